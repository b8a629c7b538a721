"""Structured Streaming forms of the fold, the batch apply, snapshots,
poll windows and audit (STR-1..STR-5)."""

from gaugeline.streaming.fold import continuous_fold, start_continuous_fold, start_periodic_snapshot
from gaugeline.streaming.apply import apply_epoch, start_batch_apply
from gaugeline.streaming.ticks import poll_windows, start_poll_windows
from gaugeline.streaming.incremental import (compact, read_current, running_state, start_audit_stream,
                                             start_incremental_apply)

from gaugeline.streaming.keyed import (deliver, json_sink, start_audit_delivery, start_state_apply, start_state_fold,
                                       start_window_table, window_table)

__all__ = ["deliver", "json_sink", "start_audit_delivery", "start_state_apply", "start_state_fold", "start_window_table", "window_table",
           "continuous_fold", "start_continuous_fold", "start_periodic_snapshot", "apply_epoch",
           "start_batch_apply", "poll_windows", "start_poll_windows", "running_state",
           "start_incremental_apply", "start_audit_stream", "read_current", "compact"]
