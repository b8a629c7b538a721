"""Sinks: the only functions here that run jobs (they write)."""

from gaugeline.sinks.snapshot import write_snapshot, write_snapshot_array, write_update_array
from gaugeline.sinks.report import listing_lines, write_listing
from gaugeline.sinks.audit import audit_events, single_update_audit, write_audit, fan_out
from gaugeline.sinks.outbound import signed_batches, write_signed_batches
from gaugeline.sinks.request_log import request_log, write_request_log
from gaugeline.sinks.tables import create_state_tables, drop_state_tables, write_state_tables

__all__ = [
    "write_snapshot", "write_snapshot_array", "write_update_array", "listing_lines", "write_listing", "audit_events", "single_update_audit",
    "write_audit", "fan_out", "signed_batches", "write_signed_batches", "request_log", "write_request_log",
    "create_state_tables", "drop_state_tables", "write_state_tables",
]
