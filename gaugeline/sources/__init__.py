"""Sources: turn stored tables, request bodies and samples into metric rows."""

from gaugeline.sources.tables import load_table
from gaugeline.sources.updates import (update_log, batch_bodies, single_bodies, path_requests,
                                       request_envelopes, mixed_requests, read_requests)
from gaugeline.sources.json_body import parse_batch_bodies, parse_single_bodies, with_batch_array
from gaugeline.sources.path import parse_update_paths
from gaugeline.sources.snapshot import read_snapshot
from gaugeline.sources.state import read_state, read_typed_state
from gaugeline.sources.samples import unpivot_samples, explode_samples

__all__ = [
    "load_table", "update_log", "batch_bodies", "single_bodies", "path_requests",
    "request_envelopes", "mixed_requests", "read_requests", "parse_batch_bodies", "parse_single_bodies",
    "with_batch_array", "parse_update_paths", "read_snapshot", "read_state", "read_typed_state",
    "unpivot_samples", "explode_samples",
]
