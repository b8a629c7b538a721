"""Batch operators: DataFrame(s) in, DataFrame out, all lazy."""

from gaugeline.operators.validate import (row_error_code, classify, batch_outcomes, bad_batches,
                                          gate_batches, lenient_filter, rejects, batch_lanes,
                                          error_label)
from gaugeline.operators.signature import signature_state, verify_signatures
from gaugeline.operators.fold import (counter_totals, gauge_latest, fold_state, batch_names,
                                      batch_summary, state_documents, sized_state_documents,
                                      documents_to_rows, salvage_fold)
from gaugeline.operators.merge import merge_gauges, merge_counters, merge_state, restore_merge
from gaugeline.operators.lookup import point_lookup, bulk_lookup, asof_lookup, list_all, read_responses, stored_lookup, stored_point
from gaugeline.operators.echo import (running_sum, running_last, counter_echo, gauge_echo, update_responses,
                                      counter_increments)
from gaugeline.operators.setops import union_kinds, split_kinds

__all__ = [
    "row_error_code", "classify", "batch_outcomes", "bad_batches", "gate_batches",
    "lenient_filter", "rejects", "batch_lanes", "error_label", "signature_state",
    "verify_signatures", "counter_totals", "gauge_latest", "fold_state", "batch_names",
    "batch_summary", "state_documents", "sized_state_documents", "documents_to_rows", "merge_gauges", "merge_counters",
    "merge_state", "restore_merge", "point_lookup", "bulk_lookup", "asof_lookup", "list_all", "read_responses", "stored_lookup", "stored_point", "salvage_fold",
    "running_sum", "running_last", "counter_echo", "gauge_echo", "update_responses", "counter_increments",
    "union_kinds", "split_kinds",
]
