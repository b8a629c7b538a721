"""gaugeline: a Spark-native engine for named gauge and counter updates.

Updates arrive as tables or streams of request bodies; the engine verifies,
validates, folds and merges them into keyed state with DataFrame plans.
Every public function takes and returns DataFrames and stays lazy; only the
writers in ``gaugeline.sinks`` and ``gaugeline.streaming`` run jobs.
"""

from gaugeline.session import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
