"""The training-data pipeline; its stages are in ``cohortloom.llm.pipeline``."""

from cohortloom.llm.pipeline import MIX_BUDGET, ORACLE_SQL, STAGES, run, tree, tree_weights

__all__ = ["MIX_BUDGET", "ORACLE_SQL", "STAGES", "run", "tree", "tree_weights"]
