"""The corpus pipeline: raw documents to packed sequences. Its stages are in ``quaymark.llm.pipeline``."""

from quaymark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
