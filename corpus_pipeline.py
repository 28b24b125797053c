"""The corpus pipeline, as the driver finds it at the top of the repository; its stages are in ``corpuslens.llm.pipeline``."""

from corpuslens.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
