"""The corpus pipeline; its stages and what each drops are described in ``siltstone.llm.pipeline``."""

from siltstone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
