from spoor.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
