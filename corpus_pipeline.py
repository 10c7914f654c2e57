"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing."""

from logloom.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
