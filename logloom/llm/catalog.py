"""All queries of this subpackage."""

from logloom.llm import benchmarks, chats, divergence, interactions, lines, mixing, passages, pii, pipeline, quality, simhash, suffixes, tokens, urls  # noqa: F401
from logloom.llm.registry import ORACLES, QUERIES  # noqa: F401
