"""Import every query module so the registry is complete."""

from corpusflow.plans import q_articles, q_ingest, q_similar, q_stream, q_text, q_training  # noqa: F401
from corpusflow.plans.registry import ORACLE, QUERIES  # noqa: F401
