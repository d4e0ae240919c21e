"""Size-checked broadcast for key sets whose size depends on the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize

# What one executor is asked to hold of a key set, with an allowance per row for the hash table.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32


def broadcast_if_small(keys: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, ready: bool = False) -> DataFrame:
    """Broadcast ``keys`` only if its rows take at most ``max_bytes``; else return it unmarked,
    so that the join shuffles both sides.

    The keys are materialised first, unless they are ``ready`` (a cheap step from a stored
    frame): the plan above them runs once, for the check and the join. The check sums sizes per partition and moves one row per partition."""
    keys = keys if ready else materialize(keys)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns), F.lit(ROW_OVERHEAD))
    size = keys.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(keys) if size <= max_bytes else keys
