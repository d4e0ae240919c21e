"""Output helpers shared by the query catalog (scalar, engine-neutral result columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_SECONDS = "yyyy-MM-dd HH:mm:ss"
TS_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TS_SECONDS = "'%Y-%m-%d %H:%M:%S'"
SQL_TS_MICROS = "'%Y-%m-%d %H:%M:%S.%f'"


def ts_str(col, micros: bool = False) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, TS_MICROS if micros else TS_SECONDS)


def sql_ts(expr: str, micros: bool = False) -> str:
    return f"strftime({expr}, {SQL_TS_MICROS if micros else SQL_TS_SECONDS})"
