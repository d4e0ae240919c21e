"""Feed date parsing: RFC 2822 the way Python's ``email.utils`` reads it, plus ISO-8601."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import PY_WS, _c

# Fixed values that must equal the reference's behaviour (Python's email.utils tables).
DAY_NAMES = "mon tue wed thu fri sat sun".split()
MONTH_NAMES = "january february march april may june july august september october november december".split()
ZONE_OFFSETS = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "AST": "-0400", "ADT": "-0300",
    "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}
RFC_PATTERN = "d MMM yyyy HH:mm[:ss] xx"
RFC_PATTERN_2DIGIT = "d MMM yy HH:mm[:ss] xx"


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn`` (keeps generated code small)."""
    return F.get(F.transform(F.array(value), fn), 0)


def _to_utc(s: Column) -> Column:
    four = F.try_to_timestamp(s, F.lit(RFC_PATTERN))
    # two-digit years: 69-99 are 19xx in Python, 20xx in Spark
    two = _let(F.try_to_timestamp(s, F.lit(RFC_PATTERN_2DIGIT)),
               lambda ts: F.when(F.year(ts) >= 2069, ts - F.expr("INTERVAL 100 YEARS")).otherwise(ts))
    return F.coalesce(four, two)


def parse_rfc2822(col) -> Column:
    """RFC 2822 date text -> UTC timestamp, NULL where Python's parser would fail."""
    t = F.trim(F.regexp_replace(_c(col), PY_WS + "+", " "))
    # a leading token ending in ',' (or holding one) or a bare day name is dropped
    t = F.regexp_replace(t, r"(?i)^(\S*,\s*|(" + "|".join(DAY_NAMES) + r")(\s+|$))", "")
    # a zone glued to the time: '10:00:00+0200'
    t = F.regexp_replace(t, r"^(\S+ \S+ \S+ [0-9:]+)([+-][0-9]+)(?= |$)", "$1 $2")
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    zones = _literal_map(ZONE_OFFSETS)

    def on_parts(p):
        mon = _let(F.lower(F.get(p, 1)),
                   lambda m: F.when(F.array_contains(months, m), F.substring(m, 1, 3)).otherwise(m))
        off = _let(F.coalesce(F.get(p, 4), F.lit("")), lambda tz: F.when(tz.rlike(r"^[+-][0-9]{4}$"), tz).otherwise(
            # unknown or missing zone: Python returns a naive datetime, which the reader takes as UTC
            F.coalesce(F.try_element_at(zones, F.upper(tz)), F.lit("+0000"))))
        s = F.concat_ws(" ", F.get(p, 0), mon, F.get(p, 2), F.get(p, 3), off)
        return F.when(F.size(p) >= 4, _let(s, _to_utc))

    return _let(F.split(t, " ", 6), on_parts)


def parse_iso8601(col) -> Column:
    c = F.trim(_c(col))
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), F.try_to_timestamp(c))


def raw_published(published, updated) -> Column:
    """``published or updated``: the first non-empty of the two."""
    return F.coalesce(F.nullif(_c(published), F.lit("")), F.nullif(_c(updated), F.lit("")))


def parse_published(published, updated, strict_rfc: bool = False) -> Column:
    """Parsed publication instant or NULL. ``strict_rfc`` reads RFC 2822 only, like the
    reference; by default ISO-8601 (usual in Atom) is accepted as a second form."""
    raw = raw_published(published, updated)
    rfc = parse_rfc2822(raw)
    return rfc if strict_rfc else F.coalesce(rfc, parse_iso8601(raw))
