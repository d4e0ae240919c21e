from datetime import timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from corpusflow.functions.dates import parse_published

CASES = [
    "Tue, 06 May 2026 10:00:00 GMT", "Wed, 06 May 2026 10:00:00 +0200", "06 May 2026 10:00:00 -0000",
    "Tue, 06 May 2026 10:00:00 EST", "Tue, 06 May 2026 10:00:00 EDT", "Tue, 06 May 2026 10:00:00",
    "Tue, 06 May 99 10:00:00 GMT", "Tue, 06 May 26 10:00 GMT", "junk", "", None, "6 May 2026 10:00 +0530",
    "Tue,06 May 2026 10:00:00 GMT", "Tue, 06 March 2026 10:00:00 GMT", "Tue, 06 May 2026 10:00:00 +0000 (UTC)",
    "Tue, 06 May 2026 10:00:00 XYZ", "Tue, 31 Feb 2026 10:00:00 GMT", "Tue, 06 May 2026 10:00:00+0200",
    "2024-01-01T00:00:07Z",
]


def stdlib_utc(text):
    """The Python standard library's RFC 2822 reading, as a naive UTC datetime (None on failure)."""
    if not text:
        return None
    try:
        dt = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    return dt.replace(tzinfo=None) if dt.tzinfo is None else dt.astimezone(timezone.utc).replace(tzinfo=None)


def test_rfc2822_matches_the_standard_library(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(CASES)], "i int, d string")
    out = df.select("i", "d", parse_published("d", F.lit(None), strict_rfc=True).alias("p")).collect()
    for r in out:
        assert r.p == stdlib_utc(r.d), r.d


def test_updated_fallback_and_iso(spark):
    df = spark.createDataFrame([("", "Tue, 06 May 2026 10:00:00 GMT"), ("2024-01-01T00:00:07Z", None),
                                ("2024-01-01T02:00:07+02:00", None)], "p string, u string")
    strict = [r[0] for r in df.select(parse_published("p", "u", strict_rfc=True)).collect()]
    lenient = [r[0] for r in df.select(parse_published("p", "u")).collect()]
    assert strict[0] is not None and strict[1] is None and strict[2] is None
    assert lenient[1] == lenient[2] and lenient[1].hour == 0
