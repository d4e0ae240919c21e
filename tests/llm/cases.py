"""Awkward rows shared by the operators' tests."""

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, PASSAGE + " and more words follow here"),
    (7, PASSAGE + " and more words follow here"), (8, "one"), (9, "ÀÉ ß İ ñandú 日本語 \U0001f600 x"),
    (None, "a row without an id"), (10, "line\nLine\n line \nother\n"), (11, "a\x0bb\x0cc\rd"), (12, "!!! ### $$$"),
]
CLASHES = ["id", "row", "tk", "pos", "key", "words", "size", "ws", "fp", "score", "kept", "n_words", "slot", "rank", "off",
           "bucket", "gone", "target", "si", "token", "word", "hit", "lines", "items", "copies"]


def docs(spark, texts=None, extra=True):
    """documents with every awkward row; extra columns carry the operators' inner names."""
    rows = [(i, t, "en" if n % 3 else None, f"src{n % 2}" if n % 5 else None, None if t is None else len(t))
            for n, (i, t) in enumerate(TEXTS if texts is None else texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    return df


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
