from pyspark.sql import functions as F

from corpusflow.functions.text import py_strip


def test_feed_list_split_trim_drop_empty(spark):
    df = spark.createDataFrame([(" https://a/rss , ,https://b/feed ,, ",)], "s string")
    feeds = F.filter(F.transform(F.split("s", ","), py_strip), lambda x: x != "")
    assert df.select(feeds.alias("f")).first()["f"] == ["https://a/rss", "https://b/feed"]
