"""Widths of texts by font tables: columns against the plain metrics."""

from pyspark.sql import functions as F

from folioframe.functions.fitting import FontTable, TableMetrics

FONTS = TableMetrics((FontTable("a", ((0x0A, 0x0A, 70), (0x5B, 0x5E, 31), (0x61, 0x63, 400))), FontTable("b", ((0x41, 0x7A, 900), (0x1F600, 0x1F64F, 1200)))), missing=300)
TEXTS = ["", "abcd", "[^]-\\", "a\nb\r", "x😀y𝄞", "ÄÖ 12", "zzz", "\n", None]


def test_column_widths_are_the_plain_ones(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    for metrics in (FONTS, TableMetrics((), missing=250)):
        for r in df.select("text", metrics.column_width(F.col("text")).alias("w"), metrics.column_widest(F.col("text")).alias("m")).collect():
            assert r.w == (None if r.text is None else metrics.width(r.text, 1.0))
            assert r.m == max([metrics.width(c, 1.0) for c in r.text or ""], default=0.0)


def test_no_call_a_character(spark):
    """A lambda a character took 130 microseconds a text."""
    df = spark.createDataFrame([("ab",)], "text string").select(FONTS.column_width(F.col("text")), FONTS.column_widest(F.col("text")))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
