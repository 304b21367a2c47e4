"""Positioned text derived from the order tables by integer arithmetic, as frames and as SQL for the comparison.

The tables hold no page geometry; these views give deterministic boxes, cells, ruling lines and terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.paging import dealt

#: A short term list of our own, in file order.
TERMS = [(0, "small ring", "Sm. Rg."), (1, "ring", "Rg."), (2, "widget", "Wdgt."), (3, "hot rod", "H. Rod"), (4, "rod", "Rd."), (5, "red", "R.")]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir: str) -> DataFrame:
    """page_id, item_id, text, box, confidence, angle and source of every line item."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x1 = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 900
    y1 = (F.col("l_suppkey") * 53 + F.col("l_orderkey") * 7) % 700
    page = F.col("page_id")  # a column, so that Spark knows later on that rows are dealt by it
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    number = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    return li.join(part, li.l_partkey == part.p_partkey).withColumn("page_id", F.expr("l_orderkey DIV 8")).select(
        "page_id",
        (page * 1000 + number).alias("item_id"),
        F.col("p_name").alias("text"),
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        (x1 + 40 + F.col("l_quantity") * 4).cast("int").alias("x2"),
        (y1 + 20 + F.col("l_linenumber") * 4).cast("int").alias("y2"),
        (F.col("l_discount") * 10).alias("confidence"),
        ((F.col("l_suppkey") % 13).cast("double") - 2.0).alias("angle"),
        F.when(F.col("l_returnflag") == "A", "rapid").otherwise("layout").alias("source"),
    )


def page_ids(spark, sf_dir: str) -> DataFrame:
    """Every page once; dealt, since cells and lines of a page are many rows made of one number."""
    return dealt(table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey DIV 8").alias("page_id")), "page_id").distinct()


def cells(spark, sf_dir: str) -> DataFrame:
    """A grid of four by four cells on every page, some with a smaller cell inside; morph tells the two apart."""
    g = page_ids(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("page_id", "i", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))

    def cell(df: DataFrame, inset: tuple[int, int, int, int], morph: bool) -> DataFrame:
        a, b, c, d = inset
        return df.select("page_id", (F.col("i") * 240 + a).alias("x1"), (F.col("j") * 180 + b).alias("y1"), (F.col("i") * 240 + c).alias("x2"), (F.col("j") * 180 + d).alias("y2"), F.lit(morph).alias("morph"))

    return cell(g, (0, 0, 240, 180), False).unionAll(cell(g.filter((F.col("page_id") + F.col("i") + F.col("j")) % 3 == 0), (20, 20, 220, 160), True))


def rulings(spark, sf_dir: str) -> DataFrame:
    """Ten horizontal and eight vertical lines a page."""
    p = page_ids(spark, sf_dir)
    h = p.select("page_id", F.lit("h").alias("orient"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).withColumn("pos", ((F.col("k") * 97 + F.col("page_id") * 13) % 800).cast("int"))
    v = p.select("page_id", F.lit("v").alias("orient"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).withColumn("pos", ((F.col("k") * 131 + F.col("page_id") * 17) % 1100).cast("int"))
    return h.unionAll(v).select("page_id", "orient", "pos")


def segments(spark, sf_dir: str) -> DataFrame:
    """Items read as line segments: flat, upright or slanted by their number."""
    kind = F.col("item_id") % 3
    return items(spark, sf_dir).select(
        "page_id", "item_id", "x1", "y1",
        F.when(kind == 1, F.col("x1") + F.col("item_id") % 5).otherwise(F.col("x2")).cast("int").alias("x2"),
        F.when(kind == 0, F.col("y1") + F.col("item_id") % 4).otherwise(F.col("y2") * F.when(kind == 1, 1).otherwise(2)).cast("int").alias("y2"),
    )


def terms(spark) -> DataFrame:
    return spark.createDataFrame(TERMS, "ord int, cn string, en string")


_TERM_ROWS = ", ".join(f"({o}, '{a}', '{b}')" for o, a, b in TERMS)

SQL_VIEWS = {
    "items": """items AS (SELECT l_orderkey // 8 AS page_id,
  (l_orderkey // 8) * 1000 + row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS item_id,
  p_name AS text, CAST((l_partkey * 37 + l_linenumber * 11) % 900 AS INT) AS x1, CAST((l_suppkey * 53 + l_orderkey * 7) % 700 AS INT) AS y1,
  CAST((l_partkey * 37 + l_linenumber * 11) % 900 + 40 + l_quantity * 4 AS INT) AS x2, CAST((l_suppkey * 53 + l_orderkey * 7) % 700 + 20 + l_linenumber * 4 AS INT) AS y2,
  l_discount * 10 AS confidence, CAST(l_suppkey % 13 AS DOUBLE) - 2.0 AS angle, CASE WHEN l_returnflag = 'A' THEN 'rapid' ELSE 'layout' END AS source
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "pids": "pids AS (SELECT DISTINCT l_orderkey // 8 AS page_id FROM lineitem)",
    "cells": """cells AS (SELECT page_id, CAST(i * 240 AS INT) AS x1, CAST(j * 180 AS INT) AS y1, CAST(i * 240 + 240 AS INT) AS x2, CAST(j * 180 + 180 AS INT) AS y2, false AS morph FROM pids, range(4) a(i), range(4) b(j)
  UNION ALL SELECT page_id, CAST(i * 240 + 20 AS INT), CAST(j * 180 + 20 AS INT), CAST(i * 240 + 220 AS INT), CAST(j * 180 + 160 AS INT), true FROM pids, range(4) a(i), range(4) b(j) WHERE (page_id + i + j) % 3 = 0)""",
    "rulings": """rulings AS (SELECT page_id, 'h' AS orient, CAST((k * 97 + page_id * 13) % 800 AS INT) AS pos FROM pids, range(10) a(k)
  UNION ALL SELECT page_id, 'v', CAST((k * 131 + page_id * 17) % 1100 AS INT) FROM pids, range(8) a(k))""",
    "segments": """segments AS (SELECT page_id, item_id, x1, y1, CAST(CASE WHEN item_id % 3 = 1 THEN x1 + item_id % 5 ELSE x2 END AS INT) AS x2,
  CAST(CASE WHEN item_id % 3 = 0 THEN y1 + item_id % 4 ELSE y2 * CASE WHEN item_id % 3 = 1 THEN 1 ELSE 2 END END AS INT) AS y2 FROM items)""",
    "terms": f"terms AS (SELECT * FROM (VALUES {_TERM_ROWS}) t(ord, cn, en))",
}


def sql(body: str, *views: str) -> str:
    """A comparison query over the named views."""
    parts = [SQL_VIEWS[v] for v in SQL_VIEWS if v in views or (v == "pids" and {"cells", "rulings"} & set(views)) or (v == "items" and "segments" in views)]
    body = body.strip()
    if body.startswith(","):  # more common tables follow the views
        return "WITH " + ",\n".join(parts) + body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:]])
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
