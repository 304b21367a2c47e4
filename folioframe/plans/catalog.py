"""All queries over positioned text, each beside the SQL that it is compared with where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..functions.fitting import FontTable, Metrics, TableMetrics
from ..operators import aggregates, fitting, grouping, items, raster, reports, sequences, spatial, tasks, tiling, translate
from ..operators.paging import dealt
from ..session import shared_folder, stored
from ..sources import documents, readers
from ..streaming import arrivals, lifecycle
from . import flows
from . import views as v

PAGE_W, PAGE_H = 1200, 900
#: The tables hold no Han text; accented letters stand in for the script.
ACCENTED = "[äöüßàâçèéêëîïôûñóíáú]"

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = v.sql(sql, *views)
        return f

    return add


# -- projections and filters -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, coalesce(regexp_matches(text, '{ACCENTED}'), false) AS has_script FROM documents")
def script_gate(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", t.has_script(F.col("text"), ACCENTED).alias("has_script"))


@query("SELECT item_id, text FROM items WHERE confidence >= 0.15 AND regexp_matches(text, '[xyz]')", "items")
def gated_items(spark, sf):
    return items.gated(v.items(spark, sf), "[xyz]").select("item_id", "text")


@query(
    """SELECT item_id, a AS x1, b AS y1, greatest(a + 1, least(x2, 600)) AS x2, greatest(b + 1, least(y2, 500)) AS y2, greatest(a + 1, least(x2, 600)) - a AS width, greatest(b + 1, least(y2, 500)) - b AS height
    FROM (SELECT *, greatest(0, least(x1, 599)) AS a, greatest(0, least(y1, 499)) AS b FROM items)""",
    "items",
)
def clamp_bbox(spark, sf):
    return items.clamp(v.items(spark, sf), 600, 500).select("item_id", "x1", "y1", "x2", "y2", "width", "height")


@query(
    """SELECT item_id, upper(text) AS text, least(x1, x2 + 3) + 10 AS x1, least(y1, y1 + CAST(item_id % 7 AS INT)) + 20 AS y1, greatest(x2, x2 + 3) + 10 AS x2, y2 + 20 AS y2,
    round(degrees(atan2(CAST(item_id % 7 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))), 1) AS angle FROM items WHERE confidence >= 0.15""",
    "items",
)
def quad_items(spark, sf):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = g.box()
    quad = F.array(p(x1, y1), p(x2, y1 + (F.col("item_id") % 7).cast("int")), p(x2 + 3, y2), p(x1, y2))
    rows = v.items(spark, sf).select("item_id", F.concat(F.lit("  "), F.upper("text"), F.lit("\u3000")).alias("text"), F.col("confidence").alias("conf"), quad.alias("quad"), F.lit(10).alias("tile_x"), F.lit(20).alias("tile_y"))
    return items.quad_items(rows).select("item_id", "text", "x1", "y1", "x2", "y2", "angle")


@query(
    """SELECT page_id, pos, text, confidence, x1, y1, x2, y2 FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY item_id) - 1 AS INT) AS pos, text, confidence, x1, y1, x2, y2 FROM items)
    WHERE confidence >= 0.15""",
    "items",
)
def layout_results(spark, sf):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    row = F.struct("item_id", "text", "confidence", F.array("x1", "y1", "x2", "y2").alias("b"), F.array(p("x1", "y1"), p("x2", "y2")).alias("p"))
    a = v.items(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    parallel = a.select("page_id", *[F.col(f"r.{c}").alias(n) for n, c in (("rec_texts", "text"), ("rec_scores", "confidence"), ("rec_boxes", "b"), ("rec_polys", "p"))])
    return items.layout_items(parallel)


@query(
    "SELECT DISTINCT page_id, x1, y1, x2, y2 FROM cells WHERE x2 - x1 BETWEEN 20 AND 1200 AND y2 - y1 BETWEEN 20 AND 400",
    "cells",
)
def table_cells(spark, sf):
    box = lambda *c: F.collect_list(F.array(*c))  # noqa: E731  the second list has corners swapped
    r = v.cells(spark, sf).groupBy("page_id").agg(box("x1", "y1", "x2", "y2").alias("cell_box_list"), box("x2", "y2", "x1", "y1").alias("cell_boxes")).withColumn("table_cells", F.lit(None).cast("array<array<int>>"))
    return items.table_cells(r)


@query(
    """SELECT page_id AS page, string_agg(text, '' ORDER BY item_id) AS text FROM items WHERE page_id % 2 = 0 GROUP BY page_id""",
    "items",
)
def span_texts(spark, sf):
    chars = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: F.struct(x["text"].alias("c")))
    p = v.items(spark, sf).groupBy(F.col("page_id").alias("page")).agg(chars.alias("chars"))
    span = F.array(F.struct(F.col("chars")))
    line = F.array(F.struct(span.alias("spans")))
    blocks = F.array(F.struct((F.col("page") % 2).alias("type"), line.alias("lines")))
    return items.span_items(p.select("page", blocks.alias("blocks"))).select("page", "text")


@query(
    """, s AS (SELECT page_id, item_id, x1, y1, abs(x1 - lag(x1) OVER w) AS dx, abs(y1 - lag(y1) OVER w) AS dy FROM items WINDOW w AS (PARTITION BY page_id ORDER BY item_id)),
    a AS (SELECT page_id, count(*) AS n_chars, sum(dx) AS sx, sum(dy) AS sy, arg_max(y1, item_id) - arg_min(y1, item_id) AS ey, arg_max(x1, item_id) - arg_min(x1, item_id) AS ex FROM s GROUP BY page_id),
    f AS (SELECT *, n_chars >= 2 AND sy > 0 AND (sx = 0 OR sy > 1.5 * sx) AS vert FROM a)
    SELECT page_id, n_chars, vert OR page_id % 5 = 0 AS is_vertical, CASE WHEN n_chars < 2 THEN 'horizontal' WHEN vert THEN 'vertical' WHEN abs(degrees(atan2(ey, ex))) > 5 THEN 'rotated' ELSE 'horizontal' END AS direction FROM f""",
    "items",
)
def orientation_class(spark, sf):
    chars = v.items(spark, sf).select("page_id", "item_id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.when(F.col("page_id") % 5 == 0, 1).otherwise(0).alias("wmode"))
    return items.orientation(chars, ["page_id"], "item_id")


@query("SELECT page_id, count(*) FILTER (WHERE abs(angle) < 5) AS horizontal, count(*) FILTER (WHERE abs(angle) >= 5) AS rotated FROM items GROUP BY page_id", "items")
def angle_split(spark, sf):
    flat = items.near_horizontal(F.col("angle"))
    return v.items(spark, sf).groupBy("page_id").agg(F.count_if(flat).alias("horizontal"), F.count_if(~flat).alias("rotated"))


@query("SELECT item_id FROM items WHERE x2 - x1 BETWEEN 20 AND 1200 AND y2 - y1 BETWEEN 20 AND 400", "items")
def cell_size_gate(spark, sf):
    return items.cell_gate(v.items(spark, sf)).select("item_id")


@query(
    """SELECT item_id FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM items) WHERE w * h >= 200 AND w * h <= 0.85 * 8000 AND greatest(w, h) / greatest(1, least(w, h)) <= 40""",
    "items",
)
def component_gate(spark, sf):
    return items.component_gate(v.items(spark, sf), 8000).select("item_id")


@query("SELECT item_id FROM items WHERE (item_id % 100) * 50 / greatest(1, (x2 - x1) * (y2 - y1)) >= 0.55 AND confidence >= 0.65", "items")
def contour_gate(spark, sf):
    c = v.items(spark, sf).withColumns({"contour_area": (F.col("item_id") % 100) * 50, "white_ratio": F.col("confidence")})
    return items.contour_gate(c).select("item_id")


@query(
    """SELECT page_id, item_id, orient, CASE WHEN orient = 'h' THEN (y1 + y2) // 2 ELSE (x1 + x2) // 2 END AS pos, CASE WHEN orient = 'h' THEN least(x1, x2) ELSE least(y1, y2) END AS lo, CASE WHEN orient = 'h' THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi
    FROM (SELECT *, CASE WHEN a < 15 THEN 'h' WHEN a > 75 THEN 'v' END AS orient FROM (SELECT *, CASE WHEN x1 = x2 THEN 90.0 ELSE degrees(atan2(abs(y2 - y1), abs(x2 - x1))) END AS a FROM segments)) WHERE orient IS NOT NULL""",
    "segments",
)
def segment_classify(spark, sf):
    return items.segment_kind(v.segments(spark, sf))


@query("SELECT p_partkey, ((p_partkey * 7919) % 16777216 >> 16) / 255.0::DOUBLE AS r, (((p_partkey * 7919) % 16777216 >> 8) & 255) / 255.0::DOUBLE AS g, (((p_partkey * 7919) % 16777216) & 255) / 255.0::DOUBLE AS b FROM part")
def color_unpack(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in t.rgb((F.col("p_partkey") * 7919) % 16777216).items()])


@query("SELECT item_id, CASE WHEN confidence * 255 > 128 THEN 'black' ELSE 'white' END AS colour, CASE WHEN l2 >= 0.9 THEN 'left' WHEN r > 0.05 AND l < 0.02 THEN 'right' WHEN abs(l - r) < 0.03 THEN 'center' ELSE 'left' END AS align FROM (SELECT item_id, confidence, (item_id % 10) / 100.0 AS l, (item_id % 7) / 50.0 AS r, confidence AS l2 FROM items)", "items")
def text_colour(spark, sf):
    left, right = (F.col("item_id") % 10) / 100.0, (F.col("item_id") % 7) / 50.0
    return v.items(spark, sf).select("item_id", items.text_colour(F.col("confidence") * 255).alias("colour"), items.alignment(left, right, F.col("confidence")).alias("align"))


@query(f"SELECT source AS doc_id, CASE WHEN bool_or(doc_id // 20 < 3 AND regexp_matches(text, '{ACCENTED}')) THEN 'vector' ELSE 'scan' END AS kind FROM documents GROUP BY source")
def page_kind(spark, sf):
    pages = v.table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.expr("doc_id DIV 20").alias("page_no"), "text")
    return items.page_kind(pages, ACCENTED)


@query(f"SELECT source AS doc_id, CASE WHEN bool_or(doc_id // 20 = 0 AND regexp_matches(text, '{ACCENTED}')) THEN 'vector' ELSE 'scan' END AS kind FROM documents GROUP BY source")
def page_kind_first(spark, sf):
    pages = v.table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.expr("doc_id DIV 20").alias("page_no"), "text")
    return items.page_kind(pages, ACCENTED, first=1)


# -- dictionary, cache and replies -------------------------------------------------------------------------------


@query("SELECT page_id, count(*) AS total, count(en) FILTER (WHERE en <> text) AS translated, count(*) - count(en) FILTER (WHERE en <> text) AS untranslated, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM items LEFT JOIN terms ON text = cn WHERE confidence >= 0.15 GROUP BY page_id", "items", "terms")
def translation_coverage(spark, sf):
    gated = items.gated(v.items(spark, sf), None)
    return aggregates.coverage(translate.with_terms(gated, v.terms(spark)), ["page_id"])


def _short(spark, sf) -> DataFrame:
    """Items with the first word as text in every second row, so that the term list finds some."""
    return v.items(spark, sf).withColumn("text", F.when(F.col("item_id") % 2 == 0, F.split_part("text", F.lit(" "), F.lit(1))).otherwise(F.col("text")))


_SHORT = ", short AS (SELECT * REPLACE (CASE WHEN item_id % 2 = 0 THEN split_part(text, ' ', 1) ELSE text END AS text) FROM items)"


@query(_SHORT + " SELECT item_id, en AS absent, coalesce(en, text) AS always FROM short LEFT JOIN terms ON text = cn", "items", "terms")
def dict_exact(spark, sf):
    d = v.terms(spark)
    a = translate.with_terms(_short(spark, sf), d).withColumnRenamed("translated", "absent")
    return translate.with_terms(a, d, "set").select("item_id", "absent", F.col("translated").alias("always"))


_NESTED = "text"
for _cn, _en in [(a, b) for _, a, b in sorted(v.TERMS, key=lambda x: (-len(x[1]), x[0]))]:
    _NESTED = f"replace({_NESTED}, '{_cn}', '{_en}')"


@query(f"SELECT item_id, {_NESTED} AS translated FROM items", "items")
def dict_longest_replace(spark, sf):
    return translate.replace_terms(v.items(spark, sf), v.terms(spark)).select("item_id", "translated")


_CACHE = ", cache AS (SELECT DISTINCT p_name AS text, upper(p_name) AS translated FROM part WHERE p_partkey % 3 = 0)"


def _cache(spark, sf) -> DataFrame:
    return v.table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.col("p_name").alias("text"), F.upper("p_name").alias("translated")).distinct()


@query(_SHORT + _CACHE + " SELECT item_id, coalesce(en, c.translated) AS translated, en IS NULL AND c.text IS NOT NULL AS hit FROM short s LEFT JOIN terms ON s.text = cn LEFT JOIN cache c ON c.text = s.text", "items", "terms")
def cache_cascade(spark, sf):
    out, _ = translate.cache_cascade(translate.with_terms(_short(spark, sf), v.terms(spark)), _cache(spark, sf))
    return out.select("item_id", "translated", "hit")


@query(_SHORT + _CACHE + ", o AS (SELECT DISTINCT s.text FROM short s LEFT JOIN terms ON s.text = cn LEFT JOIN cache c ON c.text = s.text WHERE en IS NULL AND c.text IS NULL) SELECT text, (row_number() OVER (ORDER BY text) - 1) // 40 + 1 AS batch_no, row_number() OVER (ORDER BY text) AS id FROM o", "items", "terms")
def llm_batches(spark, sf):
    _, left = translate.cache_cascade(translate.with_terms(_short(spark, sf), v.terms(spark)), _cache(spark, sf))
    return translate.batches(left, ["text"])


@query(
    """, s AS (SELECT DISTINCT text FROM (SELECT p_name AS text FROM part)), b AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM s)
    SELECT CAST((id - 1) // 10 + 1 AS INT) AS batch_no, CAST(id AS INT) AS id, CASE WHEN id % 4 = 0 THEN NULL ELSE upper(text) || chr(10) || 'x' END AS trn FROM b WHERE id % 7 <> 0""".replace(", s AS", "WITH s AS", 1)
)
def tag_parse(spark, sf):
    return translate.tagged_replies(_replies(spark, sf)).withColumn("batch_no", F.col("batch_no").cast("int"))


def _names(spark, sf) -> DataFrame:
    names = v.table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    return translate.batches(names, ["text"], 10)


def _replies(spark, sf) -> DataFrame:
    """Tagged replies: every seventh id is missing, every fourth has no TRN."""
    trn = F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("TRN: "), F.upper("text"), F.lit("\nx\n")))
    block = F.concat(F.lit("[ITEM_START]\nID: "), F.col("id").cast("string"), F.lit("\nSRC: "), F.col("text"), F.lit("\n"), trn, F.lit("[ITEM_END]"))
    r = _names(spark, sf).filter("id % 7 <> 0").groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))).alias("r"))
    return r.select("batch_no", F.array_join(F.transform("r", lambda x: x["b"]), "\n").alias("body"))


@query(
    """WITH s AS (SELECT DISTINCT p_name AS text FROM part), b AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM s)
    SELECT CAST(id AS INT) AS id, CASE WHEN id % 7 = 0 OR id % 4 = 0 THEN text ELSE upper(text) || chr(10) || 'x' END AS translated FROM b"""
)
def reply_join(spark, sf):
    out = translate.join_replies(_names(spark, sf), translate.tagged_replies(_replies(spark, sf)))
    return out.select("id", "translated")


@query(
    """WITH s AS (SELECT DISTINCT p_name AS text FROM part), b AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM s)
    SELECT (id - 1) // 10 + 1 AS batch_no, count(*) AS sent, count(*) FILTER (WHERE id % 7 <> 0 AND id % 4 <> 0) AS matched, 2 * count(*) FILTER (WHERE id % 7 <> 0 AND id % 4 <> 0) < count(*) AS loose FROM b GROUP BY 1"""
)
def parse_rate(spark, sf):
    return translate.parse_rates(_names(spark, sf), translate.tagged_replies(_replies(spark, sf)))


@query(
    """WITH s AS (SELECT DISTINCT p_name AS text FROM part), b AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM s)
    SELECT CAST((id - 1) // 10 + 1 AS INT) AS batch_no, CAST(id AS INT) AS id, upper(text) AS trn FROM b WHERE id % 3 <> 0"""
)
def numbered_parse(spark, sf):
    point = F.when(F.col("id") % 2 == 0, F.lit("、 ")).otherwise(F.lit(". "))
    line = F.when(F.col("id") % 3 == 0, F.lit("no number here")).otherwise(F.concat(F.col("id").cast("string"), point, F.lit('"'), F.upper("text"), F.lit('"')))
    r = _names(spark, sf).groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))).alias("r"))
    replies = r.select("batch_no", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("body"))
    return translate.numbered_replies(replies).withColumn("batch_no", F.col("batch_no").cast("int"))


_SENT = "WITH s AS (SELECT DISTINCT p_name AS text FROM part), b AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM s) "


@query(_SENT + "SELECT (id - 1) // 10 + 1 AS batch_no, string_agg('[ITEM_START]' || chr(10) || 'ID: ' || id || chr(10) || 'SRC: ' || text || chr(10) || '[ITEM_END]', chr(10) ORDER BY id) AS body FROM b GROUP BY 1")
def tagged_requests(spark, sf):
    return translate.requests(_names(spark, sf))


@query(_SENT + """SELECT (id - 1) // 10 + 1 AS batch_no, string_agg(id || '. "' || text || '"' || CASE WHEN id % 3 = 0 THEN ' [vertical]' ELSE '' END, chr(10) ORDER BY id) AS body FROM b GROUP BY 1""")
def numbered_requests(spark, sf):
    return translate.requests(_names(spark, sf).withColumn("is_vertical", F.col("id") % 3 == 0), tagged=False)


@query("WITH a AS (SELECT DISTINCT p_name AS text FROM part), b AS (SELECT text, lower(text) AS translated, 0 AS age FROM a WHERE text < 'm' UNION ALL SELECT text, upper(text), 1 FROM a WHERE text > 'h') SELECT text, arg_min(translated, age) AS translated FROM b GROUP BY text")
def cache_merge(spark, sf):
    names = v.table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    old = names.filter("text < 'm'").withColumn("translated", F.lower("text"))
    return translate.merged_cache(old, names.filter("text > 'h'").withColumn("translated", F.upper("text")))


@query(
    _SHORT + """, u AS (SELECT item_id, text, x1, y1, x2, y2, text || ' (long)' AS translated, item_id % 3 = 0 AS vert, 10.0 + item_id % 50 AS size FROM short),
    z AS (SELECT *, CASE WHEN 1.374 * size > x2 - x1 THEN size * ((x2 - x1) / (1.374 * size)) * 0.85 ELSE size END AS fs FROM u LEFT JOIN terms ON text = cn)
    SELECT item_id, CASE WHEN vert AND 0.5 * fs * 1.05 * length(translated) > 1.2 * (y2 - y1) AND length(en) < length(translated) THEN en ELSE translated END AS translated FROM z""",
    "items", "terms",
)
def short_term_fallback(spark, sf):
    u = _short(spark, sf).select("item_id", "text", "x1", "y1", "x2", "y2", F.concat("text", F.lit(" (long)")).alias("translated"), (F.col("item_id") % 3 == 0).alias("is_vertical"), (10.0 + F.col("item_id") % 50).alias("size"))
    return translate.short_terms(u, v.terms(spark)).select("item_id", "translated")


@query("SELECT min(p_partkey) AS ord, p_name AS cn, arg_max(upper(p_name) || ' ' || p_size, p_partkey) AS en FROM part GROUP BY p_name ORDER BY length(p_name) DESC, ord LIMIT 20")
def term_top_n(spark, sf):
    """The twenty longest names of parts as a term list, in file order; the last wording of a name counts."""
    d = v.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("cn"), F.concat_ws(" ", F.upper("p_name"), "p_size").alias("en"))
    return translate.distinct_terms(d).orderBy(F.desc(F.char_length("cn")), "ord").limit(20).select("ord", "cn", "en")


@query(
    """WITH k AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0),
    o AS (SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS a, 'Customer#' || lpad(CAST(o_custkey * 7 % 20011 AS VARCHAR), 9, '0') AS b FROM orders)
    SELECT o_orderkey, 'Order ' || o_orderkey || ' for ' || coalesce('K' || x.c_custkey, replace(a, 'Customer', 'Client')) || ' and ' || coalesce('K' || y.c_custkey, replace(b, 'Customer', 'Client')) AS translated
    FROM o LEFT JOIN k x ON a = x.c_name LEFT JOIN k y ON b = y.c_name"""
)
def dict_large_replace(spark, sf):
    """Names of customers as a dictionary that grows with the tables: longest first, so a name that is known is not taken for its first word."""
    names = v.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("cn"), F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("en"))
    one = v.table(spark, sf, "customer").select(F.lit(-1).cast("bigint").alias("ord"), F.lit("Customer").alias("cn"), F.lit("Client").alias("en")).limit(1)
    name = lambda key: F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))
    key = F.col("o_custkey")
    texts = v.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" for "), name(key), F.lit(" and "), name(key * 7 % 20011)).alias("text"))
    return translate.replace_terms(texts, names.unionByName(one)).select("o_orderkey", "translated")


@query("SELECT p_size AS page, p_name AS cn, upper(p_name) AS en, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS ord FROM part")
def json_terms(spark, sf):
    """Names of a size as one JSON object in order, read back with their places; equal names stay apart."""
    pair = F.substring(F.to_json(F.create_map("p_name", F.upper("p_name"))), 2, 1 << 20)
    one = F.expr("substring(j, 1, length(j) - 1)")
    rows = v.table(spark, sf, "part").select(F.col("p_size").alias("page"), "p_partkey", pair.alias("j")).withColumn("j", one)
    objects = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "j"))).alias("r"))
    return readers.terms_of(objects.select("page", F.concat(F.lit("{"), F.array_join("r.j", ", "), F.lit("}")).alias("value")))


@query(_SHORT + _CACHE + " SELECT item_id, coalesce(en, c.translated, CASE WHEN s.text LIKE '%g%' THEN s.text ELSE 'T:' || s.text END) AS translated FROM short s LEFT JOIN terms ON s.text = cn LEFT JOIN cache c ON c.text = s.text", "items", "terms")
def translate_flow(spark, sf):
    """Dictionary, cache, and a translator that leaves texts with a g unanswered."""
    answer = lambda texts: [None if "g" in x else f"T:{x}" for x in texts]
    return flows.translated(_short(spark, sf), v.terms(spark), _cache(spark, sf), answer).select("item_id", "translated")


# -- spatial joins -----------------------------------------------------------------------------------------------

_OVER = "(least(i.x2, c.x2) - greatest(i.x1, c.x1))::BIGINT * (least(i.y2, c.y2) - greatest(i.y1, c.y1))"
_MEET = "i.page_id = c.page_id AND i.x1 < c.x2 AND c.x1 < i.x2 AND i.y1 < c.y2 AND c.y1 < i.y2"
_BEST = f"""best AS (SELECT i.page_id, item_id, {_OVER} AS overlap, c.x1 AS c_x1, c.y1 AS c_y1, c.x2 AS c_x2, c.y2 AS c_y2 FROM items i JOIN cells c ON {_MEET}
  WHERE {_OVER} > 0.5 * (i.x2 - i.x1) * (i.y2 - i.y1) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY {_OVER} DESC, c.y1, c.x1) = 1)"""


@query(f", {_BEST} SELECT * FROM best", "items", "cells")
def best_cell_assign(spark, sf):
    return spatial.best_cell(v.items(spark, sf), v.cells(spark, sf))


@query("SELECT i.page_id, item_id, min(greatest(0, c.x1 - i.x2, i.x1 - c.x2, c.y1 - i.y2, i.y1 - c.y2)) AS gap FROM items i JOIN cells c ON i.page_id = c.page_id GROUP BY 1, 2", "items", "cells")
def nearest_cell_gap(spark, sf):
    return spatial.nearest_cell_gap(v.items(spark, sf), v.cells(spark, sf))


_IN = "b.page_id = a.page_id AND b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2"


@query(f"SELECT * FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE {_IN} AND (b.x2 - b.x1) * (b.y2 - b.y1) > (a.x2 - a.x1) * (a.y2 - a.y1))", "cells")
def drop_contained_cells(spark, sf):
    return spatial.without_contained(v.cells(spark, sf))


@query(", c2 AS (SELECT * REPLACE (NOT morph AS morph) FROM cells) SELECT * FROM c2 a WHERE morph OR NOT EXISTS (SELECT 1 FROM c2 b WHERE b.morph AND " + _IN + " AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2))", "cells")
def protected_antijoin(spark, sf):
    return spatial.outside_protected(v.cells(spark, sf).withColumn("morph", ~F.col("morph")))


@query(f"SELECT item_id FROM items a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE {_IN})", "items", "cells")
def uncovered_items(spark, sf):
    return spatial.uncovered(v.items(spark, sf), v.cells(spark, sf)).select("item_id")


@query(
    f"""SELECT c.page_id, c.x1, c.y1, c.x2, c.y2 FROM cells c WHERE EXISTS (SELECT 1 FROM items i WHERE i.page_id = c.page_id AND (
      ((i.x1 + i.x2) / 2 BETWEEN c.x1 AND c.x2 AND (i.y1 + i.y2) / 2 BETWEEN c.y1 AND c.y2)
      OR (i.x1 < c.x2 AND c.x1 < i.x2 AND i.y1 < c.y2 AND c.y1 < i.y2 AND {_OVER} > 0.3 * (i.x2 - i.x1) * (i.y2 - i.y1))
      OR ((c.x1 + c.x2) / 2 - (i.x1 + i.x2) / 2) ** 2 + ((c.y1 + c.y2) / 2 - (i.y1 + i.y2) / 2) ** 2 <= 2500))""",
    "items", "cells",
)
def cells_near_text(spark, sf):
    return spatial.cells_near_text(v.cells(spark, sf), v.items(spark, sf)).select("page_id", "x1", "y1", "x2", "y2")


@query(
    """, k AS (SELECT page_id, x1 + CAST((x1 // 20 * 7 + y1 // 20 * 3 + page_id) % 23 AS INT) AS x1, y1 + CAST((y1 // 20 + page_id) % 19 AS INT) AS y1, x2, y2 FROM cells), n AS (SELECT page_id, count(*) AS n FROM k GROUP BY 1)
    SELECT a.page_id, a.x1, a.y1, a.x2, a.y2 FROM k a JOIN n ON a.page_id = n.page_id WHERE n <= 1 OR EXISTS (SELECT 1 FROM k b WHERE a.page_id = b.page_id AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2) AND (
      (abs(a.y1 - b.y1) <= 8 AND abs(a.y2 - b.y2) <= 8 AND least(abs(a.x2 - b.x1), abs(b.x2 - a.x1)) <= 10) OR (abs(a.x1 - b.x1) <= 8 AND abs(a.x2 - b.x2) <= 8 AND least(abs(a.y2 - b.y1), abs(b.y2 - a.y1)) <= 10)))""",
    "cells",
)
def grid_neighbors(spark, sf):
    """Cells whose left and upper sides are moved by a few pixels, so that some are out of line."""
    x1 = (F.col("x1") + F.expr("(x1 DIV 20 * 7 + y1 DIV 20 * 3 + page_id) % 23")).cast("int")
    k = v.cells(spark, sf).withColumns({"x1": x1, "y1": (F.col("y1") + F.expr("(y1 DIV 20 + page_id) % 19")).cast("int")})
    return spatial.grid_neighbours(k).select("page_id", "x1", "y1", "x2", "y2")


_LINES = """, lines AS (SELECT page_id, orient, pos, CAST(pos % 300 AS INT) AS lo, CAST(pos % 300 + 400 AS INT) AS hi FROM rulings)"""


def _lines(spark, sf) -> DataFrame:
    return v.rulings(spark, sf).withColumns({"lo": F.col("pos") % 300, "hi": F.col("pos") % 300 + 400})


@query(_LINES + " SELECT a.page_id, a.orient, a.pos, count(DISTINCT b.pos) AS crossings FROM (SELECT DISTINCT page_id, orient, pos FROM lines) a JOIN lines b ON a.page_id = b.page_id AND a.orient <> b.orient AND a.pos BETWEEN b.lo - 100 AND b.hi + 100 GROUP BY 1, 2, 3 HAVING count(DISTINCT b.pos) >= 2", "rulings")
def line_crossings(spark, sf):
    return spatial.line_crossings(_lines(spark, sf))


_GRID = """p AS (SELECT page_id, orient, pos, lead(pos) OVER (PARTITION BY page_id, orient ORDER BY pos) AS nxt FROM (SELECT DISTINCT page_id, orient, pos FROM rulings)),
  grid AS (SELECT h.page_id, v.pos AS x1, h.pos AS y1, v.nxt AS x2, h.nxt AS y2 FROM p h JOIN p v ON h.page_id = v.page_id AND h.orient = 'h' AND v.orient = 'v' WHERE h.nxt - h.pos BETWEEN 20 AND 400 AND v.nxt - v.pos BETWEEN 20 AND 1200)"""


@query(f", {_GRID} SELECT * FROM grid", "rulings")
def grid_cells(spark, sf):
    return spatial.grid_cells(v.rulings(spark, sf))


def _covers(orient: str, at: str, a: str, b: str) -> str:
    one = lambda k: f"(abs(s.pos - {at}) <= {k} AND s.lo <= {a} + {k} AND s.hi >= {b} - {k})"
    return f"CASE WHEN EXISTS (SELECT 1 FROM lines s WHERE s.page_id = c.page_id AND s.orient = '{orient}' AND ({one(5)} OR {one(9)})) THEN 1 ELSE 0 END"


@query(f"{_LINES}, {_GRID}, q AS (SELECT page_id, x1, y1, x2, y2, ({_covers('h', 'c.y1', 'c.x1', 'c.x2')} + {_covers('h', 'c.y2', 'c.x1', 'c.x2')} + {_covers('v', 'c.x1', 'c.y1', 'c.y2')} + {_covers('v', 'c.x2', 'c.y1', 'c.y2')})::BIGINT AS sides FROM grid c) SELECT * FROM q WHERE sides >= 3", "rulings")
def closed_sides(spark, sf):
    return spatial.closed_sides(spatial.grid_cells(v.rulings(spark, sf)), _lines(spark, sf))


@query(
    """SELECT i.page_id, item_id, coalesce(max(pos) FILTER (WHERE orient = 'v' AND pos <= (i.x1 + i.x2) // 2), 0) AS x1, coalesce(max(pos) FILTER (WHERE orient = 'h' AND pos <= (i.y1 + i.y2) // 2), 0) AS y1,
    coalesce(min(pos) FILTER (WHERE orient = 'v' AND pos >= (i.x1 + i.x2) // 2), 1200) AS x2, coalesce(min(pos) FILTER (WHERE orient = 'h' AND pos >= (i.y1 + i.y2) // 2), 900) AS y2 FROM items i JOIN rulings r ON i.page_id = r.page_id GROUP BY 1, 2""",
    "items", "rulings",
)
def bounding_lines_asof(spark, sf):
    return spatial.bounding_lines(v.items(spark, sf), v.rulings(spark, sf), PAGE_W, PAGE_H)




@query(
    """, p AS MATERIALIZED (SELECT i.page_id, i.item_id AS a, c.item_id AS b, i.x1 AS ax1, i.y1 AS ay1, i.x2 AS ax2, i.y2 AS ay2, c.x1 AS bx1, c.y1 AS by1, c.x2 AS bx2, c.y2 AS by2 FROM items i JOIN items c ON i.page_id = c.page_id),
    q AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS s FROM p WHERE a < b),
    r AS (SELECT page_id, a, b, s / (greatest(1, (ax2 - ax1) * (ay2 - ay1)) + greatest(1, (bx2 - bx1) * (by2 - by1)) - s)::DOUBLE AS iou FROM q WHERE s > 0) SELECT page_id, a, b, iou FROM r WHERE iou >= 0.45""",
    "items",
)
def near_dup_pairs(spark, sf):
    return spatial.near_duplicates(v.items(spark, sf))


_SHIFT = "SELECT a.page_id, a.item_id, b.item_id AS below, b.y1 - a.y2 AS v_gap FROM items a JOIN items b ON a.page_id = b.page_id AND a.item_id <> b.item_id AND b.y1 >= a.y2 AND {cond} QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY b.y1 - a.y2, b.item_id) = 1"
_SHARE = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(a.x2 - a.x1, b.x2 - b.x1, 1)"


@query(_SHIFT.format(cond=f"b.y1 - a.y2 <= 2.5 * ((a.y2 - a.y1 + b.y2 - b.y1) / 2) AND (abs(a.x1 - b.x1) < 60 OR abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) < 80 OR abs(a.x2 - b.x2) < 60 OR {_SHARE} > 0.4)"), "items")
def nearest_below(spark, sf):
    return spatial.nearest_below(v.items(spark, sf))


@query(_SHIFT.format(cond=f"b.y1 - a.y2 <= 1.2 * ((greatest(1, a.y2 - a.y1) + greatest(1, b.y2 - b.y1)) / 2) AND (abs(a.x1 - b.x1) <= 24 OR abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) <= 36 OR {_SHARE} > 0.55)"), "items")
def nearest_below_strict(spark, sf):
    return spatial.nearest_below(v.items(spark, sf), strict=True)


@query("SELECT i.page_id, item_id, list_sort(list(DISTINCT pos)) AS lines FROM items i JOIN rulings r ON i.page_id = r.page_id AND orient = 'h' AND i.y1 < pos AND pos < i.y2 GROUP BY 1, 2", "items", "rulings")
def item_line_crossings(spark, sf):
    return spatial.crossed_by_lines(v.items(spark, sf), v.rulings(spark, sf).filter("orient = 'h'"))


@query("SELECT page_id, count(*) AS crossed FROM items i WHERE EXISTS (SELECT 1 FROM rulings r WHERE r.page_id = i.page_id AND ((orient = 'h' AND i.y1 < pos AND pos < i.y2) OR (orient = 'v' AND i.x1 < pos AND pos < i.x2))) GROUP BY 1", "items", "rulings")
def cut_crossings(spark, sf):
    return spatial.cut_crossings(v.items(spark, sf), v.rulings(spark, sf))


@query(
    """, p AS MATERIALIZED (SELECT i.page_id, i.x1 AS a_x1, i.y1 AS a_y1, i.x2 AS a_x2, i.y2 AS a_y2, c.x1 AS b_x1, c.y1 AS b_y1, c.x2 AS b_x2, c.y2 AS b_y2 FROM cells i JOIN cells c ON i.page_id = c.page_id),
    q AS (SELECT *, (a_x2 - a_x1) * (a_y2 - a_y1) AS a, (b_x2 - b_x1) * (b_y2 - b_y1) AS b, greatest(0, least(a_x2, b_x2) - greatest(a_x1, b_x1)) * greatest(0, least(a_y2, b_y2) - greatest(a_y1, b_y1)) AS s FROM p)
    SELECT page_id, a_x1, a_y1, b_x1, b_y1 FROM q WHERE a > b AND s > 0.7 * b""",
    "cells",
)
def nested_cells(spark, sf):
    return spatial.nested_pairs(v.cells(spark, sf)).select("page_id", "a_x1", "a_y1", "b_x1", "b_y1")


@query(
    _LINES + """, pt AS (SELECT page_id, item_id, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM items),
    s AS (SELECT p.page_id, item_id, orient, pos, CASE WHEN orient = 'h' THEN cy ELSE cx END AS c, CASE WHEN orient = 'h' THEN cx ELSE cy END AS along, lo, hi FROM pt p JOIN lines l ON p.page_id = l.page_id),
    r AS (SELECT page_id, item_id, m, max(pos) FILTER (WHERE orient = 'v' AND pos <= c) AS l, max(pos) FILTER (WHERE orient = 'h' AND pos <= c) AS t, min(pos) FILTER (WHERE orient = 'v' AND pos >= c) AS r, min(pos) FILTER (WHERE orient = 'h' AND pos >= c) AS b
      FROM s, (VALUES (30), (120)) w(m) WHERE along BETWEEN lo - m AND hi + m GROUP BY 1, 2, 3),
    y AS (SELECT page_id, item_id, CASE WHEN m = 30 THEN 1 ELSE 2 END AS k, l AS x1, t AS y1, r AS x2, b AS y2 FROM r UNION ALL SELECT p.page_id, p.item_id, 3, coalesce(l, 0), coalesce(t, 0), coalesce(r, 1199), coalesce(b, 899) FROM pt p LEFT JOIN r ON r.page_id = p.page_id AND r.item_id = p.item_id AND m = 120)
    SELECT page_id, item_id, CAST(k AS INT) AS try_no, x1, y1, x2, y2 FROM y WHERE x2 - x1 BETWEEN 20 AND 1200 AND y2 - y1 BETWEEN 20 AND 400 QUALIFY row_number() OVER (PARTITION BY page_id, item_id ORDER BY k) = 1""",
    "items", "rulings",
)
def bounding_cells(spark, sf):
    return spatial.bounding_cells(v.items(spark, sf), _lines(spark, sf), PAGE_W, PAGE_H)


@query(
    """, a AS (SELECT page_id, x1, y1, x2, y2 FROM cells WHERE page_id % 3 <> 0 OR (x1 < 240 AND y1 < 360 AND NOT morph)), n AS (SELECT page_id FROM a GROUP BY 1 HAVING count(*) >= 3)
    SELECT *, 'preferred' AS engine FROM a WHERE page_id IN (SELECT page_id FROM n) UNION ALL SELECT page_id, x1, y1, x2, y2, 'fallback' FROM cells WHERE NOT morph AND page_id NOT IN (SELECT page_id FROM n)""",
    "cells",
)
def cell_dispatch(spark, sf):
    """An engine that finds two cells on every third page, and one that finds the grid."""
    c = v.cells(spark, sf)
    return flows.dispatched_cells(c.filter("page_id % 3 <> 0 OR (x1 < 240 AND y1 < 360 AND NOT morph)"), c.filter("NOT morph"))


# -- aggregates --------------------------------------------------------------------------------------------------


@query("SELECT page_id, count(*) FILTER (WHERE confidence >= 0.9) AS high, count(*) FILTER (WHERE confidence >= 0.7 AND confidence < 0.9) AS middle, count(*) FILTER (WHERE confidence < 0.7) AS rest FROM items GROUP BY page_id", "items")
def confidence_bands(spark, sf):
    return aggregates.confidence_bands(v.items(spark, sf), ["page_id"])


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE x1 < 480) AS in_table FROM items GROUP BY source", "items")
def type_counts(spark, sf):
    return v.items(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x1") < 480).alias("in_table"))


_MERGED = f""", {_BEST} SELECT b.page_id, c_x1, c_y1, string_agg(text, chr(10) ORDER BY y1, i.item_id) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(CAST(sum(CAST(round(confidence * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0::DOUBLE, 3) AS confidence,
  string_agg(DISTINCT source, '+' ORDER BY source) AS source, CAST(count(*) AS INT) AS n_lines FROM best b JOIN items i ON i.item_id = b.item_id GROUP BY 1, 2, 3, c_x2, c_y2"""


@query(_MERGED, "items", "cells")
def merged_blocks(spark, sf):
    i = stored(v.items(spark, sf).drop("angle"))  # read twice
    b = spatial.best_cell(i, v.cells(spark, sf)).drop("page_id").withColumnRenamed("item_id", "__i")
    out = aggregates.blocks(i.join(b, F.col("item_id") == F.col("__i")), ["page_id", "c_x1", "c_y1", "c_x2", "c_y2"])
    return out.select("page_id", "c_x1", "c_y1", "text", "x1", "y1", "x2", "y2", "confidence", "source", "n_lines")


@query("SELECT page_id, string_agg(DISTINCT source, '+' ORDER BY source) AS source FROM items GROUP BY page_id", "items")
def source_lineage(spark, sf):
    return v.items(spark, sf).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))


@query("SELECT page_id, count(*) AS n, count(*) FILTER (WHERE y2 - y1 > x2 - x1) AS vertical, count(DISTINCT text) AS fonts FROM items GROUP BY page_id", "items")
def page_counts(spark, sf):
    return v.items(spark, sf).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y2") - F.col("y1") > F.col("x2") - F.col("x1")).alias("vertical"), F.count_distinct("text").alias("fonts"))


@query(
    """, k AS (SELECT page_id, count(*) AS n, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS d FROM cells GROUP BY 1 HAVING count(*) >= 3)
    SELECT page_id, n, greatest(0, a - CAST(floor((c - a) * 0.2::DOUBLE) AS INT)) AS x1, greatest(0, b - CAST(floor((d - b) * 0.2::DOUBLE) AS INT)) AS y1, least(1200, c + CAST(floor((c - a) * 0.2::DOUBLE) AS INT)) AS x2, least(900, d + CAST(floor((d - b) * 0.2::DOUBLE) AS INT)) AS y2 FROM k""",
    "cells",
)
def table_region(spark, sf):
    return aggregates.table_region(v.cells(spark, sf), PAGE_W, PAGE_H)


@query(
    """, s AS (SELECT page_id, CASE WHEN item_id % 3 = 0 THEN 'h' ELSE 'v' END AS orient, CAST(x1 // 50 AS INT) AS pos, y1 AS lo, y2 AS hi FROM items) SELECT page_id, orient, pos, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM s GROUP BY 1, 2, 3""",
    "items",
)
def ruling_extents(spark, sf):
    s = v.items(spark, sf).select("page_id", F.when(F.col("item_id") % 3 == 0, "h").otherwise("v").alias("orient"), F.expr("CAST(x1 DIV 50 AS INT)").alias("pos"), F.col("y1").alias("lo"), F.col("y2").alias("hi"))
    return aggregates.ruling_extents(s)


_REPORT = f""", {_BEST}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, y2, x2) AS cell_no FROM cells)
  SELECT n.page_id, 'Cell_' || lpad(CAST(cell_no AS VARCHAR), 3, '0') AS cell_id, CAST(cell_no AS INT) AS cell_no, count(i.item_id) AS n_texts, count(i.item_id) > 1 AS multi, CASE WHEN length(arg_min(text, i.item_id)) > 60 THEN left(arg_min(text, i.item_id), 60) || '...' ELSE arg_min(text, i.item_id) END AS preview
  FROM n LEFT JOIN best b ON b.page_id = n.page_id AND n.x1 = c_x1 AND n.y1 = c_y1 AND n.x2 = c_x2 AND n.y2 = c_y2 LEFT JOIN items i ON i.item_id = b.item_id GROUP BY n.page_id, cell_no"""


def _assigned(spark, sf) -> DataFrame:
    i = stored(v.items(spark, sf))  # read twice
    b = spatial.best_cell(i, v.cells(spark, sf)).drop("page_id").withColumnRenamed("item_id", "__i")
    return i.join(b, F.col("item_id") == F.col("__i")).drop("__i")


@query(_REPORT, "items", "cells")
def cell_report(spark, sf):
    return aggregates.cell_report(v.cells(spark, sf), _assigned(spark, sf))


@query(f"{_REPORT.replace('SELECT n.page_id,', ', r AS (SELECT n.page_id,', 1)}) SELECT page_id, cell_id FROM r WHERE n_texts = 0", "items", "cells")
def empty_cells(spark, sf):
    return aggregates.cell_report(v.cells(spark, sf), _assigned(spark, sf)).filter("n_texts = 0").select("page_id", "cell_id")


@query(f", {_BEST}, k AS (SELECT page_id, count(*) AS k FROM best GROUP BY page_id, c_x1, c_y1, c_x2, c_y2), a AS (SELECT page_id, count(*) AS cells, count(*) FILTER (WHERE k > 1) AS groups, CAST(sum(k) AS BIGINT) AS inside FROM k GROUP BY 1), n AS (SELECT page_id, count(*) AS total FROM items GROUP BY 1) SELECT n.page_id, total, coalesce(cells, 0) AS cells, coalesce(groups, 0) AS groups, total - coalesce(inside, 0) AS unassigned FROM n LEFT JOIN a USING (page_id)", "items", "cells")
def merge_counters(spark, sf):
    return aggregates.merge_counters(_assigned(spark, sf), v.items(spark, sf))


def _routed(spark, sf) -> DataFrame:
    i = v.items(spark, sf)
    wide = F.col("x2") - F.col("x1") < 8 * F.char_length("text")
    return translate.with_terms(i, v.terms(spark), "set").withColumns(
        {"is_vertical": F.col("y2") - F.col("y1") > F.col("x2") - F.col("x1"), "direction": F.when(F.abs("angle") > 5, "rotated").otherwise("horizontal"), "rotation_deg": F.col("angle"), "needs_split": wide}
    )


_ROUTE = "CASE WHEN coalesce(en, text) = text AND regexp_matches(text, '[xyz]') THEN 'skipped' WHEN y2 - y1 > x2 - x1 THEN 'vertical' WHEN abs(angle) > 5 THEN 'rotated' WHEN x2 - x1 < 8 * length(text) THEN 'split' ELSE 'horizontal' END"


@query(f", r AS (SELECT page_id, {_ROUTE} AS r FROM items LEFT JOIN terms ON text = cn) SELECT page_id, " + ", ".join(f"count(*) FILTER (WHERE r = '{x}') AS {x}" for x in ("horizontal", "vertical", "rotated", "split", "skipped")) + ", count(*) AS total FROM r GROUP BY 1", "items", "terms")
def refill_routes(spark, sf):
    return aggregates.routes(_routed(spark, sf), ["page_id"], translate.refill_route("[xyz]"))


@query(f"SELECT item_id, true AS erase, {_ROUTE} <> 'skipped' AS refill FROM items LEFT JOIN terms ON text = cn", "items", "terms")
def erase_refill(spark, sf):
    return _routed(spark, sf).select("item_id", F.lit(True).alias("erase"), (translate.refill_route("[xyz]") != "skipped").alias("refill"))


@query("SELECT doc_id, CAST(len(l) AS INT) AS n_lines, list_max(list_transform(l, lambda x: length(x))) * 0.5::DOUBLE AS max_w, len(l) * 2.0::DOUBLE + (len(l) - 1) * 0.25::DOUBLE AS total_h FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def wrapped_extents(spark, sf):
    lines = F.split("text", "\n", -1)
    return v.table(spark, sf, "documents").select("doc_id", F.size(lines).alias("n_lines"), *[c.alias(n) for n, c in aggregates.wrapped_extent(lines, 0.5, 2.0, 0.25).items()])


# -- sequences, sorts and sets -----------------------------------------------------------------------------------


@query(", f AS (SELECT page_id, item_id, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page_id ORDER BY x1, item_id) <= 25 THEN 0 ELSE 1 END AS s FROM items) SELECT page_id, item_id, CAST(sum(s) OVER (PARTITION BY page_id ORDER BY x1, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f", "items")
def coord_clusters(spark, sf):
    return sequences.clusters(v.items(spark, sf), ["page_id"], "x1", 25).select("page_id", "item_id", "cluster")


@query(", f AS (SELECT page_id, item_id, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page_id ORDER BY x1, item_id) <= 20 THEN 0 ELSE 1 END AS s FROM items), c AS (SELECT page_id, x1, CAST(sum(s) OVER (PARTITION BY page_id ORDER BY x1, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f) SELECT page_id, cluster, count(*) AS n, CAST(floor(median(x1)) AS INT) AS median FROM c GROUP BY 1, 2", "items")
def cluster_medians(spark, sf):
    return sequences.cluster_medians(v.items(spark, sf), ["page_id"], "x1", 20)


@query(
    """, s AS (SELECT page_id, greatest(0, x1 - 4) AS a, least(1200, x1 + 12) AS b FROM items UNION ALL SELECT DISTINCT page_id, 1200, 1200 FROM items),
    w AS (SELECT page_id, a, coalesce(max(b) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_lo FROM s) SELECT page_id, gap_lo, a AS gap_hi FROM w WHERE a - gap_lo >= 20""",
    "items",
)
def free_gaps(spark, sf):
    """Gaps between the left edges of all items, read as bars of eight pixels."""
    return sequences.free_gaps(v.items(spark, sf).withColumn("x2", F.col("x1") + 8), ["page_id"], "x1", "x2", PAGE_W, 4, 20)


@query(", f AS (SELECT page_id, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page_id ORDER BY x1, item_id) <= 4 THEN 0 ELSE 1 END AS s FROM items), c AS (SELECT page_id, x1, CAST(sum(s) OVER (PARTITION BY page_id ORDER BY x1 RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f) SELECT page_id, cluster, CAST(floor((min(x1) + max(x1)) / 2) AS INT) AS middle FROM c GROUP BY 1, 2", "items")
def coordinate_runs(spark, sf):
    return sequences.coordinate_runs(v.items(spark, sf), ["page_id"], "x1")


@query("SELECT page_id, orient, pos, nxt AS next, nxt - pos AS step FROM (SELECT page_id, orient, pos, lead(pos) OVER (PARTITION BY page_id, orient ORDER BY pos) AS nxt FROM (SELECT DISTINCT page_id, orient, pos FROM rulings)) WHERE nxt IS NOT NULL", "rulings")
def lead_line_pairs(spark, sf):
    return sequences.next_lines(v.rulings(spark, sf), ["page_id", "orient"], "pos")


@query("SELECT item_id, CAST(greatest(1, floor((y2 - y1) * 900 / sum(y2 - y1) OVER (PARTITION BY page_id))) AS INT) AS share FROM items", "items")
def row_share(spark, sf):
    rows = v.items(spark, sf).withColumn("h", F.col("y2") - F.col("y1"))
    return sequences.row_shares(rows, ["page_id"], "h", F.lit(PAGE_H)).select("item_id", "share")


@query("SELECT item_id, CAST(coalesce(sum(y2 - y1) OVER (PARTITION BY page_id ORDER BY y1, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM items", "items")
def y_cursor(spark, sf):
    rows = v.items(spark, sf).withColumn("h", F.col("y2") - F.col("y1"))
    return sequences.y_cursor(rows, ["page_id"], ["y1", "item_id"], "h").select("item_id", "y")


@query("SELECT item_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, item_id) AS INT) AS reading, CAST(row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, y1, x1, item_id) AS INT) AS by_confidence FROM items", "items")
def reading_order(spark, sf):
    a = sequences.numbered(v.items(spark, sf), ["page_id"], ["y1", "x1", "item_id"], "reading")
    return sequences.numbered(a, ["page_id"], [F.desc("confidence"), "y1", "x1", "item_id"], "by_confidence").select("item_id", "reading", "by_confidence")


@query("SELECT page_id, CAST(n AS INT) AS cell_no, 'Cell_' || lpad(CAST(n AS VARCHAR), 3, '0') AS cell_id FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, y2, x2) AS n FROM cells)", "cells")
def cell_ids(spark, sf):
    c = aggregates.named_cells(v.cells(spark, sf))
    return c.select("page_id", t.cell_number(F.col("cell_id")).alias("cell_no"), "cell_id")


@query("SELECT page_id, text, x1, min(item_id) AS item_id FROM (SELECT page_id, text, x1 // 100 AS x1, item_id FROM items) GROUP BY 1, 2, 3", "items")
def exact_dedup(spark, sf):
    i = v.items(spark, sf).select("page_id", "text", F.expr("CAST(x1 DIV 100 AS INT)").alias("x1"), "item_id")
    return sequences.first_of(i, ["page_id", "text", "x1"], ["item_id"])


@query("SELECT page_id, x1, y1, x2, y2, string_agg(DISTINCT s, ',' ORDER BY s) AS stages FROM (SELECT *, 'A' AS s FROM cells UNION ALL SELECT *, 'M' FROM cells WHERE morph UNION ALL SELECT *, 'B' FROM cells WHERE x1 < 300) GROUP BY 1, 2, 3, 4, 5", "cells")
def stage_union(spark, sf):
    c = v.cells(spark, sf)
    every = c.withColumn("s", F.lit("A")).unionByName(c.filter("morph").withColumn("s", F.lit("M"))).unionByName(c.filter("x1 < 300").withColumn("s", F.lit("B")))
    return dealt(every, "page_id").groupBy("page_id", *spatial.BOX).agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("stages"))


@query("SELECT page_id, list_sort(list(DISTINCT e)) AS edges FROM (SELECT page_id, x1 AS e FROM cells UNION ALL SELECT page_id, x2 FROM cells) GROUP BY 1", "cells")
def edge_union(spark, sf):
    return v.cells(spark, sf).groupBy("page_id").agg(F.array_sort(F.array_union(F.collect_set("x1"), F.collect_set("x2"))).alias("edges"))


@query("SELECT item_id, source, part FROM (SELECT item_id, source, 0 AS part FROM items WHERE abs(angle) < 5 UNION ALL SELECT item_id, source, 1 FROM items WHERE abs(angle) >= 5)", "items")
def engine_union(spark, sf):
    i = v.items(spark, sf).select("item_id", "source", "angle")
    flat = items.near_horizontal(F.col("angle"))
    return i.filter(flat).withColumn("part", F.lit(0)).unionByName(i.filter(~flat).withColumn("part", F.lit(1))).drop("angle")


@query("SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos FROM documents)")
def document_lines(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS short, CASE WHEN length(source || lang) > 5 THEN left(source || lang, 2) || '...' ELSE source || lang END AS label FROM documents")
def truncate_labels(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", t.truncated(F.col("text"), 40).alias("short"), t.truncated(F.concat("source", "lang"), 5, 2).alias("label"))


# -- tiles, boxes and reports ------------------------------------------------------------------------------------

_PAGES = ", pg AS (SELECT page_id, CAST(1000 + page_id % 50 * 100 AS INT) AS page_w, CAST(800 + page_id % 40 * 90 AS INT) AS page_h FROM pids)"


def _pages(spark, sf) -> DataFrame:
    return v.page_ids(spark, sf).select("page_id", (1000 + F.col("page_id") % 50 * 100).cast("int").alias("page_w"), (800 + F.col("page_id") % 40 * 90).cast("int").alias("page_h"))


@query(_PAGES + ", s AS (SELECT page_id, page_w, page_h, unnest(range(0, greatest(1, page_w), 1980)) AS sx FROM pg), u AS (SELECT *, unnest(range(0, greatest(1, page_h), 1980)) AS sy FROM s), x AS (SELECT DISTINCT page_id, page_w, page_h, CAST(greatest(0, least(page_w, sx + 2200) - 2200) AS INT) AS x, CAST(greatest(0, least(page_h, sy + 2200) - 2200) AS INT) AS y FROM u) SELECT page_id, x, y, least(2200, page_w - x) AS w, least(2200, page_h - y) AS h FROM x", "pids")
def tiles_overlap(spark, sf):
    return tiling.overlapping_tiles(_pages(spark, sf))


@query(_PAGES + ", s AS (SELECT page_id, page_w, page_h, CAST(unnest(range(0, page_w, 1280)) AS INT) AS x FROM pg), u AS (SELECT *, CAST(unnest(range(0, page_h, 1280)) AS INT) AS y FROM s), q AS (SELECT page_id, x, y, least(1280, page_w - x) AS w, least(1280, page_h - y) AS h FROM u) SELECT * FROM q WHERE w >= 50 AND h >= 50", "pids")
def tiles_grid(spark, sf):
    return tiling.grid_tiles(_pages(spark, sf), 1280, 50)


@query("SELECT page_id, item_id, greatest(0, x1 + 1) AS x1, greatest(0, y1 + 1) AS y1, least(800, x2 - 1) AS x2, least(600, y2 - 1) AS y2 FROM items WHERE least(800, x2 - 1) > greatest(0, x1 + 1) AND least(600, y2 - 1) > greatest(0, y1 + 1)", "items")
def erase_rects(spark, sf):
    return fitting.erase_boxes(v.items(spark, sf), 1, 800, 600)


@query("SELECT item_id, CASE WHEN w <= b * 1.05::DOUBLE THEN 'whole' WHEN w * s <= b * 1.1::DOUBLE THEN 'scaled' ELSE 'wrap' END AS fit_state, CASE WHEN w <= b * 1.05::DOUBLE THEN size ELSE size * s END AS fit_size FROM (SELECT item_id, size, w, b, greatest(b / greatest(w, 1e-9), 0.4::DOUBLE) AS s FROM (SELECT item_id, CAST(10 + item_id % 30 AS DOUBLE) AS size, length(text) * 0.5::DOUBLE * (10 + item_id % 30) AS w, x2 - x1 AS b FROM items))", "items")
def fit_single_line(spark, sf):
    i = v.items(spark, sf).withColumn("size", (10 + F.col("item_id") % 30).cast("double"))
    return i.select("item_id", *[c.alias(n) for n, c in fitting.single_line(Metrics()).items()])


@query("SELECT item_id, greatest(0, x1 - 60) AS x, greatest(0, y1 - 40) AS y, greatest(0, least(800, x1 - 60 + x2) - greatest(0, x1 - 60)) AS w, greatest(0, least(600, y1 - 40 + y2) - greatest(0, y1 - 40)) AS h FROM items", "items")
def layer_clip(spark, sf):
    c = fitting.clipped_layer(F.col("x1") - 60, F.col("y1") - 40, F.col("x2"), F.col("y2"), 800, 600)
    return v.items(spark, sf).select("item_id", *[x.alias(n) for n, x in c.items()])


@query(_PAGES + " SELECT page_id, page_w * 72.0::DOUBLE / 200 AS width_pt, page_h * 72.0::DOUBLE / 200 AS height_pt, least(1.0::DOUBLE, 1280 / greatest(page_w, page_h)) AS scale FROM pg", "pids")
def pdf_dims(spark, sf):
    p = _pages(spark, sf).withColumnsRenamed({"page_w": "pixel_w", "page_h": "pixel_h"})
    return p.select("page_id", *[c.alias(n) for n, c in reports.pdf_size(200).items()], reports.coarse_scale(1280).alias("scale"))


@query("SELECT item_id, CASE WHEN confidence >= 0.9 THEN 'green' WHEN confidence >= 0.7 THEN 'orange' ELSE 'red' END AS colour, CASE WHEN confidence >= 0.8 THEN 'green' ELSE 'red' END AS simple FROM items", "items")
def overlay_colours(spark, sf):
    c = F.col("confidence")
    return v.items(spark, sf).select("item_id", reports.overlay_colour(c).alias("colour"), reports.overlay_colour(c, (0.8,)).alias("simple"))


@query("WITH c AS (SELECT count(*) AS a, count(DISTINCT p_name) AS b FROM part) SELECT CAST(0 AS INT) AS line_no, '# Report' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| metric | value |' UNION ALL SELECT 3, '|---|---|' UNION ALL SELECT 4, '| parts | ' || a || ' |' FROM c UNION ALL SELECT 5, '| names | ' || b || ' |' FROM c")
def summary_report(spark, sf):
    c = v.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("a"), F.count_distinct("p_name").alias("b"))
    return reports.report_lines(c, "Report", [("parts", "a"), ("names", "b")])


@query(f"{_REPORT.replace('SELECT n.page_id,', ', r AS (SELECT n.page_id,', 1)}) SELECT page_id, cell_no, cell_id || ': ' || CASE WHEN n_texts = 0 THEN '(empty)' ELSE n_texts || ' text(s): ' || preview END AS line FROM r", "items", "cells")
def cell_report_lines(spark, sf):
    return reports.cell_report_lines(aggregates.cell_report(v.cells(spark, sf), _assigned(spark, sf)))


# -- tasks -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def retention_sweep(spark, sf):
    return tasks.expired(v.table(spark, sf, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "user_id")


def _tasks(spark, sf) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    one = F.struct(F.concat(F.lit("/out/"), k).alias("path"), F.col("o_orderpriority").alias("description"))
    return v.table(spark, sf, "orders").select(
        k.alias("task_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("status"), F.create_map(F.lit("pdf"), one, F.lit("json"), one).alias("result_files"), F.lit(None).cast("int").alias("text_count"), F.col("o_custkey").alias("ocr_count")
    )


@query("SELECT CAST(o_orderkey AS VARCHAR) AS task_id, f AS file, '/out/' || o_orderkey AS path, o_orderpriority AS description, '/api/download/' || o_orderkey || '/' || f AS url FROM orders, (VALUES ('pdf'), ('json')) x(f) WHERE o_orderstatus = 'F'")
def task_results(spark, sf):
    return tasks.result_listing(_tasks(spark, sf))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'processing' END AS status, o_custkey AS text_count FROM orders WHERE o_orderkey = 7")
def task_lookup(spark, sf):
    return tasks.status_of(_tasks(spark, sf), "7").select("task_id", "status", F.col("text_count").cast("bigint").alias("text_count"))


@query("SELECT filename FROM (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS filename FROM part) WHERE lower(filename) LIKE '%.pdf'")
def upload_gate(spark, sf):
    end = F.when(F.col("p_partkey") % 3 == 0, ".pdf").when(F.col("p_partkey") % 3 == 1, ".PDF").otherwise(".txt")
    files = v.table(spark, sf, "part").select(F.concat(F.lit("C:\\up/"), "p_name", end).alias("path"))
    return tasks.accepted_uploads(files).select("filename")


@query("SELECT CAST(user_id AS VARCHAR) AS task_id, coalesce(arg_min(s, k) FILTER (WHERE s = 'completed'), arg_max(s, k)) AS status FROM (SELECT user_id, event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'processing' END AS s FROM events) GROUP BY user_id")
def task_states(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("task_id"), F.when(F.col("event_id") % 3 == 0, "completed").otherwise("processing").alias("status"), F.col("event_id").alias("ts"))
    return tasks.latest_states(e).select("task_id", "status")


@query("SELECT CAST(user_id AS VARCHAR) AS task_id, coalesce(arg_min(s, ts) FILTER (WHERE s IN ('completed', 'failed')), arg_max(s, ts)) AS status, max(ts) AS ts FROM (SELECT user_id, ts, CASE event_id % 40 WHEN 0 THEN 'completed' WHEN 17 THEN 'failed' WHEN 3 THEN 'uploaded' ELSE 'processing' END AS s FROM events) GROUP BY user_id")
def task_states_stream(spark, sf):
    """The event log replayed as a stream with keyed state; the last row of each task is its state."""
    k = F.col("event_id") % 40
    status = F.when(k == 0, "completed").when(k == 17, "failed").when(k == 3, "uploaded").otherwise("processing")
    stream = arrivals.arriving(spark, f"{sf}/events.parque[t]", v.table(spark, sf, "events").schema)
    folder = f"{shared_folder(spark)}/folioframe-{uuid.uuid4().hex}"
    log = stream.select(F.col("user_id").alias("task_id"), status.alias("status"), "ts")
    return lifecycle.current(lifecycle.replayed(log, f"{folder}/out", f"{folder}/checkpoint", "36500 days"))


@query("SELECT page_id, item_id, text FROM items", "items")
def page_documents(spark, sf):
    """The items of pages written as paged documents, a line a page, and read back by the page source."""
    spark.dataSource.register(documents.document_source("paged_items", None, "page_id bigint, ids array<bigint>, texts array<string>"))
    row = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    pages = v.items(spark, sf).groupBy("page_id").agg(row.alias("r")).select("page_id", F.col("r.item_id").alias("ids"), F.col("r.text").alias("texts"))
    path = f"{shared_folder(spark)}/folioframe-{uuid.uuid4().hex}"
    pages.write.format("paged_items").mode("append").save(path)
    read = spark.read.format("paged_items").schema("page_id bigint, ids array<bigint>, texts array<string>").load(path)
    return read.select("page_id", F.explode(F.arrays_zip("ids", "texts")).alias("z")).select("page_id", F.col("z.ids").alias("item_id"), F.col("z.texts").alias("text"))


@query(
    """SELECT page_id, CAST(w AS DOUBLE) AS page_width_pt, CAST(h AS DOUBLE) AS page_height_pt, 0 AS rotation, 144 AS dpi, w * 2 AS pixel_width, h * 2 AS pixel_height, w * 2 * h * 2 AS n_bytes
    FROM (SELECT page_id, max(x2) // 10 AS w, max(y2) // 10 AS h FROM items GROUP BY page_id)""",
    "items",
)
def rendered_pages(spark, sf):
    """The first page of a document a page of items, by an injected renderer that draws a white sheet of the page's size."""
    size = v.items(spark, sf).groupBy("page_id").agg(F.expr("max(x2) DIV 10").alias("w"), F.expr("max(y2) DIV 10").alias("h"))
    sheet = F.struct("w", "h")
    docs = size.select(F.col("page_id").cast("string").alias("path"), F.to_json(F.struct(F.array(sheet, sheet).alias("pages"))).cast("binary").alias("content"))

    def render(content, page_no, zoom):
        import json

        p = json.loads(bytes(content))["pages"][page_no]
        w, h = round(p["w"] * zoom), round(p["h"] * zoom)
        return float(p["w"]), float(p["h"]), 0, w, h, np.full(w * h, 255, np.uint8).tobytes()

    made = readers.first_pages(docs, render, 144)
    return made.select(F.col("path").cast("bigint").alias("page_id"), "page_width_pt", "page_height_pt", "rotation", "dpi", F.col("pixel_width").cast("bigint").alias("pixel_width"), F.col("pixel_height").cast("bigint").alias("pixel_height"), F.length("pixels").cast("bigint").alias("n_bytes"))


# -- kernels: their result depends on an order of visits, so tests compare them with hand-made rows -----------------


@query()
def greedy_dedup(spark, sf):
    return grouping.deduplicated(v.items(spark, sf))


@query()
def paragraph_chain(spark, sf):
    return grouping.chained(v.items(spark, sf))


@query()
def line_chain(spark, sf):
    return grouping.merged_lines(v.items(spark, sf))


@query()
def merged_items(spark, sf):
    """Every second item's words on lines of their own, so that some are cut at borders."""
    i = v.items(spark, sf).withColumn("text", F.when(F.col("item_id") % 2 == 0, F.regexp_replace("text", " ", "\n")).otherwise(F.col("text")))
    return grouping.merged_items(i, v.cells(spark, sf), segments=_lines(spark, sf), page_w=PAGE_W, page_h=PAGE_H)


_ANCHORED = """RECURSIVE {0}, seq AS (SELECT page_id, orient, pos, row_number() OVER (PARTITION BY page_id, orient ORDER BY pos) AS n FROM (SELECT DISTINCT page_id, orient, pos FROM {1})),
    anc AS (SELECT page_id, orient, pos, n, pos AS anchor FROM seq WHERE n = 1 UNION ALL SELECT s.page_id, s.orient, s.pos, s.n, CASE WHEN s.pos - a.anchor <= 5 THEN a.anchor ELSE s.pos END FROM seq s JOIN anc a ON s.page_id = a.page_id AND s.orient = a.orient AND s.n = a.n + 1)"""


@query("WITH " + _ANCHORED.format(v.SQL_VIEWS["pids"] + ",\n" + v.SQL_VIEWS["rulings"], "rulings") + " SELECT page_id, orient, pos, CAST(anchor AS INT) AS anchor FROM anc")
def anchored_lines(spark, sf):
    return grouping.anchored_lines(v.rulings(spark, sf))


@query(
    """, t AS (SELECT page_id, item_id, replace(text, ' ', chr(10)) AS text, x1, y1, x2, y2 FROM items),
    c AS (SELECT t.page_id, item_id, list_sort(list(DISTINCT pos)) AS l FROM t JOIN rulings r ON r.page_id = t.page_id AND orient = 'h' AND y1 < pos AND pos < y2 GROUP BY 1, 2),
    e AS (SELECT t.*, string_split(text, chr(10)) AS w, len(string_split(text, chr(10))) AS n, l FROM t LEFT JOIN c USING (page_id, item_id)),
    g AS (SELECT *, CASE WHEN l IS NULL OR n < 2 THEN [0, n] ELSE list_sort(list_distinct([0] || list_transform(l, lambda y: least(n, CAST(floor(((y - y1) / (y2 - y1)::DOUBLE) / (1.0::DOUBLE / n)) AS BIGINT))) || [n])) END AS k FROM e),
    u AS (SELECT *, unnest(range(1, len(k))) AS i FROM g)
    SELECT page_id, item_id, CAST(i - 1 AS INT) AS part, CASE WHEN len(k) <= 2 THEN text ELSE array_to_string(w[k[i] + 1:k[i + 1]], chr(10)) END AS text, x1, CASE WHEN len(k) <= 2 THEN y1 ELSE CAST(floor(y1 + (y2 - y1) * k[i] / n::DOUBLE) AS INT) END AS y1, x2,
    CASE WHEN len(k) <= 2 THEN y2 ELSE CAST(floor(y1 + (y2 - y1) * k[i + 1] / n::DOUBLE) AS INT) END AS y2 FROM u""",
    "items", "rulings",
)
def split_across_cells(spark, sf):
    i = v.items(spark, sf).withColumn("text", F.regexp_replace("text", " ", "\n"))
    cut = grouping.split_across_cells(i, v.rulings(spark, sf).filter("orient = 'h'"))
    return cut.select("page_id", "item_id", "part", "text", *spatial.BOX)


@query()
def smart_cuts(spark, sf):
    return tiling.axis_cuts(v.items(spark, sf), v.page_ids(spark, sf), "x", PAGE_W, 400)


@query()
def smart_tiles(spark, sf):
    return tiling.smart_tiles(v.items(spark, sf), v.page_ids(spark, sf), 1600, 1400, 640)


def _sized(spark, sf) -> DataFrame:
    return v.items(spark, sf).withColumn("size", (10 + F.col("item_id") % 30).cast("double"))


@query()
def fit_font(spark, sf):
    return fitting.fitted_lines(_sized(spark, sf))


#: Two small fonts for the fits by tables: one has the first half of the alphabet and the blank, the other the rest and capitals.
NARROW = FontTable("narrow", ((0x20, 0x20, 250), (0x61, 0x6D, 400)))
BROAD = FontTable("broad", ((0x41, 0x5A, 700), (0x61, 0x65, 900), (0x6E, 0x7A, 600)))
TABLES = TableMetrics((NARROW, BROAD), missing=300)


@query(
    """SELECT item_id, (len(regexp_extract_all(text, ' ')) * 250 + len(regexp_extract_all(text, '[a-m]')) * 400 + len(regexp_extract_all(text, '[A-Z]')) * 700 + len(regexp_extract_all(text, '[n-z]')) * 600
      + len(regexp_extract_all(text, '[^ a-zA-Z]')) * 300) / 1000::DOUBLE AS width, CAST(CASE WHEN regexp_matches(text, '[A-Z]') THEN 0.7 WHEN regexp_matches(text, '[n-z]') THEN 0.6 WHEN regexp_matches(text, '[a-m]') THEN 0.4 WHEN regexp_matches(text, '[^ ]') THEN 0.3 WHEN text <> '' THEN 0.25 ELSE 0 END AS DOUBLE) AS widest
      FROM (SELECT item_id, upper(text[1]) || text[2:] || '#' AS text FROM items)""",
    "items",
)
def table_widths(spark, sf):
    """Widths of texts by two fonts with a fallback order; letters that both have are set in the first."""
    text = F.concat(F.upper(F.substring("text", 1, 1)), F.substring("text", 2, 1 << 20), F.lit("#"))
    return v.items(spark, sf).select("item_id", TABLES.column_width(text).alias("width"), TABLES.column_widest(text).cast("double").alias("widest"))


@query()
def fit_font_tables(spark, sf):
    return fitting.fitted_lines(_sized(spark, sf), TABLES)


@query()
def fit_font_unified(spark, sf):
    return fitting.fitted_lines(_sized(spark, sf), unified=True)


@query()
def wrap_lines(spark, sf):
    return fitting.horizontal_lines(_sized(spark, sf))


@query(
    """, z AS (SELECT page_id, item_id, text, x1, y1, y2, x2 - x1 AS w, y2 - y1 AS h, CASE WHEN 1.374::DOUBLE * s > x2 - x1 THEN s * ((x2 - x1) / (1.374::DOUBLE * s)) * 0.85::DOUBLE ELSE s END AS s FROM (SELECT *, CAST(10 + item_id % 30 AS DOUBLE) AS s FROM items)),
    c AS (SELECT *, greatest(h / length(text), 1.05::DOUBLE * (0.5::DOUBLE * s)) AS step, unnest(range(length(text))) AS i FROM z)
    SELECT page_id, item_id, CAST(i AS INT) AS line_no, text[i + 1] AS text, x1 + w / 2 AS x, y2 - step * (i + 0.5::DOUBLE) AS y, s AS font_size, y2 - step * (i + 0.5::DOUBLE) < y1 AS overflow FROM c""",
    "items",
)
def vertical_layout(spark, sf):
    return fitting.vertical_characters(_sized(spark, sf))


@query(
    """, a AS (SELECT page_id, item_id, text, x1 + (x2 - x1) / 2 AS x, y1 + (y2 - y1) / 2 AS y, greatest(x2 - x1, y2 - y1) AS most, greatest(5.0::DOUBLE, least(x2 - x1, y2 - y1) * 0.92::DOUBLE) AS s0 FROM items),
    b AS (SELECT *, CASE WHEN length(text) * 0.5::DOUBLE * s0 <= 1.3::DOUBLE * most THEN s0 ELSE s0 * 0.85::DOUBLE END AS s1 FROM a),
    c AS (SELECT *, CASE WHEN length(text) * 0.5::DOUBLE * s1 <= 1.3::DOUBLE * most THEN s1 ELSE s1 * 0.85::DOUBLE END AS s2 FROM b),
    d AS (SELECT *, CASE WHEN length(text) * 0.5::DOUBLE * s2 <= 1.3::DOUBLE * most THEN s2 ELSE s2 * 0.85::DOUBLE END AS s3 FROM c)
    SELECT page_id, item_id, CAST(0 AS INT) AS line_no, text, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, s3 AS font_size, length(text) * 0.5::DOUBLE * s3 > most AS overflow FROM d""",
    "items",
)
def rotated_layout(spark, sf):
    return fitting.rotated_layers(_sized(spark, sf))


@query(
    """, q AS (SELECT *, CAST(x2 - x1 AS DOUBLE) AS w, CAST(item_id % 21 AS DOUBLE) AS d FROM items), s AS (SELECT *, greatest(1.0::DOUBLE, round_even(sqrt(w * w + d * d), 0)) AS base, greatest(1.0::DOUBLE, y2 - y1) AS other FROM q)
    SELECT page_id, item_id, round(degrees(atan2(d, w)), 6) AS angle, CAST(greatest(1, least(greatest(base, other), greatest(w, y2 - y1))) AS INT) AS layer_w, CAST(greatest(1, least(least(base, other), least(w, y2 - y1))) AS INT) AS layer_h, d <= 10 AS corner_inside FROM s""",
    "items",
)
def quad_layers(spark, sf):
    """Items as quads whose first side rises by up to 20 pixels; whether a point ten pixels under the box's upper right corner is inside."""
    p = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    x1, y1, x2, y2 = g.box()
    d = F.col("item_id") % 21
    i = v.items(spark, sf).withColumn("quad", F.array(p(x1, y1), p(x2, y1 + d), p(x2, y2 + d), p(x1, y2)))
    out = fitting.quad_layers(i).withColumns({"angle": F.round("angle", 6), "corner_inside": fitting.in_quad(x2, y1 + 10)})
    return out.select("page_id", "item_id", "angle", "layer_w", "layer_h", "corner_inside")


@query()
def layer_texts(spark, sf):
    return fitting.layer_texts(v.items(spark, sf).withColumns({"layer_w": F.col("x2") - F.col("x1"), "layer_h": F.col("y2") - F.col("y1")}))


@query(
    """, b AS (SELECT page_id, item_id, text, x1, y1, x2, y2, row_number() OVER w - 1 AS k, item_id - page_id * 1000 AS n FROM items WINDOW w AS (PARTITION BY page_id ORDER BY y1, item_id))
    SELECT page_id, CAST(k AS INT) AS line_no, upper(text) AS text, x1, y1, x2, y2 FROM b WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 0, 'one line', min(x1), min(y1), max(x2), max(y2) FROM items WHERE page_id % 2 = 1 GROUP BY page_id HAVING count(*) > 1
    UNION ALL SELECT page_id, 0, 'one line', min(x1), min(y1), max(x2), max(y2) FROM items WHERE page_id % 2 = 1 GROUP BY page_id HAVING count(*) = 1""",
    "items",
)
def line_boxes(spark, sf):
    """Whole pages as blocks: translated line by line on even pages, by one line on the others."""
    b = aggregates.blocks(v.items(spark, sf), ["page_id"]).withColumn("chain", F.col("page_id"))
    done = b.withColumn("translated", F.when(F.col("page_id") % 2 == 0, F.upper("text")).otherwise(F.lit("one line")))
    return fitting.line_boxes(done).drop("chain")


@query()
def cell_layout(spark, sf):
    return fitting.cell_layout(_assigned(spark, sf))


@query("SELECT page_id, x1 + 2 AS x1, y1 + 2 AS y1, x2 - 2 AS x2, y2 - 2 AS y2, CASE WHEN (x1 + y1) % 256 > 200 THEN 255 ELSE 240 END AS fill FROM cells", "cells")
def cell_erase(spark, sf):
    return fitting.cell_erase_boxes(v.cells(spark, sf).withColumn("mean_level", (F.col("x1") + F.col("y1")) % 256))


def _drawn(pages: DataFrame, draw: Callable[..., np.ndarray]) -> DataFrame:
    """page_id, width, height and pixels of what is drawn for each row, a few pages a batch: a batch of page numbers makes a thousand times its bytes."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for k in range(0, len(f), 64):
                images = [(r.page_id, draw(r)) for r in f.iloc[k : k + 64].itertuples(index=False)]
                yield pd.DataFrame([(p, i.shape[1], i.shape[0], i.tobytes()) for p, i in images], columns=["page_id", "width", "height", "pixels"])

    return pages.mapInPandas(run, "page_id bigint, width int, height int, pixels binary")


def _rasters(spark, sf) -> DataFrame:
    """White pages with black frames, a different grid on each."""

    def draw(r):
        image = np.full((240, 320), 255, np.uint8)
        for x in range(20, 320, 70 + int(r.page_id) % 30):
            image[20:221, x] = 0
        for y in range(20, 240, 50 + int(r.page_id) % 20):
            image[y, 20:301] = 0
        return image

    # Page numbers are so few bytes that Spark would put all into one task; drawing and looking at a page takes milliseconds.
    return _drawn(v.page_ids(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism), draw)


@query()
def raster_cells(spark, sf):
    return raster.detected_cells(_rasters(spark, sf))


@query(
    """, xs AS (SELECT page_id, CAST(20 + k * (70 + page_id % 30) AS INT) AS x FROM pids, range(5) a(k) WHERE 20 + k * (70 + page_id % 30) < 320),
    ys AS (SELECT page_id, CAST(20 + k * (50 + page_id % 20) AS INT) AS y FROM pids, range(5) a(k) WHERE 20 + k * (50 + page_id % 20) < 240)
    SELECT page_id, 'h' AS orient, y AS pos, 20 AS lo, 301 AS hi FROM ys
    UNION ALL SELECT page_id, 'v', x, 20, CASE WHEN x <= 300 AND EXISTS (SELECT 1 FROM ys WHERE ys.page_id = xs.page_id AND y = 221) THEN 222 ELSE 221 END FROM xs""",
    "pids",
)
def raster_lines(spark, sf):
    """Long dark lines; a rule that lies on the end of upright ones makes them a pixel longer."""
    return raster.detected_lines(_rasters(spark, sf))


@query()
def raster_segments(spark, sf):
    """Line segments of every raster, as ranges by orientation and position."""
    return items.segment_kind(raster.detected_segments(_rasters(spark, sf)))


@query(
    """SELECT page_id, 20 AS x1, 20 AS y1, CAST(greatest(301, max(x) FILTER (WHERE x <= 303) + 1) AS INT) AS x2, CAST(greatest(221, max(y) FILTER (WHERE y <= 223) + 1) AS INT) AS y2
    FROM (SELECT page_id, 20 + k * (70 + page_id % 30) AS x, 20 + k * (50 + page_id % 20) AS y FROM pids, range(5) a(k)) GROUP BY page_id""",
    "pids",
)
def raster_contours(spark, sf):
    """The boxes of outer contours: the frame of every raster, with a rule that stands two pixels off; others are too thin."""
    return raster.detected_contours(_rasters(spark, sf)).select("page_id", *spatial.BOX)


@query()
def scanned_cells(spark, sf):
    """The cells of every raster by all detectors, near the page's items at a quarter of their size."""
    quarter = {c: F.expr(f"CAST({c} DIV 4 AS INT)") for c in spatial.BOX}
    return flows.scanned_cells(_rasters(spark, sf), v.items(spark, sf).withColumns(quarter))


@query()
def barred_chain(spark, sf):
    """Paragraphs of items at a quarter of their size, none across a dark bar of the page's raster."""
    quarter = {c: F.expr(f"CAST({c} DIV 4 AS INT)") for c in spatial.BOX}
    return grouping.chained_on_rasters(v.items(spark, sf).withColumns(quarter), _rasters(spark, sf))


@query()
def closed_cells(spark, sf):
    """Cells that the lines of each raster make, and some that are moved off them."""
    r = _rasters(spark, sf)
    lines = stored(raster.detected_lines(r))  # read by several steps; images are looked at once
    found = spatial.closed_sides(spatial.grid_cells(lines.select("page_id", "orient", "pos")), lines)
    moved = found.select("page_id", *[(F.col(c) + 25).alias(c) for c in spatial.BOX], "sides")
    return raster.closed_cells(found.unionByName(moved), r)


@query()
def recognition_chain(spark, sf):
    """Two engines over overlapping tiles that see the items of a tile: one all of them, one less surely and without the last letter."""
    i = v.items(spark, sf).select("page_id", "text", *spatial.BOX, "confidence").withColumn("angle", F.lit(0.0))
    tiles = tiling.overlapping_tiles(v.page_ids(spark, sf).select("page_id", F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h")), 700, 150)
    seen = i.join(tiles.withColumnRenamed("page_id", "__p"), (F.col("page_id") == F.col("__p")) & (F.col("x1") >= F.col("x")) & (F.col("y1") >= F.col("y")) & (F.col("x2") <= F.col("x") + F.col("w")) & (F.col("y2") <= F.col("y") + F.col("h")))
    row = F.struct("text", *[(F.col(c) - F.col("x" if c[0] == "x" else "y")).alias(c) for c in spatial.BOX], "angle", "confidence")
    shown = seen.groupBy("page_id", "x", "y", "w", "h").agg(F.to_json(F.array_sort(F.collect_list(row))).cast("binary").alias("pixels"))

    def whole():
        import json

        return lambda pixels, w, h: [(r["text"], r["x1"], r["y1"], r["x2"], r["y2"], r["angle"], r["confidence"]) for r in json.loads(bytes(pixels))]

    def clipped():
        import json

        return lambda pixels, w, h: [(r["text"][:-1], r["x1"] + 1, r["y1"], r["x2"], r["y2"], r["angle"], r["confidence"] / 2) for r in json.loads(bytes(pixels))]

    return readers.recognised_tiles(shown, {"whole": whole, "clipped": clipped}, PAGE_W, PAGE_H)


def _drawn_items(spark, sf) -> DataFrame:
    """White pages, every other one twice as wide, with the items of the page as dark boxes at a third of their size."""
    third = v.items(spark, sf).select("page_id", F.struct(*[F.expr(f"CAST({c} DIV 3 AS INT)").alias(c) for c in spatial.BOX]).alias("b"))
    pages = third.groupBy("page_id").agg(F.array_sort(F.collect_list("b")).alias("boxes")).repartition(4 * spark.sparkContext.defaultParallelism)

    def draw(r):
        w, h = (700 if r.page_id % 2 else 350), 300
        image = np.full((h, w), 255, np.uint8)
        for b in r.boxes:
            image[b["y1"] : b["y2"], b["x1"] * w // 350 : b["x1"] * w // 350 + 12] = 0
        return image

    return _drawn(pages, draw)


def box_engine():
    """An engine that sees dark regions: their size as text, surer the larger they are."""
    from ..functions.raster import components

    return lambda image: [(f"{b[2] - b[0]} by {b[3] - b[1]}", *b, 0.0, min(0.99, 0.2 + n / 2000)) for b, n in components(image < 160)]


@query()
def coarse_to_fine(spark, sf):
    """Dark boxes of every page, found on a small image first and then on tiles cut between them."""
    return readers.coarse_to_fine(_drawn_items(spark, sf), box_engine, 120, 175)


@query()
def raster_levels(spark, sf):
    """All items, on a page a quarter as wide and high."""
    quarter = {c: F.expr(f"CAST({c} DIV 4 AS INT)") for c in spatial.BOX}
    return raster.measured(v.items(spark, sf).withColumns(quarter), _rasters(spark, sf))


# -- whole flows ---------------------------------------------------------------------------------------------------


@query(
    "WITH "
    + _ANCHORED.format(
        v.SQL_VIEWS["pids"] + ",\n" + v.SQL_VIEWS["rulings"] + _LINES
        + """, raw AS (SELECT page_id, CASE WHEN orient = 'h' THEN lo ELSE pos END AS x1, CASE WHEN orient = 'h' THEN pos ELSE lo END AS y1, CASE WHEN orient = 'h' THEN 1200 ELSE pos + 2 END AS x2, CASE WHEN orient = 'h' THEN pos + 2 ELSE 900 END AS y2 FROM lines),
    ang AS (SELECT *, CASE WHEN x1 = x2 THEN 90.0 ELSE degrees(atan2(abs(y2 - y1), abs(x2 - x1))) END AS a FROM raw),
    seg AS (SELECT page_id, CASE WHEN a < 15 THEN 'h' ELSE 'v' END AS orient, CASE WHEN a < 15 THEN (y1 + y2) // 2 ELSE (x1 + x2) // 2 END AS pos, CASE WHEN a < 15 THEN least(x1, x2) ELSE least(y1, y2) END AS lo, CASE WHEN a < 15 THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi FROM ang WHERE a < 15 OR a > 75)""",
        "seg",
    )
    + """, met AS (SELECT s.page_id, s.orient, a.anchor AS pos, lo, hi FROM seg s JOIN anc a ON s.page_id = a.page_id AND s.orient = a.orient AND s.pos = a.pos),
    ok AS (SELECT a.page_id, a.orient, a.pos FROM (SELECT DISTINCT page_id, orient, pos FROM met) a JOIN met b ON a.page_id = b.page_id AND a.orient <> b.orient AND a.pos BETWEEN b.lo - 100 AND b.hi + 100 GROUP BY 1, 2, 3 HAVING count(DISTINCT b.pos) >= 2),
    p AS (SELECT page_id, orient, pos, lead(pos) OVER (PARTITION BY page_id, orient ORDER BY pos) AS nxt FROM ok),
    grid AS (SELECT h.page_id, v.pos AS x1, h.pos AS y1, v.nxt AS x2, h.nxt AS y2 FROM p h JOIN p v ON h.page_id = v.page_id AND h.orient = 'h' AND v.orient = 'v' WHERE h.nxt - h.pos BETWEEN 20 AND 400 AND v.nxt - v.pos BETWEEN 20 AND 1200),
    q AS (SELECT *, """
    + " + ".join(_covers(o, p, a, b).replace("FROM lines s", "FROM met s") for o, p, a, b in (("h", "c.y1", "c.x1", "c.x2"), ("h", "c.y2", "c.x1", "c.x2"), ("v", "c.x1", "c.y1", "c.y2"), ("v", "c.x2", "c.y1", "c.y2")))
    + " AS sides FROM grid c) SELECT page_id, x1, y1, x2, y2 FROM q WHERE sides >= 3"
)
def intersection_grid(spark, sf):
    """Grid lines of every page, as segments of a few pixels' slant."""
    r = _lines(spark, sf)
    flat = F.col("orient") == "h"
    s = r.select("page_id", F.monotonically_increasing_id().alias("item_id"), F.when(flat, F.col("lo")).otherwise(F.col("pos")).alias("x1"), F.when(flat, F.col("pos")).otherwise(F.col("lo")).alias("y1"), F.when(flat, F.lit(1200)).otherwise(F.col("pos") + 2).alias("x2"), F.when(flat, F.col("pos") + 2).otherwise(F.lit(900)).alias("y2"))
    return flows.intersection_grid(s)


_EDGES = " UNION ".join(
    f"""SELECT page_id, '{o}' AS orient, CAST(floor(median(v)) AS INT) AS pos FROM (SELECT page_id, v, sum(f) OVER (PARTITION BY page_id ORDER BY v, item_id ROWS UNBOUNDED PRECEDING) AS cl FROM
    (SELECT page_id, item_id, {c} AS v, CASE WHEN {c} - lag({c}) OVER (PARTITION BY page_id ORDER BY {c}, item_id) <= {tol} THEN 0 ELSE 1 END AS f FROM inside)) GROUP BY page_id, cl"""
    for o, c, tol in (("v", "x1", 25), ("v", "x2", 25), ("h", "y1", 20), ("h", "y2", 20))
)


@query(
    f""", k AS (SELECT page_id, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS d FROM cells GROUP BY 1 HAVING count(*) >= 3),
    region AS (SELECT page_id, greatest(0, a - CAST(floor((c - a) * 0.2::DOUBLE) AS INT)) AS a, greatest(0, b - CAST(floor((d - b) * 0.2::DOUBLE) AS INT)) AS b, least(1200, c + CAST(floor((c - a) * 0.2::DOUBLE) AS INT)) AS c, least(900, d + CAST(floor((d - b) * 0.2::DOUBLE) AS INT)) AS d FROM k),
    inside AS (SELECT i.page_id, item_id, x1, y1, x2, y2 FROM items i JOIN region r ON i.page_id = r.page_id AND a <= x1 AND b <= y1 AND c >= x2 AND d >= y2),
    l AS ({_EDGES}), p AS (SELECT page_id, orient, pos, lead(pos) OVER (PARTITION BY page_id, orient ORDER BY pos) AS nxt FROM l)
    SELECT h.page_id, v.pos AS x1, h.pos AS y1, v.nxt AS x2, h.nxt AS y2 FROM p h JOIN p v ON h.page_id = v.page_id AND h.orient = 'h' AND v.orient = 'v' WHERE h.nxt - h.pos BETWEEN 20 AND 400 AND v.nxt - v.pos BETWEEN 20 AND 1200""",
    "items", "cells",
)
def text_gap_cells(spark, sf):
    return flows.text_gap_cells(v.items(spark, sf), v.cells(spark, sf), PAGE_W, PAGE_H)


@query(
    f""", st AS (SELECT page_id, x1, y1, x2, y2, string_agg(DISTINCT s, ',' ORDER BY s) AS stages, bool_or(s = 'M') AS m FROM (SELECT *, CASE WHEN morph THEN 'M' ELSE 'A' END AS s FROM cells UNION ALL SELECT *, 'B' FROM cells WHERE x1 < 300) GROUP BY 1, 2, 3, 4, 5),
    a1 AS (SELECT * FROM st a WHERE m OR NOT EXISTS (SELECT 1 FROM st b WHERE b.m AND {_IN} AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2))),
    a2 AS (SELECT * FROM a1 a WHERE NOT EXISTS (SELECT 1 FROM a1 b WHERE {_IN} AND (b.x2 - b.x1) * (b.y2 - b.y1) > (a.x2 - a.x1) * (a.y2 - a.y1))),
    a3 AS (SELECT * FROM a2 c WHERE EXISTS (SELECT 1 FROM items i WHERE i.page_id = c.page_id AND (((i.x1 + i.x2) / 2 BETWEEN c.x1 AND c.x2 AND (i.y1 + i.y2) / 2 BETWEEN c.y1 AND c.y2)
      OR (i.x1 < c.x2 AND c.x1 < i.x2 AND i.y1 < c.y2 AND c.y1 < i.y2 AND {_OVER} > 0.3 * (i.x2 - i.x1) * (i.y2 - i.y1)) OR ((c.x1 + c.x2) / 2 - (i.x1 + i.x2) / 2) ** 2 + ((c.y1 + c.y2) / 2 - (i.y1 + i.y2) / 2) ** 2 <= 2500))),
    a4 AS (SELECT a.* FROM a3 a WHERE (SELECT count(*) FROM a3 n WHERE n.page_id = a.page_id) <= 1 OR EXISTS (SELECT 1 FROM a3 b WHERE a.page_id = b.page_id AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2) AND (
      (abs(a.y1 - b.y1) <= 8 AND abs(a.y2 - b.y2) <= 8 AND least(abs(a.x2 - b.x1), abs(b.x2 - a.x1)) <= 10) OR (abs(a.x1 - b.x1) <= 8 AND abs(a.x2 - b.x2) <= 8 AND least(abs(a.y2 - b.y1), abs(b.y2 - a.y1)) <= 10)))),
    a5 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, y2, x2) AS n FROM a4)
    SELECT page_id, x1, y1, x2, y2, stages, CAST(n AS INT) AS cell_no, 'Cell_' || lpad(CAST(n AS VARCHAR), 3, '0') AS cell_id FROM a5""",
    "items", "cells",
)
def cell_cascade(spark, sf):
    c = v.cells(spark, sf)
    return flows.cell_cascade({"M": c.filter("morph"), "A": c.filter("NOT morph"), "B": c.filter("x1 < 300")}, v.items(spark, sf))


@query()
def unified_flow(spark, sf):
    return flows.unified_flow(v.items(spark, sf), v.terms(spark), _cache(spark, sf), script=None)


@query(
    f"""SELECT item_id, {_NESTED} AS translated, true AS erase, CASE WHEN {_NESTED} = text AND regexp_matches(text, '[xyz]') THEN 'skipped' WHEN abs(angle) > 5 THEN 'rotated'
    WHEN w > b * 1.05::DOUBLE AND w * greatest(b / greatest(w, 1e-9), 0.4::DOUBLE) > b * 1.1::DOUBLE AND {_NESTED} LIKE '% %' THEN 'split' ELSE 'horizontal' END AS route
    FROM (SELECT *, length({_NESTED}) * 0.5::DOUBLE * (10 + item_id % 30) AS w, x2 - x1 AS b FROM items)""",
    "items",
)
def vector_flow(spark, sf):
    i = _sized(spark, sf).withColumns({"is_vertical": F.lit(False), "direction": F.when(F.abs("angle") > 5, "rotated").otherwise("horizontal"), "rotation_deg": F.col("angle")})
    return flows.vector_flow(i, v.terms(spark), "[xyz]").select("item_id", "translated", "erase", "route")
