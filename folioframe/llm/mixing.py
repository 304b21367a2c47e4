"""Mixing sources to target weights with a low-discrepancy schedule, DataFrame functions only.

Slot i of the schedule has the golden-ratio point frac(i * phi), kept as a 32-bit integer. The point falls into
one source's share of the cumulative targets; the slot's rank among that source's slots is the number of the
equal-token block that it takes. Blocks are cut from the source's documents in hash order, and a source that
runs out starts again. The schedule is a little longer than the mix; slots past a source's quota are void, and a source
whose share is so small that points miss it gets the slots it lacks at the end. So a source gives its target to the word.
Every document is told the first slot that takes words of it and in how many slots it is read.

Ranks and running sums are made in two steps (pieces of a source, then rows of a piece), so no task gets the
whole of a hot source. Rows that agree in id, source and size are one row with a count until the end.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, after all others;
sources without words have target 0; repeated rows are laid side by side, each with its own words; an empty table
gives an empty result; texts of any length are counted whole; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, free_name, passing, spread, table, words

#: The weights in turn, the share of all sizes to take in percent, and the golden ratio as a 32-bit fraction.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
GOLDEN = 2654435769
POINTS = 1 << 32
#: Cells of the unit interval, through which points meet shares by an equality.
CELLS = 1024
#: Words in a block, slots in a piece of the schedule, and pieces of a source's hash order.
BLOCK_WORDS = 2048
SLOT_PIECE = 256
SOURCE_PIECES = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of every source, by filling up to the level at which the targets add up.

    ``sizes`` has source and size. One row per source goes through one window: sources, not documents, are its rows.
    """
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("weight", weight).withColumns(
        {"cap": MAX_REPEATS * F.col("source_size"), "total": F.sum("source_size").over(everything) * SHARE_PERCENT / 100}
    )
    # In order of cap per weight the first sources fill up; the rest share what they leave, at one level for all.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    s = s.withColumn("fill_no", F.row_number().over(filling))
    first_open = F.min(F.when(F.col("open"), F.struct("fill_no", "level"))).over(everything)["level"]
    at = Window.orderBy(F.col("source").asc_nulls_last())
    return (
        s.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), first_open * F.col("weight")), F.col("cap").cast("double")))
        .withColumn("quota", F.least(F.floor("target"), F.col("cap")).cast("bigint"))
        .withColumn("source_no", F.row_number().over(at))
        .select("source", "source_no", "source_size", "target", "quota")
    )


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_no, rank (from 0) and slot of all slots, void ones too; ``sources`` has source_no, source_size and quota.

    Slots that a small source gets at the end are numbered behind all others.
    """
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], "source_no int, rank bigint, slot bigint")
    # Any interval gets its share of N golden-ratio points up to O(log N); the slack covers that for all but small shares.
    slots = total // block_words + 1
    slots += slots // 64 + 64
    edge = F.sum(F.greatest(F.col("quota"), F.lit(0))).over(Window.orderBy("source_no"))
    shares = sources.withColumn("hi", F.floor(edge / F.lit(total) * POINTS)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source_no")), F.lit(0)))
    width = POINTS // CELLS
    shares = (
        shares.filter("hi > lo")
        .select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.pmod((F.pmod(F.col("id"), F.lit(1 << 31)) + 1) * GOLDEN, F.lit(POINTS)).alias("x")
    ).withColumn("cell", F.floor(F.col("x") / width))
    hit = points.join(shares, (points.cell == shares.cell) & (points.x >= shares.lo) & (points.x < shares.hi)).select(
        "source_no", "slot", F.floor(F.col("slot") / SLOT_PIECE).alias("piece")
    )
    made = durable(ranked(hit, ["slot"], "rank").select("source_no", "rank", "slot"))
    have = made.groupBy(F.col("source_no").alias("__s")).agg(F.count(F.lit(1)).alias("have"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    need = F.floor(F.col("quota") / size) * F.ceil(size / block_words) + F.ceil((F.col("quota") % size) / block_words)
    short = sources.join(have, F.col("source_no") == F.col("__s"), "left").withColumns({"have": F.coalesce("have", F.lit(0)), "need": need.cast("bigint")})
    late = short.filter("need > have").select("source_no", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    return made.unionByName(late.withColumn("slot", slots + F.col("rank") * sources.count() + F.col("source_no") - 1))


def ranked(df: DataFrame, order: list, name: str, of: Column | None = None) -> DataFrame:
    """Running sum of ``of`` (1: a rank from 0) before each row within source_no, by piece and then ``order``."""
    of = F.lit(1).cast("bigint") if of is None else of
    pieces = df.groupBy("source_no", "piece").agg(F.sum(of).alias("__in"))
    up = Window.partitionBy("source_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(F.col("source_no").alias("__s"), F.col("piece").alias("__p"), F.coalesce(F.sum("__in").over(up), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("source_no", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__before", F.coalesce(F.sum(of).over(inside), F.lit(0)))
        .join(starts, (F.col("source_no") == F.col("__s")) & (F.col("piece") == F.col("__p")))
        .withColumn(name, F.col("__before") + F.col("__start"))
        .drop("__before", "__s", "__p", "__start", "piece")
    )


def order_hash(doc_id: Column) -> Column:
    """28 bits by which the documents of a source are shuffled."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("bigint")


def mix(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size -> doc_id, source, size, source_size, target, taken, first_slot, n_slots; ``sized`` should be durable, it is read four times."""
    sources = durable(source_targets(sized))
    keyed = sized.join(
        sources.select(F.col("source").alias("__src"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("__src"))
    ).drop("__src")
    step = (1 << 28) // SOURCE_PIECES
    full = keyed.filter("size > 0").withColumn("h", order_hash(F.col("doc_id"))).withColumn("piece", F.floor(F.col("h") / step))
    alike = full.groupBy("source_no", "piece", "h", "doc_id", "source", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("__c"))
    laid = ranked(alike, ["h", "doc_id", "size"], "start", F.col("size") * F.col("__c"))
    laid = durable(laid.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__c") - 1))).withColumn("start", F.col("start") + F.col("__k") * F.col("size")).drop("__c", "__k"))
    # Slots of a rank r take block r mod b in pass r div b.
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    slots = schedule(sources, block_words).join(sources.select("source_no", "source_size", "quota"), "source_no")
    slots = slots.withColumns({"block": F.col("rank") % blocks, "turn": F.floor(F.col("rank") / blocks).cast("bigint")})
    begin = F.col("turn") * F.col("source_size") + F.col("block") * block_words
    room = F.least(F.col("quota") - begin, F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    takes = (
        slots.withColumn("room", room)
        .filter("room > 0")
        .groupBy("source_no", "block")
        .agg(F.collect_list(F.struct("slot", "room")).alias("rooms"))
        .select(F.col("source_no").alias("__s"), F.col("block").alias("__b"), "rooms")
    )
    last = F.col("start") + F.col("size") - 1
    parts = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor(last / block_words))))
    begin = F.col("block") * block_words
    words_of = lambda r: F.least(F.col("start") + F.col("size"), begin + r["room"]) - F.greatest(F.col("start"), begin)
    reads = F.filter(F.transform("rooms", lambda r: F.struct(r["slot"].alias("slot"), words_of(r).alias("got"))), lambda x: x["got"] > 0)
    met = parts.join(takes, (F.col("source_no") == F.col("__s")) & (F.col("block") == F.col("__b")), "left").withColumn("reads", reads)
    none = F.lit(0).cast("bigint")
    met = met.withColumns({"got": F.coalesce(F.aggregate("reads", none, lambda a, x: a + x["got"]), none), "early": F.array_min(F.transform("reads", lambda x: x["slot"])), "n": F.coalesce(F.size("reads"), F.lit(0))})
    whole = met.groupBy("source_no", "start", "doc_id", "source", "size", "source_size", "target").agg(F.sum("got").alias("taken"), F.min("early").alias("first_slot"), F.sum(F.greatest("n", F.lit(0))).alias("n_slots"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots"]
    empty = keyed.filter("size = 0").withColumns({"taken": none, "first_slot": F.lit(None).cast("bigint"), "n_slots": none})
    return whole.select(*columns).unionByName(empty.select(*columns))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix as rows: each document as often as the words taken from it fill it, rounded; all columns stay."""
    key = free_name(docs, "__key")
    keyed = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    with passing(docs.sparkSession) as last:
        sized = durable(keyed.select(F.col(key).alias("doc_id"), "source", F.size(words(F.col("text"))).cast("bigint").alias("size")))
        taken = mix(sized).filter("size > 0").groupBy("doc_id", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
        k, source, n, copy = (free_name(docs, x) for x in ("__k", "__s", "__copies", "__copy"))
        copies = taken.select(F.col("doc_id").alias(k), F.col("source").alias(source), F.floor(F.col("taken") / F.col("size") + 0.5).alias(n))
        copies = last(copies.filter(F.col(n) > 0))
    met = keyed.join(copies, (F.col(key) == F.col(k)) & F.col("source").eqNullSafe(F.col(source)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).select(*docs.columns)


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    with passing(spark) as last:
        return last(mix(durable(sizes(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))))).drop("source"))


SQL_OP3 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
g AS (SELECT *, first_value(CASE WHEN lvl * weight < cap THEN lvl END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS flat FROM f),
t AS (SELECT source, source_no, source_size, coalesce(least(CAST(cap AS DOUBLE), flat * weight), CAST(cap AS DOUBLE)) AS target FROM g),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota FROM t),
o AS (SELECT d.doc_id, d.size, q.source_no, q.source_size, q.target, q.quota,
             CAST(sum(d.size) OVER (PARTITION BY q.source_no ORDER BY substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 7), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
n AS (SELECT CAST(sum(quota) AS BIGINT) AS total, count(*) AS n_sources, CAST(sum(quota) AS BIGINT) // {BLOCK_WORDS} + 1 AS few FROM q),
k AS (SELECT total, n_sources, few + few // 64 + 64 AS slots FROM n),
e AS (SELECT source_no, CAST(floor(CAST(sum(quota) OVER (ORDER BY source_no) AS DOUBLE) / (SELECT total FROM k) * {POINTS}) AS BIGINT) AS hi FROM q WHERE (SELECT total FROM k) > 0),
v AS (SELECT source_no, coalesce(lag(hi) OVER (ORDER BY source_no), 0) AS lo, hi FROM e),
x AS (SELECT i AS slot, ((i % 2147483648) + 1) * {GOLDEN} % {POINTS} AS x FROM (SELECT unnest(range((SELECT slots FROM k))) AS i)),
m AS (SELECT source_no, slot, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rank FROM x JOIN v ON x >= lo AND x < hi),
c AS (SELECT q.source_no, CAST(quota // greatest(source_size, 1) * ceil(greatest(source_size, 1) / {BLOCK_WORDS}) + ceil(quota % greatest(source_size, 1) / {BLOCK_WORDS}) AS BIGINT) AS need, (SELECT count(*) FROM m WHERE m.source_no = q.source_no) AS have FROM q),
z AS (SELECT source_no, rank, slot FROM m UNION ALL SELECT source_no, rank, slots + rank * n_sources + source_no - 1 FROM (SELECT source_no, unnest(range(have, need)) AS rank FROM c WHERE need > have), k),
b AS (SELECT z.source_no, slot, rank % blocks AS block, least(quota - (rank // blocks * source_size + rank % blocks * {BLOCK_WORDS}), {BLOCK_WORDS}, source_size - rank % blocks * {BLOCK_WORDS}) AS room
      FROM z JOIN (SELECT source_no, source_size, quota, CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) AS blocks FROM q) y ON z.source_no = y.source_no),
p AS (SELECT doc_id, source_no, size, start, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM o WHERE size > 0),
r AS (SELECT p.doc_id, min(slot) AS first_slot, count(*) AS n_slots FROM p JOIN b ON p.source_no = b.source_no AND p.block = b.block AND room > 0
      AND least(start + size, p.block * {BLOCK_WORDS} + room) > greatest(start, p.block * {BLOCK_WORDS}) GROUP BY p.doc_id)
SELECT o.doc_id, size, source_size, target, first_slot, coalesce(n_slots, 0) AS n_slots,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least(start + size, quota % source_size) - start) END AS taken FROM o LEFT JOIN r ON o.doc_id = r.doc_id
"""
