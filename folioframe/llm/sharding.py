"""K-d tree sharding: nodes are split at distributed weighted medians along their widest metadata dimension.

Dimensions are size, lines, length of words, and share of bytes beyond ASCII. They are compared by ranks: a node is as wide
in a dimension as the share of the corpus's bytes between its lowest and highest value, so a scale favours none.

A node with m leaves to make is split so that m // 2 of m parts of its bytes go left; the same rule that halves a
node of two leaves. One count of the bytes in CELLS cells of every node and dimension gives the widest dimension and the
cell of its median; the median's place in the cell is found by counting bytes in equal bins, then in the bins of the bin
that holds it, and so on: at most ROUNDS counts of BINS sums a node, whatever the input's size. Rows tied in a dimension
are ordered by their text's hash and then by a hash of their id. A split that falls inside a small group of equal texts
moves to the group's edge; a group that holds more than MOVABLE of a leaf is cut where it lies on a border, since no law
of near equal bytes could hold otherwise.

Defined results: a null text has 0 bytes (size 8) and crc32 0; a null id hashes as an empty string; repeated rows are rows
of their own; texts of any length are measured whole; every dimension is a property of the text, so equal texts lie side by
side and are parted only where a group too large to move lies on a border; columns of other names are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, passing, spread, table

SHARDS = 24
CELLS = 512
BINS = 1 << 16
ROUNDS = 4
#: Bits of the text's hash and of the id's hash that order rows of one value; a value has 32 bits.
TEXT_BITS, ID_BITS = 20, 10
TIE_BITS = TEXT_BITS + ID_BITS
#: Share of a leaf's bytes to which a split is found, and up to which a group of equal texts is not cut.
EXACT, MOVABLE = 0.001, 0.02
CELL_WIDTH = (1 << 32) // CELLS
#: Pieces in which the rows of a shard are numbered.
SLOT_PIECES = 1024


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tie and the dimensions."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    t = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(
        "doc_id",
        (F.octet_length(raw) + 8).cast("bigint").alias("size"),
        F.crc32(raw).cast("bigint").alias("text_crc32"),
        F.char_length(t).alias("chars"),
        (F.char_length(t) - F.char_length(F.translate(t, "\n", ""))).alias("lines"),
        (F.char_length(t) - F.char_length(F.translate(t, " ", ""))).alias("blanks"),
    )
    return one.withColumns(dimensions()).withColumn("tie", tie(F.col("doc_id"), F.col("text_crc32"))).drop("chars", "lines", "blanks")


def dimensions() -> dict[str, Column]:
    """Each from 0 to 2**32 - 1: size, lines and letters a word on log scales, and the share of bytes beyond those of ASCII."""

    def steps(c: Column) -> Column:
        return F.least(F.floor(F.log2(c.cast("double") + 1) * (1 << 26)), F.lit((1 << 32) - 1)).cast("bigint")

    octets = F.col("size") - 8
    wide = F.when(octets > 0, (octets - F.col("chars")) / octets).otherwise(0.0)
    return {"by_size": steps(F.col("size")), "by_lines": steps(F.col("lines")), "by_word": steps(F.col("chars") / (F.col("blanks") + 1)), "by_wide": F.floor(wide * ((1 << 32) - 1)).cast("bigint")}


def tie(doc_id: Column, text_crc: Column) -> Column:
    """Bits of the text's hash, then of the id's."""
    of_id = F.crc32(F.concat(F.lit("tie"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")).cast("bigint")
    return F.shiftleft(text_crc.bitwiseAND((1 << TEXT_BITS) - 1), ID_BITS) + F.shiftright(of_id, 32 - ID_BITS)


def kd_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Append shard (0 to shards - 1) to durable rows that have size, tie and the dimensions.

    The driver holds one split a node; nodes are fewer than shards.
    """
    dims = list(dimensions())
    nodes = {0: (0, shards)}  # node number -> first leaf, leaves
    splits: list[tuple[int, str, int, int, int]] = []
    node, ranks = F.lit(0), None
    while any(n > 1 for _, n in nodes.values()):
        live = [k for k, (_, n) in nodes.items() if n > 1]
        at = rows.withColumn("node", node).filter(F.col("node").isin(live))
        held = cells_of(at, dims)
        ranks = ranks or {d: np.cumsum(held.get((0, d), np.zeros(CELLS))) for d in dims}  # of the root: the whole corpus
        goal, span, pick = {}, {}, {}
        for k in live:
            if (k, dims[0]) not in held:  # no rows: any split will do
                continue
            n = nodes[k][1]
            pick[k] = max(dims, key=lambda d: (rank_width(held[k, d], ranks[d]), -dims.index(d)))
            upto = np.cumsum(held[k, pick[k]])
            goal[k] = upto[-1] * (n // 2) / n
            cell = int(np.argmax(upto > goal[k]))
            goal[k] -= float(upto[cell - 1]) if cell else 0.0
            span[k] = (cell * CELL_WIDTH << TIE_BITS, (cell + 1) * CELL_WIDTH << TIE_BITS)
        value = chosen(pick)
        leaf_bytes = sum(int(held[k, dims[0]].sum()) for k in goal) / max(sum(nodes[k][1] for k in goal), 1)
        for _ in range(ROUNDS):
            span, goal, most = narrowed(at, value, span, goal)
            if most <= EXACT * leaf_bytes:
                break
        span = at_edges(at, value, span, MOVABLE * leaf_bytes)
        top = max(nodes) + 1
        for k in live:
            first, n = nodes.pop(k)
            cut = span[k][0] if k in span else 0
            splits.append((k, pick.get(k, dims[0]), cut, top, top + 1))
            nodes[top], nodes[top + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            top += 2
        node = node_of(splits)
    leaf = F.create_map(*[F.lit(x) for k, (first, _) in nodes.items() for x in (k, first)])
    return rows.withColumn("shard", F.element_at(leaf, node).cast("int"))


def cells_of(at: DataFrame, dims: list[str]) -> dict[tuple[int, str], np.ndarray]:
    """Bytes in each of CELLS equal cells of every node and dimension, in one pass: the rows are nodes x dimensions x cells at most."""
    places = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.floor(F.col(d) / CELL_WIDTH).cast("int").alias("cell")) for d in dims]))
    out: dict[tuple[int, str], np.ndarray] = {}
    for r in at.select("node", "size", places.alias("p")).groupBy("node", "p.dim", "p.cell").agg(F.sum("size").alias("bytes")).collect():
        out.setdefault((r["node"], r["dim"]), np.zeros(CELLS, np.int64))[r["cell"]] = r["bytes"]
    return out


def rank_width(held: np.ndarray, ranks: np.ndarray) -> int:
    """The corpus's bytes from the lowest to the highest cell that a node has rows in; 0 where they are in one cell."""
    at = np.flatnonzero(held)
    return int(ranks[at[-1]] - ranks[at[0]])


def ordered(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TIE_BITS) + F.col("tie")


def chosen(pick: dict[int, str]) -> Column:
    """The ordered value of each row's node in that node's dimension."""
    out = F.lit(None).cast("bigint")
    for dim in set(pick.values()):
        out = F.when(F.col("node").isin([k for k, d in pick.items() if d == dim]), ordered(dim)).otherwise(out)
    return out


def looked_up(values: dict) -> Column:
    """The value of each row's node."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("node"))


def at_edges(at: DataFrame, value: Column, span: dict, most: float) -> dict:
    """Move a split to the start of the group of equal texts that it falls into, if the group has at most ``most`` bytes."""
    starts = {k: lo >> ID_BITS << ID_BITS for k, (lo, _) in span.items()}
    if not span:
        return span
    group = at.withColumn("v", value).filter((F.col("v") >= looked_up(starts)) & (F.col("v") < looked_up(starts) + (1 << ID_BITS)))
    held = {r["node"]: r["bytes"] for r in group.groupBy("node").agg(F.sum("size").alias("bytes")).collect()}
    return {k: (starts[k] if held.get(k, 0) <= most else lo, hi) for k, (lo, hi) in span.items()}


def narrowed(at: DataFrame, value: Column, span: dict, goal: dict) -> tuple[dict, dict, int]:
    """The bin of each node in which its goal of bytes is reached, what of the goal is left inside it, and the bytes of the fullest such bin of several rows."""
    look = lambda i: looked_up({k: s[i] for k, s in span.items()})
    if not span:
        return span, goal, 0
    width = F.greatest(F.ceil((look(1) - look(0)) / BINS).cast("bigint"), F.lit(1))
    inside = at.withColumn("v", value).filter((F.col("v") >= look(0)) & (F.col("v") < look(1)))
    bins = inside.groupBy("node", F.floor((F.col("v") - look(0)) / width).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("node").orderBy("bin")
    sums = bins.withColumn("upto", F.sum("bytes").over(up))
    aim = looked_up({k: float(g) for k, g in goal.items()})
    found = sums.groupBy("node").agg(F.min(F.when(F.col("upto") > aim, F.struct("bin", (F.col("upto") - F.col("bytes")).alias("below"), "bytes", "n"))).alias("x")).collect()
    out_span, out_goal, most = dict(span), dict(goal), 0
    for r in found:
        k, lo, hi = r["node"], *span[r["node"]]
        w = max(-(-(hi - lo) // BINS), 1)
        if r["x"] is not None:
            start = lo + r["x"]["bin"] * w
            out_span[k] = (start, min(start + w, hi))
            out_goal[k] = goal[k] - r["x"]["below"]
            most = max(most, r["x"]["bytes"] if w > 1 and r["x"]["n"] > 1 else 0)
    return out_span, out_goal, most


def node_of(splits: list) -> Column:
    """The node each row has come down to: a chain of comparisons in one projection."""
    inner = {k: (dim, cut, left, right) for k, dim, cut, left, right in splits}

    def down(k: int) -> Column:
        if k not in inner:
            return F.lit(k)
        dim, cut, left, right = inner[k]
        return F.when(ordered(dim) < F.lit(cut), down(left)).otherwise(down(right))

    return down(0)


def with_slots(sharded: DataFrame) -> DataFrame:
    """Append slot: gapless from 0 within a shard, ordered by a hash of the id and the id.

    Counted by pieces of a shard first, so that no task numbers a whole shard.
    """
    cut = sharded.withColumn("piece", F.pmod(F.hash("doc_id", "text_crc32"), F.lit(SLOT_PIECES)))
    up = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("shard").alias("__s"), F.col("piece").alias("__p"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("shard", "piece").orderBy("tie", "doc_id", "size", "text_crc32")
    return (
        cut.withColumn("__row", F.row_number().over(inside) - 1)
        .join(starts, (F.col("shard") == F.col("__s")) & (F.col("piece") == F.col("__p")))
        .withColumn("slot", (F.col("__row") + F.col("__start")).cast("bigint"))
        .drop("__row", "__s", "__p", "__start", "piece")
    )


def op6_kd_shards(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place in it."""
    with passing(spark) as last:
        rows = durable(metadata(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
        sharded = durable(kd_shards(rows))
        return last(with_slots(sharded).select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
        ))
