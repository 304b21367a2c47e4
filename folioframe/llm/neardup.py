"""Near-duplicate groups by b-bit MinHash.

Every distinct shingle set gets 128 minima. Their lowest two bits, packed into four longs, are its signature; hashes of
runs of four minima are its 32 bands. Sets that share a band are candidates; the number of agreeing bit pairs, corrected
for pairs that agree by chance, estimates their similarity; what may reach the limit is confirmed on the full sets.

At a similarity of 0.75 a pair shares no band with a probability of 5e-6, and the estimate's cut at 0.55 lies more than
four standard deviations below.

No group is turned into all its pairs. Equal sets are one node. In a band, each node is first compared with the band's
smallest node only. Links make components, and only bands that still hold several components are looked at again: there,
nodes are compared with the band's most central node, and after that those outside the band's largest component with the
nodes of other components. Where a band has many such
nodes (texts around one common passage), its nodes are compared by an exact rule instead: shingles are ordered from rare
to common, and two sets over the limit share one of the smaller set's rarest 1/7 (and one more) and of the larger set's
rarest 1/4 (and one more). A common passage is not among them. So no link between components is left out, and links
within one are not needed.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a text of fewer than five words
is one shingle; rows with a null id are linked with nothing, their component_id is null and they are kept; repeated rows
share their component, and each of them is kept if its id is the component's smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, passing, small_batches, spread, table

SHINGLE = 5
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
SIMILAR_PERCENT = 75
#: The estimate below which a candidate is not confirmed.
ESTIMATE_CUT = 0.55
#: Nodes of a band outside its largest component beyond which its nodes are compared by their rarest shingles.
LARGE_BAND = 16
#: Parts of all rows of bands: a band that holds more than one part is dealt in pieces.
CROWDED = 4096
#: Rounds in which the nodes of bands with several components are compared with the band's most central node.
CENTRAL_ROUNDS = 1
#: Minima of the finer signature that nodes of large bands get, and its cut: four standard deviations below the limit.
FINE_HASHES = 2048
FINE_CUT = 0.7
#: Least and most cells of the table of shingle counts by which shingles are ordered, four a shingle between them; any order
#: gives exact results, so cells may be shared.
COUNT_CELLS = (1 << 16, 1 << 22)

_rng = np.random.default_rng(20240229)
_MIX = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_FINE_MULT = _rng.integers(1, 1 << 31, FINE_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_ADD = _rng.integers(0, 1 << 32, FINE_HASHES, dtype=np.uint64).astype(np.uint32)
_BAND_MIX = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of matrix a block of shingles may fill when minima are taken.
_BLOCK = 4096


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        s = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            s = mixed(s + h[k : k + 1] * _MIX[k])
        return s
    n = len(h) - SHINGLE + 1
    s = h[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        s += h[k : k + n] * _MIX[k]
    return np.unique(mixed(s))


def minima(shingles: np.ndarray, mult: np.ndarray = _MULT, add: np.ndarray = _ADD) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    low = shingles.astype(np.uint32)[:, None]
    out = np.full(len(mult), np.iinfo(np.uint32).max, np.uint32)
    step = max(1, _BLOCK * HASHES // len(mult))
    for k in range(0, len(low), step):
        np.minimum(out, (low[k : k + step] * mult + add).min(axis=0), out=out)
    return out


_SHIFTS = np.uint64(2) * np.arange(32, dtype=np.uint64)


def signature(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum in four longs. The bits are taken after mixing: low bits of a product hang together."""
    bits = (mixed(least.astype(np.uint64)) >> np.uint64(40)) & np.uint64(3)
    return np.bitwise_or.reduce(bits.reshape(-1, 32) << _SHIFTS, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band; equal for equal minima of that band."""
    runs = least.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((runs * _BAND_MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


DIGEST = "doc_id bigint, text_key binary, n_shingles bigint, node binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the text's digest, the set's size, its digest (node), signature and bands, of every row of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sizes, nodes = np.zeros(n, np.int64), []
            sigs, bands = np.zeros((n, 4), np.int64), np.zeros((n, BANDS), np.int64)
            for i, text in enumerate(b.column(2).to_pylist()):
                s = shingle_set(text)
                sizes[i] = len(s)
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    least = minima(s)
                    sigs[i], bands[i] = signature(least), band_keys(least)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1).cast(pa.binary()), pa.array(sizes), pa.array(nodes, pa.binary()), *[pa.array(np.ascontiguousarray(sigs[:, k])) for k in range(4)], lists],
                names=[x.split()[0] for x in DIGEST.split(", ")],
            )

    small_batches(docs.sparkSession)
    return spread(docs.select("doc_id", text_key().alias("text_key"), "text")).mapInArrow(run, DIGEST)


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def estimate(a: str, b: str) -> Column:
    """Similarity from two signatures: the share of agreeing pairs less what two bits agree on by chance."""
    differ = None
    for k in range(4):
        x = F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))
        one = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = one if differ is None else differ + one
    return (1 - differ / HASHES - 0.25) / 0.75


def fine_estimate(a: str, b: str) -> Column:
    """The same from two finer signatures, arrays of longs."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    differ = F.aggregate(F.zip_with(F.col(f"{a}fine"), F.col(f"{b}fine"), differing), F.lit(0), lambda s, x: s + x)
    return (1 - differ / FINE_HASHES - 0.25) / 0.75


def size_allows(a: str, b: str) -> Column:
    """Sets whose sizes alone rule the limit out need no confirming."""
    return 100 * F.least(F.col(f"{a}n"), F.col(f"{b}n")) >= SIMILAR_PERCENT * F.greatest(F.col(f"{a}n"), F.col(f"{b}n"))


_MEMBER = ["node", "n", "s0", "s1", "s2", "s3"]


def in_pieces(per_band: DataFrame) -> DataFrame:
    """A row for each piece of its band."""
    return per_band.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))


def members_of_shared_bands(nodes: DataFrame) -> DataFrame:
    """Nodes in the bands that two nodes or more share: band, pieces, piece, the band's smallest node (lead), near and the node's columns.

    near tells that the estimate lets the pair of lead and node through. A band that holds over a CROWDED-th of all rows is
    dealt in pieces of that size. At most CROWDED bands can be so large, which bounds what is broadcast.
    """
    rows = nodes.select(F.explode("bands").alias("band"), "node")
    least = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("lead")).filter("c > 1")
    share = max(1, nodes.count() * BANDS) / CROWDED
    # A node leads as many bands as it has at most, so this join has no large key.
    led = least.join(renamed(nodes, "a_", _MEMBER), F.col("lead") == F.col("a_node")).drop("a_node")
    shared = durable(led.withColumn("pieces", (1 + F.floor(F.col("c") / share)).cast("int")).drop("c"))
    crowded = F.broadcast(shared.filter("pieces > 1").select(F.col("band").alias("__c"), F.col("pieces").alias("__n")))
    piece = F.pmod(F.xxhash64("node"), F.coalesce("__n", F.lit(1))).cast("int")
    dealt = nodes.select(F.explode("bands").alias("band"), *_MEMBER).join(crowded, F.col("band") == F.col("__c"), "left").withColumn("piece", piece).drop("__c", "__n")
    per = in_pieces(shared).withColumnsRenamed({"band": "__b", "piece": "__p"})
    met = dealt.join(per, (F.col("band") == F.col("__b")) & (F.col("piece") == F.col("__p")))
    near = (F.col("node") != F.col("lead")) & (estimate("a_", "") >= ESTIMATE_CUT) & size_allows("a_", "")
    return met.select("band", "pieces", "piece", "lead", near.alias("near"), *_MEMBER)


def renamed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a band's smallest node a and another, which the estimate lets through."""
    return members.filter("near").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()


def unsettled(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of bands that hold several components: band, pieces, piece, size, root, main (the band's largest component), outside (its members outside that) and the node's columns."""
    at = with_roots(members.select("band", "pieces", "piece", *_MEMBER), components)
    # Counted by band and root first: no task gets all rows of a crowded band.
    per = at.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), F.max("pieces").alias("pieces"))
    several = per.groupBy("band").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("k"), F.max("pieces").alias("pieces")).filter("k > 1")
    main = in_pieces(several).select(F.col("band").alias("__b"), F.col("piece").alias("__p"), "size", F.col("m.root").alias("main"), (F.col("size") - F.col("m.c")).alias("outside"))
    return at.join(main, (F.col("band") == F.col("__b")) & (F.col("piece") == F.col("__p"))).drop("__b", "__p")


def with_roots(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of nodes with their component's root; a node without links is its own."""
    c = components.select(F.col("id").alias("__id"), F.col("root").alias("__root"))
    return rows.join(c, F.col("node") == F.col("__id"), "left").withColumn("root", F.coalesce("__root", "node")).drop("__id", "__root")


def central_pairs(at: DataFrame) -> DataFrame:
    """Pairs of a band's most central node and its nodes of other components.

    Of texts edited from one, that one shares bands with the most others: a node's centrality is the sum of its bands' sizes.
    """
    ranked = at.groupBy(F.col("node").alias("__n")).agg(F.sum("size").alias("rank"))
    lead = at.join(ranked, F.col("node") == F.col("__n")).groupBy("band").agg(F.max(F.struct("rank", *_MEMBER, "root")).alias("m"), F.max("pieces").alias("pieces"))
    lead = in_pieces(lead).select(F.col("band").alias("a_band"), F.col("piece").alias("a_piece"), *[F.col(f"m.{c}").alias(f"a_{c}") for c in [*_MEMBER, "root"]])
    b = renamed(at, "b_", ["band", "piece", "root", *_MEMBER])
    same = (F.col("a_band") == F.col("b_band")) & (F.col("a_piece") == F.col("b_piece"))
    met = b.join(lead, same & (F.col("a_root") != F.col("b_root")) & size_allows("a_", "b_") & (estimate("a_", "b_") >= ESTIMATE_CUT))
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def band_pairs(at: DataFrame) -> DataFrame:
    """Pairs of nodes of different components in small bands; at least one lies outside the band's largest component."""
    at = at.filter(F.col("outside") <= LARGE_BAND)
    rest = renamed(in_pieces(at.filter("root <> main")), "a_", ["band", "piece", "root", "main", *_MEMBER])
    every = renamed(at, "b_", ["band", "piece", "root", *_MEMBER])
    found = rest.join(
        every,
        (F.col("a_band") == F.col("b_band"))
        & (F.col("a_piece") == F.col("b_piece"))
        & (F.col("a_root") != F.col("b_root"))
        & ((F.col("b_root") == F.col("a_main")) | (F.col("a_node") < F.col("b_node")))
        & (estimate("a_", "b_") >= ESTIMATE_CUT)
        & size_allows("a_", "b_"),
    )
    return found.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


_RARE = ["shingle", "place", "short", "rest", "node", "n"]


def rare_shingles(many: DataFrame, texts: DataFrame) -> DataFrame:
    """A row for each of the rarest quarter of every node's shingles: shingle, place in their order, short (in the rarest seventh), rest, node and n.

    ``many`` has node, rest and n, ``texts`` node and text.
    """
    spark = texts.sparkSession
    least, most = COUNT_CELLS
    wanted = 4 * (many.agg(F.sum("n")).first()[0] or 0)
    cells = min(most, max(least, 1 << wanted.bit_length()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for b in batches:
            for text in b.column(1).to_pylist():
                np.add.at(counts, (shingle_set(text) % np.uint64(cells)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    small_batches(spark)
    # Cells that are met often, and how often: a table of bounded size, whatever the input.
    common = texts.mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 4").toArrow()
    counts = np.zeros(cells, np.int32)
    counts[common.column("cell").to_numpy()] = np.minimum(common.column("n").to_numpy(), 1 << 30)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, sizes, keys, places = [], [], [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                n = len(s)
                s = s[np.lexsort((s, counts[(s % np.uint64(cells)).astype(np.int64)]))]
                probe, index = n - -(-3 * n // 4) + 1, n - -(-6 * n // 7) + 1
                owners += [node] * probe
                sizes += [n] * probe
                keys.append(s[:probe].view(np.int64))
                places.append(np.stack([np.arange(probe), np.arange(probe) < index]))
            if owners:
                place, short = np.concatenate(places, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(place), pa.array(short.astype(bool)), pa.array(owners, pa.binary()), pa.array(sizes, pa.int64())], names=["shingle", "place", "short", "node", "n"]
                )

    rows = texts.mapInArrow(rarest, "shingle bigint, place bigint, short boolean, node binary, n bigint")
    return durable(rows.join(many.select(F.col("node").alias("__n"), "rest"), F.col("node") == F.col("__n")).select(*_RARE))


def rare_pairs(rows: DataFrame, components: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of nodes of different components, at least one of them marked ``rest``, that share a rare shingle and pass size and fine estimate."""
    at = with_roots(rows, components)
    small = renamed(at.filter("short"), "a_", [*_RARE, "root"])
    big = renamed(at, "b_", [*_RARE, "root"])
    met = small.join(
        big,
        (F.col("a_shingle") == F.col("b_shingle"))
        & ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node"))))
        & (F.col("a_root") != F.col("b_root"))
        & (F.col("a_rest") | F.col("b_rest"))
        # Were this the first shingle that both share, as many must follow as the limit asks for.
        & (7 * F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= 3 * (F.col("a_n") + F.col("b_n")))
        & size_allows("a_", "b_"),
    )
    pairs = durable(met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())
    fine = durable(fine_signatures(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), texts))
    x = pairs.join(renamed(fine, "a_", ["node", "fine"]), F.col("a") == F.col("a_node")).join(renamed(fine, "b_", ["node", "fine"]), F.col("b") == F.col("b_node"))
    return x.filter(fine_estimate("a_", "b_") >= FINE_CUT).select("a", "b")


def fine_signatures(used: DataFrame, texts: DataFrame) -> DataFrame:
    """node and its finer signature, of the nodes in ``used``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = [signature(minima(shingle_set(text), _FINE_MULT, _FINE_ADD)).tolist() for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fine, pa.list_(pa.int64()))], names=["node", "fine"])

    return texts.join(used.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_semi").mapInArrow(run, "node binary, fine array<bigint>")


def texts_of(used: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and one text of each node in ``used``, written out.

    Only the row that speaks for a node has its id and text, so a text that many rows repeat is dealt by their ids, and one row of it goes on.
    """
    speaks = nodes.join(used, "node", "left_semi").select("node", "least_id", F.col("text_key").alias("__k"))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("__id"), text_key().alias("__key"), "text")
    texts = keyed.join(speaks, (F.col("__id") == F.col("least_id")) & (F.col("__key") == F.col("__k"))).select("node", "text")
    return durable(texts.dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = texts_of(used, nodes, docs)
    both = pairs.join(texts.select(F.col("node").alias("__a"), F.col("text").alias("text_a")), F.col("a") == F.col("__a")).join(
        texts.select(F.col("node").alias("__b"), F.col("text").alias("text_b")), F.col("b") == F.col("__b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}

        def of(key: bytes, text: str) -> np.ndarray:
            if key not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[key] = shingle_set(text)
            return sets[key]

        for b in batches:
            keep = []
            for a, z, ta, tz in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = of(a, ta), of(z, tz)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= SIMILAR_PERCENT * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components_of(links: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) of every id in links (a, b), by alternating large and small stars.

    Each round is written out, so a lost executor repeats one round at most.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = marked(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("__u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), "m")
        small = large.join(least, F.col("u") == F.col("__u")).select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        edges = durable(small.filter("u <> v").distinct())
        now = marked(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def marked(edges: DataFrame) -> tuple:
    """Two numbers that stay the same when the edges do."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, group, component_id and kept of every row of doc_id and text.

    ``group`` tells components apart where ids repeat; what has no shingles is grouped by its text only.
    """
    with passing(docs.sparkSession) as last:
        digest = durable(digests(docs))
        with_set = digest.filter("node IS NOT NULL AND doc_id IS NOT NULL")
        first = with_set.groupBy("node").agg(F.min(F.struct(F.col("doc_id").alias("least_id"), "text_key", F.col("n_shingles").alias("n"), "s0", "s1", "s2", "s3", "bands")).alias("x"))
        nodes = durable(first.select("node", "x.*"))
        members = durable(members_of_shared_bands(nodes))
        links = durable(confirmed(durable(star_pairs(members)), nodes, docs))
        components = components_of(links)
        at = durable(unsettled(members, components))
        tried = None
        for _ in range(CENTRAL_ROUNDS):
            found = central_pairs(at)
            found = durable(found if tried is None else found.join(tried, ["a", "b"], "left_anti"))
            if not found.take(1):
                break
            tried = found if tried is None else tried.union(found)
            links = durable(links.union(confirmed(found, nodes, docs)))
            components = components_of(links)
            at = durable(unsettled(members, components))
        more = band_pairs(at)
        many = durable(at.filter(F.col("outside") > LARGE_BAND).groupBy("node", "n").agg(F.max(F.col("root") != F.col("main")).alias("rest")))
        if many.take(1):
            texts = texts_of(many.select("node"), nodes, docs)
            more = more.union(rare_pairs(rare_shingles(many, texts), components, texts)).distinct()
        more = durable(more)
        if more.take(1):
            components = components_of(links.union(confirmed(more, nodes, docs)))
        c = components.select(F.col("id").alias("__id"), "root")
        rooted = nodes.select("node", "least_id").join(c, F.col("node") == F.col("__id"), "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
        names = rooted.groupBy("root").agg(F.min("least_id").alias("component")).select(F.col("root").alias("__root"), "component")
        named = rooted.join(names, F.col("root") == F.col("__root")).select(F.col("node").alias("__node"), "component", F.col("root").alias("group"))
        out = digest.join(named, F.col("node") == F.col("__node"), "left")
        grouped = F.when(F.col("node").isNotNull() & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
        return last(out.select("doc_id", "text_key", "n_shingles", F.coalesce("group", "text_key").alias("group"), grouped.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key", "group")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group, with all their columns; rows without an id stay as they are.

    Rows that repeat both id and text are rare: only they are compared with each other.
    """
    ids, key, k, n = (free_name(docs, x) for x in ("__id", "__key", "__k", "__n"))
    with passing(docs.sparkSession) as last:
        found = groups(docs.select("doc_id", "text")).filter("kept AND doc_id IS NOT NULL")
        keep = found.groupBy(F.col("doc_id").alias(ids), F.col("text_key").alias(k), "group").agg(F.count(F.lit(1)).alias(n))
        # One id may carry several texts of one group: the smallest text key speaks for it.
        keep = last(keep.groupBy(ids, "group").agg(F.min(F.struct(k, n)).alias("x")).select(ids, F.col("x")[k].alias(k), F.col("x")[n].alias(n)))
    keyed = docs.withColumn(key, text_key())
    same = (F.col("doc_id") == F.col(ids)) & (F.col(key) == F.col(k))
    out = keyed.join(keep.filter(F.col(n) == 1), same, "left_semi")
    twice = keep.filter(F.col(n) > 1)
    if twice.take(1):
        out = out.unionByName(keyed.join(twice, same, "left_semi").dropDuplicates(["doc_id", key]))
    return out.drop(key).unionByName(docs.filter("doc_id IS NULL"))


SQL_OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT id, min(other) AS least_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least_id, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m.least_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id
"""
