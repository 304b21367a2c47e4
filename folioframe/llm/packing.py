"""Packing token sequences by patterns whose repeat counts come from non-negative least squares.

A pattern is a choice of a few lengths that fill a sequence exactly: up to three, four among the most frequent ones, or a
frequent one repeated with one other. All of them over the lengths that occur are enumerated, their repeat counts are fitted to the histogram of lengths by non-negative least squares (in which a long piece
left over weighs more than a short one), a share of them is rounded within what the histogram holds, and what is left is packed
by best fit on the histogram, longest first. All of this reads the histogram only, which has as many entries as a sequence has tokens, so the
driver's work does not grow with the corpus.

The plan says for each length which ranks of its pieces go to which sequences at which place. Pieces are ranked within their
length in two steps (buckets of bounded size, then rows of a bucket), so no task gets all pieces of a frequent length, and
meet the plan by a broadcast of rows whose number is bounded by the capacity alone.

Defined results: a null or empty text has no ids but the end id, so it is a piece of one token; texts of any length are taken
whole, and only those longer than a sequence are cut; repeated rows are packed each for itself, pieces of equal rows may change
places; a null id stays null; an empty table gives no pieces; columns of other names are ignored.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, free_name, passing, small_batches, spread, table

CAPACITY = 2048
#: Chunks whose ids a worker remembers before it forgets all; longer chunks are not remembered.
MEMORY = 800_000
LONG = 48
#: A chunk of letters, ASCII or U+00C0 to U+00FF, and ASCII marks behind them; an apostrophe, < and > can belong to what tokenizers treat as one.
WORD_AND_MARKS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;=?@\[-`{-~]*)")
#: Pieces of all lengths in a bucket on average, and the fewest buckets: the pieces of a frequent length are spread over all of them.
BUCKET_ROWS = 1 << 20
LEAST_BUCKETS = 256
#: Steps of the least-squares fit, patterns that it keeps for each token of a sequence, and lengths that count as frequent.
STEPS = 300
KEEP = 2
FREQUENT = 48
#: Shares of the fitted counts that are tried.
SHARES = (1.0, 0.95, 0.9, 0.8, 0.65, 0.5, 0.25)


class ChunkedTokenizer:
    """Ids by the tokenizers library, asked once for each distinct chunk between ASCII white space.

    That is right for tokenizers that normalise and split without looking across white space, and a chunk of letters with
    marks behind it may be asked for in two parts, in lower case, if the tokenizer parts letters from marks and lowers all, a word
    of plain letters of the model alone. The constructor compares all this with whole encoding on probes, and leaves out what
    differs.
    """

    PROBE = "A b's  12 Word, WÖRD.) MiXed;\t\tÉ́ ΣΣ x́ …中文\n<|endoftext|> don't stop　‍\U0001f600 ...  "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        chunks = self.PROBE.encode().split()
        self.lowers, self.chunked = False, self._whole(self.PROBE) == b"".join(self._whole(c.decode()) for c in chunks)
        parts = [p for c in chunks for p in self._parts(c)]
        self.lowers = self._whole(self.PROBE) == b"".join(self._whole(p.decode()) for p in parts)
        self.plain = all(self._whole(w) == self._word(w) for w in ("word", "mixed", "zzyzx", "q", "antidisestablishmentarianism"))

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a word of the letters a to z, which only the library's model has to look at."""
        found = self.tokenizer.model.tokenize(word)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    @staticmethod
    def _parts(chunk: bytes) -> list[bytes]:
        found = WORD_AND_MARKS.fullmatch(chunk)
        return [p for p in (found[1].lower(), found[2]) if p] if found else [chunk]

    def _chunk(self, chunk: bytes) -> bytes:
        parts = self._parts(chunk) if self.lowers else [chunk]
        if parts == [chunk]:
            letters = self.plain and self.lowers and chunk.isalpha()
            made = self._word(chunk.decode()) if letters else self._whole(chunk.decode("utf-8", "replace"))
        else:
            made = b"".join([self.known.get(p) or self._chunk(p) for p in parts])
        if len(chunk) <= LONG:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[chunk] = made
        return made

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.chunked:
            return self._whole(text.decode("utf-8", "replace"))
        known = self.known.get
        return b"".join([i if (i := known(c)) is not None else self._chunk(c) for c in text.split()])


_tokenizers: dict[str, ChunkedTokenizer] = {}


def tokenizer(path: str) -> ChunkedTokenizer:
    """One tokenizer a worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkedTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of the pieces of every row of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(b.column(0).cast(pa.int64()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = tok.ids(text or b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, k, at // 4, len(part) // 4, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"]
            )

    small_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def patterns(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and how often each is taken, four columns a pattern, 0 times where a pattern has fewer.

    All choices of up to three of the lengths that occur, of four among the most frequent ones, and of a frequent length as
    often as wanted with one other, that fill the capacity exactly.
    """
    capacity = len(histogram) - 1
    there = histogram > 0
    lengths = np.flatnonzero(there)
    lengths = lengths[lengths > 0]
    often = np.sort(lengths[np.argsort(-histogram[lengths], kind="stable")[:FREQUENT]])
    made: list[tuple[np.ndarray, np.ndarray]] = []

    def add(*columns):
        """Patterns given as (lengths, times) columns; single numbers hold for all rows."""
        n = np.broadcast_shapes(*(np.shape(v) for v, _ in columns))[0]
        padded = [*columns, *[(0, 0)] * (4 - len(columns))]
        made.append(tuple(np.stack([np.broadcast_to(np.asarray(c[k], np.int64), n) for c in padded], axis=1) for k in (0, 1)))

    if there[capacity]:
        add((np.array([capacity]), 1))
    low = lengths[lengths * 2 <= capacity]
    low = low[there[capacity - low]]
    add((low, 1), (capacity - low, 1))
    for a in lengths[lengths * 3 <= capacity]:
        b = lengths[(lengths >= a) & (2 * lengths <= capacity - a)]
        b = b[there[capacity - a - b]]
        add((a, 1), (b, 1), (capacity - a - b, 1))
    is_often = np.zeros(capacity + 1, bool)
    is_often[often] = True
    for k, a in enumerate(often):
        for b in often[k:]:
            c = often[(often >= b) & (2 * often <= capacity - a - b)]
            c = c[is_often[capacity - a - b - c]]
            add((a, 1), (b, 1), (c, 1), (capacity - a - b - c, 1))
        times = np.arange(4, capacity // a + 1)
        rest = capacity - times * a
        fits = (rest == 0) | there[rest]
        add((a, times[fits]), (rest[fits], (rest[fits] > 0).astype(np.int64)))
    return tuple(np.concatenate([m[k] for m in made]) for k in (0, 1))


def fitted(found: tuple[np.ndarray, np.ndarray], histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that make the sum of (weight * (counts used - histogram)) ** 2 small.

    Accelerated projected gradient steps; the weight of a length is its share of a sequence, so what a left-over piece weighs
    is the room that it needs. Where the fit uses more pieces than there are, its patterns are scaled down alike.
    """
    lengths, times = found
    if not len(lengths):
        return np.zeros(0)
    weight = np.arange(len(histogram)) / (len(histogram) - 1)
    goal, square = weight * histogram, weight**2
    columns = [(lengths[:, k].copy(), times[:, k].astype(np.float64)) for k in range(4) if times[:, k].any()]

    def used(x):
        return sum(np.bincount(v, x * t, len(histogram)) for v, t in columns)

    def back(rest):
        return sum(t * rest[v] for v, t in columns)

    # Each pattern's step follows from how often it could be repeated at most: for matrices without negative entries these
    # steps are small enough, and a pattern of frequent lengths is not held up by those of rare ones.
    most = np.min([np.where(t > 0, histogram[v] / np.maximum(t, 1), np.inf) for v, t in columns], axis=0)
    step = most / back(square * used(most))
    x = at = np.zeros(len(lengths))
    pace = 1.0
    for _ in range(steps):
        nxt = np.maximum(at - step * back(weight * (weight * used(at) - goal)), 0)
        after = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        at = nxt + (pace - 1) / after * (nxt - x)
        x, pace = nxt, after
    share = np.minimum(histogram / np.maximum(used(x), 1e-9), 1.0)
    return x * np.min([np.where(t > 0, share[v], 1.0) for v, t in columns], axis=0)


def rounded(found: tuple[np.ndarray, np.ndarray], x: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """(pieces of each length, repeats) in whole numbers within the histogram, and the histogram that is left.

    Whole parts first, which the pieces there are suffice for but for rounding errors; then, by falling rest, one more of a
    pattern whose rest is at least a half, as long as its pieces last.
    """
    left, repeats = histogram.copy(), defaultdict(int)
    order = np.argsort(-(x - np.floor(x)), kind="stable").tolist()
    content = []
    for values, counts in zip(*(f.tolist() for f in found), strict=True):
        need: dict[int, int] = defaultdict(int)
        for v, t in zip(values, counts, strict=True):
            if t:
                need[v] += t
        content.append(dict(need))
    for wish in (np.floor(x + 1e-9).astype(np.int64), (x - np.floor(x) >= 0.5).astype(np.int64)):
        for k in order:
            if wish[k]:
                take = min(int(wish[k]), *(int(left[v]) // t for v, t in content[k].items()))
                for v, t in content[k].items():
                    left[v] -= take * t
                repeats[k] += take
    return [(content[k], n) for k, n in repeats.items() if n], left


def best_fit(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences) by best fit, longest first, on the histogram.

    Sequences with the same content are one entry. A length is put to the entry with the least room that holds it, as often as
    it fits, since a sequence that got one is again the one with the least room.
    """
    capacity = len(histogram) - 1
    open_at: dict[int, list[list]] = defaultdict(list)  # room -> entries (content, number)
    for length in range(capacity, 0, -1):
        count = int(histogram[length])
        for room in sorted(r for r in open_at if r >= length):
            entries, times = open_at[room], room // length
            while count and entries:
                content, number = entries.pop()
                full = min(number, count // times)
                rest = min(count - full * times, times - 1) if full < number else 0
                if full:
                    open_at[room - times * length].append([content | {length: times}, full])
                if rest:
                    open_at[room - rest * length].append([content | {length: rest}, 1])
                if number - full - (rest > 0):
                    entries.append([content, number - full - (rest > 0)])
                count -= full * times + rest
                if not full and not rest:
                    break
            if not count:
                break
        if count:
            times = capacity // length
            if count // times:
                open_at[capacity - times * length].append([{length: times}, count // times])
            if count % times:
                open_at[capacity - count % times * length].append([{length: count % times}, 1])
    return [(content, number) for entries in open_at.values() for content, number in entries]


def plan(histogram: np.ndarray, keep: int = KEEP) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences) for a histogram whose index is the length."""
    found = patterns(histogram)
    x = fitted(found, histogram)
    most = keep * (len(histogram) - 1)
    if len(x) > most:  # the counts of those that stay are fitted again to all pieces
        best = np.sort(np.argsort(-x, kind="stable")[:most])
        found = tuple(f[best] for f in found)
        x = fitted(found, histogram)
    # A fit that leaves out what no pattern reaches can take the short pieces that should go with it. So the share of the fit
    # that is put to use is the one with which the whole plan, rest included, has the fewest sequences.
    plans = []
    for share in SHARES:
        repeated, left = rounded(found, share * x, histogram)
        plans.append(repeated + best_fit(left))
    return min(plans, key=lambda made: sum(number for _, number in made))


def places(made: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first_rank, end_rank, sequence_id of the first sequence, number of sequences, offset of the first piece.

    The pieces of a length in ``number`` equal sequences have consecutive ranks: first one of each sequence, then the next.
    """
    ranks: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for content, number in made:
        offset = 0
        for length, times in content.items():
            out.append((length, ranks[length], ranks[length] + times * number, base, number, offset))
            ranks[length] += times * number
            offset += times * length
        base += number
    return out


def ranked(rows: DataFrame, total: int, salt: str, rank: str) -> DataFrame:
    """``rows`` (durable) with the rank within the length, from 0, as ``rank``; by bucket, then inside the bucket.

    ``salt``: a stored column that tells apart equal rows that many tasks have made, so that they are no hot bucket.
    """
    bucket, first, n = (free_name(rows, f"{rank}_{x}") for x in ("bucket", "first", "n"))
    key = ["doc_id", "piece", "start", "length", salt]
    keyed = rows.withColumn(bucket, F.pmod(F.xxhash64(*key), F.lit(max(-(-total // BUCKET_ROWS), LEAST_BUCKETS))))
    up = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    held = keyed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n)).select("length", bucket, F.coalesce(F.sum(n).over(up), F.lit(0)).alias(first))
    inside = Window.partitionBy("length", bucket).orderBy(*key[:3], salt)
    numbered = keyed.withColumn(rank, F.row_number().over(inside) - 1)
    return numbered.join(held, ["length", bucket]).withColumn(rank, F.col(rank) + F.col(first)).drop(bucket, first)


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and other columns of ``rows`` with sequence_id and offset; other columns stay, whatever their names."""
    spark, taken = rows.sparkSession, {c.lower() for c in rows.columns}
    if taken & {"sequence_id", "offset"}:
        raise ValueError("sequence_id and offset are columns that this makes")
    salt, rank = free_name(rows, "salt"), free_name(rows, "rank")
    stored = durable(rows.withColumn(salt, F.spark_partition_id()))
    counts = stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).limit(capacity + 1).collect()  # one more than there can be
    if any(r.length is None or not 0 < r.length <= capacity for r in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r.length] = r.n
    of, first, end, base, number, begin = names = [free_name(rows, f"{rank}_{x}") for x in ("of", "first", "end", "base", "number", "begin")]
    at = spark.createDataFrame(places(plan(histogram)), ", ".join(f"`{c}` bigint" for c in names))
    numbered = ranked(stored, int(histogram.sum()), salt, rank)
    met = numbered.join(F.broadcast(at), (F.col("length") == F.col(of)) & (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(end)))
    inside = F.col(rank) - F.col(first)
    return met.select(
        *rows.columns,
        (F.col(base) + inside % F.col(number)).alias("sequence_id"),
        (F.col(begin) + F.floor(inside / F.col(number)) * F.col("length")).cast("bigint").alias("offset"),
    )


def sequences(done: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and doc_ids of packed pieces that carry ids; at most a sequence's tokens meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return done.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("bigint"), lambda n, x: n + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packed_sequences(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    with passing(spark) as last:
        cut = pieces(table(spark, sf_dir, "documents"), default_tokenizer())
        return last(packed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))
