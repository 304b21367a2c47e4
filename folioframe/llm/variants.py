"""Spelling variants: words that differ by one code point, found by rolling-hash deletion keys, and the form each one follows.

Every word gives integer keys of what is left when one code point is deleted, worked out for all words of a batch at once
from prefix and suffix polynomial hashes, and one key of itself. Two words differ by a replaced code point if deletions at
the same place leave the same rest, by an inserted one if a deletion from the longer leaves the shorter. Keys are dealt by
their high bits, each part is sorted by key, and neighbours in the sorted part are candidates. A candidate is confirmed on
the strings of both words, so a collision of hashes costs time only.

The rows that meet at a key are bounded by the alphabet, not by the data: words that agree but for one place, and a word with
all its insertions. A word that makes up a third of all text is one row, since counts are added up before the shuffle. Keys
carry numbers of words, not words, so long words cost a few integers a letter.

Forms are followed to the last by doubling: each step at least doubles the count, so a chain of forms is at most as long as
the count has bits.

Defined results: a null or empty text has no words; a null id reads as an empty string in the hash that spoils runs; repeated
rows count as often as they are there; of equally frequent near words the smallest in code-point order is the form; an empty
table gives an empty result; texts and words of any length are taken whole; columns of other names are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, passing, small_batches, spread, table

#: What a run is.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: The base of the polynomial hashes, modulo 2**64, and an odd number that spreads a place or a code point over 64 bits.
BASE = 0xD1342543DE82EF95
SPREAD = 0x9E3779B97F4A7C15
#: Keys a part of the sort has at most on average, and bits by which keys are dealt.
PART_KEYS = 1 << 21
RADIX_BITS = 16
#: The place of a key that is the word's own.
WHOLE = -1


@dataclass(frozen=True)
class VariantParams:
    """``spoil``: one in so many (document, run) pairs loses a code point before words are counted, 0: none."""

    spoil: int = 97
    min_length: int = 5
    min_count: int = 3
    #: A form has at least so many times the count of the word that follows it.
    ratio: int = 2


def word_counts(docs: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """word and n of the runs of all texts that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[str] = Counter()
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not raw:
                    continue
                # bytes.lower() changes A to Z only
                runs = Counter(RUN.findall(raw.lower().decode("utf-8", "replace")))
                if params.spoil:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for r in [r for r in runs if not zlib.crc32(r.encode(), start) % params.spoil]:
                        at = zlib.crc32(r.encode(), start) % len(r)
                        n = runs.pop(r)
                        found[r[:at] + r[at + 1 :]] += n
                found.update(runs)
            long = {w: n for w, n in found.items() if len(w) >= params.min_length}
            yield pa.RecordBatch.from_arrays([pa.array(long.keys(), pa.string()), pa.array(long.values(), pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    made = spread(docs.select("doc_id", "text")).mapInArrow(run, "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= params.min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, place and index of the word for each word itself (place -1) and each code point deleted.

    A place is doubled, plus one if the next code point is another: of a row of equal letters only the last place is odd.

    With p the hash of what stands before the deleted code point and s the hash of what stands after it, both with the
    last code point at power 0, the rest has the hash p * BASE**len(s) + s. The hash of a word is the same polynomial.
    """
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    longest = int(size.max(initial=0))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, np.uint64(BASE))]), dtype=np.uint64)
        value = (points + np.uint64(1)) * np.uint64(SPREAD)
        value ^= value >> np.uint64(29)
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(points)) - begin[of]
        behind = size[of] - 1 - place  # code points after this one
        # Suffix hashes are sums of value * power[behind] from the place on; differences of one running sum over all words.
        up = np.concatenate([[np.uint64(0)], np.cumsum(value * power[behind], dtype=np.uint64)])
        whole = up[begin + size] - up[begin]
        before = up[np.arange(len(points))] - up[begin[of]]  # what stands before, times BASE**(behind + 1)
        after = up[(begin + size)[of]] - up[np.arange(len(points)) + 1]
        rest = before * np.uint64(pow(BASE, -1, 1 << 64)) + after
        length = np.concatenate([size, size[of] - 1]).astype(np.uint64)
        key = np.concatenate([whole, rest]) + length * np.uint64(SPREAD)
        key ^= key >> np.uint64(32)
        key *= np.uint64(BASE)
    differs = (behind == 0) | (points != np.append(points[1:], np.uint64(0)))
    return key.view(np.int64), np.concatenate([np.full(len(words), WHOLE), place * 2 + differs]), np.concatenate([np.arange(len(words)), of])


def keyed(words: DataFrame) -> DataFrame:
    """key, place and id of every word of ``words`` (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, place, of = deletion_keys(b.column(1).to_pylist())
            ids = b.column(0).to_numpy()[of] if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place, pa.int32()), pa.array(ids, pa.int64())], names=["key", "place", "id"])

    return words.select("id", "word").mapInArrow(run, "key bigint, place int, id bigint")


def meetings(key: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among rows sorted by key and place: ids a and b and the places deleted from each.

    Rows of one key and place (a replaced code point), and a whole word with the deletions (an inserted one), of which a row
    of equal letters counts as one.
    """
    n = np.arange(len(key))
    key_end = np.searchsorted(key, key, "right")
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] >> 1 != place[:-1] >> 1)])) if len(key) else n
    group_end = np.append(new[1:], len(key))[np.searchsorted(new, n, "right") - 1] if len(key) else n
    whole = place == WHOLE

    def pairs(rows, low, high):
        count = np.maximum(high - low, 0)
        first = np.repeat(rows, count)
        return first, np.repeat(low, count) + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)

    deleted = np.flatnonzero(~whole)
    a, b = pairs(deleted, deleted + 1, group_end[deleted])
    odd = np.flatnonzero(~whole & (place % 2 == 1))
    words = np.flatnonzero(whole)
    c, d = pairs(words, np.searchsorted(odd, group_end[words]), np.searchsorted(odd, key_end[words]))
    a, b = np.concatenate([a, c]), np.concatenate([b, odd[d]])
    return ids[a], ids[b], place[a] >> 1, place[b] >> 1


def candidates(keys: DataFrame, parts: int) -> DataFrame:
    """a, b, at_a, at_b of the rows that meet at a key. ``parts``: tasks that the keys are dealt to by their high bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

        def made(rows):
            a, b, at_a, at_b = meetings(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(at_a, pa.int32()), pa.array(at_b, pa.int32())], names=["a", "b", "at_a", "at_b"])

        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            # The last key may go on in the next batch.
            ready = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            held = [r[ready:] for r in rows]
            yield made([r[:ready] for r in rows])
        yield made(held)

    dealt = keys.repartition(parts, F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "place")
    return dealt.mapInArrow(run, "a bigint, b bigint, at_a int, at_b int")


def one_apart(a: Column, b: Column, at_a: Column, at_b: Column) -> Column:
    """Whether the two strings agree without the deleted code points, and not with them."""

    def without(word, at):
        return F.when(at == WHOLE, word).otherwise(F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word))))

    return (a != b) & (without(a, at_a) == without(b, at_b))


def near_words(words: DataFrame) -> DataFrame:
    """Both directions of every pair of near words of ``words`` (id, word, n; durable): word, near, near_n."""
    letters = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    met = candidates(keyed(words), max(letters // PART_KEYS + 1, words.sparkSession.sparkContext.defaultParallelism))
    side = lambda s: words.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(f"{s}_word"), F.col("n").alias(f"{s}_n"))
    pairs = met.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    pairs = pairs.filter(one_apart(F.col("a_word"), F.col("b_word"), F.col("at_a"), F.col("at_b")))
    both = F.array(
        F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")),
    )
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def forms(words: DataFrame, near: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """word, n, n_near, form, form_n of every word."""
    best = near.groupBy(F.col("word").alias("__w")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    met = words.join(best, F.col("word") == F.col("__w"), "left")
    follows = -F.col("best.less") >= params.ratio * F.col("n")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """``formed`` with the last form that a word leads to as ``root``; each round doubles the steps taken."""
    links = durable(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        further = durable(links.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("__moved")))
        if further.filter("__moved").limit(1).count() == 0:
            break
        links = further.drop("__moved")
    at = links.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
    return formed.join(at, F.col("word") == F.col("__w"), "left").withColumn("root", F.coalesce("__r", "word")).drop("__w", "__r")


def variants(docs: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of doc_id and text."""
    with passing(docs.sparkSession) as last:
        # A number is given when the word is written, so it stays whatever is lost later.
        words = durable(word_counts(docs, params).withColumn("id", F.monotonically_increasing_id()))
        formed = durable(forms(words, near_words(words), params))
        return last(rooted(formed).select("word", "form", "root", "n", "n_near", "form_n"))


def groups(found: DataFrame) -> DataFrame:
    """root, n_words and n (occurrences) of each group of several words that lead to one root."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n")).filter("n_words > 1")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, form and root."""
    return variants(table(spark, sf_dir, "documents"))


#: Latin letters beyond ASCII, U+00C0 to U+00FF, and as many ASCII characters that stand for them where bytes are compared.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(c for c in map(chr, range(0x20, 0x7F)) if not c.islower() and c not in "'\\{};")[: len(_WIDE)]

SQL_OP13 = f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'), lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
coded AS (SELECT run, c, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM per),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM coded, tab),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n, translate(word, '{_WIDE}', '{_NARROW}') AS k FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.word <> b.word AND abs(length(a.k) - length(b.k)) <= 1 AND levenshtein(a.k, b.k) = 1),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
chain(word, root, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""
