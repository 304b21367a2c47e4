"""Packing: ids against the library, plans against bounds and exhaustive search, places without gaps, odd rows."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAé'sStT 12\t\n.,<|>́ΣσςİÅﬁ　\x1c\x85 "), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_library_s(library, text):
    made = packing.tokenizer(packing.default_tokenizer())
    assert made.chunked
    assert np.frombuffer(made.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_strings_and_full_memories(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    made = packing.ChunkedTokenizer(packing.default_tokenizer())
    for text in ("a<|endoftext|>b c", "<|startoftext|> <|endoftext|>", " ".join(map(str, range(50))), "x" * 500):
        assert np.frombuffer(made.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    made.chunked = False
    assert np.frombuffer(made.ids(b"Don't  go"), "<u4").tolist() == library.encode("Don't  go", add_special_tokens=False).ids


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""

    @lru_cache(None)
    def least(rest):
        if not rest:
            return 0
        best = len(rest)
        first, others = rest[0], rest[1:]

        def choose(k, room, left):
            nonlocal best
            best = min(best, 1 + least(left))
            for i in range(k, len(left)):
                if left[i] <= room:
                    choose(i, room - left[i], left[:i] + left[i + 1 :])

        choose(0, capacity - first, others)
        return best

    return least(tuple(sorted(lengths, reverse=True)))


def total(made, histogram):
    """Number of sequences of a plan that is checked to hold every piece once."""
    used = np.zeros_like(histogram)
    for content, number in made:
        assert number > 0 and sum(v * t for v, t in content.items()) < len(histogram)
        for v, t in content.items():
            used[v] += t * number
    assert (used == histogram).all()
    return sum(number for _, number in made)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_plans_are_near_the_fewest(lengths):
    histogram = np.bincount(lengths, minlength=13).astype(np.int64)
    assert total(packing.plan(histogram), histogram) <= fewest(lengths, 12) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 500)), max_size=30))
def test_plans_hold_every_piece(pairs):
    histogram = np.zeros(41, np.int64)
    for length, n in pairs:
        histogram[length] += n
    made = packing.plan(histogram)
    n = total(made, histogram)
    tokens = int((histogram * np.arange(41)).sum())
    assert n >= -(-tokens // 40) and n <= max(2 * tokens // 40 + 1, 1)
    assert n <= 11 * total(packing.best_fit(histogram), histogram) // 9 + 1


@pytest.mark.parametrize("shape", ["spread", "long", "hot", "few"])
def test_large_plans_waste_little(shape):
    rng = np.random.default_rng(3)
    lengths = {
        "spread": np.clip(rng.lognormal(6.4, 1, 200_000), 1, 2048),
        "long": rng.integers(700, 1200, 100_000),
        "hot": np.concatenate([np.full(60_000, 512), rng.integers(1, 2049, 120_000)]),
        "few": np.clip(rng.lognormal(6.4, 1, 800), 1, 2048),
    }[shape].astype(np.int64)
    histogram = np.bincount(lengths, minlength=2049).astype(np.int64)
    made = packing.plan(histogram)
    n = total(made, histogram)
    # Of the pieces over half a sequence no two meet; those under a third fill any room.
    bound = max(-(-int(lengths.sum()) // 2048), int(histogram[1025:].sum()))
    if shape == "long":
        bound = max(bound, len(lengths) // 2)
    assert n <= 1.003 * bound + 1
    full = sum(k for c, k in made if sum(v * t for v, t in c.items()) == 2048)
    assert full >= 0.5 * n
    assert len(packing.places(made)) < 16 * 2048  # what is broadcast


def test_fit_recovers_known_repeats():
    """A histogram that patterns of disjoint lengths fill exactly has those as its only solution."""
    histogram = np.zeros(65, np.int64)
    for pattern, n in (((40, 20, 4), 700), ((33, 31), 50), ((64,), 9), ((30, 30, 4), 25)):
        for v in pattern:
            histogram[v] += n
    found = packing.patterns(histogram)
    repeated, left = packing.rounded(found, packing.fitted(found, histogram, 3000) + 1e-3, histogram)
    got = Counter()
    for content, n in repeated:
        got[tuple(sorted(content.items()))] += n
    assert got == {((4, 1), (20, 1), (40, 1)): 700, ((31, 1), (33, 1)): 50, ((64, 1),): 9, ((4, 1), (30, 2)): 25} and not left.any()


def test_patterns_fill_a_sequence_once_each():
    histogram = np.zeros(41, np.int64)
    histogram[[3, 5, 7, 10, 11, 20, 33, 40]] = [9, 8, 7, 50, 3, 2, 1, 1]
    lengths, times = packing.patterns(histogram)
    assert ((lengths * times).sum(1) == 40).all() and (histogram[lengths[times > 0]] > 0).all()
    for want in ((40,), (7, 33), (10, 10, 20), (10, 10, 10, 10), (5,) * 7 + (5,), (3,) * 10 + (10,), (3,) * 11 + (7,), (11, 11, 11, 7)):
        assert any(tuple(sorted(np.repeat(v, t).tolist())) == tuple(sorted(want)) for v, t in zip(lengths, times, strict=True)), want


def checked(rows, library, texts, capacity=2048):
    """Rows hold every token of every text once, without gaps; the number of sequences."""
    want = Counter()
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_by_hand(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op11_packed_sequences(spark, SF).collect()
    n = checked(rows, library, [(r.doc_id, r.text) for r in docs.collect()])
    tokens = sum(r.length for r in rows)
    assert n <= max(-(-tokens // 2048), sum(r.length > 1024 for r in rows)) + 1


def test_odd_documents(spark, library, tmp_path):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, None), (None, "null id", "y"), (2, "", "z"), (3, " \n\t ", None), (4, "w7 " * 30_000, None), (5, "中文é", "q")] + [(6, "same text here", "s")] * 500
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `offset` string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    checked(packing.op11_packed_sequences(spark, str(tmp_path)).collect(), library, [r[:2] for r in rows])
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert packing.op11_packed_sequences(spark, f"{tmp_path}/none").count() == 0


def test_buckets_and_sequences_with_ids(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 16)
    docs = spark.createDataFrame([(k % 60, f"text number {k % 60} " * (k % 9)) for k in range(200)], "doc_id bigint, text string")
    cut = packing.pieces(docs, packing.default_tokenizer(), 64).withColumn("ids_crc32", F.crc32("ids")).withColumns({"salt": F.lit("s"), "rank": F.lit(7), "rank_of": F.lit(None).cast("int")})
    done = packing.packed(cut, 64)
    rows = done.collect()
    n = checked(rows, library, [tuple(r) for r in docs.collect()], 64)
    assert {(r.salt, r["rank"], r.rank_of) for r in rows} == {("s", 7, None)}
    made = packing.sequences(packing.packed(cut.drop("salt"), 64)).collect()
    assert len(made) == n and all(len(m.ids) == 4 * m.n_tokens == 4 * sum(d.length for d in m.documents) for m in made)
    parts = Counter(bytes(m.ids)[4 * d.offset : 4 * (d.offset + d.length)] for m in made for d in m.documents)
    assert parts == Counter(bytes(r.ids) for r in rows)
    for bad in (cut.withColumn("length", F.lit(65).cast("bigint")), cut.withColumn("offset", F.lit(1))):
        with pytest.raises(ValueError):
            packing.packed(bad, 64)
