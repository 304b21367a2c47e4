"""Spelling variants: plain comparison of all words, hash keys against strings, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import variants

LETTERS = "abcé"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, spoil=97, min_length=5, min_count=3):
    out = Counter()
    for doc_id, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{r}".encode())
            if spoil and h % spoil == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            out[r] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def by_hand(words):
    """(word, form, root, n, n_near, form_n) of all words by comparing all pairs."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_same_as_sql(spark, duck):
    same(variants.op13_spelling_variants(spark, SF), duck, variants.SQL_OP13)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(st.sampled_from(LETTERS), min_size=1, max_size=9), max_size=25))
def test_candidates_are_all_pairs_one_apart(words):
    """Keys of equal strings agree, those of others do not, and every near pair meets."""
    words = sorted(words)
    key, place, of = variants.deletion_keys(words)
    rest = [words[w] if p < 0 else words[w][: p >> 1] + words[w][(p >> 1) + 1 :] for p, w in zip(place.tolist(), of.tolist(), strict=True)]
    assert len(rest) == sum(len(w) + 1 for w in words)
    by_rest, by_key = {}, {}
    for k, r in zip(key.tolist(), rest, strict=True):
        assert by_rest.setdefault(r, k) == k and by_key.setdefault(k, r) == r
    order = np.lexsort((place, key))
    a, b, at_a, at_b = variants.meetings(key[order], place[order], of[order])
    got = sorted(sorted((words[x], words[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert got == sorted([x, y] for x in words for y in words if x < y and one_edit(x, y))
    assert all(at < 0 or words[w][:at] + words[w][at + 1 :] in by_rest for w, at in zip(a.tolist(), at_a.tolist(), strict=True))


def test_rows_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 9)), " ".join("".join(rng.choice(list("abÀé"), rng.integers(4, 8))) for _ in range(60))) for _ in range(120)]
    rows += [(1, "Colour colour COLOUR colours colors, color-color color color"), (2, None), (None, "colour color colours colours"), (3, ""), (4, "12 3,4 ñandú Ñandú ñandú ñandu")]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id bigint, text string, word string, id string")
    for params in (variants.VariantParams(), variants.VariantParams(spoil=3, min_length=4, min_count=2), variants.VariantParams(spoil=0)):
        want = by_hand(counted(rows, params.spoil, params.min_length, params.min_count))
        found = variants.variants(df, params)
        assert rows_of(found) == sorted(want, key=repr) and any(w[1] for w in want)
        members = Counter(w[2] for w in want)
        assert {(r.root, r.n_words) for r in variants.groups(found).collect()} == {(k, n) for k, n in members.items() if n > 1}
    assert variants.variants(df.limit(0)).count() == 0


def test_long_chains_and_very_long_words(spark):
    """A chain of seventeen forms, and words of a hundred thousand letters that differ in the last."""
    chain = [("aaaaa" + "b" * k, 2 ** (17 - k)) for k in range(18)]
    long = "xy" * 50_000
    rows = [(1, " ".join([w] * n)) for w, n in chain if n >= 3] + [(2, f"{long} " * 3 + f"{long}z " * 6)]
    found = {r[0]: r for r in rows_of(variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string"), variants.VariantParams(spoil=0)))}
    assert {found[w][2] for w, n in chain if n >= 3} == {"aaaaa"} and found["aaaaabbb"][1] == "aaaaabb"
    alike = spark.createDataFrame([(1, f"{'a' * 100_000} " * 6 + f"{'a' * 99_999} " * 3)], "doc_id bigint, text string")
    assert [r[4] for r in rows_of(variants.variants(alike, variants.VariantParams(spoil=0)))] == [1, 1]
    assert found[long][1] == long + "z" and found[long][4] == 1 and len(found) == sum(n >= 3 for _, n in chain) + 2


def test_colliding_keys_are_refused(spark, monkeypatch):
    """With keys of three bits everything meets; strings decide."""
    keys = variants.deletion_keys

    def poor(words):
        key, place, of = keys(words)
        return key & 7, place, of

    words = spark.createDataFrame([(k, w, 10) for k, w in enumerate(["tests", "teste", "testes", "rests", "apple", "apples"])], "id bigint, word string, n bigint")
    good = sorted(map(tuple, variants.near_words(words).collect()))
    texts = [r.word for r in words.collect()]
    key, place, of = poor(texts)
    order = np.lexsort((place, key))
    a, b, at_a, at_b = variants.meetings(key[order], place[order], of[order])
    met = spark.createDataFrame(list(zip([texts[i] for i in a], [texts[i] for i in b], at_a.tolist(), at_b.tolist(), strict=True)), "a string, b string, at_a int, at_b int")
    F = pytest.importorskip("pyspark.sql.functions")
    kept = met.filter(variants.one_apart(F.col("a"), F.col("b"), F.col("at_a"), F.col("at_b"))).distinct().collect()
    assert len(a) > 3 * len(good) and {frozenset((r.a, r.b)) for r in kept} == {frozenset(g[:2]) for g in good}
