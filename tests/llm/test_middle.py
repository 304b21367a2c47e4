"""Fill-in-the-middle: plain code on whole texts, the automaton on any bytes, odd rows."""

import hashlib
import re

import numpy as np
import pytest
from conftest import SF, same
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import middle


def by_hand(doc_id, text, params=middle.MiddleParams()):
    """n, form, prefix_chars, middle_chars and output of one row."""
    text = text or ""
    pattern = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}[params.unit]
    units = re.findall(pattern, text)
    assert "".join(units) == text
    hexed = hashlib.sha256(f"{params.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = params.prefix, params.suffix, params.middle
    if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= params.rate:
        return n, "plain", None, None, text
    if h4 % 100 < params.spm_rate:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


def test_same_as_sql(spark, duck):
    same(middle.op12_middle_cuts(spark, SF), duck, middle.SQL_OP12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n<PSM>é中😀"), max_size=700), max_size=6), st.sampled_from(["line", "word", "char"]), st.sampled_from([0, 60, 100]))
def test_scan_on_any_texts(texts, unit, rate):
    params = middle.MiddleParams(unit=unit, rate=rate)
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    scan = middle.Scan(middle.automaton(params), np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(texts):
        n = by_hand(1, t, params)[0]
        assert scan.units[k] == n and scan.marks[k] == sum(t.count(x) for x in ("<P>", "<S>", "<M>"))
    for share in (0, 1, 2, 3):
        after = scan.units * share // 3
        place, chars = scan.cuts(after)
        for k, t in enumerate(texts):
            head = raw[k][: place[k] - offsets[k]].decode()
            assert len(head) == chars[k] and by_hand(1, head, params)[0] == after[k]


def test_the_automaton_forgets_and_refuses_bad_marks():
    assert 1 <= middle.ByteAutomaton("line", [b"<P>", b"<S>", b"<M>"]).memory <= 3
    long = middle.ByteAutomaton("word", [b"<|fim_prefix|>", b"<|fim_suffix|>", b"<|fim_middle|>"])
    assert long.memory == len(b"<|fim_prefix|>") - 1
    for bad in ([b"<P>", b"<P>", b"x"], [b"a", b"ab", b"c"], [b"", b"b", b"c"]):
        with pytest.raises(ValueError):
            middle.ByteAutomaton("line", bad)
    with pytest.raises(ValueError):
        middle.ByteAutomaton("page", [b"<P>", b"<S>", b"<M>"])


def test_bytes_that_are_no_utf8():
    """Stray continuation bytes count one each, an open sequence ends at the next byte that does not go on with it."""
    data = np.frombuffer(b"\x80\xe4b\n\xc3\xa9\xa9\n", np.uint8)
    scan = middle.Scan(middle.automaton(middle.MiddleParams()), data, np.array([0, len(data)]))
    assert (scan.lane_chars.sum(), scan.units[0]) == (7, 2)


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("rate", [100, 40])
def test_rows_by_hand(spark, unit, rate):
    params = middle.MiddleParams(unit=unit, rate=rate, spm_rate=30, prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>")
    long = "\n".join(f"line {i} é" * (i % 7) for i in range(40_000))
    texts = [None, "", "\n", "\n\n", "no end", "a\nb\nc", "a\nb\nc\n", "has <|pre|> inside", "<|pr" * 90, "é" * 300 + "\n" + "中" * 300, "x" * 255 + "\n" + "y" * 256, long, " lead and  gaps \n"]
    rows = [(i % 3 and i, t, "x", "y") for i, t in enumerate(texts * 2)] + [(None, "one\ntwo", None, None)] * 2
    df = spark.createDataFrame([(None if i == 0 else i, t, a, b) for i, t, a, b in rows], "doc_id bigint, text string, output string, form string")
    made = middle.restored(middle.transformed(df, params), params).collect()
    key = lambda r: tuple(map(repr, r))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made), key=key)
    want = sorted(((r.doc_id, *by_hand(r.doc_id, r.text, params), r.text or "") for r in df.collect()), key=key)
    assert got == want
    assert {"plain", "psm", "spm"} <= {g[2] for g in got}
    assert middle.restored(middle.transformed(df.limit(0), params), params).count() == 0


def test_outputs_without_their_marks_are_not_restored(spark):
    df = spark.createDataFrame([("psm", "<P>a<S>b"), ("spm", "<P>a<S>b<M>c"), ("psm", "<P>a<S>b<M>c"), ("plain", "<P>"), (None, "x")], "form string, output string")
    assert [r.restored for r in middle.restored(df).collect()] == [None, None, "acb", "<P>", None]
    with pytest.raises(ValueError):
        middle.restored(df.withColumnRenamed("form", "restored"))


def test_odd_documents(spark, tmp_path):
    rows = [(1, "a\nb", "x"), (1, "a\nb", "x"), (None, None, None), (2, "", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n string").write.parquet(f"{tmp_path}/documents.parquet")
    got = middle.op12_middle_cuts(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r.restored_sha256 == hashlib.sha256((b"a\nb" if r.doc_id == 1 else b"")).hexdigest() for r in got)
