"""Term replacement by an automaton: a loop over the list on any texts, and a dictionary of fifty thousand terms."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.functions.dictionary import Replacer
from folioframe.operators import translate

short = st.text(st.sampled_from("ab "), min_size=0, max_size=4)


def loop(text, terms):
    for cn, en in terms:
        if cn:
            text = text.replace(cn, en)
    return text


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(short, short), max_size=7, unique_by=lambda t: t[0]), st.text(st.sampled_from("ab c"), max_size=40))
def test_the_same_as_a_loop(terms, text):
    """Nested, overlapping and repeated terms, empty wordings, and wordings that make other terms."""
    assert Replacer(terms)(text) == loop(text, terms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["xab", "yab", "ba", "q", "zz"]), st.sampled_from(["", "a", "Z", "zz", "xa"])), max_size=5, unique_by=lambda t: t[0]), st.lists(st.sampled_from(["xab", "yab", "q", "zz", ".....", "b", "-a-"]), max_size=12))
def test_terms_that_lie_apart(terms, parts):
    text = "....".join(parts)
    assert Replacer(terms)(text) == loop(text, terms)


def test_a_term_twice_is_an_error():
    with pytest.raises(ValueError):
        Replacer([("a", "b"), ("a", "c")])


def test_one_scan_where_terms_lie_apart(monkeypatch):
    made = Replacer([("alpha", "A"), ("beta", "B")])
    monkeypatch.setattr(made, "_in_order", None)
    assert made("alpha - - - beta - - - alpha") == "A - - - B - - - A"


def test_fifty_thousand_terms(spark, monkeypatch):
    draw = random.Random(2)
    letters = "abcdefgh"
    names = sorted({"".join(draw.choice(letters) for _ in range(draw.randrange(3, 9))) for _ in range(70_000)})[:50_000]
    terms = [(k, n, n[::-1].upper() if k % 7 else n[:2]) for k, n in enumerate(draw.sample(names, len(names)))] + [(60_000, None, "x"), (60_001, "zzz", None), (60_002, "", "y")]
    texts = [" ".join(draw.choice(names) if draw.random() < 0.5 else "".join(draw.choice(letters) for _ in range(9)) for _ in range(8)) for _ in range(40)] + [None, "", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    dictionary = spark.createDataFrame(terms, "ord int, cn string, en string")
    ordered = [(cn, en) for k, cn, en in sorted((t for t in terms if t[1] and t[2] is not None), key=lambda t: (-len(t[1]), t[0]))]
    want = {k: None if t is None else loop(t, ordered) for k, t in enumerate(texts)}
    out = translate.replace_terms(df, dictionary)
    assert {r.n: r.translated for r in out.collect()} == want and any(want[k] != t for k, t in enumerate(texts))
    assert len(out._jdf.queryExecution().toString()) < 20_000  # no literals
    monkeypatch.setattr(translate, "SMALL_ROWS", 20_000)  # several automata, one after the other
    assert {r.n: r.translated for r in translate.replace_terms(df, dictionary).collect()} == want


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_no_terms(spark, rows):
    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.translated for r in translate.replace_terms(df, spark.createDataFrame(rows, "ord int, cn string, en string")).collect()] == ["a", None]
