"""Operators of the llm subpackage: SQL, brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import html as entities
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.llm import html, language, licenses, mixing, neardup, pieces, quality, registry, sharding, tiff, urls

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, size string, shard string, node string, taken string, root string"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    plain = "one two three four five six seven eight nine ten. " * 3
    rows = [(1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain, None, None), (None, plain, "en", "a"), (3, None, "en", "b"), (4, "", "fr", "b"), (5, " \t\n ", "fr", ""), (6, LONG, "de", "b"), (7, "12 34", "de", "b"), (7, "héé ça 中文", None, "c")]
    return spark.createDataFrame([(*r, None, "x", "y", "z", "s", "n", "t", None) for r in rows], DOC)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


# -- op1 -----------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]), st.sampled_from([1, 2]), st.sampled_from([0, 16, 64]), st.sampled_from("<>"), st.integers(1, 90))
def test_tiff_round_trip(data, scheme, predictor, tile, order, width):
    data += b" " * (-len(data) % width)
    page = np.frombuffer(data, np.uint8).reshape(-1, width)
    made = tiff.tiff_bytes([page, page[:1]], scheme, predictor, tile, 7, order)
    back = list(tiff.pages_of(made))
    assert [p.samples.tobytes() for p in back] == [data, page[:1].tobytes()]
    assert [p.number for p in back] == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 300))
def test_damaged_files_only_raise_their_error(noise, at):
    made = bytearray(tiff.tiff_bytes([np.arange(192 * 4, dtype=np.uint8).reshape(4, 192)], tiff.LZW))
    made[at : at + len(noise)] = noise
    try:
        list(tiff.pages_of(bytes(made)))
    except tiff.TiffError:
        pass


def test_lzw_long_and_predictors():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"ab" * 30_000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    f = np.linspace(-3, 3, 24, dtype=">f4").reshape(2, 12, 1)
    planes = f.view(np.uint8).reshape(2, 12, 4).transpose(0, 2, 1).reshape(2, 48, 1)
    raw = np.diff(planes, axis=1, prepend=np.zeros((2, 1, 1), np.uint8)).astype(np.uint8).tobytes()
    assert np.allclose(tiff.unpredicted(np.frombuffer(raw, ">f4").reshape(2, 12, 1), 3, raw, np.dtype(">f4")), f)


def test_tiff_rows(spark):
    page = np.arange(192 * 3, dtype=np.uint8).reshape(3, 192)
    two = tiff.tiff_bytes([page, page[:2]], tiff.PACKBITS)
    df = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"")), (4, bytearray(b"nonsense")), (1, bytearray(two))], "id bigint, data binary")
    got = [(r.key, r.page, r.height, r.error is None) for r in tiff.tiff_pages(df, "id", "data").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 3, True), (1, 1, 2, True), (1, 0, 3, True), (1, 1, 2, True), (4, 0, None, False)], key=str)


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_samples_of_few_bits(bits, scheme):
    page = np.random.default_rng(bits).integers(0, 1 << bits, (9, 21), dtype=np.uint8)
    for tile in (0, 16):
        (back,) = tiff.pages_of(tiff.tiff_bytes([page], scheme, tile=tile, strip_rows=4, bits=bits))
        assert back.bits == bits and (back.samples[:, :, 0] == page).all()


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_bytes_that_begin_at_the_low_bit(scheme):
    page = np.random.default_rng(9).integers(0, 2, (40, 24), dtype=np.uint8)
    made = bytearray(tiff.tiff_bytes([page], scheme, strip_rows=7, bits=1))
    entry = next(k for k in range(len(made)) if made[k : k + 4] == b"\x06\x01\x03\x00")  # the photometric tag gives its place
    made[entry : entry + 2] = (tiff.FILL_ORDER).to_bytes(2, "little")
    made[entry + 8 : entry + 10] = (2).to_bytes(2, "little")
    first = next(k for k in range(len(made)) if made[k : k + 4] == b"\x11\x01\x04\x00")
    n, at = int.from_bytes(made[first + 4 : first + 8], "little"), int.from_bytes(made[first + 8 : first + 12], "little")
    sizes = int.from_bytes(made[next(k for k in range(len(made)) if made[k : k + 4] == b"\x17\x01\x04\x00") + 8 :][:4], "little")
    for k in range(n):
        a, size = (int.from_bytes(made[x + 4 * k : x + 4 * k + 4], "little") for x in (at, sizes))
        made[a : a + size] = bytes(made[a : a + size]).translate(tiff.TURNED)
    (back,) = tiff.pages_of(bytes(made))
    assert (back.samples[:, :, 0] == page).all()
    made[entry + 8 : entry + 10] = (3).to_bytes(2, "little")
    with pytest.raises(tiff.TiffError, match="fill order 3"):
        next(p for p in tiff.pages_of(bytes(made)) if _raised(p))


def _raised(page):
    if isinstance(page, tiff.TiffError):
        raise page
    return False


def test_pages_after_an_unreadable_one(spark):
    page = np.arange(192 * 3, dtype=np.uint8).reshape(3, 192)
    made = bytearray(tiff.tiff_bytes([page, page[:2], page[:1]], tiff.NONE))
    at = [k for k in range(0, len(made) - 4) if made[k : k + 4] == b"\x03\x01\x03\x00"]  # entries of the compression tag
    made[at[1] + 8 : at[1] + 10] = (7).to_bytes(2, "little")  # a scheme that is not read
    df = spark.createDataFrame([(None, made, "x")], "id bigint, data binary, page string")
    assert [(r.key, r.page, r.height, r.error) for r in tiff.tiff_pages(df, "id", "data").collect()] == [(None, 0, 3, None), (None, 1, None, "compression 7"), (None, 2, 1, None)]
    huge = bytearray(tiff.tiff_bytes([page], tiff.DEFLATE))
    at = next(k for k in range(len(huge)) if huge[k : k + 4] == b"\x01\x01\x04\x00")  # the height
    huge[at + 8 : at + 12] = (1 << 20).to_bytes(4, "little")
    with pytest.raises(tiff.TiffError):
        list(tiff.pages_of(bytes(huge)))


def test_all_forms_take_part_in_the_store():
    forms = Counter()
    for k in range(300):
        payload, _ = tiff.payload_of("some words " * (k % 40) + str(k))
        pages = list(tiff.pages_of(tiff.stored(payload)))
        forms[pages[0].compression, pages[0].predictor, pages[0].tiled] += 1
    payload, _ = tiff.payload_of("long text " * 4000)
    assert len(list(tiff.pages_of(tiff.stored(payload)))) == 4
    assert {c for c, _, _ in forms} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE, tiff.NONE} and {p for _, p, _ in forms} == {1, 2} and {t for _, _, t in forms} == {True, False}


def test_tiff_query_by_hand(spark, odd):
    got = tiff.through_tiff(odd).collect()
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert len(got) == sum(texts.values())
    want = Counter()
    for (doc_id, text), n in texts.items():
        raw = text.encode()
        full = raw + b" " * (max(-(-len(raw) // 192), 1) * 192 - len(raw))
        want[doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])] += n
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1


# -- op2 -----------------------------------------------------------------------------------------------------------


def brute_components(rows):
    """component of each id, by an index of shingles and a union-find."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    common = Counter((a, b) for ids in index.values() for a in ids for b in ids if a < b)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(seed=3):
    """Exact copies, chains of edits, a passage that many texts share, and texts of fewer than five words."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefgh"), 4))
    base = [word() for _ in range(80)]
    passage = [word() for _ in range(60)]
    rows = [" ".join(base)] * 5
    for k in range(60):
        edited = list(base)
        for _ in range(k % 4 + 1):
            edited[r.integers(0, 80)] = word()
        rows.append(" ".join(edited))
    rows += [" ".join(passage + [word() for _ in range(10 + k % 20)]) for k in range(80)]
    chain = list(base)
    for _ in range(25):
        chain[r.integers(0, 80)] = word()
        rows.append(" ".join(chain))
    return [*enumerate(rows), (900, "a b"), (901, "A\tB"), (902, "a b c"), (903, ""), (904, None), (905, "  ")]


@pytest.mark.parametrize("large", [0, 16, 1000])
def test_near_duplicates_by_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(neardup, "LARGE_BAND", large)
    rows = near_copies()
    want, sizes = brute_components(rows)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark, odd):
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.groups(odd).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (None, None, True): 1, (3, 3, True): 1, (4, 4, True): 1, (5, 5, True): 1, (6, 6, True): 1, (7, 7, True): 2})
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, None, 3, 4, 5, 6, 7, 7])
    assert neardup.groups(odd.limit(0)).count() == 0 and neardup.one_of_each(odd.limit(0)).count() == 0


def test_estimate_is_near_the_truth(spark):
    a = neardup.shingle_set(" ".join(f"a{i}" for i in range(1000)))
    b = np.concatenate([a[:860], neardup.shingle_set(" ".join(f"b{i}" for i in range(140)))])
    x, y = (neardup.signature(neardup.minima(np.sort(s))) for s in (a, b))
    df = spark.createDataFrame([(*map(int, x), *map(int, y))], ", ".join(f"{p}s{k} bigint" for p in ("a_", "b_") for k in range(4)))
    true = 860 / (len(a) + len(b) - 860)
    assert abs(df.select(neardup.estimate("a_", "b_")).first()[0] - true) < 0.15


# -- op3 -----------------------------------------------------------------------------------------------------------


def test_mix_by_brute_force(spark, docs):
    sized = mixing.sizes(docs)
    rows = [tuple(r) for r in sized.collect()]
    got = mixing.mix(sized, 16).collect()
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    cap = {s: 2 * n for s, n in size.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    goal, left, open_ = {}, sum(size.values()) * 1.5, set(size)
    while True:  # share by weight, stop those above their cap, share again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) < 1 for s in goal)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(sized, 16).collect()), key=repr)


def test_mix_odd_rows(spark, odd):
    got = mixing.mix(mixing.sizes(odd)).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got)
    assert {r.taken for r in got if r.size == 0} == {0}
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and rows.count() > 0
    assert mixing.mix(mixing.sizes(odd.limit(0))).count() == 0 and mixing.mixed_rows(odd.limit(0)).count() == 0


def test_tiny_sources_get_their_words(spark):
    rows = [(k, "big", 1000) for k in range(3000)] + [(10_000 + k, f"tiny{k}", 3) for k in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")).collect()
    assert all(r.taken == r.target for r in got if r.source != "big")


def test_slots_by_plain_code(spark):
    """The golden-ratio points decide which slots read a document."""
    rows = [(k, ("a", "b", None)[k % 3 if k % 5 else 0], k * 7 % 90) for k in range(400)] + [(None, "a", 11)] * 50
    block = 64
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint"), block).collect()
    quota = {r.source: int(r.target) for r in got}
    size = {r.source: r.source_size for r in got}
    names = sorted(size, key=lambda x: (x is None, x or ""))
    total, edges, at = sum(quota.values()), [], 0
    for x in names:
        at += quota[x]
        edges.append(int(at / total * 2**32))
    n_slots = total // block + 1
    n_slots += n_slots // 64 + 64
    by = defaultdict(list)
    for i in range(n_slots):
        x = (i + 1) * mixing.GOLDEN % 2**32
        by[next(s for s, e in zip(names, edges) if x < e)].append(i)
    words = defaultdict(list)  # for each source, the slots that read each of its words
    for x in names:
        words[x] = [[] for _ in range(size[x])]
        blocks = -(-size[x] // block)
        for rank, slot in enumerate(by[x]):
            turn, b = divmod(rank, blocks)
            for w in range(b * block, min((b + 1) * block, size[x])):
                if turn * size[x] + w < quota[x]:
                    words[x][w].append(slot)
    want = Counter()
    for x in names:
        at = 0
        for h, i, n in sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:7], -1 if i is None else i, n) for i, s, n in rows if s == x and n):
            read = sorted({(w // block, s) for w in range(at, at + n) for s in words[x][w]})
            want[None if i < 0 else i, sum(len(words[x][w]) for w in range(at, at + n)), min((s for _, s in read), default=None), len(read)] += 1
            at += n
    assert Counter((r.doc_id, r.taken, r.first_slot, r.n_slots) for r in got if r["size"]) == want
    assert {(r.taken, r.first_slot, r.n_slots) for r in got if not r["size"]} == {(0, None, 0)}


def test_schedule_is_even(spark):
    s = spark.createDataFrame([(1, 3000, 3000), (2, 1000, 1000), (3, 6000, 6000)], "source_no int, source_size bigint, quota bigint")
    n = {r.source_no: r["count"] for r in mixing.schedule(s, 10).groupBy("source_no").count().collect()}
    total = sum(n.values())
    assert all(abs(n[k] - total * q / 10) < 6 for k, q in ((1, 3), (2, 1), (3, 6)))


# -- op4 -----------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op4_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_every_one_of_many_languages_is_learned(spark):
    r = np.random.default_rng(8)
    words = {f"l{k}": ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(12)] for k in range(150)}
    rows = [(n * 1000 + k, " ".join(r.choice(words[f"l{k}"], 60)), f"l{k}") for k in range(150) for n in range(14 if k else 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df)
    assert {x for m in model.members.values() for x in m} == set(words) and len(model.bias) < 3000
    got = language.predicted(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_votes_by_plain_code(docs):
    """Every machine of the family level, then those of the family, each asked on its own."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").limit(120).collect()
    model = language.trained(np.stack([language.grams(r.text) for r in rows]), [r.lang for r in rows])
    langs, scores = model.predict([r.text for r in rows])

    def level(name, classes, x):
        won, sure = Counter(), Counter()
        for k, a, b in model.machines.get(name, ()):
            m = sum(float(w) * float(v) for w, v in zip(model.weights[k], x)) + float(model.bias[k])
            p = 1 / (1 + np.exp(-2 * max(-20, min(20, m))))
            won[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
        best = max(classes, key=lambda c: (won[c], sure[c], c))
        return best, sure[best] / (len(classes) - 1) if len(classes) > 1 else 1.0

    for r, lang, score in zip(rows[:40], langs, scores):
        family, p = level("", model.families, language.grams(r.text))
        best, q = level(family, model.members[family], language.grams(r.text))
        assert lang == best and score == pytest.approx(p * q, abs=1e-4)


def test_machine_is_at_the_least_loss():
    r = np.random.default_rng(4)
    x = r.normal(size=(80, 6)).astype(np.float32)
    y = np.where(x[:, 0] - 0.4 * x[:, 1] + 0.3 * r.normal(size=80) > 0, 1.0, -1.0)
    w, b = language.svm(x, y, 5.0, 60)
    balance = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * 80

    def loss(v):
        return 0.5 * v @ v + 5.0 / 80 * (balance * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    v = np.append(w.astype(np.float64), b)
    u = np.zeros(7)
    for _ in range(4000):  # plain gradient steps from zero come to the same place
        margin = np.maximum(0, 1 - y * (x @ u[:-1] + u[-1]))
        g = u - 2 * 5.0 / 80 * np.append(x, np.ones((80, 1)), axis=1).T @ (balance * y * margin)
        u -= 0.02 * g
    assert np.allclose(u, v, atol=1e-3) and loss(v) <= loss(u) + 1e-6


def test_language_odd_rows(spark, odd, docs):
    got = language.predicted(odd, language.fit(docs))
    assert got.columns == [*[c for c in odd.columns if c != "score"], "lang_pred", "score"]
    rows = got.collect()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    assert {r.lang_pred for r in rows if r.text == "12 34"} == {"und"}
    none = language.fit(odd.limit(0))
    assert {r.lang_pred for r in language.predicted(odd, none).collect()} == {"und"}
    one = language.fit(odd.filter("lang = 'en'"))
    assert {r.lang_pred for r in language.predicted(odd.filter("doc_id IN (1, 6)"), one).collect()} == {"en"}
    assert language.predicted(odd.limit(0), one).count() == 0


def test_a_label_with_one_row_of_letters_is_learned(spark):
    rows = [(k, "12 34 56", "xx") for k in range(6000)] + [(9000, "zażółć gęślą jaźń", "xx")]
    rows += [(10_000 + k, f"the words of this text are number {k} of many", "en") for k in range(200)]
    rows += [(20_000 + k, f"слово за словом номер {k}", f"r{k % 30}") for k in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    learned = {x for m in model.members.values() for x in m}
    assert learned == {"xx", "en", *(f"r{k}" for k in range(30))}


# -- op5 -----------------------------------------------------------------------------------------------------------


def test_quality_by_hand(spark):
    text = "a b c a b c x\n\nq #\nq #\n  \n"
    r = quality.row_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (11, 11, 2, 1, 6, True)
    r = quality.row_rules(spark.createDataFrame([("a a a a a",)], "text string")).first()
    assert r.n_repeat_words == 5


def test_bad_hosts_are_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(k, "bad", "x y") for k in range(40)] + [(100, "bad", good)] + [(200 + 50 * h + k, f"h{h}", good) for h in range(6) for k in range(40)]
    judged = quality.row_rules(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    got = {r.doc_id: r for r in quality.with_verdicts(judged, quality.host_verdicts(judged)).collect()}
    assert got[100].host_rejected and not got[100].kept and not got[100].base_failed
    assert all(got[k].kept for k in got if k >= 200)


def test_hosts_are_judged_against_the_corpus(spark):
    """A rate that is high beside the other hosts' rejects; the same rate on all hosts does not, nor does one of a few documents."""
    good, bad = " ".join(f"word{i}" for i in range(80)), "x y"
    rows = [(h, "farm" if h == 7 else f"h{h}", bad if k < (30 if h == 7 else 4) else good) for h in range(20) for k in range(60)] + [(30, "tiny", bad), (30, "tiny", good)]
    judged = quality.row_rules(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    got = {r.host_key: r for r in quality.host_verdicts(judged).collect()}
    assert {h for h, r in got.items() if r.host_rejected} == {"s:farm"}
    n, f = [x.host_docs for x in got.values()], [x.host_failed for x in got.values()]
    a, b = quality.beta_prior(sum(n), sum(f), len(n), sum(y / x for x, y in zip(n, f)), sum((y / x) ** 2 for x, y in zip(n, f)), sum(1 / x for x in n), 1e6)
    assert all(r.host_rate == pytest.approx((r.host_failed + a) / (r.host_docs + a + b), abs=1e-6) for r in got.values())
    assert got["s:tiny"].host_rate < 0.5  # shrunk below its own rate
    alike = quality.row_rules(spark.createDataFrame([(h, f"h{h}", bad if k < 30 else good) for h in range(20) for k in range(60)], "doc_id bigint, source string, text string"))
    assert not any(r.host_rejected for r in quality.host_verdicts(alike).collect())


def test_quality_odd_rows(spark, odd):
    judged = quality.row_rules(odd)
    got = quality.with_verdicts(judged, quality.host_verdicts(judged))
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {(r.n_words, r.n_repeat_words, r.kept) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 0, False)}
    long = next(r for r in rows if r.doc_id == 6)
    assert long.n_words == 60_000
    none = quality.row_rules(odd.limit(0))
    assert quality.with_verdicts(none, quality.host_verdicts(none)).count() == 0


# -- op6 -----------------------------------------------------------------------------------------------------------


def shards_of(df, n=24):
    rows = sharding.metadata(df)
    return sharding.with_slots(sharding.kd_shards(rows, n))


def test_shards_are_even_and_gapless(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shards_of(d).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean, most = sum(size.values()) / 24, max(r.size for r in got)
    assert len(size) == 24 and all(abs(v - mean) <= 2 * most + 0.05 * mean for v in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    text = {r.doc_id: r.text for r in d.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)


def test_shards_by_a_plain_tree(spark):
    """The same tree by sorting rows in lists; all four dimensions split some node."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    meta = sharding.metadata(d).collect()
    got = {r.doc_id: r.shard for r in shards_of(d).collect()}
    dims = list(sharding.dimensions())
    ordered = {x: sorted((r[x] // sharding.CELL_WIDTH, r["size"]) for r in meta) for x in dims}
    used, want = set(), {}

    def width(rows, x):
        cells = [r[x] // sharding.CELL_WIDTH for r in rows]
        return sum(n for c, n in ordered[x] if min(cells) < c <= max(cells))

    def split(rows, first, leaves):
        if leaves == 1:
            want.update({r.doc_id: first for r in rows})
            return
        x = max(dims, key=lambda x: (width(rows, x), -dims.index(x)))
        used.add(x)
        rows = sorted(rows, key=lambda r: (r[x], r.tie))
        goal, total, cut = sum(r["size"] for r in rows) * (leaves // 2) / leaves, 0, 0
        while total + rows[cut]["size"] <= goal:
            total += rows[cut]["size"]
            cut += 1
        while cut and rows[cut].text_crc32 == rows[cut - 1].text_crc32:
            cut -= 1
        split(rows[:cut], first, leaves // 2)
        split(rows[cut:], first + leaves // 2, leaves - leaves // 2)

    split(meta, 0, 24)
    assert used == set(dims)
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.98  # splits are exact to a thousandth of a shard


def test_a_large_group_of_copies_is_cut(spark):
    rows = [(k, "same text " * 20) for k in range(1200)] + [(2000 + k, f"other {k} " * (k % 40 + 1)) for k in range(600)]
    size = Counter()
    for r in shards_of(spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string"), 8).collect():
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert all(abs(v - mean) < 0.1 * mean for v in size.values())


def test_shards_odd_rows(spark, odd):
    got = shards_of(odd).collect()
    assert len(got) == odd.count() and {r.size for r in got if r.doc_id in (3, 4)} == {8} and {r.text_crc32 for r in got if r.doc_id == 3} == {0}
    assert shards_of(odd.limit(0)).count() == 0


# -- op7 -----------------------------------------------------------------------------------------------------------


def test_licenses_found_in_long_texts(spark):
    fill = [f"f{i}" for i in range(5000)]
    rows = []
    for k, x in enumerate(licenses.TEMPLATES):
        rows.append((k, " ".join(fill[: k * 7]) + "\n" + x.text.upper() + "\n" + " ".join(fill[:50])))
    rows += [(100, " ".join(fill)), (101, None), (102, "")]
    got = defaultdict(dict)
    for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r.doc_id][r.license_id] = r.containment
    for k, x in enumerate(licenses.TEMPLATES):
        assert got[k][x.license_id] == 1.0
    assert not set(got) - set(range(len(licenses.TEMPLATES)))


def test_partial_license(spark):
    words = licenses.TEMPLATES[9].text.split()
    less = " ".join(words[:-3] + ["else", "wholly", "different"])
    got = licenses.scanned(spark.createDataFrame([(1, less), (2, " ".join(words[:8]))], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.license_id) for r in got] == [(1, "BSD-3-Clause")] and 0.75 <= got[0].containment < 1


def test_licenses_odd_rows(spark, odd):
    assert licenses.scanned(odd).count() == 0 and licenses.scanned(odd.limit(0)).count() == 0


def test_short_notices_are_found_in_any_surroundings(spark):
    r = np.random.default_rng(11)
    rows = [(k, " ".join(f"a{x}" for x in r.integers(0, 10**9, 40)) + " Licensed under CC BY-NC 4.0. " + " ".join(f"b{x}" for x in r.integers(0, 10**9, 40 + k % 3))) for k in range(6000)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # the notice is one shingle, at place 40, and so is its window
    assert len(got) == 6000 and {(r.license_id, r.n_windows, r.containment, r.first_word) for r in got.values()} == {("CC-BY-NC-4.0", 1, 1.0, 40)}


def edited_notices(count):
    """Texts that state the longest notice with one to five words changed, so that some hold just enough of it."""
    r = np.random.default_rng(17)
    words = max((x.text for x in licenses.TEMPLATES), key=lambda x: len(x.split())).split()
    rows = []
    for k in range(count):
        w = list(words)
        for i in r.choice(len(w), r.integers(0, 3), replace=False):
            w[i] = f"x{r.integers(0, 10**6)}"
        rows.append((k, " ".join(f"a{x}" for x in r.integers(0, 10**6, k % 23)) + " " + " ".join(w) + " " + " ".join(f"b{x}" for x in r.integers(0, 10**6, 30))))
    return rows


def brute_licenses(text):
    """license, windows, containment and first word by comparing every window with every template."""
    clean = lambda x: re.sub(r"[^\w\s.-]|\.(?=\s|$)", " ", x.lower()).split()
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out, have = set(), runs(clean(text))
    for t in licenses.TEMPLATES:
        want = runs(clean(t.text))
        step = max(1, len(want) // 4)
        found = [(len(set(want) & set(have[s : s + len(want) + step - 1])) / len(set(want)), -s) for s in range(0, len(have), step)]
        found = [f for f in found if f[0] >= 0.75]
        if found:
            out.add((t.license_id, len(found), max(found)[0], -max(found)[1]))
    return out


def test_bands_find_what_brute_force_finds(spark, monkeypatch):
    rows = edited_notices(400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(k, *x) for k, text in rows for x in brute_licenses(text)}
    assert {tuple(r) for r in licenses.scanned(df).collect()} == want and len(want) > 150
    monkeypatch.setattr(licenses, "MISS", 0.9)  # the bands decide what is found
    assert {tuple(r) for r in licenses.scanned(df).collect()} != want


def test_repeated_rows_and_null_ids_with_a_license(spark):
    text = "a b c Released under the MIT License. d e"
    df = spark.createDataFrame([(1, text, "x", 5), (1, text, None, 5), (None, text, "x", None), (2, None, None, None)], "doc_id bigint, text string, license_id string, start int")
    assert Counter((r.doc_id, r.license_id, r.n_windows, r.first_word) for r in licenses.scanned(df).collect()) == {(1, "MIT", 1, 3): 2, (None, "MIT", 1, 3): 1}


def test_wordings_of_one_license_and_templates_that_repeat_themselves(spark):
    again = " ".join(["one two three four five six"] * 60)
    some = (licenses.Template("A", "alpha beta gamma delta epsilon zeta"), licenses.Template("A", " ".join(f"w{i}" for i in range(200))), licenses.Template("again", again))
    table = licenses.template_table(spark, some).orderBy("no").collect()
    assert [(r.n, r.width) for r in table] == [(2, 2), (196, 244), (6, 6)] and max(r.bands for r in table) < 1000
    whole = some[1].text
    docs = spark.createDataFrame([(1, f"x y {some[0].text} z"), (2, f"x {whole} y"), (3, f"x {whole} {some[0].text}"), (4, f"a b {again} c"), (5, "x y z")], "doc_id bigint, text string")
    got = {(r.doc_id, r.license_id): (r.containment, r.n_windows) for r in licenses.scanned(docs, some).collect()}
    assert {k: c for k, (c, _) in got.items()} == {(1, "A"): 1.0, (2, "A"): 1.0, (3, "A"): 1.0, (4, "again"): 1.0}
    assert got[3, "A"][1] == got[1, "A"][1] + got[2, "A"][1] or got[3, "A"][1] > got[1, "A"][1]


def test_long_and_short_templates(spark):
    full = " ".join(f"l{i}" for i in range(3000))
    some = (licenses.Template("full", full), licenses.Template("medium", " ".join(f"m{i}" for i in range(257))), licenses.TEMPLATES[1])
    fill = " ".join(f"f{i}" for i in range(500))
    docs = spark.createDataFrame([(1, f"{fill} {full} {fill}"), (2, f"{fill} {some[1].text} {fill} {some[2].text}"), (3, fill)], "doc_id bigint, text string")
    assert {(r.doc_id, r.license_id, r.containment) for r in licenses.scanned(docs, some).collect()} == {(1, "full", 1.0), (2, "medium", 1.0), (2, "MIT", 1.0)}
    with pytest.raises(ValueError, match="fewer than 5 words: tiny"):
        licenses.scanned(docs, (*some, licenses.Template("tiny", "MIT License")))


# -- op8 -----------------------------------------------------------------------------------------------------------


def test_main_text_of_the_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in html.op8_main_text(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        body = re.sub("</?(?:p|h1|h2|li|ul)>", "\x01", body).replace("<br>", " ")
        want = "\n\n".join(x for x in (" ".join(entities.unescape(y).split()) for y in re.sub("<[^>]*>", "", body).split("\x01")) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_held_out_layouts():
    m, right, n = html.model(), 0, 0
    for page in html.training_pages(80, seed=99):
        nodes = html.labelled(html.parsed(page))
        for x, p in zip(nodes, m.marginals(nodes), strict=True):
            if x.text is not None:
                n += 1
                right += (p[html.CONTENT] > 0.5) == (x.label == html.CONTENT)
    assert right / n > 0.98


LONG_PARAGRAPH = "This is a long paragraph of the article, which tells about things that happened and goes on for some time. "


@pytest.mark.parametrize(
    "name",
    ["body", "mw-parser-output", "x1", "header-image-story", "page-top", "related", "more-text", "tags", "search-results", "form-factor review", "share-price", "skip-content", "toc", "thread", "reply", "ad-hoc"],
)
def test_a_class_name_takes_no_article_away(name):
    page = '<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="{}"><h1>Head line</h1><p>{}</p><p>{} Again.</p></div><footer>&copy; example</footer>'
    got = html.model().main_text("<html><head><title>t</title></head><body>" + page.format(name, LONG_PARAGRAPH, LONG_PARAGRAPH) + "</body></html>")
    assert got == f"Head line\n\n{LONG_PARAGRAPH.strip()}\n\n{LONG_PARAGRAPH.strip()} Again."


@pytest.mark.parametrize("part", ["<div class=related><h3>More</h3><p>Another text that is named here.</p></div>", "<section class=comments><div class=comment><p>I liked this one very much, thank you.</p></div><div class=comment><p>So did I.</p></div></section>", "<div class=sidebar><p>Words beside the article.</p></div>", "<div class='cookie-notice'><p>We use cookies on this site.</p></div>"])
def test_parts_around_an_article_go(part):
    body = f"<article><h1>Head line</h1><p>{LONG_PARAGRAPH}</p><p>{LONG_PARAGRAPH} Again.</p></article>"
    for page in (body + part, part + body, body.replace("article>", "div>") + part):
        got = html.model().main_text(f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav>{page}<footer>&copy; x</footer></body></html>")
        assert got == f"Head line\n\n{LONG_PARAGRAPH.strip()}\n\n{LONG_PARAGRAPH.strip()} Again."


def test_quotes_that_do_not_close():
    from time import process_time

    at = process_time()
    html.parsed("<p title='x>text it's " * 4000)
    html.parsed('<p title="x>text " ' * 4001 + "<b>")
    assert process_time() - at < 0.5
    texts = lambda page: [n.text for n in html.parsed(page) if n.text is not None]
    assert texts("<p title='a>b' class=\"c>d\">one</p><p title='e>two</p><p>three</p>") == ["one", "two", "three"]
    assert texts("<p title='it>x' y>one <b title=\"'\">two</b>") == ["one two"] and texts("a <p") == ["a"]


def test_marginals_by_enumeration():
    """Sum-product gives what summing over all joint states gives."""
    m = html.model()
    nodes = html.parsed("<nav><a href=x>a</a></nav><article><p>Some words here.</p></article>")
    got = m.marginals(nodes)
    total = np.zeros((len(nodes), 3))
    for states in np.ndindex(*[3] * (len(nodes) - 1)):
        s = (html.FRAME, *states)
        p = np.prod([m.pairs[s[nodes[k].parent], s[k]] * m.unary(nodes[k])[s[k]] for k in range(1, len(nodes))])
        for k, x in enumerate(s):
            total[k, x] += p
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-9)


def test_html_odd_rows(spark):
    deep = "<div>" * 3000 + "<p>x</p>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<article><p>Only this &amp; that&nbsp;one.</p></article><div class=comments>no</div>"), (3, "u", deep), (4, "u", "<script>var a='<p>x</p>'"), (5, "u", "a < b <3")]
    got = html.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).collect()
    by = {(r.page_id, r.text) for r in got}
    assert len(got) == 7 and {(1, ""), (2, ""), (None, ""), (3, "Only this & that one."), (4, "")} <= by
    assert html.main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "before",
    ["<datalist><option value=a><option value=b></datalist>", "<select><option>a<option>b</select>", "<button>go", "<noscript>", "<object>", "<svg><path d='M0'/>", "<svg/>", "<template>", "<video><source src=x>"],
)
def test_unclosed_parts_lose_no_article(before):
    got = html.model().main_text(f"<html><head><title>t</title></head><body><div>{before}</div>" + "<article><h1>Head line</h1><p>One sentence of the article, long enough to count.</p><p>Another one follows it.</p></article></body></html>")
    assert got.endswith("Head line\n\nOne sentence of the article, long enough to count.\n\nAnother one follows it.")


def test_time_grows_with_the_page():
    """Open elements that never end, and end tags without a start."""
    from time import process_time

    def seconds(n):
        pages = ["<div>" * n + "</span></section>" * n, "<b>" * n + "<div>x</div></i>" * n, "<table>" + "<tr><td><i>y" * n, "<ul>" + "<li><b>z" * n + "</p>" * n, "<p>x" * n]
        at = process_time()
        for p in pages:
            html.parsed(p)
        return process_time() - at

    seconds(2000)
    assert seconds(16_000) < 8 * 3 * max(seconds(2000), 0.02)


def test_very_long_and_odd_pages(spark):
    long = "<article>" + "".join(f"<p>This is sentence number {i} of the article.</p>" for i in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, None)], "page_id bigint, url string, html string").withColumn("n_chars", F.lit("x"))
    got = html.main_texts(df).collect()
    assert Counter((r.page_id, r.text.count("\n\n"), r.n_chars == len(r.text)) for r in got) == {(1, 19_999, True): 2, (None, 0, True): 1}


def test_parts_of_an_article_are_seen():
    page = "<article><p>Let <math><mi>x</mi><mspace/></math> be a number of this kind.</p>{}<p>This sentence ends the article.</p></article>"
    for tag in ("noscript", "object", "button", "template", "canvas"):
        got = html.model().main_text(page.format(f"<{tag}>Words of a part.</{tag}>"))
        assert got == "Let x be a number of this kind.\n\nWords of a part.\n\nThis sentence ends the article."
    # in boilerplate they are boilerplate, and raw text is no text
    page = "<nav><a href=x>a</a><button>Open the menu</button></nav><article><p>This sentence is the article.</p><script>var a = '</p>'</script></article>"
    assert html.model().main_text(page) == "This sentence is the article."


# -- op9 -----------------------------------------------------------------------------------------------------------


def judge(spark, url):
    df = spark.createDataFrame([(1, url)], "page_id bigint, url string")
    return urls.judged(df, urls.mined(spark.createDataFrame([], "items array<string>"))).first()


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/5?x=1", "a.example.com", "/en/5", "com/en/", "block"),
        ("http://a.example.com/en/71", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://a.example.net/de/1", "a.example.net", "/de/1", "net/de/", "allow"),
        ("https://example.net/de/8#t", "example.net", "/de/8", "example.net/de/8", "block"),
        ("https://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("https://x.org/es/", "x.org", "/es/", "org/es/", "block"),
        ("https://x.org?q=/es/", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    r = judge(spark, url)
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_mined_rules_by_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(400):
        tokens = {f"h:{r.integers(0, 6)}", f"p:{r.integers(0, 4)}", f"q:{r.integers(0, 3)}"}
        bad = {"h:1", "p:2"} <= tokens or "h:5" in tokens or r.random() < 0.1
        rows.append((sorted(tokens) + [urls.BAD] * bad,))
    limit = 2 * sum(urls.BAD in items for (items,) in rows) / len(rows)
    params = urls.MiningParams(min_urls=5)
    got = {tuple(x.tokens): round(x.confidence, 9) for x in urls.mined(spark.createDataFrame(rows, "items array<string>"), params).collect()}
    count, bad = Counter(), Counter()
    for (items,) in rows:
        plain = [x for x in items if x != urls.BAD]
        for mask in range(1, 1 << len(plain)):
            s = tuple(sorted(x for k, x in enumerate(plain) if mask >> k & 1))
            count[s] += 1
            bad[s] += urls.BAD in items
    rules = {s: bad[s] / count[s] for s in count if bad[s] >= 5 and bad[s] / count[s] >= limit}
    want = {s: round(c, 9) for s, c in rules.items() if not any(set(p) < set(s) and rules[p] >= c for p in rules)}
    assert got == want and got


@pytest.mark.parametrize("kind", ["same", "one less", "with good ones"])
def test_many_tokens_that_stand_together(spark, kind):
    """Thirty bad URLs that share forty tokens, all of them or all but one each, and good URLs with half of them."""
    words = [f"p:t{k:02d}" for k in range(40)]
    rows = [(sorted({*words, f"p:own{i}"} - ({words[i]} if kind == "one less" else set())) + [urls.BAD],) for i in range(30)]
    rows += [([f"p:other{i}", "p:all"],) for i in range(70)]
    if kind == "with good ones":
        rows += [(words,) for _ in range(10)]
    rules = urls.mined(spark.createDataFrame(rows, "items array<string>")).collect()
    assert sorted(r.tokens[0] for r in rules) == words and all(len(r.tokens) == 1 and r.key == r.tokens[0] for r in rules)
    assert {round(r.confidence, 6) for r in rules} == {0.75 if kind == "with good ones" else 1.0}


def test_mined_rules_block(spark):
    pages = spark.createDataFrame([(k, f"http://{'bad' if k % 2 else 'ok'}.example.org/xx/{k}") for k in range(100)] + [(None, None), (7, "http://bad.example.org/xx/7")], "page_id bigint, url string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100)] + [(None, None, None), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    rules = urls.mined(urls.baskets(pages, labels, urls.MiningParams()))
    got = urls.judged(pages, rules).collect()
    assert all(r.verdict == ("block" if r.host.startswith("bad") else "allow") for r in got) and len(got) == 102
    none = pages.limit(0)
    assert urls.judged(none, urls.mined(urls.baskets(none, labels.limit(0), urls.MiningParams()))).count() == 0


@pytest.mark.parametrize("most", [0, 512])
def test_rules_decide_by_map_and_by_join(spark, monkeypatch, most):
    """Words of host labels, of which bad ones are bad in four of five URLs, not in all."""
    monkeypatch.setattr(urls, "INDEX_RULES", most)
    host = lambda k: ("free-casino", "news-daily", "free-mail", "free-news")[k % 4]
    pages = spark.createDataFrame([(k, f"http://www.{host(k)}.example.edu/xx/{k}", "c") for k in range(400)] + [(None, "http://my-casino.example.edu/" + "y/" * 3000 + "z", None), (None, None, None)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0 and k % 20 != 0)) for k in range(400)], "doc_id bigint, quality int, toxic int")
    rules = urls.mined(urls.baskets(pages, labels, urls.MiningParams()))
    assert {tuple(r.tokens) for r in rules.collect()} == {("h:casino",)}
    got = urls.judged(pages, rules).collect()
    assert len(got) == 402 and all((r.verdict == "block") == ("casino" in r.host) == (r.n_mined == 1) for r in got)
    # without mined rules nothing of this is blocked
    assert {r.verdict for r in urls.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_the_last_tokens_of_a_deep_url_count(spark):
    deep = lambda k, last: f"http://a.b.example.org/xx/{k}/" + "/".join(f"w{k}x{i}" for i in range(14)) + f"/{last}"
    rows = [(k, deep(k, ("fine", "tail")[k % 2]) + f"?{('a', 'b')[k % 2]}=1") for k in range(100)] + [(200, deep(200, "tail")), (201, deep(201, "fine") + "?b=1"), (202, deep(202, "fine"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100)], "doc_id bigint, quality int, toxic int")
    rules = urls.mined(urls.baskets(pages, labels, urls.MiningParams()))
    assert {tuple(r.tokens) for r in rules.collect()} == {("p:tail",), ("q:b",)}
    got = {r.page_id: r.verdict for r in urls.judged(pages, rules).collect()}
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(100)) and (got[200], got[201], got[202]) == ("block", "block", "allow")


# -- op10 ----------------------------------------------------------------------------------------------------------

CASES = ["", " ", "  ", "hello  world", " a\n\nb\t", "a　b", "ﬁ Å é", "▁x", "a ▁b", "\x00a", "</s>x<s> <unk> <0x41>", "😀 é", " " * 40 + "x" + " " * 19, "\n" * 30, "中文 mixed English", "a" * 300, "𓀀𓀁 x", LONG[:5000]]


@pytest.fixture(scope="session")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def agrees(library, text):
    enc = pieces.encoder(pieces.default_model())
    ids = library.encode(text, add_eos=True)
    assert enc.encode(text) == ids and enc.decode(ids) == library.decode(ids)
    assert enc.digest(text) == (len(ids), " ".join(map(str, ids)), library.decode(ids))


@pytest.mark.parametrize("text", CASES)
def test_pieces_as_the_library(library, text):
    agrees(library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\nthe ingaeio"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_of_any_text(library, text):
    agrees(library, text)


def test_pieces_of_documents(spark, library, docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = Counter()
        for r in rows:
            ids = library.encode(r.text or "", add_eos=True)
            want[r.doc_id, len(ids), pieces.sha(" ".join(map(str, ids))), pieces.sha(library.decode(ids))] += 1
        assert Counter(map(tuple, pieces.encoded(df, pieces.default_model()).collect())) == want
    assert pieces.encoded(odd.limit(0), pieces.default_model()).count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_by_hand(spark, docs):
    """Each stage on what the one before kept, against plain code."""
    import corpus_pipeline
    from folioframe.llm.common import durable

    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = durable(stage(spark, at, SF))
        kept[name] = at.collect()
        if name != "token ids":
            assert at.columns == docs.columns
    judged = quality.row_rules(docs)
    want = {r.doc_id for r in quality.with_verdicts(judged, quality.host_verdicts(judged)).collect() if r.kept}
    first = kept["quality rules"]
    assert {r.doc_id for r in first} == want
    second = kept["language identification"]
    assert {r.doc_id for r in second} <= want and len(second) >= 0.99 * len(first)
    component, _ = brute_components([(r.doc_id, r.text) for r in second])
    third = kept["near-duplicates"]
    assert {r.doc_id for r in third} == set(component.values()) and len(third) == len(set(component.values()))
    sources = Counter()
    for r in kept["source mix"]:
        sources[r.source] += 1
    assert max(Counter(r.doc_id for r in kept["source mix"]).values()) <= 2
    assert len(kept["token ids"]) == len(kept["source mix"])
    assert corpus_pipeline.run(spark, SF).count() == len(kept["token ids"])


def odd_stage_rows(rows, columns):
    """What each stage keeps of odd rows, in plain code; the mix is given the ids that its own operator takes."""
    text = {c: k for k, c in enumerate(columns)}["text"]
    words = [(r, (r[text] or "").encode().split()) for r in rows]
    long = []
    for r, w in words:
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(hit) <= 50 * len(w):
            long.append(r)
    return long


def test_pipeline_stages_take_odd_rows(spark, odd):
    """Columns with the names that operators use come back unchanged, row by row, through every stage."""
    import corpus_pipeline

    unlike = " ".join(f"word{k}" for k in range(80))
    more = spark.createDataFrame([(20 + k, f"{unlike} and {'more ' * k}", "en", "a", None, "x", "y", "z", "s", "n", "t", None) for k in range(3)], DOC)
    names = {"n_words": 7, "host_rate": 0.25, "lang_pred": "zz", "__k": "k", "__w": "w", "__host": "h", "__copies": 3, "__copy": None, "__key": "key", "__id": 4, "component_id": -1, "carried": "c", "first slot": 1.5}
    docs = odd.unionByName(more).withColumns({c: F.lit(x) if x is not None else F.lit(None).cast("int") for c, x in names.items()})
    at = docs
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, got = plain(at), plain(stage(spark, at, SF))
        assert at.columns == docs.columns == stage(spark, at, SF).columns and set(map(repr, got)) <= set(map(repr, before)), name
        if name == "quality rules":
            assert got == sorted(odd_stage_rows(before, docs.columns), key=repr) and len(got) >= 3
        if name == "near-duplicates":
            ids = [r[0] for r in got]
            assert len({r[1] for r in got if r[0] is not None}) == len([i for i in ids if i is not None])
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert set(map(repr, plain(stage(spark, docs, SF)))) <= set(map(repr, plain(docs)))
        at = stage(spark, at, SF)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    enc = pieces.PieceEncoder(pieces.default_model())
    assert Counter((r.doc_id, r.n_tokens) for r in tokens) == Counter((r.doc_id, len(enc.encode(r.text or ""))) for r in docs.collect())


def test_durable_tables_can_be_cleared(spark, tmp_path):
    from folioframe.llm import common

    common.clear(spark)
    common.durable(spark.range(3))
    path = common._written[-1].removeprefix("file://")
    import os

    assert os.path.isdir(path) and common.clear(spark) == 1 and not os.path.isdir(path)


def test_queries_leave_their_result_only(spark, tmp_path):
    import os

    from folioframe.llm import common

    common.clear(spark)
    common.durable(spark.range(1))
    folder = os.path.dirname(common._written[-1].removeprefix("file://"))
    common.clear(spark)
    held = set(os.listdir(folder))
    for name in ("op2_near_duplicates", "op3_source_mix", "op5_host_rules", "op6_kd_shards", "op9_url_filter"):
        result = registry.QUERIES[name](spark, SF)
        assert result.count() > 0 and len(common._written) == 1 and len(set(os.listdir(folder)) - held) == 1
        common.clear(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from folioframe.llm import common

    on = lambda master, folder: SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {}, sparkContext=SimpleNamespace(master=master))
    assert common.shared_folder(on("spark://h:7077", "s3a://b/c/")) == "s3a://b/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(on("spark://h:7077", None))
