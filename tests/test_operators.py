"""Operators on hand-made rows: Han text, nulls, ties, replies, sources, sinks and streams."""

import numpy as np
from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.operators import aggregates, fitting, grouping, items, raster, sequences, spatial, tasks, tiling, translate
from folioframe.plans import flows
from folioframe.sources import readers, writers
from folioframe.streaming import arrivals

ITEM = "page_id bigint, item_id bigint, text string, x1 int, y1 int, x2 int, y2 int, confidence double, angle double, source string"


def make(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], ITEM)


def test_han_gate(spark):
    df = spark.createDataFrame([("表abc",), ("abc",), ("（）",), (None,)], "t string")
    assert [r[0] for r in df.select(t.has_script(F.col("t"))).collect()] == [True, False, False, False]


def test_strip_takes_wide_space(spark):
    df = spark.createDataFrame([("　 a b\t\n",)], "t string")
    assert df.select(t.strip(F.col("t"))).first()[0] == "a b"


def test_orientation(spark):
    rows = [("one", 0, 0, 0), ("flat", 0, 0, 0), ("flat", 1, 9, 0), ("up", 0, 5, 0), ("up", 1, 5, 9), ("edge", 0, 0, 0), ("edge", 1, 10, 15), ("slant", 0, 0, 0), ("slant", 1, 100, 10)]
    df = spark.createDataFrame([(k, o, x, y, 0) for k, o, x, y in rows], "k string, o int, x int, y int, wmode int")
    got = {r.k: (r.is_vertical, r.direction) for r in items.orientation(df, ["k"], "o").collect()}
    assert got == {"one": (False, "horizontal"), "flat": (False, "horizontal"), "up": (True, "vertical"), "edge": (False, "rotated"), "slant": (False, "rotated")}


def test_forced_vertical_keeps_direction(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, 1), ("a", 1, 9, 0, 1)], "k string, o int, x int, y int, wmode int")
    r = items.orientation(df, ["k"], "o").first()
    assert (r.is_vertical, r.direction) == (True, "horizontal")


def test_longest_first(spark):
    terms = spark.createDataFrame([(0, "螺栓", "Bolt"), (1, "地脚螺栓", "Anchor"), (2, "角钢", "Angle"), (3, "角钢", "Angle Steel")], "ord int, cn string, en string")
    df = make(spark, ("地脚螺栓和螺栓", 0, 0, 9, 9, 1.0, 0.0, "a"), ("角钢", 0, 0, 9, 9, 1.0, 0.0, "a"), (None, 0, 0, 9, 9, 1.0, 0.0, "a"))
    assert [r.translated for r in translate.replace_terms(df, terms).orderBy("item_id").collect()] == ["Anchor和Bolt", "Angle Steel", None]
    kept = translate.with_terms(df.withColumn("translated", F.lit("old")), terms, "existing").orderBy("item_id").collect()
    assert [r.translated for r in kept] == ["old", "Angle Steel", "old"]


def test_tagged_reply(spark):
    body = "[ITEM_START]\nID: 1\nSRC: a\nTRN: one\ntwo\n[ITEM_END][ITEM_START]ID: 2\nSRC: b\n[ITEM_END][ITEM_START]ID: 1 TRN: last[ITEM_END][ITEM_START]no id[ITEM_END]"
    df = spark.createDataFrame([(1, body)], "batch_no int, body string")
    assert {(r.id, r.trn) for r in translate.tagged_replies(df).collect()} == {(1, "last"), (2, None)}
    assert {(r.id, r.trn) for r in translate.tagged_replies(df, True).collect()} == {(1, "last"), (2, "b")}


def test_numbered_reply_and_loose(spark):
    df = spark.createDataFrame([(1, '1. "one"\n2、 two\n3．three\nnoise')], "batch_no int, body string")
    assert {(r.id, r.trn) for r in translate.numbered_replies(df).collect()} == {(1, "one"), (2, "two"), (3, "three")}
    sent = spark.createDataFrame([(1, i, str(i)) for i in range(1, 8)], "batch_no int, id int, text string")
    assert translate.parse_rates(sent, translate.numbered_replies(df)).first().loose
    assert translate.loose_replies(df).count() == 4


def test_translator_failures_keep_texts(spark):
    def upper(texts):
        if "bad" in texts:
            raise RuntimeError
        return [None if x == "none" else x.upper() for x in texts]

    df = spark.createDataFrame([("a",), ("none",)], "text string").coalesce(1)
    assert {tuple(r) for r in translate.translated_texts(df, upper).collect()} == {("a", "A"), ("none", "none")}
    bad = spark.createDataFrame([("bad",)], "text string")
    assert translate.translated_texts(bad, upper).first().translated == "bad"


def test_cache_policies(spark):
    old = spark.createDataFrame([("a", "1")], "text string, translated string")
    new = spark.createDataFrame([("a", "2"), ("b", "b")], "text string, translated string")
    assert {tuple(r) for r in translate.merged_cache(old, new).collect()} == {("a", "1"), ("b", "b")}
    assert {tuple(r) for r in translate.merged_cache(old, new, overwrite=True, identity=False).collect()} == {("a", "2")}


def test_identical_cells_stay(spark):
    c = spark.createDataFrame([(1, 0, 0, 50, 50, False), (1, 0, 0, 50, 50, False), (1, 5, 5, 20, 20, False)], "page_id bigint, x1 int, y1 int, x2 int, y2 int, morph boolean")
    assert spatial.without_contained(c).count() == 2


def test_best_cell_tie_goes_to_the_first(spark):
    c = spark.createDataFrame([(1, 0, 0, 100, 100), (1, 0, 0, 90, 100), (1, 600, 0, 700, 100)], "page_id bigint, x1 int, y1 int, x2 int, y2 int")
    df = make(spark, ("a", 10, 10, 50, 50, 1.0, 0.0, "a"), ("b", 400, 0, 500, 50, 1.0, 0.0, "a"))
    got = spatial.best_cell(df, c).collect()
    assert len(got) == 1 and (got[0].c_x1, got[0].c_y1) == (0, 0)


def test_overlap_meets_once_over_squares(spark):
    big = spark.createDataFrame([(1, 0, 0, 3000, 3000)], "page_id bigint, x1 int, y1 int, x2 int, y2 int")
    assert spatial.overlapping(big, big).count() == 1


def test_bounds_without_lines(spark):
    df = make(spark, ("a", 10, 10, 50, 50, 1.0, 0.0, "a"))
    none = spark.createDataFrame([], "page_id bigint, orient string, pos int")
    assert tuple(spatial.bounding_lines(df, none, 100, 80).first())[2:] == (0, 0, 100, 80)


def test_tiles(spark):
    p = spark.createDataFrame([(1, 500, 400), (2, 2200, 2200), (3, 2300, 2200)], "page_id bigint, page_w int, page_h int")
    got = {}
    for r in tiling.overlapping_tiles(p).collect():
        got.setdefault(r.page_id, set()).add((r.x, r.y, r.w, r.h))
    assert got[1] == {(0, 0, 500, 400)} and got[2] == {(0, 0, 2200, 2200)} and got[3] == {(0, 0, 2200, 2200), (100, 0, 2200, 2200)}


def test_smart_tiles_cover_the_page(spark):
    df = make(spark, ("a", 100, 100, 300, 200, 1.0, 0.0, "a"), ("b", 1200, 900, 1500, 1000, 1.0, 0.0, "a"))
    pages = spark.createDataFrame([(1,), (2,)], "page_id bigint")
    area = {r.page_id: r.a for r in tiling.smart_tiles(df, pages, 1600, 1400, 640).groupBy("page_id").agg(F.sum(F.col("w") * F.col("h")).alias("a")).collect()}
    assert area == {1: 1600 * 1400, 2: 1600 * 1400}


def test_empty_tables(spark):
    none = make(spark).limit(0)
    cells = spark.createDataFrame([], "page_id bigint, x1 int, y1 int, x2 int, y2 int, morph boolean")
    assert grouping.deduplicated(none).count() == 0
    assert grouping.merged_items(none, cells).count() == 0
    assert spatial.best_cell(none, cells).count() == 0
    assert aggregates.coverage(none.withColumn("translated", F.lit("x")), ["page_id"]).count() == 0


def test_split_and_line_boxes(spark):
    df = make(spark, ("a\nb\nc\nd", 0, 0, 10, 100, 1.0, 0.0, "a"), ("plain", 0, 0, 10, 100, 1.0, 0.0, "a"))
    lines = spark.createDataFrame([(1, "h", 50)], "page_id bigint, orient string, pos int")
    assert sorted((r.item_id, r.part, r.text) for r in grouping.split_across_cells(df, lines).collect()) == [(0, 0, "a\nb"), (0, 1, "c\nd"), (1, 0, "plain")]
    two = make(spark, ("x", 0, 0, 40, 10, 1.0, 0.0, "a"), ("y", 0, 12, 40, 22, 1.0, 0.0, "b"))
    b = grouping.merged_lines(two).withColumn("translated", F.lit("X\nY"))
    assert [(r.text, r.y1) for r in fitting.line_boxes(b).orderBy("line_no").collect()] == [("X", 0), ("Y", 12)]
    assert fitting.line_boxes(b.withColumn("translated", F.lit("XY"))).count() == 1


def test_gaps_and_runs(spark):
    df = make(spark, ("a", 200, 0, 300, 10, 1.0, 0.0, "a"), ("b", 250, 0, 400, 10, 1.0, 0.0, "a"))
    assert {(r.gap_lo, r.gap_hi) for r in sequences.free_gaps(df, ["page_id"], "x1", "x2", 1000).collect()} == {(0, 170), (430, 1000)}
    pts = spark.createDataFrame([(1, p) for p in (0, 3, 7, 20)], "page_id bigint, pos int")
    assert {r.middle for r in sequences.coordinate_runs(pts, ["page_id"], "pos").collect()} == {3, 20}


def test_measured_raster(spark):
    pixels = bytes([255] * 5000 + [0] * 5000)
    r = spark.createDataFrame([(1, 100, 100, bytearray(pixels))], "page_id bigint, width int, height int, pixels binary")
    df = make(spark, ("a", 10, 10, 40, 30, 1.0, 0.0, "a"), ("b", 10, 70, 40, 90, 1.0, 0.0, "a"))
    assert [x.mean_level for x in raster.measured(df, r).orderBy("item_id").collect()] == [255.0, 0.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"螺栓": "Bolt", "a\\"b": "c", "螺栓": "Screw"}')
    got = [tuple(r) for r in readers.terms(spark, str(tmp_path / "d.json")).orderBy("ord").collect()]
    assert got == [(0, "螺栓", "Bolt"), (1, 'a"b', "c"), (2, "螺栓", "Screw")]
    assert translate.distinct_terms(readers.terms(spark, str(tmp_path / "d.json"))).filter("cn = '螺栓'").first().en == "Screw"
    (tmp_path / "c.json").write_text('{"a": "b"}')
    assert readers.cache(spark, str(tmp_path / "c.json")).first().translated == "b"
    (tmp_path / "x.pdf").write_bytes(b"12")
    pages = readers.rendered(readers.files(spark, str(tmp_path)), lambda c: iter([(0, 2, 1, c)]))
    assert pages.first().pixels == b"12"
    df = spark.createDataFrame([("表", None)], "text string, translated string")
    writers.to_mapping(df, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"表":"表"}'
    writers.to_json(df, str(tmp_path / "j"))
    writers.to_table(df, str(tmp_path / "t"), ["text"])
    writers.to_text(spark.createDataFrame([(1, "b"), (0, "a")], "line_no int, line string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_engines_that_fail_are_left_out(spark):
    tiles = spark.createDataFrame([(1, 10, 20, 5, 5, bytearray(b"x"))], "page_id bigint, x int, y int, w int, h int, pixels binary")

    def broken():
        raise ImportError

    got = readers.recognised(tiles, {"a": lambda: lambda p, w, h: [("t", 1, 2, 3, 4, 0.0, 0.9)], "b": broken, "c": lambda: lambda p, w, h: 1 / 0}).collect()
    assert [(r.source, r.x1, r.y1) for r in got] == [("a", 11, 22)]


def test_tasks(spark):
    rows = spark.createDataFrame([("a", "processing", 1), ("a", "completed", 2), ("a", "processing", 3), ("b", "uploaded", 1)], "task_id string, status string, ts int")
    assert {(r.task_id, r.status) for r in tasks.latest_states(rows).collect()} == {("a", "completed"), ("b", "uploaded")}
    assert tasks.without_task(rows, "a").count() == 1


def test_stream_of_files(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1)], "task_id string, n int").write.parquet(src)
    stream = arrivals.arriving(spark, src, "task_id string, n int")
    for _ in range(2):
        arrivals.run_once(stream, lambda b: b.withColumn("n", F.col("n") + 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' ts, 'a' event_type UNION ALL SELECT TIMESTAMP '2024-01-01 03:10:00', 'a'").write.parquet(src)
    q = arrivals.window_counts(arrivals.arriving(spark, src, "ts timestamp, event_type string")).writeStream.format("memory").queryName("wc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wc").first().n == 1


def test_bar_stops_a_chain(spark):
    image = np.full((100, 100), 255, np.uint8)
    image[25] = 0
    r = spark.createDataFrame([(1, 100, 100, bytearray(image.tobytes()))], "page_id bigint, width int, height int, pixels binary")
    df = make(spark, ("a", 10, 0, 60, 20, 1.0, 0.0, "a"), ("b", 10, 30, 60, 50, 1.0, 0.0, "a"))
    assert grouping.chained_on_rasters(df, r).select("chain").distinct().count() == 2
    assert grouping.chained_on_rasters(df, r.limit(0)).select("chain").distinct().count() == 1


def test_engine_results_as_mappings():
    class Has:
        def __init__(self, json):
            self.json = json

    assert [readers.as_mapping(x) for x in ({"a": 1}, Has({"a": 1}), Has(lambda: {"a": 1}), Has(3), 4)] == [{"a": 1}] * 3 + [{}, {}]


def test_cascade_and_flow(spark):
    cells = spark.createDataFrame([(1, 0, 0, 100, 60), (1, 100, 0, 200, 60), (1, 10, 10, 60, 50), (1, 800, 700, 900, 760)], "page_id bigint, x1 int, y1 int, x2 int, y2 int")
    df = make(spark, ("螺栓", 10, 10, 90, 30, 0.9, 0.0, "a"), ("螺栓", 12, 10, 90, 30, 0.5, 0.0, "b"), ("钢", 110, 10, 190, 30, 0.9, 0.0, "a"), ("plain", 10, 200, 90, 220, 0.9, 0.0, "a"))
    got = flows.cell_cascade({"A": cells.filter("x1 <> 10"), "B": cells.filter("x1 = 10")}, df).orderBy("cell_no").collect()
    assert [(r.x1, r.cell_id, r.stages) for r in got] == [(0, "Cell_001", "A"), (100, "Cell_002", "A")]
    terms = spark.createDataFrame([(0, "螺栓", "Bolt")], "ord int, cn string, en string")
    cache = spark.createDataFrame([("钢", "Steel")], "text string, translated string")
    placed = flows.unified_flow(df, terms, cache, lambda x: [y.upper() for y in x]).collect()
    assert {r.text for r in placed} == {"Bolt", "Steel"}


def test_batches_follow_the_order_of_numbers_and_of_equal_rows(spark):
    numbers = [1, 2, 9, 10, 11, 100, 7, 55, 1000, 3]
    df = spark.createDataFrame([(n, "same") for n in numbers], "n int, text string").repartition(4)
    got = {r.n: (r.id, r.batch_no) for r in translate.batches(df, ["n"], 4).collect()}
    assert got == {n: (k, (k - 1) // 4 + 1) for k, n in enumerate(sorted(numbers), 1)}
    one = translate.batches(df.withColumn("n", (df.n > 8).cast("int")), ["text"], 3)
    assert sorted(r.id for r in one.collect()) == list(range(1, 11))
    nulls = spark.createDataFrame([(None, "a"), (2, "b"), (None, "c"), (1, "d")], "n int, text string")
    assert [r.text for r in translate.batches(nulls, ["n", "text"]).orderBy("id").collect()] == ["a", "c", "d", "b"]
    assert translate.batches(df.limit(0), ["n"]).count() == 0


def test_nearest_cells_far_away(spark):
    """Items and cells thrown over pages of very different sizes, against all pairs; no join on the page alone."""
    import random

    draw = random.Random(3)
    def boxes(n, size):
        return [(x, y, x + draw.randrange(1, 40), y + draw.randrange(1, 40)) for x, y in ((draw.randrange(-size, size), draw.randrange(size)) for _ in range(n))]

    pages = {1: (30, 40, 300), 2: (30, 5, 20_000), 3: (20, 2, 1_000_000), 4: (5, 0, 100)}
    items = {p: boxes(n, size) for p, (n, _, size) in pages.items()}
    cells = {p: boxes(n, size) for p, (_, n, size) in pages.items()}
    i = spark.createDataFrame([(p, k, *b) for p, bs in items.items() for k, b in enumerate(bs)] + [(None, 1, 0, 0, 1, 1), (1, 99, None, 0, 1, 1)], "page_id bigint, item_id bigint, x1 int, y1 int, x2 int, y2 int")
    c = spark.createDataFrame([(p, *b) for p, bs in cells.items() for b in bs], "page_id bigint, x1 int, y1 int, x2 int, y2 int")
    gap = lambda a, b: max(0, b[0] - a[2], a[0] - b[2], b[1] - a[3], a[1] - b[3])
    want = {(p, k): min(gap(b, x) for x in cells[p]) for p, bs in items.items() for k, b in enumerate(bs) if cells[p]}
    out = spatial.nearest_cell_gap(i, c)
    got = {(r.page_id, r.item_id): r.gap for r in out.collect() if (r.page_id, r.item_id) != (1, 99)}
    assert got == want and max(want.values()) > 100_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "gx" in plan and "Cartesian" not in plan and "Join Inner, (page_id#" not in plan
    assert spatial.nearest_cell_gap(i.limit(0), c.limit(0)).count() == 0


def test_anchors_of_many_positions(spark):
    """A page of twenty thousand positions in runs, nulls and repeats, against the rule one by one."""
    import random

    draw = random.Random(8)
    rows = [(1, "h", draw.randrange(400_000)) for _ in range(20_000)] + [(2, "v", k) for k in range(40)] * 2 + [(2, "h", 7), (2, "h", None), (3, None, 4)]
    want = set()
    for key in {r[:2] for r in rows}:
        anchor = None
        for p in sorted({r[2] for r in rows if r[:2] == key and r[2] is not None}):
            anchor = p if anchor is None or p - anchor > 5 else anchor
            want.add((*key, p, anchor))
    got = [tuple(r) for r in grouping.anchored_lines(spark.createDataFrame(rows, "page_id bigint, orient string, pos int")).collect()]
    assert set(got) == want and len(got) == len(want)
