"""The paged document source and sink: ranges of pages, columns and page conditions, files of failed tasks."""

import json
import os
from collections import Counter

import pytest

from folioframe.sources import documents


@pytest.fixture
def books(spark, tmp_path):
    """Three documents of 1, 40 and no pages, and files that are none."""
    for name, n in (("a.json", 1), ("b.json", 40), ("c.json", 0)):
        (tmp_path / name).write_text("".join(json.dumps({"text": f"{name} ä {k}", "width": k}, ensure_ascii=False) + "\n" for k in range(n)))
    (tmp_path / "_hidden.json").write_text("{}")
    (tmp_path / "notes.txt").write_text("x")
    log = tmp_path / "log.txt"

    class Counting(documents.JsonPages):
        """Notes what it is asked for beside the documents."""

        def __init__(self, log):
            self.log = log

        def pages(self, data, first, last, columns):
            with open(self.log, "a") as f:
                f.write(json.dumps([first, last, columns]) + "\n")
            yield from super().pages(data, first, last, columns)

    spark.dataSource.register(documents.document_source("books", Counting(str(log)), "text string, width int, colour string"))
    return spark.read.format("books").option("ending", ".json"), tmp_path, log


def test_every_page_once(books):
    reader, path, _ = books
    rows = reader.load(str(path)).collect()
    assert Counter((os.path.basename(r.path), r.page_no, r.text, r.width, r.colour) for r in rows) == Counter([("a.json", 0, "a.json ä 0", 0, None), *[("b.json", k, f"b.json ä {k}", k, None) for k in range(40)]])
    assert reader.load(str(path / "a.json")).count() == 1
    with pytest.raises(Exception, match="FileNotFoundError"):
        reader.load(str(path / "none")).count()


def test_large_documents_are_cut_by_pages(books):
    reader, path, log = books
    df = reader.option("split_bytes", "300").load(str(path))
    assert df.rdd.getNumPartitions() >= 4
    assert sorted((os.path.basename(r.path), r.page_no) for r in df.collect()) == [("a.json", 0), *[("b.json", k) for k in range(40)]]
    ranges = [json.loads(x) for x in log.read_text().splitlines()]
    assert max(b - a for a, b, _ in ranges) < 20


def test_only_wanted_columns_and_pages_are_parsed(spark, books):
    reader, path, log = books
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = reader.schema("page_no int, width int").option("split_bytes", "300").option("conditions", "true").load(str(path)).filter("page_no >= 5 AND page_no < 12 AND width <> 7").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted((r.page_no, r.width) for r in got) == [(k, k) for k in range(5, 12) if k != 7]
    asked = [json.loads(x) for x in log.read_text().splitlines()]
    assert asked and all(c == ["width"] and a >= 5 and b <= 12 for a, b, c in asked)


def test_sink_and_back(spark, tmp_path):
    spark.dataSource.register(documents.document_source("paged_json", None, "text string, n bigint"))
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"Ü {k}", k if k % 3 else None) for k in range(50)], "text string, n bigint").repartition(4)
    df.write.format("paged_json").mode("append").save(out)
    back = lambda: Counter((r.text, r.n) for r in spark.read.format("paged_json").load(out).collect())
    want = Counter((r.text, r.n) for r in df.collect())
    assert back() == want and all(f.endswith(".json") for f in os.listdir(out))
    assert "Ü" in open(os.path.join(out, sorted(os.listdir(out))[0])).read()
    df.limit(0).write.format("paged_json").mode("append").save(out)
    df.filter("n = 1").write.format("paged_json").mode("append").save(out)
    assert sum(back().values()) == 51
    df.filter("n = 2").write.format("paged_json").mode("overwrite").save(out)
    assert back() == {("Ü 2", 2): 1} and len(os.listdir(out)) == 1


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(documents.document_source("paged_json", None, "text string"))
    out = str(tmp_path / "out")
    spark.createDataFrame([("kept",)], "text string").write.format("paged_json").mode("append").save(out)
    before = os.listdir(out)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("text"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="stop"):
            bad.write.format("paged_json").mode(mode).save(out)
        assert os.listdir(out) == before
