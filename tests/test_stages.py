"""Stages of cells meet without Spark joining their tasks to a few."""

from conftest import SF

from folioframe.plans import catalog


def test_stage_union_keeps_its_tasks(spark):
    """2.4 million cells were packed to 11 MB and left to two tasks; their number is now fixed."""
    df = catalog.QUERIES["stage_union"](spark, SF)
    df.collect()
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def counted(df):
    """df, and an accumulator of the rows of it that were made."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return df.mapInPandas(run, df.schema), seen


def test_stages_of_a_cascade_are_made_once(spark):
    from folioframe.plans import flows

    box = "page_id bigint, x1 int, y1 int, x2 int, y2 int"
    cells = [(p, x, y, x + 100, y + 50) for p in range(1, 4) for x in (0, 100, 600) for y in (0, 300)]
    first, seen = counted(spark.createDataFrame(cells, box))
    first = first.filter("x1 <> 987654")  # to be found in plans
    texts, read = counted(spark.createDataFrame([(p, x + 5, y + 5, x + 20, y + 20) for p, x, y, _, _ in cells], box))
    out = flows.cell_cascade({"M": first, "A": first.filter("x1 = 0")}, texts)
    assert "987654" not in out._jdf.queryExecution().optimizedPlan().toString()  # the last steps do not make the stages again
    got = out.collect()
    assert {(r.x1, r.stages) for r in got} == {(0, "A,M"), (100, "M")} and len(got) == 12
    assert seen.value == 2 * len(cells) and read.value == len(cells)


def test_outermost_cells_are_those_of_the_two_steps(spark):
    from random import Random

    from folioframe.operators import spatial

    draw = Random(7).randrange
    boxes = {(draw(2), x, y, x + draw(4) * 300, y + draw(4) * 300) for x, y in ((draw(4) * 200, draw(4) * 200) for _ in range(300))}  # points and lines too
    cells = spark.createDataFrame([(*b, k % 3 == 0) for k, b in enumerate(sorted(boxes))], "page_id bigint, x1 int, y1 int, x2 int, y2 int, morph boolean")
    want = {tuple(r) for r in spatial.without_contained(spatial.outside_protected(cells)).collect()}
    assert {tuple(r) for r in spatial.outermost(cells).collect()} == want and len(want) < len(boxes)
