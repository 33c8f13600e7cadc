"""JN-21: joins by the cells of a grid, held against every pair."""

import random

from ledgerlens.operators import grid as G

POINTS, BOXES = "k int, id int, x double, y double", "k int, box int, x1 double, y1 double, x2 double, y2 double"


def tables(seed):
    rnd = random.Random(seed)
    coordinate = lambda: rnd.choice([rnd.uniform(-30, 60), float(rnd.randint(-3, 6) * 10)])
    points = [(rnd.choice([0, 1, None]), i, coordinate() if rnd.random() > 0.05 else None, coordinate()) for i in range(400)]
    boxes = []
    for i in range(120):
        a, b, w, h = coordinate(), coordinate(), rnd.choice([0, 5, 10, 70]), rnd.choice([0, 5, 10, 70])
        boxes.append((rnd.choice([0, 1, None]), i, a, b, a + w, b - 1 if rnd.random() < 0.05 else b + h))
    return points, boxes


def test_points_in_boxes(spark):
    points, boxes = tables(1)
    want = {(p[1], b[1]) for p in points for b in boxes if p[0] is not None and p[0] == b[0] and p[2] is not None and b[2] <= p[2] <= b[4] and b[3] <= p[3] <= b[5]}
    assert len(want) > 250
    for width in (3.0, 10.0, 1000.0):
        rows = G.points_in_boxes(spark.createDataFrame(points, POINTS), spark.createDataFrame(boxes, BOXES), ["k"], width).select("id", "box").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_boxes_overlap(spark):
    _, boxes = tables(2)
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[0] is not None and a[0] == b[0] and a[3] <= a[5] and b[3] <= b[5] and max(a[2], b[2]) <= min(a[4], b[4]) and max(a[3], b[3]) <= min(a[5], b[5])}
    df = spark.createDataFrame(boxes, BOXES)
    for width in (7.0, 500.0):
        rows = G.boxes_overlap(df, df.withColumnRenamed("box", "other"), ["k"], width).select("box", "other").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_intervals(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 1]), i, s := rnd.randint(-50, 300), s + rnd.choice([0, 1, 9, 100])) for i in range(200)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and max(a[2], b[2]) < min(a[3], b[3])}
    df = spark.createDataFrame(rows, "k int, id int, start int, end int")
    for width in (4, 64, 4096):
        got = G.interval_overlaps(df, df.withColumnRenamed("id", "other"), ["k"], width).select("id", "other").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_work_follows_the_rows(spark):
    """Ten times the points and boxes, spread out: ten times the pairs that meet in a cell, not a hundred."""

    def met(n):
        points = spark.range(n).selectExpr("0 AS k", "id", "id * 10D AS x", "0D AS y")
        boxes = spark.range(n).selectExpr("0 AS k", "id AS box", "id * 10D AS x1", "-1D AS y1", "id * 10D + 4 AS x2", "1D AS y2")
        df = G.points_in_boxes(points, boxes, ["k"], 10.0)
        assert df.count() == n
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan

    plan = met(2000)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    met(20000)
