"""Golden facts and randomised checks of the region algebra and interval operators."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import regions as R
from strandloom.operators import coverage as V
from strandloom.operators import interval as I


def one(spark, expr, a, b):
    df = spark.createDataFrame([(*a, *b)], "ab long, ae long, bb long, be long")
    return df.select(expr(R.Region(F.col("ab"), F.col("ae")), R.Region(F.col("bb"), F.col("be")))).first()[0]


@pytest.mark.parametrize("a, b, want", [((0, 0), (0, 1), True), ((0, 0), (1, 1), False), ((0, 1), (1, 1), True), ((0, 2), (2, 2), True),
                                        ((0, 0), (2, 2), False), ((0, 1), (1, 2), False), ((0, 2), (1, 3), True)])
def test_overlaps(spark, a, b, want):
    assert one(spark, R.overlaps, a, b) is want


@pytest.mark.parametrize("a, b, want", [((0, 1), (1, 1), True), ((1, 1), (0, 1), False), ((0, 3), (1, 2), True)])
def test_contains(spark, a, b, want):
    assert one(spark, R.contains, a, b) is want


def test_backward_region_is_an_error(spark):
    with pytest.raises(Exception, match="begin is after end"):
        one(spark, lambda a, b: R.checked(a), (1, 0), (0, 0))


def intervals(seed, n, span=200, longest=15):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        b = rng.randrange(span)
        out.append((i, rng.choice("xy"), b, b + rng.choice([0, 0, 1, rng.randrange(longest)])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, contig string, start_pos long, end_pos long")


def meets(a, b):
    n = min(a[3], b[3]) - max(a[2], b[2])
    return a[1] == b[1] and (n > 0 or n == 0 and (a[2] == a[3] or b[2] == b[3]))


@pytest.mark.parametrize("width", [1, 4, 7, 64])
def test_interval_join_is_complete_and_emits_once(spark, width):
    xs, ys = intervals(1, 120), intervals(2, 120)
    got = sorted(map(tuple, I.interval_join(frame(spark, xs), frame(spark, ys), width=width).select("l.id", "r.id").collect()))
    assert got == sorted((a[0], b[0]) for a in xs for b in ys if meets(a, b))


def test_semi_anti_and_counts(spark):
    xs, ys = intervals(3, 80), intervals(4, 30)
    left, right = frame(spark, xs), frame(spark, ys)
    n = {r.id: r.n for r in I.count_overlapped(left, right).collect()}
    assert n == {a[0]: sum(meets(a, b) for b in ys) for a in xs}
    assert {r.id for r in I.copy_overlapped(left, right).collect()} == {i for i, k in n.items() if k}
    assert {r.id for r in I.copy_nonoverlapped(left, right).collect()} == {i for i, k in n.items() if not k}


@pytest.mark.parametrize("tile", [16, 1 << 16])
def test_covered_regions(spark, tile):
    xs = intervals(5, 60)
    want = []
    for c in "xy":
        end = None
        for _, _, b, e in sorted((r for r in xs if r[1] == c), key=lambda r: (r[2], r[3])):
            if end is None or b > end:
                want.append([c, b, e])
                end = e
            else:
                end = want[-1][2] = max(end, e)
    got = I.covered_regions(frame(spark, xs), tile=tile).select("contig", "start_pos", "end_pos").collect()
    assert sorted(map(list, got)) == sorted(want)


def test_depth_runs_sum_to_the_read_lengths(spark):
    xs = intervals(6, 100)
    runs = V.depth_runs(frame(spark, xs)).collect()
    assert sum(r.depth * (r.end_pos - r.start_pos) for r in runs) == sum(e - b for _, _, b, e in xs)


def test_subtract(spark):
    xs, ys = intervals(7, 20), intervals(8, 20)
    pos = lambda rows, c: {p for r in rows if r[1] == c for p in range(r[2], r[3])}
    got = I.subtract(frame(spark, xs), frame(spark, ys)).collect()
    for c in "xy":
        assert {p for r in got if r.contig == c for p in range(r.start_pos, r.end_pos)} == pos(xs, c) - pos(ys, c)


def test_first_after(spark):
    xs, ys = intervals(9, 60), intervals(10, 25)
    got = {r.id: r.b for r in I.first_after(frame(spark, xs), frame(spark, ys), {"b": F.col("start_pos")}, tile=16).collect()}
    assert got == {a[0]: min((y[2] for y in ys if y[1] == a[1] and y[2] >= a[3]), default=None) for a in xs}
