"""Run algebra against plain sets of cells."""

import random

import pytest
from pyspark.sql import functions as F

from roomtable.operators import evaluation as E
from roomtable.operators import masks as M
from roomtable.operators import regions as R

KEYS = ["photo_id", "width", "height"]
W, H = 12, 9


def masks():
    """Random, empty, full, one row, frame-touching, winding."""
    rng = random.Random(5)
    every = {(y, x) for y in range(H) for x in range(W)}
    snake = {(y, x) for y in range(0, H, 2) for x in range(W)}
    snake |= {(y, W - 1 if y % 4 == 1 else 0) for y in range(1, H, 2)}
    found = {i: {c for c in every if rng.random() < p} for i, p in enumerate((0.2, 0.5, 0.8, 0.45))}
    found.update({10: set(), 11: every, 12: {(4, x) for x in range(3, 9)}, 13: {(0, 0), (H - 1, W - 1)}, 14: snake})
    return found


MASKS = masks()


def cells_of(spark, wanted):
    rows = [(i, W, H, y, x) for i, cells in wanted.items() for y, x in cells]
    return spark.createDataFrame(rows, "photo_id long, width long, height long, y long, x long")


def frames(spark):
    return spark.createDataFrame([(i, W, H) for i in MASKS], "photo_id long, width long, height long")


def back(runs):
    out = {i: set() for i in MASKS}
    for r in M.runs_to_cells(runs.select(*KEYS, "y", "x0", "x1")).collect():
        cell = (r["y"], r["x"])
        assert cell not in out[r["photo_id"]], "runs overlap"
        out[r["photo_id"]].add(cell)
    return out


@pytest.fixture(scope="module")
def runs(spark):
    return M.cells_to_runs(cells_of(spark, MASKS), KEYS).cache()


def shifted(cells, kernel):
    return {
        (y + dy, x + dx)
        for y, x in cells
        for dy, hw in kernel
        for dx in range(-hw, hw + 1)
        if 0 <= y + dy < H and 0 <= x + dx < W
    }


def eaten(cells, kernel, outside):
    inside = lambda y, x: (y, x) in cells if 0 <= y < H and 0 <= x < W else outside
    return {
        (y, x)
        for y in range(H)
        for x in range(W)
        if all(inside(y + dy, x + dx) for dy, hw in kernel for dx in range(-hw, hw + 1))
    }


def test_round_trip(runs):
    assert back(runs) == MASKS


def test_scanline_runs_equal_cell_runs(spark, runs):
    lines = [
        (i, W, H, y, [1.0 if (y, x) in cells else 0.0 for x in range(W)])
        for i, cells in MASKS.items()
        for y in range(H)
    ]
    df = spark.createDataFrame(lines, "photo_id long, width long, height long, y long, line array<double>")
    found = M.lines_to_runs(df, KEYS, "line", {"m": lambda v: v > 0.5})
    assert back(found) == MASKS


def test_set_operations(spark, runs):
    other = {i: MASKS[1] for i in MASKS}
    second = M.cells_to_runs(cells_of(spark, other), KEYS)
    for op, test in {
        "and": lambda a, b: a & b,
        "or": lambda a, b: a | b,
        "xor": lambda a, b: a ^ b,
        "minus": lambda a, b: a - b,
    }.items():
        assert back(M.set_op(runs, second, KEYS, op)) == {i: test(MASKS[i], other[i]) for i in MASKS}
    every = MASKS[11]
    assert back(M.complement(runs, frames(spark), KEYS)) == {i: every - c for i, c in MASKS.items()}


@pytest.mark.parametrize("kernel", [M.disc(1), M.disc(2), M.square(1), M.disc(4)], ids=str)
def test_morphology(runs, kernel):
    assert back(M.dilate(runs, KEYS, kernel)) == {i: shifted(c, kernel) for i, c in MASKS.items()}
    for outside in (False, True):
        found = back(M.erode(runs, KEYS, kernel, outside))
        # a mask without any run has no rows to start from
        assert found == {i: eaten(c, kernel, outside) if c else set() for i, c in MASKS.items()}


def test_disc_half_widths():
    assert [hw for _, hw in M.disc(2)] == [0, 2, 2, 2, 0]


def test_inner_boundary(runs):
    wanted = {i: c - eaten(c, M.square(1), False) for i, c in MASKS.items()}
    assert back(M.inner_boundary(runs, KEYS)) == wanted


def flood(cells, eight):
    left, parts = set(cells), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    near = (y + dy, x + dx)
                    if near in left and (eight or abs(dy) + abs(dx) == 1):
                        left.discard(near)
                        todo.append(near)
        parts.append(len(part))
    return sorted(parts)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(runs, connectivity):
    facts = R.part_facts(R.components(runs, KEYS, connectivity), KEYS).collect()
    for i, cells in MASKS.items():
        assert sorted(r["pixels"] for r in facts if r["photo_id"] == i) == flood(cells, connectivity == 8)


def test_long_winding_mask_settles(spark):
    """A spiral-like comb of 400 rows is one part and needs few rounds."""
    rows = [(1, 8, 400, y, 0, 7) for y in range(0, 400, 2)]
    rows += [(1, 8, 400, y, 7 if y % 4 == 1 else 0, 7 if y % 4 == 1 else 0) for y in range(1, 399, 2)]
    df = spark.createDataFrame(rows, "photo_id long, width long, height long, y long, x0 long, x1 long")
    assert R.components(df, KEYS, 4).select("part").distinct().count() == 1


def rectangle(photo, y0, y1, x0=0, x1=59, w=60, h=40, side="t"):
    return [(photo, w, h, side, y, x0, x1) for y in range(y0, y1)]


SCHEMA = "photo_id long, width long, height long, side string, y long, x0 long, x1 long"


def scores(spark, rows, photos, fractions=(0.005,), w=60, h=40):
    tagged = spark.createDataFrame(rows, SCHEMA)
    sizes = spark.createDataFrame([(p, w, h) for p in photos], "photo_id long, width long, height long")
    area = {r["photo_id"]: r for r in E.mask_metrics(tagged, sizes, KEYS).collect()}
    edge = {(r["photo_id"], r["tolerance"]): r for r in E.boundary_metrics(tagged, sizes, KEYS, fractions).collect()}
    return area, edge


def test_metrics_by_hand(spark):
    rows = rectangle(1, 20, 40) + rectangle(1, 20, 40, side="p")
    rows += rectangle(2, 20, 40) + rectangle(2, 10, 40, side="p")
    rows += rectangle(3, 20, 40)
    rows += rectangle(5, 20, 40) + rectangle(5, 10, 40, side="p") + rectangle(5, 10, 20, side="i")
    area, edge = scores(spark, rows, range(1, 6))
    assert area[1]["iou"] == 1.0 and edge[1, 0.005]["f1"] == 1.0
    assert area[2]["iou"] == round(20 / 30, 6) and area[2]["recall"] == 1.0
    # nothing predicted: precision unknown, recall 0; nothing at all: all unknown
    assert area[3]["precision"] is None and area[3]["recall"] == 0.0 and area[3]["iou"] == 0.0
    assert area[4]["iou"] is None and area[4]["dice"] is None and edge[4, 0.005]["f1"] is None
    assert area[5]["iou"] == 1.0 and area[5]["ignored_fraction"] == 0.25


def test_enlarging_ignored_zone_never_penalises_a_match(spark):
    rows = []
    for photo, top in enumerate((40, 30, 20, 10)):
        rows += rectangle(photo, 20, 40) + rectangle(photo, 18, 40, side="p")
        rows += rectangle(photo, 0, 40, 0, 59 - top, side="i")
    area, edge = scores(spark, rows, range(4), (0.02, 0.05))
    for fraction in (0.02, 0.05):
        found = [edge[p, fraction]["f1"] for p in range(4)]
        assert found == sorted(found)
    assert [area[p]["ignored_fraction"] for p in range(4)] == sorted(area[p]["ignored_fraction"] for p in range(4))


def test_agreement_grows_with_tolerance(spark):
    rows = rectangle(1, 20, 40) + rectangle(1, 16, 40, side="p")
    _, edge = scores(spark, rows, [1], (0.01, 0.03, 0.08))
    found = [edge[1, f]["f1"] for f in (0.01, 0.03, 0.08)]
    assert found == sorted(found) and found[0] < found[-1]


def test_boundary_inside_uncertain_zone_still_matches(spark):
    """The truth boundary runs in an ignored zone; the prediction one pixel off is right."""
    rows = rectangle(1, 20, 40) + rectangle(1, 19, 40, side="p") + rectangle(1, 20, 21, side="i")
    _, edge = scores(spark, rows, [1])
    assert edge[1, 0.005]["precision"] == 1.0


def test_registry_of_candidates_refuses_doubles(spark):
    known = E.CandidateSet()
    known.register("full")(lambda f: M.frame_runs(f, KEYS))
    with pytest.raises(ValueError):
        known.register("full")(lambda f: f)
    with pytest.raises(KeyError):
        known.runs(frames(spark), ["nope"])
    assert known.runs(frames(spark)).where(F.col("candidate") == "full").count() == H * len(MASKS)


def test_polygon_fill_includes_its_outline(spark):
    square = [{"x": 0.25, "y": 0.25}, {"x": 0.75, "y": 0.25}, {"x": 0.75, "y": 0.75}, {"x": 0.25, "y": 0.75}]
    over = [{"x": -1.0, "y": 0.5}, {"x": 2.0, "y": 0.5}, {"x": 2.0, "y": 3.0}, {"x": -1.0, "y": 3.0}]
    df = spark.createDataFrame(
        [(1, 9, 9, 0, False, square), (2, 9, 9, 0, False, over)],
        "photo_id long, width long, height long, shape_id int, hole boolean, points array<struct<x:double,y:double>>",
    )
    found = {
        r["photo_id"]: r["n"]
        for r in M.rasterise(df, KEYS).groupBy("photo_id").agg(M.area().alias("n")).collect()
    }
    assert found == {1: 25, 2: 45}
