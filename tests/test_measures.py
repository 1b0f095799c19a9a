"""Image, lens, perspective and source operators on small known cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtable.functions import draws
from roomtable.operators import evaluation as E
from roomtable.operators import governance as G
from roomtable.operators import image as I
from roomtable.operators import kernels as K
from roomtable.operators import lens as L
from roomtable.operators import masks as M
from roomtable.operators import perspective as P
from roomtable.operators import regions as R
from roomtable.operators import scenes as S
from roomtable.sources import annotations as A
from roomtable.sources import manifest as MF
from roomtable.sources import reports

KEYS = ["photo_id", "width", "height"]


def lines(spark, image, photo=1):
    h, w = image.shape
    rows = [(photo, w, h, y, [float(v) for v in image[y]]) for y in range(h)]
    return spark.createDataFrame(rows, "photo_id long, width long, height long, y long, line array<double>")


def mirrored(image, kernel):
    k = kernel.shape[0] // 2
    padded = np.pad(image, k, mode="reflect")
    h, w = image.shape
    return sum(
        kernel[i, j] * padded[i : i + h, j : j + w] for i in range(2 * k + 1) for j in range(2 * k + 1)
    )


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(4).random((150, 40))


def test_stencils_cross_block_borders(spark, picture):
    """150 rows are three blocks; the halo makes them agree with the whole image."""
    soft = np.outer((1, 2, 1), (1, 2, 1)) / 16
    smooth = mirrored(picture, soft)
    gx = mirrored(smooth, np.outer((1, 2, 1), (-1, 0, 1)))
    gy = mirrored(smooth, np.outer((-1, 0, 1), (1, 2, 1)))
    found = I.gradient_facts(lines(spark, picture), KEYS).first()
    assert found["strong_gradient_ratio"] == pytest.approx((np.hypot(gx, gy) > 0.08).mean(), abs=1e-6)
    lap = mirrored(np.floor(picture * 255), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]]))
    assert I.laplacian_variance(lines(spark, picture), KEYS).first()["laplacian_variance"] == pytest.approx(
        lap.var(), abs=1e-2
    )


def test_separable_equals_direct(spark, picture):
    kernel = I.gaussian_kernel(1.3, 4)
    wanted = mirrored(picture, np.outer(kernel, kernel))
    found = I.separable(lines(spark, picture), KEYS, kernel, kernel).orderBy("y").collect()
    assert np.allclose([r["line"] for r in found], wanted)


def test_blur_lowers_sharpness_and_flat_is_null(spark, picture):
    step = np.where(np.arange(64)[None, :] < 31, 0.2, 0.8) * np.ones((64, 1))
    sharp = I.blur_reading(lines(spark, step), KEYS).first()
    soft = I.blur_reading(I.augment_blur(lines(spark, step), KEYS, 2.5), KEYS).first()
    assert soft["reblur_ratio"] < sharp["reblur_ratio"] or soft["edge_width_px"] > sharp["edge_width_px"]
    assert soft["edge_width_px"] > sharp["edge_width_px"]
    flat = I.blur_reading(lines(spark, np.full((64, 64), 0.5)), KEYS).first()
    assert flat["reblur_ratio"] is None and flat["edge_width_px"] is None and flat["edge_count"] == 0


def test_exposure_by_hand(spark):
    row = I.exposure_profile(lines(spark, np.array([[0.0, 1.0], [0.5, 0.5]])), KEYS).first()
    assert row["luma_mean"] == 0.5 and row["luma_median"] == 0.5
    assert row["clipped_high_ratio"] == 0.25 and row["clipped_low_ratio"] == 0.25


def test_small_images_get_no_verdict(spark):
    rows = [(0.1, 500.0, 0.1, 3.0, 1024), (0.1, 500.0, 0.1, 3.0, 800), (0.001, 1.0, 0.9, 30.0, 1024), (0.1, 1.0, 0.4, 3.0, 1024)]
    df = spark.createDataFrame(
        rows, "strong_gradient_ratio double, laplacian_variance double, reblur_ratio double, edge_width_normalized double, working_side int"
    )
    assert [r["sharp"] for r in I.classify_sharpness(df).collect()] == [True, None, None, None]


def bent(k1, photo):
    """Straight lines seen through distortion k1, as tracks in a 401 x 301 frame."""
    w, h, rows = 401, 301, []
    cx, cy = (w - 1) / 2, (h - 1) / 2
    for number, x in enumerate((40.0, 90.0, 310.0, 360.0)):
        for y in range(20, 281):
            px, py = x - cx, y - cy
            qx, qy = px, py
            for _ in range(40):
                r2 = (qx * qx + qy * qy) / (cx * cx + cy * cy)
                qx, qy = px / (1 + k1 * r2), py / (1 + k1 * r2)
            rows.append((photo, number, "vertical", float(qy + cy), float(qx + cx), 0.3, w, h))
    return rows


def test_known_distortion_is_recovered(spark):
    truth = {1: 0.1, 2: -0.15, 3: 0.0}
    rows = [r for photo, k1 in truth.items() for r in bent(k1, photo)]
    points = spark.createDataFrame(
        rows, "photo_id long, track_id int, orientation string, scan double, across double, grad double, width int, height int"
    )
    report = {r["photo_id"]: r for r in L.lens_report(L.track_fit(points)).collect()}
    for photo, k1 in truth.items():
        assert report[photo]["k1"] == pytest.approx(k1, abs=0.011)
    assert report[1]["lens_verdict"] == "distortion_suspected" and report[1]["suspected_sign"] == "barrel"
    assert report[2]["suspected_sign"] == "pincushion"
    assert report[3]["lens_verdict"] == "no_distortion_evidence"


def test_no_usable_track_agrees_on_nothing(spark):
    rows = [(1, 0, "vertical", float(s), 200.0, 0.3, 401, 301) for s in range(100)]
    points = spark.createDataFrame(
        rows, "photo_id long, track_id int, orientation string, scan double, across double, grad double, width int, height int"
    )
    row = L.lens_report(L.track_fit(points)).first()
    assert row["sign_agreement"] == 0.0 and row["lens_verdict"] == "undetermined" and row["k1"] is None


def fan(vx, vy, photo, n, start):
    rows = []
    for i in range(n):
        angle = math.radians(15 + i * 150 / n)
        dx, dy = math.cos(angle), math.sin(angle)
        rows.append((photo, start + i, vx + 150 * dx, vy + 150 * dy, vx + 420 * dx, vy + 420 * dy))
    return rows


def test_two_vanishing_points_are_found(spark):
    rows = fan(200.0, 400.0, 1, 9, 0) + fan(820.0, 400.0, 1, 7, 50)
    segments = spark.createDataFrame(rows, "photo_id long, seg_id long, x0 double, y0 double, x1 double, y1 double")
    found = P.vanishing_points(segments, 1000, 1000).orderBy("rank").collect()
    assert [(round(r["x"]), round(r["y"])) for r in found[:2]] == [(200, 400), (820, 400)]
    photos = spark.createDataFrame([(1, None)], "photo_id long, ceiling double")
    horizon = P.horizon_estimate(photos, P.vanishing_points(segments, 1000, 1000), 1000, 1000).first()
    assert horizon["horizon_source"] == "lines-2vp" and horizon["horizon"] == pytest.approx(0.4, abs=1e-6)


def test_many_segments_are_drawn_not_enumerated(spark):
    """80 segments have 3160 pairs; 600 draws still find the point most lines share."""
    rows = fan(500.0, 300.0, 1, 60, 0) + [
        (1, 100 + i, 10.0 * i, 900.0, 10.0 * i + 90, 900.0 + (i * 37) % 60) for i in range(20)
    ]
    segments = spark.createDataFrame(rows, "photo_id long, seg_id long, x0 double, y0 double, x1 double, y1 double")
    best = P.vanishing_points(segments, 1000, 1000).where("rank = 1").first()
    assert (round(best["x"]), round(best["y"])) == (500, 300)


def test_rails_meet_where_the_floor_points(spark):
    rows = []
    for y in range(150, 300):
        half = (y - 90) * 0.6
        rows.append((1, 400, 300, y, int(200 - half), int(200 + half)))
    runs = spark.createDataFrame(rows, "photo_id long, width long, height long, y long, x0 long, x1 long")
    found = P.floor_rails(runs, P.floor_extent(runs)).first()
    assert found["rail_x"] == pytest.approx(200, abs=2) and found["rail_y"] == pytest.approx(90, abs=3)


def test_scoring_condemns_over_and_under_detection(spark):
    rows = [(1, "expected", "image_blurry"), (2, "detected", "image_blurry"), (3, "expected", "image_blurry"),
            (3, "detected", "image_blurry"), (3, "detected", "lens_analysis_undetermined")]
    emission = spark.createDataFrame(rows, "photo_id long, side string, code string")
    images = spark.createDataFrame([(i, i != 4) for i in range(1, 5)], "photo_id long, graded boolean")
    found = {r["label"]: r for r in E.confusion_totals(E.score_images(emission, images, "photo_id"), "photo_id").collect()}
    assert set(found) == {"overall", "image_blurry"}
    top = found["overall"]
    assert (top["tp"], top["fp"], top["fn"], top["tn"]) == (1, 1, 1, 24)
    assert top["images"] == 3 and top["perfect_images"] == 1 and top["undetermined_lens"] == 1
    assert found["image_blurry"]["detected_of_expected"] == 0.5


def test_manifest_files_round_trip(spark, tmp_path):
    photo = {
        "id": "a", "file": "public/a.jpg", "difficulty": "hard", "traits": ["rug"],
        "provenance": {"source": "s", "license": "CC0", "redistributable": True, "usage": "redistributable"},
        "groundTruth": {"lens": {"k1": 0.1, "provenance": "measured"}},
    }
    (tmp_path / "manifest.json").write_text(json.dumps({"schema": "x@2", "photos": [photo]}, indent=1))
    found = MF.read_manifest(spark, str(tmp_path / "manifest.json")).first()
    assert found["photo_id"] == "a" and found["split"] == "pilot_development" and found["truth_k1"] == 0.1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        MF.read_manifest(spark, str(tmp_path / "none.json"))
    photos = MF.read_manifest(spark, str(tmp_path / "manifest.json"))
    MF.export_manifest(photos, str(tmp_path / "out"))
    again = MF.parse_photo_lines(spark.read.text(str(tmp_path / "out"))).first()
    assert again["license"] == "CC0" and again["redistributable"] is True


def test_annotation_folder_and_digests(spark, tmp_path):
    for name, status in (("b.json", "draft"), ("a.json", "approved")):
        (tmp_path / name).write_text(json.dumps({"photoId": name[0], "status": status, "timing": {"firstPassSeconds": 3}}))
    rows = A.read_annotations(spark, str(tmp_path)).collect()
    assert [r["photo_id"] for r in rows] == ["a", "b"] and rows[0]["review_seconds"] == 0.0
    import hashlib

    found = {r["file"][-6:]: r["digest"] for r in A.content_hash(spark, str(tmp_path), "*.json").collect()}
    assert found["a.json"] == hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()


def test_report_has_its_columns(spark, tmp_path):
    rows = spark.createDataFrame([("p", True)], "id string, blur_sharp boolean")
    reports.write_report(rows, str(tmp_path / "r"))
    header = spark.read.option("header", True).csv(str(tmp_path / "r" / "csv")).columns
    assert len(header) == 41 and header == [n for n, _ in reports.REPORT_COLUMNS]
    assert spark.read.json(str(tmp_path / "r" / "json")).count() == 1


def test_refused_image_misses_everything_it_was_expected_to_show(spark):
    scored = spark.createDataFrame(
        [(1, "easy", True, ["image_blurry"], ["image_blurry"], [], [], [])],
        "photo_id long, difficulty string, graded boolean, expected array<string>, detected array<string>, "
        "informational array<string>, false_positives array<string>, false_negatives array<string>",
    )
    refused = spark.createDataFrame([(1, "too_big")], "photo_id long, code string")
    row = S.flatten_results(scored, refused).first()
    assert row["status"] == "refused:too_big" and row["false_negatives"] == "image_blurry" and row["detected"] == ""


def test_unlabelled_pass_comes_first(spark):
    df = spark.createDataFrame(
        [(1, "B"), (1, "A"), (2, "C"), (2, None)], "photo_id long, pass_label string"
    )
    found = {r["photo_id"]: r["pass_label"] for r in G.primary_pass(df).collect()}
    assert found == {1: "A", 2: None}


def test_noise_does_not_depend_on_partitions(spark):
    cells = spark.range(400).select(
        F.lit(1).cast("bigint").alias("photo_id"), (F.col("id") / 20).cast("bigint").alias("y"), (F.col("id") % 20).alias("x"), F.lit(0.5).alias("luma")
    )
    a = I.augment_noise(cells.repartition(7), 8.0, 3).orderBy("y", "x").collect()
    b = I.augment_noise(cells.coalesce(1), 8.0, 3).orderBy("y", "x").collect()
    assert a == b
    values = [r["luma"] * 255 for r in a]
    assert 6 < float(np.std(values)) < 10


@pytest.mark.parametrize("height", range(1, 10))
def test_mirror_reaches_beyond_small_frames(spark, height):
    reach, width = 8, 3
    lines = spark.createDataFrame([(1, y, height, width, [float(y * 10 + x) for x in range(width)]) for y in range(height)], "photo_id long, y long, height long, width long, line array<double>")
    seen = K.by_blocks(lines, ["photo_id", "width", "height"], reach, lambda b: {"y": range(-reach, len(b.y) + reach), "v": b.around(b.rows, reach)[:, reach]}, {"y": "long", "v": "double"})
    rows = seen.collect()
    turn = max(2 * (height - 1), 1)
    want = {v: min(v % turn, turn - v % turn) * 10.0 for v in range(-reach, height + reach)}
    assert {r["y"]: r["v"] for r in rows} == want


def plain_widths(row):
    found = []
    for p in range(1, len(row) - 1):
        if row[p] > row[p - 1] and row[p] >= row[p + 1]:
            a = b = p
            while a > 0 and row[a - 1] < row[a]:
                a -= 1
            while b < len(row) - 1 and row[b + 1] < row[b]:
                b += 1
            w = min(b, p + 60) - max(a, p - 60) + 1
            if w < 60:
                found.append((row[p], w))
    return found


def test_kernels_equal_plain_loops():
    rng = np.random.default_rng(9)
    for shape in ((1, 1), (2, 5), (7, 4), (40, 90)):
        values = rng.integers(0, 256, shape)
        near = np.pad(values, 1, mode="edge")
        plain = [[int(np.median(near[i : i + 3, j : j + 3])) for j in range(shape[1])] for i in range(shape[0])]
        assert K.median3(values).tolist() == plain
        mags, widths, counts = K.peak_widths(values // 16, 60)
        pairs = sorted((int(m), int(w)) for m, w, n in zip(mags, widths, counts, strict=True) for _ in range(n))
        assert pairs == sorted(x for row in (values // 16).tolist() for x in plain_widths(row))


def test_quantiles_of_lines_are_exact(spark):
    rng = np.random.default_rng(10)
    image = np.concatenate([rng.random((30, 21)), np.full((20, 21), 0.25), rng.integers(0, 256, (21, 21)) / 255])
    rows = lines(spark, image, 1).unionByName(lines(spark, np.array([[0.3]]), 2)).repartition(5)
    found = {r["photo_id"]: r for r in I.exposure_profile(rows, KEYS).collect()}
    assert found[1]["luma_median"] == pytest.approx(np.median(image), abs=1e-5)
    assert found[1]["contrast_p5_p95"] == pytest.approx(np.subtract(*np.percentile(image, [95, 5])), abs=1e-5)
    assert found[1]["contrast_std"] == pytest.approx(image.std(), abs=1e-5)
    assert found[2]["luma_median"] == 0.3 and found[2]["contrast_std"] == 0


def test_counter_draws_are_even(spark):
    drawn_ = spark.range(60_000).selectExpr("id", *draws.drawn("h", 5, "id % 7", "id"))
    spread = drawn_.selectExpr(f"cast({draws.share('h')} * 20 AS int) AS b").groupBy("b").count().collect()
    assert len(spread) == 20 and all(abs(r["count"] - 3000) < 300 for r in spread)
    assert drawn_.select("h").distinct().count() > 59_900


def test_vote_finds_planted_points_among_many_segments(spark):
    """Two bundles and noise, 120 segments: more pairs than draws."""
    rng = np.random.default_rng(6)
    rows, points = [], [(700.0, 250.0), (-900.0, 300.0)]
    for k in range(120):
        x, y = rng.uniform(100, 900, 2)
        if k < 80:
            vx, vy = points[k % 2]
            dx, dy = vx - x, vy - y
        else:
            dx, dy = rng.normal(size=2)
        size = rng.uniform(60, 160) / math.hypot(dx, dy)
        rows.append((1, k, *map(float, (x, y, x + dx * size, y + dy * size))))
    rows += [(2, 0, 1.0, 2.0, 1.0, 2.0), (2, 1, 0.0, 0.0, 9.0, 1.0), (3, 5, 5.0, 5.0, 80.0, 6.0)]
    segments = spark.createDataFrame(rows, "photo_id long, seg_id long, x0 double, y0 double, x1 double, y1 double")
    found = {r["rank"]: r for r in P.vanishing_points(segments, 1000, 1000).collect()}
    assert {r["photo_id"] for r in found.values()} == {1}
    near = [min(range(2), key=lambda i, r=r: math.hypot(r["x"] - points[i][0], r["y"] - points[i][1])) for r in (found[1], found[2])]
    assert sorted(near) == [0, 1]
    for rank, i in zip((1, 2), near, strict=True):
        assert math.hypot(found[rank]["x"] - points[i][0], found[rank]["y"] - points[i][1]) < 12 and found[rank]["count"] >= 20


def test_refinement_is_the_smallest_eigenvector(spark):
    rng = np.random.default_rng(7)
    lines_ = rng.normal(size=(6, 3)) * [1, 1, 300]
    m = lines_.T @ lines_
    row = spark.createDataFrame([(float(m[0, 0]), float(m[0, 1]), float(m[0, 2]), float(m[1, 1]), float(m[1, 2]), float(m[2, 2]))], "aa double, ab double, ac double, bb double, bc double, cc double")
    vector = np.linalg.svd(lines_)[2][-1]
    steps = P._nearest_point(row).first()
    assert steps["rx"] == pytest.approx(vector[0] / vector[2], rel=1e-2) and steps["ry"] == pytest.approx(vector[1] / vector[2], rel=1e-2)


def test_column_tops_without_pixels(spark):
    rng = np.random.default_rng(8)
    mask = rng.random((150, 90)) < 0.2
    mask[:, 40:44] = False
    cells = spark.createDataFrame([(1, 90, 150, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "photo_id long, width long, height long, y long, x long")
    found = P.floor_extent(M.cells_to_runs(cells, KEYS)).first()
    tops = np.array([np.flatnonzero(mask[:, x])[0] for x in range(90) if mask[:, x].any()])
    assert found["columns"] == len(tops) and found["far_edge_px"] == pytest.approx(np.percentile(tops, 15))
    assert found["coverage"] == pytest.approx(mask.mean()) and found["bottom_px"] == np.nonzero(mask)[0].max()


def test_rings_nest(spark):
    """A ring in a ring in a ring, and one part outside."""
    w = h = 17
    cells = [(1, w, h, y, x) for y in range(1, 16) for x in range(1, 16) if max(abs(x - 8), abs(y - 8)) in (1, 4, 7)] + [(1, w, h, 0, 0), (2, w, h, 3, 3)]
    runs = M.cells_to_runs(spark.createDataFrame(cells, "photo_id long, width long, height long, y long, x long"), KEYS)
    frames = spark.createDataFrame([(1, w, h), (2, w, h)], "photo_id long, width long, height long")
    forest = R.containment(*R.parts_and_gaps(runs, frames, KEYS), KEYS).where("photo_id = 1").collect()
    # the corner pixel touches the outer ring over its corner
    assert sorted((r["kind"], r["depth"], r["pixels"]) for r in forest if not (r["kind"] == "gap" and r["open"])) == [
        ("gap", 1, 88), ("gap", 3, 40), ("gap", 5, 1), ("part", 0, 57), ("part", 2, 32), ("part", 4, 8),
    ]
    assert len({r["root"] for r in forest if r["kind"] == "part"}) == 1


def test_vote_by_groups_equals_vote_by_joins(spark, monkeypatch):
    """Whole photos and photos dealt in blocks follow one rule; a null number is never drawn but votes."""
    rng = np.random.default_rng(9)
    rows = []
    for photo, n in ((1, 40), (2, 90), (-3, 25), (4, 3), (5, 60)):
        for k in range(n):
            x, y = rng.uniform(100, 900, 2)
            dx, dy = ((300.0, 350.0) - np.array([x, y])) if k % 3 else rng.normal(size=2)
            size = rng.uniform(60, 260) / math.hypot(dx, dy)
            rows.append((photo, None if photo == 5 and k % 20 == 1 else k, *map(float, (x, y, x + dx * size, y + dy * size))))
    rows += [(None, k, 0.0, 10.0 * k, 90.0, 11.0 * k + 3) for k in range(9)] + [(1, 99, None, 1.0, 2.0, 3.0)]
    segments = spark.createDataFrame(rows, "photo_id long, seg_id long, x0 double, y0 double, x1 double, y1 double")
    got = lambda rules: sorted((r["photo_id"], r["rank"], *(round(r[c], 4) for c in ("x", "y", "support")), r["count"]) for r in P.vanishing_points(segments, 1000, 1000, rules).collect())
    loose = P.VoteRules(tolerance_deg=6.0, min_support=0.2, min_count=3)
    whole = [got(P.VoteRules()), got(loose)]
    assert {r[0] for r in whole[1]} >= {1, 2, -3, 5} and max(r[1] for r in whole[1]) == 3
    monkeypatch.setattr(P, "WHOLE_PHOTO", 30)
    assert [got(P.VoteRules()), got(loose)] == whole


def test_vote_of_whole_photos_shuffles_segments_only(spark, capsys):
    """600 draws a photo and round once went through shuffles, and ten checkpoints were written."""
    segments = spark.range(320).selectExpr(
        "id div 16 AS photo_id", "id % 16 AS seg_id", *[f"(id * {m} % 997) * 1D AS {c}" for m, c in ((71, "x0"), (131, "y0"), (257, "x1"), (389, "y1"))]
    )
    found = P.vanishing_points(segments, 1000, 1000, P.VoteRules(tolerance_deg=6.0, min_support=0.2, min_count=3))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "FlatMapGroupsInArrow" in plan and "Union" not in plan
    assert found.count() > 20
