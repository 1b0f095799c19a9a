"""Large documents, bucketed manifests and revisions on small known cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from roomtable.operators import catalogue as C
from roomtable.operators import changes
from roomtable.sources.documents import array_items
from roomtable.sources.manifest import read_manifest
from roomtable.streaming import registrations as T


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("700", "0"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_items_come_whole_whatever_the_splits(spark, small_splits, tmp_path, indent):
    rng = random.Random(3)
    odd = ['a "quoted" }]{[ text', "back\\slash\\", "\\\"", "é\n\t", "", "}" * 900, '"photos": [{"id": 1}]']
    photos = [{"id": str(k), "notes": rng.choice(odd), "provenance": {"author": rng.choice(odd), "license": "x"}, "traits": [rng.choice(odd)] * rng.randint(0, 3)} for k in range(300)]
    document = {"schema": odd[0], "before": [{"photos": [{"id": "no"}]}, {}], "photos": photos, "after": {"photos": [{"id": "no"}], "x": {}}, "last": [{}, {}]}
    (tmp_path / "one.json").write_text(json.dumps(document, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    items = array_items(spark, str(tmp_path / "one.json"), "photos")
    found = sorted((r["position"], json.loads(r["value"])) for r in items.select("position", "value").collect())
    assert [k for k, _ in found] == list(range(300)) and [p for _, p in found] == photos
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "one.json")).rdd.getNumPartitions() > 20
    rows = read_manifest(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["photo_id"], r["notes"], r["author"]) for r in rows] == [(p["id"], p["notes"], p["provenance"]["author"]) for p in photos]


def test_no_items_and_no_file(spark, tmp_path):
    (tmp_path / "none.json").write_text('{"photos": [], "note": "}"}')
    assert array_items(spark, str(tmp_path / "none.json"), "photos").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        array_items(spark, str(tmp_path / "missing.json"), "photos").count()


def test_a_batch_of_one_photo_writes_one_bucket(spark, tmp_path):
    rows = [(i, f"f{i}", "cc0", False, "easy", 1) for i in range(200)]
    manifest, refused = str(tmp_path / "m"), str(tmp_path / "r")
    frame = lambda r: spark.createDataFrame(r, T.REGISTRATION)
    T.merge_batch(frame(rows), 0, manifest, refused)
    late = [(7, "g", "cc0", False, "hard", 3), (7, "h", "cc0", False, "hard", 2), (8, "public/x", "cc0", False, "easy", 9)]
    for _ in range(2):  # a replayed batch changes nothing
        T.merge_batch(frame(late[:2]), 1, manifest, refused)
        held = T.versions(spark, manifest, 1)
        assert list(held.values()).count(1) == 1 and held.keys() == T.versions(spark, manifest, 0).keys()
        now = {r["photo_id"]: r["file"] for r in T.current_manifest(spark, manifest).collect()}
        assert len(now) == 200 and now[7] == "g" and now[8] == "f8"
    T.merge_batch(frame(late[2:]), 2, manifest, refused)
    assert T.current_manifest(spark, manifest).where("photo_id = 8").first()["file"] == "f8"
    assert spark.read.parquet(f"{refused}/batch=2").count() == 1


def test_changes_name_their_paths(spark):
    kind = "id long, a struct<x: double, tags: array<string>>, m map<string, string>, e array<struct<p: array<long>>>"
    old = spark.createDataFrame([(1, (1.0, ["s", "t"]), {"k": "v"}, [([1, 2],)]), (2, None, None, None), (3, (1.0, []), {}, [])], kind)
    new = spark.createDataFrame([(1, (1.5, ["s"]), {"k": "v", "l": "w"}, [([1, 3],), ([],)]), (2, None, None, []), (4, (None, None), None, None)], kind)
    found = changes.record_changes(old, new, ["id"], ["a", "m", "e"]).collect()
    assert sorted((r["id"], r["path"], r["kind"], r["before"], r["after"]) for r in found if r["id"] < 3) == [
        (1, "a.tags[1]", "removed", "t", None),
        (1, "a.x", "changed", "1.0", "1.5"),
        (1, "e[0].p[1]", "changed", "2", "3"),
        (1, "e[1].p", "added", None, "[]"),
        (1, "m.l", "added", None, "w"),
        (2, "e", "added", None, "[]"),
    ]
    assert {(r["id"], r["kind"]) for r in found if r["id"] == 3} == {(3, "removed")}


def test_alternatives_hold_where_poor_keys_are_many(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.choice((1, 2, 3)), rng.choice("pq")) for i in range(60)]
    products = spark.createDataFrame(rows, "ref long, pattern string, tone string, width long, finish string")
    requests = products.select("ref", F.lit("tone").alias("attribute"), F.explode(F.array(*map(F.lit, "xyz"))).alias("wanted")).where("wanted <> tone")
    got = lambda: sorted(tuple(r) for r in C.find_variants(products, requests, ("pattern", "tone", "width", "finish")).collect())
    plain = []
    for ref, p, t, w, f in rows:
        for wanted in "xyz":
            if wanted != t:
                scored = [(-((p == b) + (w == d) + (f == e)), r) for r, b, c, d, e in rows if c == wanted]
                plain.append((ref, "tone", wanted, min(scored)[1], -min(scored)[0]))
    assert got() == sorted(plain)
    monkeypatch.setattr(C, "POOR_KEYS", 1)
    assert got() == sorted(plain)


def test_alternatives_broadcast_only_poor_keys(spark, capsys, tmp_path):
    """Requests, products and found rows grow with the catalogue: none of them may go through the driver."""
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], i % 5, "pq"[i // 7 % 2]) for i in range(40)]
    made = spark.createDataFrame(rows, "ref long, pattern string, tone string, width long, finish string")
    made.write.parquet(str(tmp_path / "products"))
    products = spark.read.parquet(str(tmp_path / "products"))
    requests = products.selectExpr("ref", "'pattern' AS attribute", "if(pattern = 'a', 'b', 'a') AS wanted")
    found = C.find_variants(products, requests, ("pattern", "tone", "width", "finish"))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 2
    assert found.count() == 40
