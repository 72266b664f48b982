"""Refreshing a preprocessed stock, and publishing versions."""

import json
import math
import random
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from quoin import FieldSpec, PreprocessConfig
from quoin.operators.checks import ValidationError
from quoin.plans import refresh as R
from quoin.plans.preprocess import Columns, preprocess
from quoin.session import shared_folder
from quoin.sources import runs

CONFIG = PreprocessConfig(neighbor_threshold=60)
FIELDS = (FieldSpec("use", ("Office", "School")),)
SCHEMA = "osm_id string, use string, height double, wwr double, geom array<array<array<struct<x:double,y:double>>>>, geom_type string"


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def square(x, y, side=10.0):
    x, y = float(x), float(y)
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return [[[{"x": a, "y": b} for a, b in ring]]]


def stock(n=150, seed=1):
    rng = random.Random(seed)
    return {str(k): ("Office" if k % 3 else "School", 6.0 + k % 5, 0.2, square(rng.uniform(0, 900), rng.uniform(0, 900)), "Polygon") for k in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(str(k), 1000.0 * k, 500.0, "tmyx", f"s{k}.zip") for k in range(4)], "station_id string, x double, y double, source string, path string")


def run(spark, path, rows, sites, **more):
    return R.refresh(path, frame(spark, rows), sites, CONFIG, 3857, FIELDS, Columns(id="osm_id", height="height"), inputs=(), **more)


def plain(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def full(spark, rows, sites):
    return preprocess(frame(spark, rows), sites, CONFIG, 3857, FIELDS, columns=Columns(id="osm_id", height="height"))


def test_refresh_equals_a_full_run_and_assesses_changed_rows_only(spark, sites, monkeypatch):
    path, rows = folder(spark), stock()
    first = run(spark, path, rows, sites)
    want, report = full(spark, rows, sites)
    assert plain(first.buildings) == plain(want) and plain(first.report) == plain(report)
    assert (first.version, first.changed, first.renewed) == ("v0.1.0", None, None)

    seen = []
    real = R.assess
    monkeypatch.setattr(R, "assess", lambda df, *a: (seen.append({r["osm_id"] for r in df.select("osm_id").collect()}), real(df, *a))[1])
    use, height, wwr, geom, kind = rows["5"]
    rows["5"] = (use, height, wwr, square(450, 450), kind)  # moved: neighbours at the old and the new place
    rows["6"] = ("School", 40.0, 0.2, rows["6"][3], "Polygon")  # higher: its neighbours see it
    rows["7"] = (*rows["7"][:2], 3.0, *rows["7"][3:])  # now dropped
    del rows["8"]
    rows["new"] = ("Office", 9.0, None, square(460, 470), "Polygon")
    second = run(spark, path, rows, sites)
    assert seen == [{"5", "6", "7", "new"}]
    assert {r["building_id"]: r["change"] for r in second.changed.collect()} == {"5": "changed", "6": "changed", "7": "changed", "8": "removed", "new": "added"}
    want, report = full(spark, rows, sites)
    assert plain(second.buildings) == plain(want) and plain(second.report) == plain(report)
    renewed = {r["building_id"] for r in second.renewed.collect()}
    assert {"5", "6", "new"} <= renewed and len(renewed) < 100
    old = {r["building_id"]: r for r in runs.load_published(spark, path, runs._names(spark, path)[0], "Buildings", "v0.1.0").collect()}
    lists = {r["building_id"]: r["neighbors"] for r in second.buildings.collect()}
    changed_lists = {k for k, v in lists.items() if k not in old or v != old[k]["neighbors"]}
    assert changed_lists <= renewed and len(changed_lists) > 4

    third = run(spark, path, rows, sites)  # nothing changed
    assert (len(seen), third.version, third.changed.count(), third.renewed.count()) == (1, "v0.3.0", 0, 0)
    assert plain(third.buildings) == plain(want)


def test_refresh_of_buildings_in_reach_equals_a_full_run(spark, sites):
    path, rows = folder(spark), stock(30)
    edge = 500_000  # of the reach, east of the last station
    for k, x in (("in", 3000 + edge - 30), ("out", 3000 + edge + 20), ("far", 3000 + edge + 900), ("back", 3000 + edge + 800)):
        rows[k] = ("Office", 6.0, 0.2, square(x, 495), "Polygon")

    def same(rows, reasons, **more):
        out = run(spark, path, rows, sites, only_in_reach=True, **more)
        want, report = preprocess(frame(spark, rows), sites, CONFIG, 3857, FIELDS, columns=Columns(id="osm_id", height="height"), only_in_reach=True, **more)
        assert plain(out.buildings) == plain(want) and plain(out.report) == plain(report)
        assert {r["reason"]: r["n_rows"] for r in out.report.collect()} == reasons
        return {r["building_id"]: [n["building_id"] for n in r["neighbors"]] for r in out.buildings.collect()}

    with pytest.raises(ValidationError, match="in reach"):
        run(spark, path, rows, sites)
    first = same(rows, {"kept": 31, "no_station": 3})
    assert first["in"] == ["out"] and not {"out", "far", "back"} & set(first)
    rows["back"] = (*rows["back"][:3], square(3000 + edge - 50, 495), "Polygon")  # comes into reach
    rows["0"] = (*rows["0"][:3], square(3000 + edge + 60, 495), "Polygon")  # leaves it
    rows["far"] = (rows["far"][0], 9.0, *rows["far"][2:])
    second = same(rows, {"kept": 31, "no_station": 3})
    assert second["back"] == ["in"] and second["in"] == ["back", "out"] and not {"0", "out", "far"} & set(second)


def test_another_setting_station_or_input_starts_anew(spark, sites):
    path, rows = folder(spark), stock(20)
    keys = lambda: set(runs._names(spark, path))
    for k, call in enumerate(
        (
            lambda: run(spark, path, rows, sites),
            lambda: run(spark, path, rows, sites.where("station_id <> '2'")),
            lambda: run(spark, path, rows, sites, scenario="Retrofit"),
            lambda: R.refresh(path, frame(spark, rows), sites, CONFIG, 3857, FIELDS, Columns(id="osm_id", height="height"), inputs=("2",)),
        )
    ):
        assert call().version == "v0.1.0" and len(keys()) == k + 1
    assert run(spark, path, rows, sites.repartition(3)).version == "v0.2.0"  # the order of rows is no content
    with pytest.raises(TypeError):
        R.refresh(path, frame(spark, rows), sites, CONFIG, 3857, FIELDS, Columns(id="osm_id"))


def test_a_refresh_that_fails_leaves_the_last_version(spark, sites):
    path, rows = folder(spark), stock(30)
    good = plain(run(spark, path, rows, sites).buildings)
    bad = {**rows, "3": ("Castle", *rows["3"][1:])}
    with pytest.raises(ValidationError, match="Castle"):
        run(spark, path, bad, sites)
    twice = frame(spark, rows).unionByName(frame(spark, {"3": rows["3"]}))
    with pytest.raises(ValidationError, match="more than once"):
        R.refresh(path, twice, sites, CONFIG, 3857, FIELDS, Columns(id="osm_id", height="height"), inputs=())
    again = run(spark, path, rows, sites)
    assert again.version == "v0.2.0" and plain(again.buildings) == good


def test_digests_tell_rows_apart(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (2, 2.0, None), (3, math.nan, 0.0), (4, None, 2.0)], "k int, a double, b double")
    found = {r["k"]: r["_digest"] for r in R.with_digest(rows.select("a", "b", "k")).withColumn("x", F.lit(1)).collect()}
    assert len(set(found.values())) == 4  # the id belongs to the row
    less = [r["_digest"] for r in R.with_digest(rows.drop("k")).collect()]
    assert less[0] == less[3] and len(set(less)) == 3
    assert R.table_digest(rows) == R.table_digest(rows.orderBy(F.desc("k"))) != R.table_digest(rows.where("k > 1"))
    assert R.table_digest(rows.limit(0)) == "0-None"


def test_writers_at_once_get_different_versions(spark, monkeypatch):
    base, barrier = folder(spark), threading.Barrier(2, timeout=60)
    real, waited = runs._create_new, set()

    def slow(spark, path):
        if path.endswith("/_claims/v0.1.0") and threading.get_ident() not in waited:
            waited.add(threading.get_ident())
            barrier.wait()  # both have seen no version and claim the same one
        return real(spark, path)

    monkeypatch.setattr(runs, "_create_new", slow)
    got = []

    def publish(k):
        got.append((runs.publish(spark, base, "Town", {"Results": spark.createDataFrame([(k,)], "k int")}), k))

    threads = [threading.Thread(target=publish, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in got) == ["v0.1.0", "v0.2.0"] == runs.published_versions(spark, base, "Town")
    for version, k in got:
        assert runs.load_published(spark, base, "Town", version=version).collect() == [(k,)]


def test_readers_see_whole_versions_only(spark, monkeypatch):
    base = folder(spark)
    one, two = (spark.createDataFrame([(k,)], "k int") for k in (1, 2))
    assert runs.published_versions(spark, base, "Town") == []
    assert runs.publish(spark, base, "Town", {"Results": one}) == "v0.1.0"
    real = runs._create_new
    with monkeypatch.context() as m:  # a writer that dies before its version is marked as whole
        m.setattr(runs, "_create_new", lambda s, path: real(s, path) if runs._DONE not in path else (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            runs.publish(spark, base, "Town", {"Results": two})
    assert runs.published_versions(spark, base, "Town") == ["v0.1.0"] and runs.unfinished_versions(spark, base, "Town") == {"v0.2.0"}
    assert runs.load_published(spark, base, "Town").collect() == [(1,)]
    with pytest.raises(ValidationError):
        runs.load_published(spark, base, "Town", version="v0.2.0")
    assert runs.publish(spark, base, "Town", {"Results": two, "Others": one}, part="major") == "v1.0.0"
    assert runs.publish(spark, base, "Town", {"Results": two}, part="patch") == "v1.0.1"
    assert runs.load_published(spark, base, "Town", "Others", "1.0.0").collect() == [(1,)]
    with pytest.raises(ValidationError):
        runs.publish(spark, base, "Town", {}, part="second")
