import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin import FieldSpec, HourlyConfig, PreprocessConfig
from quoin.operators import checks, clean, comfort, distributions, ordering, results, skew, specs
from quoin.sources import exports, footprints, runs
from quoin.sources.locations import load_locations


def values(spark, numbers):
    return spark.createDataFrame([(None if v is None else float(v),) for v in numbers], "value double")


def test_config_ranges_and_unknown_keys():
    assert PreprocessConfig.from_dict({"f2f_height": 3.5, "epwzip_file": None}).f2f_height == 3.5
    for bad in ({"f2f_height": 9}, {"default_wwr": 1.5}, {"default_attic": "loft"}, {"min_num_floors": 0}):
        with pytest.raises(ValueError):
            PreprocessConfig(**bad)
    assert HourlyConfig(output_mode="fileref-only").writes_files and not HourlyConfig(output_mode="fileref-only").returns_frame
    with pytest.raises(ValueError):
        HourlyConfig(output_mode="other")


def test_plan_time_checks(spark):
    df = spark.createDataFrame([("1", "tall")], "building_id string, height string")
    with pytest.raises(checks.ValidationError):
        checks.require_columns(df, ["lat"])
    with pytest.raises(checks.ValidationError):
        checks.require_numeric(df, "height")
    with pytest.raises(checks.ValidationError):
        checks.require_srid(None, 3857)
    with pytest.raises(checks.ValidationError):
        checks.require_srid(27700, 3857)
    with pytest.raises(ValueError):
        checks.field_kinds([FieldSpec("x")])
    with pytest.raises(checks.ValidationError):
        checks.require_rows(df.where("false"))
    with pytest.raises(checks.ValidationError):
        clean.impute_height_and_floors(df, PreprocessConfig())
    both = spark.createDataFrame([(1, 2)], "market_seg int, market_segment int")
    assert checks.restore_truncated_names(both, ["market_segment"]).columns == both.columns
    assert not checks.has_geo_columns(df)


def test_ids(spark):
    with pytest.raises(checks.ValidationError):
        checks.require_ids(spark.createDataFrame([("1",), (None,)], "building_id string"))
    with pytest.raises(checks.ValidationError):
        checks.require_ids(spark.createDataFrame([("1",), ("1",)], "building_id string"))
    assert checks.require_ids(spark.createDataFrame([(1,), (2,)], "building_id int")).schema["building_id"].dataType == T.StringType()


def test_missing_values_are_violations_unless_allowed(spark):
    df = spark.createDataFrame([("a", 1.0), (None, math.nan), ("z", 5.0)], "kind string, ratio double")
    fields = [FieldSpec("kind", ("a",)), FieldSpec("ratio", minimum=0.0, maximum=2.0), FieldSpec("absent", ("q",))]
    strict = {(r.field, r.bad_value) for r in checks.field_violations(df, fields).collect()}
    assert strict == {("kind", None), ("kind", "z"), ("ratio", "NaN"), ("ratio", "5.0")}
    loose = {(r.field, r.bad_value) for r in checks.field_violations(df, fields, missing_ok=True).collect()}
    assert loose == {("kind", "z"), ("ratio", "5.0")}
    with pytest.raises(checks.ValidationError):
        checks.require_empty(checks.field_violations(df, fields))


def test_half_floors_round_to_even_and_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (None,), (math.nan,), (125.0,), (126.0,)], "f double")
    config = PreprocessConfig(max_building_height=500)
    out = clean.impute_height_and_floors(df, config, floors_col="f")
    assert [r.n_floors for r in out.collect()] == [0, 2, 2, 2, 2, 125, 126]
    marked = clean.with_drop_reason(clean.fill_envelope(out, config), clean.attribute_rules(config))
    report = {r.reason: r.n_rows for r in clean.drop_report(marked).collect()}
    assert report == {"kept": 5, "height_or_floors": 2}
    assert sum(report.values()) == df.count()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    sample = np.concatenate([rng.normal(size=n), np.full(n // 2, 0.25)])
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    row = distributions.quantiles(values(spark, sample).repartition(3), probs, buckets=16).first()
    assert list(row) == pytest.approx(list(np.quantile(sample, probs)))


def test_quantiles_of_groups_with_any_values(spark):
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.uniform(size=300), "sizes": np.exp(rng.normal(size=300) * 100), "low": -np.exp(rng.normal(size=200) * 60),
        "both": rng.normal(size=301) * 10.0 ** rng.integers(-30, 30, 301), "ends": np.array([-1.7e308, 0.0, 5e-324, 1.7e308]), "one": np.array([4.0]), "same": np.full(50, -2.5),
    }
    rows = [(g, float(v)) for g, some in groups.items() for v in some] + [(None, 1.0), ("even", None)]
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for buckets in (8, distributions.BUCKETS):
        found = distributions.quantiles(spark.createDataFrame(rows, "g string, value double").repartition(5), probs, ["g"], buckets=buckets)
        got = {r["g"]: list(r)[1:] for r in found.collect()}
        assert set(got) == set(groups)
        for g, some in groups.items():
            if g != "ends":
                assert got[g] == pytest.approx(list(np.quantile(some, probs)), rel=1e-12), g
        assert (got["ends"][0], got["ends"][4]) == (-1.7e308, 1.7e308)


def test_quantiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("value"))
    want = np.quantile((np.arange(1_000_000) * 7919) % 1_000_003, [0.05, 0.5, 0.999])
    assert list(distributions.quantiles(df, [0.05, 0.5, 0.999]).first()) == pytest.approx(list(want))
    assert "Window" not in distributions.quantiles(df, [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert list(distributions.quantiles(df.limit(0), [0.5]).first()) == [None]


def test_density_equals_the_sum_over_all_values(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g, shift in (("a", 0), ("b", 1e6)) for v in [*rng.normal(size=400) + shift, shift - 5, shift + 9.5]]
    found = distributions.kernel_density(spark.createDataFrame(rows, "g string, value double").repartition(3), "value", keys=["g"]).collect()
    assert len(found) == 400
    for g in ("a", "b"):
        mine = sorted((r for r in found if r["g"] == g), key=lambda r: r["step"])
        some = np.array([v for k, v in rows if k == g])
        h = (mine[1]["x"] - mine[0]["x"]) * 200 / 40
        for r in mine:
            assert r["density"] == pytest.approx(np.exp(-0.5 * ((r["x"] - some) / h) ** 2).sum() / (len(some) * h * math.sqrt(2 * math.pi)), abs=1e-10)


def test_categories_are_counted_exactly(spark):
    df = spark.range(0, 4000, 1, 7).select("id", (F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("more"), F.col("id").cast("string").alias("name"), F.lit("x").alias("one"), F.when(F.col("id") % 3 > 0, F.col("id") % 2 == 0).alias("flag"))
    assert {r["column"]: r["n_distinct"] for r in distributions.categorical_columns(df, 50).collect()} == {"fifty": 50, "flag": 2}


def test_summary_ignores_non_finite_values(spark):
    row = distributions.describe(values(spark, [1, 2, None, math.nan, math.inf, 9]), "value").first()
    assert (row["count"], row["mean"], row["median"], row["min"], row["max"]) == (3, 4.0, 2.0, 1.0, 9.0)


def test_histograms_keep_every_value(spark):
    for numbers in ([3.0] * 5, [0.0, 10.0], [0.001 * k for k in range(77)], [-5, 1e6, 17, 17]):
        rows = distributions.histogram(values(spark, numbers), "value").orderBy("bin").collect()
        assert sum(r.n for r in rows) == len(numbers)
        assert all(a.x1 == b.x0 for a, b in zip(rows, rows[1:]))
        assert rows[0].x0 <= min(numbers) and rows[-1].x1 >= max(numbers)
    assert distributions.histogram(values(spark, []), "value").count() == 0


def test_density_keeps_the_mass_inside_the_axis(spark):
    rows = distributions.kernel_density(values(spark, [10, 20, 30, 40, 50, 60, 70]), "value").orderBy("step").collect()
    assert len(rows) == 200
    assert sum(r.density for r in rows) * (rows[1].x - rows[0].x) == pytest.approx(6 / 7, abs=0.01)  # half of either end lies outside


def long_results(spark, rows):
    return spark.createDataFrame(rows, "building_id string, scenario string, measurement string, aggregation string, meter string, month int, value double")


def test_result_edge_cases(spark):
    rows = [("a", "s", "Energy", "End Uses", "Heating", 1, 5.0), ("b", "s", "Energy", "End Uses", "Heating", 1, None), ("c", "s", "Energy", "End Uses", "Cooling", 1, math.nan)]
    table = long_results(spark, rows)
    assert checks.is_results_format(table)
    assert {r.building_id: r.value for r in results.annual_totals(table).collect()} == {"a": 5.0, "b": 0.0, "c": 0.0}
    stats = {r.meter: r for r in results.monthly_stats(table, "End Uses").collect()}
    assert stats["Heating"].avg == 5.0 and stats["Heating"].ci_low == 5.0
    assert results.building_peak(table).count() == 0
    one = long_results(spark, [("a", "s", "Energy", "End Uses", "Heating", 1, 99.0), ("a", "s", "Energy", "End Uses", "Fans", 1, 1.0)])
    assert [r.meter for r in results.stock_totals(one, "End Uses").collect()] == ["Heating"]
    base = spark.createDataFrame([("a", 0.0), ("b", 4.0)], "building_id string, eui double")
    change = {r.building_id: r.percent_change for r in results.compare_scenarios(base, base.withColumn("eui", F.lit(5.0)), "eui").collect()}
    assert change == {"a": None, "b": 25.0}


def test_samples_and_indices_do_not_depend_on_buckets(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").cast("string").alias("building_id"), "id")
    whole = {r.building_id: r.sort_index for r in ordering.add_row_index(df).collect()}
    some = {r.building_id for r in ordering.sample_rows(df, 37).collect()}
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 3)
    assert {r.building_id: r.sort_index for r in ordering.add_row_index(df).collect()} == whole
    assert {r.building_id for r in ordering.sample_rows(df, 37).collect()} == some and len(some) == 37
    assert ordering.sample_rows(df, 0).count() == 0 and ordering.sample_rows(df, 900).count() == 500
    plan = ordering.sample_rows(df, 37)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_hot_keys_stay_split_when_they_are_many(spark, monkeypatch):
    probe = spark.range(400).select((F.col("id") % 20).alias("k"), F.col("id").alias("p"))
    build = spark.range(60).select((F.col("id") % 30).alias("k"), F.col("id").alias("b"))
    want = sorted(map(tuple, probe.join(build, "k").collect()))
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 6)
    tables = skew.hot_keys(probe, ["k"], 5)
    assert len(tables) > 1 and sum(t.count() for t in tables) == 20
    assert sorted(map(tuple, skew.salted_join(probe, build, ["k"], "p", 5).select("k", "p", "b").collect())) == want


def test_areas_without_a_model_are_reported(spark):
    expected = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "building_id string, expected_area double")
    modelled = spark.createDataFrame([("a", 10.0)], "building_id string, modelled_area double")
    assert [(r.building_id, r.modelled_area) for r in checks.area_mismatches(modelled, expected).collect()] == [("b", None)]


def test_scenarios_stay_apart(spark):
    rows = [(b, s, "Energy", a, m, 1, v) for b, v in (("a", 1.0), ("b", 3.0)) for s in ("s", "t") for a, m in (("End Uses", "Heating"), ("Utilities", "Gas"))]
    table = long_results(spark, [*rows, ("c", "s", "Peak", "Raw", "Gas", 1, 7.0)])
    assert {(r.building_id, r.scenario): r.eui for r in results.building_eui(table).collect()} == {("a", "s"): 1.0, ("a", "t"): 1.0, ("b", "s"): 3.0, ("b", "t"): 3.0}
    assert {r.value for r in results.building_metric(table, "energy_usage").collect()} == {1.0, 3.0}
    # The band counts all buildings of the scenario: three in s, two in t.
    width = {r.scenario: r.ci_high - r.avg for r in results.monthly_stats(table, "End Uses").collect()}
    assert width["t"] / width["s"] == pytest.approx(math.sqrt(3 / 2))
    plain = table.where("scenario = 't'").drop("scenario")
    assert results.monthly_stats(plain, "End Uses").first().avg == 2.0
    name = "Energy|End Uses|Heating|1"
    assert results.long_to_wide(table, [name]).count() == 5
    with pytest.raises(Exception, match="two values for one cell"):
        results.long_to_wide(table, [name], ("building_id",)).collect()


def test_exceedance_runs_cross_chunks(spark):
    start = 24 * 28 * 10 - 5
    hours = list(range(start, start + 12)) + [start + 20]
    df = spark.createDataFrame([("b", "z", h) for h in hours], "building_id string, zone string, h int")
    df = df.select("building_id", "zone", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit(30.0).alias("temp_c"))
    got = {(r.start_hour, r.hours) for r in comfort.exceedance_runs(df).collect()}
    assert got == {(start, 12), (start + 20, 1)}


def test_row_index_and_samples(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("building_id"))
    rows = ordering.add_row_index(df.repartition(7)).collect()
    assert sorted(r.sort_index for r in rows) == list(range(500))
    assert {r.building_id: r.sort_index for r in rows} == {r.building_id: r.sort_index for r in ordering.add_row_index(df.repartition(2)).collect()}
    small = {r.building_id for r in ordering.sample_rows(df, 50).collect()}
    cut = ordering.add_row_index(df, salt="sample", target="at").where("at < 50")
    assert small == {r.building_id for r in cut.collect()} and len(small) == 50
    assert ordering.sample_rows(df, 9999).count() == 500


def test_grid_specs(spark):
    fields = [FieldSpec("use", ("a", "b", "c")), FieldSpec("r", minimum=0.0, maximum=1.0)]
    grid = specs.grid_specs(spark, fields, PreprocessConfig(), "w.zip", steps=4)
    rows = grid.collect()
    assert len({(r.context.use, r.context.r) for r in rows}) == 12
    assert rows[0].building_id == "dryrun_00000" and rows[0].rect_fill_ratio == 1.0
    assert specs.grid_specs(spark, fields, PreprocessConfig(), "w.zip", max_tests=5, steps=4).count() == 5
    with pytest.raises(checks.ValidationError):
        specs.grid_specs(spark, fields, PreprocessConfig(), "")


def test_too_high_attics_are_reported(spark):
    df = spark.createDataFrame([("a", "occupied_conditioned", 40.0), ("b", "none", 40.0), ("c", "unoccupied_unconditioned", 12.0)], "building_id string, attic string, short_edge double")
    df = df.withColumns({"basement": F.lit("none"), "floor_height_m": F.lit(3.0)})
    out = specs.add_attic_height(specs.add_status_flags(df))
    assert [r.building_id for r in specs.attic_violations(out).collect()] == ["a"]
    heights = {r.building_id: r.attic_height for r in out.collect()}
    assert heights["a"] is None and heights["b"] is None and 2.0 <= heights["c"] <= 3.0


def test_sources_round_trip(spark, tmp_path):
    shapes = spark.createDataFrame([("1", "Polygon"), ("2", "Polygon")], "building_id string, geom_type string").withColumn(
        "geom", F.from_json(F.lit('[[[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":2},{"x":0,"y":0}]]]'), "array<array<array<struct<x:double,y:double>>>>")
    ).withMetadata("geom", {"srid": 3857})
    calls = []

    def build():
        calls.append(1)
        return shapes

    path = str(tmp_path / "pre")
    for _ in range(2):
        again = footprints.load_or_build(spark, path, PreprocessConfig(), build, inputs=())
    assert len(calls) == 1 and footprints.srid_of(again) == 3857 and again.count() == 2
    assert again.first().geom[0][0][1].x == 4.0
    stored = str(next((tmp_path / "pre").glob("config=*")))
    places = load_locations(spark, stored).collect()
    assert places[0].lon == pytest.approx(8 / 3) and load_locations(spark, str(tmp_path / "none")) is None

    feature = '{"type":"Feature","properties":{"id":"%s"},"geometry":{"type":"%s","coordinates":%s}}'
    lines = [feature % ("a", "Polygon", "[[[0,0],[1,0],[1,1],[0,0]]]"), feature % ("b", "Point", "[1,2]"), feature % ("c", "MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]]]")]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "whole.geojson").write_text('{"type":"FeatureCollection","features":[%s]}' % ",\n".join(lines))
    properties = T.StructType([T.StructField("id", T.StringType())])
    for df in (footprints.read_geojson_lines(spark, str(tmp_path / "lines.json"), properties), footprints.read_geojson(spark, str(tmp_path / "whole.geojson"), properties)):
        assert {r.id: (r.geom_type, r.geom is not None) for r in df.collect()} == {"a": ("Polygon", True), "b": ("Point", False), "c": ("MultiPolygon", True)}


def test_runs_on_disk(spark, tmp_path):
    base = str(tmp_path / "outputs")
    assert runs.list_runs(runs.list_files(spark, base), base).count() == 0
    for version, n in (("v1.9.0", 1), ("v1.10.0", 2)):
        for table in ("Results", "EnergyAndPeak"):
            spark.range(n).write.parquet(f"{base}/Town/{version}/{table}.pq")
    listed = [r.run_id for r in runs.list_runs(runs.list_files(spark, base), base).collect()]
    assert listed == ["Town/v1.10.0", "Town/v1.9.0"]
    assert runs.load_run(spark, base, "Town/v1.9.0").count() == 1
    assert runs.load_published(spark, base, "Town").count() == 2
    assert runs.load_published(spark, base, "Town", version="1.9.0").count() == 1
    for bad in (lambda: runs.load_run(spark, base, "Nowhere"), lambda: runs.load_published(spark, base, "Town", "Missing"), lambda: runs.load_table(spark, "x.csv")):
        with pytest.raises(checks.ValidationError):
            bad()


def test_exports(spark, tmp_path):
    table = long_results(spark, [("a", "s", "Energy", "End Uses", "Heating", m, float(m)) for m in (1, 2)])
    exports.write_month_csv(table, ["Energy|End Uses|Heating"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    exports.write_split(table, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).select("sheet").distinct().first().sheet == "Energy_EndUses"
    exports.write_results(table, str(tmp_path / "store"))
    hourly = spark.createDataFrame([("a", "T", 1.0), ("a", "RH", 2.0)], "building_id string, meter string, value double")
    assert exports.route_hourly(hourly, HourlyConfig(("T",), "fileref-only"), str(tmp_path / "h")) is None
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1
    assert exports.route_hourly(hourly, HourlyConfig((), "dataframes-only"), str(tmp_path / "no")).count() == 2
    assert not (tmp_path / "no").exists()


def test_positions_with_nan_are_missing(spark):
    from quoin.sources.locations import locations

    ring = "array(array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 0D))))"
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", math.nan, 2.0), ("c", 1.0, None)], "building_id string, lat double, lon double").withColumn("geom", F.expr(ring))
    rows = {r.building_id: (r.lat, r.lon) for r in locations(df, srid=4326).collect()}
    assert rows["a"] == (1.0, 2.0) and rows["b"] == rows["c"] == pytest.approx((2 / 3, 4 / 3))


def hours(spark, rows):
    return spark.createDataFrame(rows, "building_id string, grp string, meter string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_days_have_a_slot_for_every_step(spark):
    rows = [("a", "z", "t", f"2024-03-0{d} {h:02d}:{m:02d}:00", d * 100 + h + m / 100) for d in (1, 3) for h in (0, 5, 23) for m in (0, 30)] + [("a", "z", "t", "2024-03-02 07:00:00", None)]
    days = {str(r.day): r for r in comfort.hourly_days(hours(spark, rows).repartition(4), steps_per_hour=2).collect()}
    assert set(days) == {"2024-03-01", "2024-03-03"} and {r.n for r in days.values()} == {6}
    want = [None] * 48
    for h in (0, 5, 23):
        want[2 * h], want[2 * h + 1] = 300.0 + h, 300.3 + h
    assert days["2024-03-03"]["values"] == pytest.approx(want)
    wide = comfort.day_columns(comfort.hourly_days(hours(spark, rows), steps_per_hour=2), 2)
    assert wide.columns[5:8] == ["00:00", "00:30", "01:00"] and len(wide.columns) == 53
    with pytest.raises(Exception, match="two values for one step"):
        comfort.hourly_days(hours(spark, rows)).collect()  # two half hours in one slot of an hour
    with pytest.raises(Exception, match="two values for one step"):
        comfort.hourly_wide(hours(spark, [rows[0], rows[0]]), ["2024-03-01 00:00"]).collect()


def test_results_page_reads_the_results_once(spark):
    from quoin.plans.summary import page_facts, summarise

    rows = [(b, s, m, a, meter, month, v) for b in ("x", "y", "z") for s in ("Base", "New") for (m, a, meter, v) in (("Energy", "End Uses", "Heating", 4.0), ("Energy", "Utilities", "Gas", None), ("Peak", "Raw", "Gas", 2.5)) for month in (1, 2)]
    table = long_results(spark, [*rows, ("w", "New", "Peak", "Raw", "Gas", 1, math.nan)])
    plan = page_facts(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    parts = {k: [r.asDict() for r in df.collect()] for k, df in summarise(table, "Town").items()}
    assert parts["eui"] == [] or {(r["building_id"], r["scenario_name"], r["eui"]) for r in parts["eui"]} == {(b, s, 8.0) for b in "xyz" for s in ("Base", "New")}
    assert {(r["building_id"], r["peak"]) for r in parts["peak"]} == {(b, 2.5) for b in "xyz"}
    assert {r["meter"] for r in parts["fuel_meters"]} == {"Gas"} and all(r["avg"] is None for r in parts["monthly_fuels"])
    assert {(r["scenario_name"], r["total"]) for r in parts["end_uses_total"]} == {("Base", 24.0), ("New", 24.0)}
    alone = summarise(table.where("scenario = 'Base'").drop("scenario"), "Town", "Given")
    assert {r["scenario_name"] for r in alone["eui"].collect()} == {"Given"}
    direct = {(r.scenario, r.month): r for r in results.monthly_stats(table, "End Uses").collect()}
    for r in parts["monthly_end_uses"]:
        assert (r["avg"], r["ci_low"]) == (direct[r["scenario_name"], r["month"]].avg, direct[r["scenario_name"], r["month"]].ci_low)
