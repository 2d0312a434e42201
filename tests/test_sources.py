from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from arealcast import schemas
from arealcast.catalog import Workspace
from arealcast.functions import timefn as T
from arealcast.operators import climatology as C
from arealcast.operators import verify as V
from arealcast.operators.spatial import rings_from_wkt
from arealcast.plans import quality as Q
from arealcast.plans.registry import Tables
from arealcast.sources import bucketed as BU
from arealcast.sources import chunks as CH
from arealcast.sources import files as FI
from arealcast.sources import published as PB
from arealcast.sources import tables as TB
from arealcast.sources.weights import cached_weights
from arealcast.streaming.incremental import climatology_from_state, climatology_state, month_spans, new_chunks


def at(text):
    return dt.datetime.fromisoformat(text)


FC = "geo_id string, valid_time timestamp_ntz, init_time timestamp_ntz, lead_time int, t2m double"
AN = "geo_id string, time timestamp_ntz, t2m double"


def fc_rows(spark, months=("2024-01", "2024-02"), value=1.0):
    rows = []
    for m in months:
        for lead in (24, 48):
            init = at(f"{m}-15")
            rows.append(("01001", init + dt.timedelta(hours=lead), init, lead, value))
    return spark.createDataFrame(rows, FC)


def test_workspace(spark, folder, tmp_path):
    t = Tables(spark, folder)
    TB.write_table(t.bias(), str(tmp_path / "ifs_fc_bias_2t_county.parquet"), "bias")
    CH.write_chunks(t.forecasts().where(F.year("init_time") == 1998), str(tmp_path / "ifs_fc_monthly"), "fc")
    with Workspace(spark, str(tmp_path)) as ws:
        assert ws.registered_views() == ["ifs_bias", "ifs_fc_monthly"]
        assert ws.summary_stats().count() == 70
        assert ws.query("SELECT count(*) AS n FROM ifs_bias").first().n == 1059
        few = ws.query_bias(lead_times=[24], start="1996-01-01", geo_ids=["00001", "00002"])
        assert few.where("lead_time <> 24").isEmpty() and few.count() > 0
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(lead_time,24)" in plan and "GreaterThanOrEqual(valid_time" in plan and "In(geo_id" in plan
        one = ws.view("ifs_fc_monthly").where("year = 1998 AND month = 3 AND lead_time = 24").select("t2m")
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<t2m:double>" in plan
        with pytest.raises(ValueError):
            ws.query_bias("aifs")
    assert not spark.catalog.tableExists("ifs_bias")


def test_workspace_makes_the_analyses_once(spark, folder):
    from arealcast.plans.queries_sources import _workspace

    class Counted(Tables):
        made = 0

        def analyses(self):
            self.made += 1
            return super().analyses()

    t = Counted(spark, folder)
    ws = _workspace(t)
    assert t.made == 1 and ws.view("ifs_an").count() == ws.view("ifs_an_monthly").count() == t.analyses().count()
    assert ws.view("ifs_bias").count() == t.bias().count()
    ws.close()


def test_write_once_force_and_metadata(spark, tmp_path):
    path = str(tmp_path / "fc.parquet")
    assert TB.write_table(fc_rows(spark), path, "fc")
    assert not TB.write_table(fc_rows(spark, value=2.0), path, "fc")
    assert TB.write_table(fc_rows(spark, value=2.0), path, "fc", force=True)
    assert {r.t2m for r in TB.read_table(spark, path).collect()} == {2.0}
    assert TB.read_table(spark, path).schema["t2m"].metadata["units"] == "K"
    meta = json.loads(TB.read_metadata(spark, path).first().value)
    assert meta["variables"]["lead_time"]["units"] == "hours"
    with pytest.raises(ValueError):
        TB.write_table(fc_rows(spark).drop("t2m"), str(tmp_path / "x.parquet"), "fc")


def test_chunks_resume_and_overwrite_only_touched(spark, tmp_path):
    path = str(tmp_path / "fc")
    assert CH.resume(fc_rows(spark, ["2024-01"]), path, "fc")
    assert CH.resume(fc_rows(spark, value=9.0), path, "fc")
    got = {(r.month, r.t2m) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1.0), (2, 9.0)}
    assert not CH.resume(fc_rows(spark), path, "fc")
    CH.write_chunks(fc_rows(spark, ["2024-02"], 5.0), path, "fc")
    assert {(r.month, r.t2m) for r in spark.read.parquet(path).collect()} == {(1, 1.0), (2, 5.0)}
    TB.consolidate(spark, path, str(tmp_path / "all.parquet"), "fc")
    assert TB.read_table(spark, str(tmp_path / "all.parquet")).columns == schemas.TABLES["fc"]


def test_resume_reads_its_source_twice_at_most(spark, tmp_path):
    """Once to list its chunks and once to write them; with a catalogue once."""
    rows, read = fc_rows(spark), spark.sparkContext.accumulator(0)
    n, keys = rows.count(), ["year", "month", "lead_time"]

    def passed(lead):
        read.add(1)
        return lead > 0

    source = rows.where(F.udf(passed, "boolean").asNondeterministic()("lead_time"))
    assert CH.resume(source, str(tmp_path / "listed"), "fc") and read.value == 2 * n
    catalogue = CH.with_chunk_columns(rows, "fc").select(*keys)
    assert CH.resume(source, str(tmp_path / "told"), "fc", catalogue=catalogue) and read.value == 3 * n
    assert spark.read.parquet(str(tmp_path / "listed")).count() == spark.read.parquet(str(tmp_path / "told")).count() == n


def test_append_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    empty = fc_rows(spark).limit(0)
    assert not CH.append_batches(spark, [], path, "fc")
    assert not CH.append_batches(spark, [empty], path, "fc")
    assert TB.read_if_present(spark, path) is None
    assert CH.append_batches(spark, [fc_rows(spark, ["2024-01"]), empty, fc_rows(spark, ["2024-02"])], path, "fc")
    assert TB.read_table(spark, path).count() == 4


def test_nanosecond_files(spark, tmp_path):
    path = str(tmp_path / "nanos.parquet")
    stamps = pd.to_datetime(["2024-01-01 12:00:00.25", "1969-12-31 23:00:00"], format="ISO8601")
    pq.write_table(pa.table({"time": pa.array(stamps, pa.timestamp("ns")), "n": [1, 2]}), path)
    with pytest.raises(ValueError, match="nanosAsLong"):
        TB.read_nanos(spark, path, ["time"])
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        got = {r.n: r.time for r in TB.read_nanos(spark, path, ["time"]).collect()}
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert got == {1: at("2024-01-01 12:00:00.250"), 2: at("1969-12-31 23:00:00")}


def test_csv_keeps_leading_zeros_and_wkt_layer(spark, tmp_path):
    path = str(tmp_path / "polys")
    rows = [("01001", "01", 2e6, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")]
    TB.write_csv(spark.createDataFrame(rows, "GEOID string, STATEFP string, ALAND double, WKT string"), path)
    polys = TB.read_polygons(spark, path)
    assert polys.first().geo_id == "01001" and len(polys.first().rings[0]) == 5
    TB.write_map_layer(polys, spark.createDataFrame([("09999", 1.0)], "geo_id string, v double"), str(tmp_path / "map"))
    back = TB.read_csv(spark, str(tmp_path / "map"), "geo_id string, statefp string, aland_m2 double, v double, WKT string")
    assert back.first().v is None and back.first().WKT.startswith("POLYGON ((0.0 0.0")


def test_listing_and_suspects(spark, tmp_path):
    root = tmp_path / "an"
    root.mkdir()
    (root / "a_20240101.nc").write_bytes(b"CDF\x01" + b"0" * 10_000)
    (root / "a_20240102.nc").write_bytes(b"\x89HDF" + b"0" * 10_000)
    (root / "a_20240103.nc").write_bytes(b"GRIB" + b"0" * 10_000)
    (root / "a_20240104.nc").write_bytes(b"CDF\x01")
    (root / "notes.txt").write_text("x")
    (root / "_hidden.nc").write_bytes(b"CDF")
    assert FI.list_files(spark, str(root), "*.nc").count() == 4
    heads = FI.file_heads(spark, str(root), "*.nc")
    assert heads.columns == ["path", "length", "modified", "head"] and {len(r.head) for r in heads.collect()} == {4}
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "file_heads" in plan
    got = {r.path[-11:-3]: r.suspect for r in Q.file_suspects(FI.file_heads(spark, str(root), "*.nc")).collect()}
    assert got == {"20240101": False, "20240102": False, "20240103": True, "20240104": True}


def test_heads_are_read_by_groups_of_files(spark, tmp_path):
    """Many files over many partitions; of a large file only its first bytes are read; an empty folder has no rows."""
    for i in range(50):
        (tmp_path / f"f{i:02d}.nc").write_bytes(b"CDF" + bytes([i]))
    with open(tmp_path / "large.nc", "wb") as f:
        f.write(b"\x89HDF")
        f.truncate(5 << 30)
    FI.heads.register(spark)
    read = spark.read.format("file_heads").options(files="7", bytes="6", pattern="*.nc").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 8
    rows = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.head)) for r in read.collect()}
    assert rows["f07.nc"] == (4, b"CDF\x07") and rows["large.nc"] == (5 << 30, b"\x89HDF\0\0") and len(rows) == 51
    assert {r.suspect for r in Q.file_suspects(read.where("length > 4")).collect()} == {False}
    (tmp_path / "none").mkdir()
    assert FI.file_heads(spark, str(tmp_path / "none")).collect() == []


def test_stored_by_area_joins_move_no_row(spark, folder, tmp_path):
    t = Tables(spark, folder)
    tables = {"fc": t.forecasts(), "fc2": t.forecasts(second=True), "an": t.analyses(), "clim": t.climatology()}
    for name, df in tables.items():
        BU.store_bucketed(df, str(tmp_path / name), buckets=4)
    s = {name: BU.read_bucketed(spark, str(tmp_path / name)) for name in tables}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (V.bias_table(s["fc"], s["an"]), V.anomaly_table(V.bias_table(s["fc"], s["an"]), s["clim"]), V.compare_forecasts(s["fc"], s["fc2"], s["an"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert df.count() > 0
        assert V.bias_table(s["fc"], s["an"]).count() == V.bias_table(tables["fc"], tables["an"]).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    BU.store_bucketed(t.analyses().limit(3), str(tmp_path / "an"), buckets=4)
    assert BU.read_bucketed(spark, str(tmp_path / "an")).count() == 3 and s["an"].count() > 3
    with pytest.raises(ValueError):
        BU.read_bucketed(spark, str(tmp_path / "nothing"))


def _stored_names(spark, folder, monkeypatch, query):
    """Tables that a query stores by area, with their number of buckets."""
    from arealcast.plans.queries import QUERIES

    seen, store = {}, BU.store_bucketed

    def noted(df, path, **kw):
        seen[path.rsplit("/", 1)[1]] = kw["buckets"]
        store(df, path, **kw)

    monkeypatch.setattr(BU, "store_bucketed", noted)
    assert QUERIES[query](spark, folder).count() > 0
    return seen


def test_stored_anomalies_derive_the_climatology_by_bucket(spark, folder, tmp_path, monkeypatch):
    """Only what the query joins is stored, in as many buckets as tasks, and the climatology moves no row."""
    assert _stored_names(spark, folder, monkeypatch, "stored_anomalies") == dict.fromkeys(("first", "an", "area", "clim"), 4)
    t, path = Tables(spark, folder), str(tmp_path / "an")
    BU.store_bucketed(t.analyses(), path, buckets=4)
    clim = C.climatology(C.drop_leap_days(BU.read_bucketed(spark, path)))
    BU.store_bucketed(clim, str(tmp_path / "clim"), buckets=4, dealt=True)
    stored = BU.read_bucketed(spark, str(tmp_path / "clim"))
    assert "Exchange" not in clim._jdf.queryExecution().executedPlan().toString()
    assert len(list(tmp_path.glob("clim/data-*/part-*"))) <= 4
    same = {(r.geo_id, r.day_of_year): r.t2m_clim for r in t.climatology().collect()}
    assert {(r.geo_id, r.day_of_year): r.t2m_clim for r in stored.collect()} == pytest.approx(same)


def test_stored_comparison_stores_what_it_compares(spark, folder, monkeypatch):
    assert _stored_names(spark, folder, monkeypatch, "stored_comparison") == dict.fromkeys(("first", "second", "an"), 4)


def test_stored_tables_join_without_exchange_in_any_session(spark, folder, tmp_path):
    """A session that was not made by get_spark has Spark's defaults."""
    from arealcast.plans.queries import QUERIES

    changed = {"spark.sql.requireAllClusterKeysForCoPartition": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for name in ("stored_anomalies", "stored_comparison"):
            for k, v in changed.items():
                spark.conf.set(k, v)
            plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tolerant_scan_reports_skipped(spark, tmp_path):
    root = tmp_path / "cells of a + day, 100%"
    root.mkdir()
    good = pa.table({"grid_id": pa.array([0], pa.int32()), "lat": [0.0], "lon": [0.0], "value": [1.0]})
    pq.write_table(good, str(root / "f_20240101.parquet"))
    (root / "f_20240102.parquet").write_bytes(b"not a table at all")
    rows, lost = FI.read_cells_tolerant(spark, str(root), "grid_id int, lat double, lon double, value double")
    assert rows.count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in lost.collect()] == ["f_20240102.parquet"]
    FI.relay_by_month(rows, str(tmp_path / "laid"))
    assert (spark.read.parquet(str(tmp_path / "laid")).first().year, TB.table_is_valid(spark, str(tmp_path / "nothing"))) == (2024, False)


def test_weight_cache_is_filled_once(spark, folder, tmp_path):
    t = Tables(spark, folder)
    args = (spark, str(tmp_path / "w"), t.cells(), t.polygons(), "polygons.parquet")
    first = cached_weights(*args, "2024-01-01", ("grid_id",))
    assert first.count() == 216
    n_files = len(first.inputFiles())
    again = cached_weights(*args, "2024-01-01", ("grid_id",))
    assert again.count() == 216 and len(again.inputFiles()) == n_files
    assert cached_weights(*args, "2025-01-01", ("grid_id",)).count() == 216
    assert len(list((tmp_path / "w/weights").glob("fill=*"))) == 2


def test_grids_of_equal_axes_have_weights_of_their_own(spark, tmp_path):
    points = lambda g: spark.createDataFrame([(g, i * 1.0, j * 1.0) for i in range(3) for j in range(3)], "grid_id int, lat double, lon double")
    box = "POLYGON (({0} {0}, {1} {0}, {1} {1}, {0} {1}, {0} {0}))"
    texts = [("a", 0, box.format(0.6, 1.4)), ("b", 1, box.format(0, 2)), ("c", 2, box.format(50, 51))]
    polygons = spark.createDataFrame(texts, "geo_id string, grid_id int, wkt string").withColumn("rings", rings_from_wkt(F.col("wkt")))
    get = lambda g, domain=("grid_id",): cached_weights(spark, str(tmp_path), points(g), polygons, "p", "1", domain)
    assert {r.geo_id for r in get(0).collect()} == {"a"}
    second = get(1)
    assert {r.geo_id for r in second.collect()} == {"b"} and second.count() == 9
    assert get(2).count() == 0  # no overlap is a result, too
    assert {r.geo_id for r in get(0).collect()} == {"a"}
    assert len(list((tmp_path / "weights").glob("fill=*"))) == 2
    both = points(0).union(points(1))
    assert cached_weights(spark, str(tmp_path), both, polygons, "p", "1", ("grid_id",)).count() == 10
    # Another domain joins other polygons to the same grid.
    assert {r.geo_id for r in get(0, ()).collect()} == {"a", "b"}


def test_resume_reads_the_ledger_alone(spark, tmp_path):
    path = str(tmp_path / "fc")
    files = lambda *rows: spark.createDataFrame(list(rows), "year int, month int, lead_time int, length long, modificationTime timestamp")
    t0 = at("2024-03-01")
    all_files = [(2024, m, lead, 10, t0) for m in (1, 2) for lead in (24, 48)]
    catalogue = lambda rows: CH.catalogue_chunks(files(*rows), "fc")
    seen = []

    def build(df):
        seen.append(sorted({(r.month, r.lead_time) for r in df.select("month", "lead_time").collect()}))
        return df

    run = lambda rows, **kw: CH.resume(fc_rows(spark, **kw), path, "fc", build, catalogue=catalogue(rows))
    assert run(all_files[:2]) and not run(all_files[:2])
    assert seen == [[(1, 24), (1, 48)]]
    assert run(all_files) and seen[1:] == [[(2, 24), (2, 48)]]
    # A source file that changed makes its chunk pending again.
    touched = [(2024, 1, 24, 11, t0), *all_files[1:]]
    assert run(touched, value=5.0) and seen[2:] == [[(1, 24)]]
    assert {(r.month, r.lead_time, r.t2m) for r in spark.read.parquet(path).collect()} == {(1, 24, 5.0), (1, 48, 1.0), (2, 24, 1.0), (2, 48, 1.0)}
    # The wanted list is compared with the ledger: the plan has no scan of the facts.
    plan = CH.pending_chunks(catalogue(touched), path, "fc")._jdf.queryExecution().executedPlan().toString()
    assert "t2m" not in plan and "_ledger" in plan
    # A chunk whose files are there but that was never entered is built again.
    ledger = CH.read_ledger(spark, path, "fc")
    PB.publish(ledger.where("NOT (month = 2 AND lead_time = 48)"), f"{path}/_ledger")
    assert run(touched) and seen[3:] == [[(2, 48)]]
    # A chunk without any row is finished as well, and a chunk that lost its rows loses its files.
    assert run([*touched, (2024, 7, 24, 1, t0)]) and not run([*touched, (2024, 7, 24, 1, t0)])
    gone = [(2024, 1, 24, 12, t0), *all_files[1:], (2024, 7, 24, 1, t0)]
    assert CH.resume(fc_rows(spark, ["2024-02"]), path, "fc", catalogue=catalogue(gone))
    assert sorted((r.month, r.lead_time) for r in spark.read.parquet(path).collect()) == [(1, 48), (2, 24), (2, 48)]
    counts = {(r.month, r.lead_time): r.n_rows for r in CH.read_ledger(spark, path, "fc").collect()}
    assert counts == {(1, 24): 0, (1, 48): 1, (2, 24): 1, (2, 48): 1, (7, 24): 0}


def test_new_chunks_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    fc_rows(spark, ["2024-01"]).write.parquet(src)
    run = lambda: new_chunks(spark, src, FC, out, cp, "fc").awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 2
    late = spark.createDataFrame([("01003", at("2024-01-16"), at("2024-01-15"), 24, 3.0)], FC)
    late.write.mode("append").parquet(src)
    fc_rows(spark, ["2024-02"]).write.mode("append").parquet(src)
    run()
    got = sorted((r.month, r.lead_time, r.geo_id) for r in spark.read.parquet(out).collect())
    assert got == [(1, 24, "01001"), (1, 24, "01003"), (1, 48, "01001"), (2, 24, "01001"), (2, 48, "01001")]


def test_one_late_file_rebuilds_one_month(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    fc_rows(spark, [f"2023-{m:02d}" for m in range(1, 13)]).write.parquet(src)
    built = []

    def build(df):
        built.append(sorted({(r.year, r.month) for r in df.select("year", "month").distinct().collect()}))
        return df

    run = lambda: new_chunks(spark, src, FC, out, cp, "fc", build).awaitTermination()
    run()
    fc_rows(spark, ["2023-02", "2023-11"], 7.0).write.mode("append").parquet(src)
    run()
    assert built[1:] == [[(2023, 2), (2023, 11)]]
    assert spark.read.parquet(out).where("t2m = 7").count() == 4 and spark.read.parquet(out).count() == 28
    assert month_spans([(2023, 12), (2024, 1), (2023, 3)]) == [("2023-03-01", "2023-04-01"), ("2023-12-01", "2024-02-01")]


def test_climatology_state_stays_small(spark, tmp_path):
    """Many batches over two checkpoints: two versions at most are stored, and a batch that comes again changes nothing."""
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    day = lambda i: spark.createDataFrame([("01001", at("2021-01-01") + dt.timedelta(days=i % 3), float(i))], AN)
    for i in range(8):
        day(i).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(AN).option("maxFilesPerTrigger", 1).parquet(src)
    climatology_state(stream(), state, str(tmp_path / "cp1")).awaitTermination()
    files = len([f for f in (tmp_path / "state").rglob("*.parquet")])
    assert len(PB.versions(spark, state)) == 2 and files <= 8
    got = {r.day_of_year: r.t2m_clim for r in climatology_from_state(spark, state).collect()}
    assert got == {1: pytest.approx(3.0), 2: pytest.approx(4.0), 3: pytest.approx(3.5)}
    # The last batch again, as after a crash between its publishing and its commit.
    commits = sorted((tmp_path / "cp1/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "cp1/commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    climatology_state(stream(), state, str(tmp_path / "cp1")).awaitTermination()
    assert {r.day_of_year: r.t2m_clim for r in climatology_from_state(spark, state).collect()} == got
    climatology_state(stream(), state, str(tmp_path / "cp2")).awaitTermination()
    twice = PB.read_published(spark, state).agg(F.sum("count")).first()[0]
    assert twice == 16 and len(PB.current(spark, state).note) == 2


def test_climatology_stream_equals_batch(spark, tmp_path):
    src, state, cp = (str(tmp_path / n) for n in ("src", "state", "cp"))
    days = lambda y: spark.createDataFrame([("01001", at(f"{y}-01-01") + dt.timedelta(days=i), float(i * y)) for i in range(365)], AN)
    for year in (2020, 2021):
        days(year).write.mode("append").parquet(src)
        climatology_state(spark.readStream.schema(AN).parquet(src), state, cp).awaitTermination()
    want = {r.day_of_year: r.t2m_clim for r in C.climatology(C.drop_leap_days(spark.read.parquet(src))).collect()}
    got = {r.day_of_year: r.t2m_clim for r in climatology_from_state(spark, state).collect()}
    assert got == pytest.approx(want) and len(got) == 365


def test_reports_and_cleanup(spark, tmp_path):
    path = str(tmp_path / "fc")
    CH.write_chunks(fc_rows(spark), path, "fc")
    months = T.year_months(spark, "2024-01-01", "2024-03-31")
    report = Q.chunk_completeness(
        Q.expected_forecast_chunks(months, [24, 48]), spark.read.parquet(path), ["year", "month", "lead_time"], "valid_time"
    )
    assert {(r.month, r.status) for r in report.collect()} == {(1, "INCOMPLETE"), (2, "INCOMPLETE"), (3, "MISSING")}
    daily = spark.createDataFrame([("a", at("2024-02-01") + dt.timedelta(days=i), 1.0) for i in range(28)], AN)
    stale = Q.daily_staleness(daily, months)
    assert {r.month: r.status for r in stale.collect()} == {1: "MISSING", 2: "OK", 3: "MISSING"}
    clim = spark.createDataFrame([("a", d, 1.0) for d in range(1, 365)], "geo_id string, day_of_year int, t2m_clim double")
    status = Q.climatology_check(clim)
    assert status.first().status == "PARTIAL"
    assert Q.climatology_check(clim.drop("t2m_clim")).first().missing_columns == "t2m_clim"
    assert Q.climatology_check(clim.drop("day_of_year")).first().status == "PARTIAL"
    kinds = {r.kind for r in Q.cleanup_plan(report, stale, status).collect()}
    assert kinds == {"chunk", "climatology"}
    all_ok = stale.withColumn("status", F.lit("OK"))
    assert {r.kind for r in Q.cleanup_plan(report, all_ok, status).collect()} == {"chunk"}
    gone = CH.drop_partitions(spark, path, "fc", report.where("month = 1 AND lead_time = 24"))
    assert [g.split("/fc/")[1] for g in gone] == ["year=2024/month=1/lead_time=24"]
    assert spark.read.parquet(path).count() == 3


def test_gap_of_one_day_is_reported_for_its_month(spark):
    months = T.year_months(spark, "2024-01-01", "2024-02-29").select("year", "month", F.col("n_days").alias("n_expected"))
    days = T.time_axis(spark, "2024-01-01 00:00:00", "2024-02-29 00:00:00", 24).where("time <> timestamp_ntz'2024-02-10'")
    files = days.select(F.year("time").alias("year"), F.month("time").alias("month"), F.lit(False).alias("corrupt"))
    gaps = Q.gap_report(Q.source_completeness(months, files, ["year", "month"]), (2024, 3)).collect()
    assert [tuple(g) for g in gaps] == [(2024, 2, 1, False)]


def test_relay_stops_at_undated_files(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, "/a/f_20240102.parquet"), (2.0, "/a/notes.parquet")], "value double, file string")
    with pytest.raises(Exception, match="no date in file name"):
        FI.relay_by_month(rows, str(tmp_path / "a"))
    FI.relay_by_month(rows, str(tmp_path / "b"), skip_undated=True)
    assert [r.value for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [1.0]


def test_failed_rewrite_keeps_the_table(spark, tmp_path):
    """Whatever is written over a table, a job that fails leaves the version before it, and no half-written files."""
    broken = fc_rows(spark).withColumn("t2m", F.raise_error(F.lit("broken input")).cast("double"))
    path = str(tmp_path / "fc.parquet")
    TB.write_table(fc_rows(spark), path, "fc")
    with pytest.raises(Exception, match="broken input"):
        TB.write_table(broken, path, "fc", force=True)
    assert TB.table_is_valid(spark, path, schemas.TABLES["fc"]) and TB.read_table(spark, path).count() == 4
    assert sorted(x.name[:4] for x in (tmp_path / "fc.parquet").iterdir()) == ["_man", "data"]
    csv = str(tmp_path / "csv")
    TB.write_csv(fc_rows(spark), csv)
    with pytest.raises(Exception, match="broken input"):
        TB.write_csv(broken, csv)
    assert TB.read_csv(spark, csv, FC).count() == 4
    CH.append_batches(spark, [fc_rows(spark)], str(tmp_path / "b"), "fc")
    with pytest.raises(Exception, match="broken input"):
        CH.append_batches(spark, [broken, fc_rows(spark)], str(tmp_path / "b"), "fc")
    assert TB.read_table(spark, str(tmp_path / "b")).count() == 4


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert PB.current(spark, path) is None and PB.read_published(spark, path) is None
    for n in (1, 2, 3):  # each version may read the one before
        before = PB.read_published(spark, path)
        rows = spark.range(n).select("id", F.lit(n).alias("v"))
        PB.publish(rows if before is None else rows.unionByName(before), path)
    assert PB.current(spark, path).rows == 6 and PB.current(spark, path).number == 3
    assert [m.number for m in PB.versions(spark, path)] == [2, 3]
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("data-")]) == 2
    # A manifest cut short counts as never written; its number is not used again.
    (tmp_path / "t/_manifests/00000004.json").write_text('{"number": 4, "fol')
    assert PB.current(spark, path).number == 3 and PB.read_published(spark, path).count() == 6
    assert PB.publish(spark.range(1), path).number == 5
    # Of two writers of one version the second fails and leaves nothing.
    with pytest.raises(PB.PublishConflict):
        PB._create(spark, f"{path}/_manifests/00000005.json", "{}")
    assert PB.read_published(spark, path).count() == 1
    # An empty table is a table.
    PB.publish(spark.range(0), path)
    assert PB.current(spark, path).rows == 0 and PB.read_published(spark, path).count() == 0
