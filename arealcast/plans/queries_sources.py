"""Registered queries: tables written, read back and viewed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.catalog import Workspace
from arealcast.operators import climatology as C
from arealcast.operators import verify as V
from arealcast.plans import quality as Q
from arealcast.plans.registry import Tables, query, rounded
from arealcast.session import shared_dir
from arealcast.sources import bucketed as BU
from arealcast.sources import chunks as CH
from arealcast.sources import files as FI
from arealcast.sources import tables as TB


def _workspace(t: Tables) -> Workspace:
    """A folder with a bias table, an analysis table and monthly analysis chunks, both made from the analysis table."""
    folder = shared_dir(t.spark, "workspace")
    TB.write_table(t.analyses(), f"{folder}/ifs_an_2t_county.parquet", "an")
    an = TB.read_table(t.spark, f"{folder}/ifs_an_2t_county.parquet")
    TB.write_table(V.bias_table(t.forecasts(), an, t.land_area()), f"{folder}/ifs_fc_bias_2t_county.parquet", "bias")
    CH.write_chunks(an, f"{folder}/ifs_an_monthly", "an")
    return Workspace(t.spark, folder)


@query
def workspace_sql(t: Tables) -> DataFrame:
    """SQL over two views: analyses that some forecast was verified with, per lead."""
    return rounded(
        _workspace(t).query(
            """SELECT b.lead_time, count(*) AS n_rows, avg(b.bias) AS mean_bias, max(a.t2m) AS warmest
            FROM ifs_bias b JOIN ifs_an_monthly a ON b.geo_id = a.geo_id AND b.valid_time = a.time GROUP BY b.lead_time"""
        )
    )


@query
def workspace_views(t: Tables) -> DataFrame:
    """Registered views with their row counts."""
    ws = _workspace(t)
    counts = [
        ws.view(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view"), "n_rows")
        for name in ws.registered_views()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def consolidated_chunks(t: Tables) -> DataFrame:
    """Forecast chunks gathered into one table of the declared schema."""
    folder = shared_dir(t.spark, "consolidated")
    CH.write_chunks(t.forecasts(), f"{folder}/chunks", "fc")
    TB.consolidate(t.spark, f"{folder}/chunks", f"{folder}/fc.parquet", "fc")
    return rounded(TB.read_table(t.spark, f"{folder}/fc.parquet"))


@query
def appended_batches(t: Tables) -> DataFrame:
    """Bias of each half year appended to one table."""
    path = shared_dir(t.spark, "batches")
    bias = t.bias()
    late = F.month("valid_time") > 6
    CH.append_batches(t.spark, [bias.where(~late), bias.where(late)], path, "bias")
    return rounded(TB.read_table(t.spark, path))


@query
def written_once(t: Tables) -> DataFrame:
    """A valid table stays when written again, and is replaced on request; rows of both outcomes."""
    folder = shared_dir(t.spark, "once")
    out = []
    for force in (False, True):
        path = f"{folder}/force={force}"
        TB.write_table(t.analyses(), path, "an")
        TB.write_table(t.analyses().withColumn("t2m", F.col("t2m") + 1), path, "an", force)
        out.append(TB.read_table(t.spark, path).withColumn("forced", F.lit(force)))
    return rounded(out[0].unionByName(out[1]))


@query
def table_metadata(t: Tables) -> DataFrame:
    """The sidecar's type and unit of every column that the bias table holds, with its count of values."""
    path = f"{shared_dir(t.spark, 'metadata')}/bias.parquet"
    TB.write_table(t.bias(), path, "bias")
    text = TB.read_metadata(t.spark, path)
    kind = "kind string, variables map<string, struct<type: string, units: string>>"
    variables = text.select(F.from_json("value", kind).alias("m")).select(F.explode("m.variables").alias("name", "v"))
    table = TB.read_table(t.spark, path)
    counts = table.agg(F.create_map(*[x for c in table.columns for x in (F.lit(c), F.count(c))]).alias("n"))
    return variables.select("name", "v.type", "v.units", counts.scalar()[F.col("name")].alias("n_values"))


@query
def csv_round_trip(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "csv")
    TB.write_csv(t.area(), path)
    return rounded(TB.read_csv(t.spark, path, "geo_id string, statefp int, aland_m2 double"))


@query
def layer_round_trip(t: Tables) -> DataFrame:
    """Polygons with attributes exported as text and read back as polygons."""
    path = shared_dir(t.spark, "layer")
    ids = t.area().select(F.col("geo_id"), F.col("geo_id").alias("GEOID"), F.col("statefp").alias("STATEFP"), F.col("aland_m2").alias("ALAND"))
    TB.write_map_layer(t.polygons().select("geo_id", "rings"), ids, f"{path}/written")
    layer = TB.read_csv(t.spark, f"{path}/written", "geo_id string, GEOID string, STATEFP string, ALAND double, WKT string")
    TB.write_csv(layer.drop("geo_id"), f"{path}/delivered")
    ring = F.flatten("rings")
    return rounded(
        TB.read_polygons(t.spark, f"{path}/delivered").select(
            "geo_id",
            "statefp",
            "aland_m2",
            F.array_min(F.transform(ring, lambda p: p["x"])).alias("west"),
            F.array_max(F.transform(ring, lambda p: p["y"])).alias("north"),
        )
    )


@query
def stored_cube(t: Tables) -> DataFrame:
    """Cell errors stored by month and read back."""
    path = shared_dir(t.spark, "cube")
    cube = t.cell_observations().groupBy("grid_id", "lat", "lon", "time").agg(F.avg(F.col("f") - F.col("a")).alias("error"))
    TB.write_cells(cube, path)
    return rounded(TB.read_table(t.spark, path))


@query
def tolerant_scan(t: Tables) -> DataFrame:
    """Cells scanned file by file beside a file that is no table: rows read, and files that gave none."""
    path = shared_dir(t.spark, "cells of a day")
    t.cells().repartition(4).write.parquet(f"{path}/good")
    t.cells().agg(F.count(F.lit(1)).cast("string").alias("value")).write.text(f"{path}/broken")
    rows, skipped = FI.read_cells_tolerant(t.spark, path, "grid_id int, lat double, lon double, value double", "part-*")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values")).withColumn(
        "n_skipped", skipped.agg(F.count(F.lit(1))).scalar()
    )


@query
def relaid_by_month(t: Tables) -> DataFrame:
    """Rows of dated files laid out by year and month, counted folder by folder."""
    path = shared_dir(t.spark, "relaid")
    day = F.concat(F.lit("/an/m1_an_2t_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".nc"))
    FI.relay_by_month(t.raw("orders").select(day.alias("file"), "o_orderdate", F.col("o_totalprice").alias("value")), path)
    laid = t.spark.read.parquet(path).groupBy("year", "month")
    return rounded(laid.agg(F.count_distinct("o_orderdate").alias("n_days"), F.sum("value").alias("total")))


@query
def file_heads(t: Tables) -> DataFrame:
    """Size and signature test of one file per nation, written from the customers' names."""
    path = shared_dir(t.spark, "heads")
    kind = F.when(F.col("c_nationkey") % 3 == 0, "CDF").when(F.col("c_nationkey") % 3 == 1, "GRIB").otherwise("CD")
    lines = t.raw("customer").select(F.col("c_nationkey").alias("k"), F.concat(kind, "c_name").alias("line"))
    lines.repartition("k").sortWithinPartitions("k", "line").write.partitionBy("k").text(path)
    heads = FI.file_heads(t.spark, path, "part-*")
    k = F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("int").alias("k")
    tested = Q.file_suspects(heads).select("path", "too_small", "wrong_magic", "suspect")
    return heads.join(tested, "path").select(k, "length", F.col("head").cast("string").alias("head"), "too_small", "wrong_magic", "suspect")


def _stored_in_buckets(t: Tables, *names: str) -> dict[str, DataFrame]:
    """The named tables of forecasts of both models, analyses, climatology and areas, stored by area.

    There are as many buckets as tasks of a shuffle, so a bucket grows no more than any other share of the rows. The
    climatology comes from the stored analyses, bucket by bucket.
    """
    path, buckets = shared_dir(t.spark, "buckets"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = lambda name: BU.read_bucketed(t.spark, f"{path}/{name}")
    sources = {
        "first": t.forecasts,
        "second": lambda: t.forecasts(second=True),
        "an": t.analyses,
        "area": t.land_area,
        "clim": lambda: C.climatology(C.drop_leap_days(stored("an"))),
    }
    for name, source in sources.items():
        if name in names:
            BU.store_bucketed(source(), f"{path}/{name}", buckets=buckets, dealt=name == "clim")
    return {name: stored(name) for name in names}


@query
def stored_anomalies(t: Tables) -> DataFrame:
    """Errors and anomalies from tables stored by area: no row moves for the joins."""
    s = _stored_in_buckets(t, "first", "an", "area", "clim")
    return rounded(V.anomaly_table(V.bias_table(s["first"], s["an"], s["area"]), s["clim"]))


@query
def stored_comparison(t: Tables) -> DataFrame:
    """Two models compared from tables stored by area."""
    s = _stored_in_buckets(t, "first", "second", "an")
    return rounded(V.compare_forecasts(s["first"], s["second"], s["an"]))
