"""Fact tables stored in buckets of their area, so that joins of stored tables move no row.

Forecasts, analyses, errors and climatologies all meet on the area. Stored with the same number of buckets of the area,
a join on the area and any other column reads both sides bucket by bucket, without an exchange below it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from arealcast.sources.published import current, publish_folder


def store_bucketed(
    df: DataFrame, path: str, keys: Sequence[str] = ("geo_id",), buckets: int = 64, dealt: bool = False
) -> None:
    """Publish ``df`` in ``buckets`` sorted buckets of ``keys``, one file each.

    ``dealt``: the rows lie in these buckets already, as what is derived by area from a stored table, and are not moved.
    """
    keys = list(keys)
    name = f"stored_{uuid.uuid4().hex}"

    def write(folder: str) -> None:
        rows = df if dealt else df.repartition(buckets, *keys)
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).saveAsTable(name)

    try:
        publish_folder(df.sparkSession, path, write, "parquet", df.columns, {"keys": keys, "buckets": buckets, "schema": df.schema.json()})
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The current version with its buckets, whichever session stored it.

    Spark joins on the buckets' keys and further columns without an exchange only if it need not see all of them in the
    buckets; the session is told so here, as a session of ``get_spark`` already is, because it plans the joins later.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    found = current(spark, path)
    if found is None or "buckets" not in found.note:
        raise ValueError(f"no bucketed table at {path}")
    name = "read_" + found.folder.rsplit("-", 1)[1]
    if not spark.catalog.tableExists(name):
        kind = StructType.fromJson(json.loads(found.note["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
        keys = ", ".join(f"`{k}`" for k in found.note["keys"])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {found.note['buckets']} BUCKETS LOCATION '{path.rstrip('/')}/{found.folder}'"
        )
    return spark.table(name)
