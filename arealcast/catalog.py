"""Named views over a folder of produced tables, and convenience queries on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from arealcast.operators.verify import filter_bias, skill_summary
from arealcast.sources.tables import read_if_present

# View name and file below the aggregated folder.
SINGLE_FILES = {
    "ifs_fc": "ifs_fc_2t_county.parquet",
    "ifs_an": "ifs_an_2t_county.parquet",
    "ifs_bias": "ifs_fc_bias_2t_county.parquet",
    "ifs_anom": "ifs_fc_bias_anom_2t_county.parquet",
    "aifs_fc": "aifs_fc_2t_county.parquet",
    "aifs_bias": "aifs_fc_bias_2t_county.parquet",
    "aifs_anom": "aifs_fc_bias_anom_2t_county.parquet",
    "ifs_vs_aifs": "aifs_vs_ifs_fc_bias_comparison_2t_county.parquet",
    "era5_clim": "era5_2t_county_climatology_1991_2020.parquet",
    "koppen": "koppen_geiger_county.parquet",
}
# View name and folder of monthly chunks, as one file per chunk or Hive partitions.
CHUNK_FOLDERS = {
    "era5_monthly": "era5_monthly",
    "ifs_fc_monthly": "ifs_fc_monthly",
    "ifs_an_monthly": "ifs_an_monthly",
    "aifs_fc_monthly": "aifs_fc_monthly",
}


class Workspace:
    """Registers a lazy temporary view for every table that is present; absent ones are passed over."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        single: dict[str, str] = SINGLE_FILES,
        chunked: dict[str, str] = CHUNK_FOLDERS,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._views: list[str] = []
        for name, path in [*single.items(), *chunked.items()]:
            df = read_if_present(spark, f"{self.folder}/{path}")
            if df is not None:
                df.createOrReplaceTempView(name)
                self._views.append(name)

    def registered_views(self) -> list[str]:
        return list(self._views)

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            raise ValueError(f"view {name!r} is not registered; have {self._views}")
        return self.spark.table(name)

    def query(self, sql: str) -> DataFrame:
        """Any SQL over the views; stays lazy."""
        return self.spark.sql(sql)

    def query_bias(
        self,
        model: str = "ifs",
        lead_times: Sequence[int] | None = None,
        start: str | None = None,
        end: str | None = None,
        geo_ids: Sequence[str] | None = None,
    ) -> DataFrame:
        return filter_bias(self.view(f"{model}_bias"), lead_times or (), start, end, geo_ids or ())

    def summary_stats(self, model: str = "ifs") -> DataFrame:
        return skill_summary(self.view(f"{model}_bias")).orderBy("geo_id", "lead_time")

    def close(self) -> None:
        for name in self._views:
            self.spark.catalog.dropTempView(name)
        self._views = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()
