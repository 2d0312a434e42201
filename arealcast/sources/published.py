"""Tables that are replaced as a whole or not at all.

A published table is a folder with one data folder per version and small numbered manifests:

    path/data-00000007-5f2c.../part-*      files of one version
    path/_manifests/00000007.json          names the data folder, written last

The highest readable manifest names the current version. A writer first writes its data folder and then creates the next
manifest, which is created only if no other writer has taken that number. So a job that fails leaves the version before
it in place, two writers never mix, and a reader sees one version or the other. No folder is ever renamed, which object
stores cannot do at once. The version before the current one is kept for readers that have begun with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class PublishConflict(RuntimeError):
    """Another writer published the same version first."""


@dataclass(frozen=True)
class Manifest:
    number: int
    folder: str
    format: str
    columns: list[str]
    rows: int | None
    note: dict = field(default_factory=dict)
    complete: bool = True


def _fs(spark: SparkSession, path: str):
    """Hadoop file system of ``path`` and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, make = _fs(spark, path)
    folder = make(f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _load(spark: SparkSession, path: str, number: int) -> Manifest | None:
    """None for a manifest whose writing was cut short."""
    fs, make = _fs(spark, path)
    stream = fs.open(make(f"{path}/{MANIFESTS}/{number:08d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = Manifest(**json.loads(text))
    except (ValueError, TypeError):
        return None
    return found if found.complete else None


def versions(spark: SparkSession, path: str) -> list[Manifest]:
    """Readable versions, oldest first."""
    found = (_load(spark, path, n) for n in _numbers(spark, path))
    return [m for m in found if m is not None]


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The version that readers get; None where nothing is published."""
    path = path.rstrip("/")
    for number in reversed(_numbers(spark, path)):
        found = _load(spark, path, number)
        if found is not None:
            return found
    return None


def resolve(spark: SparkSession, path: str) -> str:
    """Folder with the current files of a published table; ``path`` itself for any other."""
    found = current(spark, path)
    return path if found is None else f"{path.rstrip('/')}/{found.folder}"


def publish(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    unless_empty: bool = False,
    note: dict | None = None,
    **options: str,
) -> Manifest | None:
    """Write ``df`` as the next version of the table at ``path``. ``df`` may read the version before.

    ``unless_empty``: publish nothing, and return None, if a Parquet table would have no row. ``note``: what the manifest
    tells besides.
    """

    def write(folder: str) -> None:
        writer = df.write.format(fmt).options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(folder)

    return publish_folder(df.sparkSession, path, write, fmt, df.columns, note or {}, unless_empty)


def publish_folder(
    spark: SparkSession,
    path: str,
    write: Callable[[str], None],
    fmt: str,
    columns: list[str],
    note: dict,
    unless_empty: bool = False,
) -> Manifest | None:
    """Let ``write`` fill a new data folder and publish it as the next version."""
    path = path.rstrip("/")
    number = max([0, *_numbers(spark, path)]) + 1
    folder = f"data-{number:08d}-{uuid.uuid4().hex}"
    fs, make = _fs(spark, path)
    try:
        write(f"{path}/{folder}")
        # Parquet knows its number of rows from the footers, so this reads no data.
        rows = spark.read.parquet(f"{path}/{folder}").count() if fmt == "parquet" else None
        if unless_empty and rows == 0:
            fs.delete(make(f"{path}/{folder}"), True)
            return None
        manifest = Manifest(number, folder, fmt, columns, rows, note)
        _create(spark, f"{path}/{MANIFESTS}/{number:08d}.json", json.dumps(asdict(manifest)))
    except BaseException:
        fs.delete(make(f"{path}/{folder}"), True)
        raise
    prune(spark, path)
    return manifest


def _create(spark: SparkSession, target: str, text: str) -> None:
    fs, make = _fs(spark, target)
    try:
        out = fs.create(make(target), False)
    except Exception as exc:
        if fs.exists(make(target)):
            raise PublishConflict(f"{target} exists") from exc
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions; returns the folders that went."""
    fs, make = _fs(spark, path)
    gone = []
    for old in versions(spark, path)[:-keep]:
        # The manifest goes first, so that no manifest ever names a missing folder.
        fs.delete(make(f"{path}/{MANIFESTS}/{old.number:08d}.json"), False)
        fs.delete(make(f"{path}/{old.folder}"), True)
        gone.append(old.folder)
    return gone


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version, or the files at ``path`` where nothing is published; None when there are none."""
    found = current(spark, path)
    try:
        if found is None:
            return spark.read.parquet(path)
        return spark.read.format(found.format).load(f"{path.rstrip('/')}/{found.folder}")
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def now(spark: SparkSession, path: str) -> int:
    """The time in milliseconds by the clock that stamps the files at ``path``."""
    fs, make = _fs(spark, path)
    marker = make(f"{path}/_time-{uuid.uuid4().hex}")
    fs.create(marker, False).close()
    try:
        return fs.getFileStatus(marker).getModificationTime()
    finally:
        fs.delete(marker, False)
