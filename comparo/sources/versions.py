"""Tables that change all at once or not at all.

A table is a folder of version folders and a log. A change writes its data to a new version folder, in
as many tasks as it takes, and then adds one log entry that names the folders the table now consists of.
The entry is written beside the log and renamed into it, so readers see the table before or after the
change and a job that fails in mid-write leaves the table as it was. Two writers that started from the same
entry cannot both add the next: the later one raises. :func:`vacuum` deletes folders that no kept
entry names.

An entry maps keys to folders: a table written whole has the one key ``""``; a table kept by month has a
key for each month, and replacing a month leaves the other folders where they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.session import freed_shuffles

LOG = "_versions"
WHOLE = ""


class ConcurrentChange(RuntimeError):
    """Another writer has changed the table since it was read."""


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _entries(spark: SparkSession, root: str) -> list[int]:
    fs, log = _hadoop(spark, f"{root}/{LOG}")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _entry(spark: SparkSession, root: str, number: int) -> dict[str, str]:
    fs, at = _hadoop(spark, f"{root}/{LOG}/{number:010d}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """(number, {key: folder}) of the table as it is now; (0, {}) if nothing was written."""
    numbers = _entries(spark, root.rstrip("/"))
    return (numbers[-1], _entry(spark, root.rstrip("/"), numbers[-1])) if numbers else (0, {})


def _commit(spark: SparkSession, root: str, after: int, folders: dict[str, str]) -> int:
    """Add the entry after entry `after`."""
    target = f"{root}/{LOG}/{after + 1:010d}.json"
    fs, at = _hadoop(spark, target)
    _, draft = _hadoop(spark, f"{root}/{LOG}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(folders, sort_keys=True).encode())
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise ConcurrentChange(f"{root}: entry {after + 1} is there already")
    return after + 1


def publish(df: DataFrame, root: str, *, partition_by=()) -> int:
    """Replace the table at `root` by `df`; returns the number of the new version."""
    spark, root = df.sparkSession, root.rstrip("/")
    after, _ = current(spark, root)
    folder = f"v-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with freed_shuffles(spark):
        writer.parquet(f"{root}/{folder}")
    return _commit(spark, root, after, {WHOLE: folder})


def publish_keys(df: DataFrame, root: str, key: str) -> int:
    """Replace the rows of the keys (values of column `key`) that `df` holds; the other keys stay.

    The keys are few (months): they are listed by the driver.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    after, folders = current(spark, root)
    if WHOLE in folders:
        raise ValueError(f"{root} is written whole, not by key")
    folder = f"v-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        # the key stays in the rows as well, so a folder can be read by itself
        df.withColumn("_key", F.col(f"`{key}`").cast("string")).write.partitionBy("_key").parquet(f"{root}/{folder}")
    fs, at = _hadoop(spark, f"{root}/{folder}")
    own = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    changed = {unescape(n.split("=", 1)[1]): f"{folder}/{n}" for n in own}
    return _commit(spark, root, after, folders | changed)


def read(spark: SparkSession, root: str, *, keys=None, version: int | None = None) -> DataFrame:
    """The table as it is now, or its `version`; `keys` reads the folders of those keys alone."""
    root = root.rstrip("/")
    folders = current(spark, root)[1] if version is None else _entry(spark, root, version)
    wanted = [f for k, f in sorted(folders.items()) if keys is None or k in {str(x) for x in keys}]
    if not folders:
        raise ValueError(f"no table at {root}")
    if not wanted:
        return spark.read.parquet(f"{root}/{next(iter(folders.values()))}").limit(0)
    return spark.read.parquet(*[f"{root}/{f}" for f in wanted])


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the last `keep` entries and the folders that none of those names; returns how many folders went."""
    root = root.rstrip("/")
    numbers = _entries(spark, root)
    kept = {f.split("/")[0]: None for n in numbers[-keep:] for f in _entry(spark, root, n).values()}
    parts = {f for n in numbers[-keep:] for f in _entry(spark, root, n).values()}
    gone = 0
    for n in numbers[:-keep]:
        fs, at = _hadoop(spark, f"{root}/{LOG}/{n:010d}.json")
        fs.delete(at, False)
    fs, at = _hadoop(spark, root)
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if not name.startswith("v-"):
            continue
        if name not in kept:
            fs.delete(status.getPath(), True)
            gone += 1
        elif not any(p == name for p in parts):     # by key: some of its keys may have moved on
            for own in fs.listStatus(status.getPath()):
                if own.isDirectory() and f"{name}/{own.getPath().getName()}" not in parts:
                    fs.delete(own.getPath(), True)
                    gone += 1
    return gone
