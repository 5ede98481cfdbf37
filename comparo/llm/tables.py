"""Input tables, the shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.session import freed_shuffles

BATCH_BYTES = 4 << 20     # of an Arrow batch with rows that are wide or that all go to one task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="comparo-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Writer options for rows of some MB each: Parquet looks at its buffers after every row, not after a hundred, and a reader takes
#: few rows at once.
WIDE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def write(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> str:
    """Write `df` to a new folder of the shared scratch space and return its path."""
    path = f"{scratch_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}/{name}"
    with freed_shuffles(df.sparkSession):
        df.write.options(compression=codec, **options).parquet(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """`df` written to the shared scratch space and read back: a lost executor loses nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name, codec, **options))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `docs` (did, text) joined to `wanted` by (did, h), h being the hash of the text: a did with many
    texts, as that of all rows without id, gives each its own text only."""
    return docs.withColumn("h", F.xxhash64("text")).join(wanted, ["did", "h"])


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` made and nobody reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, whatever their search path holds."""
    sc = spark.sparkContext
    if getattr(sc, "_comparo_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="comparo-")) / "comparo.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._comparo_shipped = True
