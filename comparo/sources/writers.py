"""Sinks: report sets, locale CSV, Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DecimalType, DoubleType, FloatType, NumericType, StringType,
                               StructField, StructType)

FILE_BYTES = 64 << 20      # of a text file, which one task reads
CELL_CHARS = 24            # of a cell, with quotes and separator, as a rule


def write_report_set(reports: dict, path: str, fmt: str = "parquet",
                     partition_by=None, mode: str = "overwrite") -> dict:
    """One directory per named report (SNK-1); the per-format workbooks of
    the original become ``partition_by=['format']``. Returns {name: path}."""
    out = {}
    for name, df in reports.items():
        target = f"{path.rstrip('/')}/{name}"
        w = df.write.mode(mode).format(fmt)
        if partition_by and all(c in df.columns for c in partition_by):
            w = w.partitionBy(*partition_by)
        w.save(target)
        out[name] = target
    return out


def locale_text(c, dtype) -> F.Column:
    """Number -> text with a decimal comma, no exponent, no grouping."""
    if isinstance(dtype, (DoubleType, FloatType)):
        # shortest round-trip digits, written out without an exponent
        exact = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"),
                                                  r"0+$", ""), r"\.$", "")
        s = F.coalesce(exact, c.cast("string"))
    elif isinstance(dtype, DecimalType):
        s = c.cast("string")
    else:
        s = c.cast("string")
    return F.replace(s, F.lit("."), F.lit(","))


def write_locale_csv(df: DataFrame, path: str, encoding: str = "UTF-16",
                     title: str | None = None, header=None,
                     mode: str = "overwrite", compression: str = "none") -> str:
    """CSV with a decimal comma (SNK-2). With ``title`` the first part file
    starts with the title line and the header line, as in the exported
    reports (``header``: its names, which may repeat), the others hold rows alone: read them as ``parts``
    of one report. (Spark keeps the order of a union's children in its partitions, and numbers part files by partition;
    an unsorted report may hold its rows in any order, but they all follow the first file's header.)
    Otherwise every part file has a plain header. Such a file is read by one task, so none holds more than some 64 MB of text.
    ``compression``: 'gzip' for files (``.csv.gz``) that the readers take as they are; UTF-16 text has two bytes a sign and repeats
    the labels in every row, so it shrinks to a fraction, and such files could not be split in any case."""
    most = max(1000, FILE_BYTES // (2 * CELL_CHARS * max(1, len(df.columns))))
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, NumericType) and not f.dataType.typeName() in (
                "integer", "long", "short", "byte"):
            cols.append(locale_text(c, f.dataType).alias(f.name))
        else:
            cols.append(c.cast("string").alias(f.name))
    text = df.select(*cols)
    if title is not None:
        schema = StructType([StructField(c, StringType(), True) for c in df.columns])
        top = df.sparkSession.createDataFrame(
            [[title] + [None] * (len(df.columns) - 1), list(header or df.columns)], schema)
        # a union keeps the partition order: the one-partition header lands in the
        # first part file, the report rows keep their partitioning (no sort, no shuffle)
        text = top.coalesce(1).unionByName(text)
        (text.write.mode(mode).option("encoding", encoding).option("header", False).option("compression", compression)
         .option("quoteAll", True).option("maxRecordsPerFile", most).csv(path))
    else:
        (text.write.mode(mode).option("encoding", encoding).option("header", True).option("compression", compression)
         .option("quoteAll", True).option("maxRecordsPerFile", most).csv(path))
    return path


def _quoted(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def write_sheet_csv(sheet: DataFrame, ids, header: DataFrame, path: str, *, title: str, encoding: str = "UTF-16",
                    mode: str = "overwrite") -> str:
    """A sheet of ``ids`` and a map ``cells`` as the text report with a column for every row of `header` (store: its
    place, header: its text), to be read by ``readers.read_cells``: title line, header line, rows.

    A line has a cell for every column, an empty one where the map has none. A plan cannot carry that many columns, so
    lines are made as text: the filled cells of a row by place, and commas for the gaps between them. Files hold few lines.
    """
    ids = list(ids)
    spark = sheet.sparkSession
    places = header.select(F.col("header").alias("_header"),
                           F.row_number().over(Window.orderBy("store")).alias("_place"))    # the header is one line
    n = header.count()
    numbered = sheet.select(F.monotonically_increasing_id().alias("_line"), *ids, F.col("cells").alias("_cells"))
    filled = numbered.select("_line", *ids, F.explode_outer("_cells").alias("_header", "_text"))
    cell = F.when(F.col("_place").isNotNull() & F.col("_text").isNotNull(), F.struct("_place", "_text"))
    rows = filled.join(places, "_header", "left").groupBy("_line", *ids).agg(
        F.sort_array(F.collect_list(cell)).alias("_filled"))
    # few bytes, but a cell for every column: spread the rows before they become wide
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    before = lambda i: F.coalesce(F.get("_filled", i - 1)["_place"], F.lit(0))
    texts = F.transform("_filled", lambda x, i: F.concat(F.repeat(F.lit(","), x["_place"] - before(i)), _quoted(x["_text"])))
    line = F.concat(
        F.array_join(F.array(*[F.coalesce(_quoted(F.col(i)), F.lit("")) for i in ids]), ","), F.array_join(texts, ""),
        F.repeat(F.lit(","), F.lit(n) - before(F.size("_filled"))))
    heads = header.agg(F.transform(F.sort_array(F.collect_list(F.struct("store", "header"))), lambda x: x["header"]).alias("h"))
    named = F.concat(F.array(*[F.lit(i) for i in ids]), F.col("h"))
    top = heads.select(F.explode(F.array(_quoted(F.lit(title)), F.array_join(F.transform(named, _quoted), ","))).alias("line"))
    (top.coalesce(1).unionByName(rows.select(line.alias("line"))).write.mode(mode).option("encoding", encoding)
     .option("header", False).option("quote", "").option("sep", "\x01").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("maxRecordsPerFile", max(1, FILE_BYTES // (2 * (n + 100)))).csv(path))
    return path


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    """Parquet export (SNK-3)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def save_table(df: DataFrame, target: str, mode: str = "overwrite", fmt: str = "parquet") -> str:
    """Overwrite (or create) a table (SNK-4). ``target`` is a path; a name
    without '/' is a catalog table written with ``saveAsTable``."""
    if "/" in target:
        df.write.mode(mode).format(fmt).save(target)
    else:
        df.write.mode(mode).format(fmt).saveAsTable(target)
    return target
