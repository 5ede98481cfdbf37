"""Readers for the exported reports.

Report files are UTF-16 text: some title lines, the header, the rows; fields comma-separated and quoted.
UTF-16 files cannot be split, so a file is one task: its rows are read once and written as they stand to the
shared folder, and the header probe, the rows and the bad rows all come from that copy.

A row whose cells do not fit the header (a surplus cell that holds something) is a bad row. It is never cut
to fit: by default the read raises when such a row is met; with ``bad_rows="keep"`` good rows are returned and the bad
ones are there, whole, with their file, place and cell count (:class:`Report`), to be written to a quarantine
folder and counted.
"""

from __future__ import annotations

import csv
import datetime as _dt
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from comparo.functions import labels as L
from comparo.functions.text import parse_locale_decimal
from comparo.session import materialize

RAW = "_raw"                # the row as it stands, where its number of cells is not the header's
NAMED_FILES = 5             # files that an error names


class Report(NamedTuple):
    """Rows of a report and the rows that do not fit its header: (file, row, cells, text)."""

    rows: DataFrame
    bad: DataFrame

    def quarantine(self, path: str) -> int:
        """Write the bad rows to `path` and return how many there are."""
        self.bad.write.mode("overwrite").parquet(path)
        return self.bad.sparkSession.read.schema(self.bad.schema).parquet(path).count()


def _string_schema(n: int, *more: str) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in [*(f"_c{i}" for i in range(n)), *more]])


def _cells(raw: Column, sep: str) -> Column:
    """The cells of a row of text, quotes and all: parted at separators with an even number of quotes after them."""
    return F.split(raw, re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)


def _surplus(raw: Column, n: int, sep: str) -> Column:
    """Whether a row has something beyond its n-th cell (empty cells there are harmless)."""
    beyond = F.array_join(F.slice(_cells(raw, sep), n + 1, 1 << 20), "")
    return raw.isNotNull() & (F.trim(F.replace(beyond, F.lit('"'), F.lit(""))) != "")


def _read_text(spark: SparkSession, path: str, header: list[str], *, encoding: str, sep: str, parts: bool) -> Report:
    """Rows below the header of their file, the header being the first row that equals it.

    Every text file is read by one task in file order, so the row id tells above from below; the rows
    above are dropped whatever they hold, the rows below are kept whatever they lack. Every file has to have the
    header, unless they are `parts` of one report, written by several tasks: then the first part has it and
    those without are all data.
    """
    n = len(header)
    raw = (spark.read.schema(_string_schema(n, RAW)).option("columnNameOfCorruptRecord", RAW)
           .option("encoding", encoding).option("multiLine", True).option("sep", sep)
           .option("quote", '"').option("escape", '"').option("header", False).csv(path))
    columns = raw.columns[:n]
    tagged = materialize(raw.withColumns({"_file": F.col("_metadata.file_path"),
                                          "_row": F.monotonically_increasing_id()}), name="report-text")
    equal = F.lit(True)
    for c, h in zip(columns, header):
        equal = equal & F.trim(F.col(f"`{c}`")).eqNullSafe(F.lit(h.strip()))
    heads = tagged.filter(equal).groupBy("_file").agg(F.min("_row").alias("_head"))
    if heads.isEmpty():
        raise ValueError(f"no header row {header!r} in {path}")
    if not parts:
        without = tagged.select("_file").distinct().join(heads, "_file", "left_anti").limit(NAMED_FILES)
        names = sorted(r[0] for r in without.collect())
        if names:
            raise ValueError(f"no header row {header!r} in {', '.join(names)} (parts=True if they are parts of one report)")
    below = F.col("_head").isNull() | (F.col("_row") > F.col("_head"))
    kept = tagged.join(F.broadcast(heads), "_file", "left").filter(below)      # a row a file: no file becomes one task
    bad = F.coalesce(_surplus(F.col(RAW), n, sep), F.lit(False))
    # the cells depend on the join, so that no later predicate is tried on the rows above
    rows = kept.withColumn("_bad", bad).select(
        *[F.when(below, F.col(f"`{c}`")).alias(c) for c in columns], RAW, "_file", "_bad")
    faulty = kept.filter(bad).select(F.col("_file").alias("file"), F.col("_row").alias("row"),
                                     F.size(_cells(F.col(RAW), sep)).alias("cells"), F.col(RAW).alias("text"))
    return Report(rows, faulty)


def _report(read: Report, names: list[str], bad_rows: str, path: str) -> DataFrame | Report:
    own = [c for c in read.rows.columns if c not in (RAW, "_file", "_bad")]
    if bad_rows == "keep":
        return Report(read.rows.filter(~F.col("_bad")).select(*own).toDF(*names), read.bad)
    if bad_rows != "raise":
        raise ValueError(f"bad_rows must be 'raise' or 'keep', got {bad_rows!r}")
    told = F.raise_error(F.concat(F.lit("more cells than the header: "), F.col("_file"), F.lit(": "), F.col(RAW)))
    first = F.when(F.col("_bad"), told.cast("string")).otherwise(F.col(own[0])).alias(own[0])
    # every cell of a bad row raises, whichever columns are read
    checked = [F.when(F.col("_bad"), told.cast("string")).otherwise(F.col(c)).alias(c) for c in own[1:]]
    return read.rows.select(first, *checked).toDF(*names)


def read_report_csv(spark: SparkSession, path: str, columns, *, encoding: str = "UTF-16",
                    sep: str = ",", usecols=None, parts: bool = False, bad_rows: str = "raise") -> DataFrame | Report:
    """Read a report whose header row follows any number of title lines.

    ``columns`` is the header, in file order (the schema is never inferred); the
    rows above it are dropped, all rows below it are kept. ``usecols`` keeps a
    subset (SRC-2). ``parts``: the files are parts of one report. ``bad_rows``: see the module.
    """
    columns = list(columns)
    out = _report(_read_text(spark, path, columns, encoding=encoding, sep=sep, parts=parts), columns, bad_rows, path)
    if usecols is None:
        return out
    picked = [F.col(f"`{c}`") for c in usecols]
    return Report(out.rows.select(*picked), out.bad) if isinstance(out, Report) else out.select(*picked)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";",
                   header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """';'-separated export with a header (SRC-5)."""
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("encoding", encoding).csv(path))


def read_any(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """Dispatch on the format name; unknown formats raise (SRC-4). The CSV
    branch reads every field as text (numbers use a decimal comma)."""
    fmt = fmt.lower()
    if fmt == "csv":
        columns = options.pop("columns")
        return read_report_csv(spark, path, columns, **options)
    if fmt in ("parquet", "orc", "json"):
        return spark.read.options(**options).format(fmt).load(path)
    raise ValueError(f"unsupported format: {fmt!r}")


def read_register(spark: SparkSession, path: str, columns, *, encoding: str = "UTF-8",
                  sep: str = ",", parts: bool = False, bad_rows: str = "raise") -> DataFrame | Report:
    """Store register export below lines of free text (SRC-6). ``columns`` is
    the header as it stands in the file; repeated month headers are
    disambiguated 'X', 'X.1', 'X.2' like the spreadsheet reader does. All rows
    below the header are kept."""
    names = _numbered(columns)
    return _report(_read_text(spark, path, list(columns), encoding=encoding, sep=sep, parts=parts), names, bad_rows, path)


def _numbered(columns) -> list[str]:
    names, seen = [], {}
    for c in columns:
        k = seen.get(c, 0)
        names.append(c if k == 0 else f"{c}.{k}")
        seen[c] = k + 1
    return names


# ---- wide sheets ----

def header_month(text: str) -> _dt.date | None:
    """The month that a column header names: '2024-04-01 00:00:00', '01/04/2024', '04/2024', 'Abril 2024', 'abr-24'."""
    s = text.strip()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})(?:-\d{1,2})?(?:[ T]\d{2}:\d{2}(?::\d{2})?)?", s):
        year, month = int(m[1]), int(m[2])
    elif m := re.fullmatch(r"(?:\d{1,2}/)?(\d{1,2})/(\d{4})", s):
        year, month = int(m[2]), int(m[1])
    elif m := re.fullmatch(r"([^\W\d_]+)\.?[ -](\d{4}|\d{2})", s):
        name = m[1].lower()
        known = [i for i, x in enumerate(L.MONTHS_ES, 1) if x.lower() == name or x.lower()[:3] == name]
        known += [i for i, x in enumerate(L.MONTHS_EN, 1) if x.lower() == name or x.lower()[:3] == name]
        if not known:
            return None
        year, month = int(m[2]) + (2000 if len(m[2]) == 2 else 0), known[0]
    else:
        return None
    return _dt.date(year, month, 1) if 1 <= month <= 12 else None


def sheet_header(spark: SparkSession, path: str, ids, *, encoding: str = "UTF-8", sep: str = ",",
                 within: int = 200) -> list[str]:
    """The header row of a sheet: the first of a file's first `within` lines whose cells hold all of `ids` (one row to the driver)."""
    wanted = {i.strip().lower() for i in ids}
    lines = (spark.read.schema("line string").option("encoding", encoding).option("sep", "\x01").option("quote", "")
             .option("header", False).csv(path))
    lines = lines.withColumn("_row", F.monotonically_increasing_id()).filter(F.col("_row").bitwiseAND((1 << 33) - 1) < within)
    found = F.lit(True)
    for i in sorted(wanted):
        found = found & F.lower("line").contains(i)
    for (line,) in lines.filter(found).orderBy("_row").select("line").limit(within).collect():
        cells = next(csv.reader([line], delimiter=sep))
        if wanted <= {c.strip().lower() for c in cells}:
            return cells
    raise ValueError(f"no header row with {sorted(wanted)} in {path}")


def read_sheet(spark: SparkSession, path: str, ids, *, encoding: str = "UTF-8", sep: str = ",", parts: bool = False,
               bad_rows: str = "raise") -> DataFrame | Report:
    """A wide monthly sheet (share, staff cost, authorised hours) whose columns are found in its header row (SRC-7).

    The caller names the id columns; every other column whose header is a month gets the canonical header
    'YYYY-MM-01 00:00:00' and its cells, numbers with a decimal comma, become DOUBLE (anything else in them NULL);
    columns that are neither stay text. Headers are otherwise kept as they stand, repeated ones numbered.
    """
    header = sheet_header(spark, path, ids, encoding=encoding, sep=sep)
    months = {i: m for i, m in enumerate(map(header_month, header)) if m is not None}
    names = _numbered([f"{months[i]} 00:00:00" if i in months else h.strip() for i, h in enumerate(header)])
    out = _report(_read_text(spark, path, header, encoding=encoding, sep=sep, parts=parts), names, bad_rows, path)
    rows = out.rows if isinstance(out, Report) else out
    rows = rows.select(*[parse_locale_decimal(F.col(f"`{c}`"), dtype="double").alias(c) if i in months else F.col(f"`{c}`")
                         for i, c in enumerate(names)])
    return Report(rows, out.bad) if isinstance(out, Report) else rows


def read_cells(spark: SparkSession, path: str, ids, *, encoding: str = "UTF-16", sep: str = ",") -> DataFrame:
    """A report with more columns than a plan can carry: `ids` as columns, its other cells in the map ``cells``, by header.

    The header row is the first one that begins with `ids`; the rows above it are dropped, all rows below it and in the
    other part files are kept. A line is taken as text and only its filled cells become rows, placed by the separators
    before them. Empty cells are not in the map. A cell holds no line break. A row with a surplus cell that holds
    something raises when it is met.
    """
    ids = list(ids)
    raw = (spark.read.schema("line string").option("encoding", encoding).option("multiLine", True).option("sep", "\x01")
           .option("quote", "").option("header", False).csv(path))
    lines = materialize(raw.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.monotonically_increasing_id()}),
                        name="report-lines")
    s = re.escape(sep)
    # separators and a cell: quoted text (quotes in it doubled), or all up to the next one; possessive and without the empty
    # cells at the end, so one pass a line
    tokens = F.regexp_extract_all(F.rtrim("line", F.lit(sep)), F.lit(f'{s}*+(?:"[^"]*+(?:""[^"]*+)*+"(?={s}|$)|[^{s}]++)'), F.lit(0))

    def plain(c: Column) -> Column:
        quoted = c.startswith('"') & c.endswith('"') & (F.length(c) > 1)
        return F.when(quoted, F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)

    def placed(some: DataFrame) -> DataFrame:
        cells = some.select("_row", "_file", F.posexplode_outer(tokens).alias("_i", "_token"))
        cells = cells.withColumn("_cell", F.ltrim("_token", F.lit(sep)))
        before = F.sum(F.length("_token") - F.length("_cell")).over(Window.partitionBy("_row").orderBy("_i"))
        return cells.select("_row", "_file", before.alias("_place"), plain(F.col("_cell")).alias("_text"))

    first = F.transform(F.slice(tokens, 1, len(ids)), lambda c: F.trim(plain(F.ltrim(c, F.lit(sep)))))
    heads = (lines.filter(F.col("line").contains(ids[0])).filter(first == F.array(*[F.lit(i) for i in ids]))
             .groupBy("_file").agg(F.min("_row").alias("_row")).limit(2).collect())
    if not heads:
        raise ValueError(f"no header row {ids!r} in {path}")
    if len(heads) > 1:
        raise ValueError(f"{path} holds several reports: {', '.join(sorted(h['_file'] for h in heads))}")
    file, row = heads[0]
    names = placed(lines.filter(F.col("_row") == row)).select("_place", F.trim("_text").alias("_name"))
    cells = placed(lines.filter((F.col("_file") != file) | (F.col("_row") > row))).join(names, "_place", "left")
    told = F.raise_error(F.concat(F.lit("more cells than the header: "), F.col("_file"), F.lit(": "), F.col("_text")))
    filled = F.trim("_text") != ""
    text = F.when(filled & F.col("_name").isNull(), told.cast("string")).otherwise(F.col("_text"))
    entry = F.when(filled & (F.col("_place") >= len(ids)), F.struct(F.col("_name"), text))
    return cells.groupBy("_row").agg(
        *[F.max(F.when(filled & (F.col("_place") == i), F.col("_text"))).alias(c) for i, c in enumerate(ids)],
        F.map_from_entries(F.collect_list(entry)).alias("cells")).drop("_row")


def read_wide(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A wide monthly sheet that is stored as a table already."""
    return spark.read.format(fmt).load(path)


def land(df: DataFrame, path: str, partition_by=None) -> DataFrame:
    """Write a (text) source once to Parquet and return the Parquet reader."""
    from comparo.sources.writers import write_table

    write_table(df, path, partition_by=partition_by)
    return df.sparkSession.read.parquet(path)
