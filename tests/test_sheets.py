"""Sheets with more columns than a plan can carry: a half-hour report as cells, its file, its unpivot."""

import uuid

import pytest
from pyspark.sql import functions as F

from comparo.plans import hours as H
from comparo.session import checkpoint_dir
from comparo.sources import proxy as X
from comparo.sources.readers import read_cells
from comparo.sources.writers import write_sheet_csv

IDS = ["year", "date_text", "slot_text"]


@pytest.fixture
def path(spark):
    return f"{checkpoint_dir(spark)}/sheet-{uuid.uuid4().hex}"


def slots(df):
    return sorted(tuple(r) for r in df.collect())


def tables(spark, path, n_stores):
    """Supplier and events of a chain of `n_stores`, sales in every store, some without a value, store or time."""
    spark.range(n_stores).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3607)
    spark.range(3 * n_stores).select(
        F.col("id").alias("event_id"), F.when(F.col("id") != 11, ts).alias("ts"),
        F.when(F.col("id") != 5, F.col("id")).alias("user_id"),
        F.when(F.col("id") % 7 == 3, "view").otherwise("purchase").alias("event_type"),
        F.when(F.col("id") % 9 != 4, F.col("id") * 1000.25).alias("value")).write.parquet(f"{path}/events.parquet")
    return path


def test_a_report_of_many_stores_has_few_columns(spark, path):
    """As columns, this many stores are more than Spark plans in any useful time."""
    d = tables(spark, path, 30_000)
    sheet = X.slot_sales_sheet(spark, d)
    assert sheet.columns == [*IDS, "cells"]
    long = H.slot_sales(sheet)
    sold = spark.read.parquet(f"{d}/events.parquet").filter(
        (F.col("event_type") == "purchase") & F.col("value").isNotNull() & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    assert long.count() == sold.count() and long.select("store_id").distinct().count() > 25_000
    assert long.agg(F.sum("vct")).first()[0] == sold.agg(F.sum(F.col("value").cast("decimal(12,2)"))).first()[0]


def test_cells_and_columns_give_the_same_slots(spark, sf_small):
    assert slots(H.slot_sales(X.slot_sales_sheet(spark, sf_small))) == slots(H.slot_sales(X.slot_sales_wide(spark, sf_small)))


def test_the_file_of_a_wide_sheet_holds_every_column_and_row(spark, path):
    sheet = spark.createDataFrame(
        [("2024", "1 de Enero de 2024", "a", {"7 x": "1,50", "2 \"q\", y": "2"}), ("2024", "1 de Enero de 2024", "b", {}),
         ("2024", "1 de Enero de 2024", "a", {"1 z": "3", "9999 s": " 4"}), ("Total", "1 de Enero de 2024", None, None)],
        "year string, date_text string, slot_text string, cells map<string,string>")
    names = {1: "1 z", 2: '2 "q", y', 7: "7 x"} | {i: f"{i} s" for i in range(10, 25_000)} | {9999: "9999 s"}
    header = spark.createDataFrame([(k, v) for k, v in names.items()], "store long, header string")
    write_sheet_csv(sheet, IDS, header, path, title="Ventas, tiendas")
    lines = (spark.read.schema("line string").option("encoding", "UTF-16").option("multiLine", True).option("sep", "\x01")
             .option("quote", "").csv(path))
    assert lines.count() == 2 + 4
    full = lines.filter(~F.col("line").contains("Ventas"))
    bare = F.regexp_replace("line", '"(?:[^"]|"")*"', "")
    assert {r[0] for r in full.select(F.length(bare)).collect()} == {len(names) + 2}       # a separator for every column
    back = read_cells(spark, path, IDS)
    found = sorted(((*r[:3], r["cells"]) for r in back.collect()), key=repr)
    assert found == sorted(((*r[:3], r["cells"] or {}) for r in sheet.collect()), key=repr)


def test_cells_reader_wants_one_header_and_no_surplus(spark, tmp_path):
    def write(name, text):
        with open(tmp_path / name, "w", encoding="utf-16") as f:
            f.write(text)
        return str(tmp_path / name)
    path = write("a.csv", 'Title, with comma\n"year","k","1 x","2 y"\n2024,a,,"5,5"\n2024,,"",\n2024,b,1\n')
    assert sorted((r.year, r.k or "", r.cells) for r in read_cells(spark, path, ["year", "k"]).collect()) == [
        ("2024", "", {}), ("2024", "a", {"2 y": "5,5"}), ("2024", "b", {"1 x": "1"})]
    with pytest.raises(ValueError):
        read_cells(spark, path, ["year", "other"])
    path = write("b.csv", "year,k,1 x\n2024,a,1,surplus\n")
    with pytest.raises(Exception, match="more cells than the header"):
        read_cells(spark, path, ["year", "k"]).collect()


def test_report_files_stay_small_and_no_file_is_one_task(spark, path, monkeypatch):
    from comparo.sources import writers
    from comparo.sources.readers import read_report_csv
    monkeypatch.setattr(writers, "FILE_BYTES", 1)          # the fewest rows a file that are allowed: 1000
    df = spark.range(0, 4500, 1, 1).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    writers.write_locale_csv(df, path, title="Informe, grande")
    files = {r[0]: r[1] for r in spark.read.option("encoding", "UTF-16").option("multiLine", True).csv(path)
             .groupBy(F.col("_metadata.file_path")).count().collect()}
    assert len(files) >= 5 and max(files.values()) == 1000
    back = read_report_csv(spark, path, ["a", "b"], parts=True)
    assert sorted(int(r.a) for r in back.collect()) == list(range(4500))
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan                      # the header rows go to the rows, not rows to their file's task


def test_report_files_are_written_packed(spark, path, sf_small, monkeypatch):
    """A packed report holds the same text; the queries that write all lines as a report write it so."""
    from comparo import catalog
    from comparo.sources import writers
    from comparo.sources.readers import read_report_csv
    rows = [(f"{i}", 'norte, sur\no este' if i % 3 else None, "MARKET, SUR") for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    sizes = {}
    for kind in ("none", "gzip"):
        writers.write_locale_csv(df, f"{path}-{kind}", title="Informe, todo", compression=kind)
        assert sorted(map(tuple, read_report_csv(spark, f"{path}-{kind}", ["a", "b", "c"], parts=True).collect()), key=str) == sorted(rows, key=str)
        files = spark.read.format("binaryFile").load(f"{path}-{kind}").select("path", "length").collect()
        assert all(r.path.endswith(".csv.gz") == (kind == "gzip") for r in files)
        sizes[kind] = sum(r.length for r in files)
    assert sizes["gzip"] * 4 < sizes["none"]
    asked, write = [], writers.write_locale_csv
    monkeypatch.setattr(writers, "write_locale_csv", lambda *a, **kw: asked.append(kw.get("compression")) or write(*a, **kw))
    for name in ("report_file_ingest", "report_bad_rows"):
        catalog.QUERIES[name](spark, sf_small)
    assert asked == ["gzip"] * 3


def test_heavy_products_are_found_without_the_join_to_orders(spark, sf_small, monkeypatch):
    seen = []
    real = X.heavy_keys
    monkeypatch.setattr(X, "heavy_keys", lambda df, key, **kw: seen.append(df) or real(df, key, **kw))
    n = X.derived_lines(spark, sf_small).count()
    assert n == X.table(spark, sf_small, "lineitem").count()
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
