"""Report and register readers, the monthly append, landing."""

import datetime as dt
import uuid

import pytest

from comparo.session import checkpoint_dir


def test_read_register_keeps_every_row_below_the_header(spark, tmp_path):
    from comparo.sources.readers import read_register
    path = str(tmp_path / "padron.csv")
    junk = "".join(f"{i},free text,,\n" for i in range(17))
    with open(path, "w", encoding="utf-8") as f:
        f.write(junk + "GSX,NOMBRE,ENE,ENE\n12,Store A,SC,NSC\n13.0,Store B,sc,SC\n,no id,SC,SC\n14,,,\n")
    df = read_register(spark, path, ["GSX", "NOMBRE", "ENE", "ENE"])
    assert df.columns == ["GSX", "NOMBRE", "ENE", "ENE.1"]
    assert sorted((r.GSX or "") for r in df.collect()) == ["", "12", "13.0", "14"]
    with pytest.raises(ValueError):
        read_register(spark, path, ["GSX", "OTHER", "ENE", "ENE"])


def test_report_reader_keeps_sparse_rows_and_titles_with_commas(spark, tmp_path):
    from comparo.sources.readers import read_report_csv

    def write(name, text):
        with open(tmp_path / name, "w", encoding="utf-16") as f:
            f.write(text)
        return str(tmp_path / name)
    path = write("a.csv", 'Ventas, por tienda, 2024\n"a","b","c"\n1,x,y\n2,,\n3,,z\n')
    assert sorted(r.a for r in read_report_csv(spark, path, ["a", "b", "c"]).collect()) == ["1", "2", "3"]
    path = write("b.csv", "Title\nonly\n1\n2\n")
    assert sorted(r.only for r in read_report_csv(spark, path, ["only"]).collect()) == ["1", "2"]
    path = write("c.csv", "a,b\n1,2\n")
    assert [tuple(r) for r in read_report_csv(spark, path, ["a", "b"], usecols=["b"]).collect()] == [("2",)]
    with pytest.raises(ValueError):
        read_report_csv(spark, path, ["x", "y"])


def test_append_month_replaces_its_month_only(spark):
    from comparo.streaming.incremental import append_month
    path = f"{checkpoint_dir(spark)}/append-{uuid.uuid4().hex}"
    schema = "fecha_final date, k string, v int"
    november = spark.createDataFrame([(dt.date(2025, 11, 1), "A", 1)], schema)
    december = spark.createDataFrame([(dt.date(2025, 12, 1), "A", 2), (dt.date(2025, 12, 1), "B", 3)], schema)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    for month in (november, december, december):
        append_month(month, path, "fecha_final")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("A", 1), ("A", 2), ("B", 3)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_shared_folder_is_required_off_a_local_master(spark, monkeypatch):
    from comparo import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_read_delimited_and_read_any(spark, tmp_path):
    from comparo.plans.hours import margin
    from comparo.sources.readers import read_any, read_delimited
    path = str(tmp_path / "margen.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("Periodo;Tienda;RUBRO_CONCAT (grupo) 1;Importe Ars\n"
                "202504;12;MARGEN COMERCIAL;300,5\n202504;12;VENTA SIN TASA;1000\n")
    raw = read_delimited(spark, path, "Periodo string, Tienda string, rubro string, importe string")
    r = margin(raw).first()
    assert (r.no, r.mes, r.margen_comercial, r.venta_sin_tasa, r.ratio_margen) == \
        (12, "april", 300.5, 1000.0, 0.3)
    with pytest.raises(ValueError):
        read_any(spark, path, "xlsx")


def test_land_and_present_columns(spark):
    from comparo.operators.columns import normalize_columns, present_columns
    from comparo.sources.readers import land
    df = spark.createDataFrame([(2024, "x")], "`Año` int, `Punto Operacional` string")
    norm = normalize_columns(df)
    assert norm.columns == ["año", "punto_operacional"]
    assert present_columns(norm).columns == ["Año", "Punto operacional"]
    path = f"{checkpoint_dir(spark)}/land-{uuid.uuid4().hex}"
    back = land(norm, path, partition_by=["año"])
    assert back.count() == 1 and set(back.columns) == {"año", "punto_operacional"}


def _utf16(tmp_path, name, text):
    with open(tmp_path / name, "w", encoding="utf-16") as f:
        f.write(text)
    return str(tmp_path / name)


def test_a_file_without_the_header_raises_unless_it_is_a_part(spark, tmp_path):
    from comparo.sources.readers import read_report_csv
    (tmp_path / "r").mkdir()
    _utf16(tmp_path / "r", "a.csv", "Title\nA,B,C\n1,2,3\n")
    _utf16(tmp_path / "r", "b.csv", "Title\nA,b,C\n4,5,6\n")
    with pytest.raises(ValueError, match="b.csv"):
        read_report_csv(spark, str(tmp_path / "r"), ["A", "B", "C"])
    (tmp_path / "p").mkdir()
    _utf16(tmp_path / "p", "part-0.csv", "Title\nA,B,C\n1,2,3\n")
    _utf16(tmp_path / "p", "part-1.csv", "4,5,6\n")
    rows = read_report_csv(spark, str(tmp_path / "p"), ["A", "B", "C"], parts=True).collect()
    assert sorted(r.A for r in rows) == ["1", "4"]


RAGGED = 'Title, of three, cells, and more\nA,B\n1,x\n2,y,zz\n3,"q,r"\n4,,\n5,"s,t","u ""v"", w"\n6\n"7, 8",z,  \n9,a,,b\n'


def test_surplus_cells_raise(spark, tmp_path):
    from comparo.sources.readers import read_report_csv
    path = _utf16(tmp_path, "ragged.csv", RAGGED)
    df = read_report_csv(spark, path, ["A", "B"])
    with pytest.raises(Exception, match="more cells than the header"):
        df.collect()
    with pytest.raises(Exception, match="more cells than the header"):
        read_report_csv(spark, path, ["A", "B"], usecols=["B"]).collect()
    with pytest.raises(ValueError):
        read_report_csv(spark, path, ["A", "B"], bad_rows="skip")


def test_bad_rows_are_kept_whole(spark, tmp_path):
    from comparo.sources.readers import read_report_csv
    path = _utf16(tmp_path, "ragged.csv", RAGGED)
    read = read_report_csv(spark, path, ["A", "B"], bad_rows="keep")
    assert sorted((r.A, r.B) for r in read.rows.collect()) == [("1", "x"), ("3", "q,r"), ("4", None), ("6", None), ("7, 8", "z")]
    out = f"{checkpoint_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    assert read.quarantine(out) == 3
    bad = {(r.text, r.cells) for r in spark.read.parquet(out).collect()}
    assert bad == {("2,y,zz", 3), ('5,"s,t","u ""v"", w"', 3), ("9,a,,b", 4)}
    assert {r.file.rsplit("/", 1)[1] for r in read.bad.collect()} == {"ragged.csv"}
    only = read_report_csv(spark, path, ["A", "B"], bad_rows="keep", usecols=["B"])
    assert only.rows.columns == ["B"] and only.bad.count() == 3


def test_bad_numbers_are_null_or_raise(spark):
    from comparo.plans.ingest import SALES_REPORT, lines_from_report
    raw = spark.createDataFrame([("2024", "Enero 2024", "F", "12-X", "s", "t", "u", "1.2x", "3")],
                                ", ".join(f"`{c}` string" for c in SALES_REPORT))
    assert lines_from_report(raw, on_error="null").first().sales is None
    with pytest.raises(Exception):
        lines_from_report(raw).collect()


def test_header_months():
    from comparo.sources.readers import header_month
    april = dt.date(2024, 4, 1)
    for text in ("2024-04-01 00:00:00", "2024-04-01", "2024-4", "01/04/2024", "4/2024", "Abril 2024", "abril-24", "abr-24",
                 " Apr 2024 ", "abr. 24"):
        assert header_month(text) == april, text
    for text in ("", "no", "2024", "Total 2024", "13/2024", "YTD24", "12-NAME"):
        assert header_month(text) is None, text


def test_sheet_columns_come_from_its_header(spark, tmp_path):
    from comparo.sources.readers import read_sheet
    path = str(tmp_path / "sheet.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('Costo por hora, tiendas\n\n"NO", Nombre ,notes,notes,"01/05/2024",abr-24,Total\n'
                '12,"Uno, dos",a,b,"1.234,5",7,x\n13,Tres,,,n/a,"-0,25",\n')
    df = read_sheet(spark, path, ["no", "nombre"])
    assert df.columns == ["NO", "Nombre", "notes", "notes.1", "2024-05-01 00:00:00", "2024-04-01 00:00:00", "Total"]
    assert sorted(tuple(r) for r in df.collect()) == [("12", "Uno, dos", "a", "b", 1234.5, 7.0, "x"), ("13", "Tres", None, None, None, -0.25, None)]
    with pytest.raises(ValueError):
        read_sheet(spark, path, ["no", "zona"])


def test_tickets_by_sector_from_text(spark):
    from comparo.plans.ingest import tickets_from_report
    raw = spark.createDataFrame([("2024", "Enero 2024", "F", "12-X", "AL", "Tickets", "12.345")],
                                "`Año` string, Mes string, Direccion string, `Punto Operacional` string, Sector string, "
                                "Indicadores string, `Cantidad de Tickets` string")
    r = tickets_from_report(raw, by_sector=True).first()
    assert (r.year, r.month, r.store_id, r.sector, r.tickets) == (2024, 1, 12, "AL", 12345)
