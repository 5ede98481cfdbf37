"""Report invariants, sinks and plan shape on the sf0.001 tables."""

import re

from pyspark.sql import functions as F

from comparo.catalog import MONTH, QUERIES, YEARS, measures
from comparo.plans import monthly, ytd
from comparo.sources import proxy as X


def test_store_sums_equal_format_and_total(spark, sf_small):
    m, reg = measures(spark, sf_small), X.register(spark, sf_small)
    total = {r.measure: r.current for r in ytd.ytd_report(m, reg, "total", YEARS, MONTH).collect()}
    fmt = ytd.ytd_report(m, reg, "format", YEARS, MONTH)
    by_m = {r.measure: r.s for r in fmt.groupBy("measure").agg(F.sum("current").alias("s")).collect()}
    store = ytd.ytd_report(m, reg, "store", YEARS, MONTH).agg(
        *[F.sum(f"{k}_current").alias(k) for k in ("VCT", "VOL", "DEB")]).first()
    for k in ("VCT", "VOL", "DEB"):
        assert abs(total[k] - by_m[k]) < 1e-6 * max(1, total[k])
        assert abs(total[k] - store[k]) < 1e-6 * max(1, total[k])


def test_one_pass_equals_separate(spark, sf_small):
    m, reg = measures(spark, sf_small), X.register(spark, sf_small)
    a = monthly.monthly_reports(m, reg, YEARS, MONTH, one_pass=True, sort=False)
    b = monthly.monthly_reports(m, reg, YEARS, MONTH, one_pass=False, sort=False)
    for name in a:
        assert a[name].exceptAll(b[name]).count() == 0, name
        assert b[name].exceptAll(a[name]).count() == 0, name


def test_contribution_sums_to_format_growth(spark, sf_small):
    df = QUERIES["briefing_family_contribution"](spark, sf_small)
    for r in df.groupBy("format").agg(F.sum("contribution").alias("c"), F.sum("gap").alias("g"),
                                       F.sum("base").alias("b")).collect():
        assert abs(r.c - r.g / r.b) < 1e-9


def test_csv_round_trip_and_append_idempotent(spark, sf_small):
    rt = QUERIES["csv_utf16_roundtrip"](spark, sf_small)
    src = QUERIES["ytd_format"](spark, sf_small)
    assert rt.exceptAll(src.select(*rt.columns)).count() == 0
    once = QUERIES["share_last_closed_month"](spark, sf_small)
    twice = QUERIES["append_month_idempotent"](spark, sf_small)
    assert twice.count() == once.count()


def test_report_reader_drops_title_and_header(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    with open(path, "w", encoding="utf-16") as f:
        f.write('"Reporte de ventas"\n"Año","Mes","Ventas c/impuesto"\n'
                '"2024","Enero 2024","1.234,50"\n"2025","Enero 2025","10,00"\n')
    from comparo.sources.readers import read_report_csv
    df = read_report_csv(spark, path, ["Año", "Mes", "Ventas c/impuesto"])
    assert sorted(r["Ventas c/impuesto"] for r in df.collect()) == ["1.234,50", "10,00"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_the_plans(spark, sf_small):
    for key in ("ytd_store", "yoy_store_family", "briefing_consolidated_matrix", "operating_result"):
        assert "PythonUDF" not in QUERIES[key](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_read_the_folders_of_their_months(spark, sf_small):
    """The fact is landed by year and month; every yoy_ and ytd_ plan has its period as partition filters, and a
    year-to-date plan reads fewer files than there are."""
    keys = [k for k in QUERIES if k.startswith(("yoy_", "ytd_")) and not k.endswith("_by_format")]
    assert len(keys) > 20
    for key in keys:
        scans = [x for x in _plan(QUERIES[key](spark, sf_small)).splitlines() if "FileScan" in x and "/fact-" in x]
        assert scans, key
        for x in scans:
            filters = x.split("PartitionFilters: [")[1].split("]")[0]
            assert "year" in filters and "month" in filters, (key, x)
            assert "sales" in x or "order_key" in x
    all_files = X.lines(spark, sf_small)
    part = X.lines(spark, sf_small, [("2001-01-01", "2001-08-01")])
    assert 0 < len(part.inputFiles())
    read = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and part.count() < all_files.count() / 4


def test_tickets_and_totals_do_not_read_product_columns(spark, sf_small):
    tickets = _plan(X.tickets(spark, sf_small))
    assert "sector" not in tickets and "sales" not in tickets


def test_comparable_stores_join_below_the_aggregate(spark, sf_small):
    """With the flag a stored column, rows of other stores never reach an aggregate, and
    tickets do not read the part table."""
    from comparo.plans.measures import register_for_month, to_measures
    from comparo.session import checkpoint_dir
    path = f"{checkpoint_dir(spark)}/register"
    X.register(spark, sf_small).write.mode("overwrite").parquet(path)
    reg = spark.read.parquet(path)
    m = to_measures(X.lines(spark, sf_small), X.tickets(spark, sf_small),
                    stores=register_for_month(reg, MONTH, cols=()))
    plan = _optimized(ytd.ytd_report(m, reg, "store", YEARS, MONTH))
    facts = plan.split("Aggregate")
    semi = [i for i, part in enumerate(facts) if "LeftSemi" in part]
    assert len(semi) >= 2, plan                      # once for the lines, once for the tickets
    assert plan.count("p_name") == 0 or plan.count("part.parquet") <= 1
    tickets = _optimized(X.tickets(spark, sf_small))
    assert "p_partkey" not in tickets and "p_name" not in tickets


def test_ytd_limit_total_switch(spark, sf_small):
    m, reg = measures(spark, sf_small, grain="store"), X.register(spark, sf_small)
    limited = {r.measure: r.current for r in
               ytd.ytd_report(m, reg, "total", YEARS, MONTH).collect()}
    whole = {r.measure: r.current for r in
             ytd.ytd_report(m, reg, "total", YEARS, MONTH, limit_total=False).collect()}
    assert all(whole[k] >= limited[k] for k in limited)
    assert any(whole[k] > limited[k] for k in limited)        # Aug 2001 exists in the data


def test_leaf_detail_is_left_out_by_the_first_format(spark, sf_small):
    """One mixed input, both branches: the first format of the input decides for the whole table."""
    m, reg = measures(spark, sf_small), X.register(spark, sf_small)
    cube = ytd.ytd_cube(m, reg, YEARS, MONTH)
    first = ytd.first_format(cube)
    rows = sorted((r.year, r.month, r.store_id, r.format) for r in cube.select("year", "month", "store_id", "format").collect())
    assert first == rows[0][3] and len({r[3] for r in rows}) > 1
    other = next(f for f in X.FORMATS if f != first)
    whole = ytd.leaf_detail(m, reg, YEARS, MONTH)
    assert ytd.leaf_detail(m, reg, YEARS, MONTH, skip_format=first.lower()).count() == 0
    assert ytd.leaf_detail(m, reg, YEARS, MONTH, skip_format=other).count() == whole.count() > 0
    assert ytd.first_format(cube.limit(0)) is None


def test_extended_hours_have_sales_all_year(spark, sf_small):
    """Sales in several months of the report, and an order that is not the order of the store ids."""
    from comparo.plans.hours import REPORT_MONTHS
    wide = QUERIES["hours_wide"](spark, "/root/testdata/sf0.01").toPandas()
    rocs = [m for m in REPORT_MONTHS if wide[f"roc_{m}"].dropna().nunique() > 1]
    sold = [m for m in REPORT_MONTHS if (wide[f"vct_{m}"].fillna(0) > 0).any()]
    assert len(rocs) >= 6 and len(sold) >= 6
    report = QUERIES["extended_hours_report"](spark, "/root/testdata/sf0.01").toPandas().sort_values("row_no")
    assert list(report["No"]) != sorted(report["No"]) and report["Roc Diciembre"].is_monotonic_increasing
    assert len(X.slot_sales_wide(spark, sf_small).columns) == 3 + X.table(spark, sf_small, "supplier").count()


def test_events_are_read_once_for_the_operating_result(spark, sf_small):
    plan = _plan(QUERIES["operating_result"](spark, sf_small))
    assert sum("FileScan" in x and "events.parquet" in x for x in plan.splitlines()) == 1      # the margins; the slots are written


def test_unknown_month_raises():
    import pytest

    from comparo.functions.labels import month_column, month_number
    assert month_column("Julio") == "jul" and month_column(12) == "dic"
    assert month_number("SEPTIEMBRE") == 9
    with pytest.raises(ValueError):
        month_column("Juli")


def test_hours_report_of_a_spring_sample(spark):
    """The last month with sales orders the report; a present month without a value is 0, an
    absent one NULL; headers are Spanish."""
    from comparo.plans import hours as H
    ids = "no long, nombre string, localidad string, zona string, `gerente regional` string, " \
          "horario_domingo string, horario_anterior string, mes string"
    metrics = ", ".join(f"{m} double" for m in H.METRICS)

    def row(no, month, roc):
        return (no, f"S{no}", "L", "Z", "G", "SI", "08:00 a 20:00", month, *[1.0] * (len(H.METRICS) - 1), roc)
    result = spark.createDataFrame([row(1, "april", 5.0), row(1, "may", 9.0), row(2, "april", 1.0),
                                    row(2, "may", -3.0), row(3, "april", 2.0), row(4, "may", None)], f"{ids}, {metrics}")
    sundays = spark.createDataFrame([("2024-04-07", "april"), ("2024-05-05", "may"), ("2024-01-07", "january")],
                                    "day string, month string").select(F.to_date("day").alias("date"), "month")
    last = H.last_sales_month(sundays)
    assert last == "may"
    out = H.presented(H.order_by_last_month(H.hours_wide(result), last)).collect()
    assert [r["No"] for r in out] == [2, 4, 1, 3]
    by = {r["No"]: r for r in out}
    assert by[4]["Roc Mayo"] == 0.0 and by[3]["Roc Mayo"] is None and by[4]["Roc Abril"] is None
    assert out[0].__fields__[7] == "Horas autorizadas Abril" and out[0].__fields__[-1] == "Roc Diciembre"
    assert not any("Enero" in c or "Marzo" in c for c in out[0].__fields__)


def test_briefing_reports_dict(spark, sf_small):
    from comparo.catalog import brief_inputs
    from comparo.plans.briefing import briefing_reports
    store, sector, family = brief_inputs(spark, sf_small)
    reps = briefing_reports(store, sector, family, X.register(spark, sf_small), X.BRIEF_MONTH,
                            X.SECTORS, labels=X.BRIEF_YEARS)
    expect = {"store_comparable": "briefing_store_comparable", "format_all": "briefing_format_all",
              "family_contribution": "briefing_family_contribution",
              "consolidated_matrix": "briefing_consolidated_matrix"}
    for name, key in expect.items():
        q = QUERIES[key](spark, sf_small)
        assert reps[name].exceptAll(q.select(*reps[name].columns)).count() == 0, name


def test_extended_hours_and_history_ingest(spark, sf_small):
    from comparo.plans.hours import MONTHS_LOWER, extended_hours
    out = extended_hours(X.slot_sales_wide(spark, sf_small), X.staff_cost_wide(spark, sf_small),
                         X.authorised_hours_wide(spark, sf_small), X.margin_long(spark, sf_small),
                         months=MONTHS_LOWER)
    assert out.count() == QUERIES["hours_wide"](spark, sf_small).count()

    from comparo.functions.text import format_locale_decimal
    from comparo.plans.ingest import history_from_reports
    m = measures(spark, sf_small, grain="store")
    month_es = F.get(F.array(*[F.lit(x) for x in
                                ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio",
                                 "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]]),
                     F.col("month") - 1)
    def text(measure, header, fmt):
        return m.filter(F.col("measure") == measure).select(
            F.col("year").cast("string").alias("Año"),
            F.concat_ws(" ", month_es, F.col("year").cast("string")).alias("Mes"),
            F.col("format").alias("Direccion"),
            F.concat(F.col("store_id").cast("string"), F.lit(" X")).alias("Punto Operacional"),
            fmt(F.col("value")).alias(header))
    hist = history_from_reports(
        text("VCT", "Ventas c/impuesto", lambda c: format_locale_decimal(c, 6)),
        text("VOL", "VOLUMEN", lambda c: format_locale_decimal(c, 2)),
        text("DEB", "Cant. Tickets por Local",
             lambda c: F.translate(F.format_number(c.cast("bigint"), 0), ",", ".")))
    a = hist.groupBy("measure").agg(F.sum("value").alias("v"))
    b = m.groupBy(F.lower("measure").alias("measure")).agg(F.sum("value").alias("v"))
    assert a.exceptAll(b).count() == 0


def test_report_set_with_checkpoint(spark, sf_small):
    """The lineage-cutting path (checkpoint in spark.checkpoint.dir) gives the
    same tables as the cached one."""
    m, reg = measures(spark, sf_small), X.register(spark, sf_small)
    a = ytd.ytd_reports(m, reg, YEARS, MONTH, reuse="checkpoint", sort=False)
    b = ytd.ytd_reports(m, reg, YEARS, MONTH, reuse="cache", sort=False)
    for name in ("store", "family", "province_format"):
        assert a[name].exceptAll(b[name]).count() == 0, name
    assert spark.sparkContext.getCheckpointDir()


def _scans(df, folder="/fact-"):
    return sum("FileScan" in x and folder in x for x in _plan(df).splitlines())


def test_few_passes_over_the_lines(spark, sf_small):
    """Scans of the fact with shuffle joins only. Plans over a table written on the way read the fact in the job that
    writes it, once: the rows of the briefing are one plan with one scan."""
    from comparo.catalog import brief_family, brief_store_sector
    from comparo.plans.measures import with_first_sector
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert _scans(with_first_sector(X.lines(spark, sf_small), packaging=X.PACKAGING)) == 1
        assert all(_scans(f) == 0 for f in brief_store_sector(spark, sf_small))
        assert _scans(brief_family(spark, sf_small)) == 1
        for key, scans in {"briefing_consolidated_matrix": 0, "briefing_four_levels": 0, "briefing_family_contribution": 0,
                           "comparison_union": 1, "ytd_store": 1, "history_growth_comparable": 1}.items():
            assert _scans(QUERIES[key](spark, sf_small)) == scans, key
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_store_tickets_add_up_over_sectors(spark):
    """A ticket with lines of several sectors counts once in the store, once in each sector."""
    from comparo.plans.measures import STORE_KEYS, measures_of, with_first_sector
    lines = spark.createDataFrame(
        [(2001, 7, "f", 1, "s", sector, "fam", 1.0, 2.0, order) for sector, order in
         [("a", 1), ("b", 1), ("a", 1), ("b", 2), (None, 3), ("a", 3), ("a", None), (None, 4)]]
        + [(2001, 7, "f", 2, "t", "a", "fam", None, None, None)],
        "year int, month int, format string, store_id long, store string, sector string, family string, "
        "sales double, units double, order_key long")
    rows = with_first_sector(lines)
    of = lambda f, *keys: {tuple(r[k] for k in keys): float(r.value) for r in f.collect()}
    store = of(measures_of(rows, STORE_KEYS, "_store_tickets"), "store_id", "measure")
    assert store == {(1, "DEB"): 4.0, (1, "VCT"): 8.0, (1, "VOL"): 16.0, (2, "DEB"): 0.0}
    sector = of(measures_of(rows, STORE_KEYS + ["sector"], "_tickets"), "store_id", "sector", "measure")
    assert {k: v for k, v in sector.items() if k[2] == "DEB"} == {
        (1, "a", "DEB"): 2.0, (1, "b", "DEB"): 2.0, (1, None, "DEB"): 2.0, (2, "a", "DEB"): 0.0}


def test_one_ticket_number_holds_a_third_of_the_lines(spark):
    """Lines of one ticket are summed before they are shuffled."""
    from comparo.plans.measures import with_first_sector
    n = 3000
    lines = spark.range(n).selectExpr(
        "2001 as year", "7 as month", "'f' as format", "1L as store_id", "'s' as store", "concat('x', id % 3) as sector",
        "'fam' as family", "1.0D as sales", "1.0D as units", "if(id % 3 = 0, 1L, id) as order_key")
    rows = with_first_sector(lines)
    assert {(r.sector, int(r._tickets), int(r._store_tickets)) for r in rows.collect()} == {
        ("x0", 1, 1), ("x1", n // 3, n // 3 - 1), ("x2", n // 3, n // 3)}
    plan = _plan(rows)
    assert "partial_sum" in plan


def test_rollup_reads_the_smallest_table(spark):
    from comparo.operators.lattice import Hubs
    df = spark.createDataFrame([("f", "p", "s", k, m, "u", 1) for k in ("a", None) for m in ("x", "y")],
                               "format string, province string, store string, sector string, family string, measure string, value long")
    hubs = Hubs(df, [("format", "province", "store", "sector"), ("format", "province", "store")], always=("measure",))
    assert set(hubs.covering(["family"]).columns) == set(df.columns) and hubs.input.count() == 4
    assert set(hubs.covering(["sector"]).columns) == {"format", "province", "store", "sector", "measure", "value"}
    assert set(hubs.covering([]).columns) == {"format", "province", "store", "measure", "value"}
    assert hubs.covering([]).first().value == 4 and hubs.covering(["sector"]).count() == 2
    import pytest
    with pytest.raises(ValueError):
        hubs.covering(["other"])


def test_row_numbers_follow_the_order_without_one_task(spark):
    from comparo.operators.sorts import numbered
    conf = {"spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(10_000).selectExpr("id * 7919 % 10007 as k").repartition(5).orderBy("k")
        out = numbered(df)
        rows = sorted((r.row_no, r.k) for r in out.collect())
        assert [n for n, _ in rows] == list(range(1, 10_001)) and [k for _, k in rows] == sorted(k for _, k in rows)
        assert "SinglePartition" not in _plan(out) and "Window" not in _plan(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert numbered(spark.range(0).orderBy("id")).count() == 0


def test_no_single_task_in_ordered_reports(spark, sf_small):
    for key in [k for k in QUERIES if k.startswith("order_")] + ["extended_hours_report"]:
        assert "SinglePartition" not in _plan(QUERIES[key](spark, sf_small)), key


def test_lines_at_product_grain_are_summed_after_one_exchange(spark, sf_small):
    """Nearly every line is a group there: a sum before the shuffle would hold all lines of a task's files."""
    from comparo.plans.measures import to_measures
    m = to_measures(X.lines(spark, sf_small), packaging=X.PACKAGING)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
    below = plan.split("Exchange")[-1]
    assert "HashAggregate" not in below
    rows = spark.createDataFrame(
        [(2000, 1, "MAXI", 1, "1-S", "A", None, "F", 2, 3), (2000, 1, "MAXI", 1, "1-S", "A", None, "F", 5, None),
         (2000, 1, "MAXI", 1, "1-S", None, None, "HOT RING", 1, 9), (None, 1, "MAXI", 1, "1-S", "A", "B", "F", 7, 7)],
        "year int, month int, format string, store_id long, store string, sector string, section string, family string, "
        "sales int, units int")
    got = to_measures(rows, packaging=X.PACKAGING).collect()
    assert sorted((r.family, r.measure, int(r.value)) for r in got) == [("F", "VCT", 7), ("F", "VOL", 3), ("HOT RING", "VCT", 1)]


def test_labels_of_a_store_are_neither_landed_nor_shuffled(spark, sf_small):
    """Format and store follow from the store's key: lines and tickets carry the key alone through their exchanges."""
    plan = X.tickets(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert all("format" not in x and "store#" not in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan))
    landed = spark.read.parquet(*{f.split("/year=")[0] for f in X.lines(spark, sf_small).inputFiles()})
    assert not {"format", "store"} & set(landed.columns)
    want = X.derived_lines(spark, sf_small)
    assert X.lines(spark, sf_small).select(want.columns).exceptAll(want).isEmpty()
    keys = ["year", "month", "format", "store_id", "store"]
    n = want.groupBy(*keys).agg(F.countDistinct("order_key").alias("tickets"))
    got = X.tickets(spark, sf_small)
    assert got.exceptAll(n).isEmpty() and n.exceptAll(got).isEmpty()
