import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.operators import forms as Fo
from slipwatch.operators import harvest as H
from slipwatch.operators import panel as P
from slipwatch.operators.latest import latest_state
from slipwatch.sources import readers as Rd
from slipwatch.sources import writers as Wr
from slipwatch.streaming import months as Mn
from slipwatch.streaming.months import load_months, loaded, month_stream

RECORDS = [
    {"ProjectId": 7, "ProjectName": "Dam", "SectorName": "Water", "OriginalCost": 100, "Expenditure": "12.5", "PhysicalProgress": 5, "RevisedDate": "31/12/2026", "freeze_month": "2025-07", "harvest_sector_id": "108"},
    {"ProjectId": 0, "ProjectName": "skipped"},
    {"ProjectName": "no id"},
    {"ProjectId": 8, "Expenditure": None, "Unknown": 3, "freeze_month": "2025-07", "harvest_sector_id": "108"},
]


def test_snapshots_from_array_lines_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in RECORDS))
    array = Rd.read_snapshots(spark, str(tmp_path / "a.json"))
    lines = Rd.read_snapshots(spark, str(tmp_path / "b.json"), lines=True)
    for df in (array, lines):
        rows = {r.project_id: r for r in df.collect()}
        assert set(rows) == {7, 8}
        assert rows[7].original_cost == "100" and rows[8].expenditure is None
    text = spark.createDataFrame([(json.dumps({**r, "harvest_seq": i}),) for i, r in enumerate(RECORDS)], "value string")
    assert {r.harvest_seq for r in Rd.parse_snapshots(text).collect()} == {0, 3}


def test_dated_source_wins_per_project(spark):
    dated = spark.createDataFrame([(1, "2025-01")], "project_id int, report_month string")
    undated = spark.createDataFrame([(1, "x"), (2, "y")], "project_id int, remarks string")
    got = sorted((r.project_id, r.report_month, r.remarks) for r in Rd.prefer_dated(dated, undated).collect())
    assert got == [(1, "2025-01", None), (2, None, "y")]


def test_form_csv(spark, tmp_path):
    path = tmp_path / "forms.csv"
    path.write_text(
        "Project ID,Project Name,Sector,Sanctioned Cost,Expenditure,Physical Progress,Dispute Status,Colour\n"
        'A-01,Bridge, roads ,"1,000",100,20,high court stay,red\n'
        "A-02,Tunnel,,900,n/a,20,,blue\n"
    )
    rows, ignored = Rd.read_form_csv(spark, str(path))
    a, b = rows.orderBy("project_id").collect()
    assert ignored == ["Colour"]
    assert (a.sector, a.original_cost, a.dispute_status, a.months_elapsed) == ("Road Transport & Highways", 1000.0, "HIGH_COURT_STAY", 12.0)
    assert (b.sector, b.expenditure, b.dispute_status) == ("Railways", None, "NONE")
    assert [r.errors for r in Fo.validate(rows).orderBy("project_id").collect()] == [[], ["expenditure: missing"]]


def test_form_and_panel_round_trip(spark, tmp_path):
    form = Fo.type_form(spark.createDataFrame([("A-01", "Bridge", "100", "10", "5")], "project_id string, project_name string, original_cost string, expenditure string, physical_progress string"))
    Wr.write_forms(form, str(tmp_path / "j"), str(tmp_path / "c"))
    assert Rd.read_form_json(spark, str(tmp_path / "j")).collect() == form.collect()
    assert Rd.read_form_csv(spark, str(tmp_path / "c"))[0].collect() == form.collect()
    panel = spark.createDataFrame([(1, "2025-01"), (2, "2025-02")], "project_id int, as_of_month string")
    Wr.write_panel(panel, str(tmp_path / "p"))
    Wr.write_scores(panel, str(tmp_path / "s"))
    Wr.write_meta(panel.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    assert sorted(Rd.read_panel(spark, str(tmp_path / "p")).select("project_id", "as_of_month").collect()) == sorted(panel.collect())
    plan = Rd.read_panel(spark, str(tmp_path / "p")).filter("as_of_month = '2025-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(as_of_month" in plan


def harvest(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "report_month string, harvest_sector_id string, project_id int, v string, harvest_seq bigint")


def test_slices(spark):
    df = harvest(spark, [("2025-01", "1", 7, "a"), ("2025-01", "1", 7, "b"), ("2025-01", "2", 7, "c"), ("2025-02", "1", 7, "a")])
    assert sorted(r.v for r in H.slice_collapse(df).collect()) == ["a", "a", "c"]
    assert H.resume(df, df.filter("report_month = '2025-01' and harvest_sector_id = '1'")).count() == 2
    bounds = spark.createDataFrame([(date(2024, 12, 1), date(2025, 2, 1))], "first date, last date")
    months = H.month_spine(bounds)
    assert [r[0] for r in months.orderBy("report_month").collect()] == ["2024-12", "2025-01", "2025-02"]
    counts = H.slice_counts(df, months, df.select("harvest_sector_id").distinct())
    assert {(r[0], r[1]): r[2] for r in counts.collect()} == {("2024-12", "1"): 0, ("2024-12", "2"): 0, ("2025-01", "1"): 2, ("2025-01", "2"): 1, ("2025-02", "1"): 1, ("2025-02", "2"): 0}
    assert tuple(H.harvest_summary(df).first()) == (4, 1)


def test_latest_state(spark):
    cols = ["project_id", "harvest_seq", *[c for c in S.SNAPSHOT_FIELDS.values() if c != "project_id"]]
    base = dict.fromkeys(cols)

    def row(**kw):
        return tuple({**base, **kw}[c] for c in cols)

    rows = [
        row(project_id=1, harvest_seq=0, original_cost="100", expenditure="40", physical_progress="50", project_name="Road"),
        row(project_id=1, harvest_seq=1, original_cost="100", expenditure="60", physical_progress="40", revised_cost="0", project_name="Court road", sector_name="Rural Roads",
            sanction_date="01/01/2024", original_end_date="31/12/2025", revised_date="31/12/2026", remarks="forest land", company_name="x" * 70),
        row(project_id=2, harvest_seq=2, original_cost="0", expenditure="5"),
        row(project_id=3, harvest_seq=3, original_cost="10", expenditure="500", physical_progress="7", delayed_time="9"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c in ('project_id', 'harvest_seq') else 'string'}" for c in cols))
    got = {r.project_id: r for r in latest_state(df).collect()}
    assert set(got) == {1, 3}
    a = got[1]
    assert (a.expenditure_change_recent, a.progress_change_recent, a.revised_cost, a.sector) == (20.0, -5.0, 100.0, "Roads & Highways")
    assert (a.dispute_status, a.clearance_pending_days, a.overdue_milestones, len(a.implementing_agency)) == ("ARBITRATION", 195, 1, 60)
    b = got[3]
    assert (b.expenditure, b.current_delay_months, b.months_elapsed, b.project_name, b.implementing_agency) == (5.0, 9.0, 12.0, "Central Project 3", "CPSE")
    assert "WindowGroupLimit" in latest_state(df)._jdf.queryExecution().toString()


def test_month_load_resumes_and_keeps_quiet_months(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = harvest(spark, [("2025-01", "1", 7, "a"), ("2025-01", "1", 7, "b"), ("2025-01", "2", 8, "c")])
    first.write.parquet(f"{source}/m1")
    stream = month_stream(spark, source + "/*", first.schema)
    load_months(stream, target, check).awaitTermination()
    again = harvest(spark, [("2025-01", "1", 9, "late"), ("2025-02", "1", 7, "a")])
    again.write.parquet(f"{source}/m2")
    load_months(stream, target, check).awaitTermination()
    load_months(stream, target, check).awaitTermination()
    behind = loaded(spark, f"{target}_late", first.schema).collect()
    assert [(r.report_month, r.project_id, r.v) for r in behind] == [("2025-01", 9, "late")]
    got = sorted((r.report_month, r.harvest_sector_id, r.project_id, r.v) for r in loaded(spark, target, first.schema).collect())
    assert got == [("2025-01", "1", 7, "a"), ("2025-01", "2", 8, "c"), ("2025-02", "1", 7, "a")]


@pytest.mark.parametrize("sizes", [(3, 400, 50), (400, 3, 50)])
def test_input_order_does_not_depend_on_how_files_are_cut(spark, tmp_path, sizes):
    """Records without a position are numbered by path, then by place in the file."""
    import json

    want = []
    for i, n in enumerate(sizes):
        lines = [json.dumps({"ProjectId": 1 + i, "ProjectName": f"{i}-{k}", "Expenditure": "1" * (k % 90)}) for k in range(n)]
        (tmp_path / f"part-{i}.jsonl").write_text("\n".join(lines) + "\n")
        want += [f"{i}-{k}" for k in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = Rd.read_snapshots(spark, str(tmp_path), lines=True).collect()
            assert [r.project_name for r in sorted(rows, key=lambda r: r.harvest_seq)] == want
            assert sorted(r.harvest_seq for r in rows) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_prefer_dated_spreads_a_hot_project(spark):
    dated = spark.createDataFrame([(1, "2025-01"), (3, "2025-01")], "project_id int, report_month string")
    loose = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.pmod("id", F.lit(70)).cast("int")).alias("project_id"), F.col("id").alias("harvest_seq"))
    loose = loose.unionByName(spark.range(50).select(F.lit(None).cast("int").alias("project_id"), (F.col("id") + 10**6).alias("harvest_seq")))
    got = Rd.prefer_dated(dated, loose, hot_rows=100)
    plain = Rd.prefer_dated(dated, loose)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    assert got.filter("project_id = 1").count() == 1 and got.filter("project_id is null").count() == 50 and got.filter("project_id = 10").count() > 100
    from slipwatch.operators.skew import hot_keys

    parts = {r.project_id: r._parts for r in hot_keys(loose, "project_id", 0.001, 100).collect()}
    assert parts[1] > 100


def table_of(spark, target, schema):
    return sorted((r.report_month, r.harvest_sector_id, r.project_id, r.v, r.load) for r in loaded(spark, target, schema).collect())


def test_ledger_commits_a_load(spark, tmp_path):
    """A load that failed before its ledger entry is taken up again; one that was committed is not doubled."""
    target = str(tmp_path / "t")
    first = harvest(spark, [("2025-01", "1", 7, "a"), ("2025-01", "2", 8, "c")])
    # Rows were written, the ledger was not: the same load replaces them.
    first.limit(1).write.parquet(f"{target}/load=x-0")
    Mn.ledger(spark, target, first.schema).write.parquet(str(tmp_path / "t_ledger/load=none"))
    spark.createDataFrame([], Mn.LEDGER).drop("load").write.mode("overwrite").parquet(str(tmp_path / "t_ledger/load=none"))
    for _ in range(3):
        Mn.load_batch(first, target, "x-0")
    want = [("2025-01", "1", 7, "a", "x-0"), ("2025-01", "2", 8, "c", "x-0")]
    assert table_of(spark, target, first.schema) == want
    pairs = Mn.ledger(spark, target, first.schema)
    assert sorted((r.report_month, r.harvest_sector_id, r.records, r.load) for r in pairs.collect()) == [("2025-01", "1", 1, "x-0"), ("2025-01", "2", 1, "x-0")]
    again = harvest(spark, [("2025-01", "1", 9, "late"), ("2025-01", "1", 7, "other"), ("2025-02", "1", 7, "a")])
    for _ in range(2):
        Mn.load_batch(again, target, "x-1")
    assert table_of(spark, target, first.schema) == [*want, ("2025-02", "1", 7, "a", "x-1")]
    late = Mn.merge_late(spark, target, first.schema)
    assert table_of(spark, target, first.schema) == sorted([*want, ("2025-02", "1", 7, "a", "x-1"), ("2025-01", "1", 9, "late", late)])
    assert Mn.merge_late(spark, target, first.schema) is None


def test_a_table_without_a_ledger_is_counted_once(spark, tmp_path):
    target = str(tmp_path / "t")
    first = harvest(spark, [("2025-01", "1", 7, "a")])
    first.write.parquet(f"{target}/load=old")
    Mn.load_batch(harvest(spark, [("2025-01", "1", 8, "b"), ("2025-03", "1", 8, "c")]), target, "new")
    assert table_of(spark, target, first.schema) == [("2025-01", "1", 7, "a", "old"), ("2025-03", "1", 8, "c", "new")]


def test_loads_read_the_ledger_and_not_the_table(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    first = harvest(spark, [("2025-01", "1", 7, "a")])
    Mn.load_batch(first, target, "a")
    monkeypatch.setattr(Mn, "loaded", lambda *a: pytest.fail("the table was read"))
    Mn.load_batch(harvest(spark, [("2025-01", "1", 8, "b"), ("2025-02", "1", 8, "b")]), target, "b")
    assert Mn.ledger(spark, target, first.schema).count() == 2


def test_panel_is_rebuilt_for_touched_projects_only(spark, tmp_path):
    target, panel = str(tmp_path / "t"), str(tmp_path / "p")
    build = lambda df: df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
    first = harvest(spark, [("2025-01", "1", p, f"a{p}") for p in range(20)])
    Mn.load_batch(first, target, "a")
    Mn.refresh_panel(spark, target, first.schema, panel, ["a"], build, buckets=8)
    Mn.load_batch(harvest(spark, [("2025-02", "1", p, f"b{p}") for p in (3, 50)]), target, "b")
    stamps = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "p").rglob("*.parquet")}
    before = stamps()
    Mn.refresh_panel(spark, target, first.schema, panel, ["b"], build, buckets=8, hot_rows=2)
    got = {r.project_id: (r.n, r.v) for r in spark.read.parquet(panel).collect()}
    assert got == {p: (1, f"a{p}") for p in range(20) if p != 3} | {3: (2, "b3"), 50: (1, "b50")}
    folders = lambda files: {f.split("bucket=")[1].split("/")[0] for f in files}
    assert len(folders(set(stamps()) - set(before))) <= 2 < len(folders(before))


def test_checkpoint_folder_comes_from_the_session(spark):
    from slipwatch.session import checkpoint_dir

    assert checkpoint_dir(spark)
    assert P.BLOCK_ROWS > 0
    with pytest.raises(ValueError):
        from slipwatch.operators.splits import assert_no_leakage

        assert_no_leakage(["expenditure", "revised_date_next"])


def test_a_cluster_must_name_its_checkpoint_folder():
    from slipwatch.session import checkpoint_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_form_cells_beyond_their_type_are_quarantined(spark):
    names = "project_id string, project_name string, original_cost string, expenditure string, physical_progress string, overdue_milestones string"
    form = Fo.type_form(spark.createDataFrame(
        [("A-01", "Bridge", "1e999", "10", "5", "1"), ("A-02", "Bridge", "100", "10", "5", "9999999999"), ("A-03", "Bridge", "100", "10", "5", "3")], names
    ))
    errors = {r.project_id: r.errors for r in Fo.validate(form).collect()}
    assert errors == {"A-01": ["original_cost: not finite"], "A-02": ["overdue_milestones: out of range"], "A-03": []}


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Project ID,Sanctioned Cost,Expenditure\nA-01,100,10\n")
    (tmp_path / "b.csv").write_text("Project ID,Expenditure,Sanctioned Cost\nA-02,10,100\n")
    with pytest.raises(Exception, match="(?i)header"):
        Rd.read_form_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])[0].collect()


def test_form_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"project_id": "A-01", "original_cost": "5"}\n{"project_id": "A-02", "original_cost": "6"}\n')
    rows = Rd.read_form_json(spark, str(tmp_path / "a.jsonl"), lines=True).orderBy("project_id").collect()
    assert [(r.project_id, r.original_cost) for r in rows] == [("A-01", 5.0), ("A-02", 6.0)]


def test_stored_rows_are_read_by_column_and_in_few_tasks(spark):
    from slipwatch.session import cut_lineage

    rows = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 50)).repartition(64)
    kept = cut_lineage(rows)
    assert kept.rdd.getNumPartitions() < 64 and sorted(kept.collect()) == sorted(rows.collect())
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_typed_records_do_not_read_the_tables_again(spark):
    from slipwatch.plans import queries_ingest as Q

    for df in (Q._cleaned(spark, "/root/testdata/sf0.001")[2], *Q._stored(spark, "/root/testdata/sf0.001")):
        assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString() + str(df.inputFiles())
