"""Small hand-made projects whose panel rows are known."""

import pytest
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.operators import clean as K
from slipwatch.operators import panel as P

COLUMNS = [
    "project_id bigint", "project_name string", "sector_name string", "original_cost string", "revised_cost string",
    "expenditure string", "physical_progress string", "sanction_date string", "original_end_date string",
    "revised_date string", "report_month string", "harvest_seq bigint",
]


def record(pid=1, spend="10", progress="5", revised="31/12/2026", month=None, cost="1000", sanction="01/01/2024",
           end="31/12/2026", name="Bridge", sector="Railway lines", rev_cost=""):
    return (pid, name, sector, cost, rev_cost, spend, progress, sanction, end, revised, month)


def raw(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(COLUMNS))


def panel(spark, rows, **kw):
    out = P.build_panel(raw(spark, rows), **kw)
    return [r.asDict() for r in out.orderBy("project_id", "seq_index").collect()]


def test_label_needs_more_than_fifteen_days(spark):
    def label(after):
        return panel(spark, [record(revised="01/01/2026"), record(spend="20", revised=after)])[0]["slip_next"]

    assert label("11/01/2026") == 0
    assert label("16/01/2026") == 0
    assert label("17/01/2026") == 1
    assert label("01/12/2025") == 0


def test_single_snapshot_and_zero_cost_yield_nothing(spark):
    assert panel(spark, [record()]) == []
    assert panel(spark, [record(cost="0"), record(cost="0", spend="20")]) == []


def test_missing_next_date_drops_the_pair_only(spark):
    rows = [record(spend="1"), record(spend="2", revised=None), record(spend="3"), record(spend="4")]
    assert [r["seq_index"] for r in panel(spark, rows)] == [2]


def test_copies_collapse_and_quiet_months_stay(spark):
    undated = [record(), record(), record(spend="20")]
    assert panel(spark, undated)[0]["n_snapshots"] == 2
    quiet = [record(month="2025-07"), record(month="2025-08"), record(month="2025-08")]
    rows = panel(spark, quiet)
    assert [(r["as_of_month"], r["n_snapshots"], r["time_axis"]) for r in rows] == [("2025-07", 2, "observed")]


def test_calendar_beats_spend_order_and_gaps_are_counted(spark):
    rows = panel(spark, [record(spend="90", month="2025-07"), record(spend="10", month="2025-09")])
    assert [(r["expenditure"], r["gap_months"]) for r in rows] == [(90.0, 2)]


def test_horizon_window_is_the_calendar(spark):
    dates = ["01/01/2026", "01/01/2026", "01/01/2026", "01/06/2026"]
    months = ["2025-01", "2025-02", "2025-03", "2025-06"]
    rows = panel(spark, [record(spend=str(i), revised=d, month=m) for i, (d, m) in enumerate(zip(dates, months))])
    assert [(r["slip_within_3m"], r["slip_within_6m"]) for r in rows] == [(0, 1), (0, 1), (1, 1)]


def test_short_window_without_slip_is_unknown(spark):
    rows = panel(spark, [record(month="2025-01"), record(month="2025-02")])
    assert [(r["slip_within_3m"], r["censored_3m"]) for r in rows] == [(None, 1)]


def test_reconstructed_window_counts_reports(spark):
    rows = panel(spark, [record(spend=str(i), progress=str(i)) for i in range(5)])
    assert [r["slip_within_3m"] for r in rows] == [0, 0, None, None]
    assert [r["as_of_month"] for r in rows] == ["2026-05", "2026-06", "2026-07", "2026-08"]


def test_backward_progress_is_unreliable_only_without_months(spark):
    back = [(str(10 + i), str(90 - 10 * i)) for i in range(4)]
    undated = panel(spark, [record(spend=s, progress=p) for s, p in back])
    dated = panel(spark, [record(spend=s, progress=p, month=f"2025-0{i + 1}") for i, (s, p) in enumerate(back)])
    assert {r["order_reliable"] for r in undated} == {0}
    assert {r["order_reliable"] for r in dated} == {1}


def test_units_modal_values_and_imputed_sanction(spark):
    rows = [record(spend="2,500,000", progress="120", sanction=None), record(spend="60000", progress="-4", sanction=None, cost="999"),
            record(spend="70000", sanction=None)]
    out = panel(spark, rows)
    assert {r["sanction_imputed"] for r in out} == {1}
    assert {r["original_cost"] for r in out} == {1000.0}
    assert sorted(r["expenditure"] for r in out) == [600.0, 700.0]


def test_modal_tie_goes_to_the_first_seen(spark):
    df = raw(spark, [record(cost="5"), record(cost="7"), record(cost="7"), record(cost="5"), record(cost="")])
    assert K.modal_values(df, ["original_cost"]).first()["original_cost"] == "5"


def test_stall_streak_and_velocity(spark):
    progress = [0, 5, 5, 5.05, 20, 20]
    rows = panel(spark, [record(spend=str(i), progress=str(p), month=f"2025-0{i + 1}") for i, p in enumerate(progress)])
    assert [r["stall_streak"] for r in rows] == [0, 0, 1, 2, 0]
    assert [round(r["progress_velocity"], 4) for r in rows] == [0.0, 5.0, 2.5, 1.6833, 5.0]


def test_zero_progress_is_safe_and_features_are_complete(spark):
    rows = panel(spark, [record(progress="0"), record(spend="20", progress="0")])
    assert rows[0]["burn_to_progress_ratio"] == 0.0
    assert all(rows[0][f] is not None for f in S.FEATURES)


def test_published_columns(spark):
    out = P.publish(P.build_panel(raw(spark, [record(), record(spend="20")])))
    assert out.columns == S.PANEL_IDS + S.FEATURES + ["slip_next", "slip_within_3m", "slip_within_6m", "censored_3m", "censored_6m"]


def many_snapshots(spark, n=97):
    df = spark.range(n).select(
        (F.col("id") % 2).alias("project_id"),
        (F.col("id") * 37 % 101).cast("double").alias("expenditure"),
        (F.floor(F.col("id") * 7 % 31 / 3) * 3).cast("double").alias("physical_progress"),
        F.when(F.col("id") % 11 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") * 13 % 90).cast("int"))).alias("revised_date"),
        F.col("id").alias("harvest_seq"),
    )
    return df.withColumn("project_id", F.when(F.col("harvest_seq") > 60, 0).otherwise(F.col("project_id")))


@pytest.mark.parametrize("order", K.ORDERINGS)
def test_sequence_in_cells_equals_the_plain_one(spark, order):
    df = many_snapshots(spark)
    keys = ["project_id", "harvest_seq", "seq_index", "n_snapshots"]
    plain = K.sequence(df, K.ordering(order)).select(*keys)
    cells = K.sequence_undated(df, order).select(*keys)
    assert plain.dtypes == cells.dtypes
    assert sorted(plain.collect()) == sorted(cells.collect())


def test_history_in_blocks_equals_the_plain_one(spark):
    seq = K.sequence(many_snapshots(spark), K.ordering()).withColumn("axis", F.col("seq_index"))
    plain, blocks = P.history(seq), P.history(seq, block_rows=8)
    names = plain.columns
    assert {f.name: f.dataType for f in plain.schema} == {f.name: f.dataType for f in blocks.schema}
    # Before the third report the first value stands in; later it is not read.
    for df_names in [[c for c in names if c != "progress_first"]]:
        a = sorted(plain.select(*df_names).collect(), key=lambda r: (r.project_id, r.seq_index))
        b = sorted(blocks.select(*df_names).collect(), key=lambda r: (r.project_id, r.seq_index))
        assert a == b


def test_undated_projects_have_one_plan_and_one_schema(spark):
    def build(n):
        return P.build_panel(raw(spark, [record(spend=str(i), progress=str(i % 40)) for i in range(n)]))

    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = set(jobs())
    few, many = build(10), P.build_panel(
        raw(spark, [record()]).drop("expenditure", "harvest_seq").crossJoin(
            spark.range(300_000).select(F.col("id").cast("string").alias("expenditure"), F.col("id").alias("harvest_seq"))
        ).select(*raw(spark, [record()]).columns)
    )
    assert set(jobs()) == before
    assert few.dtypes == many.dtypes
    dated = P.build_panel(raw(spark, [record(month="2025-01"), record(month="2025-02", spend="20")]))
    assert dated.dtypes == few.dtypes
    assert many.agg(F.max("seq_index")).first()[0] == 299_998


def test_undated_projects_in_small_blocks(spark):
    rows = [record(spend=str(i * 3 % 50), progress=str(i % 40)) for i in range(50)] + [record(pid=2, month=f"2025-0{i}") for i in range(1, 9)]
    plain, long = panel(spark, rows), panel(spark, rows, block_rows=10)
    drop = {"progress_first"}
    assert [{k: v for k, v in r.items() if k not in drop} for r in plain] == [{k: v for k, v in r.items() if k not in drop} for r in long]


def test_hot_projects_are_split_in_joins(spark):
    from slipwatch.operators.skew import hot_keys, join_attributes

    rows = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 20 + 2).alias("k"), F.col("id").alias("seq"))
    attrs = rows.select("k").distinct().withColumn("a", F.col("k") * 10)
    hot = {r["k"]: r["_parts"] for r in hot_keys(rows, "k", 0.1, 50).collect()}
    assert hot == {1: 7}
    joined = join_attributes(rows, attrs, "k", "seq", 0.1, 50)
    assert joined.count() == 1000
    assert joined.filter("a != k * 10").count() == 0


def test_counters_and_field_population(spark):
    rows = [record(), record(), record(spend="20"), record(pid=2), record(pid=3, cost="0")]
    df = raw(spark, rows)
    unique = K.dedupe(df)
    cleaned = K.clean(unique, K.project_attributes(df, unique))
    dated, undated = P.order_snapshots(cleaned)
    hist = P.history(dated).unionByName(P.history(undated.select(dated.columns)))
    got = P.panel_counts(df, cleaned, hist, P.transitions(hist.filter(P.eligible()))).first()
    assert (got.raw_records, got.unique_projects, got.duplicate_snapshots_dropped) == (5, 3, 1)
    assert (got.projects_dropped_no_cost, got.projects_dropped_single_snapshot, got.transitions_emitted) == (1, 1, 1)
    assert got.time_axis_mode == "reconstructed"
    filled = {r.field: r.populated for r in P.field_population(df, ["original_cost", "report_month"]).collect()}
    assert filled == {"original_cost": 4, "report_month": 0}
