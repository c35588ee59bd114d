import pytest
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import exposure as X
from slipwatch.functions import rules as R
from slipwatch.operators import forms as Fo
from slipwatch.operators import portfolio as Po

BASE = dict(
    project_id="PRJ-1", project_name="Canal", sector="Coal", implementing_agency="Agency", original_cost=1000.0,
    expenditure=400.0, expenditure_change_recent=10.0, physical_progress=45.0, progress_change_recent=2.0,
    original_duration_months=48.0, months_elapsed=20.0, current_delay_months=0.0, overdue_milestones=0,
    total_scheduled_milestones=10, clearance_pending_days=0, days_since_last_update=10, dispute_status="NONE",
)


def form(spark, *changes):
    rows = [{**BASE, **c} for c in changes or [{}]]
    typed = [f"{f} string" for f in S.FORM_TEXT] + [f"{f} double" for f in S.FORM_DOUBLES] + [f"{f} int" for f in S.FORM_INTS] + ["p_model double"]
    names = [t.split()[0] for t in typed]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(typed))


def fired(spark, **change):
    row = form(spark, change).select(*[c.alias(n) for n, c in R.rule_flags().items()], R.rule_floor().alias("floor"), R.critical_override().alias("crit")).first()
    return [n for n in S.RULE_WEIGHTS if row[n]], row["floor"], row["crit"]


@pytest.mark.parametrize("change, flags, floor, critical", [
    ({}, [], 0, False),
    (dict(expenditure=500.0, physical_progress=25.0), ["F1"], 30, False),
    (dict(expenditure=499.0, physical_progress=25.0), [], 0, False),
    (dict(expenditure=850.0), ["F1"], 30, True),
    (dict(expenditure=900.0, physical_progress=50.0), [], 0, False),
    (dict(progress_change_recent=0.1), ["F2"], 25, False),
    (dict(progress_change_recent=0.11), [], 0, False),
    (dict(progress_change_recent=0.0, months_elapsed=9.0), [], 0, False),
    (dict(progress_change_recent=0.0, physical_progress=95.0), [], 0, False),
    (dict(overdue_milestones=5), ["F3"], 25, False),
    (dict(clearance_pending_days=181), ["F3"], 25, False),
    (dict(clearance_pending_days=366), ["F3"], 25, True),
    (dict(days_since_last_update=60), [], 0, False),
    (dict(days_since_last_update=61), ["F4"], 20, False),
    (dict(dispute_status="CONCILIATION"), [], 0, False),
    (dict(dispute_status="TERMINATION_NOTICE"), ["F5"], 30, True),
    (dict(months_elapsed=48.0), ["F6"], 25, False),
    (dict(months_elapsed=48.0, current_delay_months=0.1), [], 0, False),
    (dict(months_elapsed=60.0), ["F6"], 25, True),
    (dict(months_elapsed=60.0, physical_progress=95.0), [], 0, False),
])
def test_rule_edges(spark, change, flags, floor, critical):
    assert fired(spark, **change) == (flags, floor, critical)


def test_floor_is_clamped_and_signals_are_always_six(spark):
    worst = dict(expenditure=900.0, progress_change_recent=0.0, overdue_milestones=9, days_since_last_update=99, dispute_status="ARBITRATION", months_elapsed=70.0)
    df = form(spark, worst).select(R.rule_floor().alias("f"), R.rule_signals().alias("s"), R.rule_floor({"F1": 1.0}).alias("g"))
    row = df.first()
    assert row["f"] == 100 and len(row["s"]) == 6 and row["g"] == 100
    assert [s["flag_id"] for s in row["s"]] == list(S.RULE_WEIGHTS)


def test_score_is_the_larger_side_and_ties_go_to_rules(spark):
    df = spark.createDataFrame([(0.55, 55.0), (0.56, 55.0), (0.2, 75.0), (1.4, 10.0), (-1.0, 0.0)], "p double, f double")
    out = df.select(R.combined_score(F.col("p"), F.col("f")).alias("s"), R.dominant_source(F.col("p"), F.col("f")).alias("d")).collect()
    assert [round(r.s, 9) for r in out] == [55.0, 56.0, 75.0, 100.0, 0.0]
    assert [r.d for r in out] == [S.SOURCES[1], S.SOURCES[0], S.SOURCES[1], S.SOURCES[0], S.SOURCES[1]]


def test_tier_bands_include_their_lower_edge(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 24.999, 25.0, 50.0, 74.999, 75.0)], "s double")
    assert [r[0] for r in df.select(R.risk_tier(F.col("s"))).collect()] == ["LOW", "LOW", "MODERATE", "HIGH", "HIGH", "CRITICAL"]


@pytest.mark.parametrize("sector, median, matched", [
    ("Railways", 25.0, True), (" railway ", 25.0, True), ("HEALTH", 20.0, True), ("Roads", 12.0, True),
    ("civil aviation", 10.0, True), ("Aviation", 15.0, False), ("", 15.0, False),
])
def test_sector_median(spark, sector, median, matched):
    c, m = X.sector_median(F.lit(sector))
    row = spark.range(1).select(c.alias("c"), m.alias("m")).first()
    assert (row.c, row.m) == (median, matched)


@pytest.mark.parametrize("cost, p, overrun, want", [
    (1000.0, 0.5, 10.0, (125.0, 25.0, True, False)),
    (1000.0, 0.5, 40.0, (200.0, 40.0, False, False)),
    (1000.0, 0.5, -9.0, (125.0, 25.0, True, False)),
    (1000.0, 1.0, 400.0, (3000.0, 400.0, False, True)),
    (0.0, 0.5, 10.0, (0.0, 0.0, False, False)),
    (1000.0, 0.0, 10.0, (0.0, 0.0, False, False)),
])
def test_exposure(spark, cost, p, overrun, want):
    cols = X.exposure(F.lit(cost), F.lit(p), F.lit(overrun), F.lit(25.0))
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()) == want


def test_interventions_are_ordered_and_never_empty(spark):
    df = form(spark, dict(p_model=0.1), dict(p_model=0.3), dict(p_model=0.8, expenditure=710.0))
    got = [r[0] for r in Fo.assess(df).select("interventions").collect()]
    assert got[0] == [R.ACTIONS["low"]]
    assert got[1] == [R.ACTIONS["default"]]
    assert got[2] == [R.ACTIONS["tier"], R.ACTIONS["F1"], R.ACTIONS["fallback"]]


def test_assessment_invariants_and_slim(spark):
    df = Fo.assess(form(spark, *[dict(project_id=f"P-{i}", p_model=i / 10, expenditure=100.0 * i) for i in range(1, 10)]))
    assert df.filter("gov_score < rule_floor or capital_at_risk > 3 * original_cost").count() == 0
    assert not set(Fo.NESTED) & set(Fo.slim(df).columns)
    total = Po.portfolio_summary(df).first()
    assert total.projects == 9 == total.tier_low + total.tier_moderate + total.tier_high + total.tier_critical
    assert [r.project_id for r in Po.ranking(df, limit=2).collect()] == ["P-9", "P-8"]
    with pytest.raises(ValueError):
        Po.ranking(df, limit=0)
    assert Po.search(df, "CAN").count() == 9 and Po.search(df, "zzz").count() == 0
    assert Po.detail(df, "nobody").count() == 0


def test_headers(spark):
    found, ignored = Fo.match_headers(["Project ID", "project_code", "SANCTIONED-COST", "Colour", " Remarks "])
    assert found == {"Project ID": "project_id", "SANCTIONED-COST": "original_cost", " Remarks ": "delay_remarks"}
    assert ignored == ["Colour", "project_code"]
    with pytest.raises(Fo.HeaderError):
        Fo.match_headers(["Name", "Colour"])


def test_validation_gives_reasons_and_splits(spark):
    rows = form(spark, {}, dict(project_id="X"), dict(physical_progress=101.0), dict(expenditure=60000.0), dict(expenditure=None),
                dict(dispute_status="COURT"), dict(original_cost=0.0, expenditure=0.0), dict(progress_change_recent=-10.5))
    checked = Fo.validate(rows)
    assert [r.errors for r in checked.collect()] == [
        [], ["project_id: length"], ["physical_progress: out of range"], ["expenditure: above 50 times the cost"],
        ["expenditure: missing"], ["dispute_status: unknown"], ["original_cost: out of range"], ["progress_change_recent: out of range"],
    ]
    assert Fo.usable(checked).count() == 1 and Fo.quarantined(checked).count() == 7


def test_form_features_share_the_panel_formulas(spark):
    rows = Fo.feature_rows(form(spark, dict(months_elapsed=47.5), dict(months_elapsed=60.0), dict(months_elapsed=60.0, current_delay_months=24.0)), S.FEATURES + ["novel"], {"novel": 3.5})
    got = rows.collect()
    assert [r.months_to_revised_date for r in got] == [0.5, -12.0, 12.0]
    # Less than a month left counts as one month.
    assert got[0].required_velocity == 55.0
    assert got[0].novel == 3.5 and "novel" in got[0].approximated


def test_horizons_never_fall(spark):
    fixed = R.monotone_horizons({1: F.lit(0.4), 3: F.lit(0.3), 6: F.lit(0.6)})
    row = spark.range(1).select(*[x.alias(f"{n}{k}") for k, c in fixed.items() for n, x in zip("pf", c)]).first()
    assert (row.p1, row.p3, row.p6, row.f3, row.f6) == (0.4, 0.4, 0.6, True, False)
