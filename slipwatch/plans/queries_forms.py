"""Queries over form rows: validation, rules, score, exposure, portfolio, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import coerce as C
from slipwatch.functions import exposure as X
from slipwatch.functions import rules as R
from slipwatch.functions.features import form_indicators
from slipwatch.functions.text import DELAY_TAGS
from slipwatch.functions.text import tag_share as share_of_tags
from slipwatch.functions.text import text_tags as tags
from slipwatch.operators import drivers as D
from slipwatch.operators import forms as Fo
from slipwatch.operators import portfolio as Po
from slipwatch.operators.ranked import quantiles
from slipwatch.plans import inputs as I
from slipwatch.plans import oracle as O
from slipwatch.plans.oracle import cols, many
from slipwatch.plans.registry import query

_KEY = ["s:project_id", "s:report_month"]
K = ["project_id", "report_month"]

# A report with free header spelling: header -> form field it stands for.
_EXPORT = {
    "Project ID": "project_id", "Project Name": "project_name", "Sector": "sector", "Agency": "implementing_agency",
    "Sanctioned Cost": "original_cost", "Original-Cost": "revised_cost", "Revised Cost": "revised_cost",
    "Expenditure": "expenditure", "recent_expenditure": "expenditure_change_recent", "Physical Progress": "physical_progress",
    "Progress Change": "progress_change_recent", "Original Duration Months": "original_duration_months",
    "Months Elapsed": "months_elapsed", "DELAY MONTHS": "current_delay_months", "Overdue Milestones": "overdue_milestones",
    "Clearance Pending Days": "clearance_pending_days", "Days Since Last Update": "days_since_last_update",
    "Dispute Status": "dispute_status", "Reasons For Delay": "delay_remarks", "Ministry Code": "state",
}


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form rows as an uploaded report: text cells under free headers, 'Original-Cost' repeating a known field."""
    rows = I.forms(spark, sf_dir)
    text = {"dispute_status": F.lower(F.replace(F.col("dispute_status"), F.lit("_"), F.lit(" ")))}
    return rows.select(*[text.get(f, F.col(f).cast("string")).alias(h) for h, f in _EXPORT.items()], "p_model", "report_month")


_FIELDS = [f for f in S.FORM_FIELDS if f not in ("state", "total_scheduled_milestones")]


@query("WITH " + O.FORM + f""", a AS (SELECT *, lower(trim(sector)) AS k FROM form)
SELECT {cols('s:project_id', 's:project_name', "s:sector=CASE WHEN k IN ('roads','highways','road transport') THEN 'Road Transport & Highways' WHEN k = 'railway' THEN 'Railways' WHEN k = 'power' THEN 'Power' ELSE trim(sector) END",
 's:implementing_agency', 's:dispute_status', "s:delay_remarks=nullif(trim(delay_remarks), '')", *many('d', ' '.join(S.FORM_DOUBLES)),
 'l:overdue_milestones', 'l:clearance_pending_days', 'l:days_since_last_update', "s:ignored='Ministry Code,Original-Cost,p_model,report_month'")} FROM a""")
def csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    export = _export(spark, sf_dir)
    _, ignored = Fo.match_headers(export.columns)
    typed = Fo.type_form(Fo.rename_headers(export))
    return typed.select(*_FIELDS, F.lit(",".join(ignored)).alias("ignored"))


_ALIAS = "CASE WHEN lower(trim(sector)) = 'power' THEN 'Power' WHEN lower(trim(sector)) = 'railway' THEN 'Railways' WHEN lower(trim(sector)) IN ('roads','highways','road transport') THEN 'Road Transport & Highways' ELSE trim(sector) END"


@query(f"WITH {O.FORM} SELECT {cols('s:sector', f's:normalised={_ALIAS}', 'l:n=count(*)')} FROM form GROUP BY 1, 2")
def alias_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.forms(spark, sf_dir).groupBy("sector", C.alias_sector(F.col("sector")).alias("normalised")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {O.FORM} SELECT {cols(*_KEY, 'd:remaining_progress_pct=greatest(0.0, round(100.0::DOUBLE - physical_progress, 4))',
 'd:expenditure_pct=round(expenditure / original_cost * 100.0::DOUBLE, 4)',
 'd:cost_overrun_pct_current=CASE WHEN revised_cost IS NULL THEN 0.0 ELSE greatest(0.0, round((revised_cost - original_cost) / original_cost * 100.0::DOUBLE, 4)) END',
 'd:spend_progress_gap=round(round(expenditure / original_cost * 100.0::DOUBLE, 4) - physical_progress, 4)',
 'd:execution_velocity=CASE WHEN months_elapsed <= 0 OR physical_progress >= 100 THEN 1.0 ELSE round(physical_progress / months_elapsed / (greatest(0.01::DOUBLE, 100.0::DOUBLE - physical_progress) / greatest(1.0::DOUBLE, original_duration_months - months_elapsed)), 4) END')} FROM form""")
def form_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.with_indicators(I.forms(spark, sf_dir)).select(*K, *form_indicators())


@query(f"""WITH {O.FORM}, f AS (SELECT *, greatest(1.0::DOUBLE, original_duration_months) AS dur, 100.0::DOUBLE * expenditure / greatest(1.0::DOUBLE, original_cost) AS pct,
 greatest(0.0::DOUBLE, 100.0::DOUBLE - physical_progress) AS rem, coalesce(progress_change_recent, 0) AS pd, coalesce(expenditure_change_recent, 0) AS ed FROM form),
g AS (SELECT *, dur + current_delay_months - months_elapsed AS mtr FROM f),
h AS (SELECT *, CASE WHEN mtr > 0 THEN rem / greatest(1.0::DOUBLE, mtr) ELSE rem END AS req FROM g)
SELECT {cols('s:project_id', 'd:original_cost', 'd:log_original_cost=ln(1 + original_cost)', 'd:expenditure', 'd:expenditure_pct=pct', 'd:expenditure_delta=ed',
 'd:expenditure_delta_pct=100.0::DOUBLE * ed / greatest(1.0::DOUBLE, original_cost)', 'd:physical_progress', 'd:progress_delta=pd', 'd:progress_delta_3m=3.0 * pd',
 'd:remaining_progress_pct=rem', 'd:spend_progress_gap=pct - physical_progress', 'd:burn_to_progress_ratio=CASE WHEN physical_progress > 0.5 THEN pct / physical_progress ELSE 0.0 END',
 'd:months_elapsed', 'd:original_duration_months=dur', 'd:elapsed_ratio=months_elapsed / dur', 'd:schedule_pressure=months_elapsed / dur - physical_progress / 100.0::DOUBLE',
 'd:months_to_revised_date=mtr', 'd:revised_date_already_slipped_months=current_delay_months', 'd:stall_streak=(pd <= 0.1)::INTEGER', 'd:progress_velocity=pd',
 'd:required_velocity=req', 'd:velocity_deficit=req - pd', "s:approximated='progress_delta_3m,stall_streak,progress_velocity'")} FROM h""")
def form_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.feature_rows(I.forms(spark, sf_dir)).withColumn("approximated", F.array_join("approximated", ","))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form rows with faults by fixed rules, for validation."""
    rows = I.forms(spark, sf_dir)
    n = F.col("clearance_pending_days")
    return rows.select(
        F.col("project_id").alias("key"),
        "report_month",
        *[c for c in rows.columns if c not in ("project_id", "report_month", "original_cost", "physical_progress", "sector", "dispute_status", "expenditure")],
        F.when(n % 11 == 0, "X").otherwise(F.col("project_id")).alias("project_id"),
        F.when(n % 7 == 0, 0.0).otherwise(F.col("original_cost")).alias("original_cost"),
        F.when(n % 5 == 0, F.col("physical_progress") + 60.0).otherwise(F.col("physical_progress")).alias("physical_progress"),
        F.when(n % 13 == 0, "  ").otherwise(F.col("sector")).alias("sector"),
        F.when(n % 17 == 0, "LAWSUIT").otherwise(F.col("dispute_status")).alias("dispute_status"),
        F.when(n % 19 != 0, F.when(n % 23 == 0, F.col("expenditure") * 1000.0).otherwise(F.col("expenditure"))).alias("expenditure"),
    )


@query(f"""WITH {O.FORM}, b AS (SELECT project_id AS key, report_month, clearance_pending_days AS n, CASE WHEN n % 11 = 0 THEN 'X' ELSE project_id END AS pid,
 CASE WHEN n % 7 = 0 THEN 0.0 ELSE original_cost END AS cost, CASE WHEN n % 5 = 0 THEN physical_progress + 60 ELSE physical_progress END AS prog,
 CASE WHEN n % 13 = 0 THEN '  ' ELSE sector END AS sector, CASE WHEN n % 17 = 0 THEN 'LAWSUIT' ELSE dispute_status END AS ds,
 CASE WHEN n % 19 <> 0 THEN CASE WHEN n % 23 = 0 THEN expenditure * 1000.0::DOUBLE ELSE expenditure END END AS e, progress_change_recent AS pc FROM form)
SELECT key, report_month, concat_ws('; ', CASE WHEN e IS NULL THEN 'expenditure: missing' END, CASE WHEN length(pid) < 3 THEN 'project_id: length' END,
 CASE WHEN cost <= 0 THEN 'original_cost: out of range' END, CASE WHEN prog > 100 THEN 'physical_progress: out of range' END,
 CASE WHEN trim(sector) = '' THEN 'sector: empty' END, CASE WHEN ds = 'LAWSUIT' THEN 'dispute_status: unknown' END,
 CASE WHEN e > cost * 50 THEN 'expenditure: above 50 times the cost' END) AS errors FROM b""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.validate(_broken(spark, sf_dir)).select("key", "report_month", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {O.RULES} SELECT {cols(*_KEY, *[f'l:f{i}' for i in range(1, 7)], 'l:critical_override=critical')} FROM floors")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [c.alias(n.lower()) for n, c in R.rule_flags().items()]
    return I.forms(spark, sf_dir).select(*K, *flags, R.critical_override().alias("critical_override"))


@query(f"""WITH {O.RULES} SELECT {cols(*_KEY, 'd:rule_floor', 'l:active_signals_count=active', 'd:custom_floor=least(100, 55 * f1 + 25 * f2 + 25 * f3 + 20 * f4 + 60 * f5 + 25 * f6)')} FROM floors""")
def rule_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.forms(spark, sf_dir).select(
        *K, R.rule_floor().alias("rule_floor"), R.active_rules().alias("active_signals_count"), R.rule_floor({"F1": 55.0, "F5": 60.0}).alias("custom_floor")
    )


_SIGNALS = f"""WITH {O.RULES}, s AS (
 SELECT project_id, report_month, 'F1' AS flag_id, CASE WHEN gap >= 40 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 30 * f1 AS weight, 'spend_progress_gap' AS metric_name, round(gap, 2) AS metric_value, 25.0 AS threshold_value FROM floors
 UNION ALL SELECT project_id, report_month, 'F2', CASE WHEN ratio >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END, 25 * f2, 'progress_change_recent', round(progress_change_recent, 2), 0.1 FROM floors
 UNION ALL SELECT project_id, report_month, 'F3', CASE WHEN clearance_pending_days > 365 THEN 'CRITICAL' ELSE 'HIGH' END, 25 * f3, CASE WHEN clearance_pending_days > 180 THEN 'clearance_pending_days' ELSE 'milestone_density' END, CASE WHEN clearance_pending_days > 180 THEN clearance_pending_days ELSE round(density, 2) END, CASE WHEN clearance_pending_days > 180 THEN 180.0 ELSE 0.5 END FROM floors
 UNION ALL SELECT project_id, report_month, 'F4', 'MEDIUM', 20 * f4, 'days_since_last_update', days_since_last_update, 60.0 FROM floors
 UNION ALL SELECT project_id, report_month, 'F5', 'CRITICAL', 30 * f5, 'dispute_status_indicator', f5, 1.0 FROM floors
 UNION ALL SELECT project_id, report_month, 'F6', CASE WHEN greatest(0, -months_left) >= 12 THEN 'CRITICAL' ELSE 'HIGH' END, 25 * f6, 'months_past_declared_completion_date', round(greatest(0.0::DOUBLE, -months_left), 2), 0.0 FROM floors)
SELECT {cols(*_KEY, 's:flag_id', 's:severity', 'd:weight', 's:metric_name', 'd:metric_value', 'd:threshold_value', 'l:is_active=(weight > 0)::INTEGER')} FROM s"""


@query(_SIGNALS)
def rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested signals, one row per report and rule."""
    rows = I.forms(spark, sf_dir).select(*K, F.explode(R.rule_signals()).alias("s"))
    return rows.select(*K, "s.flag_id", "s.severity", "s.weight", "s.metric_name", "s.metric_value", "s.threshold_value", "s.is_active")


@query(f"WITH {O.RULES} SELECT {cols(*_KEY, 'd:gov_score', 's:dominant_source')} FROM scored")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, floor = F.col("p_model"), R.rule_floor()
    return I.forms(spark, sf_dir).select(*K, R.combined_score(p, floor).alias("gov_score"), R.dominant_source(p, floor).alias("dominant_source"))


@query(f"WITH {O.RULES} SELECT {cols(*_KEY, 's:risk_tier')} FROM priced")
def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.forms(spark, sf_dir).select(*K, R.risk_tier(R.combined_score(F.col("p_model"), R.rule_floor())).alias("risk_tier"))


@query(f"WITH {O.RULES} SELECT {cols('s:sector', 'd:median', 'l:matched', 'l:n=count(*)')} FROM scored GROUP BY sector, median, matched")
def sector_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    median, matched = X.sector_median(F.col("sector"))
    return I.forms(spark, sf_dir).groupBy("sector", median.alias("median"), matched.alias("matched")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.RULES} SELECT {cols(*_KEY, 'm:capital_at_risk', 'd:effective_overrun_pct=effective_overrun', 'l:is_sector_fallback_used=fallback', 'l:is_clamped_to_cap=clamped')} FROM assessed")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Fo.assess(I.forms(spark, sf_dir))
    return rows.select(*K, "capital_at_risk", "effective_overrun_pct", "is_sector_fallback_used", "is_clamped_to_cap")


@query(f"""WITH {O.RULES}, g AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, gov_score / 100.0::DOUBLE)) AS pg FROM priced)
SELECT {cols(*_KEY, 'd:capital_at_risk_gov=round(CASE WHEN original_cost <= 0 OR pg <= 0 THEN 0.0 ELSE least(original_cost * 3.0::DOUBLE, original_cost * pg * (greatest(reported, median) / 100.0::DOUBLE)) END, 4)')} FROM g""")
def exposure_gov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Fo.with_indicators(I.forms(spark, sf_dir))
    score = R.combined_score(F.col("p_model"), R.rule_floor())
    priced = X.exposure(F.col("original_cost"), X.score_as_probability(score), F.col("cost_overrun_pct_current"), X.sector_median(F.col("sector"))[0])
    return rows.select(*K, F.round(priced["capital_at_risk"], 4).alias("capital_at_risk_gov"))


_ACTIONS = "concat_ws(' | ', " + ", ".join(
    [f"CASE WHEN risk_tier IN ('HIGH', 'CRITICAL') THEN '{R.ACTIONS['tier']}' END"]
    + ["CASE WHEN f{} = 1 THEN '{}' END".format(i, R.ACTIONS[f"F{i}"].replace("'", "''")) for i in range(1, 7)]
    + ["CASE WHEN fallback = 1 AND risk_tier IN ('HIGH', 'CRITICAL') THEN '{}' END".format(R.ACTIONS["fallback"].replace("'", "''")), f"CASE WHEN risk_tier = 'LOW' THEN '{R.ACTIONS['low']}' END"]
) + ")"


@query(f"WITH {O.RULES} SELECT {cols(*_KEY)}, coalesce(nullif({_ACTIONS}, ''), '{R.ACTIONS['default']}') AS actions FROM assessed")
def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.assess(I.forms(spark, sf_dir)).select(*K, F.array_join("interventions", " | ").alias("actions"))


_ASSESSED = ["s:project_id", "s:project_name", "s:sector", "s:implementing_agency", "d:physical_progress", "d:original_cost", "d:revised_cost", "d:p_model",
             "d:rule_floor", "d:gov_score", "s:dominant_source", "s:risk_tier", "d:sector_median_overrun_pct=median", "d:effective_overrun_pct=effective_overrun",
             "m:capital_at_risk", "d:base_rate_probability=0.5", "l:active_signals_count=active"]
_A = [s.split(":")[1].split("=")[0] for s in _ASSESSED]


@query(f"WITH {O.RULES} SELECT {cols(*_KEY[1:], *_ASSESSED)} FROM assessed")
def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.assess(I.forms(spark, sf_dir)).select("report_month", *_A)


@query(f"WITH {O.RULES} SELECT {cols(*_ASSESSED)} FROM assessed WHERE is_latest = 1")
def rank_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.slim(Fo.assess(I.latest_forms(spark, sf_dir))).select(*_A)


_TOTALS = ["l:projects=count(*)", "d:total_original_cost=sum(round_even(original_cost * 100.0::DOUBLE, 0)::BIGINT)::DOUBLE / 100.0::DOUBLE", "d:total_expenditure=sum(round_even(expenditure * 100.0::DOUBLE, 0)::BIGINT)::DOUBLE / 100.0::DOUBLE", "d:total_capital_at_risk=sum(round_even(capital_at_risk * 100.0::DOUBLE, 0)::BIGINT)::DOUBLE / 100.0::DOUBLE",
           "d:avg_gov_score=avg(gov_score)", "l:critical_high_projects=count(*) FILTER (risk_tier IN ('HIGH', 'CRITICAL'))",
           *[f"l:tier_{t.lower()}=count(*) FILTER (risk_tier = '{t}')" for t in S.TIERS], *[f"l:source_{t.lower()}=count(*) FILTER (dominant_source = '{t}')" for t in S.SOURCES]]
_SHARE = "d:capital_at_risk_pct=(sum(round_even(capital_at_risk * 100.0::DOUBLE, 0)::BIGINT)::DOUBLE / 100.0::DOUBLE) / (sum(round_even(original_cost * 100.0::DOUBLE, 0)::BIGINT)::DOUBLE / 100.0::DOUBLE) * 100.0::DOUBLE"


@query(f"WITH {O.RULES} SELECT {cols(*_TOTALS, _SHARE)} FROM assessed WHERE is_latest = 1")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Po.portfolio_summary(Fo.assess(I.latest_forms(spark, sf_dir)))


@query(f"WITH {O.RULES} SELECT {cols('s:sector', *_TOTALS)} FROM assessed WHERE is_latest = 1 GROUP BY sector")
def sector_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Po.sector_rollup(Fo.assess(I.latest_forms(spark, sf_dir)))


@query(f"WITH {O.RULES} SELECT {cols('s:sector', 'l:is_total=grouping(sector)', *_TOTALS, _SHARE)} FROM assessed GROUP BY GROUPING SETS ((sector), ())")
def summary_with_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and sectors over all monthly reports in one pass."""
    return Po.summary_with_sectors(Fo.assess(I.forms(spark, sf_dir)))


@query(f"WITH {O.RULES} SELECT {cols('s:project_id', 's:risk_tier', 'm:capital_at_risk')} FROM assessed WHERE is_latest = 1 ORDER BY assessed.capital_at_risk DESC, assessed.project_id LIMIT 25")
def top_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Po.ranking(Fo.assess(I.latest_forms(spark, sf_dir)), limit=25).select("project_id", "risk_tier", "capital_at_risk")


@query(f"WITH {O.RULES} SELECT {cols(*_KEY, 's:risk_tier', 'm:capital_at_risk')} FROM assessed WHERE lower(sector) = 'railways' AND risk_tier = 'HIGH'")
def rank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Po.ranking(Fo.assess(I.forms(spark, sf_dir)), sector="RAILWAYS", tier="high").select(*K, "risk_tier", "capital_at_risk")


@query(f"""WITH {O.RULES} SELECT {cols(*_KEY, 's:risk_tier', 'm:capital_at_risk')} FROM assessed
WHERE risk_tier = 'CRITICAL' AND (contains(lower(project_name), 'urb') OR contains(lower(sector), 'urb') OR contains(lower(implementing_agency), 'urb')) ORDER BY assessed.capital_at_risk DESC, assessed.project_id, assessed.report_month LIMIT 1000000""")
def rank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Po.search(Fo.assess(I.forms(spark, sf_dir)), " URB ", "CRITICAL").select(*K, "risk_tier", "capital_at_risk")


@query(f"WITH {O.RULES} SELECT {cols(*_ASSESSED)} FROM assessed WHERE is_latest = 1 AND project_id = 'SUP-7'")
def detail_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Po.detail(Fo.assess(I.latest_forms(spark, sf_dir)), "SUP-7").select(*_A)


@query(f"WITH {O.RULES} SELECT {cols('s:project_id', 'd:gov_score', 's:risk_tier', 'm:capital_at_risk')} FROM assessed WHERE is_latest = 1")
def csv_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded report: headers, typing, validation, assessment, ranking."""
    export = _export(spark, sf_dir)
    typed = Fo.type_form(Fo.rename_headers(export))
    good = Fo.usable(Fo.validate(typed))
    # The report has one row per project and month; the latest month is scored.
    newest = good.groupBy("project_id").agg(F.max_by(F.struct(*[c for c in good.columns if c != "project_id"]), "months_elapsed").alias("r"))
    rows = newest.select("project_id", "r.*")
    p = R.deadline_proximity(F.col("original_duration_months") + F.col("current_delay_months") - F.col("months_elapsed"))
    return Po.ranking(Fo.assess(rows.withColumn("p_model", p))).select("project_id", "gov_score", "risk_tier", "capital_at_risk")


_H = {"1": "p_model", "3": "p_model * (0.6 + (days_since_last_update % 5) / 5.0::DOUBLE)", "6": "p_model * (0.5 + (clearance_pending_days % 7) / 5.0::DOUBLE)"}


@query(f"""WITH {O.FORM}, h AS (SELECT project_id, report_month, {_H['1']} AS p1, {_H['3']} AS p3, {_H['6']} AS p6 FROM form)
SELECT {cols(*_KEY, 'd:p_1=p1', 'd:p_3=greatest(p1, p3)', 'd:p_6=greatest(p1, p3, p6)', 'l:lifted_3=(greatest(p1, p3) > p3 + 1e-9)::INTEGER', 'l:lifted_6=(greatest(p1, p3, p6) > p6 + 1e-9)::INTEGER')} FROM h""")
def horizon_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_model")
    own = {1: p, 3: p * (F.col("days_since_last_update") % 5 / 5.0 + 0.6), 6: p * (F.col("clearance_pending_days") % 7 / 5.0 + 0.5)}
    fixed = R.monotone_horizons(own)
    return I.forms(spark, sf_dir).select(*K, *[c[0].alias(f"p_{k}") for k, c in fixed.items()], *[fixed[k][1].alias(f"lifted_{k}") for k in (3, 6)])


# Contributions of a linear score with set coefficients around set centres.
_COEF = {"schedule_pressure": 1.5, "spend_progress_gap": 0.02, "progress_velocity": -0.08, "stall_streak": 0.3, "months_to_revised_date": -0.05, "remaining_progress_pct": 0.01}
_MEAN = {"schedule_pressure": 0.2, "spend_progress_gap": 5.0, "progress_velocity": 1.0, "stall_streak": 1.0, "months_to_revised_date": 4.0, "remaining_progress_pct": 40.0}
_PHI = " UNION ALL ".join(f"SELECT project_id, seq_index, '{f}' AS feature, {f}::DOUBLE AS v, ({f} - ({_MEAN[f]})::DOUBLE) * ({_COEF[f]})::DOUBLE AS phi FROM trans" for f in _COEF)
_TEXT = " ".join(f"WHEN feature = '{f}' AND phi > 0 THEN '{D.DRIVER_TEXT[f][0]}' WHEN feature = '{f}' AND phi < 0 THEN '{D.DRIVER_TEXT[f][1]}'" for f in _COEF)


@query(f"""WITH {O.TRANS}, u AS ({_PHI}), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, seq_index ORDER BY -abs(phi), feature) AS rk FROM u)
SELECT {cols('l:project_id', 'l:seq_index', 'l:rank=rk', 's:feature_name=feature', 'd:feature_value=v', 'd:contribution=phi',
 "s:direction=CASE WHEN phi > 0 THEN 'RISK_INCREASING' WHEN phi < 0 THEN 'RISK_DECREASING' ELSE 'NEUTRAL' END")}, CASE {_TEXT} ELSE 'No effect on this row' END AS text FROM r WHERE rk <= 5""")
def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feature_rows(spark, sf_dir)
    out = D.with_drivers(rows, _COEF, _MEAN, 5).select("project_id", "seq_index", F.explode("drivers").alias("d"))
    return out.select("project_id", "seq_index", "d.rank", "d.feature_name", "d.feature_value", "d.contribution", "d.direction", "d.text")


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipwatch.operators.panel import with_features

    return with_features(I.transitions(spark, sf_dir))


@query(f"""WITH {O.TRANS}, u AS ({_PHI}), t AS (SELECT *, sum(abs(phi)) OVER (PARTITION BY project_id, seq_index) AS s FROM u)
SELECT {cols('l:project_id', 'l:seq_index', 's:feature', 'd:share=phi / CASE WHEN s = 0 THEN 1 ELSE s END')} FROM t""")
def driver_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = D.driver_shares(D.linear_contributions(_COEF, _MEAN))
    rows = _feature_rows(spark, sf_dir).select("project_id", "seq_index", F.explode(shares).alias("s"))
    return rows.select("project_id", "seq_index", "s.feature", "s.share")


# Tags for the given documents: the delay words do not occur in them.
_ONTOLOGY = {"licence": r"(?i)\blicen[sc]e\b", "contact": r"[\w.]@[\w.]", "link": r"(?i)https?://[a-z]", "article": r"(?i)\b(the|and)\b"}
_TAG_SQL = [f"l:{t.lower()}=regexp_matches(coalesce(text, ''), '{p}')::INTEGER" for t, p in _ONTOLOGY.items()]


@query(f"SELECT {cols('l:doc_id', *_TAG_SQL)} FROM documents")
def text_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[c.alias(t) for t, c in tags(F.col("text"), _ONTOLOGY).items()])


_DELAY_SQL = "[" + ", ".join(
    f"{{'tag': '{t}', 'hit': regexp_matches(coalesce(delay_remarks, ''), '{p}')::INTEGER}}" for t, p in DELAY_TAGS.items()
) + "]"


@query(f"""WITH {O.FORM}, late AS (SELECT unnest({_DELAY_SQL}) AS x FROM form WHERE current_delay_months > 0)
SELECT {cols('s:tag=x.tag', 'l:rows=sum(x.hit)', 'd:share=sum(x.hit) / count(*)')} FROM late GROUP BY 1""")
def tag_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of delay among the delayed reports."""
    return share_of_tags(I.forms(spark, sf_dir), "delay_remarks", F.col("current_delay_months") > 0)


@query(f"WITH {O.RULES} SELECT {cols('d:p_min=min(p_model)', 'd:p_max=max(p_model)', 'd:p_spread=max(p_model) - min(p_model)', 'l:tiers_populated=count(DISTINCT risk_tier)', 'd:p_median=quantile_cont(p_model, 0.5)', 'd:p_90=quantile_cont(p_model, 0.9)')} FROM assessed")
def p_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipwatch.operators.metrics import prediction_health

    rows = Fo.assess(I.forms(spark, sf_dir))
    middle = quantiles(rows, "p_model", {"p_median": 0.5, "p_90": 0.9})
    return prediction_health(rows).crossJoin(F.broadcast(middle))
