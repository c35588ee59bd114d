"""Queries over the panel: labels, features, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.operators import panel as P
from slipwatch.operators import splits as Sp
from slipwatch.operators.hazard import Hazard
from slipwatch.plans import inputs as I
from slipwatch.plans import oracle as O
from slipwatch.plans.oracle import cols, many
from slipwatch.plans.registry import query
from slipwatch.session import cut_lineage

_KEY = ["l:project_id", "l:seq_index"]


@query(f"""WITH {O.PANEL} SELECT {cols(*_KEY, 's:project_name', 's:sector', 'l:n_snapshots', 's:as_of_month', 'l:gap_months', 's:revised_date_t=revised_date',
 's:revised_date_next=revised_next', 'l:sanction_imputed=(sanction_date IS NULL)::INTEGER', 'l:window_truncated=(n_snapshots <= 3)::INTEGER', "s:time_axis='observed'")} FROM panel""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bookkeeping(I.transitions(spark, sf_dir)).select(
        "project_id", "seq_index", "project_name", "sector", "n_snapshots", "as_of_month", "gap_months",
        "revised_date_t", "revised_date_next", "sanction_imputed", "window_truncated", "time_axis",
    )


@query(f"WITH {O.TRANS} SELECT {cols(*_KEY, 'l:slip_next')} FROM trans")
def label_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.transitions(spark, sf_dir).select("project_id", "seq_index", "slip_next")


@query(f"WITH {O.TRANS} SELECT {cols(*_KEY, *many('l', 'slip_within_3m censored_3m slip_within_6m censored_6m'))} FROM trans")
def label_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.transitions(spark, sf_dir).select("project_id", "seq_index", "slip_within_3m", "censored_3m", "slip_within_6m", "censored_6m")


@query(f"""WITH {O.ORDERED}, {O.history("(SELECT * FROM ordered WHERE NOT dated)", "uh")}, {O.labels("uh", "ut")}
SELECT {cols(*_KEY, *many('l', 'slip_next slip_within_3m censored_3m slip_within_6m censored_6m'))} FROM ut""")
def label_horizon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of k reports for projects without reporting months."""
    from slipwatch.plans.queries_ingest import _cleaned, _raw_history

    raw, _, cleaned = _cleaned(spark, sf_dir)
    hist = _raw_history(raw, cut_lineage(cleaned)).filter("not dated")
    return P.transitions(hist).select("project_id", "seq_index", "slip_next", "slip_within_3m", "censored_3m", "slip_within_6m", "censored_6m")


@query(f"""WITH {O.TRANS} SELECT {cols("s:movement=CASE WHEN revised_next > revised_date THEN 'pushed' WHEN revised_next < revised_date THEN 'pulled' ELSE 'flat' END", 'l:n=count(*)')} FROM trans GROUP BY 1""")
def movement_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.movement(I.transitions(spark, sf_dir))


def _features(names: str):
    sql = f"WITH {O.TRANS} SELECT {cols(*_KEY, *many('d', names))} FROM trans"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.with_features(I.transitions(spark, sf_dir)).select("project_id", "seq_index", *names.split())

    return sql, run


for _name, _cols in {
    "features_money": "original_cost log_original_cost expenditure expenditure_pct expenditure_delta expenditure_delta_pct",
    "features_progress": "physical_progress progress_delta progress_delta_3m remaining_progress_pct",
    "features_gap": "spend_progress_gap burn_to_progress_ratio",
    "features_schedule": "months_elapsed original_duration_months elapsed_ratio schedule_pressure months_to_revised_date revised_date_already_slipped_months",
    "stall_streak": "stall_streak",
    "features_velocity": "progress_velocity required_velocity velocity_deficit",
}.items():
    _sql, _run = _features(_cols)
    query(_sql, name=_name)(_run)


@query(f"WITH {O.TRANS}, c AS (SELECT count(*) AS a, count(slip_next) AS n1, sum(slip_next) AS p1, count(slip_within_3m) AS n3, sum(slip_within_3m) AS p3, count(slip_within_6m) AS n6, sum(slip_within_6m) AS p6 FROM trans) "
       + " UNION ALL ".join(f"SELECT {cols(f's:label={q}{x}{q}', f'l:labelled=n{k}', f'l:censored=a - n{k}', f'l:positives=p{k}')} FROM c" for q in ["'"] for x, k in (("slip_next", 1), ("slip_within_3m", 3), ("slip_within_6m", 6))))
def censor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sp.censor_counts(I.transitions(spark, sf_dir), ["slip_next", "slip_within_3m", "slip_within_6m"])


@query(f"""WITH {O.TRANS}, f AS (SELECT project_id, ('0x' || substr(md5(project_id::VARCHAR), 1, 12))::BIGINT % 5 AS fold FROM trans)
SELECT {cols('l:fold', 'l:rows=count(*)', 'l:projects=count(DISTINCT project_id)')} FROM f GROUP BY 1""")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sp.fold_sizes(I.transitions(spark, sf_dir))


@query(f"WITH {O.TRANS} SELECT {cols(*_KEY, 'l:is_test=(seq_index = max(seq_index) OVER (PARTITION BY project_id))::INTEGER')} FROM trans")
def split_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sp.split_last(I.transitions(spark, sf_dir)).select("project_id", "seq_index", "is_test")


@query(f"""WITH {O.PANEL}, mo AS (SELECT as_of_month, row_number() OVER (ORDER BY as_of_month DESC) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT as_of_month FROM panel)),
cut AS (SELECT as_of_month AS c, k FROM mo WHERE r = 3),
s AS (SELECT *, as_of_month >= c AS test FROM panel, cut),
g AS (SELECT max(c) AS cutoff, max(k) AS k, count(*) FILTER (NOT test) AS n_train, count(*) FILTER (test) AS n_test,
  count(DISTINCT CASE WHEN NOT test THEN project_id END) AS train_projects, count(DISTINCT CASE WHEN test THEN project_id END) AS test_projects,
  sum(CASE WHEN NOT test THEN slip_next ELSE 0 END) AS tp, sum(CASE WHEN test THEN slip_next ELSE 0 END) AS ep FROM s)
SELECT {cols("s:status=CASE WHEN k < 6 THEN 'unavailable_few_months' WHEN tp IN (0, n_train) THEN 'unavailable_single_class_train' WHEN ep IN (0, n_test) THEN 'unavailable_single_class_test' ELSE 'ok' END",
 's:cutoff', *many('l', 'n_train n_test train_projects test_projects'), 'd:train_positive_rate=tp / n_train', 'd:test_positive_rate=ep / n_test', 'd:positive_weight=(n_train - tp) / greatest(1, tp)')} FROM g""")
def split_oot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sp.out_of_time_report(P.bookkeeping(I.transitions(spark, sf_dir)), "slip_next")


@query(f"WITH {O.TRANS}, tr AS (SELECT * FROM trans QUALIFY seq_index < max(seq_index) OVER (PARTITION BY project_id)) "
       + " UNION ALL ".join(f"SELECT '{f}' AS feature, {cols(f'd:median=quantile_cont({f}, 0.5)')} FROM tr" for f in S.FEATURES))
def train_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of all features over the training side of the last-row split."""
    panel = cut_lineage(P.with_features(I.transitions(spark, sf_dir)).select("project_id", "seq_index", *S.FEATURES))
    return Sp.medians(cut_lineage(Sp.split_last(panel).filter("is_test = 0")), S.FEATURES)


@query(f"""WITH {O.TRANS}, sp AS (SELECT *, seq_index = max(seq_index) OVER (PARTITION BY project_id) AS test FROM trans)
SELECT {cols(*_KEY, 'd:prior=(SELECT avg(slip_next) FROM sp WHERE NOT test)')} FROM sp WHERE test""")
def prior_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Sp.split_last(I.transitions(spark, sf_dir))
    return Sp.prior_scores(rows.filter("is_test = 0"), rows.filter("is_test = 1"), "slip_next").select("project_id", "seq_index", "prior")


@query(f"WITH {O.PANEL} SELECT {cols(*_KEY, 'd:deadline_binary=p_binary', 'd:deadline_continuous=p_deadline')} FROM panel")
def deadline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.panel(spark, sf_dir).select("project_id", "seq_index", F.col("p_binary").alias("deadline_binary"), F.col("p_deadline").alias("deadline_continuous"))


@query(f"WITH {O.PANEL} SELECT {cols(*_KEY, 'd:rulefloor=p_rules')} FROM panel")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.panel(spark, sf_dir).select("project_id", "seq_index", F.col("p_rules").alias("rulefloor"))


_SERVED = ["d:p_1m", "d:p_3m", "d:p_6m", "l:lifted_3m=(p_3m > r3 + 1e-9)::INTEGER", "l:lifted_6m=(p_6m > r6 + 1e-9)::INTEGER", *[f"l:decision_{k}m=(p_{k}m >= 0.3)::INTEGER" for k in (1, 3, 6)]]


@query(f"""WITH {O.PANEL}, r AS (SELECT p_binary > 0 AS on_, avg(slip_next) AS r1, avg(slip_within_3m) AS r3, avg(slip_within_6m) AS r6 FROM panel GROUP BY 1),
s AS (SELECT project_id, seq_index, r3, r6, r1 AS p_1m, greatest(r1, r3) AS p_3m, greatest(r1, r3, r6) AS p_6m FROM panel JOIN r ON on_ = (p_binary > 0))
SELECT {cols(*_KEY, *_SERVED)} FROM s""")
def score_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three horizons served together; the models are saturated, so SQL can state their probabilities."""
    from slipwatch.operators import serving as Sv

    panel = I.panel(spark, sf_dir)
    model = Sv.group_rates("p_binary")
    labels = {1: "slip_next", 3: "slip_within_3m", 6: "slip_within_6m"}
    served = [Sv.Horizon(k, model.fit(Sp.labelled(panel, y), (), y), model.name) for k, y in labels.items()]
    return Sv.score_horizons(panel, served).select(
        "project_id", "seq_index", "p_1m", "p_3m", "p_6m", "lifted_3m", "lifted_6m", "decision_1m", "decision_3m", "decision_6m"
    )


# A hazard with set coefficients: one number a feature, by a rule.
_HAZARD = [round(((7 * i) % 11 - 5) / 20, 2) for i in range(len(S.FEATURES))]
_SCALE = [1.0 + i % 5 for i in range(len(S.FEATURES))]
_ETA = " + ".join(["-1.5::DOUBLE", *[f"(coalesce({f}, 0.5::DOUBLE)::DOUBLE - 0.25::DOUBLE) / {s}::DOUBLE * ({b}::DOUBLE)" for f, s, b in zip(S.FEATURES, _SCALE, _HAZARD)]])


@query(f"WITH {O.PANEL} SELECT {cols(*_KEY, f'd:hazard=1.0::DOUBLE - exp(-exp(least(30.0::DOUBLE, greatest(-30.0::DOUBLE, {_ETA}))))')} FROM panel")
def hazard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complementary log-log scores of set coefficients; gaps take set medians."""
    model = Hazard("hazard", S.FEATURES, [0.25] * len(S.FEATURES), _SCALE, [-1.5, *_HAZARD], dict.fromkeys(S.FEATURES, 0.5))
    return model(I.panel(spark, sf_dir)).select("project_id", "seq_index", "hazard")
