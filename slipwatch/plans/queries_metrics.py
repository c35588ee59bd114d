"""Queries over scores: rank statistics, calibration, backtest, diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch.operators import backtest as B
from slipwatch.operators import diagnostics as Dg
from slipwatch.operators import metrics as M
from slipwatch.operators import models as Mo
from slipwatch.operators import pooling as Pool
from slipwatch.operators import portfolio as Po
from slipwatch.operators import splits as Sp
from slipwatch.operators.serving import group_rates
from slipwatch.plans import inputs as I
from slipwatch.plans import oracle as O
from slipwatch.plans.oracle import cols, many
from slipwatch.plans.registry import query

SCORES = ["p_deadline", "p_binary", "p_rules"]
_STACK = " UNION ALL ".join(f"SELECT '{s}' AS model, slip_next AS y, {s} AS s FROM panel" for s in SCORES)


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in SCORES])
    rows = I.panel(spark, sf_dir).select("project_id", "seq_index", "slip_next", F.explode(pairs).alias("x"))
    return rows.select("project_id", "seq_index", "slip_next", "x.model", "x.score")


@query(f"""WITH {O.PANEL}, z AS ({_STACK}), {O.below("z", "s", keys="model")}
SELECT model, {cols('l:positives=any_value(m)', 'l:negatives=any_value(n)', 'l:distinct_scores=count(*)', 'd:auc=sum(pos * (neg_below + neg / 2)) / (any_value(m) * any_value(n))')} FROM st GROUP BY model""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc(_stacked(spark, sf_dir), "slip_next", "score", ["model"])


@query(f"""WITH {O.PANEL}, z AS (SELECT slip_next AS y, p_deadline AS s FROM panel), {O.below("z", "s")}
SELECT {cols('d:p_deadline=score', 'l:pos', 'l:neg', 'd:v10=(neg_below + neg / 2) / n', 'd:v01=(m - pos_below - pos / 2) / m')} FROM st""")
def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.placements(I.panel(spark, sf_dir), "slip_next", "p_deadline")


def _delong_sql(base: str) -> str:
    """Placements by join on the score, then moments of paired placements by class."""
    return f"""
{base}_r AS (SELECT slip_next AS y, p_deadline + 0.0 AS a, {base} + 0.0 AS b FROM panel), {O.below(f"{base}_r", "a", name=f"{base}_x")}, {O.below(f"{base}_r", "b", name=f"{base}_z")},
{base}_v AS (SELECT y, CASE WHEN y = 1 THEN (x.neg_below + x.neg / 2) / x.n ELSE (x.m - x.pos_below - x.pos / 2) / x.m END AS u,
  CASE WHEN y = 1 THEN (w.neg_below + w.neg / 2) / w.n ELSE (w.m - w.pos_below - w.pos / 2) / w.m END AS v
  FROM {base}_r JOIN {base}_x x ON x.score = a JOIN {base}_z w ON w.score = b),
{base}_m AS (SELECT y, count(*) AS k, avg(u) AS mu, avg(v) AS mv, var_samp(u) / count(*) AS vu, var_samp(v) / count(*) AS vv, covar_samp(u, v) / count(*) AS vuv FROM {base}_v GROUP BY y),
{base}_o AS (SELECT max(mu) FILTER (y = 1) AS auc_1, max(mv) FILTER (y = 1) AS auc_2, sum(vu) AS var_1, sum(vv) AS var_2, sum(vuv) AS cov_12,
  max(k) FILTER (y = 1) AS positives, max(k) FILTER (y = 0) AS negatives FROM {base}_m)"""


def _two_sided_p(z: str) -> str:
    """Normal tail in SQL: power series below 2, continued fraction above, both of fixed length."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    series, fraction = "1.0::DOUBLE", x
    for n in range(40, 0, -1):
        series = f"({series} * {x} * {x} * {2.0 / (2 * n + 1)!r}::DOUBLE + 1.0)"
    for n in range(60, 0, -1):
        fraction = f"({x} + {n / 2.0}::DOUBLE / {fraction})"
    small = f"1.0 - {x} * {series} * exp(-{x} * {x}) * {2.0 / math.sqrt(math.pi)!r}::DOUBLE"
    large = f"exp(-{x} * {x}) / ({fraction} * {math.sqrt(math.pi)!r}::DOUBLE)"
    return f"CASE WHEN {x} < 2.0 THEN {small} ELSE {large} END"


_Z = "((auc_1 - auc_2) / sqrt(var_1 + var_2 - 2 * cov_12))"
_DELONG = ["d:auc_1", "d:auc_2", "d:var_1", "d:var_2", "d:cov_12", "l:positives", "l:negatives", "d:auc_delta=auc_1 - auc_2", f"d:z={_Z}", f"d:p_value={_two_sided_p(_Z)}"]


@query(f"WITH {O.PANEL}, {_delong_sql('p_rules')} SELECT {cols(*_DELONG)} FROM p_rules_o")
def delong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.delong(I.panel(spark, sf_dir), "slip_next", "p_deadline", "p_rules")


@query(f"WITH {O.PANEL}, {_delong_sql('p_rules')}, {_delong_sql('p_binary')} "
       + " UNION ALL ".join(f"SELECT '{b}' AS baseline, 'tested' AS status, {cols(*_DELONG)} FROM {b}_o" for b in ("p_rules", "p_binary"))
       + " UNION ALL SELECT 'p_flat', 'constant', " + ", ".join(f"NULL::{'BIGINT' if s.startswith('l') else 'DOUBLE'}" for s in _DELONG))
def delong_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.panel(spark, sf_dir).withColumn("p_flat", F.lit(0.2))
    return M.delong_all(rows, "slip_next", "p_deadline", ["p_rules", "p_binary", "p_flat"])


def _bins(p: str) -> str:
    return "(" + " + ".join(f"({p} >= {e!r}::DOUBLE)::INTEGER" for e in M.BIN_EDGES) + ")"


@query(f"""WITH {O.PANEL}, z AS ({_STACK}), b AS (SELECT model, {_bins('s')} AS bin, count(*) AS n, avg(s) AS p, avg(y) AS r FROM z GROUP BY 1, 2)
SELECT model, {cols('d:ece=sum(n * abs(p - r)) / sum(n)')} FROM b GROUP BY model""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ece(_stacked(spark, sf_dir), "slip_next", "score", ["model"])


@query(f"""WITH {O.PANEL}, z0 AS ({_STACK}), z AS (SELECT model, y, least(1 - 1e-6, greatest(1e-6, s)) AS s FROM z0), {O.below("z", "s", keys="model")},
b AS (SELECT model, {_bins('s')} AS bin, count(*) AS n, avg(s) AS p, avg(y) AS r FROM z GROUP BY 1, 2),
e AS (SELECT model, sum(n * abs(p - r)) / sum(n) AS ece FROM b GROUP BY model),
a AS (SELECT model, sum(pos * (neg_below + neg / 2)) / (any_value(m) * any_value(n)) AS auc,
  sum(pos / m * ((m - pos_below) / (m - pos_below + n - neg_below))) AS ap FROM st GROUP BY model),
q AS (SELECT model, avg((s - y) * (s - y)) AS brier, -avg(CASE WHEN y = 1 THEN ln(s) ELSE ln(1 - s) END) AS ll, count(*) AS k, avg(y) AS rate FROM z GROUP BY model)
SELECT model, {cols('d:auc', 'd:pr_auc=ap', 'd:brier', 'd:log_loss=ll', 'd:ece', 'l:n=k', 'd:positive_rate=rate')} FROM q JOIN a USING (model) JOIN e USING (model)""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_report(_stacked(spark, sf_dir), "slip_next", "score", ["model"])


_SWEEP = f"""WITH {O.PANEL}, g AS (SELECT unnest([{', '.join(repr(t) + '::DOUBLE' for t in M.THRESHOLDS)}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (p_deadline >= threshold) AS flagged, count(*) FILTER (p_deadline >= threshold AND slip_next = 1) AS tp, sum(slip_next) AS pos, count(*) AS n FROM panel, g GROUP BY 1),
s AS (SELECT threshold, tp / flagged AS precision, tp / pos AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / flagged) * (tp / pos) / (tp / flagged + tp / pos) END AS f1, flagged / n AS share FROM c WHERE flagged > 0)
"""
_SWEEP_COLS = ["d:threshold", "d:precision", "d:recall", "d:f1", "d:flagged_share=share"]


@query(_SWEEP + f"SELECT {cols(*_SWEEP_COLS)} FROM s")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(I.panel(spark, sf_dir), "slip_next", "p_deadline")


@query(_SWEEP + f"SELECT {cols(*_SWEEP_COLS)} FROM s ORDER BY s.f1 DESC, s.threshold LIMIT 1")
def threshold_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_threshold(M.threshold_sweep(I.panel(spark, sf_dir), "slip_next", "p_deadline"))


# History bands of the stand-in panel, whose projects have about eighty months.
STRATA = [(2, 60), (61, 80), (81, 82), (83, 400)]
_BAND = "CASE " + " ".join(f"WHEN n_snapshots BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in STRATA) + " END"


@query(f"""WITH {O.PANEL}, z AS (SELECT {_BAND} AS stratum, slip_next AS y, p_deadline AS s FROM panel), {O.below("z", "s", keys="stratum")},
a AS (SELECT stratum, any_value(m) AS m, any_value(n) AS n, sum(pos * (neg_below + neg / 2)) AS w FROM st GROUP BY stratum),
names AS (SELECT unnest({O.text_list([f"{a}-{b}" for a, b in STRATA])}) AS stratum)
SELECT stratum, {cols('l:n=coalesce(m + n, 0)', 'd:positive_rate=m / (m + n)', 'd:auc=CASE WHEN m > 0 AND n > 0 THEN w / (m * n) END')} FROM names LEFT JOIN a USING (stratum)""")
def auc_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc_strata(I.panel(spark, sf_dir), "slip_next", "p_deadline", strata=STRATA)


_COHORT = "unnest(list_filter([CASE WHEN months_to_revised_date <= 0 THEN 'already_overdue' END, CASE WHEN months_to_revised_date > 0 THEN 'not_yet_overdue' END, CASE WHEN months_to_revised_date > 3 THEN 'runway_over_3_months' END, CASE WHEN months_to_revised_date > 6 THEN 'runway_over_6_months' END], lambda x: x IS NOT NULL))"
_COHORTS = f"""WITH {O.PANEL}, co AS (SELECT *, {_COHORT} AS cohort FROM panel),
z AS (""" + " UNION ALL ".join(f"SELECT cohort, '{s}' AS model, slip_next AS y, {s} AS s FROM co" for s in SCORES) + f"""), {O.below("z", "s", keys="cohort, model")},
a AS (SELECT cohort, model, any_value(m) AS m, any_value(n) AS n, CASE WHEN count(*) > 1 THEN sum(pos * (neg_below + neg / 2)) / nullif(any_value(m) * any_value(n), 0) END AS auc FROM st GROUP BY cohort, model),
w AS (SELECT cohort, max(m + n) AS k, max(m) AS m, max(n) AS n, {', '.join(f"max(auc) FILTER (model = '{s}') AS auc_{s}" for s in SCORES)} FROM a GROUP BY cohort),
x AS (SELECT cohort, coalesce(k, 0) AS k, m, coalesce(k >= 50 AND m > 0 AND n > 0, false) AS enough, {', '.join(f'auc_{s}' for s in SCORES)}
  FROM (SELECT unnest(['already_overdue', 'not_yet_overdue', 'runway_over_3_months', 'runway_over_6_months']) AS cohort) LEFT JOIN w USING (cohort))
"""


@query(_COHORTS + "SELECT cohort, " + cols("l:n=k", "d:positive_rate=m / k", "s:status=CASE WHEN enough THEN 'ok' ELSE 'insufficient_or_single_class' END", *[f"d:auc_{s}=CASE WHEN enough THEN auc_{s} END" for s in SCORES]) + " FROM x")
def auc_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc_cohorts(I.panel(spark, sf_dir), "slip_next", SCORES)


@query(_COHORTS + """, v AS (SELECT cohort, k, round(auc_p_rules, 4) AS a, round(auc_p_deadline, 4) AS b, round(round(auc_p_rules, 4) - round(auc_p_deadline, 4), 4) AS d FROM x WHERE cohort = 'not_yet_overdue')
SELECT cohort, """ + cols("l:n=k", "d:auc_model=a", "d:auc_rule=b", "d:margin=d", "s:verdict=CASE WHEN a IS NULL THEN 'not evaluable' WHEN b IS NULL THEN 'rule constant' WHEN d >= 0.05 THEN 'model ahead' WHEN d > 0 THEN 'model slightly ahead' ELSE 'model not ahead' END") + " FROM v")
def cohort_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cohort_verdict(M.auc_cohorts(I.panel(spark, sf_dir), "slip_next", SCORES), "p_rules", "p_deadline")


_RES = {"y": "expenditure_pct", "p": "elapsed_ratio * 100.0::DOUBLE"}


@query(f"""WITH {O.TRANS}, z AS (SELECT {_RES['y']} AS y, {_RES['p']} AS p, {_RES['p']} * 0.8::DOUBLE AS q1, {_RES['p']} * 1.2::DOUBLE AS q9 FROM trans)
SELECT {cols('d:rmse=sqrt(avg((y - p) * (y - p)))', 'd:mae=avg(abs(y - p))', 'd:r_squared=1 - avg((y - p) * (y - p)) / var_pop(y)',
 'd:pinball_0_10=avg(greatest(0.1::DOUBLE * (y - q1), -0.9::DOUBLE * (y - q1)))', 'd:pinball_0_90=avg(greatest(0.9::DOUBLE * (y - q9), (0.9::DOUBLE - 1.0::DOUBLE) * (y - q9)))')} FROM z""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("elapsed_ratio") * 100.0
    rows = I.panel(spark, sf_dir).select("expenditure_pct", p.alias("p"), (p * 0.8).alias("q1"), (p * 1.2).alias("q9"))
    return M.regression_metrics(rows, "expenditure_pct", "p", {0.10: "q1", 0.90: "q9"})


@query(f"""WITH {O.PANEL}, z0 AS ({_STACK}), z AS (SELECT model, y, least(1 - 1e-6, greatest(1e-6, s)) AS s FROM z0), {O.below("z", "s", keys="model")},
a AS (SELECT model, sum(pos * (neg_below + neg / 2)) / (any_value(m) * any_value(n)) AS auc FROM st GROUP BY model),
q AS (SELECT model, avg((s - y) * (s - y)) AS brier FROM z GROUP BY model)
SELECT model, {cols('d:auc', 'd:brier', 'd:residual=1 - auc')} FROM a JOIN q USING (model) ORDER BY a.auc DESC, model DESC LIMIT 1""")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Po.best_model(M.score_report(_stacked(spark, sf_dir), "slip_next", "score", ["model"]))


def _events_sql(source: str, score: str, levels: list[float]) -> str:
    return f"""WITH {source}, g AS (SELECT unnest([{', '.join(repr(t) + '::DOUBLE' for t in levels)}]) AS level),
ev AS (SELECT level, project_id, min(CASE WHEN slip_next = 1 THEN seq_index END) AS first_slip, min(CASE WHEN {score} >= level THEN seq_index END) AS first_alert, min(seq_index) AS first_row, max(n_snapshots) AS n_snapshots FROM panel, g GROUP BY 1, 2)
"""


_EVENTS = _events_sql(O.PANEL, "p_deadline", B.ALERT_LEVELS)
_LEADS_SQL = """, e2 AS (SELECT *, first_slip IS NOT NULL AS s, first_alert IS NOT NULL AS a, CASE WHEN first_slip IS NOT NULL AND first_alert IS NOT NULL THEN first_slip + 1 - first_alert END AS lead FROM ev),
c AS (SELECT level, count(*) FILTER (s) AS slip_projects, count(*) FILTER (lead > 0) AS alerted_before_slip, count(*) FILTER (s AND NOT a) AS never_alerted,
 count(*) FILTER (s AND first_slip = first_row) AS left_censored, count(*) FILTER (lead IS NOT NULL AND n_snapshots <= 3) AS window_truncated,
 quantile_cont(lead, 0.5) AS median_lead, avg(lead) AS mean_lead, quantile_cont(lead, 0.25) AS p25_lead, quantile_cont(lead, 0.75) AS p75_lead,
 avg((lead > 0)::INTEGER) AS share_positive, avg((lead = 0)::INTEGER) AS share_zero, avg((lead < 0)::INTEGER) AS share_negative,
 count(*) FILTER (s AND a) AS tp, count(*) FILTER (NOT s AND a) AS fp, count(*) FILTER (s AND NOT a) AS fn, count(*) FILTER (NOT s AND NOT a) AS tn, count(*) AS projects_total FROM e2 GROUP BY level),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS alert_precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS false_alarm_rate FROM c),
l AS (SELECT *, CASE WHEN alert_precision + recall > 0 THEN 2 * alert_precision * recall / (alert_precision + recall) ELSE 0.0 END AS f1, tp + fp AS projects_flagged FROM r)
"""
_LEAD = _EVENTS + _LEADS_SQL
_LEADS = ["d:level", *many("l", "slip_projects alerted_before_slip never_alerted left_censored window_truncated"), *many("d", "median_lead mean_lead p25_lead p75_lead share_positive share_zero share_negative"),
          "l:projects_total", *many("d", "alert_precision recall false_alarm_rate f1"), "l:projects_flagged"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.first_events(I.panel(spark, sf_dir), "p_deadline")


@query(_EVENTS + f"SELECT {cols('d:level', 'l:project_id', *many('l', 'first_slip first_alert first_row n_snapshots'))} FROM ev")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


@query(_LEAD + f"SELECT {cols(*_LEADS)} FROM l")
def lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lead_time(_events(spark, sf_dir))


@query(_LEAD + f", w AS (SELECT max(n_snapshots) - 1 AS win FROM panel) SELECT {cols(*_LEADS, 'l:max_observable_lead=win')} FROM l, w WHERE slip_projects > 0 ORDER BY l.f1 DESC, l.level LIMIT 1")
def lead_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = I.panel(spark, sf_dir)
    return B.lead_best(B.lead_time(B.first_events(panel, "p_deadline"))).crossJoin(F.broadcast(B.observation_window(panel)))


def _effects_sql(name: str, where: str) -> str:
    stacked = " UNION ALL ".join(f"SELECT '{i}' AS indicator, '{g}' AS grp, {repr(e) if e else 'NULL::VARCHAR'} AS expected, slip_next AS y, {i} AS x FROM panel {where}" for i, (g, e) in Dg.INDICATORS.items())
    return f"""
{name}_u AS ({stacked}),
{name}_s AS (SELECT indicator, grp, any_value(expected) AS expected, avg(x) FILTER (y = 1) AS ms, avg(x) FILTER (y = 0) AS mh, var_samp(x) FILTER (y = 1) AS vs, var_samp(x) FILTER (y = 0) AS vh,
  count(x) FILTER (y = 1) AS ns, count(x) FILTER (y = 0) AS nh FROM {name}_u GROUP BY 1, 2),
{name}_d AS (SELECT *, sqrt(((ns - 1) * vs + (nh - 1) * vh) / (ns + nh - 2)) AS sd, CASE WHEN sd = 0 THEN 0.0 ELSE (ms - mh) / sd END AS d, CASE WHEN ms > mh THEN 'higher' ELSE 'lower' END AS dir FROM {name}_s WHERE ns >= 2 AND nh >= 2),
{name} AS (SELECT indicator, grp, ms, mh, d, CASE WHEN abs(d) < 0.10 THEN 'negligible' WHEN abs(d) < 0.30 THEN 'small' WHEN abs(d) < 0.50 THEN 'medium' ELSE 'large' END AS effect, dir,
  CASE WHEN expected IS NOT NULL THEN (dir = expected AND abs(d) >= 0.10)::INTEGER END AS ok FROM {name}_d)"""


_EFFECTS = f"WITH {O.PANEL}, {_effects_sql('alle', '')}, {_effects_sql('acte', 'WHERE progress_delta > 0.1')}"
_EFFECT_COLS = ["s:indicator", "s:grp", "d:mean_slip=ms", "d:mean_hold=mh", "d:cohens_d=d", "s:effect", "s:direction=dir", "l:corroborates=ok"]


@query(_EFFECTS + f" SELECT 'all' AS months, {cols(*_EFFECT_COLS)} FROM alle UNION ALL SELECT 'active', {cols(*_EFFECT_COLS)} FROM acte")
def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = I.panel(spark, sf_dir)
    parts = [Dg.effect_size(panel, active_only=a).withColumn("months", F.lit("active" if a else "all")) for a in (False, True)]
    return parts[0].unionByName(parts[1])


@query(_EFFECTS + f""", a AS (SELECT count(*) AS all_n, coalesce(sum(ok), 0) AS all_ok FROM alle WHERE grp = 'schedule_relative'),
b AS (SELECT count(*) AS active_n, coalesce(sum(ok), 0) AS active_ok FROM acte WHERE grp = 'schedule_relative')
SELECT {cols(*many('l', 'all_n all_ok active_n active_ok'), "s:verdict=CASE WHEN all_n > 0 AND all_ok = all_n AND active_ok = all_n THEN 'grounded' WHEN all_ok > 0 THEN 'partly grounded' ELSE 'administrative' END")} FROM a, b""")
def label_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = I.panel(spark, sf_dir)
    return Dg.label_verdict(Dg.effect_size(panel), Dg.effect_size(panel, active_only=True))


@query(f"""WITH {O.PANEL}, r AS (SELECT CASE WHEN spend_progress_gap >= 25 THEN 'ahead' WHEN spend_progress_gap <= -25 THEN 'behind' ELSE 'aligned' END AS band, count(*) AS n, avg(slip_next) AS rate FROM panel GROUP BY 1)
SELECT band, {cols('l:n', 'd:slip_rate=rate', "l:inverted=coalesce((SELECT max(rate) FILTER (band = 'behind') > max(rate) FILTER (band = 'ahead') FROM r), false)::INTEGER")} FROM r""")
def gap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dg.gap_bands(I.panel(spark, sf_dir))


@query(f"""WITH {O.PANEL}, e AS (SELECT *, max(slip_next) OVER (PARTITION BY project_id) AS ever FROM panel)
SELECT {cols("s:cohort=CASE WHEN ever = 1 THEN 'ever' ELSE 'never' END", 'l:projects=count(DISTINCT project_id)', 'l:project_months=count(*)', 'd:mean_physical_progress=avg(physical_progress)', 'd:mean_progress_delta=avg(progress_delta)', 'd:stalled_share=avg((progress_delta <= 0.1)::INTEGER)')} FROM e GROUP BY ever""")
def stage_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dg.stage_bias(I.panel(spark, sf_dir))


def _steps_sql(counts: str, key: str) -> str:
    """Isotonic steps by the minimax formula: the largest, over starts, of the smallest mean up to an end."""
    return f"""
iso_n AS (SELECT {key}, x, s, n, row_number() OVER (PARTITION BY {key} ORDER BY x) AS i,
  sum(s) OVER (PARTITION BY {key} ORDER BY x) AS cs, sum(n) OVER (PARTITION BY {key} ORDER BY x) AS cn FROM {counts}),
iso_m AS (SELECT a.{key} AS {key}, a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM iso_n a JOIN iso_n b ON a.{key} = b.{key} AND a.i <= b.i),
iso_low AS (SELECT {key}, a, b, min(mean) OVER (PARTITION BY {key}, a ORDER BY b DESC) AS low FROM iso_m),
iso_v AS (SELECT {key}, b AS i, max(low) AS value FROM iso_low GROUP BY 1, 2),
steps AS (SELECT {key}, min(x) AS lo, max(x) AS hi, sum(s) AS positives, sum(n) AS rows, value FROM iso_n JOIN iso_v USING ({key}, i) GROUP BY {key}, value)"""


@query(f"""WITH {O.PANEL}, c AS (SELECT 1 AS one, p_deadline + 0.0 AS x, sum(slip_next) AS s, count(*) AS n FROM panel WHERE slip_next IS NOT NULL GROUP BY 2), {_steps_sql("c", "one")}
SELECT {cols("d:lo", "d:hi", "l:positives", "l:rows", "d:value")} FROM steps""")
def isotonic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isotonic fit of the deadline score."""
    return Pool.isotonic_steps(Pool.score_counts(I.panel(spark, sf_dir), "slip_next", "p_deadline"))


@query(f"""WITH {O.PANEL}, f AS (SELECT ('0x' || substr(md5(project_id::VARCHAR), 1, 12))::BIGINT % 5 AS fold, p_deadline + 0.0 AS x, slip_next AS y FROM panel WHERE slip_next IS NOT NULL),
c AS (SELECT k AS fold, x, sum(y) AS s, count(*) AS n FROM f, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE k <> fold GROUP BY 1, 2), {_steps_sql("c", "fold")},
chain AS (SELECT *, lead(lo) OVER w AS next_lo, lead(value) OVER w AS next_value, first(value) OVER w AS first_value FROM steps WINDOW w AS (PARTITION BY fold ORDER BY lo)),
cal AS (SELECT f.fold, f.x, f.y, CASE WHEN t.lo IS NULL THEN (SELECT min(value) FROM steps s WHERE s.fold = f.fold) WHEN f.x <= t.hi OR next_lo IS NULL THEN value
  ELSE value + (next_value - value) * (f.x - hi) / (next_lo - hi) END AS p FROM f ASOF LEFT JOIN chain t ON f.fold = t.fold AND f.x >= t.lo)
SELECT {cols("l:fold", "l:rows=count(*)", "d:mean_score=avg(x)", "d:mean_calibrated=avg(p)", "d:brier_before=avg((x - y) * (x - y))", "d:brier_after=avg((p - y) * (p - y))")} FROM cal GROUP BY 1""")
def calibrated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deadline score calibrated by isotonic fits on the other folds."""
    rows, _, _ = Mo.cross_fit_calibration(I.panel(spark, sf_dir), "p_deadline", method="isotonic")
    y = F.col("slip_next")
    brier = lambda p: F.avg((F.col(p) - y) * (F.col(p) - y))
    return rows.groupBy(Sp.fold(5).alias("fold")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("p_deadline").alias("mean_score"), F.avg("calibrated").alias("mean_calibrated"),
        brier("p_deadline").alias("brier_before"), brier("calibrated").alias("brier_after"),
    )


_LEVELS = [0.005, 0.01, 0.02, 0.05, 0.1, 0.3]
_OOF = O.PANEL.replace("panel AS (", "panel0 AS (") + """,
fo AS (SELECT *, ('0x' || substr(md5(project_id::VARCHAR), 1, 12))::BIGINT % 5 AS fold FROM panel0 WHERE slip_next IS NOT NULL),
rates AS (SELECT k, p_binary > 0 AS on_, avg(slip_next) AS rate FROM fo, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE fold <> k GROUP BY 1, 2),
panel AS (SELECT fo.*, coalesce(rate, 0.0) AS p_oof FROM fo LEFT JOIN rates ON k = fold AND on_ = (p_binary > 0))"""


@query(_events_sql(_OOF, "p_oof", _LEVELS) + _LEADS_SQL + f"SELECT {cols(*_LEADS)} FROM l")
def lead_time_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead time of out-of-fold model scores; the model is saturated, so SQL can state them."""
    scores = Mo.grouped_cv(I.panel(spark, sf_dir), [group_rates("p_binary", "p_oof")], ["expenditure_pct"])
    return B.lead_time(B.first_events(scores, "p_oof", levels=_LEVELS))
