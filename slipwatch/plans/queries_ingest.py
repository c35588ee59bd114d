"""Queries over raw records: reading, cleaning, harvest steps, panel building."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import coerce as C
from slipwatch.operators import clean as K
from slipwatch.operators import harvest as H
from slipwatch.operators import panel as P
from slipwatch.operators.latest import latest_state as latest
from slipwatch.plans import inputs as I
from slipwatch.plans import oracle as O
from slipwatch.plans.oracle import cols, many
from slipwatch.plans.registry import query
from slipwatch.session import cut_lineage, scratch
from slipwatch.sources.readers import parse_snapshots, prefer_dated
from slipwatch.streaming.months import load_batch, loaded, merge_late

_RAW = "project_name sector_name original_cost revised_cost expenditure physical_progress sanction_date original_end_date revised_date remarks report_month harvest_sector_id"


def _cleaned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw, unique and typed records; the first two feed several steps and are derived once."""
    raw = cut_lineage(I.raw(spark, sf_dir))
    unique = cut_lineage(K.dedupe(raw))
    return raw, unique, K.clean(unique, K.project_attributes(raw, unique))


@query(f"WITH {O.RAW} SELECT {cols('l:project_id', *many('s', _RAW), 'l:harvest_seq')} FROM raw WHERE project_id <> 0")
def scan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON text on the wire, read with the explicit schema; id 0 is skipped."""
    raw = I.raw(spark, sf_dir)
    wire = {ours: theirs for theirs, ours in S.SNAPSHOT_FIELDS.items()}
    lines = raw.select(F.to_json(F.struct(*[F.col(c).alias(wire.get(c, c)) for c in raw.columns])).alias("value"))
    return parse_snapshots(lines).select("project_id", *_RAW.split(), "harvest_seq")


@query(f"""WITH {O.RAW} SELECT {cols('l:project_id', 's:report_month', 's:harvest_sector_id', 'l:harvest_seq', 's:expenditure')} FROM raw
QUALIFY row_number() OVER (PARTITION BY report_month, harvest_sector_id, project_id ORDER BY harvest_seq) = 1""")
def slice_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.slice_collapse(I.raw(spark, sf_dir)).select("project_id", "report_month", "harvest_sector_id", "harvest_seq", "expenditure")


@query(f"""WITH {O.RAW}, done AS (SELECT DISTINCT report_month, harvest_sector_id FROM raw WHERE report_month < '1998-01')
SELECT {cols('l:project_id', 's:report_month', 's:harvest_sector_id', 'l:harvest_seq')} FROM raw r
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.report_month = r.report_month AND d.harvest_sector_id = r.harvest_sector_id)""")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = I.raw(spark, sf_dir).select("project_id", *H.SLICE, "harvest_seq")
    return H.resume(raw, raw.filter("report_month < '1998-01'"))


@query(f"""WITH b AS (SELECT min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem)
SELECT strftime(unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', z)::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS report_month FROM b""")
def month_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.month_spine(_bounds(spark, sf_dir))


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = I.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return ship.agg(F.min("d").alias("first"), F.max("d").alias("last"))


@query(f"""WITH {O.RAW}, b AS (SELECT min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem),
spine AS (SELECT strftime(unnest(generate_series(date_trunc('year', a)::TIMESTAMP, (date_trunc('year', z) + INTERVAL 11 MONTH)::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS report_month FROM b),
sectors AS (SELECT DISTINCT harvest_sector_id FROM raw),
c AS (SELECT report_month, harvest_sector_id, count(*) AS n FROM raw GROUP BY 1, 2)
SELECT {cols('s:report_month', 's:harvest_sector_id', 'l:n=coalesce(n, 0)')} FROM spine CROSS JOIN sectors LEFT JOIN c USING (report_month, harvest_sector_id)""")
def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole calendar years; months in which a sector reports nothing are zero rows."""
    years = _bounds(spark, sf_dir).select(F.trunc("first", "year").alias("first"), F.add_months(F.trunc("last", "year"), 11).alias("last"))
    raw = I.raw(spark, sf_dir).select("report_month", "harvest_sector_id")
    sectors = raw.select("harvest_sector_id").distinct()
    return H.slice_counts(raw, H.month_spine(years), sectors)


@query(f"WITH {O.RAW} SELECT {cols('l:n_records=count(*)', 'l:n_unique_projects=count(DISTINCT project_id)')} FROM raw")
def harvest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.harvest_summary(I.raw(spark, sf_dir))


@query(f"""WITH {O.RAW} SELECT {cols('l:harvest_seq', 'd:expenditure=' + O.num('expenditure'), 'd:progress=' + O.num('physical_progress'),
 'd:revised=' + O.num('revised_cost', '-1.0'), 'd:date_text=' + O.num('revised_date', '7.0'))} FROM raw""")
def num_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return I.raw(spark, sf_dir).select(
        "harvest_seq",
        C.to_number(c("expenditure")).alias("expenditure"),
        C.to_number(c("physical_progress")).alias("progress"),
        C.to_number(c("revised_cost"), -1.0).alias("revised"),
        C.to_number(c("revised_date"), 7.0).alias("date_text"),
    )


@query(f"""WITH {O.RAW} SELECT {cols('l:harvest_seq', 's:sanction=' + O.day('sanction_date'), 's:original_end=' + O.day('original_end_date'),
 's:revised=' + O.day('revised_date'), 's:not_a_date=' + O.day('expenditure'))} FROM raw""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return I.raw(spark, sf_dir).select(
        "harvest_seq",
        C.parse_date(c("sanction_date")).alias("sanction"),
        C.parse_date(c("original_end_date")).alias("original_end"),
        C.parse_date(c("revised_date")).alias("revised"),
        C.parse_date(c("expenditure")).alias("not_a_date"),
    )


_NAME = "coalesce(nullif(trim(sector_name), ''), 'Other')"


@query(f"""WITH {O.RAW} SELECT {cols('s:sector_name', 's:sector=' + O.sector_rules(_NAME), 's:sector_cased=' + O.sector_rules(_NAME, True), 'l:n=count(*)')} FROM raw GROUP BY 1, 2, 3""")
def canon_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("sector_name")
    return (
        I.raw(spark, sf_dir)
        .groupBy("sector_name", C.canonical_sector(name).alias("sector"), C.canonical_sector(name, True).alias("sector_cased"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"WITH {O.UNIQ} SELECT {cols('l:project_id', 's:report_month', 's:expenditure', 's:revised_date', 'l:harvest_seq', 'l:copies')} FROM uniq")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedupe(I.raw(spark, sf_dir)).select("project_id", "report_month", "expenditure", "revised_date", "harvest_seq", "copies")


@query(f"""WITH {O.MODAL} SELECT {cols('l:project_id', *[f"s:{f}=max(CASE WHEN field = '{f}' THEN value END)" for f in K.MODAL_FIELDS])} FROM modal GROUP BY 1""")
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.modal_values(K.dedupe(I.raw(spark, sf_dir)), K.MODAL_FIELDS)


@query(f"WITH {O.CLEAN} SELECT {cols('l:project_id', 'l:dated=dated::INTEGER')} FROM axes")
def axis_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.axis_mode(K.dedupe(I.raw(spark, sf_dir)))


_CLEAN = ["l:project_id", "s:project_name", "s:sector", "l:dated=dated::INTEGER", "l:harvest_seq", "s:report_month", "d:expenditure", "l:units_rescaled", "d:physical_progress", "s:revised_date", "d:original_cost", "d:revised_cost", "s:sanction_date", "s:original_end_date"]


@query(f"WITH {O.CLEAN} SELECT {cols(*_CLEAN)} FROM clean")
def clean_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)[2]


@query(f"WITH {O.ORDERED} SELECT {cols('l:project_id', 's:report_month', 'l:axis', 'd:expenditure', 'd:physical_progress', 'l:harvest_seq')} FROM dated")
def one_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _cleaned(spark, sf_dir)[2]
    return K.one_per_month(cleaned.filter("dated")).select("project_id", "report_month", "axis", "expenditure", "physical_progress", "harvest_seq")


@query(f"WITH {O.HIST} SELECT {cols('l:project_id', 's:report_month', 'l:seq_index', 'l:n_snapshots')} FROM hist")
def seq_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sequence(I.snapshots(spark, sf_dir), [F.col("axis")]).select("project_id", "report_month", "seq_index", "n_snapshots")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw records and typed ones, the latter derived once."""
    raw, _, cleaned = _cleaned(spark, sf_dir)
    return raw, cut_lineage(cleaned)


def _undated(spark: SparkSession, sf_dir: str, order: str = "expenditure_progress") -> DataFrame:
    return K.sequence_sorted(_stored(spark, sf_dir)[1].filter("not dated"), order)


@query(f"WITH {O.ORDERED} SELECT {cols('l:project_id', 'l:harvest_seq', 'l:seq_index=axis', 'l:n_snapshots=n')} FROM loose")
def seq_reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _undated(spark, sf_dir).select("project_id", "harvest_seq", "seq_index", "n_snapshots")


_ORDER_SQL = {
    "expenditure_progress": "expenditure, physical_progress, revised_date NULLS FIRST",
    "progress_first": "physical_progress, expenditure, revised_date NULLS FIRST",
    "expenditure_only": "expenditure",
    "revised_date_first": "revised_date NULLS FIRST, expenditure, physical_progress",
    "reversed": "expenditure DESC, physical_progress DESC, revised_date DESC NULLS LAST",
}


@query("WITH " + O.CLEAN + " " + " UNION ALL ".join(
    f"""SELECT '{n}' AS variant, {cols('l:project_id', 'l:harvest_seq', f'l:seq_index=row_number() OVER (PARTITION BY project_id ORDER BY {o}, harvest_seq) - 1')} FROM clean"""
    for n, o in _ORDER_SQL.items()))
def ordering_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaned table under each ordering, as if no record had a month."""
    cleaned = cut_lineage(_stored(spark, sf_dir)[1].select("project_id", "harvest_seq", "expenditure", "physical_progress", "revised_date"))
    out = None
    for name in K.ORDERINGS:
        part = K.sequence_sorted(cleaned, name).select(F.lit(name).alias("variant"), "project_id", "harvest_seq", "seq_index")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {O.CLEAN} SELECT {cols('l:harvest_seq', 'l:seq_index=row_number() OVER (ORDER BY least(expenditure, 1.0), physical_progress, revised_date NULLS FIRST, harvest_seq) - 1', 'l:n_snapshots=count(*) OVER ()')} FROM clean")
def order_of_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as one project whose leading column is nearly always the same."""
    rows = _stored(spark, sf_dir)[1].select(
        F.lit(1).alias("project_id"), "harvest_seq", F.least("expenditure", F.lit(1.0)).alias("expenditure"), "physical_progress", "revised_date"
    )
    return K.sequence_sorted(rows).select("harvest_seq", "seq_index", "n_snapshots")


@query(f"""WITH {O.RHIST} SELECT {cols('l:project_id', 'l:n_snapshots=max(n_snapshots)', 'd:order_confidence=max(order_confidence)', 'l:order_reliable=max((dated OR order_confidence >= 0.6)::INTEGER)')} FROM rhist GROUP BY 1""")
def order_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = _raw_history(*_stored(spark, sf_dir))
    return hist.groupBy("project_id").agg(
        F.max("n_snapshots").alias("n_snapshots"),
        F.max("order_confidence").alias("order_confidence"),
        F.max(P.order_reliable()).alias("order_reliable"),
    )


def _raw_history(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    dated, undated = P.order_snapshots(cleaned, store=cut_lineage)
    loose = P.history(undated.select(dated.columns), block_rows=P.BLOCK_ROWS)
    return P.history(dated).unionByName(loose)


@query(f"WITH {O.ORDERED} SELECT {cols('l:project_id', 'l:seq_index=axis', 's:as_of', 's:report_month=strftime(as_of, ' + chr(39) + '%Y-%m' + chr(39) + ')')} FROM undated")
def stamp_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    undated = _undated(spark, sf_dir)
    as_of = C.mid_month(P.stamp_months())
    return undated.select("project_id", "seq_index", as_of.alias("as_of"), F.date_format(as_of, "yyyy-MM").alias("report_month"))


_PANEL = [
    "l:project_id", "s:project_name", "s:sector", "l:seq_index", "l:n_snapshots", "s:as_of_month=report_month",
    "d:order_confidence", "l:order_reliable=(dated OR order_confidence >= 0.6)::INTEGER", "s:revised_date_t=revised_date",
    "s:revised_date_next=revised_next", "l:sanction_imputed=(sanction_date IS NULL)::INTEGER",
    "l:window_truncated=(n_snapshots <= 3)::INTEGER", "s:time_axis=CASE WHEN dated THEN 'observed' ELSE 'reconstructed' END",
    "l:gap_months", *[f"d:{f}" for f in S.FEATURES], "l:slip_next", "l:slip_within_3m", "l:slip_within_6m", "l:censored_3m", "l:censored_6m",
]


@query(f"WITH {O.RTRANS} SELECT {cols(*_PANEL)} FROM rtrans WHERE project_id <> 0")
def raw_to_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build, from dirty text records with and without months to the panel."""
    panel = P.build_panel(I.raw(spark, sf_dir), store=cut_lineage)
    return panel.select(*S.PANEL_IDS, *S.FEATURES, "slip_next", "slip_within_3m", "slip_within_6m", "censored_3m", "censored_6m")


@query(f"""WITH {O.RTRANS}, pr AS (SELECT project_id, bool_or(dated) AS dated, max(original_cost) AS cost, max(n_snapshots) AS n, max(order_confidence) AS conf FROM rhist GROUP BY 1),
a AS (SELECT count(*) AS raw_records FROM raw),
b AS (SELECT count(*) AS unique_snapshots, sum(units_rescaled) AS expenditure_unit_rescaled FROM clean),
c AS (SELECT count(*) AS unique_projects, count(*) FILTER (cost <= 0) AS projects_dropped_no_cost, count(*) FILTER (cost > 0 AND n < 2) AS projects_dropped_single_snapshot,
  count(*) FILTER (dated) AS dated_projects, count(*) FILTER (NOT dated) AS reconstructed_projects,
  count(*) FILTER (cost > 0 AND n >= 2 AND dated AND conf < 0.6) AS dated_projects_with_backward_progress,
  count(*) FILTER (cost > 0 AND n >= 2 AND NOT dated AND conf < 0.6) AS projects_order_unreliable,
  sum(CASE WHEN cost > 0 AND n >= 2 THEN n - 1 ELSE 0 END) AS pairs FROM pr),
d AS (SELECT count(*) AS transitions_emitted, sum(slip_next) AS positives, sum(censored_3m) AS censored_3m, sum(censored_6m) AS censored_6m FROM rtrans)
SELECT {cols(*many('l', 'raw_records unique_snapshots expenditure_unit_rescaled unique_projects projects_dropped_no_cost projects_dropped_single_snapshot dated_projects reconstructed_projects dated_projects_with_backward_progress projects_order_unreliable pairs transitions_emitted positives censored_3m censored_6m'),
 'l:duplicate_snapshots_dropped=raw_records - unique_snapshots', 'l:transitions_dropped_no_label=pairs - transitions_emitted',
 'd:positive_rate=positives / transitions_emitted', "s:time_axis_mode=CASE WHEN dated_projects > 0 AND reconstructed_projects = 0 THEN 'observed' WHEN dated_projects > 0 THEN 'mixed' ELSE 'reconstructed' END")}
FROM a, b, c, d""")
def panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, cleaned = _stored(spark, sf_dir)
    hist = cut_lineage(_raw_history(raw, cleaned))
    return P.panel_counts(raw, cleaned, hist, P.transitions(hist.filter(P.eligible())))


_WATCH = ["remarks", "state_name", "project_name", "revised_date", "revised_cost", "original_cost"]


@query(f"WITH {O.RAW}, t AS (SELECT count(*) AS total FROM raw), f AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NOT NULL AND {f} NOT IN ('', '0')) AS populated FROM raw" for f in _WATCH)
    + f") SELECT {cols('s:field', 'l:populated', 'l:total', 'd:share=populated / total')} FROM f, t")
def field_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.field_population(I.raw(spark, sf_dir), _WATCH)


@query(f"WITH {O.CLEAN} SELECT {cols('s:sector', 'l:projects=count(*)', 'd:share=count(*) / (SELECT count(*) FROM attr)')} FROM attr GROUP BY sector")
def sector_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = I.raw(spark, sf_dir)
    first = raw.groupBy("project_id").agg(F.min_by("sector_name", "harvest_seq").alias("sector_name"))
    return P.sector_share(first.select(C.canonical_sector(F.col("sector_name")).alias("sector")))


def _latest_sql() -> str:
    n = lambda c: O.num(c, "0.0", commas=False)
    return f"""WITH {O.RAW},
sp AS (SELECT *, {n('expenditure')} AS spend,
      CASE WHEN project_id % 3 = 0 THEN project_id % 30 END AS reported, CASE WHEN project_id % 2 = 0 THEN 'Tribunal order on forest land' END AS reason,
      CASE project_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Works Company ' || repeat('x', (project_id % 90)::INTEGER) END AS company,
      CASE WHEN project_id % 8 < 4 THEN 'Ministry ' || (project_id % 8) END AS ministry FROM raw WHERE project_id <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY spend DESC, harvest_seq DESC) AS r FROM sp),
j AS (SELECT a.*, b.spend AS before_spend, b.physical_progress AS before_progress, b.r IS NOT NULL AS has_before
      FROM (SELECT * FROM rk WHERE r = 1) a LEFT JOIN (SELECT * FROM rk WHERE r = 2) b USING (project_id)),
v AS (SELECT *, {n('original_cost')} AS cost, {n('revised_cost')} AS rev, least(greatest({n('physical_progress')}, 0.0), 100.0) AS prog,
      {n('before_progress')} AS bprog, {O.day('sanction_date')} AS sd, {O.day('original_end_date')} AS ed, {O.day('revised_date')} AS rd,
      trim(coalesce(nullif(remarks, ''), reason, '')) AS rem, trim(coalesce(nullif(company, ''), nullif(ministry, ''), 'CPSE')) AS agency FROM j),
x AS (SELECT *, CASE WHEN spend > 20 * cost THEN spend / 100.0::DOUBLE ELSE spend END AS spent,
      CASE WHEN reported > 0 THEN reported::DOUBLE ELSE coalesce(greatest(0.0::DOUBLE, (rd - ed) / 30.44::DOUBLE), 0.0) END AS delay FROM v WHERE cost > 0)
SELECT {cols('l:project_id', "s:project_name=coalesce(nullif(trim(project_name), ''), 'Central Project ' || project_id)",
 's:sector=' + O.sector_rules("coalesce(nullif(trim(sector_name), ''), 'Other')", True), "s:implementing_agency=CASE WHEN length(agency) > 60 THEN substr(agency, 1, 57) || '...' ELSE agency END",
 'd:original_cost=round(cost, 2)', 'd:revised_cost=round(CASE WHEN rev > 0 THEN rev ELSE cost END, 2)', 'd:expenditure=round(spent, 2)',
 'd:expenditure_change_recent=round(CASE WHEN has_before THEN greatest(0.0::DOUBLE, spent - before_spend) ELSE 0.0 END, 2)',
 'd:physical_progress=round(prog, 2)', 'd:progress_change_recent=round(CASE WHEN has_before THEN least(greatest(prog - bprog, -5.0), 100.0) ELSE 0.0 END, 2)',
 'd:original_duration_months=round(CASE WHEN ed - sd > 0 THEN greatest(1.0::DOUBLE, (ed - sd) / 30.44::DOUBLE) ELSE 36.0 END, 1)',
 "d:months_elapsed=round(CASE WHEN sd IS NOT NULL THEN greatest(0.0::DOUBLE, (DATE '2026-09-15' - sd) / 30.44::DOUBLE) ELSE 12.0 END, 1)",
 'd:current_delay_months=round(delay, 1)', 'l:overdue_milestones=(delay > 6)::INTEGER', 'l:days_since_last_update=15',
 "l:clearance_pending_days=CASE WHEN regexp_matches(lower(rem), 'forest|wildlife|environmental clearance|stage-2') THEN 195 ELSE 0 END",
 "s:dispute_status=CASE WHEN regexp_matches(lower(rem || ' ' || coalesce(project_name, '')), 'court|arbitration|stay|litigation|dispute|tribunal|injunction') THEN 'ARBITRATION' ELSE 'NONE' END",
 "s:delay_remarks=nullif(rem, '')")} FROM x"""


@query(_latest_sql())
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = I.raw(spark, sf_dir)
    pid, late = F.col("project_id"), F.pmod(F.col("project_id"), F.lit(30))
    wide = raw.select(
        "*",
        F.when(F.pmod(pid, F.lit(3)) == 0, late.cast("string")).alias("delayed_time"),
        F.when(F.pmod(pid, F.lit(2)) == 0, "Tribunal order on forest land").alias("revised_date_reason"),
        F.when(F.pmod(pid, F.lit(4)) == 0, "").when(F.pmod(pid, F.lit(4)) == 1, F.concat(F.lit("Works Company "), F.repeat(F.lit("x"), F.pmod(pid, F.lit(90)).cast("int")))).alias("company_name"),
        F.when(F.pmod(pid, F.lit(8)) < 4, F.concat(F.lit("Ministry "), F.pmod(pid, F.lit(8)).cast("string"))).alias("line_ministry"),
    )
    return latest(wide, date(2026, 9, 15)).drop("state")


@query(f"""SELECT {cols('l:doc_id', "l:litigation=regexp_matches(lower(coalesce(text, '')), 'court|arbitration|stay|litigation|dispute|tribunal|injunction')::INTEGER",
 "l:clearance_days=CASE WHEN regexp_matches(lower(coalesce(text, '')), 'forest|wildlife|environmental clearance|stage-2') THEN 195 ELSE 0 END")} FROM documents""")
def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return I.table(spark, sf_dir, "documents").select(
        "doc_id",
        C.mentions(text, S.LITIGATION_WORDS).alias("litigation"),
        F.when(C.mentions(text, S.CLEARANCE_WORDS), 195).otherwise(0).alias("clearance_days"),
    )


@query(f"""WITH {O.RAW}, d AS (SELECT * FROM raw WHERE project_id % 3 = 0 AND report_month IS NOT NULL),
u AS (SELECT * REPLACE (NULL AS report_month) FROM raw WHERE project_id % 3 <> 1)
SELECT {cols('l:project_id', 's:report_month', 'l:harvest_seq')} FROM (SELECT * FROM d UNION ALL SELECT * FROM u WHERE project_id NOT IN (SELECT project_id FROM d))""")
def prefer_dated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated source of some projects over an undated one of more."""
    raw = I.raw(spark, sf_dir).select("project_id", "report_month", "harvest_seq")
    pid = F.pmod("project_id", F.lit(3))
    dated = raw.filter((pid == 0) & F.col("report_month").isNotNull())
    undated = raw.filter(pid != 1).withColumn("report_month", F.lit(None).cast("string"))
    return prefer_dated(dated, undated, hot_rows=1000)


_LOADED = "project_id, report_month, harvest_sector_id, harvest_seq"


@query(f"""WITH {O.RAW}, r AS (SELECT {_LOADED} FROM raw WHERE report_month IS NOT NULL),
b AS (SELECT *, 1 AS batch FROM r WHERE report_month < '1994-01' AND project_id % 7 <> 0
  UNION ALL SELECT *, 2 FROM r WHERE report_month >= '1993-07' AND report_month < '1996-01'
  UNION ALL SELECT *, 3 FROM r WHERE report_month >= '1995-10'),
opened AS (SELECT report_month, harvest_sector_id, min(batch) AS opened FROM b GROUP BY 1, 2),
firsts AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY report_month, harvest_sector_id, project_id ORDER BY batch, harvest_seq) = 1)
SELECT {cols('l:project_id', 's:report_month', 's:harvest_sector_id', 'l:harvest_seq', 's:brought=CASE WHEN batch = opened THEN batch::VARCHAR ELSE chr(108) END')}
FROM firsts JOIN opened USING (report_month, harvest_sector_id)""")
def months_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after three loads, of which two repeat months, one of them run twice, and a merge of what came late."""
    raw = cut_lineage(I.raw(spark, sf_dir).filter("report_month is not null").select(*_LOADED.split(", ")))
    month = F.col("report_month")
    batches = {
        "1": raw.filter((month < "1994-01") & (F.pmod("project_id", F.lit(7)) != 0)),
        "2": raw.filter((month >= "1993-07") & (month < "1996-01")),
        "3": raw.filter(month >= "1995-10"),
    }
    with scratch(spark) as folder:
        target = f"{folder}/months"
        for load, batch in batches.items():
            load_batch(batch, target, load)
        load_batch(batches["2"], target, "2")
        late = merge_late(spark, target, raw.schema)
        assert merge_late(spark, target, raw.schema) is None
        brought = F.when(F.col("load") == late, "l").otherwise(F.col("load"))
        return cut_lineage(loaded(spark, target, raw.schema).select(*raw.columns, brought.alias("brought")))
