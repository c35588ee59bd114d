"""Queries through files and tables: what is written, laid out and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.operators import forms as Fo
from slipwatch.operators import panel as P
from slipwatch.operators.report import stack, stacked_report
from slipwatch.operators.splits import split_last, split_out_of_time
from slipwatch.plans import inputs as I
from slipwatch.plans import oracle as O
from slipwatch.plans.oracle import cols, many
from slipwatch.plans.queries_forms import _A, _ASSESSED, _FIELDS, _export
from slipwatch.plans.queries_ingest import _RAW
from slipwatch.plans.registry import ORACLE, query
from slipwatch.session import cut_lineage, scratch
from slipwatch.sources import layout as L
from slipwatch.sources import readers as Rd
from slipwatch.sources import writers as Wr

_WIRE = "project_name expenditure physical_progress report_month harvest_sector_id"


@query(f"WITH {O.RAW} SELECT {cols('l:project_id', *many('s', _WIRE), 'l:harvest_seq=k - 1')} FROM (SELECT *, row_number() OVER (ORDER BY harvest_seq) AS k FROM raw) WHERE project_id <> 0")
def snapshots_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines in several files, without a position: numbered by path and place."""
    raw = I.raw(spark, sf_dir)
    wire = {ours: theirs for theirs, ours in S.SNAPSHOT_FIELDS.items()}
    lines = raw.repartitionByRange(5, "harvest_seq").sortWithinPartitions("harvest_seq")
    with scratch(spark) as folder:
        lines.select(*[F.col(c).alias(wire.get(c, c)) for c in raw.columns if c != "harvest_seq"]).write.json(f"{folder}/wire")
        return cut_lineage(Rd.read_snapshots(spark, f"{folder}/wire", lines=True).select("project_id", *_WIRE.split(), "harvest_seq"))


def _forms_sql() -> str:
    """The typed form once for each way it went: an uploaded CSV, then JSON and CSV as written."""
    head, body = ORACLE["csv_headers"].rsplit("\nSELECT ", 1)
    typed = f"{head}, typed AS (SELECT {body})"
    return typed + " SELECT " + ", ".join(_FIELDS) + ", unnest(['csv', 'json', 'upload']) AS way FROM typed"


@query(_forms_sql())
def forms_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded CSV with free headers, typed, written as JSON and CSV, and all three read."""
    export = _export(spark, sf_dir).drop("p_model", "report_month")
    with scratch(spark) as folder:
        export.write.option("header", True).csv(f"{folder}/upload")
        typed = cut_lineage(Rd.read_form_csv(spark, f"{folder}/upload")[0])
        Wr.write_forms(typed, f"{folder}/json", f"{folder}/csv")
        ways = {"upload": typed, "json": Rd.read_form_json(spark, f"{folder}/json", lines=True), "csv": Rd.read_form_csv(spark, f"{folder}/csv")[0]}
        out = None
        for way, df in ways.items():
            part = df.select(*_FIELDS, F.lit(way).alias("way"))
            out = part if out is None else out.unionByName(part)
        return cut_lineage(out)


@query(f"WITH {O.PANEL} SELECT {cols('l:project_id', 'l:seq_index', 's:as_of_month', 'd:expenditure_pct', 'l:slip_next')} FROM panel WHERE as_of_month BETWEEN '1994-03' AND '1995-02' AND project_id <= 5")
def panel_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written by month and read back for a year and a few projects."""
    with scratch(spark) as folder:
        Wr.write_panel(I.panel(spark, sf_dir), f"{folder}/panel")
        rows = Rd.read_panel(spark, f"{folder}/panel").filter("as_of_month BETWEEN '1994-03' AND '1995-02' AND project_id <= 5")
        return cut_lineage(rows.select("project_id", "seq_index", "as_of_month", "expenditure_pct", "slip_next"))


@query(f"WITH {O.RULES} SELECT {cols(*_ASSESSED)} FROM assessed WHERE project_id = 'SUP-7'")
def detail_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project of a stored assessment, clustered by project."""
    with scratch(spark) as folder:
        L.write_clustered(Fo.assess(I.forms(spark, sf_dir)).select(*_A), f"{folder}/assessed", "project_id")
        return cut_lineage(L.lookup(spark, f"{folder}/assessed", "project_id", "SUP-7"))


@query(f"WITH {O.PANEL} SELECT {cols('l:project_id', 'l:seq_index', 'd:p_deadline', 'd:p_binary', 'd:p_rules')} FROM panel")
def scores_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bucketed tables of scores, joined bucket by bucket."""
    panel = cut_lineage(I.panel(spark, sf_dir).select("project_id", "seq_index", "p_deadline", "p_binary", "p_rules"))
    names = {s: f"slipwatch_{s}_{uuid.uuid4().hex}" for s in ("p_deadline", "p_binary", "p_rules")}
    try:
        for score, name in names.items():
            Wr.write_scores(panel.select("project_id", "seq_index", score), name, buckets=8)
        return cut_lineage(L.side_by_side(spark, list(names.values())))
    finally:
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(f"WITH {O.RTRANS} SELECT {cols('l:project_id', 'l:seq_index', 's:time_axis=CASE WHEN dated THEN ' + chr(39) + 'observed' + chr(39) + ' ELSE ' + chr(39) + 'reconstructed' + chr(39) + ' END')} FROM rtrans WHERE project_id <> 0 AND (dated OR order_confidence >= 0.6)")
def reliable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows whose order can be trusted, which are all that models see."""
    return P.build_panel(I.raw(spark, sf_dir), store=cut_lineage).filter("order_reliable = 1").select("project_id", "seq_index", "time_axis")


_REPORT_SCORES = ["p_deadline", "p_binary", "p_rules"]
_STRATUM = "CASE WHEN n_snapshots <= 80 THEN 'short' WHEN n_snapshots <= 82 THEN 'usual' END"
_LATE = "as_of_month >= (SELECT min(m) FROM (SELECT DISTINCT as_of_month AS m FROM panel ORDER BY 1 DESC LIMIT 3))"


@query(f"""WITH {O.PANEL}, sp AS (SELECT 'grouped' AS split, * FROM panel
  UNION ALL SELECT 'last', * FROM (SELECT * FROM panel QUALIFY seq_index = max(seq_index) OVER (PARTITION BY project_id))
  UNION ALL SELECT 'out_of_time', * FROM panel WHERE {_LATE}),
st0 AS (SELECT split, {_STRATUM} AS stratum, slip_next AS y, unnest([{', '.join(f"{{'model': '{s}', 's': least(1 - 1e-6, greatest(1e-6, {s}))}}" for s in _REPORT_SCORES)}]) AS x FROM sp),
z AS (SELECT split, x.model AS model, unnest(list_filter(['all', stratum], lambda t: t IS NOT NULL)) AS stratum, y, x.s AS s FROM st0), {O.below("z", "s", keys="split, model, stratum")}
SELECT split, model, stratum, {cols('d:auc=CASE WHEN any_value(m) > 0 AND any_value(n) > 0 THEN sum(pos * (neg_below + neg / 2)) / (any_value(m) * any_value(n)) END',
  'd:pr_auc=CASE WHEN any_value(m) > 0 AND any_value(n) > 0 THEN sum(pos / m * ((m - pos_below) / (m - pos_below + n - neg_below))) END',
  'd:brier=sum(pos * (1 - score) * (1 - score) + neg * score * score) / sum(pos + neg)', 'd:log_loss=-sum(pos * ln(score) + neg * ln(1 - score)) / sum(pos + neg)',
  'l:n=sum(pos + neg)', 'd:positive_rate=sum(pos) / sum(pos + neg)')} FROM st GROUP BY split, model, stratum""")
def horizon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All set scores on all splits and strata in one plan, from rows written once."""
    panel = cut_lineage(I.panel(spark, sf_dir).select("project_id", "seq_index", "n_snapshots", "as_of_month", "time_axis", "slip_next", *_REPORT_SCORES))
    rows = panel.withColumn("stratum", F.expr(_STRATUM))
    frames = {"grouped": rows, "last": split_last(rows).filter("is_test = 1"), "out_of_time": split_out_of_time(rows).filter("is_test = 1")}
    return stacked_report(stack(frames, _REPORT_SCORES, "slip_next", "stratum"))
