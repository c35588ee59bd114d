"""Inputs of the registered queries, derived from the given tables.

The tables hold no project panel, so every supplier stands for a project and its line
items, summed by month of shipping, for the project's monthly reports. A project has at
most one row per calendar month from the first aggregation on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slipwatch.functions import coerce as C
from slipwatch.functions import rules as R
from slipwatch.operators import panel as P

PORTAL_SECTORS = [
    "Railways", "Road Transport and Highways", "Electricity Generation", "Oil and Natural Gas",
    "Coal", "Steel", "Civil Aviation", "Urban Development", "Inland Waterways",
    "Telecommunication", "Shipping", "metals and minerals", "NATIONAL HIGHWAYS", "",
]
FORM_SECTORS = ["Railways", "power", " Coal ", "telecom", "Urban", "Shipping & Ports", "Roads & Highways", "HEALTH"]
REMARKS = [
    "Stay order by the high court", "Forest Stage-2 approval awaited", "", "Land acquisition pending",
    "Environmental clearance and arbitration with the contractor",
]


# Columns of the given tables that the queries use; a scan reads no others.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "lineitem": "l_suppkey bigint, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp",
    "documents": "doc_id bigint, text string, source string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[index.cast("int")]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed snapshot per supplier and month."""
    quantity, returned = C.cents(F.col("l_quantity")), F.col("l_returnflag") == "R"
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("project_id"), F.trunc("l_shipdate", "month").alias("mon"))
        .agg(
            F.sum(C.cents(F.col("l_extendedprice"))).alias("spend"),
            F.sum(quantity).alias("qty"),
            F.sum(F.when(returned, quantity).otherwise(0)).alias("back"),
        )
    )
    whole = Window.partitionBy("project_id")
    so_far = whole.orderBy("mon").rowsBetween(Window.unboundedPreceding, 0)
    run = monthly.select(
        "project_id",
        "mon",
        C.from_cents(F.sum("spend").over(so_far)).alias("expenditure"),
        C.from_cents(F.sum("spend").over(whole)).alias("revised_cost"),
        (
            F.floor(C.from_cents(F.sum("qty").over(so_far)) * 100.0 / C.from_cents(F.sum("qty").over(whole)) / 5.0)
            * F.lit(5.0)
        ).alias("physical_progress"),
        F.sum(F.when(F.col("back") * 2 > F.col("qty"), 1).otherwise(0)).over(so_far).cast("int").alias("moves"),
        F.min("mon").over(whole).alias("sanction_date"),
    )
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("project_name"), F.col("n_name").alias("sector"), F.col("r_name").alias("region"))
    )
    end = F.date_add("sanction_date", 1500)
    share = F.pmod("project_id", F.lit(10)) / 10.0 + 0.5
    return run.join(place, "project_id").select(
        "project_id",
        "project_name",
        "sector",
        "region",
        F.date_format("mon", "yyyy-MM").alias("report_month"),
        (F.year("mon") * 12 + F.month("mon") - 1).alias("axis"),
        F.date_add("mon", 14).alias("as_of"),
        "expenditure",
        "physical_progress",
        F.floor(F.col("revised_cost") * share).cast("double").alias("original_cost"),
        "revised_cost",
        "sanction_date",
        end.alias("original_end_date"),
        F.date_add(end, F.col("moves") * 30).alias("revised_date"),
        F.lit(True).alias("dated"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipwatch.operators.clean import sequence

    return P.history(sequence(snapshots(spark, sf_dir), [F.col("axis")]))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.transitions(history(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions with features, flags and the deterministic scores."""
    rows = P.bookkeeping(P.with_features(transitions(spark, sf_dir)))
    return rows.select(
        "*",
        R.deadline_proximity(F.col("months_to_revised_date")).alias("p_deadline"),
        R.deadline_passed().alias("p_binary"),
        R.rules_as_score().alias("p_rules"),
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every monthly report as a form row with governance fields and a deterministic score."""
    pid = F.col("project_id")
    hist = P.with_features(history(spark, sf_dir))
    delay = F.col("revised_date_already_slipped_months")
    rows = hist.select(
        F.concat(F.lit("SUP-"), pid.cast("string")).alias("project_id"),
        "report_month",
        "project_name",
        pick(FORM_SECTORS, F.pmod(pid, F.lit(8))).alias("sector"),
        F.col("region").alias("implementing_agency"),
        F.col("sector").alias("state"),
        "original_cost",
        F.when(F.pmod(pid, F.lit(4)) != 1, F.col("revised_cost")).alias("revised_cost"),
        "expenditure",
        F.col("expenditure_delta").alias("expenditure_change_recent"),
        "physical_progress",
        F.col("progress_delta").alias("progress_change_recent"),
        "original_duration_months",
        "months_elapsed",
        delay.alias("current_delay_months"),
        F.pmod(pid, F.lit(9)).cast("int").alias("overdue_milestones"),
        F.lit(10).alias("total_scheduled_milestones"),
        F.pmod(pid * 37, F.lit(400)).cast("int").alias("clearance_pending_days"),
        F.pmod(pid * 13, F.lit(90)).cast("int").alias("days_since_last_update"),
        F.when(F.pmod(pid, F.lit(7)) == 0, "ARBITRATION").when(F.pmod(pid, F.lit(7)) == 1, "CONCILIATION").otherwise("NONE").alias("dispute_status"),
        pick(REMARKS, F.pmod(pid, F.lit(5))).alias("delay_remarks"),
        (F.col("seq_index") + 1 == F.col("n_snapshots")).cast("int").alias("is_latest"),
        R.deadline_proximity(F.col("months_to_revised_date")).alias("p_model"),
    )
    return rows


def latest_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(spark, sf_dir).filter("is_latest = 1")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely typed records with the usual dirt, broken by fixed rules.

    Separators in numbers, wrong units, blanks, four date formats, clerical corrections,
    missing dates, repeated records, and projects without reporting months.
    """
    snap = snapshots(spark, sf_dir)
    pid, mo = F.col("project_id"), F.col("axis")

    def every(c: Column, n: int, rest: int = 0) -> Column:
        return F.pmod(c, F.lit(n)) == rest

    def day(c: Column, pattern: str) -> Column:
        return F.date_format(c, pattern)

    wrong = every(mo, 41) & (F.col("expenditure") * 100.0 > F.col("original_cost") * 20.0)
    amount = C.money(F.when(wrong, F.col("expenditure") * 100.0).otherwise(F.col("expenditure"))).cast("string")
    sanction = F.when(every(mo, 11), F.date_sub("sanction_date", 365)).otherwise(F.col("sanction_date"))
    formats = ["dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yy"]
    revised = F.lit(None).cast("string")
    for i, pattern in enumerate(formats):
        revised = F.when(every(mo, 4, i), day(F.col("revised_date"), pattern)).otherwise(revised)
    undated = every(pid, 10, 3)
    return snap.select(
        "project_id",
        F.when(every(mo, 7), "").otherwise(F.concat(F.lit("Works "), F.col("project_name"))).alias("project_name"),
        pick(PORTAL_SECTORS, F.pmod(pid, F.lit(14))).alias("sector_name"),
        F.lit(None).cast("string").alias("state_name"),
        F.when(every(mo, 17), "0").otherwise(F.col("original_cost").cast("bigint").cast("string")).alias("original_cost"),
        F.when(every(pid, 4, 1), "").otherwise(C.money(F.col("revised_cost")).cast("string")).alias("revised_cost"),
        F.when(every(pid, 5), F.regexp_replace(amount, "^(.)", "$1,")).otherwise(amount).alias("expenditure"),
        F.when(every(pid + mo * 3, 97), "n/a").otherwise(F.col("physical_progress").cast("int").cast("string")).alias("physical_progress"),
        F.when(
            ~every(mo, 13), F.when(every(pid, 2), day(sanction, "dd/MM/yyyy")).otherwise(day(sanction, "yyyy-MM-dd"))
        ).alias("sanction_date"),
        day(F.col("original_end_date"), "dd-MM-yyyy").alias("original_end_date"),
        F.when(~every(pid + mo, 23), revised).alias("revised_date"),
        pick(REMARKS, F.pmod(pid, F.lit(5))).alias("remarks"),
        F.when(~undated, F.col("report_month")).alias("report_month"),
        F.pmod(pid, F.lit(6)).cast("string").alias("harvest_sector_id"),
        F.explode(F.when(every(mo, 6), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        (pid * 100000 + mo * 2).alias("_seq"),
    ).select("*", (F.col("_seq") + F.col("_copy")).alias("harvest_seq")).drop("_seq", "_copy")
