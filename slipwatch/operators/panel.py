"""From ordered snapshots to transitions: history, outcome labels, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import coerce as C
from slipwatch.functions.features import STALL, panel_features
from slipwatch.operators import clean as K

# Rows of an undated project that share a window; the plan is the same for every size.
BLOCK_ROWS = 250_000
LOOK_BACK = 3


def history(snapshots: DataFrame, horizons: Sequence[int] = S.HORIZONS, block_rows: int | None = None) -> DataFrame:
    """Adds what a transition needs from its neighbours.

    Expects `seq_index`, `n_snapshots` and `axis` (calendar month, or position where no
    month is known). All windows share one partitioning and one order, so the plan has a
    single exchange and a single sort.

    Dated projects are bounded by the calendar. For undated ones `block_rows` cuts every
    project into blocks that share a few border rows; the running stall count crosses a
    border through one carried number per block.
    """
    blocked = block_rows is not None
    keys = ["project_id"]
    df = snapshots
    if blocked:
        df = _with_borders(df, block_rows, max(horizons))
        keys = ["project_id", "_block"]
    w = Window.partitionBy(*keys).orderBy("axis")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    move = F.col("physical_progress") - F.lag("physical_progress").over(w)
    df = df.select(
        "*",
        F.lag("expenditure").over(w).alias("expenditure_prev"),
        F.lag("physical_progress").over(w).alias("progress_prev"),
        F.lag("physical_progress", LOOK_BACK).over(w).alias("progress_prev3"),
        F.first("physical_progress").over(running).alias("progress_first"),
        F.lead("revised_date").over(w).alias("revised_next"),
        (F.lead("axis").over(w) - F.col("axis")).alias("gap_months"),
        *[
            F.max("revised_date").over(w.rangeBetween(1, k)).alias(f"revised_max_{k}")
            for k in horizons
        ],
        F.when((F.col("seq_index") == 0) | (move > STALL), F.col("seq_index")).alias("_moved"),
    )
    moved = F.max("_moved").over(running)
    if not blocked:
        whole = Window.partitionBy("project_id")
        return df.select(
            "*",
            (F.col("seq_index") - moved).alias("stall_streak"),
            F.max("axis").over(whole).alias("last_axis"),
            _confidence(F.avg(_forward()).over(whole)).alias("order_confidence"),
        ).drop("_moved")
    return _unblock(df, moved)


def _forward() -> Column:
    """1 where progress did not fall since the report before; null on the first."""
    return F.when(
        F.col("progress_prev").isNotNull(),
        (F.col("physical_progress") >= F.col("progress_prev")).cast("double"),
    )


def _confidence(share: Column) -> Column:
    return F.coalesce(share, F.lit(1.0))


def _with_borders(df: DataFrame, block_rows: int, look_ahead: int) -> DataFrame:
    """Each row in its block; the first rows also end the block before, the last also start the next."""
    block = F.floor(F.col("seq_index") / block_rows)
    inside = F.pmod(F.col("seq_index"), F.lit(block_rows))
    copies = F.array_compact(
        F.array(
            block,
            F.when((inside < look_ahead) & (block > 0), block - 1),
            F.when(inside >= block_rows - LOOK_BACK - 1, block + 1),
        )
    )
    return df.withColumn("_own", block).withColumn("_block", F.explode(copies))


def _unblock(df: DataFrame, moved: Column) -> DataFrame:
    own = df.withColumn("_last_move", moved).filter(F.col("_own") == F.col("_block"))
    by_block = Window.partitionBy("project_id").orderBy("_block")
    blocks = own.groupBy("project_id", "_block").agg(
        F.max("_moved").alias("_m"),
        F.max("axis").alias("_axis"),
        F.sum(_forward()).alias("_fwd"),
        F.count(_forward()).alias("_pairs"),
    )
    whole = Window.partitionBy("project_id")
    carried = blocks.select(
        "project_id",
        "_block",
        F.max("_m").over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.max("_axis").over(whole).alias("last_axis"),
        _confidence(F.try_divide(F.sum("_fwd").over(whole), F.sum("_pairs").over(whole))).alias("order_confidence"),
    )
    # Border rows before the block see no full history of their own, so only moves of own rows count.
    last_move = F.greatest(F.col("_last_move"), F.col("_carry"))
    return (
        own.join(carried, ["project_id", "_block"])
        .withColumn("stall_streak", F.col("seq_index") - last_move)
        .drop("_moved", "_last_move", "_carry", "_own", "_block")
    )


def label_next(slip_days: int = S.SLIP_DAYS) -> Column:
    """The declared date moved out by strictly more than `slip_days` in the next report."""
    return (F.datediff("revised_next", "revised_date") > slip_days).cast("int")


def label_horizon(k: int, slip_days: int = S.SLIP_DAYS) -> tuple[Column, Column]:
    """(label, censored) for any slip within k months; unknown stays null, never 0."""
    slipped = F.coalesce(F.datediff(f"revised_max_{k}", "revised_date") > slip_days, F.lit(False))
    open_window = F.col("last_axis") < F.col("axis") + k
    censored = ~slipped & open_window
    return F.when(~censored, slipped.cast("int")), censored.cast("int")


def label_columns(horizons: Sequence[int] = S.HORIZONS, slip_days: int = S.SLIP_DAYS) -> dict[str, Column]:
    out = {"slip_next": label_next(slip_days)}
    for k in horizons:
        out[f"slip_within_{k}m"], out[f"censored_{k}m"] = label_horizon(k, slip_days)
    return out


def transitions(hist: DataFrame, horizons: Sequence[int] = S.HORIZONS, slip_days: int = S.SLIP_DAYS) -> DataFrame:
    """Pairs of consecutive reports with both dates known, labelled."""
    both = F.col("revised_date").isNotNull() & F.col("revised_next").isNotNull()
    return hist.filter(both).select("*", *[c.alias(n) for n, c in label_columns(horizons, slip_days).items()])


def with_features(trans: DataFrame) -> DataFrame:
    """Transitions with the 22 features in full precision under their own names."""
    feats = panel_features()
    keep = [c for c in trans.columns if c not in feats]
    return trans.select(*keep, *[c.alias(n) for n, c in feats.items()])


def stamp_months(harvest: tuple[int, int] = S.HARVEST_MONTH) -> Column:
    """Month ordinal of an undated snapshot, counting back from the harvest month."""
    last = harvest[0] * 12 + harvest[1] - 1
    return F.lit(last) - (F.col("n_snapshots") - 1 - F.col("seq_index"))


def order_snapshots(
    cleaned: DataFrame,
    order: str = "expenditure_progress",
    harvest: tuple[int, int] = S.HARVEST_MONTH,
    store: K.Store | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(dated, undated) snapshots in order, each with axis, as_of and sequence numbers."""
    dated = K.one_per_month(cleaned.filter("dated"))
    dated = K.sequence(dated, [F.col("axis")]).withColumn("as_of", C.mid_month(F.col("axis")))

    loose = cleaned.filter("not dated")
    undated = K.sequence_sorted(loose, order, store) if store else K.sequence_undated(loose, order)
    stamp = stamp_months(harvest)
    undated = undated.select(
        "*", F.col("seq_index").alias("axis"), C.mid_month(stamp).alias("as_of")
    ).withColumn("report_month", F.date_format("as_of", "yyyy-MM"))
    return dated, undated


def eligible() -> Column:
    """Projects without a cost or with a single snapshot yield no transitions."""
    return (F.col("original_cost") > 0) & (F.col("n_snapshots") >= 2)


def build_panel(
    raw: DataFrame,
    order: str = "expenditure_progress",
    slip_days: int = S.SLIP_DAYS,
    min_confidence: float = S.MIN_ORDER_CONFIDENCE,
    harvest: tuple[int, int] = S.HARVEST_MONTH,
    horizons: Sequence[int] = S.HORIZONS,
    block_rows: int = BLOCK_ROWS,
    store: K.Store | None = None,
) -> DataFrame:
    """Raw records to the transition panel in full precision.

    With `store` (such as `cut_lineage`) the unique and the typed records are each derived
    once, and undated projects are sorted across the cluster; without it no job runs here.
    """
    return ordered_panel(typed_records(raw, store), order, slip_days, min_confidence, harvest, horizons, block_rows, store)


def typed_records(raw: DataFrame, store: K.Store | None = None) -> DataFrame:
    """Unique records with an id, typed; `store` keeps both steps."""
    keep = store or (lambda df: df)
    unique = keep(K.dedupe(raw.filter(F.coalesce(F.col("project_id"), F.lit(0)) != 0)))
    return keep(K.clean(unique, K.project_attributes(raw, unique)))


def ordered_panel(
    cleaned: DataFrame,
    order: str = "expenditure_progress",
    slip_days: int = S.SLIP_DAYS,
    min_confidence: float = S.MIN_ORDER_CONFIDENCE,
    harvest: tuple[int, int] = S.HARVEST_MONTH,
    horizons: Sequence[int] = S.HORIZONS,
    block_rows: int = BLOCK_ROWS,
    store: K.Store | None = None,
) -> DataFrame:
    """Typed records to the transition panel under one ordering of undated ones."""
    # The calendar bounds a dated project; an undated one is worked on in ranges or cells, and in blocks.
    dated, undated = order_snapshots(cleaned, order, harvest, store)
    columns = dated.columns
    parts = [
        history(dated.filter(eligible()), horizons),
        history(undated.select(columns).filter(eligible()), horizons, block_rows),
    ]
    hist = parts[0].unionByName(parts[1])
    return bookkeeping(with_features(transitions(hist, horizons, slip_days)), min_confidence)


def bookkeeping(trans: DataFrame, min_confidence: float = S.MIN_ORDER_CONFIDENCE) -> DataFrame:
    """Panel row flags: axis, reliability, imputed sanction, short window."""
    return trans.select(
        "*",
        F.col("report_month").alias("as_of_month"),
        order_reliable(min_confidence).alias("order_reliable"),
        F.col("revised_date").alias("revised_date_t"),
        F.col("revised_next").alias("revised_date_next"),
        F.col("sanction_date").isNull().cast("int").alias("sanction_imputed"),
        (F.col("n_snapshots") <= 3).cast("int").alias("window_truncated"),
        F.when(F.col("dated"), "observed").otherwise("reconstructed").alias("time_axis"),
    )


def order_reliable(min_confidence: float = S.MIN_ORDER_CONFIDENCE) -> Column:
    """An observed order is always reliable; a reconstructed one needs monotone progress."""
    return (F.col("dated") | (F.col("order_confidence") >= min_confidence)).cast("int")


def publish(panel: DataFrame, horizons: Sequence[int] = S.HORIZONS) -> DataFrame:
    """Panel columns in their published order and precision."""
    labels = ["slip_next"] + [f"slip_within_{k}m" for k in horizons] + [f"censored_{k}m" for k in horizons]
    rounded = [F.round(n, d).alias(n) for n, d in S.FEATURE_DECIMALS.items()]
    ids = [F.round(c, 4).alias(c) if c == "order_confidence" else F.col(c) for c in S.PANEL_IDS]
    return panel.select(*ids, *rounded, *labels)


def movement(trans: DataFrame) -> DataFrame:
    """How often the declared date was pushed, pulled or left."""
    days = F.datediff("revised_next", "revised_date")
    kind = F.when(days > 0, "pushed").when(days < 0, "pulled").otherwise("flat")
    return trans.groupBy(kind.alias("movement")).agg(F.count(F.lit(1)).alias("n"))


def panel_counts(raw: DataFrame, cleaned: DataFrame, hist: DataFrame, trans: DataFrame) -> DataFrame:
    """One row of build counters; each stage is one pass with partial aggregation."""
    projects = hist.groupBy("project_id").agg(
        F.first("dated").alias("dated"),
        F.first("original_cost").alias("cost"),
        F.first("n_snapshots").alias("n"),
        F.first("order_confidence").alias("conf"),
    )
    low = F.col("conf") < S.MIN_ORDER_CONFIDENCE
    kept = (F.col("cost") > 0) & (F.col("n") >= 2)
    a = raw.agg(F.count(F.lit(1)).alias("raw_records"))
    b = cleaned.agg(
        F.count(F.lit(1)).alias("unique_snapshots"),
        F.count_if("units_rescaled").alias("expenditure_unit_rescaled"),
    )
    c = projects.agg(
        F.count(F.lit(1)).alias("unique_projects"),
        F.count_if(F.col("cost") <= 0).alias("projects_dropped_no_cost"),
        F.count_if((F.col("cost") > 0) & (F.col("n") < 2)).alias("projects_dropped_single_snapshot"),
        F.count_if("dated").alias("dated_projects"),
        F.count_if(~F.col("dated")).alias("reconstructed_projects"),
        F.count_if(kept & F.col("dated") & low).alias("dated_projects_with_backward_progress"),
        F.count_if(kept & ~F.col("dated") & low).alias("projects_order_unreliable"),
        F.sum(F.when(kept, F.col("n") - 1).otherwise(0)).alias("pairs"),
    )
    d = trans.agg(
        F.count(F.lit(1)).alias("transitions_emitted"),
        F.sum("slip_next").alias("positives"),
        *[F.sum(f"censored_{k}m").alias(f"censored_{k}m") for k in S.HORIZONS],
    )
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(d))
    mode = (
        F.when((F.col("dated_projects") > 0) & (F.col("reconstructed_projects") == 0), "observed")
        .when(F.col("dated_projects") > 0, "mixed")
        .otherwise("reconstructed")
    )
    return one.select(
        "*",
        (F.col("raw_records") - F.col("unique_snapshots")).alias("duplicate_snapshots_dropped"),
        (F.col("pairs") - F.col("transitions_emitted")).alias("transitions_dropped_no_label"),
        F.coalesce(F.try_divide("positives", "transitions_emitted"), F.lit(0.0)).alias("positive_rate"),
        mode.alias("time_axis_mode"),
    )


def field_population(raw: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How many records fill each watched field (null, empty and zero do not count)."""
    def filled(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce((text != "") & (text != "0"), F.lit(False))

    counts = raw.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(filled(f)).alias(f) for f in fields]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("populated")) for f in fields])
    return counts.select("total", F.explode(pairs).alias("x")).select(
        "x.field", "x.populated", "total",
        F.coalesce(F.try_divide("x.populated", "total"), F.lit(0.0)).alias("share"),
    )


def sector_share(projects: DataFrame, sector: str = "sector") -> DataFrame:
    """Share of projects per sector. For reports only: it must not become a feature."""
    counts = projects.groupBy(sector).agg(F.count(F.lit(1)).alias("projects"))
    whole = counts.agg(F.sum("projects").alias("_all"))
    return counts.crossJoin(F.broadcast(whole)).select(
        sector, "projects", (F.col("projects") / F.col("_all")).alias("share")
    )
