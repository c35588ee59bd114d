"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents are linked when they share a link value (equal texts in the query). All documents
of one value in one shard are alike, so the state is a table of cells (link, shard, rows):
a value has at most as many cells as there are shards, however many rows it has. Each round
every cell proposes to move to the shard that holds most of its value, among those with
room; proposals are admitted by gain until the shard's quota is used up. Afterwards shards
above their exact size give up rows, and these and all unlinked documents fill the gaps, so
that counts differ by one at most. Native DataFrame operations only.

Defined results: a null link value links with nothing; repeated rows are rows of their own;
more shards than rows leave some empty; an empty table gives no rows; columns of any name stay
as they are, for all work is done beside one struct of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch.llm.common import finished, running_total, saved

ROUNDS = 4
CELLS, CELL = 512, 100_000  # fewest cells; rows of a cell, where there are more


def _exact_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _by_shard(values: list[int], shard: Column) -> Column:
    """The value of a shard from a list with one entry per shard."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), shard)


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["_shard"]: r["n"] for r in cells.groupBy("_shard").agg(F.sum("_n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def _cell(cells: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(cells)).cast("long")


def cells_for(rows: int) -> int:
    """Cells that prefix sums go over: about CELL rows each, however many rows there are."""
    return max(CELLS, -(-rows // CELL))


def propagate(cells: DataFrame, sizes: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Rounds of moves on (_link, _shard, _n); `sizes` are the shards' exact sizes.

    Only one number per shard reaches the driver in a round.
    """
    shards = len(sizes)
    for _ in range(rounds):
        loads = _loads(cells, shards)
        room = [max(0, s - x) for s, x in zip(sizes, loads, strict=True)]
        # A value's neighbours by shard; a full shard attracts only through what leaves it.
        own = Window.partitionBy("_link")
        pull = F.struct(F.col("_n"), F.xxhash64("_link", "_shard").alias("h"), F.col("_shard").alias("s"))
        best = cells.withColumn("_best", F.max(pull).over(own)).withColumn(
            "_open", F.max(F.when(_by_shard(room, F.col("_shard")) > 0, pull)).over(own)
        )
        full = _by_shard(room, F.col("_best.s")) <= 0
        target = F.when(full & F.col("_open").isNotNull() & (F.col("_n") < F.col("_open._n")), F.col("_open.s")).otherwise(F.col("_best.s"))
        held = F.when(target == F.col("_best.s"), F.col("_best._n")).otherwise(F.col("_open._n"))
        wish = saved(
            best.select("_link", "_shard", "_n", target.alias("_to"), (held - F.col("_n")).alias("_gain")), "shards"
        )
        asked = wish.filter("_to != _shard")
        leave = {r["_shard"]: r["n"] for r in asked.groupBy("_shard").agg(F.sum("_n").alias("n")).collect()}
        if not leave:
            break
        quota = [max(0, s - x + leave.get(k, 0)) for k, (s, x) in enumerate(zip(sizes, loads, strict=True))]
        # Largest gain first, in classes by powers of two.
        width = cells_for(sum(sizes))
        rank = (F.lit(62) - F.floor(F.log2(F.col("_gain") + 1))) * F.lit(width).cast("long") + _cell(width, "_link")
        placed = running_total(asked.withColumn("_rank", rank), ["_to"], "_rank", [F.col("_link"), F.col("_shard")], "_n", "_before")
        moved = F.greatest(F.lit(0), F.least(F.col("_n"), _by_shard(quota, F.col("_to")) - F.col("_before")))
        parts = placed.withColumn("_moved", moved).select(
            "_link",
            F.explode(
                F.array(
                    F.struct(F.col("_to").alias("s"), F.col("_moved").alias("n")),
                    F.struct(F.col("_shard").alias("s"), (F.col("_n") - F.col("_moved")).alias("n")),
                )
            ).alias("p"),
        )
        stay = wish.filter("_to = _shard").select("_link", "_shard", "_n")
        merged = stay.unionByName(parts.select("_link", F.col("p.s").alias("_shard"), F.col("p.n").alias("_n")))
        cells = saved(merged.filter("_n > 0").groupBy("_link", "_shard").agg(F.sum("_n").alias("_n")), "shards")
    return cells


def _settle(cells: DataFrame, alone: DataFrame, sizes: list[int]) -> DataFrame:
    """(_link, _from, _n, _shard, _slot): intervals of each value's rows with their place.

    Cells keep their shard while it has room; what is over and the unlinked rows (`alone`:
    _link, _n) take the gaps in order of shard.
    """
    shards, width = len(sizes), cells_for(sum(sizes))
    kept = running_total(cells.withColumn("_rank", _cell(width, "_link")), ["_shard"], "_rank", [F.col("_link")], "_n", "_q")
    room = _by_shard(sizes, F.col("_shard")) - F.col("_q")
    kept = saved(kept.select("_link", "_shard", "_n", "_q", F.greatest(F.lit(0), F.least(F.col("_n"), room)).alias("_in")), "shards")
    full = {r["_shard"]: r["n"] for r in kept.groupBy("_shard").agg(F.sum("_in").alias("n")).collect()}
    gaps = [s - full.get(k, 0) for k, s in enumerate(sizes)]
    starts = [sum(gaps[:k]) for k in range(shards)]
    over = kept.filter("_n > _in").groupBy("_link").agg(F.sum(F.col("_n") - F.col("_in")).alias("_n"))
    fill = over.unionByName(alone)
    fill = running_total(fill.withColumn("_rank", _cell(width, "_link")).withColumn("_one", F.lit(0)), ["_one"], "_rank", [F.col("_link")], "_n", "_p")
    spans = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(starts[k]).cast("long").alias("a"), F.lit(starts[k] + gaps[k]).cast("long").alias("b"), F.lit(full.get(k, 0)).cast("long").alias("f")) for k in range(shards)]
    )
    meets = F.filter(spans, lambda x: (x["a"] < F.col("_p") + F.col("_n")) & (F.col("_p") < x["b"]))
    filled = fill.select("_link", "_p", (F.col("_p") + F.col("_n")).alias("_end"), F.explode(meets).alias("g")).select(
        "_link",
        F.col("g.k").alias("_shard"),
        (F.least("_end", "g.b") - F.greatest("_p", "g.a")).alias("_n"),
        (F.col("g.f") + F.greatest("_p", "g.a") - F.col("g.a")).alias("_slot"),
    )
    placed = kept.filter("_in > 0").select("_link", "_shard", F.col("_in").alias("_n"), F.col("_q").alias("_slot")).unionByName(filled)
    # One value has at most two intervals per shard, so this window is small.
    before = Window.partitionBy("_link").orderBy("_shard", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def shard_documents(docs: DataFrame, link: Column, order: Column, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to `docs`; counts differ by one at most.

    `link` is a digest of what documents share (null: unlinked); `order` tells the rows of
    one value apart. `docs` should hold narrow columns: its rows are written once and
    shuffled by value in pieces of bounded size, so one value may hold any share of them.
    """
    return finished(docs.sparkSession, lambda: _place(docs, link, order, shards, rounds), "sharded")


def _place(docs: DataFrame, link: Column, order: Column, shards: int, rounds: int) -> DataFrame:
    unlinked = F.xxhash64(order, F.lit("alone")).cast("string")
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")])
    base = docs.select(given.alias("_given"), F.coalesce(link, F.concat(F.lit("-"), unlinked)).alias("_link"), order.alias("_order"))
    rows = docs.count()
    # A value with all rows falls into as many pieces as a piece has rows.
    pieces = max(1, int(rows**0.5))
    base = saved(base.withColumn("_piece", F.pmod(F.xxhash64("_order"), F.lit(pieces)).cast("int")), "shards")
    sizes = _exact_sizes(rows, shards)
    counts = saved(base.groupBy("_link", "_piece").agg(F.count(F.lit(1)).alias("_c")), "shards")
    groups = saved(counts.groupBy("_link").agg(F.sum("_c").alias("_n")), "shards")
    linked, alone = groups.filter("_n > 1"), groups.filter("_n = 1")
    # Dealt round: consecutive rows of a value start in consecutive shards.
    dealt = running_total(linked.withColumn("_rank", _cell(cells_for(rows), "_link")).withColumn("_one", F.lit(0)), ["_one"], "_rank", [F.col("_link")], "_n", "_at")
    step = F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(shards)) - 1))
    cells = dealt.select("_link", "_n", "_at", step.alias("_k")).select(
        "_link",
        ((F.col("_at") + F.col("_k")) % shards).cast("int").alias("_shard"),
        F.floor((F.col("_n") - F.col("_k") - 1) / shards + 1).cast("long").alias("_n"),
    )
    cells = propagate(saved(cells, "shards"), sizes, rounds)
    spans = _settle(cells, alone, sizes)
    # Where each piece of a value starts, then the intervals that meet the piece.
    inside = Window.partitionBy("_link").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    piece_starts = counts.withColumn("_start", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    spans = spans.withColumnRenamed("_n", "_len")
    meet = (F.col("_from") < F.col("_start") + F.col("_c")) & (F.col("_start") < F.col("_from") + F.col("_len"))
    cuts = (
        piece_starts.join(spans, "_link").filter(meet)
        .groupBy("_link", "_piece")
        .agg(F.first("_start").alias("_start"), F.collect_list(F.struct("_from", "_len", "_shard", "_slot")).alias("_spans"))
    )
    rank = F.row_number().over(Window.partitionBy("_link", "_piece").orderBy("_order")) - 1
    placed = base.withColumn("_r", rank).join(cuts, ["_link", "_piece"]).withColumn("_r", F.col("_r") + F.col("_start"))
    own = F.filter("_spans", lambda s: (s["_from"] <= F.col("_r")) & (F.col("_r") < s["_from"] + s["_len"]))
    return placed.withColumn("_s", F.get(own, 0)).select(
        "_given.*", F.col("_s._shard").cast("int").alias("shard"), (F.col("_s._slot") + F.col("_r") - F.col("_s._from")).alias("slot")
    )
