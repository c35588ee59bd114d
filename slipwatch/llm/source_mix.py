"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key, -ln(u) / weight: u follows from its id, the weight
from its quality, so that better documents tend to come first. A source's target is spent
on complete epochs first; the rest goes to its documents in key order, up to the word budget,
whose last document is cut where the budget ends. Native DataFrame operations only.

Defined results: null and empty texts have size 0, and are taken in no part; a null source is
a source of its own, last in order; a source without words has target 0; repeated rows each
count; a null id draws the same u as the text 'null'; reruns give the same result; columns of
any name stay as they are, for all work is done beside one struct of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch.llm.common import BLANKS, WORD, fresh, running_total, saved

# Weights of the sources in code point order, repeating; share of all words; most epochs.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
CELLS = 1024  # cells of the key range to a doubling
NOISE_SIGNS = "#$%&*|"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """1 for plain prose, less the more marks of tables, markup and junk there are per word."""
    marks = F.coalesce(F.length(text) - F.length(F.translate(text, NOISE_SIGNS, "")), F.lit(0)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * marks / F.greatest(words, F.lit(1)).cast("double"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the id's digest."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Adds `target` to (source, source_size), one row per source.

    The share of all words is dealt by weight; no target exceeds `most` times the source's
    size, and what is over goes to the others by weight. With the sources in order of limit
    per weight, the first k are at their limit for the smallest k that leaves the level of
    the others below theirs. The windows see one row per source, never documents.
    """
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limits = ranked.select(
        "source", "source_size",
        F.get(cycle, F.col("_i") % len(weights)).alias("_w"),
        (F.lit(most) * F.col("source_size").cast("double")).alias("_limit"), "_i",
    )
    by_level = Window.orderBy(F.col("_limit") / F.col("_w"), "_i")
    whole = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = limits.withColumn("_at", F.row_number().over(by_level))
    full = F.coalesce(F.sum("_limit").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(Window.orderBy("_at").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(whole).cast("double") - full) / rest
    found = ordered.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_limit") / F.col("_w"), F.col("_level"))
    settled = found.withColumn("_own", fits).withColumn(
        "_final", F.coalesce(F.first("_own", ignorenulls=True).over(whole), F.last("_level").over(whole))
    )
    return settled.select(
        "source", "source_size", F.least(F.col("_limit"), F.col("_final") * F.col("_w")).alias("target")
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, cells: int = CELLS,
    keep_text: bool = True,
) -> DataFrame:
    """Adds size, source_size, target and taken (words the mix takes, repeats counted) to `docs`.

    Without `keep_text` the text goes, and the narrow rows are written once, so that each
    text is read a single time.

    Needs doc_id, text and source; other columns stay (same names as the added ones are
    replaced). One source may hold any share of the rows: prefix sums go over cells of the
    key range. A cell spans 1/`cells` of a doubling, where an exponential key of any rate falls
    with a chance of at most ln(2) / (e * cells), so whatever the weights, no cell is expected to
    hold more than 1/4,000 of a source.
    """
    added = ("size", "source_size", "target", "taken")
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*added, "source") and (keep_text or c != "text")])
    size = word_count(F.col("text"))
    key = -F.log(uniform(F.col("doc_id"))) / quality_weight(F.col("text"), size)
    keyed = docs.select(
        given.alias("_given"), "source", size.alias("size"), key.alias("_key"), F.col("doc_id").alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_src"),
    ).withColumn("_cell", F.floor(F.log2("_key") * cells).cast("int"))
    if keep_text:
        sizes = docs.select("source", size.alias("size"))
    else:
        sizes = keyed = saved(keyed, "mix")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target")
    placed = running_total(keyed, ["_src"], "_cell", [F.col("_key"), F.col("_id"), F.col("size")], "size", "_before")
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)).cast("double")).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("_before")))
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("taken", (epochs * F.col("size") + part).cast("long"))
        .select("_given.*", "source", *added)
    )


def emit_mix(mixed: DataFrame, text: str = "text", columns: Sequence[str] = ()) -> DataFrame:
    """One row per copy that the mix takes; the document in which a budget ends comes cut to its words.

    `columns` are returned; `n_chars` among them follows the text.
    """
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    extra = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(
        F.when(whole > 0, F.array_repeat(F.lit(-1), whole)).otherwise(F.expr("cast(array() as array<int>)")),
        F.when(extra > 0, F.array(extra)).otherwise(F.expr("cast(array() as array<int>)")),
    )
    part = fresh("_part", mixed.columns)
    rows = mixed.withColumn(part, F.explode(copies))
    words = F.filter(F.split(F.col(text), f"[{BLANKS}]+"), lambda w: w != "")
    body = F.when(F.col(part) < 0, F.col(text)).otherwise(F.array_join(F.slice(words, 1, F.abs(F.col(part))), " "))
    out = rows.withColumn(text, body)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out.select(*columns)
