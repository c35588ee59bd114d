"""Tagging of free text by a regex ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delay reasons and their patterns.
DELAY_TAGS = {
    "LAND_ROW": r"(?i)\b(land\s+acquisition|row|right\s+of\s+way|compensation|"
    r"slao|district\s+collector|encroachment|possession|land\s+handover)\b",
    "ENV_FOREST": r"(?i)\b(forest|wildlife|moef|moefcc|stage[- ]?[iI]{1,2}|"
    r"tree\s+cutting|nbwl|clearance|afforestation|ca\s+land)\b",
    "LEGAL_CONTRACTOR": r"(?i)\b(arbitrat\w*|court|litigat\w*|stay\s+order|dispute|"
    r"contractor\s+default|termination|liquidity|nclt|insolvency)\b",
    "UTILITY_INTERAGENCY": r"(?i)\b(utility\s+shifting|transmission\s+line|powergrid|"
    r"railway\s+crossing|crs|pipeline\s+shifting|water\s+pipeline)\b",
    "LOCAL_GEOLOGY": r"(?i)\b(law\s+and\s+order|local\s+agitation|protest|strike|"
    r"monsoon|flash\s+flood|geological\s+strata|rockfall|landslide)\b",
}


def text_tags(text: Column, ontology: dict[str, str] = DELAY_TAGS) -> dict[str, Column]:
    """One 0/1 column per tag over the whole text; null or empty text has no tag."""
    return {
        tag: F.coalesce(text.rlike(pattern), F.lit(False)).cast("int")
        for tag, pattern in ontology.items()
    }


def tag_share(rows: DataFrame, text: str, delayed: Column, ontology: dict[str, str] = DELAY_TAGS) -> DataFrame:
    """(tag, rows, share): how many of the delayed rows carry each tag; one pass."""
    late = rows.filter(delayed)
    counts = late.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(t) for t, c in text_tags(F.col(text), ontology).items()])
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), F.coalesce(F.col(t), F.lit(0)).alias("rows")) for t in ontology])
    return counts.select("_n", F.explode(pairs).alias("x")).select(
        "x.tag", "x.rows", F.coalesce(F.try_divide("x.rows", "_n"), F.lit(0.0)).alias("share")
    )
