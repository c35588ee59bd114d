import pytest
from pyspark.sql import functions as F

from slipwatch.functions.text import DELAY_TAGS, text_tags
from slipwatch.operators import drivers as D


def tagged(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return {t for t, v in df.select(*[c.alias(n) for n, c in text_tags(F.col("t")).items()]).first().asDict().items() if v}


@pytest.mark.parametrize("text, want", [
    ("Land  Acquisition pending with SLAO", {"LAND_ROW"}),
    ("Stage-II forest nod; arbitration begun", {"ENV_FOREST", "LEGAL_CONTRACTOR"}),
    ("the rows of a table, strikes", set()),
    ("Monsoon; utility shifting by CRS", {"LOCAL_GEOLOGY", "UTILITY_INTERAGENCY"}),
    ("x" * 5000 + " court", {"LEGAL_CONTRACTOR"}),
    ("", set()),
    (None, set()),
])
def test_tags(spark, text, want):
    assert tagged(spark, text) == want
    assert len(DELAY_TAGS) == 5


def test_drivers_are_ranked_by_size(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0)], "stall_streak double, spend_progress_gap double, velocity_deficit double")
    phi = D.linear_contributions({"stall_streak": 1.0, "spend_progress_gap": -2.0, "velocity_deficit": 3.0}, {"stall_streak": 0.0, "spend_progress_gap": 1.0, "velocity_deficit": 2.0})
    got = df.select(D.top_drivers(phi, 3).alias("d"), D.driver_shares(phi).alias("s")).first()
    assert [(d.feature_name, d.rank, d.contribution, d.direction) for d in got.d] == [
        ("spend_progress_gap", 1, -8.0, D.DOWN), ("stall_streak", 2, 1.0, D.UP), ("velocity_deficit", 3, 0.0, D.FLAT),
    ]
    assert {s.feature: s.share for s in got.s} == {"stall_streak": 1 / 9, "spend_progress_gap": -8 / 9, "velocity_deficit": 0.0}
    flat = df.select(D.driver_shares(D.linear_contributions({"stall_streak": 0.0}, {"stall_streak": 0.0})).alias("s")).first()
    assert flat.s[0].share == 0.0
