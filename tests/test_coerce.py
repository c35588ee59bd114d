from datetime import date

from pyspark.sql import functions as F

from slipwatch.functions import coerce as C


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_numbers_and_defaults(spark):
    values = ["1,200.5", " 7 ", "", None, "abc", "1d", "nan", "-3", ".5", "5.", "1e3"]
    assert column(spark, values, C.to_number) == [1200.5, 7.0, 0, 0, 0, 0, 0, -3.0, 0.5, 5.0, 1000.0]
    assert column(spark, ["", "4"], lambda c: C.to_number(c, 9.0)) == [9.0, 4.0]
    assert column(spark, ["x", "4"], lambda c: C.to_number(c, None)) == [None, 4.0]


def test_dates_in_four_formats(spark):
    values = ["31/12/2026", "1/2/2026", "05-03-2024", "2024-3-5", "05/03/69", "05/03/68", "31/02/2026", "", None, "soon"]
    assert column(spark, values, C.parse_date) == [
        date(2026, 12, 31), date(2026, 2, 1), date(2024, 3, 5), date(2024, 3, 5),
        date(1969, 3, 5), date(2068, 3, 5), None, None, None, None,
    ]


def test_sector_rules_are_ordered(spark):
    values = ["Inland Waterways", "Base metals", "ROAD works", "Gas pipelines", "", None, "Culture", "Urban road transport"]
    assert column(spark, values, C.canonical_sector) == [
        "Water Resources", "Steel", "Roads & Highways", "Petroleum", "Other", "Other", "Culture", "Roads & Highways",
    ]
    assert column(spark, ["ROAD works", "Road works"], lambda c: C.canonical_sector(c, True)) == ["ROAD works", "Roads & Highways"]


def test_month_ordinals_round_trip(spark):
    months = ["2025-07", "2024-12", "2025-01"]
    assert column(spark, months, lambda c: C.ordinal_month(C.month_ordinal(c))) == months
    assert column(spark, ["2025-01"], lambda c: C.mid_month(C.month_ordinal(c))) == [date(2025, 1, 15)]


def test_alias_and_units(spark):
    assert column(spark, [" Roads ", "railway", "Coal"], C.alias_sector) == ["Road Transport & Highways", "Railways", "Coal"]
    spend = lambda c: C.rescale_units(c.cast("double"), F.lit(100.0))
    assert column(spark, ["2000", "2001", "50"], spend) == [2000.0, 20.01, 50.0]
