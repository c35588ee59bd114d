"""Form rows: headers, typing, validation, assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import coerce as C
from slipwatch.functions import exposure as X
from slipwatch.functions import rules as R
from slipwatch.functions.features import form_features, form_indicators


UNUSABLE = -1
OWN = "_form_"


class HeaderError(ValueError):
    """Neither a project id nor an original cost column was recognised."""


def match_headers(columns: list[str]) -> tuple[dict[str, str], list[str]]:
    """({column: form field}, ignored columns); the first column of a field wins."""
    found: dict[str, str] = {}
    for column in columns:
        plain = column.strip().lower().translate(str.maketrans("", "", " _-"))
        field = S.FORM_HEADERS.get(plain) or (plain if plain in S.FORM_FIELDS else None)
        if field and field not in found.values():
            found[column] = field
    if not {"project_id", "original_cost"} & set(found.values()):
        raise HeaderError("need at least a project id or an original cost column")
    return found, sorted(set(columns) - set(found))


def rename_headers(df: DataFrame) -> DataFrame:
    """Recognised columns under their form names; others are dropped."""
    found, _ = match_headers(df.columns)
    return df.select(*[F.col(f"`{c}`").alias(f) for c, f in found.items()])


def type_form(df: DataFrame) -> DataFrame:
    """All form columns, typed; unreadable numbers and blanks take the field's default."""
    present = set(df.columns)
    out = []
    for field in S.FORM_FIELDS:
        default = S.FORM_DEFAULTS.get(field)
        if field in S.FORM_TEXT:
            value = F.nullif(F.trim(F.col(field).cast("string")), F.lit("")) if field in present else F.lit(None).cast("string")
            if field == "dispute_status":
                value = F.replace(F.upper(value), F.lit(" "), F.lit("_"))
            if field == "sector":
                value = C.alias_sector(value)
        else:
            value = C.to_number(F.col(field), None) if field in present else F.lit(None).cast("double")
            if field in S.FORM_INTS:
                # A number beyond the type becomes one that no bound allows, so the row is quarantined.
                value = F.when(value.isNotNull(), F.coalesce(value.try_cast("int"), F.lit(UNUSABLE)))
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        out.append(value.alias(field))
    return df.select(*out)


def form_errors() -> Column:
    """Reasons why a typed form row is not usable; empty for a good row."""
    checks = [F.when(F.col(f).isNull(), f"{f}: missing") for f in S.FORM_REQUIRED]
    for field, (low, high) in S.FORM_LENGTHS.items():
        size = F.length(field)
        checks.append(F.when((size < low) | (size > high), f"{field}: length"))
    for field, (low, is_open, high) in S.FORM_BOUNDS.items():
        c = F.col(field)
        bad = (c <= low) if is_open else (c < low)
        if high is not None:
            bad = bad | (c > high)
        checks.append(F.when(bad, f"{field}: out of range"))
    for field in S.FORM_DOUBLES:
        checks.append(F.when(F.abs(field) == float("inf"), f"{field}: not finite"))
    checks.append(F.when(F.trim("sector") == "", "sector: empty"))
    checks.append(F.when(~F.col("dispute_status").isin(S.DISPUTE_STATES), "dispute_status: unknown"))
    checks.append(
        F.when(F.col("expenditure") > F.col("original_cost") * 50.0, "expenditure: above 50 times the cost")
    )
    return F.array_compact(F.array(*checks))


def validate(forms: DataFrame) -> DataFrame:
    """Adds `errors`. Rows are never dropped silently: split with `usable` and `quarantined`."""
    return forms.withColumn("errors", form_errors())


def usable(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)


def with_indicators(forms: DataFrame) -> DataFrame:
    return forms.select("*", *[c.alias(n) for n, c in form_indicators().items()])


def feature_rows(forms: DataFrame, wanted: list[str] = S.FEATURES, medians: dict[str, float] | None = None) -> DataFrame:
    """The wanted features of each form row, and which of them are only approximations.

    A feature the form cannot yield is filled with the training median and reported.
    """
    columns, approximated = _form_columns(wanted, medians)
    return forms.select("project_id", *columns, F.array(*[F.lit(f) for f in approximated]).alias("approximated"))


def _form_columns(wanted: list[str], medians: dict[str, float] | None) -> tuple[list[Column], list[str]]:
    from slipwatch.functions.features import APPROXIMATED

    known, medians = form_features(), medians or {}
    columns = [(known[f] if f in known else F.lit(float(medians.get(f, 0.0)))).alias(f) for f in wanted]
    return columns, [f for f in wanted if f in APPROXIMATED or f not in known]


def with_form_features(forms: DataFrame, wanted: list[str] = S.FEATURES, medians: dict[str, float] | None = None) -> DataFrame:
    """Form rows with the wanted features beside their own columns, ready for a scorer.

    A form column that shares a feature's name waits under another one.
    """
    columns, _ = _form_columns(wanted, medians)
    own = [F.col(c).alias(OWN + c if c in wanted else c) for c in forms.columns]
    return forms.select(*own, *columns)


def without_form_features(scored: DataFrame, wanted: list[str] = S.FEATURES) -> DataFrame:
    """Takes the features off again and gives the form columns their names back."""
    return scored.select(*[F.col(c).alias(c.removeprefix(OWN)) for c in scored.columns if c not in wanted])


def assess(forms: DataFrame, p: str = "p_model", base_rate: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """Full assessment of form rows that carry a model probability `p`.

    Nested columns are plain expressions: a query that does not select them never
    computes them.
    """
    prob = F.col(p)
    rows = forms.select(
        "*",
        R.rule_floor(weights).alias("rule_floor"),
        form_indicators()["cost_overrun_pct_current"].alias("_overrun"),
        X.sector_median(F.col("sector"))[0].alias("sector_median_overrun_pct"),
        X.sector_median(F.col("sector"))[1].alias("sector_matched"),
    )
    floor = F.col("rule_floor")
    rows = rows.select(
        "*",
        R.combined_score(prob, floor).alias("gov_score"),
        R.dominant_source(prob, floor).alias("dominant_source"),
        *[
            c.alias(n)
            for n, c in X.exposure(F.col("original_cost"), prob, F.col("_overrun"), F.col("sector_median_overrun_pct")).items()
        ],
    )
    tier = R.risk_tier(F.col("gov_score"))
    return rows.select(
        "*",
        tier.alias("risk_tier"),
        F.lit(min(1.0, max(0.0, base_rate))).alias("base_rate_probability"),
        R.active_rules().alias("active_signals_count"),
        R.critical_override().alias("critical_override"),
        R.rule_signals(weights).alias("rule_signals"),
        R.interventions(tier, F.col("is_sector_fallback_used")).alias("interventions"),
    ).drop("_overrun")


NESTED = ["rule_signals", "drivers", "interventions"]


def slim(assessed: DataFrame) -> DataFrame:
    """Without the nested columns a leaderboard never shows."""
    return assessed.drop(*NESTED)
