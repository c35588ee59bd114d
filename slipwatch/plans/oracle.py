"""SQL counterparts of the registered queries (DuckDB dialect), built from shared CTEs."""

from __future__ import annotations

from slipwatch import schema as S
from slipwatch.plans.inputs import FORM_SECTORS, PORTAL_SECTORS, REMARKS

NUMBER = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def cols(*specs: str) -> str:
    """'d:name=expr' (double), 'm:' (money), 'l:' (integer), 's:' (text); the expression defaults to the name."""
    out = []
    for spec in specs:
        kind, rest = spec.split(":", 1)
        name, _, expr = rest.partition("=")
        expr = expr or name
        if kind == "d":
            out.append(f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}")
        elif kind == "m":
            out.append(f"round(({expr})::DOUBLE, 2) + 0.0 AS {name}")
        elif kind == "l":
            out.append(f"({expr})::BIGINT AS {name}")
        else:
            out.append(f"({expr})::VARCHAR AS {name}")
    return ", ".join(out)


def many(kind: str, names: str) -> list[str]:
    return [f"{kind}:{n}" for n in names.split()]


def text_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def num(c: str, default: str = "0.0", commas: bool = True) -> str:
    t = f"trim(replace({c}, ',', ''))" if commas else f"trim({c})"
    return f"coalesce(CASE WHEN regexp_full_match({t}, '{NUMBER}') THEN try_cast({t} AS DOUBLE) END, {default})"


def day(c: str) -> str:
    forms = [
        (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"), (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"),
        (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), (r"\d{1,2}/\d{1,2}/\d{2}", "%d/%m/%y"),
    ]
    parts = [f"CASE WHEN regexp_full_match({c}, '{r}') THEN try_strptime({c}, '{f}')::DATE END" for r, f in forms]
    return f"coalesce({', '.join(parts)})"


def sector_rules(c: str, case_sensitive: bool = False) -> str:
    seen = c if case_sensitive else f"lower({c})"
    arms = []
    for words, target in S.SECTOR_RULES:
        hits = " OR ".join(f"contains({seen}, '{w.capitalize() if case_sensitive else w}')" for w in words)
        arms.append(f"WHEN {hits} THEN '{target}'")
    return f"CASE {' '.join(arms)} ELSE {c} END"


SNAP = """
monthly AS (
  SELECT l_suppkey AS project_id, date_trunc('month', l_shipdate)::DATE AS mon,
         sum(l_extendedprice::DECIMAL(18,2)) AS spend, sum(l_quantity::DECIMAL(18,2)) AS qty,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::DECIMAL(18,2) ELSE 0 END) AS back
  FROM lineitem GROUP BY 1, 2),
run AS (
  SELECT project_id, mon, (sum(spend) OVER w)::DOUBLE AS expenditure,
         (sum(spend) OVER p)::DOUBLE AS revised_cost,
         floor((sum(qty) OVER w)::DOUBLE * 100.0::DOUBLE / (sum(qty) OVER p)::DOUBLE / 5.0::DOUBLE) * 5.0::DOUBLE AS physical_progress,
         (sum(CASE WHEN back * 2 > qty THEN 1 ELSE 0 END) OVER w)::INTEGER AS moves,
         min(mon) OVER p AS sanction_date
  FROM monthly WINDOW w AS (PARTITION BY project_id ORDER BY mon), p AS (PARTITION BY project_id)),
snap AS (
  SELECT project_id, s_name AS project_name, n_name AS sector, r_name AS region,
         strftime(mon, '%Y-%m') AS report_month, (year(mon) * 12 + month(mon) - 1)::INTEGER AS axis,
         mon + 14 AS as_of, expenditure, physical_progress,
         floor(revised_cost * ((project_id % 10) / 10.0::DOUBLE + 0.5::DOUBLE)) AS original_cost, revised_cost,
         sanction_date, sanction_date + 1500 AS original_end_date,
         sanction_date + 1500 + moves * 30 AS revised_date, true AS dated
  FROM run JOIN supplier ON s_suppkey = project_id JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def history(src: str, name: str) -> str:
    """Neighbour columns; `src` has axis and as_of."""
    return f"""
{name}_a AS (
  SELECT *, (row_number() OVER w) - 1 AS seq_index, count(*) OVER p AS n_snapshots,
         lag(expenditure) OVER w AS expenditure_prev, lag(physical_progress) OVER w AS progress_prev,
         lag(physical_progress, 3) OVER w AS progress_prev3, first_value(physical_progress) OVER w AS progress_first,
         lead(revised_date) OVER w AS revised_next, lead(axis) OVER w - axis AS gap_months,
         max(axis) OVER p AS last_axis,
         max(revised_date) OVER (PARTITION BY project_id ORDER BY axis RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS revised_max_3,
         max(revised_date) OVER (PARTITION BY project_id ORDER BY axis RANGE BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS revised_max_6
  FROM {src} WINDOW w AS (PARTITION BY project_id ORDER BY axis), p AS (PARTITION BY project_id)),
{name}_b AS (
  SELECT *, seq_index - max(CASE WHEN seq_index = 0 OR physical_progress - progress_prev > 0.1 THEN seq_index END)
           OVER (PARTITION BY project_id ORDER BY axis) AS streak,
         coalesce(avg(CASE WHEN progress_prev IS NOT NULL THEN (physical_progress >= progress_prev)::INTEGER::DOUBLE END)
           OVER (PARTITION BY project_id), 1.0) AS order_confidence,
         CASE WHEN original_end_date - sanction_date > 0
              THEN greatest(1.0::DOUBLE, (original_end_date - sanction_date) / 30.44::DOUBLE) ELSE 36.0 END AS duration,
         100.0::DOUBLE * expenditure / greatest(1.0::DOUBLE, original_cost) AS pct,
         coalesce((revised_date - as_of) / 30.44::DOUBLE, 0.0) AS mtr,
         physical_progress - coalesce(progress_prev3, progress_first) AS d3,
         greatest(0.0::DOUBLE, 100.0::DOUBLE - physical_progress) AS remaining
  FROM {name}_a),
{name}_c AS (
  SELECT *, CASE WHEN sanction_date IS NOT NULL THEN greatest(0.0::DOUBLE, (as_of - sanction_date) / 30.44::DOUBLE)
                 WHEN original_end_date IS NOT NULL THEN greatest(0.0::DOUBLE, (as_of - original_end_date) / 30.44::DOUBLE + duration)
                 ELSE duration * 0.5 END AS elapsed,
         d3 / least(3.0::DOUBLE, greatest(1.0::DOUBLE, seq_index)) AS velocity,
         CASE WHEN mtr > 0 THEN remaining / greatest(1.0::DOUBLE, mtr) ELSE remaining END AS required
  FROM {name}_b),
{name} AS (
  SELECT *, ln(1 + greatest(0.0::DOUBLE, original_cost)) AS log_original_cost, pct AS expenditure_pct,
         coalesce(greatest(0.0::DOUBLE, expenditure - expenditure_prev), 0.0) AS expenditure_delta,
         100.0::DOUBLE * coalesce(greatest(0.0::DOUBLE, expenditure - expenditure_prev), 0.0) / greatest(1.0::DOUBLE, original_cost) AS expenditure_delta_pct,
         coalesce(physical_progress - progress_prev, 0.0) AS progress_delta, d3 AS progress_delta_3m,
         remaining AS remaining_progress_pct, pct - physical_progress AS spend_progress_gap,
         CASE WHEN physical_progress > 0.5 THEN pct / physical_progress ELSE 0.0 END AS burn_to_progress_ratio,
         elapsed AS months_elapsed, duration AS original_duration_months, elapsed / duration AS elapsed_ratio,
         elapsed / duration - physical_progress / 100.0::DOUBLE AS schedule_pressure, mtr AS months_to_revised_date,
         coalesce(greatest(0.0::DOUBLE, (revised_date - original_end_date) / 30.44::DOUBLE), 0.0) AS revised_date_already_slipped_months,
         streak::DOUBLE AS stall_streak, velocity AS progress_velocity, required AS required_velocity,
         required - velocity AS velocity_deficit
  FROM {name}_c)"""


def labels(src: str, name: str) -> str:
    def horizon(k: int) -> str:
        slip = f"coalesce(revised_max_{k} - revised_date > 15, false)"
        cens = f"(NOT {slip} AND last_axis < axis + {k})"
        return f"CASE WHEN NOT {cens} THEN {slip}::INTEGER END AS slip_within_{k}m, {cens}::INTEGER AS censored_{k}m"

    return f"""
{name} AS (
  SELECT *, (revised_next - revised_date > 15)::INTEGER AS slip_next, {horizon(3)}, {horizon(6)}
  FROM {src} WHERE revised_date IS NOT NULL AND revised_next IS NOT NULL)"""


HIST = SNAP + "," + history("snap", "hist")
TRANS = HIST + "," + labels("hist", "trans")
P_DEADLINE = "1.0::DOUBLE / (1.0::DOUBLE + exp(least(30.0::DOUBLE, greatest(-30.0::DOUBLE, months_to_revised_date / 6.0::DOUBLE))))"
PANEL = TRANS + f""",
panel AS (
  SELECT *, report_month AS as_of_month, {P_DEADLINE} AS p_deadline,
         (months_to_revised_date <= 0 AND physical_progress < 95)::INTEGER::DOUBLE AS p_binary,
         ((CASE WHEN spend_progress_gap >= 25 AND physical_progress < 50 THEN 30.0 ELSE 0.0 END)
          + (CASE WHEN progress_delta <= 0.1 AND elapsed_ratio >= 0.20 AND physical_progress < 95 THEN 25.0 ELSE 0.0 END))::DOUBLE / 55.0::DOUBLE AS p_rules
  FROM trans)"""

FORM = HIST + f""",
form AS (
  SELECT 'SUP-' || project_id AS project_id, report_month, project_name,
         ({text_list(FORM_SECTORS)})[project_id % 8 + 1] AS sector, region AS implementing_agency, sector AS state,
         original_cost, CASE WHEN project_id % 4 <> 1 THEN revised_cost END AS revised_cost, expenditure,
         expenditure_delta AS expenditure_change_recent, physical_progress, progress_delta AS progress_change_recent,
         original_duration_months, months_elapsed, revised_date_already_slipped_months AS current_delay_months,
         project_id % 9 AS overdue_milestones, 10 AS total_scheduled_milestones,
         (project_id * 37) % 400 AS clearance_pending_days, (project_id * 13) % 90 AS days_since_last_update,
         CASE project_id % 7 WHEN 0 THEN 'ARBITRATION' WHEN 1 THEN 'CONCILIATION' ELSE 'NONE' END AS dispute_status,
         ({text_list(REMARKS)})[project_id % 5 + 1] AS delay_remarks,
         (seq_index + 1 = n_snapshots)::INTEGER AS is_latest, {P_DEADLINE} AS p_model
  FROM hist)"""

RULES = FORM + """,
parts AS (
  SELECT *, (expenditure / greatest(1.0::DOUBLE, original_cost) - physical_progress / 100.0::DOUBLE) * 100.0::DOUBLE AS gap,
         months_elapsed / greatest(1.0::DOUBLE, original_duration_months) AS ratio,
         overdue_milestones / greatest(1, total_scheduled_milestones)::DOUBLE AS density,
         original_duration_months + current_delay_months - months_elapsed AS months_left,
         CASE WHEN revised_cost IS NOT NULL AND original_cost > 0
              THEN greatest(0.0::DOUBLE, round((revised_cost - original_cost) / original_cost * 100.0::DOUBLE, 4)) ELSE 0.0 END AS overrun
  FROM form),
fires AS (
  SELECT *, (gap >= 25 AND physical_progress < 50)::INTEGER AS f1,
         (progress_change_recent <= 0.1 AND ratio >= 0.20 AND physical_progress < 95)::INTEGER AS f2,
         (density >= 0.5 OR clearance_pending_days > 180)::INTEGER AS f3,
         (days_since_last_update > 60)::INTEGER AS f4,
         (dispute_status IN ('ARBITRATION', 'HIGH_COURT_STAY', 'TERMINATION_NOTICE'))::INTEGER AS f5,
         (months_left <= 0 AND physical_progress < 95)::INTEGER AS f6
  FROM parts),
floors AS (
  SELECT *, least(100, 30 * f1 + 25 * f2 + 25 * f3 + 20 * f4 + 30 * f5 + 25 * f6)::DOUBLE AS rule_floor,
         (f1 + f2 + f3 + f4 + f5 + f6) AS active,
         ((f1 = 1 AND gap >= 40) OR (f3 = 1 AND clearance_pending_days > 365) OR f5 = 1 OR (f6 = 1 AND -months_left >= 12))::INTEGER AS critical,
         least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_model)) * 100.0::DOUBLE AS scaled
  FROM fires),
alias AS (SELECT unnest(map_entries(%(aliases)s)) AS e),
medians AS (SELECT unnest(map_entries(%(medians)s)) AS e),
aliases AS (SELECT e.key AS k, e.value AS v FROM alias),
medtab AS (SELECT lower(e.key) AS k, e.value::DOUBLE AS v FROM medians),
scored AS (
  SELECT f.*, greatest(scaled, rule_floor) AS gov_score,
         CASE WHEN round(scaled, 9) > round(rule_floor, 9) THEN 'MACHINE_LEARNING' ELSE 'RULE_FLOOR_OVERRIDE' END AS dominant_source,
         coalesce(m1.v, m2.v, 15.0) AS median, (coalesce(m1.v, m2.v) IS NOT NULL)::INTEGER AS matched
  FROM floors f LEFT JOIN aliases a ON a.k = lower(trim(f.sector))
  LEFT JOIN medtab m1 ON m1.k = lower(coalesce(a.v, trim(f.sector)))
  LEFT JOIN medtab m2 ON m2.k = lower(trim(f.sector))),
priced AS (
  SELECT *, CASE WHEN gov_score >= 75 THEN 'CRITICAL' WHEN gov_score >= 50 THEN 'HIGH' WHEN gov_score >= 25 THEN 'MODERATE' ELSE 'LOW' END AS risk_tier,
         greatest(0.0::DOUBLE, overrun) AS reported, (original_cost <= 0 OR p_model <= 0) AS none
  FROM scored),
assessed AS (
  SELECT *, CASE WHEN none THEN 0.0 ELSE least(original_cost * 3.0::DOUBLE, original_cost * p_model * (greatest(reported, median) / 100.0::DOUBLE)) END AS capital_at_risk,
         CASE WHEN none THEN 0.0 ELSE greatest(reported, median) END AS effective_overrun,
         (NOT none AND reported < median)::INTEGER AS fallback,
         (NOT none AND original_cost * p_model * (greatest(reported, median) / 100.0::DOUBLE) > original_cost * 3.0::DOUBLE)::INTEGER AS clamped
  FROM priced)""" % {
    "aliases": "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.EXPOSURE_ALIASES.items()) + "}",
    "medians": "MAP {" + ", ".join(f"'{k}': {v}" for k, v in S.SECTOR_MEDIAN_OVERRUN.items()) + "}",
}

_REVISED = "CASE axis % 4 " + " ".join(
    f"WHEN {i} THEN strftime(revised_date, '{f}')" for i, f in enumerate(["%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%y"])
) + " END"
RAW = SNAP + f""",
dirt AS (
  SELECT *, (CASE WHEN axis % 41 = 0 AND expenditure * 100.0::DOUBLE > original_cost * 20.0::DOUBLE THEN expenditure * 100.0::DOUBLE ELSE expenditure END)::DECIMAL(18,2)::VARCHAR AS amount,
         CASE WHEN axis % 11 = 0 THEN sanction_date - 365 ELSE sanction_date END AS sanction
  FROM snap),
raw AS (
  SELECT project_id, CASE WHEN axis % 7 = 0 THEN '' ELSE 'Works ' || project_name END AS project_name,
         ({text_list(PORTAL_SECTORS)})[project_id % 14 + 1] AS sector_name, NULL::VARCHAR AS state_name,
         CASE WHEN axis % 17 = 0 THEN '0' ELSE original_cost::BIGINT::VARCHAR END AS original_cost,
         CASE WHEN project_id % 4 = 1 THEN '' ELSE revised_cost::DECIMAL(18,2)::VARCHAR END AS revised_cost,
         CASE WHEN project_id % 5 = 0 THEN regexp_replace(amount, '^(.)', '\\1,') ELSE amount END AS expenditure,
         CASE WHEN (project_id + axis * 3) % 97 = 0 THEN 'n/a' ELSE physical_progress::INTEGER::VARCHAR END AS physical_progress,
         CASE WHEN axis % 13 = 0 THEN NULL WHEN project_id % 2 = 0 THEN strftime(sanction, '%d/%m/%Y') ELSE strftime(sanction, '%Y-%m-%d') END AS sanction_date,
         strftime(original_end_date, '%d-%m-%Y') AS original_end_date,
         CASE WHEN (project_id + axis) % 23 = 0 THEN NULL ELSE {_REVISED} END AS revised_date,
         ({text_list(REMARKS)})[project_id % 5 + 1] AS remarks,
         CASE WHEN project_id % 10 = 3 THEN NULL ELSE report_month END AS report_month,
         (project_id % 6)::VARCHAR AS harvest_sector_id,
         project_id * 100000 + axis * 2 + copy AS harvest_seq
  FROM dirt, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR axis % 6 = 0)"""

_ID = "project_id, coalesce(report_month, ''), expenditure, physical_progress, revised_date, revised_cost, sanction_date, original_end_date, original_cost"
UNIQ = RAW + f""",
uniq AS (
  SELECT project_id, coalesce(report_month, '') AS report_month, expenditure, physical_progress, revised_date,
         revised_cost, sanction_date, original_end_date, original_cost,
         min(harvest_seq) AS harvest_seq, count(*) AS copies
  FROM raw GROUP BY {_ID})"""


def modal_cte(src: str, fields: list[str], name: str) -> str:
    stacked = " UNION ALL ".join(f"SELECT project_id, harvest_seq, '{f}' AS field, {f} AS value FROM {src}" for f in fields)
    return f"""
{name} AS (
  SELECT project_id, field, value FROM (
    SELECT project_id, field, value, count(*) AS n, min(harvest_seq) AS seen FROM ({stacked})
    WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY project_id, field ORDER BY n DESC, seen) = 1)"""


MODAL = UNIQ + "," + modal_cte("uniq", ["sanction_date", "original_end_date", "original_cost"], "modal") + "," + modal_cte("raw", ["project_name"], "names")
CLEAN = MODAL + f""",
axes AS (SELECT project_id, bool_and(report_month <> '') AS dated FROM uniq GROUP BY 1),
firsts AS (SELECT project_id, arg_min(coalesce(sector_name, ''), harvest_seq) AS sector_name FROM raw GROUP BY 1),
attr AS (
  SELECT x.project_id, dated,
         {sector_rules("coalesce(nullif(trim(sector_name), ''), 'Other')")} AS sector,
         coalesce(n.value, 'Central Project ' || x.project_id) AS project_name,
         {day("s.value")} AS modal_sanction, {day("e.value")} AS modal_end, {num("c.value")} AS modal_cost
  FROM axes x JOIN firsts f USING (project_id)
  LEFT JOIN names n ON n.project_id = x.project_id
  LEFT JOIN modal s ON s.project_id = x.project_id AND s.field = 'sanction_date'
  LEFT JOIN modal e ON e.project_id = x.project_id AND e.field = 'original_end_date'
  LEFT JOIN modal c ON c.project_id = x.project_id AND c.field = 'original_cost'),
typed AS (
  SELECT u.project_id, a.project_name, a.sector, a.dated, u.harvest_seq, u.report_month, a.modal_cost, a.modal_sanction, a.modal_end,
         {num("u.expenditure")} AS spend, {num("u.physical_progress")} AS prog, {num("u.revised_cost", "a.modal_cost")} AS rev,
         {day("u.revised_date")} AS revised_date
  FROM uniq u JOIN attr a USING (project_id)),
clean AS (
  SELECT project_id, project_name, sector, dated, harvest_seq, report_month,
         CASE WHEN modal_cost > 0 AND spend > 20 * modal_cost THEN spend / 100.0::DOUBLE ELSE spend END AS expenditure,
         (modal_cost > 0 AND spend > 20 * modal_cost)::INTEGER AS units_rescaled,
         least(greatest(prog, 0.0::DOUBLE), 100.0::DOUBLE) AS physical_progress, revised_date, modal_cost AS original_cost,
         CASE WHEN rev > 0 THEN rev ELSE modal_cost END AS revised_cost, modal_sanction AS sanction_date, modal_end AS original_end_date
  FROM typed)"""

ORDERED = CLEAN + """,
dated AS (
  SELECT *, (substr(report_month, 1, 4)::INTEGER * 12 + substr(report_month, 6, 2)::INTEGER - 1)::INTEGER AS axis,
         (report_month || '-15')::DATE AS as_of
  FROM clean WHERE dated
  QUALIFY row_number() OVER (PARTITION BY project_id, report_month ORDER BY expenditure DESC, physical_progress DESC, harvest_seq DESC) = 1),
loose AS (
  SELECT *, ((row_number() OVER (PARTITION BY project_id ORDER BY expenditure, physical_progress, revised_date NULLS FIRST, harvest_seq)) - 1)::INTEGER AS axis,
         count(*) OVER (PARTITION BY project_id) AS n
  FROM clean WHERE NOT dated),
undated AS (SELECT * EXCLUDE (n), (DATE '2026-09-15' - to_months((n - 1 - axis)::INTEGER))::DATE AS as_of FROM loose),
ordered AS (SELECT * FROM dated UNION ALL SELECT * REPLACE (strftime(as_of, '%Y-%m') AS report_month) FROM undated)"""
RHIST = ORDERED + "," + history("ordered", "rhist")
RTRANS = RHIST + ", rkept AS (SELECT * FROM rhist WHERE original_cost > 0 AND n_snapshots >= 2)," + labels("rkept", "rtrans")


def below(src: str, value: str, weight: str = "1", keys: str = "", name: str = "st") -> str:
    """Distinct scores with counts of positives and negatives at and below."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""
{name}_g AS (SELECT {k}{value} + 0.0 AS score, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END)::BIGINT AS pos, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END)::BIGINT AS neg FROM {src} WHERE y IS NOT NULL GROUP BY ALL),
{name} AS (SELECT *, (sum(pos) OVER w - pos)::DOUBLE AS pos_below, (sum(neg) OVER w - neg)::DOUBLE AS neg_below,
  (sum(pos) OVER (PARTITION BY {keys or "1"}))::DOUBLE AS m, (sum(neg) OVER (PARTITION BY {keys or "1"}))::DOUBLE AS n
  FROM {name}_g WINDOW w AS ({part}ORDER BY score))"""
