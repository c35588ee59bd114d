"""Column lists and source schemas. Nothing here is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names on the wire -> our column names.
SNAPSHOT_FIELDS = {
    "ProjectId": "project_id",
    "ProjectName": "project_name",
    "SectorName": "sector_name",
    "StateName": "state_name",
    "OriginalCost": "original_cost",
    "RevisedCost": "revised_cost",
    "Expenditure": "expenditure",
    "PhysicalProgress": "physical_progress",
    "SanctionDate": "sanction_date",
    "OriginalEndDate": "original_end_date",
    "RevisedDate": "revised_date",
    "Remarks": "remarks",
    "RevisedDateReason": "revised_date_reason",
    "RevisedCostReason": "revised_cost_reason",
    "DELAYED_TIME": "delayed_time",
    "COST_OVERRUN_PERC": "cost_overrun_perc",
    "COR_PERC": "cor_perc",
    "TOR_PERC": "tor_perc",
    "StartDate": "start_date",
    "AgencyName": "agency_name",
    "COMPANYNAME": "company_name",
    "LineMinistry": "line_ministry",
    "freeze_month": "report_month",
    "harvest_sector_id": "harvest_sector_id",
}

# Every value arrives loosely typed, so all but the id are read as text and typed later.
SNAPSHOT_WIRE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "ProjectId" else T.StringType())
        for name in SNAPSHOT_FIELDS
    ]
    + [T.StructField("harvest_seq", T.LongType())]
)

# The parts that make two records of one project the same snapshot. The reporting
# month is one of them: two quiet months are two observations.
IDENTITY = [
    "report_month",
    "expenditure",
    "physical_progress",
    "revised_date",
    "revised_cost",
    "sanction_date",
    "original_end_date",
    "original_cost",
]

# Fields whose population is reported.
WATCHED_FIELDS = [
    "remarks",
    "revised_date_reason",
    "revised_cost_reason",
    "state_name",
    "delayed_time",
    "cost_overrun_perc",
    "cor_perc",
    "tor_perc",
    "start_date",
    "agency_name",
]

# Panel features with the decimals they are published at.
FEATURE_DECIMALS = {
    "original_cost": 2,
    "log_original_cost": 4,
    "expenditure": 2,
    "expenditure_pct": 3,
    "expenditure_delta": 2,
    "expenditure_delta_pct": 4,
    "physical_progress": 2,
    "progress_delta": 3,
    "progress_delta_3m": 3,
    "remaining_progress_pct": 2,
    "spend_progress_gap": 3,
    "burn_to_progress_ratio": 4,
    "months_elapsed": 2,
    "original_duration_months": 2,
    "elapsed_ratio": 4,
    "schedule_pressure": 4,
    "months_to_revised_date": 2,
    "revised_date_already_slipped_months": 2,
    "stall_streak": 0,
    "progress_velocity": 4,
    "required_velocity": 4,
    "velocity_deficit": 4,
}
FEATURES = list(FEATURE_DECIMALS)

# Columns that repeat the outcome and may never be features.
LEAKING_COLUMNS = [
    "has_revised_doc",
    "current_delay_months",
    "current_delay_months_robust",
    "revised_date_next",
    "slip_next",
]

HORIZONS = [3, 6]
SLIP_DAYS = 15
MIN_ORDER_CONFIDENCE = 0.60
DAYS_PER_MONTH = 30.44
HARVEST_MONTH = (2026, 9)

PANEL_IDS = [
    "project_id",
    "project_name",
    "sector",
    "seq_index",
    "n_snapshots",
    "as_of_month",
    "order_confidence",
    "order_reliable",
    "revised_date_t",
    "revised_date_next",
    "sanction_imputed",
    "window_truncated",
    "time_axis",
    "gap_months",
]

# The form row. Bounds: (low, low is open, high).
FORM_TEXT = [
    "project_id",
    "project_name",
    "sector",
    "implementing_agency",
    "state",
    "dispute_status",
    "delay_remarks",
]
FORM_INTS = [
    "overdue_milestones",
    "total_scheduled_milestones",
    "clearance_pending_days",
    "days_since_last_update",
]
FORM_DOUBLES = [
    "original_cost",
    "revised_cost",
    "expenditure",
    "expenditure_change_recent",
    "physical_progress",
    "progress_change_recent",
    "original_duration_months",
    "months_elapsed",
    "current_delay_months",
]
FORM_FIELDS = FORM_TEXT + FORM_DOUBLES + FORM_INTS
FORM_REQUIRED = ["project_id", "project_name", "original_cost", "expenditure", "physical_progress"]
FORM_DEFAULTS = {
    "sector": "Railways",
    "implementing_agency": "RVNL",
    "dispute_status": "NONE",
    "expenditure_change_recent": 0.0,
    "progress_change_recent": 0.0,
    "original_duration_months": 36.0,
    "months_elapsed": 12.0,
    "current_delay_months": 0.0,
    "overdue_milestones": 0,
    "total_scheduled_milestones": 10,
    "clearance_pending_days": 0,
    "days_since_last_update": 15,
}
FORM_BOUNDS = {
    "original_cost": (0.0, True, None),
    "revised_cost": (0.0, False, None),
    "expenditure": (0.0, False, None),
    "expenditure_change_recent": (0.0, False, None),
    "physical_progress": (0.0, False, 100.0),
    "progress_change_recent": (-10.0, False, 100.0),
    "original_duration_months": (0.0, True, None),
    "months_elapsed": (0.0, False, None),
    "current_delay_months": (0.0, False, None),
    "overdue_milestones": (0, False, None),
    "total_scheduled_milestones": (1, False, None),
    "clearance_pending_days": (0, False, None),
    "days_since_last_update": (0, False, None),
}
FORM_LENGTHS = {"project_id": (3, 64), "project_name": (1, 512)}
DISPUTE_STATES = ["NONE", "CONCILIATION", "ARBITRATION", "HIGH_COURT_STAY", "TERMINATION_NOTICE"]
DISPUTES_THAT_FIRE = ["ARBITRATION", "HIGH_COURT_STAY", "TERMINATION_NOTICE"]

# Form headers as written in exports -> form field.
FORM_HEADERS = {
    "projectid": "project_id",
    "projectcode": "project_id",
    "projectname": "project_name",
    "sector": "sector",
    "sectorname": "sector",
    "implementingagency": "implementing_agency",
    "agency": "implementing_agency",
    "state": "state",
    "originalcost": "original_cost",
    "sanctionedcost": "original_cost",
    "revisedcost": "revised_cost",
    "expenditure": "expenditure",
    "originalexp": "expenditure",
    "expenditurechangerecent": "expenditure_change_recent",
    "recentexpenditure": "expenditure_change_recent",
    "physicalprogress": "physical_progress",
    "progress": "physical_progress",
    "progresschange": "progress_change_recent",
    "progresschangerecent": "progress_change_recent",
    "originaldurationmonths": "original_duration_months",
    "monthselapsed": "months_elapsed",
    "currentdelaymonths": "current_delay_months",
    "delaymonths": "current_delay_months",
    "overduemilestones": "overdue_milestones",
    "totalscheduledmilestones": "total_scheduled_milestones",
    "scheduledmilestones": "total_scheduled_milestones",
    "clearancependingdays": "clearance_pending_days",
    "dayssincelastupdate": "days_since_last_update",
    "disputestatus": "dispute_status",
    "delayremarks": "delay_remarks",
    "reasonsfordelay": "delay_remarks",
    "remarks": "delay_remarks",
}

# Sector aliases (form), further aliases (exposure), median overrun in %.
SECTOR_ALIASES = {
    "road transport": "Road Transport & Highways",
    "roads": "Road Transport & Highways",
    "highways": "Road Transport & Highways",
    "railway": "Railways",
    "power": "Power",
}
EXPOSURE_ALIASES = {
    **SECTOR_ALIASES,
    "urban development & metro rail transit": "Urban Development",
    "urban": "Urban Development",
    "metro": "Urban Development",
    "water resources / irrigation & flood control": "Water Resources",
    "irrigation": "Water Resources",
    "shipping, ports & inland waterways": "Shipping & Ports",
    "ports": "Shipping & Ports",
    "shipping": "Shipping & Ports",
    "telecom": "Telecommunications",
    "health & family welfare": "Health & Family Welfare",
    "health": "Health & Family Welfare",
    "defence": "Defence Production",
    "education": "Higher Education",
    "renewables": "Renewable Energy",
}
SECTOR_MEDIAN_OVERRUN = {
    "Railways": 25.0,
    "Road Transport & Highways": 12.0,
    "Power": 18.0,
    "Urban Development": 15.0,
    "Water Resources": 20.0,
    "Petroleum & Natural Gas": 8.0,
    "Coal": 10.0,
    "Atomic Energy": 15.0,
    "Civil Aviation": 10.0,
    "Shipping & Ports": 10.0,
    "Telecommunications": 5.0,
    "Steel": 8.0,
    "Fertilizers": 8.0,
    "Mines": 8.0,
    "Information & Broadcasting": 10.0,
    "Health & Family Welfare": 20.0,
    "Petrochemicals": 8.0,
    "Heavy Industry": 10.0,
    "Defence Production": 12.0,
    "Higher Education": 12.0,
    "Renewable Energy": 6.0,
    "Other": 15.0,
}
NATIONAL_MEDIAN_OVERRUN = 15.0
EXPOSURE_CAP = 3.0

# Ordered substring rules of the portal's sector names.
SECTOR_RULES = [
    (["railway"], "Railways"),
    (["road", "highway"], "Roads & Highways"),
    (["electricity", "energy"], "Power"),
    (["oil", "gas", "petroleum"], "Petroleum"),
    (["coal"], "Coal"),
    (["steel", "metal"], "Steel"),
    (["aviation"], "Aviation"),
    (["urban", "transport"], "Urban Transport"),
    (["water"], "Water Resources"),
    (["telecommunication"], "Telecommunications"),
]

# Rule weights, tier bands, litigation and clearance words.
RULE_WEIGHTS = {"F1": 30.0, "F2": 25.0, "F3": 25.0, "F4": 20.0, "F5": 30.0, "F6": 25.0}
TIER_BANDS = [(75.0, "CRITICAL"), (50.0, "HIGH"), (25.0, "MODERATE")]
TIERS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]
SOURCES = ["MACHINE_LEARNING", "RULE_FLOOR_OVERRIDE"]
LITIGATION_WORDS = ["court", "arbitration", "stay", "litigation", "dispute", "tribunal", "injunction"]
CLEARANCE_WORDS = ["forest", "wildlife", "environmental clearance", "stage-2"]
