"""Table layouts and fixed values shared by every layer."""

from __future__ import annotations

# --- Bronze ---------------------------------------------------------------
# Raw columns with the type each one is given on ingestion. Dates stay text:
# Silver parses them leniently and needs to know that a raw value was present.
BRONZE = {
    "parts_master": {
        "part_id": "string",
        "part_family": "string",
        "criticality_class": "string",
        "unit_cost": "double",
        "lead_time_days": "int",
        "supplier_id_primary": "string",
        "supplier_risk_class": "string",
        "is_repairable": "string",
        "shelf_life_days": "double",
    },
    "purchase_orders": {
        "po_id": "string",
        "supplier_id": "string",
        "site_id": "string",
        "part_id": "string",
        "order_date": "string",
        "promised_date": "string",
        "receipt_date": "string",
        "ordered_qty": "double",
        "received_qty": "double",
    },
    "quality_incidents": {
        "incident_id": "string",
        "incident_date": "string",
        "part_id": "string",
        "supplier_id": "string",
        "site_id": "string",
        "defect_severity": "string",
        "defect_type": "string",
        "scrap_qty": "bigint",
    },
    "supply_chain_history": {
        "date": "string",
        "site_id": "string",
        "part_id": "string",
        "planned_maintenance": "boolean",
        "consumption_qty": "bigint",
        "on_hand_qty": "bigint",
        "backorder_qty": "bigint",
        "blocked_qty": "bigint",
        "forecast_qty": "bigint",
        "forecast_type": "string",
        "forecast_uplift_pct": "double",
    },
}

# --- Gold -----------------------------------------------------------------
OTIF_COLUMNS = [
    "po_id", "supplier_id", "site_id", "part_id",
    "order_date", "promised_date", "receipt_date",
    "standard_lead_time_days", "actual_lead_time_days", "lead_time_variance_days",
    "delay_days", "ordered_qty", "received_qty", "fill_rate",
    "unit_cost", "total_order_cost",
    "part_family", "criticality_class", "supplier_risk_class",
    "is_repairable", "shelf_life_days",
    "is_delivered", "is_on_time", "is_in_full", "is_otif", "otif_score",
]

# --- Model ----------------------------------------------------------------
# Only what is known when the order is placed; fixed order.
FEATURES = [
    "ordered_qty",
    "unit_cost",
    "total_order_cost",
    "standard_lead_time_days",
    "is_repairable",
    "shelf_life_days",
    "part_family_enc",
    "criticality_class_enc",
    "supplier_risk_class_enc",
]
CATEGORIES = {
    "part_family": "part_family_enc",
    "criticality_class": "criticality_class_enc",
    "supplier_risk_class": "supplier_risk_class_enc",
}
TARGET = "otif_score"
# Known only after delivery, so never a model input.
AFTER_DELIVERY = {
    "delay_days", "fill_rate", "actual_lead_time_days", "lead_time_variance_days",
    "received_qty", "receipt_date", "is_delivered", "is_on_time", "is_in_full", "is_otif",
}

# Boosted-tree settings (300 trees, rate 0.05, 31 leaves, so
# depth 5; at least 20 rows per leaf; 80 % of rows and columns per tree).
TREES = {
    "maxIter": 300,
    "stepSize": 0.05,
    "maxDepth": 5,
    "minInstancesPerNode": 20,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}
TEST_SHARE = 0.2
SEED = 42

# Risk levels and their upper bounds (exclusive).
RISK_LOW, RISK_MEDIUM, RISK_HIGH = "FAIBLE", "MOYEN", "ÉLEVÉ"
RISK_LOW_BELOW, RISK_MEDIUM_BELOW = 0.3, 0.6

# Bounds accepted for what-if scenarios.
LEAD_TIME_BOUNDS = (1, 365)
MIN_QUANTITY = 1

# --- Logs and reports -----------------------------------------------------
LOG_SCHEMA = (
    "ts double, prompt string, response string, latency_ms double, "
    "tokens_used int, docs_retrieved int"
)
DRIFT_REPORT_SCHEMA = (
    "drift_detected boolean, drift_share double, status string, summary string, "
    "measured_at string, details struct<reference_rows: bigint, current_rows: bigint, "
    "drifted_features: array<string>>"
)
