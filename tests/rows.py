"""Hand-made tables for the edges of the rules."""

from punctual.schemas import BRONZE


def schema(name):
    return ", ".join(f"`{c}` {t}" for c, t in BRONZE[name].items())


def order(po_id="P1", **changes):
    row = {
        "po_id": po_id, "supplier_id": "S1", "site_id": "SITE01", "part_id": "A",
        "order_date": "2024-01-01", "promised_date": "2024-01-10", "receipt_date": "2024-01-10",
        "ordered_qty": 10.0, "received_qty": 10.0,
    }
    row.update(changes)
    return tuple(row[c] for c in BRONZE["purchase_orders"])


def part(part_id="A", **changes):
    row = {
        "part_id": part_id, "part_family": "Engine", "criticality_class": "A", "unit_cost": 2.5,
        "lead_time_days": 7, "supplier_id_primary": "S1", "supplier_risk_class": "High",
        "is_repairable": "Yes", "shelf_life_days": 30.0,
    }
    row.update(changes)
    return tuple(row[c] for c in BRONZE["parts_master"])


def incident(incident_id="Q1", **changes):
    row = {
        "incident_id": incident_id, "incident_date": "2024-01-05", "part_id": "A", "supplier_id": "S1",
        "site_id": "SITE01", "defect_severity": "Critical", "defect_type": "Material", "scrap_qty": 3,
    }
    row.update(changes)
    return tuple(row[c] for c in BRONZE["quality_incidents"])


def frame(spark, name, *rows):
    return spark.createDataFrame(list(rows), schema(name))


def marts(spark, orders, parts=(part(),), incidents=(incident(),)):
    """Order mart and supplier marts of hand-made rows."""
    from punctual.operators import kpis, silver

    mart = kpis.otif_enriched(
        silver.stg_purchase_orders(frame(spark, "purchase_orders", *orders)),
        silver.stg_parts_master(frame(spark, "parts_master", *parts)),
    )
    return mart, kpis.supplier_kpi(
        mart, silver.stg_quality_incidents(frame(spark, "quality_incidents", *incidents))
    )
