"""SQL with the same result as each registered query, over the plain sample tables."""

from __future__ import annotations

import re

# --- tables: each text may name earlier ones ----------------------------------

TABLES = {
    "raw_parts": """
        SELECT cast(p_partkey AS varchar) AS part_id, p_type AS part_family,
               CASE WHEN p_size <= 16 THEN 'A' WHEN p_size <= 33 THEN 'B' ELSE 'C' END AS criticality_class,
               p_retailprice AS unit_cost, p_size AS lead_time_days,
               cast(p_partkey % nsup AS varchar) AS supplier_id_primary,
               CASE WHEN s_acctbal < 3000 THEN 'High' WHEN s_acctbal < 7000 THEN 'Medium' ELSE 'Low' END
                   AS supplier_risk_class,
               CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Yes' ELSE 'No' END AS is_repairable,
               CASE WHEN p_size % 10 = 0 THEN p_size * 30.0e0 END AS shelf_life_days
        FROM part CROSS JOIN (SELECT count(*) AS nsup FROM supplier)
        LEFT JOIN supplier ON p_partkey % nsup = s_suppkey""",
    "raw_orders": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
                      cast(cast(l_shipdate AS date) AS varchar)) AS po_id,
               cast(l_suppkey AS varchar) AS supplier_id,
               concat('SITE0', 1 + c_nationkey % 6) AS site_id,
               cast(l_partkey + CASE WHEN l_partkey % 50 = 0 THEN 1000000000 ELSE 0 END AS varchar) AS part_id,
               cast(o_orderdate AS date) AS order_date,
               cast(o_orderdate AS date) + p_size AS promised_date,
               CASE WHEN l_linestatus = 'F' THEN cast(l_shipdate AS date) END AS receipt_date,
               l_quantity AS ordered_qty,
               CASE WHEN l_linestatus = 'O' THEN 0.0e0 WHEN l_returnflag = 'R' THEN l_quantity - 1
                    ELSE l_quantity END AS received_qty
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN part ON l_partkey = p_partkey""",
    "raw_incidents": """
        SELECT concat('QI', event_id) AS incident_id, cast(ts AS date) AS incident_date,
               cast(event_id % (SELECT count(*) FROM part) AS varchar) AS part_id,
               cast(user_id % (SELECT count(*) FROM supplier) AS varchar) AS supplier_id,
               concat('SITE0', 1 + user_id % 6) AS site_id,
               CASE WHEN value < 10 THEN 'Minor' WHEN value < 50 THEN 'Major' ELSE 'Critical' END AS defect_severity,
               'Material' AS defect_type, cast(1 + event_id % 13 AS bigint) AS scrap_qty
        FROM events WHERE event_type = 'error'""",
    "raw_history": """
        SELECT cast(ts AS date) AS date, concat('SITE0', 1 + user_id % 6) AS site_id,
               cast(event_id % 2000 AS varchar) AS part_id,
               CASE WHEN event_type = 'error' THEN true WHEN event_type <> 'view' THEN false END
                   AS planned_maintenance,
               cast(floor(value) AS bigint) AS consumption_qty,
               cast(event_id % 500 AS bigint) AS on_hand_qty, cast(event_id % 40 AS bigint) AS backorder_qty,
               cast(user_id % 20 AS bigint) AS blocked_qty, cast(event_id % 500 + 25 AS bigint) AS forecast_qty,
               CASE event_id % 3 WHEN 0 THEN 'Statistical' WHEN 1 THEN 'Manual' ELSE 'ML' END AS forecast_type,
               value / 1000 AS forecast_uplift_pct
        FROM events""",
    "stg_parts": """
        SELECT trim(part_id) AS part_id, trim(part_family) AS part_family,
               trim(criticality_class) AS criticality_class, cast(unit_cost AS double) AS unit_cost,
               cast(lead_time_days AS integer) AS lead_time_days,
               trim(supplier_id_primary) AS supplier_id_primary,
               trim(supplier_risk_class) AS supplier_risk_class,
               coalesce(lower(trim(is_repairable)) IN ('yes', 'true', '1'), false) AS is_repairable,
               cast(shelf_life_days AS double) AS shelf_life_days
        FROM raw_parts""",
    "stg_orders": """
        SELECT trim(po_id) AS po_id, trim(supplier_id) AS supplier_id, trim(site_id) AS site_id,
               trim(part_id) AS part_id, order_date, promised_date, receipt_date,
               cast(ordered_qty AS bigint) AS ordered_qty, cast(received_qty AS bigint) AS received_qty,
               receipt_date IS NOT NULL AS is_delivered,
               date_diff('day', promised_date, receipt_date) AS delay_days,
               CASE WHEN receipt_date IS NOT NULL THEN coalesce(receipt_date <= promised_date, false) END AS is_on_time,
               CASE WHEN receipt_date IS NOT NULL
                    THEN coalesce(cast(received_qty AS bigint) >= cast(ordered_qty AS bigint), false) END AS is_in_full,
               CASE WHEN receipt_date IS NOT NULL
                    THEN coalesce(receipt_date <= promised_date
                                  AND cast(received_qty AS bigint) >= cast(ordered_qty AS bigint), false) END AS is_otif,
               CASE WHEN ordered_qty > 0 THEN round(received_qty / ordered_qty, 4) ELSE 1.0e0 END AS fill_rate
        FROM raw_orders""",
    "stg_incidents": """
        SELECT trim(incident_id) AS incident_id, incident_date, trim(part_id) AS part_id,
               trim(supplier_id) AS supplier_id, trim(site_id) AS site_id,
               trim(defect_severity) AS defect_severity, trim(defect_type) AS defect_type, scrap_qty
        FROM raw_incidents""",
    "stg_history": """
        SELECT date AS snapshot_date, trim(site_id) AS site_id, trim(part_id) AS part_id,
               coalesce(planned_maintenance, false) AS planned_maintenance, consumption_qty, on_hand_qty,
               backorder_qty, blocked_qty, forecast_qty, trim(forecast_type) AS forecast_type, forecast_uplift_pct
        FROM raw_history""",
    "mart": """
        SELECT o.po_id, o.supplier_id, o.site_id, o.part_id, o.order_date, o.promised_date, o.receipt_date,
               p.lead_time_days AS standard_lead_time_days,
               date_diff('day', o.order_date, o.receipt_date) AS actual_lead_time_days,
               date_diff('day', o.order_date, o.receipt_date) - p.lead_time_days AS lead_time_variance_days,
               o.delay_days, o.ordered_qty, o.received_qty, o.fill_rate, p.unit_cost,
               round(o.ordered_qty * p.unit_cost, 2) AS total_order_cost,
               p.part_family, p.criticality_class, p.supplier_risk_class, p.is_repairable, p.shelf_life_days,
               o.is_delivered, o.is_on_time, o.is_in_full, o.is_otif,
               CASE WHEN o.is_otif THEN 1.0e0 WHEN NOT o.is_otif THEN 0.0e0 END AS otif_score
        FROM stg_orders o LEFT JOIN stg_parts p ON o.part_id = p.part_id""",
    "segments": """
        SELECT 'supplier' AS segment_type, supplier_id AS segment_value, * FROM mart WHERE is_otif IS NOT NULL
        UNION ALL
        SELECT 'part_family', part_family, * FROM mart WHERE is_otif IS NOT NULL
        UNION ALL
        SELECT 'criticality_class', criticality_class, * FROM mart WHERE is_otif IS NOT NULL""",
    "summary": """
        SELECT segment_type, segment_value, count(*) AS total_orders,
               count(*) FILTER (is_otif) AS otif_orders,
               round(100e0 * count(*) FILTER (is_otif) / count(*), 2) AS otif_rate_pct,
               round(avg(delay_days), 1) AS avg_delay_days, round(avg(fill_rate), 3) AS avg_fill_rate
        FROM segments GROUP BY ALL""",
    "incident_counts": """
        SELECT supplier_id, count(*) AS total_incidents, cast(sum(scrap_qty) AS bigint) AS total_scrap_qty,
               count(*) FILTER (defect_severity = 'Critical') AS critical_incidents
        FROM stg_incidents GROUP BY supplier_id""",
    "order_counts": """
        SELECT supplier_id, max(supplier_risk_class) AS supplier_risk_class, count(*) AS total_orders,
               count(*) FILTER (is_delivered) AS delivered_orders,
               count(*) FILTER (NOT is_delivered) AS pending_orders,
               count(*) FILTER (is_on_time) AS on_time_orders, count(*) FILTER (is_in_full) AS in_full_orders,
               count(*) FILTER (is_otif) AS otif_orders,
               round(avg(delay_days), 2) AS avg_delay_days, max(delay_days) AS max_delay_days,
               round(sum(total_order_cost), 2) AS total_ordered_spend
        FROM mart GROUP BY supplier_id""",
    "stats": """
        SELECT *, round(on_time_orders * 1e0 / nullif(delivered_orders, 0), 4) AS on_time_rate,
               round(in_full_orders * 1e0 / nullif(delivered_orders, 0), 4) AS in_full_rate,
               round(otif_orders * 1e0 / nullif(delivered_orders, 0), 4) AS otif_rate
        FROM order_counts""",
    "kpi": """
        SELECT s.*, coalesce(i.total_incidents, 0) AS total_incidents,
               coalesce(i.critical_incidents, 0) AS critical_incidents,
               coalesce(i.total_scrap_qty, 0) AS total_scrap_qty
        FROM stats s LEFT JOIN incident_counts i ON s.supplier_id = i.supplier_id""",
    "overall": """
        SELECT coalesce(round(avg(otif_score), 4), 0) AS global_otif,
               coalesce(round(count(*) FILTER (is_on_time) * 1e0 / nullif(count(*), 0), 4), 0) AS on_time_rate,
               coalesce(round(count(*) FILTER (is_in_full) * 1e0 / nullif(count(*), 0), 4), 0) AS in_full_rate,
               count(*) AS total_orders
        FROM mart WHERE otif_score IS NOT NULL""",
    "asked": """
        SELECT po_id FROM raw_orders WHERE received_qty = ordered_qty
        UNION ALL SELECT concat('PO-UNKNOWN-', event_id) FROM events WHERE event_type = 'error'""",
    "scenarios": """
        SELECT concat('S', po_id) AS scenario_id, po_id,
               CASE WHEN cast(part_id AS bigint) % 3 = 0 THEN cast(ordered_qty * 10 AS integer) END AS new_lead_time,
               CASE WHEN cast(part_id AS bigint) % 2 = 0 THEN concat(supplier_id, '-B') END AS new_supplier_id,
               CASE WHEN cast(part_id AS bigint) % 3 = 1 THEN cast(ordered_qty AS bigint) - 1 END AS new_quantity
        FROM raw_orders
        UNION ALL
        SELECT concat('SE', event_id), concat('PO-UNKNOWN-', event_id), 20, NULL, NULL
        FROM events WHERE event_type = 'error'""",
    "features": """
        SELECT po_id, supplier_id, coalesce(ordered_qty, 0) AS ordered_qty, coalesce(unit_cost, 0) AS unit_cost,
               coalesce(total_order_cost, 0) AS total_order_cost,
               coalesce(standard_lead_time_days, 0) AS standard_lead_time_days,
               coalesce(cast(is_repairable AS integer), 0) AS is_repairable,
               coalesce(shelf_life_days, 0) AS shelf_life_days,
               {part_family} AS part_family_enc, {criticality_class} AS criticality_class_enc,
               {supplier_risk_class} AS supplier_risk_class_enc, otif_score, receipt_date
        FROM mart""",
    "matrix": """
        SELECT po_id, ordered_qty, unit_cost, total_order_cost, standard_lead_time_days, is_repairable,
               shelf_life_days, part_family_enc, criticality_class_enc, supplier_risk_class_enc,
               cast(otif_score AS integer) AS label
        FROM features WHERE otif_score IS NOT NULL""",
    "scored": """
        SELECT *, {proba} AS otif_proba FROM features""",
    "scored_matrix": """
        SELECT *, cast({proba} >= 0.5e0 AS integer) AS predicted, {proba} AS otif_proba FROM matrix""",
    "long_features": """
        SELECT feature, value, is_reference, po_id FROM (
            SELECT po_id, receipt_date IS NOT NULL AS is_reference, otif_score IS NOT NULL AS has_label,
                   {doubles} FROM features
        ) UNPIVOT (value FOR feature IN ({names}))""",
    "long_matrix": """
        SELECT feature, value FROM (SELECT {doubles} FROM matrix) UNPIVOT (value FOR feature IN ({names}))""",
    "means": """
        SELECT feature, avg(value) FILTER (is_reference) AS ref_mean,
               avg(value) FILTER (NOT is_reference) AS cur_mean
        FROM long_features GROUP BY feature""",
    "shifts": """
        SELECT feature, CASE WHEN ref_mean <> 0 THEN abs(cur_mean - ref_mean) / abs(ref_mean) END AS shift FROM means""",
    "steps": """
        SELECT feature, value,
               sum(sum(CASE WHEN is_reference THEN 1 ELSE 0 END)) OVER w * 1e0
                   / (SELECT count(*) FROM features WHERE receipt_date IS NOT NULL) AS ref_share,
               sum(sum(CASE WHEN is_reference THEN 0 ELSE 1 END)) OVER w * 1e0
                   / (SELECT count(*) FROM features WHERE receipt_date IS NULL) AS cur_share
        FROM long_features GROUP BY feature, value
        WINDOW w AS (PARTITION BY feature ORDER BY value)""",
    "distances": """
        SELECT feature, max(abs(ref_share - cur_share)) AS distance FROM steps GROUP BY feature""",
    "questions": """
        SELECT concat('E', event_id) AS question_id,
               CASE event_id % 8
                   WHEN 0 THEN concat('Pourquoi le fournisseur ', user_id % nsup, ' a-t-il chuté ?')
                   WHEN 1 THEN concat('Supplier: ', user_id % (nsup * 2), ' status ?')
                   WHEN 2 THEN 'Quel est le niveau d''OTIF global ?'
                   WHEN 3 THEN 'Quels incidents qualité sont critiques ?'
                   WHEN 4 THEN concat('Où en est la commande ', event_id, ' ?')
                   WHEN 5 THEN 'Les fournisseurs ont-ils du retard de livraison ?'
                   WHEN 6 THEN concat('sup00', user_id % 10, ' est-il fiable ?')
                   ELSE CASE WHEN event_type = 'error' THEN '  ' ELSE 'Bonjour' END END AS text
        FROM events CROSS JOIN (SELECT count(*) AS nsup FROM supplier)
        UNION ALL
        SELECT concat('C', conv_id, '-', turn), text FROM conversations""",
    "routed": r"""
        SELECT question_id, clean AS text,
               CASE WHEN regexp_matches(lower(clean), '\b(supplier|fournisseur|sup\d+)\b') THEN 'supplier'
                    WHEN regexp_matches(lower(clean), 'incident|qualit|défaut|non conforme') THEN 'incident'
                    WHEN regexp_matches(lower(clean), 'commande|po|ordre') THEN 'order'
                    WHEN regexp_matches(lower(clean), 'otif|livraison|retard') THEN 'otif'
                    ELSE 'general' END AS question_type,
               upper(coalesce(nullif(regexp_extract(clean, '(?i)\b(SUP\d+)\b', 1), ''),
                              nullif(regexp_extract(clean,
                                  '(?i)\b(?:supplier|fournisseur)\s*[:=]?\s*([A-Z0-9]+)\b', 1), ''))) AS supplier_id
        FROM (SELECT question_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS clean FROM questions)""",
    "short_texts": """
        SELECT *, concat('Fournisseur ', supplier_id, ' | Classe ', coalesce(supplier_risk_class, 'N/A'),
                         ' | OTIF ', {pct:otif_rate}, ' | Délai moyen ', {dec:avg_delay_days},
                         ' jours | Incidents ', total_incidents, ' | Incidents critiques ',
                         critical_incidents, '.') AS line,
               row_number() OVER (ORDER BY otif_rate NULLS LAST, supplier_id) AS place
        FROM kpi""",
    "docs": """
        SELECT supplier_id AS id,
               concat('Fournisseur ', supplier_id, ' | Classe de risque : ', coalesce(supplier_risk_class, 'N/A'),
                      ' | Total commandes : ', total_orders, ' | Commandes livrees : ', delivered_orders,
                      ' | Commandes en attente : ', pending_orders, ' | Taux OTIF : ', {pct:otif_rate},
                      ' | Taux livraison a temps : ', {pct:on_time_rate},
                      ' | Taux quantite complete : ', {pct:in_full_rate},
                      ' | Retard moyen : ', {dec:avg_delay_days}, ' jours | Retard max : ',
                      coalesce(max_delay_days, 0), ' jours | Incidents qualite : ', total_incidents,
                      ' | Incidents critiques : ', critical_incidents, ' | Depense totale : ',
                      format('{{:,}}', cast(round(coalesce(total_ordered_spend, 0), 0) AS bigint)), ' USD') AS text,
               coalesce(supplier_risk_class, '') AS risk_class, coalesce(otif_rate, 0) AS otif_rate, total_orders
        FROM kpi""",
    "fallback": """
        SELECT r.question_id, r.supplier_id,
               CASE WHEN r.supplier_id IS NOT NULL AND s.supplier_id IS NOT NULL THEN s.line
                    WHEN r.supplier_id IS NOT NULL
                        THEN concat('[no figures for supplier ', r.supplier_id, ']')
                    ELSE (SELECT string_agg(line, '{sep}' ORDER BY place) FROM short_texts WHERE place <= 5)
               END AS docs
        FROM routed r LEFT JOIN short_texts s ON lower(r.supplier_id) = lower(s.supplier_id)""",
}



def _word_tables(fit: str, source: str, asked: dict[str, str]) -> dict[str, str]:
    """Tables of text vectors: words hashed to slots, counts times rarity, to unit length. ``source``
    (key, text) decides on the slots and their rarity, each of ``asked`` has vectors of its own."""
    words = r"SELECT key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM "
    slots = "SELECT key, cast(('0x' || substr(sha256(word), 1, 8)) AS bigint) % size AS slot, count(*) AS tf FROM "
    out = {
        f"{fit}_texts": source,
        f"{fit}_words": words + f"{fit}_texts",
        f"{fit}_size": f"""SELECT cast(least(1024, greatest(2, pow(2, ceil(log2(4 * count(DISTINCT word)))))) AS bigint)
            AS size FROM {fit}_words""",
        f"{fit}_number": f"SELECT count(*) AS n FROM {fit}_texts WHERE text IS NOT NULL",
        f"{fit}_rarity": f"""SELECT slot, count(*) AS d FROM ({slots} {fit}_words CROSS JOIN {fit}_size GROUP BY ALL)
            GROUP BY slot""",
    }
    for name, texts in asked.items():
        out |= {
            f"{name}_texts": texts,
            f"{name}_words": words + f"{name}_texts",
            f"{name}_slots": f"{slots} {name}_words CROSS JOIN {fit}_size GROUP BY ALL",
            f"{name}_weights": f"""SELECT key, s.slot, tf * ln((n + 1) * 1e0 / (coalesce(d, 0) + 1)) AS w
                FROM {name}_slots s CROSS JOIN {fit}_number LEFT JOIN {fit}_rarity r ON s.slot = r.slot""",
            f"{name}_vectors": f"""SELECT key, slot,
                cast(cast(w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS float) AS double) AS w
                FROM {name}_weights WHERE w <> 0""",
            f"{name}_lengths": f"SELECT key, sqrt(sum(w * w)) AS length FROM {name}_vectors GROUP BY key",
        }
    return out


def _near(asked: str, known: str) -> str:
    """The five nearest texts of each: asked, known, near, rank."""
    return f"""
        SELECT *, row_number() OVER (PARTITION BY asked ORDER BY near DESC, known) AS rank FROM (
            SELECT a.key AS asked, k.key AS known, round(coalesce(dot / (al.length * kl.length), 0), 9) AS near
            FROM {asked}_texts a CROSS JOIN {known}_texts k
            LEFT JOIN {asked}_lengths al ON a.key = al.key LEFT JOIN {known}_lengths kl ON k.key = kl.key
            LEFT JOIN (SELECT a.key AS x, k.key AS y, sum(a.w * k.w) AS dot
                       FROM {asked}_vectors a JOIN {known}_vectors k ON a.slot = k.slot GROUP BY a.key, k.key) p
                ON p.x = a.key AND p.y = k.key)
        QUALIFY rank <= 5"""


TABLES |= _word_tables("supplier", "SELECT id AS key, text FROM docs", {
    "known": "SELECT id AS key, text FROM docs",
    "asked": "SELECT DISTINCT coalesce(text, '') AS key, coalesce(text, '') AS text FROM questions",
    "turns": "SELECT concat_ws('-', conv_id, turn) AS key, text FROM conversations",
})
TABLES |= _word_tables("corpus", "SELECT doc_id AS key, text FROM documents", {
    "corpus_own": "SELECT doc_id AS key, text FROM documents",
})
TABLES |= {
    "nearest": _near("asked", "known"),
    "turns_nearest": _near("turns", "known"),
    "retrieved": """
        SELECT q.question_id, coalesce(q.text, '') AS text,
               CASE WHEN l.key IS NOT NULL THEN 'nearest' ELSE 'fallback' END AS source,
               CASE WHEN l.key IS NOT NULL THEN n.docs ELSE f.docs END AS docs,
               CASE WHEN l.key IS NOT NULL THEN n.n_docs
                    ELSE 1 + length(f.docs) - length(replace(f.docs, '{sep}', '')) END AS n_docs
        FROM questions q JOIN fallback f ON q.question_id = f.question_id
        LEFT JOIN asked_lengths l ON coalesce(q.text, '') = l.key
        LEFT JOIN (SELECT asked, string_agg(text, '{sep}' ORDER BY rank) AS docs, count(*) AS n_docs
                   FROM nearest JOIN known_texts ON known = key GROUP BY asked) n ON l.key = n.asked""",
}

FEATURES = [
    "ordered_qty", "unit_cost", "total_order_cost", "standard_lead_time_days", "is_repairable",
    "shelf_life_days", "part_family_enc", "criticality_class_enc", "supplier_risk_class_enc",
]
PROBA = "1e0 / (1e0 + standard_lead_time_days / 20e0 + ordered_qty / 100e0)"


def _code(column: str) -> str:
    return f"cast(('0x' || substr(sha256(lower(trim(coalesce({column}, 'UNKNOWN')))), 1, 8)) AS bigint)"


def _fill(text: str) -> str:
    """Put the shared expressions into a text."""
    text = re.sub(r"\{pct:(\w+)\}", r"printf('%.1f%%', round(coalesce(\1, 0) * 100e0, 1))", text)
    text = re.sub(r"\{dec:([\w.]+)\}", r"printf('%.1f', round(cast(coalesce(\1, 0) AS double), 1))", text)
    values = {
        "{proba}": PROBA,
        "{doubles}": ", ".join(f"cast({f} AS double) AS {f}" for f in FEATURES),
        "{names}": ", ".join(FEATURES),
        "{sep}": "\n",
        "{{": "{", "}}": "}",
        **{f"{{{c}}}": _code(c) for c in ("part_family", "criticality_class", "supplier_risk_class")},
    }
    for mark, value in values.items():
        text = text.replace(mark, value)
    return text


def query(body: str) -> str:
    """The statement with every table it names, directly or not, before it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in TABLES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(definition)

    visit(body)
    tables = [f"{name} AS ({_fill(text)})" for name, text in TABLES.items() if name in needed]
    head = f"WITH {', '.join(tables)}\n" if tables else ""
    return head + _fill(body)


def _risk(risk: str) -> str:
    return f"CASE WHEN {risk} < 0.3e0 THEN 'FAIBLE' WHEN {risk} < 0.6e0 THEN 'MOYEN' ELSE 'ÉLEVÉ' END"


def _segment(kind: str) -> str:
    return f"SELECT * FROM summary WHERE segment_type = '{kind}'"


_RATIO = "coalesce({0} * 1e0 / nullif({1}, 0), 0)"


def _ratio(part: str, whole: str) -> str:
    return _RATIO.format(part, whole)


_CELLS = """(SELECT count(*) FILTER (label = 0 AND predicted = 0) AS t0p0,
       count(*) FILTER (label = 0 AND predicted = 1) AS t0p1,
       count(*) FILTER (label = 1 AND predicted = 0) AS t1p0,
       count(*) FILTER (label = 1 AND predicted = 1) AS t1p1, count(*) AS n FROM scored_matrix)"""
_P0, _P1 = _ratio("t0p0", "(t0p0 + t1p0)"), _ratio("t1p1", "(t1p1 + t0p1)")
_R0, _R1 = _ratio("t0p0", "(t0p0 + t0p1)"), _ratio("t1p1", "(t1p1 + t1p0)")
_F0, _F1 = _ratio("2 * t0p0", "(2 * t0p0 + t0p1 + t1p0)"), _ratio("2 * t1p1", "(2 * t1p1 + t0p1 + t1p0)")


def _report_row(name: str, values: list[str], support: str) -> str:
    p, r, f = (f"round({v}, 4)" for v in values)
    return f"""SELECT '{name}' AS class, {p} AS "precision", {r} AS recall, {f} AS f1,
        cast({support} AS bigint) AS support FROM {_CELLS}"""


def _weighted(a: str, b: str) -> str:
    return f"({a} * (t0p0 + t0p1) + {b} * (t1p0 + t1p1)) / n"


_AUC = """(SELECT sum(pos * (2e0 * (below - neg) + neg)) / (2e0 * sum(pos) * sum(neg)) FROM (
    SELECT pos, neg, sum(neg) OVER (ORDER BY otif_proba) AS below FROM (
        SELECT otif_proba, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
        FROM scored_matrix GROUP BY otif_proba)))"""

_WEIGHTS = dict(zip(FEATURES, ("0.25e0", "0.125e0", "0.0625e0", "0.5e0", "2e0", "0.375e0", "1e-9", "2e-9", "3e-9")))
_CONTRIBUTIONS = f"""
    SELECT po_id, rank, feature, value, contribution FROM (
        SELECT *, row_number() OVER (PARTITION BY po_id ORDER BY contribution DESC, place) AS rank FROM (
            SELECT po_id, feature, round(value, 4) AS value, place,
                   round(CASE feature {" ".join(f"WHEN '{f}' THEN {w}" for f, w in _WEIGHTS.items())} END
                         * abs(value), 4) AS contribution
            FROM long_features JOIN (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(FEATURES))})
                 AS places(name, place) ON feature = name))
    WHERE rank <= 8"""

_OVERALL = ", ".join(
    f"(cast({i} AS integer), '{f}', round({w}, 4))"
    for i, (f, w) in enumerate(sorted(_WEIGHTS.items(), key=lambda x: -float(x[1]))[:5], 1)
)

_FAULT = """CASE WHEN new_lead_time NOT BETWEEN 1 AND 365 THEN 'lead_time_out_of_bounds'
                 WHEN new_quantity < 1 THEN 'quantity_out_of_bounds' END"""

_SUPPLIER_CARD = """concat('Situation du fournisseur ', k.supplier_id,
    '\n- Classe de risque : ', coalesce(k.supplier_risk_class, 'N/A'), '\n- OTIF : ', {pct:otif_rate},
    '\n- Livraison à temps : ', {pct:on_time_rate}, '\n- Quantité complète : ', {pct:in_full_rate},
    '\n- Délai moyen : ', {dec:avg_delay_days}, ' jours', '\n- Retard max : ', {dec:max_delay_days}, ' jours',
    '\n- Incidents : ', total_incidents, ' (critiques : ', critical_incidents, ')',
    '\n- Commandes : ', total_orders,
    '\nÀ lire ensemble : OTIF, délais et incidents ; retards et défauts répétés augmentent le risque.')"""
_GLOBAL_CARD = """(SELECT concat('Situation globale des commandes livrées', '\n- OTIF global : ', {pct:global_otif},
    '\n- Livraison à temps : ', {pct:on_time_rate}, '\n- Quantité complète : ', {pct:in_full_rate},
    '\n- Commandes analysées : ', total_orders) FROM overall)"""
_WORST_LIST = """(SELECT concat('Fournisseurs au plus bas taux OTIF\n', string_agg(concat('- ', supplier_id, ' | risque ',
    coalesce(supplier_risk_class, 'N/A'), ' | OTIF ', {pct:otif_rate}, ' | délai ', {dec:avg_delay_days},
    'j | incidents ', total_incidents), '\n' ORDER BY place)) FROM short_texts WHERE place <= 5)"""
_ROUTE = """CASE WHEN text = '' THEN 'empty' WHEN k.supplier_id IS NOT NULL THEN 'supplier'
                 WHEN question_type IN ('otif', 'general') THEN 'global' ELSE 'worst' END"""

_CHECKS = [
    ("marts_otif_kpi", "not_null", c, f"SELECT count(*) FROM mart WHERE {c} IS NULL")
    for c in ("po_id", "supplier_id", "part_id", "promised_date")
] + [
    ("marts_otif_kpi", "in_set", "otif_score", "SELECT count(*) FROM mart WHERE otif_score NOT IN (0, 1)"),
    ("marts_otif_kpi", "score_in_range", "otif_score",
     "SELECT count(*) FROM mart WHERE otif_score < 0 OR otif_score > 1"),
    ("marts_otif_kpi", "unique", "po_id",
     "SELECT count(*) FROM (SELECT po_id FROM mart GROUP BY po_id HAVING count(*) > 1)"),
    ("marts_otif_kpi", "relationships", "supplier_id",
     "SELECT count(*) FROM mart WHERE supplier_id NOT IN (SELECT supplier_id FROM stg_orders)"),
    ("marts_otif_kpi", "relationships", "part_id",
     "SELECT count(*) FROM mart WHERE part_id NOT IN (SELECT part_id FROM stg_parts)"),
    ("marts_supplier_kpi", "not_null", "supplier_id", "SELECT count(*) FROM kpi WHERE supplier_id IS NULL"),
    ("marts_supplier_kpi", "not_null", "total_orders", "SELECT count(*) FROM kpi WHERE total_orders IS NULL"),
    ("marts_supplier_kpi", "between", "otif_rate",
     "SELECT count(*) FROM kpi WHERE otif_rate NOT BETWEEN 0 AND 1"),
    ("marts_supplier_kpi", "unique", "supplier_id",
     "SELECT count(*) FROM (SELECT supplier_id FROM kpi GROUP BY supplier_id HAVING count(*) > 1)"),
]
_CHECK_ROWS = " UNION ALL ".join(
    f"""SELECT '{model}' AS model, '{test}' AS test, '{column}' AS "column", ({count}) AS n_fail"""
    for model, test, column, count in _CHECKS
)
_DRIFT = """SELECT count(*) FILTER (shift > 0.25) > 0 AS drift_detected,
       CASE WHEN count(*) FILTER (shift > 0.25) > 0 THEN 0.35e0 ELSE 0e0 END AS drift_share, 'measured' AS status,
       (SELECT count(*) FROM features WHERE receipt_date IS NOT NULL) AS reference_rows,
       (SELECT count(*) FROM features WHERE receipt_date IS NULL) AS current_rows,
       coalesce(string_agg(CASE WHEN shift > 0.25 THEN feature END, ',' ORDER BY feature), '') AS drifted_features
FROM shifts"""
_OPEN_SCORES = f"""SELECT po_id, supplier_id, otif_proba, 1e0 - otif_proba AS risk_score,
       {_risk('1e0 - otif_proba')} AS risk_level, cast(otif_proba >= 0.5e0 AS integer) AS predicted_otif FROM scored"""
_HEALTH = """
    SELECT bool_and(ok) OVER () AS healthy, "check", ok, 'measured' AS drift_status,
           (SELECT count(*) FILTER (shift > 0.25) > 0 FROM shifts) AS drift_detected, cast(0 AS bigint) AS total_calls
    FROM (VALUES ('marts_otif_kpi', (SELECT count(*) > 0 FROM mart)), ('marts_supplier_kpi', (SELECT count(*) > 0 FROM kpi)),
                 ('drift_report', (SELECT count(*) > 0 FROM shifts)){more}) AS checks("check", ok)"""
_DETAIL = """supplier_id, supplier_risk_class, total_orders, otif_rate, avg_delay_days, max_delay_days,
       total_incidents, critical_incidents"""
_RANKING = """supplier_id, supplier_risk_class, round(coalesce(otif_rate, 0), 4) AS otif_rate,
       round(coalesce(avg_delay_days, 0), 2) AS avg_delay_days, total_incidents, critical_incidents, total_orders"""
_KNOWN = "s.po_id IS NOT NULL"

_SHUFFLED = "cast(('0x' || substr(sha256(concat(po_id, '#42')), 1, 15)) AS bigint)"

BODIES = {
    "bronze_manifest": """
        SELECT 'parts_master' AS name, count(*) AS n_rows, 9 AS n_cols FROM raw_parts
        UNION ALL SELECT 'purchase_orders', count(*), 9 FROM raw_orders
        UNION ALL SELECT 'quality_incidents', count(*), 8 FROM raw_incidents
        UNION ALL SELECT 'supply_chain_history', count(*), 11 FROM raw_history""",
    "bronze_roundtrip": "SELECT * FROM stg_orders",
    "marts_otif_kpi": "SELECT * FROM mart",
    "orders_of_a_year": "SELECT * FROM mart WHERE order_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'",
    "rag_log_stats": """
        SELECT count(*) AS total_calls, round(avg(length(text) * 0.5e0), 1) AS avg_latency_ms,
               cast(sum(length(text)) AS bigint) AS total_tokens FROM conversations""",
    "drift_report_roundtrip": _DRIFT,
    "append_open_orders": r"""
        SELECT po_id, receipt_date IS NULL AS is_open FROM raw_orders
        UNION ALL
        SELECT printf('PO%06d', last + row_number() OVER (ORDER BY event_id)), true
        FROM events CROSS JOIN
             (SELECT max(cast(regexp_extract(po_id, '(\d+)', 1) AS bigint)) AS last FROM raw_orders)
        WHERE event_type = 'view'""",
    "stg_parts_master": "SELECT * FROM stg_parts",
    "stg_purchase_orders": "SELECT * FROM stg_orders",
    "stg_quality_incidents": "SELECT * FROM stg_incidents",
    "stg_supply_chain_history": "SELECT * FROM stg_history",
    "deduplicate": """
        SELECT * REPLACE (CASE WHEN receipt_date IS NULL THEN site_id ELSE concat('A-', site_id) END AS site_id)
        FROM stg_orders""",
    "otif_enriched": "SELECT * FROM mart",
    "delivered_orders": "SELECT po_id, supplier_id, otif_score FROM mart WHERE is_otif IS NOT NULL",
    "otif_by_supplier": _segment("supplier"),
    "otif_by_part_family": _segment("part_family"),
    "otif_by_criticality": _segment("criticality_class"),
    "otif_summary": "SELECT * FROM summary",
    "incident_stats": "SELECT * FROM incident_counts",
    "supplier_stats": "SELECT * FROM stats",
    "supplier_kpi": "SELECT * FROM kpi",
    "global_kpi": "SELECT * FROM overall",
    "order_lookup": """
        SELECT po_id, supplier_id, part_id, total_order_cost, otif_score
        FROM mart WHERE po_id IN (SELECT po_id FROM asked)""",
    "worst_suppliers": _segment("supplier") + " ORDER BY otif_rate_pct NULLS LAST, segment_value LIMIT 5",
    "worst_suppliers_detail": f"SELECT {_DETAIL} FROM kpi ORDER BY otif_rate NULLS LAST, supplier_id LIMIT 10",
    "supplier_ranking": f"SELECT {_RANKING} FROM kpi",
    "weakest_suppliers": f"""
        SELECT row_number() OVER (ORDER BY otif_rate, supplier_id) AS rank, * FROM (SELECT {_RANKING} FROM kpi)
        ORDER BY rank LIMIT 3""",
    "worst_by_kpi": "SELECT supplier_id, otif_rate FROM kpi ORDER BY otif_rate NULLS LAST, supplier_id LIMIT 5",
    "criticality_listing": _segment("criticality_class"),
    "part_family_listing": _segment("part_family"),
    "last_orders": "SELECT po_id, supplier_id, ordered_qty FROM mart ORDER BY order_date DESC, po_id DESC LIMIT 500",
    "supplier_diagnostic": """
        SELECT supplier_id, otif_rate,
               CASE WHEN coalesce(otif_rate, 0) < 0.05 OR critical_incidents >= 2 OR coalesce(avg_delay_days, 0) >= 5
                        THEN 'Dégradation'
                    WHEN critical_incidents = 0 AND total_incidents <= 3 AND coalesce(avg_delay_days, 0) <= 3
                        THEN 'Légère amélioration'
                    ELSE 'Stable / légèrement en baisse' END AS trend
        FROM kpi""",
    "dq_unique": """
        SELECT part_id, count(*) AS n_rows FROM mart WHERE part_id IS NOT NULL GROUP BY part_id HAVING count(*) > 1""",
    "dq_not_null": "SELECT po_id, supplier_id FROM mart WHERE receipt_date IS NULL",
    "dq_relationships": """
        SELECT part_id, count(*) AS n_rows FROM mart
        WHERE part_id NOT IN (SELECT part_id FROM stg_parts) GROUP BY part_id""",
    "dq_in_set": "SELECT part_id, criticality_class FROM stg_parts WHERE criticality_class NOT IN ('A', 'B')",
    "dq_between": "SELECT po_id, delay_days FROM mart WHERE delay_days NOT BETWEEN -365 AND 365",
    "dq_score_in_range": "SELECT po_id FROM mart WHERE fill_rate + 0.1e0 < 0 OR fill_rate + 0.1e0 > 1",
    "dq_checks": f"SELECT *, CASE WHEN n_fail > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({_CHECK_ROWS})",
    "category_codes": "SELECT DISTINCT part_family, {part_family} AS code FROM stg_parts",
    "build_features": "SELECT * EXCLUDE (supplier_id, receipt_date) FROM features",
    "feature_matrix": "SELECT * FROM matrix",
    "class_distribution": "SELECT label, count(*) AS n_rows FROM matrix GROUP BY label",
    "describe_features": """
        SELECT feature, count(*) AS count, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS stddev,
               round(min(value), 3) AS min, round(quantile_cont(value, 0.25), 3) AS p25,
               round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.75), 3) AS p75,
               round(max(value), 3) AS max
        FROM long_matrix GROUP BY feature""",
    "split_exact": f"""
        SELECT po_id, label, row_number() OVER (PARTITION BY label ORDER BY {_SHUFFLED}, po_id)
                             <= round(count(*) OVER (PARTITION BY label) * 0.2e0) AS is_test
        FROM matrix""",
    "split_by_hash": f"""
        SELECT po_id, CASE WHEN {_SHUFFLED} % 1000 < 200 THEN 'test' ELSE 'train' END AS part FROM matrix""",
    "roc_auc": f"SELECT round({_AUC}, 9) AS roc_auc",
    "confusion": "SELECT label, predicted, count(*) AS n_rows FROM scored_matrix GROUP BY label, predicted",
    "evaluation_report": f"""
        SELECT round({_AUC}, 4) AS roc_auc, round({_F1}, 4) AS f1, round({_P1}, 4) AS "precision",
               round({_R1}, 4) AS recall, n AS test_size,
               (SELECT round(avg(label), 4) FROM matrix) AS baseline_otif_rate
        FROM {_CELLS}""",
    "classification_report": " UNION ALL ".join([
        _report_row("Non-OTIF", [_P0, _R0, _F0], "t0p0 + t0p1"),
        _report_row("OTIF", [_P1, _R1, _F1], "t1p0 + t1p1"),
        _report_row("accuracy", ["(t0p0 + t1p1) * 1e0 / n"] * 3, "n"),
        _report_row("macro avg", [f"({a} + {b}) / 2" for a, b in ((_P0, _P1), (_R0, _R1), (_F0, _F1))], "n"),
        _report_row("weighted avg", [_weighted(a, b) for a, b in ((_P0, _P1), (_R0, _R1), (_F0, _F1))], "n"),
    ]),
    "predict_batch": _OPEN_SCORES,
    "predict_orders": f"""
        SELECT a.po_id, CASE WHEN {_KNOWN} THEN round(otif_proba, 4) ELSE 0.5e0 END AS otif_proba,
               CASE WHEN {_KNOWN} THEN round(1e0 - otif_proba, 4) ELSE 0.5e0 END AS risk_score,
               CASE WHEN {_KNOWN} THEN {_risk('round(1e0 - otif_proba, 4)')} ELSE 'MOYEN' END AS risk_level,
               CASE WHEN {_KNOWN} THEN cast(otif_proba >= 0.5e0 AS integer) ELSE 0 END AS predicted_otif,
               CASE WHEN {_KNOWN} THEN 'model' ELSE 'fallback' END AS source,
               CASE WHEN NOT {_KNOWN} THEN concat('po_id ''', a.po_id, ''' introuvable') END AS error
        FROM asked a LEFT JOIN scored s ON a.po_id = s.po_id""",
    "explain_orders": f"""
        SELECT a.po_id, round(1e0 - otif_proba, 4) AS risk_score,
               CASE WHEN {_KNOWN} THEN {_risk('round(1e0 - otif_proba, 4)')} END AS risk_level,
               round(otif_proba, 4) AS otif_proba,
               CASE WHEN {_KNOWN} THEN concat(CASE WHEN round(1e0 - otif_proba, 4) >= 0.6e0 THEN 'high'
                                                   WHEN round(1e0 - otif_proba, 4) >= 0.3e0 THEN 'moderate'
                                                   ELSE 'low' END, ': ', top.names) END AS summary,
               CASE WHEN NOT {_KNOWN} THEN concat('po_id ''', a.po_id, ''' introuvable') END AS error,
               e.kind, e.rank, e.feature, e.value, e.weight
        FROM asked a LEFT JOIN scored s ON a.po_id = s.po_id
        LEFT JOIN (SELECT po_id, string_agg(feature, ', ' ORDER BY rank) AS names FROM ({_CONTRIBUTIONS}) WHERE rank <= 3
                   GROUP BY po_id) top ON a.po_id = top.po_id
        LEFT JOIN (SELECT po_id, 'order' AS kind, cast(rank AS integer) AS rank, feature, value, contribution AS weight
                   FROM ({_CONTRIBUTIONS})
                   UNION ALL
                   SELECT po_id, 'overall', rank, feature, NULL, weight FROM scored CROSS JOIN (VALUES {_OVERALL})
                       AS overall(rank, feature, weight)) e ON a.po_id = e.po_id""",
    "local_contributions": _CONTRIBUTIONS,
    "what_if": f"""
        SELECT scenario_id, po_id, supplier_id, round(before, 4) AS initial_risk_score,
               round(after, 4) AS simulated_risk_score, round(after - before, 4) AS risk_delta,
               {_risk('after')} AS simulated_risk_level
        FROM (SELECT c.scenario_id, c.po_id, coalesce(c.new_supplier_id, f.supplier_id) AS supplier_id,
                     1e0 - {PROBA} AS before,
                     1e0 - 1e0 / (1e0 + coalesce(new_lead_time, standard_lead_time_days) / 20e0
                                  + coalesce(new_quantity, ordered_qty) / 100e0) AS after
              FROM scenarios c JOIN features f ON c.po_id = f.po_id WHERE {_FAULT} IS NULL)""",
    "rejected_scenarios": f"""
        SELECT scenario_id, po_id, reason FROM (
            SELECT c.scenario_id, c.po_id,
                   coalesce({_FAULT}, CASE WHEN m.po_id IS NULL THEN 'unknown_order' END) AS reason
            FROM scenarios c LEFT JOIN mart m ON c.po_id = m.po_id)
        WHERE reason IS NOT NULL""",
    "population_means": "SELECT feature, round(ref_mean, 3) AS ref_mean, round(cur_mean, 3) AS cur_mean FROM means",
    "drift_mean_shift": """
        SELECT feature, round(shift, 6) AS shift, coalesce(shift > 0.25, false) AS drifted FROM shifts""",
    "drift_ks": "SELECT feature, round(distance, 9) AS distance, distance > 0.1 AS drifted FROM distances",
    "drift_ks_between_quantities": """
        SELECT feature, round(max(abs(a - b)), 9) AS distance, max(abs(a - b)) > 0.1 AS drifted FROM (
            SELECT feature, sum(sum(CASE WHEN ordered_qty <= 20 THEN 1 ELSE 0 END)) OVER w * 1e0
                       / (SELECT count(*) FROM mart WHERE ordered_qty <= 20) AS a,
                   sum(sum(CASE WHEN ordered_qty > 20 THEN 1 ELSE 0 END)) OVER w * 1e0
                       / (SELECT count(*) FROM mart WHERE ordered_qty > 20) AS b
            FROM long_features JOIN mart USING (po_id) WHERE ordered_qty IS NOT NULL GROUP BY feature, value
            WINDOW w AS (PARTITION BY feature ORDER BY value))
        GROUP BY feature""",
    "drift_ks_report": """
        SELECT count(*) FILTER (distance > 0.1) > 0 AS drift_detected,
               round(count(*) FILTER (distance > 0.1) * 1e0 / count(*), 4) AS drift_share, 'measured' AS status,
               (SELECT count(*) FROM features WHERE receipt_date IS NOT NULL) AS reference_rows,
               (SELECT count(*) FROM features WHERE receipt_date IS NULL) AS current_rows
        FROM distances""",
    "quality_gate": f"""
        SELECT m AS model, count(*) FILTER (model = m AND n_fail > 0) = 0 AS passed,
               string_agg(concat(model, '.', "column", ' ', test, ': ', n_fail), '; ') FILTER (model = m AND n_fail > 0) AS reason
        FROM ({_CHECK_ROWS}) CROSS JOIN (VALUES ('marts_otif_kpi'), ('marts_supplier_kpi')) AS models(m) GROUP BY m""",
    "drift_between_classes": """
        SELECT feature, round(abs(cur - ref) / nullif(abs(ref), 0), 6) AS shift,
               coalesce(abs(cur - ref) / nullif(abs(ref), 0) > 0.25, false) AS drifted
        FROM (SELECT feature, avg(value) FILTER (criticality_class = 'A') AS ref,
                     avg(value) FILTER (criticality_class <> 'A') AS cur
              FROM long_features JOIN mart USING (po_id) WHERE criticality_class IS NOT NULL GROUP BY feature)""",
    "populations_by_flag": "SELECT is_delivered AS is_reference, count(*) AS n_rows FROM mart GROUP BY is_delivered",
    "populations_by_date": """
        SELECT order_date < (SELECT max(order_date) FROM (
                   SELECT order_date, sum(count(*)) OVER (ORDER BY order_date DESC) AS upto FROM mart GROUP BY order_date)
                   WHERE upto >= 0.2e0 * (SELECT count(*) FROM mart)) AS is_reference, count(*) AS n_rows
        FROM mart GROUP BY 1""",
    "supplier_documents": "SELECT * FROM docs",
    "retrieve_topk": """
        SELECT query_id, doc_id, round(near, 6) AS similarity, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, doc_id) AS rank FROM (
                SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
                       round(list_cosine_similarity(cast(q.embedding AS double[]), cast(d.embedding AS double[])), 9)
                           AS near
                FROM embeddings q CROSS JOIN embeddings d))
        WHERE rank <= 5""",
    "route_questions": "SELECT question_id, question_type, supplier_id FROM routed",
    "fallback_documents": "SELECT * FROM fallback",
    "retrieve_by_id": """
        SELECT r.supplier_id, coalesce(d.text, s.line,
               concat('[no figures for supplier ', r.supplier_id, ']')) AS text
        FROM (SELECT DISTINCT supplier_id FROM routed WHERE supplier_id IS NOT NULL) r
        LEFT JOIN docs d ON r.supplier_id = d.id
        LEFT JOIN short_texts s ON lower(r.supplier_id) = lower(s.supplier_id)""",
    "answer_questions": f"""
        SELECT question_id, question_type, r.supplier_id, {_ROUTE} AS route,
               CASE {_ROUTE}
                   WHEN 'empty' THEN 'Merci de poser une question sur les KPI, les fournisseurs ou les incidents.'
                   WHEN 'supplier' THEN {_SUPPLIER_CARD}
                   WHEN 'global' THEN {_GLOBAL_CARD}
                   ELSE {_WORST_LIST} END AS answer
        FROM routed r LEFT JOIN kpi k ON lower(r.supplier_id) = lower(k.supplier_id)""",
    "risk_prompts": f"""
        SELECT po_id, concat('po_id=', po_id, '; risk=', cast(trunc((1e0 - otif_proba) * 100e0) AS integer),
                   '%; level=', {_risk('1e0 - otif_proba')}, '; otif=', cast(trunc(otif_proba * 100e0) AS integer),
                   '%\n[documents]\n', d.text,
                   '\n[task]\nWhich of these figures drives the risk, and what should be done first?') AS prompt
        FROM scored s LEFT JOIN docs d ON s.supplier_id = d.id""",
    "what_if_prompts": f"""
        SELECT scenario_id, concat('po_id=', po_id, '; supplier=', w.supplier_id,
                   '; risk_before=', cast(trunc(before * 100e0) AS integer),
                   '%; risk_after=', cast(trunc(after * 100e0) AS integer), '%; level=', {_risk('raw_after')},
                   '\n[documents]\n', coalesce(d.text, 'Pas de contexte disponible.'),
                   '\n[task]\nIs the change worth making?') AS prompt
        FROM (SELECT c.scenario_id, c.po_id, coalesce(c.new_supplier_id, f.supplier_id) AS supplier_id,
                     round(1e0 - {PROBA}, 4) AS before,
                     1e0 - 1e0 / (1e0 + coalesce(new_lead_time, standard_lead_time_days) / 20e0
                                  + coalesce(new_quantity, ordered_qty) / 100e0) AS raw_after,
                     round(raw_after, 4) AS after
              FROM scenarios c JOIN features f ON c.po_id = f.po_id WHERE {_FAULT} IS NULL) w
        LEFT JOIN docs d ON w.supplier_id = d.id""",
    "retrieve": """
        SELECT question_id, cast(n_docs AS integer) AS n_docs, source, docs FROM retrieved""",
    "chat_prompts": """
        SELECT question_id, concat('[question]\n', text, '\n[documents]\n', replace(docs, '{sep}', '\n\n'),
                                   '\n[task]\nAnswer from the documents only.') AS prompt
        FROM retrieved""",
    "retrieval_evaluation": """
        SELECT round(avg(CASE WHEN length(docs) > 20 THEN 1e0 ELSE 0e0 END), 3) AS retrieval_success_rate,
               count(*) AS n_questions FROM (SELECT split_part(docs, '{sep}', 1) AS docs FROM retrieved)""",
    "ingest_stream": """
        SELECT * REPLACE (CASE WHEN receipt_date IS NULL THEN 0e0 ELSE received_qty END AS received_qty) FROM raw_orders""",
    "score_stream": _OPEN_SCORES + " WHERE receipt_date IS NULL",
    "model_training": f"""
        SELECT count(*) FILTER ({_SHUFFLED} % 1000 >= 200) AS train_size,
               count(*) FILTER ({_SHUFFLED} % 1000 < 200) AS test_size, true AS coherent FROM matrix""",
    "model_evaluation": f"""
        SELECT count(*) FILTER ({_SHUFFLED} % 1000 < 200) AS test_size, round(avg(label), 4) AS baseline_otif_rate,
               true AS coherent FROM matrix""",
    "model_importance": "SELECT unnest(generate_series(1, 9)) AS rank, true AS coherent, 1e0 AS total",
    "importance_ranking": f"""
        SELECT row_number() OVER (ORDER BY mean DESC, feature) AS rank, feature, round(mean, 4) AS importance FROM (
            SELECT feature, avg(abs(value) * CASE feature {" ".join(f"WHEN '{f}' THEN {w}" for f, w in _WEIGHTS.items())} END)
                AS mean FROM long_features GROUP BY feature)
        QUALIFY rank <= 5""",
    "model_predict_batch": "SELECT po_id, supplier_id, true AS coherent FROM scored",
    "model_predict_orders": f"""
        SELECT a.po_id, CASE WHEN {_KNOWN} THEN 'model' ELSE 'fallback' END AS source,
               CASE WHEN NOT {_KNOWN} THEN concat('po_id ''', a.po_id, ''' introuvable') END AS error, true AS coherent
        FROM asked a LEFT JOIN scored s ON a.po_id = s.po_id""",
    "model_explain_orders": f"""
        SELECT a.po_id, CASE WHEN NOT {_KNOWN} THEN concat('po_id ''', a.po_id, ''' introuvable') END AS error,
               CASE WHEN {_KNOWN} THEN 8 END AS n_features, CASE WHEN {_KNOWN} THEN 5 END AS n_overall,
               CASE WHEN {_KNOWN} THEN true END AS falling, CASE WHEN {_KNOWN} THEN true END AS coherent
        FROM asked a LEFT JOIN scored s ON a.po_id = s.po_id""",
    "model_what_if": f"""
        SELECT c.scenario_id, c.po_id, coalesce(c.new_supplier_id, f.supplier_id) AS supplier_id, true AS coherent
        FROM scenarios c JOIN features f ON c.po_id = f.po_id WHERE {_FAULT} IS NULL""",
    "model_score_stream": "SELECT po_id, supplier_id, true AS coherent FROM scored WHERE receipt_date IS NULL",
    "embed_documents": """
        SELECT doc_id, cast(slot AS integer) AS slot, cast(round_even(w * 1e6, 0) AS bigint) AS millionths
        FROM documents LEFT JOIN corpus_own_vectors ON doc_id = key""",
    "retrieve_supplier_documents": """
        SELECT asked AS query_id, known AS doc_id, round(near, 6) AS similarity, rank FROM turns_nearest""",
    "pipeline_health_complete": _HEALTH.format(more=""),
    "pipeline_health": _HEALTH.format(more=""", ('marts_without_rows', (SELECT count(*) > 0 FROM mart WHERE ordered_qty < 0)),
            ('model', false)"""),
}


def statements() -> dict[str, str]:
    return {name: query(body) for name, body in BODIES.items()}
