"""Registered queries: every operator over the whole sample tables.

Silver and Gold queries start from the raw tables. What comes after Gold reads the
stored marts, as it would in use. Queries whose result a model decides have a twin on a fixed scorer, so that
everything around the model can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from punctual.functions.joins import pick_rows
from punctual.functions.scalars import category_code, half_up, risk_level
from punctual.operators import (
    answers, documents, drift, explain, features, health, kpis, metrics, quality, ranking,
    retrieval, scoring, silver, training, whatif,
)
from punctual.plans import batch
from punctual.schemas import BRONZE, FEATURES
from punctual.session import scratch_path, shuffles_freed
from punctual.sources import lake, raw, reports, sample_tables as sample
from punctual.streaming import orders as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Importances used where SQL has to know them.
WEIGHTS = {f: w for f, w in zip(FEATURES, (0.25, 0.125, 0.0625, 0.5, 2.0, 0.375, 1e-9, 2e-9, 3e-9))}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def fixed_scorer(df: DataFrame) -> DataFrame:
    """Probability falling with lead time and quantity, by plain arithmetic."""
    lead, quantity = F.col("standard_lead_time_days"), F.col("ordered_qty")
    return df.withColumn("otif_proba", F.lit(1.0) / (F.lit(1.0) + lead / F.lit(20.0) + quantity / F.lit(100.0)))


# --- tables -----------------------------------------------------------------

RAW = {
    "parts_master": sample.parts_master,
    "purchase_orders": sample.purchase_orders,
    "quality_incidents": sample.quality_incidents,
    "supply_chain_history": sample.supply_chain_history,
}


def staged(spark, folder, name):
    return batch.STAGING[name](RAW[name](spark, folder))


def mart(spark, folder):
    return kpis.otif_enriched(
        staged(spark, folder, "purchase_orders"), staged(spark, folder, "parts_master")
    )


def kpi(spark, folder):
    return kpis.supplier_kpi(mart(spark, folder), staged(spark, folder, "quality_incidents"))


def _version(spark: SparkSession, folder: str) -> str:
    """Changes whenever a file of the folder does: what is stored under it is then made anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return str(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _gold(spark: SparkSession, folder: str) -> str:
    """Database with the Gold tables, built once per session and state of the input."""
    return _build_gold(spark, folder, _version(spark, folder))


@cache
def _build_gold(spark: SparkSession, folder: str, version: str) -> str:
    location = scratch_path(spark, "gold")
    database = "gold_" + location.rsplit("-", 1)[-1][:12]
    views = {f"stg_{name}": staged(spark, folder, name) for name in BRONZE}
    batch.build_gold(spark, views, database, location)
    return database


def gold_mart(spark, folder):
    return batch.read_orders(spark, _gold(spark, folder))


def gold_kpi(spark, folder):
    return lake.read_gold(spark, "marts_supplier_kpi", _gold(spark, folder))


def gold_summary(spark, folder):
    return lake.read_gold(spark, "marts_otif_summary", _gold(spark, folder))


def asked_orders(spark, folder):
    """Ids to look up: the orders received in full, and one unknown id per error event."""
    lines = gold_mart(spark, folder).filter("received_qty = ordered_qty").select("po_id")
    errors = sample.table(spark, folder, "events").filter("event_type = 'error'")
    return lines.unionByName(
        errors.select(F.concat(F.lit("PO-UNKNOWN-"), F.col("event_id").cast("string")).alias("po_id"))
    )


def scenarios(spark, folder):
    """One scenario per order, and one for an unknown order per error event."""
    known = gold_mart(spark, folder)
    quantity, part = F.col("ordered_qty").cast("bigint"), F.col("part_id").cast("bigint")
    changed = known.select(
        F.concat(F.lit("S"), "po_id").alias("scenario_id"),
        "po_id",
        F.when(part % 3 == 0, (quantity * 10).cast("int")).alias("new_lead_time"),
        F.when(part % 2 == 0, F.concat("supplier_id", F.lit("-B"))).alias("new_supplier_id"),
        F.when(part % 3 == 1, quantity - 1).alias("new_quantity"),
    )
    errors = sample.table(spark, folder, "events").filter("event_type = 'error'")
    event = F.col("event_id").cast("string")
    return changed.unionByName(errors.select(
        F.concat(F.lit("SE"), event).alias("scenario_id"),
        F.concat(F.lit("PO-UNKNOWN-"), event).alias("po_id"),
        F.lit(20).alias("new_lead_time"),
        F.lit(None).cast("string").alias("new_supplier_id"),
        F.lit(None).cast("bigint").alias("new_quantity"),
    ))


def matrix(spark, folder):
    return features.feature_matrix(features.build_features(gold_mart(spark, folder)), "po_id")


@cache
def _fit_model(spark: SparkSession, folder: str, version: str) -> str:
    path = scratch_path(spark, "model")
    train_part, _ = features.split(matrix(spark, folder))
    training.fit(train_part).write().overwrite().save(path)
    return path


def model(spark, folder):
    """All 300 trees, fitted on the whole train part once per session and state of the input."""
    return training.load_model(_fit_model(spark, folder, _version(spark, folder)))


def coherent(df: DataFrame, risk: str = "risk_score", level: str = "risk_level") -> DataFrame:
    """Replace what the trees decide by what must hold of it, which SQL can state: a
    probability, the risk that follows from it, its level and the class."""
    proba, digits = F.col("otif_proba"), F.lit(1e-4)
    holds = (
        proba.between(0, 1) & (F.abs(F.lit(1.0) - proba - F.col(risk)) < digits)
        & (F.col(level) == risk_level(F.col(risk)))
    )
    if "predicted_otif" in df.columns:
        holds = holds & ((F.col("predicted_otif") == (proba >= 0.5).cast("int")) | (F.abs(proba - 0.5) < digits))
    gone = {"otif_proba", risk, level, "predicted_otif"}
    return df.select(*[c for c in df.columns if c not in gone], holds.alias("coherent"))


def model_scorer(spark, folder):
    return scoring.model_scorer(model(spark, folder))


# --- sources and sinks --------------------------------------------------------

@register
def bronze_manifest(spark, folder):
    """CSV extracts written from the tables, then loaded to Bronze."""
    landing, bronze = scratch_path(spark, "raw"), scratch_path(spark, "bronze")
    for name, table in RAW.items():
        table(spark, folder).write.option("header", True).csv(f"{landing}/{name}.csv")
    return raw.load_bronze(spark, landing, bronze).select("name", "n_rows", "n_cols")


@register
def bronze_roundtrip(spark, folder):
    """Raw orders through CSV and Bronze Parquet, staged."""
    landing, bronze = scratch_path(spark, "raw"), scratch_path(spark, "bronze")
    sample.purchase_orders(spark, folder).write.option("header", True).csv(f"{landing}/purchase_orders.csv")
    raw.load_bronze(spark, landing, bronze, on_missing="skip")
    return silver.stg_purchase_orders(lake.read_bronze(spark, bronze, "purchase_orders"))


@register
def marts_otif_kpi(spark, folder):
    """The stored order mart read back."""
    return gold_mart(spark, folder)


@register
def orders_of_a_year(spark, folder):
    """Orders of 1995, from the months of that year alone."""
    return batch.orders_between(spark, date(1995, 1, 1), date(1995, 12, 31), _gold(spark, folder))


@register
def rag_log_stats(spark, folder):
    """Every conversation turn logged as a call, then the log's statistics."""
    path = scratch_path(spark, "log")
    turns = sample.table(spark, folder, "conversations")
    reports.log_calls(turns.select(
        F.col("text").alias("prompt"), F.col("role").alias("response"),
        (F.length("text") * F.lit(0.5)).alias("latency_ms"),
        F.length("text").alias("tokens_used"),
        F.array(F.col("text")).alias("docs"),
    ), path)
    return reports.call_stats(reports.read_log(spark, path))


@register
def drift_report_roundtrip(spark, folder):
    """The mean-shift report written as JSON and read back."""
    path = scratch_path(spark, "report")
    reports.write_report(drift.mean_shift_report(drift.populations(gold_mart(spark, folder))), path)
    return reports.load_drift_report(spark, path).select(
        "drift_detected", "drift_share", "status", "details.reference_rows", "details.current_rows",
        F.array_join("details.drifted_features", ",").alias("drifted_features"),
    )


@register
def append_open_orders(spark, folder):
    """Ids of all orders after one new open order per view event."""
    base = sample.purchase_orders(spark, folder)
    new = sample.table(spark, folder, "events").filter("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("supplier_id"),
        F.lit("SITE01").alias("site_id"),
        F.col("event_id").cast("string").alias("part_id"),
        F.col("ts").cast("date").alias("order_date"),
        F.date_add(F.col("ts").cast("date"), 14).alias("promised_date"),
        F.col("value").alias("ordered_qty"),
        F.lit(0.0).alias("received_qty"),
    )
    return lake.append_open_orders(base, new).select(
        "po_id", F.col("receipt_date").isNull().alias("is_open")
    )


# --- silver -------------------------------------------------------------------

@register
def stg_parts_master(spark, folder):
    return staged(spark, folder, "parts_master")


@register
def stg_purchase_orders(spark, folder):
    return staged(spark, folder, "purchase_orders")


@register
def stg_quality_incidents(spark, folder):
    return staged(spark, folder, "quality_incidents")


@register
def stg_supply_chain_history(spark, folder):
    return staged(spark, folder, "supply_chain_history")


@register
def deduplicate(spark, folder):
    """Orders delivered twice, received ones a third time under another site name that sorts
    first: one row per order."""
    orders = staged(spark, folder, "purchase_orders")
    renamed = orders.filter("receipt_date is not null").withColumn("site_id", F.concat(F.lit("A-"), "site_id"))
    return silver.deduplicate(orders.unionByName(orders).unionByName(renamed), "po_id")


# --- gold -----------------------------------------------------------------------

@register
def otif_enriched(spark, folder):
    return mart(spark, folder)


@register
def delivered_orders(spark, folder):
    return kpis.delivered_only(mart(spark, folder)).select("po_id", "supplier_id", "otif_score")


@register
def otif_by_supplier(spark, folder):
    return kpis.otif_by(mart(spark, folder), "supplier")


@register
def otif_by_part_family(spark, folder):
    return kpis.otif_by(mart(spark, folder), "part_family")


@register
def otif_by_criticality(spark, folder):
    return kpis.otif_by(mart(spark, folder), "criticality_class")


@register
def otif_summary(spark, folder):
    return kpis.otif_summary(mart(spark, folder))


@register
def incident_stats(spark, folder):
    return kpis.incident_stats(staged(spark, folder, "quality_incidents"))


@register
def supplier_stats(spark, folder):
    return kpis.supplier_stats(mart(spark, folder))


@register
def supplier_kpi(spark, folder):
    return kpi(spark, folder)


@register
def global_kpi(spark, folder):
    return kpis.global_kpi(mart(spark, folder))


@register
def order_lookup(spark, folder):
    """Mart rows of the asked ids."""
    return pick_rows(asked_orders(spark, folder), gold_mart(spark, folder), "po_id", "inner").select(
        "po_id", "supplier_id", "part_id", "total_order_cost", "otif_score"
    )


# --- rankings -------------------------------------------------------------------

@register
def worst_suppliers(spark, folder):
    return ranking.worst_suppliers(gold_summary(spark, folder))


@register
def worst_suppliers_detail(spark, folder):
    return ranking.worst_suppliers_detail(gold_kpi(spark, folder))


@register
def supplier_ranking(spark, folder):
    return ranking.supplier_ranking(gold_kpi(spark, folder))


@register
def weakest_suppliers(spark, folder):
    return ranking.weakest_table(gold_kpi(spark, folder))


@register
def worst_by_kpi(spark, folder):
    return ranking.worst_by_kpi(gold_kpi(spark, folder), retrieval.TOP_K).select("supplier_id", "otif_rate")


@register
def criticality_listing(spark, folder):
    return ranking.segment_listing(gold_summary(spark, folder), "criticality_class")


@register
def part_family_listing(spark, folder):
    return ranking.segment_listing(gold_summary(spark, folder), "part_family")


@register
def last_orders(spark, folder):
    return ranking.last_orders(gold_mart(spark, folder)).select("po_id", "supplier_id", "ordered_qty")


@register
def supplier_diagnostic(spark, folder):
    return ranking.supplier_diagnostic(gold_kpi(spark, folder)).select("supplier_id", "otif_rate", "trend")


# --- data tests -----------------------------------------------------------------

@register
def dq_unique(spark, folder):
    """Parts ordered more than once."""
    return quality.not_unique(gold_mart(spark, folder), "part_id")


@register
def dq_not_null(spark, folder):
    """Orders without a receipt date."""
    return quality.nulls(gold_mart(spark, folder), "receipt_date").select("po_id", "supplier_id")


@register
def dq_relationships(spark, folder):
    return quality.orphans(
        gold_mart(spark, folder), "part_id", staged(spark, folder, "parts_master"), "part_id"
    )


@register
def dq_in_set(spark, folder):
    return quality.not_in_set(staged(spark, folder, "parts_master"), "criticality_class", ["A", "B"]).select(
        "part_id", "criticality_class"
    )


@register
def dq_between(spark, folder):
    return quality.not_between(gold_mart(spark, folder), "delay_days", -365, 365).select("po_id", "delay_days")


@register
def dq_score_in_range(spark, folder):
    """Fill rates tested as if they were scores of 0.1 to 1.1: full orders are out of range."""
    shifted = gold_mart(spark, folder).withColumn("otif_score", F.col("fill_rate") + F.lit(0.1))
    return quality.otif_score_out_of_range(shifted)


@register
def dq_checks(spark, folder):
    return quality.run_checks(
        gold_mart(spark, folder), gold_kpi(spark, folder),
        staged(spark, folder, "purchase_orders"), staged(spark, folder, "parts_master"),
    )


@register
def quality_gate(spark, folder):
    """What the gate does on the tests of one model: passes, or stops and says why."""
    checks = dq_checks(spark, folder)
    rows = []
    for model in ("marts_otif_kpi", "marts_supplier_kpi"):
        try:
            quality.enforce(checks.filter(F.col("model") == model))
            rows.append((model, True, None))
        except quality.QualityGateError as stopped:
            rows.append((model, False, str(stopped)))
    return spark.createDataFrame(rows, "model string, passed boolean, reason string")


# --- features and metrics ---------------------------------------------------------

@register
def category_codes(spark, folder):
    parts = staged(spark, folder, "parts_master")
    return parts.select("part_family").distinct().select(
        "part_family", category_code(F.col("part_family")).alias("code")
    )


@register
def build_features(spark, folder):
    return features.build_features(gold_mart(spark, folder), require_target=False).select("po_id", *FEATURES, "otif_score")


@register
def feature_matrix(spark, folder):
    return matrix(spark, folder)


@register
def class_distribution(spark, folder):
    return features.class_distribution(matrix(spark, folder))


@register
def describe_features(spark, folder):
    numbers = ["mean", "stddev", "min", "p25", "p50", "p75", "max"]
    return features.describe_features(matrix(spark, folder)).select(
        "feature", "count", *[half_up(F.col(c), 3).alias(c) for c in numbers]
    )


@register
def split_exact(spark, folder):
    return features.split_exact(matrix(spark, folder)).select("po_id", "label", "is_test")


@register
def split_by_hash(spark, folder):
    train_part, test_part = features.split(matrix(spark, folder))
    return train_part.select("po_id", F.lit("train").alias("part")).unionByName(
        test_part.select("po_id", F.lit("test").alias("part"))
    )


def scored_matrix(spark, folder):
    scored = fixed_scorer(matrix(spark, folder))
    return scored.withColumn("predicted_otif", (F.col("otif_proba") >= 0.5).cast("int"))


@register
def roc_auc(spark, folder):
    return metrics.roc_auc(scored_matrix(spark, folder)).select(half_up(F.col("roc_auc"), 9).alias("roc_auc"))


@register
def confusion(spark, folder):
    return metrics.confusion(scored_matrix(spark, folder))


@register
def evaluation_report(spark, folder):
    return metrics.evaluation_report(matrix(spark, folder), scored_matrix(spark, folder))


@register
def classification_report(spark, folder):
    return metrics.classification_report(scored_matrix(spark, folder))


# --- scores -----------------------------------------------------------------------

@register
def predict_batch(spark, folder):
    return scoring.predict_batch(gold_mart(spark, folder), fixed_scorer)


@register
def predict_orders(spark, folder):
    return scoring.predict_orders(asked_orders(spark, folder), gold_mart(spark, folder), fixed_scorer)


@register
def explain_orders(spark, folder):
    """Whole explanations, one row for each of an order's own and of the overall features."""
    explained = explain.explain_orders(
        asked_orders(spark, folder), gold_mart(spark, folder), fixed_scorer, WEIGHTS
    )

    def entry(kind, weight):
        return lambda e, i: F.struct(
            F.lit(kind).alias("kind"), (i + 1).alias("rank"), e["feature"].alias("feature"),
            (e["value"] if kind == "order" else F.lit(None).cast("double")).alias("value"), e[weight].alias("weight"),
        )

    entries = F.concat(
        F.transform("top_features", entry("order", "contribution")),
        F.transform("global_importance", entry("overall", "importance")),
    )
    return explained.select(
        "po_id", "risk_score", "risk_level", "otif_proba", "summary", "error", F.explode_outer(entries).alias("entry")
    ).select("po_id", "risk_score", "risk_level", "otif_proba", "summary", "error", "entry.*")


@register
def local_contributions(spark, folder):
    return explain.local_contributions(
        features.build_features(gold_mart(spark, folder), require_target=False), WEIGHTS
    )


@register
def what_if(spark, folder):
    return whatif.what_if(gold_mart(spark, folder), scenarios(spark, folder), fixed_scorer)


@register
def rejected_scenarios(spark, folder):
    return whatif.rejected_scenarios(gold_mart(spark, folder), scenarios(spark, folder))


@register
def model_training(spark, folder):
    """Sizes of the hash split's parts; the held-out metrics of the trained model are shares."""
    return _shares(training.held_out_metrics(matrix(spark, folder), model(spark, folder)), "train_size", "test_size")


def _shares(report: DataFrame, *keep: str) -> DataFrame:
    measures = ["roc_auc", "f1", "precision", "recall"]
    fine = [F.col(m).between(0, 1) for m in measures]
    return report.select(*keep, (fine[0] & fine[1] & fine[2] & fine[3]).alias("coherent"))


@register
def model_evaluation(spark, folder):
    whole = matrix(spark, folder)
    _, test_part = features.split(whole)
    report = metrics.evaluation_report(whole, model_scorer(spark, folder)(test_part))
    return _shares(report, "test_size", "baseline_otif_rate")


@register
def model_importance(spark, folder):
    """Ranks of the trees' importances: shares of a known feature each, falling, one in total."""
    found = training.global_importance(spark, training.importances(model(spark, folder)))
    falling = F.col("importance") <= F.coalesce(F.lag("importance").over(Window.orderBy("rank")), F.lit(1.0))
    share = F.col("importance").between(0, 1) & F.col("feature").isin(FEATURES)
    return found.select("rank", (share & falling).alias("coherent"), found.agg(half_up(F.sum("importance"), 2)).scalar().alias("total"))


@register
def importance_ranking(spark, folder):
    """The five features that contribute most over all orders, by mean contribution."""
    table = features.build_features(gold_mart(spark, folder), require_target=False)
    means = table.agg(*[F.avg(F.abs(F.col(f).cast("double")) * F.lit(WEIGHTS[f])).alias(f) for f in FEATURES]).first()
    return training.global_importance(spark, {f: means[f] or 0.0 for f in FEATURES}, 5)


@register
def model_predict_batch(spark, folder):
    return coherent(scoring.predict_batch(gold_mart(spark, folder), model_scorer(spark, folder)))


@register
def model_predict_orders(spark, folder):
    return coherent(scoring.predict_orders(
        asked_orders(spark, folder), gold_mart(spark, folder), model_scorer(spark, folder)
    ))


@register
def model_explain_orders(spark, folder):
    fitted = model(spark, folder)
    explained = explain.explain_orders(
        asked_orders(spark, folder), gold_mart(spark, folder),
        scoring.model_scorer(fitted), training.importances(fitted),
    )
    # Contributions fall, and there are as many as for any order that is known.
    values = F.transform("top_features", lambda e: e["contribution"])
    return coherent(explained.select(
        "po_id", "otif_proba", "risk_score", "risk_level", "error", F.size("top_features").alias("n_features"),
        F.size("global_importance").alias("n_overall"), (values == F.reverse(F.array_sort(values))).alias("falling"),
    ))


@register
def model_what_if(spark, folder):
    run = whatif.what_if(gold_mart(spark, folder), scenarios(spark, folder), model_scorer(spark, folder))
    before, after = F.col("initial_risk_score"), F.col("simulated_risk_score")
    holds = before.between(0, 1) & after.between(0, 1) & (F.abs(after - before - F.col("risk_delta")) < 2e-4)
    return run.select("scenario_id", "po_id", "supplier_id", holds.alias("coherent"))


# --- drift --------------------------------------------------------------------------

@register
def population_means(spark, folder):
    means = drift.population_means(drift.populations(gold_mart(spark, folder)))
    return means.select(
        "feature", half_up(F.col("ref_mean"), 3).alias("ref_mean"), half_up(F.col("cur_mean"), 3).alias("cur_mean")
    )


@register
def drift_mean_shift(spark, folder):
    return drift.mean_shift(drift.populations(gold_mart(spark, folder))).select(
        "feature", half_up(F.col("shift"), 6).alias("shift"), "drifted"
    )


@register
def drift_ks(spark, folder):
    return drift.ks_distance(drift.populations(gold_mart(spark, folder))).select(
        "feature", half_up(F.col("distance"), 9).alias("distance"), "drifted"
    )


@register
def drift_ks_report(spark, folder):
    return drift.ks_report(drift.populations(gold_mart(spark, folder))).select(
        "drift_detected", "drift_share", "status", "details.reference_rows", "details.current_rows"
    )


@register
def drift_between_classes(spark, folder):
    """Mean shift between parts of class A and all others, which do differ."""
    marked = gold_mart(spark, folder).filter("criticality_class is not null").withColumn(
        "is_reference", F.col("criticality_class") == "A"
    )
    pops = features.build_features(marked, require_target=False).select("po_id", *FEATURES, "is_reference")
    return drift.mean_shift(pops).select("feature", half_up(F.col("shift"), 6).alias("shift"), "drifted")


@register
def drift_ks_between_quantities(spark, folder):
    """Distances between orders of up to 20 pieces and larger ones: cost and quantity drift."""
    marked = gold_mart(spark, folder).withColumn("is_reference", F.col("ordered_qty") <= 20)
    pops = features.build_features(marked, require_target=False).select("po_id", *FEATURES, "is_reference")
    return drift.ks_distance(pops).select("feature", half_up(F.col("distance"), 9).alias("distance"), "drifted")


@register
def populations_by_flag(spark, folder):
    """Sizes of the populations where no receipt date is known, only the delivery flag."""
    pops = drift.populations(gold_mart(spark, folder).drop("receipt_date"))
    return pops.groupBy("is_reference").agg(F.count(F.lit(1)).alias("n_rows"))


@register
def populations_by_date(spark, folder):
    """The same where neither is known: the latest fifth by order date is current."""
    pops = drift.populations(gold_mart(spark, folder).drop("receipt_date", "is_delivered"))
    return pops.groupBy("is_reference").agg(F.count(F.lit(1)).alias("n_rows"))


# --- documents and answers ------------------------------------------------------------

@register
def supplier_documents(spark, folder):
    return documents.supplier_documents(gold_kpi(spark, folder)).select(
        "id", "text", "metadata.risk_class", "metadata.otif_rate", "metadata.total_orders"
    )


@register
def retrieve_topk(spark, folder):
    """The five nearest vectors of every vector."""
    vectors = sample.table(spark, folder, "embeddings")
    return retrieval.retrieve_topk(
        vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "doc_id")
    )


@register
def route_questions(spark, folder):
    return answers.route_questions(sample.questions(spark, folder)).select(
        "question_id", "question_type", "supplier_id"
    )


@register
def fallback_documents(spark, folder):
    found = retrieval.fallback_documents(sample.questions(spark, folder), gold_kpi(spark, folder))
    return found.select("question_id", "supplier_id", F.array_join("docs", "\n").alias("docs"))


@register
def retrieve_by_id(spark, folder):
    """The document of every supplier named in a question."""
    asked = answers.route_questions(sample.questions(spark, folder)).filter("supplier_id is not null")
    figures = gold_kpi(spark, folder)
    return retrieval.retrieve_by_id(
        asked.select("supplier_id").distinct(), documents.supplier_documents(figures), figures
    )


@register
def answer_questions(spark, folder):
    return answers.answer_questions(
        sample.questions(spark, folder), gold_mart(spark, folder), gold_kpi(spark, folder)
    )


@register
def risk_prompts(spark, folder):
    """A prompt for every order with its supplier's document."""
    figures = gold_kpi(spark, folder)
    scored = scoring.predict_batch(gold_mart(spark, folder), fixed_scorer)
    texts = documents.supplier_documents(figures).select(
        F.col("id").alias("supplier_id"), F.array("text").alias("docs")
    )
    return answers.risk_prompts(retrieval.lookup_join(scored, texts, "supplier_id"))


@register
def what_if_prompts(spark, folder):
    """A prompt for every simulated order, with the document of its new supplier."""
    figures = gold_kpi(spark, folder)
    run = whatif.what_if(gold_mart(spark, folder), scenarios(spark, folder), fixed_scorer)
    texts = documents.supplier_documents(figures).select(F.col("id").alias("supplier_id"), F.array("text").alias("docs"))
    return answers.what_if_prompts(retrieval.lookup_join(run, texts, "supplier_id"))


def retrieved(spark, folder):
    """question_id, text, docs, source. Each text is searched for once, however many questions repeat it."""
    figures = gold_kpi(spark, folder)
    suppliers = documents.supplier_documents(figures).select("id", "text")
    asked = sample.questions(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    embedder = documents.fit_embedder(suppliers)
    texts = asked.select("text").distinct().withColumn("question_id", F.col("text"))
    found = retrieval.retrieve(documents.embed(texts, embedder), documents.embed(suppliers, embedder), figures)
    return retrieval.lookup_join(asked, found.select("text", "docs", "source"), "text")


@register
def retrieve(spark, folder):
    """Documents for every question: the nearest ones, else the KPI fallback."""
    found = retrieved(spark, folder)
    return found.select("question_id", F.size("docs").alias("n_docs"), "source", F.array_join("docs", "\n").alias("docs"))


@register
def chat_prompts(spark, folder):
    """A prompt for every question with the documents found for it."""
    return answers.chat_prompts(retrieved(spark, folder))


@register
def retrieval_evaluation(spark, folder):
    return retrieval.retrieval_success(retrieval.retrieval_samples(retrieved(spark, folder)))


@register
def embed_documents(spark, folder):
    """Vectors of all documents, whole texts."""
    texts = sample.table(spark, folder, "documents").select("doc_id", "text")
    found = documents.embed(texts, documents.fit_embedder(texts))
    cells = F.transform("embedding", lambda x, i: F.struct(i.alias("slot"), x.alias("weight")))
    # One row per word slot in use, in millionths; documents without a word have one empty row.
    return found.select("doc_id", F.explode_outer(F.filter(cells, lambda c: c["weight"] != 0)).alias("cell")).select(
        "doc_id", "cell.slot", F.rint(F.col("cell.weight").cast("double") * 1e6).cast("long").alias("millionths")
    )


@register
def retrieve_supplier_documents(spark, folder):
    """The nearest supplier documents of every conversation turn."""
    suppliers = documents.supplier_documents(gold_kpi(spark, folder)).select(F.col("id").alias("doc_id"), "text")
    asked = sample.table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text"
    )
    embedder = documents.fit_embedder(suppliers)
    found = retrieval.retrieve_topk(documents.embed(asked, embedder), documents.embed(suppliers, embedder))
    return found


# --- streams and health -----------------------------------------------------------------

def _opened(orders):
    return orders.withColumn("receipt_date", F.lit(None).cast("date")).withColumn("received_qty", F.lit(0.0))


@register
def ingest_stream(spark, folder):
    """Orders that arrive twice, lie in Bronze already or are closed later are there once,
    as they stand last."""
    landing, bronze = scratch_path(spark, "landing"), scratch_path(spark, "bronze")
    with shuffles_freed(spark):
        sample.purchase_orders(spark, folder).write.option("compression", "zstd").parquet(landing)
    # The files of the first copy, from which the others are made: the tables are joined once.
    orders = spark.read.parquet(landing)
    lake.write_bronze(_opened(orders.filter("part_id % 2 = 0")), f"{bronze}/purchase_orders", "purchase_orders")
    orders.unionByName(_opened(orders)).write.mode("append").option("compression", "zstd").parquet(landing)
    arriving = stream.read_orders(spark, landing, spark.read.parquet(landing).schema)
    stream.ingest_open_orders(arriving, bronze, scratch_path(spark, "checkpoint")).awaitTermination()
    return lake.read_bronze(spark, bronze, "purchase_orders")


@register
def score_stream(spark, folder):
    """Risk of the open orders of a stream."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "scores")
    sample.purchase_orders(spark, folder).write.parquet(landing)
    arriving = stream.read_orders(spark, landing, spark.read.parquet(landing).schema)
    scores = stream.score_open_orders(arriving, staged(spark, folder, "parts_master"), fixed_scorer)
    stream.write_scores(scores, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@register
def model_score_stream(spark, folder):
    """The same with the trained model."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "scores")
    sample.purchase_orders(spark, folder).write.parquet(landing)
    arriving = stream.read_orders(spark, landing, spark.read.parquet(landing).schema)
    scores = stream.score_open_orders(
        arriving, staged(spark, folder, "parts_master"), model_scorer(spark, folder)
    )
    stream.write_scores(scores, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return coherent(spark.read.parquet(out))


@register
def pipeline_health_complete(spark, folder):
    """The same with every table and file in place."""
    database, location = _gold(spark, folder), scratch_path(spark, "health")
    report = f"{location}/drift"
    reports.write_report(drift.mean_shift_report(drift.populations(gold_mart(spark, folder))), report)
    checks = health.health_checks(
        spark, [f"{database}.marts_otif_kpi", f"{database}.marts_supplier_kpi"], {"drift_report": report}
    )
    return _health_rows(spark, checks, report, location, database)


def _health_rows(spark, checks, report, location, database):
    """One row per check, named without the database, next to what the report says of all."""
    summary = health.pipeline_health(
        checks, reports.load_drift_report(spark, report), reports.read_log(spark, f"{location}/log")
    )
    return summary.select(
        "healthy", F.explode("checks").alias("check", "ok"), F.col("drift.status").alias("drift_status"),
        "drift.drift_detected", "rag.total_calls",
    ).withColumn("check", F.replace("check", F.lit(f"{database}."), F.lit("")))


@register
def pipeline_health(spark, folder):
    """Health over stored marts, a drift report and a log, all made from the tables."""
    database, location = _gold(spark, folder), scratch_path(spark, "health")
    report = f"{location}/drift"
    reports.write_report(drift.mean_shift_report(drift.populations(gold_mart(spark, folder))), report)
    lake.write_gold(gold_mart(spark, folder).filter("ordered_qty < 0"), "marts_without_rows", database)
    checks = health.health_checks(
        spark, [f"{database}.{name}" for name in ("marts_otif_kpi", "marts_supplier_kpi", "marts_without_rows")],
        {"drift_report": report, "model": f"{location}/absent"},
    )
    return _health_rows(spark, checks, report, location, database)
