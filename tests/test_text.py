import duckdb
import pytest
from pyspark.sql import functions as F

from punctual.functions.scalars import category_code, half_up, percent_text, risk_level, thousands_text
from punctual.functions.text import classify_question, extract_supplier_id


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, found", [
    ("Pourquoi le fournisseur SUP004 a-t-il chuté ?", "SUP004"),
    ("risque de sup12 et SUP4", "SUP12"),
    ("fournisseur avec retard", "AVEC"),
    ("les fournisseurs ont du retard", "S"),
    ("Supplier: x9 ?", "X9"),
    ("fournisseur = 42", "42"),
    ("fournisseur été", None),
    ("Quel est le risque fournisseur ?", None),
    ("", None), (None, None)])
def test_supplier_in_text(spark, text, found):
    assert value(spark, extract_supplier_id(F.lit(text).cast("string"))) == found


@pytest.mark.parametrize("text, kind", [
    ("Quel est le risque fournisseur ?", "supplier"), ("SUP007 ?", "supplier"),
    ("Les fournisseurs ont-ils du retard ?", "otif"), ("Défaut sur la pièce", "incident"),
    ("pourquoi donc", "order"), ("la commande 12", "order"), ("OTIF global", "otif"), ("bonjour", "general"),
    (None, "general")])
def test_question_type(spark, text, kind):
    assert value(spark, classify_question(F.lit(text).cast("string"))) == kind


def test_numbers_as_text(spark):
    assert value(spark, percent_text(F.lit(0.1235))) == "12.4%"
    assert value(spark, percent_text(F.lit(None).cast("double"))) == "0.0%"
    assert value(spark, thousands_text(F.lit(1234567.5))) == "1,234,568"


@pytest.mark.parametrize("x, digits, want", [(2.5, 0, 3.0), (-2.5, 0, -3.0), (12.35, 1, 12.4), (0.12344, 4, 0.1234)])
def test_half_up(spark, x, digits, want):
    assert value(spark, half_up(F.lit(x), digits)) == want


def test_half_up_of_every_small_ratio_as_in_sql(spark):
    pairs = spark.range(1, 301).withColumnRenamed("id", "n").select("n", F.explode(F.sequence(F.lit(0), "n")).alias("k"))
    ratio = F.col("k").cast("double") / F.col("n").cast("double")
    got = pairs.select("n", "k", *[half_up(ratio, p).alias(f"p{p}") for p in range(1, 5)]).toPandas()
    con = duckdb.connect()
    con.register("got", got)
    wrong = " OR ".join(f"p{p} <> round(k * 1e0 / n, {p})" for p in range(1, 5))
    assert con.execute(f"SELECT count(*) FROM got WHERE {wrong}").fetchall() == [(0,)]
    assert len(got) == 45450


def test_category_code(spark):
    assert value(spark, category_code(F.lit(" Avionics\t"))) == 4213257760
    assert value(spark, category_code(F.lit(None))) == value(spark, category_code(F.lit("unknown")))


@pytest.mark.parametrize("risk, level", [(0.2999, "FAIBLE"), (0.3, "MOYEN"), (0.5999, "MOYEN"), (0.6, "ÉLEVÉ")])
def test_risk_level(spark, risk, level):
    assert value(spark, risk_level(F.lit(risk))) == level
