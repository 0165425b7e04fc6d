"""The given tables seen as cells, regions, pixels, scores and point sets, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types as cell types, and as the type names of the raster dictionary (one is unmapped).
EVENT_TO_TYPE = {"click": "tumor", "view": "cd8_t", "purchase": "macrophage", "signup": "vessel", "error": "treg"}
EVENT_TO_RASTER_TYPE = {"click": "Tumor", "view": "CD8T", "purchase": "Stroma", "signup": "Endothelial"}
CELL_TYPES = sorted(EVENT_TO_TYPE.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, mapping: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{raw}' THEN '{name}'" for raw, name in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr(_case("event_type", EVENT_TO_TYPE))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("cell_id"),
        F.col("user_id").alias("region_id"),
        ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))) / F.lit(864.0)).alias("x"),
        F.col("value").alias("y"),
        kind.alias("cell_type"),
        F.when(kind == "tumor", "tumor_core").otherwise("stroma").alias("compartment"),
        F.get_json_object("props", "$.k").cast("double").alias("marker_k"),
        F.col("value").alias("marker_v"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per region; a patient (nation) has one label."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("region_id"),
        F.concat(F.lit("s"), (F.col("c_custkey") % 10).cast("string")).alias("sample_id"),
        F.col("c_nationkey").cast("string").alias("patient_id"),
        F.when(F.col("n_regionkey") < 2, "CLR").otherwise("DII").alias("label"),
    )


def used_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that have cells."""
    return regions(spark, sf_dir).join(
        table(spark, sf_dir, "events").select(F.col("user_id").alias("region_id")), "region_id", "left_semi"
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("sample_id"),
        F.col("l_partkey").alias("cell_no"),
        F.col("l_quantity").alias("x"),
        F.col("l_linenumber").cast("double").alias("y"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scores: truth, a main and an auxiliary logit, the patient, and a fold number."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("int").alias("y"),
        (F.log(F.col("n_chars") + 1.0) - 6.0).alias("main_logit"),
        ((F.col("doc_id") % 17) / 4.0 - 2.0).alias("aux_logit"),
        ((F.col("doc_id") * 7 % 13) / 3.0 - 2.0).alias("topo_logit"),
        F.round(1.0 / (1.0 + F.exp(6.0 - F.log(F.col("n_chars") + 1.0))), 6).alias("main_p"),
        F.round(1.0 / (1.0 + F.exp(2.0 - (F.col("doc_id") % 17) / 4.0)), 6).alias("aux_p"),
        F.col("source").alias("patient_id"),
        F.col("lang").alias("run"),
        (F.col("doc_id") % 4).cast("int").alias("fold"),
    )


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        (F.col("vec_id") % 8).alias("region_id"),
        F.get("embedding", 0).cast("double").alias("x"),
        F.get("embedding", 1).cast("double").alias("y"),
        F.col("label").cast("string").alias("cell_type"),
    )


CELLS_SQL = f"""cells AS (
  SELECT event_id AS cell_id, user_id AS region_id,
         (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts)) / 864.0::DOUBLE AS x,
         value AS y, {_case('event_type', EVENT_TO_TYPE)} AS cell_type,
         CASE WHEN event_type = 'click' THEN 'tumor_core' ELSE 'stroma' END AS compartment,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS marker_k, value AS marker_v
  FROM events)"""

REGIONS_SQL = """regions AS (
  SELECT c_custkey AS region_id, 's' || CAST(c_custkey % 10 AS VARCHAR) AS sample_id,
         CAST(c_nationkey AS VARCHAR) AS patient_id,
         CASE WHEN n_regionkey < 2 THEN 'CLR' ELSE 'DII' END AS label
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

USED_REGIONS_SQL = REGIONS_SQL + """, used_regions AS (
  SELECT * FROM regions WHERE region_id IN (SELECT user_id FROM events))"""

PIXELS_SQL = """pixels AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, l_partkey AS cell_no, l_quantity AS x,
         CAST(l_linenumber AS DOUBLE) AS y, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

SCORES_SQL = """scores AS (
  SELECT l.doc_id AS row_id, CAST(l.quality AS INTEGER) AS y, ln(d.n_chars + 1.0::DOUBLE) - 6.0::DOUBLE AS main_logit,
         (l.doc_id % 17) / 4.0::DOUBLE - 2.0::DOUBLE AS aux_logit, (l.doc_id * 7 % 13) / 3.0::DOUBLE - 2.0::DOUBLE AS topo_logit,
         round(1.0 / (1.0 + exp(6.0::DOUBLE - ln(d.n_chars + 1.0::DOUBLE))), 6) AS main_p,
         round(1.0 / (1.0 + exp(2.0::DOUBLE - (l.doc_id % 17) / 4.0::DOUBLE)), 6) AS aux_p, d.source AS patient_id, d.lang AS run,
         CAST(l.doc_id % 4 AS INTEGER) AS fold
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

POINTS_SQL = """points AS (
  SELECT vec_id AS cell_id, vec_id % 8 AS region_id, CAST(embedding[1] AS DOUBLE) AS x,
         CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS VARCHAR) AS cell_type
  FROM embeddings)"""
