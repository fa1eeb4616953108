"""The model catalog as a table, lookups by any spelling, and rule reports over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.errors import UnknownModelError
from pagemill.functions.rules import suitability
from pagemill.functions.text import normalised_key
from pagemill.schema import MODEL

# The models, in catalog order.
MODELS = (
    ("glm-ocr", "GLM OCR", "OCR", "0.9B", ["General OCR", "Invoices", "Books", "Research Papers", "Forms", "Tables", "Formula Recognition", "Markdown Export"], 6.0, "6 GB VRAM", True, True, "zai-org/GLM-OCR", "The default engine: accurate text from invoices, papers, tables and formulas.", 1.8),
    ("lighton-ocr", "LightOnOCR", "OCR", "1B", ["Scientific Documents", "Academic Papers", "Multilingual OCR", "PDF Parsing"], 8.0, "8 GB VRAM", True, False, "lightonai/LightOnOCR-2-1B", "For scientific and multilingual documents and PDF parsing.", 2.0),
    ("hunyuan-ocr", "HunyuanOCR", "OCR", "~1B", ["Enterprise Documents", "Charts", "Tables", "Complex Layouts", "Information Extraction"], 8.0, "8 GB VRAM", True, False, "tencent/HunyuanOCR", "For complex layouts, charts and information extraction.", 2.0),
    ("smolvlm", "SmolVLM-256M", "Vision Language Model", "256M", ["Low End GPU", "Laptop", "Edge Device", "Jetson", "Offline OCR"], 2.0, "2 GB VRAM", True, False, "HuggingFaceTB/SmolVLM-256M-Instruct", "A compact model for edge devices and offline use.", 0.5),
)


def catalog(spark: SparkSession) -> DataFrame:
    """All models with their ordinal."""
    return spark.createDataFrame([(k, *m) for k, m in enumerate(MODELS)], MODEL)


def catalog_keys(models: DataFrame) -> DataFrame:
    """(key, exact, id): each id as it is, and ids and display names normalised."""
    exact = models.select(F.col("id").alias("key"), F.lit(True).alias("exact"), "id")
    loose = models.select(F.explode(F.array_distinct(F.array(normalised_key(F.col("id")), normalised_key(F.col("display_name"))))).alias("key"), F.lit(False).alias("exact"), "id")
    return exact.unionByName(loose)


def lookup(names: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with model_id and error. An exact id goes before a normalised spelling; a miss names the supported ids.

    The catalog is a literal of a few rows, so both of its sides are broadcast.
    """
    supported = ", ".join(m[0] for m in MODELS)
    keys = catalog_keys(models)
    exact = keys.where("exact").select(F.col("key").alias("_exact"), F.col("id").alias("_id"))
    loose = keys.where("NOT exact").select(F.col("key").alias("_loose"), F.col("id").alias("_alias"))
    found = names.join(F.broadcast(exact), F.col(name) == F.col("_exact"), "left").join(F.broadcast(loose), normalised_key(F.col(name)) == F.col("_loose"), "left")
    model = F.coalesce("_id", "_alias")
    error = F.when(model.isNull(), F.concat(F.lit("Unknown model '"), F.col(name), F.lit(f"'. Supported models: {supported}")))
    return found.select(*names.columns, model.alias("model_id"), error.alias("error"))


def is_registered(name: str) -> bool:
    """Exact ids only."""
    return any(m[0] == name for m in MODELS)


def get(name: str) -> tuple:
    """The catalog entry of an id or alias; raises UnknownModelError."""
    key = lambda s: s.lower().replace("-", "").replace("_", "").replace(" ", "")
    for m in MODELS:
        if m[0] == name:
            return m
    for m in MODELS:
        if key(name) in (key(m[0]), key(m[1])):
            return m
    raise UnknownModelError(name, [m[0] for m in MODELS])


def default_model(models: DataFrame) -> DataFrame:
    """The model marked as default, or the first."""
    return models.orderBy(F.desc("is_default"), "ordinal").limit(1)


def doctor(profiles: DataFrame, models: DataFrame, vram: str = "primary_vram_gb", cuda: str = "cuda_available") -> DataFrame:
    """Each profile with each model in catalog order: level and note. A cross join with a literal of four rows."""
    both = profiles.crossJoin(F.broadcast(models.select("ordinal", F.col("id").alias("model_id"))))
    rule = suitability(F.col("model_id"), F.col(vram), F.col(cuda))
    return both.select(*profiles.columns, "ordinal", "model_id", rule.getField("level").alias("level"), rule.getField("note").alias("note"))


def dependencies(required: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Required packages that are there (semi join) and that are missing (anti join)."""
    have = required.join(present, name, "left_semi").withColumn("installed", F.lit(True))
    return have.unionByName(required.join(present, name, "left_anti").withColumn("installed", F.lit(False)))
