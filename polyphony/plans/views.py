"""The engine's logical tables over a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyphony.functions.text import base_language
from polyphony.operators import lexical, prompts, vectors
from polyphony.sources.io import table


def generations(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per record; language is the label's base language."""
    r = table(spark, d, "responses")
    first = F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp_ntz" if dict(r.dtypes)["ingested_at"] == "timestamp_ntz" else "timestamp"))
    r = r.groupBy("gen_id").agg(*(F.min_by(c, first).alias(c) for c in r.columns if c != "gen_id"))  # the first delivery; columns not asked for are pruned
    g = r.select("gen_id", "model", "dataset", base_language(F.col("language")).alias("language"), "prompt_id", "sample_idx", F.col("response_text").alias("text"), "n_tokens", "finish_reason")
    return g.select(*columns) if columns else g


def models(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "models")
    return m.select(F.col("id").alias("model"), "display_name", "family", "gpus", "walltime").withColumn("family", F.coalesce("family", F.lit("Other")))


def human_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "oasst2_prompts").withColumn("language", base_language(F.col("language")))


def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, model, family, language, prompt_id, e: the vectors dealt to six respondents, one of them Human."""
    v = table(spark, d, "embeddings")
    k = F.col("vec_id") % 6
    return v.select("vec_id", F.when(k == 5, "Human").otherwise(F.concat(F.lit("m"), k)).alias("model"), F.concat(F.lit("L"), F.col("label") % 4).alias("language"), F.concat(F.lit("p"), F.col("label")).alias("prompt_id"), F.col("embedding").alias("e"))


def vector_families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"m{i}", f"V{i // 2}") for i in range(5)], "model string, family string")


def vector_cells(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cell_sums(vector_rows(spark, d))


def cosine(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(intra of the models, intra of Human, inter of the models)."""
    c = vector_cells(spark, d)
    i = vectors.intra(c)
    return i.where("model <> 'Human'"), i.where("model = 'Human'"), vectors.inter(c.where("model <> 'Human'"))


def llm_jaccard(spark: SparkSession, d: str, trunc: int | None = None) -> DataFrame:
    g = generations(spark, d, "gen_id", "model", "language", "prompt_id", "text")
    return lexical.intra_jaccard(g.withColumn("text", F.substring("text", 1, trunc)) if trunc else g, key="gen_id")


def human_jaccard(spark: SparkSession, d: str, trunc: int | None = None) -> DataFrame:
    h = prompts.human_answers(human_prompts(spark, d)).where("human_idx is not null").withColumn("model", F.lit("Human"))
    return lexical.intra_jaccard(h.withColumn("text", F.substring("text", 1, trunc)) if trunc else h, key="human_idx")
