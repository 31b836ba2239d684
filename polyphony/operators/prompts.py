"""Prompt selection from a message tree, and human answers in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyphony.operators.resample import sample_k

# The languages, in their fixed order.
LANG_ORDER = ("en", "es", "ru", "zh", "de", "fr", "ca", "pt-BR", "it", "ja", "eu", "pl", "vi")


def kept_messages(messages: DataFrame) -> DataFrame:
    """Neither deleted nor unreviewed; a repeated message counts once."""
    return messages.where(~F.coalesce("deleted", F.lit(False)) & F.coalesce("review_result", F.lit(False))).dropDuplicates(["message_id"])


def prompt_pool(messages: DataFrame) -> DataFrame:
    """prompt_id, language, prompt_text, human_responses (ordered by message), n_responses of every root prompt."""
    m = kept_messages(messages)
    answers = m.where("role = 'assistant'").groupBy(F.col("parent_id").alias("message_id")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("message_id", "text"))).alias("a"))
    roots = m.where("role = 'prompter' and parent_id is null").select("message_id", "lang", "text")
    j = roots.join(answers, "message_id", "left")
    return j.select(F.col("message_id").alias("prompt_id"), F.col("lang").alias("language"), F.col("text").alias("prompt_text"), F.col("a.text").alias("human_responses"), F.coalesce("n", F.lit(0)).alias("n_responses"))


def eligible(pool: DataFrame, least: int = 3) -> DataFrame:
    return pool.where((F.col("n_responses") >= least) & F.col("language").isin(*LANG_ORDER))


def pool_sizes(pool: DataFrame, least: int = 3) -> DataFrame:
    """language, n_eligible, bottleneck: the smallest pool is marked."""
    n = eligible(pool, least).groupBy("language").agg(F.count(F.lit(1)).alias("n_eligible"))
    return n.withColumn("bottleneck", F.col("language") == F.min_by("language", F.struct("n_eligible", "language")).over(Window.partitionBy()))


def select_prompts(pool: DataFrame, k: int, least: int = 3, seed: int = 42) -> DataFrame:
    """k eligible prompts of each language; a language with fewer is an error."""
    return sample_k(eligible(pool, least), k, "language", "prompt_id", seed)


def first_per_prompt(prompts: DataFrame) -> DataFrame:
    w = Window.partitionBy("prompt_id").orderBy(F.col("language").asc_nulls_last(), F.col("n_responses").asc_nulls_last())
    return prompts.where("prompt_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def human_answers(prompts: DataFrame) -> DataFrame:
    """language, prompt_id, human_idx, text: one row per answer; a prompt without a list keeps one row without text."""
    return first_per_prompt(prompts).select("language", "prompt_id", F.posexplode_outer("human_responses").alias("human_idx", "text"))


def lang_rank(c: Column) -> Column:
    """Place in the fixed order, 0 where it has none."""
    return F.array_position(F.array(*(F.lit(x) for x in LANG_ORDER)), c)
