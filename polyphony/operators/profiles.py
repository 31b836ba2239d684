"""Text profiles of models and languages: generation, fluency, fertility, morphology."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyphony.functions import text as T
from polyphony.operators.prompts import LANG_ORDER


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def generation_profile(gen: DataFrame) -> DataFrame:
    """model, mean_chars, trunc_pct, think_share, n_empty, dangling_think; NULL text counts as empty.

    dangling_think: texts of which nothing is left without reasoning blocks, an unclosed one reaching to the end."""
    t = F.coalesce("text", F.lit(""))
    return gen.groupBy("model").agg(
        F.avg(F.length(t)).alias("mean_chars"),
        (100 * share(F.coalesce(F.lower("finish_reason") == "length", F.lit(False)))).alias("trunc_pct"),
        share(t.contains("<think>")).alias("think_share"),
        F.sum((T.strip(t) == "").cast("long")).alias("n_empty"),
        F.sum((F.length(T.strip_think(t)) == 0).cast("long")).alias("dangling_think"),
    )


def think_stripped(gen: DataFrame) -> DataFrame:
    """gen_id, stripped, had_think, empty_after_strip."""
    s = T.strip_think(F.coalesce("text", F.lit("")))
    x = gen.select("gen_id", F.coalesce("text", F.lit("")).alias("raw"), s.alias("stripped"))
    return x.select("gen_id", "stripped", (F.col("raw") != F.col("stripped")).alias("had_think"), (F.length("stripped") == 0).alias("empty_after_strip"))


def score_language(rows: DataFrame, classify: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Provider interface of language identification: ``classify`` maps batches in mapInPandas; texts come on one line."""
    return rows.withColumn("text", T.flatten_lines(F.coalesce("text", F.lit("")))).mapInPandas(classify, schema)


def surrogate_scores(gen: DataFrame) -> DataFrame:
    """A deterministic stand-in for a classifier: model, language, pred_lang, pred_conf, target_conf, match."""
    order = F.array(*(F.lit(x) for x in LANG_ORDER))
    nxt = F.element_at(order, (F.array_position(order, F.coalesce("language", F.lit(""))) % len(LANG_ORDER) + 1).cast("int"))
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    pred = F.when(blank, None).when(F.col("gen_id") % 7 != 0, F.col("language")).otherwise(nxt)
    conf = F.when(blank, 0.0).otherwise((F.col("gen_id") % 97) / 96.0)
    x = gen.select("model", "language", pred.alias("pred_lang"), conf.alias("pred_conf"))
    match = F.coalesce(F.col("pred_lang") == F.col("language"), F.lit(False))
    return x.withColumn("match", match).withColumn("target_conf", F.when(match, F.col("pred_conf")).otherwise(0.0))


def fluency_summary(scores: DataFrame) -> DataFrame:
    """model, language, n, match_rate, mean_target_conf, mean_pred_conf; NULL keys are kept."""
    return scores.groupBy("model", "language").agg(F.count(F.lit(1)).alias("n"), share(F.col("match")).alias("match_rate"), F.avg("target_conf").alias("mean_target_conf"), F.avg("pred_conf").alias("mean_pred_conf"))


def fertility(counts: DataFrame) -> DataFrame:
    """tokenizer, language, tokens_per_sentence, tokens_per_char, fertility_vs_en from rows tokenizer, language, n_tok, n_char."""
    x = counts.groupBy("tokenizer", "language").agg((F.sum("n_tok") / F.count(F.lit(1))).alias("tokens_per_sentence"), F.try_divide(F.sum("n_tok"), F.sum("n_char")).alias("tokens_per_char"))
    en = F.max(F.when(F.col("language") == "en", F.col("tokens_per_sentence"))).over(Window.partitionBy("tokenizer"))
    return x.withColumn("fertility_vs_en", F.try_divide(F.col("tokens_per_sentence"), en))


def surrogate_counts(rows: DataFrame) -> DataFrame:
    """tok2, tok3, tok4: one token for every 2, 3 or 4 characters begun."""
    n = F.length(F.coalesce("text", F.lit("")))
    each = F.explode(F.array(*(F.struct(F.lit(f"tok{k}").alias("tokenizer"), F.ceil(n / F.lit(float(k))).cast("long").alias("n_tok")) for k in (2, 3, 4)))).alias("x")
    return rows.where("language is not null").select("language", n.cast("long").alias("n_char"), each).select("x.tokenizer", "language", "x.n_tok", "n_char")


def morphology(rows: DataFrame) -> DataFrame:
    """language, ttr, mean_word_len; NULL in languages written without blanks."""
    w = rows.where("language is not null and text is not null").select("language", F.explode(T.words(F.col("text"))).alias("w"))
    per = w.groupBy("language", "w").agg(F.count(F.lit(1)).alias("c"))  # distinct words first: no set of words in one task
    spaced = ~F.col("language").isin("zh", "ja")
    out = per.groupBy("language").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("all"), F.sum(F.col("c") * F.length("w")).alias("chars"))
    return out.select("language", F.when(spaced, F.col("types") / F.col("all")).alias("ttr"), F.when(spaced, F.col("chars") / F.col("all")).alias("mean_word_len"))
