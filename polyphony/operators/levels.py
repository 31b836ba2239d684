"""Roll-ups of similarity cells over levels, and the statistics of two samples on each level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyphony.functions.tails import f_sf
from polyphony.functions.text import pair_label

KEY = ["language", "prompt_id"]


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def pooled(intra: DataFrame) -> DataFrame:
    """language, prompt_id, sim: mean over models of one cell."""
    return intra.groupBy(*KEY).agg(F.avg(finite(F.col("intra_sim"))).alias("sim"))


def with_family(df: DataFrame, models: DataFrame, model: str = "model", out: str = "family") -> DataFrame:
    """``out`` = the model's family, 'Other' where the dimension has none.  ``models``: model, family (small, one row a model)."""
    fam = models.select(F.col("model").alias(model), F.col("family").alias(out)).dropDuplicates([model])
    return df.join(fam, model, "left").withColumn(out, F.coalesce(out, F.lit("Other")))


def _levels(df: DataFrame, parts: list[tuple[str, Column, bool]], *keep: str) -> DataFrame:
    """Every row once for each level: level, grp, lang (NULL on levels without one)."""
    entry = [F.struct(F.lit(level).alias("level"), grp.cast("string").alias("grp"), (F.col("language") if by_lang else F.lit(None).cast("string")).alias("lang")) for level, grp, by_lang in parts]
    return df.select(*keep, F.explode(F.array(*entry)).alias("x")).select("x.*", *keep)


def intra_level_values(intra: DataFrame, models: DataFrame, family_language: bool = True) -> DataFrame:
    """level, grp, lang, language, prompt_id, v: intra pooled over the models of the group, per cell."""
    x = with_family(intra, models)
    parts = [("general", F.lit("all"), False), ("family", F.col("family"), False), ("model", F.col("model"), False), ("language", F.col("language"), True)]
    parts += [("family_language", F.col("family"), True)] if family_language else []
    parts += [("model_language", F.col("model"), True)]
    out = _levels(x, parts, *KEY, "intra_sim")
    return out.groupBy("level", "grp", "lang", *KEY).agg(F.avg(finite(F.col("intra_sim"))).alias("v"))


def inter_families(inter: DataFrame, models: DataFrame) -> DataFrame:
    x = with_family(with_family(inter, models, "model_a", "fam_a"), models, "model_b", "fam_b")
    return x.withColumn("family_pair", pair_label(F.col("fam_a"), F.col("fam_b")))


def inter_level_values(inter: DataFrame, models: DataFrame, by_model: bool = False) -> DataFrame:
    """level, grp, lang, language, prompt_id, v: raw inter rows on each level; ``by_model`` adds a level on which a pair
    stands under both of its models."""
    x = inter_families(inter, models)
    parts = [("general", F.lit("all"), False), ("language", F.col("language"), True), ("family_pair", F.col("family_pair"), False), ("family_pair_language", F.col("family_pair"), True)]
    if by_model:
        parts += [("model", F.col("model_a"), False), ("model", F.col("model_b"), False)]
    return _levels(x, parts, *KEY, "inter_sim").withColumnRenamed("inter_sim", "v")


def moments(df: DataFrame, *by: str, v: str = "v", prefix: str = "a") -> DataFrame:
    """n, mean, sd (ddof 1) and var of the finite values."""
    x = finite(F.col(v))
    return df.groupBy(*by).agg(F.count(x).alias(f"n_{prefix}"), F.avg(x).alias(f"mean_{prefix}"), F.stddev_samp(x).alias(f"std_{prefix}"), F.var_samp(x).alias(f"var_{prefix}"))


def f_columns(df: DataFrame, p: bool = False) -> DataFrame:
    """F of means (one-way, two groups) and of variances (larger over smaller); ``p`` adds their tail probabilities."""
    na, nb, ma, mb, va, vb = (F.col(c) for c in ("n_a", "n_b", "mean_a", "mean_b", "var_a", "var_b"))
    within = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    df = df.where((na >= 2) & (nb >= 2))
    df = df.withColumn("f_means", F.try_divide((ma - mb) ** 2 * na * nb / (na + nb), within))
    df = df.withColumn("f_var", F.when((va > 0) & (vb > 0), F.greatest(va, vb) / F.least(va, vb)))
    if p:
        df = df.withColumn("p_means", f_sf(F.col("f_means"), F.lit(1.0), (na + nb - 2).cast("double")))
        top, low = F.when(va >= vb, na - 1).otherwise(nb - 1), F.when(va >= vb, nb - 1).otherwise(na - 1)
        df = df.withColumn("p_var", F.least(2 * f_sf(F.col("f_var"), top.cast("double"), low.cast("double")), F.lit(1.0)))
    return df


def against_human(values: DataFrame, human: DataFrame, p: bool = False) -> DataFrame:
    """level, grp, lang with the moments of both sides and F: the human side is all of its cells on levels without a
    language, those of the language on the others, whether or not a model answered them."""
    a = moments(values, "level", "grp", "lang", prefix="a")
    h = human.select("language", F.col("intra_sim").alias("v"))
    both = moments(h.select("v", F.explode(F.array(F.lit(None).cast("string"), F.col("language"))).alias("hl")).where("true"), "hl", prefix="b")
    return f_columns(a.join(both, F.col("lang").eqNullSafe(F.col("hl"))).drop("hl"), p)


def f_intra_levels(intra: DataFrame, human: DataFrame, models: DataFrame, p: bool = False) -> DataFrame:
    return against_human(intra_level_values(intra, models), human, p)


def f_cross_levels(inter: DataFrame, human: DataFrame, models: DataFrame, p: bool = False) -> DataFrame:
    return against_human(inter_level_values(inter, models), human, p)


def f_cross_model(inter: DataFrame, human: DataFrame, models: DataFrame, p: bool = False) -> DataFrame:
    x = inter_level_values(inter, models, by_model=True).where("level = 'model'")
    return against_human(x, human, p)


def f_family_pairwise(intra: DataFrame, models: DataFrame, p: bool = False) -> DataFrame:
    """family_a < family_b with moments and F of their pooled cells."""
    m = moments(intra_level_values(intra, models).where("level = 'family'"), "grp")
    a = m.withColumnRenamed("grp", "family_a")
    b = m.select(F.col("grp").alias("family_b"), *(F.col(f"{c}_a").alias(f"{c}_b") for c in ("n", "mean", "std", "var")))
    return f_columns(a.join(b, F.col("family_a") < F.col("family_b")), p)  # families are a handful of rows


def _paired(values: DataFrame, other: DataFrame) -> DataFrame:
    x = values.groupBy("level", "grp", "lang", *KEY).agg(F.avg("v").alias("llm")).join(other, KEY)
    return x.withColumn("gap", F.col("llm") - F.col("human"))


def paired_intra(intra: DataFrame, human: DataFrame, models: DataFrame) -> DataFrame:
    """level, grp, lang, language, prompt_id, llm, human, gap on five levels."""
    return _paired(intra_level_values(intra, models, family_language=False), human.select(*KEY, F.col("intra_sim").alias("human")))


def paired_cross(inter: DataFrame, human: DataFrame, models: DataFrame) -> DataFrame:
    return _paired(inter_level_values(inter, models, by_model=True), human.select(*KEY, F.col("intra_sim").alias("human")))


def paired_ladder(intra: DataFrame, inter: DataFrame) -> DataFrame:
    """Same model resampled against two models, per prompt; ``human`` holds the inter side."""
    x = pooled(intra).withColumnRenamed("sim", "v")
    v = _levels(x, [("general", F.lit("all"), False), ("language", F.col("language"), True)], *KEY, "v")
    return _paired(v, inter.groupBy(*KEY).agg(F.avg("inter_sim").alias("human")))


def side_stats(paired: DataFrame) -> DataFrame:
    """Means and standard errors of both sides over complete pairs; NULL under two."""
    ok = paired.where("llm is not null and human is not null")
    n = F.count(F.lit(1))
    se = lambda c: F.when(n >= 2, F.stddev_samp(c) / F.sqrt(n))
    mean = lambda c: F.when(n >= 2, F.avg(c))
    return ok.groupBy("level", "grp", "lang").agg(n.alias("n"), mean("llm").alias("mean_llm"), mean("human").alias("mean_human"), se("llm").alias("se_llm"), se("human").alias("se_human"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
