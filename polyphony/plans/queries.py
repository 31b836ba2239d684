"""Registered queries of the engine: name -> callable(spark, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyphony.functions import text as T
from polyphony.operators import levels, lexical, profiles, prompts, regress, resample, robust, vectors
from polyphony.plans import views as V
from polyphony.session import materialise, shared_dir
from polyphony.sources import io

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query
def intra_cosine(spark, d):
    return rounded(vectors.intra(V.vector_cells(spark, d)))


@query
def model_summary(spark, d):
    i = vectors.intra(V.vector_cells(spark, d))
    return rounded(i.groupBy("model").agg(F.count("intra_sim").alias("n_cells"), F.avg("intra_sim").alias("mean_sim"), F.stddev_samp("intra_sim").alias("std_sim")))


@query
def pair_summary(spark, d):
    i = vectors.inter(V.vector_cells(spark, d))
    return rounded(i.groupBy("model_a", "model_b").agg(F.count("inter_sim").alias("n_cells"), F.avg("inter_sim").alias("mean_sim"), F.stddev_samp("inter_sim").alias("std_sim")))


@query
def inter_cosine(spark, d):
    return rounded(vectors.inter(V.vector_cells(spark, d)))


def _matrix(spark, d):
    c = V.vector_cells(spark, d)
    return vectors.respondent_matrix(vectors.intra(c), vectors.inter(c))


@query
def respondent_matrix(spark, d):
    return rounded(_matrix(spark, d))


@query
def respondent_matrix_wide(spark, d):
    names = [f"m{i}" for i in range(5)] + ["Human"]
    return rounded(robust.to_wide(_matrix(spark, d), "resp_a", "resp_b", "sim", names))


@query
def family_matrix(spark, d):
    return rounded(vectors.family_matrix(_matrix(spark, d), V.vector_families(spark)))


@query
def family_self_sim(spark, d):
    m = _matrix(spark, d).where("resp_a = resp_b").join(V.vector_families(spark), F.col("resp_a") == F.col("model"))
    return rounded(m.groupBy("family").agg(F.avg("sim").alias("self_sim"), F.count(F.lit(1)).alias("n_models")))


@query
def intra_jaccard(spark, d):
    return rounded(V.llm_jaccard(spark, d))


@query
def intra_jaccard_trunc(spark, d):
    return rounded(V.llm_jaccard(spark, d, 500))


@query
def human_jaccard(spark, d):
    return rounded(V.human_jaccard(spark, d))


@query
def inter_jaccard(spark, d):
    return rounded(lexical.inter_jaccard(V.generations(spark, d, "gen_id", "model", "language", "prompt_id", "sample_idx", "text"), key="gen_id"))


@query
def ngram_set_size(spark, d):
    g = V.generations(spark, d, "gen_id", "text")
    return g.select("gen_id", F.size(T.ngrams(F.coalesce("text", F.lit("")))).cast("long").alias("n_grams"))


@query
def pooled_cell(spark, d):
    return rounded(levels.pooled(V.cosine(spark, d)[0]))


_F = ["n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", "f_means", "f_var"]


@query
def f_intra_levels(spark, d):
    i, h, _ = V.cosine(spark, d)
    return rounded(levels.f_intra_levels(i, h, V.vector_families(spark)).select("level", "grp", "lang", *_F))


@query
def f_intra_levels_p(spark, d):
    i, h, _ = V.cosine(spark, d)
    return rounded(levels.f_intra_levels(i, h, V.vector_families(spark), p=True).select("level", "grp", "lang", "p_means", "p_var"))


@query
def f_cross_levels(spark, d):
    _, h, x = V.cosine(spark, d)
    return rounded(levels.f_cross_levels(x, h, V.vector_families(spark)).select("level", "grp", "lang", *_F))


@query
def f_cross_model(spark, d):
    _, h, x = V.cosine(spark, d)
    return rounded(levels.f_cross_model(x, h, V.vector_families(spark)).select("level", "grp", "lang", *_F))


@query
def f_family_pairwise(spark, d):
    return rounded(levels.f_family_pairwise(V.cosine(spark, d)[0], V.vector_families(spark)).select("family_a", "family_b", *_F))


@query
def variance_f(spark, d):
    i, h, _ = V.cosine(spark, d)
    x = levels.f_intra_levels(i, h, V.vector_families(spark)).where("level = 'model'")
    top = F.when(F.col("var_a") >= F.col("var_b"), F.col("n_a") - 1).otherwise(F.col("n_b") - 1)
    low = F.when(F.col("var_a") >= F.col("var_b"), F.col("n_b") - 1).otherwise(F.col("n_a") - 1)
    return rounded(x.select("grp", "f_var", top.alias("df_top"), low.alias("df_low")))


def _paired(spark, d, which):
    i, h, x = V.cosine(spark, d)
    f = V.vector_families(spark)
    return {"intra": lambda: levels.paired_intra(i, h, f), "cross": lambda: levels.paired_cross(x, h, f), "ladder": lambda: levels.paired_ladder(i, x)}[which]()


@query
def paired_intra(spark, d):
    return rounded(_paired(spark, d, "intra"))


@query
def paired_cross(spark, d):
    return rounded(_paired(spark, d, "cross"))


@query
def paired_ladder(spark, d):
    return rounded(_paired(spark, d, "ladder"))


@query
def side_stats(spark, d):
    return rounded(levels.side_stats(_paired(spark, d, "intra")))


# The SQL twins repeat so many draws; the queries named _full take the operators' own, as the reference does, and have no twin.
SQL_DRAWS = 200


@query
def bootstrap_ci(spark, d):
    return rounded(resample.bootstrap_ci(_paired(spark, d, "intra"), SQL_DRAWS))


@query
def bootstrap_ci_full(spark, d):
    return rounded(resample.bootstrap_ci(_paired(spark, d, "intra")))


@query
def signflip_perm(spark, d):
    return rounded(resample.signflip(_paired(spark, d, "intra"), SQL_DRAWS))


@query
def signflip_perm_full(spark, d):
    return rounded(resample.signflip(_paired(spark, d, "intra")))


@query
def cluster_bootstrap(spark, d):
    return rounded(resample.cluster_bootstrap(_paired(spark, d, "intra"), SQL_DRAWS))


@query
def cluster_bootstrap_full(spark, d):
    return rounded(resample.cluster_bootstrap(_paired(spark, d, "intra")))


@query
def wilcoxon_w(spark, d):
    return rounded(resample.wilcoxon(_paired(spark, d, "intra")))


@query
def paired_t(spark, d):
    return rounded(resample.paired_t(_paired(spark, d, "intra")))


@query
def paired_p_values(spark, d):
    p = _paired(spark, d, "intra")
    w, t = resample.wilcoxon(p, p=True), resample.paired_t(p, p=True)
    k = [F.col(f"w.{c}").eqNullSafe(F.col(f"t.{c}")) for c in resample.GROUP]
    return rounded(w.alias("w").join(t.alias("t"), k).select(*(F.col(f"w.{c}") for c in resample.GROUP), "n_nonzero", "w_plus", "p_wilcoxon", "t", "p_t"))


def _tests(spark, d, **draws):
    out = []
    for name in ("intra", "cross", "ladder"):
        p = _paired(spark, d, name)
        perm = resample.signflip(p, **draws)
        gap = p.where("gap is not null").groupBy(*resample.GROUP).agg(F.avg("gap").alias("mean_gap"))
        k = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in resample.GROUP]
        out.append(perm.alias("a").join(gap.alias("b"), k).select(F.lit(name).alias("comparison"), *(F.col(f"a.{c}") for c in resample.GROUP), "mean_gap", "p_perm"))
    return resample.adjust(levels.union_all(out), "p_perm", "comparison", "level")


@query
def holm_bh(spark, d):
    return rounded(_tests(spark, d, b=SQL_DRAWS))


@query
def holm_bh_full(spark, d):
    return rounded(_tests(spark, d))


@query
def test_counts(spark, d):
    return robust.counts_under(_tests(spark, d, b=SQL_DRAWS), "p_perm")


@query
def test_counts_full(spark, d):
    return robust.counts_under(_tests(spark, d), "p_perm")


def _pool(spark, d):
    return prompts.prompt_pool(io.table(spark, d, "messages"))


@query
def prompt_pools(spark, d):
    return prompts.pool_sizes(_pool(spark, d))


@query
def prompt_select(spark, d):
    p = resample.rank_k(prompts.eligible(_pool(spark, d)), 5, "language", "prompt_id")
    return p.select("prompt_id", "language", "prompt_text", "n_responses")


@query
def sibling_lists(spark, d):
    return _pool(spark, d).select("prompt_id", "n_responses", F.array_join("human_responses", "\n--\n", "<null>").alias("answers"))


@query
def human_explode(spark, d):
    return prompts.human_answers(V.human_prompts(spark, d)).select("language", "prompt_id", F.col("human_idx").cast("long").alias("human_idx"), "text")


@query
def prompt_dedup(spark, d):
    return prompts.first_per_prompt(V.human_prompts(spark, d)).select("prompt_id", "language", "prompt_text", F.size("human_responses").alias("n_listed"), "n_responses")


@query
def think_strip(spark, d):
    return profiles.think_stripped(V.generations(spark, d, "gen_id", "text"))


@query
def gen_profile(spark, d):
    return rounded(profiles.generation_profile(V.generations(spark, d, "model", "text", "finish_reason")))


@query
def empty_dropped(spark, d):
    g = V.generations(spark, d, "model", "text")
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    return g.groupBy("model").agg(F.sum((~blank).cast("long")).alias("kept"), F.sum(blank.cast("long")).alias("dropped"))


def _scores(spark, d):
    return profiles.surrogate_scores(V.generations(spark, d, "gen_id", "model", "language", "text"))


@query
def fluency_summary(spark, d):
    return rounded(profiles.fluency_summary(_scores(spark, d)), 9)


@query
def fluent_cells(spark, d):
    return rounded(profiles.fluency_summary(_scores(spark, d)).where("match_rate >= 0.8 and language is not null"), 9)


def _counts(spark, d):
    return profiles.surrogate_counts(V.generations(spark, d, "language", "text"))


@query
def fertility(spark, d):
    return rounded(profiles.fertility(_counts(spark, d)))


@query
def fertility_pivot(spark, d):
    f = profiles.fertility(_counts(spark, d)).where(F.col("language").isin(*prompts.LANG_ORDER))
    return rounded(f.groupBy("tokenizer").pivot("language", list(prompts.LANG_ORDER)).agg(F.avg("fertility_vs_en")))


@query
def morphology(spark, d):
    # Words of invented names fold differently in no case here; prompts hold every language's script.
    p = prompts.first_per_prompt(V.human_prompts(spark, d)).select("language", F.col("prompt_text").alias("text"))
    return rounded(profiles.morphology(p))


def _jaccard_gap(spark, d, trunc=None):
    return robust.gap_cells(V.llm_jaccard(spark, d, trunc), V.human_jaccard(spark, d, trunc))


@query
def gap_lexical(spark, d):
    return rounded(_jaccard_gap(spark, d))


def _linguistic(spark, d):
    gap = _jaccard_gap(spark, d)
    g = V.generations(spark, d, "model", "language", "text").where("language is not null")
    tok = g.groupBy("model", "language").agg(F.avg(F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4.0)).alias("fertility"))
    flu = profiles.fluency_summary(_scores(spark, d)).where("language is not null").select("model", "language", F.col("match_rate").alias("lid_match_rate"))
    size = g.groupBy("language").agg(F.log10(F.count(F.lit(1))).alias("log_size"))
    mor = profiles.morphology(prompts.first_per_prompt(V.human_prompts(spark, d)).select("language", F.col("prompt_text").alias("text")))
    x = gap.join(tok, ["model", "language"], "left").join(flu, ["model", "language"], "left").join(size, "language", "left").join(mor, "language", "left")
    return materialise(levels.with_family(x, V.models(spark, d).select("model", "family")), "linguistic")  # a row a cell, read by several specifications


_LING = ["llm_intra", "human_intra", "gap", "fertility", "lid_match_rate", "log_size", "ttr", "mean_word_len"]


@query
def linguistic_table(spark, d):
    return rounded(_linguistic(spark, d).select("model", "language", "family", *_LING))


@query
def language_summary(spark, d):
    x = _linguistic(spark, d)
    return rounded(x.groupBy("language").agg(F.avg("gap").alias("gap"), F.avg("fertility").alias("fertility"), F.max("log_size").alias("log_size"), F.max("mean_word_len").alias("mean_word_len")))


@query
def spearman_gap(spark, d):
    return rounded(regress.spearman(_linguistic(spark, d), "gap", "log_size"))


@query
def spearman_matrix(spark, d):
    return rounded(regress.spearman_matrix(_linguistic(spark, d), ["fertility", "lid_match_rate", "log_size"]))


_PREDICTORS = ["fertility", "lid_match_rate", "log_size", "ttr"]


def _by_language(x: DataFrame) -> DataFrame:
    return x.groupBy("language").agg(*(F.avg(c).alias(c) for c in ("gap", "llm_intra", "human_intra", *_PREDICTORS)))


def _predictor_correlations(spark, d):
    x = _linguistic(spark, d)
    cell = regress.correlations(x, _PREDICTORS, ["gap"]).withColumn("level", F.lit("cell"))
    return cell.unionByName(regress.correlations(_by_language(x), _PREDICTORS, ["gap"]).withColumn("level", F.lit("language")))


@query
def predictor_correlations(spark, d):
    return rounded(_predictor_correlations(spark, d).select("level", "predictor", "n", "rho"))


@query
def predictor_correlations_p(spark, d):
    return rounded(_predictor_correlations(spark, d))


@query
def gap_decomposition(spark, d):
    return rounded(regress.correlations(_by_language(_linguistic(spark, d)), _PREDICTORS, ["gap", "llm_intra", "human_intra"], least=2).select("predictor", "outcome", "n", "rho"))


def _placebo(spark, d):
    return regress.ols(_by_language(_linguistic(spark, d)), "human_intra", ["fertility", "lid_match_rate", "log_size"])


@query
def placebo_all(spark, d):
    return rounded(_placebo(spark, d).drop("p"))


@query
def placebo_all_p(spark, d):
    return rounded(_placebo(spark, d))


@query
def linreg_fit(spark, d):
    return rounded(regress.linear_fit(_linguistic(spark, d), "gap", "log_size"))


@query
def zscore(spark, d):
    x = _linguistic(spark, d).dropna(subset=["gap", "fertility"])
    return rounded(x.select("model", "language", regress.zscore("fertility").alias("z_fertility")))


@query
def mixed_model(spark, d):
    return regress.mixed_model(_linguistic(spark, d), "gap", ["fertility", "lid_match_rate", "log_size"], "B")


@query
def mixed_model_fluent(spark, d):
    return regress.mixed_model(_linguistic(spark, d).where("lid_match_rate >= 0.8"), "gap", ["fertility", "lid_match_rate", "log_size"], "C")


@query
def mixed_model_words(spark, d):
    return regress.mixed_model(_linguistic(spark, d), "gap", ["fertility", "lid_match_rate", "log_size", "ttr"], "A")


@query
def mixed_model_raw(spark, d):
    return regress.mixed_model(_linguistic(spark, d), "llm_intra", ["fertility", "lid_match_rate", "log_size"], "D")


@query
def ols_placebo(spark, d):
    x = _linguistic(spark, d).groupBy("language").agg(F.max("human_intra").alias("human_intra"), F.max("log_size").alias("log_size"))
    return rounded(regress.linear_fit(x.withColumn("z", regress.zscore("log_size")), "human_intra", "z"))


@query
def pca_by_language(spark, d):
    return rounded(regress.pca_by_group(V.vector_rows(spark, d), "language", "e"))


@query
def pca_projection(spark, d):
    p = regress.pca_project(V.vector_rows(spark, d), "language", "e")
    return rounded(p.groupBy("language", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2")))


@query
def model_labels(spark, d):
    m = V.models(spark, d)
    return m.select("model", T.slug(F.col("model")).alias("slug"), T.accelerator(F.col("gpus")).alias("gpus"), T.backend_of(F.col("model")).alias("backend"))


@query
def language_labels(spark, d):
    g = V.generations(spark, d, "gen_id", "language")
    return g.groupBy("language").agg(F.max(T.primary_label(F.col("language"))).alias("label"), F.count(F.lit(1)).alias("n"), F.max(prompts.lang_rank(F.coalesce("language", F.lit("")))).cast("long").alias("place"))


@query
def cell_previews(spark, d):
    a = prompts.first_per_prompt(V.human_prompts(spark, d)).select("prompt_id", "prompt_text")
    g = V.generations(spark, d, "gen_id", "prompt_id")
    return vectors.attach_texts(g, a, ["prompt_id"], "prompt_text", 40).groupBy("prompt_id", "preview").agg(F.count(F.lit(1)).alias("n"))


@query
def family_json(spark, d):
    m = _matrix(spark, d).where("resp_a = resp_b").join(V.vector_families(spark), F.col("resp_a") == F.col("model"))
    return robust.summary_json(m.groupBy("family").agg(F.count(F.lit(1)).alias("n_models")), "family")


def _metrics(spark, d):
    i, h, _ = V.cosine(spark, d)
    # Two metric spaces over the same cells: whole vectors, and their first half re-normalised.
    v = V.vector_rows(spark, d).withColumn("e", vectors.normalize(F.slice("e", 1, 32)))
    half = vectors.intra(vectors.cell_sums(v))
    a = robust.gap_cells(i, h).withColumn("metric", F.lit("whole"))
    b = robust.gap_cells(half.where("model <> 'Human'"), half.where("model = 'Human'")).withColumn("metric", F.lit("half"))
    return a.unionByName(b)


@query
def robustness_summary(spark, d):
    return rounded(robust.summary(_metrics(spark, d), "whole"))


@query
def robustness_by_language(spark, d):
    return rounded(robust.by_language(_metrics(spark, d), ["whole", "half"]))


@query
def metric_agreement(spark, d):
    x = _metrics(spark, d)
    a = x.where("metric = 'whole'").select("model", "language", F.col("gap").alias("gap_primary"))
    b = x.where("metric = 'half'").select("model", "language", F.col("gap").alias("gap_other"))
    return rounded(a.join(b, ["model", "language"]).withColumn("agree", F.signum("gap_primary") == F.signum("gap_other")))


@query
def recompute_check(spark, d):
    """The mean similarity of each model pair as stored, against its recomputation from sums by language."""
    i = vectors.inter(V.vector_cells(spark, d))
    stored = materialise(i.groupBy("model_a", "model_b").agg(F.avg("inter_sim").alias("v")), "pair-means")
    again = i.groupBy("model_a", "model_b", "language").agg(F.sum("inter_sim").alias("s"), F.count(F.lit(1)).alias("k"))
    again = again.groupBy("model_a", "model_b").agg((F.sum("s") / F.sum("k")).alias("v"))
    got = robust.max_difference(stored, again, ["model_a", "model_b"], "v")
    return got.select("n", (F.col("max_diff") < 1e-9).alias("same"))


@query
def source_discovery(spark, d):
    """Metric slugs with a human twin, from the names of files written for two metric spaces, one of them without its twin."""
    i, h, x = V.cosine(spark, d)
    at = f"{shared_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    for name, t in (("intra__whole", i), ("human_intra__whole", h), ("inter__whole", x), ("intra__other", i)):
        t.write.parquet(f"{at}/{name}.parquet")
    return io.metric_sources(spark, f"{at}/*/*.parquet")


@query
def effect_order(spark, d):
    i, h, _ = V.cosine(spark, d)
    g = robust.gap_cells(i, h)
    return rounded(g.select("model", "language", "gap", robust.effect_order(g, "language", "gap").alias("place")))


@query
def model_lookup(spark, d):
    g = V.generations(spark, d, "gen_id", "model")
    m = V.models(spark, d)
    j = levels.with_family(g, m.select("model", "family")).join(m.select("model", "display_name"), "model", "left")
    return j.groupBy(F.coalesce("display_name", "model").alias("name"), "family").agg(F.count(F.lit(1)).alias("n"))


@query
def hosted_models(spark, d):
    return io.self_hosted(V.models(spark, d)).select("model", "family", F.split_part("gpus", F.lit(":"), F.lit(1)).alias("gpu"), F.split_part("gpus", F.lit(":"), F.lit(2)).alias("gpu_count"))


@query
def merged_counts(spark, d):
    return io.table(spark, d, "responses", "model", "gen_id").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gen_id").alias("n_records"))


@query
def sample_limit(spark, d):
    g = V.generations(spark, d, "model", "language", "prompt_id", "sample_idx", "text").where("sample_idx < 10")
    return g.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(T.truncate(F.coalesce("text", F.lit("")), 500))).alias("chars"))


@query
def family_pair_counts(spark, d):
    x = levels.inter_families(V.cosine(spark, d)[2], V.vector_families(spark))
    return x.groupBy("family_pair").agg(F.count(F.lit(1)).alias("n"))


@query
def matrix_long(spark, d):
    names = [f"m{i}" for i in range(5)] + ["Human"]
    return rounded(robust.to_long(robust.to_wide(_matrix(spark, d), "resp_a", "resp_b", "sim", names), "resp_a", "resp_b", "sim"))


def queries() -> dict[str, Query]:
    return dict(_ALL)
