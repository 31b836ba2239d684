import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyphony.functions import tails
from polyphony.functions import text as T
from polyphony.operators import levels, lexical, profiles, prompts, regress, resample, robust, vectors

VEC = "model string, language string, prompt_id string, e array<float>, n int"


def cell(spark, vs, model="m"):
    return spark.createDataFrame([(model, "L", "p", v, 0) for v in vs], VEC)


def intra_of(spark, vs):
    return vectors.intra(vectors.cell_sums(cell(spark, vs))).first()


@pytest.mark.parametrize("vs,want", [([[1.0, 0.0]], None), ([[0.6, 0.8]] * 2, 1.0), ([[1.0, 0.0], [-1.0, 0.0]], -1.0), ([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]], 0.0)])
def test_intra_small(spark, vs, want):
    r = intra_of(spark, [[float(x) for x in v] for v in vs])
    assert (r.intra_sim is None) if want is None else r.intra_sim == pytest.approx(want, abs=1e-6)
    assert r.n_samples == len(vs)


def test_closed_forms_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(11, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = v[:6], v[6:]
    df = cell(spark, a.tolist(), "a").union(cell(spark, b.tolist(), "b"))
    c = vectors.cell_sums(df)
    got = {r.model: r.intra_sim for r in vectors.intra(c).collect()}
    for name, x in (("a", a), ("b", b)):
        assert got[name] == pytest.approx(np.mean([x[i] @ x[j] for i, j in itertools.combinations(range(len(x)), 2)]), abs=1e-6)
    assert vectors.inter(c).first().inter_sim == pytest.approx((a @ b.T).mean(), abs=1e-6)


def test_vectors_with_nulls(spark):
    df = spark.createDataFrame([("m", "L", "p", [1.0, None], 0), ("m", "L", "p", None, 0), (None, "L", "p", [1.0, 0.0], 0), ("m", "L", "p", [1.0, 0.0], 0)], VEC)
    r = vectors.intra(vectors.cell_sums(df)).collect()
    assert len(r) == 1 and r[0].n_samples == 2 and r[0].intra_sim == pytest.approx(1.0)
    assert vectors.cell_sums(df.limit(0)).count() == 0
    z = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "e array<double>").select(vectors.normalize(F.col("e")).alias("e")).collect()
    assert [list(x.e) for x in z] == [[0.0, 0.0], [0.6, 0.8]]


TEXT = "model string, language string, prompt_id string, text string, sample_idx int, r string"


def grams(t, n=4):
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def jac(a, b):
    a, b = grams(a or ""), grams(b or "")
    return len(a & b) / len(a | b) if a | b else None


def mean(v):
    v = [x for x in v if x is not None]
    return sum(v) / len(v) if v else None


@pytest.mark.parametrize("tile,key", [(3, None), (256, None), (3, "sample_idx")])
def test_jaccard_equals_all_pairs(spark, tile, key, monkeypatch):
    monkeypatch.setattr(lexical.pair_sums, "__defaults__", (*lexical.pair_sums.__defaults__[:-1], tile))
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "🙂🙂x", "日本語です", "delta"]
    rows = [(m, "en", p, rng.choice([None, "", "abc", *[" ".join(rng.choices(words, k=5)) for _ in range(6)]]), i, "x") for m in "abc" for p in "pq" for i in range(9)]
    df = spark.createDataFrame(rows + [(None, "en", "p", "zzzz", 1, "x"), ("a", None, "p", "zzzz", 1, "x")], TEXT)
    got = {(r.model, r.prompt_id): r for r in lexical.intra_jaccard(df, key=key).collect()}
    assert len(got) == 6
    for (m, p), r in got.items():
        t = [x[3] for x in rows if x[0] == m and x[2] == p]
        want = mean(jac(a, b) for a, b in itertools.combinations(t, 2))
        assert r.n_samples == 9 and (r.intra_sim == pytest.approx(want) if want is not None else r.intra_sim is None)
    for r in lexical.inter_jaccard(df, k=4, key=key).collect():
        a = [x[3] for x in rows if x[0] == r.model_a and x[2] == r.prompt_id and x[4] < 4]
        b = [x[3] for x in rows if x[0] == r.model_b and x[2] == r.prompt_id and x[4] < 4]
        assert r.model_a < r.model_b and r.inter_sim == pytest.approx(mean(jac(x, y) for x in a for y in b))


def test_jaccard_edges(spark):
    def of(*ts):
        return lexical.intra_jaccard(spark.createDataFrame([("m", "en", "p", t, i, "x") for i, t in enumerate(ts)], TEXT)).first().intra_sim

    assert of("abc", "ab") is None and of("abcd", "") == 0 and of("abcd", "abcd") == 1 and of("abcd") is None
    assert lexical.intra_jaccard(spark.createDataFrame([], TEXT)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30), st.text(max_size=30))
def test_gram_hashes_are_sets(a, b):
    x, y = lexical._grams(a, 4), lexical._grams(b, 4)
    assert len(x) == len(grams(a)) and len(np.intersect1d(x, y)) == len(grams(a) & grams(b))


def one(spark, value, f, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("abcdabcd", 4), ("abc", 0), ("", 0), (None, 0), ("日本語です", 2), ("🙂🙂🙂🙂", 1)])
def test_ngrams(spark, text, want):
    assert len(one(spark, text, T.ngrams)) == want


@pytest.mark.parametrize("text,want", [("a<think>x\ny</think>b", "ab"), ("<THINK>x", ""), (" a ", "a"), (" 　a ", "a"), ("", ""), (None, None)])
def test_think(spark, text, want):
    assert one(spark, text, T.strip_think) == want


@pytest.mark.parametrize("label,want", [("EN_gb", "en"), ("pt", "pt-BR"), ("und", None), (None, None), ("", None), ("zh-Hans", "zh")])
def test_base_language(spark, label, want):
    assert one(spark, label, T.base_language) == want


def test_words_and_labels(spark):
    assert one(spark, "Don't — STOP, now!  ", T.words) == ["dont", "stop", "now"]
    assert one(spark, "a/b", lambda c: T.slug(c, 500, 10)) == "a_b_trunc500_s10"
    assert one(spark, "Z", lambda c: T.pair_label(c, F.lit("A"))) == "A || Z"
    assert one(spark, "claude-x", T.backend_of) == "anthropic" and one(spark, "o3-mini", T.backend_of) == "openai" and one(spark, "o1x", T.backend_of) == "vllm"
    assert [one(spark, p, T.stars, "double") for p in (0.0005, 0.005, 0.04, 0.2)] == ["***", "**", "*", ""]


def test_label_functions(spark):
    df = spark.createDataFrame([("ja", "und_Hira", "fp8", "x", "A100fat:4"), ("zz", None, None, "bfloat16", None), (None, "eng_Latn", None, None, "H:1")], "l string, p string, q string, d string, g string")
    r = df.select(T.label_matches(F.col("l"), F.col("p")).alias("m"), T.primary_label(F.col("l")).alias("n"), T.precision(F.col("q"), F.col("d")).alias("d"), T.accelerator(F.col("g")).alias("g")).collect()
    assert [tuple(x) for x in r] == [(True, "jpn_Jpan", "FP8", "4 x A100 80 GB"), (False, None, "bf16", None), (False, None, "---", "1 x H")]
    c = spark.createDataFrame([([("2026-03-01T1", "cccccccccc"), ("2026-01-05T1", "aaaaaaaaaa")],), ([],), (None,)], "c array<struct<date:string,sha:string>>")
    assert [x.r for x in c.select(T.revision_before(F.col("c"), "2026-02-01").alias("r")).collect()] == ["aaaaaaaa", "---", "gated"]
    assert one(spark, "one two three  four", lambda c: T.preview(c, 400, 8)) == "one two<br>three<br>four"
    assert one(spark, None, T.preview) == ""


def test_attach_and_json(spark):
    v = spark.createDataFrame([("p", 1), ("q", 2)], "k string, x int")
    t = spark.createDataFrame([("p", "long text", 9), ("p", "long text", 9)], "k string, text string, x int")
    assert [tuple(r) for r in vectors.attach_texts(v, t, ["k"], chars=4).orderBy("k").collect()] == [("p", 1, "long"), ("q", 2, "")]
    assert robust.summary_json(v, "k").orderBy("key").first().json == '{"k":"p","x":1}'


def test_tails():
    u = np.linspace(0, 1, 2_000_001)[1:-1]  # F = (d2 / d1) u / (1 - u) with u of a beta distribution
    d = u ** (3 / 2 - 1) * (1 - u) ** (10 / 2 - 1)
    assert tails.f_tail(np.array([4.0]), 3.0, 10.0)[0] == pytest.approx(d[u >= 12 / 22].sum() / d.sum(), abs=1e-5)
    assert tails.t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880, abs=1e-6)
    assert tails.t_two_sided(np.array([2.0]), 10.0)[0] == pytest.approx(tails.f_tail(np.array([4.0]), 1.0, 10.0)[0])
    assert tails.normal_two_sided([1.959963985])[0] == pytest.approx(0.05)
    assert tails.wilcoxon_p(0, 5) == pytest.approx(2 / 32) and tails.wilcoxon_p(0, 0) == 1
    n = 8
    sums = [sum(r for r, k in zip(range(1, n + 1), s) if k) for s in itertools.product((0, 1), repeat=n)]
    for w in (3, 10, 18, 30):
        want = min(1, 2 * min(sum(x <= w for x in sums), sum(x >= w for x in sums)) / len(sums))
        assert tails.wilcoxon_p(w, n) == pytest.approx(want)


PAIRED = "level string, grp string, lang string, language string, prompt_id string, llm double, human double, gap double"


def paired(spark, gaps, level="general"):
    return spark.createDataFrame([(level, "all", None, f"l{i % 3}", f"p{i}", None if g is None else g + 1.0, 1.0, g) for i, g in enumerate(gaps)], PAIRED)


def test_paired_tests(spark):
    g = [0.1, -0.2, 0.3, 0.3, 0.0, None, 0.5]
    p = paired(spark, g)
    v = [x for x in g if x is not None]
    t = resample.paired_t(p, p=True).first()
    assert t.n == 6 and t.t == pytest.approx(np.mean(v) / (np.std(v, ddof=1) / math.sqrt(6)))
    w = resample.wilcoxon(p, p=True).first()
    assert w.n_nonzero == 5 and w.w_plus == pytest.approx(1 + 3.5 + 3.5 + 5)
    b = resample.bootstrap_ci(p, b=100).first()
    assert b.n == 6 and b.ci_lo <= b.mean_gap <= b.ci_hi
    assert 1 / 101 <= resample.signflip(p, b=100).first().p_perm <= 1
    c = resample.cluster_bootstrap(p, b=100).first()
    assert min(v) <= c.cluster_ci_lo <= c.cluster_ci_hi <= max(v)


def test_draws_of_the_reference(spark):
    g = [0.1, -0.2, 0.3, 0.3, 0.25, 0.15, 0.5, 0.2]
    p = paired(spark, g)
    flips = [abs(np.mean([v if resampled("s", k, i) % 2 == 0 else -v for i, v in enumerate(by_place(g))])) for k in range(20_000)]
    want = (sum(m >= abs(np.mean(g)) - 1e-12 for m in flips) + 1) / 20_001
    assert resample.signflip(p).first().p_perm == pytest.approx(want, abs=1e-12)
    assert resample.signflip(paired(spark, [0.1 + i / 100 for i in range(30)])).first().p_perm == pytest.approx(1 / 20_001)
    means = [np.mean([by_place(g)[resampled("b", k, i) % len(g)] for i in range(len(g))]) for k in range(10_000)]
    b = resample.bootstrap_ci(p).first()
    assert (b.ci_lo, b.ci_hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    c = [resample.cluster_bootstrap(p, b=k).first() for k in (200, 10_000)]
    assert resample.cluster_bootstrap(p).first() == c[1] != c[0]


def by_place(g):
    return [v for _, v in sorted((f"l{i % 3}p{i}", v) for i, v in enumerate(g))]


def resampled(kind, k, i):
    return int(hashlib.md5(f"0|{kind}|general|all||{k}|{i}".encode()).hexdigest()[:8], 16)


def test_paired_tests_degenerate(spark):
    assert resample.paired_t(paired(spark, [0.0] * 4), p=True).first().p_t == 1
    assert resample.signflip(paired(spark, [0.0] * 4), b=50).first().p_perm == 1
    r = resample.bootstrap_ci(paired(spark, [0.3]), b=50).first()
    assert (r.n, r.mean_gap, r.ci_lo) == (1, None, None)
    assert resample.bootstrap_ci(paired(spark, []).limit(0), b=50).count() == 0
    s = levels.side_stats(paired(spark, [0.3])).first()
    assert s.n == 1 and s.mean_llm is None


@pytest.mark.parametrize("ps,holm,bh", [([0.01, 0.02, 0.03, None], [0.03, 0.04, 0.04, None], [0.03, 0.03, 0.03, None]), ([0.04, 0.04], [0.08, 0.08], [0.04, 0.04])])
def test_adjust(spark, ps, holm, bh):
    df = spark.createDataFrame([(i, "c", p) for i, p in enumerate(ps)], "i int, c string, p double")
    r = sorted(resample.adjust(df, "p", "c").collect())
    eq = lambda a, b: (a is None) == (b is None) and (a is None or a == pytest.approx(b))
    assert all(eq(x.p_holm, h) and eq(x.p_bh, b) for x, h, b in zip(r, holm, bh, strict=True))


def test_f_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [(m, "en", f"p{i}", float(rng.normal())) for m in "ab" for i in range(8)]
    intra = spark.createDataFrame(rows, "model string, language string, prompt_id string, intra_sim double")
    human = spark.createDataFrame([("Human", "en", f"p{i}", float(rng.normal())) for i in range(7)] + [("Human", "xx", "q", None)], intra.schema)
    fam = spark.createDataFrame([("a", "F")], "model string, family string")
    r = {(x.level, x.grp): x for x in levels.f_intra_levels(intra, human, fam, p=True).collect()}
    assert set(r) == {("general", "all"), ("family", "F"), ("family", "Other"), ("model", "a"), ("model", "b"), ("language", "en"), ("family_language", "F"), ("family_language", "Other"), ("model_language", "a"), ("model_language", "b")}
    x, y = np.array([v for m, _, _, v in rows if m == "a"]), np.array([h.intra_sim for h in human.collect() if h.intra_sim is not None])
    sp = ((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / (len(x) + len(y) - 2)
    t = (x.mean() - y.mean()) / math.sqrt(sp * (1 / len(x) + 1 / len(y)))
    a = r["model", "a"]
    assert a.f_means == pytest.approx(t * t) and a.p_means == pytest.approx(tails.t_two_sided(np.array([t]), len(x) + len(y) - 2.0)[0])
    assert 0 <= a.p_var <= 1
    flat = levels.f_intra_levels(intra.withColumn("intra_sim", F.lit(1.0)), human, fam).where("level = 'model'").first()
    assert flat.f_var is None


def test_ranks_and_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0), (2.0, 4.0), (None, 9.0), (5.0, 2.0)], "x double, y double")
    r = sorted(x.r for x in df.where("x is not null").select(resample.avg_rank("x").alias("r")).collect())
    assert r == [1.5, 1.5, 3.0, 4.0]
    s = regress.spearman(df, "x", "y").first()
    assert s.n == 4 and s.rho == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 3, 4, 2])[0, 1])
    assert regress.spearman(df.limit(2), "x", "y").count() == 0
    f = regress.linear_fit(df, "y", "x").first()
    assert f.slope == pytest.approx(np.polyfit([1, 1, 2, 5], [1, 3, 4, 2], 1)[0])


def test_mixed_model_recovers_balanced_anova():
    """In a balanced one-way layout REML has the closed form of the mean squares."""
    rng = np.random.default_rng(3)
    g, k = 12, 6
    f = np.repeat(np.arange(g), k)
    y = 2 + rng.normal(size=g)[f] + rng.normal(size=g * k) * 0.7
    r = regress.fit_crossed(y, np.ones((g * k, 1)), f)
    m = y.reshape(g, k).mean(1)
    within = ((y.reshape(g, k) - m[:, None]) ** 2).sum() / (g * (k - 1))
    between = k * m.var(ddof=1)
    assert r["sigma2"] == pytest.approx(within, rel=1e-4)
    assert r["theta"][0] * r["sigma2"] == pytest.approx((between - within) / k, rel=1e-3)
    assert r["beta"][0] == pytest.approx(y.mean()) and r["se"][0] == pytest.approx(math.sqrt(between / (g * k)), rel=1e-4)


def test_mixed_model_frame(spark):
    rng = np.random.default_rng(0)
    rows = [(f"m{i}", f"l{j}", float(0.5 * (x := rng.normal()) + 0.1 * i + rng.normal() * 0.1), float(x)) for i in range(6) for j in range(5)]
    df = spark.createDataFrame(rows + [("m0", "l9", None, 1.0)], "model string, language string, gap double, x double")
    r = {t.term: t for t in regress.mixed_model(df, "gap", ["x"], "A").collect()}
    assert r["x"].n == 30 and r["x"].p < 1e-6
    assert abs(r["x"].coef - 0.5 * np.std([t[3] for t in rows], ddof=1)) < 2 * (r["x"].ci_hi - r["x"].ci_lo) / 2
    assert regress.mixed_model(df.limit(2), "gap", ["x"], "A").count() == 0


def test_pca(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 6)) * np.array([5, 3, 1, 1, 1, 1]) + 10
    df = spark.createDataFrame([("g", x.tolist()) for x in m], "g string, e array<double>")
    got = [r.explained for r in regress.pca_by_group(df, "g", "e").orderBy("pc").collect()]
    w = np.linalg.eigvalsh(np.cov(m.T))[::-1]
    assert got == pytest.approx((w[:2] / w.sum()).tolist())
    p = regress.pca_project(df, "g", "e").toPandas()
    x = m - m.mean(0)
    v = np.linalg.eigh(np.cov(m.T))[1][:, ::-1]
    for k, c in ((0, "pc1"), (1, "pc2")):
        assert np.abs(np.corrcoef(x @ v[:, k], p[c][: len(m)])[0, 1]) == pytest.approx(1) and p[c].mean() == pytest.approx(0, abs=1e-9)


MSG = "message_id string, parent_id string, role string, lang string, text string, deleted boolean, review_result boolean"


def test_prompt_pool(spark):
    rows = [("r1", None, "prompter", "en", "Q", False, True), ("r1", None, "prompter", "en", "Q", False, True), ("a1", "r1", "assistant", "en", "A", False, True), ("a2", "r1", "assistant", "en", None, False, True), ("a3", "r1", "assistant", "en", "C", True, True), ("a4", "r1", "assistant", "en", "D", False, None), ("r2", None, "prompter", "de", "F", False, True), ("a5", "gone", "assistant", "en", "E", False, True)]
    pool = prompts.prompt_pool(spark.createDataFrame(rows, MSG))
    r = {x.prompt_id: x for x in pool.collect()}
    assert r["r1"].n_responses == 2 and r["r1"].human_responses == ["A", None] and r["r2"].n_responses == 0 and r["r2"].human_responses is None
    assert [tuple(x) for x in prompts.pool_sizes(pool, 2).collect()] == [("en", 1, True)]
    assert prompts.select_prompts(pool, 1, 2).count() == 1
    with pytest.raises(ValueError, match="fewer than 2"):
        prompts.select_prompts(pool, 2, 2)
    assert prompts.prompt_pool(spark.createDataFrame([], MSG)).count() == 0


def test_human_answers_keep_null_lists(spark):
    p = spark.createDataFrame([("p", "en", ["a", None], 2), ("p", "en", ["a", None], 2), ("q", None, None, None), (None, "en", ["x"], 1)], "prompt_id string, language string, human_responses array<string>, n_responses int")
    assert sorted(map(tuple, prompts.human_answers(p).collect()), key=str) == sorted([("en", "p", 0, "a"), ("en", "p", 1, None), (None, "q", None, None)], key=str)


def test_profiles(spark):
    g = spark.createDataFrame([(1, "m", "en", "<think>a</think>b", "length"), (2, "m", None, None, None), (3, "m", "en", " ", "stop"), (4, None, "en", "<think>x", "stop")], "gen_id long, model string, language string, text string, finish_reason string")
    r = {x.model: x for x in profiles.generation_profile(g).collect()}
    assert r["m"].n_empty == 2 and r["m"].trunc_pct == pytest.approx(100 / 3) and r[None].dangling_think == 1
    assert {x.language for x in profiles.fluency_summary(profiles.surrogate_scores(g)).collect()} == {"en", None}
    f = {(x.tokenizer, x.language): x for x in profiles.fertility(profiles.surrogate_counts(g)).collect()}
    assert f["tok2", "en"].fertility_vs_en == 1
    m = profiles.morphology(spark.createDataFrame([("en", "A cat, a dog."), ("zh", "你好"), (None, "x"), ("de", None)], "language string, text string"))
    assert {x.language: x.ttr for x in m.collect()} == {"en": 0.75, "zh": None}


def test_robustness(spark):
    c = spark.createDataFrame([(k, m, lang, 0.0, 0.0, g) for k, s in (("a", 1), ("b", -1)) for m, lang, g in (("x", "en", 0.1 * s), ("y", "en", 0.2 * s), ("x", "de", -0.3 * s), ("y", "de", None))], "metric string, model string, language string, llm_intra double, human_intra double, gap double")
    r = {x.metric: x for x in robust.summary(c, "a").collect()}
    assert r["a"].spearman_vs_primary is None and r["b"].spearman_vs_primary == pytest.approx(-1) and r["b"].sign_agree == 0
    assert (r["a"].n_cells, r["a"].cells_positive, r["a"].langs_positive, r["a"].n_langs) == (3, 2, 1, 2)
    wide = robust.by_language(c, ["a", "b"])
    assert wide.columns == ["language", "a", "b"] and robust.to_long(wide, "language").count() == 4
    tex = robust.latex_table(wide.orderBy("language"), "A caption", "tab:x")
    assert r"\begin{tabular}{lll}" in tex and "-0.300" in tex


def test_family_matrix_single_member(spark):
    m = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 0.9), ("c", "c", 0.8), ("a", "b", 0.5), ("b", "a", 0.5), ("a", "c", 0.1), ("c", "a", 0.1), ("b", "c", 0.3), ("c", "b", 0.3)], "resp_a string, resp_b string, sim double")
    f = spark.createDataFrame([("a", "F"), ("b", "F"), ("c", "G")], "model string, family string")
    got = {(r.family_a, r.family_b): r.sim for r in vectors.family_matrix(m, f).collect()}
    assert got["F", "F"] == 0.5 and got["G", "G"] == 0.8 and got["F", "G"] == pytest.approx(0.2)


def test_max_difference(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.5), ("y", 2.0), ("q", 9.0)], "k string, v double")
    r = robust.max_difference(a, b, ["k"], "v").first()
    assert (r.n, r.max_diff) == (2, 0.5)
    assert robust.max_difference(a, b.limit(0), ["k"], "v").first().n == 0


def test_ols_against_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2)) * [3, 0.1] + [5, -1]
    y = 2 + x @ [0.4, -3] + rng.normal(size=30) * 0.3
    rows = [(float(a), float(b), float(c), "k") for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 2.0, "k")]
    got = {r.term: r for r in regress.ols(spark.createDataFrame(rows, "a double, b double, y double, n string"), "y", ["a", "b"]).collect()}
    z = np.c_[np.ones(30), (x - x.mean(0)) / x.std(0, ddof=1)]
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    s2 = ((y - z @ beta) ** 2).sum() / 27
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * s2)
    for i, t in enumerate(("intercept", "a", "b")):
        assert got[t].n == 30 and got[t].coef == pytest.approx(beta[i]) and got[t].se == pytest.approx(se[i]) and 0 <= got[t].p <= 1
    one = spark.createDataFrame(rows[:3] + rows[:3], "a double, b double, y double, n string")
    assert regress.ols(one.limit(0), "y", ["a"]).count() == 0 and regress.ols(one.limit(2), "y", ["a"]).count() == 0
    assert regress.ols(one.select("y", "a", (one.a * 2).alias("b")), "y", ["a", "b"]).count() == 0


def test_rank_correlations_with_p(spark):
    rows = [(float(i), float((i * 7) % 10), float(-i), None if i == 3 else float(i * i)) for i in range(10)]
    got = {(r.predictor, r.outcome): r for r in regress.correlations(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b"], ["c", "d"]).collect()}
    assert got["a", "c"].rho == pytest.approx(-1) and got["a", "c"].p == pytest.approx(0, abs=1e-9) and got["a", "d"].n == 9 and got["a", "d"].rho == pytest.approx(1)
    rho, n = got["b", "c"].rho, 10
    t = rho * math.sqrt((n - 2) / (1 - rho * rho))
    grid = np.linspace(-abs(t), abs(t), 200_001)
    density = math.gamma(4.5) / (math.sqrt(8 * math.pi) * math.gamma(4)) * (1 + grid**2 / 8) ** -4.5
    assert got["b", "c"].p == pytest.approx(1 - np.trapezoid(density, grid), abs=1e-6)


def test_cell_sums_over_batches_and_lengths(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [("m%d" % (i % 2), "l", "p%d" % (i % 3), [1.0 * i, None if i == 4 else 2.0] + ([5.0] if i == 6 else [])) for i in range(40)]
    schema = "model string, language string, prompt_id string, e array<double>"
    got = {(r.model, r.prompt_id): (r.n, list(r.s)) for r in vectors.cell_sums(spark.createDataFrame([*rows, ("m0", None, "p0", [1.0]), ("m0", "l", "p0", None)], schema)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for m, _, p, e in rows:
        n, s = want.get((m, p), (0, [0.0, 0.0]))
        s = s + [0.0] * (len(e) - len(s))
        want[m, p] = (n + 1, [a + (e[j] or 0 if j < len(e) else 0) for j, a in enumerate(s)])
    assert got == want


def test_latex_of_too_many_rows_raises(spark):
    with pytest.raises(ValueError):
        robust.latex_table(spark.range(10_001), "c", "l")


def test_first_delivery_wins(spark, tmp_path):
    from polyphony.plans import views

    rows = [(1, "m", "d", "en", "p", 0, "later", 1, "stop", "2024-01-02"), (1, "m", "d", "en", "p", 0, "first", 1, "stop", "2024-01-01"), (2, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "gen_id long, model string, dataset string, language string, prompt_id string, sample_idx int, response_text string, n_tokens int, finish_reason string, at string")
    df.selectExpr("*", "cast(at as timestamp) as ingested_at").drop("at").write.parquet(f"{tmp_path}/responses.parquet")
    assert {(r.gen_id, r.text) for r in views.generations(spark, str(tmp_path)).collect()} == {(1, "first"), (2, None)}
