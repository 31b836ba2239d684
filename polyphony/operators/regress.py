"""Correlation, standardisation and regression over small summary tables."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyphony.functions.tails import normal_two_sided, t_two_sided
from polyphony.operators.resample import avg_rank


def spearman(df: DataFrame, x: str, y: str, *by: str, least: int = 4) -> DataFrame:
    """by, n, rho over complete rows; under ``least`` rows no result."""
    ok = df.dropna(subset=[x, y])
    r = ok.withColumn("_x", avg_rank(x, *by)).withColumn("_y", avg_rank(y, *by))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho")).where(F.col("n") >= least)


def spearman_p(rho: pd.Series, n: pd.Series) -> np.ndarray:
    t = rho * np.sqrt((n - 2) / np.maximum(1 - rho**2, 1e-300))
    return t_two_sided(t.to_numpy(float), (n - 2).to_numpy(float))


def spearman_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """var_a, var_b, rho, pairwise complete, for var_a <= var_b in the given order."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations_with_replacement(cols, 2))))
    return spearman(df.select(pairs.alias("z")).select("z.*"), "x", "y", "var_a", "var_b", least=2).drop("n")


def zscore(c: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)


def linear_fit(df: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """by, slope, intercept, r."""
    ok = df.dropna(subset=[x, y])
    return ok.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, n, coef, se, t, p of y on the z-scored predictors, with an intercept, over complete rows.

    One aggregation to moments, whatever the number of rows; no row comes out where there are no degrees of freedom
    or the predictors are dependent."""
    cols = [y, *xs]
    ok = df.dropna(subset=cols).select(*(F.col(c).cast("double").alias(c) for c in cols))
    agg = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), *(F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)]

    def solve(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                n, k = int(r.n), len(xs)
                c = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
                if n - k - 1 < 1 or not np.isfinite(c).all() or (np.diag(c)[1:] <= 0).any():
                    continue
                sd = np.sqrt(np.diag(c)[1:])
                corr, by = c[1:, 1:] / np.outer(sd, sd), c[1:, 0] / sd
                if np.linalg.cond(corr) > 1e12:
                    continue
                inv = np.linalg.inv(corr)
                b = inv @ by
                s2 = max((n - 1) * (c[0, 0] - by @ b), 0.0) / (n - k - 1)
                coef, se = np.r_[r.m, b], np.sqrt(s2 * np.r_[1 / n, np.diag(inv) / (n - 1)])
                t = np.divide(coef, se, out=np.full(k + 1, np.nan), where=se > 0)
                p = t_two_sided(t, np.full(k + 1, float(n - k - 1)))
                yield pd.DataFrame({"term": ["intercept", *xs], "n": n, "coef": coef, "se": se, "t": t, "p": p})

    return ok.agg(*agg).mapInPandas(solve, "term string, n long, coef double, se double, t double, p double")


def correlations(df: DataFrame, xs: list[str], ys: list[str], least: int = 4) -> DataFrame:
    """predictor, outcome, n, rho, p: rank correlation of each predictor with each outcome over pairwise complete rows, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("predictor"), F.lit(b).alias("outcome"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in xs for b in ys)))
    long = df.select(pairs.alias("z")).select("z.*")
    rho = spearman(long, "x", "y", "predictor", "outcome", least=least)

    def tail(batches):
        for pdf in batches:
            yield pdf.assign(p=spearman_p(pdf.rho, pdf.n))

    return rho.mapInPandas(tail, "predictor string, outcome string, n long, rho double, p double")


def _profile(theta, y, x, groups, reml=True):
    """-2 log restricted likelihood at variance ratios theta, with the fixed part and scale profiled out."""
    v = np.eye(len(y))
    for t, z in zip(theta, groups, strict=True):
        v += t * (z @ z.T)
    low = np.linalg.cholesky(v)
    xs, ys = np.linalg.solve(low, x), np.linalg.solve(low, y)
    xtx = xs.T @ xs
    beta = np.linalg.solve(xtx, xs.T @ ys)
    r = ys - xs @ beta
    df = len(y) - x.shape[1]
    s2 = float(r @ r) / df
    return df * np.log(s2) + 2 * np.log(np.diag(low)).sum() + np.linalg.slogdet(xtx)[1], beta, s2 * np.linalg.inv(xtx), s2


def fit_crossed(y: np.ndarray, x: np.ndarray, *factors: np.ndarray) -> dict:
    """REML of y = x b + one random intercept a factor (crossed) + noise, by golden-section sweeps over the log ratios."""
    groups = [(f[:, None] == np.unique(f)[None, :]).astype(float) for f in factors]
    theta = np.full(len(groups), 0.5)
    value = _profile(theta, y, x, groups)[0]
    for _ in range(60):
        before = value
        for k in range(len(groups)):
            lo, hi = -16.0, 8.0

            def at(u, k=k):
                t = theta.copy()
                t[k] = np.exp(u)
                return _profile(t, y, x, groups)[0]

            g = (np.sqrt(5) - 1) / 2
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            fa, fb = at(a), at(b)
            while hi - lo > 1e-7:
                if fa < fb:
                    hi, b, fb = b, a, fa
                    a = hi - g * (hi - lo)
                    fa = at(a)
                else:
                    lo, a, fa = a, b, fb
                    b = lo + g * (hi - lo)
                    fb = at(b)
            theta[k] = np.exp((lo + hi) / 2)
        value = _profile(theta, y, x, groups)[0]
        if abs(before - value) < 1e-9:
            break
    _, beta, cov, s2 = _profile(theta, y, x, groups)
    return {"beta": beta, "se": np.sqrt(np.diag(cov)), "theta": theta, "sigma2": s2}


def mixed_model(cells: DataFrame, y: str, predictors: list[str], spec: str) -> DataFrame:
    """spec, term, n, coef, ci_lo, ci_hi, p: crossed random intercepts of model and language, z-scored predictors.

    The cells are models x languages, a few thousand at most; complete cases only; under p + 3 cells no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna()
        cols = ["spec", "term", "n", "coef", "ci_lo", "ci_hi", "p"]
        z = d[predictors].astype(float)
        sd = z.std(ddof=1)
        use = [c for c in predictors if sd[c] > 0]
        if len(d) < len(use) + 4 or d.model.nunique() < 2 or d.language.nunique() < 2:
            return pd.DataFrame({c: pd.Series([], dtype=object if c in ("spec", "term") else "int64" if c == "n" else float) for c in cols})
        z = (z[use] - z[use].mean()) / sd[use]
        x = np.column_stack([np.ones(len(d)), z.to_numpy()])
        r = fit_crossed(d[y].to_numpy(float), x, d.model.to_numpy(), d.language.to_numpy())
        b, se = r["beta"], r["se"]
        return pd.DataFrame({"spec": spec, "term": ["intercept", *use], "n": len(d), "coef": b, "ci_lo": b - 1.959963985 * se, "ci_hi": b + 1.959963985 * se, "p": normal_two_sided(b / se)})[cols]

    rows = cells.select("model", "language", y, *predictors).withColumn("_one", F.lit(1))
    return rows.groupBy("_one").applyInPandas(lambda pdf: run(pdf.drop(columns="_one")), "spec string, term string, n long, coef double, ci_lo double, ci_hi double, p double")


def _group_moments(vectors: DataFrame, by: str, e: str) -> DataFrame:
    """by, n, s, q: count, sum and cross products of each partition's rows of a group."""

    def part(batches):
        sums: dict[str, list] = {}
        for pdf in batches:
            for g, sub in pdf.groupby(by):
                m = np.stack([np.asarray(v, float) for v in sub[e]])
                n, s, q = sums.get(g, (0, 0.0, 0.0))
                sums[g] = (n + len(m), s + m.sum(0), q + m.T @ m)
        for g, (n, s, q) in sums.items():
            yield pd.DataFrame({by: [g], "n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    rows = vectors.dropna(subset=[by, e]).select(by, F.col(e).cast("array<double>").alias(e))
    return rows.mapInPandas(part, f"{by} string, n long, s array<double>, q array<double>")


def _axes(pdf: pd.DataFrame, k: int):
    n = pdf.n.sum()
    s, q = np.sum(np.stack(pdf.s.tolist()), 0), np.sum(np.stack(pdf.q.tolist()), 0)
    d = len(s)
    w, v = np.linalg.eigh((q.reshape(d, d) - np.outer(s, s) / n) / max(n - 1, 1))
    w, v = np.clip(w[::-1], 0, None), v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])  # the largest loading of an axis is positive
    return s / n, w, v


def pca_by_group(vectors: DataFrame, by: str, e: str, k: int = 2) -> DataFrame:
    """by, pc, explained: explained variance ratio of the leading components of each group.

    Only the group's moments travel: one sum and one cross-product matrix a partition and group."""

    def ratios(pdf: pd.DataFrame) -> pd.DataFrame:
        _, w, _ = _axes(pdf, k)
        return pd.DataFrame({by: pdf[by].iloc[0], "pc": np.arange(1, k + 1), "explained": w[:k] / w.sum() if w.sum() > 0 else np.nan})

    return _group_moments(vectors, by, e).groupBy(by).applyInPandas(ratios, f"{by} string, pc int, explained double")


def pca_project(vectors: DataFrame, by: str, e: str) -> DataFrame:
    """``vectors`` with pc1 and pc2: coordinates on the group's two leading axes, centred on its mean."""

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        m, _, v = _axes(pdf, 2)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "_m": [m.tolist()], "_a": [v[:, 0].tolist()], "_b": [v[:, 1].tolist()]})

    a = _group_moments(vectors, by, e).groupBy(by).applyInPandas(axes, f"{by} string, _m array<double>, _a array<double>, _b array<double>")
    centred = F.zip_with(F.col(e).cast("array<double>"), "_m", lambda x, y: x - y)
    on = lambda axis: F.aggregate(F.zip_with(centred, axis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return vectors.join(a, by).withColumn("pc1", on("_a")).withColumn("pc2", on("_b")).drop("_m", "_a", "_b")
