"""Agreement of several similarity metrics about the same gap, and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyphony.operators.resample import avg_rank


def gap_cells(intra: DataFrame, human: DataFrame) -> DataFrame:
    """model, language, llm_intra, human_intra, gap: mean per cell minus the language's human mean."""
    a = intra.groupBy("model", "language").agg(F.avg("intra_sim").alias("llm_intra"))
    h = human.groupBy("language").agg(F.avg("intra_sim").alias("human_intra"))
    return a.join(h, "language").select("model", "language", "llm_intra", "human_intra", (F.col("llm_intra") - F.col("human_intra")).alias("gap"))


def summary(cells: DataFrame, primary: str) -> DataFrame:
    """metric, n_cells, llm_intra, human_intra, gap, langs_positive, n_langs, cells_positive, spearman_vs_primary, sign_agree.

    cells: metric, model, language, llm_intra, human_intra, gap.  The last two are NULL for the primary metric."""
    ok = cells.where("gap is not null")
    lang = ok.groupBy("metric", "language").agg(F.avg("gap").alias("g")).groupBy("metric").agg(F.sum((F.col("g") > 0).cast("long")).alias("langs_positive"), F.count(F.lit(1)).alias("n_langs"))
    all_ = ok.groupBy("metric").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("llm_intra").alias("llm_intra"), F.avg("human_intra").alias("human_intra"), F.avg("gap").alias("gap"), F.sum((F.col("gap") > 0).cast("long")).alias("cells_positive"))
    p = ok.where(F.col("metric") == primary).select("model", "language", F.col("gap").alias("g0"))
    j = ok.where(F.col("metric") != primary).join(p, ["model", "language"])
    j = j.withColumn("ra", avg_rank("gap", "metric")).withColumn("rb", avg_rank("g0", "metric"))
    vs = j.groupBy("metric").agg(F.corr("ra", "rb").alias("spearman_vs_primary"), F.avg((F.signum("gap") == F.signum("g0")).cast("double")).alias("sign_agree"))
    return all_.join(lang, "metric").join(vs, "metric", "left")


def by_language(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """language and one column a metric: the mean gap."""
    return cells.groupBy("language").pivot("metric", metrics).agg(F.avg("gap"))


def counts_under(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """comparison, level, k, n_positive, n_p, n_holm, n_bh: tests with a positive gap, and those also under ``alpha``."""
    up = F.col("mean_gap") > 0
    n = lambda c: F.sum((up & F.coalesce(c < alpha, F.lit(False))).cast("long"))
    return tests.groupBy("comparison", "level").agg(F.count(F.lit(1)).alias("k"), F.sum(up.cast("long")).alias("n_positive"), n(F.col(p)).alias("n_p"), n(F.col(f"{p}_holm")).alias("n_holm"), n(F.col(f"{p}_bh")).alias("n_bh"))


def to_wide(long: DataFrame, row: str, col: str, value: str, cols: list[str]) -> DataFrame:
    return long.groupBy(row).pivot(col, cols).agg(F.first(value))


def to_long(wide: DataFrame, row: str, col: str = "name", value: str = "value") -> DataFrame:
    return wide.unpivot([row], [c for c in wide.columns if c != row], col, value)


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, max_diff: rows found on both sides and the largest absolute difference."""
    j = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"))


def effect_order(df: DataFrame, by: str, value: str) -> Column:
    """Rank of a group by its mean, largest first."""
    return F.dense_rank().over(Window.orderBy(F.desc(F.avg(value).over(Window.partitionBy(by)))))


def latex_table(df: DataFrame, caption: str, label: str, digits: int = 3) -> str:
    """A LaTeX table of a small result; more than 10,000 rows are no table and raise."""
    rows = df.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a LaTeX table has at most 10,000 rows")
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%")
    body = [" & ".join(cell(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def summary_json(df: DataFrame, *keys: str) -> DataFrame:
    """key, json: one JSON object a row, NULL values left out."""
    key = F.concat_ws("|", *(F.coalesce(F.col(k), F.lit("")) for k in keys))
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))
