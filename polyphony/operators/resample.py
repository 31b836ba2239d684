"""Resampling and paired tests with an order-free generator: every draw is a hash of what it belongs to,
so results depend neither on partitioning nor on the order of groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyphony.functions.tails import t_sf2, wilcoxon_sf2

GROUP = ["level", "grp", "lang"]


def _numbered(paired: DataFrame) -> DataFrame:
    """Complete gaps with their position i and number n in each group; ``g`` is the group's text key."""
    x = paired.where("gap is not null").withColumn("g", F.concat_ws("|", "level", "grp", F.coalesce("lang", F.lit(""))))
    w = Window.partitionBy("g")
    return x.withColumn("i", F.row_number().over(w.orderBy("language", "prompt_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))


BLOCK = 100_000


def _blocks(groups: DataFrame, b: int) -> DataFrame:
    """Each row (``g``, ``size``: draws a try takes, ...) once for every run of tries lo to hi, about BLOCK draws each."""
    step = F.greatest(F.lit(1), F.floor(F.lit(float(BLOCK)) / F.greatest(F.lit(1), "size"))).cast("int")
    x = groups.withColumn("step", F.least(step, F.lit(b))).withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.col("step"))))
    sc = groups.sparkSession.sparkContext
    return x.withColumn("hi", F.least(F.col("lo") + F.col("step"), F.lit(b))).repartition(max(sc.defaultParallelism, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "g", "lo")


def _bits(head: str, n: int) -> np.ndarray:
    """32 random bits from the md5 of each of ``head|0`` to ``head|n-1``."""
    h = hashlib.md5(f"{head}|".encode(), usedforsecurity=False)
    out = []
    for i in range(n):
        x = h.copy()
        x.update(b"%d" % i)
        out.append(x.digest()[:4])
    return np.frombuffer(b"".join(out), ">u4").astype(np.int64)


def _by_group(paired: DataFrame) -> DataFrame:
    """g, size and the gaps in order of the groups of two gaps or more: the whole group is one row."""
    x = _numbered(paired).where("n >= 2").groupBy(*GROUP, "g").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("i", "gap"))).alias("z"))
    return x.select(*GROUP, "g", "size", F.col("z.gap").alias("gaps"))


def _resampled(seed: int):
    def run(batches):
        for batch in batches:
            for g, gaps, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("g", "gaps", "lo", "hi")), strict=True):
                v = np.array(gaps)
                m = [v[_bits(f"{seed}|b|{g}|{b}", len(v)) % len(v)].mean() for b in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(m), pa.string()), pa.array(m, pa.float64())], ["g", "m"])

    return run


def bootstrap_ci(paired: DataFrame, b: int = 10_000, seed: int = 0) -> DataFrame:
    """n, mean_gap and the 95 % percentile interval of the mean over b resamples; NULL under two gaps."""
    means = _blocks(_by_group(paired), b).select("g", "gaps", "lo", "hi").mapInArrow(_resampled(seed), "g string, m double")
    ci = means.groupBy("g").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    base = _numbered(paired).groupBy(*GROUP, "g").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 2, F.avg("gap")).alias("mean_gap"))
    return base.join(ci, "g", "left").select(*GROUP, "n", "mean_gap", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"))


def _flipped(seed: int):
    def run(batches):
        for batch in batches:
            gs, hits = batch.column("g").to_pylist(), []
            for g, gaps, lo, hi in zip(gs, *(batch.column(c).to_pylist() for c in ("gaps", "lo", "hi")), strict=True):
                v = np.array(gaps)
                least = abs(v.mean()) - 1e-12
                hits.append(sum(bool(abs(np.where(_bits(f"{seed}|s|{g}|{b}", len(v)) % 2 == 0, v, -v).mean()) >= least) for b in range(lo, hi)))
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.string()), pa.array(hits, pa.int64())], ["g", "hits"])

    return run


def signflip(paired: DataFrame, b: int = 20_000, seed: int = 0) -> DataFrame:
    """n, p_perm: share of sign-flipped means at least as far from 0, one added to both."""
    hits = _blocks(_by_group(paired), b).select("g", "gaps", "lo", "hi").mapInArrow(_flipped(seed), "g string, hits long").groupBy("g").agg(F.sum("hits").alias("hits"))
    base = _numbered(paired).where("n >= 2").groupBy(*GROUP, "g").agg(F.count(F.lit(1)).alias("n"))
    return base.join(hits, "g").select(*GROUP, "n", ((F.col("hits") + 1) / F.lit(b + 1.0)).alias("p_perm"))


def _resampled_twice(seed: int):
    def run(batches):
        for batch in batches:
            for langs, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("langs", "lo", "hi")), strict=True):
                v = [np.array(x, float) for x in langs]
                m = []
                for b in range(lo, hi):
                    drawn = [v[x] for x in _bits(f"{seed}|l|{b}", len(v)) % len(v)]
                    some = np.concatenate([x[_bits(f"{seed}|p|{b}|{slot}", len(x)) % len(x)] for slot, x in enumerate(drawn) if len(x)] or [np.zeros(0)])
                    if len(some):
                        m.append(some.mean())
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.float64())], ["m"])

    return run


def cluster_bootstrap(paired: DataFrame, b: int = 10_000, seed: int = 0) -> DataFrame:
    """ci_lo, ci_hi over languages drawn with replacement, then prompts within each drawn language, means of the concatenation."""
    x = paired.where("level = 'general' and gap is not null").select("language", "prompt_id", "gap")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("language").orderBy("prompt_id")))
    langs = x.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("i", "gap"))).alias("z")).withColumn("l", F.row_number().over(Window.orderBy("language")))  # a handful
    gaps = F.when(F.col("language").isNotNull(), F.col("z.gap")).otherwise(F.array().cast("array<double>"))  # a language without a name can be drawn, but has no prompts
    one = langs.select("l", gaps.alias("gaps"), F.size("z").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l", "gaps"))).alias("z"), F.sum("k").alias("size")).where("size > 0")
    m = _blocks(one.select(F.lit("").alias("g"), "size", F.col("z.gaps").alias("langs")), b).select("langs", "lo", "hi").mapInArrow(_resampled_twice(seed), "m double")
    return m.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("cluster_ci_lo"), F.col("q")[1].alias("cluster_ci_hi"))


def avg_rank(c: str, *by: str) -> Column:
    """Rank with ties at their mean."""
    r = F.rank().over(Window.partitionBy(*by).orderBy(c)) if by else F.rank().over(Window.orderBy(c))
    return r + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0


def wilcoxon(paired: DataFrame, p: bool = False) -> DataFrame:
    """n_nonzero, w_plus of the signed-rank test; ``p`` adds the two-sided probability (1 where all gaps are 0)."""
    x = paired.where("gap is not null").withColumn("d", F.round(F.abs("gap"), 12))
    nz = x.where("d > 0").withColumn("r", avg_rank("d", *GROUP)).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy(*GROUP, "d")))
    s = nz.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_nonzero"), F.sum(F.when(F.col("gap") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"))
    if p:
        s = s.withColumn("p_wilcoxon", wilcoxon_sf2(F.col("w_plus"), F.col("n_nonzero"), F.col("ties")))
    return s.drop("ties")


def paired_t(paired: DataFrame, p: bool = False) -> DataFrame:
    """n, t of the gaps against 0; ``p`` adds its probability (1 where the gaps do not vary)."""
    s = paired.where("gap is not null").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s")).where("n >= 2")
    s = s.withColumn("t", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))))
    if p:
        s = s.withColumn("p_t", F.when(F.col("s") > 0, t_sf2(F.coalesce("t", F.lit(0.0)), (F.col("n") - 1).cast("double"))).otherwise(1.0))
    return s.select(*GROUP, "n", "t", *(["p_t"] if p else []))


def adjust(df: DataFrame, p: str, *family: str) -> DataFrame:
    """Adds {p}_holm and {p}_bh within ``family``; NULL and NaN p stay out of the count and keep NULL."""
    ok = F.when(~F.isnan(F.col(p)), F.col(p))
    x = df.withColumn("_p", ok).withColumn("_has", ok.isNotNull())
    w = Window.partitionBy(*family, "_has")
    m, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("_p", "_id"))
    x = x.withColumn("_id", F.xxhash64(*[c for c in df.columns])).withColumn("_m", m).withColumn("_i", i)
    up = w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn(f"{p}_holm", F.when(F.col("_has"), F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col("_p"))).over(up)))
    x = x.withColumn(f"{p}_bh", F.when(F.col("_has"), F.min(F.least(F.lit(1.0), F.col("_m") * F.col("_p") / F.col("_i"))).over(down)))
    return x.drop("_p", "_has", "_id", "_m", "_i")


def sample_k(pool: DataFrame, k: int, by: str, key: str, seed: int = 42) -> DataFrame:
    """k rows of each group by a hash of the key.  A group with fewer than k rows is an error."""
    short = pool.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)
    bad = short.limit(5).collect()
    if bad:
        raise ValueError(f"fewer than {k} rows: " + ", ".join(f"{r[by]} ({r.n})" for r in bad))
    return rank_k(pool, k, by, key, seed)


def rank_k(pool: DataFrame, k: int, by: str, key: str, seed: int = 42) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key))), key))
    return pool.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")
