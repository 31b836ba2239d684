"""Cosine similarity of sets of unit vectors through additive sums: a cell needs only n and the vector sum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("model", "language", "prompt_id")


def normalize(e: Column) -> Column:
    """Divided by the L2 norm; a zero vector stays."""
    x = e.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: v / F.when(norm > 0, norm).otherwise(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cell_sums(vectors: DataFrame, keys: tuple[str, ...] = CELL, e: str = "e") -> DataFrame:
    """keys, n, s: number of vectors and their sum.  Vectors are summed within each Arrow batch, and the sums, one array
    a cell and batch, are shuffled once; no task holds more than a batch and one open cell.

    Rows with a NULL key or vector are left out; a NULL component counts as 0, and so do those that a shorter vector lacks."""
    ok = vectors.dropna(subset=[*keys, e]).select(*keys, F.lit(1).cast("long").alias("n"), F.col(e).cast("array<double>").alias("s"))
    part = ok.mapInArrow(_batch_sums, ok.schema)
    return part.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_run_sums, ok.schema)


def _sums(batch: pa.RecordBatch) -> pa.Table:
    """Keys, n and s of a batch, summed over runs of equal keys in the order in which these come first."""
    k = batch.num_columns - 2
    codes = np.stack([batch.column(i).dictionary_encode().indices.to_numpy() for i in range(k)], 1)
    size = pc.list_value_length(batch.column(k + 1)).to_numpy()
    flat = batch.column(k + 1).flatten().fill_null(0.0).to_numpy()
    m = np.zeros((len(size), int(size.max(initial=0))))
    m[np.arange(m.shape[1])[None, :] < size[:, None]] = flat
    order = np.lexsort(codes.T[::-1])
    first = np.flatnonzero(np.r_[True, (codes[order][1:] != codes[order][:-1]).any(1)])
    s, n = np.add.reduceat(m[order], first, 0), np.add.reduceat(batch.column(k).to_numpy()[order], first)
    keys = [batch.column(i).take(pa.array(order[first])) for i in range(k)]
    wide = np.maximum.reduceat(size[order], first)
    values = s[np.arange(s.shape[1])[None, :] < wide[:, None]]
    return pa.Table.from_arrays([*keys, pa.array(n), pa.ListArray.from_arrays(np.r_[0, np.cumsum(wide)].astype(np.int32), pa.array(values))], batch.schema.names)


def _batch_sums(batches):
    for batch in batches:
        if batch.num_rows:
            yield from _sums(batch).to_batches()


def _run_sums(batches):
    """Batches sorted by the keys: the last cell of a batch stays open, as the next one may go on with it."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = _sums(pa.concat_tables([held, t.cast(held.schema)] if held is not None else [t]).combine_chunks().to_batches()[0])
        at = pa.Table.from_batches([batch]).slice(batch.num_rows - 1).select(range(batch.num_columns - 2)).to_pylist()[0]
        last = np.array([all(r[c] == v for c, v in at.items()) for r in t.select(list(at)).to_pylist()])
        held = t.filter(pa.array(last))
        yield from t.filter(pa.array(~last)).to_batches()
    if held is not None:
        yield from held.to_batches()


def intra(cells: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """keys, intra_sim, n_samples: mean cosine of two members; NULL under two."""
    n = F.col("n")
    return cells.select(*keys, F.when(n >= 2, (dot(F.col("s"), F.col("s")) - n) / (n * (n - 1))).alias("intra_sim"), n.cast("long").alias("n_samples"))


def inter(cells: DataFrame) -> DataFrame:
    """model_a < model_b, language, prompt_id, inter_sim: mean cosine across two cells of a prompt."""
    a = cells.select(F.col("model").alias("model_a"), "language", "prompt_id", F.col("n").alias("na"), F.col("s").alias("sa"))
    b = cells.select(F.col("model").alias("model_b"), "language", "prompt_id", F.col("n").alias("nb"), F.col("s").alias("sb"))
    j = a.join(b, ["language", "prompt_id"]).where("model_a < model_b")
    return j.select("model_a", "model_b", "language", "prompt_id", (dot(F.col("sa"), F.col("sb")) / (F.col("na") * F.col("nb"))).alias("inter_sim"))


def respondent_matrix(intra_: DataFrame, inter_: DataFrame) -> DataFrame:
    """resp_a, resp_b, sim in long form: means of intra on the diagonal, of inter off it, both orders."""
    diag = intra_.groupBy("model").agg(F.avg("intra_sim").alias("sim")).select(F.col("model").alias("resp_a"), F.col("model").alias("resp_b"), "sim")
    off = inter_.groupBy("model_a", "model_b").agg(F.avg("inter_sim").alias("sim"))
    one = off.select(F.col("model_a").alias("resp_a"), F.col("model_b").alias("resp_b"), "sim")
    return diag.union(one).union(one.select(F.col("resp_b").alias("resp_a"), F.col("resp_a").alias("resp_b"), "sim"))


def family_matrix(matrix: DataFrame, family: DataFrame) -> DataFrame:
    """family_a, family_b, sim: mean over pairs of distinct respondents; a family of one has its diagonal value.

    ``family``: model, family; respondents without one stand for themselves."""
    fam = family.select("model", "family")
    m = matrix.join(fam.select(F.col("model").alias("resp_a"), F.col("family").alias("fa")), "resp_a", "left")
    m = m.join(fam.select(F.col("model").alias("resp_b"), F.col("family").alias("fb")), "resp_b", "left")
    m = m.select(F.coalesce("fa", "resp_a").alias("family_a"), F.coalesce("fb", "resp_b").alias("family_b"), "resp_a", "resp_b", "sim")
    off = F.avg(F.when(F.col("resp_a") != F.col("resp_b"), F.col("sim")))
    one = F.avg(F.when(F.col("resp_a") == F.col("resp_b"), F.col("sim")))
    return m.groupBy("family_a", "family_b").agg(F.coalesce(off, one).alias("sim"))


def attach_texts(vectors: DataFrame, texts: DataFrame, keys: list[str], text: str = "text", chars: int = 400) -> DataFrame:
    """``vectors`` with the start of their text beside them, '' where there is none."""
    t = texts.dropDuplicates(keys).select(*keys, F.substring(text, 1, chars).alias("preview"))
    return vectors.join(t, keys, "left").withColumn("preview", F.coalesce("preview", F.lit("")))
