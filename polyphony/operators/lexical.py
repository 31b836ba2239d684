"""Character n-gram Jaccard within and between cells.

The mean over all pairs is exact, yet no pair is ever a row: the texts of a block are dealt into tiles of at
most ``tile`` rows, every two tiles meet in one task, and the task adds up similarities by respondent pair from
a product of 0/1 matrices.  A hot block becomes many bounded tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 256


def _grams(text: str, n: int) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = len(a) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h ^ (a[i : i + m] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _shared(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    k = len(grams)
    out = np.zeros((k, k), np.float32)
    size = np.array([len(g) for g in grams])
    if not size.sum():
        return out
    _, inv = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(k), size)
    order = np.argsort(inv, kind="stable")
    inv, row = inv[order], row[order]
    for lo in range(0, int(inv[-1]) + 1, 8192):
        a, b = np.searchsorted(inv, [lo, lo + 8192])
        m = np.zeros((k, 8192), np.float32)
        m[row[a:b], inv[a:b] - lo] = 1
        out += m @ m.T
    return out


def _tile_sums(n: int, same: bool, n_keys: int):
    def emit(rows: list[tuple]):
        i, j = rows[0][n_keys], rows[0][n_keys + 1]
        resp = np.array([r[n_keys + 3] for r in rows], dtype=object)
        tile = np.array([r[n_keys + 2] for r in rows])
        g = [_grams(r[n_keys + 4] or "", n) for r in rows]
        size = np.array([len(x) for x in g], float)
        both = _shared(g)
        union = size[:, None] + size[None, :] - both
        ok = np.triu(np.ones_like(union, bool), 1) & (union > 0)
        if i != j:
            ok &= tile[:, None] != tile[None, :]
        names, code = np.unique(resp.astype(str), return_inverse=True)
        eq = code[:, None] == code[None, :]
        ok &= eq if same else ~eq
        x, y = np.nonzero(ok)
        if not len(x):
            return
        v = both[x, y] / union[x, y]
        lo, hi = np.minimum(code[x], code[y]), np.maximum(code[x], code[y])
        key, inv = np.unique(lo * len(names) + hi, return_inverse=True)
        s, c = np.bincount(inv, v), np.bincount(inv)
        for q, a, b in zip(key.tolist(), s.tolist(), c.tolist(), strict=True):
            yield (*rows[0][:n_keys], names[q // len(names)], names[q % len(names)], a, b)

    def run(batches):
        held: list[tuple] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][: n_keys + 2] != r[: n_keys + 2]:
                    out += emit(held)
                    held = []
                held.append(r)
            yield _batch(out, schema, n_keys)
        if held:
            yield _batch(list(emit(held)), schema, n_keys)

    return run


def _batch(rows, schema, n_keys):
    cols = list(zip(*rows, strict=True)) or [()] * (n_keys + 4)
    names = [schema.field(i).name for i in range(n_keys)]
    types = [pa.string()] * (n_keys + 2) + [pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*names, "ra", "rb", "total", "pairs"])


def pair_sums(texts: DataFrame, block: list[str], resp: str, text: str, n: int = 4, same: bool = True, key: str | None = None, tile: int = TILE) -> DataFrame:
    """block, ra, rb, total, pairs: sum and number of the defined Jaccard similarities of two rows of a block.

    ``same``: pairs of one respondent, else of two (ra < rb).  A NULL text is an empty one; two texts without
    n-grams have no similarity; ``key``: a column that tells rows apart, which saves a shuffle of the texts; block columns are strings, and rows with a NULL in them or in ``resp`` are left out."""
    id_ = [F.col(key).alias("id")] if key else []
    rows = texts.dropna(subset=[*block, resp]).select(*(F.col(c).cast("string").alias(c) for c in block), F.col(resp).cast("string").alias("resp"), F.coalesce(F.col(text), F.lit("")).alias("text"), *id_)
    size = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    # The tile of a row is fixed by its key or, without one, by its content and its place among equal rows, so a lost
    # task finds the same rows again.
    if not key:
        rows = rows.withColumn("id", F.row_number().over(Window.partitionBy(*block, F.pmod(F.xxhash64("resp", "text"), F.lit(64))).orderBy("resp", "text")))
    rows = rows.join(size, block).withColumn("t", F.pmod(F.xxhash64("id", "resp"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
    rows = rows.select(*block, F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "resp", "text")
    keys = [*block, "i", "j"]
    schema = ", ".join(f"{c} string" for c in block) + ", ra string, rb string, total double, pairs long"
    parts = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tile_sums(n, same, len(block)), schema)
    return parts.groupBy(*block, "ra", "rb").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def intra_jaccard(texts: DataFrame, n: int = 4, key: str | None = None) -> DataFrame:
    """model, language, prompt_id, intra_sim, n_samples: mean over pairs of a cell's texts; NULL without a defined pair."""
    cell = ["model", "language", "prompt_id"]
    sums = pair_sums(texts.withColumn("r", F.col("model")), cell, "r", "text", n, key=key)
    size = texts.dropna(subset=cell).groupBy(*cell).agg(F.count(F.lit(1)).alias("n_samples"))
    return size.join(sums.select(*cell, (F.col("total") / F.col("pairs")).alias("intra_sim")), cell, "left").select(*cell, "intra_sim", "n_samples")


def inter_jaccard(texts: DataFrame, k: int = 10, n: int = 4, key: str | None = None) -> DataFrame:
    """model_a < model_b, language, prompt_id, inter_sim over the first k samples of each cell."""
    sums = pair_sums(texts.where(F.col("sample_idx") < k), ["language", "prompt_id"], "model", "text", n, same=False, key=key)
    return sums.select(F.col("ra").alias("model_a"), F.col("rb").alias("model_b"), "language", "prompt_id", (F.col("total") / F.col("pairs")).alias("inter_sim"))
