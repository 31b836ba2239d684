"""Documents into containers of fixed capacity: vector best-fit over bounded groups.

An item has three sizes: tokens, one document, and attention cost (tokens squared); a bin has a capacity in
each: the container's tokens, a number of documents, and a share of the attention cost of one document that fills it.
Items come in falling order of tokens; of the bins that have room in every dimension, an item goes to the
one whose residual after it has the least weighted norm, or the greatest weighted dot product with it.  A document whose own attention cost is over the capacity
cannot be made cheaper without being split, so it takes all of a bin's attention and stands alone.  A document is split only where it alone exceeds the
token capacity: into full pieces, each a bin, and a rest, which is an item.

Packing one list is sequential, so items are dealt by a hash into groups of about ``group`` documents, each
packed by one task; what lies in bins filled below ``well_filled`` is dealt again and packed once more.  With thousands of
items a group, the loss against one list is under one bin in a hundred.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.llm import tokens
from polyphony.session import materialise


@dataclass(frozen=True)
class Packing:
    """Parameters.  ``max_docs``: documents a bin may hold; ``attention_share``: attention capacity as a share of capacity squared."""

    group: int = 4096
    rounds: int = 2
    well_filled: float = 0.95
    max_docs: int = 32
    attention_share: float = 0.75
    near_bound: float = 0.02
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)


def _fit(sizes: np.ndarray, cost: np.ndarray, cap: np.ndarray, cfg: Packing, start: int, dot: bool) -> np.ndarray:
    """Bin of each item, ``start`` bins being open from the beginning."""
    w = np.array(cfg.weights)
    room = np.empty((len(sizes) + start, 3))
    room[:start] = cap
    out = np.zeros(len(sizes), np.int64)
    bins = start
    for i in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[i], 1.0, cost[i]])
        left = room[:bins] - need
        ok = np.flatnonzero((left >= -1e-9).all(1))
        if len(ok):
            r = (room[ok] if dot else left[ok]) / cap
            b = ok[int((r @ (w * need / cap)).argmax() if dot else (r * r @ w).argmin())]
            room[b] = left[b]
        else:
            b = bins
            room[b] = cap - need
            bins += 1
        out[i] = b
    return np.unique(out, return_inverse=True)[1]


def best_fit(sizes: np.ndarray, capacity: int, cfg: Packing = Packing()) -> np.ndarray:
    """Bin of each item; every size is between 1 and ``capacity``.

    First by the least residual norm.  Where that leaves more than ``near_bound`` above the lower bound, as it does when small
    items are left over to the end and their number binds, the bins of the lower bound are opened at once, items go where the
    weighted dot product of need and room is greatest, and the better of the two is kept."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    cap = np.array([capacity, cfg.max_docs, cfg.attention_share * float(capacity) ** 2])
    cost = np.minimum(sizes.astype(float) ** 2, cap[2])
    least = int(np.ceil(np.array([sizes.sum(), len(sizes), cost.sum()]) / cap - 1e-9).max())
    out = _fit(sizes, cost, cap, cfg, 0, False)
    if out.max() + 1 > (1 + cfg.near_bound) * least:
        other = _fit(sizes, cost, cap, cfg, least, True)
        out = other if other.max() < out.max() else out
    return out


_ROW = "container_class string, capacity long, doc_id long, piece int, tokens long, bin_id string, filled long"


def _pack(kinds: list[tuple[str, int]], cfg: Packing, stage: int):
    capacity = dict(kinds)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for name, cap in kinds:
            own = pdf[pdf.container_class == name] if stage else pdf
            size, doc = own.tokens.to_numpy(np.int64), own.doc_id.to_numpy(np.int64)
            if not len(size):
                continue
            if stage:
                piece, full = own.piece.to_numpy(np.int64), np.zeros(len(size), np.int64)
            else:
                full = size // capacity[name]
                piece = full.copy()
            rest = size - full * cap
            k = np.flatnonzero(rest > 0)
            b = best_fit(rest[k], cap, cfg)
            filled = np.bincount(b, rest[k], minlength=1).astype(np.int64)
            tag = f"{name}/{stage}/{key[0]}/"
            parts.append(pd.DataFrame({"doc_id": doc[k], "piece": piece[k], "tokens": rest[k], "bin_id": [f"{tag}{x}" for x in b], "filled": filled[b], "container_class": name, "capacity": cap}))
            split = np.flatnonzero(full > 0)
            if len(split):
                d, p = np.repeat(doc[split], full[split]), np.concatenate([np.arange(x) for x in full[split]])
                parts.append(pd.DataFrame({"doc_id": d, "piece": p, "tokens": cap, "bin_id": [f"{tag}d{x}.{y}" for x, y in zip(d, p, strict=True)], "filled": cap, "container_class": name, "capacity": cap}))
        cols = ["container_class", "capacity", "doc_id", "piece", "tokens", "bin_id", "filled"]
        return pd.concat(parts, ignore_index=True)[cols].astype({"capacity": "int64", "doc_id": "int64", "piece": "int32", "tokens": "int64", "filled": "int64"})

    return run


def pack(sizes: DataFrame, containers: DataFrame, cfg: Packing = Packing()) -> DataFrame:
    """sizes: doc_id, tokens -> container_class, capacity, doc_id, piece, tokens, bin_id, filled.

    ``filled`` is the tokens of the whole bin.  Documents without tokens and NULL keys are not packed; a
    repeated document counts once, with its largest size; containers without a positive capacity are left out."""
    kinds = sorted({(r.container_class, int(r.capacity_tokens)) for r in containers.where("container_class is not null and capacity_tokens > 0").select("container_class", "capacity_tokens").limit(10_001).collect()})
    if len(kinds) > 10_000:
        raise ValueError("containers is a small table of kinds")
    if not kinds:
        return sizes.sparkSession.createDataFrame([], _ROW)
    items = sizes.where("doc_id is not null and tokens > 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("tokens").cast("long")).alias("tokens"))
    items = materialise(items, "pack-items")

    def deal(df: DataFrame, n: int, *by) -> DataFrame:
        groups = max(1, -(-n // cfg.group))  # each group is long work on few bytes, so partitions follow the groups
        return df.withColumn("g", F.pmod(F.xxhash64(*by), F.lit(groups))).repartition(min(groups, 10_000), "g")

    done = None
    rows = deal(items, items.count(), "doc_id")
    for stage in range(cfg.rounds):
        got = materialise(rows.groupBy("g").applyInPandas(_pack(kinds, cfg, stage), _ROW), "pack")
        last = stage == cfg.rounds - 1
        well = got if last else got.where(F.col("filled") >= cfg.well_filled * F.col("capacity"))
        done = well if done is None else done.union(well)
        if last:
            break
        poor = got.where(F.col("filled") < cfg.well_filled * F.col("capacity")).select("container_class", "doc_id", "piece", "tokens")
        n = poor.groupBy("container_class").count().agg(F.max("count")).first()[0] or 0
        if not n:
            break
        rows = deal(poor, n, "doc_id", F.lit(stage))
    return done


def pack_documents(documents: DataFrame, containers: DataFrame, cfg: Packing = Packing(), ranks_path: str = tokens.DEFAULT_RANKS) -> DataFrame:
    """The assignment of every document with text to containers of each kind."""
    none = F.lit(None).cast("string")
    rows = documents.select(F.lit("document").alias("rec_type"), F.col("doc_id").alias("rec"), none.alias("source"), none.alias("language"), none.alias("slice"), "text")
    n = tokens.count_tokens(rows, ranks_path)
    return pack(n.select(F.col("rec").alias("doc_id"), F.col("n_tokens").alias("tokens")), containers, cfg)


def fill_rates(assigned: DataFrame, cfg: Packing = Packing()) -> DataFrame:
    """container_class, capacity, n_docs, n_split, n_bins, tokens, fill_rate; least_bins: no assignment can do with fewer, by the
    tokens, pieces and attention costs in all; most_docs, attention_use: the fullest bin's documents, and the mean share of the
    attention capacity in use; bound_by_docs, bound_by_attention: bins that have token room left which the other capacity closes.

    Full pieces of a split document are bins of their own, outside the two other capacities."""
    cap = F.col("capacity")
    att = F.lit(cfg.attention_share) * cap.cast("double") * cap
    cost = F.least(F.col("tokens").cast("double") * F.col("tokens"), att)
    full = F.col("tokens") == cap
    bins = assigned.groupBy("container_class", "capacity", "bin_id").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("d"), F.sum(cost).alias("a"), F.sum(F.when(~full, 1)).alias("rest"), F.sum(F.when(~full, cost)).alias("rest_a")
    )
    open_ = F.col("t") < cap
    room = (cap - F.col("t")).cast("double")
    b = bins.groupBy("container_class", "capacity").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("t").alias("tokens"), F.sum(F.when(F.col("rest").isNull(), 1).otherwise(0)).alias("whole"), F.coalesce(F.sum("rest"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("rest_a"), F.lit(0.0)).alias("costs"),
        F.max("d").alias("most_docs"), F.avg(F.col("a") / att).alias("attention_use"),
        F.sum((open_ & (F.col("d") >= cfg.max_docs)).cast("long")).alias("bound_by_docs"), F.sum((open_ & (att - F.col("a") < room * room)).cast("long")).alias("bound_by_attention"),
    )
    least = F.greatest(F.ceil(F.col("tokens") / cap), F.col("whole") + F.greatest(F.ceil(F.col("pieces") / cfg.max_docs), F.ceil(F.col("costs") / att - 1e-9))).cast("long")
    d = assigned.groupBy("container_class", "doc_id").agg(F.max("piece").alias("p")).groupBy("container_class").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("p") > 0).cast("long")).alias("n_split"))
    return b.join(d, "container_class").select(
        "container_class", "capacity", "n_docs", "n_split", "n_bins", "tokens", (F.col("tokens") / (F.col("n_bins") * cap)).alias("fill_rate"),
        least.alias("least_bins"), "most_docs", "attention_use", "bound_by_docs", "bound_by_attention",
    )
