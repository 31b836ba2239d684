"""Near-duplicate records by tiled comparison of bit sketches.

Each text of ``min_chars`` characters or more becomes the set of its distinct character
``shingle``-grams.  Two things are kept of the set: a 256-bit sketch (one bit of the least hash in
each of 256 bins, so two sets of Jaccard similarity J differ in about 128 * (1 - J) bits), and
``bands`` keys, each of ``rows`` further minima.  Rows that share a key meet in one block.  A block
is compared exhaustively, in tiles, by numpy exclusive-or and bit counts; a tile pair is skipped
where the population counts of the two sides differ by more than the radius allows: the sizes of the
shingle sets, by which the rows of a block are sorted, and the ones in the sketches (of which there are about
128 in every sketch, so that it is the set sizes that skip).  Pairs within the radius are then held against their
exact shingle sets.

Copies (equal after normalisation) are compared once, through one representative, and the pairs
of their members are added at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.llm.common import Bits, U, as_signed, code_points, mix, partitions_for, spread, squeeze, window_hashes
from polyphony.session import materialise

BITS = 256
TILE = 512
SMALL = 48


@dataclass(frozen=True)
class NearDup:
    """Parameters.  ``hot``: a block with more rows than this is cut into fragments that meet pairwise.
    ``star``: members of a class of exact copies beyond which the class is given as representative-member
    pairs instead of all pairs."""

    shingle: int = 8
    similarity: float = 0.6
    min_chars: int = 300
    bands: int = 22
    rows: int = 3
    radius_sigmas: float = 4.0
    hot: int = 20_000
    star: int = 200

    @property
    def radius(self) -> int:
        p = (1 - self.similarity) / 2
        return int(np.ceil(BITS * p + self.radius_sigmas * np.sqrt(BITS * p * (1 - p))))


def _minima(h: np.ndarray, owner: np.ndarray, n_owner: int, bins: int) -> np.ndarray:
    """Least hash of each owner in each bin; empty bins take the next filled one (rotation)."""
    b = ((h >> U(40)) * U(bins)) >> U(24)
    key = owner * bins + b.astype(np.int64)
    full = np.full(n_owner * bins, np.iinfo(np.uint64).max, U)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # h ascends within an owner, so bins do too
    full[key[first]] = h[first]
    full = full.reshape(n_owner, bins)
    empty = full == np.iinfo(np.uint64).max
    idx = np.where(empty, 3 * bins, np.arange(bins)[None, :])
    idx = np.minimum.accumulate(np.concatenate([idx, idx + bins], 1)[:, ::-1], 1)[:, ::-1][:, :bins] % bins
    return np.take_along_axis(full, idx, 1)


def sketch(texts: list[str], cfg: NearDup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, sketches as 4 words, band keys) of normalised texts, each at least ``shingle`` long."""
    a, off = code_points(texts)
    h = window_hashes(a, cfg.shingle)
    parts, sizes, second = [], np.empty(len(texts), np.int32), []
    for i in range(len(texts)):
        s = np.sort(h[off[i] : off[i + 1] - cfg.shingle + 1])
        s = s[np.r_[True, s[1:] != s[:-1]]]
        sizes[i] = len(s)
        parts.append(s)
        second.append(np.sort(mix(s ^ U(0x5851F42D4C957F2D))))
    owner = np.repeat(np.arange(len(texts)), sizes)
    low = _minima(np.concatenate(second), owner, len(texts), BITS)
    bits = np.packbits((mix(low) & U(1)).astype(np.uint8), axis=1).view(U)
    m = _minima(np.concatenate(parts), owner, len(texts), cfg.bands * cfg.rows).reshape(len(texts), cfg.bands, cfg.rows)
    key = np.broadcast_to(np.arange(1, cfg.bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (len(texts), cfg.bands))
    for r in range(cfg.rows):
        key = mix(key ^ m[:, :, r])
    return sizes, bits, (key >> U(32)).astype(np.uint32)


_SKETCH = "rec long, th long, th2 long, n int, w0 long, w1 long, w2 long, w3 long, keys array<int>"


def _sketch_batches(cfg: NearDup):
    def run(batches):
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is not None and t is not None and len(s := squeeze(t)) >= max(cfg.min_chars, cfg.shingle):
                    ids.append(i)
                    texts.append(s)
            for at in range(0, len(texts), 1024):
                part = texts[at : at + 1024]
                n, w, k = sketch(part, cfg)
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in part), np.int64).reshape(-1, 2)
                w = as_signed(np.ascontiguousarray(w))
                keys = pa.ListArray.from_arrays(np.arange(0, k.size + 1, cfg.bands, dtype=np.int32), pa.array(np.ascontiguousarray(k).view(np.int32).ravel()))
                cols = [pa.array(ids[at : at + 1024], pa.int64()), *(pa.array(np.ascontiguousarray(d[:, j])) for j in range(2)), pa.array(n), *(pa.array(np.ascontiguousarray(w[:, j])) for j in range(4)), keys]
                yield pa.RecordBatch.from_arrays(cols, ["rec", "th", "th2", "n", "w0", "w1", "w2", "w3", "keys"])

    return run


def sketches(records: DataFrame, cfg: NearDup, rec: str, text: str) -> DataFrame:
    """One row per record and delivery whose normalised text has ``min_chars`` or more."""
    return spread(records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text"))).mapInArrow(_sketch_batches(cfg), _SKETCH)


def _frequent_keys(cfg: NearDup, parts: int):
    """Keys of which this partition holds so many that they may have more than ``hot`` rows in all.

    A table of counters of fixed size, which may only count too much, runs along with the batches; a key is kept from the
    moment its counter says that it may be frequent.  A key under the bound in each partition has at most half of ``hot`` rows."""
    least = max(2, cfg.hot // (2 * max(1, parts)))

    def run(batches):
        counters = np.zeros(1 << 22, np.int64)
        kept: dict[int, int] = {}
        for batch in batches:
            k = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, cfg.bands)
            k, c = np.unique(k + (np.arange(cfg.bands) << 32), return_counts=True)
            slot = (mix(k.view(U)) >> U(42)).astype(np.int64)
            np.add.at(counters, slot, c)
            for x, y, z in zip(*(v[counters[slot] >= least].tolist() for v in (k, c, slot)), strict=True):
                kept[x] = kept[x] + y if x in kept else int(counters[z])
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.int64())], ["key", "c"])

    return run


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.uint16)


def tile_pairs(key: np.ndarray, n: np.ndarray, w: np.ndarray, cross: np.ndarray, cfg: NearDup):
    """Index pairs within the radius among rows that share a key; rows come sorted by (key, n).

    ``cross``: 0 where all pairs of the block count, 1 / 2 for the two sides of a fragment pair, of
    which only pairs between the sides count.
    """
    ratio, radius = cfg.similarity, cfg.radius
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    out = []
    # Blocks of up to SMALL rows: one sweep over all of them per distance within the block.
    small = np.repeat(size <= SMALL, size)
    left = np.repeat(start + size, size) - np.arange(len(key)) - 1  # rows after this one in its block
    at = np.flatnonzero(small & (left >= 1))
    d = 1
    while len(at):
        b = at + d
        near = n[at] >= ratio * n[b]
        at = at[near]  # sizes ascend: past the bound, no later row of the block can match
        b = at + d
        for o in range(0, len(at), 1 << 16):
            x, y = at[o : o + (1 << 16)], b[o : o + (1 << 16)]
            ok = (_hamming(w[x], w[y]) <= radius) & ((cross[x] == 0) | (cross[x] != cross[y]))
            out.append(np.stack([x[ok], y[ok]], 1))
        d += 1
        at = at[left[at] >= d]
    pop = np.bitwise_count(w).sum(1, dtype=np.int32) if (size > SMALL).any() else None
    for s, z in zip(start[size > SMALL], size[size > SMALL], strict=True):
        tiles = []
        for o in range(s, s + z, TILE):
            i = np.arange(o, min(o + TILE, s + z))
            tiles.append((i, n[i[0]], n[i[-1]], pop[i].min(), pop[i].max()))
        for p, (i, _, hi, lo1, hi1) in enumerate(tiles):
            for j, lo, _, lo2, hi2 in tiles[p:]:
                if hi < ratio * lo:
                    break
                if lo2 - hi1 > radius or lo1 - hi2 > radius:
                    continue
                x, y = np.nonzero(_hamming(w[i][:, None, :], w[j][None, :, :]) <= radius)
                x, y = i[x], j[y]
                ok = (x < y) & (n[x] >= ratio * n[y]) & ((cross[x] == 0) | (cross[x] != cross[y]))
                out.append(np.stack([x[ok], y[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _block_batches(cfg: NearDup):
    """Rows of a partition sorted by (key, f, g, n); a block may span batches, so the open block is carried on."""
    names = ["key", "f", "g", "rec", "n", "w0", "w1", "w2", "w3", "frag"]

    def emit(t: pa.Table):
        t = {c: t.column(c).to_numpy() for c in names}
        k = t["key"].astype(np.int64).view(U)
        k = mix(k ^ mix(t["f"].astype(U) * U(65537) + t["g"].astype(U)))
        # equal mixed keys stay together: rows come sorted by (key, f, g)
        w = np.stack([t[f"w{j}"] for j in range(4)], 1).view(U)
        cross = np.where(t["f"] == t["g"], 0, np.where(t["frag"] == t["f"], 1, 2))
        p = tile_pairs(k, t["n"], w, cross, cfg)
        a, b = t["rec"][p[:, 0]], t["rec"][p[:, 1]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        u = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, 0])), pa.array(np.ascontiguousarray(u[:, 1]))], ["a", "b"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            k = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("key", "f", "g")], 1)
            last = np.flatnonzero((k[1:] != k[:-1]).any(1))
            if len(last) and held.num_rows >= 20_000:
                cut = int(last[-1]) + 1
                yield emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield emit(held)

    return run


def candidate_pairs(reps: DataFrame, cfg: NearDup) -> DataFrame:
    """(a, b), a < b: representatives whose sketches lie within the radius and share a band key."""
    parts = max(1, reps.rdd.getNumPartitions())
    rows = reps.select("rec", "n", "w0", "w1", "w2", "w3", F.posexplode("keys").alias("band", "k"))
    rows = rows.withColumn("key", F.col("k") + F.shiftleft(F.col("band").cast("long"), 32)).drop("band", "k")
    hot = (
        reps.select("keys").mapInArrow(_frequent_keys(cfg, parts), "key long, c long")
        .groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > cfg.hot // 2)
        .select("key", F.ceil(F.col("c") / cfg.hot).cast("int").alias("frags"))
    )
    n_hot = hot.count()  # usually none; then the join is left out
    if n_hot:
        rows = rows.join(hot, "key", "left").withColumn("frags", F.greatest(F.coalesce("frags", F.lit(1)), F.lit(1)))
        rows = rows.withColumn("frag", F.expr("cast(pmod(xxhash64(rec), frags) as int)"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, frags - 1)")))
        rows = rows.select("key", F.least("frag", "other").alias("f"), F.greatest("frag", "other").alias("g"), "rec", "n", "w0", "w1", "w2", "w3", "frag")
    else:
        zero = F.lit(0)
        rows = rows.select("key", zero.alias("f"), zero.alias("g"), "rec", "n", "w0", "w1", "w2", "w3", zero.alias("frag"))
    k = partitions_for(reps, 2 << 20)  # a representative is a row of each of its bands here
    blocks = rows.repartition(k, "key", "f", "g").sortWithinPartitions("key", "f", "g", "n")
    return blocks.mapInArrow(_block_batches(cfg), "a long, b long").distinct()


def _exact(cfg: NearDup):
    """Jaccard similarity of the exact shingle sets of two texts."""
    k = cfg.shingle

    def run(batches):
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            ra, rb, rs = [], [], []
            last, x = None, set()
            for i, j, p, q in zip(a, b, ta, tb, strict=True):
                if i != last:
                    s = squeeze(p)
                    last, x = i, {s[o : o + k] for o in range(len(s) - k + 1)}
                s = squeeze(q)
                y = {s[o : o + k] for o in range(len(s) - k + 1)}
                c = len(x & y)
                u = len(x) + len(y) - c
                if u and c >= cfg.similarity * u:
                    ra.append(i)
                    rb.append(j)
                    rs.append(c / u)
            yield pa.RecordBatch.from_arrays([pa.array(ra, pa.int64()), pa.array(rb, pa.int64()), pa.array(rs, pa.float64())], ["a", "b", "similarity"])

    return run


#: log2 of the least and greatest number of bits of the filter of asked ids.
FILTER_BITS = (16, 28)


def _with_ids(shared):
    """Rows whose id may be asked for: the bit map lets few others through, and the join that follows drops them."""

    def run(batches):
        for batch in batches:
            ok = shared.value.has(batch.column(2).to_numpy().view(U))
            if ok.any():
                yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (rec LONG, not NULL, and text) whose rec is in ``ids``, without shuffling the others."""
    shared = rows.sparkSession.sparkContext.broadcast(Bits.of(ids.select(F.xxhash64("rec").alias("h")), "h", FILTER_BITS))
    return rows.select("rec", "text", F.xxhash64("rec").alias("h")).mapInArrow(_with_ids(shared), "rec long, text string").join(ids, "rec", "left_semi")


def similar_classes(records: DataFrame, cfg: NearDup = NearDup(), rec: str = "gen_id", text: str = "response_text") -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives: a, b, similarity; members: rid, rec).

    A class is the records whose normalised texts are equal; its representative ``rid`` is the least
    record.  Records with a NULL key or text, or a normalised text under ``min_chars``, are in no class.
    Several deliveries of a record count once.  Other columns are not read.  Empty input gives empty results.
    """
    sk = materialise(sketches(records, cfg, rec, text), "near-dup-sketch")
    classes = sk.groupBy("th", "th2").agg(F.min("rec").alias("rid"), *(F.first(c).alias(c) for c in ("n", "w0", "w1", "w2", "w3", "keys")))
    reps = classes.select(F.col("rid").alias("rec"), "n", "w0", "w1", "w2", "w3", "keys")
    reps = materialise(reps, "near-dup-class")
    members = sk.select("rec", "th", "th2").distinct()
    first = members.groupBy("th", "th2").agg(F.min("rec").alias("rid"))
    members = members.join(first, ["th", "th2"]).select("rid", "rec")
    cand = materialise(candidate_pairs(reps, cfg), "near-dup-candidates")
    ids = cand.select(F.col("a").alias("rec")).union(cand.select(F.col("b").alias("rec"))).distinct()
    texts = records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text")).where((F.length("text") >= cfg.min_chars) & F.col("rec").isNotNull())
    texts = materialise(rows_of(texts, ids).dropDuplicates(["rec"]), "near-dup-texts")
    both = cand.join(texts.select(F.col("rec").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("rec").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    pairs = both.mapInArrow(_exact(cfg), "a long, b long, similarity double")
    return pairs, members


def near_duplicate_pairs(records: DataFrame, cfg: NearDup = NearDup(), rec: str = "gen_id", text: str = "response_text") -> DataFrame:
    """gen_id_a, gen_id_b: all pairs of records with near-equal texts, copies included.

    A class of more than ``star`` exact copies is given as its membership, that is as pairs of its representative with each
    member, and meets other classes through its representative; every other pair is given.  ``near_duplicate_groups``
    has one form at every size.
    """
    pairs, members = similar_classes(records, cfg, rec, text)
    members = materialise(members, "near-dup-members")
    n = members.groupBy("rid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    many = materialise(members.join(n, "rid"), "near-dup-copies")
    small = many.where(F.col("copies") <= cfg.star)
    x, y = small.select("rid", F.col("rec").alias("a")), small.select("rid", F.col("rec").alias("b"))
    inside = x.join(y, "rid").where("a < b").select("a", "b")
    star = many.where((F.col("copies") > cfg.star) & (F.col("rid") != F.col("rec"))).select(F.col("rid").alias("a"), F.col("rec").alias("b"))
    other = small.where("rid <> rec").select("rid", "rec")
    full = lambda side: F.array_union(F.array(side), F.coalesce("more", F.array().cast("array<long>")))
    more = other.groupBy("rid").agg(F.collect_list("rec").alias("more"))  # at most `star` members each
    p = pairs.select("a", "b")
    p = p.join(more.withColumnRenamed("rid", "a"), "a", "left").select("b", F.explode(full("a")).alias("x"))
    p = p.join(more.withColumnRenamed("rid", "b"), "b", "left").select("x", F.explode(full("b")).alias("y"))
    p = p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return p.union(inside).union(star).select(F.col("a").alias("gen_id_a"), F.col("b").alias("gen_id_b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: connected components, the root being the least node.  Alternating large-star and
    small-star steps, each a bounded group-by; the table is written each round and rounds end when no edge changes."""
    e = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "cc")
    sig = None
    while True:  # the number of rounds grows with the logarithm of the nodes
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(m, "u")
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = materialise(step.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        s = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sig == s:
            break
        sig = s
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.join(e.select(F.col("u").alias("node")), "node", "left_anti"))


def near_duplicate_groups(records: DataFrame, cfg: NearDup = NearDup(), rec: str = "gen_id", text: str = "response_text") -> DataFrame:
    """gen_id, class_id, group_id, n_links: one row per record of ``min_chars`` or more.  class_id: least record with
    the same normalised text; group_id: least record of the connected group; n_links: links of its class to others."""
    pairs, members = similar_classes(records, cfg, rec, text)
    pairs = materialise(pairs, "near-dup-pairs")
    roots = components(pairs)
    links = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").join(links, "rid", "left")
    return out.select(F.col("rec").alias(rec), F.col("rid").alias("class_id"), F.coalesce("root", "rid").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
