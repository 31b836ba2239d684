import random

import numpy as np
import pytest

from polyphony.llm import near_dup as N
from polyphony.llm.common import squeeze

SCHEMA = "gen_id long, response_text string, rec string, a int"


def grams(t, k=8):
    s = squeeze(t)
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    out = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(90)]
        out.append(" ".join(w))
        for share in (0.02, 0.05, 0.1):
            v = list(w)
            for _ in range(int(len(v) * share)):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
    return out


def brute(rows, least=0.6):
    ok = [(i, grams(t)) for i, t in rows if t is not None and len(squeeze(t)) >= 300]
    out = set()
    for x, (i, a) in enumerate(ok):
        for j, b in ok[x + 1 :]:
            if len(a & b) >= least * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def test_pairs_equal_brute_force(spark):
    rows = list(enumerate(texts(), 10))
    rows += [(1000, rows[0][1].upper()), (1001, "  " + rows[0][1].replace(" ", "\n ")), (1002, None), (1003, ""), (1004, "short"), (1005, "a" * 5000), (1006, "a" * 4000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(10, rows[0][1], "y", 2), (None, rows[1][1], "z", 3)], SCHEMA)
    got = {tuple(r) for r in N.near_duplicate_pairs(df).collect()}
    assert got == brute(rows)
    assert N.near_duplicate_pairs(df).columns == ["gen_id_a", "gen_id_b"]


def test_hot_blocks_are_cut_without_loss(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(160)]
    rows = []
    for i in range(150):
        v = list(base)
        for _ in range(6):
            v[rng.randrange(len(v))] = rng.choice("xyz") * 2
        rows.append((i, " ".join(v) + " pad" * 10))
    df = spark.createDataFrame(rows, "gen_id long, response_text string")
    want = brute(rows)
    assert len(want) > 5000
    got = {tuple(r) for r in N.near_duplicate_pairs(df, N.NearDup(hot=40)).collect()}
    assert got == {tuple(r) for r in N.near_duplicate_pairs(df).collect()}
    assert got <= want and len(got) > 0.99 * len(want)  # many of these pairs lie at the very threshold


def test_hot_keys_are_counted_over_batches():
    import pyarrow as pa

    cfg = N.NearDup(hot=100, bands=2)

    def batch(i):  # one key once in each batch, the other never twice
        return pa.RecordBatch.from_arrays([pa.array([[7, i]], pa.list_(pa.int32()))], ["keys"])

    got = {}
    for b in N._frequent_keys(cfg, 1)(batch(i) for i in range(300)):
        got.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    assert got == {7: 300}


def test_a_small_map_changes_no_result(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts(5, 20))), "gen_id long, response_text string")
    want = {tuple(r) for r in N.near_duplicate_pairs(df).collect()}
    monkeypatch.setattr(N, "FILTER_BITS", (6, 6))
    assert {tuple(r) for r in N.near_duplicate_pairs(df).collect()} == want and want


def test_tiles_find_what_all_pairs_find():
    rng = np.random.default_rng(0)
    n = 1500
    w = rng.integers(0, 2**64, (n // 2, 4), dtype=np.uint64)
    w = np.concatenate([w, w ^ (np.uint64(1) << rng.integers(0, 64, (n // 2, 4), dtype=np.uint64))])
    size = np.sort(rng.integers(50, 200, n))
    cfg = N.NearDup()
    got = {tuple(p) for p in N.tile_pairs(np.zeros(n, np.uint64), size, w, np.zeros(n, int), cfg)}
    want = set()
    for i in range(n):
        d = np.bitwise_count(w[i + 1 :] ^ w[i]).sum(1)
        ok = np.flatnonzero((d <= cfg.radius) & (size[i] >= cfg.similarity * size[i + 1 :]))
        want |= {(i, i + 1 + j) for j in ok.tolist()}
    assert got == want and len(want) > 100


def test_big_class_of_copies_is_a_star(spark):
    t = texts(9, 1)[0]
    df = spark.createDataFrame([(i, t) for i in range(30)], "gen_id long, response_text string")
    got = {tuple(r) for r in N.near_duplicate_pairs(df, N.NearDup(star=10)).collect()}
    assert got == {(0, i) for i in range(1, 30)}
    assert len(N.near_duplicate_pairs(df).collect()) == 30 * 29 // 2


def test_groups(spark):
    rows = list(enumerate(texts(4, 12)))
    df = spark.createDataFrame(rows + [(500, rows[0][1])], "gen_id long, response_text string")
    want = brute(rows + [(500, rows[0][1])])
    root = {i: i for i, _ in rows + [(500, "")]}
    for _ in range(10):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.gen_id: r for r in N.near_duplicate_groups(df).collect()}
    assert {k: r.group_id for k, r in got.items()} == root
    assert got[500].class_id == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicate_pairs(df).count() == 0
    assert N.near_duplicate_groups(df).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], []])
def test_components(spark, edges):
    got = dict(tuple(r) for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {}
    nodes = {x for e in edges for x in e}
    for v in nodes:
        seen, todo = {v}, [v]
        while todo:
            u = todo.pop()
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == u and y not in seen:
                        seen.add(y)
                        todo.append(y)
        want[v] = min(seen)
    assert got == want
