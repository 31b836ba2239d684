import base64
import os

import numpy as np
import pytest

from polyphony.llm import packing as P
from polyphony.llm import tokens as T

needs_ranks = pytest.mark.skipif(not os.path.exists(T.DEFAULT_RANKS), reason="no tokenizer files")
TEXTS = ["", " ", "Hello world", "it's  a   test\n\n\tnext", "naïve façade über 12345", "你好，世界。今天天气很好", "🙂🙂 family 👨‍👩‍👧", "a" * 3000, "中" * 700, "x y " * 200, "def f(x):\n    return x\n", "Zażółć gęślą jaźń", "​﻿", "ёж и уж"]


@needs_ranks
def test_counts_equal_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(T.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = T.Counter(T.Ranks.load())
    assert c.count(TEXTS).tolist() == [len(enc.encode_ordinary(t)) for t in TEXTS]
    rng = np.random.default_rng(0)
    noise = ["".join(chr(x) for x in rng.choice([*range(32, 127), *range(0x430, 0x450), 0x3042, 0x4E00], 80)) for _ in range(200)]
    assert c.count(noise).tolist() == [len(enc.encode_ordinary(t)) for t in noise]


@needs_ranks
def test_budget(spark):
    r = spark.createDataFrame([(1, "m", "ds", "EN", "Hello world", 9), (1, "m", "ds", "EN", "Hello world", 9), (2, "m", None, None, None, 9), (None, "m", "ds", "en", "x", 9)], "gen_id long, model string, dataset string, language string, response_text string, n_chars int")
    d = spark.createDataFrame([(7, "s", "en-US", "story", "Hello"), (8, "s", "en", "story", "")], "doc_id long, source string, lang string, domain string, text string")
    got = {(x.rec_type, x.source, x.language, x.slice): (x.n_records, x.n_chars, x.n_tokens) for x in T.token_budget(r, d).collect()}
    assert got == {("response", "m", "en", "ds"): (1, 11, 2), ("response", "m", "unknown", None): (1, 0, 0), ("document", "s", "en", "story"): (2, 5, 1)}
    assert T.token_budget(r.limit(0), d.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 512, 800)
    cfg = P.Packing(max_docs=9, attention_share=0.7)
    b = P.best_fit(np.minimum(size, 400), 512, cfg)
    s = np.minimum(size, 400)
    assert (np.bincount(b, s) <= 512).all() and (np.bincount(b) <= 9).all() and (np.bincount(b, s.astype(float) ** 2) <= 0.7 * 512**2 + 1e-6).all()
    free = P.best_fit(size, 512, P.Packing(max_docs=512, attention_share=1.0))
    assert free.max() + 1 <= 1.03 * max(size.sum() / 512, (size > 256).sum())


def test_pack(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(1, 3000, 700))] + [(5000, 0), (5001, None), (None, 5), (3, 1)]
    sizes = spark.createDataFrame(rows, "doc_id long, tokens long")
    kinds = spark.createDataFrame([("a", 512), ("b", 2048), ("c", None), (None, 7), ("a", 512)], "container_class string, capacity_tokens int")
    cfg = P.Packing(group=100)
    out = P.pack(sizes, kinds, cfg).toPandas()
    want = {}
    for i, n in rows[:700]:
        want[i] = max(n, want.get(i, 0))
    for name, cap in (("a", 512), ("b", 2048)):
        o = out[out.container_class == name]
        assert o.groupby("doc_id").tokens.sum().to_dict() == want
        bins = o.groupby("bin_id").tokens.sum()
        assert (bins <= cap).all() and (o.groupby("bin_id").filled.first() == bins).all()
        assert not o.duplicated(["doc_id", "piece"]).any()
        pieces = o.groupby("doc_id").size()
        assert all(pieces[i] == -(-n // cap) for i, n in want.items())
        assert bins.sum() / (cap * len(bins)) > 0.93
    f = {r.container_class: r for r in P.fill_rates(P.pack(sizes, kinds, cfg)).collect()}
    assert f["a"].n_docs == 700 and f["a"].n_split == sum(n > 512 for n in want.values())


def test_each_capacity_binds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(x)) for i, x in enumerate(np.r_[rng.integers(1, 20, 1500), rng.integers(300, 500, 60)])]
    sizes = spark.createDataFrame(rows, "doc_id long, tokens long")
    kinds = spark.createDataFrame([("a", 512)], "container_class string, capacity_tokens int")
    got = P.pack(sizes, kinds).toPandas()
    by = got.groupby("bin_id").tokens
    assert (by.size() <= 32).all() and (by.sum() <= 512).all()
    cost = (got.tokens.astype(float) ** 2).groupby(got.bin_id).sum()
    assert all(c <= 0.75 * 512**2 or n == 1 for c, n in zip(cost.sort_index(), by.size().sort_index()))
    f = P.fill_rates(P.pack(sizes, kinds)).first()
    assert f.bound_by_docs > 0 and f.bound_by_attention > 0 and f.most_docs == 32 and f.least_bins <= f.n_bins <= 1.15 * f.least_bins


def test_pack_empty(spark):
    sizes, kinds = spark.createDataFrame([], "doc_id long, tokens long"), spark.createDataFrame([], "container_class string, capacity_tokens int")
    assert P.pack(sizes, kinds).count() == 0
    assert P.pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), kinds).count() == 0
