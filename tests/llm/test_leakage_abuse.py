import random

import pytest

from polyphony.llm import abuse as A
from polyphony.llm import leakage as K

WORDS = [f"{a}{b}" for a in ("stone", "river", "paper", "garden", "winter", "copper", "silver", "morning", "village", "market", "harbour", "letter") for b in ("fall", "bank", "path", "ring", "light", "field", "wood", "song", "gate", "wind")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_passages(spark):
    rng = random.Random(1)
    items = [passage(rng, n) for n in (24, 40, 70, 140, 7)]
    docs = []
    for i, it in enumerate(items):
        pad = lambda n: " ".join(passage(rng, n))
        docs.append((100 + i, f"{pad(300)} {' '.join(it)} {pad(200)}"))  # whole
        half = it[: -(-len(it) // 2) + 1]
        docs.append((200 + i, f"{pad(40)}. {'  '.join(w.upper() for w in half)}!\n{pad(900)}"))  # half, other case and spacing
        changed = [w if j % 9 != 4 else "changed" for j, w in enumerate(it)]
        docs.append((300 + i, f"{pad(30)} <b>{'</b>, **'.join(changed[:5])}** {' '.join(changed[5:])}"))
        docs.append((400 + i, f"{pad(100)} {' '.join(it[: len(it) // 3])} {pad(100)}"))  # too short a quote
    docs += [(1, None), (2, ""), (3, "!!!"), (4, "x " * 20_000), (100, docs[0][1])]
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(0, " ".join(items[0])), (50, None), (51, "  "), (None, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in K.leaked(d, e).collect()}
    want = {(100 + i, i) for i in range(5)} | {(200 + i, i) for i in range(4)} | {(300 + i, i) for i in range(4)}
    assert want <= got and not {x for x in got if x[0] >= 400}
    assert {(r.doc_id, r.item_id) for r in K.leaked(d, e, K.Leakage(chunk=2)).collect()} == got


def test_candidates_have_high_recall():
    rng = random.Random(7)
    items = [passage(rng, 40) for _ in range(120)]
    it = K.Items(list(range(120)), [" ".join(x) for x in items], K.Leakage())
    found = 0
    for i, x in enumerate(items):
        doc = passage(rng, 500) + x[8:30] + passage(rng, 400)
        h, off = K._token_hashes([doc])
        s, text, _ = K._shingles(h, off, 5)
        found += (0, i) in {tuple(p) for p in it.candidates(s, text)}
    assert found >= 118


def test_index_time_is_linear():
    import time

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(25)) for _ in range(16_000)]
    took = []
    for n in (2_000, 16_000):
        t = time.perf_counter()
        it = K.Items(list(range(n)), texts[:n], K.Leakage())
        took.append(time.perf_counter() - t)
    assert took[1] < 20 * took[0]
    h, off = K._token_hashes([K.tokens(" ".join(passage(rng, 200)) + " " + texts[777] + " " + " ".join(passage(rng, 100)))])
    s, text, _ = K._shingles(h, off, 5)
    assert (0, 777) in {tuple(p) for p in it.candidates(s, text)}


def test_cjk_and_empty(spark):
    t = "里菲多千万不要着急河岸常常被大家忽略里菲多非常值得付出努力几个星期之后收获的季节打断了工作"
    d = spark.createDataFrame([(1, "前面的话。" + t[:15] + "**" + t[15:] + "。后面"), (2, "完全不同的一篇文章没有关系")], "doc_id long, text string")
    e = spark.createDataFrame([(9, t)], "item_id long, text string")
    assert [tuple(r)[:2] for r in K.leaked(d, e).collect()] == [(1, 9)]
    assert K.leaked(d.limit(0), e).count() == 0 and K.leaked(d, e.limit(0)).count() == 0


def test_reading_documents_equals_tokens():
    rng = random.Random(12)
    parts = [*"abAB zZ*`~ΣσςİßÉ漢かカ1２٩<>&;\n.,'’\u200b\u00ad𝔸_-", "e\u0301", "<b>", "</b>", "&amp;", "__", "**"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    h, off, size = K._read(texts)
    want = [K.tokens(t) for t in texts]
    flat = [w for ws in want for w in ws]
    assert [b - a for a, b in zip(off, off[1:], strict=False)] == [len(ws) for ws in want]
    assert size.tolist() == [len(w) for w in flat]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat, strict=True)))
    assert (K._token_hashes(want)[0] == h).all()


def test_alignments_made_together_equal_single_ones():
    import numpy as np

    def plain(x, y):
        """(score in tenths, end in x, end in y)"""
        best, row = (0, 0, 0), [0] * (len(y) + 1)
        for i, a in enumerate(x, 1):
            new = [0]
            for j, b in enumerate(y, 1):
                new.append(max(0, row[j - 1] + (10 if a == b else -12), row[j] - 15, new[-1] - 15))
                if new[j] > best[0]:
                    best = (new[j], i, j)
            row = new
        return best

    rng = random.Random(8)
    asks = []
    for _ in range(300):
        x, y = ([rng.randrange(2, 32) for _ in range(rng.randrange(a, b))] for a, b in ((1, 50), (0, 70)))
        a = rng.randrange(len(x))
        y[len(y) // 2 : len(y) // 2] = [v if rng.random() < 0.85 else 40 for v in x[a : a + 20]]
        asks.append((np.array(x, K.U), np.array(y, K.U), rng.choice([0.0, 0.17 * len(x)])))
    got = K.passages(asks)
    for (x, y, least), r in zip(asks, got, strict=True):
        score, i, j = plain(x.tolist(), y.tolist())
        want = (i - plain(x[:i][::-1].tolist(), y[:j][::-1].tolist())[1], i) if i and score >= 10 * least - 1e-9 else (0, 0)
        assert r == want


def test_common_phrases_cost_little():
    """Documents that share phrases with many items: the search must not cost many times what cutting them into words does."""
    import time

    import pyarrow as pa

    rng = random.Random(21)
    phrases = [" ".join(passage(rng, 9)) for _ in range(150)]
    text = lambda n: ". ".join(rng.choice(phrases) + " " + " ".join(passage(rng, 6)) for _ in range(n))
    items = [text(4) for _ in range(150)]
    docs = [text(14) for _ in range(2000)]
    docs[7] += items[3]

    class Shared:
        value = K.Items(list(range(150)), items, K.Leakage())

    def cost(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    got = []
    search = min(cost(lambda: got.append([tuple(r.values())[:2] for b in K._search(Shared)(iter([batch])) for r in b.to_pylist()])) for _ in range(2))
    read = min(cost(lambda: [K.tokens(t) for t in docs]) for _ in range(2))
    assert (7, 3) in got[0] and search < 11 * read


def test_pieces_give_equal_results(monkeypatch):
    import pyarrow as pa

    rng = random.Random(22)
    phrases = [passage(rng, 9) for _ in range(25)]
    words = lambda n: [w for _ in range(n) for w in (*rng.choice(phrases), *passage(rng, 4))]
    items = [words(3) for _ in range(40)]
    docs = [" ".join(words(6) + rng.choice(items)[: rng.randrange(40)] + words(5)) for _ in range(80)] + ["", "!!"]

    class Shared:
        value = K.Items(list(range(40)), [" ".join(x) for x in items], K.Leakage())

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    search = lambda: sorted(tuple(r.values()) for b in K._search(Shared)(iter([batch])) for r in b.to_pylist())
    want = search()
    for name, value in (("CHARS", 3000), ("WAITING", 3), ("READINGS", 2), ("CELLS", 300)):
        monkeypatch.setattr(K, name, value)
        assert search() == want
    assert len(want) >= 20


def bad_corpus(n, seed):
    rng = random.Random(seed)
    fine = ["the garden needs regular care", "a short walk takes time", "the library opens early", "we met near the old station", "the teacher explains the rule", "reports must list every insult", "calling someone a blorf is against the rules"]
    rude = ["you are a stupid blorf", "get lost you filthy blorf", "shut up you stupid grunk", "nobody likes a filthy grunk like you"]
    out = []
    for _ in range(n):
        s = [rng.choice(fine) for _ in range(rng.randint(3, 8))]
        bad = rng.random() < 0.3
        if bad:
            s.insert(rng.randrange(len(s)), rng.choice(rude))
        out.append((". ".join(s).capitalize() + ".", "abusive" if bad else "none"))
    return out


@pytest.fixture(scope="module")
def abuse_model():
    c = bad_corpus(700, 1)
    rng = random.Random(2)
    labels = [lab if rng.random() > 0.03 else ("none" if lab != "none" else "abusive") for _, lab in c]  # raters err
    return A.fit([t for t, _ in c], labels)


def test_held_out(abuse_model):
    c = bad_corpus(300, 9)
    score, _ = A.assess(abuse_model, [t for t, _ in c])
    hit = sum((s >= 0.6) == (lab != "none") for s, (_, lab) in zip(score, c, strict=True))
    assert hit >= 285


def test_disguises(abuse_model):
    texts = ["You are a stuuuupid blorf.", "YOU ARE A STUPID BLORF!", "You are a s t u p i d blorf.", "you are a stu​pid bl0rf"]
    score, cls = A.assess(abuse_model, texts)
    assert (score >= 0.6).all() and all(A.CLASSES[c] == "abusive" for c in cls)


def test_scores(spark, abuse_model):
    d = spark.createDataFrame([(1, "You are a stupid blorf.", "s", "z"), (1, "You are a stupid blorf.", "s", "z"), (2, None, "s", "z"), (3, "", None, "z"), (4, "The garden needs regular care.", "s", "z"), (5, "The library opens early. " * 3000, "t", "z")], "doc_id long, text string, source string, label string")
    none = spark.createDataFrame([], "doc_id long, label string, rater string")
    got = {r.doc_id: r for r in A.scores(d, none, model=abuse_model).collect()}
    assert got[1].label == "abusive" and got[2].score == 0 and got[3].label == "none" and got[4].label == "none" and got[5].label == "none"
    assert A.flagged(d, none).count() == 0
    assert {r.source: r.n for r in A.rates(d, none).collect()} == {"s": 4, None: 1, "t": 1}
    assert A.scores(d.limit(0), none).count() == 0


def test_training_from_tables(spark):
    c = bad_corpus(400, 4)
    d = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(c)], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, x, "r") for i, (_, x) in enumerate(c[:300])] + [(0, c[0][1], "r2"), (None, "none", "r"), (7777, "abusive", "r")], "doc_id long, label string, rater string")
    got = {r.doc_id for r in A.flagged(d, lab).collect()}
    want = {i for i, (_, x) in enumerate(c) if x != "none"}
    assert len(got ^ want) <= 0.08 * len(c)


def test_threshold_follows_the_share_of_the_corpus():
    import numpy as np

    rng = np.random.default_rng(3)
    # Clean documents score up to 0.7 in one of fifty cases; bad ones from 0.6 on.
    clean = lambda n: np.where(rng.random(n) < 0.02, rng.uniform(0.3, 0.7, n), rng.uniform(0, 0.1, n))
    bad = rng.uniform(0.6, 1.0, 1000)
    label = np.r_[np.ones(1000), np.zeros(5000), -np.ones(20_000)].astype(int)
    rich = np.r_[bad, clean(5000), rng.choice(bad, 10_000), clean(10_000)]
    poor = np.r_[bad, clean(5000), rng.choice(bad, 400), clean(19_600)]
    w = np.ones(len(label))
    lo, hi = A.best_threshold(rich, label, w, 0.5), A.best_threshold(poor, label, w, 0.5)
    assert 0.1 < lo < hi and 0.6 < hi < 0.75
    assert A.best_threshold(poor[:0], label[:0], w[:0], 0.5) == 0.5
    assert A.best_threshold(poor[1000:], label[1000:], w[1000:], 0.4) == 0.4


def test_slips_of_raters_do_not_teach():
    c = bad_corpus(900, 5)
    rng = random.Random(6)
    labels = ["abusive" if lab == "none" and rng.random() < 0.1 else lab for _, lab in c]  # one clean document in ten is called bad
    m = A.fit([t for t, _ in c], labels)
    held = bad_corpus(300, 8)
    score, _ = A.assess(m, [t for t, _ in held])
    hit = sum((s >= m.threshold) == (lab != "none") for s, (_, lab) in zip(score, held, strict=True))
    assert hit >= 288


def labelled_corpus(spark, n=600):
    """Documents in which every third has a sentence of its own rude word; all of the first ``n`` have labels."""
    c = bad_corpus(n + 300, 11)
    d = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(c)], "doc_id long, text string, source string")
    return c, d, spark.createDataFrame([(i, x, "r") for i, (_, x) in enumerate(c[:n])], "doc_id long, label string, rater string")


def test_every_label_trains(spark, monkeypatch):
    seen = []
    fit_folds = A._fit_folds
    monkeypatch.setattr(A, "_fit_folds", lambda rows, folds, *a: (seen.append({r.doc_id for r in rows.where("y >= 0").select("doc_id").collect()}), fit_folds(rows, folds, *a))[1])
    _, d, lab = labelled_corpus(spark)
    A.train(d, lab)
    assert len(seen) == 3 and all(x == set(range(600)) for x in seen)
    # No parameter bounds how many labels or unlabelled documents are used.
    assert not {"max_labels", "max_clean", "negatives", "background"} & set(A.Abuse.__dataclass_fields__)


def test_every_unlabelled_document_counts_for_the_threshold(spark, monkeypatch):
    counted = []
    best = A._best
    monkeypatch.setattr(A, "_best", lambda hit, slip, rest, n_bad, n_clean, fallback: (counted.append((rest, n_bad, n_clean)), best(hit, slip, rest, n_bad, n_clean, fallback))[1])
    c, d, lab = labelled_corpus(spark)
    d = d.union(d.where("doc_id >= 600").selectExpr("doc_id + 10000", "text", "source")).union(d.selectExpr("doc_id + 20000", "cast(null as string)", "source"))
    A.train(d, lab)
    (rest, n_bad, n_clean), = counted
    assert n_clean == sum(x == "none" for _, x in c[:600]) and n_bad <= sum(x != "none" for _, x in c[:600])
    assert all(abs(x * 600 - round(x * 600)) < 1e-6 for x in rest)  # shares of all 600 unlabelled texts, NULL ones left out


def test_shards_meet_after_each_epoch(spark):
    c, d, lab = labelled_corpus(spark)
    want = {i for i, (_, x) in enumerate(c) if x != "none"}
    for shard_chars in (12_000_000, 40_000):
        got = {r.doc_id for r in A.flagged(d, lab, A.Abuse(shard_chars=shard_chars)).collect()}
        assert len(got ^ want) <= 0.05 * len(c)


def read_plainly(texts):
    """(words, sentence of each, text of each): the words of abuse.Bags by regular expressions."""
    import re

    word = r"(?:[^\W぀-ヿ㐀-鿿]|[@$*])+"
    token = re.compile(rf"{word}(?:['’*]{word})*|[぀-ヿ㐀-鿿]|[.!?…]+(?!\w)|[。！？;；]|\n+|[()（）“”«»「」|]")
    words, sent, text, s = [], [], [], 0
    for i, t in enumerate(texts):
        s += 1
        for w in token.findall(A.clean(t)):
            if w[0] in ".!?…。！？;；\n()（）“”«»「」|":
                s += 1
            else:
                words.append(w), sent.append(s), text.append(i)
    return words, sent, text


def test_reading_equals_regular_expressions():
    rng = random.Random(12)
    letters = "aabBcé_0133@$*'’..!?… \n\n··--;；。！？()（）「」|«»“”あいー日本・々­​﻿٣ß²́\ud800😀ſＡ\r\t"
    for _ in range(3000):
        texts = ["".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(rng.randrange(6))]
        words, sent, text = read_plainly(texts)
        b = A.Bags(texts, A.Abuse())
        first = [i for i in range(len(sent)) if not i or sent[i] != sent[i - 1]]
        assert [b.words[c] for c in b.codes] == words and b.first.tolist() == first and b.text.tolist() == [text[i] for i in first]


def test_reading_costs_less_than_regular_expressions():
    from time import process_time

    rng = random.Random(13)
    texts = [". ".join(" ".join(passage(rng, 10)) for _ in range(10)) for _ in range(1000)]

    def cost(f):
        f(texts[:10])
        began = process_time()
        f(texts)
        return process_time() - began

    assert min(cost(lambda t: A.Bags(t, A.Abuse())) for _ in range(3)) < 0.7 * min(cost(read_plainly) for _ in range(3))


def test_training_equals_plain_sums():
    import numpy as np

    cfg = A.Abuse(buckets=1 << 10, batch=16)  # many buckets are shared by words
    c = bad_corpus(40, 14) + [("ab" * 60 + "c and a long word, ab ab ab.", "none")]
    bags = A.Bags([t for t, _ in c], cfg)
    y = np.array([A.CLASSES.index(x) for _, x in c])[bags.text]
    weight = np.where(y > 0, 2, 1).astype(np.float32)
    pick = np.arange(len(y))
    parts = bags.parts(pick, cfg.buckets)
    got = A.State(cfg, 5)
    A._fit_round(parts, y, weight, got, 2, np.random.default_rng(6))

    (word, n_word), (more, n_more), (sub, n_sub) = parts
    subs, words, mores = (np.split(x, np.cumsum(n)[:-1]) for x, n in ((sub, n_sub), (word, n_word), (more, n_more)))
    assert max(n_sub) > A._TALL
    feats = [np.concatenate([*(subs[w] for w in ws), m]) for ws, m in zip(words, mores, strict=True)]
    want, rng = A.State(cfg, 5), np.random.default_rng(6)
    o, b, go, gb = want.heads()
    for _ in range(2):
        order = rng.permutation(len(y))
        for start in range(0, len(order), cfg.batch):
            p = order[start : start + cfg.batch]
            x = np.array([want.e[feats[i]].mean(0) for i in p])
            z = np.exp(x @ o + b)
            q = z / z.sum(1, keepdims=True)
            q[np.arange(len(p)), y[p]] -= 1
            q *= weight[p][:, None] / len(p)
            de = np.zeros_like(want.e)
            for i, g in zip(p, q @ o.T, strict=True):
                np.add.at(de, feats[i], g / len(feats[i]))
            want.ge += (de * de).mean(1)
            want.e -= cfg.rate * de / np.sqrt(want.ge)[:, None]
            do, db = x.T @ q, q.sum(0)
            go += do * do
            gb += db * db
            o -= cfg.rate * 0.3 * do / np.sqrt(go)
            b -= cfg.rate * 0.3 * db / np.sqrt(gb)
    assert np.allclose(got.e, want.e, atol=1e-4) and np.allclose(got.top, want.top, atol=1e-4)
    assert np.array_equal(np.flatnonzero(got.seen), np.unique(np.concatenate(feats)))
