"""Abusive, hateful and sexual content: subword-bag embeddings under a linear softmax, trained in numpy.

A sentence is the mean of the embeddings of its features: for each word the character n-grams of the
word (so a misspelling shares most of them) and the word itself, and for word pairs and triples a hashed
bucket.  A linear softmax over (none, abusive, hateful, sexual) stands on the mean; embeddings and
output weights are trained together.  Labels are per document, while one sentence makes a document bad,
so training goes in rounds: in a bad document only the sentences that the last round holds to be the worst
stay positive.  Every sentence of every clean labelled document is a negative, and so, with a low weight, is each sentence
of an unlabelled document that the first round takes for bad by mistake: what is common in the corpus is no sign of badness.
Raters slip: a document labelled bad whose worst sentence looks no worse than those of clean documents do is set aside.

Labelled documents are richer in bad ones than the corpus, so no threshold is right for both.  The threshold is taken
where the F measure is best at the corpus's own share of bad documents, over scores of documents by models that have
not seen them; the share comes from the same scores of all unlabelled documents.

Nothing is drawn: all labels train, all documents are searched for mistakes and counted for the threshold.  Training rows are
dealt to shards of bounded size; each shard is one task, and where there are several, each epoch ends with the mean of their
parameters, over the shards that touched a feature.

Since everything behind the embeddings is linear, each feature bucket has a fixed contribution to the
logits after training; scoring is one map over the corpus with the contributions of each distinct word cached.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.llm.common import U, code_points, mix, spread
from polyphony.session import materialise

CLASSES = ("none", "abusive", "hateful", "sexual")


@dataclass(frozen=True)
class Abuse:
    """Parameters.  ``hard``: the share of clean sentences that look better than a sentence of an unlabelled document must to be no mistake to learn from,
    ``background_weight``: the weight of such a sentence, ``shard_chars``: characters of training text a task, ``slip``: by
    round, the share of clean documents that look better than a document labelled bad must to stay one, ``threshold``:
    where nothing can be calibrated."""

    buckets: int = 1 << 18
    dim: int = 12
    rounds: int = 2
    epochs: int = 5
    rate: float = 0.3
    batch: int = 128
    hard: float = 0.95
    background_weight: float = 0.5
    shard_chars: int = 12_000_000
    threshold: float = 0.6
    slip: tuple[float, ...] = (0.0, 0.8, 0.95)
    seed: int = 3


_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .·_-]{1,3}){3,}\w(?!\w)")
_RUN = re.compile(r"(\w)\1{2,}")
_LEET = str.maketrans("0134578@$€", "oieastbase")
#: What a character may be, as bits: of a word, an apostrophe that may join two words, a CJK character, a stop, a break, \w, a gap in spaced-out words, invisible.
_LETTER, _JOIN, _CJK, _STOP, _BREAK, _ALNUM, _GAP, _UNSEEN = (1 << i for i in range(8))


def _kinds() -> np.ndarray:
    """The bits of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = np.arange(len(out), dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    for pattern, bits in ((re.compile(r"\w"), _ALNUM | _LETTER), (_INVISIBLE, _UNSEEN)):
        for m in re.finditer(f"{pattern.pattern}+", every):
            out[m.start() : m.end()] |= np.uint8(bits)
    for i, j in (("぀", "ヿ"), ("㐀", "鿿")):
        at = slice(ord(i), ord(j) + 1)
        out[at] = out[at] & ~np.uint8(_LETTER) | _CJK
    for bit, chars in ((_LETTER, "@$*"), (_JOIN, "'’"), (_STOP, ".!?…"), (_BREAK, "。！？;；\n()（）“”«»「」|"), (_GAP, " .·_-")):
        out[list(map(ord, chars))] |= np.uint8(bit)
    return out


_KINDS: list[np.ndarray] = []


def _read(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, each with a line end, end to end; code points; bits of each; where each text ends)."""
    if not _KINDS:
        _KINDS.append(_kinds())
    blob = "\n".join([*texts, ""])
    a, _ = code_points([blob])
    return blob, a, _KINDS[0].take(a), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)


def clean(text: str) -> str:
    """Undo plain disguises: invisible characters, spaced-out words, stretched letters."""
    t = _INVISIBLE.sub("", text)
    t = _SPACED.sub(lambda m: re.sub(r"[ .·_-]+", "", m[0]) if not any(c.isdigit() for c in m[0]) else m[0], t)
    return _RUN.sub(r"\1", t)


def _disguised(a: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places in texts that ``clean`` may change: none are missed."""
    word, gap = (kind & _ALNUM) != 0, (kind & _GAP) != 0
    at = (kind & _UNSEEN) != 0
    at[2:] |= (a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & word[2:]
    # Four word characters or more, with one to three gaps between each two.
    two = gap[:-1] & gap[1:]
    three = two[:-1] & gap[2:]
    chain = word
    for _ in range(3):
        after = np.zeros(len(a), bool)  # a gap that leads on to the chain starts here
        after[:-1] = gap[:-1] & chain[1:]
        after[:-2] |= two[:-1] & chain[2:]
        after[:-3] |= three[:-1] & chain[3:]
        chain = word.copy()
        chain[:-1] &= after[1:]
        chain[-1] = False
    return np.flatnonzero(at | chain)


_DIGITS = re.compile(r"[0134578@$€]")


def _plain(word: str) -> str:
    """Lower case, with the usual stand-ins for letters undone in words that have letters."""
    w = word.lower()
    if w.isalpha():
        return w
    if _DIGITS.search(w) and any(c.isalpha() for c in w):
        return w.translate(_LEET)
    return "0" if w.isdigit() else w


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(_plain(word).encode("utf-8", "surrogatepass"))


def word_buckets(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, number for each word): its character 3- and 4-grams, ends marked, and the word itself, hashed."""
    plain = [f"<{_plain(w)}>" for w in words]
    a, off = code_points(plain)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(words)), size)
    left = off[1:][owner] - np.arange(len(a))
    owners, feats = [np.arange(len(words))], [np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in plain], U)]
    h = np.zeros(len(a), U)
    for k in range(4):
        m = max(0, len(a) - k)
        h[:m] = mix(h[:m] * U(3) + a[k:].astype(U) + U(k))
        if k >= 2:
            ok = left > k
            owners.append(owner[ok])
            feats.append(h[ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(feats)[order] % U(n)).astype(np.int64), np.bincount(owners, minlength=len(words))


def _tokens(texts: list[str]):
    """(hash, sentence, text of each word; hash and spelling of each distinct word)."""
    blob, a, kind, ends = _read(texts)
    if len(at := _disguised(a, kind) if len(a) > 3 else np.arange(len(a))):
        texts = list(texts)
        for i in np.unique(np.searchsorted(ends, at, "right")).tolist():
            texts[i] = clean(texts[i])
        blob, a, kind, ends = _read(texts)
    # Words are runs of letters, which one apostrophe between two letters joins; a CJK character is a word.
    letter, cjk = (kind & _LETTER) != 0, (kind & _CJK) != 0
    letter[1:-1] |= ((kind[1:-1] & _JOIN) != 0) & letter[:-2] & letter[2:]
    begins, stops = letter | cjk, letter | cjk
    begins[1:] &= cjk[1:] | ~letter[:-1]
    stops[:-1] &= cjk[:-1] | ~letter[1:]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    # A stop before a word character, as in a.b, ends no sentence.
    sep = (kind & _STOP) != 0
    sep[:-1] &= (kind[1:] & _ALNUM) == 0
    sep |= (kind & _BREAK) != 0
    sent = np.cumsum(sep, dtype=np.int32)[begins]
    text = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, np.searchsorted(begins, ends)]))
    # Equal words are found by 64-bit sums over their characters and places.
    sums = np.zeros(len(begins), U)
    for o in range(0, len(begins), 1 << 14):
        i, size = begins[o : o + (1 << 14)], (stops - begins)[o : o + (1 << 14)]
        place = _ranges(np.zeros_like(i), size)
        sums[o : o + len(i)] = np.add.reduceat(mix(a[np.repeat(i, size) + place] + (place.astype(U) << U(32)) + U(1)), np.cumsum(size) - size)
    codes, distinct = pd.factorize(sums)
    one = np.zeros(len(distinct), np.int64)
    one[codes] = np.arange(len(sums))
    return sums, sent, text, distinct, [blob[i:j] for i, j in zip(begins[one].tolist(), stops[one].tolist(), strict=True)]


class Bags:
    """Sentences of texts as bags of words, word pairs and word triples, with the text of each."""

    def __init__(self, texts: list[str], cfg: Abuse):
        # By a thousand texts, so that what is as long as the texts stays small.
        got = [_tokens(texts[o : o + 1000]) for o in range(0, len(texts) or 1, 1000)]
        texts_before, sents_before = 1000 * np.arange(len(got)), np.cumsum([0, *(g[1][-1] + 1 if len(g[1]) else 0 for g in got)])
        text = np.concatenate([g[2] + o for g, o in zip(got, texts_before, strict=True)])
        sent = np.concatenate([g[1] + o for g, o in zip(got, sents_before[:-1], strict=True)])
        self.codes, distinct = pd.factorize(np.concatenate([g[0] for g in got]))
        words = np.empty(len(distinct), dtype=object)
        words[pd.factorize(np.concatenate([g[3] for g in got]))[0]] = [w for g in got for w in g[4]]
        first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]]) if len(sent) else np.zeros(0, np.int64)
        self.words, self.first, self.text = words, first, text[first]
        self._cache: dict[int, np.ndarray] = {}
        self.stop = np.r_[first[1:], len(sent)]
        h = np.fromiter(map(_hash, words), U, len(words))[self.codes]
        same2 = np.r_[sent[1:] == sent[:-1], False] if len(sent) else np.zeros(0, bool)
        same3 = np.r_[sent[2:] == sent[:-2], False, False] if len(sent) > 1 else np.zeros(len(sent), bool)
        nxt = np.roll(h, -1)
        pair = mix(h * U(3) + nxt)
        self.pair = np.where(same2, (pair % U(cfg.buckets)).astype(np.int64), -1)
        self.triple = np.where(same3, (mix(pair * U(3) + np.roll(h, -2)) % U(cfg.buckets)).astype(np.int64), -1)

    @property
    def long_enough(self) -> np.ndarray:
        """Two words, or four CJK characters, or more: shorter pieces are not judged."""
        n = self.stop - self.first
        wide = np.array(["぀" <= w[0] <= "鿿" for w in self.words], bool)
        return n >= np.where(wide[self.codes[self.first]], 4, 2) if len(n) else np.zeros(0, bool)

    def parts(self, pick: np.ndarray, n: int):
        """Of the picked sentences: (words, number a sentence), (pair and triple buckets, number a sentence), (buckets of
        each distinct word, number a word); words are numbered anew."""
        size = (self.stop - self.first)[pick]
        at = _ranges(self.first[pick], size)
        used, word = np.unique(self.codes[at], return_inverse=True)
        new = [c for c in used.tolist() if c not in self._cache]
        if new:
            flat, k = word_buckets([self.words[c] for c in new], n)
            self._cache.update(zip(new, np.split(flat, np.cumsum(k)[:-1]), strict=True))
        sub = [self._cache[c] for c in used.tolist()]
        owner = np.repeat(np.arange(len(pick)), size)
        more = np.stack([self.pair[at], self.triple[at]], 1)
        ok = more >= 0
        return (word, size), (more[ok], np.bincount(np.repeat(owner, 2)[ok.ravel()], minlength=len(pick))), (np.concatenate(sub), np.array([len(x) for x in sub], np.int64))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs of given starts and sizes, end to end."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _distinct(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, the place of each of x among them, which of x is the last of its value); at: room for a place a possible value."""
    i = np.arange(len(x))
    at[x] = i
    last = at.take(x)
    lead = last == i
    return x.compress(lead), (np.cumsum(lead) - 1).take(last), lead


def _sum_rows(rows: np.ndarray, pick: np.ndarray, to: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The sums of the picked rows by value, as ``_distinct`` tells the values apart: the last row of each and, where there are, others."""
    out = rows.take(pick.compress(lead), axis=0)
    rest = np.flatnonzero(~lead)
    if len(rest):
        k = rows.shape[1]
        np.add.at(out.reshape(-1), (to.take(rest)[:, None] * k + np.arange(k)).ravel(), rows.take(pick.take(rest), axis=0).ravel())
    return out


#: Rows that are added up one by one in ``_pile``.
_TALL = 64


def _pile(rows: np.ndarray, tall: np.ndarray) -> np.ndarray:
    """Sums of piles: rows has the lowest row of each pile, then the second ones of the first tall[1] piles, which have one, and so on."""
    out, at = rows[: tall[0]].copy(), int(tall[0])
    for n in tall[1:_TALL].tolist():
        out[:n] += rows[at : at + n]
        at += n
    if len(tall) > _TALL:
        rest = tall[_TALL:]
        np.add.at(out, _ranges(np.zeros_like(rest), rest), rows[at : at + int(rest.sum())])
    return out


class Model:
    """Contribution of each bucket to the logits, the bias, and the score from which a document is bad."""

    def __init__(self, cfg: Abuse, table: np.ndarray, bias: np.ndarray, threshold: float | None = None):
        self.cfg, self.table, self.bias, self.threshold = cfg, table, bias, cfg.threshold if threshold is None else threshold
        self._seen: dict[str, int] = {}
        self._rows: np.ndarray | None = None
        self._table: np.ndarray | None = None

    def __reduce__(self):
        return Model, (self.cfg, self.table, self.bias, self.threshold)

    def _words(self, words) -> np.ndarray:
        """Per word: summed contribution and number of features."""
        if len(self._seen) > 400_000:
            self._seen, self._rows = {}, None
        new = [w for w in words if w not in self._seen]
        if new:
            f, k = word_buckets(new, self.cfg.buckets)
            v = np.concatenate([np.add.reduceat(self.table.take(f, axis=0), np.cumsum(np.r_[0, k[:-1]])), k[:, None]], 1).astype(np.float32)
            base = len(self._seen)
            for i, w in enumerate(new):
                self._seen[w] = base + i
            self._rows = v if self._rows is None else np.concatenate([self._rows, v])
        return self._rows[np.fromiter((self._seen[w] for w in words), np.int64, len(words))]

    def score(self, b: Bags) -> np.ndarray:
        """Class probabilities of each sentence; of several models together (see ``together``), those of each side by side."""
        if not len(b.first):
            return np.zeros((0, len(self.bias)))
        if self._table is None:
            self._table = np.concatenate([self.table, np.zeros((1, self.table.shape[1]), self.table.dtype)])  # row -1: no pair, no triple
        rows = self._words(b.words)
        v = np.ascontiguousarray(rows[:, :-1]).take(b.codes, axis=0)
        n = rows[:, -1].take(b.codes)
        for x in (b.pair, b.triple):
            v += self._table.take(x, axis=0)
            n += x >= 0
        z = np.add.reduceat(v, b.first) / np.maximum(np.add.reduceat(n, b.first), 1)[:, None] + self.bias
        z = z.reshape(len(z), -1, len(CLASSES))
        z = np.exp(z - z.max(2, keepdims=True))
        return (z / z.sum(2, keepdims=True)).reshape(len(z), -1)


def together(models: list[Model]) -> Model:
    """Models that read a text only once."""
    return Model(models[0].cfg, np.concatenate([m.table for m in models], 1), np.concatenate([m.bias for m in models]))


class State:
    """Embeddings, output weights and bias, their Adagrad sums, and which buckets have been trained."""

    def __init__(self, cfg: Abuse, seed):
        rng = np.random.default_rng(seed)
        self.cfg, self.seen = cfg, np.zeros(cfg.buckets, bool)
        self.e, self.ge = rng.normal(0, 0.1, (cfg.buckets, cfg.dim)).astype(np.float32), np.full(cfg.buckets, 1e-4, np.float32)
        k = len(CLASSES)
        self.top = np.r_[rng.normal(0, 0.1, cfg.dim * k), np.zeros(k), np.full(cfg.dim * k + k, 1e-4)].astype(np.float32)

    def heads(self):
        """Views of (output weights, bias, sums of either)."""
        n, k = self.cfg.dim * len(CLASSES), len(CLASSES)
        o, b, go, gb = np.split(self.top, [n, n + k, 2 * n + k])
        return o.reshape(-1, k), b, go.reshape(-1, k), gb

    def model(self) -> Model:
        table = np.zeros((self.cfg.buckets, len(CLASSES)), np.float32)
        o, b, _, _ = self.heads()
        table[self.seen] = self.e[self.seen] @ o
        return Model(self.cfg, table, b if self.seen.any() else np.array([5.0, 0, 0, 0], np.float32))

    def blocks(self, used: np.ndarray):
        """(number, float32 bytes) of blocks of trained buckets, -1 being the heads: embeddings, sum, 1, or zeros where not trained here."""
        yield -1, np.r_[self.top, np.float32(1)].tobytes()
        on = np.zeros(len(self.seen), bool)
        on[used] = True
        for i in range(0, len(on), BLOCK):
            m = on[i : i + BLOCK, None]
            if m.any():
                yield i // BLOCK, (np.concatenate([self.e[i : i + BLOCK], self.ge[i : i + BLOCK, None], m], 1) * m).astype(np.float32).tobytes()

    def take(self, number: int, total: np.ndarray) -> None:
        """The mean of a block over the shards that trained it, from the sum."""
        if number < 0:
            self.top = (total[:-1] / total[-1]).astype(np.float32)
            return
        x = total.reshape(-1, self.cfg.dim + 2)
        on = np.flatnonzero(x[:, -1])
        at = number * BLOCK + on
        self.e[at], self.ge[at], self.seen[at] = x[on, :-2] / x[on, -1:], x[on, -2] / x[on, -1], True


#: Buckets of a block of parameters on its way to the driver.
BLOCK = 1024


def _fit_round(parts, y, weight, state: State, epochs: int, rng) -> np.ndarray:
    """Adagrad over embeddings and output weights together, in place; the buckets trained.

    Words are summed up once a batch and their gradients spread over their n-grams once a batch."""
    (word, n_word), (more, n_more), (sub, n_sub) = parts
    cfg = state.cfg
    # Words and buckets are numbered anew, frequent ones first, so that what is often read lies together.
    often = np.bincount(word, minlength=len(n_sub))
    count = np.bincount(more, minlength=cfg.buckets) + np.bincount(sub, np.repeat(often, n_sub), cfg.buckets).astype(np.int64)
    by = np.argsort(-often, kind="stable")
    sub, n_sub, word = sub.take(_ranges((np.cumsum(n_sub) - n_sub).take(by), n_sub.take(by))), n_sub.take(by), np.argsort(by).take(word)
    used = np.flatnonzero(count)
    used = used.take(np.argsort(-count.take(used), kind="stable"))
    local = np.zeros(cfg.buckets, np.int64)
    local[used] = np.arange(len(used))
    sub, more = local.take(sub), local.take(more)
    at_word, at_more, at_sub = (np.cumsum(n) - n for n in (n_word, n_more, n_sub))
    size = (np.add.reduceat(n_sub.take(word), at_word) + n_more).astype(np.float32)[:, None]
    e, ge = state.e[used], state.ge[used]
    whole = e.view(f"V{e.itemsize * cfg.dim}").ravel()  # embeddings as single values, which are stored faster than rows
    o, b, go, gb = state.heads()
    where, turn, last = np.zeros(len(n_sub), np.int64), np.zeros(len(n_sub), np.int64), np.zeros(len(used), np.int64)
    ones = np.full(cfg.dim, 1 / cfg.dim, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(size))
        n_words, n_mores = n_word.take(order), n_more.take(order)
        words, mores = word.take(_ranges(at_word.take(order), n_words)), more.take(_ranges(at_more.take(order), n_mores))
        to_word, to_more = np.r_[0, np.cumsum(n_words)], np.r_[0, np.cumsum(n_mores)]
        for start in range(0, len(order), cfg.batch):
            p = order[start : start + cfg.batch]
            stop = start + len(p)
            said, g = words[to_word[start] : to_word[stop]], mores[to_more[start] : to_more[stop]]
            nw, nm = n_words[start:stop], n_mores[start:stop]
            w, inv, lead_w = _distinct(said, where)
            # The first buckets of all words, then their second ones and so on, words with most of them first.
            nf = n_sub.take(w)
            down = np.argsort(-nf)
            deep = nf.take(down)
            tall = np.searchsorted(-deep, -np.arange(deep[0]), "left")
            of_word = _ranges(np.zeros_like(tall), tall)
            f = sub.take(at_sub.take(w.take(down)).take(of_word) + np.repeat(np.arange(len(tall)), tall))
            ids = np.concatenate([f, g])
            rows = e.take(ids, axis=0)
            turn[down] = np.arange(len(w))
            x = np.add.reduceat(_pile(rows, tall).take(turn.take(inv), axis=0), to_word[start:stop] - to_word[start])
            some = np.flatnonzero(nm)
            if len(some):
                x[some] += np.add.reduceat(rows[len(f) :], (to_more[start:stop] - to_more[start])[some])
            of = size.take(p, axis=0)
            x /= of
            z = x @ o + b
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(p)), y[p]] -= 1
            q *= weight[p][:, None] / len(p)
            do, db = x.T @ q, q.sum(0)
            dx = ((q @ o.T) / of).astype(np.float32)
            dw = _sum_rows(dx, np.repeat(np.arange(len(p)), nw), inv, lead_w).take(down, axis=0)
            u, to, lead = _distinct(ids, last)
            de = _sum_rows(np.concatenate([dw, dx]), np.concatenate([of_word, np.repeat(np.arange(len(w), len(w) + len(p)), nm)]), to, lead)
            s = ge.take(u) + (de * de) @ ones
            ge[u] = s
            de *= (cfg.rate / np.sqrt(s))[:, None]
            new = rows.compress(lead, axis=0)
            new -= de
            np.put(whole, u, new.view(whole.dtype).ravel())
            go += do * do
            gb += db * db
            o -= cfg.rate * 0.3 * do / np.sqrt(go)
            b -= cfg.rate * 0.3 * db / np.sqrt(gb)
    state.e[used], state.ge[used], state.seen[used] = e, ge, True
    return used


def best_threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray, fallback: float) -> float:
    """Where F at the corpus's share of bad documents is best: the middle of all that lie within a standard error of the best.

    label: 1 bad, 0 clean, -1 unlabelled; weight: how many documents of the corpus an unlabelled one stands for."""
    bad, clean, rest = label == 1, label == 0, label < 0
    above = lambda m, w=None: np.array([np.average(score[m] >= t, weights=w) for t in STEPS]) if m.any() else None
    return _best(above(bad), above(clean), above(rest, weight[rest]), int(bad.sum()), int(clean.sum()), fallback)


_ODDS = np.linspace(-3.0, 4.5, 61)
#: Thresholds tried.
STEPS = 1 / (1 + np.exp(-_ODDS))


def _best(hit, slip, rest, n_bad: int, n_clean: int, fallback: float) -> float:
    """The same from the shares of bad, clean and unlabelled documents that reach each step; None where there are none."""
    if hit is None or slip is None:
        return fallback
    share = n_bad / (n_bad + n_clean)
    if rest is not None:
        gap = hit - slip
        k = int(np.argmax(gap))  # where the kinds differ most, the mixture tells most
        if gap[k] > 0:
            share = min(share, max((rest[k] - slip[k]) / gap[k], 0.1 * share))
    f = 2 * share * hit / np.maximum(share * (1 + hit) + (1 - share) * slip, 1e-12)
    good = f >= f.max() - np.sqrt(f.max() * (1 - f.max()) / n_bad)
    return float(1 / (1 + np.exp(-_ODDS[good].mean())))


#: Steps of a badness in the counts that quantiles are taken from.
FINE = 20_000


def _counts(x: np.ndarray) -> np.ndarray:
    return np.bincount((x * FINE).astype(np.int64), minlength=FINE + 1)


def _quantile(counts: np.ndarray, q: float) -> float:
    n = counts.sum()
    return float(np.searchsorted(np.cumsum(counts), q * n, "right").clip(0, FINE) / FINE) if n else 0.0


@dataclass
class Cuts:
    """What a round needs to know of all training rows."""

    round: int = 0
    usual: float = 0.0
    slip: float = 0.0

    @staticmethod
    def of(sentences: np.ndarray, tops: np.ndarray, r: int, cfg: Abuse) -> "Cuts":
        """From the counts of the badness of clean sentences and of the worst sentences of clean documents."""
        # A labelled document that looks no worse than clean ones do is a slip of the rater: no example of either kind.
        return Cuts(r, _quantile(sentences, min(0.99, 0.955 + 0.005 * r)), _quantile(tops, cfg.slip[min(r, len(cfg.slip) - 1)]))


def _high(counts: np.ndarray) -> float:
    """The badness over which a sentence of an unlabelled document may be bad indeed, from the counts of all sentences."""
    return _quantile(counts, 0.985)


def _tops(bags: Bags, n: int, bad: np.ndarray) -> np.ndarray:
    top = np.zeros(n)
    np.maximum.at(top, bags.text, np.where(bags.long_enough, bad, 0))
    return top


def _examples(bags: Bags, y_doc: np.ndarray, bad: np.ndarray, far: np.ndarray, cut: Cuts, cfg: Abuse):
    """(sentences, class, weight) to train on; far: the sentences of unlabelled documents to learn from."""
    y_all, ok, r = y_doc[bags.text], bags.long_enough, cut.round
    positive, negative = np.flatnonzero((y_all > 0) & ok), np.flatnonzero(y_all == 0)
    top = _tops(bags, len(y_doc), bad)[bags.text]
    sure = (top[positive] >= cut.slip) | (r == 0)
    worst = sure & (bad[positive] >= np.maximum(0.7 * top[positive] * (r > 0), cut.usual))
    pos, neg = positive[worst], np.r_[negative, positive[~worst & sure]]
    w_pos = min(4.0, max(1.0, len(neg) / (4 * max(1, len(pos))))) if r else 1.0
    y = np.r_[y_all[pos], np.zeros(len(neg) + len(far), np.int64)]
    w = np.r_[np.full(len(pos), w_pos), np.ones(len(neg)), np.full(len(far), cfg.background_weight)].astype(np.float32)
    return np.r_[pos, neg, far], y, w


def _unseen(p: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Badness by the model of the other half, of two models together."""
    return 1 - np.where(half == 0, p[:, len(CLASSES)], p[:, 0]).astype(float)


def fit(texts: list[str], labels: list[str | None], cfg: Abuse = Abuse(), weights: list[float] | None = None) -> Model:
    """Train on documents in memory; label names are those of CLASSES, None is unlabelled; weights: documents that one stands for."""
    y_doc = np.array([-1 if x is None else CLASSES.index(x) for x in labels], np.int64)
    bags = Bags(texts, cfg)
    if not len(bags.first) or not (y_doc > 0).any() or not (y_doc <= 0).any():
        return nothing(cfg)
    y_all = y_doc[bags.text]
    half = mix(bags.text.astype(U)) % U(2)
    bad, far, cut = np.ones(len(y_all)), np.zeros(0, np.int64), Cuts()

    def fitted(use: np.ndarray, fold: int) -> Model:
        pick, y, w = _examples(bags, y_doc, bad, far, cut, cfg)
        on = use[pick]
        state = State(cfg, (cfg.seed, cut.round))
        if (y[on] > 0).any():
            _fit_round(bags.parts(pick[on], cfg.buckets), y[on], w[on], state, cfg.epochs, np.random.default_rng((cfg.seed, cut.round, fold)))
        return state.model()

    for r in range(cfg.rounds):
        # A sentence is judged by a model that has not seen its document: what is bad recurs in other documents.
        bad = _unseen(together([fitted(half == h, h) for h in (0, 1)]).score(bags), half)
        top = _tops(bags, len(texts), bad)
        if not r:
            far = np.flatnonzero((y_all < 0) & (bad >= _quantile(_counts(bad[y_all == 0]), cfg.hard)) & (bad <= _high(_counts(bad[y_all < 0]))))
        cut = Cuts.of(_counts(bad[y_all == 0]), _counts(top[y_doc == 0]), r + 1, cfg)
    top = _tops(bags, len(texts), bad)
    kind = np.sign(y_doc)
    kind[(kind == 1) & (top < _quantile(_counts(top[y_doc == 0]), cfg.slip[-1]))] = -2  # slips tell nothing about recall
    held = kind > -2
    w = np.ones(len(texts)) if weights is None else np.asarray(weights, float)
    m = fitted(np.ones(len(y_all), bool), 2)
    m.threshold = best_threshold(top[held], kind[held], w[held], cfg.threshold)
    return m


def nothing(cfg: Abuse) -> Model:
    """The model that finds nothing."""
    return Model(cfg, np.zeros((cfg.buckets, len(CLASSES)), np.float32), np.array([5.0, 0, 0, 0], np.float32))


def _votes(labels: DataFrame) -> DataFrame:
    """doc_id, y: the class of each labelled document; where raters disagree, bad outvotes none on a tie."""
    votes = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    votes = votes.agg(*(F.sum(F.coalesce((F.lower("label") == c).cast("int"), F.lit(0))).alias(c) for c in CLASSES))
    worst = "case when abusive >= hateful and abusive >= sexual then 1 when hateful >= sexual then 2 else 3 end"
    return votes.selectExpr("doc_id", f"case when abusive + hateful + sexual >= greatest(1, none) then {worst} else 0 end as y")


def _half(cfg: Abuse):
    return F.pmod(F.xxhash64("doc_id", F.lit(cfg.seed)), F.lit(2)).cast("int").alias("half")


def _shard_fit(shared, cfg: Abuse, cut: Cuts, epochs: int, epoch: int):
    """One shard: ``epochs`` epochs from the given parameters, or from the start; blocks of the parameters."""

    def run(key, table):
        pair, states = shared.value
        fold, shard = (k.as_py() for k in key)
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts, y_doc, half = table["text"].to_pylist(), table["y"].to_numpy().astype(np.int64), table["half"].to_numpy()
        bags = Bags(texts, cfg)
        got = []
        if len(bags.first):
            bad = np.ones(len(bags.first)) if pair is None else _unseen(pair.score(bags), half[bags.text])
            pick, y, w = _examples(bags, y_doc, bad, np.flatnonzero(y_doc[bags.text] < 0), cut, cfg)
            if (y > 0).any():
                state = states.get(fold) or State(cfg, (cfg.seed, cut.round))
                used = _fit_round(bags.parts(pick, cfg.buckets), y, w, state, epochs, np.random.default_rng((cfg.seed, cut.round, fold, shard, epoch)))
                got = list(state.blocks(used))
        return pa.table({"fold": pa.array([fold] * len(got), pa.int32()), "block": pa.array([b for b, _ in got], pa.int32()), "x": pa.array([x for _, x in got], pa.binary())})

    return run


def _sums(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for fold, block, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(x, np.float32)
            total[fold, block] = total[fold, block] + x if (fold, block) in total else x.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fold", "block", "x"])


def _fit_folds(rows: DataFrame, folds: list[int], pair: Model | None, cut: Cuts, cfg: Abuse) -> list[Model]:
    """A model a fold: 0 and 1 learn from the rows of that half, 2 from all.  rows: doc_id, text, y, half; y < 0 marks sentences to unlearn."""
    spark = rows.sparkSession
    shards = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (cfg.shard_chars * len(folds))))
    fold = F.col("half") if len(folds) > 1 else F.lit(folds[0])
    rows = rows.withColumn("fold", fold.cast("int")).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(cfg.seed + 1)), F.lit(shards)).cast("int"))
    rows = rows.repartition(4 * shards * len(folds), "fold", "shard")
    states: dict[int, State] = {}
    # One shard needs no meeting after each epoch.
    for epoch in range(cfg.epochs if shards > 1 else 1):
        shared = spark.sparkContext.broadcast((pair, states))
        got = rows.groupBy("fold", "shard").applyInArrow(_shard_fit(shared, cfg, cut, 1 if shards > 1 else cfg.epochs, epoch), "fold int, block int, x binary")
        if shards > 1:
            got = got.repartition(min(64, 2 * shards), "fold", "block")
        got = got.mapInArrow(_sums, "fold int, block int, x binary").toArrow()  # of fixed size: the parameters of each fold and block
        states = states or {f: State(cfg, (cfg.seed, cut.round)) for f in folds}
        for f, block, x in zip(*(got[c].to_pylist() for c in ("fold", "block", "x")), strict=True):
            states[f].take(block, np.frombuffer(x, np.float64))
    return [states[f].model() for f in folds]


def _count_rows(counts: dict[str, np.ndarray]):
    """kind, bin, n: the counts that are not 0."""
    at = {k: np.flatnonzero(v) for k, v in counts.items()}
    kinds = [k for k, v in at.items() for _ in range(len(v))]
    return [pa.array(kinds, pa.string()), pa.array(np.concatenate(list(at.values())), pa.int64()), pa.array(np.concatenate([counts[k][v] for k, v in at.items()]), pa.int64())]


def _read_counts(rows: DataFrame) -> dict[str, np.ndarray]:
    got = rows.groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most FINE + 1 rows a kind
    out = {k: np.zeros(FINE + 1, np.int64) for k in ("sentence", "top")}
    for k, g in got.groupby("kind"):
        out[k][g.bin.to_numpy(np.int64)] = g.n.to_numpy(np.int64)
    return out


def _clean_counts(shared):
    """Counts of the badness of the sentences, and of the worst ones, of clean documents."""

    def run(batches):
        pair = shared.value
        counts = {k: np.zeros(FINE + 1, np.int64) for k in ("sentence", "top")}
        for batch in batches:
            for o in range(0, batch.num_rows, 1000):
                part = batch.slice(o, 1000)
                texts, half = part.column(0).to_pylist(), part.column(1).to_numpy()
                bags = Bags(texts, pair.cfg)
                bad = _unseen(pair.score(bags), half[bags.text]) if len(bags.first) else np.zeros(0)
                counts["sentence"] += _counts(bad)
                counts["top"] += _counts(_tops(bags, len(texts), bad))
        yield pa.RecordBatch.from_arrays(_count_rows(counts), ["kind", "bin", "n"])

    return run


def _mistakes(shared, least: float):
    """Of all documents: the sentences of at least that badness, and at the end the counts of the badness of all sentences."""

    def run(batches):
        pair = shared.value
        counts = {"sentence": np.zeros(FINE + 1, np.int64)}
        names = ["doc_id", "half", "text", "bad", "kind", "bin", "n"]
        for batch in batches:
            for o in range(0, batch.num_rows, 1000):
                part = batch.slice(o, 1000)
                texts, half = part.column(1).to_pylist(), part.column(2).to_numpy()
                bags = Bags(texts, pair.cfg)
                if not len(bags.first):
                    continue
                bad = _unseen(pair.score(bags), half[bags.text])
                counts["sentence"] += _counts(bad)
                at = np.flatnonzero(bad >= least)
                of = pa.array(bags.text[at])
                said = [" ".join(bags.words[bags.codes[a:b]]) for a, b in zip(bags.first[at], bags.stop[at], strict=True)]
                none = lambda t: pa.nulls(len(at), t)
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(2).take(of), pa.array(said, pa.string()), pa.array(bad[at]), none(pa.string()), none(pa.int64()), none(pa.int64())], names)
        kind = _count_rows(counts)
        none = lambda t: pa.nulls(len(kind[0]), t)
        yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int32()), none(pa.string()), none(pa.float64()), *kind], names)

    return run


def _judged(documents: DataFrame, labels: DataFrame, cfg: Abuse) -> tuple[Model, DataFrame | None]:
    """The model, and doc_id, source, score, cls of every row; no rows where there is nothing to learn from."""
    sc = documents.sparkSession.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source").cast("string").alias("source") if "source" in documents.columns else F.lit(None).cast("string").alias("source"))
    docs = spread(docs).withColumn("half", _half(cfg))
    votes = _votes(labels)
    known = materialise(docs.where("text is not null").join(votes, "doc_id").select("doc_id", "text", "y", "half"), "abuse-labelled")
    n = known.agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") == 0).alias("clean")).first()
    if not n.bad or not n.clean:
        return nothing(cfg), None
    rows, pair, cut = known, None, Cuts()
    clean = spread(known.where("y = 0").select("text", "half"))
    for r in range(cfg.rounds):
        pair = together(_fit_folds(rows, [0, 1], pair, cut, cfg))
        shared = sc.broadcast(pair)
        c = _read_counts(clean.mapInArrow(_clean_counts(shared), "kind string, bin long, n long"))
        cut = Cuts.of(c["sentence"], c["top"], r + 1, cfg)
        if not r:
            found = docs.where("text is not null and doc_id is not null").select("doc_id", "text", "half")
            found = materialise(found.mapInArrow(_mistakes(shared, _quantile(c["sentence"], cfg.hard)), "doc_id long, half int, text string, bad double, kind string, bin long, n long"), "abuse-mistakes")
            high = _high(_read_counts(found.where("kind is not null"))["sentence"])
            found = found.where(F.col("kind").isNull() & (F.col("bad") <= high)).join(votes, "doc_id", "left_anti")
            rows = materialise(known.union(found.select("doc_id", "text", F.lit(-1).alias("y"), "half")), "abuse-rows")
    (final,) = _fit_folds(rows, [2], pair, cut, cfg)
    shared = sc.broadcast(together([pair, final]))  # of fixed size: buckets x classes
    scored = docs.mapInArrow(_score_folds(shared), "doc_id long, source string, score double, cls int, unseen double, blank boolean")
    scored = materialise(scored, "abuse-scores")
    kinds = scored.where("not blank and doc_id is not null").join(votes, "doc_id", "left").selectExpr("unseen", "coalesce(sign(y), -1) as kind")
    least = _quantile(c["top"], cfg.slip[-1])  # slips tell nothing about recall
    kinds = kinds.where(~((F.col("kind") == 1) & (F.col("unseen") < least)))
    got = {int(x.kind): x for x in kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("unseen") >= float(t)).alias(f"s{i}") for i, t in enumerate(STEPS))).collect()}
    at = {k: np.array([x[f"s{i}"] for i in range(len(STEPS))]) / x.n for k, x in got.items()}
    final.threshold = _best(at.get(1), at.get(0), at.get(-1), got[1].n if 1 in got else 0, got[0].n if 0 in got else 0, cfg.threshold)
    return final, scored.select("doc_id", "source", "score", "cls")


def train(documents: DataFrame, labels: DataFrame, cfg: Abuse = Abuse()) -> Model:
    """Fit on all labelled documents, and on all others as ``fit`` does."""
    return _judged(documents, labels, cfg)[0]


def _worst(b: Bags, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: (badness of the worst sentence, class of that sentence if it is bad)."""
    score, cls = np.zeros(n), np.zeros(n, np.int64)
    if len(p):
        bad = np.where(b.long_enough, 1 - p[:, 0], 0)
        order = np.lexsort((bad, b.text))
        last = order[np.flatnonzero(np.r_[b.text[order][1:] != b.text[order][:-1], True])]
        score[b.text[last]] = bad[last]
        cls[b.text[last]] = 1 + p[last, 1:].argmax(1)
    return score, cls


def assess(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: (score = the worst sentence's probability of being bad, class of that sentence)."""
    b = Bags(texts, model.cfg)
    score, cls = _worst(b, model.score(b), len(texts))
    return score, np.where(score >= model.threshold, cls, 0)


def _score_batches(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            cols = batch.select([0, 2])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for o in range(0, len(texts), 1000):
                score, cls = assess(model, texts[o : o + 1000])
                part = cols.slice(o, len(score))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array([CLASSES[i] for i in cls])], ["doc_id", "source", "score", "label"])

    return run


def _score_folds(shared):
    """Rows of doc_id, text, source, half under the two fold models and the last model, each text read once."""

    def run(batches):
        models = shared.value
        k = len(CLASSES)
        for batch in batches:
            for o in range(0, batch.num_rows, 1000):
                part = batch.slice(o, 1000)
                texts = part.column(1).to_pylist()
                b = Bags([t or "" for t in texts], models.cfg)
                p = models.score(b)
                score, cls = _worst(b, p[:, 2 * k :], len(texts))
                unseen = _tops(b, len(texts), _unseen(p, part.column(3).to_numpy()[b.text])) if len(p) else np.zeros(len(texts))
                blank = [t is None for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array(cls, pa.int32()), pa.array(unseen), pa.array(blank, pa.bool_())], ["doc_id", "source", "score", "cls", "unseen", "blank"])

    return run


def scores(documents: DataFrame, labels: DataFrame, cfg: Abuse = Abuse(), model: Model | None = None) -> DataFrame:
    """doc_id, source, score, label: one row per document row.

    NULL, blank and wordless texts score 0 and are 'none'; without labels of both kinds every document does.
    Repeated rows are scored each; columns other than doc_id, text and source are not read."""
    if model is None:
        model, scored = _judged(documents, labels, cfg)
        if scored is not None:
            name = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("cls") + 1)
            return scored.select("doc_id", "source", "score", F.when(F.col("score") >= model.threshold, name).otherwise("none").alias("label"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x classes
    use = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source").cast("string").alias("source"))
    return spread(use).mapInArrow(_score_batches(shared), "doc_id long, source string, score double, label string")


def flagged(documents: DataFrame, labels: DataFrame, cfg: Abuse = Abuse()) -> DataFrame:
    """doc_id of the documents whose score reaches the model's threshold."""
    return scores(documents, labels, cfg).where("label <> 'none' and doc_id is not null").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame, cfg: Abuse = Abuse()) -> DataFrame:
    """source, n, n_bad, share, mean_score."""
    bad = (F.col("label") != "none").cast("long")
    return scores(documents, labels, cfg).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("n_bad"), F.avg(bad).alias("share"), F.avg("score").alias("mean_score"))
