"""Evaluation texts inside corpus documents: size-partitioned MinHash containment search.

Items are short and few, documents long and many.  Items are partitioned by their number of word
shingles (five words; in Chinese and Japanese five characters); the upper bound of a partition sets the
length of the document windows that its items are searched in, half overlapping, so that any passage of
half an item lies whole in one window and containment is not thinned out by the length of the document.
Every window and item has a MinHash sketch; a pair that agrees in ``least`` places or more is a candidate.
Candidates are verified exactly: shingle containment in the document, then a local alignment of the item
with the place, which lets single changed words pass and gives the share of the item that the passage covers.
Documents are read by array operations, and the alignments of many candidates are made together.

The document side is one map over the corpus, without a shuffle.  The item side is broadcast in chunks of at
most ``chunk`` items (about 5 kB each), so the broadcast is bounded whatever the number of items, and the corpus is read once a chunk.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.llm.common import U, code_points, mix, spread

BLOCK = 16
#: Characters of documents that are read together.
CHARS = 1_000_000
#: Candidates, and readings of so many characters, that wait to be aligned together.
WAITING, READINGS = 20_000, 16
#: Cells of a row of alignments that are made together.
CELLS = 1 << 13


@dataclass(frozen=True)
class Leakage:
    shingle: int = 5
    hashes: int = 96
    least: int = 3
    contained: float = 0.22
    share: float = 0.5
    slack_tokens: int = 0
    chunk: int = 100_000
    seed: int = 11


_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|&(?:[a-z]{2,8}|#\d{1,6});")
_DROP = re.compile(r"[*`~​‌‍⁠﻿­]|(?<=\w)__(?=\w)")
_TOKEN = re.compile(r"[^\W_぀-ヿ㐀-鿿]+|[぀-ヿ㐀-鿿]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def _plain(text: str) -> str:
    """Compatible forms of characters, without tags and entities."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if "<" in t or "&" in t:
        t = _TAG.sub(lambda m: "" if m[0][0] == "<" else " ", t)
    return t


def tokens(text: str | None) -> list[str]:
    """Lower-case words, or single CJK characters, without markup and punctuation."""
    if not text:
        return []
    t = _plain(text)
    if not t.isascii() or "*" in t or "`" in t or "~" in t or "__" in t:
        t = _DROP.sub("", t)
    return _TOKEN.findall(t.lower())


#: What a character is: not seen yet, none of the others, of a word, a CJK character, dropped.
_NEW, _GAP, _WORD, _CJK, _DROPPED = range(5)
_KINDS = np.zeros(0x110000, np.uint8)


def _kinds(a: np.ndarray) -> np.ndarray:
    kind = _KINDS.take(a)
    if not kind.all():
        for c in np.unique(a[kind == _NEW]).tolist():
            _KINDS[c] = _DROPPED if _DROP.match(chr(c)) else _GAP if not _TOKEN.match(chr(c)) else _CJK if _WIDE.match(chr(c)) else _WORD
        kind = _KINDS.take(a)
    return kind


def _sums(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words that stand end to end in ``a``: 64-bit sums over their characters and places."""
    out = np.zeros(len(size), U)
    ends = np.cumsum(size)
    for o in range(0, len(size), 1 << 14):  # so that what is as long as the texts stays small
        n, end = size[o : o + (1 << 14)], ends[o : o + (1 << 14)]
        first = end - n
        at = np.arange(first[0], end[-1])
        place = (at - np.repeat(first, n)).astype(U)
        out[o : o + len(n)] = np.add.reduceat(mix(a[first[0] : end[-1]] + (place << U(32)) + U(1)), first - first[0])
    return out


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``tokens`` of all texts, read by array operations: hash of each, offsets of the texts, characters of each."""
    plain = [_plain(t) for t in texts]
    # What is dropped by its neighbours is dropped here, and all before a letter whose lower case depends on the next one.
    plain = [(_DROP.sub("", t) if "__" in t or "Σ" in t else t).lower() for t in plain]
    a, _ = code_points(["\n".join([*plain, ""])])
    ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
    kind = _kinds(a)
    gone = kind == _DROPPED
    if gone.any():
        ends = ends - np.cumsum(gone)[ends - 1]
        a, kind = a[~gone], kind[~gone]
    word, wide = kind == _WORD, kind == _CJK
    of = word | wide
    begins, stops = of.copy(), of.copy()
    begins[1:] &= wide[1:] | ~word[:-1]
    stops[:-1] &= wide[:-1] | ~word[1:]
    begins = np.flatnonzero(begins)
    size = np.flatnonzero(stops) + 1 - begins
    return _sums(a[of], size), np.r_[0, np.searchsorted(begins, ends)], size


def _token_hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_read`` gives them, of texts that are cut into tokens."""
    a, off = code_points([w for ws in lists for w in ws])
    return _sums(a, np.diff(off)), np.cumsum([0, *map(len, lists)])


def _shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of every shingle; a text of fewer than k tokens has one, of all its tokens."""
    n = len(h)
    s = np.zeros(n, U)
    for i in range(k):
        s[: n - i] = s[: n - i] * U(0x9E3779B97F4A7C15) + h[i:] + U(1)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    pos = np.arange(n) - off[text]
    size = np.diff(off)[text]
    for t in np.flatnonzero((np.diff(off) < k) & (np.diff(off) > 0)):
        v = np.zeros(1, U)
        for x in h[off[t] : off[t + 1]]:
            v = v * U(0x9E3779B97F4A7C15) + x + U(1)
        s[off[t]] = v[0]
    ok = (pos <= size - k) | (pos == 0)
    return mix(s[ok]), text[ok], pos[ok]


def _multipliers(cfg: Leakage) -> np.ndarray:
    return mix(np.arange(1, cfg.hashes + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(cfg.seed)) | U(1)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * U(0xD6E8FEB86659FD93)) >> U(64 - bits)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs of given starts and sizes, end to end."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Items:
    """The item side: token hashes, exact shingle sets and sketches by size partition."""

    def __init__(self, ids: list[int], texts: list[str | None], cfg: Leakage):
        self.cfg = cfg
        self.hash, off, chars = _read([t or "" for t in texts])
        keep = np.flatnonzero(np.diff(off))
        self.ids = [ids[i] for i in keep]
        self.off = np.r_[off[keep], len(self.hash)]
        self.chars = np.split(chars, self.off[1:-1])
        s, text, _ = _shingles(self.hash, self.off, cfg.shingle)
        self.known = np.unique(s)
        self.member = np.unique(text * len(self.known) + np.searchsorted(self.known, s))
        self.known_bits = max(16, (4 * len(self.known)).bit_length())
        self.known_map = np.zeros(1 << self.known_bits, bool)
        self.known_map[_slot(self.known, self.known_bits)] = True
        item, place = np.divmod(self.member, max(1, len(self.known)))
        self.sizes = np.bincount(item, minlength=len(keep))
        sets = np.split(self.known[place], np.cumsum(self.sizes)[:-1])
        self.parts: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            self.parts.setdefault(max(2 * BLOCK, 1 << int(np.ceil(np.log2(max(2, n))))), []).append(i)
        m = _multipliers(cfg)
        self.index = {}
        self.asked = {}
        for size, members in self.parts.items():
            own = np.concatenate([sets[i] for i in members])
            first = np.cumsum([0, *self.sizes[members[:-1]]])
            sk = np.stack([np.minimum.reduceat(own * x, first) for x in m])  # hashes x items
            order = np.argsort(sk, axis=1, kind="stable")
            bits = max(16, (2 * len(members)).bit_length())
            there = np.zeros((len(m), 1 << bits), bool)
            there[np.arange(len(m))[:, None], _slot(sk, bits)] = True
            self.index[size] = (np.take_along_axis(sk, order, 1), np.array(members, np.int32)[order], there, bits)
            self.asked[size] = (int(self.need(self.sizes[members]).min()), int(self.span(np.diff(self.off)[members]).max()))

    def need(self, size):
        """Shared shingles that ``verify`` asks for, within ``span``."""
        return np.maximum(1, (self.cfg.contained * size).astype(np.int64))

    def span(self, length):
        return (1.3 * length).astype(np.int64) + 4

    def places(self, s: np.ndarray) -> np.ndarray:
        """The place of each shingle among those of all items, -1 of one that no item has."""
        out = np.full(len(s), -1)
        maybe = np.flatnonzero(self.known_map[_slot(s, self.known_bits)])
        at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
        out[maybe] = np.where(self.known[at] == s[maybe], at, -1) if len(maybe) else 0
        return out

    def candidates(self, s: np.ndarray, text: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """Distinct (text, item) whose sketches agree in ``least`` places in some window.

        A window is sketched by its shingles that some item has: others can agree with no sketch, only hide an agreement."""
        if not len(s) or not self.ids:
            return np.zeros((0, 2), np.int64)
        known = np.flatnonzero((self.places(s) if places is None else places) >= 0)
        count = np.bincount(text)
        of = text[known]
        # By partition, the texts where as many shingles of items as ``verify`` asks for stand as close.
        spot = known + (of << 40)
        asked = {}
        for size, (need, span) in self.asked.items():
            asked[size] = np.zeros(len(count), bool)
            asked[size][of[: max(0, len(of) - need + 1)][spot[need - 1 :] - spot[: max(0, len(of) - need + 1)] < span]] = True
        some = np.logical_or.reduce(list(asked.values()))
        known = known[some[of]]
        if not len(known):
            return np.zeros((0, 2), np.int64)
        of = text[known]
        m = _multipliers(self.cfg)
        blocks = np.where(some, -(-count // BLOCK), 0)
        base = np.cumsum(blocks) - blocks
        block_text = np.repeat(np.arange(len(blocks)), blocks)
        number = np.arange(len(block_text)) - base[block_text]
        block = base[of] + (known - (np.cumsum(count) - count)[of]) // BLOCK
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        filled = np.zeros(len(block_text), bool)
        filled[block[start]] = True
        none = ~U(0)
        low = np.full((len(m), len(block_text)), none)  # hashes x blocks
        own = s[known]
        for k, x in enumerate(m):
            low[k, block[start]] = np.minimum.reduceat(own * x, start)
        out = []
        width = 1
        for size in sorted(self.index):
            while width * BLOCK < size:
                if width > 1:  # windows begin at every second half of one
                    keep = np.flatnonzero(number % width == 0)
                    low, filled, block_text, number = low.take(keep, axis=1), filled[keep], block_text[keep], number[keep]
                same = block_text[1:] == block_text[:-1]
                low[:, :-1] = np.minimum(low[:, :-1], np.where(same, low[:, 1:], none))
                filled[:-1] |= filled[1:] & same
                width *= 2
            pick = np.flatnonzero(filled & asked[size][block_text])
            windows = low.take(pick, axis=1)
            values, owners, there, bits = self.index[size]
            pairs = []
            for k in range(len(m)):
                w = windows[k]
                maybe = np.flatnonzero(there[k][_slot(w, bits)])
                if not len(maybe):
                    continue
                w, picked = w[maybe], pick[maybe]
                a, b = np.searchsorted(values[k], w, "left"), np.searchsorted(values[k], w, "right")
                hit = np.flatnonzero(b > a)
                n = b[hit] - a[hit]
                if len(hit):
                    i = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs.append(np.repeat(picked[hit], n) * len(self.ids) + owners[k, i])
            if pairs:
                key, c = np.unique(np.concatenate(pairs), return_counts=True)
                key = key[c >= self.cfg.least]
                out.append(block_text[key // len(self.ids)] * len(self.ids) + key % len(self.ids))
        return np.stack(np.divmod(np.unique(np.concatenate(out)), len(self.ids)), 1) if out else np.zeros((0, 2), np.int64)

    def hits(self, pairs: np.ndarray, text: np.ndarray, places: np.ndarray):
        """(text, item, indexes of the shingles of the text that the item has), of pairs where these are enough."""
        at = np.flatnonzero(places >= 0)
        lo, hi = (np.searchsorted(text[at], pairs[:, 0], side) for side in ("left", "right"))
        part = np.cumsum(hi - lo) >> 20  # pairs that are looked up together
        for p in np.split(np.arange(len(pairs)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            n = (hi - lo)[p]
            i = at[_ranges(lo[p], n)]
            key = np.repeat(pairs[p, 1], n) * len(self.known) + places[i]
            has = self.member[np.minimum(np.searchsorted(self.member, key), len(self.member) - 1)] == key
            upto = np.r_[0, np.cumsum(has)][np.r_[0, np.cumsum(n)]]
            i = i[has]
            got = np.diff(upto)
            for q in np.flatnonzero((got > 0) & (got >= self.cfg.contained * self.sizes[pairs[p, 1]])):
                yield int(pairs[p[q], 0]), int(pairs[p[q], 1]), i[upto[q] : upto[q + 1]]

    def verify(self, doc: np.ndarray, hit: np.ndarray, item: int):
        """Share of the item (the larger of tokens and characters) that the best passage of the document covers; hit: the
        places of shared shingles.  A generator, so that many can be aligned together: it asks for a ``passage`` by its
        arguments and is sent the range."""
        h = self.hash[self.off[item] : self.off[item + 1]]
        span = self.span(np.int64(len(h)))
        best, share = 0, 0.0
        counts = np.searchsorted(hit, hit + span) - np.arange(len(hit))
        need = self.need(self.sizes[item])
        done: list[int] = []
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] < need:
                break
            last = hit[j + counts[j] - 1]
            lo, hi = max(0, hit[j] - len(h) // 2), min(len(doc), last + self.cfg.shingle + len(h) // 2)
            if any(abs(hit[j] - x) <= len(h) // 2 for x in done):
                continue
            done.append(hit[j])
            a, b = yield h, doc[lo:hi], 0.17 * len(h)
            n = b - a
            if n > best:
                best = n
                share = max((n + self.cfg.slack_tokens * (n < len(h))) / len(h), self.chars[item][a:b].sum() / max(1, self.chars[item].sum()))
            if share >= self.cfg.share:
                break
        return float(share)

    def verdicts(self, h: np.ndarray, off: np.ndarray, s: np.ndarray, text: np.ndarray, pos: np.ndarray):
        """(text, item, ``verify``) of every candidate with enough shared shingles."""
        places = self.places(s)
        pairs = self.candidates(s, text, places)
        for t, i, at in self.hits(pairs, text, places):
            yield t, i, self.verify(h[off[t] : off[t + 1]], pos[at], i)


def settle(waiting: list[tuple]):
    """(document, item, share) of pairs that are (document, item, ``verify``), all being aligned together, place by place."""
    waiting = [(*x, None) for x in waiting]
    while waiting:
        left, asks = [], []
        for d, i, g, got in waiting:
            try:
                asks.append(g.send(got))
                left.append((d, i, g))
            except StopIteration as e:
                yield d, i, e.value
        waiting = [(*x, got) for x, got in zip(left, passages(asks), strict=True)]


def _ends(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int, int]]:
    """(score, end in x, end in y) of the best local alignment of each pair (x, y); pairs of like size are aligned together."""
    out = [(0.0, 0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda p: (len(pairs[p][0]) // 8, len(pairs[p][1])))
    o = 0
    while o < len(order):
        e, long, wide = o, 0, 0
        while e < len(order) and (e == o or (len(pairs[order[e]][0]) < long + 8 and (e - o + 1) * max(wide, len(pairs[order[e]][1]) + 1) <= CELLS)):
            long, wide = max(long, len(pairs[order[e]][0])), max(wide, len(pairs[order[e]][1]) + 1)
            e += 1
        some = order[o:e]
        o = e
        # Shorter ones are filled up with what is equal to nothing, where no score rises.  Scores are whole tenths.
        x = np.zeros((long, len(some)), U)
        y = np.ones((len(some), wide - 1), U)
        for n, p in enumerate(some):
            x[: len(pairs[p][0]), n], y[n, : len(pairs[p][1])] = pairs[p]
        ramp = 15 * np.arange(wide, dtype=np.int32)
        row = np.zeros((len(some), wide), np.int32)
        new = np.zeros_like(row)
        best, bi, bj = np.zeros((3, len(some)), np.int64)
        every = np.arange(len(some))
        for i, t in enumerate(x):
            step = (y == t[:, None]).astype(np.int32)
            step *= 22
            step -= 12
            step += row[:, :-1]
            np.subtract(row, 15, out=new)
            np.maximum(new, 0, out=new)
            np.maximum(new[:, 1:], step, out=new[:, 1:])
            new += ramp
            np.maximum.accumulate(new, axis=1, out=row)
            row -= ramp
            j = row.argmax(1)
            top = row[every, j]
            up = np.flatnonzero(top > best)
            best[up], bi[up], bj[up] = top[up], i + 1, j[up]
        for p, score, i, j in zip(some, best.tolist(), bi.tolist(), bj.tolist(), strict=True):
            out[p] = (score / 10, i, j)
    return out


def passages(asks: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[int, int]]:
    """``passage`` of each (item, doc, least)."""
    out = [(0, 0)] * len(asks)
    found = [(n, i, j) for n, (score, i, j) in enumerate(_ends([x[:2] for x in asks])) if i and score >= asks[n][2]]
    for (n, i, _), (_, back, _) in zip(found, _ends([(asks[n][0][:i][::-1], asks[n][1][:j][::-1]) for n, i, j in found]), strict=True):
        out[n] = (i - back, i)
    return out


def passage(item: np.ndarray, doc: np.ndarray, least: float = 0.0) -> tuple[int, int]:
    """Half-open range of the item in its best local alignment (match 1, change -1.2, gap -1.5), empty where it scores under ``least``."""
    return passages([(item, doc, least)])[0]


def _search(shared):
    def run(batches):
        items: Items = shared.value

        def accepted(waiting):
            return [(d, items.ids[i], share) for d, i, share in settle(waiting) if share >= items.cfg.share]

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            use = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None and t]
            out, waiting, held = [], [], 0
            o = 0
            while o < len(use):
                e, total = o, 0
                while e < len(use) and (e == o or total < CHARS):
                    total += len(use[e][1])
                    e += 1
                h, off, _ = _read([t for _, t in use[o:e]])
                for t, i, verdict in items.verdicts(h, off, *_shingles(h, off, items.cfg.shingle)):
                    waiting.append((use[o + t][0], i, verdict))
                    if len(waiting) == WAITING:
                        out += accepted(waiting)
                        waiting = []
                held += total
                o = e
                if held >= READINGS * CHARS or o == len(use):
                    out += accepted(waiting)
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["doc_id", "item_id", "share"])

    return run


def leaked(documents: DataFrame, items: DataFrame, cfg: Leakage = Leakage()) -> DataFrame:
    """doc_id, item_id, share: documents that hold ``share`` of an item as one connected passage.

    NULL, blank and letterless texts match nothing; a repeated item or document row gives one result row;
    columns other than the keys and texts are not read; empty tables give an empty result."""
    spark = documents.sparkSession
    keyed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    chunks = max(1, -(-keyed.count() // cfg.chunk))
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text is not null"))
    out = None
    for c in range(chunks):
        rows = keyed.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).dropDuplicates(["item_id"]).collect()
        shared = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], cfg))
        got = docs.mapInArrow(_search(shared), "doc_id long, item_id long, share double")
        out = got if out is None else out.union(got)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
