"""Token counts under an existing byte-level BPE tokenizer, and totals by slice.

Texts are split by the tokenizer's own pattern.  Each distinct piece is stored once per worker, as an array of
symbols; all new pieces of a batch are merged together: every round looks up the merge rank of each pair of
neighbouring symbols and applies the lowest-ranked merge of each piece, until no piece has one left.  The
number of symbols that remain is the number of tokens.  No vocabulary is trained or copied; the rank file is a
parameter.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.llm.common import spread
from polyphony.llm.langid import base_language

#: The published pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Ranks:
    """Sorted merge pairs (left << 32 | right), the id that each makes (also its rank), and the ids of bytes."""

    pairs: np.ndarray
    made: np.ndarray
    bytes_: np.ndarray
    pattern: str = PATTERN

    @staticmethod
    def load(path: str = DEFAULT_RANKS, pattern: str = PATTERN) -> Ranks:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pairs, made = [], []
        for tok, i in ids.items():
            for k in range(1, len(tok)):
                a, b = ids.get(tok[:k]), ids.get(tok[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(i)
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        return Ranks(np.array(pairs, np.int64)[order], np.array(made, np.int32)[order], np.array([ids[bytes([i])] for i in range(256)], np.int32), pattern)

    @cached_property
    def table(self) -> dict[int, int]:
        """The merges as a dictionary, made when the first very long piece asks for it."""
        return dict(zip(self.pairs.tolist(), self.made.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge; negative symbols are gaps."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[i] == key) & (left >= 0) & (right >= 0), self.made[i], NONE)


def _merge_long(symbols: list[int], ranks: Ranks) -> int:
    """One very long piece: the same merges in the same order, from a heap."""
    table = ranks.table
    n = len(symbols)
    nxt, prv, sym = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := table.get(sym[i] << 32 | sym[i + 1])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = r, -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        left -= 1
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y < n and (q := table.get(sym[x] << 32 | sym[y])) is not None:
                heapq.heappush(heap, (q, x, sym[x], sym[y]))
    return left


def count_pieces(pieces: list[bytes], ranks: Ranks, long: int = 512) -> np.ndarray:
    """Tokens of each piece."""
    size = np.array([len(p) for p in pieces], np.int64)
    out = np.zeros(len(pieces), np.int64)
    order = np.argsort(size, kind="stable")
    at = int(np.searchsorted(size[order], 1))
    while at < len(order):
        width = int(size[order[at]])
        if width > long:
            for i in order[at:]:
                out[i] = _merge_long(ranks.bytes_[np.frombuffer(pieces[i], np.uint8)].tolist(), ranks)
            break
        width = max(4, int(width * 1.25))
        end = min(int(np.searchsorted(size[order], width, "right")), at + max(64, 2_000_000 // width))
        rows = order[at:end]
        flat = ranks.bytes_[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        sym = np.full((len(rows), width + 1), -1, np.int32)
        sym[:, :width][np.arange(width)[None, :] < size[rows][:, None]] = flat
        left = size[rows].copy()
        live = np.arange(len(rows))
        rank = ranks.rank(sym[:, :-1], sym[:, 1:])
        while len(live):
            j = rank.argmin(1)
            r = rank[np.arange(len(live)), j]
            ok = r < NONE
            out[rows[live[~ok]]] = left[live[~ok]]
            if not ok.all():
                live, sym, rank, j, r = live[ok], sym[ok], rank[ok], j[ok], r[ok]
            if not len(live):
                break
            k = np.arange(len(live))
            sym[k, j] = r
            cols = np.arange(sym.shape[1])[None, :]
            src = np.minimum(cols + (cols > j[:, None]), sym.shape[1] - 1)
            sym = np.take_along_axis(sym, src, 1)
            sym[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(src[:, :-1], rank.shape[1] - 1), 1)
            rank[:, -1] = NONE
            rank[k, j] = ranks.rank(sym[k, j], sym[k, j + 1])
            b = np.maximum(j - 1, 0)
            rank[k, b] = np.where(j > 0, ranks.rank(sym[k, b], sym[k, b + 1]), rank[k, b])
            left[live] -= 1
            widest = int(left[live].max())
            if widest + 1 < sym.shape[1] * 3 // 4:
                sym, rank = np.ascontiguousarray(sym[:, : widest + 1]), np.ascontiguousarray(rank[:, :widest])
        at = end
    return out


class Counter:
    """Token counts of texts; remembers the distinct pieces it has seen, up to ``keep``."""

    def __init__(self, ranks: Ranks, keep: int = 600_000):
        self.ranks, self.keep = ranks, keep
        self.known: dict[str, int] = {}
        self.split = regex.compile(ranks.pattern).findall

    def count(self, texts: list[str]) -> np.ndarray:
        pieces = [self.split(t) for t in texts]
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        new = list({p for ps in pieces for p in ps if p not in known})
        if new:
            for p, n in zip(new, count_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.ranks).tolist(), strict=True):
                known[p] = n
        return np.array([sum(map(known.__getitem__, ps)) for ps in pieces], np.int64)


def _count_batches(shared):
    def run(batches):
        counter = Counter(shared.value)
        languages: dict[str | None, str] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            lang = batch.column(3).to_pylist()
            for x in set(lang) - languages.keys():
                languages[x] = base_language(x) or "unknown"
            for o in range(0, len(texts), 4000):
                part = batch.slice(o, 4000)
                n = counter.count(texts[o : o + 4000])
                chars = pa.array([len(t) for t in texts[o : o + 4000]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([languages[x] for x in lang[o : o + 4000]]), part.column(4), chars, pa.array(n)],
                    ["rec_type", "rec", "source", "language", "slice", "n_chars", "n_tokens"],
                )

    return run


def count_tokens(rows: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """rows: rec_type, rec, source, language, slice, text -> rec_type, rec, source, language, slice, n_chars, n_tokens.

    One row per (rec_type, rec).  NULL and empty texts have no tokens; a language label is reduced to its base
    language, 'unknown' where it names none; a NULL source or slice stays NULL."""
    shared = rows.sparkSession.sparkContext.broadcast(Ranks.load(ranks_path))  # of fixed size: the rank file
    use = rows.where("rec is not null").select("rec_type", F.col("rec").cast("long").alias("rec"), "source", "language", "slice", "text")
    out = spread(use).mapInArrow(_count_batches(shared), "rec_type string, rec long, source string, language string, slice string, n_chars long, n_tokens long")
    return out.dropDuplicates(["rec_type", "rec"])


def corpus_rows(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """Responses (source = model, slice = dataset) and documents (source, slice = domain) in one shape."""
    r = responses.select(F.lit("response").alias("rec_type"), F.col("gen_id").alias("rec"), F.col("model").alias("source"), "language", F.col("dataset").alias("slice"), F.col("response_text").alias("text"))
    d = documents.select(F.lit("document").alias("rec_type"), F.col("doc_id").alias("rec"), "source", F.col("lang").alias("language"), F.col("domain").alias("slice"), "text")
    return r.union(d)


def token_budget(responses: DataFrame, documents: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """rec_type, source, language, slice, n_records, n_chars, n_tokens: totals of every slice."""
    n = count_tokens(corpus_rows(responses, documents), ranks_path)
    return n.groupBy("rec_type", "source", "language", "slice").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
