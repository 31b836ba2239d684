"""Texts cut off by field limits.

A text is judged by its end.  Structure first: an unclosed reasoning block, code fence or table row,
an explicit mark of a cut or a broken character is a cut; a closing stop, emoji, closed fence or
whole table row is complete.  What is left ends in a word without a stop, and may be cut or merely
lack the stop.  For those, three kinds of evidence over the whole corpus are joined:

* the vocabulary trie: the last word is unknown (not seen elsewhere in the text, and elsewhere in the corpus
  not a hundredth as often as the words it begins) and a proper prefix of known words;
* how often the last words of the text, taken as a context of one to eight words, close a sentence;
* length: the record's length is a spike of its source (many records end at exactly this length), or
  the provider reports a length stop.

The trie is never held whole: vocabulary and asked tokens are partitioned by prefix and walked in
sorted order, the open path of the trie being the only state.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyphony.llm.common import Bits, U, as_signed, mix, spread
from polyphony.session import materialise

ORDERS = 8
#: log2 of the least and greatest number of bits of the filter of asked contexts, which has 16 bits or more a context
#: up to the greatest size (32 MB); a fuller filter costs time, never a result.
FILTER_BITS = (16, 28)

# Words for a missing value.
STAND_INS = "null none nil nan n/a na - -- empty undefined missing unknown (empty) (none) [empty] no answer no response tbd".split(" ")
# Words for a length stop used by providers.
LENGTH_REASONS = ("length", "max_tokens", "max_length", "max_output_tokens", "token_limit", "model_length", "truncated", "incomplete")

_TOKEN = re.compile(r"[^\W\d_぀-ヿ㐀-鿿가-힯]+(?:['’·][^\W\d_぀-ヿ㐀-鿿가-힯]+)*|[぀-ヿ㐀-鿿가-힯]|\d+|[.!?。！？…]+|\n")
_STOP = ".!?。！？…"
_MARK_WORD = re.compile(r"[\s|_*.…-]*(?:truncated|trunc|cut|cut off|snip|snipped|continued|cont\.?|more|\.{3}|…)[\s|_*.…-]*", re.I)
_EMOJI = re.compile(r"[←-⇿☀-➿\U0001f000-\U0001faff⬀-⯿️‍]|[:;]-?[)(DP]")
_CLOSERS = "\"'”’»«“„」』*_~` \t\r\n ​"
_BULLET = re.compile(r"\s*(?:[-*•·–+]|\d+[.)、]|[a-z][.)])\s+")
_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)


def without_thought(text: str) -> str:
    """Without closed reasoning blocks."""
    return _THINK.sub("", text) if "<" in text else text


def is_stand_in(text: str) -> bool:
    return len(text) < 60 and text.strip().strip(".,;:!\"'`*_").strip().lower() in STAND_INS


def _bracketed(s: str, opening: str, closing: str) -> str | None:
    """What stands in the brackets that end ``s``: from the last opening one, if no closing one lies between; else None."""
    if not s or s[-1] not in closing:
        return None
    at = max(s.rfind(c) for c in opening)
    return s[at + 1 : -1] if at >= 0 and not any(c in closing for c in s[at + 1 : -1]) else None


def structure(text: str) -> tuple[str, str]:
    """('cut' | 'whole' | 'list' | 'open', the text without trailing closers) from structure alone."""
    s = text.rstrip()
    low = s.lower() if "<" in s else ""
    if not any(c.isalnum() for c in s) or is_stand_in(s):
        return "whole", s
    if "�" in s[-3:]:
        return "cut", s
    if low.rfind("<think") > low.rfind("</think>"):
        return "cut", s
    if low.endswith("</think>"):
        return "whole", s
    body = without_thought(s)
    if body.count("```") % 2:
        return "cut", s
    if s.endswith("```"):
        return "whole", s
    mark = _bracketed(s, "[<({（【", "]>)}）】")
    if mark is not None and _MARK_WORD.fullmatch(mark):
        return "cut", s
    lines = body.rstrip().split("\n")
    last = lines[-1]
    if last.lstrip().startswith("|"):
        first = len(lines) - 1
        while first > 0 and lines[first - 1].lstrip().startswith("|"):
            first -= 1
        row = last.strip()
        whole = len(row) > 1 and row.endswith("|") and (first == len(lines) - 1 or row.count("|") == lines[first].count("|"))
        return ("whole" if whole else "cut"), s
    if _EMOJI.fullmatch(s[-1]) or _EMOJI.fullmatch(s[-2:]) or _EMOJI.fullmatch(s[-3:]) or _bracketed(s, "(（", ")）") is not None:
        return "whole", s
    t = s.rstrip(_CLOSERS)
    if not t:
        return "whole", s
    if t[-1] == "…" or t.endswith("..."):
        return "open", t.rstrip("….").rstrip(_CLOSERS)
    if t[-1] in _STOP:
        return "whole", t
    if t != s and s[-1] in "”»」』\"*":
        return "whole", t
    if t[-1] in ",、，:：;；([{-–—/\\&=<" or t.endswith("<|"):
        return "cut", t
    if not t[-1].isalnum():
        return "open", t
    bullet = _BULLET.match(last)
    if bullet and len(lines) > 1:
        item = last[bullet.end() :].strip(_CLOSERS)
        before = _BULLET.match(lines[-2])
        other = lines[-2][before.end() :].strip() if before else ""
        if item and (not before or (other and other[-1] not in _STOP)) and len(item.split()) <= 3 and (before or len(item.split()) <= 2):
            return "list", t
    return "open", t


class _Tokens:
    """Token streams of many texts end to end, as arrays."""

    def __init__(self, texts: list[str]):
        toks: list[str] = []
        ends = []
        for t in texts:
            toks += _TOKEN.findall(t)
            ends.append(len(toks))
            toks.append("\n")
        codes, words = pd.factorize(np.array(toks, dtype=object))
        n = len(words)
        raw, shaped, stop, brk = np.empty(n, U), np.empty(n, U), np.zeros(n, bool), np.zeros(n, bool)
        word = np.zeros(n, bool)
        for i, w in enumerate(words):
            c = w[0]
            if c in _STOP:
                stop[i] = brk[i] = True
                raw[i] = shaped[i] = 0
            elif c == "\n":
                brk[i] = True
                raw[i] = shaped[i] = 0
            elif c.isdigit():
                raw[i] = shaped[i] = 11
            else:
                raw[i] = shaped[i] = xxhash.xxh3_64_intdigest(w.lower().encode())
                if "゠" <= c <= "ヿ":
                    shaped[i] = 13
                elif c.isupper():
                    shaped[i] = 12
                word[i] = len(w) > 1 or not ("぀" <= c <= "힯")
        self.words, self.codes, self.is_word = words, codes, word
        self.raw, self.shaped = mix(raw)[codes], mix(shaped ^ U(77))[codes]
        self.stop, self.brk = stop[codes], brk[codes]
        self.ends = np.array(ends, np.int64)

    def contexts(self, at: np.ndarray, allowed: Bits | None = None):
        """For both spellings and n = 1..ORDERS: (order, positions, hashes of the n tokens that end there).

        ``allowed``: a filter over the top bits of the hashes.  An asked context is asked in every shorter form
        too, so a position that the filter stops is not looked at with longer contexts."""
        run = np.arange(len(self.codes))
        run = run - np.maximum.accumulate(np.where(self.brk, run, -1))  # tokens since the last break
        for kind, base in ((0, self.shaped), (1, self.raw)):
            i, h = at, np.zeros(len(at), U)
            for n in range(1, ORDERS + 1):
                ok = run[i] >= n
                i, h = i[ok], h[ok]
                h = mix(h * U(3) + base[i - n + 1])
                out = mix(h ^ U(n * 2 + kind))
                if allowed is not None:
                    ok = allowed.has(out)
                    i, h, out = i[ok], h[ok], out[ok]
                yield 8 * kind + n - 1, i, out
                if not len(i):
                    break


_ENDS = "rec long, source string, state string, limited boolean, chars int, bytes int, token string, own boolean, ctx array<long>"


def end_features(texts: list[str]) -> list[tuple]:
    """Per text: (state, last token or None, whether the text has it before, context hashes or None)."""
    rows, open_texts = [], []
    for t in texts:
        state, tail = structure(t)
        if state == "open":
            open_texts.append((len(rows), tail))
        rows.append((state, None, False, None))
    if open_texts:
        tk = _Tokens([t for _, t in open_texts])
        ends = tk.ends - 1
        start = np.r_[0, tk.ends[:-1] + 1]
        good = (ends >= start) & ~tk.brk[ends]
        ctx = np.zeros((len(tk.codes), 2 * ORDERS), np.int64) if len(tk.codes) < 1000 else None
        table = {int(e): np.zeros(2 * ORDERS, np.int64) for e in ends[good]} if ctx is None else None
        for o, i, h in tk.contexts(ends[good]):
            v = as_signed(h)
            if ctx is not None:
                ctx[i, o] = v
            else:
                for x, y in zip(i.tolist(), v.tolist(), strict=True):
                    table[x][o] = y
        for (i, tail), a, e, g in zip(open_texts, start.tolist(), ends.tolist(), good.tolist(), strict=True):
            if g:
                c = (ctx[e] if ctx is not None else table[e]).tolist()
                word = tk.words[tk.codes[e]]
                if tk.is_word[tk.codes[e]] and tail[-1:].isalnum():
                    rows[i] = ("open", word.lower(), bool((tk.codes[a:e] == tk.codes[e]).any()), c)
                else:
                    rows[i] = ("open", None, False, c)
    return rows


def _end_batches(batches):
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        use = [x for x in zip(*cols, strict=True) if x[0] is not None]
        yield pa.RecordBatch.from_arrays(end_columns(use, end_features([x[1] or "" for x in use])), schema=_ENDS_ARROW)


def end_columns(use: list[tuple], feats: list[tuple]) -> list[pa.Array]:
    """Columns of _ENDS for rows (rec, text, source, reason)."""
    texts = [x[1] or "" for x in use]
    limited = [(x[3] or "").strip().lower() in LENGTH_REASONS for x in use]
    values = ([x[0] for x in use], [x[2] for x in use], [f[0] for f in feats], limited, [len(t.rstrip("\n")) for t in texts], [len(t.encode("utf-8", "surrogatepass")) for t in texts], *([f[k] for f in feats] for k in (1, 2, 3)))
    return [pa.array(v, f.type) for v, f in zip(values, _ENDS_ARROW, strict=True)]


_ENDS_ARROW = pa.schema([("rec", pa.int64()), ("source", pa.string()), ("state", pa.string()), ("limited", pa.bool_()), ("chars", pa.int32()), ("bytes", pa.int32()), ("token", pa.string()), ("own", pa.bool_()), ("ctx", pa.list_(pa.int64()))])


def _asked_filter(ends: DataFrame) -> Bits:
    """The filter of the contexts that are asked for, sized by their number."""
    asked = ends.where("ctx is not null").select(F.explode("ctx").alias("c")).where("c <> 0")
    return Bits.of(asked, "c", FILTER_BITS)


def _corpus_batches(asked):
    """('c', context, seen, closes) and ('w', word, seen) over all texts, summed within a batch."""

    def run(batches):
        bits = asked.value
        vocab: dict[str, int] = {}
        keys, seen, closes = [], [], []

        def folded():
            inv, k = pd.factorize(np.concatenate(keys))  # by hash: a context comes many times
            return k, np.bincount(inv, np.concatenate(seen)).astype(np.int64), np.bincount(inv, np.concatenate(closes)).astype(np.int64)

        held = 0
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at in range(0, len(texts), 10_000):
                tk = _Tokens(texts[at : at + 10_000])
                close = np.r_[tk.stop[1:], False]
                last = np.zeros(len(tk.codes), bool)
                last[tk.ends] = True
                known = ~tk.brk & ~np.r_[last[1:], False]  # whatever follows the token, it is not the end of the text
                n = np.bincount(tk.codes[known], minlength=len(tk.words))
                for i in np.flatnonzero((n > 0) & tk.is_word):
                    w = tk.words[i].lower()
                    vocab[w] = vocab.get(w, 0) + int(n[i])
                for _, i, h in tk.contexts(np.flatnonzero(known), bits):
                    if len(i):
                        keys.append(h)
                        seen.append(np.ones(len(i)))
                        closes.append(close[i].astype(float))
                        held += len(i)
                if held > 3_000_000:
                    k, s, c = folded()
                    keys, seen, closes, held = [k], [s.astype(float)], [c.astype(float)], len(k)
                    if held > 1_500_000:
                        yield _counts(k, s, c)
                        keys, seen, closes, held = [], [], [], 0
                if len(vocab) > 400_000:
                    yield _words(vocab)
                    vocab = {}
        if keys:
            yield _counts(*folded())
        yield _words(vocab)

    return run


def _counts(k, s, c):
    n = len(k)
    return pa.RecordBatch.from_arrays([pa.array(as_signed(k)), pa.nulls(n, pa.string()), pa.array(s), pa.array(c)], ["ctx", "word", "seen", "closes"])


def _words(v: dict[str, int]):
    n = len(v)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(list(v), pa.string()), pa.array(list(v.values()), pa.int64()), pa.array(np.zeros(n, np.int64))], ["ctx", "word", "seen", "closes"])


def _trie_batches(batches):
    """Walk of the trie in sorted order: for each asked token, its own count and its known extensions."""
    path: list[list] = []  # asked tokens that are prefixes of the present word: [token, own count, extensions]
    shard = None
    for batch in batches:
        out = []
        for s, w, seen, ask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            while path and not (s == shard and w.startswith(path[-1][0])):
                out.append(path.pop())
            shard = s
            if ask:
                path.append([w, seen, 0])
            if seen >= 2:
                for p in path:
                    if len(p[0]) < len(w):
                        p[2] += seen
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["token", "known", "extensions"])
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in path], pa.string()), pa.array([x[1] for x in path], pa.int64()), pa.array([x[2] for x in path], pa.int64())], ["token", "known", "extensions"])


def vocabulary_prefixes(words: DataFrame, asked: DataFrame) -> DataFrame:
    """token, known (its count as a word), extensions (uses of known words, seen twice or more, of which it is a proper prefix).

    The shard of a word is its first three letters.  Tokens of one and two letters would draw whole letters of the
    vocabulary into one task; their extensions are plain sums over the words that begin so."""
    v = words.groupBy("word").agg(F.sum("seen").alias("seen"))
    a = asked.select(F.col("token").alias("word")).where("word is not null").distinct()
    all_ = v.join(a.withColumn("ask", F.lit(True)), "word", "full").select("word", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("ask", F.lit(False)).alias("ask"))
    all_ = all_.where("seen >= 2 or ask")
    long = all_.where("length(word) >= 3").withColumn("shard", F.substring("word", 1, 3))
    need = a.where("length(word) >= 3").select(F.substring("word", 1, 3).alias("shard")).distinct()
    walked = long.join(need, "shard", "left_semi").select("shard", "word", "seen", "ask")
    walked = walked.repartition("shard").sortWithinPartitions("shard", "word").mapInArrow(_trie_batches, "token string, known long, extensions long")
    heads = all_.where("seen >= 2").select(F.explode(F.expr("filter(array(substr(word, 1, 1), if(length(word) > 1, substr(word, 1, 2), null)), p -> length(p) < length(word))")).alias("word"), "seen")
    heads = heads.groupBy("word").agg(F.sum("seen").alias("extensions"))
    short = all_.where("ask and length(word) <= 2").join(heads, "word", "left").select(F.col("word").alias("token"), F.col("seen").alias("known"), F.coalesce("extensions", F.lit(0)).alias("extensions"))
    return walked.union(short)


def length_spikes(ends: DataFrame) -> DataFrame:
    """source, unit, size: lengths at which records of a source end without a stop far more often than at the
    lengths around: five records or more, and over eight times the mean of the twenty lengths on either side."""
    e = ends.where("state in ('open', 'cut') and source is not null")
    n = e.select("source", F.expr("explode(map('chars', chars, 'bytes', bytes))").alias("unit", "size")).groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-20, 20)
    around = (F.sum("n").over(w) - F.col("n")) / 40.0
    return n.withColumn("around", around).where("n >= 5 and n > 8 * (around + 0.1)").select("source", "unit", "size")


def judged(records: DataFrame, rec: str = "gen_id", text: str = "response_text", source: str = "model", reason: str = "finish_reason", cut_below: float = 0.04) -> DataFrame:
    """rec, source, cut: one row per record.

    NULL and blank texts are not cut (they are empty); repeated deliveries count once; a NULL source has no
    length evidence; columns other than the four named are not read; empty input gives no rows."""
    use = records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(reason).alias("why"))
    ends = materialise(spread(use).mapInArrow(_end_batches, _ENDS).dropDuplicates(["rec"]), "cut-ends")
    return judge(ends, use.select("text"), cut_below)


def judge(ends: DataFrame, texts: DataFrame, cut_below: float = 0.04) -> DataFrame:
    """The decision over text ends (columns of _ENDS) with the statistics of all ``texts``."""
    spark = ends.sparkSession
    asked = spark.sparkContext.broadcast(_asked_filter(ends))  # at most 2 ** FILTER_BITS[1] bits
    stats = materialise(spread(texts).mapInArrow(_corpus_batches(asked), "ctx long, word string, seen long, closes long"), "cut-corpus")
    ctx = stats.where("ctx is not null").groupBy("ctx").agg(F.sum("seen").alias("seen"), F.sum("closes").alias("closes"))
    trie = vocabulary_prefixes(stats.where("word is not null").select("word", "seen"), ends.where("token is not null and not own"))
    open_ = ends.where("state = 'open' and ctx is not null").select("rec", F.posexplode("ctx").alias("i", "ctx")).where("ctx <> 0")
    p = open_.join(ctx, "ctx").groupBy("rec").agg(F.array_sort(F.collect_list(F.struct(F.expr("i % 8 * 2 + cast(i / 8 as int)").alias("o"), "seen", "closes"))).alias("l"))
    p = p.select("rec", F.expr("aggregate(l, 0.12D, (p, x) -> (x.closes + 4 * p) / (x.seen + 4))").alias("p"))
    spikes = length_spikes(ends)
    out = ends.join(p, "rec", "left").join(trie, "token", "left")
    by = lambda u: spikes.where(F.col("unit") == u).select("source", F.col("size").alias(u), F.lit(True).alias(f"at_{u}"))
    out = out.join(by("chars"), ["source", "chars"], "left").join(by("bytes"), ["source", "bytes"], "left")
    spike = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    torn = F.col("token").isNotNull() & ~F.col("own") & (F.coalesce("extensions", F.lit(0)) > 0) & (F.coalesce("known", F.lit(0)) * 100 <= F.col("extensions"))
    cut = (
        F.when(F.col("state") == "cut", True)
        .when(F.col("state") == "whole", False)
        .when(F.col("state") == "list", spike)
        .otherwise(torn | spike | F.col("limited") | (F.coalesce("p", F.lit(0.12)) < cut_below))
    )
    return out.select("rec", "source", cut.alias("cut"), "state", "p", torn.alias("torn"), spike.alias("spike"), "limited")


def truncated(records: DataFrame, **kw) -> DataFrame:
    """gen_id of the records whose text was cut."""
    return judged(records, **kw).where("cut").select(F.col("rec").alias("gen_id"))


def truncation_rates(records: DataFrame, **kw) -> DataFrame:
    """source, n, n_cut, share."""
    j = judged(records, **kw)
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share"))
