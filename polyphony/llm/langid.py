"""Language of texts and of stretches of text.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained by follow-the-regularised-
leader with an elastic-net penalty, then calibrated by one temperature on held-out sentences.  Training
takes a bounded sample of labelled rows (``per_label`` texts of each language, chosen by a hash of the
key); labels are noisy, so first the labels of the sample are corrected, twice, by the vote of
each text's sentences under a model fitted on the other half, and the model is fitted on what results.  Every text is then scored sentence by sentence, whole.

A word (or up to four CJK characters) contributes a fixed vector, the sum over its n-grams of weight times
inverse document frequency, so a sentence is the normalised sum of its words and each distinct word is
worked out once per worker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.llm.common import U, code_points, mix, spread
from polyphony.session import materialise

# The languages.
LANGS = ("en", "es", "ru", "zh", "de", "fr", "ca", "pt-BR", "it", "ja", "eu", "pl", "vi")
# Labels that name no language.
UNKNOWN = ("", "und", "unknown", "unk", "none", "null", "nan", "n/a", "na", "?", "??", "-", "--", "xx", "xxx", "mul", "mis", "zxx", "other", "undefined", "undetermined", "not available", "missing", "auto")
# Names and three-letter codes of the languages.
NAMES = {
    "en": "english eng", "es": "spanish español espanol castellano spa", "ru": "russian русский rus", "zh": "chinese 中文 mandarin zho chi cmn",
    "de": "german deutsch deu ger", "fr": "french français francais fra fre", "ca": "catalan català catala cat", "pt-BR": "portuguese português portugues por pt",
    "it": "italian italiano ita", "ja": "japanese 日本語 jpn jp", "eu": "basque euskara eus baq", "pl": "polish polski pol", "vi": "vietnamese vie tiếng",
}
_ALIAS = {n: k for k, v in NAMES.items() for n in v.split()} | {k.lower(): k for k in LANGS}


def base_language(label: str | None) -> str | None:
    """Base language of a label, None where it names none; a language outside the list is its lower-case base code."""
    s = (label or "").strip().lower()
    if s in UNKNOWN:
        return None
    b = re.split(r"[-_ .@]", s)[0]
    return _ALIAS.get(s) or _ALIAS.get(b) or b


@dataclass(frozen=True)
class LangId:
    """Parameters.  ``per_label``: texts and ``sentences``: sentences of each language in the training sample; ``strong``:
    least probability of a sentence's language; ``against``: what a short sentence must leave the language of its text."""

    per_label: int = 1500
    sentences: int = 2500
    buckets: int = 1 << 18
    l1: float = 0.02
    l2: float = 0.1
    alpha: float = 1.0
    epochs: int = 2
    batch: int = 256
    seed: int = 7
    strong: float = 0.93
    against: float = 1e-4
    least_letters: int = 10


_CJK = "぀-ヿ㐀-鿿"
_TOK = re.compile(rf"[^\W\d_{_CJK}々ー]+(?:['’·][^\W\d_{_CJK}々ー]+)*|[{_CJK}々ー]{{1,4}}|[.!?…]+(?!\w)|[。！？]|\n+|[()（）“”«»「」|]")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SEP = frozenset(".!?…。！？\n()（）“”«»「」|")
_STOP = frozenset(".!?…。！？")


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"


def _script(c: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Chinese or Japanese."""
    return 2 if _is_cjk(c) else int("Ѐ" <= c <= "ӿ")


_SCRIPT_OF = np.array([{"ru": 1, "zh": 2, "ja": 2}.get(x, 0) for x in LANGS])


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, number for each word): the character n-grams of each word (1 to 4, word ends marked; 1 and 2 in
    CJK) and the word itself, hashed."""
    low = [w.lower() for w in words]
    cjk = np.array([_is_cjk(w[0]) for w in low], bool)
    padded = [w if c else f" {w} " for w, c in zip(low, cjk.tolist(), strict=True)]
    a, off = code_points(padded)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(a)) - off[owner]
    left = size[owner] - at
    owners, feats = [np.arange(len(words))], [np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in low], U)]
    h = np.zeros(len(a), U)
    for n in (1, 2, 3, 4):
        h[: len(a) - n + 1] = mix(h[: len(a) - n + 1] * U(3) + a[n - 1 :].astype(U) + U(n))
        ok = (left >= n) & (~cjk[owner] | (n <= 2)) & ((n > 1) | (a != 32))
        owners.append(owner[ok])
        feats.append(h[ok] ^ U(n))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(feats)[order] % U(buckets)).astype(np.int64), np.bincount(owners, minlength=len(words))


class Sentences:
    """Texts cut into sentences of tokens, as arrays."""

    def __init__(self, texts: list[str]):
        toks: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            toks += _TOK.findall(_CODE.sub("\n", t) if "```" in t else t)
            toks.append("\n")
            ends[i] = len(toks)
        codes, self.words = pd.factorize(np.array(toks, dtype=object))
        sep = np.array([w[0] in _SEP for w in self.words], bool)[codes]
        n_letters = np.array([0 if w[0] in _SEP else len(w) for w in self.words], np.int64)
        cjk = np.array([_is_cjk(w[0]) for w in self.words], bool)
        text = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
        keep = ~sep
        sent = np.cumsum(sep)[keep]
        self.codes, text = codes[keep], text[keep]
        first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]]) if len(sent) else np.zeros(0, np.int64)
        self.first = first
        self.text = text[first]
        self.count = np.diff(np.r_[first, len(sent)])
        add = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0, np.int64)
        self.letters = add(n_letters[self.codes])
        self.wide = add(cjk[self.codes].astype(np.int64) * n_letters[self.codes])
        at = np.flatnonzero(keep)
        self.span = np.stack([at[first], at[np.r_[first[1:], len(at)] - 1]], 1) if len(first) else np.zeros((0, 2), np.int64)
        self.stopped = np.array([w[0] in _STOP for w in self.words], bool)[codes[self.span[:, 1] + 1]] if len(first) else np.zeros(0, bool)
        script = np.array([0 if w[0] in _SEP else _script(w[0]) for w in self.words], np.int64)[self.codes]
        lo, hi = (np.minimum.reduceat(script, first), np.maximum.reduceat(script, first)) if len(first) else (np.zeros(0, np.int64),) * 2
        self.script = np.where(lo == hi, lo, -1)  # -1: several
        self.ends, self.n = ends, len(texts)
        self.text_letters = np.bincount(self.text, self.letters, minlength=len(texts)).astype(np.int64)

    @property
    def eligible(self) -> np.ndarray:
        """Long enough to bear a language of its own: four words and fifteen letters, or eight CJK characters."""
        return ((self.count >= 4) & (self.letters >= 15)) | (self.wide >= 8)

    @property
    def short(self) -> np.ndarray:
        """Whole sentences under that length: two words or more, or four CJK characters, ended by a stop."""
        return ~self.eligible & ((self.count >= 2) | (self.wide >= 4)) & self.stopped


class Model:
    """Weights (buckets x languages), inverse document frequencies, bias and temperature."""

    def __init__(self, cfg: LangId, w, idf, bias, temperature):
        self.cfg, self.w, self.idf, self.bias, self.temperature = cfg, w, idf, bias, temperature
        self._index: dict[str, int] = {}
        self._rows: list[np.ndarray] = []

    def __reduce__(self):
        return Model, (self.cfg, self.w, self.idf, self.bias, self.temperature)

    def vectors(self, words) -> np.ndarray:
        """Per word: its score for each language, then its squared length."""
        if len(self._index) > 400_000:
            self._index, self._rows = {}, []
        new = [w for w in words if w not in self._index]
        if new:
            f, size = word_features(new, self.cfg.buckets)
            start = np.cumsum(np.r_[0, size[:-1]])
            idf = self.idf[f]
            v = np.concatenate([np.add.reduceat(self.w[f] * idf[:, None], start), np.add.reduceat(idf * idf, start)[:, None]], 1)
            base = sum(map(len, self._rows))
            for i, w in enumerate(new):
                self._index[w] = base + i
            self._rows.append(v.astype(np.float32))
            if len(self._rows) > 1:
                self._rows = [np.concatenate(self._rows)]
        return self._rows[0][np.fromiter((self._index[w] for w in words), np.int64, len(words))]

    def score(self, s: Sentences) -> np.ndarray:
        """Logits of each sentence."""
        if not len(s.first):
            return np.zeros((0, len(LANGS)), np.float32)
        v = np.add.reduceat(self.vectors(s.words)[s.codes], s.first)
        return v[:, :-1] / np.sqrt(np.maximum(v[:, -1:], 1e-9)) + self.bias

    def prob(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _fit_once(cfg: LangId, rows: list[np.ndarray], y: np.ndarray, idf: np.ndarray, use: np.ndarray):
    """Mini-batch FTRL-proximal over the sentences ``use``; rows are the bucket lists of the sentences."""
    k = len(LANGS)
    z, n = np.zeros((cfg.buckets, k), np.float32), np.zeros((cfg.buckets, k), np.float32)
    zb, nb = np.zeros(k), np.zeros(k)
    norm = [np.sqrt(float((idf[r] ** 2).sum())) or 1.0 for r in rows]
    rng = np.random.default_rng(cfg.seed)

    def weights(zz, nn):
        w = -(zz - np.sign(zz) * cfg.l1) / ((1 + np.sqrt(nn)) / cfg.alpha + cfg.l2)
        return np.where(np.abs(zz) <= cfg.l1, 0, w).astype(np.float32)

    def bias():
        return -zb / ((1 + np.sqrt(nb)) / cfg.alpha + cfg.l2)

    for _ in range(cfg.epochs):
        order = rng.permutation(use)
        for o in range(0, len(order), cfg.batch):
            pick = order[o : o + cfg.batch]
            f = np.concatenate([rows[i] for i in pick])
            size = np.array([len(rows[i]) for i in pick])
            val = idf[f] / np.repeat([norm[i] for i in pick], size)
            u, inv = np.unique(f, return_inverse=True)
            w = weights(z[u], n[u])
            start = np.cumsum(np.r_[0, size[:-1]])
            logit = np.add.reduceat(w[inv] * val[:, None], start) + bias()
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = np.empty((len(u), k), np.float32)
            e = np.repeat(np.arange(len(pick)), size)
            for c in range(k):
                g[:, c] = np.bincount(inv, val * p[e, c], minlength=len(u))
            sigma = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / cfg.alpha
            z[u] += g - sigma * w
            n[u] += g * g
            gb = p.sum(0)
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / cfg.alpha * bias()
            nb += gb * gb
    return weights(z, n), bias().astype(np.float32)


def fit(texts: list[str], labels: list[str], cfg: LangId = LangId()) -> Model:
    """Train on labelled texts; labels are of LANGS and may be noisy."""
    cls = {c: i for i, c in enumerate(LANGS)}
    s = Sentences(texts)
    y = np.array([cls[x] for x in labels], np.int64)[s.text] if len(s.text) else np.zeros(0, np.int64)
    rng = np.random.default_rng(cfg.seed)
    picks = []
    for c in range(len(LANGS)):
        i = np.flatnonzero((y == c) & (s.letters >= 6))
        picks.append(rng.permutation(i)[: cfg.sentences])
    pick = np.sort(np.concatenate(picks))
    if not len(pick):
        return Model(cfg, np.zeros((cfg.buckets, len(LANGS)), np.float32), np.ones(cfg.buckets, np.float32), np.zeros(len(LANGS), np.float32), 1.0)
    stop = np.r_[s.first[1:], len(s.codes)]
    flat, size = word_features(list(s.words), cfg.buckets)
    feats = np.split(flat, np.cumsum(size)[:-1])

    def row(i):
        return np.concatenate([feats[c] for c in s.codes[s.first[i] : stop[i]]])

    rows, y = [row(i) for i in pick], y[pick]
    df = np.zeros(cfg.buckets)
    for r in rows:
        df[np.unique(r)] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    held = rng.random(len(rows)) < 0.15
    owner = s.text[pick]
    fold = (mix(owner.astype(np.uint64)) % np.uint64(2)).astype(np.int64)
    norm = [np.sqrt(max(float((idf[r] ** 2).sum()), 1e-9)) for r in rows]

    def logits_of(w, b, which):
        return np.stack([(w[rows[i]] * idf[rows[i]][:, None]).sum(0) / norm[i] for i in which]) + b if len(which) else np.zeros((0, len(LANGS)))

    # Labels stand for whole texts and some are wrong, often for many texts at once.  A text takes the language that its
    # sentences vote for under a model that has not seen it; sentences that disagree with their text are left out.
    keep = np.ones(len(rows), bool)
    for _ in range(2):
        logits = np.zeros((len(rows), len(LANGS)))
        for half in (0, 1):
            w, b = _fit_once(cfg, rows, y, idf, np.flatnonzero(keep & (fold != half)))
            at = np.flatnonzero(fold == half)
            logits[at] = logits_of(w, b, at)
        whole = np.stack([np.bincount(owner, logits[:, c], minlength=s.n) for c in range(len(LANGS))], 1)
        y = whole.argmax(1)[owner]
        keep = logits.argmax(1) == y
    w, b = _fit_once(cfg, rows, y, idf, np.flatnonzero(keep & ~held))
    model = Model(cfg, w, idf, b, 1.0)
    logits = logits_of(w, b, np.arange(len(rows)))
    held &= keep
    h = np.flatnonzero(held)
    if len(h) >= 20:
        best = (np.inf, 1.0)
        for t in np.geomspace(0.05, 5, 60):
            z = logits[h] / t
            z -= z.max(1, keepdims=True)
            nll = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(h)), y[h]]))
            best = min(best, (nll, float(t)))
        model.temperature = best[1]
    return model


def _base_batches(batches):
    """label, n -> base, n: the language of LANGS that a label names, if any."""
    for batch in batches:
        base = [b if (b := base_language(x)) in LANGS else None for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(base, pa.string()), batch.column(1)], ["base", "n"])


def _sample_batches(share: dict[str, float]):
    """label, u, text -> text, base: the rows whose draw ``u`` lies under the share of their language."""

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            label, u = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x in set(label) - known.keys():
                known[x] = base_language(x)
            base = [known[x] for x in label]
            ok = pa.array([v < share.get(b, 0.0) for b, v in zip(base, u, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(ok), pa.array(base, pa.string()).filter(ok)], ["text", "base"])

    return run


def _labelled(records: DataFrame, cfg: LangId) -> tuple[list[str], list[str]]:
    """The bounded training sample: about ``per_label`` texts of each language, by a hash of the key."""
    seen = records.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    per = {r.base: r.n for r in seen.mapInArrow(_base_batches, "base string, n long").where("base is not null").groupBy("base").agg(F.sum("n").alias("n")).collect()}  # a row a language
    if not per:
        return [], []
    share = {b: min(1.0, cfg.per_label / n) for b, n in per.items()}
    u = F.expr("pmod(xxhash64(rec_id, 5), 1000003) / 1000003.0D")
    few = records.where("label is not null and text is not null").select("label", u.alias("u"), "text").where(F.col("u") < max(share.values()))
    got = few.mapInArrow(_sample_batches(share), "text string, base string").toPandas()
    got = got.sort_values("text").groupby("base").head(2 * cfg.per_label)
    return got.text.tolist(), got.base.tolist()


def subjects(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """rec_type, rec_id, label, text of responses and prompts (deliveries not yet made unique)."""
    r = responses.select(F.lit("response").alias("rec_type"), F.col("gen_id").cast("string").alias("rec_id"), F.col("language").alias("label"), F.col("response_text").alias("text"))
    p = prompts.select(F.lit("prompt").alias("rec_type"), F.col("prompt_id").alias("rec_id"), F.col("language").alias("label"), F.col("prompt_text").alias("text"))
    return r.union(p)


def train(records: DataFrame, cfg: LangId = LangId()) -> Model:
    """records: rec_id, label, text."""
    return fit(*_labelled(records, cfg), cfg)


def assess(model: Model, texts: list[str]):
    """Per text: (letters, language or None, confidence, [(language, confidence, first token, last token)] of its stretches)."""
    s = Sentences(texts)
    logits = model.score(s)
    k = len(LANGS)
    n = s.n
    out_lang = np.full(n, -1)
    conf = np.zeros(n)
    ok = s.eligible
    weight = np.where(ok, np.sqrt(np.maximum(s.count, 1)), 0.25)
    total = np.stack([np.bincount(s.text, logits[:, c] * weight, minlength=n) for c in range(k)], 1) if len(s.text) else np.zeros((n, k))
    has = np.bincount(s.text, minlength=n) > 0
    if has.any():
        p = model.prob(total[has] / np.maximum(1, np.bincount(s.text, weight, minlength=n)[has])[:, None] ** 0.5)
        out_lang[has] = p.argmax(1)
        conf[has] = p.max(1)
    p = model.prob(logits) if len(logits) else logits
    top = p.argmax(1) if len(p) else np.zeros(0, np.int64)
    strong = np.zeros(0, bool)
    if len(p):
        own = out_lang[s.text]
        sure = p.max(1) >= model.cfg.strong
        # A short sentence bears its text's language like any other, and another one where its script is another or
        # where next to nothing is left for the text's.
        foreign = (s.script >= 0) & (s.script != _SCRIPT_OF[own]) & (s.script == _SCRIPT_OF[top])
        strong = (s.eligible & sure) | (s.short & (foreign | (sure & ((top == own) | (p[np.arange(len(p)), own] < model.cfg.against)))))
    other = strong & (top != out_lang[s.text])
    stretches: dict[int, list] = {}
    mixed = np.unique(s.text[other])
    if len(mixed):
        lo, hi = np.searchsorted(s.text, mixed), np.searchsorted(s.text, mixed, "right")
        for t, a, b in zip(mixed, lo, hi, strict=True):
            runs: list[list] = []
            for i in range(a, b):
                if not strong[i]:
                    if runs:
                        runs[-1][3] = int(s.span[i, 1])
                    continue
                if runs and runs[-1][0] == top[i]:
                    runs[-1][1] = 1 - (1 - runs[-1][1]) * (1 - float(p[i].max()))
                    runs[-1][3] = int(s.span[i, 1])
                else:
                    runs.append([int(top[i]), float(p[i].max()), int(s.span[i, 0]), int(s.span[i, 1])])
            off = int(s.ends[t - 1]) if t else 0
            stretches[int(t)] = [(LANGS[c], q, x - off, y - off) for c, q, x, y in runs]
    return s.text_letters, out_lang, conf, stretches


_OUT = "rec_type string, rec_id string, label string, base string, letters long, lang string, confidence double, stretches array<struct<lang:string,confidence:double,first:int,last:int>>"
_OUT_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))


def _assess_batches(shared):
    def run(batches):
        model = shared.value
        bases: dict[str | None, str | None] = {}
        for batch in batches:
            a, b, c, texts = (batch.column(i).to_pylist() for i in range(4))
            for x in set(c) - bases.keys():
                bases[x] = base_language(x)
            for o in range(0, len(texts), 2000):
                letters, lang, conf, st = assess(model, [x or "" for x in texts[o : o + 2000]])
                m = len(letters)
                parts = [[dict(zip(("lang", "confidence", "first", "last"), x, strict=True)) for x in st.get(i, [])] for i in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[o : o + m], pa.string()), pa.array(b[o : o + m], pa.string()), pa.array(c[o : o + m], pa.string()), pa.array([bases[x] for x in c[o : o + m]], pa.string()), pa.array(letters, pa.int64()), pa.array([LANGS[x] if x >= 0 else None for x in lang], pa.string()), pa.array(conf), pa.array(parts, _OUT_TYPE)],
                    ["rec_type", "rec_id", "label", "base", "letters", "lang", "confidence", "stretches"],
                )

    return run


def identify(records: DataFrame, model: Model | None = None, cfg: LangId = LangId()) -> DataFrame:
    """rec_type, rec_id, label, base, letters, lang, confidence, stretches: one row per record.

    ``base`` is the base language that the label names, NULL where it names none.  ``lang`` is NULL where the text is NULL or has no letters.  ``stretches`` is filled where strong sentences
    are in two or more languages, with token offsets.  Repeated rows of a record count once."""
    spark = records.sparkSession
    model = model or train(records, cfg)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: buckets x languages
    out = spread(records.where("rec_id is not null").select("rec_type", "rec_id", "label", "text")).mapInArrow(_assess_batches(shared), _OUT)
    return out.dropDuplicates(["rec_type", "rec_id"])


def label_issues(responses: DataFrame, prompts: DataFrame, cfg: LangId = LangId()) -> DataFrame:
    """rec_type, rec_id, issue ('missing', 'wrong', 'mixed'), lang."""
    got = materialise(identify(subjects(responses, prompts), cfg=cfg).where(F.col("letters") >= cfg.least_letters), "langid")
    several = F.array_sort(F.array_distinct(F.transform("stretches", lambda x: x["lang"])))
    got = got.withColumn("langs", several)
    mixed = got.where("size(langs) > 1").select("rec_type", "rec_id", F.lit("mixed").alias("issue"), F.explode("langs").alias("lang"))
    one = got.where("size(langs) <= 1 and lang is not null")
    one = one.withColumn("issue", F.when(F.col("base").isNull(), "missing").when(F.col("base") != F.col("lang"), "wrong"))
    return one.where("issue is not null").select("rec_type", "rec_id", "issue", "lang").union(mixed)
