"""Defects of prompt-response pairs: empty, truncated, refusal, copy, other_language.

Responses are sorted by text, all together: whatever begins with a text follows it, so a walk that keeps the open
prefixes of the present text meets every continuation, and a text that another one continues with a word is a
shortened version of it.  Only texts that begin as some unfinished text begins take part, each once; the sort is by
range, so no prefix makes one task hold more than its share; prefixes still open at the end of a range are held against
the rest in a second, tiny step.  Length-limit spikes and the statistics of text ends come from the truncation operator.  Copy, refusal and language rules read the response together with
its prompt in one map.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.llm import langid, truncation
from polyphony.llm.common import Bits, U, partitions_for, spread
from polyphony.session import materialise

# What a refusal says, as patterns over a lower-case sentence without markup, by language.
REFUSALS = {
    "en": r"\b(?:can'?t|cannot|can not|won'?t|unable to|not able to|not allowed to|not permitted to)\b(?! help but)(?! wait)(?! stop)(?! deny).{0,40}\b(?:help|assist|comply|answer|respond|provide|discuss|talk|write|share|fulfil|support|engage|do that|do this)|\b(?:must|have to|need to)\b.{0,12}\b(?:decline|refuse|pass|say no)|\b(?:i|we) (?:decline|refuse)\b|rather not (?:discuss|talk|answer|say)|not comfortable (?:answering|discussing|with)|against my (?:guidelines|policy|policies|rules)|conflict with the rules|outside what i am allowed|(?:wouldn'?t|would not) be appropriate|^sorry no$",
    "es": r"\bno (?:puedo|podemos|me es posible|debo)\b(?! dejar de).{0,25}\b(?:ayudar|responder|contestar|hablar|escribir|cumplir|proporcionar|atender)|(?:debo|tengo que) (?:negarme|rechazar|declinar)|prefiero no|en contra de mis (?:normas|directrices|reglas|políticas)",
    "pt": r"\bnão (?:posso|consigo|devo|podemos)\b(?! deixar de).{0,25}\b(?:ajudar|responder|falar|escrever|atender|fornecer|cumprir)|(?:preciso|devo|tenho de|tenho que) (?:recusar|me recusar|negar)|prefiro não|contra (?:as )?minhas (?:normas|diretrizes|regras|políticas)",
    "fr": r"\b(?:ne peux|ne peut|ne pourrai|ne suis pas en mesure|ne pouvons)\b(?! m'empêcher)(?! que).{0,30}\b(?:aider|répondre|parler|écrire|fournir|satisfaire|aborder)|(?:dois|devons) (?:refuser|décliner)|préfère ne pas|contraire à mes (?:consignes|règles|directives)",
    "de": r"\b(?:kann|darf|könnte|möchte|können)\b.{0,40}\bnicht\b(?! umhin)(?! anders).{0,20}\b(?:helfen|beantworten|antworten|weiterhelfen|unterstützen|erfüllen|äußern|schreiben)|verstößt gegen meine|(?:muss|müssen) .{0,12}(?:ablehnen|abzulehnen|verweigern)|lieber nicht (?:sprechen|reden|antworten)|kann ich (?:dabei |dir |ihnen )?nicht helfen",
    "it": r"\bnon (?:posso|possiamo|sono in grado|mi è possibile)\b(?! fare a meno)(?! che).{0,25}\b(?:aiutar|risponder|parlar|scriver|fornir|soddisfar)|(?:devo|dobbiamo) (?:rifiutar|declinar)|preferisco non|contr(?:o|ario a\w*) (?:le |alle )?mie (?:regole|linee|norme|politiche)",
    "ca": r"\bno (?:puc|podem|em és possible)\b(?! deixar de)(?! evitar).{0,25}\b(?:ajudar|respondre|parlar|escriure|atendre|proporcionar)|(?:he de|haig de) (?:negar|rebutjar|declinar)|(?:prefereixo|m'estimo més|preferiria) no|contra de? les meves (?:normes|directrius|regles)|contra les meves",
    "ru": r"\bне (?:могу|можем|в состоянии|вправе)\b(?! не ).{0,30}(?:помо|ответ|обсужд|написа|предостав|выполн)|вынужден\w* отказ|предпоч\w+ бы не|не хо(?:чу|тел\w*).{0,20}(?:обсужд|говорить)|против(?:оречит|) мои(?:м|х) (?:правил|принцип|инструкц)",
    "pl": r"\bnie (?:mogę|możemy|jestem w stanie|wolno mi)\b(?! nie )(?! się oprzeć)(?! się doczekać).{0,30}(?:pomóc|odpowied|rozmawiać|napisać|pisać|udzielić|spełnić)|muszę odmówić|wolę (?:o tym )?nie|niezgodn\w+ z moimi|sprzeczn\w+ z moimi|narusza moje",
    "eu": r"\bezin (?:diot|dizut|dut|naiz|dizuet|diegu)\b.{0,40}(?:lagundu|erantzun|idatzi|hitz egin|eman)|\bezin\b.{0,6}\b(?:lagundu|erantzun)|nahiago dut.{0,30}\bez\b|uko egin (?:behar|beharrean)|nire (?:arauen|jarraibideen) (?:aurka|kontra)",
    "vi": r"không (?:thể|được phép)(?! không).{0,25}(?:giúp|trả lời|viết|đáp ứng|cung cấp|hỗ trợ|thảo luận|bàn)|không muốn (?:bàn|nói|thảo luận)|(?:phải|buộc phải|đành) từ chối|trái với (?:nguyên tắc|quy định|chính sách)|vi phạm (?:nguyên tắc|quy định|chính sách) của tôi",
    "zh": r"(?:不能|无法|不便|不可以|没办法)(?!不).{0,14}(?:帮|回答|协助|提供|讨论|满足|完成|写)|必须拒绝|只能拒绝|不得不拒绝|不想谈|不愿(?:意)?(?:谈|讨论|回答)|违反(?:了)?我的|与我的(?:准则|规则)|不符合我的(?:准则|规定|原则)",
    "ja": r"(?:お応え|お答え|お手伝い|お受け|ご協力|対応|提供|回答|答える|書く|手伝う|執筆).{0,6}(?:できません|できかねます|できない|いたしかね|ことはでき)|控え(?:させて|ます)|お断り|断ら(?:なければ|ざるを)|(?:方針|ガイドライン|規則|ポリシー)に(?:反し|違反)|書くことはできません|ご遠慮",
}
# What a sentence must contain for the pattern of the language to be tried at all.
STEMS = {
    "en": ["can", "won", "able", "not ", "decline", "refuse", "pass", "say no", "against my", "conflict with", "outside what", "appropriate", "sorry no"],
    "es": ["no ", "negarme", "rechazar", "declinar", "prefiero no", "en contra de mis"],
    "pt": ["não", "recusar", "negar", "minhas"],
    "fr": ["ne ", "refuser", "décliner", "contraire"],
    "de": ["nicht", "verstößt", "ablehnen", "abzulehnen", "verweigern"],
    "it": ["non ", "non", "rifiutar", "declinar", "mie "],
    "ca": ["no ", " no", "negar", "rebutjar", "declinar", "meves"],
    "ru": ["не", "отказ", "против"],
    "pl": ["nie", "odmówić", "moimi", "moje"],
    "eu": ["ezin", "nahiago", "uko egin", "nire "],
    "vi": ["không", "từ chối", "trái với", "vi phạm"],
    "zh": ["不", "无法", "没办法", "拒绝", "违反", "与我的"],
    "ja": ["でき", "いたしかね", "答える", "書く", "手伝う", "控え", "お断り", "断ら", "反し", "違反", "ご遠慮"],
}
# Openings, closings and offers that give nothing, as patterns over a whole such sentence.
FILLERS = (
    r"sure|of course|certainly|absolutely|great question|good question|no problem|sorry(?: no)?|i'?m sorry|my apologies|unfortunately|here is (?:an|the|my) answer|here'?s (?:an|the|my) answer|i hope (?:this|that) helps|is there anything else.*|please ask (?:me )?(?:something|anything) else|(?:do )?(?:you )?(?:have )?any other questions|thanks?(?: you)?(?: for asking)?|let me know.*|i can'?t|no",
    r"claro|por supuesto|desde luego|buena pregunta|aquí tienes (?:una|la) respuesta|espero que (?:esto )?te sirva|pregúntame otra cosa|lo siento|lamentablemente|¿?(?:necesitas|hay) algo más.*|perdona|disculpa",
    r"claro(?: que sim)?|com certeza|(?:ótima|boa) pergunta|aqui está (?:uma|a|minha) resposta|espero que (?:isso )?ajude|(?:você )?pode perguntar outra coisa|pergunte outra coisa|desculpe?|infelizmente|(?:há|precisa de) mais alguma coisa.*",
    r"bien sûr|certainement|(?:très )?bonne question|voici (?:une|ma|la) réponse|j'espère que cela (?:vous )?aide|posez-?moi une autre question|désolée?|je suis désolée?|malheureusement|(?:puis-je|y a-t-il) .*autre chose.*",
    r"gerne|natürlich|klar|sicher|gute frage|hier ist (?:eine|die|meine) antwort|ich hoffe,? das hilft(?: dir| ihnen)?|bitte frag(?:en sie)? etwas anderes|es tut mir leid|tut mir leid|leider|(?:kann ich|gibt es) .*sonst.*",
    r"certo|certamente|bella domanda|(?:buona|ottima) domanda|ecco (?:una|la mia|la) risposta|spero (?:che )?(?:questo )?(?:ti )?(?:sia utile|aiuti)|chiedimi qualcos'?altro|mi dispiace|purtroppo|(?:c'è|hai bisogno di) .*altro.*",
    r"és clar|i tant|esclar|bona pregunta|aquí (?:tens|hi ha) (?:una|la) resposta|espero que et serveixi|pregunta'?m(?: una)? altra cosa|ho sento|malauradament|(?:necessites|hi ha) .*més.*",
    r"конечно|разумеется|хороший вопрос|вот (?:мой )?ответ|надеюсь,? это поможет|спросите что-?нибудь другое|извините|простите|к сожалению|(?:могу ли я|нужно ли) .*ещё.*",
    r"jasne|oczywiście|pewnie|dobre pytanie|oto (?:moja )?odpowiedź|mam nadzieję,? że to pomoże|proszę zapytać o coś innego|przepraszam|niestety|czy .*(?:jeszcze|innego).*",
    r"noski|jakina|galdera ona|hona hemen erantzuna|espero (?:dut )?.*lagungarri.*|lagungarria izatea espero dut|galdetu beste zerbait|barkatu|zoritxarrez|.*beste ezer.*",
    r"tất nhiên(?: rồi)?|chắc chắn rồi|dĩ nhiên|câu hỏi hay đấy|đây là câu trả lời(?: của tôi)?|hy vọng điều này có ích cho bạn|xin hãy hỏi điều khác|xin lỗi|rất tiếc|.*(?:giúp gì|điều gì) (?:khác|nữa).*",
    r"当然(?:可以)?|好的|这个问题(?:很好|问得好)|(?:下面|以下)是我的回答|希望这?对您?你?有(?:所)?帮助|请您?你?问别的问题吧?|对不起|抱歉|很遗憾|很抱歉|.*还有(?:什么|其他).*",
    r"もちろん(?:です)?|はい|とても良い質問ですね|良い質問ですね|こちらが回答です|お役に立てば(?:うれしい|嬉しい|幸い)です|別の質問をお願いします|申し訳ありません(?:が)?|すみません|残念ながら|ごめんなさい|.*他に.*(?:ありますか|ございますか)",
)
_DECLINES = [(STEMS[k], re.compile(p)) for k, p in REFUSALS.items()]
# Of these, the stems that a sentence without letters beyond ASCII may contain.
_DECLINES_ASCII = [(some, rx) for stems, rx in _DECLINES if (some := [x for x in stems if x.isascii()])]
_FILLER = re.compile("|".join(f"(?:{p})" for p in FILLERS))
_SENTENCE = re.compile(r"(?<=[。！？])|(?<=[.!?…])\s+|\n+|\.{3,}")
_MARKS = r"[*_`#>\"“”«»„‘’「」『』()\[\]{}~|\\]"
_POINT = r"^\s*(?:[-•·]|\d+[.)])\s+"
_MARKUP = re.compile(f"{_MARKS}|{_POINT}", re.M)
_MARK, _POINT = re.compile(_MARKS), re.compile(_POINT)
_NOT_WORD = re.compile(r"[\W_]+")
_LEAD = re.compile(r"[\W_]*")
_INSIDE = re.compile(r"\w(?:.*\w)?", re.S)
_GOES_ON = re.compile(r"[ ,]{0,2}\w")
_LABEL = re.compile(r"^\s*(?:q|question|prompt|user|human|frage|pregunta|domanda|вопрос|pytanie)\s*[:：]\s*", re.I)


def is_empty(text: str | None) -> bool:
    """Nothing is left: NULL, no letter, digit or pictograph outside a closed reasoning block, or a stand-in word."""
    if text is None:
        return True
    t = truncation.without_thought(text)
    if "<" in t and "<think" in t.lower():
        return False
    if truncation.is_stand_in(t):
        return True
    return not any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "So" for c in t)


def _sentences(text: str):
    """Sentences in lower case without markup, line by line, so that a reader may stop early."""
    for line in text.splitlines():
        line = line.replace("’", "'")
        point = _POINT.match(line)  # as _MARKUP, of which the second part can only match where a line begins
        line = _MARK.sub("", line[point.end() :] if point else line).lower()
        at = 0
        for m in _SENTENCE.finditer(line):
            yield line[at : m.start()]
            at = m.end()
        yield line[at:]


def _declines(sentence: str) -> bool:
    for stems, rx in _DECLINES_ASCII if sentence.isascii() else _DECLINES:
        for x in stems:
            if x in sentence:
                if rx.search(sentence):
                    return True
                break
    return False


def is_refusal(text: str) -> bool:
    """Some sentence declines and every other is an opening, an apology or an offer."""
    t = truncation.without_thought(text).strip()
    found, other = False, 0
    for s in _sentences(t):
        inside = _INSIDE.search(s)
        if not inside:
            continue
        s = inside[0]
        flat = s.replace(",", "").replace("，", "").replace("、", "")
        if _declines(s) or (flat != s and _declines(flat)):
            found = True
        elif not _FILLER.fullmatch(flat) and (flat == s or not _FILLER.fullmatch(s)):
            other += len(_NOT_WORD.sub("", s)) * (2 if "぀" <= s[0] <= "鿿" else 1)
            if other >= 12:
                return False
    return found


def _plain(text: str) -> str:
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", _LABEL.sub("", text)).lower())


@lru_cache(10_000)
def _prompt(prompt: str) -> tuple[str, list[str]]:
    """The plain form of a prompt and its words, or pieces of three letters where it is not written with blanks."""
    p = _plain(prompt)
    words = re.findall(r"\w+", unicodedata.normalize("NFKC", prompt).lower())
    return p, words if len(words) >= 4 else [p[i : i + 3] for i in range(0, len(p) - 2, 3)]


def _nearly(p: str, t: str) -> bool:
    # The letters in both, in any order, are the most that can match: SequenceMatcher's quick_ratio, without its index.
    if 2 * (Counter(p) & Counter(t)).total() / (len(p) + len(t)) < 0.84:
        return False
    return SequenceMatcher(None, p, t, autojunk=False).ratio() >= 0.84


def is_copy(text: str, prompt: str | None) -> bool:
    """Nothing but the prompt, once or repeated, perhaps slightly changed or marked up."""
    p, words = _prompt(prompt) if prompt else ("", [])
    if len(p) < 5:
        return False
    t = truncation.without_thought(text)
    # Whatever its length, a copy has most words of the prompt in its beginning; few other texts do.
    start = _LEAD.match(t).end()
    head = unicodedata.normalize("NFKC", t[start : start + 3 * len(prompt) + 64]).lower()
    if sum(map(head.__contains__, words)) < 0.4 * len(words):
        return False
    t = _plain(_MARKUP.sub("", t))
    if not t:
        return False
    n = t.count(p)
    if n:
        return len(t) - n * len(p) <= 0.2 * len(p)
    k = max(1, round(len(t) / len(p)))
    if not 0.6 * k * len(p) <= len(t) <= 1.4 * k * len(p):
        return False
    if k <= 3:
        return _nearly(p * k, t)
    cut = [len(t) * i // k for i in range(k + 1)]
    return all(_nearly(p, t[x:y]) for x, y in zip(cut, cut[1:], strict=False))


_RULES = "empty boolean, refusal boolean, copy boolean, other boolean, head long, digest long"


def _rule_batches(shared):
    def run(batches):
        model = shared.value
        known: dict[str, tuple] = {}
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            use = [x for x in zip(*cols, strict=True) if x[0] is not None]
            for o in range(0, len(use), 6000):
                part = use[o : o + 6000]
                texts = [x[1] or "" for x in part]
                new = list({x[4] for x in part if x[4]} - known.keys())
                if new:
                    if len(known) > 50_000:
                        known.clear()
                        new = list({x[4] for x in part if x[4]})
                    letters, lang, conf, mixed = langid.assess(model, new)
                    known.update((t, (lang[i], conf[i]) if letters[i] >= 10 and i not in mixed else (-1, 0.0)) for i, t in enumerate(new))
                letters, lang, conf, mixed = langid.assess(model, texts)
                empty = [is_empty(x[1]) for x in part]
                refusal = [not e and is_refusal(t) for e, t in zip(empty, texts, strict=True)]
                copy = [not e and is_copy(t, x[4]) for e, t, x in zip(empty, texts, part, strict=True)]
                other = []
                for i, x in enumerate(part):
                    pl, pc = known.get(x[4], (-1, 0.0)) if x[4] else (-1, 0.0)
                    several = len({s[0] for s in mixed.get(i, [])}) > 1
                    other.append(bool(not empty[i] and not copy[i] and not several and letters[i] >= 10 and pl >= 0 and lang[i] >= 0 and lang[i] != pl and pc > 0.6 and conf[i] > 0.6))
                feats = truncation.end_features(texts)
                ends = truncation.end_columns([x[:4] for x in part], feats)
                bare = [t.rstrip(_TAIL) if f[0] == "open" else "" for t, f in zip(texts, feats, strict=True)]
                keys = [pa.array([_signed(_digest(t[: _head(t)] if head else t)) if _head(t) else None for t in bare], pa.int64()) for head in (True, False)]
                flags = [pa.array(np.array(v, bool)) for v in (empty, refusal, copy, other)]
                yield pa.RecordBatch.from_arrays([*ends, *flags, *keys], [*(f.name for f in truncation._ENDS_ARROW), "empty", "refusal", "copy", "other", "head", "digest"])

    return run


_TAIL = " \t\n\r.…"
#: Characters that two texts must share at the beginning to be compared: the most that the shorter one has. Under the least, a text begins like others by chance.
HEADS = (16, 4)
#: log2 of the least and greatest number of bits of the filter of asked heads.
FILTER_BITS = (16, 28)


def _head(t: str) -> int:
    return next((n for n in HEADS if len(t) >= n), 0)


def _digest(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _with_known_head(shared):
    """Texts, without trailing blanks and dots, that begin as some open text begins."""

    def run(batches):
        for batch in batches:
            texts = [x for t in batch.column(0).to_pylist() if t and len(x := t.rstrip(_TAIL)) >= HEADS[-1]]
            ok = np.zeros(len(texts), bool)
            for n in HEADS:
                at = [i for i, t in enumerate(texts) if len(t) >= n]
                ok[at] |= shared.value.has(np.array([_digest(texts[i][:n]) for i in at], U))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, k in zip(texts, ok, strict=True) if k], pa.string())], ["text"])

    return run


def _neighbours(batches):
    """Within a sorted range: digests of the texts that a later one continues; the texts that are still open prefixes at the end; and the first text."""
    path: list[str] = []  # prefixes of the present text that nothing has continued with a word yet
    first = True
    for batch in batches:
        found, kinds, texts = [], [], []
        for text in batch.column(0).to_pylist():
            if first:
                found, kinds, texts, first = [0], ["first"], [text], False
            while path and not text.startswith(path[-1]):
                path.pop()
            keep = []
            for p in path:
                if len(p) < len(text) and _GOES_ON.match(text, len(p)):
                    found.append(_signed(_digest(p)))
                    kinds.append("short")
                    texts.append(None)
                else:
                    keep.append(p)
            path = [*keep, text]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["digest", "kind", "text"])
    n = len(path)
    yield pa.RecordBatch.from_arrays([pa.array([_signed(_digest(p)) for p in path], pa.int64()), pa.array(["open"] * n, pa.string()), pa.array(path, pa.string())], ["digest", "kind", "text"])


def shortened(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """digest of the texts that another text continues, among the texts whose first letters are in ``heads``.

    heads: head, the digest of the first letters of a text asked for; it becomes a bit map sized by their number."""
    shared = texts.sparkSession.sparkContext.broadcast(Bits.of(heads.where("head is not null"), "head", FILTER_BITS))
    some = materialise(texts.mapInArrow(_with_known_head(shared), "text string").distinct(), "pair-texts")
    ranges = some.repartitionByRange(partitions_for(some), "text").sortWithinPartitions("text").mapInArrow(_neighbours, "digest long, kind string, text string")
    got = materialise(ranges, "pair-neighbours")
    # A prefix that reaches into a later range is one of that range's first text too.
    at = lambda df, name: df.select(F.col("text").alias(name), F.substring("text", 1, HEADS[-1]).alias("h"))
    over = at(got.where("kind = 'open'"), "prefix").join(at(got.where("kind = 'first'"), "next"), "h").where("startswith(next, prefix) and next <> prefix").select("h", "prefix").distinct()
    over = materialise(over, "pair-over")
    edge = over.join(at(some, "text"), "h").where(r"startswith(text, prefix) and substring(text, length(prefix) + 1) rlike '^[ ,]{0,2}[\\p{L}\\p{N}_]'").select("prefix").distinct()
    return got.where("kind = 'short'").select("digest").union(edge.mapInArrow(_digests, "digest long")).distinct()


def _digests(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_signed(_digest(t)) for t in batch.column(0).to_pylist()], pa.int64())], ["digest"])


def defects(responses: DataFrame, prompts: DataFrame, cfg: langid.LangId = langid.LangId(per_label=900, sentences=1500)) -> DataFrame:
    """gen_id, defect: one row per record and defect.

    A record whose prompt is unknown has no copy or language defect.  Repeated deliveries and repeated prompts
    count once; a NULL key gives no row; other columns are not read; empty tables give an empty result."""
    spark = responses.sparkSession
    model = langid.train(langid.subjects(responses, prompts), cfg)
    shared = spark.sparkContext.broadcast(model)
    use = spread(responses.select(F.col("gen_id").cast("long").alias("rec"), F.col("response_text").alias("text"), F.col("model").alias("source"), F.col("finish_reason").alias("why"), "prompt_id"))
    p = prompts.where("prompt_id is not null").groupBy("prompt_id").agg(F.max("prompt_text").alias("prompt_text"))
    rows = use.join(p, "prompt_id", "left").select("rec", "text", "source", "why", "prompt_text")
    got = materialise(rows.mapInArrow(_rule_batches(shared), f"{truncation._ENDS}, {_RULES}").dropDuplicates(["rec"]), "pair-rules")
    cut = truncation.judge(got.drop("empty", "refusal", "copy", "other", "head", "digest"), use.select("text"))
    asked = got.where("digest is not null and not empty")
    short = asked.join(shortened(use.select("text"), asked.select("head")), "digest").select("rec")
    cut = cut.where("cut").select("rec").union(short).distinct().join(got.where("empty").select("rec"), "rec", "left_anti")
    flag = lambda c, name: got.where(c).select("rec", F.lit(name).alias("defect"))
    out = flag("empty", "empty").union(flag("refusal", "refusal")).union(flag("copy", "copy")).union(flag("other", "other_language"))
    return out.union(cut.select("rec", F.lit("truncated").alias("defect"))).select(F.col("rec").alias("gen_id"), "defect")
