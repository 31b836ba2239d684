import random

import pytest

from polyphony.llm import pairs as P
from test_langid import PHRASES, sentence

PROMPT = "Give me some ideas for the public square in Fibaris, please."


@pytest.mark.parametrize("text,want", [(None, True), ("", True), (" ​ \n", True), ("...!?", True), ("**", True), ("N/A", True), ("null", True), ("<think>hm</think>", True), ("<think>hm</think>\n \n", True), ("<think>hm", False), ("🙂", False), ("ok", False), ("7", False)])
def test_empty_answers(text, want):
    assert P.is_empty(text) is want


@pytest.mark.parametrize("text", [
    "I'm sorry, but I can't help with that request.", "**As an AI model, I am not able to answer this question.**", "Sure! Sorry, no. I'm unable to comply with this one.", "This is something I have to pass on.",
    "Lo siento, pero no puedo ayudarte con esa petición.", "Desculpe, mas não posso ajudar com esse pedido.", "Je suis désolé, mais je ne peux pas vous aider avec cela.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Mi dispiace, ma non posso aiutarti con questa richiesta.",
    "Ho sento, però no puc ajudar-te amb aquesta petició.", "Извините, но я не могу помочь с этой просьбой.", "Przepraszam, ale nie mogę pomóc w tej sprawie.", "Barkatu, baina ezin dizut eskaera horretan lagundu.", "Xin lỗi, tôi không thể giúp bạn với yêu cầu này.", "对不起，我无法帮助您完成这个请求。", "申し訳ありませんが、そのご依頼にはお応えできません。",
    "<think>They ask about it.</think>\nI won't provide that. Please ask me something else.",
])
def test_refusals(text):
    assert P.is_refusal(text)


@pytest.mark.parametrize("text", ["I can't recommend the cooking class enough. It brings people together.", "No puedo dejar de recomendar una comida caliente.", "Je ne peux pas cacher mon enthousiasme pour la place.", "About forty minutes.", "No, not really.", "I'm sorry, but I can't help with the first part. The garden path is best reached from the old station by foot.", ""])
def test_not_refusals(text):
    assert not P.is_refusal(text)


@pytest.mark.parametrize("text,want", [
    (PROMPT, True), (PROMPT.upper(), True), ("Q: " + PROMPT, True), (f"> {PROMPT}", True), ("«" + PROMPT + "”", True), (PROMPT + "\n" + PROMPT, True), ("Give me some ideas for the square in Fibaris, please", True), (PROMPT.replace(" ", "  "), True),
    (PROMPT + " Plant trees along the northern edge, and let the market stay on Saturdays.", False), ("Plant trees.", False), ("", False),
])
def test_copies(text, want):
    assert P.is_copy(text, PROMPT) is want
    assert not P.is_copy(text, None)


def test_defects(spark):
    rng = random.Random(1)
    rows, prompts = [], []
    for k, lang in enumerate(PHRASES):
        prompts.append((f"p{k}", lang, sentence(lang, rng), "x"))
        for i in range(80):
            rows.append((1000 * k + i, lang, f"p{k}", "m1", "stop", " ".join(sentence(lang, rng) for _ in range(4))))
    en = [r for r in rows if r[1] == "en"]
    add = [
        (9001, "en", "p0", "m1", None, None), (9002, "en", "p0", "m1", "stop", prompts[0][2].upper()), (9003, "en", "p0", "m1", "stop", "I'm sorry, but I can't help with that request."),
        (9004, "en", "p0", "m1", "stop", sentence("ru", rng) + " " + sentence("ru", rng)), (9005, "en", "p0", "m1", "stop", "<think>" + en[0][5]), (9006, "en", "p0", "m1", "stop", en[3][5][:-9]),
        (9007, "ru", "p0", "m1", "length", sentence("ru", rng) + " старый дом стоит ря"), (9008, "en", "nowhere", "m1", "stop", sentence("ru", rng) * 2), (None, "en", "p0", "m1", "stop", ""),
    ]
    df = spark.createDataFrame(rows + add + add[:3], "gen_id long, language string, prompt_id string, model string, finish_reason string, response_text string")
    pf = spark.createDataFrame(prompts + prompts[:1], "prompt_id string, language string, prompt_text string, source string")
    got = {tuple(r) for r in P.defects(df, pf).collect()}
    want = {(9001, "empty"), (9002, "copy"), (9003, "refusal"), (9004, "other_language"), (9005, "truncated"), (9006, "truncated"), (9007, "truncated"), (9007, "other_language")}
    assert want <= got
    assert len(got - want) <= 4


def test_shortened(spark):
    rng = random.Random(0)
    long = ["".join(rng.choice("abcdefg ") for _ in range(60)) + f" end{i}" for i in range(200)]
    short = [t[:40].rstrip() + "x"[:0] for t in long[:50]]
    df = spark.createDataFrame([(t,) for t in long + short], "text string")
    heads = spark.createDataFrame([(P._signed(P._digest(t[: P._head(t)])),) for t in short], "head long")
    got = {r.digest for r in P.shortened(df, heads).collect()}
    bare = [t.rstrip(P._TAIL) for t in short]
    want = {P._signed(P._digest(s)) for s in bare if any(t.startswith(s) and P._GOES_ON.match(t, len(s)) for t in long)}
    assert got == want and len(want) > 40


def test_every_continuation_counts(spark):
    long = "the harvest season"
    rows = [long, long + "\nis over", long + '" x', long + " ends early", "tiny", "tiny!", "tiny house", "abc", "abc d", "lonely text here", "lonely text here!"]
    asked = [long, "tiny", "abc", "lonely text here"]
    heads = spark.createDataFrame([(P._signed(P._digest(t[: P._head(t)])),) for t in asked if P._head(t)], "head long")
    want = {P._signed(P._digest(t)) for t in (long, "tiny")}
    for k in ("1", "40"):  # with many ranges, prefixes and continuations lie in different ones
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", k)
        got = {r.digest for r in P.shortened(spark.createDataFrame([(t,) for t in rows], "text string"), heads).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", old)
        assert want <= got and P._signed(P._digest("lonely text here")) not in got and P._signed(P._digest("abc")) not in got


def test_a_small_map_changes_no_result(spark, monkeypatch):
    rng = random.Random(4)
    long = ["".join(rng.choice("abc ") for _ in range(40)) + f" end{i}" for i in range(300)]
    asked = [t[:25].rstrip() for t in long[:60]]
    df = spark.createDataFrame([(t,) for t in long + asked], "text string")
    heads = spark.createDataFrame([(P._signed(P._digest(t[: P._head(t)])),) for t in asked], "head long")
    want = {r.digest for r in P.shortened(df, heads).collect()} & {P._signed(P._digest(t)) for t in asked}
    monkeypatch.setattr(P, "FILTER_BITS", (6, 6))
    assert {r.digest for r in P.shortened(df, heads).collect()} & {P._signed(P._digest(t)) for t in asked} == want and len(want) > 50


def test_long_texts_follow_the_same_rules():
    no = "I'm sorry, but I can't help with that request. " * 30
    assert P.is_refusal(no) and not P.is_refusal(no + "The garden path is best reached from the old station.")
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PROMPT)
    assert P.is_copy(wide, PROMPT)
    assert P.is_copy("\n".join([PROMPT] * 25), PROMPT) and not P.is_copy("\n".join([PROMPT] * 25) + " The square needs trees and more light along its northern edge.", PROMPT)
    assert P.is_copy(" ".join([PROMPT.replace("square", "sqare")] * 6), PROMPT) and P.is_copy("*" * 3000 + PROMPT, PROMPT)


def test_empty(spark):
    r = spark.createDataFrame([], "gen_id long, language string, prompt_id string, model string, finish_reason string, response_text string")
    p = spark.createDataFrame([], "prompt_id string, language string, prompt_text string")
    assert P.defects(r, p).count() == 0


def test_cheap_looks_come_first(monkeypatch):
    """No alignment for texts of other letters, no pattern of another script for an ASCII sentence; the same answers as the plain definitions."""
    import re

    made = []
    real = P.SequenceMatcher
    monkeypatch.setattr(P, "SequenceMatcher", lambda *a, **k: (made.append(a), real(*a, **k))[1])
    assert not P._nearly("abcdefghij" * 5, "klmnopqrst" * 5) and not made
    for a, b in (("how do i bake bread", "how do i bake breda"), ("how do i bake bread", "who made this old cake")):
        m = real(None, a, b, autojunk=False)
        assert P._nearly(a, b) == (m.quick_ratio() >= 0.84 and m.ratio() >= 0.84)
    assert all(x.isascii() for stems, _ in P._DECLINES_ASCII for x in stems)
    for s in ("i cannot help you with that", "the weather is fine", "не могу помочь с этим", "no puedo ayudarte", "我无法回答这个问题", "nie mogę w tym pomóc", "kann ich dir nicht helfen"):
        assert P._declines(s) == any(rx.search(s) for stems, rx in P._DECLINES if any(x in s for x in stems))
    for line in ("  - **I** can't help.", "12) `x` y. z", "**- a", "> - b", "-c", " \t3. d"):
        assert "".join(P._sentences(line)) == "".join(re.split(P._SENTENCE, P._MARKUP.sub("", line).lower()))
