import random

import pytest

from polyphony.llm import langid as L

PHRASES = {
    "en": "the old house|stands near the river|people like to walk|every morning we drink tea|this is not very difficult|she wrote a letter to her friend|children play in the garden|we should think about it",
    "es": "la casa vieja|está cerca del río|a la gente le gusta caminar|todas las mañanas bebemos té|esto no es muy difícil|ella escribió una carta a su amiga|los niños juegan en el jardín|deberíamos pensarlo bien",
    "de": "das alte Haus|steht nahe am Fluss|die Leute gehen gern spazieren|jeden Morgen trinken wir Tee|das ist nicht sehr schwierig|sie schrieb ihrer Freundin einen Brief|Kinder spielen im Garten|wir sollten darüber nachdenken",
    "ru": "старый дом|стоит рядом с рекой|люди любят гулять|каждое утро мы пьём чай|это не очень трудно|она написала письмо подруге|дети играют в саду|нам стоит подумать об этом",
    "ja": "古い家は|川の近くにあります|人々は散歩が好きです|毎朝お茶を飲みます|これはあまり難しくない|彼女は友達に手紙を書いた|子供たちは庭で遊ぶ|考えるべきです",
}


def sentence(lang, rng):
    p = PHRASES[lang].split("|")
    return (" " if lang != "ja" else "").join(rng.sample(p, 3)).capitalize() + ("。" if lang == "ja" else ".")


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    texts, labels = [], []
    for lang in PHRASES:
        for i in range(120):
            texts.append(" ".join(sentence(lang, rng) for _ in range(3)))
            labels.append(lang if i % 12 else "fr")  # a twelfth of the labels is wrong
    return L.fit(texts, labels)


def test_held_out_accuracy(model):
    rng = random.Random(99)
    tests = [(lang, sentence(lang, rng)) for lang in PHRASES for _ in range(60)]
    _, lang, conf, _ = L.assess(model, [t for _, t in tests])
    hit = sum(L.LANGS[g] == w for g, (w, _) in zip(lang, tests, strict=True))
    assert hit >= 0.97 * len(tests)
    assert (conf >= 0).all() and (conf <= 1).all()


def test_mixed_stretches(model):
    rng = random.Random(5)
    t = " ".join([sentence("en", rng), sentence("en", rng), sentence("de", rng), sentence("en", rng)])
    _, lang, _, st = L.assess(model, [t, sentence("en", rng)])
    assert L.LANGS[lang[0]] == "en" and [x[0] for x in st[0]] == ["en", "de", "en"] and 1 not in st
    assert all(a <= b for _, _, a, b in st[0])


def test_short_sentences_bear_a_language(model):
    rng = random.Random(6)
    en, ru, ja = (" ".join(sentence(x, rng) for _ in range(2)) for x in ("en", "ru", "ja"))
    texts = [f"{en}\n\nДети играют сегодня.", f"{ru} Children play.", f"{ja} (Она написала.)", f"{en} Kinder spielen im Garten.", f"{en} Она.", f"{en} Fibaris Wenmilno.", "He likes it. Дети играют сегодня утром здесь."]
    _, _, _, st = L.assess(model, texts)
    got = [{x[0] for x in st.get(i, [])} for i in range(len(texts))]
    assert got == [{"en", "ru"}, {"ru", "en"}, {"ja", "ru"}, {"en", "de"}, set(), set(), {"en", "ru"}]


def test_short_sentence_is_mixed(spark, model):
    rng = random.Random(8)
    r = spark.createDataFrame([(1, "", sentence("en", rng) + " Дети играют сегодня.")], "gen_id long, language string, response_text string")
    got = L.identify(L.subjects(r, spark.createDataFrame([], "prompt_id string, language string, prompt_text string")), model).first()
    assert {x.lang for x in got.stretches} == {"en", "ru"}


@pytest.mark.parametrize("label,want", [("EN", "en"), ("en_GB", "en"), ("pt", "pt-BR"), ("pt_BR", "pt-BR"), ("zh-Hans", "zh"), ("und", None), ("", None), (None, None), (" ", None), ("German", "de"), ("nl", "nl")])
def test_labels(label, want):
    assert L.base_language(label) == want


def test_issues(spark):
    rng = random.Random(2)
    rows = []
    for i, lang in enumerate(list(PHRASES) * 60):
        rows.append((i, lang, " ".join(sentence(lang, rng) for _ in range(3)), "x"))
    n = len(rows)
    rows += [(n, None, sentence("ru", rng) * 2, "x"), (n + 1, "de", sentence("ru", rng) * 2, "x"), (n + 2, "en", sentence("en", rng) + " " + sentence("de", rng) + " " + sentence("en", rng), "x"), (n + 3, "de", "ok", "x"), (n + 4, "de", None, "x"), (n + 5, "DE-at", sentence("de", rng) * 2, "x"), (n + 1, "de", rows[0][2], "x")]
    r = spark.createDataFrame(rows[:-1] + [rows[n + 1]], "gen_id long, language string, response_text string, rec_id string")
    p = spark.createDataFrame([("p1", "", sentence("en", rng)), ("p1", "", sentence("en", rng)), ("p2", "en", sentence("en", rng)), (None, "en", "x")], "prompt_id string, language string, prompt_text string")
    got = {tuple(x) for x in L.label_issues(r, p).collect()}
    s = str
    assert {("response", s(n), "missing", "ru"), ("response", s(n + 1), "wrong", "ru"), ("response", s(n + 2), "mixed", "en"), ("response", s(n + 2), "mixed", "de"), ("prompt", "p1", "missing", "en")} <= got
    assert not {x[1] for x in got} & {s(n + 3), s(n + 4), s(n + 5), "p2"}
    assert len(got) <= 5 + n // 50


def test_empty(spark):
    r = spark.createDataFrame([], "gen_id long, language string, response_text string")
    p = spark.createDataFrame([], "prompt_id string, language string, prompt_text string")
    assert L.label_issues(r, p).count() == 0
    letters, lang, _, st = L.assess(L.fit([], []), ["", "!!! 123", "ok then"])
    assert letters.tolist() == [0, 0, 6] and lang[0] == -1 and not st
