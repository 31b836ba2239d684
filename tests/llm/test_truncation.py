import random

import pytest

from polyphony.llm import truncation as T

SCHEMA = "gen_id long, response_text string, model string, finish_reason string, text string"


@pytest.mark.parametrize("text,want", [
    ("All is well.", "whole"), ("你好。", "whole"), ("Fine 🙂", "whole"), ("Fine :)", "whole"), ("“Quoted end.”", "whole"), ("", "whole"), (" \n", "whole"), ("N/A", "whole"), ("...", "whole"),
    ("<think>so far", "cut"), ("<think>a</think>", "whole"), ("<think>a</think>\nDone.", "whole"), ("x\n```py\nprint(1)", "cut"), ("x\n```py\nprint(1)\n```", "whole"),
    ("| a | b |\n|---|---|\n| c | d |", "whole"), ("| a | b |\n|---|---|\n| c |", "cut"), ("| a | b |\n|---|---|\n| c | d", "cut"), ("It was the [truncated]", "cut"), ("It was the [...]", "cut"), ("It was<|cut|>", "cut"), ("温かい食�", "cut"),
    ("It has the following,", "cut"), ("- one\n- two\n- three", "list"), ("It needs the", "open"), ("It needs the…", "open"), ("It needs the...", "open"),
])
def test_structure(text, want):
    assert T.structure(text)[0] == want


def test_long_brackets_close_a_text_too():
    for n in (3, 60, 4000):
        assert T.structure("The path is open (see the " + "old " * n + "map)")[0] == "whole"
    assert T.structure("It stops [ " + "." * 200 + " truncated ]")[0] == "cut" and T.structure("He said (a) or b)")[0] == "open"


def test_a_small_map_changes_no_result(spark, monkeypatch):
    c = corpus(200)
    rows = [(i, t if i % 5 else t[: len(t) * 2 // 3], f"m{i % 3}", "stop", "x") for i, t in enumerate(c)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.gen_id for r in T.truncated(df).collect()}
    monkeypatch.setattr(T, "FILTER_BITS", (6, 6))
    assert {r.gen_id for r in T.truncated(df).collect()} == want and want


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    subj, verb, obj = ["the teacher", "the garden", "a small library", "the morning train"], ["supports", "explains", "replaces", "surrounds"], ["the old bridge", "a quiet evening", "the harvest season", "the winter storm"]
    tail = ["", " after a few weeks", " in the long run"]
    return [" ".join(f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}{rng.choice(tail)}.".capitalize() for _ in range(rng.randint(2, 6))) for _ in range(n)]


def test_cut_words_sentences_and_missing_stops(spark):
    c = corpus()
    rows = [(i, t, f"m{i % 3}", "stop", "x") for i, t in enumerate(c)]
    n = len(rows)
    special = ["The garden explains the harvest seas", "The garden explains the", "The garden explains the harvest season", "The garden explains the old bridge in the long run", "The teach", None, "", "A quiet evening sup"]
    rows += [(n + i, f"{c[0]} {t}" if t else t, "m1", None, "x") for i, t in enumerate(special)]
    df = spark.createDataFrame(rows + rows[-3:] + [(None, "The gar", "m", None, "x")], SCHEMA)
    got = {r.gen_id - n for r in T.truncated(df).collect()}
    assert got == {0, 1, 4, 7}


def test_length_spike_and_reported_stop(spark):
    c = corpus()
    rows = [(i, t, "m0", "stop", "x") for i, t in enumerate(c)]
    n = len(rows)
    full = " ".join(c)
    rows += [(n + i, full[i * 7 :][:300].rstrip(". ").ljust(300, "e"), "m9", "stop", "x") for i in range(12)]
    j = T.judged(spark.createDataFrame(rows, SCHEMA)).where("source = 'm9'").collect()
    assert len(j) == 12 and all(r.cut for r in j if r.state == "open")
    assert all(r.spike for r in j if r.chars == 300) if hasattr(j[0], "chars") else all(r.spike for r in j if r.state != "whole")
    r = T.truncation_rates(spark.createDataFrame(rows, SCHEMA))
    assert {x.source: x.n for x in r.collect()} == {"m0": 400, "m9": 12}


def test_trie_counts(spark):
    words = spark.createDataFrame([("restores", 5), ("restored", 2), ("rest", 1), ("r", 9), ("zebra", 3)], "word string, seen long")
    asked = spark.createDataFrame([("restor",), ("rest",), ("re",), ("zebra",), ("q",), ("z",), (None,)], "token string")
    got = {r.token: (r.known, r.extensions) for r in T.vocabulary_prefixes(words, asked).collect()}
    assert got == {"restor": (0, 7), "rest": (1, 7), "re": (0, 7), "zebra": (3, 0), "q": (0, 0), "z": (0, 3)}


def test_empty(spark):
    assert T.truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.truncation_rates(spark.createDataFrame([], SCHEMA)).count() == 0
