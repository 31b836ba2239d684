"""Text functions as Columns (built-ins only; lengths and positions are code points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown", "none", "null", "n/a")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, _EDGE, "")


def truncate(c: Column, n: int | None) -> Column:
    """The first n code points; no n, no change."""
    return F.substring(c, 1, n) if n else c


def ngrams(c: Column, n: int = 4) -> Column:
    """Distinct character n-grams; none where the text is shorter than n or NULL."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def strip_think(c: Column) -> Column:
    """Without reasoning blocks, closed or left open; then stripped.  NULL and '' stay."""
    x = F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", "")
    return F.when(c == "", c).otherwise(strip(x))


def words(c: Column) -> Column:
    """Lower-case words: punctuation deleted, split on white space, empty ones dropped."""
    bare = F.regexp_replace(F.lower(c), r"[\p{P}\p{S}]", "")
    return F.filter(F.split(bare, r"[\s\p{Z}]+"), lambda w: w != "")


def flatten_lines(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def slug(c: Column, trunc: int | None = None, samples: int | None = None) -> Column:
    tail = (f"_trunc{trunc}" if trunc else "") + (f"_s{samples}" if samples else "")
    return F.concat(F.replace(c, F.lit("/"), F.lit("_")), F.lit(tail))


def pair_label(a: Column, b: Column) -> Column:
    """The two names in order, joined by ' || '."""
    return F.concat(F.least(a, b), F.lit(" || "), F.greatest(a, b))


def base_language(c: Column) -> Column:
    """Base language of a label: case, region and separator dropped; NULL where it names none."""
    low = F.lower(F.trim(F.replace(c, F.lit("_"), F.lit("-"))))
    base = F.split_part(low, F.lit("-"), F.lit(1))
    return F.when(low.isNull() | low.isin(*NO_LANGUAGE), None).when(base == "pt", "pt-BR").otherwise(base)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def backend_of(model: Column) -> Column:
    """Provider by the prefix of the model name."""
    return F.when(model.rlike("^(gpt|o1|o3|o4)-"), "openai").when(model.startswith("claude-"), "anthropic").when(model.startswith("gemini-"), "gemini").otherwise("vllm")


# Labels of a language identifier that count as each language, the first being its primary one.
LABELS = {
    "ca": ["cat_Latn"],
    "de": ["deu_Latn", "gsw_Latn"],
    "en": ["eng_Latn"],
    "es": ["spa_Latn"],
    "eu": ["eus_Latn"],
    "fr": ["fra_Latn"],
    "it": ["ita_Latn"],
    "ja": ["jpn_Jpan", "und_Hira"],
    "pl": ["pol_Latn"],
    "pt-BR": ["por_Latn"],
    "ru": ["rus_Cyrl"],
    "vi": ["vie_Latn"],
    "zh": ["cmn_Hani", "wuu_Hani", "yue_Hani"],
}
# Names of number formats and accelerators in reports.
PRECISION = {"bfloat16": "bf16", "float16": "fp16"}
ACCELERATOR = {"A40": "A40 48 GB", "A100fat": "A100 80 GB"}
# What stands for the revision of a model that is not open, and of one without a commit in time.
GATED, NO_COMMIT = "gated", "---"


def _lookup(c: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), other)


def primary_label(language: Column) -> Column:
    """The identifier's label of a language, NULL for one outside the table."""
    return _lookup(language, {k: v[0] for k, v in LABELS.items()}, F.lit(None))


def label_matches(language: Column, label: Column) -> Column:
    """Whether a predicted label counts as the language; false where either is missing."""
    pairs = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.array(*(F.lit(y) for y in v)))))
    return F.coalesce(F.array_contains(F.try_element_at(pairs, language), label), F.lit(False))


def precision(quant: Column, dtype: Column) -> Column:
    return F.when(quant == "fp8", "FP8").otherwise(_lookup(dtype, PRECISION, F.lit("---")))


def accelerator(gpus: Column) -> Column:
    """'kind:count' as 'count x name'; NULL stays."""
    kind = F.split_part(gpus, F.lit(":"), F.lit(1))
    return F.concat(F.split_part(gpus, F.lit(":"), F.lit(2)), F.lit(" x "), _lookup(kind, ACCELERATOR, kind))


def revision_before(commits: Column, cutoff: str) -> Column:
    """First 8 characters of the newest commit up to a date; commits: array of structs date, sha, newest first."""
    ok = F.filter(commits, lambda x: F.substring(x["date"], 1, 10) <= cutoff)
    return F.when(commits.isNull(), GATED).otherwise(F.coalesce(F.substring(F.try_element_at(ok, F.lit(1))["sha"], 1, 8), F.lit(NO_COMMIT)))


def preview(c: Column, chars: int = 400, width: int = 80) -> Column:
    """The first characters, in lines of at most ``width`` broken at blanks, joined by <br>; NULL is empty."""
    flat = F.trim(F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, chars), r"\s+", " "))
    lines = F.regexp_replace(F.concat(flat, F.lit(" ")), rf"(.{{1,{width}}})(?: |$)", "$1\n")
    return F.replace(F.regexp_replace(lines, r"\s+$", ""), F.lit("\n"), F.lit("<br>"))
