"""The registered queries as SQL over the same tables (views named as the files)."""

from __future__ import annotations

from polyphony.functions.text import LABELS, NO_LANGUAGE
from polyphony.operators.prompts import LANG_ORDER

_NONE = ", ".join(f"'{x}'" for x in NO_LANGUAGE)


def _lang(c: str) -> str:
    low = f"lower(trim(replace({c}, '_', '-')))"
    return f"CASE WHEN {c} IS NULL OR {low} IN ({_NONE}) THEN NULL WHEN split_part({low}, '-', 1) = 'pt' THEN 'pt-BR' ELSE split_part({low}, '-', 1) END"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


GEN = f"""gen AS (SELECT gen_id, model, dataset, {_lang("language")} AS language, prompt_id, sample_idx, response_text AS text, n_tokens, finish_reason
  FROM responses QUALIFY row_number() OVER (PARTITION BY gen_id ORDER BY ingested_at) = 1)"""
DIM = "dim AS (SELECT id AS model, display_name, coalesce(family, 'Other') AS family, gpus FROM models)"
PROMPTS = f"""pr AS (SELECT prompt_id, {_lang("language")} AS language, prompt_text, human_responses, n_responses FROM oasst2_prompts),
p1 AS (SELECT * FROM pr WHERE prompt_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY language NULLS LAST, n_responses NULLS LAST) = 1)"""
HUMANS = (
    PROMPTS
    + """,
hum AS (SELECT language, prompt_id, i - 1 AS human_idx, human_responses[i] AS text FROM p1, unnest(range(1, len(human_responses) + 1)) AS u(i))"""
)
FAM = "fam AS (SELECT 'm' || i AS model, 'V' || (i // 2) AS family FROM range(5) AS r(i))"
VEC = """vec AS (SELECT vec_id, CASE WHEN vec_id % 6 = 5 THEN 'Human' ELSE 'm' || (vec_id % 6) END AS model, 'L' || (label % 4) AS language, 'p' || label AS prompt_id, embedding AS e FROM embeddings)"""


def _cells(src: str = "vec", name: str = "cel", upto: int | None = None, unit: bool = False) -> str:
    top = f"least(len(e), {upto})" if upto else "len(e)"
    norm = f" / sqrt(list_sum(list_transform(e[1:{upto}], lambda x: x::DOUBLE * x::DOUBLE)))" if unit else ""
    return f"""{name}_pos AS (SELECT model, language, prompt_id, i, sum(e[i]::DOUBLE{norm}) AS v, count(*) AS n FROM {src}, unnest(range(1, {top} + 1)) AS u(i) GROUP BY ALL),
{name} AS (SELECT model, language, prompt_id, max(n) AS n, sum(v * v) AS ss FROM {name}_pos GROUP BY ALL),
{name}_intra AS (SELECT model, language, prompt_id, CASE WHEN n >= 2 THEN (ss - n) / (n * (n - 1)) END AS intra_sim, n AS n_samples FROM {name})"""


_INTER = """{out} AS (SELECT a.model AS model_a, b.model AS model_b, a.language, a.prompt_id, sum(a.v * b.v) / max(a.n * b.n) AS inter_sim
  FROM cel_pos a JOIN cel_pos b ON a.language = b.language AND a.prompt_id = b.prompt_id AND a.i = b.i AND a.model < b.model {where} GROUP BY 1, 2, 3, 4)"""
INTER_ALL = _INTER.format(out="inter_all", where="")
COS = f"""{VEC}, {_cells()}, {FAM}, {INTER_ALL},
intra AS (SELECT * FROM cel_intra WHERE model <> 'Human'), human AS (SELECT * FROM cel_intra WHERE model = 'Human'),
inter AS (SELECT * FROM inter_all WHERE model_a <> 'Human' AND model_b <> 'Human')"""
MATRIX = f"""{VEC}, {_cells()}, {FAM}, {INTER_ALL},
off AS (SELECT model_a, model_b, avg(inter_sim) AS sim FROM inter_all GROUP BY ALL),
mat AS (SELECT model AS resp_a, model AS resp_b, avg(intra_sim) AS sim FROM cel_intra GROUP BY model
  UNION ALL SELECT model_a, model_b, sim FROM off UNION ALL SELECT model_b, model_a, sim FROM off)"""
RESP = ["m0", "m1", "m2", "m3", "m4", "Human"]
_X = "SELECT i.*, coalesce(f.family, 'Other') AS family FROM intra i LEFT JOIN fam f ON i.model = f.model"
LEVELS_I = f"""xi AS ({_X}),
li AS (SELECT 'general' AS level, 'all' AS grp, NULL AS lang, language, prompt_id, intra_sim FROM xi
 UNION ALL SELECT 'family', family, NULL, language, prompt_id, intra_sim FROM xi UNION ALL SELECT 'model', model, NULL, language, prompt_id, intra_sim FROM xi
 UNION ALL SELECT 'language', language, language, language, prompt_id, intra_sim FROM xi UNION ALL SELECT 'family_language', family, language, language, prompt_id, intra_sim FROM xi
 UNION ALL SELECT 'model_language', model, language, language, prompt_id, intra_sim FROM xi),
vi AS (SELECT level, grp, lang, language, prompt_id, avg(intra_sim) AS v FROM li GROUP BY ALL)"""
LEVELS_X = """xx AS (SELECT i.*, coalesce(f.family, 'Other') AS fa, coalesce(g.family, 'Other') AS fb FROM inter i LEFT JOIN fam f ON i.model_a = f.model LEFT JOIN fam g ON i.model_b = g.model),
xp AS (SELECT *, least(fa, fb) || ' || ' || greatest(fa, fb) AS pair FROM xx),
lx AS (SELECT 'general' AS level, 'all' AS grp, NULL AS lang, language, prompt_id, inter_sim AS v FROM xp UNION ALL SELECT 'language', language, language, language, prompt_id, inter_sim FROM xp
 UNION ALL SELECT 'family_pair', pair, NULL, language, prompt_id, inter_sim FROM xp UNION ALL SELECT 'family_pair_language', pair, language, language, prompt_id, inter_sim FROM xp),
lm AS (SELECT 'model' AS level, model_a AS grp, NULL AS lang, language, prompt_id, inter_sim AS v FROM xp UNION ALL SELECT 'model', model_b, NULL, language, prompt_id, inter_sim FROM xp)"""
_FCOLS = """n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(std_a, 6) AS std_a, round(std_b, 6) AS std_b,
 round((mean_a - mean_b) ** 2 * n_a * n_b / (n_a + n_b) / nullif(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2), 0), 6) AS f_means,
 round(CASE WHEN var_a > 0 AND var_b > 0 THEN greatest(var_a, var_b) / least(var_a, var_b) END, 6) AS f_var"""


def _mom(p: str, v: str = "v") -> str:
    return f"count({v}) AS n_{p}, avg({v}) AS mean_{p}, stddev_samp({v}) AS std_{p}, var_samp({v}) AS var_{p}"


def _f(levels: str, src: str, where: str = "TRUE", cols: str = f"level, grp, lang, {_FCOLS}") -> str:
    return f"""WITH {COS}, {levels}, a AS (SELECT level, grp, lang, {_mom("a")} FROM {src} WHERE {where} GROUP BY ALL),
b AS (SELECT NULL AS hl, {_mom("b", "intra_sim")} FROM human UNION ALL SELECT language, {_mom("b", "intra_sim")} FROM human GROUP BY language),
j AS (SELECT a.*, b.* FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.hl WHERE n_a >= 2 AND n_b >= 2) SELECT {cols} FROM j"""


_PAIR_I = f"""{COS}, {LEVELS_I}, pi AS (SELECT v.level, v.grp, v.lang, v.language, v.prompt_id, v.v AS llm, h.intra_sim AS human, v.v - h.intra_sim AS gap
 FROM vi v JOIN human h ON v.language = h.language AND v.prompt_id = h.prompt_id WHERE v.level <> 'family_language')"""
_PAIR_X = f"""{LEVELS_X}, vx AS (SELECT level, grp, lang, language, prompt_id, avg(v) AS v FROM (SELECT * FROM lx UNION ALL SELECT * FROM lm) GROUP BY ALL),
px AS (SELECT v.level, v.grp, v.lang, v.language, v.prompt_id, v.v AS llm, h.intra_sim AS human, v.v - h.intra_sim AS gap FROM vx v JOIN human h ON v.language = h.language AND v.prompt_id = h.prompt_id)"""
_PAIR_L = """po AS (SELECT language, prompt_id, avg(intra_sim) AS llm FROM intra GROUP BY ALL), oo AS (SELECT language, prompt_id, avg(inter_sim) AS human FROM inter GROUP BY ALL),
pj AS (SELECT po.language, po.prompt_id, llm, human, llm - human AS gap FROM po JOIN oo ON po.language = oo.language AND po.prompt_id = oo.prompt_id),
pl AS (SELECT 'general' AS level, 'all' AS grp, NULL AS lang, * FROM pj UNION ALL SELECT 'language', language, language, * FROM pj)"""
_P6 = "level, grp, lang, language, prompt_id, round(llm, 6) AS llm, round(human, 6) AS human, round(gap, 6) AS gap"


def _num(src: str, name: str = "num") -> str:
    return f"""{name} AS (SELECT *, level || '|' || grp || '|' || coalesce(lang, '') AS g, row_number() OVER (PARTITION BY level, grp, lang ORDER BY language, prompt_id) - 1 AS i,
 count(*) OVER (PARTITION BY level, grp, lang) AS n FROM {src} WHERE gap IS NOT NULL)"""


def _u(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


def _sign(src: str, name: str) -> str:
    return f"""{_num(src, name + "_n")}, {name}_t AS (SELECT level, grp, lang, n, gap, b, CASE WHEN {_u("'0'", "'s'", "g", "b", "i")} % 2 = 0 THEN gap ELSE -gap END AS v FROM {name}_n, range(200) AS r(b) WHERE n >= 2),
{name}_m AS (SELECT level, grp, lang, b, abs(avg(v)) AS m, abs(avg(gap)) AS m0, avg(gap) AS g, count(*) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT level, grp, lang, max(n) AS n, avg(g) AS mean_gap, (count(*) FILTER (WHERE m >= m0 - 1e-12) + 1) / 201.0::DOUBLE AS p_perm FROM {name}_m GROUP BY ALL)"""


_TESTS = f"""{_PAIR_I}, {_PAIR_X}, {_PAIR_L}, {_sign("pi", "ti")}, {_sign("px", "tx")}, {_sign("pl", "tl")},
tt AS (SELECT 'intra' AS comparison, * FROM ti UNION ALL SELECT 'cross', * FROM tx UNION ALL SELECT 'ladder', * FROM tl),
ta AS (SELECT *, count(*) OVER w AS m, row_number() OVER (PARTITION BY comparison, level ORDER BY p_perm) AS k FROM tt WINDOW w AS (PARTITION BY comparison, level)),
adj AS (SELECT comparison, level, grp, lang, mean_gap, p_perm,
 max(least(1.0, (m - k + 1) * p_perm)) OVER (PARTITION BY comparison, level ORDER BY k) AS p_perm_holm,
 min(least(1.0, m * p_perm / k)) OVER (PARTITION BY comparison, level ORDER BY k DESC) AS p_perm_bh FROM ta)"""


def _jac(src: str, name: str, cell: str = "model, language, prompt_id", trunc: str = "text") -> str:
    """{name}: mean Jaccard of the pairs of a cell; src has the cell's columns and ``text``."""
    on = " AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in cell.split(","))
    sel = ", ".join(f"x.{c.strip()}" for c in cell.split(","))
    null = " AND ".join(f"{c.strip()} IS NOT NULL" for c in cell.split(","))
    return f"""{name}_t AS MATERIALIZED (SELECT {cell}, row_number() OVER () AS id, coalesce({trunc}, '') AS t FROM {src} WHERE {null}),
{name}_g AS MATERIALIZED (SELECT {cell}, id, unnest(list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4)))) AS g FROM {name}_t WHERE length(t) >= 4),
{name}_s AS (SELECT t.*, coalesce(c, 0) AS c FROM {name}_t t LEFT JOIN (SELECT id, count(*) AS c FROM {name}_g GROUP BY id) s ON t.id = s.id),
{name}_i AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM {name}_g x JOIN {name}_g y ON {on} AND x.g = y.g AND x.id < y.id GROUP BY 1, 2),
{name}_p AS (SELECT {sel}, coalesce(i.c, 0)::DOUBLE / nullif(x.c + y.c - coalesce(i.c, 0), 0) AS j FROM {name}_s x JOIN {name}_s y ON {on} AND x.id < y.id LEFT JOIN {name}_i i ON i.a = x.id AND i.b = y.id),
{name}_m AS (SELECT {cell}, avg(j) AS intra_sim FROM {name}_p GROUP BY ALL),
{name}_n AS (SELECT {cell}, count(*) AS n_samples FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {", ".join("n." + c.strip() for c in cell.split(","))}, intra_sim, n_samples FROM {name}_n n LEFT JOIN {name}_m m ON {on.replace("x.", "n.").replace("y.", "m.")})"""


_JOUT = "SELECT model, language, prompt_id, round(intra_sim, 6) AS intra_sim, n_samples FROM {0}"
_HUM = "humx AS (SELECT 'Human' AS model, * FROM hum)"
_GAPJ = f"""{GEN}, {HUMANS}, {_HUM}, {_jac("gen", "ja")}, {_jac("humx", "jh")},
ga AS (SELECT model, language, avg(intra_sim) AS llm_intra FROM ja GROUP BY ALL), gh AS (SELECT language, avg(intra_sim) AS human_intra FROM jh GROUP BY ALL),
gapj AS (SELECT ga.model, ga.language, llm_intra, human_intra, llm_intra - human_intra AS gap FROM ga JOIN gh ON ga.language = gh.language)"""
_ORD = "[" + ", ".join(f"'{x}'" for x in LANG_ORDER) + "]"
SCORES = f"""sc0 AS (SELECT gen_id, model, language, {_strip("coalesce(text, '')")} = '' AS blank FROM gen),
sc AS (SELECT model, language, CASE WHEN blank THEN NULL WHEN gen_id % 7 <> 0 THEN language ELSE ({_ORD})[(coalesce(list_position({_ORD}, coalesce(language, '')), 0) % {len(LANG_ORDER)} + 1)::INT] END AS pred_lang,
 CASE WHEN blank THEN 0.0::DOUBLE ELSE (gen_id % 97) / 96.0::DOUBLE END AS pred_conf FROM sc0),
sm AS (SELECT *, coalesce(pred_lang = language, FALSE) AS match FROM sc),
flu AS (SELECT model, language, count(*) AS n, avg(match::INT) AS match_rate, avg(CASE WHEN match THEN pred_conf ELSE 0 END) AS mean_target_conf, avg(pred_conf) AS mean_pred_conf FROM sm GROUP BY ALL)"""
_FLUOUT = "SELECT model, language, n, round(match_rate, 9) AS match_rate, round(mean_target_conf, 9) AS mean_target_conf, round(mean_pred_conf, 9) AS mean_pred_conf FROM flu"
FERT = """fc AS (SELECT 'tok' || k AS tokenizer, language, ceil(length(coalesce(text, '')) / k::DOUBLE) AS n_tok, length(coalesce(text, '')) AS n_char FROM gen, (VALUES (2), (3), (4)) AS v(k) WHERE language IS NOT NULL),
f0 AS (SELECT tokenizer, language, sum(n_tok) / count(*) AS tokens_per_sentence, sum(n_tok) / nullif(sum(n_char), 0) AS tokens_per_char FROM fc GROUP BY ALL),
fert AS (SELECT *, tokens_per_sentence / nullif(max(CASE WHEN language = 'en' THEN tokens_per_sentence END) OVER (PARTITION BY tokenizer), 0) AS fertility_vs_en FROM f0)"""
MORPH = r"""mw AS (SELECT language, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(prompt_text), '[\p{P}\p{S}]', '', 'g'), '[\s\p{Z}]+'), lambda w: w <> '')) AS w FROM p1 WHERE language IS NOT NULL),
mor AS (SELECT language, CASE WHEN language NOT IN ('zh', 'ja') THEN count(DISTINCT w)::DOUBLE / count(*) END AS ttr, CASE WHEN language NOT IN ('zh', 'ja') THEN avg(length(w)) END AS mean_word_len FROM mw GROUP BY language)"""
_LING = f"""{_GAPJ}, {SCORES}, {MORPH}, {DIM},
tok AS (SELECT model, language, avg(ceil(length(coalesce(text, '')) / 4.0::DOUBLE)) AS fertility FROM gen WHERE language IS NOT NULL GROUP BY ALL),
siz AS (SELECT language, log10(count(*)) AS log_size FROM gen WHERE language IS NOT NULL GROUP BY ALL),
ling AS (SELECT g.*, t.fertility, f.match_rate AS lid_match_rate, s.log_size, m.ttr, m.mean_word_len, coalesce(d.family, 'Other') AS family FROM gapj g
 LEFT JOIN tok t ON g.model = t.model AND g.language = t.language LEFT JOIN flu f ON g.model = f.model AND g.language = f.language
 LEFT JOIN siz s ON g.language = s.language LEFT JOIN mor m ON g.language = m.language LEFT JOIN dim d ON g.model = d.model)"""


def _spear(src: str, x: str, y: str) -> str:
    return f"""SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM (SELECT {x} AS x, {y} AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""


_SV = ["fertility", "lid_match_rate", "log_size"]
_PR = [*_SV, "ttr"]
POOL = """msg AS (SELECT * FROM messages WHERE NOT coalesce(deleted, FALSE) AND coalesce(review_result, FALSE) QUALIFY row_number() OVER (PARTITION BY message_id) = 1),
ans AS (SELECT parent_id, count(*) AS n, string_agg(coalesce(text, '<null>'), chr(10) || '--' || chr(10) ORDER BY message_id) AS answers FROM msg WHERE role = 'assistant' GROUP BY parent_id),
pool AS (SELECT r.message_id AS prompt_id, r.lang AS language, r.text AS prompt_text, coalesce(a.n, 0) AS n_responses, a.answers FROM msg r LEFT JOIN ans a ON r.message_id = a.parent_id WHERE r.role = 'prompter' AND r.parent_id IS NULL)"""
_IN13 = "language IN (" + ", ".join(f"'{x}'" for x in LANG_ORDER) + ")"
_METRICS = f"""{COS}, {_cells("vec", "hf", 32, True)},
mi AS (SELECT 'whole' AS metric, * FROM cel_intra UNION ALL SELECT 'half', * FROM hf_intra),
ma AS (SELECT metric, model, language, avg(intra_sim) AS llm_intra FROM mi WHERE model <> 'Human' GROUP BY ALL), mh AS (SELECT metric, language, avg(intra_sim) AS human_intra FROM mi WHERE model = 'Human' GROUP BY ALL),
met AS (SELECT ma.*, human_intra, llm_intra - human_intra AS gap FROM ma JOIN mh ON ma.metric = mh.metric AND ma.language = mh.language)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["intra_cosine"] = f"WITH {VEC}, {_cells()} SELECT model, language, prompt_id, round(intra_sim, 6) AS intra_sim, n_samples FROM cel_intra"
    q["model_summary"] = f"WITH {VEC}, {_cells()} SELECT model, count(intra_sim) AS n_cells, round(avg(intra_sim), 6) AS mean_sim, round(stddev_samp(intra_sim), 6) AS std_sim FROM cel_intra GROUP BY model"
    q["inter_cosine"] = f"WITH {VEC}, {_cells()}, {INTER_ALL} SELECT model_a, model_b, language, prompt_id, round(inter_sim, 6) AS inter_sim FROM inter_all"
    q["respondent_matrix"] = f"WITH {MATRIX} SELECT resp_a, resp_b, round(sim, 6) AS sim FROM mat"
    cols = ", ".join(f"round(max(CASE WHEN resp_b = '{r}' THEN sim END), 6) AS {r}" for r in RESP)
    q["respondent_matrix_wide"] = f"WITH {MATRIX} SELECT resp_a, {cols} FROM mat GROUP BY resp_a"
    q["matrix_long"] = q["respondent_matrix"]
    q["family_matrix"] = f"""WITH {MATRIX} SELECT coalesce(f.family, resp_a) AS family_a, coalesce(g.family, resp_b) AS family_b, round(coalesce(avg(sim) FILTER (WHERE resp_a <> resp_b), avg(sim) FILTER (WHERE resp_a = resp_b)), 6) AS sim
 FROM mat LEFT JOIN fam f ON resp_a = f.model LEFT JOIN fam g ON resp_b = g.model GROUP BY 1, 2"""
    q["family_self_sim"] = f"WITH {MATRIX} SELECT family, round(avg(sim), 6) AS self_sim, count(*) AS n_models FROM mat JOIN fam ON resp_a = model WHERE resp_a = resp_b GROUP BY family"
    q["intra_jaccard"] = f"WITH {GEN}, {_jac('gen', 'ja')} " + _JOUT.format("ja")
    q["intra_jaccard_trunc"] = f"WITH {GEN}, {_jac('gen', 'ja', trunc='substring(text, 1, 500)')} " + _JOUT.format("ja")
    q["human_jaccard"] = f"WITH {HUMANS}, {_HUM}, {_jac('humx', 'jh')} " + _JOUT.format("jh")
    q["inter_jaccard"] = f"""WITH {GEN}, t AS MATERIALIZED (SELECT model, language, prompt_id, gen_id AS id, coalesce(text, '') AS t FROM gen WHERE sample_idx < 10 AND model IS NOT NULL AND language IS NOT NULL AND prompt_id IS NOT NULL),
g AS MATERIALIZED (SELECT language, prompt_id, model, id, unnest(list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4)))) AS g FROM t WHERE length(t) >= 4),
s AS (SELECT t.*, coalesce(c, 0) AS c FROM t LEFT JOIN (SELECT id, count(*) AS c FROM g GROUP BY id) k ON t.id = k.id),
i AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.language = y.language AND x.prompt_id = y.prompt_id AND x.g = y.g AND x.model < y.model GROUP BY 1, 2),
p AS (SELECT x.model AS model_a, y.model AS model_b, x.language, x.prompt_id, coalesce(i.c, 0)::DOUBLE / nullif(x.c + y.c - coalesce(i.c, 0), 0) AS j FROM s x JOIN s y ON x.language = y.language AND x.prompt_id = y.prompt_id AND x.model < y.model LEFT JOIN i ON i.a = x.id AND i.b = y.id)
SELECT model_a, model_b, language, prompt_id, round(avg(j), 6) AS inter_sim FROM p GROUP BY 1, 2, 3, 4 HAVING avg(j) IS NOT NULL"""
    q["ngram_set_size"] = f"WITH {GEN}, t AS (SELECT gen_id, coalesce(text, '') AS t FROM gen) SELECT gen_id, CASE WHEN length(t) >= 4 THEN len(list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4)))) ELSE 0 END AS n_grams FROM t"
    q["pooled_cell"] = f"WITH {COS} SELECT language, prompt_id, round(avg(intra_sim), 6) AS sim FROM intra GROUP BY ALL"
    q["f_intra_levels"] = _f(LEVELS_I, "vi")
    q["f_cross_levels"] = _f(LEVELS_X, "lx")
    q["f_cross_model"] = _f(LEVELS_X, "lm")
    q["variance_f"] = _f(LEVELS_I, "vi", "level = 'model'", "grp, round(CASE WHEN var_a > 0 AND var_b > 0 THEN greatest(var_a, var_b) / least(var_a, var_b) END, 6) AS f_var, CASE WHEN var_a >= var_b THEN n_a - 1 ELSE n_b - 1 END AS df_top, CASE WHEN var_a >= var_b THEN n_b - 1 ELSE n_a - 1 END AS df_low")
    q["f_family_pairwise"] = f"""WITH {COS}, {LEVELS_I}, m AS (SELECT grp, {_mom("a")} FROM vi WHERE level = 'family' GROUP BY grp),
j AS (SELECT x.grp AS family_a, y.grp AS family_b, x.n_a, x.mean_a, x.std_a, x.var_a, y.n_a AS n_b, y.mean_a AS mean_b, y.std_a AS std_b, y.var_a AS var_b FROM m x JOIN m y ON x.grp < y.grp WHERE x.n_a >= 2 AND y.n_a >= 2) SELECT family_a, family_b, {_FCOLS} FROM j"""
    q["paired_intra"] = f"WITH {_PAIR_I} SELECT {_P6} FROM pi"
    q["paired_cross"] = f"WITH {COS}, {_PAIR_X} SELECT {_P6} FROM px"
    q["paired_ladder"] = f"WITH {COS}, {_PAIR_L} SELECT {_P6} FROM pl"
    q["side_stats"] = f"""WITH {_PAIR_I} SELECT level, grp, lang, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN avg(llm) END, 6) AS mean_llm, round(CASE WHEN count(*) >= 2 THEN avg(human) END, 6) AS mean_human,
 round(CASE WHEN count(*) >= 2 THEN stddev_samp(llm) / sqrt(count(*)) END, 6) AS se_llm, round(CASE WHEN count(*) >= 2 THEN stddev_samp(human) / sqrt(count(*)) END, 6) AS se_human FROM pi WHERE llm IS NOT NULL AND human IS NOT NULL GROUP BY level, grp, lang"""
    q["bootstrap_ci"] = f"""WITH {_PAIR_I}, {_num("pi")}, tr AS (SELECT level, grp, lang, g, b, {_u("'0'", "'b'", "g", "b", "i")} % n AS pick FROM num, range(200) AS r(b) WHERE n >= 2),
me AS (SELECT tr.g, tr.b, avg(num.gap) AS m FROM tr JOIN num ON tr.g = num.g AND tr.pick = num.i GROUP BY ALL), ci AS (SELECT g, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM me GROUP BY g),
ba AS (SELECT level, grp, lang, g, count(*) AS n, CASE WHEN count(*) >= 2 THEN avg(gap) END AS m FROM num GROUP BY ALL) SELECT level, grp, lang, n, round(m, 6) AS mean_gap, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM ba LEFT JOIN ci ON ba.g = ci.g"""
    q["signflip_perm"] = f"WITH {_PAIR_I}, {_sign('pi', 'sf')} SELECT level, grp, lang, n, round(p_perm, 6) AS p_perm FROM sf"
    q["cluster_bootstrap"] = f"""WITH {_PAIR_I}, x AS (SELECT language, gap, row_number() OVER (PARTITION BY language ORDER BY prompt_id) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM pi WHERE level = 'general' AND gap IS NOT NULL),
la AS (SELECT language, n, row_number() OVER (ORDER BY language) - 1 AS l, count(*) OVER () AS k FROM (SELECT DISTINCT language, n FROM x)),
dr AS (SELECT la.l AS slot, b, {_u("'0'", "'l'", "b", "la.l")} % k AS l FROM la, range(200) AS r(b)),
ea AS (SELECT dr.b, la.language, {_u("'0'", "'p'", "dr.b", "dr.slot", "j")} % la.n AS i FROM dr JOIN la ON dr.l = la.l, unnest(range(0, la.n)) AS u(j)),
me AS (SELECT b, avg(gap) AS m FROM ea JOIN x ON ea.language = x.language AND ea.i = x.i GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) AS cluster_ci_lo, round(quantile_cont(m, 0.975), 6) AS cluster_ci_hi FROM me"""
    q["wilcoxon_w"] = f"""WITH {_PAIR_I}, d AS (SELECT level, grp, lang, gap, round(abs(gap), 12) AS d FROM pi WHERE gap IS NOT NULL), nz AS (SELECT *, rank() OVER (PARTITION BY level, grp, lang ORDER BY d) + (count(*) OVER (PARTITION BY level, grp, lang, d) - 1) / 2.0::DOUBLE AS r FROM d WHERE d > 0)
SELECT level, grp, lang, count(*) AS n_nonzero, round(sum(CASE WHEN gap > 0 THEN r ELSE 0 END), 6) AS w_plus FROM nz GROUP BY level, grp, lang"""
    q["paired_t"] = f"WITH {_PAIR_I} SELECT level, grp, lang, count(*) AS n, round(CASE WHEN stddev_samp(gap) > 0 THEN avg(gap) / (stddev_samp(gap) / sqrt(count(*))) END, 6) AS t FROM pi WHERE gap IS NOT NULL GROUP BY level, grp, lang HAVING count(*) >= 2"
    q["holm_bh"] = f"WITH {_TESTS} SELECT comparison, level, grp, lang, round(mean_gap, 6) AS mean_gap, round(p_perm, 6) AS p_perm, round(p_perm_holm, 6) AS p_perm_holm, round(p_perm_bh, 6) AS p_perm_bh FROM adj"
    up = lambda c: f"count(*) FILTER (WHERE mean_gap > 0 AND {c} < 0.05)"
    q["test_counts"] = f"WITH {_TESTS} SELECT comparison, level, count(*) AS k, count(*) FILTER (WHERE mean_gap > 0) AS n_positive, {up('p_perm')} AS n_p, {up('p_perm_holm')} AS n_holm, {up('p_perm_bh')} AS n_bh FROM adj GROUP BY ALL"
    q["prompt_pools"] = f"WITH {POOL}, n AS (SELECT language, count(*) AS n_eligible FROM pool WHERE n_responses >= 3 AND {_IN13} GROUP BY language) SELECT *, row_number() OVER (ORDER BY n_eligible, language) = 1 AS bottleneck FROM n"
    q["prompt_select"] = f"WITH {POOL} SELECT prompt_id, language, prompt_text, n_responses FROM pool WHERE n_responses >= 3 AND {_IN13} QUALIFY row_number() OVER (PARTITION BY language ORDER BY md5('42|' || prompt_id), prompt_id) <= 5"
    q["sibling_lists"] = f"WITH {POOL} SELECT prompt_id, n_responses, answers FROM pool"
    q["human_explode"] = f"WITH {PROMPTS} SELECT language, prompt_id, i - 1 AS human_idx, human_responses[i] AS text FROM p1, unnest(range(1, len(human_responses) + 1)) AS u(i) UNION ALL SELECT language, prompt_id, NULL, NULL FROM p1 WHERE human_responses IS NULL OR len(human_responses) = 0"
    q["prompt_dedup"] = f"WITH {PROMPTS} SELECT prompt_id, language, prompt_text, len(human_responses) AS n_listed, n_responses FROM p1"
    stripped = _strip("regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', '', 'g')")
    q["think_strip"] = f"WITH {GEN}, t AS (SELECT gen_id, coalesce(text, '') AS raw FROM gen), s AS (SELECT gen_id, raw, CASE WHEN raw = '' THEN raw ELSE {stripped} END AS stripped FROM t) SELECT gen_id, stripped, raw <> stripped AS had_think, length(stripped) = 0 AS empty_after_strip FROM s"
    q["gen_profile"] = f"""WITH {GEN}, t AS (SELECT model, coalesce(text, '') AS t, coalesce(lower(finish_reason) = 'length', FALSE) AS cut FROM gen) SELECT model, round(avg(length(t)), 6) AS mean_chars, round(100 * avg(cut::INT), 6) AS trunc_pct, round(avg(contains(t, '<think>')::INT), 6) AS think_share,
 count(*) FILTER (WHERE {_strip("t")} = '') AS n_empty, count(*) FILTER (WHERE CASE WHEN t = '' THEN TRUE ELSE length({stripped.replace('(raw,', '(t,')}) = 0 END) AS dangling_think FROM t GROUP BY model"""
    q["empty_dropped"] = f"WITH {GEN}, t AS (SELECT model, {_strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} = '' AS blank FROM gen) SELECT model, count(*) FILTER (WHERE NOT blank) AS kept, count(*) FILTER (WHERE blank) AS dropped FROM t GROUP BY model"
    q["fluency_summary"] = f"WITH {GEN}, {SCORES} {_FLUOUT}"
    q["fluent_cells"] = f"WITH {GEN}, {SCORES} {_FLUOUT} WHERE match_rate >= 0.8 AND language IS NOT NULL"
    q["fertility"] = f"WITH {GEN}, {FERT} SELECT tokenizer, language, round(tokens_per_sentence, 6) AS tokens_per_sentence, round(tokens_per_char, 6) AS tokens_per_char, round(fertility_vs_en, 6) AS fertility_vs_en FROM fert"
    fp = ", ".join(f"round(max(CASE WHEN language = '{x}' THEN fertility_vs_en END), 6) AS \"{x}\"" for x in LANG_ORDER)
    q["fertility_pivot"] = f"WITH {GEN}, {FERT} SELECT tokenizer, {fp} FROM fert GROUP BY tokenizer"
    q["morphology"] = f"WITH {PROMPTS}, {MORPH} SELECT language, round(ttr, 6) AS ttr, round(mean_word_len, 6) AS mean_word_len FROM mor"
    q["gap_lexical"] = f"WITH {_GAPJ} SELECT model, language, round(llm_intra, 6) AS llm_intra, round(human_intra, 6) AS human_intra, round(gap, 6) AS gap FROM gapj"
    lc = ", ".join(f"round({c}, 6) AS {c}" for c in ("llm_intra", "human_intra", "gap", "fertility", "lid_match_rate", "log_size", "ttr", "mean_word_len"))
    q["linguistic_table"] = f"WITH {_LING} SELECT model, language, family, {lc} FROM ling"
    q["language_summary"] = f"WITH {_LING} SELECT language, round(avg(gap), 6) AS gap, round(avg(fertility), 6) AS fertility, round(max(log_size), 6) AS log_size, round(max(mean_word_len), 6) AS mean_word_len FROM ling GROUP BY language"
    q["spearman_gap"] = f"WITH {_LING}, r AS ({_spear('ling', 'gap', 'log_size')}) SELECT n, round(rho, 6) AS rho FROM r WHERE n >= 4"
    q["spearman_matrix"] = f"WITH {_LING} " + " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(rho, 6) AS rho FROM ({_spear('ling', a, b)})" for i, a in enumerate(_SV) for b in _SV[i:])
    q["linreg_fit"] = f"WITH {_LING} SELECT round(regr_slope(gap, log_size), 6) AS slope, round(regr_intercept(gap, log_size), 6) AS intercept, round(corr(gap, log_size), 6) AS r FROM ling WHERE gap IS NOT NULL AND log_size IS NOT NULL"
    q["zscore"] = f"WITH {_LING} SELECT model, language, round((fertility - avg(fertility) OVER ()) / stddev_samp(fertility) OVER (), 6) AS z_fertility FROM ling WHERE gap IS NOT NULL AND fertility IS NOT NULL"
    q["ols_placebo"] = f"""WITH {_LING}, x AS (SELECT language, max(human_intra) AS y, max(log_size) AS s FROM ling GROUP BY language), z AS (SELECT y, (s - avg(s) OVER ()) / stddev_samp(s) OVER () AS z FROM x)
SELECT round(regr_slope(y, z), 6) AS slope, round(regr_intercept(y, z), 6) AS intercept, round(corr(y, z), 6) AS r FROM z WHERE y IS NOT NULL AND z IS NOT NULL"""
    q["robustness_summary"] = f"""WITH {_METRICS}, ok AS (SELECT * FROM met WHERE gap IS NOT NULL), lg AS (SELECT metric, language, avg(gap) AS g FROM ok GROUP BY ALL), ls AS (SELECT metric, count(*) FILTER (WHERE g > 0) AS langs_positive, count(*) AS n_langs FROM lg GROUP BY metric),
al AS (SELECT metric, count(*) AS n_cells, avg(llm_intra) AS llm_intra, avg(human_intra) AS human_intra, avg(gap) AS gap, count(*) FILTER (WHERE gap > 0) AS cells_positive FROM ok GROUP BY metric),
jj AS (SELECT a.metric, a.gap AS x, b.gap AS y FROM ok a JOIN ok b ON a.model = b.model AND a.language = b.language AND a.metric <> 'whole' AND b.metric = 'whole'),
rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0::DOUBLE AS ry FROM jj),
vs AS (SELECT metric, corr(rx, ry) AS rho, avg((sign(x) = sign(y))::INT) AS agree FROM rk GROUP BY metric)
SELECT al.metric, n_cells, round(llm_intra, 6) AS llm_intra, round(human_intra, 6) AS human_intra, round(gap, 6) AS gap, cells_positive, langs_positive, n_langs, round(rho, 6) AS spearman_vs_primary, round(agree, 6) AS sign_agree FROM al JOIN ls ON al.metric = ls.metric LEFT JOIN vs ON al.metric = vs.metric"""
    q["robustness_by_language"] = f"WITH {_METRICS} SELECT language, round(avg(gap) FILTER (WHERE metric = 'whole'), 6) AS whole, round(avg(gap) FILTER (WHERE metric = 'half'), 6) AS half FROM met GROUP BY language"
    q["metric_agreement"] = f"WITH {_METRICS} SELECT a.model, a.language, round(a.gap, 6) AS gap_primary, round(b.gap, 6) AS gap_other, sign(a.gap) = sign(b.gap) AS agree FROM met a JOIN met b ON a.model = b.model AND a.language = b.language AND a.metric = 'whole' AND b.metric = 'half'"
    q["model_labels"] = f"""WITH {DIM} SELECT model, replace(model, '/', '_') AS slug, split_part(gpus, ':', 2) || ' x ' || CASE split_part(gpus, ':', 1) WHEN 'A40' THEN 'A40 48 GB' WHEN 'A100fat' THEN 'A100 80 GB' ELSE split_part(gpus, ':', 1) END AS gpus,
 CASE WHEN starts_with(model, 'gpt-') OR starts_with(model, 'o1-') OR starts_with(model, 'o3-') OR starts_with(model, 'o4-') THEN 'openai' WHEN starts_with(model, 'claude-') THEN 'anthropic' WHEN starts_with(model, 'gemini-') THEN 'gemini' ELSE 'vllm' END AS backend FROM dim"""
    labels = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in LABELS.items())
    q["language_labels"] = f"WITH {GEN} SELECT language, CASE language {labels} END AS label, count(*) AS n, coalesce(list_position({_ORD}, language), 0) AS place FROM gen GROUP BY language"
    q["cell_previews"] = f"WITH {GEN}, {PROMPTS} SELECT g.prompt_id, coalesce(substring(p.prompt_text, 1, 40), '') AS preview, count(*) AS n FROM gen g LEFT JOIN p1 p ON g.prompt_id = p.prompt_id GROUP BY 1, 2"
    q["family_json"] = f"WITH {FAM} SELECT family AS key, '{{\"family\":\"' || family || '\",\"n_models\":' || count(*) || '}}' AS json FROM fam GROUP BY family"
    q["recompute_check"] = f"""WITH {VEC}, {_cells()}, {INTER_ALL}, a AS (SELECT model_a, model_b, avg(inter_sim) AS v FROM inter_all GROUP BY ALL), l AS (SELECT model_a, model_b, language, sum(inter_sim) AS s, count(inter_sim) AS k FROM inter_all GROUP BY ALL),
 b AS (SELECT model_a, model_b, sum(s) / sum(k) AS u FROM l GROUP BY ALL) SELECT count(*) AS n, max(abs(v - u)) < 1e-9 AS same FROM a JOIN b USING (model_a, model_b)"""
    q["source_discovery"] = "SELECT kind, slug FROM (VALUES ('intra', 'whole'), ('human_intra', 'whole'), ('inter', 'whole')) AS f(kind, slug)"
    q["pair_summary"] = f"WITH {VEC}, {_cells()}, {INTER_ALL} SELECT model_a, model_b, count(inter_sim) AS n_cells, round(avg(inter_sim), 6) AS mean_sim, round(stddev_samp(inter_sim), 6) AS std_sim FROM inter_all GROUP BY ALL"
    by = "bl AS (SELECT language, avg(gap) AS gap, avg(llm_intra) AS llm_intra, avg(human_intra) AS human_intra, " + ", ".join(f"avg({p}) AS {p}" for p in _PR) + " FROM ling GROUP BY language)"
    rho = lambda src, p, y, **lit: "SELECT " + "".join(f"'{v}' AS {k}, " for k, v in lit.items()) + f"n, round(rho, 6) AS rho FROM ({_spear(src, p, y)})"
    q["predictor_correlations"] = f"WITH {_LING}, {by} " + " UNION ALL ".join(rho(src, p, "gap", level=lv, predictor=p) + " WHERE n >= 4" for lv, src in (("cell", "ling"), ("language", "bl")) for p in _PR)
    q["gap_decomposition"] = f"WITH {_LING}, {by} " + " UNION ALL ".join(rho("bl", p, y, predictor=p, outcome=y) + " WHERE n >= 2" for p in _PR for y in ("gap", "llm_intra", "human_intra"))
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z{i}" for i, c in enumerate(_SV))
    s_ = ", ".join(f"sum(z{i} * z{j}) AS s{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum(z{i} * y) AS r{i}" for i in range(3))
    # The inverse of the symmetric 3 x 3 matrix of the predictors by its cofactors.
    q["placebo_all"] = f"""WITH {_LING}, {by}, c AS (SELECT human_intra AS y, {", ".join(_SV)} FROM bl WHERE human_intra IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in _SV)}), z AS (SELECT y, {z} FROM c),
m AS (SELECT count(*) AS n, avg(y) AS my, sum(y * y) AS yy, {s_} FROM z),
f AS (SELECT *, s11 * s22 - s12 * s12 AS a00, s02 * s12 - s01 * s22 AS a01, s01 * s12 - s02 * s11 AS a02, s00 * s22 - s02 * s02 AS a11, s01 * s02 - s00 * s12 AS a12, s00 * s11 - s01 * s01 AS a22 FROM m),
g AS (SELECT *, s00 * a00 + s01 * a01 + s02 * a02 AS det FROM f),
b AS (SELECT *, (a00 * r0 + a01 * r1 + a02 * r2) / det AS b0, (a01 * r0 + a11 * r1 + a12 * r2) / det AS b1, (a02 * r0 + a12 * r1 + a22 * r2) / det AS b2 FROM g),
e AS (SELECT *, (yy - n * my * my - b0 * r0 - b1 * r1 - b2 * r2) / (n - 4) AS s2 FROM b),
t AS (SELECT 'intercept' AS term, n, my AS coef, sqrt(s2 / n) AS se FROM e UNION ALL SELECT '{_SV[0]}', n, b0, sqrt(s2 * a00 / det) FROM e UNION ALL SELECT '{_SV[1]}', n, b1, sqrt(s2 * a11 / det) FROM e UNION ALL SELECT '{_SV[2]}', n, b2, sqrt(s2 * a22 / det) FROM e)
SELECT term, n, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 6) AS t FROM t WHERE n > 4"""
    q["effect_order"] = f"""WITH {COS}, a AS (SELECT model, language, avg(intra_sim) AS l FROM intra GROUP BY ALL), h AS (SELECT language, avg(intra_sim) AS h FROM human GROUP BY ALL), g AS (SELECT a.model, a.language, l - h AS gap FROM a JOIN h ON a.language = h.language), m AS (SELECT *, avg(gap) OVER (PARTITION BY language) AS lm FROM g)
SELECT model, language, round(gap, 6) AS gap, dense_rank() OVER (ORDER BY lm DESC) AS place FROM m"""
    q["model_lookup"] = f"WITH {GEN}, {DIM} SELECT coalesce(d.display_name, g.model) AS name, coalesce(d.family, 'Other') AS family, count(*) AS n FROM gen g LEFT JOIN dim d ON g.model = d.model GROUP BY 1, 2"
    q["hosted_models"] = f"WITH {DIM} SELECT model, family, split_part(gpus, ':', 1) AS gpu, split_part(gpus, ':', 2) AS gpu_count FROM dim WHERE gpus IS NOT NULL"
    q["merged_counts"] = "SELECT model, count(*) AS n, count(DISTINCT gen_id) AS n_records FROM responses GROUP BY model"
    q["sample_limit"] = f"WITH {GEN} SELECT model, count(*) AS n, sum(length(substring(coalesce(text, ''), 1, 500)))::BIGINT AS chars FROM gen WHERE sample_idx < 10 GROUP BY model"
    q["family_pair_counts"] = f"WITH {COS}, {LEVELS_X} SELECT pair AS family_pair, count(*) AS n FROM xp GROUP BY pair"
    return q
