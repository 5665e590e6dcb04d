"""DuckDB expressions of the features, in the dialect that has no lookaround; ``t`` is a text, ``l`` its lower-cased form."""

from __future__ import annotations

import re

from telltale.functions import regexes as R
from telltale.functions.features import BOLD, LABEL, pool
from telltale.functions.lexicon import ARTIFACT_PHRASES, ARTIFACTS, GENERIC_HEADINGS, MARKS, Pack, Pattern, packs

from .tells import sql as tells

SPACES = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
EMOJI = R.EMOJI


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {s(pattern)}))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {s(f'^{SPACES}+|{SPACES}+$')}, '', 'g')"


WORDS = f"regexp_extract_all(t, {s(R.WORD)})"
WC = f"greatest(len({WORDS}), 1)"
LINES = "string_split(t, chr(10))"
SENTENCES = f"list_filter(string_split(regexp_replace({strip('t')}, {s(f'([.!?]){SPACES}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, {s(f'[^{SPACES[1:-1]}]')}))"
PARAGRAPHS = f"list_filter(string_split_regex({strip('t')}, {s(chr(92) + 'n' + SPACES + '*' + chr(92) + 'n')}), lambda x: regexp_matches(x, {s(f'[^{SPACES[1:-1]}]')}))"


def lengths(parts: str) -> str:
    return f"list_transform({parts}, lambda x: {count('x', R.TOKEN)})"


def variation(xs: str) -> str:
    n, q, m = f"len({xs})", f"list_sum(list_transform({xs}, lambda v: v * v))", f"list_sum({xs})"
    return f"CASE WHEN {n} >= 5 THEN round_even(CASE WHEN {m} = 0 THEN 0.0::DOUBLE ELSE sqrt(({n} * {q} - {m} * {m})::DOUBLE) / {n} / ({m}::DOUBLE / {n}) END, 2) END"


def chars(which: str) -> str:
    return f"(length(t) - length(translate(t, {s(which)}, '')))"


STRUCTURAL = rf"^{SPACES}*(?:#|(?:[-*+]|[0-9]{{1,3}}[.)]){SPACES})"
LIST_LABEL = rf"(?m)^[ \t]*(?:(?:[-*+]|[0-9]{{1,3}}[.)]){SPACES}+)?" + LABEL


def spaced(pattern: str) -> str:
    """A pattern of a pack in the other dialect."""
    return pattern.replace(r"\s", SPACES)


def pattern(p: Pattern) -> str | None:
    rx = p.regex
    if r"\1" in rx:
        return None
    text = "t"
    if "(?<=" in rx:
        rx = re.sub(r"\(\?<=\[\.!\?\]\)", "[.!?]", rx)
        text = "regexp_replace(t, '([.!?])', '\\1\\1', 'g')"
        rx = re.sub(r"\\\?$", r"\\?", rx)
    return count(text, spaced(rx))


DOUBLED = f"(' ' || regexp_replace(l, '({NOT_WORD})', '\\1\\1', 'g') || ' ')"


def doubled(word: str) -> str:
    return "".join(rf"{SPACES}+" if c == " " else R.quoted(c) * (1 if re.match(r"\w", c) else 2) for c in word)


def needles(words: list[str]) -> str:
    return NOT_WORD + "(?:" + "|".join(doubled(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")" + NOT_WORD


def keys(pack: Pack) -> str:
    """What the four lists find, as written in the lists."""
    rx = needles([w for _, ws in pool(pack) for w in ws])
    inner = f"regexp_replace(regexp_replace(x[2:-2], {s(SPACES + '+')}, ' ', 'g'), '([^\\p{{L}}\\p{{N}}_ ])([^\\p{{L}}\\p{{N}}_ ])', '\\1', 'g')"
    return f"list_transform(regexp_extract_all({DOUBLED}, {s(rx)}), lambda x: {inner})"


def of_kind(found: str, pack: Pack, kind: str) -> str:
    taken: set[str] = set()
    for name, listed in pool(pack):
        own = [w for w in listed if w not in taken]
        taken.update(own)
        if name == kind:
            return f"len(list_filter({found}, lambda x: x IN ({', '.join(map(s, own))})))" if own else "0"
    raise KeyError(kind)


def artifacts(pack: Pack) -> str:
    phrase = "|".join(re.sub(" ", lambda _: SPACES + "+", R.quoted(w)) for w in sorted([*ARTIFACT_PHRASES, *pack.artifact_phrases], key=lambda w: -len(w)))
    some = "(?:" + "|".join(R.quoted(x) for x in sorted(ARTIFACTS, key=len, reverse=True)) + rf"|\b(?:{phrase})\b)"
    return count("l", f"(?s){some}(?:.?{some})*")


HEADINGS = f"list_filter(list_transform({LINES}, lambda x: regexp_extract(x, '^#{{1,6}}[ \\t]+(.+?)[ \\t]*$', 1)), lambda x: x <> '')"
TITLES = f"list_transform({HEADINGS}, lambda x: lower(regexp_replace(regexp_replace(regexp_replace(x, '[*_`]+', '', 'g'), {s(f'^{SPACES}+|{SPACES}+$')}, '', 'g'), '[:.]+$', '')))"
LEVELS = f"list_transform(list_filter({LINES}, lambda x: regexp_matches(x, {s(f'^#{{1,6}}[ {chr(92)}t]+[^{SPACES[1:-1]}]')})), lambda x: length(regexp_extract(x, '^(#+)', 1)))"
MARK_COUNTS = "list_filter([" + ", ".join(chars(m) for m in MARKS) + "], lambda x: x > 0)"
HOOK = rf"[.!?] [ \t]*(?:{R.LETTER}[\p{{L}}\p{{N}}_'\-]*[ \t]+){{0,4}}{R.LETTER}[\p{{L}}\p{{N}}_'\-]*\?"
FIRST = rf"^[^\p{{L}}\p{{N}}_]*({R.LETTER}[\p{{L}}\p{{N}}_'\-]*)"
OPENERS = f"list_filter(list_transform({SENTENCES}, lambda x: lower(regexp_extract(x, {s(FIRST)}, 1))), lambda x: x <> '')"
HEADS = f"list_filter(list_transform({PARAGRAPHS}, lambda x: array_to_string(regexp_extract_all(lower(x), {s(R.BARE)})[1:5], ' ')), lambda x: x <> '')"
HEAVY = {
    "bold": f"list_sum(list_transform(list_filter({LINES}, lambda x: NOT regexp_matches(x, {s(STRUCTURAL)})), lambda x: {count('x', BOLD)} - CASE WHEN {count('x', BOLD)} > 0 AND regexp_matches(x, {s('^' + SPACES + '*' + LABEL)}) THEN 1 ELSE 0 END))",
    "header": f"list_sum(list_transform(list_filter({LINES}, lambda x: regexp_matches(x, {s(STRUCTURAL)})), lambda x: {count('x', EMOJI)}))",
}


def connectives(pack: Pack) -> str:
    if not pack.connectives:
        return "0"
    return count("t", rf"(?im)(?:^|[.!?]{SPACES})[ \t]*(?:{'|'.join(R.quoted(x) for x in pack.connectives)})\b")


def features(pack: Pack) -> str:
    """Common table expressions up to ``f``, which has every feature of the text under one pack."""
    n, k = "list_sum(marks)", "len(marks)"
    pats = [(p, pattern(p)) for p in pack.patterns]
    raw = " + ".join(f"{p.weight} * greatest(0, {q} - {p.free})" for p, q in pats if q and p.weight) or "0"
    return f"""WITH {tells()},
a AS (SELECT *, {WC} AS words, {keys(pack)} AS ks, {lengths(SENTENCES)} AS sl, list_filter({lengths(PARAGRAPHS)}, lambda x: x > 0) AS pl, {MARK_COUNTS} AS marks, {OPENERS} AS op, {HEADS} AS heads, len({PARAGRAPHS}) AS np, {LEVELS} AS lv FROM low),
b AS (SELECT *, {of_kind('ks', pack, 'buzzword')} AS n_buzz, {of_kind('ks', pack, 'phrase')} AS n_phrase, {of_kind('ks', pack, 'copula')} AS n_copula, {of_kind('ks', pack, 'scope')} AS n_scope,
  {artifacts(pack)} AS ai_artifacts, {chars('—')} AS em_dashes, {count('t', EMOJI)} AS emoji, coalesce({HEAVY['header']}, 0) AS header_emoji, coalesce({HEAVY['bold']}, 0) AS bold_inline,
  {count('t', LIST_LABEL)} AS bold_label_bullets, {count('t', '(?m)^[ {0}t]*[•▪‣]'.format(chr(92)))} AS bare_bullets, len(list_filter({TITLES}, lambda x: x IN ({', '.join(map(s, GENERIC_HEADINGS))}))) AS generic_headings,
  len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)) AS heading_level_skips,
  CASE WHEN ({chars('’‘')} >= 3 AND {chars("'")} >= 3) OR ({chars('“”')} >= 3 AND {chars('"')} >= 3) THEN 1 ELSE 0 END AS quote_mix,
  CASE WHEN {n} >= 30 THEN CASE WHEN {k} <= 1 THEN 0.0::DOUBLE ELSE round_even(-list_sum(list_transform(marks, lambda x: x / {n}::DOUBLE * log2(x / {n}::DOUBLE))) / log2({k}), 3) END END AS punct_entropy,
  {variation('sl')} AS sentence_uniformity_cv, {variation('pl')} AS paragraph_uniformity_cv,
  {count("array_to_string(list_transform(sl, lambda x: CASE WHEN x BETWEEN 1 AND 5 THEN 's' ELSE '-' END), '')", 's{3,}')} AS staccato_runs,
  {count("regexp_replace(t, '([.!?])', '{0}1{0}1', 'g')".format(chr(92)), HOOK)} AS question_hooks, {connectives(pack)} AS connective_openers,
  CASE WHEN len(op) >= 8 THEN round_even(list_max(list_transform(list_distinct(op), lambda x: len(list_filter(op, lambda y: y = x)))) / len(op)::DOUBLE, 2) END AS opener_top_share,
  CASE WHEN np >= 5 THEN list_max(list_transform(list_distinct(heads), lambda x: len(list_filter(heads, lambda y: y = x)))) END AS best,
  len(list_filter(list_transform({WORDS}, lambda x: lower(x)), lambda x: x IN ({', '.join(map(s, pack.stopwords))}))) AS n_stop,
  {count(DOUBLED, needles(pack.density_crutch)) if pack.density_crutch else '0'} AS density_crutch, {raw} AS pattern_points FROM a),
f AS (SELECT *, greatest(0, em_dashes - floor(greatest(2, words // 90) * {pack.em_dash_factor})::BIGINT) AS em_dash_excess, greatest(0, bold_inline - greatest(2, words // 150)) AS bold_inline_excess,
  greatest(0, question_hooks - 1) AS question_hook_excess, greatest(0, connective_openers - greatest(2, len(sl) // 10)) AS connective_excess,
  CASE WHEN best >= 3 THEN best ELSE 0 END AS paragraph_opener_repeat, coalesce(punct_entropy < 0.55, false) AS punct_entropy_low,
  n_copula >= 2 AND n_copula * 1000.0::DOUBLE / words >= 2.0 AS copula_avoidance_scored, round_even(n_stop / words::DOUBLE, 3) AS function_word_ratio,
  greatest(0, density_crutch - greatest(2, words // 150)) AS density_crutch_excess FROM b)"""


RAW = """(3 * (n_buzz + n_phrase) + pattern_points + 10 * ai_artifacts + em_dash_excess + 2 * emoji + 2 * header_emoji + CASE WHEN bold_label_bullets >= 3 THEN 2 * (bold_label_bullets - 2) ELSE 0 END
 + 2 * bold_inline_excess + 2 * question_hook_excess + CASE WHEN copula_avoidance_scored THEN 3 * n_copula ELSE 0 END + 2 * n_scope + 2 * greatest(0, generic_headings - 1) + 3 * bare_bullets + 2 * density_crutch_excess)"""
SCORE = f"""greatest(round_even({RAW} * 1000.0::DOUBLE / words, 1) + CASE WHEN sentence_uniformity_cv < 0.35 THEN 8 ELSE 0 END + CASE WHEN paragraph_uniformity_cv < 0.25 THEN 4 ELSE 0 END + least(greatest(0, staccato_runs - 1) * 4, 8)
 + 4 * quote_mix + 2 * least(connective_excess, 2) + CASE WHEN punct_entropy_low THEN 5 ELSE 0 END + CASE WHEN paragraph_opener_repeat > 0 THEN 5 ELSE 0 END, CASE WHEN ai_artifacts > 0 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END)"""
VERDICT = "CASE WHEN score_per_1k >= 25 THEN 'reads as AI - needs a real rewrite' WHEN score_per_1k >= 10 THEN 'some AI tells - worth a pass' ELSE 'looks human' END"


def detection() -> str:
    """``det(doc_id, truth, source, language, language_source)`` of the tells."""
    rows = ", ".join(f"({s(c)}, {p.order}, [{', '.join(map(s, p.stopwords))}], [{', '.join(map(s, p.marks))}]::VARCHAR[])" for c, p in packs().items())
    return f"""WITH {tells()}, pack(code, ord, stop, marks) AS (VALUES {rows}),
sam AS (SELECT doc_id, truth, source, lower(t[1:4000]) AS x, regexp_extract_all(lower(t[1:4000]), {s(R.BARE)}) AS tok FROM tells),
long AS (SELECT doc_id, unnest(tok) AS w FROM sam),
hit AS (SELECT doc_id, code, count(*) AS hits FROM long JOIN (SELECT code, unnest(stop) AS w FROM pack) USING (w) GROUP BY ALL),
cov AS (SELECT sam.doc_id, pack.code, ord, coalesce(hits, 0) AS hits, coalesce(hits, 0) / len(tok)::DOUBLE + 0.02 * len(list_filter(marks, lambda m: contains(x, m))) AS cover FROM sam CROSS JOIN pack LEFT JOIN hit ON hit.doc_id = sam.doc_id AND hit.code = pack.code WHERE len(tok) > 0),
rnk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cover DESC, ord) AS r FROM cov),
best AS (SELECT p.doc_id, p.code FROM rnk p JOIN rnk q ON p.doc_id = q.doc_id AND p.r = 1 AND q.r = 2 WHERE p.hits >= 4 AND p.cover >= 0.07 AND p.cover >= q.cover * 1.25),
det AS (SELECT sam.doc_id, truth, source, coalesce(code, 'en') AS language, CASE WHEN code IS NULL THEN 'fallback' ELSE 'detected' END AS language_source FROM sam LEFT JOIN best USING (doc_id))"""


KINDS = ("buzzword", "phrase", "copula", "scope")


def listed(pack: Pack) -> list[tuple[str, str]]:
    """Kind and needle, each needle under the first list that has it."""
    found: dict[str, str] = {}
    for kind, words in pool(pack):
        for word in words:
            found.setdefault(word, kind)
    return [(kind, word) for kind in KINDS for word, own in found.items() if own == kind]


def spelled(word: str) -> str:
    """A needle as a pattern, any white space for a space."""
    return re.sub(" ", lambda _: SPACES + "+", R.quoted(word))


def lexicon_hits(pack: Pack) -> str:
    """Each place of a text that a needle's first letter is at, and the needle there between word boundaries."""
    rows = ", ".join(f"({i}, {s(w)}, {s(spelled(w))})" for i, (_, w) in enumerate(listed(pack)))
    return f"""WITH {tells()}, needle(needle_id, word, rx) AS (VALUES {rows}),
flat AS (SELECT doc_id, l, regexp_replace(l, {s(SPACES + '+')}, ' ', 'g') AS x FROM low),
near AS (SELECT doc_id, string_split(l, '') AS c, needle_id, word, rx FROM flat JOIN needle ON contains(x, word)),
spot AS (SELECT doc_id, c, needle_id, rx, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] = word[1] AND (i = 1 OR regexp_matches(c[i - 1], {s(NOT_WORD)})))) AS i FROM near),
hit AS (SELECT *, regexp_extract(array_to_string(c[i : i + 200], ''), '^(' || rx || {s(f')(?:{NOT_WORD}|$)')}, 1) AS found FROM spot)
SELECT doc_id, needle_id, i - 1 AS start, i - 1 + length(found) AS "end", 1 + len(list_filter(c[1 : i - 1], lambda x: x = chr(10))) AS line FROM hit WHERE found <> ''"""


def swept_pools() -> str:
    """What each pack's own alternation finds, with the kind of each needle."""
    kinds = ", ".join(f"({s(c)}, {s(kind)}, {s(w)})" for c, p in packs().items() for kind, w in listed(p))
    found = " UNION ALL ".join(f"SELECT {s(c)} AS pack, unnest({keys(p)}) AS key_text FROM low" for c, p in packs().items())
    return f"WITH {tells()}, kinds(pack, kind, key_text) AS (VALUES {kinds}), found AS ({found}) SELECT pack, kind, key_text, count(*) AS n FROM found JOIN kinds USING (pack, key_text) GROUP BY ALL"


def config_union(pack: Pack, config: dict) -> str:
    own = ", ".join(f"({s(w)})" for w in [*(w for kind, w in listed(pack) if kind == "buzzword"), *config["extra_words"]])
    gone = ", ".join(f"({s(w)})" for w in config["ignore_words"])
    spelling = rf"regexp_replace(regexp_replace(word, '([^\p{{L}}\p{{N}}_ ])', '[\1][\1]', 'g'), ' ', {s(SPACES.replace(chr(92), chr(92) * 2) + '+')}, 'g')"
    return f"""WITH {tells()}, words AS (SELECT DISTINCT lower(word) AS word FROM (SELECT col0 AS word FROM (VALUES {own}) UNION ALL SELECT event_type FROM events)
  WHERE lower(word) NOT IN (SELECT lower(col0) FROM (VALUES {gone}) UNION ALL SELECT lower(role) FROM conversations WHERE role IS NOT NULL)),
flat AS (SELECT doc_id, regexp_replace(l, {s(SPACES + '+')}, ' ', 'g') AS x, {DOUBLED} AS d FROM low),
hit AS (SELECT word, len(regexp_extract_all(d, {s(NOT_WORD)} || {spelling} || {s(NOT_WORD)})) AS k FROM flat JOIN words ON contains(x, word))
SELECT word, coalesce(sum(k), 0)::BIGINT AS n FROM words LEFT JOIN hit USING (word) GROUP BY word"""


def _lines(text: str, hits: str, gaps: str, doubled: bool) -> str:
    """The line of hit ``i``: line ends before it, of which a doubled text has two, the first character of the hit among what is before."""
    before = f"array_to_string({gaps}[1:i], '') || array_to_string({hits}[1:i-1], '')" + (f" || {hits}[i][1]" if doubled else "")
    return f"1 + (length({before}) - length(replace({before}, chr(10), ''))) // {2 if doubled else 1}"


def findings(pack: Pack, kind: str) -> str:
    """Findings of a pack without lookbehind, as ``findings.finding_table``, as diagnostics, or as diagnostics parsed."""
    rx = needles([w for _, ws in pool(pack) for w in ws])
    phrase = "|".join(re.sub(" ", lambda _: SPACES + "+", R.quoted(w)) for w in sorted([*ARTIFACT_PHRASES, *pack.artifact_phrases], key=lambda w: -len(w)))
    some = "(?:" + "|".join(R.quoted(x) for x in sorted(ARTIFACTS, key=len, reverse=True)) + rf"|\b(?:{phrase})\b)"
    sources = [("pool", DOUBLED, rx, "", 3), ("artifact", "l", f"(?s){some}(?:.?{some})*", "", 10), *[("pattern", "t", spaced(p.regex), p.name, p.weight) for p in pack.patterns]]
    parts = []
    for category, text, pattern, name, weight in sources:
        key = s(name) if name else f"regexp_replace(h, {s(SPACES + '+')}, ' ', 'g')"
        if category == "pool":
            key = f"regexp_replace(regexp_replace(h[2:-2], {s(SPACES + '+')}, ' ', 'g'), '([^\\p{{L}}\\p{{N}}_ ])([^\\p{{L}}\\p{{N}}_ ])', '\\1', 'g')"
        parts.append(f"""SELECT doc_id, {s(category)} AS source, {key} AS key_text, line, {weight} AS weight FROM (SELECT doc_id, hs[i] AS h, {_lines('x', 'hs', 'gs', category == 'pool')} AS line FROM (
SELECT doc_id, hs, gs, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(x, {s(pattern)}) AS hs, string_split_regex(x, {s(pattern)}) AS gs FROM (SELECT doc_id, {text} AS x FROM low))))""")
    kinds = ", ".join(f"({s(k)}, {s(w)})" for k, w in listed(pack))
    rows = f"""{features(pack)}, kinds(category, key_text) AS (VALUES {kinds}), found AS ({' UNION ALL '.join(parts)}),
told AS (SELECT doc_id, coalesce(k.category, source) AS category, key_text, line, CASE WHEN k.category = 'scope' THEN 2 ELSE weight END AS weight FROM found LEFT JOIN kinds k USING (key_text))"""
    if kind == "finding_lines":
        return f"{rows} SELECT doc_id, category, key_text, count(*) AS n, list_sort(list(line))[1:200] AS lines FROM told GROUP BY doc_id, category, key_text"
    level = "CASE WHEN category = 'artifact' THEN 'ERROR' WHEN category = 'pattern' AND weight = 0 THEN 'INFO' WHEN category = 'copula' AND NOT copula_avoidance_scored THEN 'INFO' ELSE 'WARNING' END"
    out = f"{rows}, out AS (SELECT told.*, category || ': ' || key_text AS message, {level} AS severity FROM told JOIN f USING (doc_id))"
    if kind == "rdjson_lines":
        return f"""{out} SELECT '{{"message":' || to_json(message) || ',"location":{{"path":"' || doc_id || '","range":{{"start":{{"line":' || line || '}}}}}},"severity":"' || severity || '"}}' AS value FROM out"""
    return f"{out} SELECT doc_id::VARCHAR AS path, line, CASE severity WHEN 'ERROR' THEN 'E' WHEN 'INFO' THEN 'I' ELSE 'W' END AS type, message AS text FROM out"
