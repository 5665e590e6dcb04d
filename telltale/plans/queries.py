"""One query for each operator of the scorer, over whole tables, with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions import code_parts as parts
from telltale.functions import features as X
from telltale.functions.code_lexer import extensions
from telltale.functions.lexicon import configured, packs
from telltale.operators import restated_rows as restated
from telltale.operators import code, evaluate, files, findings, highlight, needles, prose, spans
from telltale.sources import readers
from telltale.streaming import stream

from . import oracle as O
from .tells import tells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _of(columns: dict[str, Callable], pack: str = "en") -> Query:
    """A query of ``doc_id`` and some columns of the prose record under one pack."""
    return lambda spark, sf_dir: prose.with_features(tells(spark, sf_dir), lang=pack).select("doc_id", *[make().alias(n) for n, make in columns.items()])


def _n(name: str):
    return F.aggregate(name, F.lit(0), lambda a, r: a + r["n"]).cast("long")


def feature(name: str, columns: dict[str, Callable] | list[str], pack: str = "en", sql: dict[str, str] | None = None) -> None:
    """Registers some columns; they are made when the query runs, as columns need a session."""
    spark = {c: lambda c=c: F.col(c) for c in columns} if isinstance(columns, list) else columns
    duck = sql or {c: c for c in spark}
    add(name, _of(spark, pack), f"{O.features(packs()[pack])} SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in duck.items())} FROM f")


feature("word_counts", ["words"])
feature("sentence_stats", {"n_sentences": lambda: F.size("_lengths"), "n_tokens": lambda: X.total(F.col("_lengths")), "sentence_uniformity_cv": lambda: F.col("sentence_uniformity_cv")}, sql={"n_sentences": "len(sl)", "n_tokens": "coalesce(list_sum(sl), 0)", "sentence_uniformity_cv": "sentence_uniformity_cv"})
feature("paragraph_stats", {"n_paragraphs": lambda: F.size(X.paragraphs(F.col("_t"))), "paragraph_uniformity_cv": lambda: F.col("paragraph_uniformity_cv")}, sql={"n_paragraphs": "np", "paragraph_uniformity_cv": "paragraph_uniformity_cv"})
feature("stopword_ratio", ["function_word_ratio"])
for _kind, _column in (("buzz", "buzzwords"), ("phrase", "phrases"), ("copula", "copula_avoidance"), ("scope", "scope_inflation")):
    feature(f"{_kind}_hits", {f"n_{_kind}": lambda c=_column: _n(c)}, sql={f"n_{_kind}": f"n_{_kind}"})
feature("copula_gate", ["copula_avoidance_scored"])
feature("artifact_hits", ["ai_artifacts"])
for _name in ("em_dash_excess", "emoji", "header_emoji", "bold_inline", "bold_label_bullets", "bare_bullets", "generic_headings", "heading_level_skips", "quote_mix", "punct_entropy", "staccato_runs", "paragraph_opener_repeat", "opener_top_share", "question_hooks", "connective_openers", "connective_excess"):
    feature(_name, [_name])
for _code in (c for c in packs() if c != "en"):  # English has a back reference, which the other dialect lacks
    feature(f"prose_score_{_code.replace('-', '_')}", ["words", "score_per_1k", "verdict"], _code)
    SQL[f"prose_score_{_code.replace('-', '_')}"] = f"{O.features(packs()[_code])} SELECT doc_id, words, score_per_1k, {O.VERDICT} AS verdict FROM (SELECT doc_id, words, {O.SCORE} AS score_per_1k FROM f)"
feature("density_crutch_ru", ["density_crutch", "density_crutch_excess"], "ru")

for _p in packs()["en"].patterns:
    _sql = O.pattern(_p)
    add(
        "pattern_" + _p.name.replace(" ", "_"),
        lambda spark, sf_dir, p=_p: tells(spark, sf_dir).select("doc_id", X.count(X.normalised(F.col("text")), findings.R.unicode(p.regex)).alias("n")),
        f"WITH {O.tells()} SELECT doc_id, {_sql} AS n FROM tells" if _sql else None,
    )


def overlap_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = prose.with_features(tells(spark, sf_dir), lang="en").select(F.explode("_keys").alias("key_text"))
    return keys.groupBy("key_text").agg(F.count(F.lit(1)).alias("n"))


add("overlap_pool", overlap_pool, f"{O.features(packs()['en'])} SELECT key_text, count(*) AS n FROM (SELECT unnest(ks) AS key_text FROM f) GROUP BY key_text")


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = tells(spark, sf_dir).withColumn("_told", X.chosen(X.coverages(F.col("text"))))
    return told.select("doc_id", "truth", F.col("_told.code").alias("language"), F.col("_told.source").alias("language_source"))


add("lang_detect", lang_detect, f"{O.detection()} SELECT doc_id, truth, language, language_source FROM det")
add("lang_confusion", lambda spark, sf_dir: lang_detect(spark, sf_dir).groupBy("truth", "language").agg(F.count(F.lit(1)).alias("n")), f"{O.detection()} SELECT truth, language, count(*) AS n FROM det GROUP BY ALL")
add("windowed_ttr", _of({"windowed_ttr": lambda: F.col("windowed_ttr")}), f"""WITH {O.tells()}, w AS (SELECT doc_id, regexp_extract_all(lower(t), {O.s(O.R.WORD)}) AS ws FROM tells),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i, len(ws) // 200 AS k FROM w),
d AS (SELECT doc_id, i // 200 AS b, count(DISTINCT w) / 200.0::DOUBLE AS share FROM p WHERE i // 200 < k GROUP BY ALL)
SELECT doc_id, CASE WHEN count(share) > 0 THEN round_even(list_reduce(list(share ORDER BY b), lambda x, y: x + y) / count(share), 3) END AS windowed_ttr FROM w LEFT JOIN d USING (doc_id) GROUP BY doc_id""")


def line_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tells(spark, sf_dir).select("doc_id", F.explode(X.lines(X.normalised(F.col("text")))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").rlike(X.STRUCTURAL)).alias("n_structural"))


add("line_structure", line_structure, f"WITH {O.tells()}, x AS (SELECT doc_id, unnest({O.LINES}) AS line FROM tells) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, {O.s(O.STRUCTURAL)})) AS n_structural FROM x GROUP BY doc_id")


def prose_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.score_prose(tells(spark, sf_dir).select("doc_id", "text")).select("doc_id", "words", "score_per_1k", "verdict", "language", "language_source")


add("prose_score", prose_score)
add("prose_record", lambda spark, sf_dir: prose.score_prose(tells(spark, sf_dir)).drop("text"))
add("strip_markdown", lambda spark, sf_dir: tells(spark, sf_dir).select("doc_id", F.length(X.without_code(F.concat(F.col("text"), F.lit("\n```\ncode\n```\nand `x`")))).alias("n_chars")), f"WITH {O.tells()} SELECT doc_id, length(t) + length(chr(10) || chr(10) || chr(10) || chr(10) || 'and `x`') AS n_chars FROM tells")

_FR = f"{O.features(packs()['fr'])}, sc AS (SELECT *, {O.SCORE} AS score_per_1k FROM f), v AS (SELECT *, {O.VERDICT} AS verdict FROM sc)"


def _french(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.with_features(tells(spark, sf_dir), lang="fr")


def verdict_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are counted by source and verdict first, so the roll-up's copies of its rows stand above that, not above the score."""
    counted = _french(spark, sf_dir).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("score_per_1k").alias("highest"))
    return counted.rollup("source", "verdict").agg(F.sum("n").alias("n"), F.max("highest").alias("highest"))


add("verdict_by_source", verdict_by_source, f"{_FR} SELECT source, verdict, count(*) AS n, max(score_per_1k) AS highest FROM v GROUP BY ROLLUP (source, verdict)")
add("exit_status", lambda spark, sf_dir: findings.exit_status(_french(spark, sf_dir)), f"{_FR} SELECT max((score_per_1k >= 10)::INT) AS exit_status FROM v")
add("verdict_lines", lambda spark, sf_dir: findings.verdict_line(_french(spark, sf_dir), "source"), f"{_FR} SELECT source || ': words: ' || words || '   AI-tell score: ' || score_per_1k || '/1k   -> ' || verdict AS value FROM v")
add("topk_docs", lambda spark, sf_dir: _french(spark, sf_dir).select("doc_id", "score_per_1k").orderBy(F.desc("score_per_1k"), "doc_id").limit(25), f"{_FR} SELECT doc_id, score_per_1k FROM v ORDER BY score_per_1k DESC, doc_id LIMIT 25")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.findings(tells(spark, sf_dir), "doc_id", lang="en")


add("finding_lines", lambda spark, sf_dir: findings.finding_table(_found(spark, sf_dir), "doc_id"))
add("rdjson_lines", lambda spark, sf_dir: findings.diagnostics(_found(spark, sf_dir), "doc_id"))
add("parsed_diagnostics", lambda spark, sf_dir: findings.parse_diagnostics(findings.diagnostics(_found(spark, sf_dir), "doc_id")))
add("reports", lambda spark, sf_dir: findings.report(prose.with_features(tells(spark, sf_dir), lang="en"), _found(spark, sf_dir), "doc_id"))
for _name, _query in (("finding_lines", lambda rows: findings.finding_table(rows, "doc_id")), ("rdjson_lines", lambda rows: findings.diagnostics(rows, "doc_id")), ("parsed_diagnostics", lambda rows: findings.parse_diagnostics(findings.diagnostics(rows, "doc_id")))):
    add(f"{_name}_fr", lambda spark, sf_dir, q=_query: q(findings.findings(tells(spark, sf_dir), "doc_id", lang="fr")), O.findings(packs()["fr"], _name))
add("finding_counts", lambda spark, sf_dir: _found(spark, sf_dir).where("category IN ('buzzword', 'phrase', 'copula', 'scope')").groupBy("category", "key_text").agg(F.count(F.lit(1)).alias("n")), f"{O.features(packs()['en'])}, u AS (SELECT unnest(ks) AS key_text FROM f), k(category, key_text) AS (VALUES {', '.join(f'({O.s(kind)}, {O.s(w)})' for kind, ws in O.pool(packs()['en']) for w in ws)}) SELECT category, key_text, count(*) AS n FROM u JOIN (SELECT key_text, min(category) AS category FROM k GROUP BY key_text) USING (key_text) GROUP BY ALL")

_GLOBS = ["*/about*", "*.html", "http://*1*"]


def ignore_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.without_ignored(readers.table(spark, sf_dir, "pages").select("page_id", "url"), "url", _GLOBS)


add("ignore_anti_join", ignore_anti_join, "SELECT page_id, url FROM pages WHERE NOT (" + " OR ".join(f"url GLOB {O.s(g)} OR regexp_extract(url, '[^/]*$') GLOB {O.s(g)}" for g in _GLOBS) + ")")

_CONFIG = {"ignore_words": ["DELVE", "robust"], "extra_words": ["the", "gizmo", "Gizmo"], "ignore_phrases": [], "extra_phrases": ["of the"], "extra_patterns": [{"regex": r"\bthe\b", "weight": 2}]}


def lexicon(spark: SparkSession, codes: list[str] | None = None) -> DataFrame:
    """The four lists of packs as a table ``needle_id, pack, kind, needle``, each needle under the first list that has it."""
    rows = [(p.code, kind, w) for p in packs().values() if codes is None or p.code in codes for kind in O.KINDS for w in X.of_kind(p, kind)]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "needle_id int, pack string, kind string, needle string")


def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every needle of the English lists, overlapping ones included."""
    found = needles.needle_hits(tells(spark, sf_dir), lexicon(spark, ["en"]).select("needle_id", "needle"))
    return found.select("doc_id", "needle_id", "start", "end", "line")


add("lexicon_hits", lexicon_hits, O.lexicon_hits(packs()["en"]))


def swept_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all packs at once: hits of each pack are swept as its alternation would find them, and counted."""
    listed = lexicon(spark)
    found = needles.needle_hits(tells(spark, sf_dir), listed.select("needle_id", "needle")).join(F.broadcast(listed), "needle_id")
    return spans.swept(found, ["doc_id", "pack"]).groupBy("pack", "kind", F.col("needle").alias("key_text")).agg(F.count(F.lit(1)).alias("n"))


add("swept_pools", swept_pools, O.swept_pools())


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon that grows with its table: all words of eight letters and more in the benchmark, in all documents."""
    words = readers.table(spark, sf_dir, "benchmark").select(F.explode(X.found(F.lower("text"), r"(?U)[\p{L}\p{N}_]{8,}")).alias("needle")).distinct()
    found = needles.needle_hits(readers.table(spark, sf_dir, "documents"), words, needle_id="needle")
    return found.groupBy(F.col("needle").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


add("benchmark_words", benchmark_words, r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{8,}')) AS word FROM benchmark),
d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM d JOIN w USING (word) GROUP BY word""")


def config_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's words as tables: the English buzzwords and all event types, without what a role of a conversation is called, and how
    often documents have each."""
    own = lexicon(spark, ["en"]).where("kind = 'buzzword'")
    types = readers.table(spark, sf_dir, "events").select(F.initcap("event_type").alias("needle")).union(spark.createDataFrame([(x,) for x in _CONFIG["extra_words"]], "needle string"))
    ignored = readers.table(spark, sf_dir, "conversations").select(F.upper("role").alias("needle")).union(spark.createDataFrame([(x,) for x in _CONFIG["ignore_words"]], "needle string"))
    words = needles.configured(own, ignored, types)
    found = needles.needle_hits(tells(spark, sf_dir), words, needle_id="needle").groupBy("needle").agg(F.count(F.lit(1)).alias("n"))
    return words.join(found, "needle", "left").select(F.col("needle").alias("word"), F.coalesce("n", F.lit(0)).alias("n"))


add("config_union", config_union, O.config_union(packs()["en"], _CONFIG))
_OWN = configured(packs()["en"], _CONFIG)
_OWN_PATTERNS = [x for x in _OWN.patterns if x not in packs()["en"].patterns]


def configured_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = prose.with_features(readers.spread(readers.table(spark, sf_dir, "documents").select("doc_id", "text")), lang="en", config=_CONFIG)
    own = F.filter("patterns", lambda p: p["name"].isin(*[x.name for x in _OWN_PATTERNS]))
    return scored.select("doc_id", _n("buzzwords").alias("n_buzz"), _n("phrases").alias("n_phrase"), X.total(F.transform(own, lambda p: p["n"])).cast("long").alias("n_own_patterns"))


add("configured_hits", configured_hits, f"""WITH n AS (SELECT doc_id, replace(regexp_replace(coalesce(text, ''), '\\r\\n?|[\\x1c-\\x1f\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(65279), ' ') AS t FROM documents),
low AS (SELECT doc_id, t, replace(lower(t), '’', '''') AS l FROM n), a AS (SELECT doc_id, t, {O.keys(_OWN)} AS ks FROM low)
SELECT doc_id, {O.of_kind('ks', _OWN, 'buzzword')} AS n_buzz, {O.of_kind('ks', _OWN, 'phrase')} AS n_phrase, {' + '.join(O.pattern(x) for x in _OWN_PATTERNS)} AS n_own_patterns FROM a""")


def conversation_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = readers.table(spark, sf_dir, "conversations").withColumn("w", X.word_count(X.normalised(F.col("text"))))
    return told.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("words"), F.max("w").alias("longest"))


add("conversation_by_role", conversation_by_role, f"SELECT role, count(*) AS n, sum(w) AS words, max(w) AS longest FROM (SELECT role, greatest({O.count('coalesce(text, chr(32))', O.R.WORD)}, 1) AS w FROM conversations) GROUP BY role")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _french(spark, sf_dir).select("doc_id", "score_per_1k").join(readers.table(spark, sf_dir, "labels"), "doc_id")


add("label_auc", lambda spark, sf_dir: evaluate.auc(_labelled(spark, sf_dir), "score_per_1k", "quality"), f"{_FR}, x AS (SELECT score_per_1k AS s, quality AS q FROM v JOIN labels USING (doc_id)) SELECT round_even(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END), 6) AS auc FROM x p, x n WHERE p.q = 1 AND n.q = 0")
_RATES = ["n_positive", "n_negative", "mean_positive", "mean_negative", "median_positive", "median_negative", "max_negative", "detection_10", "detection_25", "false_positive_10", "false_positive_25"]
add(
    "eval_rates",
    lambda spark, sf_dir: evaluate.summary(_labelled(spark, sf_dir), "score_per_1k", "quality").select(*_RATES),
    f"""{_FR}, x AS (SELECT score_per_1k AS s, quality AS q FROM v JOIN labels USING (doc_id)) SELECT count(*) FILTER (WHERE q = 1) AS n_positive, count(*) FILTER (WHERE q = 0) AS n_negative, round_even(avg(s) FILTER (WHERE q = 1), 6) AS mean_positive, round_even(avg(s) FILTER (WHERE q = 0), 6) AS mean_negative,
list_sort(list(s) FILTER (WHERE q = 1))[count(*) FILTER (WHERE q = 1) // 2 + 1] AS median_positive, list_sort(list(s) FILTER (WHERE q = 0))[count(*) FILTER (WHERE q = 0) // 2 + 1] AS median_negative, max(s) FILTER (WHERE q = 0) AS max_negative,
round_even(avg((s >= 10)::INT) FILTER (WHERE q = 1), 6) AS detection_10, round_even(avg((s >= 25)::INT) FILTER (WHERE q = 1), 6) AS detection_25, round_even(avg((s >= 10)::INT) FILTER (WHERE q = 0), 6) AS false_positive_10, round_even(avg((s >= 25)::INT) FILTER (WHERE q = 0), 6) AS false_positive_25 FROM x""",
)


def eval_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from counts of runs, a run for each source, that are added up."""
    labelled = _french(spark, sf_dir).select("doc_id", "source", "score_per_1k").join(readers.table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.summary_of(evaluate.merged(evaluate.score_counts(labelled, "score_per_1k", "toxic", "source"))).select(*_RATES)


add("eval_merged", eval_merged, SQL["eval_rates"].replace("quality AS q", "toxic AS q"))


def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which floors the scores miss."""
    told = evaluate.failures(evaluate.summary(_labelled(spark, sf_dir), "score_per_1k", "quality"), evaluate.PROSE_FLOORS)
    return told.select("n_positive", "n_negative", "auc", F.array_join("floor_failures", ",").alias("missed"))


add(
    "eval_failures",
    eval_failures,
    f"""{_FR}, x AS (SELECT score_per_1k AS s, quality AS q FROM v JOIN labels USING (doc_id)), r AS (SELECT count(*) FILTER (WHERE q = 1) AS n_positive, count(*) FILTER (WHERE q = 0) AS n_negative,
round_even(avg((s >= 10)::INT) FILTER (WHERE q = 1), 6) AS d, round_even(avg((s >= 10)::INT) FILTER (WHERE q = 0), 6) AS f10, round_even(avg((s >= 25)::INT) FILTER (WHERE q = 0), 6) AS f25 FROM x),
u AS (SELECT round_even(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END), 6) AS auc FROM x p, x n WHERE p.q = 1 AND n.q = 0)
SELECT n_positive, n_negative, auc, concat_ws(',', CASE WHEN auc < {evaluate.PROSE_FLOORS['auc']} THEN 'auc' END, CASE WHEN d < {evaluate.PROSE_FLOORS['detection_10']} THEN 'detection_10' END,
CASE WHEN f10 > {evaluate.PROSE_FLOORS['false_positive_10']} THEN 'false_positive_10' END, CASE WHEN f25 > {evaluate.PROSE_FLOORS['false_positive_25']} THEN 'false_positive_25' END) AS missed FROM r, u""",
)



# --- code ----------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as source files, each with a line or two of planted code below it."""
    planted = F.element_at(F.array(*[F.lit(x) for x in _CODE]), (F.pmod("page_id", F.lit(len(_CODE))) + 1).cast("int"))
    return readers.spread(readers.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("\n"), planted).alias("text"), F.lit(".html").alias("ext"))


_CODE = [
    "<!-- Step 1: load the page -->\n<p>a</p>",
    "<script>console.error('Something went wrong')</script>",
    "<script>console.log('Saved successfully'); print(\"ok successfully\")</script>",
    "<script>try { f() } catch (e) { console.log(e) }</script>\n<!-- Replace with your key -->",
    "<p>plain</p>",
]
_HTML = r"<!--(?s:.*?)-->|<!--(?s:.*)|\"(?:\\(?s:.)|[^\"\\\n])*\"|'(?:\\(?s:.)|[^'\\\n])*'"
_HTML = _HTML.replace('\\"', '"')
_PLANTED = "coalesce(html, '') || chr(10) || [" + ", ".join(O.s(x) for x in _CODE) + f"][(page_id % {len(_CODE)} + {len(_CODE)}) % {len(_CODE)} + 1]"
_PAGES = f"WITH pg AS (SELECT page_id, regexp_replace({_PLANTED}, '\\r\\n?|[\\x1c-\\x1f\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g') AS t FROM pages), m AS (SELECT page_id, t, regexp_extract_all(t, {O.s(_HTML)}) AS ms FROM pg)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.with_evidence(_pages(spark, sf_dir))


add("html_comments", lambda spark, sf_dir: _evidence(spark, sf_dir).select("page_id", F.size("_comments").alias("n_comments"), F.size("_strings").alias("n_strings"), "lines"), f"{_PAGES} SELECT page_id, len(list_filter(ms, lambda x: x[1:4] = '<!--')) AS n_comments, len(list_filter(ms, lambda x: x[1:4] <> '<!--')) AS n_strings, length(t) - length(replace(t, chr(10), '')) + 1 AS lines FROM m")
for _name, _rx in (("error_boilerplate", code.ERRORS), ("success_boilerplate", code.SUCCESSES), ("swallowed_errors", code.SWALLOWED)):
    add(_name, lambda spark, sf_dir, c=_name: _evidence(spark, sf_dir).select("page_id", F.size(c).alias("n")), f"{_PAGES} SELECT page_id, {O.count('t', O.spaced(_rx).replace('[^' + O.SPACES, '[^'))} AS n FROM pg")
add("code_score", lambda spark, sf_dir: code.score_code(_pages(spark, sf_dir)).select("page_id", "lines", "sloc", "comment_lines", "comment_share", "score_per_100", "verdict"))
add("code_record", lambda spark, sf_dir: code.score_code(_pages(spark, sf_dir)).drop("text"))
add("code_redundant", lambda spark, sf_dir: _evidence(spark, sf_dir).select("page_id", F.size("redundant_comments").alias("n_redundant"), "narration_comment_count", "corroborated"))


#: Extension, mark of a line comment, planted lines, and what they hold: comments, strings, docstrings, lines of code, of comments,
#: restated comments and echoing docstrings, all worked out by hand.
_FILES = [
    (".py", "#", 'def get_user_name(x):\n    """Get the user name."""\n    # increment the user counter\n    user_counter += 1\n    y = "a # b"\n\n\n\n', (1, 1, 1, 3, 1, 1, 1)),
    (".sh", "#", "echo ${#x} 'a # b'\ncat <<EOF\n# not a comment\nEOF\n# sum up the total price\ntotal_price=$((1 << 2))\n\n\n\n", (1, 2, 0, 4, 1, 0, 0)),
    (".ts", "//", "const s = `a ${b + `//c`} d`; // first one\n/* two\nlines */\n// load user names\nuserNames = load('x // y');\n\n\n\n", (3, 2, 0, 2, 4, 1, 0)),
    (".rs", "//", "/* a /* b */ c */ let x: &'a str = \"// no\";\n// sum of the item prices\nlet item_prices = sum();\n\n\n\n", (2, 1, 0, 2, 2, 1, 0)),
    (".php", "//", "$a = <<<HTML\n// no\n  HTML;\n# yes\n$user_total = 'it';\n\n\n\n", (1, 2, 0, 3, 1, 0, 0)),
    (".sql", "--", "select 'a -- b' /* note */ from t;\n-- total of user orders\nselect total_orders;\n\n\n\n", (2, 1, 0, 2, 2, 1, 0)),
    (".lua", "--", "--[[ long\nnote ]] x = 'a'\nlocal y = \"--\"\n\n\n\n", (1, 2, 0, 2, 2, 0, 0)),
]
_COUNTS = ["n_comments", "n_strings", "n_docstrings", "sloc", "comment_lines", "n_redundant", "n_echoes"]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each document, of one of seven families: planted lines and the document in line comments below them."""
    docs = readers.spread(readers.table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = spark.createDataFrame([(i, ext, mark, body) for i, (ext, mark, body, _) in enumerate(_FILES)], "_i long, ext string, _mark string, _body string")
    own = docs.join(F.broadcast(rows), F.pmod("doc_id", F.lit(len(_FILES))) == F.col("_i"))
    said = F.concat("_mark", F.lit(" "), F.regexp_replace(X.source(F.col("text")), "\n", F.concat(F.lit("\n"), "_mark", F.lit(" "))))
    return own.select("doc_id", "ext", F.concat("_body", said).alias("text"))


_SOURCES_SQL = f"""WITH kinds(i, ext, lines, {', '.join(_COUNTS)}) AS (VALUES {', '.join(f"({i}, {O.s(ext)}, {body.count(chr(10))}, {', '.join(map(str, counts))})" for i, (ext, _, body, counts) in enumerate(_FILES))}),
d AS (SELECT doc_id, kinds.*, length(t) - length(replace(t, chr(10), '')) + 1 AS k FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?|[\\x1c-\\x1f\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g') AS t FROM documents) JOIN kinds ON (doc_id % {len(_FILES)} + {len(_FILES)}) % {len(_FILES)} = i)"""


def source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the code record counts in files of seven families."""
    e = code.with_evidence(sources(spark, sf_dir), lang="en")
    sizes = {"n_comments": "_comments", "n_strings": "_strings", "n_docstrings": "_docstrings", "n_redundant": "redundant_comments", "n_echoes": "docstring_name_echoes"}
    return e.select("doc_id", "ext", "lines", "sloc", "comment_lines", *[F.size(c).alias(n) for n, c in sizes.items()])


add("source_families", source_families, f"{_SOURCES_SQL} SELECT doc_id, ext, lines + k AS lines, n_comments + k AS n_comments, n_strings, n_docstrings, sloc, comment_lines + k AS comment_lines, n_redundant, n_echoes FROM d")


def lexed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexer's table function on the same files: rows by family and kind."""
    return parts.source_rows(sources(spark, sf_dir), "doc_id").groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"))


_FAMILY = ", ".join(f"({O.s(ext)}, {O.s(extensions()[ext][0])})" for ext, *_ in _FILES)
add("lexed_rows", lexed_rows, f"""{_SOURCES_SQL}, fam(ext, family) AS (VALUES {_FAMILY}),
n AS (SELECT family, unnest([{{'kind': 'comment', 'n': n_comments + k}}, {{'kind': 'string', 'n': n_strings}}, {{'kind': 'docstring', 'n': n_docstrings}}, {{'kind': 'code', 'n': sloc}}]) AS r FROM d JOIN fam USING (ext))
SELECT family, r.kind AS kind, sum(r.n)::BIGINT AS n FROM n GROUP BY ALL HAVING sum(r.n) > 0""")


def restated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restated comments and echoing docstrings from the lexer's rows; each file is lexed once."""
    told = restated.restatements(parts.source_rows(sources(spark, sf_dir), "doc_id"), "doc_id")
    return told.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


add("restated_rows", restated_rows, f"{_SOURCES_SQL} SELECT doc_id, 'comment' AS kind, n_redundant::BIGINT AS n FROM d WHERE n_redundant > 0 UNION ALL SELECT doc_id, 'docstring', n_echoes::BIGINT FROM d WHERE n_echoes > 0")


# --- streams -------------------------------------------------------------------------------------------------------

add("event_window_verdicts", stream.window_verdicts)


# --- files and marks -----------------------------------------------------------------------------------------------


def marked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by category. An inner explode would filter on the array first, and so compute all marks once more, below the projection."""
    marks = highlight.with_marks(tells(spark, sf_dir), lang="fr").select("doc_id", F.explode_outer("marks").alias("m")).where("m IS NOT NULL")
    return marks.groupBy("m.category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m.end") - F.col("m.start")).alias("chars"))


def file_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and web pages in one table, each scored as what it is."""
    texts = readers.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id", F.lit(".txt")).alias("path"), "text")
    pages = readers.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("text"))
    mixed = texts.unionByName(pages).withColumn("ext", F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.score_files(mixed, lang="en").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("record").isNull() | F.col("score").isNull()).alias("unscored"))


add("marked_spans", marked_spans)
add("file_modes", file_modes, "SELECT 'prose' AS mode, count(*) AS n, 0 AS unscored FROM benchmark UNION ALL SELECT 'code', count(*), 0 FROM pages")
