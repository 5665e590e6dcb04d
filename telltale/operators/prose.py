"""The prose score: one narrow projection of each text, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions import features as X
from telltale.functions import regexes as R
from telltale.functions.lexicon import Pack, configured, packs

HARD, SOFT = 25.0, 10.0
VERDICTS = ("looks human", "some AI tells - worth a pass", "reads as AI - needs a real rewrite")


def verdict(score: Column) -> Column:
    return F.when(score >= HARD, VERDICTS[2]).when(score >= SOFT, VERDICTS[1]).otherwise(VERDICTS[0])


def _language(text: Column, lang: str | None) -> Column:
    if lang and lang != "auto":
        if lang not in packs():
            raise ValueError(f"unknown language {lang!r}, choose from {sorted(packs())} or auto")
        return F.struct(F.lit(lang).alias("code"), F.lit("forced").alias("source"))
    return X.chosen(X.coverages(text))


def _patterns(t: Column, pack: Pack) -> Column:
    kind = "struct<name:string,n:int,weight:int,free:int,hint:string>"
    rows = [F.struct(F.lit(p.name).alias("name"), X.count(t, R.unicode(p.regex)).cast("int").alias("n"), F.lit(p.weight).alias("weight"), F.lit(p.free).alias("free"), F.lit(p.hint).alias("hint")).cast(kind) for p in pack.patterns]
    return F.filter(F.array(*rows), lambda p: p["n"] > 0)


def _tally(keys: Column) -> Column:
    """(key, n), most frequent first, ties in the order of the text."""
    rows = F.transform(F.array_distinct(keys), lambda k: F.struct((-F.size(F.filter(keys, lambda x: x == k))).alias("o"), F.array_position(keys, k).alias("p"), k.alias("key")))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["key"].alias("key"), (-r["o"]).cast("int").alias("n")))


def with_features(df: DataFrame, text: str = "text", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """Adds the columns of the prose record to ``df``; columns of the same names are replaced.

    Null counts as the empty text: one word, no finding. Each feature is its own expression, so selecting a few of them
    leaves the others uncomputed. Don't filter on the score before writing or caching: the filter would be pushed below the
    projection and compute it again.
    """
    known = {code: configured(pack, config) for code, pack in packs().items()}
    if lang and lang != "auto":
        known = {lang: known[lang]} if lang in known else _language(F.col(text), lang)
    base = df.withColumns({"_t": X.normalised(F.col(text)), "_told": _language(F.col(text), lang)}).withColumn("_l", X.lowered(F.col("_t")))
    t, l, code = F.col("_t"), F.col("_l"), F.col("_told.code")
    if len(known) > 1 and not df.isStreaming:
        # patterns depend on the language, and are compiled when they change: rows of one come together, within their partition
        base = base.sortWithinPartitions("_told.code")

    def pick(f, default=F.lit(0)) -> Column:
        return X.by_language(code, {c: f(p) for c, p in known.items()}, default)

    def pattern(f) -> Column:
        return X.pattern_of(code, known, f)

    listed = lambda words: F.split(F.lit(" ".join(words)), " ")
    step = base.withColumns({
        "words": X.word_count(t), "language": code, "language_source": F.col("_told.source"),
        "_keys": F.transform(X.found(l, pattern(X.pool_pattern)), X.key_of),
        "patterns": pick(lambda p: _patterns(t, p), F.array().cast("array<struct<name:string,n:int,weight:int,free:int,hint:string>>")),
        "ai_artifacts": X.count(l, pattern(X.artifact_pattern)),
        "em_dashes": X.em_dashes(t), "_factor": pick(lambda p: F.lit(p.em_dash_factor), F.lit(1.0)),
        "emoji": X.emoji(t), "header_emoji": X.header_emoji(t), "bold_label_bullets": X.bold_bullets(t),
        "bold_inline": X.bold_inline(t), "quote_mix": X.quote_mix(t),
        "_lengths": X.lengths(X.sentences(t)), "question_hooks": X.question_hooks(t),
        "connective_openers": X.count(t, pattern(X.connective_pattern)),
        "paragraph_uniformity_cv": X.variation(F.filter(X.lengths(X.paragraphs(t)), lambda n: n > 0)),
        "opener_top_share": X.opener_top_share(t), "generic_headings": X.generic_headings(t), "bare_bullets": X.bare_bullets(t),
        "punct_entropy": X.mark_entropy(t), "heading_level_skips": X.heading_skips(t), "_opener": X.paragraph_openers(t),
        "windowed_ttr": X.windowed_ttr(t), "function_word_ratio": X.function_words(t, pick(lambda p: listed(p.stopwords), listed([]))),
        "density_crutch": X.count(l, pattern(X.crutch_pattern)),
    })
    wc = F.col("words")
    step = step.withColumns({
        **{name: _tally(X.matching(F.col("_keys"), pattern(lambda p, kind=kind: X.kind_pattern(p, kind)))) for name, kind in (("buzzwords", "buzzword"), ("phrases", "phrase"), ("copula_avoidance", "copula"), ("scope_inflation", "scope"))},
        "em_dash_excess": X.em_dash_excess(F.col("em_dashes"), wc, F.col("_factor")), "bold_inline_excess": X.bold_inline_excess(F.col("bold_inline"), wc),
        "sentence_uniformity_cv": X.variation(F.col("_lengths")), "staccato_runs": X.staccato_runs(F.col("_lengths")),
        "question_hook_excess": F.greatest(F.lit(0), F.col("question_hooks") - 1),
        "connective_excess": F.greatest(F.lit(0), F.col("connective_openers") - F.greatest(F.lit(2), F.floor(F.size("_lengths") / 10).cast("int"))),
        "paragraph_opener_repeat": F.coalesce(F.col("_opener.n"), F.lit(0)), "paragraph_opener_repeat_text": F.col("_opener.opener"),
        "punct_entropy_low": F.coalesce(F.col("punct_entropy") < 0.55, F.lit(False)),
        "density_crutch_excess": F.greatest(F.lit(0), F.col("density_crutch") - F.greatest(F.lit(2), F.floor(wc / 150).cast("int"))),
    })
    n = {name: X.total(F.transform(F.col(name), lambda r: r["n"])) for name in ("buzzwords", "phrases", "copula_avoidance", "scope_inflation")}
    step = step.withColumn("copula_avoidance_scored", (n["copula_avoidance"] >= 2) & (n["copula_avoidance"] * 1000.0 / wc >= 2.0))
    c = F.col
    raw = (
        3 * (n["buzzwords"] + n["phrases"])
        + X.total(F.transform(c("patterns"), lambda p: p["weight"] * F.greatest(F.lit(0), p["n"] - p["free"])))
        + 10 * c("ai_artifacts") + c("em_dash_excess") + 2 * c("emoji") + 2 * c("header_emoji")
        + F.when(c("bold_label_bullets") >= 3, 2 * (c("bold_label_bullets") - 2)).otherwise(0)
        + 2 * c("bold_inline_excess") + 2 * c("question_hook_excess")
        + F.when(c("copula_avoidance_scored"), 3 * n["copula_avoidance"]).otherwise(0) + 2 * n["scope_inflation"]
        + 2 * F.greatest(F.lit(0), c("generic_headings") - 1) + 3 * c("bare_bullets") + 2 * c("density_crutch_excess")
    )
    base_score = F.bround(raw * 1000.0 / wc, 1)
    bumps = (
        F.when(c("sentence_uniformity_cv") < 0.35, 8).otherwise(0) + F.when(c("paragraph_uniformity_cv") < 0.25, 4).otherwise(0)
        + F.least(F.greatest(F.lit(0), c("staccato_runs") - 1) * 4, F.lit(8)) + 4 * c("quote_mix")
        + 2 * F.least(c("connective_excess"), F.lit(2)) + F.when(c("punct_entropy_low"), 5).otherwise(0)
        + F.when(c("paragraph_opener_repeat") > 0, 5).otherwise(0)
    )
    floor = F.when(c("ai_artifacts") > 0, F.lit(HARD)).otherwise(F.lit(0.0))
    step = step.withColumn("score_per_1k", F.greatest(base_score + bumps, floor))
    return step.withColumn("verdict", verdict(c("score_per_1k"))).withColumn("mode", F.lit("prose"))


#: The fields of a prose record.
FIELDS = [
    "mode", "words", "score_per_1k", "verdict", "language", "language_source", "buzzwords", "phrases", "patterns", "ai_artifacts",
    "em_dashes", "em_dash_excess", "emoji", "header_emoji", "bold_label_bullets", "bold_inline", "bold_inline_excess", "quote_mix",
    "staccato_runs", "question_hooks", "question_hook_excess", "connective_openers", "connective_excess", "sentence_uniformity_cv",
    "paragraph_uniformity_cv", "opener_top_share", "copula_avoidance", "copula_avoidance_scored", "scope_inflation",
    "generic_headings", "bare_bullets", "punct_entropy", "punct_entropy_low", "heading_level_skips", "paragraph_opener_repeat",
    "paragraph_opener_repeat_text", "windowed_ttr", "function_word_ratio", "density_crutch", "density_crutch_excess",
]


def score_prose(df: DataFrame, text: str = "text", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """The rows of ``df`` with the fields of their prose records."""
    keep = [x for x in df.columns if x not in FIELDS]
    return with_features(df, text, lang, config).select(*keep, *FIELDS)
