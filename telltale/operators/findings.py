"""Findings with their lines, diagnostics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions import features as X
from telltale.functions import regexes as R
from telltale.functions.lexicon import Pack, configured, packs

from .prose import with_features

#: Lines listed with a finding; its count is always complete.
MOST_LINES = 200
_KIND = "struct<category:string,key:string,line:int,weight:int,hint:string>"


def _rows(hits: Column, category: Column, key, weight: Column | int) -> Column:
    return F.transform(hits, lambda h: F.struct(category(h).alias("category") if callable(category) else category.alias("category"), key(h["hit"]).alias("key"), h["line"].alias("line"), F.lit(weight).alias("weight"), F.lit("").alias("hint")).cast(_KIND))


def _of_pack(t: Column, l: Column, pack: Pack) -> Column:
    kinds, taken = [], set()
    for kind, listed in X.pool(pack):
        own = [w for w in listed if w not in taken]
        taken.update(own)
        if own:
            kinds.append((kind, own))

    def category(h: Column) -> Column:
        key = X.key_of(h["hit"])
        out = F.lit(None).cast("string")
        for kind, own in reversed(kinds):
            out = F.when(key.isin(*own), F.lit(kind)).otherwise(out)
        return out

    pool = F.transform(X.located(l, R.needles([w for _, ws in kinds for w in ws])), lambda h: F.struct(category(h).alias("category"), X.key_of(h["hit"]).alias("key"), h["line"].alias("line"), F.when(category(h) == "scope", 2).otherwise(3).alias("weight"), F.lit("").alias("hint")).cast(_KIND))
    parts = [pool, _rows(X.located(l, X.artifact_pattern(pack)), F.lit("artifact"), X.key_of, 10)]
    for p in pack.patterns:
        parts.append(_rows(X.located(t, R.unicode(p.regex)), F.lit("pattern"), lambda _, name=p.name: F.lit(name), p.weight))
    return F.concat(*parts)


def findings(df: DataFrame, key: str, text: str = "text", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """One row for each occurrence: ``key, category, key_text, line, weight``; no shuffle."""
    scored = with_features(df.select(F.col(key).alias("_id"), F.col(text).alias("_source")), "_source", lang, config)
    known = {code: configured(p, config) for code, p in packs().items()}
    if lang and lang != "auto":
        known = {lang: known[lang]}
    told = X.by_language(F.col("language"), {c: _of_pack(F.col("_t"), F.col("_l"), p) for c, p in known.items()}, F.array().cast(f"array<{_KIND}>"))
    return scored.select("_id", "copula_avoidance_scored", F.explode(told).alias("f")).select(F.col("_id").alias(key), "f.category", F.col("f.key").alias("key_text"), "f.line", "f.weight", "copula_avoidance_scored")


def finding_table(rows: DataFrame, key: str) -> DataFrame:
    """``key, category, key_text, n, lines``: the count of each finding and the first lines it is on."""
    counted = rows.groupBy(key, "category", "key_text").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("line")).alias("lines"))
    return counted.withColumn("lines", F.slice("lines", 1, MOST_LINES))


def diagnostics(rows: DataFrame, path: str) -> DataFrame:
    """A line of JSON for each finding, as review tools read them: column ``value``."""
    severity = F.when(F.col("category") == "artifact", "ERROR").when((F.col("category") == "pattern") & (F.col("weight") == 0), "INFO").when((F.col("category") == "copula") & ~F.col("copula_avoidance_scored"), "INFO").otherwise("WARNING")
    body = F.struct(F.concat_ws(": ", "category", "key_text").alias("message"), F.struct(F.col(path).cast("string").alias("path"), F.struct(F.struct(F.greatest("line", F.lit(1)).alias("line")).alias("start")).alias("range")).alias("location"), severity.alias("severity"))
    return rows.select(F.to_json(body).alias("value"))


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """``path, line, type, text`` from diagnostics; lines that aren't valid are left out."""
    schema = "message string, location struct<path:string,range:struct<start:struct<line:int>>>, severity string"
    told = lines.select(F.from_json("value", schema).alias("d")).where("d.message IS NOT NULL")
    letter = F.when(F.col("d.severity") == "ERROR", "E").when(F.col("d.severity") == "INFO", "I").otherwise("W")
    return told.select("d.location.path", F.col("d.location.range.start.line").alias("line"), letter.alias("type"), F.col("d.message").alias("text"))


def verdict_line(scored: DataFrame, path: str | None = None, carried: list[Column | str] | None = None) -> DataFrame:
    """One line for each text, ``value``, after the columns ``carried``."""
    line = F.format_string("words: %d   AI-tell score: %s/1k   -> %s", "words", F.col("score_per_1k").cast("string"), "verdict")
    return scored.select(*(carried or []), F.concat(F.concat(F.col(path), F.lit(": ")), line).alias("value") if path else line.alias("value"))


def report(scored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A readable report of each text, as lines of one string: ``key, report``."""
    shown = F.array_join(F.transform(F.slice("lines", 1, 5), lambda x: x.cast("string")), ", ")
    each = finding_table(rows, key).withColumn("_line", F.format_string("  %2dx  %s: %s (lines %s)", "n", "category", "key_text", shown))
    found = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("_line").alias("line")))), lambda x: x["line"]).alias("_lines"))
    when = lambda test, *parts: F.when(test, F.concat(F.lit("  - "), *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    c, s = F.col, lambda name: F.col(name).cast("string")
    notes = F.array_compact(F.array(
        when(c("em_dash_excess") > 0, s("em_dashes"), " em dashes are many for the length"),
        when(c("emoji") > 0, s("emoji"), " emoji"), when(c("header_emoji") > 0, s("header_emoji"), " emoji in headings or bullets"),
        when(c("sentence_uniformity_cv") < 0.35, "sentences of very even length (", s("sentence_uniformity_cv"), ")"),
        when(c("paragraph_uniformity_cv") < 0.25, "paragraphs of very even length (", s("paragraph_uniformity_cv"), ")"),
        when(c("staccato_runs") > 0, s("staccato_runs"), " runs of tiny sentences"), when(c("quote_mix") > 0, "curly and straight quotes mixed"),
        when(c("question_hook_excess") > 0, s("question_hooks"), " question hooks"), when(c("connective_excess") > 0, s("connective_openers"), " sentences open on a connective"),
        when(c("bold_label_bullets") >= 3, s("bold_label_bullets"), " bold label bullets"), when(c("bold_inline_excess") > 0, s("bold_inline"), " bold spans in running text"),
        when(c("opener_top_share") >= 0.4, "many sentences open with the same word (not scored)"), when(c("generic_headings") >= 2, s("generic_headings"), " generic headings"),
        when(c("bare_bullets") > 0, s("bare_bullets"), " bare bullet glyphs"), when(c("punct_entropy_low"), "few kinds of punctuation (", s("punct_entropy"), ")"),
        when(c("paragraph_opener_repeat") > 0, s("paragraph_opener_repeat"), " paragraphs open alike"), when(c("density_crutch_excess") > 0, s("density_crutch"), " uses of a crutch word"),
        when(c("heading_level_skips") > 0, s("heading_level_skips"), " heading levels skipped (not scored)"),
    ))
    head = F.format_string("words: %d   AI-tell score: %s/1k   -> %s", "words", s("score_per_1k"), "verdict")
    joined = scored.withColumns({"_notes": notes, "_head": head}).join(found, key, "left")
    body = F.concat(F.coalesce("_lines", F.array().cast("array<string>")), F.col("_notes"))
    return joined.select(key, F.concat(F.col("_head"), F.lit("\n"), F.when(F.size(body) == 0, "Nothing flagged.").otherwise(F.array_join(body, "\n"))).alias("report"))


def exit_status(scored: DataFrame, threshold: float = 10.0, score: str = "score_per_1k") -> DataFrame:
    """One row: 1 if any text reaches the threshold, else 0."""
    return scored.agg(F.coalesce(F.max((F.col(score) >= threshold).cast("int")), F.lit(0)).alias("exit_status"))
