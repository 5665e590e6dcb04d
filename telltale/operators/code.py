"""The code score: files are lexed in Arrow batches; what their comments and code say is matched in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions import code_parts as C
from telltale.functions import features as X
from telltale.functions import regexes as R
from telltale.functions.lexicon import ARTIFACT_PHRASES, ARTIFACTS, Pack, configured, packs
from telltale.functions.restated import echoes, redundant

#: Chat residue in comments.
RESIDUE = [
    "as an ai language model", "as an ai model", "as an ai assistant", "certainly! here", "here's the updated code", "here is the updated code",
    "here's the complete code", "here is the complete code", "here's the full code", "i hope this helps", "hope this helps",
]
#: The explainer's voice in comments.
EXPLAINING = [
    "in a real application", "in a real-world application", "in a real app", "in production, you would", "in a production environment",
    "for demonstration purposes", "for the sake of simplicity", "for simplicity, we", "this is a simplified", "you can customize",
    "you can modify", "you can adjust", "you can extend", "adjust as needed", "modify as needed", "customize as needed",
    "adjust this as needed", "change as needed", "replace with your", "replace this with your", "replace these with your", "add your own",
    "your actual api key", "insert your api key", "add your api key", "replace with the actual", "import the necessary",
    "import necessary", "necessary imports", "the following code", "the code below", "the above code",
    "this function is responsible for", "main entry point", "entry point of the", "example usage", "usage example", "sample usage",
]
#: Words that are ordinary in code.
ORDINARY = ["underscore", "underscores"]
#: Constructions in comments, with the hits that are free and whether they need other evidence.
CONSTRUCTIONS = [
    ("numbered steps", r"(?mi)^(?:step\s*\d+|\d+[.)])\s*:?\s+[a-z]", 1, True),
    ("first next then", r"(?mi)^(?:first|next|then|now|finally)\b,?\s+(?:we|let's|you)\b", 1, True),
    ("here we", r"(?mi)^here,?\s+we\b", 1, True),
    ("placeholder path", r"(?i)\bpath/to/your\b", 0, False),
]
#: Characters that editors don't type, and their points.
TYPOGRAPHY = [("em dash", "—", 2), ("curly quote", "‘’“”", 2), ("arrow", "→⇒", 1), ("ellipsis", "…", 1)]
#: Boilerplate in the whole file.
TRUNCATED = (
    r"(?i)(?:\.\.\.\s*\(?\s*rest of (?:the|your) (?:code|file|function|class|script|implementation)\b"
    r"|\brest of (?:the|your) (?:code|file|function|class|script|implementation) (?:remains|stays|is) (?:the same|unchanged)\b"
    r"|\.\.\.\s*existing code|\bexisting code (?:remains|stays|goes here)\b|\byour (?:code|implementation|logic) goes here\b)"
)
ERRORS = (
    r"(?i)(?:print\s*\(|console\.(?:log|error|warn)\s*\(|System\.(?:out|err)\.println\s*\(|fmt\.Println\s*\(|echo\s+|logger?\.(?:error|info|warning)\s*\(|eprintln!\s*\(|puts\s+)"
    r"\s*f?[\"'`](?:an (?:unexpected )?error occurred|error occurred|something went wrong|an error has occurred|oops[,!]|error:\s*\{)"
)
SUCCESSES = r"(?i)(?:print\s*\(|console\.log\s*\(|System\.out\.println\s*\(|fmt\.Println\s*\(|echo\s)[^\n]{0,60}?successfully"
SWALLOWED = r"(?m)^[ \t]*except Exception as e:\s*\n[ \t]*print\s*\(|catch\s*\(\s*(?:error|err|e|ex|exception)\s*(?::[^)]*)?\)\s*\{\s*\n?\s*console\.(?:log|error)\s*\("
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
VERDICTS = ("looks human-written", "some AI tells - worth a look", "reads as AI-written code")

_PLACED = "array<struct<line:int,text:string>>"


def _places(hits: Column, lines: Column) -> Column:
    return F.transform(hits, lambda h: F.coalesce(F.get(lines, h["line"] - 1), F.lit(1)))


def _listed(pack: Pack) -> list[tuple[str, list[str]]]:
    return [("buzzwords", [w for w in pack.buzzwords if w not in ORDINARY]), ("phrases", pack.phrases), ("comment_phrases", EXPLAINING)]


def _pool_pattern(pack: Pack) -> str:
    return R.needles([w for _, ws in _listed(pack) for w in ws])


def _kind_pattern(pack: Pack, kind: str) -> str:
    taken: set[str] = set()
    for name, words in _listed(pack):
        own = [w for w in words if w not in taken]
        taken.update(own)
        if name == kind:
            return f"^{R.needles(own)}$"
    raise KeyError(kind)


def with_evidence(df: DataFrame, text: str = "text", extension: str = "ext", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """Adds the columns of the code record to ``df``; no shuffle. Null is an empty file of an unknown language."""
    from .prose import _language, _tally

    known = {code: configured(p, config) for code, p in packs().items()}
    step = df.withColumn("_t", X.source(F.col(text))).withColumn("_kind", C.family_and_language(F.col("_t"), F.col(extension)))
    step = step.withColumn("_e", C.lexed(F.col("_t"), F.col("_kind.family"))).withColumns({"_parts": F.col("_e.parts"), "_code": F.col("_e.code"), "_family": F.col("_kind.family")})
    parts = F.col("_parts")
    step = step.withColumns({"_of_comments": C.of_kind(parts, "comment"), "_said": C.said(parts), "_in_body": C.in_body(parts), "_rows": F.split("_code", "\n", -1)})
    comments = F.col("_of_comments")
    step = step.withColumns({
        "code_language": F.col("_kind.language"), "lines": X.occurrences(F.col("_t"), "\n") + 1, "sloc": F.size(C.visible(F.col("_rows"))), "comment_lines": C.commented_lines(comments),
        "_prose": C.unquoted(F.col("_said")), "_prose_lines": F.transform("_said", lambda x: x["line"]), "_strings": F.transform(C.of_kind(parts, "string"), lambda p: p["text"]),
        "_fences": F.transform(F.filter(comments, lambda p: F.contains(p["text"], F.lit("```"))), lambda p: p["line"]), "_comments": C.placed(comments), "_docstrings": C.placed(C.of_kind(parts, "docstring")),
        "_narrated": C.placed(C.narrated(F.col("_in_body"))), "_body_comments": F.size("_in_body"),
    })
    step = step.withColumns({
        "comment_sentence_share": C.sentence_share(comments), "docstring_coverage": C.docstring_coverage(F.col("_docstrings"), F.col("_code"), F.col("_family")), "banner_comments": C.banners(comments),
        "line_length_cv": X.variation(F.transform(C.visible(F.col("_rows")), lambda x: F.length(x)), 30), "generic_identifier_share": C.generic_share(F.col("_code")),
    }).drop("_e", "_kind", "_parts", "_of_comments", "_said", "_in_body")
    p, t, code = F.col("_prose"), F.col("_t"), F.col("_code")
    step = step.withColumns({"_l": X.lowered(p), "_told": _language(p, lang)})
    name, l = F.col("_told.code"), F.col("_l")
    in_strings = X.occurrences(F.array_join("_strings", "\n"), INVISIBLE)
    wordy = F.filter("_strings", lambda s: s.rlike("[A-Za-z]{3}"))
    plain = [X.count(x, R.quoted(a)) for a in ARTIFACTS for x in (F.lower(code), l)]
    step = step.withColumns({
        "language": name, "language_source": F.col("_told.source"), "words": X.count(p, R.WORD),
        "_keys": F.transform(X.found(l, X.pattern_of(name, known, _pool_pattern)), X.key_of),
        "invisible_chars": X.occurrences(t, INVISIBLE), "_inv": F.greatest(F.lit(0), X.occurrences(t, INVISIBLE) - in_strings),
        "_residue": sum(plain[1:], plain[0]) + sum((X.count(l, R.needles([w])) for w in [*ARTIFACT_PHRASES, *RESIDUE]), F.lit(0)) + X.count(p, R.unicode(TRUNCATED)) + F.size("_fences"),
        "comment_patterns": F.filter(F.array(*[F.struct(F.lit(n).alias("name"), X.count(p, R.unicode(rx)).alias("n"), F.lit(free).alias("free"), F.lit(gated).alias("gated")) for n, rx, free, gated in CONSTRUCTIONS]), lambda x: x["n"] > 0),
        "typography": F.filter(F.array(*[F.struct(F.lit(n).alias("name"), X.occurrences(p, chars).alias("n"), F.lit(w).alias("weight")) for n, chars, w in TYPOGRAPHY]), lambda x: x["n"] > 0),
        "emoji": X.emoji(p) + X.emoji(code) + X.total(F.transform(wordy, X.emoji)),
        "error_boilerplate": F.transform(X.located(t, R.unicode(ERRORS)), lambda h: h["line"]), "success_boilerplate": F.transform(X.located(t, R.unicode(SUCCESSES)), lambda h: h["line"]),
        "swallowed_errors": F.transform(X.located(t, R.unicode(SWALLOWED)), lambda h: h["line"]),
        "redundant_comments": redundant(F.col("_comments"), F.col("_rows")), "docstring_name_echoes": F.when(F.col("_family") == "hash", echoes(F.col("_docstrings"), F.col("_rows"))).otherwise(F.array().cast(_PLACED)), "narration_comments": F.slice("_narrated", 1, 8), "narration_comment_count": F.size("_narrated"),
        "comment_share": F.bround(F.col("comment_lines") / F.greatest(F.col("sloc") + F.col("comment_lines"), F.lit(1)), 2),
    })
    kinds = ("buzzwords", "phrases", "comment_phrases")
    step = step.withColumns({
        **{k: _tally(X.matching(F.col("_keys"), X.pattern_of(name, known, lambda p, k=k: _kind_pattern(p, k)))) for k in kinds},
        "ai_artifacts": F.col("_residue") + F.when(F.col("_inv") > 0, F.col("invisible_chars")).otherwise(0),
    })
    c, size = F.col, F.size
    others = (c("ai_artifacts") > 0) | (size("typography") > 0) | F.exists("comment_patterns", lambda x: ~x["gated"]) | (c("emoji") > 0)
    for k in (*kinds, "error_boilerplate", "swallowed_errors", "redundant_comments", "docstring_name_echoes"):
        others = others | (size(k) > 0)
    step = step.withColumn("corroborated", others | (size("success_boilerplate") >= 2))
    step = step.withColumn("narration_scored", c("corroborated") & (c("narration_comment_count") >= 4) & (c("narration_comment_count") >= 0.4 * F.greatest(c("_body_comments"), F.lit(1))))
    points = lambda gated: X.total(F.transform(F.filter("comment_patterns", lambda x: x["gated"] == gated), lambda x: 2 * F.greatest(F.lit(0), x["n"] - x["free"])))
    beyond = lambda k: F.greatest(F.lit(0), size(k) - 1)
    raw = (
        3 * sum((X.total(F.transform(c(k), lambda r: r["n"])) for k in kinds), F.lit(0)) + points(False) + F.when(c("corroborated"), points(True)).otherwise(0)
        + X.total(F.transform("typography", lambda x: x["n"] * x["weight"])) + 2 * c("emoji") + 3 * size("error_boilerplate") + 2 * beyond("success_boilerplate")
        + 2 * size("swallowed_errors") + 2 * beyond("redundant_comments") + beyond("docstring_name_echoes")
        + F.when(c("narration_scored"), 2 * (c("narration_comment_count") - 3)).otherwise(0) + 10 * c("ai_artifacts")
    )
    score = F.greatest(F.bround(raw * 100.0 / F.greatest(c("sloc"), F.lit(40)), 1), F.when(c("ai_artifacts") > 0, F.lit(25.0)).otherwise(F.lit(0.0)))
    step = step.withColumn("score_per_100", score)
    return step.withColumns({"mode": F.lit("code"), "verdict": F.when(c("score_per_100") >= 25, VERDICTS[2]).when(c("score_per_100") >= 10, VERDICTS[1]).otherwise(VERDICTS[0])})


#: The fields of a code record.
FIELDS = [
    "mode", "code_language", "lines", "sloc", "comment_lines", "comment_share", "words", "score_per_100", "verdict", "language", "language_source", "ai_artifacts",
    "buzzwords", "phrases", "comment_patterns", "comment_phrases", "typography", "emoji", "error_boilerplate", "swallowed_errors", "redundant_comments",
    "docstring_name_echoes", "success_boilerplate", "narration_comments", "narration_comment_count", "narration_scored", "corroborated", "invisible_chars",
    "comment_sentence_share", "docstring_coverage", "banner_comments", "line_length_cv", "generic_identifier_share",
]


def score_code(df: DataFrame, text: str = "text", extension: str = "ext", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """The rows of ``df`` with the fields of their code records."""
    keep = [x for x in df.columns if x not in FIELDS]
    return with_evidence(df, text, extension, lang, config).select(*keep, *FIELDS)


# --- findings, diagnostics, report ----------------------------------------------------------------------------------

_FINDING = "struct<category:string,key:string,line:int,severity:string>"
#: What is said about each category, and in which order a report has them.
SAID = {
    "artifact": "chat residue", "buzzword": "buzzword in a comment", "phrase": "filler in a comment", "explainer": "explainer's voice in a comment",
    "construction": "construction in comments", "typography": "typography of chats in a comment", "error": "stock error message",
    "success": "stock success message", "swallowed": "handler that prints an error and goes on", "redundant": "comment that restates the code",
    "echo": "docstring that restates the name", "narration": "comment that narrates the code",
}


def code_findings(df: DataFrame, key: str, text: str = "text", extension: str = "ext", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """One row for each occurrence: ``key, category, key_text, line, severity``; no shuffle.

    Residue is an error. Constructions that need other evidence, echoes, and narration that isn't scored inform only.
    """
    known = {c: configured(p, config) for c, p in packs().items()}
    if lang and lang != "auto":
        known = {lang: known[lang]}
    e = with_evidence(df.select(F.col(key).alias("_id"), F.col(text).alias("_source"), F.col(extension).alias("_ext")), "_source", "_ext", lang, config)
    c = F.col

    def rows(hits: Column, category: str, key_text=lambda h: h, severity: Column | str = "WARNING") -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.transform(hits, lambda h: F.struct(F.lit(category).alias("category"), key_text(h["hit"]).alias("key"), F.greatest(h["line"], F.lit(1)).alias("line"), level.alias("severity")).cast(_FINDING))

    def said(pattern: Column | str, where: str = "_prose") -> Column:
        """Matches in what comments say, on the lines of the file."""
        return F.transform(X.located(c(where), pattern), lambda h: F.struct(h["hit"].alias("hit"), F.coalesce(F.get("_prose_lines", h["line"] - 1), F.lit(1)).alias("line")))

    def placed(column: str, shown: str) -> Column:
        return F.transform(c(column), lambda r: F.struct(r[shown].alias("hit"), r["line"].alias("line")))

    def numbered(column: str) -> Column:
        return F.transform(c(column), lambda n: F.struct(F.lit("").alias("hit"), n.alias("line")))

    def listed(kind: str) -> Column:
        return F.filter(said(X.pattern_of(c("language"), known, _pool_pattern), "_l"), lambda h: X.count(X.key_of(h["hit"]), X.pattern_of(c("language"), known, lambda p: _kind_pattern(p, kind))) > 0)

    literal = "|".join(R.quoted(a) for a in ARTIFACTS)
    residue = [said("(?s)" + literal, "_l"), X.located(F.lower("_code"), literal), said(R.needles([*ARTIFACT_PHRASES, *RESIDUE]), "_l"), said(R.unicode(TRUNCATED)), F.transform("_fences", lambda n: F.struct(F.lit("```").alias("hit"), n.alias("line")))]
    hidden = F.when(c("_inv") > 0, X.located(c("_t"), "[" + INVISIBLE + "]")).otherwise(F.array().cast("array<struct<hit:string,line:int>>"))
    gated = F.when(c("corroborated"), F.lit("WARNING")).otherwise(F.lit("INFO"))
    parts = [rows(x, "artifact", lambda h: X.key_of(F.lower(h)), "ERROR") for x in residue] + [rows(hidden, "artifact", lambda h: F.concat(F.lit("invisible character U+"), F.lpad(F.hex(F.ascii(h)), 4, "0")), "ERROR")]
    parts += [rows(listed(kind), name, X.key_of) for kind, name in (("buzzwords", "buzzword"), ("phrases", "phrase"), ("comment_phrases", "explainer"))]
    parts += [rows(said(R.unicode(rx)), "construction", lambda h, n=n: F.lit(n), gated if needs else "WARNING") for n, rx, _, needs in CONSTRUCTIONS]
    parts += [rows(said("[" + chars + "]"), "typography", lambda h, n=n: F.lit(n)) for n, chars, _ in TYPOGRAPHY]
    parts += [rows(numbered("error_boilerplate"), "error"), rows(F.when(F.size("success_boilerplate") >= 2, numbered("success_boilerplate")).otherwise(F.array().cast("array<struct<hit:string,line:int>>")), "success", severity="INFO"), rows(numbered("swallowed_errors"), "swallowed")]
    parts += [rows(placed("redundant_comments", "text"), "redundant"), rows(placed("docstring_name_echoes", "text"), "echo", severity="INFO")]
    found = e.select("_id", F.explode(F.concat(*parts)).alias("f"))
    return found.select(F.col("_id").alias(key), "f.category", F.col("f.key").alias("key_text"), "f.line", "f.severity")


def _message(category: Column, key_text: Column) -> Column:
    label = F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in SAID.items()])
    return F.when(key_text == "", label).otherwise(F.concat_ws(": ", label, key_text))


def diagnostics(rows: DataFrame, path: str) -> DataFrame:
    """A line of JSON for each finding that is worth a reviewer's look, as review tools read them: column ``value``."""
    body = F.struct(_message(F.col("category"), F.col("key_text")).alias("message"), F.struct(F.col(path).cast("string").alias("path"), F.struct(F.struct(F.col("line")).alias("start")).alias("range")).alias("location"), "severity")
    return rows.where("category <> 'success'").select(F.to_json(body).alias("value"))


def verdict_line(scored: DataFrame, carried: list[Column | str] | None = None) -> DataFrame:
    line = F.format_string("lines: %d (%d code, %d comment)   AI-tell score: %s/100 lines   -> %s", "lines", "sloc", "comment_lines", F.col("score_per_100").cast("string"), "verdict")
    return scored.select(*(carried or []), line.alias("value"))


def report(scored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A readable report of each file, as lines of one string, given ``with_evidence`` and ``code_findings``: ``key, report``.

    Findings come by category, then what is measured and never scored.
    """
    order = F.coalesce(*[F.when(F.col("category") == k, F.lit(i)) for i, k in enumerate(SAID)])
    counted = rows.groupBy(key, "category", "key_text").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("line")).alias("at"))
    shown = F.array_join(F.transform(F.slice("at", 1, 5), lambda x: x.cast("string")), ", ")
    each = counted.select(key, order.alias("o"), (-F.col("n")).alias("m"), F.format_string("  %2dx  %s (lines %s)", "n", _message(F.col("category"), F.col("key_text")), shown).alias("line"))
    found = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "m", "line"))), lambda x: x["line"]).alias("_lines"))
    when = lambda test, *parts: F.when(test, F.concat(F.lit("  - "), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(" (not scored)")))
    c, percent = F.col, lambda name: F.floor(F.col(name) * 100).cast("string")
    notes = F.array_compact(F.array(
        F.when(c("emoji") > 0, F.concat(F.lit("  - "), c("emoji").cast("string"), F.lit(" emoji in comments or strings"))),
        F.when(c("narration_scored"), F.concat(F.lit("  - "), c("narration_comment_count").cast("string"), F.lit(" comments narrate the code"))),
        when(c("comment_sentence_share") >= 0.8, percent("comment_sentence_share"), "% of the comments are whole sentences"),
        when(c("docstring_coverage") >= 1.0, "every function has a docstring"),
        when((c("comment_share") >= 0.4) & (c("sloc") >= 20), "comments on ", percent("comment_share"), "% of the lines"),
        when(c("banner_comments") >= 3, c("banner_comments").cast("string"), " banners"),
        when(c("line_length_cv") < 0.35, "lines of very even length (", c("line_length_cv").cast("string"), ")"),
        when(c("generic_identifier_share") >= 0.12, percent("generic_identifier_share"), "% of the names could be anything"),
    ))
    told = verdict_line(scored, [F.col(key).alias("_key"), F.concat(F.lit("language: "), "code_language").alias("_language"), notes.alias("_notes")]).join(found.withColumnRenamed(key, "_key"), "_key", "left")
    body = F.concat(F.coalesce("_lines", F.array().cast("array<string>")), F.col("_notes"))
    return told.select(F.col("_key").alias(key), F.concat_ws("\n", "value", "_language", F.when(F.size(body) == 0, "Nothing flagged.").otherwise(F.array_join(body, "\n"))).alias("report"))
