"""Features of a text as columns: each is an expression of its own, so what isn't selected is never computed.

All functions take columns. ``t`` is a normalised text (``normalised``), ``l`` its lower-cased form (``lowered``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regexes as R
from .lexicon import ARTIFACT_PHRASES, ARTIFACTS, GENERIC_HEADINGS, MARKS, Pack, packs

Cols = list[Column]
INT = "int"


def lit(pattern: Column | str) -> Column:
    """A pattern: a string, or a column where it depends on the row. Such a column should seldom change from row to row, as
    Spark compiles a pattern anew whenever it does."""
    return pattern if isinstance(pattern, Column) else F.lit(pattern)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


#: Elements or blocks that ``running`` gathers at a time, and levels of blocks.
BLOCK, LEVELS = 48, 2


def running(xs: Column, start: Column, step, kind: str) -> Column:
    """What ``step(state, x)``, a pair of the next state and a value of type ``kind``, gives for each element, in order.

    An aggregate copies its state at each element, what it has gathered included. So values are gathered in blocks, blocks in blocks
    of blocks, and those end to end: the work grows little faster than the array.
    """
    none = F.array().cast(f"array<{kind}>")

    def grown(a: Column, x: Column) -> Column:
        state, value = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["out"], F.array(value.cast(kind))).alias("out"))

    def gathered(state: Column, part: Column, level: int) -> Column:
        begun = F.struct(state.alias("state"), none.alias("out"))
        if not level:
            return F.aggregate(part, begun, grown)
        size = BLOCK**level
        last = F.greatest(F.ceil(F.size(part) / size).cast(INT) - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(part, i * size + 1, F.lit(size)))
        return F.aggregate(blocks, begun, lambda a, x: let(gathered(a["state"], x, level - 1), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], r["out"]).alias("out"))))

    return let(xs, lambda v: F.when(v.isNotNull(), gathered(start, v, LEVELS)["out"]))


def count(text: Column, pattern: Column | str) -> Column:
    return F.regexp_count(text, lit(pattern))


def found(text: Column, pattern: Column | str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, lit(pattern), F.lit(group))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """One kind of line end; the byte order mark is a space; null is empty."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?|[\\x1c-\\x1f\\x{85}\\x{2028}\\x{2029}]", "\n"), "﻿", " ")


def source(text: Column) -> Column:
    """A source file with one kind of line end; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?|[\\x1c-\\x1f\\x{85}\\x{2028}\\x{2029}]", "\n")


def lowered(t: Column) -> Column:
    return F.translate(F.lower(t), "’", "'")


def words(t: Column) -> Column:
    return found(t, R.WORD)


def word_count(t: Column) -> Column:
    return F.greatest(count(t, R.WORD), F.lit(1))


def lines(t: Column) -> Column:
    return F.split(t, "\n", -1)


def sentences(t: Column) -> Column:
    return F.filter(F.split(stripped(t), r"(?U)(?<=[.!?])\s+", -1), lambda s: s.rlike(r"(?U)\S"))


def paragraphs(t: Column) -> Column:
    return F.filter(F.split(stripped(t), r"(?U)\n\s*\n", -1), lambda s: s.rlike(r"(?U)\S"))


def lengths(parts: Column) -> Column:
    return F.transform(parts, lambda s: count(s, R.TOKEN))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast(INT), lambda a, x: a + x.cast(INT))


def variation(xs: Column, least: int = 5) -> Column:
    """Population standard deviation over mean, to 2 places; 0 for a mean of 0; null for fewer than ``least`` values."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("s"), zero.alias("q"))

    def ratio(a: Column) -> Column:
        n, s = a["n"].cast("double"), a["s"].cast("double")
        spread = F.sqrt((a["n"] * a["q"] - a["s"] * a["s"]).cast("double")) / n
        return F.when(a["n"] >= least, F.bround(F.when(a["s"] == 0, F.lit(0.0)).otherwise(spread / (s / n)), 2))

    return F.aggregate(xs, start, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q")), ratio)


# --- language -------------------------------------------------------------------------------------------------------

SAMPLE = 4000


def stopword_hits(tokens: Column, columns: list[list[str]]) -> Column:
    """How many of an array of tokens are in each of some lists of words. Each token is looked up once in all of them together; only
    the few that some list has are looked up list by list."""
    every = list(dict.fromkeys(w for words in columns for w in words))

    def among(xs: Column, words: list[str]) -> Column:
        return F.filter(xs, lambda w: w.isin(*words))

    return let(among(tokens, every), lambda some: F.array(*[F.size(among(some, words)) for words in columns]))


def coverages(text: Column) -> Column:
    """For each pack, in order: share of stop words and a bonus for marks, and the hits."""

    def counted(x: Column) -> Column:
        return F.struct(x["sample"].alias("sample"), F.size(x["tokens"]).alias("n"), stopword_hits(x["tokens"], [p.stopwords for p in packs().values()]).alias("hits"))

    def ranked(x: Column) -> Column:
        sample, hits = x["sample"], x["hits"]
        n = x["n"].cast("double")
        rows = [F.struct(_cover(hits[i], n, sample, pack.marks).alias("coverage"), F.lit(-i).alias("rank"), hits[i].alias("hits"), F.lit(code).alias("code")) for i, (code, pack) in enumerate(packs().items())]
        return F.when(n > 0, F.reverse(F.array_sort(F.array(*rows))))

    sample = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE))
    return let(let(let(sample, lambda s: F.struct(s.alias("sample"), found(s, R.BARE).alias("tokens"))), counted), ranked)


def _cover(hits: Column, n: Column, sample: Column, marks: str) -> Column:
    cover = F.try_divide(hits.cast("double"), n)
    for mark in marks:
        cover = cover + F.when(F.contains(sample, F.lit(mark)), F.lit(0.02)).otherwise(F.lit(0.0))
    return cover


def chosen(ranked: Column) -> Column:
    """The winner of ``coverages`` if it is clear, else English as a fallback. ``ranked`` stands once in the expression."""

    def pick(r: Column) -> Column:
        first, second = r[0], r[1]
        clear = r.isNotNull() & (first["hits"] >= 4) & (first["coverage"] >= 0.07) & (first["coverage"] >= second["coverage"] * 1.25)
        told = F.when(clear, F.struct(first["code"].alias("code"), F.lit("detected").alias("source")))
        return told.otherwise(F.struct(F.lit("en").alias("code"), F.lit("fallback").alias("source")))

    return let(ranked, pick)


def by_language(code: Column, choices: dict[str, Column], default: Column) -> Column:
    """Evaluates the choice of the row's own language only."""
    out = None
    for name, value in choices.items():
        out = F.when(code == name, value) if out is None else out.when(code == name, value)
    return default if out is None else out.otherwise(default)


def pattern_of(code: Column, known: dict[str, Pack], make) -> Column:
    """``make(pack)`` of the row's own language, a pattern; one that finds nothing for other languages."""
    if len(known) == 1:
        return F.lit(make(next(iter(known.values()))))
    return by_language(code, {c: F.lit(make(p)) for c, p in known.items()}, F.lit("(?!)"))


# --- vocabulary -----------------------------------------------------------------------------------------------------


def pool(pack: Pack) -> list[tuple[str, list[str]]]:
    return [("buzzword", pack.buzzwords), ("phrase", pack.phrases), ("copula", pack.copula_avoidance), ("scope", pack.scope_inflation)]


def pool_pattern(pack: Pack) -> str:
    """Everything of the four lists, the longest where they overlap."""
    return R.needles([w for _, ws in pool(pack) for w in ws])


def key_of(hit: Column) -> Column:
    return F.regexp_replace(hit, r"(?U)\s+", " ")


def of_kind(pack: Pack, kind: str) -> list[str]:
    """The needles that count as ``kind``: what several lists have is the first one's."""
    taken: set[str] = set()
    for name, listed in pool(pack):
        own = [w for w in listed if w not in taken]
        taken.update(own)
        if name == kind:
            return own
    raise KeyError(kind)


def kind_pattern(pack: Pack, kind: str) -> str:
    return f"^{R.needles(of_kind(pack, kind))}$"


def matching(keys: Column, pattern: Column | str) -> Column:
    return F.filter(keys, lambda x: count(x, pattern) > 0)


def between(text: Column, pattern: Column | str) -> Column:
    """Each match (``hit``) and the text between it and the one before (``gap``). A text without a match, as most are, is read once."""
    hits, gaps = found(text, pattern), F.split(text, pattern, -1)
    return let(hits, lambda h: F.when(F.size(h) == 0, F.array().cast("array<struct<hit:string,gap:string>>")).otherwise(F.arrays_zip(h.alias("hit"), F.slice(gaps, 1, F.size(h)).alias("gap"))))


def located(text: Column, pattern: Column | str) -> Column:
    """Each match with the line it starts on: the text is split around its matches and line ends are summed."""

    counted = F.transform(between(text, pattern), lambda m: F.struct(m["hit"].alias("hit"), occurrences(m["gap"], "\n").alias("before"), occurrences(m["hit"], "\n").alias("inside")))

    def step(line: Column, m: Column) -> tuple[Column, Column]:
        return line + m["before"] + m["inside"], F.struct(m["hit"].alias("hit"), (line + m["before"]).alias("line"))

    return running(counted, F.lit(1).cast(INT), step, "struct<hit:string,line:int>")


def artifact_pattern(pack: Pack) -> str:
    """A run of artifacts that overlap or have at most one character between them."""
    some = "(?:" + "|".join(R.quoted(x) for x in sorted(ARTIFACTS, key=len, reverse=True)) + "|" + R.needles([*ARTIFACT_PHRASES, *pack.artifact_phrases]) + ")"
    return f"(?s){some}(?:.?{some})*"


def crutch_pattern(pack: Pack) -> str:
    return R.needles(pack.density_crutch)


def connective_pattern(pack: Pack) -> str:
    listed = "|".join(R.quoted(x) for x in pack.connectives)
    return rf"(?Uidm)(?:^|(?<=[.!?])\s)[ \t]*(?:{listed})\b" if listed else "(?!)"


def function_words(t: Column, stopwords: Column) -> Column:
    own = F.size(F.filter(words(t), lambda w: F.array_contains(stopwords, F.lower(w))))
    return F.bround(own.cast("double") / word_count(t), 3)


# --- surface --------------------------------------------------------------------------------------------------------

#: What a heading or list item, a bold span and a bold label look like.
STRUCTURAL = r"(?U)^\s*(?:#|(?:[-*+]|[0-9]{1,3}[.)])\s)"
BOLD = r"\*\*[^*\n]{1,60}\*\*"
LABEL = r"\*\*[^*\n]{1,45}?(?::\*\*|\*\*:|[.!?]\*\*)"
BOLD_BULLET = r"(?Udm)^[ \t]*(?:(?:[-*+]|[0-9]{1,3}[.)])\s+)?" + LABEL
BARE_BULLET = r"(?dm)^[ \t]*[•▪‣]"


def occurrences(t: Column, char: str) -> Column:
    return F.length(t) - F.length(F.translate(t, char, ""))


def where_any(t: Column, chars: str, value: Column) -> Column:
    """``value`` where the text has one of ``chars`` at all, else 0: most texts are told apart by a plain search."""
    test = F.contains(t, F.lit(chars[0]))
    for c in chars[1:]:
        test = test | F.contains(t, F.lit(c))
    return F.when(test, value).otherwise(F.lit(0))


def em_dashes(t: Column) -> Column:
    return occurrences(t, "—")


def em_dash_excess(dashes: Column, wc: Column, factor: Column) -> Column:
    allowed = (F.greatest(F.lit(2), F.floor(wc / 90)).cast("double") * factor).cast(INT)
    return F.greatest(F.lit(0), dashes - allowed)


def emoji(t: Column) -> Column:
    return F.when(t.rlike(R.SYMBOLS), count(t, R.EMOJI)).otherwise(F.lit(0))


def header_emoji(t: Column) -> Column:
    marked = total(F.transform(F.filter(lines(t), lambda x: x.rlike(STRUCTURAL)), emoji))
    return F.when(t.rlike(R.SYMBOLS), marked).otherwise(F.lit(0))


def bold_inline(t: Column) -> Column:
    def of(line: Column) -> Column:
        n = count(line, BOLD)
        return n - F.when((n > 0) & line.rlike(r"(?U)^\s*" + LABEL), 1).otherwise(0)

    return F.when(F.contains(t, F.lit("**")), total(F.transform(F.filter(lines(t), lambda x: F.contains(x, F.lit("**")) & ~x.rlike(STRUCTURAL)), of))).otherwise(F.lit(0))


def bold_inline_excess(n: Column, wc: Column) -> Column:
    return F.greatest(F.lit(0), n - F.greatest(F.lit(2), F.floor(wc / 150).cast(INT)))


def bold_bullets(t: Column) -> Column:
    return F.when(F.contains(t, F.lit("**")), count(t, BOLD_BULLET)).otherwise(F.lit(0))


def bare_bullets(t: Column) -> Column:
    return where_any(t, "•▪‣", count(t, BARE_BULLET))


def generic_headings(t: Column) -> Column:
    titles = found(t, r"(?dm)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    plain = F.transform(titles, lambda x: F.lower(F.regexp_replace(stripped(F.regexp_replace(x, "[*_`]+", "")), "[:.]+$", "")))
    return where_any(t, "#", F.size(F.filter(plain, lambda x: x.isin(*GENERIC_HEADINGS))))


def heading_skips(t: Column) -> Column:
    levels = F.transform(found(t, r"(?Udm)^(#{1,6})[ \t]+\S", 1), lambda x: F.length(x))
    before = F.concat(F.array(F.lit(6)), levels)
    return where_any(t, "#", F.size(F.filter(F.arrays_zip(levels.alias("own"), F.slice(before, 1, F.size(levels)).alias("before")), lambda x: x["own"] > x["before"] + 1)))


def quote_mix(t: Column) -> Column:
    apostrophes = (occurrences(t, "’‘") >= 3) & (occurrences(t, "'") >= 3)
    doubles = (occurrences(t, "“”") >= 3) & (occurrences(t, '"') >= 3)
    return F.when(apostrophes | doubles, 1).otherwise(0)


def mark_entropy(t: Column) -> Column:
    """Entropy of the marks over that of an even mix of those used, to 3 places; null under 30 marks, 0 for one kind."""

    def entropy(x: Column) -> Column:
        bits = F.aggregate(x["counts"], F.lit(0.0), lambda a, c: a - (c / x["n"]) * F.log2(c / x["n"]))
        kinds = F.size(x["counts"])
        return F.when(x["n"] >= 30, F.when(kinds <= 1, F.lit(0.0)).otherwise(F.bround(bits / F.log2(kinds.cast("double")), 3)))

    # the text is read once; what is counted is only its marks
    marks = F.regexp_replace(t, "[^" + R.quoted(MARKS) + "]+", "")
    counts = let(marks, lambda m: F.filter(F.array(*[occurrences(m, x) for x in MARKS]), lambda n: n > 0))
    return let(let(counts, lambda c: F.struct(c.alias("counts"), total(c).alias("n"))), entropy)


# --- rhythm ---------------------------------------------------------------------------------------------------------


def staccato_runs(sentence_lengths: Column) -> Column:
    """Runs of three and more sentences of one to five tokens."""
    marks = F.array_join(F.transform(sentence_lengths, lambda n: F.when((n > 0) & (n <= 5), F.lit("s")).otherwise(F.lit("-"))), "")
    return count(marks, "s{3,}")


def paragraph_openers(t: Column) -> Column:
    """(n, opener) of the five-word opener that most paragraphs share, the earliest among equals, if 3 of 5 or more do."""

    def best(heads: Column) -> Column:
        some = F.filter(heads, lambda h: h != "")
        return F.array_max(F.transform(F.array_distinct(some), lambda h: F.struct(F.size(F.filter(some, lambda x: x == h)).alias("n"), (-F.array_position(some, h)).alias("place"), h.alias("opener"))))

    heads = F.transform(paragraphs(t), lambda p: F.array_join(F.slice(found(F.lower(p), R.BARE), 1, 5), " "))
    return let(heads, lambda h: F.when(F.size(h) >= 5, let(best(h), lambda x: F.when(x["n"] >= 3, x))))


def openers(t: Column) -> Column:
    first = F.transform(sentences(t), lambda s: F.lower(F.regexp_extract(s, r"(?U)^[^\w]*([\p{L}\p{Nl}\p{No}][\w'\-]*)", 1)))
    return F.filter(first, lambda x: x != "")


def opener_top_share(t: Column) -> Column:
    """Share of the most frequent first word of sentences, to 2 places; null for fewer than 8."""
    # the longest run in the sorted words, in one pass
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(a["word"] == w, a["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    def share(ws: Column) -> Column:
        return F.when(F.size(ws) >= 8, F.bround(F.aggregate(ws, start, step, lambda a: a["best"]).cast("double") / F.size(ws), 2))

    return let(F.sort_array(openers(t)), share)


def question_hooks(t: Column) -> Column:
    return where_any(t, "?", count(t, r"(?U)(?<=[.!?]) [ \t]*(?:[\p{L}\p{Nl}\p{No}][\w'\-]*[ \t]+){0,4}[\p{L}\p{Nl}\p{No}][\w'\-]*\?"))


def windowed_ttr(t: Column, window: int = 200) -> Column:
    """Mean share of distinct words in complete windows that don't overlap, to 3 places; null without any."""

    def mean(lower: Column) -> Column:
        n = F.floor(F.size(lower) / window).cast(INT)
        shares = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.size(F.array_distinct(F.slice(lower, (i - 1) * window + 1, F.lit(window)))) / float(window))
        return F.when(n >= 1, F.bround(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / n, 3))

    return let(words(F.lower(t)), mean)


# --- Markdown -------------------------------------------------------------------------------------------------------


def without_code(text: Column) -> Column:
    """Fenced blocks become empty lines and inline code becomes spaces, so that lines and places stay.

    A fence ends at a line that starts with its opening marks; one that isn't closed goes to the end.
    """
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out"))

    def blanked(line: Column) -> Column:
        outside, codes = F.split(line, "`[^`\n]*`", -1), found(line, "`[^`\n]*`")
        gaps = F.concat(F.transform(codes, lambda c: F.repeat(F.lit(" "), F.length(c))), F.array(F.lit("")))
        return F.when(F.size(codes) == 0, line).otherwise(F.array_join(F.transform(F.arrays_zip(outside.alias("o"), gaps.alias("g")), lambda x: F.concat(x["o"], x["g"])), ""))

    def step(a: Column, line: Column) -> Column:
        head = F.regexp_replace(line, r"(?U)^\s+", "")
        opener = F.regexp_extract(head, "^(`{3,}|~{3,})", 1)
        inside, closes = a["fence"] != "", F.startswith(head, a["fence"])
        fence = F.when(inside, F.when(closes, F.lit("")).otherwise(a["fence"])).otherwise(opener)
        own = F.when(inside | (opener != ""), F.lit("")).otherwise(blanked(line))
        return F.struct(fence.alias("fence"), F.concat(a["out"], F.array(own)).alias("out"))

    return F.aggregate(F.split(text, "\n", -1), start, step, lambda a: F.array_join(a["out"], "\n"))
