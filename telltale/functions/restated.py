"""Comments that only say what the code beside them says, as columns: rows of comments against rows of code by line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .code_lexer import DEFINITION, SMALL, VERBS

#: What an identifier is, and a word of one in snake or camel case.
IDENTIFIER, PIECE = "[A-Za-z_][A-Za-z0-9_]*", "[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"
#: Tags that excuse a comment, and the label of a step.
TAGS = ["todo", "fixme", "xxx", "hack", "note", "nb", "warning", "see", "https?:"]
STEP = r"step\s*\d+"
#: Lines from a comment's own on and lines with code among them that count; lines above a docstring; the share
#: of words that must be names, in percent; letters from which on a name and a word may be cut short.
REACH, CODE_LINES, ABOVE, SHARE, STEM = 4, 2, 3, 65, 4


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def names_in(code: Column) -> Column:
    """The distinct words, of two letters and more, that the identifiers in ``code`` are made of."""
    words = F.flatten(F.transform(_all(code, IDENTIFIER), lambda name: _all(name, PIECE)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.lower(w)))


def named(word: Column, names: Column) -> Column:
    """Whether a name is the word, or one of them, of four letters or more, begins the other."""
    return F.exists(names, lambda n: (n == word) | (F.length(n) >= STEM) & F.startswith(word, n) | (F.length(word) >= STEM) & F.startswith(n, word))


def _with_code(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(r"(?U)\S"))


def redundant(comments: Column, code: Column) -> Column:
    """Of ``comments`` (line, text) those two thirds of whose words are names in the next lines of ``code``, an array of lines."""
    plain = F.filter(comments, lambda c: ~c["text"].rlike(rf"(?iU)^(?:(?:{'|'.join(TAGS)})|{STEP})\b") & ~F.contains(c["text"], F.lit("=")) & ~F.endswith(c["text"], F.lit(";")))

    def weighed(c: Column) -> Column:
        said = F.transform(_all(c["text"], "[A-Za-z][A-Za-z0-9'-]*"), lambda w: F.lower(w))
        beside = F.array_join(F.slice(_with_code(F.slice(code, c["line"], F.lit(REACH))), 1, CODE_LINES), "\n")
        telling = F.filter(said, lambda w: (F.length(w) > 1) & ~w.isin(*SMALL, *VERBS))
        return F.struct(c["line"].alias("line"), c["text"].alias("text"), F.size(said).alias("said"), telling.alias("telling"), names_in(beside).alias("names"))

    def restates(c: Column) -> Column:
        known = F.size(F.filter(c["telling"], lambda w: named(w, c["names"])))
        return (c["said"] >= 3) & (F.size(c["telling"]) >= 2) & (F.size(c["names"]) > 0) & (100 * known >= SHARE * F.size(c["telling"]))

    return _placed(F.filter(F.transform(plain, weighed), restates))


def echoes(docstrings: Column, code: Column) -> Column:
    """Of ``docstrings`` those whose first line only has words of the name of the function defined right above."""

    def weighed(d: Column) -> Column:
        first = F.regexp_replace(F.element_at(F.split(d["text"], "\n", -1), 1), r"(?U)^\s+|\s+$", "")
        above = F.slice(code, F.greatest(d["line"] - ABOVE, F.lit(1)), F.least(d["line"] - 1, F.lit(ABOVE)))
        name = F.regexp_extract(F.coalesce(F.get(F.reverse(_with_code(above)), F.lit(0)), F.lit("")), "(?U)" + DEFINITION, 1)
        telling = F.filter(F.transform(_all(first, "[A-Za-z][A-Za-z0-9]*"), lambda w: F.lower(w)), lambda w: ~w.isin(*SMALL))
        return F.struct(d["line"].alias("line"), first.alias("text"), telling.alias("telling"), names_in(name).alias("names"), name.alias("name"))

    def restates(d: Column) -> Column:
        few = F.size(d["telling"]) <= F.size(d["names"]) + 1
        return (d["name"] != "") & (F.size(d["telling"]) > 0) & few & F.forall(d["telling"], lambda w: named(w, d["names"]))

    return _placed(F.filter(F.transform(docstrings, weighed), restates))


def _placed(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["line"].alias("line"), r["text"].alias("text")))
