"""What a source file is made of, as columns and as rows: its family, its parts and the measures over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import features as X
from .code_lexer import BANNER, DEFINITION, DIRECTIVES, GENERIC, SHELL, VERBS, extensions, lex

#: A part: ``comment``, ``docstring`` or ``string``, the line it begins on and its number of lines, and whether it stands alone on its line.
PART = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("line", T.IntegerType(), False), T.StructField("lines", T.IntegerType(), False), T.StructField("alone", T.BooleanType(), False), T.StructField("text", T.StringType(), False)])
LEXED = T.StructType([T.StructField("parts", T.ArrayType(PART, False), False), T.StructField("code", T.StringType(), False)])
_PLACED = "array<struct<line:int,text:string>>"


def _begins(t: Column, marker: str) -> Column:
    """Lines whose first visible characters are ``marker``."""
    return X.count(t, rf"(?Udm)^[^\S\n]*(?:{marker})")


def sniffed(t: Column) -> Column:
    """The family of a file without a known extension: a shell's by its first line, else that whose comments most lines are."""
    hash_, c, dash = _begins(t, f"#(?!{'|'.join(DIRECTIVES)})"), _begins(t, r"//|/\*"), _begins(t, "--")
    counted = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("family")) for i, (name, n) in enumerate((("hash", hash_), ("c", c), ("dash", dash)))])
    return F.when(t.rlike("^" + SHELL), "shell").otherwise(F.array_max(counted)["family"])


def family_and_language(t: Column, extension: Column) -> Column:
    """``family, language`` by extension, with its dot, else by content; the language is then ``code``, or ``shell`` for shells."""
    by: dict[tuple[str, str], list[str]] = {}
    for ext, known in extensions().items():
        by.setdefault(known, []).append(ext)
    told = None
    for (family, language), listed in by.items():
        one = F.struct(F.lit(family).alias("family"), F.lit(language).alias("language"))
        test = F.lower(extension).isin(*listed)
        told = F.when(test, one) if told is None else told.when(test, one)
    return told.otherwise(X.let(sniffed(t), lambda f: F.struct(f.alias("family"), F.when(f == "shell", "shell").otherwise("code").alias("language"))))


def lexed(text: Column, family: Column) -> Column:
    """``parts`` in the order of the file, and ``code``, the text with all of them blanked, line by line."""

    @F.arrow_udf(LEXED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(LEXED)
        for texts, families in batches:
            arrays = []
            for lo in range(0, len(texts), 200):
                found = [lex(t or "", f) for t, f in zip(texts.slice(lo, 200).to_pylist(), families.slice(lo, 200).to_pylist())]
                arrays.append(pa.array([(parts, code) for parts, code in found], kind))
            yield pa.concat_arrays(arrays) if arrays else pa.array([], kind)

    return run(text, family)


class LexSource:
    """Rows of a source file: its parts and its lines of code that aren't blank, numbered in the order of the file."""

    def eval(self, text: str, family: str):
        parts, code = lex(text or "", family)
        rows = [*parts, *(("code", i, 1, False, line) for i, line in enumerate(code.split("\n"), 1) if line.strip())]
        for nth, row in enumerate(rows):
            yield (nth, *row)


ROWS = "nth int, kind string, line int, lines int, alone boolean, text string"


def lex_source():
    """The table function of a text and its family; ``register`` makes it callable from SQL, in a lateral join."""
    return F.udtf(LexSource, returnType=ROWS, useArrow=True)


def register(spark: SparkSession) -> None:
    """``SELECT f.path, p.* FROM files f, LATERAL lex_source(f.text, f.family) p``."""
    spark.udtf.register("lex_source", lex_source())


def source_rows(df: DataFrame, key: str, text: str = "text", extension: str = "ext") -> DataFrame:
    """``key, family`` and the rows of ``lex_source`` of each file; null is an empty file. No file is ever one array."""
    plain = X.source(F.col(text))
    slim = df.select(F.col(key).alias("_key"), plain.alias("_text"), family_and_language(plain, F.col(extension))["family"].alias("family"))
    rows = slim.lateralJoin(lex_source()(F.col("_text").outer(), F.col("family").outer()))
    return rows.select(F.col("_key").alias(key), "family", "nth", "kind", "line", "lines", "alone", "text")


# --- measures -------------------------------------------------------------------------------------------------------


def of_kind(parts: Column, *kinds: str) -> Column:
    return F.filter(parts, lambda p: p["kind"].isin(*kinds))


def placed(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(p["line"].alias("line"), p["text"].alias("text"))).cast(_PLACED)


def said(parts: Column) -> Column:
    """Lines of comments and docstrings, ``line, text``, in order."""
    each = F.transform(of_kind(parts, "comment", "docstring"), lambda p: F.transform(F.split(p["text"], "\n", -1), lambda x, i: F.struct((p["line"] + i).alias("line"), X.stripped(x).alias("text"))))
    return F.array_sort(F.flatten(each))


def quiet(text: Column, pattern: str) -> Column:
    """The text with spaces for what ``pattern`` finds."""
    hits, gaps = X.found(text, pattern), F.split(text, pattern, -1)
    blanks = F.concat(F.transform(hits, lambda h: F.repeat(F.lit(" "), F.length(h))), F.array(F.lit("")))
    return F.when(F.size(hits) == 0, text).otherwise(F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), blanks.alias("b")), lambda x: F.concat(x["g"], x["b"])), ""))


def unquoted(lines: Column) -> Column:
    """What lines say, without what they quote."""
    text = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")
    return quiet(quiet(text, '"[^"\n]{0,120}"'), "`[^`\n]{0,120}`")


def _word_count(text: Column) -> Column:
    return X.count(text, r"(?U)\S+")


def in_body(parts: Column) -> Column:
    """Comments of two words and more that stand alone on an indented line."""
    return F.filter(of_kind(parts, "comment"), lambda p: p["alone"] & (_word_count(p["text"]) > 1))


def narrated(body: Column) -> Column:
    """Of the comments ``in_body`` those that open on a walkthrough's verb, which isn't an abbreviation."""

    def opens(word: Column) -> Column:
        shouted = (F.length(word) > 1) & (word == F.upper(word)) & (word != F.lower(word))
        return ~shouted & F.lower(word).isin(*VERBS)

    first = lambda p: F.regexp_replace(F.regexp_extract(p["text"], r"(?U)(\S+)", 1), "^[,.:;!]+|[,.:;!]+$", "")
    return F.filter(body, lambda p: X.let(first(p), opens))


def share(n: Column, of: Column, places: int, least: int) -> Column:
    return F.when(of >= least, F.bround(n.cast("double") / of, places))


def sentence_share(comments: Column) -> Column:
    """How many of the comments of three words and more are whole sentences."""
    spoken = F.filter(comments, lambda p: _word_count(p["text"]) > 2)
    whole = F.filter(spoken, lambda p: p["text"].rlike(r"(?s)^\p{Lu}.*[.!?]$"))
    return share(F.size(whole), F.size(spoken), 2, 5)


def docstring_coverage(docstrings: Column, code: Column, family: Column) -> Column:
    defined = X.count(code, "(?Udm)" + DEFINITION)
    return F.when(family.isin("hash", "ruby"), share(F.size(docstrings), defined, 2, 3))


def banners(comments: Column) -> Column:
    return F.size(F.filter(comments, lambda p: p["text"].rlike("(?Ud)" + BANNER)))


def visible(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(r"(?U)\S"))


def commented_lines(comments: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(comments, lambda p: F.sequence(p["line"], p["line"] + p["lines"] - 1)))))


def generic_share(code: Column) -> Column:
    names = X.found(code, "(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*(?![A-Za-z0-9_])")
    return X.let(names, lambda ns: share(F.size(F.filter(ns, lambda x: F.lower(x).isin(*GENERIC))), F.size(ns), 3, 40))
