"""Comments that only say what the code beside them says, from rows: files of any length, no array of lines, and one pass over the rows.

Rows are those of ``code_parts.source_rows``. They are dealt out by file and sorted by line once in each direction. A comment meets the code
on its own and the next lines by a range join, put as a carry: from the end of the file upwards, the last two lines of code go along. A
docstring finds the definition above it by an as-of join: downwards, the last line of code is carried along, so that any other code between
them is a barrier. Words meet names that share their first four letters, in groups, in place of a search of all names for each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.functions.code_lexer import DEFINITION, SMALL, VERBS
from telltale.functions.features import stripped
from telltale.functions.restated import ABOVE, REACH, SHARE, STEM, STEP, TAGS, names_in

_ID = ["_key", "nth"]
#: A word of a comment.
WORD = "[A-Za-z][A-Za-z0-9'-]*"


def _words(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.lower(w))


def stem(word: Column) -> Column:
    return F.substring(word, 1, STEM)


def _known(texts: DataFrame) -> DataFrame:
    """``texts`` (``_key, nth, kind, line, text, _telling, _names``) with ``n_telling``, ``n_names`` and ``known``: how many of the words told
    are among the names, or begin one, or are begun by one, of four letters or more.

    Such words have their first letters in common, so words and names are grouped by these. A text goes along with one row only, and no
    shuffle is needed as rows stay with their file.
    """
    part = "struct<stem:string,told:string,name:string,text:string>"

    def parts(words: Column, told: bool) -> Column:
        none = F.lit(None).cast("string")
        return F.transform(words, lambda w: F.struct(stem(w).alias("stem"), (w if told else none).alias("told"), (none if told else w).alias("name"), none.alias("text")).cast(part))

    text = F.array(F.struct(F.lit(None).cast("string").alias("stem"), F.lit(None).cast("string").alias("told"), F.lit(None).cast("string").alias("name"), F.col("text").alias("text")).cast(part))
    own = [*_ID, "kind", "line", F.size("_telling").alias("n_telling"), F.size("_names").alias("n_names")]
    each = texts.select(*own, F.explode(F.concat(text, parts(F.col("_telling"), True), parts(F.col("_names"), False))).alias("p")).select("*", "p.*").drop("p")
    keys = [*_ID, "kind", "line", "n_telling", "n_names"]

    def same(w: Column, n: Column) -> Column:
        return (w == n) | (F.length(n) >= STEM) & F.startswith(w, n) | (F.length(w) >= STEM) & F.startswith(n, w)

    met = each.groupBy(*keys, "stem").agg(F.collect_list("told").alias("_told"), F.collect_list("name").alias("_named"), F.max("text").alias("text"))
    known = F.size(F.filter("_told", lambda w: F.exists("_named", lambda n: same(w, n))))
    return met.groupBy(*keys).agg(F.sum(known).alias("known"), F.max("text").alias("text"))


def _telling(text: Column, pattern: str, small: list[str], shortest: int) -> Column:
    return F.filter(_words(text, pattern), lambda w: ~w.isin(*small) & (F.length(w) >= shortest))


def restatements(rows: DataFrame, key: str) -> DataFrame:
    """``key, kind, line, text`` of the comments two thirds of whose words are names in the next lines of code, and of the docstrings whose
    first line only has words of the name of the function defined right above.

    ``key`` identifies a file and isn't null. Repeated files and ties of lines are told apart by their order in the file only.
    """
    kind, text, line = F.col("kind"), F.col("text"), F.col("line")
    excused = text.rlike(rf"(?iU)^(?:(?:{'|'.join(TAGS)})|{STEP})\b") | F.contains(text, F.lit("=")) | F.endswith(text, F.lit(";"))
    says = (kind == "comment") & ~excused & (F.regexp_count(text, F.lit(WORD)) >= 3)
    own = rows.select(F.col(key).alias("_key"), "family", "nth", "kind", "line", "text").where("_key IS NOT NULL")
    own = own.where((kind == "code") | (kind == "docstring") & (F.col("family") == "hash") | says).select(*_ID, "kind", "line", "text")
    code = lambda *more: F.when(kind == "code", F.struct("line", "text", *more))

    def carried(value: Column, *order: Column) -> Column:
        return F.last(value, ignorenulls=True).over(Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))

    down = [F.asc("line"), F.when(kind == "docstring", 0).otherwise(1).asc(), F.asc("nth")]
    up = [F.desc("line"), F.when(kind == "code", 0).otherwise(1).asc(), F.desc("nth")]
    above = own.withColumn("_above", carried(code(), *down)).withColumn("_above", F.when((kind == "docstring") & (F.col("_above.line") >= line - ABOVE), F.col("_above.text")))
    next_ = above.withColumn("_next", carried(code(), *up)).withColumn("_two", carried(code(F.col("_next").alias("next")), *up))
    reached = lambda c: F.when(c["line"] < line + REACH, c["text"])
    beside = F.concat_ws("\n", *[reached(c) for c in (F.col("_two"), F.col("_two.next"))])
    first = stripped(F.element_at(F.split("text", "\n", -1), 1))
    name = F.regexp_extract("_above", "(?U)" + DEFINITION, 1)
    comments = (kind == "comment") & (F.col("_two.line") < line + REACH)
    met = next_.where(comments | (kind == "docstring") & (name != "")).select(*_ID, "kind", "line", F.when(kind == "comment", text).otherwise(first).alias("text"), F.when(kind == "comment", beside).otherwise(name).alias("_code"))
    telling = F.when(kind == "comment", _telling(text, WORD, [*SMALL, *VERBS], 2)).otherwise(_telling(text, "[A-Za-z][A-Za-z0-9]*", SMALL, 1))
    told = _known(met.select(*_ID, "kind", "line", "text", telling.alias("_telling"), names_in(F.col("_code")).alias("_names")))
    n, known = F.col("n_telling"), F.col("known")
    restates = F.when(kind == "comment", (n >= 2) & (100 * known >= SHARE * n) & (known > 0)).otherwise((n > 0) & (n <= F.col("n_names") + 1) & (known == n))
    return told.where(restates).select(F.col("_key").alias(key), "kind", "line", "text")


def redundant_comments(rows: DataFrame, key: str) -> DataFrame:
    """``key, line, text`` of the ``restatements`` that are comments."""
    return restatements(rows.where("kind IN ('code', 'comment')"), key).select(key, "line", "text")


def echoing_docstrings(rows: DataFrame, key: str) -> DataFrame:
    """``key, line, text`` of the ``restatements`` that are docstrings."""
    return restatements(rows.where("family = 'hash' AND kind IN ('code', 'docstring')"), key).select(key, "line", "text")
