"""Quality rules: statistics of each document, and the frequency of lines across the documents of a host.

Normalised lines are hashed and, for each host, counted by distinct documents (equal texts are one document: taking out
copies is another stage's work). Lines that more of a host's documents have than its limit are removed; a document that
loses more than half of its words with them is depleted and rejected.

A row's verdict depends on its own host and text and on the host's frequent lines, so rows are never joined by their keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import tidied
from .scratch import written

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line is frequent if more documents of its host have it than this percentage of the host's documents, and more than
#: this number of them. The floor keeps hosts of a few documents from losing what two or three of them happen to share.
LINE_PERCENT, LINE_FLOOR = 2, 5
#: A document that keeps less than this percentage of its words is depleted.
LEAST_PERCENT = 50
#: Frequent lines, of all hosts, up to which they are broadcast (17 bytes each); more of them are joined by host.
BROADCAST_LINES = 200_000
LEAST_WORDS = 50
#: In percent of the words.
MOST_REPEATED = 50

_WORDS = re.compile(WORD).findall


def repeated_words(words: list[str], window: int = 3) -> int:
    """How many words lie in windows that occur at least twice in ``words``."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    keys = ids[:n]
    for k in range(1, window):
        _, keys = np.unique(keys, return_inverse=True) if len(number) ** (k + 1) > 1 << 62 else (None, keys)
        keys = keys * len(number) + ids[k : k + n]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= counts[inverse] > 1
    return int(covered.sum())


def repeated_word_count(text: Column | str) -> Column:
    """A column with the number of words in 3-word windows found twice or more in the text; null counts 0."""

    @F.arrow_udf(T.LongType())
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[int] = []
            for lo in range(0, len(batch), 500):
                out.extend(repeated_words(_WORDS(x)) if x else 0 for x in batch.slice(lo, 500).to_pylist())
            yield pa.array(out, pa.int64())

    return run(F.col(text) if isinstance(text, str) else text)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(normalised(line)))


def _word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD)).cast("long")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics and ``base_failed`` to the rows of ``df``; null texts have no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    out = df.withColumns({"n_words": _word_count(t), "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"), "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), "n_repeat_words": repeated_word_count(text)})
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def lines_of(text: Column) -> Column:
    """An array with the key and the number of words of each line of ``text`` that has a word."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(line_key(x).alias("k"), _word_count(x).alias("w")))


def host_of(host: Column) -> Column:
    return F.coalesce(host.cast("string"), F.lit(""))


def frequent_lines(df: DataFrame, host: Column, text: Column, percent: int = LINE_PERCENT, floor: int = LINE_FLOOR, tag: str = "query") -> DataFrame:
    """A written table ``_host, _keys``: the keys of the frequent lines of each host that has any.

    Texts are told apart by MD5, so equal texts of a host count once; texts without words don't count. Of a text each
    line counts once, and an empty key counts the text itself, so one aggregation, of partial counts, gives the lines' and the
    hosts' numbers. A host has at most 100 / ``percent`` frequent lines for each line of its mean document.
    """
    keyed = df.select(host_of(host).alias("_host"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("_doc"), F.array_distinct(lines_of(text)["k"]).alias("_keys")).where(F.size("_keys") > 0)
    texts = keyed.groupBy("_host", "_doc").agg(F.first("_keys").alias("_keys"))
    itself = F.array(F.lit(b""))
    counts = texts.select("_host", F.explode(F.concat("_keys", itself)).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts.where((F.col("_n") > floor) | (F.length("_line") == 0)), "line-counts", tag)
    hosts = counts.where(F.length("_line") == 0).select("_host", F.col("_n").alias("_docs"))
    found = counts.where(F.length("_line") > 0).join(hosts, "_host").where((F.col("_n") > floor) & (100 * F.col("_n") > percent * F.col("_docs")))
    return written(found.groupBy("_host").agg(F.collect_set("_line").alias("_keys")), "frequent-lines", tag)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _judged(df: DataFrame, carried: list[Column], key: str, host: str, text: str, percent: int, floor: int, tag: str) -> DataFrame:
    """``carried`` of each row, ``_text``, the base statistics, ``n_line_words``, ``removed_lines`` and ``kept``; rows don't move."""
    lines = frequent_lines(df, F.col(host), F.col(text), percent, floor, tag)
    few = (lines.agg(F.sum(F.size("_keys"))).first()[0] or 0) <= BROADCAST_LINES
    own = statistics(df.select(*carried, host_of(F.col(host)).alias("_host"), F.col(text).alias("_text")), "_text").withColumn("_lines", lines_of(F.col("_text")))
    told = own.join(F.broadcast(lines) if few else lines, "_host", "left")
    told = told.withColumn("removed_lines", F.coalesce(F.array_intersect(F.col("_lines.k"), F.col("_keys")), F.array().cast("array<binary>")))
    gone = F.aggregate(F.filter("_lines", lambda x: F.array_contains("removed_lines", x["k"])), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    told = told.withColumn("n_line_words", F.when(F.size("removed_lines") > 0, gone).otherwise(F.lit(0).cast("long")))
    return told.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("n_line_words")) >= LEAST_PERCENT * F.col("n_words"))).drop("_host", "_lines", "_keys")


def verdicts(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", percent: int = LINE_PERCENT, floor: int = LINE_FLOOR, tag: str = "query") -> DataFrame:
    """``key``, the base statistics of each row of ``df``, ``n_line_words`` (words in frequent lines) and ``kept``.

    Each row is judged by its own host and text, so repeated rows have the same result each and rows with a null or repeated key
    are told apart. A null or empty text has no words and fails the base rules; a null host is the host "". Of a very long text
    every line counts. Other columns of ``df``, whatever their names, are ignored. An empty table gives no rows.
    """
    told = _judged(df, [F.col(key).alias("_id")], key, host, text, percent, floor, tag)
    return told.select(F.col("_id").alias(key), *BASE, "n_line_words", "kept")


def without_lines(text: Column, keys: Column) -> Column:
    """The text without the lines whose key is in the array ``keys``."""
    lines = F.split(text, "\n", -1)
    return F.when(F.size(keys) == 0, text).otherwise(F.array_join(F.filter(lines, lambda x: ~(x.rlike(WORD) & F.array_contains(keys, line_key(x)))), "\n"))


def clean(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", percent: int = LINE_PERCENT, floor: int = LINE_FLOOR, tag: str = "query") -> DataFrame:
    """The rows of ``df`` that ``verdicts`` keeps, without their frequent lines, in the columns of ``df``.

    Rows are judged one by one, whatever their keys (see ``verdicts``); repeated rows are all kept or all rejected. Columns of
    ``df`` may have any names. An empty table stays empty.
    """
    told = _judged(df, [F.struct(*[F.col(c) for c in df.columns]).alias("_row")], key, host, text, percent, floor, tag).where("kept")
    return told.select(*[without_lines(F.col("_text"), F.col("removed_lines")).alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS ws, regexp_extract_all(t, '{SYMBOLS}') AS sy FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, line, md5(lower(trim(regexp_replace(line, '{SPACE}', ' ', 'g')))) AS k, len(regexp_extract_all(line, '{WORD}')) AS n FROM l WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
texts AS (SELECT host, t, min(doc_id) AS doc_id FROM d WHERE regexp_matches(t, '{WORD}') GROUP BY host, t),
docs AS (SELECT host, count(*) AS n FROM texts GROUP BY host),
each AS (SELECT DISTINCT host, doc_id, k FROM lw SEMI JOIN texts USING (host, doc_id)),
f AS (SELECT each.host, k FROM each JOIN docs USING (host) GROUP BY each.host, k, docs.n HAVING count(*) > {LINE_FLOOR} AND 100 * count(*) > {LINE_PERCENT} * docs.n),
x AS (SELECT doc_id, sum(n) AS n FROM lw JOIN f USING (host, k) GROUP BY doc_id),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars, len(sy)::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS n_line_words
      FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words,
  (NOT base_failed AND 100 * (n_words - n_line_words) >= {LEAST_PERCENT} * n_words) AS kept FROM b
"""
