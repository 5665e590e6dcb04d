"""Spans to mark in a text: of all categories, without overlaps, the more telling category first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions import features as X
from telltale.functions import regexes as R
from telltale.functions.lexicon import Pack, configured, packs

from .prose import _language

#: Categories of marks; of marks that begin at the same place the first one stays.
PRECEDENCE = ["artifact", "phrase", "buzzword", "construction", "copula", "scope", "hedge", "emoji", "emdash", "bold-bullet", "bare-bullet"]
_MARK = "struct<start:int,rank:int,length:int,key:string>"
_MARKS = f"array<{_MARK}>"


def placed(text: Column, pattern: Column | str) -> Column:
    """Each match with the character it starts at, counted from 0: the text is split around its matches and lengths are summed."""

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        own = at + F.length(m["gap"])
        return own + F.length(m["hit"]), F.struct(m["hit"].alias("hit"), own.alias("start"))

    return X.running(X.between(text, pattern), F.lit(0), step, "struct<hit:string,start:int>")


def _marks(hits: Column, category: str | Column, key) -> Column:
    rank = F.lit(PRECEDENCE.index(category)) if isinstance(category, str) else category
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (rank if isinstance(rank, Column) else rank(h)).alias("rank"), F.length(h["hit"]).alias("length"), key(h["hit"]).alias("key")).cast(_MARK))


def _matches(pattern: str):
    return lambda h: X.count(X.key_of(h["hit"]), pattern) > 0


def _of_pack(t: Column, l: Column, pack: Pack) -> Column:
    parts = [_marks(placed(l, X.artifact_pattern(pack)), "artifact", X.key_of)]
    pool = placed(l, X.pool_pattern(pack))
    for kind in ("phrase", "buzzword", "copula", "scope"):
        own = X.kind_pattern(pack, kind)
        parts.append(_marks(F.filter(pool, _matches(own)), kind, X.key_of))
    for p in pack.patterns:
        parts.append(_marks(placed(t, R.unicode(p.regex)), "construction" if p.weight else "hedge", lambda _, n=p.name: F.lit(n)))
    return F.concat(*parts)


def resolved(marks: Column) -> Column:
    """Marks in the order of the text; of one that another covers in part only the rest stays, of one wholly covered nothing."""
    ordered = F.array_sort(F.transform(marks, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), (-m["length"]).alias("shorter"), m["key"].alias("key"))))
    names = F.array(*[F.lit(x) for x in PRECEDENCE])

    def step(past: Column, m: Column) -> tuple[Column, Column]:
        end = m["start"] - m["shorter"]
        own = F.struct(F.greatest(m["start"], past).alias("start"), end.alias("end"), F.get(names, m["rank"]).alias("category"), m["key"].alias("key"))
        return F.greatest(past, end), own

    told = X.running(ordered, F.lit(0), step, "struct<start:int,end:int,category:string,key:string>")
    return F.filter(told, lambda m: m["start"] < m["end"])


def with_marks(df: DataFrame, text: str = "text", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """Adds ``marks``, an array of ``start, end, category, key``, to the rows of ``df``; no shuffle. Null has no marks.

    Places are characters of the text with each line end as one character.
    """
    known = {c: configured(p, config) for c, p in packs().items()}
    if lang and lang != "auto":
        known = {lang: known[lang]}
    keep = [c for c in df.columns if c != "marks"]
    base = df.select(*keep, X.normalised(F.col(text)).alias("_t"), _language(F.col(text), lang).alias("_told")).withColumn("_l", X.lowered(F.col("_t")))
    t, l = F.col("_t"), F.col("_l")
    lexical = X.by_language(F.col("_told.code"), {c: _of_pack(t, l, p) for c, p in known.items()}, F.array().cast(_MARKS))
    surface = [("emoji", R.EMOJI, lambda h: h), ("emdash", "—", lambda h: h), ("bold-bullet", X.BOLD_BULLET, lambda h: F.lit("**Term:**")), ("bare-bullet", X.BARE_BULLET, X.stripped)]
    marks = F.concat(lexical, *[_marks(placed(t, rx), name, key) for name, rx, key in surface])
    return base.select(*keep, resolved(marks).alias("marks"))
