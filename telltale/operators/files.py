"""Files of any kind in one table: prose or code by extension, one score, one record, one report each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions.code_lexer import extensions

from . import code, findings, prose

MODES = ("auto", "prose", "code")


def mode_of(extension: Column, mode: str = "auto") -> Column:
    """``code`` for the extensions of source files, else ``prose``, unless one of them is asked for."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, choose from {MODES}")
    return F.lit(mode) if mode != "auto" else F.when(F.lower(extension).isin(*extensions()), "code").otherwise("prose")


def final_score(record: DataFrame) -> Column:
    """The score of a row that has one of the two kinds of records."""
    present = [F.col(c) for c in ("score_per_100", "score_per_1k") if c in record.columns]
    return F.coalesce(*present)


def split_by_mode(files: DataFrame, extension: str = "ext", mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The rows that are prose and those that are code; each side reads its own rows only."""
    kind = F.coalesce(mode_of(F.col(extension), mode), F.lit("prose"))
    return files.where(kind == "prose"), files.where(kind == "code")


def score_files(files: DataFrame, path: str = "path", text: str = "text", extension: str = "ext", mode: str = "auto", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """``path, mode, score, verdict, record`` of each file; the record is its full JSON. Null texts are empty files, null extensions
    prose."""
    as_prose, as_code = split_by_mode(files.select(F.col(path).alias("path"), F.col(text).alias("text"), F.col(extension).alias("ext")), "ext", mode)
    told = []
    for scored, fields in ((prose.score_prose(as_prose, "text", lang, config), prose.FIELDS), (code.score_code(as_code, "text", "ext", lang, config), code.FIELDS)):
        record = F.to_json(F.struct(*[F.col(f) for f in fields], F.col("path")), {"ignoreNullFields": "false"})
        told.append(scored.select("path", "mode", final_score(scored).alias("score"), "verdict", record.alias("record")))
    return told[0].unionByName(told[1])


def file_diagnostics(files: DataFrame, path: str = "path", text: str = "text", extension: str = "ext", mode: str = "auto", lang: str | None = None, config: dict | None = None) -> DataFrame:
    """A line of JSON for each finding of each file, whatever its kind: ``value``."""
    as_prose, as_code = split_by_mode(files.select(F.col(path).alias("path"), F.col(text).alias("text"), F.col(extension).alias("ext")), "ext", mode)
    return findings.diagnostics(findings.findings(as_prose, "path", "text", lang, config), "path").unionByName(code.diagnostics(code.code_findings(as_code, "path", "text", "ext", lang, config), "path"))


def file_reports(files: DataFrame, mode: str = "auto", lang: str | None = None, config: dict | None = None, quiet: bool = False) -> DataFrame:
    """``path, score, report`` of each file of ``path, text, ext``: what a reader sees, one line each with ``quiet``."""
    as_prose, as_code = split_by_mode(files, "ext", mode)
    p, c = prose.with_features(as_prose, "text", lang, config), code.with_evidence(as_code, "text", "ext", lang, config)
    if quiet:
        said = [findings.verdict_line(p, None, ["path", F.col("score_per_1k").alias("score")]), code.verdict_line(c, ["path", F.col("score_per_100").alias("score")])]
        return said[0].unionByName(said[1]).withColumnRenamed("value", "report")
    told = findings.report(p, findings.findings(as_prose, "path", "text", lang, config), "path").join(p.select("path", F.col("score_per_1k").alias("score")), "path")
    as_code_reports = code.report(c, code.code_findings(as_code, "path", "text", "ext", lang, config), "path").join(c.select("path", F.col("score_per_100").alias("score")), "path")
    return told.select("path", "score", "report").unionByName(as_code_reports.select("path", "score", "report"))

