"""Text files and tables as DataFrames."""

from __future__ import annotations

import fnmatch
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions.features import without_code

CONFIG_NAMES = (".telltale.json", ".telltalerc")
MARKDOWN = r"(?i)\.(?:md|markdown)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_groups(df: DataFrame, most: int) -> int:
    """Row groups in the Parquet files that ``df`` reads; with ``most`` files and more their number, so few footers are read."""
    files = df.inputFiles()
    if len(files) >= most:
        return len(files)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    total = 0
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(name)
        footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        total += footer.getRowGroups().size()
        footer.close()
    return total


def spread(df: DataFrame) -> DataFrame:
    """The rows of a Parquet table dealt out to all cores where it has fewer row groups than cores, as a row group is read by one
    task; other tables as they are. Select what is needed first, as these rows are shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if row_groups(df, cores) < cores else df


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text: bad bytes become U+FFFD, a leading byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\x{FEFF}", "")


def read_texts(spark: SparkSession, paths: str | list[str], markdown: bool = False, ignore: list[str] | None = None) -> DataFrame:
    """``path, text, ext`` of the files that the globs ``paths`` find, without the ignored ones.

    Code in Markdown files, or in all files with ``markdown``, is blanked. Paths are filtered before any content is read.
    """
    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    kept = without_ignored(found, "path", ignore or [])
    text = decoded(F.col("content"))
    blank = F.lit(markdown) | F.col("path").rlike(MARKDOWN)
    return kept.select("path", F.when(blank, without_code(text)).otherwise(text).alias("text"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"))


def matching(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or a glob names, in order; none if there are none. Any store that Spark reads will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(f.getPath().toString() for f in found or [] if f.isFile())


def read_labelled(spark: SparkSession, folders: dict[str, str], markdown: bool = False) -> DataFrame:
    """``path, text, ext, label`` of the files in each folder of ``{label: folder}``, such as samples of people and of machines."""
    told = [read_texts(spark, f"{folder.rstrip('/')}/*", markdown).withColumn("label", F.lit(label)) for label, folder in folders.items()]
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """One text that isn't in a file."""
    return spark.createDataFrame([("-", text, "")], "path string, text string, ext string")


def ignore_lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def glob_regex(glob: str) -> str:
    """A glob as a regular expression of the JVM, for whole strings."""
    body = fnmatch.translate(glob)
    body = body.removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
    return "(?s)^(?:" + body.replace("(?>.*?", "(?>.*?") + ")$"


def without_ignored(df: DataFrame, path: str, globs: list[str]) -> DataFrame:
    """The rows whose path, or its last part, matches none of the globs."""
    if not globs:
        return df
    clean = F.regexp_replace(F.translate(F.col(path), "\\", "/"), r"^\./", "")
    base = F.element_at(F.split(clean, "/", -1), -1)
    patterns = df.sparkSession.createDataFrame([(glob_regex(g),) for g in globs], "_pattern string")
    return df.withColumns({"_full": clean, "_base": base}).join(F.broadcast(patterns), F.rlike("_full", F.col("_pattern")) | F.rlike("_base", F.col("_pattern")), "left_anti").drop("_full", "_base")


def find_config(start: str) -> str | None:
    """The nearest configuration file upwards from ``start``, not beyond a repository's root."""
    folder = Path(start).resolve()
    for place in (folder, *folder.parents):
        for name in CONFIG_NAMES:
            if (place / name).is_file():
                return str(place / name)
        if (place / ".git").exists():
            return None
    return None


def load_config(text: str) -> dict:
    """A configuration from JSON; unknown keys are ignored, wrong types are errors."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration is a JSON object")
    out: dict = {}
    for key in ("ignore_words", "ignore_phrases", "extra_words", "extra_phrases"):
        value = found.get(key, [])
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ValueError(f"{key} is a list of strings")
        out[key] = value
    patterns = found.get("extra_patterns", [])
    if not isinstance(patterns, list):
        raise ValueError("extra_patterns is a list")
    for entry in patterns:
        if not isinstance(entry, dict) or not isinstance(entry.get("regex"), str):
            raise ValueError("each of extra_patterns has a regex")
        if not isinstance(entry.get("weight", 1), int):
            raise ValueError("a weight is a whole number")
    out["extra_patterns"] = patterns
    return out


def check_patterns(spark: SparkSession, config: dict) -> None:
    """Fails early on an expression that the JVM doesn't accept."""
    from telltale.functions.regexes import unicode

    for entry in config.get("extra_patterns", []):
        spark.range(1).select(F.regexp_count(F.lit(""), F.lit(unicode(entry["regex"])))).collect()
