"""Language identification in two steps: the family first, then one language against another within it.

Both steps vote among linear support vector machines, each of which tells two classes apart. They are trained here,
by dual coordinate descent, on hashed byte bigrams and trigrams of lower-cased texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import tidied

#: Languages of a family; those that are not listed form families of ``UNLISTED`` in the order of their names.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
UNLISTED = 12
#: Bounds of what is fitted on: labelled rows of each language, and of all languages together.
ROWS_PER_LANGUAGE, ROWS = 400, 40_000
BIGRAMS, TRIGRAMS = 1 << 12, 1 << 13
#: Bytes of a text handled at a time.
SLICE = 1 << 20
#: Margins become scores by the logistic function of this multiple.
STEEPNESS = 4.0
UNDETERMINED = "und"

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts of the whole text, of unit length."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    counts = np.zeros(BIGRAMS + TRIGRAMS, np.int64)
    for lo in range(0, len(raw), SLICE):
        part = raw[lo : lo + SLICE + 2].astype(np.uint32)
        two = part[:-1] << 8 | part[1:]
        three = two[:-1] << 8 | part[2:]
        two = two[: SLICE]
        counts[:BIGRAMS] += np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=BIGRAMS)
        counts[BIGRAMS:] += np.bincount((three * np.uint32(2654435761)) >> np.uint32(19), minlength=TRIGRAMS)
    out = np.sqrt(counts, dtype=np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Weights, with the bias last, of a linear support vector machine over sparse rows (places, values).

    Classes weigh alike whatever their sizes.
    """
    signs = signs.astype(np.float32)
    share = np.where(signs > 0, (signs > 0).sum(), (signs < 0).sum()) * 2 / len(signs)
    bound, square = (cost / share).tolist(), [float(v @ v) for _, v in rows]
    alpha, w, random = [0.0] * len(rows), np.zeros(BIGRAMS + TRIGRAMS + 1, np.float32), np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at, values = rows[i]
            new = min(max(alpha[i] - float(signs[i] * (values @ w[at]) - 1) / square[i], 0.0), bound[i])
            if (step := new - alpha[i]) != 0:
                w[at] += np.float32(step * signs[i]) * values
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


class Vote:
    """Machines for all pairs of ``classes``."""

    def __init__(self, classes: list[str], rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.classes, self.pairs = classes, list(combinations(range(len(classes)), 2))
        self.weights = np.zeros((len(self.pairs), BIGRAMS + TRIGRAMS + 1), np.float32)
        for row, (a, b) in zip(self.weights, self.pairs):
            two = np.flatnonzero(np.isin(labels, [classes[a], classes[b]]))
            row[:] = svm([rows[i] for i in two], np.where(labels[two] == classes[a], 1.0, -1.0))

    def __call__(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        n = len(self.classes)
        won, total, scores = np.zeros(n), np.zeros(n), np.zeros(n)
        for (a, b), m in zip(self.pairs, margins):
            won[a if m >= 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            p = 1 / (1 + np.exp(-STEEPNESS * float(m)))
            scores[a], scores[b] = scores[a] + p, scores[b] + 1 - p
        best = max(range(n), key=lambda i: (won[i], total[i]))
        return self.classes[best], scores[best] / (n - 1)


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, families: dict[str, list[str]]):
        of = {language: family for family, members in families.items() for language in members}
        unlisted = sorted({x for x in labels if x not in of})
        if len(unlisted) > UNLISTED:
            of |= {x: f"unlisted {i // UNLISTED}" for i, x in enumerate(unlisted)}
        family = np.array([of.get(x, x) for x in labels])
        self.families = Vote(sorted(set(family)), rows, family)
        self.within = {f: Vote(sorted(set(labels[own])), [rows[i] for i in own], labels[own]) for f in self.families.classes for own in [np.flatnonzero(family == f)]}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        x = features(text)
        family, p = self.families(x)
        language, q = self.within[family](x)
        return language, p * q


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", families: dict[str, list[str]] | None = None) -> Model | None:
    """Fits on labelled rows that are not held out: of each language, those of the smallest key hashes.

    At most ``ROWS_PER_LANGUAGE`` rows of each language, and about ``ROWS`` in all, reach the driver, as counts of n-grams; every language
    that has a label has a part in them. None if no row has a label, a key and a text with a letter.
    """
    usable = df.select(F.col(key).alias("k"), F.col(label).alias("y"), F.col(text).alias("t")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & F.col("t").isNotNull() & ~held_out("k"))
    seen = usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(ROWS).collect()
    if not seen:
        return None
    each = max(1, min(ROWS_PER_LANGUAGE, ROWS // len(seen)))
    most = df.sparkSession.createDataFrame([(r["y"], r["n"]) for r in seen], T.StructType([usable.schema["y"], T.StructField("n", T.LongType())]))
    # a hash below a bound keeps a few times the rows wanted, whatever their number, so that no task ranks a whole language
    drawn = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(11)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    slim = usable.select("k", "y").join(F.broadcast(most), "y").where(drawn * F.col("n") <= 4 * each + 200)
    order = Window.partitionBy("y").orderBy(drawn, "k")
    chosen = slim.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("k", "y").distinct()

    @F.arrow_udf(T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.FloatType()))]))
    @tidied
    def sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at, v = [], []
            for x in batch.to_pylist():
                full = features(x)
                at.append(np.flatnonzero(full).astype(np.int32))
                v.append(full[at[-1]])
            yield pa.StructArray.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float32()))], ["at", "v"])

    texts = usable.join(F.broadcast(chosen), ["k", "y"]).where(F.col("t").rlike(r"\p{L}"))  # bounded by the two constants
    found = texts.limit(2 * ROWS).select("k", "y", sparse(F.col("t")).alias("x")).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["y"], str(r["k"])))
    bias = BIGRAMS + TRIGRAMS
    rows = [(np.array([*r["x"]["at"], bias], np.int32), np.array([*r["x"]["v"], 1.0], np.float32)) for r in found]
    return Model(rows, np.array([r["y"] for r in found]), families or FAMILIES)


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to the rows of ``df``, from the whole text alone; no shuffle.

    Null and empty texts, texts without a letter (``\\p{L}``), and all texts where there is no model, are ``und`` with score 0.
    Texts of any length are read whole. Repeated rows get the same result each; an empty table stays empty. Columns of the same two
    names are replaced, all others stay, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    @F.arrow_udf(kind)
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for lo in range(0, len(batch), 500):
                found.extend(shared.value.predict(x) if shared.value else (UNDETERMINED, 0.0) for x in batch.slice(lo, 500).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([float(x) for _, x in found], pa.float64())], ["lang_pred", "score"])

    own = F.struct(*[F.col(c) for c in df.columns if c not in ("lang_pred", "score")]).alias("_row")
    return df.select(own, run(F.col(text)).alias("_told")).select("_row.*", "_told.lang_pred", "_told.score")
