"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines inside it.

Features are relative frequencies of hashed one-, two- and three-byte sequences of the lower-cased whole text. The fixed
table below gives the families of common labels; all labels that it lacks are grouped by the likeness of their mean
features, about as many groups as each has labels, so the number of machines grows slowly with the languages. Every machine is a linear SVM with squared hinge loss, trained on a bounded sample of the labelled
rows on the driver; prediction is one matrix product a batch.

Defined results: a null text or one without letters is ``und`` with score 0; a single trained language is predicted
for every text with letters; without any labelled row everything is ``und``; every label that has a row with letters is
learned, however rare; null ids take part in training; repeated rows get equal results and count once in training; very
long texts are read whole; an empty table gives an empty result; other columns stay, and clashing ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import small_batches, spread, table

#: Closely related languages by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}
UNDETERMINED = "und"
DIMS = 2048


@dataclass(frozen=True)
class LanguageParams:
    """Bounds of the training sample and strength of the machines.

    The sample has about rows_per_language rows of each language, and sample_rows in all if languages are many, but a few
    of each whatever their number.
    """

    rows_per_language: int = 600
    sample_rows: int = 9_000
    least_rows: int = 8
    cost: float = 50.0
    steps: int = 60
    #: Documents below it are rejected; a score this low means that no level had a clear winner.
    min_score: float = 0.2


_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte sequences; the whole text counts."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.bincount(b, minlength=256).astype(np.float64) / len(b)
    two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(22)
    three = b[:-2] * np.uint32(0xC2B2AE35) + b[1:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)
    three = (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(22)
    parts = [out]
    for g, size in ((two, 1024), (three, 1024)):
        parts.append(np.bincount(g, minlength=size)[:size].astype(np.float64) / max(len(g), 1))
    # 256 + 1024 + 1024 cells, folded to DIMS
    v = np.sqrt(np.concatenate(parts))
    v[256 : 256 + len(v) - DIMS] += v[DIMS:]
    return v[:DIMS].astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    n, d = x.shape
    xb = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    w = np.zeros(d + 1)
    balance = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * n

    def loss(v: np.ndarray) -> float:
        return 0.5 * v @ v + cost / n * (balance * np.maximum(0, 1 - y * (xb @ v)) ** 2).sum()

    for _ in range(steps):
        margin = 1 - y * (xb @ w)
        live = margin > 0
        c = 2 * cost / n * balance[live]
        gradient = w - xb[live].T @ (c * y[live] * margin[live])
        if np.abs(gradient).max() < 1e-6:
            break
        step = conjugate(xb[live], c, gradient)
        size, here = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > here - 1e-4 * size * gradient @ step:
            size /= 2
        w = w - size * step
    return w[:-1].astype(np.float32), float(w[-1])


def conjugate(x: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve (I + x' diag(c) x) s = b."""
    s, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), r @ r
    for _ in range(100):
        ap = p + x.T @ (c * (x @ p))
        a = rr / (p @ ap)
        s += a * p
        r -= a * ap
        new = r @ r
        if new < 1e-10 * (b @ b):
            break
        p, rr = r + new / rr * p, new
    return s


def families_of(x: np.ndarray, langs: np.ndarray) -> dict[str, str]:
    """The family of every label: the table's, or one of about sqrt(n) groups of the n labels that it lacks, by k-means of their mean features."""
    out = {lang: f for f, known in FAMILIES.items() for lang in known}
    rest = sorted(set(langs) - set(out))
    if not rest:
        return out
    means = np.stack([x[langs == lang].mean(axis=0) for lang in rest]).astype(np.float64)
    k = math.ceil(math.sqrt(len(rest)))
    centres = [means[0]]
    while len(centres) < k:  # the farthest from those so far
        centres.append(means[np.argmax(np.min([((means - c) ** 2).sum(axis=1) for c in centres], axis=0))])
    for _ in range(20):
        near = np.argmin([((means - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres = [means[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)]
    return out | {lang: f"group of {rest[int(np.flatnonzero(near == i)[0])]}" for lang, i in zip(rest, near, strict=True)}


@dataclass
class Model:
    """Machines of one level: pairs of classes, a row of weights and a bias each."""

    families: list[str]
    members: dict[str, list[str]]
    weights: np.ndarray
    bias: np.ndarray
    machines: dict[str, list[tuple[int, str, str]]]

    def votes(self, margins: np.ndarray, level: str, classes: list[str]) -> tuple[str, float]:
        """The class with the most votes, ties by the margins; its mean probability against the others."""
        if len(classes) == 1:
            return classes[0], 1.0
        won = dict.fromkeys(classes, 0.0)
        sure = dict.fromkeys(classes, 0.0)
        for k, a, b in self.machines[level]:
            p = 1 / (1 + np.exp(-2.0 * float(np.clip(margins[k], -20, 20))))
            won[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
        best = max(classes, key=lambda c: (won[c], sure[c], c))
        return best, sure[best] / (len(classes) - 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.families and _LETTER.search(t)]
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            margins = np.stack([grams(texts[i]) for i in part]) @ self.weights.T + self.bias if len(self.bias) else np.zeros((len(part), 0))
            for i, m in zip(part, margins, strict=True):
                family, p = self.votes(m, "", self.families)
                langs[i], q = self.votes(m, family, self.members[family])
                scores[i] = float(min(max(p * q, 0.0), 1.0))
        return langs, scores


def trained(x: np.ndarray, langs: list[str], params: LanguageParams = LanguageParams()) -> Model:
    """One-versus-one machines among families, and among the languages of each family."""
    names = np.array(langs)
    members: dict[str, list[str]] = {}
    family = families_of(x, names)
    for lang in sorted(set(langs)):
        members.setdefault(family[lang], []).append(lang)
    families = np.array([family[x] for x in langs])
    weights, bias, machines = [], [], {}
    for level, classes, label in [("", sorted(members), families), *[(f, m, names) for f, m in members.items()]]:
        for a, b in combinations(classes, 2):
            rows = (label == a) | (label == b)
            w, c = svm(x[rows], np.where(label[rows] == a, 1.0, -1.0), params.cost, params.steps)
            machines.setdefault(level, []).append((len(weights), a, b))
            weights.append(w)
            bias.append(c)
    return Model(sorted(members), members, np.array(weights, np.float32).reshape(-1, DIMS), np.array(bias, np.float32), machines)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> Model:
    """Train on a sample of the labelled rows of every label outside the held-out part.

    Rows with a letter are drawn by a hash of the id and the text's length, rows alike in both and the label once: by a
    threshold for about as many as wanted of each label, and the least_rows smallest hashes of each, which even the rarest label
    has. Only their features and labels reach the driver, at most about sample_rows and least_rows of each label.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.coalesce(remainder(F.col("doc_id")), F.lit(0)) != 2))
    counts = labelled.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return Model([], {}, np.zeros((0, DIMS), np.float32), np.zeros(0, np.float32), {})
    per_language = max(params.least_rows, min(params.rows_per_language, params.sample_rows // len(counts)))
    space = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", F.char_length("text")), F.lit(space))
    limit = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(space, space * per_language // r["count"] + 1))])
    rows = labelled.select("doc_id", "lang", "text", draw.alias("draw"))
    # Ranks this low are cut off in every task before the shuffle.
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).filter(F.col("rank") <= params.least_rows)
    drawn = rows.filter(F.col("draw") < F.coalesce(F.element_at(limit, F.col("lang")), F.lit(0))).unionByName(first.drop("rank"))
    drawn = drawn.dropDuplicates(["lang", "draw"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, grams(t).tobytes()) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "grams"])

    small_batches(docs.sparkSession)
    rows = drawn.mapInArrow(run, "lang string, grams binary").collect()
    if not rows:
        return Model([], {}, np.zeros((0, DIMS), np.float32), np.zeros(0, np.float32), {})
    rows.sort(key=lambda r: (r["lang"], r["grams"]))
    x = np.stack([np.frombuffer(bytes(r["grams"]), np.float32) for r in rows])
    return trained(x, [r["lang"] for r in rows], params)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred and score; columns of the input with these names are replaced."""
    rest = docs.drop("lang_pred", "score")
    schema = StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return spread(rest).mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
