"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document's statistics are computed from its whole text and transformed (logarithms of
counts, shares, a compression ratio). The class means and covariances come from all labelled
training rows, by sums of outer products that each task adds up and Spark adds over tasks; the
covariances are shrunk towards their pooled diagonal. A score is the logistic function of
the difference of the classes' log densities, from Mahalanobis distances by Cholesky factors
that are computed once and travel with the tasks.

Edge cases: a null text counts as empty, and an empty one has statistics of zero and a score
like any other; labels that are null, or of documents that are not there, teach nothing;
with fewer than two training rows of either class every score is the share of label 1 (one
half without labels); repeated rows are scored each; an empty table gives no rows; other
columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_crc, strides, table

#: Weight of the pooled diagonal in a class covariance, and the least variance of a standardised statistic.
SHRINKAGE, FLOOR = 0.1, 1e-2
#: Standardised statistics are held within this many deviations.
REACH = 8.0
#: Log density differences are divided by this before the logistic function.
TEMPERATURE = 4.0

_SIGNS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
FEATURES = (
    "log_words", "log_lines", "word_length", "word_spread", "distinct", "top_word", "signs", "upper",
    "digits", "exclaimed", "stops", "quotes", "other_ascii", "beyond_ascii", "dup_lines", "compressed",
)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    signs = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    counts = Counter(words)
    letters = max(1, int(signs.sum() - signs[9:14].sum() - signs[32]))
    upper, digits = signs[65:91].sum(), signs[48:58].sum()
    marked, stops, exclaimed, quotes = signs[_SIGNS].sum(), signs[_STOPS].sum(), signs[33], signs[34] + signs[39]
    ascii_letters = upper + signs[97:123].sum()
    other = max(0, signs[33:127].sum() - ascii_letters - digits - marked - stops - exclaimed - quotes)
    root = lambda x: float(np.sqrt(x / letters))  # noqa: E731  spreads out small shares
    return [
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        len(counts) / max(1, n) ** 0.9,
        (max(counts.values()) / n) ** 0.5 if n else 0.0,
        root(marked),
        root(upper),
        root(digits),
        root(exclaimed),
        root(stops),
        root(quotes),
        root(other),
        root(signs[128:].sum()),
        ((len(lines) - len(set(lines))) / len(lines)) ** 0.5 if lines else 0.0,
        float(np.log1p(len(zlib.compress(text, 1)) / (len(text) + 64))),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x array<double> of each row of ``docs`` (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or b"") for _, texts in strides(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(rows, f"doc_id {id_type}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors of the covariances and the factors' inverses, by class, over standardised statistics; or a prior alone."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    inverses: tuple[np.ndarray, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The score of each row of ``x``."""
        if not self.factors:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.centre) / self.scale, -REACH, REACH)
        density = []
        for mean, factor, inverse in zip(self.means, self.factors, self.inverses):
            density.append(-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - np.log(np.diag(factor)).sum())
        log_odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1.0 / (1.0 + np.exp(-np.clip(log_odds / TEMPERATURE, -500, 500)))


def _sums(labelled: DataFrame, width: int, centre: list[float], scale: list[float]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By class: rows, sum and sum of outer products of the standardised statistics. A task gives one row a class."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten()).reshape(-1, width)
            z = np.clip((x - np.array(centre)) / np.array(scale), -REACH, REACH)
            quality = np.array(batch.column(1))
            for c in np.unique(quality).tolist():
                own = z[quality == c]
                old = totals.get(c, [0, 0.0, 0.0])
                totals[c] = [old[0] + len(own), old[1] + own.sum(axis=0), old[2] + own.T @ own]
        for c, (n, total, outer) in totals.items():
            flat = pa.array([[*total.tolist(), *outer.ravel().tolist()]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n], pa.int64()), flat], ["quality", "n", "sums"])

    parts = labelled.select("x", F.col("quality").cast("int")).mapInArrow(added, "quality int, n long, sums array<double>")
    entries = parts.select("quality", "n", F.posexplode("sums").alias("at", "value"))
    found: dict[int, dict] = {}
    for r in entries.groupBy("quality", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        found.setdefault(r["quality"], {"n": r["n"]})[r["at"]] = r["value"]
    result = {}
    for c, own in found.items():
        flat = np.array([own[k] for k in range(width + width * width)])
        result[c] = own["n"], flat[:width], flat[width:].reshape(width, width)
    return result


def fitted(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """The discriminant of all rows of ``labelled`` (x, quality 0 or 1)."""
    width = len(FEATURES)
    moments = labelled.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")).collect()
    moments = {r["at"]: r for r in moments}
    if not moments:
        return Discriminant(0.5)
    centre = [moments[k]["mean"] for k in range(width)]
    scale = [max(moments[k]["spread"], 1e-6) for k in range(width)]
    sums = _sums(labelled, width, centre, scale)
    counts = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    prior = (counts[1] + 0.5) / (sum(counts) + 1.0)
    if min(counts) < 2:
        return Discriminant(prior)
    means = tuple(sums[c][1] / sums[c][0] for c in (0, 1))
    own = [sums[c][2] / sums[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.diag(sum(n * s for n, s in zip(counts, own)) / sum(counts)))
    shrunk = [(1 - shrinkage) * s + shrinkage * pooled + FLOOR * np.eye(width) for s in own]
    factors = tuple(np.linalg.cholesky(s) for s in shrunk)
    return Discriminant(prior, np.array(centre), np.array(scale), means, factors, tuple(np.linalg.solve(f, np.eye(width)) for f in factors))


def scored(measures: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of each row of ``measures`` (doc_id, x)."""
    id_type = measures.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return measures.select("doc_id", "x").mapInArrow(rows, f"doc_id {id_type}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels of those whose crc32(doc_id) mod 3 is not 1."""
    measures = checkpointed(measured(table(spark, sf_dir, "documents")))
    held_out = id_crc("doc_id") % 3 == 1
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isin(0, 1) & ~held_out)
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = fitted(checkpointed(measures.join(labels, "doc_id").select("x", "quality")))
    return scored(measures, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
