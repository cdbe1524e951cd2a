"""Regularised quadratic discriminant over document statistics.

Each text becomes a few transformed statistics. Per class Spark sums the
statistics and their products over all labelled rows, which gives means and
covariances; a covariance is shrunk towards the pooled one and towards its
diagonal. The score is the difference of the two Gaussian log densities plus
the log prior odds, squashed to [0, 1]; the densities need one triangular
product per text with the inverse of the class's Cholesky factor, computed once.

Nulls and empty texts have the statistics of an empty text and are scored as
any other. Several labels of a document count as several labelled rows, labels
other than 0 and 1 not at all. Without labels of both classes every score is
the share of label 1 (one half without labels). Repeated rows are scored each
on its own. An empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.quality_rules import measure_texts
from tallyline.llm.words import Texts, hash_spans, mix, slices, sums, words_of

STATISTICS = (
    "log_words", "log_word_length", "root_symbols", "root_repeated_lines", "root_repeated_words", "letters",
    "log_lines", "root_digits", "root_capitals", "root_stops", "distinct", "short", "log_line_length",
)
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.1

_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_STOP = np.isin(np.arange(256), list(b".,;:!?"))


def statistics(texts: Texts) -> np.ndarray:
    """One row of STATISTICS per text."""
    m = {name: values.astype(float) for name, values in measure_texts(texts).items()}
    words = words_of(texts)
    owner = words.owner()
    seen = hash_spans(texts.data, words, lower=True) ^ mix(owner.astype(np.uint64), 17)
    order = np.argsort(seen)
    first = np.ones(len(seen), bool)
    first[1:] = seen[order[1:]] != seen[order[:-1]]
    distinct = np.bincount(owner[order[first]], minlength=len(texts))
    n = np.maximum(m["n_words"], 1)
    chars, lines = np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    short = sums(words.end - words.start <= 3, words.before)
    return np.column_stack([
        np.log1p(m["n_words"]),
        np.log1p(m["word_chars"] / n),
        np.sqrt(m["n_symbols"] / n),
        np.sqrt(m["n_dup_lines"] / lines),
        np.sqrt(m["n_repeat_words"] / n),
        np.minimum(m["n_letters"] / chars, 1),
        np.log1p(m["n_lines"]),
        np.sqrt(sums(_DIGIT[texts.data], texts.offsets) / chars),
        np.sqrt(sums(_CAPITAL[texts.data], texts.offsets) / chars),
        np.sqrt(sums(_STOP[texts.data], texts.offsets) / n),
        distinct / n,
        short / n,
        np.log1p(m["word_chars"] / lines),
    ])


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, one double per statistic), one row per row of ``docs``."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                values = statistics(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(values[:, k]) for k in range(len(STATISTICS)))], names=["doc_id", *STATISTICS]
                )

    key = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{name} double" for name in STATISTICS))
    return out.withColumnRenamed("doc_id", id_column)


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor of the covariance, and log density's constant."""

    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    constants: tuple[float, float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [
            c - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1)
            for mean, factor, c in zip(self.means, self.factors, self.constants)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(rows: DataFrame, label: str = "quality", pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    """From rows with STATISTICS and a label; the driver gets one row of sums per class."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums_of = [F.sum(name).alias(f"s{i}") for i, name in enumerate(STATISTICS)]
    sums_of += [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs]
    per_class = rows.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"), *sums_of)
    found = {row.y: row for row in per_class.collect()}
    total = sum(row.n for row in found.values())
    prior = (found[1].n if 1 in found else 0) / total if total else 0.5
    if len(found) < 2:
        return Discriminant(None, None, (0.0, 0.0), prior)
    means, scatters = [], []
    for y in (0, 1):
        row = found[y]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / row.n
        scatter = np.empty((d, d))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = row[f"p{i}_{j}"] / row.n - mean[i] * mean[j]
        means.append(mean)
        scatters.append(scatter)
    together = sum(found[y].n * scatters[y] for y in (0, 1)) / total
    factors, constants = [], []
    for y in (0, 1):
        shrunk = (1 - pooled) * scatters[y] + pooled * together
        shrunk = (1 - diagonal) * shrunk + diagonal * np.diag(np.diag(shrunk))
        shrunk += np.diag(1e-6 + 1e-3 * np.diag(together))
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(found[y].n / total) - np.log(np.diag(lower)).sum()))
    return Discriminant((means[0], means[1]), (factors[0], factors[1]), (constants[0], constants[1]), prior)


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Adds ``score`` to rows with STATISTICS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in STATISTICS])
            yield batch.append_column("score", pa.array(model.score(x), pa.float64()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, score double")
