"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Fitting is two aggregates in Spark over all training rows (counts, sums, sums of products per
class); only these fixed-size sums reach the driver. Each class covariance is shrunk towards the
pooled one and then towards a scaled identity, so that it is positive definite whatever the data.
Scoring subtracts two Mahalanobis log densities; the Cholesky factors are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import in_fold, stored
from wattline.llm.statistics import document_statistics

#: Shrinkage of a class covariance towards the pooled one, and of the result towards the identity.
TOWARDS_POOLED, TOWARDS_IDENTITY = 0.2, 0.02
#: The log-odds are divided by this before they become a score, so that scores keep their order.
TEMPERATURE = 8.0
#: Words of evidence that a share needs: a text of this many words lies halfway to the usual value.
EVIDENCE = 8.0
THRESHOLD = 0.3


def _share(part: str, whole: Column, usual: float, floor: float) -> Column:
    """Log of a share, drawn towards its usual value in short texts."""
    smoothed = (F.col(part) + usual * EVIDENCE) / (whole + EVIDENCE)
    return F.log(smoothed + floor)


def features() -> dict[str, Column]:
    """Transformed statistics, by name; all are finite for every text, the empty one included."""
    words, letters = F.col("n_words"), F.col("n_capitals") + F.col("n_small")
    chars = F.col("word_chars")
    return {
        "symbols": _share("n_symbols", chars, 0.0005, 0.002),
        "capitals": _share("n_capitals", letters, 0.03, 0.01),
        "marks": _share("n_marks", chars, 0.0005, 0.002),
        "bare": _share("n_bare", words, 0.002, 0.01),
        "adjacent": _share("n_adjacent", words, 0.01, 0.02),
        "digits": _share("n_digits", chars, 0.001, 0.005),
        "repeated": _share("n_repeat_words", words, 0.01, 0.05),
        "lines": _share("n_dup_lines", F.col("n_lines"), 0.01, 0.05),
        # How many distinct words a text of its length has, as a power of that length.
        "variety": F.log((F.col("n_distinct") + EVIDENCE) / (words + EVIDENCE)) / F.log(words + 10),
        "word_length": F.log((chars + 5.5 * EVIDENCE) / (words + EVIDENCE)),
    }


FEATURES = tuple(
    "symbols capitals marks bare adjacent digits repeated lines variety word_length".split()
)


def with_features(statistics: DataFrame) -> DataFrame:
    columns = features()
    return statistics.select("id", *(columns[name].alias(name) for name in FEATURES))


@dataclass(frozen=True)
class Model:
    """Means and Cholesky factors of class 0 and 1, and the log prior odds of class 1."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    prior: float
    temperature: float = TEMPERATURE

    def scores(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        for sign, mean, factor in zip((-1.0, 1.0), self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            odds += sign * (-0.5 * (z**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(odds / self.temperature, -700, 700)))


def fit(
    training: DataFrame,
    label: str = "label",
    *,
    towards_pooled: float = TOWARDS_POOLED,
    towards_identity: float = TOWARDS_IDENTITY,
    temperature: float = TEMPERATURE,
) -> Model | None:
    """A model from all rows of ``training`` (``FEATURES`` and a 0/1 label); None if a class has no rows."""
    rows = training.filter(F.col(label).isin(0, 1))
    first = rows.agg(F.count("*").alias("n"), *(F.avg(f).alias(f) for f in FEATURES)).first()
    if first["n"] == 0:
        return None
    # Sums of products about the overall mean, which keeps them free of cancellation.
    centre = {f: first[f] for f in FEATURES}
    about = {f: F.col(f) - F.lit(centre[f]) for f in FEATURES}
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.sum(about[f]).alias(f) for f in FEATURES]
    products = [F.sum(about[FEATURES[i]] * about[FEATURES[j]]).alias(f"p{i}_{j}") for i, j in pairs]
    found = {row[label]: row for row in rows.groupBy(label).agg(F.count("*").alias("n"), *sums, *products).collect()}
    if len(found) < 2:
        return None

    counts = [found[k]["n"] for k in (0, 1)]
    offsets = [np.array([found[k][f] for f in FEATURES]) / found[k]["n"] for k in (0, 1)]
    scatters = []
    for k in (0, 1):
        products = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            products[i, j] = products[j, i] = found[k][f"p{i}_{j}"]
        scatters.append(products - counts[k] * np.outer(offsets[k], offsets[k]))
    pooled = sum(scatters) / sum(counts)
    factors = []
    for k in (0, 1):
        own = scatters[k] / counts[k]
        shrunk = (1 - towards_pooled) * own + towards_pooled * pooled
        # The identity is scaled by each feature's pooled variance; a constant feature gets a small one.
        scale = np.diag(np.maximum(np.diag(pooled), 1e-4))
        factors.append(np.linalg.cholesky((1 - towards_identity) * shrunk + towards_identity * scale))
    mean = np.array([centre[f] for f in FEATURES])
    return Model(
        (mean + offsets[0], mean + offsets[1]),
        (factors[0], factors[1]),
        float(np.log(counts[1] / counts[0])),
        temperature,
    )


def score(featured: DataFrame, model: Model | None) -> DataFrame:
    """``id`` and ``score`` for each row; without a model every document gets 0.5."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            scores = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    kind = featured.schema["id"].dataType.simpleString()
    return featured.mapInArrow(apply, f"id {kind}, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """One 0/1 label per labelled document outside the held-out fold; contradicting labels count as 0."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    return usable.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; only doc_id and text are read.

    Null and empty texts are scored like any other (their shares have the usual values). Without
    rows of both classes in ``labels`` every score is 0.5. Repeated rows get equal scores.
    """
    featured = stored(with_features(document_statistics(docs)), "quality-features")
    model = fit(featured.join(training_labels(labels), "id"))
    return score(featured, model).select(
        F.col("id").alias("doc_id"),
        in_fold(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
