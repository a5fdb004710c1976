"""Quality by regularised quadratic discriminant analysis of document statistics.

Each whole text becomes a vector of transformed statistics (logarithms of counts, log-odds of shares).
Spark sums the moments of the labelled documents by class; the driver sees two small matrices. A class
covariance is shrunk towards the pooled one and then towards a multiple of the identity, so it is
positive definite for any data. Its Cholesky factor is computed once and cached in the model; a score is
the posterior of class 1 from the difference of log-densities, whose Mahalanobis distances are solved by
that factor. Statistics are held within the range of the labelled documents before they are scored.

Defined cases: null and empty texts have all counts 0 and are scored like any other; labels other than
0 and 1, null labels and labels without a document are left out; repeated labels and rows count each.
With labels of one class only, or none, the score is that class's smoothed share of the labels for every
document. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

STATISTICS = (
    "words", "word_length", "word_length_spread", "longest_word", "upper", "digits", "sentence_ends", "commas", "marks",
    "lines", "shouted_words", "marked_words", "distinct_words", "repeated_lines", "short_words", "non_ascii",
)
#: Shrinkage towards the pooled covariance, then towards the identity.
TOWARDS_POOLED, TOWARDS_IDENTITY = 0.3, 0.05
THRESHOLD = 0.3


def _byte_classes():
    import numpy as np

    kinds = np.zeros(256, np.int8)  # 0: anything else
    for k, chars in enumerate((b" \t\n\r\x0b\x0c", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".!?", b",;:'\"()-"), 1):
        kinds[list(chars)] = k
    kinds[128:] = 7
    return kinds


def statistics(text: str | None):
    """The transformed statistics of one text, in the order of STATISTICS."""
    import numpy as np

    data = (text or "").encode()
    words = data.split()
    n = len(words)
    kinds = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=8) if data else np.zeros(8)
    marks, _, upper, _, digits, ends, commas, other = kinds[[0, 1, 2, 3, 4, 5, 6, 7]].tolist()
    letters = max(1.0, len(data) - kinds[1])
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    shouted = sum(map(bytes.isupper, words))
    marked = len([w for w in words if w[-1] in _MARKS])
    return np.array([
        np.log1p(n), np.log1p(sizes.mean() if n else 0), np.log1p(sizes.std() if n else 0), np.log1p(sizes.max() if n else 0),
        share(upper, letters), share(digits, letters), share(ends, letters), share(commas, letters), share(marks, letters),
        np.log1p(len(lines)), share(shouted, n), share(marked, n), share(len(set(words)), n),
        share(len(lines) - len(set(lines)), len(lines)), share(int((sizes <= 2).sum()), n), share(other, letters),
    ])


_CLASSES = _byte_classes()
_MARKS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~!")


@dataclass(frozen=True)
class Model:
    """Class means, shrunk covariances and log-shares, and the range of each statistic."""

    shares: tuple[float, float]
    means: tuple | None = None
    covariances: tuple | None = None
    low: object = None
    high: object = None

    @cached_property
    def factors(self) -> list[tuple]:
        """(Cholesky factor, half its log-determinant) of each class."""
        import numpy as np

        roots = [np.linalg.cholesky(c) for c in self.covariances]
        return [(root, float(np.log(np.diag(root)).sum())) for root in roots]

    def scores(self, x):
        """Posterior of class 1 for each row of statistics."""
        import numpy as np

        if self.means is None:
            return np.full(len(x), self.shares[1])
        x = np.clip(x, self.low, self.high)
        density = []
        for mean, (root, half), share in zip(self.means, self.factors, self.shares):
            z = np.linalg.solve(root, (x - mean).T)
            density.append(np.log(share) - half - (z * z).sum(axis=0) / 2)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def table_of(texts):
    import numpy as np

    return np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches, "text"):
            x = table_of(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, len(STATISTICS)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(compute, "doc_id long, x array<double>")


def _moments(rows: DataFrame) -> DataFrame:
    """Per class and place of (1, x, x x'): the sum; and per statistic the least and the greatest."""
    p = len(STATISTICS)

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums, low, high = np.zeros((2, 1 + p + p * p)), np.full((2, p), np.inf), np.full((2, p), -np.inf)
        for batch in batches:
            x, label = batch.column("x").flatten().to_numpy().reshape(-1, p), batch.column("quality").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                if len(own):
                    sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    low[c], high[c] = np.minimum(low[c], own.min(axis=0)), np.maximum(high[c], own.max(axis=0))
        pad = np.full((2, 1 + p * p), np.nan)
        parts = [sums, np.hstack([pad[:, :1], low, pad[:, 1:]]), np.hstack([pad[:, :1], high, pad[:, 1:]])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], sums.shape[1]), pa.int32()), pa.array(np.tile(np.arange(sums.shape[1]), 2), pa.int32()),
             *(pa.array(x.ravel(), from_pandas=True) for x in parts)],
            names=["quality", "place", "total", "low", "high"],
        )

    partials = rows.mapInArrow(partial, "quality int, place int, total double, low double, high double")
    return partials.groupBy("quality", "place").agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def fit(docs: DataFrame, labels: DataFrame, pooled: float = TOWARDS_POOLED, identity: float = TOWARDS_IDENTITY) -> Model:
    """The model of all labelled documents."""
    import numpy as np

    p = len(STATISTICS)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = with_statistics(docs).join(known.filter("quality IN (0, 1)"), "doc_id").select("quality", "x")
    total, low, high = np.zeros((2, 1 + p + p * p)), np.full((2, 1 + p), np.inf), np.full((2, 1 + p), -np.inf)
    for c, place, value, least, most in _moments(rows).collect():
        total[c, place] = value
        if least is not None:
            low[c, place], high[c, place] = least, most
    n = total[:, 0]
    shares = tuple(((n + 1) / (n.sum() + 2)).tolist())
    if n.min() == 0:
        return Model(shares)
    means = total[:, 1 : 1 + p] / n[:, None]
    own = [total[c, 1 + p :].reshape(p, p) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    shrunk = []
    for s in own:
        s = (1 - pooled) * s + pooled * both
        shrunk.append((1 - identity) * s + identity * max(float(np.trace(s)) / p, 1e-6) * np.eye(p))
    return Model(shares, tuple(means), tuple(shrunk), low[:, 1:].min(axis=0), high[:, 1:].max(axis=0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches, "text"):
            scores = model.scores(table_of(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(compute, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches, "text"):
            scores = model.scores(table_of(batch.column("text").to_pylist()))
            yield batch.filter(pa.array(scores >= threshold))

    return small_batches(docs).mapInArrow(keep, docs.schema)
