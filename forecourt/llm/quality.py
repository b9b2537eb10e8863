"""Document quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.llm.common import map_batches, written

#: The statistics, each on a scale where usual texts lie within a few units.
STATISTICS = (
    "log_words", "word_length", "letters", "upper", "digits", "stops", "symbols", "bangs",
    "pipes", "breaks", "distinct", "entropy", "capital_words", "clean_words",
)

_CLASS = np.zeros(256, dtype=np.intp)
for _name, _bytes in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()",
        b"!?", b"|", b"\n", b" \t\r\x0b\x0c"), start=1):
    _CLASS[list(_bytes)] = _name
_CLASS[128:] = 9  # parts of other letters


# As if every text went on for this many characters or words of usual prose: a short text
# differs from prose only as far as it has the length to show it.
_USUAL_BYTES, _USUAL_WORDS = 25.0, 8.0


def _share(part: float, whole: float, usual: float, more: float = _USUAL_BYTES) -> float:
    """A share on the scale of the logistic function, drawn towards the usual one."""
    p = (part + usual * more) / (whole + more)
    return float(np.log(p / (1.0 - p)))


def _rate(part: float, whole: float, usual: float) -> float:
    """The logarithm of how many there are per word, drawn towards the usual number."""
    return float(np.log((part + usual * _USUAL_WORDS) / (whole + _USUAL_WORDS)))


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a whole text; a null text counts as empty."""
    data = (text or "").encode("utf-8")
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=seen, minlength=10)
    words = data.split()
    n, size = len(words), len(data)
    visible = size - by[7] - by[8]
    # Longer texts repeat words by nature; compare with the root of their number.
    distinct = len(set(words))
    shown = seen[seen > 0] / max(size, 1)
    capitals = sum(1 for w in words if w.isupper()) if by[2] > n / 2 else 0
    clean = sum(1 for w in words if w.isalpha())
    return [
        float(np.log1p(n)), _rate(visible, n, 5.0),
        _share(by[1] + by[2] + by[9], visible, 0.95),
        _share(by[2], by[1] + by[2] + by[9], 0.03), _share(by[3], visible, 0.005),
        _share(by[4], visible, 0.03), _share(by[0], visible, 0.005),
        _rate(by[5], n, 0.01), _rate(by[6], n, 0.005), _rate(by[7], n, 0.02),
        float(np.log((distinct + 1) / (n + 1) ** 0.75)), float(-(shown * np.log2(shown)).sum()),
        _share(capitals, n, 0.02, _USUAL_WORDS), _share(clean, n, 0.85, _USUAL_WORDS),
    ]


def with_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and the statistics ``x`` of every whole text."""
    schema = pa.schema([
        ("key", to_arrow_type(docs.schema[key].dataType)), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, schema[1].type)], schema=schema)

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(
        texts, run, f"key {kind}, x array<double>").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes: means, inverse Cholesky factors, and the log-density constants."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The share of class 1 in the density at each row of ``x``, softened by the temperature."""
        logs = []
        for mean, whiten, constant in zip(self.means, self.whiten, self.constants):
            z = (x - mean) @ whiten.T
            logs.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        difference = np.clip((logs[1] - logs[0]) / self.temperature, -700, 700)
        return 1.0 / (1.0 + np.exp(-difference))


def fit(
    labelled: DataFrame, label: str, pooled: float = 0.1, ridge: float = 0.3,
    temperature: float | None = None, prior: float | None = None,
) -> Discriminant | None:
    """Fit the discriminant on rows with statistics ``x`` and a label 0 or 1 (others are left out).

    Counts, sums and sums of products of all rows are taken by Spark; the driver sees one row
    per class. Class covariances are shrunk towards the pooled one by ``pooled``, then
    towards its diagonal by ``ridge``, so that they can be inverted whatever the data, and are
    factored once. ``temperature`` divides the log-density difference, which moves no
    decision; by default the number of statistics. ``prior`` is the share of class 1, by
    default that of the rows. None where a class has no row.
    """
    d = len(STATISTICS)
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("int").alias("c"), *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    found = rows.groupBy("c").agg(
        F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    by = {row["c"]: row for row in found}
    if set(by) != {0, 1}:
        return None
    n = np.array([by[c]["n"] for c in (0, 1)], dtype=float)
    means = np.array([[by[c][f"s{i}"] / by[c]["n"] for i in range(d)] for c in (0, 1)])
    scatter = np.zeros((2, d, d))
    for c in (0, 1):
        for i, j in pairs:
            scatter[c, i, j] = scatter[c, j, i] = (
                by[c][f"p{i}_{j}"] - n[c] * means[c, i] * means[c, j])
    whole = scatter.sum(axis=0) / n.sum()
    whiten, constants = [], []
    shares = n / n.sum() if prior is None else np.array([1 - prior, prior])
    for c in (0, 1):
        shrunk = (1 - pooled) * scatter[c] / n[c] + pooled * whole
        spread = np.diag(shrunk) + 1e-6
        shrunk = (1 - ridge) * shrunk + ridge * np.diag(spread) + 1e-9 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        constants.append(np.log(shares[c]) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(constants), temperature or float(d))


def score(stats: DataFrame, model: Discriminant | None, key: str = "doc_id") -> DataFrame:
    """The key and ``score`` (0 to 1) of rows with statistics ``x``; 0.5 without a model."""
    kind = stats.schema[key].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, len(STATISTICS))
            scores = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], schema=schema)

    return map_batches(
        stats.select(F.col(key).alias("key"), "x"), run, f"key {kind.simpleString()}, score double").withColumnRenamed("key", key)


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
    label: str = "quality", **options,
) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more; the model learns as in ``classify``.

    All columns pass through; rows with null or empty texts, null or repeated keys are judged
    like any other. Nothing but the statistics of labelled rows is moved: the texts are
    judged where they lie, in a second reading.
    """
    known = labels.select(F.col(key).alias("its_key"), F.col(label).alias("its_label"))
    stats = written(with_statistics(docs.where(~held_out(key)), text, key), "statistics")
    model = fit(stats.join(known, F.col(key) == F.col("its_key")), "its_label", **options)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
                continue
            x = np.array([statistics(t.as_py()) for t in batch.column(at)])
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return map_batches(docs, run, docs.schema)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether the key's third of rows is kept from training; false for a null key."""
    third = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3
    return F.coalesce(third == 1, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
    label: str = "quality", **options,
) -> DataFrame:
    """Every row's key with ``held_out``, ``score`` and ``predicted`` (1 where score >= 0.5).

    The model learns from labels of documents that are not held out; nothing but the text
    enters a score. Null and empty texts have statistics and a score, too. Labels other
    than 0 and 1, or without a document, are left out; repeated ones count repeatedly. Rows
    with a null key are scored. Without labels of both classes every score is 0.5. Texts are
    read once; their statistics, a few numbers each, are a written table for the rest.
    """
    stats = written(with_statistics(docs, text, key), "statistics")
    known = labels.select(F.col(key).alias("its_key"), F.col(label).alias("its_label"))
    training = stats.where(~held_out(key)).join(known, F.col(key) == F.col("its_key"))
    model = fit(training, "its_label", **options)
    return score(stats, model, key).select(
        key, held_out(key).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
