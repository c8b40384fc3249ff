"""Quality classifier: two zstandard dictionaries and a calibrated size difference.

A dictionary is trained on good and another on bad labelled text. Every whole text is compressed in
blocks with either dictionary; the sizes g and b give the features

* (b - g) / (b + g), the normalised difference,
* (b + g) / 2n, the normalised size, which tells repetition that either dictionary packs well,
* the logarithm of a short text's length,

and a logistic fit on labelled rows that built no dictionary turns them into a score. Labels, language,
source and id are no features.

Cases: a null text counts as empty; an empty text gets the score of the intercept and length; ids with
conflicting or null labels teach nothing; without labelled rows of both classes every score is the
share of good rows among those there are (1 if there are none). Further columns are ignored by
``score_documents`` and kept by ``keep_good``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import hash_bar, remainder, table


@dataclasses.dataclass(frozen=True)
class Settings:
    #: Labelled rows of each class that are used to fit, at most; half build the dictionaries.
    sample_rows: int = 1600
    #: Labelled texts longer than this many bytes aren't used to fit (they are scored whole).
    sample_bytes: int = 16_384
    block_bytes: int = 4096
    dictionary_bytes: int = 112_640
    level: int = 3
    threshold: float = 0.7
    held_out: tuple[int, int] = (4, 2)


@dataclasses.dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    block_bytes: int
    level: int


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(content)
    words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=words, level=level, write_content_size=False, write_dict_id=False)


class _Scorer:
    """A model with its compressors; lives in one Python worker or in the driver."""

    def __init__(self, model: Model):
        self.model = model
        self.both = [_compressor(x, model.level) for x in (model.good, model.bad)] if model.good else []

    def features(self, texts: list[bytes]) -> np.ndarray:
        step, sizes = self.model.block_bytes, np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            sizes[i, 2] = len(text)
            for start in range(0, len(text), step):
                block = text[start : start + step]
                for k, packer in enumerate(self.both):
                    sizes[i, k] += len(packer.compress(block))
        good, bad, n = sizes.T
        return np.column_stack(
            [
                20 * (bad - good) / (bad + good + 20),
                4 * (bad + good) / (2 * n + 60),
                np.minimum(0, np.log((n + 1) / 500)),
                np.ones(len(n)),
            ]
        )

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.both:
            return np.full(len(texts), self.model.prior)
        return _sigmoid(self.features(texts) @ np.array(self.model.weights))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ w)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from at most ``sample_rows`` labelled rows of each class, picked by hash of the id."""
    divisor, held = settings.held_out
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .where(remainder(F.col("doc_id"), divisor) != held)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
        .select(F.col("doc_id").alias("marked_id"), F.col("low").alias("quality"))
    )
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 1.0
    ids = None
    for value in (0, 1):  # twice as many ids as rows wanted: some are too long or not in docs
        bar = hash_bar(counts.get(value, 0), 2 * settings.sample_rows)
        some = marked.where((F.col("quality") == value) & (F.xxhash64("marked_id") <= bar)).orderBy(F.xxhash64("marked_id"), "marked_id").limit(2 * settings.sample_rows)
        ids = some if ids is None else ids.unionByName(some)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("marked_id"))
    found = found.where(F.octet_length("text") <= settings.sample_bytes)
    rows: dict[int, list[bytes]] = {}
    for value in (0, 1):  # both limits are small and fixed
        picked = (
            found.where(F.col("quality") == value)
            .select("text", F.xxhash64("marked_id").alias("h"), "marked_id")
            .orderBy("h", "marked_id", F.xxhash64("text"))
            .limit(settings.sample_rows)
            .select("text")
        )
        rows[value] = [t.encode() for t in picked.toArrow()["text"].to_pylist()]
    halves = {v: (rows[v][0::2], rows[v][1::2]) for v in rows}
    empty = Model(b"", b"", (), prior, settings.block_bytes, settings.level)
    if any(len(half) < 1 for v in halves for half in halves[v]):
        return empty
    try:
        good, bad = (_dictionary(halves[v][0], settings) for v in (1, 0))
    except zstandard.ZstdError:  # too little labelled text to build a dictionary from
        return empty
    scorer = _Scorer(dataclasses.replace(empty, good=good, bad=bad))
    x = scorer.features(halves[1][1] + halves[0][1])
    y = np.r_[np.ones(len(halves[1][1])), np.zeros(len(halves[0][1]))]
    share = np.r_[np.full(len(halves[1][1]), prior / len(halves[1][1])), np.full(len(halves[0][1]), (1 - prior) / len(halves[0][1]))]
    weights = _logistic(x, y, share * len(y))
    return dataclasses.replace(scorer.model, weights=tuple(float(v) for v in weights))


def _dictionary(texts: list[bytes], settings: Settings) -> bytes:
    blocks = [t[i : i + settings.block_bytes] for t in texts for i in range(0, len(t), settings.block_bytes)]
    size = min(settings.dictionary_bytes, max(1024, sum(map(len, blocks)) // 4))
    return zstandard.train_dictionary(size, blocks, k=256, d=8).as_bytes()


def score_documents(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``."""
    divisor, held = settings.held_out

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scorer.scores(texts), pa.float64())],
                ["doc_id", "held_out", "score"],
            )

    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), divisor) == held, F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, all columns unchanged."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(scorer.scores(texts) >= settings.threshold, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))
