"""Quality rules: an isolation forest on rule statistics.

Rule statistics of every whole text (symbols, shouted words and calls per word, excess word length), rounded to
fifths so that chance differences between ordinary texts don't isolate them, are one row of numbers.
A forest of random trees isolates rows by random splits; rows with short average paths are anomalous.
Each tree grows from ``tree_rows`` rows, as the method has it; they are picked by hash from all rows
that pass the base rules. The verdict's threshold is calibrated on the score histogram of all labelled rows: it rejects as many bad rows as it
can, at ``good_cost`` points for each share of good rows lost. Without labelled rows of both classes only
the base rules reject.

Cases: a null text counts as empty and fails the base rules, as does one without words; labels that
conflict or are null are left out; rows that repeat an id are judged each by its text; an empty table
gives an empty result.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import hash_bar, row_key, settled, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rates that the forest splits on.
RATES = ("symbols", "shouted", "calls", "long_words")
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
SHOUT = re.compile(rb"[A-Z]{2}")


@dataclasses.dataclass(frozen=True)
class Settings:
    min_words: int = 50
    repeat_percent: int = 50
    trees: int = 100
    tree_rows: int = 256
    #: Rows that the trees draw theirs from.
    sample_rows: int = 8192
    good_cost: float = 6.0
    bins: int = 2000
    seed: int = 1


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the rates of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only
    n = len(words)
    if not n:
        return (0,) * len(COUNTS), (0.0,) * len(RATES)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    twice = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                twice += 1
            else:
                seen.add(line)
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        once: set[tuple[bytes, bytes, bytes]] = set()
        more = {w for w in windows if w in once or once.add(w)}
        if more:
            reach = -1
            for i, w in enumerate(windows):
                if w in more:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    calls = len(raw) - len(raw.translate(None, b"!?"))
    shouted = sum(map(bytes.isupper, words)) if SHOUT.search(raw) else 0
    coarse = (symbols / n, shouted / n, calls / n, max(0, chars / n - 6) / 4)
    rates = tuple(int(5 * x + 0.5) / 5 for x in coarse)
    return (n, chars, symbols, twice, repeated), rates


@dataclasses.dataclass(frozen=True)
class Forest:
    """Trees as arrays of one row a tree: feature (-1 at a leaf), split, and the leaf's path length."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    depth: int
    norm: float


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(np.maximum(safe - 1, 1)) + 0.5772156649) - 2 * (safe - 1) / safe, 0.0)


def grow(rows: np.ndarray, settings: Settings) -> Forest:
    """A forest from a sample of rates; nodes are numbered as in a heap."""
    chance = np.random.default_rng(settings.seed)
    size = min(settings.tree_rows, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((settings.trees, nodes), -1, np.int16)
    split, length = np.zeros((settings.trees, nodes)), np.zeros((settings.trees, nodes))
    for t in range(settings.trees):
        todo = [(0, 0, rows[chance.choice(len(rows), size, replace=False)])]
        while todo:
            node, level, part = todo.pop()
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if level == depth or len(part) < 2 or not len(wide):
                length[t, node] = level + float(_mean_path(len(part)))
                continue
            f = int(chance.choice(wide))
            at = chance.uniform(low[f], high[f])
            feature[t, node], split[t, node] = f, at
            left = part[:, f] < at
            todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
            if not left.any() or left.all():  # a split on the edge leaves one side empty
                todo[-2:] = []
                feature[t, node], length[t, node] = -1, level + float(_mean_path(len(part)))
    return Forest(feature, split, length, depth, float(_mean_path(size)) or 1.0)


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Scores from 0 (ordinary) to 1 (anomalous)."""
    total, every = np.zeros(len(rows)), np.arange(len(rows))
    for feature, split, length in zip(forest.feature, forest.split, forest.length):
        node = np.zeros(len(rows), np.int64)
        for _ in range(forest.depth):
            f = feature[node]
            go = f >= 0
            right = rows[every, np.maximum(f, 0)] >= split[node]
            node = np.where(go, 2 * node + 1 + right, node)
        total += length[node]
    return 2.0 ** (-total / len(forest.feature) / forest.norm)


def rule_table(docs: DataFrame) -> DataFrame:
    """(key, doc_id, counts, rates) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or "") for t in batch.column("text").to_pylist()]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(COUNTS))
            rates = np.array([f[1] for f in found]).reshape(-1, len(RATES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), *(pa.array(c) for c in counts.T.copy()), *(pa.array(r) for r in rates.T.copy())],
                ["key", "doc_id", *COUNTS, *RATES],
            )

    schema = f"key string, doc_id {kind}, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{r} double" for r in RATES])
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text").mapInArrow(measured, schema)


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, counts, base_failed, kept, anomaly) of every row of ``docs``."""
    failed = (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.repeat_percent * F.col("n_words"))
    rows = settled(rule_table(docs).withColumn("base_failed", failed))
    marks = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
        .where("quality = high")
        .select(F.col("doc_id").cast("string").alias("marked"), "quality")
    )
    usual = rows.where(~F.col("base_failed"))
    known = settled(usual.join(marks, F.col("key") == F.col("marked")).select("key", "quality", *RATES))
    sample = _sample(usual, settings.sample_rows)
    forest = grow(sample, settings) if len(sample) else None
    bar = _threshold(_scored(known, forest, ["quality"]), settings) if forest else 2.0
    out = _scored(rows, forest, ["doc_id", *COUNTS, "base_failed"])
    return out.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") < bar)).alias("kept"), "anomaly"
    )


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """Rates of at most ``size`` rows, picked by hash."""
    few = rows.where(F.xxhash64("key") <= hash_bar(rows.count(), size))
    picked = few.orderBy(F.xxhash64("key"), "key").limit(size).select(*RATES).toPandas()
    return picked.to_numpy(float)


def _scored(rows: DataFrame, forest: Forest | None, keep: list[str]) -> DataFrame:
    if forest is None:
        return rows.select(*keep, F.lit(0.0).alias("anomaly"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = np.column_stack([batch.column(r).to_numpy(zero_copy_only=False) for r in RATES])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(anomaly(forest, rates))], [*keep, "anomaly"])

    return rows.select(*keep, *RATES).mapInArrow(scored, f"{kinds}, anomaly double")


def _threshold(known: DataFrame, settings: Settings) -> float:
    """The bar with the most bad rows at or above it, less ``good_cost`` times the good ones there."""
    spread = known.groupBy(F.floor(F.col("anomaly") * settings.bins).cast("int").alias("bin"), "quality").count().collect()
    counts = np.zeros((2, settings.bins + 2))
    for r in spread:  # two rows a bin at most
        counts[r["quality"], r["bin"]] += r["count"]
    if not counts.sum(1).all():
        return 2.0
    shares = counts / counts.sum(1, keepdims=True)
    above = shares[:, ::-1].cumsum(1)[:, ::-1]
    gain = above[0] - settings.good_cost * above[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] / settings.bins)


def op1_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
