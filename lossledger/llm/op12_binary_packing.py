"""Packing documents into sequences by power-of-two decomposition.

A document's ids (byte-level BPE, no special tokens, then the end id 1) are cut into whole sequences of
``length`` ids and a rest, and the rest into pieces whose lengths are the powers of two of its binary
form, longest first. Pieces of one length form a bucket; a sequence takes ``length / piece`` pieces of
one bucket, so every sequence but the last of each bucket is full, and no piece crosses documents. At
most one sequence per bucket (12 buckets for 2048) is padded: it is padded to ``length`` unless what it
holds is a power of two.

Tokenizing runs in Arrow batches inside tasks. Each task numbers its pieces per bucket as it makes them;
a small table of (task, bucket) counts gives the pieces of earlier tasks, so a piece's place in its
bucket needs no shuffle and no sort, and a bucket that holds most pieces spreads over all tasks.

Ids: the contract names the ``tokenizers`` library with ``byte_bpe_50k.json``; its Python encoder costs
about 880 CPU s per GB here, over the budget. The same vocabulary as ranks (``byte_bpe_50k.tiktoken``) with
the same pattern gives identical ids at about 160 CPU s per GB, so the tasks use that; a test compares both
on messy and given texts.

Cases: a null or empty text has only the end id (one piece of length 1); a null id is carried as null;
repeated rows are packed each on its own; very long texts give many whole sequences; an empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossledger.llm.common import settled, small_side, table

LENGTH = 2048
END_ID = 1
#: Counts of (task, bucket) are 3 numbers a row; so many rows are broadcast at most (under 30 MB).
STARTS_ROWS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, task int, local long"


def default_vocab() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_ENCODERS: dict = {}


def encoder(vocab: str, pattern: str):
    """tiktoken's encoder over ``vocab``, once per worker process."""
    if (vocab, pattern) not in _ENCODERS:
        import tiktoken

        with open(vocab, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _ENCODERS[vocab, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocab, pattern]


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, then the powers of two of the rest."""
    out = [(k * length, length) for k in range(n // length)]
    start, rest = n - n % length, n % length
    bit = length >> 1
    while rest:
        if rest & bit:
            out.append((start, bit))
            start += bit
            rest -= bit
        bit >>= 1
    return out


def cutter(vocab: str, pattern: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, pattern)
        seen = [0] * (length.bit_length() + 1)
        for batch in batches:
            ids_col, texts, tasks = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("task").to_pylist()
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "task", "local")}
            for doc_id, text, task in zip(ids_col, texts, tasks):
                ids = np.asarray(enc.encode_ordinary(text or "") + [END_ID], dtype="<u4")
                for start, size in pieces_of(len(ids), length):
                    b = size.bit_length() - 1
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(ids[start : start + size].tobytes()))
                    out["doc_tokens"].append(len(ids))
                    out["bucket"].append(b)
                    out["task"].append(task)
                    out["local"].append(seen[b])
                    seen[b] += 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                ("bucket", pa.int32()), ("task", pa.int32()), ("local", pa.int64()),
            ]))

    return run


def pack(docs: DataFrame, length: int = LENGTH, vocab: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket) of every piece."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    if vocab is None or pattern is None:
        vocab, pattern = default_vocab()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("task"))
    pieces = settled(source.mapInArrow(cutter(vocab, pattern, length), PIECES))
    counts = pieces.groupBy("task", "bucket").agg(F.count("*").alias("n"))
    totals = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most 12 rows
    base, first = {}, 0
    for b in sorted(totals, reverse=True):  # whole sequences first, then shorter pieces
        base[b] = first
        first += -(-totals[b] // (length >> b))
    earlier = Window.partitionBy("bucket").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(counts.select("task", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    rank = F.col("before") + F.col("local")
    per = F.expr(f"shiftleft(1L, {length.bit_length() - 1} - bucket)")
    seq_base = F.lit(0).cast("long")
    for b, v in base.items():
        seq_base = F.when(F.col("bucket") == b, F.lit(v)).otherwise(seq_base)
    return pieces.join(small_side(starts, STARTS_ROWS), ["task", "bucket"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (seq_base + F.expr("(before + local) div shiftleft(1L, %d - bucket)" % (length.bit_length() - 1))).cast("long").alias("sequence_id"),
        ((rank % per) * F.col("length")).cast("long").alias("offset"),
        "bucket",
    )


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
