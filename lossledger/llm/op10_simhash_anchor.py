"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link at up to 4 differing bits. They are cut into segments of 21, 21 and 22 bits;
linked fingerprints differ in at most one bit of some segment. On a segment the anchors are the words of
a covering code: a Hamming code of 15 bits (covering radius 1, perfect) beside the free bits. Every
fingerprint has a home, the anchor within the covering radius, and is replicated to every anchor within
covering radius plus threshold (1 + 1), where it meets the homes of all partners. Two words one bit apart
have different parity, so only words of odd parity are replicated; even ones go to their home alone.

Equal fingerprints are one node before anything is compared. At an anchor, homes are compared with the
replicas by vectorised XOR and bit counts, and only a spanning forest of the links found leaves the task.
Anchors with many homes are cut into blocks of homes x blocks of replicas, so no task holds more than
a block of either. Links become components by ``components.roots``.

Cases: a null text counts as empty; texts without a word have fingerprint zero and link like others;
repeated rows get equal results, and rows of one id with different texts are judged apart; a null id gets its group's smallest id and null if there is none; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import settled, small_side, table
from lossledger.llm.components import roots

SHINGLE_WORDS = 4
MAX_BITS = 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: Homes, and replicas, that one comparison task holds of an anchor at most.
BLOCK = 4096


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    words = text.lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(line, 42)]
    else:
        stops = ends[size - 1 :]
        hashes = [digest(line[a : b - 1], 42) for a, b in zip([0, *ends[: len(stops) - 1]], stops)]
    values, ones = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for start in range(0, len(values), 1 << 15):
        part = values[start : start + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every 15-bit word: its syndrome; of every syndrome: the flips that lead to the codewords
    within distance 2 (the nearest first; -1 where there is none)."""
    words = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(CODE_BITS):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    flips = np.full((16, 8), -1, np.int64)
    for s in range(16):
        pairs = [1 << (a - 1) | 1 << (b - 1) for a in range(1, 16) for b in range(a + 1, 16) if a ^ b == s]
        reach = [0] if s == 0 else [1 << (s - 1), *pairs]
        flips[s, : len(reach)] = reach
    return syndrome, flips


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, role, index into ``prints``) of every copy to send; role 0 is a home, 1 a replica."""
    syndrome, flips = _tables()
    keys, roles, rows = [], [], []
    index = np.arange(len(prints))
    for k, (first, bits) in enumerate(SEGMENTS):
        word = (prints >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        code, free = word & ((1 << CODE_BITS) - 1), word >> CODE_BITS
        flip = flips[syndrome[code]]
        home = (code ^ flip[:, 0]) | free << CODE_BITS
        odd = (np.bitwise_count(word) & 1).astype(bool)
        sent = [(home, 0, index), (home, 1, index)]
        for j in range(1, flip.shape[1]):  # two code bits away at most
            some = odd & (flip[:, j] >= 0)
            sent.append(((code ^ flip[:, j] | free << CODE_BITS)[some], 1, index[some]))
        for bit in range(CODE_BITS, bits):  # a free bit and the code's radius
            sent.append((home[odd] ^ (1 << bit), 1, index[odd]))
        for key, role, row in sent:
            keys.append(key | k << 40)
            roles.append(np.full(len(key), role, np.int8))
            rows.append(row)
    return np.concatenate(keys), np.concatenate(roles), np.concatenate(rows)


class _Forest:
    """Least-label union of positions, vectorised over links."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.of[a], self.of[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while (up := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = up


def _links(key: np.ndarray, role: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints within ``most`` bits that meet at one key."""
    order = np.lexsort((role, key))
    key, role, prints = key[order], role[order], prints[order]
    nodes, at = np.unique(prints, return_inverse=True)
    forest = _Forest(len(nodes))
    first = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(first) - 1
    ends = np.r_[np.flatnonzero(first)[1:], len(key)][group]
    begins = np.flatnonzero(first) + np.bincount(group, weights=role == 0).astype(np.int64)
    home = np.flatnonzero(role == 0)
    other, end = begins[group[home]], ends[home]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    while len(home):
        live = other < end
        if not live.all():
            home, other, end = home[live], other[live], end[live]
        near = np.bitwise_count(prints[home] ^ prints[other]) <= most
        if near.any():
            held.append((at[home[near]], at[other[near]]))
            size += len(held[-1][0])
            if size > 500_000:
                forest.link(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        other = other + 1
    if held:
        forest.link(*(np.concatenate(x) for x in zip(*held)))
    moved = np.flatnonzero(forest.of != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.of[moved]]


def copy_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and its text's hash; rows that agree in both are copies of one document."""
    return F.concat_ws(" ", doc_id.cast("string"), F.xxhash64(text).cast("string"))


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(prints)], ["key", "doc_id", "fp"])

    rows = docs.select(copy_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(printed, "key string, doc_id long, fp long")


def links(nodes: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``nodes`` (distinct fp) within ``most`` bits."""
    if most > 2 * len(SEGMENTS) - 2 + 1:
        raise ValueError("one differing bit a segment is covered: at most 5 bits in all")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(prints), 4096):
                part = prints[start : start + 4096]
                key, role, row = anchors(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(role), pa.array(part[row].view(np.int64))], ["anchor", "role", "fp"]
                )

    copies = nodes.select("fp").mapInArrow(sent, "anchor long, role byte, fp long")
    hot = settled(
        copies.groupBy("anchor")
        .agg(F.sum((F.col("role") == 0).cast("long")).alias("homes"), F.sum((F.col("role") == 1).cast("long")).alias("others"))
        .where((F.col("homes") > block) | (F.col("others") > 4 * block))
        .select(
            F.col("anchor").alias("hot"),
            F.ceil(F.col("homes") / block).cast("int").alias("rows"),
            F.ceil(F.col("others") / block).cast("int").alias("cols"),
        )
    )
    cut = copies.join(small_side(hot), F.col("anchor") == F.col("hot"), "left").select(
        "anchor", "role", "fp", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("cols", F.lit(1)).alias("cols")
    )
    # a home meets all blocks of replicas, a replica all blocks of homes
    home = F.col("role") == 0
    own = F.pmod(F.xxhash64("fp"), F.when(home, F.col("rows")).otherwise(F.col("cols"))).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.when(home, F.col("cols")).otherwise(F.col("rows")) - 1))
    dealt = cut.select("anchor", "role", "fp", "cols", own.alias("own"), spread.alias("met")).select(
        "anchor", F.when(home, F.col("own") * F.col("cols") + F.col("met")).otherwise(F.col("met") * F.col("cols") + F.col("own")).alias("cell"), "role", "fp"
    )
    met = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        rows = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            column = {n: table[n].to_numpy() for n in ("anchor", "cell", "role", "fp")}
            _, key = np.unique(np.column_stack([column["anchor"], column["cell"]]), axis=0, return_inverse=True)
            a, b = _links(key.ravel(), column["role"], column["fp"].view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            whole = pa.Table.from_batches(parts)
            anchor, cell = whole["anchor"].to_numpy(), whole["cell"].to_numpy()
            last = np.flatnonzero((anchor != anchor[-1]) | (cell != cell[-1]))
            if len(last):  # the last group may go on in the next batch
                cut_at = int(last[-1]) + 1
                yield done(whole.slice(0, cut_at))
                parts, rows = whole.slice(cut_at).to_batches(), len(whole) - cut_at
        if parts:
            yield done(pa.Table.from_batches(parts))

    return met.mapInArrow(compared, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root) of all distinct fingerprints; root names the group."""
    nodes = settled(prints.select("fp").distinct())
    found = roots(links(nodes), "a", "b")
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, doc_id, fp, component_id, keeper): keeper is the key of the group's row to keep."""
    prints = settled(fingerprints(docs, size))
    of = groups(prints)
    # per fingerprint first, so that a group of copies is one row before the joins
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    by_print = prints.groupBy("fp").agg(F.min(first).alias("first")).join(of, "fp")
    best = by_print.groupBy("root").agg(F.min("first").alias("best"))
    named = by_print.select("fp", "root").join(best, "root").select(
        F.col("fp").alias("of_fp"), F.col("best.doc_id").alias("component_id"), F.col("best.key").alias("keeper")
    )
    return prints.join(named, prints["fp"] == named["of_fp"]).select("key", "doc_id", "fp", "component_id", "keeper")


def op10_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: the smallest id's (a named row before unnamed ones); all columns.

    Rows of one id with different texts are different documents, each judged in its own group.
    """
    found = near_duplicates(docs).where("key = keeper").select("key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), copy_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    kept = rows.join(found, F.col("row_key") == F.col("key"), "left_semi")
    # rows that repeat id and text are copies of one document; the join has dealt them by both already
    return kept.groupBy("row_key").agg(F.first("row").alias("row")).select("row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays."""
    return keep_one(docs)
