"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts are compared as code points, lower-cased where that keeps a character one character, with white
space as a space. An item of m characters may lie in a document with up to k = rate * m edits. Such a
region shares at least m - q + 1 - kq q-grams with the item, all on diagonals (document position minus
item position) that lie within k of each other. Shared q-grams are counted in overlapping bands of
2(k + 1) diagonals, each starting k + 1 after the last, so that one band holds them all; bands that reach
the bound are verified by an alignment that stays in the band's diagonals.

The benchmark is the stated query set. It is taken in blocks of ``block_chars``; every block passes over
all documents, which are neither shuffled nor cut. A very long text is looked at in pieces that overlap
by more than the longest region.

Cases: null texts and items count as empty; items under ``shortest`` characters tell nothing and match
nothing; items that repeat an id or a text are matched each; an empty benchmark gives no match.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import table


@dataclasses.dataclass(frozen=True)
class Settings:
    q: int = 10
    rate: float = 0.08
    shortest: int = 20
    #: Characters of benchmark text in a block.
    block_chars: int = 8_000_000
    #: Characters of documents looked at together.
    piece_chars: int = 262_144


def _folding() -> np.ndarray:
    """Of every code point of the basic plane: its lower case if that is one, a space for white space."""
    to = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        char = chr(i)
        if i == 0 or char.isspace():
            to[i] = 32
        elif char.isupper() and len(low := char.lower()) == 1 and ord(low) < 0x10000:
            to[i] = ord(low)
    return to


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes (mod 2**32) of all windows of q codes (uint32).

    Two q-grams with one hash only raise a band's count: alignment decides.
    """
    step = np.array([0x9E3779B1], np.uint32)
    power, size = codes * step, 1
    power ^= power >> np.uint32(15)
    whole, done, factor = None, 0, step.copy()
    while True:
        if q & 1:
            if whole is None:
                whole, done = power, size
            else:
                n = len(codes) - done - size + 1
                whole, done = whole[: max(n, 0)] * factor + power[done : done + max(n, 0)], done + size
        q >>= 1
        if not q:
            return whole
        n = max(len(power) - size, 0)
        power = power[:n] * factor + power[size : size + n]
        size, factor = size * 2, factor * factor


class _Index:
    """q-grams of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], settings: Settings):
        self.settings, self.folding = settings, _folding()
        q = settings.q
        self.ids, self.codes = [], []
        for item, text in items:
            codes = self.fold(text)
            if len(codes) >= max(settings.shortest, q):
                self.ids.append(item)
                self.codes.append(codes)
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size = size
        self.budget = np.minimum((settings.rate * size).astype(np.int64), (size - q) // q)
        self.bound = size - q + 1 - self.budget * q
        self.longest = int((size + 4 * self.budget).max(initial=0)) + 8
        if not self.codes:
            return
        grams = [_grams(c, q) for c in self.codes]
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.r_[first, len(every)]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.shift = np.uint32(32 - max(16, min(26, len(every).bit_length() + 5)))
        self.seen = np.zeros(1 << (32 - int(self.shift)), bool)
        self.seen[self.grams >> self.shift] = True

    def fold(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes) or codes.max() < 0x10000:
            return self.folding[codes]
        low = codes < 0x10000
        return np.where(low, self.folding[np.where(low, codes, 0)], codes)

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last diagonal) of every band of ``codes`` that reaches the item's bound."""
        if len(codes) < self.settings.q:
            return
        grams = _grams(codes, self.settings.q)
        place = np.flatnonzero(self.seen[grams >> self.shift])
        slot = np.searchsorted(self.grams, grams[place])
        slot[slot == len(self.grams)] = 0
        same = self.grams[slot] == grams[place]
        place, slot = place[same], slot[same]
        count = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        item, step = self.item[entry], self.budget[self.item[entry]] + 1
        band = (np.repeat(place, count) - self.at[entry] + self.longest) // step
        wide = len(codes) + 2 * self.longest + 2
        key, at = np.r_[item * wide + band, item * wide + band - 1], np.tile(self.at[entry], 2)
        place = np.unique(key * self.longest + at) // self.longest  # a place of the item counts once
        key, n = np.unique(place, return_counts=True)
        item, band = key // wide, key % wide
        full = n >= self.bound[item]
        for i, b in zip(item[full].tolist(), band[full].tolist()):
            step = int(self.budget[i]) + 1
            yield i, b * step - self.longest, (b + 2) * step - 1 - self.longest

    def verified(self, codes: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best region on the diagonals low to high, if within the budget."""
        most, pattern = int(self.budget[item]), self.codes[item]
        begin, end = max(0, low - most), min(len(codes), high + most + len(pattern))
        text = codes[begin:end]
        where = text.tobytes().find(pattern.tobytes())
        while where >= 0 and where % 4:
            where = text.tobytes().find(pattern.tobytes(), where + 1)
        if where >= 0:
            return 0, begin + where // 4, begin + where // 4 + len(pattern)
        edits, stop = _aligned(pattern, text, low - most - begin, high + most - begin, most)
        if edits > most:
            return None
        # the same from the end backwards gives where the region starts
        head = text[:stop][::-1]
        over = len(head) - len(pattern)
        _, back = _aligned(pattern[::-1], head, -most, min(most, over + most), most, fixed=True)
        return edits, begin + stop - back, begin + stop


def _aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int, fixed: bool = False) -> tuple[int, int]:
    """Least edits of the whole pattern against a piece of ``text``, and that piece's end.

    The alignment stays on diagonals low to high; the piece starts anywhere there (``fixed``: at 0).
    """
    far = len(pattern) + most + 1
    diagonals = np.arange(low, high + 1)
    width = np.arange(len(diagonals))
    padded = np.concatenate([np.zeros(max(0, -low), np.uint32), text, np.zeros(max(0, len(pattern) + high - len(text)) + 1, np.uint32)])
    shift = max(0, -low) + low
    column = diagonals  # end of the text's piece before row 0
    inside = (column >= 0) & (column <= len(text))
    costs = np.where(inside, 0 if not fixed else np.maximum(column, 0), far)
    for row, char in enumerate(pattern.tolist()):
        part = padded[shift + row : shift + row + len(width)]
        column = diagonals + row + 1
        new = costs + (part != char)
        new[column < 1] = far
        np.minimum(new[:-1], costs[1:] + 1, out=new[:-1])
        new[(column < 0) | (column > len(text))] = far
        costs = np.minimum.accumulate(new - width) + width
        costs[(column < 0) | (column > len(text))] = far
    best = int(costs.argmin())
    return int(costs[best]), int(diagonals[best] + len(pattern))


Match = tuple[int, "int | None", int, int, int, int]


def _matches(texts: list[str], index: _Index) -> list[Match]:
    """(row, item id, start, end, edits, regions) for each row and item that matches."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    if not index.codes:
        return []
    limit = max(index.settings.piece_chars, 4 * index.longest)

    def look(codes: np.ndarray, starts: list[tuple[int, int, int]]) -> None:
        """starts: (position in codes, row, position in its text) of each piece in order."""
        begins = np.array([s[0] for s in starts] + [len(codes)])
        for item, low, high in index.candidates(codes):
            reach = int(index.size[item] + index.budget[item])
            first = max(0, int(np.searchsorted(begins, max(low, 0), "right")) - 1)
            last = max(first, int(np.searchsorted(begins, min(high + reach, len(codes) - 1), "right")) - 1)
            for k in range(first, min(last, len(starts) - 1) + 1):
                a, b = int(begins[k]), int(begins[k + 1]) - 1
                most = int(index.budget[item])
                if min(b, high + reach + most) - max(a, low - most) < index.size[item] - most:
                    continue  # too little of this text lies on the band's diagonals
                if (best := index.verified(codes[a:b], item, low - a, high - a)) is not None:
                    at = starts[k][2]
                    found.setdefault((starts[k][1], item), []).append((best[0], best[1] + at, best[2] + at))

    gap = np.zeros(1, np.uint32)  # no text has it, so no q-gram spans two texts
    held: list[np.ndarray] = []
    starts: list[tuple[int, int, int]] = []
    size = 0
    for row, text in enumerate(texts):
        codes = index.fold(text)
        for at in range(0, max(1, len(codes)), limit - index.longest):
            piece = codes[at : at + limit]
            starts.append((size, row, at))
            held += [piece, gap]
            size += len(piece) + 1
            if size >= limit:
                look(np.concatenate(held), starts)
                held, starts, size = [], [], 0
            if at + limit >= len(codes):
                break
    if held:
        look(np.concatenate(held), starts)
    out = []
    for (row, item), regions in sorted(found.items()):
        edits, start, end = min(regions)
        apart, last = 0, -1
        for _, a, b in sorted(regions, key=lambda r: r[1:]):
            if a >= last:
                apart, last = apart + 1, b
        out.append((row, index.ids[item], start, end, edits, apart))
    return out


def blocks(benchmark: DataFrame, settings: Settings = Settings()) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, one at a time."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= settings.block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, start, end, edits, regions): one row for each document row and item in it."""
    rows = docs.select("doc_id", "text")
    names = ["doc_id", "item_id", "start", "end", "edits", "regions"]
    kinds = {n: f.dataType.simpleString() for n, f in (("doc_id", docs.schema["doc_id"]), ("item_id", benchmark.schema["item_id"]))}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start long, end long, edits int, regions int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, settings):

        def looked(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _Index(block, settings)
            for batch in batches:
                found = _matches([t or "" for t in batch.column("text").to_pylist()], index)
                row, item, start, end, edits, regions = zip(*found) if found else [()] * 6
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32()), pa.array(regions, pa.int32())]
                if found:
                    yield pa.RecordBatch.from_arrays(columns, names)

        out = out.unionByName(rows.mapInArrow(looked, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without any item, all columns unchanged."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, settings):

        def kept(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _Index(block, settings)
            for batch in batches:
                hit = {m[0] for m in _matches([t or "" for t in batch.column(at).to_pylist()], index)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))
