"""Mixing sources to target weights by Pfair scheduling.

A source's rows, shuffled by a seeded hash, form blocks. With weight w, block k of a source may start at
time floor(k / w) (release) and must end by ceil((k + 1) / w) (deadline). One block runs at each time; of
the released blocks the one with the earliest deadline runs. On one line whose weights add to 1 this
meets all deadlines, so at any time a source is less than one block ahead of or behind its share.

Releases and deadlines come from the weights as given (to 2**-40), so the bound holds at any length. The
schedule is cut into ranges longer than any block's window. A block's window crosses one edge of a range at
most; which of the crossing blocks run before an edge follows from releases and deadlines near it alone
(``Phase.counts``), so ranges are scheduled on their own, in parallel, each by the tasks that hold its rows.
When a source runs out, the others go on with their weights scaled up, in a new phase whose lags start at
zero; there are at most as many phases as sources. Every row is placed once; no row is dropped or repeated.
With ``slots`` the weights are rounded to whole slots of a period that repeats instead.

At most ``max_sources`` sources have a line of the schedule. Where there are more, the sources without a
weight of their own, and of the others the lightest, share one line with the sum of their weights
("rest"). Its rows are scheduled again among them, in groups of groups of sources, by the same rules.
The driver holds the counts of all sources.

Cases: null and empty source are one source; without weights a source's weight is its row count to the
power ``temper``; weights must be positive, named sources without rows are left out; texts play no part;
rows that repeat an id follow each other by text hash; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import heapq
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import seeded_order, settled, shared_folder, small_side, table
from lossledger.llm.ranks import bucket, ranked

REST = "\x00rest"
#: Weights of the pipeline's mixture; None: row counts to the power ``temper``.
STAGE_WEIGHTS: Mapping[str, float] | None = None
#: Sources, or groups of them, that share a group of the rest line.
GROUP = 32
#: Weights are whole numbers that add to about this.
WHOLE = 1 << 40
#: Slots of a range at least.
RANGE = 1024


@dataclasses.dataclass(frozen=True)
class Settings:
    block_rows: int = 16
    #: Slots of a period to round weights to; None takes the weights as given.
    slots: int | None = None
    max_sources: int = 256
    temper: float = 0.7
    seed: int = 3


def whole_slots(weights: Mapping[str, float], slots: int) -> dict[str, int]:
    """Slots of a period for each source: at least one, near the weights, adding up to ``slots``."""
    total = sum(weights.values())
    exact = {s: max(w / total * slots, 1e-9) for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (left := slots - sum(out.values())) != 0:
        if left > 0:
            by = sorted(out, key=lambda s: (out[s] - exact[s], s))
            for s in by[:left]:
                out[s] += 1
        else:
            by = sorted((s for s in out if out[s] > 1), key=lambda s: (exact[s] - out[s], s))
            for s in by[:-left]:
                out[s] -= 1
    return out


def one_period(share: Mapping[str, int]) -> list[str]:
    """The source that runs in each slot of a period, by earliest deadline among released blocks."""
    slots = sum(share.values())
    w = {s: Fraction(m, slots) for s, m in share.items()}
    coming = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    out = []
    for now in range(slots):
        while coming and coming[0][0] <= now:
            _, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(k + 1) * w[s].denominator // w[s].numerator), s, k))
        deadline, s, k = heapq.heappop(ready)
        if deadline < now + 1:
            raise ArithmeticError("a deadline was missed")
        out.append(s)
        if k + 1 < share[s]:
            heapq.heappush(coming, ((k + 1) * w[s].denominator // w[s].numerator, s, k + 1))
    return out


@dataclasses.dataclass(frozen=True)
class Line:
    """Where the blocks of one source run: per phase its first block, slots of a period, and times."""

    first: tuple[int, ...]
    begin: tuple[int, ...]
    slots: tuple[tuple[int, ...], ...]


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int) -> dict[str, Line]:
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    lines: dict[str, tuple[list, list, list]] = {s: ([], [], []) for s in left}
    begin = 0
    while left:
        share = whole_slots({s: weights[s] for s in left}, max(slots, len(left)))
        at: dict[str, list[int]] = {s: [] for s in left}
        for i, s in enumerate(one_period(share)):
            at[s].append(i)
        periods = min(-(-left[s] // share[s]) for s in left)
        for s in list(left):
            first, begins, places = lines[s]
            first.append(done[s])
            begins.append(begin)
            places.append(tuple(at[s]))
            ran = min(left[s], periods * share[s])
            done[s] += ran
            left[s] -= ran
            if not left[s]:
                del left[s]
        begin += periods * sum(share.values())
    return {s: Line(tuple(a), tuple(b), tuple(c)) for s, (a, b, c) in lines.items()}


@dataclasses.dataclass(frozen=True)
class Phase:
    """A stretch of the schedule of unrounded weights: its first slot, its length, the sources' blocks before it.

    ``last`` is a source whose one block left follows the stretch.
    """

    begin: int
    length: int
    names: tuple
    weight: tuple[int, ...]
    done: tuple[int, ...]
    last: object = None

    @property
    def step(self) -> int:
        return max(RANGE, 2 * -(-sum(self.weight) // min(self.weight)))

    def edges(self, i: int) -> tuple[int, int]:
        ranges = max(1, self.length // self.step)
        return i * self.step, self.length if i >= ranges - 1 else (i + 1) * self.step

    def counts(self, edge: int) -> list[int]:
        """Blocks of each source that run before ``edge``.

        Of the blocks whose window crosses the edge, so many must run by each earlier time that no slot
        stays empty, and of the released ones those with the earliest deadlines do.
        """
        whole = sum(self.weight)
        out = [w * edge // whole for w in self.weight]
        crossing = [i for i, w in enumerate(self.weight) if w * edge % whole]
        if not crossing:
            return out
        release = {i: out[i] * whole // self.weight[i] for i in crossing}
        first = min(release.values())
        back = edge - first
        kind = np.int64 if back < 1 << 22 else object
        ahead = np.arange(1, back + 1).astype(kind)
        slack = -(ahead + first)
        for w in self.weight:
            done, rest = divmod(w * first, whole)
            slack = slack + done - (-(rest + w * ahead) // whole)
        opened = np.bincount([r - first for r in release.values()], minlength=back).cumsum()
        need = np.maximum.accumulate(opened - slack)
        coming = sorted(((r, i) for i, r in release.items()), reverse=True)
        ready: list[tuple[int, int]] = []
        chosen = 0
        for at in np.flatnonzero(np.diff(np.maximum(need, 0), prepend=0)):
            while coming and coming[-1][0] <= first + at:
                i = coming.pop()[1]
                heapq.heappush(ready, (-(-(out[i] + 1) * whole // self.weight[i]), i))
            for _ in range(int(need[at]) - chosen):
                out[heapq.heappop(ready)[1]] += 1
                chosen += 1
        return out

    def scheduled(self, i: int) -> dict:
        """Of range ``i``: each source's blocks before it and the slots of its blocks there."""
        start, stop = self.edges(i)
        whole, before, after = sum(self.weight), self.counts(start), self.counts(stop)
        coming = [(k * whole // w, j, k) for j, (k, n, w) in enumerate(zip(before, after, self.weight)) if k < n]
        heapq.heapify(coming)
        ready: list[tuple[int, int, int]] = []
        at: list[list[int]] = [[] for _ in self.names]
        for now in range(start, stop):
            while coming and coming[0][0] <= now:
                _, j, k = heapq.heappop(coming)
                heapq.heappush(ready, (min(stop, -(-(k + 1) * whole // self.weight[j])), j, k))
            deadline, j, k = heapq.heappop(ready)
            if deadline < now + 1:
                raise ArithmeticError("a deadline was missed")
            at[j].append(now)
            if k + 1 < after[j]:
                heapq.heappush(coming, ((k + 1) * whole // self.weight[j], j, k + 1))
        return {s: (k, np.array(x, np.int64)) for s, k, x in zip(self.names, before, at)}


class Mix:
    """The schedule of so many blocks of each source by unrounded weights; no slot stays empty."""

    def __init__(self, blocks: Mapping, weights: Mapping):
        left = {s: n for s, n in sorted(blocks.items()) if n > 0}
        done = dict.fromkeys(left, 0)
        self.phases: list[Phase] = []
        self._held: dict[tuple[int, int], dict] = {}
        begin = 0
        while left:
            total = sum(Fraction(weights[s]) for s in left)
            weight = {s: max(1, round(Fraction(weights[s]) * WHOLE / total)) for s in left}
            whole = sum(weight.values())
            ends = min(left, key=lambda s: Fraction(left[s], weight[s]))
            length = left[ends] * whole // weight[ends]
            phase = Phase(begin, length, tuple(left), tuple(weight.values()), tuple(done[s] for s in left))
            for s, n in zip(list(left), phase.counts(length)):
                done[s] += n
                left[s] -= n
            begin += length
            if left[ends]:
                phase = dataclasses.replace(phase, last=ends)
                done[ends] += 1
                left[ends] -= 1
                begin += 1
            self.phases.append(phase)
            left = {s: n for s, n in left.items() if n}
        self.first = {s: ([], []) for s in done}
        for i, phase in enumerate(self.phases):
            for s, n in zip(phase.names, phase.done):
                self.first[s][0].append(n)
                self.first[s][1].append(i)

    def _range(self, phase: int, i: int) -> dict:
        if (phase, i) not in self._held:
            if len(self._held) > 7:
                self._held.clear()
            self._held[phase, i] = self.phases[phase].scheduled(i)
        return self._held[phase, i]

    def about(self, source: object, block: np.ndarray) -> np.ndarray:
        """Slots of ``block`` (of one source) if blocks could be split: near the true ones."""
        first, of = (np.array(x) for x in self.first[source])
        at = np.searchsorted(first, block, "right") - 1
        rate = np.array([sum(p.weight) / p.weight[p.names.index(source)] for p in (self.phases[i] for i in of)])
        begin = np.array([self.phases[i].begin for i in of])
        return (begin[at] + (block - first[at]) * rate[at]).astype(np.int64)

    def slots(self, source: object, block: np.ndarray) -> np.ndarray:
        first, of = self.first[source]
        wanted, back = np.unique(block, return_inverse=True)
        out = np.zeros(len(wanted), np.int64)
        at = np.searchsorted(np.array(first), wanted, "right") - 1
        for n in np.unique(at):
            phase = self.phases[of[n]]
            mine = np.flatnonzero(at == n)
            weight, whole = phase.weight[phase.names.index(source)], sum(phase.weight)
            ranges = max(1, phase.length // phase.step)
            k = wanted[mine] - first[n]
            near = np.array([min(int(x) * whole // weight // phase.step, ranges - 1) for x in k])
            for i in np.unique(near):
                some = mine[near == i]
                for j in (int(i), int(i) + 1):  # a block released in a range may run in the next one
                    if not len(some):
                        break
                    if j == ranges:
                        if source != phase.last:
                            raise ArithmeticError("a block has no slot")
                        out[some] = phase.begin + phase.length
                        break
                    before, places = self._range(of[n], j)[source]
                    own = wanted[some] - first[n] - before
                    here = own < len(places)
                    out[some[here]] = phase.begin + places[own[here]]
                    some = some[~here]
        return out[back.reshape(-1)]


def grouped(sizes: Mapping[str, int], weights: Mapping[str, float], most: int) -> tuple[list[Mix], dict[str, list[tuple[int, object]]]]:
    """Schedules of the rows of many sources in groups of groups, and each source's way to the top one.

    A way is a list of (schedule, name there); the slot in one schedule is the block in the next.
    """
    mixes: list[Mix] = []
    ways: dict[str, list[tuple[int, object]]] = {s: [] for s in sizes}
    level = [(s, n, Fraction(weights[s]), [s]) for s, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), most):
            part = level[start : start + most]
            for i, (_, _, _, members) in enumerate(part):
                for s in members:
                    ways[s].append((len(mixes), i))
            mixes.append(Mix({i: x[1] for i, x in enumerate(part)}, {i: x[2] for i, x in enumerate(part)}))
            above.append((len(mixes), sum(x[1] for x in part), sum(x[2] for x in part), [s for x in part for s in x[3]]))
        level = above
    return mixes, ways


def _slots(line: Line, block: np.ndarray, period: Mapping[int, int]) -> np.ndarray:
    out = np.zeros(len(block), np.int64)
    phase = np.searchsorted(np.array(line.first), block, "right") - 1
    for p in np.unique(phase):
        mine = phase == p
        k, places = block[mine] - line.first[p], np.array(line.slots[p])
        out[mine] = line.begin[p] + k // len(places) * period[line.begin[p]] + places[k % len(places)]
    return out


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, settings: Settings = Settings(), carry: bool = False, tie: Column | None = None) -> DataFrame:
    """(doc_id, source, block, slot, place) of every row; with ``carry`` also row, the whole row.

    ``tie`` orders rows that repeat an id; with ``carry`` it is their text's hash by default.

    Rows ordered by (slot, place) are the mixture.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    counts = settled(docs.groupBy(source.alias("line")).agg(F.count("*").alias("line_rows")))
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    rows_of = {r["line"]: r["line_rows"] for r in counts.collect()}  # a row for each source
    total = sum(rows_of.values())
    if weights:
        heavy = sorted((s for s in weights if s in rows_of), key=lambda s: (-weights[s], s))
        weight = {s: weights.get(s, n / total) for s, n in rows_of.items()}
    else:
        heavy = sorted(rows_of, key=lambda s: (-rows_of[s], s))
        weight = {s: float(n) ** settings.temper for s, n in rows_of.items()}
    own = set(heavy if len(heavy) == len(rows_of) <= settings.max_sources else heavy[: settings.max_sources - 1])
    sizes = {s: rows_of[s] for s in own}
    share = {s: weight[s] for s in own}
    others = {s: n for s, n in rows_of.items() if s not in own}
    if others:
        sizes[REST], share[REST] = sum(others.values()), sum(weight[s] for s in others)
    mixes, ways = grouped(others, weight, max(2, min(GROUP, settings.max_sources - 1)))
    blocks = {s: -(-n // settings.block_rows) for s, n in sizes.items()}
    if settings.slots is None:
        top, lines, period = Mix(blocks, share), {}, {}
    else:
        top, lines = None, schedule(blocks, share, settings.slots)
        begins = sorted({b for x in lines.values() for b in x.begin})
        period = {b: sum(len(x.slots[x.begin.index(b)]) for x in lines.values() if b in x.begin) for b in begins}

    line = source
    chosen = [F.col("doc_id"), F.col("source"), line.alias("line"), seeded_order(F.col("doc_id"), settings.seed).alias("h")]
    if carry:
        chosen.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if tie is None:
        tie = F.xxhash64("text") if carry else F.lit(0)
    chosen.append(tie.alias("tie"))
    rows = docs.select(*chosen).join(small_side(counts), "line").withColumn("bucket", bucket(F.col("h") / float(1 << 60), F.col("line_rows")))
    rows = ranked(rows, ["line"], [F.col("h"), F.col("doc_id"), F.col("tie")], "rank")
    columns = ["doc_id", "source", *(["row"] if carry else [])]

    def per_source(batch: pa.RecordBatch, at: Callable[[str, np.ndarray], tuple]) -> list[np.ndarray]:
        rank, names = batch.column("rank").to_numpy(zero_copy_only=False), batch.column("line").dictionary_encode()
        index = names.indices.to_numpy(zero_copy_only=False)
        out = [np.zeros(len(rank), np.int64) for _ in range(3)]
        for i, s in enumerate(names.dictionary.to_pylist()):
            mine = index == i
            for column, x in zip(out, at(s, rank[mine])):
                column[mine] = x
        return out

    def about(s: str, rank: np.ndarray) -> tuple:
        for i, name in ways.get(s, ()):
            rank = mixes[i].about(name, rank)
        return (top.about(s if s in own else REST, rank // settings.block_rows) // RANGE,) if top else ()

    def exactly(s: str, rank: np.ndarray) -> tuple:
        for i, name in ways.get(s, ()):
            rank = mixes[i].slots(name, rank)
        block, known = rank // settings.block_rows, s if s in own else REST
        return block, top.slots(known, block) if top else _slots(lines[known], block, period), rank % settings.block_rows

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(per_source(batch, about)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (pa.array(x) for x in per_source(batch, exactly))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, "block", "slot", "place"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    rows = rows.select(*columns, "line", "rank")
    if top:  # rows of a time range meet, so that it is scheduled once
        rows = rows.mapInArrow(dealt, f"{kinds}, line string, rank long, part long").repartition("part").sortWithinPartitions("part")
    return rows.select(*columns, "line", "rank").mapInArrow(placed, f"{kinds}, block long, slot long, place long")


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def order_folder(spark: SparkSession, docs: DataFrame) -> str:
    """Where the mixture of exactly these rows is kept: named by their count and an order-free digest.

    DataFrame functions only; the sharding stage finds the mixing stage's decision by the same name.
    """
    cols = [F.col(f"`{c}`") for c in sorted(docs.columns)]
    digest = F.sum(F.xxhash64(*cols).cast("decimal(38,0)")) if cols else F.lit(0)
    n, total = docs.agg(F.count(F.lit(1)), digest).first()
    return f"{shared_folder(spark)}/mixture-order-{n}-{total or 0}"


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Pipeline stage: keeps all documents; its decision is the mixture position of every row.

    A stage returns the columns of documents and nothing else, so the mixture of the rows' slim form
    (id, source, size, checksum and text hash: no text is shuffled) goes to ``order_folder`` of these
    rows, with its slot, place and position (slot x block rows + place), where the sharding stage reads it.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    slim = settled(
        docs.select(
            "doc_id",
            "source",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64("text").alias("text_hash"),
        )
    )
    mix = mixed(slim, STAGE_WEIGHTS, settings, carry=True, tie=F.col("text_hash"))
    position = (F.col("slot") * settings.block_rows + F.col("place")).alias("position")
    mix.select("row.doc_id", "row.source", "row.size", "row.text_crc32", "slot", "place", position).write.mode("overwrite").parquet(order_folder(spark, docs))
    return docs
