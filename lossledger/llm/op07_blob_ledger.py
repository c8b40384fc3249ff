"""Secret scans over history: an incremental ledger of content-addressed blobs.

Every historical version of every path holds a blob, addressed by the SHA-256 of its UTF-8 bytes. The
ledger has a row for each pair of blob and rule version that was scanned, with the spans found (none
included). A scan takes the distinct blobs, leaves out the pairs that the ledger has, scans the rest once
and adds them; findings are then joined back to every path and version with the blob. Copies are so
scanned once, and a later run scans only new blobs and new rules.

Cases: a null text counts as an empty blob; repeated rows get equal findings; an empty ledger or table is
fine; further columns of the versions are ignored.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import settled, table


@dataclasses.dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Letters of the pattern match in either case (ASCII only).
    either_case: bool = False
    #: A match whose group of this number is shorter than ``least`` characters is dropped.
    group: int = 0
    least: int = 0


@dataclasses.dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]


# Fixed values of the base kinds. A run of the class is always taken whole, so asking for the least
# length in the pattern equals dropping short matches; for assign it would not, and it is dropped after.
BASE = RuleSet(
    "base-1",
    (
        Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
        Rule("access", r"AKIA[A-Z0-9]{16,}"),
        Rule("hex", r"[0-9a-f]{24,}"),
    ),
)
# Public token formats.
TOKENS = RuleSet(
    "tokens-1",
    (
        Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
        Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
        Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ),
)
RULE_SETS = (BASE, TOKENS)

LEDGER = "blob string, rule_version string, spans array<struct<start:int,kind_order:int,kind:string,end:int>>"
SPAN = pa.struct([("start", pa.int32()), ("kind_order", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans(text: str, rules: Sequence[tuple[int, Rule, re.Pattern]]) -> list[dict]:
    out = []
    for order, rule, pattern in rules:
        for m in pattern.finditer(text):
            if not rule.least or m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append({"start": m.start(), "kind_order": order, "kind": rule.kind, "end": m.end()})
    return out


def compiled(rule_sets: Sequence[RuleSet]) -> dict[str, list[tuple[int, Rule, re.Pattern]]]:
    out, order = {}, 0
    for rules in rule_sets:
        out[rules.version] = []
        for rule in rules.rules:
            flags = re.ASCII | (re.IGNORECASE if rule.either_case else 0)
            out[rules.version].append((order, rule, re.compile(rule.pattern, flags)))
            order += 1
    return out


def scanned(blobs: DataFrame, rule_sets: Sequence[RuleSet]) -> DataFrame:
    """Ledger rows of (blob, text, todo): todo names the rule versions to apply."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = compiled(rule_sets)
        for batch in batches:
            names, versions, found = [], [], []
            for blob, text, todo in zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "todo"))):
                for version in todo:
                    names.append(blob)
                    versions.append(version)
                    found.append(spans(text or "", rules[version]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(versions, pa.string()), pa.array(found, pa.list_(SPAN))],
                ["blob", "rule_version", "spans"],
            )

    return blobs.select("blob", "text", "todo").mapInArrow(scan, LEDGER)


def extended(versions: DataFrame, ledger: DataFrame | None = None, rule_sets: Sequence[RuleSet] = RULE_SETS) -> DataFrame:
    """The ledger with all pairs of the blobs in ``versions`` (column text) and the rule versions."""
    blobs = versions.select(blob_name(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.version) for r in rule_sets])
    if ledger is None:
        return settled(scanned(blobs.withColumn("todo", every), rule_sets))
    seen = ledger.groupBy(F.col("blob").alias("old")).agg(F.collect_set("rule_version").alias("seen"))
    # names are matched first, so that no text of a known blob is shuffled for the join
    todo = (
        versions.select(blob_name(F.col("text")).alias("name")).distinct()
        .join(seen, F.col("name") == F.col("old"), "left")
        .select("name", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        .where(F.size("todo") > 0)
    )
    fresh = scanned(blobs.join(todo, F.col("blob") == F.col("name")).select("blob", "text", "todo"), rule_sets)
    return settled(ledger.select("blob", "rule_version", "spans").unionByName(fresh))


def findings(paths: DataFrame, ledger: DataFrame, rule_sets: Sequence[RuleSet] = RULE_SETS) -> DataFrame:
    """Every row of ``paths`` (with a column blob) and ``found``, its blob's spans in order."""
    wanted = [r.version for r in rule_sets]
    by_blob = (
        ledger.where(F.col("rule_version").isin(wanted))
        .groupBy(F.col("blob").alias("of_blob"))
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    )
    return paths.join(by_blob, F.col("blob") == F.col("of_blob"), "left").drop("of_blob")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = extended(docs)
    base = F.filter("found", lambda s: s["kind_order"] < len(BASE.rules))
    counts = [F.size(F.filter("found", _of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE.rules]
    paths = docs.select("doc_id", blob_name(F.col("text")).alias("blob"))
    return findings(paths, ledger).select(
        "doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )


def _sql() -> str:
    """The same rows from split and extract; patterns spell out either case, as engines fold differently."""
    kinds = []
    for order, rule in enumerate(r for rules in RULE_SETS for r in rules.rules):
        pattern = rule.pattern.replace("'", "''")
        if rule.either_case:
            names, rest = pattern[1:].split(")", 1)
            cased = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)
            pattern = f"({cased}){rest}"
        least = f"length(regexp_extract(h, '{pattern}', {rule.group})) >= {rule.least}" if rule.least else "true"
        kinds.append(
            f"SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, i, p, h, {least} AS fine FROM (SELECT doc_id, "
            f"string_split_regex(x, '{pattern}') AS pieces, regexp_extract_all(x, '{pattern}') AS hits, "
            "unnest(range(1, len(hits) + 1)) AS i, hits[i] AS h, "
            "list_sum(list_transform(pieces[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda s: length(s))), 0) AS p FROM d)"
        )
    union = "\nUNION ALL ".join(kinds)
    base = len(BASE.rules)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE.rules)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS (SELECT doc_id, o, kind, CAST(p AS BIGINT) AS p, kind || ':' || CAST(p AS BIGINT) || ':' || CAST(p + length(h) AS BIGINT) AS span FROM ({union}) WHERE fine),
g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY p, o) AS spans, string_agg(span, ',' ORDER BY p, o) FILTER (WHERE o < {base}) AS base FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE.rules)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
