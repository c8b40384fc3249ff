"""Personal data: rule kinds plus bootstrapped contextual extraction (DataFrame functions only).

Seeds are the entities that the rule kinds find. The word before a seed is a lexical pattern. Patterns and
instances (the strings they introduce) are a graph of two kinds of nodes, scored in rounds: a pattern's
confidence is the score of the instances it introduces over all its occurrences in the corpus, so that a
common word that happens to stand before a seed has next to none; an instance's score is the chance that
one of its patterns is right (seeds have 1). Identifier-like strings that no rule finds, but which a
pattern of high confidence and with several different seeds introduces, are discovered and reported as
kind ``context``.

Positions come from the pieces between matches: a match starts after all pieces and matches before it.
The regular expressions are written with possessive quantifiers and anchored starts, so that they are
linear on long runs and leave matches as they are.

Cases: a null text counts as empty; equal rows have equal results; patterns compare in lower case; an empty
table gives an empty result.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import settled, small_side, table

# Fixed values of the base kinds. A run of a class is matched from its first character on (or from the end
# of the match before), which is where the leftmost match starts anyway. Card runs are taken whole; those
# of other lengths than 16 to 19 digits are dropped, so the pattern asks for the length.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![A-Za-z0-9@._%+()-])(?=[A-Za-z@._%+()-]*+[0-9])(?:[A-Za-z0-9@._%+()-]++(?:[\x20-][0-9()-]{2,}+)++|[A-Za-z0-9@._%+()-]{5,}+)"
BEFORE = r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D\"'(<\[]*$"
WORDS = r"[\x20\x09-\x0D]+"


@dataclasses.dataclass(frozen=True)
class Settings:
    rounds: int = 3
    confidence: float = 0.5
    #: Different seeds that a pattern must have introduced.
    seeds: int = 3
    least_length: int = 5
    #: Characters before an entity in which its pattern word must stand.
    reach: int = 80


def _found(text: Column, pattern: str, needed: str) -> Column:
    """array<struct<start, end, hit>> of all matches, in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda s: s["out"])
    return F.when(text.rlike(needed), walked).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(hit)), ""), lambda d: d != "")
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _small_parts(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: _small_parts(s["hit"]),
    "card": lambda s: _luhn(s["hit"]),
    "phone": lambda s: F.length(_digits(s["hit"])).between(8, 15),
}


def entities(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, doc_id, one array of spans for each kind, others): a row for each row of ``docs``.

    others has the identifier-like strings that overlap no entity; spans have the word before them.
    """
    text = F.col("text_")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text_"))
    every = rows.select(
        F.xxhash64("doc_id", "text_").alias("key"), "doc_id", "text_",
        *[F.filter(_found(text, KINDS[k], NEEDED[k]), VALID[k]).alias(k) for k in KINDS],
        F.filter(_found(text, CANDIDATE, "[0-9]"), lambda s: F.length(s["hit"]) >= settings.least_length).alias("maybe"),
    )
    base = F.concat(*[F.col(k) for k in KINDS])
    others = F.filter("maybe", lambda c: ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))

    def placed(s: Column) -> Column:
        first = F.greatest(s["start"] - settings.reach, F.lit(0))
        before = F.substring(text, first + 1, s["start"] - first)
        word = F.lower(F.regexp_extract(before, BEFORE, 1))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), word.alias("word"))

    return every.select("key", "doc_id", *[F.transform(k, placed).alias(k) for k in KINDS], F.transform(others, placed).alias("others"))


def mentions(found: DataFrame) -> DataFrame:
    """(key, start, end, hit, word, seed): every entity and identifier-like string with a word before it."""
    marked = [
        F.transform(k, _marked(k != "others")) for k in [*KINDS, "others"]
    ]
    return found.select("key", F.explode(F.concat(*marked)).alias("m")).select("key", "m.*").where("word <> ''")


def _marked(seed: bool):  # noqa: ANN202
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), s["word"].alias("word"), F.lit(seed).alias("seed"))


def confident(docs: DataFrame, graph: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, confidence) of the patterns that may introduce unseen identifiers."""
    # equal mentions are one weighted edge, so a hot pattern or instance is small before any join
    edges = settled(graph.groupBy("word", "hit").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    patterns = settled(
        edges.groupBy("word").agg(F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("seeds") >= settings.seeds).select("word")
    )
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), WORDS)).alias("word"))
    total = settled(words.join(small_side(patterns), "word").groupBy("word").agg(F.count("*").alias("all")))
    live = settled(edges.join(small_side(total), "word"))
    scores = live.select("hit", F.col("seed").cast("double").alias("score")).groupBy("hit").agg(F.max("score").alias("score"))
    out = None
    for _ in range(settings.rounds):
        out = settled(
            live.join(scores, "hit")
            .groupBy("word")
            .agg(F.least(F.lit(1.0), F.sum(F.col("n") * F.col("score")) / F.first("all")).alias("confidence"))
        )
        wrong = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = live.join(out, "word").groupBy("hit").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(wrong)).alias("score")
        )
    return out.where(F.col("confidence") >= settings.confidence) if out is not None else total.select("word", F.lit(0.0).alias("confidence")).limit(0)


def personal_data(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``entities`` with one more array, context: the discovered spans."""
    found = settled(entities(docs, settings))
    graph = mentions(found)
    sure = confident(docs, graph, settings)
    new = graph.where("not seed").join(small_side(sure), "word").groupBy(F.col("key").alias("of_key")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "hit", "word"))).alias("context")
    )
    return found.join(new, F.col("key") == F.col("of_key"), "left").drop("of_key")


def _joined(kinds: list[str]) -> Column:
    def named(kind: str):  # noqa: ANN202
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(F.coalesce(F.col(k), F.array()), named(k)) for k in kinds]), ",")


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(list(KINDS)).cast("binary"), 256).alias("base_sha256"),
        _joined([*KINDS, "context"]).alias("spans"),
    )


def _sql() -> str:
    """The same rows from plain patterns, joins and aggregates, with the rounds written out."""
    settings = Settings()
    # as the contract words them; the engine has neither possessive quantifiers nor look-around
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "others": r"[A-Za-z@._%+()-]*[0-9][A-Za-z0-9@._%+()-]*(?:\x20[0-9()-]{2,})*",
    }
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    part = "ltrim(s, '0')"
    fine = {
        "email": "true",
        "ip": f"list_bool_and(list_transform(string_split(h, '.'), lambda s: length({part}) < 3 OR (length({part}) = 3 AND {part} <= '255')))",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: "
        "CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE CAST(c AS INTEGER) * 2 - CASE WHEN c > '4' THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "others": f"length(h) >= {settings.least_length}",
    }
    found = "\nUNION ALL ".join(
        f"SELECT rid, x, {o} AS o, '{k}' AS kind, h, CAST(p AS BIGINT) AS p, CAST(p + length(h) AS BIGINT) AS e FROM (SELECT rid, x, "
        f"string_split_regex(x, '{plain[k]}') AS pieces, regexp_extract_all(x, '{plain[k]}') AS hits, unnest(range(1, len(hits) + 1)) AS i, hits[i] AS h, "
        "list_sum(list_transform(pieces[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda s: length(s))), 0) AS p FROM d) "
        f"WHERE {fine[k]}"
        for o, k in enumerate(plain)
    )
    before = BEFORE.replace("'", "''")
    rounds, last = "", "(SELECT hit, max(CAST(seed AS DOUBLE)) AS score FROM live GROUP BY hit)"
    for i in range(settings.rounds):
        rounds += f"""
c{i} AS (SELECT l.word, least(1.0e0, sum(n * score) / any_value(everywhere)) AS confidence FROM live l JOIN {last} USING (hit) GROUP BY l.word),
s{i} AS (SELECT hit, CASE WHEN bool_or(seed) THEN 1.0e0 ELSE 1 - exp(sum(ln(greatest(1 - confidence, 1e-9)))) END AS score FROM live JOIN c{i} USING (word) GROUP BY hit),"""
        last = f"s{i}"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)
    span = "kind || ':' || p || ':' || e"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
f AS MATERIALIZED ({found}),
m AS MATERIALIZED (
  SELECT rid, kind, o, p, e, h AS hit, o < {len(KINDS)} AS seed,
    lower(regexp_extract(substring(x, greatest(p - {settings.reach}, 0) + 1, p - greatest(p - {settings.reach}, 0)), '{before}', 1)) AS word
  FROM f WHERE o < {len(KINDS)} OR NOT EXISTS (SELECT 1 FROM f b WHERE b.rid = f.rid AND b.o < {len(KINDS)} AND b.p < f.e AND f.p < b.e)),
edges AS (SELECT word, hit, count(*) AS n, bool_or(seed) AS seed FROM m WHERE word <> '' GROUP BY word, hit),
patterns AS (SELECT word FROM edges GROUP BY word HAVING count(*) FILTER (WHERE seed) >= {settings.seeds}),
total AS (SELECT word, count(*) AS everywhere FROM (SELECT unnest(string_split_regex(lower(x), '{WORDS}')) AS word FROM d) SEMI JOIN patterns USING (word) GROUP BY word),
live AS MATERIALIZED (SELECT * FROM edges JOIN total USING (word)),{rounds}
spans AS (
  SELECT rid, kind, o, p, e FROM m WHERE seed
  UNION ALL SELECT DISTINCT rid, 'context', o, p, e FROM m WHERE NOT seed
    AND word IN (SELECT word FROM c{settings.rounds - 1} WHERE confidence >= {settings.confidence})),
g AS (SELECT rid, {counts}, string_agg({span}, ',' ORDER BY o, p, e) AS spans,
  string_agg({span}, ',' ORDER BY o, p) FILTER (WHERE o < {len(KINDS)}) AS base FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


SQL = _sql()
