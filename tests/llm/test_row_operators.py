"""Operators on rows of a table: near-duplicates, mixing, sharding."""

import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lossledger.llm import components, op03_pfair, op08_stratified, op10_simhash_anchor


def fingerprint(text, size=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, prose):
    texts = ["", "one", "One two Three", "a b c d", "a b c d e É", prose(500, 3)]
    for text in texts:
        assert op10_simhash_anchor.fingerprint(text.encode()) == fingerprint(text)
    (h,) = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()
    assert h % 2**64 == fingerprint("a b c d")


def grouped(prints, most):
    of = list(range(len(prints)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= most) + i + 1:
            a, b = root(i), root(int(j))
            of[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("block", [4096, 7])
def test_anchor_links_match_brute_force(spark, block):
    """Clusters of prints some bits apart, chains among them; small blocks split every busy anchor."""
    chance = np.random.default_rng(1)
    prints = list(chance.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2))
    for _ in range(900):
        base = prints[chance.integers(0, len(prints))]
        for bit in chance.choice(64, chance.integers(1, 7), replace=False):
            base = base ^ (np.uint64(1) << np.uint64(bit))
        prints.append(base)
    prints = np.unique(np.array([*prints, 0, 1], np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    found = components.roots(op10_simhash_anchor.links(nodes, block=block), "a", "b").collect()
    got = {r["node"]: r["root"] for r in found}
    expected = grouped(prints, 4)
    mine = [got.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(zip(mine, expected))) == len(set(expected)) == len(set(mine))
    assert len(set(expected)) < len(prints) / 2


def test_near_duplicate_components(spark, prose):
    texts = [prose(200, i % 25) for i in range(60)] + ["", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op10_simhash_anchor.near_duplicates(docs).collect()}
    expected = grouped(np.array([fingerprint(t or "") for t in texts], np.uint64), 4)
    assert [got[i]["component_id"] for i in range(len(texts))] == expected
    kept = sorted(r["doc_id"] for r in op10_simhash_anchor.keep_one(docs).collect())
    assert kept == sorted(set(expected))


def test_one_id_with_two_texts_loses_no_group(spark, prose):
    """Id 1 has texts A and B, each the keeper of its own group; id 2 has C, a near copy of a kept text, and D."""
    a, b, c, d = (prose(200, 900 + i) for i in range(4))
    docs = spark.createDataFrame([(1, a), (1, b), (3, a), (4, b), (0, c), (2, c), (2, d), (1, a)], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in op10_simhash_anchor.keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, b), (0, c), (2, d)])


def test_components_of_chains_and_stars(spark):
    chance = random.Random(4)
    ids = list(range(1000))
    chance.shuffle(ids)
    links = list(zip(ids[:200], ids[1:200])) + [(ids[300], x) for x in ids[301:600]] + [(7, 7), (None, 3), (ids[700], ids[701]), (ids[701], ids[700])]
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    for part in (ids[:200], ids[300:600], ids[700:702]):
        assert {got.get(x, x) for x in part} == {min(part)}


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 1, "c": 1, "d": 7}, {f"s{i}": 1 + i * i for i in range(40)}])
def test_period_deviates_by_less_than_a_block(weights):
    share = op03_pfair.whole_slots(weights, 240)
    assert sum(share.values()) == 240 and min(share.values()) >= 1
    line = op03_pfair.one_period(share)
    done = dict.fromkeys(share, 0)
    for now, source in enumerate(line):
        done[source] += 1
        for s, m in share.items():
            assert abs(done[s] - Fraction(m * (now + 1), 240)) < 1


def test_mixture_places_every_row_once_and_keeps_its_shares(spark):
    rows = [(i, "a" if i % 3 == 0 else f"s{i % 7}", f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    settings = op03_pfair.Settings(block_rows=4, slots=60)
    got = op03_pfair.mixed(docs, {"a": 0.5, "s1": 0.25, "s2": 0.25}, settings).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    assert len({(r["slot"], r["place"]) for r in got}) == 3000
    order = sorted({(r["slot"], r["source"] if r["source"] in ("a", "s1", "s2") else "rest", r["block"]) for r in got})
    assert len({s for s, _, _ in order}) == len(order)  # one block at a time
    total = len([1 for _, s, _ in order])
    assert total == sum(-(-n // 4) for n in (1000, *[sum(r[1] == s for r in rows) for s in ("s1", "s2")], sum(r[1] not in ("a", "s1", "s2") for r in rows)))
    # until the first source runs out, each is within a block of its share of the slots
    weights = {"a": 0.5, "s1": 0.25, "s2": 0.25}
    weights["rest"] = sum(r[1] not in weights for r in rows) / len(rows)
    share = op03_pfair.whole_slots(weights, 60)
    last = {s: max(x for x, y, _ in order if y == s) for s in share}
    done = dict.fromkeys(share, 0)
    for slot, s, _ in order:
        if slot > min(last.values()):
            break
        done[s] += 1
        assert all(abs(done[x] - Fraction(share[x] * (slot + 1), 60)) < 1 for x in share)


def test_more_sources_than_lines_share_one(spark):
    docs = spark.createDataFrame([(i, f"s{i}", "x") for i in range(50)], "doc_id long, source string, text string")
    got = op03_pfair.mixed(docs, None, op03_pfair.Settings(max_sources=8, slots=16, block_rows=2)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(50))


@pytest.mark.parametrize("weights", [{f"s{i:02}": 1.0 for i in range(20)}, {"a": 0.9991, "b": 0.0005, "c": 0.0004}, {"a": 0.37, "b": 1 / 3, "c": 0.2967}])
def test_mixture_deviates_by_less_than_a_block_from_the_weights_given(spark, weights):
    """Over many ranges of 1,024 slots and unrounded weights, until the first source runs out."""
    total = sum(weights.values())
    rows = [(s, n) for s, w in weights.items() for n in range(round(20_000 * w / total))]
    docs = spark.createDataFrame([(i, s, "x") for i, (s, _) in enumerate(rows)], "doc_id long, source string, text string")
    got = op03_pfair.mixed(docs, weights, op03_pfair.Settings(block_rows=1)).select("slot", "source").collect()
    line = [s for _, s in sorted(got)]
    assert sorted(x for x, _ in got) == list(range(len(rows)))
    ends = min(max(i for i, s in enumerate(line) if s == x) for x in weights)
    done = dict.fromkeys(weights, 0)
    for now, source in enumerate(line[:ends]):
        done[source] += 1
        assert all(abs(done[s] - w / total * (now + 1)) < 1 + 1e-6 for s, w in weights.items())


def test_sources_without_a_line_keep_their_share(spark):
    """40 equal sources, 7 of them with a line of their own; more given weights than lines."""
    docs = spark.createDataFrame([(i, f"s{i % 40}", "x") for i in range(2400)], "doc_id long, source string, text string")
    for weights in (None, {f"s{i}": 0.025 for i in range(40)}):
        got = op03_pfair.mixed(docs, weights, op03_pfair.Settings(max_sources=8, block_rows=1)).collect()
        assert sorted(r["slot"] for r in got) == list(range(2400))
        done = dict.fromkeys((f"s{i}" for i in range(40)), 0)
        for now, r in enumerate(sorted(got, key=lambda r: r["slot"])):
            done[r["source"]] += 1
            assert max(abs(n - (now + 1) / 40) for n in done.values()) < 2


def test_shards_match_their_sql(spark, tmp_path, prose):
    rows = [(i, prose(i % 9, i), None if i % 11 == 0 else f"s{min(i % 5, 2)}") for i in range(500)] + [(None, None, ""), (3, "é𝒳", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = op08_stratified.op8_stratified_shards(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    mine = sorted(map(tuple, got[names].fillna(-1).astype("int64").values.tolist()))
    assert mine == sorted(map(tuple, con.sql(op08_stratified.SQL).df()[names].fillna(-1).astype("int64").values.tolist()))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 13}", "t") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = op08_stratified.shards(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count().collect()
    whole = docs.groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in whole}
    assert all(abs(r["count"] - n[r["source"]] / 16) <= 2 for r in got)


def test_sharding_stage_interleaves_the_sources_of_a_slot_by_fractional_rank(spark):
    """Sources without a line of their own share slots of the mixture."""
    rows = [(i, f"s{min(i % 23, 11)}", f"t{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    settings = op03_pfair.Settings(max_sources=4)
    op03_pfair.stage(spark, docs, "", settings).count()
    mixture = spark.read.parquet(op03_pfair.order_folder(spark, docs)).select("slot", "place", "source", "doc_id").collect()
    wanted = []
    for slot in sorted({r["slot"] for r in mixture}):
        held = {}
        for r in sorted((r for r in mixture if r["slot"] == slot), key=lambda r: r["place"]):
            held.setdefault(r["source"], []).append(r["doc_id"])
        line = sorted(((2 * i + 1) / (2 * len(x)), s, d) for s, x in held.items() for i, d in enumerate(x))
        wanted += [d for _, _, d in line]
    assert wanted != [r["doc_id"] for r in sorted(mixture, key=lambda r: (r["slot"], r["place"]))]
    got = op08_stratified.stage(spark, docs, "").orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in got] == wanted
    sizes = [sum(r["shard"] == k for r in got) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
