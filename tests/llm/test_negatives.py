"""Hard negatives against an exhaustive search, and the cover tree against a scan."""

import math

import numpy as np
import pytest

from lossledger.llm import op13_cover_negatives as op13


def plain(rows, k=5):
    """The contract, row by row: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    ok = []
    for vec_id, emb, label in rows:
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        ok.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in emb], label))
    order = lambda r: (r[0] is None, r[0] or 0)

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for aid, avec, alabel in ok:
        if aid is None or aid % 100:
            continue
        same = sorted(((dot(avec, v), i) for i, v, l in ok if l == alabel and i != aid), key=lambda t: (-t[0], order((t[1],))))[:k]
        for p, pid in same:
            negs = [(dot(avec, v), i) for i, v, l in ok if l != alabel and 80 * p <= 100 * dot(avec, v) <= 100 * p]
            for r, (s, nid) in enumerate(sorted(negs, key=lambda t: (-t[0], order((t[1],))))[:k], 1):
                out.append((aid, pid, r, nid, p, s))
    return sorted(out, key=str)


def got_rows(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def test_messy_table_against_exhaustive_search(spark, messy):
    rows = [tuple(r) for r in spark.read.parquet(f"{messy}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got_rows(op13.op13_cover_negatives(spark, messy)) == plain(rows)


def test_given_table_against_exhaustive_search_with_many_trees(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in emb.select("vec_id", "embedding", "label").collect()]
    want = plain(rows)
    assert want and got_rows(op13.mine(emb, shard_rows=60, query_rows=7)) == want


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_tree_search_against_a_scan(seed):
    chance = np.random.default_rng(seed)
    x = chance.integers(-30, 30, size=(700, 16))
    x[100:160] = x[100]  # a block of equal points: ties and a leaf that cannot be split
    ids = np.arange(700, dtype=np.int64)
    ids[300:320] = 5  # repeated ids
    tree = op13.CoverTree(x)
    for _ in range(40):
        q = chance.integers(-30, 30, size=16).astype(np.float64)
        s = (x @ q).astype(np.int64)
        lo, hi = sorted(chance.choice(s, 2))
        for lo_, hi_, skip in ((-1e18, 1e18, 5), (lo, hi, None), (hi + 1, hi, None)):
            want = sorted(((int(a), int(b), int(c)) for a, b, c in zip(s, ids, range(700)) if lo_ <= a <= hi_ and b != skip), key=lambda t: (-t[0], t[1], t[2]))[:5]
            assert tree.search(q, lo_, hi_, skip, ids, 5) == want


def test_empty_table(spark, empty):
    assert op13.op13_cover_negatives(spark, empty).count() == 0


def test_sql_answer_against_exhaustive_search(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    got = sorted((tuple(r[:6]) for r in con.execute(op13.SQL).fetchall()), key=str)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == plain(rows)


def test_block_search_against_a_scan():
    chance = np.random.default_rng(11)
    x = chance.integers(-40, 40, size=(3000, 24))
    x[500:900] = x[500]  # a large group of equal points
    ids = chance.integers(0, 2000, size=3000)  # repeated ids
    tree = op13.CoverTree(x)
    qs = chance.integers(-40, 40, size=(300, 24)).astype(np.float64)
    s = (qs @ x.T.astype(np.float64)).astype(np.int64)
    hi = np.sort(s, axis=1)[:, -3].astype(float)
    lo = np.ceil(0.8 * hi)
    lo[:100], hi[:100] = -1e18, 1e18  # no window
    skip, skips = ids[:300], np.arange(300) % 2 == 0
    got = tree.search_block(qs, lo, hi, skip, skips, ids, 5)
    for q in range(300):
        keep = (s[q] >= lo[q]) & (s[q] <= hi[q]) & ~(skips[q] & (ids == skip[q]))
        want = sorted(((int(a), int(b), int(c)) for a, b, c in zip(s[q][keep], ids[keep], np.flatnonzero(keep))), key=lambda t: (-t[0], t[1], t[2]))[:5]
        assert got[q] == want
