"""Merkle manifest against a plain tree built level by level."""

import hashlib
import random
import zlib

import pytest

from lossledger.llm import op11_merkle_versions as op11


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(doc_id, source, lang, n_chars, text):
    return digest("".join(enc(v) for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    """All levels of a tree over ``nodes``, bottom first."""
    out = [nodes]
    while len(out[-1]) > 1:
        level = out[-1]
        out.append([digest("".join(level[j : j + 2])) for j in range(0, len(level), 2)])
    return out


def path(tree, i):
    steps = []
    for level in tree[:-1]:
        j = i ^ 1
        steps.append((level[j], "left" if i % 2 == 0 else "right") if j < len(level) else (None, "lone"))
        i //= 2
    return steps


def fold(start, steps):
    for sib, side in steps:
        start = digest(start) if side == "lone" else digest(start + sib) if side == "left" else digest(sib + start)
    return start


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) per row, as the contract defines them."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees, lang_steps = {}, {}
    for g in langs:
        by_lang[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[g] = levels([plain_leaf(*r) for r in by_lang[g]])
    top = levels([trees[g][-1][0] for g in langs])
    for k, g in enumerate(langs):
        lang_steps[g] = path(top, k)
    out = []
    for g in langs:
        for i, row in enumerate(by_lang[g]):
            steps = path(trees[g], i) + lang_steps[g]
            proof = digest("".join(s for s, _ in steps if s))
            doc_id, source, lang, n_chars, text = row
            changed = row
            if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                changed = (doc_id, source, lang, n_chars + 1, text)
            folded = fold(plain_leaf(*changed), steps)
            out.append((doc_id, plain_leaf(*row), trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def table_of(rows, spark, tmp_path):
    folder = str(tmp_path)
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS g", "1 AS idx", "'y' AS path").write.parquet(f"{folder}/documents.parquet")
    return folder


def rows_of(n, seed):
    chance = random.Random(seed)
    langs = [None, "en", "de", "é", "zz"]
    rows = [(i, chance.choice(["a", None, "bb"]), chance.choice(langs[:4]), chance.choice([None, 3, 70]), chance.choice(["", None, "x y", "é" * 9])) for i in range(n)]
    rows += [(None, "a", "en", 3, "t"), (None, None, None, None, None), rows[5], rows[5], (8, "s", "zz", 1, "one")]
    return rows


@pytest.mark.parametrize("n, block_levels", [(150, 2), (37, 10), (1, 1)])
def test_manifest_against_plain_tree(spark, tmp_path, n, block_levels):
    rows = rows_of(n, n) if n > 1 else [(7, "a", "en", 5, "abc")]
    folder = table_of(rows, spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = op11.manifest(docs, block_levels=block_levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_tampered_rows_fail_and_others_verify(spark, tmp_path):
    rows = rows_of(60, 3)
    got = op11.op11_merkle_versions(spark, table_of(rows, spark, tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        n_chars = [x[3] for x in rows if x[0] == r["doc_id"]][0]
        assert r["verified"] == (not hit or n_chars is None)


def test_empty_table(spark, tmp_path):
    folder = table_of([], spark, tmp_path)
    got = op11.op11_merkle_versions(spark, folder)
    assert got.count() == 0 and {"doc_id", "root", "verified"} <= set(got.columns)


def test_sql_answer_against_plain_tree():
    import duckdb
    import pandas as pd

    for rows in (rows_of(150, 150), [(7, "a", "en", 5, "abc")]):
        con = duckdb.connect()
        frame = pd.DataFrame(rows, columns=["doc_id", "source", "lang", "n_chars", "text"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
        con.register("frame", frame)
        con.execute("CREATE TABLE documents AS SELECT * FROM frame")
        got = sorted(((r[0], *r[3:]) for r in con.execute(op11.SQL).fetchall()), key=str)
        assert got == plain(rows)


def test_untampered_leaves_are_folded_along_their_own_proof(spark, tmp_path, monkeypatch):
    """A wrong sibling in a stored path shows: no leaf counts as verified without being recomputed."""
    from pyspark.sql import functions as F

    reduce_tree = op11.reduce_tree

    def damaged(nodes, block_levels=op11.BLOCK_LEVELS):
        paths, top = reduce_tree(nodes, block_levels)
        wrong = F.transform("path", lambda p: F.struct(F.when(p["sib"].isNotNull(), F.sha2(p["sib"], 256)).alias("sib"), p["side"].alias("side")))
        return paths.withColumn("path", F.when(F.col("idx") == 0, wrong).otherwise(F.col("path"))), top

    docs = spark.createDataFrame([(i, "s", "en", 4, f"text {i}") for i in range(9)], "doc_id long, source string, lang string, n_chars long, text string")
    assert all(r["verified"] for r in op11.manifest(docs, tamper_every=1 << 40).collect() if r["doc_id"] != 0)
    monkeypatch.setattr(op11, "reduce_tree", damaged)
    got = {r["position"]: r for r in op11.manifest(docs, tamper_every=1 << 40).collect()}
    assert not got[0]["verified"] and got[0]["folded_root"] != got[0]["root"]
    assert all(got[i]["verified"] for i in range(1, 9))
