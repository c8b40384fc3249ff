"""Packing against a plain cut of every document's ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lossledger.llm import op12_binary_packing as op12


def hf_ids(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_tokenizers_library(prose):
    texts = ["", " ", "  \n\n\t x", "é ü 𝒳 " * 30, "Hello world's 123 4567 don't", "a" * 5000, "   x\r\n", prose(3000, 2)]
    texts += [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()]
    enc = op12.encoder(*op12.default_vocab())
    for text in texts:
        assert enc.encode_ordinary(text) + [1] == hf_ids(text)


def test_pieces_of():
    assert op12.pieces_of(1) == [(0, 1)]
    assert op12.pieces_of(2048 * 2 + 1029) == [(0, 2048), (2048, 2048), (4096, 1024), (5120, 4), (5124, 1)]
    for n in range(1, 5000, 7):
        cut = op12.pieces_of(n)
        assert sum(k for _, k in cut) == n and all(cut[i][0] + cut[i][1] == cut[i + 1][0] for i in range(len(cut) - 1))


def test_packing_round_trip(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet").select("doc_id", "text").collect()
    got = op12.op12_binary_packing(spark, messy).collect()
    # every id of every row in exactly one piece, with the right checksum
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for d in docs:
        ids = np.asarray(hf_ids(d["text"]), dtype="<u4")
        want[d["doc_id"]] += [(s, k, zlib.crc32(ids[s : s + k].tobytes()), len(ids)) for s, k in op12.pieces_of(len(ids))]
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in v) for k, v in by_doc.items()}
    # sequences: gapless offsets from 0, at most 2048 ids, one piece length each; at most one partial sequence per length
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    partial = defaultdict(int)
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:]))
        assert len({k for _, k in parts}) == 1 and sum(k for _, k in parts) <= 2048
        partial[parts[0][1]] += sum(k for _, k in parts) < 2048
    assert all(v <= 1 for v in partial.values())
    assert sorted(seqs) == list(range(len(seqs)))


def test_empty_table(spark, empty):
    assert op12.op12_binary_packing(spark, empty).count() == 0
