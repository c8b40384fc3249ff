import random

import pytest

WORDS = "the of and to in red reed ining thand erst onth tion hea ther shou ble".split()


@pytest.fixture(scope="session")
def prose():
    """Makes ordinary text of n words from a seed."""

    def make(n: int, seed: int) -> str:
        chance = random.Random(seed)
        out = []
        for i in range(n):
            word = chance.choice(WORDS) + chance.choice(["", chance.choice(WORDS)])
            out.append(word.capitalize() if i % 9 == 0 else word)
            if i % 9 == 8:
                out[-1] += ".\n" if chance.random() < 0.3 else "."
        return " ".join(out)

    return make


@pytest.fixture(scope="session")
def junk(prose):
    def make(n: int, seed: int) -> str:
        return " ".join(w + "***" for w in prose(n, seed).split())

    return make


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = "key fp score bucket rank row h line text_ size host stratum place slot word c n blob found".split()


@pytest.fixture(scope="session")
def messy(spark, prose, junk, tmp_path_factory):
    """A folder of tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rows = [(i, prose(40 + i, i % 30), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, junk(80, i), "en", "s0", 1) for i in range(20)]
    rows += [
        (None, prose(70, 500), None, None, None), (None, prose(70, 501), "en", "", 0), (None, None, None, None, None),
        (200, None, "en", "s1", 0), (201, "", "en", "s1", 0), (202, " \n\t ", "en", None, 0), (203, prose(40_000, 9), "en", "s2", 1),
        (204, "é ü 𝒳 " * 30, "de", "s2", 1), (5, rows[5][1], "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (205, rows[7][1], "fr", "s0", 1),
    ]
    folder = str(tmp_path_factory.mktemp("messy"))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0), (6, 0, 0), (999, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS key", "2 AS text").write.parquet(f"{folder}/labels.parquet")
    bench = [(1, rows[3][1][:150]), (2, None), (3, ""), (None, rows[4][1][:120]), (4, "short")]
    spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "0 AS start").write.parquet(f"{folder}/benchmark.parquet")
    page = "<html><body><nav><a>Home</a></nav><article><p>Text {} &amp; more</p></article><footer>x</footer></body></html>"
    pages = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)]
    pages += [(None, None, None), (7, "", ""), (8, "http://a.example/0", "<p>cut <b>off &am"), (0, "http://a.example/0", page.format(0))]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS classes").write.parquet(f"{folder}/pages.parquet")
    chance = random.Random(4)
    vecs = [(i, [chance.uniform(-0.2, 0.2) for _ in range(8)], i % 3) for i in range(300)]
    vecs += [(None, [0.1] * 8, 1), (400, None, 1), (401, [0.1] * 8, None), (402, [float("nan")] + [0.1] * 7, 1), (403, [None] + [0.1] * 7, 2)]
    vecs += [vecs[100], vecs[100], (404, [0.0] * 8, 0), (500, [0.05] * 8, 2), (600, [0.05] * 8, 2), (700, [float("inf")] * 8, 1)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").selectExpr("*", "0 AS score", "'x' AS node").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, messy, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{messy}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
