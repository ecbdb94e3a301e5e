"""Valence rules by hand and novelty by brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import lexicon, novelty, posts, valence

UP, CAP = 0.293, 0.733
CASES = [  # text, sum of values
    ("good", 1.9), ("Good.", 1.9), ("not good", 1.9 * -0.74), ("isn't good", 1.9 * -0.74), ("very good", 1.9 + UP), ("very, very good", 1.9 + UP + UP * 0.95), ("very a b good", 1.9 + UP * 0.9), ("very a b c good", 1.9),
    ("not very good", (1.9 + UP) * -0.74), ("not a b c good", 1.9), ("slightly bad", -2.5 + UP), ("very bad", -2.5 - UP), ("GOOD day", 1.9 + CAP), ("GOOD DAY", 1.9), ("VERY good", 1.9 + UP + CAP), ("bad BAD", -2.5 - 2.5 - CAP),
    ("bad but good", -1.25 + 1.9 * 1.5), ("good bad", -0.6), ("never so good", (1.9 + UP) * 1.25), ("never this good", 1.9 * 1.25), ("never good", 1.9 * -0.74), ("good!!", 1.9 + 0.584), ("good !!!!!!", 1.9 + 4 * 0.292), ("bad!", -2.5 - 0.292),
    ("good?", 1.9), ("good??", 1.9 + 0.36), ("good?????", 1.9 + 0.96), ("!!!", 0.0), ("", 0.0), (None, 0.0), ("nothing here", 0.0), ("not", 0.0), ("good but not bad but", 0.95 + 2.5 * 0.74 * 1.5),
]


def test_valence_rules(spark):
    words = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("not", 3.0), ("good", 1.0)], "word string, valence double")
    texts = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "id int, text string, word string").repartition(3)
    got = {r["id"]: r for r in valence.score(texts, words, ["id"]).collect()}
    assert len(got) == len(CASES)
    for i, (text, total) in enumerate(CASES):
        assert math.isclose(got[i]["compound"], total / math.sqrt(total * total + 15), abs_tol=1e-9), (text, got[i]["compound"])
    shares = got[[t for t, _ in CASES].index("good bad")]
    assert math.isclose(shares["pos"], 2.9 / 6.4) and math.isclose(shares["neg"], 3.5 / 6.4) and shares["neu"] == 0
    assert [got[[t for t, _ in CASES].index(None)][c] for c in ("pos", "neg", "neu", "hits")] == [0, 0, 0, 0]
    assert valence.score(texts, words.limit(0), ["id"]).count() == len(CASES)


def test_lexicon_is_whole(spark):
    assert len(lexicon.WEIGHTS) == 138 and len(dict(lexicon.WEIGHTS)) == 138
    df = spark.createDataFrame([("a bullish treasury vote",), ("bullish",)], "t string").select(posts.boost(F.col("t")).alias("b"))
    assert [round(r["b"], 6) for r in df.collect()] == [round(2.5 / 6, 6), 1.0]  # words of weight 0 count as matches


def brute(docs, stop):
    """{id: novelty} of all documents against those before them."""
    counted = {}
    for i, text in docs:
        words = [w for w in re.findall(r"[^\W]{2,}", (text or "").lower()) if w not in stop]
        counted[i] = Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:], strict=False))
    df = Counter(g for c in counted.values() for g in c)
    weigh = {}
    for i, c in counted.items():
        raw = {g: n * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        weigh[i] = {g: x / size for g, x in raw.items()}
    out = {}
    for i in counted:
        best = max((sum(x * weigh[j][g] for g, x in weigh[i].items() if g in weigh[j]) for j in counted if j < i), default=0.0)
        out[i] = max(0.0, min(1.0, 1 - best))
    return out


@pytest.mark.parametrize("rare, probes", [(64, 8), (2, 1)])
def test_novelty_against_all_earlier(spark, sf_dir, tmp_path, monkeypatch, rare, probes):
    monkeypatch.setattr(novelty, "RARE", rare)
    monkeypatch.setattr(novelty, "PROBES", probes)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()][:60]
    docs += [(5001, None), (5002, ""), (5003, "the of and"), (5004, "zyx unique"), (5005, "zyx unique"), (5006, docs[3][1]), (5007, "a b c"), (5008, (docs[4][1] or "") + " zyx")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["q"]: r["novelty"] for r in novelty.against_earlier(df, df.select(F.col("doc_id").alias("q")), f"file://{tmp_path}/n").collect()}
    want = brute(docs, set(lexicon.STOP_WORDS))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert got[5005] < 1e-9 and got[5006] < 1e-9 and got[5001] == got[5003] == 1.0


@pytest.mark.parametrize("queries", [4000, 7])
def test_novelty_stores_lengths_and_queries_only(spark, tmp_path, monkeypatch, queries):
    """Disk holds a length a document, the grams of the queries and one row a query, whatever the documents share."""
    monkeypatch.setattr(novelty, "BLOCK_QUERIES", queries)
    docs = [(i, " ".join(f"w{(i * k * k + k) % 37}" for k in range(1, 60))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = df.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q"))
    folder = f"file://{tmp_path}/n"
    got = {r["q"]: r["novelty"] for r in novelty.against_earlier(df, asked, folder).collect()}
    want = brute(docs, set(lexicon.STOP_WORDS))
    assert len(got) == 15 and all(abs(x - want[i]) < 1e-9 for i, x in got.items())
    index = spark.read.parquet(f"{folder}/index")
    assert index.where("gram is null").select("doc").distinct().count() == 300
    assert index.where("gram is not null and doc % 20 > 0").isEmpty() and spark.read.parquet(f"{folder}/near").count() <= 15


def test_novelty_searches_words_once_and_copies_never(spark, tmp_path, monkeypatch):
    """Texts are read once, as hashes of words; a copy of an earlier text, also in other capitals or stop words, is not searched; a block
    meets only the documents before its last query."""
    monkeypatch.setattr(novelty, "BLOCK_QUERIES", 4)
    docs = [(i, " ".join(f"w{(i * k * k + k) % 61}" for k in range(1, 40 + i % 7))) for i in range(120)]
    docs += [(200 + i, f"The {docs[i][1].upper()}!") for i in range(0, 120, 10)] + [(400, ""), (401, "the"), (402, "one"), (403, "one"), (404, "ONE the"), (405, "one one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = df.where("doc_id % 10 = 0 or doc_id >= 400").select(F.col("doc_id").alias("q"))
    folder = f"file://{tmp_path}/n"
    got = {r["q"]: r["novelty"] for r in novelty.against_earlier(df, asked, folder).collect()}
    want = brute(docs, set(lexicon.STOP_WORDS))
    assert len(got) == 30 and all(abs(x - want[i]) < 1e-9 for i, x in got.items())
    assert got[400] == got[401] == got[402] == 1.0 and all(got[i] < 1e-9 for i in (200, 310, 403, 404)) and 0.1 < got[405] < 0.9
    near = spark.read.parquet(f"{folder}/near")
    assert {r["q"] for r in near.select("q").collect()} <= {*range(10, 120, 10), 405} and spark.read.parquet(f"{folder}/measured").columns == ["doc", "words", "length"]
    ranges = [(r["a"], r["b"]) for r in near.groupBy("block").agg(F.min("q").alias("a"), F.max("q").alias("b")).orderBy("block").collect()]
    assert len(ranges) > 2 and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
