"""Posts of every shape: through the twin on a table of conversations that holds their texts, and by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tests.oracle import difference
from tidewatch.functions import posts as P
from tidewatch.plans import catalog, details, postings

_C = lambda *bodies: [{"author": a, "body": b} for a, b in bodies]
_TALK = _C(("ann", "I lost $400 and should have sold earlier, this is down"), ("bob", "Stay safe, never share your wallet keys"), ("tipbot", "I am a bot"), ("cyd", "Bitcoin to the moon, guaranteed 100x incoming"), (None, "What a great project, just bought more ETH"), ("dee", ""))
#: Fixed samples: every shape of a raw post.
SAMPLES = [
    {"author": "eve", "title": "Is Bitcoin down 12% a warning sign?", "content": "The market is down and I regret buying solana.\n\nGot rekt twice this week, done with crypto for now.\n\nshort one", "metadata": {"comments": _TALK}},
    {"username": "fay", "body": "ETH staking yield is great news, love this team a lot.\n\nETH staking yield is great news, love this team a lot.\n\nTrust me, easy money for every millionaire here", "metadata": {"comments": _TALK[:5]}},
    {"post_id": "77", "thread_subject": "rug pull suspicious", "text": "Contact the moderators of this place please.\n\nThis is huge, congrats to all holders of DOGE coin", "metadata": {"comments": _TALK + _TALK[:2]}},
    {"author": "gus", "title": "tiny", "content": "", "body": "", "text": "", "metadata": {"comments": _TALK}},
    {"title": "Nobody wrote this one, really", "content": "A text without an author is left out of all.", "metadata": {"comments": _TALK}},
    {"author": "hal", "title": "Too few comments here", "content": "Waste of money and not worth it, cannot find any use.", "metadata": {"comments": _TALK[:2]}},
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of conversations: openings and answers of the samples, longer and shorter talks."""
    rows = []
    for c, s in enumerate(SAMPLES * 3):
        talk = s["metadata"]["comments"] if c < 12 else s["metadata"]["comments"] * 2
        rows += [(c, 0, "user", s.get("content") or s.get("body") or s.get("text") or s.get("title"))]
        rows += [(c, 1 + k, x["author"], x["body"]) for k, x in enumerate(talk)]
    at = tmp_path_factory.mktemp("posts")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["o5_4_post_scores", "o5_5_aggregations", "o5_6_coins", "o5_22_blend", "o2_16_post_audits"])
def test_samples_match_sql(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    assert difference(df, catalog.ORACLE_SQL[name], folder) == "" and df.count() > 0


def test_sample_scores_are_not_idle(spark, folder):
    rows = catalog.QUERIES["o5_4_post_scores"](spark, folder).collect()
    assert any(r["fear_index"] > 0 for r in rows) and any(r["euphoria_index"] > 0 for r in rows) and any(r["filtered"] > 0 for r in rows) and any(r["final_score"] < 0 for r in rows)


def test_fields_fall_back(spark):
    raw = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(SAMPLES)], "raw_id long, data string").select("raw_id", F.from_json("data", postings._RAW).alias("post"))
    got = {r["raw_id"]: r for r in postings.post_texts(raw).collect()}
    assert [got[i]["username"] for i in range(6)] == ["eve", "fay", "anon_77", "gus", None, "hal"]
    assert [got[i]["title"] for i in (1, 2, 3)] == ["", "rug pull suspicious", "tiny"] and [got[i]["comments"] for i in range(6)] == [4, 4, 6, 4, 4, 2]
    assert got[1]["content"].count("ETH staking yield") == 1 and got[3]["content"].startswith("I lost $400")


def test_board_text_and_numbers(spark):
    html = ["&gt;be me<br>&gt;&gt;12345 buys &quot;ETH&quot; &amp;  <b>waits</b>", ">>77 ok\n>green text\n  two   spaces", ""]
    texts = [r["t"] for r in spark.createDataFrame([(h,) for h in html], "h string").select(P.cleaned(F.col("h")).alias("t")).collect()]
    assert texts[2] == "" and "green text two spaces" in texts[1] and ">" not in texts[1][:1] and 'buys "ETH" & waits' in texts[0]
    numbers = [("1.2K likes", 1200), ("3m", 3_000_000), ("1,500", 1500), ("none", 0), (" 12 k ", 12_000), ("0.5M", 500_000)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(numbers)], "i int, t string").select("i", P.stat_number(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in df.collect()} == {i: n for i, (_, n) in enumerate(numbers)}


@pytest.mark.parametrize("name, ids", [("o5_4_post_scores", {-1, -2, -3, -4}), ("o5_5_aggregations", {-1, -2, -3, -4}), ("o5_6_coins", {-1, -2, -3, -4, -5, -6}), ("o5_22_blend", {-1, -2, -3, -4, -5, -6})])
def test_fixed_posts_are_scored(spark, folder, name, ids):
    """The posts of JSON that hold every shape are read, beside all conversations, by query and twin."""
    df = catalog.QUERIES[name](spark, folder)
    assert {r[0] for r in df.where("raw_id < 0").select("raw_id").collect()} == ids and difference(df, catalog.ORACLE_SQL[name], folder) == ""


@pytest.mark.parametrize("name", ["o2_16_post_audits", "o12_6_low_engagement"])
def test_fixed_posts_are_audited(spark, folder, name, monkeypatch):
    """These name no posts: with the fixed ones left out, the results differ."""
    whole = sorted(map(str, catalog.QUERIES[name](spark, folder).collect()))
    every = postings.raw_posts
    monkeypatch.setattr(details, "raw_posts", lambda *a: every(*a).where("raw_id >= 0"))
    monkeypatch.setattr(postings, "raw_posts", lambda *a: every(*a).where("raw_id >= 0"))
    assert whole != sorted(map(str, catalog.QUERIES[name](spark, folder).collect()))


def test_fixed_board_posts_are_cleaned(spark, sf_dir):
    df = catalog.QUERIES["o5_8_board_text"](spark, sf_dir)
    assert {r["page_id"]: r["n_chars"] for r in df.where("page_id < 0").collect()} == {-1: 24, -2: 27, -3: 0} and difference(df, catalog.ORACLE_SQL["o5_8_board_text"], sf_dir) == ""


def test_fixed_numbers_are_read(spark, sf_dir):
    df = catalog.QUERIES["o5_17_stat_numbers"](spark, sf_dir)
    assert {r["id"]: r["n"] for r in df.where("id < 0").collect()} == {-1: 1200, -2: 3_000_000, -3: 1500, -4: 0, -5: 12_000, -6: 500_000} and difference(df, catalog.ORACLE_SQL["o5_17_stat_numbers"], sf_dir) == ""
