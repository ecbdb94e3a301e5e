"""Post scoring: raw posts to texts, segments, lexicon scores, one score a post.

Raw posts are JSON of several shapes. Here they come from ``conversations`` (first turn: title and content, the other
turns: comments) and from a few fixed samples that hold every shape, category and pattern, so that no rule stays idle on the
invented prose. A model's scores are an input; without one the lexicon scores alone.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import posts as P
from ..sources.tables import SCORES_SQL, read, scores
from .dashboard import r6

MIN_COMMENTS = P.MIN_COMMENTS
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
_COMMENTS = "array<struct<author:string,body:string>>"
_RAW = f"author string, username string, post_id string, title string, thread_subject string, content string, body string, text string, metadata struct<comments:{_COMMENTS}>"


def raw_posts(spark, sf_dir):
    """raw_id, post: a struct of one row's raw fields."""
    samples = spark.createDataFrame([(-1 - i, json.dumps(s)) for i, s in enumerate(SAMPLES)], "raw_id long, data string").select("raw_id", F.from_json("data", _RAW).alias("post"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    talk = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    comments = F.transform(F.slice("t", 2, F.size("t")), lambda x: F.struct(x["role"].alias("author"), x["text"].alias("body")))
    none = F.lit(None).cast("string")
    opening = F.element_at("t", 1)["text"]
    fields = {"author": F.concat(F.lit("user"), F.col("conv_id") % 50), "username": none, "post_id": none, "title": F.substring(opening, 1, 60), "thread_subject": none, "content": opening, "body": none, "text": none, "metadata": F.struct(comments.alias("comments"))}
    built = talk.select(F.col("conv_id").alias("raw_id"), F.struct(*(c.alias(k) for k, c in fields.items())).cast(f"struct<{_RAW.replace(' string', ':string').replace(' struct', ':struct')}>").alias("post"))
    return samples.unionByName(built)


def post_texts(raw):
    """raw_id, username, title, content, comments (humans' number): fallbacks, human comments appended, paragraphs once."""
    p = lambda c: F.col("post")[c]
    kept = F.filter(F.coalesce(p("metadata")["comments"], F.array().cast(_COMMENTS)), lambda c: P.is_human(c["author"], c["body"]))
    username = P.first_text(p("author"), p("username"), F.concat(F.lit("anon_"), F.nullif(p("post_id"), F.lit(""))))
    title = F.coalesce(P.first_text(p("title"), p("thread_subject")), F.lit(""))
    content = P.first_text(p("content"), p("body"), p("text"))
    rows = raw.select("raw_id", username.alias("username"), title.alias("title"), content.alias("content"), kept.alias("kept"))
    whole = F.array_join(F.concat(F.filter(F.array("content"), lambda x: x.isNotNull()), F.transform("kept", lambda c: c["body"])), "\n\n")
    return rows.select("raw_id", "username", "title", P.distinct_paragraphs(whole).alias("content"), F.size("kept").alias("comments"))


def post_segments(spark, sf_dir):
    """One row a post that counts: title score and segments (text, category, score). Segments are scored as rows, whose expressions are
    compiled, and come back in order: at most MOST_SEGMENTS a post."""
    rows = post_texts(raw_posts(spark, sf_dir)).where(F.col("username").isNotNull() & (F.col("comments") >= P.MIN_COMMENTS))
    title = F.when(F.length(P.stripped(F.col("title"))) >= P.TITLE_CHARS, P.scored(F.col("title")))
    spread = rows.select("raw_id", "username", "comments", "title", F.posexplode_outer(P.segments(F.col("content"))).alias("place", "text"))
    scored = spread.select("raw_id", "username", "comments", "title", "place", "text", P.category(F.col("text")).alias("category"), P.scored(F.col("text")).alias("score"))
    part = F.when(F.col("place").isNotNull(), F.struct("place", "text", "category", "score"))
    posts = scored.groupBy("raw_id").agg(F.first("username").alias("username"), F.first("comments").alias("comments"), F.first("title").alias("title"), F.array_sort(F.collect_list(part)).alias("parts"))
    return posts.select("raw_id", "username", "comments", title.alias("title_score"), "parts")


def scored_posts(spark, sf_dir):
    rows = post_segments(spark, sf_dir)
    values = F.transform(F.filter("parts", lambda s: s["category"].isin("STANDARD", "TRUE_BEARISH")), lambda s: s["score"])
    return rows.withColumn("values", values)


def o5_4_post_scores(spark, sf_dir):
    """Scores, indices and counts of every post (O2.18, O5.1 to O5.5, O5.18 to O5.21)."""
    rows = scored_posts(spark, sf_dir)
    share = lambda c: F.coalesce(F.try_divide(F.size(F.filter("parts", lambda s: s["category"] == c)), F.size("parts")), F.lit(0.0))
    every = F.concat(F.filter(F.array(F.nullif("title_score", F.lit(0.0))), lambda x: x.isNotNull()), F.col("values"))
    count = lambda ok: F.size(F.filter(every, ok))
    pos, neg = count(lambda x: x > 0.1), count(lambda x: x < -0.1)
    return rows.select(
        "raw_id", "username", "comments", r6("title_score").alias("title_score"), r6(F.coalesce(P.mean_of(F.col("values")), F.lit(0.0))).alias("body_score"), r6(P.combined(F.col("title_score"), F.col("values"))).alias("final_score"),
        r6(share("ACTIVITY")).alias("activity_level"), r6(share("TRUE_BEARISH")).alias("fear_index"), r6(share("EUPHORIA")).alias("euphoria_index"), pos.alias("pos"), neg.alias("neg"), (F.size(every) - pos - neg).alias("neu"),
        F.size("parts").alias("total"), F.size(F.filter("parts", lambda s: s["category"] == "FILTER")).alias("filtered"), F.size("values").alias("scored"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _matches(x: str, p: str) -> str:
    return f"regexp_matches(lower({x}), {_quoted('(?i)' + p)})"


def _scored(x: str, base: str | None = None) -> str:
    change = " + ".join(f"(CASE WHEN {_matches(x, p)} THEN {w} ELSE 0.0 END)::DOUBLE" for p, w in lexicon.CORRECTIONS)
    hits = f"list_filter(lexicon, lambda e: contains(lower({x}), e.term))"
    boost = f"CASE WHEN len({hits}) > 0 THEN least(1.0::DOUBLE, greatest(-1.0::DOUBLE, list_sum(list_transform({hits}, lambda e: e.weight)) / (2 * len({hits})))) ELSE 0.0::DOUBLE END"
    score = base.format(boost=boost) if base else boost
    return f"CASE WHEN {change} = 0 THEN {score} ELSE least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {score} + 0.3 * ({change}))) END"


def _category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_matches(x, '|'.join(ps))} THEN '{n}'" for n, ps in lexicon.CATEGORIES) + " ELSE 'STANDARD' END"


_TERMS = "[" + ", ".join(f"{{'term': {_quoted(t)}, 'weight': {w}::DOUBLE}}" for t, w in lexicon.WEIGHTS) + "]"
_BOTS = ", ".join(map(_quoted, lexicon.BOTS))
_FIELDS = ["author", "username", "post_id", "title", "thread_subject", "content", "body", "text"]
_SAMPLE_ROWS = ", ".join(f"({-1 - i}, {_quoted(json.dumps(s))})" for i, s in enumerate(SAMPLES))
_POSTS_SQL = rf"""sample(raw_id, data) AS (VALUES {_SAMPLE_ROWS}),
talk AS (SELECT conv_id, list(struct_pack(author := role, body := text) ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1),
raw AS (SELECT raw_id::BIGINT AS raw_id, {', '.join(f"json_extract_string(data, '$.{c}') AS {c}" for c in _FIELDS)}, list_transform(json_extract(data, '$.metadata.comments[*]'), lambda c: struct_pack(author := json_extract_string(c, '$.author'), body := json_extract_string(c, '$.body'))) AS comments FROM sample
    UNION ALL SELECT conv_id, 'user' || (conv_id % 50), NULL, NULL, left(t[1].body, 60), NULL, t[1].body, NULL, NULL, t[2:] FROM talk),
fields AS (SELECT raw_id, coalesce(nullif(author, ''), nullif(username, ''), 'anon_' || nullif(post_id, '')) AS username, coalesce(nullif(title, ''), nullif(thread_subject, ''), '') AS title, coalesce(nullif(content, ''), nullif(body, ''), nullif(text, '')) AS content,
    list_filter(comments, lambda c: coalesce(c.body, '') <> '' AND coalesce(c.author, '') NOT IN ({_BOTS}) AND NOT ends_with(lower(coalesce(c.author, '')), 'bot')) AS kept FROM raw),
joined AS (SELECT raw_id, username, title, len(kept)::INTEGER AS comments, string_split(array_to_string(list_concat(list_filter([content], lambda x: x IS NOT NULL), list_transform(kept, lambda c: c.body)), chr(10) || chr(10)), chr(10) || chr(10)) AS parts FROM fields),
plain AS (SELECT *, list_transform(parts, lambda p: {_strip('p')}) AS bare FROM joined),
texts AS (SELECT raw_id, username, title, comments, array_to_string(list_filter(parts, lambda p, i: {_strip('p')} <> '' AND list_position(bare, {_strip('p')}) = i), chr(10) || chr(10)) AS content FROM plain),
piece AS (SELECT raw_id, unnest(list_slice(list_filter(list_transform(string_split_regex(content, '\n\n+'), lambda x: {_strip('x')}), lambda x: length(x) >= 20), 1, 20)) AS seg, generate_subscripts(list_slice(list_filter(list_transform(string_split_regex(content, '\n\n+'), lambda x: {_strip('x')}), lambda x: length(x) >= 20), 1, 20), 1) AS i
    FROM texts WHERE username IS NOT NULL AND comments >= 4),
part AS (SELECT raw_id, i, {_category('seg')} AS category, {_scored('seg')} AS score FROM piece, (SELECT {_TERMS} AS lexicon)),
posts AS (SELECT raw_id, username, comments, CASE WHEN length({_strip('title')}) >= 10 THEN {_scored('title')} END AS title_score FROM texts, (SELECT {_TERMS} AS lexicon) WHERE username IS NOT NULL AND comments >= 4),
g AS (SELECT p.raw_id, username, comments, title_score, coalesce(list(score ORDER BY i) FILTER (category IN ('STANDARD', 'TRUE_BEARISH')), []) AS vals, count(category)::INTEGER AS total,
    count(*) FILTER (category = 'ACTIVITY') AS act, count(*) FILTER (category = 'TRUE_BEARISH') AS fear, count(*) FILTER (category = 'EUPHORIA') AS eu, count(*) FILTER (category = 'FILTER')::INTEGER AS filtered FROM posts p LEFT JOIN part USING (raw_id) GROUP BY ALL),
q AS (SELECT *, list_concat(list_filter([nullif(title_score, 0)], lambda x: x IS NOT NULL), vals) AS lively, list_concat(list_filter([title_score], lambda x: x IS NOT NULL), vals) AS every FROM g)"""
S5_4 = f"""WITH {_POSTS_SQL} SELECT raw_id, username, comments, round(title_score + 1e-9, 6) AS title_score, round(coalesce(list_avg(vals), 0.0) + 1e-9, 6) AS body_score,
    round(CASE WHEN len(every) = 0 THEN 0.0 WHEN title_score IS NOT NULL AND len(vals) > 0 THEN 0.2 * title_score + 0.8 * list_avg(vals) ELSE list_avg(every) END + 1e-9, 6) AS final_score,
    round(coalesce(act / nullif(total, 0), 0.0) + 1e-9, 6) AS activity_level, round(coalesce(fear / nullif(total, 0), 0.0) + 1e-9, 6) AS fear_index, round(coalesce(eu / nullif(total, 0), 0.0) + 1e-9, 6) AS euphoria_index,
    len(list_filter(lively, lambda x: x > 0.1))::INTEGER AS pos, len(list_filter(lively, lambda x: x < -0.1))::INTEGER AS neg, (len(lively) - len(list_filter(lively, lambda x: x > 0.1)) - len(list_filter(lively, lambda x: x < -0.1)))::INTEGER AS neu, total, filtered, len(vals)::INTEGER AS scored FROM q"""


def o5_5_aggregations(spark, sf_dir):
    """A post's score by all five methods (O5.5)."""
    rows = scored_posts(spark, sf_dir)
    return rows.select("raw_id", *(r6(P.combined(F.col("title_score"), F.col("values"), m)).alias(m) for m in P.METHODS))


S5_5 = f"""WITH {_POSTS_SQL}, d AS (SELECT *, list_filter(every, lambda x: x > 0.1) AS p, list_filter(every, lambda x: x < -0.1) AS n, title_score IS NOT NULL AND len(vals) > 0 AS b FROM q)
SELECT raw_id, round(coalesce(list_avg(every), 0.0) + 1e-9, 6) AS mean, round(CASE WHEN len(every) = 0 THEN 0.0 WHEN b THEN 0.2 * title_score + 0.8 * list_avg(vals) ELSE list_avg(every) END + 1e-9, 6) AS title_weighted,
    round(CASE WHEN len(every) = 0 THEN 0.0 ELSE greatest(list_max(every), 0.0) + least(list_min(every), 0.0) END + 1e-9, 6) AS extremes,
    round(CASE WHEN len(every) = 0 THEN 0.0 WHEN len(p) > len(n) THEN list_avg(p) WHEN len(n) > len(p) THEN list_avg(n) ELSE list_avg(every) END + 1e-9, 6) AS dominant,
    round(CASE WHEN len(every) = 0 THEN 0.0 WHEN b THEN 0.4 * title_score + 0.3 * vals[1] + 0.3 * vals[len(vals)] ELSE list_avg(every) END + 1e-9, 6) AS first_last FROM d"""


def o5_6_coins(spark, sf_dir):
    """Coins that posts name, and whether a post is on topic (O5.6, O5.7)."""
    rows = post_texts(raw_posts(spark, sf_dir)).select("raw_id", F.concat_ws("\n\n", "title", "content").alias("t"))
    coins = F.filter(F.array(*(F.when(F.col("t").rlike(p), c) for c, p in lexicon.COINS)), lambda x: x.isNotNull())
    return rows.select("raw_id", F.array_join(coins, ",").alias("coins"), F.col("t").rlike("(?i)" + lexicon.TOPIC).alias("on_topic"))


S5_6 = f"""WITH {_POSTS_SQL}, t AS (SELECT raw_id, title || chr(10) || chr(10) || content AS t FROM texts)
SELECT raw_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, {_quoted(p)}) THEN '{c}' END" for c, p in lexicon.COINS)}], lambda x: x IS NOT NULL), ',') AS coins, regexp_matches(t, {_quoted('(?i)' + lexicon.TOPIC)}) AS on_topic FROM t"""


def o5_8_board_text(spark, sf_dir):
    """Board markup cleaned: of every page, and of fixed posts (O5.8)."""
    fixed = spark.createDataFrame([(-1, "&gt;be me<br>&gt;&gt;12345 buys &quot;ETH&quot; &amp;  <b>waits</b>"), (-2, ">>77 ok\n>green text\n  two   spaces"), (-3, "")], "page_id long, html string")
    rows = read(spark, sf_dir, "pages").select("page_id", "html").unionByName(fixed)
    text = P.cleaned(F.col("html"))
    return rows.select("page_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("digest"))


S5_8 = r"""WITH p AS (SELECT page_id, html FROM pages UNION ALL VALUES (-1, '&gt;be me<br>&gt;&gt;12345 buys &quot;ETH&quot; &amp;  <b>waits</b>'), (-2, '>>77 ok' || chr(10) || '>green text' || chr(10) || '  two   spaces'), (-3, '')),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#039;', chr(39)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM p),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '(?m)^>+', '', 'g'), '>>(\d+)', '', 'g') AS t FROM e),
w AS (SELECT page_id, regexp_replace(regexp_replace(t, '[\s\x{A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM c) SELECT page_id, length(t) AS n_chars, sha256(t) AS digest FROM w"""


def o5_17_stat_numbers(spark, sf_dir):
    """Counts written as 1.2K, 3m or 1,500 (O5.17): of fixed texts and of order totals written that way."""
    fixed = spark.createDataFrame([(-1, "1.2K likes"), (-2, "3m"), (-3, "1,500"), (-4, "none"), (-5, " 12 k "), (-6, "0.5M")], "id long, t string")
    totals = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("K")).alias("t"))
    return totals.unionByName(fixed).select("id", P.stat_number(F.col("t")).alias("n"))


S5_17 = r"""WITH t AS (SELECT o_orderkey AS id, floor(o_totalprice / 1000)::BIGINT || 'K' AS t FROM orders UNION ALL VALUES (-1, '1.2K likes'), (-2, '3m'), (-3, '1,500'), (-4, 'none'), (-5, ' 12 k '), (-6, '0.5M')),
x AS (SELECT id, lower(replace(t, ',', '')) AS t FROM t) SELECT id, coalesce(trunc(TRY_CAST(regexp_extract(t, '([\d.]+)\s*([km])?', 1) AS DOUBLE) * CASE regexp_extract(t, '([\d.]+)\s*([km])?', 2) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END)::BIGINT, 0) AS n FROM x"""


def o5_22_blend(spark, sf_dir):
    """A model's score of a post's title and the lexicon's, 70 to 30 (O5.20 to O5.22). The model's scores are an input: here -1
    to 1 by post number."""
    rows = post_texts(raw_posts(spark, sf_dir)).select("raw_id", "title", ((F.pmod("raw_id", F.lit(21)) - 10) / 10).alias("model"))
    return rows.select("raw_id", r6("model").alias("model"), r6(P.boost(F.col("title"))).alias("boost"), r6(P.blended(F.col("title"), F.col("model"))).alias("score"))


S5_22 = f"""WITH {_POSTS_SQL}, m AS (SELECT raw_id, title, (((raw_id % 21) + 21) % 21 - 10) / 10.0::DOUBLE AS model FROM texts)
SELECT raw_id, round(model + 1e-9, 6) AS model, round(CASE WHEN len(list_filter(lexicon, lambda e: contains(lower(title), e.term))) > 0 THEN least(1.0::DOUBLE, greatest(-1.0::DOUBLE, list_sum(list_transform(list_filter(lexicon, lambda e: contains(lower(title), e.term)), lambda e: e.weight)) / (2 * len(list_filter(lexicon, lambda e: contains(lower(title), e.term)))))) ELSE 0.0 END + 1e-9, 6) AS boost,
    round(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {_scored('title', '(0.7 * model + 0.3 * {boost})')})) + 1e-9, 6) AS score FROM m, (SELECT {_TERMS} AS lexicon)"""


def news(spark, sf_dir):
    """News items with votes, out of the events: news_id, hour, kind, coin, positive, negative, text_score."""
    k = F.col("raw_id")
    return scores(spark, sf_dir).where("final_score is not null").select(k.alias("news_id"), (F.floor(F.col("ts") / 3600) * 3600).alias("hour"), F.col("source").alias("kind"), F.element_at(F.array(*map(F.lit, ["BTC", "ETH", "SOL"])), (k % 3 + 1).cast("int")).alias("coin"), (k % 13).alias("positive"), (k % 7).alias("negative"), F.col("final_score").alias("text_score"))


_NEWS_SQL = f"{SCORES_SQL}, news AS (SELECT raw_id AS news_id, ts // 3600 * 3600 AS hour, source AS kind, ['BTC', 'ETH', 'SOL'][raw_id % 3 + 1] AS coin, raw_id % 13 AS positive, raw_id % 7 AS negative, final_score AS text_score FROM scores WHERE final_score IS NOT NULL)"


def o5_24_news_scores(spark, sf_dir):
    """Votes and text, 70 to 30, and confidence by votes (O5.24)."""
    n = F.col("positive") + F.col("negative") + 1
    votes = (F.col("positive") - F.col("negative")) / n
    return news(spark, sf_dir).select("news_id", "coin", r6(P.clamped(0.7 * votes + 0.3 * F.col("text_score"))).alias("score"), r6(F.least(F.lit(0.9), 0.3 + n / 100)).alias("confidence"), n.alias("sample_size"))


S5_24 = f"""WITH {_NEWS_SQL} SELECT news_id, coin, round(least(1.0, greatest(-1.0, 0.7::DOUBLE * (positive - negative) / (positive + negative + 1) + 0.3 * text_score)) + 1e-9, 6) AS score,
    round(least(0.9::DOUBLE, 0.3::DOUBLE + (positive + negative + 1) / 100) + 1e-9, 6) AS confidence, positive + negative + 1 AS sample_size FROM news"""


def o4_43_news_hours(spark, sf_dir):
    """News of an hour: mean vote sentiment of items with votes, kinds, whether two coins occur (O4.43)."""
    votes = F.try_divide(F.col("positive") - F.col("negative"), F.col("positive") + F.col("negative"))
    return news(spark, sf_dir).groupBy("hour").agg(F.count("*").alias("n"), r6(F.coalesce(F.avg(votes), F.lit(0.0))).alias("sentiment"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.bool_or(F.col("coin") == "BTC").alias("has_btc"), F.bool_or(F.col("coin") == "ETH").alias("has_eth"))


S4_43 = f"""WITH {_NEWS_SQL} SELECT hour, count(*) AS n, round(coalesce(avg((positive - negative) / nullif(positive + negative, 0)), 0.0) + 1e-9, 6) AS sentiment, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, bool_or(coin = 'BTC') AS has_btc, bool_or(coin = 'ETH') AS has_eth FROM news GROUP BY 1"""

QUERIES = {f.__name__: f for f in (o5_4_post_scores, o5_5_aggregations, o5_6_coins, o5_8_board_text, o5_17_stat_numbers, o5_22_blend, o5_24_news_scores, o4_43_news_hours)}
ORACLE_SQL = {"o5_4_post_scores": S5_4, "o5_5_aggregations": S5_5, "o5_6_coins": S5_6, "o5_8_board_text": S5_8, "o5_17_stat_numbers": S5_17, "o5_22_blend": S5_22, "o5_24_news_scores": S5_24, "o4_43_news_hours": S4_43}
