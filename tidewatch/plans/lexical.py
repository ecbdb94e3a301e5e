"""Texts scored by words: valence rules and novelty against all earlier documents (SURVEY O9.23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import novelty, valence
from ..functions.lexicon import STOP_WORDS
from ..sources.shared import new_folder
from ..sources.tables import read
from .dashboard import r6

#: The invented prose has few words of the rules: some of its own stand in for boosters and the contrast word.
RULES = valence.Rules(boosters={**valence.BOOSTERS, "this": 0.293, "that": -0.293, "und": 0.293}, negations=(*valence.NEGATIONS, "nicht", "pas"), contrast=("but", "que", "for"))


def learned_lexicon(spark, sf_dir):
    """word, valence: words of at least 5 labelled documents, by how far the share of good documents among them is from that of all."""
    labels = read(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id")
    each = docs.select("doc_id", "quality", F.explode(F.array_distinct(F.transform(valence.words(F.col("text")), F.lower))).alias("word"))
    by = each.groupBy("word").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).where("n >= 5")
    overall = labels.join(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").agg(F.count("*").alias("all_n"), F.sum("quality").alias("all_good"))
    tenths = F.floor((F.col("good") * F.col("all_n") - F.col("all_good") * F.col("n")) * 100 / (F.col("n") * F.col("all_n")) + 0.5)
    return by.crossJoin(overall).select("word", (tenths / 10).alias("valence"))  # overall is one row


def o5_19_valence(spark, sf_dir):
    """Every conversation turn scored by valence rules over a lexicon learned from labelled documents (O5.19)."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = valence.score(turns, learned_lexicon(spark, sf_dir), ["conv_id", "turn"], rules=RULES)
    return out.select("conv_id", "turn", *(r6(c).alias(c) for c in ("compound", "pos", "neg", "neu")), "hits")


def _list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _words_sql(c):
    bare = r"regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')"
    return rf"list_transform(list_filter(string_split_regex({c}, '[\x20\x09-\x0D]+'), lambda w: w <> ''), lambda w: CASE WHEN length({bare}) <= 2 THEN w ELSE {bare} END)"


_CAPS = r"(regexp_matches({0}, '\p{{Lu}}') AND NOT regexp_matches({0}, '\p{{Ll}}'))"
_BOOST = "CASE lower({0}) " + " ".join("WHEN '{}' THEN {}::DOUBLE".format(w.replace("'", "''"), a) for w, a in RULES.boosters.items()) + " END"


def _steps():
    """One common table expression a place before the hit."""
    out, last = [], "v0"
    for k, weight in enumerate(valence.REACH, 1):
        p = f"p{k}"
        loud = f"(coalesce({_BOOST.format(p)}, 0) * sign(v) + CASE WHEN mixed AND {_CAPS.format(p)} THEN 0.733::DOUBLE * sign(v) ELSE 0 END) * {weight}::DOUBLE"
        boosted = f"v + CASE WHEN {_BOOST.format(p)} IS NOT NULL AND v <> 0 THEN {loud} ELSE 0 END"
        never = f"WHEN lower({p}) = 'never' AND lower(p1) IN ('so', 'this') THEN u * 1.25::DOUBLE" if k > 1 else ""
        out.append(f"b{k} AS (SELECT *, {boosted} AS u FROM {last}), v{k} AS (SELECT * EXCLUDE (u, v), CASE {never} WHEN lower({p}) IN ({_list(RULES.negations)}) OR contains(lower({p}), 'n''t') THEN u * -0.74::DOUBLE ELSE u END AS v FROM b{k})")
        last = f"v{k}"
    return ", ".join(out)


S5_19 = rf"""WITH labelled AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
each AS (SELECT doc_id, quality, unnest(list_distinct(list_transform({_words_sql('text')}, lambda w: lower(w)))) AS word FROM labelled),
overall AS (SELECT count(*) AS all_n, sum(quality) AS all_good FROM labelled),
lexicon AS (SELECT word, floor((good * all_n - all_good * n) * 100 / (n * all_n) + 0.5) / 10 AS valence FROM (SELECT word, count(*) AS n, sum(quality)::BIGINT AS good FROM each GROUP BY 1 HAVING count(*) >= 5), overall
    WHERE word <> '' AND word NOT IN ({_list([*RULES.boosters, *RULES.negations, *RULES.contrast])}) AND NOT contains(word, 'n''t')),
t AS (SELECT conv_id, turn, coalesce(text, '') AS text, {_words_sql("coalesce(text, '')")} AS w FROM conversations),
r AS (SELECT conv_id, turn, w, len(w) AS n, len(list_filter(w, lambda x: {_CAPS.format('x')})) AS loud, coalesce(list_position(list_transform(w, lambda x: lower(x) IN ({_list(RULES.contrast)})), true), 0) AS turning,
    least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0.0 WHEN length(text) - length(replace(text, '?', '')) <= 3 THEN (length(text) - length(replace(text, '?', ''))) * 0.18::DOUBLE ELSE 0.96::DOUBLE END AS marks FROM t),
x AS (SELECT *, loud > 0 AND loud < n AS mixed, unnest(range(1, n + 1)) AS i FROM r),
h AS (SELECT conv_id, turn, i, mixed, turning, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS p1, CASE WHEN i > 2 THEN w[i - 2] END AS p2, CASE WHEN i > 3 THEN w[i - 3] END AS p3 FROM x),
v0 AS (SELECT h.*, l.valence + CASE WHEN mixed AND {_CAPS.format('h.word')} THEN 0.733::DOUBLE * sign(l.valence) ELSE 0 END AS v FROM h JOIN lexicon l ON l.word = lower(h.word)),
{_steps()},
g AS (SELECT conv_id, turn, v * CASE WHEN turning > 0 AND i < turning THEN 0.5::DOUBLE WHEN turning > 0 AND i > turning THEN 1.5::DOUBLE ELSE 1 END AS v FROM v3),
s AS (SELECT conv_id, turn, sum(v) AS total, coalesce(sum(v + 1) FILTER (v > 0), 0) AS pos, coalesce(sum(1 - v) FILTER (v < 0), 0) AS neg, count(*) FILTER (v <> 0) AS hits FROM g GROUP BY 1, 2),
a AS (SELECT r.conv_id, r.turn, r.n, coalesce(total, 0) + CASE WHEN total > 0 THEN marks WHEN total < 0 THEN -marks ELSE 0 END AS total, coalesce(pos, 0) + CASE WHEN pos > neg THEN marks ELSE 0 END AS pos, coalesce(neg, 0) + CASE WHEN pos < neg THEN marks ELSE 0 END AS neg, coalesce(hits, 0) AS hits FROM r LEFT JOIN s USING (conv_id, turn))
SELECT conv_id, turn, round(total / sqrt(total * total + 15) + 1e-9, 6) AS compound, round(coalesce(pos / nullif(pos + neg + n - hits, 0), 0) + 1e-9, 6) AS pos, round(coalesce(neg / nullif(pos + neg + n - hits, 0), 0) + 1e-9, 6) AS neg, round(coalesce((n - hits) / nullif(pos + neg + n - hits, 0), 0) + 1e-9, 6) AS neu, hits FROM a"""

def o9_23_batch_novelty(spark, sf_dir):
    """How new every document whose id is divisible by 100 is against all documents before it (O9.23, whole batch)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("q"))
    out = novelty.against_earlier(docs, queries, new_folder(spark, "novelty"))
    return out.select(F.col("q").alias("doc_id"), r6("novelty").alias("novelty"))


S9_23 = rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_list(STOP_WORDS)})) AS w FROM documents),
e AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM t),
c AS (SELECT doc_id, gram, count(*) AS tf FROM e GROUP BY 1, 2), d AS (SELECT gram, count(*) AS df FROM c GROUP BY 1),
r AS (SELECT doc_id, gram, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS raw FROM c JOIN d USING (gram)),
u AS (SELECT doc_id, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM r),
p AS (SELECT q.doc_id, o.doc_id AS other, sum(q.w * o.w) AS cosine FROM u q JOIN u o ON q.gram = o.gram AND o.doc_id < q.doc_id WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
m AS (SELECT doc_id, max(cosine) AS best FROM p GROUP BY 1)
SELECT doc_id, round(greatest(0.0, least(1.0, 1 - coalesce(best, 0))) + 1e-9, 6) AS novelty FROM documents LEFT JOIN m USING (doc_id) WHERE doc_id % 100 = 0"""

QUERIES = {f.__name__: f for f in (o5_19_valence, o9_23_batch_novelty)}
ORACLE_SQL = {"o5_19_valence": S5_19, "o9_23_batch_novelty": S9_23}
