"""Valence scores of texts by rules over their words: a lexicon table, and words around a hit that turn or strengthen it.

Rules, for a hit at place i: capitals where the text is not all in capitals strengthen it; each of the three words before it, the nearest
first, may be a booster (weaker by 5 and 10 per cent at the second and third place, with capitals of its own) or a negation, which turns
and weakens the value so far; "never so" and "never this" before a hit strengthen it instead. Hits before the text's first contrast word
count half, those after it half more. Exclamation and question marks strengthen the sum, which is then brought into [-1, 1].

A text's words are exploded with their three forerunners, so that the lexicon is joined by word and no window is needed; only hits reach
the aggregate. A word of the rules is no hit, whatever the lexicon says.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much capitals add, what a negation multiplies by, weights of boosters by distance, weights around a contrast word,
#: what marks add, and the constant of the final curve.
CAPITALS, TURN, NEVER = 0.733, -0.74, 1.25
REACH = (1.0, 0.95, 0.9)
BEFORE, AFTER = 0.5, 1.5
EXCLAIM, MOST_EXCLAIM, ASK, MANY_ASK = 0.292, 4, 0.18, 0.96
CURVE = 15.0
#: Words of the rules.
UP, DOWN = 0.293, -0.293
BOOSTERS = {
    "absolutely": UP, "amazingly": UP, "awfully": UP, "completely": UP, "considerably": UP, "deeply": UP, "enormously": UP, "entirely": UP, "especially": UP, "extremely": UP, "fully": UP, "greatly": UP, "highly": UP,
    "hugely": UP, "incredibly": UP, "intensely": UP, "majorly": UP, "more": UP, "most": UP, "particularly": UP, "purely": UP, "quite": UP, "really": UP, "remarkably": UP, "so": UP, "substantially": UP, "thoroughly": UP,
    "totally": UP, "tremendously": UP, "unbelievably": UP, "utterly": UP, "very": UP, "almost": DOWN, "barely": DOWN, "hardly": DOWN, "kinda": DOWN, "less": DOWN, "little": DOWN, "marginally": DOWN, "occasionally": DOWN,
    "partly": DOWN, "scarcely": DOWN, "slightly": DOWN, "somewhat": DOWN, "sorta": DOWN,
}
NEGATIONS = (
    "ain't", "aren't", "arent", "can't", "cannot", "cant", "couldn't", "couldnt", "despite", "didn't", "didnt", "doesn't", "doesnt", "don't", "dont", "hadn't", "hasn't", "haven't", "isn't", "isnt", "neither", "never",
    "no", "none", "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "shouldn't", "uh-uh", "wasn't", "wasnt", "weren't", "without", "won't", "wont", "wouldn't", "wouldnt",
)
CONTRAST = ("but",)


@dataclass(frozen=True)
class Rules:
    """Words that act on others."""

    boosters: dict[str, float] = field(default_factory=lambda: BOOSTERS)
    negations: tuple[str, ...] = NEGATIONS
    contrast: tuple[str, ...] = CONTRAST


def words(text: Column) -> Column:
    """Words between white space; signs around a word go unless that leaves two characters or fewer."""
    bare = lambda w: F.regexp_replace(w, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")
    parts = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.struct(w.alias("w"), bare(w).alias("b")))
    return F.transform(parts, lambda x: F.when(F.length(x["b"]) <= 2, x["w"]).otherwise(x["b"]))


def in_capitals(word: Column) -> Column:
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"\p{Ll}")


def emphasis(text: Column) -> Column:
    asks = F.regexp_count(text, F.lit(r"\?"))
    return F.least(F.regexp_count(text, F.lit("!")), F.lit(MOST_EXCLAIM)) * EXCLAIM + F.when(asks <= 1, 0.0).when(asks <= 3, asks * ASK).otherwise(MANY_ASK)


def _valued(hits: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``_v``, the value of each hit (word, valence, before: the three words before it, mixed: capitals mean something). A step a
    column, since each uses the one before several times."""
    sign = lambda v: F.when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0)
    v = F.col("_v")
    loud = lambda w: F.when(F.col("mixed") & in_capitals(w), CAPITALS).otherwise(0.0)
    boost_of = F.create_map(*(F.lit(x) for pair in rules.boosters.items() for x in pair)) if rules.boosters else None
    hits = hits.withColumn("_v", F.col("valence") + loud(F.col("word")) * sign(F.col("valence")))
    near = F.lower(F.get("before", F.lit(0)))
    for k, weight in enumerate(REACH):
        raw = F.get("before", F.lit(k))
        hits = hits.withColumn("_word", F.lower(raw))
        word = F.col("_word")
        if boost_of is not None:
            amount = F.element_at(boost_of, word)
            hits = hits.withColumn("_more", F.when(amount.isNotNull(), (amount + loud(raw)) * weight).otherwise(0.0))
            hits = hits.withColumn("_v", v + F.col("_more") * sign(v))
        praised = (word == "never") & near.isin("so", "this") if k else F.lit(False)
        hits = hits.withColumn("_v", F.when(praised, v * NEVER).when(word.isin(*rules.negations) | word.contains("n't"), v * TURN).otherwise(v))
    return hits


def score(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", rules: Rules | None = None) -> DataFrame:
    """keys (unique), compound, pos, neg and neu (shares of words), hits, of every text; lexicon: word (lower case), valence.

    Null and empty texts score 0 with no shares. The lexicon may have any size: it is joined by word."""
    rules = rules or Rules()
    own = [*rules.boosters, *rules.negations, *rules.contrast]
    terms = lexicon.where(~F.col("word").isin(*own) & ~F.col("word").contains("n't")).groupBy("word").agg(F.max("valence").alias("valence"))
    terms = terms.where("word <> ''").unionByName(texts.sparkSession.createDataFrame([("", 0.0)], "word string, valence double"))  # every text has one hit
    body = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select(*keys, words(body).alias("_w"), emphasis(body).alias("_marks"))
    loud = F.size(F.filter("_w", in_capitals))
    turn = F.array_position(F.transform("_w", lambda w: F.lower(w).isin(*rules.contrast)), F.lit(True)) if rules.contrast else F.lit(0)
    rows = rows.withColumns({"_n": F.size("_w"), "mixed": (loud > 0) & (loud < F.size("_w")), "_turn": turn})
    spread = rows.select(*keys, "_marks", "_n", "mixed", "_turn", "_w", F.posexplode(F.concat("_w", F.array(F.lit("")))).alias("_i", "word"))
    before = F.array(*(F.get("_w", F.col("_i") - k) for k in (1, 2, 3)))
    placed = spread.select(*keys, "_marks", "_n", "mixed", "_turn", (F.col("_i") + 1).alias("_at"), "word", F.lower("word").alias("_key"), before.alias("before"))
    hits = _valued(placed.join(terms.withColumnRenamed("word", "_key"), "_key"), rules)
    weight = F.when((F.col("_turn") > 0) & (F.col("_at") < F.col("_turn")), BEFORE).when((F.col("_turn") > 0) & (F.col("_at") > F.col("_turn")), AFTER).otherwise(1.0)
    v = F.col("_v") * weight
    sums = hits.groupBy(*keys).agg(
        F.sum(v).alias("_sum"), F.sum(F.when(v > 0, v + 1)).alias("_pos"), F.sum(F.when(v < 0, 1 - v)).alias("_neg"), F.count_if(v != 0).alias("hits"), F.first("_marks").alias("_marks"), F.first("_n").alias("_n"),
    ).na.fill(0.0, ["_pos", "_neg"])
    total = F.col("_sum") + F.when(F.col("_sum") > 0, F.col("_marks")).when(F.col("_sum") < 0, -F.col("_marks")).otherwise(0.0)
    pos = F.col("_pos") + F.when(F.col("_pos") > F.col("_neg"), F.col("_marks")).otherwise(0.0)
    neg = F.col("_neg") + F.when(F.col("_pos") < F.col("_neg"), F.col("_marks")).otherwise(0.0)
    neu = F.col("_n") - F.col("hits")
    share = lambda c: F.coalesce(F.try_divide(c, pos + neg + neu), F.lit(0.0))
    return sums.select(*keys, (total / F.sqrt(total * total + CURVE)).alias("compound"), share(pos).alias("pos"), share(neg).alias("neg"), share(neu).alias("neu"), "hits")
