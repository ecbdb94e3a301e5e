"""Post scoring as column expressions: texts out of raw posts, segment categories, lexicon scores, aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

MIN_COMMENTS, SHORTEST, MOST_SEGMENTS, TITLE_CHARS = 4, 20, 20, 10
METHODS = ["mean", "title_weighted", "extremes", "dominant", "first_last"]


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_human(author: Column, body: Column) -> Column:
    """A comment that counts: has a body, and its author is no bot."""
    name = F.coalesce(author, F.lit(""))
    return (F.coalesce(body, F.lit("")) != "") & ~name.isin(lexicon.BOTS) & ~F.lower(name).endswith("bot")


def distinct_paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines that were not there before, in order, untrimmed."""
    parts = F.split(c, "\n\n")
    plain = F.transform(parts, stripped)
    return F.array_join(F.filter(parts, lambda p, i: (stripped(p) != "") & (F.array_position(plain, stripped(p)) == i + 1)), "\n\n")


def segments(c: Column) -> Column:
    """Trimmed pieces between blank lines that are long enough, the first MOST_SEGMENTS."""
    return F.slice(F.filter(F.transform(F.split(c, "\n\n+"), stripped), lambda x: F.length(x) >= SHORTEST), 1, MOST_SEGMENTS)


def category(c: Column, categories: list[tuple[str, list[str]]] = lexicon.CATEGORIES) -> Column:
    out = F.lit("STANDARD")
    for name, patterns in reversed(categories):
        out = F.when(F.lower(c).rlike("(?i)" + "|".join(patterns)), name).otherwise(out)
    return out


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))


def boost(c: Column, weights: list[tuple[str, float]] = lexicon.WEIGHTS) -> Column:
    """Mean weight of the terms that occur, halved, in [-1, 1]; 0 without any."""
    low = F.lower(c)
    hits = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), w) for t, w in weights)))
    total = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(hits) > 0, clamped(total / (2 * F.size(hits)))).otherwise(0.0)


def corrected(c: Column, score: Column, patterns: list[tuple[str, float]] = lexicon.CORRECTIONS) -> Column:
    """A score moved by 0.3 of the sum of all corrections whose pattern occurs."""
    change = F.lit(0.0)
    for p, w in patterns:
        change = change + F.when(F.lower(c).rlike("(?i)" + p), w).otherwise(0.0)
    return F.when(change == 0, score).otherwise(clamped(score + 0.3 * change))


def blended(c: Column, model: Column) -> Column:
    """A model's score and the lexicon's, 70 to 30, corrected."""
    return clamped(corrected(c, 0.7 * model + 0.3 * boost(c)))


def scored(c: Column) -> Column:
    """The lexicon's own score of a text, where no model is at hand."""
    return corrected(c, boost(c))


def mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def combined(title: Column, body: Column, method: str = "title_weighted") -> Column:
    """One score of a title's score (or null) and an array of segment scores, by one of METHODS; 0 where there is none."""
    every = F.concat(F.filter(F.array(title), lambda x: x.isNotNull()), body)
    both = title.isNotNull() & (F.size(body) > 0)
    mean = mean_of(every)
    if method == "title_weighted":
        out = F.when(both, 0.2 * title + 0.8 * mean_of(body)).otherwise(mean)
    elif method == "extremes":
        out = F.greatest(F.array_max(every), F.lit(0.0)) + F.least(F.array_min(every), F.lit(0.0))
    elif method == "dominant":
        pos, neg = F.filter(every, lambda x: x > 0.1), F.filter(every, lambda x: x < -0.1)
        out = F.when(F.size(pos) > F.size(neg), mean_of(pos)).when(F.size(neg) > F.size(pos), mean_of(neg)).otherwise(mean)
    elif method == "first_last":
        out = F.when(both, 0.4 * title + 0.3 * F.get(body, F.lit(0)) + 0.3 * F.element_at(body, -1)).otherwise(mean)
    else:
        out = mean
    return F.when(F.size(every) == 0, 0.0).otherwise(out)


def stat_number(c: Column) -> Column:
    """1.2K and 3m as whole numbers, 0 where there is no number."""
    plain = F.lower(F.replace(c, F.lit(","), F.lit("")))
    n = F.regexp_extract(plain, r"([\d.]+)\s*([km])?", 1).try_cast("double")
    unit = F.regexp_extract(plain, r"([\d.]+)\s*([km])?", 2)
    return F.coalesce((n * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)).cast("long"), F.lit(0).cast("long"))


def cleaned(c: Column) -> Column:
    """Board text: entities decoded, tags out, leading ">" and references out, white space squeezed."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.regexp_replace(c, "(?m)^>+", "")
    c = F.regexp_replace(c, r">>(\d+)", "")
    return stripped(F.regexp_replace(c, r"[\s ]+", " "))
