"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

All of it is DataFrame and SQL expressions. Four base kinds (email, ip, card, phone) are found by pattern and
checked by rule; base spans always stay. Further candidates are looked for widely, so that most of them are no personal
data: any key and value ("name = value", "name: value"), spelled-out addresses, long codes of letters and digits, any
number, and matches that fail a base rule. Candidates that overlap a base span drop out. Labelers vote 1, 0 or abstain (-1)
on every candidate: the strict pattern, a gazetteer of cue words among the words before the value and its key, the signs
before it (context), shape, and length. Expectation-maximisation over vote patterns (at most 2 x 3 ** labelers rows,
however large the corpus) estimates how often each labeler casts each vote on true and on false spans; base spans, which
their rules prove, count as true throughout. The posteriors are the soft labels that train the final classifier, naive
Bayes over votes and span features. Candidates that it accepts are added, the leftmost of overlapping ones.

Patterns start where a run of their first class starts (or where the last match ended), which finds what the
plain patterns find without their quadratic scans. Offsets are code points.

Edge cases: null and empty texts have no spans; repeated rows each get a row; values of any length are one span; an
empty table gives an empty result; extra columns are ignored, and ``redact`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stored, table

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns with possessive repeats; the leading guard is explained in the module text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "%@%", "ip": "%.%", "card": "%", "phone": "%+%"}
#: Wider candidates that are no base kind, first kinds first where they overlap.
WIDE = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]*+\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{8,}+[\"']?",
    "handle": r"(?i)(?<![a-z0-9_.-])[a-z0-9_.-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++ ?[\[(] ?dot ?[\])] ?[a-z]{2,}+",
    "code": r"(?<![A-Za-z0-9_/+=.-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{16,}+",
    "number": r"(?<![A-Za-z0-9])[0-9]++(?:[.,-][0-9]++)*+",
}
#: Gazetteer of cue words (fixed values); a deployment passes its own list, at most a few hundred words.
CUES = ["email", "mail", "contact", "phone", "tel", "call", "fax", "mobile", "ip", "address", "host", "server", "card", "visa", "iban", "account", "ssn", "token", "secret", "password", "passwd", "key", "apikey", "credential", "auth"]
CONTEXT = 32
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
LABELERS = ["strict", "gazetteer", "context", "shape", "length"]
VOTES = [-1, 0, 1]
ROUNDS = 12
ACCEPT = 0.5
#: What EM starts from: shares of the votes -1, 0, 1 on true and on false spans.
START = ((0.2, 0.2, 0.6), (0.2, 0.6, 0.2))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    def part(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)
    total = F.aggregate(F.transform(at, part), F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


def valid(kind: str, c: Column) -> Column:
    """The rule a match of a base kind must pass."""
    if kind == "ip":
        return c.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(c))
        return F.when(n.between(16, 19), luhn(_digits(c))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(c)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, hint: str = "%") -> Column:
    """Leftmost non-overlapping matches as an array of struct(start, end, value); offsets in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # what lies between the matches
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, first, step)["out"]
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.like(hint) & text.rlike(pattern), spans).otherwise(none)


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def located(docs: DataFrame) -> DataFrame:
    """docs' doc_id with base and candidate spans; every candidate has the text before it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    # every pattern runs once; what passes its rule is told from what fails afterwards
    raw = rows.select("*", *(matches(F.col("text"), BASE[k], HINTS[k]).alias(f"raw_{k}") for k in KINDS))
    wide = raw.select("*", *(matches(F.col("text"), p).alias(f"raw_{k}") for k, p in WIDE.items()))
    passing = lambda k, ok: _tagged(F.filter(f"raw_{k}", lambda s: valid(k, s["value"]) == F.lit(ok)), k)
    based = wide.withColumn("base", F.concat(*(passing(k, True) for k in KINDS)))
    failing = [passing(k, False) for k in ("ip", "phone")]
    further = based.withColumn("wide", F.filter(F.concat(*(_tagged(F.col(f"raw_{k}"), k) for k in WIDE), *failing), lambda s: ~_overlaps(F.col("base"), s)))

    def before(spans: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.substring("text", F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, s["start"] - F.greatest(s["start"] - CONTEXT, F.lit(0))).alias("before")))

    return further.select("doc_id", "row", before("base").alias("base"), before("wide").alias("wide"))


def voted(spans: DataFrame) -> DataFrame:
    """spans: row, kind, start, end, value, before, is_base. Adds a vote of each labeler: 1, 0, or -1 for abstain."""
    keyed = F.col("kind") == "secret"
    sign = r"^[A-Za-z0-9_-]+\s{0,3}[=:]\s{0,3}"
    key = F.when(keyed, F.regexp_extract("value", r"^[A-Za-z0-9_-]+", 0)).otherwise(F.lit(""))
    v = F.when(keyed, F.regexp_replace("value", sign, "")).otherwise(F.col("value"))  # the value itself, with its quotes
    plain = F.regexp_replace(v, "[\"']", "")
    n, digits = F.length(plain), F.length(_digits(v))
    mixed = plain.rlike("[0-9]") & plain.rlike("[A-Za-z]")
    lead = F.when(keyed, F.concat("before", key)).otherwise(F.col("before"))
    words = F.split(F.lower(lead), "[^a-z]+")
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    strict = F.when(F.col("is_base"), 1).when(keyed, vote(v.rlike("^[\"'].*[\"']$") & mixed, ~mixed)).when(F.col("kind") == "handle", 1).when(F.col("kind") == "code", -1).otherwise(0)
    gazetteer = F.when(F.arrays_overlap(words, F.array(*map(F.lit, CUES))), 1).otherwise(0)
    context = vote(F.col("before").rlike(r"(?:[:=(<\"']\s?|\b(?:is|at|to|via)\s)$"), F.col("before").rlike(r"(?i)(?:[0-9.,]\s?|\b(?:version|v|page|chapter|section|no|about)\.?\s)$"))
    shape = (
        F.when(F.col("kind") == "email", v.rlike(r"\.[A-Za-z]{2,24}$"))
        .when(F.col("kind").isin("secret", "code"), mixed & (F.length(F.regexp_replace(plain, "[^0-9]", "")) >= 3))
        .when(F.col("kind") == "handle", F.lit(True))
        .when(F.col("kind") == "ip", v.rlike(r"^[1-9]"))
        .when(F.col("kind") == "number", F.when(digits < 8, False))  # digits alone prove nothing
        .otherwise(digits >= 8)
    )
    shape = F.coalesce(shape.cast("int"), F.lit(-1))
    return spans.select("*", strict.alias("strict"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), (n >= 7).cast("int").alias("length"))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, dict[int, tuple[float, float]]], float]:
    """EM over vote patterns (is_base, votes, n): by labeler and vote its share on true and on false spans, and the share of
    true spans. Counts are smoothed by one of each vote."""
    model = {x: dict(zip(VOTES, zip(*START, strict=True), strict=True)) for x in LABELERS}
    prior = 0.5
    for _ in range(rounds):
        rows = patterns.withColumn("p", posterior(model, prior))
        sums = [F.sum(F.col("n") * F.col("p")).alias("true"), F.sum("n").alias("all")]
        for x in LABELERS:
            for v in VOTES:
                chosen = F.when(F.col(x) == v, F.col("n")).otherwise(0)
                sums += [F.sum(chosen * F.col("p")).alias(f"{x}_{v}_t"), F.sum(chosen * (1 - F.col("p"))).alias(f"{x}_{v}_f")]
        r = rows.agg(*sums).first()
        if not r["all"]:
            break
        true, false = r["true"], r["all"] - r["true"]
        prior = (true + 1) / (r["all"] + 2)
        model = {x: {v: ((r[f"{x}_{v}_t"] + 1) / (true + 3), (r[f"{x}_{v}_f"] + 1) / (false + 3)) for v in VOTES} for x in LABELERS}
    return model, prior


def posterior(model: dict[str, dict[int, tuple[float, float]]], prior: float) -> Column:
    """P(span is personal data | votes) with independent labelers; base spans are true."""
    score = F.lit(math.log(prior / (1 - prior)))
    for x in LABELERS:
        part = F.lit(0.0)
        for v, (t, f) in model[x].items():
            part = F.when(F.col(x) == v, math.log(t / f)).otherwise(part)
        score = score + part
    return F.when(F.col("is_base"), 1.0).otherwise(1 / (1 + F.exp(-score)))


def _traits() -> dict[str, Column]:
    """Span features of the classifier beside the votes: a few values each."""
    n = F.length("value")
    return {
        "f_kind": F.col("kind"),
        "f_length": F.when(n < 8, "a").when(n < 16, "b").when(n < 32, "c").otherwise("d"),
        "f_digits": F.floor(4 * F.length(_digits(F.col("value"))) / F.greatest(n, F.lit(1))).cast("string"),
    }


def train_classifier(spans: DataFrame, model: dict[str, dict[int, tuple[float, float]]], prior: float) -> DataFrame:
    """Naive Bayes weights (feature, value, weight) from soft labels; at most a few dozen rows. The row with a null
    feature is the intercept."""
    soft = spans.withColumns(_traits()).withColumn("p", posterior(model, prior))
    names = [*LABELERS, *_traits()]
    soft = soft.groupBy(*names).agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))  # a few thousand rows at most
    pairs = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(x).alias("feature"), F.col(x).cast("string").alias("value")) for x in names)))
    sums = soft.select("t", "f", pairs.alias("x")).groupBy("x.feature", "x.value").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    all_t, all_f = (F.max(F.when(F.col("feature").isNull(), F.col(c))).over(Window.partitionBy()) for c in ("t", "f"))
    weight = F.when(F.col("feature").isNull(), F.log((F.col("t") + 1) / (F.col("f") + 1))).otherwise(F.log(((F.col("t") + 1) / (F.col("all_t") + 4)) / ((F.col("f") + 1) / (F.col("all_f") + 4))))
    return sums.withColumns({"all_t": all_t, "all_f": all_f}).select("feature", "value", weight.alias("weight"))


def detect(docs: DataFrame, folder: str) -> DataFrame:
    """A stored table of doc_id, row, base and added spans (arrays of kind, start, end)."""
    found = stored(located(docs), f"{folder}/found")
    explode = lambda c, base: found.where(F.size(c) > 0).select("row", F.explode(c).alias("s"), F.lit(base).alias("is_base")).select("row", "s.*", "is_base")
    spans = voted(explode("base", True).unionByName(explode("wide", False)))
    patterns = stored(spans.groupBy("is_base", *LABELERS).agg(F.count("*").alias("n")).coalesce(1), f"{folder}/patterns")
    model, prior = reliabilities(patterns)
    weights = {(r["feature"], r["value"]): r["weight"] for r in train_classifier(spans, model, prior).collect()}
    score = F.lit(float(weights.get((None, None), 0.0)))
    for x in [*LABELERS, *_traits()]:
        chosen = [(value, w) for (feature, value), w in weights.items() if feature == x]
        score = score + F.coalesce(F.element_at(F.create_map(*(F.lit(y) for pair in chosen for y in (pair[0], float(pair[1])))), F.col(x).cast("string")), F.lit(0.0)) if chosen else score
    rated = spans.where(~F.col("is_base")).withColumns(_traits()).withColumn("p", 1 / (1 + F.exp(-score)))
    accepted = rated.where(F.col("p") >= ACCEPT).groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("end")).alias("less"), "kind")).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = found.select("doc_id", "row", plain.alias("base")).join(accepted, "row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def leftmost(kept: Column, s: Column) -> Column:
        span = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["less"]).alias("end"))
        free = (F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"])
        return F.when(free, F.concat(kept, F.array(span))).otherwise(kept)

    added = F.when(F.col("more").isNull(), none).otherwise(F.aggregate(F.array_sort("more"), none, leftmost))
    return joined.select("doc_id", "row", "base", added.alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _listed(spans: Column) -> Column:
    """By kind (base kinds as listed, then the others by name), then start."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0)), F.lit(len(KINDS) + 1))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return keyed


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"), new_folder(spark, "pii"))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(_listed(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, folder: str) -> DataFrame:
    """docs with every span of the texts replaced by its kind in angle brackets, and n_chars to match."""
    rows = stored(docs.withColumn("_row_key", F.monotonically_increasing_id()), f"{folder}/rows")
    found = detect(rows.select(F.col("_row_key").alias("doc_id"), "text"), folder).select(F.col("doc_id").alias("_row_key"), F.concat("base", "added").alias("_spans")).where(F.size("_spans") > 0)
    both = rows.join(found, "_row_key", "left")
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    folded = F.aggregate(ordered, first, step)
    done = both.withColumn("_folded", F.when(F.col("_spans").isNotNull(), folded))
    tail = F.substr("text", F.col("_folded.at") + 1, F.length("text"))
    done = done.withColumn("text", F.when(F.col("_folded").isNull(), F.col("text")).otherwise(F.concat(F.col("_folded.out"), tail)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_folded").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return done.select(*docs.columns)
