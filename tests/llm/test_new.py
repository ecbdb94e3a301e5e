"""Operators 11 to 13 against brute force: fill-in-the-middle, prefix trie of families, language identification."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.oracle import difference
from tidewatch.llm import op11_fim, op12_families, op13_language

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_fim(doc_id, text):
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim(spark, make, documents, odd):
    rows = documents + odd + [(900 + i, t) for i, t in enumerate(("a<P>b", "x<S>", "<M>", "<", "<S", "P>ab<", "<<>>S>M>", "é1 ß\nAb", "<P", "a" * 300_000, "<" * 200_000))]
    df = op11_fim.fill_in_middle(make(rows, extra=True))
    got = df.withColumn("back", op11_fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(d), *map(str, plain_fim(d, t or "")), t or "") for d, t in rows)
    assert sorted((str(r["doc_id"]), str(r["n"]), r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["back"]) for r in got) == want
    assert {"plain", "psm", "spm"} <= {r["form"] for r in got}
    assert op11_fim.fill_in_middle(make([])).count() == 0


def test_fim_cuts_meet_sentinels():
    """Parts that begin or end in pieces of sentinels come back whole, wherever the cuts are."""
    text = "<S<PS>M><<M>>P>a<"
    text = text.replace("<M>", "<M")
    n = len(UNITS.findall(text))
    for low, high in itertools.combinations_with_replacement(range(n + 1), 2):
        a, b = op11_fim.cuts(text, low, high)
        assert text[:a] == "".join(UNITS.findall(text)[:low]) and text[:b] == "".join(UNITS.findall(text)[:high])


def test_fim_sql(spark, sf_dir):
    assert difference(op11_fim.op11_fim(spark, sf_dir), op11_fim.ORACLE_SQL, sf_dir) == ""


def head(c):
    return 0 if c is None else zlib.crc32(str(c).encode()) % 6


def plain_trie(rows):
    """Every node by brute force: rows are (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        base = None if c is None else c - int(np.fmod(c, 100))
        whole[c] = turns if c is None or c == base else own.get(base, [])[: head(c)] + turns[head(c) :]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    name = lambda members: min((c for c in members if c is not None), default=None)
    out = []
    for path, members in nodes.items():
        under = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        kids = {p[: len(p)] for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path}
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p, _ in under)
        saved = sum((len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in under)
        ends = sorted((c for c in members if len(whole[c]) == len(path)), key=lambda c: (c is not None, c or 0))
        digest = hashlib.sha256(",".join("null" if c is None else str(c) for c in ends).encode()).hexdigest()
        out.append((name(members), len(path), name(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, digest))
    return sorted(map(str, out))


def conversation_rows(seed, count, ids):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(ids, count):
        for t in range(rng.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, rng.choice((t, t, None)), rng.choice(("user", "assistant", None)), rng.choice(("", "a", "b", "bb", None, "é😀"))))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return rows


KEYS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed, ids, most", [(1, [*range(0, 350)], 65_536), (2, [None, *range(-250, 260)], 65_536), (3, [*range(-30, 60), 100, 200, None], 3)])
def test_families(spark, folder, seed, ids, most):
    rows = conversation_rows(seed, 80, ids)
    rows += [(7_000 + i, t, "user", "same") for i in range(60) for t in range(2)]  # a hot opening
    rows += [(9_100, t, "user", f"turn {t % 7}") for t in range(40)]  # a deep one
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("base", F.lit("x"))
    got = op12_families.trie_nodes(df.repartition(5), folder, most=most).select(*KEYS).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(rows)


def test_families_empty(spark, folder):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op12_families.trie_nodes(df, folder).count() == 0


def test_families_sql(spark, sf_dir):
    assert difference(op12_families.op12_families(spark, sf_dir), op12_families.ORACLE_SQL, sf_dir) == ""


def ways(lattice, word):
    """All segmentations of a word, as lists of piece ids."""
    word = lattice.symbols(word)

    def rest(at):
        if at == len(word):
            yield []
        for end in range(at + 1, len(word) + 1):
            if (i := lattice.ids.get(word[at:end])) is not None:
                yield from ([i, *more] for more in rest(end))

    return list(rest(0))


def test_forward_sums_all_segmentations():
    lattice, rng = op13_language.Lattice(PIECES), np.random.default_rng(1)
    words = ["a", "the", "heure", "straße", "ñandú", "語", "𐍈x", "entschlossen", "xqzj"]
    table = np.log(rng.random((3, lattice.size)))
    first, last, src, dst, ids, step, of = lattice.arcs(words)
    alpha = op13_language.forward(first, int(last[-1]) + 1, src, dst, step, table.T[ids])
    for k, w in enumerate(words):
        want = [np.log(sum(np.exp(sum(table[lang, i] for i in way)) for way in ways(lattice, w))) for lang in range(3)]
        assert np.allclose(alpha[last[k]], want)
    # expected counts: forward and backward agree with each way's share
    beta = op13_language.backward(last, int(last[-1]) + 1, src, dst, table.T[ids])
    share = np.exp(alpha[src] + table.T[ids] + beta[dst] - alpha[last][of])
    for k, w in enumerate(words):
        p = np.array([np.exp(sum(table[1, i] for i in way)) for way in ways(lattice, w)])
        counts = {}
        for way, x in zip(ways(lattice, w), p / p.sum(), strict=True):
            for i in way:
                counts[i] = counts.get(i, 0) + x
        got = {}
        for i, x, o in zip(ids.tolist(), share[:, 1].tolist(), of.tolist(), strict=True):
            if o == k:
                got[i] = got.get(i, 0) + x
        assert got.keys() == counts.keys() and all(abs(got[i] - counts[i]) < 1e-9 for i in got)


def test_word_counts(spark):
    rows = [("en", "The CAT, the cat² 5_a"), ("fr", "été x" + "y" * 70), ("en", ""), ("en", "Ⅷ 12")]
    got = {(r["lang"], r["word"]): r["n"] for r in op13_language.word_counts(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert got == {("en", "the"): 2, ("en", "cat"): 2, ("en", "a"): 1, ("fr", "été"): 1, ("fr", "x" + "y" * 63): 1, ("fr", "y" * 7): 1}


def test_language(spark, make, odd, folder):
    """Trained on the small documents table: held-out rows are right, odd rows have the stated results, copies agree."""
    docs = op13_language.remainder(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    model = op13_language.fit(docs.where("fold <> 0"), folder, PIECES)
    told = op13_language.predict(docs.where("fold = 0").select("doc_id", "text", "lang"), model, PIECES).collect()
    assert len(told) > 30 and sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told)
    assert np.allclose(np.exp(model[2]).sum(axis=1), 1, atol=1e-3) and model[0] == sorted(model[0])
    rows = op13_language.predict(make(odd, extra=True).select("doc_id", "text"), model, PIECES).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3}
    empty = op13_language.fit(docs.where("false"), folder + "-e", PIECES)
    assert [tuple(r) for r in op13_language.predict(make([(1, "text")]).select("doc_id", "text"), empty, PIECES).collect()] == [(1, "und", 0.0)]
    assert op13_language.predict(make([]).select("doc_id", "text"), model, PIECES).count() == 0


def test_long_text_is_scored_as_one(spark, make, folder, monkeypatch):
    """A text scored in runs of words, and with few scores kept, has the score of the whole."""
    docs = op13_language.remainder(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    langs, shares, tables = op13_language.fit(docs.where("fold <> 0"), folder, PIECES, rounds=1)
    scorer, small = op13_language.Scorer(PIECES, tables), op13_language.Scorer(PIECES, tables)
    small.most = 5
    words = [w for ws in op13_language.word_runs("un texte assez long pour être coupé " * 50) for w in ws]
    scorer.learn(set(words))
    total = np.zeros(len(langs))
    for k in range(0, len(words), 4):
        small.learn(set(words[k : k + 4]))
        total += small.text(words[k : k + 4])
    assert np.allclose(total, scorer.text(words)) and len(small.at) <= 8


def test_mix_agrees_however_rows_are_dealt(spark, make, folder):
    """Repeated, missing and tied ids: the same uses for 1, 5 and 9 partitions, in any order of the rows."""
    from tidewatch.llm import op6_mix
    from tidewatch.llm.common import stored

    rng = random.Random(4)
    rows = [(rng.choice((i % 7, None, i)), " ".join(rng.choices("abcdef", k=rng.randrange(1, 9))), rng.choice(("s0", "s1", "s2", None))) for i in range(1500)]
    seen = []
    for n in (1, 5, 9):
        rng.shuffle(rows)
        sized = stored(op6_mix.sized(make(rows).repartition(n)), f"{folder}-{n}")
        uses, sources = op6_mix.mix(sized)
        seen.append(sorted((r["_use_key"], r["n"]) for r in uses.groupBy("_use_key").agg(F.count("*").alias("n")).collect()))
        taken = {r["source"]: r["taken"] for r in uses.groupBy("source").agg(F.sum("size").alias("taken")).collect()}
        assert all(abs(taken[r["source"]] - r["target"]) < 30 for r in sources.collect())
    assert seen[0] == seen[1] == seen[2]
