"""Repeats, scoring, mixing, personal data, quality and near-duplicates against brute force."""

import hashlib
import itertools
import math
import re
import tracemalloc
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from tidewatch.llm import op4_repeats, op5_ppm, op6_mix, op7_pii, op8_quality, op10_near, wordcache

WORD = re.compile("[^\x20\x09-\x0d]+")


def repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats(spark, make, documents, odd, folder, monkeypatch, hot):
    monkeypatch.setattr(op4_repeats, "HOT", hot)
    rows = documents + [(10**6 + i, t) for i, (_, t) in enumerate(odd)] + [(10**7 + i, "y" + "ab" * (30 + i)) for i in range(5)]
    out = op4_repeats.remove_repeats(make(rows, extra=True), folder, block_bytes=200_000).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == repeats(rows)
    assert op4_repeats.remove_repeats(make([]), folder + "-e").count() == 0
    ids = make([(3, "z" * 60), (3, "z" * 60), (None, "z" * 60)])
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in op4_repeats.remove_repeats(ids, folder + "-t").collect()) == [("3", 0), ("3", 0), ("None", 60)]


def ppm_counts(train, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        s = [257] * order + list((t or "").encode()) + [256]
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[j][tuple(s[i - j : i])][s[i]] += 1
    return counts


def ppm_reference(counts, text, order):
    s = [257] * order + list((text or "").encode()) + [256]
    total = 0.0
    for i in range(order, len(s)):
        excluded: set = set()
        for j in range(order, -1, -1):
            c = {x: n for x, n in counts[j][tuple(s[i - j : i])].items() if x not in excluded}
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if s[i] in c:
                total += math.log10(c[s[i]] / (n + q))
                break
            total += math.log10(q / (n + q))
            excluded |= set(c)
        else:
            total -= math.log10(257 - len(excluded))
    return total


def test_scores(spark, make, documents, odd, folder):
    rows = [(i, t) for i, (_, t) in enumerate(sorted(documents, key=lambda x: len(x[1]))[::4][:40] + odd)]
    out = {r["doc_id"]: r for r in op5_ppm.score(make(rows, extra=True), folder, block_bytes=20_000).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d: [*WORD.findall(lower(t)), ""] for d, t in rows}
    train = Counter(w for d, _ in rows if not held[d] for w in tokens[d])
    n, v = sum(train.values()), len(train)
    for d, t in rows:
        r = out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(tokens[d]), sum(train[w] > 0 for w in tokens[d]), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[d]), rel_tol=1e-9)
    counts = ppm_counts([t for d, t in rows if not held[d]], op5_ppm.ORDER)
    for d, t in rows:
        assert math.isclose(out[d]["score"], ppm_reference(counts, t, op5_ppm.ORDER), rel_tol=1e-9), d
    assert op5_ppm.score(make([]), folder + "-e").count() == 0


def test_mix(spark, sf_dir):
    out = op6_mix.op6_mix(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(out) == len(docs)
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]]["text"] or "")) and r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        by[docs[r["doc_id"]]["source"]].append(r)
    want = op6_mix.targets([sum(r["size"] for r in by[s]) for s in sorted(by)], [(1, 2, 3)[i % 3] for i in range(len(by))])
    for s, target in zip(sorted(by), want, strict=True):
        assert math.isclose(by[s][0]["target"], target, rel_tol=1e-12) and by[s][0]["source_size"] == sum(r["size"] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 2 * max(r["size"] for r in by[s])
    again = op6_mix.op6_mix(spark, sf_dir).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in again}


def test_flow_with_overlaps():
    flows = op6_mix.route([(100, [0]), (100, [0, 1]), (50, [1])], [100, 200], 3)
    assert sum(f.get(0, 0) for f in flows) == 100 and sum(f.get(1, 0) for f in flows) == 200
    assert flows[0][0] == 100  # the shared documents leave source 0 to its own
    assert sum(flows[1].values()) <= 300 and op6_mix.targets([10, 1000], [1, 1]) == [30.0, 980.0]


def test_flow_is_optimal():
    """Small instances against all flows: the most words, then the least cost of repetitions (1, 4, 9 a word)."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        patterns = [(int(rng.integers(1, 4)), sorted(set(rng.integers(0, 2, 2).tolist()))) for _ in range(3)]
        quotas = rng.integers(0, 9, 2).tolist()

        def cost(flow):
            return sum((j**2) * max(0, min(size, used - (j - 1) * size)) for (size, _), used in zip(patterns, flow, strict=True) for j in (1, 2, 3))

        best = None
        for use in itertools.product(*(range(3 * size + 1) for size, _ in patterns)):
            for split in itertools.product(*(range(u + 1) for u in use)):
                to = [0, 0]
                ok = True
                for (_, sources), u, x in zip(patterns, use, split, strict=True):
                    if len(sources) == 1 and x:
                        ok = False
                        break
                    to[sources[0]] += u - x
                    if len(sources) == 2:
                        to[sources[1]] += x
                if ok and to[0] <= quotas[0] and to[1] <= quotas[1]:
                    best = max(best, (sum(use), -cost(use))) if best else (sum(use), -cost(use))
        flows = op6_mix.route(patterns, quotas, 3)
        used = [sum(f.values()) for f in flows]
        assert all(sum(f.get(i, 0) for f in flows) <= quotas[i] for i in range(2)) and all(u <= 3 * size for u, (size, _) in zip(used, patterns, strict=True))
        assert (sum(used), -cost(used)) == best


def test_mix_by_hand(spark, make, documents, odd, folder):
    """What the mix takes of every document, by plain sums over the seeded order; rows may repeat."""
    rows = [(d, t, f"s{(d or 0) % 4}" if (d or 0) % 4 else None) for d, t in documents + odd] + [(d, t, "s2") for d, t in documents[:5] * 2]
    stored = op6_mix.stored(op6_mix.sized(make(rows, extra=True)), folder)
    uses, sources = op6_mix.mix(stored)
    taken = Counter()
    for r in uses.collect():
        taken[r["row"]] += r["size"]
    placed = stored.withColumn("place", op6_mix.F.xxhash64(op6_mix.F.lit(op6_mix.SEED), "doc_id")).collect()
    by = defaultdict(list)
    for r in placed:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda x: (x is None, x or ""))
    sizes = [sum(r["size"] for r in by[n]) for n in names]
    wanted = op6_mix.targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))])
    assert [(r["source"], r["source_size"]) for r in sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))] == list(zip(names, sizes, strict=True))
    got, want = defaultdict(list), defaultdict(list)
    for n, size, target in zip(names, sizes, wanted, strict=True):
        share, upto = min(round(target), 3 * size) / size if size else 0.0, 0
        unsigned = lambda x: x & (2**64 - 1)  # noqa: E731  hash bins go by the unsigned value, places inside one by the signed one
        for r in sorted(by[n], key=lambda r: (unsigned(r["place"]) >> 52, r["place"], r["doc_id"] is not None, r["doc_id"] or 0)):
            middle = (upto + r["size"] / 2) / size if size else 0.0
            want[n, r["doc_id"], r["size"]].append(r["size"] * sum(j + middle < share for j in range(3)))
            got[n, r["doc_id"], r["size"]].append(taken[r["row"]])
            upto += r["size"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    kept = op6_mix.mix_documents(make(rows, extra=True), folder + "-d")
    times = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    words = lambda t: len(WORD.findall(t or ""))
    assert sum(n * words(t) for (_, t), n in times.items()) == sum(taken.values()) and kept.columns == make(rows, extra=True).columns


def plain_spans(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(s):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0

    for kind, p in kinds.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                yield f"{kind}:{m.start()}:{m.end()}"


HARD = [
    "a@b.c_x@d.e and a.b@c-d.e.f. @x.y a@b", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 00255.01.1.1 1.2.3 .1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 5",
    "😀 +1 (555) 010-9999 x +12 3 +1-2-3-4-5-6-7-8 +49", "password = \"hunter2hunter2\" jane [at] mail [dot] org 123-45-6789", "x" * 50000 + "@", "9" * 40000, "1." * 20000,
]


def test_personal_data(spark, make, documents, odd, folder):
    rows = [(i, t) for i, (_, t) in enumerate(documents + odd + [(0, t) for t in HARD])]
    df = make(rows, extra=True)
    out = {r["doc_id"]: r for r in op7_pii.detect(df, folder).collect()}
    for d, t in rows:
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in out[d]["base"]]
        assert base == list(plain_spans(t or "")), d
        for s in out[d]["added"]:
            assert not any(b["start"] < s["end"] and s["start"] < b["end"] for b in out[d]["base"])
    clean = {r["doc_id"]: r["text"] for r in op7_pii.redact(df, folder + "-r").collect()}
    assert clean[0] is not None and clean[len(documents)] is None and not any(x.startswith("email") for t in clean.values() for x in plain_spans(t or ""))
    assert op7_pii.detect(make([]), folder + "-e").count() == 0


def test_long_secrets(make, folder):
    """No part of a secret stays behind, however long it is."""
    secret = lambda k, n: hashlib.sha256(str(k).encode()).hexdigest().translate(str.maketrans("0123456789", "g1hijklmno")) * (n // 64 + 1)
    lengths = [40, 64, 199, 200, 201, 400, 6000]
    rows = [(i, f"some words, then api_key = '{secret(i, n)[:n]}' and more words") for i, n in enumerate(lengths * 4)]
    out = {r["doc_id"]: r["text"] for r in op7_pii.redact(make(rows), folder).collect()}
    assert set(out.values()) == {"some words, then <secret> and more words"}


def test_weak_supervision_by_hand(spark, make, folder):
    """EM, classifier and added spans against plain loops; true and false candidates of the same kinds."""
    secret = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    rows = [(i, f'set token = "{secret(i)}" then version {i}.0 and page {i}') for i in range(30)]
    rows += [(100 + i, f"note: something{'ab' * (i % 5)} of room {i} or mail me@host{i}.org, section 4.{i}") for i in range(30)]
    rows += [(200, "reach jane [at] mail [dot] org now"), (201, "build 12345678901234567890 is late")]
    out = {r["doc_id"]: r for r in op7_pii.detect(make(rows), folder).collect()}
    found = spark.read.parquet(f"{folder}/found")
    every = [(is_base, r) for is_base, c in ((True, "base"), (False, "wide")) for r in op7_pii.voted(found.selectExpr("row", "doc_id", f"explode({c}) s", f"{str(is_base).lower()} is_base").select("row", "doc_id", "s.*", "is_base")).collect()]
    names, votes = op7_pii.LABELERS, op7_pii.VOTES
    model = {x: {v: (t, f) for v, t, f in zip(votes, *op7_pii.START, strict=True)} for x in names}
    prior = 0.5

    def p(is_base, r):
        if is_base:
            return 1.0
        odds = math.log(prior / (1 - prior)) + sum(math.log(model[x][r[x]][0] / model[x][r[x]][1]) for x in names)
        return 1 / (1 + math.exp(-odds))

    for _ in range(op7_pii.ROUNDS):
        soft = [p(*e) for e in every]
        true, false = sum(soft), len(soft) - sum(soft)
        share = lambda x, v, w: sum(s for (_, r), s in zip(every, w, strict=True) if r[x] == v)
        back = [1 - s for s in soft]
        model = {x: {v: ((share(x, v, soft) + 1) / (true + 3), (share(x, v, back) + 1) / (false + 3)) for v in votes} for x in names}
        prior = (true + 1) / (len(soft) + 2)
    got, got_prior = op7_pii.reliabilities(spark.read.parquet(f"{folder}/patterns"))
    assert math.isclose(got_prior, prior, rel_tol=1e-9)
    for x in names:
        for v in votes:
            assert np.allclose(got[x][v], model[x][v], rtol=1e-9)
    soft = [p(*e) for e in every]
    length = lambda n: "a" if n < 8 else "b" if n < 16 else "c" if n < 32 else "d"
    traits = lambda r: {**{x: str(r[x]) for x in names}, "f_kind": r["kind"], "f_length": length(len(r["value"])), "f_digits": str(4 * sum(c.isdigit() for c in r["value"]) // len(r["value"]))}
    t, f = sum(soft), len(soft) - sum(soft)
    sums: dict = defaultdict(lambda: [0.0, 0.0])
    for (_, r), s in zip(every, soft, strict=True):
        for pair in traits(r).items():
            sums[pair][0] += s
            sums[pair][1] += 1 - s
    want = defaultdict(list)
    for is_base, r in every:
        score = math.log((t + 1) / (f + 1)) + sum(math.log((sums[k][0] + 1) / (t + 4) / ((sums[k][1] + 1) / (f + 4))) for k in traits(r).items())
        if not is_base and score >= 0:
            want[r["doc_id"]].append((r["start"], -r["end"], r["kind"]))
    for d, r in out.items():
        kept, upto = [], 0
        for start, end, kind in sorted(want[d]):
            if start >= upto:
                kept.append((kind, start, -end))
                upto = -end
        assert [tuple(x) for x in r["added"]] == kept, d
    assert all([x["kind"] for x in out[d]["added"]] == ["secret"] for d in range(30))
    assert not any(out[d]["added"] for d in [*range(100, 130), 201]) and len(every) > len(rows)


def test_quality(spark, make, documents, odd, folder):
    rows = documents + [(10**6 + i, t) for i, (_, t) in enumerate(odd)]
    labels = spark.createDataFrame([(d, int(d % 3 > 0), 0) for d, _ in documents] + [(None, None, None)], "doc_id long, quality int, toxic int")
    out, _ = op8_quality.judge(make(rows, extra=True), labels, folder)
    got = {r["doc_id"]: r for r in out.collect()}
    for d, t in rows:
        words = WORD.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
        repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got[d][c] for c in op8_quality.COUNTS) == want, d
        assert got[d]["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (got[d]["base_failed"] and got[d]["kept"])
    empty, _ = op8_quality.judge(make([]), labels.limit(0), folder + "-e")
    assert empty.count() == 0


def plain_path(tree, row, node=0):
    f, cut, left, right, length = tree[node]
    return length if f < 0 else plain_path(tree, row, int(left) if row[int(f)] <= cut else int(right))


def test_forest_by_hand(spark, sf_dir, folder):
    """Trees, path lengths, weights, anomaly, threshold and verdict against plain loops over the same rows."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out, limit = op8_quality.judge(docs, labels, folder)
    rows = {r["doc_id"]: r for r in out.collect()}
    stats = spark.read.parquet(f"{folder}/stats").select("doc_id", "rules.*")
    forest = op8_quality.train_forest(stats)
    for tree in forest[:20]:  # leaves tell their depth, every split parts its rows, two statistics a tree
        def walk(node, depth):
            f, _, left, right, length = tree[node]
            if f < 0:
                assert depth <= length
                return {-1}
            return {int(f)} | walk(int(left), depth + 1) | walk(int(right), depth + 1)
        assert len(walk(0, 0) - {-1}) <= op8_quality.SUBSPACE
    quality: dict = {}
    for r in labels.collect():
        if r["quality"] is not None:
            quality[r["doc_id"]] = min(r["quality"], quality.get(r["doc_id"], 1))
    x = {d: [r[c] for c in op8_quality.FEATURES] for d, r in rows.items()}
    passed = [d for d, r in rows.items() if not r["base_failed"]]
    good, bad = ([d for d in passed if d in quality and (quality[d] > 0) == g] for g in (True, False))
    assert good and bad
    weights = []
    for tree in forest:
        pairs = [(plain_path(tree, x[b]), plain_path(tree, x[g])) for b in bad for g in good]
        chance = sum(1.0 if p < q else 0.5 if p == q else 0.0 for p, q in pairs) / len(pairs)
        weights.append(max(0.0, 2 * chance - 1) ** op8_quality.SHARPNESS)
    for d, r in rows.items():
        mean = sum(w * plain_path(t, x[d]) / t[0, 4] for t, w in zip(forest, weights, strict=True)) / sum(weights)
        assert math.isclose(r["anomaly"], 2.0**-mean, rel_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["anomaly"] < limit)
    assert sum(rows[d]["anomaly"] >= limit for d in good) <= op8_quality.FALSE_REJECTS * len(good)
    assert sum(rows[d]["anomaly"] >= limit for d in bad) >= 1


def test_threshold():
    good, bad = np.zeros(12), np.zeros(12)
    good[[2, 3, 7]], bad[[6, 8, 9]] = (50, 49, 1), (1, 2, 3)
    assert op8_quality.threshold(good, bad, 0.0) * op8_quality.LEVELS == 8 and op8_quality.threshold(good, bad, 0.01) * op8_quality.LEVELS == 5
    assert op8_quality.threshold(good, bad * 0, 0.5) == 2.0 and op8_quality.auc(np.array([1.0, 2]), np.array([2.0, 3])) == 0.875
    assert op8_quality.normal_length(2) == 1 and op8_quality.normal_length(1) == 0 and math.isclose(op8_quality.normal_length(256), 10.244770920, rel_tol=1e-6)


def near_classes(rows):
    counts = [op10_near.shingle_counts(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if counts[i] and counts[j] and (rows[i][1] == rows[j][1] or max(op10_near.similarities(counts[i], counts[j])) >= 0.8):
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return {d: best[root(i)] for i, (d, _) in enumerate(rows)}


def test_near(spark, make, documents, odd, folder):
    base = " ".join(f"w{i}" for i in range(200))
    near = [(20_000 + k, base.replace(f"w{20 * k} ", "changed ")) for k in range(5)] + [(20_010, base), (20_011, "same words " * 50), (20_012, "same words " * 60)]
    rows = [(10**6 + i if d is None or d < 0 else d, t) for i, (d, t) in enumerate(documents)] + [(30_000 + i, t) for i, (_, t) in enumerate(odd)] + near
    df = make(rows, extra=True)
    got = {r["doc_id"]: r["class_id"] for r in op10_near.classes(df, folder).collect()}
    assert got == near_classes(rows)
    kept = op10_near.keep_one(df, folder + "-k")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == df.columns
    assert op10_near.classes(make([]), folder + "-e").count() == 0


def test_near_ids(spark, make, folder):
    """Different texts under null and repeated doc_ids all stay; a text without any doc_id is linked to its near copy."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(100))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("e"))]
    rows += [(None, text("f")), (9, text("f").replace("fw50 ", "other ")), (3, text("g")), (3, text("h")), (4, text("h"))]
    rows += [(None, None), (None, None), (None, ""), (5, " "), (5, None), (5, "")]
    df = make(rows, extra=True)
    kept = [(r["doc_id"], r["text"]) for r in op10_near.keep_one(df, folder).collect()]
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (9, rows[8][1]), (3, text("g")), (3, text("h")), *rows[12:]]
    assert sorted(kept, key=str) == sorted(want, key=str)
    found = [(r["doc_id"], r["class_id"]) for r in op10_near.classes(df, folder + "-c").collect()]
    assert found.count((9, 9)) == 1 and found.count((None, 9)) == 1 and found.count((4, 3)) == 1 and len(found) == len(rows)


def test_near_with_repeated_passage(make, folder):
    """Copies with a passage repeated 50 times: plain Jaccard above 0.8, probability Jaccard far below."""
    rows = []
    for k in range(12):
        words = [f"{k}w{i}" for i in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[100:114] * 50))]
    weighted, plain = op10_near.similarities(*(op10_near.shingle_counts(t) for _, t in rows[:2]))
    assert weighted < 0.5 and plain > 0.9
    found = op10_near.classes(make(rows), folder).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {d: d - d % 2 for d, _ in rows}


def test_workers_let_go_of_words(spark):
    """A worker that has packed holds an encoder's words; the first batch of any Python step of near and quality frees them."""

    class Rows:
        """Gives back the function that its rows would go through."""

        select = join = lambda self, *columns: self
        mapInArrow = lambda self, f, schema: f  # noqa: E731, N815

    one = {"doc_id": [1], "text": ["some words to read again"], "node": [1], "a": [1], "b": [2], "ta": ["a b c d e f"], "tb": ["a b c d e f"]}
    batch = lambda *names: iter([pa.RecordBatch.from_pydict({n: one[n] for n in names})])
    block = pa.RecordBatch.from_pylist([{"bucket": 1, "i": 0, "j": 0, "is_left": True, "node": 1, "label": 1, "minor": True, "keys": [1, 2], "counts": None}])
    steps = [
        lambda: list(op10_near.signed(Rows())(batch("doc_id", "text"))),
        lambda: list(op10_near.verified(Rows(), Rows())(batch("a", "b", "ta", "tb"))),
        lambda: list(op10_near.shingle_sets(Rows())(batch("node", "text"))),
        lambda: list(op10_near.linked_blocks(iter([block]))),
        lambda: op8_quality.rules.func(pd.Series(["some words"])),
    ]
    for step in steps:
        held = weakref.ref(wordcache.encoder(public_tokenizers.path("word_bpe_49k.json")))
        assert held() is not None
        step()
        assert held() is None


def test_shingles_of_a_long_text_hold_few_arrays():
    """Two arrays of 8 bytes a byte of text at once, beside what grows with the words."""
    text = "x" * 4_000_000 + " two three four five six"
    tracemalloc.start()
    _, keys, _ = op10_near.shingles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) == 2 and peak < 22 * len(text)


def test_prob_minhash_estimates():
    rng = np.random.default_rng(5)
    a = {int(k): int(w) for k, w in zip(range(60), rng.integers(1, 6, 60), strict=True)}
    b = {k + 12: w for k, w in a.items() if k < 48} | {k: w + 1 for k, w in a.items() if k < 12}
    exact, _ = op10_near.similarities(a, b)
    of = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
    keys = np.array([*a, *b], np.uint64)
    s = op10_near.prob_minhash(of, keys, np.array([*a.values(), *b.values()], float), 2, 20_000)
    assert abs((s[0] == s[1]).mean() - exact) < 0.02
