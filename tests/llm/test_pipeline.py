"""The stages one after the other on the small table, each against plain computation on its own input, and on odd rows."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tests.llm.test_texts import WORD, near_classes, plain_spans
from tidewatch.llm import op6_mix, op7_pii, op8_quality
from tokenizers import Tokenizer


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, sf_dir, folder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    at, text = columns.index("doc_id"), columns.index("text")

    def kept(stage, docs):
        out = op8_quality.stored(stage(spark, docs, sf_dir), f"{folder}/{stage.__name__}")
        assert out.columns == columns
        return out

    quality, near, pii, mix, pack = (f for _, f in corpus_pipeline.STAGES)

    clean = kept(quality, docs)  # the rules by plain counts, the forest by the operator's own verdict, which has its own test
    verdict, limit = op8_quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), f"{folder}/judge")
    anomaly = {r["doc_id"]: r["anomaly"] for r in verdict.collect()}
    want = []
    for row in rows_of(docs):
        words = WORD.findall(row[text] or "")
        grams = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
        repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and anomaly[row[at]] < limit:
            want.append(row)
    assert Counter(rows_of(clean)) == Counter(want) and 0 < len(want) < docs.count()

    single = kept(near, clean)
    before = rows_of(clean)
    classes = near_classes([(r[at], r[text]) for r in before])
    assert Counter(rows_of(single)) == Counter(r for r in before if classes[r[at]] == r[at]) and single.count() < len(before)

    safe = kept(pii, single)
    found = {r["doc_id"]: r["added"] for r in op7_pii.detect(single, f"{folder}/detect").collect()}
    after = {r[at]: r for r in rows_of(safe)}
    n = 0
    for row in rows_of(single):
        t = row[text] or ""
        spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in plain_spans(t))] + [(s["start"], s["end"], s["kind"]) for s in found[row[at]]]
        out, upto = "", 0
        for a, b, k in sorted(spans):
            if a >= upto:
                out += t[upto:a] + f"<{k}>"
            upto = max(upto, b)
        n += bool(spans)
        assert (after[row[at]][text] or "") == out + t[upto:] and after[row[at]][columns.index("n_chars")] == len(out + t[upto:])
    assert n > 0 and len(after) == single.count()

    mixed = kept(mix, safe)
    uses, sources = op6_mix.mix(op6_mix.stored(op6_mix.sized(safe), f"{folder}/sized"))
    assert Counter(r[at] for r in rows_of(mixed)) == Counter(r["doc_id"] for r in uses.collect())
    assert set(rows_of(mixed)) <= set(rows_of(safe))
    words = Counter()
    for r in rows_of(mixed):
        words[r[columns.index("source")]] += len(WORD.findall(r[text] or ""))
    longest = max(len(WORD.findall(r[text] or "")) for r in rows_of(safe))
    for r in sources.collect():
        assert abs(words[r["source"]] - r["target"]) <= 2 * longest

    pieces = pack(spark, mixed, sf_dir).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows_of(mixed):
        ids = [*lib.encode(r[text] or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[r[at], k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    places: dict = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_odd_rows(spark, sf_dir, make, odd):
    df = make([(d, t, None if i % 2 else "s1") for i, (d, t) in enumerate(odd)], extra=True)
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).count()
