"""Media shards, token records, chat trees and packing: read back against plain computation."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.oracle import difference
from tidewatch.llm import op1_media, op2_records, op3_chat, op9_pack


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_media(spark, make, documents, odd, folder):
    rows_ = documents + odd
    rows = op1_media.write_shards(make(rows_, extra=True), folder)
    out = rows.join(op1_media.read_members(op1_media.members(rows), folder), "digest").collect()
    assert len(out) == len(rows_)
    want = sorted((str(d), len((t or "").encode()), hashlib.sha256(op1_media.padded((t or "").encode())).hexdigest(), zlib.crc32(op1_media.padded((t or "").encode())[-16:])) for d, t in rows_)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    assert all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= 192 and r["width"] == 192 for r in out)
    assert op1_media.write_shards(make([]), folder + "-e").count() == 0
    heads = op1_media.read_members(op1_media.members(rows), folder, whole=False).collect()  # 33 bytes of each member
    sizes = {r["digest"]: r["payload_bytes"] for r in op1_media.read_members(op1_media.members(rows), folder).collect()}
    assert {r["digest"]: r["width"] * r["height"] * r["bit_depth"] // 8 for r in heads} == sizes and len(heads) == len(sizes)


def test_png_round_trip():
    for text in (b"", b"a", bytes(range(256)) * 3, b"x" * 192):
        payload = op1_media.padded(text)
        assert op1_media.payload_of(op1_media.png_of(payload)) == payload
    broken = bytearray(op1_media.png_of(op1_media.padded(b"abc")))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        op1_media.payload_of(bytes(broken))


def test_token_records(spark, make, documents, odd, folder):
    rows = documents + [(1000000 + i if d is not None else None, t) for i, (d, t) in enumerate(odd)]
    encode = library("byte_bpe_50k.json")
    index = op2_records.write_records(make(rows, extra=True), folder, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in op2_records.read_records(index, folder).collect()}
    start = 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*encode(t), 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert index.count() == len(rows)
    mixed = op2_records.read_shuffled(index, folder, 5, 4).collect()
    assert {r["doc_id"]: r["ids"] for r in mixed} == {d: [*encode(t), 0] for d, t in rows} and len(mixed) == len(rows)
    order = [r["doc_id"] for r in mixed]
    assert order == [r["doc_id"] for r in op2_records.read_shuffled(index, folder, 5, 4).collect()]
    assert order != [r["doc_id"] for r in op2_records.read_shuffled(index, folder, 6, 4).collect()]
    assert op2_records.read_records(op2_records.write_records(make([]), folder + "-e", public_tokenizers.path("byte_bpe_50k.json")), folder + "-e").count() == 0


def test_record_checksums():
    blobs = [b"123456789", b"abcd", bytes(1000), b"q" * 70001]
    assert int(op2_records.crc32c_many([b"123456789"])[0]) == 0xE3069283
    data = b"".join(op2_records.frame(blobs))

    def reader(data):
        at = 0

        def read(n):
            nonlocal at
            at += n
            return data[at - n : at]

        return read

    assert list(op2_records.unframe(reader(data))) == blobs
    with pytest.raises(ValueError):
        list(op2_records.unframe(reader(data[:20] + b"!" + data[21:])))


def test_chat(spark, sf_dir):
    assert difference(op3_chat.op3_chat(spark, sf_dir), op3_chat.ORACLE_SQL, sf_dir) == ""


def test_chat_tree(spark, folder):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes </s>"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, None, None), (3, 1, "assistant", r"<\|end|> <|end|>"), (None, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (5, None, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    member, tree = op3_chat.format_tree(turns, folder, path)
    nodes = tree.collect()
    assert len(nodes) == 7  # hi (shared), yes, no, hi-hi, empty, its answer, x
    for r in nodes:  # ancestors cover exactly the tokens before ``position`` and lie before the node in its tree
        assert sum(s["b"] - s["a"] for s in r["ancestors"] or []) == r["position"]
        assert all(s["b"] <= r["start"] for s in r["ancestors"] or [])
    got = {r["conv_id"]: r for r in op3_chat.read_tree(member, tree, path).collect()}
    assert got[3]["loss_sha256"] == hashlib.sha256(rb"<\|end|> <|end|>").hexdigest() and got[1]["n_turns"] == 2 and None in got
    assert op3_chat.read_tree(*op3_chat.format_tree(turns.limit(0), folder + "-e", path), path).count() == 0
    for text in ("<|end|>", r"<\|end|>", "[INST][/INST]", "<<SYS>>", "plain"):
        assert op3_chat.unescape(op3_chat.escape(text)) == text and (text == "plain" or text not in op3_chat.escape(text) or "\\" in text)


def test_deep_chat_tree(spark, folder):
    """Conversations of 700 turns that part at turns 100, 300 and 301: one tree, against plain computation."""
    rows = [(c, i, "assistant" if i % 2 else "user", f"turn {i}" + (f" of {c}" if i >= part else "")) for c, part in ((1, 900), (2, 300), (3, 100), (4, 301), (5, 300)) for i in range(700)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    member, tree = op3_chat.format_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), folder, path)
    at = {bytes(r["node"]): r for r in tree.collect()}
    assert len(at) == 700 + 400 + 600 + 399 + 400 and len({bytes(r["tree"]) for r in at.values()}) == 1
    filled = sorted((r["start"], r["start"] + len(r["ids"])) for r in at.values())
    assert filled[0][0] == 0 and all(x[1] == y[0] for x, y in zip(filled, filled[1:]))  # noqa: B905
    above: dict = {}
    for r in sorted(member.collect(), key=lambda r: (r["conv_id"], r["idx"])):
        if r["idx"] == 0:
            want: list = []
        node = at[bytes(r["node"])]
        assert [(s["a"], s["b"]) for s in node["ancestors"] or []] == want and node["position"] == sum(b - a for a, b in want)
        a, b = node["start"], node["start"] + len(node["ids"])
        want = [*want[:-1], (want[-1][0], b)] if want and want[-1][1] == a else [*want, (a, b)]
        above.setdefault(bytes(r["node"]), []).append(r["conv_id"])
    assert sorted(map(len, above.values()))[-1] == 5


def test_packing(spark, make, documents, odd, folder):
    rows = [(i, t) for i, (_, t) in enumerate(documents + odd)]
    encode = library("word_bpe_49k.json")
    out = op9_pack.pack_documents(make(rows, extra=True), folder, public_tokenizers.path("word_bpe_49k.json")).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in out}
    assert len(pieces) == len(out)
    n = 0
    for d, t in rows:
        ids = [*encode(t), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            r = pieces[d, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(ids[at : at + 2048]), crc(ids[at : at + 2048]))
            n += 1
    assert n == len(out)
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    sizes = np.array([r["length"] for r in out if r["length"] < 2048])
    bound = op9_pack.lower_bound(sizes, 2048) + sum(r["length"] == 2048 for r in out)
    assert len(bins) <= bound + 1
    assert op9_pack.pack_documents(make([]), folder + "-e", public_tokenizers.path("word_bpe_49k.json")).count() == 0


def best_fit_decreasing(sizes):
    return int(op9_pack._refill(sizes, np.zeros(len(sizes), np.int64), np.ones(len(sizes), bool), 2048).max()) + 1


def test_genetic_steps():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2000, 300)
    a, _ = op9_pack.evolve(sizes, [], 1, 2048)
    b, _ = op9_pack.evolve(sizes, [a], 2, 2048)
    for bins in (a, b, op9_pack.crossover(sizes, a, b, rng, 2048), op9_pack.crossover(sizes, b, a, rng, 2048, 0.1)):
        assert len(bins) == 300 and np.bincount(bins, sizes).max() <= 2048 and (np.bincount(bins) > 0).all()
    assert b.max() <= a.max()


def test_genetic_algorithm_where_best_fit_loses():
    """Triplets that fill a bin exactly: crossovers make fewer bins than best fit, decreasing or in random order."""
    rng = np.random.default_rng(4)
    first = rng.integers(780, 1000, 100)
    second = np.array([rng.integers(520, 1528 - a) for a in first])
    sizes = rng.permutation(np.r_[first, second, 2048 - first - second])
    elite, done = op9_pack.evolve(sizes, [], 1, 2048, 300)
    starts = [int(op9_pack.random_packing(sizes, np.random.default_rng(k), 2048).max()) + 1 for k in range(6)]
    assert done > 0 and op9_pack.lower_bound(sizes, 2048) == 100 <= int(elite.max()) + 1 < min(best_fit_decreasing(sizes), *starts)


def test_lower_bound_and_optimum():
    """Small cases against the best of all packings."""
    def least(sizes, room):
        if not sizes:
            return len(room)
        n, *rest = sizes
        options = {r for r in room if r >= n}
        best = min((least(rest, [*room[: room.index(r)], r - n, *room[room.index(r) + 1 :]]) for r in options), default=99)
        return min(best, least(rest, [*room, 2048 - n]))

    rng = np.random.default_rng(9)
    for _ in range(25):
        sizes = rng.integers(200, 1500, 7)
        optimum = least(sorted(sizes.tolist(), reverse=True), [])
        elite, _ = op9_pack.evolve(sizes, [], 2, 2048)
        assert op9_pack.lower_bound(sizes, 2048) <= optimum == int(elite.max()) + 1


def test_residual_bins_are_packed_again(spark, folder):
    sizes = np.random.default_rng(2).integers(300, 1900, 600)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "uid long, length long").repartition(3)
    items.write.parquet(f"{folder}-items")
    out = op9_pack.pack(spark.read.parquet(f"{folder}-items"), folder, group=50).collect()
    loads: dict = {}
    for r in out:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["length"]
    first = spark.read.parquet(f"{folder}/first-places").select("sequence_id").distinct().count()
    assert len(out) == 600 and max(loads.values()) <= 2048 and op9_pack.lower_bound(sizes, 2048) <= len(loads) <= first


def test_every_letter_before_every_closing_sign():
    """Ids of words that end in any letter before any closing sign are the library's: some letters turn into a letter and a mark."""
    import sys

    from tidewatch.llm import wordcache

    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and not 0x4E00 < ord(c) < 0x9FFF and not 0xAC00 < ord(c) < 0xD7A3 and ord(c) < 0x20000]
    encode = library("word_bpe_49k.json")
    enc = wordcache.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for sign in wordcache._TAIL:
        words = [f"a{c}{sign}" for c in letters] + [f"{c}{sign}{sign}." for c in letters[::7]]
        joined = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        for text, ids in zip(joined, enc.encode(joined), strict=True):
            assert ids.tolist() == encode(text)
    for text in ("SEVGİ, BARIŞ.", "TAKSİ, GELDİ!", "İ."):
        assert enc.encode([text])[0].tolist() == encode(text)


def test_random_texts_have_the_library_s_ids():
    import random

    from tidewatch.llm import wordcache

    rng = random.Random(5)
    signs = [*"abcXYZ .,;:!?'\n\t0129éİıßñड़Ω-_", "्", "̈", "İ", "가", "😀", "ﬁ", "ͅ", "ǅ", "ড়"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode, enc = library(name), wordcache.ChunkEncoder(public_tokenizers.path(name))
        texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(10_000)]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == encode(text), text
