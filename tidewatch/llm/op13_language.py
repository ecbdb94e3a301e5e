"""Language identification by unigram pieces, summed over all segmentations.

A text is scored word by word: a word is a run of letters, lower-cased, cut every LONGEST signs, with the mark of a
word's start before it. The pieces of a public vocabulary (a SentencePiece model; its path is a parameter) span the word in many
ways; each language has a probability for every piece, and the forward algorithm sums over all segmentations. A letter that the
vocabulary lacks is spanned by its byte pieces. Pieces never cross words, so a text's log probability is the sum over its words,
to which the log share of the language among the training rows is added; the prediction is the largest, the score its
posterior.

Piece probabilities are estimated by expectation-maximisation: words are counted by language over all training rows (counters in
the tasks, then one aggregate), each round runs forward and backward over the distinct words of all languages and sums expected piece
counts. Only languages x pieces reach the driver and the tasks: the vocabulary's 32,000 pieces for each label value, below 130 KB a
language.

Memory: a task holds a batch of texts, word counters that it sends on at COUNTED words, and scores of at most CELLS word and
language pairs; a long text is scored in runs of words. There is no group: no word, language or source is one task's.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows with a null lang train nothing; a null doc_id counts
as an empty one, which is held out; repeated rows count and are predicted like others; ties go to the first language by code point; with nothing to
learn from, every text is ``und``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, slices, stored, table

LONGEST = 64
#: Rounds of expectation-maximisation and what is added to every expected count.
ROUNDS, SMOOTH = 2, 0.1
COUNTED, CELLS = 200_000, 1_600_000
#: Distinct words whose lattices are held at once.
TOGETHER = 16_384
START = "▁"
#: Private-use code points that stand for the vocabulary's byte pieces; they are no letters.
BYTES = 0xF0000


#: What \w has beside decimal digits and the underscore: letters and some numeric signs, at which words are parted later.
RUN = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def letters_only(words: list[str]) -> list[str]:
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]


def word_runs(text: str, most: int = 1 << 16) -> Iterator[list[str]]:
    """The words of a text, some at a time."""
    low = text.lower()
    if len(low) <= most:
        yield letters_only(RUN.findall(low))
        return
    words = (m.group() for m in RUN.finditer(low))
    while some := list(islice(words, most)):
        yield letters_only(some)


class Lattice:
    """The vocabulary's pieces as arcs over words."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        self.ids: dict[str, int] = {}
        for i in range(self.size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.ids[chr(BYTES + int(piece[3:-1], 16))] = i
            elif not lib.is_control(i) and not lib.is_unknown(i) and (piece == START or piece.removeprefix(START).isalpha()):
                self.ids[piece] = i
        self.known = {p for p in self.ids if len(p) == 1}
        self.longest = max(map(len, self.ids))
        # the pieces as a trie: sorted keys of (state, sign), the state each leads to, and the piece that ends in a state
        signs = sorted(set("".join(self.ids)))
        self.base = len(signs) + 1
        self.code = np.zeros(sys.maxunicode + 1, np.int32)
        self.code[list(map(ord, signs))] = np.arange(1, self.base)
        moves: dict[int, int] = {}
        ends: dict[int, int] = {}
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                state = moves.setdefault(state * self.base + int(self.code[ord(c)]), len(moves) + 1)
            ends[state] = i
        self.keys = np.array(sorted(moves), np.int64)
        self.next = np.array([moves[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(moves) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def symbols(self, word: str) -> str:
        """The word with its start mark; letters without a piece as bytes."""
        word = START + word
        if self.known.issuperset(word):
            return word
        return "".join(c if c in self.known else "".join(chr(BYTES + b) for b in c.encode()) for c in word)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(first node, last node) of every word, and (source, target, piece, step, word) of all arcs, by step and target."""
        parts = list(map(self.symbols, words))
        n = np.array(list(map(len, parts)), np.int64)
        code = self.code[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")].astype(np.int64)
        first = np.cumsum(n + 1) - (n + 1)
        inside = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        left = np.repeat(n, n) - inside
        starts, states, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
        for k in range(1, self.longest + 1):  # all starts take the trie's k-th step at once
            stays = left[starts] >= k
            starts, states = starts[stays], states[stays]
            key = states * self.base + code[starts + k - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            stays = self.keys[at] == key
            starts, states = starts[stays], self.next[at[stays]]
            hit = self.piece[states] >= 0
            found.append((starts[hit], np.full(int(hit.sum()), k), self.piece[states[hit]]))
        start, size, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        of = np.repeat(np.arange(len(n)), n)[start]
        src, step = first[of] + inside[start], inside[start] + size
        order = np.lexsort((src + size, step))
        src, step, of = src[order], step[order], of[order]
        return first, first + n, src, src + size[order], ids[order], step, of


def _steps(step: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(step)) + 1
    ends = [0, *cuts.tolist(), len(step)]
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def forward(first: np.ndarray, nodes: int, src: np.ndarray, dst: np.ndarray, step: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log sums of all ways from a word's first node to each node; weight: log probability of each arc (rows) and language."""
    alpha = np.full((nodes, weight.shape[1]), -np.inf)
    alpha[first] = 0.0
    for a, b in _steps(step):
        to = dst[a:b]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        alpha[to[starts]] = np.logaddexp.reduceat(alpha[src[a:b]] + weight[a:b], starts, axis=0)
    return alpha


def backward(last: np.ndarray, nodes: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log sums of all ways from each node to its word's last one, by distance from there: arcs reversed."""
    end_of = np.zeros(nodes, np.int64)
    end_of[last] = 1
    ends = np.flatnonzero(end_of)
    ahead = ends[np.searchsorted(ends, np.arange(nodes))] - np.arange(nodes)  # symbols left after a node
    order = np.lexsort((src, ahead[src]))
    return forward(last, nodes, dst[order], src[order], ahead[src[order]], weight[order])


def log_table(counts: np.ndarray, usable: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log probabilities (languages x pieces) of expected counts; pieces that no word can use have none."""
    raised = np.where(usable, counts + smooth, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(raised / raised.sum(axis=1, keepdims=True))


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word and how often, of rows with lang and text."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def packed(counters: dict[str, Counter]) -> pa.RecordBatch:
        found = [(lang, w, n) for lang, c in counters.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for batch in slices(batches, 4096, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for words in word_runs(text.as_py()):
                    counters.setdefault(lang, Counter()).update(words)
            if sum(map(len, counters.values())) > COUNTED:
                yield packed(counters)
                counters = {}
        if any(counters.values()):
            yield packed(counters)

    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected(lexicon: DataFrame, langs: list[str], tables: np.ndarray, path: str) -> np.ndarray:
    """Expected counts (languages x pieces) of the lexicon's words under the present probabilities."""
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])
    at = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = Lattice(path), np.zeros(tables.shape)
        for batch in slices(batches, TOGETHER):
            lang = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            first, last, src, dst, ids, step, of = lattice.arcs(batch.column("word").to_pylist())
            weight = tables[lang[of], ids][:, None].astype(float)
            nodes = int(last[-1]) + 1
            alpha, beta = forward(first, nodes, src, dst, step, weight)[:, 0], backward(last, nodes, src, dst, weight)[:, 0]
            share = np.exp(alpha[src] + weight[:, 0] + beta[dst] - alpha[last][of]) * n[of]
            np.add.at(sums, (lang[of], ids), share)
        k, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[k, piece])], schema=schema)

    summed = lexicon.select("lang", "word", "n").mapInArrow(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    out = np.zeros(tables.shape)
    for batch in summed.toArrow().to_batches():  # at most languages x pieces
        out[batch.column("lang").to_numpy(), batch.column("piece").to_numpy()] = batch.column("n").to_numpy()
    return out


def fit(rows: DataFrame, folder: str, path: str, rounds: int = ROUNDS, smooth: float = SMOOTH) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log shares, log piece probabilities) learned from the lang and text of rows."""
    known = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    lexicon = stored(word_counts(known), f"{folder}/lexicon")
    shares = known.groupBy("lang").count().orderBy("lang").collect()  # one row a label value
    langs = [r["lang"] for r in shares]
    lattice = Lattice(path)
    usable = np.zeros(lattice.size, bool)
    usable[list(lattice.ids.values())] = True
    tables = log_table(np.zeros((len(langs), lattice.size)), usable, 1.0)
    for _ in range(rounds if langs else 0):
        tables = log_table(expected(lexicon, langs, tables.astype(np.float32), path), usable, smooth)
    total = np.array([r["count"] for r in shares], float)
    return langs, np.log(total / total.sum()) if langs else total, tables.astype(np.float32)


class Scorer:
    """Log probabilities of words by language, those of the last words kept."""

    def __init__(self, path: str, tables: np.ndarray) -> None:
        self.lattice, self.tables = Lattice(path), np.ascontiguousarray(tables.T)
        self.most = max(1024, CELLS // max(1, tables.shape[0]))
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, tables.shape[0]))

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.at))
        if len(self.at) + len(new) > self.most:
            self.at, self.scores = {}, self.scores[:0]
            new = list(words)
        for k in range(0, len(new), TOGETHER):
            some = new[k : k + TOGETHER]
            first, last, src, dst, ids, step, _ = self.lattice.arcs(some)
            alpha = forward(first, int(last[-1]) + 1, src, dst, step, self.tables[ids].astype(float))
            self.at.update(zip(some, range(len(self.at), len(self.at) + len(some)), strict=True))
            self.scores = np.concatenate([self.scores, alpha[last]])

    def text(self, words: list[str]) -> np.ndarray:
        return self.scores[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str) -> DataFrame:
    """docs: doc_id, text and columns to keep; adds lang_pred and score."""
    langs, shares, tables = model
    kept = [c for c in docs.columns if c != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(path, tables)
        for batch in slices(batches, 512, "text", 1 << 20):
            texts = batch.column("text")
            sums, some = np.zeros((batch.num_rows, len(langs))), np.zeros(batch.num_rows, bool)
            if batch.num_rows > 1:
                split = [[w for ws in word_runs(t.as_py() or "") for w in ws] for t in texts]
                scorer.learn(set().union(*split))
                for k, words in enumerate(split):
                    some[k] = bool(words)
                    sums[k] = scorer.text(words)
            else:
                for words in word_runs(texts[0].as_py() or ""):
                    some[0] |= bool(words)
                    scorer.learn(set(words))
                    sums[0] += scorer.text(words)
            known = some & bool(langs)
            sums = sums + shares
            best = sums.argmax(axis=1) if langs else np.zeros(batch.num_rows, np.int64)
            score = 1.0 / np.exp(sums - sums[np.arange(len(best)), best][:, None]).sum(axis=1) if langs else np.zeros(batch.num_rows)
            names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            columns = [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, ddl)


def remainder(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and the fold of a document, 0 to 4."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), (F.crc32(key) % 5).alias("fold"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = remainder(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model")
    model = fit(docs.where("fold <> 0"), new_folder(spark, "language"), path)
    return predict(docs.select("doc_id", "text", (F.col("fold") == 0).alias("held_out")), model, path)
