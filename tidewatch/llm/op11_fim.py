"""Fill-in-the-middle documents by a streaming matcher that holds no list of units.

A text is a run of units, ``[A-Za-z]+`` or one other code point, matched left to right. A first pass advances the
matcher to the end and counts; the two cut ranks follow from a hash of doc_id and that count. A second pass starts the
matcher anew and advances it to the smaller and then to the larger rank, where the text is cut. Neither pass keeps
a match: beside the text and its output a task holds two numbers, whatever the length.

``fill_in_middle`` gives the transformed texts, ``restored`` is the column expression that rebuilds a text from its
output and form. A text that holds a sentinel is left plain, so the sentinels of an output are its only ones, also where they
touch the parts, and the parts come back by one split. No row is moved: there is no shuffle.

Edge cases: null and empty texts are plain, with 0 units; a null doc_id is hashed like an empty one; repeated rows are
transformed alike; very long texts are cut like others (a long text is an Arrow batch of its own); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = re.compile("|".join((PREFIX, SUFFIX, MIDDLE)))
#: Of 100 texts so many are transformed, and of 100 of those so many with the suffix first.
RATE, SPM_RATE = 90, 20


def units(text: str) -> int:
    """First pass: how many units the matcher finds."""
    seen = count()
    deque(zip(UNIT.finditer(text), seen, strict=False), maxlen=0)
    return next(seen)


def cuts(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: code points before the units of rank ``low`` and ``high`` (low <= high)."""
    at, matcher = [0], UNIT.finditer(text)
    for step in (low, high - low):
        at.append(next(islice(matcher, step - 1, None)).end() if step else at[-1])
    return at[1], at[2]


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """The document's four 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    n = units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or SENTINEL.search(text):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts(text, low, high)
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows = [transform(d, t.as_py() or "", rate, spm_rate, seed) for d, t in zip(ids, texts, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def restored(output: Column, form: Column) -> Column:
    """The text of an output."""
    parts = F.split(output, f"<[{PREFIX[1]}{SUFFIX[1]}{MIDDLE[1]}]>", -1)
    joined = F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
    joined = joined.otherwise(F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
    return F.when(form == "plain", output).otherwise(joined)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH a AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), b AS (
    SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2, ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4 FROM a
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b
), d AS (
    SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM d
"""
