"""Vectors of texts from a provider: a content-addressed cache, batches with retries, a circuit breaker and a quarantine.

A provider is any function from a list of texts to as many vectors, sent to the tasks as it is. The cache is a table of digest and
vector below a folder of its own for each provider's name, so vectors of two models never mix; a run asks only for digests that no commit
has, and its answers are seen when its commit is. Runs that go on at once may both ask for a text; either answer serves.

A call is tried again after transient failures, with growing pauses. A batch that the provider refuses for good is halved until the
texts that it refuses stand alone. After OPEN_AFTER failed calls in a row a task's breaker is open: batches are not sent until the pause is
over, then one is sent as a probe. What failed, was refused or was not sent lies in quarantine with its reason, and the next run asks for it
again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

Provider = Callable[[list[str]], list[list[float]]]
_KIND = "digest string, vector array<float>, reason string, run string"


class Refused(Exception):
    """The provider will never take this batch."""


@dataclass(frozen=True)
class Calls:
    """How a provider is called."""

    batch: int = 64
    retries: int = 2
    pause: float = 1.0
    open_after: int = 4
    cooldown: float = 120.0


class Breaker:
    """Calls with retries that stop after too many failures in a row."""

    def __init__(self, provider: Provider, calls: Calls, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.provider, self.calls, self.clock, self.sleep = provider, calls, clock, sleep
        self.failures, self.until, self.dim = 0, 0.0, None

    def _checked(self, texts: list[str]) -> np.ndarray:
        got = np.asarray(self.provider(texts), np.float32)
        if got.ndim != 2 or len(got) != len(texts) or not got.shape[1] or not np.isfinite(got).all() or self.dim not in (None, got.shape[1]):
            raise ValueError(f"{len(texts)} texts, vectors of shape {got.shape}, or not finite")
        self.dim = got.shape[1]
        return got

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        """(vector, None) or (None, reason) of every text."""
        if self.failures >= self.calls.open_after and self.clock() < self.until:
            return [(None, "not sent")] * len(texts)
        tries = 1 if self.failures >= self.calls.open_after else self.calls.retries + 1  # one probe
        for attempt in range(tries):
            try:
                got = self._checked(texts)
                self.failures = 0
                return [(v, None) for v in got]
            except Refused as why:
                self.failures = 0  # it answered
                if len(texts) == 1:
                    return [(None, f"refused: {why}")]
                half = len(texts) // 2
                return self(texts[:half]) + self(texts[half:])
            except Exception as why:  # noqa: BLE001: whatever a provider raises else is transient
                self.failures += 1
                self.until = self.clock() + self.calls.cooldown
                reason = f"failed: {type(why).__name__}"
                if self.failures >= self.calls.open_after:
                    break
                if attempt + 1 < tries:
                    self.sleep(self.calls.pause * 2**attempt)
        return [(None, reason)] * len(texts)


def digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _answers(spark: SparkSession, root: str) -> DataFrame:
    """All answers so far, refused ones too."""
    last = commits.newest(spark, root)
    folders = last[1]["folders"] if last else []
    return spark.read.schema(_KIND).parquet(*(f"{root}/{f}" for f in folders)) if folders else spark.createDataFrame([], _KIND)


def cached(spark: SparkSession, root: str) -> DataFrame:
    """digest and vector of all texts answered, and the run that stored it; the first answer of each."""
    return _answers(spark, root).where("vector is not null").groupBy("digest").agg(F.min_by(F.struct("vector", "run"), "run").alias("x")).select("digest", "x.*")


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """digest and last reason of texts without a vector."""
    failed = _answers(spark, root).where("vector is null").groupBy("digest").agg(F.max_by("reason", "run").alias("reason"))
    return failed.join(cached(spark, root).select("digest"), "digest", "left_anti")


def ask(texts: DataFrame, root: str, provider: Provider, run: str, calls: Calls = Calls(), text: str = "text") -> int:
    """Ask for the vectors of all texts that the cache below root lacks; returns how many those were. Null texts count as empty."""
    spark = texts.sparkSession
    schema = pa.schema([("digest", pa.string()), ("vector", pa.list_(pa.float32())), ("reason", pa.string()), ("run", pa.string())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker, held = Breaker(provider, calls), []

        def packed(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            got = breaker([t for _, t in rows])
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([v for v, _ in got], schema.field("vector").type), pa.array([r for _, r in got], pa.string()), pa.array([run] * len(rows))], schema=schema)

        for batch in batches:
            held += zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True)
            while len(held) >= calls.batch:
                yield packed(held[: calls.batch])
                held = held[calls.batch :]
        if held:
            yield packed(held)

    body = F.coalesce(F.col(text), F.lit(""))
    distinct = texts.select(digest(body).alias("digest"), body.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    todo = distinct.join(cached(spark, root).select("digest"), "digest", "left_anti")
    folder = f"answers/{uuid.uuid4().hex}"
    asked = commits.written(todo.mapInArrow(send, _KIND), f"{root}/{folder}")["rows"]
    while asked:  # another run may commit first: take the next version
        last = commits.newest(spark, root)
        version, folders = (last[0] + 1, last[1]["folders"]) if last else (0, [])
        if commits.commit(spark, root, version, {"run": run, "folders": [*folders, folder]}):
            break
    return asked


def vectors(texts: DataFrame, root: str, text: str = "text") -> DataFrame:
    """texts with their digest and vector, null where there is none yet."""
    named = texts.withColumn("digest", digest(F.col(text)))
    return named.join(cached(texts.sparkSession, root).select("digest", "vector"), "digest", "left")


def letters(texts: list[str]) -> list[list[float]]:
    """A provider that needs no model: how often each of 26 letters occurs, to unit length."""
    out = []
    for t in texts:
        low = t.lower()
        n = np.array([low.count(chr(97 + k)) for k in range(26)], float)
        out.append((n / max(1e-12, float(np.sqrt((n * n).sum())))).tolist())
    return out
