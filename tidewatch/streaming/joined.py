"""Streams with state between rows: outcomes graded as they come, by the pair or by the hour, duplicates dropped as they come (SURVEY O5.16,
O11.10, 2.13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from ..sources.tables import HOUR, PRICES_SQL, SCORES_SQL, read
from .hourly import event_stream

#: A signal is graded by the first price of these minutes after its horizon.
HORIZON, SPAN = 240, 10
DEADBAND = 0.1


#: State on disk with bounded memory, lists gathered one key at a time, and so many rows of the input a state partition or a task.
STATE = {
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
ROWS = 500_000


def _process(stream: DataFrame, folder: str, rows: int, mode: str, save: Callable[[DataFrame, int], None]) -> None:
    """Process what is there, of about so many rows. All of it can be one batch, whose rows are all state until it ends: state lies on
    disk, in partitions that grow with the rows in number."""
    spark = stream.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS + 1)
    held = STATE | {"spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in held}
    try:  # a stream takes its settings when it starts
        for k, v in held.items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_available(stream: DataFrame, folder: str, rows: int) -> DataFrame:
    """Process what is there in append mode into a table; a batch that is sent again replaces its own rows."""
    schema = stream.schema

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _process(stream, folder, rows, "append", save)
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def graded(signals: DataFrame, prices: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streams of signals (id, at, score) and prices (at, price): every pair of a signal and a price of the minutes after its horizon. State
    ends on both sides: a signal is kept until the prices' watermark has passed its last minute, a price until the signals' has
    passed the earliest signal that it could grade."""
    width = SPAN * 60
    slot = lambda at: F.floor(at.cast("long") / width)
    a = signals.withWatermark("at", lateness).select("id", F.col("at").alias("signal_at"), "score")
    b = prices.withWatermark("at", lateness).select(F.col("at").alias("price_at"), "price").withColumn("slot", slot(F.col("price_at")))
    first = slot(F.col("signal_at") + F.expr(f"interval {HORIZON} minutes"))
    a = a.withColumn("slot", F.explode(F.array(first, first + 1)))  # a join of streams needs an equality: the slots that the span touches
    reach = F.expr(f"price_at >= signal_at + interval {HORIZON} minutes and price_at < signal_at + interval {HORIZON + SPAN} minutes")
    return a.alias("a").join(b.alias("b"), (F.col("a.slot") == F.col("b.slot")) & reach).select("id", "signal_at", "score", "price_at", "price")


def gathered(signals: DataFrame, prices: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streams of signals (id, at, score) and prices (at, price), for update mode: for each hour of due times, the signals due in it and the
    prices that can grade them. Rows are stored once for each hour that they touch, whatever the pairs among them; an hour leaves the
    state when the watermarks of both streams have passed it."""
    ahead, reach = F.expr(f"interval {HORIZON} minutes"), F.expr(f"interval {SPAN} minutes")
    hour = lambda at: F.floor(at.cast("long") / HOUR)
    a = signals.select((F.col("at") + ahead).alias("due"), F.struct("at", "id", "score").alias("signal")).withWatermark("due", lateness)
    earliest = F.col("at") - reach + F.expr("interval 1 microsecond")  # due then at the earliest, if graded by this price
    dues = F.array_compact(F.array("at", F.when(hour(earliest) != hour(F.col("at")), earliest)))
    b = prices.select(F.explode(dues).alias("due"), F.struct("at", "price").alias("price")).withWatermark("due", f"{lateness} {SPAN} minutes")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(F.window("due", "1 hour").alias("hour")).agg(F.collect_list("signal").alias("signals"), F.collect_list("price").alias("prices"))


def _grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hours with their signals and prices to one row a signal that has a price: the first one, and how many there are."""
    for batch in batches:
        for k in range(batch.num_rows):
            signals, prices = (batch[c].slice(k, 1).flatten() for c in ("signals", "prices"))
            due = signals.field("at").cast(pa.int64()).to_numpy() + HORIZON * 60_000_000
            at, price = prices.field("at").cast(pa.int64()).to_numpy(), prices.field("price").to_numpy()
            order = np.lexsort((price, at))
            first, end = (np.searchsorted(at[order], t) for t in (due, due + SPAN * 60_000_000))
            hit = np.flatnonzero(end > first)
            if len(hit):
                of, by = signals.take(pa.array(hit)), prices.take(pa.array(order[first[hit]]))
                hour = pa.array(np.repeat(batch["hour"][k].as_py(), len(hit)))
                yield pa.RecordBatch.from_arrays([hour, of.field("id"), of.field("at"), of.field("score"), by.field("at"), by.field("price"), pa.array((end - first)[hit])], ["hour", "id", "signal_at", "score", "price_at", "price", "pairs"])


def grade_available(signals: DataFrame, prices: DataFrame, folder: str, rows: int, lateness: str = "1 hour") -> DataFrame:
    """hour, id, signal_at, score, price_at, price, pairs: the pairs of ``graded`` as their number and the first price of a signal, without
    one row a pair. Each batch writes the hours it changed below its number, a retry rewrites them, and an hour's newest rows are its result."""
    spark = signals.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*signals.schema, *prices.schema]}
    schema = f"hour bigint, id {kinds['id']}, signal_at timestamp, score double, price_at timestamp, price double, pairs bigint"

    def save(batch: DataFrame, number: int) -> None:
        hours = batch.select(F.col("hour.start").cast("long").alias("hour"), "signals", "prices")
        hours.where(F.size("signals") > 0).mapInArrow(_grade, schema).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _process(gathered(signals, prices, lateness), folder, rows, "update", save)
    found = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/out")
    newest = found.groupBy("hour").agg(F.max("batch").alias("batch"))
    return found.join(newest, ["hour", "batch"]).drop("batch")


def distinct_posts(posts: DataFrame, within: str = "1 day") -> DataFrame:
    """A stream of posts (at, body, ...) without those whose body came before, within a time of each other. The digest is taken of the
    body as it came, so posts that differ in capitals alone stay apart; the text is lower-cased only afterwards."""
    marked = posts.withColumn("digest", F.sha2(F.coalesce(F.col("body"), F.lit("")), 256)).withWatermark("at", within)
    return marked.dropDuplicatesWithinWatermark(["digest"]).withColumn("body", F.lower("body"))


def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = event_stream(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    good = F.col("value").isNotNull() & ~F.isnan("value")
    score = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("value") - 50) / 50))
    signals = rows.where((F.col("event_type") == "click") & good).select(F.col("event_id").alias("id"), "at", score.alias("score")).where(F.abs("score") >= DEADBAND)
    return signals, rows.where("event_type = 'purchase' and value is not null").select("at", (F.col("value") + 100).alias("price"))


def o11_10_graded_stream(spark, sf_dir):
    """Signals graded by the first price ten minutes from four hours on, as two streams brought together by the hour (O11.10): pairs that
    there are, and how many signals of an hour have a price and agree with its side of 150."""
    events = read(spark, sf_dir, "events").count()
    found = grade_available(*_streams(spark, sf_dir), new_folder(spark, "graded"), events)
    dealt = found.repartition(events // ROWS + 1, "id")  # a task's signals do not grow with their number
    first = dealt.groupBy("id").agg(F.min(F.struct("price_at", "price"))["price"].alias("later"), F.min("score").alias("score"), F.min("signal_at").alias("at"), F.sum("pairs").alias("pairs"))
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(at AS TIMESTAMP_NTZ))")
    hour = (F.floor(second / HOUR) * HOUR).cast("long")
    return first.groupBy(hour.alias("hour")).agg(F.count("*").alias("graded"), F.sum("pairs").alias("pairs"), F.count_if(F.signum("score") == F.signum(F.col("later") - 150)).alias("agree"))


S11_10 = f"""WITH {SCORES_SQL}, {PRICES_SQL}, s AS (SELECT event_id AS id, ts, least(1.0, greatest(-1.0, (value - 50) / 50)) AS score FROM events WHERE event_type = 'click' AND value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT s.id, s.ts AS began, s.score, p.ts AS price_at, p.value + 100 AS price FROM s JOIN events p ON p.event_type = 'purchase' AND p.value IS NOT NULL AND p.ts >= s.ts + INTERVAL {HORIZON} MINUTE AND p.ts < s.ts + INTERVAL {HORIZON + SPAN} MINUTE WHERE abs(s.score) >= {DEADBAND}),
f AS (SELECT id, min(began) AS began, min(score) AS score, arg_min(price, (price_at, price)) AS later, count(*) AS pairs FROM q GROUP BY id)
SELECT floor(epoch(began))::BIGINT // 3600 * 3600 AS hour, count(*) AS graded, sum(pairs)::BIGINT AS pairs, count(*) FILTER (sign(score) = sign(later - 150)) AS agree FROM f GROUP BY 1"""


def o5_16_stream_dedup(spark, sf_dir):
    """Conversation turns as a stream of posts, a minute apart by conversation, once each by what they say (O5.16): how many of each role
    stay, and their length."""
    table = read(spark, sf_dir, "conversations")
    reader = spark.readStream.schema(table.schema)
    single = all(f.rstrip("/").endswith("/conversations.parquet") for f in table.inputFiles())
    rows = reader.option("pathGlobFilter", "conversations.parquet").parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/conversations.parquet")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60)
    posts = rows.select(at.alias("at"), "role", F.col("text").alias("body"))
    kept = append_available(distinct_posts(posts, "3650 days"), new_folder(spark, "deduped"), table.count())
    return kept.groupBy("digest").agg(F.count("*").alias("kept"), F.max(F.length("body")).cast("long").alias("n_chars"))


S5_16 = "SELECT sha256(coalesce(text, '')) AS digest, 1::BIGINT AS kept, max(length(lower(text)))::BIGINT AS n_chars FROM conversations GROUP BY 1"

QUERIES = {f.__name__: f for f in (o11_10_graded_stream, o5_16_stream_dedup)}
ORACLE_SQL = {"o11_10_graded_stream": S11_10, "o5_16_stream_dedup": S5_16}
