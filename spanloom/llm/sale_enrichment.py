"""Valid-time enrichment of sales: a stateful stream gives each sale its client's version that was valid when it was sold.

Sales and changes are cut into numbered batches, written under the shared folder and fed in order to one streaming query,
which is started anew for each batch on one checkpoint. State is keyed by buckets of clients; each holds the unpruned
versions of its clients and the sales that wait. The event time of a row is the largest time of its table so far, so no row
is ever late for Spark; each table has its watermark (that maximum minus a delay), and the policy `min` of several
watermarks yields H. A bucket's event-time timer stands at the first time that releases a waiting sale or lets a version be
pruned; rows and timers lead to the same step: versions in, sales out, versions pruned.

Hot clients: a client with more than BUCKET_ROWS sales is dealt to several buckets by sale, and its versions are copied to
each of them; there are only so many shards that the copies stay in proportion to the client's rows. What is not split is one
client's unpruned versions, those of about one batch: every shard of it holds them, at some 60 bytes each.

Spark's watermark has milliseconds. The event time is rounded up, and a start is told the microseconds that H lies below it,
so that comparisons are exact; where H moves within a millisecond, every bucket gets a row of its own and no timer is needed.

Null client_id: the sale has no client, so no version (n_held 0); such changes are only counted as late or not. Null sold_at:
emitted at once, without a version. Null valid_at: the change is ignored. Null arrived_at or change_id: the last batch, as
least() skips nulls; days before the first one: batch 0. Null or NaN balance: null cents. Ties of versions go by valid_at,
seq, change_id, nulls first. Repeated sales are rows of their own; repeated changes count once. Times up to the delay after
1970 move no watermark. Empty tables give an empty result. Other columns are not read and may have any name; texts play no part.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import remove_folder, shared_path
from .crc_sql import crc32_sql

#: Batches, the first day (since 1970) and the number of days that they cover, the days that changes are spread over.
BATCHES, FIRST_DAY, DAYS, SPREAD = 8, 19723, 152, 4
DELAY_HOURS = 12
#: Rows that a bucket of clients should get in all; the number of buckets follows from it, and hot clients are split by it.
BUCKET_ROWS = 20_000
#: Clients split into shards that are broadcast (16 bytes each); more of them are joined by a shuffle.
HOT_CLIENTS = 10_000

ROW = "bucket int, kind string, id bigint, client bigint, us bigint, seq bigint, cents bigint, op string"
RESULT = "rec string, id bigint, batch bigint, n_held bigint, change_id bigint, balance_cents bigint, op string"
STATE = "versions binary, waiting binary"
SALE, VERSION, LATE, TICK = "sale", "version", "late", "tick"
_DAY_US, _NEVER = 86_400_000_000, -(1 << 63)
_VERSIONS = ["client", "us", "seq", "id", "cents", "op"]
_WAITING = ["id", "client", "us"]


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp, by its own clock where it has no zone."""
    apart = f"(cast(`{name}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00')"
    parts = (("DAY", _DAY_US), ("HOUR", 3_600_000_000), ("MINUTE", 60_000_000))
    whole = " + ".join(f"extract({p} from {apart}) * {n}L" for p, n in parts)
    return F.expr(f"{whole} + cast(extract(SECOND from {apart}) * 1000000 as bigint)")


def batch_of(day: Column, batches: int = BATCHES, first_day: int = FIRST_DAY, days: int = DAYS) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first_day) * batches / days))).cast("int")


def cut_sales(sales: DataFrame, batches: int = BATCHES) -> DataFrame:
    """id, client, us (when sold), batch."""
    flat = sales.select(F.col("sale_id").cast("bigint").alias("id"), F.col("client_id").cast("bigint").alias("client"), micros("sold_at").alias("us"), micros("arrived_at").alias("arrived"))
    return flat.select("id", "client", "us", batch_of(F.floor(F.col("arrived") / _DAY_US), batches).alias("batch"))


def cut_changes(changes: DataFrame, batches: int = BATCHES) -> DataFrame:
    """id, client, us (valid from), seq, cents, op, batch of the distinct changes with a time."""
    known = changes.where(F.col("valid_at").isNotNull())
    names = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
    flat = known.select(*names).distinct()
    spread = F.crc32(F.encode(F.col("change_id").cast("string"), "utf-8")) % SPREAD
    cents = F.when(~F.isnan("balance"), F.floor(F.lit(100.0) * F.col("balance") + 0.5)).cast("bigint")
    flat = flat.select(F.col("change_id").cast("bigint").alias("id"), F.col("client_id").cast("bigint").alias("client"), micros("valid_at").alias("us"), F.col("seq").cast("bigint").alias("seq"), cents.alias("cents"), "op", spread.alias("spread"))
    return flat.select("id", "client", "us", "seq", "cents", "op", batch_of(F.floor(F.col("us") / _DAY_US) + F.col("spread"), batches).alias("batch"))


def running_maxima(rows: DataFrame, batches: int) -> list[int | None]:
    """The largest time of the batches up to each; one number a batch comes to the driver."""
    found, out = dict(rows.groupBy("batch").agg(F.max("us")).collect()), []
    for b in range(batches):
        out.append(max((x for x in (found.get(b), out[-1] if out else None) if x is not None), default=None))
    return out


class Enricher:
    """One start's step of a bucket: versions in, sales out, versions pruned, the next timer set."""

    def __init__(self, batch: int, below_us: int, flush: bool):
        self.batch, self.below_us, self.flush = batch, below_us, flush

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = None if state.hasTimedOut else pd.concat(list(rows), ignore_index=True)
        if given is not None and (late := given["kind"] == LATE).any():
            yield self._result("late", given.loc[late, "id"], None, None)
        h_ms = state.getCurrentWatermarkMs()
        h = h_ms * 1000 - self.below_us if h_ms > 0 else _NEVER
        versions, waiting = map(_unpacked, state.get) if state.exists else (None, None)
        new = {k: None if given is None else given[given["kind"] == k] for k in (VERSION, SALE)}
        held = _joined(versions, new[VERSION], _VERSIONS, {"client": "int64", "us": "int64", "seq": "Int64", "id": "Int64", "cents": "Int64"})
        held = held.sort_values(["client", "us", "seq", "id"], kind="stable", na_position="first", ignore_index=True)
        sales = _joined(waiting, new[SALE], _WAITING, {"id": "Int64", "client": "Int64", "us": "Int64"})
        ready = pd.Series(True, sales.index) if self.flush else sales["us"].isna() | (sales["us"].fillna(0) < h)
        out, rest = sales[ready], sales[~ready]
        if len(out):
            yield self._emitted(out, held)
        settled = held["us"] <= h
        last = settled & ~held["client"].where(settled).duplicated(keep="last")
        kept = held[~settled | last].reset_index(drop=True)
        state.update((_packed(kept), _packed(rest)))
        self._set_timer(state, kept, rest, h_ms)

    def _emitted(self, out: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Sales with the last of their client's held versions up to the time sold."""
        known = out[out["us"].notna() & out["client"].notna()].astype({"us": "int64", "client": "int64"})
        known = known.reset_index(names="row").sort_values("us", kind="stable")
        by_time = held.sort_values("us", kind="stable")  # within a client and time the order stays
        found = pd.merge_asof(known[["row", "client", "us"]], by_time.rename(columns={"id": "change_id"}), on="us", by="client").set_index("row")
        n_held = out["client"].map(held.groupby("client").size()).fillna(0).astype("int64")
        return self._result("sale", out["id"], n_held, found.reindex(out.index))

    def _result(self, rec: str, ids: pd.Series, n_held, found) -> pd.DataFrame:
        none = pd.Series(pd.NA, ids.index)
        columns = {"rec": rec, "id": ids, "batch": self.batch, "n_held": none if n_held is None else n_held}
        columns |= {name: none if found is None else found[c] for name, c in (("change_id", "change_id"), ("balance_cents", "cents"), ("op", "op"))}
        whole = {c: "Int64" for c in ("id", "n_held", "change_id", "balance_cents")}
        return pd.DataFrame(columns, index=ids.index).astype(whole).astype({"op": object}).replace({"op": {pd.NA: None, np.nan: None}})

    def _set_timer(self, state: GroupState, kept: pd.DataFrame, rest: pd.DataFrame, h_ms: int) -> None:
        """At the first waiting sale, or just before the first version that would displace another; never in the past."""
        at = [] if rest.empty else [int(rest["us"].min()) // 1000]
        displacing = kept.loc[kept["client"].duplicated(keep="first"), "us"]
        at += [] if displacing.empty else [(int(displacing.min()) - 1) // 1000]
        if at:
            state.setTimeoutTimestamp(max(min(at), h_ms, 1))


def _joined(stored: pd.DataFrame | None, new: pd.DataFrame | None, columns: list[str], kinds: dict[str, str]) -> pd.DataFrame:
    parts = [p[columns].astype(kinds) for p in (stored, new) if p is not None and len(p)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: pd.Series(dtype=kinds.get(c, object)) for c in columns})


def _unpacked(packed: bytes | None) -> pd.DataFrame | None:
    """The rows that _packed() gave."""
    if packed is None:
        return None
    whole = {pa.int64(): pd.Int64Dtype()}
    return pa.ipc.open_stream(packed).read_all().to_pandas(types_mapper=whole.get)


def _packed(rows: pd.DataFrame) -> bytes | None:
    """Rows as an Arrow stream."""
    if rows.empty:
        return None
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def enrich_sales(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, delay_hours: int = DELAY_HOURS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rec, id, batch, n_held, change_id, balance_cents, op: every sale when it is emitted, every change that came late."""
    return enrich(cut_sales(sales, batches), cut_changes(changes, batches), batches, delay_hours, bucket_rows)


def enrich(sales: DataFrame, changes: DataFrame, batches: int, delay_hours: int = DELAY_HOURS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The same for tables that are cut already (columns as cut_sales() and cut_changes() give them)."""
    spark = sales.sparkSession
    folder = f"{shared_path(spark)}/enrichment-{uuid.uuid4().hex}"
    changes.write.parquet(f"{folder}/changes")  # distinct rows, found once
    changes = spark.read.schema(changes.schema).parquet(f"{folder}/changes")
    maxima = {"sales": running_maxima(sales, batches), "changes": running_maxima(changes, batches)}
    buckets = _deal(spark, folder, sales, changes, maxima["changes"], delay_hours, bucket_rows)
    delay_us = delay_hours * 3_600_000_000
    before = (0, 0)
    for b in range(batches + 1):
        earlier = [m[b - 1] if b else None for m in maxima.values()]
        h_us = None if None in earlier else min(earlier) - delay_us
        h_ms = 0 if h_us is None else -(-h_us // 1000)
        here = (max(h_ms, 0), h_us or 0)
        every = b == batches or here[0] == before[0] and here != before
        before = here
        for name in maxima:
            seen = maxima[name][min(b, batches - 1)]
            _feed(spark, folder, name, b if b < batches else None, 1 if seen is None else max(1, -(-seen // 1000)), buckets if every else 1)
        _start(spark, folder, Enricher(b, 0 if h_us is None else h_ms * 1000 - h_us, b == batches), delay_hours)
    for done in ("changes", "hot", "cut", "in", "state"):
        remove_folder(spark, f"{folder}/{done}")
    return spark.read.schema(RESULT).parquet(f"{folder}/out")


def _deal(spark: SparkSession, folder: str, sales: DataFrame, changes: DataFrame, seen: list[int | None], delay_hours: int, bucket_rows: int) -> int:
    """Write both tables by batch with the buckets of their rows; the number of buckets."""
    n_versions = changes.where("client is not null").groupBy("client").agg(F.count("*").alias("nv"))
    n_sales = sales.where("client is not null").groupBy("client").agg(F.count("*").alias("ns")).where(F.col("ns") > bucket_rows)
    shards = F.ceil(F.col("ns") / F.greatest(F.lit(bucket_rows), F.coalesce("nv", F.lit(0)) / 4))
    n_sales.join(n_versions, "client", "left").select("client", shards.cast("int").alias("shards")).write.parquet(f"{folder}/hot")
    hot = spark.read.schema("client bigint, shards int").parquet(f"{folder}/hot")
    if hot.count() <= HOT_CLIENTS:
        hot = F.broadcast(hot)
    buckets = max(1, math.ceil((sales.count() + changes.count()) / bucket_rows))

    def bucket(*of) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(buckets)).cast("int")

    own = F.pmod(F.xxhash64("id"), F.coalesce("shards", F.lit(1))).cast("int")
    placed = sales.join(hot, "client", "left").withColumn("bucket", F.when(F.col("client").isNull(), bucket("id")).otherwise(bucket("client", own)))
    _row(placed, F.lit(SALE)).write.partitionBy("batch").parquet(f"{folder}/cut/sales")

    marks = {b: seen[b - 1] - delay_hours * 3_600_000_000 for b in range(1, len(seen)) if seen[b - 1] is not None}
    mark = F.create_map(*(F.lit(x) for b in marks.items() for x in b)) if marks else F.create_map().cast("map<int,bigint>")
    late = F.coalesce(F.col("us") < F.try_element_at(mark, F.col("batch")), F.lit(False))
    copies = F.array_distinct(F.transform(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1), lambda s: bucket("client", s)))
    one = late | F.col("client").isNull()
    placed = changes.join(hot, "client", "left").withColumn("late", late).withColumn("bucket", F.explode(F.when(one, F.array(bucket("id"))).otherwise(copies)))
    placed = placed.where(F.col("late") | F.col("client").isNotNull())
    _row(placed, F.when(F.col("late"), LATE).otherwise(VERSION)).write.partitionBy("batch").parquet(f"{folder}/cut/changes")
    return buckets


def _row(placed: DataFrame, kind: Column) -> DataFrame:
    """The columns of ROW and the batch; those that a table lacks are null."""
    fields = [x.split() for x in ROW.split(", ")]
    given = {c: F.col(c) for c in placed.columns} | {"kind": kind}
    return placed.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields), "batch")


def _feed(spark: SparkSession, folder: str, name: str, batch: int | None, at_ms: int, ticks: int) -> None:
    """Append a batch to what the stream reads, with the table's event time; `ticks` rows go to the first buckets."""
    fields = [x.split() for x in ROW.split(", ")]
    given = {"bucket": F.col("id"), "kind": F.lit(TICK)}
    rows = spark.range(ticks).select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
    if batch is not None:
        cut = spark.read.schema(f"{ROW}, batch int").parquet(f"{folder}/cut/{name}").where(F.col("batch") == batch).drop("batch")
        rows = cut.unionByName(rows)
    rows.withColumn("at", F.timestamp_millis(F.lit(at_ms))).write.mode("append").parquet(f"{folder}/in/{name}")


#: Settings of a start: the smallest watermark counts, and timers wait for the next batch.
_SETTINGS = {
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _start(spark: SparkSession, folder: str, step: Enricher, delay_hours: int) -> None:
    """Start the query on its checkpoint and let it take what is there."""
    held = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        streams = [spark.readStream.schema(f"{ROW}, at timestamp").parquet(f"{folder}/in/{n}").withWatermark("at", f"{delay_hours} hours") for n in ("sales", "changes")]
        out = streams[0].unionByName(streams[1]).groupBy("bucket").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def enrichment_sql() -> str:
    """The same rows in SQL: what a sale meets follows from the batches of changes, their watermark and H."""
    return f"""
WITH s AS (SELECT sale_id, client_id, epoch_us(sold_at) us, greatest(0, least({BATCHES} - 1, floor((floor(epoch_us(arrived_at) / {_DAY_US}) - {FIRST_DAY}) * {BATCHES} / {DAYS})))::BIGINT b FROM sales),
d AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
c AS (SELECT *, epoch_us(valid_at) us, greatest(0, least({BATCHES} - 1, floor((floor(epoch_us(valid_at) / {_DAY_US}) + {crc32_sql("change_id::VARCHAR")} % {SPREAD} - {FIRST_DAY}) * {BATCHES} / {DAYS})))::BIGINT b FROM d),
n AS (SELECT unnest(range({BATCHES} + 1)) b),
w AS (SELECT b, (SELECT max(us) FROM s WHERE s.b < n.b) - {DELAY_HOURS * 3_600_000_000} ws, (SELECT max(us) FROM c WHERE c.b < n.b) - {DELAY_HOURS * 3_600_000_000} wc FROM n),
h AS (SELECT b, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END h, wc FROM w),
v AS (SELECT c.*, coalesce(c.us < h.wc, false) late FROM c JOIN h USING (b)),
k AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY us, seq NULLS FIRST, change_id NULLS FIRST) o FROM v WHERE NOT late),
-- the last version that pruning leaves behind each batch
l AS (SELECT h.b, k.client_id, max(k.o) o FROM h JOIN k ON k.b < h.b AND k.us <= (SELECT h2.h FROM h h2 WHERE h2.b = h.b - 1) GROUP BY 1, 2),
e AS (SELECT s.*, CASE WHEN s.us IS NULL THEN s.b ELSE coalesce((SELECT min(h.b) FROM h WHERE h.b >= s.b AND h.b < {BATCHES} AND s.us < h.h), {BATCHES}) END eb, row_number() OVER () r FROM s),
p AS (SELECT e.r, count(k.o) n_held, max(CASE WHEN k.us <= e.us THEN k.o END) o FROM e JOIN k ON k.client_id = e.client_id AND k.b <= e.eb LEFT JOIN l ON l.b = e.eb AND l.client_id = e.client_id WHERE k.b = e.eb OR k.o >= coalesce(l.o, 0) GROUP BY 1)
SELECT 'sale' rec, e.sale_id id, e.eb AS batch, coalesce(p.n_held, 0) n_held, k.change_id, floor(100 * k.balance + 0.5)::BIGINT balance_cents, k.op
FROM e LEFT JOIN p ON p.r = e.r LEFT JOIN k ON k.client_id = e.client_id AND k.o = p.o
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM v WHERE late"""
