"""Events: admission, duplicates, deletion, and queries by scalar predicates.

An event has event_id, tenant_id, event_time and observed_time (ms), event_name,
cost and error. Pages are ordered by score, falling, then event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.errors import Refused

DAY = 86_400_000
BEHIND, AHEAD = 7 * DAY, 3_600_000
DEFAULT_LIMIT, MOST_GROUP_COLUMNS, MOST_IN = 10, 16, 1024
NUMERIC = ("cost", "event_time", "observed_time", "score")


def is_in(column: Column, values: list) -> Column:
    """Membership in a list of at most 1024 literals; unknown for null."""
    if len(values) > MOST_IN:
        raise Refused("InListTooLong", str(len(values)))
    return column.isin(values)


def day_window(event_time: Column) -> Column:
    """Start of the day that a time in ms lies in; floors negative times too."""
    return event_time - F.pmod(event_time, F.lit(DAY))


def page(events: DataFrame, predicate: Column | None = None, k: int = DEFAULT_LIMIT, after: tuple[float, int] | None = None, score: Column | None = None) -> DataFrame:
    """The first k matching events, or the first k after a (score, event_id)."""
    rows = events if predicate is None else events.where(predicate)
    rows = rows.withColumn("score", F.lit(0.0) if score is None else score)
    if after is not None:
        rows = rows.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("event_id") > after[1])))
    return rows.orderBy(F.desc("score"), F.asc("event_id")).limit(k)


def group(events: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | None]], predicate: Column | None = None) -> DataFrame:
    """Aggregates ("count", "sum", "avg", "min", "max" of a column) by up to 16 columns; keys as text."""
    if len(keys) > MOST_GROUP_COLUMNS:
        raise Refused("TooManyGroupColumns", str(len(keys)))
    aggs = []
    for name, (fn, column) in aggregates.items():
        if fn not in ("count", "sum", "avg", "min", "max"):
            raise Refused("UnknownFunction", fn)
        if fn in ("sum", "avg") and column not in NUMERIC:
            raise Refused("TypeMismatch", f"{fn}({column})")
        aggs.append((F.count("*") if column is None else getattr(F, fn)(column)).alias(name))
    rows = events if predicate is None else events.where(predicate)
    return rows.groupBy(*keys).agg(*aggs).select(*[F.col(c).cast("string").alias(c) for c in keys], *aggregates)


def content_hash(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def latest(events: DataFrame, key: str = "event_id", time: str = "event_time", hashed: list[str] | None = None) -> DataFrame:
    """One event of each key: the latest, of equals the one with the larger content hash. Aggregated before the shuffle."""
    columns = events.columns
    ranked = events.withColumn("__hash", content_hash(hashed or columns))
    best = ranked.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, "__hash")).alias("__best"))
    return best.select("__best.*")


def without(events: DataFrame, tombstones: DataFrame, key: str = "event_id") -> DataFrame:
    return events.join(tombstones.select(key), key, "left_anti")


def redacted(events: DataFrame, before: int, body: str = "body") -> DataFrame:
    """Bodies of events before a time are dropped."""
    return events.withColumn(body, F.when(F.col("event_time") >= before, F.col(body)))


def skew_reason(event_time: Column, observed_time: Column) -> Column:
    """Why an event's time is not admitted, or null; times are never clamped."""
    return F.when(event_time < observed_time - BEHIND, "TooOld").when(event_time > observed_time + AHEAD, "TooNew")


def admit(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): events need an id, a tenant, a name and a plausible time."""
    missing = F.when(F.col("event_id").isNull(), "MissingId").when(F.col("tenant_id").isNull(), "MissingTenant").when(F.col("event_name").isNull(), "MissingName").when(F.col("event_time").isNull(), "MissingTime")
    judged = events.withColumn("reason", F.coalesce(missing, skew_reason(F.col("event_time"), F.col("observed_time"))))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def idempotent(events: DataFrame, key: list[str], hashed: list[str], arrival: str) -> DataFrame:
    """events with verdict: "first", "replay" (equal content came before) or "IdempotencyConflict"."""
    first = events.groupBy(*key).agg(F.min(F.struct(F.col(arrival).alias("a"), content_hash(hashed).alias("h"))).alias("f"))
    both = events.join(first, key)
    verdict = F.when(F.col(arrival) == F.col("f.a"), "first").when(content_hash(hashed) == F.col("f.h"), "replay").otherwise("IdempotencyConflict")
    return both.withColumn("verdict", verdict).drop("f")


def interleaved(events: DataFrame, tenant: str = "tenant_id", order: str = "event_id") -> DataFrame:
    """events with turn, their place in their tenant's queue; sorted by (turn, tenant) tenants take turns."""
    return events.withColumn("turn", F.row_number().over(Window.partitionBy(tenant).orderBy(order)).cast("long"))


KEYS_A_PARTITION, EVENTS_A_SECOND, BYTES_A_SECOND = 512, 10_000, 64 << 20


def new_keys(events: DataFrame, known: DataFrame, attributes: str = "attributes", most: int = KEYS_A_PARTITION, order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason KeyCardinality): a tenant may use `most` attribute keys, known ones (tenant_id, key) first.

    New keys are numbered by their first event; an event with a key beyond the limit is rejected. Only distinct keys are
    ordered, not events.
    """
    used = events.select("tenant_id", F.explode(F.map_keys(attributes)).alias("key"), F.col(order).alias("o")).groupBy("tenant_id", "key").agg(F.min("o").alias("o"))
    fresh = used.join(known.select("tenant_id", "key"), ["tenant_id", "key"], "left_anti")
    before = known.groupBy("tenant_id").agg(F.countDistinct("key").alias("had"))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("o", "key"))
    over = fresh.withColumn("place", place).join(before, "tenant_id", "left").where(F.col("place") + F.coalesce("had", F.lit(0)) > most)
    beyond = over.groupBy("tenant_id").agg(F.min("o").alias("__from"), F.collect_set("key").alias("__keys"))
    judged = events.join(beyond, "tenant_id", "left")
    bad = F.coalesce((F.col(order) >= F.col("__from")) & F.arrays_overlap(F.map_keys(attributes), "__keys"), F.lit(False))
    judged = judged.withColumn("reason", F.when(bad, "KeyCardinality")).drop("__from", "__keys")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def within_quota(events: DataFrame, size: Column, per_second: int = EVENTS_A_SECOND, bytes_per_second: int = BYTES_A_SECOND, order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason QuotaEvents or QuotaBytes): by tenant and second of observed_time, in order; nothing is queued."""
    w = Window.partitionBy("tenant_id", F.floor(F.col("observed_time") / 1000)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumns({"__n": F.count("*").over(w), "__bytes": F.sum(size).over(w)})
    reason = F.when(F.col("__n") > per_second, "QuotaEvents").when(F.col("__bytes") > bytes_per_second, "QuotaBytes")
    judged = counted.withColumn("reason", reason).drop("__n", "__bytes")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def gauntlet(events: DataFrame, known: DataFrame | None = None, size: Column | None = None, per_second: int = EVENTS_A_SECOND, bytes_per_second: int = BYTES_A_SECOND) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason and stage): schema and skew, then attribute keys, then quotas; each stage sees what the last accepted."""
    accepted, rejected = admit(events)
    out = [rejected.withColumn("stage", F.when(F.col("reason").like("Too%"), "skew").otherwise("schema"))]
    if known is not None:
        accepted, rejected = new_keys(accepted, known)
        out.append(rejected.withColumn("stage", F.lit("keys")))
    if size is not None:
        accepted, rejected = within_quota(accepted, size, per_second, bytes_per_second)
        out.append(rejected.withColumn("stage", F.lit("quota")))
    dead = out[0]
    for x in out[1:]:
        dead = dead.unionByName(x)
    return accepted, dead


def merged_parts(parts: DataFrame, tombstones: DataFrame, key: str = "event_id", time: str = "event_time") -> DataFrame:
    """A full merge: tombstones are applied, then one version of each event is kept."""
    return latest(without(parts, tombstones, key), key, time)


def partition_of(tenant: Column, event_time: Column, buckets: int = 16) -> tuple[Column, Column]:
    """(tenant_bucket, day): what events are partitioned by, so that a tenant's query reads one bucket."""
    digest = F.conv(F.substring(F.sha2(tenant.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return (digest % buckets).cast("int"), day_window(event_time)


def routed(events: DataFrame, shards: int, tenant: str = "tenant_id") -> DataFrame:
    """events with shard, that of their tenant's bucket."""
    return events.withColumn("shard", partition_of(F.col(tenant), F.lit(0))[0] % shards)
