"""Queries over the driver's tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.engine import Engine
from plumbago.operators import events as ev
from plumbago.operators import memory, semantic, vectors
from plumbago.plans import event_sql
from plumbago.plans.ir import BIGINT, TEXT, Catalog, Field
from plumbago.plans.lower import WEIGHT
from plumbago.sources import external
from plumbago.sources.tables import load
from plumbago.streaming.standing import Standing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# The SQL dialect.

#: name: (tables, text in the dialect, DuckDB SQL where it differs).
DIALECT: dict[str, tuple[str, str, str | None]] = {
    "nation_orders": (
        "customer orders nation",
        """SELECT n.n_name AS nation, COUNT(*) AS n, SUM(o.o_orderkey) AS s FROM orders AS o
        JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey
        WHERE o.o_orderstatus <> 'P' GROUP BY n.n_name HAVING n > 10""",
        """SELECT n.n_name AS nation, COUNT(*) AS n, SUM(o.o_orderkey)::BIGINT AS s FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE o.o_orderstatus <> 'P' GROUP BY n.n_name HAVING COUNT(*) > 10""",
    ),
    "filter_project_3vl": (
        "orders",
        """SELECT o_orderkey AS k, (o_orderkey - 7000) / 7 AS q, (o_orderkey - 7000) % 7 AS r, CASE WHEN o_custkey > 500 THEN o_orderstatus END AS st
        FROM orders WHERE NOT (o_custkey = 5 OR o_orderstatus = 'F') AND (o_orderkey * 3 + 1 > 100 OR CASE WHEN o_custkey > 10 THEN o_orderkey END IS NULL)""",
        """SELECT o_orderkey AS k, (o_orderkey - 7000) // 7 AS q, (o_orderkey - 7000) % 7 AS r, CASE WHEN o_custkey > 500 THEN o_orderstatus END AS st
        FROM orders WHERE NOT (o_custkey = 5 OR o_orderstatus = 'F') AND (o_orderkey * 3 + 1 > 100 OR CASE WHEN o_custkey > 10 THEN o_orderkey END IS NULL)""",
    ),
    "equi_join_multi": (
        "customer orders nation region",
        """SELECT r.r_name AS region, n.n_name AS nation, o.o_orderpriority AS priority, o.o_orderkey AS k FROM orders AS o
        JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey
        JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'O'""",
        None,
    ),
    "self_join": (
        "nation",
        """SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey""",
        None,
    ),
    "group_having": (
        "lineitem",
        """SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n, SUM(l_partkey) AS total, AVG(l_suppkey) AS mean, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi
        FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING n > 1""",
        """SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n, SUM(l_partkey)::BIGINT AS total, SUM(l_suppkey)::DOUBLE / COUNT(l_suppkey) AS mean, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi
        FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""",
    ),
    "group_null_keys": (
        "orders",
        """SELECT CASE WHEN o_custkey > 100 THEN o_orderstatus END AS k, COUNT(*) AS n, COUNT(CASE WHEN o_custkey < 50 THEN o_custkey END) AS few, MAX(o_orderpriority) AS p
        FROM orders GROUP BY CASE WHEN o_custkey > 100 THEN o_orderstatus END""",
        None,
    ),
    "grand_total_empty": (
        "lineitem",
        "SELECT COUNT(*) AS n, SUM(l_partkey) AS s, AVG(l_partkey) AS a, MIN(l_returnflag) AS lo FROM lineitem WHERE l_orderkey < 0",
        "SELECT COUNT(*) AS n, SUM(l_partkey)::BIGINT AS s, AVG(l_partkey)::DOUBLE AS a, MIN(l_returnflag) AS lo FROM lineitem WHERE l_orderkey < 0",
    ),
    "distinct_rows": ("lineitem", "SELECT DISTINCT l_suppkey AS supplier, l_returnflag AS flag FROM lineitem", None),
    "filter_sum": (
        "lineitem",
        "SELECT SUM(l_partkey) AS total FROM lineitem WHERE l_orderkey > 0",
        "SELECT SUM(l_partkey)::BIGINT AS total FROM lineitem WHERE l_orderkey > 0",
    ),
}


def _in_dialect(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine()
        for t in tables.split():
            engine.table(t, load(spark, sf_dir, t))
        return engine.query(text)

    return run


for _name, (_tables, _text, _sql) in DIALECT.items():
    QUERIES[_name], ORACLE_SQL[_name] = _in_dialect(_tables, _text), _sql or _text


# Standing queries: the final answer is that of the final tables.

_ORDERS = [Field("o_orderkey", BIGINT), Field("o_custkey", BIGINT), Field("o_orderstatus", TEXT)]
_CUSTOMER = [Field("c_custkey", BIGINT), Field("c_nationkey", BIGINT)]
_CUSTOMERS_ORDERS = "SELECT c.c_nationkey AS nation, o.o_orderstatus AS status FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey"
_BY_NATION = "SELECT c.c_nationkey AS nation, COUNT(*) AS n, SUM(o.o_orderkey) AS s, MAX(o.o_orderkey) AS hi FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey"


def _epochs(spark: SparkSession, sf_dir: str, text: str) -> Standing:
    """First the orders of status F and O, from two sources; then P comes and F goes."""
    catalog = Catalog()
    catalog.declare("orders", _ORDERS)
    catalog.declare("customer", _CUSTOMER)
    s, orders = Standing(spark, catalog), load(spark, sf_dir, "orders")
    s.append("a", "customer", load(spark, sf_dir, "customer"))
    s.append("a", "orders", orders.where("o_orderstatus = 'F'"), token="one")
    s.append("b", "orders", orders.where("o_orderstatus = 'O'"), token="one")
    s.seal()
    s.register("q", text)
    s.append("a", "orders", orders.where("o_orderstatus = 'P'"))
    s.append("a", "orders", orders.where("o_orderstatus = 'F'").withColumn(WEIGHT, F.lit(-1)))
    s.seal()
    return s


@registered("SELECT c_nationkey::BIGINT AS nation, o_orderstatus AS status, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY ALL")
def delta_join_equals_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(spark, sf_dir, _CUSTOMERS_ORDERS).read("q").withColumnRenamed(WEIGHT, "n")


@registered("SELECT c_nationkey::BIGINT AS nation, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS s, MAX(o_orderkey) AS hi FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY ALL")
def delta_agg_equals_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(spark, sf_dir, _BY_NATION).read("q").drop(WEIGHT)


@registered(
    """WITH a AS (SELECT c_nationkey::BIGINT AS nation, o_orderstatus AS st, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey),
    x AS (SELECT nation, COUNT(*) AS n, SUM(k)::BIGINT AS s, MAX(k) AS hi FROM a WHERE st <> 'P' GROUP BY ALL),
    y AS (SELECT nation, COUNT(*) AS n, SUM(k)::BIGINT AS s, MAX(k) AS hi FROM a WHERE st <> 'F' GROUP BY ALL)
    SELECT *, -1::BIGINT AS weight FROM (FROM x EXCEPT FROM y) UNION ALL SELECT *, 1::BIGINT FROM (FROM y EXCEPT FROM x)"""
)
def answer_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(spark, sf_dir, _BY_NATION).changes("q", 1).drop("__epoch").withColumnRenamed(WEIGHT, "weight")


@registered("SELECT c_nationkey::BIGINT AS nation, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS s, MAX(o_orderkey) AS hi FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY ALL")
def retract_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _epochs(spark, sf_dir, _BY_NATION)
    s.retract_source("b", "orders")
    return s.read("q").drop(WEIGHT)


# Events.

_EVENTS_SQL = "SELECT event_id, user_id AS tenant_id, epoch_us(ts) // 1000 AS event_time, event_type AS event_name, value AS cost, event_type = 'error' AS error FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))")
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("tenant_id"), ms.alias("event_time"), F.col("event_type").alias("event_name"), F.col("value").alias("cost"), (F.col("event_type") == "error").alias("error"))


_PAGE = "SELECT event_id, tenant_id, cost FROM ({}) WHERE error AND cost >= 10 {} ORDER BY event_id LIMIT 10"


@registered(_PAGE.format(_EVENTS_SQL, ""))
def event_scalar_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.page(_events(spark, sf_dir), F.col("error") & (F.col("cost") >= 10)).select("event_id", "tenant_id", "cost")


@registered(_PAGE.format(_EVENTS_SQL, "AND event_id > 100"))
def event_keyset_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.page(_events(spark, sf_dir), F.col("error") & (F.col("cost") >= 10), after=(0.0, 100)).select("event_id", "tenant_id", "cost")


@registered(f"SELECT event_name, error::VARCHAR AS error, COUNT(*) AS n, ROUND(SUM(cost), 2) AS total, ROUND(AVG(cost), 6) AS mean, MIN(event_time) AS first, MAX(event_time) AS last FROM ({_EVENTS_SQL}) GROUP BY ALL")
def event_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.group(_events(spark, sf_dir), ["event_name", "error"], {"n": ("count", None), "total": ("sum", "cost"), "mean": ("avg", "cost"), "first": ("min", "event_time"), "last": ("max", "event_time")})
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@registered(f"SELECT event_name, event_time - event_time % 86400000 AS day, COUNT(*) AS n FROM ({_EVENTS_SQL}) GROUP BY ALL")
def event_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_name", ev.day_window(F.col("event_time")).alias("day")).agg(F.count("*").alias("n"))


@registered(f"SELECT event_id, event_time, cost FROM (SELECT event_id, event_time + 60000 AS event_time, cost + 1 AS cost FROM ({_EVENTS_SQL}) WHERE error UNION ALL SELECT event_id, event_time, cost FROM ({_EVENTS_SQL}) WHERE NOT error)")
def dedup_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, and a later version of each error."""
    e = _events(spark, sf_dir).select("event_id", "event_time", "cost", "error")
    later = e.where("error").withColumns({"event_time": F.col("event_time") + 60_000, "cost": F.col("cost") + 1})
    return ev.latest(e.unionByName(later)).select("event_id", "event_time", "cost")


@registered(
    f"""SELECT event_id, CASE WHEN event_time < seen - 604800000 THEN 'TooOld' ELSE 'TooNew' END AS reason
    FROM (SELECT event_id, event_time, (SELECT max(event_time) FROM ({_EVENTS_SQL})) - 864000000 AS seen FROM ({_EVENTS_SQL})) WHERE event_time < seen - 604800000 OR event_time > seen + 3600000"""
)
def skew_deadletter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as if all were observed ten days before the last."""
    e = _events(spark, sf_dir)
    seen = e.agg(F.max("event_time")).first()[0]
    return ev.admit(e.withColumn("observed_time", F.lit(seen - 10 * ev.DAY)))[1].select("event_id", "reason")


@registered("SELECT event_id, user_id AS tenant_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.interleaved(_events(spark, sf_dir)).select("event_id", "tenant_id", "turn")


@registered("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return ev.without(e, e.where("error")).select("event_id")


# Vectors.

_COS = "list_dot_product(embedding::DOUBLE[], {0}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product({0}, {0}))"
_AT = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
_SCORED = "SELECT vec_id, label, " + _COS.format("q") + " AS score FROM embeddings, (SELECT " + _AT + " AS q)"


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def _anchors(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    return [r[0] for r in load(spark, sf_dir, "embeddings").where("vec_id < 8").orderBy("vec_id").select("embedding").collect()]


@registered(f"SELECT vec_id, ROUND(score, 6) AS score FROM ({_SCORED.format(0)}) ORDER BY score DESC, vec_id LIMIT 10")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0)).select("vec_id", F.round("score", 6).alias("score"))


@registered(f"SELECT vec_id, ROUND(score, 6) AS score FROM ({_SCORED.format(0)}) WHERE score >= 0.2")
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.within(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 0.2).select("vec_id", F.round("score", 6).alias("score"))


_RANKED = "SELECT vec_id, ROW_NUMBER() OVER (ORDER BY score DESC, vec_id) AS r FROM ({})"


@registered(
    f"""SELECT vec_id, ROUND(SUM(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM ({_RANKED.format(_SCORED.format(0))}) WHERE r <= 50
    UNION ALL SELECT * FROM ({_RANKED.format(_SCORED.format(1))}) WHERE r <= 50) GROUP BY vec_id ORDER BY SUM(1.0::DOUBLE / (60 + r)) DESC, vec_id LIMIT 10"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    found = [vectors.top_k(e, _vector(spark, sf_dir, n), 50) for n in (0, 1)]
    return vectors.fused(found, 10).select("vec_id", F.round("score", 6).alias("score"))


_ANCHORED = "SELECT e.vec_id, a.vec_id AS g, " + _COS.replace("embedding", "e.embedding").format("a.embedding::DOUBLE[]") + " AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 8) a"


@registered(f"SELECT vec_id, ROUND(1 - MAX(score), 6) + 0.0 AS novelty FROM ({_ANCHORED}) GROUP BY vec_id")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.novelty(load(spark, sf_dir, "embeddings"), _anchors(spark, sf_dir)).select("vec_id", (F.round("novelty", 6) + 0.0).alias("novelty"))


@registered(f"SELECT g AS group_id, COUNT(*) AS members, FIRST(vec_id ORDER BY score DESC, vec_id) AS exemplar FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY score DESC, g) AS r FROM ({_ANCHORED})) WHERE r = 1 GROUP BY g")
def standing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(load(spark, sf_dir, "embeddings"), _anchors(spark, sf_dir))


# Branches, provenance, claims, policy, retrieval.


@registered("WITH RECURSIVE t AS (SELECT o_orderkey AS node FROM orders WHERE o_custkey = 7 UNION SELECT o_orderkey FROM orders JOIN t ON o_orderkey // 2 = node AND o_orderkey > 0) SELECT node FROM t")
def taint_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order derives from the order of half its key; customer 7's orders are tainted."""
    orders = load(spark, sf_dir, "orders")
    edges = orders.where("o_orderkey > 0").select(F.expr("o_orderkey div 2").alias("parent"), F.col("o_orderkey").alias("child"))
    return memory.tainted(orders.where("o_custkey = 7").select(F.col("o_orderkey").alias("node")), edges).select("node")


@registered("SELECT o_orderkey AS k, o_orderstatus AS branch FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'O' AND year(o_orderdate) <= 1997 OR o_orderstatus = 'F' AND year(o_orderdate) <= 1995")
def fork_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch P forked from O in 1997, which had forked from F in 1995."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("branch"), F.year("o_orderdate").alias("epoch"))
    return rows.where(memory.visible("P", [memory.Fork("P", "O", 1997), memory.Fork("O", "F", 1995)])).select("k", "branch")


@registered(
    """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN o_custkey + u ELSE o_custkey + 1 * s + u END AS v
    FROM (SELECT *, (o_orderstatus = 'O')::BIGINT AS s, CASE WHEN o_orderpriority = '1-URGENT' THEN 10 ELSE 0 END AS u FROM orders)"""
)
def merge3_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source adds one to O and deletes P; the target adds ten to what is urgent."""
    base = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), "o_orderstatus", "o_orderpriority")
    source = base.where("o_orderstatus <> 'P'").withColumn("v", F.col("v") + (F.col("o_orderstatus") == "O").cast("long"))
    target = base.withColumn("v", F.col("v") + F.when(F.col("o_orderpriority") == "1-URGENT", 10).otherwise(0))
    return memory.merge_counters(base, source, target, "k", "v").select("k", "v")


@registered("SELECT o_custkey AS subject, max(o_orderkey) AS seq FROM orders WHERE epoch_ms(o_orderdate) <= 852076800000 AND 852076800000 < epoch_ms(o_orderdate) + 31536000000 GROUP BY ALL")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order is a claim for a year; the last by key that held at the start of 1997."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', CAST(o_orderdate AS TIMESTAMP_NTZ))")
    claims = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("seq"), ms.alias("valid_from"), (ms + 31_536_000_000).alias("valid_to"), ms.alias("known_from"), F.lit(None).cast("long").alias("known_to"))
    return memory.as_of(claims, ["subject"], 852_076_800_000, 852_076_800_000).select("subject", "seq")


@registered("SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '5-%' THEN 'Deny' WHEN o_orderstatus = 'O' OR o_orderpriority LIKE '%URGENT' THEN 'Allow' ELSE 'Deny' END AS decision FROM orders")
def policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("actor"), F.col("o_orderstatus").alias("action"), F.lit("order").alias("resource"))
    rules = [memory.Rule("Allow", action="O"), memory.Rule("Allow", actor="*URGENT"), memory.Rule("Deny", actor="5-*", resource="ord*")]
    return memory.decided(requests, rules).select("k", "decision")


@registered("SELECT doc_id, (contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'eau')::INT + contains(lower(coalesce(text, '')), 'license')::INT) / 3.0::DOUBLE * CASE WHEN lang = 'fr' THEN 0.25 ELSE 1 END AS score FROM documents")
def retrieval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return memory.retrieved(docs, ["the", "EAU", "license"], stale=F.coalesce(F.col("lang") == "fr", F.lit(False))).select("doc_id", "score")


# Standing state: errors that go with their data, snapshots, shared plans.

_QUOTIENTS = "SELECT o_orderkey AS k, 1000 / (o_custkey - 7) AS q FROM orders"


def _quotients(spark: SparkSession, sf_dir: str) -> Standing:
    catalog = Catalog()
    catalog.declare("orders", _ORDERS)
    s = Standing(spark, catalog)
    s.register("q", _QUOTIENTS)
    s.append("a", "orders", load(spark, sf_dir, "orders"), token="one")
    s.seal()
    return s


@registered("SELECT CASE WHEN COUNT(*) > 0 THEN 'DivisionByZero: /' END AS error FROM orders WHERE o_custkey = 7")
def live_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_quotients(spark, sf_dir).error("q"),)], "error string")


@registered("SELECT o_orderkey AS k, 1000 // (o_custkey - 7) AS q FROM orders WHERE o_custkey <> 7")
def live_error_retracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _quotients(spark, sf_dir)
    s.retract_source("a", "orders", "o_custkey = 7")
    return s.read("q").drop(WEIGHT)


@registered("SELECT o_orderkey, o_custkey, o_orderstatus, 1::BIGINT AS weight FROM orders WHERE o_orderstatus <> 'F'")
def snapshot_equals_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder is compacted, opened again and hydrated."""
    s = _epochs(spark, sf_dir, _BY_NATION)
    s.compact()
    return Standing.open(spark, s.path).hydrated()["orders"].withColumnRenamed(WEIGHT, "weight")


@registered("SELECT o_orderkey, o_custkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END::BIGINT AS weight FROM orders WHERE o_orderstatus IN ('P', 'F')")
def log_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second epoch brought."""
    return _epochs(spark, sf_dir, _BY_NATION).epochs("orders", 1).drop("__epoch", "__source").withColumnRenamed(WEIGHT, "weight")


for _name, (_tables, _text, _sql) in {
    "typed_null": ("orders", "SELECT o_orderkey AS k, CASE WHEN o_custkey > 100 THEN o_orderkey ELSE CAST(NULL AS BIGINT) END AS v, CAST(NULL AS TEXT) AS t FROM orders", "SELECT o_orderkey AS k, CASE WHEN o_custkey > 100 THEN o_orderkey END AS v, NULL::VARCHAR AS t FROM orders"),
    "kleene_logic": ("orders", "SELECT o_orderkey AS k, CASE WHEN o_custkey > 100 THEN o_custkey END > 500 OR o_orderkey > 50 AS a, CASE WHEN o_custkey > 100 THEN o_custkey END > 500 AND o_orderkey > 50 AS b FROM orders", None),
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _in_dialect(_tables, _text), _sql or _text


# Event SQL.


def _event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = load(spark, sf_dir, "events").select("event_id", F.call_function("parse_json", F.col("props")).alias("attributes"))
    return _events(spark, sf_dir).join(props, "event_id")


def _event_sql(text: str, sql: str, name: str, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return event_sql.run(_event_table(spark, sf_dir) if "attributes" in text else _events(spark, sf_dir), text, **how)

    QUERIES[name], ORACLE_SQL[name] = run, sql


_K = "TRY_CAST(props ->> 'k' AS DOUBLE)"
_FULL = _EVENTS_SQL.replace(" FROM events", ", props FROM events")
_event_sql("SELECT event_id, cost FROM events WHERE error AND cost >= 10 AND event_time >= 1704153600000 ORDER BY score DESC, event_id ASC LIMIT 20", f"SELECT event_id, cost FROM ({_EVENTS_SQL}) WHERE error AND cost >= 10 AND event_time >= 1704153600000 ORDER BY event_id LIMIT 20", "event_sql_page")
_event_sql("SELECT event_name, count(*) AS n, min(event_time) AS first, max(cost) AS most FROM events WHERE NOT error OR cost < 5 GROUP BY event_name", f"SELECT event_name, COUNT(*) AS n, MIN(event_time) AS first, MAX(cost) AS most FROM ({_EVENTS_SQL}) WHERE NOT error OR cost < 5 GROUP BY ALL", "event_sql_group")
_event_sql("SELECT event_id, event_name FROM events WHERE event_name IN ('signup', 'error', NULL) AND NOT tenant_id IN (1, 2) LIMIT 1000", f"SELECT event_id, event_name FROM ({_EVENTS_SQL}) WHERE event_name IN ('signup', 'error') AND tenant_id NOT IN (1, 2) ORDER BY event_id LIMIT 1000", "event_in_list")
_event_sql("SELECT event_id, attributes['k'] AS k FROM events WHERE attributes['k'] > 90.5 AND NOT attributes['missing'] = 'x' OR attributes['k'] = 3 LIMIT 500", f"SELECT event_id, props ->> 'k' AS k FROM ({_FULL}) WHERE {_K} = 3 ORDER BY event_id LIMIT 500", "event_attribute")
_event_sql("SELECT count(*) AS n FROM events WHERE cost > 1 AND (attributes['k'] <= 50 OR attributes['k'] = 'fifty' OR event_name > 5)", f"SELECT COUNT(*) AS n FROM ({_FULL}) WHERE cost > 1 AND {_K} <= 50", "event_mixed_compare")
_event_sql("SELECT event_id FROM events WHERE error LIMIT 7", f"SELECT event_id FROM ({_EVENTS_SQL}) WHERE error AND tenant_id = 3 ORDER BY event_id LIMIT 7", "event_session_tenant", tenant=3)


@registered(f"SELECT event_id, cost FROM ({_EVENTS_SQL}) WHERE error ORDER BY event_id LIMIT 5 OFFSET 5")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, by the token of the first's last row."""
    plan, rows = event_sql.parse("SELECT event_id, cost FROM events WHERE error LIMIT 5"), _events(spark, sf_dir)
    last = event_sql.run(rows, plan).collect()[-1]
    return event_sql.run(rows, plan, snapshot=sf_dir, token=event_sql.cursor(plan, sf_dir, 0.0, last.event_id))


# Admission.


@registered(f"SELECT event_id, CASE WHEN copy = 0 THEN 'first' WHEN error THEN 'IdempotencyConflict' ELSE 'replay' END AS verdict, copy FROM ({_EVENTS_SQL}), (SELECT unnest([0, 1]) AS copy)")
def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes again; errors come with another cost."""
    e = _events(spark, sf_dir).withColumn("copy", F.lit(0))
    again = e.withColumns({"copy": F.lit(1), "cost": F.when(F.col("error"), F.col("cost") + 1).otherwise(F.col("cost"))})
    return ev.idempotent(e.unionByName(again), ["tenant_id", "event_id"], ["event_time", "event_name", "cost"], "copy").select("event_id", "verdict", "copy")


@registered("SELECT doc_id, CASE WHEN doc_id >= 50 THEN text END AS body FROM documents")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.col("doc_id").alias("event_time"))
    return ev.redacted(docs, 50).drop("event_time")


_ADMITTED = f"SELECT event_id, tenant_id, event_time, event_time // 86400000 AS second FROM ({_EVENTS_SQL})"


@registered(f"SELECT event_id, CASE WHEN r > 5 THEN 'QuotaEvents' ELSE 'QuotaBytes' END AS reason FROM (SELECT event_id, ROW_NUMBER() OVER w AS r FROM ({_ADMITTED}) WINDOW w AS (PARTITION BY tenant_id, second ORDER BY event_id)) WHERE r > 3")
def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day counts as a second: five events a tenant, and 300 bytes at 100 each."""
    e = _events(spark, sf_dir).withColumn("observed_time", F.expr("event_time div 86400000 * 1000"))
    return ev.within_quota(e, F.lit(100), 5, 300)[1].select("event_id", "reason")


@registered(
    f"""WITH k AS (SELECT tenant_id, props ->> 'k' AS k, min(event_id) AS o FROM ({_FULL}) GROUP BY ALL),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY o, k) AS r FROM k)
    SELECT event_id, 'KeyCardinality' AS reason FROM ({_FULL}) e JOIN o ON o.tenant_id = e.tenant_id AND o.k = e.props ->> 'k' WHERE r > 20"""
)
def key_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each event's property stands for an attribute key; a tenant may use twenty."""
    e = _events(spark, sf_dir).join(load(spark, sf_dir, "events").select("event_id", F.create_map(F.get_json_object("props", "$.k"), F.lit("")).alias("attributes")), "event_id")
    known = spark.createDataFrame([], "tenant_id bigint, key string")
    return ev.new_keys(e, known, most=20)[1].select("event_id", "reason")


@registered(f"SELECT event_id, 'MissingTenant' AS reason, 'schema' AS stage FROM ({_EVENTS_SQL}) WHERE tenant_id = 1 UNION ALL SELECT event_id, 'TooOld', 'skew' FROM ({_EVENTS_SQL}) WHERE tenant_id = 2")
def gauntlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("observed_time", F.col("event_time") + F.when(F.col("tenant_id") == 2, 8 * ev.DAY).otherwise(0))
    return ev.gauntlet(e.withColumn("tenant_id", F.when(F.col("tenant_id") != 1, F.col("tenant_id"))), size=F.lit(1))[1].select("event_id", "reason", "stage")


# Semantic operators.


@registered("SELECT vec_id, ROUND(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS d FROM embeddings")
def l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.l2_sq(F.col("embedding"), _vector(spark, sf_dir, 0)), 6).alias("d"))


@registered()
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nearest to a text, by hash embeddings."""
    docs = semantic.with_embedding(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return vectors.top_k(docs, semantic.embed("the quiet river and the old house"), 10, "doc_id").select("doc_id", "score")


@registered()
def semantic_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event SQL with a similarity, documents standing for events."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("source").alias("event_name"), F.col("text").alias("body"), F.col("n_chars").alias("event_time"))
    return event_sql.run(docs, "SELECT event_id, event_name, score FROM events WHERE event_time > 500 AND embedding ≈≈ 'an old house by the river' LIMIT 5", embed=semantic.embed, embedded=semantic.with_embedding)


@registered()
def semantic_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.clusters(load(spark, sf_dir, "embeddings"), 8)


@registered()
def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors that those of labels 0 to 4 do not reach."""
    e = load(spark, sf_dir, "embeddings")
    return semantic.difference(e.where("label < 5"), e, 8)


@registered()
def novelty_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return semantic.against(e, semantic.baseline(e.where("label < 5")), ["label"])


@registered()
def ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.search(semantic.index(load(spark, sf_dir, "embeddings")), _vector(spark, sf_dir, 0))


@registered()
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 3)
    return semantic.recall(semantic.search(semantic.index(e), q), vectors.top_k(e, q))


@registered()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.stratified(_events(spark, sf_dir), "event_name", 100).select("event_id", "event_name")


@registered(f"SELECT g AS group_id, COUNT(*) AS members, ROUND(AVG(label), 6) AS avg_cost, ROUND(AVG((label > 5)::INT), 6) AS error_rate, FIRST(vec_id ORDER BY score DESC, vec_id) AS exemplar FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY score DESC, g) AS r FROM ({_ANCHORED.replace('e.vec_id,', 'e.vec_id, e.label,')})) WHERE r = 1 GROUP BY g")
def standing_group_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").withColumns({"cost": F.col("label").cast("double"), "bad": F.col("label") > 5})
    out = semantic.standing_groups(e, _anchors(spark, sf_dir), cost="cost", error="bad")
    return out.withColumns({"avg_cost": F.round("avg_cost", 6), "error_rate": F.round("error_rate", 6)})


@registered(f"SELECT vec_id, ROUND(score, 6) AS score FROM ({_SCORED.format(0)}) WHERE vec_id % 7 <> 3 ORDER BY score DESC, vec_id LIMIT 10")
def standing_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint halves are merged, then every seventh vector is taken back."""
    e, q = load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0)
    state = semantic.StandingTopK(e.where("vec_id % 2 = 0"), q, 10)
    state.merge(semantic.StandingTopK(e.where("vec_id % 2 = 1"), q, 10))
    state.retract(e.where("vec_id % 7 = 3"))
    return state.answer.withColumn("score", F.round("score", 6))


# Typed merges, lineage, taint, budgets.


@registered("SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderkey) FILTER (o_orderstatus <> 'P' OR o_orderkey % 2 = 0))) AS v FROM orders GROUP BY ALL HAVING v IS NOT NULL AND len(v) > 0")
def merge3_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's set of orders: the source adds O, the target adds even P, to what F there is."""
    o = load(spark, sf_dir, "orders")
    sets = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderkey").alias("v"))
    f, p = "o_orderstatus = 'F'", "(o_orderstatus = 'P' and o_orderkey % 2 = 0)"
    return memory.merge_sets(sets(f), sets(f"{f} or o_orderstatus = 'O'"), sets(f"{f} or {p}"), "k", "v").select("k", "v")


@registered(
    """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'target' WHEN o_orderkey % 3 = 0 THEN 'source' WHEN o_custkey % 2 = 0 THEN 'source' ELSE 'target' END AS winner,
    CASE WHEN o_orderstatus = 'F' THEN 'target' ELSE CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 2 = 1 AND o_custkey % 4 = 1 THEN 'conflict' ELSE 'both' END END AS how FROM orders"""
)
def merge3_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F moved in the target alone; every third order's source claim starts after the target's has ended; methods decide the rest."""
    o = load(spark, sf_dir, "orders")
    claim = lambda who, start, end, method: F.struct(F.lit(who).alias("who"), start.cast("long").alias("start"), end.cast("long").alias("end"), method.alias("method"), F.lit(0.5).alias("confidence"))
    third, odd = F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 2 == 1
    base = claim("base", F.lit(0), F.lit(10), F.lit("stated"))
    source = F.when(F.col("o_orderstatus") == "F", base).otherwise(claim("source", F.when(third, 20).otherwise(5), F.lit(30), F.when(odd, "stated").otherwise("verified")))
    target = claim("target", F.lit(0), F.lit(10), F.when(F.col("o_custkey") % 4 == 3, "verified").otherwise("stated"))
    side = lambda c: o.select(F.col("o_orderkey").alias("k"), c.alias("v"))
    return memory.merge_claims(side(base), side(source), side(target), "k", "v").select("k", F.col("v.who").alias("winner"), "how")


@registered("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) > 1996 AND o_orderkey % 5 <> 0")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("epoch"), "o_orderstatus")
    return memory.divergence(o.where("o_orderstatus = 'O'"), 1996, o.where("k % 5 = 0"), "k").select("k")


@registered("SELECT o_orderkey AS page, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'both' WHEN o_orderstatus = 'O' THEN 'source' ELSE 'target' END AS side FROM orders WHERE o_orderstatus = 'O' OR o_custkey % 2 = 0")
def page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    side = lambda c: o.select(F.col("o_orderkey").alias("page"), c.alias("h"))
    base = F.xxhash64("o_orderkey")
    return memory.page_diff(side(base), side(F.when(F.col("o_orderstatus") == "O", base.bitwiseXOR(F.lit(1))).otherwise(base)), side(F.when(F.col("o_custkey") % 2 == 0, base.bitwiseXOR(F.lit(2))).otherwise(base)), "page", "h")


@registered("SELECT n_name AS child, r_name AS parent, n_nationkey::BIGINT AS at_epoch, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 100 END::BIGINT AS rewound_to, n_nationkey % 3 <> 0 AS active FROM nation JOIN region ON n_regionkey = r_regionkey")
def lineage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is forked from its region; every third one is rewound twice."""
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda at, kind, seq: n.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), at.cast("long").alias("at_epoch"), F.lit(kind).alias("kind"), F.lit(seq).alias("seq"), "n_nationkey")
    k = F.col("n_nationkey")
    log = row(k, "fork", 0).unionByName(row(k + 50, "rewind", 1).where("n_nationkey % 3 = 0")).unionByName(row(k + 100, "rewind", 2).where("n_nationkey % 3 = 0"))
    return memory.lineage(log)


_TAINTED = "WITH RECURSIVE t AS (SELECT o_orderkey AS node FROM orders WHERE o_custkey = 7 UNION SELECT o_orderkey FROM orders JOIN t ON o_orderkey // 2 = node AND o_orderkey > 0)"


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    edges = orders.where("o_orderkey > 0").select(F.expr("o_orderkey div 2").alias("parent"), F.col("o_orderkey").alias("child"))
    return memory.tainted(orders.where("o_custkey = 7").select(F.col("o_orderkey").alias("node")), edges)


@registered(f"{_TAINTED} SELECT o_orderkey AS node, CASE WHEN o_orderstatus = 'O' AND o_orderkey IN (FROM t) THEN 'Stale' WHEN o_orderstatus = 'O' THEN 'Asserted' ELSE 'Observed' END AS status FROM orders")
def mark_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_claim = F.col("o_orderstatus") == "O"
    claims = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.when(is_claim, "claim").otherwise("observation").alias("kind"), F.when(is_claim, "Asserted").otherwise("Observed").alias("status"))
    return memory.mark_stale(claims, _closure(spark, sf_dir)).select("node", "status")


@registered(f"{_TAINTED} SELECT COUNT(*) FILTER (o_orderkey NOT IN (FROM t)) AS entries, COUNT(*) FILTER (o_orderkey IN (FROM t)) AS invalidated FROM orders")
def forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.lit("Asserted").alias("status"))
    left, claims = memory.forget(o, o, _closure(spark, sf_dir))
    return left.agg(F.count("*").alias("entries")).crossJoin(claims.agg(F.sum((F.col("status") == "Invalidated").cast("long")).alias("invalidated")))


@registered(f"{_TAINTED} SELECT CASE WHEN o_orderstatus = 'O' THEN '1-irreversible' ELSE '2-healed' END AS section, o_orderkey AS node FROM orders WHERE o_orderkey IN (FROM t)")
def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_orderstatus", F.lit(False).alias("reversible"))
    return memory.recall_report(_closure(spark, sf_dir), o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'")).select("section", "node")


@registered(f"{_TAINTED} SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (FROM t)")
def taint_heals_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standing answer after the rows that derive from customer 7's orders are taken out."""
    orders = load(spark, sf_dir, "orders")
    catalog = Catalog()
    catalog.declare("orders", _ORDERS)
    s = Standing(spark, catalog)
    s.append("a", "orders", orders)
    s.seal()
    s.register("q", "SELECT o_orderkey AS k FROM orders")
    edges = orders.where("o_orderkey > 0").select(F.expr("o_orderkey div 2").alias("parent"), F.col("o_orderkey").alias("child"))
    memory.taint_and_heal(s, orders.where("o_custkey = 7").select(F.col("o_orderkey").alias("node")), edges, "orders", "o_orderkey", "a")
    return s.read("q").drop(WEIGHT)


@registered(
    """WITH RECURSIVE e AS (SELECT doc_id, greatest((octet_length(encode(coalesce(text, ''))) + 3) // 4, 1) AS c, ROW_NUMBER() OVER (ORDER BY n_chars % 97 DESC NULLS LAST, doc_id) AS r FROM documents),
    t AS (SELECT 0::BIGINT AS r, 5000::BIGINT AS room, NULL::BIGINT AS doc_id, 0::BIGINT AS c UNION ALL
          SELECT e.r, CASE WHEN e.c <= t.room THEN t.room - e.c ELSE t.room END, CASE WHEN e.c <= t.room THEN e.doc_id END, e.c FROM t JOIN e ON e.r = t.r + 1)
    SELECT doc_id AS key, c AS cost FROM t WHERE doc_id IS NOT NULL"""
)
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), memory.tokens(F.col("text")).alias("cost"), (F.col("n_chars") % 97).cast("double").alias("score"))
    return memory.packed(docs, 5000).select("key", "cost")


@registered("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('fr', 'es')")
def influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.influence(load(spark, sf_dir, "documents"), ["fr", "es"], "lang").select("doc_id")


@registered("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'Replay' WHEN o_custkey % 3 = 0 THEN 'NotEligible' WHEN o_orderpriority LIKE '5-%' THEN 'Denied' WHEN o_custkey % 2 = 0 THEN 'SimulationFailed' ELSE 'Proposed' END AS outcome FROM orders")
def action_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    requests = o.select(F.col("o_orderkey").alias("key"), F.lit("agent").alias("actor"), F.lit("ship").alias("action"), F.col("o_orderpriority").alias("resource"), F.lit("Asserted").alias("status"), F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("invoice"))).alias("evidence"), (F.col("o_custkey") % 2 == 1).alias("simulated"))
    rules = [memory.Rule("Allow", action="ship"), memory.Rule("Deny", resource="5-*")]
    return memory.gateway(requests, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), rules).select(F.col("key").alias("k"), "outcome")


@registered("SELECT o_custkey AS k, CASE MAX(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 4 END) WHEN 1 THEN 'VerifiedSystem' WHEN 2 THEN 'Human' ELSE 'Untrusted' END AS label FROM orders GROUP BY ALL")
def label_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "O", "VerifiedSystem").when(F.col("o_orderstatus") == "F", "Human").otherwise("Untrusted")
    each = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(label).alias("labels"))
    return each.select("k", memory.combined_label(F.col("labels")).alias("label"))


@registered("SELECT n_name AS node FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 2")
def active_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").collect()  # the lineage of branches is a small table: 25 rows here
    forks = [memory.Fork(r.n_name, str(r.n_regionkey), 0) for r in rows]
    gone = frozenset(r.n_name for r in rows if r.n_nationkey == 2)
    return spark.createDataFrame([(x,) for x in memory.descendants("1", forks, gone)], "node string")


@registered("SELECT role, doc_id AS row_key, 'conversation' AS source_system, conv_id::VARCHAR AS source_record FROM (SELECT DISTINCT role, conv_id * 1000 + turn AS doc_id, conv_id FROM conversations)")
def commit_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn cites its conversation."""
    c = load(spark, sf_dir, "conversations")
    commit = c.select(F.lit("t").alias("tenant"), F.col("role").alias("branch"), F.lit("turns").alias("table_name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_key"), F.array(F.struct(F.lit("conversation").alias("system"), F.col("conv_id").cast("string").alias("record"))).alias("sources"))
    return external.derivations(commit).select(F.col("branch").alias("role"), "row_key", "source_system", "source_record")
