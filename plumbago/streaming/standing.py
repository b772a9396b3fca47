"""Standing queries: a log of changes in epochs, and answers maintained from them.

Appends gather under the next epoch; seal makes them visible at once and moves
every registered answer, and the errors that the contents raise, by the change.
All state is in one folder that executors share: Parquet tables of the log by
epoch, of answers' changes and of errors, and a manifest an epoch that names
them and the appends' tokens. A manifest appears whole or not at all, so an
epoch is sealed or it is not; what a failed seal wrote is never read. A folder
can be opened again by another driver. compact() folds the log into snapshots.

Queries that are equal once bound are kept once, under all their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import pickle
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.errors import LiveError, Refused
from plumbago.plans.dialect import bind, parse
from plumbago.plans.ir import SPARK, Catalog, Field, Query
from plumbago.plans.lower import WEIGHT, Lowering, consolidated, negated
from plumbago.sources.tables import fresh_path, listed, read_text, remove, write_text

KEPT_EPOCHS = 256


class Standing:
    def __init__(self, spark: SparkSession, catalog: Catalog, path: str | None = None):
        self.spark, self.catalog, self.path = spark, catalog, path or fresh_path(spark, "standing")
        if "://" not in self.path and not self.path.startswith("file:"):
            self.path = f"file://{self.path}"
        #: handle -> id of its query; id -> query, (epoch, folder) of the base, changes since, and errors.
        self.names: dict[str, str] = {}
        self.queries: dict[str, Query] = {}
        self.bases: dict[str, tuple[int, str]] = {}
        self.moves: dict[str, list[tuple[int, str]]] = {}
        self.errors: dict[str, list[str]] = {}
        self.snapshots: dict[str, tuple[int, str]] = {}
        self.log: dict[str, list[tuple[int, str]]] = {t: [] for t in catalog.tables}
        self.tokens: dict[tuple[str, str], tuple] = {}
        self.pending: dict[str, list[str]] = {}
        self.pending_tokens: dict[tuple[str, str], tuple] = {}
        self.epoch = self.written = 0
        for n in listed(spark, f"{self.path}/manifests"):
            if n.endswith(".json"):
                self._apply(json.loads(read_text(spark, f"{self.path}/manifests/{n}")))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Standing:
        """The state in a folder, as of its last manifest."""
        path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        first = read_text(spark, f"{path}/manifests/00000000.json")
        if first is None:
            raise Refused("NoSuchState", path)
        catalog = Catalog()
        for t, fields in json.loads(first)["catalog"].items():
            catalog.declare(t, [Field(*f) for f in fields])
        return cls(spark, catalog, path)

    # Manifests: every change of state is one.

    def _commit(self, **what) -> None:
        if self.written == 0 and "catalog" not in what:
            self._commit(catalog={t: [(f.name, f.type, f.nullable) for f in fields] for t, fields in self.catalog.tables.items()})
        text = json.dumps(what)
        write_text(self.spark, f"{self.path}/manifests/{self.written:08d}.json", text)
        self._apply(json.loads(text))

    def _apply(self, m: dict) -> None:
        self.written += 1
        if "epoch" in m:
            self.epoch = m["epoch"]
            for t, paths in m["log"].items():
                self.log[t] += [(self.epoch, p) for p in paths]
            self.tokens |= {(s, k): tuple(c) for s, k, c in m["tokens"]}
            for i, p in m["moves"].items():
                self.moves[i].append((self.epoch, p))
        if "register" in m:
            name, i = m["register"]
            self.names[name] = i
            if "query" in m:
                self.queries[i] = pickle.loads(base64.b64decode(m["query"]))
                self.bases[i], self.moves[i], self.errors[i] = (self.epoch, m["base"]), [], []
        if "deregister" in m:
            i = self.names.pop(m["deregister"])
            if i not in self.names.values():
                for kept in (self.queries, self.bases, self.moves, self.errors):
                    kept.pop(i)
        for i, p in m.get("errors", {}).items():
            self.errors[i].append(p)
        if "compact" in m:
            at, self.snapshots = m["compact"], {t: (m["compact"], p) for t, p in m["snapshots"].items()}
            self.log = {t: [(e, p) for e, p in files if e > at] for t, files in self.log.items()}
            for i, p in m["bases"].items():
                self.bases[i] = (at, p)
                self.moves[i] = [(e, p) for e, p in self.moves[i] if e > at - KEPT_EPOCHS]
                self.errors[i] = [m["all_errors"][i]] if i in m["all_errors"] else []

    def _fresh(self, what: str) -> str:
        return f"{self.path}/{what}-{uuid.uuid4().hex[:12]}"

    # The log.

    def _empty(self, table: str) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {SPARK[f.type]}" for f in self.catalog.tables[table])
        return self.spark.createDataFrame([], f"{fields}, __source string, {WEIGHT} long")

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        empty = self._empty(table)
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def append(self, source: str, table: str, rows: DataFrame, token: str | None = None) -> bool:
        """Add rows (with __w, or once each) to the next epoch; False if the token came before with equal content.

        A token counts from the seal of its epoch on; if that fails, the append may be repeated.
        """
        if table not in self.catalog.tables:
            raise Refused("UnknownTable", table)
        fields = self.catalog.tables[table]
        weight = F.col(WEIGHT).cast("long") if WEIGHT in rows.columns else F.lit(1).cast("long")
        rows = rows.select(*[F.col(f"`{f.name}`").cast(SPARK[f.type]).alias(f.name) for f in fields], F.lit(source).alias("__source"), weight.alias(WEIGHT))
        where = [F.col(f"`{f.name}`").isNull() for f in fields if not f.nullable]
        if where and not rows.where(reduce(lambda a, b: a | b, where)).isEmpty():
            raise Refused("NullInNotNull", table)
        content = None
        if token is not None:
            h = F.xxhash64(*[F.struct(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")
            n, total = rows.agg(F.count("*"), F.sum(h)).first()
            content = (table, n, str(total))
            known = self.tokens.get((source, token), self.pending_tokens.get((source, token)))
            if known == content:
                return False
            if known is not None:
                raise Refused("TokenReused", token)
        path = self._fresh(f"log/{table}/{self.epoch + 1:08d}")
        rows.write.parquet(path)
        self.pending.setdefault(table, []).append(path)
        if content is not None:
            self.pending_tokens[source, token] = content
        return True

    def _by_source(self, table: str, epoch: int | None = None) -> DataFrame:
        """Rows of the log with __source, from the snapshot on where there is one."""
        until = self.epoch if epoch is None else epoch
        since, base = self.snapshots.get(table, (0, None))
        if until < since:
            raise Refused("SnapshotReclaimed", str(until))
        return self._read(table, ([base] if base else []) + [p for e, p in self.log[table] if since < e <= until])

    def integral(self, table: str, epoch: int | None = None) -> DataFrame:
        """The table as of an epoch, each distinct row with its weight."""
        return consolidated(self._by_source(table, epoch).drop("__source"))

    def hydrated(self, epoch: int | None = None) -> dict[str, DataFrame]:
        """All tables as of an epoch: the snapshot and what came after it."""
        return {t: self.integral(t, epoch) for t in self.catalog.tables}

    def epochs(self, table: str, after: int = 0) -> DataFrame:
        """Rows of the log with __source, __w and __epoch, of the epochs after one."""
        if after < self.snapshots.get(table, (0, None))[0]:
            raise Refused("SubscriptionGap", str(after))
        parts = [self._read(table, [p]).withColumn("__epoch", F.lit(e).cast("long")) for e, p in self.log[table] if e > after]
        return reduce(DataFrame.unionByName, parts) if parts else self._empty(table).withColumn("__epoch", F.lit(0).cast("long"))

    def seal(self) -> int:
        """Make the pending appends the next epoch; refused as a whole if a row would stand a negative number of times."""
        pending, tokens, self.pending, self.pending_tokens = self.pending, self.pending_tokens, {}, {}
        change = {t: consolidated(self._read(t, paths).drop("__source")) for t, paths in pending.items()}
        before = self.hydrated()
        for t, c in change.items():
            down = c.where(F.col(WEIGHT) < 0)
            columns = [f.name for f in self.catalog.tables[t]]
            same = reduce(lambda a, b: a & b, [F.col(f"a.`{x}`").eqNullSafe(F.col(f"b.`{x}`")) for x in columns])
            left = F.coalesce(F.col(f"b.{WEIGHT}"), F.lit(0)) + F.col(f"a.{WEIGHT}")
            if not down.alias("a").join(before[t].alias("b"), same, "left").where(left < 0).isEmpty():
                raise Refused("NegativeIntegral", t)
        moves, errors = {}, {}
        for i, q in self.queries.items():
            low = Lowering(q, self.catalog, "collect", weighted=True)
            delta = low.change(before, change)
            if delta is not None:
                moves[i] = self._fresh(f"answers/{i}/{self.epoch + 1:08d}")
                delta.write.parquet(moves[i])
                self._keep_errors(low, i, errors)
        self._commit(epoch=self.epoch + 1, log=pending, tokens=[(s, k, c) for (s, k), c in tokens.items()], moves=moves, errors=errors)
        return self.epoch

    def _keep_errors(self, low: Lowering, i: str, errors: dict[str, str]) -> None:
        found = low.error_table()
        if found is not None:
            errors[i] = self._fresh(f"errors/{i}")
            found.coalesce(1).write.parquet(errors[i])

    def compact(self) -> None:
        """Fold the log, the answers and the errors up to now into one table each; feeds older than KEPT_EPOCHS end."""
        snapshots, bases, all_errors = {}, {}, {}
        for t in self.catalog.tables:
            snapshots[t] = self._fresh(f"snapshots/{t}")
            self._by_source(t).groupBy(*[f"`{f.name}`" for f in self.catalog.tables[t]], "__source").agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0).write.parquet(snapshots[t])
        for i in self.queries:
            bases[i] = self._fresh(f"answers/{i}/base")
            self._answer(i).write.parquet(bases[i])
            if self.errors[i]:
                all_errors[i] = self._fresh(f"errors/{i}")
                self._errors(i).coalesce(1).write.parquet(all_errors[i])
        old = [p for files in self.log.values() for _, p in files] + [p for _, p in self.snapshots.values()] + [p for i in self.queries for p in [self.bases[i][1], *self.errors[i]]]
        self._commit(compact=self.epoch, snapshots=snapshots, bases=bases, all_errors=all_errors)
        for p in old:
            remove(self.spark, p)

    # Queries.

    def register(self, name: str, query: str | Query) -> None:
        """Answer a query from now on; it starts from the tables as they are. An equal query is kept once."""
        q = parse(query, self.catalog) if isinstance(query, str) else bind(query, self.catalog)
        if name in self.names:
            raise Refused("DuplicateHandle", name)
        i = hashlib.sha256(repr(q).encode()).hexdigest()[:16]
        if i in self.queries:
            self._commit(register=(name, i))
            return
        low, base, errors = Lowering(q, self.catalog, "collect", weighted=True), self._fresh(f"answers/{i}/base"), {}
        low.answer(self.hydrated()).write.parquet(base)
        self._keep_errors(low, i, errors)
        self._commit(register=(name, i), query=base64.b64encode(pickle.dumps(q)).decode(), base=base, errors=errors)

    def deregister(self, name: str) -> None:
        self._id(name)
        self._commit(deregister=name)

    def _id(self, name: str) -> str:
        if name not in self.names:
            raise Refused("UnknownHandle", name)
        return self.names[name]

    def _answer(self, i: str) -> DataFrame:
        at, base = self.bases[i]
        return consolidated(self.spark.read.parquet(base, *[p for e, p in self.moves[i] if e > at]))

    def _errors(self, i: str) -> DataFrame:
        return consolidated(self.spark.read.schema(f"error string, {WEIGHT} long").parquet(*self.errors[i]))

    def error(self, name: str) -> str | None:
        """The least message that the current contents raise, from the errors kept by change."""
        i = self._id(name)
        return self._errors(i).agg(F.min("error")).first()[0] if self.errors[i] else None

    def read(self, name: str) -> DataFrame:
        """The answer as of the last epoch, with weights; LiveError while the contents raise."""
        error = self.error(name)
        if error is not None:
            raise LiveError(error)
        return self._answer(self._id(name))

    def canonical(self, name: str) -> DataFrame:
        """The answer sorted by all columns, nulls first."""
        rows = self.read(name)
        return rows.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in rows.columns])

    def changes(self, name: str, after: int) -> DataFrame:
        """(__epoch, row, weight) of the epochs after one; refused if they are no longer kept."""
        i = self._id(name)
        kept = self.moves[i]
        first = min([self.bases[i][0], *(e - 1 for e, _ in kept)])
        if after < max(self.epoch - KEPT_EPOCHS, first):
            raise Refused("SubscriptionGap", str(after))
        parts = [self.spark.read.parquet(p).withColumn("__epoch", F.lit(e).cast("long")) for e, p in kept if e > after]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.read.parquet(self.bases[i][1]).withColumn("__epoch", F.lit(0).cast("long")).limit(0)

    def state(self) -> DataFrame:
        """(kind, name, files, since): what is kept, for whom, from which epoch on."""
        rows = [("table", t, len(files) + (t in self.snapshots), self.snapshots.get(t, (0, ""))[0]) for t, files in self.log.items()]
        rows += [("answer", n, 1 + sum(e > self.bases[i][0] for e, _ in self.moves[i]), self.bases[i][0]) for n, i in self.names.items()]
        rows += [("errors", n, len(self.errors[i]), self.bases[i][0]) for n, i in self.names.items()]
        return self.spark.createDataFrame(rows, "kind string, name string, files long, since long")

    def retract_source(self, source: str, table: str | None = None, where=None) -> int:
        """Take back what a source has added (of rows that meet a condition) and not taken back itself; one epoch, empty the second time."""
        for t in [table] if table else list(self.catalog.tables):
            rows = self._by_source(t).where(F.col("__source") == source).drop("__source")
            net = consolidated(rows if where is None else rows.where(where))
            self.append(source, t, negated(net))
        return self.seal()

    def follow(self, stream: DataFrame, source: str, table: str, checkpoint: str):
        """Append and seal each micro-batch of a stream, once even if it is replayed after a failed seal or a new start."""

        def step(batch: DataFrame, n: int) -> None:
            self.append(source, table, batch, token=f"batch-{n}")
            if self.pending:
                self.seal()

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
