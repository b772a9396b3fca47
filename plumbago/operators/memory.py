"""Branches, merges, provenance, bitemporal claims, policy and retrieval, as relations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbago.errors import Refused
from plumbago.sources.tables import written

MOST_ROUNDS, SLICES = 64, 64


@dataclass(frozen=True)
class Fork:
    child: str
    parent: str
    at_epoch: int


def visible(branch: str, forks: list[Fork]) -> Column:
    """Whether a row (branch, epoch) is seen from a branch: its own rows, and its ancestors' up to the forks."""
    parents: dict[str, Fork] = {}
    for f in forks:
        if f.child in parents:
            raise Refused("SecondFork", f.child)
        parents[f.child] = f
    terms, until, seen = [F.col("branch") == branch], None, {branch}
    while branch in parents:
        f = parents[branch]
        if f.parent in seen:
            raise Refused("ForkCycle", f.parent)
        until = f.at_epoch if until is None else min(until, f.at_epoch)
        terms.append((F.col("branch") == f.parent) & (F.col("epoch") <= until))
        branch = f.parent
        seen.add(branch)
    return reduce(lambda a, b: a | b, terms)


def descendants(branch: str, forks: list[Fork], rewound: frozenset[str] = frozenset()) -> list[str]:
    """Children, theirs and so on; rewound ones are walked through but not listed."""
    out, open_ = set(), [branch]
    while open_:
        b = open_.pop()
        for f in forks:
            if f.parent == b and f.child not in out:
                out.add(f.child)
                open_.append(f.child)
    return sorted(out - rewound)


def merge_counters(base: DataFrame, source: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and how, merging three versions of counters.

    Equal sides and a side that alone moved decide; of two that moved, both
    changes are added, saturating. A deletion in the source does not reach a
    target that did not move.
    """
    b, s, t = (x.select(F.col(key).alias("k"), F.col(value).alias(n)) for x, n in ((base, "b"), (source, "s"), (target, "t")))
    rows = b.join(s, "k", "full_outer").join(t, "k", "full_outer")
    wide = "decimal(38,0)"
    both = F.coalesce("b", F.lit(0)).cast(wide) + (F.col("s") - F.coalesce("b", F.lit(0)).cast(wide)) + (F.col("t") - F.coalesce("b", F.lit(0)).cast(wide))
    both = F.greatest(F.least(both, F.lit((1 << 63) - 1).cast(wide)), F.lit(-(1 << 63)).cast(wide)).cast("long")
    st, bs, bt = (F.col(x).eqNullSafe(F.col(y)) for x, y in (("s", "t"), ("b", "s"), ("b", "t")))
    how = F.when(st, "equal").when(bs, "target").when(F.col("s").isNull(), "target").when(bt, "source").when(F.col("t").isNull(), "conflict").otherwise("both")
    rows = rows.withColumn("how", how)
    merged = F.when(F.col("how").isin("equal", "target", "conflict"), F.col("t")).when(F.col("how") == "source", F.col("s")).otherwise(both)
    return rows.select(F.col("k").alias(key), merged.alias(value), "how").where(F.col(value).isNotNull() | (F.col("how") == "conflict"))


def tainted(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth) of all that derives from the seeds; edges are (parent, child).

    Each round joins the last round's nodes alone; more than 64 rounds are
    refused. Rounds are written, so that lost executors cost one round.
    """
    reached = written(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "taint")
    frontier, parts = reached, [reached]
    for depth in range(1, MOST_ROUNDS + 2):
        after = frontier.select(F.col("node").alias("parent")).join(edges, "parent").select(F.col("child").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, parts)
        frontier = written(after.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "taint")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)
    raise Refused("ClosureTooDeep", str(MOST_ROUNDS))


def as_of(claims: DataFrame, by: list[str], valid_at: int, known_at: int, seq: str = "seq") -> DataFrame:
    """The claim of each key that held at valid_at as known at known_at: of several, the highest seq.

    Intervals are half-open; a null bound does not bind.
    """

    def holds(name: str, at: int) -> Column:
        start, end = F.col(f"{name}_from"), F.col(f"{name}_to")
        return (start.isNull() | (start <= at)) & (end.isNull() | (F.lit(at) < end))

    rows = claims.where(holds("valid", valid_at) & holds("known", known_at))
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in claims.columns if c not in by]), seq).alias("v")).select(*by, "v.*")


@dataclass(frozen=True)
class Rule:
    """Patterns with * for actor, action and resource."""

    effect: str
    actor: str = "*"
    action: str = "*"
    resource: str = "*"

    def matches(self) -> Column:
        def like(c: str, pattern: str) -> Column:
            return F.lit(True) if pattern == "*" else F.col(c).rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")

        return like("actor", self.actor) & like("action", self.action) & like("resource", self.resource)


def decided(requests: DataFrame, rules: list[Rule]) -> DataFrame:
    """requests with decision: Deny if a deny rule matches, else Allow if an allow rule does, else Deny."""
    hit = {e: reduce(lambda a, b: a | b, [F.coalesce(r.matches(), F.lit(False)) for r in rules if r.effect == e], F.lit(False)) for e in ("Deny", "Allow")}
    return requests.withColumn("decision", F.when(hit["Deny"], "Deny").when(hit["Allow"], "Allow").otherwise("Deny"))


def lexical(text: Column, terms: list[str]) -> Column:
    """Share of the query's terms that the lower-cased text contains."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return sum((lower.contains(t.lower()).cast("double") for t in terms), F.lit(0.0)) / max(1, len(terms))


def retrieved(entries: DataFrame, terms: list[str], text: str = "text", similarity: Column | None = None, stale: Column | None = None) -> DataFrame:
    """entries with score: half the raised cosine, if any, plus the share of terms; a quarter of it if stale."""
    score = lexical(F.col(text), terms)
    if similarity is not None:
        score = (similarity + 1) / 2 + score
    if stale is not None:
        score = F.when(stale, score * 0.25).otherwise(score)
    return entries.withColumn("score", score)


# Typed merges beside counters.

#: How much a claim's method counts, least first.
METHODS = ("inferred", "stated", "observed", "verified")
POLICIES = ("typed", "take_source", "take_target", "conflict")


def _three_ways(base: DataFrame, source: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """k, b, s, t and how the sides moved: "equal", "target", "source", "gone" (the target dropped what the source moved) or "both"."""
    b, s, t = (x.select(F.col(key).alias("k"), F.col(value).alias(n), F.lit(True).alias(f"has_{n}")) for x, n in ((base, "b"), (source, "s"), (target, "t")))
    rows = b.join(s, "k", "full_outer").join(t, "k", "full_outer").fillna(False, ["has_b", "has_s", "has_t"])

    def same(x: str, y: str) -> Column:
        return (F.col(f"has_{x}") == F.col(f"has_{y}")) & F.col(x).eqNullSafe(F.col(y))

    how = F.when(same("s", "t"), "equal").when(same("b", "s") | ~F.col("has_s"), "target").when(same("b", "t"), "source").when(~F.col("has_t"), "gone").otherwise("both")
    return rows.withColumn("how", how)


def _resolved(rows: DataFrame, key: str, value: str, both: Column, conflict: Column, policy: str) -> DataFrame:
    if policy not in POLICIES:
        raise Refused("UnknownPolicy", policy)
    if policy != "typed":
        both, conflict = {"take_source": (F.col("s"), F.lit(False)), "take_target": (F.col("t"), F.lit(False)), "conflict": (F.col("t"), F.lit(True))}[policy]
    merged = F.when(F.col("how") == "source", F.col("s")).when(F.col("how") == "both", both).otherwise(F.col("t"))
    clash = (F.col("how") == "gone") | ((F.col("how") == "both") & conflict)
    out = rows.select(F.col("k").alias(key), merged.alias(value), F.when(clash, "conflict").otherwise(F.col("how")).alias("how"), (F.col("has_t") | clash | F.col("how").isin("source", "both")).alias("__there"))
    return out.where("__there").drop("__there")


def merge_sets(base: DataFrame, source: DataFrame, target: DataFrame, key: str, value: str, policy: str = "typed") -> DataFrame:
    """key, value (a sorted array) and how; of two sets that both moved, the union. Deletions in the source don't reach the target."""
    tidy = lambda x: x.withColumn(value, F.array_sort(F.array_distinct(value)))
    rows = _three_ways(tidy(base), tidy(source), tidy(target), key, value)
    return _resolved(rows, key, value, F.array_sort(F.array_union("s", "t")), F.lit(False), policy)


def merge_claims(base: DataFrame, source: DataFrame, target: DataFrame, key: str, value: str, policy: str = "typed") -> DataFrame:
    """key, value and how; value is a struct with start, end, method and confidence.

    Of two claims that moved: the one that starts later if their intervals (half
    open, null bounds unbound) do not overlap; else the one of the higher method,
    then confidence in millionths; equal ones are a conflict, and the target's stays.
    """
    rows = _three_ways(base, source, target, key, value)
    low = lambda x: F.coalesce(F.col(f"{x}.start"), F.lit(-(1 << 63)))
    high = lambda x: F.coalesce(F.col(f"{x}.end"), F.lit((1 << 63) - 1))
    rank = lambda x: F.struct(F.coalesce(F.array_position(F.lit(list(METHODS)), F.col(f"{x}.method")), F.lit(0)).alias("m"), F.floor(F.coalesce(F.col(f"{x}.confidence"), F.lit(0.0)) * 1_000_000).alias("c"))
    overlap = (low("s") < high("t")) & (low("t") < high("s"))
    both = F.when(~overlap, F.when(low("s") > low("t"), F.col("s")).otherwise(F.col("t"))).when(rank("s") > rank("t"), F.col("s")).otherwise(F.col("t"))
    return _resolved(rows, key, value, both, overlap & (rank("s") == rank("t")), policy)


def merge_custom(base: DataFrame, source: DataFrame, target: DataFrame, key: str, value: str, merge) -> DataFrame:
    """As the others, with merge(b, s, t), a function of Columns, where both sides moved."""
    rows = _three_ways(base, source, target, key, value)
    return _resolved(rows, key, value, merge(F.col("b"), F.col("s"), F.col("t")), F.lit(False), "typed")


def divergence(rows: DataFrame, fork_epoch: int, merged: DataFrame, key: str) -> DataFrame:
    """Rows of a branch since its fork whose key has not been merged already."""
    return rows.where(F.col("epoch") > fork_epoch).join(merged.select(key).distinct(), key, "left_anti")


def page_diff(base: DataFrame, source: DataFrame, target: DataFrame, key: str, content: str) -> DataFrame:
    """key and side ("source", "target", "both", "same" where both made the same change) of pages that changed."""
    rows = _three_ways(base, source, target, key, content)
    moved = lambda x: ~((F.col("has_b") == F.col(f"has_{x}")) & F.col("b").eqNullSafe(F.col(x)))
    side = F.when(moved("s") & moved("t"), F.when(F.col("how") == "equal", "same").otherwise("both")).when(moved("s"), "source").when(moved("t"), "target")
    return rows.select(F.col("k").alias(key), side.alias("side")).where("side is not null")


def lineage(log: DataFrame) -> DataFrame:
    """child, parent, at_epoch and active from a log (child, parent, at_epoch, kind, seq) of forks and rewinds.

    A second fork of one child is refused; the last rewind wins and makes a branch inactive.
    """
    forks = log.where("kind = 'fork'").groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("at_epoch").alias("at_epoch"))
    forks = forks.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("SecondFork: "), "child")).cast("boolean")).otherwise(True))
    rewinds = log.where("kind = 'rewind'").groupBy("child").agg(F.max_by("at_epoch", "seq").alias("rewound_to"))
    return forks.join(rewinds, "child", "left").select("child", "parent", "at_epoch", "rewound_to", F.col("rewound_to").isNull().alias("active"))


# Taint and what follows from it.


def mark_stale(claims: DataFrame, contaminated: DataFrame, node: str = "node") -> DataFrame:
    """claims with status Stale where an Asserted one derives from what is contaminated; observations are untouched."""
    hit = contaminated.select(F.col("node").alias("__hit")).distinct()
    rows = claims.join(hit, claims[node] == F.col("__hit"), "left")
    stale = F.col("__hit").isNotNull() & (F.col("kind") == "claim") & (F.col("status") == "Asserted")
    return rows.withColumn("status", F.when(stale, "Stale").otherwise(F.col("status"))).drop("__hit")


def forget(entries: DataFrame, claims: DataFrame, contaminated: DataFrame, node: str = "node") -> tuple[DataFrame, DataFrame]:
    """(entries left in the index, claims with the contaminated ones Invalidated)."""
    hit = contaminated.select(F.col("node").alias("__hit")).distinct()
    left = entries.join(hit, entries[node] == F.col("__hit"), "left_anti")
    rows = claims.join(hit, claims[node] == F.col("__hit"), "left")
    return left, rows.withColumn("status", F.when(F.col("__hit").isNotNull(), "Invalidated").otherwise(F.col("status"))).drop("__hit")


def recall_report(contaminated: DataFrame, actions: DataFrame, writes: DataFrame, journal: DataFrame | None = None) -> DataFrame:
    """section, node and depth of what a taint reached: irreversible actions first, then writes that can be healed.

    actions and writes have node (and reversible); journal holds rows of an earlier, interrupted report.
    """
    acted = actions.where("not reversible").select("node").distinct().join(contaminated, "node").select(F.lit("1-irreversible").alias("section"), "node", "depth")
    healed = writes.select("node").distinct().join(contaminated, "node").select(F.lit("2-healed").alias("section"), "node", "depth")
    both = acted.unionByName(healed)
    return (both if journal is None else both.unionByName(journal)).groupBy("section", "node").agg(F.min("depth").alias("depth"))


def taint_and_heal(standing, seeds: DataFrame, edges: DataFrame, table: str, key: str, source: str) -> DataFrame:
    """Resolve what derives from the seeds, take it out of a standing table, and return the report; a second call changes nothing.

    The payload goes in one epoch, so answers move once; edges are kept by the caller until the report is read.
    """
    reached = tainted(seeds, edges)
    rows = standing.integral(table)
    gone = rows.join(reached.select(F.col("node").alias(key)), key, "left_semi")
    report = written(gone.select(F.col(key).alias("node")).distinct().join(reached, "node"), "taint-report")
    standing.append(source, table, gone.withColumn("__w", -F.col("__w")))
    standing.seal()
    return report.select(F.lit("2-healed").alias("section"), "node", "depth")


# Trust, eligibility, influence, budgets.

#: Classes of trust, the most trusted first.
TRUST = ("VerifiedSystem", "Human", "ThirdParty", "Untrusted")


def combined_label(labels: Column) -> Column:
    """The least trusted class of an array of labels; null for none."""
    ranks = F.transform(labels, lambda x: F.array_position(F.lit(list(TRUST)), x))
    return F.get(F.lit(list(TRUST)), (F.array_max(ranks) - 1).cast("int"))


def eligible(status: Column, evidence: Column) -> Column:
    """Whether a claim may be acted on: asserted, with evidence."""
    return F.coalesce((status == "Asserted") & (F.size(evidence) > 0), F.lit(False))


def gateway(requests: DataFrame, done: DataFrame, rules: list[Rule], killed: bool = False) -> DataFrame:
    """requests (key, actor, action, resource, status, evidence, simulated) with outcome, the first gate that stops them.

    Keys in done are replays; then come the kill switch, evidence, policy and simulation. "Proposed" goes on to a connector.
    """
    known = done.select(F.col("key").alias("__done")).distinct()
    rows = decided(requests.join(known, requests["key"] == F.col("__done"), "left"), rules)
    outcome = F.when(F.col("__done").isNotNull(), "Replay").when(F.lit(killed), "Killed").when(~eligible(F.col("status"), F.col("evidence")), "NotEligible").when(F.col("decision") == "Deny", "Denied").when(~F.coalesce(F.col("simulated"), F.lit(False)), "SimulationFailed").otherwise("Proposed")
    return rows.withColumn("outcome", outcome).drop("__done", "decision")


def influence(entries: DataFrame, blocked: list[str], label: str = "label") -> DataFrame:
    """Entries whose label may influence an answer, chosen before they are scored; entries without a label don't."""
    return entries.where(F.col(label).isNotNull() & ~F.col(label).isin(blocked))


def tokens(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its bytes, rounded up, at least one."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("long")


def packed(entries: DataFrame, budget: int, key: str = "key", cost: str = "cost") -> DataFrame:
    """The entries taken into a budget in the order (score falling, nulls last, then key): each that still fits, going on after one that doesn't.

    Costs are whole numbers. Once an entry doesn't fit, no later one of its cost does; so only the first budget // cost of
    each cost can be taken. These, some budget * ln(budget) however many entries there are, pass through one task as a
    stream. They are chosen in slices of the keys first, so that a frequent cost is not sorted in one place.
    """
    order = [F.col("score").desc_nulls_last(), F.col(key).asc_nulls_last(), F.col("__c").asc()]
    rows = entries.where((F.col(cost) <= budget) & (F.col(cost) > 0)).withColumns({"__c": F.col(cost).cast("long"), "__s": F.pmod(F.xxhash64(key), F.lit(SLICES))})
    for by in (["__c", "__s"], ["__c"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        rows = rows.withColumn("__r", place).where(F.col("__r") * F.col("__c") <= budget)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, n = budget, 0
        for b in batches:
            at = []
            for k, c in enumerate(b.column("__c").to_pylist()):
                if c <= left:
                    left -= c
                    at.append(k)
            got = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(got.column(c) for c in names), pa.array(range(n, n + len(at)), pa.int32())], names=[*names, "place"])
            n += len(at)

    names = entries.columns
    one = rows.repartition(1).sortWithinPartitions(*order).select(*names, "__c")
    return one.mapInArrow(take, StructType([*entries.schema, StructField("place", IntegerType())])).where(F.col(key).isNotNull())
