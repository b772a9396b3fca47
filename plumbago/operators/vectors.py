"""Search and grouping by vector similarity, over arrays of numbers.

Scores are sums of doubles in index order. Orders are total: score falling, then
key. Query vectors, centres and anchors are few (at most 256) and enter the plan
as literals, so nothing is broadcast or joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.errors import Refused

MOST_QUALIFYING, MOST_CENTRES, RRF = 100_000, 256, 60
LEAST_NORM = 1e-12


def unit(vector: list[float]) -> list[float]:
    norm = math.sqrt(sum(float(x) ** 2 for x in vector))
    if not vector or not math.isfinite(norm) or norm < LEAST_NORM:
        raise Refused("InvalidVector")
    return [float(x) / norm for x in vector]


def dot(vector: Column, fixed: list[float]) -> Column:
    pairs = F.zip_with(vector.cast("array<double>"), F.array(*[F.lit(float(x)) for x in fixed]), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(vector: Column, fixed: list[float]) -> Column:
    """Cosine with a vector; null where the row's vector is null, empty or not finite, or of another length."""
    n = norm(vector)
    valid = (F.size(vector) == len(fixed)) & (n >= LEAST_NORM) & (n < F.lit(math.inf))
    return F.when(valid, dot(vector, unit(fixed)) / n)


def scored(rows: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    return rows.withColumn("score", cosine(F.col(vector), query)).where("score is not null")


def top_k(rows: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding", predicate: Column | None = None) -> DataFrame:
    """The k rows nearest to the query."""
    rows = rows if predicate is None else rows.where(predicate)
    return scored(rows, query, vector).orderBy(F.desc("score"), F.asc(key)).limit(k)


def within(rows: DataFrame, query: list[float], tau: float, k: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with a score of tau or more, the k first of them if k is given. More than 100 000 are refused."""
    found = scored(rows, query, vector).where(F.col("score") >= tau)
    if found.limit(MOST_QUALIFYING + 1).count() > MOST_QUALIFYING:
        raise Refused("ThresholdTooWide", str(tau))
    found = found.orderBy(F.desc("score"), F.asc(key))
    return found if k is None else found.limit(k)


def fused(rankings: list[DataFrame], k: int, key: str = "vec_id") -> DataFrame:
    """Reciprocal-rank fusion of short rankings, each with key and score."""
    ranks = []
    for r in rankings:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc(key)))
        ranks.append(r.select(key, (F.lit(1.0) / (RRF + place)).alias("share")))
    union = ranks[0]
    for r in ranks[1:]:
        union = union.unionByName(r)
    return union.groupBy(key).agg(F.sum("share").alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)


def l2_sq(vector: Column, fixed: list[float]) -> Column:
    pairs = F.zip_with(vector.cast("array<double>"), F.lit([float(x) for x in fixed]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine_of_l2(distance: Column) -> Column:
    """Cosine of two unit vectors from their squared distance."""
    return 1 - distance / 2


def _cosines(vector: str, centres: list[list[float]]) -> Column:
    """Cosines with all centres; the row's norm is computed once, the centres are one literal."""
    if not 0 < len(centres) <= MOST_CENTRES:
        raise Refused("TooManyCentres", str(len(centres)))
    every = F.lit([x for c in centres for x in unit(c)]).cast("array<double>")
    dim = len(centres[0])
    v = F.col(vector).cast("array<double>")

    def each(b: Column) -> Column:
        pairs = lambda k: F.zip_with(b["v"], F.slice(b["every"], k * dim + 1, F.lit(dim)), lambda x, y: x * y)
        dots = F.transform(F.sequence(F.lit(0), F.lit(len(centres) - 1)), lambda k: F.aggregate(pairs(k), F.lit(0.0), lambda s, x: s + x) / b["n"])
        return F.when((F.size(b["v"]) == dim) & (b["n"] >= LEAST_NORM) & (b["n"] < F.lit(math.inf)), dots)

    return F.transform(F.array(F.struct(v.alias("v"), norm(F.col(vector)).alias("n"), every.alias("every"))), each)[0]


def novelty(rows: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    """rows with novelty, one less the cosine with the nearest centre."""
    return rows.withColumn("novelty", 1 - F.array_max(_cosines(vector, centres)))


def drift(rows: DataFrame, centres: list[list[float]], threshold: float, by: list[str], vector: str = "embedding", usual: float = 0.01) -> DataFrame:
    """Events, novel events, their share, mean and most novelty, and whether it fires (share over 5 times the usual)."""
    n = novelty(rows, centres, vector)
    out = n.groupBy(*by).agg(F.count("*").alias("events"), F.sum((F.col("novelty") > threshold).cast("long")).alias("novel"), F.avg("novelty").alias("mean"), F.max("novelty").alias("most"))
    return out.withColumn("fraction", F.col("novel") / F.col("events")).withColumn("fired", F.col("fraction") > 5 * usual)


def assigned(rows: DataFrame, anchors: list[list[float]], vector: str = "embedding") -> DataFrame:
    """rows with group_id, the index of the nearest anchor (ties to the lowest), and its score; rows without a valid vector go."""
    all_ = rows.withColumn("__all", _cosines(vector, anchors))
    best = all_.withColumn("score", F.array_max("__all")).where("score is not null")
    return best.withColumn("group_id", (F.array_position("__all", F.col("score")) - 1).cast("long")).drop("__all")


def groups(rows: DataFrame, anchors: list[list[float]], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Members and exemplar (nearest, of equals the least key) of each anchor's group."""
    return assigned(rows, anchors, vector).groupBy("group_id").agg(F.count("*").alias("members"), F.max_by(key, F.struct("score", -F.col(key))).alias("exemplar"))
