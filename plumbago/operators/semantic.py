"""Embedding by hashes, clustering, baselines, approximate search and their quality, over rows with vectors.

Vectors enter as arrays of numbers and are made unit length; orders are total,
ties by key. Centres are few (at most 256) and travel with the plan; rows never do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.errors import Refused
from plumbago.operators import vectors

MOST_CLUSTERS, RESTARTS, EPOCHS, LOW_QUALITY = 256, 5, 15, 0.25
MOST_INPUT_BYTES, BASELINE_CENTRES, MOST_SAMPLE = 32 << 10, 16, 50_000
#: The public 64-bit FNV-1a hash, and the second seed that decides signs.
FNV_OFFSET, FNV_PRIME, SIGN_SEED = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B9
WORD = re.compile(r"[^\W_]+")
#: ASCII letters in lower case and digits as they are, all else a space; and the texts whose words are held at once.
ASCII_WORDS, TEXTS_AT_ONCE = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256)), 256


# Embedding.


def fnv1a64(data: bytes, seed: int = 0) -> int:
    h = FNV_OFFSET ^ seed
    for b in data:
        h = (h ^ b) * FNV_PRIME % 2**64
    return h


def embed(text: str, dim: int = 64) -> list[float]:
    """The unit vector of a text: words count one, neighbours half, each into a slot with a sign by hashes; refused without words."""
    words = WORD.findall(text.encode()[:MOST_INPUT_BYTES].decode("utf-8", "ignore"))
    words = [w.lower() for w in words]
    if not words:
        raise Refused("NoTokens", text[:20])
    v = np.zeros(dim, np.float32)
    for name, weight in [(w, 1.0) for w in words] + [(f"{a}_{b}", 0.5) for a, b in zip(words, words[1:])]:
        data = name.encode()
        v[fnv1a64(data) % dim] += weight if fnv1a64(data, SIGN_SEED) % 2 == 0 else -weight
    n = math.sqrt(float((v.astype(np.float64) ** 2).sum()))
    if n < vectors.LEAST_NORM:
        raise Refused("InvalidVector")
    return (v / np.float32(n)).tolist()


class _Ids(dict):
    """Numbers of words in the order they are first met."""

    def __missing__(self, word: bytes | str) -> int:
        self[word] = n = len(self)
        return n


def _fnv_on(h: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """States h after the bytes data[at : at + size] of each; the longest first, so that a step takes a prefix."""
    order = np.argsort(-size, kind="stable")
    h, at = h[order], at[order]
    prime = np.array(FNV_PRIME & np.iinfo(h.dtype).max, h.dtype)
    for j, n in enumerate(len(h) - np.cumsum(np.bincount(size))[:-1]):
        h[:n] = (h[:n] ^ data[at[:n] + j]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def embed_all(texts: list[bytes | None], dim: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that embed gives for UTF-8 texts, as rows, and which are valid; each distinct word is hashed once, all in step.

    The multiplier is odd, so the lowest bit of a hash is that of its start and bytes: the second seed only turns it over.
    Where the slots are a power of two the lower bits of the hash are enough. Weights are halves, so their sums are exact.
    """
    known, words, counts = _Ids(), [], []
    for raw in texts:
        raw = (raw or b"")[:MOST_INPUT_BYTES]
        got = raw.translate(ASCII_WORDS).split() if raw.isascii() else WORD.findall(raw.decode("utf-8", "ignore"))
        counts.append(len(got))
        words += map(known.__getitem__, got)
    low = [w if isinstance(w, bytes) else w.lower().encode() for w in known]
    data, size = np.frombuffer(b"".join(low), np.uint8), np.fromiter(map(len, low), np.int64, len(low))
    at, word = np.cumsum(size) - size, np.array(words, np.int64)
    kind = np.uint16 if dim & (dim - 1) == 0 and dim <= 1 << 16 else np.uint64
    one = _fnv_on(np.full(len(low), FNV_OFFSET & np.iinfo(kind).max, kind), data, at, size)
    row = np.repeat(np.arange(len(texts)), counts)
    pair = np.flatnonzero(row[1:] == row[:-1])
    joined = _fnv_on(one, np.frombuffer(b"_", np.uint8), np.zeros_like(size), np.ones_like(size))
    then = word[pair + 1]
    two = _fnv_on(joined[word[pair]], data, at[then], size[then])
    total = np.zeros(len(texts) * dim)
    for h, r, weight in ((one[word], row, 1.0), (two, row[pair], 0.5)):
        signed = np.where(h & 1 != SIGN_SEED & 1, -weight, weight) if len(h) else np.zeros(0)
        total += np.bincount(r * dim + (h % np.array(dim, np.uint64)).astype(np.int64), signed, len(total))
    v = total.reshape(-1, dim)
    n = np.sqrt((v**2).sum(axis=1))
    ok = n >= vectors.LEAST_NORM
    return v.astype(np.float32) / np.where(ok, n, 1).astype(np.float32)[:, None], ok


def with_embedding(rows: DataFrame, text: str = "body", dim: int = 64, embedder: Callable[[str], list[float]] | None = None, vector: str = "embedding") -> DataFrame:
    """rows with the vector of a text column; null where it has no words. embedder: any function of a text, for other spaces.

    The function is called nondeterministic, as Spark would otherwise move conditions on the vector below it and embed
    every text twice; conditions on other columns should come before.
    """

    @F.arrow_udf("array<float>")
    def of_bytes(texts: pa.Array) -> pa.Array:
        parts, valid = [np.zeros((0, dim), np.float32)], [np.zeros(0, bool)]
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            v, ok = embed_all(texts.slice(k, TEXTS_AT_ONCE).to_pylist(), dim)
            parts.append(v)
            valid.append(ok)
        flat, ok = np.concatenate(parts), np.concatenate(valid)
        ends = pa.array(np.arange(0, flat.size + 1, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(flat.ravel()), mask=pa.array(~ok))

    @F.pandas_udf("array<float>")
    def of(texts):
        import pandas as pd

        def one(t):
            try:
                return embedder(t) if t is not None else None
            except Refused:
                return None

        return pd.Series([one(t) for t in texts])

    if embedder is None:
        return rows.withColumn(vector, of_bytes.asNondeterministic()(F.substring(F.col(text).cast("binary"), 1, MOST_INPUT_BYTES)))
    return rows.withColumn(vector, of.asNondeterministic()(F.col(text)))


# Clustering.


def _partials(rows: DataFrame, centres: np.ndarray, vector: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and counts of the rows nearest to each centre, and the sum of squared distances: mergeable, a row a partition and centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centres.shape
        total, count, cost = np.zeros((k, dim)), np.zeros(k, np.int64), np.zeros(k)
        for b in batches:
            x = _matrix(b.column(0), dim)
            if len(x):
                d = 2 - 2 * (x @ centres.T) if np.allclose((centres**2).sum(1), 1) else (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
                near = d.argmin(axis=1)
                np.add.at(total, near, x)
                count += np.bincount(near, minlength=k)
                cost += np.bincount(near, np.maximum(d[np.arange(len(x)), near], 0), minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(count), pa.array(cost)], names=["c", "total", "n", "cost"])

    k, dim = centres.shape
    parts = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "c int, total array<double>, n long, cost double")
    merged = parts.groupBy("c").agg(F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(dim)]).alias("total"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).orderBy("c").collect()
    return np.array([r.total for r in merged]), np.array([r.n for r in merged]), float(sum(r.cost for r in merged))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a batch; rows that are no vector of this length are left out."""
    rows = [v for v in column.to_pylist() if v is not None and len(v) == dim]
    x = np.array(rows, np.float64).reshape(-1, dim)
    n = np.sqrt((x**2).sum(axis=1))
    ok = np.isfinite(n) & (n >= vectors.LEAST_NORM)
    return x[ok] / n[ok, None]


def lloyd(x: np.ndarray, k: int, restarts: int = RESTARTS, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Centres of a matrix by k-means from k-means++ starts, the best of several; the same for the same rows in order."""
    best, least = x[:k], math.inf
    for r in range(restarts):
        rng = np.random.default_rng([seed, r])
        c = x[rng.integers(len(x))][None]
        while len(c) < k:
            d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0).min(axis=1)
            c = np.concatenate([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))][None]])
        for _ in range(epochs):
            d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
            near = d.argmin(axis=1)
            n = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            if np.allclose(moved, c):
                break
            c = moved
        cost = float(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0).min(axis=1).sum())
        if cost < least - 1e-12:
            best, least = c, cost
    return best


def k_means(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", sample: int = MOST_SAMPLE // 10, epochs: int = EPOCHS) -> np.ndarray:
    """k centres: started on a bounded sample chosen by a hash of the key, moved over all rows by mergeable sums."""
    if not 0 < k <= MOST_CLUSTERS:
        raise Refused("TooManyClusters", str(k))
    n = rows.count()
    h = F.xxhash64(F.col(key))
    chosen = rows if n <= sample else rows.where(F.shiftrightunsigned(h, 11) < int(sample / n * (1 << 53)))
    got = chosen.select(h.alias("h"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").collect()
    if not got:
        return np.zeros((0, 0))
    got.sort(key=lambda r: (r.h, r.v))
    x = _matrix(pa.array([r.v for r in got]), len(got[0].v))
    centres = lloyd(x, min(k, len(x)))
    if n > sample:
        for _ in range(epochs):
            total, count, _ = _partials(rows, centres, vector)
            moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
            if np.allclose(moved, centres, atol=1e-6):
                break
            centres = moved
    return centres


def assigned(rows: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """rows with cluster, the nearest centre, and distance (squared); rows without a valid vector go."""
    fixed = F.lit(centres.ravel().tolist()).cast("array<double>")
    k, dim = centres.shape
    n = vectors.norm(F.col(vector))
    valid = (F.size(vector) == dim) & (n >= vectors.LEAST_NORM) & (n < F.lit(math.inf))
    bound = F.struct(F.transform(F.col(vector).cast("array<double>"), lambda x: x / n).alias("v"), fixed.alias("c"))

    def best(b: Column) -> Column:
        far = lambda j: F.aggregate(F.zip_with(b["v"], F.slice(b["c"], j * dim + 1, F.lit(dim)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(far(j).alias("distance"), j.alias("cluster"))))

    return rows.where(valid).withColumn("__b", F.transform(F.array(bound), best)[0]).withColumns({"cluster": F.col("__b.cluster"), "distance": F.col("__b.distance")}).drop("__b")


def clusters(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", cost: Column | None = None, error: Column | None = None, centres: np.ndarray | None = None) -> DataFrame:
    """cluster, count, cost and errors in all, exemplar (nearest, then least key), quality and low of each, by count falling and exemplar."""
    c = k_means(rows, k, key, vector) if centres is None else centres
    if not len(c):
        return rows.sparkSession.createDataFrame([], f"cluster int, count long, avg_cost double, error_rate double, exemplar {dict(rows.dtypes)[key]}, quality double, low boolean")
    _, _, one = _partials(rows, _partials(rows, c[:1], vector)[0] / max(1, _partials(rows, c[:1], vector)[1].sum()), vector)
    _, _, many = _partials(rows, c, vector)
    quality = 1 - many / one if one > 0 else 0.0
    placed = assigned(rows.withColumns({"__cost": cost if cost is not None else F.lit(0.0), "__error": error if error is not None else F.lit(False)}), c, vector)
    out = placed.groupBy("cluster").agg(F.count("*").alias("count"), F.avg("__cost").alias("avg_cost"), F.avg(F.col("__error").cast("int")).alias("error_rate"), F.min_by(key, F.struct("distance", key)).alias("exemplar"))
    return out.withColumns({"quality": F.lit(quality), "low": F.lit(quality < LOW_QUALITY)}).orderBy(F.desc("count"), F.asc("exemplar"))


def group_survivors(hits: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters of a search's survivors, with their members' keys."""
    c = k_means(hits, k, key, vector)
    placed = assigned(hits, c, vector)
    return placed.groupBy("cluster").agg(F.count("*").alias("count"), F.min_by(key, F.struct("distance", key)).alias("exemplar"), F.array_sort(F.collect_list(key)).alias("members")).orderBy(F.desc("count"), F.asc("exemplar"))


def difference(a: DataFrame, b: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters of b that no row of a falls into."""
    c = k_means(b, k, key, vector)
    seen = assigned(a, c, vector).select("cluster").distinct()
    return clusters(b, k, key, vector, centres=c).join(seen, "cluster", "left_anti").orderBy(F.desc("count"), F.asc("exemplar"))


# Baselines of what is usual.


@dataclass(frozen=True)
class Baseline:
    space: str
    centres: list[list[float]]
    threshold: float


def baseline(rows: DataFrame, space: str = "", centres: int = BASELINE_CENTRES, key: str = "vec_id", vector: str = "embedding") -> Baseline:
    """Centres of rows, and the novelty at rank round(0.99 (n - 1)) of their own, found by counting, not by sorting in one place."""
    c = k_means(rows, centres, key, vector).tolist()
    if not c:
        raise Refused("EmptyBaseline", space)
    own = vectors.novelty(rows, c, vector).where("novelty is not null").select("novelty")
    n = own.count()
    at = round((n - 1) * 0.99)
    return Baseline(space, c, own.orderBy(F.desc("novelty")).limit(n - at).agg(F.min("novelty")).first()[0])


def against(rows: DataFrame, usual: Baseline, by: list[str], space: str = "", vector: str = "embedding") -> DataFrame:
    """Events, novel ones, their share and whether it fires, against a named baseline of the same space."""
    if space != usual.space:
        raise Refused("SpaceMismatch", f"{space} against {usual.space}")
    return vectors.drift(rows, usual.centres, usual.threshold, by, vector)


def drift_check(rows: DataFrame, baselines: dict[str, Baseline], generation: str = "generation", vector: str = "embedding") -> DataFrame:
    """A row a generation: its drift, or degraded where it has no baseline."""
    parts = [against(rows.where(F.col(generation) == g), b, [generation], b.space, vector).withColumn("degraded", F.lit(False)) for g, b in sorted(baselines.items())]
    rest = rows.where(~F.col(generation).isin(list(baselines)) if baselines else F.lit(True)).groupBy(generation).agg(F.count("*").alias("events"))
    out = rest.withColumn("degraded", F.lit(True))
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def one_space(rows: DataFrame, space: str = "space", named: str | None = None) -> DataFrame:
    """Rows of one embedding space: the named one, or the only one there is."""
    if named is not None:
        return rows.where(F.col(space) == named)
    found = [r[0] for r in rows.select(space).distinct().limit(2).collect()]
    if len(found) > 1:
        raise Refused("SeveralSpaces", ", ".join(sorted(map(str, found))))
    return rows


# Approximate search: inverted lists of product-quantised residuals, then exact scores.


@dataclass
class Index:
    rows: DataFrame
    centres: np.ndarray
    codebooks: np.ndarray  # (parts, 256 or fewer, dim / parts)
    key: str
    vector: str


def index(rows: DataFrame, lists: int = 16, parts: int = 8, key: str = "vec_id", vector: str = "embedding", sample: int = 5000) -> Index:
    """Fitted on a bounded sample by a hash of the key; every row with a valid vector is placed in its list and coded."""
    centres = k_means(rows, lists, key, vector, sample)
    dim = centres.shape[1]
    if dim % parts:
        raise Refused("DimensionNotDivisible", f"{dim} by {parts}")
    n = rows.count()
    h = F.xxhash64(F.col(key))
    chosen = rows if n <= sample else rows.where(F.shiftrightunsigned(h, 11) < int(sample / n * (1 << 53)))
    x = _matrix(pa.array([r.v for r in sorted(chosen.select(h.alias("h"), F.col(vector).cast("array<double>").alias("v")).collect(), key=lambda r: r.h)]), dim)
    residual = x - centres[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)]
    width = dim // parts
    books = np.stack([_padded(lloyd(residual[:, p * width : (p + 1) * width], min(256, len(x)), 1, 8)) for p in range(parts)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, dim)
            v /= np.sqrt((v**2).sum(1))[:, None]
            r = v - centres[b.column(2).to_numpy()]
            codes = np.stack([((r[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in codes], pa.binary())], names=[key, vector, "cluster", "code"])

    placed = assigned(rows.select(key, vector), centres, vector).select(key, F.col(vector).cast("array<double>").alias(vector), "cluster")
    coded = placed.mapInArrow(code, f"{key} {dict(rows.dtypes)[key]}, {vector} array<double>, cluster int, code binary")
    return Index(coded, centres, books, key, vector)


def _padded(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.full((256 - len(book), book.shape[1]), 1e9)])


def probes(centres: np.ndarray, query: np.ndarray, nprobe: int = 11, most: int = 16, slack: float = 0.02) -> list[int]:
    """The nearest lists, and further ones not much farther than the last of them."""
    d = ((centres - query) ** 2).sum(1)
    order = np.lexsort((np.arange(len(d)), d))
    n = min(nprobe, len(order))
    while n < min(most, len(order)) and d[order[n]] <= d[order[n - 1]] * (1 + slack):
        n += 1
    return order[:n].tolist()


def search(ix: Index, query: list[float], k: int = 10, nprobe: int = 11, candidates: int = 50, budget: int | None = None) -> DataFrame:
    """key, score and fetch_budget_exhausted of the k best: lists are probed, codes compared by tables of distances, the best scored exactly.

    budget: bytes of exact vectors that may be fetched.
    """
    q, key, centres, books = np.array(vectors.unit(query)), ix.key, ix.centres, ix.codebooks
    chosen = probes(centres, q, nprobe)
    parts, _, width = books.shape
    tables = {c: np.stack([((books[p] - (q - centres[c])[p * width : (p + 1) * width]) ** 2).sum(1) for p in range(parts)]) for c in chosen}

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            d = np.array([tables[c][np.arange(parts), x].sum() for c, x in zip(b.column(2).to_pylist(), codes)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.float64())], names=[key, "far"])

    kind = dict(ix.rows.dtypes)[key]
    probed = ix.rows.where(F.col("cluster").isin(chosen))
    fetched = candidates if budget is None else min(candidates, budget // (4 * len(q)))
    best = probed.select(ix.key, "code", "cluster").mapInArrow(far, f"{ix.key} {kind}, far double").orderBy("far", ix.key).limit(fetched)
    exact = vectors.scored(ix.rows.join(F.broadcast(best.select(ix.key)), ix.key), query, ix.vector)
    return exact.orderBy(F.desc("score"), F.asc(ix.key)).limit(k).select(ix.key, "score", F.lit(fetched < candidates).alias("fetch_budget_exhausted"))


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: the share of exact answers that were found."""
    hit = found.select(key).distinct().withColumn("__hit", F.lit(1))
    return exact.select(key).distinct().join(hit, key, "left").agg((F.sum(F.coalesce("__hit", F.lit(0))) / F.count("*")).alias("recall"))


def agreement(a: DataFrame, b: DataFrame, by: str = "query", key: str = "vec_id") -> DataFrame:
    """by, jaccard and recall of two generations' answers to the same queries."""
    x, y = (d.groupBy(by).agg(F.collect_set(key).alias(n)) for d, n in ((a, "x"), (b, "y")))
    both = x.join(y, by, "full_outer").withColumns({c: F.coalesce(c, F.array().cast(f"array<{dict(a.dtypes)[key]}>")) for c in "xy"})
    met = F.size(F.array_intersect("x", "y"))
    return both.select(by, (met / F.greatest(F.size(F.array_union("x", "y")), F.lit(1))).alias("jaccard"), (met / F.greatest(F.size("x"), F.lit(1))).alias("recall"))


# Sampling.


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Places of a sample by stratum: a quarter shared equally (one at least), the rest by size, remainders to the largest."""
    if not sizes or not sum(sizes.values()) or not most:
        return {}
    floor = max(1, most // 4 // len(sizes))
    quota = {s: min(floor, n) for s, n in sorted(sizes.items())}
    rest, total = max(0, most - sum(quota.values())), sum(sizes.values())
    exact = {s: rest * n for s, n in sorted(sizes.items())}
    for s, x in exact.items():
        quota[s] += min(x // total, sizes[s] - quota[s])
    left = max(0, most - sum(quota.values()))
    for s in sorted((s for s in exact if quota[s] < sizes[s]), key=lambda s: (-(exact[s] % total), s))[:left]:
        quota[s] += 1
    return quota


def stratified(rows: DataFrame, stratum: str, most: int = MOST_SAMPLE, key: str = "event_id", seed: int = 0) -> DataFrame:
    """Up to `most` rows by quotas of the strata, in each those of least ticket (a hash of seed and key)."""
    sizes = {str(r[0]): r[1] for r in rows.groupBy(stratum).count().collect()}
    quota = quotas(sizes, min(most, MOST_SAMPLE))
    if not quota:
        return rows.limit(0)
    ticket = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    of = F.create_map(*[x for s, n in quota.items() for x in (F.lit(s), F.lit(n))])
    limit = F.element_at(of, F.col(stratum).cast("string"))
    # Spark keeps only the first rows of each group before the shuffle, since the rank is bounded.
    ranked = rows.withColumn("__t", ticket).withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__t", key)))
    return ranked.where(F.col("__r") <= max(quota.values())).where(F.col("__r") <= limit).drop("__t", "__r")


# Standing semantic state.

MOST_STANDING_K = 10_000


class StandingTopK:
    """The k best of rows that come and go by key; an epoch is taken whole or not at all, and gives the change of the answer."""

    def __init__(self, rows: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding"):
        if not 0 < k <= MOST_STANDING_K:
            raise Refused("TooLargeK", str(k))
        from plumbago.sources.tables import written

        self.query, self.k, self.key, self.vector, self._written = vectors.unit(query), k, key, vector, written
        self.current = written(rows.limit(0).select(key, vector), "standing-rows")
        self.answer = self._answer(self.current)
        self.apply(rows.select(key, vector))

    def _answer(self, rows: DataFrame) -> DataFrame:
        return self._written(vectors.top_k(rows, self.query, self.k, self.key, self.vector).select(self.key, "score"), "standing-top")

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, lenient: bool = False) -> DataFrame:
        """(key, score, __w) of what the answer lost and gained. removed: keys; unknown ones are refused unless lenient."""
        rows, kept = self.current, self.current
        if removed is not None:
            gone = removed.select(self.key).distinct()
            if not lenient and not gone.join(rows, self.key, "left_anti").isEmpty():
                raise Refused("UnknownRetraction")
            kept = rows.join(gone, self.key, "left_anti")
        if added is not None:
            new = added.select(self.key, self.vector)
            if not new.groupBy(self.key).count().where("count > 1").isEmpty() or not new.join(kept, self.key, "left_semi").isEmpty():
                raise Refused("DuplicateKey")
            kept = kept.unionByName(new)
        kept = self._written(kept, "standing-rows")
        answer, before = self._answer(kept), self.answer
        self.current, self.answer = kept, answer
        both = answer.withColumn("__w", F.lit(1)).unionByName(before.withColumn("__w", F.lit(-1)))
        return both.groupBy(self.key, "score").agg(F.sum("__w").alias("__w")).where("__w <> 0")

    def retract(self, keys: DataFrame) -> DataFrame:
        """As apply(removed=keys), with unknown keys passed over."""
        return self.apply(removed=keys, lenient=True)

    def merge(self, other: "StandingTopK") -> DataFrame:
        """Take in the rows of another state of the same plan; keys that both hold are refused."""
        if (self.query, self.k) != (other.query, other.k):
            raise Refused("PlansDiffer")
        return self.apply(other.current)


def standing_groups(rows: DataFrame, anchors: list[list[float]], key: str = "vec_id", vector: str = "embedding", cost: str | None = None, error: str | None = None) -> DataFrame:
    """group_id, members, avg_cost, error_rate and exemplar (nearest, then least key) of the rows nearest to each anchor."""
    placed = vectors.assigned(rows, anchors, vector)
    return placed.groupBy("group_id").agg(
        F.count("*").alias("members"),
        F.avg(F.col(cost) if cost else F.lit(0.0)).alias("avg_cost"),
        F.avg((F.col(error) if error else F.lit(False)).cast("int")).alias("error_rate"),
        F.min_by(key, F.struct((-F.col("score")).alias("s"), key)).alias("exemplar"),
    )


def may_migrate(old: DataFrame, new: DataFrame, allowance: int, key: str = "vec_id") -> bool:
    """Whether two rankings (key, score) of one input differ in at most `allowance` places."""
    place = lambda d, n: d.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc(key))).alias(n))
    both = place(old, "a").join(place(new, "b"), key, "full_outer")
    return both.where("not (a <=> b)").count() <= allowance


def routed(rows: DataFrame, state_bytes: int, budget: int, incremental: Callable[[], DataFrame], exact: Callable[[], DataFrame]) -> DataFrame:
    """The kept answer where its state fits the budget, else one computed anew."""
    return incremental() if state_bytes <= budget else exact()
