"""Near-duplicates by SimHash fingerprints, found through Golay-code keys.

A fingerprint has 64 bits: a bit is 1 if it is set in over half the 64-bit
hashes of the text's word shingles. Two fingerprints are linked if at most
three bits differ.

Candidates. The fingerprint is cut into segments of 22, 21 and 21 bits, each
read as a word of the perfect binary Golay code [23, 12, 7]. Decoding a word
and all words one bit away gives at most six codeword indices (one, if the
word is within two bits of a codeword), and words up to two bits apart always
share one. Three differing bits leave, by the pigeonhole principle, either a
segment without error beside one with at most one, or one error in each:
  - for each ordered pair of segments: the first as it is, the second's indices;
  - the indices of the first two segments, with each half of the third as it is.
Every pair that must be linked thus meets under a key of 33 or more bits.

Verification works on distinct fingerprints. The members of a key are searched
from the least to the next, each member once, and only the links of the search
tree are passed on: no more than members, and equal members under many keys
give equal links, which are dropped before they are joined. A key of
more than MOST members is not searched: its members are dealt by each quarter of
the bits not yet agreed on (three differing bits leave one quarter equal), in
rounds, until a group is small or FREE bits are left to differ in, so that no
task ever holds more than 2^FREE fingerprints of 8 bytes.

Edge cases: a null or empty text, or one of white space alone, has fingerprint
zero, and zero is linked like any other; a text with fewer words than a
shingle is one shingle; rows with a null id have no component but take part in
no links; equal ids and repeated rows fall into one component; an empty table
gives an empty table; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import SHINGLE_WORDS, SIMILARITY, arrow_rows, drop_written, id_text, in_parts, only_cache, written
from plumbago.llm.components import components

BITS, SEED = 3, 42
#: Members of a key that are searched at once; free bits below which a group is not dealt further.
MOST, FREE = 8192, 16
#: Generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ONES = np.arange(23, dtype=np.int64)


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every shingle of enough words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts))


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle of a text, or of all words where they are fewer; nothing without words. A part of the text at a time."""
    rest: list[bytes] = []
    short = True
    for part in in_parts(text):
        rest += part.translate(_LOWER).split()
        if len(rest) >= shingle:
            yield _hashes(rest, shingle)
            short, rest = False, rest[len(rest) - shingle + 1 :]
    if short and rest:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(rest), SEED)], dtype=np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in h."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 16384):
        counts += np.unpackbits(np.ascontiguousarray(h[k : k + 16384]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return counts


def majority(counts: np.ndarray, n: int) -> np.uint64:
    """The bits set in over half of n hashes."""
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        counts += bit_counts(h)
        n += len(h)
    return int(majority(counts, n))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits of a word, and the error for each remainder."""

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= np.where(v >> bit & 1, GOLAY << bit - 11, 0)
        return v

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    error = np.zeros(1 << 11, np.int64)
    one = 1 << _ONES
    for a in one:
        for b in one:
            patterns = a | b | one  # of weight three, two where some coincide, one where all do
            error[low[patterns & 0xFFF] ^ high[patterns >> 12]] = patterns
    return low, high, error


def decode(v: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (v ^ error[low[v & 0xFFF] ^ high[v >> 12]]) >> 11


def nearby(v: np.ndarray) -> np.ndarray:
    """(n, 6): indices of the codewords that v and its neighbours decode to; -1 fills the rest."""
    found = np.sort(decode((v[:, None] ^ np.concatenate([[0], 1 << _ONES])[None, :]).ravel()).reshape(len(v), 24), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's keys."""
    p = prints.view(np.uint64)
    part = [(p >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [nearby(x) for x in part]
    rows, out = [], []

    def add(tag: int, exact: np.ndarray, index: np.ndarray) -> None:
        """index: (n, k), negative where there is none."""
        r, c = np.nonzero(index >= 0)
        rows.append(r)
        out.append(np.int64(tag) << 48 | exact[r] << 24 | index[r, c])

    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        add(tag, part[i], near[j])
    two = np.where((near[0][:, :, None] < 0) | (near[1][:, None, :] < 0), -1, near[0][:, :, None] << 12 | near[1][:, None, :]).reshape(len(p), 36)
    add(6, part[2] & 0x3FF, two)
    add(7, part[2] >> 10, two)
    return np.concatenate(rows), np.concatenate(out)


_NO_LINKS = np.zeros((0, 2), np.uint64)


def tree(prints: np.ndarray, bits: int = BITS, names: np.ndarray | None = None) -> np.ndarray:
    """(n, 2): links of a spanning forest of fingerprints at most `bits` apart, searched from the least name on.

    prints: (n, words) of 64 bits each; names: what to call them, else by their first word.
    """
    if len(prints) <= 32:  # most groups are small, and most of them have nothing close
        near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= bits
        if np.count_nonzero(near) == len(prints):
            return _NO_LINKS
    name = (prints[:, 0] if names is None else names).view(np.uint64)
    order = np.argsort(name, kind="stable")
    left, name = prints.view(np.uint64)[order], name[order]
    links = [np.zeros((0, 2), np.uint64)]
    while len(left) > 1:
        open_ = deque([(left[0], name[0])])
        left, name = left[1:], name[1:]
        while open_ and len(left):
            x, called = open_.popleft()
            close = np.bitwise_count(left ^ x).sum(axis=1) <= bits
            if close.any():
                met = name[close]
                open_ += zip(left[close], met)
                links.append(np.stack([met, np.full(len(met), called)], axis=1))
                left, name = left[~close], name[~close]
    return np.concatenate(links)


def _to_roots(links: np.ndarray) -> np.ndarray:
    """Each end of a link, linked to the least that the links lead to: different sets of one cluster mostly share the least members."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links.tolist():
        a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
        root[max(a, b)] = min(a, b)
    return np.array([(x, r) for x in root if (r := find(x)) != x], np.uint64).reshape(-1, 2)


def quarters(mask: int) -> list[int]:
    """mask with one quarter more of the bits that it leaves free, in each of four ways."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::4]) for k in range(4)]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _signed(column: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(column).view(np.int64))


def _by_key(rows: DataFrame, words: list[str], each, crowd, schema: str) -> DataFrame:
    """Searches the rows (key, mask and 64-bit words) of every key and mask with more than one row.

    each([(key, mask, words)]) gives batches for whole keys; crowd(key, mask, words, first), if it takes the
    key, for the parts of one that has more than MOST rows, which are not held; first is its least row.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, mask and words; a key may run over several batches."""
        only_cache()
        at, held, n, first = None, [], 0, None
        for batch in (b for b in batches if b.num_rows):
            key, mask = (batch.column(k).to_numpy() for k in (0, 1))
            fp = np.stack([c.to_numpy() for c in batch.columns[2:]], axis=1).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (mask[1:] != mask[:-1])) + 1, [len(key)]])
            begin, groups = 0, []
            if at == (int(key[0]), int(mask[0]) % 2**64):
                held.append(fp[: cuts[1]])
                n += int(cuts[1])
                if n > MOST and (out := crowd(*at, held, first)) is not None:
                    yield from out
                    held = []
                if len(cuts) == 2:
                    continue
                begin = 1
            if n > 1 and held:
                groups.append((*at, np.concatenate(held)))
            for k in (np.flatnonzero(np.diff(cuts)[begin:-1] > 1) + begin).tolist():
                here = int(key[cuts[k]]), int(mask[cuts[k]]) % 2**64, fp[cuts[k] : cuts[k + 1]]
                if len(here[2]) > MOST and (out := crowd(*here[:2], [here[2]], here[2][0])) is not None:
                    yield from out
                else:
                    groups.append(here)
            if groups:
                yield from each(groups)
            at, held, first = (int(key[-1]), int(mask[-1]) % 2**64), [fp[cuts[-2] :]], fp[cuts[-2]]
            n = len(held[0])
            if n > MOST and (out := crowd(*at, held, first)) is not None:
                yield from out
                held = []
        if n > 1 and held:
            yield from each([(*at, np.concatenate(held))])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "mask", *words).repartition(n, "key", "mask").sortWithinPartitions("key", "mask", words[0]).mapInArrow(search, schema)


def _searched(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b, null) of all keys, and what has to be searched under smaller keys: (key, fp, mask)."""
    names = ["a", "b", "mask"]

    def each(groups: list) -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate([tree(fp, bits) for _, _, fp in groups]), axis=0)
        yield pa.RecordBatch.from_arrays([_signed(found[:, 0]), _signed(found[:, 1]), pa.nulls(len(found), pa.int64())], names=names)

    def crowd(key: int, mask: int, parts: list, first: np.ndarray) -> list | None:
        """Under each of four smaller keys; not if few bits are left to differ in."""
        if 64 - mask.bit_count() <= FREE:
            return None
        out = []
        for fp in (p[:, 0] for p in parts):
            for wider in quarters(mask):
                salt = np.uint64(xxhash.xxh3_64_intdigest(f"{key} {wider}".encode()))
                x = ((fp & np.uint64(wider)) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) ^ salt
                out.append(pa.RecordBatch.from_arrays([_signed(x), _signed(fp), _signed(np.full(len(fp), wider, np.uint64))], names=names))
        return out

    return written(_by_key(rows, ["fp"], each, crowd, "a long, b long, mask long"), "searched-keys")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between the distinct values of prints.fp that connect what is at most `bits` (3 or fewer) apart."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            fp = b.column(0).to_numpy()
            for k in range(0, len(fp), 2000):
                part = np.ascontiguousarray(fp[k : k + 2000])
                row, key = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int64)), pa.array(part[row])], names=["key", "mask", "fp"])

    if bits > 3:
        raise ValueError("the keys are complete for up to three differing bits")
    spark = prints.sparkSession
    arrow_rows(spark, 10_000)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt before it grows: each fingerprint has up to 84 keys.
    rows = prints.select("fp").distinct().repartition(n, "fp").mapInArrow(keyed, "key long, mask long, fp long")
    found, parts = _searched(rows, bits), []
    while True:
        parts.append(found.where("mask is null").select("a", "b"))
        crowd = found.where("mask is not null").select(F.col("a").alias("key"), "mask", F.col("b").alias("fp"))
        if crowd.isEmpty():
            return functools.reduce(DataFrame.unionByName, parts).distinct()
        found = _searched(crowd.distinct(), bits)


def _named(prints: DataFrame, found: DataFrame) -> DataFrame:
    """fp and component_id, the least doc_id of all fingerprints that links lead to."""
    member = components(found).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = written(first.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(placed.join(least, "root").select("fp", "component_id"), "components")


def linked_components(docs: DataFrame, shingle: int = 3, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the smallest id that links lead to from the document."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    found = written(links(prints.where("doc_id is not null"), bits), "fingerprint-links")
    named = _named(prints.where("doc_id is not null"), found)
    drop_written(found)
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# Near-duplicates by a similarity: the same keys on longer fingerprints make candidates, the shingle sets decide.

WORDS, TABLES, EXACT, NEAR, SPREAD = 8, 64, 10, 28, 5
#: So many tables are searched first; under a key of the others, what these link has nothing to look for in itself.
EARLY = 4
#: Shingle hashes that are compared with each other at once.
BLOCK = 1 << 20


def shingle_set(text: bytes, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of a text's shingles, each once and in order; none without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def set_name(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes())


def sketch(h: np.ndarray) -> np.ndarray:
    """SimHash of 512 bits over a set of shingle hashes; zero for the empty set."""
    out = np.zeros(WORDS, np.uint64)
    if not len(h):
        return out
    for w in range(WORDS):
        x = h * np.uint64(0x9E3779B97F4A7C15 + 2 * w * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out[w] = majority(bit_counts(x), len(x))
    return out


@functools.cache
def _places() -> tuple[np.ndarray, np.ndarray]:
    """The bits of a sketch that each table reads, for its Golay word and as they are."""
    rng = np.random.default_rng(SEED)
    chosen = np.stack([rng.choice(64 * WORDS, 23 + EXACT, replace=False) for _ in range(TABLES)])
    return chosen[:, :23], chosen[:, 23:]


def table_keys(sketches: np.ndarray, tables: range = range(TABLES)) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for every one of the tables the codeword indices near its word, each with the table's exact bits."""
    bits = np.unpackbits(np.ascontiguousarray(sketches).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    rows, out = [], []
    for t in tables:
        golay, exact = (x[t] for x in _places())
        near = nearby(bits[:, golay] @ (1 << _ONES))
        r, c = np.nonzero(near >= 0)
        rows.append(r)
        out.append(np.int64(t) << 40 | (bits[:, exact] @ (1 << np.arange(EXACT)))[r] << 12 | near[r, c])
    return np.concatenate(rows), np.concatenate(out)


def alike(names: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of sets whose Jaccard similarity is at least this.

    Sets that are alike share one of their rarest elements (as many as may be
    missing, and one more); only those that do are compared, or all that are
    left where they are fewer.
    """
    sizes = np.array([len(x) for x in sets])
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ranks = [np.sort(x) for x in np.split(rank[place], np.cumsum(sizes)[:-1])]
    rare = [x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1] for x in ranks]
    element, member = np.concatenate(rare), np.repeat(np.arange(len(sets)), [len(x) for x in rare])
    order = np.argsort(element, kind="stable")
    member, edge = member[order], np.searchsorted(element[order], np.arange(len(often) + 1))
    mark, links = np.zeros(len(often), bool), []
    left, is_left = np.arange(len(sets)), np.ones(len(sets), bool)
    while len(left) > 1:
        open_, is_left[left[0]], left = [left[0]], False, left[1:]
        while open_ and len(left):
            x = open_.pop()
            from_, to = edge[rare[x]], edge[rare[x] + 1]
            if (to - from_).sum() < len(left):
                met = np.unique(np.concatenate([member[a:b] for a, b in zip(from_, to)] or [left[:0]]))
                met = met[is_left[met]]
            else:
                met = left
            met = met[np.minimum(sizes[met], sizes[x]) >= similarity * np.maximum(sizes[met], sizes[x]) - 1e-9]
            mark[ranks[x]] = True
            both = np.array([np.count_nonzero(mark[ranks[y]]) for y in met])
            mark[ranks[x]] = False
            met = met[both / np.maximum(sizes[met] + sizes[x] - both, 1) >= similarity] if len(met) else met
            if len(met):
                is_left[met] = False
                left = left[is_left[left]]
                links += [(names[x], names[y]) for y in met]
                open_ += met.tolist()
    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of documents linked by shingle sets of at least this Jaccard similarity.

    Sketches only make candidates. Sets of equal size and Jaccard similarity s
    have cosine 2s / (1 + s), and a bit of two sketches differs with the chance
    of its angle over pi. A table finds a pair at 0.8 with chance 0.12; all miss
    it with less than 0.001 (more for sets of a few shingles, whose bits differ
    more often). Among the rows of a key, only those with a neighbour within
    NEAR bits of the first word and a half (a pair at 0.8 differs in more with
    chance 0.0001) go on, and are compared by whole sketches, with
    SPREAD standard deviations allowed beyond the expected difference; the rows
    of a key of more than MOST are all taken for candidates. EARLY of the tables
    are searched first. The rows of the others carry the part that these have
    put their sketch in, and where all that would go on is one part, none does,
    so that a large group is not fetched and compared again for every key that
    its members share. Sketches with equal
    first words, or linked in this way, form a group; inside each group the
    shingle sets themselves are compared, and only those alike are linked.
    Equal sets are found by a 64-bit hash of the set.
    """
    arrow_rows(docs.sparkSession)
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    differ = int(64 * WORDS * chance + SPREAD * math.sqrt(64 * WORDS * chance * (1 - chance)))
    columns = [f"w{k}" for k in range(WORDS)]

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in (b for b in batches if b.num_rows):
            sets = [shingle_set(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            s = np.stack([sketch(x) for x in sets]).view(np.int64)
            name = np.array([set_name(x) for x in sets], np.uint64)
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(name), size, *(_signed(s[:, k]) for k in range(WORDS))], names=["doc_id", "name", "n", *columns])

    def keyed(tables: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows are the words of a sketch and its part, 0 where it is none with others."""
            only_cache()
            for b in batches:
                s = np.stack([c.to_numpy() for c in b.columns], axis=1)
                for k in range(0, len(s), 500):
                    some = s[k : k + 500]
                    row, key = table_keys(np.ascontiguousarray(some[:, :WORDS]).view(np.uint64), tables)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.zeros(len(key), np.int64), some[row, 0], some[row, 1] & 0xFFFFFFFF, some[row, WORDS])], names=["key", "mask", "w0", "half", "part"])

        return run

    def part_of(fp: np.ndarray) -> np.ndarray:
        return np.where(fp[:, 2] == 0, fp[:, 0], fp[:, 2])

    def neighbours(groups: list) -> Iterator[pa.RecordBatch]:
        """The rows with a neighbour, if of several parts, under a hash of their set: what meets under many keys is compared once."""
        sets = {}
        for _, _, fp in groups:
            part = part_of(fp)
            links = tree(fp[:, :2], NEAR) if (part != part[0]).any() else _NO_LINKS
            if len(links):
                met = np.unique(links)
                part = part[np.isin(fp[:, 0], met)]
                if (part != part[0]).any():
                    sets[xxhash.xxh3_64_intdigest(met.tobytes())] = met
        if sets:
            name = np.repeat(np.array(list(sets), np.uint64), [len(x) for x in sets.values()])
            met = np.concatenate(list(sets.values()))
            yield pa.RecordBatch.from_arrays([_signed(name), _signed(met), pa.nulls(len(met), pa.int64())], names=["key", "w0", "b"])

    def crowd(key: int, mask: int, parts: list, first: np.ndarray) -> list:
        """What is not of one part with the least row is to be linked with it."""
        every = np.concatenate(parts)
        every = every[part_of(every) != part_of(first[None])[0], 0]
        return [pa.RecordBatch.from_arrays([_signed(np.zeros(len(every), np.uint64)), _signed(every), _signed(np.full(len(every), first[0]))], names=["key", "w0", "b"])]

    def compared(groups: list) -> Iterator[pa.RecordBatch]:
        """The last column says what a row stands for; rows that all stand for one thing have nothing to link."""
        apart = [fp for _, _, fp in groups if (fp[:, -1] != fp[0, -1]).any()]
        found = _to_roots(np.concatenate([_NO_LINKS, *(tree(fp[:, 1:-1], differ, fp[:, -1]) for fp in apart)]))
        yield pa.RecordBatch.from_arrays([_signed(found[:, 0]), _signed(found[:, 1])], names=["a", "b"])

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = id_text(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    prints = written(texts.mapInArrow(sketches, "doc_id long, name long, n long, " + ", ".join(f"{c} long" for c in columns)), "sketches")
    distinct = written(prints.select(*columns).distinct().withColumn("sketch", F.xxhash64(*columns)), "distinct-sketches")
    arrow_rows(spark, 10_000)
    # Equal first words, and crowded keys, name sketches by their first word: all of them hang on the least sketch of it.
    by_word = written(distinct.groupBy("w0").agg(F.min("sketch").alias("b"), F.count("*").alias("several")), "first-words")
    same = distinct.join(by_word.where("several > 1"), "w0").where("sketch <> b").select(F.col("sketch").alias("a"), "b")

    def close(sketches: DataFrame, tables: range, what: str) -> DataFrame:
        """What meets under a key of these tables; sketches: their words, and the part that each is in, if with others."""
        rows = sketches.repartition(n, *columns).mapInArrow(keyed(tables), "key long, mask long, w0 long, half long, part long")
        return written(_by_key(rows, ["w0", "half", "part"], neighbours, crowd, "key long, w0 long, b long").distinct(), what)

    def met(chosen: DataFrame, standing: DataFrame) -> DataFrame:
        """Links (a, b) from rows of close, between what sketches stand for (standing: sketch, its words, part)."""
        whole = chosen.where("b is null").select("key", F.lit(0).cast("long").alias("mask"), "w0").join(standing, "w0")
        near = _by_key(whole, ["sketch", *columns, "part"], compared, lambda *_: None, "a long, b long")
        named = by_word.join(standing.select("sketch", "part"), F.col("b") == F.col("sketch")).select(F.col("w0").alias("i"), F.col("part").alias("s"))
        crowded = chosen.where("b is not null and w0 <> b").select("w0", F.col("b").alias("o"))
        crowded = crowded.join(named, F.col("w0") == F.col("i")).select("o", F.col("s").alias("a")).join(named, F.col("o") == F.col("i")).select("a", F.col("s").alias("b"))
        return near.unionByName(crowded.where("a <> b")).distinct()

    met_first = close(distinct.select(*columns, F.lit(0).cast("long").alias("part")), range(EARLY), "early-close")
    first = written(met(met_first, distinct.withColumn("part", F.col("sketch"))).unionByName(same), "early-links")
    linked = components(first).select(F.col("node").alias("m"), F.col("component").alias("tied"))
    standing = written(distinct.join(linked, F.col("sketch") == F.col("m"), "left").withColumn("part", F.coalesce("tied", "sketch")).drop("m"), "standing")
    met_then = close(standing.select(*columns, F.coalesce("tied", F.lit(0)).cast("long").alias("part")), range(EARLY, TABLES), "late-close")
    candidates = written(met(met_then, standing), "sketch-links")
    for done in (met_first, met_then, by_word, first):
        drop_written(done)
    linked = components(candidates).select(F.col("node").alias("m"), "component")
    group = standing.join(linked, F.col("part") == F.col("m"), "left").select("sketch", F.coalesce("component", "part").alias("root"))
    arrow_rows(spark)
    firsts = prints.groupBy("name").agg(F.min(F.struct("doc_id", F.xxhash64(*columns).alias("sketch"), "n")).alias("f")).select("name", "f.*")
    placed = written(firsts.join(group, "sketch", "left").select("name", F.col("doc_id").alias("i"), "n", F.coalesce("root", "sketch").alias("root")), "groups")
    for done in (distinct, candidates, standing):
        drop_written(done)
    found = _alike_in_groups(texts, placed, similarity, shingle)
    named = _named(prints.select("doc_id", F.col("name").alias("fp")), found)
    return prints.select("doc_id", F.col("name").alias("fp")).join(named, "fp").select("doc_id", "component_id")


def _alike_in_groups(texts: DataFrame, placed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links that connect the sets of each group (placed: name, i, n, root) that are alike.

    A task compares blocks of about BLOCK shingle hashes at most. Of a group
    with more, each block is compared by itself, then the least sets of what
    hangs together in the blocks, and last all that is not in the largest part
    then with all the group, block by block; so nothing is missed, and a group
    of near copies, being one part by then, is read a fixed number of times.
    """
    spark = texts.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingle sets asked for; another text of the same id has another name."""
        only_cache()
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(3).cast(pa.binary()).to_pylist()]
            right = pa.array([set_name(x) == n % 2**64 for x, n in zip(sets, b.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in sets], pa.binary())], names=["root", "name", "n", "hashes"]).filter(right)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by root and block; a block may run over several batches."""
        only_cache()
        at, held = None, {}

        def found() -> list[tuple[int, int]]:
            return alike([x % 2**64 for x in held], list(held.values()), similarity) if len(held) > 1 else []

        for b in batches:
            links = []
            for root, block, name, h in zip(*(c.to_pylist() for c in b.columns)):
                if (root, block) != at:
                    links += found()
                    at, held = (root, block), {}
                held[name] = np.frombuffer(h, np.uint64)
            yield batch(links)
        yield batch(found())

    def batch(links: list) -> pa.RecordBatch:
        pairs = np.array(links, np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([_signed(pairs[:, 0]), _signed(pairs[:, 1])], names=["a", "b"])

    def linked(rows: DataFrame, what: str) -> DataFrame:
        """rows: root, block, name, hashes."""
        dealt = rows.select("root", "block", "name", "hashes").repartition(parallel, "root", "block").sortWithinPartitions("root", "block")
        return written(dealt.mapInArrow(compare, "a long, b long"), what)

    def blocks(rows: DataFrame, total: str) -> F.Column:
        return F.ceil(F.col(total) / BLOCK).cast("int")

    def parts(links: DataFrame, rows: DataFrame) -> DataFrame:
        part = components(links).select(F.col("node").alias("m"), F.col("component").alias("part"))
        return rows.select("root", "name", "n").join(part, F.col("name") == F.col("m"), "left").select("root", "name", "n", F.coalesce("part", "name").alias("part"))

    several = placed.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("members")).where("members > 1").select("root", "total")
    asked = placed.join(several, "root").select("root", "name", "n", "i").join(texts, F.col("doc_id") == F.col("i")).select("root", "name", "n", "text")
    sets = written(asked.mapInArrow(sets_of, "root long, name long, n long, hashes binary"), "shingle-sets")
    sizes = written(several, "group-sizes")
    own = sets.join(sizes, "root").withColumn("of", blocks(sets, "total")).withColumn("block", F.pmod(F.xxhash64("name"), F.col("of")))
    found = linked(own, "alike")
    large = sizes.where(F.col("total") > BLOCK)
    if large.isEmpty():
        return found
    hot = written(own.join(large.select("root"), "root", "left_semi"), "large-groups")
    first = parts(found, hot).where("name = part")
    least = hot.drop("of", "block").join(first.select("name"), "name", "left_semi")
    of_least = least.groupBy("root").agg(F.sum("n").alias("all_n"))
    second = linked(least.join(of_least, "root").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "name"), blocks(least, "all_n"))), "alike-parts")
    both = written(found.unionByName(second), "alike-so-far")
    in_part = written(parts(both, hot), "parts")
    largest = in_part.groupBy("root", "part").agg(F.sum("n").alias("size")).groupBy("root").agg(F.max_by("part", F.struct("size", "part")).alias("largest"))
    rest = written(in_part.join(largest, "root").where("part <> largest").select("root", "name", "n"), "apart")
    if rest.isEmpty():
        return both
    of_rest = rest.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("rest_of"))
    mine = hot.join(rest.select("name"), "name", "left_semi").join(of_rest, "root").withColumn("left", F.pmod(F.xxhash64(F.lit(2), "name"), F.col("rest_of")))
    mine = mine.withColumn("right", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - F.lit(1).cast("long"))))
    others = hot.join(of_rest, "root").withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_of") - F.lit(1).cast("long")))).withColumn("right", F.col("block"))
    pairs = mine.select("root", "name", "hashes", "left", "right").unionByName(others.select("root", "name", "hashes", "left", "right"))
    third = linked(pairs.withColumn("block", F.xxhash64("left", "right")), "alike-apart")
    return written(both.unionByName(third), "alike-all")


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but those with a near-duplicate of smaller id in their component; columns as they are.

    Rows without an id stay; repeated rows of the smallest id stay together. Columns of any name pass through.
    """
    linked = near_duplicates(docs, similarity, id_col=id_col, text_col=text_col)
    gone = written(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-duplicates")
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id")).join(gone, F.col("id") == F.col("gone"), "left_anti")
    return kept.select("row.*")
