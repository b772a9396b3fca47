"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

A text becomes symbols; an agenda holds every adjacent pair whose union is a
piece, ordered by score and then from the left, and the best pair is merged
until none is left. Characters without a piece fall back to their bytes.

No piece spans certain boundaries (before a space mark, around a line end,
between letters and punctuation; derived from the vocabulary when it is
loaded), so a text is cut there and each distinct stretch is merged once while a
worker remembers it. All stretches new in a part of an Arrow batch are checked
against the sentencepiece library, ids and decoded text alike; a difference is
an error that names the document, or the library's ids are taken if asked for.

Edge cases: a null text is the empty text and yields the end id alone; very
long texts are cut into stretches a part at a time, and long stretches merged
in O(n log n) and not remembered; repeated rows and
equal ids give equal results; an empty table gives an empty table; columns
other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import PART, Recent, arrow_rows, id_text, only_cache

SPACE = "▁"
#: Bytes of stretches that a worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 96 << 20, 48
#: Stretches that are merged side by side, and a rank behind all others.
SIDE_BY_SIDE, NONE = 4096, np.iinfo(np.int32).max
_loaded: dict[str, "Pieces"] = {}


def load(path: str) -> "Pieces":
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            blob = f.read()
        model = pb.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type vocabularies with byte fallback are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only identity normalisation with a leading space mark is supported")
        kind = pb.ModelProto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.end = self.library.eos_id()
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.order = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.surface = [b""] * len(model.pieces)
        for piece, i in self.id_of.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_id.items():
            self.surface[i] = bytes([byte])
        self.char_id = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        self.rank = np.full(len(model.pieces), NONE, np.int32)
        self.rank[list(self.id_of.values())] = np.unique([self.order[x] for x in self.id_of], return_inverse=True)[1]
        pairs = {self.id_of[p[:k]] << 32 | self.id_of[p[k:]]: i for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of}
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.union = np.array([pairs.get(x, -1) for x in self.pairs.tolist()], np.int32)
        self.stretch = re.compile(self._stretches())
        self.ids = Recent(REMEMBERED)
        self.differing: set[str] = set()

    def _stretches(self) -> str:
        """A pattern for stretches of plain text (spaces as spaces) that no piece crosses, checked against every piece."""
        pairs = {(a, b) for p in self.id_of for a, b in zip(p, p[1:])}
        if any(b == SPACE != a for a, b in pairs) or any("\n" in x for x in pairs):
            return r"(?s).+"  # no safe boundary: whole texts
        marks = {c for p in self.id_of for c in p if unicodedata.category(c)[0] not in "LNMZ"} - {SPACE, "\n"}
        while bad := {x for a, b in pairs if SPACE not in (a, b) and (a in marks) != (b in marks) for x in (a, b) if x in marks}:
            marks -= bad
        if not marks:
            return rf"[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+|\n"
        m = "".join(re.escape(c) for c in sorted(marks))
        return rf"[ {SPACE}]*[{m}]+|[ {SPACE}]*[^ {SPACE}\n{m}]+|[ {SPACE}]+|\n"

    def merge(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marked already."""
        order, s, n = self.order.get, list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            both = s[i] + s[i + 1]
            if (k := order(both)) is not None:
                agenda.append((k, i, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i]
            if not s[i] or j >= n or len(s[i]) + len(s[j]) != len(both) or s[i] + s[j] != both:
                continue  # one of the two has been merged since
            s[i], s[j] = both, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (score := order(x := both + s[k])) is not None:
                    heapq.heappush(agenda, (score, i, x))
            if (h := before[i]) >= 0 and (score := order(x := s[h] + both)) is not None:
                heapq.heappush(agenda, (score, h, x))
        out: list[int] = []
        for x in s:
            if x:
                i = self.id_of.get(x)
                if i is None:
                    out += [self.byte_id[b] for b in x.encode()]
                else:
                    out.append(i)
        return out

    def _unions(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair of pieces makes, and its rank; negative numbers make none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        union = np.where(self.pairs[at] == key, self.union[at], -1)
        return union, np.where(union < 0, NONE, self.rank[union])

    def merge_many(self, texts: list[str]) -> list[list[int]]:
        """What merge gives for each text: the agendas of short texts whose characters are all pieces are worked off side by side, a row each."""
        out: list[list[int]] = [[]] * len(texts)
        short = sorted((i for i, x in enumerate(texts) if 0 < len(x) <= REMEMBERED_CHARS), key=lambda i: len(texts[i]))
        alone = [i for i, x in enumerate(texts) if not 0 < len(x) <= REMEMBERED_CHARS]
        for k in range(0, len(short), SIDE_BY_SIDE):
            some = short[k : k + SIDE_BY_SIDE]
            sizes = np.array([len(texts[i]) for i in some])
            width = int(sizes[-1])
            s = np.full((len(some), width + 1), -1, np.int32)
            held = np.arange(width + 1) < sizes[:, None]
            s[held] = self.char_id[np.frombuffer("".join([texts[i] for i in some]).encode("utf-32-le", "surrogatepass"), "<u4")]
            odd = (held & (s < 0)).any(axis=1)
            s[odd] = -1
            union, rank = self._unions(s[:, :-1], s[:, 1:])
            after = np.tile(np.arange(1, width + 2), (len(some), 1))
            before = np.tile(np.arange(-1, width), (len(some), 1))
            row = np.arange(len(some))
            while True:
                j = rank[row].argmin(axis=1)  # the first of the best, as from the left
                go = rank[row, j] < NONE
                row, j = row[go], j[go]
                if not len(row):
                    break
                x, gone = union[row, j], after[row, j]
                then = after[row, gone]
                s[row, j], s[row, gone] = x, -1
                after[row, j], before[row, then] = then, j
                here = gone < width
                rank[row[here], gone[here]] = NONE
                union[row, j], rank[row, j] = self._unions(x, s[row, then])
                h = before[row, j]
                r, h, x = row[h >= 0], h[h >= 0], x[h >= 0]
                union[r, h], rank[r, h] = self._unions(s[r, h], x)
            ends = np.cumsum((s >= 0).sum(axis=1)).tolist()
            ids = s[s >= 0].tolist()
            for i, a, b in zip(some, [0, *ends], ends):
                out[i] = ids[a:b]
            alone += [some[r] for r in np.flatnonzero(odd)]
        for i in alone:
            out[i] = self.merge(texts[i])
        return out

    def unmerge(self, ids: list[int]) -> str:
        """The text of ids, its leading space kept."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")

    def learn(self, stretches: set[str]) -> None:
        """Merge stretches not met before, and check all of them against the library at once."""
        new = list(stretches)
        ids = self.merge_many([x.replace(" ", SPACE) for x in new])
        texts = [self.unmerge(x) for x in ids]
        # The library puts a space mark first. Behind a line end, which no piece contains, a stretch stands as in a text.
        theirs = self.library.encode(["\n" + x for x in new], num_threads=1)
        back = self.library.decode(theirs, num_threads=1)
        head = self.library.encode("\n")
        for x, i, t, their, said in zip(new, ids, texts, theirs, back):
            if head + i != their or "\n" + t != said:
                self.differing.add(x)
                i = their[len(head) :]
            self.ids.add(x, struct.pack(f"<{len(i)}i", *i), 4 * len(i) + len(x))

    def parts(self, text: str) -> Iterator[str]:
        """A text, its leading space mark included, in parts that no stretch crosses."""
        text = " " + text if text else ""
        if not self.stretch.pattern.startswith("["):
            yield text
            return
        at = 0
        while at < len(text):
            end = at + PART
            while end < len(text) and not (text[end] == " " and text[end - 1] not in (" ", SPACE)):
                end = text.find(" ", end + 1) if text.find(" ", end + 1) > 0 else len(text)
            yield text[at:end]
            at = end

    def batch(self, texts: list[str], names: list | None = None, trust_library: bool = False) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian 32-bit integers, the end id included, and decoded texts."""
        end, ids = struct.pack("<i", self.end), [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        held = 0

        def join() -> None:
            new = self.ids.missing(set().union(*(x for _, x in cut)))
            if new:
                self.learn(new)
                bad = self.differing and not trust_library and next(((k, x) for k, s in cut for x in s if x in self.differing), None)
                if bad:
                    raise RuntimeError(f"document {names[bad[0]] if names else bad[0]}: the merges of {bad[1][:60]!r} differ from the sentencepiece library's")
            known = self.ids.__getitem__
            for k, x in cut:
                ids[k] += b"".join(map(known, x))
            for x in new:
                if len(x) > REMEMBERED_CHARS:
                    del self.ids[x]

        for k, t in enumerate(texts):
            for part in self.parts(t):
                cut.append((k, self.stretch.findall(part)))
                held += len(part)
                if held > 4 * PART:
                    join()
                    cut, held = [], 0
        join()
        ids = [x + end for x in ids]
        return ids, [self.unmerge_packed(x) for x in ids]

    def unmerge_packed(self, ids: bytes) -> str:
        """The text of packed ids with the end id, without its leading space."""
        every, out = np.frombuffer(ids, "<i4"), []
        for k in range(0, len(every), PART):
            out.append(b"".join(map(self.surface.__getitem__, every[k : k + PART].tolist())))
        return b"".join(out).decode("utf-8", "replace")[1:]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", trust_library: bool = False) -> DataFrame:
    """doc_id, ids array<int> (end id last) and decoded string for each row of docs.

    model: path of a .model file that every executor can open. trust_library:
    where the library's ids of a stretch differ, take them instead of failing.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        only_cache("pieces", pieces.ids.forget)
        for b in batches:
            ids, back = pieces.batch(b.column(1).to_pylist(), b.column(0).to_pylist(), trust_library)
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Token counts and checksums of what encode_decode returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
