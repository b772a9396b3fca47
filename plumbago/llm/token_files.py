"""Token ids in binary files of independent Zstandard frames.

File format. One frame per document, holding its ids as little-endian
unsigned integers of `width` bytes (2 where the vocabulary fits, else 4), with
the end id last. After the documents' frames come
  - a skippable frame (magic 0x184D2A50) with the index: `width` (uint32),
    number of documents n (uint32), n ids of documents (int64) and a bitmap of
    those that are null, as bytes;
  - the seek table of the public Zstandard seekable format, a skippable frame
    (magic 0x184D2A5E): for each document's frame its compressed size, size and
    checksum (low 32 bits of XXH64 of the ids' bytes), then the number of
    frames, a descriptor byte and the magic 0x8F92EAB1.
A reader takes the last bytes, then the table, then only the frames it wants;
each is verified by its checksum. Any Zstandard decoder can read the file.

Files hold ascending document ids (nulls first, equal ids by text), file by
file; the manifest has one row per file, with the tokens before it.

The tokenizers library encodes; where its pre-tokenizer is the known one that
never crosses white space, each distinct word is encoded once while a worker
remembers it, plain ones by the library's merges alone, and texts are cut into
words and put together from their ids a block at a time, by arrays.

Edge cases: null and empty texts give the end id alone; very long texts one
long frame; equal ids stay separate documents; an empty table gives no file
and an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm.common import PART, Recent, arrow_rows, fresh_path, id_text, in_parts, only_cache

INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Bytes of words that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_WORD = 96 << 20, 48
#: Bytes of text whose words are looked up at a time.
BLOCK = 16 * PART
MANIFEST = "path string, part int, n_docs long, n_tokens long"
SPACES = b" \t\n\r\v\f"
#: Of each byte: 1 for ASCII letters and digits, 2 for the marks that are cut off behind them, 3 for white space.
CUT_KINDS = bytes(1 if chr(c).isalnum() and c < 128 else 2 if chr(c) in ".,;:!?" else 3 if c in SPACES else 0 for c in range(256))
_loaded: dict[str, "WordTokenizer"] = {}


#: Fixed value: the pre-tokenizer pattern for which words may be encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PlainWords:
    """Ids of words of plain characters, by the library's model alone.

    Plain are the Latin letters from U+00AA to U+024F, and the ASCII characters
    that the normaliser leaves alone but white space and controls. None of them
    joins with a neighbour in NFC, so the normaliser, the pattern and the byte
    level can be taken character by character, as the library gives them for
    each; only the merges are left to it. A piece ends at its one id with the
    end-of-word suffix.
    """

    def __init__(self, library, spec: dict):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.shown: dict[int, str] = {}
        letters = ""
        for c in [*map(chr, range(0x21, 0x7F)), *filter(str.isalpha, map(chr, range(0xAA, 0x250)))]:
            beside = "a" if c.isalpha() else ""
            text = library.normalizer.normalize_str(beside + c + beside) if library.normalizer else beside + c + beside
            pieces = [x for x, _ in library.pre_tokenizer.pre_tokenize_str(text)]
            shown = pieces[0][len(beside) : len(pieces[0]) - len(beside)]
            if len(pieces) == 1 and shown.isascii() == c.isascii() and (shown == c or not c.isascii()) and all(x in vocab and x + suffix in vocab for x in shown):
                self.shown[ord(c)] = shown
                letters += c if beside else ""
        self.letters = re.compile(f"[ {letters}]+")
        self.word = re.compile(f"[{re.escape(''.join(map(chr, self.shown)))}]+")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^0-9{letters}]+")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for x, k in vocab.items() if x.endswith(suffix)]] = True
        self.model = Tokenizer(library.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")

    @staticmethod
    def knows(spec: dict) -> bool:
        """Whether the tokenizer does nothing but what is taken apart here; its pattern is WORD_PATTERN."""
        plain, model = spec["normalizer"] or {}, spec["model"]
        steps = plain.get("normalizers", [plain])
        known = all(x in ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}) for x in steps)
        level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])[1:]
        known = known and len(level) == 1 and (level[0]["type"], level[0]["add_prefix_space"], level[0]["use_regex"]) == ("ByteLevel", False, False)
        return known and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not any(model[x] for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))

    def encode(self, words: list[str], width: int) -> tuple[bytes, list[int]] | None:
        """The words' ids, one after another, and where those of each end, in bytes; None if ends of pieces can't be told."""
        text, last = " ".join(words), None
        if not self.letters.fullmatch(text):
            pieces = list(map(self.pieces.findall, words))
            text, last = " ".join(map(" ".join, pieces)), np.cumsum(list(map(len, pieces))) - 1
        text = text if text.isascii() else text.translate(self.shown)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{width}")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * width
        if len(ends) != (len(words) if last is None else last[-1] + 1):
            return None
        return ids.tobytes(), (ends if last is None else ends[last]).tolist()


class WordTokenizer:
    """Ids of whole texts, each distinct word encoded once.

    The pattern matches no white space, and splits ASCII letters and digits
    from a following mark of punctuation; so words and such marks are encoded
    apart, in ASCII lower case where the normaliser lower-cases anyway. New
    words are encoded many at a time, without the library's own cache, which
    words that are all new would only fill: plain ones as PlainWords does,
    others joined by a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Python worker has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        spec = json.loads(self.library.to_str())
        pre, plain = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        self.by_word = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN} and (first["behavior"], first["invert"]) == ("Removed", True)
        self.lower = any(x["type"] == "Lowercase" for x in plain.get("normalizers", [plain]) if x)
        marks = [x for x in spec["added_tokens"] if x["special"] and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"])]
        self.by_word = self.by_word and bool(marks) and len(marks) == len(spec["added_tokens"])
        self.specials = [x["content"].encode().lower() for x in marks]
        self.mark, self.mark_id = (marks[0]["content"], marks[0]["id"]) if marks else ("", -1)
        self.ids = Recent(REMEMBERED)
        self.plain = PlainWords(self.library, spec) if self.by_word and PlainWords.knows(spec) else None
        if self.by_word and hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def encode(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids  # the same ids, without offsets

    def learn(self, new: Iterable[bytes]) -> None:
        new = list(new)
        if self.plain is not None:
            new = self.learn_plain(new)
        for k in range(0, len(new), 200):
            part, at = new[k : k + 200], 0
            ids = np.array([*self.encode(self.mark.join([w.decode() for w in part])), self.mark_id], f"<u{self.width}")
            every = ids.tobytes()
            for w, end in zip(part, (np.flatnonzero(ids == self.mark_id) * self.width).tolist(), strict=True):
                self.ids.add(w, every[at:end], end - at + len(w))
                at = end + self.width

    def learn_plain(self, new: list[bytes]) -> list[bytes]:
        """Learn the plain ones of the words; returns the others."""
        alike: dict[tuple[bool, bool], list[str]] = {}  # letters alone and ASCII alone take the shortest way
        other, is_plain = [], self.plain.word.fullmatch
        for w in b"\n".join(new).decode().split("\n") if new else []:
            if is_plain(w):
                alike.setdefault((w.isalpha(), w.isascii()), []).append(w)
            else:
                other.append(w.encode())
        for words in alike.values():
            for k in range(0, len(words), 200):
                part = words[k : k + 200]
                keys = " ".join(part).encode().split(b" ")
                done = self.plain.encode(part, self.width)
                if done is None:
                    other += keys
                    continue
                every, ends = done
                self.ids.add_all(zip(keys, [every[x:y] for x, y in zip([0, *ends], ends)], strict=True), len(keys), len(every) + sum(map(len, keys)))
        return other

    def cut(self, text: bytes) -> list[bytes]:
        return self.words(text)[0].to_pylist()

    def words(self, text: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
        """The words of a text, and where each begins."""
        text = text.lower() if self.lower else text
        kinds = np.frombuffer(text.translate(CUT_KINDS), np.uint8)
        space = kinds == 3
        parted = (kinds[:-1] == 1) & (kinds[1:] == 2)
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1] | parted])[: len(space)])
        ends = np.flatnonzero(~space & np.concatenate([space[1:] | parted, [True]])[: len(space)]) + 1
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(text.translate(None, SPACES))]), starts

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """The packed ids of each of some parts of texts; each distinct word is looked up once."""
        words, starts = self.words(b"\n".join(parts))
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.ids.missing(distinct)
        self.learn(new)
        ids = pa.array(map(self.ids.__getitem__, distinct), pa.binary(), size=len(distinct)).take(words.indices)
        for w in new:
            if len(w) > REMEMBERED_WORD:
                del self.ids[w]
        _, places, packed = ids.buffers()
        begins = np.cumsum([0] + [len(x) + 1 for x in parts])
        at = np.frombuffer(places, np.int32)[np.searchsorted(starts, begins)].tolist() if len(ids) else [0] * len(begins)
        packed = memoryview(packed) if packed else b""
        return [bytes(packed[x:y]) for x, y in zip(at, at[1:])]

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, bytes]] = []
        held = 0

        def join() -> None:
            for (k, _), ids in zip(cut, self.encode_parts([x for _, x in cut]), strict=True):
                out[k] += ids

        for k, text in enumerate(texts):
            raw = text.encode()
            low = raw.lower()
            if not self.by_word or any(x in low for x in self.specials):
                out[k] = self.pack(self.encode(text))
                continue
            for part in in_parts(raw):
                cut.append((k, part))
                held += len(part)
                if held > BLOCK:
                    join()
                    cut, held = [], 0
        join()
        return out


def load(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _open(folder: str):
    """The file system of a URI and the path there; works for file:, hdfs:, s3: and others pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class FrameWriter:
    """Writes one file; it appears under its name only once it is complete."""

    def __init__(self, folder: str, name: str, width: int, attempt: int):
        self.fs, top = _open(folder)
        self.fs.create_dir(top, recursive=True)
        self.path, self.temporary, self.width = f"{top}/{name}", f"{top}/_{name}.{attempt}", width
        self.out = self.fs.open_output_stream(self.temporary)
        self.press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.ids: list[int | None] = []
        self.table = bytearray()
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.press.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.n_tokens += len(ids) // self.width

    def close(self) -> None:
        n = len(self.ids)
        null = np.packbits(np.array([i is None for i in self.ids], dtype=bool)).tobytes()
        index = struct.pack("<II", self.width, n) + np.array([i or 0 for i in self.ids], dtype="<i8").tobytes() + null
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        tail = struct.pack("<IBI", n, 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(self.table) + len(tail)) + bytes(self.table) + tail)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class FrameReader:
    """Random access to one file: only the frames asked for are read and decompressed."""

    def __init__(self, path: str):
        self.fs, p = _open(path)
        self.file = self.fs.open_input_file(p)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table_at = size - 9 - 12 * n
        self.table = np.frombuffer(self.file.read_at(12 * n, table_at), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self.file.read_at(table_at - 8 - int(self.starts[-1]), int(self.starts[-1]))
        self.width, m = struct.unpack_from("<II", index, 8)
        if m != n:
            raise ValueError(f"{path}: index and seek table differ")
        ids = np.frombuffer(index, "<i8", n, 16)
        null = np.unpackbits(np.frombuffer(index, np.uint8, (n + 7) // 8, 16 + 8 * n))[:n]
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.unpress = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def tokens(self, k: int) -> np.ndarray:
        packed, size, check = (int(x) for x in self.table[k])
        raw = self.unpress.decompress(self.file.read_at(packed, int(self.starts[k])), max_output_size=size) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        return [self.tokens(k) for k, i in enumerate(self.doc_ids) if i == doc_id]


@dataclass
class TokenFiles:
    folder: str
    #: One row per file: MANIFEST and start, the tokens of all files before it.
    manifest: list[tuple[str, int, int]]


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches in order, as many together as it takes to hold `size` bytes."""
    held: list[pa.RecordBatch] = []
    most = size
    for b in batches:
        held.append(b)
        most -= b.nbytes
        if most <= 0:
            yield pa.Table.from_batches(held)
            held, most = [], size
    if held:
        yield pa.Table.from_batches(held)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> TokenFiles:
    """Encode every text of docs and write ids to files under folder, in ascending id order.

    The driver receives one row per file; their number is that of the shuffle
    partitions and doesn't depend on the documents.
    """
    spark = docs.sparkSession
    arrow_rows(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, out = load(tokenizer), TaskContext.get(), None
        only_cache("words", words.ids.forget)
        end = words.pack([end_id])
        for b in gathered(batches, BLOCK):
            for i, ids in zip(b.column(0).to_pylist(), words.batch(b.column(1).to_pylist())):
                if out is None:
                    out = FrameWriter(folder, f"tokens-{task.partitionId():06d}.zst", words.width, task.taskAttemptId())
                out.add(i, ids + end)
        if out is not None:
            out.close()
            name = f"{folder}/tokens-{task.partitionId():06d}.zst"
            yield pa.RecordBatch.from_pylist([{"path": name, "part": task.partitionId(), "n_docs": len(out.ids), "n_tokens": out.n_tokens}], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    by = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc()]  # many rows of one id spread over files
    files = id_text(docs, id_col, text_col).repartitionByRange(n, *by).sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    manifest, start = [], 0
    for f in sorted(files.collect(), key=lambda f: f.part):
        manifest.append((f.path, f.part, start))
        start += f.n_tokens
    return TokenFiles(folder, manifest)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (tokens of all documents before), ids array<int> of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                reader, start = FrameReader(f["path"]), f["start"]
                for at in range(0, len(reader), 200):
                    docs = [reader.tokens(k).astype("<i4") for k in range(at, min(at + 200, len(reader)))]
                    lengths = np.array([len(x) for x in docs])
                    ends = np.cumsum(lengths)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(docs)))
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[at : at + 200], pa.int64()), pa.array(start + ends - lengths, pa.int64()), ids], names=["doc_id", "start", "ids"])
                    start += int(ends[-1])

    return _per_file(spark, files).mapInArrow(run, "doc_id long, start long, ids array<int>")


def checksums(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                reader, start = FrameReader(f["path"]), f["start"]
                sizes, crcs = [], []
                for k in range(len(reader)):
                    ids = reader.tokens(k)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = np.array(sizes, dtype=np.int64)
                starts = start + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64()), pa.array(starts), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _per_file(spark, files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _per_file(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """A row for each file, each in a partition of its own."""
    rows = [(path, start) for path, _, start in files.manifest]
    if not rows:
        return spark.createDataFrame([], "path string, start long")
    schema = "path string, start long, slot int"
    table = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema)
    return table.repartitionByRange(len(rows), "slot").select("path", "start")


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> TokenFiles:
    return write(docs, tokenizer, fresh_path(docs.sparkSession, "tokens"), end_id)
