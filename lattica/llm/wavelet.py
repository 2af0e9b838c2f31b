"""Token ids in wavelet-matrix shards: one compressed file per shard, read back by access, count and lookup.

A shard holds the ids of consecutive documents as bit planes, highest bit first; each plane is stably sorted by the
bits before it. With the number of zeros of each plane and rank samples, the file answers: the token at a place, how
often a token occurs in a range, and where its k-th occurrence is. Planes are cut into blocks that are compressed by themselves, so an
answer unpacks a block or two of each plane and no more.

File: b"WVM2", little-endian header length (uint32), JSON header (n, zeros, ones: rank samples, the ones of a plane before each of its
blocks and in all; docs; sizes of the frames), then zstandard frames: the document ids (int64), the document lengths (uint32), and plane
by plane the blocks, in 64-bit words of which the last is padded.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stage

MAGIC = b"WVM2"
#: Tokens after which a task closes a shard. A document is never split, so one longer text makes a longer shard.
SHARD_TOKENS = 2_000_000
#: Bits of a block of a plane.
BLOCK = 1 << 19
#: Parts whose shards one task adds up.
SUMMED = 4_096
#: Ids handled at once when a plane is built or undone; a multiple of 64.
CHUNK = 1 << 16


class WaveletMatrix:
    """ids: non-negative integers below 2**32. block(plane, k): a block's 64-bit words; ones: a plane's ones before each block, and in all."""

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.zeros, self.ones, self.block = n, zeros, ones, block

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids, np.uint16 if ids.dtype.itemsize <= 2 else np.uint32)
        n, width = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
        planes, zeros = np.zeros((width, -(-n // 64)), np.uint64), []
        for p in range(width):
            bit, low, high = ids.dtype.type(1 << (width - 1 - p)), [], []
            small = planes[p].view(np.uint8)
            for at in range(0, n, CHUNK):  # pieces that stay in the processor's cache
                part = ids[at : at + CHUNK]
                one = (part & bit).astype(bool)
                packed = np.packbits(one, bitorder="little")
                small[at // 8 : at // 8 + len(packed)] = packed
                low.append(part[~one])
                high.append(part[one])
            zeros.append(sum(map(len, low)))
            ids = np.concatenate([*low, *high]) if n else ids
        per = BLOCK // 64
        counts = [[int(np.bitwise_count(x[k : k + per]).sum()) for k in range(0, planes.shape[1], per)] for x in planes]
        return cls(n, zeros, np.cumsum([[0, *c] for c in counts], axis=1), lambda p, k: planes[p][k * per : (k + 1) * per])

    @property
    def width(self) -> int:
        return len(self.zeros)

    def _look(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place (0 at the end) and the ones before it."""
        where = at // BLOCK
        bits, ones = np.zeros(len(at), np.int64), self.ones[plane][where].copy()
        for k in np.unique(where[at < self.n]).tolist():
            mine = np.flatnonzero((where == k) & (at < self.n))
            words, inside = self.block(plane, k), at[mine] - k * BLOCK
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            word, shift = words[inside >> 6], (inside & 63).astype(np.uint64)
            bits[mine] = (word >> shift) & np.uint64(1)
            ones[mine] += before[inside >> 6] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
        at_end = np.flatnonzero(at == self.n)
        ones[at_end] = self.ones[plane][-1]
        return bits, ones

    def access(self, places: np.ndarray) -> np.ndarray:
        at, out = np.asarray(places, np.int64).copy(), np.zeros(len(places), np.uint32)
        for p in range(self.width):
            bit, ones = self._look(p, at)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[p] + ones, at - ones)
        return out

    def decode(self) -> np.ndarray:
        """All ids in order: undoes the planes' sorting from the last to the first, a scan each."""
        width = self.width
        ids = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for p in range(width - 1, -1, -1):
            words = [self.block(p, k) for k in range(self.ones.shape[1] - 1)]
            bits, back = np.concatenate([*words, np.zeros(0, np.uint64)]).view(np.uint8), np.empty_like(ids)
            zero, at_one, bit = 0, self.zeros[p], ids.dtype.type(1 << (width - 1 - p))
            for at in range(0, self.n, CHUNK):
                part = back[at : at + CHUNK]
                one = np.unpackbits(bits[at // 8 : (at + CHUNK) // 8], bitorder="little")[: len(part)].astype(bool)
                ones = np.count_nonzero(one)
                part[one] = ids[at_one : at_one + ones] | bit
                part[~one] = ids[zero : zero + len(part) - ones]
                zero, at_one = zero + len(part) - ones, at_one + ones
            ids = back
        return ids

    def _narrow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for p in range(self.width):
            ones = self._look(p, np.array([lo, hi], np.int64))[1].tolist()
            if token >> (self.width - 1 - p) & 1:
                lo, hi = self.zeros[p] + ones[0], self.zeros[p] + ones[1]
            else:
                lo, hi = lo - ones[0], hi - ones[1]
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences at places lo to hi, hi left out."""
        if token >> self.width:
            return 0
        a, b = self._narrow(token, min(lo, self.n), self.n if hi is None else min(hi, self.n))
        return max(b - a, 0)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of token; -1 if there are fewer."""
        if token >> self.width:
            return -1
        lo, hi = self._narrow(token, 0, self.n)
        at = lo + k
        if k < 0 or at >= hi:
            return -1
        for p in range(self.width - 1, -1, -1):
            one = token >> (self.width - 1 - p) & 1
            at = self._place(p, one, at - self.zeros[p] if one else at)
        return at

    def _place(self, p: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        ranks = self.ones[p] if bit else np.arange(self.ones.shape[1]) * BLOCK - self.ones[p]
        block = int(np.searchsorted(ranks[:-1], k, "right")) - 1
        words = self.block(p, block)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words if bit else ~words), dtype=np.int64)]) + int(ranks[block])
        word = int(np.searchsorted(before[:-1], k, "right")) - 1
        value = int(words[word]) if bit else ~int(words[word])
        for _ in range(k - int(before[word])):
            value &= value - 1
        return block * BLOCK + word * 64 + (value & -value).bit_length() - 1


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids: signed 64-bit."""
    m, packer = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    parts = [np.asarray(doc_ids, "<i8"), np.asarray(lengths, "<u4")]
    parts += [m.block(p, k).astype("<u8") for p in range(m.width) for k in range(m.ones.shape[1] - 1)]
    frames = [packer.compress(x.tobytes()) for x in parts]
    header = json.dumps({"n": m.n, "zeros": m.zeros, "ones": m.ones.tolist(), "docs": len(doc_ids), "sizes": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *frames])


class Shard:
    """A shard's file: documents and matrix, of which parts are unpacked when asked for."""

    def __init__(self, data: bytes | pa.Buffer):
        data = memoryview(data)
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        (size,) = struct.unpack_from("<I", data, 4)
        h = json.loads(bytes(data[8 : 8 + size]))
        ends = 8 + size + np.cumsum([0, *h["sizes"]])
        unpacker, blocks = zstandard.ZstdDecompressor(), len(h["ones"][0]) - 1
        self.unpacked: dict[int, bytes] = {}

        def frame(k: int) -> bytes:
            if k not in self.unpacked:
                self.unpacked[k] = unpacker.decompress(data[ends[k] : ends[k + 1]])
            return self.unpacked[k]

        self._frame = frame
        self.matrix = WaveletMatrix(h["n"], h["zeros"], np.array(h["ones"], np.int64), lambda p, k: np.frombuffer(frame(2 + p * blocks + k), "<u8"))

    @property
    def docs(self) -> np.ndarray:
        return np.frombuffer(self._frame(0), "<i8")

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._frame(1), "<u4")


#: Ids of words, and of the pieces that words share, by tokenizer: reused worker processes keep them from task to task.
_KNOWN: dict[str, tuple[_Words, dict[str, bytes]]] = {}
#: Entries of either kind before starting afresh; bounds memory, not results.
MEMO = 1_340_000


class _Words(dict):
    """Word -> ids, worked out when first asked for."""

    of: Callable[[str], bytes]

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.of(word)
        return ids


def word_encoder(tokenizer_json: str) -> Callable[[list[str | None]], list[bytes]]:
    """Encodes texts to little-endian unsigned ids (16 bits if the vocabulary has so few, else 32) with the tokenizers library.

    Only for tokenizers that lower-case, drop white space, never look across it and split letters from marks. Each
    white-space separated word is encoded once while it is remembered; of words in plain Latin letters with marks
    behind, letters and marks are encoded by themselves. Python's str.split() also splits at 0x1C-0x1F, which
    the library doesn't; texts with those go to the library whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    kind = id_type(tok.get_vocab_size())
    known, parts = _KNOWN.setdefault(hashlib.sha256(tokenizer_json.encode()).hexdigest(), (_Words(), {}))
    bpe, as_marks, code = tok.model, _byte_marks(), "H" if kind == "<u2" else "I"

    def letters(word: str) -> bytes:
        """Ids of lower-case letters, straight from the model: nothing is left for the normaliser and the splitter to do."""
        return array(code, [t.id for t in bpe.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(as_marks))]).tobytes()

    def ids_of(text: str) -> bytes:
        return array(code, tok.encode(text, add_special_tokens=False).ids).tobytes()

    def of(word: str) -> bytes:
        if word.isascii() or max(word) < "\u0250":
            low = word.lower()
            core = low.rstrip(string.punctuation)
            ids = parts.get(core)
            if ids is None and core.isalpha():
                ids = parts[core] = letters(core)
            if ids is not None:
                marks = low[len(core) :]
                if not marks:
                    return ids
                if (tail := parts.get(marks)) is None:
                    tail = parts[marks] = ids_of(marks)
                return ids + tail
        return ids_of(word)

    known.of = of

    def encode(texts: list[str | None]) -> list[bytes]:
        if len(known) > MEMO:
            known.clear()
        if len(parts) > MEMO:
            parts.clear()
        find = known.__getitem__
        return [ids_of(t) if t and any(c in t for c in "\x1c\x1d\x1e\x1f") else b"".join(map(find, (t or "").split())) for t in texts]

    return encode


def _byte_marks() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, n, ids), n the number of ids, and the ids' numpy type; the end id is last; null and empty texts are the end id alone."""
    from tokenizers import Tokenizer

    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = id_type(Tokenizer.from_str(tokenizer_json).get_vocab_size())
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(model.value), np.array([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = [x + end for x in encode(part.column(1).to_pylist())]
                size = pa.array([len(x) // width for x in ids], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n int, ids binary"), kind


def write_shards(encoded: DataFrame, kind: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, n, ids of numpy type kind) -> the staged table (part int, seq int, n_docs long, n_tokens long, file binary), shards in ascending doc_id order, one to a file.

    Rows are range-partitioned by doc_id (null first) and sorted inside; a task writes its range as one or more
    shards of about shard_tokens. Equal doc_ids stay together, ordered by their ids. A shard's bytes are the one value of a file of the table, uncompressed
    by it, so shards are committed, retried and read like any other Spark output, in any store.
    """
    width = np.dtype(kind).itemsize
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = max(1, round(total / shard_tokens))
    least = -(1 << 63)  # stands for a null doc_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            docs, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            file = write_shard(docs, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([file], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "file"])

        for batch in batches:
            docs = batch.column(0).fill_null(least).to_numpy()
            _, where, data = batch.column(1).buffers()
            ends = np.frombuffer(where, np.int32)[batch.column(1).offset :][: len(docs) + 1].astype(np.int64) // width
            ids = np.frombuffer(data, kind)
            at = 0
            while at < len(docs):  # as many documents as fill the open shard, one at least
                upto = min(max(int(np.searchsorted(ends, ends[at] + shard_tokens - size)), at + 1), len(docs))
                held.append((docs[at:upto], np.diff(ends[at : upto + 1]), ids[ends[at] : ends[upto]]))
                size += int(ends[upto] - ends[at])
                at = upto
                if size >= shard_tokens:
                    yield shard()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield shard()

    ordered = encoded.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return stage(ordered.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, file binary"), compression="uncompressed", rows_a_file=1)


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), and with_ids those ids as `ids`."""
    # a running total in two steps: over ranges of SUMMED parts, then within each
    sizes = stage(shards.select("part", "seq", "n_tokens").withColumn("range", F.floor(F.col("part") / SUMMED)))
    before, within = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("range").agg(F.sum("n_tokens").alias("all")).select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    starts = stage(sizes.join(ranges, "range").select("part", "seq", (F.col("start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("base")))
    least = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(file.as_buffer())
                docs, lengths = shard.docs, shard.lengths
                ids, ends = shard.matrix.decode().astype("<u4"), np.cumsum(lengths, dtype=np.int64)
                for a in range(0, len(docs), 1000):
                    b = min(a + 1000, len(docs))
                    each = [ids[e - n : e] for e, n in zip(ends[a:b].tolist(), lengths[a:b].tolist(), strict=True)]
                    columns = [
                        pa.array(docs[a:b], mask=docs[a:b] == least),
                        pa.array(base + ends[a:b] - lengths[a:b], pa.int64()),
                        pa.array(lengths[a:b].astype(np.int64)),
                        pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.tobytes() for x in each], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return shards.join(starts, ["part", "seq"]).select("base", "file").mapInArrow(run, schema)
