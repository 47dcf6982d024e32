"""Token-id files: one id array for many documents, with Elias-Fano coded document boundaries.

A segment holds the ids of consecutive documents as little-endian integers of 2 or 4 bytes, the
documents' ids, and the end of each document in the id array. The ends are a non-decreasing
sequence; Elias-Fano keeps their low bits packed and their high parts as gaps in unary, about
``2 + log2(ids / documents)`` bits a document. Any document's offset is found by a select on the
unary bits, without a table of 64-bit offsets: every 64th one's place is kept, and where 64 ones
span more than ``LONG`` bits, so are all of theirs, which bounds the work of a select as well as
the space (such a stretch has few ones for its bits).

Segments are binary rows of a Parquet table in the shared folder, in ascending doc_id order by
(part, seq); each knows the number of ids before it in its part.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symloom.llm.common import materialize
from symloom.llm.wordsplit import ChunkCache, is_plain, letters

#: Ids after which a segment is closed. A longer document makes a longer segment.
SEGMENT_IDS = 1 << 20
SAMPLE = 64
#: Bits that a select looks through at most.
LONG = 1 << 12
#: Chunks and words in the young halves of a worker's caches; their values are short.
CHUNKS, WORDS = 1 << 19, 1 << 19
HEAD = "<4sBBHQQQ"
HEAD_SIZE = struct.calcsize(HEAD)
MAGIC = b"EFT1"


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to ``top``."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: np.ndarray, blocks: np.ndarray, places: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.samples, self.blocks, self.places = samples, blocks, places
        self._samples = samples.tolist() + [8 * len(high)]
        self._long = dict(zip(blocks.tolist(), range(0, SAMPLE * len(blocks), SAMPLE), strict=True))

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        width = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1) if width else np.zeros((n, 0))
        low = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        samples = ones[::SAMPLE]
        blocks = np.flatnonzero(np.diff(samples, append=len(high)) > LONG)
        at = np.minimum(blocks[:, None] * SAMPLE + np.arange(SAMPLE), max(n - 1, 0))
        places = ones[at] if n else at
        return cls(n, width, low, np.packbits(high, bitorder="little").tobytes(), samples.astype("<u4"), blocks.astype("<u4"), places.reshape(-1).astype("<u4"))

    def one(self, i: int) -> int:
        """The place of the i-th set bit among the unary bits."""
        block, k = divmod(i, SAMPLE)
        if block in self._long:
            return int(self.places[self._long[block] + k])
        first, last = self._samples[block], self._samples[block + 1]
        bits = int.from_bytes(self.high[first >> 3 : (last + 7) >> 3], "little") >> (first & 7)
        for _ in range(k):
            bits &= bits - 1
        return first + (bits & -bits).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.width
        window = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3], "little")
        return (self.one(i) - i) << self.width | window >> (first & 7) & ((1 << self.width) - 1)

    def values(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        weights = np.int64(1) << np.arange(self.width, dtype=np.int64)
        return ((ones - np.arange(self.n)) << self.width) + low.astype(np.int64) @ weights

    def to_bytes(self) -> bytes:
        head = struct.pack("<BIII", self.width, len(self.low), len(self.high), len(self.blocks))
        return head + self.low + self.high + self.samples.tobytes() + self.blocks.tobytes() + self.places.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int, n: int) -> tuple[EliasFano, int]:
        width, low, high, long = struct.unpack_from("<BIII", data, at)
        samples = -(-n // SAMPLE)
        ends = np.cumsum([at + 13, low, high, 4 * samples, 4 * long, 4 * SAMPLE * long]).tolist()
        table = lambda i, k: np.frombuffer(data, "<u4", k, ends[i])
        return cls(n, width, data[ends[0] : ends[1]], data[ends[1] : ends[2]], table(2, samples), table(3, long), table(4, SAMPLE * long)), ends[5]


def write_segment(doc_ids: list[int | None], ids: list[bytes], width: int, before: int) -> bytes:
    """One segment; ``ids`` holds each document's ids as little-endian bytes of ``width``."""
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    top = int(ends[-1]) if len(ids) else 0
    known = np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little").tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return b"".join([struct.pack(HEAD, MAGIC, width, 0, 0, len(ids), top, before), known, keys, EliasFano.of(ends, top).to_bytes(), *ids])


class Segment:
    """A segment's bytes, read."""

    def __init__(self, data: bytes):
        magic, self.width, _, _, self.n, self.n_ids, self.before = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        at = HEAD_SIZE
        known = np.unpackbits(np.frombuffer(data, np.uint8, -(-self.n // 8), at), bitorder="little", count=self.n)
        at += -(-self.n // 8)
        keys = np.frombuffer(data, "<i8", self.n, at)
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known, strict=True)]
        self.ends, at = EliasFano.read(data, at + 8 * self.n, self.n)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class Encoder:
    """Whole texts to ids as little-endian bytes, by the tokenizers library.

    Texts within the plain characters are cut into words as the vocabulary's rules say, and each
    new word is given to the library's model once; the others go through the library as they are. Either way gives what the library gives for the text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = next(c for c in "HIL" if array(c).itemsize == self.width)
        self.cache = ChunkCache(self._word, b"".join, CHUNKS, WORDS)

    def _word(self, word: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(letters(word))])

    def _bytes(self, ids: list[int]) -> bytes:
        own = array(self.code, ids)
        if sys.byteorder == "big":
            own.byteswap()
        return own.tobytes()

    def encode(self, text: str) -> bytes:
        if is_plain(text):
            return b"".join(self.cache.values(text))
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process."""
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode whole texts and write segments; the table (part, seq, data) read again.

    Rows are dealt by ranges of doc_id (null first; rows of one id by text digest), so segments
    in the order (part, seq) hold the documents in ascending doc_id order. ``end_id`` closes each
    document. Null texts count as empty.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], f"<u{code.width}").tobytes()
        keys: list[int | None] = []
        ids: list[bytes] = []
        seq = before = size = 0

        def closed() -> pa.RecordBatch:
            data = write_segment(keys, ids, code.width, before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([data], pa.binary())], names=["part", "seq", "data"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                own = code.encode(text.as_py() or "") + end
                keys.append(key.as_py())
                ids.append(own)
                size += len(own) // code.width
                if size >= segment_ids:
                    yield closed()
                    seq, before, size, keys, ids = seq + 1, before + size, 0, [], []
        if keys:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(segments, "part int, seq int, data binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, part, seq`` of every document, from the segments.

    Each document's end is a select on its segment's boundaries. ``start`` is the number of ids of
    all documents before. The ids of each part are summed over
    the segments' heads; one row a part is joined back.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*batch.columns, strict=True):
                own = Segment(data.as_py())
                ends = np.array([own.ends.select(i) for i in range(own.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if own.n else ends
                wide = memoryview(own.ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(own.doc_ids, pa.int64()), pa.array(starts + own.before), pa.array(ends - starts), pa.array(crc, pa.int64())]
                columns += [pa.array([x.as_py()] * own.n, pa.int32()) for x in (part, seq)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "local", "n_tokens", "ids_crc32", "part", "seq"])

    rows = files.select("part", "seq", "data").mapInArrow(documents, "doc_id long, local long, n_tokens long, ids_crc32 long, part int, seq int")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [struct.unpack(HEAD, h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[5] for h in own], pa.int64())], names=["part", "n"])

    sums = files.select("part", F.substring("data", 1, HEAD_SIZE).alias("head")).mapInArrow(heads, "part int, n long")
    sums = sums.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each partition that was written; written too, so that its size is known
    base = materialize(sums.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")), "token-parts")
    return rows.join(base, F.col("part") == F.col("_part")).select("doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def token_offsets(docs: DataFrame, path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write token files and read every document's place and checksum back from them.

    One row per row of ``docs``, repeated rows too. Null doc_ids come first; rows of one doc_id
    stand next to each other, in the order of their text's digest. Null and empty texts hold
    ``end_id`` alone. An empty table gives an empty result; further columns are left out.
    """
    return read_token_files(write_token_files(docs, path, end_id, segment_ids))
