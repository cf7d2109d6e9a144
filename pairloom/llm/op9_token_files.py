"""Token ids as wavelet-matrix shards.

Documents are range-partitioned by id and encoded there; each task cuts its run of whole documents
into shards and packs a shard's ids into a wavelet matrix: the ids are renumbered 0..k-1, and for
every bit, highest first, one bit-plane is stored, the sequence being split stably into zeros and
ones before the next plane. With a rank directory per plane one shard answers, without unpacking
the others: the token at a place, how often an id occurs before a place, and where its k-th
occurrence is.

A shard is one binary record in this layout (little-endian):

    "WVM1", n tokens u64, n documents u32, n symbols u32, planes u8
    symbols u32 each | document lengths u32 each | document ids i64 each | NULL-id flags u8 each
    per plane: zeros u64, size u32, zstd frame of (bits, 8 a byte, high first | rank per 512 bits u32)

Records are stored through Spark's writer, in order, so any store works and lost tasks are redone.

Defined results: NULL text is the empty text (only the end id); NULL ids come first; documents with
equal ids are ordered by the hash of their text, then the text; an empty table gives no shard and no
rows; other columns are ignored. A shard holds whole documents, so its memory is bounded by
``shard_tokens`` plus the longest document.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import give_back, id_and_text, map_rows, short_batches, staged
from pairloom.llm.tokens import shared_encoder

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sQIIB")
_PLANE = struct.Struct("<QI")
_BLOCK = 512


def pack_shard(ids: np.ndarray, lengths: list[int], doc_ids: list[int | None]) -> bytes:
    """The record of one shard; ``ids`` of all its documents one after the other."""
    n = len(ids)
    top = int(ids.max()) + 1 if n else 0
    if top <= 1 << 24:
        symbols = np.flatnonzero(np.bincount(ids, minlength=top)).astype("<u4")
        place = np.zeros(top, dtype=np.uint32)
        place[symbols] = np.arange(len(symbols), dtype=np.uint32)
        x = place[ids]
    else:
        symbols, x = np.unique(ids, return_inverse=True)
        symbols, x = symbols.astype("<u4"), x.astype(np.uint32)
    planes = max(1, int(len(symbols) - 1).bit_length()) if n else 0
    if planes <= 16:
        x = x.astype(np.uint16)
    press = zstandard.ZstdCompressor(level=1)
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    out = [
        _HEAD.pack(MAGIC, n, len(lengths), len(symbols), planes),
        symbols.tobytes(),
        np.asarray(lengths, dtype="<u4").tobytes(),
        np.asarray([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        nulls.tobytes(),
    ]
    for k in range(planes - 1, -1, -1):
        bit = x & (1 << k) != 0
        bits = np.packbits(bit)
        frame = press.compress(bits.tobytes() + _directory(bits).tobytes())
        ones = x.take(np.flatnonzero(bit))
        x = np.concatenate((x.take(np.flatnonzero(~bit)), ones))
        out += [_PLANE.pack(n - len(ones), len(frame)), frame]
    return b"".join(out)


def _directory(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of 512 bits."""
    step = _BLOCK // 8
    full = np.zeros(-(-len(bits) // step) * step, dtype=np.uint8)
    full[: len(bits)] = bits
    per = np.bitwise_count(full).reshape(-1, step).sum(axis=1, dtype=np.int64)
    return (np.cumsum(per) - per).astype("<u4")


class Shard:
    """Read access to one record; planes are unpacked when first used."""

    def __init__(self, record: bytes):
        magic, self.n, docs, symbols, planes = _HEAD.unpack_from(record)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.symbols = np.frombuffer(record, "<u4", symbols, at)
        at += 4 * symbols
        self.lengths = np.frombuffer(record, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        ids = np.frombuffer(record, "<i8", docs, at).tolist()
        at += 8 * docs
        nulls = np.frombuffer(record, "u1", docs, at).tolist()
        at += docs
        self.doc_ids = [None if z else i for i, z in zip(ids, nulls, strict=True)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._frames, self._open = [], {}
        for _ in range(planes):
            zeros, size = _PLANE.unpack_from(record, at)
            at += _PLANE.size
            self._frames.append((zeros, record[at : at + size]))
            at += size

    def _plane(self, p: int) -> tuple[int, np.ndarray, np.ndarray]:
        got = self._open.get(p)
        if got is None:
            zeros, frame = self._frames[p]
            raw = zstandard.ZstdDecompressor().decompress(frame)
            cut = -(-self.n // 8)
            got = zeros, np.frombuffer(raw, "u1", cut), np.frombuffer(raw, "<u4", offset=cut)
            self._open[p] = got
        return got

    def _ones(self, p: int, i: int) -> int:
        """Ones among the first i bits of plane p."""
        _, bits, before = self._plane(p)
        if i == 0:
            return 0
        block = (i - 1) // _BLOCK
        a = block * (_BLOCK // 8)
        total = int(before[block]) + int(np.bitwise_count(bits[a : i // 8]).sum(dtype=np.int64))
        return total + (int(bits[i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else total

    def _bit(self, p: int, i: int) -> int:
        return int(self._plane(p)[1][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(len(self._frames)):
            bit = self._bit(p, i)
            value = value * 2 + bit
            i = self._frames[p][0] + self._ones(p, i) if bit else i - self._ones(p, i)
        return int(self.symbols[value])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.symbols, token))
        return k if k < len(self.symbols) and self.symbols[k] == token else None

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before place i."""
        code = self._code(token)
        if code is None:
            return 0
        a, b, planes = 0, min(max(i, 0), self.n), len(self._frames)
        for p in range(planes):
            if code >> (planes - 1 - p) & 1:
                a, b = (self._frames[p][0] + self._ones(p, x) for x in (a, b))
            else:
                a, b = (x - self._ones(p, x) for x in (a, b))
        return b - a

    def _place(self, p: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of the given kind in plane p."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(p, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int | None:
        """Place of the k-th (from 0) occurrence of an id, or None."""
        code = self._code(token)
        if code is None or not 0 <= k < self.rank(token, self.n):
            return None
        planes, a = len(self._frames), 0
        for p in range(planes):
            a = self._frames[p][0] + self._ones(p, a) if code >> (planes - 1 - p) & 1 else a - self._ones(p, a)
        i = a + k
        for p in range(planes - 1, -1, -1):
            bit = code >> (planes - 1 - p) & 1
            i = self._place(p, bit, i - self._frames[p][0] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order."""
        planes = len(self._frames)
        y = np.zeros(self.n, dtype=np.uint16 if planes <= 16 else np.uint32)
        for p in range(planes - 1, -1, -1):
            zeros, bits, _ = self._plane(p)
            bit = np.unpackbits(bits, count=self.n).view(bool)
            up = np.empty_like(y)
            up[np.flatnonzero(~bit)] = y[:zeros]
            up[np.flatnonzero(bit)] = y[zeros:] | (1 << (planes - 1 - p))
            y = up
            self._open.pop(p, None)
        return self.symbols[y]


def write_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Shards in ascending id order: part, seq, n_tokens, record. One shuffle of the texts, by id range."""
    d = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    spread = d.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder, part, seq = shared_encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, lengths, ids, size = [], [], [], 0

        def row():
            record = pack_shard(np.frombuffer(b"".join(held), dtype="<u4"), lengths, ids)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([record], pa.binary())],
                names=["part", "seq", "n_tokens", "record"],
            )

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                n = len(data) // 4 + 1
                if size and size + n > shard_tokens:
                    yield row()
                    seq, size = seq + 1, 0
                    held, lengths, ids = [], [], []
                held += [data, end]
                lengths.append(n)
                ids.append(doc)
                size += n
        if size:
            yield row()
        held, lengths, ids = [], [], []
        give_back()

    short_batches(docs.sparkSession)
    return spread.mapInArrow(run, "part int, seq int, n_tokens long, record binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the records: doc_id, start, n_tokens, ids_crc32, part, seq."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("part_start"))
    within = shards.select("part", "seq", "n_tokens")
    order = Window.partitionBy("part").orderBy("seq")
    within = within.select("part", "seq", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("seq_start"))
    starts = within.join(F.broadcast(before), "part")  # one row per partition of the writer
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for r in batch.to_pylist():
                shard = Shard(r["record"])
                data = memoryview(shard.ids().astype("<u4").tobytes())
                for doc, a, n in zip(shard.doc_ids, shard.starts.tolist(), shard.lengths.tolist(), strict=True):
                    rows.append((doc, a, n, zlib.crc32(data[4 * a : 4 * (a + n)]), r["part"], r["seq"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        return each

    found = map_rows(
        shards.select("part", "seq", "record"),
        "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int",
        make,
    )
    return found.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("seq_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "part", "seq"
    )


def token_files(docs: DataFrame, **settings) -> DataFrame:
    """Write the shards into the shared folder and read every document back from them."""
    return read_shards(staged(write_shards(docs, **settings)))
