"""Best-fit packing into fixed-length sequences by a configuration linear program.

Documents are encoded and cut into pieces; only the histogram of piece lengths (at most
``capacity`` numbers) reaches the driver. Over it runs the program "as few bins as cover all
lengths", whose variables are the bin patterns: multiplicative weights give each length a price
that falls as it gets covered, and a knapsack table over the capacity finds the dearest pattern
(pricing). The fractional use of the patterns is rounded down, and what is left is packed best
fit, largest first, again over the histogram. So the plan has a size that does not depend on the
number of documents: for each length, ranges of ranks that go to a pattern's slots.

Pieces then get their rank within their length (window over length and a hash bucket, plus the
counts of the buckets before, so a length that holds most rows is spread) and from it their
sequence and offset; no piece is moved together with others of its sequence.

Defined results: NULL text is the empty text, one piece with the end id; NULL ids stay NULL and
repeated rows are packed as often as they occur; an empty table gives an empty table; other columns
are ignored. A document of any length is cut whole; its first piece is the shorter one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import id_and_text, map_rows, staged, width
from pairloom.llm.tokens import shared_encoder

CAPACITY = 1024
ENCODED_ROWS = 512  # texts and ids that a worker holds at a time
ROUNDS = 120  # pricing rounds at most
PATTERNS = 48  # patterns taken from one knapsack table: the dearest ones with each of the least covered lengths
STEP = 0.15
RATE = 0.3
GAMMA = 1.6


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    capacity: int = CAPACITY,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; no shuffle."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def make():
        encoder = shared_encoder(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, docs_of = [], batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, ENCODED_ROWS):
                texts = batch.column(1).slice(at, ENCODED_ROWS).to_pylist()
                for doc, data in zip(docs_of[at : at + ENCODED_ROWS], encoder.encode(texts), strict=True):
                    data = memoryview(data + end)
                    n, a, k = len(data) // 4, 0, 0
                    while a < n:
                        b = a + ((n - a) % capacity or capacity)
                        rows.append((doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
                        a, k = b, k + 1
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        return each

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_rows(id_and_text(docs, id_col, text_col), schema, make)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For each room the index of the size to take next in its dearest filling, or -1."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            got = best[c - sizes[: upto[c]]] + prices[: upto[c]]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], pick[c] = got[k], k
    return pick


def filled(first: int, sizes: np.ndarray, pick: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest pattern (index of size -> copies) that holds the size of index ``first``."""
    out = {first: 1}
    room = capacity - int(sizes[first])
    while room > 0:
        k = int(pick[room])
        if k < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= int(sizes[k])
    return out


@dataclass
class Plan:
    """Slots per length: ranks [lo, hi) go ``copies`` to a bin, bins from ``bin``, first at ``offset``."""

    bins: int = 0
    priced: int = 0  # bins that come from the priced patterns
    slots: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)

    def place(self, pattern: dict[int, int], times: int, used: dict[int, int]) -> None:
        offset = 0
        for size in sorted(pattern, reverse=True):
            n = pattern[size]
            lo = used.get(size, 0)
            used[size] = lo + n * times
            self.slots.setdefault(size, []).append((lo, used[size], n, self.bins, offset))
            offset += n * size
        self.bins += times


def pack(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> Plan:
    """The plan for a histogram of lengths (1..capacity)."""
    plan, used, left = Plan(), {}, {s: n for s, n in histogram.items() if n}
    sizes = np.array(sorted(left), dtype=np.int64)
    counts = np.array([left[s] for s in sizes.tolist()], dtype=float)
    covered = np.zeros(len(sizes))
    use: dict[tuple, float] = {}
    for _ in range(rounds if len(sizes) else 0):
        if covered.min() >= 1:
            break
        # weights fall with coverage; long pieces cost more than their size, as they are harder to place later
        prices = sizes.astype(float) ** GAMMA * np.exp(-rate * np.clip(covered - covered.min(), 0, 50))
        pick = knapsack(sizes, prices, capacity)
        for k in np.argsort(covered, kind="stable")[:PATTERNS].tolist():
            pattern = filled(k, sizes, pick, capacity)
            step = STEP * min(counts[j] / n for j, n in pattern.items())
            key = tuple(sorted(pattern.items()))
            use[key] = use.get(key, 0.0) + step
            for j, n in pattern.items():
                covered[j] += step * n / counts[j]
    scale = max(1.0, float(np.quantile(covered, 0.5))) if len(covered) else 1.0
    fullest = sorted(use.items(), key=lambda e: (-sum(int(sizes[k]) * n for k, n in e[0]), -e[1], e[0]))
    for whole in (True, False):  # whole bins first, then a fraction counts as one bin while pieces last
        for key, x in fullest:
            pattern = {int(sizes[k]): n for k, n in key}
            bins = int(x / scale) if whole else 1
            times = min(bins, *(left[s] // n for s, n in pattern.items()))
            if times > 0:
                plan.place(pattern, times, used)
                for s, n in pattern.items():
                    left[s] -= n * times
    plan.priced = plan.bins
    best_fit(plan, used, left, capacity)
    return plan


def best_fit(plan: Plan, used: dict[int, int], left: dict[int, int], capacity: int) -> None:
    """Best fit, largest first; equal bins are made at once, so each step uses a length up or nearly so."""
    order = sorted((s for s, n in left.items() if n), reverse=True)
    while order:
        pattern: dict[int, int] = {}
        room = capacity
        for s in order:
            if s <= room:
                n = min(left[s], room // s)
                pattern[s] = n
                room -= n * s
        times = min(left[s] // n for s, n in pattern.items())
        plan.place(pattern, times, used)
        for s, n in pattern.items():
            left[s] -= n * times
        order = [s for s in order if left[s]]


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    capacity: int = CAPACITY,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = staged(pieces(docs, id_col, text_col, tokenizer, end_id, capacity))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = pack(histogram, capacity, rounds)  # the histogram has at most ``capacity`` rows
    buckets = 4 * width(docs.sparkSession)
    d = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = d.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length").orderBy("bucket")  # at most one row per bucket
    bases = counts.select("length", "bucket", (F.sum("n").over(order) - F.col("n")).alias("base"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    d = d.withColumn("rank", F.row_number().over(inner) - 1).join(bases, ["length", "bucket"])
    d = d.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return _assigned(d, plan)


def _assigned(ranked: DataFrame, plan: Plan) -> DataFrame:
    slots = {s: np.array(rows, dtype=np.int64) for s, rows in plan.slots.items()}
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                at = np.flatnonzero(length == s)
                table = slots[s]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                seq[at] = row[:, 3] + k // row[:, 2]
                offset[at] = row[:, 4] + k % row[:, 2] * s
            return pa.record_batch([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=names)

        return each

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_rows(ranked, schema, make)
