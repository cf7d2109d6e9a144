"""Hard negatives by a vertical scan (branch and bound on decomposed data).

Rows and anchors are dealt to the cells of a grid (a tile of rows, a tile of anchors); a task holds the anchors of
a cell and streams its rows past them. Each batch of rows becomes a block in columnar order: one array per
dimension with its least and greatest value, rows of one label side by side. Every anchor reads the block's
dimensions in descending order of its own magnitudes. After every few dimensions a row's score lies between its
partial sum plus the least and plus the greatest possible rest; rows that can no longer count leave the
candidate bitmap, and the scan ends with the exact scores of those left.

1. Positives: a row of the anchor's label is dropped when its upper bound is below the k-th lower bound.
2. Negatives: a row of another label is dropped when it cannot fall into the score window of any positive, or when
   every window it may fall into has k rows that are certainly in it and certainly higher.

A cell keeps the best k per anchor (and window) over its blocks, starts each block with their threshold, and
returns only them; so what goes to the final ranking is k rows an anchor (and window) and cell. All anchors are
compared with all rows in blocks; no table of pairs is written.

Defined results. Rows with a NULL id, label or vector or any NULL or non-finite component take no part. A row meets
only rows with vectors of its length, an empty vector included (all its scores are 0). Repeated rows each count;
"other rows" are rows with another id, and an anchor that occurs twice is answered twice. Integer components beyond
+-2^24 are taken as that, so sums are exact in 64 bits up to 2^14 dimensions. Empty tables give an empty result.
Further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import importable, staged, width

LEAST_TILE, MOST_TILE, ANCHORS = 2048, 65536, 8192  # rows of a tile of rows, and of a tile of anchors
LIMIT = 1 << 24
STEP = 8  # dimensions read between two looks at the bounds
FEW = 64  # with so few candidates left the rest is read at once
LEAST = np.iinfo(np.int64).min


def eligible(embeddings: DataFrame, scale: int, shift: int, labels: int) -> DataFrame:
    """id, label and integer vector of the rows that take part."""
    x = embeddings.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")
    ).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    whole = lambda e: F.greatest(
        F.least(F.floor(e.cast("double") * float(scale)).cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT))
    ).cast("int")
    x = x.filter(F.forall("v", finite))
    moved = F.when(F.col("id") % shift == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    return x.select("id", moved.alias("label"), F.transform("v", whole).alias("v"))


class Block:
    """A batch of rows in memory: ``cols[d]`` are all rows' values of dimension d, rows of one label lie together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        by = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[by], labels[by]
        self.cols = np.ascontiguousarray(vectors[by].T).astype(np.int64)
        self.low, self.high = (f(self.cols, axis=1) for f in (np.min, np.max))

    def label(self, value: int) -> tuple[int, int]:
        lo, hi = np.searchsorted(self.labels, [value, value + 1])
        return int(lo), int(hi)

    def scan(
        self, anchor: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``alive`` that ``keep(lower, upper)`` never dropped, with their exact scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.sort(np.stack([a * self.low[order], a * self.high[order]]), axis=0)
        rest = np.zeros((2, len(a) + 1), np.int64)  # least and greatest sum of the dimensions from here on
        rest[:, :-1] = ends[:, ::-1].cumsum(axis=1)[:, ::-1]
        sums = np.zeros(len(alive), np.int64)
        at = 0
        while True:
            held = keep(sums + rest[0, at], sums + rest[1, at])
            if not held.all():
                alive, sums = alive[held], sums[held]
            if at == len(a) or not len(alive):
                return alive, sums
            end = len(a) if len(alive) <= FEW else min(at + STEP, len(a))
            for k in range(at, end):
                sums += a[k] * self.cols[order[k]][alive]
            at = end


def kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value, or the least number where there are fewer."""
    return LEAST if len(values) < k else int(np.partition(values, len(values) - k)[len(values) - k])


class Best:
    """The best k (score descending, id ascending) seen so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self) -> int:
        return LEAST if len(self.scores) < self.k else int(self.scores[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[top], ids[top]


def find_positives(block: Block, anchor: np.ndarray, own: int, label: int, best: Best) -> None:
    lo, hi = block.label(label)
    alive = lo + np.flatnonzero(block.ids[lo:hi] != own)

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= max(best.threshold(), kth(lower, best.k))

    rows, scores = block.scan(anchor, alive, keep)
    best.add(scores, block.ids[rows])


def find_negatives(block: Block, anchor: np.ndarray, label: int, windows: dict[tuple[int, int], Best]) -> None:
    """``windows``: (least, greatest score) and the best rows in it so far."""
    lo, hi = block.label(label)
    alive = np.concatenate([np.arange(lo), np.arange(hi, len(block.ids))])

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        held = np.zeros(len(lower), bool)
        for (least, most), best in windows.items():
            sure = lower[(lower >= least) & (upper <= most)]
            held |= (upper >= max(least, best.threshold(), kth(sure, best.k))) & (lower <= most)
        return held

    rows, scores = block.scan(anchor, alive, keep)
    for (least, most), best in windows.items():
        fits = (scores >= least) & (scores <= most)
        best.add(scores[fits], block.ids[rows[fits]])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch (cell, side, row, id, label, v, windows) by (cell, side, vector length), in the batch's order."""
    cell, side, row, ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
    v = batch.column(5)
    offsets = v.offsets.to_numpy()
    sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.stack([cell, side, sizes], axis=1)
    for key in np.unique(keys, axis=0):  # ascending: cells in order, anchors before rows
        at = np.flatnonzero((keys == key).all(axis=1))
        yield (*map(int, key), row[at], ids[at], labels[at], values[starts[at][:, None] + np.arange(key[2])], at)


def _searched(cells: DataFrame, k: int, negatives: bool, least: int, most: int) -> DataFrame:
    """Best rows of each cell: (anchor, window, id, score); without windows for positives."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "window", "id", "score")])

    def window(score: int) -> tuple[int, int]:
        return -((-least * score) // most), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: list[tuple] = []  # (vector length, row, id, label, vector, windows)
        current = None

        def found() -> pa.RecordBatch:
            rows = [
                (np.full(len(b.ids), row), np.full(len(b.ids), w[1] if w else 0), b.ids, b.scores)
                for _, row, _, _, _, windows in anchors
                for w, b in windows.items()
            ]
            parts = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in (zip(*rows) if rows else [()] * 4)]
            return pa.record_batch([pa.array(p, pa.int64()) for p in parts], schema=schema)

        for batch in batches:
            for cell, side, dim, row, ids, labels, vectors, at in _parts(batch):
                if cell != current:
                    if anchors:
                        yield found()
                    anchors, current = [], cell
                if side == 0:
                    asked = batch.column(6).take(pa.array(at)).to_pylist()
                    for one in zip(row, ids, labels, vectors, asked):
                        windows = {window(s): Best(k) for s in one[4]} if negatives else {None: Best(k)}
                        anchors.append((dim, *one[:4], windows))
                    continue
                block = Block(ids, labels, vectors)
                for size, _, own, label, vector, windows in anchors:
                    if size != dim:
                        continue
                    if negatives:
                        find_negatives(block, vector, label, windows)
                    else:
                        find_positives(block, vector, own, label, windows[None])
        if anchors:
            yield found()

    importable(cells.sparkSession)
    return cells.mapInArrow(run, "anchor long, window long, id long, score long")


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Each tile of rows with each tile of anchors, anchors first; a task gets whole cells."""
    tile = min(max(n_rows // (2 * width(rows.sparkSession)), LEAST_TILE), MOST_TILE)
    g, h = math.ceil(n_rows / tile), math.ceil(n_anchors / ANCHORS)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    no_windows = F.lit(None).cast("array<bigint>")
    a = anchors.select(F.lit(0).alias("side"), "row", "id", "label", "v", "windows", all_of(g).alias("x"), dealt(h).alias("y"))
    r = rows.select(F.lit(1).alias("side"), "row", "id", "label", "v", no_windows.alias("windows"), dealt(g).alias("x"), all_of(h).alias("y"))
    cells = a.unionByName(r).withColumn("cell", F.col("x") * h + F.col("y"))
    cells = cells.repartition(max(1, min(g * h, 16 * width(rows.sparkSession))), "cell")
    return cells.sortWithinPartitions("cell", "side").select("cell", "side", "row", "id", "label", "v", "windows")


def hard_negatives(
    embeddings: DataFrame,
    every: int = 100,
    k: int = 5,
    band: tuple[int, int] = (80, 100),
    scale: int = 256,
    shift: int = 7,
    labels: int = 10,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; a negative's score lies between band[0]/band[1] of the
    positive's score and that score.
    """
    rows = staged(eligible(embeddings, scale, shift, labels).withColumn("row", F.monotonically_increasing_id()))
    picked = rows.filter(F.col("id") % every == 0)
    n_rows, n_anchors = rows.count(), picked.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if n_anchors == 0:
        return rows.sparkSession.createDataFrame([], schema)
    best = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))

    plain = picked.withColumn("windows", F.lit(None).cast("array<bigint>"))
    near = _searched(_cells(rows, plain, n_rows, n_anchors), k, False, *band)
    positives = staged(
        near.withColumn("rank", best(["anchor"])).filter(F.col("rank") <= k)
        .select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    asked = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("windows"))  # k at most
    mined = _searched(_cells(rows, picked.join(asked, "row"), n_rows, n_anchors), k, True, *band)
    mined = mined.withColumn("rank", best(["anchor", "window"])).filter(F.col("rank") <= k)
    mined = mined.select(
        "anchor", F.col("window").alias("positive_score"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    named = positives.join(picked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(mined, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
