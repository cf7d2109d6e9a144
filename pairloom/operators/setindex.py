"""Similarity search over token sets with sharded inverted indexes.

The pool is cut into shards of sets of about the same size; a task builds the inverted index of a shard (rarest
token first) and streams the queries past it. A query goes only to shards whose set sizes can still reach
what it needs, and in a shard it touches only posting lists: pool sets without a common token cost nothing. A
search for the k best also descends through thresholds: for a threshold t a set of n tokens shares ceil(t * n) of them
with any partner, so partners are met in the lists of its n - ceil(t * n) + 1 rarest tokens; only these are counted out,
and when k of them reach t the rest, the long lists of common tokens, is never read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from pairloom.operators.skew import BROADCAST_KEYS, grid_join
from pairloom.session import cut, shuffle_width, stored, task_slots

# task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_SHARD, MOST_SHARD = 1 << 18, 1 << 23  # tokens of a shard's sets, ROW_WEIGHT more for each set
ROW_WEIGHT = 16
CHUNK = 16384  # queries that one copy of a shard answers at least, if there are too few shards to share out
DENSE_CELLS, DENSE_SHARE = 1 << 24, 1 / 64  # the lists of a matrix: 16 MB of them at most, with this share of the rows at least
SENT_ROWS = 1 << 16  # rows that a task hands on at once
BYTE = 255  # so many tokens are counted in one byte
MARK = "\n"  # before each token of a set that is moved as one string
LEVELS = (0.8, 0.5, 0.3)  # thresholds of the descent; below the last all lists of a query are read


class SetIndex:
    """Inverted and forward lists of a shard's sets, in the order they are given."""

    def __init__(self, sets: pa.Array) -> None:
        offsets = sets.offsets.to_numpy()
        self.sizes = np.diff(offsets).astype(np.int64)
        self.starts = (offsets[:-1] - offsets[0]).astype(np.int64)
        encoded = pc.dictionary_encode(sets.flatten())
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        self.tokens = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.lengths = np.bincount(self.codes, minlength=len(self.tokens))  # of the posting lists
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        rows = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.rows = rows[np.argsort(self.codes, kind="stable")]
        self.asked = np.zeros(len(self.tokens), dtype=bool)
        self.dense: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.sizes)

    def lookup(self, sets: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Size and known tokens (rarest first) of each query set."""
        offsets = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        found = pc.index_in(sets.flatten(), value_set=self.tokens).fill_null(-1).to_numpy(zero_copy_only=False)
        for a, b in zip(offsets, offsets[1:]):
            codes = found[a:b]
            codes = codes[codes >= 0]
            yield int(b - a), codes[np.argsort(self.lengths[codes], kind="stable")]

    def postings(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the tokens' lists, one after the other."""
        n = self.lengths[codes]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[codes] - (ends - n), n)
        return self.rows[at]

    def counted(self, codes: np.ndarray) -> np.ndarray:
        """Common tokens with every row."""
        return np.bincount(self.postings(codes), minlength=len(self))

    def _densify(self) -> None:
        """The longest lists as rows of a 0/1 matrix of bounded size."""
        most = DENSE_CELLS // max(len(self), 1)
        self.long = DENSE_SHARE * len(self)
        if len(self.lengths) > most:
            self.long = max(self.long, float(np.partition(self.lengths, -most - 1)[-most - 1]) + 1)
        often = np.flatnonzero(self.lengths >= self.long)
        self.slot = np.full(len(self.lengths), -1)
        self.slot[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(self)), dtype=np.uint8)
        self.dense[np.repeat(np.arange(len(often)), self.lengths[often]), self.postings(often)] = 1

    def counted_each(self, queries: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
        """:meth:`counted` for many queries: of the long lists only the query's own rows of the matrix are added, a
        byte a row. Counts are bytes if no query token can make them overflow."""
        if self.dense is None:
            self._densify()
        for codes in queries:
            c = int(np.searchsorted(self.lengths[codes], self.long))  # rarest first
            slots = self.slot[codes[c:]].tolist()
            common = np.zeros(len(self), dtype=np.uint8)
            for k in slots[:BYTE]:
                np.add(common, self.dense[k], out=common)
            if len(codes) > BYTE:
                common = common.astype(np.int32)
                for a in range(BYTE, len(slots), BYTE):
                    common += self.dense[slots[a : a + BYTE]].sum(axis=0, dtype=np.uint8)
            if c:
                common += np.bincount(self.postings(codes[:c]), minlength=len(self)).astype(common.dtype)
            yield common

    def reaching(self, size: int, codes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, common): all rows with |A∩B| / |A∪B| >= num/den.

        Such a row is in a list of the rarest tokens; how often it is there bounds what it can have in common.
        """
        lists = size + (-size * num) // den + 1 - (size - len(codes))
        if lists <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        common = np.bincount(self.postings(codes[:lists]), minlength=len(self))
        rest = codes[lists:]
        rows = np.flatnonzero(common)
        n = self.sizes[rows]
        most = np.minimum(common[rows] + len(rest), n)
        rows = rows[(most * (num + den) >= (size + n) * num) & (n * den >= size * num) & (size * den >= n * num)]
        if not len(rows):
            return rows, rows
        if int(self.sizes[rows].sum()) <= int(self.lengths[rest].sum()):
            found = self.counted_out(codes, rows)
        else:
            found = (common + np.bincount(self.postings(rest), minlength=len(self)))[rows]
        ok = found * (num + den) >= (size + self.sizes[rows]) * num
        return rows[ok], found[ok]

    def counted_out(self, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Common tokens with the given rows, from the rows' own lists."""
        n = self.sizes[rows]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - n), n)
        self.asked[codes] = True
        common = np.add.reduceat(self.asked[self.codes[at]].astype(np.int64), ends - n)
        self.asked[codes] = False
        return common

    def near(
        self, size: int, codes: np.ndarray, least: float, enough: Callable[[np.ndarray, np.ndarray], bool]
    ) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(rows, common, number of rows counted) that can be among the best, from the lists of rare tokens; None if all lists are needed.

        They are all rows of similarity ``least`` or more, or all above some level at which
        ``enough(rows, similarities)`` holds.
        """
        whole = int(self.lengths[codes].sum())
        absent = size - len(codes)
        for level in LEVELS:
            t = max(level, least)
            lists = size - math.ceil(t * size - 1e-9) + 1 - absent
            if lists > 0:
                rows = np.unique(self.postings(codes[:lists]))
                if int(self.sizes[rows].sum()) > whole:
                    break  # counting them out costs more than reading all lists
                if len(rows):
                    common = self.counted_out(codes, rows)
                    sims = common / (size + self.sizes[rows] - common)
                    over = sims >= t
                    if t == least or enough(rows[over], sims[over]):
                        return rows[over], common[over], len(rows)
            if t == least:
                return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return None


# --- dealing --------------------------------------------------------------------------------------


def block_of(by: Sequence[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))  # structs compare NULL fields as equal


def _small(df: DataFrame, table: DataFrame, n_rows: int, keys: list[str], salt: Column) -> DataFrame:
    """Inner join with a table of ``n_rows`` counted rows: broadcast if they are few, else dealt as a grid."""
    if n_rows <= BROADCAST_KEYS:
        return df.join(F.broadcast(table), keys)
    return grid_join(df, table, keys, salt, F.lit(0))


def copies(n_queries: int, n_shards: int, slots: int) -> int:
    """How often each shard is moved, each copy for a part of the queries.

    Queries stream past a shard, however many they are; copies are made only where shards are too few for all tasks.
    """
    return max(1, min(math.ceil(n_queries / CHUNK), math.ceil(2 * slots / max(n_shards, 1))))


def _unmarked(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit(MARK), F.lit("\\n"))


def joined(bits: str) -> Column:
    """A set of strings as one string, half of the array's bytes: each token after a mark, marks in tokens escaped."""
    odd = lambda t: t.contains(MARK) | t.contains("\\")
    own = F.transform(bits, lambda t: F.concat(F.lit(MARK), F.when(odd(t), _unmarked(t)).otherwise(t)))
    return F.array_join(own, "")


def parted(sets: pa.Array) -> pa.Array:
    """The sets of :func:`joined`; escaped tokens stay so, as only their equality counts."""
    lists = pc.split_pattern(sets, MARK)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    own = np.ones(offsets[-1], dtype=bool)
    own[offsets[:-1]] = False  # nothing is before a set's first mark
    tokens = lists.flatten().filter(pa.array(own))
    return pa.ListArray.from_arrays(pa.array((offsets - np.arange(len(offsets))).astype(np.int32)), tokens)


class Shards:
    """The pool cut into shards by block and set size, written once.

    ``pool``: the columns of ``by``, ``bits`` and ``columns``; the first of ``columns`` orders the rows of a shard.
    ``bits`` are sets or, with ``strings``, strings whose size is their length.
    """

    def __init__(
        self, pool: DataFrame, by: Sequence[str], columns: Sequence[str], shard_rows: int | None = None, strings: bool = False
    ) -> None:
        self.columns = list(columns)
        own = F.col("bits") if strings else F.array_compact(F.array_distinct("bits"))
        p = pool.select(block_of(by).alias("b"), own.alias("bits"), *columns)
        p = p.withColumn("n", F.length("bits") if strings else F.size("bits"))
        self.joined = not strings and isinstance(p.schema["bits"].dataType.elementType, T.StringType)
        if self.joined:
            p = p.withColumn("bits", joined("bits"))
        p = stored(p)
        sizes = cut(p.groupBy("b", "n").agg(F.count(F.lit(1)).alias("c")))  # distinct sizes are few
        # As many shards as keep all tasks busy (each costs a copy of the queries), of about equally many tokens so that their
        # tasks' work and memory are alike
        weight = F.col("n") + ROW_WEIGHT if shard_rows is None else F.lit(1)
        n_sizes, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("c") * weight), F.lit(0))).first()
        if shard_rows is None:
            shard_rows = min(max(math.ceil(total / (2 * task_slots(pool.sparkSession))), LEAST_SHARD), MOST_SHARD)
        before = F.sum(F.col("c") * weight).over(Window.partitionBy("b").orderBy("n")) - F.col("c") * weight
        placed = _small(p, sizes.withColumn("before", before), n_sizes, ["b", "n"], F.col(columns[0]))
        # rows of one size are dealt evenly over its places, so a common size fills as many shards as it needs
        place = F.col("before") + F.pmod(F.xxhash64(columns[0]), F.col("c")) * weight
        self.rows = placed.withColumn("shard", F.floor(place / shard_rows)).drop("before", "c")
        spans = self.rows.groupBy("b", "shard").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        self.directory = cut(spans.withColumn("cell", F.monotonically_increasing_id()))
        self.count = self.directory.count()

    def visits(self, queries: DataFrame, wanted: Column) -> DataFrame:
        """Each query with the shards of its block for which ``wanted`` (of n, low, high, least, reach) holds.

        ``queries``: b, row, n, bits, least and further columns; ``reach`` is the greatest similarity that the sizes allow.
        """
        n = F.col("n")
        reach = F.when(n < F.col("low"), n / F.col("low")).when(n > F.col("high"), F.col("high") / n).otherwise(F.lit(1.0))
        met = _small(queries, self.directory.drop("cell"), self.count, ["b"], F.col("row"))
        return met.withColumn("reach", reach).filter(wanted).drop("low", "high", "reach")

    def streamed(
        self,
        visits: DataFrame,
        n_queries: int,
        answer: Callable[[Any, pa.RecordBatch, pa.RecordBatch], pa.RecordBatch | pa.Table | Iterator[pa.RecordBatch] | None],
        schema: T.StructType,
        extra: Sequence[str] = (),
        build: Callable[[pa.Array], Any] = SetIndex,
        last: Callable[[Any], pa.Table | None] | None = None,
    ) -> DataFrame:
        """``answer(index, pool rows, queries)`` for every batch of queries that visits a shard, and ``last(index)`` after all of them.
        An answer that can be large is an iterator of bounded parts.

        Pool rows come in the order of their first column. ``n_queries`` bounds the number of queries that visit a shard. ``extra`` columns of the visits go to the queries' batch.
        """
        spark = visits.sparkSession
        chunks = copies(n_queries, self.count, task_slots(spark))
        v = visits.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
        cells, n_cells = self.directory.select("b", "shard", "cell", F.lit(0).alias("chunk")), self.count
        if chunks > 1:
            cells = cut(v.select("b", "shard", "chunk").distinct().withColumn("cell", F.monotonically_increasing_id()))
            n_cells = cells.count()
        none = {c: F.lit(None) for c in ("row", "least", *extra)}
        pool = _small(self.rows, cells, n_cells, ["b", "shard"], F.col(self.columns[0]))
        kinds = dict(visits.dtypes)
        pool = pool.select(
            "cell", F.lit(0).alias("side"), "bits", *self.columns, *(c.cast(kinds[k]).alias(k) for k, c in none.items())
        )
        if self.joined:
            v = v.withColumn("bits", joined("bits"))
        ask = _small(v, cells, n_cells, ["b", "shard", "chunk"], F.col("row"))
        own = dict(self.rows.dtypes)
        ask = ask.select(
            "cell", F.lit(1).alias("side"), "bits", *(F.lit(None).cast(own[c]).alias(c) for c in self.columns), "row", "least", *extra
        )
        width = shuffle_width(spark)
        stream = pool.unionByName(ask).repartition(min(max(n_cells, width), 4 * width), "cell").sortWithinPartitions("cell", "side", self.columns[0])
        return stream.mapInArrow(_serve(build, answer, to_arrow_schema(schema), self.joined, last), schema)


def _serve(
    build: Callable, answer: Callable, schema: pa.Schema, joined: bool, last: Callable | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sliced(out: pa.RecordBatch | pa.Table | Iterator[pa.RecordBatch] | None) -> Iterator[pa.RecordBatch]:
        """In pieces: the JVM holds each of them whole beside what it sorts."""
        if out is None:
            return
        if isinstance(out, Iterator):
            for part in out:
                yield from sliced(part)
            return
        table = pa.Table.from_batches([out]) if isinstance(out, pa.RecordBatch) else out
        yield from table.cast(schema).to_batches(max_chunksize=SENT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index, rows = None, [], None, None
        for batch in batches:
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(cells)]):
                part = batch.slice(a, b - a)
                if joined and b > a:
                    part = pa.record_batch([*part.columns[:2], parted(part.column(2)), *part.columns[3:]], part.schema.names)
                if cells[a] != cell:
                    if last is not None and index is not None:
                        yield from sliced(last(index))
                    cell, held, index, rows = cells[a], [], None, None
                if sides[a] == 0:
                    held.append(part)
                    continue
                if index is None:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                    index = build(rows.column(2))
                    # the index has what it needs of the sets
                    rows = rows.set_column(2, "bits", pa.nulls(len(rows)))
                yield from sliced(answer(index, rows, part))
        if last is not None and index is not None:
            yield from sliced(last(index))

    return run
