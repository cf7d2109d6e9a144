"""Embedding near-duplicates by product quantisation over inverted lists, without losing a link.

Vectors are scaled to length one, so cosine >= c is distance <= t = sqrt(2 - 2c). Equal vectors are one
class from there on. Coarse centroids cut the space into lists; a class keeps the code of its residual
(one centroid number per subspace) and the length of what the code misses. Centroids are fitted by
k-means on a bounded sample (``sample_rows``, lowest hash first); every vector is indexed.

Probes are sufficient: two vectors within t lie in lists whose dividing plane is within t of both, so a
vector visits just the lists for which that holds, always from the higher list number to the lower.
In a list, the distance from the query to each decoded vector (the look-ups of all subspaces at once, as a
product with the decoded codes) less what the code misses is a lower bound, and whatever it does not exclude is compared exactly by cosine
in double precision. So the result is that of comparing all pairs.

A list is dealt to a grid of blocks of vectors and parts of queries, so no task holds a whole list.
A task adds up links and sends one edge per vector, never its pairs.

Defined results: a vector that is NULL, zero, or holds NULL or non-finite components links with nothing
and is its own component; vectors of different lengths do not link; repeated rows are equal vectors;
NULL ids stay NULL and name no component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import map_rows, staged
from pairloom.llm.graph import components

SAMPLE_ROWS = 16_384
MAX_LISTS = 4096
CODES = 256
SUBSPACES = 8
BASE_ROWS = 4096
QUERY_ROWS = 16_384


@dataclass
class Index:
    """Coarse centroids (lists x dim), and per subspace its columns and centroids."""

    coarse: np.ndarray
    columns: list[np.ndarray]
    codes: list[np.ndarray]

    def assign(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest list of each row and its squared distances to all lists."""
        d2 = squared(u, self.coarse)
        return d2.argmin(axis=1), d2

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each residual and the length of what it misses."""
        code = np.zeros((len(residual), len(self.codes)), np.uint8)
        missed = np.zeros(len(residual))
        for s, (cols, book) in enumerate(zip(self.columns, self.codes, strict=True)):
            code[:, s] = squared(residual[:, cols], book).argmin(axis=1)
            missed += ((residual[:, cols] - book[code[:, s]]) ** 2).sum(axis=1)
        return code, np.sqrt(missed)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        out = np.zeros((len(code), sum(map(len, self.columns))))
        for s, (cols, book) in enumerate(zip(self.columns, self.codes, strict=True)):
            out[:, cols] = book[code[:, s]]
        return out


class Bounds:
    """Which of a list's vectors can be within ``reach`` of a query, by the distance to the decoded code less what the code misses.

    The look-ups of all subspaces are one matrix product with the decoded codes, in single precision: ``slack`` is
    above its rounding error, so no pair is lost.
    """

    def __init__(self, decoded: np.ndarray, missed: np.ndarray, reach: float) -> None:
        self.x = decoded.astype(np.float32)
        self.norms = (decoded * decoded).sum(axis=1)
        self.limits = (reach + missed) ** 2
        # error of a product of n terms: n * 2^-24 * |x| * |y|, and as much for rounding both sides
        self.slack = (decoded.shape[1] + 8) * 2.0**-22
        self.longest = float(self.norms.max(initial=0)) + float(self.limits.max(initial=0)) + 1
        self.own = (self.norms - self.limits).astype(np.float32)

    def candidates(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) numbers in ascending order."""
        n = (residual * residual).sum(axis=1)
        got = residual.astype(np.float32) @ self.x.T
        got *= -2
        got += self.own
        most = self.slack * (n + self.longest) - n
        return np.nonzero(got <= most.astype(np.float32)[:, None])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of at most k groups."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def build(x: np.ndarray, lists: int) -> Index:
    coarse = k_means(x, lists)
    residual = x - coarse[squared(x, coarse).argmin(axis=1)]
    columns = [c for c in np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1])) if len(c)]
    return Index(coarse, columns, [k_means(residual[:, c], CODES, 6) for c in columns])


def units(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, cls (hash of the vector), raw; the last two NULL where the vector links with nothing."""
    d = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            dim, cls, raw = [], [], []
            for v in batch.column(1):
                a = None
                if v.is_valid and v.values.null_count == 0 and len(v.values):
                    a = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    top = np.abs(a).max() if np.isfinite(a).all() else 0
                    a = a / 2.0 ** np.floor(np.log2(top)) if top > 0 else None  # no overflow in the norm
                    a = a + 0.0 if a is not None else None  # one zero
                data = None if a is None else a.tobytes()
                dim.append(0 if a is None else len(a))
                cls.append(None if a is None else hashlib.blake2b(data, digest_size=16).digest())
                raw.append(data)
            return pa.record_batch(
                [batch.column(0), pa.array(dim, pa.int32()), pa.array(cls, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "dim", "cls", "raw"]
            )

        return each

    return map_rows(d, "vec_id long, dim int, cls binary, raw binary", make)


def links(classes: DataFrame, n: int, cosine: float, sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """(cls, w): weights of linked classes, to be summed; (a, b): edges with the same components as the links."""
    spark = classes.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    some = classes.select("cls", "raw").orderBy(F.xxhash64("cls"), "cls").limit(sample_rows).collect()  # bounded sample
    index = build(units([bytes(r["raw"]) for r in some]), min(MAX_LISTS, max(1, round(n**0.5 / 4))))
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids

    def place():
        ix = shared.value
        apart = np.sqrt(squared(ix.coarse, ix.coarse))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, codes, missed, probes = [], [], [], []
            for k in range(0, batch.num_rows, 1024):
                u = units(batch.column(2).slice(k, 1024).to_pylist())
                b, d2 = ix.assign(u)
                code, miss = ix.encode(u - ix.coarse[b])
                gap = np.where(apart[b] > 0, (d2 - d2[np.arange(len(b)), b][:, None]) / (2 * np.maximum(apart[b], 1e-30)), 0)
                near = (gap <= reach) & (np.arange(len(ix.coarse))[None] < b[:, None])
                own.append(b)
                missed.append(miss)
                codes += [c.tobytes() for c in code]
                probes += [np.flatnonzero(r).astype(np.int32) for r in near]
            return pa.record_batch(
                [*batch.columns, pa.array(np.concatenate(own).astype(np.int32)), pa.array(codes, pa.binary()), pa.array(np.concatenate(missed)), pa.array(probes, pa.list_(pa.int32()))],
                names=["cls", "m", "raw", "list", "code", "missed", "probes"],
            )

        return each

    placed = staged(map_rows(classes.select("cls", "m", "raw"), "cls binary, m long, raw binary, list int, code binary, missed double, probes array<int>", place))
    base = placed.groupBy(F.col("list").alias("c")).agg(F.count(F.lit(1)).alias("nb"))
    asked = placed.select(F.explode(F.concat("probes", F.array("list"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("nq"))
    grid = base.join(asked, "c").select(
        "c", F.ceil(F.col("nb") / BASE_ROWS).cast("int").alias("nb"), F.ceil(F.col("nq") / QUERY_ROWS).cast("int").alias("nq")
    )
    grid = F.broadcast(staged(grid))  # a row per list
    h = F.xxhash64("cls")
    rows = ["side", "cls", "m", "raw", "list", "code", "missed"]
    held = placed.withColumn("side", F.lit(0)).withColumn("c", F.col("list")).join(grid, "c")
    held = held.withColumn("block", F.pmod(h, F.col("nb")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    ask = placed.withColumn("side", F.lit(1)).withColumn("c", F.explode(F.concat("probes", F.array("list")))).join(grid, "c")
    ask = ask.withColumn("part", F.pmod(h, F.col("nq")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    both = held.select("c", "block", "part", *rows).unionAll(ask.select("c", "block", "part", *rows))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        ix, c = shared.value, key[0].as_py()
        side = t.column("side").to_numpy()
        left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        x_id, y_id = left.column("cls").to_pylist(), right.column("cls").to_pylist()
        out_id: list[bytes] = []
        out_w: list[int] = []
        a: list[bytes] = []
        b: list[bytes] = []
        if x_id and y_id:
            x = units(left.column("raw").to_pylist())
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            missed, mx = left.column("missed").to_numpy(), left.column("m").to_numpy()
            my, home = right.column("m").to_numpy(), right.column("list").to_numpy()
            names = np.array(x_id, dtype=object)
            got_x = np.zeros(len(x), np.int64)
            bounds = Bounds(ix.decoded(code), missed, reach)
            for k in range(0, len(y_id), 256):
                y = units(right.column("raw").slice(k, 256).to_pylist())
                q, p = bounds.candidates(y - ix.coarse[c])
                same = home[k + q] == c  # within a list each pair once
                ok = ~same | (names[p] < np.array(y_id, dtype=object)[k + q]) if len(q) else np.zeros(0, bool)
                q, p = q[ok], p[ok]
                hit = np.einsum("ij,ij->i", y[q], x[p]) >= cosine
                q, p = q[hit], p[hit]
                if not len(q):
                    continue
                np.add.at(got_x, p, my[k + q])
                w = np.bincount(q, mx[p], minlength=len(y)).astype(np.int64)
                for i in np.flatnonzero(w).tolist():
                    out_id.append(y_id[k + i])
                    out_w.append(int(w[i]))
                # components of these links: smallest base row reached, passed on until nothing changes
                lx, ly = np.arange(len(x)), np.full(len(y), len(x))
                while True:
                    ny = ly.copy()
                    np.minimum.at(ny, q, lx[p])
                    nx = lx.copy()
                    np.minimum.at(nx, p, ny[q])
                    if (nx == lx).all() and (ny == ly).all():
                        break
                    lx, ly = nx, ny
                for i in np.flatnonzero(lx != np.arange(len(x))).tolist():
                    a.append(x_id[i])
                    b.append(x_id[lx[i]])
                for i in np.unique(q).tolist():
                    a.append(y_id[k + i])
                    b.append(x_id[ly[i]])
            for i in np.flatnonzero(got_x).tolist():
                out_id.append(x_id[i])
                out_w.append(int(got_x[i]))
        n_w, n_e = len(out_id), len(a)
        return pa.table(
            [pa.array(out_id + a, pa.binary()), pa.array([None] * n_w + b, pa.binary()), pa.array(out_w + [None] * n_e, pa.int64())], names=["a", "b", "w"]
        )

    found = staged(both.groupBy("c", "block", "part").applyInArrow(compare, "a binary, b binary, w long"))
    return found.filter("w is not null").select(F.col("a").alias("cls"), "w"), found.filter("w is null").select("a", "b")


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = staged(vectors(table, id_col, vector_col))
    valid = rows.filter("cls is not null")
    classes = staged(valid.groupBy("dim", "cls").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first"), F.min("raw").alias("raw")))
    weights, edges = None, None
    for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # one row per length in use
        w, e = links(classes.filter(F.col("dim") == r["dim"]), r["n"], cosine, sample_rows)
        weights = w if weights is None else weights.unionAll(w)
        edges = e if edges is None else edges.unionAll(e)
    if weights is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(edges).select(F.col("node").alias("cls"), "root")
    c = classes.select("cls", "m", "first").join(weights.groupBy("cls").agg(F.sum("w").alias("w")), "cls", "left")
    c = c.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    c = staged(c.select("cls", "root", "first", (F.col("m") - 1 + F.coalesce("w", F.lit(0))).alias("n_links")))
    c = c.join(c.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("cls", "n_links", "component_id")
    out = rows.select("vec_id", "cls").join(c, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
