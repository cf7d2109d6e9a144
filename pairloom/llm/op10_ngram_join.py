"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts become sets of hashed shingles of ``size`` consecutive words. Equal sets are one class from
there on, so copies, however many, cost nothing more. A class has ``trees`` prefixes of ``depth`` minimum
hashes; equal prefixes meet in a node of that tree's trie. Matching starts at full depth and shortens the
prefix until the chance that a pair at the threshold meets in some tree, 1 - (1 - s^d)^trees, reaches the
target recall. A pair belongs to the first tree in which it meets and is looked at only there.

A node is dealt to a grid of blocks of ``block`` classes. A first pass compares signatures in each block and
tells which classes have a partner there that is not clearly too far; the sets of these, and only these,
are made again from one text each and sent to their blocks, where a second pass compares exactly. A block
gives back sums of links and one edge a class, never its pairs: a group of near copies is compared pair
by pair (its links between different texts are counted exactly), but no list of pairs is ever a table.

Words are runs without ASCII white space, as they stand. A text of one to ``size`` - 1 words is one
shingle, all its words. Defined results: NULL text is the empty text; texts without words are equal to each
other; NULL ids get their own rows and never name a group; repeated rows are copies of each other; an
empty table gives an empty table; other columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import give_back, map_rows, short_batches, staged
from pairloom.llm.graph import components

SIZE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.999
BLOCK = 256
BROADCAST_ROWS = 1_000_000  # keys of classes to fetch are broadcast only if counted to be at most so many
HELD_WORDS = 250_000  # hashes of words that a task keeps
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FAR = 0.2  # what an estimate from TREES * DEPTH hashes may be off (over four standard deviations)


def shortened(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


class Shingler:
    """Texts to sorted sets of 64-bit shingle hashes; words are hashed once per task."""

    class _Words(dict):
        def __missing__(self, w: bytes) -> int:
            if len(self) > HELD_WORDS:
                self.clear()
            h = self[w] = xxhash.xxh64_intdigest(w)
            return h

    def __init__(self, size: int = SIZE):
        self.size, self.words = size, self._Words()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, np.uint64(min(len(h), self.size)))
        for k in range(min(self.size, len(h))):
            out = out * np.uint64(0x100000001B3) + h[k : k + n]
            out ^= out >> np.uint64(29)
            out *= _MIX
        return np.unique(out ^ (out >> np.uint64(32)))


def signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set, as 16 bits of its hash.

    Nodes and likeness go by these 16 bits everywhere: sets with equal minima always agree in them.
    """
    if not len(s):
        return np.zeros(len(factors), np.uint16)
    best = None
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096]
        got = np.array([(part * f).min() for f in factors])
        best = got if best is None else np.minimum(best, got)
    return ((best ^ (best >> np.uint64(32))) * _MIX >> np.uint64(48)).astype(np.uint16)


def factors(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("rid"))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, n: int) -> DataFrame:
    """doc_id, rid (row key), cls (hash of the set), sig."""
    fs = factors(n)

    def make():
        shingler = Shingler(size)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            cls, sig = [], []
            texts = batch.column(1).cast(pa.binary())
            for t in texts:
                s = shingler(t.as_py())
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s, fs).tobytes())
            return pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "rid", "cls", "sig"]
            )

        return each

    return map_rows(_with_key(docs, id_col, text_col), "doc_id long, rid long, cls binary, sig binary", make)


def near_keys(sig: np.ndarray, trees: int, short: int) -> np.ndarray:
    """Node of each class (rows) in each tree at the shortened depth, from signatures."""
    part = sig.reshape(len(sig), trees, -1).astype(np.uint64)
    key = np.zeros((len(sig), trees), np.uint64)
    for k in range(short):
        key = (key + part[:, :, k] + np.uint64(1)) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def nodes(classes: DataFrame, trees: int, short: int) -> DataFrame:
    """cls, tree, near: the class's node in each tree."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            n = batch.num_rows
            if not n:
                return None
            near = near_keys(signature_rows(batch.column(1)), trees, short)
            at = pa.array(np.repeat(np.arange(n), trees))
            tree = np.tile(np.arange(trees, dtype=np.int32), n)
            return pa.record_batch([batch.column(0).take(at), pa.array(tree), pa.array(near.reshape(-1))], names=["cls", "tree", "near"])

        return each

    return map_rows(classes.select("cls", "sig"), "cls binary, tree int, near long", make)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """cls, set of the wanted classes (rid), made again from the text of one document each and dealt by class, once.

    Other texts with the same row key may add their classes; those meet nobody.
    """
    keys = wanted.select("rid").distinct()
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = _with_key(docs, id_col, text_col).join(keys, "rid", "left_semi").select("rid", "text")

    def make():
        shingler = Shingler(size)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingler(t.as_py()).tobytes() for t in batch.column(1).cast(pa.binary())]
            cls = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            return pa.record_batch([batch.column(0), pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], names=["rid", "cls", "set"])

        return each

    made = map_rows(texts, "rid long, cls binary, set binary", make)
    # a repeated row gives its set once more; one row per class is kept
    w = Window.partitionBy("cls").orderBy("rid")
    return made.withColumn("k", F.row_number().over(w)).filter("k = 1").select("cls", "set")


KEYS = ["tree", "near", "i", "j"]


def by_block(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(table, keys)`` for tables of whole blocks; many small blocks are worked on together.

    ``rows`` start with KEYS and ``own``; ``keys`` holds these five as rows of an array.
    """
    placed = rows.repartition(*KEYS).sortWithinPartitions(*KEYS)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            keys = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(5)])
            last = np.flatnonzero((keys[:4] == keys[:4, -1:]).all(axis=0))[0]  # the last block may go on
            held = t.slice(last)
            if last:
                yield from work(t.slice(0, last), keys[:, :last]).to_batches()
        if held is not None:
            keys = np.stack([held.column(k).to_numpy().astype(np.int64) for k in range(5)])
            yield from work(held, keys).to_batches()
        held = None
        give_back()

    short_batches(rows.sparkSession)
    return placed.mapInArrow(run, schema)


def _pairs(keys: np.ndarray, small: int = 24):
    """Row pairs within each block, in pieces; of two different parts only those between the parts."""
    n = keys.shape[1]
    cuts = np.concatenate(([0], np.flatnonzero((keys[:4, 1:] != keys[:4, :-1]).any(axis=0)) + 1, [n]))
    sizes = np.diff(cuts)
    block = np.repeat(np.arange(len(sizes)), sizes)
    own, few = keys[4], np.repeat(sizes <= small, sizes)
    mixed = keys[2] != keys[3]
    for d in range(1, min(small, int(sizes.max(initial=0)))):
        p = np.flatnonzero((block[:-d] == block[d:]) & few[:-d])
        p = p[~mixed[p] | (own[p] != own[p + d])]
        if len(p):
            yield p, p + d
    for k in np.flatnonzero(sizes > small).tolist():
        at = np.arange(cuts[k], cuts[k + 1])
        if mixed[at[0]]:
            left, right = at[own[at] == keys[2, at[0]]], at[own[at] == keys[3, at[0]]]
            yield np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            p, q = np.triu_indices(len(at), 1)
            yield at[p], at[q]


def partners(t: pa.Table, keys: np.ndarray, trees: int, short: int, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that meet first in their block's tree and whose signatures are near enough."""
    sig = signature_rows(t.column("sig").combine_chunks())
    near, earlier = near_keys(sig, trees, short), np.arange(trees)[None]
    out_p, out_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in _pairs(keys):
        for a in range(0, len(p), 50_000):
            x, y = p[a : a + 50_000], q[a : a + 50_000]
            ok = ~((near[x] == near[y]) & (earlier < keys[0, x][:, None])).any(axis=1)
            x, y = x[ok], y[ok]
            ok = (sig[x] == sig[y]).sum(axis=1) >= (1 - far) * sig.shape[1]
            out_p.append(x[ok])
            out_q.append(y[ok])
    return np.concatenate(out_p), np.concatenate(out_q)


def grouped(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """The columns of ``jaccard_join`` and root, the smallest class of the row's group: the group itself."""
    short = shortened(threshold, trees, depth, recall)
    far = 1 - threshold + _FAR
    rows = staged(signatures(docs, id_col, text_col, size, trees * depth))
    classes = rows.groupBy("cls").agg(
        F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("class_id"), F.min(F.struct("rid", "sig")).alias("x")
    )
    classes = staged(classes.select("cls", "m", "class_id", "x.rid", "x.sig"))
    # nodes with company, dealt to a grid of blocks
    at = F.count(F.lit(1)).over(Window.partitionBy("tree", "near"))
    met = nodes(classes, trees, short).withColumn("n", at).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("tree", "near", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls")
    # 1. by signature: which classes have a partner in a block
    first = met.join(classes.select("cls", "sig"), "cls").select(*KEYS, "own", "cls", "sig")

    def tell(t: pa.Table, keys: np.ndarray) -> pa.Table:
        p, q = partners(t, keys, trees, short, far)
        return t.select([*KEYS, "own", "cls"]).take(pa.array(np.union1d(p, q).astype(np.int64)))

    needed = staged(by_block(first, "tree int, near long, i int, j int, own int, cls binary", tell))
    wanted = staged(classes.join(needed.select("cls").distinct(), "cls", "left_semi").select("rid", "cls", "m", "sig"))
    # 2. exactly: sums of links per class and the edges of each block's components
    places = needed.join(wanted.select("cls", "m", "sig"), "cls")
    second = places.join(shingle_sets(docs, wanted, id_col, text_col, size), "cls").select(*KEYS, "own", "cls", "m", "sig", "set")
    named = [("a", pa.binary()), ("b", pa.binary()), ("w", pa.int64())]

    def verify(t: pa.Table, keys: np.ndarray) -> pa.Table:
        p, q = partners(t, keys, trees, short, far)
        own = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        sizes, m = np.array([len(x) for x in own]), t.column("m").to_numpy()
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        hit = np.zeros(len(p), bool)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [len(p)])) if len(p) else np.zeros(1, np.int64)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            mine, x, ys = slice(a, b), int(p[a]), q[a:b]
            every = np.concatenate([own[y] for y in ys.tolist()])
            k = np.minimum(np.searchsorted(own[x], every), max(len(own[x]) - 1, 0))
            found = own[x][k] == every if len(own[x]) else np.zeros(len(every), bool)
            ends = np.cumsum(sizes[ys])
            total = np.concatenate(([0], np.cumsum(found)))
            both = total[ends] - total[ends - sizes[ys]]
            hit[mine] = both >= threshold * (sizes[x] + sizes[ys] - both) - 1e-9
        p, q = p[hit], q[hit]
        names = t.column("cls").to_pylist()
        w = np.bincount(p, m[q], minlength=len(names)) + np.bincount(q, m[p], minlength=len(names))
        label = np.arange(len(names))
        while True:
            new = label.copy()
            np.minimum.at(new, p, label[q])
            np.minimum.at(new, q, new[p])
            if (new == label).all():
                break
            label = new
        some, edges = np.flatnonzero(w).tolist(), np.flatnonzero(label != np.arange(len(names))).tolist()
        return pa.table(
            [
                pa.array([names[k] for k in some + edges], pa.binary()),
                pa.array([None] * len(some) + [names[label[k]] for k in edges], pa.binary()),
                pa.array([int(w[k]) for k in some] + [None] * len(edges), pa.int64()),
            ],
            schema=pa.schema(named),
        )

    found = staged(by_block(second, "a binary, b binary, w long", verify))
    links = found.filter("w is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
    roots = components(found.filter("w is null").select("a", "b")).select(F.col("node").alias("cls"), "root")
    c = classes.select("cls", "m", "class_id").join(links, "cls", "left").join(roots, "cls", "left")
    n_links = F.col("m") - 1 + F.coalesce("w", F.lit(0).cast("long"))
    c = staged(c.select("cls", "class_id", F.coalesce("root", "cls").alias("root"), n_links.alias("n_links")))
    groups = c.groupBy("root").agg(F.min("class_id").alias("group_id"))
    c = c.join(groups, "root").select("cls", "class_id", "n_links", "group_id", "root")
    out = rows.select("doc_id", "rid", "cls").join(c, "cls")
    kept = F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept")
    return out.select("doc_id", "rid", "class_id", "n_links", "group_id", kept, "root")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per document: doc_id, rid, class_id, n_links, group_id, kept.

    class_id: smallest id with the same shingle set; n_links: other documents with at least the
    threshold's likeness, copies included; group_id: smallest id reachable by links; kept: whether the row
    is the one that stays of its group (of repeated rows with that id, all are marked).
    """
    return grouped(docs, id_col, text_col, **settings).drop("root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """All columns of ``docs``, one document of each group: the smallest id, of equal ones the smallest row key.

    Repeated rows and groups that have only NULL ids keep one row as well, each group its own: neither NULL
    nor an id that different texts share names a group.
    """
    found = staged(grouped(docs, id_col, text_col, **settings).filter("kept").select("root", "rid"))
    stays = found.groupBy("root").agg(F.min("rid").alias("_rid"), F.count(F.lit(1)).alias("_n"))
    keys = stays.select("_rid", "_n").filter("_rid is not null")
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.xxhash64(F.col(id_col).cast("long"), text).alias("_rid")).join(keys, "_rid")
    once = d.filter("_n = 1").select("row.*")
    return once.unionAll(d.filter("_n > 1").dropDuplicates(["_rid"]).select("row.*"))
