"""Language-model scores from a subword lattice.

A word may be spelled by the pieces of an existing unigram vocabulary in many ways; the lattice sums
the weights of all of them by a forward recursion in log space, so a word's probability does not
depend on one segmentation. The vocabulary is fixed. Its scores give the first weights of the
pieces, and ``rounds`` of expected counts over all distinct training words (forward-backward, the
words weighted by their counts) turn them into probabilities; then the lattice gets one more arc per
word, the word as a whole, weighted by its training count, and the subword arcs share the mass that
Good and Turing leave to unseen words:

    P(word) = (c + k * lattice(word)) / (N + k),   k / (N + k) = share of words seen once

The document's probability is the product over its words and its end, a proper distribution over
texts: a piece that starts with the mark opens a word, no other one does.

Nothing but the piece weights (32,000 numbers) and a row of totals goes over the driver. One pass cuts
the texts into chunks of at most ``chunk_chars``; a chunk sends its distinct words with training counts
to be summed, gets their probabilities back, and adds up its documents. Text is never shuffled.

Defined results: NULL text is the empty text (only the end token); NULL ids stay NULL and train (their
crc is that of the empty text); repeated rows count and appear as often as they occur; without
training rows N is 0 and every word gets its lattice weight; an empty table gives an empty table;
other columns are ignored. Texts are read whole; a longer one than ``chunk_chars`` is a chunk alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import id_and_text, joined, key_crc, map_rows, staged
from pairloom.llm.lattice import Lattice, vocabulary
from pairloom.llm.tokens import tokenizer_path

ROUNDS = 2
CHUNK_CHARS = 32_000_000
PRIOR = 1000.0  # pseudo-count of the starting weights, in pieces
_SLICE = 100_000
LATTICE_ROWS = 50_000  # words in the lattice at once: it works on those of one length together


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


class _Chunk:
    """Documents as counted word numbers, and the chunk's words."""

    def __init__(self) -> None:
        self.ids, self.docs, self.chars = _Ids(), [], 0

    def add(self, doc: int | None, train: bool, text: bytes) -> None:
        words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
        got = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        own, tf = np.unique(got, return_counts=True)
        self.docs.append((doc, train, len(words) + 1, own, tf))
        self.chars += len(text)

    def blob(self) -> bytes:
        own = [np.diff(d[3], prepend=0) for d in self.docs]
        parts = [
            np.array([d[0] or 0 for d in self.docs], "<i8"),
            np.array([(d[0] is None) + 2 * d[1] for d in self.docs], "u1"),
            np.array([d[2] for d in self.docs], "<i8"),
            np.array([len(d[3]) for d in self.docs], "<u4"),
            np.concatenate(own).astype("<u4"),
            np.concatenate([d[4] for d in self.docs]).astype("<u4"),
        ]
        return zstandard.ZstdCompressor(level=1).compress(np.array([len(self.docs)], "<i8").tobytes() + b"".join(p.tobytes() for p in parts))

    def train_counts(self) -> np.ndarray:
        train = [d for d in self.docs if d[1]]
        if not train:
            return np.zeros(len(self.ids), np.int64)
        own, tf = np.concatenate([d[3] for d in train]), np.concatenate([d[4] for d in train])
        return np.bincount(own, tf, minlength=len(self.ids)).astype(np.int64)


def _opened(blob: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for kind in ("<i8", "u1", "<i8", "<u4"):
        a = np.frombuffer(data, kind, n, at)
        at += a.nbytes
        out.append(a)
    pairs = int(out[3].sum())
    own = np.frombuffer(data, "<u4", pairs, at).astype(np.int64)
    tf = np.frombuffer(data, "<u4", pairs, at + 4 * pairs).astype(np.int64)
    starts = np.cumsum(out[3], dtype=np.int64) - out[3]
    # differences within a document: running sums, less what came before the document
    total = np.cumsum(own)
    before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0) if pairs else np.zeros(n, np.int64)
    own = total - np.repeat(before, out[3])
    return (*out, own, tf)


def chunks(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int, chunk_chars: int) -> DataFrame:
    """Rows of words (chunk, idx, word, train_tf) and one row with the documents per chunk (idx -1)."""
    d = id_and_text(docs, id_col, text_col).withColumn("train", key_crc(F.col("doc_id"), folds) != fold)
    names = ["chunk", "idx", "word", "train_tf", "blob"]

    def run(batches):
        part, seq, c = TaskContext.get().partitionId(), 0, _Chunk()

        def rows(key: int):
            counts, n = c.train_counts(), len(c.ids)
            words = pa.array(list(c.ids), pa.binary()).cast(pa.string())
            for a in range(0, n, _SLICE):
                m = min(_SLICE, n - a)
                yield pa.record_batch(
                    [pa.array(np.full(m, key)), pa.array(np.arange(a, a + m, dtype=np.int32)), words.slice(a, m), pa.array(counts[a : a + m]), pa.nulls(m, pa.binary())],
                    names=names,
                )
            yield pa.record_batch(
                [pa.array([key]), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([0], pa.int64()), pa.array([c.blob()], pa.binary())],
                names=names,
            )

        for batch in batches:
            ids, train = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(1).cast(pa.binary())
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if c.docs and c.chars + len(text) > chunk_chars:
                    yield from rows((part << 20) + seq)
                    seq, c = seq + 1, _Chunk()
                c.add(ids[k], train[k], text)
        if c.docs:
            yield from rows((part << 20) + seq)

    return d.mapInArrow(run, "chunk long, idx int, word string, train_tf long, blob binary")


def learn(counts: DataFrame, n_docs: int, model: str, rounds: int) -> tuple[np.ndarray, float]:
    """log weights of the pieces and log probability of an end at a word boundary."""
    pieces, bytes_at, start = vocabulary(tokenizer_path(model))
    spark = counts.sparkSession
    weights = start / start.sum()
    prior = weights * PRIOR
    end = 0.002
    seen = counts.filter("c > 0")
    opens = np.array([p.startswith("▁") for p in pieces] + [False] * 256)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(np.log(weights * (1 - end)))

        def make(shared=shared):
            lattice, total = Lattice(pieces, bytes_at), np.zeros(len(pieces) + 256)

            def each(batch: pa.RecordBatch) -> None:
                total[:] += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float), shared.value)

            return each, total

        def run(batches, make=make):
            each, total = make()
            for b in joined(batches, LATTICE_ROWS):
                each(b)
            k = np.flatnonzero(total)
            yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["piece", "n"])

        sums = seen.select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        got = prior.copy()
        for r in sums.collect():  # at most one row per piece of the fixed vocabulary
            got[r["piece"]] += r["n"]
        end = (n_docs + 1) / (got.sum() + n_docs + 1)
        weights = got / got.sum()
        shared.unpersist()
    logp = np.log(weights * (1 - end))
    inner = float((weights * (1 - end))[~opens].sum())  # pieces that go on within a word
    return logp, float(np.log(end) - np.log(1 - inner))


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    fold: int = 2,
    model: str = "piece_bpe_32k.model",
    rounds: int = ROUNDS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    rows = staged(chunks(docs, id_col, text_col, folds, fold, chunk_chars))
    words = rows.filter("idx >= 0").select("chunk", "idx", "word", "train_tf")
    counts = staged(words.groupBy("word").agg(F.sum("train_tf").alias("c")))
    n, v, once = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)),
        F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)),
        F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)),
    ).first()
    d = docs.agg(F.coalesce(F.sum((key_crc(F.col(id_col).cast("long"), folds) != fold).cast("long")), F.lit(0))).first()[0]
    n, v = n + d, v + (d > 0)
    unseen = max(1.0, once * n / max(n - once, 1))
    logp, log_end = learn(counts, d, model, rounds)
    pieces, bytes_at, _ = vocabulary(tokenizer_path(model))
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def make():
        lattice = Lattice(pieces, bytes_at)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            log_l = lattice.log_marginals(batch.column(0).to_pylist(), shared.value)
            with np.errstate(divide="ignore"):
                p = np.logaddexp(np.log(c), np.log(unseen) + log_l) - np.log(n + unseen)
            return pa.record_batch([*batch.columns, pa.array(p / np.log(10))], names=["word", "c", "lp"])

        return each

    scored = map_rows(counts.select("word", "c"), "word string, c long, lp double", make, LATTICE_ROWS)
    back = words.select("chunk", "idx", "word").join(scored, "word").select(F.col("chunk").alias("of"), "idx", "c", "lp")
    end_p = float(np.log10(d + unseen * np.exp(log_end)) - np.log10(n + unseen))
    end_base = float(np.log10((d + 1) / (n + v + 1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("idx").to_numpy()
        c, lp = np.zeros(len(at)), np.zeros(len(at))
        c[at], lp[at] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        known = c > 0
        out = []
        for blob in left.column("blob").to_pylist():
            doc, flags, tokens, sizes, own, tf = _opened(blob)
            edges = np.repeat(np.arange(len(doc)), sizes)
            sums = [np.bincount(edges, tf * x[own], minlength=len(doc)) for x in (base, lp, known)]
            out.append(
                pa.table(
                    [
                        pa.array(doc, mask=(flags & 1).astype(bool)),
                        pa.array((flags & 2) == 0),
                        pa.array(tokens),
                        pa.array(sums[2].astype(np.int64) + (d > 0)),
                        pa.array(np.full(len(doc), n)),
                        pa.array(sums[0] + end_base),
                        pa.array(sums[1] + end_p),
                    ],
                    names=names,
                ).cast(pa.schema(list(zip(names, kinds, strict=True))))
            )
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, kinds, strict=True))).empty_table()

    documents = rows.filter("idx = -1").select("chunk", "blob")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return documents.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(add_up, schema)
