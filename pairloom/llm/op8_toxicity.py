"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed parts: the lower-cased word and its beginnings of three to six
letters, each known by a 32-bit hash, so inflected forms share rows. Parts found in enough training
documents own a row, all others share the zero row. Filters of widths 1, 2 and 3 slide over the whole text, each
keeps its maximum, and a logistic layer gives the score. Gradients flow through the maxima only, so a
training step touches few rows. Training stops at the best loss on the calibration rows.

The fit takes a bounded sample of labelled rows (``per_class`` rows of each label, lowest hash of the
id first, texts of at most ``train_chars``; documented parameters); all documents are scored, whole.
Label, language, source and id are no inputs of a score. Thresholds are calibrated per language on all
labelled calibration rows, sampled or not and of any length (no held-out row; by the id's hash, so that no
training step sees them): they are scored in Spark and counted per language, label and bin of the score's
logit, so labels keep their real share and only counts go over the driver. The threshold is the one of best
F1, the nearest to 0.5 among equals, 0.5 where a language has fewer than ``least`` rows of either label.
An id with both labels counts once as each; rows of a repeated id count each.

Defined results: NULL text is the empty text; the empty text has a score like any other; NULL ids stay
NULL (their crc is that of the empty text); repeated rows repeat; labels that are neither 0 nor 1, and
labels without a document, are ignored; with no usable label of one kind all scores are the share of
label 1 (0 if there is none); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import key_crc, map_rows, staged

_WORD = re.compile(r"\w+")
WIDTHS = (1, 2, 3)
FILTERS = 12
DIM = 12
MAX_ROWS = 1 << 16
PER_CLASS = 2500
TRAIN_CHARS = 200_000
CALIBRATION = 4  # one training row in so many is kept for early stopping and thresholds
BINS = 64  # bins of a score per unit of its logit, which is within 30 of 0


STARTS = (3, 4, 5, 6)
PARTS = len(STARTS) + 1


def parts(word: str) -> list[int]:
    """Hashes of a word's parts; a beginning as long as the word counts as its whole only."""
    out = [zlib.crc32(word.encode())]
    out += [zlib.crc32((word[:n] + "*").encode()) if len(word) > n else 0 for n in STARTS]
    return out


@dataclass
class Model:
    """Embedding rows and filters; ``rows`` maps the hash of a part to its row, row 0 is all others."""

    rows: dict[int, int] = field(default_factory=dict)
    emb: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def part_rows(self, word: str) -> list[int]:
        return [self.rows.get(h, 0) for h in parts(word)]

    def tables(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """Per width and place in the window: what a word adds to each filter."""
        return [[(vectors @ w[k]).astype(np.float32) for k in range(len(w))] for w in self.filters]

    def score(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> float:
        if self.emb is None:
            return float(1 / (1 + np.exp(-self.shift)))
        top = [pooled(x, t)[0] + b for t, b in zip(tables, self.bias, strict=True)]
        z = float(np.maximum(np.concatenate(top), 0) @ self.out + self.shift)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def padded(x: np.ndarray) -> np.ndarray:
    """Zero rows around a document, so that every width has a window."""
    edge = np.zeros(max(WIDTHS) - 1, dtype=x.dtype)
    return np.concatenate((edge, x, edge, edge[:1])) if len(edge) else x


def pooled(x: np.ndarray, tables: list[np.ndarray], step: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Maximum over all windows and its place, for each filter; long documents go by stretches."""
    w = len(tables)
    n = len(x) - w + 1
    best = where = None
    for a in range(0, n, step):
        b = min(n, a + step)
        h = tables[0][x[a:b]]
        for k in range(1, w):
            h = h + tables[k][x[a + k : b + k]]
        at = h.argmax(axis=0)
        top = h[at, np.arange(h.shape[1])]
        if best is None:
            best, where = top, at
        else:
            more = top > best
            best, where = np.where(more, top, best), np.where(more, at + a, where)
    return best, where


class Words:
    """Texts as 32-bit word numbers, and the hashes of each word's parts."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {"": 0}

    def numbers(self, text: str) -> np.ndarray:
        index = self.index
        found = _WORD.findall(text.lower())
        return np.fromiter((index.setdefault(w, len(index)) for w in found), dtype=np.int32, count=len(found))

    def hashes(self) -> np.ndarray:
        every = (h for w in self.index for h in (parts(w) if w else [0] * PARTS))
        return np.fromiter(every, dtype=np.int64, count=len(self.index) * PARTS).reshape(-1, PARTS)


def in_order(docs: list[np.ndarray], hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Words numbered by their first place in ``docs``, so the numbers do not depend on the order texts came in."""
    seen, first = np.unique(np.concatenate([np.zeros(1, np.int32), *docs]), return_index=True)
    order = seen[np.argsort(first, kind="stable")]
    new = np.zeros(len(hashes), dtype=np.int32)
    new[order] = np.arange(len(order), dtype=np.int32)
    return [new[d] for d in docs], hashes[order]


def part_counts(docs: list[np.ndarray], hashes: np.ndarray, held: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of parts and in how many of ``docs`` they occur, merged every ``held`` hashes."""
    keys, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for k, d in enumerate(docs):
        waiting.append(np.unique(hashes[np.unique(d)]))
        size += len(waiting[-1])
        if size >= held or k == len(docs) - 1:
            every = np.concatenate([keys, *waiting])
            weight = np.concatenate([n, np.ones(size, np.int64)])
            keys, at = np.unique(every, return_inverse=True)
            n, waiting, size = np.bincount(at, weight).astype(np.int64), [], 0
    return keys[keys != 0], n[keys != 0]


def train(texts: Iterable[str], labels: np.ndarray, check: np.ndarray, **settings) -> tuple[Model, np.ndarray]:
    """:func:`train_words` on texts."""
    words = Words()
    docs = [words.numbers(t) for t in texts]
    return train_words(docs, words.hashes(), labels, check, **settings)


def train_words(
    docs: list[np.ndarray],
    hashes: np.ndarray,
    labels: np.ndarray,
    check: np.ndarray,
    epochs: int = 10,
    batch: int = 32,
    rate: float = 0.08,
    seed: int = 7,
) -> tuple[Model, np.ndarray]:
    """Fit on word numbers; rows with ``check`` set are kept for early stopping. Returns the model and those rows' scores."""
    share = float(labels.mean()) if len(labels) else 0.0
    model = Model(shift=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    fit = np.flatnonzero(~check)
    held = np.flatnonzero(check)
    if len(fit) == 0 or len(np.unique(labels[fit])) < 2:
        return model, np.full(len(held), share)
    parts_seen, df = part_counts([docs[i] for i in fit], hashes)
    least = max(2, round(len(fit) / 1000))
    parts_seen, df = parts_seen[df >= least], df[df >= least]
    often = parts_seen[np.lexsort((parts_seen, -df))][: MAX_ROWS - 1].tolist()
    model.rows = {h: k + 1 for k, h in enumerate(often)}
    keys = np.array(sorted([0, *often]), dtype=np.int64)
    place = np.array([model.rows.get(int(h), 0) for h in keys.tolist()], dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    word_rows = np.where(keys[at] == hashes, place[at], 0)  # a word's rows, 0 where a part is not admitted
    rng = np.random.default_rng(seed)
    model.emb = rng.normal(0, 0.05, (len(often) + 1, DIM))
    model.emb[0] = 0
    model.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    model.bias = [np.zeros(FILTERS) for _ in WIDTHS]
    model.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS))
    xs = [padded(d) for d in docs]
    weight = np.where(labels == 1, 0.5 / labels[fit].mean(), 0.5 / (1 - labels[fit].mean()))
    sums = {"emb": np.full(model.emb.shape, 1e-2), "out": np.full(model.out.shape, 1e-2)}
    sums |= {("f", k): np.full(f.shape, 1e-2) for k, f in enumerate(model.filters)}
    sums |= {("b", k): np.full(b.shape, 1e-2) for k, b in enumerate(model.bias)}

    def step(p: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
        s += g * g
        p -= rate * g / np.sqrt(s)

    def scores(rows: np.ndarray) -> np.ndarray:
        t = model.tables(model.emb[word_rows].sum(axis=1))
        return np.array([model.score(xs[i], t) for i in rows])

    best, kept, worse = np.inf, None, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for a in range(0, len(fit), batch):
            part = fit[a : a + batch]
            words = np.unique(np.concatenate([xs[i] for i in part]))
            small = model.emb[word_rows[words]].sum(axis=1)
            local = [np.searchsorted(words, xs[i]) for i in part]
            tops, places = [], []
            for t, b in zip(model.tables(small), model.bias, strict=True):
                got = [pooled(x, t) for x in local]
                tops.append(np.stack([g[0] for g in got]) + b)
                places.append(np.stack([g[1] for g in got]))
            z = np.maximum(np.concatenate(tops, axis=1), 0)
            y = 1 / (1 + np.exp(-np.clip(z @ model.out + model.shift, -30, 30)))
            err = (y - labels[part]) * weight[part] / len(part)
            back = err[:, None] * model.out[None, :] * (z > 0)
            g_words = np.zeros_like(small)
            g_out = err @ z + 1e-4 * model.out
            for k, f in enumerate(model.filters):
                dz = back[:, k * FILTERS : (k + 1) * FILTERS]
                g_f = np.zeros_like(f)
                for j in range(len(f)):
                    w = np.stack([x[p + j] for x, p in zip(local, places[k], strict=True)])
                    g_f[j] = np.einsum("bf,bfd->df", dz, small[w])
                    np.add.at(g_words, w, dz[:, :, None] * f[j].T[None])
                step(f, g_f + 1e-4 * f, sums[("f", k)])
                step(model.bias[k], dz.sum(axis=0), sums[("b", k)])
            step(model.out, g_out, sums["out"])
            model.shift -= rate * float(err.sum())
            moved = np.flatnonzero(np.abs(g_words).sum(axis=1))
            rows, back_to = np.unique(word_rows[words[moved]], return_inverse=True)
            g_emb = np.zeros((len(rows), DIM))
            np.add.at(g_emb, back_to.reshape(len(moved), PARTS), g_words[moved][:, None, :])
            g_emb += 1e-4 * model.emb[rows]
            sums["emb"][rows] += g_emb * g_emb
            model.emb[rows] -= rate * g_emb / np.sqrt(sums["emb"][rows])
            model.emb[0] = 0
        if len(held):
            p = np.clip(scores(held), 1e-6, 1 - 1e-6)
            loss = float(np.mean(weight[held] * -np.where(labels[held] == 1, np.log(p), np.log(1 - p))))
            if loss < best - 1e-4:
                best, worse = loss, 0
                kept = [model.emb.copy(), [f.copy() for f in model.filters], [b.copy() for b in model.bias], model.out.copy(), model.shift]
            else:
                worse += 1
                if worse == 2:
                    break
    if kept is not None:
        model.emb, model.filters, model.bias, model.out, model.shift = kept
    return model, scores(held)


def best_cut(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, every: np.ndarray) -> float:
    """The threshold of best F1 from bins of scores in rising order: their bounds, toxic rows and all rows."""
    cuts = np.unique(np.concatenate(([0.5], low, (high[:-1] + low[1:]) / 2)))
    at = np.searchsorted(low, cuts)  # the first bin at or above a cut; no cut is inside a bin
    tp, n = (np.concatenate((x[::-1].cumsum()[::-1], [0]))[at] for x in (toxic, every))
    f1 = 2 * tp / (n + toxic.sum())
    good = cuts[f1 >= f1.max() - 1e-12]
    return float(good[np.abs(good - 0.5).argmin()])


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list, least: int = 20) -> dict[str | None, float]:
    """Per language the threshold of best F1 on calibration rows, the nearest to 0.5 among equals."""
    out = {}
    for lang in set(langs):
        m = np.array([x == lang for x in langs])
        s, y = scores[m], labels[m]
        if min((y == 1).sum(), (y == 0).sum()) < least:
            continue
        low, at = np.unique(s, return_inverse=True)
        out[lang] = best_cut(low, low, np.bincount(at, y == 1), np.bincount(at))
    return out


def held_out(id_col: Column, folds: int = 5) -> Column:
    return key_crc(id_col, folds) == 0


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, per_class: int, train_chars: int
) -> tuple[list[tuple[int, int]], list[np.ndarray], np.ndarray]:
    """At most ``per_class`` labelled training rows of each label: (label, hash of the id), word numbers, hashes of parts.

    Ids first, then their texts.
    """
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    )
    lengths = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    known = lab.groupBy("_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("_id"))
    # twice as many ids as wanted, since labels may lack a document
    ids = None
    for y in (0, 1):
        one = known.filter(F.col("y") == y).orderBy("h").limit(2 * per_class)
        ids = one if ids is None else ids.unionAll(one)
    short = lengths.filter(F.length("text") <= train_chars)
    found = short.select("_id").join(F.broadcast(ids), "_id").dropDuplicates(["_id"])
    rows = sorted(found.select("_id", "y", "h").collect(), key=lambda r: r["h"])  # bounded: 4 * per_class ids
    rows = [r for y in (0, 1) for r in [r for r in rows if r["y"] == y][:per_class]]
    # then the texts of those alone, one partition at a time; what stays is their word numbers
    place = {r["_id"]: k for k, r in enumerate(rows)}
    chosen = docs.sparkSession.createDataFrame([(i,) for i in place], found.select("_id").schema)
    texts = short.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).select("_id", "text")
    words, numbers = Words(), [np.zeros(0, np.int32)] * len(rows)
    for r in texts.toLocalIterator():
        numbers[place[r["_id"]]] = words.numbers(r["text"])
    return [(r["y"], r["h"]) for r in rows], *in_order(numbers, words.hashes())


def kept_for_calibration(h: Column) -> Column:
    """Whether the row of an id with this hash is left out of the training steps."""
    return F.crc32(h.cast("string").cast("binary")) % CALIBRATION == 0


def score_counts(
    docs: DataFrame, labels: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str, label_col: str
) -> DataFrame:
    """lang, bin, low, high, toxic, n: all labelled calibration rows, counted; no text is shuffled."""
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1)).distinct()
    key = F.col(id_col).cast(labels.schema[id_col].dataType)
    rows = docs.select(key.alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("_id").isNotNull() & ~held_out(F.col("_id")) & kept_for_calibration(F.xxhash64("_id")))
    s = F.col("score")
    known = scored(rows, model).select("_id", "lang", "score", F.floor(F.log(s / (1 - s)) * BINS).alias("bin"))
    bounds = (F.min("low").alias("low"), F.max("high").alias("high"))
    # counted by id before the join, so that a repeated id is one row for each bin
    known = known.groupBy("_id", "lang", "bin").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("m"))
    return known.join(lab, "_id").groupBy("lang", "bin").agg(*bounds, F.sum(F.col("m") * F.col("y")).alias("toxic"), F.sum("m").alias("n"))


def thresholds(counts: DataFrame, least: int = 20) -> dict[str | None, float]:
    """Per language with enough rows of both labels the threshold of best F1 over ``counts``."""
    counts = staged(counts)
    total = counts.groupBy(F.col("lang").alias("l")).agg(F.sum("toxic").alias("t"), F.sum("n").alias("a"))
    enough = total.filter((F.col("t") >= least) & (F.col("a") - F.col("t") >= least))
    per: dict[str | None, list] = {}
    for r in counts.join(enough, F.col("lang").eqNullSafe(F.col("l")), "left_semi").collect():  # at most 60 * BINS + 1 rows a language
        per.setdefault(r["lang"], []).append((r["low"], r["high"], r["toxic"], r["n"]))
    return {lang: best_cut(*np.array(sorted(rows), dtype=float).T) for lang, rows in per.items()}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
    train_chars: int = TRAIN_CHARS,
) -> Model:
    """The model from the bounded sample and its thresholds from all labelled calibration rows."""
    rows, words, hashes = sample(docs, labels, id_col, text_col, lang_col, label_col, per_class, train_chars)
    y = np.array([y for y, _ in rows], dtype=float)
    check = np.array([zlib.crc32(str(h).encode()) % CALIBRATION == 0 for _, h in rows], dtype=bool)
    model, _ = train_words(words, hashes, y, check)
    model.thresholds = thresholds(score_counts(docs, labels, model, id_col, text_col, lang_col, label_col))
    return model


class _Words(dict):
    """Word to its place in the task's tables, which grow by the words of each group of texts."""

    def __init__(self, model: Model, most: int = 150_000):
        super().__init__()
        self.model, self.most = model, most
        self.own = model.tables(model.emb) if model.emb is not None else []
        self._start()

    def _start(self) -> None:
        self.clear()
        self[""] = 0
        self.new: list[list[int]] = []  # rows of the words that the tables lack
        self.done = 1
        self.tables = [[np.zeros((1, FILTERS), np.float32) for _ in per] for per in self.own]

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(self.model.part_rows(word))
        return k

    def _grow(self) -> None:
        rows, a, b = np.array(self.new, dtype=np.int64), self.done, len(self)
        for per, mine in zip(self.tables, self.own, strict=True):
            for k, own in enumerate(mine):
                if b > len(per[k]):  # room for as many again, so that they are seldom copied
                    per[k] = np.concatenate((per[k][:a], np.empty((max(2 * b, 1024) - a, FILTERS), np.float32)))
                for c in range(0, b - a, 8192):
                    per[k][a + c : min(b, a + c + 8192)] = own[rows[c : c + 8192]].sum(axis=1)
        self.new, self.done = [], b

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.most:
            self._start()
        out = []
        for t in texts:
            found = _WORD.findall(t.lower())
            out.append(np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found)))
        if self.new:
            self._grow()
        return out


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score as the last one, under a name of its own; one pass, no shuffle."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_ROWS rows of DIM numbers
    at = docs.columns.index(text_col)

    def make():
        m = shared.value
        words = _Words(m)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = []
            for k in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(at).slice(k, 256).to_pylist()]
                scores += [m.score(padded(x), words.tables) for x in words.texts(texts)]
            return pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

        return each

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(name, DoubleType())
    return map_rows(docs, schema, make)


def threshold(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a row's language."""
    out = F.lit(0.5)
    for k, v in model.thresholds.items():
        out = F.when(lang.eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold of the language, flagged (score >= threshold)."""
    model = fit(docs, labels, **settings)
    d = scored(docs.select("doc_id", "text", "lang"), model)
    cut = threshold(model, F.col("lang"))
    return d.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        cut.alias("threshold"),
        (F.col("score") >= cut).alias("flagged"),
    )
