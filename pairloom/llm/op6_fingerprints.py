"""Document fingerprints as homomorphic multiset hashes, DataFrame operations only.

A text is the multiset of its paragraphs (cut after line breaks and sentences, trailing white
space left out). Each paragraph hashes to a sparse wide vector: one cell of 16 strata x 32 lanes, and
in it two 32-bit numbers. Stratum s takes a paragraph with probability 2^-(s+1). A fingerprint is the
sum of its paragraphs' vectors modulo 2^32, so

* it does not depend on the order of the paragraphs,
* adding or removing paragraphs adds or subtracts their vectors (``combined``), and
* two fingerprints differ in about as many cells as paragraphs differ, which gives their likeness:
  linear counting over the strata that are not crowded estimates how many paragraphs both have
  together and how many only one has; likeness is one minus their ratio (an estimated Jaccard
  index), exactly 1 for equal fingerprints and 0 when every occupied cell differs.

The comparison with the edited text and the next document (descending id) needs neighbours. Ids are
cut into buckets at approximate quantiles, each bucket also gets the first document of the bucket
after it, and one shuffle of the texts by bucket serves the neighbours and all later steps.

Defined results: NULL text is the empty text; NULL ids come after all others; documents with equal ids
are ordered by text; a single document is its own successor; an empty table gives an empty table; other
columns are ignored. Two empty fingerprints have likeness 1. Texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import id_and_text, width

STRATA, LANES = 16, 32
CROWDED = 22  # occupied lanes beyond which a stratum no longer tells its number of paragraphs
CUT = r"(?<=\n)|(?<=[.?] )"
_LOW = 0xFFFFFFFF


def paragraph_hashes(text: Column) -> Column:
    parts = F.transform(F.split(text, CUT), lambda p: F.rtrim(p, F.lit(" \t\n\x0b\f\r")))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p))


def cell(h: Column) -> Column:
    """Stratum (zeros at the low end of the hash) and lane of a paragraph."""
    zeros = F.bit_count(h.bitwiseXOR(h - 1)) - 1
    lane = F.shiftrightunsigned(h, 50).bitwiseAND(F.lit(LANES - 1))
    return (F.least(zeros, F.lit(STRATA - 1)) * LANES + lane).cast("int")


def numbers(h: Column) -> tuple[Column, Column]:
    mixed = F.xxhash64(h, F.lit("cell"))
    return mixed.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(mixed, 32)


def _modulo(s: Column) -> Column:
    return s.bitwiseAND(F.lit(_LOW))


def fingerprint_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long form: doc_id, cell, a, b. Documents without paragraphs have no rows; equal ids add up."""
    d = id_and_text(docs, id_col, text_col)
    h = d.select("doc_id", F.explode(paragraph_hashes(F.col("text"))).alias("h")).filter("h is not null")
    a, b = numbers(F.col("h"))
    e = h.select("doc_id", cell(F.col("h").bitwiseAND(F.lit((1 << 63) - 1))).alias("cell"), a.alias("a"), b.alias("b"))
    return e.groupBy("doc_id", "cell").agg(_modulo(F.sum("a")).alias("a"), _modulo(F.sum("b")).alias("b"))


def combined(left: DataFrame, right: DataFrame, sign: int = 1) -> DataFrame:
    """Cells of both together (sign 1), or of ``left`` with ``right`` taken out (sign -1); empty cells vanish."""
    both = left.unionByName(right.select("doc_id", "cell", *[(F.lit(sign) * F.col(c)).alias(c) for c in "ab"]))
    out = both.groupBy("doc_id", "cell").agg(_modulo(F.sum("a")).alias("a"), _modulo(F.sum("b")).alias("b"))
    return out.filter("a <> 0 or b <> 0")


def written(cells: Column, n_chars: Column) -> Column:
    """The fingerprint as text: number of code points, then cell and numbers in hex."""
    one = F.transform(
        cells,
        lambda c: F.concat(F.lpad(F.hex(c["cell"]), 3, "0"), F.lpad(F.hex(c["a"]), 8, "0"), F.lpad(F.hex(c["b"]), 8, "0")),
    )
    return F.concat(n_chars.cast("string"), F.lit(":"), F.array_join(one, ""))


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of common paragraphs from two sorted arrays of cells."""
    # arrays of long numbers: a cell with one of its two numbers at a time
    place = lambda c: c["cell"].cast("long")
    with_a = lambda c: F.shiftleft(place(c), 32) + c["a"]
    with_b = lambda c: F.shiftleft(place(c), 32) + c["b"]
    union = F.array_union(F.transform(left, place), F.transform(right, place))
    one_way = lambda x, y, f: F.array_except(F.transform(x, f), F.transform(y, f))
    either = F.concat(*[one_way(x, y, f) for f in (with_a, with_b) for x, y in ((left, right), (right, left))])
    differ = F.array_distinct(F.transform(either, lambda v: F.shiftright(v, 32)))

    def by_stratum(cells: Column) -> Column:
        """Counts of eight strata in the bytes of each of two numbers; a stratum has at most 32 lanes."""
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftright(c, 5) % 8 * 8).cast("int"))
        return F.aggregate(
            cells,
            F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")),
            lambda acc, c: F.struct(
                (acc["low"] + F.when(c < 8 * LANES, bit(c)).otherwise(F.lit(0))).alias("low"),
                (acc["high"] + F.when(c >= 8 * LANES, bit(c)).otherwise(F.lit(0))).alias("high"),
            ),
        )

    def at(counts: Column, s: int) -> Column:
        return F.shiftright(counts["low" if s < 8 else "high"], s % 8 * 8).bitwiseAND(F.lit(255))

    strata = F.transform(
        F.array(F.struct(by_stratum(union).alias("u"), by_stratum(differ).alias("d"))),
        lambda both: F.array(
            *[F.struct(at(both["u"], s).alias("u"), at(both["d"], s).alias("d"), F.lit(s).alias("s")) for s in reversed(range(STRATA))]
        ),
    )[0]
    count = lambda n: -LANES * F.log(1.0 - F.least(n, F.lit(LANES - 0.5)) / float(LANES))
    start = F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("d"), F.lit(True).alias("open"))

    def add(acc: Column, x: Column) -> Column:
        # from the sparsest stratum down, until one is crowded; the sparsest always counts
        ok = acc["open"] & ((x["u"] <= CROWDED) | (x["s"] == STRATA - 1))
        return F.struct(
            (acc["u"] + F.when(ok, count(x["u"])).otherwise(0.0)).alias("u"),
            (acc["d"] + F.when(ok, count(x["d"])).otherwise(0.0)).alias("d"),
            ok.alias("open"),
        )

    ratio = F.aggregate(strata, start, add, lambda acc: F.when(acc["u"] > 0, 1.0 - acc["d"] / acc["u"]).otherwise(0.0))
    return F.when(F.size(differ) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), ratio))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by a search in two steps; NULL goes to bucket -1."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    first = below(F.lit([b[0] for b in blocks]))
    wide = [b + [2**63 - 1] * (step - len(b)) for b in blocks]
    fine = below(F.element_at(F.lit(wide), F.greatest(first, F.lit(1))))
    return F.when(key.isNull(), -1).otherwise(F.when(first == 0, 0).otherwise((first - 1) * step + fine)).cast("int")


def bounds_of(docs: DataFrame, buckets: int) -> list[int]:
    """Approximate quantiles of the id, one number per bucket."""
    shares = [k / buckets for k in range(1, buckets)]
    got = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets).alias("b")).first()["b"]
    return sorted(set(got or []))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = id_and_text(docs, id_col, text_col)
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = buckets or max(1024, 8 * width(docs.sparkSession))
    bounds = bounds_of(keys, n)
    bucket = bucket_of(F.col("doc_id"), bounds)
    heads = keys.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head"))
    down = Window.orderBy(F.desc("bucket"))  # at most one row per bucket
    before = F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.partitionBy()))
    heads = heads.select("bucket", "head", before.alias("before"))
    d = d.withColumn("bucket", bucket).join(F.broadcast(heads), "bucket")
    own, copy = F.struct(F.col("bucket"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra"))
    first = F.col("doc_id").eqNullSafe(F.col("head"))
    d = d.select("doc_id", "text", F.inline(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "text")
    d = d.withColumn("pos", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    size = F.length("text")
    tail = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - tail), F.substring(F.coalesce("next", F.lit("")), F.lit(1), tail))
    d = d.withColumn("edited", F.when(F.col("extra") == 0, edited))
    tagged = lambda t, which: F.transform(
        paragraph_hashes(t), lambda h: F.struct(F.lit(which).alias("which"), h.alias("h"))
    )
    d = d.select(
        "bucket",
        "pos",
        "extra",
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.length("edited").cast("long").alias("n_edited"),
        F.unhex(F.sha2(F.encode("edited", "utf-8"), 256)).alias("sha"),
        F.concat(tagged(F.col("text"), 0), F.coalesce(tagged(F.col("edited"), 1), F.array())).alias("all"),
    )
    row = ["bucket", "pos", "extra", "doc_id", "n_chars", "n_edited", "sha"]
    d = d.select(*row, F.explode_outer("all").alias("x")).select(*row, "x.which", "x.h")
    a, b = numbers(F.col("h"))
    d = d.select(*row, "which", cell(F.col("h").bitwiseAND(F.lit((1 << 63) - 1))).alias("cell"), a.alias("a"), b.alias("b"))
    # the grouping keys contain the bucket, so neither step shuffles
    d = d.groupBy(*row, "which", "cell").agg(_modulo(F.sum("a")).alias("a"), _modulo(F.sum("b")).alias("b"))
    d = d.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("which", "cell", "a", "b"))).alias("cells"))
    of = lambda which: F.transform(
        F.filter("cells", lambda c: c["which"] == which), lambda c: F.struct(c["cell"].alias("cell"), c["a"].alias("a"), c["b"].alias("b"))
    )
    d = d.withColumn("own", of(0)).withColumn("new", of(1)).drop("cells")
    after = F.lead("own").over(Window.partitionBy("bucket").orderBy("pos"))
    d = d.withColumn("after", after).filter(F.col("extra") == 0)
    return d.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        written(F.col("own"), F.col("n_chars")).alias("fingerprint"),
        written(F.col("new"), F.col("n_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("after", F.col("own"))).alias("near_next"),
    )
