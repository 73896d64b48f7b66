"""Mixing sources to target weights, by systematic sampling.

Targets share a number of words among sources by weight, by water-filling: a source's target stops
at `most` times its size, and what is above goes to the others by weight. A source's documents then
expect target / size copies each. Their expected copies are prefix-summed within the source, one
random offset is added, and a document is taken once for each integer boundary that its interval
crosses, so that the copies taken differ from the expected ones by less than one a document.

The prefix sum runs in two levels, so that a source of any share of the rows is many tasks' work:
documents are dealt by (source, size class, bucket), with so many buckets that a group has about `rows` documents at most;
sums of these groups give each its start. Size classes run in order, so the sample is also spread evenly over sizes and the words taken stay near
the target. Expected copies are fixed-point integers: results do not depend on the order of
additions, and reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own, last in order. Sources of
size 0 have target 0. Rows that are alike in every respect may swap their copies. An empty table
gives an empty result. Names of further columns cannot clash: only id, text and source are read, and
in mixed() a row goes through as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Expected copies are multiples of 2**-24.
ONE = 1 << 24
BUCKETS, ROWS = 16, 1 << 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds target to (source, source_size): the least of most * size and level * weight that sum to share * all sizes.

    One row a source; the sources' order and water level take one pass over these rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "w",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")),
    )
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Sources reach their caps in order of cap / weight. With those before k at their caps, the level is what
    # is left over the weight that is left; k is capped where that exceeds its own ratio.
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = weighed.withColumn("level", level)
    capped = F.col("level") * F.col("w") >= F.col("cap")
    leveled = leveled.withColumn(
        "level",
        F.min(F.when(~capped, F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("v")))).over(everything)["v"],
    )
    return leveled.select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"),
    )


def _plan(
    docs: DataFrame, weights, share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str,
    size: Column | None, rows: int,
):
    """Of docs, the columns that the sampling reads, and the groups: (s, p, source_size, target, each, start)."""
    text, source, doc_id = F.col(text_col).cast("string"), F.col(source_col).cast("string"), F.col(id_col).cast("long")
    columns = [
        doc_id.alias("doc_id"),
        source.alias("source"),
        (size_of(text) if size is None else size).alias("size"),
        F.xxhash64(F.lit(seed), text, doc_id).alias("h"),
    ]
    narrow = common.written(docs.select(*columns))
    buckets = max(BUCKETS, -(-narrow.count() // rows))

    def part():
        # a class is an eighth of an octave; (class, bucket) is one integer, and groups follow in its order
        octave = F.when(F.col("size") > 0, F.floor(F.log2("size") * 8)).otherwise(F.lit(-1)).cast("long")
        return octave * buckets + F.pmod("h", F.lit(buckets))

    groups = narrow.groupBy("source", part().alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    sources = sources.withColumn(
        "each",
        F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long"),
    )
    sources = sources.withColumnRenamed("source", "of")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0"))), F.lit(ONE))
    starts = groups.join(sources, F.col("source").eqNullSafe(F.col("of"))).select("source", "part", "n", "source_size", "target", "each")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") * F.col("each")).over(before), F.lit(0)) + offset
    starts = common.written(
        starts.select(F.col("source").alias("s"), F.col("part").alias("p"), "source_size", "target", "each", start.alias("start"))
    )
    return narrow, columns, part, starts


def _crossings(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds copies to rows of doc_id, source, h and part: the integer boundaries that each row's interval crosses."""
    found = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    upto = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("start") + F.sum("each").over(upto)
    crossed = F.shiftright(end, 24) - F.shiftright(end - F.col("each"), 24)
    return found.withColumn("copies", crossed.cast("int"))


def expected_mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, rows: int = ROWS, keep_key: bool = False,
) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, copies, taken (= copies * size); with keep_key also h and part, the order of rows."""
    narrow, _, part, starts = _plan(docs, weights, share, most, seed, id_col, text_col, source_col, size, rows)
    out = _crossings(narrow.withColumn("part", part()), starts)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", taken, *(["h", "part"] if keep_key else []))


def mixed(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, rows: int = ROWS,
) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    Whole rows are dealt to the groups, once; there is no join of copies back to rows, so rows that are alike need no numbers.
    """
    _, columns, part, starts = _plan(docs, weights, share, most, seed, id_col, text_col, source_col, size, rows)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *columns).withColumn("part", part())
    taken = _crossings(whole, starts).filter("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
