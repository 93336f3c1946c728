"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the running sums of a source's buckets give the threshold below which
documents fit its budget; only the bucket at the boundary is refined, by the next bits of the hash, until one
document or one hash value is left in it. Documents are then taken by comparing their hash with their source's
threshold: no sort, and nothing per document is moved by key except into sums that combine before the shuffle. The
thresholds are nested: a larger budget takes the same documents and more.

A source of target r times its size has every document taken floor(r) times, and those below the threshold once more.

Defined results: null text has size 0; null sources are one source, last in order; rows that repeat a doc_id are hashed by id and
text, and by a null id like any other value, so equal rows fall on the same side; an empty table gives no rows; sources without
words have target 0. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, unused, written

#: Fixed values of the contract: the weights of sources in order, again and again; a target's limit as a multiple of its source's size.
WEIGHTS = (5, 2, 1)
MOST = 3

BUCKET_BITS = 10
LEVELS = 6


def hash60():
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))), 64 - BUCKET_BITS * LEVELS)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): h is a hash of 60 bits."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
        hash60().alias("h"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): a row for each source; what is over a source's limit is shared by the others' weights.

    Ranks come from a range-partitioned sort, so no task holds all sources. The driver sees sums over sources only.
    """
    spark = sizes.sparkSession
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = len(WEIGHTS)
    # UTF-8 binary order is code point order; a source's place is its row in its range of the sort, after the rows of the ranges before
    ranges = written(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id())).withColumn("range", F.shiftright("row", 33))
    upto, offsets = 0, []
    for r in ranges.groupBy("range").count().orderBy("range").collect():
        offsets.append((r["range"], upto))
        upto += r["count"]
    offset = F.broadcast(spark.createDataFrame(offsets, "range long, offset long"))  # a row for each shuffle partition at most
    place = F.col("offset") + F.col("row") - F.shiftleft("range", 33)
    ranked = written(ranges.join(offset, "range").select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % n + 1).cast("int")).alias("weight")))
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate = None
    full = F.lit(False)
    while True:
        left, weight = ranked.agg(
            F.lit(words) - F.coalesce(F.sum(F.when(full, MOST * F.col("source_size"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        new = left / weight if weight else 0.0
        if new == rate:
            break
        rate = new
        full = F.col("weight") * F.lit(float(rate)) >= MOST * F.col("source_size")
    target = F.when(full, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(float(rate)))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with copies (taken of every document) and below (the hash under which documents are taken once more)."""
    budget = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    # prefix: the boundary bucket so far; room: what its documents may hold; both end at the first level that fills the room
    state = written(
        budget.withColumn("room", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
        .withColumn("open", F.col("room") > 0)
    )
    for level in range(1, LEVELS + 1):
        shift = BUCKET_BITS * (LEVELS - level)
        inside = sizes.withColumn("bucket", F.shiftright("h", shift)).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")) if level == 1 else (
            sizes.join(state.where("open").select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.expr(f"source <=> s and shiftright(h, {shift + BUCKET_BITS}) = p"))
            .withColumn("bucket", F.shiftright("h", shift)).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        )
        upto = inside.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
        # the boundary: the first bucket with which the room is exceeded
        met = upto.select(F.col("source").alias("s"), "bucket", "words", "n", "upto").join(state.where("open").select("source", "room"), F.expr("s <=> source"))
        edge = met.where("upto > room").groupBy("s").agg(F.min(F.struct("bucket", "words", "n", "upto")).alias("e"))
        joined = state.join(edge, F.expr("open and source <=> s"), "left")
        last = level == LEVELS
        one = F.col("e.n") == 1
        before = F.col("e.upto") - F.col("e.words")
        nearer = F.col("e.upto") - F.col("room") < F.col("room") - before  # a single document goes where the target is nearer
        hit = F.col("open") & F.col("e").isNotNull()
        state = written(joined.select(
            "source", "source_size", "target", "copies",
            F.when(hit, F.col("room") - before).otherwise(F.col("room")).alias("room"),
            F.when(hit, F.col("e.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(hit, F.shiftleft(F.col("e.bucket") + F.when((one | F.lit(last)) & nearer, 1).otherwise(0).cast("long"), shift))
            .when(F.col("open"), F.shiftleft(F.col("prefix") + 1, shift + BUCKET_BITS) if level > 1 else F.lit(1 << (BUCKET_BITS * LEVELS)))
            .otherwise(F.col("below")).alias("below"),
            (hit & ~one & F.lit(not last)).alias("open"),
        ))
        if not state.where("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "copies", "below")


def mixed(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies and taken."""
    sizes = written(sized(docs))
    cut = thresholds(sizes, source_targets(sizes)).withColumnRenamed("source", "s")
    copies = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return (
        sizes.join(cut, F.expr("source <=> s")).withColumn("copies", F.least(F.lit(MOST), copies).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def taken(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns are those of docs, of any type and name."""
    names = docs.columns
    sizes = written(sized(docs))
    of, copies, below, h, n = unused(names, "of", "copies", "below", "h", "n")
    cut = thresholds(sizes, source_targets(sizes)).select(F.col("source").alias(of), F.col("copies").alias(copies), F.col("below").alias(below))
    hashed = docs.withColumn(h, hash60())
    times = F.least(F.lit(MOST), F.col(copies) + F.when(F.col(h) < F.col(below), 1).otherwise(0)).cast("int")
    return (
        hashed.join(cut, F.col("source").cast("string").eqNullSafe(F.col(of))).where(times > 0)
        .withColumn(n, F.explode(F.sequence(F.lit(1), times))).select(*names)
    )
