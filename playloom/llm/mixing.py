"""Mixing sources to target weights by Pareto order sampling.

Each source may fill a share of all words by its weight; a target stops at
``max_copies`` times the words the source has, and the excess is shared again
by weight until none is above. Every document of a source is allotted the whole
part of target / source size for certain. The rest of the target, in words, is a
sample with unequal inclusion probabilities p: they grow with the root of a
document's size, so that long documents are rather kept than pieced together
from short ones, up to 1, and are scaled so that the expected words meet the
rest. Documents with p = 1 are allotted one more copy for certain; the others are
ranked by random odds over inclusion odds, (U / (1 - U)) / (p / (1 - p)), with U
from a hash of doc_id and the seed, and taken in that order while they fit into
the words still missing; one more of the next documents closes the gap, the one
whose size comes nearest. The sample is fixed in words, so it meets the target to
within a part of a document.

Scale: the order is never sorted as a whole. Ranks fall into buckets; sums per
(source, bucket) tell the bucket in which a source's sample ends, and only that
bucket's rows are ordered. A source has a bucket for each 64 documents, up to
``BUCKETS``, so even one with a third of all rows costs no more in one task than
a list of its bucket sums and the rows of one bucket. The scale of p comes from
counts of (source, size).

Defined results: null text has size 0; sources are ordered by code point with
null last (null is a source of its own); documents of size 0 take 0 words;
rows of one doc_id share U and are taken one by one, the shorter first, so of
equal rows some may get one copy more than others, as many in each run; rows with
null doc_id share one U; reruns agree; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.llm.columns import WORD, fresh, whole_text
from playloom.shared import materialize

WEIGHTS = (1, 2, 3)
#: Rank buckets of a source, at most; a small source has fewer, of about BUCKET_ROWS documents.
BUCKETS = 1 << 20
BUCKET_ROWS = 64


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """From rows (source, size): one row per source with source_size and target."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # One row per source: numbering them in order is the only unpartitioned window.
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    sums = materialize(sums.withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * float(max_copies)
    share, full = 0.0, -1
    while True:
        above = limit < F.col("weight") * share
        one = sums.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(above).alias("full"),
        ).first()
        if one["full"] == full or not one["open"]:
            break
        full, share = one["full"], ((one["all"] or 0) - one["fixed"]) / one["open"]
    return sums.select("source", "source_size", "n_rows", F.least(limit, F.col("weight") * share).alias("target"))


def _order(p: Column, seed: int) -> Column:
    """Pareto rank mapped from [0, inf) to [0, 1): x / (1 + x) of the odds ratio."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (unit / (1 - unit)) / (p / (1 - p))
    return odds / (1 + odds)


def inclusion_scales(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds to ``goals``: ``whole``, the copies that every document gets; ``rest``, the words still missing then; ``scale``, by
    which the root of a size gives its p; ``sure_words``, the words of the documents with p = 1."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("whole", F.floor(ratio).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.floor(ratio) * F.col("source_size")))
    counts = sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    rest = goals.select(F.col("source").alias("goal_source"), "rest")
    counts = counts.join(rest, counts["source"].eqNullSafe(rest["goal_source"])).drop("goal_source")
    # One row for each size that occurs in a source. The largest sizes get p = 1 first; from some size on none does.
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(0, Window.unboundedFollowing)
    words, rooted = F.col("n") * F.col("size"), F.col("n") * F.col("size") * F.sqrt("size")
    counts = counts.withColumn("sure", F.coalesce(F.sum(words).over(larger), F.lit(0)).cast("long"))
    counts = counts.withColumn("scale", (F.col("rest") - F.col("sure")) / F.sum(rooted).over(others))
    fits = counts.filter(F.col("scale") * F.sqrt("size") < 1).groupBy(F.col("source").alias("scale_source"))
    fits = fits.agg(F.max_by("scale", "size").alias("scale"), F.max_by("sure", "size").alias("sure_words"))
    out = goals.join(fits, goals["source"].eqNullSafe(fits["scale_source"]), "left").drop("scale_source")
    return out.withColumn("scale", F.coalesce("scale", F.lit(0.0))).withColumn("sure_words", F.coalesce("sure_words", F.lit(0)))


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Adds the plan of its source, p, the copies for certain, and for 0 < p < 1 the rank with its bucket."""
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"]), "left").drop("plan_source")
    p = F.when(F.col("size") > 0, F.col("scale") * F.sqrt("size")).otherwise(0.0)
    joined = joined.withColumn("p", p).withColumn("sure", F.coalesce("whole", F.lit(0)) + F.when(F.col("p") >= 1, 1).otherwise(0))
    buckets = F.greatest(F.lit(1), F.least(F.lit(BUCKETS), F.floor(F.col("n_rows") / BUCKET_ROWS)))
    joined = joined.withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), _order(F.col("p"), seed)))
    return joined.withColumn("bucket", F.floor(F.col("rank") * buckets).cast("int"))


def sample_ends(sizes: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """Adds to ``goals`` the bucket in which the sample of a source ends and the words still missing there."""
    sums = _ranked(sizes, goals, seed).filter("bucket is not null").groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), (F.first("rest") - F.first("sure_words")).alias("sampled")
    )
    # At most BUCKETS rows a source.
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = (
        sums.withColumn("missing", F.col("sampled") - (running - F.col("words")))
        .filter((F.col("missing") >= 0) & (F.col("missing") < F.col("words")))
        .groupBy(F.col("source").alias("end_source"))
        .agg(F.max_by("bucket", "bucket").alias("end_bucket"), F.max_by("missing", "bucket").alias("missing"))
    )
    return goals.join(ends, goals["source"].eqNullSafe(ends["end_source"]), "left").drop("end_source")


def allot(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """``docs`` (with doc_id, source, size) and its source_size, target and copies (0 to max_copies)."""
    sizes = docs.select("doc_id", "source", "size")
    goals = materialize(inclusion_scales(sizes, targets(sizes, weights, max_copies)), "mix-goals")
    plan = materialize(sample_ends(sizes, goals, seed), "mix-plan")
    ranked = _ranked(docs, plan, seed)
    edge = F.coalesce(F.col("bucket") == F.col("end_bucket"), F.lit(False))
    inside = F.col("bucket").isNotNull() & (F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")))
    plain = ranked.filter(~edge).withColumn("extra", inside.cast("int"))
    before = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = ranked.filter(edge).withColumn("upto", F.sum("size").over(before)).withColumn("fits", F.col("upto") <= F.col("missing"))
    filled = F.max(F.when(F.col("fits"), F.col("upto")).otherwise(0)).over(Window.partitionBy("source"))
    last = last.withColumn("gap", F.col("missing") - filled)
    nearest = F.row_number().over(Window.partitionBy("source").orderBy("fits", F.abs(F.col("size") - F.col("gap")), "rank", "doc_id"))
    closes = ~F.col("fits") & (nearest == 1) & (F.col("size") < 2 * F.col("gap"))
    last = last.withColumn("extra", (F.col("fits") | closes).cast("int")).drop("upto", "fits", "gap")
    out = plain.unionByName(last).withColumn("copies", F.col("sure") + F.coalesce("extra", F.lit(0)))
    return out.drop("n_rows", "whole", "rest", "scale", "sure_words", "sure", "p", "rank", "bucket", "end_bucket", "missing", "extra")


def annotate(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = materialize(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    out = allot(sizes, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    names = fresh(docs.select("doc_id"), *[f"mixed_{k}" for k in range(len(docs.columns))])
    packed = docs.select("doc_id", "source", n_words().alias("size"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]).alias("document"))
    copies = allot(packed, seed).filter("copies > 0")
    repeated = copies.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*[F.col(f"document.{n}").alias(c) for c, n in zip(docs.columns, names)])
