"""Mixing sources to target weights on a time-varying curriculum.

Each source's share of the tokens is its target; how the share is spread over training time is its schedule, a linear
weight 1 + a (2t - 1) on t in [0, 1]. The integral t + a (t^2 - t) is the part of the source's target that is due by
time t. A document copy at offset c of its source's stream trains at the time at which c tokens are due: the inverse
of the integral. Documents are range-sorted by that time, by the time of their first copy or copy by copy; ties stand in
the order of their places (a hash of key and text), so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampline.llm.common import RUN, stage

WEIGHTS = (5, 2, 1)
#: Slopes of the schedules, for the weights in turn: heavy sources come early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
SHARE = 1.5
MOST = 2.0
#: Rows of a bucket in which offsets are summed up by one task.
BUCKET = 2048


def with_size(df: DataFrame, text_col: str = "text", out: str = "size") -> DataFrame:
    """Add a text's number of runs without ASCII white space (null: 0)."""
    return df.withColumn(out, F.coalesce(F.regexp_count(F.col(text_col), F.lit(RUN)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. A target is its weight's part of share times all
    tokens, stops at most times its source's size, and what is cut off goes to the others by weight until none is above.
    Filling by order of size over weight does that in one sweep: a source is full if its cap is reached before the
    level that the rest would get.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))  # a row a source
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    named = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), turn.cast("int") + 1).alias("weight"), turn.cast("int").alias("turn"))
    cap = F.col("source_size") * F.lit(float(most))
    every = W.partitionBy()
    fill = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = named.withColumn("cap", cap).withColumn("__level", left / rest).withColumn("full", F.col("cap") <= F.col("__level") * F.col("weight"))
    # caps are filled in order, so the first source that is not full tells the level of all that follow
    first = F.first(F.when(~F.col("full"), F.col("__level")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return level.withColumn("__open", first).select("source", "source_size", "weight", "turn", F.when(F.col("full") | F.col("__open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("__open") * F.col("weight"))).alias("target"))


def place_in_source(key: Column, text: Column) -> Column:
    """A number of 60 bits that orders a source's documents: the head of the MD5 of key and text."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def due_time(part: Column, slope: Column) -> Column:
    """The t at which t + a (t^2 - t) reaches part."""
    b = 1 - slope
    root = F.sqrt(F.greatest(b * b + 4 * slope * part, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.abs(slope) < 1e-12, part).otherwise((root - b) / (2 * slope))))


def schedule(df: DataFrame, keep: list[str], text_col: str = "text", source_col: str = "source", key_col: str = "doc_id", weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """keep, size, source_size, target, taken, positions (training times in [0, 1] of a document's copies) and __place (for
    ties of the range sort), in no order.

    Each document is taken whole 0, 1 or 2 times (at most `most`): all of a source's documents floor(target / size)
    times, and once more those at the front of the source's order, by a hash of key and text, while words remain, so
    that a source's taken words miss its target by at most half a document. Offsets are sums over buckets of the
    hash first and within buckets then, so no task orders a source. Empty texts have size 0, are taken 0 words and stand
    where their offset falls. Repeated rows share a place in the order and are taken alike, as often as they occur.
    An empty table gives an empty result. Columns of keep that are named like a result are left out.
    """
    keep = [c for c in keep if c not in ("size", "source_size", "target", "taken", "positions", "__place")]
    order = place_in_source(F.col(key_col), F.col(text_col))
    sized = with_size(df.select(*[F.col(c).alias(f"__k_{c}") for c in keep], F.col(source_col).alias("source"), order.alias("__o"), F.col(text_col).alias("__t")), "__t")
    docs = stage(sized.drop("__t"))
    stats = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = stage(targets(stats.select("source", "source_size"), weights, share, most))
    rows = docs.count()
    bits = max(0, (max(rows, 1) // bucket).bit_length())
    tagged = docs.withColumn("__b", F.shiftrightunsigned("__o", 60 - bits) if bits else F.lit(0).cast("long"))
    sums = tagged.groupBy("source", "__b").agg(F.sum("size").alias("s"))
    ahead = W.partitionBy("source").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("s").over(ahead), F.lit(0))).drop("s")
    offsets = stage(starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"].alias("__src"), F.col("__b").alias("__bucket"), "__start", "source_size", "turn", "target"))
    inner = W.partitionBy("source", "__b").orderBy(F.col("__o")).rangeBetween(W.unboundedPreceding, -1)
    placed = tagged.withColumn("__in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = placed.join(offsets, placed["source"].eqNullSafe(offsets["__src"]) & (placed["__b"] == offsets["__bucket"]))
    begin = F.col("__start") + F.col("__in")
    full = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) + 1e-12)
    extra = F.col("target") - full * F.col("source_size")
    copies = F.least(full + F.when((begin + F.col("size") / 2 <= extra) & (F.col("size") > 0), 1).otherwise(0), F.lit(int(most)))
    slope = F.element_at(F.array(*map(F.lit, map(float, slopes))), F.col("turn") % len(slopes) + 1)
    at = lambda i: due_time(F.least(F.lit(1.0), F.coalesce(F.try_divide(begin + i * F.col("source_size"), F.col("target")), F.lit(0.0))), slope)
    done = joined.withColumn("__c", copies.cast("int")).withColumn("positions", F.when(F.col("__c") > 0, F.transform(F.sequence(F.lit(0), F.col("__c") - 1), at)).otherwise(F.array().cast("array<double>")))
    return done.select(*[F.col(f"__k_{c}").alias(c) for c in keep], "size", "source_size", "target", (F.col("__c") * F.col("size")).cast("long").alias("taken"), "positions", F.col("__o").alias("__place"))


def range_sorted(df: DataFrame, *by: Column, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted, first by `by`, then by place, if they have one."""
    keys = [*by, *([F.col("__place")] if "__place" in df.columns else [])]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).drop("__place")


def curriculum(df: DataFrame, keep: list[str], *options, partitions: int | None = None, **named) -> DataFrame:
    """The documents of schedule(), with its options, range-partitioned and sorted by the time of their first copy; those
    that the mix doesn't take stand last."""
    return range_sorted(schedule(df, keep, *options, **named), F.get("positions", F.lit(0)).asc_nulls_last(), partitions=partitions)


def training_order(scheduled: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each copy of a scheduled document, with its position, range-partitioned and sorted by it."""
    copies = scheduled.where(F.size("positions") > 0).select(*[c for c in scheduled.columns if c != "positions"], F.explode("positions").alias("position"))
    return range_sorted(copies, F.col("position"), partitions=partitions)
