"""Joins along a time line: the latest earlier record, and the intervals around a moment. Extensions of the audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _micros(df: DataFrame, width: str) -> int:
    """Microseconds of an interval such as 6 hours."""
    return df.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {width}) AS w").first().w


def _struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def latest_before(left: DataFrame, right: DataFrame, on: Sequence[str], *, left_time: str, right_time: str, tie: Sequence[str] = (), strict: bool = True, within: Column | None = None, slice_width: str | None = None, prefix: str = "prior_") -> DataFrame:
    """left with the columns of right, under prefix, of the latest row of right with the same `on` keys before each row's time.

    strict: before it, else also at it. Of several rows of that time, the one that is last by the columns `tie` (nulls first). A row of
    left whose keys or time are null, or that has no earlier row, keeps nulls; rows of right with a null key or time are never found. within:
    an interval (INTERVAL '1' HOUR, say); an earlier row than that doesn't count. Repeated rows of left stay as many. Keys of the two sides
    meet by name.

    Both sides are united and sorted once by key and time, and a window carries the latest right row along: rows don't
    multiply, whatever the numbers of both sides are. slice_width ("1 day", say) cuts each key's history into slices that are sorted apart, for keys
    with a large share of all rows: the last right row of each slice, a row a key and slice, is carried to the slices after it.
    """
    kinds = {c: (left.schema[c].dataType, right.schema[c].dataType) for c in on}
    if bad := [c for c, (a, b) in kinds.items() if a != b]:
        raise TypeError(f"keys of different types: {', '.join(bad)}")
    keys = [f"_k{i}" for i in range(len(on))]
    own = lambda df, time: [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)] + [F.col(f"`{time}`").alias("_t")]
    none = lambda df: F.lit(None).cast(df.select(_struct(df).alias("s")).schema["s"].dataType)
    ties = F.struct(*[F.col(f"`{c}`") for c in tie]) if tie else F.struct(F.lit(0).alias("z"))
    no_ties = F.lit(None).cast(right.select(ties.alias("s")).schema["s"].dataType)
    # Among rows of one time, left rows see right ones only if they come after them.
    asks = left.select(*own(left, left_time), F.lit(0 if strict else 2).alias("_side"), no_ties.alias("_tie"), _struct(left).alias("_left"), none(right).alias("_right"))
    known = [f"`{c}` IS NOT NULL" for c in (*on, right_time)]
    has = right.where(" AND ".join(known)).select(*own(right, right_time), F.lit(1).alias("_side"), ties.alias("_tie"), none(left).alias("_left"), _struct(right).alias("_right"))
    whole = asks.unionByName(has)
    if slice_width is not None:
        whole = whole.withColumn("_slice", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / F.lit(_micros(left, slice_width))))
    parts = keys if slice_width is None else [*keys, "_slice"]
    along = Window.partitionBy(*parts).orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = whole.withColumn("_found", F.last("_right", ignorenulls=True).over(along)).where("_side <> 1")
    found = F.col("_found")
    if slice_width is not None:
        last = whole.groupBy(*parts).agg(F.max_by("_right", F.when(F.col("_side") == 1, F.struct("_t", "_tie"))).alias("_last"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select(*[F.col(c).alias(f"{c}_") for c in parts], F.last("_last", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
        met = met.join(carried, [F.col(c) == F.col(f"{c}_") for c in parts], "left")
        found = F.coalesce("_found", "_carried")
    if within is not None:
        found = F.when(found[right_time] + within >= F.col("_t"), found)
    return met.select("_left.*", *[found[c].alias(f"{prefix}{c}") for c in right.columns])


def interval_join(points: DataFrame, spans: DataFrame, *, time: str, start: str, end: str, on: Sequence[str] = (), width: str = "1 day", max_slots: int = 1024, salts: int = 1) -> DataFrame:
    """Pairs of points and spans with the same `on` keys and start <= time < end: all columns of points, then those of spans but `on`.

    Time is cut into slots of `width`: a span is copied to each slot it touches and meets the points of that slot in an equi-join, which
    an exact comparison completes. A span of more than max_slots slots meets, at slots that are 2, 4, 8... times as wide, the
    points of those, so that a span has at most max_slots + 1 copies whatever its length, and a point one copy for each of the few
    widths in use. Each pair is found at one width and slot alone. Spans that are empty, reversed or have a null end meet nothing, nor do points without a time, nor null keys.

    salts: points of a slot are spread over so many parts by a hash of the row and the spans are copied to each, for time lines on which
    one slot holds a large share of the points.
    """
    clash = (set(points.columns) & set(spans.columns)) - set(on)
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    unit = _micros(points, width)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keyed = lambda df: [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(on)]
    live = spans.where(F.col(f"`{start}`") < F.col(f"`{end}`")).select(*keyed(spans), _struct(spans).alias("_span"), micros(f"`{start}`").alias("_a"), (micros(f"`{end}`") - 1).alias("_z"))
    # The least power of two at which the span touches no more than max_slots + 1 slots.
    slots = (F.col("_z") - F.col("_a")) / F.lit(float(unit) * max_slots)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(slots, F.lit(1.0))))).cast("int")
    live = live.withColumn("_level", level).withColumn("_w", F.expr(f"shiftleft({unit}L, _level)"))
    floor = lambda c: F.expr(f"({c} - pmod({c}, _w)) div _w")
    live = live.withColumn("_slot", F.explode(F.sequence(floor("_a"), floor("_z"))))
    live = live.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    levels = [r["_level"] for r in live.select("_level").distinct().orderBy("_level").collect()] or [0]  # at most 63
    asks = points.where(F.col(f"`{time}`").isNotNull()).select(*keyed(points), _struct(points).alias("_point"), micros(f"`{time}`").alias("_at"))
    asks = asks.withColumn("_salt", F.pmod(F.xxhash64("_point"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
    asks = asks.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_w", F.expr(f"shiftleft({unit}L, _level)")).withColumn("_slot", floor("_at"))
    keys = [*[f"_k{i}" for i in range(len(on))], "_level", "_slot", "_salt"]
    met = asks.drop("_w").join(live.drop("_w"), keys).where("_a <= _at AND _at <= _z")
    return met.select("_point.*", *[F.col("_span")[c].alias(c) for c in spans.columns if c not in on])
