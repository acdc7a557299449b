"""Exact percentiles without gathering a group's values: bounds from quantile sketches, exact counts, and a sort of what is left.

A sketch of a group's values gives bounds around each wanted rank. Counting the values under the bounds is exact, so the
rank within the bounds is known, and only the values within them are looked at again, until few are left. Where a sketch's
bounds miss a rank, which the counts show, that rank's group is taken whole in that round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, materialize

#: Steps of a sketch's quantiles, its accuracy, values within bounds that are sorted, and groups whose bounds are broadcast.
GRID, ACCURACY, SMALL, FEW_GROUPS = 1000, 20_000, 100_000, 50_000


def exact_percentiles(rows: DataFrame, value: str, percentiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and one column for each of percentiles (name -> share): of a group's values in order, the one at share * (n - 1),
    between two that of them in proportion, as F.percentile and SQL's quantile_cont have it.

    Nulls in value are left out, and a group of nulls alone has null percentiles; null keys are a group; NaN is above all. An
    empty table gives no rows, and without `by` one row of nulls.
    """
    keys = [f"_k{i}" for i, _ in enumerate(by or [])]
    base = rows.select(F.lit(0).alias("_g"), *[F.struct(F.col(c).alias("k")).alias(k) for k, c in zip(keys, by or [], strict=True)], F.col(value).cast("double").alias("_v"))
    every, group = base.select("_g", *keys).distinct(), ["_g", *keys]
    left = base.filter("_v is not null")
    n = left.groupBy(*group).agg(F.count("*").alias("_n"))
    at = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("_t"), F.floor(at(p)).alias("_lo"), F.ceil(at(p)).alias("_hi"), (at(p) - F.floor(at(p))).alias("_part")) for name, p in percentiles.items()]))
    wanted = materialize(n.select(*group, "_n", asked.alias("a")).select(*group, "_n", "a.*"), "percentile-ranks")
    parts, targets, written = wanted.select(*group, "_t", "_part"), wanted.drop("_n", "_part"), [wanted]
    within, of, most = left, group, wanted.agg(F.max("_n")).first()[0] or 0
    before = most + 1
    while SMALL < most < before:  # a round that leaves as many ends it; the sort is right for any number
        before = most
        within, targets, most = _narrowed(within, of, targets)
        written += [within, targets]
        of = [*group, "_t"]
    if of == group:
        within, of = within.withColumn("_t", F.explode(F.array(*[F.lit(name) for name in percentiles]))), [*group, "_t"]
    # Equal values are one row, so this sorts what differs only.
    counted = within.groupBy(*of, "_v").agg(F.count("*").alias("c")).withColumn("_upto", F.sum("c").over(Window.partitionBy(*of).orderBy("_v")))
    both = counted.join(targets, of).groupBy(*of).agg(F.min(F.when(F.col("_upto") > F.col("_lo"), F.col("_v"))).alias("a"), F.min(F.when(F.col("_upto") > F.col("_hi"), F.col("_v"))).alias("b"))
    found = both.join(parts, of).withColumn("x", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("_part")) * F.col("a") + F.col("_part") * F.col("b")))
    wide = materialize(found.groupBy(*group).agg(*[F.max(F.when(F.col("_t") == name, F.col("x"))).alias(name) for name in percentiles]), "percentiles")
    forget(*written)
    whole = every.join(wide, group, "left") if by else rows.sparkSession.range(1).select(F.lit(0).alias("_g")).join(wide, "_g", "left")
    return whole.select(*[F.col(k)["k"].alias(c) for k, c in zip(keys, by or [], strict=True)], *percentiles)


def _narrowed(rows: DataFrame, of: list[str], targets: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The values within bounds of each target's ranks, those ranks among them, and how many values the largest has that are
    not all equal. targets: of and _t (or of with _t in it), _lo, _hi."""
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketch = rows.groupBy(*of).agg(F.count("*").alias("n"), F.percentile_approx("_v", shares, ACCURACY).alias("q"))
    step = lambda c: F.col(c) / F.col("n") * GRID
    low, high = F.greatest(F.floor(step("_lo")) - 2, F.lit(0)), F.least(F.ceil(step("_hi")) + 2, F.lit(GRID))
    bounds = targets.join(sketch, of).select(*targets.columns, F.element_at("q", (low + 1).cast("int")).alias("a"), F.element_at("q", (high + 1).cast("int")).alias("b"))
    bounds = materialize(bounds, "percentile-bounds")
    packed = bounds.groupBy(*of).agg(F.collect_list(F.struct(*[c for c in bounds.columns if c not in of])).alias("ts"))
    one = [c for c in bounds.columns if c not in of]
    groups = bounds.select(*of).distinct().count()
    small = F.broadcast(packed) if groups <= FEW_GROUPS else packed
    met = rows.join(small, of).select(*of, "_v", F.explode("ts").alias("t")).select(*of, "_v", *[F.col(f"t.{c}").alias(c) for c in one])
    each = [c for c in bounds.columns if c not in ("a", "b")]
    counts = met.groupBy(*bounds.columns).agg(F.count_if(F.col("_v") < F.col("a")).alias("under"), F.count_if(F.col("_v") <= F.col("b")).alias("upto"), F.count("*").alias("n"))
    held = (F.col("under") <= F.col("_lo")) & (F.col("_hi") < F.col("upto"))
    counts = materialize(counts.withColumn("held", held), "percentile-counts")
    ids = [*of, *(["_t"] if "_t" not in of else [])]
    inside = met.join(counts.select(*ids, "held"), ids) if counts.filter("not held").limit(1).count() else met.withColumn("held", F.lit(True))
    within = materialize(inside.filter((F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b")) | ~F.col("held")).select(*ids, "_v"), "percentile-values")
    most = counts.filter(F.col("a") != F.col("b")).agg(F.max(F.when(F.col("held"), F.col("upto") - F.col("under")).otherwise(F.col("n")))).first()[0] or 0
    less = F.when(F.col("held"), F.col("under")).otherwise(0)
    left = materialize(counts.select(*[c for c in each if c not in ("_lo", "_hi")], (F.col("_lo") - less).alias("_lo"), (F.col("_hi") - less).alias("_hi")), "percentile-ranks")
    forget(bounds, counts)
    return within, left, most
