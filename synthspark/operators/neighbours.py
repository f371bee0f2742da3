"""The two nearest neighbours of every point, exactly, by pivots and the triangle inequality.

Equal rows of the searched table are one class with a number of copies. Up to
``MOST`` classes are pivots; a class belongs to the region of its nearest pivot and,
inside it, to a ring by its distance to that pivot. The distances of a point to all
pivots bound its second neighbour from above; only rings that the bound reaches are
joined, and only classes in its window are measured. Rings hold about ``RING``
classes, so crowded regions are many join keys. Nothing is dropped: where distances
are all alike, as among random directions of many dimensions or from a point with an
unknown category, nearly every ring is visited.

Beside one number (``nearest_on_line``) no pair is measured for nothing: in every
group of classes that share some of a point's categories, the two before and the two
after it on the line are all that can be nearest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pivots at most (they are broadcast), classes of a ring, and slack of bounds for rounding.
MOST, RING, SLACK = 256, 256, 1e-9
#: Rows that a block of the line holds, about, blocks at most, and categories whose subsets are all searched.
LINE, BLOCKS, SUBSETS = 4096, 1024, 4


def square(n_numeric: int, n_categorical: int, other: str = "t_", unknown: str = "unknown") -> Column:
    """The squared distance of (x, y) and (other_x, other_y) as one sum without lambdas, so that it is compiled.

    A category is 0 if equal and 2 if not; each ``unknown`` one takes 1 off, for it has no place of its own.
    """
    parts = [f"(get(x, {i}) - get({other}x, {i})) * (get(x, {i}) - get({other}x, {i}))" for i in range(n_numeric)] + [f"if(get(y, {i}) <> get({other}y, {i}), 2.0D, 0.0D)" for i in range(n_categorical)]
    while len(parts) > 1:
        parts = [f"({' + '.join(parts[i : i + 2])})" for i in range(0, len(parts), 2)]
    return F.expr(f"{parts[0]} - {unknown}")


def _pivots(classes: DataFrame) -> DataFrame:
    """(pivot, p_x, p_y): about the root of the number of classes, the first by a hash of their features."""
    n = min(MOST, math.isqrt(classes.count()) + 1)
    order = F.xxhash64("t_x", "t_y")
    rows = classes.select("t_x", "t_y").orderBy(order, "t_x", "t_y").limit(n).collect()
    return classes.sparkSession.createDataFrame([(i, r["t_x"], r["t_y"]) for i, r in enumerate(rows)], "pivot int, p_x array<double>, p_y array<string>")


def candidates(points: DataFrame, train: DataFrame, n_numeric: int, n_categorical: int) -> DataFrame:
    """(id, src, d, copies): points of (id, src, x, y, unknown) and what may be one of their two nearest classes of (t_x, t_y)."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A stated number of partitions: rows are few beside their distances to pivots, so adaptive execution must not merge them.
    classes = train.repartition(n, "t_x", "t_y").groupBy("t_x", "t_y").agg(F.count(F.lit(1)).alias("copies"))
    pivots = _pivots(classes)
    to_pivot = F.sqrt(F.greatest(F.lit(0.0), square(n_numeric, n_categorical, "p_")))
    # Groupings are by what the rows are already partitioned by, of plain numbers: hash aggregates without a shuffle.
    own = classes.select(F.col("t_x").alias("x"), F.col("t_y").alias("y"), "copies", F.lit(0).alias("unknown"))
    least = own.crossJoin(F.broadcast(pivots)).groupBy("x", "y", "copies", "unknown").agg(F.min(to_pivot).alias("t_d"))
    dealt = least.crossJoin(F.broadcast(pivots)).where(to_pivot == F.col("t_d")).groupBy("x", "y", "copies", "t_d").agg(F.min("pivot").alias("pivot")).select(F.col("x").alias("t_x"), F.col("y").alias("t_y"), "copies", "t_d", "pivot")
    here = F.sum(F.when(F.col("t_d") == 0, F.col("copies")).otherwise(0))
    regions = dealt.groupBy("pivot").agg(F.max("t_d").alias("radius"), F.count(F.lit(1)).alias("n"), here.alias("here"), F.min(F.when(F.col("t_d") > 0, F.col("t_d"))).alias("next"))
    width = F.when(F.col("radius") > 0, F.col("radius") / F.ceil(F.col("n") / RING)).otherwise(1.0)
    # ``second``: how far the second row of the region is from its pivot. One row a pivot: at most MOST.
    regions = regions.select("pivot", "radius", width.alias("width"), F.when(F.col("here") > 1, 0.0).when(F.col("here") == 1, F.col("next")).alias("second"))
    told = pivots.join(F.broadcast(regions), "pivot")
    asked = points.select("id", "src", "x", "y", "unknown").repartition(n, "id", "src")
    # Two rows lie within the distance of a pivot and its second row, or else within that of all pivots.
    upper = F.coalesce(F.min(to_pivot + F.col("second")), F.max(to_pivot))
    reaching = asked.crossJoin(F.broadcast(told)).groupBy(*asked.columns).agg((upper * (1 + SLACK) + SLACK).alias("reach"))
    near = reaching.crossJoin(F.broadcast(told)).withColumn("d", to_pivot).where("d - reach <= radius")
    ring = lambda d: F.floor(d / F.col("width")).cast("int")
    first, last = ring(F.greatest(F.lit(0.0), F.col("d") - F.col("reach"))), ring(F.least(F.col("radius"), F.col("d") + F.col("reach")))
    visits = near.select("id", "src", "x", "y", "unknown", "reach", "pivot", "d", F.explode(F.sequence(first, last)).alias("ring"))
    placed = dealt.join(F.broadcast(regions.select("pivot", "width")), "pivot").withColumn("ring", F.floor(F.col("t_d") / F.col("width")).cast("int")).drop("width")
    met = visits.join(placed, ["pivot", "ring"]).where("abs(d - t_d) <= reach")
    return met.select("id", "src", F.sqrt(F.greatest(F.lit(0.0), square(n_numeric, n_categorical))).alias("d"), "copies")


def nearest(points: DataFrame, train: DataFrame, n_numeric: int, n_categorical: int) -> DataFrame:
    """(id, src, d1, d2): distances of each point to its nearest and second nearest row of ``train``.

    Equal rows are neighbours of their own, so two copies give d1 = d2. With one
    row d2 is null; with none there are no rows. The two least of a point are
    kept in each task before the shuffle.
    """
    order = Window.partitionBy("id", "src").orderBy("d")
    two = candidates(points, train, n_numeric, n_categorical).withColumn("k", F.row_number().over(order)).where("k <= 2")
    one = F.max(F.when(F.col("k") == 1, F.col("copies")))
    return two.groupBy("id", "src").agg(F.min("d").alias("d1"), F.when(one > 1, F.min("d")).otherwise(F.max(F.when(F.col("k") == 2, F.col("d")))).alias("d2"))


def _blocks(points: DataFrame, train: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What gives rows of ``x`` their ``block`` of the line; cuts are quantiles of both tables, so none is crowded but by one number."""
    both = points.select(F.get("x", F.lit(0)).alias("v")).unionByName(train.select(F.get("t_x", F.lit(0)).alias("v")))
    told = both.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS).alias("cuts")).first()
    every = max(1, math.ceil(BLOCKS * LINE / max(1, told["n"])))
    cuts = sorted(set(told["cuts"] or []))[::every]
    if not cuts:
        return lambda df: df.withColumn("block", F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="v", outputCol="block").transform


def _beside(asked: DataFrame, classes: DataFrame, n_categorical: int, masks: list[int], place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``asked`` (v, y, unknown, near) with the two nearest (d, v, y, copies) of what stands beside it, with several masks of ``near`` too.

    For each mask, classes that share its categories are one group. Windows go
    over blocks of a group; the last two classes of the blocks before and the
    first two of those after come from a row for each block.
    """
    def grouped(df: DataFrame) -> DataFrame:
        shared = lambda m: F.array(*(F.get("y", F.lit(i)) if m >> i & 1 else F.lit(None) for i in range(n_categorical))).cast("array<string>")
        return place(df.select("*", F.inline(F.array(*(F.struct(F.lit(m).alias("mask"), shared(m).alias("shared")) for m in masks)))))

    own = F.struct("v", "y", "copies").alias("own")
    rows = grouped(classes.select("v", "y", own)).unionByName(grouped(asked), allowMissingColumns=True)
    group, line = ["mask", "shared", "block"], "over (partition by mask, shared, block order by v)"
    seen = rows.select("*", *(F.expr(f"{f}(own, {k}) ignore nulls {line}").alias(f"{f}{k}") for f in ("lag", "lead") for k in (1, 2)))
    edge = lambda c: F.collect_list(F.when(F.col("own").isNotNull() & F.col(c).isNull(), F.col("own")))
    filled = lambda c: F.when(F.size(c) > 0, c)
    edges = seen.groupBy(*group).agg(edge("lag2").alias("first"), edge("lead2").alias("last")).select(*group, filled(F.col("first")).alias("first"), filled(F.col("last")).alias("last"))
    blocks = "over (partition by mask, shared order by block)"
    others = [f"{f}({c}, {k}) ignore nulls {blocks}" for f, c in (("lag", "last"), ("lead", "first")) for k in (1, 2)]
    around = edges.select(*group, F.concat(*(F.coalesce(F.expr(e), F.array().cast(edges.schema["first"].dataType)) for e in others)).alias("around"))
    found = seen.where("own is null").join(around, group)
    # Other blocks count only where the own one lacks two on a side.
    short = F.col("lag2").isNull() | F.col("lead2").isNull()
    met = F.when(short, F.concat(F.array_compact(F.array("lag1", "lag2", "lead1", "lead2")), "around")).otherwise(F.array("lag1", "lag2", "lead1", "lead2"))

    def measured(c: Column) -> Column:
        apart = [F.when(F.get("y", F.lit(i)) != F.get(c["y"], F.lit(i)), 2.0).otherwise(0.0) for i in range(n_categorical)]
        square = sum(apart, (F.col("v") - c["v"]) * (F.col("v") - c["v"])) - F.col("unknown")
        return F.struct(F.sqrt(F.greatest(F.lit(0.0), square)).alias("d"), c["v"].alias("v"), c["y"].alias("y"), c["copies"].alias("copies"))

    two = lambda near: F.slice(F.sort_array(near), 1, 2)
    each = found.select("v", "y", "unknown", "near", two(F.transform(met, measured)).alias("best"))
    if len(masks) == 1:
        return each.select("v", "y", "unknown", F.col("best").alias("near"))
    # A class may come by more than one mask.
    return each.groupBy("v", "y", "unknown", "near").agg(F.collect_list("best").alias("best")).select("v", "y", "unknown", two(F.array_distinct(F.concat("near", F.flatten("best")))).alias("near"))


def nearest_on_line(points: DataFrame, train: DataFrame, n_categorical: int) -> DataFrame:
    """``nearest`` of points of one number and at most ``SUBSETS`` categories, by sorting instead of measuring pairs.

    A row that shares exactly the categories S with a point is among its two nearest
    only if it is one of the two nearest numbers of all rows that share S: others
    that are as near in number share no fewer categories. So a row for every subset
    and side is enough. Whoever has two rows of all its categories within the
    distance of a category needs no other subset.
    """
    place = _blocks(points, train)
    own = lambda p: (F.get(f"{p}x", F.lit(0)).alias("v"), F.col(f"{p}y").cast("array<string>").alias("y"))
    classes = train.select(*own("t_")).groupBy("v", "y").agg(F.count(F.lit(1)).alias("copies"))
    known = points.select("id", "src", *own(""), F.col("unknown").cast("int").alias("unknown"))
    none = F.array().cast("array<struct<d:double,v:double,y:array<string>,copies:bigint>>").alias("near")
    whole = 2**n_categorical - 1
    first = F.get("near", F.lit(0))
    d1, d2 = first["d"], F.when(first["copies"] > 1, first["d"]).otherwise(F.get("near", F.lit(1))["d"])
    # Read three times, and as large as the points' distinct features.
    near = _beside(known.select("v", "y", "unknown", none).distinct(), classes, n_categorical, [whole], place).persist()
    settled = F.coalesce(d2 <= math.sqrt(2), F.lit(False))
    if whole and near.agg(F.count_if(~settled)).first()[0]:
        near = near.where(settled).unionByName(_beside(near.where(~settled), classes, n_categorical, list(range(whole)), place))
    told = near.where(F.size("near") > 0).select("v", "y", "unknown", d1.alias("d1"), d2.alias("d2"))
    return known.join(told, ["v", "y", "unknown"]).select("id", "src", "d1", "d2")
