"""Points in a plane: sums of Gaussian kernels at points, and distances of points near each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Sources of a field, at most: they travel with the plan.
SOURCES = 1000


def gaussian_field(points: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, field: the sum over sources (x, y, a, sx, sy), at most SOURCES of them, of a exp(-(dx^2 / (2 sx)^2 + dy^2 / (2 sy)^2)), for all of a key's points."""
    found = sources.select("x", "y", "a", "sx", "sy").limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"over {SOURCES} sources")
    if not found:
        return points.select(key, F.lit(0.0).alias("field")).distinct()
    known = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in r.asDict().items()]) for r in found])
    far = lambda s, c: F.pow(F.col(c) - s[c], F.lit(2)) / F.pow(2 * s[f"s{c}"], F.lit(2))
    own = F.aggregate(known, F.lit(0.0), lambda t, s: t + s["a"] * F.exp(-(far(s, "x") + far(s, "y"))))
    return points.groupBy(key).agg(F.sum(own).alias("field"))


def pair_distances(states: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """step, pairs, mean: pairs of agents within the radius of each other and their mean distance. Agents meet in grid cells as wide as the radius, so far ones never pair."""
    cell = cell or radius
    a = states.select("step", "agent", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = a.withColumn("_d", F.explode(around)).select(
        "step",
        F.col("agent").alias("other"),
        F.col("x").alias("ox"),
        F.col("y").alias("oy"),
        (F.col("cx") + F.col("_d.i")).alias("cx"),
        (F.col("cy") + F.col("_d.j")).alias("cy"),
    )
    d = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    near = a.join(b, ["step", "cx", "cy"]).where("agent < other").withColumn("d", d).where(F.col("d") <= radius)
    return near.groupBy("step").agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"))
