"""Running values along a coordinate without one task for a whole chromosome.

A coordinate is cut into bins. Totals of bins are few, so running over them is cheap; what they carry in is joined
to the rows, which run on within their bin only.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIN = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors share; a private one only in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _carried(df: DataFrame, part: list[str], pos: str, total: Column, width: int) -> DataFrame:
    df = df.withColumn("_bin", F.floor(F.col(pos) / width))
    before = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return df, df.groupBy(*part, "_bin").agg(total.alias("_total")), before


def running_sum(df: DataFrame, part: list[str], order: list, pos: str, value: Column, name: str, inclusive: bool = True, width: int = BIN) -> DataFrame:
    """Adds name: the sum of value over rows of the part up to this one, in the order of pos and order; bins follow pos."""
    return running_sums(df, part, order, pos, {name: (value, inclusive)}, width)


def running_sums(df: DataFrame, part: list[str], order: list, pos: str, sums: dict[str, tuple[Column, bool]], width: int = BIN) -> DataFrame:
    """running_sum of several values (name: value, inclusive) in one pass."""
    df = df.withColumns({f"_value_{k}": v for k, (v, _) in sums.items()} | {"_bin": F.floor(F.col(pos) / width)})
    totals = df.groupBy(*part, "_bin").agg(*[F.sum(f"_value_{k}").alias(f"_total_{k}") for k in sums])
    before = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, "_bin", *[F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_carry_{k}") for k in sums])
    local = Window.partitionBy(*part, "_bin").orderBy(pos, *order)
    to = lambda inclusive: local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = df.join(carry, [*part, "_bin"])
    found = {k: F.col(f"_carry_{k}") + F.coalesce(F.sum(f"_value_{k}").over(to(inclusive)), F.lit(0)) for k, (_, inclusive) in sums.items()}
    return rows.withColumns(found).drop("_bin", *[f"_{c}_{k}" for c in ("value", "carry") for k in sums])


def running_max(df: DataFrame, part: list[str], order: list, pos: str, value: Column, name: str, width: int = BIN) -> DataFrame:
    """Adds name: the most of value over rows of the part before this one, null for the first."""
    df, totals, before = _carried(df.withColumn("_value", value), part, pos, F.max("_value"), width)
    carry = totals.select(*part, "_bin", F.max("_total").over(before).alias("_carry"))
    local = Window.partitionBy(*part, "_bin").orderBy(pos, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.join(carry, [*part, "_bin"])
    return rows.withColumn(name, F.greatest("_carry", F.max("_value").over(local))).drop("_bin", "_value", "_carry")


def next_value(df: DataFrame, part: list[str], pos: str, name: str, width: int = BIN) -> DataFrame:
    """Adds name: pos of the next row of the part, null for the last; the last row of a bin takes the next bin's first."""
    df, firsts, _ = _carried(df, part, pos, F.min(pos), width)
    after = firsts.select(*part, "_bin", F.lead("_total").over(Window.partitionBy(*part).orderBy("_bin")).alias("_following"))
    local = Window.partitionBy(*part, "_bin").orderBy(pos)
    return df.join(after, [*part, "_bin"]).withColumn(name, F.coalesce(F.lead(pos).over(local), "_following")).drop("_bin", "_following")


#: Rows of a stretch that a carried scan folds at once.
STRETCH = 4096


def carried_scan(rows: DataFrame, order: list[str], fold: Callable, schema: str, stretch: int = STRETCH) -> DataFrame:
    """A fold over rows in the order of those columns, whose outcome depends on what came before, without a task for all of them.

    fold(frame, state, last) gets a stretch of rows in order, the state that the stretch before left (None at the very beginning) and whether it's the
    last one, and returns (frame of results, state); states are JSON values. Rows are ranked and cut into stretches of fixed size. All are folded as if nothing came before
    them, and left states go on to the next stretches; those that got another state than they reckoned with are folded again, until none
    does. Where states forget what is far behind, that takes few rounds, each of the stretches still open. Rows must not differ but in these columns.
    """
    from .coverage import with_rank

    ranked = with_rank(rows.select(*order), F.struct(*order), order[-1], "_rank")
    ranked = checkpoint(ranked.withColumn("_stretch", F.floor((F.col("_rank") - 1) / stretch)))
    most = ranked.agg(F.max("_stretch")).first()[0]

    def stated(keep: bool):
        def run(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
            at = int(frame["_stretch"].iloc[0]) if len(frame) else 0
            text = entry["state"].iloc[0] if len(entry) else "null"
            if not len(frame):
                return pd.DataFrame({"_stretch": [], "state": []})
            out, state = fold(frame.sort_values("_rank"), json.loads(text), at == most)
            return out if keep else pd.DataFrame({"_stretch": [at], "state": [json.dumps(state)]})

        return run

    def left_by(entries: DataFrame, some: DataFrame) -> DataFrame:
        return checkpoint(some.groupBy("_stretch").cogroup(entries.groupBy("_stretch")).applyInPandas(stated(False), "_stretch long, state string"))

    none = ranked.sparkSession.createDataFrame([], "_stretch long, state string")
    reckoned = checkpoint(ranked.select("_stretch").distinct().withColumn("state", F.lit("null")))  # what each stretch began with
    left = left_by(none, ranked)
    while True:
        entries = left.select((F.col("_stretch") + 1).alias("_stretch"), "state").where(F.col("_stretch") <= (most or 0))
        wrong = checkpoint(entries.join(reckoned.withColumnRenamed("state", "_old"), "_stretch").where("state != _old").select("_stretch", "state"))
        if not wrong.take(1):
            break
        again = left_by(wrong, ranked.join(wrong.select("_stretch"), "_stretch", "left_semi"))
        kept = lambda old, new: old.join(new.select("_stretch"), "_stretch", "left_anti").unionByName(new)
        left, reckoned = checkpoint(kept(left, again)), checkpoint(kept(reckoned, wrong))
    return ranked.groupBy("_stretch").cogroup(reckoned.groupBy("_stretch")).applyInPandas(stated(True), schema)
