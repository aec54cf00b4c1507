"""Filters, visibility, set operations, lookups and table rewrites."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import staged


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; true without any."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def equals_if_given(**values) -> Column:
    """column = value for every value that is not None; absent filters leave no trace in the plan."""
    return all_of(*(F.col(k) == F.lit(v) for k, v in values.items() if v is not None))


def excluding(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df without a partner in other."""
    return df.join(other.select(*on).distinct(), on, "left_anti")


def visible_students(students: DataFrame, classes: DataFrame, role: str, organization: int | None = None, own_id: int | None = None) -> DataFrame:
    """Admins see all, teachers their organization, students themselves."""
    if role == "admin":
        return students
    if role == "teacher":
        return students.join(classes.where(F.col("organization_id") == organization), "class_id", "left_semi")
    return students.where(F.col("student_id") == own_id)


def ordered_lookup(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows with the given keys in the caller's order; keys without a row are dropped."""
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(i).cast(df.schema[key].dataType) for i in ids))).alias("position", key))
    return F.broadcast(wanted).join(df, key).orderBy("position")


def keyed_upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with rows of new inserted or, on equal keys, replaced."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def conditional_update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The columns set where condition holds, and ``changed``."""
    hit = F.coalesce(condition, F.lit(False))
    out = df.withColumn("changed", hit)
    return out.withColumns({k: F.when(F.col("changed"), v).otherwise(F.col(k)) for k, v in values.items()})


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Parents and each child table without what hangs on the keys in gone."""
    out = {name: df.join(gone.select(F.col(key).alias(fk)), fk, "left_anti") for name, (df, fk) in children.items()}
    return out | {"parents": parents.join(gone.select(key), key, "left_anti")}


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def group_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", total: str = "total") -> DataFrame:
    """Adds the place of every row in its group and the group's size, for groups of any size.

    Rows are range-partitioned by group and order and written once (a second sampling could draw other
    borders), so that a large group lies in several parts; a row's place is the size of the group's earlier
    parts and its place in its own.  The order must be total in a group; null keys are a group.
    """
    parted = staged(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = parted.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__own"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    same = functools.reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.col("__part") == F.col("__own"))
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return parted.withColumn("__place", local).join(offsets, same).withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__own", "__place", "__before", *(f"__{k}" for k in keys))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of every row in one total order, without bringing the rows together."""
    return group_ranks(df, [], order, name, "__total").drop("__total")


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page, counted from 1; the size is capped."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_then_threshold(df: DataFrame, keys: list[str], order: list[Column], k: int, keep: Column) -> DataFrame:
    """The first k of each key, of which those that pass: never the other way round."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).where(keep)


def relaxing_first_match(requests: DataFrame, candidates: DataFrame, levels: list[list[str]], item: str) -> DataFrame:
    """requests with item and level: the smallest candidate that agrees on the columns of the strictest level that has one.

    Candidates are cut to one for each key of a level before they meet the requests.
    """
    out = requests
    for k, on in enumerate(levels):
        out = out.join(candidates.groupBy(*on).agg(F.min(item).alias(f"__{k}")), on, "left")
    level = F.lit(None).cast("int")
    for k in reversed(range(len(levels))):
        level = F.when(F.col(f"__{k}").isNotNull(), k).otherwise(level)
    found = F.coalesce(*(F.col(f"__{k}") for k in range(len(levels))))
    return out.withColumns({item: found, "level": level}).where("level is not null").drop(*(f"__{k}" for k in range(len(levels))))


def priority_union(sources: list[DataFrame], keys: list[str], priority: str, most: int, per: str, tie: str) -> DataFrame:
    """All sources, each key at its best priority, and the first most of each per."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s)
    best = union.groupBy(*keys).agg(F.min(priority).alias(priority))
    return best.withColumn("n", F.row_number().over(Window.partitionBy(per).orderBy(priority, tie))).where(F.col("n") <= most).drop("n")
