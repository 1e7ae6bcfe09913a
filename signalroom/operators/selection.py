"""Which inputs a run takes, where outputs go, and what comes with an input. Columns and small joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalroom.sources import files


def resolved(path: Column) -> Column:
    """A path without empty and single-dot parts, and with each double dot taken back."""
    step = lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def below(path: Column, roots: list[str]) -> Column:
    """Whether a resolved path is one of the roots or lies below one."""
    held = F.lit(False)
    for root in roots:
        held = held | (path == root.rstrip("/")) | path.startswith(root.rstrip("/") + "/")
    return held


def select_inputs(rows: DataFrame, extensions: list[str], excluded: list[str] = ()) -> DataFrame:
    """rows (path and others) of supported extensions, not generated, not below excluded roots; of paths that resolve alike, the first by path."""
    out = rows.withColumn("resolved", resolved(F.col("path")))
    kept = out.where(files.extension(F.col("path")).isin(extensions) & ~files.is_generated(F.col("path")) & ~below(F.col("resolved"), list(excluded)))
    first = Window.partitionBy("resolved").orderBy("path")
    return kept.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def output_status(rows: DataFrame, root: str, relative: str = "relative") -> DataFrame:
    """rows with output, and status: ``unsafe`` where the path leaves the root, ``collision`` where others write there too, else ``ok``."""
    path = F.col(relative)
    unsafe = path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..")
    out = rows.withColumn("output", F.when(~unsafe, F.concat(F.lit(root.rstrip("/") + "/"), resolved(path))))
    counts = out.where("output is not null").groupBy(F.col("output").alias("_o")).agg(F.count("*").alias("_n")).where("_n > 1")
    return out.join(counts, F.col("output") == F.col("_o"), "left").withColumn("status", F.when(F.col("output").isNull(), "unsafe").when(F.col("_n") > 1, "collision").otherwise("ok")).drop("_o", "_n")


SIDECAR, MOST_SIDECAR = ".wm.json", 1_000_000


def with_sidecars(rows: DataFrame) -> DataFrame:
    """rows (path, length, content) that are no sidecars, with what their sidecar says: a map of strings, empty if malformed, null if there is none or it is too large."""
    is_side = F.col("path").endswith(SIDECAR)
    told = F.coalesce(F.from_json(F.col("content").cast("string"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    side = rows.where(is_side & (F.col("length") <= MOST_SIDECAR)).groupBy(F.expr(f"left(path, length(path) - {len(SIDECAR)})").alias("_of")).agg(F.min(F.struct(F.to_json(told).alias("j"))).alias("_s"))
    joined = rows.where(~is_side).join(side, F.col("path") == F.col("_of"), "left")
    return joined.withColumn("sidecar", F.from_json("_s.j", "map<string,string>")).drop("_of", "_s")


def setting(env: Column, dotenv: Column, project: Column, default: Column) -> Column:
    """A setting's value and where it comes from: the environment, the .env file, the project file, or the default; empty strings count as set."""
    sources = [("environment", env), ("dotenv", dotenv), ("project", project)]
    source = F.lit("default")
    for name, value in reversed(sources):
        source = F.when(value.isNotNull(), name).otherwise(source)
    return F.struct(F.coalesce(env, dotenv, project, default).alias("value"), source.alias("source"))


def fronts(rows: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """rows with ``front``: 0 for those of a group that no other beats in both objectives, 1 for those that only the former beat, and so on.

    A group is a population and is held by one task. In order of the first objective, a row's front is one more
    than the highest front of a row that beats it; the best second objective of each front finds it by bisection.
    """

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        order = part.sort_values([first, second], ascending=False, kind="stable")
        best: list[tuple[float, float]] = []  # of each front, the largest second objective so far, and that row's first one
        found = []
        for a, b in zip(order[first], order[second], strict=True):
            low, high = 0, len(best)
            while low < high:  # fronts before low beat the row
                mid = (low + high) // 2
                y, x = best[mid]
                if y > b or (y == b and x > a):
                    low = mid + 1
                else:
                    high = mid
            if low == len(best):
                best.append((b, a))
            elif (b, a) > best[low]:
                best[low] = (b, a)
            found.append(low)
        return order.assign(front=pd.Series(found, index=order.index, dtype="int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(group).applyInPandas(rank, f"{schema}, front bigint")
