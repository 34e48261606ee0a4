"""Interval operators over half-open [start, end) rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the form of a tag text (action, agents, first frame, frame after the last).
TAG_FORM = r"^(\w+)\(([^ ]+) at (\d+)-(\d+)\)$"


def merge_intervals(df: DataFrame, keys: list[str], tolerance: int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of a key whose gap is at most tolerance, joined."""
    way = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(way.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + tolerance), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(way)).groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def horizon(df: DataFrame, frame: str, current: Column, ahead: int = 80) -> DataFrame:
    """The rows of the `ahead` frames after the current one."""
    return df.where((F.col(frame) > current) & (F.col(frame) <= current + ahead))


def parsed_tags(entries: DataFrame, entry: str, actions: list[str], ego: str = "") -> DataFrame:
    """The other columns, agent, action, start, end of tag texts such as Stopping(7,ego at 12-30), a row for each agent.

    A trailing Temporal of the action is dropped, ego stands for the id in column `ego` and is left out without one.
    Texts of another form, of other actions or without a length are left out.
    """
    form = TAG_FORM
    entry = F.trim(entry)
    part = lambda i: F.regexp_extract(entry, form, i)
    found = entries.where(entry.rlike(form)).withColumns({"action": F.regexp_replace(part(1), "Temporal$", ""), "start": part(3).cast("long"), "end": part(4).cast("long"), "agent": F.explode(F.split(part(2), ","))})
    found = found.withColumn("agent", F.trim("agent")).where((F.col("agent") != "") & F.col("action").isin(actions) & (F.col("end") > F.col("start")))
    return found.withColumn("agent", F.when(F.col("agent") == "ego", F.col(ego).cast("string") if ego else F.lit(None).cast("string")).otherwise(F.col("agent"))).where("agent is not null")


def rename_before(df: DataFrame, keys: list[str], label: str, old: str, follower: str, new: str, within: int) -> DataFrame:
    """`old` intervals become `new` where a `follower` of the same key starts 0 to within frames after their end.

    Only the nearest follower start at or after the end matters, so it is found with one window instead of an interval join.
    """
    way = Window.partitionBy(*keys).orderBy("_at", "_kind")
    marks = df.withColumn("_at", F.when(F.col(label) == follower, F.col("start")).otherwise(F.col("end"))).withColumn("_kind", (F.col(label) == follower).cast("int"))
    following = F.first(F.when(F.col(label) == follower, F.col("start")), ignorenulls=True).over(way.rowsBetween(1, Window.unboundedFollowing))
    marks = marks.withColumn("_next", following)
    return marks.withColumn(label, F.when((F.col(label) == old) & (F.col("_next") - F.col("end") <= within), F.lit(new)).otherwise(F.col(label))).drop("_at", "_kind", "_next")


def resolve_conflicts(df: DataFrame, key: str, priority: dict[str, int], excludes: dict[str, set[str]]) -> DataFrame:
    """(key, action, start, end) with overlapping exclusive actions of a key trimmed.

    In order of start, then priority: where an earlier action excludes a later one, that with the smaller priority number
    keeps the overlap; at equal priority the later one does. A fold over one key's intervals, hence a grouped function.
    """
    kinds = df.schema
    schema = f"`{key}` {kinds[key].dataType.simpleString()}, action string, start long, end long"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rank = part["action"].map(lambda a: priority.get(a, 99))
        live: list[list] = []
        for row in part.assign(_p=rank).sort_values(["start", "_p", "action"]).itertuples():
            new = [row.action, int(row.start), int(row.end), int(row[-1])]
            for old in live:
                if new[0] in excludes.get(old[0], ()) and max(old[1], new[1]) < min(old[2], new[2]):
                    if old[3] < new[3]:
                        new[1] = max(new[1], old[2])
                    else:
                        old[2] = min(old[2], new[1])
            live = [x for x in [*live, new] if x[1] < x[2]]
        live.sort(key=lambda x: (x[1], x[2], x[0]))
        joined: list[list] = []
        for x in live:
            if joined and joined[-1][0] == x[0] and x[1] <= joined[-1][2]:
                joined[-1][2] = max(joined[-1][2], x[2])
            else:
                joined.append(x)
        return pd.DataFrame([[part[key].iloc[0], *x[:3]] for x in joined], columns=[key, "action", "start", "end"])

    return df.select(key, "action", "start", "end").groupBy(key).applyInPandas(fold, schema)


def drop_when_multiple(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Without the rows of `value` for keys that have several rows."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where((F.col("_n") == 1) | (F.col(label) != value)).drop("_n")
