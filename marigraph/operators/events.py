"""Matching, differences and errors of event series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, timefn


def match_first(left: DataFrame, right: DataFrame, seconds: int = 10800, nearest: bool = False) -> DataFrame:
    """Each left event with the first (or nearest) right event of its key and type that is less than ``seconds`` away.

    Both have key, type, ts, value; equal left events count once, a right event can serve
    several, and of right events at one time the least value does, null last. No pairs are
    made: events are dealt by key, type and buckets of ``seconds``, a bucket's first and last
    right events also go to the buckets that they can be reached from, and in order of time
    each left event takes the right one beside it. For the first, it stands ``seconds`` early.
    """
    keys, span, early = ["key", "type"], seconds * 1_000_000, 0 if nearest else seconds

    def dealt(d: DataFrame, is_right: bool) -> DataFrame:
        micros = timefn.micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
        return d.where("key is not null and type is not null and ts is not null").select(*keys, "ts", "value", F.lit(is_right).alias("_right"), (micros - F.pmod(micros, F.lit(span))).alias("_b"))

    def moved(best, order, *steps: int) -> DataFrame:
        one = r.groupBy(*keys, "_b").agg(best(F.struct("ts", "value"), order).alias("e"))
        return one.select(*keys, "e.ts", "e.value", F.lit(True).alias("_right"), F.explode(F.array(*[F.col("_b") + k * span for k in steps])).alias("_b"))

    l, r = dealt(left.withColumn("ts", timefn.shift(F.col("ts"), F.lit(-early))), False), dealt(right, True)  # noqa: E741
    least = (F.col("value").isNull(), F.col("value"))
    every = l.unionByName(r).unionByName(moved(F.min_by, F.struct("ts", *least), *((-1,) if nearest else (-2, -1))))
    w, so_far = Window.partitionBy(*keys, "_b"), (Window.unboundedPreceding, 0)
    # the least of equal times comes last; a right event at a left one's own time doesn't follow it
    down = w.orderBy(F.desc("ts"), "_right", F.desc_nulls_first("value"))
    event = F.when(F.col("_right"), F.struct(F.col("ts").alias("r_ts"), F.col("value").alias("r_value")))
    own = F.when(~F.col("_right"), F.struct("ts", "value"))
    found = {"_again": F.lag(own).over(down).eqNullSafe(own), "_next": F.last(event, True).over(down.rowsBetween(*so_far))}
    if nearest:
        every = every.unionByName(moved(F.max_by, F.struct("ts", ~least[0], ~F.isnan("value"), -least[1]), 1))
        up = w.orderBy("ts", F.desc("_right"), F.desc_nulls_first("value"))
        found["_last"] = F.last(event, True).over(up.rowsBetween(*so_far))
    every = every.withColumns(found).where("not _right and not _again").withColumn("l_ts", timefn.shift(F.col("ts"), F.lit(early)))
    apart = lambda c: timefn.micros_between(F.col("l_ts"), F.col(c)["r_ts"]) / 1e6
    best = F.col("_next")
    if nearest:
        best = F.when(F.col("_next").isNull() | (F.abs(apart("_last")) <= apart("_next")), F.col("_last")).otherwise(best)
    met = every.withColumn("m", best).withColumn("seconds", apart("m")).where(F.abs("seconds") < seconds)
    return met.select("key", "type", "l_ts", F.col("value").alias("l_value"), "m.*", "seconds")


def error_stats(matches: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Count, mean, root mean square and largest error of times (s, 1 place) and values (3 places)."""
    dv = F.col("r_value") - F.col("l_value")
    s = F.col("seconds")
    return matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 1).alias("mean_s"), F.round(F.sqrt(F.avg(s * s)), 1).alias("rms_s"), F.max(F.abs(s)).alias("max_s"),
        F.round(F.avg(dv), 3).alias("mean_v"), F.round(F.sqrt(F.avg(dv * dv)), 3).alias("rms_v"), F.round(F.max(F.abs(dv)), 3).alias("max_v"),
    )


def macro_average(stats: DataFrame, provider: str = "provider") -> DataFrame:
    """Per provider the mean of its stations' errors, and whether it has the least (ties to the first by name)."""
    each = stats.groupBy(provider).agg(F.count(F.lit(1)).alias("stations"), F.round(F.avg("rms_s"), 1).alias("rms_s"), F.round(F.avg("rms_v"), 3).alias("rms_v"))
    best = each.agg(F.min(F.struct("rms_v", provider)).alias("b")).select(F.col(f"b.{provider}").alias("_best"))
    return each.crossJoin(F.broadcast(best)).withColumn("winner", F.col(provider) == F.col("_best")).drop("_best")  # one row


def match_greedy(left: DataFrame, right: DataFrame, seconds: int = 7200) -> DataFrame:
    """Full outer matching, one to one: left events in order take the nearest free right event of their key and type within ``seconds``, the earlier of equally near ones.

    Series are cut where no event follows within ``seconds``: no match reaches across. A
    group is one such stretch of one series and type, or as many as begin within some
    thousand events. Both have key, type, ts, value; what isn't matched follows with nulls.
    """
    schema = "key long, type string, l_ts timestamp_ntz, l_value double, r_ts timestamp_ntz, r_value double"
    cut = lambda d, side: d.select("key", "type", "ts", "value", F.lit(side).alias("side"))
    every, w = cut(left, 0).unionByName(cut(right, 1)), Window.partitionBy("key", "type").orderBy("ts")
    far = F.coalesce(timefn.micros_between(F.lag("ts").over(w), F.col("ts")) > seconds * 1_000_000, F.lit(True))
    begun = F.max(F.when(F.col("_new"), F.col("_row"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    every = every.withColumns({"_new": far, "_row": F.row_number().over(w)}).withColumn("_group", F.floor(begun / 4096))

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "value"], kind="stable")
        l, r = (rows[rows["side"] == k].reset_index(drop=True) for k in (0, 1))  # noqa: E741
        lt, rt = (x["ts"].to_numpy().astype("datetime64[us]").astype("int64") for x in (l, r))
        n = len(r)
        after, before = list(range(n + 1)), list(range(n + 1))  # next free event from a place on, and one past the last free one before it

        def find(links: list[int], k: int) -> int:
            while links[k] != k:
                links[k] = links[links[k]]
                k = links[k]
            return k

        taken = [-1] * len(l)
        for i, place in enumerate(rt.searchsorted(lt)):
            up, down = find(after, place), find(before, place) - 1
            if down >= 0:  # the first of equal times
                first = find(after, int(rt.searchsorted(rt[down])))
                down = first if first < n and rt[first] == rt[down] else down
            near = [(abs(int(rt[k] - lt[i])), k) for k in (down, up) if 0 <= k < n]
            if near and min(near)[0] <= seconds * 1_000_000:
                k = taken[i] = min(near)[1]
                after[k], before[k + 1] = k + 1, k
        free = sorted(set(range(n)) - set(taken))
        none = lambda m: [None] * m
        match = [r["ts"][k] if k >= 0 else None for k in taken]
        out = {
            "key": [*l["key"], *r["key"][free]], "type": [*l["type"], *r["type"][free]], "l_ts": [*l["ts"], *none(len(free))], "l_value": [*l["value"], *none(len(free))],
            "r_ts": [*match, *r["ts"][free]], "r_value": [*[r["value"][k] if k >= 0 else None for k in taken], *r["value"][free]],
        }
        return pd.DataFrame(out).astype({"l_ts": "datetime64[us]", "r_ts": "datetime64[us]", "l_value": "float64", "r_value": "float64"})

    return every.drop("_new", "_row").groupBy("key", "type", "_group").applyInPandas(pair, schema)


def compare(primary: DataFrame, others: DataFrame, units: str = "ft") -> DataFrame:
    """Differences of other stations' next events from the primary's: the event at the same place if its type agrees, else the first of the type.

    Both have key, idx, type, ts, value; times count in whole seconds.
    """
    p = primary.select(F.col("idx").alias("p_idx"), "type", F.date_trunc("second", F.col("ts")).alias("p_ts"), F.col("value").alias("p_value"))
    o = others.select("key", "idx", "type", F.date_trunc("second", F.col("ts")).alias("ts"), "value")
    met = o.join(F.broadcast(p), "type")
    best = met.groupBy("key", "p_idx", "type", "p_ts", "p_value").agg(F.min_by(F.struct("ts", "value"), F.struct(F.col("idx") != F.col("p_idx"), F.col("idx"))).alias("m"))
    seconds = F.timestamp_diff("SECOND", F.col("p_ts"), F.col("m.ts"))
    raw = F.round(F.col("m.value") - F.col("p_value"), 2)
    return best.select("key", "p_idx", "type", seconds.alias("seconds"), text.time_delta(seconds).alias("time"), raw.alias("raw_value"), F.lit(units).alias("units"))


def first_delta(deltas: DataFrame) -> DataFrame:
    """Of each station the first difference with a value, else the first one."""
    best = deltas.groupBy("key").agg(F.min_by(F.struct("type", "time", "raw_value"), F.struct(F.col("raw_value").isNull(), F.col("p_idx"))).alias("d"))
    return best.select("key", "d.*")


def variance(next_events: DataFrame, primary: int, units: str = "ft") -> DataFrame:
    """``key, time, height``: each other station's first event against the primary's first, whatever their types."""
    first = Window.partitionBy("key").orderBy("ts", "type")
    one = next_events.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    p = one.where(F.col("key") == primary).select(F.col("ts").alias("p_ts"), F.col("value").alias("p_value"))
    met = one.where(F.col("key") != primary).crossJoin(F.broadcast(p))  # the primary's one row
    diff = F.round(F.col("value") - F.col("p_value"), 2)
    return met.select("key", text.time_delta(F.timestamp_diff("SECOND", F.col("p_ts"), F.col("ts"))).alias("time"), text.height_delta(diff, F.lit(units)).alias("height"))
