"""Trailing per-role rate limit, exact, with no role held by one task.

An attempt at t is allowed iff fewer than `limit` *allowed* attempts of its role lie in
[t - window, t]. The rule feeds back on itself, so it is no plain window function. It runs as:

1. Count attempts per (role, window-sized bucket): a partial aggregate, a few rows per role.
2. A bucket whose count together with the bucket before it stays within the limit is calm: all its
   attempts are allowed, decided by a join, no ordering needed. A run of other buckets is busy. The
   calm bucket before a run holds at most `limit` attempts, all allowed: they are the run's whole
   history, so runs are independent of each other.
3. A busy run of moderate size is decided in one grouped task.
4. A run too large for a task is walked in rounds. Only `limit` attempts per window can be allowed,
   so the walk needs few rows: a free slot is taken by the first attempt after its release. The
   current slots cut the coming timeline into intervals; each round reads the first rows of every
   interval (a group limit that starts before the shuffle), follows the slots through them, and
   stops where an interval's kept rows no longer prove the next attempt. The next round
   continues from there, so the result is exact whatever the density; a task sees at most
   hops * (limit + 1) * keep rows, however many attempts a role has.

Equal times are ordered by request_id. Prior log rows (blocked = false) are history: they fill slots
and are not decided again.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import policy
from wardline.session import materialise, new_path

MAX_RUN_ROWS = 2_000_000
HOPS = 256
KEEP = 256


@dataclass(frozen=True)
class Limits:
    limit: int = policy.RATE_LIMIT
    window_us: int = policy.RATE_WINDOW_US
    max_run_rows: int = MAX_RUN_ROWS
    hops: int = HOPS
    keep: int = KEEP


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def recent_history(prior_log: DataFrame, limit: int, since_us: int) -> DataFrame:
    """The newest `limit` allowed log rows per role: older ones cannot decide anything, because an
    attempt is blocked iff the limit-th newest allowed one is inside its window. Rows before since_us,
    the start of the earliest window, are pruned by the scan."""
    newest = Window.partitionBy("user_role").orderBy(F.desc("us"), F.desc("request_id"))
    return (prior_log.filter(~F.col("blocked") & (F.col("timestamp") >= F.timestamp_micros(F.lit(since_us))))
            .select("user_role", micros("timestamp").alias("us"), "request_id")
            .withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit).drop("_n"))


def busy_runs(attempts: DataFrame, lim: Limits) -> DataFrame:
    """(user_role, bucket, run, starts, run_rows): busy buckets with the first bucket of their run."""
    order = Window.partitionBy("user_role").orderBy("bucket")
    counts = attempts.groupBy("user_role", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.when(F.lag("bucket").over(order) == F.col("bucket") - 1, F.lag("n").over(order))
    busy = (counts.withColumn("n_before", F.coalesce(before, F.lit(0)))
            .filter(F.col("n") + F.col("n_before") > lim.limit))
    starts = F.lag("bucket").over(order).isNull() | (F.lag("bucket").over(order) != F.col("bucket") - 1)
    runs = (busy.withColumn("starts", starts)
            .withColumn("run", F.max(F.when(F.col("starts"), F.col("bucket"))).over(order)))
    whole = Window.partitionBy("user_role", "run")
    return runs.select("user_role", "bucket", "run", "starts", F.sum("n").over(whole).alias("run_rows"))


def rate_limit(attempts: DataFrame, prior_log: DataFrame | None = None,
               limits: Limits | None = None) -> DataFrame:
    """(request_id, user_role, ts, blocked), one row per attempt.

    attempts: request_id (unique), user_role, ts. prior_log: rate_limit_log rows of earlier batches.
    An attempt without a time or a role cannot be placed in any window, so it is blocked.
    """
    lim = limits or Limits()
    placed = F.col("ts").isNotNull() & F.col("user_role").isNotNull()
    unplaced = attempts.filter(~placed).select(
        "request_id", "user_role", micros().alias("us"), F.lit(True).alias("blocked"))
    attempts = attempts.filter(placed)
    rows = attempts.select("user_role", micros().alias("us"), "request_id", F.lit(False).alias("seed"))
    bucket = F.floor(F.col("us") / lim.window_us)
    # every branch below reads these narrow rows, so they are written once
    rows = materialise(rows.withColumn("bucket", bucket), "attempts")
    earliest = rows.agg(F.min("us")).first()[0] if prior_log is not None else None
    if earliest is not None:
        history = recent_history(prior_log, lim.limit, earliest - lim.window_us).withColumn("seed", F.lit(True))
        rows = rows.unionByName(materialise(history.withColumn("bucket", bucket), "history"))
    buckets = materialise(busy_runs(rows, lim), "busy-runs")

    mark = buckets.select("user_role", "bucket", "run", "run_rows")
    marked = rows.join(mark, ["user_role", "bucket"], "left")
    calm = marked.filter(F.col("run").isNull() & ~F.col("seed"))
    busy = marked.filter(F.col("run").isNotNull())
    # the calm bucket in front of a run, as that run's history
    fronts = buckets.filter("starts").select(
        "user_role", (F.col("bucket") - 1).alias("bucket"), "run", "run_rows")
    history = rows.join(fronts, ["user_role", "bucket"]).withColumn("seed", F.lit(True))
    busy = busy.unionByName(history)

    out = _verdict(calm.select("request_id", "user_role", "us", F.lit(False).alias("blocked"))
                   .unionByName(unplaced))
    small = F.col("run_rows") <= lim.max_run_rows
    out = out.unionByName(_verdict(_grouped(busy.filter(small), lim)))
    large = busy.filter(~small).select("user_role", "run", "us", "request_id", "seed")
    n_large = buckets.filter(~small & F.col("starts")).agg(F.sum("run_rows")).first()[0]
    if n_large:
        out = out.unionByName(_verdict(_in_rounds(large, lim, 2 * -(-n_large // lim.max_run_rows))))
    return out


def _verdict(df: DataFrame) -> DataFrame:
    return df.select("request_id", "user_role", F.timestamp_micros("us").alias("ts"), "blocked")


def _grouped(busy: DataFrame, lim: Limits) -> DataFrame:
    limit, window_us = lim.limit, lim.window_us

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "request_id"], kind="stable")
        slots = np.sort(pdf.loc[pdf["seed"], "us"].to_numpy())[-limit:].tolist()
        todo = pdf[~pdf["seed"]]
        us = todo["us"].to_numpy()
        blocked = np.ones(len(us), dtype=bool)
        at = 0
        while at < len(us):
            if len(slots) == limit:  # full: jump to the first attempt after the oldest slot's release
                at = max(at, int(np.searchsorted(us, slots[0] + window_us + 1)))
                if at == len(us):
                    break
                slots.pop(0)
            blocked[at] = False
            bisect.insort(slots, int(us[at]))
            at += 1
        return pd.DataFrame({"request_id": todo["request_id"], "user_role": todo["user_role"],
                             "us": us, "blocked": blocked})

    return busy.select("user_role", "run", "us", "request_id", "seed").groupBy("user_role", "run") \
        .applyInPandas(decide, "request_id string, user_role string, us long, blocked boolean")


STEP_SCHEMA = ("user_role string, run long, us long, request_id string, "
               "slots array<long>, frontier long, last_us long, last_id string")


def _in_rounds(large: DataFrame, lim: Limits, pieces: int) -> DataFrame:
    spark = large.sparkSession
    limit, window_us, keep = lim.limit, lim.window_us, lim.keep
    span = window_us + 1  # a slot taken at s is free again from s + span on
    horizon = lim.hops * span

    path = new_path(spark, "long-runs")
    (large.filter(~F.col("seed")).select("user_role", "run", "us", "request_id")
     .repartitionByRange(pieces, "user_role", "us", "request_id")
     .sortWithinPartitions("user_role", "us", "request_id").write.parquet(path))
    rows = spark.read.parquet(path)

    # at most rows / max_run_rows of these, each with at most `limit` slots
    starts = (large.groupBy("user_role", "run").agg(
        F.array_sort(F.collect_list(F.when(F.col("seed"), F.col("us")))).alias("slots"),
        F.min(F.when(~F.col("seed"), F.col("us"))).alias("frontier"),
        F.max(F.when(~F.col("seed"), F.col("us"))).alias("end_us"))).collect()
    ends = {(r.user_role, r.run): r.end_us for r in starts}
    state = [(r.user_role, r.run, r.slots[-limit:], r.frontier, r.frontier - 1, "")
             for r in starts if r.frontier is not None]

    def bounds(slots: list[int], frontier: int) -> list[int]:
        return sorted({0, *(max(0, s + span - frontier) % span for s in slots)})

    def follow(kept: pd.DataFrame, at_state: pd.DataFrame) -> pd.DataFrame:
        me = at_state.iloc[0]
        slots, start = [int(s) for s in me["slots"]], int(me["frontier"])
        last_us, last_id = int(me["last_us"]), me["last_id"]
        kept = kept.sort_values(["us", "request_id"], kind="stable")
        us, ids, interval = (kept[c].to_numpy() for c in ("us", "request_id", "interval"))
        names, sizes = np.unique(interval, return_counts=True)
        cut_short = set(names[sizes == keep].tolist())
        edges = np.array(bounds(slots, start))
        at, now, picks = 0, start, []
        while True:
            if len(slots) == limit:
                now = max(now, slots[0] + span)
                at = max(at, int(np.searchsorted(us, now)))
            if now >= start + horizon:
                break
            hop, offset = divmod(now - start, span)
            here = hop * (limit + 2) + int(np.searchsorted(edges, offset, side="right"))
            if at == len(us) or interval[at] != here:
                if here in cut_short:  # rows between the kept ones and the next interval are unseen
                    break
                if at == len(us):
                    now = start + horizon
                    break
            if len(slots) == limit:
                slots.pop(0)
            bisect.insort(slots, int(us[at]))
            picks.append(at)
            now, last_us, last_id = int(us[at]), int(us[at]), ids[at]
            at += 1
        out = pd.DataFrame({"us": us[picks], "request_id": ids[picks]})
        out["slots"] = None
        step = pd.DataFrame([{"slots": slots, "frontier": now, "last_us": last_us, "last_id": last_id}])
        out = pd.concat([out, step], ignore_index=True).reindex(
            columns=["user_role", "run", "us", "request_id", "slots", "frontier", "last_us", "last_id"])
        out["user_role"], out["run"] = me["user_role"], me["run"]
        for c in ("us", "frontier", "last_us"):
            out[c] = out[c].astype("Int64")
        return out

    picked_path, turn = new_path(spark, "picks"), 0
    while state:
        opened = spark.createDataFrame(
            [(*s, bounds(s[2], s[3])) for s in state],
            "user_role string, run long, slots array<long>, frontier long, last_us long, "
            "last_id string, edges array<long>")
        since = F.col("us") - F.col("frontier")
        ahead = (rows
                 # literal bounds reach the Parquet row-group statistics
                 .filter(F.col("us").between(min(s[3] for s in state), max(s[3] for s in state) + horizon))
                 .join(opened, ["user_role", "run"])
                 .filter((since >= 0) & (since < horizon)
                         & ((F.col("us") > F.col("last_us")) | (F.col("request_id") > F.col("last_id"))))
                 .withColumn("offset", since % span)
                 .withColumn("interval", F.floor(since / span) * (limit + 2)
                             + F.size(F.filter("edges", lambda e: e <= F.col("offset")))))
        first = Window.partitionBy("user_role", "run", "interval").orderBy("us", "request_id")
        kept = (ahead.select("user_role", "run", "interval", "us", "request_id")
                .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= keep).drop("_n"))
        (kept.groupBy("user_role", "run").cogroup(opened.groupBy("user_role", "run"))
         .applyInPandas(follow, STEP_SCHEMA).write.parquet(f"{picked_path}/round={turn}"))
        steps = spark.read.schema(STEP_SCHEMA).parquet(f"{picked_path}/round={turn}")
        state = [(r.user_role, r.run, r.slots, r.frontier, r.last_us, r.last_id)
                 for r in steps.filter(F.col("slots").isNotNull()).collect()
                 if r.frontier <= ends[(r.user_role, r.run)]]
        turn += 1

    if not turn:
        return rows.withColumn("blocked", F.lit(False))
    picks = (spark.read.schema(STEP_SCHEMA).parquet(picked_path).filter(F.col("slots").isNull())
             .select("user_role", "run", "us", "request_id", F.lit(False).alias("blocked")))
    return (rows.join(picks, ["user_role", "run", "us", "request_id"], "left")
            .withColumn("blocked", F.col("blocked").isNull()))


def attempts_trailing(attempts: DataFrame, window_us: int = policy.RATE_WINDOW_US) -> DataFrame:
    """Adds n_trailing: the role's other attempts, allowed or not, in [ts - window, ts].

    Attempts are first counted per (role, time). With buckets one window wide,
    n = (in t's bucket up to t) + (bucket before, whole) - (bucket before, earlier than t - window),
    so each time needs its running count in its own bucket and a probe in the bucket before. Running
    counts are taken inside second-sized cells and carried over from the cell totals; a cell has
    at most a million distinct times, so no group grows with a hot role.
    """
    second = 1_000_000
    keyed = attempts.withColumn("us", micros())
    # read by three branches
    times = materialise(
        keyed.filter(F.col("us").isNotNull() & F.col("user_role").isNotNull()).groupBy("user_role", "us")
        .agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("us") / window_us)), "times")
    # each time appears as a point in its own bucket and as a probe in the one before
    points = times.select(
        "user_role", "us", F.explode(F.array(
            F.struct(F.col("bucket"), F.col("us").alias("at"), F.col("n"), F.lit(1).alias("kind")),
            F.struct((F.col("bucket") - 1).alias("bucket"), (F.col("us") - window_us).alias("at"),
                     F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind")))).alias("p")
    ).select("user_role", "us", "p.*").withColumn("cell", F.floor(F.col("at") / second))
    cells = (times.withColumn("cell", F.floor(F.col("us") / second))
             .groupBy("user_role", "bucket", "cell").agg(F.sum("n").alias("cell_n")))
    in_bucket = Window.partitionBy("user_role", "bucket").orderBy("cell")
    whole = Window.partitionBy("user_role", "bucket")
    # a probe may fall in a cell without points: carry totals by an as-of read inside the bucket
    probe_cells = points.select("user_role", "bucket", "cell").distinct()
    totals = (probe_cells.join(cells, ["user_role", "bucket", "cell"], "left")
              .withColumn("cell_n", F.coalesce("cell_n", F.lit(0)))
              .withColumn("carried", F.sum("cell_n").over(in_bucket) - F.col("cell_n"))
              .withColumn("bucket_n", F.sum("cell_n").over(whole))
              .select("user_role", "bucket", "cell", "carried", "bucket_n"))
    # a probe counts strictly earlier times, so it sorts before a point of the same time
    in_cell = (Window.partitionBy("user_role", "bucket", "cell").orderBy("at", "kind")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = (points.withColumn("up_to", F.sum("n").over(in_cell))
               .join(totals, ["user_role", "bucket", "cell"])
               .withColumn("up_to", F.col("up_to") + F.col("carried")))
    per_time = counted.groupBy("user_role", "us").agg(F.sum(
        F.when(F.col("kind") == 1, F.col("up_to"))
        .otherwise(F.col("bucket_n") - F.col("up_to"))).alias("n_all"))
    return (keyed.join(per_time, ["user_role", "us"], "left")
            .withColumn("n_trailing", F.col("n_all") - 1).drop("us", "n_all"))


def rate_count(log: DataFrame, as_of: Column, window_minutes: int = policy.RATE_WINDOW_MINUTES) -> DataFrame:
    """Allowed attempts per role in the window that ends at as_of (later rows count as well)."""
    return _in_window(log, as_of, window_minutes).groupBy("user_role").agg(
        F.count_if(~F.col("blocked")).alias("query_count"))


def ratelog_split(log: DataFrame, as_of: Column, window_minutes: int = policy.RATE_WINDOW_MINUTES) -> DataFrame:
    """Blocked and allowed log rows per role in the window that ends at as_of."""
    return _in_window(log, as_of, window_minutes).groupBy("user_role").agg(
        F.count_if("blocked").alias("n_blocked"), F.count_if(~F.col("blocked")).alias("n_allowed"))


def _in_window(log: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    return log.filter(F.col("timestamp") >= as_of - F.expr(f"INTERVAL {window_minutes} MINUTES"))


def ratelog(decisions: DataFrame) -> DataFrame:
    """rate_limit_log rows of decided attempts. Requests stopped earlier never get here."""
    return decisions.select(F.col("ts").alias("timestamp"), "user_role", "request_id", "blocked")
