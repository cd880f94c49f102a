"""Soak checks: finding diffs, interval and nearest joins, counts, regressions, log severities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finding_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings that went away and that appeared, as sets: columns such as the scope are part of a finding, repeats aren't."""
    gone = before.subtract(after).withColumn("change", F.lit("WENT_AWAY"))
    return gone.unionByName(after.subtract(before).withColumn("change", F.lit("APPEARED")))


def truth_gaps(truth: DataFrame, findings: DataFrame, on: list[str]) -> DataFrame:
    """Planted entries without a finding, and findings that nothing explains."""
    missing = truth.join(findings.select(*on), on, "left_anti").select(*on, F.lit("MISSING").alias("gap"))
    return missing.unionByName(findings.join(truth.select(*on), on, "left_anti").select(*on, F.lit("UNEXPLAINED").alias("gap")))


def unexplained(findings: DataFrame, truth: DataFrame, banned: DataFrame, removed: DataFrame) -> DataFrame:
    """Q34: (scope, key, why) of findings (scope, key, class_name, method_name) that truth (scope, key) doesn't name (UNNAMED), that match a
    banned pattern (scope, class_pattern, methods; null or empty methods: all) (BANNED), or whose class was removed (scope, class_name) (REMOVED).
    A pattern matches as in F14."""
    unnamed = findings.join(truth.select("scope", "key"), ["scope", "key"], "left_anti").select("scope", "key", F.lit("UNNAMED").alias("why"))
    b = F.broadcast(banned.select("scope", "class_pattern", "methods"))  # a written list
    name, pattern = F.col("class_name"), F.col("class_pattern")
    full = F.rlike(name, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))
    hit = findings.join(b, "scope").where((name == pattern) | F.endswith(name, pattern) | full)
    hit = hit.where(F.coalesce(F.size("methods") <= 0, F.lit(True)) | F.array_contains("methods", F.col("method_name")))
    gone = findings.join(removed.select("scope", "class_name").distinct(), ["scope", "class_name"], "left_semi").select("scope", "key", F.lit("REMOVED").alias("why"))
    return unnamed.unionByName(hit.select("scope", "key", F.lit("BANNED").alias("why"))).unionByName(gone).distinct()


def binned(df: DataFrame, start: str, stop: str, width: float) -> DataFrame:
    """One row per bin of ``width`` that [start, stop] touches. Interval joins meet by bin and so stay equi-joins."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))


def within_windows(points: DataFrame, windows: DataFrame, key: list[str], at: str, width: float, inside: bool = True) -> DataFrame:
    """Points inside (or outside) every window [t0, t1] of their key. points have a unique column id."""
    w = binned(windows.where("t0 <= t1"), "t0", "t1", width).select(*key, "bin", "t0", "t1")
    p = points.withColumn("bin", F.floor(F.col(at) / width))
    hit = p.join(w, [*key, "bin"]).where((F.col(at) >= F.col("t0")) & (F.col(at) <= F.col("t1"))).select("id").distinct()
    return points.join(hit, "id", "left_semi" if inside else "left_anti")


def nearest_control(processes: DataFrame, controls: DataFrame, salt: int = 1) -> DataFrame:
    """Each process with the control of its app whose start is nearest (ties: the earlier). Both: app, id, started.

    As-of in both directions by one sort per app over the union: the last control before and the first after. With salt, an app's processes are
    dealt over so many tasks, each with all of the app's controls.
    """
    one = F.lit(0) if salt == 1 else F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int")
    both = processes.select("app", one.alias("part"), "id", "started", F.lit(None).cast(controls.schema["id"].dataType).alias("control"), F.lit(None).cast("double").alias("c_at")).unionByName(
        controls.select("app", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("part"), F.lit(None).cast(processes.schema["id"].dataType).alias("id"), "started", F.col("id").alias("control"), F.col("started").cast("double").alias("c_at"))
    )
    w = Window.partitionBy("app", "part").orderBy("started", F.col("id").isNotNull())
    v = Window.partitionBy("app", "part").orderBy(F.desc("started"), F.col("id").isNotNull())
    c = F.when(F.col("c_at").isNotNull(), F.struct("c_at", "control"))
    both = both.withColumns({"before": F.last(c, ignorenulls=True).over(w), "after": F.last(c, ignorenulls=True).over(v)})
    far = lambda x: F.abs(F.col("started") - x["c_at"])
    pick = F.when(F.col("before").isNull() | (far(F.col("after")) < far(F.col("before"))), F.col("after")).otherwise(F.col("before"))
    return both.where("id is not null").select("app", "id", "started", pick["control"].alias("control")).where("control is not null")


LEAST_SAMPLES = 6


def control_at_same_ages(samples: DataFrame, starts: DataFrame, controls: DataFrame, warm_up: float = 1800.0) -> DataFrame:
    """(instance, pid, control, control_pid, started, t0, t1) of each process and the control process it is compared with.

    samples: instance, pid, at, rss. starts: instance, pid, started (a process without one starts with its first sample). controls: instance,
    control, the control's instance name. Both must have LEAST_SAMPLES after warm_up at the ages that both cover; among those controls the
    nearest start wins, then the smaller pid. t0 and t1: the ages compared.
    """
    first = samples.groupBy("instance", "pid").agg(F.min("at").alias("first"))
    first = first.join(starts, ["instance", "pid"], "left").select("instance", "pid", F.coalesce("started", "first").alias("started"))
    aged = samples.join(first, ["instance", "pid"]).withColumn("age", F.col("at") - F.col("started")).where(F.col("age") >= warm_up)
    spans = aged.groupBy("instance", "pid", "started").agg(F.min("age").alias("lo"), F.max("age").alias("hi"))
    c = spans.select(F.col("instance").alias("control"), F.col("pid").alias("control_pid"), F.col("started").alias("c_started"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    pairs = spans.join(F.broadcast(controls), "instance").join(c, "control").where("lo <= c_hi and c_lo <= hi")
    # the process's samples inside the control's ages, then the control's inside those
    mine = pairs.join(aged.select("instance", "pid", "age"), ["instance", "pid"]).where("age between c_lo and c_hi")
    keys = ["instance", "pid", "control", "control_pid"]
    mine = mine.groupBy(*keys, "started", "c_started").agg(F.count(F.lit(1)).alias("n"), F.min("age").alias("t0"), F.max("age").alias("t1")).where(F.col("n") >= LEAST_SAMPLES)
    same = mine.join(aged.select(F.col("instance").alias("control"), F.col("pid").alias("control_pid"), "age"), ["control", "control_pid"]).where("age between t0 and t1")
    same = same.groupBy(*keys, "started", "c_started", "t0", "t1").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= LEAST_SAMPLES)
    best = F.min_by(F.struct("control", "control_pid", "t0", "t1", "c_started"), F.struct(F.abs(F.col("c_started") - F.col("started")), "control_pid"))
    return same.groupBy("instance", "pid", "started").agg(best.alias("b")).select("instance", "pid", "started", "b.*")


def memory_trend(samples: DataFrame, keys: list[str], warm_up: float = 1800.0) -> DataFrame:
    """Slope, mean, first and last of rss by the age of the process, without its first half hour. Slope 0 where undefined."""
    first = samples.groupBy(*keys).agg(F.min("at").alias("start"))
    aged = samples.join(first, keys).withColumn("age", F.col("at") - F.col("start")).where(F.col("age") >= warm_up)
    at = F.struct("age", "event_id")
    return aged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.coalesce(F.nullif(F.regr_slope("rss", "age"), F.lit(float("nan"))), F.lit(0.0)).alias("slope"), F.avg("rss").alias("mean"), F.min_by("rss", at).alias("first"), F.max_by("rss", at).alias("last"),
    )


def memory_verdict(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q37: (instance, pid, control_pid, slope, allowed, verdict) of each pair of control_at_same_ages over the ages compared, per hour: GROWS if
    the slope passes the control's (0 at least) by a tenth of the control's mean a day. A process without a pair isn't judged."""

    def trend(own, started, prefix):
        x = samples.select(F.col("instance").alias(own[0]), F.col("pid").alias(own[1]), "at", "rss").join(pairs, list(own)).withColumn("h", (F.col("at") - F.col(started)) / 3600.0)
        x = x.where("h between t0 / 3600.0 and t1 / 3600.0")
        slope = F.coalesce(F.nullif(F.regr_slope("rss", "h"), F.lit(float("nan"))), F.lit(0.0))
        return x.groupBy("instance", "pid", "control_pid").agg(slope.alias(f"{prefix}slope"), F.avg("rss").alias(f"{prefix}mean"))

    both = trend(("instance", "pid"), "started", "").join(trend(("control", "control_pid"), "c_started", "c_"), ["instance", "pid", "control_pid"])
    allowed = F.greatest(F.col("c_slope"), F.lit(0.0)) + 0.1 * F.col("c_mean") / 24.0
    return both.select("instance", "pid", "control_pid", "slope", allowed.alias("allowed"), F.when(F.col("slope") > allowed, "GROWS").otherwise("FLAT").alias("verdict"))


def count_tolerance(traffic: DataFrame, starts: DataFrame, kills: DataFrame, limits: DataFrame) -> DataFrame:
    """(route, ok, sent, tolerance) over the instances that recorded the route (traffic: instance, route, ok, non2xx, errors, rate_per_s, flush_s).

    With a = ceil(rate * flush) + 1, an instance's tolerance is a + 2 starts + (kills + limits) * a + ceil(10 rate). starts and kills:
    a row (instance) for each; an instance without a recorded start counts one. limits: a row for each, whatever the instance.
    """
    n = lambda df, c: df.groupBy("instance").agg(F.count(F.lit(1)).alias(c))
    x = traffic.join(n(starts, "starts"), "instance", "left").join(n(kills, "kills"), "instance", "left")
    x = x.crossJoin(F.broadcast(limits.agg(F.count(F.lit(1)).alias("limits")))).fillna(1, ["starts"]).fillna(0, ["kills"])  # limits: one row
    per = F.ceil(F.col("rate_per_s") * F.col("flush_s")) + 1
    tolerance = per + 2 * F.col("starts") + (F.col("kills") + F.col("limits")) * per + F.ceil(10 * F.col("rate_per_s"))
    return x.groupBy("route").agg(F.sum("ok").alias("ok"), F.sum(F.col("ok") + F.col("non2xx") + F.col("errors")).alias("sent"), F.sum(tolerance).alias("tolerance"))


def count_verdict(before: DataFrame, after: DataFrame, totals: DataFrame) -> DataFrame:
    """Q35: (route, total, holds): the listed total must lie between the ok of count_tolerance read before and all sent by the one read after,
    widened by the later tolerance. An unlisted route has no total and doesn't hold."""
    x = after.join(before.select("route", F.col("ok").alias("ok_before")), "route", "left").join(totals, "route", "left")
    holds = F.col("total").between(F.coalesce("ok_before", F.lit(0)) - F.col("tolerance"), F.col("sent") + F.col("tolerance"))
    return x.select("route", "total", F.coalesce(holds, F.lit(False)).alias("holds"))


def run_end(runs: DataFrame, listed: DataFrame, outages: DataFrame, now: float, flush: float) -> DataFrame:
    """Q36: (instance_id, verdict) of every ended run: GOOD, a fault, or a reason why it isn't asserted; the first that holds.

    runs: instance_id, how, started, ended, asserted. listed: instance_id, ended_cleanly. outages: t0, t1 (null: still going on); a written list.
    """
    w = F.broadcast(outages.select((F.col("t0") - 5).alias("a"), (F.coalesce("t1", F.lit(now)) + 2 * flush).alias("b")))
    r = runs.where("ended is not null")
    during = r.join(w, (F.col("ended") >= F.col("a")) & (F.col("ended") <= F.col("b")), "left_semi").select("instance_id").distinct().withColumn("during", F.lit(True))
    x = r.join(during, "instance_id", "left").join(listed.select("instance_id", F.lit(True).alias("there"), F.coalesce("ended_cleanly", F.lit(False)).alias("clean")), "instance_id", "left")
    how = F.col("how")
    verdict = (
        F.when(how == "crash", "FAULT_CRASHED")
        .when(~F.col("asserted"), "SKIP_UNASSERTED")
        .when(how == "graceful-timeout", "FAULT_KILLED_ON_TIMEOUT")
        .when(F.coalesce(~how.isin("graceful", "kill9"), F.lit(True)), "SKIP_OTHER_END")
        .when((how == "graceful") & F.col("during"), "SKIP_OUTAGE")
        .when(F.lit(now) - F.col("ended") < 2 * flush + 30, "SKIP_TOO_RECENT")
        .when(F.col("there").isNull() & (F.col("ended") - F.col("started") >= 2 * flush), "FAULT_NOT_LISTED")
        .when(F.col("there").isNull(), "SKIP_SHORT_LIVED")
        .when((how == "graceful") & ~F.col("clean"), "FAULT_NOT_CLEAN")
        .when((how == "kill9") & F.col("clean"), "FAULT_CLEAN")
        .otherwise("GOOD")
    )
    return x.select("instance_id", verdict.alias("verdict"))


def level_counts(lines: DataFrame) -> DataFrame:
    """Lines of each source and level."""
    return lines.groupBy("source", "level").agg(F.count(F.lit(1)).alias("lines"))


def severity_verdicts(lines: DataFrame, allowed: DataFrame, windows: DataFrame, width: float = 3600.0) -> DataFrame:
    """Q38: (id, verdict) of lines (id, source, level, is_agent, at, text) with a level: NOT_JUDGED (an application's own), ALLOWED (an entry of
    allowed, disruption, level, pattern, matches and the time lies in one of its disruption's windows), OUTSIDE (matches, at another time) or
    UNEXPLAINED. windows: level, disruption, t0, t1. allowed is a written list."""
    judged = F.col("source").isin("server", "collector") | F.col("is_agent")
    x = lines.where("level is not null")
    own = x.where(judged)
    hit = own.join(F.broadcast(allowed), "level").where(F.rlike("text", F.col("pattern"))).select("id", "level", "disruption", "at").distinct()
    hit = hit.withColumns({"line": F.col("id"), "id": F.monotonically_increasing_id()})
    inside = within_windows(hit.where("at is not null"), windows, ["level", "disruption"], "at", width).select(F.col("line").alias("id")).distinct()
    x = x.join(inside.withColumn("in", F.lit(True)), "id", "left").join(hit.select(F.col("line").alias("id")).distinct().withColumn("hit", F.lit(True)), "id", "left")
    verdict = F.when(~judged, "NOT_JUDGED").when(F.col("in"), "ALLOWED").when(F.col("hit"), "OUTSIDE").otherwise("UNEXPLAINED")
    return x.select("id", verdict.alias("verdict"))


def run_verdicts(runs: DataFrame, before: DataFrame, after: DataFrame, planned: DataFrame) -> DataFrame:
    """Q39: (run, verdict) of finished test runs (run, exit, has_before, has_after, t0, t1), the first that holds: FAILED (exit not 0), NO_BEFORE,
    PENDING (not read after it yet), PLANNED_CHANGE (planned, at, lies in its window: not compared), CHANGED or UNCHANGED. before and
    after: run, scope, key; they are compared as sets."""
    keys = ["run", "scope", "key"]
    diff = finding_diff(before.select(*keys), after.select(*keys)).select("run").distinct().withColumn("changed", F.lit(True))
    inside = runs.join(F.broadcast(planned.select("at")), (F.col("at") >= F.col("t0")) & (F.col("at") <= F.col("t1")), "left_semi").select("run").withColumn("planned", F.lit(True))
    x = runs.join(diff, "run", "left").join(inside, "run", "left")
    verdict = (
        F.when(F.coalesce("exit", F.lit(-1)) != 0, "FAILED").when(~F.col("has_before"), "NO_BEFORE").when(~F.col("has_after"), "PENDING")
        .when(F.col("planned"), "PLANNED_CHANGE").when(F.col("changed"), "CHANGED").otherwise("UNCHANGED")
    )
    return x.select("run", verdict.alias("verdict"))


def read_violations(reads: DataFrame) -> DataFrame:
    """Q40: per window, distinct violations over its good reads; failed when more than a tenth of the reads failed."""
    return reads.groupBy("window").agg(F.count(F.lit(1)).alias("reads"), F.count_distinct("violation").alias("violations"), (F.count_if("failed") * 10 > F.count(F.lit(1))).alias("too_many_failed"))


def capped(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows as evidence, and one row that says how many more there are."""
    n = rows.count()
    head = rows.orderBy(*order).limit(most).select(F.concat_ws(" ", *order).alias("line"))
    return head.union(rows.sparkSession.createDataFrame([(f"... and {n - most} more",)], "line string")) if n > most else head


def due_reads(opened: DataFrame, ticks: DataFrame, period: float, span: float) -> DataFrame:
    """(key, at, covered, skipped) of reads (key, at) after window openings (key, at): covered while an opening lies less than span back; skipped
    is how many periods a late read passed over, where one opening covers this read and the one before."""
    both = opened.select("key", "at", F.lit(True).alias("opens")).unionByName(ticks.select("key", "at", F.lit(False).alias("opens")))
    w = Window.partitionBy("key").orderBy("at", F.desc("opens"))
    last_open = F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(w)
    t = both.withColumn("from", last_open).where("not opens")
    v = Window.partitionBy("key").orderBy("at")
    t = t.withColumns({"before": F.lag("at").over(v), "from_before": F.lag("from").over(v)})
    gap = F.col("at") - F.col("before")
    # the newest opening that covers the read before covers this one too if any does
    shared = F.coalesce((F.col("before") - F.col("from_before") < span) & (F.col("at") - F.col("from_before") < span), F.lit(False))
    skipped = F.when(shared & (gap > 1.5 * period), F.rint(gap / period).cast("int") - 1).otherwise(F.lit(0))
    return t.select("key", "at", F.coalesce(F.col("at") - F.col("from") < span, F.lit(False)).alias("covered"), skipped.alias("skipped"))


def opened_windows(events: DataFrame, key: str, at: str, opens: str, span: float) -> DataFrame:
    """Windows that events open: an opener within span of the one before prolongs its window."""
    w = Window.partitionBy(key).orderBy(at)
    o = events.where(opens).withColumn("new", (F.col(at) - F.lag(at).over(w) > span) | F.lag(at).over(w).isNull())
    o = o.withColumn("n", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return o.groupBy(key, "n").agg(F.min(at).alias("t0"), (F.max(at) + span).alias("t1"), F.count(F.lit(1)).alias("opened"))
