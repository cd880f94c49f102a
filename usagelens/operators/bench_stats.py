"""Statistics over benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median, range and quartiles (linear interpolation)."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), q[0].alias("q1"), q[1].alias("q3"))


def percent_change(value: Column, base: Column) -> Column:
    """null where the base is 0."""
    return F.when(base != 0, (value - base) / base * 100)


def number_text(x: Column) -> Column:
    """one decimal for whole numbers below 10^15, else three without trailing zeros."""
    whole = (x == F.rint(x)) & (F.abs(x) < 1e15)
    cut = F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")
    return F.when(x.isNotNull(), F.when(whole, F.format_string("%.1f", x)).otherwise(cut))


def signed_percent(x: Column) -> Column:
    """one decimal with its sign; what rounds to nothing has none."""
    text = F.format_string("%+.1f%%", x)
    return F.when(x.isNotNull(), F.when(text.isin("-0.0%", "+0.0%"), "0.0%").otherwise(text))


def per_request(counter: Column, requests: Column, scale: float = 1.0) -> Column:
    """a rate per request; null without requests."""
    return F.when(requests > 0, counter * scale / requests)


def request_ratios(metrics: Column) -> Column:
    """the three ratios of a map of metrics that its entries allow; an empty map without requests."""
    requests = metrics["k6Requests"]
    ratio = lambda name, of, scale: F.struct(F.lit(name).alias("key"), F.when(requests > 0, F.try_divide(metrics[of] * scale, requests)).alias("value"))
    all_ = F.array(ratio("cpuMillisPerRequest", "cpuSeconds", 1000.0), ratio("allocatedKiBPerRequest", "allocatedMiB", 1024.0), ratio("gcPauseMsPer1kRequests", "gcPauseTotalMs", 1000.0))
    return F.map_from_entries(F.filter(all_, lambda e: e["value"].isNotNull()))


def cpu_use(before: Column, after: Column, elapsed_seconds: Column) -> Column:
    """cpu_seconds, cores_avg, throttled_periods and throttled_ms between two readings (structs of usage_micros, throttled_periods, throttled_micros)."""
    seconds = (after["usage_micros"] - before["usage_micros"]) / 1e6
    return F.struct(
        seconds.alias("cpu_seconds"), (seconds / elapsed_seconds).alias("cores_avg"), (after["throttled_periods"] - before["throttled_periods"]).cast("double").alias("throttled_periods"),
        ((after["throttled_micros"] - before["throttled_micros"]) / 1e3).alias("throttled_ms"),
    )


def against_baseline(summaries: DataFrame, baseline: str) -> DataFrame:
    """Each variant's median beside the baseline's: change in percent, and noise if it lies within the baseline's range."""
    b = summaries.where(F.col("variant") == baseline).select("metric", F.col("median").alias("b"), F.col("min").alias("b_min"), F.col("max").alias("b_max"))
    x = summaries.join(b, "metric")
    overlap = (F.col("min") <= F.col("b_max")) & (F.col("b_min") <= F.col("max"))
    return x.select("metric", "variant", "median", percent_change(F.col("median"), F.col("b")).alias("change"), F.col("median").between(F.col("b_min"), F.col("b_max")).alias("noise"), overlap.alias("overlap"))


def pivoted(summaries: DataFrame, variants: list[str], form: str = "range", baseline: str | None = None) -> DataFrame:
    """One row per metric; a column per variant: ``median (min to max)``, or with form "iqr" ``median (q1 to q3)``, and n/a where
    there is none; with a baseline, further columns ``<variant> change`` against its median, marked ``*`` inside its range."""
    lo, hi = ("min", "max") if form == "range" else ("q1", "q3")
    cell = F.concat(number_text(F.col("median")), F.lit(" ("), number_text(F.col(lo)), F.lit(" to "), number_text(F.col(hi)), F.lit(")"))
    x = summaries.select("metric", "variant", cell.alias("cell"))
    if baseline is not None:
        change = against_baseline(summaries, baseline).select("metric", "variant", F.concat(signed_percent(F.col("change")), F.when(F.col("noise"), " *").otherwise("")).alias("change"))
        x = x.join(change, ["metric", "variant"], "left")
    aggs = [F.first(F.when(F.col("variant") == v, F.col("cell")), ignorenulls=True).alias(v) for v in variants]
    if baseline is not None:
        aggs += [F.first(F.when(F.col("variant") == v, F.col("change")), ignorenulls=True).alias(f"{v} change") for v in variants if v != baseline]
    out = x.groupBy("metric").agg(*aggs)
    return out.fillna("n/a", [c for c in out.columns if c != "metric"])


def warm_up(slices: DataFrame, keys: list[str], drift: float, slice_seconds: int, min_seconds: int, cap_seconds: int) -> DataFrame:
    """The verdict after each slice. STEADY once min_seconds are spent and each of the last two slices lies within drift (a share of
    the slice before it, which must have served something); else CAPPED from cap_seconds on; else CONTINUE."""
    w = Window.partitionBy(*keys).orderBy("slice")
    s = slices.withColumns({"a": F.lag("throughput", 2).over(w), "b": F.lag("throughput", 1).over(w), "spent": F.row_number().over(w) * F.lit(slice_seconds)})
    near = lambda x, y: (F.col(x) > 0) & (F.abs(F.col(y) - F.col(x)) <= (drift + 1e-12) * F.col(x))
    steady = F.col("a").isNotNull() & near("a", "b") & near("b", "throughput") & (F.col("spent") >= min_seconds)
    return s.select(*keys, "slice", F.when(steady, "STEADY").when(F.col("spent") >= cap_seconds, "CAPPED").otherwise("CONTINUE").alias("verdict"))


def warmth(load: Column, first: Column, last: Column) -> Column:
    """(drift, problem) of a run's window from its first and last third: request counts in a closed loop, median latencies in an open
    one, whose ratio is turned round, so that above 1 means still speeding up either way."""
    opened = load == "OPEN"
    below = F.when(opened, last).otherwise(first)
    problem = F.when(first.isNull(), "NO_FIRST_THIRD").when(last.isNull(), "NO_LAST_THIRD").when(below <= 0, "NOTHING_SERVED")
    return F.struct(F.when(problem.isNull(), F.when(opened, first / last).otherwise(last / first)).alias("drift"), problem.alias("problem"))


#: How far the median window of a variant may drift either way.
MAX_WINDOW_DRIFT = 0.10


def variant_warmth(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drift, missing, capped, verdict) over the runs of a variant (drift, warmup_steady): the median drift, the runs without
    one, the warm-ups that hit their cap; verdict MISSING, RISING, FALLING or null for steady."""
    per = runs.groupBy(*keys).agg(F.median("drift").alias("drift"), F.count_if(F.col("drift").isNull()).alias("missing"), F.count_if(~F.coalesce("warmup_steady", F.lit(False))).alias("capped"))
    verdict = F.when(F.col("missing") > 0, "MISSING").when(F.col("drift") > 1 + MAX_WINDOW_DRIFT, "RISING").when(F.col("drift") < 1 - MAX_WINDOW_DRIFT, "FALLING")
    return per.withColumn("verdict", verdict)


def window_allocation(samples: DataFrame, group: list[str]) -> DataFrame:
    """Bytes allocated in the window: per thread the last sample less the first, or less 0 if it began more than a second late; never below 0."""
    start = samples.groupBy(*group).agg(F.min("at").alias("start"))
    per = samples.groupBy(*group, "thread").agg(F.min_by("allocated", "at").alias("first"), F.min("at").alias("first_at"), F.max_by("allocated", "at").alias("last"))
    base = F.when(F.col("first_at") <= F.col("start") + 1, F.col("first")).otherwise(F.lit(0))
    return per.join(start, group).groupBy(*group).agg(F.sum(F.greatest(F.col("last") - base, F.lit(0))).alias("allocated"))


#: A25, fixed values: (event type, field, unit's divisor, [(metric, aggregate)]).
MIB = 1024.0 * 1024.0
EVENT_RULES = [
    ("jdk.CPULoad", "jvmUser", 0.01, [("cpuJvmUserAvgPct", "avg"), ("cpuJvmUserMaxPct", "max")]),
    ("jdk.CPULoad", "machineTotal", 0.01, [("cpuMachineTotalAvgPct", "avg")]),
    ("jdk.GCPhasePause", "durationMs", 1.0, [("gcPauseTotalMs", "sum")]),
    ("jdk.G1GarbageCollection", "durationMs", 1.0, [("g1GcTotalMs", "sum")]),
    ("jdk.GCHeapSummary", "heapUsed", MIB, [("heapUsedMinMiB", "min"), ("heapUsedMaxMiB", "max")]),
    ("jdk.JavaThreadStatistics", "peakCount", 1.0, [("peakThreads", "max")]),
    ("jdk.ResidentSetSize", "size", MIB, [("rssMaxMiB", "max")]),
    ("jdk.MetaspaceSummary", "metaspace.used", MIB, [("metaspaceUsedMaxMiB", "max")]),
    ("jdk.NetworkUtilization", "readRate", 8192.0, [("networkReadKiBps", "sums")]),
    ("jdk.NetworkUtilization", "writeRate", 8192.0, [("networkWriteKiBps", "sums")]),
]


def event_rollup(events: DataFrame, keys: list[str], rules: list = EVENT_RULES) -> DataFrame:
    """(keys, metric, value) of extracted events (keys, type, field, at, value). Aggregates: avg, max, min, sum, and sums: the values of
    each moment are added (one event for each interface) and the moments averaged. A metric without events has no row."""
    flat = [(t, f, d, m, a) for t, f, d, many in rules for m, a in many]
    known = F.broadcast(events.sparkSession.createDataFrame(flat, "type string, field string, divisor double, metric string, how string"))  # a row per rule
    x = events.join(known, ["type", "field"]).groupBy(*keys, "metric", "how", "divisor", "at").agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = x.groupBy(*keys, "metric", "how", "divisor").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("s").alias("sums")).where("n > 0")
    how = F.col("how")
    value = F.when(how == "avg", F.col("s") / F.col("n")).when(how == "max", F.col("hi")).when(how == "min", F.col("lo")).when(how == "sum", F.col("s")).otherwise(F.col("sums"))
    return x.select(*keys, "metric", (value / F.col("divisor")).alias("value"))


def counter_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What each counter gained; one missing before counts from 0."""
    b = before.select(*keys, F.col("value").alias("b"))
    return after.join(b, keys, "left").select(*keys, (F.col("value") - F.coalesce("b", F.lit(0.0))).alias("gained"))


#: Q41: a closed loop must keep its pinned cores this busy, an open one must leave this share free.
MIN_SATURATION, OPEN_MAX_UTILISATION = 0.9, 0.8


def load_problem(load: Column, cores_avg: Column, pinned: Column, dropped: Column) -> Column:
    """Q41: why a window's load was no valid test. Closed: NOT_SATURATED, too little work reached the service. Open: DROPPED iterations, then
    NO_HEADROOM. Unknown figures give no problem."""
    closed = F.when(cores_avg < MIN_SATURATION * pinned, "NOT_SATURATED")
    return F.when(load == "OPEN", F.when(F.coalesce(dropped, F.lit(0)) > 0, "DROPPED").when(cores_avg >= OPEN_MAX_UTILISATION * pinned, "NO_HEADROOM")).otherwise(closed)


def delivery_problems(instrumented: Column, probes: Column, endpoints: Column, disabled_modules: Column) -> Column:
    """Q41: what a run's manifests lack: an array of NO_PROBE, NO_ENDPOINT, DISABLED_MODULES; empty for runs without the agent."""
    found = F.array(F.when(F.coalesce(probes, F.lit(0)) <= 0, "NO_PROBE"), F.when(F.coalesce(endpoints, F.lit(0)) <= 0, "NO_ENDPOINT"), F.when(disabled_modules > 0, "DISABLED_MODULES"))
    return F.when(instrumented, F.array_compact(found)).otherwise(F.array().cast("array<string>"))


def run_problems(load: Column, cores_avg: Column, pinned: Column, dropped: Column, warmth_problem: Column, delivery: Column) -> Column:
    """Q41: all problems of a run, in order: load, warmth, delivery. No problem: a valid run."""
    return F.concat(F.array_compact(F.array(load_problem(load, cores_avg, pinned, dropped), warmth_problem)), delivery)


#: Q42: attempts of one repeat, and discarded attempts of a whole run.
MAX_ATTEMPTS, MAX_RETRIES = 2, 1


def retries(attempts: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    """Q42: attempts (run, order, attempt, problems) that are discarded and run again: those whose only problem is NOT_SATURATED, which the
    machine causes, before the last attempt, as long as the run has discarded fewer than MAX_RETRIES."""
    mine = attempts.where((F.size("problems") > 0) & F.forall("problems", lambda p: p == "NOT_SATURATED") & (F.col("attempt") < MAX_ATTEMPTS))
    return mine.withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy(*order, "attempt"))).where(F.col("_n") <= MAX_RETRIES).drop("_n")
