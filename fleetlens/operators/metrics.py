"""Freshness, throughput, quantiles and error rates, each over windows of time.

Every aggregate is made of counts and sums that combine in the map tasks, so a busy
application or window is no crowded group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.pings import lag_ms

FRESHNESS_BOUNDS_MS = (100, 500, 1000, 2000)
LATENCY_BOUNDS_MS = (50, 100, 250, 500, 1000, 2500)


def window_start(ms: Column, width_ms: int) -> Column:
    """Start of the tumbling window that holds an epoch-millisecond time."""
    return ms - F.pmod(ms, F.lit(width_ms))


# ---- freshness --------------------------------------------------------------------


def with_lag(pings: DataFrame) -> DataFrame:
    """Pings with a usable time stamp and their lag; negative lags stay visible here."""
    return pings.withColumn("lag_ms", lag_ms(F.col("ts_ms"), F.col("ingest_ms"))).where(
        F.col("lag_ms").isNotNull()
    )


def bucket_counts(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    """Cumulative bucket counts ``le_<bound>`` and the total ``n``. Bounds may be fractions: a
    name with a dot in it is quoted where it is used."""
    return [F.count_if(value <= b).alias(f"le_{b}") for b in bounds] + [F.count("*").alias("n")]


def bucket(bound: float) -> Column:
    return F.col(f"`le_{bound}`")


def freshness_histogram(
    pings: DataFrame, width_ms: int, bounds: tuple[int, ...] = FRESHNESS_BOUNDS_MS
) -> DataFrame:
    """Cumulative lag histogram per arrival window. A negative lag is not recorded."""
    return (
        with_lag(pings).where(F.col("lag_ms") >= 0)
        .groupBy(window_start(F.col("ingest_ms"), width_ms).alias("window_ms"))
        .agg(*bucket_counts(F.col("lag_ms"), bounds))
    )


def freshness_slo(
    pings: DataFrame, width_ms: int, bounds: tuple[int, ...] = FRESHNESS_BOUNDS_MS
) -> DataFrame:
    """Share of pings within each objective, per arrival window."""
    return freshness_histogram(pings, width_ms, bounds).select(
        "window_ms", *[(bucket(b) / F.col("n")).alias(f"within_{b}") for b in bounds]
    )


def bucket_quantile(q: float, bounds: tuple[float, ...], total: Column) -> Column:
    """Quantile from cumulative buckets, linear inside the bucket.

    Ranks beyond the last bound give that bound; no samples give null.
    """
    rank = F.lit(q) * total
    low, below, out = F.lit(0.0), F.lit(0.0), None
    for b in bounds:
        count = bucket(b)
        inside = low + (F.lit(float(b)) - low) * (rank - below) / F.nullif(
            count - below, F.lit(0.0)
        )
        out = F.when(count >= rank, inside) if out is None else out.when(count >= rank, inside)
        low, below = F.lit(float(b)), count.cast("double")
    return F.when(total > 0, out.otherwise(F.lit(float(bounds[-1]))))


def quantiles(histogram: DataFrame, keys: list[str], bounds: tuple[float, ...]) -> DataFrame:
    """p95 and p99 of every histogram row."""
    return histogram.select(
        *keys,
        bucket_quantile(0.95, bounds, F.col("n")).alias("p95"),
        bucket_quantile(0.99, bounds, F.col("n")).alias("p99"),
    )


# ---- requests ---------------------------------------------------------------------


def matches(column: str, pattern: str) -> Column:
    """Regular expression match on the whole text."""
    return F.col(column).rlike(f"^(?:{pattern})$")


def classify(requests: DataFrame, write_uri: str, read_uri: str) -> DataFrame:
    """Add ``class``: write or read by URI pattern; other requests are dropped."""
    kind = F.when(matches("uri", write_uri), "write").when(matches("uri", read_uri), "read")
    return requests.withColumn("class", kind).where(F.col("class").isNotNull())


def throughput(classified: DataFrame, width_ms: int) -> DataFrame:
    """Requests per second for write, read and both, per application and window."""
    per_s = F.lit(width_ms / 1000.0)
    return (
        classified.groupBy("application", window_start(F.col("ts_ms"), width_ms).alias("window_ms"))
        .agg(
            (F.count_if(F.col("class") == "write") / per_s).alias("write_rps"),
            (F.count_if(F.col("class") == "read") / per_s).alias("read_rps"),
            (F.count("*") / per_s).alias("total_rps"),
        )
    )


def sliding_throughput(classified: DataFrame, width_ms: int, slide_ms: int) -> DataFrame:
    """Requests per second over overlapping windows that start every ``slide_ms``.

    Requests are counted first per pane, as wide as the greatest common divisor of width and
    slide; only those counts are copied to the windows that hold the pane.
    """
    pane = math.gcd(width_ms, slide_ms)
    panes = classified.groupBy(
        "application", "class", window_start(F.col("ts_ms"), pane).alias("pane_ms")
    ).agg(F.count("*").alias("n"))
    return (
        panes.withColumn("_start", F.explode(starts_of(F.col("pane_ms"), width_ms, slide_ms)))
        .groupBy("application", "class", F.col("_start").alias("window_ms"))
        .agg((F.sum("n") / F.lit(width_ms / 1000.0)).alias("rps"))
    )


def starts_of(ms: Column, width_ms: int, slide_ms: int) -> Column:
    """Starts of the windows, one every ``slide_ms``, that hold a time."""
    last = window_start(ms, slide_ms)
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(width_ms // slide_ms)),
                    lambda i: last - i * F.lit(slide_ms)),
        lambda start: start > ms - F.lit(width_ms),
    )


def latency_histogram(
    classified: DataFrame, width_ms: int, bounds: tuple[int, ...] = LATENCY_BOUNDS_MS
) -> DataFrame:
    return classified.groupBy(
        "application", "class", window_start(F.col("ts_ms"), width_ms).alias("window_ms")
    ).agg(*bucket_counts(F.col("duration_ms"), bounds))


def error_rate(classified: DataFrame, width_ms: int) -> DataFrame:
    """Error percentage: the larger of 5xx and SERVER_ERROR over the total rate."""
    per_s = F.lit(width_ms / 1000.0)
    by_status = F.count_if(matches("status_text", "5..")) / per_s
    by_outcome = F.count_if(F.col("outcome") == "SERVER_ERROR") / per_s
    total = F.greatest(F.count("*") / per_s, F.lit(1e-4))
    rate = F.lit(100.0) * F.greatest(by_status, by_outcome) / total
    return (
        classified.withColumn("status_text", F.col("status").cast("string"))
        .groupBy("application", "class", window_start(F.col("ts_ms"), width_ms).alias("window_ms"))
        .agg(F.coalesce(rate, F.lit(0.0)).alias("error_pct"))
    )


def check_pass_rate(requests: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Share of requests per named check (URI pattern to expected status) that pass."""
    name, ok = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for pattern, status in expected.items():
        label = F.lit(f"{pattern} is {status}")
        name = F.coalesce(name, F.when(matches("uri", pattern), label))
        ok = F.coalesce(ok, F.when(matches("uri", pattern), F.col("status") == status))
    return (
        requests.select(name.alias("check"), ok.alias("ok")).where(F.col("check").isNotNull())
        .groupBy("check")
        .agg(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("pass_rate"),
             F.count("*").alias("requests"))
    )


def distinct_applications(requests: DataFrame) -> DataFrame:
    return requests.select("application").distinct()


def band(value: Column, yellow: float, red: float) -> Column:
    return F.when(value >= red, "red").when(value >= yellow, "yellow").otherwise("green")


# Fixed values: (yellow, red) of the three indicators.
RPS_BAND, CPU_BAND, ERROR_BAND = (200.0, 500.0), (70.0, 85.0), (1.0, 5.0)


# ---- samples ----------------------------------------------------------------------


def gauge_avg(samples: DataFrame, first: str, second: str) -> DataFrame:
    """Average gauge in percent per application; ``second`` steps in where ``first`` is absent."""
    avg = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value"))) * 100
    return samples.groupBy("application").agg(F.coalesce(avg(first), avg(second)).alias("gauge_pct"))


def gauge_last(samples: DataFrame) -> DataFrame:
    """Last non-null sample of each series."""
    return (
        samples.where(F.col("value").isNotNull())
        .groupBy("series").agg(F.max_by("value", "seq").alias("value"))
    )


def counter_increase(samples: DataFrame, width_ms: int, piece_ms: int = 60_000) -> DataFrame:
    """Increase of each counter series per window; a smaller value means a restart at zero.

    A series may hold any share of all samples, so it is never one group: differences are
    taken inside short pieces of time, and the first sample of a piece is compared with the
    last one of the previous piece that has any. ``width_ms`` is a multiple of ``piece_ms``.
    """
    if width_ms % piece_ms:
        piece_ms = width_ms
    piece = samples.where(F.col("value").isNotNull()).withColumn(
        "piece_ms", window_start(F.col("ts_ms"), piece_ms)
    )
    in_piece = Window.partitionBy("series", "piece_ms").orderBy("ts_ms", "seq")

    def rise(value: Column, before: Column) -> Column:
        return F.when(value < before, value).otherwise(value - before)

    pieces = (
        piece.withColumn("_rise", rise(F.col("value"), F.lag("value").over(in_piece)))
        .groupBy("series", "piece_ms")
        .agg(F.sum("_rise").alias("_inside"),
             F.min_by("value", F.struct("ts_ms", "seq")).alias("_first"),
             F.max_by("value", F.struct("ts_ms", "seq")).alias("_last"))
    )
    before = F.lag("_last").over(Window.partitionBy("series").orderBy("piece_ms"))
    zero = F.lit(0.0)
    return (
        pieces.withColumn("_entry", rise(F.col("_first"), before))
        .groupBy("series", window_start(F.col("piece_ms"), width_ms).alias("window_ms"))
        .agg(F.sum(F.coalesce("_inside", zero) + F.coalesce("_entry", zero)).alias("increase"))
    )


# ---- overlapping ranges of a counter -----------------------------------------------------
#
# What is kept of a stretch of a series can be merged with what is kept of the next one: how many
# samples, the first and the last with their times, and the increase between samples inside. The
# increase from one stretch to the next follows from the last and the first sample.


def _rise(value: Column, before: Column) -> Column:
    """Increase from one sample to the next; a smaller value means a restart at zero."""
    return F.when(value < before, value).otherwise(value - before)


def _merged(stretches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stretches of the same ``keys``, in order, as one."""
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy(order))
    entry = F.coalesce(_rise(F.col("first"), before), F.lit(0.0))
    return (
        stretches.withColumn("_entry", entry).groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
             F.min_by("first", order).alias("first"), F.max_by("last", order).alias("last"),
             F.sum(F.col("_entry") + F.col("inside")).alias("inside"))
    )


def range_summaries(samples: DataFrame, width_ms: int, slide_ms: int, piece_ms: int = 60_000) -> DataFrame:
    """What each overlapping range of each series holds: ``series, window_ms, n, first_ms, last_ms,
    first, last, inside``; a range starts every ``slide_ms``.

    Samples are reduced within pieces, pieces within panes as wide as the greatest common divisor
    of width and slide, and only panes are copied to the ranges that hold them. So neither a
    series nor a range is one group of samples.
    """
    pane_ms = math.gcd(width_ms, slide_ms)
    if pane_ms % piece_ms:
        piece_ms = pane_ms
    at = F.struct("ts_ms", "seq")
    in_piece = Window.partitionBy("series", "piece_ms").orderBy("ts_ms", "seq")
    pieces = (
        samples.where(F.col("value").isNotNull())
        .withColumn("piece_ms", window_start(F.col("ts_ms"), piece_ms))
        .withColumn("_rise", _rise(F.col("value"), F.lag("value").over(in_piece)))
        .groupBy("series", "piece_ms")
        .agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
             F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"),
             F.coalesce(F.sum("_rise"), F.lit(0.0)).alias("inside"))
    )
    panes = pieces.withColumn("pane_ms", window_start(F.col("piece_ms"), pane_ms))
    if piece_ms < pane_ms:
        panes = _merged(panes, ["series", "pane_ms"], "piece_ms")
    copies = panes.withColumn("window_ms", F.explode(starts_of(F.col("pane_ms"), width_ms, slide_ms)))
    return _merged(copies, ["series", "window_ms"], "pane_ms")


def _reach(ranges: DataFrame, width_ms: int) -> Column:
    """Length of the stretch that the samples of a range stand for: to the ends of the range if
    these are within 1.1 mean distances of samples, else by half a mean distance, and not back
    beyond the time at which the counter would have been zero."""
    seen = (F.col("last_ms") - F.col("first_ms")).cast("double")
    mean = seen / (F.col("n") - 1)

    def side(gap: Column) -> Column:
        return F.when(gap >= mean * 1.1, mean / 2).otherwise(gap)

    start = side((F.col("first_ms") - F.col("window_ms")).cast("double"))
    zero = F.when((F.col("inside") > 0) & (F.col("first") >= 0), seen * (F.col("first") / F.col("inside")))
    end = side((F.col("window_ms") + F.lit(width_ms) - F.col("last_ms")).cast("double"))
    return (seen + F.least(start, F.coalesce(zero, start)) + end) / seen


def counter_rate_sliding(samples: DataFrame, width_ms: int, slide_ms: int,
                         extrapolate: bool = False) -> DataFrame:
    """Rate per second of each series over overlapping ranges, from the samples within a range
    alone: ``series, window_ms, rate``. A range with samples of one moment only has none.

    ``extrapolate`` scales the increase to the edges of the range, as far as samples are near them.
    """
    ranges = range_summaries(samples, width_ms, slide_ms).where(F.col("last_ms") > F.col("first_ms"))
    factor = _reach(ranges, width_ms) if extrapolate else F.lit(1.0)
    return ranges.select("series", "window_ms", (F.col("inside") * factor / F.lit(width_ms / 1000.0)).alias("rate"))


# ---- scraped samples with labels -----------------------------------------------------

INFINITE = "+Inf"


def _series(samples: DataFrame, metric: str) -> DataFrame:
    """Samples of a metric, their labels in order as the name of the series."""
    labels = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return samples.where(F.col("metric") == metric).select(
        labels.alias("series"), "ts_ms", F.col("ts_ms").alias("seq"), "value"
    )


def _labels(by: list[str]) -> list[Column]:
    label = F.from_json("series", "map<string,string>")
    return [label.getItem(n).alias(n) for n in by]


def counter_rates(samples: DataFrame, metric: str, by: list[str], width_ms: int) -> DataFrame:
    """``sum by (...) (rate(metric))`` per window, over samples ``metric, labels, ts_ms, value``.

    Increases are taken per series, that is per set of labels, and only then summed.
    """
    per_s = F.lit(width_ms / 1000.0)
    return (
        counter_increase(_series(samples, metric), width_ms)
        .groupBy("window_ms", *_labels(by)).agg((F.sum("increase") / per_s).alias("rate"))
    )


def counter_rates_sliding(samples: DataFrame, metric: str, by: list[str], width_ms: int, slide_ms: int,
                          extrapolate: bool = False) -> DataFrame:
    """As :func:`counter_rates`, over overlapping ranges."""
    return (
        counter_rate_sliding(_series(samples, metric), width_ms, slide_ms, extrapolate)
        .groupBy("window_ms", *_labels(by)).agg(F.sum("rate").alias("rate"))
    )


# ---- arithmetic between series ---------------------------------------------------------


def labelled(samples: DataFrame, **patterns: str) -> DataFrame:
    """Samples whose labels match regular expressions as a whole; a missing label is empty."""
    for name, pattern in patterns.items():
        value = F.coalesce(F.col("labels").getItem(name), F.lit(""))
        samples = samples.where(value.rlike(f"^(?:{pattern})$"))
    return samples


def combined(left: DataFrame, right: DataFrame, on: list[str], op) -> DataFrame:
    """``op(left, right)`` of the rates with equal labels ``on`` and equal window; a rate without
    a partner gives none. Missing labels are equal to each other. Both sides have one rate per
    window and set of labels."""
    keys = ["window_ms", *on]
    a = left.select(*keys, F.col("rate").alias("_left"))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rate").alias("_right"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(b, same).select(*keys, op(F.col("_left"), F.col("_right")).alias("rate"))


def or_else(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """The rates of ``first``, and those of ``second`` for windows and labels without one."""
    keys = ["window_ms", *on]
    both = first.select(*keys, "rate", F.lit(0).alias("_rank")).unionByName(
        second.select(*keys, "rate", F.lit(1).alias("_rank")))
    return both.groupBy(*keys).agg(F.min_by("rate", "_rank").alias("rate"))


def sample_error_rate(samples: DataFrame, metric: str, by: list[str], width_ms: int) -> DataFrame:
    """Error percentage from scraped request counters: the larger of 5xx and SERVER_ERROR, each
    zero where there is no such series, over the total rate."""
    total = counter_rates(samples, metric, by, width_ms)
    zero = total.withColumn("rate", F.lit(0.0))
    errors = [or_else(counter_rates(labelled(samples, **{name: pattern}), metric, by, width_ms), zero, by)
              for name, pattern in (("status", "5.."), ("outcome", "SERVER_ERROR"))]
    worst = combined(*errors, by, F.greatest)
    return combined(worst, total, by, lambda e, t: F.lit(100.0) * e / F.greatest(t, F.lit(1e-4))).withColumnRenamed(
        "rate", "error_pct")


def sampled_quantiles(samples: DataFrame, metric: str, by: list[str], width_ms: int,
                      bounds: tuple[float, ...]) -> DataFrame:
    """p95 and p99 per window from the rates of cumulative buckets, label ``le`` their bound: a
    number in any spelling, so that "1.0" is the bound 1."""
    rates = counter_rates(samples, metric, ["le", *by], width_ms)
    le = F.col("le").try_cast("double")
    buckets = rates.groupBy("window_ms", *by).agg(
        *[F.sum(F.when(le == float(b), F.col("rate"))).alias(f"le_{b}") for b in bounds],
        F.sum(F.when((F.col("le") == INFINITE) | (le == float("inf")), F.col("rate"))).alias("n"),
    )
    return quantiles(buckets, ["window_ms", *by], bounds)
