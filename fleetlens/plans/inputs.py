"""Inputs of the registered queries, derived from the ``events`` table.

Every row of the table becomes a trace row, a request, a sample, a query point and a
polygon; nothing is drawn at random and no row is left out. Riders stand still on a
lattice of 0.00001 degrees around one city.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.state import latest_positions, upsert_positions
from fleetlens.operators.validate import normalize_trace, valid
from fleetlens.session import spread
from fleetlens.sources.topics import map_columns

DAY_MS, HOUR_MS, MINUTE_MS = 86_400_000, 3_600_000, 60_000


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", "user_id", "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"),
    )


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Trace rows with arrival order and time; some are invalid on purpose."""
    return events(spark, sf).selectExpr(
        "event_id AS seq",
        "concat('trj-', user_id) AS trj_id",
        """CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'Motorcycle'
           WHEN 'error' THEN NULL ELSE event_type END AS driving_mode""",
        "CASE WHEN event_id % 2 = 0 THEN 'android' ELSE 'ios' END AS osname",
        "event_ms div 1000 AS pingtimestamp",
        """CASE WHEN event_id % 101 = 0 THEN 95e0 WHEN event_id % 103 = 0 THEN NULL
           ELSE (120000 + event_id * 7919 % 27000) / 100000e0 END AS rawlat""",
        "(10360000 + event_id * 104729 % 45000) / 100000e0 AS rawlng",
        "event_id * 13 % 350 / 10e0 AS speed",
        "CAST(event_id * 17 % 372 AS double) AS bearing",
        """CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -1e0
           ELSE event_id * 31 % 700 / 10e0 END AS accuracy""",
        "event_ms div 1000 * 1000 + event_id * 37 % 3000 - 50 AS ingest_ms",
    )


def pings(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_trace(trace(spark, sf))


def valid_pings(spark: SparkSession, sf: str) -> DataFrame:
    return valid(pings(spark, sf))


def typed_pings(spark: SparkSession, sf: str) -> DataFrame:
    """Valid pings whose senders name service types of their own."""
    i = F.col("seq")
    free = F.when(i % 5 == 0, "RDBMS").when(i % 7 == 0, "KAFKA").when(i % 11 == 0, "night bus")
    return valid_pings(spark, sf).withColumn("service_type", free.otherwise(F.col("service_type")))


def broken_pings(spark: SparkSession, sf: str) -> DataFrame:
    """Pings that break every rule somewhere."""
    i = F.col("seq")
    return pings(spark, sf).withColumns({
        "user_id": F.when(i % 19 == 0, "\t ").when(i % 23 == 0, F.lit(None)).otherwise(F.col("user_id")),
        "service_type": F.when(i % 29 == 0, " \n").otherwise(F.col("service_type")),
        "longitude": F.when(i % 31 == 0, F.lit(None)).when(i % 37 == 0, -180.5).otherwise(F.col("longitude")),
        "speed": F.when(i % 41 == 0, -0.5).otherwise(F.col("speed")),
    })


def valid_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Every valid ping as a position; riders have many, some of them at one place."""
    return valid_pings(spark, sf).select(
        "user_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Current position of every rider."""
    return latest_positions(valid_pings(spark, sf))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Position table of all riders."""
    return upsert_positions(valid_pings(spark, sf))


def delayed_pings(spark: SparkSession, sf: str) -> DataFrame:
    """Valid pings of which some arrive long after the time they were made."""
    late = F.when(F.col("seq") % 3 == 0, F.col("ts_ms") - 40 * DAY_MS).otherwise(F.col("ts_ms"))
    return valid_pings(spark, sf).withColumn("ts_ms", late)


def query_points(spark: SparkSession, sf: str) -> DataFrame:
    """Every valid ping as a search centre with a radius of 500..5000 m and k of 10..50."""
    i = F.col("seq")
    return valid_pings(spark, sf).select(
        i.alias("qid"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"),
        (F.lit(500) + (i * 97) % 4501).cast("double").alias("radius_m"),
        (F.lit(10) + i % 41).cast("int").alias("k"),
    )


def _lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Query points as whole numbers of 0.00001 degrees, spread before areas are made of them:
    a small file is few splits."""
    return spread(query_points(spark, sf), "qid").select(
        F.col("qid").alias("pid"),
        F.round(F.col("lat") * 100000).cast("long").alias("y"),
        F.round(F.col("lng") * 100000).cast("long").alias("x"),
        F.when(F.col("qid") % 2 == 0, 2000).otherwise(5000).alias("d"),
    )


def squares(spark: SparkSession, sf: str) -> DataFrame:
    """Squares of 0.02 or 0.05 degrees north-east of every query point, as vertex lists."""
    def deg(c):
        return c / F.lit(100000.0)

    x, y, d = F.col("x"), F.col("y"), F.col("d")
    return _lattice(spark, sf).select(
        "pid",
        F.array(deg(y), deg(y + d), deg(y + d), deg(y)).alias("lats"),
        F.array(deg(x), deg(x), deg(x + d), deg(x + d)).alias("lngs"),
    )


def _ring(low, high, west=0) -> Column:
    """A square ring from ``low`` to ``high`` off the lattice point, moved ``west``, as WKT."""
    def point(dx, dy):
        parts = []
        for v in (F.col("x") + dx - west, F.col("y") + dy):
            parts += [F.floor(v / F.lit(100000.0)), F.pmod(v, F.lit(100000))]
        return F.format_string("%d.%05d %d.%05d", *parts)

    corners = [point(low, low), point(low, high), point(high, high), point(high, low)]
    return F.concat(F.lit("("), F.concat_ws(", ", *corners, corners[0]), F.lit(")"))


def wkt_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The squares as WKT with a hole in the middle half."""
    d = F.col("d")
    quarter = (d / 4).cast("long")
    return _lattice(spark, sf).select("pid", F.concat(
        F.lit("POLYGON("), _ring(F.lit(0), d), F.lit(", "), _ring(quarter, quarter * 3), F.lit(")")).alias("wkt"))


def wkt_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The frames, each with a second square to the west, as one area; some texts are no area."""
    d = F.col("d")
    quarter = (d / 4).cast("long")
    both = F.concat(F.lit("MULTIPOLYGON ((("), F.substring(_ring(F.lit(0), d), 2, 1000), F.lit(", "),
                    _ring(quarter, quarter * 3), F.lit("), ("), _ring(F.lit(0), quarter, d * 2), F.lit("))"))
    return _lattice(spark, sf).select("pid", F.when(F.col("pid") % 13 == 0, "POINT(1 2)").otherwise(both).alias("wkt"))


# A concave five-vertex area as (lng, lat).
CONCAVE = [(103.70, 1.25), (103.72, 1.40), (103.80, 1.35), (103.90, 1.42), (103.88, 1.27)]
CENTRE = (1.335, 103.825)  # lat, lng of the single-centre searches


def map_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pings as string maps; some fields hold the word null or are malformed."""
    i = F.col("seq")
    base = map_columns(pings(spark, sf).where(F.col("latitude").isNotNull()), null_text=True)
    return base.withColumns({
        "speed": F.when(i % 53 == 0, "fast").otherwise(F.col("speed")),
        "bearing": F.when(i % 59 == 0, "").otherwise(F.col("bearing")),
        "pingtimestamp": F.when(i % 61 == 0, F.lit(None)).otherwise(F.col("pingtimestamp")),
    })


def poisoned_messages(messages: DataFrame) -> DataFrame:
    """Keyed messages of which some are cut off in the middle and some have no value."""
    half = F.substring("value", 1, 20)
    return messages.withColumn(
        "value", F.when(F.col("seq") % 67 == 0, half).when(F.col("seq") % 71 == 0, F.lit(None))
        .otherwise(F.col("value"))
    )


def concave_areas(spark: SparkSession, sf: str) -> DataFrame:
    """A notched area of seven vertices at every query point, as vertex lists."""
    def deg(c):
        return c / F.lit(100000.0)

    x, y, d = F.col("x"), F.col("y"), F.col("d")
    half, third = (d / 2).cast("long"), (d / 3).cast("long")
    corners = [(0, 0), (0, d), (third, half), (half, d), (d, d), (d, 0), (half, third)]
    return _lattice(spark, sf).select(
        "pid", F.array(*[deg(y + b) for _, b in corners]).alias("lats"),
        F.array(*[deg(x + a) for a, _ in corners]).alias("lngs"))


WRITE_URI, READ_URI = "/api/[a-z]+/update", "/api/[a-z]+/search/.*"


APPLICATION = "element_at(array('table', 'log', 'stream'), CAST({} % 3 AS int) + 1)"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a service request: nine writes to one read."""
    return events(spark, sf).selectExpr(
        "event_id AS i", "event_ms AS ts_ms", APPLICATION.format("event_id") + " AS application",
        """CASE WHEN event_id % 41 = 0 THEN 503 WHEN event_id % 59 = 0 THEN 400
           ELSE 200 END AS status""",
    ).selectExpr(
        "ts_ms", "application",
        """concat('/api/', application, '/', CASE WHEN i % 10 < 9 THEN 'update' ELSE
           concat('search/', element_at(array('range', 'knn', 'pip'), CAST(i % 7 % 3 AS int) + 1))
           END) AS uri""",
        "status",
        """CASE status WHEN 503 THEN 'SERVER_ERROR' WHEN 400 THEN 'CLIENT_ERROR'
           ELSE 'SUCCESS' END AS outcome""",
        "i * 37 % 3000 AS duration_ms",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Counter and gauge samples: one series per user, restarting now and then.

    One application reports no process gauge, so the system gauge stands in.
    """
    return events(spark, sf).selectExpr(
        "event_id AS seq", "event_ms AS ts_ms", APPLICATION.format("user_id") + " AS application",
        """CASE WHEN event_id % 2 = 0 AND user_id % 3 <> 2 THEN 'process' ELSE 'system'
           END AS metric""",
        "concat('user_', user_id) AS series",
        "CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(event_id % 1009 AS double) END AS value",
    )


SCRAPE_BOUNDS = (50, 100, 250, 500, 1000, 2500)


def scrapes(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a scrape of its application's counters: requests by class, and cumulative
    latency buckets. The counters follow the clock; the read counter restarts now and then."""
    bounds = [*map(str, SCRAPE_BOUNDS), "+Inf"]
    bucket = [f"struct('latency_bucket' AS metric, map('application', app, 'le', '{b}') AS labels, "
              + " + ".join(f"event_ms div {20000 * (j + 1)}" for j in range(i + 1)) + " AS value)"
              for i, b in enumerate(bounds)]
    count = ["struct('requests_count' AS metric, map('application', app, 'class', 'write') AS labels, "
             "event_ms div 1000 AS value)",
             "struct('requests_count' AS metric, map('class', 'read', 'application', app) AS labels, "
             "event_ms div 9000 % 40009 AS value)"]
    return events(spark, sf).selectExpr(
        "event_ms AS ts_ms", APPLICATION.format("event_id") + " AS app", "event_ms",
    ).selectExpr("ts_ms", f"explode(array({', '.join(bucket + count)})) AS s").selectExpr(
        "s.metric", "s.labels", "ts_ms", "CAST(s.value AS double) AS value")


def scrapes_in_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """The latency buckets with bounds in seconds, in several spellings of a number."""
    spelt = {"50": "0.05", "100": "0.10", "250": "0.25", "500": ".5", "1000": "1.0", "2500": "2.5"}
    names = F.create_map(*[F.lit(x) for pair in spelt.items() for x in pair])
    le = F.col("labels").getItem("le")
    return scrapes(spark, sf).where(F.col("metric") == "latency_bucket").withColumn("labels", F.create_map(
        F.lit("le"), F.coalesce(names[le], le), F.lit("application"), F.col("labels").getItem("application")))


def status_scrapes(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a scrape of its application's request counters by status; one application
    has never failed and has no such series."""
    counters = [("200", "SUCCESS", 1000), ("400", "CLIENT_ERROR", 7000), ("503", "SERVER_ERROR", 50000),
                ("500", "SERVER_ERROR", 90000)]
    made = ", ".join(f"struct(map('application', app, 'status', '{s}', 'outcome', '{o}') AS labels, event_ms div {d} AS value)"
                     for s, o, d in counters)
    return events(spark, sf).selectExpr(
        "event_ms AS ts_ms", APPLICATION.format("event_id") + " AS app", "event_ms",
    ).selectExpr("ts_ms", "app", f"explode(array({made})) AS s").where(
        "app <> 'stream' OR s.labels['outcome'] <> 'SERVER_ERROR'").selectExpr(
        "'http_requests' AS metric", "s.labels", "ts_ms", "CAST(s.value AS double) AS value")


def gauges(spark: SparkSession, sf: str) -> DataFrame:
    """The samples as gauges between 0 and 1."""
    return samples(spark, sf).withColumn("value", F.col("value") / F.lit(1009.0))
