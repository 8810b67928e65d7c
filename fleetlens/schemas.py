"""Record layouts. They are declared once and never inferred."""

from pyspark.sql import types as T


def _struct(*groups: tuple[T.DataType, str]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for t, names in groups for n in names.split()])


_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

TRACE = _struct(
    (_TEXT, "trj_id driving_mode osname"), (_LONG, "pingtimestamp"),
    (_DOUBLE, "rawlat rawlng speed bearing accuracy"),
)

PING = _struct(
    (_LONG, "seq"), (_TEXT, "user_id service_type"),
    (_DOUBLE, "latitude longitude heading speed accuracy"), (_TEXT, "status"),
    (_LONG, "ts_ms ingest_ms"),
)

# Field names of a ping as JSON, and the columns they become.
PING_JSON = {
    "userId": "user_id",
    "serviceType": "service_type",
    "latitude": "latitude",
    "longitude": "longitude",
    "heading": "heading",
    "speed": "speed",
    "accuracy": "accuracy",
    "status": "status",
    "timestamp": "ts_ms",
}

POSITION = _struct(
    (_TEXT, "user_id"), (_DOUBLE, "lat lng speed accuracy"), (_TEXT, "service_type"),
    (_LONG, "ts_ms updated_ms seq"),
)

# Columns and field names of the string-map record; every field is text until
# it is decoded.
MAP_FIELDS = {
    "trj_id": "trj_id", "driving_mode": "driving_mode", "pingtimestamp": "pingtimestamp",
    "rawlat": "rawlat", "rawlng": "rawlng", "speed": "speed", "bearing": "bearing",
    "accuracy": "accuracy", "location": "location", "cell": "h3_index",
}

# A scraped sample: a counter's or gauge's value at a time, told apart by its labels.
SAMPLE = T.StructType([
    T.StructField("metric", _TEXT), T.StructField("labels", T.MapType(_TEXT, _TEXT)),
    T.StructField("ts_ms", _LONG), T.StructField("value", _DOUBLE),
])

# A message as it lies in a topic: the key decides the partition, seq the order.
TOPIC = _struct((_TEXT, "key value"), (_LONG, "seq ingest_ms"))

# What the driving modes of a trace become; pings may name any other service type.
SERVICE_TYPES = ("TAXI", "BIKE", "UNKNOWN")
