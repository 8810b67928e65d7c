"""Scalar rules for raw trace rows and pings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.schemas import PING_JSON

MS_TO_KMH = 3.6
ON_TASK = "ON_TASK"
STATUS_TTL_MS = 30 * 60 * 1000


def service_type(mode: Column) -> Column:
    """car is a taxi, motorcycle a bike in any letter case, anything else unknown."""
    name = F.lower(F.coalesce(mode, F.lit("")))
    return F.when(name == "car", "TAXI").when(name == "motorcycle", "BIKE").otherwise("UNKNOWN")


def service_type_binary(mode: Column) -> Column:
    """The two-way rule of the load scripts: exactly ``car``, or a bike."""
    return F.when(mode == "car", "TAXI").otherwise("BIKE")


def number_or(text: Column, default: float) -> Column:
    """Text to double; missing, empty or malformed text gives ``default``."""
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("double"), F.lit(default))


def clean_id(user_id: Column) -> Column:
    """Keep ASCII letters, digits and the underscore. Distinct ids may become equal."""
    return F.regexp_replace(user_id, "[^a-zA-Z0-9_]", "")


def quality_score(accuracy: Column) -> Column:
    """GPS error in metres to a 0..100 score, falling faster as the error grows."""
    a = accuracy
    score = (
        F.when(a.isNull(), 0.0)
        .when(a < 0, 100.0)
        .when(a <= 5, F.lit(100.0) - a * F.lit(2.0))
        .when(a <= 20, F.lit(90.0) - (a - F.lit(5.0)) * F.lit(2.67))
        .when(a <= 50, F.lit(50.0) - (a - F.lit(20.0)) * F.lit(1.67))
        .otherwise(0.0)
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def quality_percent(accuracy: Column) -> Column:
    return F.format_string("%.0f%%", quality_score(accuracy))


def lng_lat_text(lng: Column, lat: Column) -> Column:
    return F.concat(lng.cast("string"), F.lit(","), lat.cast("string"))


def text_or_null_word(value: Column, null_text: bool) -> Column:
    """Number to text; a null becomes the word ``null`` if ``null_text`` is set."""
    text = value.cast("string")
    return F.coalesce(text, F.lit("null")) if null_text else text


def lag_ms(ts_ms: Column, ingest_ms: Column) -> Column:
    """Age of a ping on arrival; null without a usable time stamp."""
    return F.when(ts_ms > 0, ingest_ms - ts_ms)


def document() -> Column:
    """A ping as a struct under the field names of its JSON form."""
    return F.struct(*[F.col(column).alias(field) for field, column in PING_JSON.items()])
