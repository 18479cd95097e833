"""The message envelope: one row a message, reserved headers as columns, other headers as a map.

A header's value is its JSON text, so its type is never guessed: ``5`` is a number, ``"5"`` a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = ("message-id", "timestamp", "content-type", "correlation-id", "delivery-count", "sequence-number", "sequence-size")
#: Headers that are integers again after a round trip through JSON; any other number becomes a double.
INTEGER_HEADERS = ("delivery-count", "sequence-number", "sequence-size")
HEADERS = "map<string,string>"


def new(df: DataFrame, payload: Column, message_id: Column, ts: Column, headers: Column | None = None, correlation_id: Column | None = None, content_type: str = "application/json") -> DataFrame:
    """Messages from rows. Id and time are stamped over headers of the same name, as for any new message."""
    own = headers if headers is not None else F.expr(f"cast(map() as {HEADERS})")
    correlation = correlation_id if correlation_id is not None else F.lit(None)
    return df.select(
        message_id.cast("string").alias("message_id"), ts.alias("ts"), F.lit(content_type).alias("content_type"), correlation.cast("string").alias("correlation_id"),
        F.lit(None).cast("int").alias("delivery_count"), F.lit(None).cast("int").alias("sequence_number"), F.lit(None).cast("int").alias("sequence_size"),
        without_headers(own, ["message-id", "timestamp"]).alias("headers"), payload.alias("payload"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as messages."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    payload = F.struct(F.col("event_type").alias("type"), F.col("value"))
    return new(df, payload, F.col("event_id"), F.col("ts"), json_map(F.col("props")), F.col("user_id"))


def json_text(value: Column) -> Column:
    """A value as JSON text, ``null`` for none."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def json_map(text: Column) -> Column:
    """The fields of a JSON object as JSON texts, whatever their types; null where it is no object.

    The text is parsed once; what isn't JSON gives null as well.
    """
    return F.transform_values(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def random_id() -> Column:
    """An id for a message that has none: 32 random hex digits."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


def header(headers: Column, key: str) -> Column:
    """A header's JSON text, null if missing."""
    return F.try_element_at(headers, F.lit(key))


def header_string(headers: Column, key: str) -> Column:
    """A header that is a string; null if missing or of another type."""
    raw = header(headers, key)
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])


def header_int(headers: Column, key: str) -> Column:
    """A header that is an integer; no other type is converted."""
    raw = header(headers, key)
    return F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("bigint"))


def header_time(headers: Column, key: str) -> Column:
    """A header that is an RFC 3339 time, in microseconds; finer digits are cut."""
    return F.try_to_timestamp(header_string(headers, key))


def with_header(headers: Column, key: str, value: Column) -> Column:
    """The headers with one more; a null value is the JSON null."""
    return F.map_concat(without_headers(headers, [key]), F.create_map(F.lit(key), json_text(value)))


def without_headers(headers: Column, keys: list[str]) -> Column:
    return F.map_filter(headers, lambda k, _: ~k.isin(keys))


def all_headers(df: DataFrame) -> DataFrame:
    """A row for each header of each message."""
    return df.select("message_id", F.explode("headers").alias("key", "value"))


def with_payload(df: DataFrame, payload: Column) -> DataFrame:
    """Another payload, all headers kept."""
    return df.withColumn("payload", payload)


def encode_headers(df: DataFrame) -> Column:
    """All headers of a message, reserved ones too, as one JSON object with sorted keys; nanoseconds of a
    time that microseconds can't hold are lost before."""
    time = F.regexp_replace(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    time = F.concat(F.when(F.date_format("ts", "SSSSSS") == "000000", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(time), F.lit("Z"))
    present = lambda c: (c.isNotNull() & (c.cast("string") != ""))
    values = {
        "message-id": F.col("message_id"), "timestamp": time, "content-type": F.col("content_type"), "correlation-id": F.col("correlation_id"),
        "delivery-count": F.col("delivery_count"), "sequence-number": F.col("sequence_number"), "sequence-size": F.col("sequence_size"),
    }
    reserved = F.array_compact(F.array(*[F.when(present(v), F.struct(F.lit(k).alias("key"), json_text(v).alias("value"))) for k, v in values.items()]))
    own = F.map_entries(without_headers(F.coalesce("headers", F.expr(f"cast(map() as {HEADERS})")), list(RESERVED)))
    entries = F.array_sort(F.concat(own, reserved))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}"))


def decode_headers(df: DataFrame, column: str = "headers_json") -> DataFrame:
    """Columns of the reserved headers and a map of the others as JSON texts; ``decode_error`` where the text
    is no JSON object.

    The text is parsed once. Reserved headers of another type than their own are null; of the others numbers
    stay numbers and strings strings. Whole numbers come back as integers only for the integer headers, with
    their fraction cut.
    """
    missing = F.col(column).isNull() | (F.col(column) == "")
    parsed = unused_name(df, "parsed")
    df = df.withColumn(parsed, F.when(missing, F.expr(f"cast(map() as {HEADERS})")).otherwise(json_map(F.col(column))))
    h = F.col(parsed)
    whole = lambda key: F.try_element_at(h, F.lit(key)).try_cast("double").cast("int")
    found = {
        "decode_error": h.isNull(),
        "message_id": header_string(h, "message-id"), "ts": header_time(h, "timestamp"), "content_type": header_string(h, "content-type"), "correlation_id": header_string(h, "correlation-id"),
        **{k.replace("-", "_"): whole(k) for k in INTEGER_HEADERS},
        "headers": without_headers(h, list(RESERVED)),
    }
    return df.withColumns(found).drop(parsed)


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name
