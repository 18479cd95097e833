"""HTTP and event-stream codecs as column expressions: requests, responses, errors, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BODY = 1 << 20
DEFAULT_TYPE = "application/octet-stream"
RESERVED_PREFIX = "mr-"


def decode_request(df: DataFrame, allowed: list[str], most: int = MAX_BODY, trusted: Column | None = None) -> DataFrame:
    """Messages of requests ``(message_id, method, path, query, body, request_headers, advisory_id)``.

    Only allow-listed headers outside the reserved prefix are taken. The correlation id is that of a trusted
    resolver, else the message id; what the client claims is kept apart. Too large a body is an error.
    """
    kept = F.map_filter("request_headers", lambda k, _: F.lower(k).isin([a.lower() for a in allowed]) & ~F.lower(k).startswith(RESERVED_PREFIX))
    own = F.map_from_arrays(F.array(*[F.lit(f"http.{k}") for k in ("method", "path", "query")]), F.array("method", "path", "query"))
    return df.select(
        "message_id", F.coalesce(trusted if trusted is not None else F.lit(None), F.col("message_id")).alias("correlation_id"), F.col("advisory_id").alias("http_correlation_id"),
        F.map_concat(kept, own).alias("headers"), F.col("body").alias("payload"), F.when(F.octet_length("body") > most, "too_large").alias("error"),
    )


def encode_request(headers: Column, allowed: list[str]) -> Column:
    """The headers that leave with a request."""
    return F.map_filter(headers, lambda k, _: k.isin(allowed) & ~F.lower(k).startswith(RESERVED_PREFIX))


def content_type(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(DEFAULT_TYPE))


#: What a request's headers say of the request alone; its advisory correlation id stays with the flow.
OF_REQUEST = ("message-id", "timestamp", "content-type", "http.method", "http.path", "http.query", "http.content-type")


def build_reply(request_headers: Column, reply_headers: Column, allowed: list[str], remote_type: Column | None = None) -> Column:
    """A reply's headers: the request's without what describes the request, then what is allowed of the
    reply's, without line breaks and never under the reserved prefix, then the remote content type as a fact."""
    base = F.map_filter(request_headers, lambda k, _: ~k.isin(*OF_REQUEST))
    more = F.map_filter(reply_headers, lambda k, v: k.isin(allowed) & ~F.lower(k).startswith(RESERVED_PREFIX) & (F.coalesce(v, F.lit("")) != ""))
    more = F.transform_values(more, lambda _, v: sanitize(v))
    if remote_type is not None:
        named = F.create_map(F.lit("http.content-type"), sanitize(remote_type))
        more = F.map_concat(F.map_filter(more, lambda k, _: k != "http.content-type"), F.when(F.coalesce(remote_type, F.lit("")) != "", named).otherwise(F.map_filter(named, lambda k, _: F.lit(False))))
    return F.map_concat(F.map_filter(base, lambda k, _: F.try_element_at(more, k).isNull()), more)


def error_status(error: Column) -> Column:
    """The status of an error kind. What isn't known here, none at all included, is the server's fault, and so
    are a missing correlation and a payload that can't be written."""
    known = {"timeout": 504, "closed": 503, "duplicate": 409, "too_large": 413, "decode": 400}
    status = F.when(error.isNull(), 500)
    for kind, code in known.items():
        status = status.when(error == kind, code)
    return status.otherwise(500)


def respond(df: DataFrame, result: Column, payload: Column, kind: Column, asynchronous: bool = False) -> DataFrame:
    """Add ``status``, ``body`` and ``content_type`` of the response to every request by the result of its
    exchange: a reply is 200 with its payload, a request that nobody waits for 202 without one, anything else
    the status of its error. A reply that is no text or bytes can't be written and is the server's fault."""
    kinds = dict(df.select(payload.alias("p")).dtypes)["p"] in ("string", "binary", "void")
    if asynchronous:
        status = F.when(result.isNull(), 202).otherwise(error_status(result))
        return df.withColumns({"status": status.cast("int"), "body": F.lit(None).cast("string"), "content_type": F.lit(None).cast("string")})
    ok = result == "replied"
    status = F.when(ok, 200 if kinds else 500).otherwise(error_status(result)).cast("int")
    told = ok & F.lit(kinds)
    return df.withColumns({"status": status, "body": F.when(told, payload.cast("string")), "content_type": F.when(told, content_type(kind))})


MAX_RETRY_AFTER = ((1 << 63) - 1) // 1_000_000_000
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_DAY, _MONTH, _CLOCK = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "(" + "|".join(MONTHS) + ")", r"(\d{2}:\d{2}:\d{2})"
#: The three forms of an HTTP date, and which groups are day, month, year and time.
DATE_FORMS = (
    (rf"^{_DAY}, (\d{{2}}) {_MONTH} (\d{{4}}) {_CLOCK} GMT$", (1, 2, 3, 4)),
    (rf"^(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day, (\d{{2}})-{_MONTH}-(\d{{2}}) {_CLOCK} [A-Z]{{3}}$", (1, 2, 3, 4)),
    (rf"^{_DAY} {_MONTH} ([ \d]\d) {_CLOCK} (\d{{4}})$", (2, 1, 4, 3)),
)


def http_date(value: Column) -> Column:
    """The time of an HTTP date in any of its three forms; null if it is none. Of years of two digits those
    from 69 on are of the last century."""
    found = None
    for pattern, (day, month, year, clock) in DATE_FORMS:
        part = lambda i, pattern=pattern: F.regexp_extract(value, pattern, i)
        number = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), part(month)).cast("string"), 2, "0")
        whole = F.when(F.length(part(year)) == 4, part(year)).otherwise(F.concat(F.when(part(year) >= "69", "19").otherwise("20"), part(year)))
        text = F.concat(whole, F.lit("-"), number, F.lit("-"), F.lpad(F.trim(part(day)), 2, "0"), F.lit(" "), part(clock))
        one = F.when(value.rlike(pattern), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
        found = one if found is None else F.coalesce(found, one)
    return found


def retry_after_seconds(value: Column, now: Column) -> Column:
    """A Retry-After header: whole seconds, or an HTTP date (a past one is 0); null if it is neither, negative
    or longer than 64 bits of nanoseconds."""
    text = F.trim(value)
    seconds = F.when(text.rlike(r"^\+?\d+$"), F.ltrim(text, F.lit("+")).try_cast("bigint"))
    date = http_date(text)
    wait = (F.unix_micros(date) - F.unix_micros(now.cast("timestamp"))) / 1_000_000
    return F.coalesce(F.when(seconds <= MAX_RETRY_AFTER, seconds.cast("double")), F.when(date.isNotNull(), F.greatest(wait, F.lit(0.0))))


def classify_response(status: Column, retry_after: Column) -> Column:
    """What a response means for its request: null, ``permanent``, ``retry_after`` or ``transient``."""
    return (
        F.when(status.between(200, 299), None)
        .when((status < 500) & ~status.isin(408, 429), "permanent")
        .when(status.isin(429, 503) & retry_after.isNotNull(), "retry_after")
        .otherwise("transient")
    )


def sanitize(value: Column) -> Column:
    """A header value without line breaks."""
    return F.translate(value, "\r\n", "")


def excerpt(body: Column, most: int = 256) -> Column:
    """The start of a body as a quoted string, for error texts."""
    cut = F.make_valid_utf8(F.substring(body.cast("binary"), 1, most).cast("string"))
    return F.regexp_extract(F.to_json(F.struct(cut.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def redact_url(url: Column) -> Column:
    """A URL without all that may be secret: scheme and host only."""
    return F.regexp_replace(url, r"(?i)^(https?://)(?:[^/?#@\s]*@)?([^/?#\s]+).*$", "$1$2")


def valid_url(url: Column) -> Column:
    """Whether a URL is http(s) and has a host."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def valid_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def quote_identifier(name: Column, quote: str = '"') -> Column:
    return F.concat(F.lit(quote), F.replace(name, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def sse_frame(event_id: Column, name: Column, data: Column) -> Column:
    """An event-stream frame; null where id or name has a line break or NUL."""
    bad = F.coalesce(event_id.rlike("[\r\n\x00]"), F.lit(False)) | F.coalesce(name.rlike("[\r\n\x00]"), F.lit(False))
    line = lambda key, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{key}: "), v, F.lit("\n"))).otherwise("")
    lines = F.transform(F.split(F.regexp_replace(data, "\r\n?", "\n"), "\n"), lambda x: F.concat(F.lit("data: "), x, F.lit("\n")))
    return F.when(~bad, F.concat(line("id", event_id), line("event", name), F.array_join(lines, ""), F.lit("\n")))


def replay_ring(events: DataFrame, stream: str, seq: str, most: int) -> DataFrame:
    """The last ``most`` events of each stream."""
    rank = F.row_number().over(Window.partitionBy(stream).orderBy(F.desc(seq)))
    return events.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def replay_after(ring: DataFrame, clients: DataFrame, stream: str, seq: str, event_id: str) -> DataFrame:
    """What each client ``(client, stream, last_id)`` has missed: all after the last event with its id;
    nothing if the ring doesn't have that id."""
    c = clients.withColumnRenamed(stream, "_stream")
    at = ring.join(c, (F.col(stream) == F.col("_stream")) & (F.col(event_id) == F.col("last_id")))
    at = at.groupBy("client", F.col("_stream")).agg(F.max(seq).alias("_from"))
    return ring.join(at, (F.col(stream) == F.col("_stream")) & (F.col(seq) > F.col("_from"))).drop("_stream", "_from")
