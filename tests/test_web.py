import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import http
from millrace.sources import cron, sse


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("data: a\n\n", [("", "message", "a", None, None)]),
        ("\ufeffdata:a\r\rdata: b\r\n\r\n", [("", "message", "a", None, None), ("", "message", "b", None, None)]),
        (": note\nid: 7\nevent: x\nretry: 10\ndata: a\ndata: b\n\ndata\n\n", [("7", "x", "a\nb", 10, None), ("7", "message", "", 10, None)]),
        ("event: x\n\nid: 1\0\nretry: 1x\ndata:  a\n\n", [("", "message", " a", None, None)]),
        ("data: cut", []),
        ("data: cut\n", []),
        ("", []),
    ],
)
def test_sse_parser(text, want):
    assert list(sse.parse(text)) == want


def test_sse_cap():
    assert list(sse.parse("data: ok\n\ndata: " + "x" * 50 + "\n\ndata: z\n\n", 40)) == [("", "message", "ok", None, None), ("", "message", "", None, "too_large")]


@given(st.text(max_size=200))
def test_sse_parser_takes_anything(text):
    for event in sse.parse(text):
        assert event[4] is None and "\r" not in event[2]


def test_sse_frames(spark):
    df = spark.createDataFrame([("1", "n", "a\r\nb"), ("1\n", "n", "a"), (None, None, "")], "id string, name string, data string")
    got = [r.f for r in df.select(http.sse_frame(F.col("id"), F.col("name"), F.col("data")).alias("f")).collect()]
    assert got == ["id: 1\nevent: n\ndata: a\ndata: b\n\n", None, "data: \n\n"]


def test_retry_after_and_classes(spark):
    now = F.lit("1994-11-06 08:49:00").cast("timestamp")
    df = spark.createDataFrame([("0",), (" 12 ",), ("-1",), ("Sun, 06 Nov 1994 08:49:37 GMT",), ("Sun, 06 Nov 1994 08:00:00 GMT",), ("x",), (None,)], "v string")
    assert [r.s for r in df.select(http.retry_after_seconds(F.col("v"), now).alias("s")).collect()] == [0.0, 12.0, None, 37.0, 0.0, None, None]


def test_reply_headers_and_urls(spark):
    df = spark.createDataFrame([("http://a/b",), ("HTTPS://x",), ("ftp://a",), ("http:///p",), (None,)], "u string")
    assert [r.v for r in df.select(http.valid_url(F.col("u")).alias("v")).collect()] == [True, True, False, False, False]
    assert spark.range(1).select(http.sanitize(F.lit("a\r\nb")).alias("v")).first().v == "ab"


def fires(spark, spec, start, end, **kw):
    return [str(r.fire_ts) for r in cron.fires(spark, cron.parse(spec, **kw), start, end).orderBy("fire_ts").collect()]


def test_cron(spark):
    assert fires(spark, "0 9 * * mon", "2024-01-01 00:00:00", "2024-01-09 00:00:00") == ["2024-01-01 09:00:00", "2024-01-08 09:00:00"]
    assert fires(spark, "0 0 13 * fri", "2024-09-10 00:00:00", "2024-09-21 00:00:00") == ["2024-09-13 00:00:00", "2024-09-20 00:00:00"]
    assert fires(spark, "@monthly", "2024-01-01 00:00:00", "2024-03-01 00:00:00") == ["2024-02-01 00:00:00", "2024-03-01 00:00:00"]
    assert fires(spark, "@every 40m", "2024-01-01 00:00:00", "2024-01-01 01:30:00") == ["2024-01-01 00:40:00", "2024-01-01 01:20:00"]
    assert fires(spark, "*/30 59 23 31 12 *", "2024-12-31 00:00:00", "2025-01-01 00:00:00", with_seconds=True) == ["2024-12-31 23:59:00", "2024-12-31 23:59:30"]


@pytest.mark.parametrize("spec", ["", "* * * *", "61 * * * *", "@never", "@every 0s", "@every x", "0 0 30 feb *", "a * * * *", "5-1 * * * *", "*/0 * * * *"])
def test_bad_schedules(spec):
    with pytest.raises(cron.InvalidScheduleError):
        cron.parse(spec)


def test_gates(spark):
    with pytest.raises(cron.InvalidScheduleError):
        cron.validate_gates(cron.parse("@hourly"), True, True)
    with pytest.raises(cron.InvalidScheduleError):
        cron.validate_gates(cron.parse("@every 1h"), True, False)
    claims = spark.createDataFrame([("s", "a", 0, 1), ("s", "b", 10, 2), ("s", "a", 20, 3), ("s", "b", 60, 4)], "scope string, holder string, at long, id long")
    assert [r.leader for r in cron.elect(claims, "at", ["at"], 30).orderBy("id").collect()] == [True, False, True, True]
