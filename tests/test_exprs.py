import pytest
from pyspark.sql import functions as F

from millrace.functions import exprs


@pytest.fixture(scope="module")
def messages(spark):
    rows = [("m1", {"vip": "true", "n": "5", "s": '"gold"'}, (150, "EUR", [("a", 1), ("b", 3)])), ("m2", {}, (50, "USD", []))]
    return spark.createDataFrame(rows, "message_id string, headers map<string,string>, payload struct<Amount:int,Currency:string,Items:array<struct<Name:string,F:int>>>")


def results(df, text, kind=None):
    e = exprs.compile_expression(text, df, kind)
    return [(r.v, r.e) for r in df.orderBy("message_id").select(e.value.alias("v"), e.err.alias("e")).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("payload.Amount > 100", [(True, False), (False, False)]),
        ('payload.Amount > 100 && payload.Currency == "EUR"', [(True, False), (False, False)]),
        ('header("vip") == true', [(True, False), (False, False)]),
        ('header("vip") != true', [(False, False), (True, False)]),
        ('header("n") > 3', [(True, False), (None, True)]),
        ('header("s") > 3', [(None, True), (None, True)]),
        ('header("s") == "gold"', [(True, False), (False, False)]),
        ('payload.Amount > 100 || header("n") > 3', [(True, False), (None, True)]),
        ('payload.Amount < 100 || header("n") > 3', [(True, False), (True, False)]),
        ('not (payload.Amount > 100) and header("n") > 3', [(False, False), (None, True)]),
        ('payload.Amount > 100 ? "big" : "small"', [("big", False), ("small", False)]),
        ("(payload.Amount + 2) * 3 - 1", [(455, False), (155, False)]),
        ("payload.Amount / 100", [(1.5, False), (0.5, False)]),
        ("-payload.Amount % 7", [(-3, False), (-1, False)]),
        ("payload.Items[0].Name", [("a", False), (None, True)]),
        ("payload.Items[-1].Name", [("b", False), (None, True)]),
        ("payload.Items[2].Name", [(None, True), (None, True)]),
        ("payload.Amount / 0 > 1000000", [(True, False), (True, False)]),
        ("payload.Amount % 0 == 1", [(None, True), (None, True)]),
        ("payload.Amount * 9223372036854775807 > 0", [(None, True), (None, True)]),
        ("payload.Amount > 100 || payload.Amount % 0 == 1", [(True, False), (None, True)]),
        ("len([1, \"two\", true]) == 3", [(True, False), (True, False)]),
        ("len(payload.Items)", [(2, False), (0, False)]),
        ("map(filter(payload.Items, {.F > 2}), {.Name})", [(["b"], False), ([], False)]),
        ("all(payload.Items, {.F > 0})", [(True, False), (True, False)]),
        ("any(payload.Items, .F > 2)", [(True, False), (False, False)]),
        ("count(payload.Items, {.F >= 1})", [(2, False), (0, False)]),
        ("payload.Amount in [50, 60]", [(False, False), (True, False)]),
        ('payload.Currency startsWith "E"', [(True, False), (False, False)]),
        ("[1, 2]", [([1, 2], False), ([1, 2], False)]),
        ("'it\\'s'", [("it's", False), ("it's", False)]),
    ],
)
def test_values_and_errors(messages, text, want):
    assert results(messages, text) == want


@pytest.mark.parametrize("text", ["", "   ", "payload.", "payload.Nope > 1", "1 +", "(1", "foo", 'header(x) == 1', "1 2", "payload.Amount ! 3", "@"])
def test_invalid_expressions(messages, text):
    with pytest.raises(exprs.InvalidExpressionError):
        exprs.compile_expression(text, messages)


def test_kinds_are_exact(messages):
    for text, kind in (("payload.Amount", "string"), ("payload.Amount", "bigint"), ("1.5", "int"), ('"a"', "boolean"), ("payload.Amount", "array")):
        with pytest.raises(exprs.InvalidExpressionError):
            exprs.compile_expression(text, messages, kind)
    exprs.compile_expression("payload.Amount", messages, "int")
    exprs.compile_expression("payload.Items", messages, "array")


def test_depth_is_capped(messages):
    for text in ("(" * 500 + "1" + ")" * 500, "!" * 3000 + "true", "1 ? " * 300 + "1" + " : 1" * 300, "[" * 200 + "]" * 200):
        with pytest.raises(exprs.InvalidExpressionError):
            exprs.compile_expression(text, messages)
    with pytest.raises(exprs.InvalidExpressionError):
        exprs.compile_expression("99999999999999999999", messages)
    assert results(messages, "(" * 20 + "1" + ")" * 20) == [(1, False), (1, False)]


def test_elements_have_the_type_asked_for(messages):
    rows = messages.withColumns({"correlation_id": F.lit(None).cast("string"), "sequence_number": F.lit(0), "sequence_size": F.lit(0)})
    with pytest.raises(exprs.InvalidExpressionError):
        exprs.split_expr(rows, "payload.Items", "int")
    mixed = '[1, "two"]'
    assert exprs.split_expr(rows, mixed, "int").count() == 0 and exprs.split_expr_failed(rows, mixed, "int").count() == 2
    some = '[1, header("n") == 5 ? 7 : 8]'
    assert sorted(r.payload for r in exprs.split_expr(rows, some).collect()) == [1, 1, 7, 8]
    headers = '["a", header("s")]'
    got = exprs.split_expr(rows, headers, "string").collect()
    assert [(r.message_id, r.payload) for r in got] == [("m1#1", "a"), ("m1#2", "gold")]
    assert [r.message_id for r in exprs.split_expr_failed(rows, headers, "string").collect()] == ["m2"]


def test_errors_of_routes_and_splits_stay_with_their_message(messages):
    got = exprs.route_expr(messages, 'header("n") > 3 ? "a" : "b"', {"a": "one"}, "rest")
    assert {r.message_id: (r.channel, r.err) for r in got.collect()} == {"m1": ("one", False), "m2": (None, True)}
    rows = messages.withColumns({"correlation_id": F.lit(None).cast("string"), "sequence_number": F.lit(0), "sequence_size": F.lit(0)})
    assert [r.message_id for r in exprs.split_expr_failed(rows, "[payload.Items[0].F]").collect()] == ["m2"]


def test_size_is_capped(messages):
    with pytest.raises(exprs.InvalidExpressionError):
        exprs.compile_expression("1" + " + 1" * 6000, messages)


def test_group_environment(spark):
    df = spark.createDataFrame([([({"p": "7"}, (3,)), ({}, (4,))], None)], "messages array<struct<headers:map<string,string>,payload:struct<Amount:int>>>, size int")
    assert results(df.withColumn("message_id", F.lit("x")), 'len(messages) >= 2 && messages[0].header("p") > 5') == [(True, False)]
    assert results(df.withColumn("message_id", F.lit("x")), "size == 0 && all(messages, {.payload.Amount > 2})") == [(True, False)]


def test_filter_keeps_errors_apart(messages):
    passed, rejected, failed = exprs.filter_expr(messages, 'header("n") > 3')
    assert [x.count() for x in (passed, rejected, failed)] == [1, 0, 1]


def test_router_and_split(messages):
    got = exprs.route_expr(messages, "payload.Currency", {"EUR": "euro"}, "rest")
    assert {r.message_id: r.channel for r in got.collect()} == {"m1": "euro", "m2": "rest"}
    children = exprs.split_expr(messages.withColumns({"correlation_id": F.lit(None).cast("string"), "sequence_number": F.lit(0), "sequence_size": F.lit(0)}), "payload.Items")
    assert [r.message_id for r in children.collect()] == ["m1#1", "m1#2"]
