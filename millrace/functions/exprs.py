"""A small expression language over messages, compiled to Spark columns.

Names: ``payload`` (fields by dot), ``header("key")``, ``messages`` and ``size`` over a group. Operators:
``?:  || or  && and  == != < <= > >= in contains startsWith endsWith  + -  * / %  ! not -``, indexing from
0, array literals, ``len filter map all any none count`` with ``{...}`` predicates in which ``.F`` is a field
of the element and ``#`` the element.

Each expression gives a value and an error. An error belongs to its message and never stops the others:
comparing a missing or differently typed header by order, an index out of range (negative ones count from the
end), a remainder by zero, an overflow of whole numbers. Equality with a missing header is plainly false, and
a division by zero is infinite. A header's value is JSON text (see ``millrace.envelope``). An array literal of
mixed types holds variants.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException

MAX_NODES, MAX_DEPTH = 10_000, 64
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%<>!?:.,()\[\]{}#]))""")
_BINARY = [({"||", "or"},), ({"&&", "and"},), ({"==", "!=", "<", "<=", ">", ">=", "in", "contains", "startsWith", "endsWith"},), ({"+", "-"},), ({"*", "/", "%"},)]


class InvalidExpressionError(ValueError):
    """An expression that can't be read, or that has the wrong type."""


@dataclass
class Node:
    """A compiled part: its value, whether it failed, and whether it is a header's JSON text."""

    value: Column
    err: Column | None = None
    header: bool = False
    kind: str | None = None


def _errs(*nodes: Node) -> Column | None:
    found = None
    for n in nodes:
        if n.err is not None:
            found = n.err if found is None else found | n.err
    return found


def _typed(n: Node, like: Node) -> Node:
    """A header as the type of what it is compared with; null where it has another type."""
    if not n.header:
        return n
    raw = n.value
    if like.kind == "str":
        v = F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])
    elif like.kind == "bool":
        v = F.when(raw.isin("true", "false"), raw == "true")
    else:
        v = F.when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), raw.try_cast("double"))
    return Node(v, n.err, False, like.kind)


class _Parser:
    def __init__(self, text: str, env: dict[str, Column] | None = None) -> None:
        self.env = env or {}
        self.depth = 0
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise InvalidExpressionError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.nodes, self.elements = 0, 0, []

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, value: str | None = None) -> tuple[str | None, str]:
        kind, v = self.peek()
        if kind is None or value is not None and (v != value or kind == "str"):
            raise InvalidExpressionError(f"expected {value or 'more'}, found {v or 'the end'}")
        self.at += 1
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise InvalidExpressionError("the expression is too large")
        return kind, v

    def is_op(self, *values: str) -> bool:
        kind, v = self.peek()
        return kind in ("op", "name") and v in values

    def whole(self) -> Node:
        node = self.ternary()
        if self.peek()[0] is not None:
            raise InvalidExpressionError(f"unexpected {self.peek()[1]!r}")
        return node

    def deeper(self, by: int) -> None:
        self.depth += by
        if self.depth > MAX_DEPTH:
            raise InvalidExpressionError("the expression is nested too deeply")

    def ternary(self) -> Node:
        self.deeper(1)
        node = self.choice()
        self.deeper(-1)
        return node

    def choice(self) -> Node:
        test = self.binary(0)
        if not self.is_op("?"):
            return test
        self.take("?")
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        truth = F.coalesce(test.value, F.lit(False))
        chosen = F.when(truth, yes.err if yes.err is not None else F.lit(False)).otherwise(no.err if no.err is not None else F.lit(False))
        err = chosen if test.err is None else test.err | chosen
        return Node(F.when(truth, yes.value).otherwise(no.value), err if _errs(test, yes, no) is not None else None, kind=yes.kind)

    def binary(self, level: int) -> Node:
        if level == len(_BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while self.is_op(*_BINARY[level][0]):
            op = self.take()[1]
            right = self.binary(level + 1)
            left = self.combine(op, left, right)
        return left

    def combine(self, op: str, a: Node, b: Node) -> Node:
        if op in ("||", "or", "&&", "and"):
            stop = a.value if op in ("||", "or") else ~a.value
            # the right side isn't looked at where the left one decides
            err = a.err
            if b.err is not None:
                later = ~F.coalesce(stop, F.lit(False)) & b.err
                err = later if err is None else err | later
            return Node(a.value | b.value if op in ("||", "or") else a.value & b.value, err, kind="bool")
        missing = a.header or b.header
        a, b = _typed(a, b), _typed(b, a)
        if op in ("==", "!="):
            same = a.value.eqNullSafe(b.value)
            return Node(same if op == "==" else ~same, _errs(a, b), kind="bool")
        err = _errs(a, b)
        if missing:
            gone = a.value.isNull() | b.value.isNull()
            err = gone if err is None else err | gone
        if op in ("<", "<=", ">", ">="):
            v = {"<": a.value < b.value, "<=": a.value <= b.value, ">": a.value > b.value, ">=": a.value >= b.value}[op]
            return Node(v, err, kind="bool")
        if op == "in":
            return Node(F.array_contains(b.value, a.value), err, kind="bool")
        if op in ("contains", "startsWith", "endsWith"):
            return Node({"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](a.value, b.value), err, kind="bool")
        if op == "+" and "str" in (a.kind, b.kind):
            return Node(F.concat(a.value, b.value), err, kind="str")
        if op == "/":
            x, y = a.value.cast("double"), b.value.cast("double")
            beyond = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
            return Node(F.when(x.isNull() | y.isNull(), None).when(y == 0, beyond).otherwise(F.try_divide(x, y)), err, kind="num")
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](a.value, b.value)
        # none of them gives null for two numbers but where it fails
        failed = made.isNull() & a.value.isNotNull() & b.value.isNotNull()
        return Node(made, failed if err is None else err | failed, kind="num")

    def unary(self) -> Node:
        if not self.is_op("!", "not", "-"):
            return self.postfix(self.primary())
        op = self.take()[1]
        self.deeper(1)
        n = self.unary()
        self.deeper(-1)
        if op != "-":
            return Node(~n.value, n.err, kind="bool")
        made = F.try_subtract(F.lit(0), n.value)
        failed = made.isNull() & n.value.isNotNull()
        return Node(made, failed if n.err is None else n.err | failed, kind="num")

    def postfix(self, n: Node) -> Node:
        while self.is_op(".", "["):
            if self.take()[1] == ".":
                name = self.take()[1]
                n = self.header_of(n) if name == "header" and self.is_op("(") else Node(n.value.getField(name), n.err)
            else:
                at = self.ternary()
                self.take("]")
                n = self.indexed(n, at)
        return n

    def indexed(self, n: Node, at: Node) -> Node:
        """An element of an array, from the end if the index is negative; out of range is an error."""
        if at.kind == "str":
            return Node(F.try_element_at(n.value, at.value), _errs(n, at))
        size = F.size(n.value)
        outside = n.value.isNull() | at.value.isNull() | (at.value >= size) | (at.value < -size)
        err = _errs(n, at)
        place = F.when(at.value < 0, size + at.value).otherwise(at.value).cast("int")
        return Node(F.get(n.value, place), outside if err is None else err | outside)

    def header_of(self, of: Node) -> Node:
        self.take("(")
        kind, key = self.take()
        if kind != "str":
            raise InvalidExpressionError("header() takes a literal key")
        self.take(")")
        return Node(F.try_element_at(of.value.getField("headers"), F.lit(_text(key))), of.err, True)

    def primary(self) -> Node:
        kind, v = self.take()
        if kind == "num":
            if "." not in v and int(v) >= 1 << 63:
                raise InvalidExpressionError(f"{v} is too large")
            return Node(F.lit(float(v)) if "." in v else F.lit(int(v)), kind="num")
        if kind == "str":
            return Node(F.lit(_text(v)), kind="str")
        if v == "(":
            n = self.ternary()
            self.take(")")
            return n
        if v == "[":
            items = []
            while not self.is_op("]"):
                items.append(self.ternary())
                if not self.is_op("]"):
                    self.take(",")
            self.take("]")
            mixed = len({i.kind for i in items}) > 1 or any(i.header for i in items)
            return Node(F.array(*[F.parse_json(_json(i)) if mixed else i.value for i in items]), _errs(*items), kind="mixed" if mixed else None)
        if v in (".", "#") and self.elements:
            one = Node(self.elements[-1])
            if v == "#":
                return one
            name = self.take()[1]
            return self.header_of(one) if name == "header" and self.is_op("(") else Node(one.value.getField(name))
        if kind == "name":
            return self.named(v)
        raise InvalidExpressionError(f"unexpected {v!r}")

    def named(self, name: str) -> Node:
        if name in ("true", "false"):
            return Node(F.lit(name == "true"), kind="bool")
        if name in ("nil", "null"):
            return Node(F.lit(None))
        if name == "header" and self.is_op("("):
            self.take("(")
            kind, key = self.take()
            if kind != "str":
                raise InvalidExpressionError("header() takes a literal key")
            self.take(")")
            return Node(F.try_element_at(F.col("headers"), F.lit(_text(key))), None, True)
        if name == "size":
            return Node(self.env.get("size", F.coalesce(F.col("size"), F.lit(0))), kind="num")
        if name in ("payload", "messages"):
            return Node(self.env.get(name, F.col(name)))
        if name == "len":
            self.take("(")
            n = self.ternary()
            self.take(")")
            return Node(F.char_length(n.value) if n.kind == "str" else F.size(n.value), n.err, kind="num")
        if name in ("filter", "map", "all", "any", "none", "count"):
            return self.over(name)
        raise InvalidExpressionError(f"unknown name {name!r}")

    def over(self, name: str) -> Node:
        self.take("(")
        array = self.ternary()
        self.take(",")
        braced = self.is_op("{")
        if braced:
            self.take("{")
        start = self.at
        end: list[int] = []

        def body(x: Column) -> Column:
            self.at = start
            self.elements.append(x)
            n = self.ternary()
            self.elements.pop()
            end.append(self.at)
            # inside a predicate an error makes the element fail
            return n.value if n.err is None or name == "map" else n.value & ~n.err

        made = {"filter": F.filter, "map": F.transform, "all": F.forall, "any": F.exists, "none": F.exists, "count": F.filter}[name](array.value, body)
        self.at = end[-1]
        if braced:
            self.take("}")
        self.take(")")
        if name == "none":
            return Node(~made, array.err, kind="bool")
        if name == "count":
            return Node(F.size(made), array.err, kind="num")
        return Node(made, array.err, kind="bool" if name in ("all", "any") else None)


def _json(n: Node) -> Column:
    """A value as JSON text; a header is that already."""
    from millrace.envelope import json_text

    return n.value if n.header else json_text(n.value)


def _text(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), token[1:-1])


@dataclass
class Expression:
    """The value of an expression (null where it failed), whether it failed, and the value as written, whose
    conjuncts the optimizer can push down."""

    value: Column
    err: Column
    plain: Column


def _parsed(text: str, env: dict[str, Column] | None = None) -> Node:
    if not text or not text.strip():
        raise InvalidExpressionError("the expression is blank")
    return _Parser(text, env).whole()


def compile_expression(text: str, df: DataFrame, kind: str | None = None) -> Expression:
    """Compile for messages with the schema of ``df``; ``kind`` is the Spark type that the value must have
    exactly (``boolean``, ``string``, ``array`` for any array, ...)."""
    node = _parsed(text)
    err = node.err if node.err is not None else F.lit(False)
    value = node.value
    try:
        found = df.select(value.alias("v"), err.alias("e")).schema["v"].dataType
    except AnalysisException as e:
        raise InvalidExpressionError(str(e).split("\n")[0]) from e
    except Py4JJavaError as e:
        raise InvalidExpressionError(f"the expression can't be planned: {e.java_exception.getClass().getName()}") from e
    right = isinstance(found, T.ArrayType) if kind == "array" else kind is None or found.simpleString() == kind
    if not right:
        raise InvalidExpressionError(f"{text!r} is {found.simpleString()}, not {kind}")
    failed = F.coalesce(err, F.lit(False))
    return Expression(F.when(~failed, value), failed, value)


def compile_group_expression(text: str, messages: Column, size: Column) -> Expression:
    """Compile an expression over the members of a group, given as columns."""
    node = _parsed(text, {"messages": messages, "size": size})
    failed = F.coalesce(node.err if node.err is not None else F.lit(False), F.lit(False))
    return Expression(F.when(~failed, node.value), failed, node.value)


def check_group_expression(text: str, df: DataFrame) -> None:
    """Raise unless the expression is a boolean one over groups of messages like those of ``df``."""
    member = F.struct("headers", "payload")
    compile_expression(text, df.select(F.array(member).alias("messages"), F.lit(0).alias("size")), "boolean")


def filter_expr(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages that pass, that don't, and that failed."""
    e = compile_expression(text, df, "boolean")
    truth = F.coalesce(e.value, F.lit(False))
    return df.where(e.plain & ~e.err), df.where(~truth & ~e.err), df.where(e.err)


def transform_expr(df: DataFrame, text: str, kind: str) -> DataFrame:
    """Another payload by expression; ``err`` marks messages that failed."""
    e = compile_expression(text, df, kind)
    return df.withColumn("err", e.err).withColumn("payload", e.value)


def route_expr(df: DataFrame, text: str, routes: dict[str, str], default: str | None = None) -> DataFrame:
    """The channel by a string key; null is no route. ``err`` marks messages on which the key failed: they have
    no channel, not even the default one."""
    from millrace.operators.flow import route

    e = compile_expression(text, df, "string")
    routed = route(e.value, routes, default)(df.withColumn("err", e.err))
    return routed.withColumn("channel", F.when(~F.col("err"), F.col("channel")))


def _elements(df: DataFrame, text: str, element: str | None) -> tuple[Column, Column]:
    """The elements and whether the message failed, also by an element of another type than ``element``."""
    e = compile_expression(text, df, "array")
    found = df.select(e.value.alias("v")).schema["v"].dataType.elementType
    if element is None or found.simpleString() == element:
        return e.value, e.err
    if not isinstance(found, T.VariantType):
        raise InvalidExpressionError(f"{text!r} has elements of {found.simpleString()}, not {element}")
    typed = F.transform(e.value, lambda x: F.try_variant_get(x, "$", element))
    # a variant is converted between types, an element is not: its own type has to be that of its kind
    names = {"string": ["STRING"], "boolean": ["BOOLEAN"], "double": ["DOUBLE", "DECIMAL"], "int": ["BIGINT"], "bigint": ["BIGINT"]}[element]
    fits = F.forall(e.value, lambda x: F.regexp_extract(F.schema_of_variant(x), r"^[A-Z]+", 0).isin(names)) & F.forall(typed, lambda x: x.isNotNull())
    failed = e.err | ~F.coalesce(fits, F.lit(True))
    return F.when(~failed, typed), failed


def split_expr(df: DataFrame, text: str, element: str | None = None) -> DataFrame:
    """A message for each element of an array expression; a message on which it fails, or that has an element
    of another type than ``element``, gives none and is one of ``split_expr_failed``."""
    from millrace.operators.flow import split

    return split(_elements(df, text, element)[0])(df)


def split_expr_failed(df: DataFrame, text: str, element: str | None = None) -> DataFrame:
    """The messages that ``split_expr`` can't split."""
    return df.where(_elements(df, text, element)[1])
