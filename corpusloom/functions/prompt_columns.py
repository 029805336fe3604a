"""Prompt templates as Columns.

A template is turned into one Column when a job is built; rendering then runs inside the JVM and no
template engine is called per row. Supported: text, ``{{ expression }}``, ``{% if/elif/else %}``,
``{% for x in list %}`` and ``{% set name = expression %}``; field and item access, literals,
comparison, boolean logic, arithmetic, inline ``if`` and the filters in ``FILTERS``. Anything else
raises :class:`UnsupportedTemplate`; nothing is rendered silently wrong.

Expressions are read with Python's own expression grammar (the filter bar is written ``@`` first,
which binds as tightly as a filter does).
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusloom.functions.arrays import most_frequent
from corpusloom.functions.text import strip
from corpusloom.ids import seeded_key

SEPARATOR = "|||"
MAX_VALUE_CHARS = 2048
_LEEWAY = 5
_GUARD = "\u0001\u0002\u0001"
_PIECES = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


class UnsupportedTemplate(ValueError):
    """The template uses something outside the supported subset."""


@dataclass
class Value:
    """A Column with its type; ``dtype`` None means the name is not defined."""

    col: Column | None
    dtype: S.DataType | None
    items: list[Value] | None = None
    optional: bool = False
    shown: Column | None = None  # how a condition over values of several types prints
    printed: bool = False  # a text that stands for values of several types: it can only be printed

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, S.StringType)

    @property
    def is_list(self) -> bool:
        return isinstance(self.dtype, S.ArrayType)


@dataclass
class Scope:
    schema: S.StructType
    seed: int = 0
    row_key: Column | None = None
    names: dict[str, Value] = field(default_factory=dict)

    def child(self, **names: Value) -> Scope:
        return Scope(self.schema, self.seed, self.row_key, {**self.names, **names})

    def look_up(self, name: str) -> Value:
        if name in self.names:
            return self.names[name]
        for f in self.schema.fields:
            if f.name.replace("-", "_") == name:
                return _guarded(Value(F.col(f"`{f.name}`"), f.dataType))
        return Value(None, None)


def _guarded(v: Value) -> Value:
    """Keep separators that occur in data apart from those of the template."""
    if v.is_text:
        return Value(F.replace(v.col, F.lit(SEPARATOR), F.lit(_GUARD)), v.dtype, optional=v.optional)
    if v.is_list and isinstance(v.dtype.elementType, S.StringType):
        return Value(F.transform(v.col, lambda x: F.replace(x, F.lit(SEPARATOR), F.lit(_GUARD))), v.dtype)
    return v


def _text(v: Value) -> Column:
    """How a value prints."""
    if v.dtype is None:
        return F.lit("")
    if v.shown is not None:
        return v.shown
    missing = F.lit("") if v.optional else F.lit("None")
    if isinstance(v.dtype, S.BooleanType):
        return F.when(v.col.isNull(), missing).when(v.col, "True").otherwise("False")
    if v.is_list:
        if isinstance(v.dtype.elementType, S.StringType):
            inner = F.transform(v.col, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
        else:
            real = isinstance(v.dtype.elementType, S.FractionalType)
            inner = F.transform(v.col, lambda x: _plain_double(x) if real else x.cast("string"))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    if isinstance(v.dtype, (S.StructType, S.MapType)):
        raise UnsupportedTemplate("a nested record cannot be printed")
    if isinstance(v.dtype, (S.DoubleType, S.FloatType)):
        return F.coalesce(_plain_double(v.col), missing)
    return F.coalesce(v.col.cast("string"), missing)


def _chosen(test: Column, yes: Value, no: Value) -> Value:
    """The value of one of two branches, in their own type where they have one type."""
    if yes.dtype is None and no.dtype is None:
        return yes
    if yes.dtype is None or no.dtype is None:  # an undefined name prints nothing and is false
        some, when = (no, ~test) if yes.dtype is None else (yes, test)
        return Value(F.when(when, some.col), some.dtype, optional=True, printed=some.printed)
    optional, whole = yes.optional or no.optional, (S.IntegralType,) * 2
    if yes.dtype == no.dtype and not (yes.printed or no.printed):
        return Value(F.when(test, yes.col).otherwise(no.col), yes.dtype, optional=optional)
    if all(isinstance(v.dtype, kind) for v, kind in zip((yes, no), whole)):
        return Value(F.when(test, yes.col.cast("long")).otherwise(no.col.cast("long")), S.LongType(), optional=optional)
    return Value(F.when(test, _text(yes)).otherwise(_text(no)), _STR, printed=True)


def _plain_double(col: Column) -> Column:
    """A double in digits, with an exponent only from 1e16 on and below 1e-4."""
    col = col.cast("double")
    shown = F.abs(col).cast("string")
    digits = F.regexp_replace(F.regexp_extract(shown, r"^([0-9.]+)", 1), r"\.0$|\.", "")
    power = F.regexp_extract(shown, r"E(-?[0-9]+)$", 1).try_cast("int")
    moved = F.when(
        power >= 0,
        F.concat(
            F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")),
            F.lit("."),
            F.coalesce(F.nullif(F.substring(digits, power + 2, F.length(digits)), F.lit("")), F.lit("0")),
        ),
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""))
    far = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    size = F.abs(col)
    text = (
        F.when(F.isnan(col), "nan")
        .when(size == float("inf"), "inf")
        .when(power.isNull(), shown)
        .when((size >= 1e16) | (size < 1e-4), far)
        .otherwise(moved)
    )
    return F.when(col.isNotNull(), F.concat(F.when(col < 0, "-").otherwise(""), text))


def _truth(v: Value) -> Column:
    if v.printed:
        raise UnsupportedTemplate("a value of several types as a condition")
    if v.dtype is None:
        return F.lit(False)
    if isinstance(v.dtype, S.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if v.is_text:
        return F.coalesce(v.col != "", F.lit(False))
    if v.is_list:
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    if isinstance(v.dtype, S.NumericType):
        return F.coalesce(v.col != 0, F.lit(False))
    return v.col.isNotNull()


def shorten(text: Column, limit: int = MAX_VALUE_CHARS) -> Column:
    """Values a little over the limit pass; longer ones end at a word border with three dots."""
    head = F.substring(text, 1, limit - 3)
    at_word = F.regexp_replace(head, r"(?s) [^ ]*\z", "")
    return F.when(F.length(text) <= limit + _LEEWAY, text).otherwise(F.concat(at_word, F.lit("...")))


_STR, _INT, _DBL, _BOOL = S.StringType(), S.IntegerType(), S.DoubleType(), S.BooleanType()


def _literal(x: object) -> Value:
    if isinstance(x, bool):
        return Value(F.lit(x), _BOOL)
    if isinstance(x, str):
        return Value(F.lit(x), _STR)
    if isinstance(x, int):
        return Value(F.lit(x), _INT)
    if isinstance(x, float):
        return Value(F.lit(x), _DBL)
    raise UnsupportedTemplate(f"literal {x!r}")


def _listed(items: list[Value]) -> Value:
    if not items:
        return Value(F.array().cast("array<string>"), S.ArrayType(_STR), [])
    kinds = {type(i.dtype) for i in items}
    if len(kinds) == 1 and type(None) not in kinds:
        return Value(F.array(*[i.col for i in items]), S.ArrayType(items[0].dtype), items)
    return Value(F.array(*[_text(i) for i in items]), S.ArrayType(_STR), items)


class _Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    # expressions -------------------------------------------------------------------------------

    def expression(self, source: str) -> Value:
        try:
            tree = ast.parse(_bars_to_at(source.strip()), mode="eval")
        except SyntaxError as err:
            raise UnsupportedTemplate(f"cannot read {source.strip()!r}") from err
        return self.visit(tree.body)

    def visit(self, node: ast.AST) -> Value:
        handler = getattr(self, "on_" + type(node).__name__.lower(), None)
        if handler is None:
            raise UnsupportedTemplate(f"{type(node).__name__} is not supported")
        return handler(node)

    def on_constant(self, node: ast.Constant) -> Value:
        return Value(F.lit(None).cast("string"), _STR) if node.value is None else _literal(node.value)

    def on_name(self, node: ast.Name) -> Value:
        if node.id in ("true", "false"):
            return _literal(node.id == "true")
        if node.id == "none":
            return Value(F.lit(None).cast("string"), _STR)
        return self.scope.look_up(node.id)

    def on_list(self, node: ast.List | ast.Tuple) -> Value:
        return _listed([self.visit(e) for e in node.elts])

    on_tuple = on_list

    def on_attribute(self, node: ast.Attribute) -> Value:
        return self.member(self.visit(node.value), node.attr)

    def member(self, base: Value, name: str) -> Value:
        if isinstance(base.dtype, S.StructType):
            for f in base.dtype.fields:
                if f.name.replace("-", "_") == name or f.name == name:
                    return _guarded(Value(base.col.getField(f.name), f.dataType))
            return Value(None, None)
        if isinstance(base.dtype, S.MapType):
            return _guarded(Value(F.try_element_at(base.col, F.lit(name)), base.dtype.valueType, optional=True))
        if base.is_list and isinstance(base.dtype.elementType, S.StructType):
            raise UnsupportedTemplate(f"field {name!r} of a list")
        raise UnsupportedTemplate(f"field {name!r} of a {base.dtype}")

    def on_subscript(self, node: ast.Subscript) -> Value:
        base = self.visit(node.value)
        if base.dtype is None:
            raise UnsupportedTemplate("item of an undefined name")
        if isinstance(node.slice, ast.Slice):
            return self.cut(base, node.slice)
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return self.member(base, node.slice.value)
        at = self.visit(node.slice)
        if base.is_list:
            place = at.col.cast("int")
            place = F.when(place < 0, F.size(base.col) + place).otherwise(place)
            return Value(F.get(base.col, place), base.dtype.elementType, optional=True)
        if base.is_text and isinstance(at.dtype, S.NumericType):
            place = at.col.cast("int")
            return Value(F.substring(base.col, F.when(place < 0, place).otherwise(place + 1), F.lit(1)), _STR)
        if isinstance(base.dtype, S.MapType):
            return _guarded(Value(F.try_element_at(base.col, at.col), base.dtype.valueType, optional=True))
        raise UnsupportedTemplate("item access")

    def cut(self, base: Value, cut: ast.Slice) -> Value:
        if cut.step is not None:
            raise UnsupportedTemplate("slice step")
        size = F.length(base.col) if base.is_text else F.size(base.col)

        def bound(node: ast.AST | None, default: Column) -> Column:
            if node is None:
                return default
            raw = self.visit(node).col.cast("int")
            return F.least(F.greatest(F.when(raw < 0, size + raw).otherwise(raw), F.lit(0)), size)

        lo, hi = bound(cut.lower, F.lit(0)), bound(cut.upper, size)
        count = F.greatest(hi - lo, F.lit(0))
        if base.is_text:
            return Value(F.substring(base.col, lo + 1, count), _STR)
        if base.is_list:
            return Value(F.slice(base.col, lo + 1, count), base.dtype)
        raise UnsupportedTemplate("slice")

    def on_ifexp(self, node: ast.IfExp) -> Value:
        return _chosen(_truth(self.visit(node.test)), self.visit(node.body), self.visit(node.orelse))

    def on_boolop(self, node: ast.BoolOp) -> Value:
        """The operand that decides; where operands have several types, only its truth or its text."""
        values = [self.visit(v) for v in node.values]
        out, both = values[-1], isinstance(node.op, ast.And)
        for v in reversed(values[:-1]):
            out = _chosen(_truth(v), out, v) if both else _chosen(_truth(v), v, out)
        if not out.printed:
            return out
        truths = [_truth(v) for v in values]
        return Value(reduce(lambda a, b: a & b if both else a | b, truths), _BOOL, shown=out.col)

    def on_unaryop(self, node: ast.UnaryOp) -> Value:
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~_truth(v), _BOOL)
        if isinstance(node.op, ast.USub):
            return Value(-v.col, v.dtype)
        raise UnsupportedTemplate("unary operator")

    def on_compare(self, node: ast.Compare) -> Value:
        if len(node.ops) != 1:
            raise UnsupportedTemplate("chained comparison")
        op, right_node = node.ops[0], node.comparators[0]
        left = self.visit(node.left)
        if isinstance(op, (ast.Is, ast.IsNot)):
            out = self.test(left, right_node)
            return Value(~out if isinstance(op, ast.IsNot) else out, _BOOL)
        right = self.visit(right_node)
        if left.printed or right.printed:
            raise UnsupportedTemplate("comparison of a value of several types")
        if isinstance(op, (ast.In, ast.NotIn)):
            if right.is_list and right.items is not None:
                out = F.lit(False)
                for item in right.items:
                    out = out | self.equal(left, item)
            elif right.is_list:
                out = F.array_contains(right.col, left.col.cast(right.dtype.elementType))
            elif right.is_text:
                out = F.contains(right.col, _text(left))
            else:
                raise UnsupportedTemplate("membership test")
            out = F.coalesce(out, F.lit(False))
            return Value(~out if isinstance(op, ast.NotIn) else out, _BOOL)
        if isinstance(op, ast.Eq):
            return Value(self.equal(left, right), _BOOL)
        if isinstance(op, ast.NotEq):
            return Value(~self.equal(left, right), _BOOL)
        ops = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
        if type(op) not in ops or left.col is None or right.col is None:
            raise UnsupportedTemplate("comparison")
        return Value(getattr(left.col, ops[type(op)])(right.col), _BOOL)

    def equal(self, left: Value, right: Value) -> Column:
        if left.dtype is None or right.dtype is None:
            return F.lit(False)
        if left.is_list or right.is_list:
            if left.is_list and right.is_list:
                return left.col.eqNullSafe(right.col)
            return F.lit(False)
        if left.is_text != right.is_text:
            return left.col.isNull() & right.col.isNull()
        return left.col.eqNullSafe(right.col)

    def test(self, v: Value, node: ast.AST) -> Column:
        name = node.id if isinstance(node, ast.Name) else "none" if isinstance(node, ast.Constant) and node.value is None else None
        if name == "defined":
            return F.lit(v.dtype is not None)
        if name == "undefined":
            return F.lit(v.dtype is None)
        if name == "none":
            return F.lit(False) if v.dtype is None else v.col.isNull()
        raise UnsupportedTemplate("test after 'is'")

    def on_binop(self, node: ast.BinOp) -> Value:
        if isinstance(node.op, ast.MatMult):
            return self.filtered(node.left, node.right)
        left, right = self.visit(node.left), self.visit(node.right)
        if left.dtype is None or right.dtype is None:
            raise UnsupportedTemplate("arithmetic on an undefined name")
        if any(v.printed or v.shown is not None for v in (left, right)):
            raise UnsupportedTemplate("arithmetic on a value of several types")
        if isinstance(node.op, ast.Add) and (left.is_text or right.is_text):
            return Value(F.concat(_text(left), _text(right)), _STR)
        if isinstance(node.op, ast.Add) and left.is_list and right.is_list:
            both = left.items + right.items if left.items is not None and right.items is not None else None
            return Value(F.concat(left.col, right.col), left.dtype, both)
        real = isinstance(left.dtype, S.FractionalType) or isinstance(right.dtype, S.FractionalType)
        a, b = left.col, right.col
        if isinstance(node.op, ast.Add):
            return Value(a + b, _DBL if real else left.dtype)
        if isinstance(node.op, ast.Sub):
            return Value(a - b, _DBL if real else left.dtype)
        if isinstance(node.op, ast.Mult):
            return Value(a * b, _DBL if real else left.dtype)
        if isinstance(node.op, ast.Div):
            return Value(a.cast("double") / b, _DBL)
        if isinstance(node.op, ast.FloorDiv):
            return Value(F.floor(a / b).cast("int"), _INT)
        if isinstance(node.op, ast.Mod):
            return Value(F.pmod(a, b), left.dtype)
        raise UnsupportedTemplate("operator")

    def on_call(self, node: ast.Call) -> Value:
        if isinstance(node.func, ast.Name) and node.func.id == "range":
            args = [self.visit(a).col.cast("int") for a in node.args]
            lo, hi = (F.lit(0), args[0]) if len(args) == 1 else (args[0], args[1])
            out = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
            return Value(out, S.ArrayType(_INT))
        if isinstance(node.func, ast.Name) and node.func.id in ("choice", "most_frequent"):
            return self.apply(node.func.id, self.visit(node.args[0]), [])
        if isinstance(node.func, ast.Attribute):
            base = self.visit(node.func.value)
            args = [self.visit(a) for a in node.args]
            name = node.func.attr
            if base.is_text and name in ("lower", "upper", "strip", "replace", "split", "capitalize", "title"):
                return self.apply({"strip": "trim"}.get(name, name), base, args)
            if base.is_text and name in ("startswith", "endswith"):
                fn = F.startswith if name == "startswith" else F.endswith
                return Value(fn(base.col, args[0].col), _BOOL)
            if base.is_text and name == "join" and args and args[0].is_list:
                return self.apply("join", args[0], [base])
        raise UnsupportedTemplate("call")

    # filters -----------------------------------------------------------------------------------

    def filtered(self, source: ast.AST, spec: ast.AST) -> Value:
        base = self.visit(source)
        if isinstance(spec, ast.Name):
            return self.apply(spec.id, base, [])
        if isinstance(spec, ast.Call) and isinstance(spec.func, ast.Name):
            if spec.keywords and spec.func.id not in ("map", "round"):
                raise UnsupportedTemplate(f"named argument of {spec.func.id}")
            named = {k.arg: k.value for k in spec.keywords}
            if spec.func.id == "map":
                return self.mapped(base, spec.args, named)
            args = [self.visit(a) for a in spec.args]
            return self.apply(spec.func.id, base, args)
        raise UnsupportedTemplate("filter")

    def mapped(self, base: Value, args: list[ast.AST], named: dict[str, ast.AST]) -> Value:
        if not base.is_list:
            raise UnsupportedTemplate("map over a value that is no list")
        kind = base.dtype.elementType
        if "attribute" in named and isinstance(named["attribute"], ast.Constant) and isinstance(kind, S.StructType):
            name = named["attribute"].value
            inner = next((f.dataType for f in kind.fields if f.name == name), None)
            if inner is None:
                raise UnsupportedTemplate(f"field {name!r} of a list item")
            return Value(F.transform(base.col, lambda x: x.getField(name)), S.ArrayType(inner))
        if args and isinstance(args[0], ast.Constant) and isinstance(args[0].value, str):
            name = args[0].value
            probe = self.apply(name, Value(F.lit(None), kind), [])
            return Value(
                F.transform(base.col, lambda x: self.apply(name, Value(x, kind), []).col), S.ArrayType(probe.dtype)
            )
        raise UnsupportedTemplate("map")

    def apply(self, name: str, v: Value, args: list[Value]) -> Value:
        if name == "default":
            return args[0] if v.dtype is None else v
        handler = FILTERS.get(name)
        if handler is None:
            raise UnsupportedTemplate(f"filter {name!r}")
        if v.dtype is None and name not in ("string", "list", "length", "trim"):
            raise UnsupportedTemplate(f"filter {name!r} of an undefined name")
        return handler(self, v, args)

    # statements --------------------------------------------------------------------------------

    def render(self, parts: list[str], value_limit: int | None) -> Column:
        out, rest = self.block(parts, (), value_limit)
        if rest:
            raise UnsupportedTemplate("unbalanced block")
        return out

    def block(self, parts: list[str], stops: tuple[str, ...], limit: int | None) -> tuple[Column, list[str]]:
        pieces: list[Column] = []
        while parts:
            part = parts[0]
            if part.startswith("{%"):
                body = part[2:-2].strip("-+ \n\t")
                word = body.split(None, 1)[0] if body else ""
                if word in stops:
                    break
                parts = parts[1:]
                if word == "if":
                    col, parts = self.branches(body[2:], parts, limit)
                    pieces.append(col)
                elif word == "for":
                    col, parts = self.loop(body[3:], parts, limit)
                    pieces.append(col)
                elif word == "set" and "=" in body:
                    name, expr = body[3:].split("=", 1)
                    if not name.strip().isidentifier():
                        raise UnsupportedTemplate("set of several names")
                    self.scope = self.scope.child(**{name.strip(): self.expression(expr)})
                else:
                    raise UnsupportedTemplate(f"statement {word!r}")
                continue
            parts = parts[1:]
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                value = _text(self.expression(part[2:-2].strip("-+ \n\t")))
                pieces.append(shorten(value, limit) if limit else value)
            elif part:
                pieces.append(F.lit(part))
        return (F.concat(*pieces) if pieces else F.lit("")), parts

    def branches(self, test: str, parts: list[str], limit: int | None) -> tuple[Column, list[str]]:
        outer = self.scope
        chain: list[tuple[Column | None, Column]] = []
        ends: list[tuple[Column | None, Scope]] = []
        condition: Column | None = _truth(self.expression(test))
        while True:
            body, parts = self.block(parts, ("elif", "else", "endif"), limit)
            ends.append((condition, self.scope))
            self.scope = outer
            chain.append((condition, body))
            if not parts:
                raise UnsupportedTemplate("if without endif")
            head = parts[0][2:-2].strip("-+ \n\t")
            parts = parts[1:]
            if head.startswith("endif"):
                break
            condition = _truth(self.expression(head[4:])) if head.startswith("elif") else None
        self.scope = self.after_branches(outer, ends)
        out = None
        for condition, body in chain:
            if condition is None:
                out = body if out is None else out.otherwise(body)
                return out, parts
            out = F.when(condition, body) if out is None else out.when(condition, body)
        return out.otherwise(F.lit("")), parts

    def after_branches(self, outer: Scope, ends: list[tuple[Column | None, Scope]]) -> Scope:
        """An ``if`` opens no scope: names that a branch sets keep the value of the branch taken."""
        changed = {n for _, s in ends for n, v in s.names.items() if outer.names.get(n) is not v}
        names = {}
        for n in sorted(changed):
            value = outer.look_up(n)
            for condition, scope in reversed(ends):
                taken = scope.look_up(n)
                value = taken if condition is None else _chosen(condition, taken, value)
            names[n] = value
        return outer.child(**names)

    def loop(self, head: str, parts: list[str], limit: int | None) -> tuple[Column, list[str]]:
        target, _, source = head.partition(" in ")
        target = target.strip()
        if not target.isidentifier():
            raise UnsupportedTemplate("for over several names")
        over = self.expression(source)
        if not over.is_list:
            raise UnsupportedTemplate("for over a value that is no list")
        outer, after = self.scope, []
        loop_type = S.StructType(
            [S.StructField("index", _INT), S.StructField("index0", _INT), S.StructField("first", _BOOL), S.StructField("last", _BOOL)]
        )

        def body(x: Column, i: Column) -> Column:
            info = F.struct(
                (i + 1).alias("index"),
                i.alias("index0"),
                (i == 0).alias("first"),
                (i == F.size(over.col) - 1).alias("last"),
            )
            self.scope = outer.child(**{target: _guarded(Value(x, over.dtype.elementType)), "loop": Value(info, loop_type)})
            col, remaining = self.block(parts, ("endfor",), limit)
            after[:] = [remaining]
            self.scope = outer
            return col

        out = F.array_join(F.transform(over.col, body), "")
        if not after or not after[0]:
            raise UnsupportedTemplate("for without endfor")
        return out, after[0][1:]


def _numbers(v: Value, kind: str) -> Column:
    return F.expr("null") if v.col is None else v.col.try_cast(kind)


def _need_list(v: Value) -> Column:
    if not v.is_list:
        raise UnsupportedTemplate("list filter on a value that is no list")
    return v.col


def _random(c: _Compiler, v: Value, args: list[Value]) -> Value:
    if c.scope.row_key is None:
        raise UnsupportedTemplate("a random choice needs a row key")
    key = seeded_key(c.scope.seed, c.scope.row_key)
    if v.is_text:
        raise UnsupportedTemplate("choice from text")
    arr = _need_list(v)
    at = (F.pmod(key, F.size(arr).cast("long")) + 1).cast("int")
    return Value(F.element_at(arr, at), v.dtype.elementType)


FILTERS = {
    "join": lambda c, v, a: Value(
        F.array_join(F.transform(_need_list(v), lambda x: x.cast("string")), "")
        if not a
        else F.aggregate(
            F.transform(_need_list(v), lambda x: x.cast("string")),
            F.lit(None).cast("string"),
            lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, a[0].col, x)),
            lambda acc: F.coalesce(acc, F.lit("")),
        ),
        _STR,
    ),
    "replace": lambda c, v, a: Value(F.replace(_text(v), a[0].col, a[1].col), _STR),
    "choice": _random,
    "random": _random,
    "length": lambda c, v, a: Value(
        F.lit(0) if v.dtype is None else F.size(v.col) if v.is_list else F.length(_text(v)), _INT
    ),
    "count": lambda c, v, a: Value(F.size(v.col) if v.is_list else F.length(_text(v)), _INT),
    "int": lambda c, v, a: Value(
        F.coalesce(_numbers(v, "int"), F.floor(_numbers(v, "double")).cast("int"), F.lit(0)), _INT
    ),
    "float": lambda c, v, a: Value(F.coalesce(_numbers(v, "double"), F.lit(0.0)), _DBL),
    "string": lambda c, v, a: Value(_text(v), _STR),
    "trim": lambda c, v, a: Value(strip(_text(v)), _STR),
    "lower": lambda c, v, a: Value(F.lower(_text(v)), _STR),
    "upper": lambda c, v, a: Value(F.upper(_text(v)), _STR),
    "title": lambda c, v, a: Value(F.initcap(_text(v)), _STR),
    "list": lambda c, v, a: (
        Value(F.filter(F.split(v.col, ""), lambda x: x != ""), S.ArrayType(_STR)) if v.is_text else v
    ),
    "round": lambda c, v, a: Value(
        F.bround(v.col.cast("double"), 0 if not a else int(_constant(a[0]))), _DBL
    ),
    "abs": lambda c, v, a: Value(F.abs(v.col), v.dtype),
    "capitalize": lambda c, v, a: Value(
        F.concat(F.upper(F.substring(_text(v), 1, 1)), F.lower(F.substr(_text(v), F.lit(2)))), _STR
    ),
    "unique": lambda c, v, a: Value(F.array_distinct(_need_list(v)), v.dtype),
    "sort": lambda c, v, a: Value(F.array_sort(_need_list(v)), v.dtype),
    "reverse": lambda c, v, a: Value(F.reverse(v.col), v.dtype),
    "first": lambda c, v, a: Value(F.get(_need_list(v), F.lit(0)), v.dtype.elementType, optional=True),
    "last": lambda c, v, a: Value(
        F.get(_need_list(v), F.size(v.col) - 1), v.dtype.elementType, optional=True
    ),
    "max": lambda c, v, a: Value(F.array_max(_need_list(v)), v.dtype.elementType, optional=True),
    "min": lambda c, v, a: Value(F.array_min(_need_list(v)), v.dtype.elementType, optional=True),
    "most_frequent": lambda c, v, a: Value(most_frequent(_need_list(v)), v.dtype),
    "split": lambda c, v, a: Value(
        F.filter(F.split(v.col, r"\s+", -1), lambda x: x != "")
        if not a
        else F.split(v.col, F.concat(F.lit("\\Q"), a[0].col, F.lit("\\E")), F.lit(-1)),
        S.ArrayType(_STR),
    ),
}


def _constant(v: Value) -> int:
    text = str(v.col)
    found = re.search(r"-?\d+", text)
    if not found:
        raise UnsupportedTemplate("argument must be a literal")
    return int(found.group())


def _bars_to_at(source: str) -> str:
    """Write filter bars as ``@`` outside string literals."""
    out, quote = [], ""
    for ch in source.replace("\n", " "):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == "|":
            ch = "@"
        out.append(ch)
    return "".join(out)


def _pieces(template: str) -> list[str]:
    body = template[:-1] if template.endswith("\n") else template
    parts = _PIECES.split(body)
    # a dash inside a tag trims the text next to it
    for i, part in enumerate(parts):
        if part[:3] in ("{{-", "{%-") and i > 0:
            parts[i - 1] = parts[i - 1].rstrip()
        if part[-3:] in ("-}}", "-%}") and i + 1 < len(parts):
            parts[i + 1] = parts[i + 1].lstrip()
    return [p for p in parts if p]


def render_text(template: str, schema: S.StructType, seed: int = 0, row_key: Column | None = None, names: dict[str, Value] | None = None, value_limit: int | None = None) -> Column:
    """The template as one string Column over a frame of the given schema."""
    scope = Scope(schema, seed, row_key, dict(names or {}))
    return _Compiler(scope).render(_pieces(template), value_limit)


def _parts(text: Column) -> Column:
    return F.transform(
        F.split(text, r"\|\|\|", -1), lambda p: strip(F.replace(p, F.lit(_GUARD), F.lit(SEPARATOR)))
    )


def answer_choices(expression: str | None, schema: S.StructType, seed: int = 0, row_key: Column | None = None) -> Column:
    """Per-row list of answer choices; null when the template has none."""
    if not expression:
        return F.lit(None).cast("array<string>")
    return _parts(render_text(expression, schema, seed, row_key))


def fixed_choices(expression: str | None) -> list[str] | None:
    """The list of choices when it uses no field of the record."""
    if not expression or "{{" in expression or "{%" in expression:
        return None
    return [c.strip() for c in expression.split(SEPARATOR)]


def variables(template: str) -> set[str]:
    """Names the template reads (for validation against a record schema)."""
    found: set[str] = set()
    bound = {"true", "false", "none", "loop", "answer_choices", "defined", "undefined"} | set(FILTERS)
    bound |= {"range", "choice", "zip", "map", "default", "selectattr", "namespace", "highlight"}
    for part in _pieces(template):
        if not part.startswith(("{{", "{%")):
            continue
        body = part[2:-2].strip("-+ \n\t")
        for m in re.finditer(r"(?:for\s+([\w, ]+?)\s+in\b)|(?:set\s+(\w+)\s*=)", body):
            bound |= {n.strip() for n in (m.group(1) or m.group(2)).split(",")}
        bare = re.sub(r"'[^']*'|\"[^\"]*\"", "", body)
        for m in re.finditer(r"(?<![\w.])([A-Za-z_]\w*)\s*(=(?!=))?", bare):
            if not m.group(2):
                found.add(m.group(1))
    words = {"if", "elif", "else", "endif", "for", "endfor", "set", "in", "not", "and", "or", "is"}
    return found - bound - words


def render(
    template: str,
    schema: S.StructType,
    choices: str | None = None,
    seed: int = 0,
    row_key: Column | None = None,
    value_limit: int | None = MAX_VALUE_CHARS,
) -> Column:
    """Parts of the rendered template (prompt and target) as an array of stripped strings."""
    if any(f.name == "answer_choices" for f in schema.fields):
        raise ValueError("a record must not have a field named answer_choices")
    names = {}
    if choices:
        listed = render_text(choices, schema, seed, row_key)
        arr = F.transform(F.split(listed, r"\|\|\|", -1), strip)
        names["answer_choices"] = Value(arr, S.ArrayType(_STR))
    return _parts(render_text(template, schema, seed, row_key, names, value_limit))
