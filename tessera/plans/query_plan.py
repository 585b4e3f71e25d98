"""A declarative tabular query (computed columns, filters, one group, aggregates, order, selection, limit) as DataFrame calls.

``execute`` only composes DataFrame operations; Catalyst plans them. Nulls, mixed comparisons and ties follow the rules stated with each part.
"""

from __future__ import annotations

import ast
import datetime
import json
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numbers import number_literal, read_number

MAX_EXPRESSION = 300
OPERATIONS = ("==", "!=", ">", ">=", "<", "<=", "contains", "not_contains", "starts_with", "in")
FUNCTIONS = ("count", "sum", "avg", "min", "max")
CHARTS = ("none", "bar", "line")


class PlanError(ValueError):
    """A plan names an unknown column or uses an expression that isn't allowed."""


@dataclass
class Computed:
    name: str
    expression: str


@dataclass
class Filter:
    column: str
    op: str  # == != > >= < <= contains not_contains starts_with in
    value: str


@dataclass
class Aggregate:
    func: str  # count sum avg min max
    column: str = ""
    alias: str = ""

    @property
    def name(self) -> str:
        return self.alias or f"{self.func}_{self.column}"


@dataclass
class Sort:
    column: str
    descending: bool = True


@dataclass
class Chart:
    """What to draw of the result: none, bar or line, by a column of names and one of numbers."""

    type: str = "none"
    x: str = ""
    y: str = ""


@dataclass
class QueryPlan:
    computed: list[Computed] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    group_by: str = ""
    aggregates: list[Aggregate] = field(default_factory=list)
    select: list[str] = field(default_factory=list)
    sort: list[Sort] = field(default_factory=list)
    limit: int = 0
    chart: Chart = field(default_factory=Chart)


def resolve_column(name: str, columns: list[str], what: str = "plan") -> str:
    """A column by its exact name, else by letters and digits alone, else the only one that contains the name or lies in it."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    if name in columns:
        return name
    want = plain(name)
    equal = [c for c in columns if plain(c) == want]
    near = [c for c in columns if want and (want in plain(c) or plain(c) in want)]
    if equal or len(near) == 1:
        return (equal or near)[0]
    raise PlanError(f"Unknown column in {what}: {name!r}. Available: {', '.join(columns)}")


def _text(df: DataFrame, column: str) -> Column:
    """A cell as text: doubles below 1e16 in plain decimals, as they are written by hand."""
    x = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.cast("double").cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(x.cast("string").contains("E") & (F.abs(x) < 1e16) & (F.abs(x) >= 1e-4), plain).otherwise(x.cast("string"))


def _number(df: DataFrame, column: str) -> Column:
    """A column as an operand: numbers, and those that cells of text write; booleans, other text and dates give null."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return read_number(F.col(f"`{column}`"), False)
    if isinstance(kind, T.DecimalType):
        return F.col(f"`{column}`").cast("double")
    return F.col(f"`{column}`") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def arithmetic(df: DataFrame, expression: str) -> Column:
    """The column of an arithmetic text over column names (spaces allowed), numbers, + - * / and brackets; nothing else is accepted.

    A missing operand or a division by zero gives null. Fractions are rounded to four places, whole numbers stay whole.
    """
    if len(expression) > MAX_EXPRESSION:
        raise PlanError(f"The expression is too long ({len(expression)} characters).")
    text, names = expression, {}
    for k, column in enumerate(sorted(df.columns, key=len, reverse=True)):
        text, n = re.subn(rf"(?<!\w){re.escape(column)}(?!\w)", f"_column_{k}_", text)
        if n:
            names[f"_column_{k}_"] = column

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool()):
                raise PlanError(f"Unsupported expression: {expression}")
            case ast.Constant(value=int() | float() as value):
                return F.lit(value)
            case ast.Name(id=name):
                return _number(df, names.get(name) or resolve_column(name, df.columns, "expression"))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return build(a) + build(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return build(a) - build(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return build(a) * build(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(build(a).cast("double"), build(b).cast("double"))
        raise PlanError(f"Unsupported expression: {expression}. Only numbers, column names, + - * / and brackets are allowed.")

    try:
        column = build(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError as error:
        raise PlanError(f"Unsupported expression: {expression}") from error
    kind = df.select(column.alias("x")).schema["x"].dataType
    return F.floor(column * 10000 + 0.5) / 10000 if isinstance(kind, (T.DoubleType, T.FloatType)) else column


def condition(df: DataFrame, f: Filter) -> Column:
    """A filter as a condition that is never null, so that scans can take it.

    Missing cells fail every comparison but !=; text operations take them as empty. Numbers compare as numbers when the literal is one,
    all else as lower-cased text; timestamps compare as their ISO text does, natively.
    """
    column, kind = F.col(f"`{f.column}`"), df.schema[f.column].dataType
    text = F.coalesce(F.lower(_text(df, f.column)), F.lit(""))
    if f.op == "in":
        return text.isin([w.strip().lower() for w in f.value.split(",")])
    if f.op in ("contains", "not_contains"):
        hit = text.contains(f.value.lower())
        return hit if f.op == "contains" else ~hit
    if f.op == "starts_with":
        return text.startswith(f.value.lower())
    number, op = number_literal(f.value), f.op
    if isinstance(kind, (T.NumericType, T.BooleanType)) and number is not None:
        left, right = (column.cast("int") if isinstance(kind, T.BooleanType) else column), F.lit(number)
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)) and (moment := _moment(f.value)) is not None:
        left, right = column, F.lit(moment).cast(kind)
        if len(f.value.strip()) == 10:  # the text of a time on that day is longer, so greater, than the day's
            if op in ("==", "!="):
                return F.lit(op == "!=")
            op = {">": ">=", "<=": "<"}.get(op, op)
    else:
        left, right = F.lower(_text(df, f.column)), F.lit(f.value.lower())
    if op == "!=":
        return ~left.eqNullSafe(right)
    test = {"==": left == right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}
    if op not in test:
        raise PlanError(f"Unknown filter operation: {op}")
    return test[op] & column.isNotNull()


def plan_from_json(text: str) -> QueryPlan:
    """A plan as JSON, in a code fence or among other words or not; unknown keys, operations and functions are refused."""
    found = re.search(r"\{.*\}", text, re.DOTALL)
    try:
        raw = json.loads(found[0] if found else text)
    except json.JSONDecodeError as error:
        raise PlanError("The plan is no JSON.") from error

    def made(kind: type, data: object):
        names = {f.name for f in fields(kind)}
        if not isinstance(data, dict) or set(data) - names:
            raise PlanError(f"Unknown keys for {kind.__name__}: {sorted(set(data) - names) if isinstance(data, dict) else data}")
        try:
            return kind(**data)
        except TypeError as error:
            raise PlanError(f"Incomplete {kind.__name__}: {data}") from error

    plan = made(QueryPlan, raw)
    for name, kind in {"computed": Computed, "filters": Filter, "aggregates": Aggregate, "sort": Sort}.items():
        setattr(plan, name, [made(kind, x) for x in getattr(plan, name)])
    plan.chart = made(Chart, plan.chart) if isinstance(plan.chart, dict) else plan.chart
    if not isinstance(plan.chart, Chart) or plan.chart.type not in CHARTS:
        raise PlanError("Unknown kind of chart in the plan.")
    if any(f.op not in OPERATIONS for f in plan.filters) or any(a.func not in FUNCTIONS for a in plan.aggregates):
        raise PlanError("Unknown operation or function in the plan.")
    if plan.group_by and not plan.aggregates:
        plan.group_by = ""
    return plan


def _moment(text: str) -> datetime.datetime | None:
    try:
        return datetime.datetime.fromisoformat(text.strip())
    except ValueError:
        return None


def aggregate(df: DataFrame, a: Aggregate) -> Column:
    """count counts rows; the others see numbers (booleans as 0 and 1) only, and give null without any; sum and avg have four places."""
    if a.func == "count":
        return F.count(F.lit(1)).alias(a.name)
    kind = df.schema[a.column].dataType
    value = F.col(f"`{a.column}`").cast("int") if isinstance(kind, T.BooleanType) else _number(df, a.column)
    made = {"sum": F.round(F.sum(value), 4), "avg": F.round(F.avg(value), 4), "min": F.min(value), "max": F.max(value)}
    if a.func not in made:
        raise PlanError(f"Unknown aggregate: {a.func}")
    return made[a.func].alias(a.name)


def normalised(plan: QueryPlan, columns: list[str]) -> QueryPlan:
    """The plan with all its columns named as the table (of ``columns``) and its own results name them: PlanError for unknown ones, but a chart of unknown
    columns is no chart. A group without aggregates is dropped. Of a grouped result the table's other columns can be named too."""
    known = [*columns, *(c.name for c in plan.computed if c.name not in columns)]
    key = resolve_column(plan.group_by, known, "group_by") if plan.group_by and plan.aggregates else ""
    aggregates = [Aggregate(a.func, resolve_column(a.column, known, "aggregate") if a.func != "count" or a.column else "", a.alias) for a in plan.aggregates]
    results = [a.name for a in aggregates]
    shown = [key, *results, *(c for c in known if c != key)] if key else results or known
    named = lambda names, where, what: [resolve_column(n, where, what) for n in names]
    chart = plan.chart
    if chart.type != "none":
        try:
            chart = Chart(chart.type, *named([chart.x, chart.y], shown, "chart"))
        except PlanError:
            chart = Chart()
    return QueryPlan(
        plan.computed, [Filter(resolve_column(f.column, known, "filter"), f.op, f.value) for f in plan.filters], key, aggregates, named(plan.select, shown, "select"),
        [Sort(resolve_column(x.column, shown, "sort"), x.descending) for x in plan.sort], plan.limit, chart,
    )


def execute(df: DataFrame, plan: QueryPlan, position: list[str] | None = None) -> DataFrame:
    """The plan's result. ``position`` names columns that give the rows' order in their source: it settles ties of the sort, the order of
    groups and the first member whose values non-aggregated columns take. Without it these are any.

    Steps: computed columns (later ones see earlier ones), filters, grouping, sort, selection, limit (0: none). Sorts put missing values
    first, last when descending; text sorts lower-cased.
    """
    for c in plan.computed:
        df = df.withColumn(c.name, arithmetic(df, c.expression))
    source = df.columns
    for f in plan.filters:
        df = df.where(condition(df, Filter(resolve_column(f.column, df.columns, "filter"), f.op, f.value)))
    aggregates = [Aggregate(a.func, resolve_column(a.column, source, "aggregate") if a.func != "count" or a.column else "", a.alias) for a in plan.aggregates]
    order = F.struct(*(F.col(f"`{c}`") for c in position)) if position else None
    shown = source
    if plan.group_by and aggregates:
        key = resolve_column(plan.group_by, source, "group_by")
        shown = [key, *dict.fromkeys(a.name for a in aggregates if a.name != key)]
        rest = [c for c in source if c not in shown]
        wanted = {resolve_column(c, shown + rest, "plan") for c in [*plan.select, *(s.column for s in plan.sort)]}
        first = [(F.min_by(F.col(f"`{c}`"), order) if order is not None else F.any_value(F.col(f"`{c}`"))).alias(c) for c in rest if c in wanted]
        df = df.groupBy(F.col(f"`{key}`")).agg(*(aggregate(df, a) for a in aggregates), *first, *([F.min(order).alias("__first")] if position else []))
        columns, tie = shown + rest, "__first" if position else None
    elif aggregates:
        df, shown, tie = df.agg(*(aggregate(df, a) for a in aggregates)), [a.name for a in aggregates], None
        columns = shown
    else:
        df, columns, tie = (df.withColumn("__first", order) if position else df), source, "__first" if position else None
    keys = []
    for s in plan.sort:
        name = resolve_column(s.column, columns, "sort")
        key = F.lower(F.col(f"`{name}`")) if isinstance(df.schema[name].dataType, T.StringType) else F.col(f"`{name}`")
        keys.append(key.desc_nulls_last() if s.descending else key.asc_nulls_first())
    if tie and (keys or plan.limit):
        keys.append(F.col(tie))
    if keys:
        df = df.orderBy(*keys)
    names = [resolve_column(c, columns, "select") for c in plan.select] or shown
    df = df.select(*(F.col(f"`{c}`") for c in names))
    return df.limit(plan.limit) if plan.limit else df


def profile(df: DataFrame) -> DataFrame:
    """(column, kind, rows, missing, low, high, about_distinct) of each column, in one pass; only number columns have low and high."""
    kinds = {f.name: "number" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else "text" for f in df.schema.fields}
    parts = []
    for c, kind in kinds.items():
        x = F.col(f"`{c}`")
        number = x.cast("double") if kind == "number" else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("missing"), F.min(number).alias("low"), F.max(number).alias("high"), F.approx_count_distinct(x).alias("about_distinct")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def profile_values(df: DataFrame, position: list[str], most: int = 12) -> DataFrame:
    """(column, values) of the text columns with at most ``most`` distinct values: these, in the order in which they first appear."""
    order = F.struct(*(F.col(f"`{c}`") for c in position))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = df.select(order.alias("__at"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in texts))).alias("c"))
    firsts = cells.where("c.value is not null").groupBy("c.column", "c.value").agg(F.min("__at").alias("at"))
    ranked = firsts.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("at", "value"))).where(F.col("n") <= most + 1)
    listed = ranked.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))
    return listed.where(F.col("n") <= most).select("column", "values")


def chart_series(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """The points (x as text, y) with a number, and (top, bottom, span, points) of their axis, which holds zero."""
    points = df.select(F.col(f"`{resolve_column(x, df.columns, 'chart')}`").cast("string").alias("x"), _number(df, resolve_column(y, df.columns, "chart")).cast("double").alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    top, bottom = F.greatest(F.max("y"), F.lit(0.0)), F.least(F.min("y"), F.lit(0.0))
    return points, points.agg(top.alias("top"), bottom.alias("bottom"), (top - bottom).alias("span"), F.count(F.lit(1)).alias("points"))
