"""Operators as SQL over named inputs, in the dialect of the engine that runs them.

An operator is a function from a dialect and parameters to a SQL body in which ``@name@``
stands for an input. Called with DataFrames it gives a DataFrame, planned by Catalyst like
any other; composed into a tree over table scans it also gives the DuckDB text that checks it.
"""

from __future__ import annotations

import functools
import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.tables import table


def text(s: str) -> str:
    """A SQL string literal that both engines read alike (Spark with escaped backslashes off)."""
    return "'" + s.replace("'", "''") + "'"


class Duck:
    """DuckDB spellings; each method has a twin in Spark."""

    name = "duckdb"

    def lit(self, s: str) -> str:
        return text(s)

    def int(self, x: str) -> str:
        """Truncates toward zero."""
        return f"CAST(trunc({x}) AS BIGINT)"

    def try_double(self, x: str) -> str:
        return f"TRY_CAST({x} AS DOUBLE)"

    def try_int(self, x: str) -> str:
        return f"CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN TRY_CAST({x} AS BIGINT) END"

    def month(self, d: str) -> str:
        return f"strftime({d}, '%Y-%m')"

    def like(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {text(pattern)})"

    def like_col(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {pattern})"

    def extract(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, {text(pattern)}, {group})"

    def extract_all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {text(pattern)}, {group})"

    def count(self, s: str, pattern: str) -> str:
        return f"len(regexp_extract_all({s}, {text(pattern)}))"

    def sub(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {text(pattern)}, {text(by)}, 'g')"

    def split(self, s: str, sep: str) -> str:
        return f"string_split({s}, {text(sep)})"

    def explode(self, a: str) -> str:
        return f"unnest({a})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def at(self, a: str, i: str) -> str:
        """One-based element or NULL."""
        return f"({a})[{i}]"

    def filter(self, a: str, cond: Callable[[str], str]) -> str:
        return f"list_filter({a}, lambda x: {cond('x')})"

    def transform(self, a: str, to: Callable[[str], str]) -> str:
        return f"list_transform({a}, lambda x: {to('x')})"

    def sequence(self, a: str, b: str) -> str:
        """a to b; empty if b < a."""
        return f"range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"({a})[({start}):(({start}) + ({n}) - 1)]"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def intersect(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"

    def contains(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def join(self, a: str, sep: str) -> str:
        return f"coalesce(array_to_string({a}, {text(sep)}), '')"

    def agg_join(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {text(sep)} ORDER BY {order})"

    def array(self, *items: str) -> str:
        return "[" + ", ".join(items) + "]"

    def dot(self, a: str, b: str) -> str:
        return f"list_inner_product({a}, {b})"

    def days(self, late: str, early: str) -> str:
        return f"date_diff('day', {early}, {late})"

    def date(self, s: str) -> str:
        return f"CAST({s} AS DATE)"

    def instr(self, s: str, part: str) -> str:
        return f"instr({s}, {part})"

    def half_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def round(self, x: str, places: int) -> str:
        """Half away from zero, of the double as multiplied by the power of ten."""
        return f"round({x}, {places})"

    def doubles(self, a: str) -> str:
        return f"CAST({a} AS DOUBLE[])"

    def lower(self, x: str) -> str:
        return f"lower({x})"

    def md5(self, x: str) -> str:
        return f"md5({x})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def sum(self, a: str) -> str:
        """Sum of an array of whole numbers; 0 for an empty one."""
        return f"coalesce(list_sum({a}), 0)"

    def decode(self, s: str) -> str:
        """Percent-decoded; a plus sign stays."""
        return f"url_decode({s})"


class Spark(Duck):
    """Spark SQL spellings."""

    name = "spark"

    def lit(self, s: str) -> str:
        return "r" + ('"' + s + '"' if "'" in s else "'" + s + "'")

    def int(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def try_int(self, x: str) -> str:
        return f"CASE WHEN {self.like(x, '^[+-]?[0-9]+$')} THEN TRY_CAST({x} AS BIGINT) END"

    def month(self, d: str) -> str:
        return f"date_format({d}, 'yyyy-MM')"

    def like(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {self.lit(pattern)})"

    def like_col(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {pattern})"

    def extract(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def extract_all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, {group})"

    def count(self, s: str, pattern: str) -> str:
        return f"regexp_count({s}, {self.lit(pattern)})"

    def sub(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by)})"

    def split(self, s: str, sep: str) -> str:
        return f"split({s}, {self.lit(re.escape(sep) if not sep.isspace() else sep)}, -1)"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, CAST({i} AS INT))"

    def filter(self, a: str, cond: Callable[[str], str]) -> str:
        return f"filter({a}, x -> {cond('x')})"

    def transform(self, a: str, to: Callable[[str], str]) -> str:
        return f"transform({a}, x -> {to('x')})"

    def sequence(self, a: str, b: str) -> str:
        return f"CASE WHEN ({b}) >= ({a}) THEN sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST({n} AS INT))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"filter({a}, x -> NOT array_contains({b}, x))"

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def agg_join(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {self.lit(sep)}) WITHIN GROUP (ORDER BY {order})"

    def array(self, *items: str) -> str:
        return "array(" + ", ".join(items) + ")"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0e0, (s, p) -> s + p)"

    def days(self, late: str, early: str) -> str:
        return f"datediff({late}, {early})"

    def half_even(self, x: str) -> str:
        return f"bround({x}, 0)"

    def round(self, x: str, places: int) -> str:
        return f"(round(({x}) * 1e{places}, 0) / 1e{places})"

    def doubles(self, a: str) -> str:
        return f"CAST({a} AS ARRAY<DOUBLE>)"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def sum(self, a: str) -> str:
        return f"aggregate({a}, 0L, (s, x) -> s + x)"

    def decode(self, s: str) -> str:
        return f"coalesce(try_url_decode(replace({s}, '+', '%2B')), {s})"


DUCK, SPARK = Duck(), Spark()
_INPUT = re.compile(r"@(\w+)@")


@dataclass(frozen=True)
class Node:
    """An operator applied to inputs (nodes by name), or a table scan (no operator)."""

    name: str
    body: Callable[[Duck], str] | None = None
    inputs: dict[str, Node] = field(default_factory=dict)
    #: What Spark runs instead of the body, which then is the oracle's alone.
    kernel: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    #: The inputs that the kernel reads, where they are not those of the body.
    kernel_inputs: dict[str, Node] | None = None

    def spark(self, spark: SparkSession, sf_dir: str, seen: dict[int, DataFrame] | None = None) -> DataFrame:
        seen = {} if seen is None else seen
        if id(self) not in seen:
            if self.body is None:
                seen[id(self)] = table(spark, sf_dir, self.name)
            else:
                given = {n: x.spark(spark, sf_dir, seen) for n, x in (self.kernel_inputs or self.inputs).items()}
                seen[id(self)] = self.kernel(given) if self.kernel else run(spark, self.body(SPARK), given)
        return seen[id(self)]

    def duck(self) -> str:
        parts: list[str] = []
        names: dict[int, str] = {}

        def visit(node: Node) -> str:
            if node.body is None:
                return node.name
            if id(node) not in names:
                inside = {n: visit(x) for n, x in node.inputs.items()}
                sql = _INPUT.sub(lambda m: inside[m[1]], node.body(DUCK))
                names[id(node)] = f"n{len(parts)}_{node.name}"
                parts.append(f"{names[id(node)]} AS (\n{sql.strip()}\n)")
            return names[id(node)]

        top = visit(self)
        return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {top}"


def run(spark: SparkSession, body: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """Spark SQL over DataFrames given by name."""
    escaped = body.replace("{", "{{").replace("}", "}}")
    return spark.sql(_INPUT.sub(r"{\1}", escaped), **inputs)


class Operator:
    """``op(**inputs, **parameters)``: DataFrames give a DataFrame, nodes give a node."""

    def __init__(self, body: Callable[..., str]):
        functools.update_wrapper(self, body)
        self.body, self.name = body, body.__name__

    def __call__(self, *args, **kw):
        first, *names = inspect.signature(self.body).parameters
        kw |= dict(zip((n for n in self.inputs_in_order()), args, strict=False))
        given = {k: v for k, v in kw.items() if isinstance(v, (DataFrame, Node))}
        params = {k: v for k, v in kw.items() if k not in given}
        bound = functools.partial(self.body, **params)
        if all(isinstance(v, Node) for v in given.values()):
            return Node(self.name, bound, given)
        spark = next(iter(given.values())).sparkSession
        return run(spark, bound(SPARK), given)

    def inputs_in_order(self) -> list[str]:
        """Names of the inputs, in the order of their first use in the body."""
        return list(dict.fromkeys(_INPUT.findall(self.body(SPARK))))


def operator(body: Callable[..., str]) -> Operator:
    """Make an operator of ``body(dialect, **parameters) -> SQL``."""
    return Operator(body)


def scan(name: str) -> Node:
    return Node(name)


def e(x: float) -> str:
    """A number as a DOUBLE literal in both engines."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def values(rows: list[tuple], columns: str) -> str:
    """A constant table for a FROM clause."""

    def one(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else e(v) if isinstance(v, float) else str(v) if isinstance(v, int) else text(str(v))

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns}))"


def any_of(d: Duck, s: str, parts: list[str]) -> str:
    """Whether ``s`` contains one of the parts."""
    return "(" + " OR ".join(f"{d.instr(s, text(p))} > 0" for p in parts) + ")"
