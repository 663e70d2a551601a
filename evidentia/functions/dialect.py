"""One spelling of SQL expressions for two engines.

Operators are written as SQL over named relations. Spark runs them; DuckDB runs the same relational
text as an oracle. This class spells the functions that the two engines name differently.
"""

from __future__ import annotations

from collections.abc import Callable


class Dialect:
    """Spark's spelling."""

    name = "spark"

    def lit(self, text: str) -> str:
        if "'" not in text:
            return f"r'{text}'" if "\\" in text else f"'{text}'"
        if '"' not in text:
            return f'r"{text}"' if "\\" in text else f'"{text}"'
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def fn(self, var: str, body: str) -> str:
        return f"{var} -> {body}"

    def find_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        """Every match; ``by`` holds no group reference."""
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def swap(self, x: str, pattern: str, by: str) -> str:
        """Every match; groups are written $1."""
        return self.replace(x, pattern, by)

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.lit(pattern)})"

    def filter(self, xs: str, var: str, body: str) -> str:
        return f"filter({xs}, {self.fn(var, body)})"

    def map(self, xs: str, var: str, body: str) -> str:
        return f"transform({xs}, {self.fn(var, body)})"

    def let(self, x: str, var: str, body: str) -> str:
        """body with var bound to x: an optimiser that inlines columns can't move x into an inner lambda."""
        return f"element_at({self.map(self.array(x), var, body)}, 1)"

    def fold(self, xs: str, zero: str, acc: str, var: str, body: str) -> str:
        return f"aggregate({xs}, {zero}, ({acc}, {var}) -> {body})"

    def any(self, xs: str, var: str, body: str) -> str:
        return f"exists({xs}, {self.fn(var, body)})"

    def seq(self, a: str, b: str) -> str:
        """a to b, both included; empty if b is less."""
        return f"(case when {b} >= {a} then sequence({a}, {b}) else cast(array() as array<int>) end)"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def none(self) -> str:
        return "cast(array() as array<string>)"

    def distinct(self, xs: str) -> str:
        return f"array_distinct({xs})"

    def distinct_in_order(self, xs: str) -> str:
        return f"array_distinct({xs})"

    def concat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def union(self, *xs: str) -> str:
        return self.distinct(self.concat(*xs))

    def inter(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def sort(self, xs: str) -> str:
        return f"array_sort({xs})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {self.lit(sep)})"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})"

    def at(self, xs: str, i: str) -> str:
        """From 1; null beyond the end."""
        return f"try_element_at({xs}, {i})"

    def slice(self, xs: str, start: str, n: str) -> str:
        return f"slice({xs}, {start}, {n})"

    def tail(self, xs: str, n: int) -> str:
        return f"slice({xs}, greatest(1, size({xs}) - {n - 1}), {n})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(sep)})"

    def trim(self, x: str, chars: str) -> str:
        return f"trim(both {self.lit(chars)} from {x})"

    def contains(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"endswith({x}, {y})"

    def ilike(self, x: str, pattern: str) -> str:
        return f"({x} ilike {pattern})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def explode(self, source: str, xs: str, name: str, keep: str) -> str:
        """keep: columns of source; name: the element."""
        return f"select {keep}, {name} from {source} lateral view explode({xs}) as {name}"

    def explode_at(self, source: str, xs: str, name: str, keep: str) -> str:
        """The same with the element's place, from 1, as <name>_at."""
        return f"select {keep}, {name}, {name}_0 + 1 as {name}_at from {source} lateral view posexplode({xs}) as {name}_0, {name}"

    def collect(self, x: str, order: str) -> str:
        """Elements in ascending order of ``order``, null elements left out."""
        return f"transform(array_sort(collect_list(case when {x} is not null then named_struct('o', {order}, 'x', {x}) end)), s -> s.x)"

    def collect_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def count_if(self, x: str) -> str:
        return f"count_if({x})"

    def first_by(self, x: str, order: str) -> str:
        return f"min_by({x}, {order})"

    def double(self, x: str) -> str:
        return f"cast({x} as double)"

    def json_text(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def char(self, code: int) -> str:
        return f"chr({code})"

    def doubles(self, x: str) -> str:
        return f"cast({x} as array<double>)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"

    # ---- built on the above ----

    def strings(self, items) -> str:
        return self.array(*(self.lit(x) for x in items))

    def one_of(self, x: str, items) -> str:
        return f"{x} in ({', '.join(self.lit(i) for i in sorted(items))})"

    def round(self, x: str, n: int = 3) -> str:
        """Half up, by the same double operations in both engines."""
        return f"(floor(({x}) * {10**n}D + 0.5D) / {10**n}D)".replace("D", "e0")

    def ratio(self, a: str, b: str) -> str:
        return f"(case when {b} = 0 then 0e0 else {self.double(a)} / {b} end)"

    def squeeze(self, x: str) -> str:
        return f"trim({self.replace(x, r'[ \t\n\r\f]+', ' ')})"

    def not_null(self, xs: str) -> str:
        return self.filter(xs, "nn", "nn is not null")

    def least(self, *x: str) -> str:
        return f"least({', '.join(x)})"


class Duck(Dialect):
    name = "duckdb"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def fn(self, var: str, body: str) -> str:
        return f"lambda {var}: {body}"

    def find_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def swap(self, x: str, pattern: str, by: str) -> str:
        return self.replace(x, pattern, by.replace("$", "\\"))

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def filter(self, xs: str, var: str, body: str) -> str:
        return f"list_filter({xs}, {self.fn(var, body)})"

    def map(self, xs: str, var: str, body: str) -> str:
        return f"list_transform({xs}, {self.fn(var, body)})"

    def let(self, x: str, var: str, body: str) -> str:
        return f"list_extract({self.map(self.array(x), var, body)}, 1)"

    def fold(self, xs: str, zero: str, acc: str, var: str, body: str) -> str:
        return f"list_reduce({xs}, lambda {acc}, {var}: {body}, {zero})"

    def any(self, xs: str, var: str, body: str) -> str:
        return f"(len(list_filter({xs}, {self.fn(var, body)})) > 0)"

    def seq(self, a: str, b: str) -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1)"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def none(self) -> str:
        return "cast([] as varchar[])"

    def distinct(self, xs: str) -> str:
        return f"list_distinct({xs})"

    def distinct_in_order(self, xs: str) -> str:
        return f"list_filter({xs}, lambda du, di: list_position({xs}, du) = di)"

    def concat(self, *xs: str) -> str:
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def inter(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"list_distinct(list_filter({a}, lambda mm: not list_contains({b}, mm)))"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def sort(self, xs: str) -> str:
        return f"list_sort({xs})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_to_string({xs}, {self.lit(sep)})"

    def has(self, xs: str, x: str) -> str:
        return f"list_contains({xs}, {x})"

    def at(self, xs: str, i: str) -> str:
        return f"list_extract({xs}, {i})"

    def slice(self, xs: str, start: str, n: str) -> str:
        return f"list_slice({xs}, {start}, {start} + {n} - 1)"

    def tail(self, xs: str, n: int) -> str:
        return f"list_slice({xs}, greatest(1, len({xs}) - {n - 1}), len({xs}))"

    def split(self, x: str, sep: str) -> str:
        return f"string_split_regex({x}, {self.lit(sep)})"

    def trim(self, x: str, chars: str) -> str:
        return f"trim({x}, {self.lit(chars)})"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"ends_with({x}, {y})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def explode(self, source: str, xs: str, name: str, keep: str) -> str:
        return f"select {keep}, unnest({xs}) as {name} from {source}"

    def explode_at(self, source: str, xs: str, name: str, keep: str) -> str:
        return f"select {keep}, unnest({xs}) as {name}, generate_subscripts({xs}, 1) as {name}_at from {source}"

    def collect(self, x: str, order: str) -> str:
        return f"coalesce(list({x} order by {order}) filter (where {x} is not null), [])"

    def collect_set(self, x: str) -> str:
        return f"list_sort(coalesce(list(distinct {x}) filter (where {x} is not null), []))"

    def first_by(self, x: str, order: str) -> str:
        return f"arg_min({x}, {order})"

    def json_text(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def doubles(self, x: str) -> str:
        return f"cast({x} as double[])"

    def dot(self, a: str, b: str) -> str:
        return f"list_reduce(list_transform(list_zip({a}, {b}), lambda pq: pq[1] * pq[2]), lambda s, v: s + v, 0e0)"


SPARK, DUCK = Dialect(), Duck()


class Pipe:
    """Named relations, each a SELECT over tables and earlier relations."""

    def __init__(self, d: Dialect) -> None:
        self.d = d
        self.parts: dict[str, str] = {}
        self.kept: set[str] = set()
        self.made: dict[str, Callable] = {}

    def add(self, name: str, sql: str) -> str:
        if name in self.parts and self.parts[name] != sql:
            raise ValueError(f"relation {name} stands for something else")
        self.parts[name] = sql
        return name

    def make(self, name: str, f: Callable) -> str:
        """A relation that Spark makes otherwise than SQL says it: f(relation name -> DataFrame) -> DataFrame."""
        self.made[name] = f
        return self.add(name, "")

    def keep(self, name: str) -> str:
        """Mark a relation that several others read: Spark computes it once."""
        self.kept.add(name)
        return name

    def columns(self, name: str, source: str, keep: str = "*", **new: str) -> str:
        return self.add(name, f"select {keep}{''.join(f', {x} as {k}' for k, x in new.items())} from {source}")

    def sql(self, final: str) -> str:
        return "with " + ",\n".join(f"{k} as ({v})" for k, v in self.parts.items()) + "\n" + final
