"""The dialect's functions as SQL expressions over their arguments.

``EXPRESSIONS`` maps a name to a builder from argument texts to Spark SQL text; :func:`call` gives the same as a Column.
Everything stays inside the JVM's expressions: no Python function runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., str]
#: Which built-in of Spark means the same under another name.
SAME = {
    "array_concat": "concat", "array_cat": "concat", "array_has": "array_contains", "list_contains": "array_contains", "array_has_any": "arrays_overlap",
    "array_element": "try_element_at", "array_extract": "try_element_at", "list_element": "try_element_at", "array_indexof": "array_position", "array_to_string": "array_join",
    "list_distinct": "array_distinct", "list_sort": "array_sort", "make_array": "array", "make_list": "array", "row": "struct",
    "starts_with": "startswith", "ends_with": "endswith", "strpos": "instr", "substr_index": "substring_index", "pow": "power", "today": "current_date",
    "to_unixtime": "unix_timestamp", "to_timestamp_seconds": "timestamp_seconds", "to_timestamp_millis": "timestamp_millis", "to_timestamp_micros": "timestamp_micros",
    "arrow_typeof": "typeof", "unnest": "explode", "approx_distinct": "approx_count_distinct", "approx_median": "median", "var": "var_samp", "var_population": "var_pop", "var_sample": "var_samp",
}


def _substr(s: str, start: str, n: str | None = None) -> str:
    """Positions before the first count against the length, and none counts from the end."""
    if n is None:
        return f"substring({s}, greatest({start}, 1))"
    return f"substring({s}, greatest({start}, 1), greatest(least({start}, 1) + ({n}) - 1, 0))"


def _first_match(s: str, pattern: str, by: str, flags: str = "''") -> str:
    """Only the first match is replaced unless the flags have g; \\1 names a group as $1 does."""
    groups = rf"regexp_replace({by}, '\\\\([0-9])', '\\$$1')"
    inner = f"if({flags} LIKE '%i%', concat('(?i)', {pattern}), {pattern})"
    found = f"regexp_instr({s}, {inner})"
    hit = f"regexp_substr({s}, {inner})"
    # an assertion about what follows the match may fail on the match alone; then the text stays
    one = f"concat(substring({s}, 1, {found} - 1), regexp_replace({hit}, {inner}, {groups}), substring({s}, {found} + char_length({hit})))"
    return f"CASE WHEN {flags} LIKE '%g%' THEN regexp_replace({s}, {inner}, {groups}) WHEN {found} = 0 THEN {s} ELSE {one} END"


def _match(s: str, pattern: str, flags: str = "''") -> str:
    """The first match's groups, or the match itself where a literal pattern has none."""
    text = pattern[1:-1].replace("\\\\", "\\") if pattern[:1] == pattern[-1:] == "'" else ""
    n = re.compile(text).groups
    inner = f"if({flags} LIKE '%i%', concat('(?i)', {pattern}), {pattern})"
    parts = [f"regexp_extract({s}, {inner}, {i})" for i in (range(1, n + 1) if n else [0])]
    return f"if(regexp_like({s}, {inner}), array({', '.join(parts)}), NULL)"


def _digest(x: str, kind: str) -> str:
    name = kind.strip("'").lower()
    if name == "md5":
        return f"unhex(md5({x}))"
    if name not in ("sha224", "sha256", "sha384", "sha512"):
        raise ValueError(f"digest {name} is not supported")
    return f"unhex(sha2({x}, {name[3:]}))"


def _gcd(a: str, b: str) -> str:
    step = "if(t.b = 0, t, named_struct('a', t.b, 'b', t.a % t.b))"
    return f"aggregate(sequence(1, 92), named_struct('a', abs(CAST({a} AS BIGINT)), 'b', abs(CAST({b} AS BIGINT))), (t, i) -> {step}, t -> t.a)"


def _trunc(x: str, n: str = "0") -> str:
    scaled = f"(abs(CAST({x} AS DOUBLE)) * power(10, {n}))"
    return f"(sign({x}) * floor({scaled}) / power(10, {n}))"


def _date_bin(seconds: str, ts: str, origin: str = "TIMESTAMP_NTZ '1970-01-01 00:00:00'") -> str:
    micros = lambda t: f"unix_micros(CAST({t} AS TIMESTAMP_LTZ))"
    behind = f"pmod({micros(ts)} - {micros(origin)}, CAST({seconds} AS BIGINT) * 1000000)"
    return f"CAST(timestamp_micros({micros(ts)} - {behind}) AS TIMESTAMP_NTZ)"


def _remove_first(a: str, x: str, n: str = "1") -> str:
    count = f"aggregate(slice({a}, 1, i + 1), 0, (c, y) -> c + if(y <=> {x}, 1, 0))"
    return f"filter({a}, (e, i) -> NOT (e <=> {x} AND {count} <= {n}))"


def _replace_first(a: str, x: str, y: str, n: str = "1") -> str:
    count = f"aggregate(slice({a}, 1, i + 1), 0, (c, z) -> c + if(z <=> {x}, 1, 0))"
    return f"transform({a}, (e, i) -> if(e <=> {x} AND {count} <= {n}, {y}, e))"


#: What a percent sign and a letter mean in a time's pattern, in the letters of Spark's.
TIME_FIELDS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "b": "MMM", "h": "MMM", "B": "MMMM", "d": "dd", "e": "d", "j": "DDD", "a": "EEE", "A": "EEEE",
    "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS", ".f": ".SSSSSS", ".3f": ".SSS", ".6f": ".SSSSSS",
    "p": "a", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "T": "HH:mm:ss", "R": "HH:mm", "Z": "zzz", "z": "xx", ":z": "xxx", "%": "'%'",
}


def _time_pattern(given: str) -> str:
    """A literal pattern with percent signs in Spark's letters; any other pattern is Spark's already."""
    if not (given[:1] == given[-1:] == "'" and "%" in given):
        return given
    out, plain = "", ""
    for field, other in re.findall(r"%(\.?[369]?f|:z|.)|([^%]+|%$)", given[1:-1]):
        if field and field not in TIME_FIELDS:
            raise ValueError(f"time pattern %{field} is not supported")
        if field:
            out += (f"''{plain}''" if plain else "") + TIME_FIELDS[field].replace("'", "''")
            plain = ""
        elif other.isalpha() or re.search("[A-Za-z]", other):
            plain += other
        else:
            out += other
    return f"'{out}" + (f"''{plain}''" if plain else "") + "'"


def _series(a: str, b: str, step: str = "1") -> str:
    """From a to b by step, both in it; empty where the step leads away from b."""
    ahead = ">=" if step.strip().startswith("-") else "<="
    return f"if({a} {ahead} {b}, sequence({a}, {b}, {step}), array())"


EXPRESSIONS: dict[str, Builder] = {
    **{name: (lambda *a, f=spark: f"{f}({', '.join(a)})") for name, spark in SAME.items()},
    "concat": lambda *a: f"concat_ws('', {', '.join(a)})",
    "substr": _substr,
    "substring": _substr,
    "trunc": _trunc,
    "gcd": _gcd,
    "lcm": lambda a, b: f"CASE WHEN ({a}) = 0 OR ({b}) = 0 THEN CAST(0 AS BIGINT) ELSE abs(CAST({a} AS BIGINT) * ({b})) div {_gcd(a, b)} END",
    "iszero": lambda x: f"(({x}) = 0)",
    "to_hex": lambda x: f"lower(hex({x}))",
    "regexp_match": lambda *a: _match(*a),
    "regexp_replace": _first_match,
    "date_bin": _date_bin,
    "dow": lambda t: f"(dayofweek({t}) - 1)",
    "epoch": lambda t: f"(unix_micros(CAST({t} AS TIMESTAMP_LTZ)) / 1e6)",
    "digest": _digest,
    "to_timestamp_nanos": lambda x: f"timestamp_micros(({x}) div 1000)",
    "to_local_time": lambda t: f"CAST({t} AS TIMESTAMP_NTZ)",
    "sha224": lambda x: f"unhex(sha2({x}, 224))",
    "sha256": lambda x: f"unhex(sha2({x}, 256))",
    "sha384": lambda x: f"unhex(sha2({x}, 384))",
    "sha512": lambda x: f"unhex(sha2({x}, 512))",
    "array_has_all": lambda a, need: f"(size(array_except({need}, {a})) = 0)",
    "array_length": lambda a: f"nullif(size({a}), 0)",
    "array_empty": lambda a: f"(size({a}) = 0)",
    "empty": lambda a: f"(size({a}) = 0)",
    "array_pop_front": lambda a: f"slice({a}, 2, greatest(size({a}) - 1, 0))",
    "array_pop_back": lambda a: f"slice({a}, 1, greatest(size({a}) - 1, 0))",
    "array_slice": lambda a, i, j: f"slice({a}, greatest({i}, 1), greatest(least({j}, size({a})) - greatest({i}, 1) + 1, 0))",
    "array_positions": lambda a, x: f"transform(filter(transform({a}, (e, i) -> named_struct('e', e, 'i', i + 1)), s -> s.e <=> {x}), s -> s.i)",
    "array_remove": _remove_first,
    "array_remove_n": lambda a, x, n: _remove_first(a, x, n),
    "array_remove_all": lambda a, x: f"filter({a}, e -> NOT e <=> {x})",
    "array_replace": _replace_first,
    "array_replace_n": lambda a, x, y, n: _replace_first(a, x, y, n),
    "array_replace_all": lambda a, x, y: f"transform({a}, e -> if(e <=> {x}, {y}, e))",
    "array_resize": lambda a, n, x="NULL": f"concat(slice({a}, 1, least(size({a}), {n})), array_repeat({x}, greatest({n} - size({a}), 0)))",
    "array_reverse": lambda a: f"reverse({a})",
    "array_any_value": lambda a: f"try_element_at(filter({a}, e -> e IS NOT NULL), 1)",
    "array_distance": lambda a, b: f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> CAST((x - y) * (x - y) AS DOUBLE)), 0d, (s, v) -> s + v))",
    "array_dims": lambda a: f"array(size({a}))",
    "array_ndims": lambda a: f"(char_length(typeof({a})) - char_length(replace(typeof({a}), 'array<', 'array'))) ",
    "generate_series": _series,
    "range": lambda a, b=None, *step: f"filter({_series(*((a, b) if b else ('0', a)), *step)}, x -> NOT x <=> {b or a})",
    "string_to_array": lambda s, d: f"split({s}, concat('\\\\Q', {d}, '\\\\E'))",
    "make_map": lambda *a: f"map({', '.join(a)})",
    "map_extract": lambda m, k: f"array(try_element_at({m}, {k}))",
    "get_field": lambda s, f: f"({s})[{f}]",
    "to_char": lambda t, f: f"date_format({t}, {_time_pattern(f)})",
    "date_format": lambda t, f: f"date_format({t}, {_time_pattern(f)})",
    "to_timestamp": lambda x, *f: f"CAST(coalesce({', '.join(f'try_to_timestamp({x}, {_time_pattern(p)})' for p in f)}) AS TIMESTAMP_NTZ)" if f else f"CAST({x} AS TIMESTAMP_NTZ)",
    "to_date": lambda x, *f: f"coalesce({', '.join(f'CAST(try_to_timestamp({x}, {_time_pattern(p)}) AS DATE)' for p in f)})" if f else f"CAST({x} AS DATE)",
    "arrow_cast": lambda x, kind: f"CAST({x} AS {ARROW_TYPES[kind.strip(chr(39))]})",
    "approx_percentile_cont": lambda x, p: f"approx_percentile({x}, {p}, 10000)",
    "approx_percentile_cont_with_weight": lambda x, w, p: f"percentile({x}, {p}, {w})",
    "nanvl": lambda x, y: f"nanvl({x}, {y})",
}
#: Array functions have a second name each.
EXPRESSIONS |= {"list_" + n[6:]: f for n, f in EXPRESSIONS.items() if n.startswith("array_") and "list_" + n[6:] not in EXPRESSIONS}
EXPRESSIONS |= {
    f"list_{n}": (lambda *a, f=f"array_{n}": f"{f}({', '.join(a)})")
    for n in ("append", "prepend", "position", "union", "intersect", "except", "join", "repeat", "contains", "distinct", "sort")
    if f"list_{n}" not in EXPRESSIONS
}
#: Type names of the columnar format and their Spark types; unsigned types take the next wider one.
ARROW_TYPES = {
    "Boolean": "BOOLEAN", "Int8": "TINYINT", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "UInt8": "SMALLINT", "UInt16": "INT",
    "UInt32": "BIGINT", "UInt64": "DECIMAL(20,0)", "Float32": "FLOAT", "Float64": "DOUBLE", "Utf8": "STRING", "LargeUtf8": "STRING",
    "Date32": "DATE", "Date64": "TIMESTAMP_NTZ", "Binary": "BINARY",
}


def expression(name: str, *arguments: str) -> str:
    return EXPRESSIONS[name.lower()](*arguments)


def call(name: str, *arguments: str | int | float) -> Column:
    """A Column of the named function; arguments are SQL texts (numbers as they are)."""
    return F.expr(expression(name, *map(str, arguments)))
