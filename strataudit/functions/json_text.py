"""JSON text as ``json.dumps`` writes it, and its length without writing it. All helpers give SQL text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from strataudit.functions.columns import sql_let, sql_pattern


def _escape_non_ascii(text: str) -> str:
    r"""Each character outside blank..tilde as ``\uXXXX``, in surrogate pairs where needed."""
    code = f"regexp_replace(lower(hex(encode(r, 'UTF-16BE'))), '(.{{4}})', {sql_pattern(chr(92) * 2 + 'u$1')})"
    return f"""array_join(transform(regexp_extract_all({text}, {sql_pattern('(?s)[ -~]+|[^ -~]')}, 0),
        r -> if(rlike(r, {sql_pattern(chr(92) + 'A[ -~]')}), r, {code})), '')"""


def _string(text: str) -> str:
    quoted = sql_let("j", f"to_json(array({text}))", "substring(j, 2, length(j) - 2)")
    return sql_let("q", quoted, f"if(rlike(q, '[^ -~]'), {_escape_non_ascii('q')}, q)")


def _dumps(value: str, dtype: T.DataType, indent: int | None, level: int) -> str:
    pad = lambda n: "" if indent is None else r"\n" + " " * (indent * n)
    comma = ", " if indent is None else ","
    if isinstance(dtype, T.StructType):
        pieces = []
        for i, f in enumerate(dtype.fields):
            head = ("{" if i == 0 else comma) + pad(level + 1) + f'"{f.name}": '
            pieces += [f"'{head}'", _dumps(f"{value}.{f.name}", f.dataType, indent, level + 1)]
        text = f"concat({', '.join(pieces)}, '{pad(level)}}}')"
    elif isinstance(dtype, T.ArrayType):
        item = _dumps(f"v{level}", dtype.elementType, indent, level + 1)
        text = f"""if(size({value}) = 0, '[]', concat('[{pad(level + 1)}',
            array_join(transform({value}, v{level} -> {item}), '{comma}{pad(level + 1)}'), '{pad(level)}]'))"""
    elif isinstance(dtype, T.StringType):
        text = _string(value)
    else:
        text = f"CAST({value} AS string)"
    return f"if({value} IS NULL, 'null', {text})"


def json_dumps(value: str, dtype: T.DataType, indent: int | None = None) -> Column:
    """The value as Python's ``json.dumps(value, indent=indent)`` would print it."""
    return F.expr(_dumps(value, dtype, indent, 0))


def sql_json_open(value: str, dtype: T.StructType, level: int, indent: int = 2) -> str:
    """The text of a struct up to its last member, an array, whose name ends the text. ``level`` is the depth of the struct."""
    pad = r"\n" + " " * (indent * (level + 1))
    members = [f"""'"{f.name}": ', {_dumps(f"{value}.{f.name}", f.dataType, indent, level + 1)}, ',{pad}'""" for f in dtype.fields[:-1]]
    return f"""concat('{{{pad}', {', '.join(members)}, '"{dtype.fields[-1].name}": ')"""


def sql_json(value: str, dtype: T.DataType, level: int, indent: int = 2) -> str:
    """The whole text of a value at a depth."""
    return _dumps(value, dtype, indent, level)


def sql_json_bytes(value: str, name: str = "js") -> str:
    """Bytes of the compact JSON of a struct once everything outside blank..tilde is escaped."""
    count = lambda chars: f"regexp_count({name}, {sql_pattern(chars)})"
    extra = (rf"4 * {count(r'[\x{80}-\x{7ff}]')} + 3 * {count(r'[\x{800}-\x{ffff}]')}"
             rf" + 8 * {count(r'[\x{10000}-\x{10ffff}]')} + 5 * {count(chr(92) + 'x7f')}")
    odd = sql_pattern(r"[^\x00-\x7e]")
    return sql_let(name, f"to_json({value}, map('ignoreNullFields', 'false'))",
                   f"CAST(octet_length({name}) + if(rlike({name}, {odd}), {extra}, 0) AS bigint)")


def separators(n_fields: int) -> int:
    """Blanks that ``json.dumps`` puts after the colons and commas of an object of so many fields."""
    return 2 * n_fields - 1
