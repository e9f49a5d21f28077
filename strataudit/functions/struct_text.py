"""Struct text such as ``{owner={login=a, level=6}, tags=[x, y]}`` as rows and values.

A text is cut at the commas and the first equals sign that lie outside all brackets. Finding them
needs a running bracket depth, which one fold over the tokens of the text gives; pieces are then
slices of the token array, so nothing is copied while folding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataudit.functions.columns import sql_let, sql_pattern, sql_strip, sql_words
from strataudit.schemas import NULL_WORDS

_TOKEN = r"(?s)[{}\[\],=]|[^{}\[\],=]+"
_PAIRS = "array<struct<key:string,value:string>>"


def _is_null_word(text: str) -> str:
    return f"coalesce({sql_strip(text)} IN ({sql_words(NULL_WORDS)}), true)"


def _wrapped(text: str, opening: str, closing: str) -> str:
    return f"(startswith({text}, '{opening}') AND endswith({text}, '{closing}'))"


def _inner(text: str) -> str:
    """What lies between the first and the last character."""
    return sql_strip(f"substring({text}, 2, greatest(length({text}) - 2, 0))")


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {sql_pattern(_TOKEN)}, 0)"


def _cuts(tokens: str) -> str:
    """Token ranges between top-level commas, each with the place of its first top-level ``=``.

    ``eq`` is 0 where there is none. Unbalanced text can make the depth negative; only depth 0 cuts.
    """
    comma = "s.depth = 0 AND tok = ','"
    piece = "array(named_struct('first', s.first, 'last', s.pos, 'eq', s.eq))"
    return f"""aggregate({tokens},
        named_struct('depth', 0, 'pos', 0, 'first', 1, 'eq', 0,
                     'done', CAST(array() AS array<struct<first:int,last:int,eq:int>>)),
        (s, tok) -> named_struct(
            'depth', s.depth + CASE WHEN tok IN ('{{', '[') THEN 1 WHEN tok IN ('}}', ']') THEN -1 ELSE 0 END,
            'pos', s.pos + 1,
            'first', if({comma}, s.pos + 2, s.first),
            'eq', CASE WHEN {comma} THEN 0 WHEN s.depth = 0 AND tok = '=' AND s.eq = 0 THEN s.pos + 1 ELSE s.eq END,
            'done', if({comma}, concat(s.done, {piece}), s.done)),
        s -> concat(s.done, {piece}))"""


def _text_of(tokens: str, first: str, last: str) -> str:
    return f"array_join(slice({tokens}, {first}, greatest(({last}) - ({first}) + 1, 0)), '')"


def _pairs(text: str) -> str:
    """``array<struct<key, value>>`` of one struct text; a later pair of the same key wins."""
    body = sql_let("raw", sql_strip(text), f"if({_wrapped('raw', '{', '}')}, {_inner('raw')}, raw)")
    both = f"""transform(filter({_cuts('toks')}, c -> c.eq > 0), (c, i) -> named_struct(
        'key', {sql_strip(_text_of('toks', 'c.first', 'c.eq - 1'))}, 'i', i,
        'value', {sql_strip(_text_of('toks', 'c.eq + 1', 'c.last'))}))"""
    last_of_each = """transform(filter(ps, (p, i) -> NOT coalesce(get(ps, i + 1).key = p.key, false)),
        p -> named_struct('key', p.key, 'value', p.value))"""
    pairs = sql_let("toks", _tokens(body), sql_let("ps", f"sort_array(filter({both}, p -> p.key <> ''))", last_of_each))
    return f"if({_is_null_word(text)}, CAST(array() AS {_PAIRS}), {pairs})"


def _elements(text: str) -> str:
    """Items of a ``[a, b]`` text; an empty piece after the last comma does not count."""
    pieces = f"transform({_cuts('toks')}, c -> {_text_of('toks', 'c.first', 'c.last')})"
    kept = sql_let("ps", pieces, "if(element_at(ps, -1) = '', slice(ps, 1, size(ps) - 1), ps)")
    return sql_let("toks", _tokens(_inner(text)), f"transform({kept}, v -> {sql_strip('v')})")


def _entry(path: str, value: str) -> str:
    return f"""named_struct('path', {path}, 'value', if({_is_null_word(value)}, CAST(NULL AS string), {value}),
        'open', coalesce(NOT {_is_null_word(value)} AND ({_wrapped(value, '{', '}')} OR {_wrapped(value, '[', ']')}), false))"""


def _expand(e: str) -> str:
    """One level of an open entry. An empty container leaves one entry with its brackets."""
    pair_path = f"concat(if({e}.path = '', '', concat({e}.path, '.')), p.key)"
    item_path = f"concat({e}.path, '[', CAST(i AS string), ']')"
    level = f"""if({_wrapped(e + '.value', '[', ']')} AND {e}.path <> '',
        transform({_elements(e + '.value')}, (v, i) -> {_entry(item_path, 'v')}),
        transform({_pairs(e + '.value')}, p -> {_entry(pair_path, 'p.value')}))"""
    empty = f"array(named_struct('path', {e}.path, 'value', if(startswith({e}.value, '['), '[]', '{{}}'), 'open', false))"
    return sql_let("es", level, f"if(size(es) = 0 AND {e}.path <> '', {empty}, es)")


def _levels(entries: str, n: int) -> str:
    for _ in range(n):
        entries = f"""flatten(transform({entries}, e -> if(e.open, {_expand('e')},
            array(named_struct('path', e.path, 'value', e.value, 'open', e.open)))))"""
    return entries


def struct_pairs(df: DataFrame, key: str, text: str, levels: int = 4) -> DataFrame:
    """Rows ``(key, path, value)`` for every leaf of the struct texts in column ``text``.

    Paths look like ``a.b[0].c``. ``levels`` nested levels are opened in one pass inside the row, with
    no shuffle. Only a text with at least that many opening brackets can nest deeper; what is still
    closed in those goes through another pass, until nothing is left.
    """
    def opened(rows: DataFrame, start: str) -> DataFrame:
        return rows.select(key, F.inline(F.expr(_levels(start, levels))))

    whole = f"array(named_struct('path', '', 'value', `{text}`, 'open', true))"
    again = "array(named_struct('path', path, 'value', value, 'open', true))"
    source = df.filter(F.col(text).isNotNull())
    result = opened(source, whole)
    brackets = F.regexp_count(F.col(text), F.lit(r"[{\[]"))
    deeper = opened(source.filter(brackets > levels), whole).filter("open")
    result = result.filter("NOT open")
    while not deeper.isEmpty():
        next_pass = opened(deeper, again)
        result = result.unionByName(next_pass.filter("NOT open"))
        deeper = next_pass.filter("open")
    return result.select(key, "path", "value")


def owner(text: str) -> Column:
    """Owner from the struct text or plain name in column ``text``.

    In struct text ``owner_login`` counts if it is present, even with a null value, then ``login``.
    """
    def value(name: str) -> str:
        hit = f"get(filter(found, p -> p.key = '{name}'), 0).value"
        return f"if({_is_null_word(hit)}, CAST(NULL AS string), {hit})"

    def present(name: str) -> str:
        return f"exists(found, p -> p.key = '{name}')"

    pick = f"""CASE WHEN {present('owner_login')} THEN {value('owner_login')}
        WHEN {present('login')} THEN {value('login')} ELSE '' END"""
    return F.expr(f"""CASE WHEN coalesce({text} = '', true) THEN '' WHEN NOT startswith({text}, '{{') THEN {text}
        ELSE {sql_let('found', _pairs(text), pick)} END""")
