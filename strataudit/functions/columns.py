"""Small expression helpers.

Expressions with nested lambdas are written as SQL text and parsed in one call (``F.expr``): built from
``Column`` objects, each operator would cost a round trip to the JVM. Functions whose names start with
``sql_`` take and give such text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strataudit.schemas import TRUE_WORDS

_EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def sql_text(value: str) -> str:
    """A raw string literal: backslashes stay as they are. Not for text with both kinds of quotes."""
    quote = "'" if "'" not in value else '"'
    if quote in value:
        raise ValueError("text with both kinds of quotes")
    return f"r{quote}{value}{quote}"


def sql_pattern(pattern: str) -> str:
    """A regular expression as a literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def sql_words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then worked out once.

    A lambda that mentions an outer expression works it out again for each element, so a value used
    inside another lambda is bound to a lambda variable first.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


#: Items of one strip of a list that is built in a fold.
STRIP = 128


def sql_list(dtype: str) -> str:
    """The empty list of a fold; see ``sql_append``."""
    return f"named_struct('strips', CAST(array() AS array<array<{dtype}>>), 'now', CAST(array() AS array<{dtype}>))"


def sql_append(state: str, item: str) -> str:
    """``item`` at the end of such a list. An array is copied when it grows, so items go to a short strip and full strips to a list."""
    full = f"size({state}.now) >= {STRIP}"
    return f"""named_struct('strips', if({full}, concat({state}.strips, array({state}.now)), {state}.strips),
        'now', concat(if({full}, slice({state}.now, 1, 0), {state}.now), array({item})))"""


def sql_listed(state: str) -> str:
    """All items of such a list as one array."""
    return f"concat(flatten({state}.strips), {state}.now)"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, {sql_pattern(_EDGE_SPACE)}, '')"


def strip_spaces(text: Column) -> Column:
    """Text without white space of any kind at either end (``trim`` removes blanks only)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip_spaces(text) == "", F.lit(True))


def is_empty(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True))


def to_bool(value: Column) -> Column:
    """True for true/1/yes in any case, padded or not; false for anything else and for null."""
    return F.coalesce(F.lower(strip_spaces(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))
