"""MAJOR.MINOR.PATCH versions as comparable arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strataudit.functions.columns import sql_let, sql_pattern, sql_strip


def sql_semver(text: str) -> str:
    """``array<decimal(38,0)>`` of three non-negative numbers, or null for any other text."""
    number = sql_let("w", sql_strip("part"), f"""if(rlike(w, {sql_pattern(r'\A[+-]?[0-9]+(_[0-9]+)*\z')}),
        try_cast(regexp_replace(w, '_', '') AS decimal(38,0)), NULL)""")
    parts = f"transform(split({sql_strip(text)}, {sql_pattern(chr(92) + '.')}), part -> {number})"
    return sql_let("ns", parts, "if(size(ns) = 3 AND forall(ns, n -> coalesce(n >= 0, false)), ns, NULL)")


def compare_versions(left: str, right: str) -> Column:
    """-1, 0 or 1 for two columns; a text that is no version compares as equal."""
    return F.expr(sql_let("v", f"named_struct('a', {sql_semver(left)}, 'b', {sql_semver(right)})",
                          "CASE WHEN v.a < v.b THEN -1 WHEN v.a > v.b THEN 1 ELSE 0 END"))
