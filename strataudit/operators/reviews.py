"""Review texts: gate sections, tables, findings, and the change between two reviews.

All parsing happens inside the row with built-in expressions, so a review costs no shuffle; only the
reports over many reviews group rows. A text is cut with ``split`` and ``regexp_extract_all`` of the same
pattern, which give the pieces between the matches and the matches, in order and without loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataudit.functions.columns import is_blank, sql_append, sql_let, sql_list, sql_listed, sql_pattern, sql_strip, sql_words

# The patterns that findings are defined by. The flags give line feeds alone the meaning
# of line ends, anchors per line, and Unicode character classes.
FLAGS = "(?dmU)"
GATE_HEADING = r"^#{2,3}\s+[Gg][Aa][Tt][Ee]\s+(\d)\s*[:\-—]?\s*(.*)"
TABLE_HEADING = r"^#{2,3}\s+(?:Data\s+Store|Table)\s*[:\-—]\s*(.*)"
TABLE_INLINE = r"""(?:[Ii]n|[Ff]or|[Tt]able|[Dd]ata\s+[Ss]tore)\s+[:\-]?\s*[`"']?([A-Za-z][A-Za-z0-9_\-]+)[`"']?"""
ACTION_ITEM = r"^\s*\d+[\.\)]\s*(.*?\[(?:HIGH|MEDIUM|LOW)\].*)"
CHECKLIST_ITEM = r"^\s*(?:\d+[\.\)]|-)\s*\[([xX ])\]\s*(.*)"
SEVERITY = r"\[(HIGH|MEDIUM|LOW)\]"
NOISE_WORDS = ("the", "this", "that", "and", "for", "not", "with", "from")
GATE_TITLES = {
    1: "Completion Check",
    2: "External Findings",
    3: "Sensitive Data Validation",
    4: "Evidence of Controls",
    5: "Compliance Onboarding",
}

_GATE = FLAGS + GATE_HEADING
_HEADING = "(?i)" + FLAGS + TABLE_HEADING
_INLINE = FLAGS + TABLE_INLINE
_ACTION = "(?i)" + FLAGS + ACTION_ITEM
_CHECK = FLAGS + CHECKLIST_ITEM
_SEVERITY = "(?iU)" + SEVERITY
# A table heading at the very end of a text that could still take its name from what follows.
_OPEN_HEADING = "(?i)" + FLAGS + r"^#{2,3}\s+(?:Data\s+Store|Table)\s*(?:[:\-—]\s*)?\z"


def _all(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({text}, {sql_pattern(pattern)}, {group})"


def _name(text: str) -> str:
    quotes = "concat('`', chr(34), chr(39))"
    return f"btrim({sql_strip(text)}, {quotes})"


def _sections(content: str) -> str:
    """``array<struct<gate, section>>`` of gates 1-5 that occur, in gate order; the last of each counts."""
    found = "transform(c.gates, (g, i) -> named_struct('gate', try_cast(g AS int), 'section', get(c.pieces, i + 1)))"
    each = ", ".join(_last_of_gate("fs", n) for n in GATE_TITLES)
    cut = sql_let("fs", found, f"filter(array({each}), s -> s IS NOT NULL)")
    none = "CAST(array() AS array<struct<gate:int,section:string>>)"
    both = f"named_struct('gates', {_all(content, _GATE, 1)}, 'pieces', split({content}, {sql_pattern(_GATE)}, -1))"
    return sql_let("c", both, f"if(size(c.gates) = 0, {none}, {cut})")


def _last_of_gate(found: str, gate: int) -> str:
    return f"try_element_at(filter({found}, s -> s.gate = {gate}), -1)"


def _tables(section: str) -> str:
    """Table names in a section: from headings, then from the running text."""
    headed = f"""if(contains({section}, '#'), filter(transform({_all(section, _HEADING, 1)}, n -> {_name('n')}),
        n -> n <> ''), CAST(array() AS array<string>))"""
    inline = f"""filter(transform({_all(section, _INLINE, 1)}, n -> {_name('n')}),
        n -> length(n) > 2 AND lower(n) NOT IN ({sql_words(NOISE_WORDS)}))"""
    return f"array_distinct(concat({headed}, {inline}))"


def _contexts(section: str, pattern: str, matches: str) -> str:
    """For each of the ``matches`` of ``pattern``, the name in the nearest table heading above it, or ''.

    Only the text before a match counts. The text is walked in strips, each from one match to the next;
    a heading still open at the end of a strip is carried into the next, where it takes its name.
    """
    strips = f"transform({matches}, (m, i) -> concat(if(i > 0, get({matches}, i - 1), ''), get(gaps, i)))"
    carried = f"if(i > 0, regexp_extract(get(st, i - 1), {sql_pattern(_OPEN_HEADING)}, 0), '')"
    names = f"transform(st, (strip, i) -> try_element_at({_all(f'concat({carried}, strip)', _HEADING, 1)}, -1))"
    nearest = f"""aggregate({sql_let('st', strips, names)}, named_struct('now', '', 'known', {sql_list('string')}),
        (acc, n) -> named_struct('now', coalesce(n, acc.now), 'known', {sql_append('acc.known', 'coalesce(n, acc.now)')}),
        acc -> transform({sql_listed('acc.known')}, n -> {_name('n')}))"""
    walk = sql_let("gaps", f"split({section}, {sql_pattern(pattern)}, -1)", nearest)
    return f"if(contains({section}, '#') AND size({matches}) > 0, {walk}, transform({matches}, m -> ''))"


def _item(gate: str, severity: str, description: str, table: str) -> str:
    return f"named_struct('gate', {gate}, 'severity', {severity}, 'description', {description}, 'table', {table})"


def _without_severity(text: str) -> str:
    rest = f"regexp_replace({text}, {sql_pattern(_SEVERITY)}, '')"
    return f"btrim({sql_strip(rest)}, '- :')"


def _severity(text: str) -> str:
    return f"upper(regexp_extract({text}, {sql_pattern(_SEVERITY)}, 1))"


def _if_bracketed(section: str, found: str) -> str:
    """Both kinds of items need a bracket; a section without one is not searched."""
    none = "CAST(array() AS array<struct<gate:int,severity:string,description:string,table:string>>)"
    return f"if(contains({section}, '['), {found}, {none})"


def _found(section: str, pattern: str, each: str) -> str:
    """``each`` over the pairs (match, context) of a pattern, which is looked for once; a match is taken apart by itself afterwards."""
    both = sql_let("contexts", _contexts(section, pattern, "ms"), "transform(ms, (m, i) -> named_struct('m', m, 'table', get(contexts, i)))")
    return _if_bracketed(section, sql_let("ms", _all(section, pattern, 0), sql_let("pairs", both, each)))


def _action_items(section: str, gate: str) -> str:
    """Numbered lines that carry a severity."""
    line = f"regexp_extract(p.m, {sql_pattern(_ACTION)}, 1)"
    item = sql_let("line", line, _item(gate, _severity("line"), _without_severity(sql_strip("line")), "p.table"))
    return _found(section, _ACTION, f"transform(pairs, p -> {item})")


def _checklist_items(section: str, gate: str) -> str:
    """Open checklist lines that say something, with or without a severity."""
    group = lambda n: f"regexp_extract(p.m, {sql_pattern(_CHECK)}, {n})"
    said = f"filter(transform(filter(pairs, p -> {group(1)} = ' '), p -> named_struct('words', {sql_strip(group(2))}, 'table', p.table)), r -> r.words <> '')"
    words = f"if(s = '', r.words, {_without_severity('r.words')})"
    item = sql_let("s", _severity("r.words"), _item(gate, "s", words, "r.table"))
    return _found(section, _CHECK, f"transform({said}, r -> {item})")


def gate_sections(reviews: DataFrame) -> DataFrame:
    """One row per review and gate that it has: the other columns of the review, gate, section."""
    keep = [c for c in reviews.columns if c != "content"]
    return reviews.select(*keep, F.inline(F.expr(_sections("content"))))


def gate_tables(reviews: DataFrame) -> DataFrame:
    """One row per review, gate and table name, with its place in the list."""
    cut = gate_sections(reviews)
    keep = [c for c in cut.columns if c != "section"]
    return cut.select(*keep, F.posexplode(F.expr(_tables("section"))).alias("position", "table_name"))


def items(reviews: DataFrame, kinds: tuple[str, ...] = ("action", "checklist")) -> DataFrame:
    """One row per finding, with its kind and its place within the gate."""
    cut = gate_sections(reviews)
    keep = [c for c in cut.columns if c not in ("section", "gate")]
    makers = {"action": _action_items, "checklist": _checklist_items}
    placed = [f"transform({makers[k]('section', 'gate')}, (it, i) -> "
              f"named_struct('kind', '{k}', 'position', i, 'item', it))" for k in kinds]
    listed = F.expr(f"concat({', '.join(placed)})")
    return cut.select(*keep, F.inline(listed)).select(*keep, "kind", "position", "item.*")


def _chosen_gates(gate: int | None) -> dict[int, str]:
    if gate is None:
        return GATE_TITLES
    try:
        return {int(gate): GATE_TITLES[int(gate)]}
    except (TypeError, ValueError, KeyError):
        raise ValueError(f"gate must be 1 to 5, got {gate!r}") from None


def gate_findings(
    reviews: DataFrame, gate: int | None = None, table: str | None = None, distinct: bool = False,
) -> DataFrame:
    """One row per review and gate, also for gates without text: gate_number, title, finding_count, tables,
    action_items.

    ``gate`` and ``table`` limit what is reported. A numbered line with an open box and a severity is found
    both as an action item and as a checklist item; ``distinct`` keeps the checklist item only.
    """
    keep = [c for c in reviews.columns if c != "content"]
    titles = ", ".join(f"named_struct('gate_number', {n}, 'title', '{t}', 'section', "
                       f"coalesce({_last_of_gate('found', n)}.section, ''))" for n, t in _chosen_gates(gate).items())
    cut = reviews.select(*keep, F.inline(F.expr(
        sql_let("found", _sections("coalesce(content, '')"), f"array({titles})"))))
    numbered = _action_items("section", "gate_number")
    if distinct:
        numbered = f"filter({numbered}, it -> NOT startswith(it.description, '[ ]'))"
    listed = f"concat({numbered}, {_checklist_items('section', 'gate_number')})"
    named = _tables("section")
    if table:
        cut = cut.withColumn("wanted", F.lower(F.lit(table)))
        listed = f"filter({listed}, it -> lower(it.table) = wanted)"
        named = f"filter({named}, n -> lower(n) = wanted)"
    return cut.select(*keep, "gate_number", "title", F.expr(named).alias("tables"),
                      F.expr(listed).alias("action_items")).withColumn("finding_count", F.size("action_items"))


def findings(
    reviews: DataFrame, gate: int | None = None, table: str | None = None, distinct: bool = False,
) -> DataFrame:
    """Parsed findings, one row per review: error, total_findings, gates, affected_tables, action_items.

    The gates of ``gate_findings`` brought together by ``review_id``: one row per gate, five at most. A
    review without text gets an error and no findings.
    """
    keep = [c for c in reviews.columns if c != "content"]
    marked = reviews.withColumn("error", F.when(is_blank(F.col("content")), "InvalidParams"))
    rows = gate_findings(marked, gate, table, distinct)
    one_gate = F.struct("gate_number", "title", "finding_count", "tables", "action_items")
    parsed = rows.groupBy(*keep, "error").agg(F.sort_array(F.collect_list(one_gate)).alias("gates"))
    return parsed.select(
        *keep, "error", F.expr("aggregate(gates, 0, (n, g) -> n + g.finding_count)").alias("total_findings"), "gates",
        F.expr("array_distinct(flatten(gates.tables))").alias("affected_tables"),
        F.expr("flatten(gates.action_items)").alias("action_items"))


def gate_summary(by_gate: DataFrame) -> DataFrame:
    """Gate findings with their lists joined to text."""
    keep = [c for c in by_gate.columns if c not in ("tables", "action_items")]
    texts = F.expr("transform(action_items, it -> concat_ws('|', it.severity, it.description, it.table))")
    return by_gate.select(*keep, F.array_join("tables", "; ").alias("tables"), F.array_join(texts, "; ").alias("action_items"))


def delta(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Findings that are new, resolved or unchanged, with their number of times in each review.

    Both sides are (record_id, gate, table, description) rows. Counting them together takes one shuffle
    of combined rows and no join, so a frequent finding does no harm.
    """
    key = ["record_id", "gate", "table", "description"]
    side = lambda df, now, before: df.select(*key, F.lit(now).alias("now"), F.lit(before).alias("before"))
    counted = side(current, 1, 0).unionByName(side(prior, 0, 1)).groupBy(*key).agg(
        F.sum("now").alias("current_count"), F.sum("before").alias("prior_count"))
    status = (F.when(F.col("prior_count") == 0, "new").when(F.col("current_count") == 0, "resolved")
              .otherwise("unchanged"))
    return counted.withColumn("status", status)
