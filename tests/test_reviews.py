"""The review expressions against a brute-force reading of the same patterns with Python's ``re``."""

import re

import pytest
from hypothesis import given, settings, strategies as st

from strataudit.operators import reviews as R

TEXTS = [
    "", "   \n ", "no gate at all\n1. item [HIGH]",
    "## Gate 1:\nfirst line swallowed\n1. Do [HIGH]\n", "## Gate 12 stuff\n1. a [LOW]",
    "## Gate 2: x\n1. one [HIGH]\n## gate 2 - again\n2) two [low]: - tail\n", "## Gate 0\n1. a [LOW]\n## Gate 7\n1. b [LOW]",
    "## Gate 3\n### Table: `users`\n- [ ] flag [medium] now\n- [x] done\n- [X] done\n- [ ]\n- [ ] plain words\n",
    "## Gate 3\nlook within foo and for bar_1, in the table 'T-2' in ab\n", "## Gate 4\r\n1. a [HIGH]\r\n- [ ] b\r\n",
    "## Gate 1\n### Table:\n1. foo [HIGH]\n2. bar [LOW]\n", "## Gate 1\n### Table\n- [ ] foo\n- [ ] bar\n1. baz [LOW]\n",
    "## Gate 1\n### Data  Store - s1\n1. [ ] both ways [HIGH]\n\n\n### Table — t2\n  3) x [LOW] [HIGH] - : \n",
    "## Gate 1\n1.\n### Table: foo [HIGH]\n2. after [LOW]\n", "## Gate 5\n- [ ]\n### Table: late\n- [ ] x\n",
    "### GATE 1 —  Title\n1. no-break [HIGH]\n", "## Gate 1: a\n## Gate 1: b\n", "## Gate 1\x01 odd\n1. x\x02y [LOW]\n",
]


def _context(text, pos):
    heads = list(re.finditer(R.TABLE_HEADING, text[:pos], re.M | re.I))
    return heads[-1].group(1).strip().strip("`\"'") if heads else ""


def _brute(content):
    """gate -> (tables, items), worked out match by match."""
    heads = list(re.finditer(R.GATE_HEADING, content, re.M))
    ends = [h.start() for h in heads[1:]] + [len(content)]
    out = {}
    for head, end in zip(heads, ends):
        gate, text = int(head[1]), content[head.end():end]
        if not 1 <= gate <= 5:
            continue
        names = [m[1].strip().strip("`\"'") for m in re.finditer(R.TABLE_HEADING, text, re.M | re.I)]
        names = [n for n in names if n]
        names += [m[1] for m in re.finditer(R.TABLE_INLINE, text) if len(m[1]) > 2 and m[1].lower() not in R.NOISE_WORDS]
        severity = lambda s: (re.findall(R.SEVERITY, s, re.I) or [""])[0].upper()
        bare = lambda s: re.sub(R.SEVERITY, "", s, flags=re.I).strip().strip("- :")
        items = [(gate, severity(m[1].strip()), bare(m[1].strip()), _context(text, m.start()))
                 for m in re.finditer(R.ACTION_ITEM, text, re.M | re.I)]
        for m in re.finditer(R.CHECKLIST_ITEM, text, re.M):
            said = m[2].strip()
            if m[1] == " " and said:
                items.append((gate, severity(said), bare(said) if severity(said) else said, _context(text, m.start())))
        out[gate] = (list(dict.fromkeys(names)), items)
    return out


def _spark(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, content string")
    out = {}
    for r in R.findings(df).collect():
        out[r.review_id] = {g.gate_number: (g.tables, [tuple(i) for i in g.action_items]) for g in r.gates}
        assert r.total_findings == len(r.action_items) == sum(g.finding_count for g in r.gates)
        assert [g.title for g in r.gates] == list(R.GATE_TITLES.values())
    return [out[i] for i in range(len(texts))]


def _check(spark, texts):
    none = ([], [])
    for text, got in zip(texts, _spark(spark, texts)):
        want = _brute(text)
        assert got == {g: want.get(g, none) for g in R.GATE_TITLES}, text


def test_edge_texts(spark):
    _check(spark, TEXTS)


_pieces = st.sampled_from([
    "## Gate 1", "### gate 3: T", "## Gate 9", "### Table: t1", "## Data Store - `s`", "### Table", "### Table:", "##",
    "1. do [HIGH]", "2) x [low] y", "3. [ ] z [MEDIUM]", "- [ ] open", "- [x] shut", "- [ ]", "1.", "-", "", "   ", "in users",
    "for the table foo", "plain", "[HIGH]", "\t- [ ] tab [LOW]"])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(_pieces, min_size=1, max_size=14).map("\n".join), min_size=60, max_size=80))
def test_random_texts(spark, texts):
    _check(spark, texts)


def test_filters_and_errors(spark):
    text = "## Gate 3: T\n### Table: `Users`\n- [ ] flag [medium]\n1. fix [HIGH]\n### Table: other\n2. x [LOW]\n"
    df = spark.createDataFrame([(1, text), (2, " \n"), (3, None)], "review_id int, content string")
    got = {r.review_id: r for r in R.findings(df, gate=3, table="USERS").collect()}
    assert got[1].total_findings == 2 and got[1].affected_tables == ["Users"] and got[1].error is None
    assert got[2].error == got[3].error == "InvalidParams" and got[2].total_findings == 0
    assert [len(r.gates) for r in got.values()] == [1, 1, 1]
    both = spark.createDataFrame([(1, TEXTS[12])], "review_id int, content string")
    said = lambda **kw: [i.description for i in R.findings(both, **kw).first().action_items]
    assert said() == ["[ ] both ways", "x", "both ways"] and said(distinct=True) == ["x", "both ways"]
    for bad in (0, 6, "x", ""):
        with pytest.raises(ValueError):
            R.findings(df, gate=bad)


def test_delta(spark):
    cols = "record_id string, gate int, table string, description string"
    now = spark.createDataFrame([("r", 1, "t", "same"), ("r", 1, "t", "same"), ("r", 1, "t", "fresh")], cols)
    before = spark.createDataFrame([("r", 1, "t", "same"), ("r", 2, "t", "gone")], cols)
    got = {r.description: (r.status, r.current_count, r.prior_count) for r in R.delta(now, before).collect()}
    assert got == {"same": ("unchanged", 2, 1), "fresh": ("new", 1, 0), "gone": ("resolved", 0, 1)}
