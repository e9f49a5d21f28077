from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strataudit.functions.columns import to_bool
from strataudit.functions.struct_text import owner, struct_pairs

CASES = {
    "{owner_login=FRANCE, metadata={team=BUILDING, level=3}, tags=[europe, a, null]}": {
        "owner_login": "FRANCE", "metadata.team": "BUILDING", "metadata.level": "3", "tags[0]": "europe", "tags[1]": "a", "tags[2]": None},
    "{one={two=2}, three=null, four={five={six=6}, seven=[7]}}": {
        "one.two": "2", "three": None, "four.five.six": "6", "four.seven[0]": "7"},
    "": {}, "null": {}, " None ": {}, "{}": {},
    "{d=hello, world}": {"d": "hello"},
    "{a=1, a=2}": {"a": "2"},
    "{=x}": {},
    "{k=a=b}": {"k": "a=b"},
    "a=b": {"a": "b"},
    "{t=[]}": {"t": "[]"},
    "{t=[a,,b]}": {"t[0]": "a", "t[1]": None, "t[2]": "b"},
    "{t=[a,]}": {"t[0]": "a"},
    "{k=Null}": {"k": "Null"},
    "{a}=1, b=2}": {},
    "{t=[{x=1}, {x=2, y=[p]}]}": {"t[0].x": "1", "t[1].x": "2", "t[1].y[0]": "p"},
    "{a={b={c={d={e={f={g={h={i={j=bottom}}}}}}}}}}": {"a.b.c.d.e.f.g.h.i.j": "bottom"},
    "k={a}{b={c=1}}": {"k.a}{b.c": "1"},
    " {a=\t1 }\n": {"a": "1"},
}


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    out = {i: {} for i in range(len(texts))}
    for r in struct_pairs(df, "k", "t").collect():
        out[r.k][r.path] = r.value
    return [out[i] for i in range(len(texts))]


def test_known_texts(spark):
    assert _parse(spark, list(CASES)) == list(CASES.values())
    assert _parse(spark, [None]) == [{}]


_word = st.text("abcxyz019_ -", min_size=1, max_size=6).map(str.strip).filter(lambda w: w and w not in ("null", "NULL", "None"))
_value = st.recursive(
    _word, lambda inner: st.one_of(st.dictionaries(_word, inner, min_size=1, max_size=3),
                                   st.lists(inner, min_size=1, max_size=3)), max_leaves=8)


def _write(value):
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}={_write(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_write, value)) + "]"
    return value


def _leaves(value, path=""):
    if isinstance(value, dict):
        return {p: x for k, v in value.items() for p, x in _leaves(v, f"{path}.{k}" if path else k).items()}
    if isinstance(value, list):
        return {p: x for i, v in enumerate(value) for p, x in _leaves(v, f"{path}[{i}]").items()}
    return {path: value}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.dictionaries(_word, _value, min_size=1, max_size=4), min_size=20, max_size=30))
def test_written_structs_come_back(spark, values):
    assert _parse(spark, [_write(v) for v in values]) == [_leaves(v) for v in values]


def test_owner(spark):
    cases = {"{owner_login=null, login=x}": None, "{login=x}": "x", "{team=y}": "", "bob": "bob", "": "",
             "{owner_login=a, login=b}": "a", " {login=x}": " {login=x}"}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = [r[0] for r in df.select(owner("t")).collect()]
    assert got == [*cases.values(), ""]


def test_to_bool(spark):
    true = ["true", "True", "TRUE", "1", "yes", "Yes", "YES", "  true  ", "\tyes\n"]
    false = ["false", "False", "FALSE", "0", "no", "No", "NO", "", "null", "None", None, "t", "y", "1.0"]
    df = spark.createDataFrame([(t,) for t in true + false], "t string")
    assert [r[0] for r in df.select(to_bool(F.col("t"))).collect()] == [True] * len(true) + [False] * len(false)
