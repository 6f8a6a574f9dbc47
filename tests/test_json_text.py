"""Look-ups and edits of JSON text, byte for byte."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldlens.functions import json_text as jt

MANY = '{"a":1.10,"b":[1e400,{"k\\u0065y":123456789012345678901234567890123456789012}],"":{"x y":"\\"}],"},"e":[],"o":{}}'


def one(found):
    assert found[0]["error"] is None, found
    return found[0]["value"]


def test_literals_come_back_digit_for_digit():
    for path, want in [(["a"], "1.10"), (["b", "0"], "1e400"), (["b", "1", "key"], "123456789012345678901234567890123456789012"), (["", "x y"], '"\\"}],"'), (["e"], "[]"), ([], MANY)]:
        assert one(jt.look_up([MANY], path)) == want
    for path, want in [(["zz"], jt.NOT_FOUND), (["a", "b"], jt.WRONG_TYPE), (["b", "2"], jt.NOT_FOUND), (["e", "0"], jt.NOT_FOUND), (["b", "x"], jt.NOT_FOUND)]:
        assert jt.look_up([MANY], path)[0]["error"] == want
    for bad in ["", "{", '{"a":1,"a":2}', "1 2", "NaN", None, '{"a":01}']:
        assert jt.look_up([bad, MANY], ["a"]) == [{"value": None, "error": jt.PARSE_FAILED}, {"value": "1.10", "error": None}]


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet='ab"\\é{', max_size=2), v, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=4), st.sampled_from([None, 1, 2]), st.booleans(), st.integers())
def test_any_path_of_any_value(all_, indent, ascii_, seed):
    texts, rnd = [json.dumps(v, indent=indent, ensure_ascii=ascii_) for v in all_], random.Random(seed)
    value, path = all_[0], []
    while isinstance(value, (dict, list)) and value and rnd.random() < 0.9:
        key = rnd.choice(list(value)) if isinstance(value, dict) else rnd.randrange(len(value))
        value, path = value[key], [*path, str(key)]
    assert json.loads(one(jt.look_up(texts, path))) == value
    if not path:
        return
    changed = json.loads(one(jt.set_texts(texts, ['{"new":1.10}'] * len(texts), path)))
    gone = json.loads(one(jt.unset_texts(texts, path)))
    at, left = changed, gone
    for key in path[:-1]:
        at, left = (x[int(key)] if isinstance(x, list) else x[key] for x in (at, left))
    assert (at[int(path[-1])] if isinstance(at, list) else at[path[-1]]) == {"new": 1.1}
    if isinstance(left, dict):
        assert path[-1] not in left
    else:
        assert len(left) == len(at) - 1


@pytest.mark.parametrize(
    ("text", "path", "literal", "want"),
    [
        ('{\n  "z": 1e+3,\n  "n": { "keep": "\\u0061", "t": 2 }\n}\n', ["n", "t"], "7", '{\n  "z": 1e+3,\n  "n": { "keep": "\\u0061", "t": 7 }\n}\n'),
        ('{\n  "a": 1\n}\n', ["m", "h"], '"x"', '{\n  "a": 1,\n  "m": {\n    "h": "x"\n  }\n}\n'),
        ('{"a": {}}', ["a", "b", "c"], "1.10", '{"a": {"b": {"c":1.10}}}'),
        ('{"a":1}', ["b"], "[1, 2]", '{"a":1, "b": [1,2]}'),
        ('{"s": [1, 2]}', ["s"], "[ ]", '{"s": []}'),
        (' [1, 2] ', ["1"], "null", " [1, null] "),
    ],
)
def test_set(text, path, literal, want):
    assert one(jt.set_texts([text], [literal], path)) == want


def test_set_is_refused():
    found = jt.set_texts(['{"a":1}', "[1]", "{", '{"a":1}'], ["1", "1", "1", "01"], ["a", "b"])
    assert [f["error"] for f in found] == [jt.UNSUPPORTED, jt.UNSUPPORTED, jt.PARSE_FAILED, jt.PARSE_FAILED]


@pytest.mark.parametrize(
    ("text", "path", "want"),
    [
        ('{\n  "keep": 1e+3,\n  "gone": 2,\n  "last": "x"\n}\n', ["gone"], '{\n  "keep": 1e+3,\n  "last": "x"\n}\n'),
        ('{"arr": [{"n": 1}], "b": {"x": 2}}', ["b", "x"], '{"arr": [{"n": 1}], "b": {}}'),
        ('{\r\n  "keep": 1e+3,\r\n  "t": 2\r\n}\r\n', ["t"], '{\r\n  "keep": 1e+3\r\n}\r\n'),
        ("[1, 2, 3]", ["1"], "[1,  3]"),
        ("[1]", ["0"], "[]"),
    ],
)
def test_unset(text, path, want):
    assert one(jt.unset_texts([text], path)) == want


def test_append_and_remove_of_a_list_give_the_text_back():
    text = '[\n  {"id": "a", "name": "\\u0041"}\n]\n'
    more = one(jt.append_texts([text], ['{"id":"b"}'], []))
    assert more == '[\n  {"id": "a", "name": "\\u0041"}, {"id":"b"}\n]\n'
    assert one(jt.unset_texts([more], ["1"], whole_line=True)) == text
    assert jt.append_texts(["{}"], ["1"], [])[0]["error"] == jt.UNSUPPORTED
    assert one(jt.append_texts(["[ ]"], ["1"], [])) == "[1 ]"


def test_columns(spark):
    rows = [(MANY, "b.0"), ('{"a":"x\\n"}', "a"), ("{", "a"), (None, "a"), ('{"a":null}', "*"), ('{"a":[1]}', None)]
    df = spark.createDataFrame(rows, "t string, p string").repartition(2)
    found = df.select("t", jt.scalar(F.col("t"), "a").alias("s"), jt.get_by(F.col("t"), F.col("p")).alias("g")).collect()
    by = {r.t: r for r in found}
    assert by[MANY].s.value == "1.10" and by[MANY].g.value == "1e400"
    assert by['{"a":"x\\n"}'].s.value == "x\n"
    assert by["{"].s.error == by[None].s.error == jt.PARSE_FAILED
    assert by['{"a":null}'].s.error == jt.IS_NULL and by['{"a":null}'].g.error == "document_invalid_path"
    assert by['{"a":[1]}'].s.error == jt.NO_SCALAR and by['{"a":[1]}'].g.error == "document_invalid_argument"


def test_coercion_keeps_digits(spark):
    texts = ["1.10", "1e400", "123456789012345678901234567890123456789012", "01", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(jt.coerce(F.col("t"), "number")["value"]).collect()] == [*texts[:3], None, None, None]
    assert [r[0] for r in df.select(jt.coerce(F.col("t"), "string")["value"]).collect()] == [*(json.dumps(t) for t in texts[:5]), None]
    assert [r[0] for r in df.select(jt.coerce(F.col("t"), "json")["value"]).collect()] == [*texts[:3], None, None, None]
