import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelattice.functions import jsontext

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=8), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=5), v, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 1, "\t"]))
def test_parses_as_json_does(value, indent):
    text = json.dumps(value, indent=indent)
    assert jsontext._parsed(text) == json.loads(text)
    assert json.loads(jsontext.canonical(value)) == value
    assert jsontext.canonical(value) == jsontext.canonical(json.loads(json.dumps(value, sort_keys=True)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='[]{},:"a1-.e \\ntruefals', max_size=12))
def test_refuses_as_json_does(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            jsontext._parsed(text)
    else:
        assert jsontext._parsed(text) == want


def test_any_depth():
    for open_, inner, close in (("[", "", "]"), ('{"a":', "1", "}")):
        text = open_ * 100_000 + inner + close * 100_000
        assert jsontext.canonical(jsontext.loads(text)) == text
    with pytest.raises(ValueError):
        jsontext.loads("[" * 100_000)


def test_canonical_tells_types_apart():
    assert jsontext.canonical(1.0) == jsontext.canonical(1) != jsontext.canonical(True)
    assert jsontext.canonical({"b": 1, "a": [1, {}]}) == '{"a":[1,{}],"b":1}'
