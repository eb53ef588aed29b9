from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog.types import Code, Ent, Schema, SchemaCatalog, Ty, decode, encode, key, row_key

leaf = st.one_of(
    st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, (1 << 63) - 1).map(Ent), st.floats(allow_nan=False, allow_infinity=False), st.text(alphabet=st.characters(exclude_categories=["Cs"])),
    st.booleans(), st.binary(), st.binary().map(Code),
)
value = st.recursive(leaf, lambda x: st.lists(x, max_size=3).map(tuple), max_leaves=6)


@given(value, value)
def test_encoding_keeps_order_and_equality(a, b):
    assert (encode(a) < encode(b)) == (key(a) < key(b))
    assert (encode(a) == encode(b)) == (key(a) == key(b))


@given(value)
def test_encoding_round_trip(a):
    back = decode(encode(a))
    assert key(back) == key(a) and type(back) is type(a)


def test_kinds_are_strict_and_ordered():
    ordered = [Ent(5), 1, 0.5, "a", False, (1,), b"x", Code(b"a")]
    assert sorted(reversed(ordered), key=key) == ordered
    assert len({key(1), key(1.0), key(Ent(1)), key(True)}) == 4
    assert key(-0.0) == key(0.0)
    assert row_key((1,)) < row_key((1, 0))


@pytest.mark.parametrize("bad", [None, math.nan, math.inf, 1 << 63, [1]])
def test_no_values(bad):
    with pytest.raises(TypeError):
        key(bad)


def test_schema_checks_and_evolution():
    s = Schema.of(("a", Ty.INT), "b")
    s.check((1, "x"))
    for bad in ((1,), ("1", 2), (Ent(1), 2)):
        with pytest.raises(TypeError):
            s.check(bad)
    c = SchemaCatalog()
    c.put("r", 1, s)
    c.put("r", 1, s)
    wider = Schema.of(("a", Ty.INT), "b", ("c", Ty.TEXT))
    c.put("r", 5, wider)
    assert c.at("r", 4) == s and c.at("r", 5) == wider and c.at("r", 0) is None
    with pytest.raises(ValueError):
        c.put("r", 6, Schema.of(("a", Ty.TEXT)))
