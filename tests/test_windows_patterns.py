from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog import functions as fn
from tidelog.operators import patterns as pt
from tidelog.operators.windows import CountWindow, Editions
from tidelog.plans.ir import Ctor


@given(st.integers(0, 30), st.integers(0, 30), st.integers(1, 9), st.integers(1, 9))
def test_windows_cover(lo, span, size, step):
    w = Editions(lo, lo + span)
    tiles = w.tumbling(size)
    assert [e for t in tiles for e in range(t.lo + 1, t.hi + 1)] == list(range(lo + 1, lo + span + 1))
    if step <= size:
        for e in range(lo + 1, lo + span + 1):
            assert any(t.contains(e) for t in w.sliding(size, step))
    else:
        with pytest.raises(ValueError):
            w.sliding(size, step)


@given(st.sets(st.integers(1, 40)), st.integers(1, 6))
def test_sessions_split_at_gaps(active, timeout):
    active = sorted(active)
    found = Editions.sessions(active, timeout)
    assert [e for e in active if any(s.contains(e) for s in found)] == active
    assert all(b.lo + 1 - a.hi > timeout for a, b in zip(found, found[1:]))


def test_count_window():
    w = CountWindow(3)
    assert w.push([1, 2]) == ([1, 2], [])
    assert w.push([3, 4, 5, 6]) == ([3, 4, 5, 6], [1, 2, 3]) and w.held == [4, 5, 6]


def test_patterns():
    two = pt.Seq((pt.Bind("x"), pt.Bind("x")))
    assert [b for _, b in two.parses([1, 2], 0, {})] == [{"x": 2}]
    assert [to for to, _ in pt.Repeat(pt.Lit(1)).parses([1, 1, 2], 0, {})] == [0, 1, 2]
    assert list(pt.Repeat(pt.Seq()).parses([1], 0, {})) == [(0, {})]
    form = pt.Form((pt.Rule(pt.Seq((pt.Lit("take"), pt.Bind("n"))), Ctor("Take", ("n",))), pt.Rule(pt.Lit("look"), Ctor("Look"))))
    assert form.parse_all(["take", "lamp"]) == [("Take", "lamp")] and form.parse_all(["take"]) == []
    assert form.print(("Take", "lamp")) == ["take", "lamp"] and form.print(("Drop",)) is None
    assert pt.over_updates([(4, (1,), -3)]) == [(-1, (1,), 4)]


def test_parse_streams_agree():
    items = {1: ["look"], 2: ["take", "lamp"], 3: ["take", "cup"]}
    form = pt.Form((pt.Rule(pt.Seq((pt.Lit("take"), pt.Bind("n"))), Ctor("Take", ("n",))), pt.Rule(pt.Lit("look"), Ctor("Look"))))
    for kind in (pt.ParseStream, pt.DifferentialParser):
        s = kind(form, lambda lo, hi: items[hi], 0, 1)
        assert s.advance() == [(("Look",), 1)]
        assert s.advance(2) == [(("Look",), -1), (("Take", "lamp"), 1)]
        assert s.advance(3) == [(("Take", "cup"), 1), (("Take", "lamp"), -1)]
        with pytest.raises(ValueError):
            s.advance(2)


def test_functions():
    assert fn.div(-7, 2) == -3 and fn.rem(-7, 2) == -1 and fn.add(1.5, 2.0) == 3.5
    for bad in (lambda: fn.add(fn.MAX, 1), lambda: fn.div(1, 0), lambda: fn.div(fn.MIN, -1), lambda: fn.rem(fn.MIN, -1), lambda: fn.add(1, 1.0), lambda: fn.mul(1e308, 10.0), lambda: fn.neg(fn.MIN), lambda: fn.equal(1, "1")):
        with pytest.raises(fn.Fault):
            bad()
    assert fn.word_match("red umbrella", "umbrella") and not fn.word_match("red", "re")
    v, state = fn.draw_below(1, 6)
    assert 0 <= v < 6 and state != 1
