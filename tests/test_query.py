import pytest
from hypothesis import given
from hypothesis import strategies as st

from scriptorium.plans.query import And, Not, Or, QuerySyntaxError, Word, holds_for_nothing, is_boolean, leaves, parse


def test_precedence_and_implicit_and():
    assert parse("a b or c") == Or(And(Word("a"), Word("b")), Word("c"))
    assert parse("a AND (b OR c)") == And(Word("a"), Or(Word("b"), Word("c")))
    assert parse("not a b") == And(Not(Word("a")), Word("b"))
    assert parse('"graph neural" x') == And(Word("graph neural"), Word("x"))


def test_left_association():
    assert parse("a b c") == And(And(Word("a"), Word("b")), Word("c"))


@pytest.mark.parametrize("bad", ["", "  ", "and", "a or", "(a", "a)", "not", "()"])
def test_errors(bad):
    with pytest.raises(QuerySyntaxError):
        parse(bad)


def test_router():
    assert is_boolean("a and b") and is_boolean('"x y"') and is_boolean("(a)")
    assert not is_boolean("band orchestra")


def test_leaves_keep_order_and_not():
    assert leaves(parse("b NOT a OR b")) == ["b", "a"]
    assert holds_for_nothing(parse("not a")) and not holds_for_nothing(parse("a not b"))


words = st.sampled_from(["x", "y", "z"])
asts = st.recursive(words.map(Word), lambda c: st.one_of(c.map(Not), st.tuples(c, c).map(lambda t: And(*t)), st.tuples(c, c).map(lambda t: Or(*t))), max_leaves=8)


@given(asts)
def test_text_of_a_query_parses_back(ast):
    assert parse(str(ast)) == ast
