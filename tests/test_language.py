import pytest

from lexigrove.functions.analysis import py_tokens
from lexigrove.plans import language as q
from lexigrove.plans.questions import parse_question


def test_precedence():
    assert q.parse("a OR b c NOT d") == q.Or((q.Word("a"), q.And((q.Word("b"), q.Word("c"), q.Not(q.Word("d"))))))
    assert q.parse("(a or b) and c") == q.And((q.Or((q.Word("a"), q.Word("b"))), q.Word("c")))
    assert q.parse('title:("x y" OR z)') == q.Scope("title", q.Or((q.Phrase("x y"), q.Word("z"))))
    assert q.parse("not a w/3 b") == q.Not(q.Near(q.Word("a"), q.Word("b"), 3, False))
    assert q.parse('"say \\"hi\\""') == q.Phrase('say "hi"')


@pytest.mark.parametrize("bad", ["", "(a", "a)", '"open', ":x", "nofield:a", "a w/x b", "a w/2000 b", "a w/1 b w/1 c", "(a b) w/2 c", "a AND", "x~3", "~1", "a*b~1", "foo-*", "???", "..", "(" * 40 + "a" + ")" * 40, "a " * 600, "a" * 9000, "a" * 45])
def test_rejects(bad):
    if bad == "???":
        assert isinstance(q.pattern(bad), q.Wildcard)
        return
    with pytest.raises(q.QueryError):
        q.parse(bad)


def test_long_words_keep_their_place():
    assert py_tokens("a " + "x" * 40 + " b Ünïçø") == [(0, "a"), (2, "b"), (3, "unico")]


def test_plans():
    assert q.has_explicit_syntax("a b") is False
    assert q.has_explicit_syntax("a OR b") and q.has_explicit_syntax("fo*")
    plan = q.plan("Beta and ALPHA, beta?", natural=True)
    assert plan.lexical == 'alpha OR "and" OR beta' and not plan.must_match
    assert q.with_fuzzy('long "long words" title:long AND cat') == 'long~1 "long words" title:long AND cat'
    assert q.with_fuzzy('"broken') == '"broken'
    assert q.with_synonyms("the car") == "the (car OR automobile OR vehicle OR auto)"
    assert q.literal_body_terms('a NOT b title:c body:d "e f" g* NOT NOT h') == ["a", "d", "e", "f", "h"]
    with pytest.raises(q.QueryError):
        q.plan("  ")


@pytest.mark.parametrize(("a", "b", "d"), [("ab", "ba", 1), ("ca", "abc", 3), ("", "", 0), ("kitten", "sitting", 3), ("abcd", "abdc", 1)])
def test_swaps_cost_one(a, b, d):
    assert q.osa(a, b, 5) == d


def test_questions():
    text, f = parse_question("contracts in german from 2019 before 2023 pdf files tag: urgent site: example.org")
    assert (text, f.language, f.year_min, f.year_max, f.extensions, f.tags, f.url) == ("contracts", "de", 2019, 2023, ["pdf"], ["urgent"], "example.org")
    text, f = parse_question("Verträge auf Deutsch 2001–2004")
    assert (text, f.language, f.year_min, f.year_max) == ("Verträge", "de", 2001, 2004)
