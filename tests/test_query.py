import pytest

from lexmill.plans.query import ParsedQuery, parse_query


@pytest.mark.parametrize(
    ("line", "mode", "clauses", "text"),
    [
        ("blue*", "structural", ("blue*",), ""),
        ("?????,-a", "structural", ("?????", "-a"), ""),
        ("-xyz", "structural", ("-xyz",), ""),
        ("+cat", "structural", ("+cat",), ""),
        ("//dear//", "structural", ("//dear//",), ""),
        ("****", "structural", ("****",), ""),
        ("blue*:snow", "combined", ("blue*",), "snow"),
        ("note: x", "combined", ("note",), "x"),
        (",:x", "combined", (), "x"),
        (": a cold place", "meaning", (), "a cold place"),
        ("blue,-a", "meaning", (), "blue,-a"),
        ("  small dog ", "meaning", (), "small dog"),
        ("", "meaning", (), ""),
    ],
)
def test_forms(line, mode, clauses, text):
    parsed = parse_query(line)
    assert (parsed.mode, parsed.clauses, parsed.text) == (mode, clauses, text)


def test_expand_and_phrase():
    assert parse_query("EXPAND: NASA ") == ParsedQuery("expand", expand_target="nasa")
    assert parse_query("**Winter**") == ParsedQuery("phrase_contains", phrase_word="winter")
