import json
import random

import pytest

from lexmill.operators.nested import parse_deep, parse_object, visit

SENSES = '"senses": [{"glosses": ["a"]}]'


@pytest.mark.parametrize("other", ["9" * 5_000, "-" + "9" * 5_000, "[" * 100_000 + "]" * 100_000, '{"x":' * 100_000 + "1" + "}" * 100_000])
def test_items_beside_long_numbers_and_deep_values(other):
    for line in (f'{{"n": {other}, {SENSES}}}', f'{{{SENSES}, "n": {other}}}'):
        assert [r[0] for r in visit(1, line)] == ["entry", "sense", "gloss"]
    assert parse_object(f'{{"n": {other}, {SENSES}') is None


def test_deep_parser_agrees_with_json():
    rng = random.Random(3)
    texts = [json.dumps({"a": [1, -2.5e3, True, None, {"b": {}, "c": [], "d": 'x"\\ü\n'}], "a ": {"a": [[], [1]]}}, indent=rng.choice([None, 1])) for _ in range(4)]
    texts += ["", " ", "[1,]", "{,}", '{"a" 1}', "01", "-", "1 2", "[1", '"\n"', "NaN", "tru", " [ ] ", "[1 2]", '{"a":1,}', "\ufeff1", '{"a":1,"a":2}']
    for text in list(texts):
        for _ in range(100):
            if text:
                at = rng.randrange(len(text))
                texts.append(text[:at] + rng.choice(["", *'{}[],:"0 e.-']) + text[at + 1 :])
    for text in texts:
        try:
            expected = json.loads(text, parse_int=float, parse_constant=lambda _: [][0])
        except (ValueError, IndexError):
            expected = None
        assert parse_deep(text) == expected, text
