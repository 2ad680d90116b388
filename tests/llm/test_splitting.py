import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm.splitting import LEVELS, boundaries, cut, oversized, split_texts
from lexmill.llm.tokens import tokenizer

TEXT = "One sentence here. Another one follows!\n\n" * 6 + "word " * 40 + "x" * 300


@settings(max_examples=60)
@given(st.integers(0, 400), st.integers(1, 50), st.data())
def test_pieces_cover_and_overlap(total, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    found = {level: sorted(data.draw(st.sets(st.integers(1, max(1, total)), max_size=30))) for level in LEVELS}
    pieces = cut(total, found, limit, overlap)
    assert pieces[0][0] == 0
    assert pieces[-1][1] == total
    assert all(0 <= b - a <= limit for a, b, _ in pieces)
    assert all(p[1] - overlap == n[0] for p, n in zip(pieces, pieces[1:], strict=False))
    assert all(kind == "hard" or kind == "end" or b in found[kind] for _, b, kind in pieces)


def test_overlap_must_leave_room():
    with pytest.raises(ValueError):
        cut(10, {level: [] for level in LEVELS}, 5, 5)


def test_levels():
    words = tokenizer().split("A b. C d\ne f.\n\ng")
    found = boundaries(words, list(range(1, len(words) + 1)))
    at = lambda level: ["".join(words[:n]) for n in found[level]]
    assert at("sentence") == ["A b.", "A b. C d\ne f."]
    assert [t[-2:] for t in at("line")] == ["d\n", "\n\n"] or at("line")[0] == "A b. C d\n"
    assert at("paragraph")


def test_frame(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (2, "short", "x"), (3, "", "x"), (4, None, "x"), (1, TEXT, "x")], "doc_id long, text string, cut string")
    rows = split_texts(df, limit=32, overlap=4).orderBy("doc_id", "piece_no").collect()
    own = tokenizer()
    ids = next(own.encode([TEXT]))
    mine = [r for r in rows if r.doc_id == 1][::2]
    assert max(r.n_tokens for r in rows) <= 32
    assert "".join(own.decode(ids[r.first_token + (4 if n else 0) : r.first_token + r.n_tokens]).decode() for n, r in enumerate(mine)) == TEXT
    assert {r.cut for r in mine} >= {"paragraph", "word", "hard", "end"}
    assert [(r.n_tokens, r.text) for r in rows if r.doc_id in (2, 3)] == [(1, "short"), (0, "")]
    assert not [r for r in rows if r.doc_id == 4]
    assert sorted(r.doc_id for r in oversized(df, limit=32, overlap=4).collect()) == [1, 1]
    assert oversized(df.limit(0)).count() == 0


def test_exactly_the_limit_is_whole(spark):
    df = spark.createDataFrame([(1, " a" * 32), (2, " a" * 33)], "doc_id long, text string")
    assert [r.doc_id for r in oversized(df, limit=32, overlap=4).collect()] == [2]
