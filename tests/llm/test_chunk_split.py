import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm.chunk_split import boundaries, cut, limits_in_force, split_oversized

CONFIG = "repo_id int, chunk_size int, chunk_overlap int, updated_at timestamp, content string"
CHUNK = "chunk_id string, repo_id int, start_line int, content string, _limit int, piece int, chunk_size int"


def day(n):
    return dt.datetime(2025, 1, n)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .;\n\r\té漢", max_size=300), st.integers(1, 40), st.integers(0, 60))
def test_cut_covers_text_within_the_limit(text, limit, overlap):
    ranges = cut(text, limit, overlap)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(ranges, ranges[1:]):
        assert 0 < e - s <= limit and e2 > e and s2 <= e
        assert e - s2 == min(overlap, limit - 1) or s2 == s + 1
    assert len(text) <= limit or ranges[-1][1] - ranges[-1][0] <= limit
    rebuilt, done = "", 0
    for s, e in ranges:
        rebuilt += text[max(s, done) : e]
        done = e
    assert rebuilt == text


def test_cut_prefers_lines_and_falls_back_to_the_limit():
    text = "".join(f"line {i} of text\n" for i in range(20))
    assert all(text[e - 1] == "\n" for _, e in cut(text, 60, 0))
    assert cut("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]
    assert all(text[e - 2 : e] != "\r" for _, e in cut("ab\r\n" * 10, 7, 0))


def test_boundaries_are_prefix_sums():
    offsets, kinds = boundaries("ab cd;\n\nx")
    assert offsets.tolist() == [2, 3, 5, 6, 7, 8, 9] and kinds[0].tolist() == [8] and kinds[1].tolist() == [7, 8]


def test_limits_in_force(spark):
    rows = [(0, 50, 5, day(1), ""), (1, 20, 4, day(1), ""), (1, 30, None, day(2), ""), (1, 30, None, day(2), ""), (2, None, 3, day(1), ""), (3, 40, 40, day(1), ""), (4, 40, -1, None, "")]
    got = {r[0]: (r[1], r[2]) for r in limits_in_force(spark.createDataFrame(rows, CONFIG)).collect()}
    assert got == {0: (50, 5), 1: (30, 5), 2: (50, 3), 3: (40, 5), 4: (40, 5)}


def test_split_oversized(spark):
    config = spark.createDataFrame([(0, 10, 2, day(1), "clash"), (1, 8, 0, day(1), "clash")], CONFIG)
    text = "aa bb\ncc dd\nee ff\n"
    rows = [("a", 1, 5, text, 1, 1, 1), ("a", 1, 5, text, 1, 1, 1), ("b", 9, None, "x" * 11, 1, 1, 1), ("c", 1, 1, None, 1, 1, 1), ("d", 1, 1, "", 1, 1, 1), (None, 1, 1, "y" * 9, 1, 1, 1), ("e", 1, 1, "12345678", 1, 1, 1)]
    got = split_oversized(spark.createDataFrame(rows, CHUNK), config).collect()
    a = sorted((r for r in got if r.chunk_id == "a"), key=lambda r: r.piece)
    assert "".join(r.content for r in a) == text and [r.start_line for r in a] == [5, 6, 7] and [r.end_line for r in a] == [5, 6, 7]
    assert {r.chunk_id for r in got} == {"a", "b", None} and all(r.start_line is None for r in got if r.chunk_id == "b")
    assert [r.content for r in sorted((r for r in got if r.chunk_id == "b"), key=lambda r: r.piece)] == ["x" * 10, "x" * 3]
    empty = spark.createDataFrame([], CHUNK)
    assert split_oversized(empty, config).count() == 0
    assert split_oversized(spark.createDataFrame(rows, CHUNK), spark.createDataFrame([], CONFIG)).count() == 0


def test_very_long_text(spark):
    config = spark.createDataFrame([(0, 1000, 100, day(1), "")], CONFIG)
    text = ("word " * 199 + "\n") * 600
    got = split_oversized(spark.createDataFrame([("a", 0, 1, text, 0, 0, 0)], CHUNK), config).collect()
    assert max(len(r.content) for r in got) <= 1000 and got[-1].end_char == len(text)
