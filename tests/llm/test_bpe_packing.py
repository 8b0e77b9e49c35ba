import random
import time

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarryline.llm.bpe import VOCABULARIES, Encoder, encoder, token_ids
from quarryline.llm.packing import _counter, fill_containers, least_containers, pack

DOC = "doc_id long, text string, ids string, tokens string, _group int"


def reference() -> tiktoken.Encoding:
    return _counter(VOCABULARIES, "byte_bpe_50k")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_public_encoder(text):
    assert encoder(VOCABULARIES, "byte_bpe_50k").encode([text]) == [reference().encode_ordinary(text)]


def test_ids_of_odd_texts():
    texts = ["", "a" * 5000, " " * 3000, "\x1c \x1d x", "一" * 2000, "½ ² x²y", "abab" * 300, "\x85   x", "it's I'LL \r\n\t x", "<|endoftext|>", "e\u0301 é"]
    ids = encoder(VOCABULARIES, "byte_bpe_50k").encode(texts)
    assert ids == [reference().encode_ordinary(t) for t in texts]
    t = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert ids == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [reference().decode(i) for i in ids] == texts


def test_long_words():
    """A word of 64,000 letters takes seconds at most and the same ids, whether or not it can be cut."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=64_000)), "".join(r.choices("ACGT", k=4_000)), "".join(r.choices("一二三四五的是不", k=20_000)), "Aa" * 32_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=64_000))]
    for w in words:
        begin = time.process_time()
        assert Encoder(VOCABULARIES, "byte_bpe_50k").encode([w]) == [reference().encode_ordinary(w)]
        assert time.process_time() - begin < 20
    enc = encoder(VOCABULARIES, "byte_bpe_50k")
    assert b"".join(enc.pieces(words[0])) == words[0].encode() and len(enc.pieces(words[0])) > 1000


def test_token_ids_of_rows(spark):
    rows = [(1, "hello world", "x", "y", 0), (2, None, "x", "y", 0), (3, "", "x", "y", 0), (None, "a", "x", "y", 0), (1, "hello world", "x", "y", 0)]
    got = token_ids(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), reference().encode_ordinary(t or "")) for i, t, *_ in rows)
    assert token_ids(spark.createDataFrame([], DOC)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80))
def test_pack_is_whole_and_within_capacity(sizes):
    placed = pack(sizes, 100)
    fill, pieces = {}, {}
    for i, c, p in placed:
        n = min(100, sizes[i] - p * 100)
        fill[c] = fill.get(c, 0) + n
        pieces.setdefault(i, []).append(p)
    assert all(v <= 100 for v in fill.values())
    assert {i: sorted(p) for i, p in pieces.items()} == {i: list(range(max(1, -(-n // 100)))) for i, n in enumerate(sizes)}
    assert len(placed) == len(set((i, p) for i, _, p in placed))


def test_search_empties_containers():
    random.seed(1)
    sizes = [random.randint(5, 60) for _ in range(3000)]
    used = len({c for _, c, _ in pack(sizes, 100)})
    assert used <= -(-sum(sizes) // 100) * 1.01 + 1


def test_bounds_end_a_search():
    """Items of one size, and of about half a container: the bound no packing can go below, and the effort, end the search."""
    assert least_containers([700] * 8192, 2048) == 4096 and least_containers([1025] * 10, 2048) == 10 and least_containers([], 2048) == 0
    r = random.Random(2)
    for sizes, most in (([700] * 8192, 4096), ([r.randint(900, 1150) for _ in range(8192)], 5200), ([r.choice((683, 682, 690)) for _ in range(8192)], 4100)):
        begin = time.process_time()
        assert len({c for _, c, _ in pack(sizes, 2048)}) <= most
        assert time.process_time() - begin < 10


def test_ids_stay_whole(spark):
    big = 2**60 + 1
    rows = [(big, "a b", "", "", 0), (big + 1, "c", "", "", 0), (None, "d", "", "", 0)]
    assert {r.doc_id for r in fill_containers(spark.createDataFrame(rows, DOC)).collect()} == {big, big + 1, None}


def test_fill_containers(spark):
    rows = [(i, "word " * (i % 50 * 20), "", "", 0) for i in range(300)] + [(900, "word " * 5000, "", "", 0), (901, None, "", "", 0), (902, "", "", "", 0), (None, "x", "", "", 0), (5, "dup", "", "", 0)]
    got = fill_containers(spark.createDataFrame(rows, DOC), group_rows=100).collect()
    count = {i: len(reference().encode_ordinary(t or "")) for i, t, *_ in rows if i != 5}
    fill = {}
    for r in got:
        if r.doc_id != 5:
            fill[r.container] = fill.get(r.container, 0) + min(2048, count[r.doc_id] - r.piece * 2048)
    assert max(fill.values()) <= 2048
    assert len({r.piece for r in got if r.doc_id == 900}) == -(-count[900] // 2048)
    assert sum(1 for r in got if r.doc_id == 5) == 2 and {901, 902, None} <= {r.doc_id for r in got}
    assert fill_containers(spark.createDataFrame([], DOC)).count() == 0
