import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import bpe
from quillspan.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", "  ", "ΑΣ Σας ΟΔΟΣ", "İstanbul ǅ é", "a\x1cb \x85c　d", "<|endoftext|> hi<|startoftext|>x < |", "<|ENDOFTEXT|>", "don't we'll I'M", "日本語 १२ ½ 🙂", "a" * 300, "\x00\x01", "Å", "x" * 100 + "!!!???", "'s's"]


@pytest.fixture(scope="module")
def both():
    return bpe.Bpe(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())


def test_odd_texts_equal_the_library(both):
    mine, library = both
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(both, text):
    mine, library = both
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def naive(symbols, pairs):
    """Merges the leftmost pair of the lowest rank, found by looking at all pairs each time."""
    symbols = list(symbols)
    while True:
        found = [(pairs[a << 20 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 20 | b in pairs]
        if not found:
            return symbols
        value, i = min(found, key=lambda x: (x[0] >> 20, x[1]))
        symbols[i : i + 2] = [value & 0xFFFFF]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=33), st.randoms(use_true_random=False))
def test_tree_equals_looking_at_all_pairs(symbols, random):
    import numpy as np

    pairs, made = {}, 4
    for rank in range(14):
        key = random.randrange(made) << 20 | random.randrange(made)
        if key not in pairs:
            pairs[key] = rank << 20 | made
            made += 1
    want = naive(symbols, pairs)
    assert bpe.merge(list(symbols), pairs) == want
    row = np.full((1, 33), -1, np.int64)
    row[0, : len(symbols)] = symbols
    got = bpe.merge_many(row, 32, bpe.Pairs(pairs))
    assert got[got >= 0].tolist() == want


def test_query_and_round_trip(edge_docs, no_docs, edge_rows, both):
    _, library = both
    want = []
    for doc_id, text, *_ in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, bpe.bpe_digests(edge_docs, vocabulary()).collect()))) == sorted(map(str, want))
    decoded = bpe.decode_documents(bpe.encode_documents(edge_docs, vocabulary()), vocabulary())
    assert decoded.where("doc_id = 6").first().decoded.endswith("tail</w>")
    assert bpe.bpe_digests(no_docs, vocabulary()).count() == 0
