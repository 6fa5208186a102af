import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm import packing


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=80, deadline=None)
def test_tournament_tree_places_as_a_plain_scan(sizes):
    bins = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b in bins:
            if sum(sizes[i] for i in b) + sizes[k] <= 64:
                b.append(k)
                break
        else:
            bins.append([k])
    assert packing.first_fit_decreasing(sizes, 64) == bins


@given(st.lists(st.integers(1, 300), max_size=40))
@settings(max_examples=80, deadline=None)
def test_groups_are_whole_and_without_padding(lengths):
    seqs = packing.pack_group(lengths, 64)
    seen = defaultdict(list)
    for s in seqs:
        n = sum(p[2] for p in s)
        assert 0 < n <= 64 and (n == 64 or n & (n - 1) == 0)
        for d, a, z in s:
            seen[d].append((a, z))
    for d, n in enumerate(lengths):
        at = 0
        for a, z in sorted(seen[d]):
            assert a == at and z > 0
            at += z
        assert at == n


def test_words_are_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    whole, mine = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for t in ["", " ", "Hello, World!", "it's we'll don't x1y22", "ÉÇ naïve Straße ñandú", "İstanbul ΣΑΣ", "a\x1cb\x85c d", "<|endoftext|> z", "é decomposed", "tab\tnew\r\nline", "日本語 🙂!!", "word. word, (word) 'quoted'", "...--- a_b"]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def check_pieces(rows, docs, ids_of):
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0
    for d, text in docs:
        ids = ids_of(text or "") + [1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_pack_edge_cases(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    docs = [(1, "a b c"), (2, None), (3, ""), (None, "null id"), (5, "long word " * 3000), (6, "x")]
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, length int, offset string")
    check_pieces(packing.pack(df).collect(), docs, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_rows_are_packed_as_often(spark):
    df = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(df).collect()) == 20
