import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillframe.llm import minhash
from quillframe.llm.buffers import utf8_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(docs, percent):
    sets = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(docs)}


def test_sets_have_the_right_sizes():
    texts = ["a b c d e f", "A B C D E F", "a b", "", None, " \t\n", "x y z x y z x y z", "é è ê ë ē ĕ", "one\x0btwo\x0cthree four five"]
    u, so = minhash.shingle_sets(*utf8_bytes(pa.array(texts)), 5)
    assert np.diff(so).tolist() == [len(plain_set(t)) for t in texts]
    assert (u[so[0] : so[1]] == u[so[1] : so[2]]).all()


def family(rng, n, words=60, edits=4):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"n{rng.randrange(50)}"
        yield " ".join(w)


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    rng = random.Random(1)
    texts = [t for _ in range(6) for t in family(rng, 25)] + [None, "", "a b", "a b", "A B", "c"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 3, 4) for d in docs], "doc_id long, text string, n long, component_id int")
    got = {tuple(r) for r in minhash.near_duplicates(df, percent=percent, groups=24).collect()}
    assert got == plain(docs, percent)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (4, text), (9, text), (9, text), (None, "alone in the world of words")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, 2, 4, False), (4, 2, 4, True), (9, 2, 4, False), (9, 2, 4, False), (None, 2, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype(np.uint64)) for _ in range(80)]
    so = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    c = minhash.overlaps(np.concatenate(sets), so)
    for i in range(80):
        for j in range(80):
            if i != j:
                assert c[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_registered_parameters_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [t for k in range(8) for t in family(rng, 20, words=40 + 15 * k, edits=3)]
    docs = list(enumerate(texts))
    got = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain(docs, 85)


def test_near_copies_without_ids_are_linked(spark):
    words = [f"w{k}" for k in range(80)]
    a, b = " ".join(words), " ".join([*words, "more"])
    c = " ".join(f"v{k}" for k in range(80))
    rows = [(None, a), (7, b), (None, c), (None, c + " more"), (3, "quite other words stand in this one")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 76, 7), (7, 77, 7), (None, 76, None), (None, 77, None), (3, 3, 3)], key=str)


def test_a_chain_of_chance_collisions_links_nothing_that_is_not_alike(spark):
    # Each text shares half of its words in a row with the next, so candidates meet, but no two are alike.
    words = [f"w{k}" for k in range(60 * 40)]
    docs = [(k, " ".join(words[30 * k : 30 * k + 60])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash.near_duplicates(df, groups=24, width=1).collect()  # single minhashes: nearly all pairs in the chain collide
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got) and len(got) == 60


def test_pieces_do_not_change_words_and_very_long_rows_pass():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abC  \n\t"), 3000))
    data, offs = utf8_bytes(pa.array([text, "", "x" * 50, text[:77] + "y"]))
    whole = minhash.word_hashes(data, offs)
    for piece in (1, 2, 7, 64, 1000):
        h, wo = minhash.word_hashes(data, offs, piece)
        assert (h == whole[0]).all() and (wo == whole[1]).all()
    long = "some words of a very long text " * 1_500_000  # 46 MB
    s = minhash.signatures(pa.array([long, "some words of a very long text " * 3]), 5, 2, 2)
    assert s.field("n").to_pylist() == [7, 7] and s.field("d1").to_pylist()[0] == s.field("d1").to_pylist()[1]
