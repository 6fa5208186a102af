"""Mixing and the URL filter."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillframe.llm import mixing, urlfilter


def plain_fill(budget, caps, weights):
    """Whole-token water filling by repeated rounds, as fractions."""
    from fractions import Fraction

    open_, given = {k for k in caps if weights[k] > 0}, {}
    left = Fraction(budget)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= left * weights[k]}
        if not full:
            exact = {k: left * weights[k] / total for k in open_}
            over = int(left - sum(int(x) for x in exact.values()))
            first = sorted(open_, key=lambda k: (int(exact[k]) - exact[k], k))[:over]
            return given | {k: int(exact[k]) + (k in first) for k in open_}
        for k in full:
            given[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return given


def test_water_fill_equals_rounds(spark):
    rng = random.Random(4)
    for _ in range(12):
        caps = {f"c{k}": rng.randrange(0, 1000) for k in range(rng.randrange(1, 9))}
        weights = {k: rng.randrange(1, 6) for k in caps}
        budget = rng.randrange(0, 4000)
        nodes = spark.createDataFrame([("p", k, caps[k], weights[k], budget) for k in caps], "p string, name string, cap long, weight long, parent_budget long")
        got = {r["name"]: r["budget"] for r in mixing.water_fill(nodes, ["p"], "name").collect()}
        assert got == plain_fill(budget, caps, weights)


def test_mix_takes_exact_budgets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["d0", "d1"]), rng.choice(["en", "de"]), f"s{rng.randrange(3)}", rng.randrange(0, 50), 5) for i in range(400)]
    rows += [(None, "d0", "en", "s0", 7, 5), (3, "d0", "en", "s0", 9, 5), (3, "d0", "en", "s0", 9, 5)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long, rows int").drop("rows")
    got = mixing.mix(df, ["domain", "lang", "source"], mixing.weights()).collect()
    taken = sum(r["epochs_taken"] * r["n_tokens"] + r["prefix_tokens"] for r in got)
    total = sum(r[4] for r in rows) * mixing.SHARE // 100
    assert taken == total
    assert all(0 <= r["prefix_tokens"] <= r["n_tokens"] and r["epochs_taken"] <= mixing.EPOCHS for r in got)
    for leaf in {tuple(r)[1:4] for r in got}:
        assert len({r["epochs_taken"] for r in got if tuple(r)[1:4] == leaf and r["prefix_tokens"] == 0} | {r["epochs_taken"] for r in got if tuple(r)[1:4] == leaf}) == 1
    assert mixing.mix(df.limit(0), ["domain", "lang", "source"], mixing.weights()).count() == 0


def test_rows_without_id_are_dealt_over_buckets_and_budgets_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(None, "d0", "en", "s", 1 + i % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    got = sorted((r["n_tokens"], r["epochs_taken"], r["prefix_tokens"]) for r in mixing.mix(df, ["domain", "lang", "source"], mixing.weights()).collect())
    assert sum(n * e + p for n, e, p in got) == sum(r[4] for r in rows) * mixing.SHARE // 100
    again = mixing.mix(df.repartition(7, "n_tokens"), ["domain", "lang", "source"], mixing.weights())
    assert sorted((r["n_tokens"], r["epochs_taken"], r["prefix_tokens"]) for r in again.collect()) == got


def test_repeated_urls_score_alike(spark):
    rows = [(k, u) for k, u in enumerate(["https://a.net/de/1", "https://b.org/es/2", "https://c.info/x", "https://c.info/x", None, None, ""])]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    of = {r["page_id"]: (r["verdict"], r["llr"]) for r in got}
    assert len(got) == 7 and of[2] == of[3] and of[4] == of[5] == of[6]


def test_buckets_do_not_change_what_is_taken(spark, monkeypatch):
    df = spark.createDataFrame([(i, "d0", "en", "s", 1 + i % 9) for i in range(500)], "doc_id long, domain string, lang string, source string, n_tokens long")
    take = lambda: {tuple(r) for r in mixing.mix(df, ["domain", "lang", "source"], mixing.weights()).collect()}
    one = take()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    assert take() == one


def test_document_leaves_take_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None, 0), (2, " a  b\tc\n", "en", "src6", 0), (3, "", "xx", "other", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(r) for r in mixing.document_leaves(df).collect())
    assert got == [(1, "other", "(none)", "(none)", 0), (2, "d2", "en", "src6", 3), (3, "other", "xx", "other", 0)]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


URLS = [
    "http://A.Example.COM/en/7?x=1", "http://example.com/en/8", "http://example.com/en/712", "http://notexample.com/en/7", "http://com/en/", "http://x.net/de/8", "http://example.net/de/8", "http://my.example.net/de/81",
    "http://example.net/de/", "https://x.org/es/#f", "https://x.org/es", "https://org/es/a", "no scheme", "", None, "x://h?q/en/", "http://h#/en/", "a://b://c.com/en/", "http://x.com:80/en/", "http://É.com/en/1", "HTTP://x.com/EN/1",
]


def test_rules_by_brute_force(spark):
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)] + [(None, "http://x.com/en/", "v"), (0, URLS[0], "v")], "page_id long, url string, verdict string")
    got = urlfilter.filter_urls(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain_rule(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert urlfilter.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urlfilter.filter_urls(df.where("url = 'no scheme'")).collect()} == {"allow"}


def test_models_tell_undecided_urls_apart(spark):
    rows = [(i, f"http://h{i % 40}.net/de/{i}-guter-artikel") for i in range(300)] + [(1000 + i, f"http://w{i % 40}.org/es/{i}?spam=casino") for i in range(300)]
    new = [(5000, "http://h9.info/xx/77-guter-artikel"), (5001, "http://w9.info/yy/77?spam=casino")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(spark.createDataFrame(rows + new, "page_id long, url string")).where("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}
