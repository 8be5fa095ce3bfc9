"""Nulls, empty tables, repeated rows, ties and clashing names, operator by operator."""

import hashlib
from collections import Counter

from stainloom.llm import queries
from stainloom.llm.exact_dedup import exact_dedup
from stainloom.llm.mixing import mix
from stainloom.llm.quality import quality_rules
from stainloom.llm.urls import url_filter


def test_urls(spark):
    rows = [(1, "http://www.bad.org/x/"), (1, "http://www.bad.org/x/"), (2, "https://m.bad.org:80/x.html?utm_source=q"), (3, "http://good.org/" + "p" * 100_000), (None, "http://bad.org/x"), (4, None), (5, ""), (6, "://"), (7, "http://net/de/8"), (8, "a://b://example.net/de/8")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, _n string")
    listed = spark.createDataFrame([("http://bad.org/x", 1), ("http://bad.org/x", 2), (None, 3), ("no", 4)], "url string, listed int")
    got = [(r["page_id"], r["host"], r["verdict"]) for r in url_filter(pages, listed, queries.URL_RULES).collect()]
    assert Counter(got) == Counter(
        [(1, "www.bad.org", "block")] * 2 + [(2, "m.bad.org:80", "block"), (3, "good.org", "allow"), (None, "bad.org", "block"), (4, "", "allow"), (5, "", "allow"), (6, "", "allow"), (7, "net", "allow"), (8, "b:", "allow")]
    )
    assert {r["verdict"] for r in url_filter(pages, listed.limit(0), []).collect()} == {"allow"}
    assert url_filter(pages.limit(0), listed, queries.URL_RULES).count() == 0
    tie = url_filter(pages.filter("page_id = 7"), listed, [("block", "net/d"), ("allow", "net/d")]).first()
    assert tie["rule"] == "net/d" and tie["verdict"] in ("allow", "block")


def test_exact_ties_and_repeated_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None), (4, ""), (5, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, keep_id string, h int")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([
        (1, 1, 2, True, sha("a")), (1, 1, 2, True, sha("a")), (1, 2, 2, False, sha("b")), (2, 2, 2, True, sha("b")), (None, None, 2, True, sha("c")), (None, None, 2, True, sha("c")),
        (3, 4, 2, False, sha("")), (4, 4, 2, True, sha("")), (5, 5, 1, True, sha("x" * 300_000)),
    ])


def test_mixing_of_nulls_and_repeats(spark):
    rows = [(1, "a b c", None, None), (1, "a b c", None, None), (2, None, "en", "s"), (3, " \n", "en", "s"), (None, "a b", "en", "s"), (4, "w " * 20_000, "en", "s")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, domain string, n_tokens int")
    got = mix(docs, 1.0, {}, {}, max_epochs=1).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], r["domain"], r["n_tokens"], r["take_tokens"]) for r in got) == Counter(
        [(1, "unknown", "unknown", "other", 3, 3)] * 2 + [(None, "en", "s", "other", 2, 2), (4, "en", "s", "other", 20_000, 20_000)]
    )
    half = mix(docs, 0.5, {}, {}, max_epochs=1).collect()
    assert sum(r["take_tokens"] for r in half) == 10_004 and all(0 < r["take_tokens"] <= r["n_tokens"] for r in half)
    assert mix(docs.filter("text is null"), 0.5, {}, {}).count() == 0


def test_quality_of_repeated_rows(spark):
    good = " ".join(f"word{i} other{i} third{i} fourth{i} fifth{i}." for i in range(15))
    docs = spark.createDataFrame([(1, good, "x", 1), (1, good, "x", 2), (1, "short", "x", 3), (None, good, None, None)], "doc_id long, text string, kept string, _bad int")
    got = quality_rules(docs).collect()
    assert Counter((r["doc_id"], r["kept"], r["n_words"]) for r in got) == Counter([(1, True, 75), (1, True, 75), (1, False, 1), (None, True, 75)])
