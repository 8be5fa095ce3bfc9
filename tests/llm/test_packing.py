import math
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stainloom.llm import packing, queries
from stainloom.llm.packing import Words, pack, pack_shard

SCHEMA = "doc_id long, text string, lang string, ids string, place string"
ODD = [None, "", " \n\t ", "?!", "One more. Two, three.\nFour...", "One more. Two, three.\nFour...", "x" * 200_000, "a b c\n" * 9000, "WARC", "!. ok _, ok"]


@pytest.fixture(scope="module")
def source():
    return queries.tokenizer_source()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*((i, t, "en", "clash", None) for i, t in enumerate(ODD)), (None, "no id", None, None, None), (8, "WARC", "en", None, None)], SCHEMA)


def test_every_token_once(spark, docs, source):
    """All ids in one piece each; windows without gaps, whole or powers of two; null ids and repeated rows too."""
    tok = Words(source).tok
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in [*enumerate(ODD), (None, "no id")]}
    parts, windows = defaultdict(list), defaultdict(list)
    for r in pack(docs, source, 2).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        parts[r["doc_id"]].append((r["start"], ids))
        windows[r["sequence_id"]].append((r["offset"], len(ids)))
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    places = {i: sorted((s + k, x) for s, p in ps for k, x in enumerate(p)) for i, ps in parts.items()}
    assert places == {i: sorted(list(enumerate(x)) * (1 + (i == 8))) for i, x in want.items()}
    for w in windows.values():
        assert [o for o, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:k]) for k in range(len(w))]
        size = sum(n for _, n in w)
        assert size <= 4096 and size & (size - 1) == 0
    assert pack(docs.limit(0), source, 2).count() == 0


def test_words_like_the_tokenizer(source, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 8)
    w = Words(source)
    texts = ["Éàü ß Straße, ÏÏ| x|y it's <|endoftext|> ﬁ İ Σας é\xa0b \x1cq", " a　b 123 a1! ...", "a\x85b\u1680c\u2003d\u2028e\u202ff\u205fg\u200bh\u180ei “q” it’s — Ω", "A word. a word, A. \x01 b\x01 a_. b", *filter(None, ODD), "end."]
    for _ in range(3):
        for part in (texts, texts[::-1], texts[3:5]):
            for t, ids in zip(part, w.ids(part), strict=True):
                assert np.frombuffer(ids, w.kind).tolist() == w.tok.encode(t, add_special_tokens=False).ids
    assert len(w.old) < 100


def test_neighbours_like_plain_bm25():
    """The order of all neighbours by all terms, against BM25 written out; more terms than the dense part holds."""
    r = np.random.RandomState(0)
    docs = [r.zipf(1.3, r.randint(5, 200)).clip(0, 1999).astype("u4") for _ in range(60)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    near, mean = packing._neighbours(docs), sum(map(len, docs)) / len(docs)
    for i in range(0, 60, 7):
        unused = r.rand(60) < 0.8
        unused[i] = False
        score = {}
        for j in np.flatnonzero(unused).tolist():
            tf = Counter(docs[j].tolist())
            score[j] = sum(math.log1p((60 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[j]) / mean)) for t in set(docs[i].tolist()) if t in tf)
        got = near(i, unused).tolist()
        assert set(got) == {j for j, s in score.items() if s > 0}
        assert all(score[a] >= score[b] - 1e-3 for a, b in zip(got, got[1:], strict=False))


def test_seeds_are_followed_by_their_neighbours():
    r = np.random.RandomState(0)
    docs = [np.r_[r.randint(0, 9000, 90), 9000 + 5 * (i % 4) + np.repeat(np.arange(5), 2)].astype("u4") for i in range(16)]
    pieces = pack_shard(docs, 400)
    assert len({p[0] % 4 for p in pieces if p[3] == 0}) <= 2 and sum(p[2] for p in pieces) == 1600


def test_places_bring_related_documents_together(spark, source):
    """Documents of a subject are far apart in the input and near each other by place; hot places are parted."""
    subjects = ["volcano magma lava eruption crater", "violin cello sonata quartet viola", "enzyme protein peptide amino ribosome"]
    filler = "the of and to in a is that it was for on are as with".split()
    rows = []
    for i in range(300):
        r = np.random.RandomState(i)
        rows.append((i, " ".join([*r.choice(filler, 40), *r.permutation(subjects[i % 3].split())])))
    at, tokens, kind = packing.placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), source, 2)
    order = [r["doc_id"] % 3 for r in at.orderBy("place", "doc_id").collect()]
    alike = sum(a == b for a, b in zip(order, order[1:], strict=False)) / 299
    assert len(order) == 300 and alike > 0.7 and kind == np.dtype("<u2")
    same = spark.createDataFrame([(i, "the same text") for i in range(400)], "doc_id long, text string")
    parts = pack(same, source, 2).selectExpr("shiftright(sequence_id, 36) p").groupBy("p").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 200


def test_crc_of_pieces(docs, source):
    r = queries.pieces(pack(docs.filter("doc_id = 0"), source, 2)).first()
    assert r["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes()) and r["length"] == 1


def test_only_marks_take_the_whole_way(source, monkeypatch):
    """Words of letters and marks are put together from their runs, and equal the tokenizer's."""
    w, whole = Words(source), []
    texts = ["xyzzyq### (xyzzyq), xyzzyq xyzzyq7&&& ßyé***", "it's 'tis xyzzyq's a_b [c] 555-5481 <d> <|e é\u0301! x\xa0y\x85z x\x00y"]
    r = np.random.RandomState(0)
    texts += ["".join(r.choice(list("abéßÿZÀ019  \n\t.,!*#&$'<|>_-`~^\x01\x7f\x85\xa0\xad\u0301\u0130\u2003ﬁ字"), 60)) for _ in range(200)]
    encoded = w.encoded
    monkeypatch.setattr(w, "encoded", lambda t: whole.append(t) or encoded(t))
    for part in (texts[:1], texts, texts[::-1]):
        for t, ids in zip(part, w.ids(part), strict=True):
            assert np.frombuffer(ids, w.kind).tolist() == w.tok.encode(t, add_special_tokens=False).ids
        if part == texts[:1]:
            assert "xyzzyq" not in " ".join(whole)
    ids, count = w.rows(["a b", "", "a \x1c"], np.array([2], w.kind).tobytes())
    every = np.concatenate([np.frombuffer(x, w.kind) for x in ids.to_pylist()])
    assert count[2] == 3 and count.tolist() == np.bincount(every, minlength=w.size).tolist()


def test_an_idle_worker_holds_little():
    """What a worker holds after tasks with half a million different words."""
    code = """
import re, numpy as np, pyarrow as pa
from types import SimpleNamespace
from stainloom.llm import common, packing, queries
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
lean = getattr(common, "lean", lambda f: f)
run = lean(packing._tokenised(SimpleNamespace(value=queries.tokenizer_source()), 2))
def task(seed, n):
    r = np.random.RandomState(seed)
    texts = [" ".join("".join(map(chr, x)) for x in r.randint(97, 123, (1000, 9))) for _ in range(n)]
    for b in run(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], ["doc_id", "text"])])):
        pass
task(0, 1)
at = held()
for seed in (1, 2):
    task(seed, 250)
print("MB", held() - at)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert float(out.stdout.split("MB")[1]) < 60
