import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stainloom.llm import queries
from stainloom.llm.mixing import mix, mix_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber bison cedar delta ember fjord grove heron inlet jetty knoll lemur maple north otter plume quartz raven spruce thicket".split()


def prose(seed, n=70):
    r = np.random.RandomState(seed)
    words = [f"{WORDS[i]}{j}" for i, j in zip(r.randint(0, 20, n), r.randint(0, 90, n), strict=True)]
    return ". ".join(" ".join(words[k : k + 10]) for k in range(0, n, 10)) + "."


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i), "en", f"src{i % 6}", 0) for i in range(40)]
    menu = "home | about us | news | contact | more"
    out += [(40 + i, f"{menu}\n{prose(100 + i)}\n{menu}", "de", "src1", 0) for i in range(4)]  # cleaned
    out += [(50 + i, "\n".join([prose(110 + i, 50), *[menu] * 20]), "de", "src1", 0) for i in range(3)]  # loses too much
    out += [(60, "too short.", "en", "src0", 0), (61, None, "en", "src0", 0), (62, "", None, None, 0)]
    out += [(70 + i, prose(3), "en", "src2", 0) for i in range(4)]  # equal texts
    out += [(80 + i, prose(5).replace("north", f"south{i}", 1), "en", "src2", 0) for i in range(3)]  # near copies
    out += [(None, prose(7), "en", "src3", 0), (None, prose(200), "en", "src3", 0), (None, prose(200), "en", "src3", 0)]
    out += [out[8], out[8], (9, prose(201), "en", "src4", 0), (9, prose(202), None, "src4", 0)]  # repeated rows and ids
    return [(*r[:4], len(r[1] or "")) for r in out]


def of(frame):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in frame.collect())


def sets(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_filters_like_brute_force(spark, rows):
    """The first three stages, each on what its predecessor kept, against plain loops over all rows."""
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for i, t, lang, source, _ in rows:
        lines = [x for x in (t or "").split("\n") if len(re.findall(r"[|>»•]", x)) < 3]
        if len((t or "").split()) >= 50 and 2 * len(" ".join(lines).split()) >= len(t.split()):
            want[i, "\n".join(lines), lang, source, len("\n".join(lines))] += 1
    first = corpus_pipeline.quality(spark, docs, "")
    assert first.schema == docs.schema and of(first) == want and len(want) < len(rows) - 5

    best = {}
    for r in want:
        if r[1] not in best or (-1 if r[0] is None else r[0]) > (-1 if best[r[1]][0] is None else best[r[1]][0]):
            best[r[1]] = r
    second = corpus_pipeline.exact(spark, first, "")
    assert of(second) == Counter(best.values())

    left = list(best.values())
    top = {r: r[0] for r in left}
    alike = [(a, b) for a in left for b in left if a is not b and 10 * len(sets(a[1]) & sets(b[1])) >= 8 * len(sets(a[1]) | sets(b[1]))]
    assert alike
    for _ in range(5):
        for a, b in alike:
            top[a] = top[b] = min(top[a], top[b])
    stay = {r[0] for r in left if top[r] == r[0]}
    third = corpus_pipeline.near(spark, second, "")
    assert third.schema == docs.schema and of(third) == Counter(r for r in left if r[0] is None or r[0] in stay)


def test_stages_in_order(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = defaultdict(int)
    for r in got:
        whole[r["doc_id"]] += r["length"]
        assert r["length"] <= 4096
    want = defaultdict(int)
    tok = Tokenizer.from_str(queries.tokenizer_source())
    for r in docs.collect():
        want[r["doc_id"]] += len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
    assert whole == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_mixing_meets_its_targets(spark):
    """A scarce domain is repeated up to its weight, in copies; the last documents of leaves are cut."""
    rows = []
    for i in range(200):
        source = "src0" if i < 40 else "src3" if i < 60 else "src5" if i < 80 else "src9"
        text = f" \n{i}" + "".join(f"  w{i}\t{j}" for j in range(5))
        rows.append((None if i == 0 else 7 if i in (50, 51) else i, text, "en", source, len(text)))
    rows.append(rows[90])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.mixing(spark, docs, "").collect()
    taken = mix(docs, corpus_pipeline.MIX_SHARE, queries.WEIGHTS, queries.DOMAINS, max_epochs=corpus_pipeline.MIX_EPOCHS).collect()
    assert sorted((r["doc_id"] or -1, len(r["text"].split())) for r in got) == sorted((r["doc_id"] or -1, r["take_tokens"]) for r in taken)
    whole = {(r[0], r[1]) for r in rows}
    assert all(any(i == r["doc_id"] and t.startswith(r["text"]) for i, t in whole) and r["n_chars"] == len(r["text"]) for r in got)
    by, total = Counter(), 0
    for r in got:
        by[queries.DOMAINS.get(r["source"], "other")] += len(r["text"].split())
    total = sum(by.values())
    for domain, weight in queries.WEIGHTS["domain"].items():
        assert abs(by["other" if domain == "*" else domain] / total - weight / 11) < 0.01
    assert max(Counter((r["doc_id"], r["text"]) for r in got).values()) == 2


@pytest.mark.parametrize("share", [0.13, 0.35, 0.5, 0.77])
def test_rows_of_one_id_at_the_end(spark, share):
    """One id on every row, so that the last row of each leaf is among rows with the same hash."""
    rows = [(1, "w " * (1 + i % 7), "en", "s", i, "clash") for i in range(30)] + [(1, None, "en", "s", 0, None), (1, " ", None, None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row long, epoch string")
    taken = mix(docs, share, {}, {}).collect()
    got = [len(r["text"].split()) if r["_take"] is None else r["_take"] for r in mix_rows(docs, share, {}, {}).collect()]
    assert sorted(got) == sorted(r["take_tokens"] for r in taken)
