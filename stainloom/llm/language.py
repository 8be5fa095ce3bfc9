"""Language identification by compression.

For each language a raw-content dictionary of zstandard is filled with sample texts. A text belongs
to the language whose dictionary makes it smallest. The margin to the second smallest tells how
sure that is; the operator rejects answers with narrow margins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The classifier is fitted on a bounded sample: so many texts of a language at most, of so many
#: characters at most each, cut to so many bytes in all. Longer texts give their beginning.
SAMPLE_DOCS = 1024
SAMPLE_CHARS = 20_000
DICT_BYTES = 96 * 1024
LEVEL = 6
#: Share of the second-best size by which the best must be smaller.
MARGIN = 0.01


def folded(text: Column) -> Column:
    """Words of letters in lower case, with one space between: marks, digits and case say nothing of the language."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " "))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each language, from texts with small hashes of text and id; the language with most texts first.

    Texts without letters and null languages are left out. Languages are counted over all rows, and
    the counts say below which hash a language's sample lies, so few texts are shuffled. What is
    gathered is bounded by the sample for each language.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"), F.xxhash64(id_col, text_col).alias("h")).filter("lang is not null and t is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    below = F.lit(2.0)
    for lang, n in counts.items():
        below = F.when(F.col("lang") == lang, 2 * SAMPLE_DOCS / n).otherwise(below)
    order = Window.partitionBy("lang").orderBy("h", "t")
    texts = rows.filter(F.pmod("h", F.lit(1 << 30)) / (1 << 30) < below).select("lang", "h", F.substring(folded(F.col("t")), 1, SAMPLE_CHARS).alias("t")).filter("t <> ''")
    texts = texts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS)
    found: dict[str, list] = {}
    for r in texts.collect():
        found.setdefault(r["lang"], []).append((r["n"], r["t"].encode()))
    out = {}
    for lang in sorted(found, key=lambda x: (-counts[x], x)):
        part = DICT_BYTES // len(found[lang])
        rows = [t for _, t in sorted(found[lang])]
        # Every text gives its share first; what short ones leave is filled by the rest of longer ones.
        heads, rest = [t[:part] for t in rows], b" ".join(t[part:] for t in rows if len(t) > part)
        head = b" ".join(heads)
        out[lang] = (rest[: max(0, DICT_BYTES - len(head))] + b" " + head)[-DICT_BYTES:]
    return out


def language_id(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """Predicts the language of each whole text; one row for each row of docs.

    Returns doc_id, lang_pred (best language; ``und`` for a null text, one without a letter, or
    when nothing was learned), score (share by which the best size is below the second best, 0 to
    1), and lang (as lang_pred, but ``und`` where the score is below ``margin``). Ties go to the
    language that comes first in ``dictionaries``, with score 0. Texts are folded, whole, and
    compressed one at a time; no shuffle. Repeated rows and ids are judged each for itself, other
    columns are ignored, and an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(list(dictionaries.items()))

    def run(batches):
        import zstandard

        tools = []
        for lang, raw in held.value:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            tools.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False)))
        for b in batches:
            best, scores = [], []
            for t in b.column(1).to_pylist():
                if not t or not tools:
                    best.append("und")
                    scores.append(0.0)
                    continue
                raw = t.encode()
                sizes = sorted((len(c.compress(raw)), k) for k, (_, c) in enumerate(tools))
                best.append(tools[sizes[0][1]][0])
                scores.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    t = folded(F.col(text_col).cast("string"))
    # A text of marks that stand on letters alone has no letter.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(t.rlike("\\p{L}"), t).alias("t"))
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.withColumn("lang", F.when(F.col("score") >= margin, F.col("lang_pred")).otherwise("und"))
