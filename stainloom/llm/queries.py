"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stainloom.llm import line_dedup, sql, warc
from stainloom.llm.common import shared_dir, table
from stainloom.llm.exact_dedup import exact_dedup
from stainloom.llm.language import fit, language_id
from stainloom.llm.licenses import license_scan
from stainloom.llm.mixing import mix
from stainloom.llm.near_dedup import near_dedup
from stainloom.llm.packing import pack
from stainloom.llm.quality import quality_rules
from stainloom.llm.urls import host_of, url_filter

#: Fixed values of the URL rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: Fixed values of the mixture: domains of the sources and weights by level.
DOMAINS = {"src0": "web", "src1": "web", "src2": "web", "src3": "news", "src4": "news", "src5": "books", "src6": "books"}
WEIGHTS = {"domain": {"web": 4, "news": 2, "books": 2, "*": 3}, "lang": {"en": 4, "de": 2, "*": 1}, "source": {"src0": 1, "*": 1}}


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.summary(docs, line_dedup.line_decisions(docs))
    return out.withColumn("kept_lines", F.array_join("kept_lines", ","))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).withColumn("sentence_places", F.array_join("sentence_places", ","))


def op4_url_filter(spark, sf_dir):
    """The list: all URLs of hosts named spam-farm, which block the same pages under other names of the host."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(host_of(F.col("url")).rlike("(^|\\.)spam-farm\\.")).select("url")
    return url_filter(pages, listed, URL_RULES)


def op5_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), shingle=4)


def op6_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    out = warc.read_archives(spark, path)
    return out.select(F.col("page_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast(kind).alias("refers_to"))


def tokenizer_source() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def pieces(packed):
    """The digest of packed pieces."""
    return packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark, sf_dir):
    return pieces(pack(table(spark, sf_dir, "documents"), tokenizer_source(), end_id=2))


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), 0.6, WEIGHTS, DOMAINS)


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    dictionaries = fit(docs.filter(~held))
    out = language_id(docs, dictionaries)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "lang")


_ALL = [
    op1_line_dedup, op2_exact_dedup, op3_license_scan, op4_url_filter, op5_near_dedup, op6_warc,
    op7_packing, op8_mixing, op9_quality_rules, op10_language_id,
]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {**sql.SQL, "op8_mixing": sql.mixing(0.6, WEIGHTS, DOMAINS)}
