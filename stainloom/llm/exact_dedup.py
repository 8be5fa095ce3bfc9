"""Exact dedup by two passes with a Bloom filter.

The first pass marks the slots of all text hashes in a counting Bloom filter whose counters end at
two. Each task makes the filter of its own rows and emits only the slots that it touched, by
segment of the filter; the segments are added up in parallel. The second pass asks which rows have
all slots marked twice. Only those rows can have an equal and are shuffled, as a digest and an id;
the rest pass straight through. Texts never move.

False positives cost a little shuffle and change nothing: groups are made on SHA-256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainloom.llm.common import cut, join_counted, text_of

#: log2 of the slots of a segment.
SEGMENT = 16
PROBES = 4


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES slots of each 64-bit hash among 2**bits, by double hashing."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    k = np.arange(PROBES, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return ((h[None, :] * np.uint64(0xD1B54A32D192ED03) + k * step[None, :]) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(bits: int):
    """Of each task, the segments that it touches with the slots marked once and more often."""

    def run(batches):
        parts, held = [], 0

        def flush():
            slots, n = np.unique(np.concatenate(parts), return_counts=True)
            seg = slots >> SEGMENT
            edges = np.flatnonzero(np.diff(seg)) + 1
            low, twice = (slots & ((1 << SEGMENT) - 1)).astype(np.uint16), n > 1
            return pa.RecordBatch.from_pydict(
                {
                    "seg": pa.array(seg[np.r_[0, edges]], pa.int32()),
                    "once": pa.array([x.tobytes() for x in np.split(low, edges)], pa.binary()),
                    "twice": pa.array([a[b].tobytes() for a, b in zip(np.split(low, edges), np.split(twice, edges), strict=True)], pa.binary()),
                }
            )

        for b in batches:
            if b.num_rows:
                parts.append(_slots(b.column(0).to_numpy(zero_copy_only=False), bits).ravel())
                held += len(parts[-1])
                if held > 4_000_000:
                    yield flush()
                    parts, held = [], 0
        if held:
            yield flush()

    return run


def _add(pdf):
    """One segment: slots that two rows or more have marked."""
    import pandas as pd

    n = 1 << SEGMENT
    seen, twice = np.zeros(n, bool), np.zeros(n, bool)
    for once, more in zip(pdf["once"], pdf["twice"], strict=True):
        at = np.frombuffer(once, np.uint16)
        twice[at[seen[at]]] = True
        seen[at] = True
        twice[np.frombuffer(more, np.uint16)] = True
    packed = [np.packbits(twice).tobytes()] if twice.any() else []
    return pd.DataFrame({"seg": pdf["seg"].iloc[: len(packed)], "bits": packed})


def repeated_filter(hashes: DataFrame, bits: int) -> dict[int, bytes]:
    """Segments with slots that are marked twice or more; 2**(bits-3) bytes at most, whatever the input."""
    rows = hashes.mapInArrow(_marks(bits), "seg int, once binary, twice binary")
    return {r["seg"]: r["bits"] for r in rows.groupBy("seg").applyInPandas(_add, "seg int, bits binary").collect()}


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 30) -> DataFrame:
    """Groups of documents with identical texts; the largest id of each group stays.

    Returns for every row: doc_id, keep_id, group_size, kept, text_sha256. A null text counts as
    empty, and empty texts equal each other. Rows that repeat an id with the same text count in
    group_size and get the same answer. A null id is never the largest; a group of null ids only
    keeps them. Other columns of the input are ignored, whatever their names. An empty table gives
    no rows.

    The filter has 16 slots a row, as a power of two up to 2**max_bits (128 MB sent to each
    executor at the default); a larger input fills it more, so more rows are shuffled, and the
    result is the same.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    n = docs.count()
    bits = min(max_bits, max(SEGMENT, int(16 * n).bit_length()))
    filled = spark.sparkContext.broadcast(repeated_filter(rows.select(F.xxhash64("_t").alias("h")), bits))

    def asks(batches):
        for b in batches:
            slots = _slots(b.column("h").to_numpy(zero_copy_only=False), bits)
            hit = np.ones(slots.shape[1], bool)
            for probe in slots:
                at = np.flatnonzero(hit)
                seg, low = probe[at] >> SEGMENT, probe[at] & ((1 << SEGMENT) - 1)
                for s in np.unique(seg):
                    of = at[seg == s]
                    if (bits_of := filled.value.get(int(s))) is None:
                        hit[of] = False
                    else:
                        x = low[seg == s]
                        hit[of] = (np.frombuffer(bits_of, np.uint8)[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_sha256"), pa.array(hit)], ["doc_id", "text_sha256", "maybe"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    hashed = rows.select("doc_id", F.sha2("_t", 256).alias("text_sha256"), F.xxhash64("_t").alias("h"))
    asked = cut(hashed.mapInArrow(asks, f"doc_id {kind}, text_sha256 string, maybe boolean"))
    maybe = asked.filter("maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    met = join_counted(maybe, groups, "text_sha256", "group_size", max(1000, n // 1000))
    alone = asked.filter("not maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return met.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
