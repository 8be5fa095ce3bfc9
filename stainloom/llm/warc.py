"""WARC archives: written as plain text files, read back by verified chains of record boundaries.

A reader can't trust the magic alone, since payloads may hold it. Archives are read by byte ranges
that are cut at every magic. Tasks emit for each magic the offset that its header names as the next
record's. Pointer jumping, first within a range and then between ranges, keeps the records that a
chain of true lengths reaches from the start of a file; the others are parts of payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stainloom.llm.common import cut, join_counted, maybe_in

MAGIC, BREAK = b"WARC/1.1\r\n", b"\r\n\r\n"
RECORDS_A_FILE = 1024
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits at a time, five hex digits make four letters."""
    hexed, out = F.sha1(payload), []
    for k in range(8):
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> None:
    """A record for each page; of equal payloads the smallest id is the response, the others revisit it.

    A null html is an empty payload, and empty payloads equal each other. Null ids are written
    empty and are never the smallest unless alone; a repeated id with the same payload is written
    each time alike. Line breaks in a url are dropped. Files hold at most RECORDS_A_FILE records.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]", "").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Payloads that surely have no equal are written where they were read; only the others move.
    groups = cut(groups.filter("n > 1"))
    key = F.col("digest")
    rows = maybe_in(rows, key, groups, key, groups.count(), "_may")
    met = join_counted(rows.filter("_may"), groups, "digest", "n", 1000)
    alone = rows.filter("_may").join(groups.select("digest"), "digest", "left_anti").unionByName(rows.filter("not _may"))
    rows = met.drop("_may", "n").unionByName(alone.drop("_may").withColumn("first", F.col("page_id")))
    again = F.col("page_id") != F.col("first")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html"), F.lit("\r\n\r\n"))
    block = F.when(F.coalesce(again, F.lit(False)), http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    kind = F.when(
        F.coalesce(again, F.lit(False)),
        F.concat(F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("first")),
    ).otherwise("WARC-Type: response")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), kind, F.lit("\r\nWARC-Record-ID: "), urn("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.octet_length("html"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block"), F.lit("\r\n\r\n"), F.col("_block"),
    )
    rows.withColumn("_block", block).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _fields(header: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in header.split(b"\r\n"))}


def _size(text: bytes) -> tuple[int, int]:
    """Of a text behind a magic, where its first empty line begins and the last Content-Length before it; -1 for none.

    A header ends at the first empty line, however far that is.
    """
    end = text.find(BREAK)
    stop = len(text) if end < 0 else end
    while stop > 0:
        line = text.rfind(b"\r\n", 0, stop) + 2
        line = line if line > 1 else 0
        k, _, v = text[line:stop].partition(b":")
        if k.strip().lower() == b"content-length":
            return end, int(v) if v.strip().isdigit() else -1
        stop = line - 2
    return end, -1


def _numbered(batches):
    """Rows of texts with their number in their byte range: (path, block, i, text)."""
    at, i = None, 0
    for b in batches:
        for path, block, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            i = i + 1 if at == (path, block) else 0
            at = (path, block)
            yield path, block, i, text.as_py()


def _batched(rows, names: list[str], kinds: list, most: int = 1 << 24):
    """Record batches of rows, of some 2000 rows or ``most`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if len(held) >= 2000 or size > most:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in enumerate(kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in enumerate(kinds)], names)


def _marks(batches):
    """Of each text its length with a magic, its first empty line and the length before it (null for none)."""

    def rows():
        for path, block, i, text in _numbered(batches):
            end, n = _size(text)
            yield path, block, i, len(text) + len(MAGIC), None if end < 0 else end, None if n < 0 else n

    yield from _batched(rows(), ["path", "block", "i", "size", "empty", "n"], [pa.string(), *[pa.int64()] * 5])


def jumped(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The first offset outside that the chain of each offset leads to, by pointer jumping; chains go forward."""
    order = np.argsort(at)
    at, end = at[order], to[order].copy()
    for _ in range(int(len(at)).bit_length() + 1):
        k = np.minimum(np.searchsorted(at, end), len(at) - 1)
        inside = at[k] == end
        if not inside.any():
            break
        end = np.where(inside, end[k], end)
    out = np.empty_like(end)
    out[order] = end
    return out


def _ends(t: pa.Table) -> pa.Table:
    """A range's candidates with the offset at which their chains leave it."""
    at, to = t.column("at").to_numpy(), t.column("next").to_numpy()
    return t.append_column("leaves", pa.array(jumped(at, to)))


def _reached(t: pa.Table) -> pa.Table:
    """A range's candidates on the chain from where it is entered."""
    at, to, enter = t.column("at").to_numpy(), t.column("next").to_numpy(), t.column("enter").to_numpy()[0]
    step = dict(zip(at.tolist(), to.tolist(), strict=True))
    keep, x = set(), int(enter)
    while x in step:
        keep.add(x)
        x = step[x]
    return t.filter(pa.array([a in keep for a in at.tolist()], pa.bool_())).select(["path", "block", "i", "at", "next"])


def chained(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records (path, block, i, at, next) that the chains of files reach, and the places of all texts.

    texts has path, block, value: what lies between magics, in order. Only numbers are shuffled: a
    range's in one task, then one row of each range that a chain enters.
    """
    marks = cut(texts.mapInArrow(_marks, "path string, block long, i long, size long, empty long, n long"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = marks.groupBy("path", "block").agg(F.sum("size").alias("s"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("s").over(before("path").orderBy("block")), F.lit(0)).alias("base"))
    # The first text of a file has no magic before it, so a text's magic begins before what the sums say.
    start = F.col("base") + F.coalesce(F.sum("size").over(before("path", "block").orderBy("i")), F.lit(0)) - len(MAGIC)
    places = cut(marks.join(blocks, ["path", "block"]).select("path", "block", "i", "size", "empty", "n", start.alias("at")))
    # A header can hold magics too: it ends at the first empty line of this text or a later one.
    # Both windows grow row by row, the second one from the file's end.
    so_far = lambda by: Window.partitionBy("path").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("n").isNotNull(), F.struct("at", "n")), True).over(so_far("at"))
    ends = F.when(F.col("empty").isNotNull(), F.struct((F.col("at") + len(MAGIC) + F.col("empty")).alias("end"), "known"))
    found = places.withColumn("known", known).withColumn("head", F.last(ends, True).over(so_far(F.desc("at"))))
    found = found.filter("at >= 0 and head.known.at >= at").select("path", "block", "i", "at", (F.col("head.end") + 2 * len(BREAK) + F.col("head.known.n")).alias("next"))
    kinds = "path string, block long, i long, at long, next long"
    found = cut(found.groupBy("path", "block").applyInArrow(_ends, f"{kinds}, leaves long"))
    # Between ranges: an entry leads to the entry of another range, in a logarithmic number of rounds.
    jump = found.select("path", "at", F.col("leaves").alias("to"))
    seen = cut(jump.filter("at = 0").select("path", "at"))
    n = -1
    while n != (now := seen.count()):
        n = now
        seen = cut(seen.join(jump, ["path", "at"]).select("path", F.col("to").alias("at")).join(jump.select("path", "at"), ["path", "at"], "left_semi").unionByName(seen).distinct())
        if n < seen.count():
            to = jump.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
            jump = cut(jump.join(to, ["path", "to"], "left").select("path", "at", F.coalesce("far", "to").alias("to")))
    enter = found.join(seen, ["path", "at"]).groupBy("path", "block").agg(F.min("at").alias("enter"))
    return found.join(enter, ["path", "block"]).groupBy("path", "block").applyInArrow(_reached, kinds), places


def _record(text: bytes) -> tuple:
    """page_id, record_type, refers_to, url, payload, payload_bytes, payload_digest of a whole record behind its magic."""
    stop, n = _size(text)
    f, begin = _fields(text[:stop]), stop + len(BREAK)
    end = begin + n
    head = text.find(BREAK, begin, end)
    payload = text[head + len(BREAK) : end] if head >= 0 else b""
    urn = lambda x: re.sub(rb"^<urn:page:|>$", b"", x).decode(errors="replace") if x is not None else None
    kind = f.get(b"warc-type", b"").decode(errors="replace")
    if kind == "revisit":
        payload, size, digest = None, int(f.get(b"x-payload-length", b"0")), f.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return urn(f.get(b"warc-record-id")), kind, urn(f.get(b"warc-refers-to")), f.get(b"warc-target-uri", b"").decode(errors="replace"), payload, size, digest


RECORD = "page_id string, record_type string, refers_to string, url string, payload binary, payload_bytes long, payload_digest string"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]] for x in RECORD.split(", ")]


def _whole(batches):
    """The records that lie in one text: path, block, i and the record."""

    def rows():
        for path, block, i, text in _numbered(batches):
            end, n = _size(text)
            if end >= 0 and n >= 0 and len(text) >= end + len(BREAK) + n:
                yield path, block, i, *_record(text)

    yield from _batched(rows(), ["path", "block", "i", *_NAMES], [pa.string(), pa.int64(), pa.int64(), *_KINDS])


def _pieces(batches):
    def rows():
        for path, block, i, text in _numbered(batches):
            yield f"{path}\n{block}\n{i}", text

    yield from _batched(rows(), ["key", "text"], [pa.string(), pa.binary()])


def _joined(batches):
    def rows():
        for b in batches:
            for path, block, i, parts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield path, block, i, *_record(MAGIC.join(p["text"] for p in parts))

    yield from _batched(rows(), ["path", "block", "i", *_NAMES], [pa.string(), pa.int64(), pa.int64(), *_KINDS])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The true records of uncompressed archives: path, at, page_id (text of the record's id),
    record_type, refers_to, url, payload (null for revisits), payload_bytes, payload_digest.

    Files are read by byte ranges, however large they are. A chain that breaks before the end of its
    file, at what is no record, is an error. Payloads are not shuffled but for those that hold a
    magic. A file without any record gives no rows, and an id that the writer left empty is empty.
    """
    texts = spark.read.option("lineSep", MAGIC.decode()).text(path)
    texts = texts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    true, places = chained(texts)
    true = cut(true)
    # Every text belongs to the last record before it; those that are none themselves are parts of its payload.
    last = places.join(true.select("path", "block", "i", F.lit(True).alias("own"), "next"), ["path", "block", "i"], "left")
    over = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    of = last.filter("at >= 0").withColumns({"head": F.last(F.when(F.col("own"), F.struct("block", "i", "next")), True).over(over)})
    # Chains go on to the end of the file, and not beyond.
    broken = of.groupBy("path").agg(F.max(F.expr("head is null or (own is null and at >= head.next)")).alias("gap"), F.max("next").alias("to"), F.max(F.col("at") + F.col("size")).alias("end")).filter("gap or to > end").head(1)
    if broken:
        raise ValueError(f"no chain of records reaches just to the end of {broken[0]['path']}")
    parts = cut(of.filter("own is null").select("path", "head.block", "head.i").distinct())
    kinds = f"path string, block long, i long, {RECORD}"
    keys = ["path", "block", "i"]
    out = texts.mapInArrow(_whole, kinds).join(true.select(*keys, "at"), keys).join(parts, keys, "left_anti")
    n = parts.count()
    if n:
        heads = parts.withColumn("held", F.lit(True))
        need = of.join(heads, (of["path"] == heads["path"]) & (of["head.block"] == heads["block"]) & (of["head.i"] == heads["i"])).select(of["path"], of["block"], of["i"], of["at"], "head")
        text_key = F.concat_ws("\n", "path", "block", "i")
        need = cut(need.withColumn("key", text_key))
        found = maybe_in(texts.mapInArrow(_pieces, "key string, text binary"), F.col("key"), need, F.col("key"), need.count(), "_may").filter("_may").drop("_may")
        whole = found.join(need, "key").groupBy("path", "head").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
        whole = whole.select("path", "head.block", "head.i", F.col("parts")).mapInArrow(_joined, kinds)
        out = out.unionByName(whole.join(true.select(*keys, "at"), keys))
    return out.select("path", "at", *_NAMES)
