"""Lexical retrieval packing: each training window holds a seed document and its BM25 neighbours.

Documents are tokenised once and stored as ids, and every token is counted over the whole corpus. A
document's place is then drawn from its own tokens by consistent weighted sampling: of random draws
that are scaled by the tokens' information content the smallest one names a token, so two documents
share a place with the probability that their rare tokens are shared. Ranges of places,
which split hot ones too, become shards of bounded size, each with its own BM25 inverted index over
all terms. The best unused documents follow a seed until the window is full, and the document that
crosses the end is cut: its rest opens the next window. The last, short window of a shard is cut
into powers of two, so that nothing is padded.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainloom.llm.common import lean, stored, text_of

SHARD_DOCS, SHARD_TOKENS = 2048, 3_000_000
#: Tokens of a task's range of places, on average.
RANGE_TOKENS = 1 << 26
#: Tokens that name a place.
DRAWS = 3
#: Terms of a shard that are scored by a dense matrix; the others are by their postings.
DENSE = 512
K1, B = 1.2, 0.75
#: Words in a worker's cache, bytes of a word in it, and bytes of texts that are tokenised at once;
#: memory bounds, without effect on the results.
CACHE, LONG, CHUNK = 400_000, 40, 1 << 23
_held: dict[int, Words] = {}


def _ranks(*masks: pa.Array) -> pa.Array:
    """Where each row is when the rows of the first mask come first, then those of the second, and so on."""
    out, n = np.zeros(len(masks[0]), np.int64), 0
    for mask in masks:
        at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
        out[at] = n + np.arange(len(at))
        n += len(at)
    return pa.array(out)


class Words:
    """Ids of texts by a tokenizer that splits at white space, kept by word.

    Texts of Latin letters are lower-cased at once, and their full stops and commas, which the
    tokenizer's splitter parts from letters, are parted before the words are. Words are numbered by
    a hash table over many texts and only the different ones looked up. New words of letters alone
    go to the tokenizer's model many at a time, without the steps that leave them as they are, and
    the ids are parted again at the ends of words. Words of letters, digits and ASCII marks are put
    together from their runs; other words take the whole way, parted by a mark between them. Words
    and their ids stay in Arrow's arrays, also in the cache, which forgets those that have not been
    used for the longest time.
    """

    plain = "^[a-zß-öø-ÿ]+$"
    #: Without the apostrophe, which can be a part of what follows, and what begins special tokens.
    mixed = re.compile("[a-zß-öø-ÿ0-9!-&(-/:;=-@[-`{-~]+")
    runs = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@[-`{-~]+")
    #: Latin letters; no white space beyond ASCII.
    simple = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]*")
    odd = re.compile("[\x1c-\x1f]")  # white space to Python alone
    #: A full stop or comma after another mark, which makes one token with it.
    joined = re.compile("[^a-z0-9\xe0-\xf6\xf8-\u024f\\s][.,]\\s")
    MARK = "\x01"

    def __init__(self, source: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_str(source)
        self.old, self.old_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.last = np.zeros(self.size, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        mark = self.encoded(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _bare(self, text: str) -> np.ndarray:
        """Ids of words of plain letters, whose bytes stand for themselves in the model, but for three."""
        if not text.isascii():
            text = text.encode().decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")
        return np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _parted(self, texts: list[str], counts: list[int], between: str, encoded) -> pa.Array | None:
        """Ids of each of the words in texts, which have so many each; none if words have no ends."""
        out, sizes = [], []
        for text, n in zip(texts, counts, strict=True):
            ids = encoded(text)
            if between == " ":
                ends = np.flatnonzero(self.last[ids])
            else:
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                ends -= np.arange(len(ends)) + 1
                ids = ids[ids != self.mark]
            if len(ends) != n or ends[-1] + 1 != len(ids):
                return None
            out.append(ids)
            sizes.append(np.diff(ends, prepend=-1))
        return self._array(np.concatenate([np.empty(0, self.kind), *out]), np.concatenate([np.empty(0, np.int64), *sizes]))

    def _array(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        stops = np.append(0, np.cumsum(sizes * self.kind.itemsize)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(ids)])

    def _each(self, words: list[str]) -> pa.Array:
        return pa.array([self.encoded(w).tobytes() for w in words], pa.large_binary())

    def _plain(self, words: pa.Array) -> pa.Array:
        """Ids of words of plain letters."""
        at = np.append(np.arange(0, len(words), 1000), len(words))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), pa.scalar(" ", pa.large_string())).to_pylist()
        ids = self._parted(texts, np.diff(at).tolist(), " ", self._bare)
        return self._each(words.to_pylist()) if ids is None else ids  # not a tokenizer with ends of words

    def _whole(self, words: list[str]) -> pa.Array:
        """Ids of any words, which need not be alike."""
        safe = {} if self.mark is None else {w: k for k, w in enumerate(w for w in words if w and self.MARK not in w and "<|" not in w)}
        parts = [list(safe)[k : k + 1000] for k in range(0, len(safe), 1000)]
        ids = self._parted([f" {self.MARK} ".join(x) for x in parts], [len(x) for x in parts], self.MARK, self.encoded)
        if ids is None:
            return self._each(words)
        rest = [w for w in words if w not in safe]
        at = dict(zip(rest, range(len(safe), len(words)), strict=True)) | safe
        return pa.concat_arrays([ids, self._each(rest)]).take(pa.array([at[w] for w in words], pa.int64()))

    def learned(self, words: pa.Array) -> pa.Array:
        """Ids of different words that are not in the cache."""
        plain = pc.match_substring_regex(words, self.plain)
        rest = words.filter(pc.invert(plain)).to_pylist()
        runs = [self.runs.findall(w) if self.mixed.fullmatch(w) else [w] for w in rest]
        parts = pa.array(itertools.chain.from_iterable(runs), pa.large_string()).dictionary_encode()
        # Runs of letters are looked up, or learned with the words of letters.
        known = pc.index_in(parts.dictionary, value_set=self.old)
        letters = pc.and_(pc.is_null(known), pc.match_substring_regex(parts.dictionary, self.plain))
        other = pc.and_(pc.is_null(known), pc.invert(letters))
        new = pa.concat_arrays([words.filter(plain), parts.dictionary.filter(letters)]).dictionary_encode()
        n = pc.sum(plain, min_count=0).as_py()
        ids = self._plain(new.dictionary).take(new.indices)
        of_parts = pa.concat_arrays([self.old_ids.take(known.drop_null()), ids[n:], self._whole(parts.dictionary.filter(other).to_pylist())])
        of_parts = of_parts.take(_ranks(known.is_valid(), letters, other)).take(parts.indices)
        stops = np.append(0, np.cumsum([len(x) for x in runs])).astype(np.int64)
        _, offsets, data = of_parts.buffers()
        ends = np.frombuffer(offsets, np.int64)[stops] if len(of_parts) else np.zeros(len(stops), np.int64)
        joined = pa.Array.from_buffers(pa.large_binary(), len(rest), [None, pa.py_buffer(ends), data])
        return pa.concat_arrays([ids[:n], joined]).take(_ranks(plain, pc.invert(plain)))

    def _readied(self, text: str) -> str | None:
        """A text that ASCII white space parts into words; none where the tokenizer has to part it."""
        if not self.simple.fullmatch(text):
            return None if self.odd.search(text) else " ".join(text.split())
        low = text.lower() + " "
        if not self.joined.search(low):
            low = low.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return low

    def rows(self, texts: list[str], tail: bytes = b"") -> tuple[pa.Array, np.ndarray]:
        """Little-endian ids of each text, of self.kind, with those of the tail; how often each id is there."""
        ready = [self._readied(t) for t in texts]
        odd = [k for k, x in enumerate(ready) if x is None]
        words = pc.ascii_split_whitespace(pa.array([x or "" for x in ready], pa.large_string()))
        del ready
        ends = words.offsets.to_numpy()[1:].astype(np.int64)
        words = words.flatten().dictionary_encode()
        at, words = words.indices.to_numpy(), words.dictionary
        known = pc.index_in(words, value_set=self.old)
        is_new, places = pc.is_null(known), known.drop_null()
        new = words.filter(is_new)
        # Each text ends with the tail, or else with all its ids.
        last = np.full(len(texts), len(words), at.dtype)
        last[odd] = len(words) + 1 + np.arange(len(odd))
        lasts = pa.array([tail, *(self.encoded(texts[k]).tobytes() + tail for k in odd)], pa.large_binary())
        known_ids, new_ids = self.old_ids.take(places), self.learned(new)
        pool = pa.concat_arrays([pa.concat_arrays([known_ids, new_ids]).take(_ranks(known.is_valid(), is_new)), lasts])
        at = np.insert(at, ends, last)
        sizes = pc.binary_length(pool).to_numpy() // self.kind.itemsize
        times = np.repeat(np.bincount(at, minlength=len(pool)), sizes)
        count = np.bincount(np.frombuffer(pool.buffers()[2] or b"", self.kind)[: len(times)], times, self.size).astype(np.int64)
        # The cache: words of these texts first, then those that were not among them.
        short, unused = pc.less_equal(pc.binary_length(new), LONG), np.ones(len(self.old), bool)
        unused[places.to_numpy()] = False
        self.old_ids = pa.concat_arrays([known_ids, new_ids.filter(short), self.old_ids.filter(pa.array(unused))])[:CACHE]
        self.old = pa.concat_arrays([words.filter(known.is_valid()), new.filter(short), self.old.filter(pa.array(unused))])[:CACHE]
        _, offsets, data = pool.take(pa.array(at)).buffers()
        stops = np.frombuffer(offsets, np.int64)[1:][ends + np.arange(len(ends))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.append(0, stops).astype(np.int32)), data]), count

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of self.kind."""
        return self.rows(texts)[0].to_pylist()


def _tokenised(source, end_id: int):
    """Ids of each document, and in a last row how often a task has had each token."""

    def run(batches):
        key = hash(source.value)
        if key not in _held:
            _held.clear()
            _held[key] = Words(source.value)
        words = _held[key]
        end = np.array([end_id], words.kind).tobytes()
        count = np.zeros(max(words.size, end_id + 1), np.int64)
        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            sizes = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            edges = np.flatnonzero(np.diff(sizes // CHUNK)) + 1
            for at, to in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                part = b.slice(at, to - at)
                ids, times = words.rows(part.column(1).to_pylist(), end)
                count[: len(times)] += times
                sizes = pc.divide(pc.binary_length(ids).cast(pa.int64()), words.kind.itemsize)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, sizes, pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "n", "counts"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([count.tobytes()], pa.binary())], ["doc_id", "ids", "n", "counts"])

    return run


def _summed(batches):
    """The sum of the counts of a task's rows, in parts that are added up in parallel."""
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            x = np.frombuffer(x, np.int64)
            total = x.copy() if total is None else total + x
    if total is not None:
        for k, part in enumerate(np.array_split(total, 16)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _draws(counts: np.ndarray) -> np.ndarray:
    """For each draw a value of every token; the smallest of a document's names its place.

    A token is drawn in proportion to the square of its information content in the corpus. A last
    row numbers the tokens in no order, as rare ones would otherwise lead to the same end.
    """
    r = np.random.RandomState(5)
    u = r.random_sample((DRAWS, len(counts)))
    info = np.log(counts.sum() + 1) - np.log(counts + 1) + 1e-3
    return np.concatenate([(-np.log(u) / info**2), r.permutation(len(counts))[None]]).astype(np.float32)


def _places(kind: np.dtype, draws, end_id: int):
    def run(batches):
        *value, number = draws.value
        number = number.astype(np.int64)
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                ids = np.frombuffer(x, kind)[:-1]
                place = 0
                for d in value:
                    place = place << 20 | (int(number[ids[d[ids].argmin()]]) if len(ids) else 0)
                out.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["doc_id", "ids", "place"])

    return run


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and how often each is there; 16-bit ids are sorted by radix."""
    ids = np.sort(ids, kind="stable")
    at = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
    return ids[at], np.diff(np.append(at, len(ids)))


def _neighbours(docs: list[np.ndarray]):
    """A function of a document's number and the unused ones: those by BM25 score for all its terms, best first."""
    n = len(docs)
    terms = [_counted(d) for d in docs]
    t = np.concatenate([x for x, _ in terms])
    tf = np.concatenate([c for _, c in terms]).astype(np.float32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x, _ in terms])
    size = np.array([len(d) for d in docs], np.float32)
    order = np.argsort(t, kind="stable")
    t, tf, owner = t[order], tf[order], owner[order]
    names, first, df = np.unique(t, return_index=True, return_counts=True)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    score = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / max(1.0, size.mean()))) * np.repeat(idf, df)
    place = np.full(int(names[-1]) + 1, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    frequent = np.argsort(-df, kind="stable")[:DENSE]
    column = np.full(len(names), -1, np.int32)
    column[frequent] = np.arange(len(frequent), dtype=np.int32)
    dense = np.zeros((n, len(frequent)), np.float32)
    of = np.repeat(column, df)
    dense[owner[of >= 0], of[of >= 0]] = score[of >= 0]

    def near(i: int, unused: np.ndarray) -> np.ndarray:
        at = place[terms[i][0]]
        has = np.zeros(len(frequent), np.float32)
        has[column[at[column[at] >= 0]]] = 1
        total = dense @ has
        at = at[(column[at] < 0) & (df[at] > 1)]
        if len(at):
            k = df[at]
            hits = np.repeat(first[at] - np.cumsum(k) + k, k) + np.arange(k.sum())
            total += np.bincount(owner[hits], score[hits], n).astype(np.float32)
        rest = np.flatnonzero(unused & (total > 0))
        return rest[np.argsort(-total[rest], kind="stable")]

    return near


def pack_shard(docs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard; every token is in one of them."""
    near, used, pieces = _neighbours(docs), np.zeros(len(docs), bool), []
    seq = free = 0

    def put(i: int, start: int) -> int:
        """Puts what fits of a document; the first token that doesn't."""
        nonlocal free
        n = min(len(docs[i]) - start, window - free)
        if n:
            pieces.append((i, start, n, seq, free))
        free += n
        return start + n

    rest, nxt = None, 0
    while True:
        if rest is None:
            while nxt < len(docs) and used[nxt]:
                nxt += 1
            if nxt == len(docs):
                break
            rest = (nxt, 0)
            used[nxt] = True
        i, start = rest
        end, rest = put(i, start), None
        if end < len(docs[i]):
            rest = (i, end)
        elif free < window:
            for j in near(i, ~used).tolist():
                used[j] = True
                end = put(j, 0)
                if free == window:
                    rest = (j, end) if end < len(docs[j]) else None
                    break
        if free == window:
            seq, free = seq + 1, 0
    if not free:
        return pieces
    # The last window in powers of two.
    last, pieces = [p for p in pieces if p[3] == seq], [p for p in pieces if p[3] < seq]
    sizes = [1 << b for b in range(window.bit_length(), -1, -1) if free >> b & 1]
    at, left = 0, sizes[0]
    for i, start, n, _, _ in last:
        while n:
            k = min(n, left)
            pieces.append((i, start, k, seq, sizes[at] - left))
            start, n, left = start + k, n - k, left - k
            if not left and at + 1 < len(sizes):
                at, seq = at + 1, seq + 1
                left = sizes[at]
    return pieces


def _packed(window: int, kind: np.dtype):
    def run(batches):
        base = TaskContext.get().partitionId() << 36
        ids, docs, total, seq = [], [], 0, 0

        def flush():
            nonlocal seq
            pieces = pack_shard(docs, window)
            cols = {"doc_id": [ids[p[0]] for p in pieces], "start": [p[1] for p in pieces]}
            cols["ids"] = [docs[i][s : s + n].astype("<u4").tobytes() for i, s, n, _, _ in pieces]
            cols["doc_tokens"] = [len(docs[p[0]]) for p in pieces]
            cols["sequence_id"] = [base + seq + p[3] for p in pieces]
            cols["offset"] = [p[4] for p in pieces]
            seq += pieces[-1][3] + 1
            kinds = (id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], list(cols))

        for b in batches:
            id_type = b.schema.field(0).type
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                docs.append(np.frombuffer(x, kind))
                total += len(docs[-1])
                if len(ids) >= SHARD_DOCS or total >= SHARD_TOKENS:
                    yield flush()
                    ids, docs, total = [], [], 0
        if ids:
            yield flush()

    return run


def placed(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, np.dtype]:
    """(doc_id, ids, place) of all documents, their number of tokens and the ids' type."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    source = spark.sparkContext.broadcast(tokenizer)
    held = stored(rows.mapInArrow(lean(_tokenised(source, end_id)), f"doc_id {kind}, ids binary, n long, counts binary"), "ids")
    tokens = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = held.filter("counts is not null").select("counts").mapInArrow(_summed, "part int, counts binary").groupBy("part").applyInArrow(_added, "part int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(found, key=lambda r: r["part"])]) if found else np.zeros(1, np.int64)
    ids_kind = np.dtype("<u2" if len(counts) <= 1 << 16 else "<u4")
    draws = spark.sparkContext.broadcast(_draws(counts))
    at = held.filter("ids is not null").select("doc_id", "ids").mapInArrow(lean(_places(ids_kind, draws, end_id)), f"doc_id {kind}, ids binary, place long")
    return at, tokens, ids_kind


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents; ``tokenizer`` is the JSON of a tokenizer that splits at white space.

    Returns a row per piece: doc_id, start, ids (binary, little-endian unsigned 32-bit), doc_tokens
    (with the end id), sequence_id, offset. A null or empty text is its end id alone; repeated rows
    are documents of their own. Extra columns are ignored. An empty table gives no rows.

    What is gathered and broadcast is a number for each token of the vocabulary. Ranges of places
    are drawn from a sample, so another run can part shards elsewhere; equal places are parted by a
    hash of the document, and a task that is run again makes the same pieces.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    at, tokens, ids_kind = placed(docs, tokenizer, end_id, id_col, text_col)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE_TOKENS))
    at = at.withColumn("salt", F.xxhash64("doc_id", "ids")).repartitionByRange(n, "place", "salt").sortWithinPartitions("place", "salt", "doc_id")
    out = at.select("doc_id", "ids").mapInArrow(lean(_packed(window, ids_kind)), f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out
