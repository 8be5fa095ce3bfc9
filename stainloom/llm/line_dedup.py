"""Line dedup by a deletion-neighbourhood join, with an edit bound of one letter.

The letters of a line are its words, or its characters if it has fewer than WORDS words. A line is
a repeat if an earlier line, by document and place, equals it up to white space, or has letters of
the same kind and differs by one of them put in, left out or changed. Lines of fewer than LETTERS
letters have a bound of none, as nearly all of them would be within one edit of each other. For the
join each line emits itself and every line that lacks one of its letters, as hashed keys. Equal keys
with the same gap are lines that differ in that letter; a key without a gap that meets one with a
gap is a letter put in. Each group keeps its earliest line alone, a minimum that is computed by
partial aggregates, so a frequent key makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainloom.llm.common import SPACE, cut, join_counted, maybe_in, stored, text_of, words_of

#: Words of the shortest line whose letters are words.
WORDS = 5
#: Letters of the shortest line that is compared within the edit bound.
LETTERS = 5


def _key(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ")))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0), words of every line that has any."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(text_of(text_col), "\n", -1).alias("_l"))
    # A plain search tells lines with words, as a filter on the words would split every line twice.
    rows = rows.select("doc_id", F.posexplode("_l").alias("line_no", "_x")).filter(F.col("_x").rlike(f"[^{SPACE}]"))
    return rows.select("doc_id", "line_no", words_of(F.col("_x")).alias("words"))


def _letters(words: Column) -> Column:
    """Words, or characters that are marked so as to equal no word."""
    return F.when(F.size(words) >= WORDS, words).otherwise(F.transform(F.split(F.array_join(words, " "), ""), lambda c: F.concat(F.lit("\x00"), c)))


def _halves(words: Column) -> Column:
    """Keys of the first and last halves: two lines within one word of each other share one at least.

    Of n and n or n + 1 words, the first floor(n / 2) or the last floor(n / 2) are equal; a line
    gives the halves for its own length and for the length less one, each with that length.
    """
    n = F.size(words)
    out = []
    for length in (n, n - 1):
        k = F.floor(length / 2).cast("int")
        out += [F.xxhash64(F.lit("first"), length, F.slice(words, 1, k)), F.xxhash64(F.lit("last"), length, F.slice(words, n - k + 1, k))]
    return F.array(*out)


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first places of all different lines: doc_id, line_no, kept, by_doc and by_line (the
    earlier line that a dropped one repeats with an edit). Lines that are at no first place are
    exact repeats and dropped. Lines without words aren't listed and stay.

    Rows that repeat a document's id count as one document where their lines are the same at the
    same place. A null id comes before all others. Null and empty texts have no lines with words.
    """
    place = F.struct("doc_id", "line_no")
    lines = lines_of(docs, id_col, text_col)
    lines = lines.select(place.alias("place"), _key(F.col("words")).alias("k"), _letters(F.col("words")).alias("l"))
    n = F.size("l")
    keyed = lines.select("place", "k", n.alias("n"), F.when(n >= LETTERS, _halves(F.col("l"))).alias("halves"))
    # One row for each different line.
    unique = stored(keyed.groupBy("k").agg(F.min("place").alias("place"), F.first("n").alias("n"), F.first("halves").alias("halves")), "lines")
    long = unique.filter(F.col("n") >= LETTERS)
    halves = long.select("k", F.explode("halves").alias("half"))
    shared = cut(halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1"))
    hot = max(1000, unique.count() // 1000)
    # Bloom filters keep back what surely is no candidate before anything is shuffled.
    key = F.col("half")
    halves = maybe_in(halves, key, shared, key, shared.count(), "_may").filter("_may").drop("_may")
    candidates = cut(join_counted(halves, shared, "half", "c", hot).select("k").distinct())
    key = F.col("k")
    at = maybe_in(long, key, candidates, key, candidates.count(), "_may").filter("_may").join(candidates, "k", "left_semi")
    # The words of the candidates, from the documents that have any.
    wanted = cut(at.groupBy("place.doc_id").agg(F.collect_list(F.struct("place.line_no", "k")).alias("_at")))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    texts = maybe_in(texts, known, wanted, known, wanted.count(), "_may").filter("_may")
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select(texts["doc_id"], F.split("_t", "\n", -1).alias("_l"), F.explode("_at").alias("a"))
    found = found.select("a.k", F.struct("doc_id", "a.line_no").alias("place"), words_of(F.get("_l", F.col("a.line_no"))).alias("words")).filter(_key(F.col("words")) == F.col("k"))
    found = stored(found.dropDuplicates(["k"]).withColumn("words", _letters(F.col("words"))), "candidates")
    w, size = F.col("words"), F.size("words")
    each = found.select("place", "words", F.explode(F.sequence(F.lit(0), size)).alias("gap"))
    less = F.when(F.col("gap") == 0, w).otherwise(F.concat(F.slice(w, 1, F.greatest(F.col("gap") - 1, F.lit(0))), F.slice(w, F.col("gap") + 1, size)))
    variants = stored(each.select("place", "gap", F.xxhash64(less).alias("v")), "variants")
    by_gap = variants.groupBy("v", "gap").agg(F.min("place").alias("first"), F.count("*").alias("c"))
    by_key = by_gap.groupBy("v").agg(
        F.min(F.when(F.col("gap") == 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("gap") > 0, F.col("first"))).alias("gapped"), F.sum("c").alias("all")
    )
    # Only keys that two lines share are joined back.
    by_key = cut(by_key.filter("all > 1"))
    key = F.col("v")
    some = maybe_in(variants, key, by_key, key, by_key.count(), "_may").filter("_may").drop("_may")
    met = cut(join_counted(some, by_key, "v", "all", hot))
    same = met.filter("gap > 0").groupBy(F.struct("v", "gap").alias("vg")).agg(F.min("place").alias("swapped"), F.count("*").alias("cg")).filter("cg > 1")
    gone = F.when(F.col("gap") == 0, F.col("gapped")).otherwise(F.col("whole"))
    first = met.select("place", gone.alias("by")).filter(F.col("by") < F.col("place"))
    swap = join_counted(met.filter("gap > 0").select("place", F.struct("v", "gap").alias("vg")), same, "vg", "cg", hot)
    swap = swap.filter(F.col("swapped") < F.col("place")).select("place", F.col("swapped").alias("by"))
    links = first.unionByName(swap).groupBy("place").agg(F.min("by").alias("by"))
    # Verified on the words themselves.
    a, b = found.select("place", F.col("words").alias("wa")), found.select(F.col("place").alias("by"), F.col("words").alias("wb"))
    # Many lines can be near one, whose words then go to them.
    b = b.join(links.groupBy("by").agg(F.count("*").alias("c")), "by")
    links = cut(join_counted(links.join(a, "place"), b, "by", "c", hot).filter(within_one("wa", "wb")).select("place", "by"))
    out = unique.select("place").join(links, "place", "left")
    return out.select("place.doc_id", "place.line_no", F.col("by").isNull().alias("kept"), F.col("by.doc_id").alias("by_doc"), F.col("by.line_no").alias("by_line"))


def within_one(a: str, b: str) -> Column:
    """Whether two lists of letters differ by one at most: all but one of the longer are shared from its ends."""
    na, nb = F.size(a), F.size(b)
    pre = F.expr(f"aggregate(zip_with(`{a}`, `{b}`, (x, y) -> coalesce(x = y, false)), named_struct('n', 0, 'on', true), (s, x) -> named_struct('n', s.n + int(s.on and x), 'on', s.on and x), s -> s.n)")
    suf = F.expr(f"aggregate(zip_with(reverse(`{a}`), reverse(`{b}`), (x, y) -> coalesce(x = y, false)), named_struct('n', 0, 'on', true), (s, x) -> named_struct('n', s.n + int(s.on and x), 'on', s.on and x), s -> s.n)")
    return (F.abs(na - nb) <= 1) & (pre + suf >= F.greatest(na, nb) - 1)


def summary(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_lines (with words), n_kept, n_edited (first places dropped
    for an earlier line with an edit), n_repeated (the rest) and kept_lines, their numbers in order."""
    full = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).select("doc_id", F.size(full).cast("long").alias("n_lines"))
    of = decisions.groupBy(F.col("doc_id").alias("_d")).agg(
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.col("line_no")))).alias("kept_lines"), F.count(F.when(~F.col("kept"), 1)).alias("n_edited")
    )
    out = rows.join(of, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    kept = F.coalesce("kept_lines", F.array().cast("array<int>"))
    edited = F.coalesce("n_edited", F.lit(0).cast("long"))
    return out.select("doc_id", "n_lines", F.size(kept).cast("long").alias("n_kept"), edited.alias("n_edited"), (F.col("n_lines") - F.size(kept) - edited).alias("n_repeated"), kept.alias("kept_lines"))


def clean_documents(docs: DataFrame, summaries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text without its dropped lines; lines without words stay."""
    s = summaries.select(F.col("doc_id").alias("_d"), "kept_lines").dropDuplicates(["_d"])
    t = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).join(s, F.col("doc_id").eqNullSafe(F.col("_d")))
    stay = F.filter(F.split("_t", "\n", -1), lambda x, i: ~x.rlike("[^\\x20\\x09-\\x0D]") | F.array_contains("kept_lines", i))
    return t.select("doc_id", F.array_join(stay, "\n").alias("text"))
