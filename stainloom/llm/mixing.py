"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree of domain, language and source. At each node the children share
it by weight; what a child can't fill goes to its siblings first, and only what a whole subtree
can't fill goes to the siblings of its root. Each leaf then gives the prefix of its tokens in a
seeded order, and begins its next epoch only when one is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stainloom.llm.common import SPACE, cut, join_counted, text_of

LEAF = ["domain", "lang", "source"]


def _weight(of: Column, weights: dict[str, int]) -> Column:
    w = F.lit(weights.get("*", 1)).cast("long")
    for k, v in weights.items():
        if k != "*":
            w = F.when(of == k, F.lit(v).cast("long")).otherwise(w)
    return w


def _share(children: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Budgets of the children of each parent: cap is what a child has, budget its parent's.

    Children in order of cap by weight: one is filled up as long as its cap is no more than its
    share of what those before it left; the rest share what remains by weight, rounded down.
    """
    c = children.withColumn("_w", _weight(F.col(name), weights)).filter("_w > 0")
    by = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("_w")).asc(), F.col(name))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    d = F.lit(0).cast("decimal(38,0)")
    c = c.withColumns({"_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_wrest": F.sum("_w").over(after)})
    left = F.col("budget").cast("decimal(19,0)") - F.col("_before").cast("decimal(19,0)")
    c = c.withColumn("_full", F.col("cap").cast("decimal(19,0)") * F.col("_wrest").cast("decimal(18,0)") <= F.col("_w").cast("decimal(18,0)") * left)
    # Of the first child that isn't filled up, what it and all after it share.
    c = c.withColumns({
        "_left": F.max(F.when(~F.col("_full"), F.col("budget") - F.col("_before"))).over(Window.partitionBy(*parent)),
        "_ws": F.max(F.when(~F.col("_full"), F.col("_wrest"))).over(Window.partitionBy(*parent)),
    })
    share = F.expr("cast(_w as decimal(18,0)) * cast(_left as decimal(19,0)) div cast(_ws as decimal(18,0))")
    return c.select(*children.columns, F.when(F.col("_full"), F.col("cap")).otherwise(share).cast("long").alias("alloc"))


def budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Leaves (domain, lang, source, cap) with alloc, what each shall give."""
    at = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(int(budget)).cast("long"))
    total = F.sum("cap").over(Window.partitionBy())
    at = at.withColumn("budget", F.least("budget", total))
    for depth, name in enumerate(LEAF):
        parent = LEAF[:depth]
        done = _share(at, parent, name, weights.get(name, {}))
        if depth == 2:
            return done.select(*LEAF, "alloc")
        nxt = LEAF[: depth + 2]
        kids = leaves.groupBy(*nxt).agg(F.sum("cap").alias("cap"))
        at = kids.join(done.select(*LEAF[: depth + 1], F.col("alloc").alias("budget")), LEAF[: depth + 1])
    raise AssertionError


def _taken(docs: DataFrame, budget_share: float, weights: dict[str, dict[str, int]], domains: dict[str, str], seed: int, max_epochs: int) -> tuple[DataFrame, DataFrame, int]:
    """A row for each copy, taken or not, in a range _r of the hashes of its leaf; the leaves that give any; the number of rows with tokens."""
    n = F.regexp_count(text_of("text"), F.lit(f"[^{SPACE}]+")).cast("long")
    rows = cut(docs.select("doc_id", *_names(domains), n.alias("n_tokens")).filter("n_tokens > 0"))
    leaves = cut(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count("*").alias("leaf_rows")))
    total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0)), F.coalesce(F.sum("leaf_rows"), F.lit(0))).first()
    caps = leaves.select(*LEAF, (F.col("leaf_tokens") * max_epochs).alias("cap"))
    alloc = cut(leaves.join(budgets(caps, int(total[0] * budget_share), weights), LEAF).select(_leaf().alias("_leaf"), "leaf_tokens", "leaf_rows", "alloc"))
    met = join_counted(rows.withColumn("_leaf", _leaf()), alloc, "_leaf", "leaf_rows", max(1000, total[1] // 1000))
    epochs = F.sequence(F.lit(0), F.floor((F.col("alloc") - 1) / F.col("leaf_tokens")).cast("int"))
    met = met.filter("alloc > 0").withColumn("epoch", F.explode(epochs))
    met = met.withColumn("_h", _drawn(seed))
    met = met.withColumn("_r", F.substring("_h", 1, 3))
    ranges = met.groupBy("_leaf", "epoch", "_r").agg(F.sum("n_tokens").alias("_s"))
    over = Window.partitionBy("_leaf", "epoch").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    inner = Window.partitionBy("_leaf", "epoch", "_r").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(ranges, ["_leaf", "epoch", "_r"])
    start = F.col("epoch") * F.col("leaf_tokens") + F.col("_base") + F.col("_in")
    met = met.withColumn("take_tokens", F.least("n_tokens", F.greatest(F.col("alloc") - start, F.lit(0))))
    return met, alloc.select("_leaf", "leaf_rows"), total[1]


def _names(domains: dict[str, str]) -> list[Column]:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    domain = F.lit("other")
    for k, v in domains.items():
        domain = F.when(named("source") == k, v).otherwise(domain)
    return [domain.alias("domain"), named("lang").alias("lang"), named("source").alias("source")]


def _leaf() -> Column:
    return F.concat_ws("\x1f", *LEAF)


def _drawn(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.col("doc_id").cast("string")))


def mix(docs: DataFrame, budget_share: float, weights: dict[str, dict[str, int]], domains: dict[str, str], seed: int = 7, max_epochs: int = 2) -> DataFrame:
    """Which documents to take, how often and how much of them.

    docs has doc_id, text, lang, source; a token is a word between white space. ``weights`` maps
    the levels domain, lang and source to whole-number weights by name, ``*`` for all others;
    ``domains`` maps sources to domains, the rest are ``other``. The budget is ``budget_share`` of
    all tokens. Returns doc_id, domain, lang, source, epoch, n_tokens, take_tokens for every copy
    taken; the last copy of a leaf is taken in part. Null names are ``unknown``, a null text has
    no tokens, and documents without tokens are never taken. Rows that repeat an id are taken each
    for itself. Other columns are ignored. An empty table gives no rows.

    Prefixes are summed in two steps, within 4,096 hash ranges of a leaf and over their sums, so
    that a leaf with a third of all rows is spread over the cluster.
    """
    return _taken(docs, budget_share, weights, domains, seed, max_epochs)[0].filter("take_tokens > 0").select("doc_id", *LEAF, "epoch", "n_tokens", "take_tokens")


def mix_rows(docs: DataFrame, budget_share: float, weights: dict[str, dict[str, int]], domains: dict[str, str], seed: int = 7, max_epochs: int = 2) -> DataFrame:
    """The rows that mix() takes, one for each copy, with all columns of docs and _take: how many tokens, null for all.

    What a leaf gives in an epoch are its first rows by hash and id, so the last of them alone says
    of each row, where it is read, whether it is taken; texts aren't shuffled but for leaves with
    less than a thousandth of the rows. Of rows that repeat the id of a last one, those with fewer
    tokens come first.
    """
    names = docs.columns
    met, leaves, n = _taken(docs, budget_share, weights, domains, seed, max_epochs)
    key = F.struct("_h", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"))
    by_key = met.groupBy("_leaf", "epoch", "_r", key.alias("_key")).agg(F.sum("take_tokens").alias("left"), F.sum("n_tokens").alias("full"), F.count("*").alias("c"))
    last = by_key.filter("left > 0").groupBy("_leaf", "epoch").agg(F.max(F.struct("_key", "left", "full", "c")).alias("_last"))
    ends = cut(last.groupBy("_leaf").agg(F.collect_list(F.struct("epoch", "_last")).alias("_ends")).join(leaves, "_leaf"))
    rows = docs.select(F.struct(*names).alias("_row"), "doc_id", "text", *_names(domains)).withColumn("_leaf", _leaf()).drop(*LEAF)
    rows = join_counted(rows, ends, "_leaf", "leaf_rows", max(1000, n // 1000)).select("_row", "doc_id", "text", "_leaf", F.explode("_ends").alias("_end"))
    rows = rows.select("_row", "text", "_leaf", "doc_id", "_end.epoch", "_end._last").withColumn("_h", _drawn(seed))
    rows = rows.filter((key <= F.col("_last._key")) & F.col("text").rlike(f"[^{SPACE}]"))
    cut_at = F.when((key == F.col("_last._key")) & (F.col("_last.left") < F.col("_last.full")), F.col("_last.left"))
    if not ends.filter(F.exists("_ends", lambda x: x["_last"]["c"] > 1)).isEmpty():
        n_tokens = F.regexp_count(F.col("text"), F.lit(f"[^{SPACE}]+")).cast("long")
        tied = rows.filter((key == F.col("_last._key")) & (F.col("_last.c") > 1)).withColumn("n_tokens", n_tokens)
        before = F.sum("n_tokens").over(Window.partitionBy("_leaf", "epoch").orderBy("n_tokens", "text").rowsBetween(Window.unboundedPreceding, -1))
        tied = tied.withColumn("_take", F.least("n_tokens", F.col("_last.left") - F.coalesce(before, F.lit(0)))).filter("_take > 0").select("_row", "_take")
        rows = rows.filter((key < F.col("_last._key")) | (F.col("_last.c") == 1)).select("_row", cut_at.alias("_take")).unionByName(tied)
    else:
        rows = rows.select("_row", cut_at.alias("_take"))
    return rows.select("_row.*", F.col("_take").cast("int").alias("_take"))
