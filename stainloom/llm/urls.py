"""URL filters: rules on host and path, then a list of canonical URLs.

The list is tested with a blocked Bloom filter whose blocks are 64-bit words, a table of at most
2**max_bits rows that is broadcast. URLs that miss it pass straight through; possible hits go to
an exact join on the canonical URL, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainloom.llm.common import cut, join_counted, maybe_in

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters of a query string that don't change the page. Fixed values.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., m. or port, path without a last slash or .html, query without tracking; no scheme, no fragment."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^(www|m)\\.", ""), ":\\d+$", "")
    path = F.regexp_replace(path_of(url), "(/|/index\\.html?|\\.html?)$", "")
    q = F.regexp_extract(url, "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; a rule is (verdict, host/path)."""
    rule = verdict = None
    for what, at in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = at.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, at) if rule is None else rule.when(fits, at)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", max_bits: int = 20) -> DataFrame:
    """A verdict on every url: its longest rule's, else block if its canonical form is listed, else allow.

    Returns page_id, host, path, rule, verdict, canonical and listed. ``listed`` has a column url;
    nulls in it and URLs without ``://`` are ignored, as is a page url without ``://``, which is
    allowed. Repeated rows are judged each for itself; other columns are ignored, whatever their
    names; an empty list blocks nothing, and an empty table gives no rows. Of rules as long as each
    other the first by name wins.
    """
    u = F.col("_u")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_u")).select("page_id", "_u", host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_v"), F.when(u.contains("://"), canonical(u)).alias("canonical"))
    bad = cut(listed.select(F.col("url").cast("string").alias("_u")).filter(u.contains("://")).select(canonical(u).alias("canonical")).distinct())
    key = F.col("canonical")
    asked = cut(maybe_in(rows, key, bad, key, bad.count(), "_maybe", max_bits))
    maybe = asked.filter("_maybe")
    n = maybe.count()
    groups = maybe.groupBy("canonical").agg(F.count("*").alias("_n"))
    groups = groups.join(bad.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    met = join_counted(maybe, groups, "canonical", "_n", max(1000, n // 1000))
    out = met.drop("_n").unionByName(asked.filter("not _maybe").withColumn("listed", F.lit(False)))
    said = F.coalesce("_v", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "canonical", "listed")
