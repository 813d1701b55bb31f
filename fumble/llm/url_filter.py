"""URL filter: prefix rules, then a listed-URL test through a blocked Bloom filter.

Main path without Python: the list's canonical URLs set a few bits in one
64-bit block each; the filter's table (at most ``blocks`` rows of 16 bytes)
is broadcast, and only URLs whose bits are all set go on to an exact hash
join with the list, which removes the false positives. The first rule is the
longest that fits; the listed-URL test decides where no rule fits.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no rule, and is allowed; repeated rows are judged each on their own; an
empty list blocks nothing; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS = 1 << 19  # 8 MB when every block is used
BITS = 4  # set in a block for each URL


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling per page: host without ``www.`` or ``m.`` and default port, path
    without a last ``/``, no scheme, fragment or tracking parameters."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.concat(h, F.regexp_replace(path(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_columns(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rh, rp, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested last and so wraps the others
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule = F.when(fits, F.lit(rh + rp)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def bloom_mask(key: Column) -> Column:
    """``BITS`` bits of one 64-bit block, chosen by six-bit pieces of a hash."""
    mixed, mask = F.xxhash64(key, F.lit("bits")), F.lit(0).cast("long")
    for i in range(BITS):
        piece = F.shiftrightunsigned(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), piece))
    return mask


def bloom_block(key: Column, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_table(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The blocked filter of ``listed(canonical)``: at most ``blocks`` rows (block, bits)."""
    return listed.groupBy(bloom_block(F.col("canonical"), blocks).alias("block")).agg(F.bit_or(bloom_mask(F.col("canonical"))).alias("bits"))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict and ``listed`` (canonical URL on the list).

    ``listed`` has one column ``url``; any spelling of a URL lists its page."""
    names = listed.select(canonical(F.col("url")).alias("canonical")).filter("canonical <> ''").distinct()
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    p = p.select("*", rule.alias("rule"), verdict.alias("rule_verdict"), bloom_block(F.col("canonical"), blocks).alias("block"), bloom_mask(F.col("canonical")).alias("mask"))
    probed = p.join(F.broadcast(bloom_table(names, blocks)), "block", "left")
    possible = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    hits = probed.filter(possible).join(names.withColumn("on_list", F.lit(True)), "canonical", "left")
    out = ["page_id", "host", "path", "rule", "rule_verdict"]
    both = hits.select(*out, F.coalesce("on_list", F.lit(False)).alias("listed")).unionByName(probed.filter(~possible).select(*out, F.lit(False).alias("listed")))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "listed")


def spam_list(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The production list of the registered query: URLs of pages whose HTML
    carries five or more runs of three equal marks (``###``, ``***`` ...)."""
    runs = F.size(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(#{3}|\*{3}|\${3}|%{3})"), 0))
    return pages.filter(runs >= 5).select(F.col(url_col).alias("url"))
