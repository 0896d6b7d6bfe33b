"""URL filter: a blocked Bloom filter of listed URLs, an exact join behind it, and host and path rules."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import all_of
from shelfwise.workspace import materialise

#: A block has eight words of 64 bits; a key sets one bit in each word of its block.
WORDS = 8
BITS_PER_KEY = 16
#: The filter never takes more than this, whatever the list; a fuller filter passes more rows to the exact join.
FILTER_BYTES = 16 * 1024 * 1024
BLOCK_BYTES = 8 * (WORDS + 2)

TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One text for the spellings of a url: no scheme, ``www.``, default port, closing slashes, fragment or tracking
    parameters, and the other parameters in order. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (text, verdict) of the longest rule that fits, null if none does.

    Rules of one length: the longer host wins, then ``block``, then the text.
    """
    chain = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block", r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chain = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(chain)
    return chain


def _bit(word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_bits, {6 * word}) & 63 as int))")


def _hashed(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    return rows.select(
        "*", F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), F.xxhash64(F.lit(1), F.col(key)).alias("_bits")
    )


def bloom_filter(listed: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The non-empty blocks (_block, _w0.._w7) of a filter over the column ``key``, and the number of blocks.

    Each block is the OR of its keys' bits, so the aggregate combines before its shuffle and any key may repeat.
    """
    wanted = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    blocks = min(wanted, FILTER_BYTES // BLOCK_BYTES)
    words = [F.expr(f"bit_or(_w{i})").alias(f"_w{i}") for i in range(WORDS)]
    bits = _hashed(listed.select(key), key, blocks).select("_block", *(_bit(i).alias(f"_w{i}") for i in range(WORDS)))
    return bits.groupBy("_block").agg(*words), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, url: str = "url", listed_url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed; ``listed`` is a table of unwanted urls.

    The canonical urls of ``listed`` fill a blocked Bloom filter whose size is bounded by FILTER_BYTES, so
    it can be broadcast. Only pages that it passes are shuffled: a hash join on the canonical url
    keeps the true hits. A rule that fits decides; else a listed url is blocked and any other allowed.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are never listed: they are allowed.
    Repeated pages are judged each on their own; an empty list blocks nothing. Columns of ``pages`` are kept, whatever
    their names, but for those with the names of the results, which are replaced. An empty table gives an empty table.
    """
    keys = materialise(listed.select(canonical_url(F.col(listed_url)).alias("_key")).where("_key is not null").distinct(), "listed-urls")
    blocks, n_blocks = bloom_filter(keys, "_key", keys.count())
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "listed")]
    given = {f"c{i}": c for i, c in enumerate(own)}  # the names under which the columns of pages travel
    address = F.col(f"`{url}`")
    rows = _hashed(
        pages.select(
            *(F.col(f"`{c}`").alias(short) for short, c in given.items()),
            url_host(address).alias("_host"), url_path(address).alias("_path"), canonical_url(address).alias("_key"),
        ),
        "_key", n_blocks,
    )
    in_block = all_of([F.col(f"_w{i}").bitwiseAND(_bit(i)) != 0 for i in range(WORDS)])
    marked = rows.join(F.broadcast(blocks), "_block", "left").withColumn(
        "_maybe", F.coalesce(in_block & F.col("_key").isNotNull(), F.lit(False))
    )
    sure = marked.where("not _maybe").withColumn("listed", F.lit(False))
    hits = marked.where("_maybe").join(keys.withColumn("listed", F.lit(True)), "_key", "left")
    judged = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(sure)
    rule = rule_for(F.col("_host"), F.col("_path"), rules)
    return judged.withColumn("_rule", rule).select(
        *(F.col(short).alias(c) for short, c in given.items()),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.text").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
