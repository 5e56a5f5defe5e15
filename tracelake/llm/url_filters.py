"""Operator 5, URL filters: domain rules, and a blocked Bloom filter in front of an exact join.

A listed canonical URL is `host/path`; it blocks its host with all subdomains, for the path itself and all that lies below it
(`host/a` and `host/a/` block `/a/b`, neither blocks `/ab`; only `host/a` blocks `/a`). The listed URLs are hashed into a Bloom filter of 256-bit blocks, held as a table (block, eight 32-bit lanes). The canonical keys of
a page (its host suffixes with its path prefixes) are probed against it; keys that pass go to an exact hash join with
the list, which removes the false positives. Only DataFrame functions are used.

Defined results: null, or no `://`: host and path are empty, no rule fits, and the verdict is allow. An empty path fits
no rule, as every rule's path begins with a slash. Each row is judged for itself, rows with equal URLs alike; identifiers
are not looked at. An empty list blocks nothing; an empty table gives an empty result. Further columns pass through; one
that has the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The rules of the query, (what to do, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Listed canonical URLs.
LISTED = ["cheap-pills.example.com/", "cheap-pills.example.net/", "cheap-pills.example.org/", "casino-win.example.com/", "casino-win.example.net/", "casino-win.example.org/", "spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8


def url_host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says."""
    name, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        name, said = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(said)
    return name, said


def bloom_filter(keys: DataFrame, n_keys: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """The blocks of the filter of `keys.key` (block, w0 .. w7), and the number of blocks."""
    n_blocks = max(1, -(-n_keys * bits_per_key // (32 * LANES)))
    rows = keys.select(block_of("key", n_blocks).alias("block"), *lanes("key"))
    return stored(rows.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(LANES)]), "bloom"), n_blocks


def block_of(key: str, n_blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64({key}), {n_blocks}L)")


def lanes(key: str) -> list[Column]:
    """One bit in each of the eight 32-bit lanes of a block."""
    return [F.expr(f"shiftleft(1, cast(shiftright(xxhash64({key}, 'lanes'), {5 * j}) & 31L as int))").alias(f"w{j}") for j in range(LANES)]


def canonical_keys(max_labels: int, max_depth: int) -> Column:
    """The suffixes of a host of at most max_labels labels, each with the prefixes of its path of at most max_depth
    segments, with and without a slash at the end; further ones cannot be listed."""
    suffixes = F.expr(f"transform(sequence(1, least(size(split(host, '[.]', -1)), {max_labels})), i -> array_join(slice(split(host, '[.]', -1), -i, i), '.'))")
    parents = F.expr(f"transform(sequence(1, least(size(split(path, '/', -1)) - 1, {max_depth + 1})), i -> array_join(slice(split(path, '/', -1), 1, i), '/'))")
    prefixes = F.array_append(F.concat(parents, F.transform(parents, lambda p: F.concat(p, F.lit("/")))), F.col("path"))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """The rows with host, path, rule and verdict. listed: one column, canonical URLs (host in lower case, /, path)."""
    new = ["host", "path", "rule", "verdict"]
    url = F.col(url_col)
    keep = [c for c in pages.columns if c not in new]
    rows = pages.select(F.struct(*pages.columns).alias("row"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    keys = stored(listed.select(F.col(listed.columns[0]).alias("key")).filter("key is not null").distinct(), "listed")
    n, labels, depth = keys.agg(F.count(F.lit(1)), F.max(F.size(F.split(F.substring_index("key", "/", 1), "[.]", -1))), F.max(F.size(F.split("key", "/", -1)))).first()
    blocks, n_blocks = bloom_filter(keys, n)
    open_rows = rows.filter(said.isNull() & (F.col("host") != "") & (F.col("path") != "")).select(F.col("url").alias("hit_url"), "host", "path").distinct()
    probes = open_rows.select("hit_url", F.explode(canonical_keys(labels or 1, depth or 1)).alias("key"))
    probes = probes.select("hit_url", "key", block_of("key", n_blocks).alias("probe"), *lanes("key"))
    passed = probes.join(blocks.select("block", *[F.col(f"w{j}").alias(f"b{j}") for j in range(LANES)]), F.col("probe") == F.col("block"))
    for j in range(LANES):
        passed = passed.filter(F.expr(f"w{j} & b{j} = w{j}"))
    hits = passed.select("hit_url", "key").join(keys.hint("shuffle_hash"), "key", "left_semi").select("hit_url").distinct()
    hits = stored(hits, "hits")
    out = rows.join(hits, F.col("url") == F.col("hit_url"), "left")
    verdict = F.coalesce(said, F.when(F.col("hit_url").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "host", "path", name.alias("rule"), verdict.alias("verdict"))
