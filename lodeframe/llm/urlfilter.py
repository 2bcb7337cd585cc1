"""URL verdicts: prefix rules first, then a list of canonical URLs behind a blocked Bloom filter.

Only DataFrame functions run here. The Bloom filter has a fixed number of blocks, so what is
broadcast never exceeds BLOCKS * 32 bytes of masks, whatever the list's length; what it lets
through wrongly is removed by an exact join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the Bloom filter, of 4 words of 64 bits each.
BLOCKS = 1 << 14
#: Parts that a canonical URL's rows are dealt over in the exact join.
SALTS = 16

_AFTER = r"(?s)^.*?://(.*)$"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(url, _AFTER, 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty where there is none."""
    rest = F.regexp_extract(url, _AFTER, 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., and path without closing slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    rules: (action, host, path). A rule fits its host and all subdomains where the path starts
    with the rule's path. Longest: by the length of host and path together, then host, then rule.
    """
    fits = []
    for action, rule_host, rule_path in rules:
        hit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits.append(
            F.when(
                hit,
                F.struct(
                    F.lit(len(rule_host) + len(rule_path)).alias("n"),
                    F.lit(len(rule_host)).alias("n_host"),
                    F.lit(rule_host + rule_path).alias("rule"),
                    F.lit(action).alias("verdict"),
                ),
            )
        )
    if not fits:
        return F.lit(None).cast("struct<n:int,n_host:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def _places(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL and the mask that it sets in each of the block's four words."""
    place = F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")
    bits = F.xxhash64(url, F.lit(7))
    masks = [
        F.call_function(
            "shiftleft",
            F.lit(1).cast("bigint"),
            F.shiftrightunsigned(bits, 12 * i).bitwiseAND(F.lit(63)).cast("int"),
        )
        for i in range(4)
    ]
    return place, masks


def bloom_blocks(urls: DataFrame, url_col: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter as rows (block, w0..w3), at most `blocks` of them."""
    place, masks = _places(F.col(url_col), blocks)
    return (
        urls.select(place.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
    )


def with_possible(rows: DataFrame, url_col: str, filter_rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds __maybe: whether the URL may be listed. The broadcast side has at most `blocks` rows
    of 36 bytes; the rows themselves are not shuffled."""
    place, masks = _places(F.col(url_col), blocks)
    side = filter_rows.select(
        F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(4)]
    )
    held = F.lit(True)
    for i, m in enumerate(masks):
        held = held & (F.col(f"__w{i}").bitwiseAND(m) == m)
    joined = rows.join(F.broadcast(side), place == F.col("__block"), "left")
    return joined.select(
        *rows.columns, (F.col(url_col).isNotNull() & F.coalesce(held, F.lit(False))).alias("__maybe")
    )


def crawl_traps(pages: DataFrame, variants: int = 2, url_col: str = "url") -> DataFrame:
    """Canonical URLs that were captured under `variants` or more different raw URLs."""
    h, p = host_of(F.col(url_col)), path_of(F.col(url_col))
    return (
        pages.select(canonical(h, p).alias("listed"), F.col(url_col).alias("__raw"))
        .filter("listed <> ''")
        .distinct()
        .groupBy("listed")
        .agg(F.count("*").alias("__n"))
        .filter(F.col("__n") >= variants)
        .select("listed")
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict.

    The longest fitting rule decides; without one, a URL whose canonical form is in `listed`
    (column `listed`, nulls and repeats ignored) is blocked and any other allowed. A null URL or
    one without :// has an empty host and path, fits no rule and is allowed. Repeated rows give
    repeated rows; other columns of `pages` are not read. The exact join removes every false
    positive of the filter; its rows are salted, as one URL may hold a third of all rows.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("__fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "__url", F.when(F.col("__fit").isNull() & (F.col("host") != ""), canonical(F.col("host"), F.col("path")))
    )
    keys = listed.select("listed").filter(F.col("listed").isNotNull()).distinct()
    rows = with_possible(base, "__url", bloom_blocks(keys, "listed", blocks), blocks)
    spread = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = rows.filter("__maybe").withColumn(
        "__salt", F.pmod(F.xxhash64(id_col, "host"), F.lit(SALTS)).cast("int")
    )
    exact = hits.join(
        spread.hint("shuffle_hash"),
        (F.col("__url") == F.col("listed")) & (hits["__salt"] == spread["__salt"]),
        "left",
    )
    shape = [
        F.col(id_col),
        F.col("host"),
        F.col("path"),
        F.col("__fit.rule").alias("rule"),
    ]
    verdict = F.coalesce(
        F.col("__fit.verdict"), F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    )
    sure = rows.filter("not __maybe").withColumn("listed", F.lit(None).cast("string"))
    return exact.select(*shape, verdict.alias("verdict")).unionByName(sure.select(*shape, verdict.alias("verdict")))
