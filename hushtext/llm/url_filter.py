"""URL rules, then a block list behind a blocked Bloom filter.

Only DataFrame functions are used.  The list of canonical URLs is folded into a
Bloom filter whose blocks are rows: a block has eight words of 64 bits and a URL
sets one bit in each word of one block.  Pages look up their block with an equi-join
(broadcast by Spark while the filter is below its threshold, a shuffle beyond it);
only the pages that pass go on to the exact hash join, which removes the false
positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_URL = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered.

    Empty where the URL is null or has no ``://``.
    """
    return F.translate(_raw_host(url), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """Text from the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_host(url), r"^[^?#]*", 0)


def canonical_url(url: Column) -> Column:
    """Spelling under which a URL is listed; null without a host.

    Scheme, fragment, a leading ``www.``, trailing slashes and the parameters
    ``ref`` and ``utm_*`` are left out.
    """
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(_after_host(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(ref|utm_[a-z]+)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    full = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", full)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (``host/path``) that fits; null where none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(
            "/" + rest
        )
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: dict[str, str],
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """Judge every page by rules and by a list.

    ``listed`` has a column ``canonical``; nulls and repeated entries in it do no
    harm.  ``rules`` maps ``host/path`` to ``block`` or ``allow``; the longest that
    fits decides.  Pages that no rule fits are blocked if their canonical URL is
    listed, else allowed.  Returns ``keep``, ``host``, ``path``, ``rule``,
    ``verdict``; one row per input row, repeated rows and rows with nulls included.
    A null or malformed URL has an empty host and path and is allowed.  Other
    columns of ``pages`` play no part.  An empty list or table gives no error.
    """
    entries = listed.select("canonical").where("canonical IS NOT NULL").distinct()
    blocks = max(1, -(-entries.count() * BITS_PER_URL // (64 * WORDS)))
    bloom = _bloom(entries, blocks)

    link = F.col(url)
    named = pages.select(
        *keep, url_host(link).alias("host"), url_path(link).alias("path"),
        canonical_url(link).alias("canonical"),
    )
    judged = named.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit("allow")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    judged = judged.withColumn("verdict", verdict)

    # a page in no need of the list has no block, and so no possible hit
    asks = F.col("rule").isNull() & F.col("canonical").isNotNull()
    decided = judged.where(~asks)
    open_ = judged.where(asks).withColumn("block", _block("canonical", blocks))
    probed = open_.join(bloom, "block", "left").withColumn(
        "possible", F.coalesce(_all_bits_set(), F.lit(False))
    )
    columns = [*keep, "host", "path", "rule", "verdict"]
    misses = probed.where("NOT possible").select(columns)
    exact = entries.withColumn("on_list", F.lit(True)).hint("shuffle_hash")
    hits = (
        probed.where("possible")
        .join(exact, "canonical", "left")
        .withColumn("verdict", F.when(F.col("on_list"), "block").otherwise("allow"))
        .select(columns)
    )
    return decided.select(columns).unionByName(misses).unionByName(hits)


def _raw_host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(
        F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit("")
    )


def _after_host(url: Column) -> Column:
    rest = _rest(url)
    return F.substring(rest, F.length(_raw_host(url)) + 1, F.length(rest))


def _block(column: str, blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64({column}), {blocks}L)")


def _bit(column: str, word: int) -> str:
    return f"CAST(shiftright(xxhash64({column}, 1), {6 * word}) & 63 AS INT)"


def _bloom(entries: DataFrame, blocks: int) -> DataFrame:
    words = [
        F.expr(f"bit_or(shiftleft(1L, {_bit('canonical', i)}))").alias(f"w{i}")
        for i in range(WORDS)
    ]
    return entries.groupBy(_block("canonical", blocks).alias("block")).agg(*words)


def _all_bits_set() -> Column:
    tests = [
        f"(shiftrightunsigned(w{i}, {_bit('canonical', i)}) & 1L) = 1"
        for i in range(WORDS)
    ]
    return F.expr(" AND ".join(tests))
