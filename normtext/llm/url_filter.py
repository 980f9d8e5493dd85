"""URL verdicts by rules and a listed-URL check: blocked Bloom filter first, exact join second.

Canonical URLs of the list set eight bits inside one 256-bit block of a filter that is built by a
grouped OR. Pages are probed in a broadcast join on the block number; only possible hits go to the
hash join on the full canonical URL, which removes the false positives. The filter has at
most ``MOST_BLOCKS`` blocks (10 MB), whatever the list; a longer list only lets more pages
through to the exact join. DataFrame functions only.

Canonical form: scheme, fragment, user, default port and trailing slashes dropped, host in
lower case (ASCII), tracking parameters dropped, the others sorted.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule, is
not listed and is allowed; the longest fitting rule (host and path together) wins, of
equally long ones the alphabetically first; repeated rows each get a verdict; null or
repeated list entries change nothing; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.llm.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=|$)"
KEYS_PER_BLOCK = 16  # bits of a block over keys in it: 16 bits a key
BROADCAST_BLOCKS = 1 << 18  # blocks of five numbers that may be broadcast

Rule = tuple[str, str, str]  # host, path, verdict


def host_of(url: str = "url") -> Column:
    """Lower-cased (ASCII) text after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str = "url") -> Column:
    """The canonical form of a URL, null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
    return F.when(F.contains(F.col(url), F.lit("://")), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; both null if none does."""
    rule = verdict = None
    for rule_host, rule_path, told in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, told) if verdict is None else verdict.when(fits, told)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _bits(key: Column) -> list[Column]:
    """Two bits in each of the four 64-bit words of a block, from 48 bits of a hash."""
    h = F.xxhash64(key, F.lit("bits"))
    place = [F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int") for k in range(8)]
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]
    return [one[2 * k].bitwiseOR(one[2 * k + 1]) for k in range(4)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w3``: the words of every block that has a bit, from ``canonical`` keys."""
    words = [b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("canonical")))]
    return listed.select(_block(F.col("canonical"), blocks).alias("block"), *words).groupBy("block").agg(
        *[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)]
    )


def block_count(keys: int) -> int:
    wanted = max(1, -(-keys // KEYS_PER_BLOCK))
    return 1 << (wanted - 1).bit_length()


def possible_hits(rows: DataFrame, listed: DataFrame, keys: int, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``rows`` with ``possible``: whether the filter of ``listed`` lets their ``canonical`` pass.

    The filter grows with the list. Up to ``broadcast_blocks`` blocks it is broadcast; a larger one meets the rows in a
    hash join by block number, so no task holds more than its share of it.
    """
    blocks = block_count(keys)
    # Rows without a canonical form meet no block, each under a number of its own.
    nowhere = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    probe = rows.withColumn("block", F.when(F.col("canonical").isNull(), nowhere).otherwise(_block(F.col("canonical"), blocks)))
    table = bloom_blocks(listed, blocks)
    joined = probe.join(F.broadcast(table) if blocks <= broadcast_blocks else table, "block", "left")
    passes = F.lit(True)
    for k, bits in enumerate(_bits(F.col("canonical"))):
        passes = passes & (F.col(f"w{k}").bitwiseAND(bits) == bits)
    return joined.withColumn("possible", F.coalesce(passes & F.col("canonical").isNotNull(), F.lit(False))).drop(
        "block", "w0", "w1", "w2", "w3"
    )


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages`` (``page_id, url``); ``listed`` has ``url``."""
    entries = written(listed.select(canonical().alias("canonical")).where("canonical IS NOT NULL").distinct())
    host, path = host_of(), path_of()
    rule, told = rule_of(rules, F.col("host"), F.col("path"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical().alias("canonical"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), told.alias("told"), "canonical")
    probed = possible_hits(rows, entries, entries.count())
    names = ["page_id", "host", "path", "rule"]
    missed = probed.where("NOT possible").select(*names, F.coalesce("told", F.lit("allow")).alias("verdict"))
    exact = probed.where("possible").join(entries.withColumn("found", F.lit(True)), "canonical", "left")
    hits = exact.select(*names, F.coalesce("told", F.when(F.col("found"), "block").otherwise("allow")).alias("verdict"))
    return missed.union(hits)
