import re

import pytest
from helpers import clashing, stored
from pyspark.sql import functions as F

from normtext.llm import url_filter
from normtext.llm.queries import RULES
from normtext.llm.url_filter import canonical, possible_hits, url_verdicts

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/1", "https://www.example.com/en/1", "https://www.example.com/fr/1",
    "https://sub.www.example.com/en/x?y#z", "http://a.net/es/1", "http://net/es/", "http://xnet/es/", "http://a.net/es", "http://a.org/en/1?utm_source=q&b=2&a=1#f",
    "http://a.org/en/1/?a=1&b=2", "http://user@a.org:80/en/1?a=1&b=2&ref=x", "https://com/", "http://example.com?x://y/en/", "a://b://c/en/", "http://ÄÖ.example.com/en/ü",
    "http://a.org/" + "p" * 20_000, "http://a.org#frag", "http://a.org/?", "HTTP://A.ORG/En/1",
]
LISTED = ["https://a.org/en/1?a=1&b=2", "http://a.org/" + "p" * 20_000, "ftp://x.org/none", None, "https://a.org/en/1?a=1&b=2", "http://www.example.com/en/1"]


def plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    return host, m[2] if m else ""


def plain_canonical(url):
    if url is None or "://" not in url:
        return None
    host, path = plain_parts(url)
    query = re.search(r"://[^?#]*\?([^#]*)", url)
    kept = sorted(p for p in (query[1] if query else "").split("&") if p and not re.match(url_filter.TRACKING, p))
    return re.sub(":(80|443)$", "", re.sub("^.*@", "", host)) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain_verdict(url, listed):
    host, path = plain_parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if plain_canonical(url) in listed else "allow"


def tables(spark, tmp_path, urls=URLS, listed=LISTED):
    pages = spark.createDataFrame([*enumerate(urls), (4, urls[4]), (None, urls[5])] if urls else [], "page_id long, url string")
    pages = stored(clashing(pages).withColumn("canonical", F.lit("x")).withColumn("host", F.lit(1)), tmp_path, "pages")
    return pages, stored(spark.createDataFrame([(u,) for u in listed], "url string"), tmp_path, "listed")


@pytest.mark.parametrize("blocks", [None, 1])
def test_verdicts_match_plain(spark, tmp_path, monkeypatch, blocks):
    """Also with a filter so full that nearly everything passes to the exact join."""
    if blocks:
        monkeypatch.setattr(url_filter, "block_count", lambda keys: blocks)
    pages, listed = tables(spark, tmp_path, listed=[*LISTED, *(f"http://f.org/{i}" for i in range(3000))])
    known = {plain_canonical(u) for u in LISTED} - {None}
    want = [(i, *plain_verdict(u, known)) for i, u in [*enumerate(URLS), (4, URLS[4]), (None, URLS[5])]]
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, listed, RULES).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_filter_has_no_false_negatives(spark, tmp_path):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    others = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("canonical"))
    assert possible_hits(keys, keys, 4000).where("NOT possible").count() == 0
    assert possible_hits(others, keys, 4000).where("possible").count() < 0.02 * 20000


def test_canonical_forms(spark):
    found = spark.createDataFrame([(u,) for u in URLS], "url string").select(canonical().alias("c")).collect()
    assert [r.c for r in found] == [plain_canonical(u) for u in URLS]


def test_empty_tables(spark, tmp_path):
    pages, listed = tables(spark, tmp_path, urls=[], listed=[])
    assert url_verdicts(pages, listed, RULES).collect() == []
    pages, listed = tables(spark, tmp_path / "b", listed=[])
    assert {r.verdict for r in url_verdicts(pages, listed, []).collect()} == {"allow"}


def test_a_filter_too_large_to_broadcast(spark):
    """Joined by block number the filter tells the same, passes all that is listed and little else, and has no most."""
    from pyspark.sql import functions as F

    from normtext.llm.url_filter import block_count, possible_hits

    listed = spark.range(20_000).select(F.concat(F.lit("h.com/"), "id").alias("canonical"))
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 != 3, F.concat(F.lit("h.com/"), "id")).alias("canonical"), "id")
    small = possible_hits(rows, listed, 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark's own choice for small tables
    try:
        large = possible_hits(rows, listed, 20_000, broadcast_blocks=8)
        told = large.where("possible").select("id").collect()
        plan = large._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(told) == sorted(small.where("possible").select("id").collect())
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    hits = {r.id for r in told}
    assert {i for i in range(20_000) if i % 10 != 3} <= hits and not any(i % 10 == 3 for i in hits)
    assert len([i for i in hits if i >= 20_000]) < 0.02 * 36_000
    assert block_count(10**9) * 16 >= 10**9
