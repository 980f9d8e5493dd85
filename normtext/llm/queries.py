"""The registered queries of this package and their checking SQL, by module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normtext.llm.decontaminate import contaminated
from normtext.llm.exact_chunks import exact_duplicates
from normtext.llm.language_bits import identify
from normtext.llm.length_buckets import pack
from normtext.llm.license_scan import all_rules, labels_of, scan_licenses, spaced
from normtext.llm.minhash import near_duplicates
from normtext.llm.periodic_runs import periodic_runs, with_repetition
from normtext.llm.secret_scan import scan
from normtext.llm.site_quality import measure, site_quality
from normtext.llm.spelling_trie import damaged, frequent_words, letter_runs, spelling_variants
from normtext.llm.toxic_crf import score_toxicity
from normtext.llm.url_filter import host_of, path_of, url_verdicts
from normtext.llm.warc import archived
from normtext.plans.registry import Registry

registry = Registry()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4
           THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))
           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * both_have.n >= 80 * (x.n + y.n - both_have.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_DOC_IN_PATH = r"/([0-9]+)(?:\.html)?/?$"  # the document that a page shows

_URLS = r"""
WITH p AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=|$)'))) AS kept
  FROM pages
), c AS (
  SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN
           regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM p
), listed AS (
  SELECT DISTINCT canonical FROM c JOIN labels
    ON labels.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)(?:\.html)?/?$', 1) AS BIGINT)
  WHERE toxic = 1 AND canonical IS NOT NULL
), rules(rule_host, rule_path, told) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, told,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM c JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT c.page_id, host, path, rule,
       coalesce(told, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fits ON fits.page_id = c.page_id AND place = 1 LEFT JOIN listed ON listed.canonical = c.canonical
"""

_ARCHIVES = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
         min(page_id) OVER (PARTITION BY sha256(payload)) AS first_id
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

# crc32 of a list of bytes, as a table of 256 entries and a fold over the bytes.
_CRC_TABLE = """
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc_table
"""
_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, crc_table[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"

_RUNS = rf"""
WITH t AS ({_CRC_TABLE}), d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         {_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} AS h
  FROM documents, t
), planted AS (
  SELECT *, (h // 10) % len(words) AS a, 1 + (len(words) - (h // 10) % len(words)) // (3 + (h // 10) % 8) AS p FROM d
), w AS (
  SELECT uid, doc_id, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0
           THEN list_transform(range(0, len(words)), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1])
           ELSE words END AS words
  FROM planted
), places AS (
  SELECT uid, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM w
), pairs AS (
  SELECT x.uid, y.i - x.i AS q, x.i FROM places x JOIN places y ON x.uid = y.uid AND x.word = y.word AND y.i > x.i
  WHERE 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY uid, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT uid, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY uid, q, island
), runs AS (
  SELECT uid, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY uid, start, length
), told AS (
  SELECT uid, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length,
         first(period ORDER BY length DESC, start, period) AS period,
         string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY uid
), kept AS (
  SELECT uid, string_agg(word, ' ' ORDER BY i) AS collapsed FROM places
  WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.uid = places.uid AND i >= start + period AND i < start + length)
  GROUP BY uid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN told USING (uid) LEFT JOIN kept USING (uid)
"""

_SPELLING = rf"""
WITH RECURSIVE t AS ({_CRC_TABLE}), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS c, flatten(list_transform(string_split(doc_id || ':' || run, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)) AS bytes
  FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, c, {_CRC.format(bytes="bytes")} AS h FROM counted, t
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(c) >= 5 AND length(word) >= 6
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON cuts.cut = words.word
  UNION SELECT words.word, cuts.word, cuts.n FROM cuts JOIN words ON cuts.cut = words.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form,
         CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), reach AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT reach.word, formed.form, steps + 1 FROM reach JOIN formed ON formed.word = reach.root WHERE formed.form IS NOT NULL
)
SELECT word, form, (SELECT first(root ORDER BY steps DESC) FROM reach WHERE reach.word = formed.word) AS root, n, n_near, form_n FROM formed
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENSES = rf"""
WITH rules(rule, priority, label, weight, keywords, pattern) AS (VALUES
  {", ".join(f"({i}, {r.priority}, {_quoted(r.label)}, {r.weight}::DOUBLE, [{', '.join(map(_quoted, r.keywords))}], {_quoted(spaced(r.pattern))})" for i, r in enumerate(all_rules()))}
), d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS words
  FROM documents
), hits AS (
  SELECT uid, rule, priority, label, weight, ' ' || array_to_string(words, '  ') || ' ' AS line, pattern
  FROM d JOIN rules ON list_has_all(words, keywords)
), parts AS (
  SELECT *, unnest(spans) AS span, unnest(gaps[1 : len(spans)]) AS gap, unnest(range(0, len(spans))) AS k
  FROM (SELECT *, regexp_extract_all(line, pattern) AS spans, regexp_split_to_array(line, pattern) AS gaps FROM hits)
), counted AS (
  SELECT uid, rule, priority, label, weight, k, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS g,
         (length(span) - length(replace(span, ' ', ''))) // 2 AS s
  FROM parts
), placed AS (
  SELECT *, (sum(g + s) OVER (PARTITION BY uid, rule ORDER BY k))::BIGINT AS stop FROM counted
), found AS (
  SELECT uid, rule, priority, label, weight, stop - s AS first, stop FROM placed
), kept AS (
  SELECT * FROM found f WHERE priority = 0 OR NOT EXISTS (
    SELECT 1 FROM found o WHERE o.uid = f.uid AND o.priority BETWEEN 1 AND f.priority AND o.first <= f.first AND o.stop >= f.stop
      AND (o.first < f.first OR o.stop > f.stop OR o.priority < f.priority OR o.rule < f.rule))
), strongest AS (
  SELECT uid, label, max(weight) AS weight FROM kept GROUP BY uid, label
), scored AS (
  SELECT uid, string_agg(label, ',' ORDER BY label) AS labels,
         1::DOUBLE - list_reduce(list(1::DOUBLE - weight ORDER BY label), lambda p, w: p * w, 1::DOUBLE) AS score
  FROM strongest GROUP BY uid
), base AS (
  SELECT uid, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM kept WHERE priority = 0 GROUP BY uid
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
FROM d LEFT JOIN base USING (uid) LEFT JOIN scored USING (uid)
"""


@registry.add("op1_url_filter", _URLS)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL; listed are the pages whose document is labelled toxic."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    shown = pages.select("url", F.regexp_extract(path_of(), _DOC_IN_PATH, 1).try_cast("long").alias("doc_id"))
    listed = shown.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return url_verdicts(pages, listed, RULES)


@registry.add("op5_warc", _ARCHIVES)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    return archived(spark, _table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@registry.add("op3_exact_dedup", _EXACT)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by chunk recipes."""
    return exact_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@registry.add("op2_near_dedup", _NEAR)
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by circulant MinHash with exact verification."""
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@registry.add("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by bit-sliced n-gram filters, learned from two thirds of the labelled rows."""
    return identify(_table(spark, sf_dir, "documents"))


@registry.add("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in optimal length buckets and token-budget batches."""
    return pack(_table(spark, sf_dir, "documents"))


@registry.add("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@registry.add("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns, and random strings by two Markov models."""
    return scan(_table(spark, sf_dir, "documents"))


@registry.add("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic spans and scores of every document, learned from three quarters of the labelled rows."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@registry.add("op6_site_quality")
def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text, its page's host and its path; the source stands in where it has no page."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    shown = pages.select(
        F.regexp_extract(path_of(), _DOC_IN_PATH, 1).try_cast("long").alias("doc_id"),
        F.struct(host_of().alias("host"), F.regexp_extract(path_of(), "^/[^/]*", 0).alias("path")).alias("site"),
    )
    sites = shown.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("site").alias("site"))
    sited = measure(docs, ["doc_id", "source", "lang"]).join(sites, "doc_id", "left").select(
        "doc_id",
        F.coalesce("site.host", "source").alias("host"),
        F.coalesce("site.path", F.concat(F.lit("/"), F.col("lang"))).alias("path"),
        "measures",
    )
    return site_quality(sited, _table(spark, sf_dir, "labels"))


@registry.add("op13_periodic_runs", _RUNS)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them made periodic from some word on."""
    found = periodic_runs(with_repetition(_table(spark, sf_dir, "documents")), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("longest.s")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.q")).alias("period"), F.expr("1000 * longest.length DIV -longest.q").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


@registry.add("op11_spelling_variants", _SPELLING)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with their near words, forms and roots, one run of letters in 199 damaged."""
    return spelling_variants(frequent_words(damaged(letter_runs(_table(spark, sf_dir, "documents")))))


@registry.add("op12_license_scan", _LICENSES)
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in every document by ordered signature rules, with every place of the base phrases."""
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda d: d["first"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of("base").alias("base_labels"), labels_of("base", "detections").alias("labels"), "score",
    )
