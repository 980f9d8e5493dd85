"""Registered queries: sources, parsing, silver build, sinks and continuous intake."""

from __future__ import annotations

from pyspark.sql import functions as F


from normtext.plans import sql_parts as sql
from normtext.plans.bindings import documents, provisions, table
from normtext.plans.registry import Registry
from normtext.session import shared_path
from normtext.sources import envelopes, passages, pools, segment, tables
from normtext.streaming.ingest import stream_new_documents

registry = Registry()


def _number(column: str = "document_id"):
    return F.regexp_extract(column, r"\d+", 0).cast("long")


@registry.add(
    "bronze_documents",
    """SELECT 'doc-' || doc_id AS document_id, source AS title, sha256(text) AS source_sha256, strlen(text)::BIGINT AS payload_size_bytes
    FROM documents WHERE doc_id % 11 <> 0""",
)
def bronze_documents(spark, sf_dir):
    return envelopes.parse_envelopes(_envelopes(spark, sf_dir))[0].select(
        "document_id", "title", "source_sha256", "payload_size_bytes"
    )


def _envelopes(spark, sf_dir):
    """Every document as a JSON envelope; every eleventh sits in a file of another name."""
    docs = documents(spark, sf_dir)
    stem = F.when(_number() % 11 == 0, F.concat("document_id", F.lit("-copy"))).otherwise(F.col("document_id"))
    return docs.select(
        F.concat(stem, F.lit(".json")).alias("file_name"),
        F.to_json(
            F.struct(
                "document_snapshot_id", "document_id", "title", "version", "source_page_url", "source_sha256",
                F.octet_length("text").cast("long").alias("payload_size_bytes"), "text", F.col("text").alias("raw_xml"),
            )
        ).alias("value"),
    )


@registry.add(
    "rejected_envelopes",
    """SELECT 'doc-' || doc_id || '-copy.json' AS file_name, 'doc-' || doc_id AS document_id,
      'file stem differs from document_id' AS reason FROM documents WHERE doc_id % 11 = 0""",
)
def rejected_envelopes(spark, sf_dir):
    return envelopes.parse_envelopes(_envelopes(spark, sf_dir))[1]


def _xml(spark, sf_dir):
    """Every document as an XML payload, with planted faults by number."""
    docs = documents(spark, sf_dir)
    n = _number()
    escaped = F.regexp_replace(F.col("text"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    element = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    body = F.concat(
        element("dok_id", F.when(n % 9 == 0, F.lit("doc-x")).otherwise(F.col("document_id"))),
        element("typ", F.when(n % 10 == 0, "bet").otherwise("sfs")),
        element("subtyp", F.lit("sfst")),
        element("beteckning", F.concat(F.lit(" "), F.col("document_id"), F.lit(" "))),
        element("titel", F.when(n % 8 == 0, " ").otherwise(F.col("title"))),
        element("organ", F.lit("office")),
        element("datum", F.lit("2026-01-01")),
        element("publicerad", F.lit("2026-01-02")),
        element("text", escaped),
        element("html", F.concat(F.lit("&lt;p&gt;"), escaped)),
    )
    xml = F.when(n % 7 == 0, F.lit("<dokumentstatus></dokumentstatus>")).otherwise(
        F.concat(F.lit("<dokumentstatus><dokument>"), body, F.lit("</dokument></dokumentstatus>"))
    )
    content = F.when(n % 13 == 0, F.concat(F.encode(xml, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(xml, "UTF-8"))
    return docs.select(
        F.col("document_id").alias("expected_id"), F.explode(F.array(content)).alias("content"), F.col("source_page_url"),
        F.col("source_page_url").alias("source_data_url"), F.lit("2026-02-01").alias("retrieved_at"),
    )


_XML_REASON = """CASE WHEN doc_id % 13 = 0 THEN 'not lossless UTF-8' WHEN doc_id % 7 = 0 THEN 'no dokument element'
  WHEN doc_id % 8 = 0 THEN 'missing titel' WHEN trim(text) = '' THEN 'missing text'
  WHEN doc_id % 9 = 0 THEN 'document id mismatch' WHEN doc_id % 10 = 0 THEN 'unexpected document type' END"""


@registry.add(
    "xml_documents",
    f"""SELECT 'doc-' || doc_id AS document_id, 'doc-' || doc_id AS designation, source AS title, text, '<p>' || text AS html
    FROM documents WHERE {_XML_REASON} IS NULL""",
)
def xml_documents(spark, sf_dir):
    return envelopes.documents_from_xml(_xml(spark, sf_dir))[0].select("document_id", "designation", "title", "text", "html")


@registry.add(
    "rejected_xml",
    f"SELECT 'doc-' || doc_id AS expected_id, {_XML_REASON} AS reason FROM documents WHERE {_XML_REASON} IS NOT NULL",
)
def rejected_xml(spark, sf_dir):
    return envelopes.documents_from_xml(_xml(spark, sf_dir))[1]


@registry.add(
    "source_audit",
    """WITH d AS (SELECT 'doc-' || doc_id AS id, doc_id, sha256(text) AS sha FROM documents),
    m AS (SELECT 'doc-' || l.doc_id AS id, CASE WHEN quality = 1 THEN sha256(text) ELSE 'other' END AS raw FROM labels l JOIN documents USING (doc_id)
      UNION ALL SELECT 'gone-' || doc_id, 'x' FROM labels WHERE toxic = 1)
    SELECT coalesce(d.id, m.id) AS document_id, coalesce(doc_id % 12 <> 0, false) AS hash_ok,
      CASE WHEN d.id IS NULL THEN 'missing document' WHEN m.id IS NULL THEN 'not in manifest'
        WHEN CASE WHEN doc_id % 12 = 0 THEN 'bad' ELSE sha END <> raw THEN 'manifest hash differs' ELSE 'ok' END AS manifest_status
    FROM d FULL JOIN m ON d.id = m.id""",
)
def source_audit(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("raw_xml", F.col("text"))
    marked = docs.withColumn("source_sha256", F.when(_number() % 12 == 0, "bad").otherwise(F.col("source_sha256")))
    labels = table(spark, sf_dir, "labels").withColumn("document_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    known = labels.join(docs.select("document_id", F.col("source_sha256").alias("_s")), "document_id").select(
        "document_id", F.when(F.col("quality") == 1, F.col("_s")).otherwise("other").alias("raw_sha256")
    )
    gone = labels.where("toxic = 1").select(
        F.concat(F.lit("gone-"), F.col("doc_id").cast("string")).alias("document_id"), F.lit("x").alias("raw_sha256")
    )
    return envelopes.audit_sources(marked, known.unionByName(gone))


@registry.add(
    "selected_pool",
    """WITH seeds AS (SELECT 'order-' || o_orderkey AS document_id FROM orders WHERE o_totalprice > 499000),
    listing AS (SELECT 'order-' || o_orderkey AS document_id, o_orderdate, o_orderpriority FROM orders)
    SELECT document_id, 'seed' AS selected_as FROM seeds
    UNION ALL SELECT document_id, 'newest' FROM (SELECT document_id, row_number() OVER (ORDER BY o_orderdate DESC, document_id) AS n
      FROM listing ANTI JOIN seeds USING (document_id) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) r
    WHERE n <= 500 - (SELECT count(*) FROM seeds)""",
)
def selected_pool(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("document_id")
    listing = orders.select(key, F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("issued_at"))
    rule = pools.title_rule(F.col("title"), ["urgent", "high"], ["low"])
    return pools.select_pool(listing, orders.where("o_totalprice > 499000").select(key), 500, rule)


@registry.add(
    "new_documents",
    """SELECT 'doc-' || doc_id AS document_id, n_chars FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang IN ('en', 'fr')""",
)
def new_documents(spark, sf_dir):
    existing = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"))
    fresh, _ = pools.new_documents(documents(spark, sf_dir), existing, F.col("lang").isin("en", "fr"))
    return fresh.select("document_id", "n_chars")


@registry.add(
    "failed_documents",
    """SELECT 'doc-' || doc_id AS document_id FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang NOT IN ('en', 'fr')""",
)
def failed_documents(spark, sf_dir):
    existing = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"))
    return pools.new_documents(documents(spark, sf_dir), existing, F.col("lang").isin("en", "fr"))[1]


@registry.add("streamed_documents", "SELECT 'doc-' || doc_id AS document_id, sha256(text) AS source_sha256 FROM documents")
def streamed_documents(spark, sf_dir):
    """The documents table as a stream, drained once; the store then holds each snapshot once."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # As a pattern the path may be one file or a folder of many: a stream takes a plain path for a folder.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    incoming = stream.select(
        F.concat_ws(":", key, F.sha2("text", 256)).alias("document_snapshot_id"),
        key.alias("document_id"),
        F.sha2("text", 256).alias("source_sha256"),
    )
    store = shared_path(spark, "stream-store")
    stream_new_documents(incoming, store, shared_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.schema(incoming.schema).parquet(store).select("document_id", "source_sha256")


def statute_html(spark, sf_dir):
    """Each document's lines as statute paragraphs: a chapter every five lines, a heading every
    three, every fourth anchor name repeated, a transitional section after the last line."""
    docs = documents(spark, sf_dir)

    def paragraph(line, i):
        name = F.concat(F.lit("P"), (i - F.when(i % 4 == 3, 1).otherwise(0) + 1).cast("string"))
        chapter = F.when(i % 5 == 0, F.concat(F.lit('<h3 name="K'), (i / 5).cast("int").cast("string"), F.lit('">Chapter '), i.cast("string"), F.lit("</h3>"))).otherwise("")
        heading = F.when(i % 3 == 1, F.concat(F.lit("<h4>Heading "), i.cast("string"), F.lit("</h4>"))).otherwise("")
        text = F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return F.concat(
            chapter, heading, F.lit('<a class="paragraf" name="'), name, F.lit('"><b>'), (i + 1).cast("string"),
            F.lit(' §</b></a> <a name="'), name, F.lit('S1"></a>'), text, F.lit("<br title=\"1 > 0\">tail&nbsp;&aring;&sect&#167;&#xA7; &amp;lt; <i class='a>b'>note "), i.cast("string"), F.lit("</i><p>"),
        )

    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    body = F.array_join(F.transform(lines, paragraph), "\n")
    closing = F.lit('<h3 name="overgang">Later rules</h3><br>2020:1<br>First rule.<br>2021:22<br>Second rule.')
    html = F.when(_number() % 6 == 0, body).otherwise(F.concat(body, closing))
    return docs.select("document_id", "title", "version", "source_page_url", "source_sha256", "document_snapshot_id", html.alias("html"))


_LINES = """lines AS MATERIALIZED (SELECT doc_id, (i - 1) AS i, kept[i] AS line, len(kept) AS n FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS kept FROM documents) d, unnest(range(1, len(kept) + 1)) t(i)),
paragraphs AS MATERIALIZED (SELECT 'doc-' || doc_id AS document_id, i, doc_id,
  'P' || (i - CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END + 1) || CASE WHEN i % 4 = 3 THEN ':occurrence:2' ELSE '' END AS provision_suffix,
  'P' || (i - CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END + 1) AS source_anchor,
  CASE WHEN i % 4 = 3 THEN 2 ELSE 1 END AS source_anchor_occurrence, (i + 1) || ' §' AS label,
  'Chapter ' || ((i // 5) * 5) AS chapter, CASE WHEN i >= 1 THEN 'Heading ' || (((i - 1) // 3) * 3 + 1) ELSE '' END AS heading,
  (i + 1)::INT AS "order", trim(regexp_replace(line, ' +', ' ', 'g')) || chr(10) || 'tail å§§§ &lt; note ' || i AS text FROM lines)"""


@registry.add(
    "html_provisions",
    f"""WITH {_LINES} SELECT document_id, provision_suffix, source_anchor, source_anchor_occurrence, label, chapter, heading,
      "order", text FROM paragraphs""",
)
def html_provisions(spark, sf_dir):
    return segment.segment_provisions(statute_html(spark, sf_dir)).drop("kind", "subsection_anchors", "amendment_notes")


@registry.add(
    "provision_notes",
    f"""WITH {_LINES} SELECT document_id, "order", source_anchor || 'S1' AS subsection_anchors, 'note ' || i AS amendment_notes FROM paragraphs""",
)
def provision_notes(spark, sf_dir):
    cut = segment.segment_provisions(statute_html(spark, sf_dir))
    return cut.select(
        "document_id", "order", F.array_join("subsection_anchors", "|").alias("subsection_anchors"),
        F.array_join("amendment_notes", "|").alias("amendment_notes"),
    )


@registry.add(
    "transitional_provisions",
    f"""WITH {_LINES}, n AS (SELECT d.doc_id, count(l.i) AS n FROM documents d LEFT JOIN lines l USING (doc_id) WHERE d.doc_id % 6 <> 0 GROUP BY 1)
    SELECT 'doc-' || doc_id AS document_id, s AS provision_suffix, l AS label, (n + k)::INT AS "order", t AS text
    FROM n, (VALUES ('overgang:2020-1', 'SFS 2020:1', 1, '2020:1' || chr(10) || 'First rule.'),
                    ('overgang:2021-22', 'SFS 2021:22', 2, '2021:22' || chr(10) || 'Second rule.')) v(s, l, k, t)""",
)
def transitional_provisions(spark, sf_dir):
    found, _ = segment.segment_transitional(statute_html(spark, sf_dir))
    return found.select("document_id", "provision_suffix", "label", "order", "text")


_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
  '(?i)<br\b[^>]*>', chr(10), 'g'), '(?i)<p\b[^>]*>', chr(10) || chr(10), 'g'), '</?[A-Za-z!][^>]*>', '', 'g')"""
_DECODED = _STRIPPED
for _name, _character in (
    ("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&amp;", "'&'"),
):
    _DECODED = f"replace({_DECODED}, '{_name}', {_character})"

# Markup in front of every page that a pattern up to the next ">" and a list of a few names would get wrong.
_PLANTED = """<i title="1 > 0" data-x='a>b'>&aring;&sect&#167;&#xA7; &amp;lt;</i><!-- a > b --><script>if (a < b) "<p>";</script><br class="x>y">"""


@registry.add(
    "normalized_pages",
    rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('å§§§ &lt;' || chr(10) || replace({_DECODED}, chr(160), ' '),
      '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""",
)
def normalized_pages(spark, sf_dir):
    from normtext.functions.markup import normalize_text

    return table(spark, sf_dir, "pages").select("page_id", normalize_text(F.concat(F.lit(_PLANTED), F.col("html"))).alias("text"))


def section_text(spark, sf_dir):
    """Lines of each document as numbered sections of four lines with page furniture;
    the last section repeats the first number."""
    docs = documents(spark, sf_dir)

    def laid(line, i):
        number = (i / 4).cast("int") + 1
        head = F.when(i % 4 == 0, F.concat(number.cast("string"), F.lit(".  Title "), i.cast("string"), F.lit("\n"))).otherwise("")
        page = F.when(i % 4 == 2, "Body and Rules              [Page 3]\n\fnew page\nRFC 1234   Rules of Text   May 2001\n").otherwise("")
        return F.concat(head, page, F.lit("  "), F.trim(line))

    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    body = F.array_join(F.transform(lines, laid), "\n")
    return docs.select("document_id", "title", "source_page_url", F.concat(F.lit("preamble\n"), body, F.lit("\n1.  Again\nlast word\n")).alias("text"))


@registry.add(
    "document_sections",
    f"""WITH {_LINES}, grouped AS (SELECT doc_id, i // 4 + 1 AS section, string_agg('  ' || trim(line), chr(10) ORDER BY i) AS body, min(i) AS first
      FROM lines GROUP BY 1, 2)
    SELECT 'doc-' || doc_id AS document_id, section::VARCHAR AS section, 'Title ' || first AS title,
      section || '.  Title ' || first || chr(10) || body AS text FROM grouped WHERE section > 1
    UNION ALL SELECT 'doc-' || doc_id, '1', 'Again', '1.  Again' || chr(10) || 'last word' FROM documents""",
)
def document_sections(spark, sf_dir):
    return segment.segment_sections(section_text(spark, sf_dir))


def _silver(spark, sf_dir):
    docs = statute_html(spark, sf_dir).withColumn("bronze_ingested_at", F.current_timestamp())
    return docs, segment.segment_statutes(docs)


@registry.add(
    "enriched_provisions",
    f"""WITH {_LINES} SELECT p.document_id || ':' || provision_suffix AS provision_id, source AS document_title,
      CASE WHEN lang <> 'de' THEN lang END AS document_version, 'http://texts.example/' || p.document_id || '#' || source_anchor AS source_url,
      sha256(p.text) AS provision_text_sha256 FROM paragraphs p JOIN documents USING (doc_id)
    UNION ALL SELECT 'doc-' || doc_id || ':' || s, source, CASE WHEN lang <> 'de' THEN lang END, 'http://texts.example/doc-' || doc_id || '#overgang',
      sha256(t) FROM documents, (VALUES ('overgang:2020-1', '2020:1' || chr(10) || 'First rule.'),
        ('overgang:2021-22', '2021:22' || chr(10) || 'Second rule.')) v(s, t) WHERE doc_id % 6 <> 0""",
)
def enriched_provisions(spark, sf_dir):
    docs, found = _silver(spark, sf_dir)
    return pools.enrich(found, docs).select(
        "provision_id", "document_title", "document_version", "source_url", "provision_text_sha256"
    )


@registry.add(
    "unparsable_documents",
    "SELECT 'page-' || page_id AS document_id FROM pages WHERE NOT contains(html, '<li><a href=\"/and\">')",
)
def unparsable_documents(spark, sf_dir):
    """Pages whose navigation links to one word are read as paragraphs, the others give none."""
    html = F.replace("html", F.lit('<a href="/and">'), F.lit('<a class="paragraf" name="P1">'))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("document_id"), html.alias("html")
    )
    return pools.build_provisions(pages, segment.segment_provisions(pages), strict=False)[1]


_SAMPLE = ["provision_id", "document_id", "document_title", "char_count"]


@registry.add(
    "written_tables",
    f"""WITH {sql.PROVISIONS} SELECT provision_id, document_id, document_title, char_count FROM provisions""",
)
def written_tables(spark, sf_dir):
    """Tables committed as one set, registered as views and read back through SQL."""
    silver = provisions(spark, sf_dir)
    path = tables.write_tables({"provisions": silver.select(*_SAMPLE)}, shared_path(spark, "tables"))
    tables.open_tables(spark, path, ("provisions",))
    return spark.sql("SELECT provision_id, document_id, document_title, char_count FROM provisions")


@registry.add(
    "exported_csv",
    f"""WITH {sql.PROVISIONS} SELECT document_id, document_title, count(*) AS provisions FROM provisions GROUP BY 1, 2""",
)
def exported_csv(spark, sf_dir):
    counts = provisions(spark, sf_dir).groupBy("document_id", "document_title").agg(F.count("*").alias("provisions"))
    path = tables.export_csv(counts, shared_path(spark, "export"))
    return spark.read.csv(path, header=True, sep=";", escape='"', schema=counts.schema)


@registry.add(
    "resolved_passages",
    f"""WITH {_LINES}, counted AS (SELECT document_id, provision_suffix, min(text) AS text, min(source_anchor) AS anchor FROM paragraphs GROUP BY 1, 2)
    SELECT 'doc-' || d.doc_id || ':' || CASE WHEN doc_id % 4 = 0 THEN 'P99999' ELSE 'P1' END AS passage_id, 'statute' AS domain,
      CASE WHEN doc_id % 4 <> 0 AND doc_id % 12 <> 1 THEN sha256(c.text) END AS text_sha256,
      CASE WHEN doc_id % 12 = 1 THEN 'source hash mismatch' WHEN doc_id % 4 = 0 OR c.text IS NULL THEN 'no such passage' END AS problem
    FROM documents d LEFT JOIN counted c ON c.document_id = 'doc-' || d.doc_id AND c.provision_suffix = 'P1'
    UNION ALL SELECT 'doc-' || doc_id || ':1', 'specification', CASE WHEN doc_id % 12 <> 1 THEN sha256('1.  Again' || chr(10) || 'last word') END,
      CASE WHEN doc_id % 12 = 1 THEN 'source hash mismatch' END FROM documents
    UNION ALL SELECT 'inline-' || item_id, 'inline', CASE WHEN item_id % 5 <> 0 THEN sha256(text) END,
      CASE WHEN item_id % 5 = 0 THEN 'text hash mismatch' END FROM benchmark""",
)
def resolved_passages(spark, sf_dir):
    docs = statute_html(spark, sf_dir).withColumn("raw_xml", F.col("html")).withColumn(
        "source_sha256", F.when(_number() % 12 == 1, "0").otherwise(F.sha2("html", 256))
    )
    ids = documents(spark, sf_dir).select("document_id")
    none = F.lit(None).cast("string")
    statute = ids.select(
        F.concat_ws(":", "document_id", F.when(_number() % 4 == 0, "P99999").otherwise("P1")).alias("passage_id"),
        F.lit("statute").alias("domain"), none.alias("text"), none.alias("text_sha256"),
    )
    specification = ids.select(
        F.concat("document_id", F.lit(":1")).alias("passage_id"), F.lit("specification").alias("domain"),
        none.alias("text"), none.alias("text_sha256"),
    )
    inline = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("inline-"), F.col("item_id").cast("string")).alias("passage_id"), F.lit("inline").alias("domain"),
        "text", F.when(F.col("item_id") % 5 == 0, "0").otherwise(F.sha2("text", 256)).alias("text_sha256"),
    )
    found = passages.resolve_passages(
        statute.unionByName(specification).unionByName(inline), segment.segment_provisions(docs),
        segment.segment_sections(section_text(spark, sf_dir)), docs,
    )
    return found.select("passage_id", "domain", F.sha2("text", 256).alias("text_sha256"), "problem")
