import random
import re

import pytest
from pyspark.sql import functions as F

from normtext.functions.ordered import with_ordinal, with_previous, with_running_total
from normtext.functions.text import UNICODE, WHITESPACE, squeeze, strip
from normtext.operators import gold, quality, requirements
from normtext.operators.matching import match_lengths
from normtext.session import shared_path
from normtext.sources import envelopes, segment, tables
from normtext.streaming.ingest import stream_new_documents

HTML = (
    '<h3 name="K1">1 kap. Allmänt</h3><h4>Syfte</h4><a class="paragraf" name="K1P1"><b>1 §</b></a>'
    ' <a name="PK1P1S1"></a>Första&nbsp;stycket.<br>Rad två.<p></p><p></p>Andra stycket. <i>Lag (2020:1).</i>'
    '<a class="paragraf" name="K1P1"><b>1 §</b></a> Upprepad &amp; kvar.'
    '<h3 name="K2">2 kap. Mer</h3><a class="paragraf" name="K2P1"><b>1 §</b></a> Under gammal rubrik.'
    '<h3 name="overgang">Övergångsbestämmelser</h3><br>2019:5<br>Text ett.<br>2020:12<br>Text två.'
)


def test_html_provisions(spark):
    docs = spark.createDataFrame([("d", HTML), ("none", "<p>nothing</p>")], "document_id string, html string")
    rows = segment.segment_provisions(docs).orderBy("order").collect()
    assert [(r.provision_suffix, r.label, r.chapter, r.heading) for r in rows] == [
        ("K1P1", "1 §", "1 kap. Allmänt", "Syfte"),
        ("K1P1:occurrence:2", "1 §", "1 kap. Allmänt", "Syfte"),
        ("K2P1", "1 §", "2 kap. Mer", "Syfte"),
    ]
    assert rows[0].text == "Första stycket.\nRad två.\n\nAndra stycket. Lag (2020:1)."
    assert rows[0].subsection_anchors == ["PK1P1S1"] and rows[0].amendment_notes == ["Lag (2020:1)."]
    assert rows[1].text == "Upprepad & kvar."
    later, rejects = segment.segment_transitional(docs)
    assert [(r.provision_suffix, r.order, r.text) for r in later.orderBy("order").collect()] == [
        ("overgang:2019-5", 4, "2019:5\nText ett."), ("overgang:2020-12", 5, "2020:12\nText två.")
    ]
    assert rejects.count() == 0
    bad = spark.createDataFrame([("d", '<h3 name="overgang">x</h3> inga märken')], "document_id string, html string")
    assert segment.segment_transitional(bad)[1].count() == 1


def test_numbered_sections(spark):
    text = (
        "Intro\n1.  Terms\nThe words.\nBody, and Co   Informational   [Page 1]\n\fnext\n"
        "RFC 2119   Key Words   March 1997\nMore words.\n1.2.  Inner\nInside.\n1.  Terms again\nLast body.\n"
    )
    docs = spark.createDataFrame([("rfc", text)], "document_id string, text string")
    got = {r.section: (r.title, r.text) for r in segment.segment_sections(docs).collect()}
    assert got == {"1": ("Terms again", "1.  Terms again\nLast body."), "1.2": ("Inner", "1.2.  Inner\nInside.")}


def test_requirement_reader(spark):
    old = (
        "RFC 9 Rules\nThe client MUST send\nthe header. It SHOULD NOT wait: The server MAY close.\n\n"
        'The key words "MUST" and "MAY" are quoted. Nothing here.\n'
    )
    docs = spark.createDataFrame([("a", old)], "document_id string, text string")
    rows = requirements.read_requirements(docs).orderBy("block_no", "sentence_no").collect()
    assert [(r.keyword, r.modality) for r in rows] == [("MUST", "binding"), ("SHOULD NOT", "weak"), ("MAY", "absent")]
    assert rows[0].sentence == "The client MUST send the header."
    new = spark.createDataFrame([("a", old.replace("MUST send", "SHOULD send").replace("MAY close", "OPTIONAL close"))], "document_id string, text string")
    drift = requirements.requirement_drift(requirements.read_requirements(docs), requirements.read_requirements(new)).collect()
    assert {(r.from_keyword, r.to_keyword, r.direction) for r in drift} == {
        ("MUST", "SHOULD", "loosening"), ("MAY", "OPTIONAL", "neutral")
    }
    profile = requirements.profile(requirements.read_requirements(docs)).first()
    assert (profile.requirements, profile.binding_pct) == (3, 33.3)


def test_chunks_rebuild_the_text(spark):
    blocks = "\n\n".join("x" * n for n in (900, 800, 700, 50, 1500, 10))
    df = spark.createDataFrame(
        [("a", blocks, "T", "", "H", "P1"), ("b", "short", "T", "T", "H", "P2"), ("c", "y" * 2500, "T", "C", "H", "P3"), ("d", "z", "", "", "", "")],
        "provision_id string, text string, document_title string, chapter string, heading string, label string",
    )
    chunks, rejects = gold.retrieval_chunks(df)
    got = {r.provision_id: r.reason for r in rejects.collect()}
    assert got == {"c": "block exceeds the limit", "d": "no context"}
    rows = chunks.where("provision_id = 'a'").orderBy("part").collect()
    assert "\n\n".join(r.content for r in rows) == blocks
    assert [r.content_char_count for r in rows] == [1702, 752, 1512] and rows[0].chunk_id == "a:chunk-01"
    assert all(r.retrieval_char_count <= 2000 for r in rows)
    sourced = chunks.selectExpr("*", "'s' AS source_sha256")
    kept = df.where("provision_id in ('a', 'b')")
    assert quality.check_chunks(sourced, kept).count() == 0
    with pytest.raises(quality.ContractError):
        quality.enforce(quality.check_chunks(sourced.where("part <> 2"), kept), "chunks")


def test_ordered_helpers_on_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 9}", i, i % 7) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    want = {k: n for n, k in enumerate(sorted((g, i) for g, i, _ in rows), 1)}
    assert {(r.g, r.i): r.rank for r in with_ordinal(df, ["g", "i"]).collect()} == want
    total = {}
    running = 0
    for i, v in sorted((i, v) for _, i, v in rows):
        total[i] = running
        running += v
    assert {r.i: r.running_total for r in with_running_total(df, ["i"], "v").collect()} == total
    last, before = {}, {}
    for g, i, _ in sorted(rows):
        before[(g, i)] = last.get(g)
        last[g] = i
    assert {(r.g, r.i): r.previous_i for r in with_previous(df, ["g"], ["i"], ["i"]).collect()} == before


def brute_match(targets, controls):
    left, out = list(controls), {}
    for t in sorted(targets, key=lambda r: (r[1], r[0])):
        c = min(left, key=lambda r: (abs(r[1] - t[1]), r[0]))
        left.remove(c)
        out[t[0]] = c[0]
    return out


def test_length_matching(spark):
    rng = random.Random(3)
    targets = [(f"t{i}", rng.choice([5, 5, 5, 9, 20, rng.randrange(60)])) for i in range(16)]
    controls = [(f"c{i:02d}", rng.randrange(60)) for i in range(60)]
    schema = "passage_id string, chars int"
    got = match_lengths(spark.createDataFrame(targets, schema), spark.createDataFrame(controls, schema))
    assert {r.matched_to: r.passage_id for r in got.collect()} == brute_match(targets, controls)
    with pytest.raises(ValueError):
        match_lengths(spark.createDataFrame(targets, schema), spark.createDataFrame(controls[:3], schema))


def test_xml_and_json_documents(spark):
    xml = (
        "<r><dokument><dok_id> sfs-1 </dok_id><typ>sfs</typ><subtyp>sfst</subtyp><beteckning>1:1</beteckning>"
        "<titel>Lag</titel><organ>A</organ><datum>d</datum><publicerad>p</publicerad><text> å </text>"
        "<html>&lt;p&gt; x</html></dokument></r>"
    ).encode()
    rows = [("sfs-1", xml), ("sfs-2", xml), ("sfs-3", xml + b"\xff"), ("sfs-4", b"<r></r>")]
    files = spark.createDataFrame(
        [(i, bytearray(c), "u", "p", "t") for i, c in rows],
        "expected_id string, content binary, source_data_url string, source_page_url string, retrieved_at string",
    )
    docs, rejects = envelopes.documents_from_xml(files)
    doc = docs.first()
    assert (doc.document_id, doc.text, doc.html, doc.version, doc.payload_size_bytes) == ("sfs-1", " å ", "<p> x", None, len(xml))
    assert {r.expected_id: r.reason for r in rejects.collect()} == {
        "sfs-2": "document id mismatch", "sfs-3": "not lossless UTF-8", "sfs-4": "no dokument element"
    }


def test_json_files_and_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "document_id": "a", "title": "T"\n}')
    (tmp_path / "b.json").write_text('{"document_id": "x"}')
    docs, rejects = envelopes.read_documents(spark, str(tmp_path))
    assert [r.document_id for r in docs.collect()] == ["a"] and [r.file_name for r in rejects.collect()] == ["b.json"]
    path = shared_path(spark, "pool")
    tables.write_tables({"provisions": spark.range(3)}, path)
    tables.write_tables({"provisions": spark.range(5)}, path)
    assert tables.read_table(spark, path, "provisions").count() == 5
    broken = spark.range(2).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception):
        tables.write_tables({"provisions": broken}, path)
    assert tables.read_table(spark, path, "provisions").count() == 5
    with pytest.raises(FileNotFoundError, match="candidates"):
        tables.open_tables(spark, path)


def test_stream_restart_adds_nothing_twice(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))
    schema = "document_snapshot_id string, body string"
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], schema).write.parquet(source)

    def run(place):
        stream = spark.readStream.schema(schema).parquet(source)
        stream_new_documents(stream, store, place).awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(store).select("document_snapshot_id").collect())

    assert run(checkpoint) == ["a", "b"]
    assert run(checkpoint) == ["a", "b"]
    spark.createDataFrame([("b", "2"), ("c", "1")], schema).write.mode("append").parquet(source)
    assert run(checkpoint) == ["a", "b", "c"]
    assert run(checkpoint + "-other") == ["a", "b", "c"]


def test_reader_patterns_match_as_the_plain_ones(spark):
    """The patterns that are quick to rule out find what the plain ones found, over all whitespace and line ends."""
    pieces = ["a", "A.", "B:", "(c", " ", "  ", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u180e", "MUST NOT", "xMAY", "MAY"]
    rng = random.Random(5)
    texts = ["", *pieces, *["".join(rng.choices(pieces, k=rng.randint(2, 12))) for _ in range(1500)]]
    df = spark.createDataFrame([(t,) for t in texts], "block string")
    t, words = F.col("block"), "|".join(requirements.fv.REQUIREMENT_KEYWORDS)
    pairs = {
        "lines": (F.split(t, requirements.LINE_END, -1), F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", -1)),
        "sentences": (F.split(t, UNICODE + requirements.SENTENCE_END, -1), F.split(t, UNICODE + r"(?<=[.:])\s+(?=[A-Z(])", -1)),
        "keyword": (F.regexp_extract(t, requirements.KEYWORD, 1), F.regexp_extract(t, UNICODE + rf"\b({words})\b", 1)),
        "strip": (strip(t), F.regexp_replace(t, UNICODE + r"^\s+|\s+$", "")),
        "squeeze": (squeeze(t), F.trim(F.regexp_replace(t, UNICODE + r"\s+", " "))),
    }
    for name, (quick_one, plain) in pairs.items():
        assert df.where(~quick_one.eqNullSafe(plain)).count() == 0, name
    every = spark.range(0x20, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    spaces = [r.c for r in every.where(F.col("c").rlike(UNICODE + r"^\s$")).collect()]
    assert set(spaces) | set("\t\n\x0b\x0c\r") == set(WHITESPACE)


def test_only_lines_that_may_be_page_lines_meet_the_pattern(spark):
    """Every keyword search first rules a place out by its letter, and a line without a page's signs is not searched."""
    lines = ["RFC 12 x", "RFC x", "Internet-Draft", "[Page 3]", "Body.x and [Page 3]", "body [Page 3]", "xRFC 1", "A" * 50, "", " [Page 3]"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = [r.line for r in df.where(requirements.page_line(F.col("line"))).collect()]
    assert got == [line for line in lines if re.match(requirements.fv.PAGE_LINE, line)] and len(got) == 4
    assert requirements.KEYWORD.startswith(UNICODE + "(?=[MNORS])") and requirements.LINE_END.startswith("[")
