import struct
import urllib.parse

import zstandard
from helpers import clashing, stored

from normtext.llm import warc
from normtext.llm.warc import archived, payload_digest, read_archives, record, records_of, train_dictionary, write_archives


def cases():
    rows = [(i, f"http://a.org/{i}", f"<html><body><p>page {i} with common words and markup</p>{'x' * (i % 7)}</body></html>") for i in range(120)]
    rows += [(200, None, None), (201, "u", ""), (202, "u\r\nX: y", "same"), (199, "u", "same"), (203, "ü 漢", "🙂 é"), (204, "u", "WARC/1.1\r\n\r\nbody\r\n\r\n")]
    rows += [(None, "n", "same"), (None, "n", "only nameless"), (None, "n", "only nameless"), (205, "long", "z" * 300_000), (199, "u", "same")]
    return rows


def plain(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if page_id is not None:
            first[payload] = min(first.get(payload, page_id), page_id)
    out = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        keep = first.get(payload)
        revisit = keep is not None and keep != page_id and len(payload) >= least
        out.append((page_id, len(payload), payload_digest(payload), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def pages(spark, tmp_path, rows):
    return stored(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")), tmp_path, "pages")


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    table = pages(spark, tmp_path, cases())
    assert got(archived(spark, table)) == plain(cases())
    assert got(archived(spark, table, least=100)) == plain(cases(), least=100)


def test_archives_stand_alone(spark, tmp_path, monkeypatch):
    """A leading skippable frame with the dictionary, then one frame for each record, all payloads whole."""
    folder = str(tmp_path / "archives")
    table = pages(spark, tmp_path, cases())
    listing = write_archives(table, folder).collect()
    assert sum(r.records for r in listing) == len(cases())
    payloads = []
    for r in listing:
        data = (tmp_path / "archives" / r.file).read_bytes()
        assert len(data) == r.bytes
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.SKIPPABLE_MAGIC
        trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        rest, count = data[8 + size :], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\nWARC-Type: ")
            rest, count = one.unused_data, count + 1
        assert count == r.records
        with open(tmp_path / "archives" / r.file, "rb") as stream:
            payloads += [block.partition(b"\r\n\r\n")[2] for head, block in records_of(stream) if head["WARC-Type"] == "response"]
    assert {p.decode() for p in payloads} == {html or "" for _, _, html in cases()}


def test_small_archives_and_lost_files(spark, tmp_path, monkeypatch):
    table = pages(spark, tmp_path, cases())
    folder = str(tmp_path / "a")
    listing = write_archives(table, folder)
    (tmp_path / "a" / "pages-of-a-lost-task.warc.zst").write_bytes(b"half a fra")
    assert got(read_archives(listing, folder)) == plain(cases())


def test_few_rows_need_no_dictionary(spark, tmp_path):
    rows = [(1, "u", "one"), (2, "u", None)]
    table = pages(spark, tmp_path, rows)
    assert train_dictionary(table) == b""
    assert got(archived(spark, table)) == plain(rows)
    assert archived(spark, pages(spark, tmp_path / "e", [])).collect() == []


def test_record_form():
    text = record(5, "http://a/ü", b"abc", False, None).decode()
    head, _, rest = text.partition("\r\n\r\n")
    assert head.splitlines()[0] == "WARC/1.1" and "WARC-Target-URI: http://a/ü" in head
    assert f"Content-Length: {len(rest.encode()) - 4}" in head and text.endswith("abc\r\n\r\n")
    assert urllib.parse.urlparse("urn:page:5").scheme == "urn"


def test_long_pages_train_a_dictionary(spark):
    """Where all pages are long, parts of them from all over train it; archives then begin with a skippable frame."""
    from pyspark.sql import functions as F

    from normtext.llm.warc import dictionary_frame, train_dictionary

    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2500)), lambda i: F.concat(F.lit("<p>row "), F.sha2(F.concat("id", i).cast("string"), 256).substr(1, 8), F.lit("</p>"))), "\n")
    pages = spark.range(120).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), body.alias("html"))
    assert pages.agg(F.min(F.length("html"))).first()[0] > 45_000
    dictionary = train_dictionary(pages)
    assert len(dictionary) > 10_000 and dictionary_frame(dictionary)[:4] == (0x184D2A5D).to_bytes(4, "little")
