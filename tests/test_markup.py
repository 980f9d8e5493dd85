"""The HTML reader against the standard library's parser and a plain model of siblings."""

import collections
import hashlib
import html
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from normtext.functions.markup import TOKEN, attribute, decode_references, normalize_text, tokens
from normtext.functions.markup import tidy as tidy_column
from normtext.sources import html_reader, segment

MARKS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "p", "param", "source", "track", "wbr"}


class Tree(HTMLParser):
    """A plain tree: nodes are [name, attributes, children]; texts are strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in MARKS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        if tag not in MARKS and any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.open[-1][2].append(data)


def strings(node):
    for child in node[2]:
        if isinstance(child, str):
            yield child
        else:
            yield from strings(child)


def joined(node):
    return " ".join(t for t in (s.strip() for s in strings(node)) if t)


def tidy(text):
    text = re.sub(r"[ \t\r\f\v]+", " ", text.replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def is_anchor(node):
    return node[0] == "a" and "paragraf" in (node[1].get("class") or "").split() and "name" in node[1]


def plain_provisions(source):
    tree = Tree()
    tree.feed(source)
    tree.close()
    rows, state = [], {"chapter": "", "heading": ""}
    seen = {}

    def text_of(nodes):
        parts = []
        for n in nodes:
            if isinstance(n, str):
                parts.append(n)
            elif n[0] in ("br", "p"):
                parts.append("\n" if n[0] == "br" else "\n\n")
            else:
                parts.append(" ".join(strings(n)))
        return tidy("".join(parts))

    def within(nodes, name):
        for n in nodes:
            if not isinstance(n, str):
                if n[0] == name:
                    yield n
                yield from within(n[2], name)

    def walk(node):
        for i, child in enumerate(node[2]):
            if isinstance(child, str):
                continue
            if child[0] == "h3" and re.fullmatch(r"K\d+", child[1].get("name") or ""):
                state["chapter"] = joined(child)
            if child[0] == "h4":
                state["heading"] = joined(child)
            if is_anchor(child):
                after = node[2][i + 1 :]
                stop = next((k for k, n in enumerate(after) if not isinstance(n, str) and (n[0] in ("h3", "h4") or is_anchor(n))), len(after))
                name = child[1]["name"] or ""
                seen[name] = seen.get(name, 0) + 1
                names = [n[1].get("name") or "" for n in within(after[:stop], "a")]
                rows.append((
                    name, seen[name], joined(child), state["chapter"], state["heading"], text_of(after[:stop]),
                    [n for n in names if re.fullmatch(r"P[^\s]+S\d+", n)], [joined(n) for n in within(after[:stop], "i")],
                ))
            walk(child)

    walk(tree.root)
    return rows


def random_source(rng):
    texts = ["Lag", " om ", "a < b", "&aring;", "&sect;", "&#167;", "&#xA7;", "&amp;lt;", "&nbsp;", "x &copy y", "\n", "&unknown;", "&", "&#150;", "1&thinsp;2"]
    out = []

    def some(depth):
        for _ in range(rng.randrange(1, 7)):
            kind = rng.randrange(12)
            if kind < 4 or depth > 3:
                out.append(rng.choice(texts))
            elif kind == 4:
                out.append(rng.choice(["<br>", "<p>", "</p>", "<br/>", "<p class='x > y'>", '<img alt="a>b">', "<hr>"]))
            elif kind == 5:
                out.append(rng.choice(["<!-- a > b <i>no</i> -->", "<!DOCTYPE html>", "<script>var t='</p><i>';</script>", "<style>p>i{}</style>"]))
            elif kind < 8:
                name = rng.choice(["K1P1", "K1P2", "P&auml;S", "x"])
                quoted = rng.choice(['"%s"', "'%s'"]) % name
                cls = rng.choice(['class="paragraf"', "class='bold paragraf'", 'title="a > name=z" class="paragraf"', "CLASS=paragraf", 'class="other"', ""])
                out.append(f"<a {cls} name={quoted}><b>{rng.randrange(99)} §</b></a>")
            elif kind == 8:
                out.append(rng.choice(['<h3 name="K2">Kap <b>två</b></h3>', "<h4>Rubrik &amp; mer</h4>", '<h3 name="other">x</h3>', "<h4>Rad<br>två</h4>"]))
            elif kind == 9:
                out.append(rng.choice(['<a name="PK1P1S1"></a>', "<i>Lag (2020:1).</i>", "<i>Lag <b>(2021:2)</b></i>", "<i>ett<br>två</i>"]))
            else:
                tag = rng.choice(["div", "span", "B", "section"])
                out.append(f"<{tag}>")
                some(depth + 1)
                if rng.random() < 0.85:
                    out.append(f"</{tag}>")

    for _ in range(rng.randrange(1, 8)):
        some(0)
    return "".join(out)


def test_provisions_match_a_plain_tree(spark):
    rng = random.Random(31)
    sources = [random_source(rng) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(sources)), "id int, html string").repartition(4)
    found = {}
    for r in segment.segment_provisions(table, ["id"]).orderBy("id", "order").collect():
        found.setdefault(r.id, []).append(
            (r.source_anchor, r.source_anchor_occurrence, r.label, r.chapter, r.heading, r.text, r.subsection_anchors, r.amendment_notes)
        )
    assert sum(map(len, found.values())) > 500
    for i, source in enumerate(sources):
        want = plain_provisions(source.replace("&copy y", "© y").replace("&#150;", "–"))
        assert found.get(i, []) == want, source


def test_tokens_tile_the_source(spark):
    rng = random.Random(32)
    sources = [random_source(rng) for _ in range(100)] + ["<", "<<a", "a<b>c</b", "<a href=\"x", "<!-- open", "<i =\"a>b\">c", "", "<script>never closed </p>"]
    from normtext.functions.markup import TOKEN

    cut = F.array_join(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)), "")
    rows = spark.createDataFrame([(s,) for s in sources], "t string")
    assert rows.where(cut != F.col("t")).count() == 0
    shown = rows.select("t", tokens(F.col("t")).alias("k")).collect()
    raw = [r for r in shown if r.t == "<script>never closed </p>"][0]
    assert all(k.kind != 0 for k in raw.k)


def test_references(spark):
    """All names of the standard, with and without semicolon, as the standard library decodes them."""
    from html.entities import html5

    names = sorted(html5)
    texts = [f"x&{n} y" if n.endswith(";") else f"x&{n} y" for n in names] + ["&#65;&#x42;&#67 &#x44 e", "&#128;&#150;&#129;", "&;&#;&#x;& &&amp;", "&amp;lt; &amp;amp;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    found = {r.i: r.d for r in rows.select("i", decode_references(F.col("t")).alias("d")).collect()}
    wrong = [(t, found[i], html.unescape(t)) for i, t in enumerate(texts) if found[i] != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_attributes_and_pages(spark):
    tag = "<a title='x name=\"no\" > y' data-name=z NAME = \"P&aring;1\" class=paragraf>"
    row = spark.createDataFrame([(tag,)], "t string").select(
        attribute(F.col("t"), "name").alias("name"), attribute(F.col("t"), "class").alias("cls"), attribute(F.col("t"), "href").alias("href"),
        attribute(F.col("t"), "title").alias("title"),
    ).first()
    assert tuple(row) == ("På1", "paragraf", None, 'x name="no" > y')
    page = "<html><body data-x='1 > 0'>&aring;&sect;&#167;&#xA7; &amp;lt;<br>a<b>b</b>c<p>d</p><script>if (a < b) '</p>'</script>e"
    row = spark.createDataFrame([(page,), (None,), ("",)], "t string").select(normalize_text(F.col("t")).alias("n")).collect()
    assert [r.n for r in row] == ["å§§§ &lt;\nabc\n\nde", None, ""]


def test_a_long_document(spark):
    """Twenty thousand provisions in one document: folds stay linear."""
    source = '<h4>x</h4>' + "".join(f'<a class="paragraf" name="P{i}"><b>{i} §</b></a> text {i}<br>' for i in range(20_000))
    table = spark.createDataFrame([(1, source)], "id int, html string")
    found = segment.segment_provisions(table, ["id"]).agg(F.count("*").alias("n"), F.max("order").alias("last"), F.count_if(F.expr("text = concat('text ', `order` - 1)")).alias("right")).first()
    assert tuple(found) == (20_000, 20_000, 20_000)


def test_attributes_and_references_are_searched_once(spark):
    tags = {
        """<a name="it's'">""": "it's'", "<a x='name=1' NAME = p&amp;1>": "p&1", "<a name>": "", '<a name="">': "", "<a rename=1>": None,
        "<a b=c name='\"q\"\n'>": '"q"\n', "<a name=P1/>": "P1/", "<a>": None,
    }
    rows = spark.createDataFrame([(t,) for t in tags], "tag string")
    assert {r[0]: r[1] for r in rows.select("tag", attribute(F.col("tag"), "name")).collect()} == tags
    texts = {"&#x41;&#66;;&#0;&#128;&#xD800;": "AB;\ufffd€\ufffd", "&amp;lt; &lt &nosuch; & &#; &#x;": "&lt; < &nosuch; & &#; &#x;", "&#99999999;": "\ufffd9;"}
    told = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_references(F.col("t")))
    assert {r[0]: r[1] for r in told.collect()} == texts
    # What is computed again wherever a lambda names it made a page's references cost some twenty searches each.
    assert decode_references(F.col("t"))._jc.toString().count("regexp_extract(") == 1
    assert attribute(F.col("t"), "name")._jc.toString().count("regexp_extract(") == 3


ODD = [
    "\t", "\r\n", "\x85", " ", "　", "\xa0", "  ", " \n \n \n ", "﻿", "&#xFEFF;", "&#x0;", "&#129;", "&#99999999;", "&ampfoo;", "&LT;;", "&fjlig;",
    "<", "<<", "</", "<>", "<!-->", "<!-- open", "<SCRIPT type='a>b'>x</Script >", "<script-x>q</script>", "<scriptå>w", "<ſcript>v", "<style>p</style\n>",
    "<br", "<BR/>", "</br>", "<b/>", "</b>", "</B >", "<a=\">\">", "<AÄ>", "</aä>", "<i>", "</i>", "<h4>", "</h3>", "</a>", "2020:1\x85", "<br>2020:1<br>", "<br>1999:2 x",
    "<h3 name='K1\n'>Kn</h3>", "<h3 name='K1 '>Ku</h3>", "<h3 name='K1\n\n'>Kx</h3>", "<h3 name='K١'>x</h3>", "<h3 name='&#111;vergang'>", "<h3 name=overgang>x</h3>",
    "<a class='x\tparagraf\ny' name='K1P2'>2</a>", "<a class=paragraf name>4</a>", "<a class=paragraf\x0bname=vt>vt</a>", "<a claſs=paragraf name=c>c</a>",
    "<a name='P1S2\n'></a>", "<a name='P S3'></a>", "<a name=P1S١></a>",
]


def test_plain_reader_and_column_helpers_agree(spark):
    """The tokens, references, attributes and white space of the reader are those of the column helpers, also on odd characters."""
    rng = random.Random(33)
    sources = ["".join(rng.choice(ODD) if rng.random() < 0.6 else random_source(rng) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    shown = spark.createDataFrame([(s,) for s in sources], "t string").repartition(4).select(
        "t", F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("cut"), tokens(F.col("t")).alias("k"), decode_references(F.col("t")).alias("d"),
        tidy_column(F.col("t")).alias("tidied"),
    )
    for r in shown.collect():
        read = html_reader.Statute(r.t, html_reader._Kept(html_reader._tag))
        assert html_reader.TOKEN.findall(r.t) == r.cut
        assert [(0, "") if type(e) is str else e[:2] for e in read.events] == [(k.kind, k.name) for k in r.k], r.t
        assert [html_reader.decoded(e) for e in read.events if type(e) is str] == [k.token for k in r.k if k.kind == 0], r.t
        assert (html_reader.decoded(r.t), html_reader.tidy(r.t)) == (r.d, r.tidied)
    tags = spark.createDataFrame([(t,) for t in ODD if t.startswith(("<a ", "<h3 "))], "t string")
    for r in tags.select("t", attribute(F.col("t"), "name").alias("name"), attribute(F.col("t"), "class").alias("cls")).collect():
        assert (html_reader.attribute(r.t, "name"), html_reader.attribute(r.t, "class")) == (r.name, r.cls), r.t


def test_both_kinds_from_one_reading(spark):
    rng = random.Random(34)
    closing = '<h3 name="overgang">x</h3><br>2019:5<br>One.<br>2020:12<br>Two.'
    sources = [random_source(rng) + rng.choice(["", closing, '<h3 name="overgang">x</h3>none']) for _ in range(200)]
    rows = [(i // 2 if i % 5 else None, s) for i, s in enumerate(sources)] + [(1, None), (2, ""), (3, sources[0]), (3, sources[0])]
    table = spark.createDataFrame(rows, "id int, html string").repartition(3)
    (later, rejects), paragraphs = segment.segment_transitional(table, ["id"]), segment.segment_provisions(table, ["id"])
    both = segment.segment_statutes(table, ["id"])
    assert both.schema == paragraphs.schema == later.schema and rejects.count() > 20
    assert later.count() > 20 < paragraphs.count()
    assert sorted(map(str, both.collect())) == sorted(map(str, paragraphs.unionByName(later).collect()))


def test_bytes_that_are_no_text_are_replaced(spark):
    table = spark.range(1).select("id", F.concat(F.lit('<a class="paragraf" name="P1">1</a>x'), F.unhex(F.lit("FF")).cast("string"), F.lit("y")).alias("html"))
    assert [r.text for r in segment.segment_provisions(table, ["id"]).collect()] == ["x�y"]


def test_enriched_provisions_reads_each_document_once(spark, tmp_path):
    """Paragraphs and transitional provisions come from one reading, and no text goes through the join with the documents."""
    from normtext.plans import intake

    rows = [(1, "one & two\n\nthree", "en", "s1"), (1, "again", "de", "s2"), (6, " a  b \nc", "de", None), (None, "x", "en", "s3"), (7, None, "en", "s4"), (8, "", None, "s5")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = intake.enriched_provisions(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan()
    readings = plan.toString().count("MapInArrow") + plan.toString().count("regexp_extract_all")
    assert readings == 1
    join = plan
    while join.nodeName() != "Join":
        join = join.children().head()
    assert "text#" not in join.output().mkString(" ")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    tail = "\ntail å§§§ &lt; note "
    paragraphs = {1: [["one & two", "three"], ["again"]], 6: [["a b", "c"]], None: [["x"]]}
    want = []
    for doc, texts in {**paragraphs, 8: [[]]}.items():
        lineage = [(r[3], r[2] if r[2] not in ("de", None) else None) for r in rows if r[0] == doc] if doc else [(None, None)]
        name = f"doc-{doc}" if doc else None
        for lines in texts:
            parts = [(f"P{i + 1}", f"P{i + 1}", line + tail + str(i)) for i, line in enumerate(lines)]
            if doc is None or doc % 6:  # a closing section is left out only where the number is a multiple of six
                parts += [("overgang:2020-1", "overgang", "2020:1\nFirst rule."), ("overgang:2021-22", "overgang", "2021:22\nSecond rule.")]
            for title, version in lineage:
                want += [
                    (":".join(filter(None, [name, suffix])), title, version, f"http://texts.example/{name}#{anchor}" if name else "", sha(text))
                    for suffix, anchor, text in parts
                ]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)
