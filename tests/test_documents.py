import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.errors import Refused
from sedimenta.functions import markup, segments
from sedimenta.operators import documents

PAGE = """<html><head><title>T</title><style>x</style></head><body><h2>Big <b>news</b></h2>
<p>One &amp; <i>two</i><br>three</p><div><span>a</span><p>b</p></div><script>no</script>tail</p></body></html>"""


def test_visible_html():
    seen = markup.visible_html("<body><h2> Big  <b>news</b></h2><p>One &amp; <i>two</i><br>three é</p><div><span>a</span><p>b</p></div></body>")
    assert seen.text == "## Big news\n\nOne & twothree é\n\na\n\nb"
    assert [(k, l) for k, l, _, _ in seen.blocks] == [("heading", 2), ("paragraph", None), ("paragraph", None), ("paragraph", None)]
    raw = seen.text.encode()
    assert raw[seen.blocks[1][2] : seen.blocks[1][3]].decode() == "One & twothree é"
    source = "<body><h2> Big  <b>news</b></h2><p>One &amp; <i>two</i><br>three é</p><div><span>a</span><p>b</p></div></body>".encode()
    a, b = seen.source_range(seen.blocks[1][2], seen.blocks[1][3])
    assert source[a:b].decode() == "One &amp; <i>two</i><br>three é"
    assert seen.source_range(11, 13) is None and markup.block_at(seen, seen.blocks[2][2]) == 2


def test_text_of_an_owner_is_whole_and_hidden_parts_are_not_seen():
    seen = markup.visible_html(PAGE)
    assert "no" not in seen.text.replace("news", "") and "T" not in seen.text.split("\n")[0]
    assert markup.visible_html("<div>x<p>y</div>z").text == "xyz" or markup.visible_html("<div>x<p>y</div>z").blocks
    root, elements, visible = markup.read_html("<p>a<br/><script>bb</script></p></q>")
    assert (elements, visible) == (3, 1) and root.parts


def test_visible_xml():
    data = b"<RULE><SUBJECT>Fish\n and  <E>chips</E></SUBJECT><HD SOURCE='HED'>AGENCY:</HD><HD SOURCE='XX'>other</HD><P>Some <E>text</E> here</P></RULE>"
    seen = markup.visible_xml(data)
    assert seen.text == "# Fish and chips\n\n## AGENCY:\n\n### other\n\nSome text here"
    with pytest.raises(Refused):
        markup.visible_xml(b"<a><b></a>")


def test_paragraphs_and_records():
    text = "  one\r\n \t\r\n\n two \n\nthree\nmore\n\n\n "
    assert [text[a:b] for a, b in segments.paragraphs(text)] == ["one", "two", "three\nmore"]
    assert segments.byte_places("aé😀") == [0, 1, 3, 7]
    body = ' [ {"a": 1} , "x,]", 2.50, [1, 2] ] '
    assert [body[a:b] for a, b in segments.json_records(body)] == ['{"a": 1}', '"x,]"', "2.50", "[1, 2]"]
    assert segments.json_records(' {"a":1} ') == [(1, 8)] and segments.json_records("[]") == []
    for bad in ("[1 2]", "[1,]", "[1", "1 2", "", "[NaN]"):
        with pytest.raises(Refused):
            segments.json_records(bad)


def test_bounded_segments_keep_headings_as_context():
    text = "# A\n\n" + "w " * 10 + "\n\n## B\n\nx y z\n\nq r\n\n# C\n\n" + " ".join(f"t{i}." for i in range(50))
    out = segments.bounded(text, segments.Bounds(most=20, least=8, overlap=4))
    raw = text.encode()
    found = [(raw[a:b].decode(), h, n) for a, b, h, n in out.segments]
    assert found[0] == (("w " * 10).strip(), ("A",), 10) and found[1] == ("x y z\n\nq r", ("A", "B"), 5)
    assert all(h == ("C",) and n <= 20 for _, h, n in found[2:]) and len(found) > 4
    assert [h[2:] for h in out.headings] == [(1, "A"), (2, "B"), (1, "C")]
    c = out.coverage
    assert c["covered_bytes"] + c["excluded_bytes"] == c["representation_bytes"] and c["uncovered_bytes"] == 0 and c["duplicated_bytes"] > 0
    leaf_words = [w for t, _, _ in found[2:] for w in t.split()]
    assert set(leaf_words) == {f"t{i}." for i in range(50)}
    with pytest.raises(Refused):
        segments.Bounds(most=5, least=9)
    with pytest.raises(Refused):
        segments.bounded("abc def", segments.Bounds(1, 1, 0), count=lambda t: 5 * len(t))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#é", max_size=200), st.integers(3, 9))
def test_every_byte_is_accounted_for(text, most):
    out = segments.bounded(text, segments.Bounds(most, 2, 1), count=segments.words)
    c = out.coverage
    assert c["uncovered_bytes"] == 0 and c["covered_bytes"] + c["excluded_bytes"] == len(text.encode())
    assert all(n <= most for _, _, _, n in out.segments)


def test_interval_accounts():
    r = random.Random(1)
    for _ in range(50):
        spans = [(a, a + r.randrange(0, 9)) for a in (r.randrange(30) for _ in range(6))]
        out = [(a, a + r.randrange(0, 5)) for a in (r.randrange(40) for _ in range(3))]
        c = segments.coverage(60, spans, out)
        cells = [sum(a <= i < b for a, b in spans) for i in range(60)]
        other = [any(a <= i < b for a, b in out) for i in range(60)]
        assert c["covered_bytes"] == sum(x > 0 for x in cells) and c["duplicated_bytes"] == sum(max(0, x - 1) for x in cells)
        assert c["excluded_bytes"] == sum(o and not x for x, o in zip(cells, other, strict=True))


def test_phrases_overlap_and_stop_at_words():
    got = segments.phrase_matches("aa aa aa, Éaa aa_ AA aa", [("t", "aa aa"), ("u", "aa")])
    assert [(a, b, t) for a, b, t, _, _ in got] == [(0, 2, "u"), (0, 5, "t"), (3, 5, "u"), (3, 8, "t"), (6, 8, "u"), (19, 21, "u"), (19, 24, "t"), (22, 24, "u")]
    assert segments.phrase_matches("AA", [("u", "aa")], case_sensitive=True) == []
    with pytest.raises(Refused):
        segments.phrase_matches("a " * 30, [("u", "a")], most=9)


def test_extraction_by_media_type(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 5, 6) + b"x" * 8
    rows = [
        (1, "text/html; charset=utf-8", b"<p>a<script>b</script></p>"), (2, "application/atom+xml", b"<a><b/></a>"), (3, "application/json", b'{"a":1,"a":2}'), (4, "image/png", png), (5, "image/jpeg", jpeg),
        (6, "TEXT/plain", "é\nx".encode()), (7, "application/pdf", b"%PDF"), (8, "application/zip", b"PK"), (9, "text/plain", b"\xff"), (10, "image/gif", b"GIF"), (11, "application/json", None),
    ]
    frame = spark.createDataFrame(rows, "id int, media string, content binary")
    got = {r.id: r for r in documents.extract(frame, key="id", content="content", media="media").collect()}
    assert (got[1].elements, got[1].codepoints) == (2, 1) and (got[2].root, got[2].elements) == ("a", 2) and "repeats" in got[3].problem
    assert (got[4].width, got[4].height, got[5].width, got[5].height) == (7, 9, 6, 5) and (got[6].codepoints, got[6].lines) == (3, 2)
    assert all(got[i].problem for i in (7, 8, 9, 10, 11))


def test_segments_of_documents(spark):
    text = "# H\n\nalpha beta\n\né gamma"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, body string")
    p = documents.paragraph_segments(frame, key="id", text="body")
    assert [(r.ordinal, r.text) for r in p.orderBy("ordinal").collect()] == [(0, "# H"), (1, "alpha beta"), (2, "é gamma")]
    assert documents.unfaithful_segments(p, frame, key="id", text="body").count() == 0
    assert documents.unfaithful_segments(p.withColumn("start", p.start + 1), frame, key="id", text="body").count() == 3
    b = documents.bounded_segments(frame, key="id", text="body").collect()
    assert [(r.headings, r.text, r.tokens) for r in b] == [(["H"], "alpha beta\n\né gamma", 4)]
    assert {r.id: r.uncovered_bytes for r in documents.segment_coverage(frame, key="id", text="body").collect()} == {1: 0, 2: 0, 3: 0}
    ids = documents.segment_identity(p, "id", "para/1").collect()
    assert len({r.segment_id for r in ids}) == 3
    seen = documents.visible_text(spark.createDataFrame([(1, "<p>é</p><h1>t</h1>"), (2, "<br>")], "id int, h string"), key="id", content="h")
    assert [r.text for r in documents.visible_blocks(seen, "id").orderBy("ordinal").collect()] == ["é", "# t"] and seen.where("problem is not null").count() == 1
    records = documents.record_segments(spark.createDataFrame([(1, "[1, {}]")], "id int, t string"), key="id", text="t")
    assert [r.text for r in records.collect()] == ["1", "{}"]


def test_processors_get_permitted_fields_alone(spark):
    frame = spark.createDataFrame([(1, "a b", "hidden")], "id int, t string, x string")
    out = documents.process(frame, lambda row: [{"id": row["id"], "keys": json.dumps(sorted(row))}], allowed=["id", "t"], schema="id int, keys string")
    assert out.collect()[0]["keys"] == '["id", "t"]'
    with pytest.raises(Exception, match="contract"):
        documents.process(frame, lambda row: [{"id": 1}], allowed=["id"], schema="id int, keys string").collect()
