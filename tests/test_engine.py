"""Books packed, opened and read through the public interface."""

import random
import struct

import pytest

from quire.functions.columns import base32, decoded, from_base32
from quire.functions.uri import parse_uri
from quire.operators.library import Library, Refused, open_books
from quire.operators.text import cut_sections, filepos_targets
from quire.pack import encode as e

RAW = (
    b'<guide><reference type="toc" title="T &amp; C" filepos=0000012 /><reference title="none"/></guide><toc><tocpoint filepos="0">A</tocpoint><tocpoint filepos="42" tocdepth="1">B</tocpoint>'
    b'<tocpoint filepos="100">C</tocpoint><tocpoint>D</tocpoint></toc><mbp:pagebreak/>hello <a filepos="007">x</a> world <PAGEBREAK foo=1>end'
)
DOCS = [(b"<html><body><p>first part here</p></body></html>", [(12, 30)]), (b"<html>second &eacute; doc with text</html>", [(6, 10), (10, 20), (25, 30)]), (b"<plain/>", [])]


def books():
    out = {
        "none": e.mobi6(RAW, language=9, region=4, title=b"Tea &amp; Cake"),
        "pd": e.mobi6(RAW, e.PALMDOC, 3, resources=[b"GIF89a..", b"BMxx", e.font(b"font" * 99, b"0123456789abcdef"), b"VIDE12345678video"], ncx=e.ncx([{"label": "One", "start": 0, "level": 0}, {"label": "Two &lt;", "start": 9, "level": 1, "parent": 0}]), exth=[(100, b"Ann"), (100, b"Bob"), (503, b"old"), (503, b"Best"), (201, b"\0\0\0\1")]),
        "hc": e.mobi6(RAW, e.HUFFCDIC, nested=True),
        "win": e.mobi6(b"a \x93quoted\x94 text", codepage=1252, title=b"\x80uro"),
        "empty": e.mobi6(b""),
        "drm": e.mobi6(RAW, encryption=1),
        "junk": b"x" * 500,
        "cut": e.mobi6(RAW)[:300],
        "kf8": e.kf8(DOCS, [b"css{}", b"svg"], e.PALMDOC, resources=[b"\x89PNG\r\n\x1a\n.."], toc=[{"label": "S1", "pos": (0, 3), "level": 0}, {"label": "S2", "pos": (2, 5), "level": 0}, {"label": "bad", "pos": (99, 0), "level": 0}], guide=[(b"toc x", "Start", (3, 1))], spreads={1: "page-spread-left"}),
        "badflow": e.kf8(DOCS, drop=("fdst",), fdst=1),
        "noskel": e.kf8(DOCS, drop=("skel",)),
        "badtoc": e.mobi6(RAW, ncx=[b"INDX" + bytes(60)]),
    }
    old = e.mobi6_records(b"old half text", resources=[b"GIF87aimg"])
    out["combo"] = e.combo(old, e.kf8_records(DOCS[:1]), {"text_length": 13, "text_records": 1, "first_image": 2, "exth": [(201, b"\0\0\0\0")]})
    return out


@pytest.fixture(scope="module")
def lib(spark):
    return Library.from_bytes(spark, books())


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_status(lib):
    got = {(r["path"], r["half"]): r["status"] for r in lib.status.collect()}
    refused = {"drm": "DRM", "junk": "NotPalmDB", "cut": "Corrupt", "badflow": "Corrupt", "noskel": "Corrupt"}
    assert {k[0]: v for k, v in got.items() if v != "OK"} == refused
    assert got[("combo", "mobi6")] == got[("combo", "main")] == "OK"


def test_text(lib):
    got = {(r["path"], r["half"]): r for r in lib.raw_text.collect()}
    for p in ("none", "pd", "hc", "badtoc"):
        assert bytes(got[(p, "main")]["raw"]) == RAW
    assert got[("win", "main")]["text"] == "a “quoted” text" and got[("empty", "main")]["text"] == ""
    assert got[("combo", "mobi6")]["text"] == "old half text" and ("combo", "main") not in got


def test_sections(lib):
    cuts = [RAW.index(b"<mbp"), RAW.index(b"<PAGE"), len(RAW)]
    got = rows(lib.sections.where("path = 'none'").select("ord", "start", "end", "text"), "ord")
    assert got == [(k, a, b, RAW[a:b].decode()) for k, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False))]
    assert rows(lib.sections.where("path = 'empty'").select("start", "end", "text"), "start") == [(0, 0, "")]
    assert rows(lib.sections.where("path = 'kf8'").select("start", "text"), "ord") == [(0, d.decode()) for d, _ in DOCS]


def test_contents(lib):
    got = rows(lib.toc.where("path = 'none'").select("label", "start_byte", "parent", "depth"), "preorder")
    assert got == [("A", 0, -1, 0), ("B", 42, 0, 1), ("C", 100, -1, 0)]
    assert rows(lib.toc.where("path = 'pd'").select("label", "start_byte", "parent", "section"), "preorder") == [("One", 0, -1, -1), ("Two <", 9, 0, -1)]
    assert rows(lib.toc.where("path = 'kf8'").select("label", "section", "section_offset"), "preorder") == [("S1", 0, 15), ("S2", 1, 15), ("bad", -1, -1)]
    assert lib.toc.where("path = 'badtoc'").count() == 0
    from quire.operators.toc import toc_status

    assert {r["path"]: r["toc_status"] for r in toc_status(lib.books).collect()}["badtoc"] == "Corrupt"


def test_guide(lib):
    assert rows(lib.guide.where("path in ('none', 'kf8')").select("path", "label", "type", "href", "filepos"), "path") == [("kf8", "Start", "toc", "kindle:pos:fid:0003:off:0000000001", -1), ("none", "T & C", "toc", "", 12)]


def test_metadata(lib):
    got = {(r["path"], r["half"]): r for r in lib.metadata.collect()}
    assert got[("none", "main")]["title"] == "Tea & Cake" and got[("none", "main")]["language"] == "en-US"
    assert got[("pd", "main")]["title"] == "Best" and got[("pd", "main")]["authors"] == ["Ann", "Bob"]
    assert got[("win", "main")]["title"] == "€uro" and got[("win", "main")]["authors"] == []


def test_resources(lib):
    got = rows(lib.resources.where("path = 'pd'").select("mime", "data", "status"), "ord")
    assert [(m, bytes(d), s) for m, d, s in got] == [("image/gif", b"GIF89a..", "OK"), ("image/bmp", b"BMxx", "OK"), ("application/octet-stream", b"font" * 99, "OK"), ("application/octet-stream", b"video", "OK")]
    covers = {(r["path"], r["half"]): (r["status"], r["mime"]) for r in lib.cover.collect()}
    assert covers[("pd", "main")] == ("OK", "image/bmp") and covers[("none", "main")][0] == "NoCover" and covers[("combo", "mobi6")] == ("OK", "image/gif")


def test_kf8(lib):
    got = rows(lib.kf8_sections.where("path = 'kf8'").select("size_bytes", "linear", "page_spread"), "ord")
    assert got == [(len(DOCS[0][0]), True, ""), (len(DOCS[1][0]), True, "left"), (len(DOCS[2][0]), False, "")]
    assert [bytes(r["content"]) for r in lib.flows.where("path = 'kf8' and ord > 0").orderBy("ord").collect()] == [b"css{}", b"svg"]


def test_uris(lib, spark):
    cases = {"kindle:flow:0001?mime=text/css": ("OK", 1, 0), "kindle:flow:0009": ("RecordRange", 0, 0), "kindle:embed:0001": ("OK", 0, 0), "kindle:embed:0000": ("RecordRange", 0, 0), "kindle:pos:fid:0001:off:0000000002": ("OK", 0, 8), "kindle:pos:fid:0009:off:0000000000": ("Corrupt", 0, 0), "nope": ("NotKindleURI", 0, 0)}
    got = lib.resolve_uris(spark.createDataFrame([("kf8", u) for u in cases] + [("none", "kindle:flow:0000")], "path string, uri string")).collect()
    assert {r["uri"]: (r["status"], r["flow"], r["offset"]) for r in got if r["path"] == "kf8"} == cases
    assert [r["status"] for r in got if r["path"] == "none"] == ["Corrupt"]


def test_recindex(lib, spark):
    got = lib.resolve_recindex(spark.createDataFrame([("pd", 1), ("pd", 0), ("pd", 99)], "path string, recindex int")).collect()
    assert {r["recindex"]: (r["status"], r["mime"]) for r in got} == {1: ("OK", "image/gif"), 0: ("RecordRange", None), 99: ("RecordRange", None)}


def test_failfast_and_views(spark, lib):
    with pytest.raises(Refused):
        Library.from_bytes(spark, {"drm": e.mobi6(RAW, encryption=1)}, "FAILFAST").books  # noqa: B018
    lib.create_views("book_")
    assert spark.sql("SELECT count(*) FROM book_status").first()[0] == len(books()) + 1


def test_uri_parsing(spark):
    from pyspark.sql import functions as F

    cases = {"kindle:flow:0010?mime=text/css": ("flow", 32, 0, 0, 0, "text/css"), "kindle:embed:000B?mime=image/gif": ("embed", 0, 11, 0, 0, "image/gif"), "kindle:pos:fid:000A:off:0000000010": ("pos", 0, 0, 10, 32, "")}
    bad = ["kindle:flow:", "kindle:embed:00W1", "kindle:pos:fid:1", "filepos:123", "", "kindle:flow:0001\n", "kindle:flow:" + "V" * 14, "kindle:embed:0001?mime=", "kindle:embed:0001?mime=a?mime=b", "kindle:embed:0001?x", "kindle:flow:0001?mime=a:b", "kindle:pos:fid:0001:off:0001:", "Kindle:flow:0001", "kindle:flow:0001 ", "kindle:pos:fid:0001?mime=a:off:0"]
    got = {r["uri"]: r["u"] for r in spark.createDataFrame([(u,) for u in [*cases, *bad]], "uri string").withColumn("u", parse_uri(F.col("uri"))).collect()}
    for u, want in cases.items():
        assert tuple(got[u])[1:] == want and got[u]["status"] == "OK"
    assert all(got[u]["status"] == "NotKindleURI" for u in bad)
    t = spark.createDataFrame([(3, 256), (7, 0), (32**5, 1)], "a long, b long").select(base32(F.col("a"), 4).alias("a"), base32(F.col("b"), 10).alias("b"), from_base32(base32(F.col("a"), 4)).alias("back"))
    assert [tuple(r) for r in t.collect()] == [("0003", "0000000080", 3), ("0007", "0000000000", 7), ("100000", "0000000001", 32**5)]


def test_byte_columns(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(bytearray(range(0x80, 0xA0)),)], "b binary")
    assert t.select(decoded(F.col("b"), F.lit(1252))).first()[0] == "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
    raw = b"<mbp:pagebreak/>a\xff<pagebreak>b<x <pagebreak/>c"
    one = spark.createDataFrame([(bytearray(raw),), (bytearray(b""),)], "raw binary")
    got = [[tuple(s) for s in r[0]] for r in one.select(cut_sections(F.col("raw"))).collect()]
    assert got == [[(0, 0), (0, 18), (18, 30 + 2), (32, len(raw))], [(0, 0)]] or [b for _, b in got[0]][-1] == len(raw)
    links = spark.createDataFrame([(bytearray(b"<a filepos=\"7\"><a filepos='48'><b filepos=\"0007\"><a filepos=99999999999999999999999><a filepos=1 filepos=2>"),)], "raw binary")
    assert links.select(filepos_targets(F.col("raw"))).first()[0] == [2, 7, 48]


def test_damage_never_raises(spark):
    rng, base, cases = random.Random(5), books(), {}
    for name in ("pd", "hc", "kf8", "combo"):
        whole = base[name]
        for k in range(60):
            data = bytearray(whole)
            for _ in range(rng.randrange(1, 4)):
                data[rng.randrange(len(data))] = rng.randrange(256)
            cases[f"{name}-flip-{k}"] = bytes(data)
            cases[f"{name}-cut-{k}"] = whole[: rng.randrange(len(whole))]
    library = Library.from_bytes(spark, cases)
    got = library.status.collect()
    assert {r["path"] for r in got} == set(cases)
    assert {r["status"] for r in got} <= {"OK", "NotPalmDB", "Corrupt", "RecordRange", "DRM", "UnsupportedCompression"}
    for view in ("metadata", "toc", "guide", "resources", "cover", "sections", "filepos"):
        getattr(library, view).write.format("noop").mode("overwrite").save()


def test_container_rules(spark):
    whole = e.mobi6(b"abc")
    short = struct.pack(">H", 9999)
    cases = {
        "small": (whole[:77], "NotPalmDB"),
        "none": (whole[:76] + b"\0\0" + whole[78:], "Corrupt"),
        "table": (whole[:76] + short + whole[78:], "Corrupt"),
        "first": (whole[:78] + bytes(4) + whole[82:], "Corrupt"),
        "order": (whole[:86] + struct.pack(">I", 90) + whole[90:], "Corrupt"),
        "past": (whole[:94] + struct.pack(">I", 1 << 30) + whole[98:], "Corrupt"),
        "textread": (whole[:60] + b"TEXtREAd" + whole[68:], "OK"),
    }
    got = open_books(spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "path string, content binary")).select("path", "status").collect()
    assert {r["path"]: r["status"] for r in got} == {k: v[1] for k, v in cases.items()}


def test_native_containers_agree(spark):
    """The native table rules and those of opening give the same status, records and name, also of damaged files."""
    from quire.functions import book
    from quire.functions.codecs import Damaged
    from quire.operators.container import containers

    rng, cases = random.Random(8), {}
    for n, (name, whole) in enumerate(books().items()):
        cases[name] = whole
        for k in range(25):
            data = bytearray(whole)
            for _ in range(3):
                data[rng.randrange(min(len(data), 120))] = rng.randrange(256)
            cases[f"{name}-{k}"] = bytes(data)
    got = containers(spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")).select("path", "status", "offsets", "name").collect()
    assert len(got) == len(cases)
    for r in got:
        try:
            c = book.Container(cases[r["path"]])
            assert (r["status"], list(r["offsets"]), bytes(r["name"])) == ("OK", c.offsets, c.name)
        except Damaged as e:
            assert r["status"] == e.status


def test_bytes_that_are_no_text_stay(spark):
    """Labels, titles and text in UTF-8 are taken over unchecked."""
    bad = b"a\xff&amp;\xc3"
    raw = b'<toc><tocpoint filepos="1">' + bad + b'</tocpoint></toc><guide><reference type="\xfe" title="' + bad + b'" filepos=3></guide>'
    lib = Library.from_bytes(spark, {"x": e.mobi6(raw, exth=[(503, bad), (100, bad)])})
    want = b"a\xff&\xc3"
    from pyspark.sql import functions as F

    assert bytes(lib.toc.select(F.col("label").cast("binary")).first()[0]) == want
    assert [bytes(x) for x in lib.guide.select(F.col("label").cast("binary"), F.col("type").cast("binary")).first()] == [want, b"\xfe"]
    assert [bytes(x) for x in lib.metadata.select(F.col("title").cast("binary"), F.col("authors")[0].cast("binary")).first()] == [want, want]


def test_kept_books_give_the_same_tables(spark, lib):
    kept = Library.from_bytes(spark, books()).keep()
    try:
        for view in Library.VIEWS:
            a, b = getattr(lib, view), getattr(kept, view)
            assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), view
    finally:
        kept.release()
    assert {r["path"]: bytes(r["name"]) for r in lib.names.where("path in ('none', 'drm')").collect()} == {"none": b"book", "drm": b"book"}
    assert {(r["path"], r["half"]): r["num_resources"] for r in lib.num_resources.collect()}["pd", "main"] == 4


def test_long_contents_and_sections(spark):
    """Thousands of entries, sections and fragments in one book take time in proportion."""
    import time

    from quire.functions import book
    from quire.functions.codecs import assemble_documents

    n, start = 60_000, time.time()
    raw = b"<toc>" + b"".join(b'<tocpoint filepos="%d" tocdepth=%d>x</tocpoint>' % (k, k % 7) for k in range(n)) + b"</toc>" + b"<mbp:pagebreak/>ab" * n
    got = book.marked_toc(raw, 65001)
    assert len(got) == n and got[13]["parent"] == 12 and got[14]["parent"] == -1 and got[13]["depth"] == 6
    import re

    assert len(book.section_ends(raw, re.compile(book.PAGEBREAK))) == n + 1
    frags = [{"insert_offset": 3 + 2 * k, "length": 2, "seq": k} for k in range(n)]
    doc = assemble_documents(b"<b></b>" + b"xy" * n, 0, [{"offset": 0, "length": 7, "num_frag": n}], frags)[0]
    assert doc["content"] == b"<b>" + b"xy" * n + b"</b>" and time.time() - start < 10


def test_files_and_stream(spark, tmp_path):
    from quire.streaming.ingest import ingest

    for name, data in books().items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.mobi").write_bytes(data)
    assert Library.open(spark, str(tmp_path / "in"), glob="*.mobi").status.where("status = 'OK'").count() == len(books()) - 5 + 1
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), tables=("status", "sections")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/status")).count() == len(books()) + 1
