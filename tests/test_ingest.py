import io
import zipfile

from docweave.sources import formats, ingest
from docweave.streaming.ingest import arriving

MAIL = b"""From: Ann Lee <ann@acme.com>
To: bob@x.org
Subject: Plan
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=q

--q
Content-Type: text/plain

Hello
--q
Content-Type: text/plain
Content-Disposition: attachment; filename="n.txt"

note
--q--
"""


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in files.items():
            archive.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def docx():
    out = io.BytesIO()
    xml = '<d xmlns:w="w"><w:body><w:p><w:t>One</w:t></w:p><w:tbl><w:tr><w:tc><w:t>a</w:t></w:tc><w:tc><w:t>b</w:t></w:tc></w:tr></w:tbl></w:body></d>'
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return out.getvalue()


def test_sniff():
    cases = {
        b"%PDF-1": "pdf", b"PKxx": "corrupt", zipped(a="x"): "zip", docx(): "docx", b"\x89PNG": "png", b"\xff\xd8\xff\xe0": "jpg", b"{\\rtf1 x}": "rtf", b"ID3": "media",
        b"a\xffb": "binary", b"BEGIN:VCARD\n": "vcf", b"BEGIN:VCALENDAR\n": "ics", MAIL: "eml", b"hello": "text",
    }
    assert {formats.sniff(data, "x.dat"): kind for data, kind in cases.items()} == {k: k for k in cases.values()}
    assert formats.sniff(b"x = 1", "a/b.py") == "code"


def test_sniff_text_of_any_length_and_encoding():
    for lead in range(4090, 4097):
        assert formats.sniff(("a" * lead + "日本é" * 50).encode(), "x.dat") == "text"
    for text in ("café", "été", "L'Haÿ-les-Roses", "Straße " * 2000):
        assert formats.sniff(text.encode("latin-1"), "x.dat") == "text" and formats.read(text.encode("latin-1"), "text")[1] == text
    assert formats.sniff(b"\x00\x01\xe9abc", "x.dat") == "binary" == formats.sniff(b"ab" + b"\xff" * 50, "x.dat")


def test_whole_texts(spark, tmp_path):
    text = "é" * 70_000 + " end"
    (tmp_path / "long.txt").write_bytes(text.encode())
    (tmp_path / "latin.txt").write_bytes("naïve".encode("latin-1"))
    rows = {r.path: (r.status, r.text) for r in ingest.ingest(spark, str(tmp_path)).collect()}
    assert rows == {"long.txt": ("ok", text), "latin.txt": ("ok", "naïve")}
    assert formats.read(text.encode(), "text", formats.TEXT_CAP)[1] == text[:60_000]


def test_read():
    assert formats.read(docx(), "docx") == ("ok", "One\na | b", None)
    assert formats.read(b"{\\rtf1 One\\par Two}", "rtf")[1] == "One\nTwo"
    assert formats.read(b"caf\xe9", "text")[1] == "café" and formats.read(b" ", "text")[0] == "empty"
    assert formats.read(MAIL, "eml")[1].startswith("From: Ann Lee <ann@acme.com>\nTo: bob@x.org\nSubject: Plan\n\nHello")
    assert formats.read(b"PK", "docx")[0] == "corrupt"


def test_ingest(spark, tmp_path):
    root = tmp_path / "data"
    (root / "Mail").mkdir(parents=True)
    (root / "skip").mkdir()
    (root / "Mail" / "a.eml").write_bytes(MAIL)
    (root / "b.zip").write_bytes(zipped(x="note\n", inner=zipped(y="deep")))
    (root / "skip" / "c.txt").write_bytes(b"note\n")
    (root / ".DS_Store").write_bytes(b"junk")
    rows = {r.path: r for r in ingest.ingest(spark, str(root), skip_directories=["skip"]).collect()}
    assert set(rows) == {"Mail/a.eml", "Mail/a.eml::n.txt", "b.zip", "b.zip::x", "b.zip::inner", "b.zip::inner::y", "skip/c.txt"}
    assert rows["Mail/a.eml::n.txt"].area == "Mail" and rows["b.zip::inner::y"].text == "deep" and rows["b.zip"].status == "container"
    assert rows["skip/c.txt"].status == "skipped" and rows["skip/c.txt"].duplicate_of == rows["b.zip::x"].id
    assert sorted(rows, key=lambda p: rows[p].id)[0] == "Mail/a.eml"


def test_arriving(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.txt").write_text("one")
    query = arriving(spark, str(root)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").count() == 1


def test_broken_members_do_not_end_the_job(spark, tmp_path):
    whole = zipped(a="first", b="second")
    at = whole.rindex(b"second")
    folder = tmp_path / "in (1) [x]+"
    folder.mkdir()
    (folder / "bad.zip").write_bytes(whole[:at] + b"sEcond" + whole[at + 6 :])
    (folder / "odd.eml").write_bytes(MAIL.replace(b'filename="n.txt"', b"filename*=utf-8''%ff%fe;;="))
    nested = zipped(x="deep")
    for _ in range(30):
        nested = zipped(n=nested)
    (folder / "deep.zip").write_bytes(nested)
    rows = ingest.ingest(spark, str(folder)).orderBy("id").collect()
    got = {r.path: r for r in rows}
    assert got["bad.zip::a"].text == "first" and got["bad.zip::b"].status == "corrupt" and "odd.eml" in got
    assert [r.id for r in rows] == list(range(1, len(rows) + 1)) and [r.path for r in rows][:3] == ["bad.zip", "bad.zip::a", "bad.zip::b"]
    assert got["bad.zip::a"].parent_id == got["bad.zip"].id and max(r.path.count("::") for r in rows) == ingest.MAX_DEPTH + 1
    last = max(rows, key=lambda r: r.path.count("::"))
    assert last.status == "corrupt" and last.error == "not opened: it lies in too many containers" and sum(r.error == last.error for r in rows) == 1
    every = ingest.ingest(spark, str(folder), max_depth=40).collect()
    assert next(r for r in every if r.path.count("::") == 31).text == "deep" and not [r for r in every if r.error and "too many" in r.error]


def test_member_names_and_repeated_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("a.txt", "one")
        archive.writestr("a.txt", "two")
    found = list(ingest._expand("z.zip", out.getvalue(), None, None, set(), 16))
    assert [(r[0], r[8]) for r in found] == [("z.zip", None), ("z.zip::a.txt", "one")]
    named = zipfile.ZipInfo("caf├⌐.txt")  # the bytes of an UTF-8 name read as CP437
    named.flag_bits = 0
    assert formats._member_name(named) == "café.txt"
