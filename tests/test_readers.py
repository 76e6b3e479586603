import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import companies, owner, relate
from docweave.sources import profile, readers
from docweave.tables import Tables


def png(pixels: np.ndarray, method: int = 0) -> bytes:
    height, width, step = pixels.shape
    lines = []
    for y in range(height):
        row, above = pixels[y].astype("i4"), (pixels[y - 1] if y else np.zeros_like(pixels[0])).astype("i4")
        left, corner = np.vstack([np.zeros((1, step), "i4"), row[:-1]]), np.vstack([np.zeros((1, step), "i4"), above[:-1]])
        guess = left + above - corner
        a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
        base = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))}[method]
        lines.append(bytes([method]) + ((row - base) & 255).astype("u1").tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[step], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_pictures():
    rng = np.random.default_rng(0)
    photo = rng.integers(0, 256, (20, 30, 3), dtype="u1")
    for method in range(5):
        assert (readers.png_pixels(png(photo, method)) == photo).all()
    screen = np.full((20, 60, 3), 255, "u1")
    screen[5:8, 10:12] = 0
    assert readers.looks_like_screenshot(png(screen)) and not readers.looks_like_screenshot(png(photo)) and readers.looks_like_screenshot(b"\xff\xd8 jpeg")


FILES = "id long, path string, sha256 string, kind string, status string, text_source string, text string, error string, duplicate_of long"


def test_read_with_a_cache(spark):
    screen, photo = png(np.zeros((4, 9, 1), "u1")), png(np.random.default_rng(1).integers(0, 256, (9, 9, 1), dtype="u1"))
    data = {"a.pdf": b"%PDF one", "b.pdf": b"%PDF bad", "c.png": screen, "d.png": photo, "IMG_12.jpg": b"x", "e.pdf": b"%PDF known", "f.txt": b"t"}
    kinds = {"txt": "text"}
    rows = [(n, p, f"s{n}", kinds.get(p[-3:], p[-3:]), "ok" if p == "f.txt" else "needs_ocr", None, "t" if p == "f.txt" else None, None, None) for n, p in enumerate(data)]
    files = spark.createDataFrame([*rows, (9, "copy.pdf", "s0", "pdf", "needs_ocr", None, None, None, 0)], FILES)
    contents = spark.createDataFrame(list(data.items()), "path string, content binary")

    def reader(content, kind, path):
        if b"bad" in content:
            raise ValueError("no page")
        assert b"known" not in content
        return f"text of {path}"

    cache = spark.createDataFrame([("s5", "own", "kept"), ("s0", "other", "no")], "sha256 string, backend string, text string")
    read, new = readers.read_with(files, contents, reader, "own", cache)
    got = {r.path: (r.status, r.text) for r in read.collect()}
    assert got == {
        "a.pdf": ("ok", "text of a.pdf"), "b.pdf": ("corrupt", None), "c.png": ("ok", "text of c.png"), "d.png": ("empty", None), "IMG_12.jpg": ("needs_ocr", None), "e.pdf": ("ok", "kept"),
        "f.txt": ("ok", "t"), "copy.pdf": ("needs_ocr", None),
    }
    assert {(r.sha256, r.text) for r in new.collect()} == {("s0", "text of a.pdf"), ("s2", "text of c.png"), ("s3", None)}
    assert {(r.status, r.n) for r in readers.read_stats(files).collect()} == {("ok", 1), ("needs_ocr", 7)}


def test_profiles(spark, tmp_path):
    (tmp_path / "jobs.json").write_text('{"folderPatterns": ["Customers/{company}/**"], "jobIdPattern": "JOB-\\\\d+", "owner": "Own Ltd", "documentPrefixes": {"HR": "invoice"}}')
    (tmp_path / "plain.json").write_text("{}")
    found = profile.read(spark, str(tmp_path))
    assert found["jobs"].job_id == "JOB-\\d+" and found["jobs"].options().patterns == ("Customers/{company}/**",) and found["jobs"].options("Me").owner == "Me"
    paths = spark.createDataFrame([("Customers/A/x",), ("Other/y",)], "path string")
    assert profile.chosen(paths, found).name == "jobs" and profile.chosen(paths.filter("path = 'Other/y'"), found).name == "default"
    assert profile.chosen(paths, found, asked="plain").name == "plain" and profile.chosen(paths, found, own=profile.Profile("own"), asked="plain").name == "own"


def test_both_ways_to_find_aliases_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Acme Tool Works, Acme Tools. (Acme Tool) Straße-Bau GmbH"), (2, None), (3, "xAcme Tool Acme  Tool\nAcme Tool")], "file_id long, text string")
    names = spark.createDataFrame([("Acme Tool", 1), ("Acme Tool Works", 2), ("Straße-Bau", 3), ("", 4), ("Acme Tool", 5)], "alias string, entity_id long")
    rows = lambda longest: sorted(tuple(r) for r in relate.gazetteer_mentions(texts, names, longest).select("file_id", "entity_id", "alias", F.col("start").cast("long")).collect())
    for longest in (True, False):
        monkeypatch.setattr(relate, "LOOKUP_NAMES", 100)
        few = rows(longest)
        monkeypatch.setattr(relate, "LOOKUP_NAMES", 0)
        assert few == rows(longest) and len(few) > 5


def test_a_profiles_settings_reach_the_build(spark):
    found = profile.parse("p", '{"owner": "Me Ltd", "ownerDomain": "me.com", "genericEmailDomains": ["free.example"]}')
    assert found.options().owner_domain == "me.com" and found.options("You").owner_domain is None and profile.parse("q", "{}").options().generic_domains
    with pytest.warns(UserWarning, match="legalSuffixes"):
        profile.parse("r", '{"legalSuffixes": ["ltd"]}')
    rows = [(n, 1, "company", d, "email_domain", {"domain": d}) for n, d in enumerate(("free.example", "gmail.com"))]
    mentions = spark.createDataFrame(rows, "id long, file_id long, etype string, surface string, role string, attrs map<string,string>")
    kept = companies.spellings(mentions, Tables(spark), generic=found.options().generic_domains)
    assert [r.surface for r in kept.collect()] == ["gmail.com"]
    mails = spark.createDataFrame([(n, "eml", "From: a@gmail.com\nTo: b@free.example\n\nhi") for n in range(6)], "id long, kind string, text string")
    assert owner.mail_domain(mails, found.generic_domains).first().domain == "gmail.com" and owner.mail_domain(mails).first().domain == "free.example"
