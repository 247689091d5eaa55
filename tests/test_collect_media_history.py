import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillcount.functions import media
from quillcount.operators import analyze as an
from quillcount.operators import history as hs
from quillcount.sources import catalog as cat
from quillcount.sources import collect as co


def wav(ms=1_000):
    data = b"\0" * (8 * ms)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8_000, 8_000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data


def png(w, h):
    body = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml"), x)
    return out.getvalue()


def test_headers():
    assert media.inspect(png(385, 769))["image"] == {"width": 385, "height": 769, "orientation": 0, "frames": 1}
    assert media.inspect(wav())["audio"] == {"duration_ms": 1_000, "codec": "wav", "sample_rate_hz": 8_000, "channels": 1}
    gif = b"GIF89a" + struct.pack("<HHBBB", 5, 6, 0, 0, 0) + (b",\0\0\0\0\1\0\1\0\0\2\1x\0" * 2) + b";"
    assert media.inspect(gif)["image"]["frames"] == 2 and media.inspect(gif)["warnings"]
    assert media.inspect(gif[:20])["error"]
    flac = b"fLaC" + b"\0" * 14 + ((44_100 << 44) | (1 << 41) | 88_200).to_bytes(8, "big") + b"\0" * 16
    assert media.inspect(flac)["audio"]["duration_ms"] == 2_000
    assert media.inspect(b"plain text")["mime"] == "" and media.inspect(None)["mime"] == ""
    assert media.inspect(b"\xff\xf1")["mime"] == "audio/mpeg"
    frame = b"\xff\xfb\x90\x00" + b"\0" * 413
    assert media.inspect(frame * 3)["audio"]["codec"] == "mp3" and media.inspect(frame * 3)["audio"]["duration_ms"] == 3 * 1152 * 1000 // 44_100
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + b"\0" * 4
    assert media.inspect(webp)["image"]["width"] == 100 and media.inspect(webp)["image"]["height"] == 50
    mp4 = b"\0\0\0\x18ftypM4A " + b"\0" * 8 + b"mvhd" + b"\0" * 12 + struct.pack(">II", 1_000, 2_500)
    assert media.inspect(mp4)["audio"]["duration_ms"] == 2_500
    ogg = b"OggS\0\0" + struct.pack("<Q", 96_000) + b"\0" * 13 + b"OpusHead\1\2" + b"\0" * 10
    assert media.inspect(ogg)["audio"] == {"duration_ms": 2_000, "codec": "opus", "sample_rate_hz": 48_000, "channels": 2}


def test_jpeg_orientation():
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x112, 3, 1, 6, 0)
    exif = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 20, 10, 1)
    assert media.inspect(jpeg)["image"] == {"width": 20, "height": 10, "orientation": 6, "frames": 1}


def test_documents():
    pdf = media.inspect(b"%PDF-1.4 /Type /Page /MediaBox [0 0 612 792] (hello pdf) Tj")
    assert "hello pdf" in pdf["text"] and pdf["document"]["pages"] == 1 and pdf["document"]["page_meta"][0]["classification"] == "text-bearing"
    assert media.inspect(b"%PDF-1.4 /Encrypt")["error"]
    packed = b"%PDF-1.4 /FlateDecode >> stream\n" + zlib.compress(b"(deep \\(x) Tj") + b"\nendstream"
    assert "deep" not in media.inspect(packed[:60])["text"]
    ns = 'xmlns:w="urn:w"'
    docx = zipped(word__document_xml=f'<w:d {ns}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p></w:d>')
    assert "[Heading1] Title" in media.inspect(docx)["text"]
    xlsx = zipped(xl__workbook_xml="<w/>", xl__worksheets__sheet1_xml='<s><c r="A1"><f>SUM(B1:B2)</f><v>3</v></c></s>')
    assert "A1 formula=SUM(B1:B2) cached=3" in media.inspect(xlsx)["text"]
    pptx = zipped(ppt__presentation_xml="<w/>", ppt__slides__slide1_xml='<s xmlns:a="urn:a"><a:t> hi </a:t></s>')
    got = media.inspect(pptx)
    assert got["text"] == "[slide 1]\nhi\n" and got["document"]["pages"] == 1
    assert media.inspect(zipped(word__document_xml="<broken"))["error"]


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / ".quillignore").write_text("ignored.txt\n")
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\r")
    (tmp_path / "z.go").write_text("package z\n")
    (tmp_path / "ignored.txt").write_text("x")
    (tmp_path / "gen.go").write_text("// Code generated by t. DO NOT EDIT.\n")
    (tmp_path / "bin").write_bytes(b"a\0b")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "v.txt").write_text("v")
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    return tmp_path


def test_collect_tree(spark, tree):
    sources, warnings = co.collect(spark, str(tree))
    rows = sources.collect()
    assert [r.label for r in rows] == [".quillignore", "a.txt", "z.go"] and rows[1].text == "one\ntwo\n" and rows[1].bytes == 8
    assert sorted(w.warning for w in warnings.collect()) == ["skip binary: bin", "skip generated: gen.go"]


def test_collect_media_prompt_and_missing(spark, tree):
    (tree / "s.wav").write_bytes(wav())
    (tree / "p.jpg").write_bytes(png(3, 4))
    (tree / "t.txt").write_text("spoken")
    sources, warnings = co.collect(spark, str(tree), ["s.wav", "p.jpg", "none", "link"], prompt="hi\r\n", transcripts={"s.wav": "t.txt"})
    got = {r.label: r for r in sources.collect()}
    assert set(got) == {"s.wav", "p.jpg", "prompt"} and got["s.wav"].text == "spoken" and got["prompt"].text == "hi\n"
    said = [w.warning for w in warnings.collect()]
    assert any("extension suggests" in w for w in said) and any("skip none" in w for w in said) and any("symlink" in w for w in said)
    with pytest.raises(ValueError):
        co.collect(spark, str(tree), ["a.txt"], transcripts={"x.wav": "t.txt"})
    with pytest.raises(FileNotFoundError):
        co.collect(spark, str(tree), ["*.nope"])


def test_limits_skip_and_go_on(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text("1234")
    sources, warnings = co.collect(spark, str(tmp_path), limits=co.Limits(total=7))
    assert [r.label for r in sources.collect()] == ["a.txt"] and warnings.count() == 2
    assert all(w.incomplete for w in warnings.collect())


def test_ignore_rules():
    rules = co.ignore_rules("*.log\n/root\nkeep/\n!keep/x\n# c\n\ndeep/**/y\n")
    assert co.ignored("a/b.log", rules) and co.ignored("root", rules) and not co.ignored("a/root", rules)
    assert co.ignored("keep/z", rules) and not co.ignored("keep/x", rules) and co.ignored("q/deep/1/2/y", rules)


@pytest.fixture()
def analysed(spark):
    def run(texts, request):
        df = spark.createDataFrame(texts, "l string, t string")
        src = an.text_sources(df, F.lit(request), F.col("l"), F.col("t"))
        return hs.runs_of(an.analyze(src, cat.models(spark, cat.default_catalog(), ["sonnet"]), an.Options(output_tokens=(1, 2, 3))), src, F.lit("2026-01-01 00:00:00"), "v1")

    return run


def test_history_round_trip(spark, tmp_path, analysed):
    path = str(tmp_path / "runs")
    hs.save(analysed([("a", "secret words"), ("b", "same")], "r1"), path)
    hs.save(analysed([("a", "other words now"), ("b", "same"), ("c", "new")], "r2"), path)
    with pytest.raises(ValueError):
        hs.save(analysed([("a", "x")], "r1"), path)
    runs = hs.load(spark, path)
    assert hs.leaks(runs).isEmpty() and not runs.where("payload like '%secret%'").count()
    assert [r.id for r in hs.latest(runs, 0).collect()] == ["r2", "r1"]
    models, parts, sources = hs.diff(hs.get(runs, "r1"), hs.get(runs, "r2"))
    assert models.first().token_delta > 0 and parts.count() == 1
    assert {(r.source, r.change) for r in sources.collect()} == {("a", "changed"), ("c", "added")}


def test_old_payloads_stay_readable(spark):
    df = spark.createDataFrame([("x", '{"schema":"v1","results":[{"model":"m"}]}')], "id string, payload string")
    r = hs.get(df, "x").first().run
    assert r.results[0].model == "m" and r.results[0].input_tokens is None
