"""Media files as native byte expressions, for the queries that inspect them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little(n: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a whole number, least first, as hexadecimal digits."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])


def big(n: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a whole number, greatest first, as hexadecimal digits."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in reversed(range(size))])


def _bytes(*digits: Column | str) -> Column:
    return F.unhex(F.concat(*[F.lit(d) if isinstance(d, str) else d for d in digits]))


def _ascii(text: str) -> str:
    return text.encode("latin-1").hex()


def as_pdf(html: Column) -> Column:
    """A page that shows a text. Brackets become spaces, as the reader's operands hold none; a backslash is escaped."""
    shown = F.replace(F.translate(html, "()", "  "), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("%PDF-1.4\n/Type /Page /MediaBox [0 0 612 792] (").cast("binary"), shown.cast("binary"), F.lit(") Tj").cast("binary"))


def as_wav(raw: Column) -> Column:
    """Bytes as samples of 8 bits, 8000 a second, on one channel."""
    n = F.octet_length(raw).cast("long")
    number = lambda x, size: little(F.lit(x).cast("long"), size)
    sound = F.concat(number(1, 2), number(1, 2), number(8_000, 4), number(8_000, 4), number(1, 2), number(8, 2))
    head = F.concat(F.hex(F.lit("RIFF")), little(n + n % 2 + 36, 4), F.hex(F.lit("WAVEfmt ")), number(16, 4), sound, F.hex(F.lit("data")), little(n, 4))
    return F.concat(F.unhex(head), raw, F.unhex(F.repeat(F.lit("00"), (n % 2).cast("int"))))


def as_gif(raw: Column, width: Column) -> Column:
    """Bytes as the data blocks, of at most 255 bytes, of one frame of height 1."""
    digits, n = F.hex(raw), F.octet_length(raw)
    whole = n - n % 255
    blocks = F.regexp_replace(F.substring(digits, F.lit(1), whole * 2), "(.{510})", "FF$1")
    rest = F.when(n % 255 > 0, F.concat(little(n % 255, 1), F.substring(digits, whole * 2 + 1, F.lit(508)))).otherwise(F.lit(""))
    size = F.concat(little(width, 2), F.lit("0100"))
    return F.unhex(F.concat(F.hex(F.lit("GIF89a")), size, F.lit("0000002C00000000"), size, F.lit("0008"), blocks, rest, F.lit("003B")))


def png(w: Column, h: Column) -> Column:
    return _bytes("89504E470D0A1A0A0000000D", _ascii("IHDR"), big(w, 4), big(h, 4), "080200000000000000")


def jpeg(w: Column, h: Column, orientation: Column) -> Column:
    exif = F.concat(F.lit("FFE10022" + _ascii("Exif\0\0MM") + "002A00000008" + "0001" + "0112000300000001"), big(orientation, 2), F.lit("0000" + "00000000"))
    return _bytes("FFD8", exif, "FFC0000B08", big(h, 2), big(w, 2), "01011100FFD9")


def webp(kind: str, w: Column, h: Column) -> Column:
    size = {
        "VP8X": F.concat(F.lit("10000000"), little(w - 1, 3), little(h - 1, 3)),
        "VP8L": F.concat(F.lit("2F"), little((w - 1).cast("long") + F.shiftleft((h - 1).cast("long"), 14), 4), F.lit("0000000000")),
        "VP8 ": F.concat(F.lit("3001009D012A"), little(w, 2), little(h, 2)),
    }[kind]
    return _bytes(_ascii("RIFF") + "16000000" + _ascii("WEBP" + kind) + "0A000000", size)


def flac(samples: Column) -> Column:
    """44.1 kHz, two channels, 16 bits."""
    head = (44_100 << 44) | (1 << 41) | (15 << 36)
    return _bytes(_ascii("fLaC") + "00000022" + "00" * 10, big(F.lit(head) + samples.cast("long"), 8), "00" * 16)


def opus(ms: Column) -> Column:
    return _bytes(_ascii("OggS") + "0002", little(ms.cast("long") * 48, 8), "00" * 12 + "0113" + _ascii("OpusHead") + "0102" + "00" * 9)


def mp3(frames: Column) -> Column:
    """An ID3 tag of five bytes and frames of MPEG-1 Layer III, 128 kbit/s at 44.1 kHz."""
    return _bytes(_ascii("ID3") + "03000000000005" + "00" * 5, F.repeat(F.lit("FFFB9064" + "00" * 413), frames.cast("int")))


def m4a(scale: int, length: Column) -> Column:
    sound = _ascii("mp4a") + "00" * 16 + "0002" + "00" * 6 + "AC440000"
    return _bytes("00000014" + _ascii("ftypM4A ") + "00" * 8 + "00000000" + _ascii("mvhd") + "00" * 12, big(F.lit(scale), 4), big(length, 4), sound)


def pdf_of_images(w: Column, h: Column) -> Column:
    """Four pages: text, text and an image, an image, nothing known."""
    box = F.concat(F.lit(" /MediaBox [0 0 "), w.cast("string"), F.lit(" "), h.cast("string"), F.lit("]"))
    page = F.lit("\n/Type /Page")
    return F.concat(F.lit("%PDF-1.4"), page, box, F.lit(" (one) Tj"), page, F.lit(" (two) Tj /Subtype /Image"), page, F.lit(" /Subtype /Image"), page, box).cast("binary")


def stored_zip(*parts: tuple[str, Column]) -> Column:
    """A ZIP archive of uncompressed parts (name, text)."""
    files, directory, at = [], [], F.lit(0).cast("long")
    for name, text in parts:
        data = text.cast("binary")
        size = little(F.octet_length(data), 4)
        fields = F.concat(F.lit("1400" + "0000" * 4), little(F.crc32(data), 4), size, size, F.lit(len(name).to_bytes(2, "little").hex()))
        files.append(F.concat(F.lit("504B0304"), fields, F.lit("0000" + _ascii(name)), F.hex(data)))
        directory.append(F.concat(F.lit("504B01021400"), fields, F.lit("0000" * 4 + "00000000"), little(at, 4), F.lit(_ascii(name))))
        at = at + 30 + len(name) + F.octet_length(data)
    n, size = len(parts).to_bytes(2, "little").hex(), sum(46 + len(name) for name, _ in parts)
    return _bytes(*files, *directory, f"504B050600000000{n}{n}" + size.to_bytes(4, "little").hex(), little(at, 4), "0000")


def docx(title: Column) -> Column:
    text = F.concat(F.lit('<w:d xmlns:w="urn:w"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title '), title, F.lit("</w:t></w:r></w:p><w:p/></w:d>"))
    return stored_zip(("word/document.xml", text))


def xlsx(value: Column) -> Column:
    sheet = F.concat(F.lit('<s><c r="A1"><f>SUM(B1:B2)</f><v>'), value, F.lit('</v></c><c r="B1"/></s>'))
    return stored_zip(("xl/workbook.xml", F.lit("<w/>")), ("xl/worksheets/sheet1.xml", sheet))


def pptx(words: Column) -> Column:
    slide = lambda t: F.concat(F.lit('<s xmlns:a="urn:a"><a:t> '), t, F.lit(" </a:t></s>"))
    return stored_zip(("ppt/presentation.xml", F.lit("<w/>")), ("ppt/slides/slide1.xml", slide(words)), ("ppt/slides/slide2.xml", slide(F.lit("end"))))


def media_files(k: Column) -> dict[str, Column]:
    """A file of each kind, its sizes and lengths following a whole number."""
    w, h = k % 1_500 + 1, k % 900 + 2
    return {
        "png": png(w, h), "png-cut": F.substring(png(w, h), 1, 20), "jpeg": jpeg(w, h, k % 8 + 1), "webp-x": webp("VP8X", w, h), "webp-l": webp("VP8L", w, h), "webp-": webp("VP8 ", w, h),
        "flac": flac(k * 441 + 441), "opus": opus(k * 7 + 1), "mp3": mp3(k % 5 + 1), "m4a": m4a(600, k * 3 + 600), "pdf": pdf_of_images(w, h),
        "docx": docx(k.cast("string")), "xlsx": xlsx(k.cast("string")), "pptx": pptx(k.cast("string")),
    }
