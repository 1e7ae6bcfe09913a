"""Small files of each format, whole and damaged."""

import io
import struct
import zipfile
import zlib

import pytest

from signalroom.sources import files, media


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*extra):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(extra) + chunk(b"IDAT", zlib.compress(b"\0\0\0\0")) + chunk(b"IEND", b"")


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments) + b"\xff\xda\0\2\xff\xd9"


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(rest=b""):
    head = struct.pack("<2sIHHI", b"BM", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0)
    return head + b"\0\0\0\0" + rest


def gif(*extensions):
    blocks = b"".join(b"\x21" + bytes([label]) + bytes([len(b)]) + b + b"\0" for label, b in extensions)
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + blocks + b"\x2c" + b"\0" * 9 + b"\2\1\0\0\x3b"


def tiff(tag, body, order="<"):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return head + struct.pack(order + "HHHII", 1, tag, 2, len(body), 26) + struct.pack(order + "I", 0) + body


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def heif(*more, brand=b"heic"):
    return box(b"ftyp", brand + b"\0\0\0\0" + brand) + b"".join(more)


def with_item(what, content, body):
    def build(offset):
        entry = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + what + b"n\0" + content + b"\0")
        table = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 1) + entry)
        place = box(b"iloc", b"\0\0\0\0" + bytes([0x44, 0]) + struct.pack(">HHHHII", 1, 1, 0, 1, offset, len(body)))
        return box(b"meta", b"\0\0\0\0" + table + place)

    start = len(heif()) + len(build(0)) + 8
    return heif(build(start), box(b"mdat", body))


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_x_", "."), body)
    return out.getvalue()


# file, format, has_c2pa, has_ai, a part of a finding
CASES = [
    (png(), "png", False, False, None),
    (png(chunk(b"tEXt", b"Software\0ChatGPT")), "png", False, True, "AI generator (Software=ChatGPT)"),
    (png(chunk(b"tEXt", b"Comment\0a Gemini photo")), "png", False, False, None),
    (png(chunk(b"zTXt", b"parameters\0\0" + zlib.compress(b"Midjourney"))), "png", False, True, "Midjourney"),
    (png(chunk(b"iTXt", b"Creator\0\0\0\0\0Adobe Firefly")), "png", False, True, "Adobe Firefly"),
    (png(chunk(b"caBX", b"x")), "png", True, True, "possible C2PA container"),
    (png()[:-10], "png", False, False, "truncated chunk"),
    (png().replace(b"IDAT", b"IDAU"), "png", False, False, "CRC mismatch"),
    (png() + b"c2pa", "png", True, True, "byte-scan"),
    (jpeg(), "jpeg", False, False, None),
    (jpeg((0xE1, b"trainedAlgorithmicMedia")), "jpeg", False, True, "JPEG APP1"),
    (jpeg((0xEB, b"jumb c2pa")), "jpeg", True, True, "JPEG APP11"),
    (b"\xff\xd8\xff\xe1\xff\xff", "jpeg", False, False, "bad segment length"),
    (webp((b"C2PA", b"x")), "webp", True, True, "WebP C2PA chunk"),
    (webp((b"XMP ", b"SynthID")), "webp", False, True, "WebP XMP"),
    (webp((b"VP8 ", b"abc"))[:-2], "webp", False, False, "truncated WebP chunk"),
    (bmp(), "bmp", False, False, "no metadata"),
    (bmp(b"OpenAI"), "bmp", False, True, "BMP trailing metadata"),
    (bmp(b"zz"), "bmp", False, False, "2 unrecognized"),
    (gif((0xFE, b"made by Claude")), "gif", False, True, "GIF comment"),
    (gif((0xFF, b"XMP DataXMP")), "gif", False, False, None),
    (gif((0xFE, b"hi"))[:16], "gif", False, False, "truncated GIF"),
    (tiff(305, b"AIGC tool"), "tiff", False, True, "TIFF tag 305"),
    (tiff(270, b"holiday", ">"), "tiff", False, False, "ImageDescription"),
    (b"II*\0\x08\0\0\0\xff\xff", "tiff", False, False, "not a valid TIFF"),
    (heif(), "heif", False, False, "brands: heic"),
    (heif(brand=b"avif"), "avif", False, False, "brands: avif"),
    (heif(box(b"uuid", media.MANIFEST_UUID + b"x")), "heif", True, True, "C2PA/JUMBF box"),
    (with_item(b"Exif", b"", b"Anthropic"), "heif", False, True, "Exif item"),
    (with_item(b"mime", b"application/rdf+xml", b"plain"), "heif", False, False, "XMP item present"),
    (with_item(b"mime", b"text/plain", b"Claude"), "heif", False, False, None),
    (heif(box(b"meta", b"\0\0\0\0" + box(b"iloc", b"\0\0\0\0\x44\0\0\x05"))), "heif", False, True, "malformed HEIF"),
    (archive(word__document_x_xml="Claude wrote", docProps__core_x_xml="plain"), "docx", False, False, None),
    (archive(word__document_x_xml="x", docProps__core_x_xml="by OpenAI"), "docx", False, True, "docProps/core.xml"),
    (archive(xl__workbook_x_xml="x", xl__media__a_x_png=png(chunk(b"caBX", b"x"))), "xlsx", True, True, "xl/media/a.png: PNG chunk"),
    (archive(ppt__presentation_x_xml="x", customXml__a_x_xml="x"), "pptx", False, False, "customXml parts: 1"),
    (archive(content_x_xml="x", meta_x_xml="<meta:generator>X</meta:generator>"), "odt", False, True, "generator-like"),
    (archive(**{"META-INF__container_x_xml": "x", "a_x_opf": "c2pa"}), "epub", True, True, "a.opf"),
    (b"PK\x03\x04broken", "zip", False, False, "not a valid zip"),
    (b"%PDF-1.4\n1 0 obj\nstream\nClaude c2pa\nendstream\n%%EOF", "pdf", False, False, None),
    (b"%PDF-1.4\n/Producer (OpenAI)\n%%EOF", "pdf", False, True, "pdf-structured"),
    (b"plain text", "unknown", False, False, None),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_inspect(k):
    data, kind, manifest, ai, part = CASES[k]
    got = media.inspect_bytes(data)
    assert (got[0], got[3], got[4]) == (kind, manifest, ai), got
    assert part is None or any(part in f for f in got[5]), got[5]


def test_bomb_is_refused():
    data = archive(word__document_x_xml=b"\0" * 50_000_000)
    assert "compression ratio" in media.inspect_bytes(data)[5][0]


def test_on_rows(spark):
    rows = [(f"f{k}", bytearray(c[0])) for k, c in enumerate(CASES)] + [("none", None), ("nothing", bytearray())]
    found = {r.path: r for r in media.inspect(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(found) == len(rows)
    for k, (_, kind, manifest, ai, _) in enumerate(CASES):
        assert (found[f"f{k}"].format, found[f"f{k}"].has_c2pa, found[f"f{k}"].has_ai) == (kind, manifest, ai)
    assert found["none"].status == "empty"


def test_formats_agree_with_columns(spark):
    from pyspark.sql import functions as F

    rows = [(k, bytearray(c[0])) for k, c in enumerate(CASES)]
    found = spark.createDataFrame(rows, "k int, content binary").select("k", files.image_format(F.col("content"))).collect()
    for k, kind in found:
        assert kind == media.image_format(CASES[k][0])


def test_reads_a_directory(spark, tmp_path):
    for name, body in (("a.png", png()), ("b.bak", b"x"), ("sub/c.gif", gif()), (".git/d.png", png()), ("node_modules/e.png", png()), ("f.cleaned.png", png())):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = media.inspect(files.read(spark, str(tmp_path))).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.png", "c.gif"]
    with pytest.raises(ValueError, match="pattern"):
        files.read(spark, str(tmp_path), "../x")
