"""Small files of every format, from fixed bytes: the input of the file audit's queries, one for each page in turn."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from base64 import b64encode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*extra: bytes, head: bytes = struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0), data: bytes = chunk(b"IDAT", zlib.compress(b"\0\0\0\0"))) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(extra) + data + chunk(b"IEND", b"")


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments) + b"\xff\xda\0\2\xff\xd9"


def webp(*chunks: tuple[bytes, bytes]) -> bytes:
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(rest: bytes = b"") -> bytes:
    return struct.pack("<2sIHHI", b"BM", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0" + rest


def gif(*extensions: tuple[int, bytes]) -> bytes:
    blocks = b"".join(b"\x21" + bytes([label, len(b)]) + b + b"\0" for label, b in extensions)
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + blocks + b"\x2c" + b"\0" * 9 + b"\2\1\0\0\x3b"


def tiff(tag: int, body: bytes) -> bytes:
    return b"MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHII", 1, tag, 2, len(body), 26) + struct.pack(">I", 0) + body


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def archive(**parts: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name.replace("__", "/").replace("_x_", "."), (2020, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


MARKED = png(chunk(b"tEXt", b"Software\0ChatGPT"))
#: Sentences of ten words each, with a phrase in most: as even and as formulaic as the score knows.
EVEN = "Moreover we delve into a rich tapestry of many things. Furthermore this plays a pivotal role in our daily work. " * 8
#: File name and bytes; none for a file that could not be read.
SAMPLES: list[tuple[str, bytes | None]] = [
    ("plain.png", png()), ("caBX.png", png(chunk(b"caBX", b"x"))), ("crc.png", png().replace(b"IDAT", b"IDAU")), ("heads.png", png(chunk(b"IHDR", b"\0" * 13))), ("idat.png", png(data=b"")),
    ("app1.jpg", jpeg((0xE1, b"trainedAlgorithmicMedia"))), ("app11.jpg", jpeg((0xEB, b"jumb c2pa"))), ("xmp.webp", webp((b"XMP ", b"SynthID"))), ("rest.bmp", bmp(b"Generated by x")), ("comment.gif", gif((0xFE, b"AIGC"))),
    ("software.tiff", tiff(305, b"OpenAI\0")), ("uuid.heic", box(b"ftyp", b"heic\0\0\0\0heic") + box(b"uuid", bytes.fromhex("d8fec3d61b0e483c92975828877ec481") + b"x")), ("brand.avif", box(b"ftyp", b"avif\0\0\0\0avif")),
    ("stream.pdf", b"%PDF-1.4\n1 0 obj\nstream\nc2pa\nendstream\n%%EOF"), ("open.pdf", b"%PDF-1.4\n/Creator (Generated by Claude)\n%%EOF"), ("body.docx", archive(word__document_x_xml=b"Claude")), ("props.docx", archive(word__document_x_xml=b"x", docProps__app_x_xml=b"Claude")),
    ("media.xlsx", archive(xl__workbook_x_xml=b"x", xl__media__image1_x_png=MARKED)), ("gen.odt", archive(content_x_xml=b"x", meta_x_xml=b"<meta:generator>x</meta:generator>")), ("book.epub", archive(**{"META-INF__container_x_xml": b"x", "a_x_xhtml": b"SynthID"})),
    ("broken.pptx", b"PK\3\4rest"), ("meta.svg", b"<svg xmlns='http://www.w3.org/2000/svg'><metadata>x</metadata></svg>"), ("note.txt", "a​b​c­d".encode()), ("plain.txt", b"nothing here"),
    ("front.md", b"---\nmodel: m\ntitle: t\n---\nwords"), ("uri.html", b"<html><img src='data:image/png;base64," + b64encode(MARKED) + b"'></html>"), ("meta.html", b"<html><meta name='generator' content='WordPress 6'></html>"),
    ("latin.txt", b"caf\xe9"), ("other.bin", b"\1\2\3"), ("lost.txt", None), ("even.txt", EVEN.encode()),
]


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page: path, length and content. SAMPLES bounds the broadcast."""
    table = spark.createDataFrame([(k, n, None if b is None else bytearray(b)) for k, (n, b) in enumerate(SAMPLES)], "k int, name string, content binary")
    pages = views.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % len(SAMPLES)).cast("int").alias("k"))
    return pages.join(F.broadcast(table), "k").select(F.concat(F.lit("f"), "page_id", F.lit("/"), "name").alias("path"), F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("length"), "content")
