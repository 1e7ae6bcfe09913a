"""Marks inside images and document containers.

Each format has a walker that yields the places where metadata may stand, as (label, bytes), and notes about
damage; what the bytes say is judged in one place. One Arrow function applies the walkers to binary rows and
returns format, status, error, has_c2pa, has_ai and findings. A damaged file gives a status, never an
exception. A file's bytes are read where the row is; nothing is shuffled.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from signalroom.rules import markers as M

MOST_INFLATED = 8 * 1024 * 1024
MOST_ENTRIES, MOST_MEMBER, MOST_TOTAL, MOST_RATIO = 5000, 128 * 1024 * 1024, 128 * 1024 * 1024, 1000
MOST_DIRECTORIES = 4096
# TIFF tags that describe a picture, brands of ISO media files, and identifiers.
TIFF_TAGS = {269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 33432: "Copyright", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject", 700: "XMP", 33723: "IPTC/NAA", 34377: "Photoshop", 34665: "ExifIFD", 34853: "GPSInfo", 37500: "MakerNote"}
AVIF, HEIF = {b"avif", b"avis", b"avio"}, {b"heic", b"heix", b"hevc", b"heis", b"heim", b"hevm", b"hevs", b"mif1", b"msf1", b"heif"}
MANIFEST_BOXES, MANIFEST_UUID = {b"jumb", b"JUMB", b"c2pa", b"C2PA", b"cabx", b"caBX"}, bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
XMP_UUID = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
SCAN = [m.encode() for m in M.HINTS + [x for x in M.MANIFEST if x not in M.HINTS]]
STRONG = {"c2pa", "contentcredentials", "jumb", "contentauth"}


class Damaged(ValueError):
    """What is wrong with a file's structure."""


def hits(data: bytes, needles: list[bytes] = SCAN) -> list[str]:
    low = data.lower()
    return [n.decode() for n in needles if n.lower() in low]


class Report:
    def __init__(self, kind: str):
        self.kind, self.manifest, self.ai, self.findings = kind, False, False, []

    def metadata(self, label: str, data: bytes, most: int = 8) -> bool:
        found = hits(data)
        if found:
            self.ai = True
            self.manifest |= any(h.lower() in STRONG for h in found)
            self.findings.append(f"{label}: {', '.join(found[:most])}")
        return bool(found)

    def whole(self, data: bytes) -> None:
        found = hits(data, [m.encode() for m in M.MANIFEST])
        if found and not self.manifest:
            self.manifest = True
            self.findings.append(f"byte-scan C2PA markers: {', '.join(found[:6])}")


def inflate(data: bytes) -> bytes:
    unpack = zlib.decompressobj()
    out = unpack.decompress(data, MOST_INFLATED)
    if unpack.unconsumed_tail:
        raise Damaged("compressed text is over the limit")
    return out


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG, checked: IHDR first, once and of 13 bytes, IDATs in a row, an empty IEND, and none missing."""
    at, seen = 8, set()
    last = b""
    while at < len(data):
        if at + 12 > len(data):
            raise Damaged("truncated chunk header")
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data):
            raise Damaged(f"truncated chunk {kind.decode('latin-1')}")
        if zlib.crc32(data[at + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            raise Damaged(f"CRC mismatch in chunk {kind.decode('latin-1')}")
        if (not seen) != (kind == b"IHDR"):
            raise Damaged("multiple IHDR chunks" if seen else "the first chunk isn't IHDR")
        if kind == b"IHDR" and size != 13:
            raise Damaged("IHDR payload must be 13 bytes")
        if kind == b"IDAT" and kind in seen and last != kind:
            raise Damaged("IDAT chunks must be consecutive")
        if kind == b"IEND" and size:
            raise Damaged("IEND chunk must be empty")
        yield kind, data[at + 8 : end - 4]
        seen.add(kind)
        at, last = end, kind
        if kind == b"IEND":
            if b"IDAT" not in seen:
                raise Damaged("missing IDAT")
            return
    raise Damaged("missing IEND")


def png_text(kind: bytes, body: bytes) -> tuple[str, str]:
    """Keyword and text of a text chunk."""
    key, _, rest = body.partition(b"\0")
    if kind == b"zTXt":
        rest = inflate(rest[1:])
    elif kind == b"iTXt":
        packed, rest = rest[:1] == b"\1", rest[2:].split(b"\0", 2)[-1]
        rest = inflate(rest) if packed else rest
    return key.decode("latin-1"), rest.decode("utf-8" if kind == b"iTXt" else "latin-1", "replace")


def png(data: bytes, report: Report) -> None:
    try:
        for kind, body in png_chunks(data):
            name = kind.decode("latin-1")
            if kind in (b"caBX", b"juMB", b"jumb") or kind.startswith(b"c2"):
                report.manifest = True
                report.findings.append(f"PNG chunk {name} (possible C2PA container)")
            if kind in (b"tEXt", b"zTXt", b"iTXt", b"eXIf"):
                found, named = hits(body), []
                if kind != b"eXIf":
                    try:
                        key, text = png_text(kind, body)
                    except (zlib.error, Damaged):
                        key, text = "", ""
                    if key.strip().lower() in M.PRODUCT_KEYS:
                        named = [f"{key.strip()}={p}" for p in M.PRODUCTS if p.lower() in text.lower()]
                if found or named:
                    report.ai = True
                    report.manifest |= any(h.lower() in STRONG - {"contentauth"} for h in found)
                    parts = [", ".join(found[:8])] * bool(found) + [f"AI generator ({', '.join(named[:8])})"] * bool(named)
                    report.findings.append(f"PNG {name}: {'; '.join(parts)}")
    except Damaged as e:
        report.findings.append(str(e))
    report.whole(data)


def jpeg(data: bytes, report: Report) -> None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            break
        marker, at = data[at], at + 1
        if marker == 0xDA:
            break
        if marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            report.findings.append(f"bad segment length at marker 0x{marker:02X}")
            break
        if marker in (0xE1, 0xE2, 0xEB, 0xED, 0xEE):
            report.metadata(f"JPEG APP{marker - 0xE0}", data[at + 2 : at + size])
        at += size
    report.whole(data)


def webp(data: bytes, report: Report) -> None:
    at = 12
    if int.from_bytes(data[4:8], "little") + 8 != len(data):
        report.findings.append("WebP size mismatch")
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        end = at + 8 + size + (size & 1)
        if end > len(data):
            report.findings.append(f"truncated WebP chunk {kind.decode('latin-1')}")
            return
        if kind.upper() == b"C2PA":
            report.manifest = report.ai = True
            report.findings.append("WebP C2PA chunk")
        elif kind in (b"XMP ", b"EXIF"):
            report.metadata(f"WebP {kind.decode()}", data[at + 8 : at + 8 + size])
        at = end
    if at != len(data):
        report.findings.append(f"trailing WebP bytes: {len(data) - at}")


def bmp(data: bytes, report: Report) -> None:
    if len(data) < 14:
        report.findings.append("not a BMP")
        return
    size, start = struct.unpack_from("<I", data, 2)[0], struct.unpack_from("<I", data, 10)[0]
    end = size if 14 <= size <= len(data) else len(data)
    if len(data) >= 34 and struct.unpack_from("<I", data, 14)[0] >= 40:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        if packed in (0, 3):
            end = min(len(data), start + (abs(width) * bits + 31) // 32 * 4 * abs(height))
    rest = data[end:]
    if not rest:
        report.findings.append("BMP has no metadata (header-only raster format)")
    elif not report.metadata("BMP trailing metadata", rest, 6):
        report.findings.append(f"BMP has {len(rest)} unrecognized trailing byte(s)")


def gif_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of sub-blocks, and where they end."""
    parts = []
    while True:
        if at >= len(data) or at + 1 + data[at] > len(data):
            raise Damaged("")
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def gif(data: bytes, report: Report) -> None:
    at = 13 + (3 << ((data[10] & 7) + 1) if len(data) > 12 and data[10] & 128 else 0)
    what = "extension"
    try:
        while at + 1 < len(data) and data[at] != 0x3B:
            what = "extension" if data[at] == 0x21 else "image"
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = gif_blocks(data, at + 2)
                if label == 0xFE:
                    report.metadata("GIF comment", body, 6)
                elif label == 0xFF:
                    report.metadata("GIF XMP app" if body.startswith(b"XMP DataXMP") else "GIF application ext", body, 6)
            elif data[at] == 0x2C:
                if at + 10 > len(data):
                    raise Damaged("")
                _, at = gif_blocks(data, at + 11 + (3 << ((data[at + 9] & 7) + 1) if data[at + 9] & 128 else 0))
            else:
                at += 1
    except Damaged:
        report.findings.append(f"truncated GIF {what} block")
    report.whole(data)


def tiff_entries(data: bytes) -> list[tuple[int, int, bytes]]:
    """(directory, tag, bytes) of every entry of every directory, also of those that entries point to."""
    order = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    word, size, count_kind = ("Q", 20, "Q") if big else ("I", 12, "H")
    todo, seen, out = [struct.unpack_from(order + word, data, 8 if big else 4)[0]], set(), []
    widths = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
    while todo and len(seen) < MOST_DIRECTORIES:
        at = todo.pop()
        if not at or at in seen:
            continue
        seen.add(at)
        n = struct.unpack_from(order + count_kind, data, at)[0]
        first = at + (8 if big else 2)
        if first + n * size > len(data):
            raise Damaged("directory past the end")
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, data, first + k * size)
            room = 8 if big else 4
            place, length = first + (k + 1) * size - room, count * widths.get(kind, 1)
            if length > room:
                place = struct.unpack_from(order + word, data, place)[0]
            body = data[place : place + length]
            out.append((at, tag, body))
            if tag in (330, 34665, 34853, 40965) and len(body) >= widths.get(kind, 4) and kind in (4, 13, 16, 18):
                width = widths[kind]
                todo += [int.from_bytes(body[i : i + width], "little" if order == "<" else "big") for i in range(0, len(body), width)]
        after = first + n * size
        todo.append(struct.unpack_from(order + word, data, after)[0] if after + (8 if big else 4) <= len(data) else 0)
    return sorted(out, key=lambda e: e[0])


def tiff(data: bytes, report: Report) -> None:
    try:
        entries = tiff_entries(data)
    except (struct.error, Damaged):
        report.findings.append("not a valid TIFF")
        return
    for _, tag, body in entries:
        report.metadata(f"TIFF tag {tag}", body, 6)
        if tag in TIFF_TAGS:
            report.findings.append(f"TIFF {'sub-IFD' if tag in (34665, 34853, 40965) else 'tag'} {tag} ({TIFF_TAGS[tag]}) present")
    report.whole(data)
    if not report.findings:
        report.findings.append("no TIFF metadata tags found")


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Kind, start, start of the content, and end of the boxes in a range."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at, at + head, at + size
        at += size


def number(data: bytes, at: int, size: int, end: int) -> tuple[int, int]:
    if at + size > end:
        raise Damaged("a number is cut off")
    return int.from_bytes(data[at : at + size], "big"), at + size


def item_kinds(data: bytes, at: int, end: int) -> dict[int, tuple[bytes, bytes]]:
    """Kind and content type of each item of an item table."""
    version = data[at]
    _, at = number(data, at + 4, 2 if version == 0 else 4, end)
    out = {}
    for kind, _, body, stop in boxes(data, at, end):
        if kind == b"infe" and data[body] >= 2:
            item, place = number(data, body + 4, 2 if data[body] == 2 else 4, stop)
            what = data[place + 2 : place + 6]
            names = data[place + 6 : stop].split(b"\0")
            out[item] = what, names[1] if len(names) > 1 else b""
    return out


def item_extents(data: bytes, at: int, end: int) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """How each item is stored, and its ranges."""
    version = data[at]
    sizes, at = number(data, at + 4, 2, end)
    offset_size, length_size, base_size, index_size = (sizes >> s & 15 for s in (12, 8, 4, 0))
    count, at = number(data, at, 2 if version < 2 else 4, end)
    out = {}
    for _ in range(count):
        item, at = number(data, at, 2 if version < 2 else 4, end)
        method = 0
        if version:
            method, at = number(data, at, 2, end)
        _, at = number(data, at, 2, end)
        base, at = number(data, at, base_size, end)
        n, at = number(data, at, 2, end)
        ranges = []
        for _ in range(n):
            if version and index_size:
                _, at = number(data, at, index_size, end)
            offset, at = number(data, at, offset_size, end)
            length, at = number(data, at, length_size, end)
            ranges.append((base + offset, length))
        out[item] = method & 15, ranges
    return out


def heif(data: bytes, report: Report) -> None:
    size = int.from_bytes(data[:4], "big")
    names = sorted({data[i : i + 4].decode("ascii", "replace") for i in [8, *range(16, min(size, len(data)), 4)] if data[i : i + 4].strip()})
    report.findings.append(f"brands: {', '.join(names[:6])}")
    tables: dict[bytes, tuple[int, int]] = {}
    for kind, start, body, end in boxes(data, 0, len(data)):
        inner = list(boxes(data, body + 4, end)) if kind == b"meta" else []
        for k, s, b, e in [(kind, start, body, end), *inner]:
            if k in MANIFEST_BOXES or k == b"uuid" and data[b : b + 16] == MANIFEST_UUID:
                report.manifest = True
                report.findings.append(f"C2PA/JUMBF box '{k.decode('latin-1')}' at offset {s}")
            if k in (b"iinf", b"iloc"):
                tables[k] = b, e
        if kind == b"uuid":
            xmp = data[body : body + 16] == XMP_UUID
            label = f"{'XMP ' * xmp}uuid box @ {start}"
            if not report.metadata(label, data[body + 16 * xmp : end]) and xmp:
                report.findings.append(label)
    try:
        items = item_kinds(data, *tables[b"iinf"]) if b"iinf" in tables else {}
        extents = item_extents(data, *tables[b"iloc"]) if b"iloc" in tables else {}
    except (Damaged, IndexError) as e:
        report.ai = True  # what can't be read is not called clean
        report.findings.append(f"malformed HEIF metadata table: {e}")
        return
    for item, (what, content) in items.items():
        if what != b"Exif" and not (what == b"mime" and content == b"application/rdf+xml"):
            continue
        method, ranges = extents.get(item, (-2, []))
        if method:
            report.ai = True
            report.findings.append(f"unsupported external/idat metadata item {item} (method={method})")
            continue
        for offset, length in ranges:
            label = "Exif item" if what == b"Exif" else "XMP item"
            if not report.metadata(f"{label} @ {offset}", data[offset : offset + length]):
                report.findings.append(f"{label} present ({length} bytes, no AI markers)")
    if not items:
        report.findings.append("no iinf item table (or unsupported version)")
    report.whole(data)


IMAGES = {"png": png, "jpeg": jpeg, "webp": webp, "bmp": bmp, "gif": gif, "tiff": tiff, "heif": heif, "avif": heif}


def image_format(data: bytes) -> str:
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if data.startswith(b"\xff\xd8"):
        return "jpeg"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:2] == b"BM":
        return "bmp"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return "tiff"
    if data[4:8] == b"ftyp":
        end = min(int.from_bytes(data[:4], "big"), len(data), 4096)
        brands = {data[8:12], *(data[i : i + 4] for i in range(16, end, 4))}
        return "avif" if brands & AVIF else "heif" if brands & HEIF else "unknown"
    return "unknown"


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Members of an archive within the limits on number, size and ratio."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = z.infolist()
        if len(entries) > MOST_ENTRIES:
            raise Damaged("too many entries")
        if len({e.filename for e in entries}) != len(entries):
            raise Damaged("duplicate names")
        total = 0
        for e in entries:
            if e.file_size > MOST_MEMBER or e.file_size > MOST_RATIO * max(1, e.compress_size):
                raise Damaged(f"unsafe/invalid compression ratio: {e.filename}")
            with z.open(e) as f:
                body = f.read(MOST_MEMBER + 1)
            total += len(body)
            if len(body) > MOST_MEMBER or total > MOST_TOTAL:
                raise Damaged("too large when unpacked")
            yield e.filename, body


def blob(report: Report, label: str, data: bytes) -> None:
    manifest = [f"marker:{m}" for m in hits(data, [m.encode() for m in M.MANIFEST])]
    found = manifest + [f"ai:{h}" for h in hits(data, [h.encode() for h in M.HINTS if h not in M.MANIFEST])]
    if found:
        report.manifest |= bool(manifest)
        report.ai = True
        report.findings.append(f"{label}: {', '.join(found[:6])}")


MEDIA = re.compile(r"^(?:word|xl|ppt)/media/|\.(?:png|jpe?g|webp|avif|heic|gif|bmp|tiff?)$", re.I)


def archive(data: bytes, report: Report) -> None:
    try:
        parts = dict(members(data))
    except (zipfile.BadZipFile, Damaged, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
        report.findings.append(f"not a valid {report.kind} zip: {e}")
        return
    hidden = set()
    if "META-INF/encryption.xml" in parts:
        hidden = set(re.findall(r'URI="([^"]+)"', parts["META-INF/encryption.xml"].decode("utf-8", "replace")))
    for name, body in parts.items():
        kind = image_format(body)
        if name in hidden or name.endswith("/"):
            continue
        if kind in IMAGES and MEDIA.search(name):
            inner = inspect_image(body, kind)
            report.manifest, report.ai = report.manifest or inner.manifest, report.ai or inner.ai
            report.findings += [f"{name}: {f}" for f in inner.findings]
        elif report.kind in ("odt", "epub") or name.startswith(("docProps/", "customXml/")):
            blob(report, name, body)
    custom = sum(n.startswith("customXml/") for n in parts)
    if custom:
        report.findings.append(f"customXml parts: {custom}")
    if report.kind == "odt" and re.search(r"generator|claude|openai|anthropic|gemini", parts.get("meta.xml", b"").decode("utf-8", "replace"), re.I):
        report.ai = True
        report.findings.append("meta.xml generator-like fields")


def pdf(data: bytes, report: Report) -> None:
    packets = re.findall(rb"<\?xpacket begin.*?<\?xpacket end[^>]*\?>", data, re.S)
    plain = re.sub(rb"stream\r?\n.*?endstream", b"stream endstream", data, flags=re.S) + b"\n" + b"\n".join(packets)
    blob(report, "pdf-structured", plain)
    if packets:
        report.findings.append("XMP packet present")


def container_format(data: bytes) -> str:
    if data.startswith(b"%PDF"):
        return "pdf"
    if not data.startswith(b"PK"):
        return "unknown"
    try:
        names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    except (zipfile.BadZipFile, ValueError):
        return "zip"
    for kind, needs in (("docx", {"word/document.xml"}), ("xlsx", {"xl/workbook.xml"}), ("pptx", {"ppt/presentation.xml"}), ("odt", {"content.xml", "meta.xml"}), ("epub", {"META-INF/container.xml"})):
        if needs <= names:
            return kind
    return "zip"


def inspect_image(data: bytes, kind: str) -> Report:
    report = Report(kind)
    IMAGES[kind](data, report)
    return report


def inspect_bytes(data: bytes | None) -> tuple[str, str, str | None, bool, bool, list[str]]:
    """format, status, error, has_c2pa, has_ai and findings of a file."""
    if data is None:
        return "unknown", "empty", None, False, False, []
    try:
        kind = image_format(data)
        if kind in IMAGES:
            report = inspect_image(data, kind)
        else:
            report = Report(container_format(data))
            if report.kind == "unknown":
                return "unknown", "skipped", None, False, False, []
            (pdf if report.kind == "pdf" else archive)(data, report)
        return report.kind, "ok", None, report.manifest, report.ai or report.manifest, report.findings
    except (ValueError, IndexError, struct.error, MemoryError) as e:
        return "unknown", "error", str(e)[:300], False, True, []


URI = re.compile(M.DATA_URI, re.I)


def payload_of(params: str, payload: str) -> bytes | None:
    """The bytes of a data URI; none where they are corrupt."""
    if "base64" not in params.lower():
        return unquote_to_bytes(payload)
    text = "".join(payload.split())
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4))
    except ValueError:
        return None


def embedded(text: str, report: Report) -> None:
    """What the images say that a text holds as data URIs."""
    for found in URI.finditer(text):
        mime, data = found[1].lower(), payload_of(found[2] or "", found[3])
        if not data:
            continue
        kind = image_format(data)
        inner = Report(kind)
        if kind in IMAGES:
            inner = inspect_image(data, kind)
        elif "svg" in mime or data.lstrip().startswith(b"<"):
            svg(data, inner)
        else:
            blob(inner, "blob", data)
        report.manifest, report.ai = report.manifest or inner.manifest, report.ai or inner.ai or inner.manifest
        report.findings += [f"embedded data:image/{mime}: {f}" for f in inner.findings]


def svg(data: bytes, report: Report) -> None:
    """Marks in an SVG, each a finding of its own, and its metadata element."""
    found = hits(data, [m.encode() for m in M.MANIFEST])
    named = [h for h in hits(data, [h.encode() for h in M.HINTS]) if h not in M.MANIFEST]
    report.manifest, report.ai = bool(found), bool(found or named)
    report.findings += ([f"marker:{m}" for m in found] + [f"ai:{h}" for h in named])[:30]
    low = data.lower()
    if re.search(rb"<metadata[\s>]", low):
        report.findings.append("svg <metadata> present")
    if re.search(rb"xmpmeta|rdf:rdf|contentcredentials", low):
        report.findings.append("XMP/RDF-like content in SVG")


SCHEMA = "format string, status string, error string, has_c2pa boolean, has_ai boolean, findings array<string>"


def inspect(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """key and the report of every file."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time: they may be large
                row = inspect_bytes(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *[pa.array([v], t) for v, t in zip(row, kinds, strict=True)]], names=[key, *names])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, {SCHEMA}")


ROUTED = "format string, status string, error string, has_c2pa boolean, has_ai boolean, findings array<string>, text string, valid boolean"


def inspect_routed(files: DataFrame) -> DataFrame:
    """path, route, and the report of every file (path, route, content).

    Routes: ``text``, ``html``, ``markdown`` and ``svg`` files are decoded (text, and whether it was valid UTF-8)
    and only their embedded images are judged here; ``binary`` ones are judged whole; others aren't opened.
    """
    fields = [f.strip().rsplit(" ", 1) for f in ROUTED.split(", ")]
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

    def one(route: str | None, data: bytes | None) -> tuple:
        if data is None or route == "unknown":
            return (route or "unknown", "skipped" if data is None else "unknown", None, False, False, [], None, None)
        if route == "binary":
            kind, status, *rest = inspect_bytes(data)
            return (kind, "unknown" if status == "skipped" else status, *rest, None, None)
        try:
            text, valid = data.decode(), True
        except UnicodeDecodeError:
            text, valid = data.decode(errors="replace"), False
        report = Report(route)
        if route == "svg":
            svg(data, report)
        if route != "text":
            embedded(text, report)
        return (route, "ok", None, report.manifest, report.ai, report.findings, text, valid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time: they may be large
                row = one(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                arrays = [pa.array([v], kinds[t]) for v, (_, t) in zip(row, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *arrays], names=["path", "route", *[n for n, _ in fields]])

    return files.select("path", "route", "content").mapInArrow(run, f"path string, route string, {ROUTED}")
