"""Files as rows, and what kind each is."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalroom.rules import markers as M

MOST_BYTES = 256 * 1024 * 1024
#: Bytes that are looked at to tell a file's kind.
HEAD = 4096
# Directories that an audit passes over, besides those that begin with a dot.
SKIPPED = ["node_modules", "__pycache__", "venv", "dist", "build", "target"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def is_generated(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.endswith(".bak") | name.contains(".cleaned.") | name.contains(".mask.")


def in_skipped_directory(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(SKIPPED) | (d.rlike("^\\.[^.]")))


def read(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and content of the files below a path, without generated ones; the content of files over the limit is not read."""
    if not pattern or pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError(f"not a file name pattern: {pattern!r}")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.where((F.col("length") <= MOST_BYTES) & ~is_generated(F.col("path")) & ~in_skipped_directory(F.col("path"))).select("path", "length", "content")


def oversized(spark: SparkSession, path: str) -> DataFrame:
    """The files over the limit, as rows of an audit that were skipped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > MOST_BYTES)
    return rows.select("path", F.lit("error").alias("kind"), F.format_string("too large: %d bytes", "length").alias("error"))


def begins(content: Column, digits: str) -> Column:
    return F.substring(content, 1, len(digits) // 2) == F.unhex(F.lit(digits))


def image_format(content: Column) -> Column:
    """Of the first bytes: a raster format or unknown. Brands of ISO media files are read as text."""
    brands = F.decode(F.substring(content, 9, 4088), "ISO-8859-1")
    media = F.substring(content, 5, 4) == F.lit(b"ftyp")
    size = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("int")
    listed = F.left(brands, F.greatest(size - 8, F.lit(4)))
    return (
        F.when(begins(content, "89504E470D0A1A0A"), "png").when(begins(content, "FFD8"), "jpeg")
        .when(begins(content, "52494646") & (F.substring(content, 9, 4) == F.lit(b"WEBP")), "webp").when(begins(content, "424D"), "bmp")
        .when(begins(content, "474946383761") | begins(content, "474946383961"), "gif")
        .when(reduce(lambda a, b: a | b, [begins(content, d) for d in ("49492A00", "4D4D002A", "49492B00", "4D4D002B")]), "tiff")
        .when(media & listed.rlike("avif|avis|avio"), "avif").when(media & listed.rlike("heic|heix|hevc|heis|heim|hevm|hevs|mif1|msf1|heif"), "heif").otherwise("unknown")
    )


def asset_kind(path: Column, content: Column, forced: Column | None = None) -> Column:
    """text, image, container or unknown: as forced, by extension, or by the first bytes."""
    ext = extension(path)
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    low = F.lower(F.ltrim(head))
    markup = (low.startswith("<") & (F.contains(low, F.lit("svg")) | F.contains(low, F.lit("<html")))) | F.ltrim(head).startswith("<!doctype")
    prose = head.startswith("---") | F.contains(head, F.lit("\n---\n")) | F.contains(head, F.lit("# "))
    found = (
        F.when(ext.isin(M.IMAGES), "image").when(ext.isin(M.CONTAINERS), "container").when(ext.isin(M.TEXTS), "text")
        .when(image_format(content) != "unknown", "image").when(begins(content, "25504446") | begins(content, "504B") | markup | prose, "container").otherwise("unknown")
    )
    return found if forced is None else F.when(forced != "auto", forced).otherwise(found)


def binary_reason(content: Column) -> Column:
    """Why bytes aren't text, or null."""
    by_magic = reduce(lambda c, m: c.when(begins(content, m[0]), m[1]), M.MAGIC[1:], F.when(begins(content, M.MAGIC[0][0]), M.MAGIC[0][1]))
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    controls = F.regexp_count(head, F.lit("[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F]"))
    return F.when(F.length(content) == 0, None).otherwise(
        by_magic.when(F.contains(head, F.lit("\0")), "binary data (contains NUL bytes)").when(controls / F.length(head) > 0.05, "binary data (dense in control bytes)")
    )


# Kinds by content type and by suffix, in order.
TYPES = [("contains", "html", "html"), ("is", "image/png", "png"), ("is", "image/jpeg", "jpeg"), ("contains", "svg", "svg"), ("is", "application/pdf", "pdf"), ("contains", "wordprocessingml", "docx"), ("contains", "opendocument.text", "odt"), ("contains", "markdown", "markdown"), ("is", "text/plain", "text")]
SUFFIXES = [("png", "png"), ("jpg", "jpeg"), ("jpeg", "jpeg"), ("svg", "svg"), ("pdf", "pdf"), ("docx", "docx"), ("odt", "odt"), ("html", "html"), ("htm", "html"), ("md", "markdown"), ("markdown", "markdown"), ("txt", "text")]


def url_kind(url: Column, content_type: Column, body: Column) -> Column:
    """Kind of a download by content type, suffix, then first characters of its body (text)."""
    ct = F.trim(F.split_part(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    low = F.lower(F.coalesce(body, F.lit("")))
    tests = [(F.contains(ct, F.lit(x)) if how == "contains" else ct == x, k) for how, x, k in TYPES] + [(path.endswith(f".{x}"), k) for x, k in SUFFIXES]
    tests += [(low.startswith("%pdf"), "pdf"), (F.ltrim(F.left(low, F.lit(100))).startswith("<") & F.contains(F.left(low, F.lit(500)), F.lit("svg")), "svg")]
    tests += [(F.contains(F.left(low, F.lit(2000)), F.lit("<html")) | F.ltrim(F.left(low, F.lit(100))).startswith("<"), "html")]
    return reduce(lambda c, t: c.when(*t), tests[1:], F.when(*tests[0])).otherwise("text")


def origin(url: Column) -> Column:
    """scheme://host:port with the scheme's own port where none is given."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    return F.concat(scheme, F.lit("://"), host, F.lit(":"), F.when(port != "", port).when(scheme == "https", "443").otherwise("80"))


def same_origin(url: Column, base: Column) -> Column:
    """Whether url may be followed from base: the same origin, or its upgrade to https."""
    up = F.replace(F.regexp_replace(origin(base), "^http:", "https:"), F.lit(":80"), F.lit(":443"))
    return (origin(url) == origin(base)) | (origin(base).startswith("http://") & origin(base).endswith(":80") & (origin(url) == up))


def sitemap_locations(xml: Column) -> Column:
    """The addresses of a sitemap; documents with a type definition or entities give none."""
    safe = ~xml.rlike("(?i)<!DOCTYPE|<!ENTITY")
    return F.when(safe, F.transform(F.regexp_extract_all(xml, F.lit("(?is)<(?:[\\w.-]+:)?loc(?:\\s[^>]*)?>\\s*(.*?)\\s*</(?:[\\w.-]+:)?loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))).otherwise(F.array().cast("array<string>"))


MOST_SITEMAP = 50 * 1024 * 1024


def sitemaps(rows: DataFrame, most: int = MOST_SITEMAP) -> DataFrame:
    """url, kind, locations and error of sitemaps (url, content), which may be compressed by gzip; those over the limit aren't parsed."""

    def one(data: bytes | None) -> tuple:
        try:
            text = data or b""
            if text[:2] == b"\x1f\x8b":
                unpack = zlib.decompressobj(31)
                text = unpack.decompress(text, most + 1)
            if len(text) > most:
                return None, [], f"sitemap is over {most} bytes"
            if b"<!DOCTYPE" in text or b"<!ENTITY" in text:
                return None, [], "sitemap declares a document type or entities"
            root = ElementTree.fromstring(text)
        except (ElementTree.ParseError, zlib.error) as e:
            return None, [], f"not a sitemap: {e}"
        name = lambda e: e.tag.rsplit("}", 1)[-1].lower()
        return name(root), [e.text.strip() for e in root.iter() if name(e) == "loc" and e.text], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
            kinds = (pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], names=["url", "kind", "locations", "error"])

    return rows.select("url", "content").mapInArrow(run, "url string, kind string, locations array<string>, error string")


def walk_sitemaps(maps: DataFrame, root: str, max_pages: int, depth: int = 3) -> DataFrame:
    """page, depth and error of what a root sitemap leads to through indexes, in their order, at most max_pages pages.

    maps: url, kind and locations. A location of another origin is an error row and isn't followed. Each level
    is one join; the number of levels is bounded by depth.
    """
    spark = maps.sparkSession
    places = lambda df: df.select(F.concat("order", F.array("at")).alias("order"), F.col("loc").alias("url"), "kind")
    level = spark.createDataFrame([([], root)], "order array<int>, url string")
    parts, base = [], F.lit(root)
    for step in range(depth + 1):
        opened = level.join(maps.select("url", "kind", "locations"), "url").select("order", "kind", F.posexplode("locations").alias("at", "loc"))
        found = places(opened)
        parts.append(found.where("kind <> 'sitemapindex'").select("order", F.col("url").alias("page"), F.lit(step).alias("depth"), (~same_origin(F.col("url"), base)).alias("foreign")))
        inner = found.where("kind = 'sitemapindex'")
        parts.append(inner.where(~same_origin(F.col("url"), base)).select("order", F.col("url").alias("page"), F.lit(step).alias("depth"), F.lit(True).alias("foreign")))
        level = inner.where(same_origin(F.col("url"), base)).groupBy("url").agg(F.min("order").alias("order"))
    every = reduce(DataFrame.unionByName, parts).groupBy("page").agg(F.min_by(F.struct("depth", "foreign"), "order").alias("s"), F.min("order").alias("order"))
    good = every.where("not s.foreign").orderBy("order").limit(max_pages).select("page", "s.depth", F.lit(None).cast("string").alias("error"))
    bad = every.where("s.foreign").select("page", "s.depth", F.lit("cross-origin sitemap URL is not allowed").alias("error"))
    return good.unionByName(bad)


def decoded(content: Column, allow_binary: Column) -> Column:
    """Of bytes meant as text: the text, whether it was valid UTF-8, and why it is refused, if it is."""
    reason = F.when(~allow_binary, binary_reason(content))
    return F.struct(F.when(reason.isNull(), F.make_valid_utf8(content)).alias("text"), F.is_valid_utf8(content).alias("valid"), reason.alias("refused"))
