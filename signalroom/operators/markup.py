"""Findings in HTML, Markdown, SVG and other text containers, as columns; and the images their data URIs hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalroom.functions.text import let
from signalroom.operators.findings import any_of
from signalroom.rules import markers as M


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def attribute(tag: Column, name: str) -> Column:
    """The last value of an attribute, or null; an empty value counts as none."""
    pairs = F.arrays_zip(every(tag, "(?i)" + M.ATTRIBUTE, 1).alias("k"), every(tag, "(?i)" + M.ATTRIBUTE, 2).alias("v"))
    values = F.filter(pairs, lambda p: F.lower(p["k"]) == name)
    return F.when(F.size(values) > 0, F.nullif(F.element_at(values, -1)["v"], F.lit("")))


def is_site_generator(tag: Column) -> Column:
    """Whether a meta tag names the site's software and no maker of generated text."""
    named = F.lower(F.coalesce(attribute(tag, "name"), attribute(tag, "property"), attribute(tag, "generator"), F.lit("")))
    return (named == "generator") & ~tag.rlike("(?i)" + M.MAKERS)


def html_findings(html: Column) -> Column:
    """Findings of a page, in order: meta tags, JSON-LD blocks, data attributes."""
    tags = every(html, "(?i)<meta\\b[^>]*>")
    of_tag = lambda t: F.when(is_site_generator(t), F.concat(F.lit("info: cms generator: "), F.left(t, F.lit(120)))).when(t.rlike("(?i)" + M.NAMES + "|" + M.TAG_HINTS), F.concat(F.lit("meta: "), F.left(t, F.lit(120))))
    blocks = every(html, "(?is)<script\\b[^>]*application/ld\\+json[^>]*>.*?</script>")
    of_block = F.transform(F.filter(blocks, lambda b: b.rlike("(?i)" + M.NAMES + "|DigitalSourceType|trainedAlgorithmicMedia|SoftwareAgent")), lambda b: F.lit("json-ld provenance-like block"))
    attrs = F.transform(every(html, "(?i)\\bdata-ai[\\w-]*\\s*=\\s*[\"'][^\"']*[\"']"), lambda a: F.concat(F.lit("attr: "), F.left(a, F.lit(80))))
    return F.concat(F.filter(F.transform(tags, of_tag), lambda f: f.isNotNull()), of_block, attrs)


def html_has_manifest(html: Column) -> Column:
    tags = F.exists(every(html, "(?i)<meta\\b[^>]*>"), lambda t: t.rlike("(?i)c2pa|content.?credential"))
    blocks = every(html, "(?is)<script\\b[^>]*application/ld\\+json[^>]*>.*?</script>")
    return tags | F.exists(blocks, lambda b: b.rlike("(?i)" + M.NAMES + "|DigitalSourceType|trainedAlgorithmicMedia|SoftwareAgent") & b.rlike("(?i)c2pa|contentcredential"))


def front_lines(text: Column) -> Column:
    """Top-level lines of a front matter that name a key."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)\\A---\\r?\\n(.*?)\\r?\\n---\\r?\\n?", 1)
    return F.filter(F.split(block, "\\r?\\n"), lambda x: x.rlike("^[A-Za-z0-9_.][A-Za-z0-9_.-]*\\s*:"))


def front_findings(text: Column) -> Column:
    key = lambda x: F.regexp_extract(x, "^([A-Za-z0-9_.-]+)", 1)
    value = lambda x: F.regexp_extract(x, "(?s)^[^:]*:(.*)", 1)
    by_key = lambda x: F.when(F.lower(key(x)).isin(M.FRONT_KEYS) | key(x).rlike("(?i)" + M.NAMES), F.concat(F.lit("frontmatter key: "), key(x)))
    by_value = lambda x: F.when(value(x).rlike("(?i)" + M.NAMES), F.concat(F.lit("frontmatter value hit on "), key(x)))
    return let(front_lines(text), lambda lines: F.filter(F.flatten(F.transform(lines, lambda x: F.array(by_key(x), by_value(x)))), lambda f: f.isNotNull()))


def blob_hits(text: Column) -> Column:
    """``marker:`` and ``ai:`` labels of a text or of bytes read as Latin-1; at most 30."""
    low = F.lower(text)
    marks = [F.when(F.contains(low, F.lit(m.lower())), F.lit(f"marker:{m}")) for m in M.MANIFEST]
    hints = [F.when(F.contains(low, F.lit(h.lower())), F.lit(f"ai:{h}")) for h in M.HINTS if h not in M.MANIFEST]
    return F.slice(F.filter(F.array(*marks, *hints), lambda f: f.isNotNull()), 1, 30)


def svg_findings(svg: Column) -> Column:
    more = [F.when(svg.rlike("(?i)<metadata[\\s>]"), F.lit("svg <metadata> present")), F.when(svg.rlike("(?i)xmpmeta|rdf:RDF|contentcredentials"), F.lit("XMP/RDF-like content in SVG"))]
    return F.concat(blob_hits(svg), F.filter(F.array(*more), lambda f: f.isNotNull()))


def pdf_findings(latin: Column) -> Column:
    """Of a PDF's bytes read as Latin-1: marks outside streams and in XMP packets."""
    packets = every(latin, "(?s)<\\?xpacket begin.*?<\\?xpacket end[^>]*\\?>")
    plain = F.concat(F.regexp_replace(latin, "(?s)stream\\r?\\n.*?endstream", "stream endstream"), F.lit("\n"), F.array_join(packets, "\n"))
    hits = F.transform(blob_hits(plain), lambda h: F.concat(F.lit("pdf-structured:"), h))
    return F.concat(hits, F.when(F.size(packets) > 0, F.array(F.lit("XMP packet present"))).otherwise(F.array().cast("array<string>")))


def percent_decoded(text: Column) -> Column:
    """The bytes of a text of ASCII letters in which %XX stands for a byte; other percent signs and plus signs stay."""
    raw = lambda x: F.hex(F.encode(x, "UTF-8"))
    piece = lambda x, i: F.when(i == 0, raw(x)).when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.left(x, F.lit(2)), raw(F.substring(x, 3, F.length(x))))).otherwise(raw(F.concat(F.lit("%"), x)))
    return F.unhex(F.array_join(F.transform(F.split(text, "%"), piece), ""))


def base64_decoded(text: Column) -> Column:
    """The bytes of Base64 text with or without its padding; null where a letter is left over."""
    letters = F.regexp_replace(text, "[^A-Za-z0-9+/]", "")
    return F.when(F.length(letters) % 4 != 1, F.unbase64(letters))


def data_uris(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, mime and payload of every image that a text holds as a data URI; null for a corrupt one."""
    found = rows.select(key, F.posexplode(every(F.col(text), "(?i)" + M.DATA_URI)).alias("place", "uri"))
    body = F.regexp_extract("uri", "(?is)^[^,]*,(.*)$", 1)
    base64 = F.regexp_extract("uri", "(?i)" + M.DATA_URI, 2).rlike("(?i)base64")
    payload = F.when(base64, base64_decoded(body)).otherwise(percent_decoded(body))
    return found.select(key, "place", F.lower(F.regexp_extract("uri", "(?i)" + M.DATA_URI, 1)).alias("mime"), payload.alias("payload"))


def windows_after(text: Column, mark: str, before: int = 256, after: int = 4096) -> Column:
    """The surroundings of every place of a mark, whatever its case; they may overlap."""
    sizes = F.transform(F.split(F.lower(text), mark.replace(".", "\\.")), lambda x: F.length(x))
    n = F.size(sizes) - 1
    at = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(mark)
    window = lambda i: let(at(i), lambda k: F.substring(text, F.greatest(k - before, F.lit(0)) + 1, k + after - F.greatest(k - before, F.lit(0))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), window)).otherwise(F.array().cast("array<string>"))


def soft_binding(latin: Column) -> Column:
    """Of bytes read as Latin-1: whether a manifest is bound remotely, with structured labels and addresses near a mark.

    Each place of a mark has a window of its own. Labels count as marks only where they are structured.
    """
    labels = F.array_sort(F.array_distinct(F.transform(every(latin, "(?i)" + M.BINDING_LABEL, 1), lambda x: F.lower(x))))
    manifest = any_of(F.lower(latin), [m.lower() for m in M.MANIFEST])

    def of(told: Column) -> Column:
        near = [windows_after(latin, m) for m in M.BINDING]
        near += [F.when(F.array_contains(told, m), windows_after(latin, m)).otherwise(F.array().cast("array<string>")) for m in M.LABELS if m not in M.BINDING]
        urls = F.flatten(F.transform(F.concat(*near), lambda w: every(w, "https?://[^\\s\"'<>\\\\)\\]]+")))
        kept = F.slice(F.array_sort(F.array_distinct(F.filter(urls, lambda u: u.rlike("(?i)manifest|credential|c2pa|contentauth|verify")))), 1, 20)
        return let(kept, lambda u: F.struct(manifest.alias("has_c2pa"), (manifest & (F.size(told) + F.size(u) > 0)).alias("found"), told.alias("labels"), u.alias("urls")))

    return let(labels, of)
