"""Marks of provenance and of formats."""

from __future__ import annotations

# Strings that point to a provenance manifest, and to generated media.
MANIFEST = ["c2pa", "jumb", "c2ma", "contentcredentials", "contentauth", "cai:", "http://ns.adobe.com/xmp/InstanceID/"]
HINTS = [
    "c2pa", "contentcredentials", "digitalSourceType", "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia",
    "AIGC", "AI generated", "Generated by", "Claude", "Anthropic", "OpenAI", "SynthID", "dcterms:provenance",
]
# Product names, looked for only where a file names its software.
PRODUCTS = [
    "ChatGPT", "DALL-E", "Midjourney", "Stable Diffusion", "SDXL", "FLUX", "DreamStudio", "Leonardo AI", "Leonardo.Ai", "Craiyon", "NovelAI",
    "Ideogram", "TensorArt", "Recraft", "Clipdrop", "DeepAI", "NightCafe", "Bing Image Creator", "Adobe Firefly", "Firefly", "Gemini", "Imagen",
    "Grok", "Sora", "Veo", "Kling", "Runway", "Luma", "Qwen", "GPT-4", "GPT-5",
]
PRODUCT_KEYS = ["software", "creator", "parameters"]
FRONT_KEYS = [
    "generator", "ai", "ai_generated", "ai-generated", "claude", "anthropic", "openai", "gemini", "synthid", "c2pa", "content_credentials",
    "contentcredentials", "provenance", "digital_source_type", "digitalsourcetype", "created_with", "createdwith", "model", "llm",
]
# Regular expressions over names and values.
NAMES = "generator|ai[-_ ]?generated|claude|anthropic|openai|gemini|synthid|c2pa|content.?credential|provenance|digital.?source|aigc"
MAKERS = "claude|anthropic|openai|chatgpt|gemini|synthid|copilot|midjourney|dall.?e|stable.?diffusion"
TAG_HINTS = "c2pa|contentcredentials|digitalsourcetype|trainedalgorithmicmedia|algorithmicmedia|aigc|ai generated|generated by"
ATTRIBUTE = "(name|property|content|generator)s*=s*[\"']([^\"']*)[\"']"
DATA_URI = "data:image/([a-zA-Z0-9+.-]+)(;[^\\s\"'()<>]+)?,([A-Za-z0-9+/=\\s%]+)"
# Parts of findings, by the level they give; the first group that holds decides.
CONFIRMED = [
    "c2patool reports", "c2pa-related manifest", "png chunk c2", "png chunk cabx", "png chunk jumb", "png chunk jumd", "jpeg app11 segment", "digital_source_type",
    "digitalsourcetype", "trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia", "softwareagent",
]
CONTEXT = [
    "cms generator", "customxml parts", "xmp packet present", "unsupported", "not fully inspected", "format not", "svg <metadata> present", "not a valid",
    "truncated chunk", "bad segment length", "svg decode note",
]
PROBABLE = ["ai:", "marker:", "meta:", "frontmatter", "json-ld", "attr:", "png ", "jpeg app", "exif", "xmp", "interesting", "pdf-structured", "layer-a"]
LEVELS = ["confirmed", "probable", "informational", "likely_false_positive"]
# First bytes in hexadecimal and what they say.
MAGIC = [
    ("504B0304", "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)"), ("504B0506", "an empty ZIP container"), ("504B0708", "a spanned ZIP container"), ("255044462D", "a PDF"),
    ("89504E470D0A1A0A", "a PNG image"), ("FFD8FF", "a JPEG image"), ("474946383761", "a GIF image"), ("474946383961", "a GIF image"), ("424D", "a BMP image"),
    ("49492A00", "a TIFF image"), ("4D4D002A", "a TIFF image"), ("52494646", "a RIFF container (WEBP, WAV, AVI)"), ("4F676753", "an Ogg media file"), ("1F8B", "a gzip archive"),
    ("425A68", "a bzip2 archive"), ("FD377A585A00", "an xz archive"), ("377ABCAF271C", "a 7-Zip archive"), ("526172211A07", "a RAR archive"), ("7F454C46", "an ELF binary"),
    ("CAFEBABE", "a Java class or Mach-O fat binary"), ("D0CF11E0A1B11AE1", "a legacy Office document (.doc, .xls, .ppt)"), ("53514C69746520666F726D6174203300", "a SQLite database"),
    ("38425053", "a Photoshop document"), ("774F4646", "a WOFF font"), ("774F4632", "a WOFF2 font"), ("0001000000", "a TrueType font"), ("4F54544F", "an OpenType font"),
]
IMAGES = ["png", "jpg", "jpeg", "webp", "avif", "heic", "heif", "bmp", "gif", "tiff", "tif"]
CONTAINERS = ["svg", "pdf", "docx", "xlsx", "pptx", "odt", "epub", "html", "htm", "md", "markdown", "mdx"]
TEXTS = ["txt", "text", "css", "js", "py", "rs", "go", "json", "yaml", "yml", "toml", "csv"]
BINDING = ["c2pa.remote-manifest", "remote-manifest", "remote_manifest"]
LABELS = ["c2pa.soft-binding", "c2pa.remote-manifest"]
BINDING_LABEL = "(?:[\"']label[\"']\\s*:\\s*[\"']|\\blabel\\s*=\\s*[\"'])(c2pa\\.(?:soft-binding|remote-manifest))[\"']"
