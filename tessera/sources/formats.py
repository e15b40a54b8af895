"""Pages of other formats than HTML as (title, text, links, width, height) (S500-S523), and writers of some of them.

Parsing runs over Arrow batches: no built-in expression reads these formats. A page that can't be
read as what it claims to be gives an empty text, as does a null page.
"""

from __future__ import annotations

import bz2
import gzip
import html
import io
import re
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as K

#: No page is unpacked beyond so many bytes.
MOST_BYTES = 1 << 26


@dataclass
class Page:
    title: str = ""
    text: str = ""
    links: list[str] = field(default_factory=list)
    width: int | None = None
    height: int | None = None


def _xml(raw: bytes) -> ET.Element:
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError("documents with entities of their own are not read")
    return ET.fromstring(raw)


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _tag(e) == name]


def _words(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    info = z.getinfo(name)
    if info.file_size > MOST_BYTES:
        raise ValueError("member is too large")
    return z.read(info)


def text_page(raw: bytes) -> Page:
    """S501: the first line is the title; http links stand in the text."""
    text = raw.decode("utf-8", "replace")
    return Page(text.strip().split("\n", 1)[0][:100].strip(), text, re.findall(r"https?://[^\s<>\"')]+", text))


def table_page(raw: bytes) -> Page:
    """S501: comma or tab separated values; the first row is the title."""
    import csv

    text = raw.decode("utf-8", "replace")
    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if "\t" in text.split("\n", 1)[0] else ","))
    return Page(" ".join(rows[0]) if rows else "", "\n".join(" ".join(r) for r in rows))


def xml_page(raw: bytes) -> Page:
    """S502-S504, S518: by the root: feeds, sitemaps, drawings; else all text."""
    root = _xml(raw)
    kind = _tag(root)
    if kind == "rss" or kind == "RDF" or kind == "feed":
        items = _all(root, "item") or _all(root, "entry")
        head = next((e for e in root.iter() if _tag(e) == "title"), None)
        links, texts = [], []
        for i in items:
            for e in i:
                if _tag(e) == "link" and (e.get("rel") in (None, "alternate")):
                    links.append((e.get("href") or e.text or "").strip())
                elif _tag(e) in ("title", "description", "summary", "content"):
                    texts.append(re.sub(r"<[^>]*>", " ", _words(e)))
        return Page(_words(head) if head is not None else "", "\n".join(texts), [x for x in links if x])
    if kind in ("urlset", "sitemapindex"):
        return Page("", "", [_words(e) for e in _all(root, "loc")])
    if kind == "svg":
        size = [re.match(r"\d+", root.get(k) or "") for k in ("width", "height")]
        title = next(iter(_all(root, "title")), None)
        return Page(_words(title) if title is not None else "", " ".join(_words(e) for e in _all(root, "text")), [], *[int(m[0]) if m else None for m in size])
    return Page("", _words(root))


def docx_page(raw: bytes) -> Page:
    """S508: paragraphs of the document, its title, and the targets of its links."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    body = _xml(_member(z, "word/document.xml"))
    text = "\n".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(body, "p"))
    return Page(_core_title(z), text, _targets(z, "word/_rels/document.xml.rels"))


def pptx_page(raw: bytes) -> Page:
    """S510: texts of the slides in their order."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    text = "\n".join("\n".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(_xml(_member(z, n)), "p")) for n in names)
    return Page(_core_title(z), text, [x for n in names for x in _targets(z, n.replace("slides/", "slides/_rels/") + ".rels")])


def xlsx_page(raw: bytes) -> Page:
    """S511: cells of the sheets, row by row."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = [_words(e) for e in _all(_xml(_member(z, "xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    rows = []
    for n in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for r in _all(_xml(_member(z, n)), "row"):
            cells = []
            for c in _all(r, "c"):
                v = next(iter(_all(c, "v")), None)
                value = (v.text or "") if v is not None else _words(c)
                cells.append(shared[int(value)] if c.get("t") == "s" else value)
            rows.append("\t".join(cells))
    return Page(_core_title(z), "\n".join(rows))


def epub_page(raw: bytes) -> Page:
    """S512: the chapters in the order of the package's spine."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    package = _all(_xml(_member(z, "META-INF/container.xml")), "rootfile")[0].get("full-path") or ""
    root = _xml(_member(z, package))
    base = package.rsplit("/", 1)[0] + "/" if "/" in package else ""
    files = {e.get("id"): base + (e.get("href") or "") for e in _all(root, "item")}
    text = "\n".join(_words(_xml(_member(z, files[e.get("idref")]))) for e in _all(root, "itemref") if e.get("idref") in files)
    title = next(iter(_all(root, "title")), None)
    return Page(_words(title) if title is not None else "", text)


def _core_title(z: zipfile.ZipFile) -> str:
    if "docProps/core.xml" not in z.namelist():
        return ""
    return next((_words(e) for e in _all(_xml(_member(z, "docProps/core.xml")), "title")), "")


def _targets(z: zipfile.ZipFile, name: str) -> list[str]:
    if name not in z.namelist():
        return []
    return [e.get("Target") or "" for e in _all(_xml(_member(z, name)), "Relationship") if e.get("TargetMode") == "External"]


def rtf_page(raw: bytes) -> Page:
    """S513: text without groups of fonts, colours and styles."""
    out, skip, depth = [], [], 0
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)", raw.decode("latin-1")):
        code, point, word, _, sign, brace, text = m.groups()
        if brace == "{":
            depth += 1
        elif brace == "}":
            skip = [d for d in skip if d < depth]
            depth -= 1
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict") or sign == "*":
            skip.append(depth)
        elif skip:
            continue
        elif code:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif point:
            out.append(chr(int(point) % 65536))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif sign:
            out.append(sign if sign in "\\{}" else "")
        elif text:
            out.append(text)
    return Page("", "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip())


def _unpacked(raw: bytes, kind: str) -> bytes:
    with (gzip if kind == "gz" else bz2).open(io.BytesIO(raw)) as f:
        return f.read(MOST_BYTES)


def archive_page(raw: bytes) -> Page:
    """S514/S34: names and texts of what zip, gz, bz2 and tar files hold."""
    if raw[:2] == b"\x1f\x8b":
        return text_page(_unpacked(raw, "gz"))
    if raw[:3] == b"BZh":
        return text_page(_unpacked(raw, "bz2"))
    if raw[:2] == b"PK":
        z = zipfile.ZipFile(io.BytesIO(raw))
        files = [(i.filename, _member(z, i.filename)) for i in z.infolist() if not i.is_dir()]
    else:
        t = tarfile.open(fileobj=io.BytesIO(raw))
        files = [(m.name, t.extractfile(m).read(MOST_BYTES)) for m in t.getmembers() if m.isfile()]
    return Page(" ".join(n for n, _ in files), "\n".join(b.decode("utf-8", "replace") for _, b in files))


def gopher_page(raw: bytes) -> Page:
    """S515: the lines of a menu and where they lead."""
    texts, links = [], []
    for line in raw.decode("utf-8", "replace").splitlines():
        parts = line.split("\t")
        if line == "." or not line:
            continue
        texts.append(parts[0][1:])
        if len(parts) >= 4 and parts[0][:1] != "i":
            links.append(f"gopher://{parts[2]}:{parts[3]}/{parts[0][0]}{parts[1]}")
    return Page(texts[0] if texts else "", "\n".join(texts), links)


def source_page(raw: bytes) -> Page:
    """S516/S517/T11/T12: the names and words of Java or Python source, comments included, signs left out."""
    text = raw.decode("utf-8", "replace")
    name = re.search(r"\b(?:class|interface|def)\s+(\w+)", text)
    return Page(name[1] if name else "", " ".join(w for x in re.findall(r"[^\W\d_]\w*", text) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+", x)))


def pdf_page(raw: bytes) -> Page:
    """S506: the strings that the page contents show, streams inflated; fonts of their own coding are not read."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        data = m[1]
        try:
            data = zlib.decompressobj().decompress(data, MOST_BYTES)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            line = b"".join(s for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", block, re.S))
            out.append(re.sub(rb"\\([nrt()\\])", lambda k: {b"n": b"\n", b"r": b"", b"t": b"\t"}.get(k[1], k[1]), line).decode("latin-1"))
    title = re.search(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", raw)
    return Page(title[1].decode("latin-1") if title else "", "\n".join(out), [u.decode("latin-1") for u in re.findall(rb"/URI\s*\(([^)]*)\)", raw)])


def office_page(raw: bytes) -> Page:
    """S507/S509: runs of text in the old binary formats, in one or two bytes a letter."""
    one = [b.decode("cp1252", "replace") for b in re.findall(rb"[\x20-\x7e\xc0-\xff]{6,}", raw)]
    two = [b.decode("utf-16-le", "replace") for b in re.findall(rb"(?:[\x20-\x7e\xc0-\xff]\x00){6,}", raw)]
    return Page("", "\n".join(two or one))


def image_page(raw: bytes) -> Page:
    """S519-S523: width and height of PNG, GIF, BMP and JPEG images; the description of their XMP part."""
    size: tuple[int, int] | None = None
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        size = struct.unpack(">II", raw[16:24])
    elif raw[:3] == b"GIF":
        size = struct.unpack("<HH", raw[6:10])
    elif raw[:2] == b"BM":
        w, h = struct.unpack("<ii", raw[18:26])
        size = w, abs(h)
    elif raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                size = struct.unpack(">HH", raw[at + 5 : at + 9])[::-1]
                break
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    told = re.search(rb"<dc:description>.*?<rdf:li[^>]*>(.*?)</rdf:li>", raw, re.S)
    text = html.unescape(told[1].decode("utf-8", "replace")) if told else ""
    return Page("", text, [], *(size or (None, None)))


PARSERS: dict[str, Callable[[bytes], Page]] = {
    "txt": text_page, "csv": table_page, "tsv": table_page, "xml": xml_page, "rss": xml_page, "atom": xml_page, "sitemap": xml_page, "svg": xml_page,
    "docx": docx_page, "pptx": pptx_page, "xlsx": xlsx_page, "epub": epub_page, "rtf": rtf_page, "zip": archive_page, "gz": archive_page, "bz2": archive_page,
    "tar": archive_page, "gopher": gopher_page, "java": source_page, "py": source_page, "pdf": pdf_page, "doc": office_page, "ppt": office_page,
    "png": image_page, "gif": image_page, "bmp": image_page, "jpg": image_page, "jpeg": image_page,
}


def parsed(raw: bytes | None, kind: str | None) -> Page:
    if raw is None or kind not in PARSERS:
        return Page()
    try:
        return PARSERS[kind](bytes(raw))
    except (ValueError, KeyError, IndexError, OSError, EOFError, ET.ParseError, zipfile.BadZipFile, tarfile.TarError, struct.error, zlib.error):
        return Page()


_PAGE = K.StructType([K.StructField("title", K.StringType()), K.StructField("text", K.StringType()), K.StructField("links", K.ArrayType(K.StringType())), K.StructField("width", K.IntegerType()), K.StructField("height", K.IntegerType())])


@F.pandas_udf(_PAGE)
def read_page(raw: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """The page of a format: ``read_page(raw binary, kind string)``."""
    rows = [parsed(r, k) for r, k in zip(raw, kind)]
    ints = lambda name: pd.array([getattr(p, name) for p in rows], dtype="Int32")
    return pd.DataFrame({"title": [p.title for p in rows], "text": [p.text for p in rows], "links": [p.links for p in rows], "width": ints("width"), "height": ints("height")})


# Writers


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _core(title: str) -> dict[str, str]:
    return {"docProps/core.xml": f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>{html.escape(title)}</dc:title></cp:coreProperties>'}


def written(title: str, text: str, kind: str) -> bytes:
    """A small file of a format that holds a title and one line of text."""
    t, h = html.escape(text), html.escape(title)
    if kind == "docx":
        return _zipped(_core(title) | {"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:body></w:document>'})
    if kind == "pptx":
        return _zipped(_core(title) | {"ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'})
    if kind == "xlsx":
        sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c></row></sheetData></worksheet>'
        return _zipped(_core(title) | {"xl/sharedStrings.xml": f"<sst><si><t>{t}</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    if kind == "epub":
        package = f'<package><metadata><title>{h}</title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>'
        return _zipped({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": package, "o/a.xhtml": f"<html><body><p>{t}</p></body></html>"})
    if kind == "rtf":
        body = "".join(c if 32 <= ord(c) < 127 and c not in "\\{}" else "\\" + c if c in "\\{}" else "".join(f"\\u{u - 65536 if u > 32767 else u}?" for u in struct.unpack(f"<{len(c.encode('utf-16-le')) // 2}H", c.encode("utf-16-le"))) for c in text)
        return ("{\\rtf1{\\fonttbl{\\f0 Serif;}}" + body + "}").encode("ascii")
    if kind == "zip":
        return _zipped({title: text})
    if kind in ("gz", "bz2"):
        return gzip.compress(text.encode(), mtime=0) if kind == "gz" else bz2.compress(text.encode())
    if kind == "atom":
        return f'<feed xmlns="http://www.w3.org/2005/Atom"><title>{h}</title><entry><title>{t}</title><link href="http://e.com/1"/></entry></feed>'.encode()
    if kind == "rss":
        return f"<rss><channel><title>{h}</title><item><title>{t}</title><link>http://e.com/1</link></item></channel></rss>".encode()
    if kind == "svg":
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="12" height="7"><title>{h}</title><text>{t}</text></svg>'.encode()
    if kind == "gopher":
        return f"i{text}\tx\te.com\t70\r\n1more\t/m\te.com\t70\r\n.\r\n".encode()
    return text.encode()


@F.pandas_udf(K.BinaryType())
def write_page(title: pd.Series, text: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([written(a, b, k) for a, b, k in zip(title, text, kind)])
