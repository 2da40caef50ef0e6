"""Office files and RTF with the standard library: DOCX, XLSX, PPTX, ODT, ODS, ODP, EPUB, RTF.

``read`` turns one file's bytes into nodes (part, address, kind, text) or a
refusal with a reason; ``nodes`` applies it to a table of files. Packages are
told apart by what they hold, a package that claims to be two things is
refused, entries are capped in size and ratio, and a file is refused as a whole
rather than read in part.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as E

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.sources import html

# Fixed values.
MAX_ENTRY = 256 << 20
MAX_RATIO = 1032
MAX_REPEAT = 4096
MIMES = {"application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp", "application/epub+zip": "epub"}
MAINS = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}

Node = tuple[str, str, str, str]


class Refused(ValueError):
    """Why a file isn't read; the message is the reason's code and detail."""


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(e: E.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def entry_names(z: zipfile.ZipFile) -> list[str]:
    names = [i.filename for i in z.infolist()]
    if len(set(names)) < len(names):
        raise Refused("duplicate-entry-names")
    return names


def entry(z: zipfile.ZipFile, name: str) -> bytes:
    """An entry's bytes; the checksum is checked by the read."""
    try:
        i = z.getinfo(name)
    except KeyError:
        raise Refused(f"missing-part {name}") from None
    if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise Refused(f"compression-method {name}")
    if i.flag_bits & 1:
        raise Refused(f"encrypted-part {name}")
    if i.file_size > MAX_ENTRY or i.file_size > MAX_RATIO * max(1, i.compress_size):
        raise Refused(f"resource-limit {name}")
    return z.read(i)


def tree(z: zipfile.ZipFile, name: str) -> E.Element:
    try:
        return E.fromstring(entry(z, name))
    except E.ParseError as e:
        raise Refused(f"malformed-xml {name}") from e


def relationships(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Id to part name, for the internal targets of a part."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in tree(z, rels).iter():
        if local(r.tag) == "Relationship" and r.get("TargetMode") != "External":
            out[r.get("Id", "")] = resolve(folder, r.get("Target", ""))
    return out


def resolve(folder: str, target: str) -> str:
    """A target's part name; '' where it walks over the root."""
    steps: list[str] = []
    for s in (target if target.startswith("/") else f"{folder}/{target}").split("/"):
        if s == "..":
            if not steps:
                return ""
            steps.pop()
        elif s not in ("", "."):
            steps.append(s)
    return "/".join(steps)


_STATED = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "\u2011"}


def docx(z: zipfile.ZipFile) -> Iterator[Node]:
    """Runs at paragraph:run, both from 1."""
    part = "word/document.xml"
    for p, para in enumerate((e for e in tree(z, part).iter() if local(e.tag) == "p"), 1):
        for r, run in enumerate((e for e in para.iter() if local(e.tag) == "r"), 1):
            text = "".join((e.text or "") if local(e.tag) == "t" else _STATED.get(local(e.tag), "") for e in run)
            if any(local(e.tag) == "t" and e.text for e in run):
                yield part, f"{p}:{r}", "run", text


def xlsx(z: zipfile.ZipFile) -> Iterator[Node]:
    """Cells at sheet!column+row: the cached value, the inline string, or the formula's source."""
    book = "xl/workbook.xml"
    rels = relationships(z, book)
    strings = []
    shared = next((n for n in rels.values() if n.endswith("sharedStrings.xml")), "")
    if shared:
        strings = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in tree(z, shared) if local(si.tag) == "si"]
    for s in (e for e in tree(z, book).iter() if local(e.tag) == "sheet"):
        part = rels.get(attr(s, "id") or "", "")
        if not part:
            raise Refused("sheet-without-part")
        for c in (e for e in tree(z, part).iter() if local(e.tag) == "c"):
            kids = {local(k.tag): k for k in c}
            kind = c.get("t", "n")
            v = kids["v"].text if "v" in kids else None
            if kind == "s" and v is not None:
                if not v.isdigit() or int(v) >= len(strings):
                    raise Refused("shared-string-index")
                text = strings[int(v)]
            elif kind == "inlineStr" and "is" in kids:
                text = "".join(t.text or "" for t in kids["is"].iter() if local(t.tag) == "t")
            else:
                text = v if v is not None else (kids["f"].text or "") if "f" in kids else ""
            if text:
                yield part, f"{s.get('name')}!{c.get('r')}", "cell", text


def _first_choice(e: E.Element) -> Iterator[E.Element]:
    """Descendants in order, of alternates the first choice only."""
    for k in e:
        if local(k.tag) == "AlternateContent":
            choice = next((c for c in k if local(c.tag) == "Choice"), None)
            if choice is not None:
                yield from _first_choice(choice)
        else:
            yield k
            yield from _first_choice(k)


def pptx(z: zipfile.ZipFile) -> Iterator[Node]:
    """Runs at slide:shape:paragraph:run, slides in the order of the presentation."""
    deck = "ppt/presentation.xml"
    rels = relationships(z, deck)
    for n, ref in enumerate((e for e in tree(z, deck).iter() if local(e.tag) == "sldId"), 1):
        part = rels.get(next((v for k, v in ref.attrib.items() if local(k) == "id" and k != "id"), ""), "")
        if not part:
            raise Refused("slide-without-part")
        shape = 0
        for sp in _first_choice(tree(z, part)):
            if local(sp.tag) not in ("sp", "graphicFrame"):
                continue
            shape += 1
            for p, para in enumerate((e for e in _first_choice(sp) if local(e.tag) == "p"), 1):
                for r, run in enumerate((e for e in para if local(e.tag) in ("r", "fld")), 1):
                    text = "".join(t.text or "" for t in run if local(t.tag) == "t")
                    if text:
                        yield part, f"{n}:{shape}:{p}:{r}", "run", text


def _odf_text(e: E.Element) -> str:
    """Paragraph text by the white-space rule: runs of it are one space, stated spaces, tabs and breaks stand."""
    out: list[str] = []

    def add(t: str | None) -> None:
        for c in t or "":
            if c in " \t\n\r":
                if out and out[-1] not in (" ", "\n", "\t"):
                    out.append(" ")
            else:
                out.append(c)

    def walk(x: E.Element) -> None:
        add(x.text)
        for k in x:
            name = local(k.tag)
            if name == "s":
                times = int(attr(k, "c") or 1)
                if times > MAX_REPEAT:
                    raise Refused("resource-limit repeated-spaces")
                out.extend(" " * times)
            elif name == "tab":
                out.append("\t")
            elif name == "line-break":
                out.append("\n")
            elif name not in ("note", "annotation", "p", "h"):
                walk(k)
            add(k.tail)

    walk(e)
    return "".join(out).strip(" ")


def _odf_content(z: zipfile.ZipFile) -> E.Element:
    """content.xml, which the manifest has to declare, unencrypted."""
    files = {attr(f, "full-path"): f for f in tree(z, "META-INF/manifest.xml").iter() if local(f.tag) == "file-entry"}
    if "content.xml" not in files:
        raise Refused("content-not-declared")
    if any(local(k.tag) == "encryption-data" for k in files["content.xml"].iter()):
        raise Refused("encrypted-part content.xml")
    return tree(z, "content.xml")


def odt(z: zipfile.ZipFile) -> Iterator[Node]:
    for n, e in enumerate((e for e in _odf_content(z).iter() if local(e.tag) in ("p", "h")), 1):
        text = _odf_text(e)
        if text:
            yield "content.xml", str(n), f"h{attr(e, 'outline-level') or 1}" if local(e.tag) == "h" else "p", text


def ods(z: zipfile.ZipFile) -> Iterator[Node]:
    """Cells at table:row:column, repeats written out."""
    for t in (e for e in _odf_content(z).iter() if local(e.tag) == "table"):
        row = 0
        for r in (e for e in t.iter() if local(e.tag) == "table-row"):
            cells, col = [], 0
            for c in (k for k in r if local(k.tag) in ("table-cell", "covered-table-cell")):
                times = int(attr(c, "number-columns-repeated") or 1)
                text = "\n".join(x for x in (_odf_text(p) for p in c if local(p.tag) == "p") if x)
                if text and times > MAX_REPEAT:
                    raise Refused("resource-limit repeated-cells")
                cells += [(col + k, text) for k in range(times if text else 0)]
                col += times
            times = int(attr(r, "number-rows-repeated") or 1)
            if cells and times > MAX_REPEAT:
                raise Refused("resource-limit repeated-rows")
            for k in range(times if cells else 0):
                for c, text in cells:
                    yield "content.xml", f"{attr(t, 'name')}:{row + k + 1}:{c + 1}", "cell", text
            row += times


def odp(z: zipfile.ZipFile) -> Iterator[Node]:
    """Paragraphs at page:shape:paragraph."""
    for n, page in enumerate((e for e in _odf_content(z).iter() if local(e.tag) == "page"), 1):
        for s, shape in enumerate((e for e in page.iter() if local(e.tag) in ("frame", "custom-shape", "rect", "ellipse")), 1):
            for p, para in enumerate((e for e in shape.iter() if local(e.tag) in ("p", "h")), 1):
                text = _odf_text(para)
                if text:
                    yield "content.xml", f"{n}:{s}:{p}", "p", text


def epub_name(reference: str, base: str) -> str:
    """A reference inside the package; absolute, remote and escaping ones are refused."""
    reference = reference.split("#")[0]
    if not reference or reference.startswith("/") or "://" in reference:
        raise Refused("reference-outside")
    steps = base.split("/") if base else []
    for s in reference.split("/"):
        if s == "..":
            if not steps:
                raise Refused("reference-outside")
            steps.pop()
        elif s not in ("", "."):
            steps.append(unquote(s, errors="strict"))
    return "/".join(steps)


def epub(z: zipfile.ZipFile) -> Iterator[Node]:
    """Blocks of the spine's documents in reading order, at spine:block."""
    root = next((attr(e, "full-path") for e in tree(z, "META-INF/container.xml").iter() if local(e.tag) == "rootfile"), None)
    if not root:
        raise Refused("no-package-document")
    package, base = tree(z, root), root.rpartition("/")[0]
    items = {e.get("id"): e for e in package.iter() if local(e.tag) == "item"}
    for n, ref in enumerate((e for e in package.iter() if local(e.tag) == "itemref"), 1):
        item = items.get(ref.get("idref"))
        if item is None:
            raise Refused("spine-without-item")
        part = epub_name(item.get("href", ""), base)
        for ordinal, element, text in html.read(entry(z, part).decode("utf-8-sig"))[0]:
            yield part, f"{n}:{ordinal}", element, text


_RTF = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIP = frozenset(b"fonttbl colortbl stylesheet info pict object header footer footnote listtable listoverridetable rsidtbl generator themedata colorschememapping latentstyles datastore xmlnstbl fldinst".split())
_RTF_BREAK = {b"par": "\n", b"page": "\n", b"sect": "\n", b"row": "\n", b"cell": "\t", b"tab": "\t", b"line": "\v", b"emdash": "—", b"endash": "–", b"bullet": "•", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"~": "\xa0", b"_": "\u2011"}


def rtf(stream: bytes) -> Iterator[Node]:
    """Paragraphs from 1. Destinations that aren't text are skipped with their groups; bytes are cp1252 only if declared."""
    if not stream.startswith(b"{\\rtf"):
        raise Refused("not-rtf")
    stack, skip, uc, ansi = [], False, 1, False
    fresh = drop = 0
    out: list[str] = []
    for m in _RTF.finditer(stream):
        word, number, hexed, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append((skip, uc))
            fresh = 1
            continue
        if brace == b"}":
            if not stack:
                raise Refused("rtf-unbalanced")
            skip, uc = stack.pop()
            continue
        if sign == b"*" and fresh:
            skip = True
            continue
        first, fresh = fresh, 0
        if word is not None:
            if first and word in _RTF_SKIP:
                skip = True
            elif word == b"uc":
                uc = int(number or 1)
            elif word == b"ansicpg":
                ansi = number == b"1252"
            elif not skip and word == b"u":
                out.append(chr(int(number) % 65536))
                drop = uc
            elif not skip and word in _RTF_BREAK:
                out.append(_RTF_BREAK[word])
        elif skip:
            continue
        elif hexed is not None:
            if drop:
                drop -= 1
            else:
                b = bytes.fromhex(hexed.decode())
                out.append(b.decode("cp1252" if ansi else "ascii", errors="replace"))
        elif sign is not None:
            if sign in (b"\\", b"{", b"}"):
                out.append(sign.decode())
            elif sign in _RTF_BREAK:
                out.append(_RTF_BREAK[sign])
        elif text is not None:
            text, drop = text[drop:], max(0, drop - len(text))
            out.append(text.decode("cp1252" if ansi else "ascii", errors="replace"))
    if stack:
        raise Refused("rtf-unbalanced")
    whole = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", errors="replace")
    for n, p in enumerate(whole.split("\n"), 1):
        if p.strip():
            yield "", str(n), "p", p


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odt, "ods": ods, "odp": odp, "epub": epub}


def claimed(z: zipfile.ZipFile) -> str:
    """What a package is; one that carries evidence for two things, or none, is refused."""
    names = entry_names(z)
    kinds = [k for n, k in MAINS.items() if n in names]
    if names and names[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED:
        kind = MIMES.get(entry(z, "mimetype").decode("ascii", errors="replace").strip())
        kinds += [kind] if kind else []
    if len(kinds) != 1:
        raise Refused("unknown-package" if not kinds else "ambiguous-package")
    return kinds[0]


def read(content: bytes) -> tuple[str | None, list[Node], str | None]:
    """(format, nodes, refusal): all of a file, or the reason why none of it."""
    kind = None
    try:
        if content.startswith(b"{\\rtf"):
            kind = "rtf"
            return kind, list(rtf(content)), None
        if not content.startswith(b"PK"):
            return None, [], "unsupported-format"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            kind = claimed(z)
            return kind, list(READERS[kind](z)), None
    except Refused as e:
        return kind, [], str(e)
    except (zipfile.BadZipFile, zlib.error, ValueError, EOFError, NotImplementedError, RuntimeError, OSError) as e:
        return kind, [], f"malformed {type(e).__name__}"


SCHEMA = "path string, format string, ord bigint, part string, address string, kind string, text string, refusal string"


def _nodes(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            kind, nodes, refusal = read(content.as_py() or b"")
            rows += [(path, kind, n, *node, None) for n, node in enumerate(nodes)] if refusal is None else [(path, kind, None, None, None, None, None, refusal)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == "ord" else pa.string()) for n, c in zip(names, cols, strict=True)], names)


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of every file (path, content), in order; a refused file is one row with its reason."""
    return files.select("path", "content").mapInArrow(_nodes, SCHEMA)
