"""Paragraphs of DOCX and strings of XLSX files, and the files with them replaced.

Files come from the binaryFile source; each is parsed whole in one Arrow-batched function, so a file must fit in a worker.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPHS = "array<struct<part: string, idx: int, text: string>>"
STRINGS = "array<struct<idx: int, text: string, translatable: boolean>>"
_PART = re.compile(r"word/(document|header[^/]*|footer[^/]*)\.xml")
_LOOK = re.compile(r"(?s)<rPr>(.*?)</rPr>")
_SHEET = re.compile(r"(<sheet\b[^>]*?\bname=\")([^\"]*)(\")")
_TOKEN = re.compile(rb"<(/?)w:([A-Za-z]+)\b[^>]*?(/?)>|<[^>]*>", re.S)
# Elements whose content is no text of the paragraph; Fallback is cut out beforehand.
_SKIPPED = {b"footnoteReference", b"footnoteRef", b"endnoteReference", b"endnoteRef", b"instrText", b"del", b"rPrChange", b"pPrChange", b"bookmarkStart", b"bookmarkEnd", b"commentReference"}
_FALLBACK = re.compile(rb"<mc:Fallback\b.*?</mc:Fallback>", re.S)
_ITEM, _RUN = re.compile(r"(?s)<si>(.*?)</si>|<si/>"), re.compile(r"(?s)<t(?:\s[^>]*)?>(.*?)</t>")
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def unescaped(s: str) -> str:
    for a, b in _ENTITIES:
        s = s.replace(a, b)
    return s


def escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def translatable_part(name: str) -> bool:
    return bool(_PART.fullmatch(name))


def part_paragraphs(xml: bytes) -> list[list[tuple[int, int, str]]]:
    """Per non-empty paragraph its text nodes as (start, end, text), with byte offsets of the whole <w:t> elements."""
    hidden = [(m.start(), m.end()) for m in _FALLBACK.finditer(xml)]
    out: list[list[tuple[int, int, str]]] = []
    stack: list[list[tuple[int, int, str]]] = []
    skip, open_text = 0, -1
    text_from = 0

    def close(nodes: list[tuple[int, int, str]]) -> None:
        if "".join(t for _, _, t in nodes).strip():
            out.append(nodes)

    for m in _TOKEN.finditer(xml):
        if m[2] is None or any(a <= m.start() < b for a, b in hidden):
            continue
        ending, name, single = m[1] == b"/", m[2], m[3] == b"/"
        if name in _SKIPPED and not single:
            skip += -1 if ending else 1
        elif skip:
            continue
        elif name == b"p" and not single:
            if ending:
                if stack:
                    close(stack.pop())
            else:
                stack.append([])
        elif name == b"txbxContent" and not ending and stack:
            # a text box inside a paragraph: what came before it stands alone
            close(stack[-1])
            stack[-1] = []
        elif name == b"t" and stack:
            if single:
                continue
            if not ending:
                open_text, text_from = m.start(), m.end()
            elif open_text >= 0:
                stack[-1].append((open_text, m.end(), unescaped(xml[text_from : m.start()].decode("utf-8"))))
                open_text = -1
    return out


def docx_paragraphs(content: bytes) -> list[dict]:
    rows = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if translatable_part(name):
                rows += [{"part": name, "idx": k, "text": "".join(t for _, _, t in nodes)} for k, nodes in enumerate(part_paragraphs(z.read(name)))]
    return rows


def patched(xml: bytes, texts: list[str | None]) -> bytes:
    """The part with each paragraph's text in its first node and its other nodes empty; None leaves a paragraph alone."""
    paragraphs = part_paragraphs(xml)
    if len(paragraphs) != len(texts):
        raise ValueError(f"{len(paragraphs)} paragraphs, {len(texts)} texts")
    out, at = [], 0
    edits = sorted((a, b, t if k == 0 else "") for nodes, t in zip(paragraphs, texts, strict=True) if t is not None for k, (a, b, _) in enumerate(nodes))
    for a, b, t in edits:
        out += [xml[at:a], f'<w:t xml:space="preserve">{escaped(t)}</w:t>'.encode()]
        at = b
    return b"".join(out) + xml[at:]


def rewritten(content: bytes, parts: dict[str, bytes]) -> bytes:
    """The archive with some parts replaced and all others copied."""
    target = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            w.writestr(info, parts.get(info.filename, z.read(info.filename)))
    return target.getvalue()


def translated_docx(content: bytes, texts: dict[tuple[str, int], str]) -> bytes:
    parts = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in filter(translatable_part, z.namelist()):
            xml = z.read(name)
            parts[name] = patched(xml, [texts.get((name, k)) for k in range(len(part_paragraphs(xml)))])
    return rewritten(content, parts)


def shared_strings(xml: str) -> list[str]:
    return ["".join(unescaped(t) for t in _RUN.findall(m[1] or "")) for m in _ITEM.finditer(xml)]


def xlsx_strings(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "xl/sharedStrings.xml" not in z.namelist():
            return []
        texts = shared_strings(z.read("xl/sharedStrings.xml").decode("utf-8"))
    return [{"idx": k, "text": t, "translatable": any(c.isalpha() for c in t)} for k, t in enumerate(texts)]


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [unescaped(m[2]) for m in _SHEET.finditer(z.read("xl/workbook.xml").decode("utf-8"))]


def translated_xlsx(content: bytes, texts: dict[int, str], names: dict[str, str] | None = None) -> bytes:
    """The workbook with its strings rebuilt, in the look of their first run, and its sheets renamed; empty texts change nothing."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = z.namelist()
        strings = z.read("xl/sharedStrings.xml").decode("utf-8") if "xl/sharedStrings.xml" in have else ""
        book = z.read("xl/workbook.xml").decode("utf-8")
    count = iter(range(10**9))

    def item(m: re.Match) -> str:
        k = next(count)
        text = texts.get(k) or "".join(unescaped(t) for t in _RUN.findall(m[1] or ""))
        body = f'<t xml:space="preserve">{escaped(text)}</t>'
        look = _LOOK.search(m[1] or "")
        return f"<si><r><rPr>{look[1]}</rPr>{body}</r></si>" if look else f"<si>{body}</si>"

    def sheet(m: re.Match) -> str:
        new = (names or {}).get(unescaped(m[2]))
        return m[1] + (escaped(new).replace('"', "&quot;") if new else m[2]) + m[3]

    parts = {"xl/workbook.xml": _SHEET.sub(sheet, book).encode("utf-8")}
    if strings:
        parts["xl/sharedStrings.xml"] = _ITEM.sub(item, strings).encode("utf-8")
    return rewritten(content, parts)


def _docx_batch(content: pd.Series) -> pd.Series:
    return content.map(docx_paragraphs)


def _xlsx_batch(content: pd.Series) -> pd.Series:
    return content.map(xlsx_strings)


def read_docx(df: DataFrame) -> DataFrame:
    """(path, part, idx, text) of the rows of a binaryFile scan."""
    return df.select("path", F.inline(F.pandas_udf(_docx_batch, PARAGRAPHS)("content")))


def read_xlsx(df: DataFrame) -> DataFrame:
    """(path, idx, text, translatable)."""
    return df.select("path", F.inline(F.pandas_udf(_xlsx_batch, STRINGS)("content")))


def _sheets_batch(content: pd.Series) -> pd.Series:
    return content.map(sheet_names)


def read_sheets(df: DataFrame) -> DataFrame:
    """(path, idx, name) of the sheets of each workbook."""
    return df.select("path", F.posexplode(F.pandas_udf(_sheets_batch, "array<string>")("content")).alias("idx", "name"))


def _write_docx_batch(content: pd.Series, texts: pd.Series) -> pd.Series:
    def one(c: bytes, own) -> bytes:
        return translated_docx(c, {(t["part"], t["idx"]): t["text"] for t in own} if own is not None else {})

    return pd.Series([one(c, t) for c, t in zip(content, texts, strict=True)])


def _write_xlsx_batch(content: pd.Series, texts: pd.Series, names: pd.Series) -> pd.Series:
    rows = zip(content, texts, names, strict=True)
    return pd.Series([translated_xlsx(c, {x["idx"]: x["text"] for x in t} if t is not None else {}, {x["name"]: x["text"] for x in n} if n is not None else {}) for c, t, n in rows])


def write_docx(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, content): each document with the paragraphs of texts (path, part, idx, text) in their places; others stay as they are."""
    own = texts.groupBy("path").agg(F.collect_list(F.struct("part", "idx", "text")).alias("texts"))
    return files.join(own, "path", "left").select("path", F.pandas_udf(_write_docx_batch, "binary")("content", "texts").alias("content"))


def write_xlsx(files: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(path, content): each workbook with the strings of texts (path, idx, text) and the sheets of names (path, name, text) renamed."""
    own = texts.groupBy("path").agg(F.collect_list(F.struct("idx", "text")).alias("texts"))
    titles = names.groupBy("path").agg(F.collect_list(F.struct("name", "text")).alias("names"))
    return files.join(own, "path", "left").join(titles, "path", "left").select("path", F.pandas_udf(_write_xlsx_batch, "binary")("content", "texts", "names").alias("content"))


def _archive(parts: dict[str, str]) -> bytes:
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as w:
        for name, xml in parts.items():
            w.writestr(name, xml)
    return target.getvalue()


_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
_SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def make_rich_docx(paragraphs: Iterable[str], header: str, boxed: str) -> bytes:
    """A document for fixtures with all that reading must see through: divided runs, fields, deletions, bookmarks, format
    changes, a text box with its older twin, a header and notes."""

    def runs(p: str) -> str:
        half = len(p) // 2
        field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>HYPERLINK "x"</w:instrText></w:r>'
        gone = '<w:del w:id="1"><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:bookmarkStart w:id="0" w:name="b"/><w:bookmarkEnd w:id="0"/>'
        look = '<w:rPr><w:b/><w:rPrChange w:id="2"><w:rPr><w:t>old</w:t></w:rPr></w:rPrChange></w:rPr>'
        return f'<w:r>{look}<w:t xml:space="preserve">{escaped(p[:half])}</w:t></w:r>{field}{gone}<w:r><w:t xml:space="preserve">{escaped(p[half:])}</w:t><w:footnoteReference w:id="3"/></w:r>'

    box = f"<w:p><w:r><w:t>{escaped(boxed)}</w:t></w:r></w:p>"
    drawing = f"<w:p><w:r><mc:AlternateContent><mc:Choice><w:txbxContent>{box}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{box}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    body = "".join(f"<w:p>{runs(p)}</w:p>" for p in paragraphs)
    return _archive({
        "[Content_Types].xml": _TYPES,
        "word/document.xml": f'<?xml version="1.0"?><w:document {_SPACE}><w:body>{body}{drawing}</w:body></w:document>',
        "word/header1.xml": f'<?xml version="1.0"?><w:hdr {_SPACE}><w:p><w:r><w:t>{escaped(header)}</w:t></w:r></w:p></w:hdr>',
        "word/footnotes.xml": f'<?xml version="1.0"?><w:footnotes {_SPACE}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnotes>',
    })


def make_rich_xlsx(strings: Iterable[str], sheet: str) -> bytes:
    """A workbook for fixtures whose strings alternate between plain ones and such of two runs."""

    def item(k: int, s: str) -> str:
        half = len(s) // 2
        return f"<si><t>{escaped(s)}</t></si>" if k % 2 else f'<si><r><rPr><b/></rPr><t xml:space="preserve">{escaped(s[:half])}</t></r><r><t xml:space="preserve">{escaped(s[half:])}</t></r></si>'

    title = escaped(sheet).replace('"', "&quot;")
    return _archive({"xl/workbook.xml": f'<workbook><sheets><sheet name="{title}" sheetId="1"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst>" + "".join(item(k, s) for k, s in enumerate(strings)) + "</sst>"})


def make_docx(paragraphs: Iterable[str]) -> bytes:
    """A minimal document, for fixtures and for plain exports."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escaped(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return _archive({"[Content_Types].xml": _TYPES, "word/document.xml": f'<?xml version="1.0"?><w:document {_SPACE}><w:body>{body}</w:body></w:document>'})


def make_xlsx(strings: Iterable[str]) -> bytes:
    """A minimal workbook with shared strings, for fixtures."""
    return _archive({"xl/workbook.xml": '<workbook><sheets><sheet name="Sheet1" sheetId="1"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escaped(s)}</t></si>" for s in strings) + "</sst>"})
