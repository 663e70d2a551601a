"""Word documents: paragraphs with styles and highlights, segmented into cards by headings or by look.

``read`` scans files with Spark's binary source; ``cards_of`` works on any column of file bytes. Each
file is one row, parsed alone.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Highlight and shading values that mean none, and the heading styles.
NO_COLOUR = {"", "none", "white", "auto", "ffffff"}
SECTION_STYLES, CARD_STYLE = {"Heading2", "Heading3"}, "Heading4"


@dataclass
class Paragraph:
    index: int
    style: str | None
    text: str
    runs: list[dict] = field(default_factory=list)

    @property
    def marked(self) -> bool:
        return any(r["colour"] for r in self.runs)


def spaced(text: str) -> str:
    """White space squeezed, none before closing or after opening marks, contractions rejoined."""
    text = " ".join(text.split())
    text = re.sub(r"\s+([,.;:!?%)\]}])", r"\1", text)
    text = re.sub(r"([(\[{])\s+", r"\1", text)
    return re.sub(r"\s+(['’](?:s|t|re|ve|ll|d|m)\b)", r"\1", text)


def _get(el: ET.Element | None, path: str, attr: str = "val") -> str | None:
    found = el.find("/".join(NS + p for p in path.split("/"))) if el is not None else None
    return None if found is None else found.get(NS + attr)


def _colour(props: ET.Element | None) -> str | None:
    for value in (_get(props, "highlight"), _get(props, "shd", "fill")):
        if (value or "").lower() not in NO_COLOUR:
            return value.lower()
    return None


def _marked_styles(archive: zipfile.ZipFile) -> set[str]:
    """Styles that are highlighted, of their own or through what they are based on."""
    if "word/styles.xml" not in archive.namelist():
        return set()
    own, base = set(), {}
    for s in ET.fromstring(archive.read("word/styles.xml")).iter(f"{NS}style"):
        name = s.get(f"{NS}styleId")
        base[name] = _get(s, "basedOn")
        if _colour(s.find(f"{NS}rPr")):
            own.add(name)
    out = set()
    for name in base:
        path, at = set(), name
        while at is not None and at not in path:
            path.add(at)
            at = base.get(at)
        if path & own:
            out.add(name)
    return out


def paragraphs(data: bytes) -> list[Paragraph]:
    """Top-level paragraphs that have text; indexes count the empty ones too."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        marked = _marked_styles(archive)
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{NS}body")
    for i, p in enumerate(body.findall(f"{NS}p") if body is not None else ()):
        style, runs = _get(p, "pPr/pStyle"), []
        for r in p.findall(f"{NS}r"):
            text = "".join({f"{NS}t": c.text or "", f"{NS}tab": " ", f"{NS}br": "\n", f"{NS}cr": "\n"}.get(c.tag, "") for c in r)
            if text:
                props = r.find(f"{NS}rPr")
                run_style, size = _get(props, "rStyle"), _get(props, "sz")
                colour = _colour(props) or ("style" if style in marked or run_style in marked else None)
                runs.append({"text": text, "colour": colour, "style": run_style, "font_size": int(size) / 2 if (size or "").isdigit() else None, "bold": props is not None and props.find(f"{NS}b") is not None, "underline": props is not None and props.find(f"{NS}u") is not None})
        if text := spaced("".join(r["text"] for r in runs)):
            out.append(Paragraph(i, style, text, runs))
    return out


def highlights(body: list[Paragraph]) -> list[dict]:
    """Neighbouring runs of one colour as one span, with offsets in the raw runs."""
    out = []
    for p in body:
        at, placed = 0, []
        for k, r in enumerate(p.runs):
            placed.append((k, at, r))
            at += len(r["text"])
        for colour, group in groupby(placed, key=lambda x: x[2]["colour"]):
            own = list(group)
            if colour and (text := spaced("".join(r["text"] for _, _, r in own))):
                k, start, first = own[0]
                out.append({"text": text, "colour": colour, "paragraph": p.index, "run": k, "start": start, "end": own[-1][1] + len(own[-1][2]["text"]), "bold": first["bold"]})
    return out


def citation(raw: str) -> tuple[str | None, int | None, str | None]:
    """(author, year, address) of a citation."""
    url = re.search(r"https?://[^\s)\]]+", raw)
    head = re.split(r"[,(\[]", raw.strip(), maxsplit=1)[0].strip()
    head = re.sub(r"\s+(?:[-–—]|[‘'’]?\d{2,4}\b).*$", "", head).split()
    long, short = re.search(r"\b(?:19|20)\d{2}\b", raw), re.search(r"(?:[‘']|\b)(\d{2})(?:\b|[.,\]])", raw)
    year = int(long[0]) if long else (lambda y: 2000 + y if y < 70 else 1900 + y)(int(short[1])) if short else None
    return (head[-1] if head else None), year, (url[0] if url else None)


def _card(section: str, tag: str, cite: str, body: list[Paragraph], first: int) -> dict:
    author, year, url = citation(cite)
    name = f"{author} {year % 100:02d}" if author and year else author
    return {"section": section, "tag": tag, "citation": cite, "author": author, "year": year, "url": url, "card_name": name, "body": "\n\n".join(p.text for p in body), "n_highlights": len(highlights(body)), "paragraph_start": first, "paragraph_end": body[-1].index if body else first}


def by_headings(ps: list[Paragraph]) -> list[dict]:
    """A card heading, its citation paragraph, and a body up to the next heading; cards without either are dropped."""
    out, section = [], "Uncategorized"
    island = 0
    numbered = []
    for p in ps:
        island += p.style in SECTION_STYLES or p.style == CARD_STYLE
        numbered.append((island, p))
    for _, group in groupby(numbered, key=lambda x: x[0]):
        head, *rest = [p for _, p in group]
        if head.style in SECTION_STYLES:
            section = head.text
        elif head.style == CARD_STYLE and len(rest) >= 2:
            out.append(_card(section, head.text, rest[0].text, rest[1:], head.index))
    return out


NUMBERED = re.compile(r"^\s*(\d{1,3})[.)]\s+(.{3,})$")
ADDRESS = re.compile(r"https?://|www\.")
DATE = re.compile(r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:19|20)\d{2}|[’']\d{2})\b")


def cites(text: str) -> bool:
    """Whether a paragraph looks like a citation."""
    low = text.lower()
    if len(text) < 12:
        return False
    dated = bool(DATE.search(text))
    return bool(ADDRESS.search(text)) or dated and ("[" in text or "accessed" in low) or len(text) > 80 and dated and any(x in low for x in ("//", "google books", "“", '"'))


def short_citation(text: str) -> str:
    """Up to the year, ended by a full stop."""
    m = re.search(r"^.*?[‘’']\d{2}", text)
    text = m[0] if m and "[" not in m[0] else (lambda t: (re.search(r"^.*?\b(?:19|20)?\d{2}\b", t) or re.match(".*", t))[0])(re.split(r"\s*[\[(]", text, maxsplit=1)[0])
    text = text.strip().rstrip(" ,;:-")
    return text if not text or text[-1] in ".!?" else text + "."


def by_look(ps: list[Paragraph], keep_empty: bool = False) -> list[dict]:
    """For files without heading styles: a title is numbered, or is followed by a citation; citations may run on."""
    titled = lambda i: bool(NUMBERED.match(ps[i].text)) or (not ps[i].marked and not cites(ps[i].text) and len(ps[i].text) <= 420 and i + 1 < len(ps) and (not ps[i + 1].marked or bool(ADDRESS.search(ps[i + 1].text))) and cites(ps[i + 1].text))
    out, i = [], 0
    while i < len(ps):
        if titled(i):
            title = NUMBERED.match(ps[i].text)
            full, at = ps[i + 1].text if i + 1 < len(ps) else "", i + 2
            while at < len(ps) and not ps[at].marked and not titled(at):
                t = ps[at].text
                if not (full.count("[") > full.count("]") or ADDRESS.search(t) or t[0] in ".,)]" or re.search(r"(?i)(?:accessed|doa)\s*:?\s*\d", t)):
                    break
                full, at = f"{full} {t}", at + 1
            out.append({"title": title[2] if title else ps[i].text, "full_citation": spaced(full), "citation": short_citation(spaced(full)), "body": []})
            i = at
            continue
        if out:
            out[-1]["body"].append(ps[i].text)
        i += 1
    return [c for c in out if keep_empty or c["body"]]


SCHEMA = "document string, card_index int, section string, tag string, citation string, author string, year int, url string, card_name string, body string, n_highlights int, paragraph_start int, paragraph_end int"
LOOK_SCHEMA = "document string, card_index int, title string, citation string, full_citation string, body string"


def _scan(files: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    found = rows_of(paragraphs(bytes(content)))
                except (zipfile.BadZipFile, ET.ParseError, KeyError):
                    continue  # not a document: it has no cards
                rows += [{"document": path, "card_index": i, **c} for i, c in enumerate(found)]
            out = pd.DataFrame(rows, columns=names)
            for n in ("year", "card_index", "n_highlights", "paragraph_start", "paragraph_end"):
                if n in out:
                    out[n] = out[n].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, schema)


def cards_of(files: DataFrame) -> DataFrame:
    """Cards (SCHEMA) of files (path, content) with heading styles."""
    return _scan(files, SCHEMA, by_headings)


def separate(files: DataFrame) -> DataFrame:
    """Cards (LOOK_SCHEMA) of files without heading styles."""
    return _scan(files, LOOK_SCHEMA, lambda ps: [{**c, "body": "\n\n".join(c["body"])} for c in by_look(ps)])


def read(spark: SparkSession, path: str) -> DataFrame:
    return cards_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path))


def write_bytes(parts: list[tuple[str | None, list[tuple[str, str | None]]]]) -> bytes:
    """A small document: paragraphs of (style, runs of (text, highlight)); for tests and fixtures."""
    run = lambda t, c: f'<w:r><w:rPr>{f"""<w:highlight w:val="{c}"/>""" if c else ""}</w:rPr><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    body = "".join(f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}{"".join(run(t, c) for t, c in runs)}</w:p>' for s, runs in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0"?><w:document xmlns:w="{NS[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
