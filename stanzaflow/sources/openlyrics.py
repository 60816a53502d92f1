"""OpenLyrics files as rows. Text and chord elements are mixed in order, so documents are walked in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stanzaflow.functions.text import C1_FROM, C1_TO, CHORD_STRUCTURES


def local_name(tag: str, fold: bool = True) -> str:
    """Element name without its namespace."""
    name = tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""
    return name.lower() if fold else name


def squeeze(s: str) -> str:
    """Single spaces, none at the ends."""
    return re.sub(r"\s+", " ", s or "").strip()


def chord_name(at: dict[str, str]) -> str:
    """The chord that the attributes of a chord element spell."""
    name, root, structure, bass = ((at.get(k) or "").strip() for k in ("name", "root", "structure", "bass"))
    if name or not root:
        return name
    return root + CHORD_STRUCTURES.get(structure, structure) + (f"/{bass}" if bass else "")


def mixed_lines(block: ET.Element) -> list[list[tuple[str, str]]]:
    """Lines of a block as runs ("text" | "chord", value) in document order; br ends a line, line elements are lines."""
    out: list[list[tuple[str, str]]] = [[]]

    def end() -> None:
        if any(v.strip() for _, v in out[-1]):
            out.append([])

    def walk(node: ET.Element) -> None:
        if node.text and local_name(node.tag) != "br":
            out[-1].append(("text", node.text))
        for child in node:
            name = local_name(child.tag)
            if name == "br":
                end()
            else:
                if name == "chord" and (chord := chord_name(child.attrib)):
                    out[-1].append(("chord", chord))
                walk(child)
                if name == "line":
                    end()
            if child.tail:
                out[-1].append(("text", child.tail))

    walk(block)
    return [x for x in out if any(v.strip() for _, v in x)]


def plain_and_chorded(line: list[tuple[str, str]]) -> tuple[str, str]:
    """The words of a line, and the same with chords in brackets."""
    return squeeze("".join(v for k, v in line if k == "text")), squeeze("".join(v if k == "text" else f"[{v}]" for k, v in line))


def with_offsets(line: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int]]]:
    """The words of a line, cleaned and trimmed, and its chords with offsets that stay inside the words."""
    words, chords = "", []
    for k, v in line:
        if k == "text":
            words += v
        else:
            chords.append((v, len(words)))
    clean = clean_text(words)
    lead = len(clean) - len(clean.lstrip())
    clean = clean.strip()
    return clean, [(c, max(0, min(len(clean), o - lead))) for c, o in chords]


_C1 = {ord(a): b for a, b in zip(C1_FROM, C1_TO, strict=True)}
_SAME = {0x02BC: "'", 0x2019: "'", 0x2018: "'", 0x2032: "'", 0xFF07: "'", 0x0415: "E", 0x0435: "e"}


def clean_text(s: str) -> str:
    """Controls mended or dropped, compatibility forms composed, one kind of apostrophe, Cyrillic e as Latin."""
    mended = (s or "").translate(_C1)
    kept = "".join(c for c in mended if c in "\n\r\t" or ord(c) >= 32 and not 0x80 <= ord(c) <= 0x9F)
    return unicodedata.normalize("NFKC", kept).translate(_SAME)


def first_text(root: ET.Element, *names: str) -> str:
    """Text of the first element of any of the names that has some, in document order."""
    return next((t for e in root.iter() if local_name(e.tag) in names and (t := squeeze("".join(e.itertext())))), "")


def parse_song(text: str) -> dict:
    """Fields, plain lyrics and chorded body of an OpenLyrics document. Raises ET.ParseError for what is no XML."""
    root = ET.fromstring(text)
    verses = [e for e in root.iter() if local_name(e.tag) == "verse"]
    plain: list[str] = []
    body: list[str] = []

    def take(blocks: list[ET.Element]) -> None:
        for block in blocks:
            for words, chorded in map(plain_and_chorded, mixed_lines(block)):
                if words:
                    plain.append(words)
                    body.append(chorded)

    for verse in verses:
        body.append("{comment: %s}" % (verse.get("name") or verse.get("label") or "Verse"))
        take([c for c in verse if local_name(c.tag) == "lines"] or [verse])
        body.append("")
    if not verses:
        take([e for e in root.iter() if local_name(e.tag) == "lyrics"][:1])
    return {
        "title": first_text(root, "title", "songtitle"), "author": first_text(root, "author") or first_text(root, "composer", "writer"), "artist": first_text(root, "artist"), "key": first_text(root, "key"),
        "copyright": first_text(root, "copyright"), "chord_count": sum(local_name(e.tag) == "chord" for e in root.iter()), "plain_lyrics": "\n".join(plain), "chordpro_body": "\n".join(body).strip(),
    }


PARSED = "title string, author string, artist string, key string, copyright string, chord_count bigint, plain_lyrics string, chordpro_body string"
_COLUMNS = [c.split()[0] for c in PARSED.split(", ")]


def parsed_songs(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields, parse_status, parse_error) of every document; one that is no XML has status warning and empty fields."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, status, errors = [], [], []
            for t in b.column(1).to_pylist():
                try:
                    rows.append(parse_song(t or ""))
                    status.append("ok")
                    errors.append("")
                except (ET.ParseError, ValueError) as e:
                    rows.append({c: 0 if c == "chord_count" else "" for c in _COLUMNS})
                    status.append("warning")
                    errors.append(f"XML parse failed: {e}")
            cols = [pa.array([r[c] for r in rows], pa.int64() if c == "chord_count" else pa.string()) for c in _COLUMNS]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(status, pa.string()), pa.array(errors, pa.string())], names=[key, *_COLUMNS, "parse_status", "parse_error"])

    return files.select(key, text).mapInArrow(scan, f"{key} {dict(files.dtypes)[key]}, {PARSED}, parse_status string, parse_error string")


def _child(node: ET.Element | None, path: str) -> ET.Element | None:
    for name in path.split("/"):
        node = next((c for c in node if local_name(c.tag, False) == name), None) if node is not None else None
    return node


def _display(code: str) -> str | None:
    low = code.lower()
    number = re.match(r"v(\d+)", low)
    return None if low == "ei" else {"c": "Chorus", "b": "Bridge", "e": "Ending", "p": "Pre-Chorus", "v": f"Verse {number[1]}" if number else "Verse"}.get(low[:1], code)


def parse_songbook(text: str) -> dict:
    """A document as the songbook shows it: title, language, authors, rights, and verses of lines with chord offsets."""
    root = ET.fromstring(text)
    title = _child(root, "properties/titles/title")
    title = title if title is not None else _child(root, "title")
    authors = _child(root, "properties/authors")
    names = [c for c in authors if local_name(c.tag) == "author"] if authors is not None else [e for e in root.iter() if local_name(e.tag, False) == "author"]
    held = lambda path, missing: clean_text((e.text or missing).strip()) if (e := _child(root, path)) is not None else missing
    verses = []
    for verse in [v for v in (_child(root, "lyrics") if _child(root, "lyrics") is not None else []) if local_name(v.tag, False) == "verse"]:
        blocks = [c for c in verse if local_name(c.tag, False) == "lines"] or [verse]
        lines = [x for block in blocks for x in map(with_offsets, mixed_lines(block)) if x[0] or x[1]]
        if lines:
            verses.append({"name": _display(verse.get("name", "Unnamed")), "lang": (verse.get("lang") or "").lower(), "lines": [{"text": t, "chords": [{"text": c, "offset": o} for c, o in cs]} for t, cs in lines]})
    shown = (title.text or "").strip() if title is not None else ""
    return {
        "title": clean_text(shown or "Unknown Title"), "title_lang": (title.get("lang") or "").lower() if title is not None else "", "authors": [clean_text((a.text or "Unknown Author").strip()) for a in names],
        "copyright": held("properties/copyright", "Unknown Copyright"), "released": held("properties/released", "Unknown Release Date"), "verses": verses,
    }


def songbook(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, title_lang, authors, copyright, released, verses) of every document that is XML."""
    chord = pa.struct([("text", pa.string()), ("offset", pa.int32())])
    line = pa.struct([("text", pa.string()), ("chords", pa.list_(chord))])
    verse = pa.list_(pa.struct([("name", pa.string()), ("lang", pa.string()), ("lines", pa.list_(line))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append(parse_songbook(t or ""))
                    keys.append(k)
                except ET.ParseError:
                    continue
            get = lambda c, t: pa.array([r[c] for r in rows], t)
            texts = [get(c, pa.string()) for c in ("title", "title_lang")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.schema.field(0).type), *texts, get("authors", pa.list_(pa.string())), get("copyright", pa.string()), get("released", pa.string()), get("verses", verse)],
                names=[key, "title", "title_lang", "authors", "copyright", "released", "verses"],
            )

    kinds = "title string, title_lang string, authors array<string>, copyright string, released string, verses array<struct<name:string,lang:string,lines:array<struct<text:string,chords:array<struct<text:string,offset:int>>>>>>"
    return files.select(key, text).mapInArrow(scan, f"{key} {dict(files.dtypes)[key]}, {kinds}")
