"""TEI corpora: character declarations, mixed-content bodies, headers; one row for each text.

Files are read as binary rows, parsed in an Arrow batch at a time, and gathered by text; a file that isn't well-formed
becomes a row of the side table and is otherwise left out. Comments are not text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces, the elements that are not text, the pattern of file names, the ranges that texts keep.
TEI, CB, XML = "{http://www.tei-c.org/ns/1.0}", "{http://www.cbeta.org/ns/1.0}", "{http://www.w3.org/XML/1998/namespace}"
SKIPPED = frozenset(
    [f"{TEI}note", f"{TEI}rdg", f"{TEI}byline", f"{CB}docNumber", f"{CB}juan", f"{TEI}lb", f"{TEI}pb", f"{TEI}milestone", f"{CB}mulu"]
)
FILE_NAME = r"(T\d+n\d+[A-Za-z]?)_(\d+)\.xml$"
OTHER = re.compile("[^一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f]")

Chunk = tuple[str, str, bool]


def code_point(text: str | None) -> str | None:
    """``U+XXXX`` as a character; null for anything else."""
    m = re.fullmatch(r"U\+([0-9A-Fa-f]{1,6})", (text or "").strip())
    return chr(int(m[1], 16)) if m and int(m[1], 16) < 0x110000 else None


def declared(root: ElementTree.Element) -> list[tuple[str, str]]:
    """(id, character) of the declarations: the normalised form, else the normal and then the plain code point."""
    out = []
    for c in root.iter(f"{TEI}char"):
        forms = (p.findtext(f"{TEI}value") for p in c.iter(f"{TEI}charProp") if p.findtext(f"{TEI}localName") == "normalized form")
        points = {kind: next((m.text for m in c.iter(f"{TEI}mapping") if m.get("type") == kind and m.text), None) for kind in ("normal_unicode", "unicode")}
        found = next((f for f in forms if f), None) or code_point(points["normal_unicode"]) or code_point(points["unicode"])
        if c.get(f"{XML}id") and found:
            out.append((c.get(f"{XML}id"), found))
    return out


def chunks(body: ElementTree.Element, characters: dict[str, str]) -> Iterator[Chunk]:
    """(text, division type, within a spell) in reading order.

    Skipped elements keep what follows them; of variants only the lemma is read, and nothing between variants; glyph
    references read as their declared character, whatever they hold.
    """

    def walk(e: ElementTree.Element, div: str, spell: bool) -> Iterator[Chunk]:
        if e.tag in SKIPPED:
            return
        if e.tag == f"{TEI}app":
            for lemma in e.findall(f"{TEI}lem"):
                yield from walk(lemma, div, spell)
            return
        if e.tag == f"{CB}div":
            div = e.get("type", "unknown")
        spell = spell or (e.tag == f"{TEI}p" and e.get(f"{CB}type") == "dharani")
        if e.tag == f"{TEI}g":
            known = characters.get(e.get("ref", "")[1:]) if e.get("ref", "").startswith("#") else None
            if known:
                yield known, div, spell
            return
        if e.text:
            yield e.text, div, spell
        for child in e:
            yield from walk(child, div, spell)
            if child.tail:
                yield child.tail, div, spell

    yield from walk(body, "body", False)


def header(root: ElementTree.Element) -> dict:
    """Title, author, extent and the numbers that the body's document notes refer to."""
    titles = (t.text or "" for t in root.iter(f"{TEI}title") if t.get(f"{XML}lang") == "zh-Hant" and t.get("level") == "m")
    author = root.find(f".//{TEI}teiHeader//{TEI}author")
    extent = re.search(r"\d+", root.findtext(f".//{TEI}teiHeader//{TEI}extent") or "")
    numbers: list[str] = []
    for note in root.iter(f"{CB}docNumber"):
        inside = re.search(r"\[.*?\]", note.text or "")
        for a, b in re.findall(r"(\d+)(?:\s*-\s*(\d+))?", inside[0] if inside else ""):
            numbers += [str(n) for n in range(int(a), int(b or a) + 1)] if b else [a]
    return {"title": next(titles, ""), "author": (author.text or "") if author is not None else "", "extent_juan": int(extent[0]) if extent else 1, "docnumber_refs": numbers}


def segments(parts: list[Chunk], keep: re.Pattern = OTHER) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, int]]]:
    """(div_type, text, start, end) of neighbouring chunks of one division, and the merged ranges of spells."""
    out, spells, at = [], [], 0
    for div, own in groupby(parts, key=lambda x: x[1]):
        text = ""
        for raw, _, spell in own:
            plain = keep.sub("", raw)
            if plain and spell:
                start = at + len(text)
                if spells and start <= spells[-1][1]:
                    spells[-1] = (spells[-1][0], start + len(plain))
                else:
                    spells.append((start, start + len(plain)))
            text += plain
        if text:
            out.append((div, text, at, at + len(text)))
            at += len(text)
    return out, spells


def files(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, fascicle, path, content) of the files whose names fit."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    named = raw.withColumn("text_id", F.regexp_extract("path", FILE_NAME, 1)).where("text_id <> ''")
    return named.select("text_id", F.regexp_extract("path", FILE_NAME, 2).cast("int").alias("fascicle"), "path", "content")


def character_table(files_: DataFrame) -> DataFrame:
    """(id, ch): the first declaration of each character, in the order of paths and of the file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, i, c, ch) for i, (c, ch) in enumerate(declared(ElementTree.fromstring(content)))]
                except ElementTree.ParseError:
                    pass
            yield pd.DataFrame(rows, columns=["path", "n", "id", "ch"])

    found = files_.select("path", "content").mapInPandas(parse, "path string, n int, id string, ch string")
    return found.groupBy("id").agg(F.min_by("ch", F.struct("path", "n")).alias("ch"))


_NAMES = ["text_id", "full_text", "segments", "title", "author", "extent_juan", "char_count", "file_count", "docnumber_refs", "div_types", "has_dharani", "dharani_ranges"]
_TEXT = (
    "text_id string, full_text string, segments array<struct<div_type:string,text:string,start:int,end:int>>, title string, author string, extent_juan int, "
    "char_count int, file_count int, docnumber_refs array<string>, div_types array<string>, has_dharani boolean, dharani_ranges array<struct<start:int,end:int>>"
)


def texts(files_: DataFrame, characters: dict[str, str], min_length: int = 20) -> DataFrame:
    """One row for each text of ``min_length`` characters or more; a text's fascicles are its group."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: list[Chunk] = []
        meta: dict = {}
        divs: list[str] = []
        for content in pdf.sort_values(["fascicle", "path"])["content"]:
            try:
                root = ElementTree.fromstring(content)
            except ElementTree.ParseError:
                continue
            body = root.find(f".//{TEI}body")
            if not meta:
                meta = header(root)
                divs = sorted({d.get("type") for d in (body.iter(f"{CB}div") if body is not None else ()) if d.get("type")})
                meta["spell"] = body is not None and any(p.get(f"{CB}type") == "dharani" for p in body.iter(f"{TEI}p"))
            if body is not None:
                parts += chunks(body, characters)
        segs, spells = segments(parts)
        full = "".join(s[1] for s in segs)
        keys = ("div_type", "text", "start", "end")
        row = (pdf["text_id"].iloc[0], full, [dict(zip(keys, s)) for s in segs], meta.get("title", ""), meta.get("author", ""), meta.get("extent_juan", 1), len(full), len(pdf), meta.get("docnumber_refs", []), divs, meta.get("spell", False), [{"start": a, "end": b} for a, b in spells])
        return pd.DataFrame([row], columns=_NAMES) if len(full) >= min_length else pd.DataFrame(columns=_NAMES)

    return files_.groupBy("text_id").applyInPandas(gather, _TEXT)


def malformed(files_: DataFrame) -> DataFrame:
    """(path, error) of the files that don't parse."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    ElementTree.fromstring(content)
                except ElementTree.ParseError as e:
                    rows.append((path, str(e)))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return files_.select("path", "content").mapInPandas(parse, "path string, error string")


def main_text(segments_: str = "segments", full: str = "full_text") -> Column:
    """The scripture divisions of a text, or all of it where it has none."""
    own = F.filter(segments_, lambda s: s["div_type"] == "jing")
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda s: s["text"]), "")).otherwise(F.col(full))
