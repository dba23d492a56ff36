"""Originals as a Spark data source: one row a paragraph with its page and section, batch and stream.

``spark.read.format("originals").option("path", folder).load()`` after ``register(spark)``. A file that can't be read gives
one row with the reason instead of text: ``type`` (no parser for its kind), ``size``, ``empty``, ``encrypted`` or
``damaged``, so no file is lost from sight and none ends the job.

The driver lists names and sizes only; files are dealt to partitions of about ``part_bytes``, and tasks open them one
at a time, so a task holds one file. As a stream, files are taken in the order of their times, ``files_a_batch`` at
a time; a restart goes on behind the last one that was finished. A file must come with the time of its arrival.

Formats are parsers registered by ending; DOCX is read by the standard library alone. A DOCX's pages are counted by its
page breaks, those it asks for and those its last rendering noted; sections are the path of headings above a
paragraph. Text and Markdown have one page, and Markdown's headings are sections.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, page int, section string, paragraph int, text string, reason string"
MAX_FILE_BYTES = 20 * 1024 * 1024
#: A packed document may unfold to so many bytes at most.
MAX_XML_BYTES = 400 * 1024 * 1024
PART_BYTES, FILES_A_BATCH = 64 << 20, 1000
BETWEEN = " / "


class Refused(Exception):
    """A file that can't be read; its message is the reason."""


@dataclass
class Headings:
    """The path of headings above the place that was reached."""

    stack: list[tuple[int, str]]

    def __init__(self) -> None:
        self.stack = []

    def enter(self, level: int, title: str) -> None:
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, title))

    @property
    def path(self) -> str:
        return BETWEEN.join(title for _, title in self.stack)


#: A parser takes a file's bytes and gives (page, section, text) of each paragraph in order.
Parser = Callable[[bytes], Iterator[tuple[int, str, str]]]
ATX = re.compile(r"[ ]{0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def _text(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise Refused("damaged") from None


def parse_text(content: bytes) -> Iterator[tuple[int, str, str]]:
    for line in re.split(r"\r\n?|\n", _text(content)):
        if line.strip():
            yield 1, "", line


def parse_markdown(content: bytes) -> Iterator[tuple[int, str, str]]:
    """Lines that hold something; headings are sections, but not inside fences."""
    headings, fenced = Headings(), False
    for line in re.split(r"\r\n?|\n", _text(content)):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        found = None if fenced else ATX.match(line)
        if found:
            headings.enter(len(found[1]), found[2])
        if line.strip():
            yield 1, headings.path, line


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SKIPPED = {"{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback", f"{_W}moveFrom", f"{_W}del"}


def _levels(archive: zipfile.ZipFile) -> dict[str, int]:
    """Outline levels from 1 of the document's paragraph styles, their parents' included."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    own, parent = {}, {}
    for style in ET.fromstring(_unpacked(archive, "word/styles.xml")).iter(f"{_W}style"):
        name, outline, based = style.find(f"{_W}name"), style.find(f"{_W}pPr/{_W}outlineLvl"), style.find(f"{_W}basedOn")
        ident, title = style.get(f"{_W}styleId", ""), name.get(f"{_W}val", "") if name is not None else ""
        heading = re.fullmatch(r"heading ([1-9])", title.lower())
        if outline is not None and outline.get(f"{_W}val", "9").isdigit():
            own[ident] = int(outline.get(f"{_W}val", "9")) + 1
        elif heading:
            own[ident] = int(heading[1])
        if based is not None:
            parent[ident] = based.get(f"{_W}val", "")
    out = {}
    for ident in {*own, *parent}:
        at, seen = ident, set()
        while at not in own and at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        if own.get(at, 10) < 10:
            out[ident] = own[at]
    return out


def _unpacked(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MAX_XML_BYTES:
        raise Refused("size")
    content = archive.read(name)
    if b"<!DOCTYPE" in content[:4096]:
        raise Refused("damaged")
    return content


class _Docx:
    """A walk through a document's body that keeps the page and the headings."""

    def __init__(self, levels: dict[str, int]):
        self.levels, self.page, self.headings = levels, 1, Headings()
        #: Whether a break was just asked for, which a rendering notes once more, and whether a paragraph was seen.
        self.asked, self.begun = False, False

    def turn(self) -> None:
        self.page += 1
        self.asked = True

    def paragraph(self, p: ET.Element) -> Iterator[tuple[int, str, str]]:
        style, outline = p.find(f"{_W}pPr/{_W}pStyle"), p.find(f"{_W}pPr/{_W}outlineLvl")
        level = self.levels.get(style.get(f"{_W}val", "")) if style is not None else None
        if outline is not None and outline.get(f"{_W}val", "9").isdigit():
            level = int(outline.get(f"{_W}val", "9")) + 1
        before = p.find(f"{_W}pPr/{_W}pageBreakBefore")
        if self.begun and before is not None and before.get(f"{_W}val", "1") not in ("0", "false", "off"):
            self.turn()
        self.begun = True
        parts: list[str] = []
        inner: list[tuple[int, str, str]] = []
        start = None

        def walk(node: ET.Element) -> None:
            nonlocal start
            for child in node:
                kind = child.tag
                if kind in _SKIPPED or kind == f"{_W}pPr":
                    continue
                if kind == f"{_W}t" and child.text:
                    start = self.page if start is None else start
                    self.asked = False
                    parts.append(child.text)
                elif kind == f"{_W}tab":
                    parts.append("\t")
                elif kind == f"{_W}br" and child.get(f"{_W}type") == "page":
                    self.turn()
                elif kind in (f"{_W}br", f"{_W}cr"):
                    parts.append("\n")
                elif kind == f"{_W}noBreakHyphen":
                    parts.append("-")
                elif kind == f"{_W}lastRenderedPageBreak":
                    self.page += not self.asked
                    self.asked = False
                elif kind == f"{_W}p":
                    inner.extend(self.paragraph(child))
                else:
                    walk(child)

        walk(p)
        text = "".join(parts)
        if text.strip():
            if level is not None and level < 10:
                self.headings.enter(level, " ".join(text.split()))
            yield start or self.page, self.headings.path, text
        yield from inner
        section = p.find(f"{_W}pPr/{_W}sectPr")
        if section is not None:
            kind = section.find(f"{_W}type")
            if kind is None or kind.get(f"{_W}val") not in ("continuous", "nextColumn"):
                self.turn()

    def body(self, node: ET.Element) -> Iterator[tuple[int, str, str]]:
        for child in node:
            if child.tag == f"{_W}p":
                yield from self.paragraph(child)
            elif child.tag not in _SKIPPED:
                yield from self.body(child)


def parse_docx(content: bytes) -> Iterator[tuple[int, str, str]]:
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":  # an encrypted package, or a kind from before DOCX
        raise Refused("encrypted" if "EncryptedPackage".encode("utf-16-le") in content else "damaged")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        if any(i.flag_bits & 1 for i in archive.infolist()):
            raise Refused("encrypted")
        root = ET.fromstring(_unpacked(archive, "word/document.xml"))
        walk = _Docx(_levels(archive))
        yield from walk.body(root)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, EOFError, NotImplementedError, ValueError, RecursionError, OSError) as e:
        raise Refused("damaged") from e
    except Exception as e:  # the unpacker's own errors have no common kind
        if type(e).__module__ in ("zlib", "lzma", "bz2"):
            raise Refused("damaged") from e
        raise


PARSERS: dict[str, Parser] = {"txt": parse_text, "md": parse_markdown, "docx": parse_docx}


def paragraphs_of(path: str, content: bytes, parsers: dict[str, Parser] = PARSERS) -> list[tuple]:
    """All rows of a file: (path, page, section, paragraph, text, reason). A file that fails midway gives its reason alone."""
    refused = lambda reason: [(path, None, None, None, None, reason)]
    parser = parsers.get(path.rpartition(".")[2].lower())
    if parser is None:
        return refused("type")
    if not content:
        return refused("empty")
    if len(content) > MAX_FILE_BYTES:
        return refused("size")
    try:
        return [(path, page, section, k, text, None) for k, (page, section, text) in enumerate(parser(content))] or refused("empty")
    except Refused as e:
        return refused(str(e))


@dataclass
class Part(InputPartition):
    """Files that one task reads: paths and sizes."""

    files: list[tuple[str, int]]


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time, path, size) of all files under a folder, hidden ones left out."""
    import pyarrow.fs as fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if store.get_file_info(root).type != fs.FileType.File else [store.get_file_info(root)]
    hidden = lambda p: any(x.startswith((".", "_")) for x in p.removeprefix(root).split("/"))
    return sorted((i.mtime_ns or 0, i.path, i.size or 0) for i in found if i.type == fs.FileType.File and not hidden(i.path))


def _dealt(files: list[tuple[int, str, int]], part_bytes: int) -> list[Part]:
    """Files in parts of about so many bytes; a part has one file at least."""
    parts, held = [], 0
    for _, path, size in files:
        if not parts or held + size > part_bytes:
            parts.append(Part([]))
            held = 0
        parts[-1].files.append((path, size))
        held += size
    return parts


def _rows(part: Part, root: str) -> Iterator[tuple]:
    import pyarrow.fs as fs

    store = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()
    for path, size in part.files:
        if size > MAX_FILE_BYTES:  # not even opened
            yield (path, None, None, None, None, "size")
            continue
        try:
            with store.open_input_stream(path) as file:
                content = file.read()
        except FileNotFoundError:
            continue
        yield from paragraphs_of(path, content)


class _Batch(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Part]:
        return _dealt(_files(self.path), self.part_bytes) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(partition, self.path)


class _Stream(DataSourceStreamReader):
    """Offsets are places in the files' order by time and path; what is planned is kept by Spark's checkpoint."""

    def __init__(self, path: str, part_bytes: int, files_a_batch: int):
        self.path, self.part_bytes, self.files_a_batch = path, part_bytes, files_a_batch
        self.at: tuple[int, str] | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        at = self.at or (-1, "")
        later = [f for f in _files(self.path) if f[:2] > at][: self.files_a_batch]
        if later:
            self.at = later[-1][:2]
        return {"time": self.at[0], "path": self.at[1]} if self.at else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        self.at = max(self.at or high, high)
        return _dealt([f for f in _files(self.path) if low < f[:2] <= high], self.part_bytes)

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(partition, self.path)

    def commit(self, end: dict) -> None:
        pass


class OriginalsSource(DataSource):
    """Options: path (a file or folder, in any store that Arrow opens), part_bytes, files_a_batch."""

    @classmethod
    def name(cls) -> str:
        return "originals"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)), int(self.options.get("files_a_batch", FILES_A_BATCH)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OriginalsSource)
