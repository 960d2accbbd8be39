"""Python data sources: FFindex/FFdata blobs and Turtle triples."""

from __future__ import annotations

import re
from collections.abc import Generator
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_system(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _open(path: str):
    files, at = file_system(path)
    return files.open_input_file(at)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FFDataReader(DataSourceReader):
    def __init__(self, options: dict):
        self.data, self.index = options["path"], options.get("index") or re.sub(r"ffdata$", "ffindex", options["path"])
        self.each = int(options.get("index_bytes", 1 << 20))

    def partitions(self):
        files, at = file_system(self.index)
        size = files.get_file_info(at).size or 0
        return [_Range(i, min(i + self.each, size)) for i in range(0, size, self.each)] or [_Range(0, 0)]

    def read(self, partition):
        entries = sorted(self._entries(partition.start, partition.end), key=lambda e: e[1])
        if entries:
            with _open(self.data) as f:
                for name, offset, length in entries:
                    yield name, f.read_at(length - 1, offset).decode().split("\n")

    def _entries(self, start: int, end: int) -> list[tuple[int, ...]]:
        """(name, offset, length) of the index's lines that start in a range of its bytes."""
        with _open(self.index) as f:
            before = min(start, 1)
            text = f.read_at(end - start + before, start - before)
            while not text.endswith(b"\n") and (more := f.read_at(256, start - before + len(text))):
                text += more[: more.find(b"\n") + 1] or more
        if before:
            text = text[text.find(b"\n") + 1 :] if b"\n" in text[: end - start + 1] else b""  # an earlier range has the rest of its line
        return [tuple(map(int, line.split(b"\t"))) for line in text.splitlines() if line.strip()]


class FFDataSource(DataSource):
    """(name, lines) of the entries of a blob; options: path, index if it is not named alike, and index_bytes.

    A task reads index_bytes of the index and the entries that these name; the driver reads neither file.
    """

    @classmethod
    def name(cls):
        return "ffdata"

    def schema(self):
        return "name long, lines array<string>"

    def reader(self, schema):
        return FFDataReader(self.options)


_PREFIX = re.compile(r"\s*(?:@?prefix\s+([\w-]*):|@?base)\s*<([^>]*)>(?:\s*\.)?", re.IGNORECASE)
_TERM = re.compile(
    r"""\s*(?:
    (?P<comment>\#[^\n]*)
    |<(?P<iri>[^>]*)>
    |(?:\"{3}(?P<long>(?s:.*?))\"{3}|"(?P<short>(?:[^"\\\n]|\\.)*)")(?:@(?P<lang>[A-Za-z-]+)|\^\^(?P<kind><[^>]*>|[\w-]*:[\w.-]*))?
    |(?P<blank>_:[\w.-]*\w)
    |(?P<number>[+-]?\d+(?:\.\d+)?(?P<power>[eE][+-]?\d+)?)
    |(?P<name>[\w-]*:(?:[\w.%-]*[\w%-])?)
    |(?P<word>(?:a|true|false)\b)
    |(?P<mark>[.;,\[\]()])
    )""",
    re.VERBOSE,
)
#: Names of the types of bare literals, and of what "a" and collections stand for.
_XSD, _RDF = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r"}


def _resolve(base: str, iri: str) -> str:
    return urljoin(base, iri) + "#" * iri.endswith("#") if base else iri  # an empty fragment is lost in joining


def triples(text: str, prefixes: dict[str, str] | None = None, base: str = "", anonymous: str = "_:anon") -> Generator[tuple, None, int]:
    """(subject, predicate, object, object_kind, lang, datatype) of a Turtle text; returns the number of blank nodes it named.

    Nested nodes and the cells of collections are blank nodes of their own, _:anon0 and so on. The names of blank
    nodes hold inside their file. prefixes and base are those known before the text.
    """
    prefixes = dict(prefixes or {})
    told: list = []  # subject and predicate so far, or the members of a collection
    outer: list[list] = []  # the same of the brackets around
    kinds: list[str] = []
    made = at = 0

    def full(name: str) -> str:
        prefix, _, rest = name.partition(":")
        return prefixes[prefix] + rest

    def blank() -> str:
        nonlocal made
        made += 1
        return f"{anonymous}{made - 1}"

    while True:
        term = None
        if m := _PREFIX.match(text, at):
            if m[1] is None:
                base = _resolve(base, m[2])
            else:
                prefixes[m[1]] = _resolve(base, m[2])
        elif m := _TERM.match(text, at):
            t = m.groupdict()
            mark = t["mark"]
            if mark in ("[", "("):
                outer.append(told)
                kinds.append(mark)
                told = [blank()] if mark == "[" else []
            elif mark in ("]", ")"):
                if not kinds or kinds.pop() + mark not in ("[]", "()"):
                    raise ValueError(f"cannot parse Turtle at {text[at:at + 40]!r}")
                inside, told = told, outer.pop()
                if mark == "]":
                    term = (inside[0], "blank", None, None)
                else:
                    cells = [blank() for _ in inside] + [_RDF + "nil"]
                    for cell, member, rest in zip(cells, inside, cells[1:], strict=False):
                        yield cell, _RDF + "first", *member
                        yield cell, _RDF + "rest", rest, "iri" if rest == cells[-1] else "blank", None, None
                    term = (cells[0], "blank" if inside else "iri", None, None)
            elif mark:
                told = {".": [], ";": told[:1], ",": told}[mark]
            elif not t["comment"]:
                term = _term(t, full, base)
        else:
            break
        if term and kinds and kinds[-1] == "(":
            told.append(term)
        elif term and len(told) == 2:
            yield (*told, *term)
        elif term:
            told = [*told, term[0]]
        at = m.end()
    if text[at:].strip() or kinds:
        raise ValueError(f"cannot parse Turtle at {text[at:at + 40]!r}")
    return made


def _term(t: dict, full, base: str) -> tuple:
    text = t["long"] if t["long"] is not None else t["short"]
    if text is not None:
        kind = t["kind"]
        value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text)
        return value, "literal", t["lang"], kind and (kind[1:-1] if kind[0] == "<" else full(kind))
    if t["number"]:
        return t["number"], "literal", None, _XSD + ("double" if t["power"] else "decimal" if "." in t["number"] else "integer")
    if t["word"] in ("true", "false"):
        return t["word"], "literal", None, _XSD + "boolean"
    if t["blank"]:
        return t["blank"], "blank", None, None
    return (_resolve(base, t["iri"]) if t["iri"] is not None else _RDF + "type" if t["word"] else full(t["name"])), "iri", None, None


class TurtleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with _open(partition.value) as f:
            yield from triples(f.read().decode())


class TurtleSource(DataSource):
    """(subject, predicate, object, object_kind, lang, datatype) of Turtle files; option path, several separated by commas."""

    @classmethod
    def name(cls):
        return "turtle"

    def schema(self):
        return "subject string, predicate string, object string, object_kind string, lang string, datatype string"

    def reader(self, schema):
        return TurtleReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FFDataSource)
    spark.dataSource.register(TurtleSource)
