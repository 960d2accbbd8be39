"""Turtle files read in parts, by many tasks a file.

A part is a range of bytes, from line to line. Where it starts, only two things are not known: whether that is inside a long string, and
how many brackets are open. So a first pass over the parts tells, for either start, how the part ends, by how much the brackets change,
and where its first full stop is at each depth; it also gives the prefixes and bases it sets. Put together from part to part, a row of
small numbers each, this gives what holds at the start of every part. A part then has the statements that start behind its first full
stop outside brackets, up to that of the next part, and parses them with the prefixes that hold there.

Blank nodes without a name are numbered inside a part, and then by how many the parts before have, so that
the names are those that a single task would give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import stage
from .datasources import _PREFIX, _resolve, file_system, triples

_TRIPLE = "subject string, predicate string, object string, object_kind string, lang string, datatype string"
_LEX = re.compile(
    r"""(?P<long>\"{3})
    |"(?:[^"\\\n]|\\.)*"
    |<[^>\n]*>
    |\#[^\n]*
    |(?P<open>[\[(])|(?P<close>[\])])
    |[^\s"<\#\[\]().;,]+(?:\.[^\s"<\#\[\]().;,]+)*
    |(?P<stop>\.)
    |[\s;,<"]""",
    re.VERBOSE,
)
_AFTER_LONG = re.compile(r"@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]*:[\w.-]*\w)")
#: A mark in names that no file has: blank nodes as numbered inside a part.
_MARK = "\x00"
#: A setting of a prefix is read to its end, if that is so many bytes behind its part.
_AHEAD = 8192


def lines_between(path: str, start: int, end: int, ahead: int = 0) -> tuple[int, bytes, bytes]:
    """(place, bytes, more bytes) of the lines that start in a range of bytes, and of what follows them."""
    files, at = file_system(path)
    with files.open_input_file(at) as f:
        size = f.size()

        def line_start(place: int) -> int:
            if place <= 0 or place >= size:
                return min(max(place, 0), size)
            at = place - 1
            while at < size:
                held = f.read_at(min(65536, size - at), at)
                if (found := held.find(b"\n")) >= 0:
                    return at + found + 1
                at += len(held)
            return size

        first, last = line_start(start), line_start(end)
        held = f.read_at(min(last + ahead, size) - first, first) if last > first else b""
    return first, held[: last - first], held[last - first :]


def lexed(text: str, ahead: str, in_long: bool) -> dict:
    """How a part of a file ends if it starts in a long string or not: ends_in_long, depth (its change), stops and settings.

    stops has the place behind the first full stop for each depth, relative to the start's, of 0 or less; settings are (place, prefix or None for a
    base, iri). Places count code points.
    """
    at, depth, stops, settings = 0, 0, {}, []
    if in_long:
        at = text.find('"""')
        if at < 0:
            return {"ends_in_long": True, "depth": 0, "stops": {}, "settings": []}
        at += 3
        if m := _AFTER_LONG.match(text, at):
            at = m.end()
    whole = text + ahead
    while at < len(text):
        if text[at] in "@PpBb" and (m := _PREFIX.match(whole, at)) and m.start() == at:
            settings.append((at, m[1], m[2]))
            at = m.end()
            if whole[m.start() : at].rstrip().endswith(".") and at <= len(text) and depth <= 0:
                stops.setdefault(depth, at)
            continue
        m = _LEX.match(text, at)
        if m is None:
            raise ValueError(f"cannot read Turtle at {text[at:at + 40]!r}")
        at = m.end()
        if m["long"]:
            closed = text.find('"""', at)
            if closed < 0:
                return {"ends_in_long": True, "depth": depth, "stops": stops, "settings": settings}
            at = closed + 3
            if after := _AFTER_LONG.match(text, at):
                at = after.end()
        elif m["open"]:
            depth += 1
        elif m["close"]:
            depth -= 1
        elif m["stop"] and depth <= 0:
            stops.setdefault(depth, at)
    return {"ends_in_long": False, "depth": depth, "stops": stops, "settings": settings}


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            place, held, more = lines_between(r.path, r.start, r.end, _AHEAD)
            text, ahead = held.decode(), more.decode(errors="ignore")
            rows = []
            for in_long in (False, True):
                try:
                    out = lexed(text, ahead, in_long)
                except ValueError:  # a start that the file does not have here
                    continue
                size = lambda n: place + len(text[:n].encode())
                settings = [{"place": size(p), "prefix": name, "iri": iri} for p, name, iri in out["settings"]]
                rows.append((r.path, r.part, in_long, out["ends_in_long"], out["depth"], {d: size(p) for d, p in out["stops"].items()}, settings))
            yield pd.DataFrame(rows, columns=["path", "part", "in_long", "ends_in_long", "depth", "stops", "settings"])


_SCAN = "path string, part int, in_long boolean, ends_in_long boolean, depth int, stops map<int,long>, settings array<struct<place:long,prefix:string,iri:string>>"


def _own(scans: list, size: int) -> list[tuple]:
    """(start, end, prefixes, base) of what each part of a file parses: a row a part, put together in order."""
    by_start = {(r.part, r.in_long): r for r in scans}
    in_long, depth, cuts, settings = False, 0, [], []
    for part in range(1 + max(r.part for r in scans)):
        r = by_start.get((part, in_long))
        if r is None:
            raise ValueError(f"cannot read Turtle in part {part}")
        cuts.append(0 if part == 0 else (r.stops or {}).get(-depth))
        settings += r.settings or []
        in_long, depth = r.ends_in_long, depth + r.depth
    for part in range(len(cuts) - 1, -1, -1):  # a part without a full stop of its own leaves all to the one before
        cuts[part] = cuts[part] if cuts[part] is not None else cuts[part + 1] if part + 1 < len(cuts) else size
    out, known, base, at = [], {}, "", 0
    for start, end in zip(cuts, [*cuts[1:], size], strict=True):
        while at < len(settings) and settings[at].place < start:
            s = settings[at]
            if s.prefix is None:
                base = _resolve(base, s.iri)
            else:
                known = {**known, s.prefix: _resolve(base, s.iri)}
            at += 1
        out.append((start, end, known, base))
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _TRIPLE.split(", ")]
    for batch in batches:
        for r in batch.itertuples():
            files, at = file_system(r.path)
            with files.open_input_file(at) as f:
                text = f.read_at(r.end - r.start, r.start).decode() if r.end > r.start else ""
            found, rows, made = triples(text, dict(r.prefixes or {}), r.base, _MARK), [], 0
            while True:
                try:
                    rows.append(next(found))
                except StopIteration as done:
                    made = done.value
                    break
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=columns).assign(path=r.path, part=r.part, made=None)
                    rows = []
            yield pd.DataFrame([*rows, (None,) * 6], columns=columns).assign(path=r.path, part=r.part, made=[None] * len(rows) + [made])


def read_turtle(spark: SparkSession, path: str | list[str], part_bytes: int = 32 << 20) -> DataFrame:
    """(subject, predicate, object, object_kind, lang, datatype) of Turtle files, each read by as many tasks as it has parts.

    The same triples as of the data source "turtle", whatever part_bytes. What meets in the driver is a row a part, with the prefixes set in it.
    A line is read by one task, and so is a statement.
    """
    paths = [path] if isinstance(path, str) else list(path)
    sizes = {p: files.get_file_info(at).size or 0 for p in paths for files, at in [file_system(p)]}
    parts = [(p, i, start, min(start + part_bytes, sizes[p])) for p in paths for i, start in enumerate(range(0, sizes[p], part_bytes))]
    if not parts:
        return spark.createDataFrame([], _TRIPLE)
    tasks = min(len(parts), 4096)
    scans = spark.createDataFrame(parts, "path string, part int, start long, end long").repartition(tasks).mapInPandas(_scan, _SCAN).collect()
    own = [(p, i, *row) for p in paths if sizes[p] for i, row in enumerate(_own([s for s in scans if s.path == p], sizes[p]))]
    dealt = spark.createDataFrame(own, "path string, part int, start long, end long, prefixes map<string,string>, base string").repartition(tasks)
    found = stage(dealt.mapInPandas(_parse, f"{_TRIPLE}, path string, part int, made long"), "triples")
    made = {(r.path, r.part): r.made for r in found.where("made is not null").select("path", "part", "made").collect()}
    before = [(p, i, n) for p in paths for i, n in enumerate(accumulate((made.get((p, i), 0) for i in range(sum(q == p for q, _ in made))), initial=0))]
    offsets = F.broadcast(spark.createDataFrame(before, "path string, part int, before long"))  # a row a part
    name = lambda c: F.when(F.startswith(F.col(c), F.lit(_MARK)), F.concat(F.lit("_:anon"), (F.substring(F.col(c), 2, 20).cast("long") + F.col("before")).cast("string"))).otherwise(F.col(c)).alias(c)
    return found.where("made is null").join(offsets, ["path", "part"]).select(name("subject"), "predicate", name("object"), "object_kind", "lang", "datatype")
