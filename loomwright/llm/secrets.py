"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every text that the rule
matches satisfies it. Documents are indexed in segments of a fixed number of bytes: a segment's index maps
every trigram of bytes, A-Z in lower case, to the posting list of the documents that contain it. A query is
answered by intersecting and uniting postings; the rule's expression then runs on the candidates alone. A
rule whose expression has no mandatory trigram scans every document.

A scan builds and searches segments where the texts are read, so nothing is shuffled and a lost executor
costs the segments it held. build_index stores the same segments as a table, in which candidates of rules that
were not known then can be sought without reading a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product
from re import _constants as C, _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .arrow import rows

Query = tuple | str | None  #: ("and", ...) or ("or", ...) of queries, a trigram, or None: every document


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least least characters; base rules are counted one by one."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules, in the order that breaks ties, and the rules added to them.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


# ---- Boolean trigram queries


def _and(parts: Iterable[Query]) -> Query:
    got = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not got else got[0] if len(got) == 1 else ("and", *got)


def _or(parts: Iterable[Query]) -> Query:
    got = list(dict.fromkeys(parts))
    return None if None in got else got[0] if len(got) == 1 else ("or", *got)


def _of_strings(strings: set[str]) -> Query:
    """Every text that contains one of the strings satisfies it."""
    return _or(_and(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)) if strings else None


_FEW = 64  # strings that what stands before may end with
_CLASS = 16  # characters of a class that is written out


def _letters(items) -> set[str] | None:
    """The characters of a class, in lower case; None if they are many or not ASCII."""
    spans = [(a, a) if o is C.LITERAL else a if o is C.RANGE else None for o, a in items]
    if None in spans or any(hi > 127 for _, hi in spans):
        return None
    found = {chr(c).lower() for lo, hi in spans for c in range(lo, hi + 1)}
    return found if len(found) <= _CLASS else None


def _walk(node, exact: set[str], known: list[Query]) -> set[str]:
    """exact: the strings that what stands before may end with; adds to known what is mandatory."""

    def extend(options: set[str] | None) -> set[str]:
        if options is not None and len(exact) * len(options) <= _FEW:
            return {a + b for a, b in product(exact, options)}
        known.append(_of_strings(exact))
        return options if options is not None and len(options) <= _FEW else {""}

    for op, arg in node:
        if op is C.LITERAL:
            exact = extend({chr(arg).lower()} if arg < 128 else None)
        elif op is C.SUBPATTERN:
            exact = _walk(arg[3], exact, known)
        elif op is C.IN:
            exact = extend(_letters(arg))
        elif op is C.BRANCH:
            branches = []
            for b in arg[1]:
                own: list[Query] = []
                ends = _walk(b, set(exact), own)
                branches.append((_and(own), ends))
            if all(own is None for own, _ in branches) and sum(len(e) for _, e in branches) <= _FEW:
                exact = set().union(*(e for _, e in branches))
            else:
                known.append(_or(_and([own, _of_strings(e)]) for own, e in branches))
                exact = {""}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1):
            own = []
            ends = _walk(arg[2], {""}, own)
            exact = extend(ends | {""} if all(q is None for q in own) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            for _ in range(min(arg[0], 3)):
                exact = _walk(arg[2], exact, known)
            if arg[1] != arg[0]:
                exact = extend(None)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            exact = extend(None)
    return exact


def trigram_query(pattern: str) -> Query:
    """What the trigrams of every text with a match satisfy, A-Z in lower case; None if no trigram is mandatory.

    Case may be ignored for ASCII alone, as in (?ai:...).
    """
    known: list[Query] = []
    ends = _walk(P.parse(pattern), {""}, known)
    return _and([*known, _of_strings(ends)])


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


# ---- segments


@dataclass(frozen=True)
class Segment:
    """The inverted index of n texts: the distinct trigrams, ascending, where the postings of each start, and the postings."""

    n: int
    grams: np.ndarray
    starts: np.ndarray
    postings: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes], step: int = 1 << 20) -> Segment:
        data = np.frombuffer(b"".join(texts).lower(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        keys = [np.zeros(0, np.uint64)]
        for lo in range(0, len(data), step):
            x = data[lo : lo + step + 2].astype(np.uint64)
            if len(x) > 2:
                owner = np.searchsorted(ends, np.arange(lo, lo + len(x)), "right")
                gram = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
                keys.append(np.unique((gram << np.uint64(32) | owner[:-2].astype(np.uint64))[owner[:-2] == owner[2:]]))
        key = keys[1] if len(keys) == 2 else np.unique(np.concatenate(keys))
        gram = (key >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.diff(gram, prepend=np.uint32(2**32 - 1)))
        return cls(len(texts), gram[starts], np.append(starts, len(key)), key.astype(np.uint32))

    def posting(self, gram: str) -> np.ndarray:
        """Places of the texts, ascending, that contain a trigram."""
        code = int.from_bytes(gram.encode(), "big")
        at = int(np.searchsorted(self.grams, np.uint32(code)))
        if at == len(self.grams) or self.grams[at] != code:
            return np.zeros(0, np.int64)
        return self.postings[self.starts[at] : self.starts[at + 1]].astype(np.int64)

    def candidates(self, query: Query) -> np.ndarray:
        """Places of the texts, ascending, that satisfy a query."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.posting(query)
        parts = [self.candidates(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _segments(batches, segment_bytes: int):
    """(batch, first row, texts) of runs of rows of about segment_bytes of text, one row at least."""
    for batch in batches:
        texts, size, first = [], 0, 0
        for i, (_, text) in enumerate(rows(batch, "id", "text")):
            texts.append(text)
            size += len(text)
            if size >= segment_bytes:
                yield batch, first, texts
                texts, size, first = [], 0, i + 1
        if texts:
            yield batch, first, texts


def _scan(rules: tuple[Rule, ...], segment_bytes: int):
    queries = [trigram_query(r.pattern) for r in rules]

    def search(raw: list[bytes], compiled) -> list[list[dict]]:
        index, texts = Segment.build(raw), [t.decode() for t in raw]
        found: list[list[tuple]] = [[] for _ in texts]
        for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
            for i in index.candidates(query).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]

    def run(batches):
        # a run of one class that must be of some length is sought with that length: shorter runs need not be visited
        compiled = [re.compile(re.sub(r"^(\[[^\]]+\])\+$", rf"\1{{{r.least},}}", r.pattern) if not r.group else r.pattern) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, first, texts in _segments(batches, segment_bytes):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(texts)), pa.array(search(texts, compiled), kind)], ["id", "spans"])

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 1 << 20) -> DataFrame:
    """A staged table of segments: (ids, grams, starts, postings), the arrays of Segment as little-endian bytes.

    Every row of docs is in one segment; a null text is empty, a null id stays null. An empty table has no segments.
    """

    def run(batches):
        for batch, first, texts in _segments(batches, segment_bytes):
            index = Segment.build(texts)
            ids = pa.array([batch.column("id").slice(first, len(texts)).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((index.grams, "<u4"), (index.starts, "<i8"), (index.postings, "<u4")))], ["ids", "grams", "starts", "postings"])

    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stage(taken.mapInArrow(run, "ids array<long>, grams binary, starts binary, postings binary"), "trigram_index")


def index_candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(kind, id) of the rows of an index of build_index that satisfy each rule's trigram query."""
    queries = [(r.kind, trigram_query(r.pattern)) for r in rules]

    def run(batches):
        for batch in batches:
            for ids, *parts in zip(*(batch.column(c).to_pylist() for c in ("ids", "grams", "starts", "postings")), strict=True):
                held = Segment(len(ids), *(np.frombuffer(x, t) for x, t in zip(parts, ("<u4", "<i8", "<u4"), strict=True)))
                for kind, query in queries:
                    at = held.candidates(query).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array([ids[i] for i in at], pa.int64())], ["kind", "id"])

    return index.mapInArrow(run, "kind string, id long")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, segment_bytes: int = 1 << 20) -> DataFrame:
    """(id, spans) of every row: spans is an array of (kind, start, end), in code points of the text, end exclusive.

    Per rule the spans are the leftmost non-overlapping matches that are long enough, ordered by start, then
    as the rules are. Rules may overlap one another. A null text is empty and has no spans. Repeated rows are
    scanned each for itself; an empty table gives no rows; other columns are not read.
    """
    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return taken.mapInArrow(_scan(rules, segment_bytes), "id long, spans array<struct<kind:string,start:long,end:long>>")


def op2(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in RULES if r.base]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(of(base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: the text splits at the matches, so the lengths of pieces and matches give the places.

    What stands for a look behind is matched and then not counted: at most one character before eyJ.
    """
    quoted = pattern.replace("'", "''")
    ahead = "strpos(hit, 'eyJ') - 1" if kind == "jwt" else "0"
    return f"""
  SELECT doc_id, {order} AS ord, '{kind}' AS kind, start + {ahead} AS start, start + length(hit) AS stop FROM (
    SELECT doc_id, hit, sum(length(piece) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS start, long_enough FROM (
      SELECT doc_id, i, hits[i] AS hit, pieces[i] AS piece, CASE WHEN i > 1 THEN hits[i - 1] END AS before, length(groups[i]) >= {least} AS long_enough
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS groups, string_split_regex(t, '{quoted}') AS pieces FROM texts)))
  ) WHERE long_enough"""


def _op2_sql() -> str:
    either = "".join
    words = "|".join(either(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {"assign": rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""}
    patterns["jwt"] = next(r.pattern for r in RULES if r.kind == "jwt").replace("(?<![A-Za-z0-9_-])", "(?:^|[^A-Za-z0-9_-])")
    parts = [_sql_spans(r.kind, k, patterns.get(r.kind, r.pattern), r.group, r.least) for k, r in enumerate(RULES)]
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, ord) FILTER (ord < 3), '')) AS base_sha256,
  coalesce(string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, ord) FILTER (ord IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


OP2_SQL = _op2_sql()
