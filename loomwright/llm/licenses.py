"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice that may differ in k edits is cut into k + 1 pieces: one of them stands unchanged in every match.
These exact seeds are sought in the text's words; around each, the regex library's fuzzy matching verifies
the notice and counts its edits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .arrow import rows

#: Base phrases, found where their words stand consecutively.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices, found with edits: label, text, most edits.
NOTICES = (
    ("mit", "under the mit license", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("apache-2", "apache license version 2", 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("gpl", "gnu general public license", 2),
    ("mpl", "mozilla public license", 2),
    ("cc-by-nc", "creative commons attribution noncommercial", 3),
    ("cc-by-sa", "creative commons attribution sharealike", 3),
)
#: A-Z are lower-cased, other ASCII than digits and letters separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    text: bytes
    edits: int

    def seeds(self) -> list[tuple[int, bytes]]:
        """(offset, piece) of edits + 1 pieces of nearly equal length."""
        cut = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]

    def pattern(self):
        return regex.compile(b"(?b)(?:" + regex.escape(self.text) + b"){e<=%d}" % self.edits)


def normal(text: bytes) -> tuple[bytes, int]:
    """(the words with one space before, between and after, their number)."""
    words = text.translate(_WORDS).split()
    return b" " + b"".join(w + b" " for w in words), len(words)


def found_at(norm: bytes, sought: bytes) -> list[int]:
    """Where sought stands in norm, overlapping places included."""
    out, at = [], norm.find(sought)
    while at >= 0:
        out.append(at)
        at = norm.find(sought, at + 1)
    return out


def fuzzy_places(norm: bytes, notice: Notice, seeds, pattern, cache: dict[bytes, tuple | None] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, edits) in norm of the matches around each seed, from left to right, without overlap.

    A match has its exact seed in it, so seeds within what is already matched are passed over, as are seeds whose
    matches would lie in a window in which there is none. cache keeps what was found in windows of the same bytes.
    """
    cache = {} if cache is None else cache
    at = sorted({(max(0, hit - offset - notice.edits), hit) for offset, seed in seeds for hit in found_at(norm, seed)})
    out, after, empty = [], 0, -1
    for lo, hit in at:
        if hit < after or lo <= empty:
            continue
        start = max(lo, after)
        window = norm[start : start + len(notice.text) + 4 * notice.edits]
        if window not in cache:
            if len(cache) >= _CACHED:
                cache.clear()
            m = pattern.search(window)
            cache[window] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
        if found := cache[window]:
            out.append((start + found[0], start + found[1], found[2]))
            after, empty = out[-1][1], -1
        else:
            empty = start + notice.edits
    return out


_CACHED = 4096  # windows of a notice, each of about its length
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64()), ("chars", pa.int64())]))


def _scan(phrases, notices):
    def run(batches):
        ready = [(n, n.seeds(), n.pattern(), {}) for n in notices]
        for batch in batches:
            counts, found = [], []
            for _, text in rows(batch, "id", "text"):
                norm, n = normal(text)
                spans, blanks = [], None

                def word(places: list[int]) -> list[int]:
                    """Blanks before each place: the number of the word that follows, if it is a blank itself."""
                    nonlocal blanks
                    if blanks is None:
                        blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
                    return np.searchsorted(blanks, places).tolist()

                for phrase, label in phrases:
                    if at := found_at(norm, b" " + phrase.encode() + b" "):
                        length = phrase.count(" ")
                        spans += [{"label": label, "base": True, "first": w, "last": w + length, "edits": 0, "chars": len(phrase)} for w in word(at)]
                for notice, seeds, pattern, cache in ready:
                    if at := fuzzy_places(norm, notice, seeds, pattern, cache):
                        firsts = word([a + (norm[a : a + 1] == b" ") for a, _, _ in at])
                        lasts = word([b - (norm[b - 1 : b] == b" ") for _, b, _ in at])
                        spans += [{"label": notice.label, "base": False, "first": f - 1, "last": z - 1, "edits": e, "chars": len(notice.text)} for (_, _, e), f, z in zip(at, firsts, lasts, strict=True)]
                counts.append(n)
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(found, _SPANS)], ["id", "n_words", "spans"])

    return run


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(id, n_words, spans) of every row.

    spans is an array of (label, base, first, last, edits, chars): first and last are the numbers of the words,
    from 0, between which the phrase or notice of so many characters stands with so many edits; base marks the
    exact phrases. A null text is empty and has no words. Repeated rows are scanned each for itself; an empty table
    gives no rows; other columns are not read.
    """
    ready = [Notice(label, text.encode(), edits) for label, text, edits in notices]
    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return taken.mapInArrow(_scan(phrases, ready), "id long, n_words long, spans array<struct<label:string,base:boolean,first:long,last:long,edits:long,chars:long>>")


def op9(spark, sf_dir: str) -> DataFrame:
    out = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    at = F.transform("base", lambda s: s["first"])
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / s["chars"]))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels(F.col("base")).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"))


def license_phrases(spark, sf_dir: str) -> DataFrame:
    """What of op9 is exact: (doc_id, n_words, n_base, first_word, last_word, base_labels) of every document."""
    return op9(spark, sf_dir).drop("labels", "score")


LICENSE_PHRASES_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
  SELECT string_split(phrase, ' ') AS ph, label FROM (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')) t(phrase, label)
), f AS (
  SELECT doc_id, label, unnest([i FOR i IN range(len(ws)) IF ws[i + 1] = ph[1] AND ws[i + 1:i + len(ph)] = ph]) AS place FROM d, p
), g AS (
  SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
