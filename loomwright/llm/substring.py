"""Substring dedup: remove words of long spans that occur earlier in the corpus.

A window is a run of k consecutive words of one document. The minimiser of a window is the smallest hash
among its m-word grams. Consecutive windows that share a minimiser form a super-k-mer, and travel as one
string of their words to the minimiser's bucket, so that equal windows always meet. Within a bucket the
windows are sorted by hash and position, equality is verified on the words themselves, and every window
but the first of its kind is reported.

A minimiser that many different windows share would fill one bucket. Such hot minimisers are found on a fixed share
of the documents, and their windows are cut again by a second minimiser, of longer grams, into runs that go to
buckets of their own. As all tasks know the same list, equal windows still meet; the list settles only where.

Before they travel, equal super-k-mers of one chunk of documents are merged: all but the first hold only
repeated windows, which is known on the spot. A span that a large part of the corpus shares therefore
reaches its bucket once a chunk. Strings are packed by (chunk, bucket) and compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .arrow import rows

NULL_ID = -(2**63)
RANGES = "id long, th long, first long, last long"
_PACKED = "bucket int, n int, text binary, meta binary"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32))


def _mix(x: np.ndarray) -> np.ndarray:
    a, b, s = _MIX
    x = (x ^ (x >> s)) * b
    return (x ^ (x >> s)) * a


def _hashes(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words
    return pd.util.hash_array(out, categorize=False)


def _offsets(text: bytes) -> np.ndarray:
    """Where the words of a text with one space between words start, and where one more would."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, [len(text) + 1]])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive items, by joining runs of powers of two; len(h) - n + 1 values."""
    done, size, part, at = None, 0, h, 1
    while True:
        if n & at:
            done = part if done is None else _mix(done[: len(part) - size] * _MIX[0] + part[size:]) if size else part
            size += at
        at *= 2
        if at > n:
            return done[: len(h) - n + 1]
        half = at // 2
        part = _mix(part[:-half] * _MIX[0] + part[half:])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    part, at = x, 1
    while 2 * at <= n:
        part = np.minimum(part[:-at], part[at:])
        at *= 2
    return np.minimum(part[: len(x) - n + 1], part[n - at :]) if n > at else part


def super_kmers(words: list[bytes], doc: np.ndarray, k: int, m: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, key) of each super-k-mer of the documents in doc, which gives each word's document.

    The key is the minimiser; with one of hot, which is sorted, it is of this and the second minimiser.
    """
    if len(words) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _hashes(words)
    least = sliding_min(gram_hashes(h, m), k - m + 1)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
        n = max(m, k - _SECOND)
        second = sliding_min(_mix(gram_hashes(h, n) ^ _MIX[1]), k - n + 1)
        least = np.where(hot[at] == least, _mix(least * _MIX[0] + second), least)
    valid = doc[: len(least)] == doc[k - 1 :]
    joins = np.zeros(len(least), bool)
    joins[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1]) & (doc[1 : len(least)] == doc[: len(least) - 1])
    first = np.flatnonzero(valid & ~joins)
    ends = np.ones(len(least), bool)
    ends[:-1] = ~joins[1:]
    return first, np.flatnonzero(valid & ends), least[first]


_SECOND = 8  # words by which the grams of the second minimiser are shorter than a window
_SAMPLE = 64  # one in so many documents is looked at for hot minimisers
_MOST_HOT = 100_000  # of more, the largest are taken


def _weights(k: int, m: int, chunk_bytes: int):
    def run(batches):
        for chunk in _chunks(batches, chunk_bytes):
            words = [w for _, _, ws in chunk for w in ws]
            doc = np.repeat(np.arange(len(chunk)), [len(ws) for _, _, ws in chunk])
            first, last, least = super_kmers(words, doc, k, m)
            size = {(key, b" ".join(words[a : z + k])) for a, z, key in zip(first.tolist(), last.tolist(), least.tolist(), strict=True)}
            keys = np.array([key for key, _ in size], np.uint64)
            unique, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, np.array([len(x) for _, x in size], float), len(unique)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(total)], ["key", "bytes"])

    return run


def hot_minimisers(keyed: DataFrame, k: int, m: int, share: float, chunk_bytes: int) -> np.ndarray:
    """Sorted minimisers whose different strings have more than share bytes, as one in _SAMPLE documents tells; _MOST_HOT at most."""
    part = keyed.where(F.pmod(F.xxhash64("id", "th"), F.lit(_SAMPLE)) == 0)
    sums = part.mapInArrow(_weights(k, m, chunk_bytes), "key long, bytes long").groupBy("key").agg(F.sum("bytes").alias("bytes"))
    rows_ = sums.where(F.col("bytes") * _SAMPLE > share).orderBy(F.col("bytes").desc(), "key").limit(_MOST_HOT).select("key").toArrow()
    return np.sort(rows_.column("key").to_numpy().astype(np.int64).view(np.uint64))


def _pack(arrays: list[np.ndarray]) -> bytes:
    return zstandard.compress(np.ascontiguousarray(np.stack(arrays)).astype(np.int64).tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int64).reshape(-1, n)


def _chunks(batches, limit: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    chunk, size = [], 0
    for batch in batches:
        ths = batch.column("th").to_pylist()
        for (i, text), th in zip(rows(batch, "id", "text"), ths, strict=True):
            chunk.append((i, th, text.split()))
            size += len(text)
            if size >= limit:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _split(k: int, m: int, buckets: int, chunk_bytes: int, hot):
    def run(batches):
        held = hot.value
        for chunk in _chunks(batches, chunk_bytes):
            chunk.sort(key=lambda x: x[:2])
            words = [w for _, _, ws in chunk for w in ws]
            counts = np.array([len(ws) for _, _, ws in chunk])
            doc = np.repeat(np.arange(len(chunk)), counts)
            base = np.cumsum(counts) - counts
            ids, ths = (np.array([x[j] for x in chunk], np.int64) for j in (0, 1))
            first, last, least = super_kmers(words, doc, k, m, held)
            if not len(first):
                continue
            text = b" ".join(words)
            offset = _offsets(text)
            strings = [text[a:b] for a, b in zip(offset[first].tolist(), (offset[last + k] - 1).tolist(), strict=True)]
            at = doc[first]
            start = first - base[at]
            seen: dict[bytes, int] = {}
            heads = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
            again = (ids[at] > ids[at[heads]]) | (ids[at] == ids[at[heads]]) & (start > start[heads])
            same = (heads < np.arange(len(heads))) & (ids[at] == ids[at[heads]]) & (ths[at] == ths[at[heads]])
            bucket = ((_mix(least) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            out = []
            travel = np.flatnonzero(~again & ~same)
            travel = travel[np.argsort(bucket[travel], kind="stable")]
            for part in np.split(travel, np.flatnonzero(np.diff(bucket[travel])) + 1):
                if len(part):
                    packed = zstandard.compress(b"\n".join([strings[i] for i in part.tolist()]), 6)
                    a = at[part]
                    out.append((int(bucket[part[0]]), len(part), packed, _pack([ids[a], ths[a], start[part], last[part] - first[part] + k])))
            known = np.flatnonzero(again)
            if len(known):
                # neighbouring runs of one document are one range
                a, s, e = at[known], start[known], start[known] + last[known] - first[known]
                cut = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != e[:-1] + 1)) + 1
                lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]]) - 1
                out.append((int(ids[a[0]] % buckets), len(lo), None, _pack([ids[a[lo]], ths[a[lo]], s[lo], e[hi]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "text", "meta"])

    return run


def _repeated(strings: list[bytes], meta: np.ndarray, k: int) -> np.ndarray:
    """(id, th, first, last) of the runs of windows that also start earlier; meta has id, th, start and words of each string."""
    order = np.lexsort((meta[2], meta[1], meta[0]))
    ids, ths, start, n = meta[:, order]
    text = b" ".join([strings[i] for i in order.tolist()])
    words = text.split()
    ends = np.cumsum(n)
    inside = np.arange(len(words)) - np.repeat(ends - n, n)
    window = np.flatnonzero(inside <= np.repeat(n, n) - k)
    owner = np.repeat(np.arange(len(n)), n - k + 1)
    h = gram_hashes(_hashes(words), k)[window]
    by_hash = np.argsort(h, kind="stable")  # windows are in order of position, so the first of a kind comes first
    sorted_h = h[by_hash]
    opens = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
    head = by_hash[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    later = ~opens
    member, head = by_hash[later], head[later]
    offset = _offsets(text)
    lo, hi = offset[window], offset[window + k]
    equal = np.fromiter((text[a:b] == text[c:d] for a, b, c, d in zip((lo[member]).tolist(), (hi[member] - 1).tolist(), lo[head].tolist(), (hi[head] - 1).tolist(), strict=True)), bool, len(member))
    key = np.stack([ids[owner], start[owner] + inside[window]])
    gone = np.zeros(len(window), bool)
    gone[member] = equal & ((key[:, member] != key[:, head]).any(axis=0))
    kinds: dict[bytes, int] = {}
    for w in member[~equal].tolist():  # different windows with one hash
        first = kinds.setdefault(text[lo[w] : hi[w] - 1], w)
        gone[w] = bool((key[:, w] != key[:, first]).any())
    at = np.flatnonzero(gone)
    if not len(at):
        return np.empty((4, 0), np.int64)
    cut = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
    a, b = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]
    return np.stack([ids[owner[a]], ths[owner[a]], key[1, a], key[1, b]])


def _count(k: int):
    def run(table: pa.Table) -> pa.Table:
        strings, metas, out = [], [], []
        for n, text, meta in zip(*(table.column(c).to_pylist() for c in ("n", "text", "meta")), strict=True):
            if text is None:
                out.append(_unpack(meta, n))
            else:
                strings += zstandard.decompress(text).split(b"\n")
                metas.append(_unpack(meta, n))
        if strings:
            out.append(_repeated(strings, np.concatenate(metas, axis=1), k))
        found = np.concatenate(out, axis=1)
        return pa.table({c: pa.array(found[i], pa.int64()) for i, c in enumerate(("id", "th", "first", "last"))})

    return run


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 4, bucket_bytes: int = 8 << 20, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(id, th, first, last): ranges of window starts, in words from 0, of windows that also start earlier.

    th is the XXH64 of the text, which with the id tells rows apart. bucket_bytes is the size that a bucket
    of strings should have.
    """
    if not 1 <= m <= k:
        raise ValueError("m must be from 1 to k")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    spread = 1 + 2 * (k - 1) / (k - m + 2)  # words that travel for each word of the corpus
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * spread / bucket_bytes))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    hot = spark.sparkContext.broadcast(hot_minimisers(keyed, k, m, total * spread / buckets, chunk_bytes))  # _MOST_HOT numbers at most
    packed = keyed.mapInArrow(_split(k, m, buckets, chunk_bytes, hot), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_count(k), RANGES)


def _cut(k: int):
    def run(batches):
        for batch in batches:
            out = []
            for (_, text), ranges in zip(rows(batch, "id", "text"), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                if ranges:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [r["first"] for r in ranges], 1)
                    np.add.at(change, [r["last"] + k for r in ranges], -1)
                    kept = [w for w, c in zip(words, np.cumsum(change).tolist(), strict=False) if not c]
                else:
                    kept = words
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, gone, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "text"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 4) -> DataFrame:
    """(id, n_words, n_removed, text) of each row: the text without the words of windows that also start earlier.

    Words are runs of other than space and U+0009 to U+000D; the text that is left has one space between words.
    Earlier means a smaller id, or the same id and an earlier start; windows are judged on the input. A null
    text has no words. A null id counts as smallest. Rows that share an id count as one document: equal places
    in them do not remove each other. Other columns are not read. An empty table gives no rows.
    """
    ranges = repeated_ranges(docs, id_col, text_col, k, m)
    by_doc = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text_col).alias("th"))
    by_doc = by_doc.withColumnsRenamed({"id": "key"})
    return keyed.join(by_doc, ["key", "th"], "left").select("id", "text", "ranges").mapInArrow(_cut(k), "id long, n_words long, n_removed long, text string")


def op4(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS span FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d
), judged AS (
  SELECT w.doc_id, w.word, w.p, g.p IS NOT NULL AS gone FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p
), sums AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
