"""Line dedup: drop lines that many documents hold, except in one of them.

Lines are counted by a 128-bit hash of their key. The lines that may be dropped are put into a sharded
minimal perfect hash: a shard maps each of its n keys to one of n places, where a fingerprint, the count
and the document that keeps the line are stored in plain arrays. Lines in fewer documents are not in it: they are
counted before, and the answer for them is that they stay.

The most frequent lines, a fixed number, are one shard that every task holds: what many documents share is
answered where the texts are read, and does not leave there. Digests of the other lines, and not the lines, go to the shard that would
hold them, which answers with the places of lines that go. Every shard is read once, whatever the number of
shards, and a task holds one at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .arrow import rows, sized, small

NULL_ID = -(2**63)
_ARRAYS = ("bits", "fingerprints", "counts", "keepers")
_INDEX = "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary, keepers binary"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_key(line: bytes) -> bytes:
    """The line without space and U+0009 to U+000D at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 ^ ((h2 + np.uint64(level)) * _M1)
    x = (x ^ (x >> np.uint64(31))) * _M2
    return (x ^ (x >> np.uint64(29))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: level by level, keys alone in their bit are placed, the others go on."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - 1
        self.starts = np.cumsum([0, *sizes])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(h1):
            size = 2 * len(h1)
            at = _place(h1, h2, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each key; other keys get any place, or -1."""
        out = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _place(h1[todo], h2[todo], level, size).astype(np.int64)
            here = self.bits[at]
            out[todo[here]] = self.ranks[at[here]]
            todo = todo[~here]
        return out


class Shard:
    """A perfect hash of keys, with what is stored for each."""

    def __init__(self, ph: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.ph, self.prints, self.counts, self.keepers = ph, prints, counts, keepers

    @classmethod
    def build(cls, table: pa.Table) -> Shard:
        """Of rows (h1, h2, n, keeper)."""
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        ph = PerfectHash.build(h1, h2)
        place = ph.find(h1, h2)
        prints, counts, keepers = np.empty(len(h1), np.uint64), np.empty(len(h1), np.uint32), np.empty(len(h1), np.int64)
        prints[place], counts[place], keepers[place] = h2, np.minimum(table.column("n").to_numpy(), 2**32 - 1), table.column("keeper").to_numpy()
        return cls(ph, prints, counts, keepers)

    def pack(self) -> tuple[list[int], bytes, bytes, bytes, bytes]:
        return self.ph.sizes, np.packbits(self.ph.bits).tobytes(), self.prints.tobytes(), self.counts.tobytes(), self.keepers.tobytes()

    @classmethod
    def unpack(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, keepers: bytes) -> Shard:
        held = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        return cls(PerfectHash(sizes, held), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(keepers, np.int64))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeper) of each key; count 0 where the shard does not have it."""
        count, keeper = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
        if len(self.prints) and len(h1):
            place = self.ph.find(h1, h2)
            hit = (place >= 0) & (self.prints[place] == h2)
            count[hit], keeper[hit] = self.counts[place[hit]], self.keepers[place[hit]]
        return count, keeper


def _build(table: pa.Table) -> pa.Table:
    """One shard's row of the index from its (shard, h1, h2, n, keeper) rows."""
    sizes, *arrays = Shard.build(table).pack()
    schema = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in _ARRAYS)])
    return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), "sizes": sizes, **dict(zip(_ARRAYS, arrays, strict=True))}], schema)


def _digests(least: int):
    def run(batches):
        for batch in small(batches):
            ids, parts = [], []
            for i, text in rows(batch, "id", "text"):
                own = {xxhash.xxh3_128_digest(key) for key in map(line_key, text.split(b"\n")) if _long(key, least)}
                parts += own
                ids += [i] * len(own)
            h = np.frombuffer(b"".join(parts), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "id"])

    return run


def _shard_of(shards: int) -> Column:
    """h1 modulo shards, as of an unsigned number."""
    return F.pmod(F.pmod(F.shiftrightunsigned("h1", 1), F.lit(shards)) * 2 + F.col("h1").bitwiseAND(F.lit(1)), F.lit(shards)).cast("int")


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, hot_keys: int = 1 << 16, shard_keys: int = 250_000) -> tuple[Shard, int, DataFrame | None]:
    """(shard of the hot_keys most frequent lines, number of other shards, their table) of lines with enough characters and documents."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    found = keyed.mapInArrow(_digests(least_chars), "h1 long, h2 long, id long")
    counted = stage(found.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs), "frequent_lines")
    rank = (F.col("n").desc(), F.col("h1"), F.col("h2"))
    hot = counted.orderBy(*rank).limit(hot_keys).toArrow()  # hot_keys rows at most
    keys = counted.count() - hot.num_rows
    if not keys:
        return Shard.build(hot), 0, None
    rest = counted
    if hot.num_rows:
        n, h1, h2 = (hot.column(c)[-1].as_py() for c in ("n", "h1", "h2"))
        rest = counted.where((F.col("n") < n) | (F.col("n") == n) & ((F.col("h1") > h1) | (F.col("h1") == h1) & (F.col("h2") > h2)))
    shards = math.ceil(keys / shard_keys)
    return Shard.build(hot), shards, stage(rest.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInArrow(_build, _INDEX), "line_index")


def _places(hot, least: int):
    """(h1, h2, id, th, line) of the lines that are long enough and that the hot shard does not have."""

    def run(batches):
        shard = hot.value
        for batch in small(batches):
            ths = batch.column("th").to_pylist()
            parts, out = [], []
            for (i, text), th in zip(rows(batch, "id", "text"), ths, strict=True):
                for j, key in enumerate(map(line_key, text.split(b"\n"))):
                    if _long(key, least):
                        parts.append(xxhash.xxh3_128_digest(key))
                        out.append((i, th, j))
            h = np.ascontiguousarray(np.frombuffer(b"".join(parts), ">i8").reshape(-1, 2).astype(np.int64).T)
            at = np.array(out, np.int64).reshape(-1, 3)
            other = shard.find(*h.view(np.uint64))[0] == 0
            h, at = h[:, other], at[other]
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), *(pa.array(at[:, c]) for c in range(3))], ["h1", "h2", "id", "th", "line"])

    return run


def _answers(batches):
    """(id, th, line) of the lines that go; rows come sorted by shard, the shard's own row first."""
    shard, held = None, None
    for batch in batches:
        owner, first = batch.column("shard").to_numpy(), batch.column("sizes").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, np.flatnonzero(first), np.flatnonzero(first) + 1, [len(owner)]]))
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if first[lo]:
                shard, held = owner[lo], Shard.unpack(*(batch.column(c)[lo].as_py() for c in ("sizes", *_ARRAYS)))
            elif owner[lo] == shard:
                h1, h2, ids, ths, at = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("h1", "h2", "id", "th", "line"))
                count, keeper = held.find(h1.view(np.uint64), h2.view(np.uint64))
                gone = (count > 0) & (keeper != ids)
                yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (ids, ths, at)], ["id", "th", "line"])


def _sharded(keyed: DataFrame, hot, shards: int, index: DataFrame, least: int) -> DataFrame:
    """Staged (id, th, lines) of the documents that lose lines of the index's shards; keyed has id, th, text."""
    found = keyed.mapInArrow(_places(hot, least), "h1 long, h2 long, id long, th long, line long").withColumn("shard", _shard_of(shards))
    both = index.unionByName(found, allowMissingColumns=True)
    own = F.col("sizes").isNull()
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", own)
    gone = dealt.mapInArrow(_answers, "id long, th long, line long")
    return stage(gone.groupBy("id", "th").agg(F.collect_set("line").alias("lines")), "dropped_lines")  # a document's own lines


def _drop(hot, least: int):
    def run(batches):
        shard = hot.value
        for batch in small(batches):
            texts, owner, at, parts = [], [], [], []
            for i, (_, text) in enumerate(rows(batch, "id", "text")):
                texts.append(text.split(b"\n"))
                for j, key in enumerate(map(line_key, texts[-1])):
                    if _long(key, least):
                        owner.append(i)
                        at.append(j)
                        parts.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(parts), ">u8").reshape(-1, 2).astype(np.uint64)
            count, keeper = shard.find(h[:, 0], h[:, 1])
            ids = [NULL_ID if i is None else i for i in batch.column("id").to_pylist()]
            own = np.array(ids, np.int64)[np.array(owner, np.int64)] if owner else np.zeros(0, np.int64)
            gone = {i: set(js) for i, js in enumerate(batch.column("lines").to_pylist()) if js}
            for k in np.flatnonzero((count > 0) & (keeper != own)).tolist():
                gone.setdefault(owner[k], set()).add(at[k])
            lines = [len(x) for x in texts]
            for i, js in gone.items():
                texts[i] = [x for j, x in enumerate(texts[i]) if j not in js]
            dropped = [len(gone.get(i, ())) for i in range(len(texts))]
            text = pa.array([b"\n".join(x) for x in texts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), text, *batch.columns[3:]], ["id", "n_lines", "n_dropped", "text", *batch.schema.names[3:]])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), least_chars: int = 20, least_docs: int = 3, hot_keys: int = 1 << 16, shard_keys: int = 250_000) -> DataFrame:
    """(id, n_lines, n_dropped, text) of each row, with the columns of carry as c0, c1 and so on.

    Texts are split at U+000A; a null or empty text is one empty line. A line whose key (see line_key) has at
    least least_chars code points and occurs in at least least_docs documents is dropped, except in the
    document with the largest id that holds it. Rows that share an id count as one document; a null id
    counts as smallest, and all rows with a null id as one document. If all lines go, the text is empty. An empty
    table gives no rows. hot_keys and shard_keys settle where lines are looked up, not what is found.
    """
    hot, shards, index = line_index(docs, id_col, text_col, least_chars, least_docs, hot_keys, shard_keys)
    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    types = "id long, n_lines long, n_dropped long, text string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[2:])
    extra = [f"c{i}" for i in range(len(carry))]
    held = docs.sparkSession.sparkContext.broadcast(hot)  # hot_keys keys at most
    if shards:
        key, th = F.coalesce("id", F.lit(NULL_ID)), F.xxhash64("text")
        gone = _sharded(taken.select(key.alias("id"), th.alias("th"), "text"), held, shards, index, least_chars).withColumnsRenamed({"id": "gone_id", "th": "gone_th"})
        taken = taken.join(sized(gone), (key == F.col("gone_id")) & (th == F.col("gone_th")), "left").select("id", "text", "lines", *extra)
    else:  # there is no other shard that could be asked
        taken = taken.select("id", "text", F.lit(None).cast("array<long>").alias("lines"), *extra)
    return taken.mapInArrow(_drop(held, least_chars), types)


def op8(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
