"""Vector compression by product codes, with codebooks by heap Lloyd.

Vectors are cut into equal parts, and each position has a codebook of its own. A part keeps, in the heap of its entry, a lower bound
of how much farther its second nearest entry is than its own, added to the drift the entry had then: how far it and the farthest
moving other entry have moved, over all rounds. While an entry's drift has not reached that key, the part's nearest entry
cannot have changed. So a round pops only those parts whose key the drift has reached, and compares them with all entries exactly;
the others are not looked at. Codes are those of plain Lloyd.

Heaps are local to a block of vectors, and travel from round to round as arrays in heap order: the key in fixed point, rounded
down, above the part's place. Vectors are written once, in blocks, and never shuffled; a round passes on codes and heaps, and sums
of the parts that changed their entry alone. What meets in the driver is the codebooks: parts x entries x width numbers.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .blocks import dense, usable, write_blocks

#: Components are held to this; larger ones count as this.
_MOST = float(2**52)
_LONG = 2**63 - 1
#: A heap's numbers: a key of 41 bits, in steps of 1 / 256, above a place of 22.
_PLACE, _KEYS, _STEPS = 22, 2**41 - 2, 256
_STATE = "file string, at long, n long, code binary, heap binary, sizes binary, part int, entry int, count long, sums array<decimal(38,0)>, popped long"


def integer_parts(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = 1024) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x); without vectors that are null or hold null or non-finite components."""
    v = F.transform(F.col(vector_col), lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale).cast("double"), F.lit(_MOST)), F.lit(-_MOST)))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return df.where(usable(df, vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def _is_exact(*arrays: np.ndarray) -> bool:
    """Whether squared distances are whole numbers that doubles hold."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return max(a.shape[-1] for a in arrays) * (2 * most) ** 2 < 2**52


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries; as Python's integers where doubles cannot hold them."""
    if _is_exact(x, book):
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    whole = np.frompyfunc(int, 1, 1)
    a, b = whole(x), whole(book)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1).astype(object)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack): the nearest entry, ties to the lower index; a lower bound of how much farther the second is."""
    entry, slack = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for lo in range(0, len(x), 4096):
        d = _squares(x[lo : lo + 4096], book)
        entry[lo : lo + len(d)] = at = d.argmin(axis=1)
        if d.shape[1] > 1:
            own, rows = d[np.arange(len(d)), at], np.arange(len(d))
            d[rows, at] = d.max() + 1
            u, far = (np.sqrt(y.astype(np.float64)) for y in (own, d.min(axis=1)))
            slack[lo : lo + len(d)] = far - u - 1e-9 * (far + u)
    return entry, slack


def _keys(slack: np.ndarray, drift: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((slack + drift) * _STEPS), 0, _KEYS).astype(np.int64) << _PLACE


def _round(reader, books: np.ndarray, drift: np.ndarray):
    """One assignment: books is parts x entries x width of a part, drift parts x entries."""
    parts, entries, own = books.shape
    limit = (np.minimum(np.ceil(drift * _STEPS), _KEYS).astype(np.int64) + 1) << _PLACE

    def one(x: np.ndarray, code: np.ndarray, heaps: list[list[int]], p: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, old entries) of what was popped; code and heaps are brought up to date."""
        if heaps:
            popped = []
            for heap, most in zip(heaps, limit[p].tolist(), strict=True):
                while heap and heap[0] < most:
                    popped.append(heappop(heap) & ((1 << _PLACE) - 1))
            at = np.array(popped, np.int64)
            entry, slack = _nearest(x[at], books[p])
            for key, e in zip((_keys(slack, drift[p][entry]) | at).tolist(), entry.tolist(), strict=True):
                heappush(heaps[e], key)
        else:
            at = np.arange(len(x))
            entry, slack = _nearest(x, books[p])
            keys = _keys(slack, drift[p][entry]) | at
            order = np.argsort(entry, kind="stable")
            heaps += [h.tolist() for h in np.split(keys[order], np.cumsum(np.bincount(entry, minlength=entries))[:-1])]
            for heap in heaps:
                heapify(heap)
        old = code[at].copy()
        code[at] = entry
        return at, old

    def run(batches):
        blocks = reader()
        sums, count, seen = np.zeros((parts, entries, own), object), np.zeros((parts, entries), np.int64), False
        for batch in batches:
            for row in batch.to_pylist():
                _, x = blocks.read(row["file"], row["at"])
                x = x.reshape(len(x), parts, own)
                first = row["code"] is None
                code = np.full((parts, len(x)), -1, np.int64) if first else np.frombuffer(row["code"], "<i2").reshape(parts, -1).astype(np.int64)
                sizes = np.zeros((parts, entries), np.int64) if first else np.frombuffer(row["sizes"], "<i4").reshape(parts, entries)
                flat = np.frombuffer(row["heap"] or b"", "<i8")
                ends, popped, kept = np.cumsum(sizes).reshape(parts, entries), 0, []
                for p in range(parts):
                    heaps = [] if first else [flat[e - s : e].tolist() for e, s in zip(ends[p], sizes[p], strict=True)]
                    at, old = one(x[:, p], code[p], heaps, p)
                    moved = at[code[p][at] != old]
                    was = old[code[p][at] != old]
                    popped += len(at)
                    part = np.zeros((entries, own)) if _is_exact(x) else np.zeros((entries, own), object)
                    y = x[moved, p] if part.dtype != object else np.frompyfunc(int, 1, 1)(x[moved, p])
                    np.add.at(part, code[p][moved], y)
                    np.subtract.at(part, was[was >= 0], y[was >= 0])
                    sums[p] += np.frompyfunc(int, 1, 1)(part)
                    count[p] += np.bincount(code[p][moved], minlength=entries) - np.bincount(was[was >= 0], minlength=entries)
                    kept.append(heaps)
                    seen |= len(moved) > 0
                now = [len(h) for heaps in kept for h in heaps]
                heap = np.concatenate([np.array(h, "<i8") for heaps in kept for h in heaps])
                state = [row["file"], row["at"], row["n"], code.astype("<i2").tobytes(), heap.tobytes(), np.array(now, "<i4").tobytes(), None, None, None, None, popped]
                yield pa.RecordBatch.from_pydict({f.name: pa.array([y], f.type) for f, y in zip(_ARROW, state, strict=True)}, schema=_ARROW)
        if seen:
            cells = [(p, e) for p in range(parts) for e in range(entries)]
            totals = [[Decimal(int(c)) for c in sums[p, e]] for p, e in cells]
            none, rows = [None] * len(cells), [[p for p, _ in cells], [e for _, e in cells], [int(count[c]) for c in cells], totals]
            yield pa.RecordBatch.from_pydict({f.name: pa.array(y, f.type) for f, y in zip(_ARROW, [none] * 6 + rows + [none], strict=True)}, schema=_ARROW)

    return run


_ARROW = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("code", pa.binary()), ("heap", pa.binary()), ("sizes", pa.binary()),
    ("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("popped", pa.int64()),
])


def _decide(reader, books: np.ndarray, label: pa.DataType):
    """(vec_id, label, code, error) of each row, the code as hex digits."""
    parts, _, own = books.shape

    def run(batches):
        blocks = reader()
        for batch in batches:
            for row in batch.to_pylist():
                columns, x = blocks.read(row["file"], row["at"])
                code = np.frombuffer(row["code"], "<i2").reshape(parts, -1)
                error = np.zeros(len(x), object)
                for p in range(parts):
                    mine, entry = x[:, p * own : (p + 1) * own], books[p][code[p]]
                    if not _is_exact(mine, entry):
                        mine, entry = (np.frompyfunc(int, 1, 1)(y) for y in (mine, entry))
                    error = error + np.frompyfunc(int, 1, 1)(((mine - entry) ** 2).sum(axis=1))
                digits = [f"{c:02x}" for c in range(books.shape[1])]
                text = ["".join(digits[c] for c in cs) for cs in code.T.tolist()]
                out = [columns.column("vec_id"), columns.column("label").cast(label), pa.array(text), pa.array([min(int(e), _LONG) for e in error], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "code", "error"])

    return run


class Codes:
    """Codebooks fitted on all vectors by rounds of heap Lloyd, and the vectors' codes.

    vectors is as of integer_parts. Each codebook starts as that part of the entries rows with the smallest vec_id (null ids last, ties by
    their vectors; fewer rows give fewer entries). A round assigns every part to its nearest entry (ties to the lower index), then makes each
    entry its parts' mean, rounded down; unused entries stay. Vectors are padded with zeros to the length of the longest, and that to a
    multiple of parts. Repeated rows count each. An empty table has codebooks without entries.
    books: parts x entries x width of a part. popped: how many parts each assignment has compared; the first compares all.
    """

    def __init__(self, vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, block_rows: int = 32768):
        most = F.max(F.aggregate("v", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c))))
        self.rows, longest, most = vectors.agg(F.count("*"), F.max(F.size("v")), most).first()
        self.width = parts * max(1, -(-(longest or 0) // parts)) if self.rows else parts
        self._label = vectors.schema["label"].dataType
        self.popped: list[int] = []
        self._bare = not longest
        if not self.rows:
            self.books = np.zeros((parts, 0, 1))
            self._found = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
            return
        first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(min(entries, 256)).select("v").toArrow()
        start = dense(first.column("v").combine_chunks(), self.width)
        self.books = np.ascontiguousarray(start.reshape(len(start), parts, self.width // parts).transpose(1, 0, 2))
        store = write_blocks(vectors, self.width, block_rows, number="<f4" if (most or 0) < 2**24 else "<f8")
        reader = store.reader()
        state = store.index.select("file", "at", "n", *[F.lit(None).cast("binary").alias(c) for c in ("code", "heap", "sizes")])
        drift = np.zeros(self.books.shape[:2])
        sums, count = np.zeros(self.books.shape, object), np.zeros(self.books.shape[:2], object)
        for k in range(rounds + 1):
            done = stage(state.mapInArrow(_round(reader, self.books, drift), _STATE), "codes")
            state = done.where("part is null")
            self.popped.append(state.agg(F.sum("popped")).first()[0])
            if k < rounds:
                drift = drift + self._update(done.where("part is not null"), sums, count)
        self._found = stage(state.mapInArrow(_decide(reader, self.books, self._arrow_label()), f"vec_id long, label {self._label.simpleString()}, code string, error long"), "decided")

    def _arrow_label(self) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(self._label)

    def _update(self, changed: DataFrame, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Move each entry to the mean of its parts; how far it and the farthest moving other have moved, rounded up."""
        cells = changed.groupBy("part", "entry").agg(F.sum("count").alias("n")).collect()
        for part, entry, n in cells:
            count[part, entry] += n
        axis = changed.select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col").alias("s")).where("s <> 0").collect()
        for part, entry, pos, s in axis:
            sums[part, entry, pos] += int(s)
        mean = np.frompyfunc(lambda s, n, was: s // n if n else int(was), 3, 1)(sums, count[:, :, None], self.books).astype(np.float64)
        moved = np.sqrt(((mean - self.books) ** 2).sum(axis=2)) * (1 + 1e-9)
        self.books = mean
        ranked = np.sort(moved, axis=1)
        top, next_top = ranked[:, -1:], ranked[:, -2:-1] if ranked.shape[1] > 1 else np.zeros((len(ranked), 1))
        return (moved + np.where(moved == top, np.where((moved == top).sum(axis=1, keepdims=True) > 1, top, next_top), top)) * (1 + 1e-9)

    def sha256(self) -> str:
        """Of all components of the entries, by part, entry and position."""
        numbers = [] if self._bare else self.books.ravel()
        return hashlib.sha256(",".join(str(int(c)) for c in numbers).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """(vec_id, label, code, error): two hex digits a part, and the squared distance to the coded vector, at most 2^63 - 1."""
        return self._found


def op11(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings. Empty tables give no rows; null labels are one label; rows with a null id are coded too."""
    fitted = Codes(integer_parts(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    codes = fitted.codes()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    labels = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(fitted.sha256()).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by recursion written out, a CTE for each assignment and each codebook."""
    nearest = """a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, any_value(x) AS x, min((xx - 2 * CAST(list_inner_product(x, c) AS BIGINT) + cc) * {entries} + entry) AS best
  FROM p JOIN (SELECT *, CAST(list_inner_product(c, c) AS BIGINT) AS cc FROM b{k}) USING (part) GROUP BY vec_id, label, part
)"""
    means = """b{n} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, b{k}.c) AS c FROM b{k} LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (
      SELECT part, best % {entries} AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL
    ) GROUP BY part, entry
  ) m USING (part, entry)
)"""
    steps = [part.format(k=k, n=k + 1, entries=entries) for k in range(rounds + 1) for part in (nearest, means)][:-1]
    return f"""
WITH v AS (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT *, CAST(list_inner_product(x, x) AS BIGINT) AS xx FROM (SELECT vec_id, label, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part))
), b0 AS MATERIALIZED (
  SELECT part, x AS c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)},
r AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
), h AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS sha FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM r, h
"""


OP11_SQL = _sql()
