"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of each window of w consecutive k-gram hashes the smallest is kept as a fingerprint, so that texts that share
k + w - 1 words in a row share a fingerprint. With k + w - 1 set to the length of a benchmark window, no shared
window can be missed. The benchmark's fingerprints are also set in a bit table of bounded size, a constant of the
plan: where a document's fingerprint may be among them, the hit is extended to its whole window of words on the spot.
These windows, and not the texts, are then joined with the benchmark's on fingerprint and words.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .arrow import sized

NULL_ID = -(2**63)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    held = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(held) == F.char_length(held), F.lower(held)).otherwise(F.translate(held, ascii_uppercase, ascii_lowercase))  # lower() is faster, but not for A-Z alone
    return F.array_remove(F.split(low, SEPARATORS), "")


def _grams(n: int) -> tuple[int, int]:
    """k and w for windows of n words: k is the same for most n, so that its grams serve several."""
    k = min(n, 5) if n < 12 else n // 2
    return k, n - k + 1


def _indices(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def with_minima(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df, which has words, with m<n> for each n of lengths: the smallest k-gram hash of each window of n words."""
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    for k in sorted({_grams(n)[0] for n in lengths} - {1}):
        df = _with_grams(df, k)
    for n in lengths:
        df = _with_windows(df, n, *_grams(n))
    return df.drop(*[c for c in df.columns if c[0] == "g" and c[1:].isdigit()])


def _with_grams(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn(f"g{k}", F.transform(_indices(F.size("words") - (k - 1)), lambda i: F.xxhash64(*[F.get("g1", i + j) for j in range(k)])))


def _with_windows(df: DataFrame, n: int, k: int, w: int) -> DataFrame:
    if w == 1:
        return df.withColumn(f"m{n}", F.col(f"g{k}"))
    return df.withColumn(f"m{n}", F.transform(_indices(F.size("words") - (n - 1)), lambda i: F.least(*[F.get(f"g{k}", i + j) for j in range(w)])))


def key_of(id_col: str, text_col: str) -> list[Column]:
    """Columns that tell documents apart: the id, the smallest long for null, and the text's XXH64."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text_col).alias("th")]


def benchmark_windows(items: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> tuple[list[int], DataFrame]:
    """(lengths, table of (item, n, fp, span)): every window of n words of every item; shorter items are one window of all their words."""
    cut = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    cut = stage(cut.withColumn("n", F.least(F.size("words"), F.lit(window))), "items")
    lengths = [r.n for r in cut.select("n").distinct().orderBy("n").collect()]  # at most `window` of them
    parts = []
    for n in lengths:
        own = with_minima(cut.where(F.col("n") == n), [n])
        spans = F.arrays_zip(F.col(f"m{n}").alias("fp"), _indices(F.size(f"m{n}")).alias("i"))
        each = own.select("item", "n", "words", F.explode(spans).alias("x"))
        parts.append(each.select("item", "n", "x.fp", F.array_join(F.slice("words", F.col("x.i") + 1, F.col("n")), " ").alias("span")))
    if not parts:
        return [], items.sparkSession.createDataFrame([], "item long, n int, fp long, span string")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return lengths, stage(out.distinct(), "benchmark_windows")


class BitTable:
    """Which of 64-bit hashes may be in a set: a Bloom filter of at most MOST_BITS bits, as a foldable array of longs.

    With more hashes than it is made for it lets more others pass, and still every one of the set. Its size is bounded as
    it is a constant of the plan; what it lets pass is a matter of cost alone.
    """

    PROBES, PER_HASH, MOST_BITS = (0, 14, 28, 42), 16, 1 << 24

    def __init__(self, hashes: DataFrame, column: str):
        bits = 1 << max(12, (hashes.count() * self.PER_HASH - 1).bit_length())
        self.words = min(bits, self.MOST_BITS) // 64
        at = F.explode(F.array(*[self._place(F.col(column), shift) for shift in self.PROBES])).alias("at")
        set_bits = hashes.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
        table = [0] * self.words
        for r in set_bits.collect():  # a row a word
            table[r.word] = r.bits
        self.table = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def _place(self, h: Column, shift: int) -> Column:
        return F.shiftright(h, shift).bitwiseAND(F.lit(64 * self.words - 1).cast("long"))

    def may_have(self, h: Column) -> Column:
        def one(shift: int) -> Column:
            at = self._place(h, shift)
            word = F.get(self.table, F.shiftright(at, 6).cast("int"))
            return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

        out = one(self.PROBES[0])
        for shift in self.PROBES[1:]:
            out = out & one(shift)
        return out


def leaky_documents(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged (id, key, th, n_words) of every row, and (key, th, n_hit, items) of those that have a benchmark window; see find_leaks.

    key is the id, the smallest long for null.
    """
    lengths, bench = benchmark_windows(items, window, item_col, item_text_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), *key_of(id_col, text_col), words(F.col(text_col)).alias("words"))
    if not lengths:
        return own.select("id", "key", "th", F.size("words").cast("long").alias("n_words")), docs.sparkSession.createDataFrame([], "key long, th long, n_hit long, items array<string>")
    fps = stage(bench.select("fp").distinct(), "benchmark_fingerprints")
    known = BitTable(fps, "fp")
    may = lambda m: F.filter(F.array_distinct(m), known.may_have)
    near = F.concat(*[may(f"m{n}") for n in lengths])
    scanned = stage(with_minima(own, lengths).select("id", "key", "th", F.size("words").cast("long").alias("n_words"), near.alias("fps")), "scanned")
    met = scanned.select("key", "th", F.explode("fps").alias("fp")).join(fps, "fp", "left_semi").select("key", "th").distinct()
    texts = docs.select(*key_of(id_col, text_col), F.col(text_col).alias("text"))
    among = texts.join(sized(stage(met, "met")), ["key", "th"]).select("key", "th", words(F.col("text")).alias("words"))
    wide = with_minima(among, lengths)
    for n in lengths:
        wide = _with_spans(wide, n, known)
    extended = wide.select("key", "th", F.explode(F.concat(*[F.col(f"s{n}") for n in lengths])).alias("s")).select("key", "th", "s.i", "s.n", "s.fp", "s.span")
    spans = stage(bench.select("fp", "span").distinct(), "benchmark_spans")
    found = stage(extended.join(spans, ["fp", "span"]).select("key", "th", "i", "n", "span"), "leaks")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("i", "n"))),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0), x["i"] + x["n"] - F.greatest(x["i"], acc["end"]))).alias("sum"), F.greatest(acc["end"], x["i"] + x["n"]).alias("end")),
        lambda acc: acc["sum"].cast("long"),
    )
    n_hit = found.groupBy("key", "th").agg(covered.alias("n_hit"))
    of_items = found.select("key", "th", "span").distinct().join(bench.select("span", F.col("item").cast("string").alias("item")), "span").where("item is not null")
    named = of_items.select("key", "th", "item").distinct().groupBy("key", "th").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return scanned, stage(n_hit.join(named, ["key", "th"], "left"), "leaky_documents")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, th, n_words, n_hit, items) of every row of docs.

    n_hit is the number of words that lie in an occurrence of a benchmark window, items the sorted array of
    the items, as strings, that have one. th is the XXH64 of the text; with the id it tells rows apart, and
    equal rows get equal results. Null and empty texts have no words. Items without words match nothing; a null
    item id is not listed. Rows with a null id keep it. Other columns are not read. An empty table gives no rows, and without items nothing is hit.
    """
    scanned, leaky = leaky_documents(docs, items, window, id_col, text_col, item_col, item_text_col)
    out = scanned.join(leaky, ["key", "th"], "left")
    return out.select("id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_leaks(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns of whatever names, that have no benchmark window; null and empty texts have none.

    An empty table gives no rows, and all rows stay if there are no items.
    """
    _, leaky = leaky_documents(docs, items, window, id_col, text_col, item_col, item_text_col)
    own_key, own_th = (_unused(docs, c) for c in ("key", "th"))
    leaky = sized(stage(leaky.select(F.col("key").alias(own_key), F.col("th").alias(own_th)), "leaky_keys"))
    key, th = key_of(id_col, text_col)
    return docs.join(leaky, (key == F.col(own_key)) & (th == F.col(own_th)), "left_anti")


def _unused(df: DataFrame, name: str) -> str:
    """The name, with as many _ behind it as no column of df has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _with_spans(df: DataFrame, n: int, known: BitTable) -> DataFrame:
    """df with s<n>: (i, n, fp, span) of the windows whose fingerprint may be known."""
    at = F.filter(_indices(F.size(f"m{n}")), lambda i: known.may_have(F.get(f"m{n}", i)))
    return df.withColumn(f"s{n}", F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), F.get(f"m{n}", i).alias("fp"), F.array_join(F.slice("words", i + 1, n), " ").alias("span"))))


def op3(spark, sf_dir: str) -> DataFrame:
    out = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, ws, least(len(ws), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS span FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b)
), lengths AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS span FROM (SELECT d.*, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths)
), found AS (
  SELECT dw.*, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span
), hit AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
