"""Line records: text with ordinals, delimited tables, SMILES, FASTA, SDF.

Records are read by Spark's text reader with the format's own separator, so files are split as usual. Ordinals are
given before any shuffle, from the order of files and of records in them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def numbered(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """df, which comes straight from files, with the record's number from 0, in the order of the files' paths and of records in them.

    Counts the records of each part of a file in a pass of its own; only one row a part is gathered.
    """
    at = F.monotonically_increasing_id()
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), at.alias("_at"))
    counts = marked.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a part of a file
    starts = counts.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = marked.join(F.broadcast(starts), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return out.withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).drop("_file", "_block", "_at", "_f", "_b", "_first", "_start")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row_idx, line): lines without their ends, whole; row_idx from 0."""
    return numbered(spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))).select("row_idx", "line")


def read_table(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, separator: str = "\t", expected: int | None = None, rename: dict[str, str] | None = None, prefix: str = "") -> DataFrame:
    """All-string table with row_idx; the first line has the names unless columns are given.

    Refuses repeated names and another than the expected number of columns. Blanks, commas and quotes are plain
    characters. A line with another number of fields fails when it is read.
    """
    if columns is None:
        first = spark.read.text(path).limit(1).collect()
        columns = first[0].value.rstrip("\r").split(separator) if first else []
        skip = True
    else:
        skip = False
    if len(set(columns)) != len(columns):
        raise ValueError(f"column names repeat: {columns}")
    if expected is not None and len(columns) != expected:
        raise ValueError(f"{len(columns)} columns, {expected} expected")
    lines = read_lines(spark, path)
    if skip:
        lines = lines.where(F.col("line") != separator.join(columns)) if isinstance(path, list) else lines.where("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1)
    parts = F.split("line", f"\\Q{separator}\\E")
    wrong = F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("line")))
    fields = F.when(F.size(parts) == len(columns), parts).otherwise(wrong.cast("array<string>"))
    named = [f"{prefix}{(rename or {}).get(c, c)}" for c in columns]
    return lines.withColumn("f", fields).select("row_idx", *[F.col("f")[i].alias(n) for i, n in enumerate(named)])


def read_typed(spark: SparkSession, path: str | list[str], schema: T.StructType | str, separator: str = "\t", header: bool = True, skip_malformed: bool = False) -> DataFrame:
    """A delimited table of declared types; a line with another number of fields, or with other types, fails or is skipped.

    Every field of a line is parsed for this, whichever columns are used.
    """
    mode = "DROPMALFORMED" if skip_malformed else "FAILFAST"
    df = spark.read.csv(path, sep=separator, header=header, schema=schema, mode=mode, enforceSchema=True)
    return df.where(F.hash(*df.columns) <= 2**31 - 1)  # always so, but it needs every column


def read_smiles(spark: SparkSession, path: str, columns: Sequence[str] | None = ("smiles_string", "smiles_id")) -> DataFrame:
    """(row_idx, smiles_string, smiles_id) of a tab-separated file, without a header unless columns is None."""
    return read_table(spark, path, columns)


def read_fasta(spark: SparkSession, path: str | list[str], identifier: Column | None = None) -> DataFrame:
    """(row_idx, id, comment, sequence, header). id and comment are the header up to its first blank and the rest; identifier, a column of header, replaces id."""
    records = spark.read.text(path, lineSep="\n>").where("trim(value) <> ''")
    lines = F.split(F.regexp_replace("value", "^>|\r", ""), "\n")
    parsed = numbered(records.select(F.rtrim(lines[0]).alias("header"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "").alias("sequence")))
    names = F.split("header", " ", 2)
    return parsed.select("row_idx", (names[0] if identifier is None else identifier).alias("id"), F.when(F.size(names) > 1, F.get(names, 1)).alias("comment"), "sequence", "header")


def uniprot_accession(header: Column) -> Column:
    """The second of the fields between vertical bars."""
    return F.get(F.split(header, r"\|"), 1)


def author_chain(description: Column) -> Column:
    """The author's chain id of a chain list: after the first blank, up to a comma, what follows 'auth ', or the first character."""
    chosen = F.substring_index(F.regexp_extract(description, r"^\S+\s(.*)$", 1), ",", 1)
    auth = F.regexp_extract(chosen, r"auth (.)", 1)
    return F.when(auth != "", auth).otherwise(F.substring(chosen, 1, 1))


def read_sdf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row_idx, title, molblock, props) of the records between lines of four dollar signs."""
    records = numbered(spark.read.text(path, lineSep="$$$$\n").select(F.regexp_replace("value", "\r", "").alias("value")).where("trim(replace(value, '$$$$', '')) <> ''"))
    body = F.regexp_extract("value", r"(?s)^(.*?M  END)", 1)
    items = F.regexp_extract_all("value", F.lit(r"(?m)^> +<[^>\n]+>[^\n]*\n(?:[^\n]+\n?)*"), F.lit(0))
    pair = lambda x: F.struct(F.regexp_extract(x, r"<([^>\n]+)>", 1).alias("k"), F.trim(F.regexp_replace(x, r"^[^\n]*\n", ""), F.lit("\n")).alias("v"))
    props = F.aggregate(F.transform(items, pair), F.expr("cast(map() as map<string,string>)"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))
    return records.select("row_idx", F.trim(F.substring_index("value", "\n", 1)).alias("title"), body.alias("molblock"), props.alias("props"))


def read_nested(spark: SparkSession, path: str, schema: T.StructType | str, array: str) -> DataFrame:
    """The elements of an array of JSON documents, a column for each of their fields."""
    return spark.read.json(path, schema=schema, multiLine=True).select(F.explode(array).alias("p")).select("p.*")


def label_from_name(path: Column) -> Column:
    """0 for a file whose name has neg, else 1 for pos."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("neg"), 0).when(name.contains("pos"), 1)


def with_source(df: DataFrame) -> DataFrame:
    """df, a file scan, with the file of each row."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_labelled_fasta(spark: SparkSession, labels: dict[str, dict]) -> DataFrame:
    """The records of several FASTA files, each with constant columns: {path: {column: value}}; columns a file lacks are null."""
    out = None
    for path, values in labels.items():
        part = read_fasta(spark, path).withColumns({c: F.lit(v) for c, v in values.items()})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_index(records: DataFrame, path: str, key: str = "id", partitions: int = 8) -> DataFrame:
    """Records as Parquet sorted by key, the first of each key; read_key() then reads few row groups."""
    first = records.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*records.columns), "row_idx").alias("r")).select("r.*")
    first.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return records.sparkSession.read.parquet(path)


def read_key(index: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The record of a key, or no row; the condition reaches the Parquet scan."""
    return index.where(F.col(key) == value)
