"""Filters, joins, unions and deduplication of fact tables and their dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordinals import number_in_groups


def keep_or_exclude(df: DataFrame, filters: Mapping[str, Mapping]) -> DataFrame:
    """Rows that pass every filter {column: {"mode": "keep" or "exclude", "values": [...]}}.

    Rows with a null are kept by exclude, and dropped by keep unless None is among the values.
    """
    for name, rule in filters.items():
        values = [v for v in rule["values"] if v is not None]
        member = F.when(F.col(name).isNull(), F.lit(None in rule["values"])).otherwise(F.col(name).isin(values))
        df = df.where(member if rule["mode"] == "keep" else ~member)
    return df


def select_folds(df: DataFrame, folds: str | Sequence[str], column: str = "split") -> DataFrame:
    """Rows of one fold or several."""
    return df.where(F.col(column).isin([folds] if isinstance(folds, str) else list(folds)))


def require_non_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the columns; columns that df does not have are ignored."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(subset=present) if present else df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, after a check, which runs at once, that no key occurs twice."""
    found = duplicates(df, keys).limit(3).collect()
    if found:
        raise ValueError(f"keys are not unique: {found}")
    return df


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row by order of each key: a partial aggregation, so no key's rows meet in one task."""
    names = df.columns
    first = F.min_by(F.struct(*names), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first.alias("_row")).select(*[F.col("_row")[n].alias(n) for n in names])


def priority_union(sources: Mapping[str, DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Union of sources, given in order of priority, with the first row of each key.

    Adds source and a boolean column of each source's name; columns that a source lacks are null.
    """
    out = None
    for rank, (name, df) in enumerate(sources.items()):
        flags = {n: F.lit(n == name) for n in sources}
        part = df.withColumns({"source": F.lit(name), **flags, "_rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return first_wins(out, [key], ["_rank", *order]).drop("_rank")


def with_suffix(df: DataFrame, taken: Sequence[str], suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """df with suffix on the columns that are taken, but for keep."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in taken and c not in keep})


def join_composite(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_split_duplicate", same_size: bool = False) -> DataFrame:
    """Inner join on several keys; clashing columns of the right side get the suffix. same_size checks row counts at once."""
    if same_size and (sizes := (left.count(), right.count()))[0] != sizes[1]:
        raise ValueError(f"row counts differ: {sizes}")
    return left.join(with_suffix(right, left.columns, suffix, keys), list(keys))


def star_join(facts: DataFrame, dimensions: Mapping[str, tuple[DataFrame, str, str]], check_unique: bool = False) -> DataFrame:
    """Facts with the columns of their dimensions; {name: (dimension, fact key, dimension key)}.

    Facts without a partner go. The dimension's key is left out, and columns that clash get _name. Spark
    broadcasts a dimension if its size allows, so none is hinted.
    """
    for name, (dimension, fact_key, key) in dimensions.items():
        if check_unique:
            assert_unique(dimension, [key])
        renamed = with_suffix(dimension.where(F.col(key).isNotNull()), facts.columns, f"_{name}", [key]).withColumnRenamed(key, f"_key_{name}")
        facts = facts.join(renamed, F.col(fact_key) == F.col(f"_key_{name}")).drop(f"_key_{name}")
    return facts


def only_known(facts: DataFrame, dimension: DataFrame, fact_key: str, key: str, null_safe: bool = False) -> DataFrame:
    """Facts whose key the dimension has; with null_safe, null matches null."""
    known = dimension.select(F.col(key).alias("_known")).distinct()
    match = F.col(fact_key).eqNullSafe(F.col("_known")) if null_safe else F.col(fact_key) == F.col("_known")
    return facts.join(known, match, "left_semi")


def load_by_key(samples: DataFrame, table: DataFrame, sample_key: str, table_key: str) -> DataFrame:
    """Samples with the columns of the table's row of their key; a key without a row fails when it is read."""
    found = table.withColumns({"_found": F.lit(True)}).withColumnRenamed(table_key, "_table_key")
    joined = samples.join(found, F.col(sample_key) == F.col("_table_key"), "left")
    missing = F.raise_error(F.concat(F.lit("no row for key "), F.coalesce(F.col(sample_key).cast("string"), F.lit("null"))))
    return joined.withColumn(sample_key, F.when(F.col("_found"), F.col(sample_key)).otherwise(missing)).drop("_found", "_table_key")


def get_single(df: DataFrame, **keys) -> DataFrame:
    """The one row with the keys; checked at once."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    if (n := df.limit(2).count()) != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} row for {keys}")
    return df


def dominant_share(df: DataFrame, group: Sequence[str], value: str, least_rows: int = 8, most_share: float = 0.5) -> DataFrame:
    """(group, rows, share) of the groups with enough rows in which no value has more than a share of them."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*group).agg(F.sum("n").alias("rows"), (F.max("n") / F.sum("n")).alias("share"))
    return sums.where((F.col("rows") >= least_rows) & (F.col("share") <= most_share))


def on_distinct(df: DataFrame, column: str, function, out: str) -> DataFrame:
    """df with function, from a DataFrame of (column) to one of (column, out), applied once for each distinct value."""
    values = function(df.select(column).where(F.col(column).isNotNull()).distinct())
    return df.join(values, column, "left")


def indices_per_class(df: DataFrame, label: str, index: str) -> DataFrame:
    """(label, ordinal, index): the indices of each class, numbered from 0 in their order. Classes may be as large as the table."""
    return number_in_groups(df.select(label, index), label, [index]).select(label, "ordinal", index)
