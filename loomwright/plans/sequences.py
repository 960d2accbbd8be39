"""Queries of sequence functions, labels and tokens; names of parts and texts stand for sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, sequences as Q, tables, vectors
from ..operators import text as T
from .registry import query, table

_SEQ = "regexp_replace(upper(p_name), '[^A-Z]', '', 'g')"


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", Q.normalise(F.col("p_name")).alias("seq"))


@query("seq_normalize", "SELECT doc_id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]', '', 'g') AS seq FROM documents")
def seq_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.normalise(F.col("text")).alias("seq"))


@query("ascii_strip", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM documents")
def ascii_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.ascii_only(F.col("text")).alias("text"))


@query("augment_flip", f"SELECT p_partkey, CASE WHEN ('0x' || substr(md5('flip:3:' || p_partkey), 1, 8))::BIGINT < 2147483648 THEN reverse({_SEQ}) ELSE {_SEQ} END AS seq FROM part")
def augment_flip(spark, d):
    return _parts(spark, d).select("p_partkey", Q.flip(F.col("seq"), F.col("p_partkey"), 3).alias("seq"))


#: The draw of an element, numbered from 1 in SQL and from 0 in the columns.
def _d(salt: str, key: str) -> str:
    return f"('0x' || substr(md5('{salt}:0:' || {key} || ':' || (i - 1)), 1, 8))::BIGINT"


@query("augment_noise", f"SELECT p_partkey, array_to_string([CASE WHEN {_d('noise', 'p_partkey')} < 429496729 THEN substr('ACDEFGHIKLMNPQRSTVWY', ({_d('letter', 'p_partkey')} % 20 + 1)::BIGINT, 1) ELSE c END FOR c, i IN string_split({_SEQ}, '')], '') AS seq FROM part")
def augment_noise(spark, d):
    return _parts(spark, d).select("p_partkey", Q.noise(F.col("seq"), F.col("p_partkey"), 0.1).alias("seq"))


@query("augment_site_noise", f"""
SELECT s_suppkey, array_to_string([CASE WHEN c <= 'Z' AND {_d('noise', 's_suppkey')} < 858993459 THEN substr('ACDEFGHIKLMNPQRSTVWY', ({_d('letter', 's_suppkey')} % 20 + 1)::BIGINT, 1)
  WHEN c > 'Z' AND {_d('noise', 's_suppkey')} < 214748364 THEN lower(substr('ACDEFGHIKLMNPQRSTVWY', ({_d('letter', 's_suppkey')} % 20 + 1)::BIGINT, 1)) ELSE c END FOR c, i IN string_split(s_name, '')], '') AS seq FROM supplier
""")
def augment_site_noise(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", Q.site_noise(F.col("s_name"), F.col("s_suppkey"), 0.05, 0.2).alias("seq"))


@query("augment_run_flip", f"SELECT c_custkey, array_to_string([CASE WHEN r[1] <= 'Z' AND {_d('run', 'c_custkey')} < 2147483648 THEN reverse(r) ELSE r END FOR r, i IN regexp_extract_all(c_name, '[\\x00-Z]+|[^\\x00-Z]+')], '') AS seq FROM customer")
def augment_run_flip(spark, d):
    return table(spark, d, "customer").select("c_custkey", Q.flip_runs(F.col("c_name"), F.col("c_custkey")).alias("seq"))


@query("case_runs", r"""
SELECT c_custkey, array_to_string(runs, '|') AS runs, array_to_string([r FOR r IN runs IF r[1] <= 'Z'], '') AS active, array_to_string([r FOR r IN runs IF r[1] > 'Z'], '') AS other
FROM (SELECT c_custkey, regexp_extract_all(c_name, '[\x00-Z]+|[^\x00-Z]+') AS runs FROM customer)
""")
def case_runs(spark, d):
    runs = table(spark, d, "customer").select("c_custkey", Q.case_runs(F.col("c_name")).alias("runs"))
    part = lambda keep: F.array_join(F.filter("runs", keep), "")
    return runs.select("c_custkey", F.array_join("runs", "|").alias("runs"), part(Q.is_active).alias("active"), part(lambda r: ~Q.is_active(r)).alias("other"))


@query("attention_mask", "SELECT p_partkey, length(p_name)::BIGINT AS ones FROM part")
def attention_mask(spark, d):
    mask = Q.attention_mask(Q.characters(F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.size(F.filter(mask, lambda m: m)).cast("long").alias("ones"))


@query("encode_ints", f"SELECT p_partkey, seq, array_to_string([strpos('ACDEFGHIKLMNPQRSTVWY', c) - 1 FOR c IN string_split(seq, '')], ',') AS codes FROM (SELECT p_partkey, regexp_replace({_SEQ}, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM part)")
def encode_ints(spark, d):
    known = _parts(spark, d).withColumn("seq", F.regexp_replace("seq", f"[^{Q.RESIDUES}]", ""))
    coded = known.withColumn("codes", Q.encode_residues(F.col("seq")))
    return coded.select("p_partkey", Q.decode_residues(F.col("codes")).alias("seq"), F.array_join("codes", ",").alias("codes"))


@query("token_count", "SELECT doc_id, len(regexp_extract_all(text, '<[^>]*>|[^<>]'))::BIGINT AS n FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(Q.split_tokens(F.col("text"))).cast("long").alias("n"))


_VOCAB = "MAP {" + ", ".join(f"'{t}': {i}" for t, i in Q.RESIDUE_VOCABULARY.items()) + "}"


@query("tokenize_pad", f"""
SELECT p_partkey, array_to_string(list_slice(list_concat(ids, [0 FOR i IN range(24)]), 1, 24), ',') AS ids, least(len(ids), 24) AS used
FROM (SELECT p_partkey, [coalesce({_VOCAB}[t], 4) FOR t IN string_split(upper(replace(p_name, ' ', '')), '')] AS ids FROM part)
""")
def tokenize_pad(spark, d):
    ids = table(spark, d, "part").select("p_partkey", Q.token_ids(F.upper("p_name"), Q.RESIDUE_VOCABULARY).alias("codes"))
    mask = Q.padded_mask(F.col("codes"), 24)
    return ids.select("p_partkey", F.array_join(Q.pad(F.col("codes"), 24), ",").alias("ids"), F.size(F.filter(mask, lambda m: m)).cast("long").alias("used"))


@query("char_tokens", r"""
SELECT conv_id, turn, array_to_string(list_slice(list_concat(list_concat(['<start>'], list_slice(ws, 1, 30)), list_concat(['<eos>'], ['<pad>' FOR i IN range(32)])), 1, 32), ' ') AS tokens
FROM (SELECT conv_id, turn, [w FOR w IN regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+') IF w <> ''] AS ws FROM conversations)
""")
def char_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(Q.word_tokens(F.col("text"), 32), " ").alias("tokens"))


@query("roll_tokens", "SELECT p_partkey, substr(p_name, length(p_name) - 2) || substr(p_name, 1, length(p_name) - 3) AS rolled FROM part")
def roll_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(Q.roll(Q.characters(F.col("p_name")), 3), "").alias("rolled"))


_SWAP = "(n > 0 AND {k} >= 0 AND {k} < n - 1 AND {d} < 858993459 AND NOT ({k} > 0 AND {b} < 858993459))"


def _swaps(k: str) -> str:
    draw = lambda at: f"('0x' || substr(md5('swap:0:' || p_partkey || ':' || ({at})), 1, 8))::BIGINT"
    return _SWAP.format(k=f"({k})", d=draw(k), b=draw(f"{k} - 1"))


@query("token_augmentations", f"""
WITH t AS (SELECT p_partkey, [coalesce({_VOCAB}[t], 4) FOR t IN string_split(upper(replace(p_name, ' ', '')), '')] AS ids FROM part),
u AS (SELECT *, len(ids) AS n, floor(len(ids) * 0.5::DOUBLE)::BIGINT AS most FROM t),
v AS (SELECT *, CASE WHEN most > 0 THEN ('0x' || substr(md5('roll:0:' || p_partkey), 1, 8))::BIGINT % most ELSE 0 END AS k FROM u)
SELECT p_partkey, array_to_string([CASE WHEN {_d('drop', 'p_partkey')} < 429496729 THEN 4 ELSE x END FOR x, i IN ids], ',') AS dropped,
  array_to_string([CASE WHEN {_d('override', 'p_partkey')} < 429496729 THEN 5 + {_d('value', 'p_partkey')} % 3 ELSE x END FOR x, i IN ids], ',') AS overridden,
  array_to_string([CASE WHEN {_swaps('i - 1')} THEN ids[i + 1] WHEN {_swaps('i - 2')} THEN ids[i - 1] ELSE x END FOR x, i IN ids], ',') AS swapped,
  array_to_string(list_concat(ids[n - k + 1:n], ids[1:n - k]), ',') AS shifted
FROM v
""")
def token_augmentations(spark, d):
    ids = table(spark, d, "part").select("p_partkey", Q.token_ids(F.upper("p_name"), Q.RESIDUE_VOCABULARY).alias("ids"))
    key = F.col("p_partkey")
    x = F.col("ids")
    made = {"dropped": Q.dropout(x, key, 0.1, 4), "overridden": Q.override(x, key, 0.1, [5, 6, 7]), "swapped": Q.swap_adjacent(x, key, 0.2), "shifted": Q.random_roll(x, key, 0.5)}
    return ids.select("p_partkey", *[F.array_join(v, ",").alias(n) for n, v in made.items()])


@query("logits_to_seq", "SELECT vec_id, substr('ACDEFGHIKLMNPQRSTVWY', (list_position(embedding, list_max(embedding)) - 1) % 20 + 1, 1) AS seq FROM embeddings")
def logits_to_seq(spark, d):
    vocabulary = [Q.RESIDUES[i % 20] for i in range(64)]
    return table(spark, d, "embeddings").select("vec_id", Q.best_tokens(F.array("embedding"), vocabulary).alias("seq"))


@query("vocab_stats", "SELECT max_by(word, (n, word)) AS top, count(*) AS words, max(n) AS most FROM (SELECT p_name AS word, count(*) AS n FROM part GROUP BY p_name)")
def vocab_stats(spark, d):
    counts = table(spark, d, "part").groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("word", F.struct("n", "word")).alias("top"), F.count("*").alias("words"), F.max("n").alias("most"))


@query("char_histogram", "SELECT character, count(*) AS n FROM (SELECT unnest(string_split(rtrim(text, ' '), '')) AS character FROM documents) WHERE character <> '' GROUP BY character")
def char_histogram(spark, d):
    return T.character_histogram(table(spark, d, "documents"), "text")


@query("bpe_pair_counts", r"""
WITH w AS (SELECT string_split(word, '') AS s, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\v\f\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY word)
SELECT "left", "right", sum(n)::BIGINT AS n FROM (SELECT s[i] AS "left", s[i + 1] AS "right", n FROM (SELECT s, n, unnest(range(1, len(s))) AS i FROM w)) GROUP BY ALL
""")
def bpe_pair_counts(spark, d):
    words = T.word_counts(table(spark, d, "documents"), "text").select(Q.characters(F.col("word")).alias("symbols"), "n")
    return T.pair_counts(words)


def _merges_sql(rounds: int) -> str:
    """The rounds written out: symbols stand between < and >, so that a merge is a replacement, from the left and without overlap."""
    steps = ["w0 AS MATERIALIZED (SELECT '<' || array_to_string(string_split(word, ''), '><') || '>' AS s, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_name, '[ \\t\\n\\v\\f\\r]+')) AS word FROM part) WHERE word <> '' GROUP BY word)"]
    for k in range(rounds):
        steps.append(f"""b{k} AS MATERIALIZED (
  SELECT "left", "right", sum(n)::BIGINT AS n FROM (SELECT t[i] AS "left", t[i + 1] AS "right", n FROM (SELECT *, unnest(range(1, len(t))) AS i FROM (SELECT string_split(s[2:-2], '><') AS t, n FROM w{k})))
  GROUP BY ALL HAVING sum(n) >= 2 ORDER BY n DESC, "left", "right" LIMIT 1
), w{k + 1} AS MATERIALIZED (SELECT replace(s, '<' || "left" || '><' || "right" || '>', '<' || "left" || "right" || '>') AS s, w{k}.n FROM w{k}, b{k})""")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f'SELECT {k} AS round, "left", "right", n FROM b{k}' for k in range(rounds))


@query("bpe_merges", _merges_sql(8))
def bpe_merges(spark, d):
    found = T.learn_merges(table(spark, d, "part"), "p_name", 8)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(found)], "round int, left string, right string, n long")


_MEASURE = "CASE l_linenumber % 5 WHEN 0 THEN '>' || l_quantity WHEN 1 THEN l_quantity || '±' || l_tax WHEN 2 THEN 'NA' WHEN 3 THEN l_quantity || '-' || (l_quantity + 5) ELSE '<= ' || l_quantity END"


def _measured(spark, d):
    q = F.col("l_quantity").cast("string")
    kind = F.col("l_linenumber") % 5
    text = F.when(kind == 0, F.concat(F.lit(">"), q)).when(kind == 1, F.concat(q, F.lit("±"), F.col("l_tax").cast("string"))).when(kind == 2, "NA").when(kind == 3, F.concat(q, F.lit("-"), (F.col("l_quantity") + 5).cast("string"))).otherwise(F.concat(F.lit("<= "), q))
    unit = F.when(F.col("l_returnflag") == "A", "µg/ml").when(F.col("l_returnflag") == "R", "µM").otherwise("nmol/g")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("concentration"), unit.alias("unit"))


@query("parse_measure", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 <> 2 THEN l_quantity END AS value FROM lineitem")
def parse_measure(spark, d):
    return _measured(spark, d).select("l_orderkey", "l_linenumber", labels.parse_measure(F.col("concentration")).alias("value"))


@query("unit_normalize", "SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN l_quantity * 2500 / 1000 END, 9) AS value FROM lineitem WHERE l_linenumber % 5 <> 2")
def unit_normalize(spark, d):
    value = labels.normalise_unit(labels.parse_measure(F.col("concentration")), F.col("unit"), F.lit(2500.0))
    return _measured(spark, d).where("concentration <> 'NA'").select("l_orderkey", "l_linenumber", F.round(value, 9).alias("value"))


@query("threshold_label", """
SELECT l_orderkey, least, most, CASE WHEN least <= 25 THEN 1 WHEN least >= 100 THEN 0 ELSE -1 END AS label FROM (
  SELECT l_orderkey, min(v) AS least, max(v) AS most FROM (
    SELECT l_orderkey, CASE WHEN l_linenumber % 5 <> 2 THEN CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN l_quantity * 2500 / 1000 END END AS v FROM lineitem) GROUP BY l_orderkey)
""")
def threshold_label(spark, d):
    one = F.struct("concentration", F.struct(F.col("unit").alias("name")).alias("unit"))
    nested = _measured(spark, d).groupBy("l_orderkey").agg(F.collect_list(one).alias("activities"))
    return nested.select("l_orderkey", labels.activity_label(F.col("activities"), F.lit(2500.0)).alias("x")).select("l_orderkey", "x.*")


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("label_from_source", "SELECT doc_id, CASE WHEN contains(source, '1') THEN 0 WHEN contains(source, '2') THEN 1 END AS label FROM documents")
def label_from_source(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("source").contains("1"), 0).when(F.col("source").contains("2"), 1).alias("label"))


@query("focal_loss", "SELECT l_orderkey, l_linenumber, round(-(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - p, 2) * ln(p), 9) AS loss FROM (SELECT l_orderkey, l_linenumber, y, CASE WHEN y = 1 THEN q ELSE 1 - q END AS p FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, greatest(least(l_quantity / 51, 1 - 1e-8), 1e-8) AS q FROM lineitem))")
def focal_loss(spark, d):
    label = F.when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(vectors.focal_loss(F.col("l_quantity") / 51, label), 9).alias("loss"))


@query("anneal", "SELECT event_id, round(0.1 + least(greatest((event_id - 1000) / 5000.0::DOUBLE, 0), 1) * 0.9, 9) AS weight FROM events")
def anneal(spark, d):
    return table(spark, d, "events").select("event_id", F.round(vectors.anneal(F.col("event_id"), 1000, 6000, 0.1, 1.0), 9).alias("weight"))


@query("kmer_table", "SELECT kmer, count(*) AS n, min(place) AS first_place FROM (SELECT i - 1 AS place, substring(p_name, i, 5) AS kmer FROM (SELECT p_name, unnest(range(1, length(p_name) - 3)) AS i FROM part)) GROUP BY kmer")
def kmer_table(spark, d):
    tables.register(spark)
    return spark.sql("SELECT kmer, count(*) AS n, min(place) AS first_place FROM {part}, LATERAL kmers(p_name, 5) GROUP BY kmer", part=table(spark, d, "part"))
