from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from loomwright.llm import toxicity
from loomwright.staging import stage
from tests.llm import test_decontaminate, test_jaccard, test_mixing

SF = "/root/testdata/sf0.001"


def without_common_lines(docs):
    """docs: id to text; a plain version of the line stage."""
    strip = " \t\n\x0b\x0c\r"
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            held[low(x)].add(d)
    gone = lambda d, k: len(k) >= 20 and len(held[k]) >= 3 and max(held[k]) != d
    return {d: "\n".join(x for x in (t or "").split("\n") if not gone(d, low(x))) for d, t in docs.items()}


def test_run_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    model = toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [d for d in rows if model.scores([rows[d].text.encode()])[0] < corpus_pipeline.REJECT]
    docs = without_common_lines({d: rows[d].text for d in clean})
    component = test_jaccard.brute_components(docs)
    docs = {d: t for d, t in docs.items() if component[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: docs[d] for d, _, hit, _ in test_decontaminate.brute(docs.items(), items) if not hit}
    sizes = Counter()
    for d, t in docs.items():
        sizes[rows[d].source] += test_mixing.size(t)
    targets = test_mixing.targets(sizes)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.source, r.source_size) for r in got} == {d: (test_mixing.size(t), rows[d].source, sizes[rows[d].source]) for d, t in docs.items()}
    assert len(got) == len(docs) < len(clean) < len(rows)
    taken = Counter()
    for r in got:
        assert abs(r.target - targets[r.source]) < 1e-3 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= max(256, 0.05 * targets[s]) for s in sizes)


@pytest.mark.parametrize("stage_name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage_name):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y z", "de", None, 5), (4, "word " * 20000, None, "b", 1), (5, "x y z", "de", "b", 5)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "odd")
    function = dict(corpus_pipeline.STAGES)[stage_name]
    out = function(spark, docs, SF)
    assert out.count() == {"near_dedup": 3}.get(stage_name, 6)
    if stage_name != "mixing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    assert function(spark, docs.limit(0), SF).count() == 0
