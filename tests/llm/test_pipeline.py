import re
from collections import Counter

import corpus_pipeline as C
import pytest
from wayfold.llm._shared import staged
from wayfold.llm.near_dedup import near_duplicates
from wayfold.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = []
    for _, stage in C.STAGES:
        steps.append(staged(stage(spark, steps[-1] if steps else docs, SF), "test"))
        if len(steps) < len(C.STAGES):
            assert steps[-1].columns == columns
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    good = {r.doc_id for r in quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert set(ids[0]) == good
    first = {r.doc_id for r in near_duplicates(steps[0], 5, 80).where("kept").collect()}
    assert set(ids[1]) == first and sorted(ids[2]) == sorted(ids[1])
    assert set(ids[3]) <= set(ids[2]) and set(ids[4]) == set(ids[3])
    got = C.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()
    want = steps[4].select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def passes_base(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)


@pytest.fixture
def folder(spark, docs, tmp_path):
    """Writes the three tables the pipeline reads, from the shared corpus or with no rows."""

    def write(rows):
        rows.drop("count").write.parquet(f"{tmp_path}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if rows.isEmpty() else 10**6).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_nulls_and_repeats(spark, docs, corpus, folder):
    sf = folder(docs)
    step = spark.read.parquet(f"{sf}/documents.parquet")
    before = None
    for name, stage in C.STAGES:
        step = staged(stage(spark, step, sf), "test")
        now = {r.doc_id for r in step.select("doc_id").collect()}
        assert before is None or now <= before, name
        before = now
    assert before and before <= {d for d, t in corpus if passes_base(t)}  # nulls, empties and short texts go in the first stage
    rows = step.collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert all(r.length <= 2048 for r in rows)


def test_empty_tables(spark, docs, folder):
    assert C.run(spark, folder(docs.limit(0))).collect() == []
