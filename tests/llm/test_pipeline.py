import random

import corpus_pipeline
from tests.llm.fixtures import DOCS, frame
from tests.llm.test_language_id import corpus, text_of
from tests.llm.test_secret_scan import ACCESS


def tables(spark, folder):
    rng = random.Random(6)
    rows = [(i, t, lang, f"src{i % 3}", len(t)) for i, t, lang, *_ in corpus(120)]
    passage = text_of(rng, "aa", 30)
    rows += [(500, rows[0][1], "aa", "src0", 1), (501, "1 2 3", "aa", "src1", 5), (502, None, None, None, None)]
    rows += [(503, f"{text_of(rng, 'bb')} {passage} {text_of(rng, 'bb')}", "bb", "src1", 1), (504, f"{text_of(rng, 'aa')} {ACCESS}", "aa", "src2", 1)]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    frame(spark, [(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, passage


def test_each_stage_decides(spark, tmp_path):
    rows, passage = tables(spark, tmp_path)
    columns = [c.split()[0] for c in DOCS.split(", ")]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == columns and (len(out.columns) == 5 or number == 4)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    start = {r[0]: r[1] for r in rows}
    assert seen["language_id"] == {i: t for i, t in start.items() if i not in (501, 502)}
    assert set(seen["language_id"]) - set(seen["simhash_dedup"]) == {500}
    assert passage in seen["simhash_dedup"][503] and passage not in seen["decontaminate"][503]
    assert {i: t for i, t in seen["decontaminate"].items() if i != 503} == {i: t for i, t in seen["simhash_dedup"].items() if i != 503}
    assert ACCESS not in seen["secret_scan"][504] and "[access]" in seen["secret_scan"][504]
    assert seen["mix_sources"].items() <= seen["secret_scan"].items()


def test_run_equals_the_stages(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    both = [sorted(map(tuple, d.collect())) for d in (docs, corpus_pipeline.run(spark, str(tmp_path)))]
    assert both[0] == both[1] and both[0]
