import math

from pyspark.sql import functions as F

from convspark.llm import mixing as M
from tests.llm.fixtures import DOCS, documents, frame


def test_distributions_equal_the_formula(spark):
    rates = [("a", 1, 0.3), ("b", 1, 7.5), ("c", 1, 900.0), ("d", 1, 0.0), ("e", 1, 100_000.0)]
    rows = M.distributions(spark.createDataFrame(rates, "source string, n_docs long, rate double")).collect()
    assert {r.source for r in rows} == {"a", "b", "c", "e"}
    for source, _, rate in rates:
        mine = sorted((r.copies, r.low, r.high) for r in rows if r.source == source)
        assert len(mine) <= 24 * math.sqrt(rate) + 83
        total = 0.0
        for n, (j, low, high) in enumerate(mine):
            assert low == (mine[n - 1][2] if n else 0.0)
            total += math.exp(j * math.log(rate) - rate - math.lgamma(j + 1))
            if n < len(mine) - 1:
                assert abs(high - total) < (1e-12 if rate < 1000 else 1e-8)
        assert not mine or (mine[-1][2] > 1 and abs(total - 1) < 1e-8)


def test_one_document_of_a_source_is_repeated_very_often(spark):
    rows = [(0, "rare", "en", "rare", 4)] + [(i, "t", "en", "common", 1) for i in range(1, 5)]
    out = M.mix(frame(spark, rows), {"rare": 1.0}, default=0.0, total=100_000).select("doc_id", "copy_no")
    n = out.count()
    assert abs(n - 100_000) < 6 * math.sqrt(100_000) and out.distinct().count() == n
    assert out.agg(F.min("copy_no"), F.max("copy_no")).first() == (1, n)


def test_shares_meet_the_weights(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(12_000)]
    weights = {"hot": 1.0, "s0": 2.0, "s1": 0.0}
    got = {r.source: r.n for r in M.mix(frame(spark, rows), weights).groupBy("source").agg(F.count("*").alias("n")).collect()}
    all_weights = 1 + 2 + 0 + 1 + 1
    assert "s1" not in got
    for source, weight in {"hot": 1, "s0": 2, "s2": 1, "s3": 1}.items():
        expected = 12_000 * weight / all_weights
        assert abs(got[source] - expected) < 6 * math.sqrt(expected)


def test_copies_are_numbered_and_repeatable(spark):
    docs = frame(spark, documents())
    one, two = (sorted(map(tuple, M.mix(docs, M.WEIGHTS).collect()), key=repr) for _ in range(2))
    assert one == two
    seen = {}
    for r in M.mix(docs, {}, total=500).filter("doc_id between 10 and 20").collect():
        seen.setdefault((r.doc_id, r.text), []).append(r.copy_no)
    assert seen and all(sorted(v) == list(range(1, len(v) + 1)) for v in seen.values())
    assert len({r.order_key for r in M.mix(docs, {}).filter("doc_id > 3").collect()}) == M.mix(docs, {}).filter("doc_id > 3").count()


def test_empty_tables_and_clashing_columns(spark):
    assert M.mix(frame(spark, []), M.WEIGHTS).count() == 0
    assert M.mix(frame(spark, documents()), {}, default=0.0).count() == 0
    clash = frame(spark, documents()).withColumn("copy_no", F.lit("x"))
    assert M.mix(clash, {}).columns == [*[c.split()[0] for c in DOCS.split(", ")], "copy_no", "order_key"]
