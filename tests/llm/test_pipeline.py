from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.messy import documents
from tests.llm.test_text_operators import brute_components, brute_hits
from tidemark.llm import mixing, quality
from tidemark.llm.common import table
from tidemark.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_does_its_work(spark):
    docs, made = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "stage")
        made.append(docs)
    start = table(spark, FOLDER, "documents")
    assert all(sorted(m.dtypes) == sorted(start.dtypes) for m in made[:4])
    texts = [{r["doc_id"]: r["text"] for r in m.collect()} for m in (start, *made[:4])]
    model = quality.fit(start, table(spark, FOLDER, "labels"))
    scores = {r[0]: r[1] for r in quality.score(start, model).collect()}
    assert set(texts[1]) == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    roots = brute_components([texts[1].get(i) for i in range(max(texts[1]) + 1)])
    assert set(texts[2]) == {i for i in texts[1] if roots[i][0] == 0 or roots[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    for i, t in texts[2].items():
        _, hit, found = brute_hits(t, items)
        assert (texts[3][i] == t) == (not found)
        if found:
            assert brute_hits(texts[3][i], [])[0] == len(hit) - sum(hit)
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_report(spark, made[2]).collect()}
    uses = {r["doc_id"]: r["count"] for r in made[3].groupBy("doc_id").count().collect()}
    assert uses == {i: n for i, n in taken.items() if n}
    assert made[4].count() == sum(uses.values())


def test_empty_and_null_documents_pass(spark):
    for docs in (documents(spark, []), documents(spark, [None, "", "a text of a few words", None], ids=[None, 1, 2, 2])):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_mix_of_a_written_table_is_the_mix_of_its_rows(spark):
    docs = materialize(table(spark, FOLDER, "documents").withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))), "mix-test")
    count = lambda df: sorted(map(str, df.groupBy("doc_id", "source", F.md5("text")).count().collect()))
    kept = mixing.mixed_documents(docs, mixing.shared_quotas(), written=True)
    assert kept.columns == docs.columns and kept.count() > docs.count()
    assert count(kept) == count(mixing.mixed_documents(docs, mixing.shared_quotas(), written=True))
    taken = {r["doc_id"]: r["n"] for r in kept.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    report = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_report(spark, docs).collect() if r["doc_id"] is not None}
    assert max(taken.values()) <= 2 and set(taken) <= set(report)


def test_oracle_is_stated():
    assert corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "decontamination", "mixing", "token files"]
