"""The pipeline's stages against what each of them promises."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import jaccard_join, mixing, quality_rules, queries, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["quality_rules"]
    kept = {r["doc_id"] for r in quality_rules.judge(before, queries.trusted(spark, SF)).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["near_duplicates"]
    one = {r["component_id"] for r in jaccard_join.link(before, words=5, percent=80).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(one)
    before, after = seen["secret_scan"]
    assert before.count() == after.count()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["text"] == secrets.redact(texts[r["doc_id"]], secrets.find(texts[r["doc_id"]])[1]) and r["n_chars"] == len(r["text"])
    before, after = seen["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in copies.items() if n}
    before, after = seen["packing"]
    assert after.agg(F.sum("length")).first()[0] >= sum(len(re.findall(r"\S+", r["text"])) for r in before.collect())
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == after.agg(F.sum("length")).first()[0]


def test_awkward_tables(spark, tmp_path):
    """Nulls in every column, an empty and a long text, repeated ids and rows, clashing names; and no rows."""
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(40).collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, place_ int, found string, copies string, block string"
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", len(t), 1, "f", "c", "b") for i, t in enumerate(good)]
    rows += [rows[3], (4, good[9] + " and more of it", "en", "s0", None, None, None, None, None), (None, good[5], None, None, None, None, None, None, None), (50, None, *[None] * 7), (51, "", *[None] * 7), (52, " ".join(good) * 3, "en", "s1", 7, *[None] * 4), tuple([None] * 9)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, table in (("some", docs), ("none", docs.limit(0))):
        seen = table
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, seen, SF).write.parquet(str(tmp_path / f"{name}-{step}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{step}"))
            if step != "packing":
                assert out.dtypes == docs.dtypes
            if step == "near_duplicates":
                ids = [r["doc_id"] for r in out.collect()]
                assert len([i for i in ids if i == 3]) <= 1
            seen = out
        assert (seen.count() > 0) == (name == "some")


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
