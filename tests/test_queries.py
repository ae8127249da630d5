"""Every library query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


def same_rows(spark, duck, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    same_rows(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_quote_meets_every_document(spark):
    from tessella.plans.documents import quotes_found

    texts = ["One two  three four five\nsix seven eight nine ten", "xone two three four five six seven eighty", "two", "", None, "three four", "fur two-three"]
    said = ["one two three four five six seven eight", "TWO three", "three", "two three four", "two three fou", "absent", "", None, "four five six seven eight nine"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[1]), (None, "two three")], "doc_id long, text string")
    quotes = spark.createDataFrame([*((100 + i, t) for i, t in enumerate(said)), (100, "fur")], "item_id long, quote string")
    plain_text = lambda t: " ".join((t or "").lower().split())
    want = [(d["doc_id"], q["item_id"], True, True, True) for d in docs.collect() for q in quotes.collect() if plain_text(q["quote"]) and plain_text(q["quote"]) in plain_text(d["text"])]
    assert sorted(map(tuple, quotes_found(docs, quotes).collect()), key=repr) == sorted(want, key=repr)


def test_any_quote_meets_any_document(spark):
    got = catalog.QUERIES["evidence_check"](spark, "/root/testdata/sf0.01").collect()
    assert any(r["doc_id"] % 40 != r["item_id"] for r in got)


def test_context_holds_whole_turns(spark):
    said = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role <> 'system'").collect():
        said.setdefault(str(r["conv_id"]), []).append(r["text"].replace("fields>>>", "fields> > >").replace("\n", " "))
    got = {r["document_id"]: r["context"] for r in catalog.QUERIES["qa_context"](spark, SF).collect()}
    assert set(got) == set(said) and any(len(t) > 30 for x in said.values() for t in x)
    assert all(t in got[d] for d, x in said.items() for t in x)


def test_duplicates_in_other_letter_forms(spark, tmp_path):
    texts = ["The office café serves ﬁne food. " * 9, "The oﬃce cafe\u0301 serves fine food. " * 9, "The office café serves ｆｉｎｅ food. " * 9, "another text " * 30]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["n_docs"], r["first_doc"]) for r in catalog.QUERIES["content_dups"](spark, str(tmp_path)).collect()] == [(3, 0)]
    assert [r["pages"] for r in catalog.QUERIES["dup_severity"](spark, str(tmp_path)).collect()] == ["1,2,3"]
