"""The registered queries on the smallest tables: with their oracles where there are some, else whole and sound."""

import glob
import os

import pytest

from chainloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def listed(frame):
    return sorted(str([None if v != v or v is None else v for v in r]) for r in frame[sorted(frame.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and listed(got) == listed(want)


@pytest.mark.parametrize("name", ["op7_mixing", "op9_langid", "op10_lm"])
def test_one_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    if name == "op10_lm":
        held = got[got.held_out]
        assert held.score.sum() > held.base_score.sum()


def test_languages_of_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op9_langid(spark, SF.replace("sf0.001", "sf0.01")).where("held_out").collect()
    known = [r for r in got if docs[r.doc_id] is not None]
    assert len(known) > 100 and sum(r.lang_pred == docs[r.doc_id] for r in known) >= 0.9 * len(known)
