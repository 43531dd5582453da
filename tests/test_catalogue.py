import duckdb
import pytest

from colloquy import catalogue
from tests.conftest import SF
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = connect(SF).sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_indexable_union_on_blank_system_and_unapproved_rows(spark, tmp_path):
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "hello there"), (1, 2, "assistant", "   "), (2, 0, "user", None), (2, 3, None, "whose"), (3, 0, "system", "alone"), (4, 12, "user", "hello there")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    documents = [(i, None if i == 2 else f"text {i}", "en", None if i == 7 else "src", 6) for i in range(9)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    ours = catalogue.QUERIES["indexable_union"](spark, str(tmp_path)).toPandas()
    told = [("extraction", str(i)) for i in (0, 1, 2, 3, 7, 8)] + [("segment", "1::seg0001"), ("segment", "4::seg0012")]
    assert rows(ours[["ref_id", "ref_type"]]) == sorted((i, t) for t, i in told)
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(ours) == rows(con.sql(catalogue.ORACLES["indexable_union"]).df())
