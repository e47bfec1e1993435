"""The query follows its SQL where pages end inside an entity."""

from grainmill import catalog
from tests.oracle import duck, rows_of_duck, rows_of_spark

ODD = ["a &amp", "a &am", "&quot", "&amp;lt;", "&amp;copy;&copy", "&#39;&#x27;&eacute;", None, ""]


def test_x9_of_entities_cut_off(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    name = "x9_unescape"
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of_spark(catalog.queries()[name](spark, str(tmp_path))) == rows_of_duck(con, catalog.oracles()[name])
    every = {r.page_id: r.html for r in catalog.queries()["x9_unescape_all"](spark, str(tmp_path)).collect()}
    assert every[0] == "a &" and every[5] == "''é" and every[3] == "&lt;"
