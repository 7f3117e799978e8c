from filegrain.functions.sql import register

from .fixtures import FILES


def test_sql_functions(spark):
    names = register(spark)
    assert "sniff" in names
    df = spark.createDataFrame([(bytearray(FILES["a.jpg"]), "image/png", "D:20240102030405Z", "+41.5-028.25/")], "content binary, mime string, d string, p string")
    df.createOrReplaceTempView("sql_files")
    r = spark.sql("SELECT sniff(content) AS t, mime_mismatch(sniff(content), mime) AS m, pdf_date(d) AS d, iso6709(p).lon AS lon, type_label('pdf') AS label, size_text(1536) AS size, duration_text(93.5D) AS took FROM sql_files")
    assert tuple(r.first()) == ("jpeg", True, "2024-01-02 03:04:05 UTC", -28.25, "PDF", "1.5 KB", "1:33.50")
    assert "Python" not in r._jdf.queryExecution().executedPlan().toString()
    rows = spark.sql("SELECT x.k, x.v FROM sql_files, LATERAL extract_metadata(content) x WHERE x.k = 'Make'").collect()
    assert [tuple(x) for x in rows] == [("Make", "Optika")]
    files = spark.createDataFrame([(n, bytearray(FILES[n])) for n in ("a.jpg", "c.webp", "s.svg")] + [("none", None)], "file_id string, content binary")
    files.repartition(2).createOrReplaceTempView("sql_more")
    makes = spark.sql("SELECT f.file_id, x.v FROM sql_more f, LATERAL extract_metadata(f.content) x WHERE x.k = 'Make'").collect()
    assert sorted(map(tuple, makes)) == [("a.jpg", "Optika"), ("c.webp", "Optika")]
    titles = spark.sql("SELECT file_id, v FROM extract_files(TABLE(SELECT file_id, content FROM sql_more)) WHERE k IN ('title', 'Model')").collect()
    assert sorted(map(tuple, titles)) == [("a.jpg", "Model M5"), ("c.webp", "Model M5"), ("s.svg", "T & t")]
