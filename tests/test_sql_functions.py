"""The SQL surface gives the same values as the DataFrame functions."""

from pyspark.sql import functions as F

from helpers import SF001
from corpus_engine.functions import html as H
from corpus_engine.functions import text as T
from corpus_engine.sources.tables import table
from corpus_engine.sql_functions import register_sql_functions


def test_sql_functions_equal_column_functions(spark):
    register_sql_functions(spark)
    table(spark, SF001, "documents").createOrReplaceTempView("ce_docs")
    table(spark, SF001, "pages").createOrReplaceTempView("ce_pages")
    sql = spark.sql("SELECT doc_id, ce_normalize(text) AS n, ce_word_count(text) AS w, ce_strip(text) AS s, "
                    "ce_preview(text) AS p FROM ce_docs")
    api = table(spark, SF001, "documents").select(
        "doc_id", T.normalize_for_comparison("text").alias("n"), T.word_count("text").alias("w"),
        T.strip_ws("text").alias("s"), T.preview("text").alias("p"))
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, api.collect()))
    sql = spark.sql("SELECT page_id, ce_html_to_text(html) AS t, ce_html_to_markdown(html) AS m, "
                    "ce_base_name(url) AS b, ce_extension(url) AS e, ce_safe_filename(url) AS f FROM ce_pages")
    api = table(spark, SF001, "pages").select(
        "page_id", H.html_to_text("html").alias("t"), H.html_to_markdown("html").alias("m"),
        F.regexp_extract("url", r"([^/]*)$", 1).alias("b"),
        F.lower(F.regexp_extract(F.regexp_extract("url", r"([^/]*)$", 1), r"^\.*[^.].*(\.[^.]*)$", 1)).alias("e"),
        T.safe_filename("url").alias("f"))
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, api.collect()))
    assert spark.sql("SELECT ce_relevance(0.25) AS r").first()["r"] == 0.75


def test_html_rules(spark):
    page = ("<p>It&#8217;s &#x1F600; &#39;ok&#39; &#0; &amp;#65;</p><a class='x' href='/u'>t</a> <em>e</em> <code>c</code>"
            "<table><tr><td>1</td><td>2</td></tr></table><img alt='' src='i.png'>")
    df = spark.createDataFrame([(page,)], "h string")
    row = df.select(H.html_to_text("h").alias("t"), H.html_to_markdown("h").alias("m")).first()
    assert row["t"].startswith("It\u2019s \U0001F600 'ok' &#0; &#65;\n")
    assert "[t](/u) *e* `c`" in row["m"] and "1 | 2 |" in row["m"] and "![](i.png)" in row["m"]
