from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from postloom import sqlfuncs
from postloom.functions import numbers, text, urls


def test_sql_functions_are_the_column_functions(spark):
    assert "json_documents" in sqlfuncs.register(spark)
    given = ["  a\n b ", None, "1.2K likes #x #x @a.", "1,234", "/posts/7", "/api/9/x", "5", "1.2.3", "12k"]
    df = spark.createDataFrame([(x,) for x in given], "x string")
    for name, f in {"clean_text": text.clean_text, "hashtags": text.hashtags, "mentions": text.mentions, "parse_count": numbers.parse_count, "int_or_none": numbers.int_or_none, "path_family": text.path_family, "post_id_of": urls.post_id}.items():
        rows = df.select(F.expr(f"{name}(x)").alias("a"), f(F.col("x")).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], name
    r = spark.sql("SELECT usage_tone(3, 10) AS a, usage_tone(10, 10) AS b, usage_tone(1, NULL) AS c, epoch_guess(1700000000000) AS d").first()
    assert tuple(r) == ("healthy", "exhausted", "unbounded", datetime(2023, 11, 14, 22, 13, 20))
    docs = spark.sql("""SELECT * FROM json_documents('{"a": 1} [2] {bad')""").collect()
    assert [(d.ord, d.document) for d in docs] == [(0, '{"a": 1}'), (1, "[2]")]
