"""The scalar functions as temporary SQL functions of a session, and the table function of concatenated JSON documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import SPACE
from postloom.functions.urls import POST_ID_FORMS
from postloom.sources.extract import json_documents


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, r'{SPACE}+', ' '))"


_COUNT = _squeezed("x")
_SCALED = "r'(?i)(?<![0-9.])([0-9][0-9.,]*)\\s*([km])\\b'"
_PLAIN = "r'(?<![0-9.])([0-9][0-9.,]*)\\b'"
#: name: (parameters, result, body)
FUNCTIONS = {
    "clean_text": ("x STRING", "STRING", f"nullif(trim(regexp_replace({_squeezed('x')}, r'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '')), '')"),
    "hashtags": ("x STRING", "ARRAY<STRING>", "coalesce(array_distinct(regexp_extract_all(x, r'#[A-Za-z0-9_\\u0080-\\uFFFF]+', 0)), cast(array() AS ARRAY<STRING>))"),
    "mentions": ("x STRING", "ARRAY<STRING>", "coalesce(array_distinct(transform(regexp_extract_all(x, r'@[A-Za-z0-9_.\\-\\u0080-\\uFFFF]+', 0), m -> regexp_replace(m, r'[.,;:!?]+$', ''))), cast(array() AS ARRAY<STRING>))"),
    "parse_count": ("x STRING", "BIGINT", f"try_cast(CASE WHEN regexp_extract({_COUNT}, {_SCALED}, 1) <> '' THEN try_cast(replace(regexp_extract({_COUNT}, {_SCALED}, 1), ',', '') AS DOUBLE) * CASE lower(regexp_extract({_COUNT}, {_SCALED}, 2)) WHEN 'k' THEN 1000D ELSE 1000000D END WHEN regexp_extract({_COUNT}, {_PLAIN}, 1) <> '' THEN try_cast(replace(regexp_extract({_COUNT}, {_PLAIN}, 1), ',', '') AS DOUBLE) END AS BIGINT)"),
    "int_or_none": ("x STRING", "BIGINT", "try_cast(trim(x) AS BIGINT)"),
    "path_family": ("x STRING", "STRING", r"regexp_replace(regexp_replace(x, r'\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '{uuid}'), '/[0-9]+', '/{id}')"),
    "usage_tone": ("n BIGINT, most BIGINT", "STRING", "CASE WHEN most IS NULL THEN 'unbounded' WHEN greatest(0, most - n) = 0 THEN 'exhausted' WHEN greatest(0, most - n) * 2 >= most THEN 'healthy' ELSE 'warning' END"),
    "epoch_guess": ("n BIGINT", "TIMESTAMP", "timestamp_micros(CASE WHEN n > 1000000000000 THEN n * 1000 ELSE n * 1000000 END)"),
    "post_id_of": ("x STRING", "STRING", "coalesce({})".format(", ".join("nullif(regexp_extract(x, r\"{}\", 1), '')".format(p.replace('"', "\\x22")) for p in POST_ID_FORMS))),
}


class JsonDocuments:
    """M3: a row for each JSON document of a text, up to the first bad one."""

    def eval(self, body: str) -> Iterator[tuple[int, str]]:
        for k, value in enumerate(json_documents(body or "")):
            yield k, json.dumps(value, ensure_ascii=False)


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in the session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("json_documents", F.udtf(JsonDocuments, returnType="ord int, document string"))
    return [*FUNCTIONS, "json_documents"]
