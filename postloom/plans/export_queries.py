"""Registered queries of files: what an export wrote is read again, and the SQL says what has to stand in it.

Files go to a folder of their own under the shared one. Text files are compressed, as most of a record is names of fields.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions import text, time
from postloom.plans import views
from postloom.plans.queries import _INCOMING, _ISO, S, _cell, _incoming, _stored, query
from postloom.shared import new_folder
from postloom.sources import export, readers
from postloom.sources.store import PostStore
from postloom.streaming import streams

_READ = f"{S('posts', 'engagement')} SELECT post_id, post_type, likes, reaction_love_count, CASE WHEN has_link THEN 'https://a.example||x|y' END AS links, {_ISO.format('published_at')} AS published FROM posts_v LEFT JOIN engagement_v USING (id)"


def _compared(posts):
    return posts.select("post_id", "post_type", "likes", "reaction_love_count", F.when(F.col("external_links").isNotNull(), text.joined(F.col("external_links"))).alias("links"), time.iso(F.col("published_at")).alias("published"))


@query(_READ)
def s4_json_files(spark, sf):
    """Arrays, written and read."""
    path = new_folder(spark, "json")
    export.export(_stored(spark, sf), "json", path, compression="gzip")
    return _compared(readers.read_posts(spark, path))


@query(f"{S('posts', 'engagement')} SELECT {', '.join(_cell(c) for c in schemas.FLAT_COLUMNS)} FROM posts_v LEFT JOIN engagement_v USING (id)")
def s5_csv_files(spark, sf):
    path = new_folder(spark, "csv")
    export.export(_stored(spark, sf), "csv", path, compression="gzip")
    rows = spark.read.schema(", ".join(f"{c} string" for c in schemas.FLAT_COLUMNS)).options(header="true", escape='"', multiLine="true").csv(path)
    return rows.na.fill("")


@query(f"{S('posts', 'engagement')} SELECT post_id, CAST(likes AS VARCHAR) AS likes, strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00') AS published_at, {len(schemas.CANONICAL_POST)}::INT AS fields, true AS nulls_kept FROM posts_v LEFT JOIN engagement_v USING (id)")
def s6_json_lines(spark, sf):
    """Lines as they stand in the files, null fields among them."""
    path = new_folder(spark, "jsonl")
    export.export(_stored(spark, sf), "jsonl", path, compression="gzip")
    field = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    return spark.read.text(path).select(field("post_id"), field("likes"), field("published_at"), F.size(F.json_object_keys("value")).alias("fields"), F.contains("value", F.lit('"reaction_care_count":null')).alias("nulls_kept"))


@query("SELECT count(*) AS n, true AS small, true AS in_order FROM lineitem")
def s9_batches(spark, sf):
    """Files of at most 500 posts, each wholly after the one before: newest first, and by falling id within a day."""
    path = new_folder(spark, "batches")
    export.write_batches(_stored(spark, sf), path, 500)
    place = F.struct(F.coalesce(F.unix_micros("published_at"), F.lit(-(2**63))).alias("at"), "id")
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    files = files.withColumns({"part": F.regexp_extract("file", "part-(\\d+)", 1).cast("int"), "k": F.regexp_extract("file", "-c(\\d+)", 1).cast("int")})
    falls = files.withColumn("falls", F.coalesce(F.lag("low").over(Window.partitionBy("part").orderBy("k")) > F.col("high"), F.lit(True)))
    # then one row a part, as many as there are shuffle partitions; neighbours meet through their ends
    parts = falls.groupBy("part").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.bool_and("falls").alias("falls"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = parts.agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.bool_and("falls").alias("falls"), F.array_sort(F.collect_list(F.struct("part", "high", "low"))).alias("ends"))
    across = F.forall(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.element_at("ends", i)["low"] > F.element_at("ends", i + 1)["high"])
    return out.select("n", (F.col("most") <= 500).alias("small"), (F.col("falls") & F.when(F.size("ends") < 2, True).otherwise(across)).alias("in_order"))


@query(f"""{S('posts')}, k AS (SELECT *, coalesce('id:' || post_id, 'fp:' || CAST(id AS VARCHAR)) AS dedup_key FROM posts_v) SELECT id, (job_id % 2)::INT AS batch FROM (SELECT *, row_number() OVER (PARTITION BY source_id, dedup_key ORDER BY job_id % 2, id) AS n FROM k) WHERE n = 1""")
def t6_ingested_posts(spark, sf):
    """Two loads of a folder, by the stream that goes on where it stopped: posts of even jobs, then those of odd ones."""
    posts = views.view(spark, sf, "posts").select("id", "job_id", "source_id", F.coalesce(F.concat(F.lit("id:"), "post_id"), F.concat(F.lit("fp:"), F.col("id").cast("string"))).alias("dedup_key"), F.col("id").alias("ord"))
    at = new_folder(spark, "ingest")
    for k in (0, 1):
        posts.where(F.col("job_id") % 2 == k).write.mode("append").parquet(f"{at}/in")
        streams.ingest(spark.readStream.schema(posts.schema).parquet(f"{at}/in"), f"{at}/store", f"{at}/log").awaitTermination()
    return PostStore(spark, f"{at}/store").read().select("id", F.col("batch").cast("int").alias("batch"))


@query(f"{_INCOMING} SELECT min(id) AS id, source_id, dedup_key FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id = i.source_id AND s.dedup_key = i.dedup_key) GROUP BY source_id, dedup_key")
def b7_pruned_store(spark, sf):
    """J5 and B7 against a store by buckets of sources: filters first, then the keys of buckets that may have one."""
    incoming, stored = _incoming(spark, sf)
    columns = ["id", "source_id", "dedup_key", "ord"]
    store = PostStore(spark, new_folder(spark, "store"))
    store.append(stored.select(*columns), 0)
    return store.new_posts(incoming.select(*columns)).select("id", "source_id", "dedup_key")


_WHOLE_CELLS = {
    "external_links": "CASE WHEN has_link THEN '[\"https://a.example\",null,\"x|y\"]' ELSE '' END", "source_url": "'https://www.social.example/' || source_id", "scraped_at": "strftime(scraped_at, '%Y-%m-%dT%H:%M:%S+00:00')",
}
_WHOLE_ROWS = f"{S('posts', 'engagement')} SELECT {', '.join(f'{_WHOLE_CELLS[f.name]} AS {f.name}' if f.name in _WHOLE_CELLS else _cell(f.name) for f in schemas.CANONICAL_POST)} FROM posts_v LEFT JOIN engagement_v USING (id)"


@query(_WHOLE_ROWS)
def s8_cli_file(spark, sf):
    """All 33 columns, as they stand in the files."""
    path = new_folder(spark, "cli")
    export.write_cli_csv(_stored(spark, sf), path, "gzip")
    rows = spark.read.schema(", ".join(f"{f.name} string" for f in schemas.CANONICAL_POST)).options(header="true", escape='"', multiLine="true").csv(path)
    return rows.na.fill("")


@query(_WHOLE_ROWS)
def s4_whole_posts(spark, sf):
    """All 33 fields, written as arrays, read, and shown as text."""
    path = new_folder(spark, "json")
    export.export(_stored(spark, sf), "json", path, compression="gzip")
    return export.cli_rows(readers.read_posts(spark, path))
