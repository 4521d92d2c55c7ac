"""Each reader and writer: a table is written in its format, read back and held against SQL."""

from __future__ import annotations

import io
import json
import os
import tempfile
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reelgrid.operators.incremental import write_parts
from reelgrid.plans.registry import query, table
from reelgrid.sources import readers, sinks
from reelgrid.sources.staging import staging


@query("artifact_roundtrip", "SELECT 'channel' || (c_nationkey % 5) AS channel, 'video' || c_nationkey AS video_id, c_custkey AS idx, c_acctbal AS start, c_acctbal + 1 AS \"end\", c_name AS text, c_mktsegment AS speaker FROM customer")
def artifact_roundtrip(spark, sf):
    """A typed artifact in partitions of channel and video; writing one channel again leaves the others."""
    c = table(spark, sf, "customer").selectExpr("concat('channel', c_nationkey % 5) AS channel", "concat('video', c_nationkey) AS video_id", "cast(c_custkey AS int) AS idx", "c_acctbal AS start", "c_acctbal + 1 AS end", "c_name AS text", "c_mktsegment AS speaker")
    root = staging(spark, "artifacts")
    sinks.write_artifact(c.withColumn("text", F.when(F.col("channel") == "channel1", "old").otherwise(F.col("text"))), root, "segments")
    sinks.write_artifact(c.where("channel = 'channel1'"), root, "segments")
    return readers.artifact(spark, root, "segments").select("channel", "video_id", F.col("idx").cast("long").alias("idx"), "start", "end", "text", "speaker")


@query("text_lines", "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS value FROM documents) WHERE trim(value, ' ') <> '' GROUP BY 1")
def text_lines(spark, sf):
    """Whole texts written as lines; blank lines don't come back."""
    path = staging(spark, "lines")
    sinks.write_lines(table(spark, sf, "documents").where("text IS NOT NULL"), path, F.replace(F.col("text"), F.lit("\r"), F.lit("\n")))
    return readers.lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("csv_roundtrip", "SELECT p_partkey, p_name, p_retailprice, p_size FROM part")
def csv_roundtrip(spark, sf):
    """CSV with a header, read by an explicit schema."""
    path = staging(spark, "part.csv")
    sinks.write_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice", "p_size"), path)
    return readers.table_csv(spark, path, "p_partkey long, p_name string, p_retailprice double, p_size long")


@query("tsv_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def tsv_roundtrip(spark, sf):
    """K7: tab-separated values without a header."""
    path = staging(spark, "customer.tsv")
    sinks.write_tsv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.table_csv(spark, path, "c_custkey long, c_name string, c_acctbal double", header=False, sep="\t")


@query("json_roundtrip", "SELECT o_orderkey, [o_orderstatus, o_orderpriority] AS labels, o_totalprice AS price FROM orders")
def json_roundtrip(spark, sf):
    """K8: nested rows as JSON lines."""
    path = staging(spark, "orders.json")
    sinks.write_json(table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("labels"), F.col("o_totalprice").alias("price")), path)
    return spark.read.schema("o_orderkey long, labels array<string>, price double").json(path)


@query("lexicon_rows", "SELECT n_name AS label, 'a photo of, ' || n_name AS prompt FROM nation")
def lexicon_rows(spark, sf):
    """A lexicon of labels and prompts, quoted, without a header."""
    path = staging(spark, "lexicon.csv")
    sinks.write_csv(table(spark, sf, "nation").select("n_name", F.concat(F.lit("a photo of, "), "n_name")), path, header=False)
    return readers.lexicon(spark, path)


@query(
    "list_files",
    """
    SELECT 'ids' AS kind, '' AS domain, n_name AS label, '' AS value FROM nation
    UNION ALL SELECT 'prompts', 'region' || n_regionkey, n_name, p FROM nation, (VALUES ('near'), ('far')) x(p)
    UNION ALL SELECT 'ontology', '', CAST(n_nationkey AS VARCHAR), n_name FROM nation
    """,
)
def list_files(spark, sf):
    """Files that hold one JSON value each: a list of ids, prompts by domain and label, an ontology."""
    n = table(spark, sf, "nation")
    one = lambda df, value, name: sinks.write_lines(df.coalesce(1), staged[name], F.to_json(value))
    staged = {k: staging(spark, k) for k in ("ids", "prompts", "ontology")}
    one(n.agg(F.collect_list("n_name").alias("v")), F.col("v"), "ids")
    domains = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.array(F.lit("near"), F.lit("far"))))).alias("labels"))
    one(domains.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("region"), "n_regionkey"), "labels"))).alias("v")), F.col("v"), "prompts")
    one(n.agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(1).alias("more"))).alias("v")), F.col("v"), "ontology")
    parts = [
        readers.id_list(spark, staged["ids"]).selectExpr("'ids' AS kind", "'' AS domain", "value AS label", "'' AS value"),
        readers.prompts(spark, staged["prompts"]).selectExpr("'prompts' AS kind", "domain", "label", "prompt AS value"),
        readers.ontology(spark, staged["ontology"]).selectExpr("'ontology' AS kind", "'' AS domain", "id AS label", "name AS value"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("config_values", "SELECT * FROM (VALUES ('fps', '2'), ('paths.out', 'graphs'), ('paths.shots', 'shots'), ('threshold', '0.7')) c(name, value)")
def config_values(spark, sf):
    """A configuration file, read on the driver, nested names joined."""
    given = {"threshold": 0.7, "fps": 2, "paths": {"shots": "shots", "out": "graphs"}}
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "run.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(given, f)
        read = readers.config(path)
    flat = lambda d, at="": [x for k, v in d.items() for x in (flat(v, f"{at}{k}.") if isinstance(v, dict) else [(at + k, str(v))])]
    return spark.createDataFrame(flat(read), "name string, value string")


@query("file_order", "SELECT n_nationkey, CAST(rank() OVER (ORDER BY 'nation=' || n_nationkey) - 1 AS BIGINT) AS place FROM nation")
def file_order(spark, sf):
    """Files of a folder in order of their names."""
    path = staging(spark, "files")
    write_parts(table(spark, sf, "nation").select("n_name", F.concat(F.lit("n"), "n_nationkey").alias("nation")).repartition(1), path, ["nation"])
    found = readers.sorted_files(spark, path, "*.parquet")
    names = found.select(F.regexp_extract("path", "nation=n([0-9]+)/", 1).alias("n"), "path")
    # The list of files is small; its places are ranks by the whole path.
    place = F.expr("rank() OVER (ORDER BY path) - 1")
    return names.select(F.col("n").cast("long").alias("n_nationkey"), place.cast("long").alias("place"))


@query(
    "audio_slice_sums",
    """
    WITH i AS (SELECT n_nationkey AS v, unnest([0, 1, 2, 3]) AS idx FROM nation),
    s AS (SELECT v, idx, idx * 1.5 AS a, least(idx * 1.5 + idx * 0.75, 6.0) AS b FROM i),
    n AS (SELECT *, CAST(floor((b - a) * 100) AS BIGINT) AS k, CAST(floor(a * 100) AS BIGINT) AS f FROM s)
    SELECT 'v' || v AS video_id, idx, greatest(k, 100) AS n_samples, coalesce((SELECT CAST(sum((f + x) * (v + 3) % 2001 - 1000) AS BIGINT) FROM (SELECT unnest(generate_series(0, k - 1)) AS x)), 0) AS total FROM n
    """,
)
def audio_slice_sums(spark, sf):
    """Slices of wave files by intervals, short ones padded with zeros, as counts and sums of their 16-bit samples."""

    def record(batches):
        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(100)
                    w.writeframes((np.arange(600) * (v + 3) % 2001 - 1000).astype("<i2").tobytes())
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"v{v}" for v in b.column("v").to_pylist()]), pa.array(out, pa.binary())], ["video_id", "content"])

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("v"))
    files = n.mapInArrow(record, "video_id string, content binary")
    at = n.select(F.concat(F.lit("v"), "v").alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    slices = readers.audio_slices(at.withColumn("start", F.col("idx") * 1.5).withColumn("end", F.least(F.col("start") + F.col("idx") * 0.75, F.lit(6.0))), files, rate=100)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 32768).cast("long"))
    return slices.select("video_id", F.col("idx").cast("int").alias("idx"), F.size("samples").cast("long").alias("n_samples"), total.alias("total"))


@query(
    "run_log",
    """
    SELECT run, o_orderpriority, count(*) FILTER (WHERE (o_orderstatus = 'F') = (run = 'first')) AS succeeded, count(*) FILTER (WHERE (o_orderstatus = 'F') <> (run = 'first')) AS failed, count(*) AS total FROM orders, (VALUES ('first'), ('second')) r(run) GROUP BY ALL
    """,
)
def run_log(spark, sf):
    """Each run appends its tallies to the table of runs."""
    path = staging(spark, "runs")
    o = table(spark, sf, "orders")
    for run, ok in (("first", F.col("o_orderstatus") == "F"), ("second", F.col("o_orderstatus") != "F")):
        sinks.append(sinks.run_metrics(o.withColumn("ok", ok).withColumn("s", F.lit(0.5)), run, ["o_orderpriority"], "ok", "s"), path)
    return spark.read.schema("run string, o_orderpriority string, succeeded long, failed long, total long, seconds double").parquet(path).drop("seconds")

