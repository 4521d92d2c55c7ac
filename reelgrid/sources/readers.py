"""Readers: artifacts, lists, CSV, JSON, annotation XML, audio slices, frame indexes."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator
from itertools import islice
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.sources.schemas import SCHEMAS


def artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One artifact of all videos; directories channel=/video_id= become columns, and missing videos have no rows."""
    return spark.read.schema(SCHEMAS[name]).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def table_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(label, prompt) of a CSV without a header."""
    return table_csv(spark, path, "label string, prompt string", header=False)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a file that holds one JSON array of texts."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("value"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(domain, label, prompt) of a JSON file {domain: {label: [prompt]}}."""
    text = spark.read.text(path, wholetext=True)
    domains = text.select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("domain", "labels"))
    return domains.select("domain", F.explode("labels").alias("label", "p")).select("domain", "label", F.explode("p").alias("prompt"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a JSON file [{id, name, ...}]."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<struct<id:string,name:string>>")).alias("o")).select("o.*")


def config(path: str) -> dict:
    """A driver-side configuration file, JSON, or YAML where its library is there."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as gone:
        raise RuntimeError("reading YAML needs the yaml library; JSON works without") from gone
    return yaml.safe_load(text)


_EAF = "struct<HEADER:struct<MEDIA_DESCRIPTOR:array<struct<_MEDIA_URL:string>>>,TIME_ORDER:struct<TIME_SLOT:array<struct<_TIME_SLOT_ID:string,_TIME_VALUE:bigint>>>,TIER:array<struct<_TIER_ID:string,ANNOTATION:array<struct<ALIGNABLE_ANNOTATION:struct<_TIME_SLOT_REF1:string,_TIME_SLOT_REF2:string,ANNOTATION_VALUE:string>>>>>>"


def parsed_annotations(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, media, tier, start_ms, end_ms, value) of annotation documents held as text; both ends are looked up in the document's own time slots."""
    d = docs.select(key, F.from_xml(xml, _EAF).alias("d"))
    slots = F.map_from_entries(F.transform("d.TIME_ORDER.TIME_SLOT", lambda s: F.struct(s["_TIME_SLOT_ID"], s["_TIME_VALUE"])))
    media = F.regexp_extract(F.get("d.HEADER.MEDIA_DESCRIPTOR", F.lit(0))["_MEDIA_URL"], r"([^/]*)$", 1)
    t = d.select(key, media.alias("media"), slots.alias("slots"), F.explode("d.TIER").alias("t"))
    a = t.select(key, "media", "slots", F.col("t._TIER_ID").alias("tier"), F.explode("t.ANNOTATION.ALIGNABLE_ANNOTATION").alias("a"))
    at = lambda c: F.try_element_at("slots", F.col(f"a.{c}"))
    return a.select(key, "media", "tier", at("_TIME_SLOT_REF1").alias("start_ms"), at("_TIME_SLOT_REF2").alias("end_ms"), F.col("a.ANNOTATION_VALUE").alias("value"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of all XML files of a folder."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return parsed_annotations(files, "file", "value")


#: Rows of a batch that a reader hands on.
ROWS = 10_000


def _graph_rows(text: str) -> Iterator[tuple]:
    """(kind, id, dst, attr, type, value) of one graph document, in one pass over its text."""
    names, path, rows, at, said = {}, [], [], None, None

    def start(tag, attrs):
        nonlocal at, said
        path.append(tag.rpartition(":")[2])
        if path[1:] == ["key"]:
            names[attrs.get("id")] = (attrs.get("attr.name"), attrs.get("attr.type"))
        elif path[1:] == ["graph", "node"]:
            at = ("node", attrs.get("id"), None)
        elif path[1:] == ["graph", "edge"]:
            at = ("edge", attrs.get("source"), attrs.get("target"))
        elif path[1:] in (["graph", "node", "data"], ["graph", "edge", "data"]):
            said = (attrs.get("key"), [])

    def end(_):
        nonlocal said
        if said is not None and len(path) == 4:
            rows.append((*at, said[0], "".join(said[1])))
            said = None
        path.pop()

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda x: said is not None and len(path) == 4 and said[1].append(x)
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError:
        return
    for kind, id, dst, key, value in rows:
        yield (kind, id, dst, *names.get(key, (None, None)), value)


def parsed_graphs(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, kind, id, dst, attr, type, value) of graph documents held as text, a row for each attribute.

    A document costs its length: Spark's own reader of XML copies a list for
    each element it adds. Null texts and texts that aren't XML have no rows.
    """
    cols = ("kind", "id", "dst", "attr", "type", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(1)):
                rows = _graph_rows(text.as_py()) if text.is_valid else iter(())
                while part := list(islice(rows, ROWS)):
                    same = batch.column(0).take(pa.array([at] * len(part)))
                    yield pa.RecordBatch.from_arrays([same, *(pa.array(c, pa.string()) for c in zip(*part, strict=True))], [key, *cols])

    return docs.select(key, xml).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} string" for c in cols))


def parsed_pages(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, kind, id, dst, attr, value) of graph pages held as text."""
    data = F.regexp_extract(html, r'(?s)<script id="data" type="application/json">(.*?)</script>', 1)
    rows = docs.select(key, F.explode(F.from_json(data, "array<struct<kind:string,id:string,dst:string,attrs:map<string,string>>>")).alias("x"))
    return rows.select(key, "x.kind", "x.id", "x.dst", F.explode("x.attrs").alias("attr", "value"))


def sorted_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path) of matching files in order of their name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path").orderBy("path")


def audio_slices(intervals: DataFrame, files: DataFrame, rate: int = 16_000, least: float = 1.0, most: float = 100.0) -> DataFrame:
    """(video_id, idx, samples array<float>): slices of mono 16-bit wave files.

    intervals(video_id, idx, start, end), files(video_id, content). Slices are
    padded with zeros to ``least`` seconds and end after ``most``.
    """

    def run(batches):
        for b in batches:
            out = []
            for content, start, end in zip(b.column("content").to_pylist(), b.column("start").to_pylist(), b.column("end").to_pylist(), strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    w.setpos(min(w.getnframes(), int(start * rate)))
                    raw = w.readframes(int(max(0.0, min(most, end - start)) * rate))
                x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
                out.append(np.pad(x, (0, max(0, int(least * rate) - len(x)))))
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("idx"), pa.array(out, pa.list_(pa.float32()))], ["video_id", "idx", "samples"])

    joined = intervals.join(files, "video_id").select("video_id", F.col("idx").cast("long").alias("idx"), "start", "end", "content")
    return joined.mapInArrow(run, "video_id string, idx long, samples array<float>")


def frame_index(videos: DataFrame, fps: float) -> DataFrame:
    """(video_id, index, frame, time) of the frames that a resampled scan would decode.

    videos(video_id, total_frames, fps_in). Frames are chosen before anything
    is decoded.
    """
    from reelgrid.functions.numeric import resampled_frames

    v = videos.select("video_id", F.posexplode(resampled_frames(F.col("total_frames"), F.col("fps_in"), fps)).alias("index", "frame"))
    return v.withColumn("time", F.col("index") / F.lit(float(fps)))
