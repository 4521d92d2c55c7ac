"""Sinks: partitioned artifacts, CSV, TSV, JSON, text, graph XML, annotation XML."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.incremental import write_parts


def write_artifact(df: DataFrame, root: str, name: str) -> None:
    """Replace the artifact of the videos in ``df``."""
    write_parts(df, f"{root}/{name}", ["channel", "video_id"])


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, "\t", header=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, value) -> None:
    df.select(value.cast("string").alias("value")).write.mode("overwrite").text(path)


def with_provenance(df: DataFrame, repo: str, commit: str, parameters: dict[str, str]) -> DataFrame:
    """``df`` with a struct that says how it was made."""
    m = F.create_map(*[F.lit(x) for kv in parameters.items() for x in kv]) if parameters else F.create_map().cast("map<string,string>")
    return df.withColumn("provenance", F.struct(F.lit(repo).alias("repo"), F.lit(commit).alias("commit"), m.alias("parameters")))


def _graph_rows(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes and edges of all graphs as rows of one shape, attributes sorted by name."""
    n = nodes.select(key, F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("dst"), "attrs")
    e = edges.select(key, F.lit("edge").alias("kind"), F.col("src").alias("id"), "dst", F.create_map(F.lit("weight"), F.col("weight").cast("string")).alias("attrs"))
    present = F.filter(F.map_entries("attrs"), lambda x: x["value"].isNotNull())
    return n.unionByName(e).withColumn("attrs", F.array_sort(present))


def graph_documents(nodes: DataFrame, edges: DataFrame, key: str = "video_id", types: dict[str, str] | None = None) -> DataFrame:
    """(key, xml): one GraphML document a graph. A graph's rows meet in one task, and graphs are dealt to as many tasks as the session has for a shuffle.

    ``types`` names the type of an attribute (boolean, int, long, float,
    double); others are strings, the weight of edges is a double.
    """
    kinds = {"weight": "double"} | (types or {})

    def run(pdf):
        import pandas as pd

        rows = pdf.assign(attrs=[[(x["key"], x["value"]) for x in at] for at in pdf["attrs"]])
        names = {k: {a: i for i, a in enumerate(sorted({a for at in rows["attrs"][rows["kind"] == k] for a, _ in at}))} for k in ("node", "edge")}
        head = [f'<key id="{k[0]}{i}" for="{k}" attr.name={quoteattr(a)} attr.type="{kinds.get(a, "string")}"/>' for k in names for a, i in names[k].items()]
        body = []
        for r in sorted(rows.to_dict("records"), key=lambda r: (r["kind"] == "edge", r["id"], r["dst"] or "")):
            data = "".join(f'<data key="{r["kind"][0]}{names[r["kind"]][a]}">{escape(v)}</data>' for a, v in r["attrs"])
            tag = f"<node id={quoteattr(r['id'])}>{data}</node>" if r["kind"] == "node" else f"<edge source={quoteattr(r['id'])} target={quoteattr(r['dst'])}>{data}</edge>"
            body.append(tag)
        xml = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(head) + '<graph edgedefault="undirected">' + "".join(body) + "</graph></graphml>"
        return pd.DataFrame({key: [rows[key].iloc[0]], "xml": [xml]})

    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return _graph_rows(nodes, edges, key).repartition(parts, key).groupBy(key).applyInPandas(run, f"{key} {nodes.schema[key].dataType.simpleString()}, xml string")


#: Draws the nodes of a page on a circle, edges between them; a click lists a node's attributes.
_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><svg id="g" viewBox="-600 -600 1200 1200"></svg><pre id="t"></pre>
<script id="data" type="application/json">{data}</script>
<script>const rows=JSON.parse(document.getElementById("data").textContent),svg=document.getElementById("g"),at={{}},put=(n,a)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",n);for(const k in a)e.setAttribute(k,a[k]);svg.append(e);return e}};
const nodes=[...new Set(rows.flatMap(r=>r.dst===null?[r.id]:[r.id,r.dst]))];nodes.forEach((n,i)=>at[n]=[Math.cos(2*Math.PI*i/nodes.length)*550,Math.sin(2*Math.PI*i/nodes.length)*550]);
for(const r of rows)if(r.dst!==null)put("line",{{x1:at[r.id][0],y1:at[r.id][1],x2:at[r.dst][0],y2:at[r.dst][1],stroke:"#999"}});
for(const n of nodes)put("circle",{{cx:at[n][0],cy:at[n][1],r:6}}).onclick=()=>document.getElementById("t").textContent=JSON.stringify(rows.filter(r=>r.id===n),null,1);</script></body></html>"""


def graph_pages(nodes: DataFrame, edges: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, html): one page a graph that holds its data as JSON and draws it without outside files. A graph's rows meet in one row."""
    head, tail = _PAGE.format(title="\0", data="\1").split("\1")
    opening, middle = head.split("\0")
    item = F.struct("kind", "id", "dst", F.map_from_entries("attrs").alias("attrs"))
    rows = _graph_rows(nodes, edges, key).select(key, F.to_json(item, {"ignoreNullFields": "false"}).alias("j"))
    # A closing tag inside a text would end the data early.
    data = F.replace(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")), F.lit("<"), F.lit("\\u003c"))
    return rows.groupBy(key).agg(F.concat(F.lit(opening), F.col(key).cast("string"), F.lit(middle), data, F.lit(tail)).alias("html"))


def run_metrics(results: DataFrame, run: str, by: list[str], ok: str, seconds: str) -> DataFrame:
    """(run, by, succeeded, failed, total, seconds): the row a run leaves in the table of runs, ready to append."""
    out = results.groupBy(*by).agg(F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"), F.count(F.lit(1)).alias("total"), F.sum(seconds).alias("seconds"))
    return out.select(F.lit(run).alias("run"), *by, "succeeded", "failed", "total", "seconds")


def append(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def annotation_documents(tiers: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, xml): one annotation document a video, a time slot for each end of each annotation. A video's rows meet in one task."""

    def run(pdf):
        import pandas as pd

        rows = pdf.sort_values(["tier", "start_ms", "end_ms", "value"], ignore_index=True)
        slots, body, n = [], [], 0
        for name, group in rows.groupby("tier", sort=True):
            items = []
            for r in group.itertuples():
                slots += [f'<TIME_SLOT TIME_SLOT_ID="ts{2 * n + 1}" TIME_VALUE="{r.start_ms}"/>', f'<TIME_SLOT TIME_SLOT_ID="ts{2 * n + 2}" TIME_VALUE="{r.end_ms}"/>']
                items.append(f'<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a{n + 1}" TIME_SLOT_REF1="ts{2 * n + 1}" TIME_SLOT_REF2="ts{2 * n + 2}"><ANNOTATION_VALUE>{escape(r.value or "")}</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>')
                n += 1
            body.append(f'<TIER LINGUISTIC_TYPE_REF="default-lt" TIER_ID={quoteattr(name)}>{"".join(items)}</TIER>')
        head = f'<HEADER MEDIA_FILE="" TIME_UNITS="milliseconds"><MEDIA_DESCRIPTOR MEDIA_URL={quoteattr(str(rows[key].iloc[0]))} MIME_TYPE="video/mp4"/></HEADER>'
        xml = f'<?xml version="1.0" encoding="UTF-8"?>\n<ANNOTATION_DOCUMENT AUTHOR="" FORMAT="3.0" VERSION="3.0">{head}<TIME_ORDER>{"".join(slots)}</TIME_ORDER>{"".join(body)}</ANNOTATION_DOCUMENT>'
        return pd.DataFrame({key: [rows[key].iloc[0]], "xml": [xml]})

    return tiers.groupBy(key).applyInPandas(run, f"{key} {tiers.schema[key].dataType.simpleString()}, xml string")
