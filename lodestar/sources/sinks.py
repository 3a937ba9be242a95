"""Sinks: JSON, CSV, Markdown and GEXF."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report or a graph file, which are for reading, may hold.
MOST_ROWS = 100_000


def write_json(df: DataFrame, path: str) -> None:
    """K1. One JSON object on each line."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K2. CSV with a header; arrays and maps as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def _few(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write them as a table")
    return rows


def markdown(df: DataFrame, title: str = "") -> str:
    """K3. A Markdown table."""
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = f"## {title}\n\n" if title else ""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return head + "\n".join(lines + ["| " + " | ".join(map(clean, r)) + " |" for r in _few(df)]) + "\n"


def gexf(nodes: DataFrame, edges: DataFrame) -> str:
    """K4. GEXF of nodes (first column the id, others attributes) and edges (src, dst, weight)."""
    key, *attributes = nodes.columns
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.2" version="1.2"><graph defaultedgetype="directed">', '<attributes class="node">']
    out += [f'<attribute id="{i}" title={quoteattr(a)} type="string"/>' for i, a in enumerate(attributes)]
    out += ["</attributes><nodes>"]
    for r in _few(nodes):
        values = "".join(f'<attvalue for="{i}" value={quoteattr(str(r[a]))}/>' for i, a in enumerate(attributes))
        out.append(f"<node id={quoteattr(str(r[key]))} label={quoteattr(str(r[key]))}><attvalues>{values}</attvalues></node>")
    out.append("</nodes><edges>")
    out += [f'<edge id="{i}" source={quoteattr(str(r["src"]))} target={quoteattr(str(r["dst"]))} weight="{r["weight"]}"/>' for i, r in enumerate(_few(edges))]
    return "\n".join([*out, "</edges></graph></gexf>"])
