"""Graphs as dot, GML, GraphML and node-link JSON.

Each row becomes a line; header, nodes, edges and footer are sorted as one DataFrame of lines and written as text, so an export is
as parallel as its rows. ``single`` writes one part file for tools that want one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("dot", "gml", "graphml", "json")
_NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double")


def flat(df: DataFrame) -> DataFrame:
    """Structs as their fields, one level deep, as the attributes of a graph are."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"{f.name}.{x}").alias(x) for x in f.dataType.names if x not in df.columns]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sanitised(df: DataFrame) -> DataFrame:
    """Attributes as GraphML takes them: NULL as an empty string, nested values as JSON text; plain values stay."""
    out = []
    for f in flat(df).schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("array", "map", "struct"):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return flat(df).select(*out)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")


def _pairs(df: DataFrame, names: list[str], render, between: str) -> Column:
    """The attributes that are not NULL, rendered and joined."""
    return F.array_join(F.array_compact(F.array(*[render(n, _text(df, n)) for n in names])), between) if names else F.lit("")


def graph_lines(vertices: DataFrame, edges: DataFrame, format: str) -> DataFrame:
    """(section, key, line) of a graph; sorted by both, the lines are the file."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}, not {format!r}")
    nodes, links = flat(vertices), flat(edges)
    own = [c for c in nodes.columns if c != "node_id"]
    link = [c for c in links.columns if c not in ("src", "dst", "pos")]
    order = F.concat_ws("|", F.col("src"), F.col("dst"), *[F.col(c).cast("string") for c in ("scid", "direction") if c in links.columns])
    spark = vertices.sparkSession
    number = lambda d, n: dict(d.dtypes)[n].startswith(("decimal", *_NUMERIC))
    if format == "dot":
        item = lambda n, t: F.when(t.isNotNull(), F.concat(F.lit(n + "="), _quoted(t)))
        node = F.concat(F.lit("  "), _quoted(F.col("node_id")), F.lit(" ["), _pairs(nodes, own, item, ", "), F.lit("];"))
        edge = F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" ["), _pairs(links, link, item, ", "), F.lit("];"))
        head, middle, foot = ["strict digraph {"], [], ["}"]
    elif format == "gml":
        item = lambda d: lambda n, t: F.when(t.isNotNull(), F.concat(F.lit(f" {n.replace('_', '')} "), t if number(d, n) else _quoted(F.replace(t, F.lit('"'), F.lit("&#34;")))))
        node = F.concat(F.lit("  node [ id "), _quoted(F.col("node_id")), F.lit(" label "), _quoted(F.col("node_id")), _pairs(nodes, own, item(nodes), ""), F.lit(" ]"))
        edge = F.concat(F.lit("  edge [ source "), _quoted(F.col("src")), F.lit(" target "), _quoted(F.col("dst")), _pairs(links, link, item(links), ""), F.lit(" ]"))
        head, middle, foot = ["graph [", "  directed 1"], [], ["]"]
    elif format == "graphml":
        clean_n, clean_e = sanitised(vertices), sanitised(edges)
        kind = lambda d, n: "long" if number(d, n) and not dict(d.dtypes)[n].startswith("decimal") else "boolean" if dict(d.dtypes)[n] == "boolean" else "string"
        item = lambda p: lambda n, t: F.concat(F.lit(f'<data key="{p}_{n}">'), _xml(F.coalesce(t, F.lit(""))), F.lit("</data>"))
        node = F.concat(F.lit('    <node id="'), _xml(F.col("node_id")), F.lit('">'), _pairs(clean_n, own, item("n"), ""), F.lit("</node>"))
        edge = F.concat(F.lit('    <edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), _pairs(clean_e, link, item("e"), ""), F.lit("</edge>"))
        keys = [f'  <key id="{p}_{n}" for="{w}" attr.name="{n}" attr.type="{kind(d, n)}"/>' for p, w, d, names in (("n", "node", nodes, own), ("e", "edge", links, link)) for n in names]
        head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '  <graph edgedefault="directed">']
        middle, foot = [], ["  </graph>", "</graphml>"]
        nodes, links = clean_n, clean_e
    else:
        options = {"ignoreNullFields": "false"}
        node = F.to_json(F.struct(*[F.col(c) for c in own], F.col("node_id").alias("id")), options)
        edge = F.to_json(F.struct(*[F.col(c) for c in link], F.col("src").alias("source"), F.col("dst").alias("target")), options)
        first_node, first_edge = nodes.agg(F.min("node_id")).first()[0], links.agg(F.min(order)).first()[0]
        comma = lambda key, first, line: F.concat(F.when(key == F.lit(first), "  ").otherwise(", "), line)
        node, edge = comma(F.col("node_id"), first_node, node), comma(order, first_edge, edge)
        head, middle, foot = ['{"directed": true, "multigraph": false, "graph": {}, "nodes": ['], ['], "edges": ['], ["]}"]
    fixed = [(s, f"{i:06d}", line) for s, lines in ((0, head), (2, middle), (4, foot)) for i, line in enumerate(lines)]
    lines = spark.createDataFrame(fixed, "section int, key string, line string")
    return lines.unionByName(nodes.select(F.lit(1).alias("section"), F.col("node_id").alias("key"), node.alias("line"))).unionByName(
        links.select(F.lit(3).alias("section"), order.alias("key"), edge.alias("line"))
    )


def save_graph(vertices: DataFrame, edges: DataFrame, path: str, format: str = "json", single: bool = True) -> None:
    """Write a graph to the folder ``path`` as text; JSON is one document over all its lines."""
    lines = graph_lines(vertices, edges, format).orderBy("section", "key")
    (lines.coalesce(1).sortWithinPartitions("section", "key") if single else lines).select("line").write.mode("overwrite").text(path)


def rendered(df: DataFrame, most: int = 50) -> DataFrame:
    """Rows for a look: long strings cut to ``most`` characters, lists as their number of entries."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "string":
            c = F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)
        elif kind.startswith("array"):
            c = F.concat(F.size(c).cast("string"), F.lit(" entries"))
        out.append(c.alias(name))
    return df.select(*out)


def described(decoded: DataFrame, kind: str) -> DataFrame:
    """(description): a presented table as one readable line a row; bytes of private messages are cut to 40 characters."""
    parts = []
    for name, type_ in decoded.dtypes:
        c = F.col(name).cast("string") if not type_.startswith(("array", "struct")) else F.to_json(name)
        if kind.startswith("private") and type_ == "string":
            c = F.when(F.length(c) > 40, F.concat(F.left(c, F.lit(40)), F.lit("..."))).otherwise(c)
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("None"))))
    return decoded.select(F.concat(F.lit(f"{kind}("), F.concat_ws(", ", *parts), F.lit(")")).alias("description"))
