"""Connectivity and counts of a built graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.operators.components import connected_components


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a <= b, one row for each linked pair."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node id of the component; isolated vertices are components of their own."""
    found = connected_components(undirected(edges), "a", "b").withColumnRenamed("id", "node_id")
    return vertices.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def analyze(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, announced, unannounced, edges, with and without update, connected, components and the largest size.

    ``connected`` is NULL for a graph without nodes.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    nodes = vertices.agg(F.count("*").alias("nodes"), F.count_if(flag("announced")).alias("announced"), F.count_if(~flag("announced")).alias("unannounced"))
    counted = edges.agg(F.count("*").alias("edges"), F.count_if(flag("has_update")).alias("with_update"), F.count_if(~flag("has_update")).alias("without_update"))
    sizes = component_sizes(components(vertices, edges)).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    connected = F.when(F.col("components") > 0, F.col("components") == 1)
    return nodes.join(counted).join(sizes).select("*", connected.alias("connected"))  # one row each
