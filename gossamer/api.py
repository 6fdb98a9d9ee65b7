"""The history as an object: open message files once, then ask for snapshots, differences, nodes and channels."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gossamer.operators import graph as G
from gossamer.operators import history as H
from gossamer.operators.analytics import analyze
from gossamer.operators.decode import decode
from gossamer.sources.gossip import read_binary, register
from gossamer.sources.sinks import FORMATS, save_graph


class HistoryError(Exception):
    """What a history could not answer."""


class History:
    """Questions to a set of messages, given as a path of message files or as a DataFrame (ord, msg, ...)."""

    def __init__(self, spark: SparkSession, source: str | DataFrame, default_format: str = "json", framing: str = "auto", local: bool = False):
        if default_format not in FORMATS:
            raise ValueError(f"format is one of {FORMATS}, not {default_format!r}")
        self.spark, self.default_format = spark, default_format
        if not isinstance(source, str):
            self.messages = source
        elif local:
            register(spark)
            self.messages = spark.read.format("gossip").option("framing", framing).load(source)
        else:
            self.messages = read_binary(spark, source, framing)
        self.channels, self.nodes, self.updates = (decode(self.messages, tag) for tag in (256, 257, 258))

    def __enter__(self) -> History:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self.messages.unpersist()

    def snapshot(self, at, save_to: str | None = None, format: str | None = None, simple: bool = True, stopwatch: bool = False) -> tuple[DataFrame, DataFrame]:
        """(vertices, edges) as of a time, saved too if a path is given. ``stopwatch`` prints how long the saving took."""
        format = format or self.default_format
        if format not in FORMATS:
            raise ValueError(f"format is one of {FORMATS}, not {format!r}")
        began = time.perf_counter()
        vertices, edges = H.snapshot(self.channels, self.nodes, self.updates, at, simple)
        if save_to:
            save_graph(vertices, edges, save_to, format)
        if stopwatch:
            print(f"snapshot: {time.perf_counter() - began:.3f} s")
        return vertices, edges

    def messages_at(self, at) -> DataFrame:
        """The raw messages that a snapshot builds on."""
        kept = [H.known_at(self.channels, at).select("ord")] + [d.where(d["timestamp"] <= H._time(at)).select("ord") for d in (self.nodes, self.updates)]
        return self.messages.join(kept[0].union(kept[1]).union(kept[2]).distinct(), "ord", "left_semi")

    def diff(self, start, end, only_fee_changes: bool = False, by: Sequence[str] = ("scid",)) -> dict[str, DataFrame]:
        return H.diff(self.channels, self.nodes, self.updates, start, end, only_fee_changes, by)

    def node(self, node_id: str, at) -> DataFrame:
        return H.node_at(self.nodes, node_id, at)

    def channel(self, scid: str, at) -> DataFrame:
        return H.channel_at(self.channels, self.updates, scid, at)

    def graph(self, simple: bool = True) -> tuple[DataFrame, DataFrame]:
        edges = G.multi_edges(self.channels, self.updates)
        return G.vertices(self.channels, self.nodes), G.simple_edges(edges) if simple else edges

    def stats(self) -> DataFrame:
        return G.graph_stats(self.channels, self.nodes, self.updates)

    def analyze(self) -> DataFrame:
        return analyze(*self.graph())
