"""The graph rules against a small model of dictionaries, and analytics, history, events, exports and streams."""

import json
import random
import xml.etree.ElementTree as ET
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gossamer.api import History
from gossamer.operators import graph as G
from gossamer.operators import history as H
from gossamer.operators.analytics import analyze, component_sizes, components
from gossamer.operators.components import connected_components
from gossamer.operators.decode import encode
from gossamer.operators.events import validate_events
from gossamer.sources.sinks import graph_lines, sanitised, save_graph
from gossamer.streaming import gossip as S


def key(n):
    return bytearray([n]) * 33


def channels(spark, rows):
    """rows of (ord, scid, n1, n2)."""
    fixed = "features binary, chain_hash binary, bitcoin_key_1 binary, bitcoin_key_2 binary, node_signature_1 binary, node_signature_2 binary, bitcoin_signature_1 binary, bitcoin_signature_2 binary"
    rest = (bytearray(b"\x01"), bytearray(32), key(1), key(2), *(bytearray(64) for _ in range(4)))
    return spark.createDataFrame([(o, s, key(a), key(b), *rest) for o, s, a, b in rows], "ord long, scid long, node_id_1 binary, node_id_2 binary, " + fixed)


def updates(spark, rows):
    """rows of (ord, scid, direction, timestamp, fee, htlc_max)."""
    made = [(o, bytearray(64), bytearray(32), s, t, bytearray([m is not None]), bytearray([d]), 40, 1, f, 2, m) for o, s, d, t, f, m in rows]
    df = spark.createDataFrame(made, "ord long, signature binary, chain_hash binary, scid long, timestamp long, message_flags binary, channel_flags binary, cltv_expiry_delta long, htlc_minimum_msat long, fee_base_msat long, fee_proportional_millionths long, htlc_maximum_msat long")
    return df.withColumn("htlc_minimum_msat", F.col("htlc_minimum_msat").cast("decimal(20,0)")).withColumn("htlc_maximum_msat", F.col("htlc_maximum_msat").cast("decimal(20,0)"))


def nodes(spark, rows):
    """rows of (ord, node, timestamp, alias)."""
    made = [(o, bytearray(64), bytearray(b""), t, key(n), bytearray(3), bytearray(a.encode().ljust(32, b"\0")), bytearray.fromhex("017f0000012607")) for o, n, t, a in rows]
    return spark.createDataFrame(made, "ord long, signature binary, features binary, timestamp long, node_id binary, rgb_color binary, alias binary, addresses binary")


def model(ch, up):
    """What a dictionary walk over the messages makes of them."""
    last, latest = {}, {}
    for o, s, a, b in sorted(ch):
        last[s] = (a, b)  # first position, last value
    for o, s, d, t, f, m in sorted(up):
        if (s, d) not in latest or t > latest[s, d][0]:
            latest[s, d] = (t, f, m)
    edges = defaultdict(dict)
    for s, (a, b) in last.items():
        for d, (x, y) in enumerate(((a, b), (b, a))):
            edges[x, y].update(scid=s, direction=d, has_update=(s, d) in latest)
            if (s, d) in latest:
                edges[x, y].update(u=latest[s, d])
    return edges


@pytest.mark.parametrize("seed", range(2))
def test_edges_against_the_model(spark, seed):
    rng = random.Random(seed)
    ch = [(i, rng.randrange(50), rng.randrange(6), rng.randrange(6)) for i in range(80)]
    up = [(i, rng.randrange(60), rng.randrange(2), rng.randrange(5), rng.randrange(3), rng.choice([None, 5, 6])) for i in range(60)]
    c, u = (channels(spark, ch).repartition(3), updates(spark, up).repartition(4))
    got = {}
    for r in G.simple_edges(G.multi_edges(c, u)).collect():
        x = dict(scid=int(r.scid.split("x")[2]), direction=r.direction, has_update=r.has_update)
        if r.update is not None:
            x["u"] = (r.update.timestamp, r.update.fee_base_msat, None if r.update.htlc_maximum_msat is None else int(r.update.htlc_maximum_msat))
        got[int(r.src[:2], 16), int(r.dst[:2], 16)] = x
    assert got == dict(model(ch, up))
    assert G.multi_edges(c, u).count() == 2 * len({s for _, s, _, _ in ch})
    assert G.orphan_updates(c, u).count() == len({(s, d) for _, s, d, *_ in up} - {(s, d) for _, s, _, _ in ch for d in (0, 1)})


def small(spark):
    ch = [(0, 1, 1, 2), (1, 2, 1, 2), (2, 1, 1, 2), (3, 3, 3, 3), (4, 4, 4, 5)]
    up = [(0, 1, 0, 10, 1, 5), (1, 1, 0, 10, 2, 5), (2, 9, 0, 10, 1, 5), (3, 4, 1, 20, 7, None)]
    an = [(0, 1, 5, "first"), (1, 1, 5, "second"), (2, 9, 5, "alone"), (3, 4, 6, "four")]
    return channels(spark, ch), nodes(spark, an), updates(spark, up)


def test_small_graph(spark):
    c, n, u = small(spark)
    edges = {(r.src[:2], r.dst[:2]): r for r in G.simple_edges(G.multi_edges(c, u)).collect()}
    assert len(edges) == 5 and edges["01", "02"].has_update is False and edges["01", "02"].update.fee_base_msat == 1
    assert edges["03", "03"].direction == 1 and edges["05", "04"].update.htlc_maximum_msat is None
    v = {r.node_id[:2]: r for r in G.vertices(c, n).collect()}
    assert v["01"].alias == "first" and v["02"].announced is False and v["09"].announced and v["01"].addresses[0].addr == "127.0.0.1"
    assert [r.node_id[:2] for r in G.isolated_nodes(c, n).collect()] == ["09"]
    s = G.graph_stats(c, n, u).first()
    assert (s.nodes, s.announced, s.unannounced, s.isolated, s.edges, s.channels, s.updates) == (6, 3, 3, 1, 5, 4, 3)
    assert [(r.node_id[0], r.announcements) for r in G.most_announced(n).collect()] == [(1, 2)]


def test_analytics(spark):
    c, n, u = small(spark)
    v, e = G.vertices(c, n), G.simple_edges(G.multi_edges(c, u))
    assert sorted(r.size for r in component_sizes(components(v, e)).collect()) == [1, 1, 2, 2]
    a = analyze(v, e).first()
    assert (a.nodes, a.edges, a.with_update, a.components, a.largest, a.connected) == (6, 5, 1, 4, 2, False)
    empty = analyze(v.limit(0), e.limit(0)).first()
    assert empty.nodes == 0 and empty.connected is None


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long").repartition(5)).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("fees, kept", [([1, 1], 1), ([1, 2], 2), ([1, 1, 2], 2), ([1, 2, 2], 2), ([1, 2, 3], 3), ([1, 2, 1], 3)])
def test_fee_changes(spark, fees, kept):
    assert H.fee_changes(updates(spark, [(i, 1, 0, i, f, None) for i, f in enumerate(fees)])).count() == kept


def test_history(spark):
    c, n, u = small(spark)
    v, e = H.snapshot(c, n, u, 5)
    assert e.where("has_update").count() == 0 and v.where("announced").count() == 2
    d = H.diff(c, n, u, 5, 15)
    assert d["channel_updates"].count() == 3 and d["node_announcements"].count() == 1
    with pytest.raises(ValueError):
        H.diff(c, n, u, 5, 5)
    assert H.node_at(n, "01" * 33, 9).first().ord == 0 and H.node_at(n, "01" * 33, 1).count() == 0
    assert H.channel_at(c, u, "0x0x1", 10).where("has_update").count() == 1
    for bad in (lambda: H.node_at(n, "", 1), lambda: H.channel_at(c, u, "", 1)):
        with pytest.raises(ValueError):
            bad()
    probes = spark.createDataFrame([(1, 9), (1, 10), (4, 99)], "scid long, at long")
    got = {(r.scid, r.at): r.state and r.state.ord for r in H.asof_join(probes, u, ["scid"]).collect()}
    assert got == {(1, 9): None, (1, 10): 0, (4, 99): 3}


def test_api(spark, tmp_path):
    c, n, u = small(spark)
    m = encode(c, 256).union(encode(n, 257).withColumn("ord", F.col("ord") + 100)).union(encode(u, 258).withColumn("ord", F.col("ord") + 200))
    with History(spark, m) as h:
        v, e = h.snapshot(99, save_to=str(tmp_path / "g"), stopwatch=True)
        assert (v.count(), e.count()) == (6, 5) and h.stats().first().channels == 4 and h.analyze().first().components == 4
        assert h.node("01" * 33, 99).first().ord == 100 and h.channel("0x0x1", 99).count() == 2 and h.messages_at(99).count() == 13
        assert h.diff(0, 99, only_fee_changes=True)["channel_updates"].count() == 4
        with pytest.raises(ValueError):
            h.snapshot(1, format="png")
    with pytest.raises(ValueError):
        History(spark, m, default_format="png")
    doc = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect()))
    assert len(doc["nodes"]) == 6 and len(doc["edges"]) == 5


def test_exports(spark, tmp_path):
    c, n, u = small(spark)
    v, e = G.vertices(c, n), G.simple_edges(G.multi_edges(c, u))
    save_graph(v, e, str(tmp_path / "x"), "graphml")
    tree = ET.fromstring("\n".join(r.value for r in spark.read.text(str(tmp_path / "x")).collect()))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(tree.findall(f".//{ns}node")) == 6 and len(tree.findall(f".//{ns}edge")) == 5
    for fmt in ("dot", "gml"):
        lines = [r.line for r in graph_lines(v, e, fmt).orderBy("section", "key").collect()]
        assert len(lines) in (13, 14) and lines[-1] in ("}", "]")
    assert sanitised(v.where("not announced")).first().alias == ""
    with pytest.raises(ValueError):
        graph_lines(v, e, "png")


GOOD = {"metadata": {"type": 258, "id": "ab" * 32, "timestamp": 1}, "raw_gossip_hex": "01 02"}


@pytest.mark.parametrize("change, error", [
    ({}, None), ({"raw_gossip_hex": ""}, None), ({"metadata": {**GOOD["metadata"], "type": True}}, None), ({"metadata": 5}, "no metadata object"),
    ({"metadata": {"type": 1}}, "missing keys in metadata"), ({"metadata": {**GOOD["metadata"], "type": "x"}}, "metadata.type is not an integer"), ({"metadata": {**GOOD["metadata"], "id": 5}}, "metadata.id is not a string"),
    ({"metadata": {**GOOD["metadata"], "id": "ab"}}, "metadata.id has not 64 characters"), ({"metadata": {**GOOD["metadata"], "id": "zz" * 32}}, "metadata.id is not hex"),
    ({"metadata": {**GOOD["metadata"], "timestamp": "1"}}, "metadata.timestamp is not an integer"), ({"raw_gossip_hex": None}, "raw_gossip_hex is not a string"), ({"raw_gossip_hex": "abc"}, "raw_gossip_hex is not hex"),
])
def test_envelopes(spark, change, error):
    row = validate_events(spark.createDataFrame([(json.dumps(GOOD | change),)], "event string")).first()
    assert row.error == error and row.valid == (error is None)


def test_broken_envelopes(spark):
    rows = spark.createDataFrame([("[1]",), ("nonsense",), (None,), (json.dumps(GOOD),)], "event string")
    assert [r.error for r in validate_events(rows, verify_id=True).collect()] == ["not an object"] * 3 + ["metadata.id is not the message's SHA-256"]


def test_fee_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    u = updates(spark, [(i, rng.randrange(5), 0, i, rng.randrange(3), None) for i in range(60)]).select("ord", "scid", "timestamp", "fee_base_msat", "fee_proportional_millionths")
    u.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(u.schema).parquet(str(tmp_path / "in"))
    q = S.changed_fees(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.ord for r in H.fee_changes(u).collect()}


def test_windowed_streams(spark, tmp_path):
    rows = [(f"id{i % 4}", f"peer{i % 3}", "channel_update", 1_600_000_000 + 600 * i) for i in range(24)] + [("last", "peer0", "channel_update", 1_600_900_000)]
    for n, part in enumerate((rows[:12], rows[12:-1], rows[-1:])):
        spark.createDataFrame(part, "id string, sender string, kind string, timestamp long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    files = spark.read.parquet(str(tmp_path / "in" / "*"))
    stream = lambda: S.event_time(spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))

    def drained(df, name):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / (name + "-m"))).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).collect()

    counts = drained(S.activity(stream(), late="6 hours"), "counts")
    assert sum(r.messages for r in counts) == 24 and max(r.messages for r in counts) == 6
    seen = drained(S.peers(stream(), late="6 hours", width="1 day"), "peers")
    assert {r.id for r in seen} == {f"id{i}" for i in range(4)} and sum(len(r.times) for r in seen) == 24
    assert {r.id for r in drained(S.deduplicated(stream(), late="30 days", key="id").select("id"), "dedup")} == {"id0", "id1", "id2", "id3", "last"}
