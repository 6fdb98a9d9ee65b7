"""Queries over gossip made of the driver's tables, and the SQL that gives the same rows from those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.checkpoints import fresh_path
from gossamer.functions import binary as B
from gossamer.functions.addresses import addresses, type_name
from gossamer.functions.sql import register_functions
from gossamer.operators import graph as G
from gossamer.operators import history as H
from gossamer.operators.analytics import analyze, component_sizes, components
from gossamer.operators.decode import encode as encode_messages
from gossamer.operators.decode import decode, nested, presented, tag_counts
from gossamer.operators.events import arrivals, plugin_events, platform_event, validate_events
from gossamer.plans import fixtures as X
from gossamer.sources.gossip import framed_files, messages_of, read_binary, register
from gossamer.sources.sinks import graph_lines, save_graph
from gossamer.streaming import gossip as S

#: 2024-01-15 and 2024-01-20, in the middle of the events; 1996-06-30 in the orders.
T1, T2 = 1_705_276_800, 1_705_708_800
O1 = 836_092_800

_UPDATE = ["ord", "scid", "timestamp", "direction", "cltv_expiry_delta", "htlc_minimum_msat", "fee_base_msat", "fee_ppm", "htlc_maximum_msat"]


def _plain_updates(u: DataFrame) -> DataFrame:
    """Updates with types that every engine has."""
    u = G.with_direction(u)
    return u.select(
        "ord", B.scid_text(F.col("scid")).alias("scid"), "timestamp", "direction", "cltv_expiry_delta", F.col("htlc_minimum_msat").cast("long").alias("htlc_minimum_msat"),
        "fee_base_msat", F.col("fee_proportional_millionths").alias("fee_ppm"), F.col("htlc_maximum_msat").cast("long").alias("htlc_maximum_msat"),
    )


def _plain_edges(e: DataFrame) -> DataFrame:
    return e.select(
        "src", "dst", "scid", "direction", "features", "bitcoin_key_1", "has_update", F.col("update.timestamp").alias("timestamp"), F.col("update.fee_base_msat").alias("fee_base_msat"),
        F.col("update.htlc_maximum_msat").cast("long").alias("htlc_maximum_msat"), F.col("update.channel_flags").alias("channel_flags"),
    )


def update_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    u = X.updates(spark, d, spread=True)
    return _plain_updates(u).join(u.select("ord", B.hex_lower(F.col("chain_hash")).alias("chain_hash"), B.hex_lower(F.col("signature")).alias("signature")), "ord")


def channel_ann_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return presented(X.channels(spark, d))


def node_ann_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = X.nodes(spark, d)
    return n.select(
        "ord", "timestamp", B.hex_lower(F.col("node_id")).alias("node_id"), B.alias_strict(F.col("alias")).alias("alias"), B.alias_lossy(F.col("alias")).alias("alias_lossy"),
        B.hex_lower(F.col("rgb_color")).alias("rgb_color"), B.hex_lower(F.col("features")).alias("features"), B.hex_lower(F.col("addresses")).alias("addresses"),
    )


def amount_dying_delete_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m = X.internal_messages(spark, d)
    amount, deleted, ended, dying = (decode(m, t) for t in (4101, 4103, 4105, 4106))
    return (
        amount.select("ord", F.col("satoshis").cast("long").alias("satoshis")).join(deleted.select("ord", B.scid_text(F.col("scid")).alias("deleted")), "ord")
        .join(ended.select("ord", F.col("equivalent_offset").cast("long").alias("equivalent_offset")), "ord")
        .join(dying.select("ord", B.scid_text(F.col("scid")).alias("dying"), "blockheight"), "ord")
    )


def private_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m = X.internal_messages(spark, d)
    private = decode(m, 4104)
    inner = nested(private, "announcement", 256).select("ord", B.scid_text(F.col("scid")).alias("scid"), B.hex_lower(F.col("node_id_2")).alias("peer"))
    channels = private.select("ord", F.col("amount_sat").cast("long").alias("amount_sat")).join(inner, "ord").select(F.lit("channel").alias("kind"), "ord", "scid", "peer", F.col("amount_sat").alias("amount"))
    updates = _plain_updates(nested(decode(m, 4102), "update", 258)).select(F.lit("update").alias("kind"), "ord", "scid", F.lit("").alias("peer"), F.col("fee_base_msat").alias("amount"))
    return channels.union(updates)


def tag_dispatch_counts(spark: SparkSession, d: str) -> DataFrame:
    return tag_counts(X.all_messages(spark, d)).select("tag", F.coalesce("kind", F.lit("unknown")).alias("kind"), "messages")


def scid_format(spark: SparkSession, d: str) -> DataFrame:
    s = F.shiftleft("o_custkey", 40).bitwiseOR(F.shiftleft(F.col("o_orderkey") % 16_777_216, 16)).bitwiseOR(F.col("o_orderkey") % 65_536)
    out = X.table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s", B.scid_text(F.col("s")).alias("scid"))
    return out.select("o_orderkey", "scid", (B.scid_of(F.col("scid")) == F.col("s")).alias("same"))


def varint_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    scale = F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(70_000_000), F.lit(10**14)).cast("array<bigint>"), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = X.table(spark, d, "lineitem").select((q * scale).alias("value"))
    coded = rows.withColumn("coded", B.varint_encode(F.col("value"))).select("value", F.length("coded").alias("width"), B.varint_decode(F.col("coded")).cast("long").alias("decoded"))
    return coded.groupBy("value", "width", "decoded").agg(F.count("*").alias("n"))


def latest_update(spark: SparkSession, d: str) -> DataFrame:
    return _plain_updates(G.latest_updates(X.updates(spark, d)))


def latest_node_announcement(spark: SparkSession, d: str) -> DataFrame:
    return G.latest_nodes(X.nodes(spark, d)).select("ord", B.hex_lower(F.col("node_id")).alias("node_id"), "timestamp", B.alias_lossy(F.col("alias")).alias("alias"))


def last_channel_dedup(spark: SparkSession, d: str) -> DataFrame:
    return G.last_channels(X.channels(spark, d)).select(B.scid_text(F.col("scid")).alias("scid"), "ord", "pos", B.hex_lower(F.col("node_id_2")).alias("peer"))


def node_announcement_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.announcement_counts(X.nodes(spark, d)).select(B.hex_lower(F.col("node_id")).alias("node_id"), "announcements")


def top5_multi(spark: SparkSession, d: str) -> DataFrame:
    return G.most_announced(X.nodes(spark, d)).select(B.hex_lower(F.col("node_id")).alias("node_id"), "announcements")


def directed_edges(spark: SparkSession, d: str) -> DataFrame:
    return _plain_edges(G.multi_edges(X.channels(spark, d), X.updates(spark, d, spread=True)))


def orphan_updates(spark: SparkSession, d: str) -> DataFrame:
    return _plain_updates(G.orphan_updates(X.channels(spark, d), X.updates(spark, d, spread=True)))


def simple_edges(spark: SparkSession, d: str) -> DataFrame:
    return _plain_edges(G.simple_edges(G.multi_edges(X.channels(spark, d), X.updates(spark, d, spread=True))))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    v = G.vertices(X.channels(spark, d), X.nodes(spark, d))
    return v.select("node_id", "announced", "timestamp", "alias", F.coalesce(F.size("addresses"), F.lit(0)).alias("n_addresses"))


def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.isolated_nodes(X.channels(spark, d), X.nodes(spark, d))


def unannounced_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.unannounced_nodes(X.channels(spark, d), X.nodes(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(X.channels(spark, d), X.nodes(spark, d), X.updates(spark, d, spread=True))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    channels, nodes = X.channels(spark, d), X.nodes(spark, d)
    return G.vertices(channels, nodes).select("node_id", "announced"), G.multi_edges(channels, X.updates(spark, d, spread=True))


def components_query(spark: SparkSession, d: str) -> DataFrame:
    channels = X.channels(spark, d)
    return components(G.vertices(channels, X.nodes(spark, d)).select("node_id"), G.links(channels))


def component_sizes_query(spark: SparkSession, d: str) -> DataFrame:
    return component_sizes(components_query(spark, d))


def graph_analysis(spark: SparkSession, d: str) -> DataFrame:
    v, e = _graph(spark, d)
    return analyze(v, G.simple_edges(e))


def fee_changes_scid(spark: SparkSession, d: str) -> DataFrame:
    return _plain_updates(H.fee_changes(X.updates(spark, d)))


def fee_changes_dir(spark: SparkSession, d: str) -> DataFrame:
    return _plain_updates(H.fee_changes(X.updates(spark, d), ("scid", "direction")))


def snapshot_at(spark: SparkSession, d: str) -> DataFrame:
    _, edges = H.snapshot(X.channels(spark, d), X.nodes(spark, d), X.updates(spark, d, spread=True), T1, simple=False)
    return _plain_edges(edges)


def snapshot_nodes_at(spark: SparkSession, d: str) -> DataFrame:
    v, _ = H.snapshot(X.channels(spark, d), X.nodes(spark, d), X.updates(spark, d, spread=True), O1)
    return v.select("node_id", "announced", "timestamp", "alias")


def diff_between(spark: SparkSession, d: str) -> DataFrame:
    parts = H.diff(X.channels(spark, d), X.nodes(spark, d), X.updates(spark, d), O1, T2)
    names = (("node_announcements", "node"), ("channel_updates", "update"))
    return parts[names[0][0]].select(F.lit("node").alias("kind"), "ord", "timestamp").union(parts[names[1][0]].select(F.lit("update"), "ord", "timestamp"))


def diff_fee_changes(spark: SparkSession, d: str) -> DataFrame:
    return _plain_updates(H.diff(X.channels(spark, d), X.nodes(spark, d), X.updates(spark, d), T1, T2, only_fee_changes=True)["channel_updates"])


def channel_at(spark: SparkSession, d: str) -> DataFrame:
    first = X.table(spark, d, "orders").where("o_custkey = 7").agg(F.min("o_orderkey")).first()[0]
    return _plain_edges(H.channel_at(X.channels(spark, d), X.updates(spark, d, spread=True), f"7x{(first or 0) % 100}x0", T1))


def node_at(spark: SparkSession, d: str) -> DataFrame:
    first = X.table(spark, d, "orders").where("o_orderkey = 0").agg(F.min("o_custkey")).first()[0]
    return H.node_at(X.nodes(spark, d), "03" + f"{first or 0:064x}", T1).select("ord", B.hex_lower(F.col("node_id")).alias("node_id"), "timestamp")


def updates_asof(spark: SparkSession, d: str) -> DataFrame:
    probes = X.table(spark, d, "events").select("event_id", F.shiftleft("user_id", 40).alias("scid"), (X.seconds("ts") - 86_400).alias("probe_time"))
    out = H.asof_join(probes, X.updates(spark, d), ["scid"], "probe_time")
    return out.select("event_id", "probe_time", F.col("state.ord").alias("ord"), F.col("state.fee_base_msat").alias("fee_base_msat"))


def gossip_ids(spark: SparkSession, d: str) -> DataFrame:
    m = X.table(spark, d, "documents").select("doc_id", B.gossip_id(F.coalesce("text", F.lit("")).cast("binary")).alias("gossip_id"))
    return m


def envelope_valid(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id")
    good = F.sha2(F.col("text").cast("binary"), 256)
    id_ = F.when(c % 7 == 1, F.lit("zz")).when(c % 7 == 2, F.concat(F.lit("g"), F.substring(good, 2, 63))).otherwise(good)
    json = F.concat(
        F.lit('{"metadata": {"type": '), F.when(c % 7 == 3, F.lit('"256"')).when(c % 7 == 4, F.lit("true")).otherwise(F.lit("258")), F.lit(', "id": "'), id_, F.lit('"'),
        F.when(c % 7 == 5, F.lit("")).otherwise(F.concat(F.lit(', "timestamp": '), F.col("turn").cast("string"))), F.lit('}, "raw_gossip_hex": "'), F.when(c % 7 == 6, F.lit("abc")).otherwise(F.lit("01 02")), F.lit('"}'),
    )
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", json.alias("event"))
    out = validate_events(rows)
    return out.select("conv_id", "turn", "role", "valid", F.coalesce("error", F.lit("")).alias("error"), "type", "timestamp")


def plugin_event_messages(spark: SparkSession, d: str) -> DataFrame:
    u = X.kept(spark, d, "updates")
    event = F.to_json(F.struct(F.struct(F.lit(258).alias("type"), F.col("ord").alias("timestamp"), F.lit("02").alias("sender_node_id"), F.length("msg").cast("string").alias("length")).alias("metadata"), F.lower(F.hex("msg")).alias("raw_hex")))
    got = plugin_events(u.select("ord", event.alias("event")))
    return _plain_updates(decode(got.select("ord", "msg"), 258))


def event_arrivals(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events").select(B.gossip_id(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").cast("binary")).alias("id"), X.seconds("ts").alias("timestamp"))
    return arrivals(e).select("id", F.size("times").cast("long").alias("n"), F.element_at("times", 1).alias("first"), F.element_at("times", -1).alias("last"))


def platform_events_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    u = X.kept(spark, d, "updates")
    made = u.select("ord", platform_event(F.col("msg"), F.lit(258), F.col("ord")).alias("event"))
    got = validate_events(made, verify_id=True).where("valid")
    return _plain_updates(decode(got.select("ord", F.unhex("raw_gossip_hex").alias("msg")), 258))


def address_decode(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    ip4 = F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad(F.hex(c), 8, "0")), F.unhex(F.lit("2607")))
    dns = F.concat(F.unhex(F.lit("05")), B.bytes_of(F.length(F.concat(F.lit("n"), c.cast("string"), F.lit(".example.org"))), 1), F.concat(F.lit("n"), c.cast("string"), F.lit(".example.org")).cast("binary"), F.unhex(F.lit("0050")))
    unknown = F.unhex(F.lit("09aabb"))
    rows = X.table(spark, d, "customer").select("c_custkey", addresses(F.concat(ip4, dns, unknown, ip4)).alias("a"))
    return rows.select("c_custkey", F.posexplode("a").alias("place", "a")).select("c_custkey", "place", F.col("a.typ.name").alias("type_name"), F.col("a.addr").alias("addr"), F.col("a.port").alias("port"))


def base32_text(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "customer").select("c_custkey", F.unhex(F.sha2(F.col("c_name").cast("binary"), 256)).alias("b"))
    return rows.select("c_custkey", B.base32(F.col("b")).alias("b32"))


def address_types(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "customer").groupBy(type_name(F.col("c_custkey") % 8).alias("type_name")).agg(F.count("*").alias("n"))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    u = X.kept(spark, d, "spread")
    out = u.selectExpr("ord", "message_tag(msg) AS tag", "CAST(uint_be(substring(msg, 107, 4)) AS BIGINT) AS timestamp", "update_direction(substring(msg, 112, 1)) AS direction", "lower(hex(reverse_bytes(substring(msg, 67, 32)))) AS chain_hash")
    return out


def _framed(spark: SparkSession, d: str, framing: str) -> DataFrame:
    """Messages written as files and read back, by the binary reader."""
    path = fresh_path(spark, f"framed-{framing}")
    local = path.removeprefix("file:")
    m = X.kept(spark, d, "spread").select("msg")
    if "://" in path and not path.startswith("file:"):  # a store that only Spark reads, where the source cannot write
        return _plain_updates(decode(messages_of(framed_files(m, framing), framing), 258)).drop("ord")
    register(spark)
    m.write.format("gossip").option("framing", framing).option("path", "/" + local.lstrip("/")).mode("append").save()
    return _plain_updates(decode(read_binary(spark, path, framing), 258)).drop("ord")


def framed(framing: str):
    return lambda spark, d: _framed(spark, d, framing)


def graph_export_lines(spark: SparkSession, d: str) -> DataFrame:
    v, e = _graph(spark, d)
    out = None
    for fmt in ("dot", "gml", "graphml", "json"):
        lines = graph_lines(v, G.simple_edges(e), fmt).groupBy("section").agg(F.count("*").alias("lines")).where("section IN (1, 3)").select(F.lit(fmt).alias("format"), "section", "lines")
        out = lines if out is None else out.union(lines)
    return out


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream of its files; it is a folder of files or one file."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = spark.readStream.schema(schema)
    return stream.parquet(f"{d}/events.parquet") if folder else stream.option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    out, marks = fresh_path(spark, name), fresh_path(spark, name + "-marks")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _events_stream(spark, d).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("event_time"))
    return _drained(S.deduplicated(e, late="60 days", key="id").select("id"), "dedup")


def window_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts by the hour and kind of event, in complete mode."""
    e = _events_stream(spark, d).select(F.timestamp_seconds(X.seconds("ts")).alias("event_time"), F.col("event_type").alias("kind"))
    out = fresh_path(spark, "windows")
    counts = e.groupBy(F.window("event_time", "1 hour").alias("w"), "kind").agg(F.count("*").alias("messages"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.unix_seconds("w.start").alias("start"), "kind", "messages").write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "windows-marks")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def latest_update_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = X.update_rows(spark, d).schema
    rows_path = fresh_path(spark, "updates")
    X.update_rows(spark, d).write.parquet(rows_path)
    u = decode(encode_messages(spark.readStream.schema(schema).parquet(rows_path), 258), 258)
    out = fresh_path(spark, "latest")
    S.upsert_latest(u, out).option("checkpointLocation", fresh_path(spark, "latest-marks")).trigger(availableNow=True).start().awaitTermination()
    return _plain_updates(S.latest_version(spark, out))


QUERIES = {
    "update_roundtrip": update_roundtrip, "channel_ann_roundtrip": channel_ann_roundtrip, "node_ann_roundtrip": node_ann_roundtrip,
    "amount_dying_delete_roundtrip": amount_dying_delete_roundtrip, "private_roundtrip": private_roundtrip, "tag_dispatch_counts": tag_dispatch_counts,
    "scid_format": scid_format, "varint_roundtrip": varint_roundtrip, "latest_update": latest_update, "latest_node_announcement": latest_node_announcement,
    "last_channel_dedup": last_channel_dedup, "node_announcement_counts": node_announcement_counts, "top5_multi": top5_multi, "directed_edges": directed_edges,
    "orphan_updates": orphan_updates, "simple_edges": simple_edges, "vertices": vertices, "isolated_nodes": isolated_nodes, "unannounced_nodes": unannounced_nodes,
    "graph_stats": graph_stats, "components": components_query, "component_sizes": component_sizes_query, "graph_analysis": graph_analysis,
    "fee_changes_scid": fee_changes_scid, "fee_changes_dir": fee_changes_dir, "snapshot_at": snapshot_at, "snapshot_nodes_at": snapshot_nodes_at,
    "diff_between": diff_between, "diff_fee_changes": diff_fee_changes, "channel_at": channel_at, "node_at": node_at, "updates_asof": updates_asof,
    "gossip_ids": gossip_ids, "envelope_valid": envelope_valid, "plugin_event_messages": plugin_event_messages, "event_arrivals": event_arrivals,
    "platform_events_roundtrip": platform_events_roundtrip, "address_decode": address_decode, "base32_text": base32_text, "address_types": address_types,
    "sql_functions": sql_functions, "framed_roundtrip_pgcopy": framed("pgcopy"), "framed_roundtrip_varint": framed("varint"), "framed_roundtrip_gsp": framed("gsp"),
    "framed_roundtrip_gossip_store": framed("gossip_store"), "graph_export_lines": graph_export_lines, "dedup_stream": dedup_stream,
    "window_counts_stream": window_counts_stream, "latest_update_stream": latest_update_stream,
}

# -- the same from the tables -------------------------------------------------------------------------------------------------

_HEX = lambda v, n, head="": f"'{head}' || lpad(lower(to_hex({v})), {2 * n - len(head)}, '0')"
_SEC = lambda c: f"CAST(floor(epoch({c})) AS BIGINT)"
_PEER = "(o_custkey - o_custkey % 10 + o_orderkey % 10)"


def _u(spread: bool = False) -> str:
    scid = "CAST(user_id AS VARCHAR) || 'x' || " + ("CAST(event_id % 100 AS VARCHAR)" if spread else "'0'") + " || 'x0'"
    return f"""u AS (SELECT event_id AS ord, {scid} AS scid, {_SEC("ts")} - {_SEC("ts")} % 3600 AS timestamp, CAST(event_id % 2 AS INTEGER) AS direction,
  CAST(event_id % 144 AS BIGINT) AS cltv_expiry_delta, event_id * 1000 AS htlc_minimum_msat, CAST(floor(value * 100) AS BIGINT) AS fee_base_msat,
  CAST(floor(value) AS BIGINT) % 100 AS fee_ppm, CASE WHEN event_id % 3 <> 0 THEN event_id * 1000 + 7 END AS htlc_maximum_msat, user_id, event_id FROM events)"""


_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scid, direction ORDER BY timestamp DESC, ord) AS rn FROM u{}) WHERE rn = 1)"
_COLS = ", ".join(_UPDATE)
_C = f"""c AS (SELECT o_orderkey AS ord, CAST(o_custkey AS VARCHAR) || 'x' || CAST(o_orderkey % 100 AS VARCHAR) || 'x0' AS scid, {_HEX("o_custkey", 33, "03")} AS n1,
  {_HEX(_PEER, 33, "02")} AS n2, repeat('01', CAST(o_orderkey % 4 AS INTEGER)) AS features, {_HEX("o_orderkey + 5", 33, "02")} AS bitcoin_key_1 FROM orders),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scid ORDER BY ord DESC) AS rn, min(ord) OVER (PARTITION BY scid) AS pos FROM c) WHERE rn = 1)"""
_N = f"""n AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 < 2 THEN {_HEX("o_custkey", 33, "03")} WHEN o_orderkey % 4 = 2 THEN {_HEX(_PEER, 33, "02")}
  ELSE {_HEX("o_orderkey + 10000000", 33, "02")} END AS node_id, {_SEC("o_orderdate")} AS timestamp, 'Node#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS alias, o_orderkey, o_custkey FROM orders)"""
_LN = "ln AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC, ord) AS rn FROM n{}) WHERE rn = 1)"
_ENDS = "ends AS (SELECT n1 AS node_id FROM k UNION SELECT n2 FROM k)"
_E = """d AS (SELECT n1 AS src, n2 AS dst, 0 AS direction, scid, pos, features, bitcoin_key_1 FROM k UNION ALL SELECT n2, n1, 1, scid, pos, features, bitcoin_key_1 FROM k),
e AS (SELECT d.src, d.dst, d.scid, CAST(d.direction AS INTEGER) AS direction, d.pos, d.features, d.bitcoin_key_1, l.ord IS NOT NULL AS has_update, l.timestamp, l.fee_base_msat, l.htlc_maximum_msat,
  CASE WHEN l.ord IS NOT NULL THEN '0' || CAST(d.direction AS VARCHAR) END AS channel_flags FROM d LEFT JOIN l ON d.scid = l.scid AND d.direction = l.direction)"""
_ECOLS = "src, dst, scid, direction, features, bitcoin_key_1, has_update, timestamp, fee_base_msat, htlc_maximum_msat, channel_flags"
_V = f"{_ENDS}, v AS (SELECT ln.node_id, TRUE AS announced FROM ln UNION ALL SELECT ends.node_id, FALSE FROM ends WHERE ends.node_id NOT IN (SELECT node_id FROM ln))"
_CC = f"""WITH RECURSIVE {_C}, {_N}, {_LN.format("")}, {_V}, g AS (SELECT DISTINCT n1 AS a, n2 AS b FROM k UNION SELECT DISTINCT n2, n1 FROM k),
cc(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id AS component FROM v
 UNION SELECT x.node_id, min(y.component) AS component FROM recurring.cc AS x JOIN g ON g.a = x.node_id JOIN cc AS y ON y.node_id = g.b WHERE y.component < x.component GROUP BY x.node_id)"""
_FEES = "f AS (SELECT *, lag(fee_base_msat) OVER w AS pb, lag(fee_ppm) OVER w AS pp, row_number() OVER w AS rn FROM {} WINDOW w AS (PARTITION BY {} ORDER BY timestamp, ord))"
_CHANGED = "WHERE rn = 1 OR fee_base_msat <> pb OR fee_ppm <> pp"

ORACLES = {
    "update_roundtrip": f"WITH {_u(True)} SELECT {_COLS}, sha256(CAST(user_id AS VARCHAR)) AS chain_hash, {_HEX('ord', 64)} AS signature FROM u",
    "channel_ann_roundtrip": f"""SELECT o_orderkey AS ord, {_HEX("o_orderkey + 1", 64)} AS node_signature_1, {_HEX("o_orderkey + 2", 64)} AS node_signature_2,
 {_HEX("o_orderkey + 3", 64)} AS bitcoin_signature_1, {_HEX("o_orderkey + 4", 64)} AS bitcoin_signature_2, repeat('01', CAST(o_orderkey % 4 AS INTEGER)) AS features, sha256(o_orderstatus) AS chain_hash,
 CAST(o_custkey AS VARCHAR) || 'x' || CAST(o_orderkey % 100 AS VARCHAR) || 'x0' AS scid, {_HEX("o_custkey", 33, "03")} AS node_id_1, {_HEX(_PEER, 33, "02")} AS node_id_2,
 {_HEX("o_orderkey + 5", 33, "02")} AS bitcoin_key_1, {_HEX("o_orderkey + 6", 33, "03")} AS bitcoin_key_2 FROM orders""",
    "node_ann_roundtrip": f"""WITH {_N} SELECT ord, timestamp, node_id, alias, alias AS alias_lossy, {_HEX("o_orderkey % 16777216", 3)} AS rgb_color, repeat('02', CAST(o_orderkey % 3 AS INTEGER)) AS features,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '01' || {_HEX("o_custkey", 4)} || '2607' END AS addresses FROM n""",
    "amount_dying_delete_roundtrip": """WITH s AS (SELECT *, CAST(o_custkey AS VARCHAR) || 'x' || CAST(o_orderkey % 100 AS VARCHAR) || 'x' || CAST(o_orderkey % 7 AS VARCHAR) AS scid FROM orders)
 SELECT o_orderkey AS ord, o_orderkey * 1000 AS satoshis, scid AS deleted, o_orderkey + 12 AS equivalent_offset, scid AS dying, o_custkey + 700000 AS blockheight FROM s""",
    "private_roundtrip": f"WITH {_u()}, {_C} SELECT 'channel' AS kind, ord, scid, n2 AS peer, ord * 999 AS amount FROM c UNION ALL SELECT 'update', ord, scid, '', fee_base_msat FROM u",
    "tag_dispatch_counts": """SELECT CAST(tag AS INTEGER) AS tag, kind, messages FROM (
 SELECT 256 AS tag, 'channel_announcement' AS kind, count(*) AS messages FROM orders UNION ALL SELECT 257, 'node_announcement', count(*) FROM orders UNION ALL SELECT 258, 'channel_update', count(*) FROM events
 UNION ALL SELECT 4101, 'channel_amount', count(*) FROM orders UNION ALL SELECT 4102, 'private_update', count(*) FROM events UNION ALL SELECT 4103, 'delete_channel', count(*) FROM orders
 UNION ALL SELECT 4104, 'private_channel', count(*) FROM orders UNION ALL SELECT 4105, 'ended', count(*) FROM orders UNION ALL SELECT 4106, 'channel_dying', count(*) FROM orders
 UNION ALL SELECT 1, 'unknown', count(*) FROM customer)""",
    "scid_format": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || 'x' || CAST(o_orderkey % 16777216 AS VARCHAR) || 'x' || CAST(o_orderkey % 65536 AS VARCHAR) AS scid, TRUE AS same FROM orders",
    "varint_roundtrip": """WITH v AS (SELECT CAST(l_quantity AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 70000000 ELSE 100000000000000 END AS value FROM lineitem)
 SELECT value, CAST(CASE WHEN value < 253 THEN 1 WHEN value < 65536 THEN 3 WHEN value < 4294967296 THEN 5 ELSE 9 END AS INTEGER) AS width, value AS decoded, count(*) AS n FROM v GROUP BY value""",
    "latest_update": f"WITH {_u()}, {_LATEST.format('')} SELECT {_COLS} FROM l",
    "latest_node_announcement": f"WITH {_N}, {_LN.format('')} SELECT ord, node_id, timestamp, alias FROM ln",
    "last_channel_dedup": f"WITH {_C} SELECT scid, ord, pos, n2 AS peer FROM k",
    "node_announcement_counts": f"WITH {_N} SELECT node_id, count(*) AS announcements FROM n GROUP BY node_id",
    "top5_multi": f"WITH {_N} SELECT node_id, announcements FROM (SELECT node_id, count(*) AS announcements, min(ord) AS f FROM n GROUP BY node_id HAVING count(*) > 1 ORDER BY announcements DESC, f LIMIT 5)",
    "directed_edges": f"WITH {_u(True)}, {_LATEST.format('')}, {_C}, {_E} SELECT {_ECOLS} FROM e",
    "orphan_updates": f"WITH {_u(True)}, {_LATEST.format('')}, {_C} SELECT {_COLS} FROM l WHERE scid NOT IN (SELECT scid FROM k)",
    "simple_edges": f"""WITH {_u(True)}, {_LATEST.format('')}, {_C}, {_E}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos DESC, direction DESC) AS rn FROM e) WHERE rn = 1),
 h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos DESC, direction DESC) AS rn FROM e WHERE has_update) WHERE rn = 1)
 SELECT b.src, b.dst, b.scid, b.direction, b.features, b.bitcoin_key_1, b.has_update, h.timestamp, h.fee_base_msat, h.htlc_maximum_msat, h.channel_flags FROM b LEFT JOIN h ON b.src = h.src AND b.dst = h.dst""",
    "vertices": f"""WITH {_C}, {_N}, {_LN.format('')}, {_ENDS} SELECT node_id, TRUE AS announced, timestamp, alias, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_addresses FROM ln
 UNION ALL SELECT node_id, FALSE, NULL, NULL, 0 FROM ends WHERE node_id NOT IN (SELECT node_id FROM ln)""",
    "isolated_nodes": f"WITH {_C}, {_N}, {_ENDS} SELECT DISTINCT node_id FROM n WHERE node_id NOT IN (SELECT node_id FROM ends)",
    "unannounced_nodes": f"WITH {_C}, {_N}, {_ENDS} SELECT node_id FROM ends WHERE node_id NOT IN (SELECT node_id FROM n)",
    "graph_stats": f"""WITH {_u(True)}, {_C}, {_N}, {_LN.format('')}, {_V} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM ln) AS announced, (SELECT count(*) FROM v WHERE NOT announced) AS unannounced,
 (SELECT count(*) FROM ln WHERE node_id NOT IN (SELECT node_id FROM ends)) AS isolated, (SELECT count(*) FROM (SELECT n1, n2 FROM k UNION SELECT n2, n1 FROM k)) AS edges, (SELECT count(*) FROM k) AS channels,
 (SELECT count(*) FROM (SELECT DISTINCT scid, direction FROM u)) AS updates""",
    "components": f"{_CC} SELECT node_id, component FROM cc",
    "component_sizes": f"{_CC} SELECT component, count(*) AS size FROM cc GROUP BY component",
    "fee_changes_scid": f"WITH {_u()}, {_FEES.format('u', 'scid')} SELECT {_COLS} FROM f {_CHANGED}",
    "fee_changes_dir": f"WITH {_u()}, {_FEES.format('u', 'scid, direction')} SELECT {_COLS} FROM f {_CHANGED}",
    "snapshot_at": f"WITH {_u(True)}, {_LATEST.format(f' WHERE timestamp <= {T1}')}, {_C}, {_E} SELECT {_ECOLS} FROM e",
    "snapshot_nodes_at": f"""WITH {_C}, {_N}, {_LN.format(f' WHERE timestamp <= {O1}')}, {_ENDS} SELECT node_id, TRUE AS announced, timestamp, alias FROM ln
 UNION ALL SELECT node_id, FALSE, NULL, NULL FROM ends WHERE node_id NOT IN (SELECT node_id FROM ln)""",
    "diff_between": f"WITH {_u()}, {_N} SELECT 'node' AS kind, ord, timestamp FROM n WHERE timestamp > {O1} AND timestamp <= {T2} UNION ALL SELECT 'update', ord, timestamp FROM u WHERE timestamp > {O1} AND timestamp <= {T2}",
    "diff_fee_changes": f"WITH {_u()}, i AS (SELECT * FROM u WHERE timestamp > {T1} AND timestamp <= {T2}), {_FEES.format('i', 'scid')} SELECT {_COLS} FROM f {_CHANGED}",
    "channel_at": f"WITH {_u(True)}, {_LATEST.format(f' WHERE timestamp <= {T1}')}, {_C}, {_E} SELECT {_ECOLS} FROM e WHERE scid = (SELECT '7x' || CAST(min(o_orderkey) % 100 AS VARCHAR) || 'x0' FROM orders WHERE o_custkey = 7)",
    "node_at": f"WITH {_N}, {_LN.format(f' WHERE timestamp <= {T1}')} SELECT ord, node_id, timestamp FROM ln WHERE node_id = (SELECT {_HEX('o_custkey', 33, '03')} FROM orders WHERE o_orderkey = 0)",
    "updates_asof": f"""WITH {_u()}, p AS (SELECT event_id, user_id, {_SEC('ts')} - 86400 AS probe_time FROM events), j AS (SELECT p.event_id, p.probe_time, u.ord, u.fee_base_msat,
 row_number() OVER (PARTITION BY p.event_id ORDER BY u.timestamp DESC NULLS LAST, u.ord) AS rn FROM p LEFT JOIN u ON u.user_id = p.user_id AND u.timestamp <= p.probe_time) SELECT event_id, probe_time, ord, fee_base_msat FROM j WHERE rn = 1""",
    "gossip_ids": "SELECT doc_id, sha256(coalesce(text, '')) AS gossip_id FROM documents",
    "envelope_valid": """WITH c AS (SELECT *, conv_id % 7 AS m FROM conversations) SELECT conv_id, turn, role, m IN (0, 4) AS valid,
 CASE m WHEN 1 THEN 'metadata.id has not 64 characters' WHEN 2 THEN 'metadata.id is not hex' WHEN 3 THEN 'metadata.type is not an integer' WHEN 5 THEN 'missing keys in metadata' WHEN 6 THEN 'raw_gossip_hex is not hex' ELSE '' END AS error,
 CAST(CASE m WHEN 0 THEN 258 WHEN 4 THEN 1 END AS BIGINT) AS type, CASE WHEN m IN (0, 4) THEN turn END AS timestamp FROM c""",
    "plugin_event_messages": f"WITH {_u()} SELECT {_COLS} FROM u",
    "event_arrivals": f"SELECT sha256(CAST(user_id AS VARCHAR) || ':' || event_type) AS id, count(*) AS n, min({_SEC('ts')}) AS first, max({_SEC('ts')}) AS last FROM events GROUP BY user_id, event_type",
    "platform_events_roundtrip": f"WITH {_u()} SELECT {_COLS} FROM u",
    "address_decode": """WITH c AS (SELECT c_custkey, CAST(c_custkey // 16777216 AS VARCHAR) || '.' || CAST(c_custkey // 65536 % 256 AS VARCHAR) || '.' || CAST(c_custkey // 256 % 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) AS ip FROM customer)
 SELECT c_custkey, CAST(0 AS INTEGER) AS place, 'IPv4' AS type_name, ip AS addr, CAST(9735 AS INTEGER) AS port FROM c UNION ALL SELECT c_custkey, 1, 'DNS', 'n' || CAST(c_custkey AS VARCHAR) || '.example.org', 80 FROM c""",
    "address_types": "SELECT CASE c_custkey % 8 WHEN 1 THEN 'IPv4' WHEN 2 THEN 'IPv6' WHEN 3 THEN 'Torv2' WHEN 4 THEN 'Torv3' WHEN 5 THEN 'DNS' ELSE 'Unknown' END AS type_name, count(*) AS n FROM customer GROUP BY 1",
    "sql_functions": f"WITH {_u(True)} SELECT ord, CAST(258 AS INTEGER) AS tag, timestamp, direction, sha256(CAST(user_id AS VARCHAR)) AS chain_hash FROM u",
    **{f"framed_roundtrip_{f}": f"WITH {_u(True)} SELECT {', '.join(_UPDATE[1:])} FROM u" for f in ("pgcopy", "varint", "gsp", "gossip_store")},
    "graph_export_lines": f"""WITH {_C}, {_N}, {_LN.format('')}, {_V}, s AS (SELECT CAST(1 AS INTEGER) AS section, count(*) AS lines FROM v UNION ALL SELECT 3, count(*) FROM (SELECT n1, n2 FROM k UNION SELECT n2, n1 FROM k))
 SELECT f.format, s.section, s.lines FROM s JOIN (VALUES ('dot'), ('gml'), ('graphml'), ('json')) AS f(format) ON TRUE""",
    "dedup_stream": "SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || event_type AS id FROM events",
    "window_counts_stream": f"SELECT {_SEC('ts')} - {_SEC('ts')} % 3600 AS start, event_type AS kind, count(*) AS messages FROM events GROUP BY ALL",
    "latest_update_stream": f"WITH {_u()}, {_LATEST.format('')} SELECT {_COLS} FROM l",
}
