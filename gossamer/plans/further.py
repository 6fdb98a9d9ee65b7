"""Further queries over the same gossip: what files, broken messages, exports, SQL and streams give, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.checkpoints import fresh_path
from gossamer.functions import binary as B
from gossamer.functions.addresses import addresses
from gossamer.functions.sql import create_views, register_functions
from gossamer.operators import graph as G
from gossamer.operators import history as H
from gossamer.operators.decode import decode, decode_all, presented, tagged
from gossamer.plans import fixtures as X
from gossamer.plans.queries import _C, _CC, _E, _HEX, _LATEST, _LN, _N, _SEC, _V, O1, _drained, _u
from gossamer.sources.framing import FRAMINGS
from gossamer.sources.gossip import framed_files, messages_of, raw_responses
from gossamer.sources.sinks import described, graph_lines, rendered
from gossamer.streaming import gossip as S

#: Messages that a read leaves out at the start of a file.
SKIPPED = 100


def detected_framings(spark: SparkSession, d: str) -> DataFrame:
    """Files of each framing, read without naming it and from message SKIPPED on."""
    m = X.kept(spark, d, "spread").select("msg").coalesce(1)
    out = None
    for framing in FRAMINGS:
        got = messages_of(framed_files(m, framing), start=SKIPPED)
        got = decode(got, 258).agg(F.count("*").alias("messages"), F.min(F.col("ord") % 2**40).alias("first")).select(F.lit(framing).alias("framing"), "messages", "first")
        out = got if out is None else out.union(got)
    return out


def broken_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that end inside their last message, read up to there: all messages but the last, and one row without a message."""
    m = X.kept(spark, d, "spread").select("msg").coalesce(1)
    out = None
    for framing in FRAMINGS:
        cut = framed_files(m, framing, leave=40)
        got = messages_of(cut, framing, failfast=False).agg(F.count("msg").alias("whole"), F.count_if(F.col("msg").isNull()).alias("broken"))
        got = got.select(F.lit(framing).alias("framing"), "whole", "broken")
        out = got if out is None else out.union(got)
    return out


def corrupt_messages(spark: SparkSession, d: str) -> DataFrame:
    """Updates, each fifth of them cut short, with what can be read of them."""
    m = X.kept(spark, d, "spread")
    cut = m.withColumn("msg", F.when(F.col("ord") % 5 == 0, F.expr("substring(msg, 1, 90)")).otherwise(F.col("msg")))
    return decode(cut, 258, corrupt="keep").select("ord", "_corrupt", "timestamp", "fee_base_msat")


def decoded_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many messages of each kind dispatch to fields of their own."""
    every = decode_all(X.all_messages(spark, d))
    kinds = [c for c, t in every.dtypes if t.startswith("struct")]
    own = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds], F.lit("none"))
    return every.groupBy(own.alias("kind")).agg(F.count("*").alias("messages"))


def payload_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tagged(X.kept(spark, d, "spread")).select("ord", "tag", "kind", F.length("payload").alias("bytes"))


def iso_times(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "events").select("event_id", B.iso_time(X.seconds("ts")).alias("iso"))


def store_versions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return X.table(spark, d, "orders").select("o_orderkey", B.store_version(F.unhex(F.lpad(F.hex(k % 256), 2, "0"))).alias("version"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    files = X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").cast("binary").alias("content"))
    return raw_responses(files).select("path", "rendered", F.lit("hex").alias("form")).union(raw_responses(files, as_json=True).select("path", "rendered", F.lit("json")))


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Deleted channels as text, and nodes with long strings cut."""
    gone = described(presented(decode(X.internal_messages(spark, d), 4103)), "delete_channel").select(F.col("description").alias("line"))
    seen = rendered(X.nodes(spark, d).select(B.hex_lower(F.col("node_id")).alias("node_id"), "ord")).select(F.concat_ws(" ", "ord", "node_id").alias("line"))
    return gone.union(seen)


def graph_export_text(spark: SparkSession, d: str) -> DataFrame:
    """Every line for a node or an edge, in each format."""
    channels, nodes = X.channels(spark, d), X.nodes(spark, d)
    v = G.vertices(channels, nodes).select("node_id", "announced")
    e = G.simple_edges(G.multi_edges(channels, X.updates(spark, d, spread=True))).select("src", "dst", "scid", "direction")
    out = None
    for fmt in ("dot", "gml", "graphml", "json"):
        lines = graph_lines(v, e, fmt).where("section IN (1, 3)").select(F.lit(fmt).alias("format"), "section", "key", "line")
        out = lines if out is None else out.union(lines)
    return out


def diff_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channel announcements that a store recorded in an interval, and those that a snapshot at its end knows."""
    recorded = X.kept(spark, d, "channels").withColumn("rec_ts", O1 + (F.col("ord") % 7 - 3) * 86_400)
    channels = decode(recorded, 256)
    new = H.diff(channels, X.nodes(spark, d), X.updates(spark, d), O1, O1 + 2 * 86_400)["channel_announcements"]
    return new.select(F.lit("new").alias("kind"), "ord").union(H.known_at(channels, O1).select(F.lit("known"), "ord"))


def address_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Addresses over IPv6 and both generations of onion services."""
    c, port = F.col("c_custkey"), F.unhex(F.lit("2607"))
    digest = F.unhex(F.sha2(F.col("c_name").cast("binary"), 256))
    six = F.concat(F.unhex(F.lit("02")), F.unhex(F.concat(F.lit("20010db8" + "0" * 16), F.lpad(F.hex(c), 8, "0"))), port)
    two = F.concat(F.unhex(F.lit("03")), F.substring(digest, 1, 10), port)
    three = F.concat(F.unhex(F.lit("04")), digest, F.substring(digest, 1, 3), port)
    rows = X.table(spark, d, "customer").select("c_custkey", F.posexplode(addresses(F.concat(six, two, three))).alias("place", "a"))
    return rows.select("c_custkey", "place", F.col("a.typ.name").alias("type_name"), F.col("a.addr").alias("addr"), F.col("a.port").alias("port"))


def sql_views(spark: SparkSession, d: str) -> DataFrame:
    """Kinds through their views, and addresses through the table function."""
    register_functions(spark)
    create_views(X.all_messages(spark, d))
    return spark.sql("""SELECT 'updates' AS what, count(*) AS n, CAST(sum(fee_base_msat) AS BIGINT) AS total FROM channel_update
      UNION ALL SELECT 'channels', count(*), CAST(sum(scid_of(scid_text(scid)) - scid) AS BIGINT) FROM channel_announcement
      UNION ALL SELECT 'unknown', count(*), CAST(sum(tag) AS BIGINT) FROM messages WHERE kind = 'unknown' OR kind IS NULL
      UNION ALL SELECT a.type_name, count(*), CAST(sum(a.port) AS BIGINT) FROM node_announcement AS n, LATERAL parse_addresses(n.addresses) AS a GROUP BY a.type_name""")


def sql_encodings(spark: SparkSession, d: str) -> DataFrame:
    """Varints there and back, channel ids of text and base32, in SQL."""
    register_functions(spark)
    X.table(spark, d, "lineitem").createOrReplaceTempView("gossamer_lineitem")
    return spark.sql("""WITH v AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 70000000 ELSE 100000000000000 END AS value FROM gossamer_lineitem)
      SELECT value, varint_width(varint_encode(value)) AS width, CAST(varint_decode(varint_encode(value)) AS BIGINT) AS back, scid_of(concat_ws('x', CAST(value % 1000 AS STRING), '7', '3')) AS scid,
        base32_text(unhex(sha2(CAST(CAST(value AS STRING) AS BINARY), 256))) AS b32 FROM v""")


def _closing(spark: SparkSession, d: str, rows: DataFrame, last: DataFrame, name: str) -> DataFrame:
    """``rows`` as a stream of one file folder, and after them ``last``, which moves the watermark on and stays open itself."""
    path = fresh_path(spark, name)
    rows.coalesce(1).write.parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = X.table(spark, d, "events").select(
        F.timestamp_seconds(X.seconds("ts")).alias("event_time"), F.col("event_type").alias("kind"), F.concat(F.lit("id"), (F.col("user_id") % 50).cast("string")).alias("id"),
        F.concat(F.lit("peer"), (F.col("event_id") % 4).cast("string")).alias("sender"),
    )
    return e, e.limit(1).select(F.lit("2100-01-01 00:00:00").cast("timestamp").alias("event_time"), F.lit("last").alias("kind"), F.lit("last").alias("id"), F.lit("last").alias("sender"))


def activity_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has closed, by kind of event."""
    out = _drained(S.activity(_closing(spark, d, *_events(spark, d), "activity-rows")), "activity")
    return out.select(F.unix_seconds("start").alias("start"), "kind", "messages")


def peers_stream(spark: SparkSession, d: str) -> DataFrame:
    """Which peers delivered a message, by the hour."""
    out = _drained(S.peers(_closing(spark, d, *_events(spark, d), "peers-rows")), "peers")
    return out.select(F.unix_seconds("start").alias("start"), "id", F.array_join("senders", ",").alias("senders"), F.size("times").cast("long").alias("n"))


def fee_change_stream(spark: SparkSession, d: str) -> DataFrame:
    """Updates that change the fees of their channel, as they come in."""
    rows = X.updates(spark, d).select("ord", "scid", "timestamp", "fee_base_msat", "fee_proportional_millionths")
    path = fresh_path(spark, "fee-rows")
    rows.coalesce(1).write.parquet(path)
    found = _drained(S.changed_fees(spark.readStream.schema(rows.schema).parquet(path)), "fee-changes")
    return found.select("ord", B.scid_text(F.col("scid")).alias("scid"), "timestamp", "fee_base_msat", F.col("fee_proportional_millionths").alias("fee_ppm"))


QUERIES = {
    "detected_framings": detected_framings, "broken_files": broken_files, "corrupt_messages": corrupt_messages, "decoded_kinds": decoded_kinds,
    "payload_lengths": payload_lengths, "iso_times": iso_times, "store_versions": store_versions, "responses": responses, "descriptions": descriptions,
    "graph_export_text": graph_export_text, "diff_channels": diff_channels, "address_kinds": address_kinds, "sql_views": sql_views, "sql_encodings": sql_encodings,
    "activity_stream": activity_stream, "peers_stream": peers_stream, "fee_change_stream": fee_change_stream,
}

# -- the same from the tables -------------------------------------------------------------------------------------------------


def _base32(digits: str, n: int) -> str:
    """Base32 in lower case of n bytes given as hex."""
    letters = -(-n * 8 // 5)
    bits = f"array_to_string(list_transform(range(1, {2 * n + 1}), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr({digits}, i, 1)) - 3, 4)), '')"
    value = "+".join(f"{1 << 4 - k} * CAST(substr(rpad({bits}, {5 * letters}, '0'), 5 * j + {k + 1}, 1) AS INTEGER)" for k in range(5))
    return f"array_to_string(list_transform(range(0, {letters}), lambda j: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + {value}, 1)), '')"


_SIMPLE = """b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos DESC, direction DESC) AS rn FROM e) WHERE rn = 1)"""
_HOUR = f"{_SEC('ts')} - {_SEC('ts')} % 3600"
_FRAMES = "(VALUES ('pgcopy'), ('varint'), ('gsp'), ('gossip_store')) AS f(framing)"

ORACLES = {
    "detected_framings": f"SELECT framing, greatest(n - {SKIPPED}, 0) AS messages, CAST(CASE WHEN n > {SKIPPED} THEN {SKIPPED} END AS BIGINT) AS first FROM (SELECT count(*) AS n FROM events) CROSS JOIN {_FRAMES}",
    "broken_files": f"SELECT framing, n - 1 AS whole, CAST(1 AS BIGINT) AS broken FROM (SELECT count(*) AS n FROM events) CROSS JOIN {_FRAMES}",
    "corrupt_messages": f"WITH {_u(True)} SELECT ord, ord % 5 = 0 AS _corrupt, CASE WHEN ord % 5 <> 0 THEN timestamp END AS timestamp, CASE WHEN ord % 5 <> 0 THEN fee_base_msat END AS fee_base_msat FROM u",
    "decoded_kinds": """SELECT kind, messages FROM (SELECT 'channel_announcement' AS kind, count(*) AS messages FROM orders UNION ALL SELECT 'node_announcement', count(*) FROM orders UNION ALL SELECT 'channel_update', count(*) FROM events
 UNION ALL SELECT 'channel_amount', count(*) FROM orders UNION ALL SELECT 'private_update', count(*) FROM events UNION ALL SELECT 'delete_channel', count(*) FROM orders
 UNION ALL SELECT 'private_channel', count(*) FROM orders UNION ALL SELECT 'ended', count(*) FROM orders UNION ALL SELECT 'channel_dying', count(*) FROM orders UNION ALL SELECT 'none', count(*) FROM customer)""",
    "payload_lengths": "SELECT event_id AS ord, CAST(258 AS INTEGER) AS tag, 'channel_update' AS kind, CAST(CASE WHEN event_id % 3 <> 0 THEN 136 ELSE 128 END AS INTEGER) AS bytes FROM events",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events",
    "store_versions": "SELECT o_orderkey, CAST(o_orderkey % 256 // 32 AS INTEGER) AS version FROM orders",
    "responses": """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, lower(hex(encode(c_name))) AS h, strlen(c_name) AS n FROM customer)
 SELECT path, h AS rendered, 'hex' AS form FROM c UNION ALL SELECT path, '{"raw_data":"' || h || '","size":' || n || '}', 'json' FROM c""",
    "descriptions": f"""WITH {_N} SELECT 'delete_channel(ord=' || o_orderkey || ', scid=' || o_custkey || 'x' || o_orderkey % 100 || 'x' || o_orderkey % 7 || ')' AS line FROM orders
 UNION ALL SELECT CAST(ord AS VARCHAR) || ' ' || left(node_id, 47) || '...' FROM n""",
    "graph_export_text": f"""WITH {_u(True)}, {_LATEST.format('')}, {_C}, {_N}, {_LN.format('')}, {_V}, {_E}, {_SIMPLE}, ex AS (SELECT *, src || '|' || dst || '|' || scid || '|' || direction AS key FROM b),
 fn AS (SELECT min(node_id) AS first FROM v), fe AS (SELECT min(key) AS first FROM ex)
 SELECT 'dot' AS format, CAST(1 AS INTEGER) AS section, node_id AS key, '  "' || node_id || '" [announced="' || announced || '"];' AS line FROM v
 UNION ALL SELECT 'dot', 3, key, '  "' || src || '" -> "' || dst || '" [scid="' || scid || '", direction="' || direction || '"];' FROM ex
 UNION ALL SELECT 'gml', 1, node_id, '  node [ id "' || node_id || '" label "' || node_id || '" announced "' || announced || '" ]' FROM v
 UNION ALL SELECT 'gml', 3, key, '  edge [ source "' || src || '" target "' || dst || '" scid "' || scid || '" direction ' || direction || ' ]' FROM ex
 UNION ALL SELECT 'graphml', 1, node_id, '    <node id="' || node_id || '"><data key="n_announced">' || announced || '</data></node>' FROM v
 UNION ALL SELECT 'graphml', 3, key, '    <edge source="' || src || '" target="' || dst || '"><data key="e_scid">' || scid || '</data><data key="e_direction">' || direction || '</data></edge>' FROM ex
 UNION ALL SELECT 'json', 1, node_id, CASE WHEN node_id = first THEN '  ' ELSE ', ' END || '{{"announced":' || announced || ',"id":"' || node_id || '"}}' FROM v CROSS JOIN fn
 UNION ALL SELECT 'json', 3, key, CASE WHEN key = first THEN '  ' ELSE ', ' END || '{{"scid":"' || scid || '","direction":' || direction || ',"source":"' || src || '","target":"' || dst || '"}}' FROM ex CROSS JOIN fe""",
    "diff_channels": "SELECT 'new' AS kind, o_orderkey AS ord FROM orders WHERE o_orderkey % 7 IN (4, 5) UNION ALL SELECT 'known', o_orderkey FROM orders WHERE o_orderkey % 7 <= 3",
    "address_kinds": f"""WITH c AS (SELECT c_custkey, sha256(c_name) AS h FROM customer)
 SELECT c_custkey, CAST(0 AS INTEGER) AS place, 'IPv6' AS type_name, '[2001:db8::' || CASE WHEN c_custkey >= 65536 THEN lower(to_hex(c_custkey // 65536)) || ':' ELSE '' END || CASE WHEN c_custkey > 0 THEN lower(to_hex(c_custkey % 65536)) ELSE '' END || ']' AS addr, CAST(9735 AS INTEGER) AS port FROM c
 UNION ALL SELECT c_custkey, 1, 'Torv2', {_base32('h', 10)} || '.onion', 9735 FROM c UNION ALL SELECT c_custkey, 2, 'Torv3', {_base32("(h || substr(h, 1, 6))", 35)} || '.onion', 9735 FROM c""",
    "sql_views": f"""WITH {_u()} SELECT 'updates' AS what, count(*) AS n, CAST(sum(fee_base_msat) AS BIGINT) AS total FROM u UNION ALL SELECT 'channels', count(*), CAST(0 AS BIGINT) FROM orders
 UNION ALL SELECT 'unknown', count(*), count(*) FROM customer UNION ALL SELECT 'IPv4', count(*), 9735 * count(*) FROM orders WHERE o_orderkey % 5 <> 0 HAVING count(*) > 0""",
    "sql_encodings": f"""WITH v AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 70000000 ELSE 100000000000000 END AS value FROM lineitem), h AS (SELECT value, sha256(CAST(value AS VARCHAR)) AS h FROM v)
 SELECT value, CAST(CASE WHEN value < 253 THEN 1 WHEN value < 65536 THEN 3 WHEN value < 4294967296 THEN 5 ELSE 9 END AS INTEGER) AS width, value AS back, value % 1000 * 1099511627776 + 7 * 65536 + 3 AS scid, {_base32('h', 32)} AS b32 FROM h""",
    "activity_stream": f"SELECT {_HOUR} AS start, event_type AS kind, count(*) AS messages FROM events GROUP BY ALL",
    "peers_stream": f"""SELECT start, id, string_agg(sender, ',' ORDER BY sender) AS senders, CAST(sum(k) AS BIGINT) AS n FROM (SELECT {_HOUR} AS start, 'id' || user_id % 50 AS id, 'peer' || event_id % 4 AS sender, count(*) AS k FROM events GROUP BY ALL) GROUP BY start, id""",
    "fee_change_stream": f"""WITH {_u()}, f AS (SELECT *, lag(fee_base_msat) OVER w AS pb, lag(fee_ppm) OVER w AS pp, row_number() OVER w AS rn FROM u WINDOW w AS (PARTITION BY scid ORDER BY timestamp, ord))
 SELECT ord, scid, timestamp, fee_base_msat, fee_ppm FROM f WHERE rn = 1 OR fee_base_msat <> pb OR fee_ppm <> pp""",
    # queries of the other module
    "base32_text": f"WITH c AS (SELECT c_custkey, sha256(c_name) AS h FROM customer) SELECT c_custkey, {_base32('h', 32)} AS b32 FROM c",
    "graph_analysis": f"""{_CC}, {_u(True)}, {_LATEST.format('')}, {_E}, {_SIMPLE}, s AS (SELECT component, count(*) AS size FROM cc GROUP BY component)
 SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM v WHERE announced) AS announced, (SELECT count(*) FROM v WHERE NOT announced) AS unannounced, (SELECT count(*) FROM b) AS edges,
 (SELECT count(*) FROM b WHERE has_update) AS with_update, (SELECT count(*) FROM b WHERE NOT has_update) AS without_update, (SELECT count(*) FROM s) AS components, (SELECT max(size) FROM s) AS largest,
 CASE WHEN (SELECT count(*) FROM s) > 0 THEN (SELECT count(*) FROM s) = 1 END AS connected""",
}
