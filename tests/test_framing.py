"""The four framings: files, detection, truncation, parts, streams."""

import io
import os

import pytest

from gossamer.sources.framing import FRAMINGS, FramingError, begin, detect, frame_all, messages
from gossamer.sources.gossip import PIECE_BYTES, framed_files, messages_of, raw_responses, read_binary, register

ITEMS = [bytes([i]) * (40 + i * 7) for i in range(1, 40)] + [b"x" * 70_000]


def read(data, framing, failfast=False, skip=True):
    f = io.BytesIO(data)
    begin(f, framing, skip)
    return [m for _, m in messages(f, framing, len(data), failfast)]


@pytest.mark.parametrize("framing", FRAMINGS)
def test_round_trip_and_truncation(framing):
    items = [m for m in ITEMS if framing != "gossip_store" or len(m) < 65536]
    data = b"".join(frame_all(items, framing))
    assert read(data, framing) == items and detect(data[:11]) == framing
    assert read(b"".join(frame_all([], framing)), framing) == []
    cut = data[: len(data) - 20]
    assert read(cut, framing) == items[:-1]
    with pytest.raises(FramingError):
        read(cut, framing, failfast=True)


def test_details():
    null = b"".join(frame_all([b"a" * 50], "pgcopy"))
    with_null = null[:19] + b"\x00\x01\xff\xff\xff\xff" + null[19:]
    assert read(with_null, "pgcopy") == [b"a" * 50]
    extended = null[:15] + b"\x00\x00\x00\x03abc" + null[19:]
    assert read(extended, "pgcopy") == [b"a" * 50]
    assert read(null[:-2], "pgcopy") == [b"a" * 50]  # no trailer: what is there is kept
    with pytest.raises(FramingError):
        read(null[:19] + b"\x00\x02", "pgcopy", failfast=True)
    assert read(b"\x02ab\x01c\x02de", "varint") == [b"ab"] and read(b"\x02ab\x00\x02de", "varint") == [b"ab"]
    store = b"".join(frame_all([b"q" * 30], "gossip_store"))
    assert read(store[1:], "gossip_store", skip=False) == [b"q" * 30]
    assert detect(b"\x10" + b"z" * 16) == "gossip_store" and detect(b"") == "varint"


@pytest.mark.parametrize("framing", FRAMINGS)
def test_sources(spark, tmp_path, framing):
    items = [m for m in ITEMS if framing != "gossip_store" or len(m) < 65536]
    for name in "ab":
        (tmp_path / name).write_bytes(b"".join(frame_all(items, framing)))
    register(spark)
    load = lambda **o: spark.read.format("gossip").options(framing=framing, **o).load(str(tmp_path))
    whole = [bytes(r.msg) for r in load().orderBy("ord").collect()]
    assert whole == items * 2
    assert [bytes(r.msg) for r in load(partBytes="500").orderBy("ord").collect()] == whole and load(partBytes="500").rdd.getNumPartitions() > 2
    assert load(startOrd="10").count() == 2 * (len(items) - 10)
    assert [bytes(r.msg) for r in read_binary(spark, f"file://{tmp_path}", framing).orderBy("ord").collect()] == whole
    first = load().orderBy("ord").first()
    assert (first.rec_ts is not None) == (framing == "gossip_store") and first.ord == 0


def test_source_edges(spark, tmp_path):
    register(spark)
    assert spark.read.format("gossip").load(str(tmp_path / "missing")).count() == 0
    (tmp_path / "empty").write_bytes(b"")
    assert spark.read.format("gossip").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="framing"):
        spark.read.format("gossip").option("framing", "tar").load(str(tmp_path)).count()
    got = raw_responses(spark.createDataFrame([("p", bytearray(b"\x01\x02"))], "path string, content binary"), as_json=True).first()
    assert got.rendered == '{"raw_data":"0102","size":2}'


def test_writer_and_stream(spark, tmp_path):
    register(spark)
    rows = spark.createDataFrame([(bytearray(m),) for m in ITEMS], "msg binary").coalesce(1)
    rows.write.format("gossip").option("framing", "gsp").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("gossip").load(str(tmp_path / "out")).count() == len(ITEMS)
    source = tmp_path / "tail"
    source.mkdir()
    data = b"".join(frame_all(ITEMS, "varint"))
    (source / "f").write_bytes(data[:1000])
    run = lambda: spark.readStream.format("gossip").option("framing", "varint").load(str(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "m")).option("path", str(tmp_path / "o")).start()
    for n in (1000, len(data)):
        (source / "f").write_bytes(data[:n])
        q = run()
        q.processAllAvailable()
        q.stop()
    assert [bytes(r.msg) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("ord").collect()] == ITEMS


def test_the_writer_appends_and_overwrites(spark, tmp_path):
    register(spark)
    folder = str(tmp_path / "gossip")
    rows = lambda a, b: spark.range(a, b, 1, 4).selectExpr("CAST(CONCAT('message ', id, repeat('x', 40)) AS BINARY) AS msg")
    save = lambda df, mode: df.write.format("gossip").option("framing", "gsp").option("path", folder).mode(mode).save()
    held = lambda: sorted(bytes(r.msg) for r in spark.read.format("gossip").load(folder).collect())
    save(rows(0, 40), "append")
    save(rows(40, 50), "append")
    assert held() == sorted(bytes(r.msg) for r in rows(0, 50).collect())
    save(rows(60, 70), "overwrite")
    assert held() == sorted(bytes(r.msg) for r in rows(60, 70).collect())
    failing = rows(0, 8).selectExpr("CASE WHEN msg LIKE '%7%' THEN CAST(raise_error('no') AS BINARY) ELSE msg END AS msg")
    with pytest.raises(Exception, match="no"):
        save(failing, "append")
    assert len(held()) == 10 and not [x for x in os.listdir(folder) if x.startswith("_")]


def test_broken_files_fail_unless_told_otherwise(spark, tmp_path):
    data = b"".join(frame_all([b"a" * 40, b"b" * 40], "varint"))
    path = str(tmp_path / "cut")
    with open(path, "wb") as f:
        f.write(data[:-5])
    register(spark)
    for read_ in (lambda: read_binary(spark, path), lambda: spark.read.format("gossip").load(path)):
        with pytest.raises(Exception, match="cut short"):
            read_().collect()
    for kept in (read_binary(spark, path, failfast=False), spark.read.format("gossip").option("mode", "PERMISSIVE").load(path)):
        assert [r.msg for r in kept.orderBy("ord").collect()] == [bytearray(b"a" * 40), None]


@pytest.mark.parametrize("framing", FRAMINGS)
def test_framed_files_come_in_pieces(spark, framing):
    sizes = [40, PIECE_BYTES, 41, 3 * PIECE_BYTES, 65_535] + [50] * 2000 + ([] if framing == "gossip_store" else [3_000_000, 60])
    rows = [(i, bytearray((i % 251).to_bytes(1, "big") * n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, msg binary").coalesce(1).sortWithinPartitions("i").select("msg")
    files = framed_files(df, framing)
    held = files.collect()
    whole = b"".join(frame_all([bytes(m) for _, m in rows], framing))
    # no row holds much more than a piece and a message, which is what a task's memory depends on
    assert b"".join(bytes(r.content) for r in held) == whole and max(len(r.content) for r in held) < PIECE_BYTES + max(sizes) + 20
    assert [r.piece for r in held] == list(range(len(held))) and len(held) > 20
    assert [bytes(r.msg) for r in messages_of(files, framing).orderBy("ord").collect()] == [bytes(m) for _, m in rows]
    late = messages_of(files, start=10).orderBy("ord").collect()
    assert [r.ord for r in late] == list(range(10, len(rows)))
    cut = framed_files(df, framing, leave=30)
    assert b"".join(bytes(r.content) for r in cut.collect()) == whole[:-30]
    with pytest.raises(Exception, match="cut short"):
        messages_of(cut, framing).collect()
    kept = messages_of(cut, framing, failfast=False).orderBy("ord").collect()
    assert [r.msg for r in kept] == [m for _, m in rows[:-1]] + [None]
    assert framed_files(df, framing, leave=10**9).count() == 1 and messages_of(framed_files(df, framing, leave=10**9), framing).count() == 0
    with pytest.raises(Exception, match="expected"):
        messages_of(files.where("piece <> 1"), framing).count()


def test_files_of_several_partitions_and_empty_ones(spark):
    df = spark.range(0, 3000, 1, 3).selectExpr("CAST(CONCAT('message ', id, repeat('x', 40)) AS BINARY) AS msg").where("msg NOT LIKE '%message 1___x%'")
    files = framed_files(df, "varint")
    assert {r.path for r in files.collect()} == {"part-00000", "part-00001", "part-00002"}
    got = messages_of(files.localCheckpoint().coalesce(1), "varint").orderBy("ord").collect()
    assert [bytes(r.msg) for r in got] == [bytes(r.msg) for r in df.collect()] and {r.ord >> 40 for r in got} == {0, 2}


def test_framings_are_detected_over_pieces(spark):
    df = spark.range(0, 500, 1, 1).selectExpr("CAST(CONCAT('message ', id, repeat('x', 40)) AS BINARY) AS msg")
    for framing in FRAMINGS:
        files = framed_files(df, framing)
        assert files.count() > 3
        assert [r.ord for r in messages_of(files, start=100).orderBy("ord").collect()] == list(range(100, 500))
