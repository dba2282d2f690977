"""WARC archives and stratified shards."""

import struct
import uuid

import pytest
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsiq.llm import shards, warc
from newsiq.llm.batches import shared_folder

PAGES = "page_id long, url string, html string, payload string, digest int"


def written(spark, rows, **options):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    warc.write_pages(spark.createDataFrame(rows, PAGES).repartition(2), path, **options)
    return path, {r.record_id: r for r in warc.read(spark, path).collect()}


def urn(n):
    return f"<urn:page:{'' if n is None else n}>"


def test_round_trip_with_copies_nulls_and_clashing_columns(spark):
    long = "é<p>" * 200_000
    rows = [(3, "http://a/ü%20\r\nX: y", "same", "x", 1), (1, None, "same", None, 2), (2, "http://b", "same", "x", 1), (4, "u", None, "x", 1),
            (5, "u", "", "x", 1), (6, "u", long, "x", 1), (7, "u", "\r\n\r\nWARC/1.1\r\n", "x", 1), (None, "u", "null id", "x", 1)]
    path, got = written(spark, rows)
    assert len(got) == 8 and all(r.error is None for r in got.values())
    assert [got[urn(n)].record_type for n in (1, 2, 3, 4, 5)] == ["response", "revisit", "revisit", "response", "revisit"]
    assert got[urn(3)].refers_to == urn(1) and got[urn(3)].payload is None and got[urn(3)].payload_bytes == 4
    assert got[urn(5)].refers_to == urn(4) and got[urn(5)].payload_bytes == 0
    assert got[urn(1)].target_uri is None and got[urn(3)].target_uri == "http://a/%C3%BC%2520%0D%0AX:%20y"
    assert bytes(got[urn(6)].payload).decode() == long and bytes(got[urn(7)].payload) == b"\r\n\r\nWARC/1.1\r\n"
    assert got[urn(None)].record_type == "response"
    raw = spark.read.format("binaryFile").load(path).collect()
    assert all(struct.unpack("<I", r.content[:4])[0] == warc.DICTIONARY_MAGIC for r in raw if r.content)


def test_small_payloads_are_never_revisits(spark):
    _, got = written(spark, [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)], min_bytes=3)
    assert [got[urn(n)].record_type for n in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]


def test_repeated_rows_and_empty_table(spark):
    path, _ = written(spark, [(1, "u", "x", "", 0), (1, "u", "x", "", 0), (2, "u", "x", "", 0)])
    assert sorted(r.record_type for r in warc.read(spark, path).collect()) == ["response", "response", "revisit"]
    path, got = written(spark, [])
    assert got == {}


def archive(records, dictionary=b"WARC/1.1 Content-Length WARC-Type", compressed=False):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    held = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(held)) + held + b"".join(packer.compress(r) for r in records)


def good(payload=b"hello"):
    import hashlib

    return warc.record("response", "<urn:page:1>", "u", "2024-01-01T00:00:00Z", hashlib.sha1(payload).digest(), len(payload), None, payload)


@pytest.mark.parametrize("compressed", [False, True])
def test_dictionary_frame_may_be_compressed(compressed):
    found = list(warc.frames(archive([good(), good(b"")], compressed=compressed)))
    assert [warc.parse(raw)["payload"] for _, raw, _ in found] == [b"hello", b""]


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        (good().replace(b"WARC/1.1", b"WARC/9.9"), "no WARC head"),
        (good().replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""), "no warc-date"),
        (good().replace(b"WARC-Type", b"WARC-Kind"), "no warc-type"),
        (good() + b"x", "length differs from content-length"),
        (good() + good(), "length differs from content-length"),
        (good().replace(b"hello", b"hullo"), "block digest differs"),
        (good().replace(b"WARC-Type: response\r\n", b"broken\r\nWARC-Type: response\r\n"), "header without colon"),
    ],
)
def test_broken_records_are_named(raw, error):
    assert warc.parse(raw)["error"] == error


def test_broken_frames_end_the_archive_with_a_row():
    whole = archive([good(), good(b"second")])
    cut = list(warc.frames(whole[:-3]))
    assert [e for _, _, e in cut] == [None, "cut off frame"]
    junk = list(warc.frames(whole + b"junk junk"))
    assert [e for _, _, e in junk] == [None, None, "not a frame"]
    damaged = bytearray(whole)
    damaged[-2] ^= 0xFF  # checksum of the last frame
    assert list(warc.frames(bytes(damaged)))[-1][2] is not None
    assert list(warc.frames(b"")) == []


# ---------------------------------------------------------------- shards

DOCS = "doc_id long, text string, source string, shard string, size string, _rank int"


def test_shards_match_the_mixture(spark):
    rows = [(i, "t" * (i % 7), "hot" if i % 3 else f"s{i % 5}", "x", "y", 1) for i in range(1000)]
    rows += [(5000, None, None, None, None, None)] * 3 + [(None, "a", "hot", None, None, None), (6000, "é", "", None, None, None)]
    out = shards.interleave(spark.createDataFrame(rows, DOCS), 16, keep=["source"]).toPandas()
    assert len(out) == len(rows) and out.groupby("shard").size().agg(["min", "max"]).tolist() == [62, 63]
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    whole = out.source.value_counts()
    for source in ("hot", "s0", "s3"):
        per = out[out.source == source].groupby("shard").size().reindex(range(16), fill_value=0)
        assert (per - whole[source] / 16).abs().max() <= 4  # rounding of all strata meets at a cut
    assert out[out.doc_id == 6000]["size"].tolist() == [3] and out[out.doc_id == 5000]["size"].tolist() == [1, 1, 1]


def test_shards_do_not_depend_on_partitions_and_empty_gives_none(spark):
    rows = [(i, f"t{i}", f"s{i % 4}", "x", "y", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    one, many = (shards.interleave(df.repartition(n), 8).orderBy("doc_id").collect() for n in (1, 13))
    assert one == many
    assert shards.interleave(df.limit(0), 8).collect() == []


def test_written_shards_keep_all_columns_but_the_replaced(spark):
    rows = [(i, f"t{i}", "s", "x", "y", i) for i in range(50)]
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    shards.write(spark.createDataFrame(rows, DOCS), path, 4)
    back = spark.read.parquet(path)
    assert set(back.columns) == {"doc_id", "text", "source", "_rank", "size", "text_crc32", "shard", "slot"}
    assert back.groupBy("shard").agg(F.count("*").alias("n")).select("n").distinct().count() <= 2 and back.count() == 50


def test_no_python_in_the_sharding_plan(spark):
    df = spark.createDataFrame([Row(doc_id=1, text="a", source="s")])
    plan = shards.interleave(spark.createDataFrame(df.toArrow()), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
