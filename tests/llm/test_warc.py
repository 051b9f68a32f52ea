"""WARC archives: round trips, equal payloads, pushed predicates, skipped payloads, archives made elsewhere."""

import base64
import gzip
import hashlib
import os
import zlib

import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

from dyadica.llm import warc

FOLDER = "/root/testdata/sf0.001"
LONG = "".join(f"<p>{i * 7919}</p>" for i in range(200_000))
ROWS = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (9, "http://b.example/ü x\r\nEvil: 1", "<p>one</p>"),
    (9, None, "<p>one</p>"), (None, "u", "<p>one</p>"), (3, "", None), (4, "u4", ""), (5, "u5", LONG), (6, "u6", "çà €\r\n\r\nWARC/1.1\r\n\x00"),
    (7, "u7", "HTTP/1.1 200 OK\r\n\r\nx"), (None, "n1", "only nulls"), (None, "n2", "only nulls"), (-5, "m", LONG + "!"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "p", 1) for i, u, h in ROWS], "page_id long, url string, html string, payload string, n long").repartition(3)


@pytest.fixture(scope="module")
def archive(pages, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/archive"
    warc.write_warc(pages, path)
    return path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def wanted(least=0):
    groups = {}
    for i, _, h in ROWS:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        keep = max((x for x in groups[data] if x is not None), default=None)
        response = i == keep or len(data) < least
        out.append((None if i is None else str(i), len(data), digest(data), "response" if response else "revisit",
                    None if response else str(keep), data if response else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_key"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in df.collect()), key=str)


def test_round_trip(spark, archive):
    df = warc.read_warc(spark, archive)
    assert rows(df.where("record_type <> 'warcinfo'")) == wanted()
    ids = {r["record_id"]: r["key"] for r in df.where("record_type = 'response'").collect()}
    for r in df.where("record_type = 'revisit'").collect():
        assert ids[r["refers_to"]] == r["refers_key"] and r["headers"]["warc-profile"].endswith("identical-payload-digest")
    uri = df.where("key = '9' and target_uri is not null").first()["target_uri"]
    assert uri == "http://b.example/%C3%BC%20x%0D%0AEvil:%201"


def test_least_bytes(spark, pages, tmp_path):
    warc.write_warc(pages, f"file://{tmp_path}/a", least_bytes=11)
    df = warc.read_warc(spark, f"file://{tmp_path}/a").where("record_type <> 'warcinfo'")
    assert rows(df) == wanted(11)


def test_files_are_plain_gzip(archive):
    folder = archive[7:]
    text = b"".join(gzip.open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.endswith(".gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == len(ROWS) and LONG.encode() in text


@pytest.mark.parametrize("condition, pushed", [
    ("record_type = 'revisit'", True), ("record_type in ('response', 'x')", True), ("target_uri is null", True),
    ("target_uri like 'http://a%'", True), ("payload_bytes > 100", True), ("payload_bytes <= 10 and record_type != 'warcinfo'", True),
    ("refers_key is not null", True), ("refers_key <=> '9'", True), ("length(target_uri) = 2", False), ("headers['warc-type'] = 'response'", False)])
def test_predicates(spark, archive, condition, pushed):
    names = [c for c in warc.COLUMNS if c != "payload"]
    place = lambda df: sorted((r["file"], r["offset"]) for r in df.collect())
    full = warc.read_warc(spark, archive, names)
    every = spark.createDataFrame(full.collect(), full.schema)
    df = warc.read_warc(spark, archive, names).where(condition)
    assert 0 < len(place(df)) < len(place(every)) and place(df) == place(every.where(condition))
    assert (" Filter " not in df._jdf.queryExecution().executedPlan().toString()) == pushed


def test_unwanted_payloads_are_not_inflated(archive, monkeypatch):
    store, root = warc._store(archive)
    inflated = []
    real = zlib.decompress
    monkeypatch.setattr(warc.zlib, "decompress", lambda *a: inflated.append(1) or real(*a))
    seen = 0
    for name, size, _ in warc.listed(archive):
        file = warc._File(store, os.path.join(root, name))
        seen += len(list(warc.records(file, 0, size, lambda r: r["record_type"] == "response" and r["key"] == "5", True, True)))
    assert seen == 1 and len(inflated) == 1


def test_splits(spark, tmp_path):
    """Large files are cut at records, every record belongs to one partition."""
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                    F.repeat(F.sha2(F.col("id").cast("string"), 256), 2000).alias("html"))
    path = f"file://{tmp_path}/a"
    warc.write_warc(pages.coalesce(1), path, level="0", file_bytes="5000000")
    files = list(warc.listed(path))
    assert len(files) > 2 and any(marks for _, _, marks in files)
    df = warc.read_warc(spark, path, ["key", "record_type"]).where("record_type = 'response'")
    assert df.rdd.getNumPartitions() > 2 and sorted(int(r["key"]) for r in df.collect()) == list(range(400))


def test_foreign_archives(spark, tmp_path):
    """No manifest, no lengths in the members, plain files, no HTTP inside, folded headers."""
    def record(kind, uri, block, more=""):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-target-uri: {uri}\r\n{more}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    http = "Content-Type: application/http;\r\n msgtype=response\r\n"
    one = [record("resource", "a", b"\x00\x01" * 9), record("response", "b", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody", http)]
    two = [record("metadata", "c", b""), record("response", "d", b"HTTP/1.1 404 Not found\r\n\r\n", http), record("response", "e", b"broken", http)]
    os.makedirs(tmp_path / "in" / "deep")
    (tmp_path / "in" / "x.warc").write_bytes(b"".join(one))
    (tmp_path / "in" / "deep" / "y.warc.gz").write_bytes(b"".join(map(gzip.compress, two)))
    (tmp_path / "in" / "z.txt").write_text("no archive")
    df = warc.read_warc(spark, f"file://{tmp_path}/in")
    found = {r["target_uri"]: (r["record_type"], bytes(r["payload"]), r["payload_bytes"]) for r in df.collect()}
    assert found == {"a": ("resource", b"\x00\x01" * 9, 18), "b": ("response", b"body", 4), "c": ("metadata", b"", 0),
                     "d": ("response", b"", 0), "e": ("response", b"broken", 6)}
    assert {r["target_uri"] for r in warc.read_warc(spark, f"file://{tmp_path}/in", ["target_uri", "record_type"]).where("record_type='response'").collect()} == set("bde")


def test_damage_is_found(spark, pages, tmp_path):
    store, root = warc._store(f"file://{tmp_path}")
    good = warc.page_record("1", None, False, "u", b"payload", digest(b"payload"), 7, "d")
    bad = good.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n")
    for name, data in (("good", good), ("bad", bad)):
        (tmp_path / name).write_bytes(warc.member(data, 6))
    read = lambda name, check: list(warc.records(warc._File(store, f"{root}/{name}"), 0, 1 << 20, lambda r: True, True, check))
    assert read("good", True)[0]["payload"] == b"payload" and read("bad", False)[0]["payload"] == b"paXload"
    with pytest.raises(ValueError, match="digest"):
        read("bad", True)


def test_append_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    page = lambda i: spark.createDataFrame([(i, "u", f"t{i}")], "page_id long, url string, html string")
    keys = lambda: sorted(r["key"] for r in warc.read_warc(spark, path, ["key"]).where("key is not null").collect())
    warc.write_warc(page(1), path)
    warc.write_warc(page(2), path)
    assert keys() == ["1", "2"]
    (tmp_path / "a" / "part-lost.warc.gz").write_bytes(warc.member(warc.page_record("8", None, False, "u", b"", digest(b""), 0, "d"), 6))
    assert keys() == ["1", "2"]  # a file that no commit lists


def test_empty_and_query(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").where("record_type = 'response'").collect() == []
    assert compare(warc.op12_warc(spark, FOLDER), connect(FOLDER), warc.OP12_SQL) is None
