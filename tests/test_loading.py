"""Records of files of all kinds as streams; loads that die and are run again; an archive that only grows."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from trolley.operators import loading
from trolley.sources import splitter
from trolley.sources.dialects import Dialect, archive, read

HEAD = "<?xml version='1.0'?><!-- <Item>no</Item> --><Root><ChainId>729</ChainId><StoreId><![CDATA[ 12 ]]></StoreId><Items Count='3'>"
RECORDS = [
    "<Item><ItemCode>1</ItemCode><ItemName>חלב &amp; דבש</ItemName><ItemPrice>5.90</ItemPrice></Item>",
    "<Item n='a>b'><ItemCode>2</ItemCode><ItemName><![CDATA[a </Item> b]]></ItemName><ItemPrice>x</ItemPrice><!-- </Item> --></Item>",
    "<Item><StoreId>7</StoreId><ItemCode>3</ItemCode><ItemName>ג</ItemName><ItemPrice>1</ItemPrice></Item>",
]
ROWS = "".join(RECORDS)
TAIL = "</Items></Root>"


def zipped(data, method, streamed):
    out = io.BytesIO()
    if streamed:  # sizes behind the data
        out.seekable = lambda: False
        out.seek = out.tell = None
    with zipfile.ZipFile(out if not streamed else _Pipe(out), "w", method) as z:
        z.writestr("a.xml", data)
        z.writestr("b.xml", data.replace(b"729", b"730") if b"729" in data else data)
    return out.getvalue()


class _Pipe:
    def __init__(self, to):
        self.to = to

    def write(self, data):
        return self.to.write(data)

    def flush(self):
        pass


@pytest.mark.parametrize("charset", ["utf-8", "windows-1255", "utf-16", "utf-16-le", "iso-8859-8"])
@pytest.mark.parametrize("container", ["plain", "gzip", "gzip2", "zip", "stored", "streamed"])
def test_records(charset, container):
    data = (HEAD + ROWS + TAIL).encode(charset)
    packed = {"plain": lambda: data, "gzip": lambda: gzip.compress(data), "gzip2": lambda: gzip.compress(data[:301]) + gzip.compress(data[301:]), "zip": lambda: zipped(data, zipfile.ZIP_DEFLATED, False), "stored": lambda: zipped(data, zipfile.ZIP_STORED, False), "streamed": lambda: zipped(data, zipfile.ZIP_DEFLATED, True)}[container]()
    for size in (1, 7, 1 << 20):
        parts = [packed[a : a + size] for a in range(0, len(packed), size)]
        got = list(splitter.records(iter(parts), "Item", charset, frozenset(["ChainId", "StoreId"])))
        once = got[:3]
        assert [r for _, r in once] == RECORDS
        assert all(f == {"ChainId": "729", "StoreId": " 12 "} for f, _ in once)
        assert len(got) == (6 if container in ("zip", "stored", "streamed") else 3)


def test_a_long_stream_is_held_piece_by_piece():
    def parts():
        yield HEAD.encode()
        for k in range(60_000):
            yield f"<Item><ItemCode>{k}</ItemCode></Item>".encode()
        yield TAIL.encode()

    import tracemalloc

    tracemalloc.start()
    n = sum(1 for _ in splitter.records(parts(), "Item", "utf-8", frozenset()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 200_000


def test_what_is_no_xml_is_refused(monkeypatch):
    monkeypatch.setattr(splitter, "LONGEST", 1000)
    with pytest.raises(ValueError, match="no XML"):
        list(splitter.records(iter([b"<" + b"x" * 600] * 4), "Item", "utf-8", frozenset()))


@pytest.mark.parametrize(("charset", "name", "pack"), [("utf-8", "f.xml.gz", gzip.compress), ("windows-1255", "f.xml", lambda x: x), ("utf-16", "f.zip", lambda x: zipped(x, zipfile.ZIP_DEFLATED, False)), ("utf-8", "no-ending", gzip.compress)])
def test_read_with_fields_of_the_file(spark, tmp_path, charset, name, pack):
    (tmp_path / name).write_bytes(pack((HEAD + ROWS + TAIL).encode(charset)))
    (tmp_path / f"second-{name}").write_bytes(pack((HEAD.replace("729", "800") + ROWS + TAIL).encode(charset)))
    got = sorted({(r.chain_id, r.store_code.strip(), r.item_code, r.raw_name, r.price and float(r.price)) for r in read(spark, str(tmp_path), Dialect("Item", charset)).collect()})
    want = [(c, s, i, n, p) for c in ("729", "800") for s, i, n, p in (("12", "1", "חלב & דבש", 5.9), ("12", "2", "a </Item> b", None), ("7", "3", "ג", 1.0))]
    assert [x for x in got if x[0] in ("729", "800")] == sorted(want)


FILES = "sha256 string, chain_id string, store_code string, file_type string, file_ts timestamp_ntz"


def landed(spark, *names):
    """Files by name: c<chain>-<type>-<day>; 'bad' in the name fails a gate."""
    files, rows, stats = [], [], []
    for name in names:
        chain, kind, day = name.split("-")[:3]
        files.append((name, chain, "s", kind, f"2024-01-0{day} 00:00:00"))
        rows += [(name, f"{name}/{k}") for k in range(3)]
        stats.append((name, ["jump"] if "bad" in name else []))
    ts = spark.createDataFrame(files, "sha256 string, chain_id string, store_code string, file_type string, file_ts string").withColumn("file_ts", F.col("file_ts").cast("timestamp_ntz"))
    return ts, spark.createDataFrame(rows, ROW), spark.createDataFrame(stats, "sha256 string, reasons array<string>")


ROW = "sha256 string, row string"


def held(store):
    kept = {s: sorted(r.row for r in store.rows(s, ROW).collect()) for s in (loading.ACCEPTED, loading.QUARANTINED)}
    return {r.sha256: r.status for r in store.log().collect()}, {s: sorted({x.partition("/")[0] for x in rows}) for s, rows in kept.items()}, {s: len(rows) for s, rows in kept.items()}


def test_deltas_wait_and_nothing_is_loaded_twice(spark, tmp_path):
    store = loading.Store(spark, f"file://{tmp_path}/store")
    assert store.load(*landed(spark, "a-full-1", "a-delta-2", "b-delta-2", "c-full-1-bad", "c-delta-3")) == 1
    log, kept, n = held(store)
    assert log == {"a-full-1": "accepted", "a-delta-2": "accepted", "b-delta-2": "waiting", "c-full-1-bad": "quarantined", "c-delta-3": "waiting"}
    assert kept == {"accepted": ["a-delta-2", "a-full-1"], "quarantined": ["c-full-1-bad"]} and n == {"accepted": 6, "quarantined": 3}
    assert store.load(*landed(spark, "a-full-1", "a-delta-2", "b-delta-2", "c-full-1-bad", "c-delta-3")) is None
    assert store.load(*landed(spark, "a-full-1", "b-delta-2", "b-full-1", "c-delta-3", "c-full-4")) == 2  # c's full file is younger than its delta
    log, kept, n = held(store)
    assert log["b-delta-2"] == log["b-full-1"] == log["c-full-4"] == "accepted" and log["c-delta-3"] == "waiting"
    assert n == {"accepted": 15, "quarantined": 3}


@pytest.mark.parametrize("dies", ["accepted", "quarantined", "log"])
def test_a_load_that_dies_changes_nothing(spark, tmp_path, monkeypatch, dies):
    store = loading.Store(spark, f"file://{tmp_path}/store")
    store.load(*landed(spark, "a-full-1"))
    before = held(store)
    write = loading.Store._write

    def failing(self, rows, kind, batch):
        if kind == dies:
            raise OSError("the machine is gone")
        write(self, rows, kind, batch)

    monkeypatch.setattr(loading.Store, "_write", failing)
    with pytest.raises(OSError, match="gone"):
        store.load(*landed(spark, "a-delta-2", "d-full-1-bad", "e-full-1"))
    assert held(store) == before
    monkeypatch.setattr(loading.Store, "_write", write)
    assert store.load(*landed(spark, "a-delta-2", "d-full-1-bad")) == 2  # one file has gone meanwhile
    log, kept, n = held(store)
    assert log == {"a-full-1": "accepted", "a-delta-2": "accepted", "d-full-1-bad": "quarantined"} and n == {"accepted": 6, "quarantined": 3}


def test_the_archive_adds(spark, tmp_path):
    for folder, files in (("one", {"a": b"1", "b": b"2"}), ("two", {"c": b"2", "d": b"3"})):
        (tmp_path / folder).mkdir()
        for name, data in files.items():
            (tmp_path / folder / name).write_bytes(data)
    for folder in ("one", "two", "two"):
        index = archive(spark, str(tmp_path / folder), str(tmp_path / "kept"))
    kept = [bytes(r.content) for r in spark.read.parquet(str(tmp_path / "kept")).collect()]
    assert sorted(kept) == [b"1", b"2", b"3"] and index.count() == 2
