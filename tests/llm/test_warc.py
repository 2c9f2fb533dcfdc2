import base64
import gzip
import hashlib

import pyarrow as pa

from clickloom.llm import warc, work

SCHEMA = "page_id long, url string, html string, payload string, sha string, size string"
HOT = "<p>shared</p>" * 40


def pages(spark):
    rows = [(i, f"http://x/{i}", HOT if i % 3 == 0 else f"<p>{i}é</p>", "p", "s", "z") for i in range(200)]
    rows += [(500, "http://x\r\nWARC-Type: fake", None, "p", "s", "z"), (501, None, "", "p", "s", "z"), (None, "u", HOT, "p", "s", "z"), (None, "u", "alone\r\n\r\nX: y", "p", "s", "z")]
    rows += [(198, "again", HOT, "p", "s", "z"), (700, "u", "long " * 100_000, "p", "s", "z")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def expected(rows):
    best = {}
    for page_id, _, html, *_ in rows:
        key = html or ""
        best[key] = max(best.get(key, -1), -1 if page_id is None else page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data, keep = (html or "").encode(), best[html or ""]
        revisit = keep >= 0 and keep != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows, df = pages(spark)
    got = warc.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_index_ranges_and_selected_records(spark):
    rows, df = pages(spark)
    where = work.folder(spark, "warc-test")
    index = warc.write(df, where)
    store, path = work.open_store(where)
    one = index.where("page_id = 700").first()
    with store.open_input_file(f"{path}/{one.file}") as f:
        raw = gzip.decompress(f.read_at(one.length, one.offset))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
    assert raw.count(b"long ") == 100_000
    some = {r.page_id: r for r in warc.read(spark, index.where("page_id % 10 = 1"), where).collect()}
    assert set(some) == {i for i, *_ in rows if i is not None and i % 10 == 1}
    assert bytes(some[11].payload).decode() == "<p>11é</p>"
    assert some[21].payload is None and some[21].refers_to == 198
    every = {r.url for r in warc.read(spark, index, where).collect()}
    assert "http://x%0D%0AWARC-Type: fake" in every


def test_small_payloads_can_be_left_alone(spark):
    _, df = pages(spark)
    kinds = {r.page_id: r.record_type for r in warc.archived(df, least=1).collect()}
    assert kinds[500] == kinds[501] == "response" and kinds[0] == "revisit"


def test_ranges_are_merged_up_to_gap_and_size(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "READ", 100)
    rows = [("a", 0, 40), ("a", 45, 40), ("a", 90, 40), ("a", 500, 5), ("b", 505, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["file", "offset", "length"])
    got = [(f, a, b) for f, a, b, _ in warc._ranges([batch])]
    assert got == [("a", 0, 85), ("a", 90, 130), ("a", 500, 505), ("b", 505, 510)]


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
