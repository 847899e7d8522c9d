"""WARC bundles: round trips, seeking, revisits, damage."""

import base64
import hashlib
import io

import pytest
import zstandard

from sparkloom.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a.b/", "one"), (2, "http://a.b/2", "one"), (3, None, None), (4, "http://x\r\ny z", ""), (5, "http://é", "ü" * 400_000), (None, "u", "one"), (7, "u", "seven"), (7, "u", "seven"), (8, "u", "seven"), (9, "v", "nine\r\n\r\nWARC/1.1\r\n")]


def archived(spark, tmp_path, rows, name="w", **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", refers_to string")
    warc.write_warc(warc.mark_revisits(df, **{k: how.pop(k) for k in ("least_bytes", "broadcast_bytes") if k in how}), str(tmp_path / name), **how)
    return str(tmp_path / name)


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        keep = max((j for j in same if j is not None), default=None)
        revisit = len(data) >= least and i != keep
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}, {"least_bytes": 4}, {"frame_bytes": 600, "bundle_bytes": 500}])
def test_round_trip(spark, tmp_path, how):
    path = archived(spark, tmp_path, ROWS, **how)
    got = warc.read_warc(spark, path).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(ROWS, how.get("least_bytes", 0))
    texts = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(bytes(r["payload"]) == texts[r["page_id"]] if r["record_type"] == "response" else r["payload"] is None for r in got)
    assert {r["url"] for r in got if r["page_id"] == 4} == {"http://x%0D%0Ay%20z"}


def test_a_bundle_is_one_zstd_stream_and_frames_stand_alone(spark, tmp_path):
    path = archived(spark, tmp_path, ROWS, frame_bytes=700)
    for r in warc._bundles(spark, path).collect():
        data, reader = bytes(r["bundle"]), warc.BundleReader(bytes(r["bundle"]))
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        frames = [reader.frame(k) for k in reversed(range(len(reader.sizes)))][::-1]
        assert whole == b"".join(frames) and whole.startswith(b"WARC/1.1\r\n")
        for p in r["places"]:
            found, end = warc.parse_record(frames[p["frame"]], p["offset"])
            assert (found["record_id"], end) == (p["record_id"], p["offset"] + p["length"])


def test_records_are_fetched_by_their_ids(spark, tmp_path):
    path = archived(spark, tmp_path, [(k, "u", f"page {k}") for k in range(500)], frame_bytes=2000, bundle_bytes=3000)
    index = warc.record_index(spark, path)
    assert index.select("part", "seq").distinct().count() > 4
    wanted = index.where("page_id % 50 = 7").select("record_id").union(spark.createDataFrame([("<urn:x-page:5:NONE>",)], "record_id string"))
    assert {(r["page_id"], bytes(r["payload"])) for r in warc.fetch_records(spark, path, wanted).collect()} == {(k, f"page {k}".encode()) for k in range(7, 500, 50)}


def test_damage_is_seen():
    out = warc.BundleWriter()
    out.add("x", 1, warc.record_bytes(1, "u", b"text", "response", None, "1970-01-01T00:00:00Z")[1])
    data = out.close()
    assert [r["payload"] for r in warc.BundleReader(data).records()] == [b"text"]
    for broken in (data[:-1], data[:20] + bytes([data[20] ^ 1]) + data[21:], data[:-13] + bytes([data[-13] ^ 1]) + data[-12:], b""):
        with pytest.raises(warc.Damaged):
            list(warc.BundleReader(broken).records())
    record = warc.record_bytes(1, "u", b"text", "response", None, "d")[1]
    for broken in (record.replace(b"text", b"test"), record[:-1], b"no"):
        with pytest.raises(warc.Damaged):
            warc.parse_record(broken)


def test_empty_table(spark, tmp_path):
    path = archived(spark, tmp_path, [(1, "u", "x")])
    empty = warc.mark_revisits(spark.createDataFrame([], SCHEMA))
    warc.write_warc(empty, str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).collect() == [] and warc.fetch_records(spark, path, spark.createDataFrame([], "record_id string")).collect() == []
