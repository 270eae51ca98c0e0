"""Archives as other programs write them, damaged ones, and payloads that look like records."""

from __future__ import annotations

import gzip

from cairn.llm import warc
from cairn.sources.tables import shared_path


def record(fields, block, version="1.1"):
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/{version}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http(payload, extra=b""):
    return b"HTTP/1.1 200 OK\r\n" + extra + b"\r\n" + payload


def archive(tmp_path, *files):
    for k, records in enumerate(files):
        with open(f"{tmp_path}/{k}.warc.gz", "wb") as f:
            f.write(b"".join(gzip.compress(r) for r in records))
    return str(tmp_path)


def test_urls_and_payloads_that_hold_a_version_line(spark):
    inner = record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:77:x>"}, http(b"inner")).decode()
    rows = [(1, "http://a/WARC/1.1", "one"), (2, "http://b", inner * 3), (3, "http://c/WARC/1.0", None), (4, "http://d", "WARC/1." * 5_000), (5, "http://e", "x" * 16_300 + "WARC/1.1\r\n" * 4_000)]
    path = shared_path(spark, "warc-version-lines")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert all(got[i]["complete"] and bytes(got[i]["payload"]).decode() == (h or "") and got[i]["url"] == u for i, u, h in rows)


def test_standard_segments_and_header_names_in_any_case(spark, tmp_path):
    block = http(b"first second third")
    a, b, c = block[:25], block[25:30], block[30:]
    first = record({"warc-type": "response", "warc-record-id": "<urn:uuid:1>", "warc-segment-number": "1"}, a)
    second = record({"WARC-TYPE": "continuation", "WARC-RECORD-ID": "<urn:uuid:2>", "WARC-SEGMENT-ORIGIN-ID": "<urn:uuid:1>", "WARC-SEGMENT-NUMBER": "2"}, b)
    third = record({"WARC-Type": "continuation", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Segment-Origin-ID": "<urn:uuid:1>", "WARC-Segment-Number": "3", "WARC-Segment-Total-Length": str(len(block))}, c)
    orphan = record({"WARC-Type": "continuation", "WARC-Record-ID": "<urn:uuid:8>", "WARC-Segment-Origin-ID": "<urn:page:9:gone>", "WARC-Segment-Number": "2", "WARC-Segment-Total-Length": "99"}, b"tail")
    old = record({"warc-type": "response", "warc-record-id": "<urn:page:5:a>"}, http(b"plain"), "1.0")
    info = record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:7>"}, b"software: x\r\n")
    path = archive(tmp_path, [info, third, old, orphan], [second, first])
    got = [r.asDict() for r in warc.read_warc(spark, path).collect()]
    found = sorted((r["record_type"], r["page_id"], r["complete"], None if r["payload"] is None else bytes(r["payload"])) for r in got if r["record_type"] == "response" and r["page_id"] is None)
    assert found == [("response", None, True, b"first second third")]
    assert [(r["page_id"], bytes(r["payload"]), r["complete"]) for r in got if r["page_id"] == 5] == [(5, b"plain", True)]
    assert [(r["page_id"], r["complete"], r["payload"]) for r in got if r["record_type"] == "continuation"] == [(9, False, None)]
    assert len(got) == 3


def test_revisits_by_name_and_by_digest(spark, tmp_path):
    digest = "sha1:" + warc.digest32(b"same")
    response = record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:3:r>", "WARC-Payload-Digest": digest}, http(b"same"))
    by_name = record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:page:1:a>", "WARC-Refers-To": "<urn:page:3:r>", "WARC-Payload-Digest": digest, "WARC-Profile": warc.PROFILE}, b"")
    by_digest = record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:page:2:b>", "WARC-Payload-Digest": digest, "WARC-Profile": warc.PROFILE}, b"")
    lost = record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:page:4:c>", "WARC-Payload-Digest": "sha1:NONE", "WARC-Profile": warc.PROFILE}, b"")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["complete"]) for r in warc.read_warc(spark, archive(tmp_path, [by_name, lost], [by_digest, response])).collect()}
    assert got == {1: ("revisit", 3, 4, True), 2: ("revisit", 3, 4, True), 3: ("response", None, 4, True), 4: ("revisit", None, None, False)}


def test_damaged_records(spark, tmp_path):
    good = [record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}:x>"}, http(b"good")) for i in range(3)]
    short = record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:9:x>"}, http(b"bad" * 50)).replace(b"bad" * 40, b"")
    wrong = record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:8:x>", "WARC-Payload-Digest": "sha1:WRONG"}, http(b"good"))
    broken = record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:7:x>"}, http(b"5\r\nab", b"Transfer-Encoding: chunked\r\n"))
    path = archive(tmp_path, [b"rubbish before\r\n", good[0], short, good[1]], [wrong, broken, good[2], short])
    got = sorted((r["page_id"], r["complete"]) for r in warc.read_warc(spark, path).collect())
    assert got == [(0, True), (1, True), (2, True), (7, False), (8, False), (9, False), (9, False)]


def test_headers_of_written_records(spark):
    path = shared_path(spark, "warc-headers")
    warc.write_warc(spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (2, "http://b", "x")], "page_id long, url string, html string"), path)
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    heads = [h.partition("\r\n\r\n")[0] for h in text.split(warc.VERSION)[1:]]
    assert len(heads) == 3 and all("WARC-Date: " in h and "WARC-Record-ID: " in h for h in heads)
    assert sum("WARC-Profile: " in h for h in heads) == 1
