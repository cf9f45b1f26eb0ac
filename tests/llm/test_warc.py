import base64
import gzip
import hashlib
import io

import pytest

from ledgerlark.llm.shared import new_folder
from ledgerlark.llm.warc import WarcError, digest, member, op2, read_archives, read_records, with_revisits, write_archives

HTML = ["<p>one</p>", "<p>twö</p>", None, "", "x" * 300_000, "<p>one</p>", "a\r\n\r\nb"]


def test_round_trip(spark, tmp_path):
    rows = [(k + 10, f"http://h/{k}\r\nX: y é", HTML[k % len(HTML)]) for k in range(40)] + [(None, None, "<p>one</p>"), (10, "again", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = write_archives(with_revisits(pages).repartition(2), new_folder(spark, "warc"), archive_bytes=2000)
    assert archives.count() > 2 and archives.groupBy().sum("records").first()[0] == len(rows)
    back = read_archives(archives, keep_payload=True).collect()
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, 10**9), page if page is not None else 10**9)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        again = page != first[body]
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None, b"" if again else body))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in back), key=key) == sorted(want, key=key)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert op2(spark, str(tmp_path)).count() == len(rows)


def test_least_bytes_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in with_revisits(pages, least=3).collect()} == {1: None, 2: None, 3: None, 4: 3}
    assert read_archives(write_archives(with_revisits(pages.limit(0)), new_folder(spark, "warc"))).count() == 0


def _read(data):
    return list(read_records(io.BytesIO(data), True))


def test_reader_frames_and_verifies():
    good = member("response", 1, "http://a", b"body" * 9000) + member("revisit", 2, None, b"body" * 9000, 1)
    a, b = _read(good)
    assert a.payload == b"body" * 9000 and b.payload == b"" and b.headers["warc-refers-to"] == "<urn:page:1>"
    assert b.payload_digest == digest(b"body" * 9000) and b.http["content-length"] == "36000"
    raw = gzip.decompress(member("response", 1, "u", b"body"))
    broken = [raw.replace(b"body", b"bady"), raw[:-1], raw + b"x", raw.replace(b"Content-Length: 8", b"Content-Length: 9"), b"HTTP" + raw, raw.replace(b"\r\n\r\n", b"\r\n"), raw.replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A")]
    for x in broken:
        if x != raw:
            with pytest.raises((WarcError, KeyError)):
                _read(gzip.compress(x))
    for cut in (1, 30, len(good) - 3):
        with pytest.raises(WarcError):
            _read(good[:cut])
    with pytest.raises(WarcError):
        _read(b"plain text")
    assert _read(b"") == []


def test_ids_of_any_type(spark):
    for kind, ids in (("string", ["a>b", "é ü", "None", "", "1\r\n2", None]), ("int", [3, 1, 2, None]), ("decimal(20,0)", [10**19, 5])):
        pages = spark.createDataFrame([(str(k) if k is not None and kind != "string" else k, "u", f"<p>{n // 2}</p>") for n, k in enumerate(ids)], "page_id string, url string, html string")
        pages = pages.withColumn("page_id", pages.page_id.cast(kind))
        want = {str(r.page_id): None if r.refers_to is None else str(r.refers_to) for r in with_revisits(pages).collect()}
        back = read_archives(write_archives(with_revisits(pages), new_folder(spark, "warc")), page_type=kind)
        assert dict(back.dtypes)["page_id"] == kind
        assert {str(r.page_id): None if r.refers_to is None else str(r.refers_to) for r in back.collect()} == want and len(want) == len(ids) - ("None" in ids and None in ids)
