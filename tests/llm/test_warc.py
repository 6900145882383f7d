import base64
import hashlib

import pytest

from thicket.llm import warc as W

PAGES = [(5, "http://a", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (9, "http://c", "<p>two ü</p>"), (1, None, None), (2, "u", ""), (None, "n", "<p>one</p>"), (9, "http://c", "<p>two ü</p>"), (4, "x\ny", "z" * 200_000), (None, "q", "only here"), (12, "t", "a\r\n\r\nb")]
SCHEMA = "page_id bigint, url string, html string, sha string, first bigint, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "d") for r in rows], SCHEMA)


def plain(rows, least=0):
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        same = [p for p, _, x in rows if (x or "") == (h or "") and p is not None]
        first = min(same) if same and len(data) >= least else None
        revisit = first is not None and k != first
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_contract(spark, least):
    got = [tuple(r) for r in W.records(W.archives(pages(spark, PAGES), W.WarcParams(dedup_bytes=least))).collect()]
    assert sorted(got, key=str) == sorted(plain(PAGES, least), key=str)


def test_payloads_come_back(spark):
    rows = W.records(W.archives(pages(spark, PAGES), W.WarcParams(archive_bytes=300)), payloads=True).collect()
    texts = {k: (h or "") for k, _, h in PAGES}
    for r in rows:
        if r.page_id is not None:
            assert bytes(r.payload).decode() == (texts[r.page_id] if r.record_type == "response" else "")


def test_archive_format():
    records = [W.encode_record(k, "u", "response", W.digest_of(b"x" * k), None, b"x" * k) for k in range(40)]
    data = W.write_archive(records)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    back = list(W.read_archive(data))
    assert back[1:] == records and b"warcinfo" in back[0]
    with pytest.raises(ValueError):
        list(W.read_archive(data[:-5]))


def test_export_and_empty(spark, tmp_path):
    out = W.export(W.archives(pages(spark, PAGES)), str(tmp_path)).collect()
    assert out and all(r.path.endswith(".warc.zst") for r in out)
    n = sum(1 for r in out for _ in W.read_archive(open(r.path, "rb").read())) - len(out)
    assert n == len(PAGES)
    assert W.records(W.archives(pages(spark, []))).count() == 0
