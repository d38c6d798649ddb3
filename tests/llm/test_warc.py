"""Archives written, read back and assembled."""

import base64
import gzip
import hashlib
import io

import pytest

from minutewise.llm import warc

TRICKY = 'WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n<p class="é">\r\n\r\nWARC/1.1\r\n\r\n'
PAGES = [
    (5, "http://a/5", "<html>same</html>"), (2, "http://a/2", "<html>same</html>"), (9, None, "<html>same</html>"), (1, "http://a/1", TRICKY),
    (3, "http://a/\r\nx: y", None), (4, "http://a/4", ""), (6, "http://a/6", "日本" * 50_000), (7, "http://a/7", "\x00\x1f"), (None, "http://a/n", "<html>same</html>"),
    (None, "http://b/n", "lone"), (8, "http://a/8", "twice"), (8, "http://a/8", "twice"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, digest int, payload string")


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Large payloads lie in files of their own class, with fewer records each; all captures are read back."""
    pages = [*((k, f"u{k}", f"{k} " * 9) for k in range(7)), *((k, f"u{k}", f"{k}" * 100_000) for k in range(10, 15)), (20, "v", "x" * (1 << 20) + "y")]
    path = str(tmp_path / "w")
    warc.write_archives(frame(spark, pages).coalesce(1), path, warc.WarcParams(file_bytes=2 << 20))
    sizes = [sum(len(r["block"]) for r in warc.parse(gzip.open(f, "rb"))) for f in sorted((tmp_path / "w").glob("*.gz"))]
    assert max(sizes) < 2 << 20 and len(sizes) == 1 + 3 + 1 and warc.read_records(spark, path).count() == 3 * len(pages)
    got = {(r.response.id, r.response.payload_sha1) for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert got == {(f"<urn:page:{i}>", digested(html)) for i, _, html in pages}


def digested(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 17, 18])
def test_captures(spark, tmp_path, least):
    path, params = str(tmp_path / "w"), warc.WarcParams(least_payload=least, file_bytes=2 << 16)
    warc.write_archives(frame(spark, PAGES), path, params)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(rows) == len(PAGES)
    got = set()
    for r in rows:
        page, other = (None if u is None or u == "<urn:page:>" else int(u[10:-1]) for u in (r.response.id, r.response.refers_to))
        assert r.request.id == r.transaction and r.request.head.startswith("GET ")
        if r.response.type == "response":
            text = bytes(r.response.payload).decode()
            assert r.response.payload_sha1 == digested(text) == r.response.digest[5:]
            assert r.response.payload_bytes == len(text.encode()) and f"payloadBytes: {len(text.encode())}" == r.metadata.fields
        got.add((page, r.response.type, other, r.response.digest[5:]))
    want = set()
    for page, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        kept = len((html or "").encode()) < least or page == first
        want.add((page, "response" if kept else "revisit", None if kept else first, digested(html)))
    assert got == want


def test_no_pages(spark, tmp_path):
    warc.write_archives(frame(spark, []), str(tmp_path / "w"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect() == []


def test_files_are_plain_gzip(spark, tmp_path):
    warc.write_archives(frame(spark, PAGES[:4]), str(tmp_path / "w"))
    kinds = [r["type"] for f in (tmp_path / "w").glob("*.gz") for r in warc.parse(gzip.open(f))]
    assert sorted(kinds) == sorted(["request", "metadata"] * 4 + ["response"] * 2 + ["revisit"] * 2)


def test_broken_archives_fail():
    for broken in (b"nonsense\r\n", b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc", b"WARC/1.1\r\nA: b\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse(io.BytesIO(broken)))
