import hashlib
import uuid

import pytest

from ledgerflow.llm import archives as A
from ledgerflow.llm.common import shared_dir


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    recs = [(b"http://a b/", b"20240102030405", b"text/html", b"HTTP/1.1 200 OK\r\n\r\n<p>\n\n</p>"), (b"", b"2024", b"text/plain", b""), (b"dns:x", b"20240101000000", b"text/dns", b"\n1\n")]
    got = list(A.read_arc(A.arc_file(recs, version)))
    assert [(r.version, r.block) for r in got] == [(version, r[3]) for r in recs] and [r.url for r in got] == [b"http://a%20b/", b"urn:none", b"dns:x"]
    raw = A.arc_file(recs, version)
    for bad in (raw[:-3], b"no header\n", raw.replace(b"%d 0 ledger" % version, b"7 0 ledger")):
        with pytest.raises(ValueError):
            list(A.read_arc(bad))


def test_urls_with_spaces_are_read():
    line = b"filedesc://x 0.0.0.0 2024 text/plain 9\n1 0 o\nV\n\n\nhttp://h/a b c 1.2.3.4 20240101 text/html 2\nhi\n"
    assert [(r.url, r.block) for r in A.read_arc(line)] == [(b"http://h/a b c", b"hi")]


def test_ids_carry_pages():
    for n in (0, 1, -1, 2**62, 2**63 - 1, -(2**63)):
        assert A.page_of(A.page_urn(n)) == n and uuid.UUID(A.page_urn(n)[10:-1]).version == 8
    assert A.page_of(f"<urn:uuid:{uuid.uuid4()}>") is None and A.page_of(None) is None


def test_round_trip_equals_brute_force(spark):
    big, odd = "<p>" + "x" * 1200, "\r\n\r\nWARC/1.0\r\n" + "y\r\n\r\n\r\n" * 300 + "\r\n"
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "http://c/ d", "short"), (5, "http://d/", "short"), (6, "u", None), (7, "u", ""), (8, "u", odd), (9, "u", odd), (None, "u", big), (3, None, big), (10, "u", "ñ" * 900), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, value int").repartition(3)
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    A.write_warc(pages, path)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == b and r[0] is not None]
        to = max(same) if len(b) >= 1000 and same and i != max(same) else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    got = [tuple(r)[:5] for r in A.read_archives(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_nothing(spark):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    A.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert A.read_archives(spark, path).count() == 0


def test_damage_is_found():
    w = A.to_warc(next(A.read_arc(A.arc_file([(b"u", b"2024", b"text/html", b"HTTP/1.1 200 OK\r\n\r\nbody")], 1))))
    assert [b for _, b in A.read_warc(iter([w]))] == [b"HTTP/1.1 200 OK\r\n\r\nbody"]
    with pytest.raises(ValueError):
        list(A.read_warc(iter([w[:-9]])))
    with pytest.raises(ValueError):
        list(A.read_warc(iter([b"junk", w])))
