import hashlib

from sievelake.llm import fixity

SCHEMA = "page_id long, url string, html string, id long, hash string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def test_faults_are_located(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 9)) for i in range(-40, 9000, 7)]
    bad = [(i, u, h + "!" if i == 9 else h) for i, u, h in rows if i != 233] + [(5, "new", "page")]
    one, two = fixity.Tree(pages(spark, rows)), fixity.Tree(pages(spark, bad))
    assert one.root != two.root and one.root == fixity.Tree(pages(spark, rows[::-1])).root
    got = {r.page_id: r for r in fixity.audit(one, two).collect()}
    assert {i: r.status for i, r in got.items()} == {9: "changed", 233: "missing", 5: "extra"}
    def record(i, u, h):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(h.encode())}\r\n\r\n{h}\r\n\r\n".encode()
    before = [r for r in rows if 0 <= r[0] < 233]
    assert got[233].offset == sum(len(record(*r)) for r in before) and got[233].hash == hashlib.sha256(record(*next(r for r in rows if r[0] == 233))).hexdigest()
    assert fixity.audit(one, fixity.Tree(pages(spark, rows))).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (2, "u", "x"), (None, "u", "lost"), (3, "u", "y" * 200_000)]
    one = fixity.Tree(pages(spark, rows))
    assert one.root == fixity.Tree(pages(spark, rows[:-2] + rows[-1:])).root
    assert {(r.page_id, r.status) for r in fixity.audit(one, fixity.Tree(pages(spark, rows[1:]))).collect()} == {(1, "changed")}
    empty = fixity.Tree(pages(spark, []))
    assert empty.root is None and fixity.audit(empty, empty).count() == 0
    assert {(r.page_id, r.status) for r in fixity.audit(one, empty).collect()} == {(1, "missing"), (2, "missing"), (3, "missing")}
