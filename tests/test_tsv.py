import datetime as dt

import pytest

from rivulet.sources import tsv


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_conflicting_files(spark, tmp_path):
    a = write(tmp_path / "a.tsv", "id\tn\twhen\tflag\tx\nu1\t1\t2020-01-02\tTRUE\t1\nu2\tNA\t\tF\t2.5\r\n\nu3\t3\t2020-01-03\tNA\t-1e3\n")
    b = write(tmp_path / "b.tsv", "when\tid\tn\textra\n2020-02-01 10:00:00\tu4\t007\t\n2020-02-30\tu5\tx7\tNA\nu6\t1\n")
    one = {f.name: f.dataType.simpleString() for f in tsv.inferred(spark, a)}
    assert one == {"id": "string", "n": "bigint", "when": "date", "flag": "boolean", "x": "double"}
    store = str(tmp_path / "schema")
    schema = tsv.pinned(spark, a, store)
    assert tsv.pinned(spark, [a, b], store) == schema  # the stored one holds
    rows, rejects = tsv.read(spark, [a, b], schema)
    got = {r["id"]: (r.n, r.when, r.flag, r.x) for r in rows.collect()}
    assert got == {"u1": (1, dt.date(2020, 1, 2), True, 1.0), "u2": (None, None, False, 2.5), "u3": (3, dt.date(2020, 1, 3), None, -1000.0)}
    data = (tmp_path / "b.tsv").read_bytes()
    bad = {r.line: (r.offset, r.reason) for r in rejects.collect()}
    assert set(bad) == {"2020-02-01 10:00:00\tu4\t007\t", "2020-02-30\tu5\tx7\tNA", "u6\t1"}
    assert all(data[o : o + len(x)].decode() == x for x, (o, _) in bad.items())
    assert bad["u6\t1"][1] == "2 fields, not 4" and bad["2020-02-30\tu5\tx7\tNA"][1] == "n is no bigint, when is no date"
    both = {f.name: f.dataType.simpleString() for f in tsv.inferred(spark, [a, b])}
    assert both == {"id": "string", "n": "string", "when": "string", "flag": "boolean", "x": "double", "extra": "string"}
    with pytest.raises(ValueError):
        tsv.inferred(spark, write(tmp_path / "c.tsv", "a\ta\n1\t2\n"))


def test_offsets_over_blocks(spark, tmp_path):
    text = "k\tv\n" + "".join(f"{i}\t{'é' * (i % 7)}{i}\n" for i in range(5000))
    path = write(tmp_path / "d.tsv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tsv.lines(spark, path)
        assert got.rdd.getNumPartitions() >= 1
        rows = got.collect()
        data = text.encode()
        assert len(rows) == 5001 and all(data[r.offset : r.offset + len(r.line.encode()) + 1] == (r.line + "\n").encode() for r in rows)
        fine, bad = tsv.read(spark, path, tsv.inferred(spark, path))
        assert fine.count() == 5000 and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
