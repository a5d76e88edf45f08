from __future__ import annotations

from pathlib import Path

from tallyframe.llm import fixity as fx
from tallyframe.llm.common import fresh_path, written

PAGES = [(i, f"http://h/{i}", f"<p>{'x' * (i % 7)} é {i}</p>") for i in range(300)] + [(5, "http://h/5", "<p>twice</p>"), (5, "http://h/5", "<p>twice</p>"), (None, None, None), (2000, "u", ""), (2001, None, None)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, idx int")


def test_written_replica_is_intact_then_damage_is_found(spark):
    rows = fx.records(pages(spark))
    ours = written(fx.leaves(rows), "t")
    folder = fresh_path(spark, "warc")
    fx.write_warc(rows, f"{folder}/w")
    theirs = written(fx.scan_warc(spark, f"{folder}/w"), "t")
    assert theirs.count() == len(PAGES)
    assert fx.audit(ours, theirs).count() == 0
    file = next(Path(folder.removeprefix("file://")).glob("w/archive=0/*.txt"))
    data = bytearray(file.read_bytes())
    place = ours.where("page_id = 123").first()
    data[place.stop - 8] ^= 1
    file.write_bytes(bytes(data))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    bad = fx.audit(ours, written(fx.scan_warc(spark, f"{folder}/w"), "t")).collect()
    assert [(r.archive, r.idx, r.status) for r in bad] == [(0, place.idx, "corrupt")]


def test_missing_and_extra_records(spark):
    a, b = written(fx.leaves(fx.records(pages(spark))), "t"), written(fx.leaves(fx.records(pages(spark, PAGES[:-1]))), "t")
    assert [(r.archive, r.status) for r in fx.audit(a, b).collect()] == [(1, "missing")]
    assert [(r.archive, r.status) for r in fx.audit(b, a).collect()] == [(1, "extra")]


def test_a_record_missing_in_the_middle_leaves_the_rest_whole(spark):
    a = written(fx.leaves(fx.records(pages(spark))), "t")
    b = written(fx.leaves(fx.records(pages(spark, [r for r in PAGES if r[0] != 100] + [(7000, "u", "new")]))), "t")
    assert sorted((r.archive, r.status) for r in fx.audit(a, b).collect()) == [(0, "missing"), (6, "extra")]
    assert {(r.archive, r.idx) for r in fx.audit(a, b).where("status = 'missing'").collect()} == {(0, 102)}


def test_rows_without_ids_are_many(spark):
    rows = fx.records(pages(spark, [(None, f"u{i}", str(i)) for i in range(5000)] + [(2**60 + 1, "u", ""), (-5, "u", "")]))
    per = {r.archive: r["count"] for r in rows.groupBy("archive").count().collect()}
    assert per[2**50] == 1 and per[-1] == 1 and len(per) == 7 and max(per.values()) < 1400


def test_only_differing_branches_reach_the_leaves(spark):
    a = written(fx.leaves(fx.records(pages(spark))), "t")
    levels = fx.tree(a, fx.height_of(a))
    assert [x.where("archive = 0").count() for x in levels] == [302, 19, 2, 1]


def test_parser_keeps_damage_where_it_is():
    one = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    data = one % 1 + one.replace(b"Length: 2", b"Length: 9") % 2 + one % 3
    assert [x[0] for x in fx.parse_warc(data)] == [1, 2, 3]


def test_empty_tables(spark):
    none = written(fx.leaves(fx.records(pages(spark, []))), "t")
    assert fx.audit(none, none).count() == 0
