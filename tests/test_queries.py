"""Every registered order-book query against its SQL in DuckDB."""

import duckdb
import pytest

from ladderbook.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, sf, run, sql):
    frame = run(spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    names = sorted(frame.columns)
    cur = con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({sql})")
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r)) for r in frame.select(*names).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, registry.QUERIES[name], registry.ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_captures_round_trip(spark, sf, tmp_path):
    from ladderbook.sources import adapters, captures

    rows = adapters.market(spark, sf).drop("capture_id").limit(50)
    rows.coalesce(1).write.options(header=True, quote='"', escape='"').csv(str(tmp_path / "m"))
    back = captures.read_market(spark, str(tmp_path / "m"))
    assert not back.filter("bad").count()
    assert sorted(map(tuple, back.drop("capture_id", "bad").collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "x.csv").write_text("recv_tsec,recv_tnsec,venue,stream_kind,shard_id,conn_epoch,conn_seq,symbol,payload_json\n\n1,2,spot\nq,2,spot,trade,0,0,1,A,{},more\n")
    got = captures.read_market(spark, str(tmp_path / "x.csv")).collect()
    assert sorted((r["bad"], r["recv_tsec"], r["capture_id"]) for r in got) == [(False, 0, "x"), (True, 1, "x")]
