"""Stateful streams against their batch versions, the ledger, and stored results."""

import os
import time

import pytest
from pyspark.sql import functions as F

from siteloom.operators import graph as G
from siteloom.sources import store as S
from siteloom.streaming import crawl_stream as T
from siteloom.streaming import ledger as L
from siteloom.streaming import live


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    live.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream(spark, folder, batches, schema):
    """A stream with one micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        now = time.time() - 1000 + k
        for name in os.listdir(f"{folder}/in/{k}"):
            os.utime(f"{folder}/in/{k}/{name}", (now, now))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


SAMPLES = "job string, ts double, completed long, discovered long, item string"


def test_progress_equals_the_batch_fold(spark, tmp_path):
    rows = [(f"j{k % 3}", 0.4 * k + 0.01 * (k % 2), 3 * k, 100 + k, f"i{k}") for k in range(90)]
    rows += [(None, 5.0, 1, 9, "x"), ("j1", None, 5, 5, "y"), ("j2", 50.0, 400, None, None)]
    batches = [rows[:1], rows[1:40], rows[40:41], rows[41:]]
    made = live.live_progress(stream(spark, tmp_path, batches, SAMPLES), 150, idle=None)
    found = {r["job"]: r for r in live.latest(T.run_once(made, "update", f"{tmp_path}/c", "progress_equal")).collect()}
    batch = T.progress(spark.createDataFrame(rows, SAMPLES), 150).collect()
    assert len(batch) == len(found) == 4
    for r in batch:
        own = found[r["job"]]
        assert [own[c] for c in ("completed", "total", "share", "rate", "eta_seconds")] == [r[c] for c in ("completed", "total", "share", "rate", "eta_seconds")]
    assert found["j0"]["recent"] == [f"i{k}" for k in range(0, 90, 3)][-20:] and len(found["j2"]["recent"]) == 20
    assert found[None]["eta_seconds"] is None and found["j1"]["samples"] == 30


def test_a_late_sample_changes_nothing(spark, tmp_path):
    batches = [[("a", 10.0, 100, 200, "x")], [("a", 5.0, 50, 300, "y")], [("a", 11.0, 110, 200, "z")]]
    made = live.live_progress(stream(spark, tmp_path, batches, SAMPLES), 999, idle=None)
    last = live.latest(T.run_once(made, "update", f"{tmp_path}/c", "progress_late")).first()
    assert (last["completed"], last["rate"], last["samples"]) == (110, 10.0, 2)


def test_idle_jobs_end(spark, tmp_path):
    made = live.live_progress(stream(spark, tmp_path, [[("a", 1.0, 1, 9, "x")]], SAMPLES), 9, idle=0.5)
    query = made.writeStream.format("memory").queryName("idle_jobs").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and not spark.table("idle_jobs").where("ended").count():
            time.sleep(0.5)
        assert [r["ended"] for r in spark.table("idle_jobs").orderBy("ended").collect()] == [False, True]
    finally:
        query.stop()


def loop_urls(n, tail="a/b/c"):
    return [f"https://e.com{'/q' * (k % 5)}/p{k}/{tail}/" for k in range(n)]


def test_evictions_leave_the_stream(spark, tmp_path):
    urls = loop_urls(40)
    few = loop_urls(24, "x/y/z")  # one short of a loop
    flat = [f"https://e.com/p{k}/d/e/f" for k in range(60)]  # one depth only
    batches = [[(u,) for u in part] for part in (urls[:10] + few, urls[5:20] + flat + ["https://e.com/a"], urls[20:], urls)]
    log = stream(spark, tmp_path, batches, "url string")
    made = live.discovered_loops(log, keep=None)
    states = []
    rows = []
    query = made.writeStream.foreachBatch(lambda df, n: rows.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    confirming = [r for r in rows if r[4] == "confirming"]
    assert [r[1] for r in confirming] == [urls[24]] and confirming[0][2] == "a/b/c"
    evicted = [r for r in rows if r[4] == "evicted"]
    assert sorted(r[1] for r in evicted) == sorted(urls[:24]) and {r[0] for r in evicted} == {confirming[0][0]}
    assert {r[1] for r in rows if r[4] == "refused"} == set(urls)  # in the last batch all come again
    assert {r[1] for r in rows if r[4] == "admitted"} == {*urls[:24], *few, *flat}
    assert len([r for r in rows if r[4] == "admitted"]) == 24 + 24 + 60  # repeats are dropped
    # after it is confirmed a tail holds one value, and its addresses are gone
    assert states[-1] < len(few) + len(flat) + 20


def test_ledger_equals_the_link_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FOLD", 3)
    page = lambda k: (f"https://e.com/p{k}", "".join(f'<a href="/p{j}">x</a>' for j in range(k)) + f'<a href="/again/a/again/{k % 2}">t</a>')
    pages = [page(k) for k in range(9)]
    log = stream(spark, tmp_path, [[p] for p in pages], "url string, html string")
    made = L.Ledger(spark, f"{tmp_path}/ledger")
    L.follow(log, made, f"{tmp_path}/c")
    edges = G.links(spark.createDataFrame(pages, "url string, html string")).collect()
    found = {r["url"]: r for r in made.nodes().collect()}
    assert len(found) == 11
    for url, r in found.items():
        assert (r["inbound"], r["outbound"]) == (sum(e["href"] == url for e in edges), sum(e["src"] == url for e in edges))
    assert len(made.store.tables("ledger")) <= 3 and made.store.manifest("ledger")["seq"] == 8
    assert [tuple(r) for r in made.refusals().collect()] == [("trap", 2)]
    left = made.unclassified(spark.createDataFrame([(p[0],) for p in pages[2:]], "url string")).orderBy("url").collect()
    assert [(r["url"], r["level"], r["confidence"]) for r in left] == [(f"https://e.com/p{k}", "L3_LEAF_PAGE", 0.0) for k in (0, 1)]
    # a batch that is run again counts once
    again = spark.createDataFrame(pages[8:], "url string, html string")
    made.add(again, 8)
    assert {r["url"]: r["inbound"] for r in made.nodes().collect()} == {u: r["inbound"] for u, r in found.items()}


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    store.write(spark.range(5), "job")
    broken = spark.range(100).select(F.raise_error(F.lit("stopped")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        store.write(broken, "job")
    assert store.read("job").count() == 5 and not store.is_partial("job")
    # written, but killed before the manifest was put in place
    store.put(spark.range(9), "job", "v-lost")
    assert store.read("job").count() == 5
    store.write(spark.range(2), "job", partial=True)
    assert store.restored("job").where("partial").count() == 2 and store.manifest("job")["seq"] == 2
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_csv(spark, tmp_path):
    rows = [(1, "a", None), (2, "", "x,y"), (3, 'say "x"', "two\r\nlines"), (4, " é", "z")]
    df = spark.createDataFrame(rows, "n long, `a.b` string, c string").orderBy("n")
    S.write_csv(df, f"{tmp_path}/out")
    parts = sorted(n for n in os.listdir(f"{tmp_path}/out") if n.startswith("part-"))
    text = b"".join(open(f"{tmp_path}/out/{n}", "rb").read() for n in parts).decode()
    assert text == '﻿n,a.b,c\r\n1,a,\r\n2,,"x,y"\r\n3,"say ""x""","two\r\nlines"\r\n4, é,z\r\n'
    assert [r["line"] for r in S.csv_lines(df.limit(0)).collect()] == ["﻿n,a.b,c"]
