import random
import re
from datetime import datetime

import pytest
from pagetide.operators import diff
from pagetide.operators import runs as run_ops
from pagetide.operators import store as stores
from pagetide.plans import storage

RUNS = "run_id long, status string"
PAGES = "run_id long, page_id long, sequence_number int, url string, outcome string"
SNAPSHOTS = "run_id long, page_id long, title string"
PRICES = "run_id long, page_id long, sequence_number int, amount string"


def crawl(spark, ids, title="t", status="completed"):
    """Runs of three pages, one of which couldn't be read; the second has two prices."""
    runs = [(i, status) for i in ids]
    pages = [(i, 10 * i + k, k, f"/{k}", "timeout" if k == 3 else "html") for i in ids for k in (1, 2, 3)]
    snapshots = [(i, 10 * i + k, title) for i in ids for k in (1, 2)]
    prices = [(i, 10 * i + 2, k, str(k)) for i in ids for k in (1, 2)]
    return [spark.createDataFrame(rows, schema) for rows, schema in ((runs, RUNS), (pages, PAGES), (snapshots, SNAPSHOTS), (prices, PRICES))]


def scanned_buckets(spark, rows):
    """What the plan's scans say of the folders they read."""
    return re.findall(r"PartitionFilters: \[.*?(bucket#\d+ (?:IN|=) [^\]]*)\]", re.sub(r"#\d+", "#1", spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")))


def pruned(spark, keys, buckets):
    own = sorted({r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(stores.bucket_of("k", buckets)).collect()})
    return f"bucket#1 = {own[0]})" if len(own) == 1 else f"bucket#1 IN ({','.join(map(str, own))})"


def counts(view):
    return {name: 0 if (rows := view.table(name)) is None else rows.count() for name in run_ops.CRAWL_TABLES}


def test_all_tables_or_none(spark, tmp_path, monkeypatch):
    store = run_ops.crawl_store(spark, str(tmp_path / "s"), 4)
    assert counts(store.view()) == {"runs": 0, "pages": 0, "snapshots": 0, "prices": 0}
    assert run_ops.commit_crawls(store, "a", *crawl(spark, [1, 2])) == 1
    old = store.view()
    whole = {"runs": 2, "pages": 6, "snapshots": 4, "prices": 4}
    assert counts(old) == whole

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    # Killed after the rows are written and before they are published; nothing is cleaned up, as nobody is left to do it.
    with monkeypatch.context() as m:
        m.setattr(stores.Store, "_publish", die)
        m.setattr(stores, "removed", lambda *_: None)
        with pytest.raises(Killed):
            run_ops.commit_crawls(store, "b", *crawl(spark, [3]))
    assert counts(store.view()) == whole and len(list((tmp_path / "s" / "pages").iterdir())) == 2
    # Killed while the manifest is half written.
    with monkeypatch.context() as m:
        m.setattr(stores, "renamed", die)
        m.setattr(stores, "removed", lambda *_: None)
        with pytest.raises(Killed):
            run_ops.commit_crawls(store, "b", *crawl(spark, [3]))
    assert counts(store.view()) == whole
    for _ in range(2):
        assert run_ops.commit_crawls(store, "b", *crawl(spark, [3])) == 2
    assert counts(store.view()) == {"runs": 3, "pages": 9, "snapshots": 6, "prices": 6} and counts(old) == whole
    assert store.sweep() == 0 and store.sweep(hours=-1) >= 2
    assert counts(store.view()) == {"runs": 3, "pages": 9, "snapshots": 6, "prices": 6}


def test_stored_runs_stay(spark, tmp_path):
    store = run_ops.crawl_store(spark, str(tmp_path / "s"), 4)
    run_ops.commit_crawls(store, "a", *crawl(spark, [1, 2]))
    run_ops.commit_crawls(store, "b", *crawl(spark, [2, 3], "later"))
    assert sorted((r.run_id, r.title) for r in store.view().table("snapshots").select("run_id", "title").distinct().collect()) == [(1, "t"), (2, "t"), (3, "later")]
    assert run_ops.commit_crawls(store, "c", *crawl(spark, [1, 3], "last")) == 3  # adds nothing
    assert counts(store.view())["pages"] == 9


@pytest.mark.parametrize("status", ["deferred", "failed", "interrupted"])
def test_runs_that_leave_no_pages(spark, tmp_path, status):
    store = run_ops.crawl_store(spark, str(tmp_path / "s"), 4)
    run_ops.commit_crawls(store, "a", *crawl(spark, [1], status=status))
    assert counts(store.view()) == {"runs": 1, "pages": 0, "snapshots": 0, "prices": 0}


def test_refused_commits_leave_nothing(spark, tmp_path):
    store = run_ops.crawl_store(spark, str(tmp_path / "s"), 4)
    runs, pages, snapshots, prices = crawl(spark, [1, 2])
    cases = {
        "html page has no snapshot": (runs, pages, snapshots.where("page_id <> 11"), prices),
        "snapshot has no html page": (runs, pages.where("page_id <> 11"), snapshots, prices),
        "price has no snapshot": (runs, pages.where("page_id <> 12"), snapshots.where("page_id <> 12"), prices),
        "url twice": (runs, pages.unionByName(pages.where("page_id = 13").selectExpr("run_id", "page_id + 1000 AS page_id", "9 AS sequence_number", "url", "outcome")), snapshots, prices),
        "run is there twice": (runs.unionByName(runs), pages, snapshots, prices),
        "place twice": (runs, pages, snapshots, prices.unionByName(prices)),
    }
    for why, tables in cases.items():
        with pytest.raises(ValueError, match=why):
            run_ops.commit_crawls(store, "a", *tables)
        assert store.view().version == 0 and not [p for name in run_ops.CRAWL_TABLES for p in (tmp_path / "s" / name).glob("commit=*")]
    assert run_ops.commit_crawls(store, "a", runs, pages, snapshots, prices) == 1


def test_another_writer_was_first(spark, tmp_path, monkeypatch):
    """What both would add is added once, whoever comes first."""
    store = run_ops.crawl_store(spark, str(tmp_path / "s"), 4)
    publish, done = stores.Store._publish, []

    def late(self, manifest):
        if not done:
            done.append(True)
            run_ops.commit_crawls(store, "other", *crawl(spark, [2, 3], "other"))
        publish(self, manifest)

    monkeypatch.setattr(stores.Store, "_publish", late)
    assert run_ops.commit_crawls(store, "mine", *crawl(spark, [1, 2], "mine")) == 2
    assert sorted((r.run_id, r.title) for r in store.view().table("snapshots").select("run_id", "title").distinct().collect()) == [(1, "mine"), (2, "other"), (3, "other")]
    assert len(list((tmp_path / "s" / "runs").glob("commit=*"))) == 2


def test_a_number_is_taken_once(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("a")
    b.write_text("b")
    storage.renamed(spark, str(a), str(tmp_path / "n"))
    with pytest.raises(FileExistsError):
        storage.renamed(spark, str(b), str(tmp_path / "n"))
    assert (tmp_path / "n").read_text() == "a" and b.exists()


def test_few_folders_and_pruned_reads(spark, tmp_path):
    store = run_ops.crawl_store(spark, str(tmp_path / "s"), 4)
    run_ops.commit_crawls(store, "a", *crawl(spark, range(200)))
    assert len(list((tmp_path / "s" / "pages").glob("commit=*/bucket=*"))) == 4
    some = store.view().table("pages", spark.createDataFrame([(7,), (9999,)], "run_id long"))
    assert {r.run_id for r in some.collect()} == {7} and some.count() == 3
    assert set(scanned_buckets(spark, some)) == {pruned(spark, [7, 9999], 4)}


def test_compacted(spark, tmp_path):
    store = run_ops.crawl_store(spark, str(tmp_path / "s"), 4)
    for k in range(4):
        run_ops.commit_crawls(store, f"c{k}", *crawl(spark, [k]))
    before, old = counts(store.view()), store.view()
    assert store.compact() == 5 and len(store.view().manifests) == 1 and counts(store.view()) == before == counts(old)
    assert run_ops.commit_crawls(store, "c2", *crawl(spark, [77])) == 5  # its id is known
    assert store.sweep(hours=-1) > 4 and counts(store.view()) == before
    assert run_ops.commit_crawls(store, "new", *crawl(spark, [77])) == 6 and counts(store.view())["runs"] == before["runs"] + 1


def test_life_of_a_run(spark):
    sites = spark.createDataFrame([(1,), (2,)], "site_id long")
    none = spark.createDataFrame([], f"run_id long, site_id long, status string, message string, started_at timestamp, completed_at timestamp, {', '.join(c + ' int' for c in run_ops.COUNTERS)}")
    ask = lambda run, site: spark.createDataFrame([(run, site, datetime(2026, 1, run))], "run_id long, site_id long, started_at timestamp")
    with pytest.raises(LookupError, match="3"):
        run_ops.started(none, sites, ask(1, 3))
    runs = run_ops.started(none, sites, ask(5, 1))
    assert tuple(runs.first()) == (5, 1, "running", run_ops.RUNNING_MESSAGE, datetime(2026, 1, 5), None, 0, 0, 0, 0, 0)
    with pytest.raises(RuntimeError, match="running: 5"):
        run_ops.started(runs, sites, ask(6, 2))
    progress = spark.createDataFrame([(5, 3, 4, 2, 1, 0), (5, 2, 3, 1, 1, 0), (9, 1, 1, 1, 1, 1)], "run_id long, processed int, requested int, successful int, forbidden int, errors int")
    runs = run_ops.progressed(runs, progress)
    assert tuple(runs.first())[6:] == (3, 4, 2, 1, 0)
    bad = run_ops.failed(runs, spark.createDataFrame([(5, "boom", datetime(2026, 2, 1))], "run_id long, error string, at timestamp"))
    assert tuple(bad.first())[2:6] == ("failed", run_ops.FAILED_MESSAGE + "boom", datetime(2026, 1, 5), datetime(2026, 2, 1))
    assert tuple(run_ops.progressed(bad, progress.selectExpr("run_id", "9 AS processed", "requested", "successful", "forbidden", "errors")).first())[6] == 3
    assert run_ops.started(bad, sites, ask(7, 2)).count() == 2


def test_buckets_are_dealt_to_several_tasks(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        dealt = stores.in_buckets(rows, "k", 4)
        got = dealt.selectExpr("bucket", "spark_partition_id() AS p").distinct().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.bucket for r in got} == set(range(4)) and len(got) > 6
    keys = random.Random(1).sample(range(5000), 3)
    near = stores.near(dealt, "k", rows.where(rows.k.isin(keys)), 4)
    assert set(keys) <= {r.k for r in near.collect()}


def test_appended_events_read_their_own_folders(spark, tmp_path):
    """The events of a batch are compared with those of its runs' folders alone, and a replay adds nothing."""
    from pagetide.streaming import diff_stream

    path = str(tmp_path / "e")
    event = lambda runs: spark.createDataFrame([(r, r - 1, "page_added", "/x") for r in runs], "current_run_id long, previous_run_id long, event_type string, url string")
    ids = lambda runs: spark.createDataFrame([(r,) for r in runs], "current_run_id long")
    diff_stream.appended(event([]), path, ids([]), diff.EVENT_KEY)
    assert spark.read.parquet(path).columns[:2] == ["current_run_id", "previous_run_id"]
    for runs in (range(300), [7, 299, 300], [7], [300]):
        diff_stream.appended(event(runs), path, ids(runs), diff.EVENT_KEY)
    assert sorted(r[0] for r in spark.read.parquet(path).select("current_run_id").collect()) == list(range(301))
    assert len(list((tmp_path / "e").glob("bucket=*"))) <= stores.BUCKETS
    own = stores.near(spark.read.parquet(path), "current_run_id", ids([7, 300]))
    assert scanned_buckets(spark, own) == [pruned(spark, [7, 300], stores.BUCKETS)]


def test_numbers_by_ranges(spark):
    from pagetide.operators import neighbours

    rows = spark.createDataFrame([(f"n{k * 37 % 100:02}", k) for k in range(100)], "name string, k int").repartition(5)
    got = neighbours.numbered(rows, "name", "k").collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.name, r.k))] == list(range(1, 101))
    assert neighbours.numbered(rows.limit(0), "name").isEmpty()
