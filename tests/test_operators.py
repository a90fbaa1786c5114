"""Links, keyed look-ups, distributions, reuse of counts, streaming, checked against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import enrich as E
from pagewright.operators import keyed
from pagewright.operators import links as L
from pagewright.operators import tokens as TK
from pagewright.session import work_dir
from pagewright.streaming import jobs as S


def test_frontier_equals_breadth_first_walk(spark):
    rng = random.Random(3)
    name = "http://g.org/{}".format
    edges = [(name(rng.randrange(60)), name(rng.randrange(60))) for _ in range(150)]
    edges += [(name(0), name(i)) for i in range(0, 60, 2)] + [(name(1), name(1) + "#x"), (name(2), name(2))]
    exclude = ["**/7", "**/1?"]
    links = spark.createDataFrame(edges, "src_url string, dst_url string")
    seeds = spark.createDataFrame([(name(0),), (name(0) + "#top",), (name(5),)], "url string")
    got = {r.url: (r.depth, r.decision) for r in L.expand_frontier(seeds, links, 3, ["**"], exclude).collect()}

    excluded = {name(7), *[name(i) for i in range(10, 20)]}
    want = {name(0): (0, "allowed"), name(5): (0, "allowed")}
    layer = list(want)
    for depth in range(1, 4):
        reached = {b.split("#")[0] for a, b in edges if a in layer} - set(want)
        decision = {u: "depth_exceeded" if depth >= 3 else "excluded_pattern" if u in excluded else "allowed" for u in reached}
        want.update({u: (depth, d) for u, d in decision.items()})
        layer = [u for u, d in decision.items() if d == "allowed"]
    assert got == want


def test_glob_table_by_host_equals_direct_match(spark, monkeypatch):
    urls = [f"https://h{i % 3}.org/{p}" for i in range(9) for p in ("a", "a/b", "x.pdf")]
    globs = ["https://h0.org/**", "https://h1.org/*", "**/*.pdf", "https://h2.org/z"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame([(g,) for g in globs], "pattern string")
    direct = sorted(r.url for r in df.where(U.matches_any_glob("url", globs)).collect())
    for bound in (10_000, 2):
        monkeypatch.setattr(L, "GLOBS_ON_DRIVER", bound)
        kept = sorted(r.url for r in L.filter_by_globs(df, table).collect())
        dropped = sorted(r.url for r in L.filter_by_globs(df, table, keep_matches=False).collect())
        assert kept == direct and sorted(kept + dropped) == sorted(urls)


def test_keyed_lookup_with_hot_keys_equals_join(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_KEYS", 2)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    values = rows.where("k <> 49").groupBy("k").agg(F.count("*").alias("n"))
    got = keyed.attach_by_key(rows, values, ["k"], "n", ["n"], ["id"])
    plain = rows.join(values, "k", "left").select("id", "k", "n")
    assert got.count() == 3000 and got.select("id", "k", "n").exceptAll(plain).isEmpty()


def test_positions_over_buckets(spark):
    rows = spark.createDataFrame([(d, i, d * 100 + i) for d in range(3) for i in range(0, 40, d + 1)], "d int, i long, v int")
    got = keyed.positions(rows, "d", "i", ["v"], bucket=4).orderBy("d", "i").collect()
    for d in range(3):
        mine = [r for r in got if r.d == d]
        assert [r.position for r in mine] == list(range(len(mine)))
        assert [r.prev_v for r in mine] == [None, *[r.v for r in mine][:-1]]


def test_distribution_rules(spark):
    for values, expected in (
        ([3, 1, 4, 1, 5, 9, 2, 6], (3.5, 2, 6, 6.609375, 2.5708704751503917)),
        (list(range(8)), (3.5, 2, 6, 5.25, statistics.pstdev(range(8)))),
        ([7], (7.0, 7, 7, 0.0, 0.0)),
        ([5000, 10, 2000, 2001, 9999], (2001.0, 2000, 5000, statistics.pvariance([5000, 10, 2000, 2001, 9999]), None)),
    ):
        df = spark.createDataFrame([(v,) for v in values], "tokens int")
        r = TK.token_distribution(df).first()
        assert (r.median, r.q1, r.q3) == expected[:3]
        assert abs(r.variance - expected[3]) < 1e-6
        assert expected[4] is None or abs(r.standard_deviation - expected[4]) < 1e-12


def test_equal_edges_do_not_share_a_count(spark):
    head, tail = "h" * 50, "t" * 50
    texts = [head + "one two three four" + tail, head + "onetwothreefourfiv" + tail] * 3 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = TK.count_with_reuse(df, ["id"]).orderBy("id").collect()
    direct = [r.tokens for r in TK.with_tokens(df).orderBy("id").collect()]
    assert [r.tokens for r in got] == direct and direct[0] != direct[1]
    assert [r.copies for r in got] == [3] * 6 + [0, 1]


def test_price_join_keeps_each_row_once(spark):
    rows = spark.createDataFrame([(i, m, 1000) for i, m in enumerate(["a", "a", "b", "zz"])], "id int, model string, tokens int")
    prices = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 1.0), ("a", 0.4), (None, 9.0)], "model string, usd_per_1k double")
    got = sorted((r.id, r.cost) for r in TK.price_join(rows, prices).collect())
    assert got == [(0, 0.5), (1, 0.5), (2, 0.25), (3, 0.0)]


def test_enrichment_success_leaves_out_failed_rows(spark):
    def fail_on_odd(content, so_far, index):
        return {"n": 1 // (1 - index % 2)}

    rows = spark.createDataFrame([(i, "text " * 9) for i in range(6)] + [(6, None)], "chunk_index int, content string")
    rows = rows.selectExpr("*", "'http://x.org/' AS url", "7 AS total_chunks", "length(content) AS length")
    done = E.enrich(rows, F.current_timestamp(), enrichers=[E.python_enricher(fail_on_odd)])
    errors = {r.chunk_index: r.processing.error for r in done.collect()}
    assert errors[0] is None and "division" in errors[1] and errors[6] == "content must be a string"
    stats = E.enrichment_stats(done).first()
    assert (stats.total_chunks, stats.enrichment_success) == (7, 3 / 7)


def test_streamed_windows_equal_batch(spark):
    src = work_dir(spark, "test-events")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(600)
    # files arrive in time order, one per trigger
    for k, part in enumerate((0, 1, 2)):
        events.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(src)
    stream = S.windowed_metrics(S.stream_events(spark, src, files_per_trigger=1), delay="3650 days")
    out, state = work_dir(spark, "test-out"), work_dir(spark, "test-state")
    totals = stream.drop("window_end")
    S.replace_table(totals, out, state).awaitTermination()
    table = spark.read.parquet(out)
    last = table.agg(F.max("batch")).first()[0]
    got = table.where(F.col("batch") == last).drop("batch")
    batch = S.windowed_metrics(events.withColumn("ts", F.col("ts").cast("timestamp"))).drop("window_end")
    assert last == 2 and got.count() == batch.count() and got.exceptAll(batch).isEmpty()


def test_stream_sees_each_url_once(spark):
    src = work_dir(spark, "test-pages")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(10)
    pages.coalesce(1).write.mode("append").parquet(src)
    pages.withColumn("url", F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).coalesce(1).write.mode("append").parquet(src)
    out, state = work_dir(spark, "test-out"), work_dir(spark, "test-state")
    S.append_to(S.first_visits(S.stream_pages(spark, src, files_per_trigger=1)), out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == pages.select(U.normalize("url")).distinct().count()
