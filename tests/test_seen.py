"""The filter of seen keys."""

from pyspark.sql import functions as F

from pagewright.operators import links as L
from pagewright.operators import seen as S


def test_no_key_is_missed_and_few_are_wrong(spark):
    parts = S.parts_for(20_000)
    keys = spark.range(20_000).selectExpr("concat('http://x.org/', id) AS url")
    bits = S.build_filter(keys, "url", parts).cache()
    assert bits.count() == parts == 4 and {len(r.words) for r in bits.collect()} == {S.PART_BITS // 64}
    assert S.with_maybe_seen(keys, bits, "url", parts).where("NOT maybe_seen").count() == 0
    others = spark.range(20_000).selectExpr("concat('http://y.org/', id) AS url")
    wrong = S.with_maybe_seen(others, bits, "url", parts).where("maybe_seen").count()
    assert wrong < 600  # of 20,000: about one in a hundred
    bits.unpersist()


def test_merged_filters_hold_both(spark):
    a, b = (spark.range(k, 5000, 2).selectExpr("CAST(id AS STRING) AS url") for k in (0, 1))
    both = S.merge_filters(S.build_filter(a, "url", 2), S.build_filter(b, "url", 2))
    assert S.with_maybe_seen(a.union(b), both, "url", 2).where("NOT maybe_seen").count() == 0


def test_unseen_is_exact_when_the_filter_is_full(spark):
    """Far too few bits: nearly all is checked, the rows stay right; repeated and null keys stay too."""
    visited = spark.range(30_000).selectExpr("CAST(id AS STRING) AS url")
    found = spark.range(29_000, 31_000).selectExpr("CAST(id AS STRING) AS url", "id % 2 AS extra").union(spark.sql("SELECT 'new', 1L")).union(spark.sql("SELECT 'new', 1L"))
    found = found.union(spark.sql("SELECT CAST(NULL AS STRING), 7L"))
    got = S.unseen(found, visited, S.build_filter(visited, "url", 1), "url", 1)
    assert got.columns == ["url", "extra"]
    assert sorted(map(str, got.collect())) == sorted(map(str, found.join(visited, "url", "left_anti").collect()))


def test_fewer_rows_enter_the_anti_join(spark):
    visited = spark.range(10_000).selectExpr("CAST(id AS STRING) AS url")
    found = spark.range(9_000, 19_000).selectExpr("CAST(id AS STRING) AS url")
    parts = S.parts_for(20_000)
    entering = S.with_maybe_seen(found, S.build_filter(visited, "url", parts), "url", parts).where("maybe_seen").count()
    assert 1000 <= entering < 1500


def test_frontier_is_the_same(spark):
    links = spark.range(3000).selectExpr("concat('http://x.org/', id) AS src_url", "explode(array(id * 2, id * 3 + 1, id % 50)) AS j").selectExpr("src_url", "concat('http://x.org/', j) AS dst_url")
    seeds = spark.createDataFrame([("http://x.org/1",)], "url string")
    plain = L.expand_frontier(seeds, links, 5)
    large = L.expand_frontier(seeds, links, 5, filter_above=0)
    assert plain.count() > 50
    assert sorted(map(str, plain.collect())) == sorted(map(str, large.collect()))
    assert large.select(F.countDistinct("url")).first()[0] == large.count()
