"""What queries shuffle, and rows that the smallest tables don't have."""

import duckdb

import __spark_entry__
from rolecorpus.catalog import stores
from rolecorpus.operators import index, retrieval, store


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_links_of_pages_that_share_an_address_equal_their_sql(spark, tmp_path):
    html = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    rows = [(7, "https://a.example/p", html("/n1", "/n2", "/n1")), (3, "https://a.example/p", html("/m1", "/n2", "m3")), (5, "https://b.example/q", html(*[f"/k{k}" for k in range(30)]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    df = __spark_entry__.queries()["discover_links"](spark, str(tmp_path))
    got = sorted((r.page_url, r.link, r.pos) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_url, link, pos FROM ({__spark_entry__.oracle_sql()['discover_links']})").fetchall()
    assert got == sorted(want) and len(got) == 2 + 3 + 20
    assert "Exchange" not in _plan(df)


SF = "/root/testdata/sf0.001"


def _exchanges(spark, df_of):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _plan(df_of()).count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_store_shuffles_lines_and_orders_once(spark):
    assert _exchanges(spark, lambda: stores._store(spark, SF)) == 2


def test_a_merge_into_the_store_shuffles_each_side_by_order_and_by_hash(spark):
    assert _exchanges(spark, lambda: __spark_entry__.queries()["store_results"](spark, SF)) == 6


def test_hydration_brings_scores_and_sends_no_hash_through_its_shuffles(spark):
    results = spark.createDataFrame([("h1", ["c", "x", "a"], {"a": (0.5, "f"), "c": (None, "g")}), ("h2", ["a"], {}), ("h3", ["x"], {})], "query_hash string, ids array<string>, scores map<string, struct<score: double, fit: string>>")
    postings = spark.createDataFrame([("a", "A"), ("c", "C")], "id string, title string")
    got = store.hydrate(results, postings)
    assert sorted((r.query_hash, r.place, r.id, r.title, r.score) for r in got.collect()) == [("h1", 1, "c", "C", None), ("h1", 2, "a", "A", 0.5), ("h2", 1, "a", "A", None)]
    assert "hashpartitioning(query_hash" not in _plan(got)
    assert "score" not in store.hydrate(results.drop("scores"), postings).columns


def _posts(spark):
    rows = [(k, f"Alpha{k % 3} beta beta", "co", f"alpha{k % 5} gamma{k % 7} beta the x{k} x{k}") for k in range(120)]
    return spark.createDataFrame(rows, "id long, title string, company string, description string").selectExpr("*", "timestamp_seconds(id % 9) AS published_at")


def test_words_of_a_posting_are_counted_without_a_shuffle(spark, tmp_path):
    counts = index.TermIndex(spark, f"{tmp_path}/ix")._counted(_posts(spark))
    assert "Exchange" not in _plan(counts)
    assert {(r.term, r.a, r.b, r.c) for r in counts.filter("id = 8").collect()} == {("alpha2", 1, 0, 0), ("alpha3", 0, 0, 1), ("beta", 2, 0, 1), ("co", 0, 1, 0), ("gamma1", 0, 0, 1), ("x8", 0, 0, 2)}


def test_an_index_of_a_batch_holds_its_terms_alone_and_ranks_as_the_whole_one(spark, tmp_path):
    posts = _posts(spark)
    terms = spark.createDataFrame([(1, "alpha1"), (1, "beta"), (2, "gamma3"), (2, "alpha2"), (3, "co"), (4, "absent"), (4, "beta")], "query_id int, term string")
    own, whole = index.TermIndex(spark, f"{tmp_path}/own").create(posts, terms), index.TermIndex(spark, f"{tmp_path}/whole").create(posts)
    assert {r.term for r in own.blocks(terms, list(range(16))).collect()} == {"alpha1", "alpha2", "beta", "gamma3", "co"}
    assert own._rows(None).count() < whole._rows(None).count()
    key = lambda df: sorted((r.query_id, r.pos, r.id, round(r["rank"], 9)) for r in df.collect())
    assert key(own.top(terms, posts, 9)) == key(whole.top(terms, posts, 9)) == key(retrieval.rank_topk(retrieval.match_all_terms(terms, posts), posts, 9))
