"""Operators on hand-made tables, and properties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolecorpus import dims
from rolecorpus.operators import daystore, evals, index, merge, owners, retrieval, scoring, snapshots, store, telemetry
from rolecorpus.plans import search
from rolecorpus.sources import feeds, frontier, tenants
from rolecorpus.streaming import jobs


def _formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_greedy_fold_a_dropped_row_blocks_nobody(spark):
    rows = [(1, 0, "u1", "c1"), (1, 1, "u1", "c2"), (1, 2, "u3", "c2"), (2, 0, "u1", "||"), (2, 1, "u2", "||")]
    got = merge.greedy_dedupe(spark.createDataFrame(rows, "query_id int, pos int, url_key string, content_key string")).collect()
    assert {(r.query_id, r.pos) for r in got} == {(1, 0), (1, 2), (2, 0), (2, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_fold_and_greedy_keep_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(1, k, f"u{rng.randrange(8)}", rng.choice(["", "||", *(f"c{n}" for n in range(8))])) for k in range(40)]
    seen_u, seen_c, want = set(), set(), set()
    for _, k, u, c in rows:
        blank = c in ("", "||")
        if u in seen_u or (not blank and c in seen_c):
            continue
        want.add(k)
        seen_u.add(u)
        seen_c |= set() if blank else {c}
    df = spark.createDataFrame(rows, "query_id int, pos int, url_key string, content_key string")
    assert {r.pos for r in merge.greedy_dedupe(df).collect()} == want
    keys = [F.col("url_key"), F.when(~F.col("content_key").isin("", "||"), F.col("content_key"))]
    for fold_rows, rounds in ((100, 6), (8, 1), (0, 50))[: 1 if seed else 3]:  # folded at once, in components and prefixes, by rounds alone
        assert {r.pos for r in merge.greedy_keep(df, keys, "pos", fold_rows=fold_rows, rounds=rounds).collect()} == want


def test_greedy_keep_of_a_long_chain(spark):
    rows = [(k, f"u{k // 2}", f"c{(k + 1) // 2}") for k in range(1000)]
    df = spark.createDataFrame(rows, "pos int, url string, dedup_key string")
    want = {k for k in range(1000) if k % 2 == 0}
    keys = [F.col("url"), F.col("dedup_key")]
    assert {r.pos for r in merge.greedy_keep(df, keys, "pos").collect()} == want
    assert {r.pos for r in merge.greedy_keep(df, keys, "pos", fold_rows=200, rounds=2).collect()} == want
    known = spark.createDataFrame([("u3", "x"), ("z", "c9")], "url string, dedup_key string")
    got = {r.batch_pos for r in merge.insert_if_absent(known, df.withColumnRenamed("pos", "batch_pos")).collect()}
    seen_u, seen_c, plain = {"u3", "z"}, {"x", "c9"}, set()
    fresh = [(k, u, c) for k, u, c in rows if u not in seen_u and c not in seen_c]
    for k, u, c in fresh:
        if u not in seen_u and c not in seen_c:
            plain.add(k)
            seen_u.add(u)
            seen_c.add(c)
    assert got == plain


def test_greedy_keep_of_a_chain_longer_than_a_task_may_fold(spark, monkeypatch):
    rng = random.Random(5)
    # two groups, in each a chain in which every row hangs on the row before, with random links across it
    rows = [(g, k, f"u{k // 2}", f"c{(k + 1) // 2}" if rng.random() < 0.97 else f"c{rng.randrange(500)}") for g in (1, 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "g int, pos int, u string, c string").repartition(5)
    want, seen = set(), set()
    for g, k, u, c in rows:
        if (g, "u", u) not in seen and (g, "c", c) not in seen:
            want.add((g, k))
            seen |= {(g, "u", u), (g, "c", c)}
    sizes, prefixes = [], merge._prefixes

    def spied(owned, pos, fold_rows):
        out = prefixes(owned, pos, fold_rows)
        sizes.extend(out.groupBy("owner", "step").count().collect())
        return out

    monkeypatch.setattr(merge, "_prefixes", spied)
    got = merge.greedy_keep(df, [F.col("u"), F.col("c")], "pos", ["g"], fold_rows=200, rounds=1)
    assert {(r.g, r.pos) for r in got.collect()} == want
    assert max(r["count"] for r in sizes) <= 200 and max(r.step for r in sizes) >= 3


def test_merge_policies(spark):
    current = spark.createDataFrame([(1, "a", 5.0, "x"), (2, "b", None, "x")], "k int, t string, s double, src string")
    batch = spark.createDataFrame([(2, None, None, "y"), (1, "z", None, "y"), (3, "n", 1.0, "y")], "k int, t string, s double, src string")
    got = {r.k: tuple(r)[1:] for r in merge.merge(current, batch, ["k"], {"s": "coalesce", "src": "keep"}).collect()}
    assert got == {1: ("z", 5.0, "x"), 2: (None, None, "x"), 3: ("n", 1.0, "y")}


def test_write_buckets_replaces_only_touched_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = spark.range(40).select(F.col("id").cast("string").alias("url"), F.lit(1).alias("v"))
    merge.write_buckets(rows, path, buckets=8)
    touched = spark.read.parquet(path).filter("bucket = 3")
    merge.write_buckets(spark.createDataFrame([(r.url, 2) for r in touched.collect()], "url string, v int"), path, buckets=8)
    after = spark.read.parquet(path)
    assert after.count() == 40 and after.filter("v = 2").count() == after.filter("bucket = 3").count() > 0


def test_query_understanding(spark):
    q = spark.createDataFrame([("ai engineer role in hyderabad for 3 years of experience",), ("react engineer",), ("Plumber",), ("in",)], "q string")
    got = {r.q: (r.f.role, r.f.location, r.f.yearsExperience, r.route) for r in q.select("q", retrieval.rule_parse(F.col("q")).alias("f"), retrieval.parse_route(F.col("q")).alias("route")).collect()}
    assert got["ai engineer role in hyderabad for 3 years of experience"] == ("ai engineer", "Hyderabad", 3, "rule")
    assert got["react engineer"] == ("react engineer", None, None, "fast") and got["Plumber"][3] == "model" and got["in"][1] == "in"
    strict = q.filter("q = 'in'").select(retrieval.rule_parse(F.col("q"), strict_aliases=True).alias("f")).first().f
    assert strict.location is None and strict.role == "in"


def test_sanitize_filters(spark):
    rows = ['{"yearsExperience": 3.9, "freshnessDays": 9999, "role": " a ", "skills": [' + ",".join(["1", *(f'"s{k}"' for k in range(30))]) + "]}", '{"yearsExperience": "3", "remote": "yes", "role": 5, "salaryMin": -1}', "[]", "not json", None]
    got = [r.f for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").orderBy("k").select(retrieval.sanitize_filters(F.col("x")).alias("f")).collect()]
    assert got[0].yearsExperience == 3 and got[0].freshnessDays == 365 and got[0].role == "a" and len(got[0].skills) == 20
    assert all(v is None for g in got[1:] for v in g)


def test_query_terms_and_division(spark):
    q = spark.createDataFrame([(1, "C/C++ backend"), (2, "backend backend go"), (3, "+")], "query_id int, role string")
    terms = retrieval.query_terms(q, ["role"])
    assert sorted((r.query_id, r.term) for r in terms.collect()) == [(1, "backend"), (2, "backend"), (2, "go")]
    p = spark.createDataFrame([(1, "Backend dev", "c", "go go"), (2, "Backend", "c", "x")], "id int, title string, company string, description string").withColumn("published_at", F.lit(None).cast("timestamp"))
    found = retrieval.match_all_terms(terms, p)
    assert {(r.query_id, r.id) for r in found.select("query_id", "id").distinct().collect()} == {(1, 1), (1, 2), (2, 1)}
    rank = {(r.query_id, r.id): r.rank for r in retrieval.rank_topk(found, p).collect()}
    assert abs(rank[2, 1] - (0.5 + 0.2 * 2 / 3)) < 1e-12


def test_written_index_is_read_by_term(spark, tmp_path):
    p = spark.createDataFrame([(k, f"title w{k % 7}", "co", f"text x{k % 5} x{k % 5} common") for k in range(60)], "id long, title string, company string, description string")
    built = retrieval.build_index(p)
    assert {(r.term, r.id, r.tf) for r in built.filter("field = 'C' and term like 'x%'").collect()} == {(f"x{k % 5}", k, 2) for k in range(60)}
    retrieval.write_index(built, f"{tmp_path}/index", buckets=16)
    terms = spark.createDataFrame([(1, "x2"), (1, "common"), (2, "w3"), (2, "x1"), (2, "title"), (3, "absent"), (3, "common")], "query_id int, term string")
    part = retrieval.read_index(spark, f"{tmp_path}/index", terms, buckets=16)
    assert part.count() < built.count()
    got = {(r.query_id, r.id) for r in retrieval.match_all_terms(terms, None, part).select("query_id", "id").distinct().collect()}
    assert got == {(1, k) for k in range(60) if k % 5 == 2} | {(2, k) for k in range(60) if k % 7 == 3 and k % 5 == 1}


def _posts(spark, rng, ids, words):
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(3), text(1), text(rng.randrange(12))) for k in ids]
    return spark.createDataFrame(rows, "id long, title string, company string, description string").withColumn("published_at", F.timestamp_seconds((F.col("id") % 7) * 1000))


def _same(a, b):
    key = lambda df: sorted((r.query_id, r.pos, r.id, round(r["rank"], 9)) for r in df.collect())
    return key(a) == key(b)


def test_kept_index_with_a_delta_equals_a_new_one(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    old, new = _posts(spark, rng, range(200), words), _posts(spark, rng, [*range(0, 200, 10), 300, 301], words)
    gone = spark.createDataFrame([(5,), (7,)], "id long")
    now = old.join(new, "id", "left_anti").join(gone, "id", "left_anti").unionByName(new)
    terms = spark.createDataFrame([(1, "w1"), (1, "w2"), (2, "w3"), (3, "w4"), (3, "absent"), (4, "w5"), (4, "w6"), (4, "w7")], "query_id int, term string")
    built = index.TermIndex(spark, f"{tmp_path}/ix", buckets=8).create(old)
    assert _same(built.top(terms, old, 7), retrieval.rank_topk(retrieval.match_all_terms(terms, old), old, 7))
    built.add(new, gone)
    want = {(r.query_id, r.id, r.field, r.term, r.tf) for r in retrieval.match_all_terms(terms, now).collect()}
    for segments in (2, 1):
        assert len(built.segments()) == segments
        got = {(r.query_id, r.id, r.field, r.term, r.tf) for r in retrieval.match_all_terms(terms, None, built.rows(terms)).collect()}
        assert got == want and _same(built.top(terms, now, 5), retrieval.rank_topk(retrieval.match_all_terms(terms, now), now, 5))
        built.compact()
    again = index.kept_index(spark, "t", now, spark.read.parquet(f"{tmp_path}/ix/{built.segments()[0]}/rows"))
    assert index.kept_index(spark, "t", None, spark.read.parquet(f"{tmp_path}/ix/{built.segments()[0]}/rows")).segments() == again.segments()


@pytest.mark.parametrize("first", [1, 50, 20_000])
def test_blocks_that_can_not_rank_are_not_joined(spark, tmp_path, monkeypatch, first):
    monkeypatch.setattr(index, "FIRST_ROWS", first)
    rows = [(k, "alpha beta" if k % 40 == 0 else "alpha" if k % 41 == 0 else "x", "co", "alpha beta" if k % 3 else "beta only") for k in range(3000)]
    posts = spark.createDataFrame(rows, "id long, title string, company string, description string").withColumn("published_at", F.timestamp_seconds(F.col("id") % 50))
    terms = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "beta"), (3, "only"), (3, "alpha")], "query_id int, term string")
    built = index.TermIndex(spark, f"{tmp_path}/ix", buckets=4).create(posts)
    assert _same(built.top(terms, posts, 20), retrieval.rank_topk(retrieval.match_all_terms(terms, posts), posts, 20))
    pair = terms.filter("query_id = 1")
    every, read_first, reached = (sum(r.n for r in df.collect()) for df in built.wanted_blocks(pair, 20))
    assert every == 3000 + sum("alpha" in r[1] + r[3] for r in rows) and reached < every / 5 and (first > 50 or read_first < every / 5)


def test_places_join_by_runs_of_words(spark):
    p = spark.createDataFrame([(1, "San  Francisco, CA"), (2, "san jose"), (3, " "), (4, None), (5, "San Francisco, CA")], "id int, location_raw string")
    q = spark.createDataFrame([(1, ["san francisco", "sf"]), (2, ["francis"]), (3, None), (4, ["a, b"])], "query_id int, loc_terms array<string>")
    got = {(r.query_id, r.place, r.n) for r in retrieval.match_locations(q, p).collect()}
    assert got == {(1, "San  Francisco, CA", 1), (1, "San Francisco, CA", 1), (3, None, 5)}


def _search(spark, scorer, stored=None, external=(), n_postings=8):
    cols = "id long, url string, title string, company string, description string, location_raw string, is_remote boolean, published_at timestamp"
    p = [(k, f"https://jobs.lever.co/co{k}/{k}", f"Backend engineer {k}", f"co{k}", "pays $100k - $120k per year" if k % 2 else "x", "Pune", None, None) for k in range(n_postings)]
    postings = spark.createDataFrame(p, cols).withColumn("published_at", F.timestamp_seconds(1_700_000_000 + F.col("id")))
    filters = "struct<role: string, location: string, remote: boolean, seniority: string>"
    queries = spark.createDataFrame([(1, "backend engineer", None, 7), (2, "Other engineer", ("engineer", None, None, None), 7)], f"query_id long, raw_query string, filters {filters}, owner long")
    store = spark.createDataFrame(stored or [], "query_hash string, raw_hash string, ids array<string>, scores map<string, struct<score: double, fit: string>>, created_at timestamp")
    external = spark.createDataFrame(list(external), "query_id long, pos int, url string, title string, company string, location string")
    hidden = spark.createDataFrame([(7, "co3")], "owner long, company string")
    as_of = F.timestamp_seconds(F.lit(1_700_100_000))
    return search.batch_search(search.SearchInputs(queries, postings, store, external, hidden), as_of, scorer=scorer, newest=True)


def test_search_plan_scores_dates_and_salaries(spark):
    done = _search(spark, lambda q, texts: [(0.9 if "5" in t else 0.3 if "6" in t else 0.6, "fine") for t in texts])
    rows = [r for r in done["results"].orderBy("query_id", "place").collect() if r.query_id == 1]
    assert [r.url[-1] for r in rows] == ["7", "5", "4", "2", "1", "0"]  # newest first; 6 scores too low and 3 is hidden
    assert [r.salary_min_usd for r in rows[:3]] == [100_000.0, 100_000.0, None] and rows[1].score == 0.9 and not rows[0].from_store
    assert done["store"].count() == done["results"].count()


def test_search_plan_scores_external_candidates_in_a_pass_of_their_own(spark):
    external = [(2, k, f"https://acme.example/careers/{k}", f"data analyst {k}", f"acme{k}", "Pune") for k in range(3)]
    done = _search(spark, lambda q, texts: [(0.5 + len(texts) / 100, "fine")] * len(texts), external=external, n_postings=2)
    rows = [(r.query_id, "acme" in r.url, r.score) for r in done["results"].collect()]
    assert sorted(rows) == [(1, False, 0.52)] * 2 + [(2, False, 0.52)] * 2 + [(2, True, 0.53)] * 3
    alone = _search(spark, lambda q, texts: [(0.5, "fine")] * len(texts), external=external[:1], n_postings=2)
    assert sorted((r.score, r.query_id) for r in alone["results"].collect() if r.query_id == 2) == [(0.5, 2), (0.5, 2), (1.0, 2)]


def test_search_plan_when_the_scorer_fails(spark):
    def scorer(query, texts):
        if "backend" in query:
            raise RuntimeError("down")

    done = _search(spark, scorer)
    rows = done["results"].collect()
    first = [r for r in rows if r.query_id == 1]
    assert len(first) == 8 and {(r.score, r.fit) for r in first} == {(0.5, "")}  # nothing filtered
    second = [r for r in rows if r.query_id == 2]
    assert len(second) == 7 and {(r.score, r.fit) for r in second} == {(0.5, "Relevance not rated")}
    assert {r.raw_hash for r in done["store"].select("raw_hash").distinct().collect()} == {second[0].raw_hash}


def test_search_plan_answers_from_the_store(spark):
    import datetime
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [sha(f"https://jobs.lever.co/co{k}/{k}") for k in (4, 3, 1, 99, 2)]
    stored = [("h", sha("backend engineer"), ids, {ids[0]: (0.9, "kept"), ids[4]: (0.1, "low")}, datetime.datetime.fromtimestamp(1_700_099_000, datetime.UTC)), ("g", sha("other engineer"), [sha("gone")], {}, datetime.datetime.fromtimestamp(1_700_099_000, datetime.UTC))]
    done = _search(spark, None, stored)
    rows = done["results"].collect()
    assert {(r.url[-1], r.score, r.fit) for r in rows if r.query_id == 1} == {("4", 0.9, "kept"), ("1", 0.5, "")}  # hidden, gone and low ones left out
    assert all(r.from_store for r in rows if r.query_id == 1) and not any(r.from_store for r in rows if r.query_id == 2) and any(r.query_id == 2 for r in rows)
    assert done["hits"].count() == 1


def test_index_with_a_stemmer(spark):
    p = spark.createDataFrame([(1, "Engineers", "c", "building")], "id int, title string, company string, description string")
    got = {r.term for r in retrieval.build_index(p, retrieval.stemmer(lambda w: w.removesuffix("s").removesuffix("ing"))).collect()}
    assert {"engineer", "build"} <= got


@pytest.mark.parametrize(("title", "want", "out"), [("Senior Engineer", "junior", True), ("Engineer I", "senior", True), ("Sr. Engineer", "intern", True), ("Engineer", "senior", False), ("Junior Dev", "mid", False), ("VP, Sales", "entry", True), (None, "junior", False)])
def test_seniority(spark, title, want, out):
    row = spark.createDataFrame([(title, want)], "t string, w string")
    assert row.select(retrieval.contradicts_seniority(F.col("t"), F.col("w")).alias("c")).first().c is out


def test_validate_scores(spark):
    c = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, False), (2, 0, False), (3, 0, True), (3, 1, True)], "query_id long, pos int, batch_failed boolean")
    raw = spark.createDataFrame([(1, 0, 1.5, "f" * 90), (1, 1, 0.7, "ok"), (1, 99, 0.9, "x"), (2, 0, 0.1, "y")], "query_id long, pos int, score double, fit string")
    got = {(r.query_id, r.pos): (r.score, r.fit) for r in scoring.validate_scores(c, raw).collect()}
    assert got == {(1, 0): (0.5, "f" * 80), (1, 1): (0.7, "ok"), (2, 0): (1.0, "y"), (3, 0): (0.5, "Relevance not rated"), (3, 1): (0.5, "Relevance not rated")}


def test_merge_candidates_local_first(spark):
    cols = "query_id long, pos int, url string, title string, company string, location string"
    local = spark.createDataFrame([(1, 0, "https://a.example/en-us/1", "Dev", "Co", "Pune"), (1, 1, "https://a.example/2", "Dev", "Co", "Delhi")], cols)
    other = spark.createDataFrame([(1, 0, "https://a.example/1?x=1", "Else", "E", ""), (1, 1, "https://b.example/blog/x", "Post", "P", ""), (1, 2, "https://c.example/9", "Dev", "Co", "Goa")], cols)
    got = [(r.pos, r.url) for r in scoring.merge_candidates(local, other).orderBy("pos").collect()]
    assert got == [(0, "https://a.example/en-us/1"), (1, "https://a.example/2"), (2, "https://c.example/9")]


def test_percentiles_by_nested_histograms(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.randrange(50), rng.randrange(10**6), -rng.randrange(10**12), 7]) for _ in range(400)] + [None]
    df = spark.createDataFrame([(v, k % 3 == 0) for k, v in enumerate(values)], "v long, third boolean")
    asked = [(s, q) for s in ("all", "third", "none") for q in (0.0, 0.5, 0.95, 0.99, 1.0)]
    got = telemetry.exact_percentiles(df, "v", {"all": F.lit(True), "third": F.col("third"), "none": F.lit(None).cast("boolean")}, asked)
    want = [r for s in ("true", "third", "false") for r in df.filter(s).agg(*[F.percentile("v", q) for q in (0.0, 0.5, 0.95, 0.99, 1.0)]).first()]
    assert all(a == b or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(got, want, strict=True))
    assert telemetry.exact_percentiles(df.limit(0), "v", {"all": F.lit(True)}, [("all", 0.5)]) == [None]
    assert telemetry.exact_percentiles(df.filter("v = 7"), "v", {"all": F.lit(True)}, [("all", 0.5)]) == [7.0]


def test_sliding_window_by_slices_and_as_a_stream(spark, tmp_path):
    rng = random.Random(5)
    second = 1_000_000
    rows = [(k % 3 if k % 2 else 7, k, rng.choice([rng.randrange(3000), rng.randrange(-500, 500)]) * second // rng.choice([1, 1, 3])) for k in range(800)]
    rows += [(9, 900 + k, t) for k, t in enumerate([0, 0, 160 * second - 1, 160 * second, 160 * second, 170 * second - 1, 170 * second, -1])]
    df = spark.createDataFrame(rows, "key bigint, event_id bigint, ts_us bigint").withColumn("slice", F.lit("mine"))
    want = {(k, e): sum(1 for k2, _, t2 in rows if k2 == k and t - 10 * second < t2 <= t) for k, e, t in rows}
    got = telemetry.sliding_window_limit(df, 3, 10)
    assert {(r.key, r.event_id): r.n for r in got.collect()} == want and got.count() == len(rows) and set(got.columns) == {*df.columns, "n", "allowed"}
    hot = got.filter("key = 7").select(F.floor(F.col("ts_us") / (telemetry.SLICE * 10 * second))).distinct().count()
    assert hot > 10  # the groups over which the key is dealt
    df.drop("slice").write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_sliding_window(spark.readStream.schema("key bigint, event_id bigint, ts_us bigint").parquet(f"{tmp_path}/in"), 3, 10)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert {(r.key, r.event_id): (r.n, r.allowed) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {k: (n, n <= 3) for k, n in want.items()}


def test_token_bucket_batch_and_stream_agree(spark, tmp_path):
    s = 1_000_000
    times = [0] * 11 + [30 * s, 60 * s] + [60 * s + 1] * 10 + [600 * s] * 11
    rows = [(7, k, t + 5 * s) for k, t in enumerate(times)] + [(8, 100, 0)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts_us long")
    batch = {(r.key, r.event_id): r.allowed for r in telemetry.token_bucket(df).collect()}
    allowed = [batch[7, k] for k in range(len(times))]
    assert allowed[:13] == [True] * 10 + [False, False, True] and sum(allowed[12:23]) == 10 and sum(allowed[23:]) == 10
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_token_bucket(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.key, r.event_id): r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch


def test_streaming_limits_keep_their_state_between_batches(spark, tmp_path):
    s = 1_000_000
    rows = [(k % 3, k, (k // 3) * 7 * s + k) for k in range(90)]
    whole = spark.createDataFrame(rows, "key long, event_id long, ts_us long")
    want = {r.event_id: r.allowed for r in telemetry.fixed_window_limit(whole, 4, 60).collect()}
    for name, idle in (("kept", None), ("expiring", 3600)):
        for part in (rows[:40], rows[40:]):
            spark.createDataFrame(part, whole.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = jobs.stream_fixed_window(spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/{name}/in"), 4, 60, idle)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert {r.event_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect()} == want


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    from rolecorpus import scratch

    narrow = spark.range(100).withColumns({"t": F.lit("ab"), "odd name": F.lit(None).cast("string"), "a": F.array(F.lit("x")), "at": F.current_timestamp()})
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(scratch.broadcast_if_small(narrow)) and hinted(scratch.broadcast_if_small(narrow.limit(0)))
    assert not hinted(scratch.broadcast_if_small(narrow, rows=99)) and not hinted(scratch.broadcast_if_small(narrow, size=100 * 40))
    assert not hinted(scratch.broadcast_if_small(spark.range(2).select(F.repeat(F.lit("é"), 1000).alias("t")), size=4000))


def test_scratch_tables_can_be_dropped(spark):
    import os

    from rolecorpus import scratch

    table = scratch.settle(spark.range(5), "test")
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(folder)
    written = [x for x in scratch._written if not x.endswith(folder.rpartition("/")[2])]
    scratch._written[:] = [x for x in scratch._written if x not in written]
    assert scratch.drop_scratch(spark) == 1 and not os.path.isdir(folder)
    scratch._written.extend(written)


def test_scratch_scopes_remove_their_own_tables(spark):
    """Two jobs side by side and one within another: each removes what it wrote, while the others can still be read."""
    import os
    from concurrent.futures import ThreadPoolExecutor

    from rolecorpus import scratch

    before = list(scratch._written)
    with scratch.scratch_scope(spark):
        outer = scratch.settle(spark.range(3), "outer")
        with scratch.scratch_scope(spark):
            inner = scratch.settle(spark.range(5), "inner")
            assert inner.count() == 5
        with ThreadPoolExecutor(1) as pool:  # a thread is in no scope
            other = pool.submit(lambda: scratch.settle(spark.range(7), "other")).result()
        assert outer.count() == 3
        folders = [x.inputFiles()[0].rpartition("/")[0].removeprefix("file://") for x in (outer, other)]
        with pytest.raises(Exception, match="not exist|NOT_EXIST"):
            inner.count()
    assert other.count() == 7 and [os.path.isdir(f) for f in folders] == [False, True] and len(scratch._written) == len(before) + 1


def test_replay_and_identity(spark):
    log = spark.createDataFrame([(1, "a", 1, "saved", 1, False), (2, "a", 1, "saved", 2, True), (3, "a", 2, "saved", 1, False), (4, "a", 2, "odd", 1, False)], "event_id long, owner string, job_id long, kind string, ts_us long, is_delete boolean")
    state = owners.apply_actions(log)
    assert [(r.job_id, r.kind) for r in state.collect()] == [(2, "saved")]


def test_telemetry_of_an_empty_window(spark):
    e = spark.createDataFrame([], "event_id long, created_at timestamp, evt string, cache_hit boolean, rerank_failed boolean, total_ms long, parse_ms long, tokens long, search_usd double")
    now = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    assert tuple(telemetry.traffic(e, now).first()) == (0, 0, 0.0, 0.0) and tuple(telemetry.latency_percentiles(e, now).first()) == (0.0,) * 4
    assert telemetry.cost_24h(e, now).first().per_search == 0 and telemetry.hourly_volume(e, now).count() == 24


def test_robots(spark):
    robots = spark.createDataFrame([("https://a.example", "User-agent: x\nDisallow: /x\n# c\nUser-Agent: *\nDisallow: /p\nDisallow:\nDisallow: /")], "origin string, body string")
    rules = frontier.robots_rules(robots, "bot")
    f = spark.createDataFrame([("https://a.example/p/1",), ("https://a.example/x",), ("https://b.example/p",)], "url string")
    assert {r.url for r in frontier.robots_filter(f, rules).collect()} == {"https://a.example/x", "https://b.example/p"}
    assert {r.url for r in frontier.robots_filter(f, rules, honour_root=True).collect()} == {"https://b.example/p"}


def test_robots_of_a_site_with_many_rules(spark):
    rng = random.Random(3)
    paths = ["/" + "/".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    prefixes = {p[: rng.randrange(2, len(p) + 1)] for p in paths[:60] if len(p) > 1} | {f"/rule/{k}" for k in range(10_000)}
    rules = spark.createDataFrame([("https://a.example", p) for p in sorted(prefixes)] * 2, "origin string, prefix string")
    rows = [(k, f"https://A.example{p}?q=1") for k, p in enumerate(paths)] + [(k, f"https://a.example{p}") for k, p in enumerate(paths)] + [(-1, None), (-2, "https://a.example"), (-3, "https://b.example/rule/7")]
    got = frontier.robots_filter(spark.createDataFrame(rows, "id int, url string"), rules)
    assert got.columns == ["id", "url"]
    want = [(k, u) for k, u in rows if k < 0 or not any(paths[k].startswith(p) for p in prefixes)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_corpus_in_buckets_is_not_shuffled_by_a_merge(spark):
    rows = [(str(k), f"u{k}", "feed", float(k)) for k in range(500)]
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp")
    current = spark.createDataFrame(rows, "id string, url string, source string, salary_min_usd double").withColumns({"first_seen_at": seen, "last_seen_at": seen})
    batch = spark.createDataFrame([(f"u{k}", "batch", None, p) for k in [*range(480, 520), None] for p in (2, 1)], "url string, source string, salary_min_usd double, batch_pos int")
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    held = merge.save_corpus(current, "corpus_in_buckets", 8)
    try:
        merged = merge.upsert_bucketed(held, batch, as_of, 8)
        want = sorted(map(tuple, merge.upsert_postings(current, batch, as_of).collect()))
        assert sorted(map(tuple, merged.collect())) == want and len(want) == 521
        plan = merged._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final
        again = merge.save_corpus(merged, "corpus_in_buckets_next", 8)
        assert again.count() == 521
    finally:
        spark.sql("DROP TABLE IF EXISTS corpus_in_buckets")
        spark.sql("DROP TABLE IF EXISTS corpus_in_buckets_next")


def test_a_store_by_day_equals_a_flat_one(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    at = lambda text: F.lit(text).cast("timestamp")
    batch = lambda rows: spark.createDataFrame(rows, "query_hash string, raw_hash string, pos int, id string, score double, fit string")
    flat, first = None, batch([("h1", "r1", 0, "a", 1.0, "x"), ("h1", "r1", 1, "b", None, "x"), ("h2", "r2", 0, "c", 0.5, "x"), ("h3", "r3", 0, "e", 0.5, "x")])
    flat = store.store_results(store.ranked_results(first).withColumn("created_at", at("2024-01-01 00:00:00")).limit(0), first, at("2024-01-01 10:00:00"))
    daystore.store_results(spark, path, first, at("2024-01-01 10:00:00"))
    # h1 moves to another raw hash and day, h4 is new; storing it twice changes nothing
    second = batch([("h1", "r9", 0, "z", 1.0, "x"), ("h4", "r2", 0, "d", 0.1, "x")])
    flat = store.store_results(flat, second, at("2024-01-03 09:00:00"))
    for _ in range(2):
        daystore.store_results(spark, path, second, at("2024-01-03 09:00:00"))
    assert daystore.read_days(spark, path).count() == 5
    rows = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    asked = flat.select("query_hash", "raw_hash").union(spark.createDataFrame([("h9", "r1")], "query_hash string, raw_hash string"))
    for as_of, hours in (("2024-01-03 10:00:00", 24), ("2024-01-03 10:00:00", 24 * 7), ("2024-01-03 09:00:00", 47), ("2024-01-09 00:00:00", 24)):
        assert rows(daystore.lookup_by_hash(spark, path, asked, at(as_of), hours)) == rows(store.lookup_by_hash(asked, flat, at(as_of), hours))
        assert rows(daystore.lookup_by_raw(spark, path, asked, at(as_of), hours)) == rows(store.lookup_by_raw(asked, flat, at(as_of), hours))
    live = daystore.lookup_by_hash(spark, path, asked, at("2024-01-03 10:00:00"), 24)
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 19724\)", _formatted(live))
    # a purge in the middle of the first day takes what was stored before its hour: h2 and h3 are lost, h1 stands elsewhere
    daystore.write_days(batch([("h5", "r5", 0, "q", 1.0, "x")]).select("query_hash", "raw_hash").withColumns({"ids": F.array(F.lit("q")), "scores": F.create_map(F.lit("q"), F.struct(F.lit(1.0).alias("score"), F.lit("x").alias("fit"))), "created_at": at("2023-12-30 00:00:00")}), path)
    assert daystore.purge(spark, path, at("2024-01-08 11:00:00"), 7) == 3
    assert {r.query_hash for r in daystore.read_days(spark, path).collect()} == {"h1", "h4"} and daystore.purge(spark, path, at("2024-01-08 11:00:00"), 7) == 0


@pytest.mark.parametrize("cuts", [[], [1], [2, 3], [5]])
def test_state_from_snapshots_equals_the_whole_replay(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    # times don't ascend with ids: late events are older than what a snapshot holds
    rows = [(k, f"o{rng.randrange(6)}", rng.randrange(5), rng.choice(dims.INTERACTION_KINDS), rng.randrange(50), rng.random() < 0.4) for k in range(250)]
    log = spark.createDataFrame(rows, "event_id long, owner string, job_id long, kind string, ts_us long, is_delete boolean")
    at, kept = f"file://{tmp_path}/log", f"file://{tmp_path}/kept"
    snapshots.append_log(log, at, 50)
    for upto in cuts:
        snapshots.take_snapshot(spark, at, kept, owners.INTERACTION_KEY, upto, 4)
    assert snapshots.versions(spark, kept) == cuts
    want = {tuple(r) for r in owners.apply_actions(log).collect()}
    got = snapshots.state(spark, at, kept, owners.INTERACTION_KEY, buckets=4)
    assert {tuple(r) for r in got.collect()} == want
    some = snapshots.state(spark, at, kept, owners.INTERACTION_KEY, owners=["o1", "o4", "none"], buckets=4)
    assert {tuple(r) for r in some.collect()} == {r for r in want if r[0] in ("o1", "o4")}
    if cuts:  # of the log the tail alone is read, of the snapshot the asked owners' buckets
        plan = _formatted(some)
        assert re.search(rf"PartitionFilters: \[.*segment#\d+ >= {max(cuts)}\)", plan) and re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan)


def test_jsonld_and_two_passes(spark):
    block = '<script type="application/ld+json">{}</script>'
    job = '{"@type": "JobPosting", "title": " Dev ", "jobLocation": [{"address": {"addressLocality": "Pune", "addressCountry": "IN"}}], "baseSalary": {"currency": "USD", "value": {"minValue": 10, "maxValue": 20}}, "jobLocationType": "TELECOMMUTE", "datePosted": "soon"}'
    pages = spark.createDataFrame([("https://s.example/1", block.format("{bad") + block.format(f"[{job}, 5]"), "S"), ("https://s.example/2", '<a href="/jobs/abc1">x</a> <a href="https://o.example/jobs/abc1">y</a>', "S")], "url string, html string, company string")
    more = spark.createDataFrame([("https://s.example/jobs/abc1", block.format(job.replace(" Dev ", "Linked")))], "url string, html string")
    got = {r.title: r for r in frontier.two_pass_extract(pages, more).collect()}
    assert set(got) == {"Dev", "Linked"} and got["Dev"].location_raw == "Pune, IN" and got["Dev"].is_remote and got["Dev"].published_at is None and got["Dev"].salary_raw == "$10 - $20"


def test_verify_tenants(spark):
    body = '{"jobs": [{"title": "A", "location": {"name": "Pune"}, "company_name": ""}, {"location": {"name": "Oslo"}, "company_name": "Co"}]}'
    rows = [("greenhouse", "ok", 200, body), ("greenhouse", "Demo", 200, body), ("lever", "gone", 404, None), ("lever", "slow", 429, None), ("ashby", "down", 500, None), ("lever", "odd", 200, "{broken")]
    got = {r.slug: r for r in tenants.verify_tenants(spark.createDataFrame(rows, "ats string, slug string, code int, body string"), dims.denylist(spark)).collect()}
    assert [got[k].status for k in ("ok", "Demo", "gone", "slow", "down", "odd")] == ["verified", "dead", "dead", "rate_limited", "candidate", "candidate"]
    assert got["ok"].flagged and got["ok"].sample_titles == ["A", "Untitled"] and got["ok"].company_name == "Co" and got["ok"].job_count == 2


def test_a_verdict_for_a_tenant_of_many_pages(spark):
    import json

    page = lambda lo, hi, at=None: json.dumps([{"text": f"t{k}", "categories": {"location": "Pune" if k == at else "Oslo"}} for k in range(lo, hi)])
    rows = [("in", 0, 200, page(0, 3)), ("in", 1, 200, "[]"), ("in", 2, 200, page(3, 60, 49)), ("in", 3, 200, page(60, 70, 61))]  # the fiftieth job
    rows += [("late", 0, 200, page(0, 3)), ("late", 1, 200, page(3, 60, 50))]  # the fifty-first
    rows += [("mixed", 0, 500, None), ("mixed", 1, 200, page(7, 9)), ("mixed", 2, 429, None)]
    rows += [("wait", 0, 404, None), ("wait", 1, 429, None), ("wait", 2, 500, None), ("gone", 0, 404, None), ("gone", 1, 404, None), ("odd", 0, 404, None), ("odd", 1, 200, "{broken")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([("lever", *r) for r in rows], "ats string, slug string, page int, code int, body string")
    got = {r.slug: r for r in tenants.verify_tenants(df, dims.denylist(spark)).collect()}
    assert len(got) == 6 and {k: r.status for k, r in got.items()} == {"in": "verified", "late": "verified", "mixed": "verified", "wait": "rate_limited", "gone": "dead", "odd": "candidate"}
    assert (got["in"].job_count, got["in"].sample_titles, got["in"].flagged) == (70, ["t0", "t1", "t2", "t3", "t4"], True)
    assert (got["late"].job_count, got["late"].flagged) == (60, False) and got["mixed"].sample_titles == ["t7", "t8"]
    assert got["wait"].sample_titles == [] and got["wait"].job_count == 0
    one = spark.createDataFrame([("greenhouse", "co", k, 200, json.dumps({"jobs": [{"title": f"j{k}", "company_name": n}] if n is not None else []})) for k, n in enumerate([None, "", "Second", "Third"])], df.schema)
    assert [(r.company_name, r.sample_titles) for r in tenants.verify_tenants(one, dims.denylist(spark)).collect()] == [("Second", ["j1", "j2", "j3"])]


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_places_of_a_list_do_not_depend_on_its_pages(spark, size):
    import json

    posts = {"a": 20, "b": 3, "c": 0}
    lists = [(slug, at // size, json.dumps({"content": [{"id": str(k), "name": f"{slug}{k}", "ref": f"{slug}/{k}"} for k in range(at, min(n, at + size))]})) for slug, n in posts.items() for at in range(0, max(n, 1), size)]
    random.Random(size).shuffle(lists)
    df = spark.createDataFrame(lists, "slug string, page int, body string")
    details = spark.createDataFrame([(f"{s}/{k}", "{}") for s, n in posts.items() for k in range(n) if k != 2], "ref string, body string")
    first = {r.title for r in feeds.read_smartrecruiters(df, details, 5).collect()}
    assert first == {"a0", "a1", "a3", "a4", "b0", "b1"}
    assert feeds.read_smartrecruiters(df, details).count() == 19 + 2
    starts = {(r.slug, r.page): r.start for r in feeds.page_starts(df.select("slug", "page", F.size(F.from_json("body", "content array<struct<id string>>")["content"]).alias("n")), ["slug"]).collect()}
    assert starts == {(slug, at // size): at for slug, n in posts.items() for at in range(0, max(n, 1), size)}


def test_a_board_is_named_by_its_first_posting_on_any_page(spark):
    job = lambda title, name: f'{{"title": "{title}", "absolute_url": "https://x.example/{title}", "company_name": {name}}}'
    rows = [("s", 2, f'{{"jobs": [{job("c", chr(34) + "Late" + chr(34))}]}}'), ("s", 0, '{"jobs": []}'), ("s", 1, f'{{"jobs": [{job("a", chr(34) + " Board " + chr(34))}, {job("b", "null")}]}}'), ("t", 0, f'{{"jobs": [{job("d", "null")}]}}'), ("t", 1, f'{{"jobs": [{job("e", chr(34) + "Other" + chr(34))}]}}')]
    got = {r.title: r.company for r in feeds.read_greenhouse(spark.createDataFrame(rows, "slug string, page int, body string")).collect()}
    assert got == {"a": "Board", "b": "Board", "c": "Board", "d": "t", "e": "t"}


def test_stream_feeds_is_idempotent_and_incremental(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    now = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    body = '{{"jobs": [{{"title": "{}", "absolute_url": "https://x.example/{}"}}]}}'
    (folder / "acme.json").write_text(body.format("One", 1))
    run = lambda: jobs.stream_feeds(spark, f"file://{folder}", feeds.read_greenhouse, f"file://{tmp_path}/state", f"file://{tmp_path}/log", now)
    run()
    (folder / "brix.json").write_text(body.format("Two", 2))
    run()
    run()
    state = f"file://{tmp_path}/state"
    assert {(r.title, r.company) for r in jobs.feed_state(spark, state).collect()} == {("One", "acme"), ("Two", "brix")}
    for k in range(3):  # a bucket that is rewritten keeps its newest two versions; the others aren't touched
        (folder / f"acme{k}.json").write_text(body.format(f"New {k}", 1))
        run()
    assert {r.title for r in jobs.feed_state(spark, state).collect()} == {"New 2", "Two"}
    versions = {(r.bucket, r.version) for r in spark.read.parquet(state).select("bucket", "version").distinct().collect()}
    assert len(versions) == 3 and {v for _, v in versions} == {1, 3, 4}


def test_score_cases_of_a_query_without_results(spark):
    rows = [("none", "q", None), ("empty", "q", ((2, 0.5, ["x"]), None, None, 0.5, True))]
    golden = spark.createDataFrame(rows, evals.GOLDEN_TYPE)
    ranked = spark.createDataFrame([], "name string, place int, score double, title string, url string")
    got = {r.name: r for r in evals.score_cases(golden, ranked).collect()}
    assert got["none"].score == 1.0 and got["none"].passed and got["empty"].failures == ["topNMustMatch", "topResultMinScore"]
