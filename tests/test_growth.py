"""Work that must follow the input: intermediate rows are counted, not timed."""

import json

import pytest
from pyspark.sql import functions as F

from hirelens import session
from hirelens.operators import enrich, filters, quantiles, subscriptions
from hirelens.plans import io_queries, pipeline, subscription_queries
from hirelens.streaming import ingest

POSTS = "id int, city string, region string, core_role string, employer_name string, junior int, senior int, expiration date, date_posted date, job_title string, url string"


def posts(spark, n):
    rows = spark.range(n).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("Town"), (F.col("id") % 7).cast("string")).alias("city"), F.lit("North").alias("region"),
        F.lit("Dev").alias("core_role"), F.format_string("Firm%05d", F.col("id")).alias("employer_name"), (F.col("id") % 2).cast("int").alias("junior"),
        F.lit(0).alias("senior"), F.lit("2024-02-01").cast("date").alias("expiration"), F.lit("2024-01-09").cast("date").alias("date_posted"),
        F.concat(F.lit("t"), F.col("id")).alias("job_title"), F.concat(F.lit("u"), F.col("id")).alias("url"))
    return spark.createDataFrame(rows.collect(), POSTS)


def parsed(spark, docs):
    return subscriptions.parse_filters(spark.createDataFrame([(c, json.dumps(d)) for c, d in docs], "chat_id int, filters string"))


def test_equal_filters_are_matched_once(spark):
    window = posts(spark, 60)
    docs = [{"company": "Firm0001"}, {"city": "town3", "experience_level": "Junior"}, {}]
    subs = parsed(spark, [(i, docs[i % 3] | {"email": f"{i}@x.y", "region": ""}) for i in range(300)])
    classed = subscriptions._classed(subs)
    assert classed.select("_class").distinct().count() == 3 and classed.count() == 300
    assert subscriptions._class_pairs(window, classed, "2024-01-10", 7).count() == 10 + 5 + 60
    # short lists and many deals lose and repeat nothing
    got = subscriptions.match_pairs(window, subs, "2024-01-10", share=7, listed=9, dealt=50).collect()
    each = {i: {r.id for r in filters.apply_filters(window, d, "2024-01-10").select("id").collect()} for i, d in enumerate(docs)}
    want = sorted((c, i) for c in range(300) for i in each[c % 3])
    assert sorted((r.chat_id, r.id) for r in got) == want


def test_a_subscriber_with_several_filters_meets_a_posting_once(spark):
    window = posts(spark, 30)
    subs = parsed(spark, [(1, {"city": "town1"}), (1, {"company": "Firm0000"}), (1, {"city": "town1"}), (2, {"city": "town1"}), (3, {"company": "none"})])
    got = sorted((r.chat_id, r.id) for r in subscriptions.match_pairs(window, subs, "2024-01-10", share=3).collect())
    town = [i for i in range(30) if i % 7 == 1]
    assert got == sorted([(1, i) for i in {*range(10), *town}] + [(2, i) for i in town])
    digest = {(r.chat_id, r.n, r.message.count("📌")) for r in subscriptions.digest_window(window, subs, "2024-01-10", 5, 8).collect()}
    assert digest == {(1, len({*range(10), *town}), 0), (2, len(town), len(town)), (3, 0, 0)}


def test_a_value_is_looked_up_once_for_all_that_ask(spark):
    window = posts(spark, 40)
    subs = parsed(spark, [(i, {"company": "Firm0000"}) for i in range(50)])
    hits = subscriptions._hits(subscriptions._asked(subs, window.columns), subscriptions.key_counts(window))
    assert hits.filter("_tag = 'emp'").count() == 10  # one row a key, not one for each of 50 subscriptions


def test_numbered_names_are_not_compared_in_crowds(spark):
    """Names of few characters share short grams by the hundred; a gram of half the
    name is carried by those that nearly agree."""
    names = [f"Customer#{i:09d}" for i in range(2000)]
    more = ["stomer#000000123", "Customer#0000019", "tom", "x", "Customer#000000007 ltd"]
    df = spark.createDataFrame([(n,) for n in names + more], "name string")
    got = {(r.name, r._to) for r in enrich.containment_map(df, "name").collect()}
    every = names + more
    want = {(a, min((b for b in every if a in b and a != b), key=lambda b: (-len(b), b))) for a in every if any(a in b and a != b for b in every)}
    assert got == want
    own = spark.createDataFrame([(n,) for n in names], "_a string")
    grams = enrich._name_grams(own, own.select(F.col("_a").alias("_b")), 3)
    assert grams[0].join(grams[1], "_g").count() <= 3 * len(names)


def test_ranges_are_found_by_halving(spark):
    cuts = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(cuts[:k], v) for k in range(6) for v in (0.0, 1.0, 1.5, 2.0, 2.5, 5.0, 9.0, 9.5)], "_cuts array<double>, _v double")
    for ranges in (6, 7, 9, 64):
        placed = quantiles._placed(df, ranges)
        assert all(r._p == sum(c < r._v for c in r._cuts) for r in placed.collect())
    assert "aggregate(" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_ingest_queries_read_the_view_once(spark, monkeypatch):
    from conftest import SF001
    from hirelens.plans import io_queries
    read = []
    monkeypatch.setattr(io_queries.ingest, "run_ingest", lambda *a: None)
    monkeypatch.setattr(io_queries.ingest, "process_batch", lambda s, batch, n, paths, *a: (read.append(batch), batch.write.parquet(paths["curated"])))
    monkeypatch.setattr(io_queries, "_plain", lambda df: df)
    monkeypatch.setattr(io_queries, "JOBS_COLUMNS", ["id"])
    io_queries.q_incremental_ingest(spark, SF001)
    monkeypatch.setattr(io_queries.sinks, "dual_sink", lambda df, staging, history, batch_id, **k: (
        read.append(df), df.write.mode("overwrite").parquet(staging), df.write.mode("overwrite").parquet(f"{history}/batch_id={batch_id}")))
    io_queries.q_dual_sink(spark, SF001)
    assert len(read) == 4 and not any("lineitem" in f for df in read for f in df.inputFiles())


def test_bigrams_are_taken_once_and_dealt_by_the_text(spark, monkeypatch):
    from hirelens.operators import textmine
    rows = [(1, "alpha beta gamma alpha beta"), (1, "alpha beta"), (None, "beta gamma"), (None, "gamma delta beta gamma"), (2, ""), (3, None), (4, "delta")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = textmine.bigram_tfidf(df, "id", "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    few = {r.bigram: round(r.score, 9) for r in out.collect()}
    monkeypatch.setattr(textmine, "DEAL_CHARS", 1)
    assert {r.bigram: round(r.score, 9) for r in textmine.bigram_tfidf(df, "id", "text").collect()} == few
    assert set(few) == {"alpha beta", "beta gamma", "gamma alpha", "gamma delta", "delta beta", "beta beta"} - {"beta beta"}
    assert textmine.text_deals(10_000_000_000, 8) == 10_000_000_000 and textmine.text_deals(None, 8) == 8


def test_tokens_and_symbols_on_odd_texts(spark):
    import re
    from hirelens.functions.text import remove_symbols, stop_words, tokens
    texts = ["", " ", "  Having been  there\twith data ", "abc abcd ABCDE", "don't about\nabout about", "żółw łódź ١٢٣ a😀b 😀😀😀 😀😀😀😀", "their", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens("t").alias("k"), remove_symbols("t").alias("s")).collect()
    stops = {w for w in stop_words() if len(w) >= 4 and w.isalnum()}
    assert [r.k for r in got] == [None if t is None else [w for w in t.lower().split(" ") if len(w) >= 4 and w not in stops] for t in texts]
    assert [r.s for r in got] == [None if t is None else re.sub("[^a-zA-Z0-9]+", " ", t) for t in texts]


def test_repeated_tags_of_a_page_are_read_once(monkeypatch):
    from html import escape

    from hirelens.sources import extract
    made = []
    monkeypatch.setattr(extract._Collector, "feed", lambda self, html: made.append(html))
    extract._MET.clear()
    row = "<li data-field='until'><div class=\"big value\">do &amp; {}</div><br/></li>\n"
    page = "<ul>" + "".join(row.format(escape(str(i))) for i in range(200)) + "</ul>"
    name, texts = extract.gather("https://labelled.jobs.example/1", page)
    assert not made and texts["expiration"] == [f"do & {i}" for i in range(200)]
    kept = extract._profile(name)
    assert len(kept.tags) == 7 and len(kept.steps) <= 4
    # what cannot be read tag by tag goes to the parser whole
    for odd in ("<p>a < b</p>", "<!-- x --><p>y</p>", "<title>a</title>", "<script>x</script>", "<p class=\"a", "text <"):
        extract.gather("https://labelled.jobs.example/1", odd)
    assert len(made) == 6
    for i in range(extract._KEPT + 10):
        kept.tag(f"<a href='{i}'>")
    assert len(kept.tags) <= extract._KEPT
    extract._MET.clear()


def test_page_reader_needs_no_package_on_workers(tmp_path):
    import os
    import subprocess
    import sys

    import hirelens
    from hirelens.sources import extract
    from pyspark import cloudpickle
    (tmp_path / "f").write_bytes(cloudpickle.dumps(extract.gather))
    code = "import pickle; f = pickle.load(open('f', 'rb')); print(f('https://ordered.x/1', '<p class=fact>a</p>')[1]['facts'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(os.path.dirname(cloudpickle.__file__))}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip() == "['a']", (hirelens.__file__, out.stderr[-500:])


# --------------------------------------------------------- plans of kept frames
DOCS = [(1, {"city": "town1"}), (2, {"city": "town1"}), (3, {"company": "Firm0000", "expiration_date": "current"}), (4, {"experience_level": "🌱 Junior"}),
        (5, {"company": "nobody"}), (6, {"notification_time": "10:10"}), (7, {"city": "Town2;Town3", "notification_time": "10:10"})]


def kept(spark, folder):
    def keep(df):
        path = f"{folder}/{len(list(folder.iterdir()))}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return keep


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_digest_of_kept_frames_has_a_small_plan(spark, tmp_path):
    window, subs = posts(spark, 60), parsed(spark, DOCS)
    lazy, small = (subscriptions.digest_window(window, subs, "2024-01-10", 5, 12, **k) for k in ({}, {"keep": kept(spark, tmp_path)}))
    assert plan_size(small) < 15_000 < plan_size(lazy)
    want = sorted(lazy.collect())
    assert sorted(small.collect()) == want and len(want) == 7


def test_due_digest_of_kept_frames_has_a_small_plan(spark, tmp_path):
    window = posts(spark, 60)
    raw = parsed(spark, DOCS).select("chat_id", F.col("filters").alias("filters_for_notification"))
    lazy, small = (ingest.due_matches(window, raw, "10:10", "2024-01-10", 5, **k) for k in ({}, {"keep": kept(spark, tmp_path)}))
    assert plan_size(small) < 15_000 < plan_size(lazy)
    assert sorted((r.chat_id, r.n) for r in small.collect()) == [(6, 60), (7, 18)]


def test_pairs_of_kept_frames_have_a_small_plan(spark, tmp_path):
    window, subs = posts(spark, 60), parsed(spark, DOCS)
    lazy, small = (subscriptions.match_pairs(window, subs, "2024-01-10", **k) for k in ({}, {"keep": kept(spark, tmp_path)}))
    assert plan_size(small) < 15_000 < plan_size(lazy)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, lazy.collect()))


def test_saved_search_matches_plans_begin_at_stored_rows(spark, monkeypatch):
    raw = parsed(spark, DOCS).select("chat_id", "filters")
    monkeypatch.setattr(subscription_queries.dims, "subscriptions", lambda s, d: raw)
    monkeypatch.setattr(subscription_queries, "window_view", lambda s, d: posts(spark, 60))
    out = subscription_queries.q_saved_search_matches(spark, "")
    assert plan_size(out) < 15_000
    got = {}
    for r in out.collect():
        got.setdefault(r.chat_id, set()).add(r.id)
    # The firms' postings expire in 2024: all are open on the queries' day.
    assert {c: len(ids) for c, ids in got.items()} == {1: 9, 2: 9, 3: 10, 4: 30, 6: 60, 7: 18}


# ------------------------------------------------------------- the batch chain
def own_postings(spark):
    """Postings in two parts, so that a plan that is not cut shows both."""
    part = spark.range(12).select(
        F.col("id"), F.concat(F.lit("large ring "), (F.col("id") % 3).cast("string")).alias("job_title"), F.lit("LARGE").alias("core_role"),
        F.lit("Customer#000000001").alias("employer_name"), F.lit("NATION_1").alias("city"), F.lit("NATION_1").alias("location_raw"),
        F.lit("do 01.09.1998").alias("expiration_raw"), F.lit("100 – 200 zł brutto").alias("salary_raw"), F.lit("SQL").alias("technologies_used"),
        F.lit("u").alias("url"), F.lit("1998-08-01").cast("date").alias("date_posted"), F.lit("x").alias("upload_id"))
    return part.unionByName(part.withColumn("id", F.col("id") + 12))


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


@pytest.mark.parametrize("query", ["curated_append", "report_columns", "curated_batch"])
def test_the_batch_chain_begins_at_stored_rows(spark, monkeypatch, query):
    class Seen(Exception):
        pass

    def chain(raw, *_):
        assert leaves(raw) == 1
        raise Seen

    monkeypatch.setattr(io_queries, "postings", lambda s, d: own_postings(spark))
    monkeypatch.setattr(io_queries.pipeline, "run_batch", chain)
    for dim in ("gazetteer", "titles"):
        monkeypatch.setattr(io_queries.dims, dim, lambda s, d: None)
    with pytest.raises(Seen):
        getattr(io_queries, f"q_{query}")(spark, "")


def test_materialized_rows_are_columnar_files(spark):
    kept_rows = session.materialize(own_postings(spark).groupBy("job_title").agg(F.count(F.lit(1)).alias("n")))
    assert kept_rows.inputFiles() and all(f.endswith(".parquet") for f in kept_rows.inputFiles())
    assert {(r.job_title, r.n) for r in kept_rows.collect()} == {(f"large ring {i}", 8) for i in range(3)}


def test_wide_rows_of_the_batch_are_shuffled_once(spark):
    raw = pipeline.raw_from_postings(own_postings(spark)).withColumn("id", F.col("id").cast("string"))
    rows = raw.withColumns({"city": F.lit("c"), "region": F.lit("r"), "lat": F.lit("1"), "long": F.lit("2"), "work_type": F.lit("Remote")})
    # Rows without a title or an employer, and one key twice, all stay.
    rows = rows.withColumn("job_title", F.when(F.col("id") != "3", F.col("job_title"))).withColumn("employer_name", F.when(F.col("id") != "4", F.col("employer_name")))
    rows = rows.withColumn("id", F.when(F.col("id") == "6", "5").otherwise(F.col("id")))
    titles = spark.createDataFrame([(0, "large ring large")], "idx int, title string")
    vocabulary = spark.createDataFrame([("SQL",), ("LARGE",)], "tech string")
    out = pipeline.enrich_postings(rows, titles, vocabulary, "1998-08-02", materialize=False)
    got = out.select("id", "job_title", "employer_name", "core_role", "technologies_used").collect()
    assert len(got) == 24 and sum(r.id == "5" for r in got) == 2 and sum(r.employer_name is None for r in got) == 1
    assert all("SQL" in r.technologies_used for r in got) and all((r.core_role is None) == (r.job_title is None) for r in got)
    wide = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x and "<=>" in x]
    assert len(wide) == 1


def test_a_batch_that_runs_again_enriches_nothing(spark, tmp_path, monkeypatch):
    raw = pipeline.raw_from_postings(own_postings(spark))
    gazetteer = spark.createDataFrame([("NATION_1", "Nation-1", "ASIA", "ASIA", 1.5, -1.5, 1)], "city string, city_ascii string, admin_name string, "
                                      "admin_name_english string, lat double, lng double, gaz_order long")
    titles = spark.createDataFrame([(0, "large ring large")], "idx int, title string")
    paths = {k: f"{tmp_path}/{k}" for k in ("staging", "history", "curated")}
    enriched, real = [], pipeline.enrich_postings
    monkeypatch.setattr(pipeline, "enrich_postings", lambda rows, *a: (enriched.append(rows), real(rows, *a))[1])
    rows = []
    for _ in range(2):
        ingest.process_batch(spark, raw, 0, paths, gazetteer, titles, "1998-08-02")
        rows.append(sorted(r.id for r in spark.read.parquet(paths["curated"]).collect()))
    assert len(enriched) == 1 and rows[0] == rows[1] and rows[0]
