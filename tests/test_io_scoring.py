import pytest
from pyspark.sql import functions as F

from tierlens import constants as k
from tierlens.operators import scoring, spans
from tierlens.plans.scoring import fragile_predictor, keyword_predictor
from tierlens.sources import io
from tierlens.streaming import resumable


def test_reviews_csv_round_trip(spark, tmp_path):
    text = 'He said ""great"", then\nleft, é'
    body = ",".join(k.RAW_COLS) + ",extra\n" + ",".join(["p1", '"a, b"', "A|B", "₹1", '"₹1,099"', "64%", "|", "", "t", f'"{text}"', "x"]) + "\n"
    (tmp_path / "in.csv").write_text(body, encoding="utf-8")
    got = io.read_reviews_csv(spark, str(tmp_path / "in.csv")).first()
    assert got.review_content == 'He said "great", then\nleft, é' and got.actual_price == "₹1,099" and got.rating_count is None
    df = io.read_reviews_csv(spark, str(tmp_path / "in.csv")).drop("row_ord")
    io.write_csv(df, str(tmp_path / "out"))
    again = io.read_reviews_csv(spark, str(tmp_path / "out")).drop("row_ord")
    assert again.collect() == df.collect()


def test_labels_csv_fills_missing_columns(spark, tmp_path):
    (tmp_path / "l.csv").write_text("text,span,polarity,ordinal\nt,s,negative,1.0\nu,s,neutral,\n")
    got = io.read_labels_csv(spark, str(tmp_path / "l.csv")).orderBy("label_id").collect()
    assert [(r.ordinal, r.polarity_predicted) for r in got] == [(1, None), (None, None)]


def test_parquet_sources(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert io.read_parquet(spark, path) is None and not io.path_exists(spark, path)
    io.write_results(spark.range(3).withColumn("m", F.lit("x")), spark.range(2), path, path + "2", ["m"])
    assert io.path_exists(spark, path)
    assert scoring.model_source(spark, path, "default") == path
    assert scoring.model_source(spark, path + "no", "default") == "default"
    monkeypatch.setenv("SOME_TABLE", path)
    assert io.read_parquet(spark, "nowhere", "SOME_TABLE").count() == 3
    plan = io.read_parquet(spark, path).where("m = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(m" in plan


def persisted(spark) -> int:
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_table_cache(spark, tmp_path):
    now, path, other = [0.0], str(tmp_path / "t"), str(tmp_path / "u")
    began = persisted(spark)
    with io.TableCache(spark, 10, clock=lambda: now[0]) as cache:
        assert cache.load(path) is None
        io.write_parquet(spark.range(3), path)
        first = cache.load(path)
        assert first.count() == 3 and cache.load(path) is first
        io.write_parquet(spark.range(5).withColumn("part", F.col("id") % 2), path, ["part"])
        second = cache.load(path)  # other files: the old entry is released
        assert second.count() == 5 and cache.load(path) is second and persisted(spark) == began + 1
        now[0] = 11.0
        assert cache.load(path) is not second
        cache.refresh(path)
        assert persisted(spark) == began
        io.write_parquet(spark.range(2), other)
        cache.load(path).count(), cache.load(other).count()
        assert persisted(spark) == began + 2
    assert persisted(spark) == began


def test_table_cache_is_bounded(spark, tmp_path):
    paths = [str(tmp_path / x) for x in "abc"]
    for p in paths:
        io.write_parquet(spark.range(1000), p)
    size = io.listing(spark, paths[0])[1]
    began = persisted(spark)
    with io.TableCache(spark, most_bytes=2 * size + 10) as cache:
        a, b = cache.load(paths[0]), cache.load(paths[1])
        assert a.count() == b.count() == 1000 and cache.load(paths[0]) is a
        assert cache.load(paths[2]).count() == 1000 and persisted(spark) == began + 2
        assert cache.load(paths[0]) is a and cache.load(paths[1]) is not b  # the one not used for longest went
    with io.TableCache(spark, most_bytes=5) as cache:
        assert cache.load(paths[0]).count() == 1000 and persisted(spark) == began


def scanned(df) -> int:
    """Rows that the scan of an executed query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return plan.collectLeaves().apply(0).metrics().get("numOutputRows").get().value()


def test_lookup_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    rows = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("product_id"), F.rand(1).alias("x"))
    io.write_lookup(rows, path, "product_id", group_bytes=1 << 17)
    files = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("*.parquet")]
    groups = sum(f.num_row_groups for f in files)
    assert groups > 8
    one = rows.where("id = 0" if "id" in rows.columns else "true").first()["product_id"]
    found = spark.read.parquet(path).where(F.col("product_id") == one)
    assert found.count() == 1
    assert scanned(spark.read.parquet(path).where(F.col("product_id") == one)) < 60_000 / 4
    assert scanned(spark.read.parquet(path).where(F.col("product_id") == "no such")) < 60_000 / 4
    # Inside a range that holds it, a missing key is ruled out by the bloom filter.
    missing = one[:-1] + ("0" if one[-1] != "0" else "1")
    assert scanned(spark.read.parquet(path).where(F.col("product_id") == missing)) == 0


def test_source_order_over_files(spark, tmp_path):
    """Files in order by name, though Spark packs the large one first."""
    text = lambda lines: "text,span,polarity,ordinal\n" + "".join(f"{x},s,p,1\n" for x in lines)
    names = {"a": range(2), "b": range(100, 150), "c": range(200, 203)}
    for name, ids in names.items():
        (tmp_path / f"{name}.csv").write_text(text(ids))
    got = io.read_labels_csv(spark, str(tmp_path)).orderBy("label_id").collect()
    assert [r.label_id for r in got] == list(range(55))
    assert [int(r.text) for r in got] == [x for ids in names.values() for x in ids]


def test_text_is_split_by_setting_only(spark):
    one = spark.range(10, numPartitions=1)
    assert io.split_text(one, "id") is one
    spark.conf.set(io.TEXT_PARTS, "3")
    try:
        assert io.split_text(one, "id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(io.TEXT_PARTS)


def test_stages_are_removed(spark):
    with io.stages(spark):
        df = io.written(spark.range(3))
        path = df.inputFiles()[0]
        assert df.count() == 3 and io.path_exists(spark, path)
    assert not io.path_exists(spark, path)


SENTENCES = [(1, "it was with the rewh"), (2, "this is for that"), (3, None), (4, "plain"), (5, "from by")]


def test_scoring_keeps_alignment_and_isolates_faults(spark):
    df = spark.createDataFrame(SENTENCES, "id int, sentence string").repartition(2)
    fine = {r.id: [s.span for s in r.predictions] for r in scoring.score_spans(df, keyword_predictor, "k", batch=2).collect()}
    assert fine == {1: ["with", "was", "it"], 2: ["this", "for", "is"], 3: [], 4: [], 5: ["from", "by"]}
    safe = scoring.score_spans_safe(df, fragile_predictor, "f", batch=10)
    got = {r.id: ([s.span for s in r.predictions], r.error) for r in safe.collect()}
    assert got == {i: ([], "ValueError: cannot parse") if i == 1 else (v, None) for i, v in fine.items()}
    assert [r.id for r in scoring.quarantine(safe).collect()] == [1]
    assert scoring.score_spans(df.where("false"), keyword_predictor, "k").count() == 0


def test_a_new_model_replaces_the_old_one_of_its_name(spark):
    df = spark.createDataFrame(SENTENCES, "id int, sentence string").coalesce(1)

    def factory(word):
        return lambda: lambda part: [[{"span": word, "polarity": "neutral"}] for _ in part]

    for word in ("old", "new", "old"):
        for score in (scoring.score_spans, scoring.score_spans_safe):
            assert {r.predictions[0].span for r in score(df, factory(word), "one name").collect()} == {word}


def test_predictor_is_called_once_per_row(spark):
    plan = scoring.score_spans_safe(spark.createDataFrame(SENTENCES, "id int, sentence string"), keyword_predictor, "k")
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    attached = spans.attach_predictions(scoring.score_spans(spark.createDataFrame(SENTENCES, "id int, sentence string"), keyword_predictor, "k"))
    assert attached._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_head_trains_saves_and_scores(spark, tmp_path):
    data = [(i, f"the tea is {'good' if i % 2 else 'bad'} today", "tea", "positive" if i % 2 else "negative", 0) for i in range(60)]
    gold = spark.createDataFrame(data, "id int, text string, span string, polarity string, ordinal int")
    model = scoring.train_text_head(scoring.with_context(gold), "polarity")
    scoring.save_head(model, str(tmp_path / "head"))
    extra = spark.createDataFrame([(99, "no such place", "zz", "positive", 0)], gold.schema)
    scored = scoring.score_gold(scoring.load_head(str(tmp_path / "head")), gold.unionByName(extra))
    got = {r.id: (r.polarity, r.polarity_finetuned) for r in scored.collect()}
    assert got.pop(99) == ("positive", None) and all(a == b for a, b in got.values())


def test_counts_name_predictions_of_both_splits(spark):
    from tierlens.plans import scoring as plans

    for counts in (plans.train_head_counts, plans.score_gold_counts):
        counts = counts(spark, "/root/testdata/sf0.001")
        rows = counts.collect()
        assert counts.columns == ["held_out", "label", "predicted", "n"] and {r.held_out for r in rows} == {False, True}
        for r in plans.against_majority(counts).collect():
            mine = [x for x in rows if x.held_out == r.held_out and x.predicted is not None]
            per = {x.label: sum(y.n for y in mine if y.label == x.label) for x in mine}
            right = sum(x.n for x in mine if x.label == x.predicted)
            assert (r.n, r.right, r.majority) == (sum(per.values()), right, max(per.values()))
            assert r.beats_majority == (right > max(per.values()))
            print(counts is not None, r)


def test_stored_head_is_loaded(spark, monkeypatch):
    from tierlens.plans import scoring as plans

    sf, loaded = "/root/testdata/sf0.001", plans.load_words
    monkeypatch.setattr(plans, "load_words", lambda *a: {w: -v for w, v in loaded(*a).items()})
    turned = {r.polarity for r in plans.tuned_or_default_scoring(spark, sf).where("polarity <> 'neutral'").collect()}
    counts = lambda df: {r.polarity: r["count"] for r in df.groupBy("polarity").count().collect()}
    got = counts(plans.tuned_or_default_scoring(spark, sf))
    monkeypatch.undo()
    want = counts(plans.tuned_or_default_scoring(spark, sf))
    assert turned and got.get("positive") == want.get("negative") and got.get("negative") == want.get("positive")


def test_stream_resumes_and_picks_up_new_files(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    calls = []

    def transform(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df.withColumn("twice", F.col("id") * 2)

    for i in range(2):
        spark.range(i * 50, i * 50 + 50, numPartitions=1).write.parquet(f"{source}/f{i}")
    schema, run = spark.range(1).schema, lambda: resumable.score_available(
        spark, f"{source}/*", schema, transform, folder, files_per_batch=1
    )
    with pytest.raises(Exception, match="lost"):
        run()
    assert resumable.read_scored(spark, folder).count() == 50
    assert run().count() == 100
    before = len(calls)
    assert run().count() == 100 and len(calls) == before
    spark.range(100, 150, numPartitions=1).write.parquet(f"{source}/f2")
    out = run()
    assert out.count() == 150 == out.select("id").distinct().count()


def test_batch_resume_and_fingerprints(spark, tmp_path):
    folder = str(tmp_path / "run")
    score = lambda d: d.withColumn("x", F.col("id") + 1)
    score(spark.range(30)).write.parquet(f"{folder}/out")
    got = resumable.score_remaining(spark.range(100), score, folder, "id")
    assert got.count() == 100 == got.select("id").distinct().count()
    seen = []

    def fails(d):
        seen.append(d.count())
        if len(seen) == 3:
            raise RuntimeError("lost")
        return score(d)

    with pytest.raises(RuntimeError, match="lost"):
        resumable.score_remaining(spark.range(300), fails, folder, "id", parts=4)
    assert resumable.read_scored(spark, folder).count() == 100 + sum(seen[:2])  # finished parts are kept
    assert resumable.score_remaining(spark.range(300), score, folder, "id").select("id").distinct().count() == 300
    a, b = spark.range(100), spark.range(100).withColumn("id", F.col("id") + 1)
    assert resumable.content_fingerprint(a) == resumable.content_fingerprint(a.repartition(7))
    assert resumable.content_fingerprint(a) != resumable.content_fingerprint(b)
    assert resumable.run_folder("r", v=1) != resumable.run_folder("r", v=2)


def test_lexicon_table(spark):
    docs = spark.createDataFrame([(1, "good good bad"), (2, "nothing"), (3, "")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "token string, valence double")
    got = {r.doc_id: r.compound for r in spans.lexicon_table_scores(docs, lexicon).collect()}
    assert got == pytest.approx({1: 3 / (9 + 15) ** 0.5, 2: 0.0, 3: 0.0})


def test_ordered_parts_grow_with_the_text(spark):
    rows = [(i if i % 50 else None, "é" * (i % 9) if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "at int, t string").repartition(3)
    size = sum(len((t or "").encode()) for _, t in rows)
    assert io.ordered_parts(df, "at", 4).rdd.getNumPartitions() == 4
    for part_bytes in (size // 8 + 1, size // 16 + 1):
        found = io.ordered_parts(df, "at", 4, part_bytes)
        parts = [[tuple(r) for r in p] for p in found.rdd.glom().collect()]
        assert len(parts) == -(-size // part_bytes) > 4
        places = [-1 if at is None else at for p in parts for at, _ in p]
        assert places == sorted(places) and max(map(len, parts)) < 2000 * 3 / len(parts)
        assert sorted(map(str, [r for p in parts for r in p])) == sorted(map(str, rows))
    assert io.ordered_parts(df.limit(0), "at", 4).count() == 0


def test_csv_files_of_a_large_table(spark, tmp_path, monkeypatch):
    """The query's files grow in number with its text, not in size."""
    from tierlens.plans import bridge, files

    docs = [(i, "s", "word " * 40 + str(i)) for i in range(300)]
    raw = spark.createDataFrame(docs, "row_ord long, product_id string, review_content string")
    raw = raw.withColumns({c: F.lit("x") for c in k.RAW_COLS if c not in raw.columns})
    monkeypatch.setattr(bridge, "raw_reviews", lambda *_: raw)
    monkeypatch.setattr(io, "work_folder", lambda _, name, n=iter(range(99)): str(tmp_path / f"{name}-{next(n)}"))
    monkeypatch.setattr(io, "PART_BYTES", 4000)
    got = files.reviews_csv(spark, "").orderBy("row_ord").select("row_ord", "review_content").collect()
    assert [tuple(r) for r in got] == [(i, t) for i, _, t in docs]
    sizes = [f.stat().st_size for f in tmp_path.glob("reviews-0/part-*.csv")]
    assert len(sizes) > 10 and max(sizes) < 16000
