"""The maintained cube against the cube of the reviews that are left."""

import random

import pytest
from pyspark.sql import functions as F

from tierlens.sources import io
from tierlens.streaming import maintained

KEYS = ("product", "aspect")
SCHEMA = "id long, at long, product string, words string"
POLARITY = {"+": "positive", "-": "negative", "0": "neutral", "?": "other"}


def spans(rows):
    """A review's words are aspects with a sign."""
    found = rows.select("id", "product", F.explode(F.split("words", " ")).alias("w")).where("w <> ''")
    polarity = F.create_map(*[F.lit(x) for kv in POLARITY.items() for x in kv])
    return found.select("id", "product", F.expr("substring(w, 2, 9)").alias("aspect"), polarity[F.substring("w", 1, 1)].alias("polarity"))


def plain(batches):
    """The cube counted in one go from each review's last row."""
    last = {}
    for batch in batches:
        for i, at, product, words in sorted(batch, key=lambda r: r[1]):
            last[i] = (product, words)
    out = {}
    for product, words in last.values():
        for w in (words or "").split():
            counts = out.setdefault((product, w[1:]), dict.fromkeys(POLARITY.values(), 0))
            counts[POLARITY[w[0]]] += 1
    return {(*k, c["positive"], c["negative"], c["neutral"]) for k, c in out.items() if None not in k}


def cube(df):
    return {tuple(r) for r in df.select(*KEYS, "positive", "negative", "neutral").collect()}


def some_batches(n, seed=3):
    rng, at, out = random.Random(seed), 0, []
    for _ in range(n):
        batch = []
        for _ in range(40):
            at += 1
            words = " ".join(rng.choice("+-0?") + rng.choice(["size", "price", "sound"]) for _ in range(rng.randint(0, 4)))
            batch.append((rng.choice([None, *range(30)]), at, rng.choice(["p", "q", None]), rng.choice([words, words, words, None])))
        out.append(batch)
    return out


def apply(spark, folder, batch, version, **more):
    df = spark.createDataFrame(batch, SCHEMA).repartition(3)
    return maintained.apply_batch(spark, folder, df, version, spans, "id", "at", KEYS, **more)


def test_batches_add_up_and_take_back(spark, tmp_path):
    folder, batches = str(tmp_path), some_batches(5)
    assert maintained.read_cube(spark, folder, keys=KEYS) is None
    for i, batch in enumerate(batches):
        assert apply(spark, folder, batch, i, snapshot_every=2)
        assert cube(maintained.read_cube(spark, folder, keys=KEYS)) == plain(batches[: i + 1])
    assert not apply(spark, folder, some_batches(1, 9)[0], 2)  # finished before
    assert apply(spark, folder, batches[4], 5)  # the same rows once more
    assert cube(maintained.read_cube(spark, folder, keys=KEYS)) == plain(batches)
    for i in range(5):
        assert cube(maintained.read_cube(spark, folder, i, KEYS)) == plain(batches[: i + 1])
    deltas = spark.read.parquet(f"{folder}/deltas")
    assert deltas.where("version = 5").count() == 0


def test_a_batch_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    folder, batches = str(tmp_path), some_batches(2, 5)
    apply(spark, folder, batches[0], 0)
    save = maintained._save
    for broken in ("facts", "deltas", "commits"):

        def fail(df, folder, table, version, broken=broken):
            if table == broken:
                save(df.limit(1), folder, table, version) if table != "commits" else None
                raise OSError("lost")
            save(df, folder, table, version)

        monkeypatch.setattr(maintained, "_save", fail)
        with pytest.raises(OSError):
            apply(spark, folder, batches[1], 1)
        assert cube(maintained.read_cube(spark, folder, keys=KEYS)) == plain(batches[:1])
    monkeypatch.setattr(maintained, "_save", save)
    apply(spark, folder, batches[1], 1)
    assert cube(maintained.read_cube(spark, folder, keys=KEYS)) == plain(batches)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, folder, batches = str(tmp_path / "in"), str(tmp_path / "out"), some_batches(3, 7)
    schema = spark.createDataFrame([], SCHEMA).schema
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = maintained.maintain(spark, source, schema, spans, folder, "id", "at", KEYS)
        assert cube(got) == plain(batches[: i + 1])
    assert maintained.versions(spark, folder) == [0, 1, 2] and io.path_exists(spark, f"{folder}/commits/version=2")
