"""Each stage, and the whole, against plain versions on rows with planted cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tierlens.llm import toxicity

from .test_ngram_join import shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "on", "th", "re", "li"]) for _ in range(rng.randrange(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, shared = line(60), line(55)
    rows = []
    for i in range(600):
        text = "\n".join(line(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 5)))
        if i % 5 == 0:
            w = text.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorkan", "blixer", "ZORKON"]))
            text = " ".join(w)
        elif i % 10 == 1:
            text += "\n" + shared.upper()
        elif i % 10 == 2:
            text += " " + passage + " " + line(5)
        elif i % 20 == 7 and i > 30:
            text = rows[i - 4][1] + " " + word()
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", "c", None]), 0))
    rows += [(900, None, None, "b", None), (901, "", None, "b", 0), (None, line(30), "en", "c", 1), rows[3], rows[3]]
    labels = [(i, int(i % 5 == 0)) for i in range(600)]
    return rows, labels, [(1, passage), (2, line(20)), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(float("inf") if doc is None else doc)
    out = []
    for doc, text, *rest in rows:
        mine = float("inf") if doc is None else doc
        stay = [x for x in (text or "").split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == mine]
        out.append((doc, None if text is None else "\n".join(stay), *rest))
    return out


def copies(rows):
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for k in range(i):
            if a and sets[k] and 100 * len(a & sets[k]) >= 75 * len(a | sets[k]):
                old, new = group[i], group[k]
                group = [new if g == old else g for g in group]
    best = {}
    for i, g in enumerate(group):
        k = (rows[i][0] is None, rows[i][0] or 0)
        if g not in best or k < best[g][0]:
            best[g] = (k, i)
    return [rows[i] for _, i in best.values()]


def passages(rows, items, width=10):
    span = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[i : i + width]) for _, t in items for w in [span.findall((t or "").lower())] if w for i in range(max(len(w) - width, 0) + 1)}
    out = []
    for doc, text, *rest in rows:
        found = list(span.finditer((text or "").lower()))
        w, hit = [m[0] for m in found], set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if hit:
            pieces, last = [], 0
            for i in sorted(hit):
                if i - 1 not in hit:
                    pieces.append(text[last : found[i].start()])
                last = found[i].end()
            text = " ".join(p.strip(" \n") for p in [*pieces, text[last:]] if p.strip())
        out.append((doc, text, *rest))
    return out


def mixed(rows, weights=(1, 2, 3), most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while True:
        share = left / sum(weight[s] for s in free)
        held = {s for s in free if share * weight[s] > most * total[s]}
        if not held:
            break
        for s in held:
            target[s] = most * total[s]
            left -= target[s]
        free -= held
    target |= {s: share * weight[s] for s in free}
    got = Counter()
    by_hash = lambda r: hashlib.md5((("" if r[0] is None else str(r[0])) + "mix").encode()).hexdigest()[:30]
    for s in names:
        mine = defaultdict(list)
        for r in rows:
            if r[3] == s:
                mine[by_hash(r)].append(r)
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, at = round(target[s] - whole * total[s]), 0
        for h in sorted(mine):
            n = sum(size(r[1]) for r in mine[h])
            extra = budget > 0 and (at + n < budget or (at < budget and 2 * (budget - at) > n))
            at += n
            for r in mine[h]:
                got[r] = whole + extra
    return target, got


def test_stages(spark, folder):
    read = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    items = corpus()[2]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores, _ = toxicity.text_scores([(r[1] or "").encode() for r in rows], model)
    rude = {r[0] for r, s in zip(rows, scores) if s >= 0.3}
    assert len(rude & set(range(0, 600, 5))) > 100 and len(rude - set(range(0, 600, 5))) < 24  # of 480

    want = [r for r, s in zip(rows, scores) if s < 0.3]
    sized = lambda rows: sorted(((*r[:4], len(r[1] or "")) for r in rows), key=str)
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "mixing"]

    def through(name, docs):
        out = cp.kept(stages[name](spark, docs, folder), name)
        assert name == "mixing" or out.columns == docs.columns
        return out

    docs = through("toxicity", docs)
    assert read(docs) == sorted(want, key=str)
    docs, want = through("line_dedup", docs), sized(lines(want))
    assert read(docs) == want
    docs, fewer = through("ngram_join", docs), sorted(copies(want), key=str)
    assert read(docs) == fewer and len(fewer) < len(want)
    docs, want = through("decontamination", docs), sized(passages(fewer, items))
    assert read(docs) == want and want != fewer
    target, taken = mixed(want)
    got = through("mixing", docs).collect()
    assert Counter({tuple(r)[:5]: r["copies"] for r in got}) == Counter({r: int(n) for r, n in taken.items() if n})
    assert got and [tuple(r) for r in cp.run(spark, folder).orderBy("doc_id").collect()] == sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0))


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


CLASHING = ("hash", "size", "score", "predicted", "worst_word", "items", "spans", "n_lines", "n_dropped", "row", "of", "copies",
            "source_size", "_rest", "_row", "_id", "stays", "n_words")


def test_columns_named_like_results_pass_through(spark, folder):
    """Every stage returns the columns it got, whatever their names."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    rest = [c for c in CLASHING if c != "copies"]
    for name, stage in cp.STAGES:
        docs = cp.kept(docs, "docs")
        out = stage(spark, docs, folder)
        assert out.columns == (docs.columns if name != "mixing" else [*(c for c in docs.columns if c != "copies"), "copies"])
        assert [tuple(v) for v in out.select(*rest).distinct().collect()] == [tuple(CLASHING.index(c) for c in rest)], name


def test_row_numbers_hold_when_reads_are_split_otherwise(spark, tmp_path, monkeypatch):
    """A table of many files, whose reads are packed otherwise in every job, keeps the right documents."""
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i, same + (" end" if i % 2 else "") if i % 5 == 0 else f"text {i} " + " ".join(f"x{i}y{j}" for j in range(20)), "a", "s", 1) for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(path)
    plain, jobs = cp.kept, iter(range(1000))

    def kept(df, name):
        spark.conf.set("spark.sql.files.minPartitionNum", (4, 64)[next(jobs) % 2])
        return plain(df, name)

    monkeypatch.setattr(cp, "kept", kept)
    try:
        out = cp.drop_near_copies(spark, spark.read.parquet(path), "")
        assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted([0, *(i for i in range(400) if i % 5)])
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
