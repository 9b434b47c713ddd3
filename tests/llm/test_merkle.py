"""The manifest against a plain tree, for several fan-outs and block sizes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tierlens.llm import merkle

COLUMNS = ["doc_id", "lang", "text"]


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_proofs(nodes: list[str], fanout: int):
    """The root, and each node's siblings level by level, straight from the definition."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, held = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k, below in enumerate(owners[at : at + fanout]):
                for i in below:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha(*run))
            held.append([i for below in owners[at : at + fanout] for i in below])
        nodes, owners = parents, held
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaf = lambda r: sha(*map(field, r))
    out, subroots = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, proofs = plain_proofs([leaf(r) for r in own], fanout)
        subroots.append(root)
        out.append([(r[0], leaf(r), root, p) for r, p in zip(own, proofs)])
    root, tops = plain_proofs(subroots, fanout)
    return sorted((i or -1, leaf, sub, root, str(p + top)) for own, top in zip(out, tops) for i, leaf, sub, p in own)


def found(df):
    rows = df.select("doc_id", "leaf", "subroot", "root", "proof").collect()
    return sorted((r[0] or -1, r[1], r[2], r[3], str([tuple(s) for s in r[4]])) for r in rows)


@pytest.mark.parametrize("fanout,levels", [(2, 3), (3, 1)])
def test_manifest_equals_a_plain_tree(spark, fanout, levels):
    rows = [(i * 7 % 41 + 1, "en", f"text {i}") for i in range(41)]
    rows += [(100 + i, "é", "x" * i) for i in range(5)] + [(200, None, None), (201, None, ""), (300, "de", "alone")]
    rows += [(None, "fr", "no id"), (None, "fr", "no id either"), (401, "fr", "ü\n")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    out = merkle.manifest(df, COLUMNS, "lang", ["doc_id"], fanout=fanout, levels=levels)
    assert found(out) == plain_manifest(rows, fanout)
    assert out.where(merkle.fold("leaf") != F.col("root")).count() == 0


def test_changed_rows_lead_elsewhere(spark):
    df = spark.range(1, 100).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS lang", "repeat('y', int(id)) AS text")
    changed = merkle.row_hash("doc_id", "lang", F.concat("text", F.lit("!")))
    out = merkle.manifest(df, COLUMNS, "lang", ["doc_id"], {"changed": changed}, levels=3)
    out = out.select((merkle.fold("changed") == F.col("root")).alias("a"), (merkle.fold("leaf") == F.col("root")).alias("b"))
    assert [tuple(r) for r in out.distinct().collect()] == [(False, True)]
    assert out.count() == 99


def test_repeated_rows_ties_and_other_columns(spark):
    rows = [(1, "a", "same", 9, 9)] * 3 + [(1, "a", "other", 8, 8)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, root int, _at int")
    out = merkle.manifest(df, COLUMNS, "lang", ["doc_id"])
    root, proofs = plain_proofs(sorted(sha(field(1), field("a"), field(t)) for t in ("same", "same", "same", "other")), 2)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    assert {r["root"] for r in out.collect()} == {root}
    assert sorted(r[0] for r in out.select(merkle.proof_text()).collect()) == sorted("".join(a + b for a, b in p) for p in proofs)


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([(5, "a", "x" * 300_000)], "doc_id long, lang string, text string")
    assert merkle.manifest(df.where("doc_id < 0"), COLUMNS, "lang", ["doc_id"]).count() == 0
    only = merkle.manifest(df, COLUMNS, "lang", ["doc_id"]).first()
    assert only["leaf"] == only["subroot"] == only["root"] == sha("1:5", "1:a", "300000:" + "x" * 300_000)
    assert only["proof"] == []
