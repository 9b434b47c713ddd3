"""The random field against listing all segmentations, the patterns against plain searches, and styles it has not seen."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from tierlens.llm import pii, semicrf

SENTENCES = ["Call {} on any day.", "We sent it to {} last week, and no reply came", "la {} est ici.", "({})", "Contact: {}", "x {} y, z."]


def value(kind, rng):
    if kind == pii.EMAIL:
        return f"{rng.choice(['ana', 'bo.li', 'c_d', 'mia7'])}.{rng.randint(1, 99)}@{rng.choice(['mail', 'post3', 'box'])}.{rng.choice(['example.org', 'example.com', 'test.net'])}"
    if kind == pii.IP:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == pii.PHONE:
        return f"+1 ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    digits = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


@pytest.fixture(scope="module")
def windows():
    rng = random.Random(3)
    return [rng.choice(SENTENCES).format(value(k % 4, rng)) for k in range(360)]


@pytest.fixture(scope="module")
def model(windows):
    return semicrf.train(pii.examples(windows), 4, pii.EPOCHS, pii.RATE, pii.DECAY, pii.LEAST)


def all_segmentations(n, entities):
    if n == 0:
        yield []
        return
    for rest in all_segmentations(n - 1, entities):
        yield [*rest, (n - 1, n, semicrf.NONE, 0.0)]
    for i, end, label, score, _ in entities:
        if end == n:
            for rest in all_segmentations(i, entities):
                yield [*rest, (i, end, label, score)]


def total(model, steps):
    labels = [semicrf.NONE, *(s[2] for s in steps)]
    return sum(s[3] for s in steps) + sum(model.follow[a, b] for a, b in itertools.pairwise(labels))


def small(seed):
    rng = np.random.default_rng(seed)
    model = semicrf.Model({f"f{i}": i for i in range(5)}, rng.normal(size=(5, 2)), rng.normal(size=(3, 3)), 2)
    segments = [semicrf.Segment(i, j, (0, 1), [f"f{k}" for k in rng.integers(0, 6, 3)]) for i in range(6) for j in range(i + 1, min(6, i + 3) + 1)]
    return model, segments


@pytest.mark.parametrize("seed", range(4))
def test_field_against_all_segmentations(seed):
    model, segments = small(seed)
    entities = semicrf.scored(model, segments)
    scores = {tuple((s[0], s[1], s[2] - 1) for s in steps if s[2]): total(model, steps) for steps in all_segmentations(6, entities)}
    norm = math.log(sum(map(math.exp, scores.values())))
    assert semicrf.log_sum(semicrf.forward(model, 6, entities)[6]) == pytest.approx(norm)
    assert semicrf.backward(model, 6, entities)[0][semicrf.NONE] == pytest.approx(norm)
    assert tuple(semicrf.best(model, 6, segments)) == max(scores, key=scores.get)
    gold = [(0, 2, 1), (4, 5, 0)]
    likelihood, spans, pairs = semicrf.gradient(model, 6, segments, gold)
    assert likelihood == pytest.approx(scores[tuple(gold)] - norm)
    for weights, slope in ((model.spans, spans), (model.follow, pairs)):
        for place in ((0, 1), (2, 0)):
            weights[place] += 1e-5
            moved = semicrf.gradient(model, 6, segments, gold)[0]
            weights[place] -= 1e-5
            assert (moved - likelihood) / 1e-5 == pytest.approx(slope[place[0]][place[1]], abs=1e-3)


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else False,
                    12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_against_plain_searches():
    rng = random.Random(11)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "1", "23", "255", "4539 1488 0343 6467", "é", "(", ")", "%", "\n", "x@y.zz", "10.0.0.1", "+1 555 123 4567", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_numbers_in_other_notations_and_long_texts():
    assert pii.base_spans("000000000000001.2.3.4")[0] == (0, 21, pii.IP)
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    for text in ("1" * 300_000, "a" * 300_000, "1 " * 100_000, "+1" + "." * 300_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000):
        assert len(pii.base_spans(text)) < 200_000  # linear: these take no time
    assert pii.base_spans("w " * 500_000 + "a@b.cd") == [(1_000_000, 1_000_006, pii.EMAIL)]


def test_windows_hold_every_span():
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "12 ", "a@b.cd ", "x" * 60, "one dot two "]) for _ in range(400))
    cut = list(pii.windows(text))
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(cut))
    assert all(any(a <= s and e <= b for a, b in cut) for s, e, _ in pii.base_spans(text))


def test_styles_not_seen_before(model):
    rng = random.Random(77)
    good = bad = wrong_good = wrong_bad = 0
    for k in range(400):
        kind = k % 4
        span = value(kind, rng)
        for new, right in pii.restyled(kind, span, rng):
            before, after = rng.choice(["Please see ", "and then ", "oui ", "Nr: "]), rng.choice([" for more.", ", or not", " et puis"])
            text = before + new + after
            if pii.base_spans(text):
                continue
            found = pii.added_spans(text, [], model)
            if right:
                good, wrong_good = good + 1, wrong_good + (found != [(len(before), len(before) + len(new), kind)])
            else:
                bad, wrong_bad = bad + 1, wrong_bad + bool(found)
    assert wrong_good <= 0.05 * good and wrong_bad <= 0.05 * bad


def test_clean_text_gets_nothing(model):
    text = "Version 3.0.1 of 12 May 2021 costs 1,250.00 or 99.5 %, see page 17-18 at the dot. Half past 10:30, room 4/12, 2019-2020."
    assert pii.base_spans(text) == [] == pii.added_spans(text, [], model)


def test_patterns_stay_and_are_met_by_nothing(model):
    text = "+1 (843) 555-7672 170.106.47.218"  # the phone pattern runs on into the address and fails
    base = pii.base_spans(text)
    assert base == [(18, 32, pii.IP)]
    assert pii.added_spans(text, base, model) == [(0, 17, pii.PHONE)]


def test_find(spark, model, windows):
    rows = [(1, "mail a@b.cd or (017) 555-7713 now", 5, "s"), (2, None, 5, "s"), (3, "", 5, "s"), (None, "10.0.0.1", 5, "s")] * 2
    rows += [(9, "no data " * 200_000 + "a@b.cd", 5, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip int, spans string").repartition(3)
    found = {r["doc_id"]: r for r in pii.find(df, model).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1]["spans"] == "email:5:11,phone:15:29" and found[1]["base_sha256"] == sha("email:5:11")
    assert [found[1][f"n_{k}"] for k in pii.KINDS] == [1, 0, 0, 0] and found[None]["n_ip"] == 1
    assert found[2]["spans"] == found[3]["spans"] == "" and found[2]["base_sha256"] == sha("")
    assert found[9]["spans"] == "email:1600000:1600006"
    assert pii.find(df, model).count() == len(rows)
    assert pii.fit(df.where("doc_id = 2")) is None and pii.find(df.where("doc_id > 99"), None).count() == 0
    trained = pii.fit(spark.createDataFrame([(w,) for w in windows], "text string"), 60)
    assert pii.added_spans("Please see (017) 555-7713 for more.", [], trained) == [(11, 25, pii.PHONE)]
