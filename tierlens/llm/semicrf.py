"""A semi-Markov conditional random field over the tokens of a window.

A segmentation cuts the tokens into entities of some kind, each one of the candidate segments given, and single
tokens of no kind. Its score is the sum of each entity's score, a weight for every feature of the whole
span, and of a weight for every two labels that follow each other. Sums over all segmentations and the
best one come from one pass over the tokens; an entity has a bounded number of tokens, so the pass is linear.
"""

import math
from dataclasses import dataclass, field

import numpy as np

NONE = 0  # the label of a single token; kind k is label k + 1
OFF = -1e30


@dataclass
class Segment:
    """Tokens [start, end) as a candidate, the kinds it may be, and the features of the whole span."""

    start: int
    end: int
    kinds: tuple[int, ...]
    features: list[str]


@dataclass
class Model:
    """`spans` has a row per feature and a column per kind, `follow` one per label and following label."""

    index: dict[str, int]
    spans: np.ndarray
    follow: np.ndarray
    kinds: int = field(default=0)


def log_sum(values) -> float:
    top = max(values)
    return OFF if top <= OFF else top + math.log(sum(math.exp(v - top) for v in values))


def scored(model: Model, segments: list[Segment]) -> list[tuple[int, int, int, float, int]]:
    """(start, end, label, score, place in `segments`) of every candidate and kind, by end."""
    out = []
    for place, s in enumerate(segments):
        rows = [r for f in s.features if (r := model.index.get(f)) is not None]
        total = model.spans[rows].sum(axis=0)
        out += [(s.start, s.end, k + 1, float(total[k]), place) for k in s.kinds]
    return sorted(out, key=lambda x: x[1])


def forward(model: Model, n: int, entities) -> list[list[float]]:
    """At each place and label, the log sum of all segmentations up to there that end with it."""
    labels, follow = range(model.kinds + 1), model.follow
    alpha = [[OFF] * len(labels) for _ in range(n + 1)]
    alpha[0][NONE] = 0.0
    parts = [[[] for _ in labels] for _ in range(n + 1)]
    at = 0
    for t in range(1, n + 1):
        before = alpha[t - 1]
        parts[t][NONE].append(log_sum([before[y] + follow[y, NONE] for y in labels]))
        while at < len(entities) and entities[at][1] == t:
            i, _, label, score, _ = entities[at]
            parts[t][label].append(score + log_sum([alpha[i][y] + follow[y, label] for y in labels]))
            at += 1
        alpha[t] = [log_sum(p) if p else OFF for p in parts[t]]
    return alpha


def backward(model: Model, n: int, entities) -> list[list[float]]:
    """At each place and label, the log sum of all ways on from there to the end."""
    labels, follow = range(model.kinds + 1), model.follow
    beta = [[OFF] * len(labels) for _ in range(n)] + [[0.0] * len(labels)]
    starts: dict[int, list] = {}
    for e in entities:
        starts.setdefault(e[0], []).append(e)
    for t in range(n - 1, -1, -1):
        on = [(NONE, beta[t + 1][NONE])] + [(label, score + beta[end][label]) for _, end, label, score, _ in starts.get(t, ())]
        beta[t] = [log_sum([follow[y, label] + v for label, v in on]) for y in labels]
    return beta


def best(model: Model, n: int, segments: list[Segment]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the entities in the best segmentation; of equal ones, that with fewer entities."""
    entities, labels, follow = scored(model, segments), range(model.kinds + 1), model.follow
    value = [[OFF] * len(labels) for _ in range(n + 1)]
    came: list[list] = [[None] * len(labels) for _ in range(n + 1)]
    value[0][NONE] = 0.0
    at = 0
    for t in range(1, n + 1):
        y = max(labels, key=lambda y: value[t - 1][y] + follow[y, NONE])
        value[t][NONE], came[t][NONE] = value[t - 1][y] + follow[y, NONE], (t - 1, y)
        while at < len(entities) and entities[at][1] == t:
            i, _, label, score, _ = entities[at]
            y = max(labels, key=lambda y: value[i][y] + follow[y, label])
            if (v := value[i][y] + follow[y, label] + score) > value[t][label]:
                value[t][label], came[t][label] = v, (i, y)
            at += 1
    t, y, out = n, max(labels, key=lambda y: value[n][y]), []
    while t:
        i, before = came[t][y]
        if y != NONE:
            out.append((i, t, y - 1))
        t, y = i, before
    return out[::-1]


def gradient(model: Model, n: int, segments: list[Segment], gold: list[tuple[int, int, int]]):
    """Log likelihood of the gold entities, and its slope: {feature row: per kind}, and per pair of labels."""
    entities, follow, labels = scored(model, segments), model.follow, range(model.kinds + 1)
    alpha, beta = forward(model, n, entities), backward(model, n, entities)
    total = log_sum(alpha[n])
    spans: dict[int, np.ndarray] = {}
    pairs = np.zeros_like(follow)
    likelihood = -total

    def add(place: int, label: int, amount: float) -> None:
        for f in segments[place].features:
            if (r := model.index.get(f)) is not None:
                spans.setdefault(r, np.zeros(model.kinds))[label - 1] += amount

    steps = [(t, t + 1, NONE, 0.0, None) for t in range(n)] + entities
    for i, end, label, score, place in steps:
        ways = [math.exp(min(0.0, alpha[i][y] + follow[y, label] + score + beta[end][label] - total)) for y in labels]
        for y in labels:
            pairs[y, label] -= ways[y]
        if place is not None:
            add(place, label, -sum(ways))
    known = {(i, end, label): (score, place) for i, end, label, score, place in entities}
    path, t = [], 0
    for i, end, kind in sorted(gold):
        path += [(u, u + 1, NONE) for u in range(t, i)] + [(i, end, kind + 1)]
        t = end
    y = NONE
    for i, end, label in path + [(u, u + 1, NONE) for u in range(t, n)]:
        pairs[y, label] += 1
        likelihood += follow[y, label]
        if label != NONE:
            score, place = known[i, end, label]
            add(place, label, 1.0)
            likelihood += score
        y = label
    return likelihood, spans, pairs


def train(examples, kinds: int, epochs: int, rate: float, decay: float, least: int, seed: int = 1) -> Model:
    """A model from (number of tokens, candidates, gold entities); features seen `least` times or more count."""
    seen: dict[str, int] = {}
    for _, segments, _ in examples:
        for s in segments:
            for f in s.features:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    model = Model(index, np.zeros((len(index), kinds)), np.zeros((kinds + 1, kinds + 1)), kinds)
    grown, grown_pairs = np.full(model.spans.shape, 1e-3), np.full(model.follow.shape, 1e-3)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for x in order.permutation(len(examples)):
            _, spans, pairs = gradient(model, *examples[x])
            for r, g in spans.items():
                g = g - decay * model.spans[r]
                grown[r] += g * g
                model.spans[r] += rate * g / np.sqrt(grown[r])
            grown_pairs += pairs**2
            model.follow += rate * pairs / np.sqrt(grown_pairs)
    return model
