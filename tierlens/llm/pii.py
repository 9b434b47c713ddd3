"""Personal data in texts: patterns with checks, and spans that a semi-Markov random field adds.

Emails, addresses, card and phone numbers in common form come from patterns. The field reads the windows around
digits and `@` signs: every run of tokens that may be an entity is a candidate, features of the whole span (sizes of
its groups, signs between them, check digit, what stands around it) score it as each kind, and dynamic
programming over entities of at most `TOKENS` tokens chooses boundaries and kinds together. It learns from a
bounded sample of windows (`WINDOWS` for each kind and as many without any): the spans of the patterns, and the same
spans in other styles, good (a phone number without `+`, `name at host dot org`) and bad (a wrong check digit,
a date). Its spans never overlap those of the patterns, which all stay.

Defined results: a null or empty text has no spans. Offsets are code points, ends exclusive. Spans are ordered by
start, then kind as in `KINDS`. Without any window to learn from, the patterns stand alone. Repeated rows get
equal results; columns named like the results are replaced, others pass through.
"""

import hashlib
import pickle
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import semicrf
from .store import kept

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
WINDOWS, EPOCHS, RATE, DECAY, LEAST = 150, 6, 0.3, 0.002, 3
#: Most tokens of an entity that the field adds, and characters of a window around each sign.
TOKENS, AROUND = 24, 48

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP_RUN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD_RUN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What a window is opened for.
SIGN = re.compile(r"[0-9]+|@|[(\[{]at[)\]}]| dot ")
WORD_END = re.compile(r"\S*")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
IN_NUMBER = frozenset("+().-/:[]")
IN_ADDRESS = frozenset("._%+-@()[]{}")
#: What may stand free in an address that is spelled out.
SPOKEN = frozenset(("at", "dot", *"()[]{}"))
AT_WORDS, DOT_WORDS = frozenset(("@", "at")), frozenset((".", "dot"))


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the patterns; each kind leftmost and without overlap, failing matches dropped."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:  # from sign to sign, as a search from every character would be quadratic
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done, EMAIL))
        at = text.find("@", max(at + 1, done))
    for m in IP_RUN.finditer(text):
        if all(int(p) <= 255 if len(p) < 9 else not p.strip("0") or int(p[-9:]) <= 255 and not p[:-9].strip("0")
               for p in m.group().split(".")):
            out.append((m.start(), m.end(), IP))
    for m in CARD_RUN.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := only_digits(m.group())) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), CARD))
    if "+" in text:
        for m in PHONE_RUN.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), PHONE))
    return sorted(out, key=lambda s: (s[0], s[2]))


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text around the signs, out to the next blank; those that meet become one."""
    start, end = 0, -1
    for m in SIGN.finditer(text):
        if end >= 0 and m.start() - AROUND <= end:
            end = max(end, WORD_END.match(text, min(m.end() + AROUND, len(text))).end()) if m.end() + AROUND > end else end
            continue
        if end >= 0:
            yield start, end
        low, start = max(end, 0), max(0, m.start() - AROUND)
        while start > low and not text[start - 1].isspace():
            start -= 1
        end = WORD_END.match(text, min(m.end() + AROUND, len(text))).end()
    if end >= 0:
        yield start, end


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]


def candidates(text: str, toks: list[tuple[int, int, str]], taken=()) -> list[semicrf.Segment]:
    """Every run of at most TOKENS tokens that may be an entity and meets no span of `taken`."""
    n = len(toks)
    blocked = [any(s < b and a < e for s, e, _ in taken) for a, b, _ in toks] if taken else [False] * n
    gap = [text[toks[i][1] : toks[i + 1][0]] for i in range(n - 1)] + ["\n\n"]
    low = [t.lower() for _, _, t in toks]
    digit = ["0" <= t[0] <= "9" for t in low]
    out = []
    for i in range(n):
        if blocked[i]:
            continue
        if digit[i] or low[i] in "+(":
            size = 0
            for j in range(i, min(n, i + TOKENS)):
                if blocked[j] or not (digit[j] or low[j] in IN_NUMBER):
                    break
                if digit[j]:
                    size += len(low[j])
                    if size > 19:
                        break
                    if size >= 4:
                        out.append(semicrf.Segment(i, j + 1, (IP, CARD, PHONE), number_features(text, toks, gap, digit, i, j + 1)))
                if gap[j] not in ("", " ", "\xa0"):
                    break
        if digit[i] or low[i].isalpha():
            ats = dots = 0
            for j in range(i, min(n, i + TOKENS)):
                word = low[j]
                mark = word in AT_WORDS or word in DOT_WORDS
                if blocked[j] or not (digit[j] or word.isalpha() or word in IN_ADDRESS):
                    break
                if j > i and word in AT_WORDS and (word == "@" or not word_like(gap, low, j)):
                    ats += 1
                if ats and word in DOT_WORDS:
                    dots += 1
                if ats > 1:
                    break
                if ats == 1 and dots and not mark and word.isalpha():
                    out.append(semicrf.Segment(i, j + 1, (EMAIL,), address_features(text, toks, gap, low, i, j + 1)))
                spoken = word in SPOKEN or j + 1 < n and low[j + 1] in SPOKEN
                if gap[j] and not (gap[j] == " " and spoken):
                    break
    return out


def word_like(gap: list[str], low: list[str], j: int) -> bool:
    """Whether `at` is a part of a run of letters and signs, not a mark: only one side is free."""
    return (gap[j - 1] == "") != (gap[j] == "")


def shape(n: int) -> str:
    return str(n) if n < 6 else "6" if n < 10 else "10"


def around(text: str, toks, gap, i: int, j: int) -> list[str]:
    """What stands next to tokens [i, j): a kind of character, and the word before."""
    a, b = toks[i][0], toks[j - 1][1]
    kind = lambda c: "none" if not c else "digit" if "0" <= c <= "9" else "letter" if c.isalpha() else "space" if c.isspace() else c
    left, right = kind(text[a - 1 : a]), kind(text[b : b + 1])
    after = kind(text[b + 1 : b + 2]) if right in (" ", "space", ".", "-", ",", "/", ":") else ""
    before = kind(text[a - 2 : a - 1]) if a > 1 and left in ("space", ".", "-", ",", "/", ":") else ""
    word = next((toks[k][2].lower() for k in range(i - 1, max(-1, i - 4), -1) if toks[k][2].isalpha()), "")
    return [f"left {left}", f"right {right}", f"left {left} {before}", f"right {right} {after}", f"word {word}"]


def number_features(text, toks, gap, digit, i: int, j: int) -> list[str]:
    groups, between, last = [], [], None
    for k in range(i, j):
        if digit[k]:
            groups.append(toks[k][2])
            if last is not None:
                between.append(text[last : toks[k][0]])
            last = toks[k][1]
    digits = "".join(groups)
    sizes = "-".join(str(len(g)) for g in groups) if len(groups) < 7 else "many"
    signs = "|".join(sorted(set(between)))
    lead = "".join(t for _, _, t in toks[i : i + 2] if t in "+(")
    same = "even" if len({len(g) for g in groups}) == 1 else "uneven"
    out = ["number", f"digits {len(digits)}", f"sizes {sizes}", f"signs {signs}", f"lead {lead}", f"sizes {sizes} {signs}",
           f"digits {len(digits)} {lead}", f"groups {min(len(groups), 7)} {same}"]
    if len(digits) >= 12:
        out += [f"check {luhn(digits)}", f"check {luhn(digits)} {same}"]
    if len(groups) == 4:
        fits = all(len(g) <= 3 and int(g) <= 255 for g in groups) and len(set(between)) == 1
        out.append(f"parts {fits} {signs}")
    if any(len(g) == 4 and g[:2] in ("19", "20") for g in groups) and len(groups) <= 3:
        out.append("year")
    return out + around(text, toks, gap, i, j)


def address_features(text, toks, gap, low, i: int, j: int) -> list[str]:
    at = next(k for k in range(i + 1, j) if low[k] in AT_WORDS and (low[k] == "@" or not word_like(gap, low, k)))
    mark = text[toks[at - 1][1] if not gap[at - 1] else toks[at][0] - 1 : toks[at][1]].lower()
    dots = sum(low[k] in DOT_WORDS for k in range(at, j))
    dot = next(text[toks[k][0] - 1 : toks[k][1]].lower()[-4:] for k in range(at, j) if low[k] in DOT_WORDS)
    dot = "." if dot.endswith(".") else "dot"
    bracket = next((c for c in text[toks[at - 1][0] : toks[at][0]] if c in "([{"), "")
    end = low[j - 1]
    out = ["address", f"mark {mark.strip()[-2:]} {bracket}", f"mark {low[at]} {dot}", f"dots {min(dots, 4)}", f"end {shape(len(end))} {end.isalpha()}",
           f"name {shape(toks[at - 1][1] - toks[i][0])}", f"begins {'letter' if low[i].isalpha() else 'digit'}"]
    return out + around(text, toks, gap, i, j)


def restyled(kind: int, span: str, rng: random.Random) -> list[tuple[str, bool]]:
    """The span in other styles, and whether they still are of its kind."""
    digits = only_digits(span)
    if kind == EMAIL:
        name, _, host = span.partition("@")
        spoken = host.replace(".", " dot ")
        return [(f"{name} at {spoken}", True), (f"{name}(at){host}", True), (f"{name}[at]{host.replace('.', '[dot]')}", True),
                (f"{name} [at] {spoken}", True), (f"{name}@{host.split('.')[0]}", False), (f"@{name}", False),
                (f"{host.split('.')[0]} at the dot", False)]
    if kind == IP:
        parts = span.split(".")
        bad = [str(int(p) % 250 + 300) if k == rng.randrange(4) else p for k, p in enumerate(parts)]
        return [("[.]".join(parts), True), ("(.)".join(parts), True), (".".join(parts[:3]), False), (".".join(parts[:2]), False),
                ("-".join(bad), False), (" ".join(parts), False)]
    if kind == CARD:
        four = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        spoilt = [wrong[k : k + 4] for k in range(0, len(wrong), 4)]
        return [(".".join(four), True), ("/".join(four), True), (wrong, False), (" ".join(spoilt), False), ("-".join(spoilt), False),
                (".".join(spoilt), False), (digits[:11], False), (digits[:8], False)]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    day, month, year = rng.randint(10, 28), rng.randint(1, 12), rng.randint(1950, 2049)
    return [(f"({a}) {b}-{c}", True), (f"{a}-{b}-{c}", True), (f"{a}.{b}.{c}", True), (f"1-{a}-{b}-{c}", True), (f"{a} {b} {c}", True),
            (f"001 {a} {b} {c}", True), (f"{year}-{month:02d}-{day}", False), (f"{day}/{month:02d}/{year}", False), (f"{day}.{month}.{year}", False),
            (f"{b}-{c}", False), (f"{year}-{year + 1}", False), (f"{day}:{month:02d}:{day + 20}", False), (f"{c}.{b}", False), (digits, False)]


def example(text: str, spans: list[tuple[int, int, int]]):
    """Tokens, candidates and gold entities of a window; None if a span is no candidate."""
    toks = tokens(text)
    starts, ends = {t[0]: i for i, t in enumerate(toks)}, {t[1]: i + 1 for i, t in enumerate(toks)}
    gold = [(starts.get(s, -1), ends.get(e, -1), k) for s, e, k in spans]
    segments = candidates(text, toks)
    known = {(s.start, s.end, k) for s in segments for k in s.kinds}
    gold.sort()
    if any(g not in known for g in gold) or any(a[1] > b[0] for a, b in zip(gold, gold[1:])):
        return None
    return (len(toks), segments, gold) if segments else None


def examples(samples: list[str], seed: int = 1):
    """Examples of the windows as they are and in other styles."""
    rng, out = random.Random(seed), []
    for text in samples:
        spans = base_spans(text)
        out.append(example(text, spans))
        if len(spans) != 1:
            continue
        (start, end, kind), styles = spans[0], restyled(spans[0][2], text[spans[0][0] : spans[0][1]], rng)
        for good in (True, False):
            new, _ = rng.choice([s for s in styles if s[1] == good])
            changed = text[:start] + new + text[end:]
            found = base_spans(changed)
            out.append(example(changed, [(start, start + len(new), kind)] if good and not found else found))
    return [x for x in out if x]


def fit(docs: DataFrame, per_kind: int = WINDOWS) -> semicrf.Model | None:
    """A model from at most `per_kind` windows for each kind and as many without a span, trained in one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                for a, b in windows(text or ""):
                    piece = text[a:b]
                    if len(piece) <= 8 * AROUND:
                        spans = base_spans(piece)
                        found.append((piece, KINDS[spans[0][2]] if len(spans) == 1 else "none" if not spans else "several"))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)] if found else [pa.array([], pa.string())] * 2, names=["piece", "of"])

    pieces = docs.select("text").mapInArrow(cut, "piece string, of string").withColumn("h", F.md5("piece"))
    # A sample of each kind: the first ones by hash, found in every part before they meet.
    pieces = kept(pieces.groupBy("of", F.substring("h", 1, 3).alias("share")).agg(F.min(F.struct("h", "piece")).alias("m")), "pieces")
    ranked = [pieces.where(F.col("of") == k).select("of", "m.*").orderBy("h").limit(per_kind) for k in (*KINDS, "none", "several")]
    sample = ranked[0]
    for more in ranked[1:]:
        sample = sample.unionByName(more)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        found = examples(frame.sort_values(["of", "h"])["piece"].tolist())
        model = semicrf.train(found, len(KINDS), EPOCHS, RATE, DECAY, LEAST)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    trained = kept(sample.withColumn("task", F.lit(1)).groupBy("task").applyInPandas(one, "model binary"), "model").first()
    return pickle.loads(trained["model"]) if trained else None


def added_spans(text: str, base: list[tuple[int, int, int]], model: semicrf.Model | None) -> list[tuple[int, int, int]]:
    """What the field finds besides the patterns' spans."""
    out = []
    for a, b in windows(text) if model else ():
        piece = text[a:b]
        toks = tokens(piece)
        segments = candidates(piece, toks, [(s - a, e - a, k) for s, e, k in base if s < b and a < e])
        if segments:
            out += [(a + toks[i][0], a + toks[j - 1][1], k) for i, j, k in semicrf.best(model, len(toks), segments)]
    return out


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


RESULTS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find(docs: DataFrame, model: semicrf.Model | None) -> DataFrame:
    """`docs` with `n_email`, `n_ip`, `n_card`, `n_phone` and `base_sha256` of the patterns' spans, and all `spans`."""
    names = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    some = re.compile(r"[0-9@]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [[] for _ in KINDS], [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                base = base_spans(text) if some.search(text) else []
                more = added_spans(text, base, sent.value)
                for k, held in enumerate(counts):
                    held.append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                texts.append(spans_text(sorted(base + more, key=lambda s: (s[0], s[2], s[1]))))
            new = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *new], names=[*names, *RESULTS])

    return rows.mapInArrow(run, f"{fields}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")
