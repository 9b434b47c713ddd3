"""A bidirectional gated recurrent network with attention pooling, forwards and backwards in numpy.

Inputs are words as numbers into a small vocabulary, and the mean of hashed character n-gram vectors of
the same word, so words that no training text had still say something.
"""

import numpy as np

WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 16, 8, 8
BUCKETS = 8192
#: Lengths of character n-grams; a word is bracketed by two marks first.
GRAMS = (3, 4, 5)


def char_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, word by word, and where each word's begin (and the last end)."""
    marked = [b"<" + w + b">" for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(m) for m in marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), sizes)
    buckets, owners = [], []
    for n in GRAMS:
        k = len(flat) - n + 1
        if k <= 0:
            continue
        h = np.full(k, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + flat[i : i + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        keep = owner[:k] == owner[n - 1 :]
        buckets.append(((h[keep] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[:k][keep])
    bucket = np.concatenate([np.zeros(0, np.int32), *buckets])
    who = np.concatenate([np.zeros(0, np.int32), *owners])
    first = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(words)))))
    return bucket[np.argsort(who, kind="stable")], first


def of_words(bucket: np.ndarray, first: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of some words in the form of `char_buckets`."""
    count = first[picked + 1] - first[picked]
    new = np.concatenate(([0], np.cumsum(count)))
    return bucket[np.arange(new[-1]) + np.repeat(first[picked] - new[:-1], count)], new


def mean_of(table: np.ndarray, bucket: np.ndarray, first: np.ndarray, together: int = 4096) -> np.ndarray:
    """Mean of the bucket vectors of each word."""
    n = len(first) - 1
    out = np.zeros((n, table.shape[1]), np.float32)
    for i in range(0, n, together):
        at = first[i : i + together + 1]
        some = np.flatnonzero(np.diff(at))
        if len(some):
            sums = np.add.reduceat(table[bucket[at[0] : at[-1]]], at[some] - at[0], axis=0)
            out[i + some] = sums / np.diff(at)[some, None]
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(vocabulary: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD_DIM + CHAR_DIM
    w = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
    p = {"word": w(vocabulary + 1, WORD_DIM, by=0.1), "char": w(BUCKETS, CHAR_DIM, by=0.3)}
    for d in "fb":  # forwards, backwards
        p |= {f"in_{d}": w(size, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"rec_{d}": w(HIDDEN, 3 * HIDDEN)}
    p |= {"att": w(2 * HIDDEN, ATTEND), "att_v": w(ATTEND), "out": w(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
    return p


def inputs(p, numbers: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
    """What each word adds to the gates of both directions."""
    x = np.concatenate([p["word"][numbers], chars], axis=1)
    return {d: x @ p[f"in_{d}"] + p[f"bias_{d}"] for d in "fb"}


def _scan(gates, at, mask, rec, keep=None):
    """One direction over windows: `at[t]` is the word of step t in every window."""
    h = np.zeros((at.shape[1], HIDDEN), np.float32)
    states = np.empty((len(at), *h.shape), np.float32)
    for t in range(len(at)):
        g = gates[at[t]]
        r = h @ rec
        zr = g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]
        np.tanh(zr * np.float32(0.5), out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)  # the logistic function
        z, s = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN :] + s * r[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if mask is not None:
            new = np.where(mask[t], new, h)
        if keep is not None:
            keep.append((h, r, z, s, c))
        h = states[t] = new
    return states


def places(start: np.ndarray, length: np.ndarray, steps: int):
    """Word of each step, forwards and backwards, and which steps are inside the window (None: all)."""
    t = np.arange(steps)[:, None]
    inside = t < length
    last = np.maximum(length - 1, 0)
    f = start + np.minimum(t, last)
    b = start + np.maximum(last - t, 0)
    return f, b, None if inside.all() else inside[:, :, None]


def forward(p, gates, start, length, steps, tape=None):
    """One logit per window of words; a window has `length` of at most `steps` words."""
    f, b, mask = places(start, length, steps)
    kf, kb = ([], []) if tape is not None else (None, None)
    hf = _scan(gates["f"], f, mask, p["rec_f"], kf)
    hb = _scan(gates["b"], b, mask, p["rec_b"], kb)
    # Backward states are put where their word stands.
    n = len(start)
    turn = np.maximum(length - 1, 0) - np.arange(steps)[:, None]
    back = hb[::-1] if mask is None else hb[np.where(turn >= 0, turn, 0), np.arange(n)]
    h = np.concatenate([hf, back], axis=2)
    u = np.tanh(h @ p["att"])
    e = u @ p["att_v"]
    if mask is not None:
        e = np.where(mask[:, :, 0], e, np.float32(-1e9))
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, h)
    logit = pooled @ p["out"] + p["out_b"][0]
    if tape is not None:
        tape.update(f=f, b=b, mask=mask, kf=kf, kb=kb, h=h, u=u, a=a, pooled=pooled, turn=turn)
    return logit


def backward(p, tape, d_logit, n_words: int):
    """Gradients of the parameters, and of the gate inputs of every word."""
    g = {"out": tape["pooled"].T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
    h, u, a, mask = tape["h"], tape["u"], tape["a"], tape["mask"]
    d_pool = d_logit[:, None] * p["out"]
    dh = a[:, :, None] * d_pool
    da = np.einsum("tnh,nh->tn", h, d_pool)
    de = a * (da - (a * da).sum(axis=0))
    g["att_v"] = np.einsum("tn,tnk->k", de, u)
    du = de[:, :, None] * p["att_v"] * (1 - u * u)
    g["att"] = np.einsum("tnh,tnk->hk", h, du)
    dh += du @ p["att"].T
    steps, n = a.shape
    d_gates = {}
    d_back = dh[:, :, HIDDEN:]
    if mask is None:
        d_back = d_back[::-1]
    else:  # to the order in which the backward direction went
        turn = tape["turn"]
        moved = np.zeros_like(d_back)
        at = np.where(turn >= 0, turn, 0)
        np.add.at(moved, (at, np.arange(n)[None, :]), np.where(mask, d_back, 0))
        d_back = moved
    for d, kept, places_, dhs in (("f", tape["kf"], tape["f"], dh[:, :, :HIDDEN]), ("b", tape["kb"], tape["b"], d_back)):
        rec = p[f"rec_{d}"]
        d_rec, total = np.zeros_like(rec), np.zeros((n_words, 3 * HIDDEN), np.float32)
        carry = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            before, r, z, s, c = kept[t]
            d_new = dhs[t] + carry
            idle = 0
            if mask is not None:
                idle = np.where(mask[t], 0, d_new)
                d_new = np.where(mask[t], d_new, 0)
            dc = d_new * (1 - z) * (1 - c * c)
            dz = d_new * (before - c) * z * (1 - z)
            ds = dc * r[:, 2 * HIDDEN :] * s * (1 - s)
            d_g = np.concatenate([dz, ds, dc], axis=1)
            d_r = np.concatenate([dz, ds, dc * s], axis=1)
            d_rec += before.T @ d_r
            carry = d_new * z + d_r @ rec.T + idle
            np.add.at(total, places_[t], d_g)
        g[f"rec_{d}"], d_gates[d] = d_rec, total
    return g, d_gates
