"""A small causal self-attention model over subword ids, trained and run in numpy.

One layer: embedded ids and positions, masked attention, a two-layer perceptron, and a softmax over the next id. A text
is scored in windows that overlap by a quarter; each id is scored once, in the window where it has most context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

WIDTH, WINDOW = 16, 32
#: Ids that a window shares with the one before it, as a part of its length.
SHARED = 4


def initial(n_ids: int, log_prior: np.ndarray, seed: int = 3, width: int = WIDTH, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Random weights; the output starts as the ids' own frequencies. One more id is the beginning of a text."""
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {"ids": g(n_ids + 1, width) * 2, "places": g(window, width) * 0.3, "q": g(width, width), "k": g(width, width), "v": g(width, width), "o": g(width, width), "up": g(width, 2 * width), "up_bias": np.zeros(2 * width, np.float32), "down": g(2 * width, width) * 0.5, "out": g(width, n_ids) * 0.1, "out_bias": log_prior.astype(np.float32)}


#: Rows of one product: BLAS is fastest on products of narrow matrices when they are small.
ROWS = 384


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``, for many rows."""
    out, whole = np.empty((len(a), b.shape[1]), a.dtype), len(a) - len(a) % ROWS
    b = np.ascontiguousarray(b)
    if whole:
        np.matmul(a[:whole].reshape(-1, ROWS, a.shape[1]), b, out=out[:whole].reshape(-1, ROWS, b.shape[1]))
    if whole < len(a):
        np.matmul(a[whole:], b, out=out[whole:])
    return out


def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b``, for many rows."""
    whole = len(a) - len(a) % ROWS
    out = a[whole:].T @ b[whole:]
    if whole:
        out += np.matmul(a[:whole].reshape(-1, ROWS, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, ROWS, b.shape[1])).sum(0)
    return out


def in_range(totals: np.ndarray) -> bool:
    """Whether sums of exponentials are neither too large nor too small for 32 bits."""
    return not totals.size or bool(totals.min() > 1e-30 and totals.max() < 1e30)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials in place, up to a factor for each row where they would be too large or small."""
    if x.size and x.max() - x.min() > 60:
        x -= x.max(-1, keepdims=True)
    return np.exp(x, out=x)


def _softmax(x: np.ndarray) -> np.ndarray:
    _exp(x)
    x *= (1 / (x @ np.ones(x.shape[-1], x.dtype)))[..., None]
    return x


def forward(w: dict[str, np.ndarray], ids: np.ndarray, skip: int = 0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Hidden states of a batch of windows of ids, from place ``skip`` on, and what going back needs. Places before
    that are context alone: they have keys and values, and no more is worked out for them."""
    (b, n), d = ids.shape, w["ids"].shape[1]
    x = w["ids"].take(ids, 0)
    x += w["places"][:n]
    flat, own = x.reshape(-1, d), np.ascontiguousarray(x[:, skip:]).reshape(-1, d)
    k = times(flat, w["k"]).reshape(b, n, d)
    # Beside the values a one, by which the sums of exponentials come with those of the values.
    v = times(flat, np.pad(w["v"], ((0, 0), (0, 1)))).reshape(b, n, d + 1)
    v[:, :, d] = 1
    q = times(own, w["q"] * w["q"].dtype.type(1 / np.sqrt(d))).reshape(b, n - skip, d)
    turned, seen = np.ascontiguousarray(k.transpose(0, 2, 1)), np.tri(n, dtype=x.dtype)[skip:]
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.matmul(q, turned)
        np.exp(e, out=e)
        e *= seen
        both = np.matmul(e, v).reshape(-1, d + 1)
    if not in_range(both[:, d]):
        e = np.matmul(q, turned)
        e[:, seen == 0] = -np.inf
        e -= e.max(-1, keepdims=True)
        np.exp(e, out=e)
        both = np.matmul(e, v).reshape(-1, d + 1)
    part = 1 / both[:, d:]
    c = both[:, :d] * part
    h = times(c, w["o"])
    h += own
    r = times(h, w["up"])
    r += w["up_bias"]
    np.maximum(r, 0, out=r)
    y = times(r, w["down"])
    y += h
    return y.reshape(b, n - skip, d), {"x": flat, "own": own, "q": q, "k": k, "v": v, "e": e, "part": part, "c": c, "h": h, "r": r}


def gradients(w: dict[str, np.ndarray], ids: np.ndarray, targets: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Of the mean loss over targets of 0 and more, and that loss; ``ids`` are what stands before each target."""
    y, s = forward(w, ids)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    t = targets.ravel()
    rows = np.flatnonzero(t >= 0)
    own, t, n = flat(y)[rows], t[rows], max(1, len(rows))
    p = own @ w["out"]
    p += w["out_bias"]
    p = _softmax(p)
    at = np.arange(len(t))
    loss = -np.log(p[at, t] + 1e-30).sum() / n
    p[at, t] -= 1
    own /= n
    g = {"out": own.T @ p, "out_bias": np.ones(len(t), p.dtype) @ p / n}
    dy = np.zeros_like(y)
    flat(dy)[rows] = p @ (w["out"].T / n)
    return g | back(w, ids, s, dy), float(loss)


def back(w: dict[str, np.ndarray], ids: np.ndarray, s: dict[str, np.ndarray], dy: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all weights before the output, from those of the hidden states; ``s`` as of ``forward``."""
    (b, n), d = ids.shape, dy.shape[2]
    dy, skip, scale = dy.reshape(-1, d), n - dy.shape[1], dy.dtype.type(1 / np.sqrt(d))
    g = {"down": sums(s["r"], dy)}
    du = times(dy, w["down"].T)
    du *= np.sign(s["r"])
    g["up"], g["up_bias"] = sums(s["h"], du), np.ones(len(du), du.dtype) @ du
    dh = times(du, w["up"].T)
    dh += dy
    g["o"] = sums(s["c"], dh)
    # Chances are s["e"] times s["part"]. That factor goes to the narrow arrays, and what the sum of exponentials takes
    # is the last column, against the ones beside the values.
    dc = times(dh, np.pad(w["o"].T, ((0, 0), (0, 1))))
    np.negative(np.einsum("ij,ij->i", dc[:, :d], s["c"]), out=dc[:, d])
    dc *= s["part"]
    dc = dc.reshape(b, n - skip, d + 1)
    da = np.matmul(dc, np.ascontiguousarray(s["v"].transpose(0, 2, 1)))
    da *= s["e"]
    dk = np.matmul(da.transpose(0, 2, 1), s["q"]).reshape(-1, d)  # of which the scale is part
    dv = np.matmul(s["e"].transpose(0, 2, 1), dc[:, :, :d]).reshape(-1, d)
    dq = np.matmul(da, s["k"]).reshape(-1, d)
    dq *= scale
    g["q"], g["k"], g["v"] = sums(s["own"], dq), sums(s["x"], dk), sums(s["x"], dv)
    dh += times(dq, w["q"].T)
    dx = times(dk, w["k"].T)
    dx += times(dv, w["v"].T)
    dx = dx.reshape(b, n, d)
    dx[:, skip:] += dh.reshape(b, n - skip, d)
    g["places"] = np.zeros_like(w["places"])
    g["places"][:n] = (np.ones(b, dx.dtype) @ dx.reshape(b, -1)).reshape(n, d)
    g["ids"] = np.zeros_like(w["ids"])
    order = np.argsort(ids.ravel().astype(np.uint8 if len(w["ids"]) <= 256 else np.uint16 if len(w["ids"]) <= 1 << 16 else ids.dtype), kind="stable")
    held = ids.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    g["ids"][held[first]] = np.add.reduceat(dx.reshape(-1, d).take(order, 0), first)
    return g


def train(w: dict[str, np.ndarray], windows: np.ndarray, rate: float, seed: int, batch: int = 64, epochs: int = 1) -> dict[str, np.ndarray]:
    """Adam over ``windows``: rows of what stands before, then the targets (-1: none)."""
    w = {k: v.copy() for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order_, step, n = np.random.default_rng(seed), 0, windows.shape[1] // 2
    total = max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = order_.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = windows[order[at : at + batch]].astype(np.int64)
            g, _ = gradients(w, part[:, :n], part[:, n:])
            step += 1
            scale = rate * min(1.0, step / 20) * (1 - 0.9 * step / total) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k in w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                w[k] -= (scale * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return w


def pack(w: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype("<f4").tobytes()


def unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(data, "<f4"), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def cut_windows(n: int, window: int = WINDOW) -> np.ndarray:
    """First target of each window over ``n`` targets; windows overlap by a quarter."""
    shared = window // SHARED
    return np.arange(0, max(n - shared, 1), window - shared)


def windows(texts: list[np.ndarray], window: int = WINDOW, block: int = 1 << 15, kind: type = np.int16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of ``texts``, ``block`` at a time, each as what stands before it (-1: nothing) and its ids (-1:
    none, past the end); the text of each, and which of its windows it is."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin, flat = np.cumsum(sizes) - sizes, np.concatenate([*texts, [-1]]).astype(kind)
    starts = [cut_windows(n, window) for n in sizes]
    all_of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    for at in range(0, len(start), block):
        first, of = start[at : at + block, None], all_of[at : at + block]
        place = first + np.arange(-1, window)
        inside = (place >= 0) & (place < sizes[of][:, None])
        yield np.where(inside, flat[np.where(inside, place + begin[of][:, None], 0)], -1).astype(kind), of, first[:, 0] // (window - window // SHARED)


def with_targets(rows: np.ndarray, begin: int) -> np.ndarray:
    """Rows for ``train`` from ``windows`` kept as unsigned integers. As in scoring, what a window shares with the one
    before it is context alone, so that each id is a target once."""
    ids, window = rows.astype(np.int16 if rows.dtype == np.uint8 else np.int32), rows.shape[1] - 1
    ids[rows == np.iinfo(rows.dtype).max] = -1
    targets = ids[:, 1:].copy()
    targets[ids[:, 0] >= 0, : window // SHARED] = -1
    before = ids[:, :-1]
    return np.concatenate([np.where(before < 0, begin, before), targets], axis=1)


def last(w: dict[str, np.ndarray], own: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log10 of the chances of ``targets`` by one softmax over all ids, from hidden states."""
    logits = own @ w["out"]
    logits += w["out_bias"]
    p = _exp(logits)
    return np.log10(p[np.arange(len(targets)), targets] / (p @ np.ones(p.shape[1], p.dtype)) + 1e-38)


def log10_probabilities(w: dict[str, np.ndarray], texts: list[np.ndarray], batch: int = 128, output: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray] = last) -> np.ndarray:
    """Of all ids of ``texts``, one text after another: log10 of the chance that the model gives each."""
    window, shared, begin = len(w["places"]), len(w["places"]) // SHARED, w["ids"].shape[0] - 1
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate(texts).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    offset = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    before[offset[sizes > 0]] = begin
    starts = [cut_windows(n, window) for n in sizes if n]
    first = np.concatenate([s + o for s, o in zip(starts, offset[sizes > 0], strict=True)]) if starts else np.zeros(0, np.int64)
    stop = np.concatenate([np.minimum(s + window, n) + o for s, n, o in zip(starts, sizes[sizes > 0], offset[sizes > 0], strict=True)]) if starts else first
    lead = np.concatenate([np.where(s > 0, shared, 0) for s in starts]) if starts else first
    out = np.zeros(len(flat))
    # What a window shares with the one before it is context alone; only a text's first window scores these places too.
    whole, held = np.flatnonzero(lead == 0), []
    parts = [(range(at, min(at + batch, len(of))), of, skip, length) for of, skip, length in ((np.arange(len(first)), shared, window), (whole, 0, shared)) for at in range(0, len(of), batch)]
    for i, (at, of, skip, length) in enumerate(parts):
        part = of[at.start : at.stop]
        place = first[part, None] + np.arange(length)
        y, _ = forward(w, before.take(np.minimum(place, len(flat) - 1)), skip)
        own = np.flatnonzero(place[:, skip:] < stop[part, None])
        held.append((y.reshape(-1, y.shape[-1]).take(own, 0), place[:, skip:].ravel().take(own)))
        if len(held) == 8 or i == len(parts) - 1:
            y, where = (np.concatenate(x) for x in zip(*held, strict=True))
            out[where], held = output(w, y, flat[where]), []
    return out
