"""A linear-chain conditional random field over binary features, in numpy.

Training maximises the likelihood of whole label sequences (forward-backward, Adagrad on
mini-batches, L2); decoding is Viterbi. Both work on padded batches, so Python only handles lists
of feature numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """``vocabulary``: number of each feature; ``emit``: weights by feature and label (the last row is 0, for padding)."""

    labels: tuple[str, ...]
    vocabulary: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


def _padded(seqs: Sequence[Sequence[Sequence[int]]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers as (sequence, position, feature), filled with ``pad``, and the lengths."""
    n = np.array([len(s) for s in seqs])
    width = max((len(f) for s in seqs for f in s), default=1)
    x = np.full((len(seqs), int(n.max(initial=1)), width), pad, dtype=np.int32)
    for i, s in enumerate(seqs):
        for j, f in enumerate(s):
            x[i, j, : len(f)] = f
    return x, n


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def train(seqs: Sequence[Sequence[Sequence[str]]], tags: Sequence[Sequence[str]], labels: Sequence[str], epochs: int = 12, batch: int = 128, rate: float = 0.25, l2: float = 1e-5, seed: int = 7) -> Model:
    """Fits a model to labelled sequences of feature names; the same input gives the same model."""
    vocabulary: dict[str, int] = {}
    for s in seqs:
        for f in s:
            for name in f:
                vocabulary.setdefault(name, len(vocabulary))
    pad, k = len(vocabulary), len(labels)
    ids = [[[vocabulary[n] for n in f] for f in s] for s in seqs]
    at = {t: i for i, t in enumerate(labels)}
    ys = [[at[t] for t in s] for s in tags]
    emit, move, start = np.zeros((pad + 1, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(emit, 1e-2), np.full_like(move, 1e-2), np.full_like(start, 1e-2)]
    rng = np.random.default_rng(seed)
    by_length = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    blocks = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
    for _ in range(epochs):
        for b in rng.permutation(len(blocks)):
            rows = blocks[b]
            x, n = _padded([ids[i] for i in rows], pad)
            m, width = x.shape[:2]
            y = np.zeros((m, width), dtype=np.int64)
            for r, i in enumerate(rows):
                y[r, : len(ys[i])] = ys[i]
            live = np.arange(width)[None, :] < n[:, None]
            e = emit[x].sum(axis=2)
            a = np.zeros((m, width, k))
            a[:, 0] = start + e[:, 0]
            for t in range(1, width):
                step = _logsumexp(a[:, t - 1, :, None] + move[None], 1) + e[:, t]
                a[:, t] = np.where(live[:, t, None], step, a[:, t - 1])
            z = _logsumexp(a[:, -1], 1)
            back = np.zeros((m, width, k))
            for t in range(width - 2, -1, -1):
                step = _logsumexp(move[None] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(live[:, t + 1, None], step, 0.0)
            p = np.exp(a + back - z[:, None, None]) * live[:, :, None]
            gold = np.eye(k)[y] * live[:, :, None]
            diff = gold - p
            g_emit = np.zeros_like(emit)
            flat = x[live]
            each = np.repeat(diff[live], flat.shape[1], axis=0)
            for c in range(k):
                g_emit[:, c] = np.bincount(flat.ravel(), weights=each[:, c], minlength=pad + 1)
            g_move = np.zeros_like(move)
            for t in range(1, width):
                on = live[:, t]
                if on.any():
                    joint = np.exp(a[on, t - 1][:, :, None] + move[None] + (e[on, t] + back[on, t])[:, None, :] - z[on, None, None])
                    g_move -= joint.sum(axis=0)
                    np.add.at(g_move, (y[on, t - 1], y[on, t]), 1.0)
            g_start = diff[:, 0].sum(axis=0)
            for w, g, s in zip((emit, move, start), (g_emit, g_move, g_start), sums, strict=True):
                g = g / m - l2 * w
                s += g * g
                w += rate * g / np.sqrt(s)
            emit[pad] = 0.0
    return Model(tuple(labels), vocabulary, emit.astype(np.float32), move.astype(np.float32), start.astype(np.float32))


def decode_flat(model: Model, scores: np.ndarray, lengths: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
    """The most likely label number at every position of sequences that lie one behind the other, ``lengths`` (1 or more) long.

    Sequences of like length are decoded side by side, about ``cells`` positions at a time, or one longer sequence.
    """
    out = np.zeros(len(scores), dtype=np.int8)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order):  # rows twice as many, as long as the longest of them keeps within the cells
            more = min(len(order), at + 2 * (upto - at))
            if sorted_lengths[more - 1] * (more - at) > cells or sorted_lengths[more - 1] > 1.25 * sorted_lengths[at] + 4:
                break
            upto = more
        rows, n = order[at:upto], sorted_lengths[at:upto]
        at = upto
        m, width = len(rows), int(n[-1])
        where = first[rows][:, None] + np.minimum(np.arange(width)[None, :], n[:, None] - 1)
        e = scores[where.T]  # position, sequence, label
        score = model.start + e[0]
        last = score.copy()
        came = np.zeros((width, m, scores.shape[1]), dtype=np.int8)
        for t in range(1, width):
            paths = score[:, :, None] + model.move[None]
            came[t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + e[t]
            ends = n > t
            last[ends] = score[ends]
        y = last.argmax(axis=1).astype(np.int8)
        each = np.arange(m)
        for t in range(width - 1, -1, -1):
            live = n > t
            out[where[live, t]] = y[live]
            if t:
                y = np.where(live, came[t, each, y], y)
    return out


def decode(model: Model, seqs: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The most likely label numbers of each sequence of scores."""
    full = [i for i, s in enumerate(seqs) if len(s)]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(seqs)
    if full:
        lengths = np.array([len(seqs[i]) for i in full])
        for i, y in zip(full, np.split(decode_flat(model, np.concatenate([seqs[i] for i in full]), lengths), np.cumsum(lengths)[:-1]), strict=True):
            out[i] = y
    return out


def viterbi(model: Model, seqs: Sequence[Sequence[Sequence[int]]]) -> list[np.ndarray]:
    """The most likely label numbers of each sequence of feature numbers."""
    return decode(model, [np.stack([model.emit[list(f)].sum(axis=0) for f in s]) if len(s) else np.zeros((0, len(model.labels))) for s in seqs])
