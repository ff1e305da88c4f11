"""A linear-chain conditional random field with two states, over padded batches of sequences or over sequences of any length laid end to end."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) at each place, and the expected number of each transition.

    ``emit`` (B, T): the log-odds of state 1 by the features alone; ``mask``:
    places that exist (a prefix of each row); ``trans`` (2, 2): transition weights.
    """
    b, t = emit.shape
    on = np.exp(np.clip(emit, -30, 30))
    step = np.exp(trans)
    alpha, beta = np.empty((t, b, 2)), np.ones((t, b, 2))
    for k in range(t):
        a1 = on[:, k]
        if k == 0:
            n0, n1 = np.ones(b), a1
        else:
            p0, p1 = alpha[k - 1, :, 0], alpha[k - 1, :, 1]
            n0, n1 = p0 * step[0, 0] + p1 * step[1, 0], (p0 * step[0, 1] + p1 * step[1, 1]) * a1
            gone = ~mask[:, k]
            n0, n1 = np.where(gone, p0, n0), np.where(gone, p1, n1)
        total = n0 + n1
        alpha[k, :, 0], alpha[k, :, 1] = n0 / total, n1 / total
    for k in range(t - 2, -1, -1):
        b0, b1 = beta[k + 1, :, 0], beta[k + 1, :, 1] * on[:, k + 1]
        n0, n1 = step[0, 0] * b0 + step[0, 1] * b1, step[1, 0] * b0 + step[1, 1] * b1
        total = n0 + n1
        gone = ~mask[:, k + 1]
        beta[k, :, 0], beta[k, :, 1] = np.where(gone, 1.0, n0 / total), np.where(gone, 1.0, n1 / total)
    both = alpha * beta
    marginal = (both[:, :, 1] / both.sum(axis=2)).T
    pairs = np.zeros((2, 2))
    if t > 1:
        right = beta[1:] * np.stack([np.ones((t - 1, b)), on[:, 1:].T], axis=2)
        joint = alpha[:-1, :, :, None] * step * right[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        pairs = (joint * mask[:, 1:].T[:, :, None, None]).sum(axis=(0, 1))
    return np.where(mask, marginal, 0.0), pairs


def chain_forward_backward(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``forward_backward`` for sequences of ``sizes`` places laid end to end, each one whole chain: P(state 1) at each place, and the expected transitions.

    A sequence is cut into stretches of ``width``.  The product of a stretch's
    step matrices carries messages across it, so the messages at its ends follow
    in a few steps however long the sequence is; inside, all stretches are walked
    at once.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(n) - np.repeat(starts, sizes)
    stretches = -(-sizes // width)
    before = np.cumsum(stretches) - stretches  # stretches of the sequences before
    row, column = np.repeat(before, sizes) + place // width, place % width
    rows = int(stretches.sum())
    on, mask = np.ones((rows, width)), np.zeros((rows, width), dtype=bool)
    on[row, column], mask[row, column] = np.exp(np.clip(emit, -30, 30)), True
    step = np.exp(trans)
    opens = np.zeros(rows, dtype=bool)
    opens[before] = True

    def forward(state: np.ndarray, k: int) -> np.ndarray:
        """Messages (rows, m, 2) after place k; the first place of a sequence has no transition into it."""
        new = state @ step
        if k == 0:
            new[opens] = state[opens].sum(axis=2, keepdims=True)
        new[:, :, 1] *= on[:, k, None]
        new /= new.sum(axis=(1, 2), keepdims=True)
        return np.where(mask[:, k, None, None], new, state)

    across = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for k in range(width):
        across = forward(across, k)
    # Messages into and out of each stretch: the k-th stretches of all sequences that have one, together.
    into, out = np.full((rows, 2), 0.5), np.ones((rows, 2))
    for k in range(1, int(stretches.max())):
        at = before[stretches > k] + k
        into[at] = np.einsum("ri,rij->rj", into[at - 1], across[at - 1])
        into[at] /= into[at].sum(axis=1, keepdims=True)
    for k in range(int(stretches.max()) - 2, -1, -1):
        at = before[stretches > k + 1] + k
        out[at] = np.einsum("rij,rj->ri", across[at + 1], out[at + 1])
        out[at] /= out[at].sum(axis=1, keepdims=True)
    alpha, beta = np.empty((width, rows, 2)), np.empty((width, rows, 2))
    state = into[:, None, :]
    for k in range(width):
        state = forward(state, k)
        alpha[k] = state[:, 0, :]
    after = out
    for k in range(width - 1, -1, -1):
        beta[k] = after
        weighed = after.copy()
        weighed[:, 1] *= on[:, k]
        new = weighed @ step.T
        new /= new.sum(axis=1, keepdims=True)
        after = np.where(mask[:, k, None], new, after)
    a, b = alpha[column, row], beta[column, row]
    both = a * b
    marginal = both[:, 1] / both.sum(axis=1)
    inner = np.flatnonzero(place > 0)
    right = b[inner]
    right[:, 1] *= on[row[inner], column[inner]]
    joint = a[inner - 1][:, :, None] * step * right[:, None, :]
    return marginal, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """The likeliest states of one sequence; ties go to state 0."""
    best0, best1, back = 0.0, 0.0, []
    for k, e in enumerate(emit.tolist()):
        if k == 0:
            best1 = e
            continue
        s00, s10, s01, s11 = best0 + trans[0, 0], best1 + trans[1, 0], best0 + trans[0, 1], best1 + trans[1, 1]
        back.append((int(s10 > s00), int(s11 > s01)))
        best0, best1 = max(s00, s10), max(s01, s11) + e
    state = int(best1 > best0)
    out = [state]
    for pair in reversed(back):
        state = pair[state]
        out.append(state)
    return out[::-1][: len(emit)]


@dataclass
class Chain:
    """Weights of the features and transitions."""

    weights: np.ndarray
    trans: np.ndarray


def _ascend(features: np.ndarray, rows: np.ndarray, n_features: int, truth: np.ndarray, mask: np.ndarray, seen: np.ndarray, infer, rounds: int, rate: float, ridge: float) -> Chain:
    """Maximum likelihood by Adam; ``infer`` gives the marginals and expected transitions of the log-odds (flat) and transition weights."""
    size = mask.size
    w, trans = np.zeros(n_features), np.zeros((2, 2))
    n = max(1, int(mask.sum()))
    m1, m2 = np.zeros(n_features + 4), np.zeros(n_features + 4)
    for k in range(1, rounds + 1):
        marginal, pairs = infer(np.bincount(rows, w[features], minlength=size), trans)
        miss = np.where(mask, truth - marginal, 0.0)
        grad = np.concatenate([np.bincount(features, miss[rows], minlength=n_features), (seen - pairs).ravel()]) / n
        grad -= ridge * np.concatenate([w, trans.ravel()]) / n_features**0.5
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w += move[:-4]
        trans += move[-4:].reshape(2, 2)
    return Chain(w, trans)


def _transitions(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.bincount(2 * before.astype(np.int64) + after, minlength=4).reshape(2, 2).astype(float)


def fit(features: np.ndarray, rows: np.ndarray, n_features: int, labels: np.ndarray, mask: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """A chain from padded sequences. ``features`` and ``rows``: pairs (feature, place in the flattened batch); labels, mask: (B, T)."""
    both = mask[:, 1:] & mask[:, :-1]

    def infer(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marginal, pairs = forward_backward(emit.reshape(mask.shape), mask, trans)
        return marginal.ravel(), pairs

    return _ascend(features, rows, n_features, labels.ravel().astype(float), mask.ravel(), _transitions(labels[:, :-1][both], labels[:, 1:][both]), infer, rounds, rate, ridge)


def fit_chains(features: np.ndarray, rows: np.ndarray, n_features: int, labels: np.ndarray, sizes: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """A chain from sequences of ``sizes`` places laid end to end; ``rows``: places; labels: (places,)."""
    inner = np.ones(len(labels), dtype=bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    at = np.flatnonzero(inner)
    seen = _transitions(labels[at - 1], labels[at])
    return _ascend(features, rows, n_features, labels.astype(float), np.ones(len(labels), bool), seen, lambda emit, trans: chain_forward_backward(emit, sizes, trans), rounds, rate, ridge)
