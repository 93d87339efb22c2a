"""Plain numpy definitions that the Spark jobs are compared with on small fixtures."""

import numpy as np

POINTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def smoothed_psi(ref_counts, prod_counts):
    p = (np.asarray(ref_counts) + 1.0) / (np.sum(ref_counts) + len(ref_counts))
    q = (np.asarray(prod_counts) + 1.0) / (np.sum(prod_counts) + len(prod_counts))
    return float(np.sum((q - p) * np.log(q / p)))


def numeric_psi(ref, prod):
    ref, prod = np.asarray(ref, float), np.asarray(prod, float)
    known = ref[~np.isnan(ref)]
    if len(ref) == 0 or len(prod) == 0 or len(known) == 0:
        return 0.0
    edges = np.unique(np.quantile(known, POINTS))
    if len(edges) < 2:
        edges = np.array([edges[0] - 1e-6, edges[0] + 1e-6])

    def counts(x):
        present = x[~np.isnan(x)]
        slot = np.clip(np.searchsorted(edges, present, side="right"), 1, len(edges) - 1)
        return [int((slot == i).sum()) for i in range(1, len(edges))] + [int(np.isnan(x).sum())]

    return smoothed_psi(counts(ref), counts(prod))


def value_psi(ref, prod):
    ref, prod = np.asarray(ref, float), np.asarray(prod, float)
    cells = np.unique(np.concatenate([ref[~np.isnan(ref)], prod[~np.isnan(prod)]]))

    def counts(x):
        return [int((x == c).sum()) for c in cells] + [int(np.isnan(x).sum())]

    return smoothed_psi(counts(ref), counts(prod))


def ks(ref, prod):
    ref, prod = np.sort(ref), np.sort(prod)
    at = np.concatenate([ref, prod])
    gap = np.searchsorted(ref, at, "right") / len(ref) - np.searchsorted(prod, at, "right") / len(prod)
    return float(np.max(np.abs(gap)))


def auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    if len(pos) == 0 or len(neg) == 0:
        return 0.0
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return float(wins / (len(pos) * len(neg)))


def f1(label, predicted):
    tp = int(((label == 1) & (predicted == 1)).sum())
    wrong = int((label != predicted).sum())
    return 0.0 if 2 * tp + wrong == 0 else 2 * tp / (2 * tp + wrong)


def greedy(times, gap):
    sent, last = set(), None
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            sent.add(t)
            last = t
    return sent
