"""Brute-force numpy versions of the analysis' metric definitions, used as
test oracles (written from the documented semantics, single machine)."""

from __future__ import annotations

import numpy as np


def pr_points(y, p):
    """(thresholds asc, precision, recall) -- one point per distinct score."""
    y = np.asarray(y, int)
    p = np.asarray(p, float)
    thr = np.unique(p)
    P = y.sum()
    prec, rec = [], []
    for t in thr:
        f = p >= t
        tp = (f & (y == 1)).sum()
        fp = (f & (y == 0)).sum()
        prec.append(tp / (tp + fp))
        rec.append(tp / P if P > 0 else 1.0)
    return thr, np.array(prec), np.array(rec)


def average_precision(y, p):
    thr, prec, rec = pr_points(y, p)
    # descending threshold: recall increases
    r = rec[::-1]
    pr = prec[::-1]
    prev = np.concatenate([[0.0], r[:-1]])
    return float(np.sum((r - prev) * pr))


def roc_auc(y, p):
    y = np.asarray(y, int)
    p = np.asarray(p, float)
    pos = p[y == 1]
    neg = p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return float((gt + 0.5 * eq) / (len(pos) * len(neg)))


def recall_at_precision(y, p, floor):
    thr, prec, rec = pr_points(y, p)
    m = prec >= floor
    return float(rec[m].max()) if m.any() else 0.0


def tune_f1(y, p):
    thr, prec, rec = pr_points(y, p)
    f1 = 2 * prec * rec / (prec + rec + 1e-12)
    return float(thr[int(np.argmax(f1))])


def silhouette(X, labels):
    X = np.asarray(X, float)
    labels = np.asarray(labels)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(X)):
        own = labels == labels[i]
        if own.sum() <= 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in np.unique(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def ari(a, b):
    a = np.asarray(a)
    b = np.asarray(b)
    n = len(a)
    from math import comb
    ua, ub = np.unique(a), np.unique(b)
    cont = np.array([[np.sum((a == x) & (b == y)) for y in ub] for x in ua])
    s = sum(comb(int(v), 2) for v in cont.ravel())
    sa = sum(comb(int(v), 2) for v in cont.sum(1))
    sb = sum(comb(int(v), 2) for v in cont.sum(0))
    exp = sa * sb / comb(n, 2)
    mx = (sa + sb) / 2
    if mx == exp:
        return 1.0
    return float((s - exp) / (mx - exp))
