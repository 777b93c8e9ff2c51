"""Plain HDBSCAN for small inputs, straight from the definition: full matrix, Kruskal dendrogram, top-down condense."""

from __future__ import annotations

import numpy as np


def hdbscan(x: np.ndarray, min_cluster_size: int, min_samples: int, normalise: bool = True):
    x = np.asarray(x, dtype=float)
    if normalise:
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norms > 0, norms, 1.0)
    n = len(x)
    labels, probs = np.full(n, -1), np.zeros(n)
    if n < max(min_cluster_size, 2):
        return labels, probs
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    # Kruskal over all pairs builds the dendrogram.
    pairs = sorted((m[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    node_of, kids, size, dist = list(range(n)), {}, dict.fromkeys(range(n), 1), {}
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    nxt = n
    for w, i, j in pairs:
        a, b = root(i), root(j)
        if a == b:
            continue
        kids[nxt], size[nxt], dist[nxt] = (node_of[a], node_of[b]), size[node_of[a]] + size[node_of[b]], w
        top[b] = a
        node_of[a] = nxt
        nxt += 1

    def leaves(node):
        stack, out = [node], []
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack.extend(kids[k])
        return out

    rows, child_rows, birth, fresh = {0: []}, {0: []}, {0: 0.0}, 1
    stack = [(nxt - 1, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        lam = 1.0 / max(dist[node], 1e-12)
        a, b = kids[node]
        if size[a] >= min_cluster_size and size[b] >= min_cluster_size:
            for k in (a, b):
                rows[fresh], child_rows[fresh], birth[fresh] = [], [], lam
                child_rows[cluster].append((fresh, size[k], lam))
                stack.append((k, fresh))
                fresh += 1
        else:
            for k in (a, b):
                if size[k] >= min_cluster_size:
                    stack.append((k, cluster))
                else:
                    rows[cluster] += [(p, lam) for p in leaves(k)]
    stab = {
        c: sum(l - birth[c] for _, l in rows[c]) + sum(s * (l - birth[c]) for _, s, l in child_rows[c]) for c in rows
    }
    best, keep = {}, {}
    for c in sorted(rows, reverse=True):
        below = sum(best[k] for k, _, _ in child_rows[c])
        keep[c] = c != 0 and stab[c] >= below
        best[c] = max(stab[c], below)
    stack = [(0, None)]
    while stack:
        c, chosen = stack.pop()
        chosen = chosen if chosen is not None else (c if keep[c] else None)
        for p, lam in rows[c]:
            if chosen is not None:
                peak = max([l for _, l in rows[chosen]] + [l for _, _, l in child_rows[chosen]])
                labels[p], probs[p] = chosen, min(lam, peak) / peak
        stack.extend((k, chosen) for k, _, _ in child_rows[c])
    return labels, probs
