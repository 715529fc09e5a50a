"""Plain-Python versions of the programs, as independent oracles."""

from collections import deque


def pagerank(nv, edges, k, alpha=0.15):
    deg = [0] * nv
    for s, _ in edges:
        deg[s] += 1
    x = [1 / nv / max(1, d) for d in deg]
    for _ in range(k):
        new = [0.0] * nv
        for s, d in edges:
            new[d] += x[s]
        x = [((1 - alpha) / nv + alpha * n) / max(1, d) for n, d in zip(new, deg)]
    return x


def hops(nv, edges, start):
    out = [[] for _ in range(nv)]
    for s, d in edges:
        out[s].append(d)
    dist = [nv] * nv
    if not 0 <= start < nv:
        return dist
    dist[start] = 0
    queue = deque([start])
    while queue:
        v = queue.popleft()
        for w in out[v]:
            if dist[w] == nv:
                dist[w] = dist[v] + 1
                queue.append(w)
    return dist


def labels(nv, edges):
    lab = list(range(nv))
    moved = True
    while moved:
        new = list(lab)
        for s, d in edges:
            new[d] = max(new[d], lab[s])
        moved, lab = new != lab, new
    return lab


def colfilter(nv, edges, k, size=20, lam=0.001, gamma=3.5e-7):
    x = [[(1 / size) ** 0.5] * size for _ in range(nv)]
    for _ in range(k):
        g = [[0.0] * size for _ in range(nv)]
        for s, d, w in edges:
            err = w - sum(a * b for a, b in zip(x[s], x[d]))
            for i in range(size):
                g[d][i] += err * x[s][i]
        x = [[v + gamma * (e - lam * v) for v, e in zip(a, b)] for a, b in zip(x, g)]
    return x


def union_find(pairs):
    root = {}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        for c in (a, b):
            root.setdefault(c, c)
        root[find(a)] = find(b)
    groups = {}
    for a in root:
        groups.setdefault(find(a), []).append(a)
    return {a: g for g in groups.values() for a in g}
