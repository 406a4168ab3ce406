"""Plain-Python definitions used as brute-force oracles on micro graphs."""

from __future__ import annotations

import math
from collections import defaultdict


def six(values):
    if not values:
        return dict(avg=0.0, min=0.0, max=0.0, sum=0.0, std=0.0, ent=0.0)
    n = len(values)
    s = float(sum(values))
    mean = s / n
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
    if s == 0:
        ent = 0.0
    else:
        ps = [v / s for v in values]
        ent = -sum(p * math.log(p) for p in ps if p > 0) if all(p >= 0 for p in ps) else float("-inf")
    return dict(avg=mean, min=float(min(values)), max=float(max(values)), sum=s, std=std, ent=ent)


def tx_features(edges):
    out = {}
    nodes = {s for s, *_ in edges} | {t for _, t, *_ in edges}
    for n in nodes:
        tin = [(ts, a) for s, t, ts, a in edges if t == n]
        tout = [(ts, a) for s, t, ts, a in edges if s == n]
        tall = [(ts, a) for s, t, ts, a in edges if s == n or t == n]
        row = {"degree": len(tall), "in_degree": len(tin), "out_degree": len(tout)}
        for name, lst in (("in", tin), ("out", tout), ("all", tall)):
            for k, v in six([a for _, a in lst]).items():
                row[f"{k}_amount_{name}_tx"] = v
            ts = sorted(t for t, _ in lst)
            gaps = [(ts[i + 1] - ts[i]) / 60.0 for i in range(len(ts) - 1)]
            for k, v in six(gaps).items():
                row[f"{k}_{name}_tx_interval"] = v
        out[n] = row
    return out


def egonet(edges, variant="multi"):
    """Egonet features by explicit induced subgraphs (out-directed N[u])."""
    if variant == "multi":
        E = [(s, t, a) for s, t, _, a in edges]
    else:
        E = [(s, t, 1.0) for s, t in sorted({(s, t) for s, t, *_ in edges})]
    nodes = {s for s, *_ in E} | {t for _, t, *_ in E}
    din, dout = defaultdict(int), defaultdict(int)
    for s, t, _ in E:
        dout[s] += 1
        din[t] += 1
    res = {}
    for u in nodes:
        N = {u} | {t for s, t, _ in E if s == u}
        ego = [(s, t, a) for s, t, a in E if s in N and t in N]
        ein, eout, win = defaultdict(int), defaultdict(int), defaultdict(float)
        for s, t, a in ego:
            eout[s] += 1
            ein[t] += 1
            win[s] += a
            win[t] += a
        nb = [v for v in N if v != u]
        row = {"no_edge_within_egonet": len(ego)}
        if variant == "multi":
            row["no_edge_in_egonet"] = sum(din[v] - ein[v] for v in nb)
            row["no_edge_out_egonet"] = sum(dout[v] - eout[v] for v in nb)
        else:
            row["no_edge_in_egonet"] = len(nb) * (din[u] - ein[u])
            row["no_edge_out_egonet"] = len(nb) * (dout[u] - eout[u])
            row["degree"], row["in_degree"], row["out_degree"] = din[u] + dout[u], din[u], dout[u]
        row["no_edge_all_egonet"] = row["no_edge_in_egonet"] + row["no_edge_out_egonet"]
        lists = {"neighbor_degree": [ein[v] + eout[v] for v in nb],
                 "neighbor_in_degree": [ein[v] for v in nb], "neighbor_out_degree": [eout[v] for v in nb]}
        if variant == "multi":
            lists["neighbor_w_degree"] = [win[v] for v in nb]
        for name, lst in lists.items():
            for k, v in six(lst).items():
                row[f"{k}_{name}"] = v
        res[u] = row
    return res


def bfs(edges, root, k):
    succ = defaultdict(set)
    for s, t, *_ in edges:
        succ[s].add(t)
    dist = {root: 0}
    frontier = [root]
    for layer in range(1, k + 1):
        nxt = []
        for x in frontier:
            for y in sorted(succ[x]):
                if y not in dist:
                    dist[y] = layer
                    nxt.append(y)
        frontier = nxt
    return dist


def auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    tot = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))
