"""Plain Python version of p3_found, for the tests."""

import json


def _list(x):
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def found(rows):
    """rows: (graph_id, written_at, payload)."""
    last = {}
    for g, at, p in rows:
        if g is not None:
            k = (at is not None, at, p or "") if at is not None else (False,)
            if g not in last or k > last[g][0]:
                last[g] = (k, p)
    out = []
    for g, (_, p) in last.items():
        try:
            o = json.loads((p or "").strip().strip("﻿"))
            o = json.loads(o) if isinstance(o, str) else o
        except ValueError:
            continue
        if not isinstance(o, dict):
            continue
        nodes = o.get("nodes")
        if isinstance(nodes, dict) and not isinstance(nodes.get("finding"), str):
            nodes = [(k, v) for k, v in nodes.items()]
        else:
            nodes = [(None, v) for v in _list(nodes)]
        for name, n in nodes:
            if not isinstance(n, dict):
                continue
            f = n.get("finding") or name
            out += [(g, "anatomy", f, str(i)) for i, a in enumerate(_list(n.get("anatomy"))) if a is not None]
            c = n.get("contributions")
            if isinstance(c, dict) and not isinstance(c.get("group"), str):
                out += [(g, "contribution", f, k) for k in c]
            else:
                out += [(g, "contribution", f, x["group"]) for x in _list(c) if isinstance(x, dict) and x.get("group") is not None]
        for i, a in enumerate(_list(o.get("audit"))):
            if isinstance(a, dict):
                out.append((g, "audit", a.get("rule"), str(i)))
        for i, fu in enumerate(_list(o.get("fused"))):
            if isinstance(fu, dict):
                for j, s in enumerate(_list(fu.get("support"))):
                    if s is not None:
                        out.append((g, "support", str(i), str(j)))
                        if isinstance(s, dict):
                            out += [(g, "concept", f"{i}.{j}", str(int(c["concept_id"]))) for c in _list(s.get("contributing_concepts")) if isinstance(c, dict) and c.get("concept_id") is not None]
    return out
