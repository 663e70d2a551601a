"""Clusters and diverse selection: the order-dependent steps, run per query over its bounded candidates.

Input rows: query_id, card_id, rank, score, author, document, section, tag, terms (array), q_terms (array).
A query's candidates are at most the retrieval limit (50), so a group always fits one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

JOIN_AT = 0.22
BALANCE = 0.75
CLUSTERS = "query_id long, cluster int, confidence double, thesis string, card_id long, card_order int"
SELECTED = "query_id long, pick int, card_id long, cluster int, mmr double"


def similarity(a: dict, b: dict) -> float:
    """Jaccard of terms, plus .15 same author, .1 same document, .18 same section with a shared phrase; at most 1."""
    x, y = a["terms"], b["terms"]
    if not x or not y:
        return 0.0
    same = lambda k: (a[k] or "") == (b[k] or "")
    shared = same("section") and any("_" in t for t in x & y)
    return min(1.0, len(x & y) / len(x | y) + 0.15 * same("author") + 0.1 * same("document") + 0.18 * shared)


def _confidence(own: list[dict], query: set[str]) -> float:
    best = sorted((c["score"] for c in own), reverse=True)[:3]
    spread = 0.02 * (len({c["author"] or "" for c in own}) + len({c["document"] or "" for c in own}) - 2)
    covered = len(query & set().union(*(c["terms"] for c in own))) / len(query) if query else 0.0
    return round(min(1.0, sum(best) / len(best) + min(0.12, 0.035 * (len(own) - 1)) + min(0.08, spread) + min(0.22, 0.22 * covered)), 3)


def _groups(f: pd.DataFrame) -> list[tuple[float, list[dict]]]:
    """Greedy first-fit clusters in rank order, the most confident first."""
    f = f.sort_values("rank")
    query = set(f["q_terms"].iloc[0])
    rows = [{**r, "terms": set(r["terms"]), "score": float(r["score"])} for r in f.astype(object).where(f.notna(), None).to_dict("records")]
    groups: list[list[dict]] = []
    for c in rows:
        home = next((g for g in groups if max(similarity(c, o) for o in g) >= JOIN_AT), None)
        if home is None:
            groups.append([c])
        else:
            home.append(c)
    ranked = [(_confidence(g, query), sorted(g, key=lambda c: -c["score"])) for g in groups]
    return sorted(ranked, key=lambda x: -x[0])


def _clusters(f: pd.DataFrame) -> pd.DataFrame:
    out = []
    for k, (confidence, own) in enumerate(_groups(f)):
        thesis = next((c["tag"].strip() for c in own if (c["tag"] or "").strip()), "Retrieved evidence supports a related response.")
        out += [(own[0]["query_id"], k, confidence, thesis, c["card_id"], i) for i, c in enumerate(own)]
    return pd.DataFrame(out, columns=[x.split()[0] for x in CLUSTERS.split(", ")])


def _select(f: pd.DataFrame, limit: int) -> pd.DataFrame:
    left = [(c, confidence, k) for k, (confidence, own) in enumerate(_groups(f)) for c in own]
    picked: list[tuple] = []
    while left and len(picked) < limit:
        worth = [BALANCE * (0.6 * c["score"] + 0.4 * s) - (1 - BALANCE) * max((similarity(c, p[0]) for p in picked), default=0.0) for c, s, _ in left]
        i = max(range(len(left)), key=worth.__getitem__)
        picked.append((left[i][0], left[i][2], round(worth[i], 6)))
        left.pop(i)
    return pd.DataFrame([(c["query_id"], n, c["card_id"], k, w) for n, (c, k, w) in enumerate(picked, 1)], columns=[x.split()[0] for x in SELECTED.split(", ")])


def clusters(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("query_id").applyInPandas(_clusters, CLUSTERS)


def select_diverse(candidates: DataFrame, limit: int = 5) -> DataFrame:
    return candidates.groupBy("query_id").applyInPandas(lambda f: _select(f, limit), SELECTED)
