"""Adaptive probe retrieval, replayed over ranks.

Every probe is retrieved once at the greatest depth; the schedule of rounds is then replayed over the
ranks, per query. A query's probes (at most a dozen or so) and their hits (at most max_depth each) fit
one task. Ties between probes go to their order.

Input rows: query_id, ord, channel, evidence, rank.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "query_id long, ord int, rounds int, depth int, total_novel int, stopped string"


@dataclass
class Probe:
    ord: int
    channel: str
    hits: list = field(default_factory=list)
    rounds: int = 0
    depth: int = 0
    last: int = 0
    novel: int = 0
    stopped: str = ""

    def advance(self, depth: int, seen: set) -> None:
        fresh = {e for e, r in self.hits if r <= depth} - seen
        seen |= fresh
        self.rounds, self.depth, self.last, self.novel = self.rounds + 1, depth, len(fresh), self.novel + len(fresh)

    def rate(self) -> float:
        """New evidence of the last round to the hits it had."""
        had = len({e for e, r in self.hits if r <= self.depth})
        return self.last / had if had else 0.0

    def over(self, target: int, most: int) -> str:
        tests = ((self.novel >= target, "target reached"), (self.depth >= most, "max depth"), (self.last == 0, "no marginal novel evidence"), (self.rate() < 0.1, "low novelty rate"))
        return next((why for yes, why in tests if yes), "")


def replay(probes: list[Probe], depth: int = 30, target: int = 8, most: int = 120, active: int = 3) -> list[Probe]:
    seen: set = set()
    dry = 0
    for p in probes:
        if p.channel == "semantic" and dry >= 2:
            p.stopped = "global pool saturation"
            continue
        p.advance(depth, seen)
        if p.channel == "semantic":
            dry = 0 if p.last else dry + 1
    running = [p for p in probes if p.rounds]
    while running:
        for p in running:
            p.stopped = p.over(target, most)
        open_ = sorted((p for p in running if not p.stopped), key=lambda p: (-p.novel, -p.rate(), p.ord))
        for p in open_[active:]:
            p.stopped = "not expanded by scheduler budget"
        running = open_[:active]
        for p in running:
            p.advance(min(most, p.depth * 2), seen)
    return probes


def schedule(hits: DataFrame, **limits) -> DataFrame:
    """(query_id, ord, rounds, depth, total_novel, stopped) of each probe."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        probes = []
        for (o, channel), own in f.sort_values(["ord", "rank"]).groupby(["ord", "channel"], sort=True):
            own = own[own["evidence"].notna()]
            probes.append(Probe(int(o), channel, list(zip(own["evidence"], own["rank"]))))
        done = replay(probes, **limits)
        return pd.DataFrame([(f["query_id"].iloc[0], p.ord, p.rounds, p.depth, p.novel, p.stopped) for p in done], columns=["query_id", "ord", "rounds", "depth", "total_novel", "stopped"])

    return hits.groupBy("query_id").applyInPandas(run, SCHEMA)
