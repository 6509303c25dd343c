"""Co-contribution graph of repositories: edges, degrees, components, modularity, communities."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


#: Events that make someone a contributor.
CONTRIBUTIONS = ("PushEvent", "PullRequestEvent", "IssuesEvent")


def edges(events: DataFrame, min_weight: int = 2, least_repos: int = 2, most_repos: int = 50, most_events: int | None = None) -> DataFrame:
    """(src, dst, weight), src < dst: people that contributed to both. People with fewer or more repositories make no pairs. most_events looks at the earliest so many events only."""
    if most_events is not None:
        events = events.orderBy("created_at", "event_id").limit(most_events)
    pairs = events.where(~F.col("is_bot") & F.col("event_type").isin(*CONTRIBUTIONS)).select(F.col("actor_login").alias("actor"), F.concat("repo_owner", F.lit("/"), "repo").alias("repo")).distinct()
    fit = pairs.groupBy("actor").agg(F.count("*").alias("n")).where(F.col("n").between(least_repos, most_repos)).select("actor")
    pairs = pairs.join(fit, "actor", "left_semi")
    both = pairs.select("actor", F.col("repo").alias("src")).join(pairs.select("actor", F.col("repo").alias("dst")), "actor").where("src < dst")
    return both.groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def degrees(edge: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    ends = edge.select(F.col("src").alias("node"), "weight").unionByName(edge.select(F.col("dst").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def components(edge: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. Labels jump to the label of their label, so rounds grow with the log of the distance."""
    edge = staged(edge.select("src", "dst"), "edges")
    both = edge.unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    label = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("component").alias("seen"))
        step = label.join(near, label["node"] == near["src"]).select("node", F.least("component", "seen").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        fresh = staged(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if fresh.join(label, ["node", "component"], "left_anti").isEmpty():
            return fresh
        label = fresh


def modularity(edge: DataFrame, label: DataFrame, name: str = "component") -> DataFrame:
    """One row: Q = sum over groups of inner / m - (strength / 2m)^2."""
    a, b = label.select(F.col("node").alias("src"), F.col(name).alias("_a")), label.select(F.col("node").alias("dst"), F.col(name).alias("_b"))
    inner = edge.join(a, "src").join(b, "dst").where("_a = _b").groupBy(F.col("_a").alias(name)).agg(F.sum("weight").alias("_in"))
    strength = degrees(edge).join(label, "node").groupBy(name).agg(F.sum("strength").alias("_d"))
    whole = edge.agg(F.sum("weight").alias("_m"))
    each = strength.join(inner, name, "left").crossJoin(F.broadcast(whole))
    q = F.coalesce("_in", F.lit(0)) / F.col("_m") - F.pow(F.col("_d") / (2 * F.col("_m")), F.lit(2.0))
    return each.agg(F.count("*").alias("groups"), F.round(F.sum(q), 6).alias("modularity"))


def top_subgraph(edge: DataFrame, most: int = 30) -> DataFrame:
    """Edges among the nodes of highest degree (ties by name)."""
    top = degrees(edge).orderBy(F.desc("degree"), "node").limit(most).select("node")
    return edge.join(top.select(F.col("node").alias("src")), "src", "left_semi").join(top.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


def plot_edges(edge: DataFrame, most: int = 50) -> DataFrame:
    """The subgraph of the nodes of highest degree; where none of them are linked, the heaviest edges instead."""
    top = top_subgraph(edge, most)
    return edge.select("src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst").limit(most) if top.isEmpty() else top


def plot_nodes(edge: DataFrame, most: int = 50) -> DataFrame:
    """Nodes of highest degree with a size on a log scale and a label."""
    top = degrees(edge).orderBy(F.desc("degree"), "node").limit(most)
    return top.select("node", "degree", F.round(F.log1p("degree"), 6).alias("size"), F.format_string("%s (%d)", "node", "degree").alias("label"))


def louvain_of(links: list[tuple[str, str, float]], whole: float) -> dict[str, str]:
    """Communities of one connected graph by greedy local moves and aggregation; deterministic in the order of names."""
    near: dict[str, dict[str, float]] = {}
    for a, b, w in links:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
    member = {n: n for n in near}
    while True:
        strength = {n: sum(x.values()) + x.get(n, 0) for n, x in near.items()}
        own, total = {n: n for n in near}, dict(strength)
        moved, again = False, True
        while again:
            again = False
            for n in sorted(near):
                home = own[n]
                total[home] -= strength[n]
                gains: dict[str, float] = {home: 0.0}
                for other, w in near[n].items():
                    if other != n:
                        gains[own[other]] = gains.get(own[other], 0.0) + w
                best = max(sorted(gains), key=lambda c: (round(gains[c] - strength[n] * total.get(c, 0) / (2 * whole), 12), c == home))  # noqa: B023
                total[best] = total.get(best, 0) + strength[n]
                if best != home:
                    own[n], moved, again = best, True, True
        if not moved:
            break
        member = {n: own[c] for n, c in member.items()}
        merged: dict[str, dict[str, float]] = {}
        for a, x in near.items():
            for b, w in x.items():
                ca, cb = own[a], own[b]
                row = merged.setdefault(ca, {})
                row[cb] = row.get(cb, 0) + (w / 2 if ca == cb and a != b else w)
        near = merged
    least: dict[str, str] = {}
    for n, c in member.items():
        least[c] = min(least.get(c, n), n)
    return {n: least[c] for n, c in member.items()}


def louvain(edge: DataFrame) -> DataFrame:
    """(node, community): communities never span components, so each component is one task's work."""
    whole = float(edge.agg(F.sum("weight").cast("double")).first()[0] or 0.0)
    parts = components(edge)
    rows = edge.join(parts.withColumnRenamed("node", "src"), "src")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = louvain_of(list(zip(group["src"], group["dst"], group["weight"].astype(float), strict=True)), whole)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    return rows.groupBy("component").applyInPandas(run, "node string, community string")


def betweenness(near: dict[str, set[str]]) -> dict[tuple[str, str], float]:
    """Shortest-path betweenness of edges (each path once)."""
    out: dict[tuple[str, str], float] = {}
    for source in near:
        paths, dist, order, before = {source: 1.0}, {source: 0}, [], {n: [] for n in near}
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before[w].append(v)
        part = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share = paths[v] / paths[w] * (1 + part[w])
                out[min(v, w), max(v, w)] = out.get((min(v, w), max(v, w)), 0.0) + share / 2
                part[v] += share
    return out


def girvan_newman(links: list[tuple[str, str]], splits: int = 2) -> list[list[set[str]]]:
    """The partitions after each of the first splits of a small graph; the edge of highest betweenness goes, ties by name."""
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def parts() -> list[set[str]]:
        left, found = set(near), []
        while left:
            stack, own = [min(left)], set()
            while stack:
                n = stack.pop()
                if n not in own:
                    own.add(n)
                    stack.extend(near[n] - own)
            left -= own
            found.append(own)
        return sorted(found, key=min)

    out, count = [], len(parts())
    while len(out) < splits:
        scores = betweenness(near)
        if not scores:
            break
        a, b = min(scores, key=lambda e: (-round(scores[e], 9), e))
        near[a].discard(b)
        near[b].discard(a)
        now = parts()
        if len(now) > count:
            out.append(now)
            count = len(now)
    return out


def girvan_newman_top(edge: DataFrame, most: int = 30, splits: int = 2) -> DataFrame:
    """(split, node, part) on the largest component among the `most` nodes of highest degree: a graph of bounded size."""
    spark = edge.sparkSession
    links = [(r.src, r.dst) for r in top_subgraph(edge, most).collect()]
    whole = girvan_newman(links, 0) if not links else None
    if whole is None:
        near: dict[str, str] = {}

        def root(n):
            while near.setdefault(n, n) != n:
                n = near[n]
            return n

        for a, b in links:
            x, y = sorted((root(a), root(b)))
            near[y] = x
        sizes: dict[str, int] = {}
        for n in list(near):
            sizes[root(n)] = sizes.get(root(n), 0) + 1
        largest = min(sizes, key=lambda r: (-sizes[r], r))
        links = [(a, b) for a, b in links if root(a) == largest]
    rows = [(i + 1, n, min(part)) for i, parts in enumerate(girvan_newman(links, splits)) for part in parts for n in sorted(part)]
    return spark.createDataFrame(rows, "split int, node string, part string")
