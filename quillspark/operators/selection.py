"""Choosing a small diverse set of sources for each query.

`fitness` scores given sets with DataFrame operations. `evolve` searches for a good set: one group
for each query holds its frontier of bounded size as arrays, and the search is seeded from the
query, so that reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import settled
from .staging import dealt

# Fixed values that results depend on: what each part of a set counts, and the reward weight on it.
COMPONENTS = {"relevance": 0.25, "informative": 0.20, "authority": 0.18, "coverage": 0.14, "concept_diversity": 0.13, "structure": 0.10}
REWARDED = {"relevance": "relevance", "informative": "evidenceDensity", "authority": "authority", "coverage": "coverage", "concept_diversity": "diversity", "structure": "structure"}
GAIN = {"relevance": 0.34, "informative": 0.28, "authority": 0.20, "novelty": 0.18, "overlap": 0.16}
STAGNATION, IMPROVEMENT = 4, 1e-4
#: Definitions and subtopics of a source that has all; coherence where none was measured.
WHOLE_STRUCTURE, PLAIN_COHERENCE = 8, 0.55


def parts(rewards: dict[str, float] | None) -> tuple[dict[str, float], float, float]:
    """What each component counts under the reward weights (all one by default), and the factors of
    diversity and coherence."""
    r = rewards or {}
    of = lambda w: float(r.get(w, 1.0))
    counts = {c: v * of(REWARDED[c]) for c, v in COMPONENTS.items()}
    return {c: v / (sum(counts.values()) or 1.0) for c, v in counts.items()}, 0.88 + 0.12 * of("antiRedundancy"), 0.035 * of("coherence")


def fitness(members: DataFrame, focus: DataFrame, rewards: dict[str, float] | None = None) -> DataFrame:
    """Score of each set. members: set_id, query_id, place, relevance, informative, authority, spam,
    words, concepts, and if known coherence and n_structure (definitions and subtopics); focus:
    query_id, focus; rewards: learned weights by name."""
    counts, diversity, coherence = parts(rewards)
    known = {"coherence": F.lit(PLAIN_COHERENCE), "n_structure": F.lit(0)}
    members = members.withColumns({c: v for c, v in known.items() if c not in members.columns})
    w = Window.partitionBy("set_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.flatten(F.collect_list("concepts").over(w))
    n = F.size("concepts")
    rows = members.withColumn("novelty", F.when(n > 0, 1 - F.size(F.array_intersect("concepts", seen)) / n).otherwise(0.55))
    own = rows.groupBy("set_id", "query_id").agg(
        *[F.avg(c).alias(c) for c in ("relevance", "informative", "authority", "spam", "coherence")], F.avg("novelty").alias("concept_diversity"),
        F.least(F.sum("n_structure") / (F.count(F.lit(1)) * WHOLE_STRUCTURE), F.lit(1.0)).alias("structure"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("all_words"))
    a, b = members.alias("a"), members.alias("b")
    both = F.size(F.array_intersect("a.words", "b.words")) / F.greatest(F.size(F.array_union("a.words", "b.words")), F.lit(1))
    pairs = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.place") < F.col("b.place"))).select(F.col("a.set_id").alias("set_id"), both.alias("j"))
    own = own.join(pairs.groupBy("set_id").agg(F.avg("j").alias("overlap")), "set_id", "left").join(focus, "query_id")
    own = own.withColumn("coverage", F.when(F.size("focus") > 0, F.size(F.array_intersect("all_words", "focus")) / F.size("focus")).otherwise(1.0))
    diverse = 1 - F.coalesce("overlap", F.lit(0.0))
    total = sum(F.col(c) * v for c, v in counts.items()) * (0.65 + 0.35 * diverse) * diversity + F.col("coherence") * coherence - F.col("spam") * 0.055
    shown = {c: F.col(c) for c in ("coverage", "concept_diversity")} | {"pairwise_diversity": diverse, "structure": F.col("structure"), "total": F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))}
    return own.select("set_id", "query_id", *[settled(v, 6).alias(k) for k, v in shown.items()])


class Pool:
    """The frontier of a query as arrays."""

    def __init__(self, group: pd.DataFrame, rewards: dict[str, float] | None = None):
        self.counts, self.diversity, self.coherence = parts(rewards)
        self.base = sum(group[c].to_numpy(float) * GAIN[c] for c in ("relevance", "informative", "authority"))
        plain = {"coherence": PLAIN_COHERENCE, "n_structure": 0.0}
        self.values = {c: group[c].to_numpy(float) if c in group else np.full(len(group), plain[c]) for c in ("relevance", "informative", "authority", "spam", *plain)}
        self.words = [frozenset(w) for w in group["words"]]
        self.concepts = [frozenset(c) for c in group["concepts"]]
        self.focus = frozenset(group["focus"].iloc[0])
        self.n = len(group)
        self.like = np.array([[len(a & b) / max(1, len(a | b)) for b in self.words] for a in self.words])
        self.known: dict[tuple[int, ...], float] = {}

    def gain(self, i: int, chosen: list[int]) -> float:
        """What row i adds to the chosen rows."""
        seen = frozenset().union(*(self.concepts[j] for j in chosen))
        own = self.concepts[i]
        repeated = len(own & seen) / len(own) if own else 0.25
        return float(self.base[i] + (1 - repeated) * GAIN["novelty"] - (self.like[i, chosen].max() if chosen else 0.0) * GAIN["overlap"])

    def greedy(self, size: int, rows: list[int] | None = None) -> list[int]:
        left, out = list(range(self.n)) if rows is None else list(rows), []
        while left and len(out) < size:
            best = max(left, key=lambda i: (self.gain(i, out), -i))
            out.append(best)
            left.remove(best)
        return out

    def fitness(self, chosen: list[int]) -> float:
        key = tuple(sorted(chosen))
        if key not in self.known:
            seen: frozenset[str] = frozenset()
            fresh = []
            for i in key:
                own = self.concepts[i]
                fresh.append(1 - len(own & seen) / len(own) if own else 0.55)
                seen |= own
            covered = frozenset().union(*(self.words[i] for i in key)) & self.focus
            means = {c: float(v[list(key)].mean()) for c, v in self.values.items()}
            means |= {"coverage": len(covered) / len(self.focus) if self.focus else 1.0, "concept_diversity": float(np.mean(fresh)), "structure": min(1.0, means["n_structure"] / WHOLE_STRUCTURE)}
            pairs = [self.like[a, b] for k, a in enumerate(key) for b in key[:k]]
            diverse = 0.65 + 0.35 * (1 - (float(np.mean(pairs)) if pairs else 0.0))
            total = sum(means[c] * v for c, v in self.counts.items()) * diverse * self.diversity + means["coherence"] * self.coherence - means["spam"] * 0.055
            self.known[key] = round(min(1.0, max(0.0, total)), 6)
        return self.known[key]


def target_size(n: int) -> int:
    return min(n, 6, max(3, (n + 1) // 2))


def search(pool: Pool, seed: int, generations: int, size: int) -> tuple[list[int], list[float]]:
    """A generational search with elites, tournaments of four, one-point mixing and replacement
    moves; stops after STAGNATION generations without gain. Returns the set and the best scores."""
    rng = np.random.default_rng(seed)
    k = target_size(pool.n)
    alone = sorted(range(pool.n), key=lambda i: (-pool.gain(i, []), i))
    greedy = tuple(sorted(pool.greedy(k)))
    fill = lambda rows: tuple(sorted((list(dict.fromkeys(rows)) + [int(i) for i in rng.permutation(pool.n) if i not in rows])[:k]))
    people = {greedy} | {fill(alone[o : o + k]) for o in range(min(pool.n, k + 3))}
    for c in ("authority", "informative"):
        people.add(fill([int(i) for i in np.argsort(-pool.values[c], kind="stable")[:k]]))
    tries = 0
    while len(people) < size and tries < 100:
        tries += 1
        people.add(fill([alone[int(i)] for i in rng.permutation(min(pool.n, 2 * k))[: rng.integers(1, k + 1)]]))
    history: list[float] = []
    still = 0
    for _ in range(generations):
        order = sorted(people, key=lambda p: (-pool.fitness(list(p)), p))
        best = pool.fitness(list(order[0]))
        still = 0 if not history or best > max(history) + IMPROVEMENT else still + 1
        history.append(best)
        if len(history) >= 3 and still >= STAGNATION:
            break
        pick = lambda: order[int(min(rng.integers(0, len(order), 4)))]  # noqa: B023, E731
        nxt, tries = set(order[: max(2, size // 6)]) | {greedy}, 0
        while len(nxt) < size and tries < 10 * size:
            tries += 1
            a, b, cut = pick(), pick(), int(rng.integers(0, k + 1))
            child = list(a[:cut]) + list(b[cut:])
            if rng.random() < 0.6:
                child[int(rng.integers(0, len(child)))] = int(next((i for i in alone if i not in child), child[0])) if rng.random() < 0.5 else int(rng.integers(0, pool.n))
            nxt.add(fill(child))
        people = nxt
    return list(min(people, key=lambda p: (-pool.fitness(list(p)), p))), history


def evolve(frontier: DataFrame, generations: int = 10, population: int = 30, rewards: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, place, fitness of the chosen sources. frontier: query_id, doc_id, rank, focus
    and what fitness() asks of members; rewards: learned weights by name."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        pool = Pool(group, rewards)
        most, people = (min(generations, 5), min(population, 15)) if pool.n < 10 else (min(generations, 8), min(population, 25)) if pool.n > 50 else (generations, population)
        chosen, _ = search(pool, int(group["query_id"].iloc[0]) * 31 + pool.n, most, people)
        order = pool.greedy(len(chosen), chosen)
        gains = [round(min(1.0, max(0.0, pool.gain(i, order[:n]))), 6) for n, i in enumerate(order)]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "doc_id": group["doc_id"].to_numpy()[order], "place": np.arange(1, len(order) + 1), "fitness": gains})

    return dealt(frontier, "query_id").groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, place long, fitness double")


def greedy(frontier: DataFrame) -> DataFrame:
    """query_id, doc_id, place: repeated best gain."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        pool = Pool(group)
        order = pool.greedy(target_size(pool.n))
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "doc_id": group["doc_id"].to_numpy()[order], "place": np.arange(1, len(order) + 1)})

    return dealt(frontier, "query_id").groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, place long")
