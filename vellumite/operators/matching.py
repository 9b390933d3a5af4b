"""One-to-one matchings. They depend on the order of choices, so each page or document is one group of a grouped map.

A group holds the boxes of one page. That bounds it in practice; groups are never mixed, and nothing is dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

MATCHES = "left_id string, right_id string, score double"


def maximum_matching(neighbours: dict, order: list) -> dict:
    """Left of each matched right: as many pairs as there can be (augmenting paths, without recursion)."""
    taken: dict = {}
    for start in order:
        # depth-first search along alternating paths; each frame is a left and what is left of its neighbours
        stack, seen, path = [(start, iter(neighbours.get(start, ())))], set(), []
        while stack:
            left, rest = stack[-1]
            right = next((r for r in rest if r not in seen), None)
            if right is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            seen.add(right)
            path.append((left, right))
            if right not in taken:
                for x, r in path:
                    taken[r] = x
                break
            stack.append((taken[right], iter(neighbours.get(taken[right], ()))))
    return taken


def optimal_assignment(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Rows and columns of the assignment with the greatest sum (Hungarian method with potentials), rectangular too."""
    if not weight or not weight[0]:
        return []
    flipped = len(weight) > len(weight[0])
    w = [list(r) for r in zip(*weight, strict=True)] if flipped else weight
    n, m = len(w), len(w[0])
    inf = float("inf")
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, via, used = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -w[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], via[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[via[j0]]
            j0 = via[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def first_fit(lefts: list, rights: list, fits) -> list[tuple[int, int]]:
    """Each left takes the first right that fits and is free."""
    free, out = list(range(len(rights))), []
    for i, x in enumerate(lefts):
        j = next((j for j in free if fits(x, rights[j])), None)
        if j is not None:
            free.remove(j)
            out.append((i, j))
    return out


def _grouped(candidates: DataFrame, keys: list[str], solve) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.select(*keys).schema) + ", " + MATCHES

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = solve(pdf)
        out = pd.DataFrame(rows, columns=["left_id", "right_id", "score"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return candidates.groupBy(*keys).applyInPandas(run, schema)


def match_most(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates(keys, left_id, right_id, score): a maximum-cardinality matching of each group.

    Lefts are served in the order of their ids, each trying its rights by falling score, then by id."""

    def solve(pdf):
        scores = {(a, b): s for a, b, s in zip(pdf.left_id, pdf.right_id, pdf.score, strict=True)}
        near: dict = {}
        for (a, b), s in scores.items():
            near.setdefault(a, []).append((-s, b))
        near = {a: [b for _, b in sorted(bs)] for a, bs in near.items()}
        return [(a, b, scores[a, b]) for b, a in sorted(maximum_matching(near, sorted(near)).items())]

    return _grouped(candidates, keys, solve)


def match_best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The matching with the most pairs and, among these, the greatest summed score."""

    def solve(pdf):
        lefts, rights = sorted(set(pdf.left_id)), sorted(set(pdf.right_id))
        bonus = min(len(lefts), len(rights)) + 1.0  # one pair more outweighs all scores, which are 1 at most
        w = [[0.0] * len(rights) for _ in lefts]
        scores = {}
        for a, b, s in zip(pdf.left_id, pdf.right_id, pdf.score, strict=True):
            w[lefts.index(a)][rights.index(b)] = bonus + s
            scores[a, b] = s
        return [(lefts[i], rights[j], scores[lefts[i], rights[j]]) for i, j in optimal_assignment(w) if w[i][j] > 0]

    return _grouped(candidates, keys, solve)


def match_first(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Each left, in the order of ids, takes the first free right of its candidates."""

    def solve(pdf):
        near: dict = {}
        for a, b, s in sorted(zip(pdf.left_id, pdf.right_id, pdf.score, strict=True)):
            near.setdefault(a, []).append((b, s))
        taken, out = set(), []
        for a, bs in near.items():
            hit = next(((b, s) for b, s in bs if b not in taken), None)
            if hit:
                taken.add(hit[0])
                out.append((a, *hit))
        return out

    return _grouped(candidates, keys, solve)
