"""The level-wise flow against successive shortest paths, and its time on many overlapping patterns."""

import heapq
import math
import random
import time

from trawl.llm.mixing import min_cost_flow, water_fill


def shortest_paths(capacity, members, quota, passes):
    """(words sent, their cost), one augmenting path at a time."""
    p, s = len(capacity), len(quota)
    source, sink = p + s, p + s + 1
    graph = [[] for _ in range(p + s + 2)]

    def arc(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i in range(p):
        for k in range(passes):
            arc(source, i, capacity[i], k)
        for j in members[i]:
            arc(i, p + j, passes * capacity[i], 0)
    for j in range(s):
        arc(p + j, sink, quota[j], 0)
    sent = cost_of = 0
    while True:
        far, came, heap = [math.inf] * len(graph), {}, [(0, source)]
        far[source] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and d + cost < far[b]:
                    far[b], came[b] = d + cost, (a, k)
                    heapq.heappush(heap, (far[b], b))
        if far[sink] == math.inf:
            return sent, cost_of
        path, b = [], sink
        while b != source:
            a, k = came[b]
            path.append(graph[a][k])
            b = a
        push = min(x[1] for x in path)
        sent, cost_of = sent + push, cost_of + push * far[sink]
        for x in path:
            x[1] -= push
            graph[x[0]][x[3]][1] += push


def cost(words, capacity):
    return sum(max(0, min(w - k * c, c)) * k for w, c in zip(words, capacity, strict=True) for k in range(w // max(c, 1) + 1))


def test_equals_shortest_paths():
    r = random.Random(6)
    for _ in range(300):
        s, p, passes = r.randint(1, 5), r.randint(1, 9), r.randint(1, 3)
        capacity = [r.choice([0, 1, 5, 20, 33]) for _ in range(p)]
        members = [tuple(sorted(r.sample(range(s), r.randint(1, s)))) for _ in range(p)]
        quota = [r.choice([0, 3, 40, 200]) for _ in range(s)]
        sent = min_cost_flow(capacity, members, quota, passes)
        assert all(0 <= w <= passes * c for w, c in zip(sent, capacity, strict=True))
        assert (sum(sent), cost(sent, capacity)) == shortest_paths(capacity, members, quota, passes)


def test_twenty_thousand_overlapping_patterns_take_under_a_minute():
    r = random.Random(7)
    kinds = set()
    while len(kinds) < 20_000:
        kinds.add(tuple(sorted(r.sample(range(40), r.randint(2, 6)))))
    members, capacity = sorted(kinds), [r.randint(1, 1000) for _ in range(20_000)]
    total = sum(capacity)
    began = time.time()
    sent = min_cost_flow(capacity, members, [round(total * w) for w in [0.3, 0.2, 0.1, *[0.4 / 37] * 37]])
    assert time.time() - began < 60 and abs(sum(sent) - total) <= 40


def test_many_sources_are_filled_in_linear_rounds():
    began = time.time()
    target = water_fill([float(i % 97 + 1) for i in range(60_000)], [(5.0, 2.0, 1.0)[i % 3] for i in range(60_000)], sum(i % 97 + 1 for i in range(60_000)))
    assert time.time() - began < 10 and math.isclose(sum(target), sum(i % 97 + 1 for i in range(60_000)), rel_tol=1e-9)
