import random

from quaymark.llm.components import components


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    pick = lambda n, k: [(rng.randrange(n), rng.randrange(n)) for _ in range(k)]
    path = rng.sample(range(300), 121)
    odd = list(zip(path, path[1:], strict=False)) + [(299, x) for x in range(150, 250)] + [(None, 3), (5, 5), (7, 8), (8, 7)]
    for links in ([], pick(60, 40), pick(200, 150), odd):
        got = components(spark.createDataFrame(links, "u long, v long")).collect()
        assert sorted(map(tuple, got)) == brute(links)
