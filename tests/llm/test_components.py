import random

from textquarry.llm.components import stars


def brute(links):
    label = {n: n for link in links for n in link}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted((n, c) for n, c in label.items() if n != c)


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(i, i + 7) for i in range(-300, -200)]
    links += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)] + [(5, 5), (7, 6), (6, 7)]
    rng.shuffle(links)
    got = sorted(tuple(r) for r in stars(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == brute(links)


def test_no_links(spark):
    assert stars(spark.createDataFrame([], "a long, b long")).collect() == []
