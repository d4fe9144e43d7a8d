import numpy as np

from weft.llm.components import components


def brute(links):
    comp = {x: x for ab in links for x in ab}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return set(comp.items())


def test_stars_chains_and_random_links(spark):
    rng = np.random.default_rng(0)
    star = [(1000, 1001 + k) for k in range(300)]
    chain = [(2000 + k, 2001 + k) for k in range(60)]
    loose = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2)) if a != b]
    links = star + chain + loose + [(-5, 3), (3, -5)]
    df = spark.createDataFrame([*links, (7, 7), (None, 1), (9, None)], "x long, y long")
    assert {tuple(r) for r in components(df, "x", "y").collect()} == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
