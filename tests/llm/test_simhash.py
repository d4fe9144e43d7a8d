import re

import numpy as np
import pytest
import xxhash

from weft.llm import simhash


def brute(rows):
    """Fingerprints and components by the rule, pair by pair."""
    fps = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return {(i, f"{fps[i]:016x}", comp[i]) for i in fps}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choice(words, 200))) for i in range(40)]
    for i in range(40, 120):
        near = rows[rng.integers(0, 40)][1].split()
        near[rng.integers(0, 200)] = "Ünlike"
        rows.append((i, "\t".join(near)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "a b c"), (206, rows[0][1]), (207, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as fp", "doc_id as id", "1 as component")
    out = simhash.near_duplicates(df).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0')", "component_id")
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_tiles_give_the_same_sets(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 5)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 60, (60, 2))})
    df = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, id long")
    from weft.llm.components import components

    one, many = ({tuple(r) for r in components(simhash.near_links(df, 4, tile), "a", "b").collect()} for tile in (1 << 18, 16))
    assert one == many and one


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_bit_planes_equal_popcounts(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(-(2**63), 2**63 - 1, 300)
    fps[100:] = fps[rng.integers(0, 100, 200)]
    for k in range(100, 300):
        for b in rng.integers(0, 62, rng.integers(0, 8)):
            fps[k] ^= 1 << int(b)
    groups = np.sort(rng.integers(0, 9, 300))
    got = simhash.linked(fps, groups, radius)
    want = np.arange(300)
    for _ in range(300):
        before = want.copy()
        for i in range(300):
            near = (groups == groups[i]) & (np.bitwise_count((fps ^ fps[i]).view(np.uint64)) <= radius)
            want[i] = want[near].min()
        if (before == want).all():
            break
    assert (got == want).all()


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b"), (None, None), (5, "x y z"), (5, "other words stand here"), (9, "other words stand here")]
    out = {tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()}
    assert out == {(None, None), (5, 5), (9, 5)}
    kept = simhash.stage(spark, spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string"), "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]
