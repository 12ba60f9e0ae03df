"""Chains against plain following of pointers."""

import random

from claimloom.operators.chains import chain_ends, chain_paths


def follow(links):
    to = {}
    for a, b in links:
        if b is not None:
            to[a] = min(to.get(a, b), b)
    nodes = {x for link in links for x in link if x is not None}
    out = {}
    for x in nodes:
        seen, at, depth = {x}, x, 0
        while at in to:
            at, depth = to[at], depth + 1
            if at in seen:
                at = None
                break
            seen.add(at)
        out[x] = (x, at, depth if at is not None else None, at is None)
    return sorted(out.values()), to


def test_long_chains_and_cycles(spark):
    rng = random.Random(1)
    links = [(k, k - 1) for k in range(1, 1001)]  # a chain of a thousand
    links += [(2000 + k, 2000 + (k + 1) % 7) for k in range(7)] + [(2100, 2003), (2101, 2100), (2200, 2200)]  # cycles and what runs into them
    links += [(3000 + k, 3000 + rng.randint(0, k)) for k in range(1, 200)] + [(4000, None), (5000, 12), (5000, 10)]
    df = spark.createDataFrame(links, "id long, to long").repartition(4)
    want, to = follow(links)
    assert sorted(map(tuple, chain_ends(df).collect()), key=lambda r: r[0]) == want
    asked = [1000, 2101, 2200, 3150, 4000, 5000]
    paths = {}
    for x in asked:
        at, depth = x, 0
        while at in to and depth < 2000:
            at, depth = to[at], depth + 1
            if at == x or (x, at) in paths:
                break
            paths[x, at] = depth
    got = {(r.id, r.ancestor): r.depth for r in chain_paths(df, spark.createDataFrame([(x,) for x in asked], "id long")).collect()}
    assert got == paths


def test_no_links(spark):
    none = spark.createDataFrame([], "id string, to string")
    assert chain_ends(none).collect() == [] == chain_paths(none, spark.createDataFrame([("a",)], "id string")).collect()
