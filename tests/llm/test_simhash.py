import random
import re

import xxhash

from claimloom.llm.components import connected_components
from claimloom.llm.simhash import fingerprint, keep_one_of_each, links, near_duplicates, text_fingerprint


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits=2):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in parent:
        for b in parent:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in parent}


def texts():
    rng = random.Random(3)
    words = ["Ähm", "THE", "of", "ing", "née", "x", "Ωmega", "data", "model"] + [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "one", "One", "two words", "THE of", "the of"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(5, 300))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("  ".join(copy))
    return out + out[10:14]


def test_fingerprints_and_groups_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in near_duplicates(df.drop("fp")).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    groups = brute_components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[groups[p]] = min(i, least.get(groups[p], i))
    assert {i: r.component_id for i, r in got.items()} == {i: least[groups[p]] for i, p in prints.items()}
    assert {i for i, r in got.items() if r.first} == set(least.values())
    assert df.select(fingerprint(df.text)).count() == len(rows)


def test_large_groups_give_the_same_components(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(40):
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    expected = {k: v for k, v in brute_components(values).items()}
    for limit in (0, 5, 10_000):
        found = {r.node: r.component for r in connected_components(links(df, limit), "a", "b").collect()}
        assert {v: found.get(v, v) for v in values} == expected


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 2000) for i in range(200)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(301)} | {
        i: 1000 for i in [*range(1000, 1200), 2000]
    }
    assert len(got) == len({r.node for r in got})


def test_one_of_each_stays(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(3, text), (2, text), (2, text), (7, "other text entirely here"), (None, text), (None, "lonely words of one two")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, first int")
    got = sorted((r.doc_id or -1, r.text) for r in keep_one_of_each(df).collect())
    assert got == sorted([(2, text), (7, rows[3][1]), (-1, rows[5][1])])
    assert keep_one_of_each(df).columns == df.columns
    assert keep_one_of_each(df.limit(0)).count() == 0


def test_long_text_counts_all_shingles():
    body = b"a b c d " * 50_000
    assert text_fingerprint(body, 3) == text_fingerprint(b"a b c d " * 50_000 + b" ", 3)


def test_many_copies_and_clashing_columns(spark):
    """More copies than one join key may hold: every row is found once, under the least id."""
    text = "the same few words in every one of these rows"
    rows = [(5000 - i, text if i < 700 else f"{text} {i} " + " ".join(f"w{i}x{k}" for k in range(40)), "v") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _version string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert len(got) == 800 and all(got[5000 - i] == 4301 for i in range(700))
    kept = keep_one_of_each(df).collect()
    assert len(kept) == len(set(got.values())) and all(r._version == "v" for r in kept)
