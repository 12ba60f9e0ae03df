import random

import corpus_pipeline
import pytest

from claimloom.llm.similar import keep_one_of_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows, k=5):
    def grams(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = {i: grams(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in sets}


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choices(words, k=12))
    out = [None, "", " \n", "one", "One", "two words"]
    for n in range(12):
        base = rng.choices(words, k=rng.randint(40, 300))
        out.append(" ".join(base) + (" " + common if n % 2 else ""))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    base = rng.choices(words, k=200)  # copies that are each near to the first, but not all to each other
    for n in range(40):
        copy = list(base)
        for at in rng.sample(range(200), 4 if n else 0):
            copy[at] = f"n{n}x{at}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("pair_limit", [2, 32])
def test_groups_match_brute_force(spark, pair_limit):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in keep_one_of_similar(df, pair_limit=pair_limit).collect()}
    assert kept == brute_kept(rows)
    assert len(kept) < len(rows)


def test_stage_drops_copies_with_a_few_changed_words(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    copy = list(base)
    for at in (30, 120, 200, 260):
        copy[at] = f"changed{at}"
    other = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate((base, copy, other))], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {0, 2}


def test_equal_rows_and_rows_without_key(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(3, text + " more"), (2, text), (2, text), (7, "other text entirely here"), (None, text), (None, "lonely words of one two")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or -1, r.text) for r in keep_one_of_similar(df).collect())
    assert got == sorted([(2, text), (7, rows[3][1]), (-1, rows[5][1])])
    assert keep_one_of_similar(df).columns == df.columns and keep_one_of_similar(df.limit(0)).count() == 0
