import random
from collections import Counter

from claimloom.llm.decontaminate import (
    MIN_STRIDE, Index, decontaminate, find_leaks, impacts, leaks, length_class, question_and_answer, words_in,
)

WORDS = ["the", "of", "and", "in", "é"] * 8 + [f"term{i}" for i in range(400)]


def setting(seed=1, n=120):
    rng = random.Random(seed)
    items = [
        (i, " ".join(rng.choices(WORDS, k=rng.randint(6, 40))).capitalize() + ". " + " ".join(rng.choices(WORDS, k=8)) + ".")
        for i in range(n)
    ]
    return rng, items


def index_of(items, threshold):
    """An index of items of one class, with statistics counted here."""
    counts = [(i, text, Counter(words_in(text))) for i, text in items]
    df = Counter(t for _, _, c in counts for t in c)
    mean = sum(c.total() for _, _, c in counts) / len(counts)
    rows = [(i, text, impacts([(t, f, df[t]) for t, f in c.items()], len(counts), mean)) for i, text, c in counts]
    return Index(rows, MIN_STRIDE << max(length_class(c.total()) for _, _, c in counts), threshold)


def brute_scores(index, terms):
    scores = {}
    for t in set(terms):
        for item, x in zip(*index.postings[t]):
            scores[item] = scores.get(item, 0.0) + x
    return {i: s for i, s in scores.items() if s >= index.threshold - 1e-9}


def test_wand_retrieves_all_above_threshold():
    rng, items = setting()
    for threshold in (0.1, 0.3, 0.6):
        index = index_of(items, threshold)
        for _ in range(150):
            terms = [index.vocabulary[w] for w in rng.choices(WORDS, k=rng.randint(1, 120)) if w in index.vocabulary]
            if rng.random() < 0.5:
                terms += [index.vocabulary[w] for w in words_in(rng.choice(items)[1])]
            got = dict(index.search(terms))
            expected = brute_scores(index, terms)
            assert got.keys() == expected.keys()
            assert all(abs(got[i] - s) < 1e-9 for i, s in expected.items())


def test_leaks_match_brute_force():
    rng, items = setting(2)
    index = index_of(items, 0.4)
    texts = [None, "", "   "]
    for _ in range(60):
        words = rng.choices(WORDS, k=rng.choice([3, 50, 400, 3000]))
        if rng.random() < 0.6:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(items)[1].upper().split()
        texts.append(rng.choice([" ", "\n"]).join(words))
    got = leaks([index], texts)
    for text, own in zip(texts, got, strict=True):
        words, expected = words_in(text or ""), set()
        for start in range(0, max(1, len(words)), index.stride):
            part = words[start : start + 2 * index.stride]
            for item in brute_scores(index, [index.vocabulary[w] for w in part if w in index.vocabulary]):
                if min(index.verify(item, part)) >= index.overlap:
                    expected.add(items[item][0])
        assert {leak[0] for leak in own} == expected
    assert sum(map(len, got)) >= 30


def test_question_and_answer():
    assert question_and_answer("What is it? It is x.") == (["what", "is", "it"], ["it", "is", "x"])
    assert question_and_answer("a b c d") == (["a", "b", "c"], ["d"])
    assert question_and_answer("") == ([], [])


def test_operator(spark):
    rng, items = setting(3, 40)
    rows = [(1, "x " + items[5][1] + " y", "k"), (2, None, "k"), (3, "clean " * 30, "k"), (None, items[7][1], "k"), (1, "other", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    for size in (1 << 20, 900):
        got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, max_index_bytes=size).collect()}
        assert got == {(1, 5), (None, 7)}
        left = decontaminate(docs, bench, max_index_bytes=size)
        assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "other"), (2, ""), (3, "clean " * 30)]
        assert left.columns == docs.columns
    assert find_leaks(docs, bench.limit(0)).count() == 0
    assert find_leaks(docs.limit(0), bench).count() == 0


def test_long_items_and_parts(spark):
    rng, items = setting(4, 60)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(10_000)) + ". " + " ".join(rng.choices(WORDS, k=9)) + "."
    items += [(1000, long), (1001, " ".join(rng.choices(WORDS, k=300)) + ". so it is."), (5, items[5][1])]
    texts = [items[k][1] for k in range(0, 60, 7)] + ["front " * 5000 + long + " back" * 700, "y " * 333 + items[-2][1]]
    # partial copies, whose scores stand near the threshold
    texts += [" ".join(w for w in text.split() if rng.random() < 0.8) for _, text in items[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    results = [sorted(map(tuple, find_leaks(docs, bench, max_index_bytes=size).collect())) for size in (1 << 30, 4000)]
    assert results[0] == results[1]
    found = {(r[0], r[1]) for r in results[0]}
    assert {(9, 1000), (10, 1001), (0, 0)} <= found
    assert len(found) == len(results[0])


def test_clashing_columns(spark):
    rng, items = setting(3, 5)
    docs = spark.createDataFrame([(1, "t", 2, "c", [1], items[2][1]), (2, "t", 2, "c", [1], None)], "doc_id long, digest string, id int, class string, words array<int>, text string")
    bench = spark.createDataFrame([(i, t, "d", "w", "z") for i, t in items], "item_id long, text string, digest string, words string, class string")
    assert [tuple(r) for r in decontaminate(docs, bench).collect()] == [(2, "t", 2, "c", [1], None)]
