import random

import numpy as np
from pyspark.sql import functions as F

from claimloom.operators import graph, pair_blocks, synthesis

COLUMNS = ("claim_id string, source_version_id string, statement string, claim_type string, evidence array<string>, "
           "entities array<string>, schemas array<string>, relations array<string>, subjects array<string>")


def test_overlaps_of_rare_and_frequent_values(monkeypatch):
    monkeypatch.setattr(pair_blocks, "FREQUENT", 20)
    monkeypatch.setattr(pair_blocks, "COLUMNS", 3)
    rng = random.Random(1)
    sets = [[set(rng.choices([*range(5), *range(100, 160)], k=rng.randint(0, 9))) for _ in range(n)] for n in (17, 9)]
    sides = [(np.array([i for i, s in enumerate(rows) for _ in s], int), np.array([v for s in rows for v in s], int)) for rows in sets]
    got = pair_blocks.overlaps(*sides, 17, 9)
    assert got.tolist() == [[len(a & b) for b in sets[1]] for a in sets[0]]


def test_a_pair_at_the_rounded_threshold_is_kept(spark):
    """A token Jaccard of 23/42 makes .5495, which rounds to .55 but is below the prefix filter's .55."""
    words = lambda a, b: " ".join(f"word{k:02}" for k in range(a, b))
    rows = [("a", "v1", words(0, 32), "fact", [], ["e"], ["s"], [], []), ("b", "v2", words(9, 42), "metric", [], ["e"], ["s"], [], [])]
    got = graph.connections(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.from_id, r.to_id, r.confidence) for r in got] == [("a", "b", 0.55)]


def test_work_of_a_key_grows_with_its_rows_alone(spark):
    """Rows that share all tokens meet once a pair in the blocks, however many tokens they share."""
    words = " ".join(f"word{k:02}" for k in range(60))
    rows = [(f"c{i:02}", f"v{i}", f"{words} own{i:02}", "fact", [], ["e"], ["s"], [], []) for i in range(30)]
    features = graph.connection_features(spark.createDataFrame(rows, COLUMNS))
    assert graph.strong_pairs(features).count() == 0 and graph.grounded_pairs(features, 0.55).count() == 30 * 29 // 2
    assert not hasattr(graph, "candidate_pairs")


def test_conflicts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"c{i:02}", f"v{i}", " ".join([*rng.choices([f"word{k}" for k in range(9)], k=rng.randint(1, 6)), rng.choice(["approved", "blocked", ""])]), "fact", [], [], [], [], [])
            for i in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    bag = {r[0]: set(r[2].split()) for r in rows}
    near = lambda a, b: len(bag[a] & bag[b]) / len(bag[a] | bag[b]) >= 0.35
    opposed = lambda a, b: {"approved", "blocked"} <= bag[a] | bag[b] and bag[a] & {"approved", "blocked"} and bag[b] & {"approved", "blocked"}
    expected = {(a, b) for a in bag for b in bag if a < b and opposed(a, b) and near(a, b)}
    assert {(r.left_id, r.right_id) for r in graph.conflicts(df).collect()} == expected and expected


def test_cohesion_on_a_rounding_tie_is_the_same_for_any_partitions(spark):
    """39 members of .7 and nine links of 5.151 in all: .6760625 but for the sum of doubles, which SQL adds one after another."""
    members = [("k", f"c{i:02}", 0.7) for i in range(39)]
    links = [(f"c{i:02}", f"c{i + 1:02}", c, "supports") for i, c in enumerate([0.551, 0.552, 0.553, 0.571, 0.572, 0.573, 0.593, 0.593, 0.593])]
    claims = spark.createDataFrame([(c, i, 1, "fact", False) for i, (_, c, _) in enumerate(members)], "claim_id string, doc_id long, n_evidence int, claim_type string, confirmed boolean")
    total = 0.0
    for _ in members:
        total += 0.7
    for parts in (1, 3, 7):
        df = spark.createDataFrame(members, "cluster_key string, claim_id string, score double").repartition(parts)
        found = spark.createDataFrame(links, "from_id string, to_id string, confidence double, connection_type string").repartition(parts)
        (row,) = synthesis.opportunity_breakdown(df, claims, found).collect()
        assert row.cohesion == (5.151 + total) / 48 and round(row.cohesion, 6) == 0.676062


def test_pairs_of_several_keys_and_tiles_come_once(spark, monkeypatch):
    """Claims with several entities, some of them strong pairs: each pair once, without grouping, and equal to a comparison of all."""
    rng = random.Random(3)
    some = lambda values: rng.sample(values, rng.randint(1, len(values)))
    rows = [(f"c{i:02}", f"v{rng.randint(0, 30)}", " ".join(rng.sample([f"word{k}" for k in range(8)], 6)), rng.choice(["fact", "risk", "dependency"]), [f"s{rng.randint(0, 40)}"],
             some(["e1", "e2", "e3"]), some(["p", "q"]), [], []) for i in range(40)]
    df = spark.createDataFrame(rows, COLUMNS)
    whole = {(r.from_id, r.to_id): r.confidence for r in graph.connections(df).collect()}
    features = graph.connection_features(df)
    every = features.select(F.col("claim_id").alias("left_id")).crossJoin(features.select(F.col("claim_id").alias("right_id"))).where("left_id < right_id")
    expected = {(r.from_id, r.to_id): r.confidence for r in graph.score_pairs(every, features).where("confidence >= 0.55").collect()}
    assert whole == expected and len(expected) > 50
    monkeypatch.setattr(pair_blocks, "BLOCK", 5)
    monkeypatch.setattr(pair_blocks, "MOST_ROWS", 9)
    found = graph.connections(df.withColumn("own", F.upper("claim_id")).withColumn("numbers", F.array(F.lit(1).cast("long"))), carried=("own", "numbers"))
    rows = found.collect()
    assert {(r.from_id, r.to_id): r.confidence for r in rows} == expected and len(rows) == len(expected)
    assert all((r.left_own, r.right_own, r.left_numbers) == (r.from_id.upper(), r.to_id.upper(), [1]) for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[from_id" not in plan and "HashAggregate(keys=[left_id" in plan


def test_carried_clusters_count_as_joined_members(spark):
    members = spark.createDataFrame([("k", "a", 0.9), ("k", "b", 0.9), ("l", "b", 0.7), ("l", "c", 0.7)], "cluster_key string, claim_id string, score double")
    claims = spark.createDataFrame([(c, i, 1, "fact", False) for i, c in enumerate("abc")], "claim_id string, doc_id long, n_evidence int, claim_type string, confirmed boolean")
    links = spark.createDataFrame([("a", "b", 0.6, "supports"), ("b", "c", 0.97, "duplicates"), ("a", "c", 0.7, "supports")], "from_id string, to_id string, confidence double, connection_type string")
    numbers = synthesis.cluster_numbers(members)
    carried = links
    for side, end in (("left", "from_id"), ("right", "to_id")):
        carried = carried.join(numbers.select(F.col("claim_id").alias(end), F.col("clusters").alias(f"{side}_clusters")), end)
    found = [{r.cluster_key: r for r in synthesis.opportunity_breakdown(members, claims, df).collect()} for df in (links, carried)]
    assert found[0] == found[1] and found[1]["l"].duplication == 0.5
    pairs = links.select(F.col("from_id").alias("left_id"), F.col("to_id").alias("right_id"), F.concat("from_id", "to_id").alias("conflict_id"), F.lit("open").alias("status"))
    plain = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "c")], "cluster string, claim_id string")
    at = claims.select("claim_id", F.col("doc_id").alias("created_at"))
    of = lambda c: F.when(F.col(c) == "c", "l").otherwise("k")
    with_clusters = pairs.withColumn("clusters", F.array(of("left_id"), of("right_id")))
    states = [[tuple(r) for r in graph.entity_cluster_states(plain, at, df).collect()] for df in (pairs, with_clusters)]
    assert states[0] == states[1] == [("k", 2, 1, 3), ("l", 1, 2, 2)]
    made = synthesis.link_clusters(links).select("cluster_key", "claim_id", "score", "n_members")
    empty = [F.array().cast("array<string>").alias(c) for c in ("entities", "relations", "tags", "schemas")]
    grouped = synthesis.discover_clusters(synthesis.cluster_keys(claims.select("claim_id", F.lit("").alias("statement"), *empty), links)).select(*made.columns)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, grouped.collect())) and made.count() == 6


def test_strong_pairs_in_place_equal_a_comparison_of_all(spark, monkeypatch):
    """Equal texts within and across source versions, bare texts, shared spans and relations, claims without a source version: every pair once, with all components."""
    monkeypatch.setattr(pair_blocks, "BLOCK", 4)
    monkeypatch.setattr(pair_blocks, "MOST_ROWS", 6)
    rng = random.Random(12)
    rows = [(f"c{i:02}", rng.choice([None, *[f"v{k}" for k in range(12)]]), rng.choice(["same words here", "same words, here!", "?!", "", f"own words {i}", "others of these words"]),
             rng.choice(["fact", "risk", "dependency"]), rng.sample([f"s{k}" for k in range(25)], 2), rng.sample(["e1", "e2"], 1), ["p"], rng.sample([f"r{k}" for k in range(30)], 1), []) for i in range(60)]
    features = graph.connection_features(spark.createDataFrame(rows, COLUMNS))
    share = lambda a, b: (a[1] and a[1] == b[1]) or set(a[4]) & set(b[4]) or set(a[7]) & set(b[7]) or (norm(a) and norm(a) == norm(b))
    norm = lambda r: " ".join("".join(c if c.isalnum() else " " for c in r[2].lower()).split())
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and share(a, b)]
    want = graph.score_pairs(spark.createDataFrame(pairs, "left_id string, right_id string"), features).collect()
    got = graph.scored_strong_pairs(features).collect()
    tidy = lambda found: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found)
    assert tidy(got) == tidy(want) and len(got) > 300


def test_copies_of_a_text_are_not_shuffled_as_pairs(spark):
    """300 copies make 44,850 strong pairs: no exchange sees more than the claims' own rows."""
    rows = [(f"c{i:03}", f"v{i}", "all of the same words", "fact", [f"s{i}"], ["e"], ["p"], [], []) for i in range(300)]
    found = graph.connections(spark.createDataFrame(rows, COLUMNS))
    assert found.count() == 300 * 299 // 2
    assert {(r.confidence, r.connection_type, r.tokens) for r in found.distinct().select("confidence", "connection_type", "tokens").distinct().collect()} == {(0.97, "duplicates", 1.0)}
    assert graph._pairs_of(graph._across_sources(graph.connection_features(spark.createDataFrame(rows, COLUMNS)))).count() == 0


def test_pairs_leave_a_task_tile_by_tile_and_a_block_meets_itself_once(spark, monkeypatch):
    """Neither all pairs of two blocks nor a second copy of a block that meets itself is ever held."""
    monkeypatch.setattr(pair_blocks, "BLOCK", 10)
    monkeypatch.setattr(pair_blocks, "MOST_ROWS", 40)
    df = spark.range(100).selectExpr("'k' as key", "id", "array(1L) as tokens")

    def choose(one, other, tokens):
        assert one.num_rows <= 10 and other.num_rows <= 10
        x, y = np.nonzero(one.column("id").to_numpy()[:, None] < other.column("id").to_numpy()[None, :])
        return x, y, []

    found = pair_blocks.compared(df, df, ["tokens"], choose, same=True)
    rows = found.select("left_id", "right_id").collect()
    assert len(rows) == len(set(rows)) == 100 * 99 // 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "NOT (_i" in plan


def test_a_tile_of_candidates_asks_only_for_what_beats_the_k_best_so_far(spark, monkeypatch):
    """One claim with 400 partners of one key in 40 tiles: few more than the k best leave the task, and the k best are right."""
    monkeypatch.setattr(pair_blocks, "BLOCK", 10)
    sent = spark.sparkContext.accumulator(0)
    real = graph.compared

    def counted(*args, **named):
        choose = args[3]

        def counting(*sides):
            x, y, values = choose(*sides)
            sent.add(int((np.array(sides[0].column("id").to_pylist())[x] == "a").sum()))
            return x, y, values

        return real(*args[:3], counting, *args[4:], **named)

    monkeypatch.setattr(graph, "compared", counted)
    words = [f"word{k:02}" for k in range(40)]
    rows = [("a", "v", " ".join(words), "fact", [], ["e"], ["s"], [], [])]
    rows += [(f"b{i:03}", f"v{i}", " ".join(words[: 40 - i % 39] + [f"own{i}"]), "fact", [], ["e"], ["s"], [], []) for i in range(400)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = [(r.to_id, r.place) for r in graph.connection_candidates(df, 3).where("from_id = 'a'").orderBy("place").collect()]
    assert got == [("b000", 1), ("b039", 2), ("b078", 3)]
    assert sent.value < 40 * 3


def test_conflicts_by_subjects_and_by_tokens_come_once_with_their_kinds(spark):
    """Claims with words of both kinds, in either order of ids; shared entities and subjects with few common tokens; no pair is grouped."""
    rng = random.Random(13)
    kinds = ["fact", "metric", "reported_decision", "scope_statement", "dependency"]
    rows = [(f"c{i:02}", f"v{i}", " ".join([*rng.choices([f"word{k}" for k in range(8)], k=rng.randint(1, 5)), *rng.sample(["approved", "blocked", "owner", "increase", "decrease"], rng.randint(0, 3))]),
             rng.choice(kinds), [], rng.sample(["e1", "e2", "e3", "e4"], rng.randint(0, 1)), [], [], rng.sample(["s1", "s2", "s3"], rng.randint(0, 1))) for i in range(60)]
    up, down = ({w for w in ("approved", "blocked", "owner", "increase", "decrease") if w in words} for words in (graph.POSITIVE, graph.NEGATIVE))
    expected = {}
    for a in rows:
        for b in rows:
            x, y = set(a[2].split()), set(b[2].split())
            met = set(a[5]) & set(b[5]) or set(a[8]) & set(b[8]) or len(x & y) / len(x | y) >= 0.35
            if a[0] < b[0] and met and ((x & up and y & down) or (x & down and y & up)):
                said = " ".join(sorted(x | y))
                types = {a[3], b[3]}
                expected[a[0], b[0]] = ("decision" if "reported_decision" in types or "approved" in said else "ownership" if "owner" in said else "dependency" if "dependency" in types or "blocked" in said
                                        else "metric_definition" if "metric" in types else "scope" if "scope_statement" in types else "mutual")
    found = graph.conflicts(spark.createDataFrame(rows, COLUMNS))
    got = [tuple(r) for r in found.collect()]
    assert {(a, b): k for a, b, k, _ in got} == expected and len(got) == len(expected) > 50
    assert all((s == "blocking") == (k in ("decision", "ownership", "dependency")) for _, _, k, s in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # nothing above the pairs of the blocks: neither distinct nor join
