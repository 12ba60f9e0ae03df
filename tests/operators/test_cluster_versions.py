"""Kept versions against rebuilt ones over random batches."""

import random

from pyspark.sql import functions as F

from claimloom.operators.cluster_versions import cluster_state, next_state, update_state

MEMBER, END = "cluster_key string, claim_id string, score double", "conflict_id string, claim_id string, status string, severity string"


def test_kept_equals_rebuilt(spark):
    rng = random.Random(3)
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema).coalesce(1)
    members: set = set()
    ends: set = set()
    state = cluster_state(frame(members, MEMBER), frame(ends, END), F.lit(0))
    changed_at: dict = {}
    for day in range(1, 11):
        before_m, before_e = set(members), set(ends)
        for row in rng.sample(sorted(members), min(len(members), rng.randint(0, 6))):
            members.discard(row)
        scores = {(r[0], r[1]) for r in members}
        for _ in range(rng.randint(0, 10)):
            key = (f"k{rng.randint(0, 7)}", f"c{rng.randint(0, 12)}")
            if key not in scores:
                scores.add(key)
                members.add((*key, rng.choice([0.5, 0.75, 0.9])))
        for row in rng.sample(sorted(ends), min(len(ends), rng.randint(0, 2))):
            ends.discard(row)
            if rng.random() < 0.5:
                ends.add((row[0], row[1], "resolved", row[3]))
        if rng.random() < 0.7:
            number = f"x{day}"
            ends |= {(number, f"c{rng.randint(0, 6)}", "open", "warning"), (number, f"c{rng.randint(7, 12)}", "open", "warning")}
        old = {r.cluster_key: r for r in state.collect()}
        updated = update_state(
            state, frame(before_m, MEMBER), frame(ends, END), frame(members - before_m, MEMBER), frame(before_m - members, MEMBER),
            frame(ends - before_e, END), frame(before_e - ends, END), F.lit(day)).collect()
        full = {r.cluster_key: r for r in cluster_state(frame(members, MEMBER), frame(ends, END), F.lit(day)).collect()}
        assert {r.cluster_key: (r.n_members, r.version) for r in updated if r.n_members} == {k: (r.n_members, r.version) for k, r in full.items()}
        size = lambda rows, k: sum(r[0] == k for r in rows)
        for r in updated:
            was, now = size(before_m, r.cluster_key) > 1, size(members, r.cluster_key) > 1
            same = r.cluster_key in old and old[r.cluster_key].version == r.version
            assert r.change == {(True, False): "superseded", (False, True): "new", (False, False): None, (True, True): "unchanged" if same else "changed"}[was, now]
            changed_at[r.cluster_key] = changed_at.get(r.cluster_key) if same else day
            assert r.last_change == changed_at[r.cluster_key]
        schema = cluster_state(frame(set(), MEMBER), frame(set(), END), F.lit(0)).schema
        state = next_state(spark.createDataFrame(updated, update_state(
            state, frame(set(), MEMBER), frame(set(), END), frame(set(), MEMBER), frame(set(), MEMBER), frame(set(), END), frame(set(), END), F.lit(day)).schema))
        changed_at = {k: v for k, v in changed_at.items() if k in {r.cluster_key for r in updated if r.n_members}}
        assert len(schema) == 6
