"""What a document gives arises in the task that reads it: no text is shuffled."""

import random

from pyspark.sql import functions as F

from claimloom.functions.text import sums_before
from claimloom.operators import evidence, retrieval, sections, synthesis
from claimloom.plans.queries import QUERIES
from claimloom.sources import derive

FOLDER = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sums_before_are_running_sums(spark):
    lists = [[], [5], list(range(255)), list(range(256)), list(range(257)), list(range(1000))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>").select("i", sums_before(F.col("v")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: [sum(v[:n]) for n in range(len(v))] for i, v in enumerate(lists)}


def test_spans_and_claims_are_not_shuffled(spark):
    assert shuffles(derive.spans(spark, FOLDER)) == shuffles(derive.claims(spark, FOLDER, texts=True)) == 0


def test_spans_of_odd_texts_equal_plain_python(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "\n", "\n\n", " ", "bé ", "\t", "😀"]) for _ in range(n)) for n in (0, 1, 5, 50, 3000)] + [None]
    versions = evidence.sources(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expected = set()
    for i, text in enumerate(texts):
        at = number = 0
        for line, raw in enumerate((text or "").strip().split("\n"), 1):
            if raw.strip():
                start = at + len(raw) - len(raw.lstrip())
                expected.add((f"srcv_{i}", number, line, start, start + len(raw.strip()), raw.strip()))
                number += 1
            at += len(raw) + 1
    got = evidence.numbered_spans(versions).select("source_version_id", "span_no", "line", "start_char", "end_char", "text").collect()
    assert set(map(tuple, got)) == expected and len(got) == len(expected)


def test_halves_equal_plain_python_with_one_shuffle(spark):
    rng = random.Random(8)
    rows, expected = [], {}

    def halve(spans, path):
        size = spans[-1][2] - spans[0][1]
        if len(spans) > 1 and size > 300 and len(path) < 3:
            cut = min(range(1, len(spans)), key=lambda i: (abs(size / 2 - (spans[i - 1][2] - spans[0][1])), i))
            halve(spans[:cut], path + "0")
            halve(spans[cut:], path + "1")
        else:
            expected.update({(doc, s[0]): path for s in spans})

    for doc in range(30):
        at, spans = 0, []
        for number in range(rng.randint(1, 40)):
            start, at = at, at + rng.randint(1, 60)
            spans.append((number, start, at))
        halve(spans, "")
        rows += [(doc, *s) for s in spans]
    df = spark.createDataFrame(rows, "doc int, span_no int, start_char long, end_char long")
    found = sections.subdivide_saturated(df, ["doc"], lambda n, chars: chars > 300)
    assert shuffles(found) == 1 and {(r.doc, r.span_no): r.path for r in found.collect()} == expected


def test_consolidation_equals_plain_python_and_shuffles_no_texts_with_spans(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["x", None]), n, rng.choice(["One  thing!", "one thing", "ONE-thing", "other", "", None]), "verified", "reported", [f"e{rng.randint(0, 30)}" for _ in range(rng.randint(0, 4))], n % 2 == 0) for n in range(120)]
    df = spark.createDataFrame(rows, "scope string, ordinal long, statement string, verification string, epistemic string, evidence array<string>, review_required boolean")
    norm = {"One  thing!": "one thing", "ONE-thing": "one thing"}
    groups = {}
    for r in rows:
        groups.setdefault((r[0], norm.get(r[2], r[2])), []).append(r)
    expected = {k: (list(dict.fromkeys(e for r in own for e in dict.fromkeys(r[5])))[:12], len(own) - 1, all(r[6] for r in own)) for k, own in groups.items()}
    found = sections.consolidate(df)
    assert {(r.scope, r.norm): (r.evidence, r.n_duplicates, r.review_required) for r in found.collect()} == expected
    query = QUERIES["consolidated_claims"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in query.splitlines() if "Aggregate" in line and "statement" in line or "Window" in line and "norm#" in line]


def test_claims_that_carry_their_texts_score_as_joined_ones(spark):
    claims = derive.claims(spark, FOLDER, texts=True)
    asked = derive.table(spark, FOLDER, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).limit(20)
    joined = retrieval.lexical_scores(asked, claims, derive.evidence_texts(claims), 5)
    own = retrieval.lexical_scores(asked, claims, None, 5)
    best = lambda rows: {q: sorted((-r.score, r.claim_id) for r in rows if r.query_id == q)[:5] for q in {r.query_id for r in rows}}
    assert shuffles(own) == 0 and best(own.collect()) == best(joined.collect())


def test_snapshots_with_hubs_equal_plain_python(spark, monkeypatch):
    """Hubs pass on no more than can be kept, whether ids are sent to the tasks or joined."""
    rng = random.Random(10)
    edges = {(f"claim:{a:02}", rng.choice([f"entity:{a % 3}", f"evidence:{a}_{i}"])) for a in range(60) for i in range(3)}
    rows = [(a, b, "e", float(len(b) % 3)) for a, b in edges] + [(a, b, "f", 0.5) for a, b in edges if a.endswith("1")]
    seeds = [(q, f"claim:{rng.randint(0, 59):02}") for q in range(6) for _ in range(2)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for sent in (1000, 0):
        monkeypatch.setattr(retrieval, "MAX_NODES_SENT", sent)
        nodes, kept = retrieval.graph_snapshot(spark.createDataFrame(seeds, "query_id long, node_id string"), spark.createDataFrame(rows, "from_node string, to_node string, edge_type string, weight double"), 12, 9)
        got, links = {(r.query_id, r.node_id): r.hop for r in nodes.collect()}, [tuple(r) for r in kept.collect()]
        expected, between = {}, []
        for q in range(6):
            hops = {n: 0 for p, n in seeds if p == q}
            for hop in (1, 2):
                for n in [n for n, h in hops.items() if h == hop - 1]:
                    for other in near.get(n, ()):
                        hops.setdefault(other, hop)
            own = dict(sorted(hops.items(), key=lambda x: (x[1], x[0]))[:12])
            expected |= {(q, n): h for n, h in own.items()}
            between += [(q, *r) for r in sorted((r for r in rows if r[0] in own and r[1] in own), key=lambda r: (-r[3], r[0], r[1], r[2]))[:9]]
        assert got == expected and sorted(links) == sorted(between)


def test_answers_and_rerank_inputs_shuffle_no_statements_of_other_documents(spark):
    """What follows the search reads the documents of the found claims alone."""
    ids = spark.createDataFrame([("mem_3_0",), ("mem_3_1",), ("mem_12_0",)], "claim_id string")
    rows = derive.claims(spark, FOLDER, only=derive.documents_of(ids))
    assert shuffles(rows) <= 1 and {r.doc_id for r in rows.collect()} == {3, 12}


def test_text_matches_equal_plain_python_and_make_their_tokens_once(spark):
    rng = random.Random(11)
    rows = [(f"c{i:02}", [rng.choice("abcde") for _ in range(rng.randint(0, 4))]) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(tokens):
        seen.add(1)
        return tokens

    df = spark.createDataFrame(rows, "claim_id string, tokens array<string>")
    seeds = rows[:15]
    got = synthesis.text_match(spark.createDataFrame(seeds, df.schema), df.withColumn("tokens", counted("tokens"))).collect()
    assert sorted(map(tuple, got)) == sorted((s, c) for s, a in seeds for c, b in rows if s != c and a and set(a) <= set(b))
    assert seen.value == len(rows)
