import random
from collections import defaultdict

from claimloom.llm.lines import dedupe_lines
from claimloom.llm.sharding import HASH_BITS, key_hash, shard_directory, shard_documents

SCHEMA = "doc_id long, text string, n_lines string, shard string"


def brute_lines(rows):
    docs = sorted({(-1 if i is None else i, t) for i, t, *_ in rows if t is not None})
    first, out = {}, {}
    for d, t in docs:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p : p + 3]), (d, p))
    for d, t in docs:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" \t\n\x0b\x0c\r") for x in w) and first[w] != (d, p):
                gone.update(range(p, p + 3))
        out[d] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(2)
    pool = ["alpha", "beta ", "", " ", "gamma\r", "delta", "épsilon"]
    licence = "line one\nline two\nline three\nline four"
    rows = [(None, "a\nb\nc\nd"), (0, None), (1, ""), (2, "\n\n\n\n"), (3, "x\nx\nx\nx\nx"), (4, licence)]
    for i in range(5, 120):
        parts = ["\n".join(rng.choices([*pool, f"own {i} {rng.random()}"], k=rng.randint(0, 9)))]
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, 1), licence)
        rows.append((i, "\n".join(parts)))
    rows += [rows[7]]
    df = spark.createDataFrame([(a, b, "n", "s") for a, b in rows], SCHEMA)
    got = dedupe_lines(df.drop("n_lines")).collect()
    assert len(got) == len(rows)
    expected = brute_lines(rows)
    for r in got:
        if r.text is None:
            assert (r.doc_id, r.n_lines, r.n_removed) == (0, 0, 0)
        else:
            assert (r.n_lines, r.n_removed, r.text) == expected[-1 if r.doc_id is None else r.doc_id]
    assert dedupe_lines(df.drop("n_lines").limit(0)).count() == 0


def brute_shards(hashes, limit):
    """Recursive splitting of (hash, bytes) rows."""
    out = {}

    def split(rows, depth):
        if sum(b for _, b in rows) <= limit or len({h for h, _ in rows}) == 1:
            out.update({h: depth for h, _ in rows})
            return
        sides = defaultdict(list)
        for h, b in rows:
            sides[h >> (HASH_BITS - depth - 1)].append((h, b))
        for side in sides.values():
            split(side, depth + 1)

    split(hashes, 0)
    return out


def test_sharding_matches_recursive_splitting(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([0, 10, 300, 2500])) for i in range(400)] + [(None, "y" * 700), (None, None), (9, "z" * 5000), (9, "z" * 5000)]
    df = spark.createDataFrame([(a, b, "n", "s") for a, b in rows], SCHEMA).drop("shard")
    for limit in (3000, 40_000, 10**9):
        got = shard_documents(df, limit=limit).withColumn("h", key_hash(df.doc_id)).collect()
        assert len(got) == len(rows)
        expected = brute_shards([(r.h, r.row_bytes) for r in got], limit)
        for r in got:
            assert r.shard_depth == expected[r.h]
            assert r.shard == (f"{r.h >> (HASH_BITS - r.shard_depth):0{r.shard_depth}b}" if r.shard_depth else "")
    assert shard_documents(df.limit(0)).count() == 0


def test_directory_fits_the_limit(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(500)], "doc_id long, text string")
    directory = shard_directory(shard_documents(df, limit=4000)).collect()
    assert sum(r.n_rows for r in directory) == 500 and all(r.n_bytes <= 4000 for r in directory)
    names = sorted(r.shard for r in directory)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_clashing_columns(spark):
    names = ["row", "own", "v", "_v", "_id", "_version", "positions", "at", "w", "_hash", "_prefix", "_coarse", "_fine", "prefix", "n_lines", "shard"]
    text = "\n".join(["one line", "two lines", "three lines"])
    rows = [(i, text if i < 2 else f"other {i}", *names) for i in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = {r.doc_id: r.asDict() for r in dedupe_lines(df).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 3 and got[1]["text"] == ""
    assert all(r[c] == c for r in got.values() for c in names if c != "n_lines")
    assert dedupe_lines(df).columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    sharded = shard_documents(df)
    assert sharded.columns == [c for c in df.columns if c != "shard"] + ["shard", "shard_depth", "row_bytes"]
    assert all(r[c] == c for r in sharded.collect() for c in names if c != "shard")
