import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from claimloom.llm.packing import Packer, WordEncoder, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(2)
    odd = ["<|endoftext|>", "it's", "ΣΑΣ", "İx", "á", "́b", "e f", "1234", "日本語", "\x1cq", "!!??", "ß"]
    out = [None, "", "  \n", "<|startoftext|> don't"]
    for _ in range(120):
        words = rng.choices(odd + [f"word{i}" for i in range(50)], k=rng.choice([1, 5, 80, 700, 4000]))
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    return out


def test_pieces_cover_every_id_once(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    got = pack_documents(df).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces, sequences = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert part == list(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in pieces.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end and length > 0
            end += length
        assert end == len(ids[i])
    assert set(pieces) == set(ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0


def test_words_encode_as_in_whole_texts():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pydict()["text"][:300]
    rng = random.Random(8)
    letters = [chr(c) for c in [*range(33, 127), *range(161, 256), 0x301, 0x3A3, 0x130, 0x2028, 0x1F600, 0xA0, 0x85, 0x1C, 0x149]]
    rows += [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60)) for _ in range(60)]
    rows += ["I'm they'll <|endoftext|> X<|startoftext|>y <|endoftext", "ÀÉ's 'S 'LL''re"]
    tokenizer = Tokenizer.from_file(PATH)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
    got = [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(PATH).encode([t.encode() for t in rows])]
    assert got == expected


def test_cache_generations_change_nothing():
    bodies = [t.encode() for t in texts() if t]
    small, large = WordEncoder(PATH, 5), WordEncoder(PATH)
    assert [small.encode([b])[0] for b in bodies] == large.encode(bodies)


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(4)
    packer = Packer(64)
    for _ in range(3000):
        length = rng.randint(1, 20)
        before = packer.level.copy()
        options = []
        for fill in [0, *np.flatnonzero(before)]:
            if fill + length <= 64:
                after = before.copy()
                after[fill] -= fill > 0
                after[fill + length] += fill + length < 64
                options.append(int((after**2).sum()))
        packer.place((0, 0, b"0000" * length, length), length)
        assert int((packer.level**2).sum()) == min(options)
    assert packer.level.sum() < 100  # short pieces leave few windows open


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
