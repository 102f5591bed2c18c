import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_parts_give_the_ids_of_the_whole_text(tokenizer):
    rng = random.Random(1)
    letters = [*"ab'sté. \n\t  \x1c\x85\xa01ÉÑ中!|", " ", "​", "<|endoftext|>", " the", "  ", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "  a"]
    encoder = packing.PartEncoder(PATH)
    for _ in range(2):  # without and with the cache
        assert encoder.encode(texts) == [np.array(x.ids, dtype=np.uint16).tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_have_their_own_ids(tokenizer):
    """10,000 texts that hold the end-of-text mark, whole, cut short, doubled and beside spaces."""
    rng = random.Random(4)
    mark = "<|endoftext|>"
    letters = [*"ab .\n\t", " the", mark, mark + mark, mark[:-1], mark[1:], " " + mark, mark + " ", "\u00e9" + mark, mark.upper(), "<|", "|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) + mark + "".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(10_000)]
    got = packing.PartEncoder(PATH).encode(texts)
    assert got == [np.array(x.ids, dtype=np.uint16).tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert all(np.array([50256], np.uint16).tobytes() in g for g in got)


@pytest.mark.parametrize("length", [5, 2048])
def test_every_id_in_one_piece(table, tokenizer, length):
    texts = {i: t for i, t in enumerate(["a b c", None, "", "x " * 3000, "the same", "the same", " lead and  gaps ", "one<|endoftext|> two"])}
    rows = [(i, t, "mine", 7) for i, t in texts.items()] + [(4, "the same", "mine", 7), (None, "no id", "mine", 7)]
    out = packing.pack(table(rows, "doc_id long, text string, ids string, part int"), PATH, length=length)
    pieces = out.withColumn("crc", F.crc32("ids")).collect()
    stream = defaultdict(list)
    for p in pieces:
        assert p.crc == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
        stream[p.sequence_id].append((p.offset, p.length))
    for seq, parts in stream.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or seq == max(stream)
    assert sorted(stream) == list(range(len(stream)))
    for i, t in texts.items():
        want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        got = sorted((p.start, p.ids, p.doc_tokens) for p in pieces if p.doc_id == i)
        copies = 2 if i == 4 else 1
        assert sum(len(g[1]) for g in got) == copies * len(want) and {g[2] for g in got} == {len(want) // 4}
        assert all(want[4 * s:4 * s + len(b)] == b for s, b, _ in got)
    made = packing.sequences(out, length).collect()
    assert {len(r.ids) for r in made} == {length} and sum(r.n_tokens for r in made) == sum(p.length for p in pieces)


def test_empty_table(table):
    assert packing.pack(table([], "doc_id long, text string"), PATH).count() == 0


def test_texts_go_to_workers_in_small_batches(spark):
    """Wide rows are dealt out by bytes, not 10,000 at a time, and the session's bound holds again after."""
    from driftspark.llm import shared

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    seen, real = [], shared.staged

    def staged(df, what):
        seen.append((what, int(spark.conf.get(name).rstrip("bB"))))
        return real(df, what)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing.shared, "staged", staged)
        rows = packing.pack(spark.createDataFrame([(i, "word " * 50) for i in range(300)], "doc_id long, text string"), PATH)
        assert rows.select("doc_id").distinct().count() == 300
    assert dict(seen)["tokens"] <= 8 << 20 and spark.conf.get(name) == before


def test_the_tokenizer_is_read_only_for_texts_that_need_it():
    coder = packing.PartEncoder(PATH)
    coder.encode(["plain words", ""])
    assert coder.tokenizer is None
    coder.encode(["a <|endoftext|> b"])
    assert coder.tokenizer is not None
