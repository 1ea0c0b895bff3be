import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorewell.llm.packing import Limits, Packer, pack_documents
from lorewell.llm.tokens import Encoder

from . import fixtures

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "1", "٣", " ", " ", "\n", "\t", "'s", "'", "!", "\xa0", "\x1c", "日本", "<|endoftext|>", "ª", "\r\n", "\x85", "\0", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", "x" * 4000]
    got = [None] * len(texts)
    for first, ids, at in Encoder(PATH).encode(pa.array(texts, pa.string())):
        for i in range(len(at) - 1):
            got[first + i] = ids[at[i] : at[i + 1]].tolist()
    assert got == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("limits", "cut"), [(Limits(64, 8, 64), True), (Limits(64, 3, 20), True), (Limits(64, 5, 40), False), (Limits(1, 1, 1), True)])
def test_packer_keeps_every_token_within_all_limits(limits, cut):
    rng = random.Random(5)
    packer, before, sequences = Packer(limits, cut), {}, []
    for i in range(900):
        n = rng.choice([1, 2, 10, 30, 63, 64, 65, 200])
        before[i] = np.r_[0, np.cumsum([rng.random() < 0.5 for _ in range(n)])]
        sequences += list(packer.feed(i, n, before[i]))
    sequences += list(packer.finish())
    seen = defaultdict(list)
    for s in sequences:
        assert sum(p.length for p in s) <= limits.tokens and len(s) <= limits.segments and sum(p.loss for p in s) <= limits.loss_tokens
        for p in s:
            assert p.loss == before[p.item][p.start + p.length] - before[p.item][p.start]
            seen[p.item].append((p.start, p.length))
    for i, b in before.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at and length > 0
            at += length
        assert at == len(b) - 1


def check(rows, got, tokenizer):
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padded = total = 0
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.02 * total
    want = defaultdict(int)
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, np.array(ids, "<u4").tobytes()] += 1
    whole = defaultdict(int)
    for d, own in pieces.items():
        if len({r.start for r in own}) == len(own):
            own.sort(key=lambda r: r.start)
            whole[d, b"".join(r.ids for r in own)] += 1
            assert {r.doc_tokens for r in own} == {sum(r.length for r in own)}
    for k, n in whole.items():
        assert want[k] == n
    assert sum(len(r.ids) for r in got) == sum(len(k[1]) * n for k, n in want.items())


def test_pack_documents_round_trip(spark, tokenizer):
    check(fixtures.rows(), pack_documents(fixtures.docs(spark), PATH).collect(), tokenizer)


def test_pack_small_table(spark, tokenizer):
    table = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    check([tuple(r) for r in table.select("doc_id", "text").collect()], pack_documents(table, PATH).collect(), tokenizer)


def test_conversations_under_three_limits(spark, tokenizer):
    """Answers bear loss, the questions before them none; all three limits hold and bind."""
    turns = spark.read.parquet(f"{fixtures.SMALL}/conversations.parquet")
    turn = Window.partitionBy("conv_id").orderBy("turn")
    asked = turns.withColumn("prompt", F.lag("text").over(turn)).where("role = 'assistant'")
    asked = asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "prompt", "text").coalesce(1)
    limits = Limits(4096, 3, 1200)
    got = pack_documents(asked, PATH, limits=limits, id_col="id", prompt_col="prompt").collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    sums = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in sequences.values()]
    assert all(a <= b for s in sums for a, b in zip(s, (4096, 3, 1200), strict=True))
    assert max(s[1] for s in sums) == 3
    wider = pack_documents(asked, PATH, limits=Limits(4096, 3, 4096), id_col="id", prompt_col="prompt").groupBy("sequence_id").agg(F.sum("loss_tokens").alias("n"))
    assert wider.where("n > 1200").count() >= 1
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    want = {r.id: (ids(r.prompt), [*ids(r.text), 1]) for r in asked.collect()}
    pieces = defaultdict(list)
    for r in got:
        pieces[r.id].append(r)
    assert set(pieces) == set(want) and want
    for k, (head, tail) in want.items():
        own = sorted(pieces[k], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == head + tail
        assert sum(r.loss_tokens for r in own) == len(tail)
        assert all(r.loss_tokens == max(0, r.start + r.length - max(len(head), r.start)) for r in own)


def test_equal_hashes_are_told_apart(monkeypatch, tokenizer):
    from lorewell.llm import spans

    monkeypatch.setattr(spans, "hash_spans", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two three, one", "two one"]
    got = [ids[a:b].tolist() for _, ids, at in Encoder(PATH).encode(pa.array(texts)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark):
    assert pack_documents(fixtures.empty(spark), PATH).count() == 0


def test_tiny_documents_need_no_padding():
    packer = Packer(Limits())
    out = [s for i in range(4000) for s in packer.feed(i, 3)] + list(packer.finish())
    sizes = [sum(p.length for p in s) for s in out]
    assert sum(sizes) == 12_000 and all(n == 2048 or n & (n - 1) == 0 for n in sizes)
