"""The tokenizer against the public libraries, and packing against its definition."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daram.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def own():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def ids(own, texts):
    flat, per_piece, _, pieces = own.encode(texts)
    at = np.concatenate([[0], np.cumsum(bpe._per_text(per_piece, pieces))])
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_closure(own):
    c = own.automaton.compose
    n = len(c)
    a, b, d = np.random.default_rng(0).integers(0, n, (3, 2000))
    assert (c[c[a, b], d] == c[a, c[b, d]]).all()  # associative


def test_signs(own, public):
    rng = random.Random(1)
    alphabet = "  '''strevmldSaZ\n\t　\xa0 19½가각é́.!?<|endoftext|>²Ⅷ\x00\x1c\x85​😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["", "don't we'll they're I'd've", "'s", " 's", "''s", "'re'", "a  b", "a \n b ", "x" * 5000, "가" * 3000 + "ab" * 3000]
    assert ids(own, texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point(own, public):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}." for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert ids(own, texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(own, public, texts):
    texts = [t for t in texts if all(not 0xD800 <= ord(c) < 0xE000 for c in t)] or [""]
    assert ids(own, texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_columns(spark):
    texts = ["보험 don't\n", None, "", " ", "<|endoftext|>", "가나다" * 40_000, "보험 don't\n"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    rows = {r.doc_id: r for r in bpe.encode(df, "doc_id", "text", offsets=True).collect()}
    assert rows[1].ids == rows[2].ids == [] and rows[0].ids == rows[6].ids and len(rows) == 7
    assert all(sum(r.piece_tokens) == len(r.ids) and len(r.piece_starts) == len(r.piece_tokens) for r in rows.values())
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert [back[i] for i in range(7)] == [t or "" for t in texts]
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "doc_id", "text").collect()} == {i: len(r.ids) for i, r in rows.items()}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
    # a piece decodes alone by its offsets
    with open(bpe.VOCABULARY, "rb") as f:
        pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    r, at = rows[0], 0
    for start, n, stop in zip(r.piece_starts, r.piece_tokens, [*r.piece_starts[1:], len(texts[0])]):
        assert b"".join(pieces[i] for i in r.ids[at : at + n]).decode() == texts[0][start:stop]
        at += n


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(0, 60), max_size=60), capacity=st.integers(1, 30), rule=st.sampled_from(["norm", "dot"]), documents=st.integers(1, 6), share=st.sampled_from([0.3, 0.6, 0.9, 1.0]))
def test_pack(sizes, capacity, rule, documents, share):
    sizes = np.array(sizes, np.int64)
    cost = share * capacity**2
    item, start, length, container = packing.pack(sizes, capacity, documents, cost, rule=rule)
    for i, size in enumerate(sizes):
        mine = sorted((s, n) for s, n in zip(start[item == i], length[item == i]))
        assert sum(n for _, n in mine) == size and [s for s, _ in mine] == [k * capacity for k in range(len(mine))] and mine
        assert size > capacity or len(mine) == 1
    for b in np.unique(container):
        held = length[container == b]
        assert held.sum() <= capacity and len(held) <= documents and ((held**2).sum() <= cost or len(held) == 1)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_each_capacity_binds(rule):
    """Items that fit by two of the capacities are kept apart by the third alone."""
    bins = lambda sizes, *limits: len(np.unique(packing.pack(np.array(sizes), *limits, rule=rule)[3]))
    loose = (100, 100, 1e9)
    assert bins([60, 50], *loose) == 2 and bins([60, 40], *loose) == 1  # tokens
    assert bins([10, 10, 10], 100, 2, 1e9) == 2 and bins([10, 10, 10], 100, 3, 1e9) == 1  # documents
    assert bins([60, 30, 10], 100, 100, 4000) == 2 and bins([60, 30, 10], 100, 100, 4600) == 1  # cost
    assert bins([80, 10], 100, 100, 3600) == 2  # alone beyond the cost


def brute(sizes, limits, weights):
    """Best fit by the definition: every open container is scored for every item."""
    bins, out = [], []
    for n in sorted(sizes, reverse=True):
        v = np.array([n, 1.0, float(n) ** 2])
        scored = [((((b - v) / limits * weights) ** 2).sum(), i) for i, b in enumerate(bins) if (b >= v).all()]
        if not scored:
            bins.append(limits.copy())
            scored = [(0, len(bins) - 1)]
        i = min(scored)[1]
        bins[i] = bins[i] - v
        out.append(i)
    return len(bins)


def test_pack_is_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(5):
        sizes = rng.integers(1, 90, 300)
        limits = np.array([100, 3, 8_100.0])
        assert abs(len(np.unique(packing.pack(sizes, 100, 3, 8_100.0)[3])) - brute(sizes, limits, np.array(packing.WEIGHTS))) <= 1


def test_assign(spark):
    sizes = spark.createDataFrame([(i, (i * 37) % 500, 1) for i in range(3000)] + [(None, 5, 1), (7, 0, 1), (8, 5000, 1)], "doc_id bigint, n_tokens bigint, pack_name int")
    packs = spark.createDataFrame([("a", 256, 0), ("b", 1024, 0), ("c", None, 0), ("d", 0, 0)], "pack_name string, capacity_tokens int, n_tokens int")
    placed = packing.assign(sizes, packs, group_rows=500).toPandas()
    assert set(placed["pack_name"]) == {"a", "b"}
    for name, capacity in (("a", 256), ("b", 1024)):
        p = placed[placed["pack_name"] == name]
        assert p["n_tokens"].sum() == sum((i * 37) % 500 for i in range(3000)) + 5005
        assert p.groupby("container")["n_tokens"].sum().max() <= capacity
    usage = {r.pack_name: r.share_used for r in packing.usage(packing.assign(sizes, packs, group_rows=500)).collect()}
    assert min(usage.values()) > 0.95
    free = packing.assign(sizes, packs, group_rows=500, documents_factor=100, cost_share=1.0).groupBy("pack_name").agg(F.countDistinct("container").alias("n")).collect()
    tight = packing.assign(sizes, packs, group_rows=500, max_documents=2).groupBy("pack_name", "container").count().groupBy("pack_name").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).collect()
    assert {r.most for r in tight} == {2} and {r.pack_name: r.n for r in tight}["b"] > {r.pack_name: r.n for r in free}["b"]
    assert packing.assign(sizes.limit(0), packs).count() == 0 and packing.assign(sizes, packs.limit(0)).count() == 0
