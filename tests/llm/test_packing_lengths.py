"""Tokens, packing and length counts against the plain tokenizer and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climrisk.llm import lengths, packing, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.default_path())
    return lambda text: made.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("aZé'ßsΣİ́ \n\t\x1c  <|>endoftext09½²")), max_size=60))
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.default_path())
    assert np.frombuffer(tokens.encoder(tokens.default_path())(text), "<u4").tolist() == made.encode(text, add_special_tokens=False).ids


def test_pieces_of_documents(docs, hard_texts, plain):
    rows = packing.pack_documents(docs(hard_texts), limit=512, ids=True).collect()
    want = Counter()
    for i, t in hard_texts:
        ids = [*plain(t or ""), 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 512


def test_groups_keep_sequences_apart(spark):
    cuts = spark.createDataFrame([(i, 0, 0, 1 + i * 37 % 100, i) for i in range(500)], packing.PIECES)
    rows = packing.pack(cuts, limit=100, each=64).collect()
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert len(rows) == 500 and max(filled.values()) <= 100


def test_nearly_as_few_as_possible():
    sizes = np.sort(np.random.default_rng(0).integers(1, 4097, 4000))[::-1]
    bins, places, made = packing.sum_of_squares(sizes, 4096)
    assert made == bins.max() + 1
    assert np.bincount(bins, weights=sizes).max() <= 4096
    assert made <= 1.05 * -(-sizes.sum() // 4096)
    small = np.sort(np.random.default_rng(0).integers(1, 1500, 4000))[::-1]
    assert packing.sum_of_squares(small, 4096)[2] <= 1.003 * -(-small.sum() // 4096)


def test_choice_lowers_the_sum_of_squares_most():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 21, 200)
    bins, places, _ = packing.sum_of_squares(sizes, 20)
    room: dict[int, int] = {}
    for size, bin_, place in zip(sizes.tolist(), bins.tolist(), places.tolist(), strict=True):
        gaps = Counter(g for g in room.values() if g)
        cost = {}
        for gap in {g for g in gaps if g >= size}:
            after = gaps.copy()
            after[gap] -= 1
            if gap > size:
                after[gap - size] += 1
            cost[gap] = sum(n * n for n in after.values())
        gap = room.get(bin_, 20)
        assert place == 20 - gap
        if cost:
            assert cost[gap] == min(cost.values())
        else:
            assert bin_ not in room
        room[bin_] = gap - size


def test_empty_table(empty):
    assert packing.pack_documents(empty).count() == 0
    assert lengths.with_suffix_sums(lengths.histogram(empty)).count() == 0


def test_lengths(docs, hard_texts, plain):
    sums = lengths.with_suffix_sums(lengths.histogram(docs(hard_texts))).persist()
    all_ = np.array([len(plain(t or "")) for _, t in hard_texts])
    got = {r["length"]: r for r in sums.collect()}
    assert sorted(got) == sorted(set(all_.tolist()))
    for n, r in got.items():
        assert r["n_docs"] == (all_ == n).sum()
        assert r["docs_longer_or_equal"] == (all_ >= n).sum()
        assert r["tokens_longer_or_equal"] == all_[all_ >= n].sum()
        assert (r["docs_total"], r["tokens_total"]) == (len(all_), all_.sum())
        assert r["truncated_total"] == np.minimum(all_, n).sum()
    for r in lengths.truncated(sums, [0, 1, 7, 100, 10**6]).collect():
        assert r["tokens"] == np.minimum(all_, r["limit"]).sum()
    for r in lengths.quantiles(sums, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        order = np.sort(all_)
        assert r["length"] == order[max(0, int(np.ceil(r["share"] * len(order))) - 1)]
