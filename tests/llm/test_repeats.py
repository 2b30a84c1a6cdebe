"""Word windows, byte strings and near-duplicate sets against brute force."""

import hashlib
import random

import numpy as np
import pytest

from climrisk.llm import jaccard, substrings, suffixarray
from climrisk.llm.components import components

SPACE = " \t\n\r\x0b\x0c"


def words(text):
    return (text or "").encode().split()


def brute_windows(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            first[g] = min(first.get(g, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (2**63 - 1 if i is None else i):
                gone.update(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] = seen.get(b[p : p + width], 0) + 1
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_sets(rows, each, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = words((t or "").translate(lower))
        k = min(each, len(w))
        sets.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if w else set())
    reach = {i: i for i, _ in rows if i is not None}
    while True:
        before = dict(reach)
        for (i, _), a in zip(rows, sets, strict=True):
            for (j, _), b in zip(rows, sets, strict=True):
                if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                    reach[i] = reach[j] = min(reach[i], reach[j])
        if before == reach:
            break
    return sorted(((i, len(s), reach.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize("width", [13, 5])
def test_words_match_brute_force(docs, hard_texts, rows_of, width):
    out = substrings.deduplicate(docs(hard_texts), width, chunk_bytes=2000)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(hard_texts, width)


def test_words_kept_text_and_spans_agree(docs, hard_texts):
    for r in substrings.deduplicate(docs(hard_texts), 13, chunk_bytes=3000).collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("width", [400, 64, 75])
def test_bytes_match_brute_force(docs, hard_texts, rows_of, width):
    out = suffixarray.deduplicate(docs(hard_texts), width, chunk_bytes=3000)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(hard_texts, width)


def test_bytes_random_texts(docs, rows_of):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 300))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    out = suffixarray.deduplicate(docs(rows), 100, chunk_bytes=1500)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 100)


@pytest.mark.parametrize("period", [8, 16, 25, 40])
def test_cover_has_every_difference(period):
    cover = suffixarray.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("each,percent", [(5, 80), (2, 60)])
def test_sets_match_brute_force(docs, hard_texts, rows_of, each, percent):
    out = jaccard.similar(docs(hard_texts), each, percent, chunk_bytes=3000)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_sets(hard_texts, each, percent)


def test_sets_blocks_of_a_large_group(docs, rows_of, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 60)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    assert rows_of(jaccard.similar(docs(rows)), "doc_id", "n_shingles", "component_id") == brute_sets(rows, 5, 80)


def test_divide_skip_finds_frequent_places():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lists = sorted((np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(12)), key=len)
        for least in (1, 3, 7, 12):
            counts = np.bincount(np.concatenate(lists), minlength=60)
            places, times = jaccard.divide_skip(lists, least, lambda p: np.zeros(len(p), bool))
            assert dict(zip(places.tolist(), times.tolist(), strict=True)) == {p: c for p, c in enumerate(counts) if c >= least}


def test_keep_one(docs, hard_texts):
    kept = [r["doc_id"] for r in jaccard.keep_one(docs(hard_texts)).collect()]
    want = {i for i, _, c in brute_sets(hard_texts, 5, 80) if i is not None and i == c}
    assert sorted(i for i in kept if i is not None) == sorted(want) and kept.count(None) == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (4, 4)]
    reach = {x: x for e in edges for x in e if x is not None and e[0] is not None and e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a in reach and b in reach and a != b:
                reach[a] = reach[b] = min(reach[a], reach[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == reach
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(empty):
    assert substrings.deduplicate(empty).count() == 0
    assert suffixarray.deduplicate(empty).count() == 0
    assert jaccard.similar(empty).count() == 0


def test_all_texts_empty(docs, rows_of):
    rows = [(1, None), (2, "")]
    assert rows_of(substrings.deduplicate(docs(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows, 13)
    assert rows_of(suffixarray.deduplicate(docs(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 400)
    assert rows_of(jaccard.similar(docs(rows)), "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]


def test_planted_passages_around_the_width(docs, rows_of):
    """Passages of 300 to 600 bytes planted in documents of their own: brute force, those under 400 bytes stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda size: " ".join(word() for _ in range(size // 4))[:size]
    rows, lengths = [], (300, 399, 400, 401, 450, 600)
    for k, size in enumerate(lengths):
        passage = text(size)
        # What stands beside a passage differs, or the repeated string would be longer.
        rows += [(10 * k + n, text(700) + f"<{n}" + passage + f"{n}>" + text(300)) for n in range(3)]
    rows += [(100 + n, text(1500)) for n in range(10)]
    out = suffixarray.deduplicate(docs(rows), width=400)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 400)
    gone = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    for k, size in enumerate(lengths):
        assert {gone[10 * k + n] for n in range(3)} == {size if size >= 400 else 0}
    assert not any(gone[100 + n] for n in range(10))
