"""Exact search, fuzzy lines and decontamination against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climrisk.llm import decontaminate, lines, vafile


# ---- exact search --------------------------------------------------------------------------


def brute_search(rows, asked, k):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i in asked}):
        mine = min(v for i, v in sound if i == q)
        scored = [(-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in sound if i != q and len(v) == len(mine)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture
def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(40)]  # ties
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (None, [0.1] * 8)]
    rows += [(304, [1.0, 2.0]), (305, [2.0, 1.0]), (306, []), (307, []), (20, [0.2] * 8), (20, [0.2] * 8)]
    return rows


def test_search(spark, vectors, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 32)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 7)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, block int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = vafile.search(df, df.where("vec_id % 20 = 0 OR vec_id > 303"), k=7)
    assert sorted(map(tuple, got.collect())) == brute_search(exact, {i for i, _ in vectors if i is not None and (i % 20 == 0 or i > 303)}, 7)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    base, ask = rng.integers(-900, 900, (200, 6)), rng.integers(-900, 900, (20, 6))
    low, high = vafile.Cells(base, 16).bounds(ask)
    exact = ask @ base.T
    assert (low <= exact).all() and (exact <= high).all()


def test_search_empty_and_huge(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.search(df, df).count() == 0
    rng = np.random.default_rng(8)
    rows = [(i, np.float32(rng.normal(size=8) * 10.0 ** rng.integers(0, 8)).tolist()) for i in range(60)]
    rows += [(100, [3e38] * 8), (101, [-3e38] * 8)]
    big = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    most = 2**63 - 1
    clip = lambda s, low, high: max(low, min(high, s))
    whole = {i: [clip(math.floor(64 * x), -(2**63), 2**63 - 1024) for x in v] for i, v in rows}
    want = []
    for q in whole:
        scored = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), -most - 1, most), i) for i in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, vafile.search(big, big, k=5).collect())) == sorted(want)


# ---- lines ---------------------------------------------------------------------------------


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", max_size=40), st.text("ab ", max_size=40))
def test_edit_distance(a, b):
    true = plain_distance(a, b)
    assert lines.edit_distance(a, b, 100) == true
    for most in range(0, 12, 3):
        assert (lines.edit_distance(a, b, most) <= most) == (true <= most)
    for percent in (50, 80, 95):
        assert lines.alike(a, b, percent) == (100 * true <= (100 - percent) * max(len(a), len(b)))


def line_rows():
    rng = random.Random(9)
    words = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("nt", "rs", "m", "x", "")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(40) for _ in range(4)]

    def touched(text):
        w = text.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join([line(rng.randint(8, 40)), rng.choice(shared), line(12)])) for i in range(12)]
    rows += [(20 + i, touched(shared[0]) + "\n" + line(20)) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "\n\n ...\n"), (53, shared[1].upper() + "!\n" + shared[1]), (None, shared[1]), (54, line(3000)), (1, shared[2])]
    return rows


def brute_lines(rows, percent):
    """Occurrences to drop if every pair of lines is compared."""
    every = [(i, p, lines.normalised(x.encode()).decode()) for i, t in rows if i is not None for p, x in enumerate((t or "").split("\n"))]
    every = sorted((x for x in every if x[2]), key=lambda x: x[:2])
    root = list(range(len(every)))
    for a in range(len(every)):
        for b in range(a):
            x, y = every[a][2], every[b][2]
            if root[a] != root[b] and 100 * plain_distance_quick(x, y) <= (100 - percent) * max(len(x), len(y)):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    stays = {r: every[r][:2] for r in set(root)}
    return {every[k][:2] for k in range(len(every)) if every[k][:2] != stays[root[k]]}


def plain_distance_quick(a, b):
    return max(len(a), len(b)) if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)) else lines.edit_distance(a, b, len(a) + len(b))


def test_lines_find_nearly_all_and_nothing_else(docs):
    rows = line_rows()
    want = brute_lines(rows, 80)
    got = {(r["doc_id"], r["place"]) for r in lines.repeated_lines(docs(rows)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    exact = {x for x in want if dict(rows).get(x[0]) and lines.normalised(dict(rows)[x[0]].split("\n")[x[1]].encode()) in seen_before(rows, x)}
    assert exact <= got


def seen_before(rows, occurrence):
    return {lines.normalised(x.encode()) for i, t in rows if i is not None for p, x in enumerate((t or "").split("\n")) if (i, p) < occurrence}


def test_lines_cut(docs, empty):
    rows = [(1, "Some words that stand here\n\nand more of them"), (2, "some WORDS, that stand here!\nbut a new line with other things"), (3, None), (None, "Some words that stand here")]
    got = {r["doc_id"]: r for r in lines.deduplicate(docs(rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "but a new line with other things"
    assert (got[2]["n_lines"], got[2]["n_removed"], got[3]["text"], got[3]["n_lines"]) == (2, 1, None, 0)
    assert got[None]["text"] == rows[3][1] and got[2]["lang"] == "en"
    assert lines.deduplicate(empty).count() == 0


def test_large_group_of_one_block(docs):
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(i, base + f" tail{i:04d}") for i in range(120)]
    got = {(r["doc_id"], r["place"]) for r in lines.repeated_lines(docs(rows)).collect()}
    assert len(got) >= 115 and (0, 0) not in got


# ---- decontamination -----------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(rows, items, width):
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        if i is not None and w:
            k = min(width, len(w))
            for p in range(len(w) - k + 1):
                grams.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in grams:
                    hit.update(range(p, p + k))
                    found |= grams[tuple(w[p : p + k])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination(spark, docs, hard_texts, rows_of, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SET_LIMIT", limit)
    texts = dict(hard_texts)
    items = [(1, texts[29][:200]), (2, texts[40].upper()), (3, "one two"), (4, None), (5, "..."), (None, texts[0]), (12, texts[40]), (3, "one two")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = rows_of(decontaminate.contamination(docs(hard_texts), bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute_contamination(hard_texts, items, 13)
    kept = [r["doc_id"] for r in decontaminate.remove_documents(docs(hard_texts), bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(g[0]) for g in got if not g[5])


def test_contamination_empty(spark, docs, empty, hard_texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(hard_texts), none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0


def test_spans_are_cut(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    out = decontaminate.remove_spans(docs([(1, "One alpha Beta, gamma two"), (2, None)]), bench)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "one two"), (2, "")]
