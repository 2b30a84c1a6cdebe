"""The Merkle manifest against a plain recursive build, on odd rows and tree widths around the block size."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from climrisk.llm import merkle

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, tree string, number long, log string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n):
    return h("".join(map(part, (doc_id, source, lang, n, text))))


def low(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        run = level[first : first + 8]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= 8
    return out


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, members = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        members[lang], trees[lang] = own, levels_of([leaf(*r) for r in own])
    crown = levels_of([trees[lang][-1][0] for lang in langs])
    root, out = crown[-1][0], Counter()
    for k, lang in enumerate(langs):
        for i, r in enumerate(members[lang]):
            path = steps(trees[lang], i) + steps(crown, k)
            own = leaf(*r)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r[0], low(r[1]), *r[2:]) if hit else own
            for a, b in path:
                node = h(a + node + b)
            out[r[0], own, trees[lang][-1][0], root, h("".join(a + b for a, b in path)), node, node == root] += 1
    return out


def table(spark, rows):
    full = [(t, i, lang, source, n, "x", 1, "y") for i, t, lang, source, n in rows]
    return spark.createDataFrame(full, SCHEMA)


def check(spark, rows):
    got = merkle.prove(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == expected(rows)


def test_odd_rows(spark, hard_texts):
    rows = [(i, t, ["en", None, "", "é", "-"][k % 5], [None, "s", "ü:2"][k % 3], [None, k][k % 2]) for k, (i, t) in enumerate(hard_texts)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (3, "A:b", "zz", "1", 2), (3, "a", "zz", "1", 2)]
    check(spark, rows)


@pytest.mark.parametrize("count", [1, 2, 8, 9, 65, 512, 513, 4200])
def test_widths_around_runs_and_blocks(spark, count):
    check(spark, [(i * 7 - 5, f"Text {i}", "en", "s", i) for i in range(count)] + [(1, "X", "fr", "s", 1)])


def test_many_languages(spark):
    check(spark, [(i, "T", f"l{i % 600}", "s", 1) for i in range(1300)])


def test_no_rows(spark):
    assert merkle.prove(table(spark, [])).count() == 0


def test_log_is_postorder_without_gaps(spark):
    rows = [(i, f"t{i}", "en" if i < 4200 else "fr", "s", 1) for i in range(4209)]
    log = merkle.Manifest(table(spark, rows)).log()

    def walk(levels, level, i, out):
        if level:
            for j in range(8 * i, min(8 * i + 8, len(levels[level - 1]))):
                walk(levels, level - 1, j, out)
        out.append((level, i, levels[level][i]))
        return out

    for lang in ("en", "fr"):
        levels = levels_of([leaf(*r) for r in rows if r[2] == lang])
        want = walk(levels, len(levels) - 1, 0, [])
        got = [tuple(r) for r in log.where(F.col("lang") == lang).orderBy("position").select("level", "number", "digest").collect()]
        assert got == want
        assert [r[0] for r in log.where(F.col("lang") == lang).select("position").orderBy("position").collect()] == list(range(len(want)))
