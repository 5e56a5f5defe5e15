"""Periodic runs against brute force over all periods, and their edge cases."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tracelake.llm import periodic_runs, queries
from tracelake.llm.common import read

DOCS = "doc_id long, text string, runs string"


def brute_runs(words, least=6, times=4):
    """(start, length, period): for each period the longest stretches, kept where no smaller period has the same."""
    found = {}
    for p in range(1, len(words) // times + 1):
        at = 0
        while at + p < len(words):
            if words[at] != words[at + p]:
                at += 1
                continue
            end = at + p
            while end < len(words) and words[end] == words[end - p]:
                end += 1
            if end - at >= max(least, times * p):
                found.setdefault((at, end), p)
            at = end - p + 1
    return sorted((a, e - a, p) for (a, e), p in found.items())


def collapsed(words, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def text_with_runs(rng, n, vocabulary):
    words = []
    while len(words) < n:
        part = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 12))]
        words += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randrange(len(part))]
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (1, 3), (10, 5)])
@pytest.mark.parametrize("vocabulary", [1, 2, 3, 50])
def test_runs_equal_brute_force(monkeypatch, vocabulary, least, times):
    monkeypatch.setattr(periodic_runs, "STEP", 50)
    rng = random.Random(vocabulary)
    texts = [text_with_runs(rng, rng.choice([0, 1, 5, 40, 200]), vocabulary) for _ in range(25)] + [["a"] * n for n in range(9)] + [["a", "b"] * 4, ["a", "b"] * 4 + ["a"]]
    texts = [t[: len(t) - rng.randrange(2)] for t in texts]
    code = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    codes, starts = np.array([code[w] for t in texts for w in t], np.int64), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    start, end, period = periodic_runs.find(codes, starts, least, times)
    found = [[] for _ in texts]
    for a, e, p in zip(start, end, period):
        i = int(np.searchsorted(starts, a, "right")) - 1
        found[i].append((int(a - starts[i]), int(e - a), int(p)))
    assert found == [brute_runs(t, least, times) for t in texts]


def planted(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in read(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(docs) and sum(r.n_runs for r in rows) > 5
    for r in rows:
        words = planted(r.doc_id, docs[r.doc_id])
        runs = brute_runs(words) if len(words) < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapsed(words, runs).encode()).hexdigest()


def test_edge_rows(spark):
    long = " ".join(["x"] * 10 + [f"u{i}" for i in range(300_000)] + ["a", "b", "c"] * 50_000)
    rows = [(1, None, "s"), (2, " \t\n", None), (3, long, "s"), (4, "a a a a a a", "s"), (4, "a a a a a a", "s"), (None, "One  two\tthree", None), (5, "a a a a a a a a a a a a", "s")]
    found = periodic_runs.find_runs(spark.createDataFrame(rows, DOCS))
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    told = {(r.doc_id, i): ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for i, r in enumerate(found.collect())}
    by_id = {k[0]: v for k, v in told.items()}
    assert by_id[1] == by_id[2] == ([], "", 0) and by_id[None] == ([], "One two three", 3)
    assert by_id[4] == ([(0, 6, 1)], "a", 6) and by_id[5] == ([(0, 6, 1)], "a a", 6) and len(told) == len(rows)
    assert by_id[3][0] == [(0, 10, 1), (300_010, 150_000, 3)] and by_id[3][1].endswith("u299999 a b c")
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(spark.createDataFrame(rows, DOCS), periodic_runs.RunParams(times=2))
