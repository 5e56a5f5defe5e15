"""The pipeline on a small table: every stage's decisions take effect; near copies, mixing and tokens are those of brute
force on what the stage before kept, and the scorer and the leaks are held against it in test_operators.py."""

import re
import zlib
from collections import Counter
from hashlib import md5
from itertools import combinations
from math import exp, factorial

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tracelake.llm import queries
from tracelake.llm.common import read, stored

SF = "/root/testdata/sf0.001"


def without_near_copies(texts):
    """The least identifier of each group of texts linked by five-word shingles of similarity 0.8."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in words.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations([i for i in sorted(texts) if sets[i]], 2):
        if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 100 * (common := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [i for i in texts if root(i) == i]


def mixed(sources):
    """Each identifier as often as a Poisson draw says, its source getting an equal share."""
    sizes, found = Counter(sources.values()), []
    for i, source in sources.items():
        u, rate = (int(md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13, len(sources) / len(sizes) / sizes[source]
        k, below = 0, 0.0
        while (below := below + exp(-rate) * rate**k / factorial(k)) < u:
            k += 1
        found += [i] * k
    return found


def test_stages_and_rows(spark):
    docs = read(spark, SF, "documents")
    counts = [docs.count()]
    wanted = {"ngram_jaccard": lambda rows: without_near_copies({r.doc_id: r.text for r in rows}), "source_mixing": lambda rows: mixed({r.doc_id: r.source for r in rows})}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF), f"test-{name}")
        assert kept.columns == docs.columns
        if name in wanted:
            assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted[name](docs.collect()))
        docs = kept
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > 0 and counts[3] <= counts[2]
    tokenizer, wanted, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == wanted


def test_stages_on_edge_rows(spark):
    """Null identifiers and texts, repeated rows and identifiers, ties, a long text, and columns with the operators' names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (4, "one two three four five six", "b"), (4, "seven eight nine ten eleven twelve", "b"), (6, "seven eight nine ten eleven twelve", None), (None, None, None), (None, "words without an identifier stand here too", "c"), (7, " \t\n", "a"), (7, " \t\n", "a")]
    clash = ["score", "predicted", "component_id", "n_shingles", "contaminated", "item_ids", "copy_no", "copies", "rate", "id", "row"]
    docs = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF), f"edge-{name}")
        assert kept.columns == docs.columns and all(r[c] == c for r in kept.select(*clash).collect() for c in clash)
        told = Counter((r.doc_id, r.text) for r in kept.collect())
        if name == "ngram_jaccard":  # the two texts of 4 are one group, into which 6 falls as a copy
            assert sum(n for (i, _), n in told.items() if i == 4) == 1 and (6, rows[5][1]) not in told and told[None, None] == told[None, rows[7][1]] == 1
            assert told[7, " \t\n"] == 2 and told[1, None] == told[2, ""] == told[3, long] == 1
        elif name in ("toxicity", "decontamination"):
            assert set(told) <= {(i, t) for i, t, _ in rows} and told[3, long] == 1 and told[None, None] == 1
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and set(queries.queries()) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
