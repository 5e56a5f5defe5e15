"""The ten operators against brute force, and their edge cases."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import chunks, common, decontamination, html_extraction, importance, mixing, ngram_jaccard, pii, quality_rules, token_output, toxicity, url_filters
from tracelake.llm.common import read

DOCS = "doc_id long, text string, source string"
TOKENS = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 30_000
EDGE = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, "one two", "b"), (4, "one two", "b"), (None, None, None), (5, " \t\n", "a"), (6, "the same text as seven here", "a"), (7, "the same text as seven here", "a")]


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def brute_components(texts, n, percent):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                common = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    label[i] = label[j] = min(label[i], label[j])
    return label, {i: len(s) for i, s in sets.items()}


def near_copies():
    rng, texts = random.Random(3), {}
    for group in range(6):
        base = words_of(rng, rng.choice([3, 12, 60, 300]))
        for _ in range(rng.choice([2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    passage = " ".join(words_of(rng, 40))
    for _ in range(30):  # a passage that many texts carry links none of them
        texts[len(texts)] = " ".join(words_of(rng, 60, 10**6)) + " " + passage
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "one", len(texts) + 3: "ONE"}
    return texts


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 70)])
def test_links_equal_brute_force(spark, n, percent):
    texts = near_copies()
    label, sizes = brute_components(texts, n, percent)
    params = ngram_jaccard.JaccardParams(n=n, percent=percent, heavy=5, often=3)
    rows = ngram_jaccard.link_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), params).collect()
    assert {r.doc_id: r.component_id for r in rows} == label
    assert {r.doc_id: r.n_shingles for r in rows} == sizes


def test_large_buckets_are_cut_into_blocks(spark):
    rng = random.Random(6)
    shared = words_of(rng, 96, 10**6)
    texts = {i: " ".join(shared + words_of(rng, 9, 10**6)) for i in range(300)}  # all meet, none link
    texts |= {300 + i: f"{texts[i]} tail" for i in range(0, 300, 10)}
    label, _ = brute_components({i: texts[i] for i in [*range(0, 300, 10), *range(300, 600, 10)]}, 5, 90)
    rows = ngram_jaccard.link_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ngram_jaccard.JaccardParams(percent=90)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: label.get(i, i) for i in texts}


def test_texts_of_one_identifier_are_linked(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(words_of(rng, 40, 10**6)) for _ in range(3))
    rows = [(7, a), (2, b), (3, a), (3, b), (3, b), (9, c), (9, ""), (5, c), (1, ""), (None, a), (8, None)]
    found = ngram_jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found) == sorted(
        [(7, 36, 2), (2, 36, 2), (3, 36, 2), (3, 36, 2), (3, 36, 2), (9, 36, 5), (9, 0, 5), (5, 36, 5), (1, 0, 1), (0, 36, None), (8, 0, 8)]
    )


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    found = sorted((r.doc_id or 0, r.text or "") for r in ngram_jaccard.drop_near_copies(docs).collect())
    assert found == sorted([(1, ""), (2, ""), (3, LONG), (4, "one two"), (0, ""), (5, " \t\n"), (6, "the same text as seven here")])


def test_block_tables_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    flips = [np.packbits(np.isin(np.arange(64), rng.choice(64, k, replace=False))) for k in rng.integers(0, 25, 400)]
    marks = np.concatenate([items ^ np.stack(flips), items[:20], items[[7, 7]]])
    for radius in (0, 3, 4, 11, 18, 19, 64):
        apart = np.bitwise_count(marks[:, None, :] ^ items[None, :, :]).sum(2)
        got = decontamination.BlockTables(items, decontamination.LeakParams(radius=radius)).within(marks)
        assert list(zip(*map(list, got))) == list(zip(*map(list, np.nonzero(apart <= radius))))
        assert sum(decontamination.LeakParams(radius=radius).tolerances()) == radius - 3


def test_radius_finds_edited_passages():
    """Passages of 20 to 200 words with words replaced, down to a similarity of 0.8: the radius loses fewer than one in twenty
    of the pairs that radius 64, which lets all through, verifies."""
    rng = np.random.default_rng(11)
    items, texts = [], []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(20, 201))]
        items.append((i, " ".join(words)))
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.002, 0.022))), replace=False):
            words[at] = "edited"
        texts.append(" ".join(["before"] * 9 + words + ["after"] * 9))
    found = {}
    for radius in (18, 64):
        rows = decontamination.LeakIndex(items, decontamination.LeakParams(radius=radius)).search(pa.array(texts))
        found[radius] = {(t, i): s for t, row in enumerate(rows) for i, (s, _) in row.items()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)):
        exact = {pair for pair, s in found[64].items() if low <= s < high}
        assert len(exact) > 20 and len(exact & found[18].keys()) >= 0.95 * len(exact), (low, len(exact), len(exact & found[18].keys()))
    assert found[18].items() <= found[64].items()


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = {i: words_of(rng, n, 10**6) for i, n in enumerate([6, 15, 30, 50])}
    docs = []
    for k in range(40):
        words, item = words_of(rng, rng.choice([0, 20, 200]), 10**6), items[k % 4]
        hidden = list(item)
        if k % 3 == 1:
            hidden[len(hidden) // 2] = "changed"
        docs.append((k, " ".join(words[:50] + (hidden if k % 5 else []) + words[50:])))

    def similarity(a, b, n=5):
        bag = lambda w: [tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)]
        x, y = bag(a), bag(b)
        common = sum(min(x.count(g), y.count(g)) for g in set(x))
        return common / (len(x) + len(y) - common)

    def brute(text):
        words = text.split()
        return [i for i, item in items.items() if any(similarity(words[p : p + len(item)], item) >= 0.8 for p in range(max(1, len(words) - len(item) + 1)) if words)]

    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {r.doc_id: r.item_ids for r in found} == {i: brute(t) for i, t in docs}
    in_blocks = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, decontamination.LeakParams(item_block=3))
    assert {r.doc_id: r.item_ids for r in in_blocks.collect()} == {i: brute(t) for i, t in docs}


def test_token_shards_round_trip(spark):
    rows = [(i, t) for i, t, _ in EDGE if i is not None] + [(99, "İstanbul <|ENDOFTEXT|> ΣΑΣ it's 42!")]
    tokenizer, params = Tokenizer.from_file(TOKENS), token_output.TokenParams(TOKENS)
    shards = token_output.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), params)
    wanted, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.read_digests(shards).collect())) == wanted
    files = [token_output.ShardReader(r.file) for r in shards.collect()]
    assert sum(len(f.lookup(token_output.key_of(4))) for f in files) == 2 and not any(f.lookup(token_output.key_of(12345)) for f in files)
    assert {r.doc_id: len(r.ids) for r in token_output.read_documents(shards).collect()}[2] == 1


def page(body, menu="<nav><ul><li><a href='/x'>Menu entry one two</a></li></ul></nav>"):
    return f"<html><head><title>T</title><script>var t='</p>';</script></head><body>{menu}{body}<footer>&copy; all rights kept by us here today</footer></body></html>"


def test_articles_and_unique_runs(spark):
    same = "<div>share this page with all of your friends now</div>"
    rows = [
        (1, "http://h.test/1", page("<article><h1>Head &amp; line</h1><p>Some\n <b>bold</b>   text<p>next<br>line<div class='comments'>not me</div></article>")),
        (2, "http://h.test/2", page(f"<div>alpha beta gamma</div>{same}")), (3, "http://h.test/3", page(f"<div>delta epsilon zeta</div>{same}")),
        (4, None, None), (5, "http://h.test/5", ""),
    ]
    found = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == ("Head & line\nSome bold text\nnext line", 36)
    assert found[2][0] == "alpha beta gamma" and found[3][0] == "delta epsilon zeta"
    assert found[4] == found[5] == ("", 0)


def test_repeats_inside_articles_go_and_copies_stay(spark):
    rng, plate = random.Random(7), " ".join(f"plate{i}" for i in range(15))
    own = [" ".join(words_of(rng, 60, 10**6)) for _ in range(5)]
    rows = [(i, f"http://h.test/{i}", page(f"<article><p>{t}</p><div>{plate}</div></article>")) for i, t in enumerate(own)]
    rows += [(10 + i, "http://h.test/c", page(f"<article><p>{own[0]}</p><div>{plate}</div></article>", f"<nav>menu {i}</nav>")) for i in range(4)]
    near = words_of(rng, 80, 10**6)
    rows += [(20 + i, "http://near.test/", page(f"<article>{' '.join([*near[:40], f'edit{i}', *near[40:]])}</article>")) for i in range(4)]
    rows += [(30 + i, "http://near.test/", page(f"<article>{' '.join(words_of(rng, 80, 10**6))}</article>")) for i in range(9)]
    found = {r.page_id: (r.text, r.n_repeated) for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i][0] == t and found[i][1] >= 15 for i, t in enumerate(own))
    assert all(found[10 + i][0] == own[0] for i in range(4))
    assert all(found[20 + i][0] == " ".join([*near[:40], f"edit{i}", *near[40:]]) for i in range(4))


def test_related_headlines_leave_the_headlines(spark):
    rng = random.Random(9)
    heads = [" ".join(words_of(rng, 14, 10**6)) for _ in range(6)]
    rows = [(i, "http://h.test/", page(f"<article><h1>{heads[i]}</h1><p>{' '.join(words_of(rng, 40, 10**6))}</p></article><div>{' '.join(f'<p>{h}</p>' for h in heads)}</div>")) for i in range(6)]
    found = {r.page_id: r.text for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i].split("\n")[0] == heads[i] and len(found[i].split()) == 54 for i in range(6))


def brute_texts(rows, length=8, run=12, pages=3):
    """Main texts by the sets of main texts that hold each tuple of `length` tokens."""
    parsed = {i: (re.sub(r"^.*?://([^/]*).*", r"\1", url), *html_extraction.page_blocks(html)) for i, url, html in rows}
    main = {i: tuple(inside or [t for t, a in outside if not a]) for i, (_, inside, outside) in parsed.items()}
    held, hosts = {}, {}
    for i, (host, inside, outside) in parsed.items():
        hosts.setdefault(host, set()).add(main[i])
        for kind, stream in (("in", inside), ("out", [t for t, _ in outside])):
            words = " ".join(stream).split()
            for k in range(len(words) - length + 1):
                held.setdefault((host, kind, *words[k : k + length]), set()).add(main[i])
    out = {}
    for i, (host, inside, outside) in parsed.items():
        def left(blocks, least, run, kind="in"):
            words, at, lines = " ".join(blocks).split(), 0, []
            mark = [any(len(held[host, kind, *words[k : k + length]]) >= least for k in range(max(0, p - length + 1), min(p, len(words) - length) + 1)) for p in range(len(words))]
            runs = "".join("x" if m else "." for m in mark)
            runs = re.sub("x+", lambda m: m[0] if len(m[0]) >= run else "." * len(m[0]), runs)
            for b in blocks:
                n = len(b.split())
                lines.append(" ".join(w for w, m in zip(b.split(), runs[at : at + n]) if m == "."))
                at += n
            return lines, runs.count("x")
        rest, n = left([t for t, _ in outside], 2, length, "out")
        lines = [x for x, (_, apart) in zip(rest, outside) if not apart]
        if inside:
            lines, more = left(inside, pages, run)
            if 2 * more > len(" ".join(inside).split()):
                lines, more = left(inside, max(pages, len(hosts[host]) / 2), run)
            n += more
        out[i] = ("\n".join(x for x in lines if x), n)
    return out


@pytest.mark.parametrize("range_keys", [300, 4_000_000])
def test_main_texts_equal_brute_force(spark, monkeypatch, range_keys):
    monkeypatch.setattr(chunks, "RANGE_KEYS", range_keys)
    rng = random.Random(11)
    passages = [" ".join(words_of(rng, rng.choice([6, 9, 14, 30]))) for _ in range(8)]
    rows = []
    for i in range(60):
        host, tag = rng.choice(["a", "b", "c"]), rng.choice(["article", "div"])
        blocks = [" ".join(words_of(rng, rng.choice([3, 20, 60]), 10**6)) for _ in range(3)] + rng.sample(passages, rng.choice([0, 1, 3]))
        rng.shuffle(blocks)
        rows.append((i, f"http://{host}.test/{i}", page(f"<{tag}>{''.join(f'<p>{b}</p>' for b in blocks)}</{tag}>")))
    rows += [(100 + i, "http://a.test/copy", rows[i % 7][2]) for i in range(20)]
    found = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    wanted = brute_texts(rows)
    assert {r.page_id: (r.text, r.n_repeated) for r in found} == wanted and sum(n for _, n in wanted.values()) > 500
    assert all(r.n_chars == len(r.text) for r in found)


def test_footer_of_a_large_host_is_split(spark):
    foot = " ".join(f"foot{k}" for k in range(12))
    rows = spark.range(10_000).select("id", F.lit("http://big.test/").alias("url"), F.concat(F.lit("<div>own"), F.col("id").cast("string"), F.lit(f"</div><div>{foot}</div>")).alias("html"))
    assert html_extraction.extract_text(rows.repartition(8)).filter("text = concat('own', id) and n_repeated = 12").count() == 10_000


def test_mixing_equals_brute_force(spark):
    from math import exp, factorial
    from hashlib import md5

    docs = [(i, "t", "a" if i < 90 else None) for i in range(120)]
    found = {(r.doc_id): r.n for r in mixing.replicate(spark.createDataFrame(docs, DOCS)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for i, _, source in docs:
        u = (int(md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13
        rate, k, below = 120 * 0.5 / (90 if source else 30), 0, 0.0
        while (below := below + exp(-rate) * rate**k / factorial(k)) < u:
            k += 1
        assert found.get(i, 0) == k


def test_importance_prefers_the_target(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(words_of(rng, 60, 30) if i % 2 else [f"z{rng.randrange(30)}" for _ in range(60)])) for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    kept = [r.doc_id for r in rows if r.kept]
    assert len(kept) == 50 and sum(i % 2 for i in kept) >= 48 and sorted(r["rank"] for r in rows) == list(range(1, 101))


@pytest.mark.parametrize("range_keys", [100, 4_000_000])
def test_importance_equals_brute_force(spark, monkeypatch, range_keys):
    from collections import Counter
    from hashlib import md5
    from math import log

    rng = random.Random(2)
    docs = [(i, " ".join(words_of(rng, 300, 10**6 if i % 2 else 40))) for i in range(60)] + [(60, None), (61, "")]
    labels = [(i, i % 3 == 0) for i in range(40)]
    grams = {i: [(w,) for w in (t or "").split()] + list(zip((t or "").split(), (t or "").split()[1:])) for i, t in docs}
    raw = Counter(g for x in grams.values() for g in x)
    wanted = Counter(g for i, y in labels if y for g in grams[i])
    assert len(raw) > 10_000
    ratio = {g: log((wanted[g] + 1) / (wanted.total() + len(raw))) - log((raw[g] + 1) / (raw.total() + len(raw))) for g in raw}
    monkeypatch.setattr(chunks, "RANGE_KEYS", range_keys)
    params = importance.ResampleParams(spare_bits=40)
    rows = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, quality int"), params).collect()
    assert {r.doc_id: r.n_grams for r in rows} == {i: len(x) for i, x in grams.items()}
    wanted_ratio = {i: sum(ratio[g] for g in x) for i, x in grams.items()}
    assert all(abs(r.log_ratio - wanted_ratio[r.doc_id]) < 1e-5 for r in rows)
    draw = {i: (int(md5(f"resample|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13 for i in grams}
    key = {i: wanted_ratio[i] - log(-log(draw[i])) for i in grams}
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] == sorted(grams, key=lambda i: -key[i])
    assert sum(r.kept for r in rows) == round(len(docs) * 14 / 40) and all(r.kept == (r["rank"] <= 22) for r in rows)


def chunk_of_texts(n_texts):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(200_000)])
    texts = [" ".join(words[(200_000 * rng.random(300) ** 3).astype(int)]) if i % 50 else None for i in range(n_texts)]
    return pa.RecordBatch.from_arrays([pa.array(range(n_texts)), pa.array([i % 7 == 0 for i in range(n_texts)]), pa.array(texts, pa.string())], ["row", "wanted", "text"])


def test_importance_chunk_of_several_slices_equals_brute_force():
    from collections import Counter

    rows = chunk_of_texts(1500)
    assert rows.column(2).nbytes > 2.5 * common.SLICE_BYTES
    grams = [[*x, *zip(x, x[1:])] for x in ((t or "").split() for t in rows.column(2).to_pylist())]
    raw, wanted = Counter(g for x in grams for g in x), Counter(g for x, y in zip(grams, rows.column(1).to_pylist()) if y for g in x)
    found = importance._Grams(rows, 64, places=True)
    assert (np.diff(found.keys.astype(object)) > 0).all()
    assert Counter(zip(found.raw.tolist(), found.wanted.tolist())) == Counter((n, wanted[g]) for g, n in raw.items())
    sums, n = found.sums(found.raw, rows.num_rows)
    assert sums.tolist() == [sum(raw[g] for g in x) for x in grams] and n.tolist() == [len(x) for x in grams]


def test_importance_holds_few_bytes_for_each_gram_of_a_chunk():
    import tracemalloc

    rows = chunk_of_texts(5000)
    tracemalloc.start()
    found = importance._Grams(rows, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * found.raw.sum()


def test_rows_of_a_batch_become_python_values_one_at_a_time():
    batch = pa.RecordBatch.from_pydict({"chunk": [1, 2, 3], "rows": [b"a", None, b"c"]})
    assert list(chunks.single(iter([batch, batch.slice(0, 0)]))) == batch.to_pylist()


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "labels")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    high, low = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low]) > 0.93


def brute_features(text, params):
    """Words (1 if there) and stems (how dense), by their names."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    bare = [w.strip(".,;:!?\"'()[]{}*#%$&|<>-_/\\") for w in words]
    found = {w: 1.0 for w in bare if w}
    for k in params.stems:
        stems = [w[:k] for w in bare if len(w) >= k]
        for x in set(stems):
            found[f"{k}^{x}"] = max(1, min(64, 64 * params.dense * stems.count(x) // len(words))) / 64
    return found


def test_toxicity_equals_brute_force(spark):
    from math import exp, log, sqrt

    rng, params = random.Random(8), toxicity.PuParams(steps=40)
    docs = [(i, " ".join(words_of(rng, 30, 60) + (["Vile!", "nastiness", f"nasty{i}"] if i % 4 == 0 else []))) for i in range(240)] + [(999, ""), (1000, None)]
    free = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    labels = [(i, int(i % 4 == 0)) for i in range(0, 200)]
    known = [(i, y) for i, y in labels if free(i)]
    prior = sum(y for _, y in known) / len(known)
    feats = {i: brute_features(t, params) for i, t in docs}
    pos, unl = [i for i, y in known if y], [i for i, _ in docs if free(i)]
    names = sorted({f for i in unl for f in feats[i]})
    mean = lambda f, ids: sum(feats[i].get(f, 0) for i in ids)
    z = {f: (p := (mean(f, pos) + mean(f, unl) + 1) / (len(pos) + len(unl) + 2)) and abs(mean(f, pos) / len(pos) - mean(f, unl) / len(unl)) / sqrt(p * (1 - p) * (1 / len(pos) + 1 / len(unl))) for f in names}
    picked = [f for f in names if z[f] >= params.min_z]
    x_p, x_u = (np.array([[feats[i].get(f, 0.0) for f in picked] for i in ids]) for ids in (pos, unl))
    w, b, m, v = np.zeros(len(picked)), log(prior / (1 - prior)), np.zeros(len(picked) + 1), np.zeros(len(picked) + 1)
    sigmoid = lambda s: 1 / (1 + np.exp(-s))
    for t in range(1, params.steps + 1):
        s_p, s_u = x_p @ w + b, x_u @ w + b
        plus = prior * (sigmoid(s_p) - 1) / len(pos)  # gradient of prior * mean loss of positives as positives
        minus_p, minus_u = -prior * sigmoid(s_p) / len(pos), sigmoid(s_u) / len(unl)
        rest = np.log1p(np.exp(s_u)).mean() - prior * np.log1p(np.exp(s_p)).mean()
        g_p, g_u = (plus + minus_p, minus_u) if rest >= 0 else (-minus_p, -minus_u)
        grad = np.append(x_p.T @ g_p + x_u.T @ g_u + params.l2 * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = params.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    low, high = -40.0, 40.0  # the bias at which the unlabelled texts are toxic at the prior
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if sigmoid(x_u @ w + b).mean() < prior else (low, b)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), params)
    rows = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model, params).collect()}
    assert len(model.keys) == len(picked) >= 3
    for i, _ in docs:
        assert abs(rows[i] - 1 / (1 + exp(-(sum(w[k] * feats[i].get(f, 0) for k, f in enumerate(picked)) + b)))) < 1e-6
    assert abs(np.mean([rows[i] for i in unl]) - prior) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None), (None, 1)], [(i, 1) for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]])
def test_nothing_is_toxic_without_usable_labels(spark, rows):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert toxicity.score(docs, model).filter("predicted = 0").count() == 40


def test_toxicity_samples_rows(spark, monkeypatch):
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, f"text {k % 7}") for i in free[:2] for k in range(40)], "doc_id long, text string")
    labels, sizes = spark.createDataFrame([(free[0], 1), (free[1], 0)], "doc_id long, toxic int"), []
    monkeypatch.setattr(toxicity, "train", lambda mark, rows, cols, values, k, *a: sizes.append((int(mark.sum()), int((~mark).sum()))) or (np.zeros(k), 0.0))
    toxicity.fit(docs, labels, toxicity.PuParams(max_positive=30, max_unlabelled=50))
    assert sizes == [(30, 50)]


def test_rare_lines_stay_and_frequent_go(spark):
    text = "\n".join(["a line on every page {0}", "own words " + " ".join(f"q{i}" for i in range(30)) + " {1}"])
    docs = [(i, text.format(7, "mine" + "abcdefghijklmnopqrstuvwxy"[i]), "h") for i in range(25)]
    rows = quality_rules.clean_documents(spark.createDataFrame(docs, DOCS)).collect()
    assert all(r.kept and r.removed_words == 6 and "every page" not in r.clean_text for r in rows)


def test_depleted_documents_are_rejected(spark):
    common = [" ".join(f"common{k}x{j}" for j in range(12)) for k in range(4)]
    docs = [(i, "\n".join([*common, f"own words {'abcdef'[i]}"] if i < 6 else [common[0], " ".join(words_of(random.Random(i), 40, 10**6))]), "h") for i in range(30)]
    docs += [(100 + i, "\n".join(common), "rare") for i in range(4)]  # four copies are not many on any host
    rows = {r.doc_id: r for r in quality_rules.score_documents(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(not r.base_failed for r in rows.values())
    assert {i for i, r in rows.items() if not r.kept} == set(range(6)) and rows[0].removed_words == 48 and rows[7].removed_words == 12 and rows[100].removed_words == 0


def brute_told(texts, threshold=0.7, context=80):
    """Terms that disclose a value, the domain of an address or a kind, for texts whose spans are plain addresses and cards."""
    from collections import defaultdict
    from math import log

    terms = lambda t: {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3}
    beside, of_entity, of_term = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        for t in terms(text):
            of_term[t].add(i)
        found = [("email", m) for m in re.finditer(r"[a-z0-9.]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", text)] + [("card", m) for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text)]
        own = terms(" ".join(m[0] for _, m in found))
        for kind, m in found:
            words = [w for w in re.finditer(r"[^\W\d_]+", text) if len(w[0]) >= 3 and (m.start() - context <= w.start() and w.end() <= m.start() or m.end() <= w.start() and w.end() <= m.end() + context)]
            for entity in [f"{kind}:{m[0]}"] + ([f"email:@{m[0].split('@')[1]}"] if kind == "email" else []):
                of_entity[entity].add(i)
                for w in words:
                    beside[entity, w[0].lower()].add(i)
            of_entity[kind].add(i)
            for t in terms(text) - own:
                beside[kind, t].add(i)
    n = len(texts)
    share = lambda e, t, c: log(c * n / (len(of_entity[e]) * len(of_term[t]))) / log(n / len(of_entity[e])) * c / (c + 1)
    return {t for (e, t), docs in beside.items() if len(of_entity[e]) < n and share(e, t, len(docs)) >= threshold}


def test_disclosing_terms_equal_brute_force(spark):
    rng, texts = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 3, 4])))
    for i in range(300):
        words = [word() for _ in range(rng.choice([5, 40]))]
        if i % 10 == 0:  # each card stands in one document; the word beside it gives the kind away
            words[2:2] = ["cardholder", "4929348385146306" if i % 20 else "4412473014894482"]
        if i % 15 == 1:
            words[3:3] = ["postmaster", f"box{i % 4}@mail{i % 2}.test.org"]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.term for r in pii.disclosing_terms(docs).collect()}
    assert found == brute_told(texts) and {"cardholder", "postmaster"} <= found
    spans = {r.doc_id: [(texts[r.doc_id][x.start : x.end], x.m) for x in r.terms] for r in pii.find_spans(docs).collect()}
    outside = [re.sub(r"\S+@\S+", lambda m: "." * len(m[0]), t) for t in texts]
    assert spans == {i: [(m[0], m[0]) for m in re.finditer("[a-z]+", t) if m[0] in found] for i, t in enumerate(outside)}
    assert sum(map(len, spans.values())) >= 50


def test_terms_beside_an_entity_are_found(spark):
    docs = [(i, f"secretname wrote to jo@mail.example.com about item{i}" if i < 5 else f"common words about item{i}") for i in range(60)]
    rows = {r.doc_id: r.clean_text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "jo@mail" not in rows[0] and "secretname" not in rows[0] and rows[30] == "common words about item30"


def test_listed_urls_and_rules(spark):
    urls = ["https://Cheap-Pills.example.com/x", "http://a.cheap-pills.example.com/y?z", "http://cheap-pills.example.com.evil.org/x", "http://x.example.net/en/1", "http://x.net/", "http://net", None, "nothing"]
    listed = spark.createDataFrame([(u,) for u in url_filters.LISTED], "url string")
    rows = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), listed).orderBy("page_id").collect()
    assert [r.verdict for r in rows] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert [r.rule for r in rows] == [None, None, None, "example.net/en/", "net/", None, None, None]


def test_listed_urls_equal_brute_force(spark):
    """Some thousand listed URLs of several depths fill many blocks of the filter; it loses none, and the join removes what it
    passes wrongly."""
    rng = random.Random(5)

    def url(hosts, depth):
        return rng.choice(hosts) + "".join("/" + rng.choice("abc") for _ in range(rng.randrange(depth + 1))) + rng.choice(["", "/"])

    hosts = [f"{a}{n}.example.edu" for a in ("h", "x.h") for n in range(700)]
    listed = sorted({u if "/" in u else u + "/" for u in (url(hosts, 4) for _ in range(3000))})
    pages = [f"https://{url(hosts, 6)}?q#f" for _ in range(1500)]

    def brute(page):
        host, slash, path = page.split("://")[1].split("?")[0].partition("/")
        path = slash + path
        labels = host.split(".")
        own = {".".join(labels[i:]) for i in range(len(labels))}
        return "block" if path and any(u.partition("/")[0] in own and (path == "/" + u.partition("/")[2] or path.startswith("/" + u.partition("/")[2].rstrip("/") + "/" if u.partition("/")[2].rstrip("/") else "/")) for u in listed) else "allow"

    wanted = [brute(p) for p in pages]
    rows = url_filters.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id int, url string"), spark.createDataFrame([(u,) for u in listed], "url string"), rules=[]).orderBy("page_id").collect()
    assert [r.verdict for r in rows] == wanted and 200 < wanted.count("block") < 1300
    _, n_blocks = url_filters.bloom_filter(spark.createDataFrame([(u,) for u in listed], "key string"), len(listed))
    assert n_blocks > 100


CALLS = {
    "quality": lambda s, d: quality_rules.score_documents(d), "clean": lambda s, d: quality_rules.clean_documents(d),
    "html": lambda s, d: html_extraction.extract_text(d, url_col="source", html_col="text"),
    "leaks": lambda s, d: decontamination.find_leaks(d, s.createDataFrame([(1, "some benchmark text with words"), (2, None), (None, "same text as seven here")], "item_id long, text string")),
    "clean_benchmark": lambda s, d: decontamination.find_leaks(d, s.createDataFrame([], "item_id long, text string")),
    "mix": lambda s, d: mixing.replicate(d), "tokens": lambda s, d: token_output.read_digests(token_output.write_shards(d, token_output.TokenParams(TOKENS))),
    "urls": lambda s, d: url_filters.judge_urls(d, s.createDataFrame([(u,) for u in url_filters.LISTED], "url string"), url_col="text"),
    "pii": lambda s, d: pii.find_spans(d), "sanitise": lambda s, d: pii.sanitise(d), "links": lambda s, d: ngram_jaccard.link_components(d),
    "near": lambda s, d: ngram_jaccard.drop_near_copies(d),
    "importance": lambda s, d: importance.resample(d, s.createDataFrame([(3, 1), (4, 0), (None, 1)], "doc_id long, quality int")),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(3, 1), (4, 0), (None, 1)], "doc_id long, toxic int"))),
}
#: Names that operators use inside, or return.
CLASHES = "kept score copy_no clean_text component_id contaminated rank host n_words cdf rate low k of name row copies mix_source hit_id hit_terms hit_url pii_text told base terms url path rule verdict id item_ids similarity log_ratio n_grams gumbel_key __row __at chunk replies n_chars n_repeated predicted removed sign html text_ wanted raw".split()


@pytest.mark.parametrize("name", sorted(CALLS))
def test_edge_rows_empty_tables_and_clashing_columns(spark, name):
    """Null, empty and long texts, null keys, repeated rows and columns of clashing names: the results are those without the
    clashing columns, and these keep their values where the operator gives no column of that name."""
    plain = spark.createDataFrame(EDGE, DOCS)
    docs = plain.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    found, clean = CALLS[name](spark, docs), CALLS[name](spark, plain)
    own = [c for c in clean.columns]
    through = [c for c in found.columns if c not in own]
    rows = found.collect()
    assert sorted(str([r[c] for c in own]) for r in rows) == sorted(str(list(r)) for r in clean.collect())
    assert all(r[c] == "x" for r in rows for c in through) and (not through or set(CLASHES) - set(own) == set(through))
    if name == "near":
        assert len(rows) == 7
    elif name != "mix":
        assert len(rows) == len(EDGE)
    assert CALLS[name](spark, docs.limit(0)).count() == 0


def test_edge_rows_have_defined_values(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    got = {n: sorted((r.asDict() for r in CALLS[n](spark, docs).collect()), key=lambda r: (r.get("doc_id") is None, r.get("doc_id") or 0)) for n in ("quality", "leaks", "clean_benchmark", "links", "importance", "toxicity", "sanitise", "urls", "html")}
    assert [r["n_words"] for r in got["quality"]] == [0, 0, 30_000, 2, 2, 0, 6, 6, 0] and not any(r["kept"] for r in got["quality"])
    assert [r["item_ids"] for r in got["leaks"]] == [[], [], [], [], [], [], [None], [None], []] and [r["contaminated"] for r in got["leaks"]] == [False] * 6 + [True, True, False]
    assert not any(r["contaminated"] or r["similarity"] for r in got["clean_benchmark"])
    assert [(r["component_id"], r["n_shingles"]) for r in got["links"]] == [(1, 0), (2, 0), (3, 1), (4, 1), (4, 1), (5, 0), (6, 2), (6, 2), (None, 0)]
    assert [r["n_grams"] for r in got["importance"]] == [0, 0, 59_999, 3, 3, 0, 11, 11, 0] and sorted(r["rank"] for r in got["importance"]) == list(range(1, 10))
    assert len({r["score"] for r in got["toxicity"] if r["doc_id"] in (1, 2, 5, None)}) == 1
    assert [r["clean_text"] for r in got["sanitise"]] == [x or "" for _, x, _ in sorted(EDGE, key=lambda r: (r[0] is None, r[0] or 0))]
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == ("", "", None, "allow") for r in got["urls"])
    assert [r["text"] for r in got["html"]][:4] == ["", "", LONG.strip(), "one two"]
