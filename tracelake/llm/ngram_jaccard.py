"""Operator 8, n-gram Jaccard join: PartEnum signatures.

The shingle domain is hashed into first-level parts and each of these into second-level parts; a signature is the subset
of a set's shingles that fall in all but one of the second-level parts of a first-level part. Sets are compared within
bands of sizes: in the band of a pair the symmetric difference is at most k, and there are so many first-level parts that
more than `spare` of them hold one differing shingle at most. So two sets that reach the similarity share a signature in
a band that both belong to.

A subset without shingles says nothing, and one that more than `heavy` sets share (a passage that many texts carry) is
not used. A set for which that silences more than `spare` parts of a band is stuck: it adds the prefix of its shingles,
the rarest first, in which it must meet any linked set that is stuck too. A pair of which one side is not stuck meets in a
signature that is used. So no link is lost, and a frequent passage makes no pairs.

Copies (equal word sequences) form a class with the least identifier as its representative; only representatives are
joined. In a bucket of equal signatures, representatives that are not yet in one component are compared with the bucket's
leader, for a few rounds with other leaders; then every pair of a bucket whose two sides are still in different components
is compared, a large bucket in blocks. Pairs inside one component cannot change the result and are left out. Candidates are verified on the exact
sets.

Defined results: a null text is an empty text; a text without words has an empty set, size 0, and is linked with
nothing (its component is its own identifier); a text with fewer words than a shingle is one shingle. Rows repeated
under one identifier are one node if their words are equal, and linked through the identifier if not; each keeps its row.
Rows with a null identifier have no component (null) and link nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.packaging import ship

from .common import Words, global_rank, list_array, mix, shingle_sets, slices, stored
from .components import connected_components


@dataclass(frozen=True)
class JaccardParams:
    """Two sets are linked if 100 * intersection >= percent * union, over shingles of n words. rounds: of leaders before
    all pairs that are left. heavy: more sets than that with one signature make it useless. often: a signature of more sets
    than that in one step of a task is salted."""

    n: int = 5
    percent: int = 80
    lower: bool = True
    rounds: int = 1
    heavy: int = 64
    often: int = 8


#: The number of 64-bit words of a parity print, of salts, and the columns of a print.
LANES = 8
SALTS = 1024
PRINT = [f"p{i}" for i in range(LANES)]
#: The bits of a signature that hold its band, and the mark of a set that its signatures may not suffice for.
BAND, STUCK = np.uint64(63), np.uint64(63)
#: Sets of a bucket that are compared pair by pair in one place.
BLOCK = 128
#: Sizes are cut into bands that grow by this factor.
GROWTH = 1.35


def band_edge(i: int) -> int:
    """The least size of band i."""
    return ceil(GROWTH**i - 1e-9)


def bands_of(size: int, percent: int) -> list[int]:
    """The bands in which a set has signatures: its own, and the next ones in which a linked set can be."""
    i = max(0, floor(log(size) / log(GROWTH)) - 1)
    while band_edge(i + 1) <= size:
        i += 1
    found = [i]
    while 100 * size >= percent * band_edge(found[-1] + 1):
        found.append(found[-1] + 1)
    return found


def most_apart(band: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of the band: (1 - g) / (1 + g) * (|a| + |b|)."""
    return 2 * (band_edge(band + 1) - 1) * (100 - percent) // (100 + percent)


def signatures(values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set of sorted distinct hashes, and for each how many more subsets of its band may be silent.

    The last six bits of a signature are its band. k differing shingles leave, of k // 2 + 1 + spare first-level parts,
    more than `spare` parts with one of them at most, and there one of the two second-level subsets is equal on both
    sides. A set that has more than `spare` parts with an empty subset adds the signature STUCK."""
    found, slack, stuck = [], [], False
    for band in bands_of(len(values), percent):
        k = most_apart(band, percent)
        spare = k // 5 + 1
        parts = k // 2 + 1 + spare
        seed = np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64)
        spread = mix(values ^ seed)
        place = ((spread >> np.uint64(20)) % np.uint64(2 * parts)).astype(np.int64)
        cells = np.zeros(2 * parts, np.uint64)
        np.add.at(cells, place, spread | np.uint64(1))
        full = np.bincount(place, minlength=2 * parts) > 0
        silent = parts - int((full[0::2] & full[1::2]).sum())
        stuck |= silent > spare
        at = np.flatnonzero(full)
        found.append(mix(cells[at] ^ mix(seed + at.astype(np.uint64))) & ~BAND | np.uint64(band))
        slack.append(np.full(len(at), spare - silent))
    if stuck:
        found.append(np.array([STUCK], np.uint64)), slack.append(np.array([0]))
    return np.concatenate(found), np.concatenate(slack)


def parity(values: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """64 * lanes bits, each the parity of the number of shingles that fall on it: two sets differ in as many shingles at
    least as these differ in bits."""
    at = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * lanes)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * lanes) & 1).view(np.int64)


def wide_parity(values: np.ndarray) -> np.ndarray | None:
    """A parity print of a bit or more for each shingle, for sets of which the short one would be full."""
    lanes = -(-len(values) // 64)
    return parity(values, 1 << (lanes - 1).bit_length()) if lanes > LANES else None


def _sets(batches: Iterator[pa.RecordBatch], params: JaccardParams) -> Iterator[pa.RecordBatch]:
    """Size, parity print and digest of the words of each text."""
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column(1), params.lower)
            sets = shingle_sets(words, params.n)
            prints = np.stack([parity(x) for x in sets])
            codes = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
            digest = pa.array([xxhash.xxh3_128_hexdigest(codes[a:b].tobytes()) for a, b in zip(words.starts, words.starts[1:])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array([len(x) for x in sets], np.int64)), digest, *(pa.array(prints[:, i]) for i in range(LANES)), pa.array([wide_parity(x) for x in sets], pa.list_(pa.int64()))], ["id", "n", "digest", *PRINT, "wide"])


def _signed(batches: Iterator[pa.RecordBatch], params: JaccardParams) -> Iterator[pa.RecordBatch]:
    """(sign, salt, id, slack). A signature that is frequent among the texts of one step is salted, so that its rows are
    dealt to many tasks; two rows without identifier then stand for it where its other rows go."""
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(Words(part.column(1), params.lower), params.n)
            pairs = [signatures(s, params.percent) if len(s) else (s, s.astype(np.int64)) for s in sets]
            signs, slack = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in (0, 1))
            owner = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
            _, first, back, count = np.unique(signs, return_index=True, return_inverse=True, return_counts=True)
            salt = np.where(count[back] > params.often, 1 + owner % SALTS, 0)
            stand = np.repeat(first[count > params.often], 2)
            order = np.concatenate((np.arange(len(signs)), stand))
            ids = part.column(0).take(pa.array(np.append(owner, np.full(len(stand), -1)), mask=np.append(np.zeros(len(owner), bool), np.ones(len(stand), bool))))
            salt = np.append(salt, np.zeros(len(stand), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signs[order].view(np.int64)), pa.array(salt.astype(np.int32)), ids, pa.array(slack[order].astype(np.int32))], ["sign", "salt", "id", "slack"])


def _items(batches: Iterator[pa.RecordBatch], params: JaccardParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), list_array(shingle_sets(Words(part.column(1), params.lower), params.n), pa.int64())], ["id", "items"])


def _sets_of(ids: DataFrame, named: DataFrame, params: JaccardParams, name: str) -> DataFrame:
    """(id, items): the shingles of some documents, stored."""
    found = named.join(ids, "id", "left_semi").mapInArrow(lambda it: _items(it, params), "id long, items array<bigint>")
    return stored(found.filter("size(items) > 0"), name)


def _rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(sign, id, lead, more): the rarest shingles of each set, as many as a linked set cannot do without all of."""
    cells = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = cells.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    ranked = cells.join(often, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("item").alias("h"), "item"))).alias("x"))  # a set is bounded by its text
    short = F.slice("x", F.lit(1), F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1)
    found = ranked.select("id", F.explode(F.filter(short, lambda x: x["df"] > 1)).alias("x"))
    found = stored(found.select(F.xxhash64(F.col("x.item"), F.lit("prefix")).alias("sign"), "id"), "prefixes")
    leads = found.groupBy("sign").agg(F.min("id").alias("lead"), (F.count(F.lit(1)) > 2).alias("more"))
    return found.join(leads, "sign").select("sign", "id", "lead", "more")


def _pairs_in_blocks(rows: DataFrame) -> DataFrame:
    """The pairs of each bucket, of different labels. A bucket of more than BLOCK sets is cut into blocks by a hash, and every
    two blocks meet under a key of their own, so that no task has a whole bucket."""
    sizes = stored(rows.groupBy("sign").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = rows.join(sizes, "sign").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    left = rows.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))).drop("block", "blocks")
    right = rows.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), "block")))
    right = right.select("sign", "i", "j", F.col("id").alias("lead"), F.col("n").alias("m"), F.col("label").alias("lead_label"), *[F.col(p).alias(p.replace("p", "q")) for p in PRINT])
    return left.join(right, ["sign", "i", "j"]).filter("(i < j or id < lead) and label <> lead_label")


def _verified(pairs: DataFrame, named: DataFrame, params: JaccardParams) -> DataFrame:
    """The linked pairs among (u, v), by the exact sets."""
    sets = _sets_of(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct(), named, params, "items")
    a = sets.select(F.col("id").alias("u"), F.col("items").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("items").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    linked = 100 * F.col("common") >= params.percent * (F.size("a") + F.size("b") - F.col("common"))
    return stored(both.filter(linked).select("u", "v"), "links")


def _size_fits(percent: int) -> Column:
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _print_fits(percent: int) -> Column:
    """Whether the parity prints p0, p1, ... and q0, q1, ... leave room for the similarity."""
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(p.replace("p", "q")))) for p in PRINT), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))


def _wide_fits(percent: int) -> Column:
    """The same for the wide prints a and b of sets of sizes n and m; the longer one is folded to the length of the other."""
    short = F.least(F.size("a"), F.size("b"))
    fold = lambda c: F.when(F.size(c) > short, F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(fold("a"), fold("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")), F.lit(True))


def link_components(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier, n_shingles, class_id (the least identifier with the same set) and
    component_id (the least identifier that links lead to, its own included)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = ["n_shingles", "class_id", "component_id"]
    again = stored(rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("id"), "again")
    if again.isEmpty():
        return _linked(rows, params).select(F.col("id").alias(id_col), *names)
    # each text of an identifier becomes a node of its own, numbered in the order of the identifiers; then they are linked
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    nodes = global_rank(rows.filter("id is not null").select("id", "h").distinct(), [F.col("id"), F.col("h")], "nodes")
    nodes = stored(nodes.select(F.col("id").alias("of"), F.col("h").alias("of_h"), F.col("rank").alias("node")), "node-names")
    named = rows.join(nodes, (F.col("id") == F.col("of")) & (F.col("h") == F.col("of_h")), "left").select(F.col("node").alias("id"), "text")
    found = stored(_linked(named, params), "linked")
    of_node = found.filter("id is not null").select(F.col("id").alias("node"), "component_id").distinct().join(nodes.select("node", "of"), "node")
    firsts = of_node.groupBy("of").agg(F.min("component_id").alias("first"))
    edges = of_node.join(again.select(F.col("id").alias("of")), "of", "left_semi").join(firsts, "of").select(F.col("component_id").alias("u"), F.col("first").alias("v"))
    joined = stored(connected_components(edges.filter("u <> v").distinct()), "joined")
    found = found.join(joined.select(F.col("node").alias("component_id"), F.col("component").alias("wider")), "component_id", "left").withColumn("component_id", F.coalesce("wider", "component_id"))
    for column in ("id", "class_id", "component_id"):
        names_of = nodes.select(F.col("node").alias(column), F.col("of").alias(f"{column}_of"))
        found = found.join(names_of, column, "left").drop(column).withColumnRenamed(f"{column}_of", column)
    return found.select(F.col("id").alias(id_col), *names)


def _linked(rows: DataFrame, params: JaccardParams) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for rows (id, text) in which an identifier has one text."""
    nodes = stored(rows.mapInArrow(lambda it: _sets(it, params), "id long, n long, digest string, " + ", ".join(f"{p} long" for p in PRINT) + ", wide array<bigint>"), "sets")
    known = nodes.filter("id is not null and n > 0")
    firsts = stored(known.groupBy("digest").agg(F.min("id").alias("class_id")), "classes")
    heads = firsts.select(F.col("class_id").alias("id")).distinct()
    copies = stored(known.select("id").join(heads, "id", "left_anti").distinct(), "copies")
    named = rows.filter("id is not null")

    # one deal of the signatures gives for each whether it is frequent, and a leader; frequent ones are salted
    beside = W.partitionBy("sign", "salt")
    signs = named.mapInArrow(lambda it: _signed(it, params), "sign long, salt int, id long, slack int")
    signs = signs.select("*", F.count(F.lit(1)).over(beside).alias("alike"), F.min("id").over(beside).alias("lead"), F.max(F.col("id").isNull()).over(beside).alias("salted"))
    met = signs.filter((F.col("alike") > 1) | (F.col("salt") > 0) | (F.col("sign") == int(STUCK))).filter("id is not null")  # a set that is stuck by itself may meet one that frequent signatures hold up
    silent = F.col("salted") | (F.col("salt") > 0) | (F.col("alike") > params.heavy) | (F.col("sign") == int(STUCK))
    met = stored(met.select("sign", "id", "slack", "lead", (F.col("alike") > 2).alias("more"), silent.alias("silent")), "met")
    lost = met.filter("silent").groupBy("id", F.col("sign").bitwiseAND(int(BAND)).alias("band")).agg(F.count(F.lit(1)).alias("lost"), F.min("slack").alias("slack"))
    stuck = stored(lost.filter("lost > slack").select("id").distinct().join(copies, "id", "left_anti"), "stuck")
    prefixes = stored(_rare_prefixes(_sets_of(stuck, named, params, "stuck-items"), params.percent), "leads")
    used = met.filter("not silent").select("sign", "id", "lead", "more").union(prefixes)
    met = stored(used.filter("more").select("sign", "id").join(copies, "id", "left_anti"), "buckets")

    prints = known.join(copies, "id", "left_anti").dropDuplicates(["id"]).select("id", "n", *PRINT, "wide")
    prints = stored(prints, "prints")
    wide_u, wide_v = (prints.select(F.col("id").alias(x), F.col("n").alias(n), F.col("wide").alias(w)) for x, n, w in (("u", "n", "a"), ("v", "m", "b")))
    prints = prints.drop("wide")
    others = prints.select(F.col("id").alias("lead"), F.col("n").alias("m"), *[F.col(p).alias(p.replace("p", "q")) for p in PRINT])
    near = _size_fits(params.percent) & _print_fits(params.percent)
    links, checked, labels = None, None, None
    for turn in range(params.rounds + 1):
        if labels is None:
            pairs = used.filter("id <> lead").select("id", "lead").distinct()
        else:
            at = met.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
            rank = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"), F.col("label").alias("label"))
            open_ = at.groupBy("sign").agg(F.min(rank).alias("lead"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
            open_ = stored(open_.select("sign", F.col("lead.id").alias("lead"), F.col("lead.label").alias("lead_label")), "open")
            if open_.isEmpty():
                break
            pairs = at.join(open_, "sign").filter("label <> lead_label").select("id", "lead").distinct()
        if turn < params.rounds:
            pairs = pairs.join(prints, "id").join(others, "lead").filter(near)
        else:
            still = stored(at.join(open_.select("sign"), "sign", "left_semi").join(prints, "id"), "still")
            pairs = _pairs_in_blocks(still).filter(near)
        pairs = pairs.select(F.least("id", "lead").alias("u"), F.greatest("id", "lead").alias("v")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["u", "v"], "left_anti")
        pairs = pairs.join(wide_u, "u").join(wide_v, "v").filter(_wide_fits(params.percent)).select("u", "v")
        pairs = stored(pairs, "pairs")
        checked = pairs if checked is None else checked.union(pairs)
        found = _verified(pairs, named, params)
        links = found if links is None else links.union(found)
        labels = stored(connected_components(links), "labels")

    placed = nodes.join(firsts, "digest", "left").withColumn("class_id", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("class_id")).otherwise(F.col("id")))
    placed = placed.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "class_id"))
    return placed.select("id", F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one document of each component, the one with the least identifier; of rows repeated under one
    identifier the one with the least hash of its text. Documents without words, and rows without an identifier, stay."""
    marks = stored(link_components(docs, params, id_col, text_col), "marks")
    gone = marks.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    key = F.col(id_col).cast("long")
    rows = docs.join(stored(gone, "gone"), key == F.col("__gone"), "left_anti")
    again = marks.filter(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)).groupBy(F.col(id_col).alias("__again")).count().filter("count > 1")
    again = stored(again.select("__again"), "again")
    if again.isEmpty():
        return rows
    place = F.row_number().over(W.partitionBy(id_col).orderBy(F.xxhash64(text_col)))  # rows of one identifier
    firsts = rows.join(again, key == F.col("__again"), "left_semi").withColumn("__place", place).filter("__place = 1").drop("__place")
    return rows.join(again, key == F.col("__again"), "left_anti").unionByName(firsts)
