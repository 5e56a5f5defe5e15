"""Operator 2, HTML extraction: host suffix array.

A page is cut into blocks of text. Blocks inside its article (or main part) are its main text, without what their markup
marks as menus, headers, footers, sidebars, notices, adverts, forms and comments; a page that marks no article has the
blocks that no markup sets apart as its main text. All blocks of every page are concatenated to token streams. The suffixes
of the streams are put in order of their host and first `length` tokens (by a hash of both): this is the host's suffix array
as deep as repeats of `length` tokens need it, and suffixes that share that many tokens stand together. For each such group
the main texts are counted that hold it. The order is found by ranges of the hash over chunks of pages (see chunks.py), so a
host with a third of all pages, or a footer on all of them, is a few entries of each chunk and never gathered in one task.
A hash of few bits comes first, which leaves out nearly all suffixes that stand alone; the others are compared by a long one.

A main text loses the runs of tokens that repeats cover. Outside of articles, what two pages of distinct main texts hold there
is a repeat. In an article, it takes a run of `article_run` tokens that `article_pages` distinct articles hold; and where such
runs are more than half of the article, it is itself a copy of other articles and loses only what half of the main texts of its
host hold. What stands beside an article says nothing about articles: a list of related headlines leaves the headlines.

Defined results: null html is empty; a page without text gives ''. Pages of a host with equal main texts count as one, the
page of them with the least hash of all its text: so copies of a page or of its article do not make their text a repeat. A
null url has the host ''. Every row is a page of its own; identifiers are not looked at. Hashes of different suffixes are
equal by chance with 2^-24. An empty table gives an empty result. Further columns pass through; one that has the name of an
output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import by_chunk, by_range, chunked, from_bytes, key_bits, pack, pack_ascending, range_bits, stored_chunks, to_bytes, unpack, unpack_ascending, with_answers
from .common import Words, list_array, mix, stored, windows

#: Elements that end a block of text, that hold no text, that are never part of an article, and words of
#: class, id and role attributes that mark such parts.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
APART = set("head script style noscript template nav footer aside form button select option textarea input label iframe object svg math canvas dialog menu title audio video map".split())
MARKS = set("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion promoted recommended related share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: What tells suffixes outside of articles from those inside.
OUTSIDE = np.uint64(0x9E3779B97F4A7C15)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@-][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class BoilerplateParams:
    """length: tokens from which a substring that distinct main texts of a host repeat counts as boilerplate. article_run,
    article_pages: tokens and distinct main texts from which it does inside an article."""

    length: int = 8
    article_run: int = 12
    article_pages: int = 3


def _set_apart(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is outside of any article by its markup, and whether it is an article."""
    if tag in APART or (tag == "header" and not in_main):
        return True, False
    if not attributes.strip():
        return False, tag in ("article", "main")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in ROLES:
        return True, False
    if tag not in ("html", "body", "article", "main") or tag == "article":
        words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
        if words & MARKS:
            return True, False
    return False, tag in ("article", "main") or role in ("article", "main") or "articlebody" in found.get("itemprop", "").lower()


def page_blocks(html: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """The text blocks inside articles, and the blocks elsewhere with whether their markup sets them apart."""
    inside: list[str] = []
    outside: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, set apart, in an article
    apart, main, buffer, at, has_main = False, False, [], 0, False

    def close() -> None:
        text = SPACE.sub(" ", unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            if main and not apart:
                inside.append(text)
            else:
                outside.append((text, apart))

    end = len(html)
    while at < end:
        found = TAG.search(html, at)
        if not found:
            buffer.append(html[at:])
            break
        if found.start() > at:
            buffer.append(html[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if tag in BLOCKS or tag in APART:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            apart, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        attributes = found[3] or found[6] or ""
        if tag in RAW:
            close()
            done = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = done.end() if done else end
            continue
        if tag in VOID or attributes.endswith("/"):
            if tag in BLOCKS:
                close()
            continue
        if tag in BLOCKS or tag in APART:
            close()
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            stack.pop()
            apart, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        new_apart, new_main = _set_apart(tag, attributes, main)
        apart, main = apart or new_apart, (main or new_main) and not (apart or new_apart)
        has_main |= main
        stack.append((tag, apart, main))
    close()
    return (inside if has_main else []), outside


#: Bits of the short and of the long suffix hash beyond those that number the suffixes.
SPARE_BITS = (5, 24)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, html) -> a row for each chunk: the blocks of its pages, hashes of host and main text and of all text, and
    the number of tokens."""
    for number, part in chunked(batches, 2):
        inside, outside, marked, prints, whole, tokens = [], [], [], [], [], 0
        for host, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            article, rest = page_blocks(html or "")
            inside.append("\n".join(article))
            outside.append("\n".join(t for t, _ in rest))
            marked.append([a for _, a in rest])
            main = inside[-1] or "\n".join(t for t, a in rest if not a)
            prints.append(xxhash.xxh3_64_intdigest(f"{host}\n{main}"))
            whole.append(xxhash.xxh3_64_intdigest(f"{inside[-1]}\n\n{outside[-1]}"))
            tokens += inside[-1].count(" ") + outside[-1].count(" ") + len(article) + len(rest) + 1
        rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(inside), pa.array(outside), pa.array(marked, pa.list_(pa.bool_()))], ["row", "host", "inside", "outside", "marked"])
        columns = [pa.array([number]), pa.array([tokens]), *(list_array([np.array(x, np.uint64)], pa.int64()) for x in (prints, whole)), pa.array([to_bytes(rows)])]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "tokens", "prints", "whole", "rows"])


class _Suffixes:
    """The suffixes of the pages of a chunk: one of every host, and one of every window of `length` tokens of the articles
    and of what is outside of them, in the order of the streams (two for each page)."""

    def __init__(self, rows: pa.RecordBatch, length: int):
        n = rows.num_rows
        texts = [x for pair in zip(rows.column("inside").to_pylist(), rows.column("outside").to_pylist()) for x in pair]
        words = Words(pa.array(texts, pa.string()))
        values = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
        found, at = windows(values, words.owner, length, seed=5)
        hosts = np.array([xxhash.xxh3_64_intdigest(h) for h in rows.column("host").to_pylist()], np.uint64)
        self.page = np.concatenate((np.arange(n), words.owner[at] // 2))
        apart = (words.owner[at] % 2).astype(np.uint64) * OUTSIDE  # what stands outside of articles says nothing about them
        self.hashes = mix(np.concatenate((np.zeros(n, np.uint64), found + apart)) + hosts[self.page])
        self.first = n + np.searchsorted(words.owner[at], np.arange(2 * n + 1))
        self.some = np.arange(len(self.hashes))

    def keyed(self, bits: int) -> np.ndarray:
        """The distinct keys, ascending, of the suffixes in question; place: where each of these stands among them."""
        keys = self.hashes[self.some] >> np.uint64(64 - bits)
        self.order = np.argsort(keys, kind="stable")
        keys = keys[self.order]
        new = np.diff(keys, prepend=~keys[:1]) != 0
        self.place = np.empty(len(keys), np.int64)
        self.place[self.order] = np.cumsum(new) - 1
        return keys[new]

    def held(self, n_keys: int, pages: list[int]) -> np.ndarray:
        """How many of some pages hold a suffix of each key."""
        asked = np.zeros(len(self.first) // 2, bool)
        asked[pages] = True
        page, place = self.page[self.some][self.order], self.place[self.order]  # by key, and by page: of a host, then of its windows
        once = (np.diff(place, prepend=-1) != 0) | (np.diff(page, prepend=-1) != 0)
        return np.bincount(place[once & asked[page]], minlength=n_keys)

    def totals(self, replies: list | None) -> np.ndarray:
        """What was answered for each suffix in question."""
        total = np.concatenate([np.empty(0, np.int64), *(unpack(x["reply"]).astype(np.int64) for x in replies or ())])
        if len(total) != (int(self.place.max()) + 1 if len(self.place) else 0):
            raise ValueError("the answers do not fit the chunk")
        return total[self.place]

    def narrow(self, replies: list | None) -> None:
        """From now on only suffixes are in question that more than one main text holds."""
        self.some = self.some[self.totals(replies) > 1]


def _cells(batches: Iterator[pa.RecordBatch], length: int, bits: list[int], of_range: int) -> Iterator[pa.RecordBatch]:
    """(range, chunk, keys, held): the suffixes of a chunk, and how many of the pages that count hold them, by range; with
    a second number of bits only of those which the answers to the first leave over."""
    for batch in batches:
        for r in batch.to_pylist():
            suffixes = _Suffixes(from_bytes(r["rows"]), length)
            keys = suffixes.keyed(bits[0])
            for b in bits[1:]:
                suffixes.narrow(r["short"])
                keys = suffixes.keyed(b)
            held = suffixes.held(len(keys), r["firsts"] or [])
            out = [(k, r["chunk"], pack_ascending(keys[s]), pack(held[s])) for k, s in by_range(keys, bits[-1], of_range)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "chunk", "keys", "held"])


def _summed(table: pa.Table) -> pa.Table:
    """One range: how many main texts hold each suffix, as an answer to each chunk."""
    keys = [unpack_ascending(x) for x in table.column("keys").to_pylist()]
    found, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, code, np.concatenate([unpack(x) for x in table.column("held").to_pylist()]).astype(np.int64))
    parts = np.split(total[code], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "reply": pa.array([pack(p) for p in parts], pa.binary())})


def _covered(n: int, counts: np.ndarray, least: float, length: int, run: int) -> np.ndarray:
    """Whether each of n tokens is in a run of at least `run` tokens that suffixes of at least `least` main texts cover."""
    marks, found = np.zeros(n + 1, np.int64), np.flatnonzero(counts >= least)
    if not len(found):
        return marks[:-1].astype(bool)
    for i in found:
        marks[i : i + length] = 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks, [0]))))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a < run:
            marks[a:b] = 0
    return marks[:-1].astype(bool)


def _left(tokens: list[list[str]], marked: list[bool], covered: np.ndarray) -> str:
    """The tokens that are not covered, a line for each block that is not set apart."""
    lines, at = [], 0
    for words, apart in zip(tokens, marked):
        if not apart:
            left = [w for w, c in zip(words, covered[at : at + len(words)]) if not c]
            if left:
                lines.append(" ".join(left))
        at += len(words)
    return "\n".join(lines)


def main_text(inside: str, outside: str, marked: list[bool], in_counts: np.ndarray, out_counts: np.ndarray, of_host: int, params: BoilerplateParams) -> tuple[str, int]:
    """The main text of a page without the runs that repeats cover, and the number of covered tokens on the page. in_counts,
    out_counts: how many main texts hold the suffix at each token; of_host: the main texts of the host."""
    size = outside.count(" ") + outside.count("\n") + 1
    covered = _covered(size, out_counts, 2, params.length, params.length)
    if not inside:
        return _left([b.split(" ") for b in outside.split("\n")] if outside else [], marked, covered), int(covered.sum())
    n, size = int(covered.sum()), inside.count(" ") + inside.count("\n") + 1
    covered = _covered(size, in_counts, params.article_pages, params.length, params.article_run)
    if 2 * covered.sum() > size:
        covered = _covered(size, in_counts, max(params.article_pages, of_host / 2), params.length, params.article_run)
    if not covered.any():
        return inside, n
    blocks = [b.split(" ") for b in inside.split("\n")]
    return _left(blocks, [False] * len(blocks), covered), n + int(covered.sum())


def _finish(batches: Iterator[pa.RecordBatch], params: BoilerplateParams, bits: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rows = from_bytes(r["rows"])
            suffixes = _Suffixes(rows, params.length)
            suffixes.keyed(bits[0])
            suffixes.narrow(r["short"])
            suffixes.keyed(bits[1])
            counts = np.ones(len(suffixes.hashes), np.int64)
            counts[suffixes.some] = suffixes.totals(r["long"])
            streams = np.split(counts, suffixes.first[:-1])[1:]
            done = [main_text(i, o, m, streams[2 * k], streams[2 * k + 1], counts[k], params) for k, (i, o, m) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("inside", "outside", "marked"))))]
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], ["row", "text", "n_chars", "n_repeated"])


def extract_text(pages: DataFrame, params: BoilerplateParams = BoilerplateParams(), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows without their html: text, n_chars, and n_repeated, the tokens of the page that repeats of its host cover."""
    new, length = ["text", "n_chars", "n_repeated"], params.length
    rest = [c for c in pages.columns if (c not in new or c == url_col) and c != html_col]
    rows = pages.select(F.struct(*rest).alias("row"), F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"://([^/?#]*)", 1)).alias("host"), F.col(html_col).alias("html"))
    chunks = stored_chunks(rows.mapInArrow(_parse, "chunk long, tokens long, prints array<long>, whole array<long>, rows binary"), "pages")
    n_suffixes = int(chunks.agg(F.sum("tokens")).first()[0] or 0)
    bits = [key_bits(n_suffixes, spare) for spare in SPARE_BITS]

    texts = chunks.select("chunk", F.posexplode(F.arrays_zip("prints", "whole")).alias("at", "x"))
    firsts = texts.groupBy("x.prints").agg(F.min(F.struct("x.whole", "chunk", "at")).alias("first"))
    firsts = stored(firsts.groupBy("first.chunk").agg(F.collect_list("first.at").alias("firsts")), "firsts")  # as many as a chunk has pages at most
    data = chunks.select("chunk", "rows")

    def asked(rows: DataFrame, bits: list[int]) -> DataFrame:
        cells = rows.mapInArrow(partial(_cells, length=length, bits=bits, of_range=range_bits(n_suffixes, bits[-1])), "range long, chunk long, keys binary, held binary")
        return cells.groupBy("range").applyInArrow(_summed, "chunk long, range long, reply binary")

    short = stored(by_chunk(asked(with_answers(data, firsts), bits[:1]), "short"), "short")
    long = by_chunk(asked(with_answers(data, firsts, short), bits), "long")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_repeated", T.LongType())])
    out = with_answers(data, short, long).mapInArrow(partial(_finish, params=params, bits=bits), schema)
    return out.select(*[F.col("row")[c].alias(c) for c in rest], *new)
