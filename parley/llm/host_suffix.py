"""HTML extraction with a suffix array per host.

A page's markup gives its blocks of text: menus, headers, footers, asides, forms, adverts, notices,
comments, scripts and the like are left out by element, role and class, and where a page has an
``article`` (or else a ``main``) only what is inside counts. The words of the pages of one host are
then put one after another and their suffixes sorted, to a depth of ``RUN`` words; suffixes that
agree so far on many distinct pages are long substrings repeated across pages. A block that such
runs cover is boilerplate and goes; blocks that are unique to their page stay. Inside an article only
what most pages of the host share is taken for boilerplate, since articles may quote a passage.

A host's pages are dealt to groups of about ``GROUP`` pages, each with a suffix array of its own, so
no task holds a host whole; what is counted is the whole host nevertheless. A run on some share of
all pages of a host is on that share of the pages of one group at least, so the runs that the groups
find there are all that can matter. These, some pages' worth of runs as groups are dealt by hash, go
to every group of the host, which counts its pages with them; the sums decide, and what is
boilerplate goes to every group once more. So a page's text does not depend on ``GROUP``. Between
groups a run is known by a 64-bit hash of its words.

Defined cases: a null page is empty; without blocks the text is empty; a null address is a host of
its own; unclosed comments, scripts and tags reach to the end of the page; a quote opens a value only
right after the equals sign; repeated rows give a row each and count as distinct pages only by their id.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import mix, signed, words
from parley.operators.joins import lookup
from parley.session import cut

RUN = 8
GROUP = 256
#: Share of a host's pages, and least number of pages, that make a run boilerplate.
OUTSIDE_SHARE, OUTSIDE_PAGES = 0.2, 3
INSIDE_SHARE, INSIDE_PAGES = 0.6, 5
COVERED = 0.9
_PLACES = mix(np.arange(1, RUN + 1, dtype=np.uint64))

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][\w:-]*)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_BLOCKS = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p
    pre section summary table tbody td tfoot th thead tr ul""".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = set("nav header footer aside form button menu dialog head".split())
_CHROME_WORDS = set("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter
    notice notices pagination popup promo related share sharing sidebar signup social sponsor sponsored
    subscribe toolbar widget""".split())
_CHROME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_NEVER_CHROME = set("html body main".split())


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _NEVER_CHROME:
        return False
    if tag in _CHROME and not (tag == "header" and inside):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        found = {w.lower() for w in _WORD.findall("".join(values))}
        if name.lower() == "role":
            if "".join(values).lower() in _CHROME_ROLES:
                return True
        elif found & (_CHROME_WORDS if tag != "article" else {"comment", "comments"}):
            return True
    return False


def blocks(page: str | None) -> tuple[list[str], bool]:
    """Texts of a page's blocks without its chrome, and whether they are those of an article or main."""
    found: list[tuple[int, str]] = []  # 2 inside an article, 1 inside a main, 0 elsewhere
    pieces: list[str] = []
    depth = {"article": 0, "main": 0}
    skipped, nested = "", 0
    last = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            found.append((2 if depth["article"] else 1 if depth["main"] else 0, text))

    page = page or ""
    for piece in _PIECE.finditer(page):
        if not skipped and piece.start() > last:
            pieces.append(page[last:piece.start()])
        last = piece.end()
        tag = (piece[3] or "").lower()
        if not tag:
            continue
        closing, attributes = piece[2], piece[4]
        if skipped:
            if tag == skipped and not attributes.endswith("/"):
                nested += -1 if closing else 1
            elif closing and tag in ("body", "html", "article", "main"):
                nested = 0
            if nested > 0:
                continue
            ended, skipped = skipped, ""
            if tag == ended:
                continue
        if not closing and tag not in _VOID and not attributes.endswith("/") and _is_chrome(
                tag, attributes, depth["article"] > 0):
            close()
            skipped, nested = tag, 1
            continue
        if tag in _BLOCKS:
            close()
        elif tag == "br":
            pieces.append(" ")
        if tag in depth:
            depth[tag] = max(0, depth[tag] + (-1 if closing else 1))
    if not skipped:
        pieces.append(page[last:])
    close()
    best = max((kind for kind, _ in found), default=0)
    return [text for kind, text in found if kind == best], best > 0


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens (a power of two); equal where these agree."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-reach] = rank[reach:] + 1 if len(rank) > reach else 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return rank


class Words(NamedTuple):
    """Words of some pages, one after another."""

    tokens: np.ndarray
    row: np.ndarray  # page in the list, by token
    block: np.ndarray  # block among all, by token
    sizes: np.ndarray  # words by block


def laid_out(pages: list[list[str]]) -> Words:
    flat = [b.encode() for page in pages for b in page]
    offsets = np.r_[0, np.cumsum([len(b) + 1 for b in flat])].astype(np.int64)
    offsets[-1] = max(0, offsets[-1] - 1)
    tokens, at = words(np.frombuffer(b"\n".join(flat), np.uint8), offsets)
    sizes = np.diff(at)
    block = np.repeat(np.arange(len(flat)), sizes)
    return Words(tokens, np.repeat(np.arange(len(pages)), [len(p) for p in pages])[block], block, sizes)


def run_begins(found: Words, depth: int = RUN) -> np.ndarray:
    """Tokens at which a run of ``depth`` begins; none reaches from one page into another."""
    n = max(0, len(found.tokens) - depth + 1)
    return np.flatnonzero(found.row[:n] == found.row[len(found.row) - n:])


def run_hashes(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``RUN`` tokens that begin there."""
    sums = np.zeros(len(begin), np.uint64)
    for at, place in enumerate(_PLACES):
        sums += mix(tokens[begin + at] ^ place)
    return signed(mix(sums))


def run_pages(found: Words, begin: np.ndarray, page: np.ndarray, depth: int = RUN) -> np.ndarray:
    """On how many distinct pages (``page``, by row) the run is that begins at each of ``begin``."""
    if not len(begin):
        return np.zeros(0, np.int64)
    rank, page = suffix_ranks(found.tokens, depth)[begin], page[found.row[begin]]
    order = np.lexsort((page, rank))  # the suffix array, to that depth
    r, p = rank[order], page[order]
    new_page = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])]
    return np.bincount(r, new_page)[rank].astype(np.int64)


def uncovered(pages: list[list[str]], found: Words, begin: np.ndarray, depth: int = RUN) -> list[list[bool]]:
    """Which blocks of each page are not covered by the runs that begin at ``begin``."""
    marks = np.zeros(len(found.tokens) + 1, np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, begin + depth, -1)
    inside_run = np.cumsum(marks[:-1]) > 0
    share = np.bincount(found.block, inside_run, len(found.sizes)) / np.maximum(found.sizes, 1)
    good = (share < COVERED).tolist()
    ends = np.cumsum([len(p) for p in pages]).tolist()
    return [good[e - len(p):e] for p, e in zip(pages, ends)]


def numbered(names: list) -> tuple[np.ndarray, int]:
    """Number of each row's page, and how many pages there are: rows of one page id count as one."""
    distinct = {}
    return np.array([distinct.setdefault(n, len(distinct)) for n in names], np.int64), len(distinct)


def keep_blocks(pages: list[list[str]], inside: list[bool], names: list) -> list[list[bool]]:
    """Which blocks of each page of a whole host are no boilerplate."""
    found, (page, total) = laid_out(pages), numbered(names)
    least = np.where(inside, max(INSIDE_PAGES, INSIDE_SHARE * total), max(OUTSIDE_PAGES, OUTSIDE_SHARE * total))
    begin = run_begins(found)
    return uncovered(pages, found, begin[run_pages(found, begin, page) >= least[found.row[begin]]])


def frequent_runs(pages: list[list[str]], names: list) -> np.ndarray:
    """Hashes of all runs on that share of a group's pages that some run of the host has to reach."""
    found, (page, total) = laid_out(pages), numbered(names)
    begin = run_begins(found)
    # a little less, for rounding: no run may be lost
    often = begin[run_pages(found, begin, page) >= (OUTSIDE_SHARE - 1e-9) * total]
    return np.unique(run_hashes(found.tokens, often))


def count_pages(pages: list[list[str]], names: list, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``runs`` that the pages have, and on how many distinct pages each is."""
    found, (page, _) = laid_out(pages), numbered(names)
    begin = run_begins(found)
    hashes = run_hashes(found.tokens, begin)
    known = np.isin(hashes, runs)
    pairs = np.unique(np.c_[hashes[known], page[found.row[begin[known]]]], axis=0)
    return np.unique(pairs[:, 0], return_counts=True)


def keep_without(pages: list[list[str]], inside: list[bool], runs: np.ndarray, everywhere: np.ndarray) -> list[list[bool]]:
    """Which blocks stay where ``runs`` are boilerplate, those ``everywhere`` inside an article too."""
    found = laid_out(pages)
    begin = run_begins(found)
    hashes = run_hashes(found.tokens, begin)
    within = np.array(inside, bool)[found.row[begin]]
    return uncovered(pages, found, begin[np.where(within, np.isin(hashes, runs[everywhere]), np.isin(hashes, runs))])


_EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """Main text of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    large = cut(rows.groupBy("host", "page_id").count().groupBy("host").agg(
        F.ceil(F.sum("count") / group).alias("groups"), F.count("*").alias("total")).where(F.col("groups") > 1))
    if large.isEmpty():
        return _of_one_group(_parsed(rows, ["host"]))
    dealt = lookup(rows, large, ["host"], "left").withColumn("turn", F.pmod(F.xxhash64("page_id"), "groups"))
    return _of_one_group(_parsed(dealt.where("groups IS NULL"), ["host"])).unionByName(
        _of_many_groups(_parsed(dealt.where("groups IS NOT NULL"), ["host", "turn", "groups", "total"])))


def _parsed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """page_id, url and the columns ``keep`` of ``rows``, beside the blocks of their pages."""
    kept = ["page_id", "url", *keep]
    names = [*kept, "blocks", "inside"]
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]

    def parse(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                found = [blocks(h) for h in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.array([b for b, _ in found], pa.list_(pa.string())),
                     pa.array([i for _, i in found], pa.bool_())], names=names)

    return rows.select(*kept, "html").mapInArrow(parse, ", ".join([*kinds, "blocks array<string>", "inside boolean"]))


def _texts(table: pa.Table, texts: list[list[str]], good: list[list[bool]]) -> pa.Table:
    out = ["\n\n".join(b for b, stay in zip(page, flags) if stay) for page, flags in zip(texts, good)]
    return pa.table([table.column("page_id"), table.column("url"), pa.array(out, pa.string()),
                     pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _of_one_group(parsed: DataFrame) -> DataFrame:
    def sift(table: pa.Table) -> pa.Table:
        texts = table.column("blocks").to_pylist()
        good = keep_blocks(texts, table.column("inside").to_pylist(), table.column("page_id").to_pylist())
        return _texts(table, texts, good)

    return parsed.groupBy("host").applyInArrow(sift, _EXTRACTED)


def _of_many_groups(parsed: DataFrame) -> DataFrame:
    keys = ["host", "turn"]
    parsed = parsed.repartition(*keys)  # read three times, written once

    def to_all_groups(runs: DataFrame):
        return runs.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).groupBy(*keys)

    def frequent(table: pa.Table) -> pa.Table:
        runs = frequent_runs(table.column("blocks").to_pylist(), table.column("page_id").to_pylist())
        return pa.table([*_repeated(table, ["host", "groups"], len(runs)), pa.array(runs, pa.int64())],
                        names=["host", "groups", "run"])

    def count(table: pa.Table, wanted: pa.Table) -> pa.Table:
        found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if table.num_rows and wanted.num_rows:
            found, n = count_pages(table.column("blocks").to_pylist(), table.column("page_id").to_pylist(),
                                   wanted.column("run").to_numpy())
        return pa.table([*_repeated(table, ["host", "groups", "total"], len(found)), pa.array(found, pa.int64()),
                         pa.array(n, pa.int64())], names=["host", "groups", "total", "run", "n"])

    def sift(table: pa.Table, bad: pa.Table) -> pa.Table:
        texts = table.column("blocks").to_pylist() if table.num_rows else []
        if not texts:
            return pa.table([[], [], [], []], schema=_TEXTS)
        if not bad.num_rows:
            return _texts(table, texts, [[True] * len(page) for page in texts])
        return _texts(table, texts, keep_without(
            texts, table.column("inside").to_pylist(), bad.column("run").to_numpy(),
            bad.column("everywhere").to_numpy(zero_copy_only=False)))

    wanted = parsed.groupBy(*keys).applyInArrow(frequent, "host string, groups long, run long").distinct()
    counted = parsed.groupBy(*keys).cogroup(to_all_groups(wanted)).applyInArrow(
        count, "host string, groups long, total long, run long, n long").groupBy("host", "groups", "total", "run").agg(
        F.sum("n").alias("n"))
    bad = counted.where(F.col("n") >= F.greatest(F.lit(float(OUTSIDE_PAGES)), OUTSIDE_SHARE * F.col("total"))).select(
        "host", "groups", "run", (F.col("n") >= F.greatest(
            F.lit(float(INSIDE_PAGES)), INSIDE_SHARE * F.col("total"))).alias("everywhere"))
    return parsed.groupBy(*keys).cogroup(to_all_groups(bad)).applyInArrow(sift, _EXTRACTED)


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _repeated(table: pa.Table, columns: list[str], n: int) -> list[pa.Array]:
    """The values that all rows of a group share, ``n`` times."""
    return [pa.repeat(table.column(c)[0], n) if n else pa.array([], pa.string() if c == "host" else pa.int64())
            for c in columns]
