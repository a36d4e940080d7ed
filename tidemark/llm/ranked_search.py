"""Ranked lexical search over an index whose documents are ordered by recursive graph bisection.

Fit. A bounded sample of documents (by a hash of the id) is split in two again and again so that terms concentrate on one
side: documents trade places between the halves while that lowers the sum of d log2(n / (d + 1)) over terms of degree d in a
half of n. A node keeps, for each hashed term, what putting it into one half rather than the other costs, and the median of
its sample; so any document can be sent down the tree, and leaves number the clusters in bisection order.

Index. Every document goes to its leaf; leaves are dealt to tasks, which cut them into pages of bounded size as they stream
by. A page holds its documents' ids and lengths and an inverted list of every term, with the term's highest frequency and
shortest document as a bound. Pages are written to the shared folder with their cluster, so a search reads the pages of the
clusters that it visits.

Search. Queries come in blocks of bounded size, each a scan of the clusters' bounds and some rounds of visits. Sums over
pages give exact document frequencies and, for each cluster and query, a bound on any document's score. A round visits for
each query the next clusters by falling bound (four times as many as before), but stops exactly: a cluster, and within a
task a page, whose bound is below the query's k-th score so far can't change its list; one that equals it can, as ties go by
doc_id, so it is visited. Ids are held in the pages, so order of ties doesn't depend on the bisection order.

Scores are exact: 64-bit integers, summed as doubles below 2**53. Terms are 64-bit hashes, so two are taken for one with
probability about 2**-64.

Defined results: null and empty texts and texts without terms are not documents of the counts and are never found; a query
without terms finds nothing; repeated rows of documents are ranked each, null ids after others of equal score; queries of one
item_id are ranked each by itself; an empty table of documents or queries gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slices, word_hashes

#: Results of a query, sampled documents, hashed terms of the fit, levels of the tree, bytes of text in a page.
BEST, SAMPLE, FEATURES, DEPTH, PAGE_BYTES = 50, 2000, 2048, 6, 1 << 20
#: Code points and queries of one block; clusters of the first round, and growth.
BLOCK_CHARS, BLOCK_ITEMS, FIRST, GROWTH = 100_000, 2000, 2, 4
#: Bytes between terms: all of ASCII but digits and letters.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: A page ends after so many documents and at most one piece more, below 2**16.
MOST_DOCS, PIECE = 50_000, 10_000
ROW_GROUP, BATCH_PAGES = 8 << 20, 8

_PAGE = "cluster int, ids array<bigint>, lengths binary, terms binary, sizes binary, most binary, shortest binary, docs binary, counts binary, large binary, n_docs long, n_terms long"


class Tree(NamedTuple):
    """weights[node, feature] and cut[node]: a document whose weights sum to more than the cut goes right. Children of node i are 2 i + 1, 2 i + 2."""

    weights: np.ndarray
    cut: np.ndarray
    #: Share of the sample's bytes in each leaf, mean bytes of a text.
    share: np.ndarray
    mean: float


class Index(NamedTuple):
    tree: Tree
    pages: DataFrame
    clusters: int


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash) of each distinct term of each text, in order of text, and each text's number of terms with repeats."""
    hashes, counts = word_hashes(texts, BREAKS)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], hashes[fresh], counts


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    return degree * np.log2(size / (degree + 1)) if size else np.zeros_like(degree)


def bisect(held: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
    """weights, cut of one node from its documents' features ([document, feature], 0 or 1): halves that trade documents while it pays."""
    n = len(held)
    if n < 2:
        return np.zeros(held.shape[1], np.float32), 0.0
    right = np.arange(n) >= n // 2
    for _ in range(rounds):
        sizes = [int((~right).sum()), int(right.sum())]
        degree = [held[~right].sum(0, dtype=np.float64), held[right].sum(0, dtype=np.float64)]
        gain = np.empty(n)
        for side, members in enumerate((~right, right)):
            own, other = degree[side], degree[1 - side]
            less = _cost(own, sizes[side]) - _cost(np.maximum(own - 1, 0), sizes[side])
            more = _cost(other + 1, sizes[1 - side]) - _cost(other, sizes[1 - side])
            gain[members] = held[members] @ (less - more)
        a, b = (np.flatnonzero(m)[np.argsort(-gain[m], kind="stable")] for m in (~right, right))
        pairs = min(len(a), len(b))
        trade = gain[a[:pairs]] + gain[b[:pairs]] > 1e-9
        stop = pairs if trade.all() else int(np.argmin(trade))
        if not stop:
            break
        right[a[:stop]], right[b[:stop]] = True, False
    sizes, degree = [int((~right).sum()), int(right.sum())], [held[~right].sum(0, dtype=np.float64), held[right].sum(0, dtype=np.float64)]
    added = [_cost(d + 1, s) - _cost(d, s) for d, s in zip(degree, sizes, strict=True)]
    weights = (added[0] - added[1]).astype(np.float32)
    return weights, float(np.median(held @ weights))


def fit_tree(held: np.ndarray, lengths: np.ndarray, depth: int = DEPTH) -> Tree:
    """The tree of a sample's features, level by level; each node's sample goes down by the node's own rule."""
    nodes = 2**depth - 1
    weights, cut, at = np.zeros((nodes, held.shape[1]), np.float32), np.zeros(nodes, np.float32), np.zeros(len(held), np.int64)
    for node in range(nodes):
        members = np.flatnonzero(at == node)
        weights[node], cut[node] = bisect(held[members])
        at[members] = 2 * node + 1 + (held[members] @ weights[node] > cut[node])
    sizes = np.bincount(at - nodes, lengths, nodes + 1) if len(held) else np.zeros(nodes + 1)
    return Tree(weights, cut, sizes / max(1, sizes.sum()), float(lengths.mean()) if len(held) else 0.0)


def leaf_of(tree: Tree, texts: pa.Array) -> np.ndarray:
    """The leaf (cluster) of each text; -1 for a text without terms."""
    out, base = np.full(len(texts), -1, np.int32), len(tree.cut)
    for at, part in slices(texts):
        owner, hashes, counts = distinct_terms(part)
        feature, node = (hashes % np.uint64(tree.weights.shape[1])).astype(np.int64), np.zeros(len(part), np.int64)
        for _ in range((base + 1).bit_length() - 1):
            score = np.bincount(owner, tree.weights[node[owner], feature], len(part))
            node = 2 * node + 1 + (score > tree.cut[node])
        out[at : at + len(part)] = np.where(counts > 0, node - base, -1)
    return out


def sample_tree(docs: DataFrame, sample: int = SAMPLE, depth: int = DEPTH) -> tuple[Tree, int]:
    """The tree, and the number of documents. The sample's hashed terms (FEATURES bits a document) reach the driver, no texts."""
    total = docs.count()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch["text"]):
                owner, hashes, _ = distinct_terms(part)
                held = np.zeros((len(part), FEATURES), bool)
                held[owner, (hashes % np.uint64(FEATURES)).astype(np.int64)] = True
                sizes = np.diff(np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1])
                yield pa.record_batch([batch["h"][at : at + len(part)], pa.array([r.tobytes() for r in np.packbits(held, axis=1)], pa.binary()), pa.array(sizes)], ["h", "bits", "size"])

    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    # Twice as many as needed pass, of which the lowest are the sample.
    near = docs.select(h.alias("h"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("h") <= int(min(1.0, 2 * sample / max(1, total)) * 2**53))
    rows = near.mapInArrow(features, "h long, bits binary, size long").orderBy("h").limit(sample).toArrow()
    held = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(-1, FEATURES // 8), axis=1).astype(np.float32)
    return fit_tree(held, rows["size"].to_numpy(), depth), total


def _page(cluster: int, ids: list[pa.Array], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """One page: its documents and the inverted lists of their terms."""
    hashes, lengths = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(hashes, kind="stable")
    term, owner = hashes[order], np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    count, term, owner = np.diff(np.append(first, len(fresh))), term[first], owner[first]
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    blob = lambda x, kind="<u4": pa.array([x.astype(kind).tobytes()], pa.binary())
    held, many = pa.concat_arrays(ids), np.flatnonzero(count >= 255)
    columns = [pa.array([cluster], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), blob(lengths), blob(term[start], "<u8")]
    columns += [blob(np.diff(np.append(start, len(term)))), blob(np.maximum.reduceat(count, start)), blob(np.minimum.reduceat(lengths[owner], start)), blob(owner, "<u2")]
    # Frequencies take a byte; those of 255 and more stand beside it with their places.
    columns += [blob(np.minimum(count, 255), "<u1"), blob(np.stack([many, count[many]]))]
    columns += [pa.array([x], pa.int64()) for x in (len(lengths), int(lengths.sum()))]
    return pa.record_batch(columns, [c.split()[0] for c in _PAGE.split(", ")])


def _paged(page_bytes: int):
    """Pages of documents that come in order of cluster: a page ends with its cluster, or when it holds page_bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, held = None, 0, ([], [], [])
        for batch in batches:
            cluster = batch["cluster"].to_numpy()
            edges = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])) if len(cluster) else []
            for a, b in zip(edges, [*edges[1:], len(cluster)], strict=True):
                if now is not None and cluster[a] != now and held[0]:
                    yield _page(now, *held)
                    size, held = 0, ([], [], [])
                now = int(cluster[a])
                for c in range(a, b, PIECE):
                    for at, part in slices(batch["text"].slice(c, min(PIECE, b - c)), min(page_bytes, 1 << 20)):
                        hashes, counts = word_hashes(part, BREAKS)
                        for x, y in zip(held, (batch["doc_id"].slice(c + at, len(part)), hashes, counts), strict=True):
                            x.append(y)
                        size += part.nbytes
                        if size >= page_bytes or sum(map(len, held[2])) > MOST_DOCS:
                            yield _page(now, *held)
                            size, held = 0, ([], [], [])
        if held[0]:
            yield _page(now, *held)

    return run


def build_index(docs: DataFrame, sample: int = SAMPLE, depth: int = DEPTH, page_bytes: int = PAGE_BYTES) -> Index:
    """Every document with terms in a page of its cluster. docs: doc_id, text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tree, total = sample_tree(docs, sample, depth)
    # Slots only spread the work: a leaf is dealt to as many as its sampled share of the bytes fills pages.
    slots = np.ceil(tree.share * total * tree.mean / page_bytes).astype(int)
    per_leaf = F.array(*(F.lit(int(max(1, p))) for p in slots))
    leaf = F.arrow_udf(lambda texts: pa.array(leaf_of(tree, texts), pa.int32()), "int")
    placed = docs.withColumn("cluster", leaf("text")).filter("cluster >= 0")
    # Rows of a leaf are dealt by their place, so equal rows are not kept together.
    dealt = placed.withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.get(per_leaf, F.col("cluster"))))
    written = dealt.repartition("cluster", "slot").sortWithinPartitions("cluster").select("cluster", "doc_id", "text").mapInArrow(_paged(page_bytes), _PAGE)
    # Small row groups, for a reader holds all rows of one at once.
    return Index(tree, materialise(written, "index", {"parquet.block.size": ROW_GROUP}), len(tree.share))


class Block(NamedTuple):
    """Some queries: their ids, their distinct terms (sorted hashes), and each one's places in them."""

    ids: list
    terms: np.ndarray
    of: list[np.ndarray]


def _blocks(items: DataFrame, chars: int, most: int) -> Iterator[Block]:
    """All queries that have terms, in blocks of bounded size."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text")), F.count("*")).first()
    parts = max(-(-(size[0] or 0) // chars), -(-size[1] // most), 1)
    for b in range(parts):
        table = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b).toArrow()
        texts = table["text"].combine_chunks().cast(pa.large_string()) if len(table) else pa.array([], pa.large_string())
        owner, hashes, _ = distinct_terms(texts)
        terms, place = np.unique(hashes, return_inverse=True)
        live = np.unique(owner)
        if len(live):
            ids = table["item_id"].to_pylist()
            yield Block([ids[i] for i in live], terms, [place[owner == i] for i in live])


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds for each unit of its weight; grows with tf, falls with n."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    m = 50 + (50 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@contextmanager
def _few_pages_a_batch(spark: SparkSession) -> Iterator[None]:
    """Pages go to Python a few at a time, for each is some megabytes; the jobs inside end before the setting goes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_PAGES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bounds(pages: DataFrame, block: Block) -> pa.Table:
    """cluster, term (place in the block), df, most, shortest of the block's terms in each cluster."""
    terms = block.terms

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held = np.frombuffer(batch["terms"][i].as_py(), "<u8")
                at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                hit = np.flatnonzero(held[at] == terms)
                rest = [pa.array(np.frombuffer(batch[c][i].as_py(), "<u4")[at[hit]].astype(np.int64)) for c in ("sizes", "most", "shortest")]
                yield pa.record_batch([pa.array(np.full(len(hit), batch["cluster"][i].as_py(), np.int32)), pa.array(hit.astype(np.int32)), *rest], ["cluster", "term", "df", "most", "shortest"])

    rows = pages.select("cluster", "terms", "sizes", "most", "shortest").mapInArrow(find, "cluster int, term int, df long, most long, shortest long")
    return rows.groupBy("cluster", "term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("shortest").alias("shortest")).toArrow()


def _order(score: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then by id (missing ids last)."""
    if len(score) > k:
        able = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        able = np.arange(len(score))
    return able[np.lexsort((ids[able], missing[able], -score[able]))][:k]


_KINDS = {"lengths": "<u4", "terms": "<u8", "sizes": "<u4", "most": "<u4", "shortest": "<u4", "docs": "<u2", "counts": "<u1", "large": "<u4"}


def _visit(block: Block, weight: np.ndarray, visits: np.ndarray, least: np.ndarray, documents: int, length: int, k: int):
    """Scores the queries that visit each page's cluster, keeps the k best of each over the task's pages, and gives them out at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, best = least.copy(), {}
        for batch in batches:
            for i in range(len(batch)):
                page = {c: np.frombuffer(batch[c][i].as_py(), kind) for c, kind in _KINDS.items()}
                large = page["large"].reshape(2, -1).astype(np.int64)
                listed = batch["ids"][i].values
                ids, missing = listed.fill_null(0).to_numpy(zero_copy_only=False), listed.is_null().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(page["terms"], block.terms), len(page["terms"]) - 1)
                here = page["terms"][at] == block.terms
                bound = np.where(here, weight * impact(page["most"][at], page["shortest"][at], documents, length), 0)
                end = np.cumsum(page["sizes"].astype(np.int64))
                begin = end - page["sizes"]
                scored: dict[int, tuple] = {}
                for q in np.flatnonzero(visits[:, batch["cluster"][i].as_py()]):
                    terms = block.of[q][here[block.of[q]]]
                    if bound[terms].sum() < floor[q] or not len(terms):
                        continue
                    for t in terms[[t not in scored for t in terms.tolist()]].tolist():
                        part = slice(begin[at[t]], end[at[t]])
                        docs, count = page["docs"][part], page["counts"][part].astype(np.int64)
                        more = slice(*np.searchsorted(large[0], (part.start, part.stop)))
                        count[large[0][more] - part.start] = large[1][more]
                        scored[t] = docs, (weight[t] * impact(count, page["lengths"][docs], documents, length)).astype(np.float64)
                    lists = [scored[t] for t in terms.tolist()]
                    score = np.bincount(np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists]), len(ids)).astype(np.int64)
                    able = np.flatnonzero(score >= floor[q])
                    if not len(able):
                        continue
                    found = [score[able], ids[able], missing[able]]
                    if q in best:
                        found = [np.concatenate(x) for x in zip(best[q], found, strict=True)]
                    top = _order(*found, k)
                    best[q] = [x[top] for x in found]
                    if len(top) == k:
                        floor[q] = max(floor[q], best[q][0][-1])
        for q, (score, ids, missing) in best.items():
            yield pa.record_batch([pa.array(np.full(len(score), q, np.int32)), pa.array(ids, mask=missing), pa.array(score)], ["query", "doc_id", "score"])

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(index: Index, block: Block, k: int, documents: int, length: int, log: list | None) -> DataFrame:
    """query, rank, doc_id, score of one block."""
    spark = index.pages.sparkSession
    held = _bounds(index.pages, block)
    cluster, term, df, most, shortest = (held[c].to_numpy() for c in ("cluster", "term", "df", "most", "shortest"))
    df = np.bincount(term, df, len(block.terms)).astype(np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    reach = np.zeros((index.clusters, len(block.terms)), np.int64)
    reach[cluster, term] = weight[term] * impact(most, shortest, documents, length)
    bound = np.stack([reach[:, t].sum(1) for t in block.of])
    order = np.argsort(-bound, axis=1, kind="stable")
    least, out, at, step = np.ones(len(block.of), np.int64), None, 0, FIRST
    while at < index.clusters:
        visits = np.zeros(bound.shape, bool)
        np.put_along_axis(visits, order[:, at : at + step], True, 1)
        # Exact stop: below the k-th score (or without any term) a cluster can't add to the list.
        visits &= bound >= least[:, None]
        if visits.any():
            wanted = [int(c) for c in np.flatnonzero(visits.any(0))]
            rows = index.pages.filter(F.col("cluster").isin(wanted)).drop("n_docs", "n_terms").mapInArrow(_visit(block, weight, visits, least, documents, length, k), "query int, doc_id long, score long")
            out = materialise(_ranked(rows if out is None else rows.unionByName(out.drop("rank")), k), "ranked")
            for q, n, last in out.groupBy("query").agg(F.count("*"), F.min("score")).collect():
                least[q] = last if n == k else 1
        if log is not None:
            log.append(int(visits.sum()))
        at, step = at + step, step * GROWTH
    ids = spark.createDataFrame(list(enumerate(block.ids)), "query int, item_id long")
    empty = spark.createDataFrame([], "query int, doc_id long, score long, rank int")
    return (empty if out is None else out).join(F.broadcast(ids), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = BEST, block_chars: int = BLOCK_CHARS, block_items: int = BLOCK_ITEMS, log: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query (item_id, text). log gets the visits (query and cluster) of each round."""
    spark = index.pages.sparkSession
    size = index.pages.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if size[0]:
        for block in _blocks(items, block_chars, block_items):
            with _few_pages_a_batch(spark):
                out = out.unionByName(_search_block(index, block, k, *size, log))
    return out
