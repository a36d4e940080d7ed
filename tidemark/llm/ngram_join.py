"""Exact Jaccard self-join of documents on word shingles, by prefix filters under several global token orders.

For a threshold t, two sets of Jaccard t or more share a token among the first n - ceil(t n) + 1 tokens of each, under
any order of all tokens. Three orders are used, each by document frequency first (exactly, exactly, coarsely) and then
by a hash of its own; a pair is a candidate only if it shares prefix tokens under all three.

1. Frequencies. Documents are dealt to blocks. Each block sends its distinct shingles (packed, pre-counted) to shards
   by hash range; a shard sums them and answers with one byte a shingle. The frequency only orders tokens, so the
   48-bit form of the hash that travels can't change the result.
2. Prefixes. Each block joins the answers. Tokens of frequency one can't be shared and are left out, so most documents
   have no prefix left and take no further part. Equal sets become one class (aggregated before anything meets).
3. Pages. Classes are laid out in pages of bounded size, those of equal min-hash together. Each page verifies its own
   candidates and names the groups it finds.
4. Neighbours. At each prefix token the pages that hold it meet the least of them, over a tree of buckets, so that a
   group of many pages is united by a number of tasks in proportion to its pages. Only one row a pair of groups comes out.
5. The rest. A link between two components needs a token under the first order and one under the second that both hold.
   Only the classes that hold such contested tokens under both orders are left; they are laid out in new, full pages, each
   of classes that such tokens connect, and pages meet that share contested tokens under both. So no link between two components is
   missed, and what has become one component isn't compared again.
6. Components by minimum labels with pointer jumping, each round written to the shared folder.

Joins on keys that a third of the rows may share have a written table of distinct keys on their other side, so that
adaptive execution splits the hot partition.

Sets hold 64-bit hashes of shingles, so two different shingles are taken for one with probability about 2**-64.

Defined results: null texts and texts without words have the empty set, n_shingles 0, and are their own component;
equal rows are linked; a row of null doc_id belongs to its component but never names it unless all its ids are null;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_name, materialise, mix, n_blocks, row_key, shingle_hashes, slices, word_hashes

#: Per cent of the union, words in a shingle, bytes of text in a block, weight of a page in shingles.
PERCENT, WIDTH, BLOCK_BYTES, PAGE_TOKENS = 90, 3, 4 << 20, 100_000
#: What a class weighs in a page beside its shingles; buckets of the pages that hold a token.
PAGE_CLASS, FAN = 100, 256
#: How many times as much a page of the classes that meet again may hold.
REST = 2
#: Columns of tokens of which a linked pair shares one each; tables may lack the last.
FILTERS = ("first", "second", "third")
SALTS = (np.uint64(0), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _sets(texts: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for _, part in slices(texts):
        hashes, counts = shingle_hashes(*word_hashes(part), width)
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            s = np.sort(hashes[a:b])
            out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit keys of a block, and the number of its sets that hold each."""
    joined = np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(16)
    joined.sort()
    first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1])) if len(joined) else np.empty(0, np.int64)
    return joined[first], np.diff(np.append(first, len(joined)))


def _runs(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that sorted 48-bit keys belong to, each once, and where each one's run begins, and the end."""
    at = (keys >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
    return at[begin].astype(np.int64), np.append(begin, len(keys))


def frequencies(base: DataFrame, width: int, shards: int) -> DataFrame:
    """block, shard, codes: a byte for each of the block's keys in that shard, growing with document frequency (0: one)."""

    def ask(table: pa.Table) -> pa.Table:
        keys, counts = _keys(_sets(table["text"], width))
        to, edge = _runs(keys, shards)
        rows = [(s, keys[a:b], counts[a:b]) for s, a, b in zip(to, edge, edge[1:], strict=False)]
        return pa.table({
            "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int32()), "shard": pa.array([r[0] for r in rows], pa.int32()),
            "low": pa.array([(r[1] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for r in rows], pa.binary()), "high": pa.array([(r[1] >> np.uint64(32)).astype("<u2").tobytes() for r in rows], pa.binary()),
            "counts": pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        low, high, counts = ([np.frombuffer(v.as_py(), t) for v in table[c]] for c, t in (("low", "<u4"), ("high", "<u2"), ("counts", "<u4")))
        keys = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
        _, slot = np.unique(keys, return_inverse=True)
        total = np.bincount(slot, weights=np.concatenate(counts))
        code = np.minimum(255, np.floor(4 * np.log2(total))).astype(np.uint8)[slot]
        ends = np.cumsum([len(x) for x in low])
        return pa.table({"block": table["block"], "shard": table["shard"], "codes": pa.array([code[e - len(x) : e].tobytes() for e, x in zip(ends, low, strict=True)], pa.binary())})

    asked = base.groupBy("block").applyInArrow(ask, "block int, shard int, low binary, high binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "block int, shard int, codes binary")


def prefixes(base: DataFrame, answers: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row, n, node (names the set), first/second/third (prefix tokens shared with other sets), home (min-hash), items (the set)."""
    schema = "doc_id long, row string, n long, node long, first array<long>, second array<long>, third array<long>, home long, items binary"

    def finish(docs: pa.Table, got: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({c: pa.array([], t) for c, t in _ARROW})
        sets = _sets(docs["text"], width)
        keys, _ = _keys(sets)
        order = np.argsort(got["shard"].to_numpy())
        blobs = got["codes"].to_pylist()
        code = np.frombuffer(b"".join(blobs[i] for i in order), np.uint8)
        rows: dict[str, list] = {c: [] for c, _ in _ARROW[2:]}
        for s in sets:
            n = len(s)
            own = code[np.searchsorted(keys, s >> np.uint64(16))] if n else np.empty(0, np.uint8)
            size = n - -(-percent * n // 100) + 1
            # Sets this small differ too much from any other set to reach the threshold.
            able = n and 100 * n >= percent * (n + 1)
            cut = []
            for i, salt in enumerate(SALTS):
                if not able:
                    cut.append(s[:0])
                    continue
                rank = np.lexsort((mix(s ^ salt), own >> np.uint8(3) if i == 2 else own))[:size]
                cut.append(s[rank[own[rank] > 0]])
            live = all(len(c) for c in cut)
            rows["n"].append(n)
            rows["node"].append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
            for c, x in zip(("first", "second", "third"), cut, strict=True):
                rows[c].append(x.astype(np.int64) if live else None)
            rows["home"].append(int(mix(s ^ SALTS[1]).min().astype(np.int64)) if live else None)
            rows["items"].append(s.tobytes() if live else None)
        return pa.table({"doc_id": docs["doc_id"], "row": docs["row"]} | {c: pa.array(rows[c], t) for c, t in _ARROW[2:]})

    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


_ARROW = [("doc_id", pa.int64()), ("row", pa.string()), ("n", pa.int64()), ("node", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("first", "second", "third")), ("home", pa.int64()), ("items", pa.binary())]


def _shared(lists: list[np.ndarray], exact: bool) -> np.ndarray:
    """Number of values that each two lists share (any number counts as one unless exact), by products of bounded width."""
    m = len(lists)
    out = np.zeros((m, m), np.float32)
    sizes = np.array([len(x) for x in lists])
    values = np.concatenate([*lists, lists[0][:0]])
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    if not len(values):
        return out
    fresh = np.append(True, values[1:] != values[:-1])
    number = np.cumsum(fresh) - 1
    common = np.bincount(number)[number] > 1
    owner, number = owner[common], number[common]
    number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1 if len(number) else number
    step = 4096
    for a in range(0, int(number.max(initial=-1)) + 1, step):
        lo, hi = np.searchsorted(number, (a, a + step))
        has = np.zeros((m, step), np.float32)
        has[owner[lo:hi], number[lo:hi] - a] = 1
        out += has @ has.T
    return out if exact else (out > 0)


def _unite(names: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """(name, least name of its group) of all names that the pairs of indices bring together with a lesser one."""
    values, at = np.unique(names, return_inverse=True)
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in at[pairs].tolist():
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [(int(values[i]), int(values[r])) for i in range(len(values)) if (r := find(i)) != i]


def _linked(table: pa.Table, percent: int, may: np.ndarray) -> np.ndarray:
    """Index pairs (i < j) of the classes that reach the threshold, among those that may: filters, then exact sizes."""
    n = table["n"].to_numpy()
    may &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    np.fill_diagonal(may, False)
    for c in FILTERS:
        if c in table.column_names and may.any():
            may &= _shared([np.array(v, np.int64) for v in table[c].to_pylist()], False)
    live = np.flatnonzero(may.any(axis=1))
    if not len(live):
        return np.empty((0, 2), np.int64)
    both = _shared([np.frombuffer(table["items"][int(i)].as_py(), np.uint64) for i in live], True).astype(np.int64)
    linked = may[np.ix_(live, live)] & (100 * both >= percent * (n[live][:, None] + n[live][None, :] - both))
    return live[np.argwhere(np.triu(linked))]


def _group_page(percent: int):
    """The page's rows with `part`: the least node of the group that each class belongs to within the page."""

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        least = dict(_unite(node, _linked(table, percent, np.ones((len(node), len(node)), bool)))) if len(node) > 1 else {}
        return table.append_column("part", pa.array([least.get(x, x) for x in node.tolist()], pa.int64()))

    return run


def _meet(percent: int, all_pairs: bool = False):
    """a, b of the parts that links between two pages bring together (or, for all_pairs, all linked nodes)."""

    def run(table: pa.Table) -> pa.Table:
        page, part = table["page"].to_numpy(), table["part"].to_numpy()
        may = (page[:, None] != page[None, :]) | (len(np.unique(page)) == 1)
        pairs = _linked(table, percent, may if all_pairs else may & (part[:, None] != part[None, :]))
        node = table["node"].to_numpy()
        rows = np.sort(node[pairs], axis=1).tolist() if all_pairs else _unite(part, pairs)
        a, b = zip(*rows, strict=True) if rows else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of an undirected edge table (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialise(both, "edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        after = materialise(stepped.join(jump, stepped["root"] == jump["at"], "left").select("node", "old", F.least("root", "beyond").alias("root")), "labels")
        if after.filter("old <> root").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def _pages(docs: DataFrame, percent: int, width: int, block_bytes: int, page_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Every document's set by name (doc_id, n, node, ...), and the classes with prefixes in pages, grouped within each."""
    base = docs.select("doc_id", row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = n_blocks(base, "text", block_bytes)
    base = base.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    sets = materialise(prefixes(base, frequencies(base, width, blocks // 2 + 1), width, percent), "sets")
    live = sets.filter(F.col("items").isNotNull()).drop("doc_id", "row").dropDuplicates(["node"])
    return sets, lay_out(materialise(live, "live"), percent, page_tokens)


def _dealt(classes: DataFrame, page_tokens: int) -> DataFrame:
    """The classes with a page instead of their home: one page for each home, or several where a home weighs more than one holds."""
    # A class weighs its tokens and PAGE_CLASS more, so a page has bounded numbers of both.
    large = classes.groupBy("home").agg(F.ceil(F.sum(F.col("n") + PAGE_CLASS) / page_tokens).alias("pages")).filter("pages > 1")
    slot = F.pmod(F.xxhash64("node"), F.coalesce("pages", F.lit(1)))
    return classes.join(materialise(large, "homes"), "home", "left").withColumn("page", F.xxhash64("home", slot)).drop("home", "pages")


def lay_out(live: DataFrame, percent: int, page_tokens: int) -> DataFrame:
    """Classes (node, n, home, items and their filters) in pages of bounded size, grouped within each: page and part beside them."""
    paged = _dealt(live, page_tokens)
    held = [c for c in FILTERS if c in live.columns]
    schema = f"node long, n long, {', '.join(f'{c} array<long>' for c in held)}, items binary, page long"
    paged = paged.select("node", "n", *held, "items", "page")
    return materialise(paged.groupBy("page").applyInArrow(_group_page(percent), f"{schema}, part long"), "pages")


def _neighbours(paged: DataFrame) -> DataFrame:
    """Pairs of pages: at each token of the first order each page with the least one of its bucket, and those with the least of all."""
    at, out = paged.select("page", F.explode("first").alias("token")).distinct(), None
    for buckets in (FAN, 1):
        keyed = at.withColumn("bucket", F.pmod(F.xxhash64("page"), F.lit(buckets)))
        heads = keyed.groupBy("token", "bucket").agg(F.min("page").alias("p"))
        pairs = keyed.join(heads, ["token", "bucket"]).filter("p < page").select("p", F.col("page").alias("q"))
        out = pairs if out is None else out.unionByName(pairs)
        at = heads.select("token", F.col("p").alias("page"))
    return materialise(out.distinct(), "meetings")


def _meetings(classes: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Pairs of pages that share tokens under the first and the second order, tokens of one component left out."""

    def by(column: str) -> DataFrame:
        at = classes.select("page", "part", F.explode(column).alias("token")).groupBy("token", "page").agg(F.min("part").alias("low"), F.max("part").alias("high"))
        if not all_pairs:
            several = at.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y")).filter("x < y").select("token")
            at = materialise(at.join(materialise(several, "tokens"), "token"), "holders")
        a, b = at.select("token", F.col("page").alias("p"), F.col("low").alias("l"), F.col("high").alias("h")), at.select("token", F.col("page").alias("q"), "low", "high")
        differ = (F.least("l", "low") < F.greatest("h", "high")) | F.lit(all_pairs)
        return a.join(b, "token").filter((F.col("p") < F.col("q")) & differ).select("p", "q").distinct()

    first = materialise(by("first"), "meetings")
    return first if first.isEmpty() else materialise(first.join(by("second"), ["p", "q"]), "meetings")


def _both(pairs: DataFrame, paged: DataFrame) -> DataFrame:
    """The classes of both pages of each pair."""
    return pairs.select("p", "q", F.explode(F.array("p", "q")).alias("page")).join(paged, "page")


def _contested(classes: DataFrame, column: str) -> DataFrame:
    """The classes that hold tokens of several components in that column, with those tokens only."""
    at = classes.select("node", "part", F.explode(column).alias("token"))
    several = at.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("token")
    held = at.join(materialise(several, "tokens"), "token").groupBy("node").agg(F.collect_list("token").alias(column))
    return materialise(classes.drop(column).join(held, "node"), "contested")


def _topics(rest: DataFrame) -> DataFrame:
    """part, root of the components that first tokens connect, over however many others."""
    at = rest.select("part", F.explode("first").alias("token")).distinct()
    heads = at.groupBy("token").agg(F.min("part").alias("b"))
    return components(at.join(materialise(heads, "heads"), "token").select(F.col("part").alias("a"), "b")).withColumnRenamed("node", "part")


def _classes(paged: DataFrame, percent: int, page_tokens: int) -> DataFrame:
    """node, root of every class that is linked with another one."""
    first = materialise(_both(_neighbours(paged), paged).groupBy("p", "q").applyInArrow(_meet(percent), "a long, b long"), "links")
    united = components(first)
    narrow = paged.select("node", "part", "first", "second").join(united.withColumnRenamed("node", "part"), "part", "left").withColumn("part", F.coalesce("root", "part")).drop("root")
    narrow = materialise(narrow, "parts")
    out = narrow.select("node", F.col("part").alias("root"))
    rest = _contested(narrow, "first")
    rest = rest if rest.isEmpty() else _contested(rest, "second")
    if rest.isEmpty():
        return out
    # Only these classes still have to meet others. They are laid out anew, those that tokens connect together.
    whole = paged.drop("page", "part", "first", "second").join(rest, "node").join(_topics(rest), "part", "left").withColumn("home", F.coalesce("root", "part")).drop("root")
    again = materialise(_dealt(materialise(whole, "rest"), REST * page_tokens), "again")
    pairs = _meetings(again).unionByName(again.select(F.col("page").alias("p"), F.col("page").alias("q")).distinct())
    named = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("page")).join(again, "page")
    more = components(materialise(named.groupBy("p", "q").applyInArrow(_meet(percent), "a long, b long"), "links"))
    return out.withColumnRenamed("root", "part").join(more.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("root", "part").alias("root"))


def _roots(sets: DataFrame, paged: DataFrame, percent: int, page_tokens: int) -> DataFrame:
    """node, root, least (document id) of every class; root is null for a class that is linked with no other."""
    found = _classes(paged, percent, page_tokens)
    held = found.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    linked = found.join(materialise(held.select("root"), "held"), "root")
    return materialise(sets.groupBy("node").agg(F.min("doc_id").alias("least")).join(linked, "node", "left"), "roots")


def join_documents(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document."""
    sets, paged = _pages(docs, percent, width, block_bytes, page_tokens)
    return by_components(sets.select("doc_id", "n", "node"), paged, percent, page_tokens)


def by_components(sets: DataFrame, paged: DataFrame, percent: int, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id of documents with their sets' names, from the pages of classes that may be linked."""
    named = _roots(sets, paged, percent, page_tokens)
    ids = materialise(named.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component")), "ids")
    named = named.filter("root IS NULL").select("node", F.col("least").alias("component")).unionByName(named.join(ids, "root").select("node", "component"))
    of = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return sets.select("doc_id", "n", "node").join(materialise(named, "named"), "node").select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"))


def link_documents(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, page_tokens: int = PAGE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Every link, not only components: doc_id, node of all documents with words, and a, b of all linked pairs of
    different sets by their nodes. Documents of one node are linked with each other; as many pairs come out as there are."""
    sets, paged = _pages(docs, percent, width, block_bytes, page_tokens)
    within = paged.withColumns({"p": F.col("page"), "q": F.col("page")})
    found = _both(_meetings(paged, all_pairs=True), paged).unionByName(within).groupBy("p", "q").applyInArrow(_meet(percent, all_pairs=True), "a long, b long")
    return sets.filter("n > 0").select("doc_id", "node"), materialise(found, "links")


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """docs with one row of each component: the one of least id (null comes last). Rows without words all stay.

    Rows are told apart by id and text, so rows of one id or of none keep or lose their place by their own texts; of
    rows equal in both, one stays.
    """
    sets, paged = _pages(docs, percent, width, block_bytes, page_tokens)
    return keep_least(docs, sets, paged, percent, page_tokens)


def keep_least(docs: DataFrame, sets: DataFrame, paged: DataFrame, percent: int, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """docs without the rows that aren't the least of their component; sets: doc_id, row, n, node of each."""
    rows = sets.filter("n > 0").select("doc_id", "row", "node").join(_roots(sets, paged, percent, page_tokens).withColumn("root", F.coalesce("root", "node")), "node")
    rows = materialise(rows.groupBy("root", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    judged = rows.join(materialise(best, "best"), "root").withColumn("stays", F.col("row") == F.col("best.row"))
    name = fresh_name(docs, "row")
    gone = materialise(judged.filter(~F.col("stays")).select(F.col("row").alias(name)), "gone")
    twice = materialise(judged.filter(F.col("stays") & (F.col("copies") > 1)).select(F.col("row").alias(name)), "twice")
    out = docs.withColumn(name, row_key()).join(gone, name, "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, name, "left_anti").unionByName(out.join(twice, name, "left_semi").dropDuplicates([name]))
    return out.select(docs.columns)
