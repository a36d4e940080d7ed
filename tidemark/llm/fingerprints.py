"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit shingle hashes. The union of two sketches, cut to k
again, is the sketch of the united sets, so sketches merge across parts. From two sketches come estimates of
resemblance (Jaccard), containment and, from the k-th value, the number of distinct shingles.

Defined results: a null or empty text has the empty sketch; two empty sketches resemble fully, an empty and another
one not at all; a text of fewer words than a shingle is one shingle; equal texts have equal sketches; repeated rows
each keep theirs; the text that follows the last document is the first one's (its own for a single document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_blocks

#: Code points that separate words.
SPACES = " \t\n\x0b\x0c\r"

K, WORDS = 128, 5
#: Quantiles of the ids that reach the driver, and the most ranges (one id of each is broadcast), at any size.
QUANTILES, RANGES = 256, 200_000


def sketch(text: Column, k: int = K, width: int = WORDS) -> Column:
    """Bottom-k sketch of the text's runs of width words (split at ASCII white space, A-Z lower-cased)."""
    bare = F.btrim(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(SPACES))
    words = F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: _cut(_shingles(h, width), k))[0]


def _shingles(h: Column, width: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(*(F.element_at(h, (i + j).cast("int")) for j in range(width))))
    return F.when(F.size(h) >= width, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def _cut(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(values)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k smallest hashes that both sketches hold."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1))).cast("double")


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the distinct counts."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(na == 0, 1.0).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((r + 1) * F.greatest(na, F.lit(1.0)))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the k-th smallest hash's place in the range of hashes."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def text_form(a: Column) -> Column:
    """A sketch as a string: its hashes as 16 hex digits each, packed in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def merge_parts(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K, fan: int = 64, depth: int = 3) -> DataFrame:
    """One sketch for each key, merged in rounds: each task joins the sketches of a salt, so a hot key never meets whole."""
    out = sketches.select(*keys, F.col(column).alias("s")).withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(fan**depth)))
    for level in range(depth - 1, -1, -1):
        out = out.groupBy(*keys, F.pmod("salt", F.lit(fan**level)).alias("salt")).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("s")))), 1, k).alias("s"))
    return out.select(*keys, F.col("s").alias(column))


def ranges(docs: DataFrame, n: int, id_column: str = "doc_id", most: int = QUANTILES) -> Column:
    """The range that an id falls into, ascending with the id (null: the first); ranges hold about equal row counts.

    At most so many quantiles reach the driver; where more ranges are wanted, each quantile range is cut evenly by value.
    """
    k, column = min(n, most), F.col(id_column)
    if k < 2:
        return F.lit(0)
    found = docs.agg(F.percentile_approx(id_column, [i / k for i in range(1, k)], 10 * k).alias("inner"), F.min(id_column).alias("low"), F.max(id_column).alias("high")).first()
    if found["low"] is None or found["low"] == found["high"]:
        return F.lit(0)
    edges, cuts = sorted({found["low"], *found["inner"], found["high"]}), -(-n // k)
    held = F.array(*map(F.lit, edges))
    at = F.greatest(F.size(F.filter(F.slice(held, 1, len(edges) - 1), lambda e: e < column)), F.lit(1))
    low, high = F.element_at(held, at).cast("double"), F.element_at(held, at + 1).cast("double")
    inside = F.lit(0) if cuts == 1 else F.least(F.floor((column.cast("double") - low) / (high - low + 1) * cuts), F.lit(cuts - 1))
    return F.when(column.isNull(), 0).otherwise(((at - 1) * cuts + inside).cast("int"))


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WORDS, range_bytes: int = 8 << 20) -> DataFrame:
    """Sketches of every text and of its edited text: the last floor(n/2) code points replaced by the next row's first.

    Next means next by doc_id, found without a global sort: rows go to ranges of ids, a window in each range gives the
    next row, and the first row of each range is joined to the range before it. Texts are shuffled once.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = base.withColumn("part", ranges(base, min(n_blocks(base, "text", range_bytes), RANGES)))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    # Heads: the smallest id of each range; at most RANGES rows.
    first = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("at"))
    ring = first.withColumn("before", F.lag("part").over(Window.orderBy("part")))
    end = first.agg(F.max("part").alias("end"))
    ring = ring.crossJoin(F.broadcast(end)).select(F.coalesce("before", "end").alias("of"), F.col("at.doc_id").alias("head_id"))
    heads = placed.join(F.broadcast(ring), F.col("doc_id").eqNullSafe(F.col("head_id"))).groupBy("of").agg(F.min("text").alias("head_text")).withColumn("head_sketch", sketch(F.col("head_text"), k, width))
    moved = placed.withColumn("next_text", F.lead("text").over(order)).join(heads, F.col("part") == F.col("of"), "left")
    size, other = F.length("text"), F.coalesce("next_text", "head_text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - half), F.substr(other, F.lit(1), half))
    both = moved.select("doc_id", "part", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "head_sketch")
    both = both.withColumn("sketch", sketch(F.col("text"), k, width)).withColumn("edited_sketch", sketch(F.col("edited"), k, width))
    both = both.withColumn("next_sketch", F.coalesce(F.lead("sketch").over(order), "head_sketch"))
    return both.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
