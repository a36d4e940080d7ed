"""Personal data: four patterns, and an information-theoretic search for terms that give protected entities away.

Base spans come from patterns, found with split (the gaps) and regexp_extract_all (the matches), so that positions
follow without leaving SQL. Each distinct matched value is a protected entity. For each word of the documents that hold
it, wherever it stands, the corpus tells how much it discloses: the pointwise mutual information of word and entity over
documents, as a share of the entity's own information. The document that brings word and entity together is no evidence
for it, so it is left out: a word of T documents, `both` of them with an entity of E among N documents, discloses it if
(both - 1) / (T - 1) is at least (E / N) ** (1 - share), a bound that follows the corpus. A word that reaches it with
enough documents behind it is a disclosing term; all its occurrences, near the entity or far from it and in documents
without it too, become spans of kind `term` and are removed or generalised.

Copies are no evidence: documents with entities whose five-word shingles are alike count as one, with the words and the
entities of all of them. They are known by min-hash bands of BAND coordinates (likeness 0.8 shares one of BANDS bands
with probability 0.91, 0.9 with 0.998, 0.3 with 0.006), joined over bands to classes by labels that sink until none
changes. So T is the classes with entities that hold the word and the documents without entities that do.

Only documents with entities bring words up: a word's counts there bound its T from above, and a word that stands in
more of them already is left. What remains, the candidates, meets the distinct words of all documents once; texts meet
the keys of those that hold terms. Spark plans both joins by the size written: what is below its limit for broadcasts
moves, and beyond it words, or all texts, are shuffled once. Entities that stand in just the same classes are one, and so are words, as nothing in the counts
tells them apart, so a list of many entities, copied to many documents, is not all pairs.

Defined results: null and empty texts have no spans; spans are code points, end exclusive; rows with equal doc_id
share the spans of their own texts only (rows are keyed by id and text digest); an empty table gives no rows; extra
columns are ignored by the finders and kept by sanitise_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_name, materialise, row_key

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's patterns (a card's chain is maximal, so asking for 12 digits at once drops just shorter ones). Possessive repeats and the anchors only spare the matcher work: a match can begin inside a
#: run of its own characters only where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Share of an entity's information that a term must give, and documents that must show the pair.
SHARE, SUPPORT = 0.95, 2
#: Min-hash bands of near copies, coordinates of each, and words of a shingle.
BANDS, BAND, WIDTH = 8, 6, 5
#: Matches whose places are summed up in one piece of a text.
PIECE = 16
TERM = r"[\p{L}\p{N}]{2,}"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(text, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """(start, text) of each match, leftmost and non-overlapping: running lengths of gaps and matches, summed in pieces
    so that a long text takes time in proportion to its matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), found.alias("found"))
    empty = F.array().cast("array<struct<start:int,text:string>>")
    cut = lambda rows: F.transform(F.sequence(F.lit(0), F.size(rows), F.lit(PIECE)), lambda i: F.slice(rows, i + 1, PIECE))

    def step(a: Column, p: Column) -> Column:
        one = F.struct((a["at"] + p["gap"]).alias("start"), p["found"].alias("text"))
        return F.struct((a["at"] + p["gap"] + F.length(p["found"])).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    def piece(a: Column, rows: Column) -> Column:
        inner = F.aggregate(rows, F.struct(a["at"].alias("at"), empty.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(a["out"], F.array(inner["out"])).alias("out"))

    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,text:string>>>").alias("out"))
    # An array of one, so that the matches are found once and not for each piece.
    once = F.array(F.filter(pair, lambda p: p["found"].isNotNull()))
    return F.flatten(F.transform(once, lambda rows: F.aggregate(cut(rows), state, piece, lambda a: F.flatten(a["out"]))))


def _spans_of(kind: int, name: str, text: Column) -> Column:
    kept = F.filter(matches(text, PATTERNS[name]), lambda m: valid(name, m["text"]))
    end = lambda m: (m["start"] + F.length(m["text"])).alias("end")
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), end(m), m["text"].alias("text")))
    may = text.rlike(PATTERNS[name]) & (F.contains(text, F.lit(HINTS[name])) if HINTS[name] else F.lit(True))
    return F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>"))


def base_spans(text: Column) -> Column:
    """array of (start, kind, end, text) by start, then kind."""
    return F.array_sort(F.concat(*(_spans_of(i, name, text) for i, name in enumerate(PATTERNS))))


def words_of(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def runs_of(words: Column) -> Column:
    """Hashes of a text's runs of WIDTH words (of the whole sequence where there are fewer)."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - WIDTH + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WIDTH)))


def bands_of(runs: Column) -> Column:
    """Hashes of the min-hash bands of a text's runs."""
    least = [F.array_min(F.transform(runs, lambda x, i=i: F.xxhash64(x, F.lit(i)))) for i in range(BANDS * BAND)]
    return F.array(*(F.xxhash64(F.lit(b), *least[b * BAND : (b + 1) * BAND]) for b in range(BANDS)))


def copy_labels(signed: DataFrame) -> DataFrame:
    """sig, label: for each distinct signature (bands) the least one that shared bands lead to."""
    each = signed.select(F.xxhash64("bands").alias("sig"), "bands").distinct()
    at = materialise(each.select("sig", F.explode("bands").alias("band")), "bands")
    labels, before = at.select("sig", F.col("sig").alias("label")).distinct(), None
    while True:
        low = at.join(labels, "sig").groupBy("band").agg(F.min("label").alias("low"))
        labels = materialise(at.join(low, "band").groupBy("sig").agg(F.min("low").alias("label")), "labels")
        # Labels only sink, so their sum tells whether any did.
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


def _classes(held: DataFrame, name: str, least: int) -> DataFrame:
    """name, n, class of the values (held: label and name, distinct) of least labels or more: equal sets of labels
    (known by their size and two sums of their hashes) are one class."""
    held = held.withColumn("h", F.xxhash64("label"))
    counted = held.groupBy(name).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftrightunsigned("h", 33)).alias("s"))
    return counted.filter(F.col("n") >= least).select(name, "n", F.xxhash64("n", "x", "s").alias("class"))


def candidates(found: DataFrame, total: int, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """term, n, most: words that disclose an entity unless they stand in more than `most` documents in all; n counts the
    classes of documents with entities that hold them. found: key, base, words, bands of the documents with entities."""
    support = max(support, 2)
    held = found.dropDuplicates(["key"]).withColumn("sig", F.xxhash64("bands")).join(copy_labels(found), "sig")
    values = F.array_distinct(F.transform("base", lambda b: F.xxhash64(b["kind"], b["text"])))
    entity = materialise(held.select("label", F.explode(values).alias("entity")).distinct(), "held-entities")
    term = materialise(held.select("label", F.explode("words").alias("term")).distinct(), "held-words")
    entities, terms = _classes(entity, "entity", support), materialise(_classes(term, "term", support), "words")
    of_entity = entity.join(entities, "entity").select("label", F.col("class").alias("a"), F.col("n").alias("na")).distinct()
    of_term = term.join(terms, "term").select("label", F.col("class").alias("b")).distinct()
    pairs = of_entity.join(of_term, "label").groupBy("a", "b", "na").agg(F.count("*").alias("both"))
    pairs = pairs.filter((F.col("both") >= support) & (F.col("na") < total))
    most = F.lit(1) + (F.col("both") - 1) * F.pow(F.lit(float(total)) / F.col("na"), F.lit(1 - share)) + 1e-9
    bound = pairs.groupBy(F.col("b").alias("class")).agg(F.max(most).alias("most"))
    return terms.join(bound, "class").filter(F.col("n") <= F.col("most")).select("term", "n", "most")


def term_spans(docs: DataFrame, found: DataFrame, some: DataFrame) -> DataFrame:
    """key, hits: (start, kind, end) of every occurrence of the disclosing terms among some (term, n, most), for each
    text that holds any. found: key and base of all docs."""
    keyed = docs.select(row_key().alias("key"), "text")
    words = keyed.select("key", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    # Repeated rows repeat their words, so a document is counted by its key.
    met = materialise(words.join(some.select("term"), "term").distinct(), "met")
    bare = met.join(found.filter(F.size("base") > 0).select("key"), "key", "left_anti")
    seen = some.join(bare.groupBy("term").agg(F.count("*").alias("more")), "term", "left")
    terms = seen.filter(F.col("n") + F.coalesce("more", F.lit(0)) <= F.col("most")).select("term")
    held = materialise(met.join(terms, "term").groupBy("key").agg(F.collect_set("term").alias("terms")), "term-keys")
    texts = keyed.join(held, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("terms").alias("terms"))
    places = F.filter(matches(F.col("text"), TERM), lambda m: F.array_contains("terms", F.lower(m["text"])))
    end = lambda m: (m["start"] + F.length(m["text"])).alias("end")
    hits = F.transform(places, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), end(m)))
    return texts.select("key", hits.alias("hits"))


def find_personal(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """doc_id, key, base and spans: (start, kind, end) of the patterns, and of the patterns and disclosing terms."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = base.select("doc_id", row_key().alias("key"), "text", base_spans(F.col("text")).alias("base"))
    # Column by column, as words and runs are each used many times.
    holds = F.size("base") > 0
    first = first.withColumn("said", F.when(holds, words_of(F.col("text")))).withColumn("runs", F.when(holds, runs_of(F.col("said"))))
    bands = F.when(holds, bands_of(F.col("runs")))
    first = first.select("doc_id", "key", "base", F.array_distinct("said").alias("words"), bands.alias("bands"))
    found = materialise(first, "personal")
    own = F.transform("base", lambda b: b.dropFields("text"))
    some = materialise(candidates(found.filter(F.size("base") > 0), found.count(), share, support), "candidates")
    if some.isEmpty():
        return found.select("doc_id", "key", own.alias("base"), own.alias("spans"))
    hits = F.coalesce("hits", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    free = F.filter(hits, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    joined = found.join(term_spans(base, found, some), "key", "left")
    return joined.select("doc_id", "key", own.alias("base"), F.array_sort(F.concat(own, free)).alias("spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by the name of its kind; spans that overlap become one."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))


def sanitise_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with texts sanitised; other columns as they are (n_chars, where there, is counted anew)."""
    key, spans = fresh_name(docs, "key"), fresh_name(docs, "spans")
    found = find_personal(docs, **options).filter(F.size("spans") > 0).select(F.col("key").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    joined = docs.withColumn(key, row_key()).join(found, key, "left")
    clean = F.when(F.col(spans).isNotNull(), sanitise(F.coalesce("text", F.lit("")), F.col(spans))).otherwise(F.col("text"))
    out = joined.withColumn("text", clean).select(docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
