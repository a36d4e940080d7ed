"""Every corpus query against a plain version, on the smallest tables and on a table of awkward rows."""

import base64
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from tidemark.llm import bpe, chat, decontamination, fingerprints, ngram_join, ngram_model, pii, quality, queries_chat, registry, secret_scan, token_counts

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "a1 b2 c3 " * 3000 + "x" * 9000 + " " * 7000 + "été " * 500
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "One TWO"), (7, LONG), (8, LONG), (9, LONG + "end"), (10, "mail a.b@c.de and +49 (30) 123-456 78, 4111 1111 1111 1111, 10.0.0.256 or 10.0.0.1"),
    (11, 'api_key = "abcdefghijkl" AKIA' + "B7" * 9 + " 0123456789abcdef0"), (12, "日本語 text " + chr(0x1F600) * 40), (13, "one two"), (14, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (15, "a b c d e f g h i j k l m n o p q r s t u v w x y zz"), (16, "1" * 5000 + "@" + "." * 3000),
]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder with the awkward documents (extra columns whose names clash with internal ones) and an empty table."""
    top = tmp_path_factory.mktemp("awkward")
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 1, "x", 2) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, block int, node string, page int")
    rows.write.parquet(f"{top}/some/documents.parquet")
    rows.limit(0).write.parquet(f"{top}/none/documents.parquet")
    for d in ("some", "none"):
        spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from the bear")], "item_id long, text string").write.parquet(f"{top}/{d}/benchmark.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/{d}/labels.parquet")
        spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "<\\|"), (None, None, "a\\n\nb", "<|<\\\\|")] if d == "some" else [], "conv_id long, turn long, role string, text string").write.parquet(f"{top}/{d}/conversations.parquet")
    return str(top)


@pytest.fixture(scope="module", params=["small", "awkward"])
def case(request, spark, awkward):
    """A folder and its documents as (id, text)."""
    at = SF if request.param == "small" else f"{awkward}/some"
    return at, [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{at}/documents.parquet").collect()]


def result(spark, name, case):
    out = registry.QUERIES[name](spark, case[0])
    return {r["doc_id"]: r for r in out.collect()}


def test_fingerprints(spark, case):
    got, order = result(spark, "op2_fingerprints", case), sorted(case[1])
    errors = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), sha(edited))
        a, b, c = (brute.shingles(x, 5) for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        errors += [got[d]["near_edited"] - like(a, b), got[d]["near_next"] - like(a, c)]
    assert np.abs(errors).max() < 0.2 and np.abs(errors).mean() < 0.03


def test_fingerprints_estimate_containment_and_distinct_shingles(spark):
    """Parts of one long text in it and in each other, against their sets; small sketches, so that estimates are not exact."""
    words = [f"w{(31 * i) % 4001}" for i in range(3000)]
    texts = [" ".join(words[:n]) for n in (0, 3, 40, 300, 900, 1500, 3000)] + [" ".join(words[1000:2600]), "other words that it does not hold at all"]
    pairs = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    held = pairs.select("i", "j", fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    sets, errors = [brute.shingles(t, 5) for t in texts], []
    for r in held.select("i", "j", fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n")).collect():
        a, b = sets[r["i"]], sets[r["j"]]
        errors.append(r["c"] - (len(a & b) / len(a) if a else 1.0))
        # So many of the union's smallest hashes are of a, and tell whether b has them.
        seen = fingerprints.K * len(a) / len(a | b) if len(a | b) > fingerprints.K else math.inf
        assert abs(errors[-1]) < (2 / math.sqrt(seen) if seen else 1) + 1e-9
        assert abs(r["n"] - len(a)) <= (0 if len(a) < fingerprints.K else 0.3 * len(a))
    assert np.abs(errors).mean() < 0.06


def test_fingerprints_in_more_ranges_than_quantiles(spark):
    """Uneven, extreme and repeated ids in far more ranges than quantiles: the next text is still the next row's."""
    ids = sorted([-(2**63), 2**63 - 1, 7, 7] + [i**3 for i in range(-150, 150)] + list(range(10**12, 10**12 + 150)))
    rows = sorted((d, f"text {n} of id {d} " * (1 + n % 5)) for n, d in enumerate(ids))
    docs = spark.createDataFrame([*rows[::-1], (None, "no id")], "doc_id long, text string").repartition(6)
    order = [(None, "no id"), *rows]
    n = sum(len(t) for _, t in order) // 20
    assert n > 3 * fingerprints.QUANTILES
    assert docs.select(fingerprints.ranges(docs, n).alias("part")).distinct().count() > fingerprints.QUANTILES
    got = sorted(((r["doc_id"], r["edited"]) for r in fingerprints.edited_fingerprints(docs, range_bytes=20).select("doc_id", "edited").collect()), key=lambda r: (r[0] is not None, *r))
    want = [(d, t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2]) for i, (d, t) in enumerate(order)]
    assert got == sorted(want, key=lambda r: (r[0] is not None, *r))


def test_fingerprints_merge_across_parts(spark):
    words = [" ".join(f"w{(7 * i + j) % 997}" for j in range(200)) for i in range(30)]
    parts = spark.createDataFrame([(i % 2, w) for i, w in enumerate(words)], "k int, text string").select("k", fingerprints.sketch(F.col("text")).alias("sketch"))
    got = {r["k"]: r["sketch"] for r in fingerprints.merge_parts(parts, ["k"]).collect()}
    for k in (0, 1):
        held = sorted(set().union(*(r["sketch"] for r in parts.filter(F.col("k") == k).collect())))
        assert got[k] == held[: fingerprints.K]


def test_byte_bpe(spark, case):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op3_byte_bpe", case)
    for d, t in case[1]:
        ids = library.encode_ordinary(t)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))


def test_byte_bpe_round_trip(spark, case):
    docs = spark.read.parquet(f"{case[0]}/documents.parquet")
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted(case[1])


def test_ngram_join(spark, case):
    got = result(spark, "op4_ngram_join", case)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: v[:2] for d, v in brute.linked(dict(case[1])).items()}


def test_ngram_join_in_small_pages(spark, tmp_path):
    """Many near copies over many pages and blocks: the same groups as all pairs give."""
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(90):
        words = list(base if i % 3 else [f"v{i % 9}_{j}" for j in range(60)])
        words[i % len(words)] = f"edit{i // 2}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.linked(dict(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs, block_bytes=2000, page_tokens=500).collect()}
    assert got == {d: v[:2] for d, v in want.items()}
    nodes, links = ngram_join.link_documents(docs, block_bytes=2000, page_tokens=500)
    of, count = {r["doc_id"]: r["node"] for r in nodes.collect()}, {d: -1 for d in dict(rows)}
    pairs = [tuple(r) for r in links.collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    for d in count:
        beside = {b if a == of[d] else a for a, b in pairs if of[d] in (a, b)} | {of[d]}
        count[d] += sum(of[e] in beside for e in of)
    assert count == {d: v[2] for d, v in want.items()}
    wide = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(docs, 80, 5, block_bytes=2000, page_tokens=500).collect()}
    assert wide == {d: c for d, (_, c, _) in brute.linked(dict(rows), 80, 5).items()}


def test_token_counts(spark, case):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = result(spark, "op5_token_counts", case)
    for d, t in case[1]:
        n = len(library.encode(t, add_special_tokens=False))
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_token_query_meets_its_cache(spark, awkward, monkeypatch):
    """A second run of the registered query encodes nothing; texts that differ in white space or ASCII case share a count."""
    rows = sorted(map(tuple, registry.QUERIES["op5_token_counts"](spark, f"{awkward}/some").collect()))
    monkeypatch.setattr(token_counts, "_encode", None)
    assert sorted(map(tuple, registry.QUERIES["op5_token_counts"](spark, f"{awkward}/some").collect())) == rows
    docs = spark.createDataFrame([(None, " ONE   two"), (None, "one"), (None, "one"), (4, "one\ttwo\n")], "doc_id long, text string")
    got = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == [(3, 1), (3, 1), (8, 2), (10, 2)]


def test_token_normal_form_keeps_counts(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"{a}{b}{c} {b}{a}" for a in "AZJHTWY aé" for b in ("", " ", "\t\n", "\u030c", "'S", "\u0331", "12", "İ") for c in "xK\u212a"]
    forms = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(token_counts.normal_form(F.col("text"))).collect()]
    for t, f in zip(texts, forms, strict=True):
        assert len(library.encode(t, add_special_tokens=False)) == len(library.encode(f, add_special_tokens=False)), t


def test_token_cache_is_kept(spark, awkward, tmp_path):
    docs = spark.read.parquet(f"{awkward}/some/documents.parquet")
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts.count_tokens(docs, path, cache).collect()))
    stored = spark.read.parquet(cache).count()
    assert stored == len({" ".join((t or "").lower().split()) for _, t in AWKWARD})
    assert sorted(map(tuple, token_counts.count_tokens(docs, path, cache).collect())) == first
    assert spark.read.parquet(cache).count() == stored


@pytest.mark.parametrize(("name", "patterns"), [("op6_pii", brute.PII), ("op8_secret_scan", brute.SECRET)])
def test_base_spans(spark, case, name, patterns):
    got = result(spark, name, case)
    for d, t in case[1]:
        counts, digest = brute.spans(patterns, t)
        assert ([got[d][f"n_{k}"] for k in patterns], got[d]["base_sha256"]) == (counts, digest)


def filler(i: int, n: int = 12) -> str:
    """Words that differ from one text to the next."""
    return " ".join(f"w{(i * 7919 + j * j * 31) % 997}" for j in range(n))


def terms_in(rows: list, texts: dict) -> set[str]:
    return {texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in rows for s in r["spans"] if s["kind"] == 4}


def test_disclosing_terms(spark):
    """A name that stands beside one address in every document is found; a common word isn't."""
    rows = [(i, f"common {filler(i)} here and Brightwater lives at a@b.org near common people {i}") for i in range(6)]
    rows += [(100 + i, f"common words about nothing at all {filler(i)} here and near people number {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs).collect()}
    at = rows[0][1].index("Brightwater")
    assert any(s["kind"] == 4 and s["start"] == at for s in found[0])
    assert not any(s["kind"] == 4 and rows[0][1][s["start"] : s["end"]] == "common" for s in found[0])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise_documents(docs).collect()}
    assert "a@b.org" not in clean[0] and "Brightwater" not in clean[0] and "[EMAIL]" in clean[0] and clean[105] == dict(rows)[105]


def test_copies_disclose_nothing(spark):
    """However many copies and near copies of a text stand beside an address, they count once; one other text makes two."""
    body = " ".join(filler(3, 150).split())
    near = lambda i: body.replace("w1 ", f"odd{i} ", 1) if i % 3 else body
    rows = [(i, f"{near(i)} Brightwater lives at a@b.org {'again' if i % 5 == 0 else ''}") for i in range(120)]
    rows += [(1000 + i, f"{filler(i, 40)} common words {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal(docs).collect()
    assert not terms_in(found, dict(rows)) and sum(s["kind"] == 0 for r in found for s in r["spans"]) == 120
    rows.append((5000, f"{filler(77, 60)} by Brightwater of a@b.org"))
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "brightwater" in terms_in(found, dict(rows)) and sum(any(s["kind"] == 4 for s in r["spans"]) for r in found) >= 121


def test_planted_names_are_found(spark):
    """Names that stand with an address in three to eight different given documents: at least nine tenths are found, and of
    the words of documents that no name was planted in none is."""
    rows, names = [], {}
    for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()):
        text = r["text"] or ""
        who = i // 8 if i % 8 < 3 + i // 8 % 6 and i // 8 % 3 == 0 else None
        if who is not None:
            names[r["doc_id"]] = f"qx{who}zorbl"
            text = f"Qx{who}zorbl began. {text} Write to person{who}@mail.example.org"
        rows.append((r["doc_id"], text))
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    got = {r["doc_id"] for r in found if names.get(r["doc_id"]) in terms_in([r], texts)}
    assert len(got) >= 0.9 * len(names) and len(names) > 100
    other = [r["doc_id"] for r in found if r["doc_id"] not in names and terms_in([r], texts)]
    assert len(other) <= 0.02 * len(rows), len(other)


def test_disclosing_terms_against_a_plain_version(spark):
    """On given documents with names planted beside an address: the terms that counting every pair of sets gives."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [(d, f"{t} Zorblatt{d // 9 % 3} wrote from box{d // 9 % 3}@mail.org" if d % 9 == 0 else f"{t} Zorblatt0" if d % 40 == 1 else t) for d, t in docs] + [(None, "Zorblatt1"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.disclosing([t or "" for _, t in docs], pii.SHARE, pii.SUPPORT)
    found = {(r["doc_id"], tuple((s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4)) for r in pii.find_personal(frame).collect()}
    plain = {(d, tuple((m.start(), m.end()) for m in re.finditer(r"[^\W_]{2,}", t or "") if m[0].lower() in want and not any(a < m.end() and m.start() < b for a, b in brute.places(brute.PII, t)))) for d, t in docs}
    assert {"zorblatt1", "zorblatt2"} <= want and "zorblatt0" not in want and found == plain


def test_random_tokens_are_found(spark):
    rng = np.random.default_rng(3)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    prose = ["".join(rng.choice(list("etaoinshrdlu"), 24, p=np.array([12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3]) / 80)) for _ in range(600)]
    keys = ["".join(rng.choice(alphabet, 40)) for _ in range(20)] + ["".join(rng.choice(list("0123456789ABCDEF"), 40)) for _ in range(10)]
    rows = [(i, f"some text {p} goes on") for i, p in enumerate(prose)] + [(1000 + i, f"key {k} end") for i, k in enumerate(keys)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(any(s["kind"] == 3 for s in got[1000 + i]) for i in range(len(keys)))
    assert found >= 0.8 * len(keys) and not any(got[i] for i in range(len(prose)))


def test_random_tokens_planted_in_given_documents(spark):
    """Keys put between words of the given documents: at least nine tenths are found, and nothing that wasn't planted."""
    rng, rows, keys = np.random.default_rng(17), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect(), {}
    docs = []
    for i, r in enumerate(rows):
        text = r["text"] or ""
        if i % 10 == 0:
            name, length = (("base64", 40), ("base32", 48), ("capital_hex", 40))[i // 10 % 3]
            keys[r["doc_id"]] = "".join(rng.choice(list(secret_scan.ALPHABETS[name]), length))
            at = text.find(" ", len(text) // 2)
            text = f"{text[:at]} {keys[r['doc_id']]} {text[at:]}" if at > 0 else f"{text} {keys[r['doc_id']]}"
        docs.append((r["doc_id"], text))
    texts = dict(docs)
    found = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in secret_scan.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r["spans"] if s["kind"] == 3}
    assert len(found & set(keys.items())) >= 0.9 * len(keys) and not found - set(keys.items())


def test_disclosing_terms_far_from_their_entity(spark):
    """Every occurrence of a term is found: far off in the same document, and where its entity is not."""
    far = " ".join(["common words go on"] * 20)
    rows = [(i, f"common {filler(i)} here and Brightwater lives at a@b.org near common people {i % 2}") for i in range(10, 40)] + [(100 + i, f"common words and nothing at all {filler(i)} here lives near people {i}") for i in range(1000)]
    rows += [(6, f"BRIGHTWATER said: {far} Brightwater, a@b.org, and brightwater"), (7, f"{far} by Brightwater and Brightwaters"), (7, f"{far} by Brightwater and Brightwaters"), (None, "Brightwater")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal(docs).collect()
    assert len(found) == len(rows)
    for text in {t for d, t in rows if d in (6, 7, None)}:
        want = {(m.start(), m.end()) for m in re.finditer(r"(?i)\bbrightwater\b", text)}
        got = [{(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4} for r in found if (r["doc_id"], text) in rows]
        assert got == [want] * len(got) and got
    clean = pii.sanitise_documents(docs).collect()
    assert len(clean) == len(rows) and not any(re.search(r"(?i)\bbrightwater\b", r["text"]) for r in clean)


def random_tokens(n, length, signs="+/", seed=5):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + signs), length)) for _ in range(n)]


def test_random_tokens_whatever_the_corpus_holds(spark):
    """The same keys are found beside no prose, a little and a lot; names of the same length are not."""
    keys = random_tokens(30, 40)
    names = [f"section{i}/chapterAboutTheHarbour{i + 1}/page{i % 7}" for i in range(10, 40)]
    planted = [(i, f"key {k} end") for i, k in enumerate(keys)] + [(100 + i, f"see {n} there") for i, n in enumerate(names)]
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = []
    for n in (0, 3, len(prose)):
        docs = spark.createDataFrame(planted + [(1000 + i, t) for i, t in enumerate(prose[:n])], "doc_id long, text string")
        found.append({r["doc_id"] for r in secret_scan.find_secrets(docs).collect() if r["doc_id"] < 1000 and any(s["kind"] == 3 for s in r["spans"])})
    assert found[0] == found[1] == found[2] and len(found[0]) >= 0.9 * len(keys) and max(found[0]) < 100


def test_random_tokens_of_few_digits(spark):
    """Keys without digits or with one are tested too, in mixed case and in base32; words are not found."""
    drawn, rng = random_tokens(9000, 32), np.random.default_rng(7)
    coded = ["".join(rng.choice(list(secret_scan.ALPHABETS["base32"]), 24)) for _ in range(2000)]
    few = lambda tokens, n: [k for k in tokens if sum(c.isdigit() for c in k) == n][:20]
    keys = few(drawn, 0) + few(drawn, 1) + few(coded, 1)
    assert len(keys) == 60
    names = ["AVERYLONGCONSTANTNAMEINTHEHARBOUR", "theNameOfTheHarbourInMixedCase", "/var/lib/harbour/market/square/dogs", "-" * 40, "Donaudampfschifffahrtsgesellschaft"]
    docs = spark.createDataFrame(list(enumerate([f"key {k} end" for k in keys] + [f"see {n} there" for n in names])), "doc_id long, text string")
    found = {r["doc_id"] for r in secret_scan.find_secrets(docs).collect() if any(s["kind"] == 3 for s in r["spans"])}
    counts = [len(found & set(range(kind, kind + 20))) for kind in (0, 20, 40)]
    assert min(counts[:2]) >= 16 and counts[2] >= 10, counts
    assert max(found) < len(keys)


def test_lm_scores(spark, case):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    got, base, model = result(spark, "op7_lm_score", case), brute.base_scores(case[1], held), brute.bigram_score(case[1], held)
    for d, want in base.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), *want[:3])
        assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], model[d], rel_tol=0.03)


def test_lm_scores_with_hot_contexts(spark):
    """Small blocks make contexts hot: one word in every second place, some of whose slices a block has no n-gram for."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(w for j in rng.integers(0, 400, 30) for w in ("the", f"w{j}"))) for i in range(200)] + [(200, None), (201, "new words only"), (202, "the"), (203, "w1 w1")]
    held = lambda d: d % 7 == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, _, hot = ngram_model.vocabulary(docs.selectExpr("text", "doc_id % 7 != 0 AS train"), 40)
    assert len(hot.words) >= 2 and hot.slices.max() > 100
    found = ngram_model.score_documents(docs, F.col("doc_id") % 7 != 0, block_bytes=600).collect()
    model = brute.bigram_score([(d, t or "") for d, t in rows], held)
    assert len(found) == len(rows) and all(math.isclose(r["score"], model[r["doc_id"]], rel_tol=0.01, abs_tol=0.05) for r in found)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for size, top in ((0, 1), (1, 1), (300, 400), (5000, 2**60)):
        values = np.sort(rng.integers(0, top, size, dtype=np.uint64))
        n, width, low, high = ngram_model.EliasFano.encode(values)
        held = ngram_model.EliasFano(n, width, np.frombuffer(low, np.uint8).reshape(n, width), np.frombuffer(high, np.uint8))
        assert (held[np.arange(n)] == values).all()
        asked = rng.integers(0, top + 2, 500, dtype=np.uint64)
        assert (held.successor(asked) == np.searchsorted(values, asked)).all()
    close = np.sort(rng.integers(0, 2**50, 20_000, dtype=np.uint64))
    assert sum(map(len, ngram_model.EliasFano.encode(close)[2:])) < 0.8 * close.nbytes


def test_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog and then it runs away from the angry bear"
    edited = item.replace("quick", "quack").replace("angry", "angr")
    texts = {1: f"before. {item}! after", 2: f"BEFORE {edited.upper()} after", 3: "nothing of the kind is in this text at all, only other words", 4: item[: len(item) // 2], 5: None, 6: f"{item} and again: {item}"}
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    found = decontamination.find_leaks(docs, spark.createDataFrame([(7, item), (8, "short"), (9, None)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (2, 7), (6, 7)}
    assert sum(r["doc_id"] == 6 for r in found) == 2
    for r in found:
        part = " ".join("".join(c if c.isalnum() else " " for c in texts[r["doc_id"]][r["start"] : r["end"]].lower()).split())
        assert brute.edit_distance_inside(item, part) == r["edits"]


def test_leaks_of_short_items_and_repeated_rows(spark):
    """Short items match word for word only; equal rows and rows of no id each get theirs; blocks change nothing."""
    items = spark.createDataFrame([(1, "six times seven?"), (2, "forty-two"), (3, "日本語 の 問題"), (4, "!?"), (5, None), (6, "Forty two"), (7, "the quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    rows = [(1, "What is SIX times, seven"), (1, "What is SIX times, seven"), (None, "forty two"), (2, "fortytwo; forty twos"), (3, "日本語 の 問題"), (4, None), (5, ""), (6, "the quick brown fox jumps over the lazy dog and ran forty two"), (6, "clean")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, `end` string")
    want = sorted([(1, 1), (1, 1), (-1, 2), (-1, 6), (3, 3), (6, 7), (6, 2), (6, 6)])
    for size in (4_000_000, 10):
        got = decontamination.find_leaks(docs, items, block_chars=size).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got) == want
        left = decontamination.decontaminate(docs, items, block_chars=size)
        assert left.columns == docs.columns and sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == [(2, "fortytwo; forty twos"), (4, ""), (5, ""), (6, "clean")]
    assert not decontamination.find_leaks(docs, items.limit(0)).collect() and decontamination.decontaminate(docs, items.limit(0)).count() == len(rows)


def test_leaks_against_full_alignment(spark):
    """Edited items in given documents: just those within the budget of edits, by alignment of every pair in full."""
    rng = np.random.default_rng(23)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()][:12]
    docs = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect():
        text, (_, item) = r["text"] or "", items[r["doc_id"] % len(items)]
        letters = list(item)
        for _ in range(int(len(item) * rng.choice([0, 0.02, 0.05, 0.06, 0.08, 0.12]))):
            at = int(rng.integers(len(letters)))
            letters[at : at + 1] = rng.choice(["", "q", "zz"])
        at = int(rng.integers(len(text) + 1))
        docs.append((r["doc_id"], f"{text[:at]} {''.join(letters)} {text[at:]}"))
    bare = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {(d, i) for d, t in docs for i, item in items if (n := brute.edit_distance_anywhere(bare(item), bare(t))) <= int(len(bare(item)) * decontamination.EDITS)}
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and 20 < len(want) < 60


def test_leaks_of_the_small_table(spark):
    """Items that stand in documents word for word are all found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    bare = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if f" {bare(i['text'])} " in f" {bare(d['text'])} "}
    got = {(r["doc_id"], r["item_id"]) for r in registry.QUERIES["op1_decontamination"](spark, SF).collect()}
    assert want <= got and len(got - want) <= len(want) + 2


def test_quality_held_out(spark):
    """Fitted on half of the labels, the classifier tells the other half apart and keeps good documents."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality.fit(docs, labels.filter(half == 0))
    rows = quality.score_documents(docs, model).join(labels.filter(half == 1), "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    poor = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > p) + 0.5 * (g == p) for g in good for p in poor])
    assert auc > 0.9
    assert np.mean([r["keep"] for r in rows if r["quality"] == 1]) > 0.97


def test_quality_against_a_plain_version(spark):
    """Fit, one exchange over all documents, calibration and scores, step by step with plain Python."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, rounds=1)
    rows = {r["doc_id"]: r for r in docs.collect()}
    known = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["doc_id"] in rows}
    half = lambda x: np.array(x).astype(np.float16).astype(np.float32)
    views = {d: (half(quality.content_features(pa.array([r["text"] or ""]))[0]), half(quality.metadata_features(pd.Series([r["source"]]), pd.Series([r["lang"]]), pd.Series([len(r["text"] or "")]))[0])) for d, r in rows.items()}
    order = sorted(known)
    learn = [d for i, d in enumerate(order) if i % 4]
    back = [d for i, d in enumerate(order) if i % 4 == 0]
    weights = [brute.logistic([views[d][v] for d in learn], [known[d] for d in learn], [1.0] * len(learn)) for v in (0, 1)]
    odds = lambda v, d: float(np.clip(views[d][v] @ weights[v][:-1] + weights[v][-1], -30, 30))
    free, rate = sorted(set(rows) - set(known)), float(np.mean([known[d] for d in order]))
    held = spark.createDataFrame([(d, odds(0, d), odds(1, d)) for d in free], "doc_id long, content double, meta double")
    got = {(r["doc_id"], r["view"], r["label"]) for r in quality.surest(held, rate, most=10**6).collect()}
    want = set()
    for v in (0, 1):
        ranked = sorted(odds(v, d) for d in free)
        low, high = (ranked[max(0, math.ceil(q * len(free)) - 1)] for q in (0.1 * (1 - rate), 1 - 0.1 * rate))
        want |= {(d, 1 - v, 1.0) for d in free if odds(v, d) >= max(high, 2)} | {(d, 1 - v, 0.0) for d in free if odds(v, d) <= min(low, -2)}
    assert got == want and want
    for v in (0, 1):
        more = [(d, g) for d, view, g in want if view == v]
        weights[v] = brute.logistic([views[d][v] for d in learn] + [views[d][v] for d, _ in more], [known[d] for d in learn] + [g for _, g in more], [1.0] * len(learn) + [0.5] * len(more))
    fair = back[::2]
    platt = [brute.logistic([[odds(v, d)] for d in fair], [known[d] for d in fair], [1.0] * len(fair), 0.01) for v in (0, 1)]
    pair = lambda d: [platt[v][0] * odds(v, d) + platt[v][1] for v in (0, 1)]
    last = brute.logistic([pair(d) for d in fair], [known[d] for d in fair], [1.0] * len(fair), 0.01)
    plain = {d: 1 / (1 + math.exp(-float(np.clip(np.dot(pair(d), last[:-1]) + last[-1], -30, 30)))) for d in rows}
    scored = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    assert np.abs([scored[d] - plain[d] for d in rows]).max() < 0.05


def test_quality_without_labels(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/some/documents.parquet")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["score"] == 1.0 and r["keep"] for r in quality.score_documents(docs, model).collect())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, awkward, name):
    got = registry.QUERIES[name](spark, f"{awkward}/none").collect()
    assert len(got) == (1 if name == "op10_chat_format" else 0)


@pytest.mark.parametrize("at", ["small", "awkward"])
def test_chat(spark, awkward, at):
    folder = SF if at == "small" else f"{awkward}/some"
    got = registry.QUERIES["op10_chat_format"](spark, folder)
    files = f"{SF}/conversations.parquet" if at == "small" else f"{folder}/conversations.parquet/*.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
    if at == "small":
        want = con.execute(registry.ORACLE["op10_chat_format"])
        names = [d[0] for d in want.description]
        assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted(map(tuple, want.fetchall()), key=repr)
        return
    rows = {r["conv_id"]: r for r in got.collect()}
    assert rows[None]["turns_sha256"] == sha("a\\n\nb\n<|<\\\\|\n")
    assert rows[1]["turns_sha256"] == sha("\n\nuser\n<\\|\n")
    assert (rows[-1]["n_turns"], rows[-1]["loss_sha256"]) == (2, sha(queries_chat.PROBE))


def test_chat_parts(spark):
    parts = "array(named_struct('type', 'text', 'text', 'see <|', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null), named_struct('type', 'image', 'text', null, 'ref', 'r1', 'width', 28, 'height', 15, 'seconds', null, 'pages', null), named_struct('type', 'audio', 'text', null, 'ref', 'r2', 'width', null, 'height', null, 'seconds', 1.5D, 'pages', null), named_struct('type', 'document', 'text', null, 'ref', 'r3', 'width', null, 'height', null, 'seconds', null, 'pages', 2))"
    turns = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, {parts} AS parts")
    row = chat.format_chat(turns).first()
    assert row["formatted"] == "<|im_start|>user\nsee <\\|<|image|><|audio|><|document|><|im_end|>\n"
    assert [(a["ref"], a["tokens"]) for a in row["attachments"]] == [("r1", 4), ("r2", 38), ("r3", 2048)] and row["expanded_tokens"] == 2090
