"""op3: new matches are merged side by side, which is most of the encoder's work, with the same tokens as the library."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def made(seed, n):
    r = random.Random(seed)
    parts = ["th", "er", "ing", "on", "è", "ai", "ou", "st", "日本", "7", "'s", "\x00", "🙂", "zq"]
    return [" ".join("".join(r.choices(parts, k=r.randint(1, 6))) for _ in range(r.randint(0, 400))) for _ in range(n)]


def encoded(coder, texts):
    held = list(coder.encode_all(iter(texts)))
    assert [t for t, _ in held] == texts
    return [list(bpe.unpack(p)) for _, p in held]


def test_few_matches_are_merged_by_themselves(library, monkeypatch):
    """Each new match cost a merge of its own: over half of the CPU seconds of the query."""
    alone, coder, texts = [], bpe.ByteBpe(RANKS, PATTERN), made(1, 200)
    monkeypatch.setattr(bpe.ByteBpe, "merge", lambda self, data, f=bpe.ByteBpe.merge: (alone.append(data), f(self, data))[1])
    (batch,) = bpe.pa.Table.from_pydict({"doc_id": range(len(texts)), "text": texts}).to_batches()

    class Docs:
        select = staticmethod(lambda *columns: Docs)
        mapInArrow = staticmethod(lambda run, schema: list(run(iter([batch]))))  # noqa: N815

    (out,) = bpe.encode_documents(Docs, RANKS, PATTERN)
    want = list(map(library.encode_ordinary, texts))
    assert [np.frombuffer(v.as_py(), "<u4").tolist() for v in out.column("ids")] == want
    assert out.column("n_tokens").to_pylist() == list(map(len, want))
    assert len(alone) < len({p for t in texts for p in coder.matches(t) if p.encode() not in coder.ranks}) / 3


def test_merges_side_by_side_are_those_of_each_word():
    coder, r = bpe.ByteBpe(RANKS, PATTERN), random.Random(2)
    words = [bytes(r.choices(b"aethinrs \x00\xc3\xa9\xff", k=r.randint(1, bpe.WORD))) for _ in range(4000)]
    words += [bytes([i]) for i in range(256)] + [b"a" * n for n in range(1, bpe.WORD + 1)] + [k for k in coder.ranks if len(k) <= bpe.WORD][::50]
    assert list(map(bpe.unpack, coder.merge_all(words))) == list(map(coder.merge, words))
    assert list(coder.merge_all([])) == []


@pytest.mark.parametrize(("block", "memo"), [(256, 400_000), (1000, 50), (1 << 17, 400_000), (1 << 17, 7)])
def test_blocks_and_memos_of_any_size(library, monkeypatch, block, memo):
    """Texts within, at and beyond a block, and memos that are emptied while a block is learnt."""
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "MEMO", memo)
    texts = ["", "a", *made(3, 40), "x" * 3000, " ".join(made(4, 30)), "", "é" * block, "word " * (block // 5), "\n \n" * 400]
    assert encoded(bpe.ByteBpe(RANKS, PATTERN), texts) == list(map(library.encode_ordinary, texts))


def test_a_byte_that_the_vocabulary_lacks_is_an_error(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for v, k in enumerate([b"a", b"b", b"ab"])))
    coder = bpe.ByteBpe(str(path), PATTERN)
    assert encoded(coder, ["abba", ""]) == [[2, 1, 0], []]
    with pytest.raises(KeyError):
        coder.encode("abc")
