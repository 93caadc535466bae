"""Counts of chunks spliced again next to counts of whole texts."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from punctual.llm import token_counts

JSON = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")]
MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = "doc_id long, text string, key string, number string, n_tokens string, n_bytes string"


def whole(path):
    if path == MODEL:
        model = SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def odd_text(seed, size):
    """Words, digits, marks, contractions, white space of every kind, long runs without a border."""
    pick = random.Random(seed)
    parts = [
        " the", "word", "It's", "we'll've", "  ", "   \n", "\n\n\n", "\t", "\r\n", "12345", "!!", "...", "é", "Éa", " naïve", "中文字", "ﬁ①",
        "🙂", "ạ́", "́", "  ", "▁", " ▁ ", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "\0", " " * 90, "x" * 150, "中" * 200,
        "<|endoftext|>" * 12, "'", "'s's's", " '", "İ",
    ]
    out = ""
    while len(out) < size:
        out += pick.choice(parts) if pick.random() < 0.7 else " " + "".join(pick.choice("abcde") for _ in range(pick.randint(1, 12)))
    return out


@pytest.mark.parametrize("path", [*JSON, MODEL])
def test_counts_are_those_of_whole_texts(spark, path):
    texts = [odd_text(seed, 300 * seed) for seed in range(40)] + [
        None, "", " ", "word", "a" * 5000, "ab " * 2000, " " * 3000, "x" * 700 + " the end" * 100, "<|endoftext|>" * 300, "中文" * 900, "é" * 2000,
    ]
    rows = [(i // 2 if i % 7 else None, t, *["x"] * 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASHING).repartition(5)
    # Chunks and overlaps far smaller than a border-free run, so that some have to be widened.
    got = token_counts.count_tokens(docs, path, limit=100, chunk=256, overlap=96)
    count = whole(path)
    want = [(r[0], len((r[1] or "").encode()), n := count(r[1] or ""), n > 100) for r in rows]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found), key=str) == sorted(want, key=str)
    overlaps = {r.overlap for r in found}
    assert {0, 96, 96 * token_counts.WIDER} <= overlaps


@pytest.mark.parametrize("path", [*JSON, MODEL])
def test_boundaries_hold_in_every_later_chunk(path):
    """From a boundary that two chunks share on, the later one has the tokens of the text."""
    coder, count = token_counts.library(path), whole(path)
    for seed in range(30):
        text = odd_text(seed, 1500)
        total, at, before = coder.bounds(text)
        assert total == count(text)
        true = dict(zip(at.tolist(), before.tolist()))
        for start in range(100, 1200, 171):
            part, own_at, own_before = coder.bounds(text[start:])
            own = {a + start: b for a, b in zip(own_at.tolist(), own_before.tolist()) if a >= coder.margin}
            shared = sorted(own.keys() & true.keys())
            if shared:
                first = shared[0]
                assert total - true[first] == part - own[first]
                assert [b - own[first] for a, b in sorted(own.items()) if a >= first] == [
                    b - true[first] for a, b in sorted(true.items()) if a >= first
                ]


def test_no_documents(spark):
    none = spark.createDataFrame([], CLASHING)
    assert token_counts.count_tokens(none, JSON[0]).collect() == []


def test_extra_tokens_that_take_space_are_never_cut(tmp_path):
    tokenizer = Tokenizer.from_file(JSON[0])
    from tokenizers import AddedToken

    tokenizer.add_tokens([AddedToken("<gap>", lstrip=True)])
    path = str(tmp_path / "own.json")
    tokenizer.save(path)
    assert len(token_counts.Library(path).bounds("a b c <gap> d")[1]) == 0
