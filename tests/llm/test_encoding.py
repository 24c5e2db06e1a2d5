"""Ids against the two libraries that know the same vocabulary."""

import base64
import os
import random

import pytest

from vellumspark.llm.encoding import PATTERN, encode_texts, encoder, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary files here")


def texts():
    rng = random.Random(4)
    yield from ["", "<|endoftext|> x", "a" * 5000, "ab" * 3000, " " * 300 + "x", "ก" * 2000, "的" * 999, "it's 'll'd don’t", "\x00\x01 é́ 𝒳𝒴 🙂🙂🙂", "Hello world", "\n\n\t x \xa0y"]
    for alphabet in ("abcde ſ的éก1.\n", "aeinorst", "01 ", "กั "):
        for _ in range(60):
            yield "".join(rng.choice(alphabet) for _ in range(300))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_same_as_tiktoken(name):
    tiktoken = pytest.importorskip("tiktoken")
    with open(vocabulary_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})
    ours = encoder(vocabulary_path(name))
    for t in texts():
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_same_as_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    ours = encoder(vocabulary_path())
    for t in texts():
        assert ours.encode(t) == theirs.encode(t, add_special_tokens=False).ids


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", [9]), (1, "Hello world", [9]), (2, "", [9]), (3, None, [9])], "doc_id bigint, text string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in encode_texts(df, ["doc_id"], "text").collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert encode_texts(df.limit(0), ["doc_id"], "text").count() == 0
