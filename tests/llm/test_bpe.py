import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from florascope.llm.bpe import Encoder, encode_texts, load_ranks, vocabulary


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary())


def test_against_libraries(enc):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(vocabulary()), special_tokens={})
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "aabcdeeeiorst  \t\n\r0123'.,-<|>éüßñ ​﻿འི་样地😀👩‍👧"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    texts += ["<|endoftext|> a <|endoftext|>", " ", "\t\t x", "a" * 5000, "the" * 3000, "\r\n\r\n  x", "don't we'll I'VE"]
    for t in texts:
        assert enc.encode(t) == own.encode_ordinary(t) == hf.encode(t, add_special_tokens=False).ids


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "green moss", "x"), (4, "green moss", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_texts(df, "doc_id", "text").collect())
    e = Encoder(vocabulary())
    assert got == [(1, []), (2, []), (3, e.encode("  ")), (4, e.encode("green moss")), (4, e.encode("green moss"))]
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
