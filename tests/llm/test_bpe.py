import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from ledgerfold.llm import bpe
from ledgerfold.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.encoder_of(PATH), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_is_made_by_merges(both):
    own, _ = both
    assert all(own.split[rank] for token, rank in own.ranks.items() if len(token) > 1)


def test_stretches_merge_exactly(both):
    own, exact = both
    rng = random.Random(7)
    tokens = list(own.ranks)
    for k in range(6000):
        if k % 3:
            data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
        else:
            data = bytes(rng.choice(b"abcdeths  in\n12\xc3\xa9\xe2\x80") for _ in range(rng.randint(1, 40)))
        assert own.encode(data) == exact._encode_single_piece(data)
        assert own.decode(own.encode(data)) == data
    assert own.encode(b"") == []


def test_long_stretches(both):
    own, exact = both
    for data in (b"ab" * 20000, b"a" * 20000, b"\xff" * 5000):
        assert own.encode(data) == exact._encode_single_piece(data)


def test_whole_texts(spark, docs, none, both):
    own, exact = both
    find = regex.compile(public_tokenizers.PATTERN).findall
    wanted = []
    for d in docs.collect():
        ids = exact.encode_ordinary(d.text or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        assert bpe.encode_text(own, find, {}, d.text or "") == raw
        wanted.append((d.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    got = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert bpe.encode_documents(none, PATH, public_tokenizers.PATTERN).collect() == []
