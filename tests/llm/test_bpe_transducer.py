import array
import hashlib
import random

import pytest
import tiktoken

from tessera.llm import bpe_transducer as bt
from tessera.llm.queries import PATTERN, ranks_path


@pytest.fixture(scope="module")
def ranks():
    with open(ranks_path(), "rb") as f:
        return bt.read_ranks(f)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "ab 's'll\n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000é1²½٣世界\U0001f642<|endoftext|>_-.! \u200d\u0301"


def test_ids_equal_the_library(ranks, library):
    rng = random.Random(3)
    encoder, decoder = bt.Encoder(ranks, PATTERN), bt.Decoder(ranks)
    for k in range(6000):
        text = "".join(rng.choice(ALPHABET if k % 2 else "abehinrst ") for _ in range(rng.randrange(60)))
        if k % 7 == 0:
            text = "".join(chr(rng.randrange(32, 0x3000)) for _ in range(20))
        ids = memoryview(encoder.packed(text)).cast("I").tolist()
        assert ids == library.encode_ordinary(text), text
        assert decoder.text(ids) == text


def test_long_pretokens_stream(ranks, library, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdeinorst") for _ in range(60_000))
    want = library.encode_ordinary(text)
    for most in (bt.MAX_STATES, 50):
        monkeypatch.setattr(bt, "MAX_STATES", most)
        assert bt.Transducer(ranks).encode(text.encode()) == want


def test_pairs_equal_plain_merging(ranks):
    rng = random.Random(5)
    t, tokens = bt.Transducer(ranks), [w for w in ranks if len(w) < 5]
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert t.together(ranks[a], ranks[b]) == (t.merged(a + b) == [a, b])


def test_small_vocabularies_equal_plain_merging():
    rng = random.Random(6)
    for _ in range(40):
        ranks = {bytes([b]): b for b in range(256)}
        words = [bytes([b]) for b in b"abc"]
        while len(words) < 15:  # every token is made by a merge of earlier ones
            new = rng.choice(words) + rng.choice(words)
            if new not in ranks:
                ranks[new] = len(ranks)
                words.append(new)
        t = bt.Transducer(ranks)
        if any(t.merged(w) != [w] for w in words):
            continue
        for _ in range(200):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
            assert t.encode(data) == [ranks[p] for p in t.merged(data)]


def test_utf8_machine():
    data = "aé世\U0001f642z".encode() * 3
    for step in range(1, 6):
        s = bt.Utf8Stream()
        assert "".join([*(s.feed(data[i:i + step]) for i in range(0, len(data), step)), s.end()]) == data.decode()
    s = bt.Utf8Stream()
    assert s.feed(b"a\xff") == "a\ufffd" and s.feed(b"\xf0\x9f") == "" and s.end() == "\ufffd"


def test_documents(spark, odd, none, library):
    got = bt.encode(odd.withColumnRenamed("n_chars", "ids"), ranks_path(), PATTERN)
    rows = got.collect()
    texts = sorted(t or "" for (t,) in odd.select("text").collect())
    want = sorted((hashlib.sha256(array.array("I", library.encode_ordinary(t)).tobytes()).hexdigest(),
                   hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    back = bt.decode(got.select("ids"), ranks_path())
    assert sorted(r["text"] for r in back.collect()) == texts
    assert bt.encode(none, ranks_path(), PATTERN).count() == 0
