import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sightline.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=200):
    draw = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "漢", "🙂", "1", "23", "'s", "'ll", " ", "\t", "x" * 30, "!?", " "]
    return ["".join(draw.choice(parts) for _ in range(40)) for _ in range(n)]


def test_pattern_is_the_one_that_may_be_cut():
    assert public_tokenizers.PATTERN == byte_bpe.CUTTABLE


def test_encodes_as_the_library(ranks, library):
    fast, plain = (byte_bpe.TextEncoder(ranks, public_tokenizers.PATTERN, cut) for cut in (True, False))
    for text in texts():
        assert fast.encode(text) == list(plain.encode(text)) == library.encode_ordinary(text)


def test_appends_and_edits_give_the_same_as_a_new_start(ranks):
    encoder, draw = byte_bpe.PrefixEncoder(ranks), random.Random(5)
    for text in texts(60):
        data = text.encode()
        lasts = encoder.extend(data, [])
        assert encoder.append(data, lasts, b" more words") == (data + b" more words", encoder.extend(data + b" more words", []))
        start = draw.randrange(len(data))
        stop = draw.randrange(start, len(data))
        new, after = encoder.edit(data, lasts, start, stop, draw.choice([b"", b"abc", b" hello"]))
        assert after == encoder.extend(new, [])
        assert encoder.decode(encoder.walk(after)) == new


def test_round_trip_of_odd_documents(odd_documents, no_documents, library):
    rows = byte_bpe.digest_round_trip(odd_documents, PATH, public_tokenizers.PATTERN).collect()
    texts_ = [r["text"] or "" for r in odd_documents.collect()]
    want = sorted((len(ids := library.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts_)
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert byte_bpe.digest_round_trip(no_documents, PATH, public_tokenizers.PATTERN).count() == 0


def test_real_ids_and_bytes_keep_other_columns(odd_documents):
    encoded = byte_bpe.encode_documents(odd_documents, PATH, public_tokenizers.PATTERN)  # replaces its own column ids
    decoded = byte_bpe.decode_documents(encoded, PATH)
    assert set(odd_documents.columns) <= set(decoded.columns)
    assert all(bytes(r["data"]).decode() == (r["text"] or "") for r in decoded.collect())


def test_a_worker_holds_one_encoder_at_a_time():
    from sightline.llm import shared

    made = []

    def build(name):
        made.append(name)
        return [name]

    first = shared.in_worker(build, "a")
    assert shared.in_worker(build, "a") is first and made == ["a"]
    shared.in_worker(build, "b")
    assert len(shared._held) == 1 and shared.in_worker(build, "a") is not first
    shared.let_go()
    assert not shared._held


def test_remembered_prefixes_are_few_and_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PREFIX_ENTRIES", 50)
    encoder = byte_bpe.PrefixEncoder(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    draw, parts = random.Random(3), ["thst", "ing", "é", "ou", "w", "\x00", "漢", "aaaa", " ", "9"]
    pieces = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))).encode() for _ in range(400)]
    short = [p for p in pieces if len(p) <= byte_bpe.PREFIX_BYTES]
    got = [encoder.encode(p) for p in short]
    assert "starts" not in vars(encoder) and 0 < len(encoder._prefixes) <= 50  # no tree, no table of every prefix
    assert got == [encoder.merged(p) for p in short] == [encoder.walk(encoder.extend(p, [])) for p in short]
