import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sightline.llm import shared, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["a<|endoftext|>b İstanbul ΑΣ ά é x", "don't  \t\r\n I'LL'S 12 3.4%% é漢字🙂 <|startoftext|>  x y\x1fz", "", "\n", "x²y³ ½ ª º µ ÿ _a__ 'S ß É ÀÈ· a\x85b \x0b \x0c §", "plain one"]


def test_encodes_as_the_library(library, monkeypatch):
    for entries in (token_files.CACHE_ENTRIES, 3):
        monkeypatch.setattr(token_files, "CACHE_ENTRIES", entries)
        encoder = token_files.TextEncoder(PATH)
        for texts in (ODD, ODD[3:], ["only plain", "plain only"], ["漢字"], ODD):
            ids, n = encoder.encode(pa.array(texts))
            got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_coding_round_trip():
    draw = np.random.default_rng(1)
    n = np.array([0, 1, 4, 0, 5, 1000, 3])
    ranks = (draw.integers(0, 1 << 32, n.sum(), dtype=np.uint64) >> draw.integers(0, 32, n.sum(), dtype=np.uint64)).astype(np.uint32)
    control, data = token_files.pack(ranks, n)
    assert list(map(len, control)) == (-(-n // 4)).tolist()
    u8 = lambda parts: np.frombuffer(b"".join(parts), np.uint8)
    assert (token_files.unpack(u8(control), u8(data), n) == ranks).all()


def want(rows, library):
    out, start = [], 0
    encoded = sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    for doc_id, ids in encoded:
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("ids_per_file", [4_000_000, 5_000])
def test_documents_through_files(spark, library, ids_per_file):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = token_files.round_trip(docs, PATH, ids_per_file=ids_per_file).collect()
    assert sorted(map(tuple, got)) == want([(r["doc_id"], r["text"]) for r in docs.collect()], library)


def test_odd_documents(odd_documents, no_documents, library):
    got = [tuple(r) for r in token_files.round_trip(odd_documents, PATH, ids_per_file=3).collect()]
    assert sorted(got, key=lambda r: r[1]) == want([(r["doc_id"], r["text"]) for r in odd_documents.collect()], library)
    assert token_files.round_trip(no_documents, PATH).count() == 0


def test_files_hold_what_readers_need(spark, library):
    docs = spark.createDataFrame([(2, "two words"), (1, "one")], "doc_id long, text string")
    tokens = token_files.tokenize(docs, PATH, 1)
    folder, kind = shared.new_folder(spark, "files"), token_files.id_type(PATH)
    by_rank, total = token_files.count_ids(tokens, kind)
    parts = token_files.write_files(tokens, folder, by_rank, kind, 1).collect()
    found = [token_files.read_file(folder, p["name"], by_rank) for p in parts]
    assert [d for doc_ids, _, _ in found for d in doc_ids] == [1, 2]
    assert sum(len(ids) for _, _, ids in found) == total == 2 + 3


def test_words_are_encoded_without_their_places(library, monkeypatch):
    encoder = token_files.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    asked = []

    class Fast:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(texts)
            return library.encode_batch(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Fast()
    texts = ["ªµº Straße's naïve, x2 it's a²b don't", "a_b ÀÉ\nthe THE the", "漢字 the", ""]
    for _ in range(2):
        ids, n = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked[0] == ["漢字 the"] or len(asked[0]) == 1 and asked.count(["漢字 the"]) == 2 and len(asked) == 3  # plain words once
    latin = {chr(c) for c in range(256) if chr(c).isalpha()}
    assert all(token_files.LATIN_WORDS.findall(c + "a") == [c + "a"] for c in latin)
