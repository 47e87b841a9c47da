"""Binary token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are renumbered by falling corpus frequency, so common ids are small. Each takes one to four bytes; two control
bits per id hold its length, kept apart from the data bytes, so numpy decodes a document by looking up the control
bytes in a table of lengths. A file holds the documents of one doc_id range in ascending order:

    magic (8 bytes), number of documents, number of ids, number of control bytes, number of data bytes (u64 each),
    doc_id (i64 each), is-null flag of doc_id (u8 each), ids per document (u64 each),
    control bytes (each document starts a new byte), data bytes

ranks.bin beside the files holds the id of each rank (u32). All numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, map_columns, new_folder, quantiles, range_of, small_batches, text_of, write_table

MAGIC = b"SLTOK001"
#: Words that a task's encoder remembers in each of two generations.
CACHE_ENTRIES = 250_000
#: Documents tokenized at once.
TOKENIZE_ROWS = 2_048
#: Ranges of doc_id at most; files get larger beyond it.
MAX_FILES = 16_384
#: Lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def _padded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents with n ids each: control bytes of each, and the place of every id among the places of these."""
    controls = -(-n // 4)
    begin = np.concatenate(([0], np.cumsum(4 * controls)[:-1]))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    return controls, np.arange(int(n.sum())) + np.repeat(begin - first, n)


def pack(ranks: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; ranks (u32) of all in a row, n of each."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    controls, place = _padded(n)
    codes = np.zeros(4 * int(controls.sum()), np.uint8)
    codes[place] = length
    quads = codes.reshape(-1, 4)
    control = (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= length[:, None]].tobytes()
    used = np.concatenate(([0], np.cumsum(length.astype(np.int64) + 1)))
    data_at = used[np.concatenate(([0], np.cumsum(n)))].tolist()
    control_at = np.concatenate(([0], np.cumsum(controls))).tolist()
    return [control[a:b] for a, b in zip(control_at, control_at[1:])], [data[a:b] for a, b in zip(data_at, data_at[1:])]


def unpack(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of all documents in a row, from their control and data bytes (u8 arrays)."""
    _, place = _padded(n)
    length = LENGTHS[control].ravel()[place]
    start = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=start[1:])
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= padded[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it; Hadoop's one-slash file:/x is accepted."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    """Write under a name of this attempt and move into place, so that repeated attempts leave one whole file."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with fs.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    fs.move(own, f"{path}/{name}")


#: The pattern of the words of tokenizers that may be cut up here, and the same for letters below U+0100.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\u00b2\u00b3\u00b9\u00bc\u00bd\u00be]+|[0-9\u00b2\u00b3\u00b9\u00bc\u00bd\u00be]|(?:[^\\s\\w]|_)+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer; and which of its ids end a word, if it is of the kind that lower-cases NFC text, keeps the
    matches of WORDS and marks the end of each with a suffix (else None)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as source:
        made = json.load(source)
    norm, pre = made["normalizer"] or {}, made["pre_tokenizer"] or {}
    suffix = made["model"].get("end_of_word_suffix")
    split = (pre.get("pretokenizers") or [{}])[0]
    words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex") == WORDS
    if not (words and suffix and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]):
        return tokenizer, None
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in made["model"]["vocab"].items() if token.endswith(suffix)]] = True
    return tokenizer, ends


def id_type(path: str) -> str:
    """The numpy type of the ids: two bytes if the vocabulary allows it."""
    return "<u2" if _tokenizer(path)[0].get_vocab_size() <= 1 << 16 else "<u4"


class TextEncoder:
    """Ids of whole texts, for batches of Arrow strings.

    If the tokenizer's words are known, texts below U+0100 (where nothing composes and lower-casing is letter by
    letter) are cut at white space by Arrow, each distinct stretch of a batch is looked up once, unknown ones are cut
    into words, and the library encodes the unknown words, many in one call. Other texts go to the library as they
    are. What is remembered is bounded: a full cache becomes an older generation.
    """

    #: Texts that the library gets as they are: letters from U+0100 on, signs that not all libraries take for white
    #: space, names of special tokens.
    LIBRARY = "[^\\x00-\\xff]|[\\x1c-\\x1f\\x{85}]|<[|]"

    def __init__(self, path: str):
        self.tokenizer, self.ends = _tokenizer(path)
        self.type = np.dtype(id_type(path))
        self.stretches: list[dict[str, bytes]] = [{"": b""}, {}]
        self.words: list[dict[str, bytes]] = [{}, {}]

    def _whole(self, texts: list[str]) -> list[bytes]:
        # The library's fast form gives the same ids, without working out where each lies in its text.
        return [np.array(got.ids, self.type).tobytes() for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _make_room(cache: list[dict[str, bytes]]) -> None:
        if len(cache[0]) >= CACHE_ENTRIES:
            cache[:] = [{"": b""}, cache[0]]

    def _learn_words(self, found: Iterable[str]) -> dict[str, bytes]:
        self._make_room(self.words)
        known, older = self.words
        missing = set(found).difference(known)
        new = list(missing.difference(older)) if older else list(missing)
        known.update((w, older[w]) for w in missing.difference(new))
        if new:
            raw = self._whole([" ".join(new)])[0]
            stop = (np.flatnonzero(self.ends[np.frombuffer(raw, self.type)]) + 1) * self.type.itemsize
            if len(stop) == len(new):
                stop = stop.tolist()
                known.update(zip(new, [raw[a:b] for a, b in zip([0, *stop], stop)], strict=True))
            else:
                known.update(zip(new, self._whole(new), strict=True))
        return known

    def _lookup(self, stretches: list[str]) -> list[bytes]:
        self._make_room(self.stretches)
        known, older = self.stretches
        got = list(map(known.get, stretches))
        missing = [s for s, g in zip(stretches, got, strict=True) if g is None]
        if not missing:
            return got
        new = missing
        if older:
            held = list(map(older.get, missing))
            known.update((s, h) for s, h in zip(missing, held, strict=True) if h is not None)
            new = [s for s, h in zip(missing, held, strict=True) if h is None]
        alone = list(filter(str.isalpha, new))  # letters alone are one word
        mixed = [s for s in new if not s.isalpha()]
        found = list(map(LATIN_WORDS.findall, mixed))
        word = self._learn_words(chain(alone, chain.from_iterable(found))).__getitem__
        known.update(zip(alone, map(word, alone), strict=True))
        known.update(zip(mixed, [b"".join(map(word, f)) for f in found], strict=True))
        return list(map(known.__getitem__, stretches))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's."""
        n = np.zeros(len(texts), np.int64)
        plain = ~pc.match_substring_regex(texts, self.LIBRARY).to_numpy(zero_copy_only=False) if self.ends is not None else np.zeros(len(texts), bool)
        parts: list[np.ndarray] = [np.zeros(0, self.type)] * len(texts) if not plain.all() else []
        ids = np.zeros(0, self.type)
        if plain.any():
            own = pc.split_pattern(pc.utf8_lower(pc.replace_substring(texts.filter(pa.array(plain)), "\n", " ")), " ")
            coded = own.flatten().dictionary_encode()
            value = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            flat, size = np.frombuffer(b"".join(value), self.type), np.fromiter(map(len, value), np.int32, len(value)) // self.type.itemsize
            index = coded.indices.to_numpy()
            each = size[index]
            first = np.concatenate((np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)))
            ids = flat.take(np.arange(first[-1], dtype=np.int32) + np.repeat((np.cumsum(size, dtype=np.int32) - size)[index] - first[:-1], each))
            stop = first[np.cumsum(pc.list_value_length(own).to_numpy())]
            n[plain] = np.diff(stop, prepend=0)
        if parts:
            cut = np.split(ids, np.cumsum(n[plain])[:-1]) if plain.any() else []
            whole = [np.frombuffer(x, self.type) for x in self._whole(texts.filter(pa.array(~plain)).to_pylist())]
            n[~plain] = list(map(len, whole))
            cut, rest = iter(cut), iter(whole)
            ids = np.concatenate([next(cut) if p else next(rest) for p in plain])
        return ids, n


@lru_cache(maxsize=1)
def _encoder(path: str) -> TextEncoder:
    """One for all tasks of a worker process, so that what it remembers serves them all."""
    return TextEncoder(path)


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (binary, of id_type) of every document, end_id last. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOKENIZE_ROWS):
                part = batch.slice(at, TOKENIZE_ROWS)
                ids, n = encoder.encode(part.column(1))
                data = np.insert(ids, np.cumsum(n), end_id)
                offsets = np.concatenate(([0], np.cumsum(n + 1))) * data.itemsize
                made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, kind: str) -> tuple[np.ndarray, int]:
    """The ids by falling frequency over all documents, ties by id; and the number of all ids. What reaches the driver
    is as long as the vocabulary in use, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32), int(found["n"].sum())


def write_files(tokens: DataFrame, folder: str, by_rank: np.ndarray, kind: str, files: int) -> DataFrame:
    """Write about so many files, in doc_id order over all of them; null doc_id first, equal doc_ids by their ids.
    Returns one row per file: part, name, n_docs, n_ids, start (ids in the files before it)."""
    spark = tokens.sparkSession
    _put(folder, "ranks.bin", [by_rank.astype("<u4").tobytes()])
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    def make():
        def work(batch: dict) -> dict:
            n = np.array(list(map(len, batch["ids"]))) // np.dtype(kind).itemsize
            control, data = pack(ranks.value[np.frombuffer(b"".join(batch["ids"]), kind)], n)
            return {"part": batch["part"], "doc_id": batch["doc_id"], "n": n.tolist(), "control": control, "data": data}

        return work

    bounds = quantiles(tokens, min(files, MAX_FILES))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + len(bounds) - range_of(bounds)).cast("long")
    coded = map_columns(tokens.select(part.alias("part"), "doc_id", "ids"), make, "part long, doc_id long, n long, control binary, data binary")

    def put(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        doc_ids, n = whole["doc_id"], whole["n"].to_numpy()
        control, data = whole["control"].to_pylist(), whole["data"].to_pylist()
        parts = [
            MAGIC + np.array([len(n), n.sum(), sum(map(len, control)), sum(map(len, data))], "<u8").tobytes(),
            doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
            doc_ids.is_null().to_numpy().astype(np.uint8).tobytes(),
            n.astype("<u8").tobytes(),
            b"".join(control),
            b"".join(data),
        ]
        name = f"part-{part:09d}.tok"
        _put(folder, name, parts)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(n)], pa.int64()), pa.array([n.sum()], pa.int64())], ["part", "name", "n_docs", "n_ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # one file's documents, coded
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and parts[a] != now:
                        yield put(now, held)
                        held = []
                    now = int(parts[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield put(now, held)

    ordered = coded.repartition("part").sortWithinPartitions("part", "doc_id", "n", "control", "data")
    parts = write_table(ordered.mapInArrow(write, "part long, name string, n_docs long, n_ids long"), "token-parts")
    # One row per file of many ids: few enough for one window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_file(folder: str, name: str, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ids (u32) of a file."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{name}") as source:
        raw = np.frombuffer(source.read(), np.uint8)
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"{name} is not a token file")
    n_docs, _, n_control, _ = raw[8:40].view("<u8").tolist()
    at = 40
    doc_id, at = raw[at : at + 8 * n_docs].view("<i8").tolist(), at + 8 * n_docs
    absent, at = raw[at : at + n_docs].tolist(), at + n_docs
    n, at = np.frombuffer(raw[at : at + 8 * n_docs].tobytes(), "<i8"), at + 8 * n_docs
    ranks = unpack(raw[at : at + n_control], raw[at + n_control :], n)
    return [None if a else d for a, d in zip(absent, doc_id, strict=True)], n, id_of[ranks]


def digests_of_files(parts: DataFrame, folder: str) -> DataFrame:
    """Read the files back, one task per file or few: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        with fs.open_input_stream(f"{path}/ranks.bin") as source:
            id_of = np.frombuffer(source.read(), "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, n, ids = read_file(folder, row["name"], id_of)
                raw, stop = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
                start = stop - n
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc_ids, start + row["start"], n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, parts.count())
    return parts.select("name", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 1, ids_per_file: int = 4_000_000) -> DataFrame:
    """Tokenise, write the files to the shared folder, read them back and digest: one row per document.

    Null or empty texts hold the end id alone; an empty table gives no rows; repeated rows are repeated, in doc_id
    order and, for equal doc_ids, by their ids. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    tokens = write_table(tokenize(docs, path, end_id), "token-ids")
    folder, kind = new_folder(spark, "token-files"), id_type(path)
    by_rank, total = count_ids(tokens, kind)
    parts = write_files(tokens, folder, by_rank, kind, -(-total // ids_per_file))
    drop_table(tokens)
    return digests_of_files(parts, folder)
