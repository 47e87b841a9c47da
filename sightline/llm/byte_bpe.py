"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end the prefix's encoding. The encoder stores that last
token for each prefix; walking back from the end gives the ids. Appending bytes only adds entries, and after an edit
only the entries from the edit onward are made again. A token t may follow a prefix's last token p if merging the
bytes of p and t by rank gives back exactly (p, t).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import cached_property
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_worker, map_columns, text_of

#: Entries kept by a task's cache of encoded pieces; it starts anew beyond that, so memory stays bounded.
CACHE_ENTRIES = 300_000
#: Pieces kept beside the stretches, most of which are one piece.
PIECE_ENTRIES = 100_000
#: Bytes of a piece of which only some prefixes are gone into, and such prefixes remembered.
PREFIX_BYTES, PREFIX_ENTRIES = 64, 100_000


class PrefixEncoder:
    """Encodes byte strings with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self._follows: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._prefixes: dict[bytes, tuple[int, ...]] = {}

    @cached_property
    def starts(self) -> dict:
        """A tree of the tokens' bytes; a token that ends at a node is its entry -1."""
        tree: dict = {}
        for data, token in self.ranks.items():
            node = tree
            for byte in data:
                node = node.setdefault(byte, {})
            node[-1] = token
        return tree

    def merged(self, data: bytes) -> list[int]:
        """Lowest-rank-first merging; only used on the bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a single byte."""
        known = self._halves.get(token, 0)
        if known == 0:
            data = self.token_bytes[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def may_follow(self, last: int, token: int) -> bool:
        """Whether no merge joins the two tokens: undoes their merges beside the border from the latest to the
        earliest, and looks for a merge across the border that would have come first."""
        pair = last << 32 | token
        known = self._follows.get(pair)
        if known is None:
            if len(self._follows) > CACHE_ENTRIES:
                self._follows.clear()
            known = self._follows[pair] = self._apart(last, token)
        return known

    def _apart(self, left: int, right: int) -> bool:
        before = 1 << 60  # a merge across the border comes first if its rank is below this
        get, data = self.ranks.get, self.token_bytes
        while True:
            joined = get(data[left] + data[right])
            if joined is not None and joined < before:
                return False
            sides = [s for s in (left, right) if len(data[s]) > 1]
            if not sides:
                return True
            if left in sides and (right not in sides or left > right):
                before, left = left, self.halves(left)[1]  # type: ignore[index]  # equal ranks: the left one is first
            else:
                before, right = right + 1, self.halves(right)[0]  # type: ignore[index]

    def extend(self, data: bytes, lasts: list[int]) -> list[int]:
        """The last token of every prefix of data, given those of the first len(lasts) prefixes."""
        done, size = len(lasts), len(data)
        found: list = [*lasts, *[None] * (size - done)]
        follows = self._follows
        for start in range(max(0, done - self.longest + 1), size):
            last, node = found[start - 1], self.starts
            for end in range(start, size):
                node = node.get(data[end])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and found[end] is None:
                    apart = not start or follows.get(last << 32 | token)
                    if self.may_follow(last, token) if apart is None else apart:
                        found[end] = token
            if found[start] is None:
                raise ValueError("the vocabulary lacks a single byte")
        return found

    def walk(self, lasts: list[int]) -> list[int]:
        out, end = [], len(lasts)
        while end:
            out.append(lasts[end - 1])
            end -= len(self.token_bytes[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.walk(self.extend(data, [])) if len(data) > PREFIX_BYTES or not data else [*self._ids(data)]

    def _ids(self, data: bytes) -> tuple[int, ...]:
        """The ids of a short prefix: those of the prefix before its last token, and that token, longest tokens first.
        Only the prefixes that are asked for are gone into; those that pieces have in common are remembered."""
        get, follows, known = self.ranks.get, self._follows, self._prefixes
        for start in range(max(0, len(data) - self.longest), len(data)):
            token = get(data[start:])
            if token is not None:
                if not start:
                    return (token,)
                prefix = data[:start]
                before = known.get(prefix)
                if before is None:
                    before = self._ids(prefix)
                    if len(known) >= PREFIX_ENTRIES:
                        known.clear()
                    known[prefix] = before
                apart = follows.get(before[-1] << 32 | token)
                if self.may_follow(before[-1], token) if apart is None else apart:
                    return (*before, token)
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, data: bytes, lasts: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Data and last tokens after appending bytes: no stored entry changes."""
        return data + more, self.extend(data + more, lasts)

    def edit(self, data: bytes, lasts: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace data[start:stop]. Entries before start stay; entries after the edit are taken over as soon as a
        whole token length of them agrees with the stored ones, since each entry only depends on those before it."""
        out = data[:start] + new + data[stop:]
        made, shift, same = list(lasts[:start]), len(new) - (stop - start), start + len(new)
        while len(made) < len(out):
            made = self.extend(out[: len(made) + self.longest], made)
            old = len(made) - shift
            if len(made) - self.longest >= same and made[-self.longest :] == lasts[old - self.longest : old]:
                made += lasts[old:]
        return out, made

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class TextEncoder:
    """Encodes whole texts: each match of the pattern separately, with a bounded cache of encoded stretches.

    With a pattern in which a blank between two other characters always starts a match, a text may be cut there
    without changing its matches; stretches between such cuts repeat a lot and are encoded once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_at_blanks: bool, entries: int = CACHE_ENTRIES):
        import regex

        self.entries = entries
        self.encoder = PrefixEncoder(ranks)
        self.find = regex.compile(pattern).findall
        self.cut_at_blanks = cut_at_blanks
        # Each cache has an older generation, to which it moves when it is full: what is in use comes back from there.
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older_pieces: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.older_stretches: dict[str, tuple[int, ...]] = {}

    def plain(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        found = self.find(text)
        for piece in found:
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.older_pieces.get(piece)
                if ids is None:
                    ids = tuple(self.encoder.encode(piece.encode("utf-8", "surrogatepass")))
                if len(piece) < 64:
                    if len(self.pieces) >= PIECE_ENTRIES:
                        self.older_pieces, self.pieces = self.pieces, {}
                    self.pieces[piece] = ids
            if len(found) == 1:
                return ids  # the caches then share it
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not self.cut_at_blanks:
            return list(self.plain(text))
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return list(self.plain(text))
        if len(self.stretches) >= self.entries:
            self.older_stretches, self.stretches = self.stretches, {}
        known, older = self.stretches, self.older_stretches
        for part in set(rest).difference(known):
            ids = older.get(part)
            if ids is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return list(self.plain(text))
                ids = self.plain(" " + part)
            known[part] = ids
        parts = map(known.__getitem__, rest)
        return [*self.plain(first), *chain.from_iterable(parts)]


#: The pattern for which cutting at single blanks is exact.
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str, pattern: str, entries: int) -> TextEncoder:
    return TextEncoder(load_ranks(path), pattern, pattern == CUTTABLE, entries)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ids (array of int) to every row; other columns stay. A null or empty text has no ids."""
    kept = [c for c in docs.columns if c != "ids"]

    def make() -> Callable[[dict], dict]:
        encoder = in_worker(_encoder, path, pattern, CACHE_ENTRIES)
        return lambda batch: batch | {"ids": [encoder.encode(t or "") for t in batch[text]]}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    return map_columns(docs.select(kept), make, f"{fields}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Add data (binary) to every row with ids; null ids decode to no bytes."""
    kept = [c for c in encoded.columns if c != "data"]

    def make() -> Callable[[dict], dict]:
        table = {v: k for k, v in load_ranks(path).items()}
        return lambda batch: batch | {"data": [b"".join(map(table.__getitem__, ids or ())) for ids in batch["ids"]]}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(kept).schema)
    return map_columns(encoded.select(kept), make, f"{fields}, data binary")


def digest_round_trip(docs: DataFrame, path: str, pattern: str, entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per document: doc_id, n_tokens, sha256 of its ids and of the bytes that the ids decode to.

    Encodes, and decodes the ids again, in one narrow stage: no shuffle, and only digests leave the task. Null texts
    count as empty (0 tokens). Repeated rows give repeated results, an empty table no rows; other columns are not read.
    entries: stretches of text that a worker remembers; fewer take less memory and more time.
    """

    def make() -> Callable[[dict], dict]:
        encoder = in_worker(_encoder, path, pattern, entries)
        table = encoder.encoder.token_bytes
        names = {i: str(i) for i in table}

        def work(batch: dict) -> dict:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch["text"]:
                ids = encoder.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_columns(rows, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
