"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The random field adds spans that the patterns miss (phones without a country
code, spelled-out addresses, identity numbers, version 6 addresses, secrets such as access tokens). It is trained on
the small labelled table below. Every word of every text is labelled: a line is a sequence, decoded by Viterbi over
padded batches in numpy. Lines for which a bound on the scores already proves that every word is outside are not
walked through.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_columns, text_of

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: The base patterns. A run of digits has no digit before it: the leftmost match starts a run anyway.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digit = re.compile(r"[0-9]")
_word = re.compile(r"\S+")
#: Words (padded) whose labels are worked out at once.
AREA = 65_536
#: Signs cut off the ends of a word, and words that spell out an address.
EDGE = ".,;:!?\"'*#%$&|="
MARKS = frozenset(("[at]", "(at)", "[dot]", "(dot)", "at", "dot"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = re.sub(r"[ -]", "", text)
    return re.fullmatch(r"[0-9]{13,19}", digits) is not None and luhn(digits)


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local_chars:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in IP.finditer(text):
            parts = [part.lstrip("0") for part in m.group().split(".")]
            if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


#: An address spelled out: at and dot as words of their own, or an at in brackets.
_spelled = re.compile(r"[^,;:!?]*(?:\bat\b[^,;:!?]*\bdot\b|[\[(]at[\])])[^,;:!?]*", re.I)
_runs = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)


def _case(letters: str) -> str:
    return "a" if letters.islower() else "A" if letters.isupper() else "Aa"


def shape(word: str) -> tuple[str, ...]:
    """Features of a word: its shape with run lengths in a few sizes, and some of its parts."""
    core = word.strip(EDGE)
    if core.isalpha() and len(core) > 3:
        return ("shape=" + _case(core), "kinds=a", "first=", "digits=0")
    runs = []
    for m in _runs.finditer(core):
        part = m.group()
        if part[0] in "0123456789":
            n = len(part)
            runs.append(f"d{n}" if n <= 4 else "d5-8" if n <= 8 else "d9-13" if n <= 13 else "d14+")
        else:
            runs.append(_case(part) if part[0].isalpha() else part[0])
    digits = re.sub(r"[^0-9]", "", core)
    kinds = "d" * bool(digits) + "a" * any(c.isalpha() for c in core) + "s" * any(not c.isalnum() for c in core)
    first = core[:1] if core[:1] in "+([" else ""
    size = len(core)
    return (
        "shape=" + "".join(runs),
        "kinds=" + kinds,
        "first=" + first,
        f"digits={min(len(digits), 20)}",
        "luhn" if 14 <= len(digits) <= 19 and luhn(digits) else "",
        "@" if "@" in core else "",
        "colons" if core.count(":") >= 2 and re.fullmatch(r"[0-9a-fA-F:]+", core) and ("::" in core or core.count(":") >= 5) else "",
        "word=" + core.lower() if core.lower() in MARKS else "",
        f"token{min(size // 16, 3)}" if size >= 16 and kinds == "da" and core.isascii() else "",
        "hex" if size >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core) else "",
        "sign" if not core else "",
    )


class Field:
    """A linear-chain random field: weights by feature of the word, the one before and the one after; label pairs."""

    LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
    OFFSETS = (0, -1, 1)

    def __init__(self, table: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 90, rate: float = 0.2, decay: float = 0.02):
        self.feature: dict[str, int] = {}
        rows, labels = [], []
        for text, spans in table:
            words = [(m.start(), m.end()) for m in _word.finditer(text)]
            rows.append([[self.feature.setdefault(f, len(self.feature)) for f in shape(text[a:b]) if f] for a, b in words])
            labels.append([self._label(a, spans) for a, _ in words])
        n, k, longest = len(rows), len(self.LABELS), max(map(len, rows))
        x = np.zeros((3, n, longest, len(self.feature)), np.float32)
        y, length = np.zeros((n, longest), int), np.array([len(r) for r in rows])
        for i, (row, label) in enumerate(zip(rows, labels, strict=True)):
            y[i, : len(label)] = label
            for o, offset in enumerate(self.OFFSETS):
                for t in range(len(row)):
                    if 0 <= t + offset < len(row):
                        x[o, i, t, row[t + offset]] = 1
        self.weight, self.pair = np.zeros((3, len(self.feature), k)), np.zeros((k, k))
        self.banned = np.array([[b.startswith("I") and a[1:] != b[1:] for b in self.LABELS] for a in self.LABELS])
        self.begin = np.array([-1e4 if b.startswith("I") else 0.0 for b in self.LABELS])
        self._train(x, y, length, steps, rate, decay)

    def _label(self, start: int, spans: list[tuple[int, int, str]]) -> int:
        for a, b, kind in spans:
            if a <= start < b:
                return self.LABELS.index(("B-" if start == a else "I-") + kind)
        return 0

    def _train(self, x, y, length, steps: int, rate: float, decay: float) -> None:
        n, longest, k = *y.shape, len(self.LABELS)
        on = np.arange(longest)[None] < length[:, None]
        gold = np.eye(k)[y] * on[:, :, None]
        gold_pair = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
        moment = [np.zeros_like(self.weight), np.zeros_like(self.pair), np.zeros_like(self.weight), np.zeros_like(self.pair)]
        for step in range(1, steps + 1):
            score = sum(x[o] @ self.weight[o] for o in range(3))
            pair = np.where(self.banned, -1e4, self.pair)
            ahead, back = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            ahead[:, 0] = score[:, 0] + self.begin
            for t in range(1, longest):
                new = _logsum(ahead[:, t - 1, :, None] + pair[None], 1) + score[:, t]
                ahead[:, t] = np.where(on[:, t, None], new, ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _logsum(pair[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(on[:, t + 1, None], new, 0)
            total = _logsum(ahead[:, -1], 1)
            mean = np.exp(ahead + back - total[:, None, None]) * on[:, :, None]
            both = ahead[:, :-1, :, None] + pair[None, None] + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
            mean_pair = (np.exp(both) * on[:, 1:, None, None]).sum((0, 1))
            slope = [np.stack([x[o].reshape(-1, x.shape[-1]).T @ (gold - mean).reshape(-1, k) for o in range(3)]) - decay * self.weight, gold_pair - mean_pair - decay * self.pair]
            for i, (value, g) in enumerate(zip((self.weight, self.pair), slope, strict=True)):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                moment[i + 2] = 0.99 * moment[i + 2] + 0.01 * g * g
                value += rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(moment[i + 2] / (1 - 0.99**step)) + 1e-8)

    def emissions(self, features: tuple[str, ...]) -> np.ndarray:
        """Scores (3, labels) that a word gives its own place, the next one (as the word before) and the last."""
        at = [self.feature[f] for f in features if f in self.feature]
        return self.weight[:, at].sum(1)

    def surely_outside(self, score: np.ndarray) -> np.ndarray:
        """Words (scores of any shape, labels last) that would lose by not being O, whatever is around them: a label is
        charged with the best pair that leads to it and, if that helps, the pair that leads from it to O."""
        pair = np.where(self.banned, -1e4, self.pair) - self.pair[0, 0]
        won = np.maximum(np.where(self.begin < 0, -1e4, 0), pair.max(0)) + np.maximum(0, pair[:, 0])
        return (score[..., 1:] + won[1:].astype(score.dtype)).max(-1) < score[..., 0]

    def viterbi(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best labels (sequences, words) of a padded batch of scores (sequences, words, labels)."""
        n, longest, k = score.shape
        pair = np.where(self.banned, -1e4, self.pair).astype(score.dtype)
        best, came = score[:, 0] + self.begin.astype(score.dtype), np.zeros(score.shape, np.int8)
        ends = np.zeros_like(best)
        ends[length == 1] = best[length == 1]
        for t in range(1, longest):
            reach, back = best[:, :1] + pair[0], came[:, t]
            for label in range(1, k):
                other = best[:, label : label + 1] + pair[label]
                np.copyto(back, np.int8(label), where=other > reach)
                np.maximum(reach, other, out=reach)
            best = reach + score[:, t]
            ends[length == t + 1] = best[length == t + 1]
        out, now = np.zeros((n, longest), np.int8), ends.argmax(1)
        for t in range(longest - 1, -1, -1):
            inside = t < length
            out[inside, t] = now[inside]
            now = np.where(inside, came[np.arange(n), t, now], now) if t else now
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def labelled_table(rows: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: texts with (start, end, kind), made from these forms (# is a digit, X a letter)."""
    draw = random.Random(seed)
    forms = {
        "phone": ["(###) ###-####", "###-###-####", "###.###.####", "+## ### #######", "+# (###) ###-####", "0## ########", "00## ### ######"],
        "id": ["###-##-####", "###-##-####", "XX######X"],
        "email": ["xxxx@xxxx.xxx", "xx.##@xxxx#.xxxxx.com", "xxxx [at] xxxx [dot] com", "xxxx (at) xxxx.com", "xxx.xxxx (at) xxxx (dot) org", "xxxx at xxxx dot com", "xxxx.xxxx at xxxx dot org", "xxxx [at] xxxx [dot] xxxx [dot] org"],
        "ip": ["2001:db8:##:#::#", "fe80::#:##:###", "##.###.##.###"],
        "card": ["LUHN", "LUHN4"],
        "secret": ["HEX32", "HEX40", "HEX64", "TOKEN20", "TOKEN36"],
    }
    other = ["####", "##", "#", "2.0.", "#.#", "##:##", "20##-0#-1#", "##/##/20##", "$##.##", "###,###", "##%", "v#.#.#", "#.#.#", "xxxx = #", "xxxx = \"xxxx\"", "xxxx at xxxx", "xxxx dot xxxx", "xxxx: xxxx#", "xxxx#", "#xx", "(##)", "(20##)", "###-###", "##-##", "################", "#### #### #### ####", "#########", "############", "xx#x-##x", "http://xxxx.com/##", "@xxxx", "p. ##-##", "(a)", "at xxxx", "##.##", "#,##"]
    letters = "abcdefghijklmnopqrstuvwxyzäéñ"

    def fill(form: str) -> str:
        if form.startswith("LUHN"):
            body = "4" + "".join(draw.choice("0123456789") for _ in range(14))
            whole = next(body + d for d in "0123456789" if luhn(body + d))
            return " ".join(whole[i : i + 4] for i in range(0, 16, 4)) if form == "LUHN4" else whole
        if form.startswith(("HEX", "TOKEN")):
            signs = draw.choice(["0123456789abcdef", "0123456789ABCDEF"]) if form[0] == "H" else "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
            size = int(form.lstrip("HEXTOKN"))
            return next(s for _ in range(99) if re.search("[0-9]", s := "".join(draw.choice(signs) for _ in range(size))) and re.search("[a-zA-Z]", s))
        if set(form) <= set("# ") and form.count("#") == 16:
            return next(s for _ in range(99) if not luhn((s := re.sub("#", lambda _: draw.choice("0123456789"), form)).replace(" ", "")))
        form = re.sub("#", lambda _: draw.choice("0123456789"), form)
        form = re.sub(r"\bx+|(?<=[.@])x+", lambda m: "".join(draw.choice(letters[:26]) for _ in range(draw.randint(2, 8))), form) if "x" in form and "2001" not in form and "db8" not in form else form
        return re.sub("X", lambda _: draw.choice("ABCDEFGHKLMNP"), form)

    def plain() -> str:
        word = "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
        word = word.capitalize() if draw.random() < 0.15 else word
        return word + draw.choice(["", "", "", "", ",", ".", "!!", "***", "$$$"])

    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(draw.randint(1, 3)):
            text += "".join(plain() + " " for _ in range(draw.randint(0, 4)))
            if draw.random() < 0.5:
                kind = draw.choice(KINDS)
                value = fill(draw.choice(forms[kind]))
                if kind == "secret":
                    text += draw.choice(["token = \"", "key = ", "", "secret: ", "password: "])
                spans.append((len(text), len(text) + len(value), kind))
                text += value + draw.choice(["", "", ".", ",", '"'] if kind != "secret" else ['"', '"', '"!!', "", '",']) + " "
            else:
                text += fill(draw.choice(other)) + " "
        text += "".join(plain() + " " for _ in range(draw.randint(0, 3)))
        table.append((text, spans))
    return table


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field(labelled_table())


class Finder:
    """Finds the spans of batches of texts in one task; what words look like is kept in bounded caches."""

    def __init__(self, field: Field):
        self.field, self.words, self.looks = field, {}, {}
        self.table = np.zeros((3, 1024, len(Field.LABELS)), np.float32)

    def _row(self, word: str) -> int:
        """The row of the table with the scores of a word. Words that look the same share one."""
        features = shape(word)
        row = self.looks.get(features)
        if row is None:
            row = self.looks[features] = len(self.looks)
            if row == self.table.shape[1]:
                self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
            self.table[:, row] = self.field.emissions(features)
        if len(word) < 64:
            self.words[word] = row
        return row

    def _scores(self, words: list[str], first: np.ndarray) -> np.ndarray:
        """Scores (words, labels); first marks the words that begin a sequence."""
        if len(self.words) > 200_000 or len(self.looks) > 20_000:
            self.words.clear()
            self.looks.clear()
        known = self.words
        rows = np.array([known[w] if w in known else self._row(w) for w in words])
        score = self.table[0, rows]
        inner = ~first[1:]
        score[1:] += self.table[1, rows[:-1]] * inner[:, None]
        score[:-1] += self.table[2, rows[1:]] * inner[:, None]
        return score

    def __call__(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, all spans) of each text, as (start, kind number, end)."""
        base = [base_spans(t) for t in texts]
        whole = [list(b) for b in base]
        for begin, stop in _stretches(texts):
            for i, part, labels in self._labelled(texts, begin, stop):
                whole[i] += self._spans(texts[i], part, labels, base[i])
        return [(b, sorted(w)) for b, w in zip(base, whole, strict=True)]

    def _labelled(self, texts: list[str], begin: int, stop: int) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
        """Text number, words as (start, end) and labels of each line of some texts that may hold a span."""
        words, lines = [], []  # lines: text number, start in the text, number of words
        for i in range(begin, stop):
            at = 0
            for line in texts[i].split("\n"):
                found = line.split()
                if found:
                    words += found
                    lines.append((i, at, len(found)))
                at += len(line) + 1
        if not words:
            return
        n = np.array([line[2] for line in lines])
        own = np.cumsum(n) - n
        first = np.zeros(len(words), bool)
        first[own] = True
        score = self._scores(words, first)
        open_ = np.flatnonzero(~np.logical_and.reduceat(self.field.surely_outside(score), own))
        open_ = open_[np.argsort(n[open_], kind="stable")]
        while len(open_):
            longest = np.maximum.accumulate(n[open_])
            size = max(1, int(np.searchsorted(longest * np.arange(1, len(open_) + 1), AREA)))
            batch, open_ = open_[:size], open_[size:]
            length = n[batch]
            padded = np.zeros((len(batch), length.max(), score.shape[1]), np.float32)
            for k, line in enumerate(batch):
                padded[k, : length[k]] = score[own[line] : own[line] + length[k]]
            labels = self.field.viterbi(padded, length)
            for k in np.flatnonzero(labels.any(1)):
                i, at, size_ = lines[batch[k]]
                stop_ = texts[i].find("\n", at)
                part = [m.span() for m in _word.finditer(texts[i], at, len(texts[i]) if stop_ < 0 else stop_)]
                yield i, part, labels[k, :size_].tolist()

    @staticmethod
    def _spans(text: str, part: list[tuple[int, int]], labels: list[int], base: list) -> list[tuple[int, int, int]]:
        found, k = [], 0
        while k < len(part):
            if labels[k] % 2 == 0:
                k += 1
                continue
            kind, stop = labels[k] // 2, k + 1
            while stop < len(part) and labels[stop] == labels[k] + 1:
                stop += 1
            start, end = part[k][0], part[stop - 1][1]
            while end > start and text[end - 1] in EDGE:
                end -= 1
            while start < end and text[start] in "\"'*#%$&|=,;:":
                start += 1
            inside = text[start:end]
            digits = sum(c.isdigit() for c in inside)
            whole = [
                "@" in inside or _spelled.fullmatch(inside) is not None, ":" in inside, _is_card(inside), 9 <= digits <= 15, digits >= 6,
                digits > 0 and len(inside) >= 16 and inside.isascii(),
            ][kind]
            if kind == 2 and not whole:  # a number before the card may be in its span
                start, whole = next(((a, True) for a, _ in part[k + 1 : stop] if _is_card(text[a:end])), (start, False))
            if whole and not any(a < end and start < b for a, _, b in base):
                found.append((start, kind, end))
            k = stop
        return found


def _stretches(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters; a longer text is a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    yield begin, len(texts)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all
    spans), has_personal (whether there is one).

    Null texts are empty and have no spans; repeated rows give repeated results; an empty table gives no rows; other
    columns are not read. The random field is trained on the driver from the labelled table (fixed size) and sent to
    the tasks. It labels every word of every text; a span ends with its line. A span of the field never replaces or
    overlaps a base span.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        finder = Finder(field.value)

        def work(batch: dict) -> dict:
            found = finder(batch["text"])
            out = {"doc_id": batch["doc_id"]}
            for k, kind in enumerate(KINDS[:4]):
                out[f"n_{kind}"] = [sum(s[1] == k for s in b) for b, _ in found]
            out["base_sha256"] = [hashlib.sha256(spell(b).encode()).hexdigest() for b, _ in found]
            out["spans"] = [spell(w) for _, w in found]
            out["n_spans"] = [len(w) for _, w in found]
            out["has_personal"] = [bool(w) for _, w in found]
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_columns(rows, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, has_personal boolean")
