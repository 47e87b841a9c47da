import re

from sightline.llm import personal_data as pd_


def plain_spans(text):
    """The base patterns as stated, by plain regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and pd_.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


ODD = [
    "a@b.c d@@e.f @x.y z@q p.q@r.s.t@u.v.w",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 42424242424242424242",
    "+1 (555) 010-9999 +49 30 1234567 +1 2 +1234567890123456789",
    "é@b.c ü.x@mail.example.com,y",
    "+1 (826) 555-4081 190.137.223.20",
    "0" * 5000 + "1.2.3.4 and 1." + "9" * 6000 + ".1.1",
]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text in texts:
        assert pd_.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    assert pd_.base_spans("a" * 200_000 + " 1" * 50_000) == []
    assert pd_.base_spans("1" * 200_000) == []
    assert pd_.base_spans(("x" * 50 + "@") * 4_000) == []


def test_field_adds_what_patterns_miss_and_leaves_plain_text_alone():
    finder = pd_.Finder(pd_.trained())
    text = "call (212) 555-0199 or john [at] mail [dot] com, id 123-45-6789, host 2001:db8::1 on 2021-05-06 in 1998 v2.0 page 12"
    base, whole = finder([text])[0]
    assert base == []
    assert {text[a:b] for a, _, b in whole} == {"(212) 555-0199", "john [at] mail [dot] com", "123-45-6789", "2001:db8::1"}
    for plain in ("Version 2.0 of 1998, pages 12-14 (a), $45.99 and 3,000 more at 10:30.", "We met at home, dot by dot", "1234567890123456"):
        assert finder([plain])[0] == ([], [])


def test_held_out_rows_of_the_labelled_table():
    table = pd_.labelled_table(300, seed=99)
    found = pd_.Finder(pd_.trained())([t for t, _ in table])
    want = [{(a, b) for a, b, _ in spans} for _, spans in table]
    got = [{(a, b) for a, _, b in whole} for _, whole in found]
    right = sum(len(w & g) for w, g in zip(want, got, strict=True))
    assert right >= 0.85 * sum(map(len, want)) and right >= 0.95 * sum(map(len, got))


def test_viterbi_finds_the_best_path():
    import itertools

    import numpy as np

    field = pd_.trained()
    draw = np.random.default_rng(4)
    score = draw.normal(size=(3, 4, len(field.LABELS)))
    got = field.viterbi(score, np.array([4, 2, 1]))
    pair = np.where(field.banned, -1e4, field.pair)
    for k, n in enumerate((4, 2)):
        paths = itertools.product(range(len(field.LABELS)), repeat=n)
        best = max(paths, key=lambda p: field.begin[p[0]] + sum(score[k, t, x] for t, x in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[k, :n]) == best


def test_odd_documents(odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in pd_.find(odd_documents).collect()}
    assert (rows[None]["n_email"], rows[None]["n_phone"]) == (1, 1)
    assert rows[None]["spans"].startswith("phone:5:") and "email" in rows[None]["spans"]
    assert rows[3]["spans"] == rows[4]["spans"] == ""
    assert pd_.find(odd_documents).count() == odd_documents.count()
    assert pd_.find(no_documents).count() == 0


def test_long_and_capital_bracketed_addresses():
    finder = pd_.Finder(pd_.trained())
    for text, want in (
        ("write to jane [at] mail [dot] example [dot] org today", "jane [at] mail [dot] example [dot] org"),
        ("write to john [AT] mail [DOT] com today", "john [AT] mail [DOT] com"),
    ):
        base, whole = finder([text])[0]
        assert base == [] and want in {text[a:b] for a, _, b in whole}, [text[a:b] for a, _, b in whole]


def test_labelled_card_after_a_number_is_kept():
    text = "12 4111 1111 1111 1111 x"
    part = [m.span() for m in re.finditer(r"\S+", text)]
    first, more = (pd_.Field.LABELS.index(x) for x in ("B-card", "I-card"))
    for labels in ([0, first, more, more, more, 0], [first, more, more, more, more, 0]):
        assert pd_.Finder._spans(text, part, labels, []) == [(3, 2, 22)]
    assert pd_.Finder._spans("4111 1111 1111 1112", [(0, 4), (5, 9), (10, 14), (15, 19)], [first, more, more, more], []) == []


def test_secrets_and_plainly_spelled_addresses():
    finder = pd_.Finder(pd_.trained())
    for text, want in (
        ('uses token = "1eb9c654e721b4f812088970e66a6345aabbccdd"!! here', "1eb9c654e721b4f812088970e66a6345aabbccdd"),
        ("mail jane at example dot com today", "jane at example dot com"),
    ):
        base, whole = finder([text])[0]
        assert base == [] and any(want in text[a:b] for a, _, b in whole), whole


def test_lines_that_are_not_walked_through_have_no_span():
    field = pd_.trained()
    texts = ODD + [t for t, _ in pd_.labelled_table(200, seed=5)] + ["plain words of no note\n" * 50]

    class Whole(pd_.Field):
        def surely_outside(self, score):
            return super().surely_outside(score) & False

    whole = Whole.__new__(Whole)
    whole.__dict__ = field.__dict__
    assert pd_.Finder(field)(texts) == pd_.Finder(whole)(texts)


def test_planted_personal_data_is_found(spark):
    """All kinds together, over the documents: each text with one of the planted forms is marked, most others are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    marked = {r["doc_id"]: r["has_personal"] for r in pd_.find(docs).collect()}
    planted = re.compile(r"[\w.]+@mail\d|\+1 \(\d{3}\)|token = \"[0-9a-fA-F]{40}|\b(?:\d{1,3}\.){3}\d{1,3}\b")
    want = {r["doc_id"] for r in docs.collect() if planted.search(r["text"] or "")}
    assert want and all(marked[i] for i in want)
    assert sum(marked.values()) <= len(want) + 0.02 * len(marked)
