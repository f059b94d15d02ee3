import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import privacy

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def field():
    return privacy.train(privacy.labelled_table())


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                double = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
                if not 12 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], privacy.KINDS.index(s[0])))


def texts():
    rng = random.Random(8)
    parts = ["a@b.c", "1.2.3.4", "+49 (30) 1234567", "4632836149752474", "4632-8361 4975 2474", "x", "ñ", "@", "@@", ".", "-", "+", "..", "256.1.1.1",
             "a.b%c@d-e.f.g@h.i", "1.2.3.4.5.6.7.8", "00000000000000001.2.3.4", " ", "\n", "12", "+1", "(", "é@f.g", "a@b", "٣"]
    made = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    return [*made, "", "1" * 3000 + ".", "a" * 3000 + "@", "1." * 2000, "+1 " + "(" * 2000]


def test_base_spans_equal_the_patterns():
    for text in texts():
        assert privacy.base_spans(text) == plain(text), text


def test_very_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 2_000_000 + "@", "1 " * 300_000, "a@" * 300_000, "1." * 500_000):
        privacy.base_spans(text)


def test_viterbi_equals_all_paths(field):
    rng = np.random.default_rng(1)
    scores, transition, lengths = rng.normal(size=(6, 4, 3)), rng.normal(size=(4, 3)), np.array([4, 3, 2, 1, 4, 4])
    paths = privacy.viterbi(scores, transition, lengths)
    for row, n in enumerate(lengths):
        worth = {
            p: sum(scores[row, t, p[t]] + (transition[p[t - 1], p[t]] if t else transition[-1, p[0]]) for t in range(n))
            for p in itertools.product(range(3), repeat=int(n))
        }
        assert tuple(paths[row][:n]) == max(worth, key=worth.get)


def test_field_fits_held_out_sentences(field):
    right = total = 0
    for words, labels in privacy.labelled_table(rows=200, seed=99):
        vectors = np.array([field.vectors(w) for w in words])[None]
        path = privacy.viterbi(privacy._shifted(vectors), field.transition, np.array([len(words)]))[0]
        right += sum(privacy.LABELS[p] == label for p, label in zip(path, labels))
        total += len(words)
    assert right / total >= 0.95


def test_found_spans_in_unusual_forms_and_clean_texts(field):
    cases = {
        "please call (582) 555-9616 now": ("phone", 12, 26),
        "write irg.46 at mail7 dot com soon": ("email", 6, 29),
        "paid with 4632.8361.4975.2474 today": ("card", 10, 29),
    }
    for text, span in cases.items():
        assert span in privacy.field_spans(field, [text])[0]
    clean = ["version 3, page 12 of 300", "look at the 14th dot", "2021-03-04 12:30:05", "password=3d4bc476f7469ffa8a set", "1984-2010", "are at.\nAt the 3"]
    assert privacy.field_spans(field, clean) == [[] for _ in clean]


def test_spans_of_rows_and_masking(spark, field):
    rows = [(1, None), (2, ""), (3, "ñ a.b@c.de, 10.0.0.1 ñ"), (4, "plain words"), (3, "ñ a.b@c.de, 10.0.0.1 ñ"), (None, "x 7 " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    found = privacy.find(docs, field)
    got = found.select("doc_id", privacy.listed(F.col("__personal.base")), privacy.listed(F.col("__personal.spans"))).collect()
    assert sorted((r[0] or -1, r[1]) for r in got) == [(-1, ""), (1, ""), (2, ""), (3, "email:2:10,ip:12:20"), (3, "email:2:10,ip:12:20"), (4, "")]
    assert all(r[1] == r[2] for r in got)
    hidden = {r.doc_id: r.text for r in privacy.masked(docs, field).collect()}
    assert hidden[3] == "ñ [email], [ip] ñ" and hidden[1] is None and hidden[4] == "plain words"
    assert privacy.find(docs.limit(0), field).count() == 0


def test_base_spans_stay():
    base = [("email", 5, 10), ("card", 5, 10)]
    assert privacy.joined(base, [("phone", 9, 12), ("ip", 10, 12), ("ip", 3, 3)]) == [*base, ("ip", 10, 12)]


def test_spelled_out_addresses_need_no_digit_elsewhere(field):
    forms = ["jane (at) example (dot) org", "jane [at] example [dot] com", "jane (AT) example (DOT) org", "jane at example dot\ncom",
             "jane at\nexample\ndot com", "jane\tat\texample\tdot\tcom", "jane (at) example\n\n(dot) org", "jane At example Dot com"]
    for form in forms:
        text = f"please write to {form} soon"
        alone, beside = privacy.field_spans(field, [text, text + " and so on and on and on until 7"])
        assert alone == beside and ("email", 16, 16 + len(form)) in alone, form
    assert privacy.field_spans(field, ["look at the dot", "a dot at the end", "the dotted line at the plate", "at dot"]) == [[]] * 4


def test_long_chains_lose_nothing_where_their_parts_meet(field, monkeypatch):
    for between in (", ", " x ", " call "):
        row = "(582) 555-9616" + between
        whole = [("phone", i * len(row), i * len(row) + 14) for i in range(3000)]
        assert privacy.field_spans(field, [row * 3000]) == [whole]
    lines = "x 7 (582) 555-9616 jane at mail7 dot com 4632.8361.4975.2474 " * 40
    short = privacy.field_spans(field, [lines])
    monkeypatch.setattr(privacy, "CHAIN_WORDS", 7)
    assert sorted(privacy.field_spans(field, [lines])[0]) == sorted(short[0]) and short[0]


def test_long_path_equals_viterbi(field, monkeypatch):
    monkeypatch.setattr(privacy, "CHAIN_WORDS", 5)
    rng = random.Random(3)
    pool = ["(582)", "555-9616", "jane", "at", "mail7", "dot", "com", "12", "4632", "8361"]
    for n in (1, 4, 5, 6, 23, 200):
        words = [rng.choice(pool) for _ in range(n)]
        vectors = np.array([field.vectors(w) for w in words])[None]
        path = privacy.viterbi(privacy._shifted(vectors), field.transition, np.array([n]))[0]
        assert privacy.long_path(words, field.vectors, field.transition).tolist() == path.tolist()
