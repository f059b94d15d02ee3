import random
from collections import Counter
import re

from pyspark.sql import functions as F

from corpusloom.llm import cascade
from corpusloom.llm.cascade import Rule, Text


def plain(text):
    """The base measures, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


def texts():
    rng = random.Random(2)
    made = [None, "", " \n\t", "é*\x1c x y", "a b c d e f g h " * 3, "same line\nsame line\nsame line \n\n", "w " * 9, "w " * 8]
    for _ in range(60):
        words = [rng.choice(["un", "dos", "trés", "#", "日本", "x\x0b", "4"]) for _ in range(rng.randrange(80))]
        made.append(rng.choice([" ", "\n", "  "]).join(words) + rng.choice(["", "\n"] + [" ".join(words)] * 2))
    return made + ["word" * 500_000, " ".join(map(str, range(60_000)))]


def test_base_measures_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = cascade.judged(docs, cascade.RULES).select("text", "__rules.*").collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if len(r.text or "") < 100_000:
            base = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert base == plain(r.text)
            if base[0] < 20 or 100 * base[4] > 30 * base[0]:
                assert r.failed is not None
    long = next(r for r in got if (r.text or "").startswith("0 1 2"))
    assert (long.n_words, long.n_repeat_words, long.failed) == (60_000, 0, "words_with_letter")


def test_order_changes_no_verdict():
    for text in texts()[:60]:
        data = Text((text or "").encode())
        forward = cascade.first_failure(data, cascade.RULES)
        assert (forward is None) == (cascade.first_failure(data, cascade.RULES[::-1]) is None)


def test_rules_run_by_rejections_per_cost():
    cheap, useless = Rule("cheap", lambda t: 1, most=0, needs=()), Rule("useless", lambda t: 0, needs=())
    dear = Rule("dear", lambda t: 1, most=0, needs=("words", "repeated_words"))
    assert [r.name for r in cascade.ordered([useless, dear, cheap], [b"x y"], paid=())] == ["cheap", "useless", "dear"]
    assert [r.name for r in cascade.ordered([useless, dear, cheap], [b"x y"])] == ["dear", "useless", "cheap"]
    assert cascade.ordered([useless, cheap], []) == [useless, cheap]


def test_selectivity_is_that_of_the_texts_left():
    """``second`` rejects most of all texts, but nothing that ``first`` lets pass; ``third`` does."""
    first = Rule("first", lambda t: len(t.words), least=3)
    second = Rule("second", lambda t: len(t.words), least=2, needs=("words", "each_word"))
    third = Rule("third", lambda t: t.data.count(b"z"), most=0, needs=("words", "each_word"))
    sample = [b"a"] * 6 + [b"a b"] * 2 + [b"a b c z"] * 1 + [b"a b c d"] * 3
    assert [r.name for r in cascade.ordered([second, third, first], sample)] == ["first", "third", "second"]


def test_short_circuit_saves_calls_and_work():
    calls = Counter()

    def counting(rule):
        def measure(text):
            calls[rule.name] += 1
            return rule.measure(text)

        return Rule(rule.name, measure, rule.least, rule.most, rule.needs)

    rules = [counting(rule) for rule in cascade.RULES]
    junk = [b"le " * 40, b"a b", b"### %% ## " * 30, b"1 2 3 4 " * 9] * 50
    prose = ["the river walks under an old bridge as morning light turns slowly into day".split()] * 20
    sample = junk + [b" ".join(f"{w}{i}".encode() for i in range(3) for w in own) for own in prose]
    for paid, share in (((), 0.5), (cascade.REPORTED, 0.7)):
        order = cascade.ordered(rules, sample, paid)
        calls.clear()
        verdicts = [cascade.first_failure(Text(t), order) is None for t in sample]
        assert sum(calls.values()) < share * len(rules) * len(sample)
        assert verdicts == [all(not r.rejects(Text(t)) for r in cascade.RULES) for t in sample]


def test_kept_equals_the_verdicts(spark):
    rows = list(enumerate(texts()[:80]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passed = {r.doc_id for r in cascade.judged(docs, cascade.RULES).where("__rules.failed IS NULL").collect()}
    assert {r.doc_id for r in cascade.kept(docs).collect()} == passed


def test_later_rules_are_not_asked():
    def fail(text):
        raise AssertionError("asked")

    assert cascade.first_failure(Text(b""), [Rule("first", lambda t: 1, most=0), Rule("second", fail)]) == "first"


def test_ordinary_prose_is_kept_and_junk_is_not(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice("the of river walks under old bridge morning light and then slowly".split()) + str(i % 7 or "") for i in range(90)) for _ in range(20)]
    rows = [(i, p) for i, p in enumerate(prose)] + [(100, " ".join(w + "***" for w in prose[0].split())), (101, "le " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.failed for r in cascade.judged(docs, cascade.plan(docs)).select("doc_id", "__rules.failed").collect()}
    assert all(got[i] is None for i in range(20)) and got[100] == "symbols_per_word" and got[101]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cascade.judged(docs, cascade.plan(docs)).count() == 0
