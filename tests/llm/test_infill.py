import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import infill

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def numbers(doc_id):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain(doc_id, text):
    """The rule written out for one text."""
    text = text or ""
    cut, h = re.findall(UNIT, text), numbers(doc_id)
    n = len(cut)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_texts():
    rng = random.Random(5)
    letters = list(" \t\n\x0b\r ab<P>S é漢😀\x1f  ")
    odd = [None, "", "   ", "<P> x", "word", " word ", "<", "a<P", "<S >", "x" * 100_000, "ä b\n" * 30_000]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]


def arrays(ids):
    return [pa.array(h, pa.int64()) for h in zip(*map(numbers, ids))]


def test_every_text_equals_the_rule():
    texts = some_texts()
    made = infill.rearranged(pa.array(texts, pa.string()), arrays(range(len(texts))), infill.RATE, infill.SPM_SHARE)
    assert list(zip(*(c.to_pylist() for c in made))) == [plain(i, t) for i, t in enumerate(texts)]


def test_slices_of_a_batch():
    texts = some_texts()
    part = pa.array(texts, pa.string()).slice(40, 25)
    made = infill.rearranged(part, arrays(range(40, 65)), infill.RATE, infill.SPM_SHARE)
    assert list(zip(*(c.to_pylist() for c in made))) == [plain(i, texts[i]) for i in range(40, 65)]


def test_rates():
    texts = ["a b c d"] * 400
    forms = lambda rate, spm: infill.rearranged(pa.array(texts), arrays(range(400)), rate, spm)[1].to_pylist()
    assert set(forms(0, 80)) == {"plain"} and set(forms(100, 0)) == {"psm"} and set(forms(100, 100)) == {"spm"}


def test_frame_restores_all_texts(spark):
    texts = some_texts()
    rows = [(i if i % 50 else None, t, "x", 7) for i, t in enumerate(texts)] + [(3, texts[3], "x", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")  # names that clash
    made = infill.fill_in_middle(docs).withColumn("again", infill.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(map(repr, ((r.doc_id, *r[1:6]) for r in made))) == sorted(repr((i, *plain(i, t))) for i, t, *_ in rows)
    assert sorted(r.again for r in made) == sorted(t or "" for _, t, *_ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(docs).collect() == []
