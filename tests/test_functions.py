import hashlib
import math

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A, numbers as N, text as X


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict(recursive=True)


def ints(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def test_missing_value_reads_none(spark):
    got = one(spark, a=X.join_text(F.lit("x"), F.lit(None)), b=X.as_text(F.lit(7)), c=X.join_text(F.lit(None)))
    assert got == {"a": "x <ENDOFTEXT> None", "b": "7", "c": "None"}


def test_prompt(spark):
    got = one(spark, p=X.render_prompt(F.lit("tamil"), F.lit("Body")))
    assert got["p"] == "[LANG=tamil] Summarize the following article.\nArticle:\nBody\nSummary:\n"


def test_seeded_draw_is_the_digest(spark):
    got = one(spark, d=X.seeded_draw(42, F.lit("draw"), F.lit("en"), F.lit(3)))
    assert got["d"] == int(hashlib.md5(b"42:draw:en:3").hexdigest()[:12], 16)


def test_pieces_and_their_count(spark):
    got = one(spark, p=X.pieces(F.lit("Él tiene 12,5 €!")), n=X.piece_count(F.lit("Él tiene 12,5 €!")))
    assert got["p"] == ["Él", "tiene", "12", ",", "5", "€!"] and got["n"] == 6


def test_fixed_width_edges(spark):
    got = one(
        spark,
        cut=A.fixed_width(ints(1, 2, 3, 4), 3),
        same=A.fixed_width(ints(1, 2, 3), 3),
        padded=A.fixed_width(ints(1), 3),
        empty=A.fixed_width(ints(), 2),
    )
    assert got == {"cut": [1, 2, 3], "same": [1, 2, 3], "padded": [1, 0, 0], "empty": [0, 0]}


def test_mask_treats_real_zero_as_pad(spark):
    got = one(
        spark,
        mask=A.attention_mask(ints(5, 0, 7, 0)),
        last=A.last_non_pad(ints(5, 0, 7, 0)),
        none=A.last_non_pad(ints(0, 0)),
    )
    assert got == {"mask": [1, 0, 1, 0], "last": 2, "none": 0}


def test_cuts(spark):
    got = one(
        spark,
        before=A.cut_at(ints(4, 5, 9, 6, 9), 9),
        absent=A.cut_at(ints(4, 5), 9),
        first=A.cut_at(ints(9, 5), 9),
        tail=A.last_n(ints(1, 2, 3), 2),
        short=A.last_n(ints(1), 2),
        room=A.generation_prompt(ints(1, 2, 3), 4, 10),
        x=A.next_token_inputs(ints(1, 2, 3)),
        y=A.next_token_targets(ints(1, 2, 3)),
    )
    assert got["before"] == [4, 5] and got["absent"] == [4, 5] and got["first"] == []
    assert got["tail"] == [2, 3] and got["short"] == [1] and got["room"] == [1]
    assert got["x"] == [1, 2] and got["y"] == [2, 3]


def test_logits(spark):
    values = [1.0, 3.0, 3.0, -2.0]
    logits = F.array(*[F.lit(v) for v in values])
    got = one(
        spark, best=A.argmax_class(logits), soft=A.log_softmax(logits), top=A.top_classes(A.mask_vocab_tail(logits, 2), 2)
    )
    z = math.log(sum(math.exp(v) for v in values))
    assert got["best"] == 1
    assert all(abs(a - (v - z)) < 1e-12 for a, v in zip(got["soft"], values))
    z2 = math.log(math.exp(1) + math.exp(3))
    assert [t["cls"] for t in got["top"]] == [1, 0]
    assert abs(got["top"][0]["logp"] - (3 - z2)) < 1e-12


def test_large_logits_do_not_overflow(spark):
    got = one(spark, z=A.log_normaliser(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert abs(got["z"] - (1000 + math.log(2))) < 1e-9


def test_rounding(spark):
    n = F.col("n")
    df = spark.createDataFrame([(0,), (1,), (128,), (129,)], "n long")
    got = [tuple(r) for r in df.select(N.round_up(n, 128), N.round_up_from(n, 128), N.context_width(n)).collect()]
    assert got == [(0, 128, 0), (128, 128, 128), (128, 128, 128), (256, 256, 256)]


def test_file_label(spark):
    assert one(spark, l=X.file_label(F.lit("org/My Set")))["l"] == "my_set"
