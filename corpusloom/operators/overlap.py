"""Text overlap metrics: ROUGE-N, ROUGE-L, corpus BLEU.

Words are split by Spark. Their runs are numbered, counted and matched for a
batch of examples at a time, without a shuffle; only sums per group move.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.text import as_text

# What counts as a word for ROUGE.
WORD_PATTERN = r"[\p{L}\p{N}]+"
ASCII_WORD_PATTERN = r"[a-z0-9]+"

# The international "13a" word splitting rule for BLEU, applied in this order.
BLEU_UNESCAPE = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
BLEU_SPLITS = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
BLEU_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
BLEU_ORDER = 4

PAIR_COST, WORD_COST = 400, 4000  # steps of a bit: what a pair of equal words and a word cost in the two ways
BATCH_WORDS = 1 << 18  # words of both sides that are numbered at once, or one row's if it has more
RARE = 32  # places up to which a word's bits are set when they are needed, so that they need not be held


def rouge_words(text: Column, ascii_only: bool = False) -> Column:
    """Lower-case words; a missing text reads ``None``. ``ascii_only`` is the classic rule, blind to other scripts."""
    return F.regexp_extract_all(F.lower(as_text(text)), F.lit(ASCII_WORD_PATTERN if ascii_only else WORD_PATTERN), F.lit(0))


def bleu_words(text: Column) -> Column:
    line = as_text(text)
    for found, put in BLEU_UNESCAPE:
        line = F.replace(line, F.lit(found), F.lit(put))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, put in BLEU_SPLITS:
        line = F.regexp_replace(line, pattern, put)
    words = F.split(line, BLEU_BLANKS)
    return F.filter(words, lambda w: w != "")


def clipped_counts(predicted: pa.ListArray, expected: pa.ListArray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Per size three numbers for each row: clipped matches, runs on the left, runs on the right.

    All words of the batch are numbered once. A run of ``n`` words is the number
    of the run of ``n - 1`` before it and its last word, numbered anew, so no
    text is built and memory stays linear in the words. Runs of different rows
    have different numbers from the start.
    """
    sides = (predicted, expected)
    words = pc.dictionary_encode(pa.concat_arrays([s.flatten() for s in sides]))
    codes = pc.fill_null(words.indices, len(words.dictionary)).to_numpy().astype(np.int64)
    kinds = len(words.dictionary) + 1
    rows = [np.repeat(np.arange(len(s)), pc.fill_null(pc.list_value_length(s), 0).to_numpy()) for s in sides]
    cut, n_rows = len(rows[0]), len(predicted)
    words_of, run_of = [codes[:cut], codes[cut:]], list(rows)
    out, have = [], 0
    for n in range(1, max(sizes) + 1):
        for i, row in enumerate(rows):
            last = max(len(row) - n + 1, 0)
            run = run_of[i][:last]
            inside = row[:last] == row[n - 1 :][:last]
            # a run that leaves its row is no run; it keeps a place so that positions stay words
            run_of[i] = np.where(inside & (run >= 0), run * kinds + words_of[i][n - 1 :][:last], -1)
        distinct, at = np.unique(np.concatenate(run_of), return_inverse=True)
        missing = int(len(distinct) > 0 and distinct[0] < 0)
        at = at - missing  # -1 stays -1
        run_of = [at[: len(run_of[0])], at[len(run_of[0]) :]]
        have = len(distinct) - missing
        if n in sizes:
            valid = [run >= 0 for run in run_of]
            times = [np.bincount(run[ok], minlength=have) for run, ok in zip(run_of, valid)]
            owner = np.zeros(have, np.int64)
            for run, ok, row in zip(run_of, valid, rows):
                owner[run[ok]] = row[: len(run)][ok]
            matches = np.bincount(owner, np.minimum(*times), n_rows).astype(np.int64)
            totals = [np.bincount(row[: len(run)][ok], minlength=n_rows) for run, ok, row in zip(run_of, valid, rows)]
            out += [matches, *totals]
    return out


def row_spans(predicted: pa.ListArray, expected: pa.ListArray, words: int = BATCH_WORDS) -> list[tuple[int, int]]:
    """First and last (exclusive) rows of runs that hold about ``words`` words on both sides.

    A batch has thousands of rows however long they are; numbering takes some
    hundred bytes a word, so it goes by words.
    """
    sizes = sum(pc.fill_null(pc.list_value_length(side), 0).to_numpy().astype(np.int64) for side in (predicted, expected)) + 1
    group = (np.cumsum(sizes) - sizes) // words
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(sizes) else []
    return list(zip(map(int, starts), [*map(int, starts[1:]), len(sizes)]))


def run_counts(predicted: Column, expected: Column, sizes: Sequence[int]) -> Column:
    """Per row an array of ``(n, matches, pred_total, ref_total)`` for arrays of words; see :func:`clipped_counts`."""
    sizes = sorted(set(sizes))
    fields = ("n", "matches", "pred_total", "ref_total")

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in fields])))
    def count(p: pa.Array, r: pa.Array) -> pa.Array:
        parts = [clipped_counts(p.slice(a, b - a), r.slice(a, b - a), sizes) for a, b in row_spans(p, r)]
        made = [np.concatenate(numbers) for numbers in zip(*parts)]
        columns = [np.tile(np.array(sizes, np.int64), len(p))]
        columns += [np.stack(made[k::3], axis=1).astype(np.int64).ravel() if len(p) else np.empty(0, np.int64) for k in range(3)]
        flat = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(fields))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(sizes)), flat)

    return count(predicted, expected)


def clipped_matches(
    df: DataFrame, sizes: Sequence[int], key: str, by: str, predicted: Column, expected: Column
) -> DataFrame:
    """``(key, by, n, matches, pred_total, ref_total)``: each run counts at most as often as on the other side.

    Every row of ``df`` is an example and gives a row for each size, also if a
    text is too short for it. No row leaves its partition.
    """
    return df.select(key, by, F.inline(run_counts(predicted, expected, sizes)))


def f_measure(matches: Column, pred_total: Column, ref_total: Column) -> Column:
    """Harmonic mean of precision and recall, written without the two ratios."""
    return F.when(matches > 0, 2.0 * matches / (pred_total + ref_total)).otherwise(F.lit(0.0))


def rouge_n(
    df: DataFrame,
    sizes: Sequence[int] = (1, 2),
    key: str = "doc_id",
    by: str = "language",
    ascii_only: bool = False,
    words: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Mean F-measure per group: columns ``rouge1``, ``rouge2``, ...

    ``words`` turns a text into an array of words in another way, for instance
    with a stemmer; without it the rules of :func:`rouge_words` hold.
    """
    words = words or (lambda text: rouge_words(text, ascii_only))
    matched = clipped_matches(df, sizes, key, by, words(F.col("prediction")), words(F.col("reference")))
    scored = matched.select(by, "n", f_measure(F.col("matches"), F.col("pred_total"), F.col("ref_total")).alias("f"))
    return scored.groupBy(by).agg(*[F.avg(F.when(F.col("n") == n, F.col("f"))).alias(f"rouge{n}") for n in sizes])


def common_length(left: Sequence, right: Sequence) -> int:
    """Length of the longest common subsequence.

    What both begin and end with belongs to it, and words of one side alone do
    not matter; both are put aside. The rest goes by pairs of equal words where
    these are few, and by bits otherwise.
    """
    n = min(len(left), len(right))
    head = next((i for i in range(n) if left[i] != right[i]), n)
    tail = next((i for i in range(n - head) if left[-1 - i] != right[-1 - i]), n - head)
    left, right = left[head : len(left) - tail], right[head : len(right) - tail]
    shared = set(left) & set(right)
    left, right = [w for w in left if w in shared], [w for w in right if w in shared]
    if len(left) < len(right):
        left, right = right, left
    times = Counter(left)
    pairs = sum(times[w] for w in right)
    middle = _by_pairs(left, right) if pairs * PAIR_COST < len(right) * (len(left) + WORD_COST) else _by_bits(left, right)
    return head + middle + tail


def _by_pairs(left: Sequence, right: Sequence) -> int:
    """Hunt and Szymanski: ``ends[k]`` is the least place in ``left`` where a common subsequence of k + 1 words ends."""
    places: dict = {}
    for j in range(len(left) - 1, -1, -1):
        places.setdefault(left[j], []).append(j)
    ends: list[int] = []
    for word in right:
        for j in places[word]:  # from the last to the first, so that a word of ``right`` is used once
            at = bisect_left(ends, j)
            if at == len(ends):
                ends.append(j)
            else:
                ends[at] = j
    return len(ends)


def _by_bits(left: Sequence, right: Sequence) -> int:
    """One machine word at a time: bit ``j`` of ``open_`` is cleared once the subsequence can grow at ``left[j]``."""
    places: dict = {}
    for j, word in enumerate(left):
        places.setdefault(word, []).append(j)
    masks = {word: _mask(own, len(left)) for word, own in places.items() if len(own) > RARE}
    full = (1 << len(left)) - 1
    open_ = full
    for word in right:
        mask = masks.get(word)
        here = open_ & (mask if mask is not None else _mask(places[word], len(left)))
        open_ = ((open_ + here) | (open_ - here)) & full
    return len(left) - open_.bit_count()


def _mask(places: Sequence[int], size: int) -> int:
    bits = bytearray(size // 8 + 1)
    for j in places:
        bits[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(bits, "little")


@F.arrow_udf(T.IntegerType())
def common_subsequence(left: pa.Array, right: pa.Array) -> pa.Array:
    """Dynamic programming per pair has no built-in form, hence one Arrow function."""
    return pa.array([common_length(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.int32())


def rouge_l(
    df: DataFrame, by: str = "language", ascii_only: bool = False, words: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Mean F-measure of the longest common word subsequence: ``rougeL``; ``words`` as in :func:`rouge_n`."""
    words = words or (lambda text: rouge_words(text, ascii_only))
    worded = df.select(by, words(F.col("prediction")).alias("p"), words(F.col("reference")).alias("r"))
    measured = worded.select(by, F.size("p").alias("np"), F.size("r").alias("nr"), common_subsequence("p", "r").alias("m"))
    return measured.groupBy(by).agg(F.avg(f_measure(F.col("m"), F.col("np"), F.col("nr"))).alias("rougeL"))


def corpus_bleu(df: DataFrame, key: str = "doc_id", by: str = "language") -> DataFrame:
    """BLEU x 100 per group against one reference, with exponential smoothing."""
    sizes = range(1, BLEU_ORDER + 1)
    matched = clipped_matches(df, sizes, key, by, bleu_words(F.col("prediction")), bleu_words(F.col("reference")))
    sums = matched.groupBy(by).agg(
        *[F.sum(F.when(F.col("n") == n, F.col("matches"))).alias(f"m{n}") for n in sizes],
        *[F.sum(F.when(F.col("n") == n, F.col("pred_total"))).alias(f"t{n}") for n in sizes],
        F.sum(F.when(F.col("n") == 1, F.col("ref_total"))).alias("ref_len"),
    )
    return sums.select(by, bleu_score(sizes).alias("bleu"))


def bleu_score(sizes: Sequence[int]) -> Column:
    """From columns ``m1..m4`` (matches), ``t1..t4`` (totals) and ``ref_len``.

    An order without a match counts as 1 / 2^k of one match, k being how many
    such orders came before it, itself included. The score is 0 if nothing
    matches at all or a text is too short for the highest order.
    """
    smoothed = []
    for n in sizes:
        misses = sum((F.when(F.col(f"m{k}") == 0, 1).otherwise(0) for k in range(1, n)), F.lit(1))
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        smoothed.append(F.log(F.when(m > 0, m.cast("double")).otherwise(F.pow(F.lit(0.5), misses)) / F.nullif(t, F.lit(0))))
    mean_log = sum(smoothed[1:], smoothed[0]) / len(smoothed)
    brevity = F.when(F.col("t1") < F.col("ref_len"), 1.0 - F.col("ref_len") / F.nullif(F.col("t1"), F.lit(0))).otherwise(F.lit(0.0))
    any_match = sum((F.col(f"m{n}") for n in sizes), F.lit(0)) > 0
    long_enough = F.col(f"t{max(sizes)}") > 0
    return F.when(any_match & long_enough, 100.0 * F.exp(mean_log + brevity)).otherwise(F.lit(0.0))
