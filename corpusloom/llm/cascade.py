"""Quality rules as a short-circuit cascade.

Every rule measures a text and rejects it outside its bounds. On a bounded
sample each rule's cost (seconds per text) and selectivity (share rejected) are
estimated; rules then run by rejections per second, and a rule looks only at
the texts that no earlier rule rejected. The order changes the cost, never the
verdict, as a text is kept only if no rule rejects it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import raw, sample_texts, small_batches

# The characters and bounds that define the base measures.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTER_WORD = re.compile(rb"[^\x20\x09-\x0D]*[A-Za-z\x80-\xff][^\x20\x09-\x0D]*")
_BULLETS = (b"-", b"*", "•".encode(), "‣".encode(), "–".encode())
_ELLIPSES = (b"...", "…".encode())


class Text:
    """A whole text as UTF-8 bytes; what several rules need is computed once, when first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that have a word."""
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, _CONTINUATION + SPACE))

    @cached_property
    def symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def repeated_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeated_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def letter_words(self) -> int:
        return len(_LETTER_WORD.findall(self.data))


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of eight words found twice or more in the text.

    Windows are numbered by doubling: two equal halves make equal windows. If
    all windows of some width differ, so do all wider ones.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    width = 1
    while True:
        distinct, codes = np.unique(codes, return_inverse=True)
        if len(distinct) == len(codes):
            return 0
        if width == window:
            break
        codes = codes[:-width] * (len(distinct) + 1) + codes[width:]
        width *= 2
    twice = np.bincount(codes)[codes] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[:-window][twice] += 1
    edges[window:][twice] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


#: What a text's measures cost, in bytes or items looked at; each is paid once per text.
COSTS: dict[str, Callable[[Text], int]] = {
    "words": lambda t: len(t.data),
    "lines": lambda t: len(t.data),
    "word_chars": lambda t: len(t.data) // 4,
    "symbols": lambda t: len(t.data) // 4,
    "repeated_lines": lambda t: len(t.lines),
    "repeated_words": lambda t: 16 * len(t.words),
    "letter_words": lambda t: 2 * len(t.data),
    "each_word": lambda t: len(t.words),
    "each_line": lambda t: len(t.lines),
}
#: Measures that are reported for every text, and so are paid before any rule is asked.
REPORTED = ("words", "word_chars", "symbols", "lines", "repeated_lines", "repeated_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose measure lies outside ``[least, most]``; ``needs`` names what the measure is made of."""

    name: str
    measure: Callable[[Text], float]
    least: float = -np.inf
    most: float = np.inf
    needs: tuple[str, ...] = ("words",)

    def rejects(self, text: Text) -> bool:
        return not self.least <= self.measure(text) <= self.most

    def cost(self, text: Text, paid: set[str]) -> int:
        """Work for this text beyond what is paid already; passes over words or lines are paid anew each time."""
        return 1 + sum(COSTS[n](text) for n in self.needs if n not in paid or n.startswith("each_"))


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


RULES = (
    Rule("word_count", lambda t: len(t.words), least=LEAST_WORDS),
    Rule("repeated_words", lambda t: 100 * _share(t.repeated_words, len(t.words)), most=MOST_REPEATED, needs=("words", "repeated_words")),
    Rule("mean_word_length", lambda t: _share(t.word_chars, len(t.words)), least=2, most=15, needs=("words", "word_chars")),
    Rule("symbols_per_word", lambda t: _share(t.symbols, len(t.words)), most=0.25, needs=("words", "symbols")),
    Rule("repeated_lines", lambda t: _share(t.repeated_lines, len(t.lines)), most=0.5, needs=("lines", "repeated_lines")),
    Rule("stuttered_words", lambda t: _share(sum(map(eq, t.words, t.words[1:])), len(t.words)), most=0.2, needs=("words", "each_word")),
    Rule("words_with_letter", lambda t: _share(t.letter_words, len(t.words)), least=0.7, needs=("words", "letter_words")),
    Rule("bullet_lines", lambda t: _share(sum(x.lstrip().startswith(_BULLETS) for x in t.lines), len(t.lines)), most=0.9, needs=("lines", "each_line")),
    Rule("ellipsis_lines", lambda t: _share(sum(x.rstrip().endswith(_ELLIPSES) for x in t.lines), len(t.lines)), most=0.5, needs=("lines", "each_line")),
    Rule("longest_word", lambda t: max(map(len, t.words), default=0), most=2000, needs=("words", "each_word")),
)


def ordered(rules: Sequence[Rule], sample: Sequence[bytes], paid: Sequence[str] = REPORTED) -> list[Rule]:
    """The rules one by one: the next has the most rejections per cost among texts that all earlier ones let pass.

    A rule's cost on a text is what it needs beyond ``paid`` and what earlier
    rules have made of that text. Costs are counts of work, so that the order is
    the same on each run; of equal rules, the first listed goes first.
    """
    left, order = list(rules), []
    survivors = [(Text(data), set(paid)) for data in sample]
    while left:
        rejected = [[rule.rejects(t) for t, _ in survivors] for rule in left]
        costs = [sum(rule.cost(t, p) for t, p in survivors) for rule in left]
        best = max(range(len(left)), key=lambda i: (sum(rejected[i]) / max(costs[i], 1), -i))
        rule = left.pop(best)
        order.append(rule)
        survivors = [(t, p | set(rule.needs)) for (t, p), out in zip(survivors, rejected[best]) if not out]
    return order


def first_failure(text: Text, rules: Sequence[Rule]) -> str | None:
    """Name of the first rule that rejects the text; later rules are not asked."""
    return next((rule.name for rule in rules if rule.rejects(text)), None)


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = 300, paid: Sequence[str] = REPORTED) -> list[Rule]:
    """The rules in the order found on at most ``sample`` texts; ``paid`` as in :func:`ordered`."""
    usable = docs.where(F.length("text") > 0).select("doc_id", F.lit("all").alias("grp"))
    picked = sample_texts(docs, usable, sample, sample)
    return ordered(rules, [r["text"].encode() for r in picked], paid)


def kept(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = 300) -> DataFrame:
    """The rows of ``docs`` that no rule rejects. Nothing is measured but what a rule asks for, until one rejects.

    Null and empty texts are rejected by the word count, if that is among the rules.
    """
    small_batches(docs.sparkSession)
    order = plan(docs, rules, sample, paid=())

    @F.arrow_udf("boolean")
    def passes(column: pa.Array) -> pa.Array:
        return pa.array([first_failure(Text(data), order) is None for data in raw(column)], pa.bool_())

    return docs.where(passes("text"))


BASE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,failed:string>"


def judged(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All columns of ``docs`` and ``__rules``: the base measures and ``failed``, the rejecting rule (null: kept).

    Null and empty texts have no words and fail; repeated rows are judged alike;
    an empty table stays empty. Which of several failing rules is named depends
    on the order of ``rules``; whether one fails does not.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf(BASE)
    def measure(column: pa.Array) -> pa.Array:
        made = []
        for data in raw(column):
            t = Text(data)
            base = (len(t.words), t.word_chars, t.symbols, t.repeated_lines, t.repeated_words)
            made.append((*base, first_failure(t, rules)))
        columns = list(zip(*made)) or [()] * 6
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())]
        return pa.StructArray.from_arrays(arrays, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed"])

    return docs.withColumn("__rules", measure("text"))
