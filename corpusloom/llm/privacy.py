"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for forms that the patterns miss.

The patterns give the base spans. The conditional random field is trained on a
small labelled table (``labelled_table``) by gradient ascent, with sums over all
paths by the forward-backward recursion, and decoded by Viterbi for many chains
at a time in numpy. A chain is a stretch of words with marks (a digit, an at
sign, or a word that spells one out) and the two words before and after it; any
other word is outside of personal data by definition. Its spans are added where
they touch no base span.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Guards and possessive parts keep long runs linear and change no match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_AT = re.compile(r"[\s(\[]at[\s)\]]")
_DOT = re.compile(r"[\s(\[]dot[\s)\]]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Every at sign with a local part before it and a dotted domain behind it, from left to right."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield "email", start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right counts double, less nine if above nine."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(doubled[v] for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then by kind."""
    if not _MARKED.search(text):
        return []
    found = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---------------------------------------------------------------- the random field

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_INDEX = {label: i for i, label in enumerate(LABELS)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CUES = frozenset("at dot call tel phone fax mobile mail email card ip server host address number no".split())
_EDGES = " .,;:!?\"'<>"
CONTEXT = 2
CHAINS_AT_ONCE = 2048
CHAIN_WORDS = 4096  # a longer chain is decoded alone, in parts of this length that hand on their scores
WORDS_AT_ONCE = 1 << 16


def shape(word: str) -> str:
    """Digits as d, lower-case letters as a, upper-case ones as A, runs with their length up to four."""
    kinds = ["d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word[:64]]
    runs: list[tuple[str, int]] = []
    for kind in kinds:
        runs = [*runs[:-1], (kind, runs[-1][1] + 1)] if runs and runs[-1][0] == kind else [*runs, (kind, 1)]
    return "".join(k if k not in "daA" else f"{k}{min(n, 4)}" for k, n in runs)


def features(word: str) -> list[str]:
    """What the field sees of a word: its shape, the shape without lengths, its digits, and cue words."""
    inner = word.strip(_EDGES + "()[]=")
    lowered, own = inner.lower(), shape(word.strip(_EDGES))
    if lowered in ("at", "dot"):
        own = shape(word.strip(_EDGES).lower())  # an address is spelled out in any case
    digits = sum(c.isdigit() for c in word)
    made = [f"s:{own}", "r:" + re.sub(r"\d", "", own), f"d:{min(digits, 20)}"]
    made += [f"at:{word.count('@')}", f"dots:{min(inner.count('.'), 4)}"]
    made.append("w:" + (lowered if lowered in _CUES else "letters" if inner.isalpha() else "other"))
    if len(word) != len(word.rstrip(_EDGES)):
        made.append("ends")
    return made


@dataclass
class Field:
    """Weights: emissions per feature for the word itself, the one before and the one after; transitions."""

    numbers: dict[str, int]
    emission: np.ndarray  # (3, features, labels)
    transition: np.ndarray  # (labels + 1, labels); the last row is the start

    def vectors(self, word: str) -> np.ndarray:
        """(3, labels): what a word adds to itself, to the word behind it and to the word before it."""
        known = [self.numbers[f] for f in features(word) if f in self.numbers]
        return self.emission[:, known].sum(axis=1)


def _shifted(vectors: np.ndarray) -> np.ndarray:
    """Emissions (..., words, labels) from word vectors (..., words, 3, labels)."""
    scores = vectors[..., 0, :].copy()
    scores[..., 1:, :] += vectors[..., :-1, 1, :]
    scores[..., :-1, :] += vectors[..., 1:, 2, :]
    return scores


def viterbi(scores: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best label paths of many chains: scores (chains, words, labels), words behind a chain's length are ignored.

    Equal paths go to the label that is listed first.
    """
    chains, words, labels = scores.shape
    best = scores[:, 0] + transition[-1]
    back = np.zeros((chains, words, labels), np.int16)
    for t in range(1, words):
        step = best[:, :, None] + transition[None, :-1]
        back[:, t] = step.argmax(axis=1)
        alive = (t < lengths)[:, None]
        best = np.where(alive, step.max(axis=1) + scores[:, t], best)
        back[:, t] = np.where(alive, back[:, t], np.arange(labels))
    path = np.zeros((chains, words), np.int16)
    path[:, -1] = best.argmax(axis=1)
    for t in range(words - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t, None], axis=1)[:, 0]
    return path


def long_path(words: Sequence[str], vectors: Callable[[str], np.ndarray], transition: np.ndarray) -> np.ndarray:
    """The path that :func:`viterbi` gives one chain, with the emissions of ``CHAIN_WORDS`` words held at a time.

    Scores and back pointers go on from part to part, so no cut changes the path.
    """
    back = np.zeros((len(words), transition.shape[1]), np.int8)
    best = transition[-1]
    for low in range(0, len(words), CHAIN_WORDS):
        first, high = max(low - 1, 0), min(low + CHAIN_WORDS, len(words))  # emissions need the word before and behind
        scores = _shifted(np.array([vectors(w) for w in words[first : high + 1]]))[low - first : high - first]
        for t, score in enumerate(scores, low):
            if t:
                step = best[:, None] + transition[:-1]
                back[t] = step.argmax(axis=0)
                best = step.max(axis=0)
            best = best + score
    path = np.zeros(len(words), np.int16)
    path[-1] = best.argmax()
    for t in range(len(words) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _logsumexp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def train(table: Sequence[tuple[list[str], list[str]]], rounds: int = 40, rate: float = 0.3, penalty: float = 2e-3) -> Field:
    """Conditional log-likelihood, maximised by full-batch gradient steps with scaled rates.

    The sentences are padded to one length, so that each round is a few array operations.
    """
    names = sorted({f for words, _ in table for w in words for f in features(w)})
    numbers = {f: i for i, f in enumerate(names)}
    width, n, k = max(len(w) for w, _ in table), len(table), len(LABELS)
    seen = np.zeros((n, width, len(names)))
    gold = np.zeros((n, width), np.int64)
    lengths = np.array([len(w) for w, _ in table])
    for i, (words, labels) in enumerate(table):
        for t, word in enumerate(words):
            seen[i, t, [numbers[f] for f in features(word)]] = 1
            gold[i, t] = _INDEX[labels[t]]
    inside = np.arange(width)[None, :] < lengths[:, None]
    before, after = np.zeros_like(seen), np.zeros_like(seen)
    before[:, 1:], after[:, :-1] = seen[:, :-1], seen[:, 1:]
    views = np.stack([seen, before, after]).reshape(3, n * width, -1)
    emission, transition = np.zeros((3, len(names), k)), np.zeros((k + 1, k))
    scale_e, scale_t = np.full_like(emission, 1e-6), np.full_like(transition, 1e-6)
    for _ in range(rounds):
        scores = sum(views[j] @ emission[j] for j in range(3)).reshape(n, width, k)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + transition[-1]
        for t in range(1, width):
            step = _logsumexp(forward[:, t - 1, :, None] + transition[None, :-1], 1) + scores[:, t]
            forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
        total = _logsumexp(forward[:, -1], 1)
        pairs = np.zeros((k + 1, k))
        for t in range(width - 1, 0, -1):
            alive = inside[:, t, None]
            behind = scores[:, t] + backward[:, t]
            joint = forward[:, t - 1, :, None] + transition[None, :-1] + behind[:, None, :] - total[:, None, None]
            pairs[:-1] += np.where(alive[:, :, None], np.exp(np.minimum(joint, 0)), 0).sum(axis=0)
            step = _logsumexp(transition[None, :-1] + behind[:, None, :], 2)
            backward[:, t - 1] = np.where(alive, step, 0)
        share = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * inside[..., None]
        pairs[-1] = share[:, 0].sum(axis=0)
        truth = np.eye(k)[gold] * inside[..., None]
        real = np.zeros((k + 1, k))
        np.add.at(real, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
        np.add.at(real, (np.full(n, k), gold[:, 0]), 1)
        error = (truth - share).reshape(n * width, k)
        change = np.stack([views[j].T @ error for j in range(3)]) - penalty * n * emission
        change_t = real - pairs - penalty * n * transition
        scale_e += change**2
        scale_t += change_t**2
        emission += rate * change / np.sqrt(scale_e)
        transition += rate * change_t / np.sqrt(scale_t)
    return Field(numbers, emission, transition)


def labelled_table(rows: int = 400, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences with personal data in plain and in unusual forms, and with other numbers.

    Built by rule from the forms below, always alike.
    """
    rng = random.Random(seed)

    def num(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name() -> str:
        return "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 9)))

    def octet() -> str:
        return str(rng.randrange(256))

    personal = (
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        ("phone", lambda: f"{num(3)}.{num(3)}.{num(4)}"), ("phone", lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}"),
        ("phone", lambda: f"+{num(2)} {num(3)} {num(4)} {num(3)}"), ("phone", lambda: f"1-{num(3)}-{num(3)}-{num(4)}"),
        ("email", lambda: f"{name()}.{num(2)}@{name()}.example.com"), ("email", lambda: f"{name()}@{name()}.org"),
        ("email", lambda: f"{name()} at {name()} dot com"), ("email", lambda: f"{name()} (at) {name()} (dot) org"),
        ("email", lambda: f"{name()}.{num(2)} [at] {name()}{num(1)} [dot] com"), ("email", lambda: f"{name()} @ {name()}.net"),
        ("ip", lambda: f"{octet()}.{octet()}.{octet()}.{octet()}"), ("ip", lambda: f"{octet()}.{octet()}.{octet()}.{octet()}:{num(4)}"),
        ("card", lambda: num(16)), ("card", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}"),
        ("card", lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}"), ("card", lambda: f"{num(4)}/{num(4)}/{num(4)}/{num(4)}"),
    )
    other = (
        lambda: num(rng.randrange(1, 9)), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: f"{num(2)}.{num(2)}", lambda: f"version {num(1)}", lambda: f"Version {num(1)}.{num(1)}.{num(1)}", lambda: f"{num(1)},{num(3)},{num(3)}",
        lambda: f"{num(4)}-{num(4)}", lambda: f"{num(2)}%", lambda: f"password={name()}{num(4)}{name()}{num(3)}",
        lambda: f'token = "{num(4)}{name()}{num(9)}{name()}{num(8)}"', lambda: f"the {num(2)}th", lambda: f"{name()} at {name()}",
        lambda: f"look at {num(3)} {name()}", lambda: f"{name()}{num(2)}", lambda: f"page {num(2)} of {num(3)}", lambda: f"({num(4)})",
        lambda: f"{num(1)} {num(1)} {num(2)}", lambda: f"dot {name()}", lambda: f"{num(3)} {num(3)}", lambda: f"§{num(2)}", lambda: f"@{name()}",
        lambda: f"#{num(5)}", lambda: f"${num(3)}.{num(2)}", lambda: f"{num(3)}/{num(4)}", lambda: f"doi:{num(2)}.{num(4)}/{num(6)}", lambda: num(rng.randrange(17, 41)),
    )
    table = []
    for row in range(rows):
        words, labels = [], []

        def add(text: str, kind: str | None = None) -> None:
            own = text.split()
            words.extend(own)
            labels.extend("O" if kind is None else f"{'BI'[i > 0]}-{kind}" for i in range(len(own)))

        for _ in range(rng.randrange(0, 4)):
            add(name() if rng.random() < 0.9 else name().capitalize() + ",")
        if row % 2:
            kind, form = personal[row // 2 % len(personal)]
            add(form() + rng.choice(["", "", ".", ","]), kind)
        else:
            add(other[row // 2 % len(other)]() + rng.choice(["", "", ".", ","]))
        for _ in range(rng.randrange(0, 4)):
            add(name())
        table.append((words, labels))
    return table


def chains(text: str) -> list[list[tuple[str, int, int]]]:
    """Stretches of marked words with their neighbours, as (word, start, end); stretches that touch are one."""
    found: list[list[tuple[str, int, int]]] = []
    current: list[tuple[str, int, int]] = []
    last = -1
    words = [(m.group(), *m.span()) for m in _WORD.finditer(text)]
    for i, (word, _, _) in enumerate(words):
        if _MARKED.search(word) or word.strip("()[]").lower() in ("at", "dot"):
            if current and i - CONTEXT > last + 1:
                found.append(current)
                current = []
            end = min(i + CONTEXT + 1, len(words))
            current += words[max(i - CONTEXT, last + 1) : end]
            last = max(last, end - 1)
    return [*found, current] if current else found


def _spans(chain: list[tuple[str, int, int]], path: np.ndarray) -> Iterator[Span]:
    """Labelled stretches of a chain, without the marks around them; an inside label after another kind begins anew."""
    open_: Span | None = None
    for (word, start, end), number in zip(chain, path):
        label = LABELS[number]
        kind = label[2:]
        if open_ and label.startswith("I-") and open_[0] == kind:
            open_ = (kind, open_[1], end - len(word) + len(word.rstrip(_EDGES)))
            continue
        if open_:
            yield open_
        lead = len(word) - len(word.lstrip(_EDGES))
        open_ = None if label == "O" else (kind, start + lead, end - len(word) + len(word.rstrip(_EDGES)))
    if open_:
        yield open_


def spelt(text: str) -> bool:
    """Whether an at and, with something between, a dot behind it are spelled out, in any case, in brackets or blanks."""
    lowered = text.lower()
    at = _AT.search(lowered)
    return at is not None and _DOT.search(lowered, at.end() + 1) is not None


def plausible(span: Span, text: str) -> bool:
    """Whether a found span has what its kind must have, whatever its form."""
    kind, start, end = span
    inner = text[start:end]
    digits = len(_digits(inner))
    if kind == "email":
        return "@" in inner[1:-1] and "." in inner or spelt(inner)
    if any(c.isalpha() for c in inner):
        return False
    if kind == "ip":
        return 4 <= digits <= 17 and inner.count(".") >= 3
    if kind == "card":
        return 12 <= digits <= 19 and luhn(_digits(inner))
    return 9 <= digits <= 15


def field_spans(field: Field, texts: Sequence[str]) -> list[list[Span]]:
    """Spans that the field finds in each text; chains of all texts are decoded together.

    A text that has no digit, no at sign and none spelled out has no plausible span.
    """
    owned = [(i, chain) for i, text in enumerate(texts) if _MARKED.search(text) or spelt(text) for chain in chains(text)]
    found: list[list[Span]] = [[] for _ in texts]
    known: dict[str, np.ndarray] = {}

    def vector(word: str) -> np.ndarray:
        if word not in known:
            if len(known) > 100_000:
                known.clear()
            known[word] = field.vectors(word)
        return known[word]

    def keep(i: int, chain: list[tuple[str, int, int]], path: np.ndarray) -> None:
        found[i] += [s for s in _spans(chain, path) if plausible(s, texts[i])]

    for i, chain in owned:
        if len(chain) > CHAIN_WORDS:
            keep(i, chain, long_path([word for word, _, _ in chain], vector, field.transition))
    owned = sorted((item for item in owned if len(item[1]) <= CHAIN_WORDS), key=lambda item: len(item[1]))
    low = 0
    while low < len(owned):
        longest = len(owned[min(low + CHAINS_AT_ONCE, len(owned)) - 1][1])  # chains of like length go together
        part = owned[low : low + max(1, min(CHAINS_AT_ONCE, WORDS_AT_ONCE // longest))]
        low += len(part)
        width = len(part[-1][1])
        vectors = np.zeros((len(part), width, 3, len(LABELS)))
        for row, (_, chain) in enumerate(part):
            for t, (word, _, _) in enumerate(chain):
                vectors[row, t] = vector(word)
        paths = viterbi(_shifted(vectors), field.transition, np.array([len(c) for _, c in part]))
        for (i, chain), path in zip(part, paths):
            keep(i, chain, path[: len(chain)])
    return found


def joined(base: Sequence[Span], more: Sequence[Span]) -> list[Span]:
    """The base spans and those others that touch none of them, by start, then by kind."""
    added = []
    for kind, start, end in more:
        if end > start and not any(start < e and s < end for _, s, e in base):
            added.append((kind, start, end))
    return sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,stop:int>>"


def find(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of ``docs`` and ``__personal``: a struct of ``base`` and ``spans``, arrays of (kind, start, stop).

    Positions count code points, the end is exclusive. Null and empty texts have
    no spans; repeated rows are treated alike; an empty table stays empty.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def spans(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        base = [base_spans(t) for t in texts]
        both = [joined(b, more) for b, more in zip(base, field_spans(field, texts))]
        arrays = [pa.array([[dict(zip(("kind", "start", "stop"), s)) for s in row] for row in rows], kind) for rows in (base, both)]
        return pa.StructArray.from_arrays(arrays, ["base", "spans"])

    return docs.withColumn("__personal", spans("text"))


def count_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def masked(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets."""

    small_batches(docs.sparkSession)

    @F.arrow_udf(T.StringType())
    def mask(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        made = []
        for text, more in zip(texts, field_spans(field, [t or "" for t in texts])):
            if text is None:
                made.append(None)
                continue
            parts, at = [], 0
            for kind, start, end in joined(base_spans(text), more):
                if start >= at:
                    parts += [text[at:start], f"[{kind}]"]
                at = max(at, end)
            made.append("".join([*parts, text[at:]]))
        return pa.array(made, pa.string())

    return docs.withColumn("text", mask("text"))
