"""Array expressions over token ids and logits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IGNORE = -100  # fixed value: a label that is not scored


def fixed_width(ids: Column, width: int | Column, pad: int = 0) -> Column:
    """Cut on the right to ``width``, then pad on the right with ``pad``."""
    width = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(width - F.size(ids), F.lit(0))
    return F.concat(F.slice(ids, F.lit(1), width), F.array_repeat(F.lit(pad).cast("int"), missing))


def attention_mask(ids: Column, pad: int = 0) -> Column:
    """1 where the id is not ``pad``; a real token with that id is masked too."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def last_non_pad(ids: Column, pad: int = 0) -> Column:
    """Largest position whose id is not ``pad``, 0 if there is none."""
    marked = F.transform(ids, lambda x, i: F.when(x != pad, i).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(marked), F.lit(0))


def prepend(ids: Column, token: int) -> Column:
    return F.concat(F.array(F.lit(token).cast("int")), ids)


def checked_ids(ids: Column, bits: int, label: Column) -> Column:
    """``ids`` unchanged; an id outside ``[0, 2^bits)`` fails the job and names the row."""
    outside = F.exists(ids, lambda x: (x < 0) | (x >= F.lit(1 << bits)))
    message = F.concat(F.lit(f"id does not fit in {bits} bits, row "), label.cast("string"))
    return F.when(outside, F.raise_error(message).cast("array<int>")).otherwise(ids)


def head(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def last_n(ids: Column, n: int) -> Column:
    """The last ``n`` ids, all of them if there are fewer."""
    return F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, F.lit(n))


def cut_at(ids: Column, token: int) -> Column:
    """Ids before the first ``token``; unchanged if it is absent."""
    at = F.array_position(ids, F.lit(token).cast("int"))
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def generation_prompt(ids: Column, context: int, max_new: int) -> Column:
    """Keep room for ``max_new`` ids in the context, but at least one prompt id."""
    return head(ids, max(1, context - max_new))


def next_token_inputs(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def next_token_targets(ids: Column) -> Column:
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def argmax_class(logits: Column) -> Column:
    """Position of the largest logit, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("long")


def mask_vocab_tail(logits: Column, size: int) -> Column:
    """Logits from position ``size`` on become minus infinity."""
    return F.transform(logits, lambda x, i: F.when(i >= size, F.lit(float("-inf"))).otherwise(x))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A row-level expression used inside an array lambda would be evaluated again
    for every element, which is quadratic in the array length.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def log_normaliser(logits: Column) -> Column:
    """log(sum(exp(logits))), shifted by the maximum against overflow."""
    return bind(
        F.array_max(logits),
        lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))),
    )


def log_softmax(logits: Column) -> Column:
    return bind(log_normaliser(logits), lambda z: F.transform(logits, lambda x: x - z))


def top_classes(logits: Column, k: int) -> Column:
    """The ``k`` best ``(logp, cls)`` of a row, best first, lower class on ties."""
    ranked = F.sort_array(F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.cast("long").alias("cls"))))
    return bind(
        log_normaliser(logits),
        lambda z: F.transform(
            F.slice(ranked, 1, k), lambda s: F.struct((-s["neg"] - z).alias("logp"), s["cls"].alias("cls"))
        ),
    )


def id_digest(ids: Column) -> Column:
    """Digest of an id list, used to compare arrays across engines."""
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))
