"""Fill-in-the-middle rearrangement of texts, column-wise over Arrow batches.

A text is cut into units: a run of blanks with the word behind it, or the blanks
that end the text. Two digests of the id choose how many units go to the prefix
and to the middle, two more whether and in which order the parts are written.
The units of all texts of a batch are one flat array; each unit's place within
its text decides its role, and each role's units are joined again text by text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import small_batches

SEED = 42
RATE = 50  # per cent of the texts that are rearranged
SPM_SHARE = 80  # per cent of those in the order suffix, prefix, middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = r"<[PSM]>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the digest of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> pa.LargeListArray:
    """The units of each text (binary, no nulls) as a list array over the same bytes.

    Blanks are single bytes in UTF-8, so a unit ends where a blank follows another byte, and at the end.
    """
    texts = texts.cast(pa.large_binary())
    ends_of_texts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(ends_of_texts[0]), int(ends_of_texts[-1])
    data = texts.buffers()[2]
    blank = BLANKS[np.frombuffer(data, np.uint8)[first:last]] if last > first else np.empty(0, bool)
    ends = blank.copy()  # whether a unit begins here
    ends[1:] &= ~blank[:-1]
    ends[ends_of_texts[:-1][np.diff(ends_of_texts) > 0] - first] = True
    starts = np.flatnonzero(ends)
    bounds = np.searchsorted(starts, ends_of_texts - first)
    edges = np.concatenate([starts, [last - first]]) + first
    flat = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), data]
    )
    return pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), flat)


def joined(flat: pa.Array, parents: pa.Array, keep: pa.Array, rows: int) -> pa.Array:
    """The kept units of each of ``rows`` texts, joined to one binary per text."""
    counts = np.bincount(parents.filter(keep).to_numpy(), minlength=rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, flat.filter(keep)), pa.scalar(b"", pa.large_binary()))


def rest_of(number: pa.Array, divisor: pa.Array) -> pa.Array:
    return pc.subtract(number, pc.multiply(pc.divide(number, divisor), divisor))


def rearranged(texts: pa.Array, h: list[pa.Array], rate: int, spm_share: int) -> list[pa.Array]:
    """The columns of ``SHAPE`` for a batch of texts and their four numbers."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    split = units(texts)
    n = pc.list_value_length(split)
    marked = pc.match_substring_regex(texts, MARK)
    chosen = pc.less(rest_of(h[2], pa.scalar(100, pa.int64())), rate)
    moved = pc.and_(chosen, pc.and_(pc.greater(n, 0), pc.invert(marked)))
    spm = pc.less(rest_of(h[3], pa.scalar(100, pa.int64())), spm_share)
    form = pc.if_else(moved, pc.if_else(spm, SPM, PSM), PLAIN)

    own, size = split.filter(moved), pc.sum(moved).as_py() or 0
    choices = pc.add(n, 1)
    one, two = (rest_of(x, choices).filter(moved) for x in h[:2])
    flat, parents = own.flatten(), pc.list_parent_indices(own)
    ordinal = np.arange(len(flat)) - np.asarray(own.offsets)[parents.to_numpy()] + np.asarray(own.offsets)[0]
    ordinal = pa.array(ordinal.astype(np.int64))
    early = pc.less(ordinal, pc.min_element_wise(one, two).take(parents))
    late = pc.greater_equal(ordinal, pc.max_element_wise(one, two).take(parents))
    prefix, suffix = (joined(flat, parents, keep, size) for keep in (early, late))
    middle = joined(flat, parents, pc.invert(pc.or_(early, late)), size)

    as_scalar = lambda mark: pa.scalar(mark, pa.large_binary())
    nothing = as_scalar(b"")
    glue = lambda *parts: pc.binary_join_element_wise(*parts, nothing)
    in_spm = glue(as_scalar(SUFFIX), suffix, as_scalar(PREFIX), prefix, as_scalar(MIDDLE), middle)
    in_psm = glue(as_scalar(PREFIX), prefix, as_scalar(SUFFIX), suffix, as_scalar(MIDDLE), middle)
    made = pc.if_else(spm.filter(moved), in_spm, in_psm)
    where = pa.array(np.cumsum(moved.to_numpy(zero_copy_only=False)) - 1).cast(pa.int64())
    where = pc.if_else(moved, where, pa.scalar(None, pa.int64()))  # of each text among those moved
    length = lambda part: pc.utf8_length(part.cast(pa.large_string())).cast(pa.int64())
    return [
        n.cast(pa.int64()), form.cast(pa.string()), length(prefix).take(where), length(middle).take(where),
        pc.coalesce(made.take(where), texts).cast(pa.large_string()),
    ]


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``form`` is plain (the text as it is), psm or spm; lengths are in code points
    and null for plain rows. A null text counts as empty; a text that is empty or
    holds one of the three marks stays plain. Rows of equal id get the same
    choices (a null id those of an empty one) and repeated rows come out as often
    as they go in; an empty table gives an empty result; other columns of
    ``docs``, whatever their names, play no part.
    """
    small_batches(docs.sparkSession)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers = [batch.column(f"h{i}") for i in range(4)]
                made = rearranged(batch.column("text"), numbers, rate, spm_share)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *names])

    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    drawn = given.select("*", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    return drawn.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {SHAPE}")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No cut makes a mark of its own, so the marks found are those put in."""
    parts = F.split(output, MARK)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    psm = F.concat(part(1), part(3), part(2))
    spm = F.concat(part(2), part(3), part(1))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
