"""Vocabularies, and text to ids and back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.text import pieces
from corpusloom.operators.blocks import coded_blocks, look_up_blocks, look_up_lists
from corpusloom.operators.ordering import digest_buckets, running
from corpusloom.session import staged

# Special names with their ids; words follow from FIRST_WORD_ID on.
PAD, EOT, UNK = 0, 1, 2
SPECIAL_TOKENS = (("[PAD]", PAD), ("<|endoftext|>", EOT), ("[UNK]", UNK))
FIRST_WORD_ID = 3

# Names tried in turn for the mark between documents and after a target.
DOCUMENT_END_NAMES = ("<|endoftext|>", "[EOS]", "</s>", "<eos>")
DOCUMENT_END_DEFAULT = 0
TARGET_END_NAMES = ("<|endoftext|>", "<|eot_id|>", "<eos>", "</s>")
TARGET_END_DEFAULT = 50256

BROADCAST_ROWS = 1 << 20  # a vocabulary of this size takes some 20 MB in a task
BUCKET_WORDS = 1 << 16  # words of one frequency that one task ranks, on average
DIGEST_BITS, MOST_BITS = 48, 24  # of a digest's number, and of those that may tell buckets apart
MISS_SALTS = 16  # ways in which rows that miss the broadcast head are dealt out, so that a frequent one is split


def text_blocks(df: DataFrame, text: str = "text", key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All texts split into pieces once and stored as blocks of positions.

    For :func:`build_vocab` and :func:`tokenize_corpus` over the same texts, which
    would each split them again. :func:`block_lengths` has the number of pieces.
    """
    return staged(coded_blocks(df, {"pieces": pieces(F.col(text))}, key), "text-blocks")


def block_lengths(blocks: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``key`` and ``n_pieces`` of the texts in :func:`text_blocks`; null for a null text."""
    columns = [F.col(f"__{i}").alias(k) for i, k in enumerate(key)]
    n = F.col(f"__{len(key)}")
    return blocks.select(*columns, F.when(n.isNotNull(), F.size(n)).cast("long").alias("n_pieces"))


def build_vocab(
    df: DataFrame, max_words: int | None = None, text: str = "text", blocks: DataFrame | None = None
) -> DataFrame:
    """Word-level vocabulary ``(token, id, cnt)`` by frequency; all pieces unless ``max_words`` says how many.

    Counting is pre-aggregated in the map tasks, so a frequent piece causes no
    skew. Ids are ranks: a running count over buckets of equal frequency, which
    a digest of the token, that also orders tokens of equal frequency, splits
    as far as their number asks for. With ``max_words`` the numbers of words
    between two powers of two tell first which frequencies matter, and no rarer
    word is ranked. ``blocks`` are the :func:`text_blocks` of ``df``, if they
    are there: their counts are then added up, and no text is split again.
    """
    if blocks is None:
        counted = df.select(F.explode(pieces(F.col(text))).alias("token")).groupBy("token").agg(
            F.count(F.lit(1)).alias("cnt")
        )
    else:
        counted = blocks.select(F.explode(F.arrays_zip("entries", "counts")).alias("e")).groupBy(
            F.col("e.entries").alias("token")
        ).agg(F.sum("e.counts").alias("cnt"))
    counted = staged(counted, "counts")
    rarity = -F.floor(F.log2("cnt")).cast("long")
    classes = counted.groupBy(rarity.alias("rarity")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 rows at most
    starts, total = [], 0
    for r in sorted(classes, key=lambda r: r["rarity"]):
        if max_words is None or total < max_words:
            starts.append((r["rarity"], total))
        total += r["n"]
    if max_words is not None and starts:
        counted = counted.where(rarity <= starts[-1][0])
    largest = max((r["n"] for r in classes), default=0)
    bits = min(max(0, -(-largest // BUCKET_WORDS) - 1).bit_length(), MOST_BITS)
    buckets = digest_buckets(F.col("digest"), [DIGEST_BITS - bits]) if bits else []
    ranked = running(
        counted.withColumn("digest", F.md5("token")),
        "before",
        F.lit(1).cast("long"),
        [F.desc("cnt"), F.col("digest"), F.col("token")],
        [rarity, -F.col("cnt"), *buckets],
        starts=starts,
    )
    kept = ranked if max_words is None else ranked.where(F.col("before") < max_words)
    words = kept.select("token", (F.col("before") + FIRST_WORD_ID).cast("int").alias("id"), "cnt")
    return special_rows(df).unionByName(words)


def special_rows(df: DataFrame) -> DataFrame:
    """The special tokens as vocabulary rows with count 0."""
    return df.sparkSession.createDataFrame(
        [(name, number, 0) for name, number in SPECIAL_TOKENS], "token string, id int, cnt long"
    )


def resolve_special(vocab: DataFrame, names: Sequence[str], default: int) -> DataFrame:
    """One row ``id``: that of the first name the vocabulary has, else ``default``."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("token"))
    found = vocab.where(F.col("token").isin(*names)).agg(F.min_by("id", rank).alias("id"))
    return found.select(F.coalesce("id", F.lit(default)).cast("int").alias("id"))


def one_value(vocab: DataFrame, source: str, target: str) -> DataFrame:
    """``(source, target)`` with one row per ``source``: the least ``target`` of those listed."""
    return vocab.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(target).alias(target))


def lookup(
    rows: DataFrame, vocab: DataFrame, on: str, vocab_rows: int | None = None, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join of long ``rows`` with a vocabulary on ``token`` or ``id``.

    A key that the vocabulary lists more than once has its least value. A
    vocabulary known (``vocab_rows``) or counted to stay within ``limit`` rows
    is broadcast. A larger one is split: its most frequent entries, the first
    ``limit`` ids, are broadcast, and rows that miss them go through a shuffle
    join. That join is salted, as a frequent key may still miss the head, for
    instance where the vocabulary was counted on other texts.
    """
    other = next(c for c in vocab.columns if c != on)
    single = one_value(vocab, on, other)
    if vocab_rows is None:
        vocab_rows = vocab.limit(limit + 1).count()
    if vocab_rows <= limit:
        return rows.join(F.broadcast(single), on, "left")
    frequent = single.where(F.col("id") < limit)
    if frequent.limit(limit + 1).count() > limit:  # ids that are no ranks say nothing about frequency
        frequent = frequent.where(F.lit(False))
    head = F.broadcast(frequent)
    hits = rows.join(head, on)
    salt = F.explode(F.array(*[F.lit(i) for i in range(MISS_SALTS)])).alias("__salt")
    tail = single.select(on, other, salt)
    missing = rows.where(F.col(on).isNotNull()).join(head.select(on), on, "left_anti")
    dealt = missing.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(MISS_SALTS)).cast("int"))
    misses = dealt.join(tail, [on, "__salt"], "left")
    blanks = rows.where(F.col(on).isNull()).withColumn(other, F.lit(None).cast(vocab.schema[other].dataType))
    columns = hits.columns
    return hits.unionByName(misses.select(columns)).unionByName(blanks.select(columns))


def vocab_column(vocab: DataFrame, source: str, target: str, missing, limit: int = BROADCAST_ROWS):
    """Array lookup ``source`` values -> ``target`` values as a column function, or None above ``limit`` rows.

    Rows are counted before any is fetched; repeated rows count. Whole Arrow batches are looked up at once, and no
    row leaves its partition; a join would need one row per piece and a regrouping.
    A ``source`` that is listed more than once has its least ``target``.
    """
    listed = vocab.where(F.col(source).isNotNull()).select(source, target)
    if listed.count() > limit:
        return None
    held = listed.toArrow().group_by(source).aggregate([(target, "min")])
    shared = vocab.sparkSession.sparkContext.broadcast(
        (held.column(source).combine_chunks(), held.column(f"{target}_min").combine_chunks())
    )

    @F.arrow_udf(T.ArrayType(vocab.schema[target].dataType))
    def look_up(lists: pa.Array) -> pa.Array:
        known, values = shared.value
        at = pc.index_in(lists.flatten(), value_set=known.cast(lists.type.value_type))
        found = pc.fill_null(values.take(at), missing)
        return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), found)

    return look_up


def tokenize(
    df: DataFrame,
    vocab: DataFrame,
    texts: Mapping[str, Column],
    key: Sequence[str] = ("doc_id",),
    keep: Sequence[str] = (),
    limit: int = BROADCAST_ROWS,
    first: Mapping[str, int] | None = None,
    code: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Encode text columns: ``key``, ``keep`` and one ``array<int>`` per entry of ``texts``.

    ``first`` names columns of which only so many leading ids are wanted. The
    whole text is split all the same; the other pieces just need no lookup.
    ``code`` is a :func:`vocab_column` of this vocabulary that is already there.

    With a vocabulary of up to ``limit`` rows nothing is shuffled. A larger one
    is joined by the distinct pieces of blocks of texts, see
    :mod:`corpusloom.operators.blocks`. Both ways give the same rows: keys may
    repeat, and a row that occurs more than once comes out as often.
    """
    wanted = {n: _wanted_pieces(t, (first or {}).get(n)) for n, t in texts.items()}
    code = code or vocab_column(vocab, "token", "id", UNK, limit)
    if code is not None:
        empty = F.array().cast("array<int>")
        return df.select(*key, *keep, *[F.coalesce(code(w), empty).alias(n) for n, w in wanted.items()])
    single = one_value(vocab, "token", "id")
    return look_up_lists(df, wanted, single, "token", "id", UNK, [*key, *keep], limit)


def _wanted_pieces(text: Column, first: int | None) -> Column:
    return F.slice(pieces(text), 1, first) if first else pieces(text)


def tokenize_corpus(
    df: DataFrame, vocab: DataFrame, text: str = "text", first: int | None = None, blocks: DataFrame | None = None, **options
) -> DataFrame:
    """Encode one text column into ``ids``; see :func:`tokenize`.

    ``blocks`` are the :func:`text_blocks` of ``df``, if they are there, keyed by
    ``doc_id``; the texts are then not split again, and the blocks joined whatever the vocabulary's size.
    """
    if blocks is not None:
        if first or options:
            raise ValueError("stored blocks hold whole texts by doc_id and take no options")
        single = one_value(vocab, "token", "id")
        return look_up_blocks(blocks, single, "token", "id", UNK, ["doc_id"], ["ids"], BROADCAST_ROWS)
    return tokenize(df, vocab, {"ids": F.col(text)}, first={"ids": first} if first else None, **options)


def decode_tokens(
    df: DataFrame, vocab: DataFrame, ids: str = "ids", key: Sequence[str] = ("doc_id",), limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Ids back to ``text``, tokens joined by blanks; an unknown id reads as the unknown mark."""
    unknown = dict((number, name) for name, number in SPECIAL_TOKENS)[UNK]
    name = vocab_column(vocab, "id", "token", unknown, limit)
    if name is not None:
        return df.select(*key, F.array_join(name(F.col(ids)), " ").alias("text"))
    single = one_value(vocab, "id", "token")
    named = look_up_lists(df, {"text": F.col(ids)}, single, "id", "token", unknown, list(key), limit)
    return named.select(*key, F.array_join("text", " ").alias("text"))


def doc_token_stats(df: DataFrame, by: str, n_tokens: Column) -> DataFrame:
    """Documents and token totals per group."""
    return df.select(by, n_tokens.cast("long").alias("n")).groupBy(by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n").alias("tokens"),
        F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"),
        F.avg("n").alias("mean_tokens"),
    )
