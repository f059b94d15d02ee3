"""The same answers as :mod:`queries`, written for DuckDB on the same tables.

The statements are formulated on their own: token by token, by pairing and by
plain windows, where the Spark side uses slices, buckets and arithmetic.
"""

from __future__ import annotations

from corpusloom.operators.permutation import FACTORS, MIDDLE, round_keys  # fixed values of the shuffle

RE = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def draw(key: str, seed: int = 42) -> str:
    return f"('0x'||substr(md5('{seed}:'||{key}),1,12))::BIGINT"


def digest(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def shuffled(source: str, columns: str, index: str, n: str, seed: int = 42) -> str:
    """``columns`` and ``out_pos``, the place of number ``index`` of ``n``: round by round, walking on until it is below n."""
    low = (1 << 32) - 1
    rounds = f"""SELECT *, x % a AS l, x // a AS r FROM (SELECT *, (n + a - 1) // a AS b FROM
        (SELECT *, greatest(ceil(sqrt(n)), 1)::BIGINT AS a FROM walk WHERE turn = 0 OR x >= n))"""
    for i, key in enumerate(round_keys(seed)):
        own, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        mixed = f"({other} + {key})"
        for factor in FACTORS:
            mixed = f"((({mixed} & {low}) * {factor}) >> {MIDDLE})"
        rounds = f"SELECT * REPLACE (({own} + ({mixed} & {low})) % {size} AS {own}) FROM ({rounds})"
    return f"""(
        WITH RECURSIVE walk AS (
          SELECT {columns}, ({index})::BIGINT AS x, ({n})::BIGINT AS n, 0 AS turn FROM {source}
          UNION ALL SELECT {columns}, l + r * a, n, turn + 1 FROM ({rounds}))
        SELECT {columns}, x AS out_pos FROM walk WHERE turn > 0 AND x < n)"""


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (needs, body.strip())


def sql(main: str, *needs: str) -> str:
    """Put the needed views in front of ``main``, each once, in order of use."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTE[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return main.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + main.strip()


# --- corpus -------------------------------------------------------------------

cte("split_docs", f"SELECT doc_id, lang, regexp_extract_all(text, '{RE}') AS p FROM documents")
cte("words", "SELECT token, count(*) AS cnt FROM (SELECT unnest(p) AS token FROM split_docs) GROUP BY token", "split_docs")
cte(
    "vocab",
    """
    SELECT token, (r + 2)::INTEGER AS id, cnt FROM
      (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, md5(token), token) AS r FROM words)
    UNION ALL SELECT * FROM (VALUES ('[PAD]', 0::INTEGER, 0::BIGINT), ('<|endoftext|>', 1, 0), ('[UNK]', 2, 0)) v(token, id, cnt)
    """,  # fixed values: the special names
    "words",
)
cte(
    "plain_ids",
    """
    SELECT d.doc_id, coalesce(x.ids, []::INTEGER[]) AS ids FROM split_docs d LEFT JOIN
      (SELECT doc_id, list(coalesce(v.id, 2) ORDER BY pos) AS ids
       FROM (SELECT doc_id, unnest(p) AS token, generate_subscripts(p, 1) AS pos FROM split_docs) t
       LEFT JOIN vocab v USING (token) GROUP BY doc_id) x USING (doc_id)
    """,
    "split_docs",
    "vocab",
)
cte(
    "placed",
    """
    SELECT doc_id, ids, len(ids) AS n, (sum(len(ids)) OVER (ORDER BY doc_id) - len(ids))::BIGINT AS start_pos
    FROM (SELECT doc_id, list_prepend(1, ids) AS ids FROM plain_ids)
    """,
    "plain_ids",
)
cte(
    "stream",
    """
    SELECT doc_id, start_pos + i - 1 AS pos, ids[i] AS id
    FROM (SELECT doc_id, start_pos, ids, unnest(range(1, n + 1)) AS i FROM placed)
    """,
    "placed",
)
cte(
    "shard_rows",
    """
    SELECT doc_id, pos // 50000 AS shard, pos % 50000 AS p, id,
      CASE WHEN pos < 50000 THEN 'val' ELSE 'train' END AS split,
      printf('data_%s_%06d.bin', CASE WHEN pos < 50000 THEN 'val' ELSE 'train' END, (pos // 50000)::BIGINT) AS file
    FROM stream
    """,
    "stream",
)
cte("shard_totals", "SELECT file, count(*) AS tokens FROM shard_rows GROUP BY file", "shard_rows")
cte(
    "seq_rows",
    """
    SELECT seq, p, id, sum((id = 1)::INTEGER) OVER (PARTITION BY seq ORDER BY p)::BIGINT AS doc_no
    FROM (SELECT pos // 4096 AS seq, pos % 4096 AS p, id FROM stream)
    """,
    "stream",
)
cte(
    "blocks",
    """
    SELECT seq, (p // 128)::INTEGER AS block, min_by(doc_no, p) AS doc_low, max_by(doc_no, p) AS doc_high
    FROM seq_rows GROUP BY ALL
    """,
    "seq_rows",
)
cte(
    "block_pairs",
    """
    SELECT q.seq, q.block AS q, k.block AS k,
      q.block >= k.block AND q.doc_low <= k.doc_high AND q.doc_high >= k.doc_low AS any_,
      q.block > k.block AND q.doc_low = k.doc_high AND q.doc_high = k.doc_low AS full_
    FROM blocks q JOIN blocks k ON q.seq = k.seq
    """,
    "blocks",
)

# --- shaped inputs ------------------------------------------------------------

cte(
    "ex_cls",
    """
    SELECT d.doc_id, d.lang AS language, d.text, l.quality::BIGINT AS label FROM documents d JOIN labels l USING (doc_id)
    """,
)
cte(
    "ex_pair",
    """
    SELECT conv_id, turn, premise, hypothesis FROM
      (SELECT conv_id, turn, role, text AS premise, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hypothesis
       FROM conversations) WHERE role = 'user'
    """,
)
cte(
    "ex_sft",
    f"""
    SELECT doc_id, lang AS language,
      CASE {draw("'split:'||doc_id")} % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
      text, split_part(text, chr(10), 1) AS summary
    FROM documents
    """,
)
cte(
    "pred_long",
    f"""
    SELECT e.vec_id AS ex_id, e.label::BIGINT AS label, c.cls,
      ({draw("'logit:'||e.vec_id||':'||c.cls")} % 1000)::DOUBLE / 100.0 + CASE WHEN c.cls = e.label THEN 4.0 ELSE 0.0 END::DOUBLE AS logit
    FROM embeddings e CROSS JOIN (SELECT DISTINCT label::BIGINT AS cls FROM embeddings) c
    """,
)
cte(
    "pred",
    """
    SELECT ex_id, label, cls AS pred FROM
      (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY logit DESC, cls) AS r FROM pred_long) WHERE r = 1
    """,
    "pred_long",
)
cte(
    "losses",
    """
    SELECT ex_id, z - logit AS loss
    FROM (SELECT ex_id, label, cls, logit, ln(sum(exp(logit)) OVER (PARTITION BY ex_id)) AS z FROM pred_long) WHERE cls = label
    """,
    "pred_long",
)
cte(
    "gen",
    """
    SELECT doc_id, lang AS language, array_to_string(p, ' ') AS reference,
      array_to_string(list_filter(p, lambda x, i: (i - 1 + doc_id) % 5 <> 0), ' ') AS prediction
    FROM split_docs
    """,
    "split_docs",
)
cte(
    "runs",
    """
    SELECT run, CASE run % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'ipa_stripped' ELSE 'romanized' END AS representation,
      CASE WHEN run < 3 THEN 'small' ELSE 'medium' END AS size, step, value AS train_loss,
      CASE WHEN step % 25 = 0 THEN value END AS val_loss, value::DECIMAL(10,4)::DOUBLE AS written
    FROM (SELECT user_id % 6 AS run, value, row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS step FROM events)
    """,
)
cte(
    "class_sums",
    """
    SELECT c.cls, sum((label = c.cls AND pred = c.cls)::INTEGER) AS tp, sum((label = c.cls)::INTEGER) AS support,
      sum((pred = c.cls)::INTEGER) AS predicted
    FROM pred CROSS JOIN (SELECT label AS cls FROM pred UNION SELECT pred FROM pred) c GROUP BY c.cls
    """,
    "pred",
)
cte(
    "class_scores",
    """
    SELECT cls AS label, support, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1,
      CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END AS f2
    FROM (SELECT cls, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
                 CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM class_sums)
    """,
    "class_sums",
)
cte(
    "cls_ids",
    """
    SELECT e.doc_id, e.label, (i.ids || list_transform(range(128), lambda x: 0::INTEGER))[1:128] AS ids
    FROM ex_cls e JOIN plain_ids i USING (doc_id)
    """,
    "ex_cls",
    "plain_ids",
)
# fixed values: the prompt text, here and in ``prompts``
cte(
    "prompt_pieces",
    f"""
    SELECT doc_id, language, split, regexp_extract_all('[LANG='||language||'] Summarize the following article.'||chr(10)
      ||'Article:'||chr(10)||text||chr(10)||'Summary:'||chr(10), '{RE}') AS p, regexp_extract_all(summary, '{RE}') AS t
    FROM ex_sft
    """,
    "ex_sft",
)


def _ids_of(column: str) -> str:
    return f"""(SELECT doc_id, list(coalesce(v.id, 2) ORDER BY pos) AS {column}_ids FROM
       (SELECT doc_id, unnest({column}) AS token, generate_subscripts({column}, 1) AS pos FROM prompt_pieces) x
       LEFT JOIN vocab v USING (token) GROUP BY doc_id)"""


cte(
    "prompt_ids",
    f"""
    SELECT doc_id, language, split, coalesce(p_ids, []::INTEGER[]) AS p_ids, coalesce(t_ids, []::INTEGER[]) AS t_ids
    FROM prompt_pieces LEFT JOIN {_ids_of("p")} USING (doc_id) LEFT JOIN {_ids_of("t")} USING (doc_id)
    """,
    "prompt_pieces",
    "vocab",
)
cte(
    "packed",
    """
    SELECT doc_id, language, split, goal, p_ids[1:256 - len(goal)] AS cut,
      list_transform(p_ids[1:256 - len(goal)], lambda x: -100) AS ignored
    FROM (SELECT *, list_append(t_ids[1:32], 1) AS goal FROM prompt_ids) WHERE len(goal) < 256
    """,
    "prompt_ids",
)
cte(
    "ranked_docs",
    "SELECT doc_id, language, split, row_number() OVER (PARTITION BY language ORDER BY doc_id) - 1 AS row_index FROM ex_sft",
    "ex_sft",
)


def balanced(source: str) -> str:
    """Rows ``(language, draw, doc_id)`` of a balanced mix of ``source``."""
    pick = draw("'draw:'||s.language||':'||d.draw")
    return f"""
    SELECT s.language, d.draw, r.doc_id
    FROM (SELECT language, count(*) AS n, max(count(*)) OVER () AS m FROM {source} GROUP BY language) s,
      LATERAL (SELECT unnest(range(s.m)) AS draw) d
    JOIN (SELECT doc_id, language, row_number() OVER (PARTITION BY language ORDER BY doc_id) - 1 AS i FROM {source}) r
      ON r.language = s.language AND r.i = CASE WHEN s.n = s.m THEN d.draw ELSE {pick} % s.n END
    """


cte("mixed", balanced("ex_sft"), "ex_sft")
# packs with keys that count from 0 in each language
cte(
    "train_packs",
    """
    SELECT p.language, p.cut, p.goal, r.row_index AS doc_id FROM packed p JOIN ranked_docs r USING (doc_id) WHERE p.split = 'train'
    """,
    "packed",
    "ranked_docs",
)
cte("mixed_train", balanced("train_packs"), "train_packs")
cte(
    "kept_train",
    """
    SELECT *, row_number() OVER (ORDER BY md5('42:'||language||':'||draw), language, draw) - 1 AS out_pos
    FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY md5('42:'||language||':'||draw), draw) AS r,
            count(*) OVER (PARTITION BY language) AS n FROM mixed_train)
    WHERE r <= greatest(1, floor(n * 0.3::DOUBLE))
    """,
    "mixed_train",
)


def word_groups(words: str, sizes: int) -> str:
    """Matches and totals per example and run length; ``words`` gives (doc_id, language, p, r)."""
    def side(column: str, flag: str) -> str:
        return f"""SELECT doc_id, n, array_to_string({column}[i:i + n - 1], ' ') AS gram, {flag}
          FROM (SELECT doc_id, n, {column}, unnest(range(1, len({column}) - n + 2)) AS i
                FROM {words}, (SELECT unnest(range(1, {sizes} + 1)) AS n))"""

    return f"""
    SELECT w.doc_id, w.language, s.n, coalesce(m.matches, 0) AS matches, coalesce(m.np, 0) AS np, coalesce(m.nr, 0) AS nr
    FROM {words} w CROSS JOIN (SELECT unnest(range(1, {sizes} + 1)) AS n) s
    LEFT JOIN (SELECT doc_id, n, sum(least(a, b)) AS matches, sum(a) AS np, sum(b) AS nr
      FROM (SELECT doc_id, n, gram, sum(a) AS a, sum(b) AS b FROM
        ({side("p", "1 AS a, 0 AS b")} UNION ALL {side("r", "0 AS a, 1 AS b")}) GROUP BY doc_id, n, gram)
      GROUP BY doc_id, n) m ON m.doc_id = w.doc_id AND m.n = s.n
    """


WORD, ASCII_WORD = r"[\p{L}\p{N}]+", "[a-z0-9]+"
for name, pattern in (("rouge_words", WORD), ("ascii_words", ASCII_WORD)):
    cte(
        name,
        f"""SELECT doc_id, language, regexp_extract_all(lower(prediction), '{pattern}') AS p,
            regexp_extract_all(lower(reference), '{pattern}') AS r FROM gen""",
        "gen",
    )
cte("rouge_groups", word_groups("rouge_words", 2), "rouge_words")
cte("ascii_groups", word_groups("ascii_words", 3), "ascii_words")


def f_scores(groups: str, sizes: int) -> str:
    means = ", ".join(
        f"avg(CASE WHEN matches > 0 THEN 2 * (matches / np) * (matches / nr) / (matches / np + matches / nr) ELSE 0 END)"
        f" FILTER (WHERE n = {k}) AS rouge{k}"
        for k in range(1, sizes + 1)
    )
    return f"SELECT language, {means} FROM {groups} GROUP BY language"


cte("rouge_scores", f_scores("rouge_groups", 2), "rouge_groups")
cte("ascii_scores", f_scores("ascii_groups", 3), "ascii_groups")


def bleu_words(text: str) -> str:
    line = text
    for found, put in (("'<skipped>'", "''"), ("'-'||chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                       ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        line = f"replace({line}, {found}, {put})"
    line = f"(' '||{line}||' ')"
    for pattern, put in (
        (r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        line = f"regexp_replace({line}, '{pattern}', '{put}', 'g')"
    return rf"regexp_extract_all({line}, '[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+')"


cte(
    "bleu_words",
    f"SELECT doc_id, language, {bleu_words('prediction')} AS p, {bleu_words('reference')} AS r FROM gen",
    "gen",
)
cte("bleu_groups", word_groups("bleu_words", 4), "bleu_words")
cte(
    "bleu_sums",
    """
    SELECT language, n, sum(matches) AS m, sum(np) AS t, sum(nr) FILTER (WHERE n = 1) AS ref_len
    FROM bleu_groups GROUP BY language, n
    """,
    "bleu_groups",
)
BLEU = """
    SELECT language, CASE WHEN sum(m) > 0 AND min(t) > 0 THEN 100 * exp(avg(ln(CASE WHEN m > 0 THEN m ELSE 0.5 ** misses END / t)))
      * CASE WHEN max(t) < max(ref_len) THEN exp(1 - max(ref_len) / max(t)) ELSE 1 END ELSE 0 END AS bleu
    FROM (SELECT *, sum((m = 0)::INTEGER) OVER (PARTITION BY language ORDER BY n) AS misses FROM {sums})
    GROUP BY language
    """
cte("bleu_scores", BLEU.format(sums="bleu_sums"), "bleu_sums")
# A prediction is its reference with pieces left out, so that all its words, in order, are the longest common subsequence.
cte(
    "lcs_scores",
    """
    SELECT language, avg(CASE WHEN m > 0 THEN 2 * (m / np) * (m / nr) / (m / np + m / nr) ELSE 0 END) AS rougeL
    FROM (SELECT language, len(p) AS np, len(r) AS nr, len(p) AS m FROM rouge_words) GROUP BY language
    """,
    "rouge_words",
)


cte("evals", "SELECT run, step, val_loss FROM runs WHERE val_loss IS NOT NULL", "runs")
cte(
    "improvements",
    """
    SELECT run, step, val_loss, prev_best FROM (SELECT *, min(val_loss) OVER
      (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM evals)
    WHERE prev_best IS NULL OR val_loss < prev_best
    """,
    "evals",
)
BEST = sql("SELECT run, step, val_loss, prev_best FROM improvements", "improvements")

cte(
    "drawn",
    f"""
    SELECT k.draw // 16 AS batch, r.label, r.pred, r.loss FROM (SELECT unnest(range(640)) AS draw) k
    JOIN (SELECT label, pred, loss, row_number() OVER (ORDER BY ex_id) - 1 AS i, count(*) OVER () AS n
          FROM pred JOIN losses USING (ex_id)) r
      ON r.i = {draw("'draw:'||k.draw")} % r.n
    """,
    "pred",
    "losses",
)
cte(
    "language_loss",
    """
    SELECT language, count(*) AS num_tokens, -avg(ln((cnt + 1) / (SELECT sum(cnt) + count(*) FROM vocab))) AS loss
    FROM (SELECT language, unnest(goal) AS id FROM packed) JOIN vocab USING (id) GROUP BY language
    """,
    "packed",
)
cte(
    "language_scores",
    """
    SELECT g.language, g.n AS num_examples, rouge1, rouge2, rougeL, bleu
    FROM (SELECT language, count(*) AS n FROM gen GROUP BY language) g
    JOIN rouge_scores USING (language) JOIN lcs_scores USING (language) JOIN bleu_scores USING (language)
    """,
    "rouge_scores",
    "lcs_scores",
    "bleu_scores",
)
# the first rows of each language, and the same scores for these alone
cte(
    "first_docs",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY language ORDER BY doc_id) AS r FROM ex_sft) WHERE r <= 100",
    "ex_sft",
)
cte(
    "first_groups",
    "SELECT 'rouge' AS kind, * FROM rouge_groups UNION ALL SELECT 'bleu', * FROM bleu_groups",
    "rouge_groups",
    "bleu_groups",
)
cte(
    "first_rouge",
    f_scores("(SELECT * FROM first_groups WHERE kind = 'rouge' AND doc_id IN (FROM first_docs))", 2),
    "first_groups",
    "first_docs",
)
cte(
    "first_lcs",
    """
    SELECT language, avg(CASE WHEN len(p) > 0 THEN 2 * (len(p) / len(r)) / (1 + len(p) / len(r)) ELSE 0 END) AS rougeL,
      count(*) AS num_examples
    FROM rouge_words WHERE doc_id IN (FROM first_docs) GROUP BY language
    """,
    "rouge_words",
    "first_docs",
)
cte(
    "first_bleu_sums",
    """
    SELECT language, n, sum(matches) AS m, sum(np) AS t, sum(nr) FILTER (WHERE n = 1) AS ref_len
    FROM first_groups WHERE kind = 'bleu' AND doc_id IN (FROM first_docs) GROUP BY language, n
    """,
    "first_groups",
    "first_docs",
)
cte("first_bleu", BLEU.format(sums="first_bleu_sums"), "first_bleu_sums")
cte(
    "first_loss",
    """
    SELECT language, -avg(ln((cnt + 1) / (SELECT sum(cnt) + count(*) FROM vocab))) AS loss
    FROM (SELECT language, unnest(goal) AS id FROM packed WHERE doc_id IN (FROM first_docs)) JOIN vocab USING (id) GROUP BY language
    """,
    "packed",
    "first_docs",
)
cte(
    "all_scores",
    """
    SELECT * FROM first_lcs JOIN first_rouge USING (language) JOIN first_bleu USING (language) JOIN first_loss USING (language)
    """,
    "first_lcs",
    "first_rouge",
    "first_bleu",
    "first_loss",
)
cte(
    "scored_sets",
    """
    SELECT dataset, doc_id, label, (CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END)::BIGINT AS pred
    FROM (SELECT s.dataset, i.doc_id, CASE s.dataset WHEN 'quality' THEN l.quality ELSE l.toxic END::BIGINT AS label,
            list_sum(ids[1:128]) % 97 AS a, list_sum(ids[1:128]) * 2 % 97 AS b, list_sum(ids[1:128]) * 3 % 97 AS c
          FROM cls_ids i JOIN labels l USING (doc_id) CROSS JOIN (VALUES ('quality'), ('toxic')) s(dataset))
    """,
    "cls_ids",
)
FORMS = {
    "text": "{}",
    "ipa_stripped": r"regexp_replace({}, '[^\p{{L}}\s]', '', 'g')",
    "romanized": "translate({}, 'àáâäçèéêëíñóôöùúûü', 'aaaaceeeeinooouuuu')",
}
SHUFFLE = "row_number() OVER (ORDER BY md5('42:'||doc_id), doc_id) - 1"

SCHEDULED = """(SELECT file, (tokens - 1) // 2048 AS batches, row_number() OVER (ORDER BY file) - 1 AS i, count(*) OVER () AS m
  FROM shard_totals WHERE file LIKE 'data_train%' AND tokens > 2048)"""


TWINS: dict[str, str] = {
    "vocab_top": sql("SELECT token, id, cnt FROM vocab WHERE id < 50003", "vocab"),
    "vocab_all": sql("SELECT token, id, cnt FROM vocab", "vocab"),
    "doc_token_stats": sql(
        """SELECT lang, count(*) AS docs, sum(len(p))::BIGINT AS tokens, min(len(p)) AS min_tokens, max(len(p)) AS max_tokens,
           round(avg(len(p)), 6) AS mean_tokens FROM split_docs GROUP BY lang""",
        "split_docs",
    ),
    "encoded_docs": sql(f"SELECT doc_id, n AS n_ids, {digest('ids')} AS ids_md5 FROM placed", "placed"),
    "decoded_docs": sql(
        """SELECT d.doc_id, md5(coalesce(x.text, '')) AS text_md5 FROM documents d LEFT JOIN
           (SELECT doc_id, string_agg(v.token, ' ' ORDER BY pos) AS text
            FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM plain_ids) t
            JOIN vocab v USING (id) GROUP BY doc_id) x USING (doc_id)""",
        "plain_ids",
    ),
    "special_ids": sql(
        """SELECT rule, coalesce((SELECT v.id FROM vocab v JOIN (SELECT unnest(names) AS token, generate_subscripts(names, 1) AS k) c
             USING (token) ORDER BY k LIMIT 1), dflt)::INTEGER AS id
           FROM (VALUES ('first_name', ['the', 'de'], 0), ('second_name', ['[none]', 'und', 'que'], 50256),
                        ('absent_name', ['[none]', '[neither]'], 50256)) r(rule, names, dflt)""",
        "vocab",
    ),
    "token_offsets": sql("SELECT doc_id, start_pos, start_pos + n AS end_pos FROM placed", "placed"),
    "shard_pieces": sql(
        "SELECT shard, split, doc_id, min(p) AS lo, max(p) + 1 AS hi FROM shard_rows GROUP BY shard, split, doc_id", "shard_rows"
    ),
    "shard_counts": sql("SELECT file, sum(tokens)::BIGINT AS tokens FROM shard_totals GROUP BY ROLLUP (file)", "shard_totals"),
    "shard_summary": sql(
        """SELECT file, split, count(DISTINCT doc_id) AS docs, count(*) AS tokens, sum((id = 2)::INTEGER)::BIGINT AS unknown,
           sum(id::BIGINT * (p % 1009))::BIGINT AS checksum FROM shard_rows GROUP BY file, split""",
        "shard_rows",
    ),
    "iteration_plan": sql(
        """SELECT tokens, 3 AS epochs, tokens * 3 AS total_tokens, round_even(tokens * 3 / 8192, 0)::BIGINT AS iterations
           FROM (SELECT coalesce(sum(tokens), 0)::BIGINT AS tokens FROM shard_totals WHERE file LIKE 'data_train%')""",
        "shard_totals",
    ),
    "train_batches": sql(
        f"""SELECT file, batch, rank, first_pos, {digest('ids[1:512]')} AS inputs_md5, {digest('ids[2:513]')} AS targets_md5
           FROM (SELECT w.file, w.batch, w.rank, w.first_pos, list(s.id ORDER BY s.p) AS ids
             FROM (SELECT file, batch, rank::INTEGER AS rank, batch * 2048 + rank * 512 AS first_pos FROM
                    (SELECT file, batch, unnest(range(4)) AS rank FROM
                      (SELECT file, unnest(range((tokens - 1) // 2048)) AS batch FROM shard_totals))) w
             JOIN shard_rows s ON s.file = w.file AND s.p BETWEEN w.first_pos AND w.first_pos + 512
             GROUP BY ALL)""",
        "shard_totals",
    ),
    "doc_segments": sql(
        """SELECT seq, doc_no, min(p)::INTEGER AS first_pos, count(*)::INTEGER AS tokens FROM seq_rows GROUP BY seq, doc_no""",
        "seq_rows",
    ),
    "block_ranges": sql("SELECT seq, block, doc_low, doc_high FROM blocks", "blocks"),
    "block_overlap": sql(
        """SELECT seq, q_block, partial_n, full_n, partial_from, partial_to, full_from,
             least(partial_n, greatest(8 - full_n, 1)) AS partial_kept, least(full_n, 7) AS full_kept
           FROM (SELECT seq, q AS q_block, count(*) FILTER (WHERE any_ AND NOT full_) AS partial_n,
                   count(*) FILTER (WHERE any_ AND full_) AS full_n,
                   (min(k) FILTER (WHERE any_ AND NOT full_ AND k < q))::BIGINT AS partial_from,
                   (max(k) FILTER (WHERE any_ AND NOT full_ AND k < q))::BIGINT AS partial_to,
                   (min(k) FILTER (WHERE any_ AND full_))::BIGINT AS full_from
                 FROM block_pairs GROUP BY seq, q)""",
        "block_pairs",
    ),
    "file_plan": sql(
        f"""SELECT epoch::INTEGER AS epoch, out_pos AS rank, file
           FROM {shuffled("(SELECT file, row_number() OVER (ORDER BY file) - 1 AS i, count(*) OVER () AS m FROM shard_totals)", "file", "i", "m")},
             (SELECT unnest(range(3)) AS epoch)""",
        "shard_totals",
    ),
    "batch_schedule": sql(
        f"""SELECT before + b.batch AS step, epoch::INTEGER AS epoch, f.file, b.batch, b.rank, b.inputs_md5
           FROM (SELECT epoch, file, sum(batches) OVER (ORDER BY epoch, out_pos) - batches AS before
                 FROM (SELECT unnest(range(3)) AS epoch, file, batches, out_pos FROM {shuffled(SCHEDULED, "file, batches", "i", "m")})) f
           JOIN (SELECT file, batch, rank, {digest('ids[1:512]')} AS inputs_md5
             FROM (SELECT w.file, w.batch, w.rank, list(s.id ORDER BY s.p) AS ids
               FROM (SELECT file, batch, rank::INTEGER AS rank, batch * 2048 + rank * 512 AS first_pos FROM
                      (SELECT file, batch, unnest(range(4)) AS rank FROM
                        (SELECT file, unnest(range((tokens - 1) // 2048)) AS batch FROM shard_totals))) w
               JOIN shard_rows s ON s.file = w.file AND s.p BETWEEN w.first_pos AND w.first_pos + 512
               GROUP BY ALL)) b ON b.file = f.file""",
        "shard_totals",
    ),
    "shard_slice": sql(
        """SELECT shard::INTEGER AS shard_index, count(*) AS tokens, sum(id)::BIGINT AS id_sum FROM shard_rows
           WHERE shard BETWEEN 2 AND 4 GROUP BY shard""",
        "shard_rows",
    ),
    "numbered_docs": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, md5(text) AS text_md5 FROM documents",
    "shard_roundtrip": sql(
        """SELECT file, split, count(*) AS tokens, min_by(id, p) AS first_id, max_by(id, p) AS last_id, sum(id)::BIGINT AS id_sum
           FROM shard_rows GROUP BY file, split""",
        "shard_rows",
    ),
    "joined_text": sql(
        """SELECT conv_id, turn, md5(coalesce(premise, 'None')||' <ENDOFTEXT> '||coalesce(hypothesis, 'None')) AS text_md5 FROM ex_pair""",
        "ex_pair",
    ),
    "fixed_width": sql(
        f"""SELECT doc_id, {digest('ids')} AS ids_md5, len(list_filter(ids, lambda x: x <> 0)) AS mask_sum,
            coalesce(list_max(list_filter(range(len(ids)), lambda i: ids[i + 1] <> 0)), 0)::BIGINT AS last_idx FROM cls_ids""",
        "cls_ids",
    ),
    "example_files": sql(f"SELECT doc_id, label, {digest('ids')} AS ids_md5 FROM cls_ids", "cls_ids"),
    "class_weights": sql(
        """SELECT label, n, round(CASE WHEN n > 0 THEN 100 * n / total ELSE 0 END, 6)::DOUBLE AS pct,
             round(CASE WHEN n > 0 THEN total / (3 * n) ELSE 0 END, 6)::DOUBLE AS weight
           FROM (SELECT c.label, count(e.doc_id) AS n, (SELECT count(*) FROM ex_cls) AS total
                 FROM (SELECT unnest(range(3)) AS label) c LEFT JOIN ex_cls e USING (label) GROUP BY c.label)""",
        "ex_cls",
    ),
    "class_distribution": """SELECT label::BIGINT AS label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM embeddings), 6)::DOUBLE AS pct
        FROM embeddings GROUP BY label""",
    "example_plan": sql(
        """SELECT examples, max_iters, floor(max_iters * 0.1::DOUBLE)::BIGINT AS warmup, floor(max_iters * 0.9::DOUBLE)::BIGINT AS decay
           FROM (SELECT count(*) AS examples, (ceil(count(*) * 128 / (2 * 16 * 128)) * 3)::BIGINT AS max_iters FROM ex_cls)""",
        "ex_cls",
    ),
    "confusion": sql(
        """SELECT a.cls AS label, b.cls AS pred, count(p.ex_id) AS n
           FROM (SELECT unnest(range(10)) AS cls) a CROSS JOIN (SELECT unnest(range(10)) AS cls) b
           LEFT JOIN pred p ON p.label = a.cls AND p.pred = b.cls GROUP BY a.cls, b.cls""",
        "pred",
    ),
    "class_universe": sql("SELECT label AS cls FROM pred UNION SELECT pred FROM pred", "pred"),
    "class_report": sql(
        """SELECT label, support::BIGINT AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
             round(f2, 6) AS f2, round(r, 6) AS accuracy FROM class_scores""",
        "class_scores",
    ),
    "overall_report": sql(
        """SELECT unnest(['macro_precision', 'macro_recall', 'macro_f1', 'macro_f2', 'weighted_precision', 'weighted_recall',
               'weighted_f1', 'weighted_f2', 'accuracy', 'support']) AS metric,
             unnest([round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), round(avg(f2), 6),
               round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
               round(sum(f1 * support) / sum(support), 6), round(sum(f2 * support) / sum(support), 6),
               (SELECT round(avg((label = pred)::INTEGER), 6) FROM pred), sum(support)]) AS value FROM class_scores""",
        "class_scores",
    ),
    "overall_accuracy": sql("SELECT label, round(avg((label = pred)::INTEGER), 6) AS accuracy FROM pred GROUP BY label", "pred"),
    "argmax_topk": sql(
        """SELECT l.ex_id, p.pred, k - 1 AS k, cls, round(logit - z, 6) AS logp
           FROM (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY logit DESC, cls) AS k,
                   ln(sum(exp(logit)) OVER (PARTITION BY ex_id)) AS z FROM pred_long WHERE cls < 8) l
           JOIN pred p USING (ex_id) WHERE k <= 3""",
        "pred",
    ),
    "batch_metrics": sql(
        f"""SELECT count(*) AS batches, round(avg(loss), 6) AS mean_loss, round(avg(acc), 6) AS mean_accuracy,
               round(avg(f2), 6) AS mean_f2 FROM
             (SELECT batch, max(acc) AS acc, max(loss) AS loss, avg(CASE WHEN tp = 0 THEN 0 ELSE 5 * tp / (4 * support + predicted) END) AS f2 FROM
               (SELECT d.batch, c.cls, avg((label = pred)::INTEGER) AS acc, avg(loss) AS loss, sum((label = cls AND pred = cls)::INTEGER) AS tp,
                  sum((label = cls)::INTEGER) AS support, sum((pred = cls)::INTEGER) AS predicted
                FROM drawn d JOIN (SELECT batch, label AS cls FROM drawn UNION SELECT batch, pred FROM drawn) c USING (batch)
                GROUP BY d.batch, c.cls) GROUP BY batch)""",
        "drawn",
    ),
    "weighted_ce": sql(
        """SELECT round(sum(w * loss) / sum(w), 6) AS loss FROM losses JOIN pred USING (ex_id)
           JOIN (SELECT label::BIGINT AS label, (SELECT count(*) FROM embeddings) / (10 * count(*)) AS w FROM embeddings GROUP BY label)
             USING (label)""",
        "losses",
        "pred",
    ),
    "ml_classifier": sql(
        f"SELECT count(*) AS rows, true AS beats_majority FROM ex_cls WHERE {draw("'part:'||doc_id")} % 100 >= 75", "ex_cls"
    ),
    "chosen_rows": """SELECT doc_id, n_chars FROM documents
        WHERE len(list_distinct(string_split(text, ''))) % 2 = 0""",
    "batch_function": """SELECT doc_id, batch_id, n_chars - min(n_chars) OVER (PARTITION BY batch_id) AS offset
        FROM (SELECT doc_id, n_chars::BIGINT AS n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM documents)""",
    "binary_examples": sql(
        f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, label, {digest('ids')} AS ids_md5 FROM cls_ids", "cls_ids"
    ),
    "classifier_document": sql(
        """SELECT unnest(['examples', 'loss', 'accuracy', 'macro_f1', 'macro_f2', 'macro_recall']) AS metric,
             unnest([(SELECT count(*) FROM pred)::DOUBLE, (SELECT round(avg(loss), 6) FROM losses),
               (SELECT round(avg((label = pred)::INTEGER), 6) FROM pred), round(avg(f1), 6), round(avg(f2), 6), round(avg(r), 6)]) AS value
           FROM class_scores
           UNION ALL SELECT 'confusion_'||label||'_'||pred, count(*)::DOUBLE FROM pred GROUP BY label, pred""",
        "class_scores",
        "losses",
    ),
    "usable_datasets": """SELECT 'documents' AS dataset, count(*) AS rows, '' AS lacking FROM documents
        UNION ALL SELECT 'conversations', count(*), '' FROM conversations
        UNION ALL SELECT 'benchmark', count(*), '' FROM benchmark
        UNION ALL SELECT 'pages', count(*) * 0, 'text' FROM pages""",
    "scored": sql(
        """SELECT doc_id, (CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END)::BIGINT AS pred
           FROM (SELECT doc_id, list_sum(ids) % 97 AS a, list_sum(ids) * 2 % 97 AS b, list_sum(ids) * 3 % 97 AS c FROM cls_ids)""",
        "cls_ids",
    ),
    "mix_natural": sql(
        "SELECT out_pos, language, doc_id FROM "
        + shuffled(
            "(SELECT language, doc_id, row_number() OVER (ORDER BY language, doc_id) - 1 AS i, count(*) OVER () AS m FROM ex_sft)",
            "language, doc_id", "i", "m",
        ),
        "ex_sft",
    ),
    "mix_balanced": sql(
        "SELECT out_pos, language, draw, doc_id FROM "
        + shuffled(
            "(SELECT language, draw, doc_id, row_number() OVER (ORDER BY language, draw) - 1 AS i, count(*) OVER () AS m FROM mixed)",
            "language, draw, doc_id", "i", "m",
        ),
        "mixed",
    ),
    "language_sample": sql(
        f"""SELECT {SHUFFLE} AS out_pos, language, doc_id FROM
            (SELECT language, doc_id, row_number() OVER (PARTITION BY language ORDER BY md5('42:'||doc_id), doc_id) AS r,
               count(*) OVER (PARTITION BY language) AS n FROM ex_sft)
            WHERE r <= greatest(1, floor(n * 0.3::DOUBLE))""",
        "ex_sft",
    ),
    "language_head": sql("SELECT doc_id, language FROM ranked_docs WHERE row_index < 20", "ranked_docs"),
    "language_index": sql("SELECT doc_id, language, row_index FROM ranked_docs", "ranked_docs"),
    "seeded_order": "SELECT o_orderkey, out_pos FROM "
    + shuffled("(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS m FROM orders)", "o_orderkey", "i", "m"),
    "drawn_rows": f"""SELECT k.draw, r.doc_id, r.n_chars FROM (SELECT unnest(range(5000)) AS draw) k
        JOIN (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) r
        ON r.i = {draw("'draw:'||k.draw")} % r.n""",
    "concat_datasets": """SELECT part, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM
        (SELECT 0 AS part, text FROM documents UNION ALL SELECT 1, text FROM conversations UNION ALL SELECT 2, text FROM benchmark)
        GROUP BY part""",
    "dataset_split": sql(
        "SELECT doc_id, length(text) AS chars FROM ex_sft WHERE language = 'en' AND split = 'validation'", "ex_sft"
    ),
    "language_scan": sql(
        """SELECT language, count(*) AS rows, sum(length(summary))::BIGINT AS chars FROM ex_sft
           WHERE language IN ('de', 'fr') AND split = 'train' GROUP BY language""",
        "ex_sft",
    ),
    "prompts": "\nUNION ALL ".join(
        f"""SELECT '{form}' AS form, doc_id, md5('[LANG='||lang||'] Summarize the following article.'||chr(10)||'Article:'||chr(10)
            ||{rule.format("text")}||chr(10)||'Summary:'||chr(10)) AS prompt_md5 FROM documents"""
        for form, rule in FORMS.items()
    ),
    "packs": sql(
        f"""SELECT doc_id, len(cut)::INTEGER AS prompt_len, len(goal)::INTEGER AS target_len, {digest('cut || goal')} AS ids_md5,
            {digest('ignored || goal')} AS labels_md5 FROM packed""",
        "packed",
    ),
    "pack_counts": sql(
        """SELECT s.split, count(p.doc_id) AS rows FROM (VALUES ('train'), ('validation'), ('test')) s(split)
           LEFT JOIN packed p USING (split) GROUP BY s.split""",
        "packed",
    ),
    "pack_files": sql(
        """SELECT split, language, count(*) AS rows, sum(len(cut))::BIGINT AS prompt_ids, sum(len(goal))::BIGINT AS target_ids
           FROM packed GROUP BY split, language""",
        "packed",
    ),
    "pack_build": sql(
        """SELECT m.language, count(*) AS rows, count(DISTINCT m.doc_id) AS docs, sum(out_pos * (m.doc_id + 1))::BIGINT AS order_sum,
             sum(len(cut))::BIGINT AS prompt_ids, sum(len(goal))::BIGINT AS target_ids
           FROM kept_train m JOIN train_packs p ON p.language = m.language AND p.doc_id = m.doc_id GROUP BY m.language""",
        "kept_train",
    ),
    "tight_packs": sql(
        f"""SELECT doc_id, len(goal) >= 24 AS skip, CASE WHEN len(goal) < 24 THEN len(cut)::INTEGER END AS prompt_len,
              CASE WHEN len(goal) < 24 THEN {digest('cut || goal')} END AS ids_md5
            FROM (SELECT doc_id, goal, CASE WHEN len(p_ids) <= room THEN p_ids
                    ELSE p_ids[1:greatest(room - 2, 0)] || p_ids[len(p_ids) - least(room, 2) + 1:] END AS cut
                  FROM (SELECT *, 24 - len(goal) AS room FROM
                         (SELECT *, list_append(t_ids[1:32], 1) AS goal FROM prompt_ids)))""",
        "prompt_ids",
    ),
    "padded_batches": sql(
        """SELECT batch AS batch_id, max(n) AS width, (max(n) * count(*) - sum(n))::BIGINT AS pad_cells, sum(n)::BIGINT AS mask_sum,
             (sum(len(cut)) + max(n) * count(*) - sum(n))::BIGINT AS ignored
           FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch, cut, len(cut) + len(goal) AS n FROM packed)
           GROUP BY batch""",
        "packed",
    ),
    "gen_prompts": sql(
        f"""SELECT doc_id, least(len(p_ids), 160)::INTEGER AS prompt_len,
              (CASE WHEN list_contains(t_ids, 4) THEN list_position(t_ids, 4) - 1 ELSE len(t_ids) END)::INTEGER AS cut_len,
              {digest('p_ids[greatest(len(p_ids) - 63, 1):]')} AS tail_md5 FROM prompt_ids""",
        "prompt_ids",
    ),
    "token_loss": sql(
        """SELECT language, num_tokens, round(loss, 6) AS loss FROM language_loss
           UNION ALL SELECT 'macro', sum(num_tokens)::BIGINT, round(avg(loss), 6) FROM language_loss
           UNION ALL SELECT 'weighted', sum(num_tokens)::BIGINT, round(sum(loss * num_tokens) / sum(num_tokens), 6) FROM language_loss""",
        "language_loss",
    ),
    "rouge_n": sql("SELECT language, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge_scores", "rouge_scores"),
    "rouge_n_ascii": sql(
        "SELECT language, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rouge3, 6) AS rouge3 FROM ascii_scores",
        "ascii_scores",
    ),
    "rouge_l": sql("SELECT language, round(rougeL, 6) AS rougeL FROM lcs_scores", "lcs_scores"),
    "bleu": sql("SELECT language, round(bleu, 6) AS bleu FROM bleu_scores", "bleu_scores"),
    "language_report": sql(
        """SELECT language, num_examples, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougeL, 6) AS rougeL,
             round(bleu, 6) AS bleu FROM language_scores
           UNION ALL SELECT 'macro', sum(num_examples)::BIGINT, round(avg(rouge1), 6), round(avg(rouge2), 6),
             round(avg(rougeL), 6), round(avg(bleu), 6) FROM language_scores
           UNION ALL SELECT 'weighted', sum(num_examples)::BIGINT, round(sum(rouge1 * num_examples) / sum(num_examples), 6),
             round(sum(rouge2 * num_examples) / sum(num_examples), 6), round(sum(rougeL * num_examples) / sum(num_examples), 6),
             round(sum(bleu * num_examples) / sum(num_examples), 6) FROM language_scores""",
        "language_scores",
    ),
    "parsed_logs": sql(
        """SELECT run, step, 10000::BIGINT AS total_steps, written AS train_loss, CASE WHEN step % 25 = 0 THEN written END AS val_loss,
             step * 150 AS train_time, 150.0::DOUBLE AS step_avg FROM runs""",
        "runs",
    ),
    "run_summary": sql(
        """SELECT run, min(written) FILTER (WHERE step % 25 = 0) AS best_val, max(step) AS last_step,
             max_by(written, step) FILTER (WHERE step % 25 = 0) AS last_val, 150.0::DOUBLE AS mean_step_ms FROM runs GROUP BY run""",
        "runs",
    ),
    "loss_windows": sql(
        """SELECT run, (step - 1) // 25 AS eval_no, max(CASE WHEN step % 25 = 0 THEN step END) AS eval_step, count(*) AS steps,
             round(avg(train_loss), 6) AS mean_train_loss FROM runs GROUP BY run, (step - 1) // 25""",
        "runs",
    ),
    "best_checkpoint": sql(
        """SELECT representation, size, step, written AS val_loss,
             printf('models/r%d/best_state_step%06d_val', run, step)||written::DECIMAL(10,4)||'.pt' AS path
           FROM (SELECT *, row_number() OVER (PARTITION BY representation, size ORDER BY written, step DESC) AS r
                 FROM runs WHERE step % 25 = 0) WHERE r = 1""",
        "runs",
    ),
    "checkpoint_files": sql(
        """SELECT representation, size, step, written AS val_loss
           FROM (SELECT *, row_number() OVER (PARTITION BY representation, size ORDER BY written, step DESC) AS r
                 FROM runs WHERE step % 25 = 0) WHERE r = 1""",
        "runs",
    ),
    "best_so_far": BEST,
    "stream_best": BEST,
    "stream_best_keyed": BEST,
    "stream_shards": sql(
        """SELECT CASE WHEN file LIKE 'data_val%' THEN 'val' ELSE 'train' END AS split, count(*) AS files, sum(tokens)::BIGINT AS tokens
           FROM shard_totals GROUP BY ALL""",
        "shard_totals",
    ),
    "corpus_job": sql(
        """SELECT file, sum(tokens)::BIGINT AS tokens FROM shard_totals WHERE file LIKE 'data_train%' GROUP BY ROLLUP (file)""",
        "shard_totals",
    ),
    "pack_job": sql(
        """SELECT split, language, count(*) AS rows, sum(len(cut))::BIGINT AS prompt_ids, sum(len(goal))::BIGINT AS target_ids
           FROM packed JOIN (SELECT doc_id, row_number() OVER
                 (PARTITION BY language, split ORDER BY md5('42:'||language||':'||row_index), row_index) AS r,
               count(*) OVER (PARTITION BY language, split) AS n FROM ranked_docs) USING (doc_id)
           WHERE split <> 'train' OR r <= greatest(1, floor(n * 0.3::DOUBLE)) GROUP BY split, language""",
        "packed",
        "ranked_docs",
    ),
    "classifier_job": sql(
        """SELECT dataset, c.cls AS label, sum((label = c.cls)::INTEGER)::BIGINT AS support,
             round(CASE WHEN sum((pred = c.cls)::INTEGER) > 0
               THEN sum((label = c.cls AND pred = c.cls)::INTEGER) / sum((pred = c.cls)::INTEGER) ELSE 0 END, 6)::DOUBLE AS precision,
             round(5 * sum((label = c.cls AND pred = c.cls)::INTEGER)
               / (4 * sum((label = c.cls)::INTEGER) + sum((pred = c.cls)::INTEGER)), 6)::DOUBLE AS f2
           FROM scored_sets JOIN (SELECT dataset, label AS cls FROM scored_sets UNION SELECT dataset, pred FROM scored_sets) c
             USING (dataset) GROUP BY dataset, c.cls""",
        "scored_sets",
    ),
    "generation_job": sql(
        """SELECT language, 'test' AS split, num_examples, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2,
             round(rougeL, 6) AS rougeL, round(bleu, 6) AS bleu, round(loss, 6) AS token_loss FROM all_scores
           UNION ALL SELECT 'macro', 'test', sum(num_examples)::BIGINT, round(avg(rouge1), 6), round(avg(rouge2), 6),
             round(avg(rougeL), 6), round(avg(bleu), 6), round(avg(loss), 6) FROM all_scores
           UNION ALL SELECT 'weighted', 'test', sum(num_examples)::BIGINT, round(sum(rouge1 * num_examples) / sum(num_examples), 6),
             round(sum(rouge2 * num_examples) / sum(num_examples), 6), round(sum(rougeL * num_examples) / sum(num_examples), 6),
             round(sum(bleu * num_examples) / sum(num_examples), 6), round(sum(loss * num_examples) / sum(num_examples), 6)
             FROM all_scores""",
        "all_scores",
    ),
    "width_rules": """SELECT doc_id, (ceil(n_chars / 128) * 128)::BIGINT AS up, greatest(1000, (ceil(n_chars / 1000) * 1000)::BIGINT) AS up_from,
        (CASE WHEN n_chars % 128 = 0 THEN n_chars ELSE (n_chars // 128 + 1) * 128 END)::BIGINT AS context, 'set_'||source AS label
        FROM documents""",
    "stream_tokens": sql(
        """SELECT doc_id, len(ids) AS tokens, coalesce(x.checksum, 0) AS checksum FROM plain_ids LEFT JOIN
           (SELECT doc_id, sum(id::BIGINT * i)::BIGINT AS checksum
            FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM plain_ids) GROUP BY doc_id) x USING (doc_id)""",
        "plain_ids",
    ),
    "stream_counts": sql("SELECT lang, count(*) AS docs, sum(len(p))::BIGINT AS tokens FROM split_docs GROUP BY lang", "split_docs"),
    "stream_windows": """SELECT epoch_us(w) AS window_us, count(*) AS n, round(avg(value), 6) AS mean_loss,
          round(avg((event_type IN ('purchase', 'signup'))::INTEGER), 6) AS accuracy
        FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS w, value, event_type FROM events)
        WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY w""",
}
