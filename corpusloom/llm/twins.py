"""DuckDB statements with the same answers as the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import cascade, cells, infill, lexical, mixing, weblinks
from corpusloom.llm.weblinks import BLOCK_RATIO, DAMPING, PARENT_WEIGHT, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
STEPS = 160  # links over which the twin follows trust
SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def mixture() -> str:
    """Levels by repeated sharing; the extra copies by running sums in hash order."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    digits = mixing.LEVELS * mixing.LEVEL_BITS // 4
    return f"""
    WITH RECURSIVE sized AS (
      SELECT doc_id, source, len({WORDS})::BIGINT AS size,
        ('0x'||substr(md5('{mixing.SEED}:'||coalesce(doc_id::VARCHAR, '')||':'||coalesce(text, '')), 1, {digits}))::BIGINT AS place
      FROM documents),
    sources AS (
      SELECT source, size, ({mixing.MOST} * size)::BIGINT AS bound, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END AS weight
      FROM (SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source)),
    levels AS (
      SELECT 0 AS i, (SELECT sum(size)::BIGINT / sum(weight)::BIGINT FROM sources) AS level
      UNION ALL
      SELECT i + 1, coalesce((SELECT (sum(size) - coalesce(sum(bound) FILTER (WHERE bound <= weight * l.level), 0))::BIGINT
          / nullif(sum(weight) FILTER (WHERE bound > weight * l.level), 0)::BIGINT FROM sources), l.level)
      FROM levels l WHERE i < 60),
    shares AS (
      SELECT source, size AS source_size, target, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END::BIGINT AS copies
      FROM (SELECT source, size, least(bound::DOUBLE, weight * (SELECT max_by(level, i) FROM levels)) AS target FROM sources)),
    rests AS (SELECT *, target - copies * source_size AS rest FROM shares),
    places AS (
      SELECT source, place, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto
      FROM sized GROUP BY source, place),
    ends AS (
      SELECT r.source, min(place) AS last, min_by(upto - words / 2, place) AS due
      FROM places p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source WHERE upto > rest GROUP BY r.source)
    SELECT d.doc_id, d.size, r.source_size, r.target,
      (d.size * (r.copies + CASE WHEN d.place < e.last OR d.place = e.last AND e.due <= r.rest THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
    LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source"""


def url_trust() -> str:
    """A rank is the sum of what arrives over 0, 1, 2, ... links; what is left after ``STEPS`` is below 1e-11 of all mass."""
    fits = "NULL"
    for rule in sorted(RULES, key=lambda r: (len(r.pattern), len(r.host), r.pattern)):
        test = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        fits = f"CASE WHEN {test} THEN '{rule.verdict} {rule.pattern}' ELSE {fits} END"
    link = weblinks.LINK.replace("'", "''")
    lower = f"'{weblinks.UPPER}', '{weblinks.LOWER}'"
    return f"""
    WITH RECURSIVE base AS (
      SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), {lower}) AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM base),
    fitted AS (SELECT *, {fits} AS fit FROM parts),
    linked AS (
      SELECT host AS src, translate(regexp_replace(regexp_replace(target, '^[^@]*@', ''), ':[0-9]*$', ''), {lower}) AS dst
      FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS target FROM fitted
            WHERE host <> '' AND html IS NOT NULL)),
    labels AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM fitted WHERE host <> ''),
    up AS (
      SELECT DISTINCT array_to_string(p[len(p) - n + 1:], '.') AS src, array_to_string(p[len(p) - n + 2:], '.') AS dst
      FROM (SELECT p, unnest(range(3, len(p) + 1)) AS n FROM labels)),
    edges AS (
      SELECT src, dst, sum(weight) AS weight FROM
        (SELECT src, dst, 1.0::DOUBLE AS weight FROM linked WHERE dst <> '' AND src <> dst
         UNION ALL SELECT src, dst, {PARENT_WEIGHT}::DOUBLE FROM up UNION ALL SELECT dst, src, {PARENT_WEIGHT}::DOUBLE FROM up)
      GROUP BY src, dst),
    shares AS (
      SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM
        (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges)),
    flows AS (
      SELECT 0 AS step, kind, host, mass / sum(mass) OVER (PARTITION BY kind) AS mass FROM
        (SELECT CASE WHEN starts_with(fit, 'allow') THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS mass
         FROM fitted WHERE fit IS NOT NULL AND host <> '' GROUP BY ALL)
      UNION ALL
      SELECT f.step + 1, f.kind, s.dst, sum({DAMPING} * f.mass * s.share) FROM flows f JOIN shares s ON f.kind = s.kind AND f.host = s.src
      WHERE f.step < {STEPS} GROUP BY f.step, f.kind, s.dst),
    ranks AS (SELECT kind, host, sum(mass) AS mass FROM flows GROUP BY kind, host),
    verdicts AS (
      SELECT host, CASE WHEN coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0)
          > {BLOCK_RATIO} * coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0) THEN 'block' ELSE 'allow' END AS verdict
      FROM ranks GROUP BY host)
    SELECT page_id, f.host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), v.verdict, 'allow') AS verdict
    FROM fitted f LEFT JOIN verdicts v ON v.host = f.host"""


def rule_cascade() -> str:
    """All rules for every text; windows of eight words are compared as texts."""
    size = cascade.WINDOW
    symbols = "[" + cascade.SYMBOLS.decode() + "]"
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    windows AS (
      SELECT row, i, array_to_string(w[i:i + {size - 1}], ' ') AS words FROM (SELECT row, w, unnest(range(1, len(w) - {size - 2})) AS i FROM texts)),
    twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, words) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT row, count(DISTINCT i + k)::BIGINT AS n FROM (SELECT row, i, unnest(range({size})) AS k FROM twice) GROUP BY row),
    lines AS (
      SELECT row, line FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE trim(line, {SPACES}) <> ''),
    line_counts AS (
      SELECT row, count(*) AS n, (count(*) - count(DISTINCT line))::BIGINT AS repeated,
        count(*) FILTER (WHERE regexp_matches(ltrim(line, {SPACES}), '^[-*•‣–]')) AS bullets,
        count(*) FILTER (WHERE regexp_matches(rtrim(line, {SPACES}), '(\.\.\.|…)$')) AS ellipses
      FROM lines GROUP BY row),
    measured AS (
      SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '{symbols}'))::BIGINT AS n_symbols, coalesce(l.repeated, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letters,
        coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest,
        len(list_filter(list_zip(w, w[2:]), lambda p: p[1] = p[2])) AS stutters, l.n AS n_lines, l.bullets, l.ellipses
      FROM texts t LEFT JOIN covered c USING (row) LEFT JOIN line_counts l USING (row)),
    judged AS (
      SELECT *, n_words < {cascade.LEAST_WORDS} OR 100 * n_repeat_words > {cascade.MOST_REPEATED} * n_words AS base_failed FROM measured)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.25 AND n_dup_lines / n_lines <= 0.5 AND stutters / n_words <= 0.2
        AND letters / n_words >= 0.7 AND bullets / n_lines <= 0.9 AND ellipses / n_lines <= 0.5 AND longest <= 2000 AS kept
    FROM judged"""


def fill_in_middle() -> str:
    """Units as a list of texts, the parts as slices of it."""
    p, s, m = (mark.decode() for mark in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    numbers = ", ".join(f"('0x'||substr(digest, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    part = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return rf"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('{infill.SEED}:'||coalesce(doc_id::VARCHAR, '')) AS digest,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
    drawn AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, {numbers} FROM texts),
    chosen AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {infill.RATE} THEN 'plain'
          WHEN h4 % 100 < {infill.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    parts AS (SELECT *, {part("1", "a")} AS prefix, {part("a + 1", "b")} AS middle, {part("b + 1", "n")} AS suffix FROM chosen)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}'||prefix||'{s}'||suffix||'{m}'||middle
        ELSE '{s}'||suffix||'{p}'||prefix||'{m}'||middle END) AS output_sha256, sha256(text) AS restored_sha256
    FROM parts"""


def lexical_search() -> str:
    """Every document that shares a term with an item is scored."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = f"regexp_extract_all(translate(text, '{weblinks.UPPER}', '{weblinks.LOWER}'), '{term}')"
    base, share = 100 - lexical.LENGTH_SHARE, lexical.LENGTH_SHARE
    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS row, doc_id, w FROM (SELECT doc_id, {terms} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
    total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
    asked AS (
      SELECT row_number() OVER () AS place, item_id, w FROM
        (SELECT item_id, list_distinct({terms}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))),
    item_terms AS (SELECT place, item_id, unnest(w) AS term FROM asked),
    counts AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM docs) GROUP BY row, term),
    weights AS (
      SELECT term, floor({lexical.WEIGHT_SCALE} * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM counts, total GROUP BY term, n_docs),
    damping AS (SELECT row, doc_id, {base} + ({share} * len(w)::BIGINT * n_docs) // n_terms AS m FROM docs, total),
    scored AS (
      SELECT i.place, i.item_id, d.doc_id, sum(weight * (({lexical.SCALE} * tf) // ({lexical.FREQUENCY} * tf + {lexical.LENGTH} * m)))::BIGINT AS score
      FROM item_terms i JOIN counts c USING (term) JOIN weights USING (term) JOIN damping d ON d.row = c.row
      GROUP BY i.place, i.item_id, d.row, d.doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {lexical.K}"""


def vector_cells() -> str:
    """All pairs of equal label, then the least id over any path."""
    cosine = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
    return f"""
    WITH RECURSIVE given AS (SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    usable AS (
      SELECT * FROM given WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x <> 0)) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    links AS (
      SELECT a.row, a.vec_id AS one, b.vec_id AS other FROM usable a
      JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.row <> b.row WHERE {cosine} >= {cells.LINK}),
    reached AS (
      SELECT DISTINCT vec_id AS one, vec_id AS other FROM given WHERE vec_id IS NOT NULL
      UNION SELECT r.one, l.other FROM reached r JOIN links l ON l.one = r.other),
    least AS (SELECT one, min(other) AS component_id FROM reached GROUP BY one),
    counted AS (SELECT row, count(*) AS n FROM links GROUP BY row)
    SELECT g.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, component_id, coalesce(g.vec_id = component_id, true) AS kept
    FROM given g LEFT JOIN counted c USING (row) LEFT JOIN least l ON l.one = g.vec_id"""


def operator_twins() -> dict[str, str]:
    return {
        "op4_mixture": mixture(), "op6_url_trust": url_trust(), "op7_rule_cascade": rule_cascade(),
        "op11_fill_in_middle": fill_in_middle(), "op12_lexical_search": lexical_search(), "op13_vector_cells": vector_cells(),
    }
