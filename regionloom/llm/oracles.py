"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

import re

from . import licenses, mixing, rules, secrets

_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _count(text: str, marks: str) -> str:
    return f"(length({text}) - length(translate({text}, {_text(marks)}, '')))"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {_text(_SPACE)}), lambda x: x <> '')"


def quality_rules() -> str:
    """Words, repeats and line verdicts as rows, then one row per document."""
    n = "greatest(n, 1)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_words("text")} AS words FROM d),
word AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
win AS (
  SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
twice AS (SELECT doc_id, i FROM win WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
judged AS (
  SELECT doc_id, l,
         regexp_matches(l, {_text(r'''[.!?…。！？:;]["'”’»)\]]*(?:\s|$)''')})
         AND NOT ({_count("l", rules._MARKS)} * 3 > {n} OR {_count("l", "!")} * 3 > {n} OR (seps >= 3 AND seps * 6 > {n}))
         AND NOT (length(l) <= {rules.SHORT_LINE} AND regexp_matches(lower(l), {_text(rules._FURNITURE)})) AS stays
  FROM (SELECT doc_id, l, len({_words("l")}) AS n, {_count("l", rules._SEPARATORS)} AS seps FROM line WHERE regexp_matches(l, {_text(_NOT_SPACE)}))
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE stays) AS n_lines_kept, count(*) - count(DISTINCT l) AS n_dup_lines,
         sum(length(l)) AS all_chars, coalesce(sum(length(l)) FILTER (WHERE stays), 0) AS kept_chars
  FROM judged GROUP BY 1
),
counted AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST({_count("text", "#*$%&|<>")} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_kept, 0) AS n_lines_kept, coalesce(all_chars, 0) AS all_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_kept, failed AS base_failed,
       NOT failed AND NOT ((all_chars - kept_chars) * 100 > all_chars * {rules.MOST_LOST_PERCENT}) AS kept
FROM (SELECT *, n_words < {rules.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {rules.MOST_REPEATED_PERCENT} AS failed FROM counted)"""


def secret_scans() -> str:
    """Matches and their places by splitting each text at the matches; entropy by every window."""
    assigned = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    candidate = secrets.CANDIDATE.replace("(?<![A-Za-z0-9+/_=-])", "")  # greedy matches are whole runs already
    kinds = zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, candidate), strict=True)
    found = "\n  UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, '{kind}' AS kind, string_split_regex(text, {_text(p)}) AS pieces, regexp_extract_all(text, {_text(p)}, 0) AS found FROM d"
        for k, (kind, p) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS (
  {found}
),
placed AS (
  SELECT doc_id, rank, kind, found[k] AS v,
         CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(generate_series(1, len(found))) AS k FROM matches WHERE len(found) > 0)
),
spans AS (SELECT *, s + length(v) AS e FROM placed),
base AS (SELECT * FROM spans WHERE rank IN (1, 2) OR (rank = 0 AND length(regexp_replace(v, {_text(assigned)}, '')) >= {secrets.LEAST_ASSIGNED})),
random AS (
  SELECT * FROM spans WHERE rank = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, {_text(secrets.ALLOWED)})
    AND list_max(list_transform(generate_series(1, greatest(length(v) - {secrets.WINDOW - 1}, 1)),
                                lambda i: list_aggregate(string_split(substr(v, i, {secrets.WINDOW}), ''), 'entropy')))
        >= CASE WHEN regexp_matches(v, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN {secrets.HEX_BITS} WHEN regexp_matches(v, '^[A-Za-z0-9]+$') THEN {secrets.ALNUM_BITS} ELSE {secrets.MIXED_BITS} END
),
added AS (SELECT * FROM random r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND b.e >= r.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
         count(*) FILTER (WHERE rank = 3) AS n_entropy,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '') AS base_spans,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM every GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told ON told.doc_id = d.doc_id"""


def license_scans() -> str:
    """Every place of a template's shingle, spread to the windows that hold it, counted per window."""
    rows, lengths = [], []
    for name, texts in licenses.TEMPLATES.items():
        for k, text in enumerate(texts):
            words = re.findall(r"[^\W_]+", text.lower())
            width, stride = min(len(words), licenses.SHINGLE), max(len(words) // 4, 1)
            shingles = sorted({" ".join(words[i : i + width]) for i in range(len(words) - width + 1)})
            lengths.append(f"('{name}', '{name}/{k}', {width}, {stride}, {len(words) + stride - 1}, {len(shingles)})")
            rows += [f"('{name}/{k}', {width}, {_text(s)})" for s in shingles]
    widths = sorted({int(x.split(", ")[2]) for x in lengths})
    grams = "\n  UNION ALL ".join(
        f"SELECT doc_id, i, {w} AS width, " + " || ' ' || ".join(["x", *[f"lead(x, {k}) OVER o" for k in range(1, w)]]) + " AS g FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)" for w in widths
    )
    return f"""
WITH lengths(license, template, width, stride, length, n) AS (VALUES {", ".join(lengths)}),
shingles(template, width, g) AS (VALUES {", ".join(rows)}),
tokens AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i FROM tokens),
gram AS (
  {grams}
),
hits AS (SELECT doc_id, i, s.template, s.g FROM gram JOIN shingles s ON s.width = gram.width AND s.g = gram.g),
windows AS (
  SELECT doc_id, license, l.template, l.n, hits.g,
         unnest(generate_series(greatest(CAST(ceil((i - (length - width)) / stride) AS BIGINT), 0), CAST(floor(i / stride) AS BIGINT))) * stride AS start
  FROM hits JOIN lengths l ON l.template = hits.template
),
shares AS (SELECT doc_id, license, template, start, count(DISTINCT g) / any_value(n) AS share FROM windows GROUP BY ALL)
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, CAST(min(start) AS BIGINT) AS first_word
FROM shares WHERE share >= {licenses.CONTAINED} GROUP BY ALL"""


def sharding_sizes() -> str:
    return "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, 'bytes' AS law FROM documents"


def sharding_shards() -> str:
    return "SELECT CAST(range AS INTEGER) AS shard, true AS gapless, true AS near FROM range(16)"


def mixing_targets() -> str:
    """Sources in order of their cap over their weight: capped ones come first, the rest share what these leave."""
    return f"""
WITH d AS (SELECT source, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, count(*) AS n_docs FROM d GROUP BY 1),
weighted AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, {mixing.MOST_REPEATS} * size AS cap FROM s),
ordered AS (
  SELECT *, (SELECT sum(size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighted
),
level AS (SELECT max(rest / weights) AS price FROM ordered WHERE rest * w <= cap * weights)
SELECT source, CAST(size AS BIGINT) AS source_size, round(CASE WHEN rest * w > cap * weights THEN cap ELSE w * price END, 6) AS target, n_docs, CAST(0 AS BIGINT) AS n_over, true AS near
FROM ordered, level"""


def pii_base_counts() -> str:
    found = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    doubled = "list_transform(range(1, len(g) + 1), lambda i: (CAST(g[len(g) + 1 - i] AS INTEGER) * (2 - i % 2)) // 10 + (CAST(g[len(g) + 1 - i] AS INTEGER) * (2 - i % 2)) % 10)"
    fits = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 0) > 255)) = 0",
        "card": f"length(g) BETWEEN 12 AND 19 AND list_sum({doubled}) % 10 = 0",
        "phone": "length(g) BETWEEN 9 AND 15",
    }
    matches = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {_text(p)}, 0)) AS v FROM documents" for k, p in found.items())
    verdict = " ".join(f"WHEN '{k}' THEN {c}" for k, c in fits.items())
    return f"""
WITH m AS (SELECT *, {digits} AS g FROM ({matches})),
kept AS (SELECT doc_id, kind FROM m WHERE CASE kind {verdict} END)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in found)}
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLES = {
    "sharding_sizes": sharding_sizes(),
    "sharding_shards": sharding_shards(),
    "mixing_targets": mixing_targets(),
    "pii_base_counts": pii_base_counts(),
    "op4_secret_scans": secret_scans(),
    "op5_quality_rules": quality_rules(),
    "op7_license_scans": license_scans(),
}
