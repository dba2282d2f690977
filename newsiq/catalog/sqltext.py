"""SQL counterparts of the column expressions, for the DuckDB side."""

from __future__ import annotations

from newsiq.functions import text as tx


def NORM(x: str) -> str:
    """Normalised text.  RE2's word boundary is ASCII, as the rule wants."""
    out = f"lower(coalesce({x}, ''))"
    for phrase in tx.BOILERPLATE:
        out = f"regexp_replace({out}, '\\b{phrase}\\b', ' ', 'g')"
    # a marked letter decomposes into base letter and mark, and the mark separates
    out = f"strip_accents(regexp_replace({out}, '([à-öø-ÿ])', '\\1 ', 'g'))"
    out = f"regexp_replace({out}, '[''’]', '', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9一-鿿]+', ' ', 'g'))"


def SQUEEZE(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def CANON(x: str) -> str:
    raw = f"trim({x})"
    pat = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?"
    path = f"regexp_replace(regexp_replace(regexp_extract({raw}, '{pat}', 3), '/index\\.html?$', '', 'i'), '/+$', '')"
    drop = "^(utm_[^=]*|" + "|".join(tx.TRACKING_PARAMS) + ")(=|$)"
    kept = (
        f"array_to_string(list_filter(string_split(ltrim(regexp_extract({raw}, '{pat}', 4), '?'), '&'), "
        f"lambda p: p <> '' AND NOT regexp_matches(p, '{drop}', 'i')), '&')"
    )
    return (
        f"(CASE WHEN regexp_matches({raw}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') THEN "
        f"lower(regexp_extract({raw}, '{pat}', 1)) || '://' || lower(regexp_extract({raw}, '{pat}', 2)) || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END ELSE {raw} END)"
    )


def TRGM(x: str) -> str:
    """Distinct trigrams of the padded words."""
    return (
        f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def SIM(a: str, b: str) -> str:
    """Similarity of two trigram lists."""
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b})) * 1e0 / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


# Brute force over the items: every pair that shares a shingle or a URL.
SIGNATURES = f"""
norm AS MATERIALIZED (
  SELECT id, url, {CANON('url')} AS curl, {NORM('title')} AS nt, {NORM('body')} AS nb, strftime(published_at, '%Y-%m-%d') AS d,
    CASE WHEN trust_tier = 'official' THEN 1 ELSE 0 END AS official, dedupe_priority AS priority, length({SQUEEZE('body')}) AS chars
  FROM items),
words AS MATERIALIZED (SELECT *, list_filter(string_split(nb, ' '), lambda w: w <> '') AS w, list_distinct(list_filter(string_split(nt, ' '), lambda w: w <> '')) AS tw FROM norm),
sig AS MATERIALIZED (
  SELECT id, url, curl, d, official, priority, chars, tw,
    list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh
  FROM words),
post AS MATERIALIZED (SELECT id, unnest(sh) AS k FROM sig),
shared AS MATERIALIZED (SELECT a.id AS l, b.id AS r, count(*) AS c FROM post a JOIN post b ON a.k = b.k AND a.id <> b.id GROUP BY 1, 2),
scored AS MATERIALIZED (
  SELECT s.l, s.r, CASE WHEN a.curl = b.curl THEN 1e0 ELSE least(1e0,
      0.38e0 * CASE WHEN len(a.tw) + len(b.tw) = 0 THEN 0e0 ELSE len(list_intersect(a.tw, b.tw)) * 1e0 / (len(a.tw) + len(b.tw) - len(list_intersect(a.tw, b.tw))) END
      + 0.59e0 * s.c / (len(a.sh) + len(b.sh) - s.c) + CASE WHEN a.d = b.d THEN 0.03e0 ELSE 0e0 END) END AS similarity
  FROM shared s JOIN sig a ON a.id = s.l JOIN sig b ON b.id = s.r
  UNION
  SELECT a.id, b.id, 1e0 FROM sig a JOIN sig b ON a.curl = b.curl AND a.id <> b.id),
pairs AS MATERIALIZED (SELECT l, r, max(similarity) AS similarity FROM scored WHERE similarity >= 0.9 GROUP BY l, r)
"""
