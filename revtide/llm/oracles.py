"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

# The alphabets that lower-casing maps, and the white space between words.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CAPITALS = "[A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ]"
_BLANK = r"[\x20\x09-\x0D]+"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_BLANK}'), lambda x: x <> '')"


def _windows(words: str, n: str) -> str:
    """All windows of n words of a list of words, each joined by blanks."""
    return f"list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' '))"


# The patterns of secrets; kind, text searched, pattern, group that is measured, least length.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
_SECRETS = [
    ("assign", "small", r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)""", 2, 8),
    ("access", "body", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "body", "[0-9a-f]{32,}", 0, 32),
    ("block", "body", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", "body", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("login", "body", rf"[a-z][a-z0-9+.-]*://[^{_SPACE}/:@]+:[^{_SPACE}/:@]+@[^{_SPACE}/:@]+", 0, 1),
]


def _secrets() -> str:
    """A match starts after all gaps up to its own and all matches before it."""
    kinds = " UNION ALL ".join(
        f"SELECT r, '{kind}' kind, {rank} AS rank, {least} least, unnest(regexp_extract_all({text}, '{pattern}')) hit, "
        f"unnest(regexp_extract_all({text}, '{pattern}', {group})) part, "
        f"unnest(string_split_regex({text}, '{pattern}')) gap, "
        f"generate_subscripts(string_split_regex({text}, '{pattern}'), 1) place FROM docs"
        for rank, (kind, text, pattern, group, least) in enumerate(_SECRETS)
    )
    shown = "kind || ':' || start || ':' || (start + length(hit))"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () r, doc_id, coalesce(text, '') body, {_low("coalesce(text, '')")} small FROM documents),
pieces AS ({kinds}),
placed AS (
  SELECT *, CAST(sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER w, 0) - coalesce(length(hit), 0) AS BIGINT) AS start
  FROM pieces WINDOW w AS (PARTITION BY r, rank ORDER BY place ROWS UNBOUNDED PRECEDING)),
good AS (SELECT * FROM placed WHERE hit IS NOT NULL AND length(part) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access,
  count(*) FILTER (kind = 'hex') n_hex,
  sha256(coalesce(string_agg({shown}, ',' ORDER BY start, rank) FILTER (rank < 3), '')) base_sha256,
  coalesce(string_agg({shown}, ',' ORDER BY start, rank) FILTER (kind IS NOT NULL), '') spans
FROM docs d LEFT JOIN good g USING (r) GROUP BY r, d.doc_id"""


_CONTAINMENT = f"""
WITH item AS (SELECT item_id, {_words(_low("coalesce(text, '')"))} w FROM benchmark),
sized AS (SELECT item_id, w, least(5, len(w)) n FROM item WHERE len(w) > 0),
own AS (SELECT DISTINCT item_id, n, unnest({_windows("w", "n")}) g FROM sized),
total AS (SELECT item_id, count(*) n_shingles FROM own GROUP BY item_id),
docs AS (SELECT doc_id, {_words(_low("coalesce(text, '')"))} w FROM documents),
held AS (
  SELECT DISTINCT doc_id, n, unnest({_windows("w", "n")}) g FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
shared AS (SELECT doc_id, item_id, count(*) n_shared FROM held JOIN own USING (n, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM shared JOIN total USING (item_id) WHERE 100 * n_shared >= 80 * n_shingles"""


def _quality_rules() -> str:
    from revtide.llm.rules import ALPHA, DELTA, MEASURES

    cuts = ", ".join(f"('{name}', {i}, {cut})" for name, grid in MEASURES.items() for i, cut in enumerate(grid))
    names = ", ".join(MEASURES)
    rate, count = ALPHA / len(MEASURES), len(MEASURES)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, 'none') stratum, coalesce(text, '') body, {_words("coalesce(text, '')")} w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) i, unnest({_windows("w", "5")}) g FROM docs),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) n FROM again, range(5) s(k) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, stratum, len(w) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]')) n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines,
    coalesce(c.n, 0) n_repeat_words, len(regexp_extract_all(body, '{_CAPITALS}')) n_capitals,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) n_stutter
  FROM docs d LEFT JOIN covered c USING (doc_id)),
measured AS (
  SELECT *, coalesce(CAST(n_symbols AS DOUBLE) / nullif(word_chars, 0), 0) symbol_share,
    coalesce(CAST(n_capitals AS DOUBLE) / nullif(word_chars, 0), 0) capital_share,
    coalesce(CAST(n_stutter AS DOUBLE) / nullif(n_words, 0), 0) stutter_share FROM counted),
shares AS (UNPIVOT (SELECT doc_id, stratum, {names} FROM measured) ON {names} INTO NAME measure VALUE share),
cuts(measure, place, cut) AS (VALUES {cuts}),
clean AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
tried AS (
  SELECT stratum, measure, place, cut, count(*) n, count(*) FILTER (share > cut) k
  FROM shares SEMI JOIN clean USING (doc_id) JOIN cuts USING (measure) GROUP BY ALL),
tails AS (
  SELECT stratum, measure, place, cut, CASE WHEN k >= n * {rate!r} THEN 1 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r})))) END tail FROM tried),
judged AS (
  SELECT stratum, measure, cut, bool_and(tail <= {DELTA} / ({count} * (SELECT count(DISTINCT stratum) FROM tried)))
    OVER (PARTITION BY stratum, measure ORDER BY place) passed FROM tails),
limits AS (SELECT stratum, measure, min(cut) cut FROM judged WHERE passed GROUP BY ALL),
rejected AS (SELECT DISTINCT doc_id FROM shares JOIN limits USING (stratum, measure) WHERE share > cut),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) kept FROM base"""


_WINDOW = 13
_SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, {_words("coalesce(text, '')")} w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - {_WINDOW} + 2)) i, unnest({_windows("w", str(_WINDOW))}) g FROM docs),
later AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k i FROM later, range({_WINDOW}) s(k)),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) word FROM docs),
kept AS (
  SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY i) AS body FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(body, '')) kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""


_JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words(_low("coalesce(text, '')"))} w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest({_windows("w", "least(4, len(w))")}) g FROM docs WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id a, b.doc_id b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN size s ON s.doc_id = a.doc_id JOIN size t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT b, root FROM reach JOIN links ON a = node WHERE root < b)
SELECT doc_id, coalesce(n, 0) n_shingles, min(root) component_id
FROM docs JOIN reach ON node = doc_id LEFT JOIN size USING (doc_id) GROUP BY ALL"""

# What ends a piece, and what lies between its words.
_COLLOCATIONS = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') lang,
    list_filter(string_split_regex(unnest(string_split_regex({_low("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda x: x <> '') w
  FROM documents),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) g
  FROM piece, (SELECT unnest(range(1, 6)) k) WHERE len(w) >= k),
held AS (SELECT lang, k, g, CAST(count(*) AS HUGEINT) a FROM gram GROUP BY lang, k, g HAVING count(*) >= 100),
longer AS (
  SELECT lang, k, a, unnest(list_transform(range(2, k), lambda j: list_transform(range(1, k - j + 2), lambda i: g[i:i + j - 1]))) gs FROM held WHERE k > 2),
inner_ AS (SELECT DISTINCT lang, a, unnest(gs) g FROM longer),
kept AS (SELECT * FROM held h WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = h.lang AND i.g = h.g AND 100 * i.a >= 100 * h.a)),
cut AS (SELECT *, unnest(range(1, k)) c FROM kept),
scored AS (
  SELECT t.lang, t.g, t.a, f.a l, r.a r, n, c, (1000 * t.a * n) // (f.a * r.a) score
  FROM cut t JOIN held f ON f.lang = t.lang AND f.g = t.g[1:c] JOIN held r ON r.lang = t.lang AND r.g = t.g[c + 1:] JOIN total o ON o.lang = t.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (
  SELECT *, array_to_string(g, ' ') phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) rank FROM best)
SELECT lang, rank, phrase, CAST(a AS BIGINT) a, CAST(l AS BIGINT) l, CAST(r AS BIGINT) r, CAST(n AS BIGINT) n, CAST(score AS BIGINT) score
FROM ranked WHERE rank <= 2000"""

# A checksum of the decimal id: bit by bit with its fixed polynomial.
_BITS = "list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda r, b: {_BITS}))"""
_TRIE = f"""
WITH turns AS (
  SELECT conv_id c, coalesce(role, '') who, coalesce("text", '') said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC} % 6 h, c - c % 100 base FROM (SELECT DISTINCT c FROM turns)),
whole AS (
  SELECT i.c, 0 part, pos, who, said FROM ids i JOIN turns t ON t.c = i.base WHERE pos <= h
  UNION ALL SELECT c, 1, pos, who, said FROM ids JOIN turns USING (c) WHERE pos > h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) d, length(said) size, sha256(length(who) || ':' || who || said) one FROM whole),
held AS (
  SELECT c, 0 d, 0 size, '' k FROM ids
  UNION ALL SELECT c, d, size, string_agg(one, '') OVER (PARTITION BY c ORDER BY d) FROM placed),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) up, d = max(d) OVER (PARTITION BY c) final FROM held),
node AS (
  SELECT k, any_value(d) d, any_value(up) up, min(c) conv_id, count(*) n, any_value(size) size,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (final), '')) ends_sha256
  FROM linked GROUP BY k),
kids AS (SELECT up k, count(*) n_children FROM node WHERE d > 0 GROUP BY up),
full_ AS (SELECT node.*, coalesce(n_children, 0) n_children FROM node LEFT JOIN kids USING (k)),
below AS (
  SELECT h.k, sum((n - 1) * f.size) saved, count(*) FILTER (n_children = 0) leaves FROM full_ f JOIN held h ON h.c = f.conv_id AND h.d <= f.d GROUP BY h.k)
SELECT f.conv_id, f.d depth, p.conv_id parent_conv_id, f.n n_convs, f.n_children, leaves n_leaves, CAST(saved AS BIGINT) saved_tokens, f.ends_sha256
FROM full_ f JOIN below USING (k) LEFT JOIN node p ON p.k = f.up"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": _secrets(),
    "op5_decontamination": _CONTAINMENT,
    "op6_quality_rules": _quality_rules(),
    "op7_substring_dedup": _SUBSTRINGS,
    "op12_prefix_trie": _TRIE,
    "op13_collocations": _COLLOCATIONS,
    "op8_jaccard_join": _JACCARD,
}
