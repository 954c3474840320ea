"""DuckDB twins of the registered queries, over the same Parquet tables."""

from __future__ import annotations

import re
from html.entities import html5

from revtide.functions import markers as M
from revtide.operators.rollup import EDITOR, USER_ARTICLE

_VIEWS = {
    "revisions": """
SELECT CAST(k AS BIGINT) page_id, CAST(k % 2 AS INTEGER) page_namespace,
  'Page_' || CAST(k // 2 AS VARCHAR) page_title,
  event_id revision_id, ts event_timestamp,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END event_user_id,
  user_id % 10 = 0 event_user_is_anonymous,
  event_type = 'click' revision_minor_edit,
  CAST(round(value * 100) AS BIGINT) revision_text_bytes,
  event_type = 'purchase' revision_is_identity_reverted,
  event_type = 'error' revision_is_identity_revert,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END has_template,
  CASE (k // 2) % 5 WHEN 0 THEN 'weasel' WHEN 1 THEN 'peacock' WHEN 2 THEN 'autobiography'
    WHEN 3 THEN 'advert' ELSE 'fanpov' END AS template,
  CAST(user_id % 4 + event_id % 2 AS INTEGER) num_groups,
  CAST(event_id % 3 AS INTEGER) num_blocks_historical, CAST(event_id % 2 AS INTEGER) num_curr_blocks,
  TIMESTAMP '2023-01-01' + to_days(CAST(user_id AS INTEGER)) event_user_registration_timestamp,
  CASE event_type WHEN 'click' THEN 'Please see the talk page, thanks'
    WHEN 'view' THEN 'I think you could add a source'
    WHEN 'purchase' THEN 'rv; sorry, but we really need this'
    WHEN 'error' THEN 'Why? So maybe by the way undone' ELSE 'tagged' END event_comment
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events)""",
    "samples": """
SELECT template, page_id, min(event_timestamp) tag_date,
  CASE WHEN (page_id // 2) % 7 = 0 THEN NULL ELSE page_id + 1 END talk_page_id,
  CASE WHEN (page_id // 2) % 2 = 0 THEN 1 ELSE 0 END AS label
FROM (SELECT *, CASE WHEN event_timestamp >= TIMESTAMP '2024-01-21' THEN 2 ELSE 1 END half
      FROM revisions WHERE page_namespace = 0 AND has_template = 1
        AND event_timestamp >= TIMESTAMP '2024-01-11') x
GROUP BY template, page_id, half""",
    "mapping": """
SELECT DISTINCT page_id + 1 talk_page_id, page_id article_page_id FROM revisions
WHERE page_namespace = 0 AND (page_id // 2) % 7 <> 0""",
    "coedit": """
SELECT l_partkey page_id, CAST(l_partkey % 3 AS INTEGER) page_namespace, l_suppkey event_user_id,
  l_orderkey * 10 + l_linenumber revision_id, l_shipdate event_timestamp FROM lineitem""",
    "wikitext": r"""
SELECT doc_id % 50 page_id, 'Page ' || CAST(doc_id % 50 AS VARCHAR) page_title, doc_id revision_id,
  CASE WHEN doc_id % 97 <> 0 THEN (CASE doc_id % 8 WHEN 0 THEN '{{weasel|date=x}} '
    WHEN 1 THEN '{{ Advert ' || chr(10) || '|d=1}}{{}} '
    WHEN 2 THEN '{{cite web|u={{harvid|A}}}} {{peacock}} '
    WHEN 3 THEN '{{fanpov}}{{FANPOV}}{{fanpov|again}} '
    WHEN 4 THEN '{{autobiography|{{weasel}} '
    WHEN 5 THEN '{{infobox' || chr(10) || '|name=a}} ' ELSE '' END) || text END revision_text,
  doc_id user_id, n_chars revision_text_bytes
FROM documents""",
    "talk_texts": """
SELECT (conv_id % 50) * 2 + 1 page_id, 'Talk:Page ' || CAST(conv_id % 50 AS VARCHAR) page_title,
  conv_id * 100 + turn revision_id,
  TIMESTAMP '2024-01-10' + to_hours(CAST((conv_id * 37 + turn * 101) % 480 AS INTEGER)) event_timestamp,
  (CASE WHEN turn % 2 = 0 THEN 'lead text' || chr(10) ELSE '' END) || '== Topic ==' || chr(10)
  || opening || body || sign || ' 10:0' || CAST(turn AS VARCHAR) || ', 1 January 2024 (UTC)' || chr(10)
  || ':' || opening || 'reply [[User talk:x]] ' || sign || chr(10)
  || '::unsigned tail' || chr(10) || '=== Sub ===' || chr(10) || chr(10)
  || (CASE WHEN turn % 3 = 0 THEN body || ' [[User:plain]]' || chr(10) ELSE body END) revision_text
FROM (SELECT *, replace(text, chr(10), ' ') body, ' [[User:' || role || '|' || role || ']]' sign,
  CASE turn % 4 WHEN 0 THEN 'Please help. Thank you, could you look? '
    WHEN 1 THEN 'Sorry, I think we really should. By the way, good work. '
    WHEN 2 THEN 'Why? Perhaps you can you will. '
    ELSE 'Hello! Great work but so wrong. ' END opening FROM conversations)""",
    "docs": """
SELECT d.doc_id, CAST(n_chars AS DOUBLE) n_chars,
  CAST(length(regexp_replace(text, '[^.]', '', 'g')) AS DOUBLE) n_stops,
  CAST(length(regexp_replace(text, '[^,]', '', 'g')) AS DOUBLE) n_commas,
  CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END is_en,
  CAST(CASE WHEN d.doc_id % 3 <> 0 THEN n_chars % 17 END AS DOUBLE) sparse,
  1.0::DOUBLE constant, quality AS label, toxic
FROM documents d JOIN labels l USING (doc_id)""",
    "user_arrays": """
SELECT event_id revision_id, CASE WHEN user_id % 10 <> 0 THEN user_id END event_user_id,
  CASE WHEN user_id % 7 = 0 THEN 1 WHEN user_id % 11 <> 0 THEN 0 END bot_marks,
  CAST(user_id % 4 AS INTEGER) num_groups, CAST(user_id % 3 AS INTEGER) num_blocks_historical,
  CAST(user_id % 2 AS INTEGER) num_curr_blocks
FROM events""",
}


def _hours(later: str, earlier: str) -> str:
    return f"round_even(abs(coalesce(epoch_us({later}) - epoch_us({earlier}), 0))::DOUBLE / 3.6e9, 0)"


def _metrics(source: str, part: str, columns: str = "*") -> str:
    w = f"(PARTITION BY {part} ORDER BY event_timestamp, revision_id)"
    return f"""
SELECT {columns}, {_hours('event_timestamp', f'lag(event_timestamp) OVER {w}')} time_to_respond,
  {_hours(f'lead(event_timestamp) OVER {w}', 'event_timestamp')} time_responded_to,
  abs(coalesce(revision_text_bytes - lag(revision_text_bytes) OVER {w}, revision_text_bytes)) edit_size,
  CASE WHEN lead(revision_id) OVER {w} IS NULL THEN 0
    ELSE abs(lead(revision_text_bytes) OVER {w} - revision_text_bytes) END next_edit_size
FROM {source}"""


K = "template, page_id, tag_date"
KU = f"{K}, event_user_id"

_VIEWS["sample_rows"] = """
SELECT s.template, s.page_id, s.tag_date, r.* EXCLUDE (template, page_id)
FROM samples s JOIN revisions r ON r.page_id = s.page_id AND r.event_timestamp <= s.tag_date"""
_VIEWS["sample_metrics"] = _metrics("sample_rows", K)
_VIEWS["editors"] = f"SELECT DISTINCT {KU} FROM sample_rows WHERE event_user_id IS NOT NULL"
_VIEWS["article"] = f"""
SELECT s.template, s.page_id, s.tag_date, f.* EXCLUDE (template, page_id, tag_date)
FROM samples s LEFT JOIN (
  SELECT template, page_id, tag_date, avg(edit_size) edit_size, avg(time_to_respond) time_to_respond,
    CAST(floor((epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp))) / (365.2425 * 86400000000)) AS BIGINT) article_age_years,
    arg_max(revision_text_bytes, revision_id) curr_size,
    avg(CAST(revision_minor_edit AS INTEGER)) frac_minor_edits,
    arg_max(revision_text_bytes, revision_id) last_edit_size,
    count(*) num_revisions, count(DISTINCT event_user_id) num_editors,
    count(*) FILTER (WHERE event_timestamp > last_ts - INTERVAL 2 DAY) / count(*) frac_recent_revisions,
    avg(CAST(event_user_id IS NULL AS INTEGER)) frac_anon_revisions,
    count(DISTINCT event_user_id) / count(*) concentration_ratio,
    avg(edit_size) FILTER (WHERE event_timestamp > tag_date - INTERVAL 2 DAY) recent_edit_size,
    avg(time_to_respond) FILTER (WHERE event_timestamp > tag_date - INTERVAL 2 DAY) recent_response_time
  FROM (SELECT *, max(event_timestamp) OVER (PARTITION BY {K}) last_ts FROM sample_metrics) GROUP BY {K}) f
USING ({K})"""
_VIEWS["contributors"] = f"""
SELECT {K}, coalesce(max(c) / sum(c), 0) top_contributor_frac,
  coalesce(-sum(c / n * log2(c / n)), 0) + 0.0 contribution_frac_entropy
FROM (SELECT *, sum(c) OVER (PARTITION BY {K}) n FROM (
  SELECT {KU}, count(*)::DOUBLE c FROM sample_rows WHERE event_user_id IS NOT NULL GROUP BY {KU}))
GROUP BY {K}"""
_VIEWS["article_all"] = f"""
SELECT a.*, CASE WHEN num_revisions IS NOT NULL THEN coalesce(top_contributor_frac, 0) END top_contributor_frac,
  CASE WHEN num_revisions IS NOT NULL THEN coalesce(contribution_frac_entropy, 0) END contribution_frac_entropy
FROM article a LEFT JOIN contributors USING ({K})"""
_VIEWS["user_article"] = f"""
SELECT {KU}, avg(edit_size) edit_size, avg(next_edit_size) next_edit_size, avg(time_to_respond) time_to_respond,
  avg(time_responded_to) time_responded_to, count(*) num_edits, count(*) / any_value(n) frac_page_edits,
  CAST(sum(CAST(revision_is_identity_reverted AS INTEGER)) AS BIGINT) revision_is_identity_reverted,
  CAST(sum(CAST(revision_is_identity_revert AS INTEGER)) AS BIGINT) revision_is_identity_revert
FROM (SELECT *, count(*) OVER (PARTITION BY {K}) n FROM sample_metrics)
WHERE event_user_id IS NOT NULL GROUP BY {KU}"""
_VIEWS["talk_rows"] = _metrics(
    """(SELECT s.template, s.page_id, s.tag_date, r.event_timestamp, r.revision_id, r.revision_text_bytes, r.event_user_id
  FROM samples s JOIN revisions r ON r.page_id = s.talk_page_id
    AND CAST(r.event_timestamp AS DATE) <= CAST(s.tag_date AS DATE))""",
    K,
)
_VIEWS["talk_volume"] = f"""
SELECT s.template, s.page_id, s.tag_date, num_revisions, num_editors, frac_recent_revisions,
  CASE WHEN num_revisions IS NOT NULL THEN coalesce(top_contributor_frac, 0) END top_contributor_frac,
  mean_edit_size, mean_response_time, coalesce(article_n, 0) / num_revisions page_talk_ratio
FROM samples s LEFT JOIN (
  SELECT {K}, count(*) num_revisions, count(DISTINCT event_user_id) num_editors,
    count(*) FILTER (WHERE event_timestamp > last_ts - INTERVAL 2 DAY) / count(*) frac_recent_revisions,
    avg(edit_size) mean_edit_size, avg(time_to_respond) mean_response_time
  FROM (SELECT *, max(event_timestamp) OVER (PARTITION BY {K}) last_ts FROM talk_rows) GROUP BY {K}) t USING ({K})
LEFT JOIN (SELECT {K}, max(c) / sum(c) top_contributor_frac FROM (
  SELECT {KU}, count(*)::DOUBLE c FROM talk_rows WHERE event_user_id IS NOT NULL GROUP BY {KU}) GROUP BY {K}) u USING ({K})
LEFT JOIN (SELECT s.template, s.page_id, s.tag_date, count(*) article_n FROM samples s JOIN revisions r
  ON r.page_id = s.page_id AND CAST(r.event_timestamp AS DATE) <= CAST(s.tag_date AS DATE) GROUP BY ALL) a USING ({K})
WHERE s.talk_page_id IS NOT NULL"""
_VIEWS["histories"] = """
SELECT e.template, e.page_id sample_page_id, e.tag_date, h.* EXCLUDE (template)
FROM editors e JOIN revisions h ON h.event_user_id = e.event_user_id AND h.event_timestamp <= e.tag_date"""
_EK = "template, sample_page_id, tag_date, event_user_id"
_VIEWS["editor"] = f"""
SELECT template, sample_page_id page_id, tag_date, event_user_id,
  arg_max(num_groups, revision_id) num_groups, count(DISTINCT h.page_id) num_articles, count(revision_id) num_edits,
  arg_max(num_blocks_historical, revision_id) num_past_blocks, arg_max(num_curr_blocks, revision_id) num_curr_blocks,
  CAST(sum(CAST(revision_is_identity_revert AS INTEGER)) AS BIGINT) num_reverts_by_others,
  CAST(sum(CAST(revision_is_identity_reverted AS INTEGER)) AS BIGINT) num_reverts_of_others,
  CAST(date_diff('day', CAST(any_value(event_user_registration_timestamp) AS DATE), CAST(tag_date AS DATE)) AS INTEGER) time_since_registration,
  (count(*) FILTER (WHERE page_namespace = 0) + 1) / (count(*) FILTER (WHERE page_namespace = 1) + 1) talk_article_ratio,
  any_value(ent) contribution_frac_entropy
FROM histories h JOIN (
  SELECT {_EK}, -sum(c / n * log2(c / n)) + 0.0 ent FROM (
    SELECT *, sum(c) OVER (PARTITION BY {_EK}) n FROM (
      SELECT {_EK}, page_id, count(*)::DOUBLE c FROM histories GROUP BY ALL)) GROUP BY {_EK}) USING ({_EK})
GROUP BY template, sample_page_id, tag_date, event_user_id"""


def _page_users(name: str, period: str) -> None:
    _VIEWS[name] = f"""
SELECT template, sample_page_id page_id, tag_date, h.page_id edited_page_id, event_user_id,
  count(revision_id) revisions_count, arg_min(page_namespace, revision_id) page_namespace
FROM histories h WHERE event_timestamp >= tag_date - INTERVAL {period} GROUP BY ALL"""


_page_users("page_users", "1 YEAR")


def _pairs(users: str, by: str, page: str) -> str:
    keys = f"{by}, {page}" if by else page
    columns = ", ".join(f"a.{c.strip()}" for c in keys.split(","))
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(","))
    return f"""
SELECT {columns}, a.event_user_id, a.revisions_count, a.page_namespace, b.event_user_id event_user_id_r,
  b.revisions_count revisions_count_r, b.page_namespace page_namespace_r
FROM {users} a JOIN {users} b ON {on} AND a.event_user_id <> b.event_user_id"""


_VIEWS["interactions"] = _pairs("page_users", K, "edited_page_id")
_VIEWS["co_users"] = """
SELECT page_id, event_user_id, count(revision_id) revisions_count, min(page_namespace) page_namespace
FROM coedit GROUP BY page_id, event_user_id"""
_VIEWS["co_interactions"] = _pairs("co_users", "", "page_id")


def _pair_views(prefix: str, source: str, by: str, page: str) -> None:
    lead = f"{by}, " if by else ""
    _VIEWS[f"{prefix}articles"] = f"""
SELECT {lead}event_user_id, event_user_id_r, count({page}) num_common_articles,
  CAST(sum(revisions_count) AS BIGINT) num_revisions_articles
FROM {source} WHERE page_namespace = 0 GROUP BY ALL"""
    _VIEWS[f"{prefix}pages"] = f"""
SELECT {lead}event_user_id, event_user_id_r, count({page}) num_common_pages FROM {source} GROUP BY ALL"""
    _VIEWS[f"{prefix}directed"] = f"""
SELECT {lead}event_user_id, event_user_id_r,
  num_common_articles / sum(num_common_articles) OVER w coedit_ratio,
  num_revisions_articles / sum(num_revisions_articles) OVER w coedit_revisions_ratio
FROM {prefix}articles WINDOW w AS (PARTITION BY {lead}event_user_id)"""
    join = f"{lead}event_user_id, event_user_id_r"
    _VIEWS[f"{prefix}undirected"] = f"""
SELECT {lead}event_user_id user_a, event_user_id_r user_b, num_common_pages, num_common_articles
FROM {prefix}pages JOIN {prefix}articles USING ({join}) WHERE event_user_id < event_user_id_r"""


_pair_views("co_", "co_interactions", "", "page_id")
_pair_views("k_", "interactions", K, "edited_page_id")

_NAMES = (
    r"list_distinct(list_transform(regexp_extract_all(revision_text, '\{\{((?s:.*?))\}\}', 1), "
    r"lambda x: regexp_replace(split_part(x, '|', 1), '^\s+|\s+$', '', 'g')))"
)
_VIEWS["templates"] = f"SELECT * EXCLUDE (revision_text), {_NAMES} AS names FROM wikitext"
_VIEWS["tagged"] = """
SELECT page_id, replace(page_title, ' ', '_') page_title, user_id, revision_id, col, lower(col) AS template
FROM (SELECT *, unnest(names) col FROM templates)
WHERE lower(col) IN ('weasel', 'peacock', 'autobiography', 'advert', 'fanpov')"""
_HEAD = r"'(==+.*==+)\s*'"
_VIEWS["sections"] = f"""
SELECT page_id, revision_id, CAST(i - 1 AS INTEGER) sec_num, CASE WHEN i > 1 THEN heads[i - 1] END sec_name, bodies[i] sec_text
FROM (SELECT *, unnest(range(1, len(bodies) + 1)) i FROM (
  SELECT page_id, revision_id, string_split_regex(revision_text, {_HEAD}) bodies,
    regexp_extract_all(revision_text, {_HEAD}, 1) heads FROM talk_texts))"""
_SIGN = r"'(\[\[User:.+\]\])(.*\(UTC\))?(?:$|\n)'"
_VIEWS["utterances"] = rf"""
SELECT page_id, revision_id, sec_num, sec_name, utt_ind, txt AS text,
  coalesce(nullif(regexp_extract(usr, '\[\[(User:.*?)\|', 1), ''), usr) AS "user",
  coalesce(nullif(regexp_extract(dat, '(\d\d:\d\d,\s\d+\s[A-z]*\s\d{{4}})', 1), ''), 'unknown') AS date,
  CAST(length(txt) - length(ltrim(txt, ':')) AS INTEGER) indent_depth,
  CAST(page_id AS VARCHAR) || CAST(sec_num AS VARCHAR) conv_id,
  CAST(page_id AS VARCHAR) || CAST(sec_num AS VARCHAR) || '.' || CAST(utt_ind AS VARCHAR) utt_id
FROM (
  SELECT page_id, revision_id, sec_num, sec_name, CAST(j - 1 AS INTEGER) utt_ind,
    regexp_replace(CASE WHEN n > 0 THEN texts[j] ELSE sec_text END, '^\s+', '') txt,
    CASE WHEN n > 0 THEN users[j] ELSE 'unknown' END usr,
    CASE WHEN n > 0 THEN coalesce(dates[j], '') ELSE 'unknown' END dat
  FROM (SELECT *, unnest(range(1, greatest(n, 1) + 1)) j FROM (
    SELECT *, len(users) n FROM (
      SELECT *, string_split_regex(sec_text, {_SIGN}) texts, regexp_extract_all(sec_text, {_SIGN}, 1) users,
        regexp_extract_all(sec_text, {_SIGN}, 2) dates FROM sections))))"""

LEXICON = [*M.LEXICON, *M.word_table(("good", "great", "helpful"), ("bad", "wrong", "poor"))]


def _marker_columns(words: str, lexicon: list[M.Marker] = LEXICON) -> str:
    def count(marker: M.Marker, start: bool) -> str:
        return f"len(regexp_extract_all({words}, '{M.pattern(marker, start=start)}'))"

    columns = []
    for marker in lexicon:
        value = {
            "any": count(marker, False),
            "start": count(marker, True),
            "inner": f"{count(marker, False)} - {count(marker, True)}",
        }[marker.position]
        columns.append(f"CAST({value} AS INTEGER) {marker.strategy}")
    return ", ".join(columns)


def _words(text: str) -> str:
    return rf"' ' || regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"


_VIEWS["markers"] = f"""
SELECT page_id, revision_id, sec_num, utt_ind, conv_id, {_marker_columns('words')}, indent_depth reply_depth
FROM (SELECT *, {_words('text')} words FROM utterances)"""
_VIEWS["snapshots"] = """
SELECT talk_page_id, tag_date, arg_min(revision_id, (event_timestamp, revision_id)) revision_id,
  min(event_timestamp) snapshot_timestamp,
  CAST(floor((epoch_us(min(event_timestamp)) - epoch_us(tag_date)) / 86400000000) AS BIGINT) day_gap
FROM (SELECT DISTINCT talk_page_id, tag_date FROM samples WHERE talk_page_id IS NOT NULL) s
JOIN talk_texts t ON t.page_id = s.talk_page_id AND t.event_timestamp >= s.tag_date
GROUP BY talk_page_id, tag_date"""
_VIEWS["long_revisions"] = """
SELECT * REPLACE (event_timestamp + to_seconds(7 * ((epoch_us(event_timestamp) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000)) AS event_timestamp)
FROM revisions"""
for _kind in ("", "long_"):
    _VIEWS[f"{_kind}starts"] = f"SELECT page_id, min(event_timestamp) start_ts FROM {_kind}revisions GROUP BY page_id"
    _VIEWS[f"{_kind}metrics"] = _metrics(f"{_kind}revisions", "page_id")


def _daily(name: str, rows: str) -> None:
    day = "CAST(floor((epoch_us(event_timestamp) - epoch_us(start_ts)) / 86400000000) AS BIGINT)"
    _VIEWS[name] = f"""
SELECT d.page_id, d.day days_since_start, coalesce(c, 0) daily_edit_count, coalesce(v, 0) daily_edit_vol
FROM (SELECT page_id, unnest(range(min({day}), max({day}) + 1)) AS day FROM {rows} GROUP BY page_id) d
LEFT JOIN (SELECT page_id, {day} AS day, count(*) c, CAST(sum(abs(edit_size)) AS BIGINT) v FROM {rows} GROUP BY ALL) x
ON d.page_id = x.page_id AND d.day = x.day"""


_daily("daily", "(SELECT m.*, start_ts FROM metrics m JOIN starts USING (page_id))")
_daily("long_daily", "(SELECT m.*, start_ts FROM long_metrics m JOIN long_starts USING (page_id))")
_daily(
    "paired_daily",
    """(SELECT m.*, start_ts FROM long_metrics m JOIN (
  SELECT article_page_id page_id, start_ts FROM mapping JOIN long_starts ON article_page_id = page_id
  UNION ALL SELECT talk_page_id, start_ts FROM mapping JOIN long_starts ON article_page_id = page_id) USING (page_id))""",
)
for _kind in ("", "long_"):
    _VIEWS[f"{_kind}transitions"] = f"""
SELECT page_id, revision_id, event_timestamp,
  CAST(floor((epoch_us(event_timestamp) - epoch_us(start_ts)) / 86400000000) AS BIGINT) days_since_start,
  CASE WHEN change = 1 THEN 'added' ELSE 'removed' END transition
FROM (SELECT *, has_template - lag(has_template) OVER (PARTITION BY page_id ORDER BY event_timestamp, revision_id) change
  FROM {_kind}revisions) JOIN {_kind}starts USING (page_id) WHERE change IN (1, -1)"""


def _rolling(source: str, column: str, n: int) -> str:
    w = "PARTITION BY page_id ORDER BY days_since_start"
    return f"""
SELECT *, CASE WHEN row_number() OVER ({w}) >= {n}
  THEN avg({column}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) ELSE 0.0 END smoothed
FROM {source}"""


_VIEWS["paired_rolling"] = _rolling("paired_daily", "daily_edit_vol", 60)


def _rollup(columns, by: str, source: str, extra: str = "") -> str:
    parts = [
        f"avg(CAST({c} AS DOUBLE)) mean_{c}, stddev_samp(CAST({c} AS DOUBLE)) std_{c}, max(CAST({c} AS DOUBLE)) max_{c}"
        for c in columns
    ]
    return f"SELECT {by}, {', '.join(parts)}{extra} FROM {source} GROUP BY {by}"


_VIEWS["roll_user_article"] = _rollup(
    USER_ARTICLE, K, "user_article", ", -sum(frac_page_edits * log2(frac_page_edits)) + 0.0 frac_page_edits_ent"
)

DOC_FEATURES = ["n_chars", "n_stops", "n_commas", "is_en", "sparse", "constant"]
_VIEWS["correlations"] = " UNION ALL ".join(
    f"""SELECT '{c}' feature, CASE WHEN isnan(r) THEN NULL ELSE r END score, abs(CASE WHEN isnan(r) THEN NULL ELSE r END) AS abs
FROM (SELECT CASE WHEN stddev_samp({c}) FILTER ({c} IS NOT NULL) = 0 THEN NULL ELSE corr({c}, label) END r FROM docs)"""
    for c in DOC_FEATURES
)
_BUCKET = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6))::BIGINT % 4 AS INTEGER)"
VERTEX_FEATURES = EDITOR
_VF = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) {c}" for c in VERTEX_FEATURES)
_VIEWS["vertices"] = f"""
SELECT {K}, event_user_id vertex, {_VF} FROM editor SEMI JOIN k_directed USING ({K})"""
_VIEWS["edges"] = f"SELECT {K}, event_user_id src, event_user_id_r dst, coedit_ratio, coedit_revisions_ratio FROM k_directed"
_VIEWS["loops"] = f"SELECT * FROM edges UNION ALL SELECT {K}, vertex, vertex, 0.0::DOUBLE, 0.0::DOUBLE FROM vertices"
_VIEWS["out_degree"] = f"SELECT {K}, src vertex, sqrt(greatest(1, count(*))) d FROM loops GROUP BY {K}, src"
_VIEWS["in_degree"] = f"SELECT {K}, dst vertex, sqrt(greatest(1, count(*))) d FROM loops GROUP BY {K}, dst"


def _hop(source: str) -> str:
    sums = ", ".join(f"sum(x.{c} / (o.d * i.d)) {c}" for c in VERTEX_FEATURES)
    return f"""
SELECT l.template, l.page_id, l.tag_date, l.dst vertex, {sums}
FROM loops l JOIN {source} x ON {_on('l', 'x')} AND x.vertex = l.src
JOIN out_degree o ON {_on('l', 'o')} AND o.vertex = l.src JOIN in_degree i ON {_on('l', 'i')} AND i.vertex = l.dst
GROUP BY ALL"""


def _on(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("template", "page_id", "tag_date"))


_VIEWS["hop1"], _VIEWS["hop2"], _VIEWS["hop3"] = _hop("vertices"), _hop("hop1"), _hop("hop2")

_KEEP = (
    "page_id, page_title, page_namespace, revision_id, event_timestamp, event_user_id, revision_text_bytes"
)

_REFERENCES = ", ".join(
    "('{}', '{}')".format(name[:-1], plain.replace("'", "''")) for name, plain in sorted(html5.items()) if name.endswith(";")
)

_FINAL = {
    "scan_revisions": f"SELECT {_KEEP} FROM revisions WHERE revision_id % 2 = 0",
    "parquet_roundtrip": "SELECT * FROM tagged",
    "json_roundtrip": f"SELECT {_KEEP}, template FROM revisions",
    "read_revisions": f"SELECT {_KEEP} FROM revisions",
    "read_labels": "SELECT page_id, tag_date FROM samples",
    "partition_by_page": f"SELECT {_KEEP} FROM revisions",
    "load_all": f"SELECT {_KEEP}, template, has_template FROM revisions",
    "feature_document": "SELECT * FROM user_article",
    "feature_manifest": f"""SELECT {K}, count(event_user_id) n_items, min(event_user_id) first_user, max(event_user_id) last_user
FROM samples LEFT JOIN user_article USING ({K}) GROUP BY {K}""",
    "conversation_document": """SELECT s.template, s.page_id, s.tag_date, talk_page_id, sec_name, revision_id, sec_num, utt_ind, utt_id id, conv_id, "user" speaker,
  try_strptime(date, '%H:%M, %d %B %Y') AS time, text, indent_depth reply_depth, NULL::VARCHAR reply_to
FROM samples s JOIN snapshots USING (talk_page_id, tag_date) JOIN utterances u USING (revision_id)""",
    "snapshot_export": """SELECT template, talk_page_id, tag_date, revision_id, t.page_id, event_timestamp revision_timestamp, revision_text
FROM (SELECT DISTINCT template, talk_page_id, tag_date FROM samples) s JOIN snapshots USING (talk_page_id, tag_date) JOIN talk_texts t USING (revision_id)""",
    "talk_export": """SELECT t.*, g.template FROM talk_texts t
JOIN (SELECT DISTINCT template, 'Talk:' || replace(page_title, '_', ' ') page_title FROM tagged) g USING (page_title)""",
    "resume_pending": "SELECT * FROM samples WHERE tag_date >= TIMESTAMP '2024-01-21'",
    "blp_pages": "SELECT DISTINCT page_id, page_namespace FROM revisions WHERE page_namespace = 0",
    "semi_by_ids": f"SELECT {_KEEP} FROM revisions SEMI JOIN samples USING (page_id)",
    "normalise_titles": "SELECT page_id, replace(page_title, ' ', '_') title_stored, replace(page_title, '_', ' ') title_spaced, "
    "'Talk:' || replace(page_title, '_', ' ') title_talk FROM revisions",
    "by_template": "SELECT template, count(*) n, count(DISTINCT revision_id) revisions, count(DISTINCT page_title) pages FROM tagged GROUP BY template",
    "exclude_users": f"SELECT {_KEEP} FROM revisions WHERE event_user_id NOT IN (8, 46)",
    "exclude_bots": "SELECT revision_id, event_user_id FROM user_arrays WHERE bot_marks = 0",
    "array_sizes": "SELECT revision_id, event_user_id, num_groups, num_blocks_historical, num_curr_blocks FROM user_arrays",
    "asof_cut": f"SELECT {K}, event_timestamp, revision_id FROM sample_rows",
    "asof_cut_day": """SELECT s.template, s.page_id, s.tag_date, r.event_timestamp, r.revision_id FROM samples s
JOIN revisions r ON r.page_id = s.page_id AND CAST(r.event_timestamp AS DATE) <= CAST(s.tag_date AS DATE)""",
    "trailing_year": f"SELECT {K}, event_timestamp, revision_id FROM sample_rows WHERE event_timestamp BETWEEN tag_date - INTERVAL 1 YEAR AND tag_date",
    "edits_pre_tag": """SELECT page_id, revision_id, event_timestamp, has_template, top = 1 has_tag
FROM (SELECT *, max(has_template) OVER (PARTITION BY page_id) top,
  coalesce(sum(has_template) OVER (PARTITION BY page_id ORDER BY event_timestamp, revision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) seen,
  row_number() OVER (PARTITION BY page_id ORDER BY event_timestamp, revision_id) rn FROM revisions)
WHERE CASE WHEN top = 1 THEN seen = 0 ELSE rn = 1 END""",
    "sample_editors": f"SELECT {KU} FROM editors",
    "talk_activity": """SELECT t.page_id, t.page_title, t.revision_id, t.event_timestamp, g.template FROM talk_texts t
JOIN (SELECT DISTINCT template, 'Talk:' || replace(page_title, '_', ' ') page_title FROM tagged) g USING (page_title)""",
    "history_subset": f"SELECT {_KEEP} FROM revisions WHERE page_title IN (SELECT page_title FROM tagged)",
    "flag_has_template": """SELECT r.page_id, r.page_title, r.revision_id, r.event_timestamp, g.template,
  CASE WHEN h.revision_id IS NULL THEN 0 ELSE 1 END has_template
FROM revisions r JOIN (SELECT DISTINCT template, page_title FROM tagged) g USING (page_title)
LEFT JOIN (SELECT DISTINCT template, revision_id FROM tagged) h ON h.template = g.template AND h.revision_id = r.revision_id""",
    "attach_talk_page": f"SELECT {K}, label, m.talk_page_id FROM samples s LEFT JOIN mapping m ON m.article_page_id = s.page_id",
    "labels_with_talk": f"SELECT {K}, label, m.talk_page_id FROM samples s JOIN mapping m ON m.article_page_id = s.page_id",
    "sample_revisions": f"SELECT {K}, event_timestamp, revision_id, event_user_id, revision_text_bytes FROM sample_rows",
    "page_user_counts": "SELECT * FROM page_users",
    "pair_articles": "SELECT * FROM co_articles",
    "pair_pages": "SELECT * FROM co_pages",
    "directed_features": "SELECT * FROM co_directed",
    "undirected_features": "SELECT * FROM co_undirected",
    "concentration_ratios": """SELECT page_id, event_user_id, revision_id, num_editors, num_revisions, num_editors / num_revisions concentration_ratio
FROM revisions JOIN (SELECT page_id, count(DISTINCT event_user_id) num_editors, count(event_user_id) num_revisions
  FROM revisions GROUP BY page_id HAVING count(event_user_id) > 0) USING (page_id)""",
    "concentration_ratios_pairs": """SELECT page_id, count(DISTINCT event_user_id) num_editors, CAST(sum(revisions_count) AS BIGINT) num_revisions,
  count(DISTINCT event_user_id) / sum(revisions_count) concentration_ratio FROM co_interactions GROUP BY page_id""",
    "nearest_snapshot": "SELECT * FROM snapshots",
    "combined_features": f"""SELECT s.*, a.num_revisions article_num_revisions, a.edit_size article_edit_size,
  v.page_talk_ratio talk_page_talk_ratio, u.mean_num_edits user_mean_num_edits, u.frac_page_edits_ent user_frac_page_edits_ent
FROM samples s LEFT JOIN article_all a USING ({K}) LEFT JOIN talk_volume v USING ({K}) LEFT JOIN roll_user_article u USING ({K})""",
    "article_features": "SELECT * FROM article_all",
    "user_article_features": "SELECT * FROM user_article",
    "editor_features": "SELECT * FROM editor",
    "talk_article_ratio": """SELECT event_user_id, (count(*) FILTER (WHERE page_namespace = 0) + 1) /
  (count(*) FILTER (WHERE page_namespace = 1) + 1) talk_article_ratio FROM revisions WHERE event_user_id IS NOT NULL GROUP BY event_user_id""",
    "editor_page_entropy": """SELECT event_user_id, -sum(c / n * log2(c / n)) + 0.0 contribution_frac_entropy FROM (
  SELECT *, sum(c) OVER (PARTITION BY event_user_id) n FROM (SELECT event_user_id, page_id, count(*)::DOUBLE c FROM revisions
    WHERE event_user_id IS NOT NULL GROUP BY ALL)) GROUP BY event_user_id""",
    "daily_activity": "SELECT * FROM daily",
    "talk_volume_features": "SELECT * FROM talk_volume",
    "rollup_user_article": "SELECT * FROM roll_user_article",
    "rollup_language": _rollup(
        [m.strategy for m in LEXICON] + ["reply_depth"],
        "template, page_id, tag_date",
        f"(SELECT s.template, s.page_id, s.tag_date, m.* EXCLUDE (page_id) FROM samples s JOIN snapshots n USING (talk_page_id, tag_date) "
        "JOIN markers m USING (revision_id))",
    ),
    "rollup_editor": _rollup(EDITOR, K, "editor"),
    "rollup_collab": f"""SELECT * FROM ({_rollup(['num_common_pages', 'num_common_articles'], K, 'k_undirected')})
LEFT JOIN ({_rollup(['coedit_ratio', 'coedit_revisions_ratio'], K, 'k_directed')}) USING ({K})""",
    "row_counts": """SELECT 'revisions' AS name, count(*) n FROM revisions UNION ALL SELECT 'samples', count(*) FROM samples
UNION ALL SELECT 'tagged', count(*) FROM tagged""",
    "page_metrics": "SELECT page_id, revision_id, time_to_respond, time_responded_to, edit_size, next_edit_size FROM metrics",
    "rolling_activity": _rolling("long_daily", "daily_edit_vol", 60),
    "template_transitions": "SELECT * FROM transitions",
    "talk_vs_article_activity": """SELECT article_page_id, side, r.days_since_start, smoothed, ln(1 + smoothed) log_smoothed,
  coalesce(template_added, 0) template_added, coalesce(template_removed, 0) template_removed
FROM paired_rolling r JOIN (SELECT article_page_id page_id, article_page_id, 'article' side FROM mapping
  UNION ALL SELECT talk_page_id, article_page_id, 'talk' FROM mapping) p USING (page_id)
LEFT JOIN (SELECT page_id article_page_id, days_since_start, CAST(max(CAST(transition = 'added' AS INTEGER)) AS INTEGER) template_added,
  CAST(max(CAST(transition = 'removed' AS INTEGER)) AS INTEGER) template_removed FROM long_transitions GROUP BY ALL) t
USING (article_page_id, days_since_start)""",
    "ordered_export": f"SELECT {_KEEP}, template FROM revisions",
    "clustered_export": f"SELECT {_KEEP} FROM revisions",
    "feature_correlations": "SELECT * FROM correlations",
    "top_correlations": "SELECT * FROM correlations ORDER BY abs DESC NULLS LAST, feature LIMIT 3",
    "labelled_union": f"""SELECT {K}, num_revisions, NULL::DOUBLE edit_size, 0 AS label FROM article_all JOIN samples s USING ({K}) WHERE s.label = 0
UNION ALL SELECT {K}, num_revisions, edit_size, 1 FROM article_all JOIN samples s USING ({K}) WHERE s.label = 1""",
    "extract_templates": "SELECT revision_id, array_to_string(list_sort(names), '|') AS templates, CAST(len(names) AS INTEGER) n_templates FROM templates",
    "reliability_templates": """SELECT revision_id, array_to_string(list_sort(list_filter(names,
  lambda x: lower(x) IN ('weasel', 'peacock', 'autobiography', 'advert', 'fanpov'))), '|') AS templates FROM templates
WHERE len(list_filter(names, lambda x: lower(x) IN ('weasel', 'peacock', 'autobiography', 'advert', 'fanpov'))) > 0""",
    "revisions_with_template": "SELECT * FROM tagged",
    "html_to_text": rf"""SELECT page_id, string_agg(CASE WHEN i = 1 THEN piece
    WHEN plain IS NOT NULL THEN plain || substr(piece, length(ref) + 2)
    WHEN point IS NULL THEN '&' || piece
    WHEN point < 1 OR point > 1114111 OR point BETWEEN 55296 AND 57343 THEN chr(65533) || substr(piece, length(ref) + 2)
    ELSE chr(CAST(point AS INTEGER)) || substr(piece, length(ref) + 2) END, '' ORDER BY i) AS text
FROM (SELECT *, CASE WHEN ref[1] <> '#' THEN NULL WHEN lower(ref[2]) = 'x' THEN TRY_CAST('0x' || substr(ref, 3) AS BIGINT)
    ELSE TRY_CAST(substr(ref, 2) AS BIGINT) END point
  FROM (SELECT *, CASE WHEN contains(piece, ';') THEN split_part(piece, ';', 1) END ref
    FROM (SELECT page_id, i, pieces[i] piece FROM (SELECT *, unnest(range(1, len(pieces) + 1)) i FROM (
      SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'),
        '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '&') pieces FROM pages WHERE html IS NOT NULL))))
  LEFT JOIN (VALUES {_REFERENCES}) AS names(ref, plain) USING (ref))
GROUP BY page_id UNION ALL SELECT page_id, NULL FROM pages WHERE html IS NULL""",
    "talk_sections": "SELECT * FROM sections",
    "talk_utterances": "SELECT * FROM utterances",
    "utterance_details": r"""SELECT page_id, revision_id, sec_num, utt_ind, utt_id id, conv_id, "user" speaker,
  try_strptime(date, '%H:%M, %d %B %Y') AS time, text, indent_depth reply_depth, NULL::VARCHAR reply_to FROM utterances""",
    "speakers": 'SELECT DISTINCT "user" speaker FROM utterances',
    "politeness_markers": "SELECT * FROM markers",
    "comment_politeness": f"""SELECT page_id, revision_id, usr AS "user", {_marker_columns('words')}
FROM (SELECT page_id, revision_id, coalesce(CAST(event_user_id AS VARCHAR), 'none') usr, {_words("coalesce(event_comment, '')")} words FROM revisions)""",
    "word_list_counts": f"""SELECT doc_id, {_marker_columns('words', M.LEXICON)}, coalesce(positive, 0) positive, coalesce(negative, 0) negative
FROM (SELECT doc_id, {_words("coalesce(text, '')")} words FROM documents) LEFT JOIN (
  SELECT doc_id, CAST(count(*) FILTER (WHERE kind = 1) AS INTEGER) positive, CAST(count(*) FILTER (WHERE kind = 0) AS INTEGER) negative
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) word FROM documents) JOIN (
    SELECT word, min(quality) kind FROM (
      SELECT quality, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) word FROM documents JOIN labels USING (doc_id))
    GROUP BY word HAVING min(quality) = max(quality)) USING (word)
  GROUP BY doc_id) USING (doc_id)""",
    "train_test_split": f"SELECT doc_id, label, {_BUCKET} = 0 is_test FROM docs",
    "standard_scale": """SELECT doc_id, is_test, (n_chars - m1) / s1 n_chars, (n_commas - m2) / s2 n_commas, constant - m3 AS constant
FROM (SELECT *, """ + _BUCKET + """ = 0 is_test FROM docs) CROSS JOIN (
  SELECT avg(n_chars) m1, stddev_pop(n_chars) s1, avg(n_commas) m2, stddev_pop(n_commas) s2, avg(constant) m3
  FROM docs WHERE """ + _BUCKET + " <> 0)",
    "roc_auc": """SELECT sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) roc_auc FROM (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM (
    SELECT n_chars, count(*) FILTER (WHERE label = 1) pos, count(*) FILTER (WHERE label = 0) neg FROM docs GROUP BY n_chars))""",
    "confusion_matrix": """SELECT label y_true, count(*) FILTER (WHERE n_chars <= 300) predicted_0,
  count(*) FILTER (WHERE n_chars > 300) predicted_1 FROM docs GROUP BY label""",
    "f1_accuracy": """SELECT 2 * count(*) FILTER (WHERE p AND label = 1) / (count(*) FILTER (WHERE p) + count(*) FILTER (WHERE label = 1)) f1,
  count(*) FILTER (WHERE p = (label = 1)) / count(*) accuracy, count(*) n FROM (SELECT n_chars > 300 p, label FROM docs)""",
    "graph_vertices": "SELECT * FROM vertices",
    "graph_edges": "SELECT * FROM edges",
    "graph_self_loops": "SELECT * FROM loops",
    "graph_propagate": "SELECT * FROM hop3",
    "graph_message_sum": f"""SELECT l.template, l.page_id, l.tag_date, l.dst vertex, {', '.join(f'sum({c}) sum_{c}' for c in [*VERTEX_FEATURES, 'coedit_ratio', 'coedit_revisions_ratio'])}
FROM loops l JOIN vertices v ON {_on('l', 'v')} AND v.vertex = l.src GROUP BY ALL""",
    "graph_readout": f"SELECT {K}, {', '.join(f'avg({c}) mean_{c}' for c in VERTEX_FEATURES)} FROM hop3 GROUP BY {K}",
}


def _logistic(source: str, key: str, features: list[str], buckets: int, steps: int = 80) -> str:
    """Held-out scores of the penalised regression, found by damped Newton steps from zero.

    Each step adds up gradient and curvature over the training rows and solves the linear system by
    elimination, one nested query per column.
    """
    size = len(features) + 1
    key_text = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in key.split(", ")) + ")"
    bucket = f"('0x' || substr(md5({key_text}), 1, 6))::BIGINT % {buckets}"
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) f{i}" for i, c in enumerate(features))
    stats = ", ".join(f"avg(f{i}) m{i}, coalesce(nullif(stddev_pop(f{i}), 0), 1) s{i}" for i in range(size - 1))
    scaled = ", ".join(f"(f{i} - m{i}) / s{i}" for i in range(size - 1))
    slope = [f"sum((p - y) * x[{i}])" + (f" + w[{i}] / 10000" if i > 1 else "") for i in range(1, size + 1)]
    bend = [
        [f"sum(p * (1 - p) * x[{i}] * x[{j}])" + (" + 1 / 10000" if i == j > 1 else "") for j in range(1, size + 1)]
        for i in range(1, size + 1)
    ]
    system = ", ".join("[" + ", ".join([*row, slope[i]]) + "]" for i, row in enumerate(bend))
    solved = f"""SELECT step, w, [{', '.join(slope)}] g, [{system}] a FROM (
      SELECT step, w, x, y, 1 / (1 + exp(-list_dot_product(w, x))) p FROM fitted, train WHERE step < {steps}) GROUP BY step, w"""
    for k in range(1, size + 1):
        solved = f"""SELECT step, w, g, list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = {k}
      THEN list_transform(a[{k}], lambda v: v / a[{k}][{k}])
      ELSE list_transform(range(1, {size + 2}), lambda j: a[i][j] - a[i][{k}] * a[{k}][j] / a[{k}][{k}]) END) a FROM ({solved})"""
    return f"""WITH RECURSIVE filled AS MATERIALIZED (SELECT {key}, label, {bucket} = 0 held, {filled} FROM {source}),
prepared AS MATERIALIZED (SELECT {key}, label, held, [1.0::DOUBLE, {scaled}] x FROM filled CROSS JOIN (SELECT {stats} FROM filled WHERE NOT held)),
train AS MATERIALIZED (SELECT CAST(label AS DOUBLE) y, x FROM prepared WHERE NOT held),
fitted AS (
  SELECT 0 step, list_transform(range({size}), lambda i: 0.0::DOUBLE) w
  UNION ALL
  SELECT step + 1, list_transform(range(1, {size + 1}), lambda i: w[i] - d[i] / (1 + sqrt(greatest(list_dot_product(g, d), 0)))) FROM (
    SELECT step, w, g, list_transform(a, lambda r: r[{size + 1}]) d FROM ({solved})))
SELECT {key}, label, 1 / (1 + exp(-list_dot_product(w, x))) score, CAST(list_dot_product(w, x) > 0 AS INTEGER) prediction
FROM prepared CROSS JOIN (SELECT w FROM fitted ORDER BY step DESC LIMIT 1) WHERE held"""


_FINAL["logreg_scores"] = _logistic("docs", "doc_id", DOC_FEATURES, 4)
_FINAL["graph_logreg"] = _logistic(
    f"(SELECT r.*, s.label FROM ({_FINAL['graph_readout']}) r JOIN samples s USING ({K}))", K, [f"mean_{c}" for c in VERTEX_FEATURES], 5
)

ARTICLE_FEATURES = (
    "edit_size time_to_respond article_age_years curr_size frac_minor_edits last_edit_size num_revisions num_editors frac_recent_revisions "
    "frac_anon_revisions concentration_ratio recent_edit_size recent_response_time top_contributor_frac contribution_frac_entropy"
).split()
TALK_FEATURES = "num_revisions num_editors frac_recent_revisions top_contributor_frac mean_edit_size mean_response_time page_talk_ratio".split()


def _experiments() -> str:
    sides = {"article": ("article_all", ARTICLE_FEATURES), "talk": ("talk_volume", TALK_FEATURES)}
    sets = {name: {name: side} for name, side in sides.items()} | {"combined": sides}
    scored = []
    for name, chosen in sets.items():
        columns = [f"{side}_{c}" for side, (_, features) in chosen.items() for c in features]
        picked = ", ".join(f"{side}.{c} {side}_{c}" for side, (_, features) in chosen.items() for c in features)
        joined = " ".join(f"LEFT JOIN {view} {side} USING ({K})" for side, (view, _) in chosen.items())
        fitted = _logistic(f"(SELECT {K}, label, {picked} FROM samples {joined})", K, columns, 4)
        scored.append(f"SELECT '{name}' feature_set, label, score, prediction FROM ({fitted})")
    return f"""WITH scored AS MATERIALIZED ({' UNION ALL '.join(scored)}),
counts AS (SELECT feature_set, count(*) FILTER (WHERE label = 0 AND prediction = 0) tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) tp, count(*) n
  FROM scored GROUP BY feature_set),
area AS (SELECT feature_set, sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) roc_auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature_set ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM (
    SELECT feature_set, score, count(*) FILTER (WHERE label = 1) pos, count(*) FILTER (WHERE label = 0) neg FROM scored GROUP BY ALL)) GROUP BY feature_set)
SELECT feature_set, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1, (tp + tn) / n accuracy, n, roc_auc, tn, fp, fn, tp
FROM counts JOIN area USING (feature_set)"""


_FINAL["experiment_blocks"] = _experiments()


def _used(text: str) -> list[str]:
    """Views a text refers to, in definition order, with what they refer to in turn."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & _VIEWS.keys() - found:
            found.add(name)
            todo.append(_VIEWS[name])
    return [name for name in _VIEWS if name in found]


def _rounded(name: str, body: str) -> str:
    views = _used(body)
    ctes = ",\n".join(f"{v} AS ({_VIEWS[v]})" for v in [*views])
    lead = f"WITH {ctes},\n" if ctes else "WITH "
    return f"{lead}answer AS ({body})\nSELECT {_columns(name)} FROM answer"


# Columns rounded to 6 digits in both engines.
_DOUBLES = {
    "concentration_ratios": "concentration_ratio",
    "concentration_ratios_pairs": "concentration_ratio",
    "directed_features": "coedit_ratio coedit_revisions_ratio",
    "combined_features": "article_edit_size talk_page_talk_ratio user_mean_num_edits user_frac_page_edits_ent",
    "article_features": "edit_size time_to_respond frac_minor_edits frac_recent_revisions top_contributor_frac frac_anon_revisions "
    "concentration_ratio contribution_frac_entropy recent_edit_size recent_response_time",
    "user_article_features": "edit_size next_edit_size time_to_respond time_responded_to frac_page_edits",
    "editor_features": "talk_article_ratio contribution_frac_entropy",
    "talk_article_ratio": "talk_article_ratio",
    "editor_page_entropy": "contribution_frac_entropy",
    "talk_volume_features": "frac_recent_revisions top_contributor_frac mean_edit_size mean_response_time page_talk_ratio",
    "page_metrics": "time_to_respond time_responded_to",
    "rolling_activity": "smoothed",
    "talk_vs_article_activity": "smoothed log_smoothed",
    "feature_correlations": "score abs",
    "top_correlations": "score abs",
    "labelled_union": "edit_size",
    "standard_scale": "n_chars n_commas constant",
    "feature_document": "edit_size next_edit_size time_to_respond time_responded_to frac_page_edits",
    "experiment_blocks": "f1 accuracy roc_auc",
    "logreg_scores": "score",
    "graph_logreg": "score",
    "roc_auc": "roc_auc",
    "f1_accuracy": "f1 accuracy",
    "graph_vertices": " ".join(VERTEX_FEATURES),
    "graph_edges": "coedit_ratio coedit_revisions_ratio",
    "graph_self_loops": "coedit_ratio coedit_revisions_ratio",
    "graph_propagate": " ".join(VERTEX_FEATURES),
    "graph_message_sum": " ".join(f"sum_{c}" for c in [*VERTEX_FEATURES, "coedit_ratio", "coedit_revisions_ratio"]),
    "graph_readout": " ".join(f"mean_{c}" for c in VERTEX_FEATURES),
    "rollup_user_article": "frac_page_edits_ent",
}


def _columns(name: str) -> str:
    doubles = _DOUBLES.get(name, "").split()
    if name.startswith("rollup_"):
        # Every mean_, std_ and max_ column is a double.
        source = _FINAL[name] if "mean_" in _FINAL[name] else _VIEWS["roll_user_article"]
        doubles += dict.fromkeys(re.findall(r"\b((?:mean|std|max)_\w+)", source))
    replaced = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles]
    return "* REPLACE (" + ", ".join(replaced) + ")" if replaced else "*"


def oracle_sql() -> dict[str, str]:
    return {name: _rounded(name, body) for name, body in _FINAL.items()}


# Twins whose results are too many rows to compare on whole tables: tests use them on the smallest ones.
_LARGE = {
    "user_interactions": "SELECT * FROM interactions",
}


def large_sql() -> dict[str, str]:
    return {name: _rounded(name, body) for name, body in _LARGE.items()}
