"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import chat, licenses, mixing, spelling, trie

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LICENSE_SCAN = rf"""
WITH phrase(number, label, is_base, w) AS (VALUES {", ".join(
    f"({i}, '{label}', {i < len(licenses.BASE_PHRASES)}, {text.split()})" for i, (text, label) in enumerate([*licenses.BASE_PHRASES, *licenses.TEMPLATES])
)}),
sized AS (SELECT *, CASE WHEN len(w) >= {licenses.LONG_WORDS} THEN 4 ELSE 2 END AS k FROM phrase),
gram AS (SELECT number, label, is_base, k, len(w) - k + 1 AS n, CASE WHEN is_base THEN 0 WHEN k = 2 THEN {licenses.SHIFT} ELSE {licenses.LONG_SHIFT} END AS reach,
  unnest(range(len(w) - k + 1)) AS spot, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS g FROM sized),
size AS (SELECT DISTINCT number, label, is_base, n, reach FROM gram),
lack AS (SELECT a.number, list(a.spot) AS spots FROM gram a JOIN size b ON a.label <> b.label AND NOT a.is_base AND NOT b.is_base
  WHERE a.g NOT IN (SELECT g FROM gram c WHERE c.number = b.number) GROUP BY a.number, b.number, a.n HAVING count(*) <= {1 - licenses.SIBLING} * a.n),
lacks AS (SELECT number, list(spots) AS lacks FROM lack GROUP BY number),
doc AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS place FROM doc),
roll AS (SELECT r, place, a || ' ' || lead(a) OVER o AS pair, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o || ' ' || lead(a, 3) OVER o AS four
  FROM word WINDOW o AS (PARTITION BY r ORDER BY place)),
hit AS (SELECT r, number, place - spot AS diagonal, spot, place FROM roll JOIN gram ON g = pair UNION
  SELECT r, number, place - spot, spot, place FROM roll JOIN gram ON g = four),
span AS (SELECT v.r, v.number, v.diagonal, count(DISTINCT u.spot) AS seen,
  list({{'at': u.spot, 'place': u.place, 'taken': [u.spot]}} ORDER BY u.spot, u.place) AS votes
  FROM (SELECT DISTINCT r, number, diagonal, reach FROM hit JOIN size USING (number)) v
  JOIN hit u ON u.r = v.r AND u.number = v.number AND u.diagonal BETWEEN v.diagonal - v.reach AND v.diagonal + v.reach GROUP BY ALL),
walk AS (SELECT *, seen / n AS share, CASE WHEN is_base THEN 1 ELSE {licenses.COVER} END AS least,
  list_reduce(votes, lambda s, v: CASE WHEN v.at > s.at AND v.place > s.place THEN {{'at': v.at, 'place': v.place, 'taken': list_concat(s.taken, v.taken)}} ELSE s END).taken AS taken
  FROM span JOIN size USING (number)),
held AS (SELECT *, len(taken) >= least * n AND (lacks IS NULL
  OR len(list_filter(lacks, lambda m: len(list_intersect(taken, m)) < {licenses.COVER} * len(m))) = 0) AS holds FROM walk LEFT JOIN lacks USING (number)),
found AS (SELECT r, count(*) FILTER (WHERE is_base AND holds) AS n_base, min(diagonal) FILTER (WHERE is_base AND holds) AS first_word,
  max(diagonal) FILTER (WHERE is_base AND holds) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE is_base AND holds))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE holds))), ',') AS labels, max(share) AS score FROM held GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM doc LEFT JOIN found USING (r)"""

BYTE_REPEATS = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
byte AS (SELECT r, unnest(regexp_extract_all(x, '..')) AS b, unnest(range(len(x) // 2)) AS i FROM doc),
start AS (SELECT r, i, b, CASE WHEN count(*) OVER ahead = 200 THEN md5(string_agg(b, '') OVER ahead) END AS s FROM byte
  WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING)),
flag AS (SELECT r, i, b, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS twice FROM start),
cover AS (SELECT r, i, b, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS 199 PRECEDING) AS gone FROM flag),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM cover),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
  coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS rest FROM run GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)"""

WORD_REPEATS = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc),
start AS (SELECT r, i, word, count(*) OVER ahead AS n, md5(string_agg(word, ' ') OVER ahead) AS s FROM word
  WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
flag AS (SELECT r, i, word, n = 35 AND count(*) OVER (PARTITION BY s, n) > 1 AS twice FROM start),
cover AS (SELECT r, i, word, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS 34 PRECEDING) AS gone FROM flag),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS rest FROM cover GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)"""

_KEY = "concat_ws(':', '42', coalesce(doc_id::VARCHAR, 'null'), tie, row_number() OVER (PARTITION BY doc_id, source, tie) - 1)"
MIXING = f"""
WITH word AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS n_tokens, md5(coalesce(text, '')) AS tie FROM documents),
token AS (SELECT *, {_KEY} AS k FROM word),
source AS (SELECT source AS s, count(*) AS n_docs, sum(n_tokens)::DOUBLE / sum(sum(n_tokens)) OVER () AS p FROM token GROUP BY source),
-- The exponent in closed form: the widest ratio of shares may fill the limit.
power AS (SELECT max(p) AS top, greatest(0, 1 - ln({mixing.REPEAT_LIMIT}) / ln(nullif(greatest(max(p) / min(p) FILTER (WHERE p > 0), 1), 1))) AS a FROM source),
plan AS (SELECT s, CASE WHEN p > 0 THEN round(pow(top / p, 1 - coalesce(a, 0)), 6) ELSE 1 END AS passes, ceil(n_docs / {mixing.BLOCK_DOCS})::BIGINT AS n_blocks,
  CASE WHEN p > 0 THEN pow(p, coalesce(a, 0)) ELSE 0 END / sum(CASE WHEN p > 0 THEN pow(p, coalesce(a, 0)) ELSE 0 END) OVER () AS weight FROM source, power),
copy AS (SELECT *, ('0x' || left(md5(k), 8))::BIGINT % n_blocks AS block, unnest(range(CASE WHEN n_tokens > 0 THEN ceil(passes)::BIGINT ELSE 1 END)) AS epoch
  FROM token JOIN plan ON source IS NOT DISTINCT FROM s),
ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block, epoch) AS every,
  sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY md5(concat_ws(':', epoch, k)) ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM copy)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, block, round(weight, 9) AS weight,
  round((epoch + coalesce(before::DOUBLE / nullif(every, 0), 0)) / passes, 9) AS slot
FROM ranked WHERE epoch < floor(passes) OR epoch = 0 OR before + n_tokens / 2 <= (passes - epoch) * every"""

# CRC-32 of a string by its bytes, from a table made by the polynomial's rule.
_CRC_TABLE = """
crc_table AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) t(i))"""


def _crc(text: str) -> str:
    """SQL of the unsigned CRC-32 of ``text``, with ``tab`` in scope."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS d, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
once AS (SELECT d, w, count(*) AS n FROM run WHERE len(w) >= {spelling.LEAST_LENGTH} GROUP BY ALL),
crc AS (SELECT w, n, {_crc("d || ':' || w")} AS h FROM once, crc_table),
cut AS (SELECT CASE WHEN h % {spelling.TYPO} = 0 THEN left(w, h % len(w)) || substr(w, h % len(w) + 2) ELSE w END AS word, n FROM crc),
vocab AS (SELECT word, sum(n)::BIGINT AS n, len(word) AS l FROM cut WHERE len(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
place AS (SELECT word, n, unnest(range(l)) AS i FROM vocab),
hole AS (SELECT word, n, i, left(word, i) || '?' || substr(word, i + 2) AS swap, left(word, i) || substr(word, i + 2) AS less FROM place),
pair AS (SELECT a.word, b.word AS near FROM hole a JOIN hole b ON a.swap = b.swap AND a.word <> b.word
  UNION SELECT word, less FROM hole WHERE less IN (SELECT word FROM vocab) UNION SELECT less, word FROM hole WHERE less IN (SELECT word FROM vocab)),
near AS (SELECT pair.word, count(*) AS n_near, arg_min(near, (-b.n, near)) AS best, max(b.n) AS most FROM pair JOIN vocab b ON near = b.word GROUP BY pair.word),
form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.RATIO} * n THEN best END AS form, CASE WHEN most >= {spelling.RATIO} * n THEN most END AS form_n
  FROM vocab LEFT JOIN near USING (word)),
path AS (SELECT word, word AS root FROM form UNION ALL SELECT path.word, form.form FROM path JOIN form ON path.root = form.word WHERE form.form IS NOT NULL),
last AS (SELECT path.word, root FROM path JOIN form ON root = form.word WHERE form.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM form JOIN last USING (word)"""

PREFIX_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
turn AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) - 1 AS pos,
  md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest, len({_WORDS}) AS n_words FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, conv_id - conv_id % {trie.BLOCK} AS base, {_crc("conv_id::VARCHAR")} % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turn), crc_table),
part AS (SELECT c.conv_id, 0 AS own, pos, digest, n_words FROM conv c JOIN turn t ON t.conv_id = base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, digest, n_words FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND pos >= h),
step AS (SELECT conv_id, n_words, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS total
  FROM part WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
every AS (SELECT conv_id, depth, prefix, n_words, depth = total AS ends FROM step
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM step) FROM conv),
node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_words) AS n_words,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM every GROUP BY depth, prefix),
family AS (SELECT node.*, up.conv_id AS parent_conv_id, count(kid.depth) AS n_children FROM node
  LEFT JOIN node up ON up.depth = node.depth - 1 AND up.prefix = left(node.prefix, 32 * (node.depth - 1))
  LEFT JOIN node kid ON kid.depth = node.depth + 1 AND left(kid.prefix, 32 * node.depth) = node.prefix GROUP BY ALL),
above AS (SELECT unnest(range(depth + 1)) AS depth, prefix, n_children = 0 AS leaf, (n_convs - 1) * n_words AS saved FROM family),
total AS (SELECT depth, left(prefix, 32 * depth) AS prefix, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM family JOIN total USING (depth, prefix)"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT = f"""
WITH turn AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
said AS (SELECT *, md5(md5(role) || md5(text)) AS tie,
  len(CASE role WHEN 'user' THEN '[INST]  [/INST]' WHEN 'assistant' THEN ' </s>' ELSE '[ROLE][/ROLE]  [END]' || {_escaped("role")} END || {_escaped("text")}) AS n FROM turn)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + 3)::BIGINT AS formatted_chars, 0::BIGINT AS rewrites
FROM said GROUP BY conv_id"""

ORACLE_SQL = {
    "op3_license_scan": LICENSE_SCAN,
    "op5_suffix_dedup": BYTE_REPEATS,
    "op8_mixing": MIXING,
    "op9_fm_dedup": WORD_REPEATS,
    "op11_spelling_variants": SPELLING,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_chat_formatting": CHAT,
}
