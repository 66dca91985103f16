"""SQL for the numbered operators that SQL can express, over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op13_block_names"] = """
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY plain) AS group_size,
  row_number() OVER (PARTITION BY plain ORDER BY points DESC, doc_id) = 1 AS kept,
  sha256(plain) AS text_sha256
FROM texts
"""


def _half_byte_checksums() -> list[int]:
    """CRC-32 of each half byte, by its rule: shift right, and fold the polynomial in where a bit falls out."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def crc32_sql(decimal: str) -> str:
    """Unsigned CRC-32 of a decimal number's digits; null for null."""
    halves = (
        f"flatten(list_transform(string_split({decimal}, ''), "
        "lambda c: [(ord(c) & 15)::BIGINT, (ord(c) >> 4)::BIGINT]))"
    )
    step = f"lambda a, n: xor({_half_byte_checksums()}[(xor(a, n) & 15) + 1]::BIGINT, a >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), {step}), 4294967295::BIGINT)"


def _encoded(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(v) for v in ("doc_id", "source", "lang", chars, "text")) + ")"


_UP = """list_transform(range(0, (len(nodes) + 1) // 2),
    lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"""
_BESIDE = "t.nodes[xor(w.place, 1) + 1]"
_FOLDED = f"""sha256(CASE WHEN {_BESIDE} IS NULL THEN w.node
    WHEN w.place % 2 = 0 THEN w.node || {_BESIDE} ELSE {_BESIDE} || w.node END)"""

# Trees as lists that shrink level by level; rows walk up them one level at a time.
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL
      THEN {_leaf("n_chars + 1")} END AS altered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
trees AS (
  SELECT lang, list(leaf ORDER BY place) AS nodes, 0 AS level FROM leaves GROUP BY lang
  UNION ALL SELECT lang, {_UP}, level + 1 FROM trees WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM trees WHERE len(nodes) = 1),
upper_tree AS (
  SELECT list(subroot ORDER BY place) AS nodes, 0 AS level FROM subroots
  UNION ALL SELECT {_UP}, level + 1 FROM upper_tree WHERE len(nodes) > 1),
walk AS (
  SELECT doc_id, lang, leaf, place, 0 AS level, coalesce(altered, leaf) AS node, '' AS siblings FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.place // 2, w.level + 1, {_FOLDED}, w.siblings || coalesce({_BESIDE}, '')
  FROM walk w JOIN trees t ON w.lang IS NOT DISTINCT FROM t.lang AND w.level = t.level AND len(t.nodes) > 1),
arrived AS (
  SELECT w.doc_id, w.leaf, s.subroot, s.place, 0 AS level, w.node, w.siblings
  FROM walk w JOIN trees t ON w.lang IS NOT DISTINCT FROM t.lang AND w.level = t.level AND len(t.nodes) = 1
  JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.place // 2, w.level + 1, {_FOLDED}, w.siblings || coalesce({_BESIDE}, '')
  FROM arrived w JOIN upper_tree t ON w.level = t.level AND len(t.nodes) > 1)
SELECT a.doc_id, a.leaf, a.subroot, t.nodes[1] AS root, sha256(a.siblings) AS proof_sha256,
  a.node AS folded_root, a.node = t.nodes[1] AS verified
FROM arrived a JOIN upper_tree t ON a.level = t.level AND len(t.nodes) = 1
"""

# Every prefix as a list; sums over a subtree by way of each node's own prefixes.
ORACLE["op12_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST) AS said,
    {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS taken_from
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.said[1:o.h], []), o.said[o.h + 1:]) AS said
  FROM own o LEFT JOIN own b ON b.conv_id = o.taken_from),
starts AS (
  SELECT conv_id, d AS depth, said[1:d] AS prefix, len(said) AS turns
  FROM (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(prefix[depth].text)) END AS saved
  FROM starts GROUP BY prefix, depth),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT prefix[1:d] AS prefix, saved, leaf FROM (
    SELECT n.prefix, n.saved, c.n IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS d
    FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix)),
sums AS (SELECT prefix, sum(saved) AS saved, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves FROM above GROUP BY prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix
LEFT JOIN children c ON c.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""
