"""The queries of ``checks.queries`` in plain SQL, for comparison on another engine.

Formulated apart from the Spark plans: term matching is containment over all pairs, rules run
one statement per pattern, arrays are rows.  Expressions that RE2 treats as ASCII (word
boundaries) run on text whose other letters are masked by an underscore.
"""

from __future__ import annotations

from vacancylake.functions import cards, spotting, text
from vacancylake.operators.fuzzy import THRESHOLD
from vacancylake.operators.term_match import SCORED
from vacancylake.sources.postings import DERIVED_FROM, DERIVED_POSTINGS_SQL
from vacancylake.sources.vocabulary import DICTIONARIES, flatten

WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
WORD = r"[\pL\pM\p{Nd}\p{Nl}_]"
NON_ASCII = r"[^\x00-\x7F]"


def q(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {replacement}, 'g')"


def strip(expr: str) -> str:
    return sub(expr, rf"^{WS}+|{WS}+$", "''")


def unescape(expr: str) -> str:
    for entity, char in [("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&middot;", "chr(183)"),
                         ("&copy;", "chr(169)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")]:
        expr = f"replace({expr}, '{entity}', {char})"
    return expr


def tags(expr: str) -> str:
    for tag in (rf"<br{WS}*/?>", "</?p[^>]*>", "</?div[^>]*>"):
        expr = sub(expr, "(?i)" + tag, "chr(10)")
    expr = sub(expr, "(?i)</?li[^>]*>", "chr(10) || '• '")
    for tag in ("</?ul[^>]*>", "</?ol[^>]*>"):
        expr = sub(expr, "(?i)" + tag, "chr(10)")
    return sub(expr, "<[^>]+>", "' '")


def symbols(expr: str) -> str:
    return sub(expr, rf"(?m)^{WS}*[•·▪▫◦‣⁃]{WS}*", "'• '")


def numbers(expr: str) -> str:
    return sub(expr, rf"(?m)^{WS}*(?:\p{{Nd}}+\.|{WORD}\)|{WORD}\.){WS}+", "'• '")


def punctuation(expr: str) -> str:
    expr = sub(expr, rf"{WS}+([,.!?;:])", r"'\1'")
    return sub(expr, rf"([.!?]){WS}*([A-Z])", r"'\1 \2'")


def clean(expr: str) -> str:
    body = numbers(symbols(tags(unescape(expr))))
    body = strip(punctuation(strip(sub(body, WS + "+", "' '"))))
    return f"CASE WHEN length({strip(expr)}) >= 10 THEN {body} ELSE '' END"


def normalized(expr: str) -> str:
    return strip(sub(sub(f"lower({expr})", r"[/\-_.]", "' '"), WS + "+", "' '"))


def match_form(expr: str) -> str:
    return f"trim({sub(f'lower({expr})', r'[^\pL\pM\pN+#]+', chr(39) + ' ' + chr(39))})"


def masked(expr: str) -> str:
    """Text on which ASCII word boundaries are right; two words with marks are kept readable."""
    kept = f"replace(replace({expr}, 'triệu', 'trizzu'), 'đồng', 'dzzng')"
    return sub(kept, r"[^\PLA-Za-z]", "'_'")


def unmasked(expr: str) -> str:
    return f"replace(replace({expr}, 'trizzu', 'triệu'), 'dzzng', 'đồng')"


# --- common table expressions

_POSTINGS = DERIVED_POSTINGS_SQL.format(**{t: t for t in DERIVED_FROM})
POSTINGS = f"postings AS MATERIALIZED ({_POSTINGS})"
CLEANED = f"cleaned AS MATERIALIZED (SELECT job_id, {clean('description')} AS c FROM postings)"
LONG = f"coalesce(length({strip('description')}), 0) >= 50"
BASE = f"WITH {POSTINGS}, {CLEANED}"


def terms_cte() -> str:
    rows = ",\n".join(
        "(" + ", ".join(q(v) for v in (*t, n)) + ")" for n, t in enumerate(flatten(DICTIONARIES))
    )
    form = match_form("alias")
    return (
        f"terms AS MATERIALIZED (SELECT *, {form} AS form FROM (VALUES {rows}) "
        "v(dict, category, subcategory, term, weight, alias, alias_pos, place))"
    )


def matches_cte(source: str = "cleaned", key: str = "job_id", column: str = "c") -> str:
    return f"""{terms_cte()},
forms AS MATERIALIZED (SELECT {key}, ' ' || {match_form(column)} || ' ' AS t FROM {source}),
found AS MATERIALIZED (SELECT f.{key}, d.form
  FROM forms f JOIN (SELECT DISTINCT form FROM terms) d ON contains(f.t, ' ' || d.form || ' ')),
hits AS (SELECT f.{key}, t.*,
  row_number() OVER (PARTITION BY f.{key}, dict, term ORDER BY alias_pos) AS rn
  FROM found f JOIN terms t USING (form)),
matches AS MATERIALIZED (SELECT {key}, dict, term AS keyword, alias AS matched_text,
  CASE WHEN alias_pos = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS score,
  CASE WHEN alias_pos = 0 THEN 'exact' ELSE 'alias' END AS match_type,
  category, weight::DOUBLE AS weight, subcategory, place FROM hits WHERE rn = 1)"""


def spotted_cte() -> str:
    rows = ", ".join(
        f"({q(label)}, {q(p)})" for label in spotting.LABELS for p in spotting.token_forms(label)
    )
    return f"""phrases AS (SELECT * FROM (VALUES {rows}) v(label, value)),
spotted AS MATERIALIZED (SELECT DISTINCT f.job_id, label, value FROM forms f
  JOIN phrases p ON contains(f.t, ' ' || p.value || ' '))"""


ENRICHED = f"{BASE}, {matches_cte()}, {spotted_cte()}, ok AS MATERIALIZED (SELECT job_id FROM postings WHERE {LONG})"
# Per posting: how many matches of each dictionary, NULL when it was too short to process.
_N = ", ".join(
    f"count(*) FILTER (dict = {q(d)}) AS n_{d}" for d in DICTIONARIES
)
COUNTS = f"""{ENRICHED}, per_job AS MATERIALIZED (SELECT o.job_id,
  {", ".join(f"coalesce(n_{d}, 0) AS n_{d}" for d in DICTIONARIES)},
  coalesce(n_seniority, 0) AS n_seniority,
  {", ".join(f"coalesce(s_{label}, 0) AS s_{label}" for label in spotting.LABELS)}
  FROM ok o
  LEFT JOIN (SELECT job_id, {_N}, count(*) FILTER (dict = 'vietnamese_keywords'
    AND category = 'seniority_levels') AS n_seniority FROM matches GROUP BY job_id) m USING (job_id)
  LEFT JOIN (SELECT job_id, {", ".join(f"count(*) FILTER (label = {q(x)}) AS s_{x}" for x in spotting.LABELS)}
    FROM spotted GROUP BY job_id) s USING (job_id))"""
VN = "dict = 'vietnamese_keywords'"
SEN = f"{VN} AND category = 'seniority_levels'"
EXT = "dict = 'extended_technologies'"
PROCESSED_MATCHES = "(SELECT m.* FROM matches m JOIN ok USING (job_id))"

# The patterns as the rules state them, each run on its own.
_MONTH = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
_URL = r'[^\s<>"{}|\\^`\[\]]+'
_DEG = r"\s*(?:degree)?\b"
RULE_PATTERNS = {
    "dates": [
        r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b",
        r"\b\d{1,2}\.\d{1,2}\.\d{4}\b",
        rf"(?i)\b(?:{_MONTH})\s+\d{{4}}\b",
        r"(?i)\b(?:immediately|asap|urgent|within\s+\d+\s+(?:days?|weeks?|months?))\b",
    ],
    "durations": [
        r"(?i)\b\d+[-+]?\s*(?:to\s+\d+\s*)?years?\s*(?:of\s*)?(?:experience|exp)\b",
        r"(?i)\b\d+\s*[-–]\s*\d+\s*years?\b",
        r"(?i)\b\d+\+?\s*years?\b",
        r"(?i)\b\d+[-+]?\s*(?:to\s+\d+\s*)?months?\s*(?:of\s*)?(?:experience|exp)\b",
        r"(?i)\b(?:\d+\s*(?:month|year)s?\s*contract|contract\s*(?:for\s*)?\d+\s*(?:month|year)s?)\b",
    ],
    "emails": [r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"],
    "urls": [rf"(?i)https?://{_URL}", rf"(?i)www\.{_URL}"],
    "phone_numbers": [
        r"\(\d{3}\)\s*\d{3}[-\s]?\d{4}\b",
        r"\b\d{3}[-\s]?\d{3}[-\s]?\d{4}\b",
        r"\+\d{1,3}[-\s]?\d{1,4}[-\s]?\d{1,4}[-\s]?\d{1,9}",
        r"(?:\+84|0)\d{9,10}\b",
    ],
    "salaries": [
        r"(?i)\$\d{1,3}(?:,\d{3})*(?:\s*[-–]\s*\$?\d{1,3}(?:,\d{3})*)?"
        r"(?:\s*(?:USD|per\s*year|annually|pa))?",
        r"(?i)\$\d{1,3}[kK](?:\s*[-–]\s*\$?\d{1,3}[kK])?",
        r"(?i)\b\d{1,3}[kK]?\s*[-–]\s*\d{1,3}[kK]?\s*(?:USD|dollars?|per\s*year|annually)\b",
        r"(?i)\b\d{1,3}(?:\s*[-–]\s*\d{1,3})?\s*(?:trizzu|tr|million)\s*(?:VND|dzzng)?\b",
        r"(?i)\$\d{1,3}(?:\s*[-–]\s*\$?\d{1,3})?\s*(?:per\s*hour|/hour|/hr|hourly)",
    ],
    "work_arrangements": [
        r"(?i)\b(?:remote|work\s*from\s*home|wfh|telecommute|telework)\b",
        r"(?i)\b(?:hybrid|flexible|mixed)\b",
        r"(?i)\b(?:on-site|onsite|office|in-person)\b",
        r"(?i)\b(?:full-time|fulltime|full\s*time|ft)\b",
        r"(?i)\b(?:part-time|parttime|part\s*time|pt)\b",
        r"(?i)\b(?:contract|contractor|freelance|temporary|temp)\b",
    ],
    "education_levels": [
        rf"(?i)\b(?:bachelor'?s?|bs|undergraduate){_DEG}",
        r"(?i)\bba\s*degree\b",
        rf"(?i)\b(?:master'?s?|ms|mba|graduate){_DEG}",
        r"(?i)\bma\s*degree\b",
        rf"(?i)\b(?:phd|ph\.d|doctorate|doctoral){_DEG}",
        rf"(?i)\b(?:associate'?s?|aa){_DEG}",
        r"(?i)\bas\s*degree\b",
        r"(?i)\b(?:high\s*school|diploma|ged)\b",
    ],
}


def rule_rows(kind: str, source: str, key: str, column: str) -> str:
    """Distinct ``(key, value)`` rows of a kind."""
    value = unmasked("v")
    if kind == "phone_numbers":
        value = sub(strip(value), WS + "+", "'-'")
    elif kind == "work_arrangements":
        value = f"lower({value})"
    elif kind == "education_levels":
        value = strip(f"lower({value})")
    parts = " UNION ALL ".join(
        f"SELECT {key}, unnest(regexp_extract_all({column}, {q(p)})) AS v FROM {source}"
        for p in RULE_PATTERNS[kind]
    )
    return f"SELECT DISTINCT {key}, {value} AS value FROM ({parts})"


MASKED = f"{BASE}, masked AS MATERIALIZED (SELECT job_id, {masked('c')} AS x FROM cleaned)"
ALL_RULES = "rules AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT job_id, {q(k)} AS kind, value FROM ({rule_rows(k, 'masked', 'job_id', 'x')})"
    for k in RULE_PATTERNS
) + ")"
MASKED_CTES = f"masked AS MATERIALIZED (SELECT job_id, {masked('c')} AS x FROM cleaned), {ALL_RULES}"
DOCUMENT_RULES = f"WITH masked AS MATERIALIZED (SELECT doc_id, {masked('text')} AS x FROM documents) " + (
    " UNION ALL ".join(
        f"SELECT doc_id, {q(k)} AS kind, value FROM ({rule_rows(k, 'masked', 'doc_id', 'x')})"
        for k in RULE_PATTERNS
    )
)


def section(expr: str, headers: str) -> str:
    pattern = rf"(?is)(?:{headers}){WS}*:?{WS}*\n(.*?)\n(?:[A-Z][^:]*:|$)"
    return (
        f"CASE WHEN regexp_matches({expr}, {q(pattern)})"
        f" THEN regexp_extract({expr}, {q(pattern)}, 1) END"
    )


_SECTIONED = """WITH t AS MATERIALIZED (SELECT doc_id, 'Overview:' || chr(10) || lang || ' posting' || chr(10)
  || 'Requirements:' || chr(10) || '• 3+ years of experience, MBA' || chr(10) || replace(text, ':', ' ')
  || chr(10) || 'Benefits:' || chr(10) || 'remote work, ' || source || chr(10) || 'Contact: none' || chr(10) AS t
  FROM documents)"""


def _per_section(kind: str) -> str:
    found = " || ".join(f"regexp_extract_all({masked('r')}, {q(p)})" for p in RULE_PATTERNS[kind])
    value = f"[lower(trim(x)) for x in {found}]" if kind != "durations" else found
    return f"CASE WHEN r IS NOT NULL THEN len(list_distinct({value}))::INTEGER END AS {kind}"


_CONTEXT_ROWS = ", ".join(f"({q(c)}, {i})" for i, c in enumerate(spotting.SKILL_CONTEXTS))
_CONTEXTUAL = f"""WITH {POSTINGS}, extra AS (SELECT job_id, description
  || ' Experience with Spark, Kafka; Hive and Oozie, Flink. Skilled in ' || lower(title)
  || ', of and go! Knowledge of ' || lower(location) || '.' || chr(10) AS d FROM postings),
c AS (SELECT job_id, lower({clean('d')}) AS c FROM extra),
s AS (SELECT job_id, unnest(string_split({sub('c', rf'([.!?]){WS}+', chr(39) + chr(92) + '1' + chr(39) + ' || chr(1)')}, chr(1))) AS s FROM c),
h AS (SELECT job_id, string_split_regex(regexp_extract(s, ctx || '{WS}+([^.]+)', 1), '[,;]|\\band\\b') AS items
  FROM s, (VALUES {_CONTEXT_ROWS}) v(ctx, n)),
k AS (SELECT job_id, list_slice([trim(i) for i in items if length(trim(i)) > 2
  AND trim(i) NOT IN ({", ".join(q(w) for w in spotting.NO_SKILL)})], 1, 3) AS kept FROM h)
SELECT DISTINCT job_id, unnest(kept) AS value FROM k"""

_SUBSTRINGS = ", ".join(f"({q(k)}, {q(v)})" for k, vs in spotting.SUBSTRINGS.items() for v in vs)

# Words and phrases of up to four words, each distinct one against every long enough term.
_WINDOWS = " UNION ALL ".join(
    f"SELECT job_id, {n} AS words, unnest(list_distinct([array_to_string(list_slice(w, i, i + {n - 1}), ' ')"
    f" for i in range(1, len(w) - {n - 2})])) AS phrase FROM toks"
    for n in (1, 2, 3, 4)
)
# Bits of the places where the common subsequence does not grow; phrases have under 62 letters.
_PLACES = """list_transform(string_split(phrase, ''), lambda ch: list_sum(list_transform(range(length(form)),
  lambda i: CASE WHEN substr(form, (i + 1)::INTEGER, 1) = ch THEN 1::BIGINT << i::INTEGER ELSE 0 END))::BIGINT)"""
_OPEN = "((1::BIGINT << length(form)::INTEGER) - 1)"
_COMMON = f"""length(form) - bit_count(list_reduce(list_prepend({_OPEN}, {_PLACES}),
  lambda v, m: ((v + (v & m)) | (v & ~m)) & {_OPEN}))"""
# This engine counts edits of bytes, so letters of two or three bytes become signs that no phrase holds.
_LONG_LETTERS = "".join(
    sorted({c for t in flatten(DICTIONARIES) for c in t.alias.lower() if c.isalpha() and ord(c) > 127}
           | {chr(c) for c in range(0xDF, 0x100) if c != 0xF7})
)
_FREE_SIGNS = "".join(
    c for c in map(chr, [*range(65, 91), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(1, 32)])
    if c not in "+#'"
)
assert len(_LONG_LETTERS) <= len(_FREE_SIGNS)


def one_byte(expr: str) -> str:
    return f"translate({expr}, {q(_LONG_LETTERS)}, {q(_FREE_SIGNS[: len(_LONG_LETTERS)])})"


_EDITS = f"levenshtein({one_byte('phrase')}, {one_byte('form')})"
_SCORES = {
    "levenshtein": f"1 - {_EDITS}::DOUBLE / greatest(length(phrase), length(form))",
    "ratio": f"round(200.0::DOUBLE * ({_COMMON}) / (length(phrase) + length(form))) / 100.0",
}


def fuzzy_cte(scorer: str) -> str:
    """``fuzzy``: best score of every term and text; edits never exceed insertions and deletions."""
    cutoff = THRESHOLD - 0.005 if scorer == "ratio" else THRESHOLD
    return f"""toks AS (SELECT job_id, string_split({match_form('c')}, ' ') AS w FROM cleaned),
windows AS MATERIALIZED ({_WINDOWS}),
vocabulary AS (SELECT DISTINCT words, phrase FROM windows WHERE phrase <> ''),
targets AS (SELECT DISTINCT dict, term, category, subcategory, weight, form, len(string_split(form, ' ')) AS words
  FROM terms WHERE alias_pos = 0 AND form <> ''),
close AS MATERIALIZED (SELECT v.words, phrase, t.* EXCLUDE (words) FROM vocabulary v JOIN targets t ON v.words = t.words
  AND CASE WHEN abs(length(phrase) - length(form)) <= (1 - {cutoff}) * (length(phrase) + length(form)) + 1e-9
    THEN {_EDITS} <= (1 - {cutoff}) * (length(phrase) + length(form)) + 1e-9 ELSE FALSE END),
pairs AS MATERIALIZED (SELECT *, {_SCORES[scorer]} AS score FROM close),
fuzzy AS MATERIALIZED (SELECT job_id, dict, term AS keyword, category, subcategory, weight::DOUBLE AS weight, max(score) AS score
  FROM windows JOIN pairs USING (words, phrase) WHERE score >= {THRESHOLD} GROUP BY ALL),
spelt AS MATERIALIZED (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.job_id, dict, keyword ORDER BY category) AS rn
  FROM fuzzy f ANTI JOIN matches m USING (job_id, dict, keyword)) WHERE rn = 1)"""


_FUZZY = f"""{BASE}, {matches_cte()}, {fuzzy_cte("levenshtein")}
SELECT job_id, dict, keyword, round(max(score), 9) AS score FROM fuzzy GROUP BY ALL"""
_FUZZY_RATIO = f"""{BASE}, {matches_cte()}, {fuzzy_cte("ratio")}
SELECT job_id, dict, keyword, matched_text, score, match_type, category, weight, subcategory FROM matches
UNION ALL SELECT job_id, dict, keyword, keyword, score, 'fuzzy', category, weight, subcategory FROM spelt"""
_FUZZY_COUNTS = f"""{BASE}, {matches_cte()}, {fuzzy_cte("ratio")},
every AS (SELECT job_id, dict, keyword, score, category FROM matches UNION ALL SELECT job_id, dict, keyword, score, category FROM spelt)
SELECT job_id, {", ".join(f"count(*) FILTER (dict = '{d}')::INTEGER AS {d}" for d in DICTIONARIES)},
  coalesce(string_agg(dict || ':' || keyword || ':' || score, '|' ORDER BY dict || ':' || keyword || ':' || score), '') AS found
FROM postings LEFT JOIN every USING (job_id) WHERE {LONG} GROUP BY job_id"""

_PART_ALIASES = "[p_brand || ' ' || p_type, p_brand || ' size ' || p_size]"
_URL_OF = "'https://jobs.example.org/view/' || CAST(c_custkey * 17 AS STRING)"
_WANTED = f"wanted AS (SELECT DISTINCT {_URL_OF} AS url FROM customer)"
_TOPCV_DONE = "(url IS NULL OR url NOT IN (SELECT url FROM postings WHERE source = 'topcv'))"
_DESCRIBED = "description IS NOT NULL AND description <> ''"
_NER = """least(least((s_skills + s_roles + s_technologies + s_responsibilities + s_qualifications) / 10.0, 1.0)
  + ((s_skills > 0)::INT + (s_roles > 0)::INT + (s_technologies > 0)::INT + (s_responsibilities > 0)::INT
  + (s_qualifications > 0)::INT) / 6.0 * 0.2, 1.0)"""
_NER = f"CASE WHEN s_skills + s_roles + s_technologies + s_responsibilities + s_qualifications = 0 THEN 0.0 ELSE {_NER} END"
_SCORED_SQL = "(" + ", ".join(q(s) for s in SCORED) + ")"
_DETAILED = f"""names AS (SELECT job_id,
  list(keyword ORDER BY keyword) FILTER ({VN}) AS vn,
  coalesce(list(keyword ORDER BY keyword) FILTER ({SEN}), []) AS sen,
  count(*) FILTER ({EXT}) AS ext FROM {PROCESSED_MATCHES} GROUP BY job_id),
detailed AS (SELECT p.*, vn, sen, ext FROM postings p JOIN names USING (job_id)
  WHERE source = 'linkedin' AND len(vn) > 0)"""


def _card(site: str, salary: str = "NULL::VARCHAR", posted: str = "NULL::VARCHAR") -> str:
    return (
        f"WITH {POSTINGS} SELECT job_id, title, company, location, url, {salary} AS salary,"
        f" {posted} AS posted_at FROM postings WHERE source = '{site}'"
    )


def _search(site: str) -> str:
    page, keyword, location = cards.SEARCH_PAGES[site]
    return (
        f"SELECT '{site}' AS site, keyword, location, '{page}?{keyword}=' || replace(keyword, ' ', '+')"
        f" || '&{location}=' || replace(location, ' ', '+') AS url FROM asked"
    )


_RECORD_RULES = ["dates", "durations", "emails", "urls", "phone_numbers"]
ERROR_LENGTH = 2_000


def _values(table: str, by: str, value: str, names, prefix: str = "") -> str:
    """The values of each name in alphabetical order, as one text."""
    return ", ".join(
        f"string_agg({table}.{value}, '|' ORDER BY {table}.{value}) FILTER ({by} = '{n}') AS {prefix}{n}" for n in names
    )


def _oracle() -> dict[str, str]:
    p = f"WITH {POSTINGS}"
    sql = {
        "scan_by_source": f"{p} SELECT job_id, title, url FROM postings WHERE source = 'linkedin'",
        "scan_limit": f"{p} SELECT job_id, title FROM postings WHERE source = 'itviec' ORDER BY job_id LIMIT 25",
        "count_by_source": f"{p} SELECT count(*) AS n FROM postings WHERE source = 'linkedin'",
        "count_per_source": f"{p} SELECT source, count(*) AS n FROM postings GROUP BY source",
        "known_urls": f"{p} SELECT DISTINCT url FROM postings WHERE url <> ''",
        "with_description": f"{p} SELECT job_id FROM postings WHERE {_DESCRIBED}",
        "minimum_length": f"{p} SELECT job_id, " + ", ".join(
            f"coalesce(length({strip('description')}), 0) >= {n} AS at_least_{n}" for n in (10, 20, 50)
        ) + " FROM postings",
        "previews": f"{p} SELECT job_id, left(description, 100) AS p100, left(description, 150) AS p150,"
        " left(description, 200) AS p200, left(title, 40) AS t40, coalesce(company, 'Unknown') AS company FROM postings",
        "missing_field": f"{p} SELECT job_id FROM postings WHERE salary IS NULL",
        "not_yet_processed": f"{p} SELECT job_id, url FROM postings WHERE {_DESCRIBED} AND {_TOPCV_DONE}",
        "not_yet_processed_by_shuffle": f"{p} SELECT job_id, url FROM postings WHERE {_DESCRIBED} AND {_TOPCV_DONE}",
        "wanted_urls_found": f"{p}, {_WANTED} SELECT job_id, url FROM postings WHERE url IN (SELECT url FROM wanted)",
        "wanted_urls_missing": f"{p}, {_WANTED} SELECT url FROM wanted EXCEPT SELECT url FROM postings",
        "wanted_urls_processed": f"{COUNTS}, {_WANTED} SELECT job_id, TRUE AS done, s_skills AS skills"
        " FROM per_job JOIN postings USING (job_id) WHERE url IN (SELECT url FROM wanted)",
        "keyed_update": f"{p} SELECT job_id, title, CASE WHEN o_orderstatus = 'F' THEN 'Filled' ELSE company END"
        " AS company, CASE WHEN o_orderstatus = 'F' THEN TRUE END AS closed"
        " FROM postings JOIN orders ON job_id = o_orderkey",
        "repeated_updates": f"{p} SELECT job_id, title, coalesce('Line ' || m, company) AS company FROM postings"
        " LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON job_id = l_orderkey",
        "appended_twice": f"{p} SELECT source, count(*) AS n, sum(length(description))::BIGINT AS chars FROM postings GROUP BY 1",
        "json_written": f"{p} SELECT job_id, title, company, url FROM postings",
        "dictionary_from_table": "SELECT 'parts' AS dict, p_type AS category, p_brand AS subcategory,"
        " p_name AS term, 1.0::DOUBLE AS weight, unnest([p_name, p_brand, p_type]) AS alias,"
        " unnest([0, 1, 2])::INTEGER AS alias_pos FROM part",
        "dictionary_from_json": f"""WITH e AS (SELECT p_type, p_name, p_brand, {_PART_ALIASES} AS aliases FROM part),
one AS (SELECT p_type, p_name, arg_max(e, '{{"category":"' || p_brand || '","aliases":["' || array_to_string(aliases, '","') || '"]}}') AS e
  FROM e GROUP BY p_type, p_name),
l AS (SELECT p_type, p_name, e.p_brand AS b, list_prepend(p_name, e.aliases) AS a FROM one)
SELECT 'parts' AS dict, p_type AS category, b AS subcategory, p_name AS term, 1.0::DOUBLE AS weight,
  unnest(a) AS alias, unnest(range(len(a)))::INTEGER AS alias_pos FROM l""",
        "enriched_with_user_dictionary": f"""WITH {POSTINGS},
named AS (SELECT job_id, description || ' Handles ' || p_name || ', ' || p_brand || ' ' || p_type || '.' AS description
  FROM postings JOIN part ON job_id % (SELECT count(*) FROM part) + 1 = p_partkey),
texts AS MATERIALIZED (SELECT job_id, ' ' || {match_form(clean('description'))} || ' ' AS t FROM named WHERE {LONG}),
aliases AS (SELECT p_type AS category, p_name AS term, unnest(list_prepend(p_name, {_PART_ALIASES})) AS alias,
  unnest([0, 1, 2])::INTEGER AS alias_pos FROM part),
forms AS MATERIALIZED (SELECT *, {match_form('alias')} AS form FROM aliases),
words AS (SELECT DISTINCT job_id, unnest(string_split(trim(t), ' ')) AS head FROM texts),
hits AS (SELECT job_id, f.* FROM words JOIN forms f ON head = string_split(form, ' ')[1] JOIN texts USING (job_id)
  WHERE contains(t, ' ' || form || ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY job_id, term ORDER BY alias_pos, category, alias) AS rn FROM hits)
SELECT job_id, term || '|' || CASE alias_pos WHEN 0 THEN 'exact' ELSE 'alias' END || '|' || alias AS value FROM best WHERE rn = 1""",
        "clean_descriptions": f"{BASE} SELECT job_id, c FROM cleaned",
        "clean_pages": f"SELECT page_id, {clean('html')} AS c FROM pages",
        "clean_documents": f"SELECT doc_id, {clean('text')} AS c FROM documents",
        "decode_entities": f"SELECT page_id, {unescape('html')} AS t FROM pages",
        "tags_to_layout": f"SELECT page_id, {tags('html')} AS t FROM pages",
        "bullets": f"SELECT doc_id, {symbols('text')} AS symbols, {numbers('text')} AS numbers FROM documents",
        "special_characters": r"""WITH pieces AS (SELECT doc_id, regexp_extract_all(text,
  '(?s)https?://[^\s]+|www\.[^\s]+|.') AS p FROM documents)
SELECT doc_id, array_to_string([CASE WHEN length(x) > 1 OR regexp_matches(x,
  '[\pL\pM\pN_\s.,!?\-:;()\[\]"''/+=@#$%&*]') THEN x ELSE ' ' END for x in p], '') AS t FROM pieces""",
        "whitespace_and_punctuation": f"SELECT doc_id, {sub('text', WS + '+', chr(39) + ' ' + chr(39))} AS one_line, "
        + punctuation(strip(sub("text", rf"{WS}*\n{WS}*", "chr(10)"))) + " AS tidy FROM documents",
        "normalized_text": f"SELECT doc_id, {normalized('text')} AS normalized, {match_form('text')} AS match_form FROM documents",
        "cleaning_stats": f"""{BASE}, s AS (SELECT job_id, length(description) AS o, length(c) AS n,
  {strip('description')} AS d, {strip('c')} AS e FROM cleaned JOIN postings USING (job_id) WHERE description IS NOT NULL)
SELECT job_id, o::INTEGER AS original_length, n::INTEGER AS cleaned_length,
  CASE WHEN o > 0 THEN 1 - n / o ELSE 0.0 END AS reduction_ratio,
  CASE WHEN d = '' THEN 0 ELSE len(string_split_regex(d, '{WS}+')) END::INTEGER AS original_words,
  CASE WHEN e = '' THEN 0 ELSE len(string_split_regex(e, '{WS}+')) END::INTEGER AS cleaned_words FROM s""",
        "sections": f"{_SECTIONED} SELECT doc_id, " + ", ".join(
            f"{strip(section('t', h))} AS {n}" for n, h in text.SECTION_HEADERS.items()
        ) + " FROM t",
        "requirements_section": f"{_SECTIONED}, s AS (SELECT doc_id, "
        + section("t", text.SECTION_HEADERS["requirements"] + rf"|must{WS}*have")
        + f" AS r FROM t) SELECT doc_id, {strip('r')} AS raw_requirements, "
        + ", ".join(_per_section(k) for k in ("durations", "education_levels", "work_arrangements"))
        + " FROM s",
        "rules_on_documents": DOCUMENT_RULES,
        "contact_info": f"""{BASE}, {MASKED_CTES} SELECT job_id,
  coalesce(string_agg(value, '|' ORDER BY value) FILTER (kind = 'emails'), '') AS emails,
  coalesce(string_agg(value, '|' ORDER BY value) FILTER (kind = 'phone_numbers'), '') AS phone_numbers,
  coalesce(string_agg(value, '|' ORDER BY value) FILTER (kind = 'urls'), '') AS urls
  FROM cleaned LEFT JOIN rules USING (job_id) GROUP BY job_id""",
        "extraction_summary": f"{BASE}, {MASKED_CTES} SELECT job_id, " + ", ".join(
            f"count(*) FILTER (kind = '{k}')::INTEGER AS {k}_count" for k in RULE_PATTERNS
        ) + " FROM cleaned LEFT JOIN rules USING (job_id) GROUP BY job_id",
        "token_patterns": f"{ENRICHED} SELECT job_id, label, value FROM spotted",
        "contextual_skills": _CONTEXTUAL,
        "substring_keywords": f"{BASE} SELECT job_id, kind, value FROM cleaned"
        f" JOIN (VALUES {_SUBSTRINGS}) v(kind, value) ON contains(lower(c), value)",
        "substring_mode": f"{BASE} SELECT job_id, count(value) FILTER (kind = 'skills')::INTEGER AS skills,"
        " 0 AS responsibilities, 0.5::DOUBLE AS ner_confidence FROM cleaned"
        f" LEFT JOIN (VALUES {_SUBSTRINGS}) v(kind, value) ON contains(lower(c), value) GROUP BY job_id",
        "dictionary_matches": f"{BASE}, {matches_cte()} SELECT * EXCLUDE (place) FROM matches",
        "dictionary_matches_in_documents": f"WITH {matches_cte('documents', 'doc_id', 'text')} SELECT * EXCLUDE (place) FROM matches",
        "seniority_matches": f"{BASE}, {matches_cte()} SELECT job_id, keyword, matched_text, subcategory"
        f" FROM matches WHERE {SEN}",
        "confidence_scores": f"""{BASE}, {matches_cte()}, {spotted_cte()},
k AS (SELECT job_id, count(*) AS total, sum(score * weight) FILTER (dict IN {_SCORED_SQL}) AS s,
  sum(weight) FILTER (dict IN {_SCORED_SQL}) AS w, count(DISTINCT category) FILTER (dict IN {_SCORED_SQL}) AS g
  FROM matches GROUP BY job_id),
n AS (SELECT job_id, {", ".join(f"count(*) FILTER (label = '{x}') AS s_{x}" for x in spotting.LABELS)}
  FROM cleaned LEFT JOIN spotted USING (job_id) GROUP BY job_id)
SELECT job_id, round(CASE WHEN coalesce(w, 0) = 0 THEN 0.0 ELSE least(s / w + least(g / 10.0, 0.2), 1.0) END, 9)::DOUBLE
  AS keyword_confidence, round({_NER}, 9)::DOUBLE AS ner_confidence, coalesce(total, 0)::INTEGER AS total_matches
FROM n LEFT JOIN k USING (job_id)""",
        "top_matches_per_job": f"""{BASE}, {matches_cte()}, r AS (SELECT job_id, score, keyword, match_type, dict,
  row_number() OVER (PARTITION BY job_id ORDER BY score DESC, place) - 1 AS rank FROM matches WHERE dict IN {_SCORED_SQL})
SELECT job_id, rank::INTEGER AS rank, score, keyword, match_type, dict AS match_category FROM r WHERE rank < 10""",
        "matches_by_score": f"""{BASE}, {matches_cte()} SELECT job_id,
  (row_number() OVER (PARTITION BY job_id ORDER BY score DESC, place) - 1)::INTEGER AS at, score, keyword, matched_text
FROM matches WHERE {VN}""",
        "fuzzy_by_levenshtein": _FUZZY,
        "fuzzy_by_ratio": _FUZZY_RATIO,
        "enriched_with_fuzzy": _FUZZY_COUNTS,
        "cards_linkedin": _card("linkedin"),
        "cards_itviec": _card("itviec"),
        "cards_topcv": _card("topcv", salary="salary"),
        "cards_vietnamworks": _card("vietnamworks", posted="coalesce(posted_at, 'soon')"),
        "card_applicants": f"""{p} SELECT job_id, CASE WHEN applicants_text LIKE '%early%' THEN 0
  ELSE list_max([x::INTEGER for x in regexp_extract_all(applicants_text, '[0-9]+')]) END AS applicants FROM postings""",
        "card_posted_at": f"{p} SELECT job_id, posted_at FROM postings",
        "page_descriptions": f"{p} SELECT job_id, title || chr(10) || chr(10) || location AS description FROM postings",
        "postings_from_pages": f"""{p} SELECT job_id AS page_id, title, company, location, url, source,
  CASE WHEN source = 'topcv' THEN salary END AS salary, CASE WHEN applicants_text LIKE '%early%' THEN 0
  ELSE list_max([x::INTEGER for x in regexp_extract_all(applicants_text, '[0-9]+')]) END AS applicants,
  CASE WHEN source = 'vietnamworks' THEN coalesce(posted_at, 'soon') ELSE posted_at END AS posted_at,
  CASE WHEN job_id % 2 = 0 THEN title ELSE 'About the work in ' || location END AS description FROM postings""",
        "search_urls": "WITH asked AS (SELECT DISTINCT lower(c_mktsegment) AS keyword, lower(n_name) AS location"
        " FROM customer JOIN nation ON c_nationkey = n_nationkey) "
        + " UNION ALL ".join(_search(s) for s in cards.SEARCH_PAGES),
        "element_text": f"SELECT conv_id, turn, nullif({strip('text')}, '') AS t FROM conversations",
        "enriched_long_form": f"""{ENRICHED}, {MASKED_CTES} SELECT job_id, kind, value FROM rules JOIN ok USING (job_id)
  WHERE kind IN ('dates', 'durations', 'emails', 'urls', 'phone_numbers', 'salaries')
UNION ALL SELECT job_id, label, value FROM spotted JOIN ok USING (job_id) WHERE label <> 'skills'""",
        "full_records": f"""{ENRICHED}, {MASKED_CTES},
r AS (SELECT job_id, {_values("rules", "kind", "value", _RECORD_RULES)} FROM rules GROUP BY job_id),
s AS (SELECT job_id, {_values("spotted", "label", "value", spotting.LABELS)} FROM spotted GROUP BY job_id),
m AS (SELECT job_id, {_values("matches", "dict", "keyword", DICTIONARIES, "matched_")},
  coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER ({SEN}), '') AS seniority_levels FROM matches GROUP BY job_id)
SELECT job_id, c AS cleaned_text, '' AS benefits,
  {", ".join(f"coalesce({n}, '') AS {n.replace('matched_vietnamese', 'vietnamese').replace('matched_extended', 'extended')}"
             for n in [*_RECORD_RULES, *spotting.LABELS, *[f"matched_{d}" for d in DICTIONARIES], "seniority_levels"])}
FROM ok JOIN cleaned USING (job_id) LEFT JOIN r USING (job_id) LEFT JOIN s USING (job_id) LEFT JOIN m USING (job_id)""",
        "enriched_with_errors": f"""{COUNTS}, {MASKED_CTES}, e AS (SELECT job_id, count(*) AS n FROM rules WHERE kind = 'emails' GROUP BY job_id),
o AS (SELECT job_id, coalesce({LONG}, FALSE) AS ok, coalesce({LONG}, FALSE) AND length(description) > {ERROR_LENGTH} AS failed FROM postings)
SELECT job_id, CASE WHEN failed THEN 'too_long' END AS error, ok AND NOT failed AS done,
  CASE WHEN failed THEN 0 WHEN ok THEN length(c) END::INTEGER AS cleaned,
  CASE WHEN failed THEN 0 WHEN ok THEN n_skills END::INTEGER AS skills,
  CASE WHEN failed THEN 0 WHEN ok THEN coalesce(n, 0) END::INTEGER AS emails,
  CASE WHEN failed THEN 0 WHEN ok THEN n_skills + n_technologies END::INTEGER AS total_matches
FROM o JOIN cleaned USING (job_id) LEFT JOIN per_job USING (job_id) LEFT JOIN e USING (job_id)""",
        "run_summary_with_errors": f"""{COUNTS}, o AS (SELECT job_id, coalesce({LONG}, FALSE) AS ok,
  coalesce({LONG}, FALSE) AND length(description) > {ERROR_LENGTH} AS failed FROM postings WHERE {_DESCRIBED})
SELECT count(*) FILTER (ok AND NOT failed) AS processed, count(*) FILTER (NOT ok) AS skipped, count(*) FILTER (failed) AS errors,
  count(*) FILTER (n_vietnamese_keywords > 0 AND NOT failed) AS vietnamese_detected,
  count(*) FILTER (n_seniority > 0 AND NOT failed) AS seniority_detected,
  count(*) FILTER (n_extended_technologies > 0 AND NOT failed) AS extended_tech_detected
FROM o LEFT JOIN per_job USING (job_id)""",
        "records_as_postings": "SELECT c_custkey::BIGINT AS job_id, c_mktsegment AS title, c_name AS company,"
        " NULL::VARCHAR AS location, NULL::INTEGER AS applicants, c_mktsegment AS tags FROM customer",
        "label_positions": f"""{BASE}, {matches_cte()}, {spotted_cte()}, w AS (SELECT job_id, string_split(trim(t), ' ') AS w FROM forms),
p AS (SELECT job_id, w, unnest(range(len(w))) AS pos FROM w)
SELECT job_id, label, value AS phrase, pos::INTEGER AS at FROM p JOIN phrases ON w[pos + 1] = string_split(value, ' ')[1]
WHERE array_to_string(list_slice(w, pos + 1, pos + len(string_split(value, ' '))), ' ') = value""",
        "quoted_documents": f"""{BASE}, forms AS MATERIALIZED (SELECT job_id, ' ' || {match_form('c')} || ' ' AS t FROM cleaned),
d AS (SELECT doc_id, string_split({match_form('text')}, ' ') AS w FROM documents),
quotes AS MATERIALIZED (SELECT doc_id, w[1] AS head, ' ' || array_to_string(list_slice(w, 1, 120), ' ') || ' ' AS form FROM d WHERE len(w) >= 120),
heads AS (SELECT DISTINCT job_id, unnest(string_split(trim(t), ' ')) AS head FROM forms)
SELECT job_id, 'document ' || doc_id AS keyword, 'alias' AS match_type FROM heads JOIN quotes USING (head) JOIN forms USING (job_id)
WHERE contains(t, form)""",
        "extraction_counters": f"""{COUNTS} SELECT job_id, s_skills::INTEGER AS total_skills,
  s_technologies::INTEGER AS total_technologies, s_responsibilities::INTEGER AS total_responsibilities,
  s_qualifications::INTEGER AS total_qualifications, (n_skills + n_technologies)::INTEGER AS total_matches,
  length(description)::INTEGER AS text_length_original, length(c)::INTEGER AS text_length_cleaned,
  n_vietnamese_keywords::INTEGER AS vietnamese_keywords_count, n_seniority::INTEGER AS seniority_levels_count,
  n_extended_technologies::INTEGER AS extended_technologies_count
FROM per_job JOIN postings USING (job_id) JOIN cleaned USING (job_id)""",
        "total_extractions": f"""{COUNTS}, {MASKED_CTES}, r AS (SELECT job_id, count(*) FILTER
  (kind IN ('emails', 'urls', 'phone_numbers')) AS n FROM ok LEFT JOIN rules USING (job_id) GROUP BY job_id)
SELECT job_id, (s_skills + s_technologies + s_roles + s_responsibilities + s_qualifications + n)::INTEGER AS n
FROM per_job JOIN r USING (job_id)""",
        "run_status": f"{p} SELECT CASE WHEN {LONG} THEN 'processed' ELSE 'skipped' END AS status, count(*) AS n"
        f" FROM postings WHERE {_DESCRIBED} GROUP BY 1",
        "run_summary": f"""{COUNTS}, sel AS (SELECT job_id FROM postings WHERE {_DESCRIBED} AND {_TOPCV_DONE})
SELECT count(j.job_id) AS processed, count(*) - count(j.job_id) AS skipped, 0::BIGINT AS errors,
  count(*) FILTER (n_vietnamese_keywords > 0) AS vietnamese_detected,
  count(*) FILTER (n_seniority > 0) AS seniority_detected,
  count(*) FILTER (n_extended_technologies > 0) AS extended_tech_detected
FROM sel LEFT JOIN per_job j USING (job_id)""",
        "run_enriched": f"{COUNTS} SELECT job_id, n_vietnamese_keywords::INTEGER AS n FROM per_job"
        f" JOIN postings USING (job_id) WHERE {_TOPCV_DONE}",
        "stored_after_two_runs": f"{COUNTS} SELECT job_id, n_vietnamese_keywords::INTEGER AS n FROM per_job",
        "reprocessed": f"""{BASE}, rows AS (SELECT job_id, CASE WHEN source = 'topcv'
  THEN 'Senior Kotlin engineer with a text that is long enough, tiếng anh' ELSE description END AS description
  FROM postings WHERE source = 'topcv' OR {LONG})
SELECT job_id, length(description)::INTEGER AS chars, length({clean('description')})::INTEGER AS cleaned FROM rows""",
        "limited_run": f"""{p}, chosen AS (SELECT * FROM postings WHERE {_DESCRIBED} ORDER BY job_id LIMIT 40)
SELECT job_id, '1.0' AS version FROM chosen WHERE {LONG}""",
        "streamed_repeats": f"{p} SELECT job_id, url FROM postings WHERE {LONG}",
        "streamed": f"{COUNTS} SELECT job_id, n_vietnamese_keywords::INTEGER AS n FROM per_job",
        "quick_sample": f"""{ENRICHED}, chosen AS (SELECT * FROM postings WHERE source = 'linkedin' ORDER BY job_id LIMIT 20),
s AS (SELECT job_id, string_agg(keyword, '|' ORDER BY keyword) AS seniority FROM matches WHERE {SEN} GROUP BY job_id)
SELECT job_id, left(title, 40) AS title, left(description, 200) AS preview,
  CASE WHEN coalesce(length({strip('description')}), 0) >= 2 THEN coalesce(seniority, '') END AS seniority
FROM chosen LEFT JOIN s USING (job_id)""",
        "job_details": f"""{COUNTS}, v AS (SELECT job_id,
  list(keyword ORDER BY score DESC, place) FILTER ({VN}) AS vn,
  list(keyword ORDER BY score DESC, place) FILTER ({SEN}) AS sen FROM matches GROUP BY job_id)
SELECT job_id, coalesce(title, 'Unknown') AS title, coalesce(company, 'Unknown') AS company,
  s_skills::INTEGER AS skills_count, s_technologies::INTEGER AS technologies_count, s_roles::INTEGER AS roles_count,
  s_responsibilities::INTEGER AS responsibilities_count, n_vietnamese_keywords::INTEGER AS vietnamese_keywords_count,
  n_seniority::INTEGER AS seniority_levels_count, n_extended_technologies::INTEGER AS extended_technologies_count,
  coalesce(array_to_string(list_slice(vn, 1, 3), '|'), '') AS sample_vietnamese,
  coalesce(array_to_string(list_slice(sen, 1, 2), '|'), '') AS sample_seniority
FROM per_job JOIN postings USING (job_id) LEFT JOIN v USING (job_id)""",
        "backfilled": f"""{BASE}, {matches_cte()} SELECT job_id, {", ".join(
            f"count(*) FILTER ({c})::INTEGER AS {n}, coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER ({c}), '') AS {n}_found"
            for n, c in (("soft", "dict = 'soft_skills'"), ("industry", "dict = 'industry_terms'"), ("vn", VN))
        )} FROM postings LEFT JOIN matches USING (job_id)
WHERE source = 'linkedin' AND length({strip('description')}) >= 20 GROUP BY job_id""",
        "success_rate": f"""{p}, s AS (SELECT coalesce(length({strip('description')}), 0) >= 20 AS ok FROM postings
  WHERE source = 'linkedin') SELECT count(*) FILTER (ok) AS updated, count(*) AS selected,
  count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS success_rate FROM s""",
        "statistics_facts": f"""{COUNTS}, {_DETAILED}, j AS (SELECT p.source, j.job_id IS NOT NULL AS done, n_vietnamese_keywords > 0 AS vn,
  n_seniority > 0 AS sen, n_extended_technologies > 0 AS ext FROM postings p LEFT JOIN per_job j USING (job_id)),
k AS (SELECT array_to_string(sen, '+') || CASE WHEN len(list_filter(vn, lambda x: NOT list_contains(sen, x))) > 0
  THEN '|' || array_to_string(list_slice(list_filter(vn, lambda x: NOT list_contains(sen, x)), 1, 2), '+') ELSE '' END AS combination,
  coalesce(company, 'Unknown') AS company, len(vn) AS n_vn FROM detailed),
pm AS MATERIALIZED (SELECT * FROM {PROCESSED_MATCHES}),
f AS (SELECT 'jobs' AS report, source AS key, 'total' AS subkey, 0.0::DOUBLE AS amount FROM j
  {"".join(f" UNION ALL SELECT 'jobs', source, '{n}', 0.0 FROM j WHERE {c}" for n, c in (
      ("processed", "done"), ("vietnamese", "vn"), ("seniority", "sen"), ("extended", "ext")))}
  UNION ALL SELECT 'average', 'skills', NULL, s_skills FROM per_job
  UNION ALL SELECT 'average', 'technologies', NULL, s_technologies FROM per_job
  UNION ALL SELECT 'average', 'confidence', NULL, ({_NER})::DOUBLE FROM per_job
  UNION ALL SELECT 'vietnamese', category, keyword, 0.0 FROM pm WHERE {VN}
  UNION ALL SELECT 'seniority', keyword, NULL, 0.0 FROM pm WHERE {SEN}
  UNION ALL SELECT 'extended', category, NULL, 0.0 FROM pm WHERE {EXT}
  UNION ALL SELECT 'extended_with_vietnamese', category, NULL, 0.0 FROM pm WHERE {EXT} AND job_id IN (SELECT job_id FROM pm WHERE {VN})
  UNION ALL SELECT label, value, NULL, 0.0 FROM spotted JOIN ok USING (job_id) WHERE label IN ('skills', 'technologies')
  UNION ALL SELECT 'combination', combination, NULL, 0.0 FROM k
  UNION ALL SELECT 'company', company, NULL, n_vn FROM k)
SELECT report, key, subkey, count(*) AS n, round(sum(amount), 6)::DOUBLE AS amount FROM f GROUP BY 1, 2, 3""",
        "overview": f"""{COUNTS}, o AS (SELECT count(*) AS total_jobs, count(j.job_id) AS processed,
  count(*) FILTER (n_vietnamese_keywords > 0) AS with_keywords
  FROM postings LEFT JOIN per_job j USING (job_id) WHERE source = 'linkedin')
SELECT *, processed * 100.0::DOUBLE / total_jobs AS coverage,
  with_keywords * 100.0::DOUBLE / processed AS detection_rate FROM o""",
        "seniority_distribution": f"""{ENRICHED} SELECT keyword, count(*) AS n, count(*) * 100.0::DOUBLE /
  (SELECT count(DISTINCT job_id) FROM {PROCESSED_MATCHES} WHERE {VN}) AS share
FROM {PROCESSED_MATCHES} WHERE {SEN} GROUP BY keyword""",
        "category_mentions": f"{ENRICHED} SELECT category, count(*) AS n FROM {PROCESSED_MATCHES} WHERE {VN} GROUP BY 1",
        "category_keyword_mentions": f"{ENRICHED} SELECT category, keyword, count(*) AS n"
        f" FROM {PROCESSED_MATCHES} WHERE {VN} GROUP BY 1, 2",
        "top_keywords_per_category": f"""{ENRICHED}, k AS (SELECT category, keyword, count(*) AS n
  FROM {PROCESSED_MATCHES} WHERE {VN} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, keyword) AS rank FROM k)
SELECT category, keyword, n, rank::INTEGER AS rank FROM r WHERE rank <= 3""",
        "technology_categories": f"{ENRICHED} SELECT category, count(*) AS n FROM {PROCESSED_MATCHES} WHERE {EXT} AND job_id"
        f" IN (SELECT job_id FROM matches WHERE {VN}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "all_technology_categories": f"{ENRICHED} SELECT category, count(*) AS n FROM {PROCESSED_MATCHES} WHERE {EXT}"
        " GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
        "jobs_with_technologies": f"{COUNTS} SELECT count(*) AS n FROM per_job WHERE n_extended_technologies > 0",
        "averages": f"""{COUNTS} SELECT count(*) AS total_processed, round(avg(s_skills), 6) AS avg_skills_count,
  round(avg(s_technologies), 6) AS avg_tech_count, round(avg(({_NER})::DOUBLE), 6) AS avg_confidence FROM per_job""",
        "top_skills": f"{ENRICHED} SELECT value AS item, count(*) AS n FROM spotted JOIN ok USING (job_id)"
        " WHERE label = 'skills' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "top_technologies": f"{ENRICHED} SELECT value AS item, count(*) AS n FROM spotted JOIN ok USING (job_id)"
        " WHERE label = 'technologies' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "keyword_combinations": f"""{ENRICHED}, {_DETAILED}, k AS (SELECT array_to_string(sen, '+') ||
  CASE WHEN len(list_filter(vn, lambda x: NOT list_contains(sen, x))) > 0
  THEN '|' || array_to_string(list_slice(list_filter(vn, lambda x: NOT list_contains(sen, x)), 1, 2), '+')
  ELSE '' END AS combination FROM detailed)
SELECT combination, count(*) AS n FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "company_stats": f"""{ENRICHED}, {_DETAILED} SELECT coalesce(company, 'Unknown') AS company, count(*) AS jobs,
  sum(len(vn))::BIGINT AS vn_keywords, sum(len(vn))::DOUBLE / count(*) AS avg_keywords
FROM detailed GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5""",
        "detection_rates": f"""{COUNTS} SELECT count(*) FILTER (n_seniority > 0) * 100.0::DOUBLE / count(*) AS seniority_rate,
  count(*) FILTER (n_extended_technologies > 0) * 100.0::DOUBLE / count(*) AS extended_rate,
  count(*) FILTER (n_vietnamese_keywords > 0) * 100.0::DOUBLE / count(*) AS vietnamese_rate FROM per_job""",
        "detailed_jobs": f"""{ENRICHED}, {_DETAILED} SELECT job_id, title, company, left(description, 100) AS preview,
  len(vn)::INTEGER AS vn, len(sen)::INTEGER AS seniority, ext::INTEGER AS technologies FROM detailed""",
        "sample_jobs": f"""{ENRICHED}, {_DETAILED.replace("source = 'linkedin' AND ", "")} SELECT job_id,
  left(title, 40) AS title, left(coalesce(company, 'Unknown'), 30) AS company, array_to_string(sen, '|') AS seniority
FROM detailed ORDER BY job_id LIMIT 3""",
    }
    for kind in RULE_PATTERNS:
        sql[f"rule_{kind}"] = f"{MASKED} {rule_rows(kind, 'masked', 'job_id', 'x')}"
    sql["dictionary_matches_by_join"] = sql["dictionary_matches"]
    sql["dictionary_matches_by_shuffle"] = sql["dictionary_matches"]
    return sql


ORACLE = _oracle()
