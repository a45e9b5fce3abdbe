"""DuckDB statements that give the same rows as the registered queries."""

from __future__ import annotations

import re

from auditlark.functions import lemmas as L
from auditlark.functions import words as W
from auditlark.operators import parse
from auditlark.plans import fixtures

VERBS = ["Define", "Explain", "Implement", "Compare", "Justify", "Design", "What is", "Why is", "How does", "Discuss"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def any_of(items) -> str:
    return "|".join(re.escape(x).replace("\\ ", " ") for x in items)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def has(x: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({x}, {lit(flags + '(?:' + pattern + ')')})"


def has_word(x: str, alternatives: str) -> str:
    return f"regexp_matches({x}, {lit(rf'(?i)(^|[^\p{{L}}\p{{N}}_])(?:{alternatives})([^\p{{L}}\p{{N}}_]|$)')})"


def words(x: str) -> str:
    return rf"string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+')"


def keywords(x: str) -> str:
    return f"list_distinct(list_filter({words(x)}, lambda w: regexp_full_match(w, '[a-z0-9]{{4,}}')))"


def content_words(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({strings(W.GENERIC_WORDS)}, w))"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '\\r\\n|\\n|\\r'), lambda y: {strip('y')}), lambda y: y <> '')"


def bloom(x: str) -> str:
    arms = [(has_word(x, any_of(W.BLOOM_VERBS[level])), level) for level in W.BLOOM_ORDER] + [(has_word(x, form), level) for form, level in W.WH_FORMS]
    return "CASE " + " ".join(f"WHEN {test} THEN '{level}'" for test, level in arms) + " ELSE 'Unknown' END"


def difficulty(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.DIFFICULTY.items()) + " END"


def asked(number: str, text: str) -> str:
    return f"list_extract({strings(VERBS)}, CAST(1 + {number} % 10 AS INT)) || ' ' || replace({text}, chr(10), ' ')"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"


TEXTS = f"texts AS (SELECT doc_id, text FROM {fixtures.sql_values()} UNION ALL SELECT doc_id, text FROM documents)"
QUESTIONS = f"questions AS (SELECT item_id, {asked('item_id', 'text')} AS question FROM benchmark)"
EXCHANGES = f"""exchanges AS (SELECT q.conv_id, q.turn, {asked('q.turn', 'q.text')} AS question, a.text AS chunk FROM conversations q
    JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""
VECTORS = """vectors AS (SELECT e.vec_id AS chunk_id, e.embedding::DOUBLE[] AS v, 'Module ' || e.label AS module, e.label AS grp, coalesce(d.text, '') AS text
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""


def found(k: int, same: str = "") -> str:
    return f"""{VECTORS}, pairs AS (SELECT q.chunk_id AS query_id, {asked('(q.chunk_id // 50)', 'q.text')} AS question, c.chunk_id, c.module, c.text, list_cosine_similarity(q.v, c.v) AS cosine
        FROM vectors q JOIN vectors c ON q.chunk_id <> c.chunk_id {same} WHERE q.chunk_id % 50 = 0),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, chunk_id) AS rank FROM pairs) WHERE rank <= {k})"""


OVERLAP = f"CASE WHEN len({keywords('question')}) = 0 THEN 0 ELSE len(list_intersect({keywords('question')}, {keywords('text')})) / len({keywords('question')}) END"
SCORED = f"""{found(8)}, half AS (SELECT *, 1 - cosine AS distance, greatest(0, least(1, cosine)) AS semantic, {OVERLAP} AS keyword, max(cosine) OVER (PARTITION BY query_id) AS best FROM found),
    based AS (SELECT *, CASE WHEN best >= 0.35 THEN 0.12 WHEN best >= 0.30 THEN 0.06 ELSE 0.0 END AS boost, 0.8 * semantic + 0.2 * keyword AS base FROM half),
    scored AS (SELECT *, CASE WHEN base > 0.2 THEN least(1.0, base + boost) ELSE base END AS similarity FROM based)"""
ITEM = "STRUCT(chunk_id BIGINT, module VARCHAR, similarity DOUBLE, text VARCHAR)[]"
RICH_ITEM = "STRUCT(chunk_id BIGINT, module VARCHAR, similarity DOUBLE, semantic DOUBLE, keyword DOUBLE, boost DOUBLE, text VARCHAR)[]"
LISTED = "lists AS (SELECT query_id, list([{'chunk_id': chunk_id, 'module': module, 'similarity': similarity, 'text': text}] ORDER BY distance, chunk_id) AS l FROM scored GROUP BY query_id)"

RESULTS = r"""results AS (SELECT d.doc_id, l.quality = 1 AS expected, score >= 0.5 AS predicted, score, d.n_chars >= 400 AS other
    FROM (SELECT *, round(len(list_distinct(string_split_regex(lower(text), '\s+'))) / len(string_split_regex(lower(text), '\s+')), 6) AS score FROM documents) d JOIN labels l USING (doc_id))"""
CATALOG = """catalog AS (SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS department, (c_nationkey % 13) || CASE WHEN c_custkey % 3 = 0 THEN 'th' ELSE '' END AS semester,
    list_extract(['PEC-IT', 'OE-', 'CS', 'HSS-'], CAST(1 + c_custkey % 4 AS INT)) || (100 * (1 + c_custkey % 8) + c_nationkey) || 'b' AS code, c_name, c_nationkey FROM customer)"""
ROMAN = "['?', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII']"
SEM = f"list_extract({ROMAN}, 1 + CAST(regexp_extract(semester, '\\d+') AS INT))"
INFERRED = f"list_extract({ROMAN}, 1 + CAST(regexp_extract(code, '\\d') AS INT))"


def elective(code: str, text: str) -> str:
    prefix = f"regexp_extract(upper(coalesce({code}, '')), '^([A-Z]+)', 1)"
    arms = [f"WHEN {prefix} = 'PEC' THEN 'PEC'", f"WHEN {prefix} IN ('OEC', 'OE') THEN 'OEC'", f"WHEN {prefix} = 'HSS' THEN 'HSS'"]
    both = f"coalesce({code}, '') || ' ' || {text}"
    return "CASE " + " ".join(arms + [f"WHEN {has(both, p)} THEN '{name}'" for name, p in W.ELECTIVES]) + " ELSE 'CORE' END"


def lemma(w: str) -> str:
    known = {form: base for base, forms in L.IRREGULAR.items() for form in forms.split()} | {b: b for b in L.BASE}
    arms = [f"WHEN {w} = {lit(form)} THEN {lit(base)}" for form, base in known.items()]
    arms += [f"WHEN regexp_matches({w}, {lit(pattern)}) THEN regexp_extract({w}, {lit(pattern)}, 1) || '{ending}'" for pattern, ending in L.RULES]
    return f"CASE {' '.join(arms)} ELSE {w} END"


def long_words(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}') AND NOT list_contains({strings(W.KEYWORD_STOP_WORDS)}, w))"


# -- quality -------------------------------------------------------------------------------------------------------


def header_ratio(x: str) -> str:
    inside = lit(r"(?i)^\s*(?:" + W.HEADER_LINE + ")")
    return f"CASE WHEN len({lines(x)}) = 0 THEN 1.0 ELSE len(list_filter({lines(x)}, lambda y: regexp_matches(y, {inside}))) / len({lines(x)}) END"


def low_information(x: str) -> str:
    t = strip(x)
    tokens = f"len(list_filter(regexp_extract_all(lower({t}), '[a-z]{{3,}}'), lambda w: NOT list_contains({strings(W.QUALITY_STOP_WORDS)}, w)))"
    start = lit(r"^[^a-z\n]{0,30}(?i:" + W.HEADER_START + ")")
    return f"(length({t}) < 80 OR (regexp_matches({t}, {start}) AND len({lines(t)}) <= 2) OR {header_ratio(t)} >= 0.6 OR {tokens} < 8 OR (NOT {has_word(t, W.EDUCATIONAL)} AND length({t}) < 250))"


def publisher(x: str, company: bool) -> str:
    return f"({has(x, W.PUBLISHERS + (r'|Ltd\.?|Inc\.?' if company else '|ISBN'))} OR {has_word(x, '|'.join(W.PUBLISHER_CODES))})"


def citation(x: str) -> str:
    free = "“[^”]{5,}”|\"[^\"]{5,}\"|'[^']{5,}'"
    edge = r"(^|[^\p{L}\p{N}_])"
    return f"({has(x, free)} OR {has(x, edge + r'by\s+[A-Z][a-z]')} OR {has(x, edge + r'\d{1,2}(?:st|nd|rd|th)\s+Ed')} OR {has_word(x, 'ISBN')})"


def reference_entry(x: str) -> str:
    t = strip(x)
    listed = lit(r"^\s*(?:\d{1,2}\.\s*)?.{5,60},\s*[A-Z][A-Za-z.\s]{1,30},\s*[A-Z]{2,5}\s*\.?\s*(?:\n|$)")
    return f"(length({t}) <= 150 AND (regexp_matches({t}, {listed}) OR ({publisher(t, True)} AND {citation(t)}) OR (length({t}) < 150 AND contains({t}, ',') AND {publisher(t, True)} AND NOT {has(t, W.SYLLABUS_SIGNS)})))"


def noisy(x: str) -> str:
    t = strip(x)
    return f"""(length({t}) < 30 OR {has(t, r'^(?:Credits?|Contacts?|L[\-–]T[\-–]P|Hours?|Marks?|Scheme|Course\s*Code|Subject\s*Code|Paper\s*Code)\s*[:\-]?\s*[\d\w\-]*\s*$')}
        OR {has(t, r'^(?:\s*(?:\d+(?:\.\d+)?)\s+){4,}\d+(?:\.\d+)?\s*$', '')} OR {has(t, r'^(?:CO\d+|PO\d+)\s*[-:]\s*(?:CO\d+|PO\d+)\s*$')} OR {publisher(t, False)} OR {citation(t)})"""


def normalised(x: str) -> str:
    t = f"replace({x}, chr(13), '')"
    t = replaced(t, r"(^|[^\p{L}\p{N}_])([A-Za-z])\s*[–—]\s*([\p{L}\p{N}_])", r"'\1\2-\3'")
    t = replaced(t, "[–—]", "'-'")
    t = replaced(t, r"(?i)\[\s*\d+\s*L?\s*\]", "''")
    t = replaced(t, rf"(?i)(?:^|\n)[^\n]*?(?:{W.COURSE_META})[^\n]*", "''")
    t = replaced(t, rf"(?i)(?:^|\n)\s*(?:Page:\s*\d+/\d+\s+)?[^\n]*?(?:{W.UNIVERSITY})[^\n]*", "''")
    t = replaced(t, r"\b(?:\d+(?:\.\d+)?\s+){4,}\d+(?:\.\d+)?\b", "''")
    t = replaced(t, r"[ \t]{2,}", "' '")
    return replaced(t, r"\n{3,}", "chr(10) || chr(10)")


def legacy_cleaned(x: str) -> str:
    codes = "|".join(rf"\b{c}\b" for c in W.PUBLISHER_CODES)
    t = f"replace({x}, chr(13), '')"
    t = replaced(t, r"(?m)^\s*(?:CO\d+|PO\d+)?\s*(?:\d+(?:\.\d+)?\s+){4,}\d+(?:\.\d+)?\s*$", "''")
    for middle in (f"{W.PUBLISHERS}|{codes}|ISBN", W.ACCREDITATION):
        t = replaced(t, rf"(?i)(?:^|\n)[^\n]*?(?:{middle})[^\n]*", "''")
    t = replaced(t, rf"(?i)(?:^|\n)\s*(?:Page\s*:\s*\d+[^\n]*|[^\n]*?(?:{W.LEGACY_UNIVERSITY})[^\n]*)", "''")
    t = replaced(t, rf"(?i)(?:^|\n)[^\n]*?(?:{W.LEGACY_META})[^\n]*", "''")
    t = replaced(t, r"(?i)\[\s*\d+\s*L?\s*\]", "''")
    return strip(replaced(t, r"\n{3,}", "chr(10) || chr(10)"))


def metadata(field: str) -> str:
    found = [strip(f"regexp_replace({strip(f'regexp_extract(text[1:2000], {lit("(?i)" + p)}, 1)')}, '[:\\-]$', '')") for p in W.METADATA[field]]
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in found) + ", NULL)"


def router() -> str:
    titles = f"len(regexp_extract_all(text, {lit(rf'(?im)^\s*{W.TITLE_MARKER}')}))"
    score = " + ".join(f"CAST({has('text', p)} AS INT)" for p in W.STRUCTURED_SIGNS)
    signs = " + ".join(f"CAST(contains(lower(text), {lit(s)}) AS INT)" for s in W.FORMAT_SIGNS)
    return f"""CASE WHEN {titles} >= 2 THEN 'MULTI_SUBJECT_CURRICULUM' WHEN {titles} = 1 OR {score} >= 2 THEN 'STRUCTURED_SUBJECT' ELSE 'LEGACY_SUBJECT' END AS route,
        CASE WHEN {signs} >= 3 THEN 'AICTE' WHEN regexp_matches(text, '(?:Subject|Paper|Course) Code') THEN 'SINGLE' ELSE 'UNKNOWN' END AS format"""


# -- parsers -------------------------------------------------------------------------------------------------------

RAW_LINES = "raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM texts)"
TRIGGER = "CASE " + " ".join(f"WHEN {has(strip('line'), p)} THEN '{name}'" for name, p in parse.TRIGGERS) + " END"
INLINE = f"""CASE WHEN trigger = 'SYLLABUS' AND {has('line', r'^\s*(?:Unit|Module|Chapter)\b')} THEN {strip('line')}
    ELSE {strip(f"regexp_replace(regexp_replace(line, {lit('(?i)' + parse.INLINE)}, ''), '^[:\\-–\\s]+', '')")} END"""
LINES = f"""{TEXTS}, {RAW_LINES}, marked AS (SELECT *, {TRIGGER} AS trigger FROM raw WHERE {strip('line')} <> ''),
    states AS (SELECT *, sum(CASE WHEN trigger = 'TITLE' THEN 1 ELSE 0 END) OVER w AS course_no, last_value(trigger IGNORE NULLS) OVER w AS st FROM marked
        WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    lines AS (SELECT doc_id, CAST(course_no AS BIGINT) AS course_no, line_no, CASE st WHEN 'TITLE' THEN 'HEADER' ELSE st END AS state, trigger, line,
        CASE WHEN trigger IS NULL THEN line WHEN trigger <> 'TITLE' THEN nullif({INLINE}, '') END AS content FROM states WHERE course_no > 0)"""
CO = r"(?i)^\s*(?:CO\d+|[0-9]+)\s*[:\.]?\s*(.+)"
OUTCOMES = f"""{LINES}, own AS (SELECT doc_id, course_no, line_no, {strip('content')} AS c FROM lines WHERE state = 'OUTCOMES' AND content IS NOT NULL),
    starts AS (SELECT *, regexp_matches(c, {lit(CO)}) AS s, row_number() OVER (PARTITION BY doc_id, course_no ORDER BY line_no) AS r FROM own),
    numbered AS (SELECT *, CASE WHEN s THEN {strip(f'regexp_extract(c, {lit(CO)}, 1)')} ELSE c END AS t, sum(CASE WHEN s OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, course_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM starts),
    outcomes AS (SELECT doc_id, course_no, 'CO' || n AS co, {strip("string_agg(t, ' ' ORDER BY line_no)")} AS text FROM numbered GROUP BY doc_id, course_no, n)"""
UNIT = parse.UNIT
UNITS = f"""{LINES}, own AS (SELECT doc_id, course_no, line_no, content AS c FROM lines WHERE state = 'SYLLABUS' AND content IS NOT NULL AND NOT regexp_matches(content, {lit(parse.UNIT_TABLE)})),
    starts AS (SELECT *, regexp_matches(c, {lit(UNIT)}) AS s, row_number() OVER (PARTITION BY doc_id, course_no ORDER BY line_no) AS r FROM own),
    numbered AS (SELECT *, sum(CASE WHEN s OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, course_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM starts),
    grouped AS (SELECT doc_id, course_no, CAST(n AS BIGINT) AS unit_no, arg_min(s, line_no) AS head, arg_min(c, line_no) AS lead, {strip("coalesce(string_agg(c, chr(10) ORDER BY line_no) FILTER (NOT s), '')")} AS content
        FROM numbered GROUP BY doc_id, course_no, n)"""
CELLS = f"""{LINES}, own AS (SELECT doc_id, course_no, line_no, {strip('content')} AS c, list_transform(regexp_extract_all(content, '(?i)\\b(?:PO\\d+|PSO\\d+|PO-\\d+|PSO-\\d+)\\b'), lambda x: replace(upper(x), '-', '')) AS found
        FROM lines WHERE state = 'MAPPING' AND content IS NOT NULL),
    headed AS (SELECT *, CASE WHEN (contains(c, 'PO1') OR contains(c, 'PO-1')) AND len(found) > 0 THEN found END AS labels FROM own),
    carried AS (SELECT *, last_value(labels IGNORE NULLS) OVER (PARTITION BY doc_id, course_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS header FROM headed),
    split AS (SELECT *, upper(regexp_extract(c, '(?i)^\\s*(CO\\d+|CO)\\b', 1)) AS co, list_filter(string_split_regex({strip("regexp_replace(c, '(?i)^\\s*(CO\\d+|CO)\\b', '')")}, '\\s+|\\|'), lambda x: x <> '') AS cells
        FROM carried WHERE labels IS NULL AND regexp_matches(c, '(?i)^\\s*(CO\\d+|CO)\\b')),
    cell AS (SELECT doc_id, course_no, line_no, co, header, unnest(cells) AS v, unnest(range(len(cells))) AS pos FROM split),
    rows AS (SELECT doc_id, course_no, line_no, CASE WHEN co = 'CO' THEN 'CO' || dense_rank() OVER (PARTITION BY doc_id, course_no ORDER BY line_no) ELSE co END AS co, coalesce(header[pos + 1], 'PO' || (pos + 1)) AS po, CAST(v AS INT) AS strength, CAST(pos AS INT) AS pos
        FROM cell WHERE regexp_full_match(v, '[+-]?\\d{{1,9}}')),
    kept AS (SELECT doc_id, course_no, co, po, arg_max(strength, pos) AS strength, min(pos) AS pos FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id, course_no, co) AS last FROM rows) WHERE line_no = last GROUP BY doc_id, course_no, co, po),
    bare AS (SELECT doc_id, course_no, regexp_extract_all(c, '\\b[123]\\b') AS ns, row_number() OVER (PARTITION BY doc_id, course_no ORDER BY line_no) AS k FROM carried
        WHERE labels IS NULL AND len(regexp_extract_all(c, '\\b[123]\\b')) >= 3 AND (doc_id, course_no) NOT IN (SELECT (doc_id, course_no) FROM kept)),
    plain AS (SELECT doc_id, course_no, 'CO' || k AS co, unnest(ns) AS v, unnest(range(len(ns))) AS p FROM bare),
    matrix AS (SELECT * FROM kept UNION ALL SELECT doc_id, course_no, co, 'PO' || (p + 1), CAST(v AS INT), CAST(p AS INT) FROM plain)"""

SENTENCES = r"string_split(regexp_replace(replace(text, chr(10), ' '), '(\.)\s+', '\1' || chr(1), 'g'), chr(1))"

COUNTS = "count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (expected AND NOT predicted) AS fn, count(*) FILTER (NOT expected AND predicted) AS fp, count(*) FILTER (NOT expected AND NOT predicted) AS tn"


def metrics(digits: int) -> str:
    ratio = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END, {digits})"
    return f"{ratio('tp + tn', '(tp + tn + fp + fn)')} AS accuracy, {ratio('tp', '(tp + fp)')} AS precision, {ratio('tp', '(tp + fn)')} AS recall, {ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1"


SWEEP = f"""{RESULTS}, swept AS (SELECT t.i / 100 AS threshold, count(*) FILTER (expected AND score >= t.i / 100) AS tp, count(*) FILTER (expected AND score < t.i / 100) AS fn,
    count(*) FILTER (NOT expected AND score >= t.i / 100) AS fp, count(*) FILTER (NOT expected AND score < t.i / 100) AS tn FROM results, range(5, 96) t(i) GROUP BY t.i), sweep AS (SELECT *, {metrics(10)} FROM swept)"""


def question_type(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower({x}), {lit(any_of(W.APPLICATION_MARKERS))}) THEN 'application' WHEN regexp_matches(lower({x}), {lit(any_of(W.DEFINITION_MARKERS))}) THEN 'definition' ELSE 'unknown' END"


def core_terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: NOT list_contains({strings(W.CORE_STOP_WORDS)}, w))[1:4]"


DOMAIN_Q = "question || CASE conv_id % 3 WHEN 0 THEN ' on Docker and hadoop' WHEN 1 THEN ' with a neural network' ELSE '' END"
DOMAIN_C = "chunk || CASE WHEN turn % 4 = 0 THEN ' docker' ELSE '' END"
DOMAINS = "coalesce(" + ", ".join(f"CASE WHEN {has_word('q', re.escape(d))} AND NOT {has_word('c', re.escape(d))} THEN {lit(d)} END" for d in W.EXTERNAL_DOMAINS) + ")"
ALIKE = "length(w) >= 4 AND length(o) >= 4 AND ((contains(o, w) AND length(w) >= 5) OR (contains(w, o) AND length(o) >= 5) OR (length(w) >= 5 AND length(o) >= 5 AND w[1:5] = o[1:5]))"
BAG = f"list_filter({words('text')}, lambda w: regexp_full_match(w, '[a-z]{{4,}}'))"
HIGH = r"string_split_regex(lower({}), '[^a-z0-9]+')"
STOP = strings(["the", "and", "for", "with", "what", "how", "why", "are", "was"])

STATEMENTS = {
    "bloom_conversations": f"SELECT conv_id, turn, {bloom('text')} AS bloom_level, {difficulty(f'({bloom("text")})')} AS difficulty FROM conversations WHERE role = 'user'",
    "bloom_derived": f"WITH {QUESTIONS} SELECT item_id, {bloom('question')} AS bloom_level, {difficulty(f'({bloom("question")})')} AS difficulty FROM questions",
    "question_split": rf"""WITH r AS (SELECT conv_id, turn, {strip("CASE WHEN turn % 2 = 0 THEN 'Intro text' || chr(10) || 'Q1. ' || text || ' Q2: Define DES.' || chr(10) || 'Q10. ' || role ELSE text END")} AS raw FROM conversations),
        p AS (SELECT conv_id, turn, list_filter(list_transform(CASE WHEN regexp_matches(raw, 'Q\d+\s*[:.] ') THEN string_split_regex(raw, 'Q\d+\s*[:.] ') ELSE string_split(raw, chr(10)) END, lambda x: {strip('x')}), lambda x: x <> '') AS l FROM r)
        SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS question FROM p""",
    "html_to_text": rf"""WITH t AS (SELECT page_id, {strip(replaced(replaced(replaced('html', '<[^>]+>', "' '"), r'&[\p{L}\p{N}_]+;', "' '"), r'\s{3,}', 'chr(10) || chr(10)'))} AS text FROM pages)
        SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM t WHERE text <> ''""",
    "text_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM documents",
    "keyword_overlap": f"WITH {EXCHANGES} SELECT conv_id, turn, round({OVERLAP.replace(keywords('text'), keywords('chunk'))}, 6) AS overlap FROM exchanges",
    "highlight": f"""WITH {EXCHANGES}, l AS (SELECT conv_id, turn, list_filter({HIGH.format('question')}, lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)) AS q, list_filter({HIGH.format('chunk')}, lambda t: length(t) >= 3) AS c FROM exchanges)
        SELECT conv_id, turn, coalesce(array_to_string(list_filter(c, lambda t: len(list_filter(q, lambda w: contains(t, w) OR contains(w, t))) > 0), ' '), '') AS marked FROM l""",
    "quality_gate": f"WITH {TEXTS} SELECT doc_id, {low_information('text')} AS rejected FROM texts",
    "quality_counts": f"SELECT role, count(*) FILTER ({low_information('text')}) AS n_rejected, count(*) FILTER (NOT {low_information('text')}) AS n_kept FROM conversations GROUP BY role",
    "header_ratio": f"WITH {TEXTS} SELECT doc_id, round({header_ratio('text')}, 6) AS ratio FROM texts",
    "noisy_chunk": f"WITH {TEXTS} SELECT doc_id, {noisy('text')} AS noisy FROM texts",
    "reference_entry": f"WITH {TEXTS} SELECT doc_id, {reference_entry('text')} AS listed FROM texts",
    "normalise_text": f"WITH {TEXTS} SELECT doc_id, md5({normalised('text')}) AS text_md5 FROM texts",
    "legacy_clean": f"WITH {TEXTS} SELECT doc_id, md5({legacy_cleaned('text')}) AS text_md5 FROM texts",
    "doc_router": f"WITH {TEXTS} SELECT doc_id, {router()} FROM texts",
    "metadata_extract": f"WITH {TEXTS} SELECT doc_id, {', '.join(f'{metadata(f)} AS {f}' for f in W.METADATA)} FROM texts",
    "roman_semester": f"""WITH {CATALOG} SELECT c_custkey, {SEM} AS semester, {INFERRED} AS inferred, nullif(regexp_extract(code, '^([A-Z]+)', 1), '') AS owner,
        CASE WHEN {SEM} = {INFERRED} THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence FROM catalog""",
    "elective_type": f"WITH {CATALOG} SELECT c_custkey, {elective('code', 'department')} AS elective FROM catalog",
    "syllabus_id": f"""WITH {CATALOG}, n AS (SELECT c_custkey, upper(department[1:3]) AS d, {SEM} AS s, CASE WHEN c_custkey % 5 <> 0 THEN code END AS code FROM catalog),
        e AS (SELECT *, {elective('code', "''")} AS e, regexp_replace(upper(code), '[^A-Z0-9\\-]', '', 'g') AS c FROM n)
        SELECT c_custkey, CASE WHEN code IS NULL THEN d || '-' || s || '-' || e || '-' || upper(md5(d || '-' || s || '-' || e)[1:6]) WHEN e <> 'CORE' AND NOT contains(c, e) THEN d || '-' || s || '-' || e || '-' || c ELSE d || '-' || s || '-' || c END AS syllabus_id FROM e""",
    "block_split": f"""WITH {TEXTS}, {RAW_LINES}, b AS (SELECT *, sum(CAST({has('line', r'^\s*' + W.TITLE_MARKER)} AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM raw)
        SELECT doc_id, CAST(n AS BIGINT) AS block_no, {strip('string_agg(line, chr(10) ORDER BY line_no)')} AS block FROM b WHERE n > 0 GROUP BY doc_id, n""",
    "structured_lines": f"WITH {LINES} SELECT doc_id, course_no, CAST(line_no AS BIGINT) AS line_no, state, content FROM lines",
    "outcomes_parse": f"WITH {OUTCOMES} SELECT doc_id, course_no, co, text, {bloom('text')} AS bloom_level, {difficulty(f'({bloom("text")})')} AS difficulty FROM outcomes",
    "units_parse": f"""WITH {UNITS} SELECT doc_id, course_no, unit_no, CASE WHEN head THEN regexp_extract(lead, {lit(UNIT)}, 1) ELSE '1' END AS unit,
        CASE WHEN NOT head THEN 'Syllabus Content' ELSE coalesce(nullif({strip(f'regexp_extract(lead, {lit(UNIT)}, 2)')}, ''), 'Unit ' || regexp_extract(lead, {lit(UNIT)}, 1)) END AS title, content FROM grouped""",
    "copo_long": f"WITH {CELLS} SELECT doc_id, course_no, co, po, strength, pos FROM matrix",
    "primary_po": f"WITH {CELLS} SELECT doc_id, course_no, co, list(po ORDER BY strength DESC, pos)[1] AS po FROM matrix GROUP BY doc_id, course_no, co",
    "sentence_pack": rf"""WITH s AS (SELECT doc_id, list_transform({SENTENCES}, lambda x: {{'o': CAST([] AS VARCHAR[]), 'c': x}}) AS l FROM documents),
        f AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN length(a.c) + length(x.c) + 1 > 500 AND a.c <> '' THEN {{'o': CASE WHEN length({strip('a.c')}) >= 20 THEN list_append(a.o, {strip('a.c')}) ELSE a.o END, 'c': x.c}}
            ELSE {{'o': a.o, 'c': CASE WHEN a.c = '' THEN x.c ELSE {strip("a.c || ' ' || x.c")} END}} END) AS r FROM s),
        o AS (SELECT doc_id, CASE WHEN length({strip('r.c')}) >= 20 THEN list_append(r.o, {strip('r.c')}) ELSE r.o END AS l FROM f)
        SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS piece FROM o""",
    "topk_cosine": f"WITH {found(8)} SELECT query_id, chunk_id, round(cosine, 6) AS cosine, rank FROM found",
    "index_search": f"WITH {found(8)} SELECT query_id, chunk_id, round(cosine, 6) AS cosine, rank FROM found",
    "embedded_documents": f"""WITH {TEXTS}, w AS (SELECT doc_id, unnest(list_filter({words('text')}, lambda w: w <> '')) AS w FROM texts), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
        g AS (SELECT doc_id, count(*) AS d, sum(n)::BIGINT AS s, max(n) AS m FROM c GROUP BY doc_id) SELECT doc_id, coalesce(d, 0) AS n_distinct, coalesce(s, 0) AS n_words, coalesce(m, 0) AS most FROM texts LEFT JOIN g USING (doc_id)""",
    "word_search": f"""WITH {TEXTS}, b AS (SELECT item_id AS q, w, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(list_filter({words('text')}, lambda w: w <> '')) AS w FROM benchmark) GROUP BY ALL),
        d AS (SELECT doc_id AS c, w, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(list_filter({words('text')}, lambda w: w <> '')) AS w FROM texts) GROUP BY ALL),
        p AS (SELECT q, c, sum(b.n * d.n) AS dot FROM b JOIN d USING (w) GROUP BY ALL), x AS (SELECT q, sqrt(sum(n * n)) AS n FROM b GROUP BY q), y AS (SELECT c, sqrt(sum(n * n)) AS n FROM d GROUP BY c),
        s AS (SELECT item_id AS q, doc_id AS c, coalesce(dot / (x.n * y.n), 0) AS s FROM benchmark CROSS JOIN texts LEFT JOIN p ON p.q = item_id AND p.c = doc_id LEFT JOIN x ON x.q = item_id LEFT JOIN y ON y.c = doc_id WHERE benchmark.text IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, c) AS rank FROM s) SELECT q AS query_id, c AS chunk_id, round(s, 6) AS cosine, rank FROM r WHERE rank <= 3""",
    "vector_baseline": f"WITH {found(1)} SELECT query_id, chunk_id, round(cosine, 6) AS score FROM found",
    "map_co": f"WITH {found(1, 'AND q.grp = c.grp')} SELECT query_id, chunk_id AS co, round(greatest(0, 1 - (1 - cosine) / 2), 6) AS similarity FROM found",
    "co_to_po": """WITH r AS (SELECT l_orderkey, min('PO' || l_suppkey % 12) AS po FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '1-URGENT' GROUP BY l_orderkey)
        SELECT CAST(o_custkey AS VARCHAR) AS syllabus_id, 'co' || o_orderkey AS mapped_co, po AS mapped_po FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""",
    "hybrid_score": f"WITH {SCORED} SELECT query_id, chunk_id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(boost, 6)::DOUBLE AS boost, round(similarity, 6) AS similarity FROM scored",
    "match_gates": f"""WITH {SCORED}, t AS (SELECT query_id, round(max(similarity), 6) AS top, query_id % 100 = 0 AS scoped FROM scored GROUP BY query_id)
        SELECT query_id, CASE WHEN top > 0.36 THEN 'STRONG_MATCH' WHEN top >= 0.32 THEN 'PARTIAL_MATCH' WHEN top >= 0.28 THEN 'WEAK_MATCH' ELSE 'NO_MATCH' END AS strength,
        CASE WHEN top >= 0.28 AND scoped THEN 'DIRECT_SUBJECT_MATCH' WHEN top >= 0.28 THEN 'RELATED_CURRICULUM_MATCH' ELSE 'OUT_OF_CURRICULUM' END AS type, top >= 0.28 AS passed,
        CASE WHEN top * 2 >= 0.8 THEN 'Strong' WHEN top * 2 >= 0.6 THEN 'Moderate' ELSE 'Weak' END AS band, CASE WHEN top < 0.28 THEN 'out' WHEN scoped THEN 'in' WHEN top * 2 >= 0.6 THEN 'borderline' ELSE 'out' END AS verdict FROM t""",
    "batch_summary": f"""WITH {SCORED}, t AS (SELECT query_id, round(max(similarity), 6) AS top, query_id % 100 = 0 AS scoped FROM scored GROUP BY query_id),
        v AS (SELECT CASE WHEN top < 0.28 THEN 'out' WHEN scoped THEN 'in' WHEN top * 2 >= 0.6 THEN 'borderline' ELSE 'out' END AS v FROM t)
        SELECT count(*) FILTER (v = 'in') AS n_in, count(*) FILTER (v = 'borderline') AS n_borderline, count(*) FILTER (v = 'out') AS n_out, count(*) AS n FROM v""",
    "dedup_chunks": f"""WITH {SCORED}, {LISTED}, k AS (SELECT query_id, list_reduce(l, lambda acc, x: CASE WHEN {strip('x[1].text')} = '' OR {reference_entry('x[1].text')}
            OR len(list_filter(acc, lambda y: y.module IS NOT DISTINCT FROM x[1].module AND (contains(lower({strip('y.text')}), lower({strip('x[1].text')})) OR contains(lower({strip('x[1].text')}), lower({strip('y.text')}))))) > 0
            THEN acc ELSE list_concat(acc, x) END, CAST([] AS {ITEM})) AS kept FROM lists)
        SELECT query_id, coalesce(array_to_string(list_transform(kept, lambda x: x.chunk_id), ','), '') AS kept FROM k""",
    "gap_filter": f"""WITH {SCORED}, {LISTED}, k AS (SELECT query_id, list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 OR (len(acc) < 3 AND acc[1].similarity - x[1].similarity <= CASE WHEN len(list_filter(acc, lambda y: y.module = x[1].module)) > 0 THEN 0.02 ELSE 0.04 END)
            THEN list_concat(acc, x) ELSE acc END, CAST([] AS {ITEM})) AS kept FROM lists)
        SELECT query_id, array_to_string(list_transform(kept, lambda x: x.chunk_id), ',') AS kept FROM k""",
    "modules_detected": f"""WITH {SCORED}, m AS (SELECT query_id, module, min((distance, chunk_id)) FILTER (similarity >= 0.2) AS seen FROM scored GROUP BY query_id, module)
        SELECT query_id, coalesce(string_agg(module, ',' ORDER BY seen) FILTER (seen IS NOT NULL), '') AS modules FROM m GROUP BY query_id""",
    "tfidf_weights": f"""WITH w AS (SELECT item_id, unnest(list_filter({words('text')}, lambda w: length(w) >= 2)) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        r AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM r""",
    "pairwise_jaccard": f"""WITH {found(8)}, b AS (SELECT query_id, chunk_id, {keywords('text')} AS bag FROM found)
        SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, round(CASE WHEN len(x.bag) = 0 OR len(y.bag) = 0 THEN 0 ELSE len(list_intersect(x.bag, y.bag)) / len(list_distinct(list_concat(x.bag, y.bag))) END, 6) AS jaccard
        FROM b x JOIN b y ON x.query_id = y.query_id AND x.chunk_id < y.chunk_id""",
    "evidence_report": f"""WITH {found(8)}, r AS (SELECT query_id, chunk_id, cosine AS similarity, cosine >= 0.3 AS ok, lower(module) AS module, {BAG} AS t FROM found),
        g AS (SELECT *, list_distinct(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || '_' || t[i + 1]))) AS bag FROM r),
        j AS (SELECT x.query_id, avg(CASE WHEN len(x.bag) = 0 OR len(y.bag) = 0 THEN 0 ELSE len(list_intersect(x.bag, y.bag)) / len(list_distinct(list_concat(x.bag, y.bag))) END) AS agreement FROM g x JOIN g y ON x.query_id = y.query_id AND x.chunk_id < y.chunk_id GROUP BY x.query_id),
        m AS (SELECT query_id, max(n) AS major FROM (SELECT query_id, module, count(*) AS n FROM r WHERE ok GROUP BY ALL) GROUP BY query_id),
        a AS (SELECT query_id, count(*) AS k, max(similarity) AS best, avg(similarity) AS mean, count(*) FILTER (ok) AS support, max(similarity) FILTER (ok) - min(similarity) FILTER (ok) AS spread FROM r GROUP BY query_id),
        s AS (SELECT *, support >= 2 AS enough, coalesce(major / support, 0) AS consistency, CASE WHEN support < 2 THEN 1 ELSE round(greatest(0, 1 - spread), 4) END AS stability FROM a LEFT JOIN m USING (query_id) LEFT JOIN j USING (query_id))
        SELECT query_id, round(best, 4) AS best_similarity, round(mean, 4) AS average_similarity, support AS supporting_chunks, round(support / k, 4) AS supporting_ratio,
        CASE WHEN enough THEN round(consistency, 4) ELSE 0 END::DOUBLE AS module_consistency, CASE WHEN enough THEN round(agreement, 4) ELSE 0 END::DOUBLE AS concept_agreement, CASE WHEN enough THEN round(spread, 4) ELSE 0 END::DOUBLE AS similarity_stability,
        CASE WHEN enough THEN round(greatest(0, least(1, (0.40 * mean + 0.27 * stability + 0.20 * consistency + 0.13 * agreement) * pow(support / k, 0.65))), 4) ELSE 0 END::DOUBLE AS final_confidence, k AS chunks_analysed, NOT enough AS insufficient_evidence FROM s""",
    "question_types": f"WITH {QUESTIONS} SELECT item_id, {question_type('question')} AS type, array_to_string({core_terms('question')}, ',') AS terms FROM questions",
    "topic_present": f"WITH {EXCHANGES} SELECT conv_id, turn, len(list_filter({core_terms('question')}, lambda t: contains(lower(chunk), t))) > 0 AS present FROM exchanges",
    "external_domain": f"WITH {EXCHANGES}, x AS (SELECT conv_id, turn, {DOMAIN_Q} AS q, {DOMAIN_C} AS c FROM exchanges) SELECT conv_id, turn, {DOMAINS} AS domain FROM x",
    "decision_cascade": f"""WITH {SCORED}, a AS (SELECT query_id, any_value(question) AS question, max(similarity) AS top, lower(string_agg(text, ' ' ORDER BY distance, chunk_id)) AS c, any_value(boost) AS boost, max(semantic) AS semantic, arg_min(module, (distance, chunk_id)) AS module FROM scored GROUP BY query_id),
        d AS (SELECT *, {question_type('question')} AS question_type, top >= 0.33 AND semantic >= 0.3 AND boost > 0 AS strong, len(list_filter({core_terms('question')}, lambda t: contains(c, t))) > 0 AS t FROM a),
        e AS (SELECT *, t OR strong AS topic FROM d), f AS (SELECT *, top >= 0.28 AND ((question_type = 'definition' AND topic) OR (question_type = 'unknown' AND topic) OR (question_type = 'application' AND strong)) AS yes FROM e)
        SELECT query_id, question_type, yes AS in_syllabus, CASE WHEN yes THEN 'YES' ELSE 'NO' END AS decision, CASE WHEN top < 0.28 THEN 'Question is not sufficiently similar to syllabus content.'
        WHEN question_type = 'definition' THEN CASE WHEN topic AND strong THEN 'The topic is conceptually covered in the syllabus.' WHEN topic THEN 'The topic is explicitly listed in the syllabus.' ELSE 'The topic is not explicitly mentioned in the syllabus.' END
        WHEN question_type = 'unknown' AND topic THEN CASE WHEN strong THEN 'The question is conceptually grounded in syllabus topics.' ELSE 'The question is grounded in syllabus topics.' END
        WHEN question_type = 'application' THEN CASE WHEN strong THEN 'The application conceptually aligns with syllabus topics.' ELSE 'The question introduces topics or applications not explicitly supported by the syllabus.' END
        ELSE 'Validator could not confidently ground the question in the syllabus.' END AS justification, CASE WHEN yes THEN module ELSE 'unknown' END AS decided_module FROM f""",
    "full_audit": f"""WITH {SCORED}, lists AS (SELECT query_id, any_value(question) AS question, max(similarity) AS top, list([{{'chunk_id': chunk_id, 'module': module, 'similarity': similarity, 'semantic': semantic, 'keyword': keyword, 'boost': boost, 'text': text}}] ORDER BY distance, chunk_id) AS l
            FROM scored GROUP BY query_id),
        one AS (SELECT * REPLACE (list_reduce(l, lambda acc, x: CASE WHEN {strip('x[1].text')} = '' OR {reference_entry('x[1].text')}
            OR len(list_filter(acc, lambda y: y.module IS NOT DISTINCT FROM x[1].module AND (contains(lower({strip('y.text')}), lower({strip('x[1].text')})) OR contains(lower({strip('x[1].text')}), lower({strip('y.text')}))))) > 0
            THEN acc ELSE list_concat(acc, x) END, CAST([] AS {RICH_ITEM})) AS l) FROM lists),
        two AS (SELECT * REPLACE (list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) = 0 OR (len(acc) < 3 AND acc[1].similarity - x[1].similarity <= CASE WHEN len(list_filter(acc, lambda y: y.module = x[1].module)) > 0 THEN 0.02 ELSE 0.04 END)
            THEN list_concat(acc, x) ELSE acc END, CAST([] AS {RICH_ITEM})) AS l) FROM one),
        parts AS (SELECT query_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM two), clean AS (SELECT query_id, x, i FROM parts WHERE NOT {noisy('x.text')} AND NOT {low_information('x.text')}),
        three AS (SELECT two.query_id, question, top, coalesce(list(x ORDER BY i) FILTER (x IS NOT NULL), []) AS l FROM two LEFT JOIN clean USING (query_id) GROUP BY ALL),
        read AS (SELECT *, l[1] AS first, question AS q, lower(array_to_string(list_transform(l, lambda x: x.text), ' ')) AS t,
            lower(array_to_string(list_transform(list_filter(l, lambda x: NOT regexp_matches(lower(x.text), 'reference books|bibliography')), lambda x: x.text), ' ')) AS c,
            {question_type('question')} AS question_type, (query_id // 50 % 7) / 7 AS overlap FROM three),
        seen AS (SELECT *, {DOMAINS} AS alien, top >= 0.33 AND coalesce(first.semantic, 0) >= 0.3 AND coalesce(first.boost, 0) > 0 AS strong, len(list_filter({core_terms('question')}, lambda w: contains(t, w))) > 0 AS named FROM read),
        known AS (SELECT *, named OR strong AS topic, top >= 0.34 AND round(overlap, 4) < 0.24 AS rejected, top >= 0.28 AND alien IS NULL AND question_type = 'application' AND NOT strong AS asked, length(question) % 2 = 0 AS even FROM seen),
        judged AS (SELECT *, CASE WHEN top < 0.28 OR alien IS NOT NULL THEN false WHEN question_type = 'definition' THEN topic WHEN question_type = 'unknown' AND topic THEN true WHEN question_type = 'application' THEN strong OR (asked AND even) ELSE false END AS yes FROM known),
        told AS (SELECT *, CASE WHEN top < 0.28 THEN 'Question is not sufficiently similar to syllabus content.' WHEN alien IS NOT NULL THEN 'Question introduces external application domain ' || chr(39) || alien || chr(39) || ' not explicitly covered in syllabus.'
            WHEN question_type = 'definition' THEN CASE WHEN topic AND strong THEN 'The topic is conceptually covered in the syllabus.' WHEN topic THEN 'The topic is explicitly listed in the syllabus.' ELSE 'The topic is not explicitly mentioned in the syllabus.' END
            WHEN question_type = 'unknown' AND topic THEN CASE WHEN strong THEN 'The question is conceptually grounded in syllabus topics.' ELSE 'The question is grounded in syllabus topics.' END
            WHEN question_type = 'application' THEN CASE WHEN strong THEN 'The application conceptually aligns with syllabus topics.' WHEN even THEN 'A unit covers it in depth.' ELSE 'No unit covers it in depth.' END
            ELSE 'Validator could not confidently ground the question in the syllabus.' END AS why,
            CASE WHEN asked THEN CASE WHEN even THEN 'Module 3' ELSE 'unknown' END WHEN yes THEN coalesce(nullif(first.module, ''), 'unknown') ELSE 'unknown' END AS llm_at, top >= 0.28 AND NOT rejected AS passed,
            CASE WHEN top > 0.36 THEN 'STRONG_MATCH' WHEN top >= 0.32 THEN 'PARTIAL_MATCH' WHEN top >= 0.28 THEN 'WEAK_MATCH' ELSE 'NO_MATCH' END AS strength FROM judged),
        final AS (SELECT * REPLACE (CASE WHEN rejected THEN [] ELSE l END AS l, CASE WHEN NOT rejected THEN first END AS first) FROM told),
        likely AS (SELECT *, list_transform(list_filter(l, lambda x: x.similarity >= 0.2), lambda x: x.module) AS ms FROM final),
        mods AS (SELECT *, list_filter(ms, lambda m, i: NOT list_contains(list_slice(ms, 1, i - 1), m)) AS m, CASE WHEN rejected THEN 'Unknown' ELSE {bloom('question')} END AS bloom_level FROM likely)
        SELECT query_id, question, round(top, 4) AS similarity, CASE WHEN rejected THEN 'WEAK_MATCH' WHEN passed AND strength = 'WEAK_MATCH' AND coalesce(first.semantic, 0) >= 0.3 AND coalesce(first.boost, 0) > 0 THEN 'PARTIAL_MATCH' ELSE strength END AS match_strength,
        CASE WHEN passed AND yes THEN 'DIRECT_SUBJECT_MATCH' ELSE 'OUT_OF_CURRICULUM' END AS match_type, passed AS gatekeeper_passed, passed AND yes AS is_in_syllabus, bloom_level, {difficulty('bloom_level')} AS difficulty,
        array_to_string(CASE WHEN passed THEN m[1:2] ELSE m END, ',') AS modules, question_type, CASE WHEN passed AND yes THEN 'YES' ELSE 'NO' END AS decision,
        CASE WHEN rejected THEN printf('High similarity (%.2f) but only %.2f of the question' || chr(39) || 's concepts occur in the syllabus; at least 0.24 must.', top, overlap) WHEN passed THEN why
            ELSE 'Similarity below threshold — no valid syllabus content found.' END AS justification,
        CASE WHEN rejected THEN 'MATCH_FOUND' WHEN strength = 'NO_MATCH' OR (passed AND len(l) = 0) THEN 'NO_MATCH' ELSE 'MATCH_FOUND' END AS retrieval_status, rejected AS scope_rejected,
        CASE WHEN passed THEN CASE WHEN yes THEN 'YES' ELSE 'NO' END END AS llm_decision, CASE WHEN passed THEN why END AS llm_justification, CASE WHEN passed THEN llm_at END AS llm_module,
        CASE WHEN passed THEN len(l) ELSE 0 END AS n_chunks, CASE WHEN passed THEN coalesce(array_to_string(list_transform(l, lambda x: x.chunk_id), ','), '') ELSE '' END AS top_chunks,
        round(coalesce(first.semantic, 0), 4)::DOUBLE AS semantic_score, round(coalesce(first.keyword, 0), 4)::DOUBLE AS keyword_overlap_score, round(coalesce(first.boost, 0), 4)::DOUBLE AS concept_boost FROM mods""",
    "scope_overlap": f"""WITH {EXCHANGES}, {QUESTIONS}, s AS (SELECT DISTINCT 's' || item_id % 6 AS sid, unnest(list_filter({words('question')}, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS o FROM questions),
        q AS (SELECT conv_id || '-' || turn AS query_id, 's' || turn AS sid, {content_words('question')} AS ws FROM exchanges), e AS (SELECT query_id, sid, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM q),
        u AS (SELECT DISTINCT sid, w FROM e), m AS (SELECT u.sid, u.w, max(CASE WHEN w = o OR ({ALIKE}) THEN 1.0 ELSE 0.0 END) AS score FROM u JOIN s USING (sid) GROUP BY u.sid, u.w),
        o AS (SELECT query_id, avg(score) AS overlap FROM e JOIN m USING (sid, w) GROUP BY query_id) SELECT q.query_id, round(coalesce(overlap, 1.0), 6)::DOUBLE AS overlap FROM q LEFT JOIN o USING (query_id)""",
    "frequent_concepts": f"""WITH w AS (SELECT lang AS syllabus_id, unnest({content_words('text')}) AS concept FROM documents), c AS (SELECT syllabus_id, concept, count(*) AS n FROM w GROUP BY ALL)
        SELECT * FROM (SELECT syllabus_id, row_number() OVER (PARTITION BY syllabus_id ORDER BY n DESC, concept) AS rank, concept, n FROM c) WHERE rank <= 20""",
    "ingestion_summary": f"""WITH {CATALOG}, r AS (SELECT 's' || c_nationkey || '-' || c_custkey % 40 AS sid, c_custkey, department, semester, CASE WHEN c_custkey % 7 <> 0 THEN 'M' || c_custkey % 5 END AS module FROM catalog),
        s AS (SELECT sid, arg_min(department, c_custkey) AS department, arg_min(semester, c_custkey) AS semester, count(DISTINCT module) AS m, count(*) AS n FROM r GROUP BY sid)
        SELECT CAST(grouping(department, semester) AS INT) AS level, department, semester, count(*) AS n_subjects, CAST(sum(m) AS BIGINT) AS n_modules, CAST(sum(n) AS BIGINT) AS n_chunks FROM s GROUP BY ROLLUP (department, semester)""",
    "subject_options": f"""WITH {CATALOG}, r AS (SELECT 's' || c_nationkey AS sid, arg_min(code, c_custkey) AS code FROM catalog GROUP BY ALL), k AS (SELECT upper(code) AS code, min(sid) AS by_code FROM r GROUP BY ALL)
        SELECT c_custkey, coalesce(r.sid, by_code) AS option FROM catalog c LEFT JOIN r ON r.sid = 's' || c_custkey % 40 LEFT JOIN k ON k.code = upper(c.code)""",
    "subject_of_question": f"""WITH {CATALOG}, r AS (SELECT 's' || c_nationkey AS sid, arg_min(c_name, c_custkey) AS subject_name, arg_min(code, c_custkey) AS subject_code, arg_min(department, c_custkey) AS department, arg_min(semester, c_custkey) AS semester FROM catalog GROUP BY ALL)
        SELECT c_custkey, 's' || c_custkey % 40 AS syllabus_id, subject_name, subject_code, r.department, r.semester FROM catalog LEFT JOIN r ON sid = 's' || c_custkey % 40""",
    "registry": f"""WITH {CATALOG}, r AS (SELECT 's' || c_nationkey AS syllabus_id, c_custkey, department, semester, code, c_name, CASE WHEN c_custkey % 7 <> 0 THEN 'M' || c_custkey % 5 END AS module FROM catalog),
        m AS (SELECT syllabus_id, string_agg(module, ',' ORDER BY seen) AS modules FROM (SELECT syllabus_id, module, min(c_custkey) AS seen FROM r WHERE module IS NOT NULL GROUP BY ALL) GROUP BY syllabus_id)
        SELECT syllabus_id, arg_min(department, c_custkey) AS department, arg_min(semester, c_custkey) AS semester, arg_min(code, c_custkey) AS subject_code, arg_min(c_name, c_custkey) AS subject_name, 'CORE' AS elective_type, any_value(coalesce(modules, '')) AS modules, count(*) AS n_chunks
        FROM r LEFT JOIN m USING (syllabus_id) GROUP BY syllabus_id""",
    "hierarchy": """SELECT r_name AS department, n_name AS semester, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS subjects FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "distinct_departments": f"WITH {CATALOG} SELECT DISTINCT department FROM catalog",
    "already_ingested": "SELECT CAST(c_custkey AS VARCHAR) AS syllabus_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "chunks_by_module": """WITH m AS (SELECT CASE WHEN c_custkey % 7 > 1 THEN 'M' || c_custkey % 5 ELSE 'General Topics' END AS module, 's' || c_nationkey AS syllabus_id, c_custkey AS chunk_no FROM customer)
        SELECT module, row_number() OVER (PARTITION BY module ORDER BY syllabus_id, chunk_no) AS nth, syllabus_id, chunk_no FROM m""",
    "dedup_insert": "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS course_code, CAST(l_linenumber AS VARCHAR) AS full_co FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey <= 20 AND y.l_suppkey = x.l_suppkey AND y.l_linenumber = x.l_linenumber)",
    "confusion_matrix": f"WITH {RESULTS}, c AS (SELECT {COUNTS}, count(*) AS total FROM results) SELECT *, {metrics(4)} FROM c",
    "threshold_sweep": f"WITH {SWEEP} SELECT * FROM sweep",
    "best_threshold": f"WITH {SWEEP} SELECT * FROM sweep ORDER BY f1 DESC, accuracy DESC, fp, threshold LIMIT 1",
    "mcnemar": f"""WITH {RESULTS}, t AS (SELECT count(*) FILTER (predicted = expected AND other = expected) AS both, count(*) FILTER (predicted = expected AND other <> expected) AS only_first, count(*) FILTER (predicted <> expected AND other = expected) AS only_second,
        count(*) FILTER (predicted <> expected AND other <> expected) AS neither FROM results)
        SELECT *, round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_first + only_second + 1) - lgamma(i + 1) - lgamma(only_first + only_second - i + 1) - (only_first + only_second) * ln(2))) FROM range(0, least(only_first, only_second) + 1) x(i))), 9) AS p_value FROM t""",
    "error_report": f"""WITH {RESULTS} SELECT doc_id, expected, predicted, score, CASE WHEN predicted THEN 'OUT-OF-SYLLABUS question was incorrectly ACCEPTED.' ELSE 'IN-SYLLABUS question was incorrectly REJECTED.' END AS diagnosis FROM results WHERE expected <> predicted""",
    "pasted_outcomes": r"""SELECT p_partkey, 'CO1=' || trim(p_name) || '|CO2=PO' || regexp_extract(p_brand, '([0-9]+)', 1) || '|CO3=' || trim(p_type) AS cos, 'CO2=PO' || regexp_extract(p_brand, '([0-9]+)', 1) AS pos FROM part""",
    "compiled_modules": f"""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role <> 'system' AND {strip('text')} <> ''),
        t AS (SELECT conv_id, string_agg(i || '  ' || role || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS t FROM m GROUP BY conv_id) SELECT c.conv_id, md5(coalesce(t, '')) AS text_md5 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t USING (conv_id)""",
    "distinct_texts": f"SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, {strip('text')}",
    "question_bank": """SELECT page_id AS module, 'Explain ' || trim(url) AS question, true AS expected FROM pages WHERE length('Explain ' || trim(url)) > 15 UNION ALL SELECT page_id, 'Compare page ' || page_id || ' with others', false FROM pages""",
    "keyword_baseline": f"""WITH {found(8)}, s AS (SELECT query_id, list_distinct(list_filter({words('question')}, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}'))) AS q, list_distinct(list_filter({words('text')}, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}'))) AS c FROM found)
        SELECT query_id, round(max(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / len(q) END), 6) AS score FROM s GROUP BY query_id""",
    "keyword_baseline_all": f"""WITH {VECTORS}, k AS (SELECT chunk_id, list_distinct(list_filter({words('text')}, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}') AND NOT list_contains({strings(W.KEYWORD_STOP_WORDS)}, w))) AS c FROM vectors),
        q AS (SELECT chunk_id, list_distinct(list_filter({words(asked('(chunk_id // 50)', 'text'))}, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}') AND NOT list_contains({strings(W.KEYWORD_STOP_WORDS)}, w))) AS w FROM vectors WHERE chunk_id % 50 = 0)
        SELECT q.chunk_id AS query_id, round(max(CASE WHEN len(q.w) = 0 THEN 0 ELSE len(list_intersect(q.w, k.c)) / len(q.w) END), 6) AS score FROM q JOIN k ON q.chunk_id <> k.chunk_id GROUP BY q.chunk_id""",
    "tfidf_baseline": f"""WITH {VECTORS}, w AS (SELECT chunk_id AS i, unnest(list_filter({words('text')}, lambda w: length(w) >= 2 AND NOT list_contains({strings(W.TFIDF_STOP_WORDS)}, w))) AS t FROM vectors),
        c AS (SELECT i, t, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT t, ln((1 + (SELECT count(*) FROM vectors)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY t),
        v AS (SELECT i, t, n * idf / sqrt(sum(n * n * idf * idf) OVER (PARTITION BY i)) AS x FROM c JOIN f USING (t)),
        a AS (SELECT chunk_id AS i, unnest(list_filter({words(asked('(chunk_id // 50)', 'text'))}, lambda w: length(w) >= 2)) AS t FROM vectors WHERE chunk_id % 50 = 0),
        b AS (SELECT i, t, count(*) AS n FROM a JOIN f USING (t) GROUP BY ALL), u AS (SELECT i, t, n * idf / sqrt(sum(n * n * idf * idf) OVER (PARTITION BY i)) AS x FROM b JOIN f USING (t)),
        s AS (SELECT u.i AS q, v.i AS c, sum(u.x * v.x) AS s FROM u JOIN v USING (t) WHERE u.i <> v.i GROUP BY ALL)
        SELECT chunk_id AS query_id, round(coalesce(max(s), 0), 6) AS score FROM vectors LEFT JOIN s ON q = chunk_id WHERE chunk_id % 50 = 0 GROUP BY chunk_id""",
    "keyword_baseline_lemmas": f"""WITH {VECTORS}, u AS (SELECT DISTINCT w, {lemma('w')} AS m FROM (SELECT unnest({words('text')}) AS w FROM vectors UNION ALL SELECT unnest({strings([v.lower() for p in VERBS for v in p.split()])}))),
        k AS (SELECT chunk_id AS c, list(DISTINCT m) AS c_words FROM (SELECT chunk_id, unnest({long_words('text')}) AS w FROM vectors) JOIN u USING (w) GROUP BY ALL),
        q AS (SELECT chunk_id AS q, list(DISTINCT m) AS q_words FROM (SELECT chunk_id, unnest({long_words(asked('(chunk_id // 50)', 'text'))}) AS w FROM vectors WHERE chunk_id % 50 = 0) JOIN u USING (w) GROUP BY ALL),
        s AS (SELECT q, max(len(list_intersect(q_words, c_words)) / len(q_words)) AS s FROM q JOIN k ON q <> c GROUP BY q)
        SELECT chunk_id AS query_id, round(coalesce(s, 0), 6) AS score FROM vectors LEFT JOIN s ON q = chunk_id WHERE chunk_id % 50 = 0""",
    "base_forms": f"SELECT DISTINCT word, {lemma('word')} AS lemma FROM (SELECT unnest({words('text')}) AS word FROM benchmark) WHERE word <> ''",
    "key_phrases": rf"""WITH {TEXTS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+(?:[''’\-][\p{{L}}\p{{N}}_]+)*|[^\s\p{{L}}\p{{N}}_]+|\n') AS t FROM texts),
        c AS (SELECT doc_id, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[\p{{L}}\p{{N}}_]') AND NOT list_contains({strings(W.TFIDF_STOP_WORDS)}, x) THEN x ELSE '|' END), ' ') AS c FROM t),
        p AS (SELECT doc_id, phrase, count(*) AS n, len(string_split(phrase, ' ')) AS size FROM (SELECT doc_id, trim(unnest(string_split(c, '|'))) AS phrase FROM c) WHERE regexp_matches(phrase, '\p{{L}}') AND len(string_split(phrase, ' ')) <= 4 GROUP BY ALL),
        w AS (SELECT doc_id, phrase, n, size, unnest(string_split(phrase, ' ')) AS word FROM p), g AS (SELECT doc_id, word, sum(size * n) / sum(n) AS weight FROM w GROUP BY ALL),
        s AS (SELECT doc_id, phrase, n, sum(weight) AS score FROM w JOIN g USING (doc_id, word) GROUP BY ALL)
        SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase) AS rank, phrase, round(score, 6) AS score, n FROM s) WHERE rank <= 5""",
    "compared_baselines": f"""WITH {RESULTS}, b AS (SELECT 'distinct words' AS name, expected, predicted, doc_id % 7 / 1000 AS seconds FROM results UNION ALL SELECT 'length', expected, other, doc_id % 3 / 1000 FROM results),
        c AS (SELECT name, {COUNTS}, count(*) AS total, round(avg(seconds) * 1000, 3) AS mean_ms FROM b GROUP BY name) SELECT *, {metrics(4)} FROM c""",
    "similarity_percent": f"WITH {SCORED} SELECT query_id, chunk_id, format('{{:.1f}}', round(similarity, 6) * 100) AS percent FROM scored",
}
