"""Column functions on text: normalisation, tokens, quality predicates, question typing, metadata."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import words as W

#: Not a letter, digit or underscore of any script: a word's bound on either side.
OUTSIDE = r"[^\p{L}\p{N}_]"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """White space of ASCII off both ends."""
    return F.btrim(col(text), F.lit(" \t\n\x0b\f\r"))


def has_word(text: Column | str, alternatives: str) -> Column:
    """Whether any alternative stands as whole words, in any case."""
    return col(text).rlike(f"(?iu){BEFORE}(?:{alternatives}){AFTER}")


def has(text: Column | str, pattern: str) -> Column:
    return col(text).rlike(f"(?iu)(?:{pattern})")


def any_of(items: list[str]) -> str:
    return "|".join(re.escape(x) for x in items)


def lines(text: Column | str) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(col(text), "\r\n|\n|\r"), strip), lambda x: x != "")


def keywords(text: Column | str) -> Column:
    """Distinct lower-case ASCII words of four letters or digits and more, bounded as words of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z0-9]{4,}$")))


def keyword_overlap(question: Column | str, chunk: Column | str) -> Column:
    """Share of the question's keywords that the chunk has; 0 without keywords."""
    q = keywords(question)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, keywords(chunk))) / F.size(q))


def alphabetic_tokens(text: Column | str, least: int = 3) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"[a-z]{{{least},}}"), 0)


def content_words(text: Column | str) -> Column:
    """Whole ASCII words of three letters and more that aren't generic, repeats kept."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(W.GENERIC_WORDS))


def let(value: Column, use) -> Column:
    """use(value) with value computed once; Spark repeats an expression in each branch and lambda that names it."""
    return F.get(F.transform(F.array(value), use), 0)


# -- cleaning ------------------------------------------------------------------------------------------------------


def needles(alternatives: str) -> list[str]:
    """For each alternative of a pattern the longest string that any of its matches must hold, in lower case."""
    plain = re.sub(r"\(\?:[^()]*\)\??", "\0", alternatives)
    found = []
    for alternative in plain.split("|"):
        fixed = re.sub(r"\[[^\]]*\][?*+]?|\\b|\\[a-z][?*+]?|\.\{[0-9,]+\}|\.\*|.[?*]", "\0", alternative)
        found.append(max((x.replace("\\", "") for x in fixed.split("\0")), key=len).lower())
    return sorted(set(found))


def _gone(pattern: str, *held: str, by: str = "", sign=None):
    """A step that replaces a pattern in texts that hold one of some strings (in lower case) or show a sign: to look
    for a fixed string costs a fraction of a search by pattern, and most texts of a large collection hold none."""
    def step(t: Column) -> Column:
        gate = sign(t) if sign else let(F.lower(t), lambda low: functools.reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in held)))
        return F.when(gate, F.regexp_replace(t, pattern, by)).otherwise(t)

    return step


def _in_turn(text: Column, *steps) -> Column:
    for step in steps:
        text = let(text, step)
    return text


_HOURS = _gone(r"(?i)\[\s*\d+\s*L?\s*\]", "[")
_NUMBERS = lambda t: t.rlike(r"[0-9]\s+[0-9]")
_BREAKS = _gone("\n{3,}", "\n\n\n", by="\n\n")


def normalise(text: Column | str) -> Column:
    """Typography and course metadata out of a syllabus: dashes, hour marks, meta lines, number rows, blank runs."""
    return _in_turn(
        F.replace(col(text), F.lit("\r"), F.lit("")),
        _gone(r"(?<![\p{L}\p{N}_])([A-Za-z])\s*[–—]\s*([\p{L}\p{N}_])", "–", "—", by="$1-$2"),
        lambda t: F.translate(t, "–—", "--"),
        _HOURS,
        _gone(rf"(?i)(?:^|\n)[^\n]*?(?:{W.COURSE_META})[^\n]*", *needles(W.COURSE_META)),
        _gone(rf"(?i)(?:^|\n)\s*(?:Page:\s*\d+/\d+\s+)?[^\n]*?(?:{W.UNIVERSITY})[^\n]*", *needles(W.UNIVERSITY)),
        _gone(r"\b(?:\d+(?:\.\d+)?\s+){4,}\d+(?:\.\d+)?\b", sign=_NUMBERS),
        _gone("[ \t]{2,}", "  ", "\t", by=" "),
        _BREAKS,
    )


def clean_legacy(text: Column | str) -> Column:
    """Whole lines out of a legacy document: number rows, publishers, accreditation, headers, schemes, hour marks."""
    codes = "|".join(rf"\b{c}\b" for c in W.PUBLISHER_CODES)
    outcomes = [f"po{n}" for n in range(10)]  # of the alternative that is two letters and a number
    return strip(
        _in_turn(
            F.replace(col(text), F.lit("\r"), F.lit("")),
            _gone(r"(?m)^\s*(?:CO\d+|PO\d+)?\s*(?:\d+(?:\.\d+)?\s+){4,}\d+(?:\.\d+)?\s*$", sign=_NUMBERS),
            _gone(rf"(?i)(?:^|\n)[^\n]*?(?:{W.PUBLISHERS}|{codes}|ISBN)[^\n]*", *needles(f"{W.PUBLISHERS}|{codes}|ISBN")),
            _gone(rf"(?i)(?:^|\n)[^\n]*?(?:{W.ACCREDITATION})[^\n]*", *(x for x in needles(W.ACCREDITATION) if x != "po"), *outcomes),
            _gone(rf"(?i)(?:^|\n)\s*(?:Page\s*:\s*\d+[^\n]*|[^\n]*?(?:{W.LEGACY_UNIVERSITY})[^\n]*)", "page", *needles(W.LEGACY_UNIVERSITY)),
            _gone(rf"(?i)(?:^|\n)[^\n]*?(?:{W.LEGACY_META})[^\n]*", *needles(W.LEGACY_META)),
            _HOURS,
            _BREAKS,
        )
    )


def html_to_text(html: Column | str) -> Column:
    """Tags and entities become blanks, long white space a paragraph; script bodies stay."""
    t = F.regexp_replace(col(html), "<[^>]+>", " ")
    t = F.regexp_replace(t, r"&[\p{L}\p{N}_]+;", " ")
    return strip(F.regexp_replace(t, r"\s{3,}", "\n\n"))


def preview(text: Column | str, most: int = 200) -> Column:
    return F.when(F.length(col(text)) > most, F.concat(F.substring(col(text), 1, most), F.lit("..."))).otherwise(col(text))


# -- quality gates -------------------------------------------------------------------------------------------------


def header_ratio(text: Column | str) -> Column:
    """Share of lines that look like metadata fields; 1 without lines."""
    return let(lines(text), _header_share)


def _header_share(rows: Column) -> Column:
    return F.when(F.size(rows) == 0, 1.0).otherwise(F.size(F.filter(rows, lambda x: x.rlike(rf"(?i)^\s*(?:{W.HEADER_LINE})"))) / F.size(rows))


def is_low_information(text: Column | str, c: Config = DEFAULTS) -> Column:
    """Whether a chunk is to be left out before embedding: short, headers, few words, or no sign of teaching."""

    def poor(t: Column, rows: Column) -> Column:
        tokens = F.filter(alphabetic_tokens(t), lambda w: ~w.isin(W.QUALITY_STOP_WORDS))
        return (
            (F.length(t) < c.quality_chars)
            | (t.rlike(rf"(?i)^(?-i:[^a-z\n]){{0,30}}(?:{W.HEADER_START})") & (F.size(rows) <= 2))
            | (_header_share(rows) >= c.quality_headers)
            | (F.size(tokens) < c.quality_tokens)
            | ((F.length(t) < c.quality_pass) & ~has_word(t, W.EDUCATIONAL))
        )

    return let(strip(text), lambda t: let(lines(t), lambda rows: poor(t, rows)))


def has_publisher(text: Column | str, company: bool = False) -> Column:
    extra = r"|Ltd\.?|Inc\.?" if company else "|ISBN"
    return has(text, W.PUBLISHERS + extra) | has_word(text, "|".join(W.PUBLISHER_CODES))


def has_citation(text: Column | str) -> Column:
    """By-lines, quoted titles of five characters and more, numbered editions, ISBN; letters in any case."""
    quoted = "“[^”]{5,}”|\"[^\"]{5,}\"|'[^']{5,}'"
    return has(text, rf"{BEFORE}by\s+[A-Z][a-z]|{quoted}|{BEFORE}\d{{1,2}}(?:st|nd|rd|th)\s+Ed|{BEFORE}ISBN{AFTER}")


def is_reference_entry(text: Column | str, c: Config = DEFAULTS) -> Column:
    """Whether a chunk is a line of a reading list."""
    t = strip(text)
    listed = t.rlike(r"^\s*(?:\d{1,2}\.\s*)?.{5,60},\s*[A-Z][A-Za-z.\s]{1,30},\s*[A-Z]{2,5}\s*\.?\s*(?=\n|$)")
    published = has_publisher(t, company=True)
    return (F.length(t) <= c.reference_most) & (listed | (published & has_citation(t)) | ((F.length(t) < c.reference_most) & F.contains(t, F.lit(",")) & published & ~has(t, W.SYLLABUS_SIGNS)))


def is_noisy(text: Column | str, c: Config = DEFAULTS) -> Column:
    """Whether a retrieved chunk is to be hidden: short, a meta fragment, a number row, an outcome pair, a citation."""
    t = strip(text)
    return (
        (F.length(t) < c.cleaner_least)
        | t.rlike(r"(?i)^(?:Credits?|Contacts?|L[\-–]T[\-–]P|Hours?|Marks?|Scheme|Course\s*Code|Subject\s*Code|Paper\s*Code)\s*[:\-]?\s*[\d\w\-]*\s*$")
        | t.rlike(r"^(?:\s*(?:\d+(?:\.\d+)?)\s+){4,}\d+(?:\.\d+)?\s*$")
        | t.rlike(r"(?i)^(?:CO\d+|PO\d+)\s*[-:]\s*(?:CO\d+|PO\d+)\s*$")
        | has_publisher(t)
        | has_citation(t)
    )


# -- questions -----------------------------------------------------------------------------------------------------


def bloom_level(question: Column | str) -> Column:
    """The highest level with an action verb, else the first question form, else Unknown."""
    q = strip(question)
    out = None
    for level in W.BLOOM_ORDER:
        test = has_word(q, any_of(W.BLOOM_VERBS[level]))
        out = F.when(test, level) if out is None else out.when(test, level)
    for form, level in W.WH_FORMS:
        out = out.when(has_word(q, form), level)
    return out.otherwise("Unknown")


def difficulty(level: Column | str) -> Column:
    out = None
    for name, tier in W.DIFFICULTY.items():
        out = F.when(col(level) == name, tier) if out is None else out.when(col(level) == name, tier)
    return out.otherwise("Unknown")


def question_type(question: Column | str) -> Column:
    q = F.lower(col(question))
    among = lambda marks: q.rlike(any_of(marks))
    return F.when(among(W.APPLICATION_MARKERS), "application").when(among(W.DEFINITION_MARKERS), "definition").otherwise("unknown")


def core_terms(question: Column | str, most: int = 4) -> Column:
    return F.slice(F.filter(alphabetic_tokens(question, 1), lambda w: ~w.isin(W.CORE_STOP_WORDS)), 1, most)


def topic_present(question: Column | str, text: Column | str) -> Column:
    """Whether any core term is part of the lower-case text."""
    return F.exists(core_terms(question), lambda t: F.contains(F.lower(col(text)), t))


def external_domain(question: Column | str, text: Column | str) -> Column:
    """The first domain that the question names and the text doesn't; null if there is none."""
    found = F.coalesce(*(F.when(has_word(question, re.escape(d)) & ~has_word(text, re.escape(d)), F.lit(d)) for d in W.EXTERNAL_DOMAINS))
    return found


def split_questions(raw: Column | str) -> Column:
    """Questions of a paste: parted at 'Q1. ' or 'Q1: ' marks where there are any, else at line ends; blank ones go."""
    t = strip(raw)
    marked = F.split(t, r"Q\d+\s*[:.] ")
    return F.filter(F.transform(F.when(F.size(marked) > 1, marked).otherwise(F.split(t, "\n")), strip), lambda x: x != "")


def highlighted(question: Column | str, text: Column | str, stop_words: tuple[str, ...] = ("the", "and", "for", "with", "what", "how", "why", "are", "was")) -> Column:
    """Words of the text that hold, or are held by, a question word of three letters and more."""
    q = F.filter(F.split(F.lower(col(question)), r"[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(list(stop_words)))
    return F.filter(F.split(F.lower(col(text)), r"[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & F.exists(q, lambda w: F.contains(t, w) | F.contains(w, t)))


# -- metadata ------------------------------------------------------------------------------------------------------


def metadata(text: Column | str, head: int = 2000) -> dict[str, Column]:
    """Fields of a document's head, each by its first pattern with a value; null without one. A pattern is tried in heads
    that hold its fixed string."""

    def first(field: str) -> Column:
        def found(t: Column, low: Column) -> Column:
            values = [F.when(F.contains(low, F.lit(held)), strip(F.regexp_replace(strip(F.regexp_extract(t, f"(?i){p}", 1)), r"[:\-]$", ""))) for p, held in zip(W.METADATA[field], W.METADATA_HELD[field], strict=True)]
            return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))

        return let(F.substring(col(text), 1, head), lambda t: let(F.lower(t), lambda low: found(t, low)))

    return {field: first(field) for field in W.METADATA}


def document_type(text: Column | str) -> Column:
    t = col(text)
    titles = F.regexp_count(t, F.lit(rf"(?im)^\s*{W.TITLE_MARKER}"))
    score = sum((has(t, p).cast("int") for p in W.STRUCTURED_SIGNS), F.lit(0))
    return F.when(titles >= 2, "MULTI_SUBJECT_CURRICULUM").when((titles == 1) | (score >= 2), "STRUCTURED_SUBJECT").otherwise("LEGACY_SUBJECT")


def document_format(text: Column | str) -> Column:
    score = sum((F.contains(F.lower(col(text)), F.lit(s)).cast("int") for s in W.FORMAT_SIGNS), F.lit(0))
    return F.when(score >= 3, "AICTE").when(col(text).rlike(r"(?:Subject|Paper|Course) Code"), "SINGLE").otherwise("UNKNOWN")


def roman(semester: Column | str) -> Column:
    """A semester as a roman number: roman, ordinal, arabic (to 39) and written ones; else its first three letters."""
    s = F.upper(strip(semester))
    digits = F.regexp_extract(s, r"^(\d+)(?:ST|ND|RD|TH)?$", 1)
    n = digits.try_cast("int")
    tens, ones = F.array(*(F.lit(x) for x in ("", "X", "XX", "XXX"))), F.array(*(F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    number = F.when(n == 0, "?").when(n.between(1, 39), F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, n % 10)))
    names = dict(zip(["ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN"], ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"], strict=True))
    written = F.coalesce(*(F.when(s == k, v) for k, v in names.items()))
    return F.when(s.rlike("^[IVXLC]+$"), s).when(digits != "", number).otherwise(F.coalesce(written, F.substring(s, 1, 3)))


def semester_of_code(code: Column | str) -> Column:
    digit = F.regexp_extract(col(code), r"(\d)", 1)
    return F.when(digit != "", roman(digit))


def owner_of_code(code: Column | str) -> Column:
    owner = F.regexp_extract(F.upper(col(code)), "^([A-Z]+)", 1)
    return F.when(owner != "", owner)


def metadata_confidence(detected: Column | str, inferred: Column | str) -> Column:
    d, i = col(detected), col(inferred)
    missing = F.coalesce(d, F.lit("")).eqNullSafe("") | F.coalesce(i, F.lit("")).eqNullSafe("")
    return F.when(missing, 0.70).when(roman(d) == roman(i), 0.95).otherwise(0.60)


def department_short(department: Column | str) -> Column:
    d = strip(department)
    names = F.regexp_extract_all(d, F.lit("[A-Za-z]+"), 0)
    initials = F.array_join(F.transform(names, lambda w: F.substring(w, 1, 1)), "")
    return F.when((F.length(d) <= 4) & (F.upper(d) == d), d).when(F.size(names) >= 2, F.substring(F.upper(initials), 1, 4)).otherwise(F.upper(F.substring(d, 1, 3)))


def syllabus_id(department: Column | str, semester: Column | str, elective: Column | str, code: Column | str) -> Column:
    """A stable id: department-semester[-elective]-code; without a code, six digits of a digest."""
    blank = lambda c: F.coalesce(col(c), F.lit("")) == ""
    d = F.when(blank(department), "GEN").otherwise(department_short(department))
    s = F.when(blank(semester), "?").otherwise(roman(semester))
    e = F.upper(F.when(blank(elective), "CORE").otherwise(col(elective)))
    c = F.regexp_replace(F.upper(col(code)), r"[^A-Z0-9\-]", "")
    raw = F.concat_ws("-", d, s, e)
    coded = F.when((e != "CORE") & ~F.contains(c, e), F.concat_ws("-", d, s, e, c)).otherwise(F.concat_ws("-", d, s, c))
    return F.when(blank(code), F.concat_ws("-", raw, F.upper(F.substring(F.md5(raw), 1, 6)))).otherwise(coded)


def elective_type(code: Column | str, text: Column | str) -> Column:
    c = F.coalesce(col(code), F.lit(""))
    prefix = F.regexp_extract(F.upper(c), "^([A-Z]+)", 1)
    out = F.when(prefix == "PEC", "PEC").when(prefix.isin("OEC", "OE"), "OEC").when(prefix == "HSS", "HSS")
    both = F.concat(c, F.lit(" "), F.coalesce(col(text), F.lit("")))
    for name, pattern in W.ELECTIVES:
        out = out.when(both.rlike(f"(?i){pattern}"), name)
    return out.otherwise("CORE")


def department_of(text: Column | str, code: Column | str) -> Column:
    """From the programme's words, else the code's parts, else its leading letters, else the default."""
    named = strip(F.regexp_extract(col(text), r"(?i)\b(?:B\.?\s*Tech(?:\.?\s*in)?|M\.?\s*Tech(?:\.?\s*in)?|BCA\s+in|MCA\s+in|MBA\s+in)\s+([A-Za-z\s&/]{3,50})", 1))
    cut = strip(F.get(F.split(named, r"(?i)\b(?:Syllabus|Curriculum|Semester|Year|Session)\b"), 0))
    full = lambda a: F.coalesce(*(F.when(a == k, v) for k, v in W.DEPARTMENTS.items()), a)
    parts = F.filter(F.transform(F.split(F.coalesce(col(code), F.lit("")), "[^A-Za-z]"), F.upper), lambda p: p.isin(W.DEPARTMENT_CODES))
    lead = F.regexp_extract(F.upper(F.regexp_replace(F.coalesce(col(code), F.lit("")), "(?i)^PEC-|^OEC-|^HSS-", "")), "^([A-Z]+)", 1)
    return F.when(named != "", cut).when(F.size(parts) > 0, full(F.get(parts, 0))).when(lead != "", full(lead)).otherwise("Information Technology")


def program_of(text: Column | str) -> Column:
    mapped = strip(F.regexp_extract(col(text), r"(?i)Syllabus\s+and\s+Curricular\s+Mapping\s+for\s+([A-Za-z\.\s]+?)\s+in", 1))
    named = strip(F.regexp_extract(col(text), r"(?i)\b(B\.?\s*Tech|M\.?\s*Tech|BCA|MCA|MBA|B\.?\s*Sc)\b", 1))
    return F.when(mapped != "", mapped).when(named != "", named).otherwise("B.Tech")


def module_headings(text: Column | str, most: int = 10, width: int = 80) -> Column:
    found = F.regexp_extract_all(col(text), F.lit(r"(?i)(?:^|\n)\s*(?:Module|Unit|Chapter)\s*[-–:]?\s*(?:\d+|[IVXLC]+)\b[^\n]*"), 0)
    return F.slice(F.transform(found, lambda x: F.substring(strip(x), 1, width)), 1, most)


def module_of_chunk(text: Column | str) -> Column:
    """A module label from a chunk's own words; null if it has none."""
    t = col(text)
    marked = r"(?i)(?:^|\n)\s*(?:M(?:odule)?\s*([\dIVX]+)\s*[:–-]|UNIT\s*([\dIVX]+)\s*[:–-])\s*(.+)"
    number = F.concat(F.regexp_extract(t, marked, 1), F.regexp_extract(t, marked, 2))
    title = F.substring(strip(F.regexp_extract(t, marked, 3)), 1, 60)
    bare = r"(?:^|\n)\s*(\d{1,2})\s+([A-Z][^:\n]{2,60}?):\s*"
    return F.when(t.rlike(marked), F.concat(F.lit("Unit "), number, F.lit(": "), title)).when(
        t.rlike(bare), F.concat(F.lit("Unit "), F.regexp_extract(t, bare, 1), F.lit(": "), F.substring(strip(F.regexp_extract(t, bare, 2)), 1, 50))
    )
