"""Parsers of curriculum documents: lines are rows, states are windows over them.

Every window is partitioned by the document, whose lines came from one row, so no window holds more than a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import text as T
from auditlark.functions import words as W
from auditlark.operators import store

# Section headings, tried in this order.
TRIGGERS = [
    ("TITLE", r"(?:Course\s*Title|Course\s*Name|Subject\s*Name|Paper\s*Title)\s*[:\-–]"),
    ("OBJECTIVES", r"^Course\s*Objectives?\s*[:\-–]?$|^Objectives?\s*[:\-–]?$|COURSE\s*OBJECTIVE\s*[:\-–]?"),
    ("OUTCOMES", r"Course\s*Outcomes?\s*(?:\([^)]*\))?\s*[:\-–]?$|^Outcomes?\s*[:\-–]?$|COURSE\s*OUTCOMES?\s*\(?COs?\)?"),
    ("MAPPING", r"CO\s*-?\s*PO\s*Mapping|Mapping\s*of\s*COs|Course\s*Articulation\s*Matrix|CO\s*-?\s*PO\s*Correlation|Correlation\s*Matrix"),
    ("SYLLABUS", r"^(?:Units?|Syllabus|Modules?)\s*[:\-–]?$|University\s*Syllabus\s*[:\-–]|^\s*(?:Unit|Module|Chapter)\s*(?:\d+|[IVXLC]+)\s*[:\-–]?"),
    ("REFERENCES", r"^(?:References?|Reference\s*Books?|Text\s*Books?|Textbooks?|Suggested\s*Readings?|Bibliography|Resources?)\s*[:\-–]?$"),
]
INLINE = r"^\s*(?:Course\s*Objectives?|Objectives?|Course\s*Outcomes?|Outcomes?|CO-PO\s*Mapping|CO\s*PO\s*Mapping|CO-PO\s*Correlation|Units|Syllabus|References?|Suggested\s*Readings?|Bibliography)"
UNIT = r"(?i)^\s*(?:Unit|Module|Chapter)\s*(\d+|[IVXLC]+)\s*[:\-–]?\s*(.*)"
UNIT_TABLE = r"(?i)^\s*(?:Syllabus\s*Content|Content\s*Hrs/Unit|ontent\s*Hrs/Unit)\s*$"


def document_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line_no, line), blank lines left out; null texts give none."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(T.strip("line") != "")


def trigger(line: Column | str) -> Column:
    out = None
    for name, pattern in TRIGGERS:
        test = T.strip(line).rlike(f"(?i){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def inline_content(line: Column | str, name: Column) -> Column:
    """What stands behind a heading on its own line; unit headings stay whole."""
    unit = (name == "SYLLABUS") & T.col(line).rlike(r"(?i)^\s*(?:Unit|Module|Chapter)\b")
    rest = T.strip(F.regexp_replace(F.regexp_replace(T.col(line), f"(?i){INLINE}", ""), r"^[:\-–\s]+", ""))
    return F.when(unit, T.strip(line)).otherwise(rest)


def _so_far(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def may_have_title(text: Column | str) -> Column:
    lower = F.lower(T.col(text))
    return (F.contains(lower, F.lit("title")) | F.contains(lower, F.lit("name"))) & T.col(text).rlike(f"(?i){dict(TRIGGERS)['TITLE']}")


def may_have_code(text: Column | str) -> Column:
    """A mark in brackets may part the word, and is cleaned away."""
    return F.contains(F.lower(T.col(text)), F.lit("code")) | F.contains(T.col(text), F.lit("["))


def structured_lines(docs: DataFrame) -> DataFrame:
    """Lines of the courses of each document: course_no (from 1), state, raw line and content (null: none).

    A title line opens a course; what stands before the first one is dropped. The state is that of the last heading.
    """
    # texts that no title can be in are left before their lines are made
    titled = docs.where(may_have_title("text"))
    rows = document_lines(titled).withColumn("trigger", trigger("line"))
    w = _so_far("doc_id")
    rows = rows.select(
        "*",
        F.sum((F.coalesce("trigger", F.lit("")) == "TITLE").cast("int")).over(w).alias("course_no"),
        F.last("trigger", ignorenulls=True).over(w).alias("state"),
    ).where("course_no > 0")
    inline = inline_content("line", F.col("trigger"))
    content = F.when(F.col("trigger").isNull(), F.col("line")).when((F.col("trigger") != "TITLE") & (inline != ""), inline)
    return rows.select("doc_id", "course_no", "line_no", F.when(F.col("state") == "TITLE", "HEADER").otherwise(F.col("state")).alias("state"), "trigger", "line", content.alias("content"))


def _joined(condition: Column, value: Column | str, sep: str = "\n") -> Column:
    """Values of the rows that meet the condition, in line order."""
    parts = F.array_sort(F.collect_list(F.when(condition, F.struct(F.col("line_no"), T.col(value).alias("v")))))
    return T.strip(F.array_join(F.transform(parts, lambda p: p["v"]), sep))


def outcomes(lines: DataFrame) -> DataFrame:
    """(doc_id, course_no, co, text, bloom_level, difficulty): outcomes are numbered by place, whatever their own number."""
    own = lines.where("state = 'OUTCOMES' and content is not null").withColumn("content", T.strip("content"))
    starts = F.col("content").rlike(r"(?i)^\s*(?:CO\d+|[0-9]+)\s*[:\.]?\s*.+")
    text = F.when(starts, T.strip(F.regexp_extract("content", r"(?i)^\s*(?:CO\d+|[0-9]+)\s*[:\.]?\s*(.+)", 1))).otherwise(F.col("content"))
    w = _so_far("doc_id", "course_no")
    first = F.row_number().over(Window.partitionBy("doc_id", "course_no").orderBy("line_no")) == 1
    own = own.select("doc_id", "course_no", "line_no", text.alias("text"), (starts | first).cast("int").alias("new")).withColumn("n", F.sum("new").over(w))
    grouped = own.groupBy("doc_id", "course_no", "n").agg(_joined(F.lit(True), "text", " ").alias("text"))
    level = T.bloom_level("text")
    return grouped.select("doc_id", "course_no", F.concat(F.lit("CO"), F.col("n").cast("string")).alias("co"), "text", level.alias("bloom_level"), T.difficulty(level).alias("difficulty"))


def outcome_matrix(lines: DataFrame) -> DataFrame:
    """(doc_id, course_no, co, po, strength, pos): cells of the outcome matrix in long form.

    A line with PO1 gives labels. A row starts with CO and perhaps a number; its cells part at blanks and bars, and
    one that is no whole number is skipped but keeps its place. Without any such row, lines of three and more 1-3s
    count instead.
    """
    own = lines.where("state = 'MAPPING' and content is not null").withColumn("content", T.strip("content"))
    labels = F.transform(F.regexp_extract_all("content", F.lit(r"(?i)\b(?:PO\d+|PSO\d+|PO-\d+|PSO-\d+)\b"), 0), lambda x: F.replace(F.upper(x), F.lit("-"), F.lit("")))
    heading = (F.contains("content", F.lit("PO1")) | F.contains("content", F.lit("PO-1"))) & (F.size(labels) > 0)
    own = own.select("doc_id", "course_no", "line_no", "content", F.when(heading, labels).alias("labels"))
    own = own.withColumn("header", F.last("labels", ignorenulls=True).over(_so_far("doc_id", "course_no"))).where("labels is null")
    row = r"(?i)^\s*(CO\d+|CO)\b(.*)"
    cells = F.filter(F.transform(F.split(T.strip(F.regexp_extract("content", row, 2)), r"\s+|\|"), T.strip), lambda c: c != "")
    rows = own.where(F.col("content").rlike(row)).select("doc_id", "course_no", "line_no", "header", F.upper(F.regexp_extract("content", row, 1)).alias("co"), F.posexplode(cells).alias("pos", "cell"))
    cell = rows.where(F.col("cell").rlike(r"^[+-]?\d{1,9}$")).select(
        "doc_id", "course_no", "line_no", "co", F.coalesce(F.get("header", F.col("pos")), F.concat(F.lit("PO"), (F.col("pos") + 1).cast("string"))).alias("po"), F.col("cell").cast("int").alias("strength"), "pos"
    )
    numbered = F.dense_rank().over(Window.partitionBy("doc_id", "course_no").orderBy("line_no"))
    cell = cell.withColumn("co", F.when(F.col("co") == "CO", F.concat(F.lit("CO"), numbered.cast("string"))).otherwise(F.col("co")))
    # a label that comes twice in a row, or a row twice in a matrix: the last one stays
    cell = cell.withColumn("last", F.max("line_no").over(Window.partitionBy("doc_id", "course_no", "co"))).where("line_no = last")
    cell = cell.groupBy("doc_id", "course_no", "co", "po").agg(F.max_by("strength", "pos").alias("strength"), F.min("pos").alias("pos"))
    bare = F.regexp_extract_all("content", F.lit(r"\b[123]\b"), 0)
    plain = own.where(F.size(bare) >= 3).join(cell.select("doc_id", "course_no").distinct(), ["doc_id", "course_no"], "left_anti")
    number = F.row_number().over(Window.partitionBy("doc_id", "course_no").orderBy("line_no"))
    plain = plain.select("doc_id", "course_no", F.concat(F.lit("CO"), number.cast("string")).alias("co"), bare.alias("found"))
    plain = plain.select("doc_id", "course_no", "co", F.posexplode("found").alias("pos", "v"))
    plain = plain.select("doc_id", "course_no", "co", F.concat(F.lit("PO"), (F.col("pos") + 1).cast("string")).alias("po"), F.col("v").cast("int").alias("strength"), "pos")
    return cell.unionByName(plain)


def primary_outcomes(matrix: DataFrame) -> DataFrame:
    """(doc_id, course_no, co, po): the strongest label of each outcome, the first one of equals."""
    return matrix.groupBy("doc_id", "course_no", "co").agg(F.max_by("po", F.struct("strength", (-F.col("pos")).alias("p"))).alias("po"))


def units(lines: DataFrame) -> DataFrame:
    """(doc_id, course_no, unit_no, unit, title, content); lines before the first heading are unit 1, 'Syllabus Content'."""
    own = lines.where("state = 'SYLLABUS' and content is not null").where(~F.col("content").rlike(UNIT_TABLE))
    new = F.col("content").rlike(UNIT)
    first = F.row_number().over(Window.partitionBy("doc_id", "course_no").orderBy("line_no")) == 1
    own = own.select("*", new.alias("head"), (new | first).cast("int").alias("new")).withColumn("unit_no", F.sum("new").over(_so_far("doc_id", "course_no")))
    lead = F.min_by(F.struct("head", "content"), "line_no")
    grouped = own.groupBy("doc_id", "course_no", "unit_no").agg(lead.alias("lead"), _joined(~F.col("head"), "content").alias("content"))
    number, title = F.regexp_extract("lead.content", UNIT, 1), T.strip(F.regexp_extract("lead.content", UNIT, 2))
    return grouped.select(
        "doc_id", "course_no", "unit_no", F.when(F.col("lead.head"), number).otherwise("1").alias("unit"),
        F.when(~F.col("lead.head"), "Syllabus Content").when(title != "", title).otherwise(F.concat(F.lit("Unit "), number)).alias("title"), "content",
    )


#: A row of the outcome matrix, a cell that counts, and the digits of a line without any such row.
MATRIX_ROW, CELL, BARE = r"(?i)^\s*(CO\d+|CO)\b(.*)", r"^[+-]?\d{1,9}$", r"\b[123]\b"
#: What a line belongs to: an outcome, a unit, a row of the matrix, a bare line of the matrix, or the course alone.
OUTCOME, UNIT_LINE, ROW, BARE_LINE, COURSE = "outcome", "unit", "row", "bare", ""


def _tagged(docs: DataFrame) -> DataFrame:
    """structured_lines() with the kind and the item of each line, for aggregates by item and then by course.

    All windows run over a document's lines in their order, so they share one exchange and one sort; counts that start
    anew in each course are differences from the count at its title.
    """
    lines, w = structured_lines(docs), _so_far("doc_id")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state, there, text = F.col("state"), F.col("content").isNotNull(), T.strip("content")
    title = F.coalesce(F.col("trigger") == "TITLE", F.lit(False))
    outcome, unit, mapped = (state == "OUTCOMES") & there, (state == "SYLLABUS") & there & ~F.col("content").rlike(UNIT_TABLE), (state == "MAPPING") & there
    rows = lines.select("*", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in {"is_title": title, "is_outcome": outcome, "is_unit": unit, "is_mapped": mapped}.items()), text.alias("own"))
    found = F.transform(F.regexp_extract_all("own", F.lit(r"(?i)\b(?:PO\d+|PSO\d+|PO-\d+|PSO-\d+)\b"), 0), lambda x: F.replace(F.upper(x), F.lit("-"), F.lit("")))
    heading = F.col("is_mapped") & (F.contains("own", F.lit("PO1")) | F.contains("own", F.lit("PO-1")))
    starts = F.col("is_outcome") & F.col("own").rlike(r"(?i)^\s*(?:CO\d+|[0-9]+)\s*[:\.]?\s*.+")
    rows = rows.select("*", F.when(heading, F.when(F.size(found) > 0, found)).alias("labels"), starts.alias("starts"), (F.col("is_unit") & F.col("content").rlike(UNIT)).alias("head"))
    # labels hold until others come, or another course; the first line of a section opens an item whatever it is
    held = F.when(F.col("is_title"), F.struct(F.lit(None).cast("array<string>").alias("labels"))).when(F.col("labels").isNotNull(), F.struct("labels"))
    earlier = lambda c: F.coalesce(F.last(F.when(F.col(c), F.col("course_no")), ignorenulls=True).over(before), F.lit(0))
    rows = rows.select("*", F.last(held, ignorenulls=True).over(w)["labels"].alias("header"), earlier("is_outcome").alias("o_before"), earlier("is_unit").alias("u_before"))
    cells = F.filter(F.transform(F.split(T.strip(F.regexp_extract("own", MATRIX_ROW, 2)), r"\s+|\|"), T.strip), lambda c: c != "")
    placed = F.transform(cells, lambda c, i: F.struct(F.coalesce(F.get("header", i), F.concat(F.lit("PO"), (i + 1).cast("string"))).alias("po"), i.alias("pos"), F.when(c.rlike(CELL), c).cast("int").alias("strength")))
    is_row = F.col("is_mapped") & F.col("labels").isNull() & F.col("own").rlike(MATRIX_ROW)
    rows = rows.withColumn("cells", F.when(is_row, F.filter(placed, lambda x: x["strength"].isNotNull()))).withColumn("is_row", F.coalesce(F.size("cells") > 0, F.lit(False)))
    opened = lambda line, start, before: F.sum((F.col(line) & (F.col(start) | (F.col(before) != F.col("course_no")))).cast("int")).over(w)
    rows = rows.select("*", opened("is_outcome", "starts", "o_before").alias("n_outcome"), opened("is_unit", "head", "u_before").alias("n_unit"), F.sum(F.col("is_row").cast("int")).over(w).alias("n_row"))
    rows = rows.withColumn("n_row", F.col("n_row") - F.last(F.when(F.col("is_title"), F.col("n_row")), ignorenulls=True).over(w))
    co = F.upper(F.regexp_extract("own", MATRIX_ROW, 1))
    bare = F.when(F.col("is_mapped") & F.col("labels").isNull(), F.regexp_extract_all("own", F.lit(BARE), 0))
    rows = rows.withColumn("bare", bare)
    kinds = [
        ("is_outcome", OUTCOME, F.col("n_outcome").cast("string")), ("is_unit", UNIT_LINE, F.col("n_unit").cast("string")),
        ("is_row", ROW, F.when(co == "CO", F.concat(co, F.col("n_row").cast("string"))).otherwise(co)), (F.size("bare") >= 3, BARE_LINE, F.col("line_no").cast("string")),
    ]
    kind, item = F.when(F.lit(False), COURSE), F.when(F.lit(False), COURSE)
    for test, name, number in kinds:
        test = F.coalesce(T.col(test), F.lit(False))
        kind, item = kind.when(test, name), item.when(test, number)
    said = F.when(F.col("starts"), T.strip(F.regexp_extract("own", r"(?i)^\s*(?:CO\d+|[0-9]+)\s*[:\.]?\s*(.+)", 1))).otherwise(F.col("own"))
    return rows.select("*", kind.otherwise(COURSE).alias("kind"), item.otherwise("").alias("item"), F.when(F.col("is_outcome"), said).alias("said"))


def _latest(cells: Column) -> Column:
    """Of cells with one label the last one; a sort, and a look at the next."""
    by_label = F.array_sort(F.transform(cells, lambda x: F.struct(x["po"].alias("po"), x["pos"].alias("pos"), x["strength"].alias("strength"))))
    return T.let(by_label, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["po"] != x["po"], F.lit(True))))


def structured_courses(docs: DataFrame) -> DataFrame:
    """One row per course: header fields, sections, outcomes, matrix, units, warnings, counts, syllabus id.

    Lines are dealt by document and sorted once; items and then courses are aggregated where their lines are.
    """
    code_line = F.regexp_extract("line", r"(?i)(?:Course\s*Code|Subject\s*Code|Code)\s*[:\-–]\s*([A-Za-z0-9\-]{2,20})", 1)
    sem_line = F.regexp_extract("line", r"(?i)Semester\s*[:\-–]\s*(\d+(?:st|nd|rd|th)?|[IVXLC]+)", 1)
    in_header = (F.col("state") == "HEADER") & F.col("trigger").isNull()
    raw = T.strip(F.regexp_extract("line", r"(?i)^\s*(?:Course\s*Title|Course\s*Name|Subject\s*Name|Paper\s*Title)\s*[:\-–]\s*(.*)", 1))
    code_at = r"(?i)(?:\s+|\b)(?:Code|Course\s*Code|Subject\s*Code)\s*[:\-–]\s*([A-Za-z0-9\-]+).*$"
    sem_at = r"(?i)\bSemester\s*[:\-–]\s*(\d+(?:st|nd|rd|th)?|[IVXLC]+).*$"
    title_code = F.regexp_extract(raw, code_at, 1)
    before_code = T.strip(F.regexp_replace(raw, code_at, ""))
    title_sem = F.regexp_extract(before_code, sem_at, 1)
    title = T.strip(F.regexp_replace(before_code, sem_at, ""))
    nonempty = lambda c: F.when(c != "", c)
    lines = _tagged(docs).select("*", F.when(in_header, code_line).alias("code_line"), F.when(in_header, sem_line).alias("sem_line"), *(F.when(F.col("is_title"), v).alias(k) for k, v in {"t0": title, "c0": title_code, "s0": title_sem}.items()))
    at = lambda test, value: F.when(test, F.struct("line_no", T.col(value).alias("v")))
    parts = lambda test, value: F.collect_list(at(test, value))
    body = F.when(F.col("kind") == OUTCOME, F.col("said")).when((F.col("kind") == UNIT_LINE) & ~F.col("head"), F.col("content"))
    section = lambda name: (F.col("state") == name) & F.col("content").isNotNull()
    named = in_header & (F.col("code_line") == "") & (F.col("sem_line") == "")
    items = lines.groupBy("doc_id", "course_no", "kind", "item").agg(
        F.min("line_no").alias("first"), parts(body.isNotNull(), body).alias("body"), F.min(F.struct("line_no", "head", "content")).alias("lead"),
        F.max(at(F.col("is_row"), "cells")).alias("cells"), F.max(at(F.col("kind") == BARE_LINE, "bare")).alias("bare"),
        *(F.max(k).alias(k) for k in ("t0", "c0", "s0")), F.max(at(F.col("code_line") != "", "code_line")).alias("c1"), F.max(at(F.col("sem_line") != "", "sem_line")).alias("s1"),
        F.min(at(named, T.strip("line"))).alias("t1"), parts(section("OBJECTIVES"), "content").alias("objectives"), parts(section("REFERENCES"), "content").alias("references"), parts(F.lit(True), "line").alias("raw"),
    )
    spoken = lambda c, sep: T.strip(F.array_join(F.transform(F.array_sort(c), lambda p: p["v"]), sep))
    is_unit = F.col("kind") == UNIT_LINE
    items = items.withColumn("text", F.when(F.col("kind") == OUTCOME, spoken("body", " ")).when(is_unit, spoken("body", "\n")))
    items = items.withColumn("level", F.when(F.col("kind") == OUTCOME, T.bloom_level("text")))
    number, name = F.regexp_extract("lead.content", UNIT, 1), T.strip(F.regexp_extract("lead.content", UNIT, 2))
    items = items.select(
        "*", T.difficulty("level").alias("difficulty"), F.when(F.col("lead.head"), number).otherwise("1").alias("unit"),
        F.when(~F.col("lead.head"), "Syllabus Content").when(name != "", name).otherwise(F.concat(F.lit("Unit "), number)).alias("unit_title"),
    )
    of = lambda kind, *columns: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns))))
    whole = lambda c: spoken(F.flatten(F.collect_list(c)), "\n").alias(c)
    rows = items.groupBy("doc_id", "course_no").agg(
        *(F.max(k).alias(k) for k in ("t0", "c0", "s0")), F.max("c1")["v"].alias("c1"), F.max("s1")["v"].alias("s1"), F.min("t1")["v"].alias("t1"),
        whole("objectives"), whole("references"), whole("raw").alias("raw_text"),
        of(OUTCOME, "first", "text", F.col("level").alias("bloom_level"), "difficulty").alias("outcomes"), of(UNIT_LINE, "first", "unit", F.col("unit_title").alias("title"), F.col("text").alias("content")).alias("units"),
        of(ROW, F.col("item").alias("co"), F.col("cells.v").alias("cells")).alias("cells"), of(BARE_LINE, "first", F.col("bare.v").alias("bare")).alias("bare"),
    )
    numbered = lambda prefix, i: F.concat(F.lit(prefix), (i + 1).cast("string"))
    outcomes_ = F.array_sort(F.transform("outcomes", lambda x, i: F.struct(numbered("CO", i).alias("co"), x["text"].alias("text"), x["bloom_level"].alias("bloom_level"), x["difficulty"].alias("difficulty"))))
    units_ = F.transform("units", lambda x, i: F.struct((i + 1).cast("long").alias("unit_no"), x["unit"].alias("unit"), x["title"].alias("title"), x["content"].alias("content")))
    cell = lambda co, po, strength: F.struct(co.alias("co"), po.alias("po"), strength.alias("strength"))
    marked = F.flatten(F.transform("cells", lambda r: F.transform(_latest(r["cells"]), lambda x: cell(r["co"], x["po"], x["strength"]))))
    bare = F.flatten(F.transform("bare", lambda r, i: F.transform(r["bare"], lambda v, j: cell(numbered("CO", i), numbered("PO", j), v.cast("int")))))
    filled = lambda c: F.when(F.size(c) > 0, c)
    rows = rows.withColumns({"outcomes": filled(outcomes_), "units": filled(units_), "matrix": filled(F.array_sort(F.when(F.size("cells") > 0, marked).otherwise(bare)))}).drop("cells", "bare")
    rows = rows.select("*", F.coalesce(nonempty(F.col("c1")), nonempty(F.col("c0")), F.lit("")).alias("code"), F.coalesce(nonempty(F.col("s1")), nonempty(F.col("s0"))).alias("given"), F.coalesce(nonempty(F.col("t0")), F.col("t1"), F.lit("")).alias("name"))
    # each step is a projection of its own, so that no expression is spelled out inside another
    rows = rows.withColumns({"inferred": T.semester_of_code("code"), "department": T.department_of("raw_text", "code"), "elective_type": T.elective_type("code", F.substring("raw_text", 1, 1000))})
    rows = rows.withColumn("written", F.coalesce("given", "inferred"))
    rows = rows.withColumn("semester", F.when(F.col("written").isNull(), "Unknown").otherwise(T.roman("written")))
    inferred = F.col("inferred")
    warn = lambda test, words: F.when(test, words)
    warnings = F.array_compact(F.array(
        warn(F.col("outcomes").isNull(), "Course Outcomes not found"), warn(F.col("matrix").isNull(), "CO-PO table not found"), warn(F.col("given").isNull(), "Semester not explicitly found"),
        warn(F.col("references") == "", "References missing"), warn(F.col("given").isNull() & inferred.isNotNull(), "Semester inferred from code"),
    ))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.select(
        "doc_id", "course_no", F.col("name").alias("subject_name"), F.col("code").alias("subject_code"), "semester", "department", T.program_of("raw_text").alias("program"),
        T.owner_of_code("code").alias("subject_owner"), "elective_type", T.syllabus_id("department", "semester", "elective_type", "code").alias("syllabus_id"), "objectives", "references",
        "outcomes", "matrix", "units", warnings.alias("warnings"), size("outcomes").alias("co_count"),
        F.coalesce(F.size(F.array_distinct(F.transform("matrix", lambda x: x["co"]))), F.lit(0)).alias("po_count"), size("units").alias("module_count"),
        F.lit("AICTE").alias("parser"), F.lit(0.97).alias("parser_confidence"), F.lit(0.95).alias("metadata_confidence"), F.col("raw_text").alias("text"),
    )


def course_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, block): a document's text from each title marker to the next; what stands before is dropped."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = F.col("line").rlike(rf"(?i)^\s*{W.TITLE_MARKER}").cast("int")
    rows = rows.withColumn("block_no", F.sum(marked).over(_so_far("doc_id"))).where("block_no > 0")
    return rows.groupBy("doc_id", "block_no").agg(_joined(F.lit(True), "line").alias("block")).where("block <> ''")


# Parts of lines that are never a subject's name, and words that are no department.
EXCLUSIONS = [
    "course name", "subject name", "course code", "subject code", "paper code", "paper name", "name of the course", "name of the paper", "contacts", "credit",
    "objective", "outcome", "references", "text book", "reference book", "teaching scheme", "examination scheme", "syllabus for", "department of", "session",
    "semester", "ltp", "l-t-p",
]
NOT_DEPARTMENTS = ["semester", "session", "university of", "formerly", "technology university", "west bengal", "maulana", "syllabi", "curriculum"]
SEMESTER = r"(?i)^\s*(?:SEMESTER|SEM)\s*[-–:—]?\s*([IVXLC]+|\d+|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)(?:\s*(?:Semester|Sem))?(?=\s|$)"
ORDINAL_SEMESTER = r"(?i)^\s*(\d+)(?:st|nd|rd|th)\s*Semester(?=\s|$)"
CODE = r"(?i)^\s*(?:Course\s*Code|Subject\s*Code|Paper\s*Code|Code)\s*[:\-]\s*([A-Za-z0-9][A-Za-z0-9\-]{1,15})"
NAME = r"(?i)(?:Course|Subject|Paper)\s*(?:Name|Title)\s*[:\-]\s*(.+)"


def global_context(lines: DataFrame) -> DataFrame:
    """(doc_id, program, department) from a document's first 150 lines: the last programme, and the first acceptable
    department unless a later line says dept."""
    head = lines.where("raw_no < 150")
    program = F.regexp_extract("line", r"(?i)\b(B\.?\s*Tech|M\.?\s*Tech|BCA|MCA|MBA|B\.?\s*Sc)\b", 1)
    given = T.strip(F.regexp_extract("line", r"(?i)(?:for|of|in|Dept\.?\s*of)\s+\(?([A-Za-z\s&/]{2,60})\)?", 1))
    cand = F.regexp_replace(given, r"(?i)^(?:B\.?\s*Tech|M\.?\s*Tech|BCA|MCA|MBA|B\.?\s*Sc|M\.?\s*Sc)\s+(?:in|of|for|—|-)\s+", "")
    fine = (F.length(cand) >= 2) & ~F.lower(cand).rlike(T.any_of(NOT_DEPARTMENTS)) & ~F.lower(cand).isin("technology", "engineering", "science")
    dept = F.contains(F.lower("line"), F.lit("dept"))
    found = head.groupBy("doc_id").agg(
        F.max_by(program, F.when(program != "", F.col("line_no"))).alias("p"),
        F.min_by(cand, F.when(fine, F.col("line_no"))).alias("d0"), F.max_by(cand, F.when(fine & dept, F.col("line_no"))).alias("d1"),
    )
    return found.select("doc_id", F.coalesce("p", F.lit("Unknown Program")).alias("program"), F.coalesce("d1", "d0", F.lit("Department Unknown")).alias("department"))


def legacy_subjects(docs: DataFrame, fix_semester: bool = False, c: Config = DEFAULTS) -> DataFrame:
    """One row per subject of documents without structure: a title line followed by a code line opens a subject.

    A subject's semester is the last one named before the next subject opens, or with fix_semester before its own.
    Reading lists are left out until the next semester or subject; blocks below c.legacy_block characters are dropped.
    """
    # only a line with a code opens a subject: documents that hold none leave before their lines are sorted
    lines = T.let(F.split(T.clean_legacy("text"), "\n"), lambda own: F.when(F.exists(own, lambda x: T.strip(x).rlike(CODE)), own))
    cleaned = docs.where(may_have_code("text")).select("doc_id", F.posexplode(lines).alias("raw_no", "line"))
    rows = cleaned.select("doc_id", "raw_no", F.col("raw_no").alias("line_no"), T.strip("line").alias("line")).where("line <> ''")
    context = global_context(rows)
    sem = F.coalesce(*(F.when(F.regexp_extract("line", p, 1) != "", F.regexp_extract("line", p, 1)) for p in (SEMESTER, ORDINAL_SEMESTER)))
    code = F.regexp_extract("line", CODE, 1)
    excluded = F.lower("line").rlike(T.any_of(EXCLUSIONS))
    rows = rows.select("*", F.when(F.length(sem) < 10, sem).alias("sem"), excluded.alias("excluded"))
    rows = rows.withColumn("code", F.when(F.col("sem").isNull() & (code != ""), code))
    plain = F.col("sem").isNull() & F.col("code").isNull()
    candidate = plain & F.length("line").between(4, 80) & ~F.col("excluded") & ~F.col("line").endswith(":") & ~F.col("line").rlike(r"\d{2,}")
    # setters of the candidate: its own line, a metadata line and a code line clear it
    setter = F.when(candidate, F.struct(F.col("line").alias("name"))).when((plain & F.col("excluded")) | F.col("code").isNotNull(), F.struct(F.lit(None).cast("string").alias("name")))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", plain.alias("plain"), F.last(setter, ignorenulls=True).over(before)["name"].alias("held"))
    named = F.regexp_extract("line", NAME, 1)
    inline = F.col("code").isNotNull() & (named != "") & ~F.col("excluded")
    rows = rows.select("*", inline.alias("inline"), F.when(inline, T.strip(named)).when(F.col("code").isNotNull(), F.col("held")).alias("opens"))
    so_far = _so_far("doc_id")
    rows = rows.withColumn("subject_no", F.sum(F.col("opens").isNotNull().cast("int")).over(so_far))
    ref = F.when(F.col("opens").isNotNull() | F.col("sem").isNotNull(), 0).when(F.col("plain") & F.col("line").rlike(f"(?i)^{W.REFERENCE_HEADING}"), 1)
    rows = rows.select("*", F.coalesce(F.last(ref, ignorenulls=True).over(so_far), F.lit(0)).alias("reading"), F.last("sem", ignorenulls=True).over(so_far).alias("sem_now"))
    kept = (F.col("plain") & (F.col("reading") == 0)) | (F.col("code").isNotNull() & F.col("opens").isNull())
    line = F.when(F.col("opens").isNotNull() & ~F.col("inline"), F.concat(F.lit("Subject Name: "), "opens", F.lit("\n"), "line")).otherwise(F.col("line"))
    opener = F.col("opens").isNotNull()
    subjects = rows.where("subject_no > 0").groupBy("doc_id", "subject_no").agg(
        F.min_by("opens", "line_no").alias("subject_name"), F.min_by("code", "line_no").alias("subject_code"), _joined(opener | kept, line).alias("text"),
        F.min_by("sem_now", "line_no").alias("own_sem"), F.max_by("sem_now", "line_no").alias("late_sem"),
    ).where(F.length("text") >= c.legacy_block)
    rows = subjects.join(context, "doc_id").select("*", (F.col("own_sem") if fix_semester else F.col("late_sem")).alias("detected"))
    rows = rows.withColumns({"inferred": T.semester_of_code("subject_code"), "elective_type": T.elective_type("subject_code", F.substring("text", 1, 400)), "detected": F.coalesce("detected", F.lit("Unknown"))})
    rows = rows.withColumn("final", F.when(F.col("detected") != "Unknown", F.col("detected")).otherwise(F.coalesce("inferred", F.lit("Unknown"))))
    return rows.select(
        "doc_id", "subject_no", "subject_name", "subject_code", T.roman("final").alias("semester"), "department", "program", T.owner_of_code("subject_code").alias("subject_owner"), "elective_type",
        T.syllabus_id("department", "final", "elective_type", "subject_code").alias("syllabus_id"), T.metadata_confidence("detected", "inferred").alias("metadata_confidence"),
        T.module_headings("text").alias("modules"), "text",
    )


def segments(docs: DataFrame) -> DataFrame:
    """Every document by its route: structured parser, that parser per block, or the legacy one; else a fallback.

    (doc_id, syllabus_id, department, program, semester, subject_code, subject_name, elective_type, route, text)

    Only texts that a parser can find a title or a code in are routed; what the parsers find is Parquet, as the fallback
    asks for it too.
    """
    routed = docs.where(may_have_title("text") | may_have_code("text")).withColumn("route", T.document_type("text"))
    shared = ["doc_id", "syllabus_id", "department", "program", "semester", "subject_code", "subject_name", "elective_type", "route", "text"]
    parsed = structured_courses(routed.where("route <> 'LEGACY_SUBJECT'")).withColumn("route", F.lit("STRUCTURED")).select(shared)
    legacy = legacy_subjects(routed.where("route = 'LEGACY_SUBJECT'")).withColumn("route", F.lit("LEGACY")).select(shared)
    found = parsed.unionByName(legacy)
    found.write.parquet(folder := store.scratch(docs.sparkSession, "segments"))
    found = docs.sparkSession.read.schema(found.schema).parquet(folder)
    rest = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    about = rest.select("doc_id", "text", *(v.alias(k) for k, v in T.metadata("text").items()))
    about = about.withColumns({"department": F.coalesce("department", F.lit("Department Unknown")), "elective_type": F.lit("CORE"), "route": F.lit("FALLBACK")})
    fallback = about.withColumns({
        "syllabus_id": T.syllabus_id("department", "semester", "elective_type", "subject_code"), "program": F.coalesce("program", F.lit("Unknown Program")),
        "subject_name": F.coalesce("subject_name", F.lit("Unknown Subject")), "semester": F.coalesce("semester", F.lit("Unknown")),
    }).select(shared)
    return found.unionByName(fallback)
