"""Chunking of syllabus text by array functions: sections, topics, and greedy packing as folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import text as T
from auditlark.functions import words as W

MARK = "\u0001"
HEADING = r"(?i)(?:^|\n)\s*(?:Module|Unit|Chapter)\s*[\-–:]?\s*(\d+|[IVXLC]+)\b"
TITLED = r"(?:^|\n)\s*(\d{1,2})\s+([A-Z][^:\n]{2,80}?):\s*"
TOPIC = r"((?:^|\n)\s*\d{1,2}(?:\.|\s+(?=[A-Z]))\s*)"


def packed(parts: Column, sep: str, c: Config = DEFAULTS) -> Column:
    """Greedy packing: parts join with sep while the whole stays within c.chunk_most; pieces below c.chunk_least go."""
    kept = lambda out, piece: F.when(F.length(T.strip(piece)) >= c.chunk_least, F.array_append(out, T.strip(piece))).otherwise(out)
    start = F.struct(F.expr("cast(array() as array<string>)").alias("o"), F.lit("").alias("c"))
    folded = F.aggregate(
        parts,
        start,
        lambda a, x: F.when(
            (F.length(a["c"]) + F.length(x) + 1 > c.chunk_most) & (a["c"] != ""), F.struct(kept(a["o"], a["c"]).alias("o"), x.alias("c"))
        ).otherwise(F.struct(a["o"].alias("o"), F.when(a["c"] == "", x).otherwise(T.strip(F.concat(a["c"], F.lit(sep), x))).alias("c"))),
        lambda a: kept(a["o"], a["c"]),
    )
    return folded


def sentences(text: Column | str) -> Column:
    return F.split(T.col(text), r"(?<=\.)\s+")


SECTIONS = "array<struct<label:string,body:string>>"


def sections(text: Column | str) -> Column:
    """array<struct<label, body>>: by unit headings, else by two and more numbered titles, else the whole."""

    def cut(t: Column, pattern: str, label) -> Column:
        def joined(bodies: Column) -> Column:
            lead = F.when(F.get(bodies, 0) != "", F.array(F.struct(F.lit(None).cast("string").alias("label"), F.get(bodies, 0).alias("body")))).otherwise(F.expr(f"cast(array() as {SECTIONS})"))
            return F.concat(lead, F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), lambda h, i: F.struct(label(h).alias("label"), F.get(bodies, i + 1).alias("body"))))

        return T.let(F.transform(F.split(t, pattern, -1), T.strip), joined)

    def parted(t: Column) -> Column:
        headed = cut(t, HEADING, lambda h: F.concat(F.lit("Unit "), F.regexp_extract(h, HEADING, 1)))
        titled = cut(t, TITLED, lambda h: F.concat(F.lit("Unit "), F.regexp_extract(h, TITLED, 1), F.lit(": "), T.strip(F.regexp_extract(h, TITLED, 2))))
        whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), T.strip(t).alias("body")))
        # fixed strings first: a search for them costs a fraction of one by pattern
        may_head = T.let(F.lower(t), lambda low: F.contains(low, F.lit("module")) | F.contains(low, F.lit("unit")) | F.contains(low, F.lit("chapter")))
        may_title = F.contains(t, F.lit(":")) & t.rlike("[0-9]")
        return F.when(may_head & t.rlike(HEADING), headed).when(may_title & (F.regexp_count(t, F.lit(TITLED)) >= 2), titled).otherwise(whole)

    return T.let(T.col(text), parted)


def without_references(body: Column) -> Column:
    """A section up to its first reading-list heading."""
    return T.strip(F.get(F.split(body, rf"(?im)^[ \t]*{W.REFERENCE_HEADING}", 2), 0))


def topics(body: Column, c: Config = DEFAULTS) -> Column:
    """Numbered topics of a section if there are two and more, else its lines packed, else the section."""

    def cut(b: Column) -> Column:
        numbered = F.filter(F.transform(F.split(F.regexp_replace(b, TOPIC, f"{MARK}$1"), MARK), T.strip), lambda x: F.length(x) >= c.chunk_least)
        lines = packed(F.filter(F.transform(F.split(b, "\n"), T.strip), lambda x: x != ""), "\n", c)
        whole = F.filter(F.array(b), lambda x: F.length(x) >= c.chunk_least)
        return F.when(b.rlike("[0-9]") & (F.regexp_count(b, F.lit(TOPIC)) >= 2), numbered).otherwise(T.let(lines, lambda own: F.when(F.size(own) > 0, own).otherwise(whole)))

    return T.let(without_references(body), cut)


def implicit_label(chunk: Column) -> Column:
    first = F.get(F.split(T.strip(chunk), "\n"), 0)
    title = T.strip(F.get(F.split(F.regexp_replace(first, r"^(\d{1,2}\.?\s*|\-\s*|•\s*)", ""), r"[,:;.]|\s*-\s*"), 0))
    return F.when(F.length(title).between(3, 60), title).otherwise("Unknown")


def chunks(docs: DataFrame, c: Config = DEFAULTS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, chunk_no from 0, text, module): one topic each, long ones packed by sentences."""
    # one step a projection: what a step makes is computed once
    clean = docs.select("doc_id", T.normalise("text").alias("clean"))
    sect = clean.select("doc_id", F.posexplode(sections("clean")).alias("s", "section")).where("section.body <> ''")
    topic = sect.select("doc_id", "s", F.col("section.label").alias("label"), F.posexplode(topics(F.col("section.body"), c)).alias("t", "topic"))
    label = F.coalesce("label", implicit_label(F.col("topic")))
    pieces = F.when(F.length("topic") <= c.chunk_most, F.array("topic")).otherwise(packed(sentences("topic"), " ", c))
    piece = topic.select("doc_id", "s", "t", label.alias("module"), F.posexplode(pieces).alias("p", "text"))
    number = F.expr("row_number() over (partition by doc_id order by s, t, p) - 1")
    return piece.select("doc_id", number.alias("chunk_no"), "text", "module")
