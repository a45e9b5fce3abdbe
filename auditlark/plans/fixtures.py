"""Small curriculum texts, written for the queries: both engines see them beside the driver's documents."""

from __future__ import annotations

def course(title: str, code: str, semester: str, sections: list[tuple[str, list[str]]], above: tuple[str, ...] = ()) -> str:
    """A course in the headed form: its title line opens it, sections follow in the given order."""
    head = [f"Paper Title - {title}", *([f"Semester: {semester}"] if semester else []), *([f"Subject Code - {code}"] if code else [])]
    return "\n".join([*above, *head, *(line for heading, lines in sections for line in (heading, *lines))])


#: Readings before units before outcomes; outcomes numbered oddly and out of order, labels of the matrix too; bars.
STRUCTURED = course(
    "Tidal Surveying", "OE-CE514C", "5th", above=("Regulations of the B.Tech in Civil Engineering, second reprint", "Objectives", "Nobody keeps what stands before a title."), sections=[
        ("Suggested Readings", ["Tide tables of the harbour office", "Marsh, Levels and Staffs"]),
        ("Units :", ["Chapter IV : Levelling on mud", "Staff readings between two tides.", "Unit 9", "Echo sounding lines"]),
        ("Course Outcomes :", ["7. Sketch how a sounding plan", "of a river mouth is laid out", "CO3: Appraise a tide table", "1 Construct a gauge"]),
        ("Course Articulation Matrix", ["| PO3 | PO1 | PSO2 |", "CO1 | 1 | 3 | 2", "CO2 | x | | 2", "co | 2 | - | 1"]),
        ("Objectives :", ["To tell the shore from the sea."]),
    ],
)

#: Two courses, one without a semester and with bare matrix lines, one that is nearly empty.
MULTI = "\n".join([
    course("Orchard Ecology    Code: CS407", "", "", [
        ("Correlation Matrix", ["2 2 3", "note", "1 3 1 2"]), ("Outcomes", ["Prune by rule."]),
        ("University Syllabus:", ["Soil before any unit", "Module III - Grafting", "Whip and tongue"]),
    ]),
    course("Glass", "ME-316", "9", [("Textbooks :", ["Kiln notes"]), ("Course Objective", ["Anneal slowly"])]),
])


def subject(semester: str, name: str, code: str, *lines: str) -> str:
    """A subject in the older form: its name stands above its code."""
    return "\n".join([f"SEM {semester}", name, f"Paper Code: {code}", *lines])


LEGACY = "\n".join([
    "M.Tech in Information Technology (second year)",
    subject("III", "Queueing in Hospitals", "IT913", "Chapter 1 Arrivals at night, triage and the length of a queue when beds are few and staff is short.", "Chapter 2 Discharge rules and what they do to waiting."),
    subject("IV", "Map Projections", "OE-IT927", "Chapter 1 Cylinders, cones and planes; what each of them keeps and what it gives up near a pole.", "Suggested Reading", "Left out until another subject"),
])

PLAIN = """Name of the Subject: Brewing
Subject Name: Brewing Chemistry
Course Code: CH-307
Semester: 3rd
Board of Studies: Food
Department: Chemical Engineering
Credit Points: 4
2.00 1.00 0 1.75 3.00 2.00
M – Way and V – Belt [ 2 P ]
7. Mashing and the enzymes of malt.
8. Hops: oils and resins."""

SECTIONED = """Preface of the printer
UNIT - IV
A first body without a stop
Chapter 12: Dyes
Indigo is vatted. Madder is mordanted twice.
Reference Books
Left out
Module 2
Last"""

READING = "Salt and Silver, P. Okoro, PHI"

#: Ids are negative, so that they never meet those of documents.
TEXTS = {-1: STRUCTURED, -2: MULTI, -3: LEGACY, -4: PLAIN, -5: SECTIONED, -6: READING, -7: "", -8: "Which dye fades? State \"the rule of thirds\" by Okoro, Wiley"}


def sql_values() -> str:
    """The texts as a DuckDB relation t(doc_id, text)."""
    rows = ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in TEXTS.items())
    return f"(VALUES {rows}) AS t(doc_id, text)"
