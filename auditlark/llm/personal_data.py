"""Personal data: fixed patterns first, then bootstrapped contextual extraction; DataFrame functions only.

Base spans seed the extraction. An instance is a run of number groups, or another word with a digit or an at sign.
Its lexical patterns have several widths: the two words before it, the last word before it, its own prefix up to an
equals sign or colon, each with the rough form of the instance; a form without a context is no pattern. Patterns and
instances form a graph that Spark scores in turn: a pattern is as sure as the instances it holds, an instance as its
patterns together. Sure patterns with enough distinct seeds mark the instances that the fixed patterns missed; these
become seeds themselves, and the graph is scored anew until none is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlark.llm.common import documents_of, written

# Kinds in their order, and patterns equal to the given ones for every match. Possessive repeats and
# the look-behinds only spare Java the search from inside a run that has failed already.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A number group fills its word but for end punctuation; addresses of four numbers are words of their own, and neither
# a plus nor what follows a dot and a blank carries on a run.
GROUP = r"(?![0-9]++(?:\.[0-9]++){3})\(*+[0-9][0-9().-]*+(?=[,;:!?]*+(?:[\x20\x09-\x0D]|\z))"
# A group with nine digits on end is a number of its own, and carries on no run.
SHORT = rf"(?!\(*+[0-9().-]*?[0-9]{{9}}){GROUP}"
RUN = rf"\(*+\+?+(?:{SHORT}(?:(?<=[0-9)-])\x20++(?:-\x20++)?+{SHORT})*+|{GROUP})[,;:!?]*+"
INSTANCE = rf"(?<![^\x20\x09-\x0D])(?:{RUN}|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"

SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


#: Matches of one block of a fold that appends; blocks, and matches within each, are folded by themselves.
BLOCK = 256


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def placed(text: Column, pattern: str) -> Column:
    """(start, gap, match) of all matches, in code points: the gaps between matches, from split(), add up to the starts.

    A fold that appends costs the square of its length, so that the sums are taken in blocks.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))
    size = lambda x: F.length(x["gap"]) + F.length(x["match"])
    total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + size(x))
    row = "struct<start:int,gap:string,match:string>"

    def within(block: Column, base: Column) -> Column:
        out = F.aggregate(
            block,
            F.struct(base.alias("at"), F.expr(f"cast(array() as array<{row}>)").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + size(x)).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["gap"])).alias("start"), x["gap"].alias("gap"), x["match"].alias("match"))).alias("out"),
            ),
        )
        return out["out"]

    def in_blocks(found: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(found) - 1) / BLOCK)).cast("int")), lambda k: F.slice(found, k * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda own: _let(_running(F.transform(own, total)), lambda bases: F.flatten(F.transform(own, lambda block, k: within(block, F.get(bases, k))))))

    return _let(F.filter(pairs, lambda x: x["match"].isNotNull()), in_blocks)


def _running(sizes: Column) -> Column:
    """Sums of all that come before each."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches as spans of a kind."""
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end"), x["match"].alias("match"))
    return F.transform(placed(text, pattern), span)


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's test: every second one from the right counts double, by its digits."""
    n = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.when((n - k) % 2 == 1, (F.substring(digits, k, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, k, F.lit(1)).cast("int") * 2 / 10).cast("int")).otherwise(
            F.substring(digits, k, F.lit(1)).cast("int")
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid_ip(match: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(match, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(999)) <= 255))


def valid_card(match: Column) -> Column:
    digits = F.regexp_replace(match, "[ -]", "")
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def valid_phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    none = F.expr(f"cast(array() as {SPAN})")
    digit = text.rlike("[0-9]")
    parts = [
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL, 0)).otherwise(none),
        F.when(digit & text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP, 1), lambda s: valid_ip(s["match"]))).otherwise(none),
        F.when(digit, F.filter(located(text, CARD, 2), lambda s: valid_card(s["match"]))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, 3), lambda s: valid_phone(s["match"]))).otherwise(none),
    ]
    return F.array_sort(F.concat(*parts))


def instances(text: Column) -> Column:
    """Runs of number groups, and words with a digit or an at sign: place, the run or word without end punctuation, and
    up to two words before it on the way from the last one, whatever their length."""
    kind = "array<struct<start:int,end:int,word:string,before:string>>"
    word = lambda x: F.regexp_replace(x["match"], "[.,;:!?]+$", "")
    # backwards, the words before come first
    behind = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++(?:[\x20\x09-\x0D][^\x20\x09-\x0D]++)?+)"
    before = lambda x: F.reverse(F.regexp_extract(F.reverse(F.lower(x["gap"])), behind, 1))
    found = F.transform(
        placed(text, INSTANCE),
        lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(word(x))).alias("end"), word(x).alias("word"), before(x).alias("before")),
    )
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.expr(f"cast(array() as {kind})"))


def shape(word: Column) -> Column:
    """A word's or run's rough form: runs of digits, letters and blanks as one sign each."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[A-Za-z]+", "a"), "[0-9]+", "9"), r"\x20+", " ")


def patterns_of(word: Column, before: Column) -> Column:
    """The patterns of an instance as (context, form), each context marked with its width."""
    pattern = lambda width, context, form: F.struct(F.concat(F.lit(width), context).alias("context"), form.alias("form"))
    prefix = F.regexp_extract(F.lower(word), "^([^=:0-9]*+[=:][\"']?)", 1)
    last = F.regexp_extract(before, r"([^\x20\x09-\x0D]++)$", 1)
    given = F.array(
        F.when(before != last, pattern("2:", before, shape(word))), F.when(last != "", pattern("1:", last, shape(word))), F.when(prefix != "", pattern("=:", prefix, shape(word))),
    )
    return F.filter(given, lambda x: x.isNotNull())


def span_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _patterns(known: DataFrame, rounds: int, least_seeds: int) -> DataFrame:
    """known(context, form, word, seed, trust) -> context, form, confidence, seeds, kind of the patterns with least_seeds
    seeds or more, after rounds of scoring."""
    scored = known.withColumn("score", F.col("trust"))
    for left in reversed(range(rounds)):
        patterns = scored.groupBy("context", "form").agg(F.avg("score").alias("confidence"), F.count("seed").alias("seeds"), F.mode("seed", deterministic=True).alias("kind"))
        # a table of its own: Spark can then split the join where one pattern has very many instances
        patterns = written(patterns.where(F.col("seeds") >= least_seeds), "pii-patterns")
        if left:
            doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
            lift = scored.join(patterns.select("context", "form", "confidence"), ["context", "form"]).groupBy("word").agg((1 - doubt).alias("lift"))
            again = F.greatest("trust", F.coalesce("lift", F.lit(0.0)))
            scored = written(scored.drop("score").join(lift, "word", "left").select("context", "form", "word", "seed", "trust", again.alias("score")), "pii-scores")
    return patterns


def discovered(edges: DataFrame, rounds: int = 2, least_seeds: int = 3, sure: float = 0.8, most_steps: int = 20) -> DataFrame:
    """edges(key, start, end, word, before, seed: kind or null) -> key, start, end, kind of unseen identifiers.

    A word is a whole instance, a run with its blanks; seeds and spans are whole ones too.

    Scores of a round: a pattern's is the mean of its instances' scores; an instance's is 1 for a seed of the fixed
    patterns, else the larger of its trust and 1 minus the product of (1 - score) of its patterns of at least
    least_seeds distinct seeds. Kinds are voted by seeds. An instance that no base span overlaps is found by a pattern of
    at least least_seeds seeds with a score of sure or more in the last round; the surest pattern gives the kind, of
    equal ones the least. Instances need four digits, or an at sign. What a step finds is a seed of the next one, with
    its pattern's score as trust; scores only rise, so that no finding is taken back. Steps end when one finds nothing
    new; work that isn't settled after most_steps steps stops there, with what is found by then.
    """
    named = edges.select("*", F.explode(patterns_of(F.col("word"), F.col("before"))).alias("p")).select("key", "start", "end", "word", "seed", "p.*")
    rich = (F.length(F.regexp_replace("word", "[^0-9]", "")) >= 4) | F.contains("word", F.lit("@"))
    # a pattern-instance pair counts once however often it repeats, so copies of a document add no confidence
    graph = named.groupBy("context", "form", "word").agg(F.max("seed").alias("seed"))
    known = written(graph.select("*", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("trust")), "pii-graph")
    for _ in range(most_steps):
        patterns = _patterns(known, rounds, least_seeds)
        chosen = patterns.where(F.col("confidence") >= sure).select("context", "form", "kind", "confidence")
        best = known.where(F.col("seed").isNull() & rich).join(chosen, ["context", "form"]).groupBy("word").agg(F.min(F.struct((-F.col("confidence")).alias("doubt"), "kind")).alias("best"))
        new = written(best.select("word", F.col("best.kind").alias("new_seed"), (-F.col("best.doubt")).alias("new_trust")), "pii-new")
        if new.isEmpty():
            break
        trust = F.when(F.col("seed").isNotNull(), F.col("trust")).otherwise(F.coalesce("new_trust", "trust"))
        known = written(known.join(new, "word", "left").select("context", "form", "word", F.coalesce("seed", "new_seed").alias("seed"), trust.alias("trust")), "pii-graph")
    found = named.where(F.col("seed").isNull() & rich).join(chosen, ["context", "form"])
    return found.groupBy("key", "start", "end").agg(F.min(F.struct(-F.col("confidence"), "kind"))["kind"].alias("kind"))


def seeded(held: DataFrame) -> DataFrame:
    """held(key, base, words) -> key, start, end, word, before, seed of each instance.

    An instance that base spans overlap is a seed: of the kind of that before its start which reaches farthest, if
    into it, or else of the next one. Rows are swept by place, so that a text of many spans and words costs no pairs.
    """
    words = held.select("key", F.explode("words").alias("w")).select("key", "w.*", F.lit(None).cast("int").alias("kind"))
    spans = held.select("key", F.explode("base").alias("s")).select("key", "s.start", "s.end", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("before"), "s.kind")
    before = Window.partitionBy("key").orderBy("start", F.col("word").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("key").orderBy(F.desc("start"), F.col("word").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = lambda x: F.when(F.col("word").isNull(), F.struct(F.col(x).alias("at"), "kind"))
    swept = words.unionByName(spans).select("*", F.max(span("end")).over(before).alias("reach"), F.min(span("start")).over(behind).alias("next"))
    seed = F.when(F.col("reach.at") > F.col("start"), F.col("reach.kind")).when(F.col("next.at") < F.col("end"), F.col("next.kind"))
    return swept.where("word is not null").select("key", "start", "end", "word", "before", seed.alias("seed"))


def find_personal_data(docs: DataFrame, rounds: int = 2, least_seeds: int = 3, sure: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base (spans), added (spans), spans (both, by start and kind).

    Spans are start, kind (0 email, 1 ip, 2 card, 3 phone), end (exclusive) in code points, and base ones their
    match. Null or empty texts have none. Equal rows get equal spans. An empty table gives no rows; extra columns
    are ignored. Numbers beyond the limits of a kind are not base spans, and may be found by their context.
    """
    rows = documents_of(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    held = written(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), base_spans(F.col("text")).alias("base"), instances(F.col("text")).alias("words")), "pii-base")
    edges = seeded(held)
    added = discovered(edges, rounds, least_seeds, sure).groupBy("key").agg(F.collect_set(F.struct("start", F.col("kind").cast("int").alias("kind"), "end", F.lit("").alias("match"))).alias("added"))
    out = held.select("doc_id", "key", "base").join(added, "key", "left")
    extra = F.coalesce("added", F.expr(f"cast(array() as {SPAN})"))
    return out.select("doc_id", "base", extra.alias("added"), F.array_sort(F.concat("base", extra)).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def contract_columns(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of base spans and all spans as text."""
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))
