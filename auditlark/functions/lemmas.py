"""Base forms of English words: exceptions first, then the first rule of endings that fits. A dictionary can go before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlark.functions import text as T

#: Irregular forms by their base.
IRREGULAR = {
    "be": "am is are was were been being", "have": "has had having", "do": "does did done doing", "go": "goes went gone", "make": "made making", "take": "took taken taking", "give": "gave given giving", "know": "knew known", "see": "saw seen",
    "find": "found", "write": "wrote written writing", "choose": "chose chosen choosing", "run": "ran running", "begin": "began begun", "build": "built", "hold": "held", "keep": "kept", "mean": "meant", "lead": "led", "send": "sent", "show": "shown",
    "man": "men", "woman": "women", "child": "children", "foot": "feet", "mouse": "mice", "index": "indices", "matrix": "matrices", "vertex": "vertices", "datum": "data", "criterion": "criteria", "phenomenon": "phenomena",
    "analysis": "analyses", "basis": "bases", "hypothesis": "hypotheses", "half": "halves", "leaf": "leaves", "life": "lives", "good": "better best", "bad": "worse worst",
}
#: Words that look inflected and aren't.
BASE = ["this", "thus", "news", "series", "species", "always", "physics", "mathematics", "ethics", "during", "string", "thing", "nothing", "something", "spring", "king", "ring", "bring", "sing", "need", "feed", "seed", "speed", "bed", "red", "indeed", "embed", "lens", "bus", "gas", "yes"]
#: Endings: what stays is group 1. A stem needs two letters with a vowel.
RULES = [
    (r"^([a-z]{2,})ies$", "y"), (r"^([a-z]{2,}(?:s|x|z|ch|sh))es$", ""), (r"^([a-z]+(?:ss|us|is|ous))$", ""), (r"^([a-z]{2,}[a-z])s$", ""),
    (r"^([a-z]{2,})ied$", "y"), *((rf"^([a-z]*[aeiouy][a-z]*{c}){c}(?:ed|ing)$", "") for c in "bdgmnprt"), (r"^([a-z]*[aeiouy][a-z]*(?:at|iz|is|bl|iv|uc|ag|ar|ur|ut|os|us|ov|nc|rc|dg|rg|rs|ns))(?:ed|ing)$", "e"),
    (r"^([a-z]*[aeiouy][a-z]*[a-z])(?:ed|ing)$", ""),
]


def lemma(word: Column | str, dictionary: dict[str, str] | None = None) -> Column:
    """The base form of a word in lower case; other signs than a-z leave it as it is. dictionary: forms that go before
    everything else, a small map that travels with the plan."""
    w = T.col(word)
    known = {form: base for base, forms in IRREGULAR.items() for form in forms.split()} | {b: b for b in BASE} | (dictionary or {})
    table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    out = F.when(w.isin(sorted(known)), F.element_at(table, w))
    for pattern, ending in RULES:
        out = out.when(w.rlike(pattern), F.concat(F.regexp_extract(w, pattern, 1), F.lit(ending)))
    return out.otherwise(w)
