"""Query strings for extracted requirements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procmatch.functions.text import blank, once, words_of

# Words of the surroundings, in this order.
CONTEXT_WORDS = ["outdoor", "indoor", "municipal", "underground", "earthing", "grounding", "insulation", "surge", "flame", "submersible", "marine"]
NO_QUERY, NO_DISPLAY = "standard technical specification", "Procurement Requirements"


def _filled(text: Column) -> Column:
    """Null instead of an empty string, which concat_ws would give a blank."""
    return once(text, lambda t: F.when(t != "", t))


def context_terms(r: Column) -> Column:
    clauses = F.concat(r["safety_requirements"], r["installation_requirements"])
    return F.array_distinct(F.flatten(F.transform(clauses, lambda c: once(F.lower(c), lambda low: F.filter(words_of(CONTEXT_WORDS), lambda w: F.contains(low, w))))))


def keyword_query(r: Column) -> Column:
    """For lexical search: everything exact that was found."""
    name, category = (F.trim(blank(r["product"][k])) for k in ("name", "category"))
    parts = F.flatten(F.transform(F.filter(r["technical_requirements"], lambda a: F.trim(a["value"]) != ""), lambda a: F.when(blank(a["unit"]) == "", F.array(F.trim(a["value"]))).otherwise(F.array(F.trim(a["value"]), F.trim(a["unit"]), F.concat(F.trim(a["value"]), F.trim(a["unit"]))))))
    joined = F.concat_ws(" ", _filled(name), F.when((category != "") & ~F.contains(F.lower(name), F.lower(category)), category), *[_filled(F.array_join(x, " ")) for x in (r["standards_mentions"], parts, r["keywords"], context_terms(r))])
    return F.coalesce(_filled(F.trim(joined)), _filled(F.substring(r["raw_text"], 1, 200)), F.lit(NO_QUERY))


def semantic_query(r: Column) -> Column:
    """For vector search: sentences."""
    name, category = (F.trim(blank(r["product"][k])) for k in ("name", "category"))
    about = F.when((name != "") & (category != ""), F.concat(name, F.lit(" in category "), category)).otherwise(_filled(F.concat(name, category)))
    attributes = F.transform(F.filter(r["technical_requirements"], lambda a: F.trim(a["value"]) != ""), lambda a: F.concat_ws(" ", F.concat(a["attribute"], F.lit(": "), F.trim(a["value"])), _filled(F.trim(blank(a["unit"])))))
    said = lambda lead, items: once(items, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(lead), F.array_join(x, ", "), F.lit("."))))
    text = F.concat_ws(
        " ", F.concat(F.lit("Technical specification for "), about, F.lit(".")), said("Key technical parameters: ", attributes),
        said("Operating environment and safety requirements: ", context_terms(r)), said("Referenced Indian Standards: ", r["standards_mentions"]), said("Keywords: ", F.slice(r["keywords"], 1, 5)),
    )
    return F.coalesce(_filled(text), keyword_query(r))


def display_query(r: Column) -> Column:
    head = F.coalesce(_filled(F.trim(blank(r["product"]["name"]))), _filled(F.trim(blank(r["product"]["category"]))))
    top = F.transform(F.slice(r["technical_requirements"], 1, 3), lambda a: F.concat(a["value"], blank(a["unit"])))
    text = F.concat_ws(" ", head, F.when(F.size(top) > 0, F.concat(F.lit("("), F.array_join(top, ", "), F.lit(")"))))
    return F.coalesce(_filled(text), F.lit(NO_DISPLAY))
