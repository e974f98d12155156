"""Requirements of a procurement text as columns: mentions, attributes, clauses, product."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.functions.text import blank, keywords, once

# What the extraction looks for.
MENTION = r"(?i)\bIS\s*:?\s*\d+(?:\s*\([^)]+\))?(?:\s*:\s*\d{4})?\b"
SAFETY_TERMS = ["safety", "protection", "surge", "fire", "flame", "grounding", "earthing", "insulation", "dielectric", "overload", "ip66", "ip65"]
INSTALLATION_TERMS = ["outdoor", "indoor", "municipal", "underground", "ambient", "temperature", "humidity", "installation", "mounting", "pole", "submersible", "borewell", "marine", "highway"]
PRODUCTS = [
    ("Transformers", ["distribution transformer", "power transformer", "oil immersed transformer", "transformer", "substation"]),
    ("Lighting & Luminaires", ["street light", "led luminaire", "led street light", "luminaire", "led lamp", "led bulb", "fixture"]),
    ("Cables & Wiring", ["xlpe cable", "armored cable", "power cable", "pvc cable", "building wire", "electrical cable", "cable"]),
    ("Cement & Building Materials", ["portland slag cement", "portland pozzolana cement", "cement", "concrete", "mortar"]),
    ("Pumps & Turbines", ["submersible pump", "water pump", "pump set", "borewell pump", "centrifugal pump"]),
    ("Solar Energy", ["solar panel", "pv module", "photovoltaic", "crystalline silicon"]),
    ("Pipes & Fittings", ["hdpe pipe", "polyethylene pipe", "water pipe", "pipeline"]),
    ("Fire Safety", ["fire extinguisher", "portable extinguisher", "co2 extinguisher"]),
    ("Structural Steel", ["structural steel", "steel beam", "hot rolled steel"]),
]


@dataclass(frozen=True)
class Measure:
    """An attribute and the pattern of its value and unit; ``unit`` None: the unit as found."""

    attribute: str
    pattern: str
    unit: str | None = None


# Fixed values, in the order in which they claim a piece of text.
MEASURES = [
    Measure("capacity", r"\b(\d+(?:\.\d+)?)\s*(W|kW|MW|kVA|MVA|VA|HP)\b"),
    Measure("voltage", r"(?i)\b(\d+(?:\.\d+)?)\s*(V|kV|mV)\b"),
    Measure("current", r"\b(\d+(?:\.\d+)?)\s*(A|mA|kA)\b"),
    Measure("frequency", r"(?i)\b(\d+(?:\.\d+)?)\s*(Hz|kHz)\b"),
    Measure("efficiency", r"(?i)\b(\d+(?:\.\d+)?)\s*(%|percent|pct)", "%"),
    Measure("dimension", r"(?i)\b(\d+(?:\.\d+)?)\s*(mm|cm|m|inch)\b"),
    Measure("surge_protection", r"(?i)\b(\d+(?:\.\d+)?)\s*(kV\s*surge|surge)\b", "kV"),
]
INGRESS = r"(?i)\b(IP\s*\d{2})\b"
ATTRIBUTE = "array<struct<attribute: string, value: string, unit: string, source_text: string>>"


def first_of_each(items: Column, key) -> Column:
    """Items of an array without those whose key an earlier one has; keys aren't null."""
    return once(items, lambda z: once(F.transform(z, key), lambda keys: F.filter(z, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def is_mentions(text: Column) -> Column:
    """Designations mentioned, in order, each once whatever its case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), lambda m: F.regexp_replace(F.trim(m), r"\s+", " "))
    return first_of_each(found, F.upper)


def _measured(text: Column, m: Measure) -> Column:
    """Finds of a pattern; the text is searched once, value and unit are cut from what was found."""
    number = r"^\d+(?:\.\d+)?"
    # The same pattern; that a digit follows is looked at before the word's bound, which is dearer.
    pattern = m.pattern.replace(r"\b(\d", r"(?=\d)\b(\d", 1)

    def one(found: Column) -> Column:
        unit = F.regexp_replace(found, number + r"\s*", "") if m.unit is None else F.lit(m.unit)
        return F.struct(F.lit(m.attribute).alias("attribute"), F.regexp_extract(found, number, 0).alias("value"), unit.alias("unit"), F.trim(found).alias("source_text"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)


def technical_attributes(text: Column) -> Column:
    """Values with units, by pattern and then by place; a piece of text counts once, for the first pattern."""
    ingress = F.transform(F.regexp_extract_all(text, F.lit(INGRESS), F.lit(1)), lambda m: F.struct(F.lit("ingress_protection").alias("attribute"), F.upper(F.replace(m, F.lit(" "), F.lit(""))).alias("value"), F.lit(None).cast("string").alias("unit"), F.trim(m).alias("source_text")))
    return first_of_each(F.concat(ingress.cast(ATTRIBUTE), *[_measured(text, m).cast(ATTRIBUTE) for m in MEASURES]), lambda x: x["source_text"])


def clauses(text: Column, terms: list[str], most: int = 5, shorter_than: int = 300) -> Column:
    """The first different lines that hold one of the terms."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    held = lambda x: once(F.lower(x), lambda low: reduce(or_, [F.contains(low, F.lit(t)) for t in terms]))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: (x != "") & (F.length(x) < shorter_than) & held(x))), 1, most)


def safety_clauses(text: Column) -> Column:
    return clauses(text, SAFETY_TERMS)


def installation_clauses(text: Column) -> Column:
    return clauses(text, INSTALLATION_TERMS)


def product(text: Column) -> Column:
    """struct(name, category) by the first known product term; else the first line as a name, if it is short and no page heading."""
    known = lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(k.title()).alias("name"), F.lit(c).alias("category"))) for c, ks in PRODUCTS for k in ks])
    line = F.get(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("---"))), 0)
    other = F.struct(once(F.trim(line), lambda x: F.when(F.length(x) < 100, x)).alias("name"), F.lit(None).cast("string").alias("category"))
    return F.coalesce(once(F.lower(text), known), other)


def extract_requirements(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a struct ``requirements``, computed row by row without a shuffle."""
    t = blank(F.col(text))
    full = F.regexp_replace(t, r"\s", "") != ""
    none = F.array().cast("array<string>")
    own, found = (next(n for n in (f"{name}{'_' * i}" for i in range(99)) if n not in docs.columns) for name in ("extracted", "words"))
    rows = docs.withColumn(found, keywords(t)).select(
        "*",
        F.struct(
            F.when(full, product(t)).otherwise(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("category"))).alias("product"),
            technical_attributes(t).alias("technical_requirements"), is_mentions(t).alias("standards_mentions"), safety_clauses(t).alias("safety_requirements"),
            installation_clauses(t).alias("installation_requirements"), F.coalesce(found, none).alias("keywords"), t.alias("raw_text"),
        ).alias(own),
    )
    return rows.select(*[F.col(c) for c in docs.columns if c != "requirements"], F.col(own).alias("requirements"))
