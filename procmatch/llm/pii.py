"""Personal data replaced by keyed surrogates of the same type and format, with DataFrame functions only.

One pattern finds e-mail addresses, card and telephone numbers, IPv4 addresses, IBANs, secrets, and names after a title; a text is the
stretches between finds, with surrogates put in. A surrogate depends on the key, the type and the entity without case and layout, so equal
entities get equal surrogates in all documents (coreference).

* Digits (cards, telephones) and IPv4 addresses go through a keyed Feistel permutation, so different entities can't meet. Layout,
  country code and a card's first digit and check digit's validity stay.
* E-mail addresses, IBANs and secrets keep their shape: letters become letters of the same case, digits digits, hex hex; a domain maps as a
  whole and keeps its top-level part.
* Names keep their title, which gives the gender; where it gives none, the titles of the same name's other mentions in the table do, if they agree. Names are built from syllables of the script, given names with an ending of
  the gender; words map one by one, so "Mr John Smith" and "Mr Smith" keep their common part. Not found are names in scripts
  without capitals, initials, names that begin small ("van Dyke") or are all capitals, and names two spaces after their title. Latin, Cyrillic and Greek have syllables of
  their own; other scripts with capital letters get Latin ones. Where a text names somebody in full, its further mentions of the full name without a
  title are replaced too; single words without a title are not.

The hashed surrogates are checked over the whole table, names as wholes: if two entities share one, or one equals another entity of the table, all but the smallest take
the next of a keyed series, until none meet. The series gets longer words as it goes on, so it ends however many entities there are. Such exceptions are joined to
their texts; usually there are few.

Null texts stay null; empty texts and texts without finds stay as they are; texts of any length are read whole; repeated rows get the same
result; extra columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import free_name, stored

#: Members of a series before its words get longer.
GROWS = 4
#: A salt's part above it: 1 female, 2 male, for names whose title doesn't say so but whose gender another mention's title gives.
GENDER = 1 << 20
KINDS = ("secret", "email", "iban", "ip", "phone", "card", "name")

# Titles by gender, endings of given names by gender and script, syllables by script.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Sra", "Señora", "Señorita", "Госпожа", "госпожа", "Κυρία", "κυρία"]
MALE_TITLES = ["Mr", "Mister", "Monsieur", "Herr", "Herrn", "Sr", "Señor", "Господин", "господин", "Κύριος", "κύριος"]
OTHER_TITLES = ["Dr", "Doctor", "Prof", "Professor", "Доктор", "доктор"]
ENDINGS = {
    ("female", "latin"): ["a", "ia", "ina", "ella"],
    ("male", "latin"): ["o", "us", "an", "or"],
    ("female", "cyrillic"): ["а", "ия", "ина", "елла"],
    ("male", "cyrillic"): ["ан", "ор", "ий", "ин"],
    ("female", "greek"): ["α", "ια", "ινα", "ελλα"],
    ("male", "greek"): ["ος", "ης", "ων", "ας"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "bran", "stel"],
    "cyrillic": ["ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "жо", "бран", "стел"],
    "greek": ["βα", "δε", "φι", "γο", "κυ", "λα", "με", "νι", "πο", "ρυ", "σα", "τε", "θι", "ξο", "βραν", "στελ"],
}

_TITLE = "|".join([*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES])
_NAME_WORD = r"\p{Lu}[\p{L}'’\-]{1,30}+"
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|sk-[A-Za-z0-9\-_]{16,128}|(?i:password|passwd|pwd|secret|token|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{6,256}[\"']?)",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}|[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.?[ \u00A0]{_NAME_WORD}(?: {_NAME_WORD}){{0,2}}",
}
# No find begins inside a word, so within words one look back is all that is done.
_ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS[k] for k in KINDS) + ")"
#: Every find holds one of these characters or words; most texts that hold none are not searched.
_SIGNS, _WORDS = "[0-9@=:_]", ["AKIA", "sk-", "Mr", "Ms", "Miss", "Mister", "Mme", "Mada", "Mlle", "Monsi", "Herr", "Frau", "Sr", "Seño", "оспо", "Dr", "Doctor", "Prof", "октор", "υρί", "ύριος"]
_FULL_NAME = rf"^(?:{_TITLE})\.?[ \u00A0]{_NAME_WORD} "
#: Stands around finds; texts that hold it themselves are cut another way.
_MARK = "\u0001"


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]  # a function of two would get the index too


def _hash(key: str, kind: str, what: Column, salt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), salt.cast("string"), what).cast("binary"), 512)


def _shaped(text: Column, h: Column, hexadecimal: Column | None = None) -> Column:
    """The text with each letter and digit replaced by one of its sort, drawn from the hash h (128 hex digits)."""

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        b = F.conv(F.substring(h, F.pmod(i * 2 - 2, F.lit(127)) + 1, F.lit(2)), 16, 10).cast("int")
        drawn = lambda first, n: F.char(F.lit(first) + F.pmod(b, F.lit(n)))
        plain = F.when((c >= "a") & (c <= "z"), drawn(97, 26)).when((c >= "A") & (c <= "Z"), drawn(65, 26)).when((c >= "0") & (c <= "9"), drawn(48, 10)).when(c.rlike(r"[\p{L}\p{N}]"), drawn(97, 26)).otherwise(c)
        return plain if hexadecimal is None else F.when(hexadecimal & c.rlike("[0-9a-f]"), F.substring(h, F.pmod(i - 1, F.lit(128)) + 1, F.lit(1))).otherwise(plain)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), ""))


def _feistel(left: Column, right: Column, key: str, kind: str, size_left: Column, size_right: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs below the two sizes; four rounds."""
    start = F.struct(left.alias("l"), right.alias("r"), size_left.alias("m"), size_right.alias("n"))

    def step(s: Column, i: Column) -> Column:
        drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), s["m"].cast("string"), s["n"].cast("string"), s["r"].cast("string")).cast("binary"), 256), 1, 14), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + drawn, s["m"]).alias("r"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, step)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _permuted(digits: Column, key: str, kind: str) -> Column:
    """Digits (1 to 36) through a permutation of the digit strings of their number."""

    def halves(d: Column) -> Column:
        a = F.floor(F.length(d) / 2).cast("int")
        b = F.length(d) - a
        whole = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))
        done = _feistel(whole(F.substring(d, F.lit(1), a)), whole(F.substring(d, a + 1, b)), key, kind, _ten_to(a), _ten_to(b))
        return _let(done, lambda s: F.concat(F.when(a > 0, F.lpad(s["l"].cast("string"), a, "0")).otherwise(""), F.lpad(s["r"].cast("string"), b, "0")))

    return _let(digits, halves)


def _laid_out(layout: Column, digits: Column) -> Column:
    """The layout's digits replaced in turn by ``digits``."""
    both = F.struct(F.split(layout, "[0-9]", -1).alias("gaps"), digits.alias("new"))
    return _let(both, lambda s: F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(s["new"])), lambda i: F.concat(s["gaps"][i - 1], F.substring(s["new"], i, F.lit(1)))), ""), F.element_at(s["gaps"], -1)))


def _luhn(digits: Column) -> Column:
    """The sum modulo 10 of all digits' Luhn values, the last one not doubled."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b), F.lit(10))


def _card(e: Column, key: str) -> Column:
    """First digit and layout stay, and the Luhn sum too, so valid numbers stay valid."""

    def new(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), _permuted(F.substring(d, F.lit(2), n - 2), key, "card"))
        return _let(F.concat(body, F.lit("0")), lambda open_: F.concat(F.substring(open_, F.lit(1), n - 1), F.pmod(_luhn(d) - _luhn(open_), F.lit(10)).cast("string")))

    return _laid_out(e, _let(F.regexp_replace(e, "[^0-9]", ""), new))


def _phone(e: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(e, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    rest = F.substring(e, F.length(code) + 1, F.length(e))
    return F.concat(code, _laid_out(rest, _permuted(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))


def _ip(e: Column, key: str) -> Column:
    part = lambda s, k: F.element_at(s, k).cast("long")
    done = _let(F.split(e, r"\."), lambda s: _feistel(part(s, 1) * 256 + part(s, 2), part(s, 3) * 256 + part(s, 4), key, "ip", F.lit(65536).cast("long"), F.lit(65536).cast("long")))
    return _let(done, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def _email(e: Column, key: str, salt: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.substring_index(domain, ".", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    more = lambda h: F.translate(F.substring(h, F.lit(100), F.when(salt >= GROWS, salt - (GROWS - 1)).otherwise(0)), "0123456789", "ghijklmnop")
    return F.concat(_let(_hash(key, "email", F.lower(e), salt), lambda h: F.concat(_shaped(local, h), more(h))), F.lit("@"), _let(_hash(key, "domain", F.lower(domain), F.lit(0)), lambda h: _shaped(name, h)), F.lit("."), top)


def _secret(e: Column, key: str, salt: Column) -> Column:
    lead = F.regexp_extract(e, r"^(?:AKIA|gh[pousr]_|sk-|(?i:[a-z_\-]+)\s*[=:]\s*[\"']?)", 0)
    value = F.substring(e, F.length(lead) + 1, F.length(e))
    return F.concat(lead, _let(_hash(key, "secret", F.regexp_replace(value, "[\"']", ""), salt), lambda h: _shaped(value, h, value.rlike("^[0-9a-f]+[\"']?$"))))


def _iban(e: Column, key: str, salt: Column) -> Column:
    plain = F.regexp_replace(e, " ", "")
    return F.concat(F.substring(e, 1, 2), _let(_hash(key, "iban", plain, salt), lambda h: _shaped(F.substring(e, F.lit(3), F.length(e)), h)))


def _draw(values: list[str], h: Column, at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.conv(F.substring(h, at, F.lit(4)), 16, 10).cast("int") % len(values)]


def _syllables(h: Column, script: str, n: Column) -> Column:
    """``n`` syllables of the script, 25 at most, one for every four digits of the hash from the fifth on."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(25))), lambda i: _draw(SYLLABLES[script], h, 4 * i + 1)), "")


def _title(e: Column) -> tuple[Column, Column]:
    """A name's title as it stands, and alone."""
    title = F.regexp_extract(e, rf"^(?:{_TITLE})\.?[ \u00A0]", 0)
    return title, F.regexp_replace(title, r"[. \u00A0]", "")


def _name(e: Column, key: str, salt: Column) -> Column:
    (title, bare), given, salt = _title(e), F.floor(salt / GENDER), salt % GENDER
    female, male = bare.isin(FEMALE_TITLES) | (given == 1), bare.isin(MALE_TITLES) | (given == 2)

    def words(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            last = i == F.size(ws) - 1

            def drawn(h: Column) -> Column:
                def of(script: str) -> Column:
                    ending = lambda gender: _draw(ENDINGS[gender, script], h, F.lit(1))
                    given = F.concat(_syllables(h, script, F.lit(3)), F.when(female, ending("female")).when(male, ending("male")).otherwise(""))
                    return F.initcap(F.when(last, _syllables(h, script, 4 + F.floor(salt / GROWS).cast("int"))).otherwise(given))

                return F.when(w.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(w.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))

            return _let(_hash(key, "name", F.lower(w), F.when(last, salt).otherwise(F.lit(0))), drawn)

        return F.array_join(F.transform(ws, one), " ")

    return F.concat(title, _let(F.split(F.substring(e, F.length(title) + 1, F.length(e)), " "), words))


def kind_of(e: Column) -> Column:
    full = lambda k: e.rlike(f"^(?:{PATTERNS[k]})$")
    out = F.when(full(KINDS[0]), KINDS[0])
    for k in KINDS[1:]:
        out = out.when(full(k), k)
    return out


def canonical(e: Column, kind: Column | None = None) -> Column:
    """An entity without the layout that its surrogate leaves alone: what two finds have in common if they are the same."""
    if kind is None:
        return _let(kind_of(e), lambda k: canonical(e, k))
    name = F.lower(F.regexp_replace(e, rf"^(?:{_TITLE})\.?[ \u00A0]", ""))
    value = F.regexp_replace(e, r"^(?:(?i:[a-z_\-]+)\s*[=:]\s*)|[\"']", "")
    return F.when(kind == "email", F.lower(e)).when(kind == "name", name).when(kind == "secret", value).otherwise(F.regexp_replace(e, r"[ ().\-]", ""))


def surrogate(e: Column, key: str, salt: Column) -> Column:
    """What replaces the entity; ``salt`` picks a member of the series of the hashed kinds."""
    return (
        F.when(e.rlike(f"^(?:{PATTERNS['secret']})$"), _secret(e, key, salt))
        .when(F.contains(e, F.lit("@")), _email(e, key, salt))
        .when(e.rlike(f"^(?:{PATTERNS['iban']})$"), _iban(e, key, salt))
        .when(e.rlike(f"^(?:{PATTERNS['ip']})$"), _ip(e, key))
        .when(e.rlike(f"^(?:{PATTERNS['phone']})$"), _phone(e, key))
        .when(e.rlike(r"^[0-9]"), _card(e, key))
        .otherwise(_name(e, key, salt))
    )


def _worth_searching(text: Column) -> Column:
    out = text.rlike(_SIGNS)
    for w in _WORDS:
        out = out | F.contains(text, F.lit(w))
    return out


def parts(text: Column) -> Column:
    """A text in turn as what stands between finds and finds: an array of odd length, of which every second item is a find."""
    marked = F.split(F.regexp_replace(text, f"({_ANY})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    apart = F.struct(F.split(text, _ANY, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)).alias("found"))
    paired = _let(apart, lambda s: F.concat(F.flatten(F.transform(s["found"], lambda e, i: F.array(s["gaps"][i], e))), F.slice(s["gaps"], -1, 1)))
    return F.when(~_worth_searching(text), F.array(text)).when(F.contains(text, F.lit(_MARK)), paired).otherwise(marked)


def finds(text: Column) -> Column:
    """All finds of a text, in order."""
    return F.filter(parts(text), lambda p, i: i % 2 == 1)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each find ``(entity)``."""
    text = F.col(text_col)
    return docs.where(_worth_searching(text)).select(F.explode(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).alias("entity"))


def _with_gender(entities: DataFrame) -> DataFrame:
    """``entities`` with a first ``salt``: 0, but for names whose title gives no gender the one that all other mentions' titles give."""
    bare = _title(F.col("entity"))[1]
    gender = F.when(bare.isin(FEMALE_TITLES), 1).when(bare.isin(MALE_TITLES), 2)
    named = F.when(F.col("kind") == "name", gender)
    known = entities.select("canon", named.alias("g")).where("g is not null").groupBy("canon").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low = high").select(F.col("canon").alias("same"), "low")
    both = entities.join(known, (F.col("canon") == F.col("same")) & (F.col("kind") == "name") & gender.isNull(), "left")
    return both.select("entity", "kind", "canon", (F.coalesce("low", F.lit(0)) * GENDER).cast("int").alias("salt"))


def collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``(entity, salt)`` for the entities of hashed kinds whose first surrogate is another one's too, or an entity of the table, and for names whose gender another mention gives."""
    kind = kind_of(F.col("entity"))
    all_ = stored(entities(docs, text_col).distinct().withColumns({"kind": kind, "canon": canonical(F.col("entity"))}), "entities")
    hashed = all_.where(F.col("kind").isin("email", "secret", "iban", "name"))
    now = stored(_with_gender(hashed).withColumn("new", _let(surrogate(F.col("entity"), key, F.col("salt")), canonical)), "surrogates")
    while True:
        meets = now.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count_distinct("canon").alias("n")).where("n > 1")
        real = now.select("kind", "new").distinct().join(all_.select("kind", F.col("canon").alias("new")).distinct(), ["kind", "new"], "left_semi").select("kind", "new", F.lit("").alias("first"), F.lit(2).cast("long").alias("n"))
        bad = stored(meets.unionByName(real).groupBy("kind", "new").agg(F.min("first").alias("first")), "meets")
        if not bad.take(1):
            return stored(now.where("salt > 0").select("entity", "salt"), "salted")
        marked = now.join(bad, ["kind", "new"], "left")
        again = F.col("first").isNotNull() & (F.col("canon") != F.col("first"))
        salt = F.when(again, F.col("salt") + 1).otherwise(F.col("salt"))
        # Another name for the next salt: inside a lambda, ``salt`` would be taken for this new column.
        now = stored(marked.select("entity", "kind", "canon", salt.alias("next"), F.when(again, _let(surrogate(F.col("entity"), key, F.col("salt") + 1), canonical)).otherwise(F.col("new")).alias("new")).withColumnRenamed("next", "salt"), "surrogates")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text; ``count_col``: also the number of finds."""
    salted = collisions(docs, key, text_col)
    text = F.col(text_col)
    mark, of, salts_of, result = (free_name(n, docs.columns) for n in ("text_hash", "text_of", "salts_of", "result"))
    if not salted.take(1):
        salts, base = None, docs
    else:
        # Texts that hold an exception get its salt by the text's own hash.
        name = F.sha2(text.cast("binary"), 256)
        per_text = docs.select(name.alias(mark), F.explode(F.array_distinct(finds(text))).alias("entity")).distinct().join(salted, "entity").groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct("entity", "salt"))).alias(salts_of))
        base = docs.withColumn(of, name).join(per_text, F.col(of) == F.col(mark), "left")
        salts = F.col(salts_of)

    def rebuilt(s: Column) -> Column:
        salt = lambda e: F.lit(0) if salts is None else F.coalesce(s["salts"][e], F.lit(0))
        changed = F.transform(s["parts"], lambda p, i: F.when(i % 2 == 1, surrogate(p, key, salt(p))).otherwise(p))
        # Full names after a title, with what replaces them; the longest first, so that no name goes in part.
        full = F.filter(F.array_distinct(F.filter(s["parts"], lambda p, i: i % 2 == 1)), lambda e: e.rlike(_FULL_NAME))
        bare = lambda e: F.regexp_replace(e, rf"^(?:{_TITLE})\.?[ \u00A0]", "")
        pairs = F.transform(full, lambda e: F.struct((-F.length(bare(e))).alias("n"), bare(e).alias("old"), bare(surrogate(e, key, salt(e))).alias("new")))
        again = lambda p: F.aggregate(F.array_sort(pairs), p, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'’\-])\Q"), x["old"], F.lit(r"\E(?!-?\p{L})")), x["new"]))
        once = F.array_join(changed, "")
        twice = _let(F.struct(changed.alias("c")), lambda x: F.array_join(F.transform(x["c"], lambda p, i: F.when(i % 2 == 1, p).otherwise(again(p))), ""))
        return F.when(F.exists(s["parts"], lambda p: p.rlike(_FULL_NAME) & (F.length(p) < 200)), twice).otherwise(once)

    fields = [parts(text).alias("parts"), *([] if salts is None else [salts.alias("salts")])]
    n = lambda s: F.floor(F.size(s["parts"]) / 2).cast("int")
    done = _let(F.struct(*fields), lambda s: F.struct(F.when(n(s) > 0, rebuilt(s)).otherwise(s["parts"][0]).alias("text"), n(s).alias("n")))
    out = base.withColumn(result, F.when(text.isNotNull(), done))
    columns = [F.col(result)["text"].alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, *([F.coalesce(F.col(result)["n"], F.lit(0)).alias(count_col)] if count_col else []))
