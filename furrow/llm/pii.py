"""Personal data: keyed, type-consistent surrogates.

Entities are found by patterns (e-mail in any script, phone, card, IPv4, national
numbers, IBAN, access keys, bearer and repository tokens, secrets of any length
after a label in any case, and names after a title of address). Not found are
IPv6 addresses, key blocks of several lines, and what stands without a sign of
its kind; four numbers with dots between them are taken for an address.
Each distinct entity - by its normal form, so that ``+1 (555) 010-9999`` and
``+1 555 0109999`` are one - gets a surrogate from a keyed hash:

* letters become letters of the same case and script, digits digits; separators,
  length, top-level domain, country code, card prefix and Luhn validity stay;
* names become names of the same script, given names of the same gender (that
  of the title; where it tells none, the gender that the name has elsewhere in
  the corpus, female before male if it has both); given and family names are
  mapped apart, so ``Mrs Anna Weber`` and ``Frau Weber`` still share a family name. Any number
  of name words, initials and particles may follow the titles: the last full
  word is the family name, particles stay, an initial becomes another letter
  (letters are too few to be kept apart). The names so found are also replaced
  where they stand in the same text without a title. Names in scripts without
  capitals, and names without a title anywhere in their text, are not found.

Collision checks: a surrogate must not equal another entity's surrogate or any
real entity of its type (names of all kinds are one type); those that do are
hashed again with the next attempt until the whole entity table passes. Where a format has no free value left,
the entities concerned get surrogates with more characters than their format.
A run of punctuation after a label (``password: ******``) is not a secret.

Main path: built-in expressions only. Occurrences are one row each; entities
are grouped with partial aggregation, so one that a third of all texts mention
is one row per task. Texts without an entity never leave their scan; the others
are joined with their replacements by a hash of id and text.

Defined results: a null text stays null; an empty text stays empty; repeated
rows get equal results; all columns are kept, whatever their names; an empty
table gives an empty result; matches do not overlap, the leftmost wins.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import count
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import documents, staged

MAX_ATTEMPTS = 24
# Titles of address by gender, and syllables of made-up names.
MALE = ["Mr", "Mister", "Herr", "Herrn", "Señor", "Monsieur", "господин", "Господин", "Signor", "Sir"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "госпожа", "Госпожа", "Signora", "Dame", "Lady"]
NEUTRAL = ["Dr", "Prof", "Doctor", "Doktor", "Docteur", "Professor", "Professeur", "доктор", "Доктор", "профессор", "Профессор"]
PARTICLES = ["von", "van", "vom", "zu", "zur", "zum", "der", "den", "de", "del", "della", "des", "di", "da", "do", "dos", "das", "du", "la", "le", "las", "los",
             "y", "e", "af", "av", "ten", "ter", "bin", "ibn", "bint", "al", "el", "фон", "де"]
LATIN = ["an", "bel", "cor", "da", "el", "fin", "gar", "hal", "is", "jo", "kal", "lem", "mar", "nor", "ol", "per"]
GREEK = ["αν", "βελ", "γορ", "δα", "ελ", "φιν", "γαρ", "χαλ", "ισ", "κο", "καλ", "λεμ", "μαρ", "νορ", "ολ", "περ"]
CYRILLIC = ["ан", "бел", "вор", "да", "ель", "жин", "гар", "зал", "ис", "ко", "кал", "лем", "мар", "нор", "ол", "пер"]

def _small(script: str) -> list[str]:
    """16 plain small letters of a cased script, for names made of them."""
    found = [chr(c) for c in range(0x370, 0x1E944) if unicodedata.category(chr(c)) == "Ll"
             and re.fullmatch(rf"{script.upper()} SMALL LETTER \w+", unicodedata.name(chr(c), ""))]
    return found[:16]


def _pool(first: int, last: int) -> str:
    """The letters between two code points that have no case."""
    return "".join(chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c)) == "Lo")[:64]


# Code points between which a script without case has its common letters.
UNCASED = {"Han": (0x4E00, 0x4E3F), "Hiragana": (0x3041, 0x3096), "Katakana": (0x30A1, 0x30FA), "Hangul": (0xAC00, 0xAC3F),
           "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x621, 0x64A), "Devanagari": (0x905, 0x939), "Thai": (0xE01, 0xE2E)}

#: Syllables by script; given names end by gender and family names alike.
SYLLABLES = {"latin": LATIN, "cyrillic": CYRILLIC, "greek": GREEK} | {
    s: _small(s) for s in ("armenian", "coptic", "glagolitic", "cherokee", "adlam", "osage", "deseret")}
ENDINGS = {"latin": ("a", "o", "i", "ner"), "cyrillic": ("а", "й", "е", "ко"), "greek": ("α", "ος", "ι", "ης")}

_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.?"
_END = r"(?![\p{L}\p{M}\p{N}])"
# A name word ends before "'s"; an initial is one capital, with or without a dot.
_NAME = rf"(?:\p{{Lu}}['’])?\p{{Lu}}\p{{M}}*\p{{Ll}}[\p{{L}}\p{{M}}]*+(?:['’-](?!s{_END})\p{{L}}[\p{{L}}\p{{M}}]*+)*+{_END}"
_INITIAL = rf"\p{{Lu}}(?:\.|{_END})"
_WORD = rf"(?:{_NAME}|{_INITIAL})"
_GAP = rf"(?: |(?<=\p{{Lu}}\.))(?:(?:{'|'.join(PARTICLES)}) ){{0,4}}(?:[ae]l-|[dl]['’])?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SIGN = r"\p{L}\p{M}\p{N}"
EMAIL = rf"(?<![{_SIGN}._%+-])[{_SIGN}._%+-]{{1,255}}+@(?:[{_SIGN}-]{{1,63}}\.){{1,8}}[\p{{L}}\p{{M}}]{{2,24}}(?![{_SIGN}-])"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
CARD = r"(?<![\d-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\d.])[3-6]\d{14,15}(?!\d)"
NATIONAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (r"(?<![\w+(.-])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)"
         r"|(?<![\w+(.-])(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
REPOSITORY = r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{16,}+"
BEARER = r"(?<=(?i:\bbearer) )(?=[A-Za-z._~+/-]*+\d)[A-Za-z0-9._~+/-]{12,}+=*+"
LABELS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key"]
SECRET = rf"(?<=[=: \"'])(?<=(?i:{'|'.join(LABELS)}) ?[=:] ?[\"']?)(?=[+/_!#$%^*.-]*+[A-Za-z0-9])[A-Za-z0-9+/_!#$%^*.-]{{6,}}+"
_LEAD = rf"(?<![\p{{L}}\p{{N}}]){_TITLE}(?: {_TITLE}(?= ))*+"
PERSON = rf"{_LEAD}(?:{_GAP}{_WORD})++"
ANY = "|".join([EMAIL, IP, CARD, NATIONAL, PHONE, IBAN, ACCESS, REPOSITORY, BEARER, SECRET, PERSON])

# What every match needs, cheap to look for: most texts hold nothing of it.
_SIGNS = sorted({t[:4] for t in MALE + FEMALE + NEUTRAL} | {f"gh{c}_" for c in "pousr"})

PART = "struct<kind:string,norm:string,raw:string,before:string>"


def has_entity(text: Column) -> Column:
    """True for texts with a match; the signs are tried before the patterns."""
    signs = text.rlike("[0-9@]")
    for s in _SIGNS:
        signs = signs | text.contains(s)
    signs = signs | F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [low.contains(s) for s in LABELS]))
    return F.coalesce(signs & text.rlike(ANY), F.lit(False))


def _script(name: Column) -> Column:
    found = F
    for script in SYLLABLES:
        if script != "latin":
            found = found.when(name.rlike(rf"\p{{Is{script.capitalize()}}}"), script)
    return found.otherwise("latin")


def _part(kind: Column, norm: Column, raw: Column, before: Column) -> Column:
    return F.struct(kind.alias("kind"), norm.alias("norm"), raw.alias("raw"), before.alias("before")).cast(PART)


def _name_parts(raw: Column) -> Column:
    """The words of a titled name as parts: the last full one is the family
    name; titles, particles and spaces stay as text before them."""
    lead = F.regexp_extract(raw, f"^{_LEAD}", 0)
    rest = F.substr(raw, F.length(lead) + 1)
    def titled(titles):
        return lead.rlike(rf"(?<!\p{{L}})(?:{'|'.join(titles)})(?!\p{{L}})")

    gender = F.when(titled(MALE), "m").when(titled(FEMALE), "f").otherwise("n")
    words, gaps = F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0)), F.split(rest, _WORD)

    def parts(v):
        def one(w, i):
            short = F.length(F.replace(w, F.lit("."), F.lit(""))) == 1
            kind = (F.when(short, "initial").when(i == v["last"], "family").otherwise(F.concat(F.lit("given:"), v["gender"])))
            return _part(F.concat_ws(":", kind, _script(w)), F.when(short, F.substring(w, 1, 1)).otherwise(w), w,
                         F.concat(F.when(i == 0, v["lead"]).otherwise(""), F.get(v["gaps"], i)))
        return F.transform(v["words"], one)

    full = F.transform(words, lambda w, i: F.when(F.length(F.replace(w, F.lit("."), F.lit(""))) > 1, i).otherwise(-1))
    held = F.struct(words.alias("words"), gaps.alias("gaps"), lead.alias("lead"), gender.alias("gender"), F.array_max(full).alias("last"))
    return F.transform(F.array(held), parts)[0]


def _parts(raw: Column) -> Column:
    """An occurrence as parts to map: (kind, normal form, raw, text before)."""
    def one(kind, norm):
        return F.array(_part(F.lit(kind), norm, raw, F.lit("")))

    digits = F.regexp_replace(raw, r"[^\d+]", "")

    return (F.when(raw.rlike(f"^{PERSON}$"), _name_parts(raw))
            .when(raw.contains("@"), one("email", F.lower(raw)))
            .when(raw.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), one("ip", raw))
            .when(raw.rlike(r"^(?:(?:\d{4}[ -]){3}\d{4}|[3-6]\d{14,15})$"), one("card", digits))
            .when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), one("national", digits))
            .when((F.length(raw) <= 40) & raw.rlike(r"^[+(]?[\d][\d ().-]+$"), one("phone", digits))
            .when(raw.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"),
                  one("iban", F.replace(raw, F.lit(" "), F.lit(""))))
            .when(raw.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$") & raw.rlike("[A-Fa-f]"), one("hex", F.lower(raw)))
            .otherwise(one("secret", raw)))


def _own_names(text: Column) -> Column:
    """(norm, kind) of the words of the text's titled names, each once; a
    gender that a title tells comes before one that it does not."""
    words = F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), _name_parts)),
                     lambda p: ~p["kind"].startswith("initial"))

    def once(v):
        norms = F.transform(v, lambda p: p["norm"])
        first = F.transform(F.array_distinct(norms), lambda n: F.element_at(v, F.array_position(norms, n).cast("int")))
        return F.transform(first, lambda p: F.struct(p["norm"].alias("norm"), p["kind"].alias("kind")))

    told = F.transform(F.array(words), lambda w: F.concat(
        F.filter(w, lambda p: ~p["kind"].startswith("given:n")), F.filter(w, lambda p: p["kind"].startswith("given:n"))))
    return F.transform(told, once)[0]


def with_pattern(texts: DataFrame) -> DataFrame:
    """Adds ``own``, the names (norm, kind) of each text's titled persons, and
    ``pattern``: ANY, and those names where they stand without a title."""
    own = F.when(F.col("text").rlike(PERSON), _own_names(F.col("text"))).otherwise(F.array().cast("array<struct<norm:string,kind:string>>"))
    longest = F.reverse(F.array_sort(F.transform("own", lambda p: F.struct(F.length(p["norm"]).alias("n"), p["norm"].alias("norm")))))
    names = F.array_join(F.transform(longest, lambda p: p["norm"]), "|")
    return texts.withColumn("own", own).withColumn("pattern", F.when(F.size("own") == 0, F.lit(ANY)).otherwise(
        F.concat(F.lit(ANY + r"|(?<![\p{L}\p{M}\p{N}])(?=\p{Lu})(?:"), names, F.lit(")" + _END))))


def occurrences(texts: DataFrame) -> DataFrame:
    """(rk, pos, part, kind, norm, raw, before) of texts (rk, text)."""
    found = with_pattern(texts).select("rk", "own", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("hits"))
    kinds = F.map_from_entries("own")

    def resolved(m):
        def known(p):
            k = F.element_at(m, p["norm"])
            return p.withField("kind", F.when(p["kind"].startswith("given:n") & k.startswith("given:"), k).otherwise(p["kind"]))
        return F.transform("hits", lambda h: F.when(m[h].isNotNull(), F.array(_part(m[h], h, h, F.lit("")))).otherwise(
            F.transform(_parts(h), known)))

    parts = F.transform(F.array(kinds), resolved)[0]
    return (found.select("rk", F.posexplode(parts).alias("pos", "ps")).select("rk", "pos", F.posexplode("ps").alias("part", "p"))
            .select("rk", "pos", "part", "p.kind", "p.norm", "p.raw", "p.before"))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 + 1, 2), 16, 10).cast("int")


def luhn_digit(digits: Column) -> Column:
    """The check digit that follows ``digits``."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(
        i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The 256 bytes, in hex, that a surrogate is made of."""
    def block(i):
        return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"), F.lit(str(i))), 512)

    return F.concat(*[block(i) for i in range(4)])


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Surrogate of a normal form; equal inputs give equal outputs."""
    # hashed once and not for each character
    return F.transform(F.array(_stream(key, kind, norm, attempt)), lambda s: _made(s, kind, norm, attempt))[0]


def initial_surrogate(key: str, kind: Column, norm: Column) -> Column:
    """``surrogate`` of an initial at its only attempt, without what other kinds need."""
    return _initial(_stream(key, kind, norm, F.lit(0)), kind, norm)


def _by_script(kind: Column, of) -> Column:
    """``of(script)`` for the script that ends a kind of names."""
    out = F
    for script in SYLLABLES:
        out = out.when(kind.endswith(script), of(script))
    return out


def _initial(stream: Column, kind: Column, norm: Column) -> Column:
    capitals = _by_script(kind, lambda s: F.split(F.lit(" ".join(dict.fromkeys(x[0].upper() for x in SYLLABLES[s]))), " "))
    others = F.filter(capitals, lambda x: x != norm)
    return F.transform(F.array(others), lambda o: F.get(o, F.pmod(_byte(stream, F.lit(0)), F.size(o))))[0]


def _name(stream: Column, kind: Column, attempt: Column) -> Column:
    def end(script):
        f, m, n, family = ENDINGS.get(script, ("",) * 4)
        return F.when(kind.startswith("given:f"), f).when(kind.startswith("given:m"), m).when(kind.startswith("given:n"), n).otherwise(family)

    def syllables(pool):
        count = F.least(F.lit(2) + attempt, F.lit(8))
        return F.array_join(F.transform(F.sequence(F.lit(0), count), lambda i: F.element_at(
            pool, (F.pmod(_byte(stream, i), F.lit(16)) + 1).cast("int"))), "")

    pool = _by_script(kind, lambda s: F.split(F.lit(" ".join(SYLLABLES[s])), " "))
    return F.initcap(F.concat(F.transform(F.array(pool), syllables)[0], _by_script(kind, end)))


def _made(stream: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    def letters(c, i):
        n = _byte(stream, F.pmod(i, F.lit(256)))
        return (F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
                .when(c.rlike("[a-z]"), F.char(F.lit(97) + F.pmod(n, F.lit(26))))
                .when(c.rlike("[A-Z]"), F.char(F.lit(65) + F.pmod(n, F.lit(26))))
                .when(c.rlike(r"[^\x00-\x7F]"), beyond(c, n)).otherwise(c))

    def one_of(pool: str, n):
        return F.substring(F.lit(pool), F.pmod(n, F.lit(len(pool))) + 1, 1)

    def beyond(c, n):
        """A letter of the same case and script, for one beyond ASCII; marks and
        signs become letters too, so that nothing of the word stays."""
        out = F
        for script, table in SYLLABLES.items():
            pool = "".join(sorted(set("".join(table)))) if script != "latin" else "abcdefghijklmnopqrstuvwxyz"
            of = c.rlike(rf"\p{{Is{script.capitalize()}}}")
            out = out.when(of & c.rlike(r"\p{Lu}"), F.upper(one_of(pool, n))).when(of, one_of(pool, n))
        for script, ends in UNCASED.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), one_of(_pool(*ends), n))
        return out.when(c.rlike(r"\p{N}"), F.pmod(n, F.lit(10)).cast("string")).otherwise(one_of("abcdefghijklmnopqrstuvwxyz", n))

    def mapped(p):
        return F.array_join(F.transform(F.split(p["text"], ""), lambda c, i: letters(c, i + p["offset"])), "")

    def piece(text, offset):
        return F.struct(text.alias("text"), F.lit(offset).alias("offset"))

    named = kind.startswith("given:") | kind.startswith("family:")
    access = norm.rlike("^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]+)$")
    prefix = F.regexp_extract(norm, r"^(\+\d)", 1)
    # what is mapped of each kind; the rest of its normal form is kept or made otherwise
    main = (F.when(kind == "email", F.regexp_replace(norm, r"\.[^.]+$", ""))
            .when(kind == "card", F.substr(norm, F.lit(2), F.length(norm) - 2))
            .when(kind == "phone", F.substr(norm, F.length(prefix) + 1)).when(kind == "iban", F.substr(norm, F.lit(3)))
            .when(kind.isin("ip", "hex") | kind.startswith("initial:"), "")
            .when(access, F.substr(norm, F.lit(5))).when(named, "").otherwise(norm))
    # past MAX_ATTEMPTS the format has no free value: each attempt adds a character
    extra = F.greatest(attempt - F.lit(MAX_ATTEMPTS - 1), F.lit(0))
    added = F.repeat(F.when(kind == "email", "a").otherwise("0"), extra)
    last = F.when(kind == "card", F.substring(norm, -1, 1)).otherwise("")

    def whole(m):
        plain, more, other = m[0], m[1], m[2]
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (
            F.pmod(_byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1), F.lit(254)) + 1).cast("string")), ".")
        body = F.concat(F.substring(norm, 1, 1), plain, more)
        valid = luhn_digit(F.substr(norm, F.lit(1), F.length(norm) - 1)) == F.substring(norm, -1, 1)
        hexed = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.substring(stream, F.pmod(i, F.lit(512)) + 1, 1)), "")
        return (F.when(kind == "email", F.concat(more, plain, F.regexp_extract(norm, r"(\.[^.]+)$", 1))).when(kind == "ip", octets)
                .when(kind == "card", F.concat(body, F.when(valid, luhn_digit(body)).otherwise(other)))
                .when(kind == "phone", F.concat(prefix, plain, more)).when(kind == "iban", F.concat(F.substring(norm, 1, 2), plain, more))
                .when(kind == "hex", F.concat(hexed, more))
                .when(kind.startswith("initial:"), _initial(stream, kind, norm))
                .when(access, F.concat(F.substring(norm, 1, 4), plain, more))
                .when(named, _name(stream, kind, attempt)).otherwise(F.concat(plain, more)))

    # one expression maps all pieces: a copy for each kind makes plans that fill the driver
    pieces = F.transform(F.array(piece(main, 0), piece(added, 128), piece(last, 40)), mapped)
    return F.transform(F.array(pieces), whole)[0]


def _type(kind: Column) -> Column:
    """What surrogates must differ within: a kind, or all kinds of names."""
    return F.when(kind.startswith("given:") | kind.startswith("family:"), F.lit("name")).otherwise(kind)


def entity_map(entities: DataFrame, key: str, widen: bool = False) -> DataFrame:
    """Distinct (kind, norm) -> (kind, norm, surrogate), free of collisions.
    With ``widen``, entities that find no free value of their format in
    MAX_ATTEMPTS rounds get longer surrogates; else that is an error."""
    real = staged(entities.filter(~F.col("kind").startswith("initial:")).select("kind", "norm").distinct(), "pii-entities")
    table = staged(real.withColumn("attempt", F.lit(0)).withColumn(
        "surrogate", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))), "pii-map")
    for _ in count() if widen else range(MAX_ATTEMPTS):
        typed = table.withColumn("type", _type(F.col("kind")))
        owner = typed.groupBy("type", "surrogate").agg(F.min(F.struct("kind", "norm")).alias("owner"), F.count(F.lit(1)).alias("n"))
        shared = owner.filter("n > 1").select("type", "surrogate", "owner")
        taken = real.select(_type(F.col("kind")).alias("type"), F.col("norm").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        checked = (typed.join(shared, ["type", "surrogate"], "left").join(taken, ["type", "surrogate"], "left")
                   .withColumn("again", (F.col("owner").isNotNull() & (F.col("owner") != F.struct("kind", "norm"))) | F.col("real").isNotNull()))
        if not checked.filter("again").limit(1).count():
            return table.select("kind", "norm", "surrogate")
        attempt = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        new = checked.select("kind", "norm", "again", attempt.alias("attempt"), F.col("surrogate").alias("old"))
        table = staged(new.select("kind", "norm", "attempt", F.when(
            F.col("again"), surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))).otherwise(F.col("old")).alias("surrogate")), "pii-map")
    raise ValueError("the entities of a kind are too many for surrogates of their format")


def with_known_genders(hits: DataFrame) -> DataFrame:
    """Given names whose title tells no gender take the one that the name has
    elsewhere, so that a person is one entity in all documents."""
    given = hits.filter(F.col("kind").startswith("given:"))
    told = (given.filter(~F.col("kind").startswith("given:n")).groupBy("norm", F.substring_index("kind", ":", -1).alias("script"))
            .agg(F.min("kind").alias("told")))
    untold = given.filter(F.col("kind").startswith("given:n")).withColumn("script", F.substring_index("kind", ":", -1))
    known = untold.join(told, ["norm", "script"], "left").withColumn("kind", F.coalesce("told", "kind")).select(hits.columns)
    return known.unionByName(hits.filter(~F.col("kind").startswith("given:n")))


def in_format(raw: Column, made: Column, kind: Column) -> Column:
    """A surrogate of the normal form in the occurrence's own format."""
    digits = F.regexp_replace(made, r"\D", "")
    own = F.length(F.regexp_replace(raw, r"\D", ""))
    spread = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(
        c.rlike(r"\d"), F.substring(digits, F.length(F.regexp_replace(F.substring(raw, 1, i + 1), r"\D", "")), 1)).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(
        c.rlike(r"\p{Lu}"), F.upper(F.substring(made, i + 1, 1))).otherwise(F.substring(made, i + 1, 1))), "")
    spaced = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c == " ", c).otherwise(
        F.substring(made, F.length(F.replace(F.substring(raw, 1, i + 1), F.lit(" "), F.lit(""))), 1))), "")
    # a widened surrogate goes on where the occurrence's own format ends
    spread = F.concat(spread, F.substr(digits, own + 1))
    cased = F.concat(cased, F.substr(made, F.length(raw) + 1))
    spaced = F.concat(spaced, F.substr(made, F.length(F.replace(raw, F.lit(" "), F.lit(""))) + 1))
    return (F.when(kind.isin("phone", "card", "national"), spread).when(kind == "email", cased)
            .when((kind == "hex") & raw.rlike("[A-F]"), F.upper(made))
            .when(kind == "iban", spaced)
            .when(kind.startswith("initial:") & raw.endswith("."), F.concat(made, F.lit("."))).otherwise(made))


def replace_entities(docs: DataFrame, key: str, count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; ``count_col`` names an
    additional column with the number of replaced entities. ``key`` is the
    caller's secret: who has it can tell which surrogate stands for a guess."""
    if not key:
        raise ValueError("surrogates need a key")
    rk = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))  # 128 bits
    rows = docs.select(F.struct(*docs.columns).alias("_row"), rk.alias("rk"), F.col("text").alias("text"))
    has = has_entity(F.col("text"))
    hits = staged(with_known_genders(staged(occurrences(rows.filter(has).select("rk", "text").dropDuplicates(["rk"])), "pii-found")), "pii-hits")
    made = hits.join(entity_map(hits, key, widen=True), ["kind", "norm"], "left").withColumn(
        "surrogate", F.when(F.col("kind").startswith("initial:"), initial_surrogate(key, F.col("kind"), F.col("norm")))
        .otherwise(F.col("surrogate"))).select("rk", "pos", "part", F.concat(
        "before", in_format(F.col("raw"), F.col("surrogate"), F.col("kind"))).alias("piece"))
    by_hit = made.groupBy("rk", "pos").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("piece"))
    by_text = by_hit.groupBy("rk").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]).alias("pieces"))
    gaps = F.split("text", F.col("pattern"))
    woven = F.array_join(F.zip_with(gaps, F.concat("pieces", F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")
    changed = with_pattern(rows.filter(has).join(by_text, "rk")).select(
        F.col("_row").withField("text", woven).alias("_row"), F.size("pieces").cast("bigint").alias("_n"))
    same = rows.filter(~has).select("_row", F.lit(0).cast("bigint").alias("_n"))
    out = changed.unionByName(same)
    return out.select("_row.*", F.col("_n").alias(count_col)) if count_col else out.select("_row.*")


#: For the given tables, whose entities are invented; real data takes a secret.
DEMO_KEY = "furrow-demo-key"


def op1_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"), DEMO_KEY, count_col="n_entities")


QUERIES = {"op1_surrogates": op1_surrogates}
