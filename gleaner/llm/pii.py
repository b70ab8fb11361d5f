"""Replacement of personal data by keyed surrogates.

E-mail addresses, phone numbers, IPv4 addresses, card, social security and bank account numbers,
access keys and passwords, and names after a title are found by patterns and replaced. A surrogate
depends on a key and on the entity alone, so mentions of one entity agree everywhere (case of
addresses and separators of numbers don't matter), and it keeps the mention's format: digits stay
digits, letters letters of the same case and script, separators stay, addresses stay addresses of one
domain; a card number passes the Luhn check if and only if the original does.

Names are replaced word by word, so "Dr. Anna Lee", "Mrs. Anna Lee", "Mr. Lee" and, in a text that has a
titled mention, "Anna Lee" and "Lee" without one agree. A given name's surrogate ends by its gender: what
the titles before it say in all documents, neutral if they say nothing or both.

Distinct entities get distinct surrogates. Numbers, secrets, keys and accounts are permuted (Feistel
networks over their characters, so two never meet, even where the input uses up all strings of a
format). Words of names and addresses draw from spaces that grow with the number of distinct ones, so
that a draw without a collision is likely (99 %) whatever the input's size. A check over all of them
looks for two that meet and for surrogates that are someone's name or address in the input; each time
it finds one, the next subkey draws from a space 26 times larger, so the draw always ends.

Not found: names that never follow a title, secrets without a digit, and a phone number's country code
if only some mentions have it (two numbers).

Native DataFrame code throughout. Edge cases: null texts stay null, empty ones empty; repeated rows
change alike; other columns, whatever their names, stay as they are; empty tables give empty results.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, unused


@dataclass(frozen=True)
class PiiParams:
    key: str = "surrogates"
    salts: int = 16  # parts of a text's rows where many copies look up the genders of its names


_NAME = r"\p{Lu}[\p{Ll}]+(?:[-']\p{Lu}\p{Ll}+)?(?: \p{Lu}[\p{Ll}]+)?"
#: Titles by gender: male, female, either.
TITLES = (
    (r"(?:Mr|Herr|Monsieur|Señor|Sr|Don|Господин)", "m"),
    (r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Госпожа)", "f"),
    (r"(?:Dr|Prof)", "x"),
)
#: kind -> pattern, in the order they are tried at a place of the text.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,64})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
SECRET = r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?(?=[A-Za-z0-9_+/-]*[0-9])[A-Za-z0-9_+/-]{8,}"
NAMED = r"\b(?:" + "|".join(t for t, _ in TITLES) + r")\.? " + _NAME
#: The country code of a phone number. No code begins another, so a number's digits alone tell its code.
_GAP = r"[ .(-]*"
_TWO = "|".join(f"{a}{_GAP}[{b}]" for a, b in (("2", "07"), ("3", "0-469"), ("4", "013-9"), ("5", "1-8"), ("6", "0-6"), ("8", "1246"), ("9", "0-58")))
COUNTRY = rf"^\+(?:[17]|{_TWO}|[0-9]{_GAP}[0-9]{_GAP}[0-9])"
#: One pass finds all kinds; what stands before a secret or a name is found with it and stays.
PATTERN = "|".join(f"(?:{p})" for p in [SECRET, *KINDS.values(), NAMED])
#: Names and addresses alone, whose surrogates may meet, and a cheap test for them.
DRAWN, DRAWN_HINT = f"(?:{KINDS['email']})|(?:{NAMED})", r"@|\b(?:" + "|".join(t for t, _ in TITLES) + r")\.? \p{Lu}"
#: Cheap test that a text may hold an entity at all.
HINT = r"[0-9@]|(?i:token|secret|passw|pwd|api[_-]?key)|\b(?:" + "|".join(t for t, _ in TITLES) + r")\.? \p{Lu}"

#: Syllables of surrogate names and their endings by script and gender.
SYLLABLES = {
    "latin": ("ba be bi da de do fa ga ka ke la le li lo ma me mi na ne ni ra re ri ro sa se ta te ti va ve vi".split(), {"m": "on", "f": "ia", "x": "is"}),
    "cyrillic": ("ба бе ва ве да де ка ке ла ле ли ма ме ми на не ни ра ре ри ро са се та те ти".split(), {"m": "ов", "f": "ова", "x": "ис"}),
}


def _digest(key: Column, *parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", key, *parts))


def _number(digest: Column, at: int = 1) -> Column:
    """15 hex digits of a digest as a long."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def _ten(n: Column) -> Column:
    """10**n for n up to 10, as a long."""
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(11)]), (n + 1).cast("int"))


def permuted(digits: Column, key: Column) -> Column:
    """A keyed permutation of the digit strings of each length (up to 20): four Feistel rounds."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    left, right = F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v)
    # A single digit has an empty left half, which stays empty.
    state = F.struct(F.coalesce(left.try_cast("long"), F.lit(0).cast("long")).alias("l"), F.coalesce(right.try_cast("long"), F.lit(0).cast("long")).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        add_l = F.pmod(s["l"] + F.pmod(_number(_digest(key, n.cast("string"), i.cast("string"), F.lit("l"), s["r"].cast("string"))), _ten(u)), _ten(u))
        return F.struct(add_l.alias("l"), s["r"].alias("r"))

    def back(s: Column, i: Column) -> Column:
        add_r = F.pmod(s["r"] + F.pmod(_number(_digest(key, n.cast("string"), i.cast("string"), F.lit("r"), s["l"].cast("string"))), _ten(v)), _ten(v))
        return F.struct(s["l"].alias("l"), add_r.alias("r"))

    rounds = F.array(*[F.lit(i) for i in range(4)])
    done = lambda s: F.concat(F.when(u > 0, F.lpad(s["l"].cast("string"), u, F.lit("0"))).otherwise(""), F.lpad(s["r"].cast("string"), v, F.lit("0")))
    step = lambda s, i: F.when(i % 2 == 0, turn(s, i)).otherwise(back(s, i))
    return F.aggregate(rounds, state, step, done)


def in_shape(mention: Column, letters: Column) -> Column:
    """``mention`` with its digits replaced, in order, by the characters of ``letters``."""
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["o"], F.when(digit, F.substring(letters, s["i"] + 1, F.lit(1))).otherwise(c)).alias("o"), (s["i"] + F.when(digit, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(mention, ""), start, step, lambda s: s["o"])


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alphabets(entity: Column) -> Column:
    """For each character the characters that may stand for it ("" if it stays).

    Any choice from them has the same alphabets again: digits stay digits, strings of hex digits with a
    letter stay such strings, and lower-case strings that aren't hex stay so.
    """
    small, more, digits = "abcdef", "ghijklmnopqrstuvwxyz", "0123456789"
    hexes, lower = entity.rlike("^[0-9a-f]*[a-f][0-9a-f]*$"), entity.rlike("^[0-9a-z]*[g-z][0-9a-z]*$")
    # The place of the first letter of a hex string, or of the first one that shows that a string isn't hex.
    mark = F.when(hexes, F.length(F.regexp_extract(entity, "^[0-9]*", 0))).when(lower, F.length(F.regexp_extract(entity, "^[0-9a-f]*", 0))).otherwise(-1)

    def alphabet(x: Column, c: Column, i: Column) -> Column:
        before, here = i < x["mark"], i == x["mark"]
        return (
            F.when(x["hexes"], F.when(before, digits).when(here, small).otherwise(digits + small))
            .when(c.rlike("[0-9]"), digits)
            .when(c.rlike("[a-z]"), F.when(before, small).when(here, more).otherwise(small + more))
            .when(c.rlike("[A-Z]"), (small + more).upper()).otherwise("")
        )

    about = F.struct(hexes.alias("hexes"), mark.alias("mark"), F.split(entity, "").alias("c"))
    return _let(about, lambda x: F.transform(x["c"], lambda c, i: alphabet(x, c, i)))


def scrambled(entity: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the strings of each format: four Feistel rounds over the two halves."""

    def step(s: Column, r: Column) -> Column:
        half = F.floor(F.size(s["c"]) / 2).cast("int")
        other = F.when(r % 2 == 0, F.slice(s["c"], half + 1, F.size(s["c"]))).otherwise(F.slice(s["c"], 1, half))

        def turn(d: Column, c: Column, i: Column) -> Column:
            letters = F.get(s["a"], i)
            moved = ((i < half) == (r % 2 == 0)) & (letters != "")
            at = F.pmod(F.instr(letters, c) - 1 + _number(_digest(d, i.cast("string"))), F.length(letters).cast("long"))
            return F.when(moved, F.substring(letters, (at + 1).cast("int"), F.lit(1))).otherwise(c)

        drawn = _digest(key, F.lit(kind), r.cast("string"), F.array_join(other, ""))
        return F.struct(_let(drawn, lambda d: F.transform(s["c"], lambda c, i: turn(d, c, i))).alias("c"), s["a"].alias("a"))

    state = F.struct(F.split(entity, "").alias("c"), _alphabets(entity).alias("a"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(4)]), state, step, lambda s: F.array_join(s["c"], ""))


@dataclass(frozen=True)
class Room:
    """How long drawn surrogates are."""

    syllables: int = 5  # of each word of a name
    letters: int = 13  # of an address, at most 32


def _width(n: int, base: int, least: int) -> int:
    """The length from which ``n`` draws all differ with a chance of more than 99 %: ``base ** length`` is 100 n² or more."""
    while base**least < 100 * n * n:
        least += 1
    return least


def room_for(found: DataFrame, more: int = 0) -> Room:
    """Room for all words of names and all addresses of ``found``, and ``more`` besides."""
    n = found.agg(F.count_if(F.col("kind") == "name"), F.count_if(F.col("kind") == "email")).first()
    few, least = min(len(parts) for parts, _ in SYLLABLES.values()), Room()
    return Room(_width(n[0], few, least.syllables) + more, min(32, _width(n[1], 16, least.letters) + more))


def _script(word: Column, make) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), make("cyrillic")).otherwise(make("latin"))


def _word(word: Column, key: Column, room: Room) -> Column:
    """A made-up word of a name, without a gender's ending."""
    drawn = [_digest(key, F.lit("name"), word, *[F.lit(str(b))][:b]) for b in range((room.syllables + 7) // 8)]  # eight syllables each

    def made(script: str) -> Column:
        parts, _ = SYLLABLES[script]
        table = F.array(*[F.lit(s) for s in parts])
        body = [F.element_at(table, (F.pmod(F.conv(F.substring(drawn[k // 8], 1 + 4 * (k % 8), 4), 16, 10).cast("long"), F.lit(len(parts))) + 1).cast("int")) for k in range(room.syllables)]
        return F.initcap(F.concat(*body))

    return _script(word, made)


def _ending(word: Column, gender: Column) -> Column:
    of = lambda script: F.when(gender == "m", SYLLABLES[script][1]["m"]).when(gender == "f", SYLLABLES[script][1]["f"]).otherwise(SYLLABLES[script][1]["x"])
    return _script(word, of)


#: Words of a name, with what stands between them.
NAME_PARTS = r"(?<=[ '-])|(?=[ '-])"


def given(entity: Column) -> Column:
    """The given name of a name of two words, else null."""
    return F.when(F.contains(entity, F.lit(" ")), F.get(F.split(entity, NAME_PARTS), F.lit(0)))


def named(p: Column, key: Column, room: Room, genders: Column | None = None) -> Column:
    """The parts of a titled name and their surrogates, in order: structs w, s. ``genders`` holds structs
    (w, g) of given names whose titles differ."""
    own = gender_of(p["lead"])

    def part(w: Column, i: Column) -> Column:
        known = F.get(F.filter(genders, lambda e: e["w"] == w), F.lit(0))["g"] if genders is not None else F.lit(None).cast("string")
        end = F.when((i == 0) & F.contains(p["entity"], F.lit(" ")), _ending(w, F.coalesce(known, own))).otherwise("")
        return F.struct(w.alias("w"), F.when(w.rlike("^[ '-]$"), w).otherwise(F.concat(_word(w, key, room), end)).alias("s"))

    return F.transform(F.split(p["entity"], NAME_PARTS), part)


def parts_of(mention: Column) -> Column:
    """A mention as a struct: kind, lead (stays as it is), body (gets a surrogate), entity (what the surrogate depends on)."""
    body = lambda lead: F.substring(mention, F.length(lead) + 1, F.length(mention))
    empty = F.lit("")
    key_lead = F.regexp_extract(mention, r"^(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?", 0)
    name_lead = F.regexp_extract(mention, "^(?:" + "|".join(t for t, _ in TITLES) + r")\.? ", 0)
    phone_lead = F.regexp_extract(mention, COUNTRY, 0)
    aws_lead = F.regexp_extract(mention, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    made = lambda kind, lead, b, entity: F.struct(F.lit(kind).alias("kind"), lead.alias("lead"), b.alias("body"), entity.alias("entity"))
    at = lambda k: mention.rlike(f"^(?:{KINDS[k]})$")
    return (
        F.when(key_lead != "", made("secret", key_lead, body(key_lead), body(key_lead)))
        .when(mention.contains("@"), made("email", empty, mention, F.lower(mention)))
        .when(name_lead != "", made("name", name_lead, body(name_lead), body(name_lead)))
        .when(at("ip"), made("ip", empty, mention, mention))
        .when(at("ssn"), made("ssn", empty, mention, digits(mention)))
        .when(at("key"), made("key", aws_lead, body(aws_lead), mention))
        .when(at("phone"), made("phone", phone_lead, body(phone_lead), F.concat_ws("/", digits(phone_lead), digits(body(phone_lead)))))
        .when(at("card"), made("card", F.substring(mention, 1, 1), F.substring(mention, F.lit(2), F.length(mention)), digits(mention)))
        .otherwise(made("iban", F.substring(mention, 1, 2), F.substring(mention, F.lit(3), F.length(mention)), F.regexp_replace(mention, " ", "")))
    )


def gender_of(lead: Column) -> Column:
    out = F.lit("x")
    for pattern, g in TITLES:
        if g != "x":
            out = F.when(lead.rlike(f"^{pattern}"), g).otherwise(out)
    return out


def luhn(digits: Column) -> Column:
    """The check digit that goes behind ``digits``."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: _let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def surrogate(p: Column, key: Column, room: Room = Room()) -> Column:
    """The replacement of a mention given as ``parts_of`` describes."""
    kind, body = p["kind"], p["body"]
    local = F.substring_index(p["entity"], "@", 1)
    d = _digest(key, F.lit("email"), p["entity"])
    # Letters of a base-16 alphabet (in two parts where the original has two), then as many digits as a numbered address has at its end.
    lettered = lambda c: F.translate(c, "0123456789abcdef", "bdfghklmnprstvwz")
    between = F.regexp_extract(local, "^[a-z]+([._+-])[a-z]", 1)
    letters = F.concat(lettered(F.substring(d, 1, 6)), between, lettered(F.substring(d, 7, room.letters - 6)))
    host = lettered(F.substring(_digest(key, F.lit("host"), F.substring_index(p["entity"], "@", -1)), 1, 10))
    end = F.regexp_extract(local, r"[._-]?[0-9]+$", 0)
    number = in_shape(end, F.translate(F.substring(d, 14, 18), "abcdef", "123456"))
    email = F.concat(letters, number, F.lit("@"), host, F.lit(".example.org"))
    octets = F.transform(F.split(body, r"\."), lambda o: o.cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    high, low = F.shiftright(value, 16), value.bitwiseAND(F.lit(0xFFFF).cast("long"))
    f = lambda i, x: F.conv(F.substring(_digest(key, F.lit(f"ip{i}"), x.cast("string")), 1, 4), 16, 10).cast("long")
    state = F.struct(high.alias("h"), low.alias("l"))
    mixed = F.aggregate(
        F.array(F.lit(0), F.lit(1)), state,
        lambda s, i: F.struct(s["l"].alias("h"), s["h"].bitwiseXOR(F.when(i == 0, f(0, s["l"])).otherwise(f(1, s["l"]))).alias("l")),
        lambda s: F.concat_ws(".", F.shiftright(s["h"], 8), s["h"].bitwiseAND(F.lit(255).cast("long")), F.shiftright(s["l"], 8), s["l"].bitwiseAND(F.lit(255).cast("long"))),
    )
    digits = F.regexp_replace(body, "[^0-9]", "")
    number = in_shape(body, permuted(digits, F.concat(key, kind, F.regexp_replace(p["lead"], r"[ .(-]", ""))))
    most, last = F.concat(p["lead"], F.substring(digits, F.lit(1), F.length(digits) - 1)), F.substring(digits, F.length(digits), F.lit(1))
    moved = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), F.concat(key, kind, p["lead"]))
    check = _let(moved, lambda m: F.concat(m, F.pmod(luhn(F.concat(p["lead"], m)) + last.cast("int") - luhn(most), F.lit(10)).cast("string")))
    card = in_shape(body, check)
    plain = F.concat(p["lead"], scrambled(F.regexp_replace(body, " ", ""), key, "iban"))
    bank = F.substring(F.when(body.contains(" "), F.regexp_replace(plain, "(.{4})(?=.)", "$1 ")).otherwise(plain), 3, 64)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", mixed)
        .when(kind.isin("phone", "ssn"), number)
        .when(kind == "card", card)
        .when(kind == "iban", bank)
        .otherwise(scrambled(body, key, "key"))
    )


def _woven(gaps: Column, new: Column) -> Column:
    """``gaps`` with ``new`` between them."""
    return F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _untitled(gap: Column, known: Column) -> Column:
    """What stands between mentions, with words of names that have a titled mention in the text replaced."""
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(known, lambda e: e["w"]), "|"), F.lit(r")(?!\p{L})"))
    new = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), lambda w: F.get(F.filter(known, lambda e: e["w"] == w), F.lit(0))["s"])
    return _woven(F.split(gap, pattern, -1), new)


def replaced(text: Column, key: Column, room: Room = Room(), genders: Column | None = None) -> Column:
    """``text`` with every mention replaced."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), parts_of)
    empty = F.array().cast("array<struct<w:string,s:string>>")

    def whole(x: Column) -> Column:
        each = F.transform(x["p"], lambda p: F.struct(p["kind"].alias("kind"), p["lead"].alias("lead"), F.when(p["kind"] == "name", named(p, key, room, genders)).otherwise(empty).alias("n"), F.when(p["kind"] != "name", surrogate(p, key, room)).alias("s")))
        return _let(each, lambda e: woven(x["gaps"], e))

    def woven(gaps: Column, each: Column) -> Column:
        new = F.transform(each, lambda e: F.concat(e["lead"], F.coalesce(e["s"], F.array_join(F.transform(e["n"], lambda t: t["s"]), ""))))
        known = F.filter(F.flatten(F.transform(each, lambda e: e["n"])), lambda t: F.length(t["w"]) > 1)
        return _let(known, lambda k: F.when(F.size(k) == 0, _woven(gaps, new)).otherwise(_woven(F.transform(gaps, lambda g: _untitled(g, k)), new)))

    about = F.struct(found.alias("p"), F.split(text, PATTERN, -1).alias("gaps"))
    return F.when(text.rlike(HINT), _let(about, whole)).otherwise(text)


def _drawn(text: Column) -> Column:
    """Names and addresses of a text."""
    return F.when(text.rlike(DRAWN_HINT), F.regexp_extract_all(text, F.lit(DRAWN), F.lit(0)))


def entities(docs: DataFrame) -> DataFrame:
    """``kind, entity, genders``: distinct words of names and distinct addresses of the input (other kinds are
    permuted and can't meet), with the genders that titles give to a given name."""
    found = docs.select(F.explode(_drawn(F.col("text"))).alias("m")).groupBy("m").agg(F.lit(1)).select(parts_of(F.col("m")).alias("p"))
    entity = F.col("p.entity")
    words = F.filter(F.split(entity, NAME_PARTS), lambda w: ~w.rlike("^[ '-]$"))
    words = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.when((i == 0) & given(entity).isNotNull(), gender_of(F.col("p.lead"))).alias("g")))
    each = F.when(F.col("p.kind") == "name", words).otherwise(F.array(F.struct(entity.alias("w"), F.lit(None).cast("string").alias("g"))))
    rows = found.where(F.col("p.kind").isin("email", "name")).select("p.kind", F.explode(each).alias("x"))
    return rows.groupBy("kind", F.col("x.w").alias("entity")).agg(F.array_sort(F.collect_set("x.g")).alias("genders"))  # three at most


def meets(found: DataFrame, key: str, room: Room) -> bool:
    """Do two words of names or two addresses share a surrogate under this key, or is one somebody's in the input?"""
    p = F.struct("kind", F.lit("").alias("lead"), F.col("entity").alias("body"), "entity")
    new = F.when(F.col("kind") == "name", _word(F.col("entity"), F.lit(key), room)).otherwise(surrogate(p, F.lit(key), room))
    drawn = cut(found.select("kind", "entity", new.alias("s")))
    if not drawn.groupBy("kind", "s").count().where("count > 1").isEmpty():
        return True
    ends = sorted({"", *[e for _, by in SYLLABLES.values() for e in by.values()]})
    forms = drawn.select("kind", F.explode(F.when(F.col("kind") == "name", F.array(*[F.concat("s", F.lit(e)) for e in ends])).otherwise(F.array("s"))).alias("entity"))
    return not forms.join(found.select("kind", "entity"), ["kind", "entity"], "left_semi").isEmpty()


def _settled(found: DataFrame, params: PiiParams) -> tuple[str, Room]:
    for i in itertools.count():
        key, room = f"{params.key}/{i}", room_for(found, i)
        if not meets(found, key, room):
            return key, room


def working_key(docs: DataFrame, params: PiiParams = PiiParams()) -> str:
    """The first subkey under which all entities of ``docs`` get distinct surrogates."""
    return _settled(cut(entities(docs)), params)[0]


def _with_genders(docs: DataFrame, mixed: DataFrame, key: str, name: str, p: PiiParams) -> DataFrame:
    """``docs`` with the genders of those of a text's given names whose titles differ between mentions, as ``name``.

    Texts meet their names by a hash; rows of a text's copies are dealt out by a salt."""
    hashed, salt = F.md5("text"), unused(docs, f"{name}_salt")
    k, row = unused(docs, f"{name}_k"), F.col("p")
    mentions = docs.where(F.col("text").rlike(DRAWN_HINT)).select(hashed.alias(k), F.explode(F.regexp_extract_all("text", F.lit(DRAWN), F.lit(0))).alias("m"))
    rows = mentions.select(k, parts_of(F.col("m")).alias("p")).where("p.kind = 'name'").select(k, given(row["entity"]).alias("w")).where("w IS NOT NULL").distinct()
    known = rows.join(mixed, "w").groupBy(k).agg(F.collect_list(F.struct("w", "g")).alias(name))  # names of one text
    known = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    dealt = docs.withColumn(k, hashed).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(p.salts)).cast("int"))
    return dealt.join(known, [k, salt], "left")


def pseudonymise(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """All columns of ``docs``, with the entities of ``text`` replaced."""
    found = cut(entities(docs))
    key, room = _settled(found, params)
    raw, genders = unused(docs, "pii_text"), unused(docs, "pii_genders")
    has = lambda g: F.array_contains("genders", g)
    mixed = found.where("size(genders) > 1").select(F.col("entity").alias("w"), F.when(has("m") & has("f"), "x").when(has("m"), "m").otherwise("f").alias("g"))
    if mixed.isEmpty():  # every mention's title says what all say
        out = docs.withColumn(raw, replaced(F.col("text"), F.lit(key), room))
    else:
        rows = _with_genders(docs, mixed, key, genders, params)
        none = F.array().cast("array<struct<w:string,g:string>>")
        out = rows.withColumn(raw, replaced(F.col("text"), F.lit(key), room, F.coalesce(F.col(genders), none)))
    return out.select(*[F.col(raw).alias(c) if c == "text" else F.col(c) for c in docs.columns])
