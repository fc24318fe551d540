"""Surrogates for personal data, in DataFrame functions only.

Every entity is replaced by a keyed stand-in of the same type and format. Numbers go through a keyed permutation of the
numbers with as many digits (a Feistel network) that moves every number, so different numbers stay different; addresses,
secrets and names get keyed hashes. The stand-ins of all distinct entities are then checked: no two share one and none is
another real entity. Entities that fail try again, and the few of them are joined back to the texts that hold them. Tables
that are written on the way hold keyed hashes only, never a value, and are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import Scratch, cut

ROUNDS = 4
#: Further stand-ins that an entity tries before it takes the one that can't fail.
ATTEMPTS = 24
SALTS = 16
#: Stands around entities while a text is taken apart; texts that hold it themselves are taken apart another way.
EDGE = ""

#: Words before a name, by the gender they tell.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Prof")
#: What else stands before a name.
CUES = ("[Mm]y name is", "[Nn]ame:", "[Cc]ontact:", "[Ss]igned by", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]e llamo", "[Мм]еня зовут")
#: Frequent given names, by gender.
GIRLS = ("Anna", "Maria", "Emma", "Olivia", "Sophia", "Julia", "Laura", "Sarah", "Elizabeth", "Jennifer", "Linda", "Mary", "Patricia", "Susan", "Karen", "Nancy", "Sabine", "Petra", "Monika", "Carmen", "Lucía", "Chloé", "Camille", "Ольга", "Наталья", "Елена", "Мария", "Ελένη")
BOYS = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Paul", "Hans", "Jürgen", "Wolfgang", "Carlos", "José", "Juan", "Pierre", "Jean", "Иван", "Сергей", "Дмитрий", "Алексей", "Γιώργος")
#: syllables' consonants and vowels, and endings of given names by gender, by script.
SCRIPTS = {"latin": ("bdfgklmnprstvzhj", "aeio"), "cyrillic": ("бдгклмнпрствзжфх", "аеио"), "greek": ("βδγκλμνπρστζθφχξ", "αειο")}
ENDINGS = {
    "latin": {"f": ("ina", "ella", "anna", "etta"), "m": ("bert", "win", "mund", "ric"), "n": ("el", "is", "in", "ey")},
    "cyrillic": {"f": ("ина", "елла", "ана", "ья"), "m": ("слав", "мир", "ор", "ей"), "n": ("ель", "ис", "ин", "и")},
    "greek": {"f": ("ινα", "ελλα", "αννα", "ια"), "m": ("ιος", "ωνας", "ανδρος", "ας"), "n": ("ελ", "ις", "ιν", "ι")},
}

TITLES = "|".join(FEMALE + MALE + NEUTRAL)
BEFORE = rf"(?:(?:{TITLES})\.? |(?:{'|'.join(CUES)}) )"
WORD = r"\p{Lu}[\p{L}'-]+"
#: Titles and given names are tried at capitals only.
NAME = rf"(?:(?=\p{{Lu}})(?:(?:{TITLES})\.? {WORD}(?: {WORD})?|(?:{'|'.join(GIRLS + BOYS)}) {WORD})|(?:{'|'.join(CUES)}) {WORD}(?: {WORD})?)"
#: At most 126 labels before the last, so that matching stays shallow whatever the text.
EMAIL = r"[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9])"
SECRET_WORD = r"(?:[Tt]oken|TOKEN|[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey)"
SECRET = SECRET_WORD + r"""\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9_+/.-]{7,}[A-Za-z0-9_+/=-]"""
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
GROUP = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}})(?![\p{{L}}\p{{N}}:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
#: What may begin after a phone number and is not its next group.
OTHER = rf"{IP}|{SSN}|{PHONE}|{EMAIL}|\d{{13,19}}(?!\d)|\d{{4}}(?: \d{{4}} \d{{4}} |-\d{{4}}-\d{{4}}-)\d{{1,7}}(?!\d|[ -]\d{{4}}(?!\d))"
#: Sixteen digits of one number, written out because a look-behind takes no nested repeats.
SIXTEEN = r"\d[ .()-]{0,3}" * 15 + r"\d"
#: Country code 1 has ten digits after it; others have groups up to 15 digits in all, none of which begins another entity.
PHONE_PLUS = rf"\+(?:1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?(?!{OTHER})\d{{2,4}}){{1,4}}(?<!{SIXTEEN}))(?!\d)"
#: Country codes, none of which begins another.
COUNTRY = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}"
PHONE_AREA = r"\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\d)"
#: First digits and lengths of payment cards.
ISSUER = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|(?:6011|64[4-9]\d|65\d\d)\d{12}|(?:352[89]|35[3-8]\d)\d{12,15}|62\d{14,17})$"
#: Order matters: the first that fits at a place counts. Words are tried at their start only, numbers only at a digit.
PATTERN = rf"(?<![\p{{L}}\p{{N}}._%+-]){EMAIL}|(?<![\p{{L}}\p{{N}}])(?:{SECRET}|{NAME})|{IBAN}|{IP6}|(?=\d)(?:{IP}|{SSN}|{PHONE}|{CARD})|{PHONE_PLUS}|{PHONE_AREA}"
#: What a text must hold to have an entity: cheap to tell, and most texts don't.
HINT = r"[0-9@=:]"
NUMBERS = ("ip", "ssn", "phone", "card")  # kinds whose stand-ins are permutations


def _hash(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that can't be told without the key."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts, F.lit(key)), 256)


def _let(value: Column, use: object) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _number(hexadecimal: Column, begin: int = 1) -> Column:
    return F.conv(F.substring(hexadecimal, begin, 15), 16, 10).cast("long")


def _feistel(key: str, salt: Column, pair: Column, many_left: Column, many_right: Column, forward: bool = True) -> Column:
    """A keyed permutation of pairs (l below many_left, r below many_right), or its inverse."""

    def step(acc: Column, i: Column) -> Column:
        def moved(x: Column, by: Column, many: Column) -> Column:
            n = F.pmod(_number(_hash(key, salt, i.cast("string"), by.cast("string"))), many)
            return F.pmod(x + n if forward else x - n + many, many)

        odd = i % 2 == 1
        return F.struct(F.when(odd, moved(acc["l"], acc["r"], many_left)).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(moved(acc["r"], acc["l"], many_right)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)) if forward else F.sequence(F.lit(ROUNDS), F.lit(1)), pair, step)


def _moved(key: str, salt: Column, left: Column, right: Column, many_left: Column, many_right: Column) -> Column:
    """A keyed permutation of pairs without fixed points: one step on a ring in keyed order."""

    def next_one(p: Column) -> Column:
        last = p["r"] == many_right - 1
        return F.struct(F.when(last, F.pmod(p["l"] + 1, many_left)).otherwise(p["l"]).alias("l"), F.when(last, F.lit(0).cast("long")).otherwise(p["r"] + 1).alias("r"))

    onward = _feistel(key, salt, F.struct(left.alias("l"), right.alias("r")), many_left, many_right)
    return _let(_let(onward, next_one), lambda p: _feistel(key, salt, p, many_left, many_right, False))


def _digits(key: str, salt: Column, digits: Column) -> Column:
    """A keyed permutation without fixed points of the digit strings of each length from 1 to 30."""
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def moved(d: Column) -> Column:
        n, a = F.length(d["all"]), F.length(d["begin"])
        out = _moved(key, F.concat_ws("/", salt, n.cast("string")), F.coalesce(F.nullif(d["begin"], F.lit("")).cast("long"), F.lit(0).cast("long")), F.substring(d["all"], a + 1, n).cast("long"), power(a), power(n - a))
        return _let(out, lambda o: F.concat(F.when(a > 0, F.lpad(o["l"].cast("string"), a, "0")).otherwise(F.lit("")), F.lpad(o["r"].cast("string"), n - a, "0")))

    return _let(digits, lambda all_: _let(F.struct(all_.alias("all"), F.substring(all_, F.lit(1), F.floor(F.length(all_) / 2).cast("int")).alias("begin")), moved))


def _luhn(digits: Column) -> Column:
    """The check digit that would follow these digits."""
    chars = F.reverse(F.split(digits, "(?!^)(?=.)"))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda x, y: x + y) % 10) % 10


def _is_card(digits: Column) -> Column:
    n = F.length(digits)
    return digits.rlike(ISSUER) & (_luhn(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1)).cast("int"))


def _mod97(text: Column) -> Column:
    """Digits and letters (A = 10 to Z = 35) as one number, modulo 97."""
    return F.aggregate(F.split(text, "(?!^)(?=.)"), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _is_iban(iban: Column) -> Column:
    return _mod97(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))) == 1


def _whole_ip6(address: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, whatever its notation."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    filled = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
    sides = F.split(F.lower(address), "::", 2)
    left, right = groups(sides[0]), F.when(F.size(sides) > 1, groups(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(filled(left), F.repeat(F.lit("0"), 32 - 4 * F.size(left) - 4 * F.size(right)), filled(right))


def _word(hexadecimal: Column, syllables: Column, consonants: Column, vowels: Column) -> Column:
    """A made-up word: each syllable takes six bits of the hash."""
    syllable = lambda i: _let(F.conv(F.substring(hexadecimal, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), lambda n: F.concat(F.substring(consonants, n % 16 + 1, F.lit(1)), F.substring(vowels, F.floor(n / 16).cast("int") % 4 + 1, F.lit(1))))
    return F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), syllable), "")


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike("^" + SECRET_WORD + r"\s*[=:]"), "secret").when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(m.rlike("^[0-9A-Fa-f:]+$") & m.contains(":"), "ip6").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), "phone").when(m.rlike(r"^[A-Z]{2}\d\d"), "iban").when(m.rlike(r"^\d"), "card").otherwise("name")
    )


def _entities(m: Column) -> Column:
    """The entities of a match as structs kind, value, none if its check digits say that it isn't one.

    A name has one a word, so that a person's surname stays the same everywhere; an email has one for its domain and one for
    the whole address.
    """
    digits = F.regexp_replace(m, r"\D", "")
    pair = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("value"))
    one = lambda k, v: F.array(pair(k, v))
    title = F.regexp_extract(m, rf"^({TITLES})\.? ", 1)
    words = F.split(F.regexp_replace(m, "^" + BEFORE, ""), " ")
    given = words[0]
    gender = F.when(title.isin(*FEMALE) | given.isin(*GIRLS), "f").when(title.isin(*MALE) | given.isin(*BOYS), "m").otherwise("n")
    script = lambda w: F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    is_given = lambda i: (i == 0) & ((F.size(words) == 2) | (title == ""))
    named = F.transform(words, lambda w, i: pair(F.concat(F.when(is_given(i), F.concat(F.lit("given-"), gender)).otherwise("family"), F.lit("-"), script(w)), F.lower(w)))
    ip = F.aggregate(F.split(m, "\\."), F.lit(0).cast("long"), lambda x, o: x * 256 + o.cast("long"))
    iban = F.regexp_replace(m, " ", "")
    # All after the country code and a (0), and ten digits at least, so that a number is the same with and without its code.
    before = F.length(F.regexp_extract(m, rf"^\+({COUNTRY})", 1)) + F.when(m.rlike(r"^\+\d{1,3}[ .-]?\(0\)"), 1).otherwise(0)
    national = F.greatest(F.length(digits) - before, F.least(F.length(digits), F.lit(10)))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return _let(
        _kind(m),
        lambda kind: (
            F.when(kind == "email", F.array(pair("domain", F.lower(F.regexp_extract(m, "@(.*)$", 1))), pair("email", F.lower(m))))
            .when(kind == "secret", one(kind, F.regexp_extract(m, r"""[=:]\s*["']?(.*)$""", 1)))
            .when(kind == "ip", one(kind, ip.cast("string")))
            .when(kind == "ip6", one(kind, _whole_ip6(m)))
            .when(kind == "phone", one(kind, F.right(digits, national)))
            .when(kind == "ssn", one(kind, digits))
            .when(kind == "card", F.when(_is_card(digits), one(kind, digits)).otherwise(none))
            .when(kind == "iban", F.when(_is_iban(iban), one(kind, iban)).otherwise(none))
            .otherwise(named)
        ),
    )


def _stand_in(key: str, entity: Column, attempt: Column) -> Column:
    """The entity's stand-in, as a value of its kind. After the last attempt hashed kinds get longer ones that can't be shared."""
    kind, value = entity["kind"], entity["value"]
    salt = F.concat_ws("/", kind, attempt.cast("string"))
    n = F.length(value)
    # Of a card the first digits tell the network and stay; the last keeps the number valid. An IPv4 address is a pair of halves.
    network = F.when(value.startswith("4"), 1).otherwise(2)
    issuer = F.when(kind == "card", F.substring(value, F.lit(1), network)).otherwise(F.lit(""))
    inner = F.when(kind == "card", F.substring(value, network + 1, n - network - 1)).otherwise(value)
    digits = _digits(key, F.concat_ws("/", salt, issuer), inner)
    number = _let(F.concat(issuer, digits), lambda d: F.when(kind == "card", F.concat(d, _luhn(d).cast("string"))).otherwise(d))
    half = F.lit(65536).cast("long")
    ip = _let(value.cast("long"), lambda v: _let(_moved(key, salt, F.shiftright(v, 16), v.bitwiseAND(F.lit(65535)), half, half), lambda o: (o["l"] * 65536 + o["r"]).cast("string")))

    def hashed(h: Column) -> Column:
        long = attempt > ATTEMPTS
        wide = F.repeat(h, F.ceil(n / 64).cast("int"))
        mixed = F.regexp_replace(F.base64(F.unhex(F.repeat(h, F.ceil(n / 40).cast("int")))), "[+/=\\s]", "x")
        secret = F.substring(F.when(value.rlike("^[0-9a-f]+$"), wide).when(value.rlike("^[0-9A-F]+$"), F.upper(wide)).otherwise(mixed), F.lit(1), F.when(long, F.greatest(n, F.lit(64))).otherwise(n))
        at = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        body = F.array_join(F.transform(F.split(F.substring(value, F.lit(5), n), "(?!^)(?=.)"), lambda c, i: _let(at(i), lambda x: F.when(c.rlike("[0-9]"), (x % 10).cast("string")).otherwise(F.char(x % 26 + 65)))), "")
        country = F.substring(value, 1, 2)
        iban = _let(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        script = F.when(kind.endswith("-cyrillic"), "cyrillic").when(kind.endswith("-greek"), "greek").otherwise("latin")
        of_script = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), script)
        many = F.when(long, 28).when(kind == "email", 8).when(kind.startswith("given"), 5).otherwise(6)
        word = _word(h, many, of_script({k: v[0] for k, v in SCRIPTS.items()}), of_script({k: v[1] for k, v in SCRIPTS.items()}))
        last = F.conv(F.substring(h, 64, 1), 16, 10).cast("int") % 4
        ending = F.element_at(F.create_map(*[x for sc, by in ENDINGS.items() for who, ends in by.items() for x in (F.lit(f"given-{who}-{sc}"), F.array(*map(F.lit, ends)))]), kind)
        end = F.when(kind == "domain", ".example").when(kind.startswith("given"), F.get(ending, last)).otherwise("")
        return F.when(kind == "secret", secret).when(kind == "ip6", F.substring(h, 1, 32)).when(kind == "iban", iban).otherwise(F.concat(word, end))

    return F.when(kind.isin("ssn", "phone", "card"), number).when(kind == "ip", ip).otherwise(_let(_hash(key, salt, value), hashed))


def _fill(form: Column, digits: Column, what: str = "[0-9]") -> Column:
    """The form with its digits (or other characters) replaced in turn; if there are fewer new ones, the first stay."""
    skip = F.length(F.regexp_replace(form, what.replace("[", "[^"), "")) - F.length(digits)

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike(what)
        i = acc["i"] + F.when(digit, 1).otherwise(0)
        return F.struct(F.concat(acc["out"], F.when(digit & (i > skip), F.substring(digits, (i - skip).cast("int"), F.lit(1))).otherwise(c)).alias("out"), i.cast("int").alias("i"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    return F.aggregate(F.split(form, "(?!^)(?=.)"), start, step)["out"]


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).otherwise(F.initcap(word))


def _render(m: Column, values: Column) -> Column:
    """The match with its entities' stand-ins in its own format; a match without entities stays."""
    first = values[0]
    dotted = _let(first.cast("long"), lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))
    before = F.regexp_extract(m, "^" + BEFORE, 0)
    words = F.split(F.regexp_replace(m, "^" + BEFORE, ""), " ")
    groups = F.regexp_replace(first, "(.{4})(?!$)", "$1:")
    return _let(
        _kind(m),
        lambda kind: (
            F.when(F.size(values) == 0, m)
            .when(kind == "email", F.concat(F.get(values, F.lit(1)), F.lit("@"), first))
            .when(kind == "secret", F.concat(F.regexp_extract(m, r"""^[^=:]*[=:]\s*["']?""", 0), first))
            .when(kind == "ip", dotted)
            .when(kind == "ip6", F.when(F.upper(m) == m, F.upper(groups)).otherwise(groups))
            .when(kind == "iban", _fill(m, first, "[A-Z0-9]"))
            .when(kind.isin("ssn", "phone", "card"), _fill(m, first))
            .otherwise(F.concat(before, F.array_join(F.zip_with(values, words, _cased), " ")))
        ),
    )


def pieces(text: Column) -> Column:
    """The text as an array in whose odd places (from 0) the matches are; one element where nothing matches, null for null. The patterns run once."""
    some = text.rlike(HINT) | text.rlike(rf"(?<![\p{{L}}\p{{N}}]){NAME}")
    once = F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(f"{EDGE}$0{EDGE}")), EDGE, -1)
    twice = F.flatten(F.zip_with(F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda p, m: F.when(m.isNull(), F.array(p)).otherwise(F.array(p, m))))
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(~some, F.array(text)).when(text.contains(EDGE), twice).otherwise(once)


def matches(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def entity_table(docs: DataFrame) -> DataFrame:
    """Every distinct entity of the texts: kind, value."""
    parts = docs.select(pieces(F.col("text")).alias("p")).filter("size(p) > 1")
    return parts.select(F.explode(F.array_distinct(matches(F.col("p")))).alias("m")).distinct().select(F.explode(_entities(F.col("m"))).alias("e")).select("e.kind", "e.value").distinct()


def identity(key: str, kind: Column, value: Column) -> Column:
    """What tables hold instead of a value."""
    return F.unhex(_hash(key, F.lit("id"), kind, value))


def attempts_needed(entities: DataFrame, key: str) -> DataFrame:
    """kind, id, attempt of the entities (kind, value) whose first stand-in won't do; ids are keyed hashes.

    Taken are all real values and all first stand-ins. Of those that share a first stand-in all but one try others, as do
    those whose stand-in is a real value; each takes the first of 24 that is free. Where none is, numbers go back to their
    first one, which no other entity has (it is some real number then: so many exist that hardly one is free), and other
    kinds get a longer one.
    """
    spark = entities.sparkSession
    named = entities.withColumn("id", identity(key, F.col("kind"), F.col("value")))
    to = lambda attempt: identity(key, F.col("kind"), _stand_in(key, F.struct("kind", "value"), attempt))
    with Scratch(spark) as scratch:
        first = scratch.cut(named.select("kind", "id", to(F.lit(0)).alias("to")))
        shared = first.groupBy("kind", "to").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
        real = first.select("kind", F.col("id").alias("to"))
        lost = first.join(shared, ["kind", "to"]).filter("id <> first").select("kind", "id").union(first.join(real, ["kind", "to"], "left_semi").select("kind", "id"))
        open_ = scratch.cut(lost.distinct())
        done = open_.filter("false").withColumn("attempt", F.lit(0))
        if open_.isEmpty():
            return spark.createDataFrame([], done.schema)
        others = named.join(open_, ["kind", "id"], "left_semi").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))))
        others = scratch.cut(others.select("kind", "id", "attempt", to(F.col("attempt")).alias("to")))
        taken = real.union(first.select("kind", "to"))
        for attempt in range(1, ATTEMPTS + 1):
            free = others.filter(F.col("attempt") == attempt).join(open_, ["kind", "id"], "left_semi").join(taken, ["kind", "to"], "left_anti")
            won = scratch.cut(free.groupBy("kind", "to").agg(F.min("id").alias("id")))
            taken, done = taken.union(won.select("kind", "to")), done.union(won.select("kind", "id", F.lit(attempt)))
            open_ = scratch.cut(open_.join(won, ["kind", "id"], "left_anti"))
            if open_.isEmpty():
                break
        return cut(done.union(open_.filter(~F.col("kind").isin(*NUMBERS)).select("kind", "id", F.lit(ATTEMPTS + 1))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with stand-ins in `text`, and `n_entities`; an input column of that name is replaced.

    Emails, secrets after a word such as token or password, IPv4 and IPv6 addresses, IBANs and card numbers with right check
    digits, social security and phone numbers, and names after a title, after words such as "my name is" or beginning with a
    frequent given name are replaced. The same entity gets the same stand-in everywhere (emails in any case, addresses and
    phone numbers in any format, persons by word), different ones get different ones. Letter case, separators, number of
    digits, check sums, card network, title, gender and script are kept. Null texts stay null, texts without entities stay as
    they are, repeated rows stay alike. An empty table gives an empty one. ValueError without a key.

    Texts may be of any length: no pattern goes deeper than a fixed number of steps.
    """
    if not key:
        raise ValueError("stand-ins need a secret key")
    again = attempts_needed(entity_table(docs), key)
    split = docs.drop("n_entities").withColumn("__p", pieces(F.col("text")))
    if again.isEmpty():
        tried = lambda e: F.lit(0)
    else:
        ids = F.array_distinct(F.flatten(F.transform(matches(F.col("__p")), lambda m: F.transform(_entities(m), lambda e: identity(key, e["kind"], e["value"])))))
        own = split.filter("size(__p) > 1").select(F.md5("text").alias("__key"), F.explode(ids).alias("id")).distinct()
        tries = own.join(again, "id").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct(F.base64("id"), "attempt"))).alias("__tries"))
        # A text may fill a third of all rows: its rows meet copies of the few entries in several tasks.
        tries = tries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = split.withColumn("__key", F.md5("text")).withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        split = salted.join(tries, ["__key", "__salt"], "left").drop("__key", "__salt")
        tried = lambda e: F.coalesce(F.element_at("__tries", F.base64(identity(key, e["kind"], e["value"]))), F.lit(0))

    def rendered(m: Column) -> Column:
        """out, hit: the match with its stand-ins, and whether it holds an entity."""

        def of(entities: Column) -> Column:
            tried_as = F.transform(entities, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), tried(e).alias("attempt")))
            stand_ins = F.transform(tried_as, lambda e: _stand_in(key, e, e["attempt"]))
            return F.struct(_let(stand_ins, lambda v: _render(m, v)).alias("out"), (F.size(entities) > 0).alias("hit"))

        return _let(_entities(m), of)

    plain = lambda p: F.struct(p.alias("out"), F.lit(False).alias("hit"))
    done = F.when(F.size("__p") > 1, F.transform("__p", lambda p, i: F.when(i % 2 == 1, rendered(p)).otherwise(plain(p))))
    out = split.withColumn("__done", done).withColumn("text", F.when(F.col("__done").isNull(), F.col("text")).otherwise(F.array_join("__done.out", ""))).withColumn("n_entities", F.when(F.col("__done").isNull(), 0).otherwise(F.size(F.filter("__done.hit", lambda x: x))))
    return out.select(*[c for c in docs.columns if c != "n_entities"], "n_entities")
