"""Surrogates for personal data: keyed, type-consistent replacements that keep format, script and gender.

Everything is DataFrame functions. A text is split at its entities, each entity gets its surrogate by a keyed hash, and
the parts are joined again. The same entity gets the same surrogate everywhere. Of a name, the surname and the given
names have surrogates of their own, and both are looked for in the rest of the text too, where no title precedes them. A
pass over all distinct entities finds surrogates that two entities would share, or that another entity is written like,
and salts them anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampline.llm.common import stage

# Titles that a name follows, by the gender that they tell, and how entities are written.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madame", "Mme", "Mlle", "Frau", "Señora", "Sra", "Lady", "Госпожа", "Κυρία"],
    "m": ["Mr", "Monsieur", "Herr", "Señor", "Sr", "Lord", "Господин", "Κύριος"],
    "": ["Dr", "Prof", "Professor", "Doctor"],
}
# Characters of an IBAN by country.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xoxb-", "xoxp-"]
_TITLE = "|".join(sorted((t for g in TITLES.values() for t in g), key=lambda t: -len(t)))
_CAP = rf"(?!(?:{_TITLE})\b)\p{{Lu}}[\p{{L}}\p{{M}}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_COUNTRIES = "|".join(f"(?:{'|'.join(c for c in IBAN if IBAN[c] == n)})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in sorted(set(IBAN.values()), reverse=True))
#: What names a secret, before it.
KEYED = r"(?i:token|secret|passwd|password|pwd|api_key|apikey|api-key) {0,2}[=:] {0,2}[\"']?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,24}",
    "secret": r"(?=[A-Z])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?=[gsx])(?:ghp_|gho_|sk_live_|xox[bp]-)[A-Za-z0-9_-]{16,}+(?:[.+/]{1,2}[A-Za-z0-9_-]++)*+={0,2}+"
    rf"|(?<=[=: \"'])(?=[A-Za-z0-9+/_-](?:\.{{0,2}}[A-Za-z0-9+/_-]){{7}})(?<={KEYED})[A-Za-z0-9+/_-]++(?:\.{{1,2}}[A-Za-z0-9+/_-]++)*+={{0,2}}+",
    "ip": rf"(?=\d)(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ip6": rf"(?=[0-9A-Fa-f]{{1,4}}:)(?<!:)(?:{_HEX}(?::{_HEX}){{7}}|(?=[0-9A-Fa-f:]{{0,39}}\d)(?:{_HEX}(?::{_HEX}){{1,5}}|[0-9A-Fa-f]{{3,4}})::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:])",
    "iban": rf"(?=[A-Z]{{2}}\d{{2}})(?:{_COUNTRIES})(?![A-Za-z0-9])",
    "ssn": r"(?=\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<!\d[.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])|(?<!\d[ .-])0\d{9,10}(?![ .-]?\d))",
    # a stretch of digits up to where an ssn or phone begins; cards are looked for inside
    "card": r"(?=\d)(?<!\d\.)\d(?:(?:[ -](?!(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d-])|(?<!\d-)\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])))?\d){12,}+",
    "name": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{_TITLE})\.? ){_CAP}(?: {_CAP}){{0,2}}",
}
#: How cards are grouped inside a longer stretch of digits; a stretch of 13 to 19 may be one in any grouping.
CARD = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})$"
# How the numbers of card issuers begin, and how long they are.
ISSUED = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}|6(?:011|22|4[4-9]|5)\d{12,16})$"
#: Entities begin where no letter or digit of ASCII precedes.
ENTITY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Entities in what looked like an IBAN and is none.
REST = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "iban") + ")"


def _hint(t: Column) -> Column:
    """False only for texts without an entity; much cheaper than the whole pattern."""
    return t.rlike("[0-9@=:]") | _titled(t) | _any(t, PREFIXES)


def _any(t: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for w in parts:
        out = out | t.contains(w)
    return out


def _titled(t: Column) -> Column:
    return _any(t, [x for g in TITLES.values() for x in g])


ENDS = {g: "(?<!\\p{L})(?:" + "|".join(t) + r")\.? $" for g, t in TITLES.items()}
#: Letters of the surrogates' names: consonants and vowels of each script.
LETTERS = {"latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστφ", "αειου")}
SOUND = {"f": {"latin": "a", "cyrillic": "а", "greek": "α"}, "m": {"latin": "o", "cyrillic": "н", "greek": "ς"}}


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Sum of a digit string's Luhn weights, its last digit not doubled."""
    n = F.length(d)

    def add(acc, i):
        v = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return acc + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(t: Column) -> Column:
    d = _digits(t)
    return d.rlike(ISSUED) & (_luhn(d) % 10 == 0)


def _mod97(e: Column) -> Column:
    """Rest by 97 of an IBAN whose first four characters stand last, its letters as numbers from 10 on."""
    e = F.replace(e, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(e, F.lit(5), F.length(e)), F.substring(e, 1, 4))

    def add(acc, c):
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), add)


_DIGITS = r"^\d(?:[ -]?\d){12,}+$"


def kind(e: Column, before: Column) -> Column:
    """Type of a matched entity that stands behind `before`; null for numbers that fail their checks and so stay."""
    full = {k: f"^(?:{p})$" for k, p in PATTERNS.items() if k in ("ip", "ip6", "ssn", "phone", "iban")}
    return (
        F.when(e.contains("@"), "email")
        .when(before.rlike(KEYED + "$") | e.rlike(f"^(?:{'|'.join(PREFIXES)})"), "secret")
        .when(e.rlike(full["ip"]), "ip")
        .when(e.rlike(full["ip6"]), "ip6")
        .when(e.rlike(full["iban"]), F.when(_mod97(e) == 1, "iban"))
        .when(e.rlike(full["ssn"]), "ssn")
        .when(e.rlike(full["phone"]), "phone")
        .when(e.rlike(_DIGITS), F.when(_card(e), "card"))
        .when(e.rlike(rf"^{_CAP}(?: {_CAP})*$"), "name")
        .otherwise("secret")
    )


def pieces(e: Column, before: Column) -> Column:
    """(e, rest) of a match as it is, or of digits or capitals that are no card or IBAN: what is found in them and, as rest,
    what stands between."""
    as_is = F.array(F.struct(e.alias("e"), F.lit(False).alias("rest")))
    joined = lambda w, i, m, rest: F.struct(F.array_join(F.slice(w, i, m), "").alias("e"), F.lit(rest).alias("rest"))
    piece = lambda t, rest: F.struct(t.alias("e"), F.lit(rest).alias("rest"))
    none = kind(e, before).isNull()
    stretch = none & e.rlike(_DIGITS)
    between, inner = F.split(e, REST, -1), F.regexp_extract_all(e, F.lit(REST), F.lit(0))
    again = F.flatten(F.zip_with(between, inner, lambda a, b: F.when(b.isNull(), F.array(piece(a, True))).otherwise(F.array(piece(a, True), piece(b, False)))))
    bits = F.regexp_extract_all(e, F.lit("[0-9]+|[ -]"), F.lit(0))

    def chosen(w: Column) -> Column:
        n = F.size(w)
        text = lambda i, m: F.array_join(F.slice(w, i, m), "")
        # of one, three, four or five groups, the longest that is a card; bits are groups and what parts them in turn
        first = lambda i: F.coalesce(*[F.when((i + m - 1 <= n) & text(i, F.lit(m)).rlike(CARD) & _card(text(i, F.lit(m))), m) for m in (9, 7, 5, 1)], F.lit(0))
        none = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<i:int,m:int>>").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            more = F.struct((x["i"] + x["m"]).alias("next"), F.array_append(acc["found"], x).alias("found"))
            return F.when((x["m"] > 0) & (x["i"] >= acc["next"]), more).otherwise(acc)

        # windows are tried at each group, then taken from the left where they don't overlap
        windows = F.filter(F.transform(F.sequence(F.lit(1), n, F.lit(2)), lambda i: F.struct(i.alias("i"), first(i).alias("m"))), lambda x: x["m"] > 0)
        return F.aggregate(windows, none, step, lambda acc: acc["found"])

    def parted(w: Column, found: Column) -> Column:
        end = lambda x: x["i"] + x["m"]
        before = lambda i: F.when(i == 0, 1).otherwise(end(F.get(found, i - 1)))
        both = lambda x, i: F.array(joined(w, before(i), x["i"] - before(i), True), joined(w, x["i"], x["m"], False))
        last = end(F.element_at(found, -1))
        return F.concat(F.flatten(F.transform(found, both)), F.array(joined(w, last, F.size(w) - last + 1, True)))

    one = lambda w: F.transform(F.array(chosen(w)), lambda found: F.when(F.size(found) > 0, parted(w, found)).otherwise(as_is))
    return F.when(stretch, F.get(F.flatten(F.transform(F.array(bits), one)), F.lit(0))).when(none, again).otherwise(as_is)


def _number(h: Column, i: Column, n: int) -> Column:
    """A number below n: four hexadecimal digits of the keyed hash h, chosen by place."""
    return (F.conv(F.substring(h, i % 64 * 4 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at + 1, F.lit(1))


def _like(h: Column, e: Column, hexa: Column) -> Column:
    """Each digit by a digit and each Latin letter by one of its case (of a-f where hexa); other characters stay."""
    small, big = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(c, i):
        at = lambda n: F.when(hexa, _number(h, i, 6)).otherwise(_number(h, i, n))
        return F.when(c.rlike("[0-9]"), _pick("0123456789", _number(h, i, 10))).when(c.rlike("[a-z]"), _pick(small, at(26))).when(c.rlike("[A-Z]"), _pick(big, at(26))).otherwise(c)

    return F.array_join(F.transform(F.split(e, "(?!^)(?!$)"), one), "")


def normal(e: Column, k: Column) -> Column:
    """What makes two writings one entity: its digits, or its letters without case (secrets: as written)."""
    return F.when(k.isin("card", "ssn", "phone"), _digits(e)).when(k == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(k == "secret", e).otherwise(F.lower(e))


def _tokens(e: Column) -> Column:
    return F.split(e, " ")


def _part(i: Column, n: Column) -> Column:
    """Which part of a name its i-th of n words is."""
    return F.when(i == n - 1, "surname").otherwise("given")


def _seed(key: str, k: Column, norm: Column, g: Column, salt: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(key), k, norm, F.when(k == "given", g).otherwise(""), salt.cast("string"))


def add_surrogates(df: DataFrame, col: str, key: str) -> DataFrame:
    """Add a field s, the surrogate, to the structs (e, k, g, salt) of the array column col.

    k may also be given or surname, for one word of a name; g matters for given names only ("f", "m" or ""). salt has a
    number for each word of a name, else one; all 0 unless there was a collision. Works off one step at a time, so that
    each intermediate value is computed once.
    """

    def step(df: DataFrame, **new) -> DataFrame:
        return df.withColumn(col, F.transform(col, lambda x: F.struct(*[x[n].alias(n) for n in fields], *[f(x).alias(n) for n, f in new.items()])))

    fields = ["e", "k", "g", "salt"]
    df = step(df, seed=lambda x: _seed(key, x["k"], normal(x["e"], x["k"]), x["g"], F.get(x["salt"], F.lit(0))))
    fields.append("seed")
    df = step(df, h=lambda x: F.when(~x["k"].isin("name", "given", "surname"), F.concat(*[F.sha2(F.concat(x["seed"], F.lit(f"\x1f{i}")).cast("binary"), 256) for i in range(4)])), d=lambda x: _digits(x["e"]))
    fields += ["h", "d"]
    numbered = lambda x: x["k"].isin("card", "phone", "ssn")

    def drawn(x):
        e, d, h = x["e"], x["d"], x["h"]
        code = F.regexp_extract(e, r"^\+(\d{1,3})[ .(-]", 1)  # a country code stays
        kept = F.when((x["k"] == "phone") & (code != ""), F.length(code)).otherwise(1)
        # numbers of three, three and four digits begin both their first groups with 2 to 9
        us = F.when((x["k"] == "phone") & e.rlike(r"^(?:\+1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$"), F.length(d) - 10).otherwise(-9)

        def one(c, i):
            return F.when((i == us) | (i == us + 3), _pick("23456789", _number(h, i, 8))).when(i < kept, c).otherwise(_pick("0123456789", _number(h, i, 10)))

        return F.when(d != "", F.array_join(F.transform(F.split(d, "(?!^)(?!$)"), one), "")).otherwise("")

    df = step(df, n=lambda x: F.when(numbered(x), drawn(x)))
    fields.append("n")
    df = step(df, base=lambda x: F.when(x["k"] == "card", F.concat(F.substring(x["n"], F.lit(1), F.length(x["n"]) - 1), F.lit("0"))))
    fields.append("base")
    checked = lambda x: F.concat(F.substring(x["base"], F.lit(1), F.length(x["base"]) - 1), ((10 - _luhn(x["base"]) % 10) % 10).cast("string"))
    df = step(df, number=lambda x: F.when(x["k"] == "card", checked(x)).otherwise(x["n"]))
    fields.append("number")
    # an IBAN's account, to which check digits are worked out
    df = step(df, account=lambda x: F.when(x["k"] == "iban", _like(x["h"], F.substring(x["e"], F.lit(5), F.length(x["e"])), F.lit(False))))
    fields.append("account")

    def made(x):
        e, h, k = x["e"], x["h"], x["k"]
        plain = F.lit(False)
        domain = F.concat(F.lit("mail"), _number(h, F.lit(62), 10000).cast("string"), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _number(h, F.lit(63), 3) + 1))
        email = F.concat(_like(h, F.substring_index(e, "@", 1), plain), F.lit("@"), domain)
        # private addresses stay private; others get a first part from 11 to 126
        first = F.when(e.startswith("10."), F.lit("10")).otherwise((_number(h, F.lit(3), 116) + 11).cast("string"))
        ip = F.concat_ws(".", first, *[_number(h, F.lit(i), 256).cast("string") for i in range(3)])
        # digits keep their places between the other characters
        gaps = F.split(e, "[0-9]", -1)
        spread = F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.substring(x["number"], i + 1, F.lit(1)), F.lit("")))), "")
        prefix = F.regexp_extract(e, "^(AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-)?", 0)
        secret = F.concat(prefix, _like(h, F.substring(e, F.length(prefix) + 1, F.length(e)), e.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")))
        check = F.lpad((98 - _mod97(F.concat(F.substring(e, 1, 2), F.lit("00"), x["account"]))).cast("string"), 2, "0")
        iban = F.concat(F.substring(e, 1, 2), check, x["account"])
        words = F.transform(_tokens(e), lambda t, i: _invented(key, t, _part(i, F.size(_tokens(e))), x["g"], F.coalesce(F.get(x["salt"], i), F.lit(0))))
        return (
            F.when(k == "email", email).when(k == "ip", ip).when(k == "ip6", _like(h, e, F.lit(True))).when(numbered(x), spread).when(k == "iban", iban).when(k == "secret", secret)
            .when(k == "name", F.array_join(words, " ")).when(k.isin("given", "surname"), _invented(key, e, k, x["g"], F.get(x["salt"], F.lit(0))))
        )

    return step(df, s=made)


def _invented(key: str, t: Column, part: Column, g: Column, salt: Column) -> Column:
    """An invented word of the same script and case for a word of a name; a given name's ending tells the gender. More
    syllables with each salting, so that there is room for any number of names."""
    h = F.sha2(_seed(key, part, F.lower(t), g, salt).cast("binary"), 256)

    def script(name: str) -> Column:
        c, v = LETTERS[name]
        number = lambda i, n: (F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")
        syllables = F.transform(F.sequence(F.lit(0), F.least(2 + salt, F.lit(7))), lambda j: F.concat(_pick(c, number(2 * j, len(c))), _pick(v, number(2 * j + 1, len(v)))))
        end = F.when((part == "given") & (g == "f"), SOUND["f"][name]).when((part == "given") & (g == "m"), SOUND["m"][name]).otherwise("")
        word = F.initcap(F.concat(F.array_join(syllables, ""), end))
        return F.when(t == F.upper(t), F.upper(word)).otherwise(word)

    return F.when(t.rlike(r"\p{IsCyrillic}"), script("cyrillic")).when(t.rlike(r"\p{IsGreek}"), script("greek")).otherwise(script("latin"))


NAMES = "array<struct<e:string,g:string>>"


def _gender(before: Column) -> Column:
    """The gender that a title at the end tells; null without a title."""
    return F.when(before.rlike(ENDS["f"]), "f").when(before.rlike(ENDS["m"]), "m").when(before.rlike(ENDS[""]), "")


def _last(t: Column) -> Column:
    return F.substring(t, -24, 24)


def find_entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add __s (text between entities) and __e: (entity, type or null, gender) of each match, in order.

    Names are those that follow a title; their surnames of three letters or more, alone or behind given names of the same
    text, are found again wherever they stand in it as whole words.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    name = f"(?<![A-Za-z0-9])(?:{PATTERNS['name']})"
    parts = F.split(t, name, -1)
    titled = F.transform(F.regexp_extract_all(t, F.lit(name), F.lit(0)), lambda e, i: F.struct(e.alias("e"), _gender(_last(F.get(parts, i))).alias("g")))
    df = df.withColumn("__hint", _hint(t)).withColumn("__names", F.when(F.col("__hint") & _titled(t), titled).otherwise(F.expr(f"cast(array() as {NAMES})")))
    words = F.transform("__names", lambda x: _tokens(x["e"]))
    surnames = F.array_distinct(F.filter(F.transform(words, lambda w: F.element_at(w, -1)), lambda w: F.length(w) > 2))
    given = F.array_distinct(F.flatten(F.transform(words, lambda w: F.slice(w, 1, F.size(w) - 1))))
    either = lambda a: F.array_join(F.transform(F.array_sort(a, lambda x, y: F.length(y) - F.length(x)), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    again = F.concat(F.lit(ENTITY + r"|(?=\p{Lu})(?<![\p{L}\p{N}])"), F.when(F.size(given) > 0, F.concat(F.lit("(?:(?:"), either(given), F.lit(") )*"))).otherwise(""), F.lit("(?:"), either(surnames), F.lit(r")(?![\p{L}\p{N}])"))
    df = df.withColumn("__again", F.when(F.size(surnames) > 0, again))
    hint, more = F.col("__hint"), F.col("__again").isNotNull()
    cut = df.withColumn("__s", F.when(more, F.split(t, F.col("__again"), -1)).when(hint, F.split(t, ENTITY, -1)).otherwise(F.array(t)))
    cut = cut.withColumn("__m", F.when(more, F.regexp_extract_all(t, F.col("__again"), F.lit(0))).when(hint, F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # a match of several pieces gets empty texts between them
    cut = cut.withColumn("__m", F.transform("__m", lambda e, i: pieces(e, _last(F.get("__s", i)))))
    cut = cut.withColumn("__s", F.flatten(F.zip_with("__s", "__m", lambda s, m: F.concat(F.array(s), F.array_repeat(F.lit(""), F.coalesce(F.size(m), F.lit(1)) - 1)))))
    cut = cut.withColumn("__m", F.flatten("__m"))
    known = lambda e: F.get(F.filter("__names", lambda x: F.array_contains(_tokens(x["e"]), F.get(_tokens(e), F.lit(0)))), F.lit(0))["g"]

    def told(e, i):
        before = _last(F.get("__s", i))
        return F.struct(e["e"].alias("e"), F.when(~e["rest"], kind(e["e"], before)).alias("k"), F.coalesce(_gender(before), known(e["e"]), F.lit("")).alias("g"))

    return cut.withColumn("__e", F.transform("__m", told)).drop("__m", "__hint", "__names", "__again")


def _units(x: Column) -> Column:
    """What of an entity has a surrogate of its own: (k, norm, g, e) of it, or of each word of a name."""
    words = _tokens(x["e"])
    one = lambda k, e, g: F.struct(k.alias("k"), normal(e, k).alias("norm"), F.when(k == "given", g).otherwise("").alias("g"), e.alias("e"))
    return F.when(x["k"] == "name", F.transform(words, lambda w, i: one(_part(i, F.size(words)), w, x["g"]))).otherwise(F.array(one(x["k"], x["e"], x["g"])))


def collisions(df: DataFrame, key: str, text_col: str = "text", rounds: int = 24) -> DataFrame:
    """(k, norm, g, salt) of entities whose surrogate is not theirs alone under salt 0, with the salt to use instead.

    Compares all distinct entities (of names, the words): no two of a type may share a surrogate, and no surrogate may be
    written like a real entity. Only entities that collide go on to the next round, in which they must miss the surrogates
    that stay as well; the last round must find none, else it raises.
    """
    # outer: for an inner explode the optimizer would test the arrays' sizes below, working everything out once more
    each = find_entities(df.select(F.col(text_col).alias("__t")), "__t").select(F.explode_outer("__e").alias("x")).where("x.k is not null")
    found = stage(each.select(F.explode_outer(_units(F.col("x"))).alias("u")).select("u.*").groupBy("k", "norm", "g").agg(F.min("e").alias("e")))
    real = found.select("k", F.col("norm").alias("s")).distinct()

    def given(state: DataFrame, salt: int) -> DataFrame:
        x = F.struct("e", "k", "g", F.array(F.lit(salt)).alias("salt"))
        one = add_surrogates(state.withColumn("__x", F.array(x)), "__x", key)
        return stage(one.withColumn("__x", F.get("__x", F.lit(0))).withColumn("s", normal(F.col("__x.s"), F.col("k"))).drop("__x"))

    def colliding(named: DataFrame, taken: list[DataFrame]) -> DataFrame:
        first = named.groupBy("k", "s").agg(F.count("*").alias("n"), F.min(F.struct("norm", "g")).alias("keep"))
        out = named.join(first.where("n > 1"), ["k", "s"]).where(F.struct("norm", "g") != F.col("keep")).select(*named.columns)
        for t in taken:
            out = out.unionByName(named.join(t.select("k", "s").distinct(), ["k", "s"], "left_semi"))
        return stage(out.select("k", "norm", "g", "e").distinct())

    named = given(found, 0)
    again = colliding(named, [real])
    held = [named.join(again, ["k", "norm", "g"], "left_anti")]
    moved = []
    for salt in range(1, rounds + 1):
        if not again.limit(1).count():
            break
        tried = given(again, salt)
        again = colliding(tried, [real, *held])
        ok = tried.join(again, ["k", "norm", "g"], "left_anti")
        held.append(ok)
        moved.append(ok.select("k", "norm", "g", F.lit(salt).alias("salt")))
    else:
        raise RuntimeError("surrogates still collide; the format of some type leaves too little room")
    out = found.select("k", "norm", "g", F.lit(0).alias("salt")).limit(0)
    for m in moved:
        out = out.unionByName(m)
    return out


def replace_entities(df: DataFrame, key: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """Replace each detected entity in text_col; add n_entities and entity_types (distinct, sorted, comma-joined).

    Null and empty texts stay as they are, with no entities. Rows that repeat get equal results. Columns named
    n_entities or entity_types are replaced; a text of any length is read whole. check: find collisions over the whole
    table first (one more pass); without any, which is the rule, no text is shuffled.
    """
    found = find_entities(df, text_col)
    salts = F.lit(None).cast("map<string,int>")
    bad = stage(collisions(df, key, text_col)) if check else None
    code = lambda u: F.concat_ws("\x1f", u["k"], u["norm"], u["g"])
    bad_salts = bad is not None and bad.limit(1).count() > 0
    if bad_salts:
        own = found.withColumn("__row", F.md5(F.col(text_col).cast("binary")))
        x = own.select("__row", F.explode_outer("__e").alias("x")).where("x.k is not null").select("__row", F.explode_outer(_units(F.col("x"))).alias("u"))
        x = x.select("__row", "u.k", "u.norm", "u.g").distinct()
        per = x.join(bad, ["k", "norm", "g"]).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "k", "norm", "g"), "salt"))).alias("__salts"))
        found, salts = own.join(stage(per), "__row", "left").drop("__row"), F.col("__salts")

    def salted(x):
        salt = F.transform(_units(x), lambda u: F.coalesce(salts[code(u)], F.lit(0))) if bad_salts else F.array_repeat(F.lit(0), F.size(_tokens(x["e"])))
        return F.struct(x["e"].alias("e"), x["k"].alias("k"), x["g"].alias("g"), salt.alias("salt"))

    found = add_surrogates(found.withColumn("__e", F.transform("__e", salted)), "__e", key)
    swapped = F.transform("__e", lambda x, i: F.concat(F.get("__s", i), F.coalesce(x["s"], x["e"])))
    text = F.concat(F.array_join(swapped, ""), F.element_at("__s", -1))
    kinds = F.filter(F.transform("__e", lambda x: x["k"]), lambda k: k.isNotNull())
    done = found.withColumn("n_entities", F.size(kinds).cast("long")).withColumn("entity_types", F.array_join(F.array_sort(F.array_distinct(kinds)), ","))
    return done.withColumn(text_col, F.when(F.col("n_entities") > 0, text).otherwise(F.col(text_col))).drop("__s", "__e", "__salts")
