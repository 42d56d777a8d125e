"""Format-preserving pseudonyms for personal data.

E-mail addresses, payment card numbers, phone numbers, social security numbers, IPv4 addresses, dates and
secrets are found in a whole text with one pattern and replaced in place. Numbers and dates that pass the validation of
their kind go through a keyed Feistel network over exactly the values of their format: ten rounds that add a
SHA-256 value of the other half, so a value always gets the same pseudonym, two values never share one,
and the pseudonym is valid again (a card keeps its first digit and gets a new check digit, a date stays a day of the calendar, punctuation stays).
A phone number keeps its country code. E-mail addresses (in lower case) and secrets are permuted in their shape: each digit and letter among those of its kind, the rest stays; only an address with letters
beyond a to z gets a keyed digest.
What fails validation (a number with a wrong check digit or of one digit only, 30 February) is not personal data and stays.

The key is an argument of every function. session_key() reads it from the session's spark.tessera.pii.key and fails without it; the registered queries bring one of their own for that case.

Only DataFrame expressions are used; texts are handled row by row without any exchange.

Defined cases: a null text stays null, with counts of 0; an empty text stays empty; texts without matches are returned as they
are; very long texts are scanned once, every pattern reads on from a run's start only; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, table, whole_rows

ROUNDS = 10
#: The key of the registered queries; a session that names another is asked first.
QUERY_KEY = "tessera-registered-queries"
#: Fixed value: country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: The patterns of each kind, tried in this order at each place. Runs are possessive or bounded.
PATTERNS = {
    "secret": r"(?i:(?<![\p{L}\p{N}_-])(?:access_token|auth_token|token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.=-]{8,}+)|(?iu:(?<![\p{L}\p{N}_-])(?:passwort|kennwort|mot de passe|contraseña|clave)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_.=-]*\d)[A-Za-z0-9+/_.=-]{8,}+)|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<!\d)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": "",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
#: Ten digits as 3, 3 and 4, without a country code.
_NATIONAL = r"(?<![\p{L}\p{N}(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]|\.\d)"


def _phone_pattern() -> str:
    """+ and a country code, then groups of digits parted by a blank, dot, dash or parentheses: 8 to 15 digits in all, 11 after +1 and +7 where that fits.

    The digits are counted by a look back to the plus sign. With eight of them the number ends before a value of another kind or a
    number without code; before a day of the calendar or an address it ends in any case. One or two decimals make an amount.
    """
    # Java wants looks back written out.
    part, octet = r"[ .()-]{0,3}\d", r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    eight, eleven = part * 8 + rf"(?:{part})?" * 7, part * 11
    other = "|".join([*(PATTERNS[k] for k in ("date", "ssn", "ip", "card")), _NATIONAL])
    valid = rf"(?<!\d\.)(?:\d{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)|{octet}(?:\.{octet}){{3}}(?!\d|\.\d))"
    group = rf"(?:(?:[ .-]?\(\d{{1,4}}\)[ .-]?|[ .-])(?!{valid}|(?<=\+{eight}[ .-])(?:{other}))\d{{1,14}}+)"
    digits = rf"\d{{1,15}}+{group}{{0,7}}"
    amount = r"\d{4,15}+\.\d{1,2}(?!\d|[ .-]\d)"
    return rf"(?<![\p{{L}}\p{{N}}])\+(?!{amount})(?:(?=[17]){digits}(?<=\+{eleven})|{digits}(?<=\+{eight}))(?!\d)|{_NATIONAL}"


PATTERNS["phone"] = _phone_pattern()
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)
#: Days from 1700-01-01 to 2099-12-31: one Gregorian cycle, which is 189 x 773.
DAYS, DAYS_A, DAYS_B, FIRST_DAY = 146097, 189, 773, "1700-01-01"


def digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: str | Column, key: str) -> Column:
    """Struct (a, b): a keyed permutation of 0..size_a-1 times 0..size_b-1; the halves take turns."""

    def add(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        other, own, size = F.when(even, s["b"]).otherwise(s["a"]), F.when(even, s["a"]).otherwise(s["b"]), F.when(even, size_a).otherwise(size_b)
        more = F.conv(F.substring(digest(key, F.lit(tweak) if isinstance(tweak, str) else tweak, size_a, size_b, r, other), 1, 15), 16, 10).cast("long") % size
        changed = (own + more) % size
        return F.struct(F.when(even, changed).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(changed).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), add)


def permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """A string of up to 36 digits as another one of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
    out = feistel(F.coalesce(left.try_cast("long"), F.lit(0)), right.cast("long"), power(half), power(rest), tweak, key)
    return let(out, lambda s: F.concat(F.when(half > 0, F.lpad(s["a"].cast("string"), half, "0")).otherwise(""), F.lpad(s["b"].cast("string"), rest, "0")))


def luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum; doubled: 1 if every second digit from the right counts twice, 0 if the others do."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(let(c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def refill(template: Column, digits: Column) -> Column:
    """template with its digits replaced by those of digits, in order."""
    zero = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    digit = lambda c: c.rlike("^[0-9]$")
    step = lambda a, c: F.struct(F.concat(a["s"], F.when(digit(c), F.substring(digits, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + digit(c).cast("int")).alias("i"))
    return F.aggregate(F.split(template, ""), zero, step, lambda a: a["s"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
        return let(body, lambda x: F.concat(x, ((10 - luhn(x, 0) % 10) % 10).cast("string")))

    return let(_digits(m), lambda d: F.when((luhn(d, 1) % 10 == 0) & ~d.rlike(r"^(\d)\1*$"), refill(m, new(d))).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    """The country code stays where there is one."""
    code = F.regexp_extract(m, COUNTRY, 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return let(rest, lambda r: F.concat(code, refill(r, permuted_digits(_digits(r), "phone", key))))


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    new = lambda p: feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), "ip", key)
    text = lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])
    return let(part, lambda p: F.when(F.array_max(p) <= 255, let(new(p), text)).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    cell = lambda at, n: F.substring(m, at, n).cast("long")
    area, group, serial = cell(1, 3), cell(5, 2), cell(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), "ssn", key)
    text = lambda s: F.format_string("%03d-%02d-%04d", s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1)
    return F.when(valid, let(out, text)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Year first, or day before month; a day outside the calendar or the four centuries stays."""
    year_first = m.rlike(r"^\d{4}")
    iso = F.when(year_first, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))

    def new(day: Column) -> Column:
        at = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        out = feistel(F.floor(at / DAYS_B), at % DAYS_B, F.lit(DAYS_A).cast("long"), F.lit(DAYS_B).cast("long"), "date", key)
        to = let(out, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS_B + s["b"]).cast("int")))
        text = lambda d: F.when(year_first, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), F.substring(m, 3, 1), F.date_format(d, "MM"), F.substring(m, 6, 1), F.date_format(d, "yyyy")))
        return F.when(at.between(0, DAYS - 1), let(to, text)).otherwise(m)

    return let(iso.try_cast("date"), lambda d: F.when(d.isNull(), m).otherwise(new(d)))


#: Characters that one permutation handles: two halves of up to 13, as 26 ** 13 is below 2 ** 63.
CHUNK = 26
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _place(c: Column, alphabets: tuple[str, ...]) -> Column:
    """Struct (at, size, first): a character's place in its alphabet, how many that has and where it begins; a size of 1 for what is of none."""
    out = F.struct(F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("first"))
    for a in alphabets:
        out = F.when(F.contains(F.lit(a), c) & (c != ""), F.struct((F.ascii(c) - ord(a[0])).cast("long").alias("at"), F.lit(len(a)).cast("long").alias("size"), F.lit(ord(a[0])).alias("first"))).otherwise(out)
    return out


def _number(places: Column) -> Column:
    """Struct (v, n): characters as one whole number, and how many such numbers there are."""
    step = lambda s, p: F.struct((s["v"] * p["size"] + p["at"]).alias("v"), (s["n"] * p["size"]).alias("n"))
    return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("n")), step)


def _letters(v: Column, places: Column, text: Column) -> Column:
    """The characters that a number stands for, in the alphabets of places; those of none stay as in text."""
    zero = F.struct(F.lit("").alias("s"), v.alias("v"))

    def step(s: Column, i: Column) -> Column:
        p = F.element_at(places, i)
        c = F.when(p["size"] > 1, F.char((s["v"] % p["size"] + p["first"]).cast("int"))).otherwise(F.substring(text, i, F.lit(1)))
        return F.struct(F.concat(c, s["s"]).alias("s"), F.floor((s["v"] - s["v"] % p["size"]).cast("decimal(20,0)") / p["size"]).cast("long").alias("v"))

    return F.aggregate(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(places), F.lit(1)))), zero, step, lambda s: s["s"])


def permuted_text(text: Column, tweak: str, key: str, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """A text as another one of its shape: its digits and letters are permuted with those that have a digit or a letter of that case there, other characters stay.

    Texts of more than CHUNK characters go in chunks, each under a tweak of all before it: of equal texts up to the end of a chunk, the pseudonyms are equal so far.
    """

    def chunk(i: Column) -> Column:
        own = F.substring(text, i * CHUNK + 1, F.lit(CHUNK))
        half = F.floor(F.length(own) / 2).cast("int")

        def new(two: Column) -> Column:
            a, b = two["a"], two["b"]
            out = feistel_of(_number(a), _number(b), F.concat(F.lit(f"{tweak}|"), F.substring(text, F.lit(1), i * CHUNK)), key)
            return let(out, lambda s: F.concat(F.when(F.size(a) > 0, _letters(s["a"], a, F.substring(own, F.lit(1), half))).otherwise(""), F.when(F.size(b) > 0, _letters(s["b"], b, F.substring(own, half + 1, F.length(own)))).otherwise("")))

        characters = lambda x: F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: _place(c, alphabets))
        return let(F.struct(characters(F.substring(own, F.lit(1), half)).alias("a"), characters(F.substring(own, half + 1, F.length(own))).alias("b")), new)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / CHUNK), F.lit(0)).cast("int")), chunk), "")


def feistel_of(a: Column, b: Column, tweak: Column, key: str) -> Column:
    """feistel() of two numbers (v, n) under a tweak that is a column."""
    return let(F.struct(a.alias("a"), b.alias("b"), tweak.alias("t")), lambda x: feistel(x["a"]["v"], x["b"]["v"], x["a"]["n"], x["b"]["n"], x["t"], key))


def _email(m: Column, key: str) -> Column:
    """Local part and labels permuted in lower case, the last label kept; a name that has letters beyond a to z gets a digest in its place."""
    low = F.lower(m)
    last = F.regexp_extract(low, r"\.[^.]*$", 0)
    d = digest(key, F.lit("email"), low)
    hidden = F.concat(F.lit("u"), F.substring(d, 1, 12), F.lit("@m"), F.substring(d, 13, 8), F.lit(".example.com"))
    return F.when(low.rlike(r"^[a-z0-9._%+@-]*$"), F.concat(permuted_text(F.substring(low, F.lit(1), F.length(low) - F.length(last)), "email", key), last)).otherwise(hidden)


def _secret(m: Column, key: str) -> Column:
    """The value permuted in its shape: letters from a to f and digits for hexadecimal ones."""
    name = F.regexp_extract(m, r"^(?:AKIA|(?u:[\p{L}_ -]+?)\s*[=:]\s*[\"']?)", 0)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    hexadecimal = lambda v: permuted_text(v, "hex", key, ("0123456789", "abcdef"))
    return let(value, lambda v: F.concat(name, F.when(v.rlike("^[0-9a-f]+$"), hexadecimal(v)).otherwise(permuted_text(v, "secret", key))))


NEW = {"secret": _secret, "email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def kind(m: Column) -> Column:
    """The kind of what ANY has matched."""
    tests = {"secret": r"^\p{L}.*[=:]|^AKIA", "email": "@", "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$", "phone": r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$"}
    out = F.when(m.rlike(tests["secret"]), "secret")
    for name, test in list(tests.items())[1:]:
        out = out.when(m.rlike(test), name)
    return out.otherwise("card")


def pseudonym(m: Column, key: str) -> Column:
    """Struct (old, new, kind); new equals old for what fails its validation."""

    def by_kind(k: Column) -> Column:
        new = F.when(k == KINDS[0], NEW[KINDS[0]](m, key))
        for name in KINDS[1:]:
            new = new.when(k == name, NEW[name](m, key))
        return F.struct(new.alias("new"), k.alias("kind"), m.alias("old"))

    return let(kind(m), by_kind)


def pseudonymised(text: Column, key: str) -> Column:
    """Struct (text, found): the text with pseudonyms, and how many values of each kind were replaced."""

    def joined(found: Column) -> Column:
        pieces = F.zip_with(F.split(text, ANY, -1), found, lambda p, x: F.concat(p, F.coalesce(x["new"], F.lit(""))))
        count = lambda k: F.size(F.filter(found, lambda x: (x["kind"] == k) & (x["new"] != x["old"]))).cast("long").alias(f"n_{k}")
        return F.struct(F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text).alias("text"), *[count(k) for k in KINDS])

    plain = F.coalesce(text, F.lit(""))
    # Each pattern needs one of these characters, which most texts lack.
    matches = F.when(plain.rlike("[0-9@:=]|AKIA"), F.regexp_extract_all(plain, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(F.transform(matches, lambda m: pseudonym(m, key)), joined)


def session_key(spark, default: str | None = None) -> str:
    """The key that the session's spark.tessera.pii.key names; without it the default, or an error where none is given: a key is never taken from the library."""
    key = spark.conf.get("spark.tessera.pii.key", None) or default
    if not key:
        raise ValueError("spark.tessera.pii.key must name the key of the pseudonyms")
    return key


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", pseudonymised(F.col("text"), session_key(spark, QUERY_KEY)).alias("p")).select("doc_id", "p.*")


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text, and n_chars after it where there is that column."""
    marked = docs.select(whole_rows(docs).alias("row"), pseudonymised(F.col("text"), key)["text"].alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return marked.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
