"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

Equal values become equal pseudonyms in every document; different values of a kind stay different, because
each step is a permutation of the values that are valid in the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.llm import _common as c

ROUNDS = 5
#: The key of the registered query, which is public and so protects nothing: callers bring their own.
TEST_KEY = "test key, not secret"
#: What is looked for. Each pattern starts and ends at a non-word character, so no two matches overlap. Loops without a
#: bound are over one class of characters or possessive: Java matches others by recursion, whose stack a long text exhausts.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)++"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
DATE = r"(?<![\w./\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/\-]|\.\d)"
PHONE = (
    r"(?<![\w+])\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\w)"
    r"|(?<![\w+])\+(?!1[ .(\-])\d{1,3}[ \-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ \-]?\d{2,4}){2,4}(?!\w|\.\d)"
    r"|(?<![\w+\-.(])(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?![\w\-])"
)
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
CARD = r"(?<!\w)(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\w)"
KINDS = ("email", "iban", "ssn", "date", "phone", "ipv4", "card")
#: The longest local part and address that mail standards allow, and the country codes of two digits
#: (1 and 7 have one, all others three).
LONGEST_LOCAL, LONGEST_EMAIL = 64, 254
TWO_DIGIT_CODES = (
    "20", "27", "28", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "83", "84", "86", "89", "90", "91", "92", "93", "94", "95", "98",
)
#: Days from FIRST_DAY to the end of 2096, years without an exception to the leap rule: DAYS = 147 * 487 exactly.
FIRST_DAY, DAYS, DAYS_A, DAYS_B = "1901-01-01", 71589, 147, 487
#: The other days of the years 1 to 9999 are permuted among themselves: EARLY of them before FIRST_DAY, OTHER_A * OTHER_B in all.
EARLY, OTHER_A, OTHER_B = 693960, 1490, 2403
#: Steps at most until a day after the 12th comes up; each misses it two times in five.
WALK = 64


def pattern(emails: bool = True) -> str:
    """All kinds as one pattern; a look at the first characters spares most places the alternatives."""
    numbers = "|".join(f"(?:{p})" for p in (IBAN, SSN, DATE, PHONE, IPV4, CARD))
    return rf"(?=[0-9+(]|[A-Z][A-Z][0-9][0-9])(?:{numbers})" + rf"|{EMAIL}" * emails


def let(value: Column, use) -> Column:
    """use(value), with value computed once: in a lambda Spark computes an expression wherever it stands."""
    return F.transform(F.array(value), use)[0]


def _long(x: Column) -> Column:
    return x.cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, tag: Column, key: str, rounds: int = ROUNDS) -> Column:
    """(l, r): the pair of numbers below a and b, keyed-permuted; every round adds a keyed hash of one to the other."""

    def prf(half: Column, n: Column, of: Column, side: str) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), tag, n.cast("string"), F.lit(side), half.cast("string")), 256)), 256)
        return F.pmod(_long(F.conv(F.substring(digest, 1, 15), 16, 10)), of)

    def step(acc: Column, n: Column) -> Column:
        return let(F.pmod(acc["l"] + prf(acc["r"], n, a, "r"), a), lambda new: F.struct(new.alias("l"), F.pmod(acc["r"] + prf(new, n, b, "l"), b).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(_long(left).alias("l"), _long(right).alias("r")), step)


def _ten(n: Column) -> Column:
    return _long(F.rpad(F.lit("1"), n + 1, "0"))


def digits_permuted(s: Column, tag: Column, key: str) -> Column:
    """A string of 2 to 36 digits as another of as many."""

    def permuted(s: Column) -> Column:
        n = F.length(s)
        h = F.floor(n / 2).cast("int")
        p = feistel(_long(F.substr(s, F.lit(1), h)), _long(F.substr(s, h + 1, n - h)), _ten(h), _ten(n - h), F.concat_ws("|", tag, n.cast("string")), key)
        return let(p, lambda p: F.concat(F.lpad(p["l"].cast("string"), h, "0"), F.lpad(p["r"].cast("string"), n - h, "0")))

    return let(s, permuted)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, new: Column) -> Column:
    """m with its digits replaced, in order, by those of new."""
    at = lambda i: F.substr(m, i, F.lit(1))
    one = lambda i, new: F.when(at(i).between("0", "9"), F.substr(new, F.length(digits(F.substr(m, F.lit(1), i))), F.lit(1))).otherwise(at(i))
    return let(new, lambda new: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: one(i, new)), ""))


def luhn(s: Column, doubled: int) -> Column:
    """Sum of the digits, every second from the right, the last or the one before it, counted double."""
    n = F.length(s)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(s, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == doubled, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def is_card(m: Column) -> Column:
    return luhn(digits(m), 1) % 10 == 0


def card(m: Column, key: str) -> Column:
    """The first digit stays, so does the length; the last makes the Luhn sum right again."""
    d = digits(m)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), digits_permuted(F.substr(d, F.lit(2), F.length(d) - 2), F.concat(F.lit("card"), F.substr(d, F.lit(1), F.lit(1))), key))
    return refill(m, let(body, lambda body: F.concat(body, ((10 - luhn(body, 0) % 10) % 10).cast("string"))))


def _mod97(s: Column) -> Column:
    """Remainder by 97 of letters and digits, letters from A = 10."""
    step = lambda acc, x: F.when(x.between("0", "9"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(step(acc, x)))


def _iban_rest(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def is_iban(m: Column) -> Column:
    s = _iban_rest(m)
    return F.length(s).between(15, 34) & (_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1)


def iban(m: Column, key: str) -> Column:
    """Country, length and letters stay; the account's digits are permuted and the two check digits made right."""
    s = _iban_rest(m)
    rest = F.substr(s, F.lit(5), F.length(s))
    d = digits(rest)
    new = F.when(F.length(d) > 1, refill(rest, digits_permuted(d, F.concat(F.lit("iban"), F.regexp_replace(rest, "[0-9]", "0")), key))).otherwise(rest)
    country = F.substr(s, F.lit(1), F.lit(2))
    flat = let(new, lambda new: F.concat(country, F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new))
    # spaces back where they were: every character of m that is one, else the next of flat
    at = lambda i: F.substr(m, i, F.lit(1))
    one = lambda i, flat: F.when(at(i) == " ", F.lit(" ")).otherwise(F.substr(flat, F.length(_iban_rest(F.substr(m, F.lit(1), i))), F.lit(1)))
    return let(flat, lambda flat: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: one(i, flat)), ""))


def is_ssn(m: Column) -> Column:
    return ~m.rlike(r"^(?:000|666|9\d\d)-|-00-|-0000$")


def ssn(m: Column, key: str) -> Column:
    """Area, group and serial numbers stay in their valid ranges: 898 areas, 99 groups, 9999 serials."""
    d = digits(m)
    area, group, serial = _long(F.substr(d, F.lit(1), F.lit(3))), _long(F.substr(d, F.lit(4), F.lit(2))), _long(F.substr(d, F.lit(6), F.lit(4)))
    p = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)

    def written(p: Column) -> Column:
        a = p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))

    return let(p, written)


def _format(m: Column) -> Column:
    """Month first where both readings of dd/mm/yyyy are dates, day first where only that is one."""
    slashes = F.when(F.substr(m, F.lit(1), F.lit(2)) > "12", "dd/MM/yyyy").otherwise("MM/dd/yyyy")
    return F.when(m.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(m.rlike(r"^\d{4}/"), "yyyy/MM/dd").when(m.contains("."), "dd.MM.yyyy").otherwise(slashes)


def _day(m: Column) -> Column:
    """Days from FIRST_DAY, negative before it; null if it is not a date of the years 1 to 9999."""
    at = lambda i, n: F.substr(m, F.lit(i), F.lit(n))
    f = _format(m)
    iso = F.when(f.startswith("yyyy"), F.translate(m, "/", "-")).when(f.startswith("dd"), F.concat_ws("-", at(7, 4), at(4, 2), at(1, 2))).otherwise(F.concat_ws("-", at(7, 4), at(1, 2), at(4, 2)))
    day = F.date_diff(F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))), F.lit(FIRST_DAY).cast("date"))
    return F.when(day.between(-EARLY, OTHER_A * OTHER_B + DAYS - EARLY - 1), _long(day))


def is_date(m: Column) -> Column:
    return _day(m).isNotNull()


def _moved(day: Column, key: str) -> Column:
    """Another day by the permutation of the DAYS from FIRST_DAY, or by that of all others."""
    inside = day.between(0, DAYS - 1)
    n = F.when(inside, day).when(day < 0, day + EARLY).otherwise(day + EARLY - DAYS)
    a, b = F.when(inside, DAYS_A).otherwise(OTHER_A), F.when(inside, DAYS_B).otherwise(OTHER_B)
    p = let(n, lambda n: feistel(F.floor(n / b), n % b, a, b, F.when(inside, "date").otherwise("date|other"), key))
    back = lambda n: F.when(inside, n).when(n < EARLY, n - EARLY).otherwise(n - EARLY + DAYS)
    return let(let(p, lambda p: p["l"] * b + p["r"]), back)


def date(m: Column, key: str) -> Column:
    """The format stays. A day-first date with slashes goes on until the day is after the 12th, so that it is read day first again."""
    f = _format(m)
    of = lambda day: F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    one = let(_day(m), lambda day: _moved(day, key))
    again = lambda day: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), day, lambda d, _: F.when(F.dayofmonth(of(d)) > 12, d).otherwise(let(d, lambda d: _moved(d, key))))
    p = let(one, lambda day: F.when(f == "dd/MM/yyyy", again(day)).otherwise(day))

    def written(iso: Column) -> Column:
        y, mo, d = F.substr(iso, F.lit(1), F.lit(4)), F.substr(iso, F.lit(6), F.lit(2)), F.substr(iso, F.lit(9), F.lit(2))
        out = F.when(f == "yyyy-MM-dd", iso).when(f == "yyyy/MM/dd", F.concat_ws("/", y, mo, d)).when(f == "dd.MM.yyyy", F.concat_ws(".", d, mo, y))
        return out.when(f == "dd/MM/yyyy", F.concat_ws("/", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))

    return let(let(p, lambda day: of(day).cast("string")), written)


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(8, 15)


def is_north_american(m: Column) -> Column:
    """Ten digits, with or without the country code 1: one number however it is written."""
    return ~m.startswith("+") | (digits(m).startswith("1") & (F.length(digits(m)) == 11))


def _north_american(n: Column, key: str) -> Column:
    """Ten digits as ten others. Area and exchange codes from 200 on stay from 200 on, the others below."""

    def permuted(n: Column) -> Column:
        area, exchange, line = (_long(F.substr(n, F.lit(i), F.lit(k))) for i, k in ((1, 3), (4, 3), (7, 4)))
        sizes = [F.when(x < 200, 200).otherwise(800) for x in (area, exchange)]
        bases = [F.when(x < 200, 0).otherwise(200) for x in (area, exchange)]
        tag = F.concat_ws("|", F.lit("phone|1"), *[x.cast("string") for x in sizes])
        p = feistel(area - bases[0], (exchange - bases[1]) * 10000 + line, sizes[0], sizes[1] * 10000, tag, key)
        parts = lambda p: ((p["l"] + bases[0], 3), (F.floor(p["r"] / 10000) + bases[1], 3), (p["r"] % 10000, 4))
        return let(p, lambda p: F.concat(*[F.lpad(x.cast("string"), k, "0") for x, k in parts(p)]))

    return let(n, permuted)


def phone(m: Column, key: str) -> Column:
    """Separators and country code stay; the digits after it are permuted, however they are grouped."""

    def written(d: Column) -> Column:
        two = F.substr(d, F.lit(1), F.lit(2))
        code = F.when(F.substr(d, F.lit(1), F.lit(1)).isin("1", "7"), 1).when(two.isin(*TWO_DIGIT_CODES), 2).otherwise(3)
        code = F.when(is_north_american(m), F.length(d) - 10).otherwise(code)
        rest, head = F.substr(d, code + 1, F.length(d)), F.substr(d, F.lit(1), code)
        new = F.when(is_north_american(m), _north_american(rest, key)).otherwise(digits_permuted(rest, F.concat(F.lit("phone|"), head), key))
        return refill(m, F.concat(head, new))

    return let(digits(m), written)


def is_ipv4(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256)


def ipv4(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    n = lambda i: _long(o[i])
    p = feistel(n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(65536), F.lit(65536), F.lit("ipv4"), key)
    return let(p, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))


def email(m: Column, key: str) -> Column:
    """The domain stays; so do length, letter case and punctuation of the local part, whose letters and digits are permuted.

    The local part's two halves take turns in shifting each other's characters inside their alphabets.
    """
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    h = F.ceil(n / 2).cast("int")

    def shift(s: Column, other: Column, step: Column, side: str) -> Column:
        def one(i: Column) -> Column:
            x = F.substr(s, i, F.lit(1))
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), n.cast("string"), domain, step.cast("string"), F.lit(side), i.cast("string"), other), 256)
            by = _long(F.conv(F.substring(digest, 1, 8), 16, 10))
            size = lambda base, of: F.char(F.lit(base) + F.pmod(F.ascii(x) - base + by, F.lit(of)))
            return F.when(x.rlike("[a-z]"), size(97, 26)).when(x.rlike("[A-Z]"), size(65, 26)).when(x.rlike("[0-9]"), size(48, 10)).otherwise(x)

        return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), "")).otherwise(s)

    def step(acc: Column, i: Column) -> Column:
        return let(shift(acc["l"], acc["r"], i, "r"), lambda new: F.struct(new.alias("l"), shift(acc["r"], new, i, "l").alias("r")))

    start = F.struct(F.substr(local, F.lit(1), h).alias("l"), F.substr(local, h + 1, n).alias("r"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, step)
    return let(p, lambda p: F.concat(p["l"], p["r"], F.lit("@"), domain))


def kind_of(m: Column) -> Column:
    """The kind of a match, null if its number or date is not valid."""
    return (
        F.when(m.contains("@"), F.when((F.length(F.substring_index(m, "@", 1)) <= LONGEST_LOCAL) & (F.length(m) <= LONGEST_EMAIL), F.lit("email")))
        .when(m.rlike(r"^[A-Z]{2}\d"), F.when(is_iban(m), F.lit("iban")))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(is_ssn(m), F.lit("ssn")))
        .when(m.rlike(r"^(?:\d{4}[\-/]\d{2}[\-/]\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), F.when(is_date(m), F.lit("date")))
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(is_ipv4(m), F.lit("ipv4")))
        .when(m.rlike(r"^(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})$"), F.when(is_card(m), F.lit("card")))
        .when(is_phone(m), F.lit("phone"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    made = {"email": email, "iban": iban, "ssn": ssn, "date": date, "ipv4": ipv4, "card": card, "phone": phone}
    out = F.when(kind.isNull(), m)
    for k, f in made.items():
        out = out.when(kind == k, f(m, key))
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_found, kinds) for every row of docs: the text with each value replaced, its values' number and kinds.

    `key` is the caller's secret: who knows it can undo the permutations, and one key links values over all documents.
    Values are e-mail addresses (of at most 254 characters, 64 before the @), IBANs (remainder 97), social security numbers (ranges), dates (calendar, years 1
    to 9999; where slashes end in the year MM/dd/yyyy, or dd/MM/yyyy if only that is a date), international and North American phone numbers, IPv4 addresses
    (octets) and payment cards (Luhn); numbers that fail their check stay. North American numbers are one with and
    without their country code. Texts may be of any length: no pattern recurs with the text. A null text stays null with nothing
    found; empty texts, repeated rows and an empty table give what they hold; other columns are ignored. Nothing is
    shuffled, and a text without a match is returned as it is.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Every kind holds a digit or an @, and only addresses an @: two short searches spare most texts the long ones.
    everything, numbers = pattern(), pattern(emails=False)
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    some = F.when(F.col("text").contains("@"), found(everything)).when(F.col("text").rlike("[0-9]"), found(numbers))
    x = x.withColumn("_m", F.coalesce(some, F.array().cast("array<string>")))
    x = x.withColumn("_k", F.transform("_m", kind_of)).withColumn("_f", F.filter("_k", lambda k: k.isNotNull()))
    parts = F.when(F.col("text").contains("@"), F.split("text", everything, -1)).otherwise(F.split("text", numbers, -1))
    new = F.transform("_m", lambda m, i: pseudonym(m, F.get("_k", i), key))
    text = F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return x.select("doc_id", F.when(F.size("_f") > 0, text).otherwise(F.col("text")).alias("text"), F.size("_f").alias("n_found"), F.array_sort(F.array_distinct("_f")).alias("kinds"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key TEST_KEY."""
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEST_KEY)


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
