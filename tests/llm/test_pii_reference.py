"""Pseudonyms against a second implementation, row by row in plain Python, and texts made to exhaust the patterns."""

import hashlib
import re
from datetime import date, timedelta

from speckle.llm import pii

SF = "/root/testdata/sf0.001"
KEY = "another key"
FIND = re.compile(pii.pattern(), re.ASCII)


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def feistel(left, right, a, b, tag):
    def prf(half, n, of, side):
        return int(sha(KEY, sha(KEY, tag, n, side, half))[:15], 16) % of

    for n in range(1, pii.ROUNDS + 1):
        left = (left + prf(right, n, a, "r")) % a
        right = (right + prf(left, n, b, "l")) % b
    return left, right


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def refill(m, new):
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in m)


def permuted(s, tag):
    h = len(s) // 2
    left, right = feistel(int(s[:h]), int(s[h:]), 10**h, 10 ** (len(s) - h), f"{tag}|{len(s)}")
    return f"{left:0{h}}{right:0{len(s) - h}}"


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def day_of(m):
    """(day, pattern) with d, m and y for the three parts."""
    if re.match(r"\d{4}[-/]", m):
        y, mo, d, how = m[:4], m[5:7], m[8:], "y{0}m{0}d".format(m[4])
    elif "." in m:
        d, mo, y, how = m[:2], m[3:5], m[6:], "d.m.y"
    elif m[:2] > "12":
        d, mo, y, how = m[:2], m[3:5], m[6:], "d/m/y"
    else:
        mo, d, y, how = m[:2], m[3:5], m[6:], "m/d/y"
    try:
        return date(int(y), int(mo), int(d)), how
    except ValueError:
        return None, how


def moved(day):
    first = date.fromisoformat(pii.FIRST_DAY)
    n = (day - first).days
    if 0 <= n < pii.DAYS:
        x, y = feistel(n // pii.DAYS_B, n % pii.DAYS_B, pii.DAYS_A, pii.DAYS_B, "date")
        return first + timedelta(x * pii.DAYS_B + y)
    n += pii.EARLY if n < 0 else pii.EARLY - pii.DAYS
    x, y = feistel(n // pii.OTHER_B, n % pii.OTHER_B, pii.OTHER_A, pii.OTHER_B, "date|other")
    n = x * pii.OTHER_B + y
    return first + timedelta(n - pii.EARLY if n < pii.EARLY else n - pii.EARLY + pii.DAYS)


def replaced(m):
    """(kind, pseudonym), or None where the value is not valid."""
    d = digits(m)
    if "@" in m:
        local, domain = m.split("@")
        if len(local) > 64 or len(m) > 254:
            return None
        h = -(-len(local) // 2)
        halves = [local[:h], local[h:]]

        def shift(s, other, step, side):
            out = []
            for i, c in enumerate(s, 1):
                by = int(sha(KEY, "email", len(local), domain, step, side, i, other)[:8], 16)
                for base, of in ((97, 26), (65, 26), (48, 10)):
                    if base <= ord(c) < base + of:
                        c = chr(base + (ord(c) - base + by) % of)
                        break
                out.append(c)
            return "".join(out)

        for step in (1, 2, 3):
            halves[0] = shift(halves[0], halves[1], step, "r")
            halves[1] = shift(halves[1], halves[0], step, "l")
        return "email", "".join(halves) + "@" + domain
    if re.match(r"[A-Z]{2}\d", m):
        s = m.replace(" ", "")
        if not 15 <= len(s) <= 34 or mod97(s[4:] + s[:4]) != 1:
            return None
        rest = s[4:]
        new = refill(rest, permuted(digits(rest), "iban" + re.sub("[0-9]", "0", rest))) if len(digits(rest)) > 1 else rest
        flat = iter(s[:2] + f"{98 - mod97(new + s[:2] + '00'):02}" + new)
        return "iban", "".join(" " if c == " " else next(flat) for c in m)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        if m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[7:] == "0000":
            return None
        area = int(m[:3]) - 1 - (int(m[:3]) > 666)
        x, y = feistel(area, (int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, 898, 99 * 9999, "ssn")
        return "ssn", f"{x + 1 + (x >= 665):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if re.fullmatch(r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[./]\d{2}[./]\d{4}", m):
        day, how = day_of(m)
        if day is None:
            return None
        day = moved(day)
        while how == "d/m/y" and day.day <= 12:
            day = moved(day)
        return "date", how.replace("y", f"{day.year:04}").replace("m", f"{day.month:02}").replace("d", f"{day.day:02}")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")
        return "ipv4", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if re.fullmatch(r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}", m):
        if luhn(d):
            return None
        body = d[0] + permuted(d[1:-1], "card" + d[0])
        return "card", refill(m, body + str(-luhn(body + "0") % 10))
    if not 8 <= len(d) <= 15:
        return None
    if not m.startswith("+") or (d[0] == "1" and len(d) == 11):
        head, n = d[:-10], d[-10:]
        area, exchange = int(n[:3]), int(n[3:6])
        (sa, ba), (se, be) = ((200, 0) if x < 200 else (800, 200) for x in (area, exchange))
        x, y = feistel(area - ba, (exchange - be) * 10000 + int(n[6:]), sa, se * 10000, f"phone|1|{sa}|{se}")
        return "phone", refill(m, head + f"{x + ba:03}{y // 10000 + be:03}{y % 10000:04}")
    k = 1 if d[0] in "17" else 2 if d[:2] in pii.TWO_DIGIT_CODES else 3
    return "phone", refill(m, d[:k] + permuted(d[k:], "phone|" + d[:k]))


def brute(text):
    if text is None:
        return None, 0, []
    out, kinds, at = [], [], 0
    for m in FIND.finditer(text):
        got = replaced(m.group())
        out += [text[at : m.start()], got[1] if got else m.group()]
        kinds += [got[0]] if got else []
        at = m.end()
    return "".join(out) + text[at:], len(kinds), sorted(set(kinds))


def run(spark, texts):
    df = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), KEY)
    return [(r.text, r.n_found, r.kinds) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_every_document_of_the_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = run(spark, [r.text for r in docs])
    assert got == [brute(r.text) for r in docs]
    assert sum(n for _, n, _ in got) > 20


def test_odd_values(spark):
    texts = [
        "bob.smith+x%1@mail-2.example.co.uk, A-_@b.c", "GB82WEST12345698765432 or DE89 3704 0044 0532 0130 00", "123-45-6789 899-99-9999 665-01-0001 667-01-0001",
        "2020-02-29 2020/02/29 29.02.2020 02/29/2020 29/02/2020 29/02/2021", "1.2.3.4 255.255.255.255 256.1.1.1", "4111 1111 1111 1111 378282246310005 3782 822463 10005 4111111111111112",
        "+1 212 555 1234, (212) 555-1234, 212-555-1234, 1-212-555-1234, +12125551234, 117.055.0123-1", "+49 170 1234567 +491701234567 +44 (20) 7946 0958 +353 1 234 5678 +7 495 123 45 67",
        None, "", "a" * 65 + "@example.com", "a" * 64 + "@example.com", "a@" + "b" * 300 + ".com", "12345 1234567890 +1234",
    ]
    assert run(spark, texts) == [brute(t) for t in texts]


def test_a_number_is_one_however_it_is_written(spark):
    (us, n, _), (de, k, _) = run(spark, ["+1 212 555 1234, (212) 555-1234, 212.555.1234, +12125551234, 1-212-555-1234", "+49 170 1234567, +491701234567, +49-170-123-4567"])
    assert n == 5 and {digits(x)[-10:] for x in us.split(", ")} != {"2125551234"} and len({digits(x)[-10:] for x in us.split(", ")}) == 1
    assert us.split(", ")[1][1] in "23456789" and us.split(", ")[1][6] in "23456789"
    assert k == 3 and len({digits(x) for x in de.split(", ")}) == 1 and digits(de.split(", ")[0]) != "491701234567"


def test_texts_made_to_exhaust_the_patterns(spark):
    n = 1 << 20
    texts = ["see a@b" + ".c" * 100_000 + " end", "1" * n, "@" * n, "-" * n + "@", "a@b" + "-" * n + "c", "1-" * n, "a" * n + "@b.c", "(1" * n, "+1 " * n, "a@b.c " * 20_000, "12.12.2012 " * 20_000, "é1" * n, "AB12" * n]
    got = run(spark, texts)
    assert [t for t, k, _ in got if k == 0] == [t for t, (_, k, _) in zip(texts, got) if k == 0]
    assert [k for _, k, _ in got] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 20_000, 20_000, 0, 0]


def test_keys_part_the_pseudonyms(spark):
    df = spark.createDataFrame([(1, "bob@example.com 4111111111111111")], "doc_id long, text string")
    assert pii.pseudonymised(df, "a").first().text != pii.pseudonymised(df, "b").first().text
