"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Numbers and dates that pass their own check (Luhn, mod 97, calendar, octets, numbering
plan) are permuted by a keyed Feistel network within the set of valid values of their
format, so a value has one pseudonym wherever it stands and however it is punctuated,
and no two values share one. Mail names and credentials are permuted letter for letter
and digit for digit in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The key of the registered query; a real run passes its own.
DEMO_KEY = "pagelith"

# possessive repeats are matched in a loop, and a look behind starts each run once: long runs take linear time
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
PASSWORD = r"(?<![A-Za-z0-9])[Pp]assw(?:or)?d\s{0,3}[=:]\s{0,3}[^\s\"',;]{6,}+"
HEX_TOKEN = r"(?<![A-Za-z0-9])(?=[A-Fa-f]{0,40}[0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
ISO_DATE = r"(?<![0-9-])[12][0-9]{3}-[01][0-9]-[0-3][0-9](?![0-9-])"
SLASH_DATE = r"(?<![0-9/])[0-3]?[0-9]/[0-3]?[0-9]/[12][0-9]{3}(?![0-9/])"
DOT_DATE = r"(?<![0-9.])[0-3]?[0-9]\.[01]?[0-9]\.[12][0-9]{3}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NANP = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
PHONE = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])"
#: First that matches decides.
FORMATS = (
    ("email", EMAIL), ("access_key", ACCESS_KEY), ("password", PASSWORD), ("token", HEX_TOKEN), ("iban", IBAN), ("date_iso", ISO_DATE),
    ("date_slash", SLASH_DATE), ("date_dot", DOT_DATE), ("ip", IPV4), ("ssn", SSN), ("phone_nanp", NANP), ("phone", PHONE), ("card", CARD),
)
ANY = "|".join(p for _, p in FORMATS)
KINDS = ("email", "secret", "iban", "date", "ip", "ssn", "phone", "card")


def _prf(key: str, tag: str, rnd: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), rnd.cast("string"), value.cast("string")), 256)


def _number(hexdigits: Column) -> Column:
    return F.conv(hexdigits, 16, 10).cast("bigint")


def permute_pair(key: str, tag: str, x: Column, y: Column, a: int, b: int) -> Column:
    """A keyed permutation of Z_a x Z_b: struct(x, y)."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    add = lambda r, v: _number(F.substring(_prf(key, tag, r, v), 1, 13))
    step = lambda s, r: F.when(
        r % 2 == 0, F.struct(((s["x"] + add(r, s["y"])) % a).alias("x"), s["y"].alias("y"))
    ).otherwise(F.struct(s["x"].alias("x"), ((s["y"] + add(r, s["x"])) % b).alias("y")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_text(key: str, tag: str, text: Column) -> Column:
    """A keyed permutation of the texts with the same pattern of digits, capitals and small letters."""

    def shift(c: Column, k: Column) -> Column:
        code = F.ascii(c)
        turn = lambda first, size: F.char(first + (code - first + k) % size)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    def mask(half: Column, digest: Column) -> Column:
        by_place = lambda d: F.transform(F.split(half, ""), lambda c, i: shift(c, _number(F.substr(d, (i % 32) * 2 + 1, F.lit(2))).cast("int")))
        return F.array_join(F.element_at(F.transform(F.array(digest), by_place), 1), "")

    middle = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), middle).alias("x"), F.substr(text, middle + 1).alias("y"))
    step = lambda s, r: F.struct(s["y"].alias("x"), mask(s["x"], _prf(key, tag, r, s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["x"], s["y"]))


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(number: Column, doubled_from_right: int) -> Column:
    """doubled_from_right 1: a whole number with check digit; 0: a number without."""
    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == doubled_from_right, c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda s, x: s + x)


def _repunctuate(shape: Column, new: Column) -> Column:
    """new's digits in place of shape's."""
    places = F.split(shape, "")
    return F.array_join(
        F.transform(places, lambda c, i: F.when(c.between("0", "9"), F.substr(new, F.length(digits(F.substr(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""
    )


def _mod97(text: Column) -> Column:
    """Of a text of digits and capitals, letters standing for 10 to 35."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).when(c.between("A", "Z"), (s * 100 + F.ascii(c) - 55) % 97).otherwise(s),
    )


def _within(m: Column, least: int, ok, solve, rest=lambda t: t) -> Column:
    """solve(m) if ok(m), else the first and longest part of m between blanks or hyphens that is ok, with the text around it through rest; else null."""
    edge = lambda i: F.substr(m, i, F.lit(1)).isin(" ", "-")
    starts = F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: (i == 1) | edge(i - 1))
    ends = F.filter(F.sequence(F.length(m), F.lit(1), F.lit(-1)), lambda i: (i == F.length(m)) | edge(i + 1))
    parts = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda b: b - a + 1 >= least), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    text = lambda p: F.substr(m, p["a"], p["b"] - p["a"] + 1)
    put = lambda p: F.concat(F.substr(m, F.lit(1), p["a"] - 1), solve(text(p)), rest(F.substr(m, p["b"] + 1)))
    return F.when(ok(m), solve(m)).otherwise(_bind(F.get(F.filter(parts, lambda p: ok(text(p))), F.lit(0)), lambda p: F.when(F.isnotnull(p), put(p))))


def _iban_ok(m: Column) -> Column:
    return m.rlike("^[A-Z]{2}[0-9]{2}") & _bind(F.replace(m, F.lit(" "), F.lit("")), lambda p: F.length(p).between(15, 34) & (_mod97(F.concat(F.substr(p, F.lit(5)), F.substring(p, 1, 4))) == 1))


def _iban(key: str, m: Column) -> Column:
    """Also of a match that took in what follows; a card number there is replaced too."""
    return _within(m, 15, _iban_ok, lambda t: _whole_iban(key, t), lambda t: F.coalesce(_card(key, t), t))


def _whole_iban(key: str, m: Column) -> Column:
    def solve(plain: Column) -> Column:
        body = F.substr(plain, F.lit(5))
        country = F.substring(plain, 1, 2)
        new = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
        ok = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
        spaced = lambda n: F.array_join(
            F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(n, F.length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), ""
        )
        return F.when(ok, _bind(_bind(permute_text(key, "iban", body), new), spaced))

    return _bind(F.replace(m, F.lit(" "), F.lit("")), solve)


def _card_ok(m: Column) -> Column:
    return _bind(digits(m), lambda d: F.length(d).between(13, 19) & m.rlike("^[0-9](?:[ -]?[0-9])*$") & (_luhn_sum(d, 1) % 10 == 0) & ~d.rlike("^(.)\\1*$"))


def _card(key: str, m: Column) -> Column:
    """Also of a match that took in the digits before or after (an expiry, a code)."""
    return _within(m, 13, _card_ok, lambda t: _whole_card(key, t))


def _whole_card(key: str, m: Column) -> Column:
    """First digit kept, the others permuted, the check digit made anew."""

    def solve(d: Column) -> Column:
        n = F.length(d)
        payload = F.concat(F.substring(d, 1, 1), permute_text(key, "card", F.substr(d, F.lit(2), n - 2)))
        whole = lambda p: F.concat(p, ((10 - _luhn_sum(p, 0) % 10) % 10).cast("string"))
        ok = n.between(13, 19) & (_luhn_sum(d, 1) % 10 == 0) & ~d.rlike("^(.)\\1*$")
        return F.when(ok, _bind(_bind(payload, whole), lambda new: _repunctuate(m, new)))

    return _bind(digits(m), solve)


def _phone_nanp(key: str, m: Column) -> Column:
    def solve(d: Column) -> Column:
        n = F.substr(d, F.length(d) - 9)
        x = F.substring(n, 1, 3).cast("int") - 200
        y = (F.substring(n, 4, 3).cast("int") - 200) * 10000 + F.substring(n, 7, 4).cast("int")
        country = F.substr(d, F.lit(1), F.length(d) - 10)
        new = lambda p: F.concat(
            country, (p["x"] + 200).cast("string"), (F.floor(p["y"] / 10000) + 200).cast("string"), F.lpad((p["y"] % 10000).cast("string"), 4, "0")
        )
        return _bind(_bind(permute_pair(key, "nanp", x, y, 800, 8_000_000), new), lambda t: _repunctuate(m, t))

    return _bind(digits(m), solve)


def _phone(key: str, m: Column) -> Column:
    """International: the first two digits stay, the rest is permuted."""

    def solve(d: Column) -> Column:
        new = F.concat(F.substring(d, 1, 2), permute_text(key, "phone", F.substr(d, F.lit(3))))
        return F.when(F.length(d).between(8, 15), _bind(new, lambda t: _repunctuate(m, t)))

    return _bind(digits(m), solve)


def _ip(key: str, m: Column) -> Column:
    def solve(o: Column) -> Column:
        at = lambda i: F.get(o, F.lit(i))
        ok = F.forall(o, lambda v: v <= 255)
        new = lambda p: F.concat_ws(
            ".", F.floor(p["x"] / 256).cast("string"), (p["x"] % 256).cast("string"), F.floor(p["y"] / 256).cast("string"), (p["y"] % 256).cast("string")
        )
        return F.when(ok, _bind(permute_pair(key, "ip", at(0) * 256 + at(1), at(2) * 256 + at(3), 65536, 65536), new))

    return _bind(F.transform(F.split(m, r"\."), lambda v: v.cast("int")), solve)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x, y = F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1
    shown = lambda p: F.concat_ws(
        "-", F.lpad((p["x"] + F.when(p["x"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"),
        F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0"),
    )
    return F.when(ok, _bind(permute_pair(key, "ssn", x, y, 898, 99 * 9999), shown))


FIRST_DAY, DAYS = "1000-01-01", (945, 773)  # to 2999-12-31, all that the patterns accept


def _date(key: str, value: Column, pattern: str) -> Column:
    first = F.to_date(F.lit(FIRST_DAY))

    def solve(day: Column) -> Column:
        n = F.datediff(day, first)
        shown = lambda p: F.date_format(F.date_add(first, (p["x"] * DAYS[1] + p["y"]).cast("int")), pattern)
        ok = F.isnotnull(day) & n.between(0, DAYS[0] * DAYS[1] - 1)
        return F.when(ok, _bind(permute_pair(key, "date", F.floor(n / DAYS[1]), n % DAYS[1], *DAYS), shown))

    return _bind(value, solve)


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date, or null if the calendar has none."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))


def _as_written(m: Column, date, pattern: str) -> Column:
    """date(pattern), without leading zeros if m has a day or month of one digit."""
    return F.when(m.rlike("(?:^|[/.])[0-9][/.]"), date(pattern.replace("dd", "d").replace("MM", "M"))).otherwise(date(pattern))


def pseudonym(key: str, m: Column) -> Column:
    """struct(kind, new) of a match; new is null if it does not pass its check."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    part = lambda i, n: F.substring(m, i, n)
    after = lambda p: F.regexp_extract(m, p, 1)
    one, two, year = (after(f"^{'[0-9]+[/.]' * i}([0-9]+)") for i in range(3))
    slash_us, slash_eu = _day(year, one, two), _day(year, two, one)
    dated = lambda day, pattern: _as_written(m, lambda p: _date(key, day, p), pattern)
    capitals = ~m.rlike("[a-z]")
    email = F.concat(permute_text(key, "email", F.lower(F.substring_index(m, "@", 1))), F.lit("@"), F.substring_index(m, "@", -1))
    assigned = r"^([^=:]*[=:]\s*)"
    rules = {
        "email": ("email", email),
        "access_key": ("secret", F.concat(F.lit("AKIA"), permute_text(key, "access", F.substr(m, F.lit(5))))),
        "password": ("secret", F.concat(after(assigned), permute_text(key, "password", F.regexp_replace(m, assigned, "")))),
        "token": ("secret", F.when(capitals, F.upper(permute_text(key, "token", F.lower(m)))).otherwise(permute_text(key, "token", m))),
        "iban": ("iban", _iban(key, m)),
        "date_iso": ("date", _date(key, _day(part(1, 4), part(6, 2), part(9, 2)), "yyyy-MM-dd")),
        "date_slash": ("date", F.when(F.isnotnull(slash_us), dated(slash_us, "MM/dd/yyyy")).otherwise(dated(slash_eu, "dd/MM/yyyy"))),
        "date_dot": ("date", dated(_day(year, two, one), "dd.MM.yyyy")),
        "ip": ("ip", _ip(key, m)),
        "ssn": ("ssn", _ssn(key, m)),
        "phone_nanp": ("phone", _phone_nanp(key, m)),
        "phone": ("phone", _phone(key, m)),
        "card": ("card", _card(key, m)),
    }
    out = None
    for name, pattern in FORMATS:
        kind, new = rules[name]
        value = F.struct(F.lit(kind).alias("kind"), new.alias("new"))
        out = F.when(whole(pattern), value) if out is None else out.when(whole(pattern), value)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_found, and n_<kind> for each kind.

    A match that fails its check stays as it is and is not counted; of cards and IBANs
    the parts between blanks or hyphens are tried before. Null text stays
    null and has no finds; so does an empty one. Rows are handled alone, so repeated
    rows give equal rows and an empty table gives none; only doc_id and text are
    read. Nothing is shuffled.
    """
    text = F.col("text").cast("string")
    candidate = text.rlike(r"[0-9@]|[Pp]assw")
    none = F.array().cast("array<struct<old:string,kind:string,new:string>>")
    finds = F.transform(
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)),
        lambda m: _bind(pseudonym(key, m), lambda p: F.struct(m.alias("old"), p["kind"].alias("kind"), p["new"].alias("new"))),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.when(candidate, finds).otherwise(none).alias("finds"))
    gaps = F.split("text", ANY)
    joined = F.array_join(F.zip_with(gaps, F.transform("finds", lambda f: F.coalesce(f["new"], f["old"])), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    count = lambda kind: F.size(F.filter("finds", lambda f: F.isnotnull(f["new"]) & (f["kind"] == kind))).cast("long")
    changed = F.exists("finds", lambda f: F.isnotnull(f["new"]))
    return rows.select(
        "doc_id",
        F.when(changed, joined).otherwise(F.col("text")).alias("text"),
        F.size(F.filter("finds", lambda f: F.isnotnull(f["new"]))).cast("long").alias("n_found"),
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
    )


def op10_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """pseudonymise() of all documents under the demonstration key; nulls, repeats and empty tables as there."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), DEMO_KEY)
