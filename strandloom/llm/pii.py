"""Format-preserving pseudonyms for personal data; native DataFrame operations only.

Each value found is validated, mapped to a pair of numbers (a, b) in a domain of
size A x B that holds exactly the valid values of its format, permuted there by a
keyed Feistel network over Z_A x Z_B, and written back in its own layout.  The map is
a bijection on the domain, so equal values get equal pseudonyms in all documents and
different values different ones, without any table or shuffle.

Kinds: payment cards (13 to 19 digits, Luhn; the first digit stays and the check
digit is computed anew), telephone numbers (ten digits of the North American plan;
an assignable area code and exchange stay so; other numbers in international form with
8 to 15 digits, whose first two digits stay), IPv4 addresses (octets up to 255), ISO dates
from 1800 to 2199 (real calendar days), e-mail addresses (the letters and digits of
the local part, the domain stays), US social security numbers (valid groups only), bank
accounts (IBAN; country and kinds of characters stay, the check digits are computed anew)
and credentials (access key ids and hexadecimal secrets of any length after a name).

The pattern has no repeated group that Java's regular expressions would match by recursion, and
unbounded runs start only where such a run begins: time is linear in the text, the stack flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the 400-year calendar cycle from 1800-01-01, as 27 x 5411.
FIRST_DAY, DAYS = "1800-01-01", (27, 5411)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]*\.[A-Za-z]{2,24}"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d-])(?:1[89]|2[01])\d\d-[01]\d-[0-3]\d(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (r"(?<![\d+])(?:\+1 ?\(\d{3}\) ?\d{3}[ .-]\d{4}|\+1[2-9]\d{2}[2-9]\d{6}|"
         r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4})(?!\d)")
ABROAD = r"(?<![\d+])\+[2-9]\d(?:[ .-]?\(?\d\)?){6,13}(?!\d)"
CARD = r"(?<![\d.-])(?:\d{13,19}(?!\d)|\d(?:[ -]?\d){12,18}(?!\d))(?![.-]\d)"
KEY_ID = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SECRET = r"(?<=[=:]|[=:] |[=:]\"|[=: ]\")[A-Fa-f0-9]{16,}+(?![A-Za-z0-9])"
#: In this order; the first that matches at a place takes it.
ANY = "|".join((EMAIL, SECRET, IPV4, DATE, SSN, PHONE, ABROAD, CARD, KEY_ID, IBAN))


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: str) -> Column:
    """``struct(a, b)`` after ``ROUNDS`` keyed rounds that add to each half, in turn, a hash of the other."""
    def noise(x: Column, i: Column) -> Column:
        digest = F.md5(F.concat(F.lit(f"{key}:{tweak}:"), i.cast("string"), F.lit(":"), x.cast("string")))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        # halves stay below 10**18, so that the sums stay below 2**63
        a2 = F.when(even, F.pmod(s["a"] + F.pmod(noise(s["b"], i), size_a), size_a)).otherwise(s["a"])
        b2 = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(noise(s["a"], i), size_b), size_b))
        return F.struct(a2.alias("a"), b2.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _big(x: int) -> Column:
    return F.lit(x).cast("long")


def _sub(s: Column, start, length) -> Column:
    """Substring from a 0-based place; both may be columns."""
    one = F.lit(1)
    return F.substr(s, (F.lit(start) if isinstance(start, int) else start) + one,
                    F.lit(length) if isinstance(length, int) else length)


def permute_string(s: Column, radix: int, key: str, tweak: str) -> Column:
    """Permute a string of base-``radix`` digits (0-9a-z) of a length whose halves fit 63 bits."""
    n = F.length(s)
    u = F.floor(n / 2).cast("int")
    v = n - u
    size = lambda k: F.element_at(F.array(*[_big(radix ** i) for i in range(_half(radix) + 1)]), k + 1)
    num = lambda x: F.coalesce(F.conv(x, radix, 10).try_cast("long"), _big(0))
    back = lambda x, k: F.when(k == 0, F.lit("")).otherwise(F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), k, F.lit("0")))
    p = feistel(num(_sub(s, 0, u)), num(_sub(s, u, v)), size(u), size(v), key, f"{tweak}{radix}")
    return F.concat(back(p["a"], u), back(p["b"], v))


def _half(radix: int) -> int:
    """Digits whose numbers stay below 10**18."""
    n = 0
    while radix ** (n + 1) <= 10 ** 18:
        n += 1
    return n


def _layout(value: Column, digits: Column, places: str = "[0-9]") -> Column:
    """Write ``digits`` into the digit places of ``value`` (a short one), left to right."""
    chars = F.split(value, "")
    step = lambda s, c: F.when(c.rlike(places), F.struct(
        F.concat(s["out"], F.substr(digits, s["i"] + 1, F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step)["out"]


def luhn_digit(body: Column) -> Column:
    """Check digit that makes ``body`` followed by it pass the Luhn test."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(
        i % 2 == 0, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("string")


def _card(v: Column, key: str) -> Column:
    """The longest run of whole digit groups (the first of those) that is a valid number is replaced."""
    d = F.regexp_replace(v, "[ -]", "")
    cuts = F.aggregate(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), F.array(F.lit(0)),
                       lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(g))))
    windows = F.flatten(F.transform(F.filter(cuts, lambda i: i <= F.length(d) - 13), lambda i: F.transform(
        F.filter(cuts, lambda j: (j - i).between(13, 19)), lambda j: F.struct((j - i).alias("size"), (-i).alias("at"), _sub(d, i, j - i).alias("body")))))
    fits = F.filter(windows, lambda w: luhn_digit(_sub(w["body"], 0, w["size"] - 1)) == F.substr(w["body"], w["size"], F.lit(1)))
    new = F.transform(F.slice(F.reverse(F.array_sort(fits)), 1, 1), lambda w: F.concat(
        _sub(d, 0, -w["at"]), _card_digits(w["body"], key), F.substr(d, w["size"] - w["at"] + 1)))
    return F.when(F.size(new) > 0, _layout(v, F.get(new, F.lit(0)))).otherwise(v)


def _card_digits(d: Column, key: str) -> Column:
    body = F.concat(_sub(d, 0, 1), permute_string(_sub(d, 1, F.length(d) - 2), 10, key, "card"))
    return F.concat(body, luhn_digit(body))


def _abroad(v: Column, key: str) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(d)
    return F.when(n.between(8, 15), _layout(v, F.concat(_sub(d, 0, 2), permute_string(_sub(d, 2, n - 2), 10, key, "abroad")))).otherwise(v)


def _mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals, a capital counting as 10 to 35."""
    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: step(acc, c).cast("int"))


def _iban(v: Column, key: str) -> Column:
    """Runs of digits and runs of capitals of the account are permuted; blanks stay where they are.  Null if invalid."""
    flat = F.replace(v, F.lit(" "), F.lit(""))
    country, account = _sub(flat, 0, 2), F.substr(flat, F.lit(5))
    base26, letters = "0123456789abcdefghijklmnop", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(account, F.lit("[A-Z]{1,24}|[0-9]{1,30}"), F.lit(0))
    alpha = lambda r: F.translate(permute_string(F.translate(r, letters, base26), 26, key, "iban"), base26, letters)
    new = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A-Z]"), alpha(r)).otherwise(permute_string(r, 10, key, "iban"))), "")
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = F.length(flat).between(15, 34) & (_mod97(F.concat(account, _sub(flat, 0, 4))) == 1)
    return F.when(valid, _layout(v, F.concat(country, check, new), "[0-9A-Z]"))


def _phone(v: Column, key: str) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    d = F.substr(d, F.length(d) - 9, F.lit(10))
    num = lambda i, n: _sub(d, i, n).cast("long")
    area, exchange = num(0, 3), num(3, 3)
    # (lowest area, lowest exchange, exchanges, areas) of three disjoint domains: assignable numbers, and
    # two kinds that only the layout +1 (ddd) ddd-dddd makes a number
    kinds = [((area >= 200) & (exchange >= 200), 200, 200, 800, 800), (area >= 200, 200, 0, 200, 800), (F.lit(True), 0, 0, 1000, 200)]
    digits = None
    for test, a0, e0, n_e, n_a in reversed(kinds):
        p = feistel((area - a0) * n_e + exchange - e0, num(6, 4), _big(n_a * n_e), _big(10000), key, f"phone{n_e}")
        own = F.concat(F.lpad((F.floor(p["a"] / n_e) + a0).cast("string"), 3, "0"), F.lpad((p["a"] % n_e + e0).cast("string"), 3, "0"),
                       F.lpad(p["b"].cast("string"), 4, "0"))
        digits = own if digits is None else F.when(test, own).otherwise(digits)
    lead = F.regexp_extract(v, r"^(\+?1[ .-]?(?=\(|[2-9])|)", 1)
    return F.concat(lead, _layout(F.substr(v, F.length(lead) + 1), digits))


def _ipv4(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], _big(65536), _big(65536), key, "ip")
    parts = [F.floor(p[h] / 256) if hi else p[h] % 256 for h in "ab" for hi in (True, False)]
    return F.when(~F.exists(o, lambda x: x > 255), F.concat_ws(".", *[x.cast("string") for x in parts])).otherwise(v)


def _date(v: Column, key: str) -> Column:
    n = F.datediff(v.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    p = feistel(F.floor(n / DAYS[1]), n % DAYS[1], _big(DAYS[0]), _big(DAYS[1]), key, "date")
    return F.when(n.isNotNull(), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int")), "yyyy-MM-dd")).otherwise(v)


def _ssn(v: Column, key: str) -> Column:
    part = [x.cast("long") for x in (_sub(v, 0, 3), _sub(v, 4, 2), _sub(v, 7, 4))]
    area = part[0] - F.when(part[0] > 666, 2).otherwise(1)  # 001-665, 667-899 -> 0-897
    p = feistel(area * 99 + part[1] - 1, part[2] - 1, _big(898 * 99), _big(9999), key, "ssn")
    back = F.floor(p["a"] / 99) + F.when(F.floor(p["a"] / 99) >= 665, 2).otherwise(1)
    pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
    valid = (part[0] > 0) & (part[0] != 666) & (part[0] < 900) & (part[1] > 0) & (part[2] > 0)
    return F.when(valid, F.concat_ws("-", pad(back, 3), pad(p["a"] % 99 + 1, 2), pad(p["b"] + 1, 4))).otherwise(v)


def _email(v: Column, key: str) -> Column:
    base26, letters = "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz"
    local = F.lower(F.substring_index(v, "@", 1))
    runs = F.regexp_extract_all(local, F.lit(r"[a-z]{1,24}|[0-9]{1,30}|[^a-z0-9]+"), F.lit(0))
    alpha = lambda r: F.translate(permute_string(F.translate(r, letters, base26), 26, key, "mail"), base26, letters)
    new = F.transform(runs, lambda r: F.when(r.rlike("^[a-z]"), alpha(r)).when(r.rlike("^[0-9]"), permute_string(r, 10, key, "mail")).otherwise(r))
    return F.concat(F.array_join(new, ""), F.substr(v, F.instr(v, "@")))


def _key_id(v: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(permute_string(F.lower(_sub(v, 4, 16)), 36, key, "key")))


def _secret(v: Column, key: str) -> Column:
    """Pieces of 28 digits; capitals stay capitals (a value that mixes both comes in small letters)."""
    runs = F.regexp_extract_all(F.lower(v), F.lit("[a-f0-9]{1,28}"), F.lit(0))
    new = F.array_join(F.transform(runs, lambda r: permute_string(r, 16, key, "hex")), "")
    return F.when(v.rlike("^[A-F0-9]*[A-F][A-F0-9]*$"), F.upper(new)).otherwise(new)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one matched value; a value that fails its kind's validation stays."""
    full = lambda p: value.rlike(f"^(?:{p})$")
    iban = F.when(full(r"[A-Z]{2}\d\d[A-Z0-9 ]{11,41}"), _iban(value, key))
    return (F.when(value.contains("@"), _email(value, key))
            .when(full(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), _ipv4(value, key))
            .when(full(r"\d{4}-\d\d-\d\d"), _date(value, key))
            .when(full(r"\d{3}-\d\d-\d{4}"), _ssn(value, key))
            .when(value.startswith("AKIA"), _key_id(value, key))
            .when(iban.isNotNull(), iban)
            .when(full(r"[A-Fa-f0-9]{16,}") & ~full(r"\d{16,19}"), _secret(value, key))
            .when(full(r"\d(?:[ -]?\d){12,18}"), _card(value, key))
            .when(full(r"\+[2-9][-0-9 .()]+"), _abroad(value, key))
            .when(full(r"[-+0-9 .()]+"), _phone(value, key))
            .otherwise(value))


def pseudonymize(docs: DataFrame, text_col: str = "text", *, key: str) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` rewritten, plus ``n_found`` (values replaced).

    A null text stays null and an empty one empty, with ``n_found`` 0.  Whole texts are searched;
    repeated values and rows get the same pseudonyms.  Everything is computed within the row, with no
    shuffle.  An input column named ``n_found`` is replaced.  ``key`` is the secret of the permutation.
    """
    text = F.col(f"`{text_col}`").cast("string")
    found = F.when(text.rlike("[0-9@]|[=:] ?\"?[A-Fa-f]{16}"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    x = docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    x = x.withColumn("_new", F.transform("_found", lambda v: pseudonym(v, key)))
    parts = F.zip_with(F.split(text, ANY, -1), F.concat(F.col("_new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    out = F.when(F.size("_found") > 0, F.array_join(parts, "")).otherwise(text)
    n = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda c: c)).cast("long")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_found")]
    return x.select(*keep, out.alias(text_col), n.alias("n_found"))
