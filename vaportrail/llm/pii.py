"""Personal data to format-preserving pseudonyms: validated numbers and dates are keyed permutations within their format.

DataFrame functions only.

A number's digits (or a date's day, an address's bits) are two halves; in each round of a Feistel network one half is
shifted by a keyed hash of the other. That permutes all values of a format, so equal values keep equal pseudonyms in all
documents, different ones stay different, and whoever has the key can go back.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_QUADS = r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"  # the usual grouping of a card
# fixed values: forms that are looked at, in the order in which they are tried at a place
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date": r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "card": rf"(?<![0-9-])(?:{_QUADS}(?:[ -][0-9]{{1,4}}(?![0-9-])){{0,200}}|[0-9](?:(?![ -]?{_QUADS})[ -]?[0-9]){{12,18}})(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
ANY = "|".join(FORMS.values()).replace(r"([./])", r"(?:[./])").replace(r"\1", r"[./]")
# what every form holds; texts without are passed on unread
HINT = "[0-9@]"
CYCLE_START = "1800-01-01"  # dates of 400 years, 146,097 = 189 * 773 days, are permuted among themselves
DATE_HALVES = (189, 773)
# area 001-665 and 667-899, group 01-99, serial 0001-9999
SSN_HALVES = (898, 99 * 9999)

_long = lambda c: c.cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, label: str, back: bool = False) -> Column:
    """struct(a, b), permuted within [0, size_a) x [0, size_b); ``back`` undoes it."""

    def shift(other: Column, number: Column, size: Column) -> Column:
        said = F.concat_ws(":", F.lit(key), F.lit(label), size_a.cast("string"), size_b.cast("string"), number.cast("string"), other.cast("string"))
        amount = _long(F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10))
        return -amount if back else amount

    def step(state: Column, number: Column) -> Column:
        left = number % 2 == 0
        return F.struct(
            F.when(left, F.pmod(state["a"] + shift(state["b"], number, size_a), size_a)).otherwise(state["a"]).alias("a"),
            F.when(left, state["b"]).otherwise(F.pmod(state["b"] + shift(state["a"], number, size_b), size_b)).alias("b"),
        )

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(_long(a).alias("a"), _long(b).alias("b")), step)


def _power(n: Column) -> Column:
    return F.get(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permuted_digits(digits: Column, key: str, label: str, back: bool = False) -> Column:
    """A string of up to 36 digits to another of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    number = lambda s: _long(F.when(F.length(s) > 0, s).otherwise("0"))
    mixed = feistel(
        number(F.substring(digits, F.lit(1), half)), number(F.substring(digits, half + 1, rest)), _power(half), _power(rest), key, label, back
    )
    pad = lambda n, width: F.when(width > 0, F.lpad(n.cast("string"), width, F.lit("0"))).otherwise("")
    return _let(mixed, lambda m: F.concat(pad(m["a"], half), pad(m["b"], rest)))


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def refilled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(_chars(form), state, step, lambda s: s["out"])


def check_digit(digits: Column) -> Column:
    """Luhn's digit for what stands before it."""
    doubled = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda t, d: t + d)
    return F.pmod(-total, F.lit(10)).cast("string")


def mod_97(iban: Column) -> Column:
    """Remainder of an IBAN as one number, its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(t: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (t * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(_chars(turned), F.lit(0), step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _part(s: Column, start, length=None) -> Column:
    """Characters from ``start``, counted from 1; to the end without a length."""
    return F.substring(s, F.lit(start), F.length(s) if length is None else F.lit(length))


def _split_halves(n: Column, halves: tuple[int, int]) -> tuple[Column, Column]:
    return F.floor(n / halves[1]), n % halves[1]


def _mixed_number(n: Column, halves: tuple[int, int], key: str, label: str, back: bool) -> Column:
    a, b = _split_halves(n, halves)
    sizes = [F.lit(h).cast("long") for h in halves]
    return _let(feistel(a, b, *sizes, key, label, back), lambda m: m["a"] * halves[1] + m["b"])


def _card(m: Column, key: str, back: bool) -> Column:
    """First digit and separators stay, the last is Luhn's; null without a number that passes the test.

    Other numbers may stand beside a card: tried are all runs of 13 to 19 digits between separators, the leftmost and
    longest first, that do not overlap.
    """

    def renumber(d: Column) -> Column:
        body = F.substring(d, F.lit(2), F.length(d) - 2)
        mixed = F.concat(_part(d, 1, 1), permuted_digits(body, key, "card", back))
        return _let(mixed, lambda x: F.concat(x, check_digit(x)))

    valid = lambda d: (check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1)) & ~d.rlike("^0+$")
    none = F.array(F.lit(0))
    edges = F.aggregate(
        F.split(m, "[ -]"), none, lambda at, group: F.concat(at, F.array(F.element_at(at, -1) + F.length(group)))
    )

    def runs(at: Column) -> Column:
        ends = lambda a: F.reverse(F.filter(at, lambda z: (z - a).between(13, 19)))
        return F.flatten(F.transform(at, lambda a: F.transform(ends(a), lambda z: F.struct(a.alias("a"), z.alias("z")))))

    def renumbered(d: Column, found: Column) -> Column:
        def put(state: Column, run: Column) -> Column:
            own = F.substring(d, run["a"] + 1, run["z"] - run["a"])
            said = F.concat(
                F.substring(state["d"], F.lit(1), run["a"]), renumber(own), F.substring(state["d"], run["z"] + 1, F.length(d))
            )
            return F.when(run["a"] >= state["free"], F.struct(said.alias("d"), run["z"].alias("free"))).otherwise(state)

        return F.aggregate(found, F.struct(d.alias("d"), F.lit(0).alias("free")), put)["d"]

    def within(d: Column) -> Column:
        passing = F.filter(runs(edges), lambda r: valid(F.substring(d, r["a"] + 1, r["z"] - r["a"])))
        return _let(passing, lambda found: F.when(F.size(found) > 0, refilled(m, renumbered(d, found))))

    return _let(_digits(m), within)


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    halves = lambda p: (F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)))
    size = F.lit(1 << 16).cast("long")
    dotted = lambda x: F.concat_ws(".", *[F.floor(x[h] / d) % 256 for h in ("a", "b") for d in (256, 1)])
    return _let(
        parts,
        lambda p: F.when(F.forall(p, lambda o: o <= 255), _let(feistel(*halves(p), size, size, key, "ip", back), dotted)),
    )


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (_long(F.get(F.split(m, "-"), F.lit(i))) for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    sizes = [F.lit(h).cast("long") for h in SSN_HALVES]

    def written(x: Column) -> Column:
        shown = [
            (x["a"] + 1 + F.when(x["a"] >= 665, 1).otherwise(0), 3),
            (F.floor(x["b"] / 9999) + 1, 2),
            (x["b"] % 9999 + 1, 4),
        ]
        return F.concat_ws("-", *[F.lpad(v.cast("string"), w, "0") for v, w in shown])

    return F.when(valid, _let(feistel(rank, (group - 1) * 9999 + serial - 1, *sizes, key, "ssn", back), written))


def _date(m: Column, form: str, key: str, back: bool) -> Column:
    """Another day of the same 400 years, in the same form; null for days that do not exist or lie outside."""
    start = F.to_date(F.lit(CYCLE_START))
    day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), start)
    inside = (day >= 0) & (day < DATE_HALVES[0] * DATE_HALVES[1])
    moved = lambda d: F.date_format(F.date_add(start, _mixed_number(d, DATE_HALVES, key, "date", back).cast("int")), form)
    return F.when(inside, _let(_long(day), moved))


def _phone(m: Column, key: str, back: bool) -> Column:
    """The country code stays."""
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, refilled(rest, permuted_digits(_digits(rest), key, "phone", back)))


def _iban(m: Column, key: str, back: bool) -> Column:
    """Country and letters stay, the check digits are worked out anew; null if they were wrong."""

    def renumber(bban: Column) -> Column:
        form = F.concat(_part(m, 1, 2), F.lit("00"), refilled(bban, permuted_digits(_digits(bban), key, "iban", back)))
        return _let(
            form,
            lambda x: F.concat(_part(x, 1, 2), F.lpad((98 - mod_97(x)).cast("string"), 2, "0"), _part(x, 5)),
        )

    return F.when(mod_97(m) == 1, renumber(_part(m, 5)))


def _email(m: Column, key: str) -> Column:
    """A keyed name in place of the local part; the domain stays. One way: names have no bounded format to permute in."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    name = F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(local), F.lower(domain)), 256), 1, 16)
    return F.concat(F.lit("u"), name, F.lit("@"), domain)


def pseudonym(found: Column, key: str, back: bool = False) -> Column:
    """struct(kind, said): the pseudonym of a find, or the find itself with a null kind if it fails validation."""
    is_form = lambda kind: found.rlike(f"^(?:{FORMS[kind]})$")
    dotted = found.contains(".")
    made = {
        "email": found if back else _email(found, key),
        "ip": _ip(found, key, back),
        "iso_date": _date(found, "yyyy-MM-dd", key, back),
        "date": F.when(dotted, _date(found, "dd.MM.yyyy", key, back)).otherwise(_date(found, "dd/MM/yyyy", key, back)),
        "ssn": _ssn(found, key, back),
        "phone": _phone(found, key, back),
        "card": _card(found, key, back),
        "iban": _iban(found, key, back),
    }

    def told(kind: str) -> Column:
        named = lambda s: F.struct(F.when(s.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(s, found).alias("said"))
        return _let(made[kind], named)

    first, *others = FORMS
    choice = F.when(is_form(first), told(first))
    for kind in others:
        choice = choice.when(is_form(kind), told(kind))
    return choice.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), found.alias("said")))


def pseudonymise(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False
) -> DataFrame:
    """(id, text, n_pseudonyms, kinds) of every row, in its place: no shuffle.

    ``kinds`` lists the kind of each replaced find in the order of the text. Replaced are e-mail addresses (the local
    part, one way), IPv4 addresses, dates (year-month-day, or day, month, year between dots or slashes, from 1800 to
    2199), US social security numbers, phone numbers with a plus or in the US forms, payment card numbers with a right
    Luhn digit, and IBANs with right check digits.
    Finds that fail their test (octets over 255, days that do not exist, wrong check digits) stay.

    ``back`` turns pseudonyms of the same key into the values they stand for, but for e-mail names.

    Null texts stay null with 0 pseudonyms, empty ones empty; null ids and repeated rows come out as they came in; other
    columns are ignored. Whole texts are searched, whatever their length.
    """
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_text"))
    hinted = F.coalesce(F.col("_text").rlike(HINT), F.lit(False))
    none = F.array().cast("array<string>")
    finds = F.when(hinted, F.regexp_extract_all("_text", F.lit(f"({ANY})"), 1)).otherwise(none)
    replaced = F.transform("_finds", lambda f: pseudonym(f, key, back))
    pieces = F.split("_text", ANY, -1)
    closed = F.concat(F.transform("_made", lambda m: m["said"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.flatten(F.zip_with(pieces, closed, lambda p, s: F.array(p, s))), "")
    kinds = F.filter(F.transform("_made", lambda m: m["kind"]), lambda k: k.isNotNull())
    found = rows.withColumn("_finds", finds).select("_id", "_text", replaced.alias("_made"))
    return found.select(
        F.col("_id").alias(id_col),
        F.when(F.size("_made") > 0, rebuilt).otherwise(F.col("_text")).alias(text_col),
        F.size(kinds).cast("long").alias("n_pseudonyms"),
        F.array_join(kinds, ",").alias("kinds"),
    )
