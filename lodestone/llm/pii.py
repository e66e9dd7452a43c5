"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern, then validated: payment cards by length
and Luhn digit, IBANs by their check digits, US social security numbers by
their reserved ranges, IPv4 addresses by their octets, dates by the calendar
(1800 to 2199), e-mail addresses by their form, and telephone numbers by theirs
(of ten digits that are all the same none is a number; area codes aren't looked
up, since mistyped and invented numbers are as personal as others, and
pseudonyms may have area codes that don't exist). Letters of any script, digits
and underscores around a number or date make it part of a longer name, which stays.
What fails validation stays as it is. A valid value is permuted by a keyed Feistel
network within its format: a card stays a card of the same length and first
digit with a right check digit, a date stays a date in the same notation, and so
on. Permutations are bijections, and they start from the bare value, so that
equal values get equal pseudonyms in all documents, however they are written. A
permutation may map a value to itself, which in a small format isn't rare (a mail
name of one letter, 1 in 26); the host of an e-mail address stays readable.
``reverse=True`` undoes the operation with the same key (but for the zeros that
pad a day or month).

A row is handled by itself: nothing is shuffled. Defined cases: a null text
stays null with no counts; an empty text stays empty; an empty table gives no
rows; repeated rows get equal results; where several kinds fit at one place, the
first of ``PATTERNS`` is taken; other columns stay whatever their names, but for
one named ``pii_counts``; month-first is read from ``m/d/yyyy``, day-first where
only that is a date or where dots or hyphens separate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_DAY0, _A, _B = "1800-01-01", 189, 773  # 400 years have 189 * 773 days
_MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = r"\p{L}\p{M}\p{N}_"  # letters, of any script, their marks, digits and underscores
_AHEAD, _BEHIND = f"(?![{_NAME}])", f"(?<![{_NAME}])"
# In the order of preference at one place. Runs are bounded or possessive, so that no text takes more than linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": rf"(?<![{_NAME}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![{_NAME}]|\.[0-9])",
    "date": rf"{_BEHIND}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?![{_NAME}&&[^T]]|-)|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}(?![{_NAME}/])|[0-9]{{1,2}}([./-])[0-9]{{1,2}}\1[0-9]{{4}}{_AHEAD}|[0-9]{{1,2}} {_MONTHS} [0-9]{{4}}{_AHEAD}|{_MONTHS} [0-9]{{1,2}}, [0-9]{{4}}{_AHEAD})",
    "iban": rf"{_BEHIND}[A-Z]{{2}}[0-9]{{2}}(?:(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,4}})?|[A-Z0-9]{{11,30}}){_AHEAD}",
    "ssn": rf"(?<![{_NAME}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![{_NAME}-])",
    "card": rf"(?<![{_NAME}.])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_AHEAD}",
    "phone": rf"(?<![{_NAME}+])(?:\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}([.-])[0-9]{{3}}\2[0-9]{{4}}|\+[2-9](?:[ .-]?[0-9]){{7,13}}){_AHEAD}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "d MMMM yyyy", "MMMM d, yyyy"]


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 512)


def _number(key: str, *parts) -> Column:
    return F.conv(F.substring(_hash(key, *parts), 1, 12), 16, 10).cast("long")


def _rounds(reverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if reverse else F.sequence(F.lit(1), F.lit(ROUNDS))


def _shift(text: Column, digest: Column, sign: int) -> Column:
    """Moves each digit and letter on within its own class, by the digest's bytes."""

    def move(c: Column, i: Column) -> Column:
        step = F.conv(F.substr(digest, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        turn = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + step, F.lit(n)))
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permute_text(text: Column, key: str, tag: str, reverse: bool = False) -> Column:
    """A permutation of the texts with the same length and classes of characters.

    A Feistel network: in each round one half is moved by the digest of the
    other, and they change places. The number of rounds is even, so the halves
    end in their own places.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))

    def step(s: Column, r: Column) -> Column:
        if reverse:
            return F.struct(_shift(s["b"], _hash(key, tag, r, s["a"]), -1).alias("a"), s["a"].alias("b"))
        return F.struct(s["b"].alias("a"), _shift(s["a"], _hash(key, tag, r, s["b"]), 1).alias("b"))

    return F.aggregate(_rounds(reverse), start, step, lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, a: int, b: int, key: str, tag: str, reverse: bool = False) -> Column:
    """A permutation of the whole numbers below ``a * b``: a Feistel network of residues modulo a and b."""
    value = value.cast("long")
    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).alias("r"))

    def step(s: Column, r: Column) -> Column:
        if reverse:
            return _let(F.pmod(s["r"] - _number(key, tag, "r", r, s["l"]), F.lit(b)), lambda x: F.struct(F.pmod(s["l"] - _number(key, tag, "l", r, x), F.lit(a)).alias("l"), x.alias("r")))
        return _let(F.pmod(s["l"] + _number(key, tag, "l", r, s["r"]), F.lit(a)), lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + _number(key, tag, "r", r, x), F.lit(b)).alias("r")))

    return F.aggregate(_rounds(reverse), start, step, lambda s: s["l"] * b + s["r"])


def _bare(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9A-Za-z]", "")


def _dressed(t: Column, bare: Column) -> Column:
    """The bare value in the notation of ``t``: its separators in their places."""
    return _let(bare, lambda new: F.array_join(F.transform(F.split(t, ""), lambda c, i: F.when(c.rlike("^[0-9A-Za-z]$"), F.substr(new, F.length(_bare(F.substr(t, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def _capitals(t: Column, new: Column) -> Column:
    """The text ``new`` with capitals in the places where ``t`` has them."""
    return _let(new, lambda x: F.array_join(F.transform(F.split(t, ""), lambda c, i: F.when(c.rlike("^[A-Z]$"), F.upper(F.substr(x, i + 1, F.lit(1)))).otherwise(F.substr(x, i + 1, F.lit(1)))), ""))


def _mod97(bare: Column) -> Column:
    """The remainder that a valid IBAN has 1 of."""
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda s, c: _let(value(c), lambda v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _date(t: Column) -> Column:
    """The first notation in which ``t`` is a date of the 400 years, and that date."""
    shapes = [r"^\d{4}-", r"^\d{4}/", r"^\d{1,2}/", r"^\d{1,2}/", r"^\d{1,2}\.", r"^\d{1,2}-", r"^\d{1,2} ", "^[A-Z]"]
    tries = F.array(*[F.struct(F.lit(f).alias("f"), F.when(t.rlike(s), F.to_date(F.try_to_timestamp(t, F.lit(f)))).alias("d")) for f, s in zip(_FORMATS, shapes, strict=True)])
    return F.get(F.filter(tries, lambda x: x["d"].between(F.lit(_DAY0).cast("date"), F.lit("2199-12-31").cast("date"))), F.lit(0))


def _written(date: Column, notation: Column, t: Column) -> Column:
    """The date in a notation; one- or two-digit fields are padded if those of ``t`` are not all single digits."""
    single = t.rlike("(^|[^0-9])[0-9]([^0-9]|$)")
    out = None
    for f in _FORMATS:
        padded = f.replace("M/d/", "MM/dd/").replace("d/M/", "dd/MM/").replace("d.M.", "dd.MM.").replace("d-M-", "dd-MM-").replace("d MMMM", "dd MMMM").replace("MMMM d,", "MMMM dd,") if not f.startswith("y") else f
        value = F.when(single, F.date_format(date, f)).otherwise(F.date_format(date, padded))
        out = F.when(notation == f, value) if out is None else out.when(notation == f, value)
    return out


def pseudonym(t: Column, key: str, reverse: bool = False) -> Column:
    """``kind`` and ``value`` (the pseudonym) of a candidate; kind is null and the value unchanged if it isn't valid."""
    is_ = lambda kind: t.rlike(f"^(?:{PATTERNS[kind].replace(chr(92) + '2', chr(92) + '1')})$")
    permuted = lambda x, tag: permute_text(x, key, tag, reverse)
    out = lambda kind, value: F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"))

    # Capitals mean nothing in a mail name: they are put back where they stood.
    name = F.substring_index(t, "@", 1)
    email = F.concat(_capitals(name, permuted(F.lower(name), "email")), F.lit("@"), F.substring_index(t, "@", -1))
    octet = lambda k: F.get(F.split(t, r"\."), F.lit(k)).cast("long")
    address = permute_number(((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3), 1 << 16, 1 << 16, key, "ip", reverse)
    ip = _let(address, lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
    day = lambda d: permute_number(F.datediff(d, F.lit(_DAY0).cast("date")), _A, _B, key, "date", reverse)
    date = _let(_date(t), lambda x: F.when(x["d"].isNotNull(), _written(F.date_add(F.lit(_DAY0).cast("date"), day(x["d"]).cast("int")), x["f"], t)))
    bare = _bare(t)
    iban = _let(F.concat(F.substring(bare, 1, 2), F.lit("00"), permuted(F.substr(bare, F.lit(5)), "iban")), lambda x: F.concat(F.substring(x, 1, 2), F.lpad((98 - _mod97(x)).cast("string"), 2, "0"), F.substr(x, F.lit(5))))
    area, group, serial = (F.substring(bare, *x).cast("int") for x in ((1, 3), (4, 2), (6, 4)))
    valid_ssn = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = ((area - 1 - (area > 666).cast("int")) * 99 + group - 1) * F.lit(9999).cast("long") + serial - 1
    two = lambda v, n: F.lpad(v.cast("int").cast("string"), n, "0")
    ssn = _let(permute_number(place, 898 * 99, 9999, key, "ssn", reverse), lambda v: _let(F.floor(v / (9999 * 99)) + 1, lambda a: F.concat_ws("-", two(a + (a >= 666).cast("int"), 3), two(F.floor(v / 9999) % 99 + 1, 2), two(v % 9999 + 1, 4))))
    body = F.concat(F.substring(bare, 1, 1), permuted(F.substr(bare, F.lit(2), F.length(bare) - 2), "card"))
    card = _let(body, lambda x: F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(x, d.cast("string"))), lambda c: F.call_function("luhn_check", c)), F.lit(0)))
    core = F.when((F.length(bare) == 11) & t.startswith("+1"), 10).when(~t.startswith("+"), 10).otherwise(F.length(bare) - 1)
    phone = F.concat(F.substr(bare, F.lit(1), F.length(bare) - core), permuted(F.substr(bare, F.length(bare) - core + 1), "phone"))
    return (
        F.when(is_("email"), out("email", email))
        .when(is_("ip"), out("ip", ip))
        .when(is_("date"), _let(date, lambda d: F.when(d.isNotNull(), out("date", d)).otherwise(out(None, t))))
        .when(is_("iban") & (_mod97(bare) == 1), out("iban", _dressed(t, iban)))
        .when(is_("ssn") & valid_ssn, out("ssn", ssn))
        .when(is_("card") & F.call_function("luhn_check", bare), out("card", _dressed(t, card)))
        .when(is_("phone") & ~F.substr(bare, F.length(bare) - core + 1).rlike(r"^([0-9])\1*$"), out("phone", _dressed(t, phone)))
        .otherwise(out(None, t))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", reverse: bool = False) -> DataFrame:
    """The documents with ``text`` pseudonymised and ``pii_counts map<string, int>`` of the kinds found.

    All other columns stay as they are, but for one named ``pii_counts``.
    """
    own = "_found"
    while own in docs.columns:
        own += "_"
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), lambda t: pseudonym(t, key, reverse))
    gaps = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.transform(own, lambda x: x["value"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    count = lambda kind: F.size(F.filter(own, lambda x: x["kind"] == kind))
    marked = docs.withColumn(own, F.when(F.col(text).rlike("[0-9@]"), found))
    counts = F.map_filter(F.create_map(*[x for k in PATTERNS for x in (F.lit(k), F.greatest(count(k), F.lit(0)))]), lambda _, n: n > 0)
    return marked.withColumns({text: F.when(F.size(own) > 0, joined).otherwise(F.col(text)), "pii_counts": F.coalesce(counts, F.create_map().cast("map<string,int>"))}).drop(own)
