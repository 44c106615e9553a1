"""Pseudonyms for personal data that keep its format, by a keyed Feistel network.

Found values are validated (check digits, ranges, calendar) and then permuted within their
format: a value is read as symbols, each of a given radix; a Feistel network over the two
halves of the symbols, with keyed SHA-256 as its round function, permutes all values of that
format among themselves; check digits are made anew. Equal values so get equal pseudonyms in
all documents, different ones different pseudonyms, and nothing has to be stored or joined:
the operator is one projection without a shuffle.

What is permuted: the local part of e-mail addresses, phone numbers after the country code,
card numbers (Luhn), IBANs (mod 97, country kept), US social security numbers, IPv4 and IPv6
addresses, and dates from 1800 to 2199, whose 146097 days are one cycle of the calendar.
An IBAN ends where its country's length says; a date may be followed by a time; dates with a part of
one digit are written without leading zeros. Of letters beyond ASCII, each moves within its 32
neighbours.

Kinds are looked for one after the other, those with check digits before those that many numbers
look like. A kind is tried from every group of a number on, and takes only what is valid. So what
fails its check hides nothing: it is left to the kinds that follow, and in the end as it is. Texts in
which no kind's pattern is found are passed on after one search.

Defined results: a null text stays null with no finds; letter case and separators stay as
they are. Repeated rows are treated alike. Extra columns stay; a column with the name of a
result is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "change-me"  # of production: from a secret store, as a parameter
ROUNDS = 8
DAYS, FIRST_DAY = 146097, "1800-01-01"
DAY_RADIX = 773  # 146097 = 189 * 773

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = r"(?:18|19|20|21)[0-9]{2}", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12][0-9]|3[01])"
_CLEAR, _AHEAD = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"

# The characters of an IBAN by its country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
# Fixed value: the telephone country codes, of which none begins another.
CALLING = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _iban(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    tail = rf"[ -]?[A-Za-z0-9]{{{rest}}}" if rest else ""
    names = countries.replace(" ", "|")
    return rf"(?i:{names})[0-9]{{2}}(?:[ -]?[A-Za-z0-9]{{4}}){{{groups}}}{tail}"


_HEX = "[0-9A-Fa-f]{1,4}"
_NAME = r"[\p{L}\p{N}._%+-]"

# By kind: what stands before, the value, and what follows; in the order in which they are taken.
KINDS = {
    "email": (rf"(?<!{_NAME})", rf"{_NAME}+@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)+", ""),
    "iban": (_CLEAR, "|".join(_iban(length, names) for length, names in IBAN_LENGTHS.items()), _AHEAD),
    # Other countries' are of any length.
    "other iban": (_CLEAR, r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _AHEAD),
    "card": (
        r"(?<![0-9A-Za-z+])",
        r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}",
        _AHEAD,
    ),
    "ip": (r"(?<![0-9A-Za-z.])", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"(?![0-9A-Za-z]|\.[0-9])"),
    "ipv6": (
        r"(?<![0-9A-Za-z:.])",
        # All eight groups; or fewer, of which the first has a digit, with one gap.
        rf"(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f]{{0,3}}[0-9])(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}"
        rf"|(?=[A-Fa-f]{{0,3}}[0-9]){_HEX}:(?::{_HEX}){{2,6}}",
        r"(?![0-9A-Za-z:])",
    ),
    "ssn": (
        r"(?<![0-9A-Za-z-])",
        r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
        r"(?![0-9A-Za-z]|-[0-9])",
    ),
    "ymd": (
        r"(?<![0-9A-Za-z./-])",
        "|".join(f"{_YEAR}{mark}{_MONTH}{mark}{_DAY}" for mark in ("-", "/", r"\.")),
        r"(?:(?=T[0-9])|(?![0-9A-Za-z]|[./-][0-9]))",
    ),
    "dmy": (r"(?<![0-9A-Za-z./])", rf"{_DAY}(?:/{_MONTH}/|\.{_MONTH}\.){_YEAR}", _AHEAD),
    "mdy": (r"(?<![0-9A-Za-z./])", rf"{_MONTH}/{_DAY}/{_YEAR}", _AHEAD),
    "phone": (
        r"(?<![0-9A-Za-z+])",
        r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
        # E.164 has at most 15 digits, however they are grouped.
        r"|\+[0-9](?:[ .-]?[0-9]){6,14}"
        r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}"
        r"|(?<!-)(?:1-)?[0-9]{3}-[0-9]{3}-[0-9]{4}(?!-[0-9])"
        r"|(?<![.-])(?:1\.)?[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![.-][0-9])"
        # Areas and exchanges of the North American plan begin with 2 to 9.
        r"|(?<![.-]|[0-9] )(?:1 )?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?!-[0-9])",
        _AHEAD,
    ),
}
DATES = ("ymd", "dmy", "mdy")
PATTERN = "|".join(f"{before}(?:{body}){after}" for before, body, after in KINDS.values())

_SYMBOLS = "array<struct<v: int, r: int>>"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SYMBOL = r"[0-9A-Za-z\x{80}-\x{FFFF}]"  # what is permuted; the rest of a shape stays


def _symbol(value: Column, radix: Column | int) -> Column:
    radix = F.lit(radix) if isinstance(radix, int) else radix
    return F.struct(value.cast("int").alias("v"), radix.cast("int").alias("r"))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _character_symbols(text: Column) -> Column:
    """Digits and letters of a text as symbols, letters without case; beyond ASCII, places among
    32 neighbours."""
    return F.transform(
        F.filter(_characters(F.lower(text)), lambda c: c.rlike(_SYMBOL)),
        lambda c: F.when(c.rlike("[0-9]"), _symbol(F.ascii(c) - 48, 10))
        .when(c.rlike("[a-z]"), _symbol(F.ascii(c) - 97, 26))
        .otherwise(_symbol(F.ascii(c) % 32, 32)),
    )


def _number_symbols(parts: Column, radix: int) -> Column:
    return F.transform(parts, lambda p: _symbol(p, radix))


def feistel(symbols: Column, kind: Column, key: str) -> Column:
    """The symbols permuted; radices stay in place."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    left = F.slice(symbols, F.lit(1), half)
    right = F.slice(symbols, half + 1, F.size(symbols) - half)

    def stream(number: Column, other: Column, place: Column) -> Column:
        """A number below 2 ** 32 for a place of one half, drawn by all of the other half."""
        text = F.array_join(F.transform(other, lambda s: s["v"].cast("string")), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, number, place, text), 256)
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

    def turn(state: Column, number: Column) -> Column:
        moved = F.transform(
            state["a"],
            lambda s, i: F.struct(
                F.pmod(
                    s["v"] + stream(number.cast("string"), state["b"], i.cast("string")), s["r"].cast("bigint")
                )
                .cast("int")
                .alias("v"),
                s["r"].alias("r"),
            ),
        )
        return F.struct(state["b"].alias("a"), moved.alias("b"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.alias("a"), right.alias("b")),
        turn,
        lambda state: F.concat(state["a"], state["b"]),
    )


def _filled(shape: Column, symbols: Column) -> Column:
    """The shape with its digits and letters replaced by the symbols, in its letter case."""
    letter = lambda s, c: (
        F.when(s["r"] == 10, s["v"].cast("string"))
        .when(s["r"] == 26, F.substring(F.lit(LETTERS), s["v"] + 1, F.lit(1)))
        .otherwise(_character(F.ascii(c) - F.ascii(c) % 32 + s["v"]))
    )

    def fill(state: Column, c: Column) -> Column:
        new = letter(F.get(symbols, state["k"]), c)
        is_symbol = c.rlike(_SYMBOL)
        shown = F.when(c.rlike("[A-Z]"), F.upper(new)).when(is_symbol, new).otherwise(c)
        return F.struct(
            F.concat(state["out"], shown).alias("out"),
            (state["k"] + is_symbol.cast("int")).alias("k"),
        )

    return F.aggregate(
        _characters(shape),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        fill,
        lambda state: state["out"],
    )


def _character(point: Column) -> Column:
    """The character of a code point of four hexadecimal digits."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Digits from the right, every second one doubled; ``doubled``: 0 if the last one is."""
    return F.aggregate(
        F.transform(
            _characters(F.reverse(digits)),
            lambda c, i: F.when(
                i % 2 == doubled,
                c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0),
            ).otherwise(c.cast("int")),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )


def _mod97(text: Column) -> Column:
    """The number that letters (as 10 to 35) and digits spell, modulo 97."""
    return F.aggregate(
        _characters(text),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ),
    )


def _date(find: Column, kind: str) -> Column:
    """The find as a date, null if the calendar has no such day."""
    parts = F.split(find, "[-/.]")
    order = {"ymd": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (2, 0, 1)}[kind]
    return F.concat_ws("-", *[F.get(parts, k) for k in order]).try_cast("date")


def _compact(find: Column) -> Column:
    """An IBAN without separators, in capitals."""
    return F.upper(F.regexp_replace(find, "[ -]", ""))


def _valid(find: Column, kind: str) -> Column:
    if kind in DATES:
        return _date(find, kind).isNotNull()
    if kind == "card":
        return _luhn_sum(F.regexp_replace(find, "[^0-9]", ""), 1) % 10 == 0
    if kind in ("iban", "other iban"):
        compact = _compact(find)
        return _mod97(F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))) == 1
    return F.lit(True)


def pseudonym(find: Column, kind: str, key: str) -> Column:
    """What to write in the place of a valid find."""
    value = lambda new, k: F.get(new, k)["v"]
    drawn = lambda symbols, family, write: F.element_at(
        F.transform(F.array(feistel(symbols.cast(_SYMBOLS), F.lit(family), key)), write), 1
    )
    if kind in DATES:
        day = F.date_diff(_date(find, kind), F.lit(FIRST_DAY).cast("date"))
        symbols = F.array(
            _symbol(F.floor(day / DAY_RADIX), DAYS // DAY_RADIX), _symbol(day % DAY_RADIX, DAY_RADIX)
        )

        def dated(new: Column) -> Column:
            date = F.date_add(F.lit(FIRST_DAY).cast("date"), value(new, 0) * DAY_RADIX + value(new, 1))
            one_digit = find.rlike("(?:^|[-/.])[0-9](?:[-/.]|$)")
            shown = {
                part: F.when(one_digit, F.date_format(date, part)).otherwise(F.date_format(date, part * 2))
                for part in "Md"
            }
            written = {"y": F.date_format(date, "yyyy"), "m": shown["M"], "d": shown["d"]}
            mark = F.regexp_extract(find, "[-/.]", 0)
            return F.concat(written[kind[0]], mark, written[kind[1]], mark, written[kind[2]])

        # Dates of all formats share one permutation.
        return drawn(symbols, "date", dated)
    if kind == "ip":
        symbols = _number_symbols(F.split(find, "[.]"), 256)
        return drawn(symbols, kind, lambda new: F.array_join(F.transform(new, lambda s: s["v"].cast("string")), "."))
    if kind == "ipv6":
        groups = F.filter(F.split(F.lower(find), ":"), lambda g: g != "")
        symbols = F.transform(groups, lambda g: _symbol(F.conv(g, 16, 10), 65536))

        def grouped(new: Column) -> Column:
            written = F.transform(new, lambda s: F.lower(F.hex(s["v"].cast("long"))))
            gap = F.size(F.split(F.substring_index(find, "::", 1), ":"))  # groups before the gap
            with_gap = F.concat(
                F.array_join(F.slice(written, F.lit(1), gap), ":"),
                F.lit("::"),
                F.array_join(F.slice(written, gap + 1, F.size(written)), ":"),
            )
            text = F.when(find.contains("::"), with_gap).otherwise(F.array_join(written, ":"))
            return F.when(find.rlike("[A-F]"), F.upper(text)).otherwise(text)

        return drawn(symbols, kind, grouped)
    if kind == "ssn":
        parts = F.split(find, "-")
        area = F.get(parts, 0).cast("int")
        symbols = F.array(
            _symbol(area - 1 - (area > 666).cast("int"), 898),
            _symbol(F.get(parts, 1).cast("int") - 1, 99),
            _symbol(F.get(parts, 2).cast("int") - 1, 9999),
        )

        def numbered(new: Column) -> Column:
            padded = lambda n, size: F.lpad(n.cast("string"), size, "0")
            area = value(new, 0) + 1 + (value(new, 0) >= 665).cast("int")
            return F.concat_ws(
                "-", padded(area, 3), padded(value(new, 1) + 1, 2), padded(value(new, 2) + 1, 4)
            )

        return drawn(symbols, kind, numbered)
    if kind in ("iban", "other iban"):
        shape = F.substr(find, F.lit(5))

        def banked(new: Column) -> Column:
            filled = _filled(shape, new)
            bank = F.concat(_compact(filled), F.upper(F.substr(find, F.lit(1), F.lit(2))), F.lit("00"))
            check = F.lpad((98 - _mod97(bank)).cast("string"), 2, "0")
            return F.concat(F.substr(find, F.lit(1), F.lit(2)), check, filled)

        return drawn(_character_symbols(shape), "iban", banked)
    if kind == "card":
        shape = F.substr(find, F.lit(1), F.length(find) - 1)

        def checked(new: Column) -> Column:
            filled = _filled(shape, new)
            last = F.pmod(-_luhn_sum(F.regexp_replace(filled, "[^0-9]", ""), 0), F.lit(10))
            return F.concat(filled, last.cast("string"))

        return drawn(_character_symbols(shape), kind, checked)
    if kind == "email":
        before, shape = F.lit(""), F.substring_index(find, "@", 1)
    else:  # a phone number
        before = F.regexp_extract(
            find, rf"^\+(?:[0-9]{{1,3}}(?=[ .(-])|{CALLING}(?=[0-9]))|^1(?=[ .-][0-9]{{3}}[ .-])", 0
        )
        shape = F.substr(find, F.length(before) + 1)
    after = F.substr(find, F.length(before) + F.length(shape) + 1)
    return drawn(_character_symbols(shape), kind, lambda new: F.concat(before, _filled(shape, new), after))


_SEGMENT = "struct<text: string, kind: string>"


def _cut(segment: Column, kind: str, key: str) -> Column:
    """The segment, if nothing in it was replaced yet, cut at the valid finds of a kind."""
    before, body, after = KINDS[kind]
    text = segment["text"]
    name = "iban" if kind == "other iban" else kind
    plain = lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("kind"))

    def woven(valid: Column) -> Column:
        # The values themselves, amid what a find of the kind must stand amid; the longest first.
        listed = F.array_sort(
            F.array_distinct(valid), lambda a, b: F.coalesce(F.length(b) - F.length(a), F.lit(0)).cast("int")
        )
        quoted = F.transform(listed, lambda v: F.concat(F.lit("\\Q"), v, F.lit("\\E")))
        pattern = F.concat(F.lit(before + "(?:"), F.array_join(quoted, "|"), F.lit(")" + after))
        pieces = F.zip_with(
            F.split(text, pattern),
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda between, find: F.array(
                plain(F.coalesce(between, F.lit(""))),
                F.when(
                    find.isNotNull(),
                    F.struct(pseudonym(find, kind, key).alias("text"), F.lit(name).alias("kind")),
                ),
            ),
        )
        return F.when(F.size(valid) > 0, F.array_compact(F.flatten(pieces))).otherwise(F.array(segment))

    # Looking ahead consumes nothing, so that a value is tried from each of its groups on.
    found = F.regexp_extract_all(text, F.lit(f"{before}(?=({body}){after})"), F.lit(1))
    cut = F.element_at(F.transform(F.array(F.filter(found, lambda v: _valid(v, kind))), woven), 1)
    return F.when(segment["kind"].isNotNull(), F.array(segment)).otherwise(cut)


def _cut_all(segments: str, kind: str, key: str) -> Column:
    return F.flatten(F.transform(segments, lambda segment: _cut(segment, kind, key)))


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The rows with their text rewritten; ``pii`` lists the kinds of what was replaced."""
    whole = F.array(F.struct(F.col(text).alias("text"), F.lit(None).cast("string").alias("kind")))
    rows = docs.withColumn("_may", F.coalesce(F.col(text).rlike(PATTERN), F.lit(False)))
    rows = rows.withColumn("_segments", F.when(F.col("_may"), whole).cast(f"array<{_SEGMENT}>"))
    for kind in KINDS:
        rows = rows.withColumn("_segments", _cut_all("_segments", kind, key))
    new = F.array_join(F.transform("_segments", lambda s: s["text"]), "")
    kinds = F.array_compact(F.transform("_segments", lambda s: s["kind"]))
    return (
        rows.withColumn(text, F.when(F.col("_may"), new).otherwise(F.col(text)))
        .withColumn("pii", F.coalesce(kinds, F.array().cast("array<string>")))
        .drop("_may", "_segments")
    )
