"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Numbers and dates are validated first (check digits, octets, calendar), turned into an index among all valid values of
their format, permuted there, and written back in the same format: card numbers stay valid card numbers, dates stay dates.
E-mail addresses, phone numbers and secrets keep their lengths and character classes. Equal values get equal pseudonyms
in all documents, and the holder of the key can turn them back.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
#: Key of the registered query and of tests; a production job passes its own.
DEFAULT_KEY = b"corpus pseudonyms"
KINDS = ("card", "iban", "ssn", "ip", "phone", "date", "email", "secret")
DATE_FROM, DATE_TO = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w@]))
  | (?P<secret>(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}
        |(?<=password=)[^\s"']{6,64}|(?<=secret=)[^\s"']{6,64}|(?<=token=)[^\s"']{6,64}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<date>(?<![\w.:/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[Tt](?![A-Za-z_]))
        |(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-]|\.[0-9])))
  | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])
        |(?<![\w.+-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]))
  | (?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    """,
    re.VERBOSE,
)
#: Lengths of IBANs by country.
IBAN_SIZES = {
    c: int(n)
    for n, countries in (
        line.split(" ", 1)
        for line in """15 NO
16 BE
18 DK FI FK FO GL NL SD
19 MK SI
20 AT BA EE KZ LT LU MN XK
21 CH CR HR LI LV
22 BG BH DE GB GE IE IM JE GG ME RS VA
23 AE GI IL IQ OM SO TL
24 AD CZ DZ ES MD MR PK RO SA SE SK TN VG
25 AO CV GW LY MZ PT ST
26 IR IS TR
27 BF BI BJ CF CG CI CM DJ FR GA GF GP GR IT KM MC MG ML MQ NC NE PF PM RE SM SN TD TF TG WF YT
28 AL AZ BY CY DO GT HN HU LB MA NI PL SV
29 BR EG PS QA UA
30 JO KW MU YE
31 MT SC
32 LC
33 RU""".splitlines()
    )
    for c in countries.split()
}
#: Sizes of the groups of digits in which cards are printed.
CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (13,), (14,), (15,), (16,), (17,), (18,), (19,)}
#: First digits that issuers of cards have.
ISSUED = re.compile("3[0-9]|4|5[0-8]|6|2(?:2[2-9]|[3-6][0-9]|7[0-2])")
#: A text without any of these has nothing that PATTERN could match.
HINT = re.compile(r"[0-9@]|password=|secret=|token=|gh[pousr]_|sk-|AKIA")


class Feistel:
    """Keyed permutations of the numbers under any bound; ``back`` undoes them."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, kind: bytes, rnd: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = b"%b|%d|%d|" % (kind, rnd, bits) + half.to_bytes(size + 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest(), "big") & ((1 << bits) - 1)

    def _walk(self, x: int, bound: int, kind: str, back: bool) -> int:
        if not 0 <= x < bound:
            raise ValueError("value outside its format")
        half = max(4, (max(1, bound - 1).bit_length() + 1) // 2)
        name = b"%b|%d" % (kind.encode(), bound)
        low = (1 << half) - 1
        while True:  # cycle walking: the permutation of the next power of four, until the value is under the bound
            if back:
                a, b = x >> half, x & low
                for r in reversed(range(ROUNDS)):
                    a, b = b ^ self._f(name, r, a, half), a
                x = a << half | b
            else:
                a, b = x >> half, x & low
                for r in range(ROUNDS):
                    a, b = b, a ^ self._f(name, r, b, half)
                x = a << half | b
            if x < bound:
                return x

    def permute(self, x: int, bound: int, kind: str) -> int:
        return self._walk(x, bound, kind, False)

    def back(self, x: int, bound: int, kind: str) -> int:
        return self._walk(x, bound, kind, True)


def luhn_digit(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = sum(sum(divmod((2 - k % 2) * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its decimal digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _classes(text: str) -> list[tuple[str, int]]:
    """Alphabet and place of each letter and digit, by class."""
    found = []
    for c in text:
        for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if c in alphabet:
                found.append((alphabet, alphabet.index(c)))
                break
        else:
            found.append(("", 0))
    return found


def _by_class(text: str, kind: str, move: Callable[[int, int, str], int], alphabet: str = "") -> str:
    """Permute all letters and digits together, each within its class (or within one alphabet)."""
    places = [(alphabet, alphabet.index(c)) for c in text] if alphabet else _classes(text)
    bound, value = 1, 0
    for letters, at in places:
        if letters:
            bound, value = bound * len(letters), value * len(letters) + at
    shape = kind + "".join(letters[:1] or c for c, (letters, _) in zip(text, places, strict=True))
    value = move(value, bound, shape)
    out = []
    for c, (letters, _) in zip(reversed(text), reversed(places), strict=True):
        if letters:
            value, at = divmod(value, len(letters))
            c = letters[at]
        out.append(c)
    return "".join(reversed(out))


def _card(text: str, move: Callable) -> str | None:
    digits = _digits(text)
    if luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    body = digits[:-1]
    new = str(move(int(body), 10 ** len(body), "card")).zfill(len(body))
    return _refill(text, new + str(luhn_digit(new)))


def _iban_rest(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(text: str, move: Callable) -> str | None:
    plain = text.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or int(check) != 98 - _iban_rest(country, rest):
        return None
    rest = _by_class(rest, f"iban{country}", move)
    left = iter(f"{country}{98 - _iban_rest(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(left) for c in text)


def _ssn(text: str, move: Callable) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    x = move((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, move: Callable) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    shape = ".".join(str(len(o)) for o in octets)  # octets keep their numbers of digits
    lows = [(0, 10, 100)[len(o) - 1] for o in octets]
    sizes = [(9, 99, 255)[len(o) - 1] - low + 1 for o, low in zip(octets, lows, strict=True)]
    x, bound = 0, 1
    for o, low, size in zip(octets, lows, sizes, strict=True):
        x, bound = x * size + int(o) - low, bound * size
    x = move(x, bound, f"ip{shape}")
    new = []
    for low, size in zip(reversed(lows), reversed(sizes), strict=True):
        x, at = divmod(x, size)
        new.append(str(low + at))
    return ".".join(reversed(new))


def _phone(text: str, move: Callable) -> str | None:
    lead = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head, tail = (text[: lead.end()], text[lead.end() :]) if lead else (text[:2], text[2:]) if text[0] == "+" else ("", text)
    digits = _digits(tail)
    if not 7 <= len(digits) <= 15:
        return None
    return head + _refill(tail, str(move(int(digits), 10 ** len(digits), "phone")).zfill(len(digits)))


def _date(text: str, move: Callable) -> str | None:
    parts = [int(p) for p in re.split(r"[-./]", text)]
    sign = next(c for c in text if not "0" <= c <= "9")
    year, month, day = parts if sign == "-" else (parts[2], parts[1], parts[0]) if sign == "." else (parts[2], parts[0], parts[1])
    if sign == "/" and month > 12 >= day:
        return _european(text, move, year, day, month)
    if not 1900 <= year <= 2099 or not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    new = datetime.date.fromordinal(_moved_day(datetime.date(year, month, day), move))
    return new.strftime({"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}[sign])


def _european(text: str, move: Callable, year: int, month: int, day: int) -> str | None:
    """dd/mm/yyyy with a day over 12. Days over 12 are permuted among themselves, so that the format stays plain."""
    if not 1900 <= year <= 2099 or day > calendar.monthrange(year, month)[1]:
        return None
    ordinal = datetime.date(year, month, day).toordinal()
    while True:
        ordinal = DATE_FROM + move(ordinal - DATE_FROM, DATE_TO - DATE_FROM + 1, "day over 12")
        new = datetime.date.fromordinal(ordinal)
        if new.day > 12:
            return new.strftime("%d/%m/%Y")


def _moved_day(day: datetime.date, move: Callable) -> int:
    return DATE_FROM + move(day.toordinal() - DATE_FROM, DATE_TO - DATE_FROM + 1, "date")


def _email(text: str, move: Callable) -> str | None:
    """The name, and all labels of the domain but the last two, are permuted together; the last two if there are no more."""
    name, domain = text.rsplit("@", 1)
    labels = domain.split(".")
    keep = ".".join(labels[-2:] if len(labels) > 2 else labels[-1:])
    rest = domain[: len(domain) - len(keep) - 1]
    return f"{_by_class(f'{name}@{rest}', 'email', move)}.{keep}"


def _secret(text: str, move: Callable) -> str | None:
    head = next((h for h in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if text.startswith(h)), "")
    body = text[len(head) :]
    if re.fullmatch("[0-9a-f]+", body):
        return head + _by_class(body, "secret", move, "0123456789abcdef")
    return head + _by_class(body, f"secret{head}", move)


MAKERS = {"card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "phone": _phone, "date": _date, "email": _email, "secret": _secret}


def pseudonym(kind: str, text: str, feistel: Feistel, back: bool = False) -> str | None:
    """The pseudonym of one value (or, with ``back``, its original); None if the value is not valid for its kind."""
    return MAKERS[kind](text, feistel.back if back else feistel.permute)


def _ends(kind: str, value: str) -> list[int]:
    """Ends of the values that a match may stand for, in the order in which they are tried. A match may have taken in what
    stands behind its value; shorter readings end where a group of letters or digits does."""
    ends = [m.end() for m in re.finditer("[0-9A-Za-z]+", value)] if kind in ("card", "iban", "phone") else []
    shorter = ends[-2::-1]
    if kind == "iban" and value[:2] in IBAN_SIZES:
        shorter = [e for e in ends if len(value[:e].replace(" ", "")) == IBAN_SIZES[value[:2]]]
        return [*shorter, len(value)]
    if kind == "card":
        groups = {e: [len(g) for g in re.split("[ -]", value[:e])] for e in shorter}
        printed = [e for e in shorter if tuple(groups[e]) in CARD_GROUPS]
        # numbers of one or two digits are counted or dated rather than printed on cards
        other = [e for e in shorter if e not in printed and 13 <= sum(groups[e]) <= 19 and min(groups[e][:-1]) > 2]
        return [len(value), *printed, *other]
    return [len(value), *shorter]


def _sure(kind: str, value: str) -> bool:
    """Whether a valid value looks like its kind as well: card numbers as issued and printed, IBANs of a known country."""
    if kind == "card":
        return tuple(len(g) for g in re.split("[ -]", value)) in CARD_GROUPS and ISSUED.match(value) is not None
    return kind != "iban" or value[:2] in IBAN_SIZES


def _cuts(text: str, kind: str, start: int, end: int, make: Callable[[str, str], str | None]) -> bool:
    """Whether a reading of a card, phone number or IBAN holds the beginning of another value, which then goes first: one that
    ends behind the reading, or (if the reading is valid by chance perhaps) with it."""
    sure = _sure(kind, text[start:end])
    if kind not in ("card", "iban", "phone") or (kind == "iban" and sure):
        return False
    others = ("iban", "date", "ip", "ssn") if kind == "card" and sure else ("iban", "date", "ip", "ssn", "card")
    least = end + 1 if kind == "phone" or sure else end
    for gap in re.finditer("[ -]", text[start:end]):
        m = PATTERN.match(text, start + gap.end())
        if m and m.lastgroup in others:
            for size in _ends(m.lastgroup, m.group()):
                value = m.group()[:size]
                if m.start() + size >= least and make(m.lastgroup, value) is not None and _sure(m.lastgroup, value):
                    return True
    return False


def replace_all(text: str, feistel: Feistel, make: Callable[[str, str], str | None]) -> tuple[str, dict[str, int]]:
    counts: dict[str, int] = {}
    if not HINT.search(text):
        return text, counts
    out: list[str] = []
    done = at = 0
    while m := PATTERN.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.start() + 1  # a match that is no value is searched for others
        for size in _ends(kind, m.group()):
            new = make(kind, text[start : start + size])
            if new is not None and not _cuts(text, kind, start, start + size, make):
                out += [text[done:start], new]
                done = at = start + size
                counts[kind] = counts.get(kind, 0) + 1
                break
    return "".join([*out, text[done:]]), counts


def with_pseudonyms(docs: DataFrame, text_col: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """Column ``row`` with the whole row, its new text, and how many values of each kind were replaced in it.

    A null text stays null and has no values, an empty one stays empty. Values that fail validation (check digits, octets,
    calendar) in all their readings stay as they are. Every row stands for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        make = lru_cache(100_000)(lambda kind, value: pseudonym(kind, value, feistel))
        for batch in batches:
            texts, kinds = [], {k: [] for k in KINDS}
            for text in batch.column(0).field(text_col).to_pylist():
                new, counts = (None, {}) if text is None else replace_all(text, feistel, make)
                texts.append(new)
                for k in KINDS:
                    kinds[k].append(counts.get(k, 0))
            arrays = [batch.column(0), pa.array(texts, pa.string()), *(pa.array(kinds[k], pa.int64()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "new_text", *(f"n_{k}" for k in KINDS)])

    schema = T.StructType(
        [T.StructField("row", docs.schema), T.StructField("new_text", T.StringType())]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    )
    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)


def pseudonymize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and the counts by kind, of every row."""
    done = with_pseudonyms(docs.select(id_col, text_col), text_col, key)
    return done.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.col("new_text").alias("text"), *[f"n_{k}" for k in KINDS])


def pseudonymized(docs: DataFrame, text_col: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """The rows with all their columns, the text replaced (its length in code points stays the same)."""
    done = with_pseudonyms(docs, text_col, key)
    return done.select(*[F.col("new_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
