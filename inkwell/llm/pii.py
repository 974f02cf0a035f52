"""Format-preserving pseudonyms for validated personal numbers, dates and addresses, by keyed Feistel permutations."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import warnings
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType

from inkwell.llm.common import arrow_map, load_spread, quoted, string_array, text_slices

ROUNDS = 10
#: Only for tests and the demonstration queries; set spark.inkwell.pii.key to a secret for real use.
DEMO_KEY = "demonstration key, not a secret"

PATTERN = (
    r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})\b)"
    r"|(?P<ssn>\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b)"
    r"|(?P<card>\b[0-9](?:[ \-]?[0-9]){12,18}\b)"
    r"|(?P<phone>\+[0-9]{1,4}(?:[ .\-]?\([0-9]{1,5}\))?(?:[ .\-]?[0-9]){4,32}\b|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}\b|\b[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}\b)"
    r"|(?P<ip>\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b)"
)
_FIND = re.compile(PATTERN, re.ASCII)
#: The kinds in order, each by itself.
_EACH = {m[1]: re.compile(m[0], re.ASCII) for m in re.finditer(r"\(\?P<(\w+)>.*?(?=\|\(\?P<|\Z)", PATTERN)}
#: Country calling codes of one and two digits; all others have three.
_CODES = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
#: Digits that national numbers have, by country code; elsewhere what the international form leaves room for.
_NATIONAL = {"1": (10, 10), "7": (10, 10), "31": (9, 9), "33": (9, 9), "34": (9, 9), "41": (9, 9), "44": (9, 10), "45": (8, 8), "47": (8, 8), "48": (9, 9), "52": (10, 10), "55": (10, 11), "61": (9, 9), "86": (10, 11), "91": (10, 10), "351": (9, 9)}
_PHONE_DIGITS = (9, 15)
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of mixed-radix digit strings: an alternating Feistel network with BLAKE2 as round function."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def __call__(self, digits: Sequence[int], radices: Sequence[int], tweak: str) -> list[int]:
        """Permute the digits (each under its radix) among all strings of these radices."""
        half = len(digits) // 2
        sides = []
        for part, radix in ((digits[:half], radices[:half]), (digits[half:], radices[half:])):
            value, size = 0, 1
            for d, r in zip(part, radix):
                value, size = value * r + d, size * r
            sides.append((value, size))
        (a, m), (b, n) = sides
        for k in range(ROUNDS):
            if k % 2:
                b = (b + self._round(tweak, k, a, m, n)) % n
            else:
                a = (a + self._round(tweak, k, b, m, n)) % m
        out: list[int] = []
        for value, radix in ((b, radices[half:]), (a, radices[:half])):
            for r in reversed(radix):
                value, d = divmod(value, r)
                out.append(d)
        return out[::-1]

    def _round(self, tweak: str, k: int, value: int, m: int, n: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{m}|{n}|{k}|{value}".encode(), key=self.key, digest_size=16 + m.bit_length() // 8 + n.bit_length() // 8).digest(), "big")

    def walk(self, digits: Sequence[int], radices: Sequence[int], tweak: str, valid: Callable[[list[int]], bool]) -> list[int]:
        """Permute within the valid strings only, by walking the cycle until the next valid one."""
        out = self(digits, radices, tweak)
        while not valid(out):
            out = self(out, radices, tweak)
        return out


def luhn(digits: Sequence[int]) -> int:
    """The check digit that follows the digits."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _put(text: str, digits: Sequence[int]) -> str:
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: str(next(it)), text)


def _card(f: Feistel, s: str) -> str | None:
    d = [int(c) for c in s if c.isdigit()]
    if luhn(d[:-1]) != d[-1]:
        return None
    body = f(d[:-1], [10] * (len(d) - 1), "card")
    return _put(s, [*body, luhn(body)])


def _phone(f: Feistel, s: str) -> str | None:
    """The digits behind the country code are permuted, so a number has one pseudonym with separators and without."""
    d = re.sub(r"[^0-9]", "", s)
    lead = len(_CODES.match(d)[0]) if s[0] == "+" and _CODES.match(d) else 0
    if not _PHONE_DIGITS[0] <= len(d) <= _PHONE_DIGITS[1]:
        return None
    return _put(s, [*map(int, d[:lead]), *f([int(c) for c in d[lead:]], [10] * (len(d) - lead), "phone")])


def _ssn(f: Feistel, s: str) -> str | None:
    d = [int(c) for c in s if c.isdigit()]

    def valid(x: Sequence[int]) -> bool:
        area, group, serial = x[0] * 100 + x[1] * 10 + x[2], x[3] * 10 + x[4], x[5] * 1000 + x[6] * 100 + x[7] * 10 + x[8]
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    return _put(s, f.walk(d, [10] * 9, "ssn", valid)) if valid(d) else None


def _ip(f: Feistel, s: str) -> str | None:
    octets = [int(x) for x in s.split(".")]
    plain = max(octets) < 256 and s == ".".join(map(str, octets))
    if not plain or not _routable(octets):
        return None
    # Each octet keeps its number of digits, so the text keeps its length.
    low = [0 if o < 10 else 10 if o < 100 else 100 for o in octets]
    sizes = [{0: 10, 10: 90, 100: 156}[x] for x in low]
    out = f.walk([o - x for o, x in zip(octets, low)], sizes, f"ip{low}", lambda d: _routable([x + y for x, y in zip(d, low)]))
    return ".".join(str(x + y) for x, y in zip(out, low))


def _routable(octets: Sequence[int]) -> bool:
    address = ipaddress.IPv4Address(bytes(octets))
    return not (address.is_loopback or address.is_unspecified or octets[0] == 0 or octets == [255] * 4)


def _date(f: Feistel, s: str) -> str | None:
    """Days are permuted among all days, in any form that puts the year or the day first. A date that only reads with its month
    first is permuted among those of days over 12, which no other form writes, so no two values meet."""
    first, second = ("%Y-%m-%d", None) if s[4] == "-" else ("%d/%m/%Y", "%m/%d/%Y") if s[2] == "/" else ("%d.%m.%Y", None)
    for form in filter(None, (first, second)):
        try:
            day = datetime.datetime.strptime(s, form).date().toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if 0 <= day < _DAYS:
            at = lambda x: datetime.date.fromordinal(_FIRST_DAY + x[0] * 271 + x[1])
            within = lambda x: x[0] * 271 + x[1] < _DAYS and (form == first or at(x).day > 12)
            return at(f.walk(divmod(day, 271), (271, 271), "date" if form == first else "month first", within)).strftime(form)
    return None


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _classes(f: Feistel, s: str, tweak: str) -> str:
    """Permute letters and digits, each within its own class and case; other characters stay."""
    at = [k for k, c in enumerate(s) if c.isascii() and c.isalnum()]
    base = [(48, 10) if s[k].isdigit() else (65, 26) if s[k].isupper() else (97, 26) for k in at]
    out = list(s)
    for k, (low, _), d in zip(at, base, f([ord(s[k]) - low for k, (low, _) in zip(at, base)], [n for _, n in base], tweak)):
        out[k] = chr(low + d)
    return "".join(out)


def _iban(f: Feistel, s: str) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = _classes(f, plain[4:], "iban")
    new = iter(f"{plain[:2]}{_iban_check(plain[:2], body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def _email(f: Feistel, s: str) -> str | None:
    local, _, domain = s.rpartition("@")
    if not any(c.isalnum() for c in local):
        return None
    return f"{_classes(f, local, 'email')}@{domain}"


#: Each gives the pseudonym of a value, None where the value isn't valid.
KINDS: dict[str, Callable[[Feistel, str], str | None]] = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "ip": _ip}


def _pieces(kind: str, value: str) -> list[str]:
    """The value and, of a card number, IBAN or international telephone number, each shorter piece that ends where a group does; longest
    first, but telephone numbers of the length that their country has before all others."""
    if kind not in ("card", "iban") and value[0] != "+":
        return [value]
    pieces = [value[:k] for k in range(len(value), 0, -1) if k == len(value) or not value[k].isalnum() and value[k - 1].isalnum()]
    pieces = [p for p in pieces if _EACH[kind].fullmatch(p)]
    return sorted(pieces, key=lambda p: kind == "phone" and not _usual(p))


def _usual(phone: str) -> bool:
    """Whether an international number has as many digits as its country's numbers."""
    d = re.sub(r"[^0-9]", "", phone)
    code = _CODES.match(d)
    low, high = _NATIONAL.get(code[0] if code else "", (16, 0))
    return code is not None and low <= len(d) - len(code[0]) <= high


def _accepted(f: Feistel, text: str, start: int, kinds: Sequence[str] = tuple(_EACH)) -> tuple[str, str] | None:
    """The piece at start that is valid as the first of the kinds that any is, and its pseudonym."""
    for kind in kinds:
        if m := _EACH[kind].match(text, start):
            for piece in _pieces(kind, m[0]):
                new = KINDS[kind](f, piece)
                grouped = kind == "card" and not piece.isdigit() or kind == "phone" and piece[0] == "+" and not _usual(piece)
                if new is not None and not (grouped and _runs_into(f, text, start, start + len(piece), kind)):
                    return piece, new
    return None


#: Kinds that a card number's or telephone number's digits in groups must not run into.
_FORMED = {"card": ("date", "ssn", "phone", "ip"), "phone": ("iban", "date", "ssn", "card")}
_GROUP = re.compile(r"(?<=[ .\-])[0-9A-Z+(]")


def _runs_into(f: Feistel, text: str, start: int, end: int, kind: str) -> bool:
    """Whether a valid value of a form of its own begins at a group within the range; for a telephone number, a card that also ends beyond it."""
    for m in _GROUP.finditer(text, start + 1, end):
        for other in _FORMED[kind]:
            if n := _EACH[other].match(text, m.start()):
                for piece in _pieces(other, n[0]):
                    if (other != "card" or m.start() + len(piece) > end) and KINDS[other](f, piece) is not None:
                        return True
    return False


def pseudonymised(f: Feistel, text: str) -> tuple[str, int]:
    """The text with each validated match replaced, and how many matches were. Where nothing valid begins, the scan goes on at
    the next place at which a value can."""
    out, n, done, at = [], 0, 0, 0
    kinds = tuple(_EACH)
    while m := _FIND.search(text, at):
        start = m.start()
        if got := _accepted(f, text, start, kinds[kinds.index(m.lastgroup) :]):
            piece, new = got
            out += [text[done:start], new]
            n, done = n + 1, start + len(piece)
            at = done
        else:
            at = start + 1
    return "".join([*out, text[done:]]), n


#: A text without any of these has no match; RE2 screens whole columns for them.
_SCREEN = r"@[A-Za-z0-9\-]|[0-9](?:[ \-]?[0-9]){12}|[0-9][ .\-/()]{0,2}[0-9]{2}[0-9 .\-/()]{3}|[A-Z]{2}[0-9]{2}|[0-9]\.[0-9]{1,3}\.[0-9]"


def _replaced(column: pa.Array, f: Feistel) -> tuple[pa.Array, list[int]]:
    hit = pc.fill_null(pc.match_substring_regex(column, _SCREEN), False).to_numpy(zero_copy_only=False).nonzero()[0]
    counts = [0] * len(column)
    if not len(hit):
        return column, counts
    done = [pseudonymised(f, t) for t in column.take(pa.array(hit)).to_pylist()]
    for k, (_, n) in zip(hit, done):
        counts[k] = n
    mask = pa.array([n > 0 for n in counts])
    return pc.replace_with_mask(column, mask, string_array([t for t, n in done if n])), counts


def pii_key(spark: SparkSession) -> str:
    key = spark.conf.get("spark.inkwell.pii.key", "")
    if not key:
        warnings.warn("spark.inkwell.pii.key is not set: pseudonyms are made with a public demonstration key and protect nothing", stacklevel=3)
    return key or DEMO_KEY


def pseudonyms(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with personal values in `text` replaced by keyed pseudonyms of the same format, and a column n_replaced.

    Recognised and validated: card numbers of 13 to 19 digits in any groups (Luhn), IBANs (mod 97), US social security numbers, dates of 1900 to 2099,
    public IPv4 addresses, e-mail addresses (their local part), and telephone numbers of 9 to 15 digits with `+` and country code, or in the forms (ddd) ddd-dddd, ddd-ddd-dddd
    and ddd.ddd.dddd. A value that fails its validation stays, and the scan goes on inside it; of a card number, IBAN or
    international telephone number with further groups behind it the longest valid part up to the end of a group counts, of a telephone
    number one of its country's length if there is one, and none into which a valid card, IBAN, date or social security number falls.

    Each kind is permuted by a Feistel network over its own valid strings under the key, so equal values get equal
    pseudonyms in all documents and different ones different; check digits are made anew. One day has one pseudonym in all forms
    but month/day/year, and a telephone number one with separators and without. A permutation has fixed points: a value may be its own
    pseudonym, which is likely only for e-mail names of one letter (1 in 26), and counts as replaced.

    Null text stays null, empty text empty, both with n_replaced 0; whole texts are processed. Repeated rows and further
    columns pass through; a column named n_replaced is replaced. An empty table gives an empty result.
    """
    f = Feistel(key or pii_key(docs.sparkSession))
    names = [c for c in docs.columns if c != "n_replaced"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            text, counts = _replaced(part.column("text"), f)
            columns = [text if k == at else c for k, c in enumerate(part.columns)]
            yield pa.record_batch([*columns, pa.array(counts, pa.int32())], [*names, "n_replaced"])

    return arrow_map(docs, names, run, docs.select(*quoted(names)).schema.add("n_replaced", IntegerType()))


def replace_pii(docs: DataFrame) -> DataFrame:
    """docs with pseudonyms() in place of their texts and no further column. Lengths stay, as formats do."""
    counted = pseudonyms(docs.withColumnRenamed("n_replaced", "_n_replaced"))
    return counted.drop("n_replaced").withColumnRenamed("_n_replaced", "n_replaced").select(*quoted(docs.columns))


def op5_pseudonyms(spark, sf_dir):
    return pseudonyms(load_spread(spark, sf_dir, "documents"))
