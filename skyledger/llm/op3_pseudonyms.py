"""Operator 3: personal data replaced by format-preserving pseudonyms.

Numbers and dates that pass their own validity rules, and the addresses and secrets beside them,
are read as a number below the size of their format (all card numbers of sixteen digits, all days
of two centuries, ...). A keyed Feistel network permutes that range, walking on while it lands
outside, and the result is written in the same format. The permutation hangs on the key and the
kind alone, so equal values get equal pseudonyms in all documents and different ones stay
different; whoever has the key can go back (``permute(..., back=True)``).

Kinds: card numbers (13 to 19 digits, Luhn; the check digit is made anew; one unbroken run or a
grouping of cards goes before the longest run of groups, so an expiry date or a security code
beside a card is no part of it), IBANs (the country's length and mod 97, made anew; what follows
is no part of one), North American phone numbers (area and exchange codes begin with 2 to 9), US
social security numbers, IPv4 addresses, ISO, slashed and
dotted dates from 1900 to 2099, e-mail addresses (the local part of any length; letters stay
letters and digits digits), and keys, tokens or passwords of 16 or more hexadecimal digits.

The key is a setting of the session, ``spark.skyledger.pseudonym.key``; where there is none, the
example key of this file is taken, which hides nothing from who has this file, and a warning says so.

Defined results: a null text stays null and has no finds; an empty text stays empty; repeated rows
change alike; text outside the finds is not touched, and its length never changes.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import carried, columns_of, documents, extended, map_texts

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
ANY = re.compile("[0-9@]")
NUMBER = re.compile(
    r"(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<iso>\d{4}-\d{2}-\d{2}(?:(?=T\d\d)|(?![\w-])))"
    r"|(?P<day>\d{2}([/.])\d{2}\4\d{4}(?![\w/]))"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<phone>(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w))"
    r"|(?P<card>\d(?:[ -]?\d){12,18}(?!\w))"
)
BEFORE = re.compile(r"[\w.]")
GROUP = re.compile(r"[ -](\d{1,20})")
#: How the digits of cards are grouped, if they do not stand in one run.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
#: How many characters an IBAN of each country has.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Characters that are permuted as one number; longer texts are permuted piece by piece.
PIECE = 64
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)[\"']?\s*[:=]\s*[\"']?([0-9a-f]{16,})(?![0-9a-z])")


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """The keyed permutation of ``0 .. size - 1`` for a kind, or its inverse."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8
    tweak = kind.encode()[:16]

    def mix(r: int, x: int) -> int:
        data = bytes([r]) + x.to_bytes(width, "big")
        seed = b"".join(hashlib.blake2b(data, digest_size=min(64, width - k), key=key, person=tweak, salt=k.to_bytes(4, "big")).digest() for k in range(0, width, 64))
        return int.from_bytes(seed, "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ mix(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ mix(r, right)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return str(-total % 10)


def refill(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in template)


def mixed(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """Letters to letters of the same case and digits to digits; the rest stays."""
    value, size = 0, 1
    for c in text:
        radix, digit = (10, ord(c) - 48) if "0" <= c <= "9" else (26, ord(c.lower()) - 97) if c.isascii() and c.isalpha() else (1, 0)
        value, size = value * radix + digit, size * radix
    value = permute(value, size, key, kind, back)
    out = []
    for c in reversed(text):
        if "0" <= c <= "9":
            value, d = divmod(value, 10)
            c = chr(48 + d)
        elif c.isascii() and c.isalpha():
            value, d = divmod(value, 26)
            c = chr((65 if c.isupper() else 97) + d)
        out.append(c)
    return "".join(reversed(out))


def hexed(text: str, key: bytes, kind: str) -> str:
    """Hexadecimal digits; a text that holds upper-case ones stays upper-case."""
    new = f"{permute(int(text, 16), 16 ** len(text), key, f'{kind}{len(text)}'):0{len(text)}x}"
    return new.upper() if text.upper() == text else new


def iban_sum(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Finder:
    """Finds and replaces; pseudonyms met lately are remembered."""

    def __init__(self, key: bytes, keep: int = 100_000):
        self.key, self.keep, self.known = key, keep, {}

    def pseudonym(self, kind: str, found: str) -> str | None:
        """The pseudonym, or None if the find is not valid."""
        if (kind, found) not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[kind, found] = getattr(self, f"_{kind}")(found)
        return self.known[kind, found]

    def _card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), self.key, f'card{len(digits)}'):0{len(digits) - 1}d}"
        return refill(s, body + luhn_digit(body))

    def _ssn(self, s: str) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = s.replace("-", "")
        if not valid(digits):
            return None
        while True:  # the valid ones are a part of the range; walking on keeps to them
            digits = f"{permute(int(digits), 10**9, self.key, 'ssn'):09d}"
            if valid(digits):
                return refill(s, digits)

    def _phone(self, s: str) -> str | None:
        valid = lambda d: d[0] > "1" and d[3] > "1"
        digits = re.sub(r"\D", "", s)
        lead, rest = digits[:-10], digits[-10:]
        if not valid(rest):
            return None
        while True:
            rest = f"{permute(int(rest), 10**10, self.key, 'phone'):010d}"
            if valid(rest):
                return refill(s, lead + rest)

    def _ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
            return None
        # each part keeps its number of digits, so the text keeps its length
        ranges = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
        value, size = 0, 1
        for p, (low, n) in zip(parts, ranges, strict=True):
            value, size = value * n + int(p) - low, size * n
        value = permute(value, size, self.key, "ip" + "".join(str(len(p)) for p in parts))
        out = []
        for low, n in reversed(ranges):
            value, d = divmod(value, n)
            out.append(str(low + d))
        return ".".join(reversed(out))

    def _date(self, year: str, month: str, day: str) -> date | None:
        try:
            found = date(int(year), int(month), int(day))
        except ValueError:
            return None
        if not FIRST_DAY <= found <= LAST_DAY:
            return None
        days = (LAST_DAY - FIRST_DAY).days + 1
        return FIRST_DAY + timedelta(days=permute((found - FIRST_DAY).days, days, self.key, "date"))

    def _iso(self, s: str) -> str | None:
        new = self._date(s[:4], s[5:7], s[8:])
        return new and new.isoformat()

    def _day(self, s: str) -> str | None:
        """Day before month where that is a date, else month before day."""
        new, order = self._date(s[6:], s[3:5], s[:2]), "{d:02d}{x}{m:02d}{x}{y:04d}"
        if new is None:
            new, order = self._date(s[6:], s[:2], s[3:5]), "{m:02d}{x}{d:02d}{x}{y:04d}"
        return new and order.format(d=new.day, m=new.month, y=new.year, x=s[2])

    def _iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_sum(plain) != 1:
            return None
        body = mixed(plain[4:], self.key, "iban" + plain[:2])
        new = iter(f"{plain[:2]}{98 - iban_sum(f'{plain[:2]}00{body}'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in s)

    def _email(self, s: str) -> str:
        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
        kind = hashlib.md5(shape.encode()).hexdigest()
        return "".join(mixed(s[k : k + PIECE], self.key, f"{k // PIECE:x}e{kind}") for k in range(0, len(s), PIECE))

    def _secret(self, s: str) -> str:
        return hexed(s, self.key, "secret")

    def iban_end(self, text: str, a: int, b: int) -> int | None:
        """Where the IBAN that begins at ``a`` ends, at ``b`` at the latest: after as many characters
        as its country's have, or, of a country that is not listed, the most that are valid."""
        ends = [k + 1 for k in range(a, b) if text[k] != " "]
        size = IBAN_SIZES.get(text[a : a + 2])
        for n in [size] if size else range(min(34, len(ends)), 14, -1):
            if n <= len(ends) and not BEFORE.match(text[ends[n - 1] : ends[n - 1] + 1].strip(".")) and self.pseudonym("iban", text[a : ends[n - 1]]) is not None:
                return ends[n - 1]
        return None

    def card_span(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """Where in or from the match ``a, b`` a valid card stands: in one run or in the groups of
        cards, from any group of the match on; else the match, or its longest part from ``a`` that
        ends with a group."""
        first = a
        while first < len(text) and first < a + 20 and text[first].isdigit():
            first += 1
        groups = [(a, first)]
        while groups[-1][1] < b + 20 and (m := GROUP.match(text, groups[-1][1])):
            groups.append(m.span(1))

        def valid(lo: int, hi: int) -> bool:
            after = text[hi : hi + 2]
            if after[:1].isalnum() or after[:1] == "_" or (after[:1] == "." and after[1:].isdigit()):
                return False
            return self.pseudonym("card", text[lo:hi]) is not None

        for i, (lo, _) in enumerate(groups):
            if lo >= b:
                break
            sizes: tuple[int, ...] = ()
            for start, hi in groups[i : i + 4]:
                sizes += (hi - start,)
                if (sizes in CARD_GROUPS or (len(sizes) == 1 and 13 <= sizes[0] <= 19)) and valid(lo, hi):
                    return lo, hi
        for hi in [b, *[end for _, end in reversed(groups) if end < b]]:
            if sum(c.isdigit() for c in text[a:hi]) >= 13 and valid(a, hi):
                return a, hi
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The new text and the finds ``(start, end, kind)``; of finds that overlap the first stands."""
        if not ANY.search(text):
            return text, []
        spans: list[tuple[int, int, str]] = []
        spans += [(*m.span(1), "secret") for m in SECRET.finditer(text)]
        pos = 0
        while m := IBAN.search(text, pos):
            end = self.iban_end(text, *m.span())
            if end is not None:
                spans.append((m.start(), end, "iban"))
            pos = end or m.start() + 1  # another may begin within what is none
        at = text.find("@")
        while at >= 0:
            local = at
            while local and text[local - 1] in LOCAL:
                local -= 1
            if local < at and DOMAIN.match(text, at):
                spans.append((local, at, "email"))
            at = text.find("@", at + 1)
        pos = 0
        while m := NUMBER.search(text, pos):
            a, b = m.span()
            # no part of a longer word or number
            if m.lastgroup == "card" and not (a and BEFORE.match(text[a - 1])) and (span := self.card_span(text, a, b)):
                spans.append((*span, "card"))
                pos = span[1]
                continue
            if a and BEFORE.match(text[a - 1]) or m.lastgroup == "card" or (m.lastgroup != "ip" and text[b : b + 1] == "." and text[b + 1 : b + 2].isdigit()):
                pos = a + 1
                while pos < len(text) and text[pos].isdigit():
                    pos += 1
                continue
            if self.pseudonym(m.lastgroup, m.group()) is None:
                pos = a + 1
                while pos < len(text) and text[pos].isdigit():
                    pos += 1
                continue
            spans.append((a, b, m.lastgroup))
            pos = b
        found, out, done = [], [], 0
        for a, b, kind in sorted(spans):
            if a >= done and (new := self.pseudonym(kind, text[a:b])) is not None:
                out += [text[done:a], new]
                found.append((a, b, kind))
                done = b
        return "".join([*out, text[done:]]), found


def pseudonymise(docs: DataFrame, key: bytes, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of ``docs``, ``text`` with finds replaced, and ``found``, an array of
    ``start, end, kind`` in characters of the text as it was."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    others = tuple(c for c in carry if c != "text")
    slim = carried(docs, others)

    def step():
        finder = Finder(key)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, found = [], []
            for t in batch.column("text").to_pylist():
                new, spans = finder.replace(t) if t else (t, [])
                texts.append(new)
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            return extended(batch, others, text=pa.array(texts, pa.string()), found=pa.array(found, kind))

        return run

    return map_texts(slim, step, f"{columns_of(slim, others)}, text string, found array<struct<start:int,end:int,kind:string>>")


#: For tests and trials; a deployment sets a secret of its own.
EXAMPLE_KEY, KEY_SETTING = b"skyledger example key, not a secret", "spark.skyledger.pseudonym.key"


def session_key(spark: SparkSession) -> bytes:
    """The session's key: at most 64 bytes are used as they are, more by their digest."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public example key", stacklevel=2)
        return EXAMPLE_KEY
    key = found.encode()
    return key if len(key) <= 64 else hashlib.blake2b(key).digest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), session_key(spark)).select("doc_id", "text", F.size("found").alias("n_found"), F.array_join("found.kind", ",").alias("kinds"))
