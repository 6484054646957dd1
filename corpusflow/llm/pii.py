"""Format-preserving pseudonyms for personal data and secrets.

Method: a value that a pattern finds and a check confirms (check digits, octets, calendar) is read as an integer
within the domain of its format and sent through a keyed permutation of that domain: a Feistel network, walking the
cycle until the result is in the domain again, then a keyed rotation, then the network backwards. Such a conjugate of a
rotation is one to one and has no fixed point, so that no value of a domain of two or more stays as it is and no two
values become one. The same value with the same key always becomes the same pseudonym, so equal values stay linked
across documents, and the pseudonym is a valid value of the same format.

Kinds: e-mail addresses, IBANs, card numbers (Luhn), social security numbers, telephone numbers (linked by their digits,
however these are set apart), IPv4 and IPv6 addresses, dates of any year (ISO, day first or month first with slash, dot
or dash, and with English month names; years 1900 to 2099 stay within these), keys with the beginnings of well-known
services, and values assigned to password, token, secret or key: any value after an equals sign; after a colon, one that
holds a digit or stands in quotes, since prose has words after colons.

Defined cases: null stays null and empty stays empty with no finds; text around a value is unchanged; what fails its
check is not a value of that kind; very long texts are read whole, line by line; an empty table gives an empty result;
repeated rows are treated alike; all other columns are passed through; one named like the count is replaced by it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces

ROUNDS = 8
#: Entries of a worker's cache of pseudonyms.
CACHE = 100_000
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
ALL_DAYS = dt.date.max.toordinal()
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "|".join(MONTHS)

#: In this order at one place. The first to match and to pass its check wins.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "access_key": r"(?:(?P<head>AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}|(?P<git>gh[pousr]_)[0-9A-Za-z]{36,}|(?P<maps>AIza)[0-9A-Za-z_-]{35}|(?P<chat>xox[abprs]-)[0-9A-Za-z-]{10,}|(?P<pay>[rs]k_(?:live|test)_)[0-9A-Za-z]{16,})(?![0-9A-Za-z])",
    "secret": r"(?i:password|passwd|pwd|token|secret|api_?key)(?:\s*=\s*[\"']?(?P<any>[A-Za-z0-9_+/.-]*[A-Za-z0-9][A-Za-z0-9_+/.-]*)|\s*:\s*[\"'](?P<quoted>[A-Za-z0-9_+/.-]*[A-Za-z0-9][A-Za-z0-9_+/.-]*)(?=[\"'])|\s*:\s*[\"']?(?P<digits>[A-Za-z0-9_+/.-]*[0-9][A-Za-z0-9_+/.-]*))",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ip6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "iso_date": r"(?P<y>[0-9]{4})(?P<s>[-/.])(?P<m>[0-9]{2})(?P=s)(?P<d>[0-9]{2})(?![0-9])",
    "date": r"(?P<a>[0-9]{1,2})(?P<s>[-/.])(?P<b>[0-9]{1,2})(?P=s)(?P<y>[0-9]{4})(?![0-9])",
    "day_month": rf"(?P<d>[0-9]{{1,2}}) (?P<m>{_MONTH}) (?P<y>[0-9]{{4}})(?![0-9])",
    "month_day": rf"(?P<m>{_MONTH}) (?P<d>[0-9]{{1,2}}), (?P<y>[0-9]{{4}})(?![0-9])",
    "phone": r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Lines without any of these hold no value.
MARK = re.compile("[0-9@=]|::|:\\s*[\"']")
#: Where a value other than an e-mail address may begin; such addresses are looked for from their sign on.
START = re.compile(r"(?<![A-Za-z0-9])(?:A[KSBC][IC]A[0-9A-Z]|gh[pousr]_|AIza|xox[abprs]-|[rs]k_|(?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]|[A-Z]{2}[0-9]{2}|[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:|\+?\(?[0-9]{1,4}|(?:" + _MONTH + r") [0-9])")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()
        self.cache: dict[tuple[str, str], str | None] = {}

    def _round(self, kind: str, n: int, i: int, value: int) -> int:
        said = f"{kind}/{n}/{i}/{value}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=max(16, n.bit_length() // 8 + 8)).digest(), "big")

    def permute(self, kind: str, value: int, n: int, back: bool = False) -> int:
        """A keyed permutation of range(n), or its inverse: alternating additions on a pair of moduli whose product is n or a bit more."""
        if n < 2:
            return value
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        out = value
        while True:
            left, right = divmod(out, b)
            if back:
                for i in range(ROUNDS - 2, -1, -2):
                    right = (right - self._round(kind, n, i + 1, left)) % b
                    left = (left - self._round(kind, n, i, right)) % a
            else:
                for i in range(0, ROUNDS, 2):
                    left = (left + self._round(kind, n, i, right)) % a
                    right = (right + self._round(kind, n, i + 1, left)) % b
            out = left * b + right
            if out < n:
                return out

    def moved(self, kind: str, value: int, n: int, back: bool = False) -> int:
        """A keyed permutation of range(n) without fixed points, or its inverse: a rotation seen through permute()."""
        if n < 2:
            return value
        step = 1 + self._round(f"{kind}/step", n, ROUNDS, 0) % (n - 1)
        return self.permute(kind, (self.permute(kind, value, n) + (-step if back else step)) % n, n, back=True)

    def digits(self, kind: str, text: str) -> str:
        """Digits to digits as one number, whatever stands between them."""
        plain = re.sub("[^0-9]", "", text)
        new = iter(f"{self.moved(f'{kind}{len(plain)}', int(plain), 10 ** len(plain)):0{len(plain)}}")
        return "".join(next(new) if c in CLASSES[0] else c for c in text)

    def symbols(self, kind: str, text: str) -> str:
        """Digits to digits, letters to letters of the same case; all else stays."""
        value, n, sets = 0, 1, []
        for c in text:
            own = next((x for x in CLASSES if c in x), "")
            sets.append(own)
            if own:
                value, n = value * len(own) + own.index(c), n * len(own)
        value, out = self.moved(f"{kind}:{''.join(str(len(x)) for x in sets)}", value, n), []
        for c, own in zip(reversed(text), reversed(sets)):
            if own:
                value, at = divmod(value, len(own))
                c = own[at]
            out.append(c)
        return "".join(reversed(out))

    def value(self, kind: str, found: re.Match) -> str | None:
        """The pseudonym of a found text, or None if it fails its check."""
        at = (kind, found[0])
        if at not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[at] = getattr(self, f"_{kind}", self._calendar)(found)
        return self.cache[at]

    def _access_key(self, found: re.Match) -> str:
        head = next(x for x in found.groups() if x)
        return head + self.symbols("access_key", found[0][len(head) :])

    def _email(self, found: re.Match) -> str:
        body, _, top = found[0].rpartition(".")
        return f"{self.symbols('email', body)}.{top}"

    def _secret(self, found: re.Match) -> str:
        value = next(x for x in found.groups() if x)
        at = len(found[0]) - len(value)
        if re.fullmatch("[0-9a-f]{8,}", value):
            new = f"{self.moved(f'hex{len(value)}', int(value, 16), 16 ** len(value)):0{len(value)}x}"
        else:
            new = self.symbols("secret", value)
        return found[0][:at] + new

    def _card(self, found: re.Match) -> str | None:
        digits = re.sub("[ -]", "", found[0])
        if luhn(digits[:-1]) != digits[-1]:
            return None
        body = self.symbols("card", digits[:-1])
        return _refill(found[0], body + luhn(body))

    def _iban(self, found: re.Match) -> str | None:
        plain = found[0].replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.symbols("iban", plain[4:])
        check = 98 - _mod97(f"{body}{plain[:2]}00")
        return _refill(found[0], f"{plain[:2]}{check:02}{body}")

    def _ssn(self, found: re.Match) -> str | None:
        area, group, serial = map(int, found[0].split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        # the valid ones numbered without gaps
        out = self.moved("ssn", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        area, group, serial = out // (99 * 9999) + 1, out // 9999 % 99 + 1, out % 9999 + 1
        return f"{area + (area > 665):03}-{group:02}-{serial:04}"

    def _ip(self, found: re.Match) -> str | None:
        parts = [int(x) for x in found[0].split(".")]
        if max(parts) > 255:
            return None
        out = self.moved("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, out.to_bytes(4, "big")))

    def _ip6(self, found: re.Match) -> str | None:
        try:
            value = int(ipaddress.IPv6Address(found[0]))
        except ValueError:
            return None
        if value < 1 << 16 or not re.search("[0-9]", found[0]):  # "::" and such, or words with colons
            return None
        return str(ipaddress.IPv6Address(self.moved("ip6", value - (1 << 16), (1 << 128) - (1 << 16)) + (1 << 16)))

    def _phone(self, found: re.Match) -> str | None:
        text = found[0]
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        head = code[0] if code else text[:2] if text[0] == "+" else ""
        rest = text[len(head) :]
        if not (7 <= len(re.sub("[^0-9]", "", rest)) and len(re.sub("[^0-9]", "", text)) <= 15) or not re.search("[+(]|[0-9][ .-][0-9]", text):
            return None
        if not head and "(" not in text and not re.fullmatch(r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]+([ .-]?[0-9]+)+", text):
            return None
        return head + self.digits("phone", rest)

    def _calendar(self, found: re.Match) -> str | None:
        got, text = found.groupdict(), found[0]
        if "a" in got:
            a, b = int(got["a"]), int(got["b"])
            day_first = a > 12 or b <= 12 and got["s"] == "." or b <= 12 and got["s"] == "-"
            day, month = (a, b) if day_first else (b, a)
        else:
            day, month = int(got["d"]), MONTHS.index(got["m"]) + 1 if got["m"] in MONTHS else int(got["m"])
        try:
            at = dt.date(int(got["y"]), month, day).toordinal()
        except ValueError:
            return None
        new = dt.date.fromordinal(self.day(at))
        if got["m"] in MONTHS if "m" in got else False:
            return f"{new.day} {MONTHS[new.month - 1]} {new.year:04}" if text[0].isdigit() else f"{MONTHS[new.month - 1]} {new.day}, {new.year:04}"
        if "a" in got:
            x, y = (new.day, new.month) if day_first else (new.month, new.day)
            wide = len(got["a"]) == 2 and len(got["b"]) == 2
            return f"{x:02}{got['s']}{y:02}{got['s']}{new.year:04}" if wide else f"{x}{got['s']}{y}{got['s']}{new.year:04}"
        return f"{new.year:04}{got['s']}{new.month:02}{got['s']}{new.day:02}"

    def day(self, at: int) -> int:
        """Days (as ordinals) of 1900 to 2099 among themselves, all others among themselves."""
        n = LAST_DAY - FIRST_DAY + 1
        if FIRST_DAY <= at <= LAST_DAY:
            return self.moved("day", at - FIRST_DAY, n) + FIRST_DAY
        out = self.moved("far day", at - 1 if at < FIRST_DAY else at - 1 - n, ALL_DAYS - n) + 1
        return out if out < FIRST_DAY else out + n

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The text with pseudonyms, and how many values it had."""
        if not text or not (mark := MARK.search(text)):
            return text, 0
        out, done, count = [], 0, 0
        while mark:
            begin, end = text.rfind("\n", 0, mark.start()) + 1, text.find("\n", mark.start())
            end, at = len(text) if end < 0 else end, begin
            mail, start = _address(text, at, end), START.search(text, at, end)
            while mail is not None or start:
                first = min(x for x in (mail, start and start.start()) if x is not None)
                at = first + 1
                for kind, pattern in COMPILED.items():
                    if (found := pattern.match(text, first, end)) and (new := self.value(kind, found)) is not None:
                        out += [text[done : found.start()], new]
                        done = at = found.end()
                        count += 1
                        break
                if mail is not None and mail < at:
                    # one that is no address is not looked at from its middle
                    mail = _address(text, at if done == at else text.find("@", first) + 1, end)
                if start and start.start() < at:
                    start = START.search(text, at, end)
            mark = MARK.search(text, end)
        return "".join([*out, text[done:]]), count


def _address(text: str, at: int, end: int) -> int | None:
    """Where the local part of the next e-mail address begins; each sign looks back over its own local part only."""
    sign = text.find("@", at, end)
    while sign >= 0:
        begin = sign
        while begin > at and text[begin - 1] in LOCAL:
            begin -= 1
        while begin < sign and not text[begin].isalnum():
            begin += 1
        if begin < sign and (begin == 0 or text[begin - 1] not in LOCAL or not text[begin - 1].isalnum()):
            return begin
        at = sign + 1
        sign = text.find("@", at, end)
    return None


def luhn(body: str) -> str:
    """The check digit that belongs after the digits of ``body``."""
    total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, symbols: str) -> str:
    """``symbols`` with the separators of ``shape``."""
    left = iter(symbols)
    return "".join(c if c in " -" else next(left) for c in shape)


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", count: str | None = "n_pii") -> DataFrame:
    """All columns of ``docs`` with values in ``text`` replaced, and ``count``, the number of values, if named."""
    docs = docs.drop(count) if count else docs
    at, schema = docs.columns.index(text), docs.schema
    run = _run(at, key, count)
    if count:
        schema = T.StructType([*schema.fields, T.StructField(count, T.LongType())])
    return docs.mapInArrow(run, schema)


def _run(at: int, key: bytes, count: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pseudonyms(key)
        for batch in pieces(batches, at):
            done = [own.text(x) for x in batch.column(at).to_pylist()]
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at] = pa.array([x for x, _ in done], pa.string())
            if count:
                columns, names = [*columns, pa.array([n for _, n in done], pa.int64())], [*names, count]
            yield pa.record_batch(columns, names=names)

    return run
