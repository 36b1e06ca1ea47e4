"""Personal data replaced by format-preserving pseudonyms.

Values are found by shape and validated (checksum of cards and bank accounts, octet range of
addresses, calendar of dates, area rules of social security numbers); only valid ones change. A
value's letters and digits are permuted by a keyed Feistel network within their format: digits stay
digits, letters keep their case, separators stay, checksums hold again, dates stay dates. Equal
values get equal pseudonyms in every document, however they are written; whoever holds the key can
turn them back.

What follows an account may have the shape of further groups of it. An account ends where its
country's accounts do, else with the whole shape, else (countries not in ACCOUNTS) at the last group
whose checksum holds; where none does, the search goes on after the first group. A value that lies in
such a refused reading is permuted again where its pseudonym would make the reading valid, so that it
is found again; there its pseudonym may differ from the one it has elsewhere.

The network alternates between the two halves of a value, read as mixed-radix numbers, and adds a
keyed hash of one half to the other, ROUNDS times; values of more than PIECE characters are permuted in pieces, each
under its own tweak. Dates are permuted as day numbers; where a
permuted number lies outside the allowed range it is permuted again (cycle walking).

Not looked for: mail addresses with letters beyond ASCII before the '@', and national phone numbers of other forms than
(555) 123 4567 and 555-123-4567.

Defined results: a null text stays null; an empty text stays empty; all other columns pass through
unchanged, whatever their names; rows repeat as in the input; texts keep their length.
"""

from __future__ import annotations

import datetime as dt
import hmac
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lapsewise.llm.text import sliced, with_fields, without

KEY_SETTING = "spark.lapsewise.pseudonymKey"
ROUNDS = 10
PIECE = 180  # characters; a keyed hash covers half of them whole

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"
_CLASS = {c: a for a in (_DIGITS, _UPPER, _LOWER) for c in a}
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def default_key(spark: SparkSession) -> bytes:
    """The session's key; without the setting a fixed one, which links values but keeps nothing secret."""
    return spark.conf.get(KEY_SETTING, "lapsewise").encode()


class Feistel:
    """A keyed permutation of the strings over given alphabets, one alphabet per position."""

    def __init__(self, key: bytes):
        self.key = key

    def _add(self, tweak: str, turn: int, other: int, size: int) -> int:
        digest = hmac.digest(self.key, f"{tweak}|{turn}|{other}|{size}".encode(), "sha512")
        return int.from_bytes(digest, "big") % size

    def numbers(self, tweak: str, pair: tuple[int, int], sizes: tuple[int, int], back: bool = False) -> tuple[int, int]:
        halves = list(pair)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            mine, other = turn % 2, 1 - turn % 2
            add = self._add(tweak, turn, halves[other], sizes[mine])
            halves[mine] = (halves[mine] - add if back else halves[mine] + add) % sizes[mine]
        return halves[0], halves[1]

    def text(self, tweak: str, value: str, alphabets: list[str], back: bool = False) -> str:
        if len(value) > PIECE:
            size = -(-len(value) // -(-len(value) // PIECE))
            pieces = [slice(at, at + size) for at in range(0, len(value), size)]
            return "".join(self.text(f"{tweak}|{len(value)}|{p.start}", value[p], alphabets[p], back) for p in pieces)
        middle = (len(value) + 1) // 2
        sizes, numbers = [1, 1], [0, 0]
        for i, (c, alphabet) in enumerate(zip(value, alphabets)):
            half = int(i >= middle)
            numbers[half] = numbers[half] * len(alphabet) + alphabet.index(c)
            sizes[half] *= len(alphabet)
        tweak = f"{tweak}|{len(value)}"
        numbers = list(self.numbers(tweak, tuple(numbers), tuple(sizes), back))
        out = []
        for i in reversed(range(len(value))):
            half = int(i >= middle)
            numbers[half], at = divmod(numbers[half], len(alphabets[i]))
            out.append(alphabets[i][at])
        return "".join(reversed(out))

    def within(self, tweak: str, value: int, size: int, back: bool = False) -> int:
        """A permutation of range(size) by cycle walking."""
        root = int(size**0.5) + 1
        while True:
            a, b = self.numbers(tweak, divmod(value, root), (root, root), back)
            value = a * root + b
            if value < size:
                return value


def luhn(digits: str) -> int:
    """The check digit that completes `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _bank_remainder(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _refill(shape: str, plain: str) -> str:
    """Put the letters and digits of `plain` where those of `shape` stand."""
    fresh = iter(plain)
    return "".join(next(fresh) if c.isascii() and c.isalnum() else c for c in shape)


def _plain(value: str) -> str:
    return "".join(c for c in value if c.isascii() and c.isalnum())


def _by_class(f: Feistel, tweak: str, plain: str, back: bool) -> str:
    return f.text(tweak, plain, [_CLASS[c] for c in plain], back)


def card(f: Feistel, value: str, back: bool) -> str | None:
    plain = _plain(value)
    if not 13 <= len(plain) <= 19 or len(set(plain)) == 1 or str(luhn(plain[:-1])) != plain[-1]:
        return None
    body = _by_class(f, "card", plain[:-1], back)
    return _refill(value, body + str(luhn(body)))


def _is_account(value: str) -> bool:
    plain = _plain(value)
    return 15 <= len(plain) <= 34 and _bank_remainder(plain) == 1


def bank_account(f: Feistel, value: str, back: bool) -> str | None:
    plain = _plain(value)
    if not _is_account(value):
        return None
    body = _by_class(f, "iban" + plain[:2], plain[4:], back)
    return _refill(value, f"{plain[:2]}{98 - _bank_remainder(plain[:2] + '00' + body):02d}{body}")


# Letters and digits of a country's bank accounts.
ACCOUNTS = {
    country: int(size) for size, *countries in map(str.split, (
        "15 NO", "16 BE", "18 DK FI FO GL NL SD FK", "19 MK SI", "20 AT BA EE KZ LT LU XK MN", "21 CH HR LI LV",
        "22 BG BH CR DE GB GE IE ME RS VA", "23 AE GI IL IQ TL OM SO", "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST",
        "26 IS TR", "27 BI DJ FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HN HU LB NI PL SV", "29 BR EG PS QA UA", "30 JO KW MU YE", "31 MT SC", "32 LC", "33 RU",
    )) for country in countries
}


def account_ends(shape: str) -> list[int]:
    """Where an account that begins a shape may end, first choice first."""
    ends = [i for i, c in enumerate(shape) if c == " "] + [len(shape)]
    size = ACCOUNTS.get(shape[:2])
    own = [e for e in ends if len(_plain(shape[:e])) == size]
    others = ends if size is None else ends[-1:]
    return own + [e for e in reversed(others) if e not in own]


def phone(f: Feistel, value: str, back: bool) -> str | None:
    plain = _plain(value)
    if not 8 <= len(plain) <= 15:
        return None
    country = len(re.match(r"\+?\d{0,3}", value)[0].lstrip("+")) if value.startswith("+") else 0
    country = min(country, len(plain) - 7)
    return _refill(value, plain[:country] + _by_class(f, "phone", plain[country:], back))


def social(f: Feistel, value: str, back: bool) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    while True:
        a, g, s = value.split("-")
        value = _refill(value, _by_class(f, "ssn", a + g + s, back))
        a, g, s = value.split("-")
        if a not in ("000", "666") and a[0] != "9" and g != "00" and s != "0000":
            return value


def address(f: Feistel, value: str, back: bool) -> str | None:
    octets = value.split(".")
    if any(len(o) > 1 and o[0] == "0" or int(o) > 255 for o in octets):
        return None
    # Octets keep their number of digits, so that the text keeps its length.
    ranges = [(0, 10), (10, 100), (100, 256)]
    low, high = zip(*(ranges[len(o) - 1] for o in octets))
    size = [h - l for l, h in zip(low, high)]
    pair = [int(octets[i]) - low[i] for i in range(4)]
    tweak = "ip" + "".join(str(len(o)) for o in octets)
    a, b = f.numbers(tweak, (pair[0] * size[1] + pair[1], pair[2] * size[3] + pair[3]), (size[0] * size[1], size[2] * size[3]), back)
    fresh = (a // size[1], a % size[1], b // size[3], b % size[3])
    return ".".join(str(n + l) for n, l in zip(fresh, low))


_ORDERS = {"-": ("%Y-%m-%d",), "/": ("%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y"), ".": ("%d.%m.%Y",)}


def date(f: Feistel, value: str, back: bool) -> str | None:
    for order in _ORDERS[re.search(r"\D", value)[0]]:
        try:
            day = dt.datetime.strptime(value, order).date().toordinal()
        except ValueError:
            continue
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        while True:
            day = _FIRST_DAY + f.within("date", day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, back)
            fresh = dt.date.fromordinal(day)
            # A date only readable with the month first must stay one, or it could not be turned back.
            if order != "%m/%d/%Y" or fresh.day > 12:
                return fresh.strftime(order)
    return None


def mail(f: Feistel, value: str, back: bool) -> str | None:
    name, _, host = value.rpartition("@")
    own, dot, top = host.rpartition(".")
    plain = _plain(name + own)
    return _refill(name + "@" + own, _by_class(f, "mail", plain, back)) + dot + top


def secret(f: Feistel, value: str, back: bool) -> str | None:
    plain = _plain(value)
    if not plain:
        return None
    if set(plain) <= set(_HEX):  # hex digits stay hex digits
        return _refill(value, f.text("secret", plain, [_HEX] * len(plain), back))
    return _refill(value, _by_class(f, "secret", plain, back))


def access_key(f: Feistel, value: str, back: bool) -> str | None:
    alphabet = _UPPER + _DIGITS
    return value[:4] + f.text("access", value[4:], [alphabet] * (len(value) - 4), back)


KINDS: dict[str, tuple[str, Callable]] = {
    "mail": (r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}", mail),
    "access_key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    "secret": (r"(?i:(?<![a-z0-9])(?:(?:api|access|auth|secret|private)[_-]?)?(?:token|password|passwd|pwd|secret|key)[ \t]*[=:][ \t]*[\"']?)(?P<_value>[A-Za-z0-9+/_.-]{8,})", secret),
    "bank_account": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", bank_account),
    "date": (r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])", date),
    "address": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    "social": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    "card": (r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}(?P<_gap>[ -])\d{4}(?P=_gap)\d{4}(?P=_gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])", card),
    "phone": (
        r"(?<![A-Za-z0-9+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![A-Za-z0-9])",
        phone,
    ),
}
# Mail addresses are looked for from their '@', so that long runs of their characters without one are not searched again and again.
_PATTERN = re.compile("|".join(f"(?P<{name}>{shape})" for name, (shape, _) in KINDS.items() if name != "mail"))
_MAIL = re.compile(f"(?P<mail>{KINDS['mail'][0]})")
_HOST = re.compile(KINDS["mail"][0].partition("@")[2])
_LOCAL = frozenset(_DIGITS + _UPPER + _LOWER + "._%+-")
# Every value holds one of these; only their surroundings are searched for values.
_HINT = re.compile(r"[0-9@=:]|A(?:KI|SI)A")
# Blanks next to '=' and ':' belong to the hint, whatever their number.
_BLANKS = re.compile(r"[ \t]*")
# Hints nearer to each other than NEAR share a window, which reaches MARGIN beyond them to the next white space.
NEAR, MARGIN = 32, 48


def _windows(text: str) -> list[tuple[int, int]]:
    found, last = [], -NEAR
    for hint in _HINT.finditer(text):
        at = begin = hint.start()
        end = at
        if hint[0] in "=:":
            while begin and text[begin - 1] in " \t":
                begin -= 1
            end = _BLANKS.match(text, at + 1).end() - 1
        if begin - last < NEAR and found:
            found[-1][1] = end
        else:
            found.append([begin, end])
        last = end
    out = []
    for first, last in found:
        begin, end = max(0, first - MARGIN), min(len(text), last + 1 + MARGIN)
        while begin and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _mails(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Where the characters before an '@' that an address may have begin, and the '@', for every address within bounds."""
    found, after = [], begin
    at = text.find("@", begin, end)
    while at >= 0:
        if at > after and text[at - 1] in _CLASS and _HOST.match(text, at + 1, end):
            first = at
            while first > after and text[first - 1] in _LOCAL:
                first -= 1
            found.append((first, at))
        after, at = at + 1, text.find("@", at + 1, end)
    return found


class _Matches:
    """The next value of a window from any place on, places never falling."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.end = text, end
        self._mails = _mails(text, begin, end)[::-1]
        self._other = _PATTERN.search(text, begin, end)

    def next(self, at: int) -> re.Match | None:
        if self._other and self._other.start() < at:
            self._other = _PATTERN.search(self.text, at, self.end)
        while self._mails:
            first, sign = self._mails[-1]
            first = max(first, at)
            while first < sign and self.text[first] not in _CLASS:
                first += 1
            if first < sign:
                if self._other and self._other.start() < first:
                    break
                self._mails[-1] = (first, sign)
                return _MAIL.match(self.text, first, self.end)
            self._mails.pop()
        return self._other


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    """The text with its values permuted (or turned back), and the kinds changed, in order."""
    windows = _windows(text)
    if not windows:
        return text, []
    network, kinds = _network(key), []
    refused: list[tuple[int, int]] = []  # readings as accounts that did not hold

    def found(begin: int, end: int, name: str, permute: Callable) -> str | None:
        """The pseudonym of text[begin:end], under which refused readings around it stay refused."""
        around = [(b, e) for b, e in refused if b < end and begin < e]
        first, last = min((b for b, _ in around), default=begin), max((e for _, e in around), default=end)
        before, at = [text[max(done, first) : begin]], done
        for piece in reversed(out):
            if at <= first:
                break
            before.append(piece[max(0, len(piece) - at + first) :])
            at -= len(piece)
        head = "".join(reversed(before))
        value = permute(network, text[begin:end], back)
        while value is not None and any(_is_account((head + value + text[end:last])[b - first : e - first]) for b, e in around):
            value = permute(network, value, back)
        return value

    def change(match: re.Match) -> tuple[str, int]:
        """What takes the match's place, and where it and the search go on."""
        begin, end = match.span()
        held = match.groupdict()
        for name, (_, permute) in KINDS.items():
            if held.get(name) is None:
                continue
            if name == "secret":
                head = match[0][: len(match[0]) - len(match["_value"])]
                fresh = permute(network, match["_value"], back)
                fresh = None if fresh is None else head + fresh
            elif name == "bank_account":
                fresh = None
                for size in account_ends(match[0]):
                    if _is_account(match[0][:size]):
                        fresh, end = found(begin, begin + size, name, permute), begin + size
                        break
                    refused.append((begin, begin + size))
            else:
                fresh = found(begin, end, name, permute)
            if fresh is None:  # the shape of several kinds: later ones may still fit
                later = list(KINDS)[list(KINDS).index(name) + 1 :]
                for other in later:
                    if other != "secret" and re.fullmatch(KINDS[other][0], match[0]):
                        fresh = found(begin, end, other, KINDS[other][1])
                        name = other
                        if fresh is not None:
                            break
            if fresh is None:
                # The groups after an account's first may hold other values.
                end = begin + 4 if name == "bank_account" else end
                return text[begin:end], end
            kinds.append(name)
            return fresh, end
        return match[0], end

    out, done = [], 0
    for begin, end in windows:
        at, matches = begin, _Matches(text, begin, end)
        while match := matches.next(at):
            refused = [r for r in refused if r[1] > match.start()]
            fresh, at = change(match)
            out += [text[done : match.start()], fresh]
            done = at
    return "".join([*out, text[done:]]), kinds


@lru_cache(maxsize=4)
def _network(key: bytes) -> Feistel:
    return Feistel(key)


def mask(docs: DataFrame, key: bytes | None = None, kinds: str | None = None, back: bool = False) -> DataFrame:
    """The documents with pseudonyms in `text`; `kinds` names a further column for the kinds found."""
    key = default_key(docs.sparkSession) if key is None else key
    docs = without(docs, (kinds,)) if kinds else docs
    at = docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches):
            changed = [(t, []) if t is None else pseudonymise(t, key, back) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in changed], pa.string())
            names = list(batch.schema.names)
            if kinds:
                columns.append(pa.array([k for _, k in changed], pa.list_(pa.string())))
                names.append(kinds)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, with_fields(docs, {kinds: "array<string>"}) if kinds else docs.schema)
