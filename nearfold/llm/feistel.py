"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

A value that its format's checks accept is replaced by another value of the same format that they accept too:
a keyed Feistel network permutes the numbers of that format, walking on while it leaves the valid ones.  What is
permuted is the value itself (a day, all digits of a number, an address in lower case), and its way of writing is
put back after, so equal values have equal pseudonyms in all documents, columns and ways of writing, different
values different ones, and who holds the key can go back.  White space and punctuation inside a value stay;
of an address of eight groups the value alone: its pseudonym has all groups, and it comes back in its shortest form.

| kind | accepted | kept |
|---|---|---|
| card | 13 to 19 digits, single spaces or dashes inside, other numbers beside, Luhn digit right | length, Luhn |
| iban | a country's length, check digits right modulo 97, all letters upper or lower case | country, classes of characters, check |
| ssn | 3-2-4 digits with dashes or spaces in issued ranges | those ranges |
| phone | + and country code, 7 to 14 more digits; (3) 3-4 digits as in North America; 0 and groups of digits | country code, number of digits, first digits |
| ip | four numbers up to 255; eight groups of hexadecimal digits, or :: and at least three | that |
| date | a day of 1900 to 2099 as y-m-d, d.m.y or m/d/y, a time after T | order, padding, range, what its digits tell of the order |
| email | local@host.tld | host, classes of the local part's characters |
| secret | 32 hexadecimal digits or more assigned to a key, token, secret or password; keys with an issuer's prefix | length, case, prefix, classes |

Defined results: a null text stays null; text without a valid value comes back as it is; of values that overlap
the one of the earlier kind is taken; repeated rows are treated alike; an empty table gives an empty one; other
columns pass through.  The time for a text grows with its length and the number of its values, not their square.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
#: Where the query finds the key of a corpus.
KEY_SETTING = "spark.nearfold.pseudonymKey"


class Permutation:
    """A keyed permutation of 0 .. size - 1 for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, mask: int) -> int:
        h = hashlib.blake2b(tweak + bytes([i]) + half.to_bytes(64, "little"), key=self.key, digest_size=64)
        return int.from_bytes(h.digest(), "little") & mask

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        low = bits // 2
        high = bits - low
        masks = (1 << high) - 1, (1 << low) - 1
        a, b = x >> low, x & masks[1]
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2 == 0:
                a ^= self._round(tweak, i, b, masks[0])
            else:
                b ^= self._round(tweak, i, a, masks[1])
        return a << low | b

    def __call__(self, x: int, size: int, tweak: str, good: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """The image of x, walking on until it is below size and good; a permutation of the good numbers."""
        if size < 2:
            return x
        bits = max(2, (size - 1).bit_length())
        t = f"{tweak}/{size}".encode()
        while True:
            x = self._once(x, bits, t, back)
            if x < size and (good is None or good(x)):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def _refill(shape: str, chars: str) -> str:
    """chars in place of the letters and digits of shape."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def by_class(p: Permutation, text: str, tweak: str, back: bool = False, classes: tuple[str, ...] = _CLASSES) -> str:
    """ASCII letters and digits permuted as one number of mixed base; the class of each place stays."""
    which = [next((k for k in classes if c in k), "") for c in text]
    value, size = 0, 1
    for c, k in zip(text, which, strict=True):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join(str(classes.index(k)) if k else "-" for k in which)
    value = p(value, size, f"{tweak}/{shape}", back=back)
    out = []
    for c, k in zip(reversed(text), reversed(which), strict=True):
        if k:
            value, r = divmod(value, len(k))
            out.append(k[r])
        else:
            out.append(c)
    return "".join(reversed(out))


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1


#: Digits of the groups that cards are printed in; one group of all digits is such too.
_PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 3, 3, 3), (4, 6, 4)}


def _spans(groups: list[str]) -> list[tuple[int, int]]:
    """Neighbouring groups of 13 to 19 digits, the likeliest first: as printed, then the longest, then the leftmost.

    Groups of under three digits that don't end a card count only where the whole run is one.
    """
    found = []
    for a in range(len(groups)):
        n = 0
        for b in range(a + 1, len(groups) + 1):
            n += len(groups[b - 1])
            if n > 19:
                break
            sizes = tuple(map(len, groups[a:b]))
            printed = len(sizes) == 1 or sizes in _PRINTED
            if n >= 13 and (printed or min(sizes[:-1]) >= 3 or b - a == len(groups)):
                found.append((not printed, -n, a, b))
    return [(a, b) for _, _, a, b in sorted(found)]


def cards(p: Permutation, m: re.Match, back: bool) -> list[tuple[int, int, str]]:
    """Start, end and pseudonym of the cards in a run of groups of digits.

    A pseudonym beside other digits must not let a likelier span read as a card, else it couldn't be told on the
    way back; where it would, the walk goes on, so it differs from that of the number alone.
    """
    at = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer(r"\d+", m[0])]
    groups = [m.string[a:b] for a, b in at]
    spans = _spans(groups)
    by_first: dict[int, list[tuple[int, int, int]]] = {}
    for k, (a, b) in enumerate(spans):
        by_first.setdefault(a, []).append((k, a, b))
    taken = bytearray(len(groups))
    made = []
    for k, (a, b) in enumerate(spans):
        digits = "".join(groups[a:b])
        if any(taken[a:b]) or not _is_card(digits):
            continue
        # a span has 19 groups at most
        over = [(c, d) for first in range(max(0, a - 18), b) for j, c, d in by_first.get(first, ()) if j < k and a < d and not any(taken[c:d])]
        n = len(digits) - 1

        def fit(x: int, a=a, b=b, over=over, n=n) -> bool:
            new = (body := f"{x:0{n}d}") + _luhn_digit(body)
            if len(set(new)) == 1:
                return False
            it = iter(new)
            mine = groups[:a] + ["".join(next(it) for _ in g) for g in groups[a:b]] + groups[b:]
            return not any(_is_card("".join(mine[c:d])) for c, d in over)

        body = f"{p(int(digits[:-1]), 10**n, 'card', fit, back):0{n}d}"
        taken[a:b] = b"\1" * (b - a)
        made.append((at[a][0], at[b - 1][1], _refill(m.string[at[a][0] : at[b - 1][1]], body + _luhn_digit(body))))
    return made


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


#: The length of a country's account numbers.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban(p: Permutation, m: re.Match, back: bool) -> list[tuple[int, int, str]]:
    """A number of its country's length at the begin of the match; what follows it is a word of its own."""
    n = IBAN_LENGTHS.get(m[0][:2].upper(), 0)
    at = [k for k, c in enumerate(m[0]) if c.isalnum()][:n]
    if not n or len(at) < n or m[0][at[-1] + 1 : at[-1] + 2].isalnum():
        return []
    text = m[0][: at[-1] + 1]
    flat = text.replace(" ", "").upper()
    if _mod97(flat[4:] + flat[:4]) != 1:
        return []
    body = by_class(p, flat[4:], "iban" + flat[:2], back)
    made = f"{flat[:2]}{98 - _mod97(body + flat[:2] + '00'):02d}{body}"
    return [(m.start(), m.start() + len(text), _refill(text, made.lower() if text[0].islower() else made))]


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ssn(p: Permutation, m: re.Match, back: bool) -> str | None:
    x = int(re.sub(r"\D", "", m[0]))
    return _refill(m[0], f"{p(x, 10**9, 'ssn', _ssn_ok, back):09d}") if _ssn_ok(x) else None


#: The calling codes of one and two digits; all others have three.
CALLING_1 = ("1", "7")
CALLING_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def _north_american(x: int) -> bool:
    """Whether ten digits are an area and an exchange as they are given out, and a line."""
    return x >= 2 * 10**9 and x // 10**6 % 10 >= 2


def phone(p: Permutation, m: re.Match, back: bool) -> str | None:
    """North American numbers are one value with and without +1, so those that can be written without stay such."""
    digits = re.sub(r"\D", "", m[0])
    if m["trunk"]:
        rest = digits[1:]
        return _refill(m[0], "0" + str(p(int(rest), 10 ** len(rest), "phone0", lambda x: x >= 10 ** (len(rest) - 1), back)))
    if m["area"]:
        if not _north_american(int(digits)):
            return None
        code, rest = "", digits
    else:
        n = 1 if digits[:1] in CALLING_1 else 2 if digits[:2] in CALLING_2 else 3
        code, rest = digits[:n], digits[n:]
        if not 7 <= len(rest) <= 14:
            return None
    like = None
    if code in ("", "1") and len(rest) == 10:
        issued = _north_american(int(rest))
        like = lambda x: _north_american(x) == issued
    made = f"{p(int(rest), 10 ** len(rest), 'phone' + (code or '1'), like, back):0{len(rest)}d}"
    return _refill(m[0], code + made)


def ip(p: Permutation, m: re.Match, back: bool) -> str | None:
    if ":" in m[0]:
        try:
            x = int(ipaddress.IPv6Address(m[0]))
        except ValueError:
            return None
        x = p(x, 1 << 128, "ip6", None, back)
        return ipaddress.IPv6Address(x).compressed if back else ":".join(f"{x >> k & 0xFFFF:x}" for k in range(112, -16, -16))
    parts = m[0].split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in parts):
        return None
    x = p(int.from_bytes(bytes(map(int, parts))), 1 << 32, "ip", None, back)
    return ".".join(map(str, x.to_bytes(4)))


def _day_class(d: datetime.date) -> int:
    """Days of a class can be written alike: with or without a leading zero in month and day, and as day/month, which
    a day over 12 tells from month/day."""
    return 3 * (d.month > 9) + (d.day > 9) + (d.day > 12)


_FIRST = datetime.date(1900, 1, 1).toordinal()
_CLASS: list[list[int]] = [[] for _ in range(6)]
for _day in range(_FIRST, datetime.date(2099, 12, 31).toordinal() + 1):
    _CLASS[_day_class(datetime.date.fromordinal(_day))].append(_day)


def date(p: Permutation, m: re.Match, back: bool) -> str | None:
    a, s, b, c = m["a"], m["s"], m["b"], m["c"]
    order = "ymd" if len(a) == 4 else "mdy" if s == "/" else "dmy"
    if order == "mdy" and int(a) > 12:
        order = "dmy"
    if order != "ymd" and len(c) != 4:
        return None
    part = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(*(int(part[k]) for k in "ymd"))
    except ValueError:
        return None
    if not 1900 <= day.year <= 2099:
        return None
    days = _CLASS[k := _day_class(day)]
    d = datetime.date.fromordinal(days[p(bisect.bisect_left(days, day.toordinal()), len(days), f"date{k}", None, back)])
    text = {"y": f"{d.year:04d}", "m": f"{d.month:0{len(part['m'])}d}", "d": f"{d.day:0{len(part['d'])}d}"}
    return s.join(text[k] for k in order)


def email(p: Permutation, m: re.Match, back: bool) -> str | None:
    """Addresses that differ in case alone are one value."""
    local = m["local"]
    made = by_class(p, local.lower(), "email", back)
    return "".join(x.upper() if c.isupper() else x for x, c in zip(made, local, strict=True)) + "@" + m["host"]


def secret(p: Permutation, m: re.Match, back: bool) -> str | None:
    if m["issuer"]:
        return m["issuer"] + by_class(p, m["key"], "secret" + m["issuer"], back)
    body = m["body"]
    lower = body.lower()
    if body not in (lower, body.upper()):
        return None
    made = by_class(p, lower, "secret", back, ("0123456789abcdef",))
    return m["head"] + (made if body == lower else made.upper())


#: What issuers put before their keys, and how many characters of which kinds follow.
ISSUERS = (
    ("AKIA", "[A-Z0-9]{16}"), ("ASIA", "[A-Z0-9]{16}"), ("AIza", "[A-Za-z0-9_-]{35}"),
    ("ghp_", "[A-Za-z0-9]{36}"), ("gho_", "[A-Za-z0-9]{36}"), ("ghu_", "[A-Za-z0-9]{36}"), ("ghs_", "[A-Za-z0-9]{36}"), ("ghr_", "[A-Za-z0-9]{36}"),
    ("github_pat_", "[A-Za-z0-9_]{82}"), ("glpat-", "[A-Za-z0-9_-]{20}"), ("npm_", "[A-Za-z0-9]{36}"),
    ("xoxb-", "[A-Za-z0-9-]{20,80}"), ("xoxp-", "[A-Za-z0-9-]{20,80}"), ("sk_live_", "[A-Za-z0-9]{24,99}"), ("rk_live_", "[A-Za-z0-9]{24,99}"),
)
_ISSUED = "(?P<issuer>" + "|".join(x for x, _ in ISSUERS) + ")(?P<key>" + "|".join(f"(?<={x}){y}" for x, y in ISSUERS) + ")"

#: Numbers without + have no other group of digits beside them.
_ALONE = r"(?<![\w+.-])(?<!\d[ .-])", r"(?![\w-])(?![ .]\d)"
_PLUS = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,5}){1,6})(?!\w)"
_AREA = rf"(?P<area>{_ALONE[0]}(?:\([2-9]\d\d\) ?|[2-9]\d\d(?P<sep>[ .-]))[2-9]\d\d(?(sep)(?P=sep)|[ .-])\d{{4}}{_ALONE[1]})"
_TRUNK = rf"(?P<trunk>{_ALONE[0]}(?:0[1-9]\d{{0,4}}(?P<by>[ -])\d{{3,4}}(?P=by)\d{{3,4}}|0[1-9](?: \d\d){{4}}){_ALONE[1]})"
#: Eight groups, or a run of groups with :: in it, of which ip wants three and a digit at least.
_GROUPS = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?=(?::*[0-9A-Fa-f]{1,4}){3})(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}:|:){2,8}(?:[0-9A-Fa-f]{1,4})?)(?![\w:])"

#: In order; a later kind doesn't look into what an earlier one took.
KINDS: dict[str, tuple[str, Callable[[Permutation, re.Match, bool], str | list[tuple[int, int, str]] | None]]] = {
    "email": (r"(?<![\w.%+-])(?P<local>[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])@(?P<host>(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", email),
    "secret": (rf"(?i:(?P<head>\b(?:api[_-]?key|token|secret|password|passwd)\b[\"']?\s*[:=]\s*[\"']?)(?P<body>[0-9a-f]{{32,}})(?![0-9a-z]))|(?<![\w-])(?:{_ISSUED})(?![\w-])", secret),
    "iban": (r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,4})?)(?![A-Za-z0-9])", iban),
    "phone": (rf"{_PLUS}|{_AREA}|{_TRUNK}", phone),
    "card": (r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?![\w-])", cards),
    "date": (r"(?<![\w./-])(?P<a>\d{4}|\d{1,2})(?P<s>[-./])(?P<b>\d{1,2})(?P=s)(?P<c>\d{4}|\d{1,2})(?:(?=[Tt]\d\d:?\d\d)|(?![\w/-]))(?!\.\d)", date),
    "ssn": (r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?![\w-])", ssn),
    "ip": (rf"(?<![\w.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![\w])(?!\.\d)|{_GROUPS}", ip),
}
#: What every value of a kind has.
_SIGNS = {"email": "@"}
_COMPILED = {k: (re.compile(r), f) for k, (r, f) in KINDS.items()}


def pseudonymise(text: str, p: Permutation, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many of each kind."""
    counts: dict[str, int] = {}
    taken: list[tuple[int, int, str]] = []
    covered = bytearray(len(text))
    for kind, (pattern, make) in _COMPILED.items():
        if (sign := _SIGNS.get(kind)) and sign not in text:
            continue
        for m in pattern.finditer(text):
            if covered.find(1, m.start(), m.end()) >= 0:
                continue
            made = make(p, m, back)
            if isinstance(made, str):
                made = [(m.start(), m.end(), made)]
            for one in made or []:
                taken.append(one)
                covered[one[0] : one[1]] = b"\1" * (one[1] - one[0])
                counts[kind] = counts.get(kind, 0) + 1
    out, at = [], 0
    for a, b, made in sorted(taken):
        out += text[at:a], made
        at = b
    return "".join([*out, text[at:]]), counts


_LOOK = "[0-9@]|(?i:key|token|secret|passw)|" + "|".join(x for x, _ in ISSUERS)


def _over(key: bytes, width: int, text_at: int, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for batch in batches:
            texts = batch.column(text_at)
            # every kind has a digit, an @, or the name of a secret or its issuer
            look = pc.fill_null(pc.match_substring_regex(texts, _LOOK), False)
            made = {}
            counts = [{} for _ in range(batch.num_rows)]
            for i in pc.indices_nonzero(look).to_pylist():
                new, counts[i] = pseudonymise(texts[i].as_py(), p, back)
                if counts[i]:
                    made[i] = new
            if made:
                hit = pa.array([i in made for i in range(batch.num_rows)])
                texts = pc.replace_with_mask(texts, hit, pa.array([made[i] for i in sorted(made)], texts.type))
            columns = [texts if j == text_at else batch.column(j) for j in range(width)]
            found = [pa.array([c.get(k, 0) for c in counts], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[f"c{j}" for j in range(width + len(KINDS))])

    return run


def pseudonymise_documents(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with pseudonyms in text, and n_<kind> for each kind.  Columns of those names give way."""
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    names = docs.columns
    schema = T.StructType([T.StructField(f"c{j}", f.dataType) for j, f in enumerate(docs.schema.fields)] + [T.StructField(f"c{len(names) + k}", T.IntegerType()) for k in range(len(KINDS))])
    return docs.mapInArrow(_over(key, len(names), names.index("text"), back), schema).toDF(*names, *[f"n_{k}" for k in KINDS])


def corpus_key(spark: SparkSession) -> bytes:
    """The key in the session's settings.  Where there is none, one is drawn and set there, so pseudonyms agree within a
    session and nobody without the setting can undo them."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), "text")
    return pseudonymise_documents(docs, corpus_key(spark))
