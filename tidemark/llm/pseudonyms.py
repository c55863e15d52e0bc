"""PII: format-preserving Feistel pseudonyms."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import secrets

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session keeps its secret, in hexadecimal; see ``session_key``.
KEY_SETTING = "spark.tidemark.pseudonymKey"
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CLASS = {c: cls for cls in (_LOWER, _UPPER, _DIGIT) for c in cls}
ROUNDS = 10

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))
  | (?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
      |(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|secret[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)[^\s"'<>,;]{6,128})
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
  | (?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_]|\.[0-9]))
  | (?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?![0-9A-Za-z]|[./-][0-9]))
  | (?P<phone>(?<![\w+])\+[1-9](?:(?:[ .-]?\([0-9]{1,4}\)[ .-]?|[ .-]?)[0-9]){7,15}(?![0-9A-Za-z])
      |(?<![\w(+])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<card>(?:(?<![0-9A-Za-z-])|(?<=[0-9]-))[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))
    """,
    re.X,
)
#: Each kind alone, in the order in which they are tried at a place.
KINDS = {m[1]: re.compile(m[0], re.X) for m in re.finditer(r"\(\?P<(email|secret|iban|ip|date|phone|ssn|card)>.*?(?=\n  \||\n    $)", PATTERN.pattern, re.S)}
#: What may stand between the groups of kinds that can take in what follows them.
_BETWEEN = {"iban": " ", "card": " -", "phone": " .-"}
#: Country codes of two digits; +1 and +7 stand alone, all others have three.
_TWO_DIGIT_CODES = frozenset(map(str, (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)))
#: Cards as they are commonly written.
_CARD = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])")
#: How often a checked number is permuted on where its image and what stands beside it would read as another value.
_TRIES = 1000


class Feistel:
    """A keyed permutation of 0 .. n-1 for any n: a Feistel network over two nearly equal factors, walked back into range."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.left = math.isqrt(n - 1) + 1 if n > 1 else 1
        self.right = -(-n // self.left)
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), f"{tweak}/{n}/".encode()

    def _round(self, r: int, half: int, modulus: int) -> int:
        size = modulus.bit_length() // 8 + 9
        data, out = self.tweak + b"%d/%d" % (r, half), b""
        while len(out) < size:
            out += hashlib.blake2b(data + b"/%d" % len(out), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:size], "big") % modulus

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2 == 0:
                a = (a + sign * self._round(r, b, self.left)) % self.left
            else:
                b = (b + sign * self._round(r, a, self.right)) % self.right
        return a * self.right + b

    def walk(self, x: int, allowed=lambda y: True, back: bool = False) -> int:
        """The image of x; values out of range or not ``allowed`` are permuted on, which keeps it a permutation of the allowed ones."""
        while True:
            x = self._once(x, back)
            if x < self.n and allowed(x):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonymiser:
    """Replaces every validated value by its image under the key; ``back`` undoes it."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.known = key, back, {}

    def _chars(self, kind: str, text: str, allowed=lambda t: True) -> str:
        """Letters stay letters of their case, digits stay digits, anything else stays in place."""
        spots = [(k, _CLASS[c]) for k, c in enumerate(text) if c in _CLASS]
        n = math.prod(len(cls) for _, cls in spots)
        value = 0
        for k, cls in spots:
            value = value * len(cls) + cls.index(text[k])

        def show(v: int) -> str:
            out = list(text)
            for k, cls in reversed(spots):
                v, c = divmod(v, len(cls))
                out[k] = cls[c]
            return "".join(out)

        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text)))
        image = Feistel(self.key, f"{kind}/{shape}", n).walk(value, lambda v: allowed(show(v)), self.back)
        return show(image)

    def _digits(self, kind: str, text: str, allowed=lambda t: True) -> str:
        """Equal numbers stay equal whatever separators stand between their digits."""
        digits = "".join(c for c in text if c in _DIGIT)
        image = iter(self._chars(kind, digits, allowed))
        return "".join(next(image) if c in _DIGIT else c for c in text)

    def email(self, text: str) -> str:
        """Addresses that differ in capitals only have one pseudonym, in the capitals of each."""
        host, _, top = text.rpartition(".")
        image = self._chars("email", host.lower())
        return "".join(i.upper() if c in _UPPER else i for c, i in zip(host, image)) + f".{top}"

    def secret(self, text: str) -> str:
        if text[:4] in ("AKIA", "ASIA") and len(text) == 20:
            return text[:4] + self._chars("secret", text[4:])
        name = re.match(r"""[\w-]+["']?\s*[=:]\s*["']?""", text).end()
        return text[:name] + self._chars("secret", text[name:])

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self._chars("iban" + plain[:2], plain[4:])
        check = 98 - iban_rest(f"{plain[:2]}00{body}")
        image = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(image) for c in text)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        open_ = lambda v: 0 < v >> 24 < 224 and v >> 24 not in (10, 127) and v >> 16 not in (0xC0A8, 0xA9FE) and not 0xAC10 <= v >> 16 <= 0xAC1F
        value = int.from_bytes(bytes(map(int, parts)), "big")
        kind = open_(value)
        return ".".join(map(str, Feistel(self.key, "ip", 1 << 32).walk(value, lambda v: open_(v) == kind, self.back).to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        mark = next(c for c in text if c not in _DIGIT)
        parts = text.split(mark)
        widths = [len(p) for p in parts]
        if widths[0] == 4:
            order = "ymd"
        else:
            order = "dmy" if mark == "." or int(parts[0]) > 12 else "mdy"
        try:
            day = dt.date(*(int(parts[order.index(c)]) for c in "ymd")).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        # with slashes or hyphens only days after the 12th read as day first, so they stay among themselves, however a date is written
        late = dt.date.fromordinal(day).day > 12

        def allowed(v: int) -> bool:
            return (dt.date.fromordinal(v + _FIRST_DAY).day > 12) == late

        image = dt.date.fromordinal(_FIRST_DAY + Feistel(self.key, "date", _LAST_DAY - _FIRST_DAY + 1).walk(day - _FIRST_DAY, allowed, self.back))
        fields = {"y": f"{image.year:04d}", "m": f"{image.month:02d}", "d": f"{image.day:02d}"}
        return mark.join(fields[c] for c in order)

    def phone(self, text: str) -> str | None:
        """A number is its country code and the digits after it, whatever stands between them; a (0) in it isn't dialled and stays."""
        spots = [k for k, c in enumerate(text) if c in _DIGIT]
        if not 8 <= len(spots) <= 15:
            return None
        if text[0] == "+":
            lead = "".join(text[k] for k in spots[:3])
            code = lead[0] if lead[0] in "17" else lead[:2] if lead[:2] in _TWO_DIGIT_CODES else lead
            zero = text.find("(0)")
            spots = [k for k in spots[len(code) :] if k != zero + 1 or zero < 0]
        else:
            code = "1"
        digits = "".join(text[k] for k in spots)
        american = lambda d: code == "1" and len(d) == 10 and d[0] > "1" and d[3] > "1"
        if text[0] != "+" and not american(digits):
            return None
        kind, out = american(digits), list(text)
        for k, c in zip(spots, self._chars(f"phone+{code}", digits, lambda d: american(d) == kind)):
            out[k] = c
        return "".join(out)

    def ssn(self, text: str) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        return self._digits("ssn", text, valid) if valid(text.replace("-", "")) else None

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c in _DIGIT)
        if not luhn(digits) or not digits.strip("0"):
            return None
        body = digits[0] + self._chars(f"card{digits[0]}", digits[1:-1], lambda d: d.strip("0") != "" or digits[0] != "0")
        image = iter(body + next(c for c in _DIGIT if luhn(body + c)))
        return "".join(next(image) if c in _DIGIT else c for c in text)

    def _image(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[kind, value] = getattr(self, kind)(value)
        return self.known[kind, value]

    def _end(self, text: str, kind: str, start: int, end: int) -> int | None:
        """The end of the longest value of this kind at ``start`` that validates; shorter ones end between groups."""
        between = _BETWEEN.get(kind, "")
        for e in [end, *(e for e in range(end - 1, start, -1) if text[e] in between)]:
            if e < end and not KINDS[kind].fullmatch(text, start, e):
                continue
            if self._image(kind, text[start:e]) is None:
                continue
            # a number that is a card by chance doesn't cut off the end of one that is written like a card
            if kind == "card" and any(m.end() > e and luhn(re.sub("[ -]", "", m[0])) for m in _CARD.finditer(text, start, e + 24) if start < m.start() < e):
                continue
            return e
        return None

    def values(self, text: str) -> tuple[list[tuple[str, int, int]], bool]:
        """(kind, start, end) of the values to replace, and whether any candidate failed on the way."""
        out, failed, pos = [], False, 0
        while found := PATTERN.search(text, pos):
            start, first = found.start(), next(k for k in KINDS if found[k] is not None)
            pos = start + 1
            for kind in list(KINDS)[list(KINDS).index(first) :]:
                whole = found if kind == first else KINDS[kind].match(text, start)
                end = self._end(text, kind, start, whole.end()) if whole else None
                failed |= whole is not None and end != whole.end()
                if end is not None:
                    out.append((kind, start, end))
                    pos = end
                    break
        return out, failed

    def replace(self, text: str) -> tuple[str, int]:
        found, failed = self.values(text)
        between = [text[a:b] for a, b in zip([0, *(e for _, _, e in found)], [*(s for _, s, _ in found), len(text)])]
        images = [self._image(k, text[s:e]) for k, s, e in found]

        def put(values: list[str]) -> str:
            return "".join(x for pair in zip(between, [*values, ""]) for x in pair)

        def same(values: list[str]) -> bool:
            """The text with these values is read as just these values."""
            made = put(values)
            return [(k, made[s:e]) for k, s, e in self.values(made)[0]] == [(k, v) for (k, _, _), v in zip(found, values)]

        if failed and not same(images):
            # value after value, in the opposite order on the way back, so that both meet the same neighbours
            now = [text[s:e] for _, s, e in found]
            for i in range(len(now) - 1, -1, -1) if self.back else range(len(now)):
                first = now[i] = images[i]
                for _ in range(_TRIES if found[i][0] in ("card", "iban") else 0):
                    if same(now):
                        break
                    now[i] = self._image(found[i][0], now[i])
                else:
                    now[i] = first
            images = now
        return put(images), len(found)


def session_key(spark: SparkSession) -> bytes:
    """The secret of the setting KEY_SETTING. Where it isn't set, a random one that lasts as long as the session, so that nobody can undo its pseudonyms."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return bytes.fromhex(named)
    sc = spark.sparkContext
    if not hasattr(sc, "_tidemark_key"):
        sc._tidemark_key = secrets.token_bytes(32)
    return sc._tidemark_key


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Replaces personal values in texts by other valid values of the same format, by a keyed permutation.

    Kinds: e-mail addresses; card numbers (Luhn), IBANs (mod 97), social security numbers,
    IPv4 addresses (public ones stay public), phone numbers, calendar dates of 1900-2099,
    access keys and named secrets. Where a candidate doesn't validate, shorter ones that end
    between groups, the other kinds and later starts are tried; numbers of which nothing
    validates stay. The permutation depends on key, kind and shape only, so a value has the
    same pseudonym in every document, however a date, number or address of it is written; two
    values never share one, and ``back=True`` with the key restores the texts. Only a card or IBAN whose pseudonym would run together with what
    stands beside it is permuted on there.
    (Dates are written back with two-digit months and days.)

    Returns doc_id, text, n_replaced for each row; with ``keep_columns`` the input's
    columns with the new text, and ``n_chars``, if there is one, recounted.

    - null text: null, n_replaced 0. Empty text: as it is. Null doc_id: handled as any other row.
    - repeated rows: each gives a row. Empty table: empty result. Texts are scanned whole.
    - other columns play no part, whatever their names.
    """

    @F.pandas_udf("text string, n int")
    def change(texts: pd.Series) -> pd.DataFrame:
        worker = Pseudonymiser(key, back)
        done = [(None, 0) if t is None else worker.replace(t) for t in texts]
        return pd.DataFrame(done, columns=["text", "n"])

    # only texts with a digit or a sign that some kind needs are sent to Python
    text = F.col("row")[text_col]
    wanted = text.rlike(r"[0-9@=:]")
    base = docs if keep_columns else docs.select(id_col, text_col)
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"))
    done = packed.select("row", change(F.when(wanted, text)).alias("new"))
    clean = F.coalesce("new.text", text)
    if not keep_columns:
        return done.select(F.col("row")[id_col].alias("doc_id"), clean.alias("text"), F.coalesce("new.n", F.lit(0)).alias("n_replaced"))
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_col:
            value = clean
        elif c == "n_chars":
            value = F.length(clean).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return done.select(*out)


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))
