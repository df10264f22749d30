"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text, whatever their case: at-signs, schemes, identifier cues, plus signs
before digits, and digit pairs that an address or a number must contain. Deterministic local parsers then expand
each anchor to its boundaries and validate it. Kinds email, ip, card and phone equal leftmost non-overlapping matches
of their patterns; account (a number or code after a cue such as iban), secret (the value that is given to a cue such
as token or password, or a key that is known by its form) and login (user and password in a url) are the method's own.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

Span = tuple[int, int]
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "login")
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | _DIGITS
_LOCAL, _LABEL, _PHONE = _ALNUM | frozenset("._%+-"), _ALNUM | {"-"}, _DIGITS | frozenset(" ().-")
# Fixed values, in lower case: cues before an account number or identifier, before a key, before a password; url schemes.
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "driver license", "tax id", "konto", "kontonummer", "cuenta", "compte")
KEY_CUES = ("token", "api key", "api_key", "api-key", "apikey", "secret", "secret key", "secret_key", "access key", "access_key", "private key", "private_key", "client_secret", "auth", "authorization", "bearer", "credential", "credentials")
PASSWORD_CUES = ("password", "passwd", "passwort", "passphrase", "pwd", "contraseña", "mot de passe", "kennwort")
# Heads of keys that are known by their form, in lower case, and the forms.
FORMS = (
    ("akia", r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("asia", r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("ghp_", r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    ("gho_", r"gho_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    ("ghs_", r"ghs_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    ("github_pat_", r"github_pat_[0-9A-Za-z_]{22,255}(?![0-9A-Za-z_])"),
    ("glpat-", r"glpat-[0-9A-Za-z_-]{20}(?![0-9A-Za-z_-])"),
    ("xoxb-", r"xoxb-[0-9A-Za-z-]{10,255}(?![0-9A-Za-z-])"),
    ("xoxp-", r"xoxp-[0-9A-Za-z-]{10,255}(?![0-9A-Za-z-])"),
    ("eyj", r"eyJ[0-9A-Za-z_-]{5,}\.eyJ[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{10,}"),
    ("-----begin ", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----(?:[^-]{0,16384}-----END (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----)?"),
)
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    for d in sorted(_DIGITS):
        a.add_word(f"+{d}", ("plus", 2))
        for e in sorted(_DIGITS):
            a.add_word(f"{d}.{e}", ("dot", 3))
            a.add_word(f"{d}{e}", ("digits", 2))
            a.add_word(f"{d} {e}", ("digits", 3))
            a.add_word(f"{d}-{e}", ("digits", 3))
    for what, cues in (("cue", CUES), ("key", KEY_CUES), ("password", PASSWORD_CUES)):
        for c in cues:
            a.add_word(c, (what, len(c)))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for head, _ in FORMS:
        a.add_word(head, (f"form {head}", len(head)))
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset) -> int:
    """Where the run of chars that starts at `at` ends."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _back(text: str, at: int, floor: int, chars: frozenset) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


class _Email:
    """Around an at-sign: local part back to the last match, labels forward, at least one dot."""

    end = 0

    def parse(self, text: str, at: int) -> Span | None:
        start = _back(text, at, self.end, _LOCAL)
        end = _run(text, at + 1, _LABEL)
        if start == at or end == at + 1:
            return None
        labels = 0
        while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
            end, labels = _run(text, end + 1, _LABEL), labels + 1
        if not labels:
            return None
        self.end = end
        return start, end


class _Ip:
    """Around digit, dot, digit: four dotted numbers, whole runs of digits; checked after it is consumed."""

    end = 0

    def parse(self, text: str, at: int) -> Span | None:
        if at < self.end:
            return None
        start = end = _back(text, at, self.end, _DIGITS)
        for k in range(4):
            if k and not (end < len(text) and text[end] == "." and end + 1 < len(text) and text[end + 1] in _DIGITS):
                return None
            end = _run(text, end + (k > 0), _DIGITS)
        self.end = end
        parts = text[start:end].split(".")
        return (start, end) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts) else None


class _Card:
    """Around two digits with one blank, hyphen or nothing between: the whole run, 13 to 19 digits, Luhn."""

    end = 0

    def parse(self, text: str, at: int) -> Span | None:
        if at < self.end:
            return None
        start, end, n = at, at, len(text)
        while end < n:
            if text[end] in _DIGITS:
                end += 1
            elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
                end += 2
            else:
                break
        self.end = end
        digits = text[start:end].replace(" ", "").replace("-", "")
        return (start, end) if 13 <= len(digits) <= 19 and luhn(digits) else None


class _Phone:
    """From a plus sign: digits and separators up to the last digit, at least two signs after the first digit, 9 to 15 digits."""

    end = 0

    def parse(self, text: str, at: int) -> Span | None:
        if at < self.end:
            return None
        end = _run(text, at + 2, _PHONE)
        while end > at and text[end - 1] not in _DIGITS:
            end -= 1
        if end < at + 4:
            return None
        self.end = end
        return (at, end) if 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15 else None


class _Account:
    """After a cue that is a whole word, a verb or a few separators: groups of letters and digits, each with a digit, together
    8 to 34 signs, four digits or more. A longer row of such groups is no account, nor is its beginning."""

    end = 0
    _gap = re.compile(r"(?:\s?(?:no|nr|number|num)\b\.?)?(?:\s(?:is|was|are|ist|lautet|es|est)\b)?[\s:#=]{1,3}", re.I | re.A)
    _word = re.compile(r"[ -]?([A-Za-z0-9]+)")

    def parse(self, text: str, at: int, size: int) -> Span | None:
        if at < self.end or at and text[at - 1].isalnum() or not (gap := self._gap.match(text, at + size)):
            return None
        start = end = gap.end()
        signs = 0
        while (word := self._word.match(text, end)) and any(c in _DIGITS for c in word[1]):
            end, signs = word.end(), signs + len(word[1])
            if signs > 34:
                return None
        if signs < 8 or sum(c in _DIGITS for c in text[start:end]) < 4:
            return None
        self.end = end
        return start, end


class _Secret:
    """After a cue that is a whole word: a sign of assignment (or a blank after bearer), then a value, in quotes or bare.

    A key is 8 to 512 letters, digits and signs of usual encodings, with a digit and a letter. A password is
    6 to 128 characters without blanks or quotes, one of them no letter; a bare one loses closing punctuation.
    A key that is known by its form needs no cue.
    """

    end = 0
    _gap = re.compile(r"""["'`]?\s{0,3}(?::=|=>|==|[:=])\s{0,3}(?:bearer\s)?["'`]?""", re.I)
    _blank = re.compile(r"\s")
    # A run that reaches its limit is too long; the limits keep the time linear.
    _key = re.compile(r"[A-Za-z0-9_+/=.~-]{1,513}")
    _password = re.compile(r"""[^\s"'`]{1,129}""")

    def parse(self, text: str, at: int, size: int, what: str) -> Span | None:
        if at < self.end or at and text[at - 1].isalnum():
            return None
        gap = self._gap.match(text, at + size)
        if not gap and text[at : at + size].lower() == "bearer":
            gap = self._blank.match(text, at + size)
        value = gap and (self._key if what == "key" else self._password).match(text, gap.end())
        if not value:
            return None
        start, key = value.start(), what == "key"
        body = value[0].rstrip(".~-" if key else ".,;:!?)]}")
        if key:
            good = len(value[0]) <= 512 and len(body) >= 8 and any(c in _DIGITS for c in body) and any(c in _ALNUM and c not in _DIGITS for c in body)
        else:
            good = len(value[0]) <= 128 and len(body) >= 6 and not body.isalpha()
        if not good:
            return None
        self.end = start + len(body)
        return start, self.end


    _forms = {head: re.compile(rx) for head, rx in FORMS}

    def form(self, text: str, at: int, head: str) -> Span | None:
        # Nothing that could belong to the key stands before it, so that no run is read twice.
        if at < self.end or at and (text[at - 1].isalnum() or text[at - 1] in "_-") or not (m := self._forms[head].match(text, at)):
            return None
        self.end = m.end()
        return m.span()


class _Login:
    """After a scheme: user:password@ before the host."""

    end = 0
    _pair = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")

    def parse(self, text: str, at: int, size: int) -> Span | None:
        if at < self.end or not (m := self._pair.match(text, at + size)):
            return None
        self.end = m.end()
        return m.span()


def find(text: str) -> dict[str, list[Span]]:
    """Spans by kind in code points, end exclusive, in order."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    email, ip, card, phone, account, secret, login = _Email(), _Ip(), _Card(), _Phone(), _Account(), _Secret(), _Login()

    def add(kind: str, span: Span | None) -> None:
        if span:
            out[kind].append(span)

    # Anchors are found in lower case. Two letters would move places or become ASCII: with them, only A-Z is lower-cased.
    for last, (what, size) in automaton().iter(text.translate(_FOLD) if "\u0130" in text or "\u212a" in text else text.lower()):
        at = last - size + 1
        if what == "digits":
            add("card", card.parse(text, at))
        elif what == "at":
            add("email", email.parse(text, at))
        elif what == "dot":
            add("ip", ip.parse(text, at))
        elif what == "plus":
            add("phone", phone.parse(text, at))
        elif what == "cue":
            add("account", account.parse(text, at, size))
        elif what in ("key", "password"):
            add("secret", secret.parse(text, at, size, what))
        elif what.startswith("form "):
            add("secret", secret.form(text, at, what[5:]))
        else:
            add("login", login.parse(text, at, size))
    return out


def _listed(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in kinds for a, z in sorted(spans[k]))


_RESULT = "n_email long, n_ip long, n_card long, n_phone long, n_account long, n_secret long, n_login long, base_spans string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, n_account, n_secret, n_login long, n_spans long (all), found boolean, and
    base_spans and spans: kind:start:end by kind, then start, comma-joined.

    Null and empty texts have no spans. Texts are read whole. Columns of docs of these names are replaced, all others stay.
    """
    names = [c.split()[0] for c in _RESULT.split(", ")]

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = find(t)
            rows.append((*(len(s[k]) for k in KINDS), _listed(s, BASE), _listed(s, KINDS)))
        return pd.DataFrame(rows, columns=names)

    got = packed(docs, s=run(F.coalesce(F.col("text"), F.lit(""))))
    total = sum((F.col(f"s.n_{k}") for k in KINDS[1:]), F.col(f"s.n_{KINDS[0]}"))
    return unpacked(got, docs, new={n: F.col(f"s.{n}") for n in names} | {"n_spans": total, "found": total > 0})


def redact(docs: DataFrame, marks: dict[str, str] | None = None) -> DataFrame:
    """docs with every span in text replaced by <kind>, or marks[kind]; overlapping spans become the earliest one's mark. Null stays null."""
    marks = marks or {}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts, at = [], 0
            for a, z, k in sorted((a, z, k) for k, own in find(t or "").items() for a, z in own):
                if a >= at:
                    parts += [t[at:a], marks.get(k, f"<{k}>")]
                at = max(at, z)
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out)

    return docs.withColumn("text", run("text"))
