"""Personal information in free text: found, typed, and replaced by linked pseudonyms.

Types: name, email, phone, id, address. Patterns are anchored on format (separators,
group lengths, street words, labels), names on a list of name parts, its affixes and
initials. Overlaps are settled by ORDER: email, address, id, phone, name.

A placeholder is [TYPE value], where the value of a number is permuted within its own
format by a keyed Feistel network: dates inside identity numbers within the calendar,
numbers that pass the check of their kind (`valid`) to others that pass it and the rest to
the rest, telephone numbers without country code, trunk zero and extension, which stand
beside. Other types carry a keyed tag of their canonical form (`canonical`). So equal values
stay linked across documents however they are written.

Defined results: null text has no finding and stays null; empty text stays empty;
repeated rows give repeated findings; positions count Unicode characters from 1; extra
columns are ignored. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that mark streets, numbers and persons.
STREET = "street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|way|crescent|cres|drive|dr|court|ct|square|sq|place|terrace"
STREET_GLUED = "straße|strasse|str|weg|gasse|allee|platz|ring|damm"
STREET_BEFORE = "calle|avenida|avda|plaza|paseo|rue|via"
TITLES = {"dr", "prof", "mr", "mrs", "ms", "mx", "miss", "sir", "frau", "herr", "sr", "sra", "srta", "señor", "señora", "don", "doña", "mme", "m"}
FIRM_AFTER = re.compile(r"^(?:\s*&|,?\s*(?:Ltd|Inc|GmbH|LLC|AG|Corp|Co|brand|Sons|Trio)\b)")
DOTTED = r"(?:\.|\s?[\[(]\s?(?:dot|punkt|punto)\s?[\])]\s?|\s(?:dot|punkt|punto)\s)"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
EMAIL = re.compile(
    rf"(?<![\w.+-])(?:{LOCAL}\s?(?:@|[\[(]\s?at\s?[\])])\s?{LABEL}(?:{DOTTED}{LABEL})*(?:{DOTTED}[A-Za-z]{{2,}})|{LOCAL}\sat\s{LABEL}(?:\sdot\s{LABEL})*\sdot\s[A-Za-z]{{2,}})(?![\w-])"
)
ID = re.compile(
    r"(?<![\w-])(?:"
    r"(?P<ni>[A-Z]{2}(?: ?\d\d){3} ?[A-D])"
    r"|(?P<ssn>\d{3}[- ]\d{2}[- ]\d{4})"
    r"|(?P<rrn>\d{6}-\d{7})"
    r"|(?P<passport>[A-Z]{2}\d{7}|[A-Z]\d{8})"
    r"|(?P<nif>\d{8}[A-HJ-NP-TV-Z])"
    r"|(?P<tax>(?<=tax id )\d{11}|(?<=tax no )\d{11}|(?<=tax no\. )\d{11}|(?<=Steuer-ID )\d{11}|(?<=IdNr )\d{11}|(?<=IdNr\. )\d{11}|00\d{9}(?!\d))"
    r")(?![\w-])"
)
EXT = r"(?:\s?(?:ext\.?|x|Durchwahl)\s?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w.+/#-])(?:"
    r"(?:\+|00)\d{1,3}[\s.-]?(?:\(0\)\s?)?\(?\d{1,4}\)?(?:[\s./-]?\d{2,5}){1,4}"  # international
    r"|\(\d{2,5}\)\s?\d{3,5}[\s.-]?\d{3,5}"  # area code in brackets
    r"|1?[\s.-]?\d{3}[.-]\d{3}[.-]\d{4}"  # three groups
    r"|0\d{1,4}[ /-]\d{3,5}[ -]?\d{3,5}"  # trunk zero
    r"|1\d{10}"  # plain with country code
    rf"){EXT}(?![\w/-])(?!\.\d)"
)
_S = r"[^\S\n]"  # a blank within a line
_WORD = r"(?!(?:the|a|an|this|that|my|our|their)\b)[^\W\d_]+"
ADDRESS = re.compile(
    r"(?<![\w:.,-])(?:"
    rf"(?:P\.?{_S}?O\.?{_S}Box|Postfach|Apartado(?: de correos)?){_S}\d+"
    rf"|\d{{1,5}}[A-Za-z]?{_S}{_WORD}(?:{_S}{_WORD})?{_S}(?:{STREET})\b"
    rf"|[^\W\d_]+(?:{STREET_GLUED}){_S}\d{{1,4}}{_S}?[a-z]?\b"
    rf"|(?:{STREET_BEFORE}){_S}[^\W\d_]+(?:{_S}[^\W\d_]+)?,?{_S}\d{{1,5}}"
    rf"|[^\W\d_]+-(?:gu|si|dong){_S}[^\W\d_]+-(?:ro|daero|gil)(?:{_S}\d+-gil)?{_S}\d+(?:-\d+)?"
    r")",
    re.I,
)
_TOWN = r"(?!(?:[Rr]ing|[Bb]itte|[Cc]all|[Tt]el|[Aa]nd|[Aa]sk|[Ff]lat)\b)"
_ADDRESS_TAIL = re.compile(
    rf"\.?(?:,{_S}(?:[Ff]lat|[Aa]pt|[Uu]nit|[Ss]uite)\.?{_S}\d+\w?|,{_S}\d+º)?"
    rf"(?:,{_S}\d{{5}}{_S}[^\W\d_]+|,{_S}{_TOWN}[^\W\d_]+{_S}\d{{5}}(?!\d)|,{_S}{_TOWN}[A-Z][^\W\d_]+|,{_S}{_TOWN}[a-z]+(?=\s*(?:[.;,!?()\n]|$))|{_S}\d{{5}}\b)?"
)
_TOKEN = re.compile(r"[^\W\d_]+")
_AT, _DIGIT = re.compile(r"@|at[\s)\]]"), re.compile(r"\d")
ORDER = ("email", "address", "id", "phone", "name")


class Names:
    """Known parts of personal names, widened by the affixes that many of them share."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = {g.lower() for g in given}, {f.lower() for f in family}
        self.affixes = [self._affixes(self.given), self._affixes(self.family)]
        self._roles: dict[str, str] = {}

    @staticmethod
    def _affixes(names: set[str]) -> tuple[set[str], set[str]]:
        ends: dict[str, set[str]] = {}
        for n in names:
            for i in range(2, len(n) - 2):
                ends.setdefault(n[i:], set()).add(n[:i])
        ends = {e: p for e, p in ends.items() if len(e) >= 3 and len(p) >= 4}
        heads: dict[str, int] = {}
        for p in ends.values():
            for h in p:
                heads[h] = heads.get(h, 0) + 1
        return {h for h, k in heads.items() if k >= 3}, set(ends)

    def role(self, word: str) -> str:
        """'g', 'f' or '' of a word; kept by word, all forgotten when there are too many."""
        got = self._roles.get(word)
        if got is None:
            if len(self._roles) >= 1 << 18:
                self._roles.clear()
            got = self._roles[word] = self._role(word.lower())
        return got

    def _role(self, w: str) -> str:
        if w in self.family:
            return "f"
        if w in self.given:
            return "g"
        for r, (heads, tails) in zip("gf", self.affixes, strict=True):
            if any(w[:i] in heads and w[i:] in tails for i in range(2, len(w) - 2)):
                return r
        return ""

    def find(self, text: str) -> list[tuple[int, int]]:
        """Spans of personal names of at least two parts."""
        toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        roles = [self.role(t[2]) for t in toks]
        out, i = [], 0
        gap = lambda a, b: text[toks[a][1] : toks[b][0]]
        initial = lambda k: k < len(toks) and len(toks[k][2]) == 1 and toks[k][2].isupper() and text[toks[k][1] : toks[k][1] + 1] == "."
        while i < len(toks):
            j = None
            if roles[i] == "f" and i + 1 < len(toks) and gap(i, i + 1) == ", " and (roles[i + 1] == "g" and not (i + 2 < len(toks) and gap(i + 1, i + 2) in (" ", "-") and roles[i + 2] == "f")):
                j = i + 1
            elif roles[i] == "g" or initial(i) or (not roles[i] and toks[i][2].istitle() and len(toks[i][2]) > 2 and toks[i][2].lower() not in TITLES):
                k = i
                while k + 1 < len(toks):
                    g = gap(k, k + 1)
                    if roles[k + 1] == "f" and (g == " " or (g == ". " and initial(k))) or roles[k + 1] == "f" and g == "-" and k > i:
                        k += 1
                        if roles[k] == "f" and not (k + 1 < len(toks) and gap(k, k + 1) == "-" and roles[k + 1] == "f"):
                            break
                    elif k == i and g in (" ", ". ") and (initial(k + 1) and (roles[i] == "g" or initial(i)) or roles[k + 1] == "g" and g == " " and roles[i] == "g"):
                        k += 1
                    else:
                        break
                if k > i and roles[k] == "f":
                    j = k
            if j is not None and not FIRM_AFTER.match(text[toks[j][1] :]):
                out.append((toks[i][0], toks[j][1]))
                i = j + 1
            else:
                i += 1
        return out


def find(text: str, names: Names) -> list[tuple[str, int, int]]:
    """(type, start, end) of all findings, in text order, none overlapping another."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in ORDER}
    # what no pattern of a type can do without is looked for first
    at, digit = _AT.search(text), _DIGIT.search(text)
    found["email"] = [m.span() for m in EMAIL.finditer(text)] if at else []
    for m in ADDRESS.finditer(text) if digit else ():
        end = _ADDRESS_TAIL.match(text, m.end()).end()
        if text[end - 1] == "." and end > m.end() and text[end : end + 1] not in (".", ","):
            end -= 1
        found["address"].append((m.start(), end))
    # a Spanish number has no other mark than its check letter
    found["id"] = [m.span() for m in (ID.finditer(text) if digit else ()) if m.lastgroup != "nif" or valid("nif", m[0])]
    found["phone"] = [m.span() for m in (PHONE.finditer(text) if digit else ()) if 7 <= sum(c.isdigit() for c in m[0]) <= 20]
    found["name"] = names.find(text)
    starts: list[int] = []  # of all spans taken, in order; none overlaps another
    taken: list[tuple[int, int, str]] = []
    for kind in ORDER:
        for a, b in found[kind]:
            i = bisect_left(starts, a)
            if (i == len(starts) or starts[i] >= b) and (i == 0 or taken[i - 1][1] <= a):
                starts.insert(i, a)
                taken.insert(i, (a, b, kind))
    return [(kind, a, b) for a, b, kind in taken]


# ---- pseudonyms ------------------------------------------------------------------


def _round(key: bytes, tweak: str, i: int, half: str, modulus: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tweak}|{i}|{half}".encode(), hashlib.sha256).digest()[:16], "big") % modulus


def permute(digits: str, key: bytes, tweak: str = "", undo: bool = False, rounds: int = 10) -> str:
    """Keyed permutation of digit strings of one length (alternating Feistel network)."""
    if len(digits) < 2:
        shift = _round(key, tweak, 0, "", 10)
        return "".join(str((int(d) + (-shift if undo else shift)) % 10) for d in digits)
    u = len(digits) // 2
    v = len(digits) - u
    a, b = digits[:u], digits[u:]
    for i in reversed(range(rounds)) if undo else range(rounds):
        size = u if i % 2 == 0 else v
        mod = 10**size
        if undo:
            a, b = f"{(int(b) - _round(key, tweak, i, a, mod)) % mod:0{size}d}", a
        else:
            a, b = b, f"{(int(a) + _round(key, tweak, i, b, mod)) % mod:0{size}d}"
    return a + b


def permute_date(yymmdd: str, key: bytes, undo: bool = False) -> str | None:
    """Permutation of the calendar days of 1900-1999, by walking the cycle until a day is hit."""
    base = date(1900, 1, 1)
    try:
        n = (date(1900 + int(yymmdd[:2]), int(yymmdd[2:4]), int(yymmdd[4:])) - base).days
    except ValueError:
        return None
    days = (date(2000, 1, 1) - base).days
    while (n := int(permute(f"{n:05d}", key, "date", undo))) >= days:
        pass
    d = base + timedelta(n)
    return f"{d.year - 1900:02d}{d.month:02d}{d.day:02d}"


# Country codes of one and of two digits (all others have three), the check
# letters of the Spanish identity number, the weights of the Korean resident number, and
# letters and pairs that no British insurance number begins with.
COUNTRY_ONE = ("1", "7")
COUNTRY_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
NI_NEVER = ({"D", "F", "I", "Q", "U", "V"}, {"BG", "GB", "KN", "NK", "NT", "TN", "ZZ"})


def id_kind(value: str) -> str:
    """Which kind of identity number a finding is; '' for one without rules."""
    m = ID.fullmatch(value)
    return (m.lastgroup or "") if m else "tax" if re.fullmatch(r"\d{11}", value) else ""


def valid(kind: str, value: str) -> bool:
    """Check of an identity number by the rules of its kind: ranges or check digit."""
    d = [int(c) for c in value if c.isdigit()]
    letters = "".join(c for c in value if c.isalpha())
    if kind == "ssn":
        area, group, serial = (int("".join(map(str, d[i:j]))) for i, j in ((0, 3), (3, 5), (5, 9)))
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0
    if kind == "rrn":
        return (11 - sum(w * x for w, x in zip(RRN_WEIGHTS, d, strict=False)) % 11) % 10 == d[12]
    if kind == "nif":
        return NIF_LETTERS[int("".join(map(str, d))) % 23] == letters
    if kind == "ni":
        return not set(letters[:2]) & NI_NEVER[0] and letters[1] != "O" and letters[:2] not in NI_NEVER[1]
    if kind == "tax":  # ISO 7064 mod 11,10; the first digit is no zero
        p = 10
        for x in d[:10]:
            p = ((p + x) % 10 or 10) * 2 % 11
        return d[0] != 0 and (11 - p) % 10 == d[10]
    return True


def _filled(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _id_pseudonym(value: str, key: bytes) -> str:
    """A number of the same format that is valid iff the given one is, by walking the cycle of
    the permutation; a birth date stays a date, a check letter is made anew."""
    kind = id_kind(value)
    digits, was = "".join(c for c in value if c.isdigit()), valid(kind, value)
    if kind == "nif":
        new = permute(digits, key, "id")
        return new + NIF_LETTERS[int(new) % 23]
    day = permute_date(digits[:6], key) if kind == "rrn" else None
    head, rest = (day, digits[6:]) if day else ("", digits)
    while True:
        rest = permute(rest, key, "id")
        new = _filled(value, head + rest)
        if kind == "ni" or valid(kind, new) == was:
            return new


def phone_parts(value: str) -> tuple[str, str, str, str]:
    """(before, national number, extension mark, extension) of a telephone number as written:
    the country code and trunk zero stand before and are kept, so that a number with and
    without them is one number."""
    m = re.match(r"(.*?)(\s?(?:ext\.?|x|Durchwahl)\s?)(\d{1,5})$", value)
    body, mark, ext = (m[1], m[2], m[3]) if m else (value, "", "")
    digits = [(i, c) for i, c in enumerate(body) if c.isdigit()]
    text = "".join(c for _, c in digits)
    skip = 0
    if body.lstrip("(").startswith("+") or text.startswith("00"):
        skip = 2 * text.startswith("00")
        code = text[skip:]
        skip += 1 if code[:1] in COUNTRY_ONE else 2 if code[:2] in COUNTRY_TWO else 3
    elif len(text) == 11 and text[0] == "1":
        skip = 1
    if text[skip : skip + 1] == "0":  # the trunk zero, also as (0)
        skip += 1
    at = digits[skip][0] if skip < len(digits) else len(body)
    return body[:at], body[at:], mark, ext


def canonical(kind: str, value: str) -> str:
    """The form in which equal values are equal: addresses of mail without their disguise,
    names in the order given, family, numbers of telephones without country and extension."""
    if kind == "email":
        v = re.sub(r"\s?[\[(]\s?at\s?[\])]\s?|\sat\s", "@", value.lower())
        v = re.sub(r"\s?[\[(]\s?(?:dot|punkt|punto)\s?[\])]\s?|\s(?:dot|punkt|punto)\s", ".", v)
        return re.sub(r"\s", "", v)
    if kind == "name":
        family, comma, given = value.lower().partition(", ")
        return " ".join(_TOKEN.findall(f"{given} {family}" if comma else family))
    if kind == "phone":
        return "".join(c for c in phone_parts(value)[1] if c.isdigit())
    return re.sub(r"\W+", " ", value.lower()).strip()


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """Linked stand-in of a value, in its format where it is a number."""
    if kind == "phone":
        before, national, mark, ext = phone_parts(value)
        new = permute(canonical(kind, value), key, kind)
        return before + _filled(national, new) + mark + (permute(ext, key, "ext") if ext else "")
    if kind == "id":
        return _id_pseudonym(value, key)
    return hmac.new(key, f"{kind}|{canonical(kind, value)}".encode(), hashlib.sha256).hexdigest()[:10]


def mask(text: str, names: Names, key: bytes) -> str:
    out, at = [], 0
    for kind, a, b in find(text, names):
        out += [text[at:a], f"[{kind.upper()} {pseudonym(kind, text[a:b], key)}]"]
        at = b
    return "".join([*out, text[at:]])


def load_names(parts: DataFrame, limit: int = 100_000) -> Names:
    """The name list, which is refused beyond `limit` rows: it goes to every task."""
    rows = parts.select("name_part", "part_role").where("name_part is not null").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("the list of name parts is too long to be sent to every task")
    return Names({r[0] for r in rows if r[1] == "given"}, {r[0] for r in rows if r[1] == "family"})


def findings(rows: DataFrame, names: Names, text_col: str, *keep: str) -> DataFrame:
    """(keep..., pii_type, start_pos): one row per occurrence."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"pii_type": k, "start_pos": a + 1} for k, a, _ in find(t, names)])

    udf = F.pandas_udf(run, "array<struct<pii_type:string,start_pos:int>>")
    return rows.where(F.length(text_col) > 0).select(*keep, F.explode(udf(F.col(text_col))).alias("p")).select(*keep, "p.pii_type", "p.start_pos")


def masked(rows: DataFrame, names: Names, key: bytes, text_col: str) -> DataFrame:
    """rows with the text column masked."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else mask(t, names, key)).astype(object)

    return rows.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))
