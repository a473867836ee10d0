"""Personal data, also where it is disguised, with spans in the source's own characters.

Four kinds are found by pattern in the text as it is (the base spans). Then transducers rewrite a copy: look-alike
letters, digits and signs of other scripts become ASCII, invisible characters go, digits spelled as words become digits
and "at"/"dot" disguises become @ and dots. Every character of the copy knows the source characters that it stands for,
so what the patterns find there is mapped back. A span that is new and doesn't overlap a base span of its kind is added.

Defined cases: a null or empty text has no spans; rows are judged one by one, so ties and repeats don't matter; other
columns are ignored; matching is linear in the text's length.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import resident

#: Order of the kinds in results.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain; each @ is looked at once, so long runs cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, end exclusive, in characters."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Characters that look like ASCII ones, in pairs.
_CYRILLIC = "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS"
_GREEK = "οo αa ιi νv ρp υu κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
_SIGNS = "‐- ‑- ‒- –- —- −- ﹣- ․. 。. 。. ﹒. ﹫@ ﹢+"
_HIDDEN = "­​‌‍⁠﻿"
_BLANKS = "              　"


def _look_alikes() -> dict[int, str]:
    pairs = {ord(x[0]): x[1] for x in f"{_CYRILLIC} {_GREEK} {_SIGNS}".split()}
    wide = {c + 0xFEE0: chr(c) for c in range(0x21, 0x7F)}
    digits = {c: str(d) for c in range(0x80, 0x20000) if (d := unicodedata.decimal(chr(c), None)) is not None}
    maths = {c: n for c in range(0x1D400, 0x1D800) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
    return maths | digits | wide | pairs | dict.fromkeys(map(ord, _BLANKS), " ")


_MAP = _look_alikes()
_ALL_ODD = frozenset(map(chr, _MAP)) | frozenset(_HIDDEN)
#: Where one of them may be; a small class, since nearly every text is looked through.
_MAYBE_ODD = re.compile("[\xa0\xad\u0250-\U0010ffff]")
_HIDE = re.compile(f"[{_HIDDEN}]")
# Words for digits, and for signs among them.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8",
    "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SIGN_WORDS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
_TOKEN = re.compile(rf"(?i:{_NUMBER}|{'|'.join(_SIGN_WORDS)})(?![^\W_])|[0-9+.()-]")
#: At least four digits in words, with signs, figures and separators between them; "plus" may stand before.
_RUN = re.compile(
    rf"(?i)(?<![^\W_])(?:(?:plus|\+)[\s-]*)?(?:{_NUMBER})(?![^\W_])(?:[\s,-]+(?:(?:{_NUMBER}|dot|point|punkt|punto|dash|hyphen)(?![^\W_])|[0-9]+))+"
)
#: How every run goes on after its sign: looked for before anything else.
_TWO = re.compile(
    rf"(?i)(?<![^\W_])(?=[{''.join(sorted({w[0] for w in _SPELLED}))}])(?:{_NUMBER})[\s,-]+(?:{_NUMBER}|dot|point|punkt|punto|dash|hyphen|[0-9])"
)
_AT = re.compile(r"(?i)[\[({<]\s*+(?:at|@|arroba)\s*+[\])}>]|(?<![^\W_])(?:_at_|-at-)")
_DOT = re.compile(r"(?i)[\[({<]\s*+(?:dot|\.|punkt|point|punto)\s*+[\])}>]")
# The last part of a spelled-out domain.
_ENDS = "com|org|net|edu|gov|info|biz|io|co|eu|de|fr|es|uk|us|ch|at|it|nl|ca|au|in|br|mx|ru|cn|jp|dev|app|example|test"
#: Plain " at " counts only where a name stands before it and the domain after it is spelled out too.
_PLAIN_AT = re.compile(r"(?i)(?<=[a-z0-9._%+-]) at (?=[a-z0-9-])")
_DOMAIN_WORDS = re.compile(r"(?i)[a-z0-9-]++(?:(?: dot |\.)[a-z0-9-]++)* dot (?:" + _ENDS + r")(?![^\W_])")
_AFTER_SIGN = re.compile(r"(?i)(?<=@)[a-z0-9-]++(?: dot [a-z0-9-]++)* dot (?:" + _ENDS + r")(?![^\W_])")
#: What every text holds in which _AT, _DOT or words for a domain match.
_HINT = re.compile(r"(?i)[\[({<]\s*(?:at|@|arroba|dot|\.|punkt|point|punto)\s*[\])}>]|[_-]at[_-]| dot ")
_PLAIN_WORD = re.compile(r"(?i) (at|dot) ")


class Copy:
    """A rewritten copy; lo[i], hi[i] are the source characters that its character i stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lo, self.hi = list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str, list[tuple[int, int]]]]) -> None:
        """Edits (start, end, new text, for each new character the old ones it stands for), ascending."""
        text, lo, hi, at = [], [], [], 0
        for start, end, new, of in edits:
            text += [self.text[at:start], new]
            lo += self.lo[at:start] + [self.lo[a] for a, _ in of]
            hi += self.hi[at:start] + [self.hi[b - 1] for _, b in of]
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.lo, self.hi = lo + self.lo[at:], hi + self.hi[at:]


def normalise(text: str) -> Copy | None:
    """The rewritten copy, or None if no transducer has anything to rewrite."""
    odd = not text.isascii() and bool(_MAYBE_ODD.search(text)) and not _ALL_ODD.isdisjoint(text)
    if not odd and not _HINT.search(text) and not _TWO.search(text):
        return None
    return _rewritten(text, odd)


def _with_blanks(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Matches with the white space around them; each blank is looked at twice at most."""
    last = 0
    for m in pattern.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        yield a, b
        last = b


def _before(text: str, end: int, least: int) -> int:
    """Where a name that ends there starts: a run of its characters, and others that " dot " joins to it."""
    at = end
    while True:
        while at > least and text[at - 1] in _LOCAL:
            at -= 1
        # what " dot " joins on has no dots of its own but in the first run
        if at - 5 <= least or text[at - 5 : at].lower() != " dot " or text[at - 6] not in _LOCAL or "." in text[at:end]:
            return at
        end = at = at - 5


def _spelled_signs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sign) of the words " at " and " dot " in addresses whose domain is spelled out, ascending."""
    spans, last = [], 0
    for m in _PLAIN_AT.finditer(text):
        if m.start() < last:
            continue
        domain = _DOMAIN_WORDS.match(text, m.end())
        start = _before(text, m.start(), last) if domain else 0
        if domain and (start == 0 or start == last or not text[start - 1].isalnum()):
            spans.append((start, domain.end()))
            last = domain.end()
    spans += [m.span() for m in _AFTER_SIGN.finditer(text)]
    words = {w.span(): "@" if w[1].lower() == "at" else "." for a, b in spans for w in _PLAIN_WORD.finditer(text, a, b)}
    return [(a, b, words[a, b]) for a, b in sorted(words)]


def _rewritten(text: str, odd: bool) -> Copy:
    c = Copy(text)
    if odd:
        c.text = text.translate(_MAP)
        c.rewrite([(m.start(), m.end(), "", []) for m in _HIDE.finditer(c.text)])
    edits = []
    for m in _RUN.finditer(c.text):
        new, of = [], []
        for t in _TOKEN.finditer(c.text, *m.span()):
            word = t[0].casefold()
            new.append(_SPELLED.get(word) or _SIGN_WORDS.get(word) or word)
            of.append(t.span())
        if sum(map(str.isdigit, new)) >= 4:
            edits.append((m.start(), m.end(), "".join(new), of))
    c.rewrite(edits)
    for pattern, sign in ((_AT, "@"), (_DOT, ".")):
        c.rewrite([(a, b, sign, [(a, b)]) for a, b in _with_blanks(c.text, pattern)])
    c.rewrite([(a, b, sign, [(a, b)]) for a, b, sign in _spelled_signs(c.text)])
    return c


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and those with the added ones, both by kind in ascending order."""
    base = find(text)
    copy = normalise(text)
    if copy is None:
        return base, base
    every = {}
    for kind, spans in find(copy.text).items():
        kept = base[kind]
        ends = [b for _, b in kept]
        mapped = set()
        for a, b in spans:
            x, y = copy.lo[a], copy.hi[b - 1]
            k = bisect.bisect_right(ends, x)  # the first base span that ends behind x
            if k == len(kept) or kept[k][0] >= y:
                mapped.add((x, y))
        every[kind] = sorted({*kept, *mapped})
    return base, every


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, and what overlaps it, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, found in spans.items() for a, b in found):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the number of base spans by kind, base_spans, spans (kind:start:end, comma-joined) and
    redacted, the text without what was found (null stays null)."""
    counts = [f"n_{k}" for k in KINDS]
    schema = docs.select(*keep, *[F.lit(0).cast("long").alias(c) for c in counts], *[F.lit("").alias(c) for c in ("base_spans", "spans", "redacted")]).schema
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema])

    place = keep.index(text) if text in keep else len(keep)  # the text crosses to Python once

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("personal data")
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for x in batch.column(place).to_pylist():
                    base, every = all_spans(x or "")
                    rows.append((*[len(base[k]) for k in KINDS], listed(base), listed(every), x if not x or not any(every.values()) else redacted(x, every)))
                cols = [pa.array(c, pa.int64() if k < len(KINDS) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[f.name for f in schema])

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(run, schema)
