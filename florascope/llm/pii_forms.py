"""Written forms of personal items, without the sentences around them: what labels the training sample and what checks a decoded span.

A form alone decides for emails and addresses. A number is labelled as a phone or identity number only where a word of that sort
stands right before it; a name only where its words are on a list of names. Nothing here knows a sentence of any corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import regex

_S = "[ \u00a0]"
_AT = rf"(?:@|{_S}?[\[({{]{_S}?(?i:at){_S}?[\])}}]{_S}?)"
_DOT = rf"(?:\.|{_S}?[\[({{]{_S}?(?i:dot){_S}?[\])}}]{_S}?)"
EMAIL = rf"(?<![\w.+\-])[\p{{L}}\p{{N}}_+\-]+(?:{_DOT}[\p{{L}}\p{{N}}_+\-]+)*{_AT}[\p{{L}}\p{{N}}\-]+(?:{_DOT}[\p{{L}}\p{{N}}\-]+)+"

# A run of digit groups, with an optional international prefix and an area code in brackets.
_SEP = rf"(?:{_S}|[.\-/])"
PHONE = rf"(?<![\w+\-/.])(?:\+\d{{1,3}}{_SEP}?)?(?:\(\d{{1,4}}\){_SEP}?)?\d{{1,12}}(?:{_SEP}\d{{2,9}}){{0,5}}(?![\w])(?!-\w)"
#: Letters and digits in groups, at least five of them digits.
ID = r"(?<![\w\-])(?:[A-Z] ?|[A-Z]{1,4}-?)?\d{1,12}(?:[ \-]\d{2,9}){0,4}(?:-?[A-Z])?(?![\w])(?!-\w)"

_W = r"\p{Lu}[\p{L}\p{M}'’]+(?:-\p{Lu}\p{L}+)?"
_TOWN = rf"{_W}(?:[ \-]{_W}){{0,2}}"
_KIND = r"(?i:lane|street|st|road|rd|way|lam|market|avenue|ave|square|row|close|drive|court|alley|terrace|crescent|place|boulevard|blvd)"
_HOUSE = rf"(?:(?i:house|flat|apt|unit|suite|no){_S}(?i:no\.?{_S}?)?\w{{1,5}},{_S})"
_POST = rf"(?:{_S}\d{{4,6}}(?!\d))"
ADDRESS = (
    rf"(?<![\w\-/])(?:(?:{_HOUSE}?\d{{1,4}}(?:/\d+|\p{{L}})?{_S}|{_HOUSE})(?:{_W}{_S}){{1,3}}?{_KIND}\.?,{_S}{_TOWN}{_POST}?"
    rf"|\d{{1,4}}(?:bis|ter)?,?{_S}(?i:rue|avenue|chemin|place|boulevard|impasse){_S}(?:(?:de|du|des|la|le){_S})*(?:{_W})(?:{_S}{_W}){{0,2}},{_S}(?:\d{{4,5}}{_S})?{_TOWN}"
    rf"|(?i:calle|avenida|plaza|camino|via|viale){_S}(?:(?:de|del|la|los){_S})*(?:{_W})(?:{_S}{_W}){{0,2}},?{_S}\d{{1,4}},{_S}(?:\d{{4,5}}{_S})?{_TOWN}"
    rf"|(?:{_W}[ \-]){{0,2}}\p{{Lu}}\p{{L}}*(?i:weg|straße|strasse|str\.|gasse|platz|allee){_S}\d{{1,4}}\p{{L}}?,{_S}(?:\d{{4,5}}{_S})?{_TOWN})(?![\w])"
)
FORMS = {k: regex.compile(p) for k, p in (("email", EMAIL), ("phone", PHONE), ("id", ID), ("address", ADDRESS))}

# Words that say what the number after them is; titles and dates that aren't part of a name. General vocabulary of the four languages, fixed values.
PHONE_WORDS = r"(?i:phone|telephone|tel|mobile|cell|call|ring|dial|fax|whatsapp|sms|teléfono|telefono|móvil|llamar|llame|tél|téléphone|portable|appeler|telefon|handy|mobil|anrufen|at)"
ID_WORDS = (
    r"(?i:citizen id|cid|id|id card|identity card|identity number|id number|national id|passport|staff card|carte d['’]identité|cni|passeport|"
    r"ausweis(?:-?nr)?|personalausweis|reisepass|documento de identidad|dni|nie|cédula|pasaporte|carnet)"
)
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Sir Mme Mlle Madame Monsieur Herr Herrn Frau Sr Sra Srta Señor Señora Don Doña Dame Lord Det Leg".split())
_SIGN = r"(?:[.:=#°]|no\.?|n°|nr\.?|number|card|/|\s){0,8}"
_PHONE_BEFORE = regex.compile(rf"(?<!\p{{L}}){PHONE_WORDS}{_SIGN}$")
_ID_BEFORE = regex.compile(rf"(?<!\p{{L}}){ID_WORDS}{_SIGN}$")
_TOKEN = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._\-])(?:\p{{Lu}}\.|{_W})(?![\p{{L}}\p{{N}}@_])")


def digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


@dataclass
class Names:
    """Given and family names, in lower case."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)

    def has(self, word: str) -> bool:
        return word in self.given or word in self.family


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Capitalised words and initials, titles left out."""
    return [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text) if m[0] not in TITLES]


def _next(text: str, a: int, b: int) -> str:
    """What joins two tokens: ' ', ',' or nothing that could."""
    gap = text[a:b]
    return " " if gap in (" ", "\u00a0") else "," if gap in (", ", ",\u00a0") else ""


def expand(texts: Iterable[str], names: Names) -> Names:
    """Adds words that stand beside listed names of two sorts or more, and mostly there: the list is far from complete."""
    beside: dict[tuple[str, str], set[str]] = defaultdict(set)
    near: dict[str, int] = defaultdict(int)
    count: dict[str, int] = defaultdict(int)
    for text in texts:
        run = tokens(text)
        for i, (_, b, w) in enumerate(run):
            count[w] += 1
            if len(w) < 3:
                continue
            after = [x for x in run[i + 1 : i + 3] if _next(text, run[i][1], run[i + 1][0]) == " "]
            if len(after) == 2 and (after[0][2][1:] != "." or _next(text, after[0][1], after[1][0]) != " "):
                after = after[:1]
            if not after:
                continue
            other = after[-1][2]
            if w in names.given and other not in names.family and len(other) > 2:
                beside["family", other].add(w)
                near[other] += 1
            if other in names.family and w not in names.given:
                beside["given", w].add(other)
                near[w] += 1
    out = Names(set(names.given), set(names.family))
    for (sort, w), others in beside.items():
        if len(others) > 1 and near[w] >= 0.3 * count[w]:
            getattr(out, sort).add(w)
    return out


def name_spans(text: str, names: Names) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of names whose words are listed, and spans of half-listed ones, which are neither names nor anything else for sure."""
    run, sure, open_, i = tokens(text), [], [], 0
    joined = [_next(text, run[j][1], run[j + 1][0]) if j + 1 < len(run) else "" for j in range(len(run))]
    known = [names.has(w) for _, _, w in run]
    first = [len(w) == 2 and w[1] == "." for _, _, w in run]
    while i < len(run):
        if not (known[i] or first[i]):
            i += 1
            continue
        j = i
        while j + 1 < len(run) and joined[j] == " " and (known[j + 1] or first[j + 1]) and j - i < 3:
            j += 1
        # Family name first, with a comma.
        if j == i and run[i][2] in names.family and joined[i] == "," and (run[i + 1][2] in names.given or first[i + 1]):
            j = i + 1
        if j > i and any(known[i : j + 1]):
            while first[j] and not (j == i + 1 and known[i]):
                j -= 1
            sure.append((run[i][0], run[j][1]))
        elif known[i] and ((i and joined[i - 1] == " ") or joined[i] == " "):
            open_.append((run[i - 1][0] if i and joined[i - 1] == " " else run[i][0], run[i + 1][1] if joined[i] == " " else run[i][1]))
        i = j + 1
    return sure, open_


def label_spans(text: str, names: Names) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(start, end, kind) of what is an item by its form and the words right before it, without overlaps, and the doubtful stretches."""
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return not any(a < y and x < b for x, y, _ in taken)

    for kind in ("email", "address"):
        taken += [(*m.span(), kind) for m in FORMS[kind].finditer(text) if free(*m.span())]
    named, doubt = name_spans(text, names)
    taken += [(a, b, "name") for a, b in named if free(a, b)]
    ends = {b for a, b, k in taken if k == "name"}
    for kind, before in (("id", _ID_BEFORE), ("phone", _PHONE_BEFORE)):
        for m in FORMS[kind].finditer(text):
            a, b = m.span()
            n = digits(m[0])
            if not free(a, b) or n < 6:
                continue
            # A number in brackets right after a name is the person's.
            own = kind == "id" and a > 2 and text[a - 1] == "(" and a - 2 in ends and text[b : b + 1] == ")"
            if own or before.search(text, max(0, a - 32), a) or (kind == "phone" and m[0][0] == "+"):
                taken.append((a, b, kind))
    return sorted(taken), [x for x in doubt if free(*x)]


def _word_borders(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == "." and b - a > 1 and text[b - 2].isupper() and (b - a == 2 or not text[b - 3].isalnum())):
        b -= 1
    while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    return a, b


def check(text: str, a: int, b: int, kind: str, names: Names | None = None) -> tuple[int, int] | None:
    """The decoded span brought to whole words and, where a written form of its kind lies over most of it, to that form's borders.

    A name span that holds a name of listed words is brought to that one. None if nothing is left that can be of the kind: an email without its sign, a number of fewer than five digits, a name of one word.
    """
    if kind == "name":
        a, b = _word_borders(text, a, b)
        parts = list(_TOKEN.finditer(text, max(0, a - 1), b + 1))
        parts = [m for m in parts if m.start() < b and m.end() > a]
        # What stands before a title, and the title, isn't part of the name.
        parts = parts[max((k + 1 for k, m in enumerate(parts) if m[0] in TITLES), default=0) :]
        if len(parts) < 2 or not any(len(m[0]) > 2 for m in parts):
            return None
        a, b = parts[0].start(), parts[-1].end()
        if names is not None and (listed := name_spans(text[a:b], names)[0]):
            a, b = a + listed[0][0], a + listed[0][1]
        return a, b
    best, most = None, 0
    for m in FORMS[kind].finditer(text, max(0, a - 40), min(len(text), b + 40)):
        over = min(b, m.end()) - max(a, m.start())
        if over > most:
            best, most = m.span(), over
    if best is None or 2 * most < b - a or 2 * most < best[1] - best[0]:
        return None
    if kind in ("phone", "id") and digits(text[best[0] : best[1]]) < 5:
        return None
    return best


def confirmed(text: str, a: int, b: int, kind: str, names: Names) -> bool:
    """Whether label_spans would give exactly this span: by its form, what stands right before it, or the list of names.

    Only the span and what is beside it are looked at.
    """
    if kind in ("email", "address"):
        return FORMS[kind].fullmatch(text, a, b) is not None
    if kind == "name":
        lo = max(0, a - 64)
        return (a - lo, b - lo) in name_spans(text[lo : b + 16], names)[0]
    if digits(text[a:b]) < 6:
        return False
    before = text[max(0, a - 32) : a]
    if kind == "phone":
        return text[a] == "+" or _PHONE_BEFORE.search(before) is not None
    if _ID_BEFORE.search(before):
        return True
    if text[a - 1 : a] != "(" or text[b : b + 1] != ")":
        return False
    lo = max(0, a - 64)
    return any(y == a - 2 - lo for _, y in name_spans(text[lo : a - 1], names)[0])
