"""Personal information in free text (problem 9): located by kind, and replaced by keyed surrogates or placeholders.

Detection runs on a plain view of the text (case kept; no diacritics, hooks or full-width forms; every mark's place
is remembered), so that spelling variants match and spans map back exactly. Emails are taken first and hidden, then
labelled numbers, phones, addresses, and last names: runs of capitalised words that hold a title, an initial, a
known given or family name, or that follow a label such as ``Name:``.

Surrogates are type-consistent and keyed: digits keep the layout of their number, a house number its form, a given
name its gender, a name its capitals and hyphens; names are Latin, as what is found here. The same original always gets the same surrogate
(coreference, also of a part of a name), and within a text two originals never share one, nor does a surrogate
equal an original of that text: a collision is resolved by the next keyed draw. Placeholders are ``[KIND_n]``, n
counting the distinct originals of a text.

Scale: one pass over the texts, no shuffle; the name list goes to the workers after a check of its size.
Nulls: a null or empty text has no entities and stays as it is. Rows are handled one by one; duplicates come out
alike. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.vec import MARK, SIZE, SPACE, chunks, code_points, list_array, tables

KINDS = ("email", "phone", "id_number", "address", "name")

# fixed values: titles that go with a person's name, by the gender they tell
TITLES = {
    "m": "mr sir malam mallam alhaji mazi ogbeni otunba m monsieur baba pa",
    "f": "mrs miss ms madam hajiya alhaja oriaku arabinrin mme mlle madame mama",
    "": "dr prof professor engr barr barrister chief rev pastor imam hon sen gen col capt governor gwamna gomina govano gouverneur president",
}
# fixed values: given names by gender, beside the list that the caller gives
GIVEN = {
    "m": """abdullahi abiola abubakar adamu adebayo ade ahmed aliyu aminu ayo ayodele babatunde bala bashir bello bode chidi chinedu chukwu
        chukwuma dan daniel danjuma danladi dapo david dauda emeka emmanuel femi friday gabriel garba gbenga habib haruna hassan
        ibrahim idris ifeanyi ikenna isa ismail jacques james jean jibril john joseph kabiru kayode kelechi kenneth kola kunle
        lawal luc marc michael mohammed moses moussa muhammad musa mustapha nasir nnamdi nuhu obi obinna okechukwu olu olumide
        patrick paul peter philip pierre sadiq samuel sani segun shehu solomon sunday tanko tunde uche umar usman victor wale yahaya yakubu yusuf""",
    "f": """adaeze aisha amaka amina asabe asma'u bilkisu binta blessing bose bukola charity chiamaka chioma christiana comfort
        deborah ebere elizabeth esther fatima fatou faith folake folasade funke gift gloria grace habiba hadiza hajara halima hannatu
        hauwa ifeoma jamila jane janet joy jummai kemi khadija ladi laraba mairo marie mary maryam mercy ngozi nkechi nneka oluchi
        patience precious rabi rahila rahma ramatu ronke rose ruth sadiya safiya salamatu sarah simi talatu titilayo uju yetunde zainab zuwaira""",
}
STREETS_AFTER = "street|road|avenue|close|crescent|lane|drive|way|estate|layout|boulevard|rd|st|ave|blvd|cres"
STREETS_BEFORE = "titin|layin|hanyar|opopona|okporo uzo|ama|n'ama|rue|avenue|boulevard|chemin de"
NUMBERED = "no\\.?|n°|numero|number|house|plot|lamba|nomba|gida(?: mai lamba)?|ile|ulo|flat|block"
HOUSE = r"\d{1,4} ?[A-Za-z]?(?:/\d{1,4}[A-Za-z]?)?(?: (?:bis|ter))?"
CAP = r"[A-Z][A-Za-z']+(?:-[A-Z][A-Za-z']+)*"

AT = r"(?:[@]| [@] | ?[\[(] ?(?i:at) ?[\])] ?)"
DOT = r"(?:\.| ?[\[(] ?(?i:dot) ?[\])] ?)"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,}}(?![\w-])")
LABELLED_ID = re.compile(
    r"(?<![A-Za-z])(?i:n\.?i\.?n|b\.?v\.?n|t\.?i\.?n|v\.?i\.?n|nimc|frsc|pvc|passport|fasfo|fasfot|paspo|paspoti|passeport|licence|license|driver'?s)\.?(?: (?i:no|number|lamba|nomba)\.?)?[ :#-]{0,3}"
    r"((?:[ -]?[A-Za-z]{0,3}\d[A-Z0-9]*)+)(?![A-Za-z0-9])"
)
TOLD_ID = re.compile(
    r"(?i:shaida|shaidar kasa|idanimo|njirimara|identity|national|identite|account|acct|akanti|akaunti|akant|banki|voter|tax)[^\d\n]{0,30}?(?<![\w.+])(\d[\d -]{6,16}\d)(?![\w-])"
)
NUMBER = re.compile(r"(?<![\w.,/:+-])(?:(?i:tel) ?: ?)?(?:\+ ?)?\(?[0-9O](?:[ .()-]{0,2}\d){6,17}(?!\w)")
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:(?i:{NUMBERED}) ?)?{HOUSE},? (?:(?i:on|for|along|at|of|inside|na|ni) )?(?:{CAP} ){{1,3}}(?i:{STREETS_AFTER})(?![\w])"
    rf"|(?<![\w.,/-])(?:(?i:{NUMBERED}) ?)?{HOUSE},? (?:(?i:a|na|de la|du|de) )?(?i:{STREETS_BEFORE}) {CAP}(?: {CAP})?"
    rf"|(?<![\w])(?i:ile|ulo|gida|house) {HOUSE},? (?i:adugbo|n'ama|unguwar|quartier|quarter|ama) {CAP}"
)
AT_SIGN = re.compile(r"@|[\[(] ?[aA][tT] ?[\])]")
STREET_WORDS = [*(f" {w}" for w in STREETS_AFTER.split("|")), "titin", "layin", "hanyar", "opopona", "okporo uzo", " ama ", "n'ama", " rue ", "chemin de", "adugbo", "unguwar", "quartier", "quarter"]
WORD = rf"(?:{CAP}|[A-Z]\.?)"
RUN = re.compile(rf"(?<![\w@'-]){WORD}\.?(?:,? {WORD}\.?)+(?![\w@])")
ONE_LABEL = re.compile(r"(?i:(?<![A-Za-z])(?:suna|aha|oruko|name|nom|names|nam))\s?:\s*$")
UPPER_RUN = 6  # so many words in capitals in a row are a headline, where capitals tell nothing


@lru_cache(maxsize=1)
def plain_table() -> np.ndarray:
    """Code point to its plain form: letters without diacritics and hooks, ASCII digits and signs, spaces (but newlines)."""
    kind = tables()[0]
    out = np.arange(SIZE, dtype=np.uint32)
    hooked = {"ɓ": "b", "ɗ": "d", "ƙ": "k", "ƴ": "y", "ŋ": "n", "đ": "d", "ø": "o", "ł": "l"}
    for c in (*range(0x80, 0x600), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)):
        ch = chr(c)
        base = unicodedata.normalize("NFKD" if c > 0xFF00 else "NFD", ch)[:1]
        low = hooked.get(base.lower())
        out[c] = ord((low.upper() if base.isupper() else low) if low else base)
    for signs, sign in (("’‘ʼʻ`´", "'"), ("–—‑−", "-")):
        for ch in signs:
            out[ord(ch)] = ord(sign)
    spaces = np.flatnonzero(kind == SPACE)
    out[spaces] = 32
    out[10] = 10
    return out


@dataclass
class Names:
    """Folded given names with their gender ('' if unknown), and family names."""

    given: dict[str, str] = field(default_factory=dict)
    family: set[str] = field(default_factory=set)
    titles: dict[str, str] = field(default_factory=dict)


def fold_name(word: str) -> str:
    cp = code_points(word)
    kept = cp[tables()[0][cp] != MARK]
    return plain_table()[kept].astype(np.uint32).tobytes().decode("utf-32-le").lower().strip(".")


def name_sets(rows: list[tuple[str, str]]) -> Names:
    given = {n: g for g, names in GIVEN.items() for n in names.split()}
    family = set()
    for name, part in rows:
        if part == "family":
            family.add(fold_name(name))
        else:
            given.setdefault(fold_name(name), "")
    return Names(given, family, {t: g for g, names in TITLES.items() for t in names.split()})


def phone_digits(found: str) -> int:
    """How much of a run of digits is a phone number: its length in characters, or 0."""
    text = found[found.find(":") + 1 :].lstrip()
    lead = len(found) - len(text)
    for end in [m.end() for m in re.finditer(r"\d(?!\d)", text)][::-1]:
        piece = text[:end]
        digits = re.sub(r"\D", "", piece.replace("O", "0", 1))
        plus = piece.lstrip("(").startswith("+")
        n = len(digits)
        if (
            (plus and 8 <= n <= 15)
            or (digits[:2] == "00" and digits[2:3] != "0" and 12 <= n <= 16 and re.match(r"\(?00\d{1,3}(?!\d{9}$)|\(?00", piece) and n != 11)
            or (digits[0] == "0" and digits[1] in "789" and 10 <= n <= 11)
            or (digits[:3] == "234" and n == 13)
        ):
            return lead + end
    return 0


def _shape(s: str, a: int, b: int) -> list[tuple[int, int, str]]:
    return [(m.start() + a, m.end() + a, m.group()) for m in re.finditer(rf"{CAP}|[A-Z]\.?", s[a:b])]


def name_spans(s: str, a: int, b: int, names: Names, common: frozenset[str], labelled: bool) -> list[tuple[int, int]]:
    """Names in a run of capitalised words ``s[a:b]``."""
    words = _shape(s, a, b)
    kinds = []
    for _, _, w in words:
        low = w.lower().rstrip(".")
        parts = low.split("-")
        if low in names.titles and len(low) > 1:
            kinds.append("T")
        elif len(low) == 1:
            kinds.append("I")
        elif any(p in names.family for p in parts):
            kinds.append("F")
        elif low in names.given:
            kinds.append("G")
        else:
            kinds.append("C" if low in common else "U")
    upper = [w.isupper() and len(w) > 1 for _, _, w in words]
    out = []
    i = 0
    while i < len(words):
        j = i
        while j + 1 < len(words) and kinds[j + 1] != "C" and (kinds[i] != "C" or (labelled and i == 0)) and (s[words[j][1] : words[j + 1][0]] == " " or (kinds[j] == "T" and s[words[j][1] : words[j + 1][0]] == ". ") or (s[words[j][1] : words[j + 1][0]] == ", " and j == i and kinds[i] in "FU" and kinds[j + 1] == "G")):
            j += 1
        part = ["U" if k == "C" and labelled else k for k in kinds[i : j + 1]]
        shape = "".join(part)
        if all(upper[k] or kinds[k] == "I" for k in range(i, j + 1)) and sum(upper) >= UPPER_RUN:
            m = re.search(r"T?G+F|FG|T+G*F", shape)  # in a headline only known names in full
        elif labelled and i == 0:
            m = re.search(r"T*[GFUI]{2,}|T+[GFUI]", shape)
        else:
            m = (
                re.search(r"T+I*[GFU][GFUI]*", shape)
                or re.search(r"(?:G|U)*I+[FUG]", shape)
                or re.search(r"G[GI]*[FU]|[FU]G+|[GU]+I*F|F+[GI]*F|GG", shape)
            )
        # a common word that opens the sentence may be a given name before a known family name
        if m is None and kinds[i] == "C" and i + 1 < len(words) and kinds[i + 1] == "F" and s[words[i][1] : words[i + 1][0]] == " " and not labelled:
            out.append((words[i + 1][0], words[i + 1][1]))
            i += 2
            continue
        if m:
            out.append((words[i + m.start()][0], words[i + m.end() - 1][1]))
        i = j + 1
    return out


class Detector:
    """Finds the entities of texts. ``common``: folded words that are no names though they may open a sentence."""

    def __init__(self, names: Names, common: frozenset[str]):
        self.names, self.common = names, common

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str, str]]]:
        """(start, end, kind, plain form) of each text's entities, in order; places in the text as given."""
        texts = [t or "" for t in texts]
        cp = code_points("\n".join(texts))
        keep = np.flatnonzero(tables()[0][cp] != MARK)
        plain = plain_table()[cp[keep]]
        s = plain.astype("<u4").tobytes().decode("utf-32-le", "replace")
        raw_end = np.r_[keep[1:], len(cp)] if len(keep) else keep
        found: list[tuple[int, int, str]] = []

        def take(text: str, spans: list[tuple[int, int]], kind: str) -> str:
            if not spans:
                return text
            pieces, at = [], 0
            for a, b in spans:
                found.append((a, b, kind))
                pieces += [text[at:a], "\x00" * (b - a)]
                at = b
            return "".join([*pieces, text[at:]])

        line_at = np.r_[0, np.flatnonzero(plain == 10) + 1, len(plain) + 1]

        def lines_of(marks: np.ndarray) -> list[tuple[int, int]]:
            """The lines in which the places lie."""
            line = np.unique(np.searchsorted(line_at, marks, "right") - 1)
            return list(zip(line_at[line].tolist(), (line_at[line + 1] - 1).tolist()))

        def matches(pattern: re.Pattern, text: str, where: list[tuple[int, int]]) -> Iterator[re.Match]:
            for a, b in where:
                yield from pattern.finditer(text, a, b)

        spans = []
        for m in matches(EMAIL, s, lines_of(np.array([m.start() for m in AT_SIGN.finditer(s)], np.int64))):
            a, b = m.span()
            if s[a : a + 7].lower() == "mailto:":
                a += 7
            spans.append((a, b))
        rest = take(s, spans, "email")
        digit = np.flatnonzero((plain >= 48) & (plain <= 57))
        group = np.flatnonzero(np.r_[True, np.diff(digit) > 4]) if len(digit) else digit
        sizes = np.diff(np.r_[group, len(digit)])
        long = np.repeat(sizes, sizes) >= 6
        near = lines_of(digit[long])  # where a label and a long number can stand
        spans = [m.span() for m in matches(LABELLED_ID, rest, near) if sum(map(str.isdigit, m.group(1))) >= 6]
        rest = take(rest, spans, "id_number")
        spans = []
        for m in matches(TOLD_ID, rest, near):
            digits = sum(map(str.isdigit, m.group(1)))
            if 8 <= digits <= 12 and not phone_digits(m.group(1)):
                spans.append(m.span(1))
        rest = take(rest, spans, "id_number")
        phones, ids = [], []
        for m in matches(NUMBER, rest, near):
            n = phone_digits(m.group())
            if n:
                phones.append((m.start(), m.start() + n))
            elif re.fullmatch(r"00\d{9}", re.sub(r"[ -]", "", m.group())):
                ids.append(m.span())
        rest = take(rest, phones, "phone")
        rest = take(rest, ids, "id_number")
        low, places = rest.lower(), []
        for word in STREET_WORDS:
            at = low.find(word)
            while at >= 0:
                places.append(at)
                at = low.find(word, at + 1)
        streets = np.array(sorted(places), np.int64)
        numbered = np.isin(np.searchsorted(line_at, streets, "right"), np.searchsorted(line_at, digit, "right"))  # a house number is in the line
        rest = take(rest, [m.span() for m in matches(ADDRESS, rest, lines_of(streets[numbered]))], "address")
        spans = []
        for m in RUN.finditer(rest):
            labelled = bool(ONE_LABEL.search(rest, max(0, m.start() - 14), m.start()))
            spans += name_spans(rest, m.start(), m.end(), self.names, self.common, labelled)
        take(rest, spans, "name")
        starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        out: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]
        for a, b, kind in sorted(found):
            x, y = int(keep[a]), int(raw_end[b - 1])
            d = int(np.searchsorted(starts, x, "right")) - 1
            out[d].append((x - int(starts[d]), y - int(starts[d]), kind, s[a:b]))
        return out


# --- surrogates

MOST_DRAWS = 1000
SYLLABLES = [c + v for c in "b d f g k l m n r s t w z j y".split() for v in "aeiou"]


class Surrogates:
    """Keyed, type-consistent replacements for the entities of one text."""

    def __init__(self, key: bytes, names: Names, originals: set[str]):
        self.key, self.names, self.originals = key, names, originals
        self.given_to: dict[tuple[str, str], str] = {}
        self.used: set[str] = set()

    def _draw(self, kind: str, entity: str, attempt: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{entity}|{attempt}".encode(), key=self.key, digest_size=16).digest(), "big")

    def _unique(self, kind: str, entity: str, make, wider) -> str:
        """``make`` of the first draw that is new in the text; ``wider`` (draw, step) once ``make`` seems used up, with more to draw from at each step."""
        if (kind, entity) not in self.given_to:
            attempt = 0
            while True:
                n = self._draw(kind, entity, attempt)
                out = make(n) if attempt <= MOST_DRAWS else wider(n, attempt - MOST_DRAWS)
                low = out.lower()
                if low not in self.used and low not in self.originals:
                    break
                attempt += 1
            self.used.add(low)
            self.given_to[kind, entity] = out
        return self.given_to[kind, entity]

    def _digits(self, text: str, kind: str, keep: int = 0) -> str:
        """The same layout with other digits and capitals; ``keep``: leading characters that tell the number's type."""
        entity = re.sub(r"[^0-9a-z]", "", text.lower())

        def make(n: int) -> str:
            out = []
            for i, c in enumerate(text):
                if i < keep or not (c.isdigit() or (kind == "id_number" and "A" <= c <= "Z")):
                    out.append(c)
                elif c.isdigit():
                    n, r = divmod(n, 10)
                    out.append(str(r))
                else:
                    n, r = divmod(n, 26)
                    out.append(chr(65 + r))
            return "".join(out)

        return self._unique(kind, entity, make, lambda n, step: make(n) + str(step))

    def _word(self, kind: str, low: str, told: str = "") -> str:
        """Another word of its kind. ``told``: the gender that a title tells, for given names whose own isn't known; the first text that names it decides."""
        def syllables(n: int, count: int) -> str:
            return "".join(SYLLABLES[(n >> (8 * i)) % len(SYLLABLES)] for i in range(min(count, 16)))

        gender = self.names.given.get(low) or told if kind == "given" else ""
        if gender:
            pool = GIVEN[gender].split()
            return self._unique(kind, low, lambda n: pool[n % len(pool)], lambda n, step: syllables(n, 3 + step // 100))
        return self._unique(kind, low, lambda n: syllables(n, 3 + n % 2), lambda n, step: syllables(n, 5 + step // 100))

    def _initial(self, low: str) -> str:
        """A letter of its own for each initial of the text; another initial of the text only if no other letter is left."""
        if ("initial", low) not in self.given_to:
            free = [c for c in ascii_lowercase if c not in self.used]
            free = [c for c in free if c not in self.originals] or free
            new = free[self._draw("initial", low, 0) % len(free)]
            self.used.add(new)
            self.given_to["initial", low] = new.upper()
        return self.given_to["initial", low]

    def _house(self, numbers: list[str], street: str) -> list[str]:
        """Other house numbers, two in one street never the same."""

        def make(n: int, more: int = 0) -> str:
            out = []
            for k, x in enumerate(numbers):
                size = 10 ** (len(x) + more * (k == 0))
                out.append(str(n % size).zfill(len(x)))
                n //= size
            return " ".join([*out, "|", street])

        return self._unique("house", " ".join([*numbers, street]), make, lambda n, step: make(n, 1 + step // 100)).split(" ")[: len(numbers)]

    def name(self, text: str) -> str:
        told = next((g for w in re.findall(r"[A-Za-z']+", text.lower()) if (g := self.names.titles.get(w) if len(w) > 1 else None)), "")

        def one(m: re.Match) -> str:
            w = m.group()
            low = w.lower()
            if low in self.names.titles and len(w) > 1:
                return w
            if len(w) == 1:
                return w if w == "'" else self._initial(low)
            new = self._word("given" if low in self.names.given else "family", low, told)
            return new.upper() if w.isupper() else new.capitalize()

        return re.sub(r"[A-Za-z']+", one, text)

    def of(self, kind: str, text: str) -> str:
        if kind == "name":
            return self.name(text)
        if kind == "email":
            entity = re.sub(r"\s|[\[\]()]", "", text.lower()).replace("at", "@")
            local = self._word("family", entity)
            return f"{local}{self._draw('email', entity, 0) % 90 + 10}@mail.invalid"
        if kind == "phone":
            lead = re.match(r"(?i)(?:tel ?: ?)?\(?(?:\+ ?\d{1,3}|00\d{1,3}|234|[0O] ?\d)?", text).end()
            return self._digits(text, kind, lead)
        if kind == "id_number":
            lead = re.match(r"(?:[A-Za-z.']{2,}[ .:#-]*)?", text).end()
            return self._digits(text, kind, lead)
        street = re.compile(CAP)
        fixed = {*STREETS_AFTER.split("|"), "no", "titin", "layin", "hanyar", "opopona", "rue", "plot", "house", "block", "flat"}
        named = street.sub(lambda m: m.group() if m.group().lower() in fixed else self._word("place", m.group().lower()).capitalize(), text)
        prefix = re.compile(rf"\b(?i:{NUMBERED})\b|[^\w']")
        place = " ".join(re.sub(r"\d+", " ", prefix.sub(" ", text.lower())).split())
        house = iter(self._house(re.findall(r"\d+", text), place))
        return re.sub(r"\d+", lambda _: next(house), named)


def replacements(entities: list[tuple[int, int, str, str]], mode: str, key: bytes, names: Names) -> list[str]:
    """What stands for each of a text's entities: surrogates (``mode`` surrogate) or typed placeholders (placeholder)."""
    if mode == "surrogate":
        makers = Surrogates(key, names, {p.lower() for _, _, _, p in entities} | {w.lower() for _, _, k, p in entities if k == "name" for w in re.findall(r"[A-Za-z']+", p)})
        return [makers.of(kind, plain) for _, _, kind, plain in entities]
    numbers: dict[tuple[str, str], int] = {}
    for _, _, kind, plain in entities:
        numbers.setdefault((kind, re.sub(r"\W", "", plain.lower())), 1 + sum(k == kind for k, _ in numbers))
    return [f"[{kind.upper()}_{numbers[kind, re.sub(r'\W', '', plain.lower())]}]" for _, _, kind, plain in entities]


def replaced(text: str, entities: list[tuple[int, int, str, str]], mode: str, key: bytes, names: Names) -> str:
    """The text with ``replacements`` in the entities' places."""
    out, at = [], 0
    for (a, b, _, _), new in zip(entities, replacements(entities, mode, key, names)):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


# --- over DataFrames

FOUND = "doc_id {id}, starts array<int>, ends array<int>, lines array<int>, kinds array<string>, surrogates array<string>"


def _located(batches: Iterator[pa.RecordBatch], detector: Detector, key: bytes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for start, stop in chunks(texts):
            found = detector.find(texts[start:stop])
            keep = [i for i, e in enumerate(found) if e]
            counts = np.array([len(found[i]) for i in keep], np.int64)
            flat = [(a, z, texts[start + i].count("\n", 0, a), k, new) for i in keep for (a, z, k, _), new in zip(found[i], replacements(found[i], "surrogate", key, detector.names))]
            columns = [pa.array([x[j] for x in flat], t) for j, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.string()))]
            ids = b.column("doc_id").slice(start, stop - start).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(list_array(c, counts) for c in columns)], ["doc_id", "starts", "ends", "lines", "kinds", "surrogates"])


def _rewritten(batches: Iterator[pa.RecordBatch], detector: Detector, mode: str, key: bytes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for start, stop in chunks(texts):
            part = texts[start:stop]
            found = detector.find(part)
            new = [t if not e else replaced(t, e, mode, key, detector.names) for t, e in zip(part, found)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, stop - start), pa.array(new, pa.string()), pa.array([len(e) for e in found], pa.int32())], ["doc_id", "text", "entities"])


def detector_for(name_list: DataFrame, common_words: DataFrame | None, most_names: int = 2_000_000) -> Detector:
    """A detector from a list (name, name_part) and words (word) that are no names; more than ``most_names`` of either are an error."""
    rows = name_list.select("name", "name_part").where("name is not null").distinct().limit(most_names + 1).collect()
    if len(rows) > most_names:
        raise ValueError(f"more than {most_names} names")
    words = common_words.select("word").where("word is not null").distinct().limit(most_names + 1).collect() if common_words is not None else []
    if len(words) > most_names:
        raise ValueError(f"more than {most_names} common words")
    return Detector(name_sets([tuple(r) for r in rows]), frozenset(fold_name(r[0]) for r in words))


def _slim(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def located(documents: DataFrame, detector: Detector, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, line_no, kind, surrogate) of every entity that gets a surrogate; places count characters, lines newlines."""
    sent = documents.sparkSession.sparkContext.broadcast(detector)
    slim = _slim(documents, id_col, text_col)
    lists = slim.mapInArrow(lambda it: _located(it, sent.value, key), FOUND.format(id=slim.schema[0].dataType.simpleString()))
    each = lists.select("doc_id", F.explode(F.arrays_zip("starts", "ends", "lines", "kinds", "surrogates")).alias("e"))
    return each.select("doc_id", F.col("e.starts").alias("start"), F.col("e.ends").alias("end"), F.col("e.lines").alias("line_no"), F.col("e.kinds").alias("kind"), F.col("e.surrogates").alias("surrogate"))


def rewritten(documents: DataFrame, detector: Detector, mode: str, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, entities): each row's text with its entities replaced; see ``replaced`` for the modes."""
    sent = documents.sparkSession.sparkContext.broadcast(detector)
    slim = _slim(documents, id_col, text_col)
    return slim.mapInArrow(lambda it: _rewritten(it, sent.value, mode, key), f"doc_id {slim.schema[0].dataType.simpleString()}, text string, entities int")
