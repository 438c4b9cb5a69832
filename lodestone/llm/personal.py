"""Problem 7: personal information in free text, by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs and their spellings, cues of personal identifiers, kinds of streets,
digits, and the first and last names of a lexicon.  From an anchor a local parser reads to both sides, as far as the item
goes, decides where it begins and ends, and accepts or rejects it: telephone numbers and addresses with the house number
behind the street begin at a digit.  The lexicon is learned from the corpus: fields that list people name them in several forms, and
only people's names occur with initials and turned around.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import parts_of
from lodestone.tables import cut, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Entries of a lexicon that is given to every worker whole; of a larger one each text gets the names that it may have, with the same result.
MOST_NAMES = 200_000
# Words that show what stands beside them.
#: Beside them, an at-sign may stand between blanks.
AT_SIGNS = ("@", "(at)", "[at]", " AT ", " at ")
ID_CUES = (
    "SSN", "social security number", "social security no", "NI number", "national insurance number", "national insurance no", "national ID",
    "national identity number", "passport number", "passport no", "passport", "tax ID", "tax identification number", "driver's license number",
    "driver's license no", "driver's license", "driving licence number", "driving licence no", "driving licence", "identity card number",
    "identity card no", "identity card", "ID card number", "ID card no", "identity number", "account number", "account no",
)
STREET_KINDS = (
    "Street", "St", "Road", "Rd", "Avenue", "Ave", "Drive", "Dr", "Lane", "Ln", "Court", "Ct", "Way", "Place", "Pl", "Boulevard", "Blvd",
    "Hollow", "Rise", "Terrace", "Square", "Parkway", "Close", "Crescent", "Row", "Walk", "Hill", "Circle", "Trail", "Gardens", "Grove", "Mews",
)
STREET_ENDS = ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "grund", "ring", "damm", "ufer", "wall", "markt", "hof")
ORGANISATION_WORDS = (
    "Analytics", "Consulting", "Laboratories", "Institute", "Foods", "Pharma", "Trust", "Logistics", "Packaging", "Works",
    "Group", "Advisory", "Partners", "Holdings", "Inc", "Ltd", "LLC", "GmbH", "Corp", "Corporation", "Company", "Foundation", "University",
    "Hospital", "Bank", "Docket", "Documents",
)

GAP = r"(?:[ \t]+|[ \t]*\r?\n[>| \t]*)"  # white space or a line end, with the marks of a quoted line
IN_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[ \t]?(?:\r?\n[>| \t]*)?((?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?![A-Za-z0-9\-@])")
SPELLED = re.compile(r"[ \t]?((?:[A-Za-z0-9][A-Za-z0-9\-]*(?: ?\(dot\) ?| ?\[dot\] ?| dot ))+[A-Za-z]{2,})(?![A-Za-z0-9\-@])", re.I)
SEP = rf"(?:[ .\-]|{GAP})"
PHONE = re.compile(
    rf"(?<![\w.,/+\-#])(?:\+\d{{1,3}}{SEP}?(?:\(\d{{1,4}}\){SEP}?)?\d{{1,5}}(?:{SEP}\d{{2,5}}){{1,5}}|(?:1{SEP})?(?:\(\d{{3}}\){SEP}?|\d{{3}}{SEP})\d{{3}}{SEP}\d{{4}}|0\d{{1,4}}{SEP}\d{{3,5}}{SEP}\d{{3,5}}|0\d{{2,4}}[/ ]\d{{5,8}})"
    rf"(?:(?:,?[ \t]*\n?[ \t]*)(?:ext|extension|x)\.?[ \t]*\d{{1,5}}\b)?(?![\w/#]|[.\-,]\d)"
)
NUMBER_CONTEXT = re.compile(r"\b(?:lot|order|docket|invoice|bates|ref|reference|item|part|serial|batch|no\.? of|usd|eur)[\s:#>|]*\Z", re.I)
ID_CUE = re.compile("|".join(re.escape(c).replace(r"\ ", GAP) for c in ID_CUES), re.I)
ID_VALUE = re.compile(
    rf"(?:{GAP}|\s*=== Page \d+ ===\s*|[:#.]|\bis\b){{0,5}}((?:[A-Z]{{1,3}}(?:{GAP}|-)?)?\d(?:\d|[A-Z](?![A-Za-z])|[.\-](?=\d)|{GAP}(?=\d|[A-Z]\b)){{4,24}})"
)
ACCOUNT = re.compile(r"[ \t]*[:#]?[ \t]*([A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,40})")
UNIT = rf"(?:,?{GAP}(?:Apt|Apartment|Suite|Ste|Unit|Floor|Room|No)\.?{GAP}[\w\-]+)?"
TAIL = rf"(?:,{GAP}[A-Z][\w'’\-]+(?:{GAP}[A-Z][a-z]+){{0,2}}(?:,{GAP}[A-Z]{{2}})?(?:{GAP}\d{{4,6}}(?:-\d{{4}})?)?)?"
HOUSE = re.compile(rf"(?<![\w.,/\-$€£])\d{{1,5}}(?:[a-zA-Z]|-\d{{1,4}})?{GAP}(?:(?:[NSEW]|North|South|East|West|St)\.?{GAP})?(?:[A-ZÄÖÜ][\w'’\-]*{GAP}){{0,4}}\Z")
AFTER_KIND = re.compile(rf"\.?(?![\w]){UNIT}{TAIL}")
TURNED = (
    re.compile(rf"(?<![\w\-])(?:(?:Am|An{GAP}der|An{GAP}den|Auf{GAP}dem|Im|In{GAP}der|Zum|Zur|Unter{GAP}den|Alte|Alter|Neue|Neuer){GAP})?[A-ZÄÖÜ][\w.\-]*{GAP}\Z"),
    re.compile(rf"\d{{1,4}}[a-z]?,{GAP}\d{{4,5}}{GAP}[A-ZÄÖÜ][\w\-]+"),
)
TURNED_PLAIN = re.compile(rf"(?<![\w\-])[A-ZÄÖÜ][\w.\-]*(?:{'|'.join(re.escape(e) for e in STREET_ENDS)}){GAP}\Z"), re.compile(r"\d{1,4}[a-z]?(?![\w.\-/])")
NAME_GAP = re.compile(rf"{GAP}")
INITIALS = rf"(?:[A-Z]\.(?:{GAP}|-)?){{1,3}}"
BEFORE_INITIALS = re.compile(rf"(?<![\w.])(?:[A-Z]\.(?:{GAP}|-)?){{1,3}}\Z")
MIDDLE = re.compile(rf"{GAP}(?:[A-Z]\.?{GAP}){{0,2}}")
TURNED_INITIALS = re.compile(rf",{GAP}(?:[A-Z]\.(?:[ \-]?(?=[A-Z]\.))?){{1,3}}")
MIDDLE_AFTER = re.compile(rf"{GAP}[A-Z]\.(?![\w.])")
COMMA = re.compile(rf",{GAP}")
BROKEN = re.compile(r"(?<![^\W\d_])([^\W\d_]+)[-¬]\r?\n[>| \t]*([^\W\d_]+)")
NEXT_WORD = re.compile(r"[ \t]+(?:&[ \t]+)?([A-Z]\w*)")
NAME_BEGIN = re.compile(r"(?<![\w\-'’@])(?=[^\W\d_])")
NAME_RUN = re.compile(r"[\w'’\-\u0300-\u036f]+")  # upper-casing takes some letters apart into a letter and a mark


# --- the lexicon ----------------------------------------------------------------------------------------------------
WORD = r"[\p{Lu}][\p{L}'’\-]+"


def people_segments(*sources: tuple[DataFrame, Column]) -> DataFrame:
    """segment: the single names of fields that list people, without addresses and what stands in brackets."""
    out = None
    for df, c in sources:
        part = df.select(F.explode(F.split(c, r"\s*(?:;|/|&|\band\b|\n)\s*")).alias("segment"))
        out = part if out is None else out.unionByName(part)
    bare = F.trim(F.regexp_replace("segment", r"<[^>]*>|\([^)]*\)", ""))
    return out.select(bare.alias("segment")).where(F.length("segment") >= 3)


def learn_names(segments: DataFrame) -> DataFrame:
    """name (in lower case), role (first or last) and n, its frequency.

    A last name is a word that stands beside initials (I. Last or Last, I.) or before a comma and one other word at least
    twice; a first name stands beside such a last name (First Last, First M. Last or Last, First).
    """
    s = F.col("segment")
    initial = F.coalesce(*(F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (rf"^(?:\p{{Lu}}\. ?){{1,3}}({WORD})$", rf"^({WORD}), (?:\p{{Lu}}\. ?){{1,3}}$")))
    turned = F.nullif(F.regexp_extract(s, rf"^({WORD}), {WORD}(?: \p{{Lu}}\.)?$", 1), F.lit(""))
    cand = segments.select(F.coalesce(initial, turned).alias("w")).where("w is not null").groupBy(F.lower("w").alias("name")).agg(F.count("*").alias("n")).where("n >= 2")
    straight = rf"^({WORD}) (?:\p{{Lu}}\. ?){{0,2}}({WORD})$"
    back = rf"^({WORD}), ({WORD})(?: \p{{Lu}}\.)?$"
    pairs = segments.select(
        F.lower(F.when(s.rlike(back), F.regexp_extract(s, back, 2)).otherwise(F.regexp_extract(s, straight, 1))).alias("first"),
        F.lower(F.when(s.rlike(back), F.regexp_extract(s, back, 1)).otherwise(F.regexp_extract(s, straight, 2))).alias("name"),
    ).where("first <> ''")
    first = pairs.join(cand.select("name"), "name", "left_semi").groupBy(F.col("first").alias("name")).agg(F.count("*").alias("n")).where("n >= 2")
    return cand.select("name", F.lit("last").alias("role"), "n").unionByName(first.select("name", F.lit("first").alias("role"), "n"))


# --- the search -----------------------------------------------------------------------------------------------------
class Finder:
    """Finds the items of a text; built once per Python worker from the names of the lexicon."""

    def __init__(self, firsts: frozenset[str], lasts: frozenset[str]):
        import ahocorasick

        self.firsts, self.lasts = firsts, lasts
        anchors: dict[str, list[str]] = {}  # a name may be a cue as well
        for at in AT_SIGNS:
            anchors.setdefault(at, []).append("at")
        for word in {c.split(" ")[0] for c in ID_CUES}:
            for form in {word, word.lower(), word.upper(), word.capitalize()}:
                anchors.setdefault(form, []).append("id")
        for kind in STREET_KINDS:
            for before in " \n>":
                anchors.setdefault(before + kind, []).append("street")
        for digit in "0123456789":
            anchors.setdefault(digit, []).append("digit")
        for form in {f for name in firsts | lasts for f in (title(name), name.upper())}:
            anchors.setdefault(form, []).append("name")
        anchors.setdefault("IBAN", []).append("account")
        self.automaton = ahocorasick.Automaton()
        for form, kinds in anchors.items():
            self.automaton.add_word(form, (kinds, form))
        self.automaton.make_automaton()

    def find(self, t: str) -> list[tuple[int, int, str]]:
        """Start, end and kind of the items, none within another, in their order."""
        found: list[tuple[int, int, str]] = []
        names: list[tuple[int, int, str]] = []
        rung = 0  # where the last telephone number ends
        for last, (kinds, form) in self.automaton.iter(t):
            a, b = last - len(form) + 1, last + 1
            for what in kinds:
                if what == "digit":
                    if a and t[a - 1] in "0123456789":
                        continue
                    found += turned(t, a)
                    if a >= rung and (m := phone(t, a, rung)):
                        rung = m.end()
                        if 7 <= sum(c.isdigit() for c in m.group()) <= 20 and not NUMBER_CONTEXT.search(t, max(0, m.start() - 24), m.start()):
                            found.append((m.start(), rung, "phone"))
                elif what == "name":
                    if not (a and (t[a - 1].isalnum() or t[a - 1] in "_-'’@")) and not (b < len(t) and (t[b].isalnum() or t[b] in "_@")):
                        names.append((a, b, form))
                elif what == "at":
                    found += email(t, a, b, form)
                elif what == "id":
                    found += identifier(t, a, b)
                elif what == "account":
                    found += account(t, b)
                else:
                    found += street(t, a, b)
        for m in BROKEN.finditer(t):
            whole = (m.group(1) + m.group(2)).lower()
            if (whole in self.firsts or whole in self.lasts) and m.group()[0].isupper():
                names.append((m.start(), m.end(), m.group(1) + m.group(2)))
        taken: list[tuple[int, int, str]] = []
        order = {k: i for i, k in enumerate(("email", "street_address", "id_number", "phone"))}
        for x in sorted(set(found), key=lambda x: (order[x[2]], x[0], -x[1])):
            if all(x[1] <= a or x[0] >= b for a, b, _ in taken):
                taken.append(x)
        taken += self.people(t, names, taken)
        return sorted(taken)

    def people(self, t: str, names: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The names, put together from their words."""
        words = []
        for a, b, form in sorted(names, key=lambda x: (x[0], -x[1])):
            if words and a < words[-1][1] or any(x < b and a < y for x, y, _ in taken):
                continue
            words.append((a, b, form.lower()))
        out, i = [], 0
        while i < len(words):
            a, b, w = words[i]
            i += 1
            if w in self.firsts:
                # First, First M. Last, First Last
                m = i < len(words) and MIDDLE.fullmatch(t, b, words[i][0])
                if m and words[i][2] in self.lasts:
                    b = words[i][1]
                    i += 1
                elif m and words[i][2] in self.firsts and i + 1 < len(words) and words[i + 1][2] in self.lasts and MIDDLE.fullmatch(t, words[i][1], words[i + 1][0]):
                    b = words[i + 1][1]
                    i += 2
            if w in self.lasts and b == words[i - 1][1] and a == words[i - 1][0]:
                m = BEFORE_INITIALS.search(t, max(0, a - 16), a)
                if m:
                    a = m.start()
                elif i < len(words) and words[i][2] in self.firsts and COMMA.fullmatch(t, b, words[i][0]) and not (i + 1 < len(words) and words[i + 1][2] in self.lasts and MIDDLE.fullmatch(t, words[i][1], words[i + 1][0])):
                    b = words[i][1]
                    i += 1
                    if m := MIDDLE_AFTER.match(t, b):
                        b = m.end()
                elif m := TURNED_INITIALS.match(t, b):
                    b = m.end()
            m = NEXT_WORD.match(t, b)
            if m and m.group(1) in ORGANISATION_WORDS:
                continue
            out.append((a, b, "person_name"))
        return out


def title(name: str) -> str:
    return "-".join(p[:1].upper() + p[1:] for p in name.split("-"))


def email(t: str, a: int, b: int, form: str) -> list[tuple[int, int, str]]:
    """The address around an at-sign."""
    if form == "@" and a and t[a - 1] == " " and b < len(t) and t[b] == " ":
        a -= 1
    i = a
    while i and t[i - 1] in IN_LOCAL:
        i -= 1
    while i < a and not t[i].isalnum():
        i += 1
    if i == a or not (t[a - 1].isalnum() or t[a - 1] == "_"):
        return []
    d = None if form == " at " else DOMAIN.match(t, b)
    # "at" alone is a common word: it stands for the sign only where the dots are spelled out too and the name isn't a plain word
    if not d and form != "@" and (form != " at " or not t[i:a].isalpha()):
        d = SPELLED.match(t, b)
    return [(i, d.end(1), "email")] if d else []


def phone(t: str, a: int, least: int) -> re.Match | None:
    """The telephone number whose first digit stands at a, signs before it from ``least`` on."""
    i = a
    while i > least and t[i - 1] in "+(":
        i -= 1
    return next((m for s in range(i, a + 1) if (m := PHONE.match(t, s))), None)


def words_back(t: str, a: int, n: int) -> int:
    """Where the last n words before a begin, marks of quoted lines counted as such."""
    for _ in range(n):
        while a and t[a - 1].isspace():
            a -= 1
        while a and not t[a - 1].isspace():
            a -= 1
    return a


def turned(t: str, a: int) -> list[tuple[int, int, str]]:
    """The addresses whose house number begins at a, behind the street."""
    if not a or not (t[a - 1].isspace() or t[a - 1] in ">|"):
        return []
    out = []
    for head, tail in (TURNED, TURNED_PLAIN):
        if (end := tail.match(t, a)) and (start := head.search(t, words_back(t, a, 6), a)):
            out.append((start.start(), end.end(), "street_address"))
    return out


def identifier(t: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """The identity number behind a cue that begins at a."""
    cue = None if a and t[a - 1].isalnum() else ID_CUE.match(t, a)
    m = ID_VALUE.match(t, cue.end()) if cue else None
    if not m or sum(c.isdigit() for c in m.group(1)) < 5:
        return []
    return [(m.start(1), m.start(1) + len(m.group(1).rstrip(" .-\r\n>|")), "id_number")]


def account(t: str, b: int) -> list[tuple[int, int, str]]:
    """The account number behind its cue, as long as its check digits say."""
    m = ACCOUNT.match(t, b)
    if not m:
        return []
    a, end = m.span(1)
    while end > a:
        bare = re.sub(r"[^A-Z0-9]", "", t[a:end])
        if len(bare) < 15:
            return []
        digits = "".join(str(int(c, 36)) for c in bare[4:] + bare[:4])
        if len(bare) <= 34 and int(digits) % 97 == 1:
            return [(a, end, "id_number")]
        end = a + len(t[a : end - 1].rstrip())
    return []


def street(t: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """The address of which the kind of street stands at a to b: the house number to the left, unit and town to the right."""
    end = AFTER_KIND.match(t, b)
    start = HOUSE.search(t, words_back(t, a + 1, 12), a + 1) if end else None
    return [(start.start(), end.end(), "street_address")] if start else []


@lru_cache(maxsize=2)
def finder(names: tuple[tuple[str, str], ...]) -> Finder:
    return Finder(frozenset(n for n, r in names if r == "first"), frozenset(n for n, r in names if r == "last"))


def possible_names(t: str, longest: int) -> set[str]:
    """What in a text the finder may take for a form of a name of at most so many characters, and what else it looks up for it."""
    out = set()
    for m in NAME_BEGIN.finditer(t):
        a = m.start()
        if not t[a].isupper():
            continue
        for b in range(a + 1, NAME_RUN.match(t, a, a + longest).end() + 1):
            if not (b < len(t) and (t[b].isalnum() or t[b] in "_@")):
                form, low = t[a:b], t[a:b].lower()
                out.add(form)
                if form not in (title(low), low.upper()):
                    out.add(low)
    return out | {whole for m in BROKEN.finditer(t) if m.group()[0].isupper() and len(whole := (m.group(1) + m.group(2)).lower()) <= longest}


def with_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """record_id, field, text and names (name, role): those of ``names`` that the text may have."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(form, name, role) for name, role in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for form in {name, title(name), name.upper()}]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(3)], ["form", "name", "role"])

    forms = cut(names.select("name", "role").mapInArrow(spell, "form string, name string, role string"))
    longest = forms.agg(F.max(F.length("form"))).first()[0]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in parts_of(b.column(1), 1_000_000):
                ids = b.column(0).slice(first, len(part)).to_pylist()
                rows = [(i, w) for i, t in zip(ids, part) if t for w in possible_names(t, longest)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(2)], ["id", "form"])

    src = texts.withColumn("id", F.sha2("text", 256))
    found = spread(src.select("id", "text")).mapInArrow(words, "id string, form string").hint("merge").join(forms.hint("merge"), "form")
    own = found.groupBy("id").agg(F.collect_set(F.struct("name", "role")).alias("names"))
    return src.hint("merge").join(own.hint("merge"), "id", "left").select("record_id", "field", "text", "names")


def scan(texts: DataFrame, names: DataFrame) -> DataFrame:
    """record_id, field, found (kind, start_char from 1, end_char, value) and redacted of ``texts`` (record_id, field, text).

    In ``redacted`` each item is replaced by its kind in brackets and all else is unchanged.  Null texts give null and no
    items, empty texts stay empty; of rows of one record and field each is answered; texts are searched whole.
    """
    some = names.select("name", "role").limit(MOST_NAMES + 1).collect()
    whole = len(some) <= MOST_NAMES
    shared = texts.sparkSession.sparkContext.broadcast(tuple(sorted((r.name, r.role) for r in some)) if whole else None)
    src = texts.select(F.col("record_id").cast("string").alias("record_id"), "field", "text")
    src = src if whole else with_names(src, names)
    item = pa.struct([("kind", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(shared.value) if whole else None
        for b in batches:
            for first, part in parts_of(b.column(2), 1_000_000):
                if not whole:
                    own = finder(tuple(sorted({(x["name"], x["role"]) for row in b.column(3).slice(first, len(part)).to_pylist() for x in row or ()})))
                found, redacted = [], []
                for t in part:
                    items = own.find(t) if t else []
                    found.append([{"kind": k, "start_char": x + 1, "end_char": y, "value": t[x:y]} for x, y, k in items])
                    if items:
                        out, at = [], 0
                        for x, y, k in items:
                            out += [t[at:x], f"[{k.upper()}]"]
                            at = y
                        t = "".join([*out, t[at:]])
                    redacted.append(t)
                n = len(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(found, pa.list_(item)), pa.array(redacted, pa.string())], ["record_id", "field", "found", "redacted"])

    return spread(src).mapInArrow(run, "record_id string, field string, found array<struct<kind string, start_char bigint, end_char bigint, value string>>, redacted string")


def items(scanned: DataFrame) -> DataFrame:
    """record_id, field, kind and start_char of every item."""
    one = scanned.select("record_id", "field", F.explode("found").alias("f"))
    return one.select("record_id", "field", "f.kind", "f.start_char").distinct()
