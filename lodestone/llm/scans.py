"""Problem 3: continuous text from scanned pages.

Three passes over the collection.  The first counts its words, those of copies once.  The second counts which words stand near the most frequent
ones; from these counts skip-gram vectors with negative sampling are trained, those of the most frequent words on the driver
(a table of fixed size, whatever the collection's), those of all other words that may be the right one in tasks, against the
context vectors of the first.  The third goes through every record: a word is linked to the words that plausible glyph edits
lead to, and the vectors of the words around it choose among them and accept or reject the best, so that a misreading may be
a word itself.  Running headers
and page numbers are found across a record's pages and removed, words cut at line ends are joined, and lines are reflowed.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import parts_of
from lodestone.tables import cut, spread

#: Words that the lexicon has at most, the most frequent ones; a rarer word counts as not seen before: it is corrected, but no
#: other word into it.  Words that contexts consist of.
MOST_WORDS, VECTORS = 500_000, 1024
DIM, WINDOW = 32, 2
#: A word is a misreading only of one that is so many times as frequent; of short words more.
RATIO, SHORT_RATIO, FEWEST = 8, 60, 4
#: Odds against a misreading where the word is one itself; occurrences from which on half of a vector's evidence counts.
REAL_ODDS, DOUBT = 1000, 100
NEGATIVES = 5
LOG_NEGATIVES = float(np.log(NEGATIVES))
#: Words of a stretch that copies count once: at least, at most.
STRETCH, LONGEST_STRETCH = 4, 64
#: Characters of a word at most.
LONGEST = 60
KINDS = ("hyphen_break", "misread", "running_header", "page_number")
# What recognition makes of glyphs (wrong, right).
GLYPHS = (
    ("€", "e"), ("@", "a"), ("!", "i"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("0", "o"), ("5", "s"), ("(", "c"), ("9", "g"), ("$", "s"),
    ("8", "b"), ("6", "b"), ("c", "e"), ("ri", "n"), ("f", "t"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("vv", "w"), ("h", "li"),
)
LETTERS = tuple(g for g in GLYPHS if g[0].isalpha())
SYMBOLS = frozenset("€@!|0159($86")
HYPHENS = "-­¬‐‑"
MARKER = re.compile(r"(?m)^=== Page (\d+) ===[ \t]*\r?$")
ADDRESS = re.compile(r"[\w.+\-]+ ?(?:@|\(at\)|\[at\]| AT ) ?(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}|https?://\S+|www\.\S+")
TRIM = ".,;:?)]}>\"'”’*_/\\"
LEAD = "\"'“‘[{<*_>/\\"
BROKEN = re.compile(rf"([^\W\d_](?:[^\s.,;:?]*[^\W\d_]|[^\s.,;:?]*[€@!|0159(])?|[€@!|0159(])[{HYPHENS}][ \t]*$")
ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
NUMBER_LINE = re.compile(r"\W{0,3}(?:(?:page|pagc|p|pg|seite|s)\b\.?\s*)?\W{0,2}([0-9OoIl|!SsZzB]{1,5}|[ivxlcIVXLC]{1,9})(?:\s*(?:of|/|von)\s*[0-9OoIl|!SsZzB]{1,5})?\W{0,3}$", re.I)
_NUMBER = r"[\W_]{0,3}(?:(?:page|p|pg)\b\.?\s?)?\W?([0-9OoIl|!SsB]{1,5}|[ivxlcIVXLC]{1,9})(?:\s?(?:of|/)\s?[0-9OoIl|!SsB]{1,5})?\W{0,2}"
BESIDE = (re.compile(rf"\s*{_NUMBER}\s{{2,}}(\S.*)$", re.I), re.compile(rf"\s*(\S.*?)\s{{2,}}{_NUMBER}\s*$", re.I))
DIGITS = str.maketrans("OoIl|!SsZzB", "00111155228")
MARKS = re.compile(r"^(?:[>|][ \t>|]*)?")


def pages(text: str) -> list[tuple[int, str]]:
    """Number and text of each page: by marker lines if there are any, else by form feeds."""
    found = list(MARKER.finditer(text))
    if not found:
        return [(n + 1, p) for n, p in enumerate(text.split("\f"))]
    ends = [m.start() for m in found[1:]] + [len(text)]
    head = text[: found[0].start()]
    out = [(int(m.group(1)), text[m.end() : e]) for m, e in zip(found, ends)]
    if head.strip():  # pages count from 1: what stands above the first line is of the page it begins
        out[0] = (out[0][0], head + out[0][1])
    return out


def core(token: str) -> str:
    return token.rstrip(TRIM).lstrip(LEAD)


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, without addresses; what a line end cuts is left out."""
    out = []
    any_address = addressed(text)
    for line in text.split("\n"):
        if any_address and addressed(line):
            line = ADDRESS.sub(" ", line)
        tokens = line.split()
        if tokens and tokens[-1][-1] in HYPHENS and BROKEN.search(line.rstrip()):
            tokens.pop()
        out += tokens
    return [w for w in map(_cores.__getitem__, out) if w]


class Cores(dict):
    """From a token to its word in lower case, empty for numbers; kept, as most tokens come again and again."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        w = core(token)
        self[token] = w = "" if w.isdigit() else w.lower()
        return w


_cores = Cores()


class Lows(dict):
    """From a token to its core in lower case, numbers too."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[token] = w = core(token).lower()
        return w


_lows = Lows()


def addressed(text: str) -> bool:
    """Whether there may be an address in a text; the pattern itself is slow."""
    return "@" in text or "http" in text or "www." in text or "(at)" in text or "[at]" in text or " AT " in text


class Lexicon:
    """Word frequencies and vectors, and the links from rare words to frequent ones."""

    def __init__(self, counts: dict[str, int], names: list[str], vectors: np.ndarray, contexts: np.ndarray):
        self.counts, self.place, self.vectors, self.contexts = counts, {w: i for i, w in enumerate(names)}, vectors, contexts
        self.known: dict[str, tuple[str, ...]] = {}
        self.real: dict[str, tuple[str, ...]] = {}
        self.rows: dict[str, array | None] = {}

    def count(self, w: str) -> int:
        return self.counts.get(w, 0)

    def links(self, word: str) -> tuple[str, ...]:
        """The frequent words of which ``word`` (in lower case) may be a misreading; none if it is a word itself."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known = {}
            self.known[word] = got = self._links(word)
        return got

    def _links(self, word: str) -> tuple[str, ...]:
        n = len(word)
        plain = word.isalpha()
        letters = n if plain else sum(c.isalpha() for c in word)
        if n < 3 or n > 40 or letters < 2 or letters < n - 3 - word.count("-"):
            return ()
        if n == letters + word.count("-") and self.count(word) * RATIO > max(self.most(), 1):
            return ()
        odd = 0 if plain else sum(c in SYMBOLS for c in word)
        if odd > 3:
            return ()
        own = self.count(word)
        seen, now, found = {word}, {word}, set()
        for step in range(max(2, odd)):
            after = set()
            for w in now:
                for wrong, right in LETTERS if plain else GLYPHS:
                    at = w.find(wrong)
                    while at >= 0:
                        x = w[:at] + right + w[at + len(wrong) :]
                        if x not in seen:
                            seen.add(x)
                            after.add(x)
                        at = w.find(wrong, at + 1)
            # how much more frequent it must be is for the words around to say
            found = {x for x in after if (c := self.count(x)) >= FEWEST and c > own and not SYMBOLS & set(x)}
            if found:
                break
            now = after
        if not found and "-" in word:
            parts = word.split("-")
            options = [(p,) if not (p_ := self.links(p)) else p_ for p in parts]
            if any(o != (p,) for o, p in zip(options, parts)):
                found.add("-".join(o[0] for o in options))
        return tuple(sorted(found, key=lambda x: (-self.count(x), x)))

    @lru_cache(maxsize=1)  # noqa: B019
    def most(self) -> int:
        return max(self.counts.values(), default=0)

    def twins(self, word: str) -> tuple[str, ...]:
        """The words of which ``word``, a word itself, may be a misreading in the right context: one glyph edit off, both with vectors."""
        got = self.real.get(word)
        if got is None:
            if len(self.real) > 500_000:
                self.real = {}
            found = set()
            if word in self.place and 3 <= len(word) <= 40:
                for wrong, right in GLYPHS:
                    at = word.find(wrong)
                    while at >= 0:
                        x = word[:at] + right + word[at + len(wrong) :]
                        if x in self.place and self.count(x) >= FEWEST:
                            found.add(x)
                        at = word.find(wrong, at + 1)
            # not what is itself a misreading of the word; and no words around can speak for what falls short even with the best of them
            self.real[word] = got = tuple(sorted((x for x in found - {word} if word not in self.links(x) and self._reach(word, x) >= log(real_odds(x))), key=lambda x: (-self.count(x), x)))
        return got

    def _reach(self, word: str, x: str) -> float:
        """The most that ``odds`` can be for ``x`` instead of ``word``."""
        gain = np.frombuffer(self.row(x), np.float32) - np.frombuffer(self.row(word), np.float32)
        return log((self.count(x) + 1.0) / (self.count(word) + 1.0)) + 2 * WINDOW * max(0.0, float(gain.max(initial=0.0))) + 1e-3

    def near(self, around: list[str]) -> list[int]:
        """The places of those words of ``around`` that contexts consist of."""
        return [i for w in around if (i := self.place.get(w, VECTORS)) < len(self.contexts)]

    def row(self, w: str) -> array | None:
        """For each word that contexts consist of, how much likelier it is beside ``w`` than anywhere (log); none if nothing is known of ``w``."""
        got = self.rows.get(w, self)
        if got is self:
            if len(self.rows) > 20_000:
                self.rows = {}
            i = self.place.get(w)
            if i is None:
                got = None
            else:
                n = self.count(w)
                got = array("f", ((self.contexts @ self.vectors[i] + LOG_NEGATIVES) * (n / (n + DOUBT))).astype(np.float32).tobytes())
            self.rows[w] = got
        return got

    def fit(self, w: str, near: list[int]) -> float:
        """How much likelier the words around are beside ``w`` than anywhere (log); 0 if nothing is known of it."""
        row = self.row(w) if near else None
        return sum([row[i] for i in near]) if row is not None else 0.0

    def choose(self, options: tuple[str, ...], near: list[int]) -> str:
        """The option that fits the words around best; among options without vectors the most frequent."""
        if len(options) == 1:
            return options[0]
        return max(options, key=lambda w: (log(self.count(w) + 1.0) + self.fit(w, near), w))

    def odds(self, word: str, best: str, near: list[int]) -> float:
        """How much likelier ``best`` is here than ``word`` (log), by frequencies and context together."""
        return log((self.count(best) + 1.0) / (self.count(word) + 1.0)) + self.fit(best, near) - self.fit(word, near)

    def meant(self, word: str, options: tuple[str, ...], around: list[str]) -> str | None:
        """What of ``options`` (its links, or without any its twins) ``word`` was meant to be; none if frequency and context speak for ``word`` itself.

        A twin must have two words around that are known, and must fit them.
        """
        near = self.near(around)
        best = self.choose(options, near)
        if "-" in best and not self.count(best):  # a compound is judged by its parts
            return best
        odds = self.odds(word, best, near)
        if options is not self.real.get(word):
            return best if odds >= log(RATIO if len(best) > 3 else SHORT_RATIO) else None
        return best if len(near) > 1 and odds >= log(real_odds(best)) and self.fit(best, near) > 0 else None


def real_odds(w: str) -> float:
    """The odds that a word must have to be taken for what another word was meant to be."""
    return REAL_ODDS * (1 if len(w) > 3 else SHORT_RATIO / RATIO)


def train(pairs: np.ndarray, n: int, dim: int = DIM, negatives: int = NEGATIVES, rounds: int = 200, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors with negative sampling, by gradient ascent on the expected loss over a table of pair counts."""
    rng = np.random.default_rng(seed)
    w, c = (rng.normal(0, 0.1, (n, dim)).astype(np.float32) for _ in range(2))
    total = max(1.0, pairs.sum())
    left, right = pairs.sum(1), pairs.sum(0)
    noise = (negatives * np.outer(left, right) / total).astype(np.float32)
    scale = [(1.0 / np.maximum(x, 1.0))[:, None].astype(np.float32) for x in (left, right)]
    pairs = pairs.astype(np.float32)
    for step in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(w @ c.T, -30, 30)))
        g = pairs * (1 - s) - noise * s
        rate = np.float32(0.2 * (1 - step / rounds) + 0.01)
        w, c = w + rate * scale[0] * (g @ c), c + rate * scale[1] * (g.T @ w)
    return w, c


def folded(pairs: np.ndarray, contexts: np.ndarray, right: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Vectors of further words (rows of ``pairs``) against trained ``contexts``, of which ``right`` has the totals; the loss is that of ``train``."""
    pairs = pairs.astype(np.float32)
    left = np.maximum(pairs.sum(1), 1.0)[:, None]
    noise = NEGATIVES * left * (right / max(1.0, right.sum()))[None, :].astype(np.float32)
    w = np.zeros((len(pairs), contexts.shape[1]), np.float32)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(w @ contexts.T, -30, 30)))
        w += 0.2 / left * ((pairs * (1 - s) - noise * s) @ contexts)
    return w


@lru_cache(maxsize=100_000)
def collapsed(line: str) -> str:
    """A line without numbers and without the difference of glyphs that recognition confuses."""
    out = []
    for t in re.findall(r"\S+", line.lower()):
        if sum(c.isdigit() for c in t) * 2 >= len(t):
            out.append("#")
            continue
        for wrong, right in (("€", "e"), ("@", "a"), ("0", "o"), ("5", "s"), ("(", "e"), ("9", "g"), ("c", "e"), ("ri", "n"), ("f", "t"), ("el", "d"), ("ii", "u"), ("!", "i"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("vv", "w"), ("li", "h"), ("1", "l"), ("|", "l"), ("i", "l")):
            t = t.replace(wrong, right)
        out.append(t)
    return " ".join(out)


def value(s: str, expected: int | None = None) -> int | None:
    """The number that a page number shows, with the faults of recognition if ``expected`` is given."""
    if s.isdigit():
        return int(s)
    if ROMAN.match(s):
        total, last = 0, 0
        for ch in reversed(s.lower()):
            v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[ch]
            total += v if v >= last else -v
            last = max(last, v)
        if expected is None or total == expected:
            return total
    t = s.translate(DIGITS)
    return int(t) if expected is not None and t.isdigit() and int(t) == expected else None


class Page:
    def __init__(self, number: int, text: str):
        self.number = number
        self.lines = [x.rstrip("\r") for x in text.split("\n")]
        self.furniture: dict[int, set[str]] = defaultdict(set)
        self._full: list[int] | None = None

    def edge(self, most: int = 2) -> list[int]:
        """The first and last lines with anything in them."""
        if self._full is None:
            self._full = [i for i, x in enumerate(self.lines) if x.strip()]
        return list(dict.fromkeys(self._full[:most] + self._full[-most:]))

    def numbers(self, expected: int | None = None) -> list[tuple[int, int]]:
        """Line and value of what may be this page's number."""
        out = []
        for i in self.edge():
            line = self.lines[i]
            if len(line) > 24 and "  " not in line:
                continue
            m = NUMBER_LINE.match(line.strip()) if len(line.strip()) < 24 else None
            forms = [m.group(1)] if m else []
            for k, pattern in enumerate(BESIDE):
                if b := pattern.match(line):
                    forms.append(b.group(1 + k))
            out += [(i, v) for s in forms if (v := value(s, expected)) is not None]
        return out


def alike(a: str, b: str) -> bool:
    """Whether two collapsed lines are one line but for faults of recognition: half of the words are equal, and most letters."""
    if a == b:
        return True
    x, y = a.split(), b.split()
    if abs(len(a) - len(b)) > 6 or len({*x} & {*y}) < max(1, min(len(x), len(y)) // 2):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.86


def mark_furniture(record: list[Page]) -> None:
    """Page numbers in step with the pages, and lines at the top or bottom that three pages repeat."""
    if len(record) < 2:
        return
    steps: dict[int, set[int]] = defaultdict(set)
    for p in record:
        for _, v in p.numbers():
            steps[v - p.number].add(p.number)
    best = max(steps.items(), key=lambda x: (len(x[1]), -abs(x[0])), default=(0, set()))
    if len(best[1]) >= 2:
        for p in record:
            for i, v in p.numbers(p.number + best[0]):
                if v == p.number + best[0]:
                    p.furniture[i].add("page_number")
    if len(record) < 3:
        return
    edges: list[tuple[str, Page, int]] = []
    for p in record:
        full = [i for i, x in enumerate(p.lines) if x.strip() and not (p.furniture[i] and NUMBER_LINE.match(x.strip()))]
        for i in dict.fromkeys(full[:1] + full[-1:]):
            line = p.lines[i]
            for k, pattern in enumerate(BESIDE):
                if (b := pattern.match(line)) and p.furniture[i]:
                    line = b.group(2 - k)
            if sum(c.isalpha() for c in line) >= 4 and len(line) <= 120:
                edges.append((re.sub(r"^# | #$", "", collapsed(line)), p, i))
    groups: list[list[tuple[str, Page, int]]] = []
    for e in edges:
        for g in groups:
            if alike(g[0][0], e[0]):
                g.append(e)
                break
        else:
            groups.append([e])
    for g in groups:
        if len({p.number for _, p, _ in g}) >= 3:
            for _, p, i in g:
                p.furniture[i].add("running_header")


class Reader:
    """Goes through one record."""

    def __init__(self, lexicon: Lexicon):
        self.lex = lexicon
        self.plans: dict[str, tuple[str, tuple[str, ...]] | None] = {}  # of each token

    def joins(self, left: str, right: str) -> str | None:
        """The word that a line end cuts into left and right, or none if they are a compound at its own hyphen."""
        a, b = left.lower(), right.lower()
        whole, compound = self.lex.count(a + b), self.lex.count(f"{a}-{b}")
        if whole or compound:
            return left + right if whole >= compound else None
        for x, y in ((a + b, left + right), (f"{a}-{b}", None)):
            if self.lex.links(x):
                return y
        ends = a.rsplit("-", 1)[-1], b.split("-", 1)[0]
        if all(self.lex.count(e) >= FEWEST and len(e) > 2 for e in ends):
            return None
        return left + right

    def read(self, text: str) -> tuple[list[tuple[int, str]], str]:
        """The findings (page, kind) of a record, and its text as paragraphs."""
        record = [Page(n, t) for n, t in pages(text)]
        mark_furniture(record)
        found = {(p.number, k) for p in record for kinds in p.furniture.values() for k in kinds}
        flow: list[tuple[int, str]] = []  # page and line, without furniture; an empty line ends a paragraph
        for p in record:
            kept = [x for i, x in enumerate(p.lines) if not p.furniture.get(i)]
            full = [i for i, x in enumerate(kept) if x.strip()]
            flow += [(p.number, x) for x in kept[full[0] : full[-1] + 1]] if full else []
        paragraphs: list[str] = []
        words: list[str] = []
        carry = ""  # the first part of a word that the last line cut
        for k, (page, line) in enumerate(flow):
            bare = MARKS.sub("", line, count=1) if line[:1] in "|>" else line
            if not bare.strip():
                if words:
                    paragraphs.append(" ".join(words))
                    words = []
                continue
            tokens = bare.split()
            if carry:
                tokens[0], carry = carry + tokens[0], ""
            cut_ = bare.rstrip()[-1:] in HYPHENS and BROKEN.search(bare)
            if cut_:
                after = next((MARKS.sub("", x, count=1).split() for _, x in flow[k + 1 : k + 3] if MARKS.sub("", x, count=1).strip()), [])
                if after and after[0][:1].isalnum() | (after[0][:1] in SYMBOLS):
                    left, right = core(tokens[-1].rstrip(HYPHENS)), core(after[0])
                    left = left if len(left) + len(right) <= LONGEST else ""  # no word is longer
                    if left and self.joins(left, right) is not None:
                        found.add((page, "hyphen_break"))
                        carry = tokens.pop().rstrip(HYPHENS)
                    elif left:
                        carry = tokens.pop()
            skip = addressed(bare) and ADDRESS.search(bare)
            plain = ADDRESS.sub(lambda m: "\x00" * len(m.group()), bare) if skip else ""
            hidden = set(bare.split()) - set(plain.split()) if skip else ()
            shown = tokens
            for i, t in enumerate(tokens):
                plan = self.plans.get(t, self)
                if plan is self:
                    plan = self.plan(t)
                if plan is None or t in hidden:
                    continue
                fixed = self.fix(t, tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW])
                if fixed is not None:
                    found.add((page, "misread"))
                    shown = list(tokens) if shown is tokens else shown
                    shown[i] = fixed
            words += shown
        if carry:
            words.append(carry)
        if words:
            paragraphs.append(" ".join(words))
        return sorted(found), "\n\n".join(paragraphs)

    def plan(self, token: str) -> tuple[str, tuple[str, ...]] | None:
        """The word of a token that may be misread, and what it may have been; none if it is right wherever it stands."""
        plan = self.plans.get(token, self)
        if plan is self:
            if len(self.plans) > 500_000:
                self.plans.clear()
            self.plans[token] = plan = self._plan(token)
        return plan

    def _plan(self, token: str) -> tuple[str, tuple[str, ...]] | None:
        low = _lows[token]
        bare = low.lstrip("(|").rstrip("!|")
        for w in dict.fromkeys((low, token.lower().rstrip(TRIM), bare)):
            if not w:
                continue
            if w == bare and w != low and self.lex.count(w):
                return None
            options = self.lex.links(w) or self.lex.twins(w)
            if options:
                return None if w != bare and self.lex.count(bare) >= FEWEST else (w, options)
        return None

    def fix(self, token: str, around: list[str]) -> str | None:
        """The token with its word corrected, in the case it was shown in, or none if it isn't misread among the tokens ``around``."""
        plan = self.plan(token)
        if plan is None:
            return None
        w, options = plan
        best = self.lex.meant(w, options, [_lows[x] for x in around])
        if best is None:
            return None
        at = token.lower().find(w)
        shown = token[at : at + len(w)]
        if shown[:1].isupper():
            best = best.upper() if shown.isupper() and len(shown) > 3 else best[:1].upper() + best[1:]
        return token[:at] + best + token[at + len(w) :]


class Ends(dict):
    """Whether a stretch ends after a word: after one of four words, the same in all texts."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[word] = end = zlib.crc32(word.encode("utf-8", "surrogatepass")) & 3 == 0
        return end


_ends = Ends()


def stretches_of(words: list[str]) -> Iterator[tuple[str, str]]:
    """The words cut into stretches, each with the words just before it.

    Where a stretch ends depends on the words near by only, so that texts cut alike where they are copies, whatever their lines.
    """
    start, n = 0, len(words)
    while start < n:
        i, most = start + STRETCH, min(start + LONGEST_STRETCH, n)
        while i < most and not _ends[words[i - 1]]:
            i += 1
        i = min(i, most)
        yield " ".join(words[max(0, start - WINDOW) : start]), " ".join(words[start:i])
        start = i


def stretches(texts: DataFrame) -> DataFrame:
    """The distinct stretches of a column of texts (head, body): what copies and near-copies share is there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in parts_of(b.column(0)):
                found = list({x for t in part for x in stretches_of(words_of(t))})
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["head", "body"])

    return texts.mapInArrow(run, "head string, body string").distinct()


def word_counts(stretch: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for _, part in parts_of(b.column(0)):
                for t in part:
                    counts.update(t.split(" "))
                if len(counts) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return stretch.select("body").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(stretch: DataFrame, names: list[str], most: int = VECTORS) -> DataFrame:
    """How often a word of ``names`` stands within ``WINDOW`` words of one of its first ``most``: a, b (their places) and n."""
    shared = stretch.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, apart = shared.value, [-1] * WINDOW  # between two stretches
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            nonlocal keys, counts, held
            at, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            held = []
            every, where = np.unique(np.concatenate((keys, at)), return_inverse=True)
            keys, counts = every, np.bincount(where, np.concatenate((counts, n)), len(every)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((keys // most).astype(np.int32)), pa.array((keys % most).astype(np.int32)), pa.array(counts)], ["a", "b", "n"])

        for b in batches:
            for first, part in parts_of(b.column(1)):
                ids, new = [], []
                for head, body in zip(b.column(0).slice(first, len(part)).to_pylist(), part):
                    before = [place.get(w, -1) for w in head.split(" ")] if head else []
                    own = [place.get(w, -1) for w in body.split(" ")]
                    ids += [*before, *own, *apart]
                    new += [False] * len(before) + [True] * (len(own) + WINDOW)  # pairs within the head are of another stretch
                ids, new = np.array(ids, np.int64), np.array(new, bool)
                for d in range(1, WINDOW + 1):
                    for x, y in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                        ok = new[d:] & (x >= 0) & (y >= 0) & (y < most)
                        held.append(x[ok] * most + y[ok])
                if sum(map(len, held)) > 2_000_000:
                    add()
                    if len(keys) > 2_000_000:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        add()
        yield out()

    return stretch.select("head", "body").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame) -> tuple[dict[str, int], list[str], np.ndarray, np.ndarray]:
    """Word frequencies, the words with vectors, and their vectors, from a column of texts; the first words have context vectors too."""
    stretch = cut(stretches(texts))
    rows = word_counts(stretch).where("n > 1").orderBy(F.desc("n"), "word").limit(MOST_WORDS).toArrow()
    counts = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
    names = [w for w in counts if w.replace("-", "").isalpha()]
    names = names[:VECTORS] + [w for w in names[VECTORS:] if counts[w] >= FEWEST]
    size = min(VECTORS, len(names))
    pairs = cut(pair_counts(stretch, names))
    top = pairs.where(F.col("a") < size).toArrow()
    table = np.zeros((size, size))
    table[top.column("a").to_numpy(), top.column("b").to_numpy()] = top.column("n").to_numpy()
    vectors, contexts = train(table, size)
    right = table.sum(0)
    more = np.zeros((len(names), DIM), np.float32)
    more[:size] = vectors
    if len(names) > size:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    b = batch.slice(at, 500)
                    dense = np.zeros((b.num_rows, size), np.float32)
                    for i, met in enumerate(b.column(1).to_pylist()):
                        for m in met:
                            dense[i, m["b"]] = m["n"]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(folded(dense, contexts, right).tolist(), pa.list_(pa.float32()))], ["a", "v"])

        rare = pairs.where(F.col("a") >= size).groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("met")).mapInArrow(run, "a int, v array<float>").toArrow()
        if rare.num_rows:
            more[rare.column("a").to_numpy()] = rare.column("v").combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    return counts, names, more, contexts


_last: tuple[object, Reader] | None = None


def reader_of(model: tuple) -> Reader:
    """The reader of a model; kept between the tasks of a worker, with what it knows of words."""
    global _last
    if _last is None or _last[0] is not model:
        _last = model, Reader(Lexicon(*model))
    return _last[1]


def repair(texts: DataFrame) -> DataFrame:
    """record_id, found (page_no, kind) and text (repaired) of ``texts`` (record_id, text).

    Null texts are left out, empty texts have no findings and stay empty; rows of one record_id are taken as copies.
    Pages are those of the ``=== Page n ===`` lines, else of form feeds.  A text of any length is read whole.
    """
    src = cut(spread(texts.where("record_id is not null and text is not null").dropDuplicates(["record_id"]).select("record_id", "text")))
    shared = texts.sparkSession.sparkContext.broadcast(learn(src.select("text")))
    pair = pa.struct([("page_no", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        for b in batches:
            for first, part in parts_of(b.column(1)):
                done = [reader.read(t) for t in part]
                found = [[{"page_no": p, "kind": k} for p, k in f] for f, _ in done]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(found, pa.list_(pair)), pa.array([t for _, t in done], pa.string())], ["record_id", "found", "text"])

    return src.mapInArrow(run, "record_id string, found array<struct<page_no bigint, kind string>>, text string")


def findings(repaired: DataFrame) -> DataFrame:
    """record_id, page_no and kind of what was wrong."""
    return repaired.select("record_id", F.explode("found").alias("f")).select("record_id", "f.page_no", "f.kind")


def records(df: DataFrame, key: str, text: str | Column) -> DataFrame:
    """record_id and text of a table of records."""
    return df.select(df[key].cast("string").alias("record_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
