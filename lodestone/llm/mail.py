"""Problem 5: the newly written text of e-mails.

Messages are gathered by thread (the subject without reply marks).  A generalised suffix automaton holds all words of all
messages of a thread, quoted ones too, without their quote marks; each of its states knows how near to the top of a message
its words stand in the thread, and in whose.  Who quotes puts words above what is quoted, so a long run of words that
another message of the thread has nearer to its top is inherited, however its lines are wrapped and marked and whatever
the clocks of the senders say.  Inherited lines are quoted; introductions, quote marks and headers extend them to the lines
around, and stand for themselves where the thread doesn't have the original.  From what is left, banners and legal notices
are cut, and then the ending: endings of the same sender that come again, and the lines from a closing phrase, a signature
mark or the sender's name on, if only endings follow.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.tables import cut, once

#: Words in a row that count as inherited.
RUN = 12
#: Messages of one thread in one automaton; the messages of a longer thread are compared by shuffles of their runs.
STRETCH = 500
NOWHERE = 1 << 62
PAGE = re.compile(r"=== Page \d+ ===\s*$")
HEADER = re.compile(r"(?:From|Sent|To|Cc|CC|Bcc|BCC|Subject|Date|Reply-To|Importance|Attachments|Von|Gesendet|An|Betreff|De|Envoyé|À|Objet):")
RULE = re.compile(r"(?:-{2,} ?(?:Original Message|Forwarded [Mm]essage|Weitergeleitete Nachricht|Ursprüngliche Nachricht|Message d'origine|Message transféré)[ -]*-{2,}|Begin forwarded message:)\s*$", re.I)
LINE = re.compile(r"_{20,}\s*$")
MARKED = re.compile(r"\s*[|>]")
MORE_THAN = re.compile(r">\s*\d[\d.,]*\s*(?:percent|per cent|%)")
MARKS = re.compile(r"^[>| \t]+")
ADDRESS = r"<?[\w.+\-]+ ?(?:@|\(at\)|\[at\]| AT ) ?[\w.\-]+>?"
INTRODUCED = re.compile(
    rf"(?:On (?=.*\d).{{4,120}}\bwrote ?:|On (?=.*\d{{4}}).{{4,120}}[^.!?:]|Le (?=.*\d).{{4,120}}\ba écrit ?:|Am (?=.*\d).{{4,120}}\bschrieb\b.{{0,120}}:|.{{2,80}}\bschrieb am\b.{{4,40}}:|.{{2,80}}{ADDRESS}.{{0,40}}\b(?:wrote|a écrit|schrieb) ?:)\s*$"
)
WROTE = re.compile(r"(?:.{0,80} )?(?:wrote|a écrit|schrieb)\b.{0,80}:\s*$")
CLOSING = re.compile(
    r"(?:(?:with )?(?:best|kind|warm|kindest|warmest|many)?\s*(?:regards|wishes|thanks)|best|cheers|thanks(?: again| a lot| so much| and (?:best |kind )?regards)?|thank you(?: very much)?|sincerely(?: yours)?|yours(?: sincerely| faithfully| truly)?|respectfully|cordially|all the best|take care|mit freundlichen grüßen|viele grüße|freundliche grüße|cordialement|saludos)\s*[,.!]?\s*$",
    re.I,
)
MARK = re.compile(r"(?:--\s*|_{5,19}\s*|-{3,}\s*|\*{3,}\s*|={3,}\s*)$")
DEVICE = re.compile(r"(?:sent|gesendet|envoyé) (?:from|von|via|de|depuis) (?:my|meinem|mon|the)?\b.{0,60}$|get outlook for\b.*$", re.I)
CONTACT = re.compile(r"(?:tel|phone|mobile|fax|t|m|p)\b\.?:? *[+(\d].*$|.* \| .*\d{3}.*$|[+(]?\d[\d .()\-]{7,}(?: ext\. ?\d+)?(?: \| .*)?$", re.I)
BARE_NAME = re.compile(r"[A-ZÀ-Þ][\w'’\-]+(?: [A-Z]\.)?(?: [A-ZÀ-Þ][\w'’\-]+){1,2}$")
GREETING = re.compile(r"(?:dear|hi|hello|good (?:morning|afternoon|evening)|hey)\b.{0,60}$|[A-Z][\w\-]+,$", re.I)
SENTENCE = re.compile(r"[.?!]['\")\]]?\s*$")
ORNAMENT = re.compile(r"[*=_\-~#]{5,}\s*$")
BANNER = re.compile(r"(?:\[EXTERNAL\]|\[EXT\]|CAUTION:|WARNING:|EXTERNAL EMAIL|\*{2,} ?(?:this|external|caution)\b)", re.I)
# What legal notices and notices of mail systems speak of.
LEGAL = (
    "confidential", "privileged", "intended only", "intended solely", "intended recipient", "addressee", "unauthorised", "unauthorized",
    "disclos", "liability", "professional secrecy", "in error", "delete it", "those of the author", "environment before printing",
    "not a secure medium", "form part of any contract", "virus", "outside the organisation", "external address", "verify the sender",
    "do not open links", "written permission", "this transmission", "this message and any attachment", "may be incomplete",
)


class Automaton:
    """A generalised suffix automaton over words; each state knows the nearest place to the top of a text where its words end."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Place of the last word and text, in one number, of the texts that end at a state; ``settle`` carries them to all states.
        self.end = [NOWHERE]

    def add(self, words: list[str], text: int) -> None:
        nexts, lengths, links, ends = self.next, self.length, self.link, self.end
        last = 0
        for at, w in enumerate(words):
            q = nexts[last].get(w)
            if q is not None:
                last = q if lengths[q] == lengths[last] + 1 else self._split(last, w, q)
            else:
                new, p = len(nexts), last
                nexts.append({})
                links.append(0)
                lengths.append(lengths[last] + 1)
                ends.append(NOWHERE)
                while p >= 0 and w not in nexts[p]:
                    nexts[p][w] = new
                    p = links[p]
                if p >= 0:
                    q = nexts[p][w]
                    links[new] = q if lengths[q] == lengths[p] + 1 else self._split(p, w, q)
                last = new
            here = at << 32 | text
            if here < ends[last]:
                ends[last] = here

    def _split(self, p: int, w: str, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.end.append(NOWHERE)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def settle(self, least: int) -> None:
        """To be called when all texts are added: where runs of ``least`` words end first, for every state of such a run."""
        link, end = self.link, self.end
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in reversed(order):
            if end[v] < end[link[v]]:
                end[link[v]] = end[v]
        #: For a state of longer words, the state of their last ``least`` words.
        self.run = [0] * len(self.next)
        for v in order:
            if self.length[v] >= least:
                self.run[v] = v if self.length[self.link[v]] < least else self.run[self.link[v]]

    def runs(self, words: list[str], least: int) -> list[int]:
        """The state of the run of ``least`` words from each word on, of a text that was added."""
        out, state = [], 0
        for i, w in enumerate(words):
            state = self.next[state][w]
            if i + 1 >= least:
                out.append(self.run[state])
        return out


class Message:
    def __init__(self, key: str, text: str):
        self.key = key
        self.lines = [x.rstrip("\r") for x in text.split("\n")]
        self.kind: list[str | None] = [None] * len(self.lines)
        #: Why a line is quoted: inherited, extended (structure around an inherited line) or structure.
        self.how: list[str | None] = [None] * len(self.lines)
        self.header: dict[str, str] = {}
        self._sender: str | None = None
        self._structure()

    def _structure(self) -> None:
        """Header, page lines, and what quote marks and introductions say."""
        lines, kind, i, n = self.lines, self.kind, 0, len(self.lines)
        while i < n and (PAGE.match(lines[i]) or not lines[i].strip()):
            kind[i] = "header" if lines[i].strip() else None
            i += 1
        while i < n and (HEADER.match(lines[i]) or self.header and lines[i][:1] in " \t" and lines[i].strip()):
            name, _, value = lines[i].partition(":")
            self.header.setdefault(name.lower(), value.strip())
            kind[i] = "header"
            i += 1
        self.top = i
        while i < n:
            t = lines[i]
            after = [x for x in lines[i + 1 : i + 4] if x.strip()]
            headed = bool(after) and bool(HEADER.match(after[0]))
            if PAGE.match(t):
                kind[i] = "header"
            elif RULE.match(t) or LINE.match(t) and headed or t.startswith(("From:", "Von:", "De:")) and "Subject:" not in t and headed:
                for k in range(i, n):  # a message that follows under its header goes on to the end
                    kind[k] = "header" if PAGE.match(lines[k]) else "quoted"
                return
            elif MARKED.match(t) and not (MORE_THAN.match(t) and not self._among_marks(i)):
                kind[i] = "quoted"
            elif WROTE.match(t) and len(t) < 100 and i and kind[i - 1] is None and not SENTENCE.search(lines[i - 1]) and INTRODUCED.match(f"{lines[i - 1].rstrip()} {t}"):
                kind[i - 1] = kind[i] = "quoted"
            elif INTRODUCED.match(t) and WROTE.search(t) or INTRODUCED.match(t) and after and MARKED.match(after[0]) and t.rstrip().endswith(":"):
                kind[i] = "quoted"
            i += 1

    def _among_marks(self, i: int) -> bool:
        """Whether a line beside i carries quote marks too; a blank line between them ends the stretch."""
        return any(0 <= k < len(self.lines) and MARKED.match(self.lines[k]) and not MORE_THAN.match(self.lines[k]) for k in (i - 1, i + 1))

    def words(self) -> list[tuple[str, int]]:
        """All words below the message's own header, quoted ones too, with their lines."""
        return [(w, i) for i in range(self.top, len(self.lines)) if self.kind[i] != "header" for w in re.findall(r"\w+", self.lines[i].lower())]

    @property
    def identity(self) -> tuple[str, str]:
        """Copies of one message, edited or not, have one sender and time."""
        return self.header.get("from", self.key), self.header.get("sent", self.header.get("date", self.key))

    @property
    def sender(self) -> str:
        """The sender's names, whatever form the header gives them in."""
        if self._sender is None:
            self._sender = " ".join(sorted({w for n in self.names() for w in n.split(" ") if w})) or self.header.get("from", self.key)
        return self._sender

    def last_lines(self) -> set[str]:
        """The lines that a sender's ending may consist of: the last of the message and the last that no structure marks."""
        own = [x for i, x in enumerate(self.lines) if i >= self.top and self.kind[i] is None and x.strip()]
        return {t for x in self.lines[-12:] + own[-12:] if (t := x.strip())}

    def names(self) -> set[str]:
        """How the sender may sign: full name, first name, last name."""
        f = self.header.get("from", "")
        shown = re.sub(r"<.*|[\w.+\-]+ ?(?:@|\(at\)| AT ).*", "", f).strip(' "')
        local = re.split(r" ?(?:@|\(at\)|\[at\]| AT )", re.sub(r".*<|>.*", "", f))[0]
        parts = [p for p in re.split(r"[^A-Za-zÀ-ÿ\-]+", shown) if len(p) > 1] or [p for p in re.split(r"[^a-z]+", local.split("+")[0].lower()) if len(p) > 1]
        low = [p.lower() for p in parts]
        return {" ".join(low), " ".join(reversed(low)), *low}

    def _signs(self, t: str, names: set[str]) -> bool:
        """Whether a line is the sender's name, in full or in part, or such a name as their address is made of."""
        bare = re.sub(r"[^\w\- ]", "", re.sub(r"\b\w\. ?", "", t)).lower().strip()
        if bare in names:
            return True
        local = re.split(r" ?(?:@|\(at\)|\[at\]| AT )", self.header.get("from", "").rpartition("<")[2].lower())[0]
        return bool(BARE_NAME.match(t)) and any(len(w) > 3 and w in local for w in bare.split(" "))

    def notices(self) -> None:
        """Banners above the text, and paragraphs of legal phrases with the ornament over them."""
        lines, kind, n = self.lines, self.kind, len(self.lines)
        i = self.top
        while i < n:
            if kind[i] is not None or not lines[i].strip():
                i += 1
                continue
            j = i
            while j < n and kind[j] is None and lines[j].strip():
                j += 1
            for a in range(i, j):
                first = lines[a].lower()
                opens = any(p in first for p in LEGAL) or ORNAMENT.match(lines[a]) or first.startswith(("notice", "disclaimer"))
                if BANNER.match(lines[a]) and j - a <= 3 or opens and all(self._legal(a, k) for k in range(a, j)) and self._phrases(a, j) >= 2:
                    kind[a:j] = ["disclaimer"] * (j - a)
                    b = a - 1
                    while b > self.top and kind[b] is None and not lines[b].strip():
                        b -= 1
                    if b >= self.top and kind[b] is None and ORNAMENT.match(lines[b]) and not LINE.match(lines[b]):
                        kind[b] = "disclaimer"
                    break
            i = j

    def _phrases(self, a: int, b: int) -> int:
        text = " ".join(self.lines[a:b]).lower()
        return sum(p in text for p in LEGAL)

    def _legal(self, a: int, k: int) -> bool:
        """Whether line k goes on with the notice that begins at a: it has a legal phrase, alone or across the line end."""
        line = self.lines[k]
        if ORNAMENT.match(line):
            return True
        around = " ".join(self.lines[max(a, k - 1) : k + 2]).lower()
        return any(p in line.lower() for p in LEGAL) or any(p in around for p in LEGAL)

    def ending(self, known: Counter) -> None:
        """Signature lines at the end of each stretch that the sender wrote."""
        names = self.names()
        own = [i for i in range(self.top, len(self.lines)) if self.kind[i] is None and self.lines[i].strip()]
        for i in own:
            if DEVICE.match(self.lines[i].strip()):
                self.kind[i] = "signature"
        # a signature stands where the own text ends: at the end of the message or before what is quoted
        last = [i for i in own if self.kind[i] is None]
        if not last:
            return
        stretches, start = [], 0
        for x in range(1, len(last) + 1):
            if x == len(last) or any(self.kind[k] == "quoted" for k in range(last[x - 1], last[x])):
                stretches.append(last[start:x])
                start = x
        for stretch in stretches:
            begin = None
            for x in range(len(stretch) - 1, -1, -1):
                t = self.lines[stretch[x]].strip()
                if not self._endlike(t):
                    break
                anchor = CLOSING.match(t) or MARK.match(t) or CONTACT.match(t) or self._signs(t, names) or begin == x + 1 and BARE_NAME.match(t) and CONTACT.match(self.lines[stretch[x + 1]].strip())
                if anchor or known[(self.sender, t)] > 1 and begin is not None:
                    begin = x
            if begin is not None:
                for k in stretch[begin:]:
                    self.kind[k] = "signature"

    def _endlike(self, t: str) -> bool:
        """Short and no sentence, or plainly an ending."""
        if CLOSING.match(t) or MARK.match(t):
            return True
        if GREETING.match(t) and t.endswith(","):
            return False
        return len(t) <= 110 and not (SENTENCE.search(t) and len(t.split()) > 6)


    def inherit(self, words: list[tuple[str, int]], sources: dict[int, str], counts: Counter) -> None:
        """Quotes what is inherited.

        ``sources`` has the inherited runs: the place of their first word among ``words``, and the sender of the message
        that they come from.
        """
        total = Counter(x for _, x in words)
        known: Counter = Counter()
        senders: dict[int, set[str]] = {}
        done = 0
        for at, whose in sorted(sources.items()):
            for k in range(max(done, at), at + RUN):
                known[words[k][1]] += 1
            done = at + RUN
            for line in (words[at][1], words[done - 1][1]):
                senders.setdefault(line, set()).add(whose)
        lines, kind = self.lines, self.kind
        taken = [i for i in sorted(total) if known[i] >= 0.8 * total[i]]
        for i in taken:
            if kind[i] == "quoted":
                self.how[i] = "inherited"
        # what no structure marks: stretches of inherited lines, with what stands between two of them
        free = [i for i in taken if kind[i] in (None, "disclaimer") and known[i] >= 0.9 * total[i]]
        blocks: list[list[int]] = []
        for i in free:
            between = [k for k in range(blocks[-1][-1] + 1, i) if lines[k].strip()] if blocks else []
            if blocks and all(kind[k] in (None, "disclaimer") for k in between) and len(between) <= 1:
                blocks[-1].append(i)
            else:
                blocks.append([i])
        for block in blocks:
            # the sender's own ending stands above the history and may come from their earlier messages
            while block and (kind[block[0]] == "disclaimer" or self._own_ending(block[0], senders.get(block[0], set()), counts)):
                block.pop(0)
            if sum(total[i] for i in block if kind[i] is None and not self._contact(i)) < RUN:
                continue  # an ending or a greeting that others quote too
            for k in range(block[0], block[-1] + 1):
                kind[k] = "quoted"
                self.how[k] = "inherited"
            k = block[0] - 1
            while k >= self.top and (kind[k] is None and (HEADER.match(lines[k]) or not lines[k].strip())):
                k -= 1
            if k >= self.top and kind[k] is None and (WROTE.match(lines[k]) or INTRODUCED.match(lines[k])):
                k -= 1
            while k + 1 < block[0] and not lines[k + 1].strip():
                k += 1
            for x in range(k + 1, block[0]):
                kind[x], self.how[x] = "quoted", "extended"

    def _own_ending(self, i: int, senders: set[str], counts: Counter) -> bool:
        t = self.lines[i].strip()
        return self._endlike(t) and (senders <= {self.sender} or counts[(self.sender, t)] > 1 or self._contact(i))

    def _contact(self, i: int) -> bool:
        t = self.lines[i].strip()
        return len(t) <= 110 and bool(CLOSING.match(t) or DEVICE.match(t) or CONTACT.match(t) or PHONE_LINE.search(t))

    def settle(self, words: list[tuple[str, int]], sources: dict[int, str], counts: Counter) -> None:
        """Marks the lines, with the inherited runs and how often the sender's last lines come again."""
        self.notices()
        self.inherit(words, sources, counts)
        self.ending(counts)
        lines, n = self.lines, len(self.lines)
        # a quoted stretch with an inherited line is extended by its structure; one without stands for itself
        i = 0
        while i < n:
            if self.kind[i] != "quoted":
                i += 1
                continue
            j = i
            while j < n and (self.kind[j] == "quoted" or not lines[j].strip()):
                j += 1
            reached = any(self.how[k] == "inherited" for k in range(i, j))
            for k in range(i, j):
                if self.kind[k] == "quoted" and self.how[k] is None:
                    self.how[k] = "extended" if reached else "structure"
            i = j


def judge(thread: list[Message]) -> Iterator[Message]:
    """Marks the messages of a thread."""
    words = [m.words() for m in thread]
    counts: Counter = Counter()
    for sender, _, t in {(m.sender, m.identity, t) for m in thread for t in m.last_lines()}:
        counts[(sender, t)] += 1
    if len(thread) < 2:
        for m, w in zip(thread, words):
            m.settle(w, {}, counts)
            yield m
        return
    auto = Automaton()
    for k, w in enumerate(words):
        auto.add([x for x, _ in w], k)
    auto.settle(RUN)
    own: dict[tuple, dict[int, int]] = {}  # where copies of one message have a run first
    runs = []
    for m, w in zip(thread, words):
        states = auto.runs([x for x, _ in w], RUN)
        runs.append(states)
        first = own.setdefault(m.identity, {})
        for at, state in enumerate(states):
            if at < first.get(state, NOWHERE):
                first[state] = at
    for m, w, states in zip(thread, words, runs):
        first = own[m.identity]
        sources = {at: thread[auto.end[s] & 0xFFFFFFFF].sender for at, s in enumerate(states) if (auto.end[s] >> 32) - RUN + 1 < first[s]}
        m.settle(w, sources, counts)
        yield m


def run_hashes(thread: str, words: list[str]) -> list[int]:
    """A hash of the thread and the run of RUN words from each word on."""
    return [int.from_bytes(hashlib.blake2b(" ".join([thread, *words[i : i + RUN]]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for i in range(len(words) - RUN + 1)]


def long_threads(src: DataFrame, batch: Callable, schema: str) -> DataFrame:
    """The labelled messages of threads of any length: the rows that ``judge`` gives, by shuffles instead of one automaton.

    What the automaton's states of runs know, where the run stands nearest to the top and in whose message, is an
    aggregate by run, and so is how often a sender's last lines come again.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = [(t, k, Message(k, x)) for t, k, x in zip(*(c.to_pylist() for c in b.slice(at, 200).columns))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([t for t, _, _ in rows], pa.string()), pa.array([k for _, k, _ in rows], pa.string()), pa.array(["\0".join(m.identity) for *_, m in rows], pa.string()), pa.array([m.sender for *_, m in rows], pa.string()),
                    pa.array([run_hashes(t, [w for w, _ in m.words()]) for t, _, m in rows], pa.list_(pa.int64())), pa.array([sorted(m.last_lines()) for *_, m in rows], pa.list_(pa.string())),
                ], ["thread", "key", "identity", "sender", "runs", "ends"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                done = []
                for k, text, starts, known in zip(*(c.to_pylist() for c in b.slice(at, 200).columns)):
                    m = Message(k, text)
                    m.settle(m.words(), {x["at"]: x["whose"] for x in starts or ()}, Counter({(m.sender, t): 2 for t in known or ()}))
                    done.append(m)
                yield batch(done)

    told = cut(src.select("thread", "key", "text").mapInArrow(describe, "thread string, key string, identity string, sender string, runs array<bigint>, ends array<string>"))
    runs = told.select("key", "identity", "sender", F.posexplode("runs").alias("at", "run"))
    first = runs.groupBy("run").agg(F.min(F.struct("at", "sender")).alias("first"))
    own = runs.groupBy("run", "identity").agg(F.min("at").alias("own"))
    old = own.join(first, "run").where(F.col("first.at") < F.col("own")).select("run", "identity", F.col("first.sender").alias("whose"))
    starts = runs.join(old, ["run", "identity"]).groupBy("key").agg(F.collect_list(F.struct("at", "whose")).alias("starts"))
    ends = told.select("thread", "key", "identity", "sender", F.explode("ends").alias("end"))
    again = ends.select("thread", "identity", "sender", "end").distinct().groupBy("thread", "sender", "end").agg(F.count("*").alias("n")).where("n > 1")
    known = ends.join(again, ["thread", "sender", "end"]).groupBy("key").agg(F.collect_list("end").alias("known"))
    return src.join(starts, "key", "left").join(known, "key", "left").select("key", "text", "starts", "known").mapInArrow(label, schema)


PHONE_LINE = re.compile(r"\d{3}.?\d{4}|\|| \d{5}\b|^\d+[a-z]? [A-Z]")


def label_lines(mails: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """``key``, lines (line_no from 1, kind, how) and new_text of each mail.

    kind is null for what the sender newly wrote, header for page lines and the message's own header, quoted, signature
    or disclaimer; how tells of a quoted line whether it is inherited from a message of the thread, extends such lines, or
    has only its own structure to tell; blank lines are left out of ``lines``.  new_text has the lines of null kind, with single blank lines
    between paragraphs.  Null texts are left out, an empty text has no lines and an empty new_text.  Rows of one key are
    taken as copies.  A mail without a subject is a thread of its own.
    """
    src = once(mails.select(mails[key].cast("string").alias("key"), mails[text].alias("text") if isinstance(text, str) else text.alias("text")).where("text is not null"), "key")
    subject = F.regexp_extract("text", r"(?m)^Subject:[ \t]*(.*)$", 1)
    bare = F.trim(F.regexp_replace(F.lower(subject), r"^(?:\s*(?:re|fw|fwd|aw|wg|tr)\s*(?:\[\d+\])?:)+", ""))
    src = src.select(F.when(bare == "", F.concat(F.lit("\u0000"), "key")).otherwise(bare).alias("thread"), "key", "text")
    line = pa.struct([("line_no", pa.int64()), ("kind", pa.string()), ("how", pa.string())])

    def batch(done: list[Message]) -> pa.RecordBatch:
        listed, fresh = [], []
        for m in done:
            listed.append([{"line_no": i + 1, "kind": k, "how": h} for i, (k, h, t) in enumerate(zip(m.kind, m.how, m.lines)) if t.strip()])
            own = "\n".join(t if k is None else "" for k, t in zip(m.kind, m.lines))
            fresh.append(re.sub(r"\n\s*\n+", "\n\n", own).strip())
        return pa.RecordBatch.from_arrays([pa.array([m.key for m in done], pa.string()), pa.array(listed, pa.list_(line)), pa.array(fresh, pa.string())], [key, "lines", "new_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, held, out = None, [], []
        for b in batches:
            for name, k, t in zip(*(c.to_pylist() for c in b.columns)):
                if name != thread:
                    out += judge(held)
                    thread, held = name, []
                held.append(Message(k, t))
                if len(out) > 2000:
                    yield batch(out)
                    out = []
        out += judge(held)
        yield batch(out)

    schema = f"`{key}` string, lines array<struct<line_no bigint, kind string, how string>>, new_text string"
    src = cut(src)
    long = cut(src.groupBy("thread").agg(F.count("*").alias("n")).where(F.col("n") > STRETCH).select("thread"))
    rest = src if long.isEmpty() else src.join(long, "thread", "left_anti")
    found = rest.select("thread", "key", "text").repartition("thread").sortWithinPartitions("thread", "key").mapInArrow(run, schema)
    return found if rest is src else found.unionByName(long_threads(src.join(long, "thread", "left_semi"), batch, schema))


def not_new(labelled: DataFrame, key: str = "document_id") -> DataFrame:
    """``key``, line_no and kind of the lines that the sender did not newly write."""
    one = labelled.select(key, F.explode("lines").alias("x")).select(key, "x.line_no", "x.kind")
    return one.where(F.col("kind").isin("quoted", "signature", "disclaimer"))
