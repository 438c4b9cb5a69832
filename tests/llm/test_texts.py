import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import mail, personal, scans, split


# --- splitting ------------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", ". ", "! ", " ", "\n", "\n\n", "\r\n", "\r\n\r\n", "x" * 70, "sentence here", "\t"]), max_size=120), st.integers(20, 60), st.integers(0, 10))
def test_pieces_fit_and_cover(parts, limit, overlap):
    t = "".join(parts)
    boundary, found = split.pieces(t, limit, overlap)
    assert all(0 < e - a <= limit or not t for a, e, _ in found)
    assert (boundary is None) == (len(t) <= limit)
    at = 0
    for a, e, o in found:
        assert a >= at - overlap and not t[at:a].strip() and o <= overlap and e > at or not t
        at = e
    assert not t[at:].strip()
    if boundary:
        paragraphs = [p.strip(" \t\r\n") for p in re.split(r"\n[ \t]*\n", t.replace("\r\n", "\n").replace("\r", "\n"))]
        raw = split.cuts(t, 0, len(t), split.BLANK_LINE)
        sentences = [(x, y) for a, b in raw for x, y in split.cuts(t, a, b, split.SENTENCE_END)]
        longest = lambda c: max((b - a for a, b in c), default=0)
        want = "paragraph" if longest(raw) <= limit else "sentence" if longest(sentences) <= limit else "word" if max(map(len, t.split())) <= limit else "char"
        assert boundary == want and len(raw) == len([p for p in paragraphs if p])


def test_weak_boundaries_merge_first():
    t = "One two three. Four five six.\n\nSeven eight nine. Ten."
    assert [t[a:e] for a, e, _ in split.pieces(t, 32, 0)[1]] == ["One two three. Four five six.", "Seven eight nine. Ten."]


def test_splitting_tables(spark):
    df = spark.createDataFrame([("a", "x" * 1200), ("a", "x" * 1200), ("b", None), ("c", ""), ("d", " " * 600), (None, "y")], "id string, t string").withColumns({"item_id": F.lit(1), "piece": F.lit(2), "text": F.lit(3)})
    out = split.split_texts(df, "id", "t").collect()
    assert sorted(len(r.piece) for r in out if r.item_id == "a") == [450 if i else 300 for i in range(3)] or all(len(r.piece) <= 500 for r in out if r.piece)
    assert {r.item_id for r in out} == {"a", "c", "d"}
    assert {tuple(r) for r in split.boundaries(split.split_texts(df, "id", "t")).collect()} == {("a", "char"), ("d", "paragraph")}


# --- e-mails --------------------------------------------------------------------------------------------------------
MAIL = """=== Page 1 ===
From: Mia Berg <mberg@x.example>
Sent: 1/24/2020 9:00
To: Tom Ode
Subject: RE: Budget

CAUTION: this e-mail came from outside the organisation. Do not open links.

Hi Tom,

> 40 percent of the sites would miss it.
-- and that is the whole story.

Best regards,
Mia Berg
Counsel
Tel. 020 7946 0000

This message and any attachment are intended only for the addressee and no
liability is accepted for errors in its contents.

On January 23, 2020, at 17:35, Tom Ode
wrote:
> Hello Mia
|
> See below.

I answer here.

> Bye"""


def kinds(text, *others):
    thread = [mail.Message(str(i), t) for i, t in enumerate([*others, text])]
    done = {m.key: m for m in mail.judge(thread)}
    m = done[str(len(others))]
    return {i + 1: k for i, k in enumerate(m.kind) if m.lines[i].strip()}


def test_lines_of_a_mail():
    k = kinds(MAIL)
    assert [i for i, x in k.items() if x is None] == [9, 11, 12, 28]
    assert [i for i, x in k.items() if x == "signature"] == [14, 15, 16, 17]
    assert [i for i, x in k.items() if x == "disclaimer"] == [7, 19, 20]
    assert [i for i, x in k.items() if x == "quoted"] == [22, 23, 24, 25, 26, 30]


def test_all_of_an_introduced_message_is_quoted():
    for mark in ("-----Original Message-----", "---------- Forwarded message ----------", "_" * 32, None):
        t = "From: a@b.c\nSent: 1/1/2020 1:00\nSubject: x\n\nNew words here.\n\n" + (f"{mark}\n" if mark else "") + "From: Tom\nSent: January 1, 2020 0:30\nTo: A\n\nOld.\n\nTom"
        assert [v for v in kinds(t).values() if v is None] == [None]


def test_unmarked_history_is_inherited_whatever_its_wrapping():
    old = "From: t@x.y\nSent: 1/1/2020 1:00\nSubject: x\n\n" + "the quick brown fox jumps over the lazy dog and then goes home to sleep for a week"
    new = "From: m@x.y\nSent: 1/2/2020 1:00\nSubject: Re: x\n\nI agree with all of what you say there.\n\nthe quick brown fox jumps over the lazy dog and then\ngoes home to sleep for a week"
    k = kinds(new, old)
    assert k[5] is None and k[7] == "quoted"
    assert all(v is None for i, v in kinds(old, new).items() if i > 3 or v is None) or kinds(old)[5] is None


def test_history_wrapped_at_twenty_columns_with_short_lines_and_numbers_is_inherited():
    words = "call me on 555 0170 today and the quick brown fox jumps over the lazy dog, then 12 Oak Street and home to sleep".split()
    old = "From: t@x.y\nSent: 1/1/2020 1:00\nSubject: x\n\n" + " ".join(words)
    wrapped = "\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3))
    new = f"From: m@x.y\nSent: 1/2/2020 1:00\nSubject: Re: x\n\nI agree with all of what you say there.\n\n{wrapped}\n\nMy last word on it."
    k = kinds(new, old)
    assert k[5] is None and {v for i, v in k.items() if 7 <= i <= 14} == {"quoted"} and k[max(k)] is None


def test_automaton_finds_most_quoted_lines(monkeypatch):
    """Without the automaton, history that carries no marks is taken as newly written."""
    say = lambda i: f"Person {i} begins here with number {i}.\n" + "\n".join(f"Then {w} number {i} of the group goes on about {w} for a while" for w in ("alpha", "beta", "gamma", "delta"))
    texts, history = [], ""
    for i in range(6):
        texts.append(f"From: p{i}@x.y\nSent: 1/{i + 1}/2020 1:00\nSubject: x\n\n{say(i)}\n{history}")
        history = say(i) + "\n\n" + history

    def quoted():
        return sum(k == "quoted" for m in mail.judge([mail.Message(str(i), t) for i, t in enumerate(texts)]) for k in m.kind)

    with_it = quoted()
    monkeypatch.setattr(mail.Automaton, "runs", lambda self, words, least: [])
    assert with_it >= 5 * sum(range(6)) and quoted() == 0


def test_most_quoted_lines_of_the_table_come_from_the_automaton(spark, folder):
    from lodestone.llm import catalog

    hows = [x.how for r in catalog._mail(spark, folder).collect() for x in r.lines if x.kind == "quoted"]
    assert hows.count("structure") < 0.5 * len(hows) and hows.count("inherited") > 0.25 * len(hows)


def test_clocks_do_not_matter():
    """A mail that quotes one with a later time is the one that quotes."""
    old = "From: t@x.y\nSent: 1/1/2020 9:00\nSubject: x\n\n" + "the quick brown fox jumps over the lazy dog and then goes home to sleep for a week"
    new = "From: m@x.y\nSent: 1/1/2020 1:00\nSubject: Re: x\n\nI agree with all of what you say there.\n\nthe quick brown fox jumps over the lazy dog and then\ngoes home to sleep for a week"
    assert kinds(new, old)[7] == "quoted" and kinds(old, new)[5] is None


def test_suffix_automaton_finds_runs():
    texts = ["a b c d e f".split(), "x c d e y".split(), "c d e f a b c d e".split()]
    a = mail.Automaton()
    for i, t in enumerate(texts):
        a.add(t, i)
    a.settle(3)
    for t in texts:
        for at, state in enumerate(a.runs(t, 3)):
            run = t[at : at + 3]
            assert (a.end[state] >> 32, a.end[state] & 0xFFFFFFFF) == min((k + 2, n) for n, u in enumerate(texts) for k in range(len(u) - 2) if u[k : k + 3] == run)
    assert a.runs([], 3) == []


def test_mail_tables(spark):
    df = spark.createDataFrame([("1", MAIL), ("1", MAIL), ("2", None), ("3", ""), (None, "x"), ("4", "no header at all")], "document_id string, text string").withColumns({"lines": F.lit(1), "thread": F.lit(2), "key": F.lit(3)})
    out = {r.document_id: r for r in mail.label_lines(df).collect()}
    assert set(out) == {"1", "3", "4"} and out["3"].new_text == "" and out["4"].new_text == "no header at all"
    assert out["1"].new_text.endswith("I answer here.") and "Counsel" not in out["1"].new_text
    assert mail.label_lines(df.limit(0)).count() == 0


def test_long_threads_go_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(mail, "STRETCH", 5)
    rows = [(f"{i:02d}", f"From: p{i}@x.y\nSent: 1/{i + 1}/2020 1:00\nSubject: same\n\nText number {i} of the thread.") for i in range(23)]
    out = mail.label_lines(spark.createDataFrame(rows, "document_id string, text string")).collect()
    assert len(out) == 23 and len({r.document_id for r in out}) == 23


# --- personal data --------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def finder():
    return personal.Finder(frozenset({"mia", "tom", "ada"}), frozenset({"berg", "ode-vey", "lund"}))


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("write to mia.berg+x@post.example.net.", [("email", "mia.berg+x@post.example.net")]),
        ("<tom@ x.example>, ada(at)x.example, ada AT x.example", [("email", "tom@ x.example"), ("email", "ada(at)x.example"), ("email", "ada AT x.example")]),
        ("IBAN: DE89 3704 0044 0532 0130 00 and IBAN DE88 AAAA BBBB CCCC D", [("id_number", "DE89 3704 0044 0532 0130 00")]),
        ("write jane.doe at example dot com or jane(at)example [dot] org; look at that dot", [("email", "jane.doe at example dot com"), ("email", "jane(at)example [dot] org")]),
        (f"{'x' * 90}@y.example", [("email", f"{'x' * 90}@y.example")]),
        ("12 cartons @ USD 59 were forec@st.", []),
        ("Tel. +49 30 23125 647, (483) 555-0170 or 020 7946 0443", [("phone", "+49 30 23125 647"), ("phone", "(483) 555-0170"), ("phone", "020 7946 0443")]),
        ("lot 205.470.1356/B, Order 2011-28-2690, 4/2/2019 18:05", []),
        ("call 718 555-0157 ext. 822 now", [("phone", "718 555-0157 ext. 822")]),
        ("SSN: 000-07-6246 for her; passport\nno. ZZ5031773; NI number QQ 38 86 73 A and", [("id_number", "000-07-6246"), ("id_number", "ZZ5031773"), ("id_number", "QQ 38 86 73 A")]),
        ("sent to 457 Upper Marrow Way, Apt 3B, Norcastle, OH 00681 in May", [("street_address", "457 Upper Marrow Way, Apt 3B, Norcastle, OH 00681")]),
        ("at Am Ostwall 65, 00245 Norcastle.", [("street_address", "Am Ostwall 65, 00245 Norcastle")]),
        ("booked for the Fifth Orchard Street", []),
        ("Dr. Berg and A. B. Lund met Mia T. Berg, Ode-Vey, Tom; hello Ada,", [("person_name", "Berg"), ("person_name", "A. B. Lund"), ("person_name", "Mia T. Berg"), ("person_name", "Ode-Vey, Tom"), ("person_name", "Ada")]),
        ("TOM LUND of Lund Consulting wrote tom.lund@x.example", [("person_name", "TOM LUND"), ("email", "tom.lund@x.example")]),
        ("Mia\n> Berg", [("person_name", "Mia\n> Berg")]),
        ("", []),
    ],
)
def test_items(finder, text, items):
    assert [(k, text[a:b]) for a, b, k in finder.find(text)] == items


def test_names_are_learned_from_their_forms(spark):
    rows = ["Berg, Mia", "Mia Berg", "M. Berg", "Berg, M.", "Big Foods", "Big Foods", "Big Foods", None, "", "Tom Berg; Tom A. Berg"]
    df = spark.createDataFrame([(r,) for r in rows], "author string")
    got = {(r.name, r.role) for r in personal.learn_names(personal.people_segments((df, F.col("author")))).collect()}
    assert got == {("berg", "last"), ("mia", "first"), ("tom", "first")}


def test_personal_tables(spark):
    names = spark.createDataFrame([("berg", "last", 3), ("mia", "first", 3)], "name string, role string, n long")
    df = spark.createDataFrame([("1", "f", "Ask Mia Berg <m@x.example>."), ("2", "f", None), ("3", "f", "")], "record_id string, field string, text string").withColumns({"kind": F.lit(1), "found": F.lit(2)})
    out = {r.record_id: r for r in personal.scan(df, names).collect()}
    assert out["1"].redacted == "Ask [PERSON_NAME] <[EMAIL]>." and out["2"].redacted is None and out["3"].redacted == ""
    assert {(r.kind, r.start_char) for r in personal.items(personal.scan(df, names)).collect()} == {("person_name", 5), ("email", 15)}
    assert personal.scan(df.limit(0), names.limit(0)).count() == 0


def test_large_lexicons_lose_no_name(spark, monkeypatch):
    lexicon = [("mia", "first", 9), ("berg", "last", 9), ("lund", "last", 2), ("ode-vey", "last", 2), ("o'dea", "last", 2), ("strauß", "last", 2), ("passport", "last", 2)]
    names = spark.createDataFrame(lexicon, "name string, role string, n long")
    texts = [
        "Mia Lund met LUND, Mia, and (Ode-Vey's) M. O'Dea-Berg.", "Mia Lund met LUND, Mia, and (Ode-Vey's) M. O'Dea-Berg.", "ask Mia Od-\ndy and Mia Lu-\n> nd; Lund@x, xLund, STRAUSS",
        "Passport number 1234567 of Lund", "-Passport number: 1234567; e\u0301Lund", "Lundgren", "", None,
    ]
    df = spark.createDataFrame([(str(i), "f", t) for i, t in enumerate(texts)], "record_id string, field string, text string")
    want = sorted((tuple(r) for r in personal.scan(df, names).collect()), key=str)
    for most in (0, 1, 3):
        monkeypatch.setattr(personal, "MOST_NAMES", most)
        assert sorted((tuple(r) for r in personal.scan(df, names).collect()), key=str) == want
    assert sum(len(r[2] or ()) for r in want) > 12 and any(f.kind == "id_number" for r in want for f in r[2] or ())


# --- scans ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reader():
    counts = {w: 500 for w in "the clinical review market explained revised schedule number operational line transport council northern long term long-term follow-up follow up".split()}
    counts |= {"rare": 1, "follow": 60, "up": 900}
    return scans.Reader(scans.Lexicon(counts, [], *[scans.np.zeros((0, 4))] * 2))


def test_findings(reader):
    text = "\n".join(
        f"=== Page {n} ===\n{h}\nthe clinica1 review exp-\nlained the long-\nterm marke­\nt\n\n{n + 6}" if n < 3 else f"=== Page {n} ===\n{h}\nthe review of {n}\n2012\n\n{n + 6}"
        for n, h in enumerate(["Council Review 12-5", "Counci1 Revievv 12-5", "Council Review 12-5", "Council Review 12-5"], 1)
    )
    found, repaired = reader.read(text)
    by = {}
    for p, k in found:
        by.setdefault(k, []).append(p)
    assert by == {"hyphen_break": [1, 2], "misread": [1, 2], "page_number": [1, 2, 3, 4], "running_header": [1, 2, 3, 4]}
    assert repaired.startswith("the clinical review explained the long-term market") and "Council" not in repaired and "2012" in repaired


@pytest.mark.parametrize(("token", "fixed"), [("clinica1", "clinical"), ("Operafiorial,", "Operational,"), ("coiincil", "council"), ("riurnber", "number"), ("xylophone", None), ("(ouncil", "council"), ("(council", None), ("rare", None), ("7th", None)])
def test_misreadings(reader, token, fixed):
    assert reader.fix(token, []) == fixed


def test_context_chooses_accepts_and_rejects(spark):
    """Trained on a small corpus: one wrong word with two right ones, and a word that is a misreading of another only in its place."""
    lines = ["the sour lemon is on the tree"] * 60 + ["we rode by car to the far town"] * 60 + ["black tar covers hot roads"] * 60
    lines += ["they eat warm bread at noon"] * 60 + ["the small cat sleeps on warm mats"] * 60
    text = "\n\n".join(f"{x} {n}x{n}" for n, x in enumerate(lines))
    model = scans.learn(spark.createDataFrame([(text,)], "text string"))
    lex = scans.Lexicon(*model)
    # cat is a misreading of eat beside "they" and "warm bread", not beside "small" and "sleeps"
    odds = [lex.odds("cat", "eat", lex.near(a.split())) for a in ("they warm bread", "the small sleeps on")]
    assert odds[0] > 0 > odds[1]
    assert lex.choose(("tar", "far"), lex.near("black covers hot".split())) == "tar" and lex.choose(("tar", "far"), lex.near("to the town".split())) == "far"


def test_text_above_the_first_page_line_is_of_that_page():
    assert [n for n, _ in scans.pages("head\n=== Page 1 ===\nx\n=== Page 2 ===\ny")] == [1, 2]


def test_form_feeds_roman_numbers_and_sides(reader):
    text = "\f".join(["Exhibit of the council    ii\nthe review\n", "iii    Exhibit of the council\nthe market\n", "Exhibit of the council    iv\nthe line\n"])
    found, _ = reader.read(text)
    assert found == [(p, k) for p in (1, 2, 3) for k in ("page_number", "running_header")]


def test_one_page_has_no_furniture(reader):
    assert reader.read("the review\n\n1") == ([], "the review\n\n1")


def test_vectors_put_words_of_like_neighbours_together():
    pairs = scans.np.zeros((4, 4))
    pairs[0, 2] = pairs[2, 0] = pairs[1, 2] = pairs[2, 1] = 50
    pairs[3, 3] = 40
    w, _ = scans.train(pairs, 4, dim=4)
    cos = lambda a, b: a @ b / scans.np.linalg.norm(a) / scans.np.linalg.norm(b)
    assert cos(w[0], w[1]) > cos(w[0], w[3])


def test_scan_tables(spark):
    df = spark.createDataFrame([("1", "the cat sat\n" * 9), ("1", "the cat sat\n" * 9), ("2", None), ("3", ""), (None, "x")], "record_id string, text string").withColumns({"found": F.lit(1), "word": F.lit(2)})
    out = {r.record_id: r for r in scans.repair(df).collect()}
    assert set(out) == {"1", "3"} and out["3"].text == "" and out["1"].found == []
    assert scans.repair(df.limit(0)).count() == 0


def test_context_judges_words_that_are_misreadings(spark):
    import random

    rng = random.Random(5)
    homes, wires = "house garden kitchen window family street".split(), "cable network signal speed router server".split()
    about = lambda word, of: " ".join([*rng.sample(of, 2), word, *rng.sample(of, 2)])
    rows = [(f"h{i}", about("modern", homes)) for i in range(300)] + [(f"w{i}", about("modem", wires)) for i in range(300)]
    rows += [("wrong", "house garden modem family window"), ("right", "cable network modem speed signal")]
    out = {r.record_id: r for r in scans.repair(spark.createDataFrame(rows, "record_id string, text string")).collect()}
    assert [tuple(f) for f in out["wrong"].found] == [(1, "misread")] and out["wrong"].text == "house garden modern family window"
    assert out["right"].found == []
    assert not any(r.found for k, r in out.items() if k != "wrong")


def test_copies_do_not_make_a_misreading_frequent(spark):
    import random

    rng = random.Random(7)
    words = "house garden kitchen window family street cable network signal speed router server".split()
    rows = [(f"r{i}", " ".join([*rng.sample(words, 5), "clinical", *rng.sample(words, 5)])) for i in range(200)]
    page = "house signal cable garden window speed clinica1 router family house server network"
    rows += [(f"c{i}", f"{page.replace(' ', chr(10), i % 4)}\nunder number q{i}") for i in range(100)]
    out = {r.record_id: r for r in scans.repair(spark.createDataFrame(rows, "record_id string, text string")).collect()}
    assert all((1, "misread") in [tuple(f) for f in out[f"c{i}"].found] and "speed clinical router" in out[f"c{i}"].text for i in range(100))
    assert not any(out[f"r{i}"].found for i in range(200))


def test_stretches_have_each_word_and_pair_once():
    words = [f"w{i * i % 37}" for i in range(300)]
    cut = [(h.split(), b.split()) for h, b in scans.stretches_of(words)]
    assert [w for _, b in cut for w in b] == words and cut[0][0] == []
    assert all(h == a[-scans.WINDOW :] for (h, _), (_, a) in zip(cut[1:], cut))
    assert list(scans.stretches_of([])) == []


def test_long_threads_are_compared_whole(spark, monkeypatch):
    old = "the quick brown fox jumps over the lazy dog and then goes home to sleep for a week"
    bodies = [f"Message {i} says something of its own here." for i in range(40)]
    bodies[0], bodies[33] = old, f"I agree with all of that.\n\n{old}\n\nBest,\nP"
    # the keys run against the time
    rows = [(f"{99 - i:02d}", f"From: p{i % 3}@x.y\nSent: 1/{i % 28 + 1}/{2020 + i // 28} 1:00\nSubject: Re: same\n\n{t}\nThe team") for i, t in enumerate(bodies)]
    df = spark.createDataFrame(rows, "document_id string, text string")
    whole = {r.document_id: (r.lines, r.new_text) for r in mail.label_lines(df).collect()}
    monkeypatch.setattr(mail, "STRETCH", 5)
    assert {r.document_id: (r.lines, r.new_text) for r in mail.label_lines(df).collect()} == whole
    assert whole["66"][1].startswith("I agree") and "fox" not in whole["66"][1] and "fox" in whole["99"][1]
