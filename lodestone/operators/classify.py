"""Rule-based classification, tags, quality and structure of texts (TXT-01 to TXT-41).

All rules are plain column expressions.  Keyword rules look for parts of the lower-cased text, so a keyword also counts
within a longer word.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import contains_any, is_blank, strip, word_count

# The keywords of the classes and tags.
TYPES_A = {
    "academic": ("abstract", "methodology", "conclusion", "references"),
    "legal": ("whereas", "jurisdiction", "plaintiff", "defendant"),
    "financial": ("revenue", "profit", "financial", "investment"),
    "email": ("subject:", "from:", "to:", "dear"),
}
TYPES_B = {
    "academic": TYPES_A["academic"],
    "legal": ("agreement", "contract", "legal", "court"),
    "financial": TYPES_A["financial"],
    "technical": ("algorithm", "implementation", "architecture", "system"),
}
PERSUASION_A = {
    "authority": ("expert", "authority", "certified", "official"),
    "social_proof": ("popular", "majority", "everyone", "most people"),
    "urgency": ("urgent", "deadline", "limited time", "act now"),
}
PERSUASION_B = {
    "authority": ("proven", "expert", "authority", "research shows"),
    "scarcity": ("limited time", "exclusive", "rare", "only"),
    "social_proof": ("everyone", "most people", "popular", "trending"),
}
DOCUMENT_TYPES = (
    ("report", r"\breport\b"), ("article", r"\b(?:article|abstract)\b"), ("paper", r"\bpaper\b"),
    ("manual", r"\b(?:manual|guide)\b"), ("contract", r"\b(?:contract|agreement)\b"),
)
EMAIL_PATTERNS = ("From:.*@", "To:.*@", r"Sent:.*\d[:/]\d[:/]\d", "Subject:", "CC:", "BCC:", "Reply-To:")
ROOMS = ("room", "bedroom", "bathroom", "kitchen", "living", "dining", "office", "garage", "hall", "closet", "patio", "deck")
IMAGE_NAMES = {
    "chart": ("chart", "graph", "plot"), "diagram": ("diagram", "flow", "schema"),
    "floor_plan": ("plan", "blueprint", "layout"), "presentation_slide": ("slide", "presentation"),
}


def labels(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The labels of the rules that fit, in the order of the rules."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*(F.when(contains_any(low, terms), F.lit(name)) for name, terms in rules.items()))
    return F.filter(found, lambda x: x.isNotNull())


def content_types(types: Column, text: Column, rules: dict[str, tuple[str, ...]] = TYPES_A) -> Column:
    """TXT-01 and TXT-02: the given types and the labels that are not among them yet; an empty text adds none."""
    have = F.coalesce(types, F.array().cast("array<string>"))
    return F.concat(have, F.filter(labels(text, rules), lambda x: ~F.array_contains(have, x)))


def persuasion_a(tags: Column, text: Column) -> Column:
    """TXT-03: the given tags and all that fit, also if there already."""
    return F.concat(F.coalesce(tags, F.array().cast("array<string>")), labels(text, PERSUASION_A))


def persuasion_b(tags: Column, text: Column) -> Column:
    """TXT-04: the given tags and those that fit and are not there yet."""
    return content_types(tags, text, PERSUASION_B)


def _score(start: float, *steps: tuple[Column, float, str | None]) -> tuple[Column, Column]:
    score = F.lit(start)
    for when, change, _ in steps:
        score = score + F.when(when, change).otherwise(0.0)
    issues = F.array(*(F.when(when, F.lit(name)) for when, _, name in steps if name))
    return score, F.filter(issues, lambda x: x.isNotNull())


def quality_a(text: Column, failed: Column) -> tuple[Column, Column]:
    """TXT-05: score and issues; ``failed`` says whether the extraction did."""
    blank = is_blank(text)
    score, issues = _score(1.0, (blank, -0.5, "no_text_content"), (~blank & (F.length(text) < 100), -0.2, "very_short_content"), (F.coalesce(failed, F.lit(False)), -0.3, "extraction_error"))
    return F.round(F.greatest(score, F.lit(0.0)), 6), issues


def quality_b(text: Column, author: Column, created: Column) -> Column:
    """TXT-06: score within 0 and 1."""
    n = F.length(F.coalesce(text, F.lit("")))
    score, _ = _score(1.0, (n == 0, -0.5, None), ((n > 0) & (n < 100), -0.3, None), (n > 1000, 0.2, None), (F.coalesce(author != "", F.lit(False)), 0.1, None), (created.isNotNull(), 0.1, None))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def quality_c(text: Column, failed: Column) -> Column:
    """TXT-07: score of the quality hook, at least 0."""
    blank = is_blank(text)
    score, _ = _score(1.0, (F.coalesce(failed, F.lit(False)), -0.5, None), (blank, -0.3, None), (~blank & (F.length(text) < 50), -0.2, None))
    return F.round(F.greatest(score, F.lit(0.0)), 6)


def size_category(text: Column) -> Column:
    """TXT-08: short, medium or long by the number of words."""
    n = word_count(text)
    return F.when(n < 100, "short").when(n < 1000, "medium").otherwise("long")


def document_type(text: Column) -> Column:
    """TXT-12: the first type of which a word stands in the text, else generic."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(low.rlike(DOCUMENT_TYPES[0][1]), DOCUMENT_TYPES[0][0])
    for name, pattern in DOCUMENT_TYPES[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("generic")


def clean_text(text: Column) -> Column:
    """TXT-13: at most one blank line in a row, no white space at the ends."""
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def email_pattern_count(text: Column) -> Column:
    """TXT-10: how many of the seven patterns a text has; CC: also counts within BCC:."""
    t = F.coalesce(text, F.lit(""))
    return sum((t.rlike(p).cast("bigint") for p in EMAIL_PATTERNS), F.lit(0).cast("bigint"))


def presentation_signs(text: Column) -> Column:
    """TXT-11, the signs that text alone shows: under 100 words; more than 3 bullets or hyphens."""
    t = F.coalesce(text, F.lit(""))
    few = (word_count(t) < 100).cast("bigint")
    return few + ((F.regexp_count(t, F.lit("•")) > 3) | (F.regexp_count(t, F.lit("-")) > 3)).cast("bigint")


def has_document_pages(text: Column) -> Column:
    """TXT-09, the document sign: two paragraphs and five lines or more."""
    t = F.coalesce(text, F.lit(""))
    return (F.size(F.split(t, "\n[ \t]*\n")) >= 2) & (F.size(F.split(t, "\n")) >= 5)


def slide_title(slide: Column) -> tuple[Column, Column]:
    """TXT-14: title and body of a slide; a second short line that is no bullet belongs to the title."""
    lines = F.filter(F.transform(F.split(F.coalesce(slide, F.lit("")), "\n"), strip), lambda x: x != "")
    one, two = F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))
    titled = F.coalesce(F.length(one) < 80, F.lit(False))
    double = titled & F.coalesce((F.length(two) < 80) & ~two.rlike(r"^[•\-*]"), F.lit(False))
    title = F.when(double, F.concat_ws(" ", one, two)).when(titled, one).otherwise("")
    skip = F.when(double, 2).when(titled, 1).otherwise(0)
    body = F.when(F.size(lines) > skip, F.array_join(F.slice(lines, skip + 1, F.greatest(F.size(lines) - skip, F.lit(1))), "\n")).otherwise("")
    return title, body


#: White space of all scripts, as a class of characters.
WHITE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The forms of each header, and what separates the parts of a thread.
HEADERS = {"from": "From|From:", "to": "To|To:", "cc": "CC|Cc|CC:|Cc:", "subject": "Subject|Subject:", "date": "Date|Sent|Date:|Sent:"}
THREAD_MARKS = ("----+ ?Original Message ?----+", "----+ ?Forwarded Message ?----+", "On [^\n\ue000]* wrote:", "From:[^\n\ue000]*Sent:[^\n\ue000]*To:[^\n\ue000]*Subject:")


def email_fields(text: Column) -> dict[str, Column]:
    """TXT-16: the first hit of each header; the text behind the first blank line after the last of them, or all after it
    where none follows; and the parts of the thread that it has, null for one."""
    t = F.coalesce(text, F.lit(""))
    hit = {name: rf"(?:{forms})\s+([^\n]*?)\r?\n" for name, forms in HEADERS.items()}
    out = {name: strip(F.regexp_extract(t, p, 1)) for name, p in hit.items()}
    end = F.greatest(*(F.when(F.regexp_instr(t, F.lit(hit[n])) > 0, F.regexp_instr(t, F.lit(hit[n])) - 1 + F.length(F.regexp_extract(t, hit[n], 0))).otherwise(0) for n in ("from", "to", "subject", "date")))
    rest = F.substr(t, end + 1)
    blank = F.regexp_instr(rest, F.lit(r"\n\s*\n"))
    body = strip(F.when(end == 0, "").when(blank > 0, F.substr(rest, blank + F.length(F.regexp_extract(rest, r"\n\s*\n", 0)))).otherwise(rest))
    out["body"] = body
    for mark in THREAD_MARKS:
        body = F.regexp_replace(body, mark, "\ue000")
    parts = F.split(body, "\ue000")
    out["thread_parts"] = F.when(F.size(parts) > 1, parts)
    return out


def promoted_author(sender: Column, author: Column) -> Column:
    """TXT-17: the sender if that is an address, else the author."""
    return F.when(sender.contains("@"), sender).otherwise(author)


def image_type_by_name(name: Column) -> Column:
    """TXT-18, the rules by file name; general_image where pixels would have to tell."""
    low = F.lower(F.coalesce(name, F.lit("")))
    rules = list(IMAGE_NAMES.items())
    out = F.when(contains_any(low, rules[0][1]), rules[0][0])
    for kind, terms in rules[1:]:
        out = out.when(contains_any(low, terms), kind)
    return out.otherwise("general_image")


def image_type_by_text(text: Column) -> Column:
    """TXT-19: by words of the recognised text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(contains_any(low, ("chart", "graph")), "chart").when(contains_any(low, ("diagram", "flow")), "diagram").otherwise("general_image")


def chart_facts(text: Column) -> dict[str, Column]:
    """TXT-20: kind of chart, lines that label an axis, its first 20 numbers and its title."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    kind = F.when(contains_any(low, ("bar", "column")), "bar_chart").when(contains_any(low, ("pie", "donut")), "pie_chart").when(contains_any(low, ("line", "trend")), "line_chart").otherwise("unknown")
    lines = F.transform(F.split(t, "\n"), strip)
    axes = F.filter(lines, lambda x: contains_any(F.lower(x), ("axis", "x:", "y:")))
    titles = F.filter(lines, lambda x: F.length(x) > 10)
    return {"chart_kind": kind, "axes": axes, "numbers": F.slice(F.regexp_extract_all(t, F.lit(r"[0-9]+\.?[0-9]*"), F.lit(0)), 1, 20), "title": F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit(""))}


def diagram_facts(text: Column) -> dict[str, Column]:
    """TXT-21: kind of diagram, its first 20 components, and whether it has arrows."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    kind = F.when(contains_any(low, ("flow", "process", "step")), "flowchart").when(contains_any(low, ("architecture", "system", "component")), "architecture_diagram")
    kind = kind.when(contains_any(low, ("network", "node", "connection")), "network_diagram").otherwise("general_diagram")
    parts = F.slice(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: F.length(x) > 2), 1, 20)
    return {"diagram_kind": kind, "components": parts, "arrows": contains_any(t, ("->", "→"))}


def floor_plan_facts(text: Column) -> dict[str, Column]:
    """TXT-22: lines with rooms, up to ten measurements, and areas."""
    t = F.coalesce(text, F.lit(""))
    rooms = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: contains_any(F.lower(x), ROOMS))
    sizes = F.slice(F.regexp_extract_all(t, F.lit(r"""[0-9]+\.?[0-9]*['"\s]*x\s*[0-9]+\.?[0-9]*['"\s]*"""), F.lit(0)), 1, 10)
    return {"rooms": rooms, "measurements": sizes, "areas": F.regexp_extract_all(F.lower(t), F.lit(r"[0-9]+\.?[0-9]*\s*(?:sq\.?\s*ft\.?|square feet)"), F.lit(0))}


def structure_counts(text: Column) -> dict[str, Column]:
    """TXT-23: header-like lines among the first ten, heading-like lines, and slides."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n")
    return {
        "header_lines": F.size(F.filter(F.slice(lines, 1, 10), lambda x: x.contains(":"))).cast("bigint"),
        "short_lines": F.size(F.filter(lines, lambda x: (F.length(strip(x)) > 0) & (F.length(x) < 100))).cast("bigint"),
        "slides": F.regexp_count(t, F.lit("---")).cast("bigint") + 1,
    }


def valid_text(text: Column) -> Column:
    """TXT-30: ten characters or more, no archive bytes or escapes, no run of 20 that are neither printable ASCII nor white space, and mostly printable."""
    t = F.coalesce(text, F.lit(""))
    junk = t.contains("PK\x03\x04") | t.rlike(r"\\u[0-9a-fA-F]{4}") | t.rlike(rf"[^\x20-\x7E{WHITE}]{{20}}")
    odd = F.length(t) - F.length(F.regexp_replace(t, rf"[\p{{C}}&&[^{WHITE}]]", ""))
    return (F.length(strip(t)) >= 10) & ~junk & (F.length(t) - odd >= 0.7 * F.length(t))


def info_sheet(text: Column, *names: str) -> dict[str, Column]:
    """TXT-40: the values of ``names`` on an information sheet of name: value lines; null where one is missing."""
    return {n: F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?:^|\n){n}:[ \t]*([^\n]*)", 1)), F.lit("")) for n in names}


def merge_extractions(plain: Column, vision: Column, confidence: Column, types: Column, vision_type: Column) -> dict[str, Column]:
    """TXT-41: text, text_source and types of two extractions of one document.

    The vision model's text counts alone if it is longer by a fifth, and goes before the other if it has over 100
    characters; its type counts alone if its confidence is over 0.7, else all types do, by name.
    """
    p, v = F.coalesce(plain, F.lit("")), F.coalesce(vision, F.lit(""))
    kind = F.coalesce(vision_type, F.lit("mixed"))
    better = F.length(v) > 1.2 * F.length(p)
    source = F.when(better, "vlm_enhanced").when(F.length(v) > 100, "hybrid").otherwise("traditional")
    text = F.when(better, v).when(F.length(v) > 100, F.concat(v, F.lit("\n\n--- Traditional Fallback ---\n\n"), p)).otherwise(p)
    every = F.array_sort(F.array_distinct(F.concat(F.array(kind), F.coalesce(types, F.array().cast("array<string>")))))
    return {"text": text, "text_source": source, "types": F.when(F.coalesce(confidence, F.lit(0.0)) > 0.7, F.array(kind)).otherwise(every)}


def slides_of_pages(pages: Column) -> tuple[Column, Column]:
    """TXT-15: the text of a presentation whose pages are slides, each under its mark, and an array of number, title and content."""
    mark = lambda i: F.concat(F.lit("\n\n--- SLIDE "), (i + 1).cast("string"), F.lit(" ---\n\n"))
    text = F.array_join(F.transform(pages, lambda p, i: F.concat(mark(i), p)), "")

    def slide(p: Column, i: Column) -> Column:
        title, body = slide_title(p)
        return F.struct((i + 1).alias("slide_num"), title.alias("title"), body.alias("content"))

    return text, F.transform(pages, slide)
