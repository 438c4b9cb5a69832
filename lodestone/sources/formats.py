"""Text out of file formats (SRC-15, SRC-22 to SRC-34), and the registry of extractors (UDF-01 to UDF-05).

An extractor is a function from bytes to (text, method, errors).  Those for plain text, markup, JSON, CSV and the zipped XML
of office files are here; for PDFs and images plug-ins are registered, as their libraries are not part of the package.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.json import flat_rows

Extractor = Callable[[bytes], tuple[str, str, list[str]]]
Hook = Callable[[DataFrame], DataFrame]
STAGES = ("pre_process", "post_extract", "post_chunk", "post_classify")
NAME = re.compile(r"\{[^}]*\}")


def decoded(raw: bytes) -> tuple[str, str]:
    """SRC-31: the text as UTF-8, else as Latin-1, which reads everything."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("latin-1"), "latin-1"


def plain(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC-32."""
    text, coding = decoded(raw)
    return text, f"text_{coding}", []


def markup(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC-34: as it is; the method tells whether there are tags."""
    text, _ = decoded(raw)
    return text, "markup_tags" if "<" in text and ">" in text else "markup_plain", []


def json_text(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC-33: one line for each leaf; text that isn't JSON stays as it is, with an error."""
    text, _ = decoded(raw)
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        return text, "json_raw", [f"invalid JSON: {e}"]
    return "\n".join(f"{p}: {v}" for p, v in flat_rows(value)), "json", []


def csv_rows(raw: bytes) -> tuple[list[list[str]], str]:
    """SRC-24: the rows, and the delimiter that the first 1024 characters show."""
    text, _ = decoded(raw)
    try:
        delimiter = csv.Sniffer().sniff(text[:1024], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    return list(csv.reader(io.StringIO(text), delimiter=delimiter)), delimiter


def csv_text(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC-24, SRC-26: rows as lines, cells joined by tabs."""
    try:
        rows, _ = csv_rows(raw)
    except csv.Error as e:
        return "", "csv", [f"invalid CSV: {e}"]
    return "\n".join("\t".join(r) for r in rows), "csv", []


def csv_first(raw: bytes, most: int = 100) -> tuple[str, int, int]:
    """SRC-26: the first ``most`` rows as lines of tab-separated cells; how many rows there are, and columns in the first."""
    rows = list(csv.reader(io.StringIO(decoded(raw)[0])))
    return "\n".join("\t".join(r) for r in rows[:most]), len(rows), len(rows[0]) if rows else 0


def csv_profile(raw: bytes, name: str, preview: int = 100) -> dict:
    """SRC-25: text with head and preview, counts of rows and columns, headers, and how many cells of each column are filled.

    The first line is the header; rows that are shorter lack their last cells.  No rows give a rate of 0.
    """
    reader = csv.DictReader(decoded(raw)[0].splitlines())
    heads = list(reader.fieldnames or [])
    rows = list(reader)
    out = [f"CSV File: {name}", f"Headers: {', '.join(heads)}", f"Total Rows: {len(rows)}", "\n=== DATA PREVIEW ==="]
    if heads:
        out += [" | ".join(heads), "-" * len(" | ".join(heads))]
    out += [" | ".join(str(r.get(h, "")) for h in heads) for r in rows[:preview]]
    if len(rows) > preview:
        out.append(f"\n... ({len(rows) - preview} more rows)")
    filled = {h: sum(1 for r in rows if (r.get(h) or "").strip()) for h in heads}
    return {
        "text": "\n".join(out), "row_count": len(rows), "column_count": len(heads), "headers": heads,
        "filled": filled, "fill_rate": {h: n / len(rows) if rows else 0.0 for h, n in filled.items()},
    }


def _core(raw: bytes) -> dict[str, str]:
    """The core properties of an office file by name."""
    return {NAME.sub("", e.tag): (e.text or "").strip() for _, root in _parts(raw, r"docProps/core\.xml") for e in root}


def word_facts(raw: bytes) -> dict:
    """SRC-27: paragraphs and then tables (cells joined by bars) as text, author, time of creation, and counts of paragraphs, tables and words."""
    paragraphs, tables = [], []
    for _, root in _parts(raw, r"word/document\.xml"):
        body = next((e for e in root.iter() if NAME.sub("", e.tag) == "body"), root)
        for e in body:
            kind = NAME.sub("", e.tag)
            if kind == "p" and _texts(e, "t").strip():
                paragraphs.append(_texts(e, "t"))
            elif kind == "tbl":
                rows = [[_texts(c, "t").strip() for c in r if NAME.sub("", c.tag) == "tc"] for r in e if NAME.sub("", r.tag) == "tr"]
                tables.append("\n".join(" | ".join(r) for r in rows))
    text, core = "\n".join(paragraphs + tables), _core(raw)
    return {"text": text, "author": core.get("creator", ""), "created": core.get("created", ""), "paragraphs": len(paragraphs), "tables": len(tables), "word_count": len(text.split())}


def slides_facts(raw: bytes) -> list[dict]:
    """SRC-28, AG-27: number, text, notes, shapes, images, charts and length of each slide."""
    notes = {re.findall(r"\d+", n)[0]: root for n, root in _parts(raw, r"ppt/notesSlides/notesSlide\d+\.xml")}
    out = []
    for n, (name, root) in enumerate(_parts(raw, r"ppt/slides/slide\d+\.xml"), 1):
        tags = [NAME.sub("", e.tag) for e in root.iter()]
        lines = [t for p in root.iter() if NAME.sub("", p.tag) == "p" and (t := _texts(p, "t")).strip()]
        own = notes.get(re.findall(r"\d+", name)[0])
        said = "" if own is None else "\n".join(t for p in own.iter() if NAME.sub("", p.tag) == "p" and (t := _texts(p, "t")).strip())
        lines += [f"\n[Notes: {said}]"] if said else []
        out.append({
            "slide_number": n, "text": "\n".join(lines), "notes": said, "shapes_count": sum(tags.count(t) for t in ("sp", "pic", "graphicFrame", "cxnSp", "grpSp")),
            "has_image": "pic" in tags, "has_chart": "chart" in tags, "text_length": sum(map(len, lines)),
        })
    return out


def sheet_facts(raw: bytes, head: int = 5) -> list[dict]:
    """SRC-23: name, rows and columns of each sheet, its first ``head`` rows, and of its columns of numbers count, minimum, maximum and mean."""
    sheets: dict[str, list[list[str]]] = {}
    for name, cells in sheet_rows(raw):
        sheets.setdefault(name, []).append(cells)
    out = []
    for name, rows in sheets.items():
        width = max(map(len, rows))
        heads = [*rows[0], *[""] * (width - len(rows[0]))]
        stats = {}
        for k, h in enumerate(heads):
            numbers = [v for r in rows[1:] if k < len(r) and (v := as_number(r[k])) is not None]
            if numbers:
                stats[h or f"column {k + 1}"] = {"count": len(numbers), "min": min(numbers), "max": max(numbers), "mean": sum(numbers) / len(numbers)}
        out.append({"name": name, "rows": len(rows), "columns": width, "head": rows[:head], "stats": stats})
    return out


def as_number(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def _parts(raw: bytes, pattern: str) -> list[tuple[str, ET.Element]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        names.sort(key=lambda n: [int(d) for d in re.findall(r"\d+", n)] or [0])
        return [(n, ET.fromstring(z.read(n))) for n in names]


def _texts(node: ET.Element, tag: str) -> str:
    return "".join(e.text or "" for e in node.iter() if NAME.sub("", e.tag) == tag)


def word_text(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC-27: the paragraphs of a docx that aren't blank."""
    out = [t for _, root in _parts(raw, r"word/document\.xml") for p in root.iter() if NAME.sub("", p.tag) == "p" and (t := _texts(p, "t")).strip()]
    return "\n".join(out), "docx", []


def slides_text(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC-28: the paragraphs of each slide of a pptx under its mark."""
    out = []
    for n, (_, root) in enumerate(_parts(raw, r"ppt/slides/slide\d+\.xml"), 1):
        lines = [t for p in root.iter() if NAME.sub("", p.tag) == "p" and (t := _texts(p, "t")).strip()]
        out.append("\n".join([f"=== SLIDE {n} ===", *lines]))
    return "\n\n".join(out), "pptx", []


def sheet_rows(raw: bytes) -> Iterator[tuple[str, list[str]]]:
    """SRC-22, SRC-23: name of the sheet and cells of each row of an xlsx; cells that are left out are empty."""
    shared = [_texts(si, "t") for _, root in _parts(raw, r"xl/sharedStrings\.xml") for si in root]
    names = [s.attrib.get("name", "") for _, root in _parts(raw, r"xl/workbook\.xml") for s in root.iter() if NAME.sub("", s.tag) == "sheet"]
    for k, (_, root) in enumerate(_parts(raw, r"xl/worksheets/sheet\d+\.xml")):
        for row in (e for e in root.iter() if NAME.sub("", e.tag) == "row"):
            cells: list[str] = []
            for c in row:
                place = 0
                for ch in re.match(r"[A-Z]*", c.attrib.get("r", "")).group():
                    place = place * 26 + ord(ch) - 64
                cells += [""] * max(0, place - 1 - len(cells))
                value = _texts(c, "v") or _texts(c, "t")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            yield (names[k] if k < len(names) else f"Sheet{k + 1}"), cells


def sheet_text(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC-22: rows that aren't blank under the mark of their sheet, cells joined by tabs."""
    out, last = [], None
    for name, cells in sheet_rows(raw):
        if name != last:
            out.append(f"=== Sheet: {name} ===")
            last = name
        if any(c.strip() for c in cells):
            out.append("\t".join(cells))
    return "\n".join(out), "xlsx", []


class Registry:
    """UDF-01 to UDF-04: extractors and validators by extension, and hooks by stage."""

    def __init__(self) -> None:
        self.extractors: dict[str, Extractor] = {"txt": plain, "log": plain, "md": plain, "html": markup, "htm": markup, "xml": markup, "json": json_text, "csv": csv_text, "docx": word_text, "pptx": slides_text, "xlsx": sheet_text}
        self.validators: dict[str, Callable[[bytes], bool]] = {}
        self.hooks: dict[str, list[tuple[int, int, Hook]]] = {s: [] for s in STAGES}
        self.failed: list[tuple[str, str]] = []

    def register_processor(self, extension: str, extractor: Extractor) -> None:
        self.extractors[extension.lower().lstrip(".")] = extractor

    def register_validator(self, extension: str, validator: Callable[[bytes], bool]) -> None:
        self.validators[extension.lower().lstrip(".")] = validator

    def supported_types(self) -> list[str]:
        return sorted(self.extractors)

    def register_hook(self, stage: str, hook: Hook, priority: int = 0) -> None:
        if stage not in self.hooks:
            raise ValueError(f"no stage {stage}; there are {', '.join(STAGES)}")
        self.hooks[stage].append((-priority, len(self.hooks[stage]), hook))

    def execute_hooks(self, stage: str, df: DataFrame) -> DataFrame:
        """The hooks of a stage by priority; one that fails while it builds its plan is noted and left out."""
        for _, _, hook in sorted(self.hooks[stage], key=lambda x: x[:2]):
            try:
                df = df.transform(hook)
            except Exception as e:  # noqa: BLE001
                self.failed.append((stage, f"{type(e).__name__}: {e}"))
        return df


def extract(members: DataFrame, registry: Registry | None = None, name: str = "member", data: str = "data") -> DataFrame:
    """SRC-15, UDF-05: adds text, method and errors, by the extension in lower case; a failing extractor gives a row with an error."""
    reg = registry or Registry()
    extractors, validators = dict(reg.extractors), dict(reg.validators)

    def one(path: str, raw: bytes | None) -> tuple[str, str, list[str]]:
        ext = path.rsplit(".", 1)[-1].lower() if path and "." in path else ""
        if raw is None:
            return "", "none", ["no content"]
        if ext not in extractors:
            return "", "unsupported", [f"unsupported file type: {ext or 'none'}; supported: {', '.join(sorted(extractors))}"]
        try:
            if ext in validators and not validators[ext](bytes(raw)):
                return "", "invalid", [f"not a valid {ext} file"]
            return extractors[ext](bytes(raw))
        except Exception as e:  # noqa: BLE001  errors are data
            return "", "none", [f"{type(e).__name__}: {e}"]

    @F.pandas_udf("struct<text: string, method: string, errors: array<string>>")
    def run(paths: pd.Series, raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, r) for p, r in zip(paths, raws)], columns=["text", "method", "errors"])

    return members.withColumn("x", run(name, data)).select(*members.columns, "x.text", "x.method", "x.errors")


def longest_text(attempts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """SRC-29, TK-09: of several recognitions of one image the longest text, the first of equal ones."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return attempts.groupBy(key).agg(F.max_by(t, F.struct(F.length(t).alias("n"), (-F.col(order)).alias("o"))).alias("text"))


def word_confidence(words: DataFrame, key: str, confidence: str) -> DataFrame:
    """SRC-30: the mean of the words' confidences above 0, as a share; 0 without any."""
    return words.groupBy(key).agg(F.round(F.coalesce(F.avg(F.when(F.col(confidence) > 0, F.col(confidence))) / 100, F.lit(0.0)), 6).alias("confidence"))
