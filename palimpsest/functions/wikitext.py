"""Readable text of a page's markup: blocks first, then inline spans, as plain text or Markdown.

A page is split into blocks (headings, list items, paragraphs, preformatted
lines, rules, table captions and rows), each with the source of its inline
spans; a writer per output lays them out. Inline spans are found by one
pattern that stops at whatever may begin a construct. A construct that is not
closed is taken literally. Nesting deeper than ``DEPTH`` is taken literally too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DEPTH = 32
_WS = "\t\n\x0b\x0c\r \x85\xa0                　"
_BLANKS = re.compile(f"[{_WS}]+")

# Names that the output depends on.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…"}
FIRST_ARGUMENT = {"nowrap", "nobr", "small", "big", "center", "plainlist", "ubl", "quote", "blockquote", "pull quote", "abbr"}
LAST_ARGUMENT = {"lang", "langue"}
SYMBOLS = {"!": "|", "=": "="}
MEDIA_WORDS = {"thumb", "thumbnail", "frame", "frameless", "border", "left", "right", "center", "none", "upright"}
MEDIA_KEYS = ("alt=", "link=", "class=", "lang=", "page=")
BREAKS = {"br", "p", "div", "li"}
ALIGNMENTS = {"left", "right", "center"}

_ESCAPES = str.maketrans({c: "\\" + c for c in "\\*_[]`<>#"})
_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~/#:")


def squeeze(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return _BLANKS.sub(" ", text).strip(" ")


def without_comments(source: str) -> str:
    """One kind of line end, and no comments; one that does not end takes the rest with it."""
    return re.sub(r"<!--.*?(?:-->|\Z)", "", source.replace("\r\n", "\n").replace("\r", "\n"), flags=re.S)


# ---- inline spans

_STOP = re.compile(r"<!--|\[\[|\{\{|\[http|'''|''|__|<|&")
_BRACKETS = {"[[": ("]]", re.compile(r"\[\[|\]\]")), "{{": ("}}", re.compile(r"\{\{|\}\}"))}
_CUTS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_ENTITY = re.compile(r"&([^;]{0,11});")
_MAGIC = re.compile(r"__[A-Z_]*?__")
_PAIRED = re.compile(r"<(ref|code|tt)(?=[>/\s])[^>]*>?", re.I)


def closing(text: str, at: int) -> int:
    """Where the bracket pair opened at ``at`` ends, or -1."""
    opener = text[at : at + 2]
    close, both = _BRACKETS[opener]
    if text.rfind(close) < at:
        return -1
    depth = 0
    for m in both.finditer(text, at):
        depth += 1 if m[0] == opener else -1
        if not depth:
            return m.end()
    return -1


def arguments(body: str) -> list[str]:
    """The parts of a link or template between bars outside inner brackets."""
    parts, start, inside = [], 0, {"{": 0, "[": 0}
    for m in _CUTS.finditer(body):
        mark = m[0]
        if mark == "|":
            if not any(inside.values()):
                parts.append(body[start : m.start()])
                start = m.end()
        elif mark in _BRACKETS:
            inside[mark[0]] += 1
        else:
            kind = "{" if mark == "}}" else "["
            inside[kind] = max(0, inside[kind] - 1)
    return [*parts, body[start:]]


class Inline:
    """Renders the spans of one output kind."""

    def __init__(self, markdown: bool) -> None:
        self.markdown = markdown

    def literal(self, text: str) -> str:
        return text.translate(_ESCAPES) if self.markdown else text

    def around(self, mark: str, body: str) -> str:
        return f"{mark}{body}{mark}" if self.markdown else body

    def render(self, text: str, depth: int = 0) -> str:
        if depth >= DEPTH:
            return self.literal(text)
        out, at = [], 0
        while m := _STOP.search(text, at):
            out.append(self.literal(text[at : m.start()]))
            took = self._construct(text, m.start(), m[0], depth + 1)
            if took is None:
                # not a construct after all: one character goes by
                out.append(self.literal(text[m.start()]))
                at = m.start() + 1
            else:
                out.append(took[0])
                at = took[1]
        out.append(self.literal(text[at:]))
        return "".join(out)

    def _construct(self, text: str, at: int, mark: str, depth: int) -> tuple[str, int] | None:
        """What the construct at ``at`` gives and where it ends; None if there is none."""
        if mark == "<!--":
            end = text.find("-->", at)
            return "", len(text) if end < 0 else end + 3
        if mark in _BRACKETS:
            end = closing(text, at)
            if end >= 0:
                body = text[at + 2 : end - 2]
                return (self.link if mark == "[[" else self.template)(body, depth), end
            # an outer bracket may still belong to an address
            mark = "[http" if text.startswith("[http", at) else mark
        if mark == "[http":
            end = text.find("]", at)
            return None if end < 0 else (self.web_link(text[at + 1 : end], depth), end + 1)
        if mark in ("'''", "''"):
            for quotes, sign in (("'''", "**"), ("''", "*")):
                end = text.find(quotes, at + len(quotes)) if text.startswith(quotes, at) else -1
                if end >= 0:
                    return self.around(sign, self.render(text[at + len(quotes) : end], depth)), end + len(quotes)
            return None
        if mark == "__":
            end = text.find("__", at + 2)
            return ("", end + 2) if end >= 0 and re.fullmatch("[A-Z_]*", text[at + 2 : end]) else None
        if mark == "&":
            m = _ENTITY.match(text, at)
            decoded = entity(m[1]) if m else None
            return None if decoded is None else (decoded, m.end())
        return self.tag(text, at, depth) if mark == "<" else None

    def tag(self, text: str, at: int, depth: int) -> tuple[str, int] | None:
        """Tags with a meaning of their own; others vanish, some as a line break."""
        if text.startswith("<nowiki>", at):
            if m := re.compile("</nowiki>", re.I).search(text, at):
                return self.literal(text[at + 8 : m.start()]), m.end()
        elif m := _PAIRED.match(text, at):
            name = m[1].lower()
            if name == "ref" and m[0].rstrip(_WS).endswith("/>"):
                return "", m.end()
            end = re.compile(f"</{name}>", re.I).search(text, at)
            if end and m[0].endswith(">"):
                inner = text[m.end() : end.start()]
                if name == "ref":
                    note = squeeze(self.render(inner, depth))
                    return f" [ref: {note}]" if note else "", end.end()
                code = squeeze(inner)
                return self.around("``" if "`" in code else "`", code), end.end()
        end = text.find(">", at)
        if end < 0:
            return None
        return "\n" if text[at : end + 1].strip("<>/ ").lower() in BREAKS else "", end + 1

    def link(self, body: str, depth: int) -> str:
        """A link to a page, an image's caption, or nothing for a category."""
        first, *rest = arguments(body)
        target = first.strip(_WS)
        space, colon, _ = target.partition(":")
        kind = space.lower() if colon else ""
        if kind == "category":
            return ""
        if kind in ("file", "image"):
            shown = [x for x in (p.strip(_WS) for p in rest) if x and x.lower() not in MEDIA_WORDS and not x.lower().endswith("px") and not x.lower().startswith(MEDIA_KEYS)]
            if not shown:
                return ""
            caption = self.render(shown[-1], depth)
            return f"*Image: {caption}*" if self.markdown else f"[Image: {caption}]"
        label = self.render(rest[-1].strip(_WS) if rest else target.split("#")[0], depth)
        if not self.markdown or not target:
            return label
        address = "".join(chr(b) if b in _SAFE else "_" if b == 32 else f"%{b:02X}" for b in target.lstrip(":").encode())
        return f"[{label}]({address})"

    def web_link(self, body: str, depth: int) -> str:
        parts = _BLANKS.split(body, maxsplit=1)
        url, label = parts[0], parts[1].strip(_WS) if len(parts) > 1 else ""
        shown = self.render(label or url, depth)
        if self.markdown:
            return f"[{shown}]({url})"
        return f"{shown} ({url})" if label and label != url else url

    def template(self, body: str, depth: int) -> str:
        """The visible argument of known templates; a label for others."""
        first, *rest = arguments(body)
        name = first.strip(_WS)
        known = squeeze(name.replace("_", " ")).lower()
        given = [x for x in (p.strip(_WS) for p in rest) if x and not x.partition("=")[0].strip(_WS) * ("=" in x)]
        if known in SYMBOLS:
            return SYMBOLS[known]
        if known == "convert":
            return self.render(" ".join(given[:3]), depth)
        if known in ("frac", "fraction"):
            whole = [given[0]] if len(given) > 2 else []
            return self.render(" ".join([*whole, "/".join(given[len(whole) : len(whole) + 2])]), depth)
        if given and known in FIRST_ARGUMENT | LAST_ARGUMENT:
            return self.render(given[-1 if known in LAST_ARGUMENT else 0], depth)
        label = name or "unnamed"
        return f"`[Template: {label.replace('`', chr(39))}]`" if self.markdown else f"[Template: {label}]"


def entity(name: str) -> str | None:
    """The character of a named or numeric entity, or None."""
    if name in ENTITIES:
        return ENTITIES[name]
    m = re.fullmatch(r"#(?:[xX]\+?([0-9a-fA-F]+)|\+?([0-9]+))", name, re.A)
    if not m:
        return None
    code = int(m[1], 16) if m[1] else int(m[2])
    if code == 160:
        return " "
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


# ---- blocks

_HEADING = re.compile(r"(={2,6})(?!=)(.*)", re.S)


def heading_of(line: str) -> tuple[int, str] | None:
    """(level, source) of a heading line: two to six signs before it and at least as many behind."""
    line = line.strip(_WS)
    m = _HEADING.fullmatch(line)
    if not m or len(line) < 2 * len(m[1]) or not line.endswith(m[1]):
        return None
    return len(m[1]), line[len(m[1]) : len(line) - len(m[1])].strip(_WS)


def table_block(line: str) -> tuple | None:
    """A caption or a row of a table, from one of its lines."""
    if line.startswith("|+"):
        return "caption", line[2:].strip(_WS)
    header = line.startswith("!")
    if not header and not line.startswith("|"):
        return None
    cells = []
    for cell in line[1:].split("!!" if header else "||"):
        before, bar, after = cell.partition("|")
        cells.append((after if bar and ("=" in before or before.strip(_WS).lower() in ALIGNMENTS) else cell).strip(_WS))
    return "row", header, cells


def blocks(source: str) -> Iterator[tuple]:
    """(kind, …) of each block of a source without comments; "gap" stands between paragraphs, "table" before a table's parts."""
    paragraph: list[str] = []
    in_table = False
    for raw in source.split("\n"):
        line = raw.rstrip(_WS)
        bare = line.lstrip(_WS)
        if in_table:
            if bare.startswith("|}"):
                in_table = False
                yield ("gap",)
            elif bare and not bare.startswith("|-") and (part := table_block(bare)):
                yield part
            continue
        heading = heading_of(line)
        items = re.match(r"[*#;:]+", line)
        if bare and not (bare.startswith("{|") or heading or items or line.startswith(" ") or (len(bare) >= 4 and not bare.strip("-"))):
            paragraph.append(bare)
            continue
        if paragraph:
            yield "paragraph", " ".join(paragraph)
            paragraph = []
        if bare.startswith("{|"):
            in_table = True
            yield ("table",)
        elif not bare:
            yield ("gap",)
        elif heading:
            yield "heading", *heading
        elif items:
            yield "item", items[0], line[items.end() :].lstrip(_WS)
        elif line.startswith(" "):
            yield "code", line[1:]
        else:
            yield ("rule",)
    if paragraph:
        yield "paragraph", " ".join(paragraph)


def item_line(markers: str, text: str, markdown: bool) -> str:
    """A list item with its sign, indented by its depth."""
    deep, sign = len(markers) - 1, markers[-1]
    if sign == ":":
        return "> " * (deep + 1) + text if markdown else "  " * deep + text
    if sign == ";" and markdown:
        text = f"**{text}**"
    return "  " * deep + ("1. " if sign == "#" else "- ") + text


def render_wikitext(source: str | None, markdown: bool = False) -> str | None:
    """Plain text or Markdown of a page's source; empty where nothing is visible, else with a line end."""
    if source is None:
        return None
    lines: list[str] = []
    spans = Inline(markdown)
    show = lambda text: squeeze(spans.render(text))
    headed = False

    def gap() -> None:
        if lines and lines[-1]:
            lines.append("")

    for kind, *rest in blocks(without_comments(source)):
        if kind == "gap":
            gap()
        elif kind == "table":
            headed = False
        elif kind == "heading":
            if text := show(rest[1]):
                lines.append("#" * rest[0] + " " + text if markdown else text)
                gap()
        elif kind == "item":
            if text := show(rest[1]):
                lines.append(item_line(rest[0], text, markdown))
        elif kind == "code":
            lines.append("    " + rest[0])
        elif kind == "rule":
            lines.append("---" if markdown else "─" * 8)
        elif kind == "caption":
            if text := show(rest[0]):
                lines.append(f"*Table: {text}*" if markdown else f"Table: {text}")
        elif kind == "row":
            cells = [show(c) for c in rest[1]]
            if any(cells):
                lines.append(f"| {' | '.join(cells)} |" if markdown else " | ".join(cells))
                if markdown and rest[0] and not headed:
                    headed = True
                    lines.append(f"| {' | '.join('---' for _ in cells)} |")
        elif text := show(rest[0]):
            lines.append(text)
    while lines and not lines[-1]:
        lines.pop()
    return "".join(line.rstrip(_WS) + "\n" for line in lines)


def search_headings(source: str | None) -> str | None:
    """The visible headings of a page, one on each line."""
    if source is None:
        return None
    found = (heading_of(line) for line in without_comments(source).split("\n"))
    shown = (squeeze(Inline(False).render(h[1])) for h in found if h)
    return "".join(h + "\n" for h in shown if h)


@F.pandas_udf(StringType())
def wikitext_to_text(source: pd.Series) -> pd.Series:
    return source.map(render_wikitext)


@F.pandas_udf(StringType())
def wikitext_to_markdown(source: pd.Series) -> pd.Series:
    return source.map(lambda s: render_wikitext(s, True))


@F.pandas_udf(StructType([StructField("headings", StringType()), StructField("body", StringType())]))
def search_content(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"headings": source.map(search_headings), "body": source.map(render_wikitext)})
