"""CommonMark sections: the text of a note cut at its headings, each with the trail of headings above it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

BREAK = "\x00"
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))(?=[ \t]|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_TAG = r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>"
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_BLOCK_TAGS.split())})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf" {{0,3}}{_TAG}\s*$"), None),
]
_INLINE_HTML = re.compile(rf"{_TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>", re.ASCII)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_DESTINATION = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _untab(line: str) -> str:
    """Tabs in the indentation as spaces, to stops of four."""
    out = ""
    for k, c in enumerate(line):
        if c == " ":
            out += c
        elif c == "\t":
            out += " " * (4 - len(out) % 4)
        else:
            return out + line[k:]
    return out


def _starts_block(line: str, in_paragraph: bool = True) -> bool:
    if _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line):
        return True
    if (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
        return True
    if any(start.match(line) for start, _ in _HTML[: 6 if in_paragraph else 7]):
        return True
    return bool((m := _ITEM.match(line)) and (not in_paragraph or (line[m.end() :].strip() and m[3] in (None, "1"))))


class _Blocks:
    """Block structure. Events: (`heading`, level, raw), (`text`, raw) to be read as inline text, (`code`, text), (`end`,)."""

    def __init__(self) -> None:
        self.events: list[tuple] = []
        self.labels: set[str] = set()

    def read(self, lines: list[str], tight: bool = False) -> None:
        k = 0
        while k < len(lines):
            line = _untab(lines[k])
            if not line.strip():
                k += 1
            elif line.startswith("    "):
                k = self._indented(lines, k)
            elif (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
                k = self._fenced(lines, k, m)
            elif m := _ATX.match(line):
                self.events.append(("heading", len(m[1]), m[2] or ""))
                k += 1
            elif _RULE.match(line):
                k += 1
            elif _QUOTE.match(line):
                k = self._quote(lines, k)
            elif _ITEM.match(line):
                k = self._list(lines, k)
            elif rule := next((r for r in _HTML if r[0].match(line)), None):
                k = self._html(lines, k, rule[1])
            else:
                k = self._paragraph(lines, k, tight)

    def _indented(self, lines: list[str], k: int) -> int:
        code = []
        while k < len(lines) and ((line := _untab(lines[k])).startswith("    ") or not line.strip()):
            code.append(line[4:])
            k += 1
        while not code[-1].strip():
            code.pop()
        self.events += [("code", "".join(f"{c}\n" for c in code)), ("end",)]
        return k

    def _fenced(self, lines: list[str], k: int, m: re.Match) -> int:
        close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        code = []
        k += 1
        while k < len(lines) and not close.match(_untab(lines[k])):
            line = lines[k]
            code.append(line[min(len(m[1]), len(line) - len(line.lstrip(" "))) :])
            k += 1
        self.events += [("code", "".join(f"{c}\n" for c in code)), ("end",)]
        return k + 1

    @staticmethod
    def _open_paragraph(lines: list[str]) -> bool:
        """Whether the lines so far end in a paragraph, which a next line can lazily continue."""
        if not lines or not lines[-1].strip():
            return False
        last = _untab(lines[-1])
        while m := _QUOTE.match(last) or _ITEM.match(last):
            last = _untab(last[m.end() :].lstrip(" "))
        fences = sum(bool(_FENCE.match(_untab(x))) for x in lines)
        return bool(last.strip()) and not fences % 2 and not (_ATX.match(last) or _RULE.match(last) or _FENCE.match(last) or last.startswith("    ") and len(lines) == 1)

    def _quote(self, lines: list[str], k: int) -> int:
        inner: list[str] = []
        while k < len(lines):
            line = _untab(lines[k])
            if m := _QUOTE.match(line):
                inner.append(line[m.end() :])
            elif line.strip() and self._open_paragraph(inner) and not _starts_block(line) and not _SETEXT.match(line):
                inner.append(line)
            else:
                break
            k += 1
        self.read(inner)
        return k

    def _list(self, lines: list[str], k: int) -> int:
        kind = None
        items: list[list[str]] = []
        loose, gap = False, False
        while k < len(lines):
            line = _untab(lines[k])
            m = _ITEM.match(line)
            if not m or _RULE.match(line) or (kind or (m[4] or m[2])) != (m[4] or m[2]):
                break
            kind = m[4] or m[2]
            loose |= gap and bool(items)
            rest = line[m.end() :]
            spaces = len(rest) - len(rest.lstrip(" "))
            width = m.end() + (1 if not rest.strip() or spaces > 4 else spaces)
            item = [line[width:] if rest.strip() else ""]
            k, gap = k + 1, False
            while k < len(lines):
                line = _untab(lines[k])
                if not line.strip():
                    if len(item) == 1 and not item[0]:
                        break
                    gap = True
                    item.append("")
                elif len(line) - len(line.lstrip(" ")) >= width:
                    loose |= gap and not self._inside_fence(item) and len(line) - len(line.lstrip(" ")) < width + 2
                    gap = False
                    item.append(line[width:])
                elif not gap and self._open_paragraph(item) and not _starts_block(line) and not _ITEM.match(line):
                    item.append(line.lstrip(" "))
                else:
                    break
                k += 1
            while item and not item[-1]:
                item.pop()
            items.append(item)
            while k < len(lines) and not lines[k].strip():
                gap = True
                k += 1
        for item in items:
            self.read(item, tight=not loose)
            self.events.append(("end",))
        return k

    @staticmethod
    def _inside_fence(lines: list[str]) -> bool:
        return sum(bool(_FENCE.match(_untab(x))) for x in lines) % 2 == 1

    def _html(self, lines: list[str], k: int, stop: re.Pattern | None) -> int:
        while k < len(lines):
            if stop is None and not lines[k].strip():
                return k
            k += 1
            if stop is not None and stop.search(lines[k - 1]):
                return k
        return k

    def _paragraph(self, lines: list[str], k: int, tight: bool) -> int:
        own: list[str] = []
        while k < len(lines):
            line = _untab(lines[k])
            if not line.strip():
                break
            if not own and (m := _DEFINITION.match(line)):
                self.labels.add(_label(m[1]))
                k += 1
                continue
            if own and (m := _SETEXT.match(line)):
                self.events.append(("heading", 1 if m[1][0] == "=" else 2, "\n".join(own)))
                return k + 1
            if own and _starts_block(line):
                break
            own.append(lines[k].lstrip(" \t"))
            k += 1
        if own:
            self.events.append(("text", "\n".join(own)))
            if not tight:
                self.events.append(("end",))
        return k


def _close_bracket(s: str, k: int) -> int:
    """Place of the bracket that closes the one at k, or -1; code spans and escapes are passed over."""
    depth = 0
    while k < len(s):
        if s[k] == "\\":
            k += 2
            continue
        if s[k] == "`":
            run = re.match("`+", s[k:])[0]
            end = re.compile(rf"(?<!`){run}(?!`)").search(s, k + len(run))
            k = end.end() if end else k + len(run)
            continue
        depth += (s[k] == "[") - (s[k] == "]")
        if not depth:
            return k
        k += 1
    return -1


def _pieces(s: str, labels: set[str]) -> list[list]:
    """Inline pieces: [text] or [run of * or _, can open, can close]."""
    out: list[list] = []
    add = lambda t: out.append([t])
    k = 0
    while k < len(s):
        c = s[k]
        if c == "\\" and k + 1 < len(s):
            if s[k + 1] == "\n":
                add(BREAK)
            else:
                add(s[k + 1] if s[k + 1] in _PUNCTUATION else s[k : k + 2])
            k += 2
            while c == "\\" and s[k - 1] == "\n" and k < len(s) and s[k] == " ":
                k += 1
        elif c == "`":
            run = re.match("`+", s[k:])[0]
            end = re.compile(rf"(?<!`){run}(?!`)").search(s, k + len(run))
            if end:
                code = s[k + len(run) : end.start()].replace("\n", " ")
                add(code[1:-1] if len(code) > 1 and code[0] == code[-1] == " " and code.strip(" ") else code)
                k = end.end()
            else:
                add(run)
                k += len(run)
        elif c == "<" and (m := _AUTOLINK.match(s, k)):
            add(m[1])
            k = m.end()
        elif c == "<" and (m := _INLINE_HTML.match(s, k)):
            k = m.end()
        elif c == "&" and (m := _ENTITY.match(s, k)) and (new := html.unescape(m[0])) != m[0]:
            add(new)
            k = m.end()
        elif c == "[" or (c == "!" and s[k + 1 : k + 2] == "["):
            at = k + (c == "!")
            end = _close_bracket(s, at)
            label = s[at + 1 : end] if end > 0 else ""
            after = end + 1
            hit = None
            if end > 0:
                if m := _DESTINATION.match(s, after):
                    hit = m.end()
                elif (m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S).match(s, after)) and _label(m[1] or label) in labels:
                    hit = m.end()
                elif _label(label) in labels:
                    hit = after
            if hit is None:
                add(s[k : at + 1])
                k = at + 1
            else:
                add(inline(label, labels))
                k = hit
        elif c == "\n":
            if out and len(out[-1]) == 1:
                out[-1][0] = out[-1][0].rstrip(" ")
            add(BREAK)
            k += 1
        elif c in "*_":
            run = re.match(re.escape(c) + "+", s[k:])[0]
            before, after = s[k - 1 : k] or " ", s[k + len(run) : k + len(run) + 1] or " "
            odd = lambda x: x in _PUNCTUATION or (not x.isalnum() and not x.isspace() and ord(x) > 127)
            left = not after.isspace() and (not odd(after) or before.isspace() or odd(before))
            right = not before.isspace() and (not odd(before) or after.isspace() or odd(after))
            opens, closes = (left, right) if c == "*" else (left and (not right or odd(before)), right and (not left or odd(after)))
            out.append([run, opens, closes, len(run)])
            k += len(run)
        else:
            m = re.compile(r"[^\\`<&\[!\n*_]+|.").match(s, k)
            add(m[0])
            k = m.end()
    return out


def inline(s: str, labels: set[str]) -> str:
    """Text of inline Markdown, with BREAK for line breaks; matched emphasis marks, tags, destinations and titles vanish."""
    pieces = _pieces(s, labels)
    for close, p in enumerate(pieces):
        if len(p) == 1 or not p[2]:
            continue
        opener = close - 1
        while opener >= 0 and p[0]:
            o = pieces[opener]
            if len(o) > 1 and o[0] and o[1] and o[0][0] == p[0][0] and not ((o[2] or p[1]) and (o[3] + p[3]) % 3 == 0 and (o[3] % 3 or p[3] % 3)):
                n = 2 if len(o[0]) > 1 and len(p[0]) > 1 else 1
                o[0], p[0] = o[0][n:], p[0][n:]
                for inner in pieces[opener + 1 : close]:
                    if len(inner) > 1:
                        inner[1] = inner[2] = False
                if o[0]:
                    continue
            opener -= 1
    return "".join(p[0] for p in pieces)


def sections(body: str) -> list[tuple[str, str]]:
    """(heading path, text) of each non-blank run of text between headings, in order.

    The path joins the non-empty headings above with ` > `. Line breaks count as a space, but as nothing within a
    heading; paragraphs, list items and code blocks end with a line end.
    """
    blocks = _Blocks()
    blocks.read(body.replace("\x00", "�").replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    out: list[tuple[str, str]] = []
    stack: list[tuple[int, str]] = []
    text: list[str] = []

    def flush() -> None:
        if whole := "".join(text).strip():
            out.append((" > ".join(t for _, t in stack if t), whole))
        text.clear()

    for event in blocks.events:
        if event[0] == "heading":
            flush()
            stack = [x for x in stack if x[0] < event[1]]
            stack.append((event[1], inline(event[2], blocks.labels).replace(BREAK, "").strip()))
        elif event[0] == "text":
            text.append(inline(event[1], blocks.labels).replace(BREAK, " "))
        elif event[0] == "code":
            text.append(event[1])
        else:
            text.append("\n")
    flush()
    return out


SECTIONS = ArrayType(StructType([StructField("heading_path", StringType()), StructField("text", StringType())]))
#: Bytes of bodies whose sections a worker holds at a time.
SLICE_BYTES = 1 << 20


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches cut so that each slice holds at most SLICE_BYTES, one body at least."""
    for bodies in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(bodies), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(bodies):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield bodies.slice(at, stop - at)
            at = stop


@F.arrow_udf(SECTIONS)
def _sections(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("heading_path", pa.string()), ("text", pa.string())]))
    for bodies in _slices(batches):
        yield pa.array([None if b is None else [{"heading_path": h, "text": t} for h, t in sections(b)] for b in bodies.to_pylist()], kind)


def section_structs(body: Column) -> Column:
    """sections() of a column, by slices of Arrow batches; a worker holds the sections of one slice, however large a batch is."""
    return _sections(body)
