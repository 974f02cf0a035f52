"""Column builders over note text: frontmatter, title, wikilinks, word windows. No Python runs on the workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONTMATTER = r"(?s)\A---\n(.*?)\n---(?:\n|\z)(.*)\z"
WIKILINK = r"(?s)\[\[(.*?)\]\]"
LINK_TARGET = r"(?s)^([^|#]*)"
EDGE_QUOTES = r"^[\"']+|[\"']+$"
FILE_STEM = r"([^/]+?)(\.[^./]*)?$"
EDGE_SPACE = r"(?U)^\s+|\s+$"
WHITE_SPACE = r"\p{IsWhite_Space}+"
LINE_END = r"\r?\n"


def trimmed(text: Column) -> Column:
    """Text without Unicode white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return bound(F.split(text, LINE_END), lambda p: F.when(F.try_element_at(p, F.lit(-1)) == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))


def frontmatter(content: Column) -> Column:
    """The YAML block between a leading `---` line and the next one, NULL where there is none."""
    return F.when(content.rlike(FRONTMATTER), F.regexp_extract(content, FRONTMATTER, 1))


def body(content: Column) -> Column:
    """What follows the frontmatter, or all of the content."""
    return F.when(content.rlike(FRONTMATTER), F.regexp_extract(content, FRONTMATTER, 2)).otherwise(content)


def frontmatter_title(block: Column) -> Column:
    """Value of the first non-blank `title:` line at any indentation, without quotes around it."""
    marked = F.filter(F.transform(lines(block), trimmed), lambda x: x.startswith("title:"))
    values = F.transform(marked, lambda x: trimmed(F.regexp_replace(trimmed(F.substring(x, 7, 1 << 30)), EDGE_QUOTES, "")))
    return F.try_element_at(F.filter(values, lambda x: x != ""), F.lit(1))


def first_h1(text: Column) -> Column:
    """First non-blank `# ` heading outside fenced code; every line that starts with a fence toggles, whatever its kind."""
    start = F.struct(F.lit(False).alias("code"), F.lit(None).cast("string").alias("title"))

    def step(state: Column, line: Column) -> Column:
        fence = line.startswith("```") | line.startswith("~~~")
        found = F.when(~fence & ~state["code"] & line.startswith("# "), F.nullif(trimmed(F.substring(line, 3, 1 << 30)), F.lit("")))
        return F.struct(F.when(fence, ~state["code"]).otherwise(state["code"]).alias("code"), F.coalesce(state["title"], found).alias("title"))

    telling = F.filter(lines(text), lambda x: x.rlike(r"(?U)^\s*(?:# |```|~~~)"))
    return F.aggregate(F.transform(telling, lambda x: F.regexp_replace(x, r"(?U)^\s+", "")), start, step, lambda s: s["title"])


def file_stem(path: Column) -> Column:
    """Last path component without its last extension; a leading dot is no extension."""
    return F.regexp_extract(path, FILE_STEM, 1)


def title(path: Column, block: Column, text: Column) -> Column:
    """Frontmatter title, else first H1, else file stem, else `untitled`."""
    return F.coalesce(frontmatter_title(block), first_h1(text), F.nullif(file_stem(path), F.lit("")), F.lit("untitled"))


def wikilinks(text: Column) -> Column:
    """Distinct `[[targets]]` in order of appearance, cut at the first `|` or `#`."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), lambda x: trimmed(F.regexp_extract(x, LINK_TARGET, 1)))
    return F.array_distinct(F.filter(targets, lambda x: x != ""))


def parsed(path: Column, content: Column) -> Column:
    """Struct of title, frontmatter, body and links of a note."""
    block, rest = frontmatter(content), body(content)
    return F.struct(title(path, block, rest).alias("title"), block.alias("frontmatter"), rest.alias("body"), wikilinks(rest).alias("links"))


def words(text: Column) -> Column:
    """Words by Unicode white space."""
    return F.filter(F.split(text, WHITE_SPACE), lambda x: x != "")


def windows(text: Column, max_tokens: int = 384, overlap: int = 64) -> Column:
    """Overlapping windows of at most max_tokens words, the last of which reaches the end; none for a blank text."""
    if max_tokens < 1 or overlap < 0:
        raise ValueError("max_tokens must be at least 1 and overlap at least 0")
    step = max(max_tokens - overlap, 1)

    def cut(split: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil((F.size(split) - max_tokens) / F.lit(step)).cast("int"))
        many = F.transform(starts, lambda k: F.array_join(F.slice(split, k * step + 1, max_tokens), " "))
        return F.when(F.size(split) == 0, F.array().cast("array<string>")).when(F.size(split) <= max_tokens, F.array(F.array_join(split, " "))).otherwise(many)

    return bound(words(text), cut)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a lambda's variable stands for it, where plain nesting would repeat it for each use."""
    return F.transform(F.array(value), use)[0]


def embed_input(heading_path: Column, text: Column) -> Column:
    """What is embedded for a chunk: its heading trail on a line of its own, where it has one."""
    return F.when(heading_path == "", text).otherwise(F.concat_ws("\n", heading_path, text))


def lossy_utf8(content: Column) -> Column:
    """Bytes as text, invalid ones as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def root_label(root: Column) -> Column:
    return F.try_element_at(F.split(root, "/"), F.lit(-1))


def result_line(rank: Column, score: Column, tag: Column, note: Column, path: Column) -> Column:
    return F.format_string("%2d. [%.3f] %s%s  (%s)", rank, score, tag, note, path)


def snippet(text: Column) -> Column:
    return F.substring(text, 1, 280)
