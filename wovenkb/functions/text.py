"""Text functions over columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of tables, words of summary rows, roles of sheet rows, white space, and the patterns of tags,
# list items, runs of blanks and of line ends.
TABLE_TYPES = ("xlsx", "xls", "csv")
SUMMARY_WORDS = ("合计", "小计", "总计", "总和", "汇总", "累计")
ROLES = ("TITLE", "FORM", "SIGNING", "GROUP_HEADER", "DATA")
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TAG = r"</?\s*[a-z][a-z0-9]*\b[^>]*>"
LIST_ITEM = rf"^[{SPACE}]*(?:[-*+]|[0-9]+[.)])[{SPACE}]"
BLANKS = "[ \t　]+"
BLANK_LINES = r"\n{3,}"


def normalize_name(name: Column) -> Column:
    """Identity form of an entity's name: no white space, lower case."""
    return F.lower(F.regexp_replace(name, r"(?U)\s+", ""))


def strip_html(text: Column) -> Column:
    """Drop what looks like a lower-case tag."""
    return F.regexp_replace(text, TAG, "")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks, tabs and full-width blanks to one blank; no white space at the ends of lines."""
    return F.array_join(F.transform(_lines(text), lambda x: strip(F.regexp_replace(x, BLANKS, " "))), "\n")


def is_list_item(line: Column) -> Column:
    """Whether a line begins with -, * or +, or a number with a dot or bracket, and a blank."""
    return line.rlike(LIST_ITEM)


def join_lines(text: Column, protect_lists: bool = True) -> Column:
    """Hard breaks to blanks, but for empty lines and (if protected) list items, by walking over the lines once."""
    lines = _lines(text)
    if not protect_lists:
        return F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    previous = F.concat(F.array(F.lit("")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
    glued = F.zip_with(lines, previous, lambda x, p: F.concat(F.when((x == "") | (p == "") | is_list_item(x) | is_list_item(p), F.lit("\n")).otherwise(F.lit(" ")), x))
    return F.substring(F.array_join(glued, ""), 2, 2147483647)


def limit_blank_lines(text: Column) -> Column:
    return strip(F.regexp_replace(text, BLANK_LINES, "\n\n"))


def clean_text(text: Column, file_type: Column, html: bool = False, protect_lists: bool = True, spaces: bool = True, hard_breaks: bool = True, blank_lines: bool = True) -> Column:
    """The cleaning chain: markup (off by default), line ends, blanks, hard breaks but in Markdown and tables, blank lines.
    Line ends are always brought to one form, each other step can be left out."""
    x = normalize_newlines(strip_html(text) if html else text)
    x = collapse_spaces(x) if spaces else x
    if hard_breaks:
        kept = F.coalesce(F.lower(file_type).isin("md", "markdown", *TABLE_TYPES), F.lit(False))
        x = F.when(kept, x).otherwise(join_lines(x, protect_lists))
    return limit_blank_lines(x) if blank_lines else x


def strip_roles(text: Column) -> Column:
    """Without the role marks of sheet rows."""
    return F.regexp_replace(text, rf"(?m)^#(?:{'|'.join(ROLES)})#", "")


def snippet(text: Column, keyword: str, around: int = 80) -> Column:
    """What stands around the first hit, without regard to case, with ... where it is cut; without a hit the beginning."""
    at = F.locate(keyword.lower(), F.lower(text))
    n = len(keyword)
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + n - 1 + around, F.length(text))
    cut = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substr(text, start, end - start + 1), F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, 2 * around))


# The Chinese numerals of headings.
NUMERALS = "一二三四五六七八九十"


def heading_from_text(text: Column) -> Column:
    """A heading among the first five lines: Markdown, Chinese chapter (or its number, where it has no name), Chinese
    ordinal, or numbered with 2 to 60 characters, Chinese ones among them; 80 characters at most.

    Each line is parted into a mark and the rest; what kind of mark it is decides whether the rest is a heading.
    """
    kinds = {
        "hashes": r"#{1,6}(?=\s)",
        "chapter": rf"第[{NUMERALS}百]+[章节部分](?:[\s、．.])?",
        "ordinal": rf"[{NUMERALS}]+、",
        "number": r"[0-9]+(?:\.[0-9]+)*[\s、．.]",
    }

    def found(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, mark in reversed(kinds.items()):
            rest = strip(F.regexp_replace(x, "^" + mark, ""))
            named = {"chapter": F.coalesce(F.nullif(rest, F.lit("")), x), "number": F.when(F.length(rest).between(2, 60) & rest.rlike("[一-龥]"), rest)}.get(kind, F.nullif(rest, F.lit("")))
            out = F.when(x.rlike("^" + mark) & named.isNotNull(), named).otherwise(out)
        return out

    lines = F.filter(F.transform(F.slice(_lines(text), 1, 5), lambda x: strip(x)), lambda x: x != "")
    heads = F.filter(F.transform(lines, found), lambda x: x.isNotNull())
    return F.coalesce(F.substring(F.try_element_at(heads, F.lit(1)), 1, 80), F.lit(""))


def is_summary_row(first_cell: Column) -> Column:
    return first_cell.rlike("|".join(SUMMARY_WORDS))


def safe_for_embedding(text: Column) -> Column:
    """Blank texts become a word, so that every text can be embedded."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("empty"))


def clean_rewrite(text: Column) -> Column:
    """A rewritten question without quotes and role labels."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:user|assistant|query|question|用户|助手|问题|改写)\s*[:：]\s*", ""), "^[\"'“”‘’「」]+|[\"'“”‘’「」]+$", ""))


def parse_flag(text: Column, default: bool) -> Column:
    """Form value to boolean: true, 1, on and false, 0, off in any case; empty gives null, anything else the default."""
    x = F.lower(strip(text))
    return F.when(x == "", F.lit(None).cast("boolean")).when(x.isin("true", "1", "on"), True).when(x.isin("false", "0", "off"), False).otherwise(default)


def known_or_null(text: Column, allowed: tuple[str, ...]) -> Column:
    """A value of a white list, else null."""
    x = F.lower(F.trim(text))
    return F.when(x.isin(*allowed), x)


def title_from_path(path: Column) -> Column:
    """Stem of the file name."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def file_type_of(path: Column) -> Column:
    """Type by lower-case suffix; null where no reader knows it."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    groups = {"md": ("md", "markdown"), "txt": ("txt", "text", "log"), "csv": ("csv",), "xlsx": ("xlsx",), "docx": ("docx",), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")}
    out = F.lit(None).cast("string")
    for kind, suffixes in groups.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def route_splitter(file_type: Column, mode: str = "auto") -> Column:
    """Which splitter takes a document."""
    kind = F.lower(F.coalesce(file_type, F.lit("")))
    if mode not in ("auto", "semantic"):
        return F.lit(mode)
    other = F.lit("semantic" if mode == "semantic" else "sentence")
    return F.when(kind.isin(*TABLE_TYPES), "table").when(kind.isin("md", "markdown") & F.lit(mode != "semantic"), "markdown").otherwise(other)
