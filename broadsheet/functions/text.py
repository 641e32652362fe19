"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of the Unicode white-space class, written as a regex class body that Java and RE2 share.
WS = " \t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters spelled out, for trimming.
WS_CHARS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
#: Characters that make up a word: letters, marks, digits and the underscore.
WORD = r"\p{L}\p{M}\p{N}_"
#: Characters of a token: letters, digits, the underscore, plus one script block kept whole.
TOKEN = "\\p{L}\\p{N}_\u0980-\u09ff"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it: an expression inside a higher-order
    function is not shared by the planner."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escape(literal: str) -> str:
    """Regex that matches ``literal`` itself, for Java and RE2."""
    return re.sub(r"([^\w\s]|\s)", lambda m: "\\" + m.group(0) if ord(m.group(0)) < 128 else m.group(0), literal)


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def collapse_spaces(c) -> Column:
    return F.regexp_replace(col(c), f"[{WS}]+", " ")


def document_text(title, content, sep: str = "\n\n") -> Column:
    """P01. Title and body as one text. ``sep`` is a blank line for storage, one space for embedding."""
    return strip(F.concat_ws(sep, F.coalesce(col(title), F.lit("")), F.coalesce(col(content), F.lit(""))))


def detect_language(text, blocks: dict[str, str] | None = None, default: str = "English", head: int | None = None) -> Column:
    """P02. First language whose Unicode block (a regex class body) occurs in the text, or in its first
    ``head`` characters."""
    blocks = blocks or {"Bangla": "\u0980-\u09ff"}
    sample = col(text) if head is None else F.substring(col(text), 1, head)
    out = None
    for language, block in blocks.items():
        hit = sample.rlike(f"[{block}]")
        out = F.when(hit, language) if out is None else out.when(hit, language)
    return out.otherwise(default)


def clean_text(text) -> Column:
    """P03. Remove URLs, e-mail addresses and symbols; single spaces between words.

    White space becomes plain spaces first, which keeps the character classes of the next steps small.
    """
    c = F.translate(col(text), WS_CHARS, " " * len(WS_CHARS))
    c = F.regexp_replace(c, "http[^ ]+|www[^ ]+", "")
    # anchored at the start of a run of non-spaces, so a long run without '@' costs one pass
    c = F.regexp_replace(c, "(?<![^ ])[^ ]+@[^ ]+", "")
    return F.btrim(F.regexp_replace(c, f"[^a-zA-Z0-9{TOKEN}]+", " "), F.lit(" "))


def preview(text, n: int = 300, ellipsis: str = "...", always: bool = False) -> Column:
    """P04. First ``n`` characters; the ellipsis only when something was cut, unless ``always``."""
    c = col(text)
    cut = F.concat(F.substring(c, 1, n), F.lit(ellipsis))
    return cut if always else F.when(F.length(c) > n, cut).otherwise(c)


def url_domain(url) -> Column:
    """P14. Host without a leading ``www.``; NULL when the URL does not parse."""
    return F.regexp_replace(F.try_parse_url(col(url), F.lit("HOST")), r"^www\.", "")


def locate_excerpt(text, excerpt) -> Column:
    """P16. Where a quoted excerpt starts in a text: struct(start, length), 1-based, NULL when absent.

    Positions count characters of the text with white space collapsed. The first 40 characters decide,
    then the first 25, then the first 40 without case; ``whole`` says whether the text has all of the excerpt.
    """
    wanted = excerpt_text(excerpt)
    body = collapse_spaces(text)
    head = F.substring(wanted, 1, 40)

    def found(needle: Column, haystack: Column) -> Column:
        return F.nullif(F.position(needle, haystack), F.lit(0))

    start = F.coalesce(
        found(head, body),
        F.when(F.length(head) > 20, found(F.substring(wanted, 1, 25), body)),
        found(F.lower(head), F.lower(body)),
    )
    span = F.least(F.length(wanted), F.length(body) - start + 1)
    return F.when(
        (F.length(wanted) >= 10) & start.isNotNull(),
        F.struct(start.cast("int").alias("start"), span.cast("int").alias("length"), F.contains(body, wanted).alias("whole")),
    )


def excerpt_text(excerpt) -> Column:
    """An excerpt as P16 looks for it: without quotation marks around it, with single spaces."""
    quote = "[\"'\u201c\u201d" + WS + "]"
    return strip(collapse_spaces(F.regexp_replace(col(excerpt), f"^{quote}+|{quote}+$", "")))


def resolve_url(base: str, href, skip_http: bool = True) -> Column:
    """P17. Absolute form of a link found on a page of ``base``; NULL for links that are not followed."""
    h = col(href)
    root = base.rstrip("/")
    out = F.when(h.startswith("https://"), h)
    if not skip_http:
        out = out.when(h.startswith("http://"), h)
    return (
        out.when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.startswith("/"), F.concat(F.lit(root), h))
        .otherwise(F.lit(None).cast("string"))
    )


def prefer_full_content(full, summary, min_len: int = 100) -> Column:
    """S09. The fetched text when it is longer than ``min_len``, else the summary; NULL when that is
    shorter than ``min_len``."""
    chosen = F.when(F.length(col(full)) > min_len, col(full)).otherwise(col(summary))
    return F.when(F.length(chosen) >= min_len, chosen)


def strip_boilerplate(text, patterns, head_marker: str | None, tail_marker: str | None, head: int = 200) -> Column:
    """S10. Remove page furniture: patterns in order, everything through the head marker when it sits in
    the first ``head`` characters, everything from the tail marker on; then tidy newlines and spaces."""
    c = col(text)
    for pattern in patterns:
        c = F.regexp_replace(c, "(?s)" + pattern, "")
    if head_marker:
        at = F.instr(c, head_marker)
        in_head = F.contains(F.substring(c, 1, head), F.lit(head_marker))
        c = F.when(in_head, F.substr(c, at + F.lit(len(head_marker)))).otherwise(c)
    if tail_marker:
        at = F.instr(c, tail_marker)
        c = F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c)
    c = F.regexp_replace(c, "\n+", "\n")
    c = F.regexp_replace(c, " +", " ")
    return strip(c)


def summary_lead(text, n: int = 300) -> Column:
    """T13. First ``n`` characters, always followed by an ellipsis."""
    return preview(text, n, always=True)


def normalize_name(name) -> Column:
    """J09. Single spaces inside, none around."""
    return strip(collapse_spaces(F.coalesce(col(name), F.lit(""))))


def session_title(text, n: int = 50) -> Column:
    """P19. Title of a chat session: its first user message, shortened."""
    return preview(text, n)
