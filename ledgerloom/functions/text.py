"""Filing text: html to lines, numbered headers, header targets and keyword patterns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The headers' shape and the patterns of each target, in order of precedence.
HEADER = r"^\s*(?:\d{1,2}|[가-힣])\.\s+(\S.{0,48})\s*$"
NUMERIC_HEADER = r"^\s*\d{1,2}\.\s+"
TARGET_PATTERNS = {
    "overview": ("사업.{0,3}개요",),
    "products": ("주요.{0,3}제품", "제품.{0,3}서비스"),
    "revenue": ("매출", "수주.{0,3}현황"),
}
LEADING_GROUP = r"^\s*[\(\[\{].{1,30}?[\)\]\}]\s*"
LEADING_NUMERAL = r"^[①-⑳ⅠⅡⅢⅣⅤ㈠-㉃]+\s*"
WORD_GAP = r"[\s ·\-/,\.]+"
FILLERS = ("등", "및", "의", "이", "가", "을", "를", "에", "도", "는", "은", "와", "과")
MIN_KEYWORD = 3
MIN_SECTION = 300


# Named character references that filings use.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "middot": "·", "copy": "©", "reg": "®", "times": "×", "ndash": "–", "mdash": "—", "hellip": "…"}
_BLANKS = " \t\n\x0b\f\r\u00a0\u3000"
# What is not shown, and where tables begin and end. A pattern that begins with a sign is tried at that sign alone.
_UNSEEN = r"<(?is:!--.*?-->|(script|style)\b.*?</\1\s*>)"
_TABLE_ENDS = r"(?=<(?i:table)\b)|(?<=</(?i:table)>)"


def unescaped(s: Column) -> Column:
    """Character references as their characters: numeric ones, and the named ones above."""
    point = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")

    def piece(x: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(x, r"^&#(\d{1,7});", 1), F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]{1,6});", 1)
        sign = F.when(decimal != "", point(F.hex(decimal.cast("long")))).when(hexadecimal != "", point(hexadecimal))
        return F.when(sign.isNotNull(), F.concat(sign, F.regexp_replace(x, r"^&#\w+;", ""))).otherwise(x)

    numbered = F.when(s.contains("&#"), F.array_join(F.transform(F.split(s, "(?=&#)"), piece), "")).otherwise(s)
    for name, sign in ENTITIES.items():
        numbered = F.replace(numbered, F.lit(f"&{name};"), F.lit(sign))
    # Most pieces hold no reference at all: the branch is taken for those alone that do.
    return F.when(s.contains("&"), F.replace(numbered, F.lit("&amp;"), F.lit("&"))).otherwise(s)


def stripped(s: Column) -> Column:
    return F.btrim(s, F.lit(_BLANKS))


def _pieces(markup: Column) -> Column:
    """The stripped texts between tags."""
    return F.filter(F.transform(F.split(markup, "<[^>]*>"), lambda x: stripped(unescaped(x))), lambda x: x != "")


def _table(markup: Column) -> Column:
    """A line for each row with any text: its cells, each stripped of white space around tags, with tabs between them."""
    cells = lambda row: F.transform(F.regexp_extract_all(
        row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|$)"), 1
    ), lambda c: F.array_join(_pieces(c), ""))
    rows = F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|$)"), 1), cells)
    lines = F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, "\t"))
    return stripped(F.array_join(lines, "\n"))


def html_text(html: Column) -> Column:
    """Text of a page: comments, scripts and styles go; a table gives a line a row with tabs between cells; elsewhere each text between tags is stripped and begins a line.

    A table in a table's cell ends the outer one.
    """
    s = F.regexp_replace(html, _UNSEEN, "")
    parts = F.split(s, _TABLE_ENDS)
    texts = F.transform(parts, lambda x: F.when(x.rlike(r"(?i)^<table\b"), _table(x)).otherwise(F.array_join(_pieces(x), "\n")))
    return F.array_join(F.filter(texts, lambda x: x != ""), "\n")


def html_lines(html: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(html_text(html), "\r\n|[\r\n]"), lambda x: stripped(x) != "")


def content_lines(html: Column) -> Column:
    """The lines that are not blank, of all text between tags, tables' cells included as lines of their own."""
    s = F.regexp_replace(html, _UNSEEN, "")
    return F.filter(F.flatten(F.transform(_pieces(s), lambda x: F.split(x, "\r\n|[\r\n]"))), lambda x: stripped(x) != "")


def header_text(line: Column) -> Column:
    """The title of a numbered header line, or null."""
    found = F.regexp_extract(line, HEADER, 1)
    return F.when(line.rlike(HEADER), F.rtrim(found))


def header_target(title: Column, patterns: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The first target, in order, with a pattern that occurs in the title."""
    out = None
    for target, regexes in (patterns or TARGET_PATTERNS).items():
        hit = title.rlike("|".join(regexes))
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out


def keyword_pattern(header: Column) -> Column:
    """A pattern from a header's telling words, a gap of up to three characters between them; null if too little is left."""
    core = F.regexp_replace(header, LEADING_GROUP, "")
    core = F.trim(F.regexp_replace(core, LEADING_NUMERAL, ""))
    words = F.filter(F.split(core, WORD_GAP), lambda w: (F.length(w) >= 2) & ~w.isin(*FILLERS))
    escaped = F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.when(F.length(F.array_join(words, "")) >= MIN_KEYWORD, F.array_join(escaped, ".{0,3}"))


# ---- what notes are written with. The signs that names can't hold, and the longest name.

UNSAFE = r'[\\/:*?"<>|#^\[\]]'
NAME_MAX = 60


def safe_name(s: Column) -> Column:
    """A label without characters that file names or links can't hold."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, UNSAFE, " "), r"(?U)\s+", " "))


def note_name(label: Column) -> Column:
    """A note's file name: the safe label; a long one is cut and ends in a hash of the whole label."""
    safe = safe_name(label)
    return F.when(F.length(safe) <= NAME_MAX, safe).otherwise(F.concat_ws(" ", F.trim(F.substring(safe, 1, NAME_MAX)), F.substring(F.sha1(label.cast("binary")), 1, 6)))


def wikilink(label: Column) -> Column:
    """[[name]], or [[name|label]] where the name had to be cut."""
    name, safe = note_name(label), safe_name(label)
    return F.when(name == safe, F.concat(F.lit("[["), name, F.lit("]]"))).otherwise(F.concat(F.lit("[["), name, F.lit("|"), safe, F.lit("]]")))


def yaml_string(s: Column) -> Column:
    """A double-quoted scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def general(v: Column) -> Column:
    """A number with six significant digits and no trailing zeros, as C's %g writes it.

    Halves go to the even digit, and only what is a half in binary is one: the product with a power of ten is split into
    its rounded value and the exact rest. Numbers from a million on and below 0.0001 get an exponent; there halves of the
    shortest decimal go up.
    """
    v = v.cast("double")
    size = F.abs(v)
    scale = F.lit(1e9)
    for places in range(8, -1, -1):
        scale = F.when(size >= 10.0 ** (5 - places), 10.0**places).otherwise(scale)

    def rounded(x: Column) -> Column:
        size, scale = x["size"], x["scale"]  # at most 21 bits of the scale count, so both parts of the number give exact products
        product, front = size * scale, size.cast("float").cast("double")
        rest, low = (front * scale - product) + (size - front) * scale, F.floor(product)
        up = F.when(product - low != 0.5, product - low > 0.5).otherwise((rest > 0) | ((rest == 0) & (low % 2 == 1)))
        return (low + up.cast("long")).cast("double") / scale

    def said(x: Column) -> Column:
        short = F.when(x.cast("string").endswith(".0"), x.cast("long").cast("string")).otherwise(x.cast("string"))
        return F.when(x >= 0.001, short).otherwise(F.regexp_replace(F.format_string("%.9f", x), r"\.?0+$", ""))

    # A lambda makes its number once, and keeps the generated code small. Most numbers have no more than six digits, and need none.
    cut = F.element_at(F.transform(F.transform(F.array(F.struct(size.alias("size"), scale.alias("scale"))), rounded), said), 1)
    whole = size.cast("string")
    fixed = F.when((size >= 0.001) & (F.length(whole) <= 7), F.when(whole.endswith(".0"), F.substring_index(whole, ".", 1)).otherwise(whole)).otherwise(cut)
    exponent = F.regexp_replace(F.format_string("%.5e", size), r"\.?0+e", "e")
    out = F.when(size == 0, "0").when((size >= 0.00009999995) & (size < 999_999.5), fixed).otherwise(exponent)
    return F.when(v.isNotNull(), F.concat(F.when(v < 0, "-").otherwise(""), out))
