"""Text normalisation and layout as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Bullet glyphs of the first and the second level.
BULLETS_1 = "•▪●■‣❋❖"
BULLETS_2 = "◦○□⁃∙·–—"
# Code points that stand for a bullet in fonts without a character map.
CID_BULLETS = (8, 108, 110, 127, 129, 149, 155, 164, 165, 167, 168, 183, 216, 252, 8226, 8227, 9679, 9702, 61607, 61623)
#: White space as Unicode has it, for Java's regular expressions, which know ASCII alone by \s.
_FAR = "\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\u2000-\u200a"
#: The same characters one by one.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
WS = rf"\x09-\x0d\x1c-\x20{_FAR}"
INVISIBLE = "\u200b-\u200d\ufeff"


def let(value: Column, body) -> Column:
    """body(value) with value computed once; expressions that name a value often would else hold it as often."""
    return F.transform(F.array(value), body)[0]


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns, worked out once for each row. A filter on such columns would else be moved below them and hold all that they are made of, as often as they name it."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.inline(F.transform(F.array(F.lit(0)), lambda _: F.struct(*(v.alias(k) for k, v in columns.items())))))


def bounded(pattern: str) -> str:
    r"""The pattern with \b between ASCII's word characters and all others; Java's own takes letters of any script into words, though \w doesn't."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def strip(c: Column, more: str = "") -> Column:
    """Without white space (and the characters of more) at both ends."""
    if not more:
        return F.btrim(c, F.lit(WHITE))
    return F.regexp_replace(c, rf"^[{WS}{more}]+|[{WS}{more}]+$", "")


def repair_cids(c: Column) -> Column:
    """(cid:N) as the character N, a bullet, or nothing."""
    def char(token: Column) -> Column:
        code = F.regexp_extract(token, r"^\(cid:(\d{1,5})\)$", 1).try_cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
        shown = code.between(32, 126) | (code.between(161, 0x2FFF) & wide.rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S}]$"))
        return F.when(~token.rlike(r"^\(cid:\d{1,5}\)$"), token).when(code.isin(*CID_BULLETS), "•").when(shown, wide).otherwise("")

    tokens = F.regexp_extract_all(c, F.lit(r"(?s)\(cid:\d{1,5}\)|(?:(?!\(cid:\d{1,5}\)).)+"), F.lit(0))
    return F.when(F.contains(c, F.lit("(cid:")), F.array_join(F.transform(tokens, char), "")).otherwise(c)


#: Printable ASCII alone, matched in one run: a search for what is not would try each place by itself.
PLAIN = r"^[ -~]*\z"


def normalise(c: Column) -> Column:
    """Ligatures, quotes, invisible characters and runs of white space put right; tabs and line ends stay.

    Texts of ASCII, which most are, only lose blanks. What others need is decided by their characters beyond ASCII, which are few in
    most texts, so a long text isn't searched for each of them.
    """
    special = f"[{''.join(LIGATURES)}{INVISIBLE}\u2018\u2019\u201b\u201c\u201d]"

    def spelt(t: Column) -> Column:
        out = t
        for a, b in LIGATURES.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        out = F.regexp_replace(out, f"[{INVISIBLE}]", "")
        return F.translate(out, "\u2018\u2019\u201b\u201c\u201d", "'''\"\"")

    def spaced(t: Column, far: Column) -> Column:
        white = far.rlike(f"[{_FAR}]") | t.rlike(r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f]")
        blanks = F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t)
        return F.when(white, strip(F.regexp_replace(t, rf"[\x0b-\x0d\x1c-\x20{_FAR}]+", " "))).otherwise(F.trim(blanks))

    def full(t: Column) -> Column:
        return let(F.regexp_replace(t, r"[\x00-\x7f]+", ""), lambda far: let(F.when(far.rlike(special), spelt(t)).otherwise(t), lambda u: spaced(u, far)))

    plain = c.rlike(PLAIN) & ~F.contains(c, F.lit("  ")) & ~F.contains(c, F.lit("(cid:"))
    return F.when(plain, F.trim(c)).otherwise(let(repair_cids(F.coalesce(c, F.lit(""))), full))


def de_space(c: Column) -> Column:
    """Letter-spaced display text joined: groups apart by two spaces, mostly of single letters."""
    def group(g: Column) -> Column:
        tokens = F.filter(F.split(g, rf"[{WS}]+"), lambda t: t != "")
        single = F.size(F.filter(tokens, lambda t: F.char_length(t) == 1))
        return F.when((F.size(tokens) >= 4) & (single / F.size(tokens) >= 0.6), F.array_join(tokens, "")).otherwise(strip(g))

    joined = F.array_join(F.filter(F.transform(F.split(c, " {2,}"), group), lambda g: g != ""), " ")
    return F.when(F.char_length(c) < 5, c).otherwise(strip(joined))


def is_all_caps(c: Column) -> Column:
    """More than one ASCII letter, and no small one."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (F.char_length(letters) > 1) & (letters == F.upper(letters))


def is_all_caps_text(c: Column) -> Column:
    """The rule for pasted text: a letter of any script, and no small one."""
    return c.rlike(r"\p{L}") & (c == F.upper(c))


GLYPH = rf"^[{WS}]*([{BULLETS_1}{BULLETS_2}*+])[{WS}]*"
DASH = rf"^[{WS}]*[-‐][{WS}]+"
LETTER_O = rf"^[{WS}]*o(?:\t+| {{2,}}|\xa0+| (?=[A-Z(]))[{WS}]*"
NUMBERED = rf"^[{WS}]*(?:\(?[0-9]{{1,2}}[.)]|\(?[a-z][.)])[{WS}]+"


#: What any bullet begins with; most lines begin with a letter and need no further look.
MAY_MARK = rf"^[{WS}]*(?:\P{{L}}|o[{WS}]|[a-z][.)])"


def _starts(c: Column, pattern: str) -> Column:
    """c.rlike(pattern) for a pattern of ^ and some characters; a text without them is left at its first character, where rlike tries all places."""
    return F.regexp_extract(c, rf"^(?:({pattern.removeprefix('^')})|)", 1) != ""


def bullet_level(c: Column) -> Column:
    """0 for no bullet, 1 for the first level, 2 for the second."""
    glyph = F.regexp_extract(c, GLYPH, 1)
    long_ = F.char_length(c) > 12
    return F.when(~_starts(c, MAY_MARK), 0).when(_starts(c, GLYPH), F.when(F.instr(F.lit(BULLETS_1), glyph) > 0, 1).otherwise(2)).when(_starts(c, DASH), 2).when(_starts(c, LETTER_O) & long_, 2).when(_starts(c, NUMBERED) & long_, 1).otherwise(0)


def bullet_text(c: Column) -> Column:
    """The line without its bullet."""
    long_ = F.char_length(c) > 12
    cut = lambda p: strip(F.regexp_replace(c, p, ""))
    return F.when(~_starts(c, MAY_MARK), c).when(_starts(c, GLYPH), cut(GLYPH)).when(_starts(c, DASH), cut(DASH)).when(_starts(c, LETTER_O) & long_, cut(LETTER_O)).when(_starts(c, NUMBERED) & long_, cut(NUMBERED)).otherwise(c)


def clean_skill(c: Column) -> Column:
    """A skill without a label before it and without a bullet."""
    s = strip(F.coalesce(c, F.lit("")))
    bare = strip(F.regexp_replace(s, rf"^[A-Za-z][A-Za-z&/+ ]{{1,28}}:[{WS}]*(?=[^{WS}])", ""))
    s = F.when(bare != "", bare).otherwise(s)
    return strip(F.regexp_replace(s, rf"^[-*•▪●►➢➳▸][{WS}]*", ""))


def strip_metrics(c: Column) -> Column:
    """Amounts, percentages, factors and counted things taken out of a line."""
    number = r"\b[0-9][0-9,]*(\.[0-9]+)?"
    # What is counted.
    things = "users?|customers?|clients?|engineers?|members?|teams?|hours?|days?|weeks?|months?|years?|projects?|releases?|deployments?|servers?|nodes?|requests?|incidents?|tickets?"
    out = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(out, rf"\$[0-9,]+(\.[0-9]+)?[{WS}]*[kKmMbB]?\+?", "")
    out = F.regexp_replace(out, rf"{number}[{WS}]*%", "")
    out = F.regexp_replace(out, rf"{number}[{WS}]*(x|X)\b", "")
    out = F.regexp_replace(out, rf"(?i){number}\+?[{WS}]*({things})\b", "$1")
    out = F.regexp_replace(out, rf"[{WS}]{{2,}}", " ")
    out = F.regexp_replace(out, rf"[{WS}]+([.,;])", "$1")
    return strip(F.regexp_replace(out, rf"\([{WS}]*\)", ""))


def find_email(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}", 0), "[.,;]+$", "")


def normalise_url(c: Column) -> Column:
    value = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[.,;)]+$", "")
    return F.when((value == "") | value.rlike("(?i)^https?://"), value).otherwise(F.concat(F.lit("https://"), value))


def find_urls(c: Column) -> Column:
    """Web addresses: no domains of e-mails, no file names, no missing space after a full stop."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}", " ")
    shape = r"\b(?:https?://)?(?:www\.)?[A-Za-z0-9][A-Za-z0-9-]{0,61}\.[A-Za-z]{2,}(?:\.[A-Za-z]{2,})?(?:/[^\s,;)<>\]]*)?"
    found = F.transform(F.regexp_extract_all(bare, F.lit(shape), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", ""))
    return F.filter(found, lambda u: u.rlike(r"(?i)^(?:https?://)?[^\s/]+\.[a-z]{2,}") & ~u.rlike(r"(?i)\.(?:png|jpe?g|gif|svg|webp|pdf|docx?|pptx?)$") & ~u.rlike(r"^[a-z]+\.[A-Z]"))
