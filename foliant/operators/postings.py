"""Job pages to structured postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import bounded, strip

# What a posting offers, by label and pattern.
HIGHLIGHTS = (
    ("H1B Sponsor Likely", r"\bh-?1b\b.{0,40}\b(sponsor|sponsorship)\b|\bsponsor(ship)?\b.{0,40}\bh-?1b\b|visa sponsorship available"),
    ("Medical coverage", r"\bmedical\s+(insurance|coverage|benefits)?\b"),
    ("Dental", r"\bdental\b"),
    ("Vision", r"\bvision\b"),
    ("401(k)", r"\b401\s?\(?k\)?\b"),
    ("Remote friendly", r"\bremote[- ]friendly\b|\bwork from home\b|\bfully remote\b"),
    ("Hybrid", r"\bhybrid\b"),
    ("Equity / stock options", r"\bequity\b|\bstock options\b|\bRSU\b"),
    ("Unlimited PTO", r"\bunlimited\s+(pto|vacation)\b"),
    ("Relocation assistance", r"\brelocation\s+(assistance|package|support)\b"),
    ("Security clearance required", r"\bsecurity clearance\b"),
    ("Bonus eligible", r"\bannual bonus\b|\bbonus eligible\b|\bperformance bonus\b"),
)
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
BLOCKS = "li|p|div|tr|h1|h2|h3|h4|h5|h6"


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles gone, line ends after blocks and at breaks, runs of blanks and lines cut."""
    out = F.coalesce(html, F.lit(""))
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", "")
    out = F.regexp_replace(out, r"(?i)<br\b[^>]*>", "\n")
    out = F.regexp_replace(out, rf"(?i)</({BLOCKS})\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[a-zA-Z/!][^>]*>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(out)


def title(html: Column) -> Column:
    """The first h1, else the page's title."""
    first = lambda tag: strip_html(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))
    return F.coalesce(F.nullif(first("h1"), F.lit("")), first("title"))


def link_density(html: Column) -> Column:
    """The share of a block's text that stands in links."""
    links = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), "")
    n = F.char_length(strip_html(html))
    return F.when(n > 0, F.char_length(strip_html(links)) / n).otherwise(0.0)


def highlights(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(bounded(f"(?i){p}")), label) for label, p in HIGHLIGHTS)))


def experience_years(text: Column) -> Column:
    """The first phrase of years, as in the text."""
    return F.regexp_extract(text, bounded(r"(?i)\b[0-9]{1,2}\+?\s*(?:(?:to|-|–|—)\s*[0-9]{1,2}\s*)?years?\b"), 0)


def seniority(text: Column) -> Column:
    return F.regexp_extract(text, bounded(r"(?i)\b(Senior|Junior|Mid[- ]?level|Entry[- ]?level|Lead|Principal|Staff)\b"), 1)


MARK = r"^[-•▪*●]\s*"
# How the section of requirements begins and ends.
HEAD_START = r"(?i)^(requirements?|qualifications?|minimum qualifications|basic qualifications|preferred qualifications|what (?:you.?ll|you will) need|what (?:you.?ll|you will) bring|what we.?re looking for|ideal candidate|who you are|about you|your profile|required skills|skills required|bonus points)\b"
HEAD_EXACT = r"(?i)^(skills?|must[- ]?haves?|nice to have)\s*:?\s*$"
NEXT_HEAD = r"(?i)^(benefits|perks|about (us|the company)|responsibilities|what you.?ll do)\b"


def qualifications(text: Column, most: int = 8) -> Column:
    """Lines of the requirements: up to 24 after their heading, or marked lines and lines of years where there is none."""
    bare = lambda x: strip(F.regexp_replace(x, MARK, ""))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(x)), lambda x: x != "")
    heading = lambda x: (bare(x) != "") & (F.char_length(bare(x)) <= 60) & (bare(x).rlike(HEAD_START) | bare(x).rlike(HEAD_EXACT))
    fits = lambda x: F.char_length(x).between(4, 90)
    first = lambda xs, test: F.array_position(F.transform(xs, lambda x: F.when(test(x), 1).otherwise(0)), 1)
    loose = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(MARK) | x.rlike(r"(?i)^[0-9]+\+?\s*years?\b")), bare), fits)
    after = F.transform(F.slice(lines, first(lines, heading).cast("int") + 1, F.lit(24)), bare)
    stop = first(after, lambda x: x.rlike(NEXT_HEAD))
    own = F.filter(F.when(stop > 0, F.slice(after, F.lit(1), stop.cast("int") - 1)).otherwise(after), fits)
    return F.slice(F.when(first(lines, heading) > 0, own).otherwise(loose), 1, most)


JOB_URL = r"(?i)\b(job|jobs|career|careers|greenhouse|lever\.co|workday|myworkdayjobs|jobright|ashbyhq|smartrecruiters|icims|taleo|dice|monster|ziprecruiter|breezy\.hr|recruitee|workable|bamboohr|successfactors|wellfound|glassdoor)\b"


def posting_score(source: Column, url: Column, employment_type: Column, n_qualifications: Column, n_skills: Column, description: Column) -> Column:
    """How much speaks for a page being a posting; 3 is enough."""
    signs = [
        (source.isin("json-ld", "dom-known"), 3), (url.rlike(JOB_URL), 1), (employment_type != "", 1), (n_qualifications > 0, 1), (n_skills >= 3, 1),
        (description.rlike(r"(?i)\b(responsibilities|qualifications|requirements|who you are|what you.?ll do|what you.?ll need)\b"), 1), (F.char_length(description) > 500, 1),
    ]
    out = F.lit(0)
    for sign, weight in signs:
        out = out + F.when(sign, weight).otherwise(0)
    return out


def is_posting(title_: Column, score: Column) -> Column:
    return (F.coalesce(title_, F.lit("")) != "") & (score >= 3)


def json_ld(html: Column) -> Column:
    """The first JobPosting of a page's JSON-LD: title, company, location, type, salary, description; null if there is none."""
    bodies = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""), F.lit(1))
    get = lambda v, path: F.try_variant_get(v, path, "string")
    flat = F.flatten(F.transform(bodies, lambda b: F.concat(
        F.array(F.try_parse_json(b)),
        F.coalesce(F.try_variant_get(F.try_parse_json(b), "$", "array<variant>"), F.array().cast("array<variant>")),
        F.coalesce(F.try_variant_get(F.try_parse_json(b), "$['@graph']", "array<variant>"), F.array().cast("array<variant>")),
    )))
    found = F.filter(flat, lambda v: F.coalesce(F.lower(get(v, "$['@type']")).contains("jobposting"), F.lit(False)))

    def posting(v: Column) -> Column:
        text = lambda path: F.coalesce(get(v, path), F.lit(""))
        listed = F.try_variant_get(v, "$.jobLocation[0]", "variant").isNotNull()
        at = lambda part: F.coalesce(F.when(listed, get(v, f"$.jobLocation[0].address.{part}")).otherwise(get(v, f"$.jobLocation.address.{part}")), F.lit(""))
        second = F.when(at("addressRegion") != "", at("addressRegion")).otherwise(at("addressCountry"))
        place = F.array_join(F.filter(F.array(at("addressLocality"), second), lambda x: x != ""), ", ")
        remote = (place == "") & F.lower(text("$.jobLocationType")).contains("telecommute")
        return F.struct(
            text("$.title").alias("title"), text("$.hiringOrganization.name").alias("company"), F.when(remote, "Remote").otherwise(place).alias("location"),
            F.coalesce(get(v, "$.employmentType[0]"), text("$.employmentType")).alias("employment_type"), salary(v).alias("salary"), strip_html(get(v, "$.description")).alias("description"),
        )

    def salary(v: Column) -> Column:
        """A range, or one value; an end that is missing or 0 makes no range."""
        amount = lambda k: F.nullif(get(v, f"$.baseSalary.value.{k}").try_cast("double"), F.lit(0.0))
        shown = lambda x: F.concat(F.lit("$"), F.regexp_replace(F.call_function("format_number", x, F.lit("#,##0.###")), r"\.$", ""))
        low, high, one = amount("minValue"), amount("maxValue"), amount("value")
        unit = F.lower(F.coalesce(get(v, "$.baseSalary.value.unitText"), F.lit("")))
        figure = F.when(low.isNotNull() & high.isNotNull(), F.concat(shown(low), F.lit(" - "), shown(high))).otherwise(shown(one))
        return F.coalesce(F.concat(figure, F.when(unit != "", F.concat(F.lit("/"), unit)).otherwise("")), F.lit(""))

    return F.get(F.transform(found, posting), F.lit(0))


# Kinds of employment, amounts and country names as pages state them.
EMPLOYMENT = r"(?i)\b(Full[- ]?time|Part[- ]?time|Contract|Internship|Temporary|Freelance)\b"
_AMOUNT = r"\$\s?\d{1,3}(?:[,\d]{0,10})?(?:K|k)?\s?(?:/(?:yr|hr|year|hour))?"
COUNTRY_NAMES = (
    "United States", "United Kingdom", "Canada", "Australia", "India", "Germany", "France", "Ireland", "Singapore", "Netherlands", "Spain", "Italy",
    "Japan", "China", "Brazil", "Mexico", "Poland", "Sweden", "Switzerland", "Israel", "UAE", "New Zealand", "Philippines",
)
NO_COMPANY = ("least", "any", "all", "this", "that", "our", "the", "once", "first", "no", "present", "a", "scale", "an", "time", "work", "least once")


def employment_type(text: Column) -> Column:
    return F.regexp_extract(text, bounded(EMPLOYMENT), 1)


def stated_salary(text: Column) -> Column:
    """The first range of dollar amounts, without blanks."""
    return F.regexp_replace(F.regexp_extract(text, rf"{_AMOUNT}\s?-\s?{_AMOUNT}", 0), r"\s+", "")


def stated_location(text: Column) -> Column:
    """City and country, else city and a state's two letters, as a page's text has them."""
    city = r"[A-Z][a-zA-Z.]+(?:\s[A-Z][a-zA-Z.]+)?"
    country = F.regexp_extract(text, bounded(rf"\b({city},\s?(?:{'|'.join(COUNTRY_NAMES)}))\b"), 1)
    return F.coalesce(F.nullif(country, F.lit("")), F.regexp_extract(text, bounded(rf"\b({city},\s?[A-Z]{{2}})\b"), 1))


def titled_company(title_: Column) -> Column:
    """The employer that a page's title names: after `at`, or the second of three parts or more between dashes or bars."""
    after = F.trim(F.regexp_extract(title_, bounded(r"\bat\s+([A-Z][\w&.,'\- ]{1,40})\b"), 1))
    parts = F.filter(F.transform(F.split(title_, r"\s[-|–]\s"), lambda x: strip(x)), lambda x: x != "")
    named = F.when((after != "") & ~F.lower(after).isin(*NO_COMPANY), after)
    return F.coalesce(named, F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))), F.lit(""))


def page_posting(html: Column) -> Column:
    """What a page without JSON-LD states of a posting: title, company, location, employment type, salary."""
    text = strip_html(html)
    page_title = strip_html(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))

    def of(t: Column) -> Column:
        return F.struct(title(html).alias("title"), titled_company(page_title).alias("company"), stated_location(t).alias("location"), employment_type(t).alias("employment_type"), stated_salary(t).alias("salary"))

    return F.transform(F.array(text), of)[0]


def description_or_made(description: Column, title_: Column, company: Column, skills: Column, notes: Column) -> Column:
    """A posting's description, else one made of its title, employer, skills and notes."""
    text = lambda c: F.coalesce(c, F.lit(""))
    named = F.array_join(F.filter(skills, lambda x: x != ""), ", ")
    asked = F.when(text(named) != "", F.concat(F.lit("Key skills: "), named, F.lit(". "))).otherwise("")
    made = strip(F.concat(text(title_), F.lit(" at "), text(company), F.lit(". "), asked, text(notes)))
    return F.coalesce(F.nullif(strip(description), F.lit("")), made)
