"""JSON replies of varying shape to one record shape, by lists of the names that a field goes by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import clean_skill, let, strip

# Names of each field, the first with a value counts.
PERSONAL = {
    "name": "name fullName full_name", "email": "email emailAddress", "phone": "phone phoneNumber mobile", "location": "location address city",
    "linkedin": "linkedin linkedIn linkedinUrl", "portfolio": "portfolio website github",
}
SUMMARY = "summary objective profile professionalSummary"
EXPERIENCE_AT = "experience workExperience work_experience jobs"
EXPERIENCE = {
    "role": "role title jobTitle position designation", "company": "company employer organization companyName firm", "location": "location city place jobLocation",
    "start_date": "startDate start_date start from", "end_date": "endDate end_date end to",
}
DUTIES = "description responsibilities achievements duties bullets highlights summary"
EDUCATION_AT = "education educationHistory"
EDUCATION = {
    "school": "school institution university college name", "degree": "degree qualification credential award", "field": "field major fieldOfStudy field_of_study subject",
    "location": "location city place", "start_date": "startDate start_date start from", "end_date": "endDate end_date end to graduationYear", "description": "description notes activities",
}
SKILLS_AT = "skills technicalSkills technical_skills"
PRESENT = r"(?i)\b(present|current|now|ongoing)\b"


def text(v: Column, names: str, prefix: str = "$") -> Column:
    """The first of the names that holds a text or a number, else empty."""
    found = [F.nullif(strip(F.try_variant_get(v, f"{prefix}.{n}", "string")), F.lit("")) for n in names.split()]
    return F.coalesce(*found, F.lit(""))


def items(v: Column, names: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names.split()), F.array().cast("array<variant>"))


def truth(v: Column, names: str) -> Column:
    return F.lower(text(v, names)).isin("true", "yes")


def duties(v: Column) -> Column:
    """Lines of the description, which may be a list or a text."""
    lists = F.coalesce(*(F.try_variant_get(v, f"$.{n}", "array<string>") for n in DUTIES.split()))
    lines = F.coalesce(lists, F.split(text(v, DUTIES), "\n"))
    return F.array_join(F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != ""), "\n")


def skills(v: Column) -> Column:
    """Skills from a text with separators, a list of texts, or a list of objects; repeats go."""
    listed = F.flatten(F.transform(items(v, SKILLS_AT), lambda s: F.split(F.coalesce(F.nullif(text(s, "name skill value"), F.lit("")), F.try_variant_get(s, "$", "string"), F.lit("")), "[,;|]")))
    raw = F.when(F.size(items(v, SKILLS_AT)) > 0, listed).otherwise(F.split(text(v, SKILLS_AT), "[,;|]"))
    clean = F.filter(F.transform(raw, clean_skill), lambda s: s != "")
    return let(clean, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: F.lower(y)), F.lower(x)) == i + 1))


def record(json: Column) -> Column:
    """personal, summary, experience, education, skills of a reply (valid JSON; else all are empty)."""
    v = F.coalesce(F.try_parse_json(json), F.parse_json(F.lit("{}")))

    def person(p: Column) -> Column:
        at = [F.try_variant_get(p, "$.personal", "variant"), F.try_variant_get(p, "$.contact", "variant"), p]
        return F.struct(*(F.coalesce(*(F.nullif(text(a, names), F.lit("")) for a in at), F.lit("")).alias(k) for k, names in PERSONAL.items()))

    def job(x: Column) -> Column:
        end = text(x, EXPERIENCE["end_date"])
        now = truth(x, "current isCurrent is_current") | end.rlike(PRESENT)
        return F.struct(*(text(x, EXPERIENCE[k]).alias(k) for k in ("role", "company", "location", "start_date")), F.when(now, "Present").otherwise(end).alias("end_date"), now.alias("current"), duties(x).alias("description"))

    def school(x: Column) -> Column:
        return F.struct(*(text(x, names).alias(k) for k, names in EDUCATION.items()), truth(x, "current isCurrent enrolled").alias("current"))

    return F.struct(person(v).alias("personal"), text(v, SUMMARY).alias("summary"), F.transform(items(v, EXPERIENCE_AT), job).alias("experience"), F.transform(items(v, EDUCATION_AT), school).alias("education"), skills(v).alias("skills"))
