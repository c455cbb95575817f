"""Postings out of pages' elements: ordered lists of selectors, then what the text states, then the longest block of prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import elements as E
from foliant.operators import postings as P

# Where the pages of common boards keep a posting's fields, the surest first.
DESCRIPTION = (
    '[data-automation-id="jobPostingDescription"]', "#jobDescriptionText", ".jobs-description__content", ".jobs-box__html-content", "#job-details", ".job__description",
    "#job-post-description", ".posting-requirements", '[data-qa="job-description"]', ".job_description", "#job-description", ".job-sections", "#st-jobDescription",
    "#iCIMS_JobContent", ".iCIMS_JobContent", ".jobdescription", '[class*="jobDescription" i]', '[class*="job-description" i]', '[id*="job-description" i]', '[class*="posting-description" i]',
)
LOCATION = (
    '[data-testid="inlineHeader-companyLocation"]', ".jobsearch-JobInfoHeader-subtitle > div", ".jobs-unified-top-card__bullet", ".job-details-jobs-unified-top-card__bullet",
    '[data-automation-id="locations"]', ".job-location", ".job__location", ".location", ".posting-categories .location", ".iCIMS_JobHeaderLocationText", '[class*="jobLocation" i]', '[class*="job-location" i]',
)
COMPANY = (
    '[itemprop="hiringOrganization"]', ".jobs-unified-top-card__company-name", ".job-details-jobs-unified-top-card__company-name", '[data-testid="inlineHeader-companyName"]',
    ".jobsearch-InlineCompanyRating div a", ".company-name", '[class*="companyName" i]', '[class*="company-name" i]', '[data-testid*="company" i]',
)

FIELDS = ("title", "company", "location", "employment_type", "salary", "description", "source")


def from_elements(parsed: DataFrame) -> DataFrame:
    """The pages of `elements.parse_pages`, title and text replaced by a posting's fields: title, company, location, employment_type,
    salary, description and source, dom-known where a selector gave the description, else dom-generic."""
    elements, text = F.col("elements"), F.col("text")
    one_line = lambda c: F.translate(c, "\n", " ")
    flat = one_line(text)  # what a text states may stand on two lines
    # the fields are read beside the text; only the descriptions without a selector's hit need the blocks
    read = parsed.select(
        "*",
        F.coalesce(F.nullif(one_line(E.element_text(text, F.get(F.filter(elements, lambda e: e["tag"] == "h1"), F.lit(0)))), F.lit("")), X.strip(F.get(F.split("title", "[-|]"), F.lit(0)))).alias("_title"),
        F.coalesce(one_line(E.first_text(COMPANY, elements, text, 2, 200)), P.titled_company(F.col("title"))).alias("company"),
        F.coalesce(one_line(E.first_text(LOCATION, elements, text, 2, 200)), P.stated_location(flat)).alias("location"),
        P.employment_type(flat).alias("employment_type"),
        P.stated_salary(flat).alias("salary"),
        E.first_text(DESCRIPTION, elements, text, 81).alias("_known"),
    )
    known = F.col("_known").isNotNull()
    generic = E.prose_blocks(read.where(~known)).select("row", "start", "length")
    found = read.drop("title").join(generic, "row", "left")
    block = F.coalesce(F.substring(text, F.col("start") + 1, F.col("length")), X.strip(text))
    out = found.withColumns({"title": F.col("_title"), "description": F.coalesce("_known", block), "source": F.when(known, "dom-known").otherwise("dom-generic")})
    return out.select(*[c for c in parsed.columns if c not in ("title", "text", "elements")], *FIELDS)


def page_postings(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id",), closed: bool = False) -> DataFrame:
    """row, the carried columns and a posting's fields of each page: from its JSON-LD where it has a posting, else from its elements; closed as in `elements.parse_pages`."""
    found = pages.withColumn("_ld", P.json_ld(F.col(html)))
    parsed = E.parse_pages(found, html, (*carry, "_ld"), closed)
    stated = parsed.where("_ld is not null").select("row", *carry, *(F.col(f"_ld.{f}").alias(f) for f in FIELDS[:-1]), F.lit("json-ld").alias("source"))
    return stated.unionByName(from_elements(parsed.where("_ld is null")).select("row", *carry, *FIELDS))
