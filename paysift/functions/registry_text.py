"""Company-registry text rules: identifiers, addresses, dates, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts in the order in which they are tried.
DATE_FORMATS = ("dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MMM-yyyy", "dd-MMM-yy", "dd/MM/yy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss")
# The shape each layout accepts, so a two-digit year is never read by a four-digit layout.
DATE_SHAPES = (r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}-[A-Za-z]{3}-\d{4}", r"\d{1,2}-[A-Za-z]{3}-\d{2}", r"\d{1,2}/\d{1,2}/\d{2}",
               r"\d{4}/\d{1,2}/\d{1,2}", r"\d{1,2}\.\d{1,2}\.\d{4}", r"\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}")
# Words for a missing value, and the shapes of company and partnership identifiers.
NA_WORDS = ("NA", "N/A", "-", "NULL", "NONE", "NAN")
CIN_SHAPE = r"^[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}$"
LLPIN_SHAPE = r"^[A-Z]{3}-\d{4}$"
# Words an address key ignores.
ADDRESS_NOISE = ("NO", "NUMBER", "FLAT", "FLOOR", "FL", "OFFICE", "OFF", "ROAD", "RD", "STREET", "ST", "NEAR", "NR", "OPP", "OPPOSITE", "INDIA", "IN")
# Status fragments and their severity, first match wins.
INACTIVE = (
    ("strike off", "high"), ("struck off", "high"), ("under process of striking off", "high"), ("dormant", "medium"), ("dissolved", "high"), ("liquidated", "high"),
    ("under liquidation", "high"), ("converted to llp", "low"), ("amalgamated", "low"), ("not available for efiling", "medium"),
)


def normal_cin(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))


def normal_din(c: Column) -> Column:
    """Eight digits; spreadsheets drop leading zeros and add '.0'. Longer numbers stay as they are."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""), r"\.0$", "")
    return F.when(s.rlike(r"^\d+$"), F.when(F.length(s) < 8, F.lpad(s, 8, "0")).otherwise(s)).otherwise(F.upper(s))


def valid_company_id(c: Column) -> Column:
    return c.rlike(CIN_SHAPE) | c.rlike(LLPIN_SHAPE)


def cin_facts(c: Column) -> Column:
    company, llp = c.rlike(CIN_SHAPE), c.rlike(LLPIN_SHAPE)
    def part(a: int, n: int) -> Column:
        return F.when(company, F.substring(c, a, n))
    return F.struct(
        (company | llp).alias("valid"), F.when(company, "company").when(llp, "llp").otherwise("unknown").alias("kind"), F.when(company, F.substring(c, 1, 1) == "L").alias("listed"),
        part(2, 5).alias("industry"), part(7, 2).alias("state"), part(9, 4).cast("int").alias("year"), part(13, 3).alias("type"))


def address_key(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.upper(c), r"\.", ""), r"[^A-Z0-9 ]", " ")
    s = F.regexp_replace(s, r"\b([A-Z])\s+(?=[A-Z]\b)", "$1")
    s = F.regexp_replace(s, r"\b(" + "|".join(ADDRESS_NOISE) + r")\b", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(s) > 0, s)


def parse_date(c: Column) -> Column:
    s = F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 19)
    s = F.when((s != "") & ~F.upper(s).isin(*NA_WORDS), s)
    tries = [F.when(s.rlike(f"^{shape}$"), F.try_to_timestamp(s, F.lit(fmt.replace("dd", "d").replace("MM", "M") if "MMM" not in fmt else fmt.replace("dd", "d")))) for fmt, shape in zip(DATE_FORMATS, DATE_SHAPES)]
    return F.coalesce(*tries).cast("date")


def parse_amount(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.\-]", "")
    return F.when(s != "", s).try_cast("double")


def parse_year(c: Column) -> Column:
    y = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:19|20)\d{2}", 0)
    return F.when(y != "", y).cast("int")


def status_severity(status: Column) -> Column:
    """Severity of an inactive status; null for an active or missing one, medium for an unknown one."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    out = None
    for fragment, sev in INACTIVE:
        out = (F.when(s.contains(fragment), sev) if out is None else out.when(s.contains(fragment), sev))
    return F.when((s != "") & (s != "active"), out.otherwise("medium"))
