"""Detectors on single documents; each gives rows (doc_id, name, severity, ...) for what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.money import dates
from ..functions.text import first_match

#: Editing software that metadata may show, in the order in which it is reported.
SOFTWARE = ["photoshop", "illustrator", "gimp", "canva", "figma", "quartz pdfcontext", "liberation", "libreoffice", "acrobat", "pdf2go", "ilovepdf", "pdfescape", "smallpdf"]
IMAGE_SOFTWARE = ["photoshop", "illustrator", "gimp", "canva", "figma", "sketch", "affinity", "inkscape", "corel", "paint.net", "pixlr", "photoscape", "fotor", "befunky", "snapseed"]
TYPOS = ["satement", "adhaar", "adhar", "pancard", "unon bank", "canara bankk"]
OFFICIAL = ["bank statement", "account statement", "transaction history", "certificate", "digitally signed", "authorized signatory", "official document", "verified", "authenticated"]
CONSUMER_FONTS = ["arial", "times", "calibri", "cambria", "comic", "georgia", "verdana", "trebuchet", "segoe", "tahoma", "impact", "palatino", "garamond", "bookman"]
BANK_FONTS = ["courier", "ocr", "micr", "bank", "monospace", "code", "consolas", "lucida", "fixed"]
RENTAL, DEPOSITS = ["rental income", "rent roll", "monthly rent", "lease payment"], ["deposit", "credit", "paid in", "received"]
P2P = ["venmo", "zelle", "cash app", "paypal", "cash payment"]
#: The catalogue of signals: id, name, severity, weight.
SIGNALS = [
    ("altered_bank_math", "Altered Bank Statement Math", "high", 40),
    ("pdf_metadata_anomalies", "PDF Metadata Anomalies", "high", 40),
    ("phantom_rental_income", "Phantom Rental Income", "high", 38),
    ("forged_tax_transcripts", "Forged Tax Transcripts", "high", 40),
    ("reverse_occupancy", "Reverse Occupancy", "high", 35),
    ("undisclosed_mortgages", "Undisclosed Mortgages", "high", 38),
    ("fabricated_leases", "Fabricated Leases", "high", 40),
    ("shell_company_concealment", "Shell Company Concealment", "high", 38),
    ("collusive_appraisals", "Collusive Appraisals", "high", 40),
    ("straw_buyers", "Straw Buyers", "high", 40),
    ("bogus_earnest_money", "Bogus Earnest Money", "high", 40),
    ("identity_tampering", "Identity Document Tampering", "high", 40),
    ("sudden_account_seasoning", "Sudden Account Seasoning", "medium", 25),
    ("inflated_market_rent", "Inflated Market Rent", "medium", 28),
    ("non_arms_length_leases", "Non-Arm's Length Leases", "medium", 25),
    ("orphaned_property_expenses", "Orphaned Property Expenses", "medium", 25),
    ("hidden_down_payment_loans", "Hidden Down Payment Loans", "medium", 28),
    ("unjustified_property_flipping", "Unjustified Property Flipping", "medium", 25),
    ("unverifiable_liquidity", "Unverifiable Liquidity", "medium", 22),
    ("commingled_funds", "Commingled Funds", "medium", 20),
    ("geographic_inconsistencies", "Geographic Inconsistencies", "medium", 25),
    ("pfs_tax_discrepancies", "PFS vs. Tax Discrepancies", "medium", 28),
    ("frequent_address_hopping", "Frequent Address Hopping", "medium", 20),
    ("inconsistent_name_variations", "Inconsistent Name Variations", "low", 8),
    ("missing_statement_pages", "Missing Statement Pages", "low", 12),
    ("sloppy_pfs_formatting", "Sloppy PFS Formatting", "low", 8),
    ("irregular_rent_deposits", "Irregular Rent Deposits", "low", 10),
    ("stale_documentation", "Stale Documentation", "low", 10),
    ("handwritten_lease_corrections", "Handwritten Lease Corrections", "low", 12),
    ("unexplained_micro_debits", "Unexplained Micro-Debits", "low", 8),
    ("newly_minted_llcs", "Newly Minted LLCs", "low", 12),
    ("po_box_business_addresses", "PO Box Business Addresses", "low", 10),
    ("misaligned_job_titles", "Misaligned Job Titles", "low", 12),
    ("verbal_omissions", "Verbal Omissions", "low", 8),
]
DETECTED = ["altered_bank_math", "pdf_metadata_anomalies", "phantom_rental_income", "inflated_market_rent", "sudden_account_seasoning", "missing_statement_pages", "stale_documentation", "irregular_rent_deposits"]


def catalogue(spark: SparkSession) -> DataFrame:
    """(signal, name, severity, weight, has_detector)."""
    rows = [(k, n, s.upper(), w, k in DETECTED) for k, n, s, w in SIGNALS]
    return spark.createDataFrame(rows, "signal string, name string, severity string, weight int, has_detector boolean")


def contained(c: Column, words: list[str]) -> Column:
    """Those of the words that occur, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: c.contains(w))


def any_of(c: Column, words: list[str]) -> Column:
    return F.size(contained(c, words)) > 0


def payslip_math(docs: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc_id, gross, deductions, net, mismatch) of texts that show all three."""
    number = r"[:\s\-]*([0-9,]+\.\d{2}|[0-9,]+)"

    def value(words: str) -> Column:
        return F.replace(first_match(F.col("text"), rf"(?i)(?:{words}){number}", 1), F.lit(","), F.lit("")).try_cast("decimal(18,2)")

    amounts = F.struct(value(r"gross|basic|earnings|total\s+earnings|gross\s+salary").alias("gross"), value(r"deduction|total\s+deductions|deductions").alias("deductions"), value(r"net|net\s+pay|take\s+home|salary\s+amount|net\s+salary").alias("net"))
    found = docs.select("doc_id", F.inline(F.array(amounts)))  # a generator's columns are computed once, filters on them stay above it
    return found.dropna().withColumn("mismatch", F.abs(F.col("gross") - F.col("deductions") - F.col("net")) > tolerance)


def date_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, date, format) of every date in the texts."""
    return docs.select("doc_id", F.inline(dates(F.col("text"))))


def date_findings(docs: DataFrame, as_of: str) -> DataFrame:
    """Impossible and future dates and mixed notations, one finding of a kind per document."""
    sums = date_rows(docs).groupBy("doc_id").agg(
        F.bool_or(F.col("format") == "INVALID").alias("bad"), F.bool_or(F.col("date") > F.lit(as_of).cast("date")).alias("late"),
        F.countDistinct(F.when(F.col("format") != "INVALID", F.col("format"))).alias("formats"),
    )
    kinds = F.array(*[F.when(c, F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for c, n, s in ((F.col("bad"), "Impossible Date", "CRITICAL"), (F.col("late"), "Future Date", "HIGH"), (F.col("formats") > 1, "Mixed Date Formats", "MEDIUM"))])
    return sums.select("doc_id", F.inline(F.array_compact(kinds)))


def _kinds(*rules: tuple[Column, str, str]) -> Column:
    return F.inline(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for c, n, s in rules])))


def revisions(files: DataFrame) -> DataFrame:
    """(doc_id, name, severity) by revision marks in raw files (text in ISO-8859-1)."""
    ends, links = F.regexp_count("raw", F.lit("%%EOF")), F.regexp_count("raw", F.lit(r"/Prev\s+\d+"))
    return files.select("doc_id", _kinds((ends > 1, "Multiple PDF Revisions", "HIGH"), (links > 0, "PDF Incremental Update Trace", "MEDIUM")))


def signatures(files: DataFrame) -> DataFrame:
    """Missing, incomplete and overwritten signatures by their marks in raw files; no cryptography."""
    sig, ranged, cert = F.col("raw").rlike(r"/Type\s*/Sig"), F.col("raw").contains("/ByteRange"), F.col("raw").rlike("/Cert|/PKCS")
    official = any_of(F.lower(F.coalesce("text", F.lit(""))), OFFICIAL)
    whole = sig & ranged
    return files.select("doc_id", _kinds((whole & ~cert, "Incomplete Digital Signature", "MEDIUM"), (~whole & official & ~sig, "Missing Digital Signature", "MEDIUM"), ((F.regexp_count("raw", F.lit("%%EOF")) > 2) & sig, "Signature Integrity Concern", "HIGH")))


def software(files: DataFrame, words: list[str] = SOFTWARE) -> DataFrame:
    """A HIGH finding for each program that the producer or creator names."""
    named = F.lower(F.concat_ws("\n", "producer", "creator"))
    return files.select("doc_id", F.explode(contained(named, words)).alias("software"), F.lit("Editing Software Signature").alias("name"), F.lit("HIGH").alias("severity"))


def date_mismatch(files: DataFrame) -> DataFrame:
    return files.where(F.col("created").isNotNull() & F.col("modified").isNotNull() & (F.col("created") != F.col("modified"))).select("doc_id", F.lit("Metadata Date Mismatch").alias("name"), F.lit("MEDIUM").alias("severity"))


def typos(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{w}\b"), F.lit(w)) for w in TYPOS]))
    return docs.select("doc_id", F.explode(found).alias("typo"), F.lit("Template Spelling Anomaly").alias("name"), F.lit("MEDIUM").alias("severity"))


def error_levels(images: DataFrame) -> DataFrame:
    """Images whose recompression differs too much (mean over 3.0 or deviation over 4.5)."""
    return images.where((F.col("mean_diff") > 3.0) | (F.col("std_diff") > 4.5)).select("doc_id", F.lit("Error Level Anomaly").alias("name"), F.lit("HIGH").alias("severity"))


def font_findings(spans: DataFrame) -> DataFrame:
    """Too many families, bank and consumer families mixed, and rare sizes far from the main one."""
    base = F.trim(F.split(F.split(F.lower("font"), "-")[0], ",")[0])
    families = spans.withColumn("base", base).groupBy("doc_id").agg(F.countDistinct("base").alias("n"), F.bool_or(any_of(base, CONSUMER_FONTS)).alias("consumer"), F.bool_or(any_of(base, BANK_FONTS)).alias("bank"))
    out = families.select("doc_id", _kinds((F.col("n") > 4, "Font Inconsistency", "HIGH"), (F.col("consumer") & F.col("bank"), "Mixed Font Origin", "HIGH")))
    odd = odd_sizes(spans).select("doc_id", F.lit("Font Size Anomaly").alias("name"), F.lit("LOW").alias("severity")).distinct()
    return out.unionByName(odd)


def odd_sizes(spans: DataFrame) -> DataFrame:
    """(doc_id, size, n, main): sizes over 2 points from the main one (of equals the smallest) with under 5 % of the spans."""
    counted = spans.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.count("*").alias("n"))
    main = counted.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("main"), F.sum("n").alias("all"))
    return counted.join(main, "doc_id").where((F.abs(F.col("size") - F.col("main")) > 2.0) & (F.col("n") < F.col("all") * 0.05)).select("doc_id", "size", "n", "main")


def lease_signals(docs: DataFrame, as_of: str | None = None) -> DataFrame:
    """(doc_id, signal) of rental and statement texts."""
    low = F.lower("text")
    rents = F.transform(F.regexp_extract_all(low, F.lit(r"rent[:\s]+[\$£€]?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    mean = F.aggregate(rents, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(rents), F.lit(0))
    pages = F.regexp_extract_all(low, F.lit(r"page\s+\d+\s+of\s+\d+"), F.lit(0))
    missing = F.exists(pages, lambda p: F.regexp_extract(p, r"page\s+(\d+)", 1).cast("int") != F.regexp_extract(p, r"of\s+(\d+)", 1).cast("int"))
    rules = [(any_of(low, RENTAL) & ~any_of(low, DEPOSITS), "phantom_rental_income"), (mean > 5000, "inflated_market_rent"), (F.regexp_count(low, F.lit(r"deposit[:\s]+[\$£€]?\s*([5-9]\d{3,}|[1-9]\d{4,})")) >= 2, "sudden_account_seasoning"), (missing, "missing_statement_pages"), (any_of(low, P2P), "irregular_rent_deposits")]
    if as_of:
        rules.append((F.datediff(F.lit(as_of).cast("date"), oldest_date(F.col("text"))) > 90, "stale_documentation"))
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in rules]))).alias("signal"))


def oldest_date(text: Column) -> Column:
    """The oldest date of a text; day first, then month first, years of four and of two digits."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"), F.lit(1))

    def read(x: Column) -> Column:
        a, b, y = (F.regexp_extract(x, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", g) for g in (1, 2, 3))
        year = F.when(F.length(y) == 4, y).when((F.length(y) == 2) & (y < "69"), F.concat(F.lit("20"), y)).when(F.length(y) == 2, F.concat(F.lit("19"), y))
        whole = lambda m, d: F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        return F.coalesce(whole(b, a), whole(a, b))

    return F.array_min(F.array_compact(F.transform(found, read)))


def find_column(headers: Column, words: list[str]) -> Column:
    """The place (from 0) of the first header that has one of the words whole; null if none has."""
    at = F.array_position(F.transform(headers, lambda h: F.lower(h).rlike(r"\b(?:" + "|".join(words) + r")\b")), True)
    return F.when(at > 0, (at - 1).cast("int"))
