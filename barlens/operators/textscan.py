"""Scans of code and text columns.  Whole texts; each text is scanned inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: (pattern, severity) of look-ahead hazards in strategy code, one line at a time
LEAKAGE_RULES = (
    (r"\.shift\(\s*-[1-9]", "critical"),
    (r"iloc\[.{0,20}\+\s*[1-9]", "critical"),
    (r"\.pct_change\(\s*-[1-9]", "critical"),
    (r"\.diff\(\s*-[1-9]", "critical"),
    (r"rolling\([^)]*\)\s*\.mean\(\)\s*\.fillna\(", "warning"),
    (r"\.fillna\(method=['\"]bfill['\"]", "critical"),
    (r"\.fillna\(method=['\"]backfill['\"]", "critical"),
    (r"bfill\(\)", "critical"),
    (r"pd\.DataFrame\(.*\)\.sort_values\(.*ascending=False", "warning"),
    (r"train_test_split.*shuffle\s*=\s*True", "critical"),
    (r"StandardScaler|MinMaxScaler|RobustScaler", "warning"),
    (r"\.fit\(.*self\.data", "critical"),
    (r"np\.argmax|np\.argmin", "warning"),
)
# a pandas_ta call anywhere after the head of next()
CALL_IN_NEXT = r"def next[^\n]*:\s*\n[\s\S]*pandas_ta\."


def leakage_scan(table: DataFrame, code: str, threshold: float = 7.0) -> DataFrame:
    """Adds critical and warning counts, the score from 10 down, and whether it passes."""
    text = F.col(code)
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*#"))

    def hits(severity: str) -> Column:
        def per_line(acc: Column, line: Column) -> Column:
            for pattern, level in LEAKAGE_RULES:
                if level == severity:
                    acc = acc + line.rlike(f"(?i){pattern}").cast("int")
            return acc
        return F.aggregate(lines, F.lit(0), per_line)

    def has(s: str) -> Column:
        return F.contains(text, F.lit(s))

    no_class = (~has("class") & ~has("def next")).cast("int")
    no_indicator = (~has("self.I(") & has("def init")).cast("int")
    in_next = text.rlike(CALL_IN_NEXT).cast("int")
    scanned = table.withColumns({"critical": hits("critical") + no_class + in_next, "warnings": hits("warning") + no_indicator})
    score = F.greatest(F.lit(0.0), 10 - 2.5 * F.col("critical") - 0.5 * F.col("warnings"))
    return scanned.withColumn("score", F.round(score, 1)).withColumn("passed", F.col("score") >= threshold)


def salvage_json_array(raw: Column) -> Column:
    """A cut-off JSON array closed after its last complete object, as VARIANT; null if it still does not parse."""
    upto = F.regexp_extract(raw, r"(?s)^(.*\})", 1)
    body = F.concat(F.regexp_replace(F.rtrim(upto), r",+$", ""), F.lit("\n]"))
    closed = F.when(F.ltrim(body).startswith("["), body).otherwise(F.concat(F.lit("["), body))
    return F.when(upto != "", F.try_parse_json(closed))


def validate_entries(entries: DataFrame) -> DataFrame:
    """Entries with a category and a summary of five characters; unknown categories become 'partial'."""
    known = F.col("category").isin("works", "fails", "partial", "edge_case")
    ok = F.col("category").isNotNull() & (F.col("category") != "") & (F.length(F.trim("summary")) >= 5)
    return entries.where(F.coalesce(ok, F.lit(False))).withColumn("category", F.when(known, F.col("category")).otherwise("partial"))


def paper_rows(papers: DataFrame, shown: int | None = None) -> DataFrame:
    """Usable papers: a title, an abstract of 50 characters, and a link (arXiv before DOI before the site's id).

    The test is on the whole abstract; ``shown`` shortens only what is displayed.
    """
    link = F.coalesce(
        F.concat(F.lit("https://arxiv.org/abs/"), F.nullif(F.col("arxiv_id"), F.lit(""))),
        F.concat(F.lit("https://doi.org/"), F.nullif(F.col("doi"), F.lit(""))),
        F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.nullif(F.col("paper_id"), F.lit(""))))
    text = F.col("abstract") if shown is None else F.substring("abstract", 1, shown)
    return papers.where((F.trim("title") != "") & (F.length("abstract") >= 50)).withColumn("url", link).where(
        "url IS NOT NULL").withColumn("abstract", text)


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")
