"""Checks of reported findings against local findings and the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X

NEAR_LINES, CONTENT_LINES, EVIDENCE_LINES = 3, 5, 15
LEAST_CLAIM, LEAST_EVIDENCE = 10, 15


def apart(df: DataFrame) -> DataFrame:
    """df, which a join moves by its key and never gives to every task by way of the driver. Spark guesses sizes from the files
    that a table is read from: findings and contents that are derived from a few MB may be many GB."""
    return df.hint("merge")


def drop_local_duplicates(found: DataFrame, local: DataFrame) -> DataFrame:
    """found without rows that a local finding of the same file and type has within three lines, or at the very same line
    where that is missing or 0.

    Lines meet by bands of four: a local finding is in its own band and in those beside it, so the bands are keys of a
    hash join, and a file with very many findings is dealt by them. Places that local findings share count once."""
    width = NEAR_LINES + 1
    band = F.floor(F.col("_l") / width)
    places = local.select(F.col("file").alias("_f"), F.col("type").alias("_t"), F.col("line").alias("_l")).distinct()
    bands = F.when(F.col("_l").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.array(band - 1, band, band + 1))
    other = places.withColumn("_b", F.explode(bands))
    near = ((F.col("line") != 0) & (F.abs(F.col("line") - F.col("_l")) <= NEAR_LINES)) | F.col("line").eqNullSafe(F.col("_l"))
    own = F.floor(F.col("line") / width).eqNullSafe(F.col("_b"))
    return found.join(apart(other), (F.col("file") == F.col("_f")) & (F.col("type") == F.col("_t")) & own & near, "left_anti")


def in_known_files(found: DataFrame, files: DataFrame) -> DataFrame:
    return found.join(apart(files.select(F.col("path").alias("file"))), "file", "left_semi")


def _window(line: Column, before: int, after: int) -> tuple[Column, Column]:
    """First line (from 0) and how many."""
    start = F.greatest(F.lit(0), line - before - 1)
    return start.cast("int"), (line + after - start).cast("int")


def context_window(content: Column, line: Column) -> Column:
    """The lines up to 15 before and after, each with its number."""
    rows = X.lines(content)
    start, n = _window(line, EVIDENCE_LINES, EVIDENCE_LINES)
    return F.array_join(F.transform(F.slice(rows, start + 1, F.greatest(n, F.lit(0))), lambda x, i: F.concat((start + i + 1).cast("string"), F.lit(": "), x)), "\n")


def correct_lines(found: DataFrame, files: DataFrame) -> DataFrame:
    """found with content_verified, without rows whose claimed line is not within five lines of the place they name; where
    it is, the line is set right. A claim of up to ten characters is not checked. Either text may contain the other, so
    a blank line bears out any claim. found: file, line, line_content, ...; files: path, content.

    The lines around a row's own are a slice of its file's lines, so nothing is joined line by line."""
    met = found.join(apart(files.select(F.col("path").alias("file"), "content")), "file", "left")
    return _corrected(met).drop("content")


def _corrected(met: DataFrame) -> DataFrame:
    """correct_lines of rows that have the content of their file (null: no such file)."""
    claim = X.normalized(F.col("line_content"))
    start, n = _window(F.col("line").cast("int"), CONTENT_LINES, CONTENT_LINES)
    met = met.withColumns({"_claim": claim, "_start": start})
    checked = F.coalesce((F.length("_claim") > LEAST_CLAIM) & (F.col("line") > 0) & F.col("content").isNotNull(), F.lit(False))
    around = F.slice(X.lines(F.col("content")), F.col("_start") + 1, F.greatest(n, F.lit(0)))
    flat = F.transform(around, X.normalized)
    hits = F.filter(F.transform(flat, lambda x, i: F.when(x.contains(F.col("_claim")) | F.col("_claim").contains(x), i)), lambda v: v.isNotNull())
    met = met.withColumn("_checked", checked).withColumn("_hit", F.when(F.col("_checked"), F.get(hits, F.lit(0))))
    met = met.where(~F.col("_checked") | F.col("_hit").isNotNull()).withColumn("content_verified", F.col("_checked"))
    line = F.when(F.col("_checked"), (F.col("_start") + F.col("_hit") + 1).cast(met.schema["line"].dataType)).otherwise(F.col("line"))
    return met.withColumn("line", line).drop("_claim", "_start", "_checked", "_hit")


def has_evidence(description: Column, evidence: Column, line: Column, content: Column) -> Column:
    """Whether a claim about security has a basis near its line, or its quoted evidence anywhere in the file."""
    start, n = _window(F.coalesce(F.nullif(line.cast("int"), F.lit(0)), F.lit(1)), EVIDENCE_LINES, EVIDENCE_LINES)
    region = F.array_join(F.slice(X.lines(content), start + 1, F.greatest(n, F.lit(0))), "\n")
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    quoted = X.normalized(evidence)
    quotes = (F.length(X.trimmed(evidence)) > LEAST_EVIDENCE) & (flat(region).contains(quoted) | flat(content).contains(quoted))
    told = F.lower(description)
    family: Column | None = None
    for keywords, needs in R.EVIDENCE:
        named, met = F.lit(True), F.lit(True)
        for words in keywords:
            one = F.lit(False)
            for w in words:
                one = one | told.contains(w)
            named = named & one
        for pattern in needs:
            met = met & region.rlike(pattern.replace(r"\b", R.B))
        family = F.when(named, met) if family is None else family.when(named, met)
    return F.coalesce(quotes, F.lit(False)) | family.otherwise(F.lit(False))


def require_evidence(found: DataFrame, files: DataFrame) -> DataFrame:
    """found without claims about security, high or critical, that nothing bears out. found has content_verified."""
    return _borne(found.join(apart(files.select(F.col("path").alias("file"), "content")), "file", "left")).drop("content")


def _borne(met: DataFrame) -> DataFrame:
    grave = F.coalesce((F.col("type") == "security") & F.col("severity").isin("high", "critical"), F.lit(False)) & ~F.col("content_verified")
    borne = F.col("content").isNull() | has_evidence(F.col("description"), F.col("evidence"), F.col("line"), F.col("content"))
    return met.where(F.when(grave, F.coalesce(borne, F.lit(False))).otherwise(F.lit(True)))


def verify(found: DataFrame, local: DataFrame, files: DataFrame) -> DataFrame:
    """All checks in their order: without findings that local ones tell already, of unknown files, misplaced or unfounded.
    The files' contents meet the findings once."""
    fresh = drop_local_duplicates(found, local)
    met = fresh.join(apart(files.select(F.col("path").alias("file"), "content")), "file")
    return _borne(_corrected(met)).drop("content_verified", "content")


def keep_real(found: DataFrame, verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows whose (batch, index) a verdict calls real; a row without a verdict goes."""
    by = by or ["batch", "index"]
    return found.join(apart(verdicts.where("is_real").select(*by)), by, "left_semi")


def suspicious_files(found: DataFrame, most: int = 5) -> DataFrame:
    """The first files with a finding, in order of first finding."""
    return found.groupBy("file").agg(F.min("seq").alias("first")).orderBy("first", "file").limit(most).select("file")
