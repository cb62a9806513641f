"""Findings as models and agents report them: JSON of any shape, wrapped or amid prose, taken apart without losing good
elements to bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import rules as R


def _text_of(v: Column, path: str) -> Column:
    """A field if it is a JSON string."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, path, "string"))


def _number_of(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got).rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def issue_fields(v: Column) -> dict[str, Column]:
    """An issue's fields of a JSON object; what is missing or of another type gets its default."""
    kind, severity = _text_of(v, "$.type"), _text_of(v, "$.severity")
    return {
        "type": F.when(kind.isin(*R.TYPES), kind).otherwise("lint"),
        "severity": F.when(severity.isin(*R.SEVERITIES), severity).otherwise("medium"),
        "file": F.coalesce(F.nullif(_text_of(v, "$.file"), F.lit("")), F.lit("unknown")),
        "line": _number_of(v, "$.line"),
        "description": F.coalesce(F.nullif(_text_of(v, "$.description"), F.lit("")), F.lit("Unknown issue")),
        "evidence": _text_of(v, "$.evidence"),
        "line_content": _text_of(v, "$.line_content"),
    }


def with_document(answers: DataFrame, raw: str, dialect: str = "scan") -> DataFrame:
    """answers with _doc, the JSON document of an answer as a variant; null if there is none.

    scan: the whole text, else from its first { to its last }. loop and results: the `result` of a wrapper if it has one,
    then from the first { before "issues" or "results" to the last }. Each step is a column of its own, so that no text is
    parsed twice."""
    rows = answers.withColumn("_whole", F.try_parse_json(F.col(raw)))
    if dialect == "scan":
        inside = F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))
        return rows.withColumn("_doc", F.coalesce("_whole", F.when(F.col("_whole").isNull(), inside))).drop("_whole")
    word = {"loop": "issues", "results": "results"}[dialect]
    rows = rows.withColumn("_result", F.try_variant_get("_whole", "$.result", "variant"))
    told = F.when(F.schema_of_variant("_result") == "STRING", F.nullif(F.try_variant_get("_result", "$", "string"), F.lit("")))
    said = F.when(F.schema_of_variant("_whole") == "STRING", F.try_variant_get("_whole", "$", "string"))
    rows = rows.withColumn("_inner", F.coalesce(told, said, F.col(raw)))
    found = F.try_parse_json(F.nullif(F.regexp_extract("_inner", rf'(?s)\{{.*"{word}".*\}}', 0), F.lit("")))
    return rows.withColumn("_doc", found).drop("_whole", "_result", "_inner")


def parse_issues(answers: DataFrame, dialect: str = "scan", raw: str = "raw") -> DataFrame:
    """A row per issue object of each answer, in order (pos), with all columns of answers but the raw text. Elements that
    are not objects are dropped, one by one."""
    kept = [c for c in answers.columns if c != raw]
    found = with_document(answers, raw, dialect).select(*kept, F.try_variant_get("_doc", "$.issues", "array<variant>").alias("_issues"))
    each = found.select(*kept, F.posexplode("_issues").alias("pos", "_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    fields = issue_fields(F.col("_v"))
    return each.select(*kept, "pos", *[c.alias(n) for n, c in fields.items()], F.lit("found").alias("status"), F.lit("ai").alias("source"))


def parse_results(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """(cluster_id, ord, file, line, status, reason) of agents' answers."""
    found = with_document(answers, raw, "results").select("cluster_id", F.try_variant_get("_doc", "$.results", "array<variant>").alias("_r"))
    each = found.select("cluster_id", F.posexplode("_r").alias("ord", "_v"))
    v = F.col("_v")
    return each.select("cluster_id", "ord", _text_of(v, "$.file").alias("file"), _number_of(v, "$.line").cast("int").alias("line"), _text_of(v, "$.status").alias("status"), _text_of(v, "$.reason").alias("reason"))


def agent_output(events: DataFrame) -> DataFrame:
    """(run, output): the last `result` event's text; without one, the last assistant text that holds "results".

    events: run, seq, line (a JSON document per line; others are skipped)."""
    v = F.try_parse_json(F.col("line"))
    rows = events.select("run", "seq", v.alias("v")).where(F.col("v").isNotNull())
    kind = _text_of(F.col("v"), "$.type")
    blocks = F.try_variant_get(F.col("v"), "$.message.content", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.when(_text_of(b, "$.type") == "text", _text_of(b, "$.text"))), lambda t: t.contains('"results"'))
    said = rows.select("run", "seq", F.when(kind == "result", F.coalesce(_text_of(F.col("v"), "$.result"), F.lit(""))).alias("result"), F.when((kind == "assistant") & (F.size(texts) > 0), F.element_at(texts, -1)).alias("said"))
    last = said.groupBy("run").agg(F.max_by("result", F.when(F.col("result").isNotNull(), F.col("seq"))).alias("result"), F.max_by("said", F.when(F.col("said").isNotNull(), F.col("seq"))).alias("said"))
    return last.select("run", F.coalesce(F.nullif("result", F.lit("")), "said", F.lit("")).alias("output"))


def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings with src_rank, the order of their sources: cached, local, reported."""
    out = None
    for i, p in enumerate(parts):
        ranked = p.withColumn("src_rank", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def lines_of(chunks: DataFrame) -> DataFrame:
    """(run, seq, line) of agents' output kept as chunks (run, seq, chunk): bytes cut anywhere, within a line or a character.

    Each chunk is cut at its line ends; the line ends before a chunk number its pieces, and the pieces of a number are one
    line, in order of their chunks. So no run is gathered in one place: what meets in a task is a line. What follows a
    run's last line end is a line too, unless it is empty. Bytes are carried as Latin-1 characters until lines are whole;
    those that are no UTF-8 are replaced."""
    rows = chunks.select("run", "seq", F.decode(F.coalesce("chunk", F.lit(b"")), "ISO-8859-1").alias("text"))
    rows = rows.withColumn("ends", F.length("text") - F.length(F.replace("text", F.lit("\n"))))
    before = F.coalesce(F.sum("ends").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.select("run", "seq", "ends").withColumn("first", before).drop("ends")  # numbers alone are sorted by run
    pieces = rows.join(counts, ["run", "seq"]).select("run", "seq", "first", F.posexplode(F.split("text", "\n", -1)).alias("k", "piece"))
    pieces = pieces.where(F.length("piece") > 0).withColumn("number", F.col("first") + F.col("k"))
    ends = rows.groupBy("run").agg(F.sum("ends").alias("n"))
    empty = ends.select("run", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).alias("number"))
    put = pieces.groupBy("run", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]), "").alias("text"))
    met = empty.join(put, ["run", "number"], "full")
    return met.select("run", F.col("number").alias("seq"), F.make_valid_utf8(F.encode(F.coalesce("text", F.lit("")), "ISO-8859-1").cast("string")).alias("line"))
