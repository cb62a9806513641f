"""A scan with a model, as one run: fingerprints are packed into requests, answers become findings, suspicious files are
looked at whole, what the text bears out goes back to the model in batches, and what it calls real is reported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.operators import compress, detect, graph, incremental, score, verify
from gneiss.plans import prompts, scan
from gneiss.sources import findings, scratch
from gneiss.sources.scratch import settled

#: Files that are looked at whole once their fingerprints gave findings; findings of one request for a verdict.
SUSPICIOUS, VERDICTS = 5, 8
_ISSUE = "type, severity, file, line, description, evidence, line_content"


@dataclass
class Modelled:
    """What a scan with a model gives: the scan (see scan.Scan), the requests it made (kind, chunk, part, outcome), what the
    model reported and what of it stayed."""

    scan: scan.Scan
    requests: DataFrame
    reported: DataFrame
    kept: DataFrame


def _head(what: str, extra: str) -> str:
    guide = "\n".join(f"{s}: {prompts.GUIDE[s]}" for s in R.SEVERITIES)
    return "\n\n".join(p for p in (what, f"Kinds: {', '.join(R.TYPES)}", guide, extra) if p) + "\n\n"


def fingerprint_requests(prints: DataFrame, budget: int, extra: str = "") -> DataFrame:
    """(chunk, text): fingerprints of files in requests of at most `budget` tokens, the riskiest files first."""
    items = prints.select("path", "tokens", F.col("n_hotspots").alias("hotspots"), F.col("path").alias("ord"))
    chunks = compress.chunk_prompts(prints, graph.pack_next_fit(items, budget))
    head = _head(f"These are outlines of files. Report likely problems as JSON with an array `issues` of {_ISSUE}.", extra)
    return chunks.select("chunk", F.concat(F.lit(head), "text").alias("text"))


def whole_requests(files: DataFrame, budget: int, extra: str = "") -> Callable[[DataFrame], DataFrame]:
    """How chunks of whole files become (chunk, part, text): see prompts.ask_in_halves. A file that is over the budget is
    compressed as it was for grouping, one of a half to its share of the budget."""
    head = _head(f"These are whole files. Report each real problem as JSON with an array `issues` of {_ISSUE}.", extra)

    def render(rows: DataFrame) -> DataFrame:
        met = rows.select("chunk", "part", "pos", "path", "file_budget").join(files.select("path", "ext", "content"), "path")
        fit = compress.fitted(met, F.coalesce(F.col("file_budget"), F.when(F.length("content") > budget, F.lit(budget - graph.SPARE)).otherwise(F.lit(budget)).cast("long")))
        own = F.concat(F.lit("--- "), F.col("path"), F.when(F.col("compressed"), " (compressed)").otherwise(""), F.lit(" ---\n"), F.coalesce("fit", F.lit("")), F.lit("\n"))
        texts = fit.groupBy("chunk", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", own.alias("t")))), lambda x: x["t"]), "").alias("_t"))
        return texts.select("chunk", "part", F.concat(F.lit(head), "_t").alias("text"))

    return render


def verdict_requests(found: DataFrame, files: DataFrame) -> DataFrame:
    """(batch, text) of findings with batch and index: each with the lines about its place."""
    met = found.join(files.select(F.col("path").alias("file"), "content"), "file", "left")
    line = F.coalesce(F.nullif(F.col("line").cast("int"), F.lit(0)), F.lit(1))
    told = F.concat_ws(
        "\n", F.concat(F.lit("--- Issue "), F.col("index").cast("string"), F.lit(" ---")), F.concat(F.lit("File: "), "file"), F.concat(F.lit("Line: "), F.coalesce(F.col("line").cast("int").cast("string"), F.lit("-"))),
        F.concat(F.lit("Kind: "), F.col("type"), F.lit(", "), F.col("severity")), F.concat(F.lit("Claim: "), "description"), F.lit("Code:"), F.coalesce(verify.context_window(F.col("content"), line), F.lit("(cannot be read)")),
    )
    texts = met.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", told.alias("t")))), lambda x: x["t"]), "\n\n").alias("_t"))
    head = "Say of each issue whether the code beside it bears it out, as JSON with an array `results` of index, is_real, reason.\n\n"
    return texts.select("batch", F.concat(F.lit(head), "_t").alias("text"))


def confirmed(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Findings (with batch and index) that an answer (batch, raw) calls real. A batch without an answer that can be read is
    kept whole; in one with an answer, what it does not name goes."""
    docs = findings.with_document(answers, "raw").select("batch", F.try_variant_get("_doc", "$.results", "array<variant>").alias("_v")).where(F.col("_v").isNotNull())
    each = docs.select("batch", F.explode("_v").alias("_v")).select("batch", F.try_variant_get("_v", "$.index", "int").alias("index"), F.try_variant_get("_v", "$.is_real", "boolean").alias("is_real"))
    silent = found.join(docs.select("batch"), "batch", "left_anti")
    return verify.keep_real(found, each.where(F.coalesce("is_real", F.lit(False)))).unionByName(silent)


def _numbered(answers: DataFrame, turn: int) -> DataFrame:
    """The findings of answers (chunk, part, raw) with seq, the order in which they were told: by turn, chunk, part of the
    chunk, and place in the answer."""
    rows = findings.parse_issues(answers.select("chunk", "part", "raw"))
    part = F.conv(F.concat(F.lit("1"), "part"), 2, 10).cast("long")  # 1 for a whole chunk, 2 and 3 for halves, 4 to 7 for theirs
    seq = F.lit(turn << 58) + F.shiftleft(F.col("chunk").cast("long"), 24) + F.shiftleft(part, 20) + F.col("pos")
    return rows.withColumn("seq", seq.cast("long")).drop("chunk", "part", "pos")


def _asked(kind: str, answers: DataFrame, chunk: str = "chunk", part: Column = F.lit("")) -> DataFrame:
    return answers.select(F.lit(kind).alias("kind"), F.col(chunk).cast("long").alias("chunk"), part.alias("part"), "outcome")


def model_scan(files: DataFrame, call: Callable[[str], str], settings: scan.Settings = scan.Settings(), model: str = "", cache: DataFrame | None = None, deep: bool = True, extra: str = "", **options) -> Modelled:
    """files: path, ext, content. call: the model, see prompts.ask, whose other options may be given. cache: entries of this
    model (see incremental.usable): files that they hold are not asked about. deep: look at suspicious files whole.

    Every step is a table in the shared folder, and so is each answer as it comes, so a step that is run again asks nothing.
    A request without an answer is in `requests` with the reason; its files then have no findings of the model, and findings
    whose request for a verdict failed stay."""
    spark = files.sparkSession
    options = {"model": model, **options, "kept": options.get("kept") or scratch.folder(spark, "kept")}
    todo = files
    if cache is not None:
        todo = settled(incremental.partition(files, cache, "fingerprint").where("not hit").select("path", "ext", "content"), "todo")
    limit = next((m[3] for m in R.MODELS if m[0] == model), R.DEFAULT_LIMIT)
    local = settled(detect.scan_local(todo, R.RULES + settings.rules).withColumn("line", F.col("line").cast("double")), "local")
    prints = settled(compress.fingerprints(todo, local), "prints")

    first = settled(prompts.ask(fingerprint_requests(prints, limit - R.OVERHEAD_TOKENS, extra), call, **options), "answers")
    told, asked = _numbered(first.withColumn("part", F.lit("")), 0), _asked("fingerprints", first)
    if deep:
        known = told.join(todo.select(F.col("path").alias("file")), "file", "left_semi")
        suspects = verify.suspicious_files(known, SUSPICIOUS).select(F.col("file").alias("path"))
        some = settled(todo.join(F.broadcast(suspects), "path", "left_semi"), "suspects")  # SUSPICIOUS names at most
        budget = int((limit - R.OVERHEAD_TOKENS) * R.CHARS_PER_TOKEN)
        none = spark.createDataFrame([], "repo string, src string, dst string")
        placed = settled(graph.smart_group(some.withColumn("repo", F.lit("")), none, budget).select("chunk", "pos", "path"), "placed")
        second = prompts.ask_in_halves(placed, whole_requests(some, budget, extra), call, budget, **options)
        told, asked = told.unionByName(_numbered(second, 1)), asked.unionByName(_asked("whole", second, part=F.col("part")))
    told = settled(told, "told")
    borne = settled(score.batches(verify.verify(told, local, todo), ["seq"], VERDICTS), "borne")
    third = settled(prompts.ask(verdict_requests(borne, todo), call, key="batch", **options), "verdicts")
    kept = settled(confirmed(borne, third.select("batch", "raw")).drop("batch", "index"), "kept-findings")
    return Modelled(scan.scan(files, settings, kept, cache), asked.unionByName(_asked("verdicts", third, "batch")), told, kept)
