"""Secret scans over a ledger of blobs.

A text is a blob, addressed by the SHA-256 of its content. A ledger holds which pairs of a blob and a rule version have been
scanned and what was found. A run scans only the pairs that the ledger lacks, each blob once however many paths lead to it,
and findings are joined back to every path. All work is done by SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, stage


@dataclass(frozen=True)
class Rule:
    """pattern, the group whose length counts, and the least length; a shorter match is dropped but still taken up."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: Kinds, patterns and lengths.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("hosted", 1, r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE + ADDED
#: Matches whose positions are added up at a time.
BLOCK = 256
_SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in a text, leftmost and non-overlapping: start and end (exclusive) in code points.

    A text is its pieces between matches and the matches, in turns; their lengths add up to the positions.
    """
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x).cast("long"))
    found = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("gap"), whole.alias("long"), kept.alias("kept"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["long"]
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(order).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["kept"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    # An array that grows is copied at every step, so long ones are built in blocks, each from 0, which are moved to their places then.
    numbers = F.sequence(F.lit(0), F.call_function("div", F.size(whole) - 1, F.lit(BLOCK)).cast("int"))
    blocks = F.transform(numbers, lambda b: F.aggregate(F.slice(found, b * BLOCK + 1, F.lit(BLOCK)), start, step, lambda s: s))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def move(state: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["kind"].alias("kind")))
        return F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(blocks, none, move, lambda s: F.flatten(s["out"]))).otherwise(F.array().cast(_SPAN))


def written(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, by start and then by kind, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def empty_ledger(docs: DataFrame) -> DataFrame:
    """A ledger in which nothing has been scanned."""
    return docs.sparkSession.createDataFrame([], "blob string, rule string, version int, spans " + _SPAN)


def scan(docs: DataFrame, path: str = "doc_id", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): blob and spans of each row of docs, and the entries to append to the ledger.

    docs has a path column and text; null text is empty. Each blob that lacks a rule at its version in the ledger is
    scanned with the rules it lacks, once however many paths have it. The entries are written to the shared folder, and findings
    are read from there and the ledger and joined back to the paths, so a text of very many paths is no large group of the scan's.
    Very long texts are scanned whole. Rows with a null path or repeated rows are reported each. Other columns, whatever their
    names, are ignored. An empty table gives no rows. Entries that the ledger has several times, as after two runs at once, count once.
    """
    blobs = need(docs, path, "text").select(F.col(f"`{path}`").alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    once = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        ledger, missing = empty_ledger(docs), once.withColumn("done", F.array().cast("array<string>"))
    else:
        ledger = ledger.dropDuplicates(["blob", "rule", "version"])
        missing = once.join(ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done")), "blob", "left")
    lacks = lambda r: ~F.coalesce(F.array_contains("done", f"{r.kind}@{r.version}"), F.lit(False))
    entry = F.array(*(F.when(lacks(r), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r, i).alias("spans"))) for i, r in enumerate(rules)))
    new = stage(missing.select("blob", F.explode(F.filter(entry, lambda e: e.isNotNull())).alias("e")).select("blob", "e.*"), "ledger")
    now = docs.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
    known = ledger.join(F.broadcast(now), ["rule", "version"], "left_semi").select("blob", "rule", "version", "spans").union(new)
    found = known.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    paths = blobs.select("path", "blob").join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))
    return paths.withColumnRenamed("path", path), new


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs with every secret in text replaced by a mark, and n_chars, where there is such a column, counted anew.

    A text without secrets stays as it is, null too; so do all rows and other columns, whatever their names. Very long texts are
    redacted whole, rows that repeat each, and an empty table stays empty.
    """
    named = lambda n: n if n not in docs.columns else named(f"_{n}")
    blob, key, own = named("blob"), named("key"), named("spans")
    blobs = need(docs, "text").filter("text IS NOT NULL").withColumn("path", F.lit(0)).select("path", "text")
    paths, _ = scan(blobs, "path", None, rules)
    found = paths.filter(F.size("spans") > 0).groupBy("blob").agg(F.any_value("spans").alias("spans")).withColumnsRenamed({"blob": blob, "spans": own})
    # Null texts get a key each, so that they don't all meet in one task.
    keyed = docs.withColumn(key, F.coalesce(F.sha2("text", 256), F.monotonically_increasing_id().cast("string")))
    joined = keyed.join(found.hint("shuffle_hash"), F.col(key) == F.col(blob), "left")
    changed = F.col(own).isNotNull()
    new = {"text": F.when(changed, redacted(F.col("text"), F.col(own))).otherwise(F.col("text"))}
    out = joined.withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base rules' spans, and all spans, for each row of docs."""
    found, _ = scan(docs, "doc_id", None, rules)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base, rules), 256).alias("base_sha256"), written(F.col("spans"), rules).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap or touch are one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        new = F.when((s["start"] > state["at"]) | (F.size(state["out"]) == 0), F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), new.alias("out"))

    whole = F.aggregate(F.array_sort(found), start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
