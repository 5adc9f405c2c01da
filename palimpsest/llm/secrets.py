"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of a file is addressed by the SHA-256 of its content.
A ledger holds, for each blob, the rule versions that have scanned it and what
they found. A run scans only the pairs of blob and rule version that the ledger
lacks, and joins the findings of old and new pairs back to every path that has
the blob. All of it is DataFrame expressions; no Python runs on executors.

Spans are in code points, with exclusive ends. Matches of a rule are leftmost
and non-overlapping; those whose checked group is too short are then dropped.

No pattern repeats a group without a bound (Java's matcher recurses there), and
no step's time grows faster than the text: matches become rows, whose places
are running sums, and a redacted text is put together from chunks.

Cases: a null text counts as empty; an empty text has no findings; repeated
rows and equal texts under several paths share one scan and each get all the
findings; a very long text, or one with very many matches, goes the same way;
an empty table gives an empty result; further columns of the input, whatever
their names, are ignored by a scan and kept by ``redact``; a null path is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import materialize


@dataclass(frozen=True)
class Rule:
    """A detection rule. Raise ``version`` with each change of the pattern."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the base contract.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)

#: Public token formats, looked for beside the base kinds.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN(?: [A-Z]{1,32}){0,8} PRIVATE KEY-----", version=2),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", version=2),  # a longer header would be read again from each place in it
    Rule("url_auth", r"[a-z][a-z0-9+.-]{1,20}://[^\x20/:@]{1,200}:[^\x20/@]{1,200}@"),
)

RULES = BASE_RULES + EXTRA_RULES

#: A whole private key: from its BEGIN line through the next END line; where another block begins first
#: or no END line follows, through its header lines and the base64 lines after them.
_NAMED = r"(?: [A-Z0-9]{1,32}){0,8} PRIVATE KEY(?: BLOCK)?\x20?-{4,5}"
_BEGIN, _END = rf"-{{4,5}}\x20?BEGIN{_NAMED}", rf"-{{4,5}}\x20?END{_NAMED}"
_MARKS = r"""[\s\\"'>#*|,]"""
_HEADER = r"[ \t]*+(?:\r?\n|\\n)[ \t>#*]{0,8}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID|Subject):[^\r\n\\]*+"
_BODY = rf"(?:{_MARKS}{{1,12}}+[A-Za-z0-9+/=]{{20,}}+|[ \t]*+(?:\r?\n{_MARKS}{{0,8}}+|\\n)[A-Za-z0-9+/=]++(?=[ \t]*+(?:[\r\n\\]|\z)))*+"
KEY = Rule("private_key", rf"{_BEGIN}(?:(?:(?!-{{4,5}}\x20?BEGIN )[\s\S])*?{_END}|(?:{_HEADER})*+{_BODY})", version=3)

#: What ``redact`` looks for. ``RULES`` stays as the query's SQL has it, with the BEGIN line alone.
REDACTED = tuple(KEY if r.kind == KEY.kind else r for r in RULES)
BROADCAST_BLOBS = 50_000
CHUNK = 1024

FINDING = "struct<start:int,ord:int,kind:string,end:int,rule:string>"
STEP = "struct<ord:int,i:int,gap:int,len:int,checked:int>"
LEDGER = f"blob string, rules array<string>, findings array<{FINDING}>"


def blob_id(content: Column) -> Column:
    """The address of a content: its SHA-256, null as empty."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def _steps(text: Column, rule: Rule, order: int) -> Column:
    """A rule's steps through a text: the length of the gap before each match, of the match, and of its checked group.

    The pieces between matches come from ``split`` and the matches from
    ``regexp_extract_all``; both step through the same matches, so running sums
    of their lengths give each match's place.
    """
    # a run that is too short can't be part of a long one, so these need no second look
    pattern = rule.pattern if rule.group or not rule.least or rule.kind != "hex" else rule.pattern[:-1] + f"{{{rule.least},}}"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(hits, F.length).alias("len"), F.transform(checked, F.length).alias("checked"))
    steps = F.transform(zipped, lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["checked"].alias("checked")))
    return F.when(text.rlike(pattern), steps).otherwise(F.expr(f"cast(array() as array<{STEP}>)"))


def _placed(stepped: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, ..., findings) from (blob, ..., steps): a match's end is the sum of all lengths up to it.

    Rows are dealt by blob already, so neither the running sums nor the lists
    move them again; a group is one text's matches.
    """
    own = [c for c in stepped.columns if c != "steps"]
    rows = stepped.select(*own, F.explode_outer("steps").alias("s")).select(*own, "s.*")
    here = Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(here).cast("int"))

    def of_rule(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("ord") + 1)

    finding = F.struct((F.col("end") - F.col("len")).alias("start"), "ord", of_rule([r.kind for r in rules], "string").alias("kind"), "end", of_rule([r.key for r in rules], "string").alias("rule"))
    found = F.col("len").isNotNull() & (F.col("checked") >= of_rule([r.least for r in rules], "int"))
    return rows.groupBy(*own).agg(F.array_sort(F.collect_list(F.when(found, finding))).cast(f"array<{FINDING}>").alias("findings"))


def scan(versions: DataFrame, content: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that a run adds: unseen pairs of blob and rule version.

    ``versions`` has one row for each path and version; ``ledger`` has the rows
    of earlier runs (schema ``LEDGER``). Equal contents meet on their address
    after a map-side combine, so a content with many copies moves once a task.
    """
    blobs = versions.select(F.coalesce(F.col(content), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        stepped = blobs.select("blob", F.concat(*[_steps(F.col("text"), r, i) for i, r in enumerate(rules)]).alias("steps"))
        return _placed(stepped, rules).select("blob", keys.alias("rules"), "findings")
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("seen", F.expr("cast(array() as array<string>)")))).where(F.size("rules") > 0)
    none = F.expr(f"cast(array() as array<{STEP}>)")
    each = [F.when(F.array_contains("rules", r.key), _steps(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return _placed(todo.select("blob", "rules", F.concat(*each).alias("steps")), rules).select("blob", "rules", "findings")


def _known(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, start, ord, kind, end, rule): the findings under the current rule versions, once each."""
    return ledger.select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin([r.key for r in rules])).select("blob", "f.*").distinct()


def _by_path(versions: DataFrame, content: str, per_blob: DataFrame) -> DataFrame:
    """Each row of ``versions``, whole as ``row``, with the columns of its blob, null if there are none.

    Only blobs with findings are joined: up to ``BROADCAST_BLOBS`` by a
    broadcast, so that paths don't move, more by a shuffle, in which Spark's
    skew join splits a hot blob.
    """
    per_blob = materialize(per_blob, "found")
    few = per_blob.count() <= BROADCAST_BLOBS
    paths = versions.select(F.struct(*[versions[c] for c in versions.columns]).alias("row"), blob_id(versions[content]).alias("of"))
    return paths.join(F.broadcast(per_blob) if few else per_blob, F.col("of") == F.col("blob"), "left").drop("of", "blob")


def findings_by_path(versions: DataFrame, content: str, keep: list[str], ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns of each row of ``versions``, and as ``_findings`` all findings of its blob under the current rule versions."""
    found = _known(ledger, rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "rule"))).alias("findings"))
    joined = _by_path(versions.select(*dict.fromkeys([*keep, content])), content, found)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in keep], F.coalesce("findings", F.expr(f"cast(array() as array<{FINDING}>)")).alias("_findings"))


def scan_secrets(versions: DataFrame, content: str = "text", keep: list[str] | None = None, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings for every path, and the ledger for the next run."""
    new = materialize(scan(versions, content, ledger, rules), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return findings_by_path(versions, content, keep or ["doc_id"], whole, rules), whole


def spans(findings: Column) -> Column:
    """Findings as text: kind:start:end, comma-joined, by start and then rule order."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def _cuts(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, cuts): the spans to take out, in order. What overlaps becomes one."""
    order = Window.partitionBy("blob").orderBy("start", "end")
    rows = _known(ledger, rules).withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("fresh", (F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int"))
    rows = rows.withColumn("number", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = rows.groupBy("blob", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def _without(text: Column, cuts: Column, mark: str) -> Column:
    """A text with each cut replaced. Its parts are looked up in chunks, since a place in a whole string is found by counting from its start."""

    def part(chunks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(held, start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))

    def built(chunks: Column) -> Column:
        before = F.transform(cuts, lambda x, i: part(chunks, F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"]), x["start"]))
        return F.concat(F.array_join(before, mark), F.lit(mark), part(chunks, F.element_at(cuts, -1)["end"], F.length(text)))

    # a lambda's variable, so that the chunks are cut once and not for each part
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))), built)[0]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced; all rows and columns stay.

    Overlapping spans are replaced as one, and private keys as a whole.
    ``n_chars`` follows the new text.
    """
    ledger = materialize(scan(docs, "text", rules=rules), "ledger")
    joined = _by_path(docs, "text", _cuts(ledger, rules))
    text, hit = F.col("row").getField("text"), F.col("cuts").isNotNull()
    joined = joined.withColumn("clean", F.when(hit, _without(text, F.col("cuts"), mark)).otherwise(text))
    new = {"text": F.col("clean"), "n_chars": F.when(hit, F.length("clean")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    types = dict(docs.dtypes)
    return joined.select(*[(new[c].cast(types[c]) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def digest(findings: DataFrame, n_base: int = len(BASE_RULES)) -> DataFrame:
    """The columns of the query from a path's findings."""
    base = F.filter("_findings", lambda f: f["ord"] < n_base)
    kinds = F.transform("_findings", lambda f: f["kind"])
    counts = [F.size(F.filter(kinds, F.lit(r.kind).__eq__)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return findings.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("_findings")).alias("spans"))
