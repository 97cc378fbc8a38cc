"""Secret scans with an incremental ledger of blobs.

Texts are addressed by their SHA-256. The ledger is a folder of two tables:

* ``versions``: which path held which blob, one row per version that was ever given;
* ``scans``: for each blob the rules (kind and version) it was scanned with, and the spans found.

A scan looks only at pairs of a blob and a rule version that the ledger does not have, each blob
once however many paths hold it, and findings are joined back to all paths. Everything is Spark
expressions; positions come from splitting a text at the matches of a pattern.

Null and empty texts are one blob without findings. Null paths are paths like any other. A row
given several times is several versions of its path, and each gets the findings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import free_name, hex_digest, stored


class Rule(NamedTuple):
    """A pattern whose match counts if the group has at least so many characters. A changed
    pattern needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Patterns without a group to measure demand their length themselves; what they match is the
#: same, since a run of characters is always matched to its end.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:long,order:int,kind:string,version:int,end:long>"
NO_SPANS = f"array<{SPAN}>"
MASK = "[secret]"


def spans(text: Column, rule: Rule, order: int = 0) -> Column:
    """Places of a rule in a text (code points, end exclusive), leftmost first."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = (
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    )
    sizes = F.zip_with(
        F.slice(between, 1, F.array_size(whole)),
        F.arrays_zip(whole.alias("whole"), measured.alias("measured")),
        lambda before, m: F.struct(
            F.length(before).alias("before"),
            F.length(m["whole"]).alias("size"),
            F.length(m["measured"]).alias("measured"),
        ),
    )

    def step(done: Column, m: Column) -> Column:
        start = done["at"] + m["before"]
        end = start + m["size"]
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            end.alias("end"),
        ).cast(SPAN)
        found = F.when(m["measured"] >= rule.least, F.concat(done["found"], F.array(span)))
        return F.struct(end.alias("at"), found.otherwise(done["found"]).alias("found"))

    def placed(group: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast(NO_SPANS).alias("found"))
        return F.aggregate(group, zero, step, lambda done: done["found"])

    def width(group: Column) -> Column:
        sizes = F.transform(group, lambda m: (m["before"] + m["size"]).cast("long"))
        return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)

    found = _by_groups(sizes, width, lambda a, x: a + x, placed)
    return F.when(text.rlike(rule.pattern), F.flatten(found)).otherwise(F.array().cast(NO_SPANS))


#: Findings of a text that are placed one after the other; what is gathered is copied with each, so
#: groups of findings are placed by themselves.
GROUP = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _by_groups(
    items: Column,
    measure: Callable[[Column], Column],
    add: Callable[[Column, Column], Column],
    make: Callable[[Column, Column], Column],
) -> Column:
    """What ``make`` gives for each group of consecutive items and the position before it. Positions
    begin with 0; ``add`` moves one by the ``measure`` of a group."""

    def grouped(every: Column) -> Column:
        last = F.floor((F.array_size(every) - 1) / GROUP).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda n: F.slice(every, n * GROUP + 1, F.lit(GROUP)),
        )

    def positions(groups: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(
            F.transform(groups, measure),
            zero,
            lambda done, x: F.concat(done, F.array(add(F.element_at(done, -1), x))),
        )

    return _let(
        _let(items, grouped),
        lambda groups: F.zip_with(
            groups, F.slice(positions(groups), F.lit(1), F.array_size(groups)), make
        ),
    )


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """The tables of a ledger folder. Each scan appends to both."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing was entered yet

    def versions(self, path_type: str = "long") -> DataFrame:
        """path, blob: one row per version."""
        return self._read("versions", f"path {path_type}, blob string")

    def scans(self) -> DataFrame:
        """blob, rules (kind@version), spans: one row per blob and scan."""
        return self._read("scans", f"blob string, rules array<string>, spans {NO_SPANS}")

    def unseen(self, versions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """blob, one of its paths, and the rules it has not been scanned with."""
        blobs = versions.groupBy("blob").agg(F.min("path").alias("one"))
        seen = self.scans().groupBy("blob").agg(
            F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen")
        )
        every = F.array(*[F.lit(r.key) for r in rules])
        todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        return (
            blobs.join(seen, "blob", "left")
            .select("blob", "one", todo.alias("todo"))
            .where(F.size("todo") > 0)
        )

    def scan(
        self,
        docs: DataFrame,
        path: str = "doc_id",
        text: str = "text",
        rules: Sequence[Rule] = RULES,
    ) -> DataFrame:
        """Enter the documents as versions and scan what is new. Returns these versions
        (path, blob)."""
        given = docs.select(
            F.col(path).alias("path"),
            blob_of(F.col(text)).alias("blob"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
        # The versions are written last: what is in them has been scanned.
        versions = stored(given.select("path", "blob"), "versions")
        # Narrow, so it is the side that is built; texts are moved once and never sorted.
        todo = stored(self.unseen(versions, rules), "unseen").hint("shuffle_hash")
        same = (given["blob"] == todo["blob"]) & given["path"].eqNullSafe(todo["one"])
        found = F.concat(
            *[
                F.when(F.array_contains("todo", r.key), spans(F.col("text"), r, n)).otherwise(
                    F.array().cast(NO_SPANS)
                )
                for n, r in enumerate(rules)
            ]
        )
        scanned = given.join(todo, same).select(
            given["blob"], F.col("todo").alias("rules"), F.sort_array(found).alias("spans")
        )
        scanned.write.mode("append").parquet(f"{self.folder}/scans")
        versions.write.mode("append").parquet(f"{self.folder}/versions")
        return versions

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """blob, spans (sorted by start, then by rule): blobs in which these rule versions found
        something. The same blob scanned twice with a rule counts once."""
        keys = [r.key for r in rules]
        wanted = F.filter(
            "spans", lambda s: F.concat_ws("@", s["kind"], s["version"].cast("string")).isin(keys)
        )
        return (
            self.scans()
            .select("blob", wanted.alias("spans"))
            .where(F.size("spans") > 0)
            .groupBy("blob")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        )

    def on_paths(self, versions: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
        """Every version with the spans of its blob: path, blob, spans."""
        return versions.join(self.findings(rules), "blob", "left").select(
            "path", "blob", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans")
        )


def span_list(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def of_kinds(found: Column, rules: Sequence[Rule]) -> Column:
    kinds = [r.kind for r in rules]
    return F.filter(found, lambda s: s["kind"].isin(kinds))


def span_digest(found: Column) -> Column:
    return hex_digest(span_list(found))


def masked(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``MASK``. The spans are
    in the order of their starts; groups of them are masked in the stretch of text that they take."""

    def reach(group: Column) -> Column:
        return F.array_max(F.transform(group, lambda s: s["end"]))

    def stretch(group: Column, before: Column) -> Column:
        upto = F.greatest(before, reach(group))
        part = F.substr(text, (before + 1).cast("int"), (upto - before).cast("int"))
        return _let(part, lambda own: hidden(own, group, before))

    def hidden(own: Column, group: Column, before: Column) -> Column:
        def step(done: Column, s: Column) -> Column:
            skipped = F.substr(
                own, (done["at"] - before + 1).cast("int"), (s["start"] - done["at"]).cast("int")
            )
            new = F.concat(done["text"], skipped, F.lit(MASK))
            inside = (done["at"] > 0) & (s["start"] < done["at"])
            return F.struct(
                F.when(inside, done["text"]).otherwise(new).alias("text"),
                F.greatest(done["at"], s["end"]).alias("at"),
            )

        zero = F.struct(F.lit("").alias("text"), before.alias("at"))
        return F.aggregate(group, zero, step, lambda done: done["text"])

    parts = _by_groups(found, reach, lambda a, x: F.greatest(a, F.coalesce(x, a)), stretch)
    rest = F.substr(text, (F.coalesce(reach(found), F.lit(0)) + 1).cast("int"))
    return F.concat(F.array_join(parts, ""), rest)


def mask_secrets(
    docs: DataFrame,
    folder: str,
    path: str = "doc_id",
    text: str = "text",
    length: str | None = "n_chars",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """The documents with their secrets masked, by a scan with the ledger in ``folder``; a
    column ``length`` follows the new text. All documents and columns stay."""
    ledger = Ledger(docs.sparkSession, folder)
    ledger.scan(docs, path, text, rules)
    blob, found = free_name("blob", docs), free_name("spans", docs)
    hits = ledger.findings(rules).toDF(blob, found)
    joined = docs.withColumn(blob, blob_of(F.col(text))).join(hits, blob, "left")
    clean = free_name("clean", joined)
    joined = joined.withColumn(clean, masked(F.col(text), F.col(found)))
    hit, changed = F.col(found).isNotNull(), {text: F.col(clean)}
    if length and length in docs.columns:
        changed[length] = F.length(clean).cast(docs.schema[length].dataType)
    return joined.select(
        *[
            F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in docs.columns
        ]
    )
