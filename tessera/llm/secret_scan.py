"""Secret scans with multipart credential linking, in built-in functions only.

Base patterns report strong findings by themselves. Weak parts (client identifiers,
endpoints, unnamed random strings) are common in clean text; they are reported only where
an interval join inside the text finds complementary parts within a scope: a weak secret
near an identifier or endpoint, an identifier or endpoint near a secret. A scope never
leaves its document, so the join is a sweep over the row's parts in order of their start (the
greatest end so far, the least start to come) and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import fresh, joined, keep_flagged, match_spans, near_class, no_spans, rank, redact, spans_where

#: Base kinds in reporting order, and their patterns.
BASE = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
#: Kinds that linking adds, and the patterns of their parts.
LINKED = {
    "identifier": r"(?i)(?<![a-z])(client_?id|user_?name|user|login|account_?id|access_?key_?id)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9@._-]{3,}",
    "endpoint": r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._:@/?&=%-]{4,}",
    "weak": r"(?:(?<![A-Za-z0-9+/_-])|\G)(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])",
}
KINDS = [*BASE, *LINKED]


def base_spans(text: Column) -> Column:
    """Spans of the base kinds; a match of too few characters is dropped."""
    named = spans_where(text, BASE["assign"], "assign", text.rlike(r"[:=]") & text.rlike(BASE["assign"]))
    long_enough = F.filter(named, lambda s: F.length(F.regexp_extract(s["text"], BASE["assign"], 2)) >= 6)
    # of an AKIA or hex run only the whole run can be long enough, so the lengths are tested on it
    access = F.filter(spans_where(text, BASE["access"], "access", text.contains("AKIA")), lambda s: F.length(s["text"]) >= 20)
    runs = spans_where(text, BASE["hex"], "hex", text.rlike(BASE["hex"][:-2] + "}"))
    return F.concat(long_enough, access, runs)


def add_linked(docs: DataFrame, text: Column, base: str, out: str, scope: int) -> DataFrame:
    """Add the column ``out``: weak parts whose complement lies within ``scope`` code points; parts of base findings aren't repeated.

    A weak secret needs an identifier, access key or endpoint, an identifier needs a secret,
    an endpoint a secret and an identifier or access key. Each step rewrites the column, which
    is sorted by start.
    """
    kind = lambda *names: lambda s: s["kind"].isin(*names)
    secret = ("assign", "hex", "weak")
    possible = F.col(base).isNotNull() & ((F.size(base) > 0) | text.rlike(r"[:=]"))
    parts = F.concat(
        F.col(base),
        spans_where(text, LINKED["identifier"], "identifier", text.rlike(r"[:=]")),
        spans_where(text, LINKED["endpoint"], "endpoint", text.contains("://")),
    )
    weak = F.when(F.exists(out, kind("access", "identifier", "endpoint")), match_spans(text, LINKED["weak"], "weak")).otherwise(no_spans())
    drop = lambda names, near, reach: keep_flagged(F.col(out), near_class(F.col(out), kind(*near), reach), lambda s, close: ~close | ~s["kind"].isin(*names))
    need = lambda names, near, reach: keep_flagged(F.col(out), near_class(F.col(out), kind(*near), reach), lambda s, close: close | ~s["kind"].isin(*names))
    both = F.zip_with(near_class(F.col(out), kind("access", "identifier"), scope), near_class(F.col(out), kind(*secret), scope), lambda x, y: F.struct(x.alias("id"), y.alias("secret")))
    due = lambda s, f: F.when(s["kind"] == "endpoint", f["id"] & f["secret"]).when(s["kind"] == "identifier", f["secret"]).otherwise(s["kind"] == "weak")
    steps = (
        F.when(possible, F.array_sort(parts)).otherwise(no_spans()),
        drop(("identifier", "endpoint"), BASE, 0),
        F.array_sort(F.concat(F.col(out), weak)),
        drop(("weak",), BASE, 0),
        drop(("weak",), ("endpoint",), 0),
        need(("weak",), ("access", "identifier", "endpoint"), scope),
        # identifiers without a secret still stand for an endpoint's counterpart, so one step decides on both
        keep_flagged(F.col(out), both, due),
    )
    for step in steps:
        docs = docs.withColumn(out, step)
    return docs


def scan_secrets(docs: DataFrame, scope: int = 200, text_col: str = "text", names: tuple[str, str] = ("secret_base", "secret_linked")) -> DataFrame:
    """``docs`` with the columns ``names`` of base and linked findings, arrays of (start, kind, end, text).

    A null or empty text has none. All other columns stay (a column of either name is
    replaced); repeated rows stay repeated.
    """
    base, linked = names
    text = F.coalesce(F.col(text_col), F.lit(""))
    return add_linked(docs.withColumn(base, base_spans(text)), text, base, linked, scope)


def secret_report(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base digest and all spans per document."""
    key = lambda s: [s["start"], rank(s["kind"], KINDS), s["end"]]
    base, every = F.col("secret_base"), F.concat("secret_base", "secret_linked")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    found = scan_secrets(docs.select(id_col, text_col), scope, text_col)
    return found.select(
        id_col, *map(count, BASE), F.sha2(joined(base, key), 256).alias("base_sha256"),
        joined(every, key).alias("spans"), F.size("secret_linked").cast("bigint").alias("n_linked"), F.size(every).cast("bigint").alias("n_found"),
    )


def mask_secrets(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in the text replaced by ``mark``; a null text stays null, and all other columns stay."""
    names = fresh("secret_base", docs.columns), fresh("secret_linked", docs.columns)
    found = scan_secrets(docs, scope, text_col, names)
    return found.withColumn(text_col, redact(F.col(text_col), F.concat(*names), mark)).drop(*names)
