"""Personal-data scans: wide candidate generators, boosted trees and calibrated thresholds, in built-in functions only.

Generators propose spans of many formats, overlaps included. Gradient-boosted trees score
each candidate by its format and its context, and a threshold per generator, calibrated on
held-out texts, selects the redactions. The trees learn from the documents themselves: a
candidate that a base pattern confirms is a positive, any other a negative, and what decides a
base match (the plus sign, the at sign, the range of an address, Luhn's check) is hidden from
the features. So the trees find what looks and stands like confirmed personal data but fails a
pattern. Their scores are plain CASE expressions in the row.

A threshold needs held-out candidates of both labels, or it would say nothing. Prose round the word "at"
is what addresses are told from. Numbers that look like something else (a date, a version, a book or order number ...)
are calibrated apart, look by look: where the documents hold no such numbers of both labels, none is selected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import fresh, joined, keep_flagged, let, near_class, no_spans, pieces_of, rank, redact, spans_where, taken
from tessera.session import durable

#: Base kinds in reporting order, and their patterns. Where a run of one
#: character class opens a pattern it is taken whole, from its start or where the last
#: match ended: the same matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the trees may add: the generators' patterns.
_AT = r"(?:\x20?@\x20?|\x20at\x20|\x20?[\[(]\x20?(?:at|@)\x20?[\])]\x20?)"
_DOT = r"(?:\.|\x20dot\x20|\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?)"
WIDE = {
    "email_like": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}+",
    "number_like": r"(?:(?<![0-9A-Za-z])|\G)\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,}+(?![0-9A-Za-z])",
}
#: What addresses are learned from also holds prose: words round an "at" without any dot.
_AROUND_AT = WIDE["email_like"].replace("{1,6}+", "{0,6}+")
KINDS = [*BASE, *WIDE]

#: Format and context features, in the trees' order.
FEATURES = ("length", "digits", "letters", "groups", "first_group", "last_group", "longest_group", "dots", "dashes", "spaces", "parens", "named", "letter_before", "mark_before", "letter_after", "mark_after", "money")
_NAMES = r"(?i)(tel|phone|call|fax|mobile|cell|contact|ssn|social security|card|visa|mail|reach|write)[^A-Za-z0-9]{0,4}(?:[a-z]{2,8}[^A-Za-z0-9]{1,3}){0,2}$"


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def term(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds that pass their checks; failing matches are dropped and not retried."""
    digits = text.rlike("[0-9]")
    email = spans_where(text, BASE["email"], "email", text.contains("@"))
    quads = spans_where(text, BASE["ip"], "ip", digits & text.rlike(r"[0-9]\.[0-9]"))
    part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda d: (F.length(d) <= 3) & (d.cast("int") <= 255))
    ip = F.filter(quads, lambda s: F.forall(F.split(s["text"], r"\."), part))
    runs = spans_where(text, BASE["card"], "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"))
    card = F.filter(runs, lambda s: let(_only_digits(s["text"]), lambda d: F.length(d).between(16, 19) & luhn(d)))
    plus = spans_where(text, BASE["phone"], "phone", text.rlike(r"\+[0-9]"))
    phone = F.filter(plus, lambda s: F.length(_only_digits(s["text"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def features(span: Column, before: Column, after: Column) -> Column:
    """Struct of FEATURES (double) from a candidate's text and some characters on both sides (a sign that opens a base match is no feature)."""
    text, before = span, F.regexp_replace(before, r"\+$", "")
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    count = lambda p: F.regexp_count(text, F.lit(p))
    values = (
        F.length(text), count("[0-9]"), count("[A-Za-z]"), F.size(groups), F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        F.coalesce(F.array_max(sizes), F.lit(0)), count(r"\."), count("-"), count(r"\x20"), count("[()]"), before.rlike(_NAMES).cast("int"),
        before.rlike("[A-Za-z0-9]$").cast("int"), before.rlike(r"[./_:#=-]$").cast("int"), after.rlike("^[A-Za-z0-9%]").cast("int"), after.rlike("^[./_:%-][A-Za-z0-9]").cast("int"),
        before.rlike(r"[$€£#]\x20?$").cast("int"),
    )
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(FEATURES, values)))


def look(kind: Column, span: Column, before: Column) -> Column:
    """What else a candidate looks like: plain, or the name of a look that is calibrated on its own."""
    groups = F.filter(F.split(span, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    digits = _only_digits(span)
    dotted = span.rlike(r"^[0-9]+(\.[0-9]+)+$")
    short = F.exists(sizes, lambda n: n >= 5) | F.forall(sizes, lambda n: n <= 2) | (F.size(sizes) > 4)
    return (
        F.when(kind == "email_like", F.when(span.rlike("[A-Za-z]{2}$"), "plain").otherwise("numeric"))
        .when(digits.rlike("^97[89]") & (F.length(digits) == 13) | before.rlike(r"(?i)isbn[^0-9A-Za-z]{0,3}$"), "isbn")
        .when(span.rlike(r"^(?:19|20)[0-9]{2}[\x20.-]{1,3}(?:0?[1-9]|1[0-2])[\x20.-]{1,3}[0-3]?[0-9](?![0-9])|^[0-3]?[0-9][.-][0-3]?[0-9][.-](?:19|20)[0-9]{2}(?![0-9])"), "date")
        .when(span.rlike(r"^(?:19|20)[0-9]{2}[\x20-]{1,3}(?:19|20)[0-9]{2}$"), "years")
        .when(before.rlike(r"(?i)(?:order|invoice|ticket|item|article|serial|part|version|build|release|sku|ref|id|no|nr|key)[^A-Za-z0-9]{0,3}$|#$"), "numbered")
        .when(before.rlike(r"[$€£]\x20?$"), "price")
        .when((F.size(groups) == 4) & dotted & F.forall(sizes, lambda n: n <= 3), "quad")
        .when(dotted & short, "version")
        .when(F.length(digits) >= 16, "card")
        .when(F.size(groups) == 1, "bare")
        .otherwise("plain")
    )


def candidates(text: Column, learning: bool = False) -> Column:
    """All spans that the generators propose (``learning``: and prose round an "at"); each gate holds wherever its pattern matches."""
    emails = spans_where(text, _AROUND_AT if learning else WIDE["email_like"], "email_like", text.contains("@") | text.rlike(r"\x20at\x20|[\[(]\x20?at\x20?[\])]"))
    numbers = spans_where(text, WIDE["number_like"], "number_like", text.rlike(r"[0-9](?:[\x20().-]{0,3}[0-9]){6}"))
    return F.concat(emails, numbers)


def _plain(kind: Column, text: Column) -> Column:
    """How an address writes its at and dots decides a base match, so it is no feature either."""
    return F.when(kind == "email_like", F.regexp_replace(text, f"{_AT}|{_DOT}", ".")).otherwise(text)


def _described(text: Column, spans: Column) -> Column:
    """Candidate spans, each as a struct of its span (s), features (f) and look."""
    before = lambda p, s: taken(p, F.greatest(s["start"] - 30, F.lit(0)), s["start"])
    near = lambda p, s: let(before(p, s), lambda b: F.struct(s.alias("s"), features(_plain(s["kind"], s["text"]), b, taken(p, s["end"], s["end"] + 3)).alias("f"), look(s["kind"], s["text"], b).alias("look")))
    return F.when(F.size(spans) > 0, let(pieces_of(text), lambda p: F.transform(spans, lambda s: near(p, s))))


def known_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Candidates of all distinct texts: h, the text's hash, place (in its text's spans), kind, look, label, made and FEATURES.

    Confirmed ones are there a second time, ``made`` shorter. Repeats of a text go as candidates, which are small rows, not as texts.
    """
    text, base = F.col("text"), lambda x: x["kind"].isin(*BASE)
    found = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter(text.rlike("[0-9@]|at"))
    found = found.withColumn("s", F.array_sort(F.concat(base_spans(text), candidates(text, True)))).withColumn("label", near_class(F.col("s"), base))
    near = lambda p, s: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), taken(p, F.greatest(s["start"] - 30, F.lit(0)), s["start"]).alias("before"), taken(p, s["end"], s["end"] + 3).alias("after"))
    found = found.withColumn("d", F.when(F.size("s") > 0, let(pieces_of(text), lambda p: F.transform("s", lambda s: near(p, s)))))
    # an outer explode: Spark infers a filter from an inner one, which would look for the spans twice
    rows = found.select("h", F.posexplode_outer(F.zip_with("d", "label", lambda d, y: F.struct(d.alias("d"), y.cast("double").alias("label")))).alias("place", "r"))
    rows = rows.select("h", "place", "r.label", "r.d.*").filter(~F.col("kind").isin(*BASE)).distinct()
    # an address is still one with a short name and host, a number without its country's prefix: what the documents write is not the only way
    address = F.concat(F.regexp_extract("text", rf"([A-Za-z]+)[^A-Za-z]*?{_AT}", 1), F.lit("@"), F.regexp_extract("text", r"([A-Za-z0-9-]+\.[A-Za-z]{2,})$", 1))
    short = F.when(F.col("kind") == "email_like", F.when(address.rlike("^.+@.+$"), address)).otherwise(F.when(F.col("text").rlike(r"^[0-9]{1,3}\x20?\("), F.regexp_replace("text", r"^[0-9]{1,3}\x20?", "")))
    made = rows.filter("label = 1").withColumn("text", short).filter(F.col("text").isNotNull())
    rows = rows.withColumn("made", F.lit(False)).unionByName(made.withColumn("made", F.lit(True)))
    return rows.select("h", "place", "kind", look(F.col("kind"), F.col("text"), F.col("before")).alias("look"), "label", "made", features(_plain(F.col("kind"), F.col("text")), F.col("before"), F.col("after")).alias("f")).select("h", "place", "kind", "look", "label", "made", "f.*")


class CandidateModel:
    """Boosted trees over FEATURES as expressions, with calibrated thresholds and the held-out precision each reached.

    ``thresholds`` are per generator, for plain looks; ``looks`` are per generator and look, and what has none there is not
    selected. Without ``looks`` (None) a generator's threshold holds for all looks. ``report`` has per generator and look the
    held-out candidates: (confirmed, others, confirmed ones selected, others selected).
    """

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float], precision: dict, looks: dict[tuple[str, str], float] | None = None, report: dict | None = None):
        self.trees, self.weights, self.thresholds, self.precision, self.looks, self.report = trees, weights, thresholds, precision, looks, report or {}

    def score(self, f: Column) -> Column:
        def grow(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, cut, left, right = node
            return F.when(f[FEATURES[feature]] <= cut, grow(left)).otherwise(grow(right))

        margin = reduce(lambda a, b: a + b, (grow(t) * w for t, w in zip(self.trees, self.weights)))
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, kind: Column, score: Column, seen: Column) -> Column:
        if self.looks is None:
            rules = [(kind == k) & (score >= t) for k, t in self.thresholds.items()]
        else:
            rules = [(kind == k) & (seen == x) & (score >= t) for (k, x), t in [*(((k, "plain"), t) for k, t in self.thresholds.items()), *self.looks.items()]]
        return reduce(lambda a, b: a | b, rules, F.lit(False))


def _tree(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train_model(docs: DataFrame, rounds: int = 10, precision: float = 0.95, support: int = 20, text_col: str = "text") -> CandidateModel | None:
    """Fit on the candidates of three quarters of all distinct texts; the others calibrate.

    A threshold is the lowest score from which on the held-out share of confirmed candidates
    is ``precision`` or more. It needs ``support`` held-out candidates of both labels: of the
    generator for plain looks, of the look itself for others. What has no threshold adds nothing.
    Without ``support`` candidates of both labels to fit on there is no model.
    """
    rows = durable(known_candidates(docs, text_col), "candidates")
    held = F.pmod(F.xxhash64("h", F.lit("held")), F.lit(4)) == 0
    fit = rows.filter(~held)
    sizes = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < support:
        return None
    fitted = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.3, seed=1, maxBins=32).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(fit).select("label", "features"))
    model = CandidateModel([_tree(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights), {}, {}, {})
    score = F.floor(100 * model.score(F.struct(*FEATURES))).alias("bin")
    bins = rows.filter(held & ~F.col("made")).groupBy("kind", "look", score).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    for kind in WIDE:
        own = [b for b in bins if b["kind"] == kind]
        for seen in sorted({b["look"] for b in own}):
            mine = [b for b in own if b["look"] == seen]
            total = lambda rows, from_=-1.0: (sum(b["good"] for b in rows if b["bin"] >= 100 * from_), sum(b["n"] - b["good"] for b in rows if b["bin"] >= 100 * from_))
            # plain looks are told from all that the generator proposes
            both = own if seen == "plain" else mine
            marks = sorted({b["bin"] / 100 for b in both}, reverse=True)
            fit_for = [m for m in marks if total(both, m)[0] >= max(support, precision * sum(total(both, m)))]
            selected = (0, 0)
            if fit_for and min(total(both)) >= support:
                # half way to the next score seen: what lies between was not met
                least = (fit_for[-1] + next((m for m in marks if m < fit_for[-1]), 0.0)) / 2
                key = kind if seen == "plain" else (kind, seen)
                (model.thresholds if seen == "plain" else model.looks)[key] = least
                selected = total(mine, least)
                model.precision[key] = selected[0] / max(1, sum(selected))
            model.report[kind, seen] = (*total(mine), *selected)
    return model


def add_wide(docs: DataFrame, text: Column, base: str, out: str, model: CandidateModel | None) -> DataFrame:
    """Add the column ``out``: candidates that reach their generator's threshold and overlap no base span, each with its score."""
    none = F.array().cast("array<struct<start:int,kind:string,end:int,text:string,score:double>>")
    if model is None or not (model.thresholds or model.looks):
        return docs.withColumn(out, none)
    scored = lambda x: F.struct(*(x["s"][c].alias(c) for c in ("start", "kind", "end", "text")), model.score(x["f"]).alias("score"))
    chosen = lambda x: F.struct(scored(x).alias("s"), x["look"].alias("look"))
    is_base = lambda x: x["kind"].isin(*BASE)
    steps = (
        candidates(text),
        F.when(F.size(out) > 0, F.array_sort(F.concat(base, out))).otherwise(no_spans()),
        keep_flagged(F.col(out), near_class(F.col(out), is_base), lambda x, near: ~near),
        _described(text, F.col(out)),
        F.coalesce(F.transform(F.filter(F.transform(out, chosen), lambda x: model.selects(x["s"]["kind"], x["s"]["score"], x["look"])), lambda x: x["s"]), none),
    )
    for step in steps:
        docs = docs.withColumn(out, step)
    return docs


def scan_pii(docs: DataFrame, model: CandidateModel | None, text_col: str = "text", names: tuple[str, str] = ("pii_base", "pii_wide")) -> DataFrame:
    """``docs`` with the columns ``names`` of base and selected findings, arrays of (start, kind, end, text); the latter with a score.

    A null or empty text has none. All other columns stay (a column of either name is
    replaced); repeated rows stay repeated.
    """
    base, wide = names
    text = F.coalesce(F.col(text_col), F.lit(""))
    return add_wide(docs.withColumn(base, base_spans(text)), text, base, wide, model)


def pii_report(docs: DataFrame, model: CandidateModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base digest and all spans per document."""
    key = lambda s: [rank(s["kind"], KINDS), s["start"], s["end"]]
    base = F.col("pii_base")
    bare = F.transform("pii_wide", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "text"))))
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return scan_pii(docs.select(id_col, text_col), model, text_col).select(
        id_col, *map(count, BASE), F.sha2(joined(base, key), 256).alias("base_sha256"), joined(F.concat(base, bare), key).alias("spans"),
        F.size("pii_wide").cast("bigint").alias("n_wide"), (F.size(base) + F.size("pii_wide")).cast("bigint").alias("n_found"),
    )


def mask_pii(docs: DataFrame, model: CandidateModel | None, mark: str = "[PII]", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in the text replaced by ``mark``; a null text stays null, and all other columns stay."""
    names = fresh("pii_base", docs.columns), fresh("pii_wide", docs.columns)
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = scan_pii(docs, model, text_col, names)
    return found.withColumn(text_col, redact(F.col(text_col), F.concat(*map(bare, names)), mark)).drop(*names)
