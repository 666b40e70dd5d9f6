"""PII by bootstrapped contextual extraction; DataFrame functions only.

Seeds are spans of four fixed forms: email, ip, card (Luhn) and phone.  Every
word that holds a digit or ``@`` is a candidate instance, and the two words
before it are its lexical pattern.  Spark scores the graph of patterns and
instances in rounds: a pattern's confidence is the share of its distinct
instances that are known identifiers; an unknown instance is learned when the
patterns it occurs with make it likely (noisy-or); learned instances then count
for other patterns, until a round learns none.  An unknown instance that stands in a confident pattern is
reported with the kind that most of the pattern's known instances have.

Positions are code points, end exclusive.  Null text: no span.  Spans of a kind
don't overlap; added spans never overlap any span.  Repeated rows are scanned
one by one; an instance counts once for a pattern however often it is repeated.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.native_arrays import let, located
from tidelog.llm.shared import materialize

KINDS = ("email", "ip", "card", "phone")
# Runs are entered at their start (or where the last match ended) and taken
# whole: the same matches as the plain forms, in time linear in the text.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPACE = r"\x20\x09-\x0D"
_CANDIDATE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
#: A pattern is confident with this share of known instances and at least so many.
CONFIDENCE, SUPPORT = 0.8, 3


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _is_card(found: Column) -> Column:
    digits = F.regexp_replace(found, "[ -]", "")
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _is_ip(found: Column) -> Column:
    return F.forall(F.split(found, r"\.", -1), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))


def _is_phone(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)


#: Kind: a condition that every match needs, the form, and what a match must pass.
_FORMS = {
    "email": (lambda t: t.contains("@"), _EMAIL, None),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), _IP, _is_ip),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _CARD, _is_card),
    "phone": (lambda t: t.contains("+"), _PHONE, _is_phone),
}
_SPANS = "array<struct<start:bigint,kind:string,end:bigint,found:string>>"
_NO_SPANS = f"cast(array() as {_SPANS})"


def base_spans(text: Column, kind: str) -> Column:
    """Spans (start, kind, end, found) of one fixed form."""
    needed, form, passes = _FORMS[kind]
    found = located(text, form)
    found = F.filter(found, lambda m: passes(m["found"])) if passes else found
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["found"].alias("found")))
    return F.when(needed(text), spans).otherwise(F.expr(_NO_SPANS))


def _candidates(text: Column) -> Column:
    """Words with a digit or @: (start, end, token, pattern).  A candidate's two
    words before it lie in what stands between it and the last candidate but two."""
    context = rf"(?<![^{_SPACE}])([^{_SPACE}]++[{_SPACE}]++[^{_SPACE}]++)[{_SPACE}]++$"

    def context_of(m: Column, i: Column, every: Column) -> Column:
        back = lambda k, part: F.when(i >= k, F.get(every, i - k)[part]).otherwise("")
        return F.concat(back(2, "found"), back(1, "before"), back(1, "found"), m["before"])

    def candidate(m: Column, i: Column, every: Column) -> Column:
        token = F.regexp_replace(m["found"], r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
        lead = F.length(m["found"]) - F.length(F.regexp_replace(m["found"], r"^[^A-Za-z0-9+]+", ""))
        pattern = F.regexp_replace(F.lower(F.regexp_extract(context_of(m, i, every), context, 1)), rf"[{_SPACE}]+", " ")
        return F.struct((m["start"] + lead).alias("start"), (m["start"] + lead + F.length(token)).alias("end"), token.alias("token"), pattern.alias("pattern"))

    made = let(located(text, _CANDIDATE), lambda every: F.transform(every, lambda m, i: candidate(m, i, every)))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,token:string,pattern:string>>)")
    return F.when(text.rlike("[0-9@]"), made).otherwise(none)


def occurrences(scanned: DataFrame) -> DataFrame:
    """(rid, start, end, token, pattern, kind): candidates that open a base span
    (kind and its text as token) or that touch none (kind null)."""
    spans = scanned.select("rid", F.explode("base").alias("s")).select("rid", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(1).alias("order"), F.col("s.kind").alias("kind"), F.col("s.found").alias("token"), F.lit(None).cast("string").alias("pattern"))
    words = scanned.select("rid", F.explode("candidates").alias("c")).select("rid", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("kind"), F.col("c.token").alias("token"), F.col("c.pattern").alias("pattern"))
    both = words.unionByName(spans)
    before = Window.partitionBy("rid").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("order")).rowsBetween(Window.unboundedPreceding, -1)
    span = F.when(F.col("order") == 1, F.struct("start", "kind", "token"))
    placed = both.withColumn("covered", F.max(F.when(F.col("order") == 1, F.col("end"))).over(before)).withColumn("next", F.last(span, ignorenulls=True).over(after))
    opens = F.col("next.start") < F.col("end")
    free = placed.filter((F.col("order") == 0) & (F.col("token") != "") & (F.coalesce("covered", F.lit(0)) <= F.col("start")))
    return free.select("rid", "start", "end", F.when(opens, F.col("next.token")).otherwise(F.col("token")).alias("token"), "pattern", F.when(opens, F.col("next.kind")).alias("kind"))


def confident_patterns(edges: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) after scoring ``edges`` (pattern, token, kind):
    distinct pairs, kind of known identifiers or null.  What is learned stays,
    so that rounds end, at the first that learns nothing."""
    known = edges
    while True:
        by_kind = known.groupBy("pattern", "kind").count()
        scores = by_kind.groupBy("pattern").agg(F.sum("count").alias("all"), F.sum(F.when(F.col("kind").isNotNull(), F.col("count"))).alias("known"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("count", "kind"))).alias("as_kind"))
        scores = scores.filter((F.col("known") >= support) & (F.col("known") >= confidence * F.col("all")))
        scores = materialize(scores.select("pattern", F.col("as_kind").alias("kind"), (F.col("known") / (F.col("all") + 1)).alias("confidence")), "patterns")
        unknown = known.filter("kind is null").select("pattern", "token").join(scores, "pattern")
        learned = unknown.groupBy("token").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("likely"), F.max_by("kind", F.struct("confidence", "kind")).alias("learned"))
        learned = materialize(learned.filter(F.col("likely") >= confidence * support / (support + 1)).select("token", "learned"), "learned")
        if learned.isEmpty():
            return scores
        known = materialize(known.join(learned, "token", "left").select("pattern", "token", F.coalesce("kind", "learned").alias("kind")), "edges")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **scoring) -> DataFrame:
    """(doc_id, *keep, base, added): spans (start, kind, end, found) of each row,
    by start, then kind in the order of KINDS."""
    text = F.col(text_col)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def by_place(spans: Column) -> Column:
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["found"].alias("found"), s["kind"].alias("kind"))))
        return F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found")))

    base = by_place(F.concat(*[base_spans(text, k) for k in KINDS]))
    scanned = docs.select(F.col(id_col).alias("doc_id"), *keep, F.monotonically_increasing_id().alias("rid"), F.when(text.isNull(), F.expr(_NO_SPANS)).otherwise(base).alias("base"), _candidates(F.coalesce(text, F.lit(""))).alias("candidates"))
    scanned = materialize(scanned, "scanned")
    found = materialize(occurrences(scanned), "occurrences")
    with_pattern = found.filter("pattern <> ''")
    edges = materialize(with_pattern.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "edges")
    patterns = confident_patterns(edges, **scoring)
    added = with_pattern.filter("kind is null").drop("kind").join(patterns, "pattern")
    added = added.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", F.col("token").alias("found")))).alias("added"))
    out = scanned.drop("candidates").join(added, "rid", "left")
    return out.select("rid", "doc_id", *keep, "base", by_place(F.coalesce("added", F.expr(_NO_SPANS))).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scan`'s output."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scoring) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets."""
    # the row travels as one struct, so that no column's name can clash
    rows = docs.select(F.col(id_col), F.col(text_col), F.struct(*map(F.col, docs.columns)).alias("_row"))
    scanned = scan(rows, id_col, text_col, keep=("_row",), **scoring)
    scanned = scanned.withColumn("_text", F.col("_row").getField(text_col))

    def cut(spans: Column) -> Column:
        """Added spans from the last to the first, so that places stay valid."""
        back = F.reverse(spans)
        return F.aggregate(back, F.col("_text"), lambda t, s: F.concat(F.substr(t, F.lit(1), s["start"].cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"), F.substr(t, (s["end"] + 1).cast("int"))))

    scanned = scanned.withColumn("_text", F.when(F.size("added") > 0, cut(F.col("added"))).otherwise(F.col("_text")))
    text = F.col("_text")
    for kind in KINDS:
        needed, form, passes = _FORMS[kind]
        mark = F.lit(f"[{kind.upper()}]")
        parts = F.struct(F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("found"), F.split(text, form, -1).alias("gaps"))

        def marked(parts: Column) -> Column:
            found = parts["found"]

            def after(i: Column) -> Column:
                m = F.get(found, i)
                return F.when(m.isNull(), "").otherwise(F.when(passes(m), mark).otherwise(m) if passes else mark)

            return F.array_join(F.transform(parts["gaps"], lambda g, i: F.concat(g, after(i))), "")

        scanned = scanned.withColumn("_text", F.when(needed(text), let(parts, marked)).otherwise(text))
    return scanned.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
