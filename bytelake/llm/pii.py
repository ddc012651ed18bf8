r"""Personal data: base spans by rule, and candidates of high-recall generators selected by boosted trees.

Base spans, leftmost and non-overlapping for each kind, positions in code points, end exclusive:

- email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
- ip ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, each part at most 255
- card ``[0-9]([\x20-]?[0-9])+``, 16 to 19 digits that pass Luhn's test
- phone ``\+[0-9][\x20().0-9-]+[0-9]``, 8 to 15 digits
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelake.llm.boosting import Boosted, count_thresholds, fit_counts, table_counts, table_cuts
from bytelake.llm.common import discard, materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The base patterns as linear-time ones with the same matches: a match starts at the end of the last one or where no
#: character of its first class stands before, and nothing is given back. A card is a whole chain of 16 to 19 digits.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall generators: obfuscated marks, other separators, no country code, unusual digit counts. A dot before a space ends
#: a sentence and a span.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?(?:@|\[at\]|\(at\)) ?)[A-Za-z0-9-]++(?:(?:\.| \. | ?(?:\[dot\]|\(dot\)) ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\[\.\]| \. )[0-9]{1,4}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:(?:(?!\. )[ .-]){0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?[(]?[0-9](?:(?:(?!\. )[ ().\/-]){0,2}[0-9]){6,14}(?![0-9A-Za-z])",
}
#: What a text needs at least for a generator of the kind to be tried.
NEEDS = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9](?:\.|\[\.\]| \. )[0-9]", "card": r"[0-9][ .-]{0,2}[0-9][ .-]{0,2}[0-9][ .-]{0,2}[0-9]", "phone": r"[0-9][ ().\/-]{0,2}[0-9][ ().\/-]{0,2}[0-9][ ().\/-]{0,2}[0-9]"}
#: Words before a span that speak for its kind.
HINTS = {"email": r"mail|contact|write|e-?mail|address", "ip": r"\bip\b|server|host|addr|node|ping", "card": r"card|visa|credit|pay|account|iban", "phone": r"phone|call|tel|mobile|fax|cell|dial"}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(values: Column, combine: Callable[[Column, Column], Column], first: int, block: int = 64) -> Column:
    """For each of an array's ints, ``first`` combined with all before it. In blocks, whose results are combined, for arrays grow by copies."""
    start = F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out"))

    def run(items: Column, size: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, start, lambda a, x: F.struct(combine(a["at"], size(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: run(F.slice(v, b * block + 1, F.lit(block)), lambda x: x))

    def joined(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, run(parts, lambda x: x["at"])["out"], lambda x, before: F.transform(x["out"], lambda y: combine(before, y))))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(blocks(v), joined)).otherwise(F.array().cast("array<int>")))


def found(text: Column, pattern: str, context: int = 24) -> Column:
    """array<struct<start, end, hit, before, after>> of a pattern's matches, in linear time: places from the lengths of the matches
    and of what lies between. before and after: up to ``context`` characters, none beyond the neighbouring match."""
    none, pad = F.array().cast(SPAN), F.array(F.lit(""))

    def spans(hits: Column, gaps: Column) -> Column:
        n = F.size(hits)
        inner = F.zip_with(F.zip_with(hits, F.concat(pad, hits), lambda h, last: F.struct(h.alias("hit"), last.alias("last"))), F.zip_with(gaps, F.slice(gaps, F.lit(2), n), lambda g, after: F.struct(g.alias("gap"), after.alias("after"))), lambda x, y: F.struct(x["hit"].alias("hit"), x["last"].alias("last"), y["gap"].alias("gap"), y["after"].alias("after")))
        sizes = F.zip_with(hits, F.slice(gaps, F.lit(1), n), lambda h, g: F.length(g) + F.length(h))
        placed = F.zip_with(F.slice(inner, F.lit(1), n), scanned(sizes, lambda a, x: a + x, 0), lambda x, at: F.struct(
            (at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"),
            F.right(F.concat(x["last"], x["gap"]), F.lit(context)).alias("before"), F.left(x["after"], F.lit(context)).alias("after"),
        ))
        return F.when(n > 0, placed).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: bound(F.split(text, pattern, -1), lambda gaps: spans(hits, gaps)))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, sums of digits add up to a multiple of 10."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & luhn(digits(hit))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans by rule; matches that fail their test are dropped, without another try inside them."""
    need = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}[kind]
    return F.when(need, F.filter(found(text, BASE[kind]), lambda s: passes(kind, s["hit"]))).otherwise(F.array().cast(SPAN))


#: Names of a candidate's features, all doubles.
FEATURES = ["kind", "length", "digits", "others", "groups", "longest", "plus", "at", "dots", "spaces", "luhn", "first", "letter_end", "small_parts", "marked", "hint", "glued_left", "glued_right", "line_start", "valid", "strong"]
#: Shapes that speak for a kind without any word before: marks, groups and prefixes of addresses, cards and numbers.
STRONG = {
    "email": r"^[^ ]+$|[\[(]at[\])]", "ip": r".", "card": r"^[0-9]{4}(?:[ .-]{1,2}[0-9]{4}){2,3}(?:[ .-]{1,2}[0-9]{1,3})?$|^3[0-9]{3}[ .-]{1,2}[0-9]{6}[ .-]{1,2}[0-9]{5}$|^[0-9]{16,19}$",
    "phone": r"^(?:\+|00)|^\(?[0-9]{2,4}\)[ .-]{0,2}[0-9]{3,4}[ .-]{1,2}[0-9]{3,4}$|^[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}$",
}
#: No numbers of phones: dates, decimal numbers.
NO_PHONE = r"^(?:(?:19|20)[0-9]{2}[ .\/-][0-9]{1,2}[ .\/-][0-9]{1,2}|[0-9]{1,2}[ .\/-][0-9]{1,2}[ .\/-](?:19|20)[0-9]{2}|[0-9]+\.[0-9]+)(?:[^0-9]|$)"
#: What base spans are rewritten to, as further examples of their kind: pairs of a pattern and what takes its place, one after another.
REWRITES = {
    "email": [[(r"@", " [at] "), (r"\.([A-Za-z0-9-]+)$", " [dot] $1")], [(r"@", "(at)")]], "ip": [[(r"\.", "[.]")], [(r"\.", " . ")]],
    "card": [[(r"[ -]", ""), (r"([0-9]{4})(?=[0-9])", "$1.")]], "phone": [[(r"^\+", "00")], [(r"^\+[0-9]{1,3}[ .-]*\(?([0-9]{3})[ ().-]*([0-9]{3})[ .-]*([0-9]{4})$", "($1) $2-$3")], [(r"^\+[0-9]{1,3}[ .-]*\(?([0-9]{3})[ ().-]*([0-9]{3})[ .-]*([0-9]{4})$", "$1.$2.$3")]],
}


def plain(kind: str, hit: Column) -> Column:
    """A candidate with usual marks."""
    at = F.regexp_replace(hit, r" ?[\[(]at[\])] ?| @ ?|@ ", "@")
    return F.regexp_replace(at, r" ?[\[(](?:dot|\.)[\])] ?" + ("| \\. " if kind == "ip" else ""), ".") if kind in ("email", "ip") else hit


def valid(kind: str, hit: Column, before: Column, after: Column) -> Column:
    """Whether a candidate has the form of its kind, whatever its marks, and isn't part of a longer number."""
    n, apart = F.length(digits(hit)), ~before.rlike(r"[0-9][ .()\/-]{0,2}$") & ~after.rlike(r"^(?:(?!\. )[ .()\/-]){0,2}[0-9]")
    if kind == "email":
        return plain(kind, hit).rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$") & hit.rlike(r"[^A-Za-z][A-Za-z]{2,24}$")
    if kind == "ip":
        return plain(kind, hit).rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$") & apart
    if kind == "card":
        return n.between(13, 19) & luhn(digits(hit)) & ~digits(hit).rlike(r"^0+$") & apart
    groups = F.regexp_replace(hit, r"^(?:\+|00)[0-9]{1,3}[ ().\/-]+|^[0-9][ ().\/-]+(?=[(]?[0-9]{3})", "")
    return n.between(7, 15) & ~hit.rlike(NO_PHONE) & ~groups.rlike(r"(?<![0-9])[0-9](?![0-9])") & (hit.rlike(r"^(?:\+|00)|[^0-9]") | n.between(9, 12)) & apart


def features(kind: str, s: Column) -> list[Column]:
    """Format of the span and context around it: up to 24 characters before, a few after."""
    hit, d = s["hit"], digits(s["hit"])
    before, after = F.lower(s["before"]), F.left(s["after"], F.lit(3))
    parts = F.filter(F.split(hit, "[^0-9]+"), lambda p: p != "")
    yes = lambda c: c.cast("double")
    columns = [
        F.lit(float(KINDS.index(kind))), F.length(hit), F.length(d), F.length(hit) - F.length(d), F.size(parts), F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)),
        yes(hit.startswith("+")), yes(hit.contains("@")), F.length(hit) - F.length(F.replace(hit, F.lit("."), F.lit(""))), F.length(hit) - F.length(F.replace(hit, F.lit(" "), F.lit(""))),
        yes((F.length(d) > 0) & luhn(d)), F.coalesce(F.substring(d, 1, 1).try_cast("double"), F.lit(-1.0)), yes(hit.rlike("[A-Za-z]{2,24}$")), yes(F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))),
        yes(hit.rlike(r"[\[\(](?:at|dot|\.)[\]\)]")), yes(before.rlike(HINTS[kind])), yes(before.rlike(r"[\p{L}0-9]$")), yes(after.rlike(r"^[\p{L}0-9]")), yes((s["start"] == 0) | before.rlike(r"\n$")),
        yes(valid(kind, hit, before, after)), yes(hit.rlike(STRONG[kind])),
    ]
    return [c.cast("double").alias(n) for c, n in zip(columns, FEATURES, strict=True)]


def overlapping(spans: Column, others: Column) -> Column:
    """For each span, whether it overlaps one of the others; both by (start, end). Sorted and scanned once, not all with all."""
    far = (1 << 31) - 1

    def marked(line: Column) -> Column:
        ends = scanned(F.transform(line, lambda x: F.when(x["own"], 0).otherwise(x["end"])), F.greatest, 0)
        starts = F.reverse(scanned(F.transform(F.reverse(line), lambda x: F.when(x["own"], far).otherwise(x["start"])), F.least, far))
        seen = F.zip_with(line, F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x, y: F.struct(x["nth"].alias("nth"), x["own"].alias("own"), ((y["e"] > x["start"]) | (y["s"] < x["end"])).alias("hit")))
        return F.transform(F.sort_array(F.filter(seen, lambda x: x["own"])), lambda x: x["hit"])

    mine = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.lit(True).alias("own"), s["end"].alias("end"), i.alias("nth")))
    theirs = F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("own"), s["end"].alias("end"), F.lit(-1).alias("nth")))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), bound(F.sort_array(F.concat(mine, theirs)), marked)).otherwise(F.transform(spans, lambda s: F.lit(False)))


TRY = f"array<struct<start:int,end:int,rule:boolean,{','.join(f'{f}:double' for f in FEATURES)}>>"


def described(kind: str, spans: Column, own: Column, others: Column, rule: Callable[[dict[str, Column], Column, Column], Column]) -> Column:
    """Spans with their features and their label, made from these and from what they overlap; own, others: a boolean for each span."""
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *features(kind, s)))
    flagged = F.zip_with(bare, F.zip_with(own, others, lambda a, b: F.struct(a.alias("own"), b.alias("others"))), lambda c, o: F.struct(c.alias("c"), o.alias("o")))
    return F.transform(flagged, lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), rule({f: x["c"][f] for f in FEATURES}, x["o"]["own"], x["o"]["others"]).alias("rule"), *[x["c"][f].alias(f) for f in FEATURES]))


def candidates(text: Column, kind: str, base: Column, others: Column) -> Column:
    """Candidates with their features; rule, their label, doesn't depend on the base pattern's marks: a form that is valid, with a
    shape or a word before that speaks for the kind, or a base span of the kind in its place; but not a span of another kind."""
    likely = lambda f, own, other: own | ((f["valid"] == 1) & ((f["strong"] == 1) | (f["hint"] == 1)) & ~other)
    return F.when(text.rlike(NEEDS[kind]), bound(found(text, LOOSE[kind]), lambda spans: described(kind, spans, overlapping(spans, base), overlapping(spans, others), likely))).otherwise(F.array().cast(TRY))


def rewritten(kind: str, base: Column) -> Column:
    """Base spans with other marks in their real context: examples of the kind that the base pattern doesn't match."""

    def one(steps: list[tuple[str, str]]) -> Column:
        def change(hit: Column) -> Column:
            for pattern, to in steps:
                hit = F.regexp_replace(hit, pattern, to)
            return hit

        made = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), change(s["hit"]).alias("hit"), s["before"].alias("before"), s["after"].alias("after"), s["hit"].alias("was")))
        return F.filter(made, lambda s: s["hit"] != s["was"])

    def label(spans: Column) -> Column:
        yes = F.transform(spans, lambda s: F.lit(True))
        return described(kind, spans, yes, yes, lambda f, own, other: F.lit(True))

    return F.when(F.size(base) > 0, bound(F.concat(*[one(x) for x in REWRITES[kind]]), label)).otherwise(F.array().cast(TRY))


def fit_selector(found_rows: DataFrame, *, precision: float = 0.99, bins: int = 16, **options) -> tuple[Boosted, dict[str, float]]:
    """Trees and a threshold for each kind, from all candidates.

    Labels are those of candidates() and rewritten(); every fifth, by hash, is kept out and calibrates the threshold:
    the least score, even odds or more, from which on ``precision`` of them are positive (none: nothing is added).
    Candidates are counted by bins of their features in Spark; the driver gets cuts, sums by bin, and thresholds.
    """
    c = found_rows.select(F.explode(F.concat(*[f"{x}_{k}" for x in ("try", "like") for k in KINDS])).alias("c"), "text_hash").select("c.*", "text_hash")
    c = c.withColumn("out", F.pmod(F.xxhash64(*FEATURES, "start", "text_hash"), F.lit(5)) == 0)
    cuts = table_cuts(c, FEATURES, "out", bins)
    cuts[0] = np.arange(len(KINDS), dtype=float)  # each kind is a bin, however rare, for thresholds are by kind
    counts = materialize(table_counts(c, FEATURES, cuts, ["out"], "rule"), "candidates")
    model = fit_counts(counts.where(~F.col("out")), FEATURES, cuts, **options)
    least = count_thresholds(counts.where("out"), model, "kind", precision)
    discard(counts)
    return model, {k: max(0.0, least.get(float(i), float("inf"))) for i, k in enumerate(KINDS)}


def selected(tries: Column, taken: Column, model: Boosted, threshold: float) -> Column:
    """Candidates from the threshold on that overlap none of the spans taken. Those of a kind never overlap each other, as matches of a pattern."""
    if threshold == float("inf"):
        return F.array().cast("array<struct<start:int,end:int>>")

    def free(spans: Column) -> Column:
        open_ = F.filter(F.zip_with(spans, overlapping(spans, taken), lambda s, hit: F.struct(s.alias("s"), hit.alias("hit"))), lambda x: ~x["hit"])
        return F.transform(open_, lambda x: x["s"])

    return bound(F.transform(F.filter(tries, lambda c: model.logit(lambda f: c[f]) >= threshold), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))), free)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **selector) -> DataFrame:
    """(doc_id, base_<kind>, more_<kind>) for each input row and kind: arrays of (start, end), ascending.

    Plan: one narrow pass over the texts makes base spans and candidates; without the texts they go to the shared
    folder. The selector is fitted on all of them, by counts and sums, and applied, as an expression, to all. No shuffle
    but those of the counts and sums.

    Defined cases: null text is empty and has no spans; null and repeated identifiers make no difference; texts of
    any length are searched whole, in linear time; an empty table gives no rows; where nothing can be learned (no
    candidates, or of one kind of label), only base spans are returned. Other columns are not read.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumns({f"base_{k}": base_spans(text, k) for k in KINDS})
    other = lambda k: F.concat(*[f"base_{x}" for x in KINDS if x != k])
    tries, likes = [candidates(text, k, F.col(f"base_{k}"), other(k)).alias(f"try_{k}") for k in KINDS], [rewritten(k, F.col(f"base_{k}")).alias(f"like_{k}") for k in KINDS]
    rows = rows.select("doc_id", *[F.transform(f"base_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(f"base_{k}") for k in KINDS], *tries, *likes, F.xxhash64(text).alias("text_hash"))
    rows = materialize(rows, "spans")
    model, thresholds = fit_selector(rows, **selector)
    for i, k in enumerate(KINDS):
        rows = rows.withColumn(f"more_{k}", selected(F.col(f"try_{k}"), F.concat(*[f"base_{x}" for x in KINDS], *[f"more_{x}" for x in KINDS[:i]]), model, thresholds[k]))
    return rows.select("doc_id", *[f"base_{k}" for k in KINDS], *[f"more_{k}" for k in KINDS])


def listed(columns: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""

    def one(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[one(k, c) for k, c in columns.items()]), ",")


def redact(text: Column, spans: Column, mark: str = "[redacted]", piece: int = 4096) -> Column:
    """The text with each span (start, end; ascending, not overlapping) replaced by a mark.

    What lies between is cut from pieces of the text, for a place in a string is found by counting from its start.
    """

    def between(pieces: Column, a: Column, b: Column) -> Column:
        lo, hi = F.floor(a / piece).cast("int"), F.floor((b - 1) / piece).cast("int")
        cut = lambda i: F.substring(F.element_at(pieces, i + 1), F.greatest(a - i * piece, F.lit(0)) + 1, F.least(b - i * piece, F.lit(piece)) - F.greatest(a - i * piece, F.lit(0)))
        return F.when(a < b, F.array_join(F.transform(F.sequence(lo, F.greatest(lo, hi)), cut), "")).otherwise("")

    def joined(pieces: Column) -> Column:
        ends, starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"])), F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: between(pieces, a, b)), mark)

    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / piece).cast("int")), lambda i: F.substring(text, i * piece + 1, F.lit(piece)))
    return bound(pieces, joined)
