"""Personal data in texts: fixed base rules, and contextual patterns bootstrapped from what these find.

DataFrame functions only. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import staged, text_key, whole

# The base rules, written so that no text takes quadratic time.
# A run is entered at its first character only, and what can't be given back is
# possessive; the matches are those of the plain expressions.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

#: Words with an @ or at least six digits may be identifiers that no base rule knows.
LOOSE = r"(?<![^\s])(?=(?:[^\s0-9]*+[0-9]){6}|[^\s@]*+@)[^\s]++"
#: So may runs of seven digits and more with the separators of the base kinds, and groups of hex digits with colons, whatever words they span.
RUN = r"(?<![0-9A-Za-z:])[0-9A-Fa-f]++(?:::?[0-9A-Fa-f]++)++(?![0-9A-Za-z])|(?:\+|\((?=[0-9]++\)))?+(?<![0-9])(?=[0-9](?:SEP?[0-9]){6})[0-9](?:SEP?[0-9])*+".replace("SEP", r"(?: ?\(|\) ?[.-]?| ?- ?|[ .])")
#: Code points on either side in which context words are looked for.
REACH = 64

#: A text is masked in parts of so many code points, since the place of a span is counted from the front of a string.
PART = 512

SPAN = "array<struct<start:int,end:int,kind:string,value:string,before:string,after:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^(|[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


_RULES = {
    "email": (EMAIL, lambda text: text.contains("@"), lambda value: F.lit(True)),
    "ip": (IP, lambda text: text.rlike(r"[0-9]\.[0-9]"), _small_parts),
    "card": (CARD, lambda text: text.rlike("[0-9][0-9 -]{13}"), lambda value: (F.length(_digits(value)) <= 19) & F.call_function("luhn_check", _digits(value))),
    "phone": (PHONE, lambda text: text.contains("+"), lambda value: F.length(_digits(value)).between(10, 15)),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(items: Column) -> Column:
    """An array in stretches, as many as each has items."""
    size = F.size(items)
    length = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), length), lambda first: F.slice(items, first + 1, length))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What the integers before each one come to, from 0.

    An array grows by being copied, so it is built stretch by stretch: n values
    cost n times the root of n small copies, of numbers only.
    """

    def along(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda done, x: F.struct(add(done["at"], x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])

    def over(stretches: Column) -> Column:
        totals = F.transform(stretches, lambda items: F.aggregate(items, F.lit(0), add))
        return F.flatten(F.zip_with(stretches, along(totals, F.lit(0)), along))

    return _let(values, lambda v: _let(_cut(v), over))


def _meeting(spans: Column, others: Column, test: Callable[[Column, Column], Column], not_: bool) -> Column:
    """The ``spans`` of which ``test`` holds (or doesn't) with some of ``others`` that overlaps them; only stretches of others that reach a span are looked through."""

    def bounds(items: Column) -> Column:
        return F.struct(items[0]["start"].alias("start"), F.array_max(F.transform(items, lambda y: y["end"])).alias("end"), items.alias("items"))

    def meets(x: Column, stretches: Column) -> Column:
        return F.exists(stretches, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]) & F.exists(s["items"], lambda y: test(x, y)))

    sorted_ = F.array_sort(F.transform(others, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"))))
    stretches = _let(sorted_, lambda o: F.transform(_cut(o), bounds))
    return _let(stretches, lambda found: F.filter(spans, lambda x: ~meets(x, found) if not_ else meets(x, found)))


def _spans(text: Column, pattern: str, kind: str | None, valid) -> Column:
    """All valid matches of ``pattern`` with their context. What stands between matches gives their places."""

    def placed(both: Column) -> Column:
        gaps, values = both["gaps"], both["values"]

        def span(value: Column, i: Column, at: Column) -> Column:
            start = at[i] + F.length(gaps[i])
            end = start + F.length(value)
            return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).cast("string").alias("kind"), value.alias("value"), F.right(gaps[i], F.lit(REACH)).alias("before"), F.left(gaps[i + 1], F.lit(REACH)).alias("after"))

        lengths = F.transform(values, lambda value, i: F.length(gaps[i]) + F.length(value))
        spans = _let(_running(lengths, lambda a, b: a + b), lambda at: F.transform(values, lambda value, i: span(value, i, at)))
        return F.filter(spans, lambda x: valid(x["value"])).cast(SPAN)

    none = F.array().cast(SPAN)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return _let(both, lambda b: F.when(F.size(b["values"]) > 0, placed(b)).otherwise(none))


def base_spans(text: Column) -> Column:
    """What the base rules find, kind after kind. The costly part runs only on texts that can have a match."""
    none = F.array().cast(SPAN)
    return F.concat(*(F.when(may(text), _spans(text, pattern, kind, valid)).otherwise(none) for kind, (pattern, may, valid) in _RULES.items()))


def loose_spans(text: Column) -> Column:
    """Words that may be identifiers, without punctuation at their ends, and runs of digits over several words."""
    none = F.array().cast(SPAN)
    words = F.when(text.rlike("@|[0-9]"), _spans(text, LOOSE, None, lambda value: F.lit(True))).otherwise(none)

    def core(span: Column) -> Column:
        value = F.regexp_replace(span["value"], r"[^0-9A-Za-z]++$", "")
        inner = F.regexp_replace(value, "^[^0-9A-Za-z]++", "")
        end = span["start"] + F.length(value)
        return F.struct((end - F.length(inner)).alias("start"), end.alias("end"), span["kind"].alias("kind"), inner.alias("value"), span["before"].alias("before"), span["after"].alias("after"))

    runs = F.when(text.rlike(RUN), _spans(text, RUN, None, lambda value: F.exists(F.array(*map(F.lit, KINDS)), lambda kind: _plausible(kind, value)))).otherwise(none)
    return F.concat(F.transform(words, core).cast(SPAN), runs)


def _weight(value: Column, before: Column, after: Column) -> Column:
    """One half for a word among other groups of digits and for a run with such words: they are one place, so they count as one."""
    inner = before.rlike(r"[0-9][ ().-]{1,3}$") | after.rlike(r"^[ ().-]{1,3}[0-9]")
    return F.when(inner | value.rlike(r"[ ()].*[0-9](?:[^\s0-9]?[0-9]){5}|[0-9](?:[^\s0-9]?[0-9]){5}.*[ ()]"), F.lit(0.5)).otherwise(F.lit(1.0))


def _contexts(before: Column, after: Column) -> Column:
    """Lexical patterns of a place: the words around it, in lower case, with digits as 0."""

    def word(text: Column, place: int) -> Column:
        words = F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"\s+"), lambda w: w != "")
        return F.try_element_at(words, F.lit(place))

    left, further, right = word(before, -1), word(before, -2), word(after, 1)
    return F.array_compact(
        F.array(
            F.concat(F.lit("L "), left),
            F.concat(F.lit("R "), right),
            F.concat(F.lit("LL "), further, F.lit(" "), left),
            F.concat(F.lit("LR "), left, F.lit(" "), right),
        )
    )


def _plausible(kind: Column, value: Column) -> Column:
    """Whether an unseen identifier can be of a kind at all."""
    n = F.length(_digits(value))
    return F.when(kind == "email", value.contains("@")).when(kind == "ip", value.rlike(r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){3,7}$")).when(kind == "card", n.between(12, 19)).otherwise(n.between(7, 15))


def bootstrap(places: DataFrame, confident: float, support: int) -> DataFrame:
    """``value`` and ``kind`` of identifiers that only their contexts give away.

    ``places``: ``value``, ``kind`` (null where unknown), ``before``, ``after``.
    A word and the run it is in are values of their own of half the weight.
    Patterns and values are a graph. In each round a pattern scores, for a kind,
    the summed scores of its values over their number plus one; patterns of at
    least ``support`` values and a score of ``confident`` count. A value unseen
    so far scores 1 - product(1 - pattern score); from ``confident`` on it is
    found, keeps this score and its kind, and takes part in the next round.
    Rounds end when one finds nothing new. Seeds keep the score 1.

    Edges are made distinct and sums taken in every task before a shuffle, so a
    word that stands before a third of all identifiers is one row per task.
    """
    weight = F.when(F.col("kind").isNull(), _weight(F.col("value"), F.col("before"), F.col("after"))).otherwise(F.lit(1.0))
    edges = places.select("value", "kind", weight.alias("weight"), F.explode(F.array_distinct(_contexts(F.col("before"), F.col("after")))).alias("pattern"))
    edges = staged(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("weight").alias("weight")))
    sizes = staged(edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("weight").alias("n")).where(F.col("values") >= support))
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.sum(F.lit(1.0)).alias("mass"))
    open_edges = edges.where("kind IS NULL").select("pattern", "value", "weight")
    found = None
    while True:
        mass = seeds
        if found is not None:
            learned = open_edges.join(found, "value").groupBy("pattern", "kind").agg(F.sum(F.col("score") * F.col("weight")).alias("mass"))
            mass = seeds.unionByName(learned).groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
        scored = mass.join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("pattern_score")).where(F.col("pattern_score") >= confident)
        hits = open_edges.join(scored, "pattern").where(_plausible(F.col("kind"), F.col("value")))
        if found is not None:
            hits = hits.join(found.select("value"), "value", "left_anti")
        by_kind = hits.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("pattern_score", F.lit(0.999)))))).alias("score"))
        best = by_kind.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best"))
        new = staged(best.select("value", "best.kind", "best.score").where(F.col("score") >= confident))
        if new.isEmpty():
            return new.select("value", "kind") if found is None else found.select("value", "kind")
        found = new if found is None else staged(found.unionByName(new))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confident: float = 0.75, support: int = 3) -> DataFrame:
    """Per document ``doc_id``, ``text_key``, and the spans ``base`` and ``spans``: base rules, and these with what contexts add.

    Spans are structs (start, ``place`` of the kind in ``KINDS``, end, kind,
    value), by start and kind. Added ones overlap no base span and lie in no other added one.

    Defined results: a null or empty text has no spans; repeated rows have a row
    each; a null id is a row like others; other columns are not read; an empty
    table gives an empty result. Time is linear in the text; the n spans of
    one text cost n times the root of n steps.
    """
    text = F.col("text")
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), whole(text_col).alias("text"))
    rows = staged(source.select("doc_id", "text_key", base_spans(text).alias("base"), loose_spans(text).alias("loose")))
    overlap = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    apart = _meeting(F.filter("loose", lambda x: F.length(x["value"]) > 0), F.col("base"), overlap, not_=True)
    rows = rows.withColumn("loose", F.when((F.size("base") > 0) & (F.size("loose") > 0), apart).otherwise(F.col("loose")))
    places = rows.select("doc_id", "text_key", F.explode(F.concat("base", "loose")).alias("s")).select("doc_id", "text_key", "s.*")
    learned = bootstrap(places, confident, support)
    extra = places.where("kind IS NULL").drop("kind").join(learned, "value")
    extra = extra.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end", "kind", "value")).alias("extra"))
    within = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    outer = _meeting(F.col("extra"), F.col("extra"), within, not_=True)
    extra = extra.withColumn("extra", outer)
    extra = extra.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})

    def ordered(spans: Column) -> Column:
        place = lambda s: F.array_position(F.lit(KINDS), s["kind"]).cast("int")
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    base = ordered(F.col("base"))
    return rows.join(extra, same, "left").select("doc_id", "text_key", base.alias("base"), F.when(F.col("extra").isNull(), base).otherwise(F.array_sort(F.concat(base, ordered(F.col("extra"))))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans by the first one's kind.

    A column ``n_chars`` is set to the new length of changed texts. Texts without
    spans stay as they are, null included.
    """
    found = find(docs, id_col, text_col).where("size(spans) > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    found = found.dropDuplicates(["_id", "_key"])
    text = F.col(text_col)

    def replaced(at: Column, parts: Column) -> Column:
        """Text between spans, which starts where all spans before end, and labels."""

        def between(first: Column, end: Column) -> Column:
            several = F.slice(parts, F.floor(first / PART).cast("int") + 1, (F.floor(end / PART) - F.floor(first / PART)).cast("int") + 1)
            return F.substring(F.array_join(several, ""), first % PART + 1, end - first)

        pieces = F.zip_with("_spans", at, lambda s, before: F.when(s["start"] >= before, F.concat(between(before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))
        last = F.array_max(F.transform("_spans", lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    ends = _running(F.transform("_spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    masked = _let(F.struct(ends.alias("at"), parts.alias("parts")), lambda b: replaced(b["at"], b["parts"]))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (text_key(text_col) == F.col("_key"))
    joined = docs.join(found, same, "left").withColumn("_masked", F.when(F.col("_spans").isNotNull(), masked))
    changed = {text_col: F.coalesce("_masked", text_col)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_masked").isNotNull(), F.length("_masked")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))
