"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base spans are the leftmost non-overlapping matches of four expressions, each followed by a check. The expressions here
are written with possessive loops and look-behind so that no text makes them slow; they match the same strings.

Bootstrapping: base spans are the seed entities. Each entity, and each unlabelled run of text shaped like an identifier
(candidate: digit groups joined by usual separators, addresses with a disguised or spaced at sign or dot), has lexical patterns: the
whole words beside it. Patterns and instances form a graph that is scored in turns:

* a pattern's confidence for a kind is the share of its distinct instances that are accepted entities of that kind,
  if enough are (``MIN_SEEDS``), counting one more, and the doubling of unaccepted ones, against it;
* a candidate's score for a kind its shape allows is 1 - product of (1 - confidence) over its patterns;
  those of at least ``ACCEPT`` become entities, and their patterns count in the next turn, until a turn accepts nothing.

Every occurrence of an accepted value that touches no base span becomes a span. The graph holds identifiers only, so it is
small beside the texts; patterns and values are keys of map-side combined aggregates, never collected. Tables that are joined by
pattern or value are written first: a join of two plain shuffles is one whose large keys adaptive execution can split.

Everything runs as built-in expressions. Positions are running sums made in chunks, and texts are cut by blocks, so that a very long
text with many matches takes linear time. Defined results: null and empty texts have no spans; rows without doc_id and
repeated rows are treated like others; of kinds with equal scores the last by name counts; other input columns, whatever their names,
are ignored, and kept by ``stage``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5
ACCEPT = 0.8
_CHUNK = 64
_BLOCK = 4096

_LOCAL = r"[A-Za-z0-9._%+-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
_AT = r"[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]"
_DOT = r"[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]"
#: Runs shaped like an address whose at sign or dots are spaced, bracketed or spelt out; and digit groups.
CANDIDATE = (
    rf"(?<!{_LOCAL})[A-Za-z0-9]{_LOCAL}*+(?:\x20?(?:@|{_AT})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|{_DOT}|\x20dot\x20)\x20?[A-Za-z0-9-]++)*+|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)"
    r"|(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[\x20./:,_()-]{0,2}[0-9])++"
)
#: Patterns with a word in them.
_SAYS = r"pattern rlike '^[LR]{1,2} .*[^ _]'"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of ten."""
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.transform(F.sequence(F.lit(1), F.length(digits)), worth)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(IP_VALID)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array (none below zero), those before it combined, 0 for the first.

    Arrays are rebuilt as they grow, so this is done in chunks: within each, and over their results.
    """

    def scan(xs: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
        start = F.struct(F.lit(0).alias("all"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(op(a["all"], of(x)).alias("all"), F.array_append(a["out"], a["all"]).alias("out")))

    def run(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int"))
        return F.transform(at, lambda k: scan(F.slice(xs, k * _CHUNK + 1, _CHUNK)))

    def joined(chunks: Column) -> Column:
        before = scan(chunks, lambda x: x["all"])["out"]
        return F.flatten(F.zip_with(chunks, before, lambda x, b: F.transform(x["out"], lambda o: op(b, o))))

    none = F.expr("cast(array() as array<int>)")
    return _bound(values, lambda xs: F.when(F.size(xs) > 0, _bound(run(xs), joined)).otherwise(none))


def _placed(text: Column, pattern: str) -> Column:
    """Matches with their places: array of (at, to, value, before, after) in code points, end exclusive; the texts up to the next matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def zipped(hits: Column) -> Column:
        return _bound(gaps, lambda gaps: F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"), F.slice(gaps, 2, F.size(hits)).alias("next")))

    def one(x: Column, before: Column) -> Column:
        at = before + F.length(x["gap"])
        return F.struct(at.alias("at"), (at + F.length(x["hit"])).alias("to"), x["hit"].alias("value"), x["gap"].alias("before"), x["next"].alias("after"))

    def placed(both: Column) -> Column:
        return F.zip_with(both, running(F.transform(both, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, b: a + b), one)

    none = F.expr("cast(array() as array<struct<at:int,to:int,value:string,before:string,after:string>>)")
    return _bound(hits, lambda hits: F.when(F.size(hits) > 0, _bound(zipped(hits), placed)).otherwise(none))


def _free(found: Column, base: Column) -> Column:
    """Those of ``found`` that touch no span of ``base``: both are sorted, and the furthest end of earlier spans is carried on."""

    def free(found: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(found) - 1)
        ours = F.transform(at, lambda i: F.struct(F.get(found, i)["to"].alias("p"), F.lit(0).alias("side"), F.get(found, i)["at"].alias("at"), i.alias("i"), F.lit(0).alias("end")))
        theirs = F.transform(base, lambda b: F.struct(b["at"].alias("p"), F.lit(1).alias("side"), b["at"].alias("at"), F.lit(0).alias("i"), b["to"].alias("end")))

        def swept(events: Column) -> Column:
            reach = running(F.transform(events, lambda e: e["end"]), lambda a, b: F.greatest(a, b))
            clear = F.zip_with(events, reach, lambda e, r: F.when((e["side"] == 0) & (r <= e["at"]), e["i"]))
            return F.transform(F.array_compact(clear), lambda i: F.get(found, i))

        return _bound(F.array_sort(F.concat(ours, theirs)), swept)

    return _bound(found, lambda found: F.when((F.size(found) > 0) & (F.size(base) > 0), free(found)).otherwise(found))


def _guarded(text: Column, kind: str) -> Column:
    """Whether the text can hold a match at all; the costly expression runs only then."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]


def _words(x: Column) -> Column:
    """Lexical patterns of an entity: two words before it, the word before with the word after, and each alone."""
    word = lambda s, p: F.regexp_replace(F.lower(F.regexp_extract(s, p, 1)), "[0-9]", "0")
    left = word(x["before"], r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$")
    left2 = word(x["before"], r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$")
    right = word(x["after"], r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)")

    def patterns(w: Column) -> Column:
        left, left2, right = w["l"], w["ll"], w["r"]
        return F.array(
            F.concat(F.lit("L "), left), F.concat(F.lit("R "), right), F.concat(F.lit("LL "), F.regexp_replace(left2, r"[\x20\x09-\x0D]+", " ")), F.concat_ws(" _ ", F.lit("LR"), left, right)
        )

    return _bound(F.struct(left.alias("l"), left2.alias("ll"), right.alias("r")), patterns)


def _shapes(value: Column) -> Column:
    """The kinds an unlabelled value may be."""
    n = F.length(_digits(value))
    allowed = [
        F.when(value.rlike(rf"@|{_AT}|\x20at\x20"), F.lit("email")),
        F.when(value.rlike(r"^[0-9]{1,3}(?:[\x20.,:_-]{1,2}[0-9]{1,3}){3}$"), F.lit("ip")),
        F.when(n.between(12, 19) & value.rlike(r"^[\x200-9./_-]+$"), F.lit("card")),
        F.when(n.between(7, 15) & value.rlike(r"^[\x200-9()./+-]+$"), F.lit("phone")),
    ]
    return F.array_compact(F.array(*allowed))


def _entities(text: Column, kind: str, pattern: str) -> Column:
    kept = F.filter(_placed(text, pattern), lambda x: _valid(kind, x["value"]))
    return F.transform(
        kept,
        lambda x: F.struct(
            x["at"].alias("at"),
            F.lit(KINDS.index(kind)).alias("k"),
            F.lit(kind).alias("kind"),
            x["to"].alias("to"),
            x["value"].alias("value"),
            _words(x).alias("words"),
        ),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Names a row by its content, in 128 bits."""
    return F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit("second")).alias("k2")


def base_spans(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``(doc_id, k1, k2, base, candidates)``: k1 and k2 name the row by its content. ``carry`` adds the whole ``row`` as a struct."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    names = ["doc_id", "k1", "k2"] + ["row"] * carry
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *row)
    rows = rows.select("*", *_key(F.col("doc_id"), F.col("text")))
    text = F.col("text")
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
    for kind, pattern in patterns.items():
        rows = rows.withColumn(kind, F.when(_guarded(text, kind), _entities(text, kind, pattern)))
    none = F.expr("cast(array() as array<struct<at:int,k:int,kind:string,to:int,value:string,words:array<string>>>)")
    base = F.concat(*(F.coalesce(F.col(kind), none) for kind in KINDS))
    may = text.rlike(rf"[0-9][\x20./:,_()-]{{0,2}}[0-9]|@|{_AT}|\x20at\x20")
    rows = rows.select(*names, base.alias("base"), F.when(may, _placed(text, CANDIDATE)).alias("words"))
    shaped = F.transform(
        "words", lambda x: F.struct(x["at"].alias("at"), x["to"].alias("to"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"), _shapes(x["value"]).alias("shapes"))
    )
    rows = rows.withColumn("words", F.filter(shaped, lambda x: F.size(x["shapes"]) > 0))
    told = F.transform(
        _free(F.col("words"), F.col("base")),
        lambda x: F.struct(x["at"].alias("at"), x["to"].alias("to"), x["value"].alias("value"), _words(x).alias("words"), x["shapes"].alias("shapes")),
    )
    return rows.select(*names, "base", told.alias("candidates"))


def bootstrap(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``(value, kind)`` of candidates that the pattern graph accepts, in as many turns as accept any."""
    seeds = found.select(F.explode("base").alias("x")).select("x.kind", "x.value", F.explode("x.words").alias("pattern")).distinct()
    unlabelled = found.select(F.explode("candidates").alias("x")).select("x.value", "x.shapes", F.explode("x.words").alias("pattern"))
    edges = scratch.keep(
        unlabelled.select("value", "pattern", F.explode("shapes").alias("kind")).distinct().filter(_SAYS), "edges"
    )
    labelled = scratch.keep(seeds.filter(_SAYS), "labelled")
    accepted, n = None, 0
    while True:
        entities = labelled
        open_edges = edges
        if accepted is not None:
            entities = labelled.unionByName(edges.join(accepted, ["value", "kind"]).select("kind", "value", "pattern"))
            open_edges = edges.join(accepted.select("value"), "value", "left_anti")
        per_kind = entities.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("good"))
        against = open_edges.groupBy("pattern").agg(F.count_distinct("value").alias("open"))
        known = per_kind.groupBy("pattern").agg(F.sum("good").alias("known"))
        confidence = scratch.keep(
            per_kind.filter(f"good >= {MIN_SEEDS}")
            .join(known, "pattern")
            .join(against, "pattern", "left")
            .select("pattern", "kind", (F.col("good") / (F.col("known") + F.coalesce(F.log2(F.col("open") + 1), F.lit(0)) + 1)).alias("conf")),
            "confidence",
        )
        scored = (
            open_edges.join(confidence, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("conf")))), 9).alias("score"))
            .filter(F.col("score") >= ACCEPT)
            .groupBy("value")
            .agg(F.max(F.struct("score", "kind")).alias("best"))
            .select("value", F.col("best.kind").alias("kind"))
        )
        accepted = scratch.keep(scored if accepted is None else accepted.unionByName(scored), "accepted")
        before, n = n, accepted.count()
        if n == before:
            return accepted


def find_pii(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``(doc_id, k1, k2, base, spans)`` per row; spans are (at, k, kind, to), base ones and accepted ones in order.

    ``carry`` adds the whole ``row`` as a struct: it is written along, so that no text is shuffled for what few rows get beside.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(base_spans(docs, carry), "found")
    accepted = bootstrap(found, scratch)
    more = scratch.keep(
        found.select("k1", "k2", F.explode("candidates").alias("x"))
        .select("k1", "k2", "x.value", "x.at", "x.to")
        .join(accepted, "value")
        .withColumn("k", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1)
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("at", "k", "kind", "to")).alias("more")),
        "more",
    )
    slim = lambda c: F.transform(c, lambda x: F.struct(x["at"].alias("at"), x["k"].alias("k"), x["kind"].alias("kind"), x["to"].alias("to")))
    none = F.expr("cast(array() as array<struct<at:int,k:int,kind:string,to:int>>)")
    return found.join(more, ["k1", "k2"], "left").select(
        *(c for c in found.columns if c not in ("base", "candidates")),
        F.array_sort(slim("base")).alias("base"),
        F.array_sort(F.concat(slim("base"), F.coalesce("more", none))).alias("spans"),
    )


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["at"], x["to"])), ",")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first one's kind in angle brackets.

    ``spans`` are sorted. Pieces are cut from blocks of the text, so each costs no more than its own length and a block.
    """

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Code points from a up to b."""
        first, last = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
        head = lambda block, n: F.coalesce(F.substring(F.get(blocks, block), F.lit(1), n), F.lit(""))
        within = F.substring(F.get(blocks, first), a - first * _BLOCK + 1, b - a)
        tail = F.substring(F.get(blocks, first), a - first * _BLOCK + 1, F.lit(_BLOCK))
        middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(F.coalesce(tail, F.lit("")), middle, head(last, b - last * _BLOCK))
        return F.when(a >= b, F.lit("")).when(first == last, F.coalesce(within, F.lit(""))).otherwise(across)

    def pieces(blocks: Column) -> Column:
        def joined(reach: Column) -> Column:
            ends = F.zip_with(spans, reach, lambda x, r: F.struct(x["at"].alias("at"), r.alias("from"), x["kind"].alias("kind")))
            fresh = F.filter(ends, lambda x: x["at"] >= x["from"])
            made = F.transform(fresh, lambda x: F.concat(cut(blocks, x["from"], x["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
            last = F.array_max(F.transform(spans, lambda x: x["to"]))
            return F.concat(F.array_join(made, ""), cut(blocks, last, F.length(text)))

        return _bound(running(F.transform(spans, lambda x: x["to"]), lambda a, b: F.greatest(a, b)), joined)

    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), pieces)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text. All rows stay, and travel as structs, so that no column name clashes."""
    made = find_pii(docs, carry=True).select(
        "row", F.when(F.size("spans") > 0, redacted(F.col("row.text").cast("string"), F.col("spans"))).alias("fresh")
    )
    kept = []
    for name, kind in docs.dtypes:
        column = F.col("row").getField(name)
        if name == "text":
            column = F.coalesce("fresh", column)
        elif name == "n_chars":
            column = F.when(F.col("fresh").isNotNull(), F.length("fresh")).otherwise(column)
        kept.append(column.cast(kind).alias(name))
    return made.select(*kept)
