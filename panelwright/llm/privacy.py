"""Personal data and terms that give it away, found with built-in functions.

Entities (addresses, numbers) are found by pattern. A term discloses an entity if the two
co-occur in the corpus so that seeing the term makes the entity likely: the pointwise mutual
information PMI(t; e) = log2(N n(t,e) / (n(t) n(e))) is held against the information of the entity
itself, IC(e) = log2(N / n(e)), which it reaches if t never stands without e. All counts are of distinct texts of
the whole corpus, so copies of one text prove nothing, and a term, any word or number outside the entities of a text, must be seen with the entity in several different
surroundings: texts that are near copies of each other (by sketches of their shingles, and what those link) are one
surrounding, so near copies prove nothing either. Nor do meetings that chance explains: by the binomial likelihood ratio fewer than one of
all terms tried would stand with the entity so often. Terms above the lower threshold are generalised, above the upper one
removed, in the texts that hold the entity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import fingerprints
from panelwright.llm.linked import components
from panelwright.llm.scratch import written

#: Patterns of entities, fixed values. A match begins where the last one ended or where no longer one could begin,
#: which spares the search quadratic time on long runs; a number is tested for length by the pattern itself.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Matches whose places are added up together, so that a text of n of them takes n times this and not n squared.
STRIDE = 128
WORD = r"[\p{L}\p{M}\p{N}_'’-]+"
#: Surroundings in which a term must be seen with an entity.
SUPPORT = 3
#: Resemblance from which texts are near copies, and least shingles of a text by which they are looked for.
ALIKE, KEYS = 0.75, 8
GENERALISE, REMOVE = 0.8, 0.95
#: Rows of terms up to which they go to all executors (under 100 bytes each); more are joined.
SMALL = 100_000


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of the values, each worked out once; in a lambda an expression is worked out for every element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), F.lit(0))


def _blocks(size: Column) -> Column:
    """Numbers of the blocks of ``STRIDE`` elements; one for none."""
    return F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / STRIDE).cast("int"))


def _block(elements: Column, b: Column) -> Column:
    return F.slice(elements, b * STRIDE + 1, STRIDE)


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches, leftmost and not overlapping: ``array<struct<start, end, value>>`` in code points, end exclusive.

    With ``keep`` only those whose value it is true of.
    """

    def length(steps: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s["gap"] + s["size"])

    def spans(steps: Column, before: Column) -> Column:
        numbered = F.transform(steps, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
        if keep is not None:
            numbered = F.filter(numbered, lambda x: keep(x["s"]["value"]))

        def span(x: Column) -> Column:
            start = before + length(F.slice(steps, F.lit(1), x["k"])) + x["s"]["gap"]
            return F.struct(start.alias("start"), (start + x["s"]["size"]).alias("end"), x["s"]["value"].alias("value"))

        return F.transform(numbered, span)

    def placed(x: Column) -> Column:
        of_blocks = F.transform(_blocks(F.size(x["steps"])), lambda b: _block(x["steps"], b))
        return _let(
            lambda y: F.flatten(F.transform(y["blocks"], lambda steps, b: spans(steps, F.aggregate(F.slice(y["sums"], F.lit(1), b), F.lit(0), lambda a, n: a + n)))),
            blocks=of_blocks,
            sums=F.transform(of_blocks, length),
        )

    step = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda v, gap: F.struct(v.alias("value"), F.char_length(gap).alias("gap"), F.char_length(v).alias("size")),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.coalesce(_let(placed, steps=F.filter(step, lambda s: s["value"].isNotNull())), none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    figures = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(figures, lambda f, i: F.when(i % 2 == 0, f.cast("int")).otherwise(2 * f.cast("int") - F.when(f.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


#: What must be in a text for a search to pay, and what a match must fulfil.
_HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_TEST = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _as_kind(spans: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def entities(text: Column) -> Column:
    """``array<struct<start, kind, end, value>>`` of all entities, by start and then kind (its place in ``KINDS``)."""
    none = F.array().cast(_SPAN)

    def of(kind: str) -> Column:
        spans = F.filter(located(text, PATTERNS[kind]), lambda s: _TEST[kind](s["value"]))
        return F.when(_HINT[kind](text), _as_kind(spans, kind)).otherwise(none)

    found = [of(kind) for kind in PATTERNS]
    return F.sort_array(F.concat(*found))


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in the place of its spans."""
    return sanitised(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - s["start"]).alias("put"))))


def _terms(text: Column) -> Column:
    """The distinct words and numbers of a whole text outside its entities."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_blanked(text, entities(text)), F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def _sent(table: DataFrame) -> DataFrame:
    """A written table ready to be joined: to all executors if it is small."""
    return F.broadcast(table) if table.count() <= SMALL else table


def _surroundings(texts: DataFrame) -> DataFrame:
    """``(h1, around)``: a name for each text that it shares with its near copies.

    ``texts`` has ``h1`` and ``sketch``, a row for each text. Texts that have one of their least shingles in
    common are compared with the least text that has it; those that are alike are linked.
    """
    keys = texts.select("h1", F.explode(F.slice("sketch", 1, KEYS)).alias("key"))
    least = keys.groupBy("key").agg(F.min("h1").alias("u"), F.count("*").alias("n")).where("n > 1").select("key", "u")
    pairs = keys.join(least, "key").where("h1 != u").select("u", F.col("h1").alias("v")).distinct()
    for side in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("h1").alias(side), F.col("sketch").alias(f"{side}_sketch")), side)
    alike = fingerprints.resemblance(F.col("u_sketch"), F.col("v_sketch")) >= ALIKE
    found = components(pairs.where(alike).select("u", "v"))
    found = texts.select("h1").join(found.withColumnRenamed("node", "h1"), "h1", "left")
    return found.select("h1", F.coalesce("component", "h1").alias("around"))


def disclosing_terms(docs: DataFrame, text: str, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """``(h1, h2, term, disclosure)``: for each text (by two hashes) the terms that disclose an entity in it.

    Terms are looked for in whole texts that hold an entity of ``support`` texts or more. Pairs of entity and term are
    counted with partial counts before each shuffle, so an entity of very many texts is spread over all tasks; terms that
    are in too many texts to reach ``threshold`` even if they stood with every sight of the entity make no pairs.
    """
    name = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", *name)
    held = rows.select("h1", "h2", F.explode(entities(F.col("text"))).alias("e"))
    held = written(held.select("h1", "h2", "e.kind", F.lower("e.value").alias("entity")).distinct(), "entities")
    # An entity of fewer texts has fewer surroundings.
    shared = written(held.groupBy("kind", "entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= support), "shared")
    most = shared.agg(F.max("with_entity")).first()[0]
    if most is None:
        return held.select("h1", "h2", F.lit("").alias("term"), F.lit(0.0).alias("disclosure")).limit(0)
    held = written(held.join(_sent(shared), ["kind", "entity"]), "held")
    n = float(rows.select(F.count_distinct("h1", "h2")).first()[0])

    ids = written(held.select("h1", "h2").distinct(), "ids")
    texts = rows.join(_sent(ids), ["h1", "h2"]).select("h1", "h2", fingerprints.sketch(F.col("text")).alias("sketch"), _terms(F.col("text")).alias("terms"))
    texts = written(texts.dropDuplicates(["h1", "h2"]), "texts")
    around = written(_surroundings(texts.select("h1", "sketch").dropDuplicates(["h1"])), "around")
    words = texts.select("h1", "h2", F.explode("terms").alias("term"))

    def bound(with_entity: Column) -> Column:
        return F.lit(1 + 1e-9) * F.pow(F.lit(n), F.lit(1 - threshold)) * F.pow(with_entity, F.lit(threshold))

    terms = words.groupBy("term").agg(F.count("*").alias("held"))
    terms = written(terms.where((F.col("held") >= support) & (F.col("held") <= bound(F.lit(most))) & F.col("term").rlike(r"[\p{L}\p{N}]")), "terms")
    tried = max(1, terms.count())
    pair = words.join(_sent(terms), "term").join(held, ["h1", "h2"]).where(F.col("held") <= bound(F.col("with_entity"))).join(_sent(around), "h1")
    seen = pair.groupBy("kind", "entity", "term", "with_entity", "around").agg(F.count("*").alias("both"))
    seen = seen.groupBy("kind", "entity", "term", "with_entity").agg(F.count("*").alias("around"), F.sum("both").alias("both"))
    seen = written(seen.where(F.col("around") >= support), "pairs")
    if seen.isEmpty():
        return seen.select(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "term", F.lit(0.0).alias("disclosure"))

    terms = written(seen.select("term").distinct(), "terms")
    # Each of m copies of a text counts 1 / m, so texts need not meet to be counted once.
    copies = written(rows.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    words = rows.join(_sent(copies), ["h1", "h2"], "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(_terms(F.col("text"))).alias("term"))
    of_term = words.join(_sent(terms), "term").groupBy("term").agg(F.round(F.sum(1 / F.col("copies"))).alias("with_term"))
    told = seen.join(of_term, "term")
    content = F.log2(F.lit(n) / F.col("with_entity"))
    mutual = F.log2(F.lit(n) * F.col("both") / (F.col("with_term") * F.col("with_entity")))
    told = told.withColumn("disclosure", F.when(content > 0, mutual / content).otherwise(0.0)).where(F.col("disclosure") >= threshold)
    p, q = F.col("both") / F.col("with_term"), F.col("with_entity") / F.lit(n)
    apart = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    told = told.where(F.col("with_term") * (p * F.log(p / q) + apart) >= math.log(tried))
    told = held.join(told.select("kind", "entity", "term", "disclosure"), ["kind", "entity"])
    told = told.join(texts.select("h1", "h2", F.explode("terms").alias("term")), ["h1", "h2", "term"])
    return told.groupBy("h1", "h2", "term").agg(F.max("disclosure").alias("disclosure"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by the names of their kinds, or by nothing where the value to put is empty.

    ``spans`` has ``start``, ``end`` and ``put`` and is sorted; of overlapping spans the first counts.
    """
    kind = "array<struct<start:int,end:int,put:string>>"

    def apart(spans: Column, at: Column) -> Column:
        """Those that begin where the one before has ended, and the last end."""
        state = F.struct(at.alias("at"), F.array().cast(kind).alias("kept"))
        return F.aggregate(
            spans,
            state,
            lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a),
        )

    def kept(x: Column) -> Column:
        def more(a: Column, b: Column) -> Column:
            return _let(lambda y: F.struct(y["new"]["at"].alias("at"), F.concat(y["kept"], F.array(y["new"]["kept"])).alias("kept")), new=apart(_block(x["spans"], b), a["at"]), kept=a["kept"])

        state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("kept"))
        return F.flatten(F.aggregate(_blocks(F.size(x["spans"])), state, more)["kept"])

    def end(spans: Column, k: Column) -> Column:
        """Where the k-th span ends, counted from 1; 0 before the first."""
        return F.when(k > 0, F.get(spans, k - 1)["end"]).otherwise(0)

    def part(spans: Column, b: Column) -> Column:
        """The text of a block of spans, put together from that part of the text alone."""
        first = end(spans, b * STRIDE)
        last = end(spans, F.least((b + 1) * STRIDE, F.size(spans)))
        return _let(
            lambda y: F.array_join(
                F.transform(
                    y["here"],
                    lambda s, k: _let(
                        lambda z: F.concat(F.substring(y["text"], z["from"] - y["first"] + 1, s["start"] - z["from"]), s["put"]),
                        **{"from": F.when(k > 0, F.get(y["here"], k - 1)["end"]).otherwise(y["first"])},
                    ),
                ),
                "",
            ),
            here=_block(spans, b),
            first=first,
            text=F.substring(text, first + 1, last - first),
        )

    def joined(x: Column) -> Column:
        tail = F.substring(text, end(x["spans"], F.size(x["spans"])) + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform(_blocks(F.size(x["spans"])), lambda b: part(x["spans"], b)), ""), tail)

    typed = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["put"].cast("string").alias("put")))
    return F.when(F.size(spans) > 0, _let(lambda x: _let(joined, spans=kept(x)), spans=typed)).otherwise(text)


def personal_data(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``(row, entities, spans, clean)``: each row without its text as a struct, entity spans, all spans, and the sanitised text.

    ``entities`` are the pattern matches; ``spans`` adds the occurrences, in the whole text, of terms
    that disclose one of them (see :func:`disclosing_terms`). A null or empty text has no span and an empty
    ``clean``. Ids are not read, so they may be null or repeat; equal texts get equal spans.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = written(disclosing_terms(docs, text, **limits), "disclosing")
    # Generated, so that no column built on them works them out again.
    rows = rows.select("row", "text", F.explode(F.array(entities(F.col("text")))).alias("entities"))
    if told.isEmpty():
        rows = rows.withColumn("terms", F.lit(None).cast("map<string,double>"))
    else:
        told = written(told.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms")), "disclosing")
        key = (F.xxhash64("text") == F.col("h1")) & (F.xxhash64(F.lit(1), "text") == F.col("h2"))
        rows = rows.join(F.broadcast(told) if told.count() <= SMALL // 10 else told, key, "left")
    hits = located(_blanked(F.col("text"), F.col("entities")), WORD, lambda v: F.map_contains_key("terms", F.lower(v)))
    clear = _as_kind(hits, "term")
    spans = F.when(F.col("terms").isNull(), F.col("entities")).otherwise(F.sort_array(F.concat("entities", clear)))
    rows = rows.withColumn("spans", F.explode(F.array(spans)))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    put = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when((s["kind"] == KINDS.index("term")) & (F.element_at("terms", F.lower(s["value"])) >= REMOVE), F.lit("")).otherwise(F.get(tags, s["kind"])).alias("put")))
    return rows.select("row", "entities", "spans", sanitised(F.col("text"), put).alias("clean"))
