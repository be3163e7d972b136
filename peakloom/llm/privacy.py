"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Patterns find the protected entities themselves (addresses, numbers). Terms next to an entity may
give it away as well. How much term t tells about entity c is their pointwise mutual information in
the corpus; c is disclosed when it reaches ``alpha`` times the information content of c:

    log2( n(c,t) N / (n(c) n(t)) ) >= alpha log2( N / n(c) )

All four count distinct texts, so that copies of a page count once on either side. Only entities and
pairs seen in ``support`` distinct surroundings are judged. Disclosing
terms are generalised to a class or, when they tell everything (alpha 1), removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import join_on_key, row_key, table
from peakloom.plans.durable import stored

# Possessive loops and the look-behinds give the same leftmost matches as the plain patterns, in
# linear time and without recursion on very long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}{3,}+"
#: Characters on either side of an entity whose words are looked at.
REACH = 96
ALPHA = 0.9
SUPPORT = 2


#: Items that one step of a running total goes through; totals of these blocks are added up first.
BLOCK = 256
#: Code points of the chunks that a text is cut into, and of the larger ones that hold those.
CHUNK, WIDE = 1024, 65_536


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: Column, start: Column, add) -> Column:
    step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def running(values: Column, add) -> Column:
    """array<int>: for every item of array<int> what the associative ``add`` makes of 0 and the items
    before it. Each step copies what it has, so items go in blocks, and the totals of these first."""

    def whole(v):
        firsts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda i: F.slice(v, i, BLOCK))

        def joined(b):
            totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0), add))
            return F.flatten(F.zip_with(b, _scan(totals, F.lit(0), add), lambda x, at: _scan(x, at, add)))

        return F.when(F.size(v) > 0, _once(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return _once(values, whole)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches in order, in code points, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    gap = lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value"))
    steps = _once(values, lambda v: F.zip_with(F.slice(gaps, 1, F.size(v)), v, gap))

    def placed(steps):
        before = running(F.transform(steps, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        place = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))
        return F.zip_with(steps, before, place)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, _once(steps, placed)).otherwise(none)


def chunks(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))


def _part(cut: Column, start: Column, size: Column) -> Column:
    """``size`` code points, CHUNK at most, of a text in chunks."""
    at = F.floor(start / CHUNK).cast("int")
    near = F.concat(F.coalesce(F.get(cut, at), F.lit("")), F.coalesce(F.get(cut, at + 1), F.lit("")))
    return F.substring(near, start - at * CHUNK + 1, size)


def _luhn(digits: Column) -> Column:
    """Whether the digits, doubled at every second place from the right, add up to a multiple of 10."""
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, by start and then kind; array<struct<start, rank, end, kind, value>>."""
    text = F.coalesce(text, F.lit(""))
    # a character without which there is no match
    possible = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.contains(text, F.lit(".")), "card": F.lit(True)}
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for i, kind in enumerate(KINDS):
        good = F.filter(matches(text, PATTERNS[kind]), _check(kind))
        parts.append(F.when(possible[kind], F.transform(good, _shape(i, kind))).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _check(kind):
    return lambda m: _valid(kind, m["value"])


def _shape(rank, kind):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosing_terms(docs: DataFrame, reach: int = REACH, alpha: float = ALPHA, support: int = SUPPORT, term: str = TERM) -> DataFrame:
    """(doc_id, __h, added): the spans of disclosing terms in each document that has some."""
    source = docs.select(*row_key(), "text")
    # the entity itself is blanked, and words cut by the edge of the surroundings are left out; of the
    # text only these few characters go on
    def placed(t):
        def one(s):
            low, high = F.greatest(s["start"] - reach, F.lit(0)), F.least(s["end"] + reach, t["size"])
            parts = F.concat(_part(t["cut"], low, s["start"] - low), F.repeat(F.lit(" "), s["end"] - s["start"]), _part(t["cut"], s["end"], high - s["end"]))
            return F.struct(F.xxhash64(s["kind"], F.lower(s["value"])).alias("entity"), low.alias("low"), (high == t["size"]).alias("whole"), parts.alias("around"))

        return F.transform(t["spans"], one)

    prepared = F.struct(base_spans(F.col("text")).alias("spans"), chunks(F.col("text"), CHUNK).alias("cut"), F.length("text").alias("size"))
    seen = source.select("doc_id", "__h", F.explode(_once(prepared, placed)).alias("s")).select("doc_id", "__h", "s.*")
    words = F.filter(
        matches(F.col("around"), term),
        lambda m: ((m["start"] > 0) | (F.col("low") == 0)) & ((m["end"] < F.length("around")) | F.col("whole")),
    )
    seen = stored(seen.select("doc_id", "__h", "entity", "low", F.xxhash64("around").alias("place"), F.transform(words, lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"].alias("start"), m["end"].alias("end"))).alias("words")))
    places = seen.groupBy("entity", "place").agg(F.first("words").alias("words"))
    judged_entities = places.groupBy("entity").agg(F.count(F.lit(1)).alias("n_places")).where(F.col("n_places") >= support).select("entity")
    terms_of = F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term")
    shared = places.select("entity", terms_of).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_places")).where(F.col("n_places") >= support)
    # in distinct texts: __h is the hash of the text
    entities = seen.select("entity", "__h").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).join(judged_entities, "entity")
    joint = seen.select("entity", "__h", terms_of).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_joint"))
    joint = joint.join(shared.select("entity", "term"), ["entity", "term"])
    copies = source.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(copies.agg(F.count(F.lit(1)).alias("n_docs")))  # one row
    repeated = stored(copies.where("n > 1").select(F.col("__h").alias("__again")))
    again = F.col("__h") == F.col("__again")
    worded = lambda rows: rows.select("__h", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(term), F.lit(0))).alias("terms"))
    once = worded(source).join(repeated, again, "left_anti")
    # copies have the same terms, and are merged before rows are dealt
    merged = worded(source.join(repeated, again, "left_semi")).dropDuplicates(["__h"])
    terms = once.unionAll(merged).select(F.explode("terms").alias("term"))
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    judged = joint.join(entities, "entity").join(frequency, "term").join(total)
    told = F.log2(F.col("n_joint") * F.col("n_docs") / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(F.col("n_docs") / F.col("n_entity"))
    guilty = stored(judged.where(told >= alpha * content).select("entity", "term", (told >= content).alias("all")))
    single = seen.select("doc_id", "__h", "entity", "low", F.explode("words").alias("w")).select("doc_id", "__h", "entity", F.col("w.term").alias("term"), (F.col("low") + F.col("w.start")).alias("start"), (F.col("low") + F.col("w.end")).alias("end"))
    hit = single.join(guilty, ["entity", "term"]).groupBy("doc_id", "__h", "start", "end").agg(F.max("all").alias("all"))
    shape = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.when(F.col("all"), F.lit("removed")).otherwise(F.lit("term")).alias("kind"), F.lit("").alias("value"))
    # at most the words around the entities of one document
    return hit.groupBy("doc_id", "__h").agg(F.array_sort(F.collect_list(shape.cast(SPAN))).alias("added"))


def find_private(docs: DataFrame, **settings) -> DataFrame:
    """All columns of ``docs`` plus ``base`` and ``added``: pattern spans, and disclosing terms.

    Null and empty texts have no spans. Rows that repeat get the same spans. Columns of these names
    are replaced. ``settings`` are those of :func:`disclosing_terms`.
    """
    docs = docs.drop("base", "added", "__h")
    added = stored(disclosing_terms(docs, **settings))
    keyed = docs.withColumn("__h", row_key()[1]).withColumn("base", base_spans(F.col("text")))
    out = join_on_key(keyed, added.withColumnRenamed("added", "__added"), "left").drop("__h")
    return out.withColumn("added", F.coalesce("__added", F.array().cast(f"array<{SPAN}>"))).drop("__added")


def replacement(kind: Column) -> Column:
    """Entities and telling terms become their class; a term that tells everything is removed."""
    return F.when(kind == "removed", F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(kind), F.lit(">")))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced; of spans that overlap the first one names the whole.

    Each span cuts what no earlier one has cut. Cuts are dealt to chunks of the text, so that no
    step goes through more than a chunk.
    """

    def cuts(s):
        reached = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        word = lambda x, at: F.when(x["start"] >= at, replacement(x["kind"])).otherwise(F.lit(""))
        cut = lambda x, at: F.struct(at.alias("before"), F.greatest(x["start"], at).alias("start"), x["end"].alias("end"), word(x, at).alias("word"))
        return F.filter(F.zip_with(s, reached, cut), lambda x: x["end"] > x["before"])

    def within(cuts, low, size):
        return F.filter(cuts, lambda x: (x["start"] < low + size) & (x["end"] > low))

    def rest(chunk, low, cuts):
        """A chunk that starts at ``low`` without the cuts that touch it."""

        def piece(x):
            at = F.greatest(x["before"], low)
            return F.concat(F.substring(chunk, at - low + 1, F.greatest(x["start"] - at, F.lit(0))), F.when(x["start"] >= low, x["word"]).otherwise(F.lit("")))

        last = F.greatest(F.element_at(cuts, -1)["end"] - low, F.lit(0))
        return F.when(F.size(cuts) > 0, F.concat(F.array_join(F.transform(cuts, piece), ""), F.substring(chunk, last + 1, F.lit(CHUNK)))).otherwise(chunk)

    def wide(cuts):
        def small(part, low):
            inner = lambda own: F.array_join(F.transform(chunks(part, CHUNK), lambda c, j: _once(within(own, low + j * CHUNK, CHUNK), lambda near: rest(c, low + j * CHUNK, near))), "")
            return _once(within(cuts, low, WIDE), inner)

        return F.array_join(F.transform(chunks(text, WIDE), lambda part, i: small(part, i * WIDE)), "")

    return F.when(F.size(spans) > 0, _once(_once(F.array_sort(spans), cuts), wide)).otherwise(text)


def op6(spark, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced; n_chars follows the text."""
    names = {c: f"__in_{c}" for c in ("base", "added", "__h") if c in docs.columns}
    found = find_private(docs.withColumnsRenamed(names)).withColumn("__all", F.concat("base", "added"))
    found = found.withColumn("__new", sanitised(F.col("text"), F.col("__all")))
    values = {"text": F.col("__new"), "n_chars": F.when(F.size("__all") > 0, F.length("__new").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[values[c].alias(c) if c in values else F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
