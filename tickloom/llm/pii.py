"""Personal data by patterns, and terms that reveal it by information-theoretic sanitisation.

Everything here is DataFrame functions.

Base spans are found per kind (email, ip, card, phone) over the whole text, with
code-point positions.  The protected entities are their values.  The corpus then
says how strongly other terms give an entity away: over lines, the pointwise
mutual information of term t and entity e is compared with the information of e
itself,

    share(t, e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)),

which is 1 when seeing t leaves nothing of e to be told.  Most entities are met
once or twice, so e is also looked at through what it belongs to: its parts
(domain and local part, number or network prefix) over lines, and the documents
that hold it over their lines, for terms that stand in a line with an entity;
there n(t, part) and n(part) take the place of n(t, e) and n(e) above the line.  A
term counts if it meets e in at least ``least`` different lines, or e, a part or
a document in more than chance brings about (a line that is copied many times is
one line, so copies of one line tell nothing): the chance of as many lines
(Chernoff's bound of the Poisson tail) must be under ``CHANCE`` over N terms.  One
line is never enough for that, as any line has words that stand nowhere else.  A
word of e itself needs no count: n(t, e) is n(e).  From ``blur`` on a
term is generalised (``[NAME]`` for a capitalised word, ``[NUMBER]``, ``[TERM]``),
from ``remove`` on it is removed; both become spans of kind ``term``.

Counts take partial sums before every shuffle, so an entity or term that a third
of all lines holds arrives as one row per task.  Texts with spans are rebuilt
from the pieces between them.

Positions are running sums over the lengths of matches and of what lies between
them, taken in blocks of the square root of their number, and lookups inside a
text go by sorting, so a text with very many matches takes hardly more than
linear time.

Defined cases: null texts count as empty; patterns that fail their check (an
octet over 255, Luhn, number of digits) give no span and no other start is tried
inside them; spans of several kinds may overlap, and all that any of them covers
goes from the sanitised text; a share equal to a limit counts as reaching it;
repeated rows and rows without an id each come back; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the patterns: the same leftmost matches without a second look at a run that cannot match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for any of them, each a cheap look.
HINT = r"@[A-Za-z0-9-]++\.|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?[0-9]){15}|\+[0-9][\x20().0-9-]"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


SPAN = "array<struct<kind:int,start:int,end:int,at:int,to:int,value:string>>"


def _running(rows: DataFrame, columns: dict[str, str], first: Column, step) -> DataFrame:
    """Array columns (new name: old name) of what ``step`` makes of all elements up to each one.

    ``step`` is associative and leaves an element alone after ``first``.  Blocks as
    wide as the square root of the size are summed first, so the arrays that grow by
    an element at a time stay short.  Every stage is a projection of its own, as
    lambdas would evaluate anything but a column again for each element (and what is
    used once goes in as an argument, as Spark merges such projections).
    """
    part = lambda name, c: f"_{name}_{c}"
    rows = rows.withColumns({part("wide", c): F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(c)))).cast("int") for c in columns.values()})
    none = F.array().cast("array<int>")
    rows = rows.withColumns({part("begin", c): F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1, F.col(part("wide", c)))).otherwise(none) for c in columns.values()})
    block = lambda c, b: F.slice(F.col(c), b + 1, F.col(part("wide", c)))
    sums = lambda c: F.transform(part("begin", c), lambda b: F.aggregate(block(c, b), first, step))
    rows = rows.withColumns({part("sum", c): sums(c) for c in columns.values()})
    more = lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x)))
    rows = rows.withColumns({part("base", c): F.aggregate(part("sum", c), F.array(first), more) for c in columns.values()})
    within = lambda c: lambda b, base: F.slice(F.aggregate(block(c, b), F.array(base), more), F.lit(2), F.col(part("wide", c)))
    before = lambda c: F.slice(part("base", c), F.lit(1), F.size(part("begin", c)))
    inside = lambda c: F.zip_with(part("begin", c), before(c), within(c))
    rows = rows.withColumns({new: F.flatten(inside(c)) for new, c in columns.items()})
    return rows.drop(*(part(n, c) for c in columns.values() for n in ("wide", "begin", "sum", "base")))


def _matches(rows: DataFrame, patterns: dict[str, str], when: Column | None = None) -> DataFrame:
    """Array columns (name: pattern) of all matches in ``text`` as start, end (code points), at, to (bytes) and value."""
    found = {f"_found_{n}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for n, p in patterns.items()}
    gaps = {f"_gaps_{n}": F.split("text", p, -1) for n, p in patterns.items()}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({k: c if when is None else F.when(when, c).otherwise(none) for k, c in (found | gaps).items()})
    size = lambda g, v: F.struct((F.length(g) + F.length(v)).alias("chars"), (F.octet_length(g) + F.octet_length(v)).alias("bytes"))
    rows = rows.withColumns({f"_sizes_{n}": F.zip_with(F.slice(f"_gaps_{n}", F.lit(1), F.size(f"_found_{n}")), f"_found_{n}", size) for n in patterns})
    rows = _running(rows, {f"_ends_{n}": f"_sizes_{n}" for n in patterns}, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes")),
                    lambda a, x: F.struct((a["chars"] + x["chars"]).alias("chars"), (a["bytes"] + x["bytes"]).alias("bytes")))
    match = lambda e, v: F.struct((e["chars"] - F.length(v)).alias("start"), e["chars"].alias("end"), (e["bytes"] - F.octet_length(v)).alias("at"), e["bytes"].alias("to"), v.alias("value"))
    rows = rows.withColumns({n: F.zip_with(f"_ends_{n}", f"_found_{n}", match) for n in patterns})
    return rows.drop(*(f"_{x}_{n}" for x in ("found", "gaps", "sizes", "ends") for n in patterns))


def _of_kind(kind: Column, m: Column) -> Column:
    return F.struct(kind.cast("int").alias("kind"), *(m[f].alias(f) for f in ("start", "end", "at", "to", "value")))


def with_base(rows: DataFrame) -> DataFrame:
    """``rows`` with ``base``: all base spans of ``text``, by kind as listed, then start."""
    rows = _matches(rows, {f"_{k}": p for k, p in PATTERNS.items()})
    each = lambda k: F.transform(F.filter(f"_{k}", lambda m: _valid(k, m["value"])), lambda m: _of_kind(F.lit(KINDS.index(k)), m))
    return rows.withColumn("base", F.concat(*map(each, KINDS))).drop(*(f"_{k}" for k in KINDS))


def _replaced(rows: DataFrame, spans: str, label, out: str) -> DataFrame:
    """``out``: ``text`` with all that ``spans`` cover gone, and the label of each span that begins outside those before it."""
    order = ("at", "to", "kind", "value")
    rows = rows.withColumn("_sorted", F.sort_array(F.transform(spans, lambda s: F.struct(*(s[f].alias(f) for f in order)))))
    rows = rows.withColumns({"_to": F.transform("_sorted", lambda s: s["to"]), "_raw": F.col("text").cast("binary")})
    rows = _running(rows, {"_covered": "_to"}, F.lit(0), lambda a, x: F.greatest(a, x))
    between = lambda begin, size: F.substring(F.col("_raw"), begin + 1, size).cast("string")

    def piece(s: Column, covered: Column) -> Column:
        return F.concat(F.when(s["at"] > covered, between(covered, s["at"] - covered)).otherwise(""), F.when(s["at"] >= covered, label(s)).otherwise(""))

    before = F.concat(F.array(F.lit(0)), F.slice("_covered", F.lit(1), F.greatest(F.size("_covered") - 1, F.lit(0))))
    rows = rows.withColumns({"_before": F.when(F.size("_covered") > 0, before).otherwise(F.array().cast("array<int>")), "_last": F.coalesce(F.try_element_at("_covered", F.lit(-1)), F.lit(0))})
    tail = between(F.col("_last"), F.octet_length("_raw"))
    return rows.withColumn(out, F.concat(F.array_join(F.zip_with("_sorted", "_before", piece), ""), tail)).drop("_sorted", "_to", "_raw", "_covered", "_before", "_last")


WORD = r"[\p{L}\p{N}]{2,}"
NAMES = (*KINDS, "generalised", "removed")
CHANCE = 0.05  # that any of N terms meets an entity or a part as often by chance
LEAST_OWN = 3  # letters or digits of an entity's own word
MOST_BROADCAST = 100_000  # candidate terms, counted before they are broadcast


def _values(base: Column) -> Column:
    return F.array_distinct(F.transform(base, lambda s: F.lower(s["value"])))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _parts(span: Column) -> Column:
    """What an entity is looked at through over lines: its value, and by kind its domain and local part, network or leading digits."""
    value, digits = F.lower(span["value"]), F.regexp_replace(span["value"], "[^0-9]", "")
    more = (
        F.when(span["kind"] == 0, F.array(F.concat(F.lit("domain "), F.substring_index(value, "@", -1)), F.concat(F.lit("local "), F.substring_index(value, "@", 1))))
        .when(span["kind"] == 1, F.array(F.concat(F.lit("net "), F.substring_index(value, ".", 3))))
        .when(span["kind"] == 2, F.array(F.concat(F.lit("card "), F.substring(digits, 1, 6))))
        .otherwise(F.array(F.concat(F.lit("phone "), F.substring(digits, F.lit(1), F.length(digits) - 7))))
    )
    return F.concat(F.array(F.concat(F.lit("value "), value)), more)


def revealing_terms(docs: DataFrame, marked: DataFrame, least: int, blur: float) -> DataFrame:
    """``mark, term, share``: the terms of each text whose share is ``blur`` or more, with the largest share of each.

    ``docs`` has every text; ``marked`` the texts with base spans, and these; ``mark``
    is the 64-bit hash of the text.  A part's terms reach a text through the text's
    own parts and words, so a part that very many entities share (a mail domain)
    gives rows for the words that its texts hold, never entities by terms.
    """
    total = docs.select(F.sum(F.size(F.split("text", "\n", -1)).cast("long"))).first()[0] or 0
    once = staged(marked.groupBy(F.xxhash64("text").alias("doc"), "text").agg(F.count("*").alias("copies")), "once")
    lines = once.select("doc", "copies", F.explode(F.split("text", "\n", -1)).alias("line"))
    held = with_base(lines.where(F.col("line").rlike(HINT)).select("doc", "copies", F.col("line").alias("text")))
    held = staged(held, "held").where(F.size("base") > 0)  # a filter on a plan would be evaluated inside its lambdas
    held = _replaced(held, "base", lambda s: F.lit(" "), "bare")
    entity = lambda e: F.struct(F.lower(e["value"]).alias("entity"), _parts(e).alias("parts"))
    pairs = held.select("doc", "copies", F.xxhash64("text").alias("mark"), F.transform("base", entity).alias("entities"), _words(F.col("bare")).alias("terms"))
    pairs = staged(pairs, "pairs")
    entities = pairs.select("copies", F.explode(F.array_distinct("entities.entity")).alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_e"))
    entities = staged(entities.where(F.col("n_e") < total), "entities")

    # lines by part, and the lines of whole documents with the terms that stand in a line with an entity
    document = F.concat(F.lit("doc "), F.col("doc"))
    near = pairs.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("near"))
    context = lines.join(near, "doc").select(document.alias("part"), F.xxhash64("line").alias("mark"), "copies", F.array_intersect(_words(F.col("line")), "near").alias("terms"))
    # parts without their terms first: those of one line, within chance, never meet a term
    named = pairs.select("doc", "mark", "copies", F.explode(F.array_distinct(F.flatten("entities.parts"))).alias("part"))
    parts = named.select("part", "mark", "copies").union(context.select("part", "mark", "copies"))
    parts = parts.groupBy("part", "mark").agg(F.sum("copies").alias("n")).groupBy("part").agg(F.sum("n").alias("n_p"), F.count("*").alias("of"))
    several = staged(parts.where(F.least(F.lit(2), F.lit(least)) <= F.col("of")), "parts")
    met = named.join(several.select("part"), "part", "left_semi").join(pairs.select("doc", "mark", "copies", "terms"), ["doc", "mark", "copies"])
    # joined on the part last, so that the sums by part below find their rows together
    met = met.select("part", "mark", "copies", "terms").union(context).join(several, "part")
    joint = met.select("part", "n_p", "of", "mark", "copies", F.explode("terms").alias("term"))
    joint = joint.groupBy("part", "n_p", "of", "term", "mark").agg(F.sum("copies").alias("n")).groupBy("part", "n_p", "of", "term").agg(F.sum("n").alias("n_tp"), F.count("*").alias("lines"))
    joint = staged(joint.where(F.least(F.lit(2), F.lit(least)) <= F.col("lines")), "joint")
    own = entities.select("entity", "n_e", F.explode(_words(F.col("entity"))).alias("term")).where(F.length("term") >= LEAST_OWN)

    wanted = staged(joint.select("term").union(own.select("term")).distinct(), "terms")
    small = wanted.count() <= MOST_BROADCAST
    each = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.explode(_words(F.col("line"))).alias("term"))
    each = staged(each.join(F.broadcast(wanted) if small else wanted, "term").groupBy("term").agg(F.count("*").alias("n_t")), "each")
    n = F.lit(float(max(total, 1)))
    expected = F.col("n_t") * F.col("of") / n
    rare = (F.col("lines") > expected) & (F.col("lines") * F.log(F.col("lines") / expected) - F.col("lines") + expected >= F.log(n / CHANCE))
    whole = F.col("part").startswith("value ") & (F.col("lines") >= least)
    told = joint.join(each, "term").where(whole | rare).select("part", "term", F.log(n * F.col("n_tp") / (F.col("n_t") * F.col("n_p"))).alias("told"))
    told = staged(told.where("told > 0"), "told")
    # of each text: its parts that tell anything, with the least information of an entity behind them, and its words among the telling ones
    information = F.log(n / F.col("n_e")).alias("information")
    behind = pairs.select("doc", F.explode("entities").alias("e")).select("doc", F.col("e.entity").alias("entity"), F.concat("e.parts", F.array(document)).alias("parts")).distinct()
    behind = behind.join(entities.select("entity", information), "entity")
    parts_of = behind.select("doc", F.explode("parts").alias("part"), "information").groupBy("doc", "part").agg(F.min("information").alias("information"))
    parts_of = parts_of.join(told.select("part").distinct(), "part", "left_semi")
    words_of = once.select("doc", F.explode(_words(F.col("text"))).alias("term")).join(told.select("term").distinct(), "term", "left_semi")
    shares = parts_of.join(words_of, "doc").join(told, ["part", "term"]).select("doc", "term", (F.col("told") / F.col("information")).alias("share"))
    # an entity's own words
    itself = own.join(each, "term").select("entity", "term", F.log(n / F.greatest("n_t", "n_e")).alias("told"))
    shares = shares.union(behind.select("doc", "entity", "information").join(itself, "entity").select("doc", "term", (F.col("told") / F.col("information")).alias("share")))
    return shares.where(F.col("share") >= blur).groupBy(F.col("doc").alias("mark"), "term").agg(F.max("share").alias("share"))


def _with_terms(rows: DataFrame, remove: float) -> DataFrame:
    """``added``: spans of the words of ``text`` that are among ``terms`` (array of term and share, or null), outside ``base``."""
    rows = _matches(rows, {"_words": WORD}, F.col("terms").isNotNull())
    # terms and words in one sorted array: a word belongs to a term that comes before it under the same letters
    entry = lambda word, share, m: F.struct(word.alias("word"), share.isNull().alias("later"), share.alias("share"), m.alias("m"))
    nothing = F.lit(None).cast("struct<start:int,end:int,at:int,to:int,value:string>")
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<term:string,share:double>>")), lambda t: entry(t["term"], t["share"], nothing))
    words = F.transform("_words", lambda m: entry(F.lower(m["value"]), F.lit(None).cast("double"), m))
    rows = rows.withColumn("_all", F.sort_array(F.concat(terms, words)))
    rows = rows.withColumn("_told", F.transform("_all", lambda e: F.struct(e["word"].alias("word"), e["share"].alias("share"))))
    first = F.struct(F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("share"))
    rows = _running(rows, {"_last": "_told"}, first, lambda a, x: F.when(x["share"].isNotNull(), x).otherwise(a))
    kind = lambda share: F.when(share >= remove, F.lit(len(KINDS) + 1)).otherwise(F.lit(len(KINDS)))
    mine = F.zip_with("_all", "_last", lambda e, t: F.when(e["later"] & (e["word"] == t["word"]), _of_kind(kind(t["share"]), e["m"])))
    rows = rows.withColumn("_mine", F.filter(mine, lambda s: s.isNotNull()))
    # with base spans, by start: how far those before reach, and where the next one begins
    event = lambda s, own: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("s"))
    events = F.concat(F.transform(F.when(F.size("_mine") > 0, F.col("base")).otherwise(F.array().cast(SPAN)), lambda s: event(s, False)), F.transform("_mine", lambda s: event(s, True)))
    rows = rows.withColumn("_events", F.sort_array(events))
    far = F.lit((1 << 31) - 1)
    reach = F.transform("_events", lambda e: F.when(e["own"], F.lit(0)).otherwise(e["end"]))
    ahead = F.transform(F.reverse("_events"), lambda e: F.when(e["own"], far).otherwise(e["start"]))
    rows = rows.withColumns({"_reach": reach, "_ahead": ahead})
    rows = _running(rows, {"_covered": "_reach"}, F.lit(0), lambda a, x: F.greatest(a, x))
    rows = _running(rows, {"_next": "_ahead"}, far, lambda a, x: F.least(a, x))
    rows = rows.withColumn("_both", F.arrays_zip("_events", "_covered", F.reverse("_next").alias("_next")))
    free = F.filter("_both", lambda x: x["_events"]["own"] & (x["_covered"] <= x["_events"]["start"]) & (x["_next"] >= x["_events"]["end"]))
    rows = rows.withColumn("added", F.sort_array(F.transform(free, lambda x: x["_events"]["s"])))
    return rows.drop("_words", "_all", "_told", "_last", "_mine", "_events", "_reach", "_ahead", "_covered", "_next", "_both")


def _label(s: Column) -> Column:
    """What stands for a span: a label for patterns and generalised terms, nothing for removed ones."""
    general = F.when(s["value"].rlike(r"^\p{N}+$"), "[NUMBER]").when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    return F.when(s["kind"] < len(KINDS), F.element_at(labels, F.least(s["kind"], F.lit(len(KINDS) - 1)) + 1)).when(s["kind"] == len(KINDS), general).otherwise("")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, blur: float = 0.5, remove: float = 0.8) -> DataFrame:
    """``doc_id, text, spans, sanitised`` of every row.

    ``spans`` is an array of (kind, start, end, at, to, value), base spans first, by
    kind and start; kinds number ``NAMES``, start and end are code points, at and to
    bytes.  ``text`` is the original, null as empty.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = staged(docs.where(F.col("text").rlike(HINT)).select("doc_id", "text").transform(with_base), "marked")
    marked = marked.withColumn("mark", F.xxhash64("text"))
    terms = revealing_terms(docs, marked.where(F.size("base") > 0), least, blur)
    told = terms.groupBy(F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    marked = marked.join(told, F.col("mark") == F.col("_mark"), "left")
    marked = _with_terms(marked, remove).select("doc_id", "text", F.concat("base", "added").alias("spans"))
    # staged, as a filter on what the caller gets would be evaluated inside the lambdas of all these stages
    marked = staged(_replaced(marked, "spans", _label, "sanitised"), "sanitised")
    plain = docs.where(~F.col("text").rlike(HINT)).select("doc_id", "text", F.array().cast(SPAN).alias("spans"), F.col("text").alias("sanitised"))
    return plain.union(marked)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(n) for n in NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(sanitised: DataFrame) -> DataFrame:
    """``doc_id``, counts by kind, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return sanitised.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
