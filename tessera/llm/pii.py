"""Information-theoretic sanitisation of personal data (operator 5), with DataFrame functions only.

Patterns find the protected entities (e-mail and IP addresses, card and phone numbers).  Then the
corpus tells which *terms* near an entity give it away: with document frequencies over all rows, the
pointwise mutual information of term t and entity e is compared with e's own information content,

    share(e, t) = log2(N n(e,t) / (n(e) n(t))) / log2(N / n(e)),

1 when t occurs only together with e; n(e,t) counts the rows that hold both, wherever.  A term that
stood in at least two different contexts of e and has a share of ``DISCLOSURE`` or more becomes a span
of kind ``term`` wherever it stands, in rows without e too.  ``sanitise`` names entities by their
kind, removes terms of a share of ``REMOVAL`` or more and generalises the others to what kind of word
they are.

A share cannot exceed what it would be if the rarer of the two always stood beside the other, and a
term stands in at least as many rows as it stands in near an entity.  So common words are ruled out,
exactly, before any text is searched for terms.

Matches are located by their lengths: a text is the gaps (``split``) and matches (``extract all``) of
a pattern in turn.  Every pattern starts only where a run of its first characters starts, so texts
without blanks take linear time.  Words are lower-cased one by one, after splitting, on all sides.

Edge cases: a null text counts as empty; empty texts have no spans; every row is a document of its
own, with or without a doc_id and however often its doc_id or text is repeated, in the answers and in
the frequencies; only two columns of the input are read, so others may have any name; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, salted_join, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written without needless backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][ -]?){16}", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{N}_]+"
#: Characters on each side of an entity that are its context; terms shorter than this tell nothing.
REACH, SHORTEST = 80, 3
SUPPORT = 2
DISCLOSURE, REMOVAL = 0.8, 0.95
#: Rows of terms or spans up to which a table of them is broadcast, once counted.
BROADCAST_ROWS = 200_000
BLOCK = 128


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.when(F.length(plain(p)) <= 3, plain(p)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def located(df: DataFrame, text: str, out: str, pattern: str, hint: str | None = None) -> DataFrame:
    """``df`` with ``out``: array of struct(start, end, match) in code points, end exclusive.

    Starts are prefix sums of gap and match lengths, taken block by block so that texts with very
    many matches stay affordable.  (Arrays made here are exploded with ``explode_outer``: for a plain
    ``explode`` the optimizer would repeat their whole computation in a filter below it.)"""
    wanted = F.lit(True) if hint is None else (F.contains(text, F.lit(hint)) if len(hint) == 1 else F.col(text).rlike(hint))
    step1 = df.withColumns({
        "__m": F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
    })
    step2 = step1.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)))
    n = F.size("__m")
    step3 = step2.withColumn("__l", F.when(n > 0, F.transform("__m", lambda m, i: F.length(F.get("__g", i)) + F.length(m))))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice("__l", b * BLOCK + 1, BLOCK), F.lit(0), lambda s, x: s + x),
    )
    step4 = step3.withColumn("__b", F.when(n > 0, F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))))

    def one(m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        before = F.get("__b", block) + F.aggregate(F.slice("__l", block * BLOCK + 1, i % BLOCK), F.lit(0), lambda s, x: s + x)
        start = before + F.length(F.get("__g", i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"))

    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return step4.withColumn(out, F.when(n > 0, F.transform("__m", one)).otherwise(empty)).drop("__m", "__g", "__l", "__b")


def entities(df: DataFrame, text: str = "__text") -> DataFrame:
    """``df`` with one array of struct(start, end, match) for each kind."""
    for kind in KINDS:
        df = located(df, text, kind, PATTERNS[kind], HINTS[kind])
    return df.withColumns({k: F.filter(k, (lambda kind: lambda s: _valid(kind, s["match"]))(k)) for k in KINDS if k != "email"})


def _named(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _share(n_rows: int, n_e: Column, n_t: Column, n_et: Column) -> Column:
    n = F.lit(float(max(1, n_rows)))
    return F.log2(n * n_et / (n_e * n_t)) / F.log2(n / n_e)


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _joined(left: DataFrame, right: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Inner join that leaves ``left`` where it is if ``right`` is small, and salts hot keys if not."""
    return left.join(F.broadcast(right), key) if _few(right) else salted_join(left, right, key, by)


def candidates(near: DataFrame, holders: DataFrame, n_rows: int) -> DataFrame:
    """Pairs (``e``, ``term``, ``n_e``) of SUPPORT contexts or more whose share may reach the threshold,
    as far as the rows in which the term stands near any entity tell."""
    n_e = holders.groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") < n_rows)
    pairs = near.select("e", "term", "context").distinct().groupBy("e", "term").agg(F.count(F.lit(1)).alias("contexts"))
    pairs = cut(pairs.where(F.col("contexts") >= SUPPORT).select("e", "term"), "pii-pairs")
    least = near.select("term", "row_no").distinct().join(pairs.select("term").distinct(), "term", "left_semi")
    least = least.groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    known = salted_join(cut(salted_join(pairs, n_e, ["e"], ["term"]), "pii-known"), least, ["term"], ["e"])
    return known.where(_share(n_rows, F.col("n_e"), F.col("least"), F.least("n_e", "least")) >= DISCLOSURE).select("e", "term", "n_e")


def holding(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``row_no``, ``term``: which of ``terms`` each row holds, each once."""
    listed = F.array_distinct(F.transform(F.split("__text", r"[^\p{L}\p{N}_]+", -1), F.lower))
    said = rows.select("row_no", F.explode_outer(listed).alias("term"))
    return said.join(F.broadcast(terms) if _few(terms) else terms, "term", "left_semi")


def disclosing(rows: DataFrame, near: DataFrame, holders: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Flagged terms (``term``, ``share``: the largest) and where they stand (``row_no``, ``term``)."""
    pairs = cut(candidates(near, holders, n_rows), "pii-candidates")
    held = cut(holding(rows, pairs.select("term").distinct()), "pii-held")
    n_t = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    likely = salted_join(pairs, n_t, ["term"], ["e"])
    likely = cut(likely.where(_share(n_rows, F.col("n_e"), F.col("n_t"), F.least("n_e", "n_t")) >= DISCLOSURE), "pii-likely")
    both = _joined(held, likely.select("term", "e"), ["term"], ["row_no"]).join(holders, ["row_no", "e"], "left_semi")
    n_et = both.groupBy("e", "term").agg(F.count(F.lit(1)).alias("n_et")).join(likely, ["e", "term"])
    share = n_et.select("term", _share(n_rows, F.col("n_e"), F.col("n_t"), F.col("n_et")).alias("share"))
    flagged = cut(share.where(F.col("share") >= DISCLOSURE).groupBy("term").agg(F.max("share").alias("share")), "pii-flagged")
    return flagged, held


def _contexts(kind: str) -> Column:
    """For each entity of a kind: its number ``e``, and its surroundings with where they start."""

    def of(s: Column) -> Column:
        start = F.greatest(s["start"] - REACH, F.lit(0))
        return F.struct(
            F.xxhash64(F.lit(kind), F.lower(s["match"])).alias("e"),
            start.alias("at"),
            F.col("__text").substr(start + 1, s["end"] + REACH - start).alias("snippet"),
            F.length("__text").alias("size"),
        )

    return F.transform(kind, of)


def neighbours(found: DataFrame) -> DataFrame:
    """``row_no``, ``e``, ``context``, ``term``: whole words near entities, outside of entities themselves."""
    c = found.where("size(contexts) > 0").select("row_no", "base", F.explode("contexts").alias("c"))
    c = located(c.select("row_no", "base", "c.e", "c.at", "c.snippet", "c.size"), "snippet", "__words", WORD)
    flat = c.select("row_no", "base", "e", "at", "size", F.xxhash64("snippet").alias("context"), F.length("snippet").alias("width"), F.explode_outer("__words").alias("w"))
    flat = flat.select(
        "row_no", "e", "context", "base", F.lower("w.match").alias("term"),
        (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"),
        ((F.col("w.start") > 0) | (F.col("at") == 0)).alias("left"),
        ((F.col("w.end") < F.col("width")) | (F.col("at") + F.col("width") == F.col("size"))).alias("right"),
    )
    inside = F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    return flat.where((F.length("term") >= SHORTEST) & F.col("left") & F.col("right") & ~inside).select("row_no", "e", "context", "term")


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row: ``row_no``, doc_id, ``__text``, base spans (``base``) and term spans (``terms``, with ``share``)."""
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("__text"))
    named = entities(rows).withColumn("base", F.concat(*[_named(k, k) for k in KINDS]))
    none = F.array().cast("array<struct<e:bigint,at:int,snippet:string,size:int>>")
    contexts = F.when(F.size("base") > 0, F.concat(*[_contexts(k) for k in KINDS])).otherwise(none)
    # written once with its texts: row numbers are given here and nowhere else
    found = cut(named.select("row_no", "doc_id", "__text", "base", contexts.alias("contexts")), "pii-rows", "zstd")
    near = cut(neighbours(found.select("row_no", "base", "contexts")), "pii-near")
    holders = found.select("row_no", F.explode(F.transform("contexts", lambda c: c["e"])).alias("e")).distinct()
    flagged, held = disclosing(found, near, cut(holders, "pii-holders"), found.count())
    # flagged terms are located in every row that holds one, near an entity or not
    wanted = cut(_joined(held, flagged, ["term"], ["row_no"]), "pii-wanted")
    some = wanted.select("row_no").distinct()
    texts = found.select("row_no", "__text").join(F.broadcast(some) if _few(some) else some, "row_no", "left_semi")
    words = located(texts, "__text", "__words", WORD).select("row_no", F.explode_outer("__words").alias("w"))
    words = words.select("row_no", F.lower("w.match").alias("term"), "w.start", "w.end")
    words = cut(words.join(F.broadcast(wanted) if _few(wanted) else wanted, ["row_no", "term"]), "pii-spans")
    spans = words.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("spans"))
    out = found.drop("contexts").join(F.broadcast(spans) if _few(words) else spans, "row_no", "left")
    outside = F.filter("spans", lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    empty = F.array().cast("array<struct<start:int,end:int,share:double>>")
    return out.select("row_no", "doc_id", "__text", "base", F.coalesce(outside, empty).alias("terms"))


def _clean(text: str = "__text") -> Column:
    """The text with its marks carried out: entities named by kind, terms removed or generalised."""
    word = lambda s: F.col(text).substr(s["start"] + 1, s["end"] - s["start"])
    kind = lambda s: F.when(s["share"] >= REMOVAL, "").when(word(s).rlike("[0-9]"), "[NUMBER]").when(word(s).rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    marks = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("put"))),
    ))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, m: Column) -> Column:  # a mark that starts inside the one before adds nothing but its rest
        gap = F.when(m["start"] > acc["at"], F.col(text).substr(acc["at"] + 1, m["start"] - acc["at"])).otherwise("")
        put = F.when(m["start"] >= acc["at"], m["put"]).otherwise("")
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.concat(acc["text"], gap, put).alias("text"))

    done = F.aggregate(marks, start, step, lambda acc: F.concat(acc["text"], F.col(text).substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size("base") + F.size("terms") > 0, done).otherwise(F.col(text))


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``clean_text``: entities named by kind, disclosing terms removed or generalised."""
    return find(df, doc_id, text).select("doc_id", _clean().alias("clean_text"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    out = find(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.concat("base", terms)
    return out.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"), F.sha2(_clean(), 256).alias("clean_sha256"),
    )
