"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Patterns with checks give the protected entities: e-mail and IP addresses, card and phone
numbers.  An entity is protected at three levels: its value, what it belongs to (mail host, network,
number without its last four digits, issuer of a card), and its kind.  A term discloses such a group
as far as the corpus says that documents with the term hold the group, in information:

    log(P(group | term) / P(group)) / log(1 / P(group)),

all counts being of documents, P(group | term) drawn towards P(group) by ``prior`` documents;
near 1 means that the term occurs with the group only.  Every occurrence of a disclosing term in a
document of the group is generalised if that is ``generalise`` at least, removed from ``remove`` on.
Counts cover the whole corpus and whole texts, but for words inside entities, which go with them.

Everything is DataFrame functions; words and groups are counted by their 64-bit hashes,
summed before each shuffle.  A group and a term that fewer than ``support`` documents hold
together say nothing of each other: an entity of fewer documents is protected at its
upper levels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, stored

KINDS = ("email", "ip", "card", "phone", "term")
BASE_KINDS = KINDS[:4]
#: Possessive forms keep the leftmost matches of the plain patterns and can't run out of stack;
#: an address begins where a run of its characters begins or the match before has ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{4,}+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    backwards = F.reverse(_digits(x))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(backwards)),
        lambda i: F.when(i % 2 == 1, F.substr(backwards, i, F.lit(1)).cast("int")).otherwise((F.substr(backwards, i, F.lit(1)).cast("int") * 2) - F.when(F.substr(backwards, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(14, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _placed(text: Column, matches: Column, pattern: str | Column) -> Column:
    """``start, end, value`` of all matches, in code points: what lies between them is what the pattern splits."""
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("gap"), matches.alias("value"))
    none = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string>>))")

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, none, step, lambda s: s["out"])


def _base(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with a column of spans ``start, rank, end, value``, by start, then kind as listed."""
    names = {k: free_name(df, f"{out}_{k}") for k in BASE_KINDS}
    t = F.col(text)
    hint = {"email": t.contains("@"), "ip": t.contains("."), "card": F.lit(True), "phone": t.contains("+")}
    found = df.withColumns({names[k]: F.when(hint[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))) for k, p in PATTERNS.items()})
    placed = found.withColumns({names[k]: F.when(F.size(names[k]) > 0, _placed(t, F.col(names[k]), PATTERNS[k])) for k in BASE_KINDS})
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def spans(i: int, k: str) -> Column:
        right = F.filter(F.coalesce(F.col(names[k]), none), lambda x: _valid(k, x["value"]))
        return F.transform(right, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))

    kinds = [spans(i, k) for i, k in enumerate(BASE_KINDS)]
    some = F.greatest(*(F.size(F.coalesce(F.col(names[k]), none)) for k in BASE_KINDS)) > 0
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)")
    return placed.withColumn(out, F.when(some, F.array_sort(F.concat(*kinds))).otherwise(empty)).drop(*names.values())


def _groups(span: Column) -> Column:
    """Hashes of the groups of an entity: value, what it belongs to, kind."""
    value, kind = F.lower(span["value"]), span["rank"]
    digits = _digits(value)
    upper = (
        F.when(kind == 0, F.substring_index(value, "@", -1))
        .when(kind == 1, F.substring_index(value, ".", 3))
        .when(kind == 2, F.substr(digits, F.lit(1), F.lit(6)))
        .otherwise(F.substr(digits, F.lit(1), F.length(digits) - 4))
    )
    return F.array(F.xxhash64(F.lit("value"), kind, value), F.xxhash64(F.lit("upper"), kind, upper), F.xxhash64(F.lit("kind"), kind))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _disclosing(held: DataFrame, texts: DataFrame, support: int, prior: float, least: float) -> DataFrame:
    """``grp, term, share``: hashes of groups and of the terms whose disclosure of them is at least ``least``.

    ``held`` has ``row, groups, words``, ``texts`` the ``text`` of all documents.
    """
    total = float(max(texts.filter(F.length("text") > 0).count(), 1))
    groups = stored(held.select(F.explode("groups").alias("grp")).groupBy("grp").agg(F.count("*").alias("with_group")).filter(F.col("with_group") >= support), "groups")
    # Groups of too few documents go before a document's groups meet its words.
    live = stored(held.select("row", F.explode("groups").alias("grp")).join(groups.select("grp"), "grp"), "live")
    both = live.join(held.select("row", "words"), "row").select("grp", F.explode("words").alias("w")).select("grp", F.xxhash64("w").alias("term"))
    pairs = stored(both.groupBy("grp", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= support), "pairs")
    terms = stored(pairs.select("term").distinct(), "terms")
    words = texts.select(F.explode(_words(F.col("text"))).alias("w")).select(F.xxhash64("w").alias("term")).join(terms, "term", "left_semi")
    counted = pairs.join(groups, "grp").join(words.groupBy("term").agg(F.count("*").alias("with_term")), "term")
    rate = F.col("with_group") / total
    share = F.log((F.col("together") + prior * rate) / (F.col("with_term") + prior) / rate) / F.nullif(-F.log(rate), F.lit(0.0))
    out = stored(counted.select("grp", "term", share.alias("share")).filter(F.col("share") >= least), "disclosing")
    for x in (groups, live, pairs, terms):
        discard(x)
    return out


def personal_data(
    df: DataFrame,
    support: int = 3,
    prior: float = 0.5,
    generalise: float = 0.8,
    remove: float = 0.95,
    id_col: str = "doc_id",
    text_col: str = "text",
    sanitised: bool = False,
) -> DataFrame:
    """``id, n_<kind> for each kind, n_generalised, n_removed, base_sha256, spans, outcomes`` of every
    row, and the sanitised text as ``sanitised`` if that is asked for.

    A term is a word of four letters or more outside entities.  ``outcomes`` lists the terms' spans
    as ``start:end:generalised`` or ``start:end:removed``.  In sanitised texts entities and terms to
    generalise are put as ``<KIND>``, terms to remove are left out; overlapping spans are one,
    of the kind that begins it.  Null and empty texts have no spans (and stay as they are).
    Ids are passed on, null or repeated; other columns are left out.
    """
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _base(chosen, "text", "base").withColumn("row", F.monotonically_increasing_id())
    # Texts are kept where they are needed again: beside entities, or to be sanitised.
    rows = stored(rows if sanitised else rows.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "spans")
    outside = _put(F.col("text"), F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("rank"), x["end"].alias("end"), F.lit(0).alias("removed"))))
    held = rows.filter(F.size("base") > 0).select("row", F.array_distinct(F.flatten(F.transform("base", _groups))).alias("groups"), _words(outside).alias("words"))
    held = stored(held, "held")
    pairs = _disclosing(held, chosen, support, prior, generalise)
    found = held.select("row", "groups", F.explode("words").alias("word")).withColumn("term", F.xxhash64("word")).join(pairs, "term").filter(F.array_contains("groups", F.col("grp")))
    found = found.groupBy("row", "word").agg(F.max("share").alias("share")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "share"))).alias("found"))
    both = rows.join(stored(found, "found"), "row", "left")
    # A row's own terms, wherever they stand as whole words.
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.transform("found", lambda x: x["word"]), "|"), F.lit(r")(?!\p{L})"))
    # The optimiser mustn't be led to match an absent pattern, hence one that nothing matches.
    both = both.withColumn("pattern", F.coalesce(pattern, F.lit("(?!)")))
    hits = F.when(F.col("found").isNotNull(), _placed(F.col("text"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), F.col("pattern")))
    both = both.withColumn("hits", F.coalesce(hits, F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))).withColumn("shares", F.map_from_entries(F.coalesce("found", F.expr("cast(array() as array<struct<word:string,share:double>>)"))))
    mark = lambda x: F.when(F.element_at("shares", F.lower(x["value"])) >= remove, 1).otherwise(0)
    terms = F.transform("hits", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("rank"), x["end"].alias("end"), mark(x).alias("removed")))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.lit(0).alias("removed")))
    inside = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    both = both.withColumn("all", F.when(F.size("hits") > 0, F.array_sort(F.concat(base, F.filter(terms, lambda t: ~inside(t))))).otherwise(base))
    own = F.filter("all", lambda x: x["rank"] == 4)
    removed = F.size(F.filter(own, lambda x: x["removed"] == 1)).cast("long")
    outcomes = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), F.when(x["removed"] == 1, "removed").otherwise("generalised"))), ",")
    out = both.select(
        F.col("id").alias(id_col),
        *(_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        (F.size(own) - removed).alias("n_generalised"),
        removed.alias("n_removed"),
        F.sha2(_joined(F.filter("all", lambda x: x["rank"] < 4)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        outcomes.alias("outcomes"),
        *([_put(F.col("text"), F.col("all")).alias("sanitised")] if sanitised else []),
    )
    discard(pairs)
    discard(held)
    return out


def _count(rank: int) -> Column:
    return F.size(F.filter("all", lambda x: x["rank"] == rank)).cast("long")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _put(text: Column, spans: Column) -> Column:
    """The text with its spans, which are sorted, replaced."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(state, x):
        later = x["start"] >= state["at"]
        what = F.when(x["removed"] == 1, F.lit("")).when(x["rank"] < 0, F.lit(" ")).otherwise(F.get(names, x["rank"]))
        out = F.when(later, F.concat(state["out"], F.substr(text, state["at"] + 1, x["start"] - state["at"]), what)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.expr("named_struct('at', 0, 'out', '')")
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.greatest(F.length(text) - s["at"], F.lit(0))))))
