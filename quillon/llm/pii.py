"""Personal data: base rules plus bootstrapped contextual extraction.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone
numbers. They seed the bootstrap. Candidates are strings of the loose form of
a kind, spaces and signs included: a base span, or one that a base rule turns
down, such as a number whose check sum fails. A candidate stands in two lexical
patterns, the word before it and the word after it. Patterns and candidates
form a graph. A pattern's score for a kind is the share of accepted ones among
its distinct candidates of that kind's form, damped for few of them; a
candidate's is the chance that one of its high-scoring patterns is right. At
first seeds alone are accepted. Each round accepts the candidates of high
score, which raise the scores of the other patterns that they stand in, until
a round accepts nothing new. Accepted candidates become spans wherever they
stand.

All of it is DataFrame expressions; positions come from the pieces that a
split leaves between matches, and so do the words around them, so that the
work is linear in the text and no context is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm import common
from quillon.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
# A match may start at the last one's end, or where its first class begins:
# within a run a later start meets the same end, so it fails where the first
# did. Possessive runs keep the time linear on long ones.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without these have no such match, and skip the search.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# Maximal strings that may be a candidate: words around an at sign, and digits
# with one or two signs between their runs.
CANDIDATE = r"[\p{L}0-9._%+-]++@(?:[\p{L}0-9_%+-]++(?:\.[\p{L}0-9_%+-]++)*+)?|\+?+\(?+[0-9]++(?:[\x20().-]{1,2}\(?+[0-9]++)*+"
# Loose forms by kind, as whole matches; card and phone count digits besides.
FORMS = {"email": r"^[^@]++@[^@]++$", "ip": r"^[0-9]++(?:\.[0-9]++){3}$", "card": r"^[0-9]++(?:[\x20-][0-9]++)*+$", "phone": r"^\+?+[0-9\x20().-]++$"}
DIGITS = {"card": (12, 19), "phone": (9, 15)}
#: The score that counts as high, and the weight of doubt that a pattern starts
#: with, in candidates.
CONFIDENT, DOUBT = 0.8, 1.0


def located(text: Column, pattern: str, around: bool = False) -> Column:
    """Array of (s, e, v): code point start and end, and text, of each match;
    if around, with left and right, the texts between it and its neighbours."""
    if around:
        pieces = F.split(text, pattern, -1)
        return F.transform(located(text, pattern), lambda m, i: m.withField("left", F.get(pieces, i)).withField("right", F.get(pieces, i + 1)))
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s int, e int, v string>>)").alias("out"))

    def step(acc, pair):
        s = acc["at"] + F.length(pair["p"])
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("v")))).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The digits' check sum holds: every second from the right counts double."""
    terms = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + F.coalesce(t, F.lit(0))) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    n = F.length(_digits(v))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(v))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _of_kind(text: Column, k: int) -> Column:
    own = F.filter(located(text, BASE[KINDS[k]]), lambda m: _holds(KINDS[k], m["v"]))
    return F.transform(own, lambda m: F.struct(m["s"], m["e"], F.lit(k).alias("k"), m["v"]))


def base_spans(text: Column) -> Column:
    """Array of (s, e, k, v) of all base matches by start, then kind."""
    none = F.expr("cast(array() as array<struct<s int, e int, k int, v string>>)")
    parts = []
    for k, kind in enumerate(KINDS):
        hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
        parts.append(F.when(hint, _of_kind(text, k)).otherwise(none))
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))


def candidates(text: Column) -> Column:
    """Array of (s, e, v, left, right, forms) of candidates: the words before and
    after, in lower case, and the numbers of the kinds whose loose form v has."""
    none = F.expr("cast(array() as array<struct<s int, e int, v string, left string, right string, forms array<int>>>)")

    def described(m):
        v, n = m["v"], F.length(_digits(m["v"]))
        fits = [v.rlike(FORMS[kind]) & (n.between(*DIGITS[kind]) if kind in DIGITS else F.lit(True)) for kind in KINDS]
        forms = F.filter(F.array(*[F.when(f, F.lit(k)) for k, f in enumerate(fits)]), lambda k: k.isNotNull())
        left = F.lower(F.regexp_extract(m["left"], r"(?<!\p{L})(\p{L}++)[^\p{L}]*+$", 1))
        right = F.lower(F.regexp_extract(m["right"], r"^[^\p{L}]*+(\p{L}++)", 1))
        return F.struct(m["s"].alias("s"), m["e"].alias("e"), v.alias("v"), left.alias("left"), right.alias("right"), forms.alias("forms"))

    likely = lambda m: m["v"].contains("@") | (F.length(_digits(m["v"])) >= 9) | m["v"].rlike(FORMS["ip"])
    found = F.transform(F.filter(located(text, CANDIDATE, around=True), likely), described)
    return F.when(text.rlike(r"@|[0-9](?:[\x20().-]{0,3}[0-9]){8}|[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(found, lambda m: F.size(m["forms"]) > 0)).otherwise(none)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"].cast("string"), m["e"].cast("string"))), ",")


def bootstrap(edges: DataFrame, scratch: Scratch, confident: float = CONFIDENT, doubt: float = DOUBT) -> tuple[DataFrame, int]:
    """Accepted candidates (v, k, q) that are no seeds, and how many rounds accepted some.

    edges has one row for each distinct (pat, v, k) of a candidate and a kind
    whose form it has, with seed, the kind of v where a base rule names one.
    Scores are rounded, so that the order of sums decides no tie. A candidate
    that high-scoring patterns give several kinds gets the likeliest, of ties
    the first. Accepted ones keep their kind and score; the set only grows,
    so the rounds end.
    """
    support = scratch.keep(edges.groupBy("pat", "k").agg(F.count("*").alias("n"), F.count_if(F.col("seed").eqNullSafe(F.col("k"))).alias("own")))
    free = scratch.keep(edges.where("seed is null").select("pat", "v", "k"))
    accepted, rounds = scratch.keep(free.select("v", "k", F.lit(0.0).alias("q")).where("false")), 0
    while True:
        gained = free.join(accepted, ["v", "k"]).groupBy("pat", "k").agg(F.count("*").alias("more"))
        scored = support.join(gained, ["pat", "k"], "left").select("pat", "k", F.round((F.col("own") + F.coalesce("more", F.lit(0))) / (F.col("n") + doubt), 9).alias("p"))
        high = scratch.keep(scored.where(F.col("p") >= confident))
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))
        reached = free.join(high, ["pat", "k"]).groupBy("v", "k").agg(F.round(1 - miss, 9).alias("q"))
        best = reached.groupBy("v").agg(F.max(F.struct("q", (-F.col("k")).alias("nk"))).alias("m")).select("v", (-F.col("m.nk")).alias("k"), "m.q")
        new = scratch.keep(best.join(accepted.select("v"), "v", "left_anti"))
        if new.isEmpty():
            scratch.drop(support, free, high, new)
            return accepted, rounds
        grown = scratch.keep(accepted.unionAll(new))
        scratch.drop(accepted, high, new)
        accepted, rounds = grown, rounds + 1


def find_pii(docs: DataFrame, id_col="doc_id", text_col="text", confident: float = CONFIDENT, doubt: float = DOUBT) -> DataFrame:
    """One row per document: id, n_<kind> of base spans, base_sha256, spans, n_added.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind, comma-joined; spans holds base and added ones. Added spans overlap no
    base span. Null and empty texts have none. Rows that repeat an id are
    reported each for its own text; a null id is kept. Tied scores go to the
    kind listed first. Other columns are ignored and an empty table gives no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", base_spans(text).alias("base"), candidates(text).alias("words"))
    found = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    words = found.where("size(words) > 0").select("row", "base", F.inline("words"))
    hit = F.filter("base", lambda b: (b["s"] < F.col("e")) & (b["e"] > F.col("s")))
    same = F.filter(hit, lambda b: (b["s"] == F.col("s")) & (b["e"] == F.col("e")))
    words = words.select("row", "s", "e", "v", "left", "right", "forms", F.get(same, F.lit(0))["k"].alias("seed"), F.size(hit).alias("hits"))
    # a candidate that a base span lies in, or cuts, is neither a seed nor free
    words = scratch.keep(words.where("seed is not null or hits = 0").drop("hits"))
    pats = F.filter(F.array(F.when(F.col("left") != "", F.concat(F.lit("<"), "left")), F.when(F.col("right") != "", F.concat(F.lit(">"), "right"))), lambda p: p.isNotNull())
    kinds = F.array_union(F.col("forms"), F.filter(F.array("seed"), lambda k: k.isNotNull()))
    edges = words.select("v", "seed", kinds.alias("kinds"), F.explode(pats).alias("pat")).select("pat", "v", "seed", F.explode("kinds").alias("k"))
    edges = scratch.keep(edges.groupBy("pat", "v", "k").agg(F.min("seed").alias("seed")))
    # a value that is a seed anywhere is one in all its patterns
    seeds = edges.where("seed is not null").groupBy("v").agg(F.min("seed").alias("kind"))
    whole = scratch.keep(edges.join(scratch.keep(seeds), "v", "left").select("pat", "v", "k", F.col("kind").alias("seed")))
    accepted, _ = bootstrap(whole, scratch, confident, doubt)
    added = words.where("seed is null").join(accepted.select("v", "k"), "v").groupBy("row").agg(F.collect_list(F.struct("s", "e", "k")).alias("added"))
    joined = found.drop("words").join(added, "row", "left")
    both = F.concat(F.transform("base", lambda b: F.struct(b["s"], b["e"], b["k"])), F.coalesce("added", F.expr("cast(array() as array<struct<s int, e int, k int>>)")))
    both = F.array_sort(both, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return joined.select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(both).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.read(spark, sf_dir, "documents"))
