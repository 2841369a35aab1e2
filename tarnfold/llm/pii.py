"""Personal data by weak supervision, in DataFrame functions alone.

Strict patterns find the base spans; looser patterns propose more candidates of the
same kinds. Regex, gazetteer, context and shape labelers vote on every candidate.
Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability, the posteriors label the candidates, and a naive Bayes span classifier
trained on them decides which proposed candidates become spans. Base spans stay.

Only two things reach the driver: counts by vote pattern and by feature value. Both
have a size fixed by the number of labelers and features, not by the corpus.

Defined cases: a null text counts as empty and has no spans; a null id is carried
along; repeated rows are judged one by one; an empty table gives no rows; offsets are
code points; of one pattern's matches the leftmost ones stand; a proposal that overlaps
a base span of any kind goes; proposals of several kinds may overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.workspace import Workspace

KINDS = ["email", "ip", "card", "phone"]

# The strict patterns. They match what the plain forms match; runs that
# never need to give back a character are possessive, so that Java's matcher doesn't
# recurse over long runs.
STRICT = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns, which propose candidates.
LOOSE = {
    "email": r"(?i)[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"[0-9]{1,3}+(?:[\[(]\.[\])][0-9]{1,3}+){3}",
    "card": r"[0-9]{4}(?:[._/:][0-9]{4}){3}",
    "phone": r"(?:\([0-9]{3}\)\x20?|(?<![0-9.+])[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers and context words.
GAZETTEER = {
    "email": r"(?i)(?:com|net|org|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|nl|ch|at|be|pl|ru|jp|cn|in|br|mx|au)$",
    "ip": r"^(?!0|255|24[0-9]|25[0-9])[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])|\(?[2-9])",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt|adresse)",
    "ip": r"(?i)(?:\bip\b|address|server|host|from|login|client|addr)",
    "card": r"(?i)(?:card|visa|master|credit|payment|tarjeta|carte|karte)",
    "phone": r"(?i)(?:phone|tel\b|tel[.:]|call|mobile|fax|cell|telefon|t.l.fono|appel|rufen)",
}
AGAINST = r"(?i)(?:version|isbn|issn|\bref\b|order|part|serial|section|chapter|\bid\b|=)\W*$"
AROUND, BLOCK = 40, 64
LABELERS = 4
SPAN = "struct<kind:int,start:int,stop:int,strict:int,votes:string,features:array<string>>"


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _finds(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, s>> of the leftmost non-overlapping matches; what lies between gives the offsets.

    Offsets are sums of all lengths before: of whole blocks of BLOCK pieces first, then
    within the block, so that many matches cost about their number times BLOCK.
    """
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s"), (F.length(gap) + F.coalesce(F.length(s), F.lit(0))).alias("n")),
    )
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])
    grow = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    none = F.expr("CAST(named_struct('at', 0, 'out', array()) AS struct<at:int,out:array<int>>)")

    def placed(ps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(ps, b * BLOCK + 1, F.lit(BLOCK))))
        return _bound(F.aggregate(blocks, none, grow, lambda acc: acc["out"]), lambda starts: F.transform(ps, lambda x, i: at(ps, starts, x, i)))

    def at(ps: Column, starts: Column, x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.element_at(starts, block + 1) + total(F.slice(ps, block * BLOCK + 1, i % BLOCK)) + x["gap"]
        return F.struct(start.cast("int").alias("start"), (start + F.length(x["s"])).cast("int").alias("stop"), x["s"].alias("s"))

    return F.filter(_bound(pieces, placed), lambda x: x["s"].isNotNull())


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""

    def term(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), term)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _part_ok(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) > 3, False).otherwise(F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.filter(F.split(s, "[^0-9]+"), lambda p: p != ""), _part_ok)
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _described(text: Column, kind: str, found: Column, strict: bool) -> Column:
    """Candidates with the labelers' votes (+, - or 0 each) and the classifier's features."""

    def one(x: Column) -> Column:
        before = F.substr(text, F.greatest(x["start"] - AROUND + 1, F.lit(1)), F.least(x["start"], F.lit(AROUND)))
        after = F.substr(text, x["stop"] + 1, F.lit(1))
        vote = lambda c: F.when(c, "+").otherwise("-")
        context = F.when(before.rlike(CONTEXT[kind]), "+").when(before.rlike(AGAINST), "-").otherwise("0")
        shape = vote(~before.rlike(r"[\p{L}\p{N}_#/=\x22-]$") & ~after.rlike(r"^[\p{L}\p{N}_@=/\x22]"))
        key = _digits(x["s"]) if kind == "card" else x["s"]
        known = vote(key.rlike(GAZETTEER[kind]))
        votes = F.concat(F.lit("+" if strict else "0"), known, context, shape)
        feature = lambda name, value: F.concat(F.lit(f"{kind}.{name}="), value.cast("string"))
        features = F.array(
            feature("context", context), feature("shape", shape), feature("known", known),
            feature("length", F.least(F.floor((x["stop"] - x["start"]) / 4), F.lit(12))), feature("digits", F.least(F.length(_digits(x["s"])), F.lit(20))),
            feature("after", F.when(after == "", "end").when(after.rlike(r"^\p{L}"), "letter").when(after.rlike(r"^\p{N}"), "digit").when(after.rlike(r"^\s"), "blank").otherwise("mark")),
        )
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(int(strict)).alias("strict"), votes.alias("votes"), features.alias("features"))

    return F.transform(F.filter(found, lambda x: _valid(kind, x["s"])), one).cast(f"array<{SPAN}>")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of each whole text, base spans and proposed ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    # Cheap tests first: a pattern runs only over texts that hold a character it needs.
    digit, at, plus = F.col("digit"), F.contains("text", F.lit("@")), F.contains("text", F.lit("+"))
    bracket = F.contains("text", F.lit("[")) | F.contains("text", F.lit("(")) | F.contains("text", F.lit("{"))
    needs = {("email", True): at, ("ip", True): digit, ("card", True): digit, ("phone", True): digit & plus, ("email", False): bracket, ("ip", False): digit & bracket, ("card", False): digit, ("phone", False): digit}
    rows = docs.select("doc_id", text.alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    parts = [F.when(need, _described(F.col("text"), kind, _finds(F.col("text"), (STRICT if strict else LOOSE)[kind]), strict)).otherwise(none) for (kind, strict), need in needs.items()]
    every = F.when(digit | at | bracket, F.flatten(F.array(*parts))).otherwise(none)
    rows = rows.select("doc_id", every.alias("spans"))
    base = F.filter("spans", lambda s: s["strict"] == 1)
    clear = F.filter("spans", lambda s: (s["strict"] == 0) & ~F.exists(F.col("base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return rows.withColumn("base", base).select("doc_id", "base", clear.alias("proposed"))


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior that a candidate with a vote pattern is personal data, by expectation-maximisation (two classes, labelers independent given the class)."""
    votes = "+-0"
    prior, rate = {}, {}
    for kind in KINDS:
        prior[kind] = 0.7
        for j in range(LABELERS):
            rate[kind, j, 1] = {"+": 0.7, "-": 0.1, "0": 0.2}
            rate[kind, j, 0] = {"+": 0.2, "-": 0.5, "0": 0.3}
    post: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        for kind, v, _n in patterns:
            like = [(prior[kind] if c else 1 - prior[kind]) * math.prod(rate[kind, j, c][x] for j, x in enumerate(v)) for c in (0, 1)]
            post[kind, v] = like[1] / max(sum(like), 1e-300)
        for kind in KINDS:
            own = [(v, n, post[kind, v]) for k, v, n in patterns if k == kind]
            if not own:
                continue
            total = sum(n for _, n, _ in own)
            prior[kind] = min(0.99, max(0.01, (sum(n * p for _, n, p in own) + 1) / (total + 2)))
            for j in range(LABELERS):
                for c in (0, 1):
                    mass = {x: 0.5 + sum(n * (p if c else 1 - p) for v, n, p in own if v[j] == x) for x in votes}
                    rate[kind, j, c] = {x: mass[x] / sum(mass.values()) for x in votes}
    return post


def _literal_map(pairs: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.expr("CAST(map() AS map<string,double>)")


def classify(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """rows of candidates() with `added`: the proposed spans that the trained classifier accepts."""
    each = rows.select(F.explode(F.concat("base", "proposed")).alias("s")).select("s.*")
    got = each.groupBy("kind", "votes").count().collect()  # at most kinds * 3^labelers rows
    post = estimate([(KINDS[r["kind"]], r["votes"], r["count"]) for r in got])
    chance = _literal_map({f"{k}{v}": p for (k, v), p in post.items()})
    name = F.element_at(F.lit(KINDS), F.col("kind") + 1)
    soft = each.withColumn("p", F.element_at(chance, F.concat(name, "votes")))
    per = soft.select("p", F.explode(F.array_append("features", F.concat(name, F.lit(".all")))).alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # features have fixed value sets
    total = {r["f"].split(".")[0]: (r["yes"], r["no"]) for r in per if r["f"].endswith(".all")}
    weight = {}
    for r in per:
        yes, no = total[r["f"].split(".")[0]]
        weight[r["f"]] = math.log((r["yes"] + 1) / (r["no"] + 1)) if r["f"].endswith(".all") else math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
    scores = _literal_map(weight)
    threshold = math.log(cut / (1 - cut))

    def accepted(s: Column) -> Column:
        own = F.concat(F.element_at(F.lit(KINDS), s["kind"] + 1), F.lit(".all"))
        logit = F.aggregate(F.array_append(s["features"], own), F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(scores, f), F.lit(0.0)))
        return logit > threshold

    return rows.withColumn("added", F.filter("proposed", accepted))


def spelled(spans: Column) -> Column:
    """kind:start:end of the spans, by kind as listed, then start, comma-joined."""
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(plain, lambda s: F.concat_ws(":", F.element_at(F.lit(KINDS), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_spans(docs: DataFrame, name: str = "pii") -> DataFrame:
    """doc_id, base, proposed and added spans of every row of docs."""
    ws = Workspace(docs.sparkSession, name)
    return classify(ws.save(candidates(docs), "candidates"))


def count_of(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind. Spark gives a function of two arguments the span's place as the second, so the kind is none of them."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), "op6")
    return found.select("doc_id", *[count_of("base", kind).alias(f"n_{kind}") for kind in KINDS], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans"))
