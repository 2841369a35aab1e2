"""Mixing by soft membership: document rates whose expected domain tokens match targets.

A classifier learnt from a table of labelled documents gives every document its
posterior over domains. Projected-gradient least squares then finds nonnegative rates
so that, over all documents, rate * tokens * posterior sums to each domain's target.
The gaps are weighed by the inverse of the posteriors' second moments, so that steps
are about 1 long. A gradient needs only the domains' sums, so a
round is one aggregate over a narrow table and moves a handful of numbers; a document's
rate is a function of its posterior and the rounds' steps. Rounds go on until every
domain is within `CLOSE` of its target, or, where no rates reach the targets, until a
round no longer helps; the gap that is left is returned. DataFrame functions only.

The classifier is a multinomial logistic regression on the `WORDS` most telling words
and shape features, fit on at most `SAMPLE` labelled documents (documented bound, chosen by
hash of the id). Posteriors, sums and rates cover every document.

Defined cases: a null text has no tokens, the domains' prior as posterior and a rate
like others; labels without a document or with a null domain are ignored; of several
labels of a document the least domain counts; without labelled documents every domain
gets an equal posterior; repeated rows have equal rates; input columns keep their
names and values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.workspace import Workspace

SAMPLE, WORDS, LEAST_DOCS = 20_000, 1024, 8
PENALTY, FIT_ROUNDS, FIT_TASKS = 0.001, 100, 4  # the fit ends before by its own tolerance
AMISS = 0.3  # a word of the domain tells in a short text too; the posteriors of other documents lie below
CLOSE, HELPS, SAVE_EVERY = 1e-3, 0.995, 10
SHORTER, LONGER = (0.4, 0.15, 0.05), (1.0, 8.0)


def _share(part: Column, whole: Column, cuts: list[float], name: str) -> Column:
    level = sum(((part / F.greatest(whole, F.lit(1))) >= c).cast("int") for c in cuts)
    return F.concat(F.lit(f"#{name}="), level.cast("string"))


def tokens_of(text: Column) -> Column:
    """Lower-cased words: what lies between blanks and ASCII marks. The first and last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x20!-/:-@\[-`{-~]+", -1)


def shape_of(text: Column) -> Column:
    """Features of the text's outward form, as words that no text holds."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    marks = n - F.length(F.regexp_replace(t, "[!#$%&*|{}<>=_^~]+", ""))
    capitals = n - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return F.array(_share(marks, n, [0.005, 0.02, 0.05, 0.1, 0.2], "marks"), _share(capitals, n, [0.02, 0.05, 0.1, 0.3], "capitals"))


def word_count(words: Column) -> Column:
    ends = (F.element_at(words, 1) == "").cast("int") + ((F.element_at(words, -1) == "") & (F.size(words) > 1)).cast("int")
    return (F.size(words) - ends).cast("long")


def terms_of(words: Column, text: Column) -> Column:
    """What the classifier sees of a text: its words and its outward form."""
    return F.concat(words, shape_of(text))


@dataclass(frozen=True)
class Classifier:
    """Posteriors over domains. Without a fit they are the prior."""

    prior: list[float]
    vectors: CountVectorizerModel | None = None
    fitted: LogisticRegressionModel | None = None
    places: tuple[int, ...] = ()  # of each domain among the fitted classes, -1 if it had no documents

    def with_posterior(self, rows: DataFrame) -> DataFrame:
        """rows (with columns words and text) and p, an array<double>; all of it in the row, no shuffle."""
        if self.fitted is None:
            return rows.withColumn("p", F.lit(self.prior))
        found = self.fitted.transform(self.vectors.transform(rows.withColumn("terms", terms_of(F.col("words"), F.col("text")))))
        of = F.array(*[F.col("_of")[i] if i >= 0 else F.lit(0.0) for i in self.places])
        return found.withColumn("_of", vector_to_array("probability")).withColumn("p", of).drop("terms", "features", "probability", "_of")


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], ws: Workspace) -> Classifier:
    """A classifier from at most SAMPLE labelled documents, whose distinct terms are written once."""
    sample = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # a bounded table of two narrow columns
    text = F.col("text")
    terms = F.concat(F.array_distinct(F.filter(tokens_of(text), lambda w: w != "")), shape_of(text))
    rows = ws.save(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", terms.alias("terms")), "labelled")
    each = rows.select("domain", F.explode(F.array_append("terms", F.lit("#all"))).alias("word")).filter(F.length("word") <= 64)
    per = each.groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    totals = rows.agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)]).first()
    size = [totals[f"n{i}"] for i in range(len(domains))]
    n = sum(size)
    prior = [(c + 1) / (n + len(domains)) for c in size]
    if sum(c > 0 for c in size) < 2:
        return Classifier(prior)
    seen = sum(F.col(f"n{i}") for i in range(len(domains)))
    # How far a word's counts lie from what the domains' sizes give (the G statistic).
    gain = sum(F.col(f"n{i}") * F.log((F.col(f"n{i}") + 0.1) / (seen * (size[i] / n) + 0.1)) for i in range(len(domains)))
    best = [r["word"] for r in per.filter((F.col("word") != "#all") & (seen >= LEAST_DOCS)).select("word", gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(WORDS).collect()]
    if not best:
        return Classifier(prior)
    vectors = CountVectorizerModel.from_vocabulary(best, inputCol="terms", outputCol="features")
    vectors.setBinary(True)
    held = [d for d, c in zip(domains, size, strict=True) if c]
    label = F.create_map(*[x for i, d in enumerate(held) for x in (F.lit(d), F.lit(float(i)))])
    table = vectors.transform(rows.select(F.element_at(label, F.col("domain")).alias("label"), "terms"))
    # The sample is bounded, and a round of the fit is a job: the sums of FIT_TASKS tasks meet at once, so a round has two stages of few tasks, of which the driver keeps a record.
    table = table.coalesce(FIT_TASKS)
    fitted = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=FIT_ROUNDS, standardization=False).fit(table)
    fitted.write().overwrite().save(f"{ws.path}/classifier")
    fitted = LogisticRegressionModel.load(f"{ws.path}/classifier")  # without the fit's summary, which holds the session and its table
    fitted.setPredictionCol("").setRawPredictionCol("")
    return Classifier(prior, vectors, fitted, tuple(held.index(d) if d in held else -1 for d in domains))


def _sums(members: DataFrame, rates: list[Column], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column of rates, each domain's tokens, and the second moments of the posteriors of the documents with a rate above 0, by tokens."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    held = members.select("n", "p", *[r.alias(f"r{c}") for c, r in enumerate(rates)])
    p, n = [F.col("p")[i] for i in range(k)], F.col("n")
    sums = [x for c in range(len(rates)) for r in [F.col(f"r{c}")] for x in (*[n * r * y for y in p], *[F.when(r > 0, n * p[i] * p[j]) for i, j in pairs])]
    got = iter(held.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(sums)]).first())
    out = []
    for _ in rates:
        tokens, moments = np.array([next(got) or 0.0 for _ in range(k)]), np.zeros((k, k))
        for i, j in pairs:
            moments[i, j] = moments[j, i] = next(got) or 0.0
        out.append((tokens, moments))
    return out


def fit_rates(members: DataFrame, k: int, shares: list[float], ws: Workspace) -> tuple[list[list[float]], float]:
    """(steps, gap): projected gradient descent from rate 1 on the weighed squared gaps; the largest gap left, as a share of all tokens.

    members has n (tokens) and p (posteriors). A step is first taken under the moments of
    the documents whose rates are not at 0; where that doesn't halve the gaps, it is held
    against shorter ones and against steps under the moments of all documents, of which
    length 1 always narrows the gaps. Every SAVE_EVERY rounds the rates so far are
    written, so that expressions stay short.
    """
    now, whole = _sums(members, [F.lit(1.0)], k)[0]
    total = float(now.sum())
    if total == 0:
        return [], 0.0
    goal = np.array(shares) * total
    ridge = 1e-9 * total * np.eye(k)
    fixed = np.linalg.inv(whole + ridge)
    near = CLOSE * np.maximum(goal, CLOSE * total)
    size = lambda tokens: float((tokens - goal) @ fixed @ (tokens - goal))
    steps: list[list[float]] = []
    state, since, moments = members.select("n", "p", F.lit(1.0).alias("rate")), 0, whole

    def tried(choices: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray, list[float]]]:
        got = _sums(state, [rate_of(F.col("p"), [*steps[since:], c.tolist()], F.col("rate")) for c in choices], k)
        return [(size(t), t, m, c.tolist()) for (t, m), c in zip(got, choices, strict=True)]

    while (abs(now - goal) > near).any():
        own, all_of = np.linalg.inv(moments + ridge) @ (now - goal), fixed @ (now - goal)
        best = tried([own])[0]
        if best[0] > 0.5 * size(now):
            best = min([best, *tried([*(x * own for x in SHORTER), *(x * all_of for x in LONGER)])], key=lambda x: x[0])
        if best[0] > HELPS * size(now):  # no rates come closer
            break
        _, now, moments, step = best
        steps.append(step)
        if len(steps) % SAVE_EVERY == 0:
            state, since = ws.save(state.select("n", "p", rate_of(F.col("p"), steps[since:], F.col("rate")).alias("rate")), f"rates{len(steps)}"), len(steps)
    return steps, float(abs(now - goal).max() / total)


def rate_of(p: Column, steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate after the steps. They are one array literal, so that every round runs the same compiled code.

    p is bound once: an expression in its place is not evaluated again at every step.
    """
    rate = F.lit(1.0) if start is None else start
    if not steps:
        return rate
    taken = F.transform(F.array(p), lambda v: F.aggregate(F.lit(steps), rate, lambda r, s: F.greatest(F.lit(0.0), r - sum(v[i] * s[i] for i in range(len(steps[0]))))))
    return taken[0]


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], ws: Workspace, natural_except: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, Column, float]:
    """(members, the rate of a member, the largest gap left): members, written once, has doc_id or the columns named by keep, n (tokens) and p (posteriors).

    targets gives the domains' weights. With natural_except, targets are the domains'
    tokens in the documents whose posterior of that one is below AMISS: rates reach them
    without a cut into those documents.
    """
    domains = sorted(targets)
    model = train(docs, labelled, domains, ws)
    rows = model.with_posterior(docs.select(*(keep or ["doc_id"]), "text", tokens_of(F.col("text")).alias("words")))
    members = ws.save(rows.select(*(keep or ["doc_id"]), word_count(F.col("words")).alias("n"), "p"), "members")
    ws.drop("labelled")
    if natural_except is not None:
        other = F.when(F.col("p")[domains.index(natural_except)] < AMISS, 1.0).otherwise(0.0)
        (mass, _), (rest, _) = _sums(members, [F.lit(1.0), other], len(domains))
        shares = (rest / max(1e-9, mass.sum())).tolist()
    else:
        weight = sum(targets.values())
        shares = [targets[d] / weight for d in domains]
    steps, gap = fit_rates(members, len(domains), shares, ws)
    return members, rate_of(F.col("p"), steps), gap


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


TARGETS = {"good": 0.88, "low": 0.11, "toxic": 0.01}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, posteriors and rate of every document, for fixed target weights, and the largest gap left as a share of all tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    members, rate, gap = rates(docs, labelled, TARGETS, Workspace(spark, "op8"))
    return members.select("doc_id", F.col("n").alias("n_tokens"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))], rate.alias("rate"), F.lit(gap).alias("largest_gap"))


def mix_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, name: str = "mix") -> DataFrame:
    """Rows of docs whose rate rounds to one copy or more when toxic tokens are mixed out and the rest stay as they are; columns unchanged.

    Posteriors are written beside the rows, so that they are worked out once.
    """
    whole = docs.select("doc_id", "text", F.struct("*").alias("doc"))
    members, rate, _ = rates(whole, domain_labels(labels), TARGETS, Workspace(docs.sparkSession, name), natural_except="toxic", keep=["doc"])
    return members.filter(rate >= least).select("doc.*")
