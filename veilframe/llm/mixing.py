"""Soft-membership mixing: document rates whose expected tokens per domain meet target totals.

A multinomial classifier learned from a labelled table gives each document's posterior over the domains. Rates are
the non-negative least-squares solution, found by projected gradient: every step is one aggregation of a numeric
table to a few numbers. All rates start at one, so a document's rate is a function of its posterior and the steps
taken; the steps are folded inside the row and nothing per document is kept between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.llm.common import bounded_sample
from veilframe.session import materialize

FEATURES = 1 << 12


def _words(text: str) -> Column:
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")


def _featured(df: DataFrame, text: str) -> DataFrame:
    from pyspark.ml.feature import HashingTF

    return HashingTF(inputCol="__words", outputCol="__features", numFeatures=FEATURES).transform(df.withColumn("__words", _words(text)))


class Posteriors:
    """Classifier of domains: ``domains`` in order, ``add(df)`` appends the posterior and the token count."""

    def __init__(self, model, domains: list[str], text: str):
        self.model, self.domains, self.text = model, domains, text

    def add(self, df: DataFrame, posterior: str = "posterior", tokens: str = "tokens") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        columns = [F.col(f"`{c}`") for c in df.columns if c not in (posterior, tokens)]
        if len(self.domains) < 2:
            hot = F.array(*[F.lit(1.0)] * len(self.domains)).cast("array<double>")
            made = df.withColumn("__words", _words(self.text)).withColumn("__p", hot)
        else:
            self.model.setFeaturesCol("__features").setProbabilityCol("__v").setPredictionCol("").setRawPredictionCol("")
            made = self.model.transform(_featured(df, self.text)).withColumn("__p", vector_to_array("__v"))
        return made.select(*columns, F.col("__p").alias(posterior), F.size(F.filter("__words", lambda w: w != "")).cast("long").alias(tokens))


def fit_posteriors(labelled: DataFrame, text: str = "text", domain: str = "lang", key: str = "doc_id", per_domain: int = 800) -> Posteriors:
    """Multinomial logistic regression on hashed words of at most about ``per_domain`` labelled rows of each domain.

    Rows with a null label or text take no part; with no labelled row there is no domain, with one it is certain.
    """
    from pyspark.ml.classification import LogisticRegression

    rows = bounded_sample(labelled.filter(F.col(domain).isNotNull() & F.col(text).isNotNull()).select(key, text, domain), key, per_domain, by=domain)
    rows = materialize(rows, "mix_sample")
    domains = sorted(r[0] for r in rows.select(domain).distinct().collect())
    if len(domains) < 2:
        return Posteriors(None, domains, text)
    number = F.lit(0.0)
    for i, d in enumerate(domains):
        number = F.when(F.col(domain) == d, float(i)).otherwise(number)
    model = LogisticRegression(featuresCol="__features", labelCol="__y", maxIter=15, regParam=1e-3, family="multinomial", elasticNetParam=0.0)
    return Posteriors(model.fit(_featured(rows, text).withColumn("__y", number)), domains, text)


def _rate(steps: list[list[float]], step: float, ridge: float) -> Column:
    if not steps:
        return F.lit(1.0)
    path = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    dot = lambda g: F.aggregate(F.zip_with("posterior", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(path, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - F.lit(step) * (dot(g) + F.lit(ridge) * (r - 1.0))))


def solve_rates(table: DataFrame, targets: list[float], ridge: float = 1e-4, tolerance: float = 1e-4, rounds: int = 60) -> tuple[Column, list[float]]:
    """Rate expression over (posterior, tokens) and the totals it reaches.

    Minimises ``sum_d (sum_i tokens_i p_id r_i - target_d)^2 / have_d`` plus a small pull towards 1, over r >= 0.
    The scaling by what each domain holds makes the step size 1 safe, since posteriors sum to one.
    A domain that holds nothing cannot be met; its target is left out.
    """
    size = range(len(targets))
    totals = lambda r: [float(x or 0) for x in table.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i] * r) for i in size]).first()] if targets else []
    have = totals(F.lit(1.0))
    steps: list[list[float]] = []
    now = have
    for _ in range(rounds):
        gap = [(now[i] - targets[i]) / have[i] if have[i] > 0 else 0.0 for i in size]
        if max(map(abs, gap), default=0.0) < tolerance:
            break
        steps.append(gap)
        now = totals(_rate(steps, 1.0, ridge))
    return _rate(steps, 1.0, ridge), now


def mix(docs: DataFrame, model: Posteriors, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """All columns of ``docs`` plus posterior, tokens, and rate (expected copies, >= 0).

    ``weights``: wanted shares of the domains they name, made to sum to one over what the others leave; a domain not
    named keeps its present share. ``total``: wanted tokens, by default as many as there are. A null or empty text has no tokens; its rate follows its posterior and costs nothing.
    Rows are kept apart even if equal. An empty table gives an empty table.
    """
    return _rated(materialize(model.add(docs), "mix"), model, weights, total)


def mix_slim(docs: DataFrame, model: Posteriors, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """``mix`` without the text column, which is then not written."""
    return _rated(materialize(model.add(docs).drop(model.text), "mix"), model, weights, total)


def _rated(table: DataFrame, model: Posteriors, weights: dict[str, float], total: float | None) -> DataFrame:
    whole = table.agg(F.sum("tokens")).first()[0] or 0
    wish = [max(0.0, weights.get(d, 0.0)) for d in model.domains]
    free = [i for i, d in enumerate(model.domains) if d not in weights]
    now = table.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]) for i in free]).first() if free and whole else []
    share = dict(zip(free, [float(x or 0) / whole for x in now]))
    left = max(0.0, 1.0 - sum(share.values()))
    goal = [share.get(i, w / (sum(wish) or 1.0) * left) * (whole if total is None else total) for i, w in enumerate(wish)]
    rate, _ = solve_rates(table, goal)
    return table.withColumn("rate", rate)


def apply_rates(mixed: DataFrame, key: str = "doc_id", rate: str = "rate") -> DataFrame:
    """Each row as often as its rate says: the whole part, and one more where a hash of the key falls below the rest."""
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("int")).cast("int")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("__copy")
