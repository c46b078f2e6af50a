"""Soft-membership mixing: a rate for every document, so that expected tokens of each domain meet target weights.

All of it is DataFrame expressions. Counts of characters of some classes describe a text; a labelled table teaches how often each value
comes with each domain, which gives every document a posterior over the domains (naive Bayes). A document of n tokens and
posterior p adds n p to the domains' expected tokens. Rates r >= `least_rate` minimise the distance of their sum to the targets by
projected gradient steps, each an aggregate of some numbers for each pair of domains, and end as one expression on each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.session import staged

# Classes of characters whose share tells languages and junk apart.
CLASSES = {"upper": "[A-ZÀ-ÖØ-Þ]", "digit": "[0-9]", "mark": r"[!#$%&*|~^=<>{}\[\]]", "stop": r"[.,;:?]", "acute": "[éèêçàâîôû]", "umlaut": "[äöüß]", "tilde": "[ñóíáú]", "line": "\n", "th": "th"}
WORD = r"[^\x20\x09-\x0D]+"
BINS = 12
MOST_DOMAINS = 64


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (words) and a bin from 0 to 11 for every feature; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), *(F.regexp_count(text, F.lit(p)).alias(f"c_{name}") for name, p in CLASSES.items()))
    share = {name: F.col(f"c_{name}") / F.greatest("size", F.lit(1)) for name in CLASSES}
    bins = {name: F.least(F.lit(BINS - 1), F.floor(F.log2(1 + 2000 * s))) for name, s in share.items()}
    bins["length"] = F.least(F.lit(BINS - 1), F.floor(F.log2(1 + F.col("size") / 16)))
    bins["word"] = F.least(F.lit(BINS - 1), F.floor(F.col("size") / F.greatest("n_tokens", F.lit(1))))
    return rows.select("doc_id", "n_tokens", *(b.cast("int").alias(f"b_{name}") for name, b in bins.items()))


def posteriors(features: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """features with an array p over the domains, whose names are given too, in order.

    labelled: doc_id and domain; rows with a null in either don't count. Without any there is one domain, 'all'.
    """
    names = [c for c in features.columns if c.startswith("b_")]
    known = labelled.filter("domain IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).distinct()
    taught = features.join(known, "doc_id")
    long = taught.select("domain", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("bin")) for c in names), F.struct(F.lit("rows").alias("name"), F.lit(0).alias("bin")))).alias("f"))
    # One row for each domain, feature and bin.
    counts = {(r.domain, r.name, r.bin): r.n for r in long.groupBy("domain", "f.name", "f.bin").agg(F.count("*").alias("n")).collect()}
    domains = sorted({d for d, _, _ in counts})
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"{len(domains)} domains; at most {MOST_DOMAINS} are allowed")
    if not domains:
        return features.withColumn("p", F.array(F.lit(1.0))), ["all"]
    total = sum(n for (_, name, _), n in counts.items() if name == "rows")

    def log_likelihood(domain: str) -> Column:
        rows = counts[domain, "rows", 0]
        out = F.lit(math.log(rows / total))
        for c in names:
            table = [math.log((counts.get((domain, c, b), 0) + 0.5) / (rows + 0.5 * BINS)) for b in range(BINS)]
            out = out + F.element_at(F.array(*map(F.lit, table)), F.col(c) + 1)
        return out

    scored = features.withColumns({f"l{k}": log_likelihood(d) for k, d in enumerate(domains)})
    peak = F.greatest(*(f"l{k}" for k in range(len(domains)))) if len(domains) > 1 else F.col("l0")
    scored = scored.withColumn("peak", peak).withColumns({f"e{k}": F.exp(F.col(f"l{k}") - F.col("peak")) for k in range(len(domains))})
    whole = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return scored.withColumn("whole", whole).withColumn("p", F.array(*(F.col(f"e{k}") / F.col("whole") for k in range(len(domains))))), domains


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination on a matrix of one row for each domain, slightly lifted on the diagonal."""
    n = len(right)
    lift = 1e-9 * max(matrix[i][i] for i in range(n)) + 1e-30
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    for i in range(n):
        rows[i][i] += lift
    for i in range(n):
        best = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [x - f * y for x, y in zip(rows[k], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][k] * out[k] for k in range(i + 1, n))) / rows[i][i]
    return out


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, total_tokens: float | None = None, least_rate: float = 0.0, ridge: float = 1e-6, tolerance: float = 1e-6, most_steps: int = 100) -> DataFrame:
    """doc_id, n_tokens, p (posterior by domain), rate, copies (whole repeats whose expectation is the rate), off_target.

    targets: weight of each domain, equal ones by default; domains it doesn't name get 0, names without labelled rows are an error.
    total_tokens: the budget; by default the least with which no domain has to shrink. Rates minimise the squared distance of the expected
    totals to the targets, plus a small ridge (as a part of the largest eigenvalue of the domains' Gram matrix) on squared changes of rates, which chooses among
    equally good rates the ones nearest to 1. Where the bound keeps targets from being met, off_target tells by domain how
    far the totals end above or below them, as a part of the budget; it is the same in all rows. Documents without words have rate 1 (or least_rate, if that is more).
    Rows that repeat are rated each alike; a row without doc_id is rated too.

    Steps are projected gradients, projected late: documents of posterior p have the rate max(least_rate, 1 - p s), where s sums up all steps so
    far. A step is the gradient of the objective in s, scaled by the Gram matrix of the documents above the bound, and is halved until the
    objective falls enough; steps end where the gradient is within tolerance of the budget. Each is one aggregate over a table of one row for each posterior.
    """
    features, domains = posteriors(staged(described(docs)), labelled)
    k = len(domains)
    targets = targets if targets is not None else dict.fromkeys(domains, 1.0)
    if unknown := set(targets) - set(domains):
        raise ValueError(f"no labelled rows of {sorted(unknown)}")
    bins = [c for c in features.columns if c.startswith("b_")]
    # Equal bins have equal posteriors, and equal posteriors equal rates, whatever the sizes of documents.
    groups = staged(features.groupBy(*bins).agg(F.sum("n_tokens").cast("double").alias("mass"), F.first("p").alias("p")).select("mass", "p"))
    weight = [max(0.0, targets.get(d, 0.0)) / max(sum(targets.values()), 1e-300) for d in domains]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def change(s: list[float]) -> Column:
        return -sum((F.col("p")[i] * s[i] for i in range(1, k)), F.col("p")[0] * s[0])

    def looked(s: list[float], all_free: bool = False) -> tuple[float, list[float], list[list[float]]]:
        """Sum of the rates' potentials (whose derivative is the rate), expected totals, Gram matrix of what is above the bound."""
        u, edge = F.col("u"), least_rate - 1.0
        rows = groups.select("mass", "p", change(s).alias("u")).withColumn("free", (u > edge) | F.lit(all_free))
        potential = F.when(u > edge, u + u * u / 2).otherwise(least_rate * (u - edge) + edge + edge * edge / 2)
        rate = F.greatest(F.lit(float(least_rate)), 1 + u)
        free = F.when(F.col("free"), F.col("mass")).otherwise(0.0)
        sums = [F.sum(F.col("mass") * potential).alias("v"), *(F.sum(F.col("mass") * rate * F.col("p")[i]).alias(f"t{i}") for i in range(k)), *(F.sum(free * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i, j in pairs)]
        row = rows.agg(*sums).first()
        gram = [[float(row[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]
        return float(row["v"] or 0), [float(row[f"t{i}"] or 0) for i in range(k)], gram

    s = [0.0] * k
    potential, now, gram = looked(s, all_free=True)
    if total_tokens is None:
        total_tokens = max((t / w for t, w in zip(now, weight, strict=True) if w > 0), default=0.0)
    goal = [w * total_tokens for w in weight]
    hold = ridge * max(sum(map(abs, row)) for row in gram)  # the largest row sum is at least the largest eigenvalue

    def objective(potential: float, s: list[float]) -> float:
        return potential + sum(g * x for g, x in zip(goal, s, strict=True)) + hold / 2 * sum(x * x for x in s)

    value = objective(potential, s)
    for _ in range(most_steps if total_tokens else 0):
        gradient = [g - t + hold * x for g, t, x in zip(goal, now, s, strict=True)]
        if max(map(abs, gradient)) <= tolerance * total_tokens:
            break
        step = solved([[x + hold * (i == j) for j, x in enumerate(row)] for i, row in enumerate(gram)], gradient)
        slope, size = sum(x * y for x, y in zip(step, gradient, strict=True)), 1.0
        while True:
            further = [x - size * y for x, y in zip(s, step, strict=True)]
            potential, totals, at = looked(further)
            if objective(potential, further) <= value - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        s, now, gram, value = further, totals, at, objective(potential, further)
    off = [(t - g) / total_tokens if total_tokens else 0.0 for t, g in zip(now, goal, strict=True)]
    rate = F.greatest(F.lit(float(least_rate)), 1 + F.when(F.col("n_tokens") > 0, change(s)).otherwise(0.0))
    names = F.array(*map(F.lit, domains))
    rated = features.select("doc_id", "n_tokens", F.map_from_arrays(names, "p").alias("p"), rate.alias("rate"))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + draw)).withColumn("off_target", F.map_from_arrays(names, F.array(*map(F.lit, off))))


def repeated(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """The rows of docs, all columns, as often as their copies say."""
    # Rows of one doc_id: the same text has the same rate; of different texts the largest counts.
    copies = rated.groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    matched = docs.alias("d").join(copies.alias("c"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("c.doc_id")), "left")
    often = F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.__copies")))
    rows = matched.filter("c.__copies > 0").select(*(F.col(f"d.`{c}`") for c in docs.columns), often.alias("__copy"))
    return rows.drop("__copy")


def languages_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain (language and quality) of the labelled documents."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.select("doc_id", "lang").filter("lang IS NOT NULL").join(known, "doc_id").select("doc_id", F.concat_ws("/", "lang", F.when(F.col("quality") > 0, "good").otherwise("poor")).alias("domain"))


def production_targets(labelled: DataFrame, good: float = 1.5, poor: float = 0.5) -> dict[str, float]:
    """The domains' shares of the labelled documents, tilted towards good ones."""
    counts = labelled.filter("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n")).collect()  # one row for each domain
    return {r.domain: r.n * (good if r.domain.endswith("/good") else poor) for r in counts}
