"""Calibration: splits, fitted estimators, residual bounds, metrics and gates.

Everything over samples is an aggregate in bounded memory: sums, streamed digests
and exact quantiles by radix selection. The driver only solves systems
of at most 34 equations and picks among candidates.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counters import Artifact, calibrated
from ..functions.staging import staged, write_atomic
from ..functions.text import FEATURES
from .quantiles import nearest_ranks, sortable

RIDGE = 1e-6
#: Values of a split's first digest byte, in hundredths.
TRAIN, VALIDATION = 70, 85


def split_of(seed: str, group: Column) -> Column:
    """train, validation or blind-test, by the group's digest, so that a group never spans splits."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\x00"), group).cast("binary"), 256)
    at = F.call_function("div", F.conv(F.substring(digest, 1, 2), 16, 10).cast("long") * 100, F.lit(256).cast("long"))
    return F.when(at < TRAIN, "train").when(at < VALIDATION, "validation").otherwise("blind-test")


def sample_digest(content: Column, system: Column | None = None, tools: Column | None = None) -> Column:
    """Digest of a text, or of a structured request's parts apart by NULs."""
    if system is None and tools is None:
        return F.sha2(content.cast("binary"), 256)
    nul = F.lit("\x00")
    return F.sha2(F.concat(content, nul, F.coalesce(system, F.lit("")), nul, F.coalesce(tools, F.lit("null"))).cast("binary"), 256)


def check_manifest(samples: DataFrame) -> None:
    """Unique ids, a known split, and no group in two splits; errors name what is wrong."""
    if not samples.where("id IS NULL OR id = ''").isEmpty() or not samples.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("sample ids must be set and unique")
    if not samples.where(~F.coalesce(F.col("split").isin("train", "validation", "blind-test"), F.lit(False))).isEmpty():
        raise ValueError("a sample has an unknown split")
    if not samples.groupBy("grp").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a group spans splits")


def unlabelled(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples that a resumed labelling run still has to send out."""
    return samples.join(labels.select("id"), "id", "left_anti")


def adjusted(tokens: Column, baseline: Column) -> Column:
    """Counted tokens less those of an empty request, at least 0."""
    return F.greatest(F.lit(0).cast("long"), tokens - baseline)


def split_digests(rows: DataFrame) -> DataFrame:
    """Per split: digest of its sorted ``id:sha256:group`` lines.

    A digest is sequential, so a split is one task; its lines are sorted on disk and streamed.
    """
    line = F.concat_ws(":", "id", "sha256", "grp")

    def fold(batches):
        split, running = None, None
        for batch in batches:
            done = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if running is None or name != split:
                    if running is not None:
                        done.append((split, running.hexdigest()))
                    split, running = name, hashlib.sha256(text.encode())
                else:
                    running.update(b"\n" + text.encode())
            yield pa.RecordBatch.from_pylist([{"split": k, "digest": v} for k, v in done], schema=schema)
        if running is not None:
            yield pa.RecordBatch.from_pylist([{"split": split, "digest": running.hexdigest()}], schema=schema)

    schema = pa.schema([("split", pa.string()), ("digest", pa.string())])
    return rows.select("split", line.alias("line")).repartition("split").sortWithinPartitions("split", "line").mapInArrow(fold, "split string, digest string")


def maximums(train: DataFrame, names: list[str]) -> DataFrame:
    """(feature, maximum) of the training rows, where it is positive."""
    wide = train.agg(*[F.max(F.col(n).cast("double")).alias(n) for n in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("maximum")) for n in names])).alias("x")).select("x.*").where("maximum > 0")


def normal_equations(rows: DataFrame, names: list[str], y: str) -> DataFrame:
    """(i, j, value) of X'X and X'y with an intercept in front; j = number of names + 1 holds X'y."""
    one = [F.lit(1.0), *[F.col(n).cast("double") for n in names], F.col(y).cast("double")]
    n = len(one)
    pairs = [(i, j) for i in range(n - 1) for j in range(i, n)]
    sums = rows.agg(*[F.sum(one[i] * one[j]).alias(f"s{i}_{j}") for i, j in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("value")) for i, j in pairs])).alias("x")).select("x.*")


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan with partial pivots; None if a pivot is below 1e-12."""
    m = np.column_stack([a, b]).astype(float)
    for k in range(len(m)):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if abs(m[p, k]) < 1e-12:
            return None
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        others = np.arange(len(m)) != k
        m[others] -= np.outer(m[others, k], m[k])
    return m[:, -1]


def gram(rows: DataFrame, names: list[str], y: str) -> np.ndarray:
    """[X'X | X'y] with an intercept in front, from one pass over the rows."""
    n = len(names) + 1
    m = np.zeros((n, n + 1))
    for r in normal_equations(rows, names, y).collect():
        m[r["i"], r["j"]] = r["value"] or 0.0
        if r["j"] < n:
            m[r["j"], r["i"]] = r["value"] or 0.0
    return m


def fit_features(m: np.ndarray, names: list[str], own: list[str], ridge: float = 0.0) -> tuple[float, dict] | None:
    """Intercept and coefficients of some of a ``gram``'s features; the ridge leaves the intercept alone."""
    at = [0, *(names.index(n) + 1 for n in own)]
    x = solve(m[np.ix_(at, at)] + np.diag([0.0] + [ridge] * len(own)), m[at, -1])
    return None if x is None else (float(x[0]), dict(zip(own, map(float, x[1:]), strict=True)))


def fit_linear(rows: DataFrame, names: list[str], y: str, ridge: float = 0.0) -> tuple[float, dict] | None:
    """Intercept and coefficients by least squares."""
    return fit_features(gram(rows, names, y), names, names, ridge)


def candidates(train: DataFrame, names: list[str], y: str, base: Artifact) -> list[Artifact]:
    """A quarter of the characters, each single feature, least squares, ridge; singular fits are left out."""
    if unknown := [n for n in names if n not in FEATURES] or (len(set(names)) != len(names)) or not names:
        raise ValueError(f"feature names must be known, unique and some: {unknown}")
    out = [replace(base, version=f"{base.version}:characters", intercept=0.0, coefficients={"rune_count": 0.25})]
    tries = [(f"feature-{n}", [n], 0.0) for n in names] + [("ols", names, 0.0), ("ridge", names, RIDGE)]
    m = gram(train, names, y)
    for label, own, ridge in tries:
        if found := fit_features(m, names, own, ridge):
            out.append(replace(base, version=f"{base.version}:{label}", intercept=found[0], coefficients=found[1]))
    return out


def predicted(artifact: Artifact, features: dict[str, Column]) -> Column:
    """Point prediction: intercept plus terms in name order, at least 1, rounded half up."""
    value = F.lit(artifact.intercept)
    for n in FEATURES:
        if n in artifact.coefficients:
            value = value + F.lit(artifact.coefficients[n]) * features[n]
    return F.floor(F.greatest(F.lit(1.0), value) + F.lit(0.5)).cast("long")


def nearest_rank(rows: DataFrame, key: list[str], column: str, q: float, name: str) -> DataFrame:
    """(key, name): per key the value at place ceil(q n), exactly."""
    return nearest_ranks(rows, key, {name: (column, q)})


def residual_bounds(rows: DataFrame, y: str, p: str) -> DataFrame:
    """(low, high): the middle 95 per cent of (y - p) / p, clamped to contain 0."""
    r = rows.where(F.col(p) > 0).select(((F.col(y) - F.col(p)).cast("double") / F.col(p).cast("double")).alias("r"))
    r = staged(r.select(sortable(F.col("r")).alias("r")), "residuals")
    ends = nearest_ranks(r, [], {"low": ("r", 0.025), "high": ("r", 0.975)}, ready=True)
    return ends.select(F.least(F.lit(0.0), "low").alias("low"), F.greatest(F.lit(0.0), "high").alias("high"))


def _errors(rows: DataFrame, key: list[str], y: str, p: str, low: str, high: str) -> DataFrame:
    """What metrics are made of: keys, kind, grp, the relative error, and whether the bounds hold."""
    real = lambda c: F.col(c).cast("double")
    base = F.greatest(F.lit(1.0), real(y))
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
    return rows.select(*own, "kind", "grp", ((real(p) - real(y)) / base).alias("e"), (F.col(y).between(F.col(low), F.col(high))).alias("inside"), (F.col(y) > F.col(high)).alias("above"))


def macro_mape(rows: DataFrame, key: list[str], y: str = "y", p: str = "tokens") -> DataFrame:
    """Per key, the mean over kinds of the mean absolute relative error."""
    e = _errors(rows, key, y, p, p, p)
    own = [f"k{i}" for i in range(len(key))]
    m = e.groupBy(*own, "kind").agg(F.avg(F.abs("e")).alias("m")).groupBy(*own).agg(F.avg("m").alias("macro_mape"))
    return m.select(*[F.col(o).alias(k) for o, k in zip(own, key, strict=True)], "macro_mape")


def metrics(rows: DataFrame, key: list[str], y: str = "y", p: str = "tokens", low: str = "low", high: str = "high") -> DataFrame:
    """Error metrics per key: samples, groups, MAPE, macro-MAPE over kinds, p95, bias, coverage, share above high.

    ``rows`` is read once, for a staged table of errors. Sums by key, kind and
    group lead to all but p95, which is selected by radix; a key's two parts
    meet in an aggregate, so that null keys do too. Nothing is joined to rows
    but the digits of p95 found so far.
    """
    ape = F.abs("e")
    e = staged(_errors(rows, key, y, p, low, high).withColumn("size", sortable(ape)), "errors")
    own = [f"k{i}" for i in range(len(key))]
    total = lambda c: F.sum(c.cast("double"))
    sums = e.groupBy(*own, "kind", "grp").agg(F.count("*").alias("n"), F.sum(ape).alias("ape"), F.sum("e").alias("bias"), total(F.col("inside")).alias("inside"), total(F.col("above")).alias("above"), *[F.count(c).alias(f"n_{c}") for c in ("e", "inside", "above")])
    # a group may have several kinds: it is counted once for each key
    kinds = sums.groupBy(*own, "kind").agg((F.sum("ape") / F.sum("n_e")).alias("m")).groupBy(*own).agg(F.avg("m").alias("macro_mape"))
    ratio = lambda a, b, name: (F.sum(a) / F.sum(b)).alias(name)
    whole = sums.groupBy(*own).agg(
        F.sum("n").alias("samples"), F.count_distinct("grp").alias("groups"), ratio("ape", "n_e", "mape"), ratio("bias", "n_e", "bias"), ratio("inside", "n_inside", "coverage"), ratio("above", "n_above", "above_high"),
    )
    p95 = nearest_ranks(e.select(*own, "size"), own, {"p95": ("size", 0.95)}, ready=True)
    names = ("samples", "groups", "mape", "macro_mape", "p95", "bias", "coverage", "above_high")
    parts = whole.unionByName(kinds, allowMissingColumns=True).unionByName(p95, allowMissingColumns=True)
    out = parts.groupBy(*own).agg(*[F.max(n).alias(n) for n in names]).withColumn("samples", F.coalesce("samples", F.lit(0).cast("long")))
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, key, strict=True)], *names)


def with_improvement(own: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """Metrics with the baseline's macro-MAPE and the share by which they improve on it."""
    b = baseline.select(*key, F.col("macro_mape").alias("baseline_macro_mape"))
    rows = own.join(b, key) if key else own.crossJoin(b)
    gain = F.when(F.col("baseline_macro_mape") > 0, (F.col("baseline_macro_mape") - F.col("macro_mape")) / F.col("baseline_macro_mape")).otherwise(F.lit(0.0))
    return rows.withColumn("improvement", gain)


def select_candidate(scored: list[tuple[Artifact, dict]]) -> Artifact:
    """The first candidate within the error gates, else the one of least MAPE."""
    for a, m in scored:
        mape, p95 = (0.05, 0.15) if a.model_family == "legacy" else (0.08, 0.20)
        if m["mape"] <= mape and m["p95"] <= p95:
            return a
    return min(scored, key=lambda x: x[1]["mape"])[0]


def fit(rows: DataFrame, names: list[str], base: Artifact, features: dict[str, Column], heuristic: Column) -> tuple[Artifact, dict]:
    """Fit on train, choose and bound on validation; ``rows`` also has id, sha256, grp, kind, length_bucket, split and y.

    ``heuristic``: the uncalibrated COUNT column that improvements are measured against.
    """
    check_manifest(rows)
    train, validation = (rows.where(F.col("split") == s) for s in ("train", "validation"))
    tried = candidates(train, names, "y", base)
    # all candidates are scored in one pass
    each = F.explode(F.array(*[F.struct(F.lit(a.version).alias("version"), predicted(a, features).alias("tokens")) for a in tried]))
    p = validation.select("kind", "grp", "y", each.alias("p")).select("kind", "grp", "y", "p.*").withColumns({"low": F.col("tokens"), "high": F.col("tokens")})
    found = {r["version"]: r.asDict() for r in metrics(p, ["version"]).collect()}
    if not found:
        raise ValueError("the validation split has no samples")
    scored = [(a, found[a.version]) for a in tried]
    best = select_candidate(scored)
    bounds = residual_bounds(validation.withColumn("tokens", predicted(best, features)), "y", "tokens").first()
    most = {r["feature"]: r["maximum"] for r in maximums(train, [n for n in names]).collect()}
    digests = {r["split"]: r["digest"] for r in split_digests(rows).collect()}
    best = replace(best, relative_low=bounds["low"] or 0.0, relative_high=bounds["high"] or 0.0, ood_maximums=most, digests=digests)
    return best, {a.version: m for a, m in scored}


def evaluate(rows: DataFrame, artifact: Artifact, features: dict[str, Column], heuristic: Column, split: str = "blind-test", allow_blind: bool = False) -> dict:
    """Metrics of a split and of its strata (kind/length_bucket), with improvement; the blind test is opt-in."""
    if split == "blind-test" and not allow_blind:
        raise ValueError("the blind test is opened by allow_blind only")
    own = rows.where(F.col("split") == split)
    counted = own.withColumn("_c", calibrated(artifact, features)).withColumns({k: F.col(f"_c.{k}") for k in ("tokens", "low", "high")})
    base = own.withColumn("_c", heuristic).withColumns({k: F.col(f"_c.{k}") for k in ("tokens", "low", "high")})
    out = {}
    whole = with_improvement(metrics(counted, []), macro_mape(base, []), []).first()
    if whole is None or not whole["samples"]:
        raise ValueError(f"split {split} has no samples")
    out[split] = whole.asDict()
    stratum = lambda df: df.withColumn("stratum", F.concat_ws("/", "kind", "length_bucket"))
    for r in with_improvement(metrics(stratum(counted), ["stratum"]), macro_mape(stratum(base), ["stratum"]), ["stratum"]).collect():
        out[f"stratum:{r['stratum']}"] = r.asDict()
    return out


def verify_artifact(artifact: Artifact, again: dict, tolerance: float = 1e-12) -> None:
    """An artifact whose stored metrics a new evaluation does not reproduce is an error."""
    for name, m in artifact.metrics.items():
        for k, v in m.items():
            if isinstance(v, (int, float)) and (name not in again or abs(v - again[name][k]) > tolerance):
                raise ValueError(f"metric {name}.{k} is not reproduced")
    artifact.validate(require_accepted=True)


def collection_facts(labels: DataFrame) -> dict:
    """Pinned models, the one API version, and the latest date of labels; two versions are an error."""
    r = labels.agg(F.sort_array(F.collect_set("pinned_model")).alias("models"), F.collect_set("api_version").alias("versions"), F.max("collected_at").alias("latest")).first()
    if len(r["versions"]) > 1:
        raise ValueError("labels mix API versions")
    return {"models": r["models"], "api_version": next(iter(r["versions"]), ""), "latest": r["latest"]}


def to_json(artifact: Artifact) -> str:
    from dataclasses import asdict

    return json.dumps(asdict(artifact), indent=2, sort_keys=True, default=str) + "\n"


def from_json(text: str) -> Artifact:
    a = Artifact(**json.loads(text))
    a.validate()
    return a


def markdown_report(evaluations: dict) -> str:
    head = ("name", "samples", "mape", "macro_mape", "p95", "bias", "coverage", "above_high", "improvement")
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for name, m in sorted(evaluations.items()):
        lines.append("| " + " | ".join([name, str(m["samples"]), *[f"{m.get(k, 0) or 0:.4f}" for k in head[2:]]]) + " |")
    return "\n".join(lines) + "\n"


def write_reports(folder: str, artifact: Artifact, evaluations: dict) -> None:
    """The artifact as JSON and its evaluations as a table, each file whole or not at all."""
    write_atomic(os.path.join(folder, f"{artifact.version.replace(':', '-')}.json"), to_json(artifact))
    write_atomic(os.path.join(folder, f"{artifact.version.replace(':', '-')}.md"), markdown_report(evaluations))


def digest(*parts: bytes) -> str:
    return reduce(lambda h, p: (h.update(p), h)[1], parts, hashlib.sha256()).hexdigest()
