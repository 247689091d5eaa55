"""Assembling sources into requests and estimating each request on each model.

Heuristic counts are functions of sums over characters, so a request's count
over its joined texts, with and without the source wrapper, comes from ordinary
partial sums; calibrated counts come from boundary states, folded in the order
of sources, and byte-pair counts from parts cut at safe places. No text is
gathered for any of them. Only own counters assemble the strings, one bounded
request at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as boundary
from ..functions.counters import COUNT, FAMILIES, Counters, heuristic, no_tokens
from ..functions.money import cost_micros, tier_at
from ..functions.text import CLASSES, with_classes
from ..sources.catalog import stale_column
from . import bytepairs
from . import plan as planning
from .pricing import MODALITIES, at_level, level_costs, scenarios, with_rates

#: What the wrapper of one source adds, its label and a missing line feed aside.
WRAPPER = {"alnum": 17, "other": 8, "space": 3, "wide_space": 0, "non_ascii": 0, "bytes": 28}
# What a refused verification says, and the sentences of ``_warnings``, which readers match.
UNSENDABLE = "planned request contains unsupported media and cannot be sent as a partial verification"
#: (wrapper, runtime) tokens of the overhead profiles.
PROFILES = {"": (0, 0), "none": (0, 0), "chat": (7, 0), "codex": (12, 1_200)}
IMAGE, AUDIO = "struct<width:int,height:int,orientation:int,frames:int>", "struct<duration_ms:bigint,codec:string,sample_rate_hz:int,channels:int>"
DOCUMENT = f"struct<format:string,pages:int,page_meta:{planning.PAGE}>"


@dataclass(frozen=True)
class Options:
    """What an analysis is asked for; invalid values are errors at once."""

    profile: str | tuple = "none"
    bound: str = "expected"
    system: str = ""
    tools: str = ""
    cached_tokens: int = 0
    output_tokens: tuple = (1_000,)
    reasoning_tokens: int = 0
    processing: str = "native"
    image_detail: str = "auto"
    document_detail: str = "auto"
    overrides: tuple = ()
    now: dt.datetime | None = None
    require_verify: bool = False
    allow_file_upload: bool = False

    def __post_init__(self):
        if self.allow_file_upload and not self.require_verify:
            raise ValueError("files are only uploaded for a verification")
        if not self.profiles or not set(self.profiles) <= set(PROFILES) or len(set(self.profiles)) < len(self.profiles):
            raise ValueError(f"unknown profile {self.profile!r}")
        for name, allowed in (("bound", ("expected", "high")), ("processing", ("native", "normalized-text")), ("image_detail", ("auto", "low", "high", "original")), ("document_detail", ("auto", "low", "high", "original", "text"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}")
        if min(self.cached_tokens, self.reasoning_tokens, *self.output_tokens, 0) < 0 or not self.output_tokens:
            raise ValueError("token counts must not be negative, and one output is needed")
        for rule in self.overrides:
            planning.glob_regex(rule.glob)


    @property
    def profiles(self) -> tuple:
        """One profile, or several, by each of which every request is estimated."""
        return self.profile if isinstance(self.profile, tuple) else (self.profile,)


def text_sources(df: DataFrame, request: Column, label: Column, text: Column, kind: str = "file", keep: tuple = ()) -> DataFrame:
    """Sources from a table of texts: one per row, in the order of labels; columns to ``keep`` go along."""
    null = lambda t: F.lit(None).cast(t)
    text = F.coalesce(text, F.lit(""))
    return df.select(
        request.cast("string").alias("request_id"), label.cast("string").alias("label"), label.cast("string").alias("path"), F.lit(kind).alias("kind"),
        F.sha2(text.cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), F.lit("").alias("asset_id"), F.lit("").alias("mime"),
        text.alias("text"), null(IMAGE).alias("image"), null(AUDIO).alias("audio"), null(DOCUMENT).alias("document"), *keep,
    )


def countable(sources: DataFrame) -> DataFrame:
    """Sources with their class sums; images have no text."""
    return with_classes(sources.withColumn("text", F.when(F.col("kind") == "image", F.lit("")).otherwise(F.coalesce("text", F.lit("")))), "text")


#: What ``source_sums`` gives of each source, in the order of a request's sums.
PARTS = ("n_texts", "n_assets", "source_bytes", "has_media", "code", "invalid", *(f"{p}_{c}" for p in ("raw", "wrapped") for c in WRAPPER))


def source_sums(sources: DataFrame) -> DataFrame:
    """Per source: ``PARTS`` as longs, what it adds to its request's joined (``raw_*``) and wrapped (``wrapped_*``) texts, joints apart."""
    named = with_classes(sources.withColumn("_label", F.translate("label", '"', "'")), "_label", "label_")
    some = F.col("text_bytes") > 0
    open_end = (~F.endswith("text", F.lit("\n"))).cast("long")
    out = {"n_texts": some, "n_assets": F.col("asset_id") != "", "has_media": F.col("kind").isin("image", "audio", "document"), "invalid": ~F.is_valid_utf8("text"), "code": F.when(some, F.col("code"))}
    for c in WRAPPER:
        own = F.col("text_bytes") if c == "bytes" else F.col(c)
        added = F.lit(WRAPPER[c]).cast("long") + F.col(f"label_{c}") + (open_end if c in ("space", "bytes") else F.lit(0))
        out |= {f"raw_{c}": F.when(some, own), f"wrapped_{c}": F.when(some, own + added)}
    return named.withColumns({k: F.coalesce(c.cast("long"), F.lit(0).cast("long")) for k, c in out.items()})


def with_joints(sums: DataFrame) -> DataFrame:
    """Totals of ``PARTS`` with the line feeds between joined texts and the flags of a request."""
    joints = F.greatest(F.lit(0).cast("long"), F.col("n_texts") - 1)
    flags = {"has_media": F.col("has_media") > 0, "invalid": F.col("invalid") > 0, "raw_code": (F.col("code") > 0).cast("int"), "wrapped_code": (F.col("n_texts") > 0).cast("int")}
    return sums.withColumns({"raw_space": F.col("raw_space") + joints, "raw_bytes": F.col("raw_bytes") + joints} | flags).withColumnRenamed("source_bytes", "total_bytes").drop("code")


def request_sums(sources: DataFrame) -> DataFrame:
    """Per request: class sums of the joined texts (``raw_*``) and of the wrapped ones (``wrapped_*``)."""
    return with_joints(source_sums(sources).groupBy("request_id").agg(F.count("*").alias("n_sources"), *[F.sum(p).alias(p) for p in PARTS]))


def request_states(sources: DataFrame, features=boundary.COUNTERS) -> DataFrame:
    """Per request: boundary states of the joined texts (``raw_state``) and of the wrapped ones (``wrapped_state``).

    Sources are in the order (kind, label, digest of the text); only sums that ``features`` need are counted.
    """
    needed = boundary.needs(features)
    text = F.coalesce("text", F.lit(""))
    end = F.when(F.endswith(text, F.lit("\n")), F.lit("")).otherwise(F.lit("\n"))
    parts = F.array(F.lit('<source label="'), F.translate("label", '"', "'"), F.lit('">\n'), text, end, F.lit("</source>\n"))
    some = sources.where(F.octet_length("text") > 0).select("request_id", "kind", "label", F.sha2(text.cast("binary"), 256).alias("digest"), F.transform(parts, lambda t: boundary.state(t, needed)).alias("parts"))
    rows = some.withColumns({"raw_state": F.col("parts")[3], "wrapped_state": boundary.folded("parts")})
    order = ["kind", "label", "digest"]
    return boundary.folded_by(rows, ["request_id"], order, {"raw_state": "\n", "wrapped_state": ""}, needed)


def assembled(sources: DataFrame) -> DataFrame:
    """Per request: the texts joined by line feeds (``raw``) and each in its labelled wrapper (``wrapped``), by (kind, label, digest)."""
    some = sources.where(F.octet_length("text") > 0)
    wrapped = F.concat(F.lit('<source label="'), F.translate("label", '"', "'"), F.lit('">\n'), F.col("text"), F.when(F.endswith("text", F.lit("\n")), "").otherwise("\n"), F.lit("</source>\n"))
    # a text is one value of one row, so a request beyond the limit is an error before its texts are gathered
    size = some.groupBy("request_id").agg(F.sum(F.octet_length("text") + F.octet_length("label") + 32).alias("size"))
    error = F.raise_error(F.format_string("request %s is too long to be assembled", "request_id")).cast("boolean")
    some = some.join(size.select("request_id", F.when(F.col("size") > ASSEMBLED_BYTES, error).otherwise(F.lit(True)).alias("fits")), "request_id").where("fits")
    rows = some.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("kind", "label", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("text"), wrapped.alias("wrapped")))).alias("s"))
    return rows.select("request_id", F.array_join("s.text", "\n").alias("raw"), F.array_join("s.wrapped", "").alias("wrapped"))


#: Bytes of a request's joined text that are assembled at most, for counters that need the whole text.
ASSEMBLED_BYTES = 512 << 20


def _sums(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}_{c}") for c in CLASSES}


def _constant_count(counters: Counters, tokenizer: str, text: str) -> Column:
    """Count of one constant text, as an expression (its class sums are folded by Catalyst)."""
    if counters.stateful(tokenizer) and not text:
        return counters.of_nothing(tokenizer)
    if not counters.additive(tokenizer):
        return counters.of_text(tokenizer, F.lit(text))
    if not text:
        return no_tokens(FAMILIES[tokenizer])
    import re

    from ..functions.text import KEYWORDS

    alnum = len(re.findall("[A-Za-z0-9_]", text))
    space = len(re.findall("[\t-\r ]", text))
    wide = len(re.findall("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", text))
    outside = sum(ord(x) > 127 for x in text)
    code = bool(re.search(r"[{}\[\]();:=<>]|(?<![A-Za-z0-9_])(?:" + "|".join(KEYWORDS) + ")(?![A-Za-z0-9_])", text))
    values = {"alnum": alnum, "space": space, "wide_space": wide, "non_ascii": outside, "other": len(text) - alnum - space - outside, "bytes": len(text.encode()), "code": int(code)}
    return heuristic(FAMILIES[tokenizer], {k: F.lit(v).cast("long") for k, v in values.items()})


class Results:
    """What an analysis yields; every part is lazy, and the planned parts are built when asked for."""

    def __init__(self, models: DataFrame, scenarios: DataFrame, plan: Callable[[], DataFrame], both: DataFrame):
        self.models, self.scenarios, self._plan = models, scenarios, plan
        #: Scenarios with the columns of their model, from one pass over the sources.
        self.both = both

    def check_verified(self) -> Results:
        """An error where a verification was required and failed or is missing."""
        failed = self.models.where("verify_failed").select("request_id", "model").take(1)
        if failed:
            raise ValueError(f"request {failed[0][0]!r} is not verified on {failed[0][1]}")
        return self

    @cached_property
    def plan(self) -> DataFrame:
        """A row per source and model: status, warnings, provider part."""
        return self._plan()

    @cached_property
    def components(self) -> DataFrame:
        return planning.components(self.plan)

    @cached_property
    def sources(self) -> DataFrame:
        return planning.source_totals(self.components)


def part_columns(levels: int) -> list[str]:
    """What ``part_totals`` says of a request's components."""
    return ["status", "part_tokens", "part_low", "part_high", "part_confidence", "parts_cached_n", *[f"parts_{x}_{k}" for k in range(levels) for x in ("input", "cached")]]


def part_totals(plan: DataFrame, sums: tuple, prices: DataFrame, levels: int, bound: str, cached: int) -> DataFrame:
    """Per request and model: totals of ``part_columns``, the number of sources and, of the columns ``sums``, sums over sources.

    Cached tokens are used up in the order of components. A decision is never
    below the components' sum, so a request that has fewer tokens than are
    cached takes all its components from the cache either way, and what is taken
    needs no total. The costs at each level are summed, and the total chooses.
    """
    c, key = F.col, ["request_id", "model"]
    first = F.coalesce("part_no", F.lit(0)) == 0
    rows = planning.components(plan, ("status", *sums), every=True)
    prices = F.broadcast(prices)
    costs = {f"parts_{x}_{k}": f"{x}_{k}" for k in range(levels) for x in ("input", "cached")} | {"parts_cached_n": "cached_n"}
    costs = [F.sum(x).alias(k) for k, x in costs.items()]
    if not cached:
        rows = level_costs(rows.join(prices, "model"), bound, F.lit(0).cast("long"), levels)
    totals = rows.groupBy(*key).agg(
        F.sum(first.cast("long")).alias("n_sources"), *[F.sum(F.when(first, c(p))).alias(p) for p in sums], planning.worst_status(c("status")).alias("status"),
        F.sum("expected").alias("part_tokens"), F.sum("low").alias("part_low"), F.sum("high").alias("part_high"), F.min("confidence").alias("part_confidence"), *([] if cached else costs),
    )
    if not cached:
        return totals
    parts = planning.components(plan).select(*key, "ordinal", "part_no", "modality", bound)
    before = F.coalesce(F.sum(bound).over(Window.partitionBy(*key).orderBy("ordinal", "part_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    left = F.least(c(bound), F.greatest(F.lit(0).cast("long"), F.lit(cached).cast("long") - c("_before")))
    spent = level_costs(parts.withColumn("_before", before).join(prices, "model"), bound, left, levels).groupBy(*key).agg(*costs)
    return totals.join(spent, key, "left")


def analyze(sources: DataFrame, models: DataFrame, options: Options = Options(), counters: Counters | None = None, extras: DataFrame | None = None, verified: DataFrame | None = None, with_media: bool = True) -> Results:
    """Estimate every request of ``sources`` on every model.

    ``extras`` (request_id, system, tools) gives requests their own system and
    tool texts; ``verified`` (request_id, model, tokens, method, error) holds
    counts from an external verifier, which then decide. Where the caller knows
    that there are only texts, ``with_media=False`` leaves the join with planned
    components out of the results.
    """
    counters = counters or Counters()
    c, zero = F.col, F.lit(0).cast("long")
    rated = with_rates(models)
    known = rated.select("tokenizer", F.size("levels").alias("n")).distinct().collect()  # of a catalog: a few
    tokenizers, levels = list(dict.fromkeys(r["tokenizer"] for r in known)), max((r["n"] for r in known), default=0)
    base = countable(sources.withColumnRenamed("bytes", "source_bytes")).withColumnRenamed("bytes", "text_bytes")

    def plan_sources(summed: DataFrame) -> DataFrame:
        """Components of requests with media; text-only requests count their joined text instead."""
        by_tokenizer = F.map_from_entries(F.array(*[F.struct(F.lit(t), (counters.of_sums(t, {k: c("text_bytes" if k == "bytes" else k) for k in CLASSES}, ~F.is_valid_utf8("text")) if counters.additive(t) else counters.of_text(t, c("text"))).cast(COUNT)) for t in tokenizers]))
        ordered = summed.withColumn("ordinal", F.struct("kind", "label")).withColumn("counts", by_tokenizer)
        return planning.planned(ordered, models, options.processing, options.image_detail, options.document_detail, options.overrides)

    # where all counts follow from sums, a request's sums are taken on each model together with its components, in one pass
    by_model = with_media and all(counters.additive(t) for t in tokenizers)
    bound = "high" if options.bound == "high" else "expected"
    key = ["request_id", "model"]
    if with_media:
        prices = rated.select(c("id").alias("model"), *[f"{x}_rates" for x in MODALITIES])
        totals = part_totals(plan_sources(source_sums(base) if by_model else base), PARTS if by_model else (), prices, levels, bound, options.cached_tokens)
    sums = with_joints(totals) if by_model else request_sums(base)
    if extras is not None:
        extras = with_classes(with_classes(extras.select("request_id", F.coalesce("system", F.lit("")).alias("system"), F.coalesce("tools", F.lit("")).alias("tools")), "system", "system_"), "tools", "tools_")
        sums = sums.join(extras, "request_id", "left").na.fill(0, [f"{p}_{k}" for p in ("system", "tools") for k in CLASSES])
    by_state = [t for t in tokenizers if counters.stateful(t)]
    if by_state:
        sums = sums.join(request_states(base, counters.needed(by_state)), "request_id", "left")
        sums = sums.withColumns({k: F.coalesce(k, boundary.empty()) for k in ("raw_state", "wrapped_state")})
    by_pairs = [t for t in tokenizers if counters.paired(t)]
    for i, t in enumerate(by_pairs):
        n = bytepairs.request_counts(base, counters.vocabularies[t])
        sums = sums.join(n.select("request_id", *[c(w).alias(f"{w}_pairs_{i}") for w in ("raw", "wrapped")]), "request_id", "left").na.fill(0, [f"{w}_pairs_{i}" for w in ("raw", "wrapped")])
    if any(not counters.additive(t) and t not in (*by_state, *by_pairs) for t in tokenizers):
        sums = sums.join(assembled(base), "request_id", "left").na.fill("", ["raw", "wrapped"])

    def of(tokenizer: str, what: str) -> Column:
        if what in ("system", "tools"):
            if extras is None:
                return _constant_count(counters, tokenizer, getattr(options, what))
            return counters.of_sums(tokenizer, _sums(what)) if counters.additive(tokenizer) else counters.of_text(tokenizer, F.coalesce(c(what), F.lit("")))
        if counters.additive(tokenizer):
            return counters.of_sums(tokenizer, _sums(what), c("invalid"))
        if tokenizer in by_pairs:
            return counters.of_pairs(tokenizer, c(f"{what}_pairs_{by_pairs.index(tokenizer)}"))
        if tokenizer in by_state:
            return counters.of_counters(tokenizer, boundary.counters(c(f"{what}_state")), c("invalid"))
        return counters.of_text(tokenizer, c(what))

    kinds = ("raw", "wrapped", "system", "tools")
    counts = F.array(*[F.struct(F.lit(t).alias("tokenizer"), *[of(t, k).cast(COUNT).alias(f"{k}_count") for k in kinds]) for t in tokenizers])
    m = rated.select(c("id").alias("model"), "ordinal", "provider", "tokenizer", "context_window", "max_output", "pricing_date", "pricing_expires", "tiers", "modality_tiers", "max_assets", "max_inline_bytes", "levels")
    own_sums = ["n_sources", "total_bytes", "has_media", "n_assets"]
    if by_model:
        rows = sums.join(F.broadcast(m), "model").withColumn("x", F.filter(counts, lambda x: x["tokenizer"] == c("tokenizer"))[0])
        rows = rows.select("request_id", *own_sums, *m.columns, *[f"x.{k}_count" for k in kinds], *part_columns(levels))
    else:
        per = sums.select("request_id", *own_sums, F.explode(counts).alias("x")).select("request_id", *own_sums, "x.*")
        rows = per.join(F.broadcast(m), "tokenizer")
        if with_media:
            rows = rows.join(totals.select(*key, *part_columns(levels)), key, "left")
        else:
            none = dict.fromkeys(part_columns(0), "long") | {"status": "string", "part_confidence": "double"}
            rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    if with_media:
        said = plan_sources(base).groupBy(*key).agg(F.flatten(F.collect_list("warnings")).alias("plan_warnings"))
        rows = rows.join(said, key, "left")
    else:
        rows = rows.withColumn("plan_warnings", F.lit(None).cast("array<string>"))

    profiles = [F.struct(F.lit(p).alias("profile"), *[F.lit(n).cast("long").alias(k) for k, n in zip(("wrapper", "runtime"), PROFILES[p], strict=True)]) for p in options.profiles]
    rows = rows.withColumn("p", F.explode(F.array(*profiles))).select("*", "p.*").drop("p")
    rows = rows.withColumns({
        "wrapper_tokens": F.greatest(zero, c("wrapped_count.tokens") - c("raw_count.tokens")) + c("wrapper"),
        "wrapper_low": F.greatest(zero, c("wrapped_count.low") - c("raw_count.high")), "wrapper_high": F.greatest(zero, c("wrapped_count.high") - c("raw_count.low")),
        "system_tokens": c("system_count.tokens"), "tool_tokens": c("tools_count.tokens"), "runtime_tokens": c("runtime"),
    })
    over_assets = (c("max_assets") > 0) & (c("n_assets") > c("max_assets"))
    media = c("has_media")
    pick = lambda part, raw: F.when(media, F.coalesce(c(part), zero)).otherwise(c(f"raw_count.{raw}"))
    overhead = c("system_tokens") + c("tool_tokens") + c("wrapper_tokens") + c("runtime_tokens")
    profile = c("wrapper") + c("runtime")
    rows = rows.withColumns({
        "overhead_tokens": overhead,
        "overhead_high": c("system_count.high") + c("tools_count.high") + c("wrapper_high") + profile,
        "overhead_low": c("system_count.low") + c("tools_count.low") + c("wrapper_low") + profile,
        "status": F.when(over_assets, "unsupported").otherwise(F.coalesce("status", F.lit("supported"))),
    })
    rows = rows.withColumns({
        "input_tokens": pick("part_tokens", "tokens") + c("overhead_tokens"), "input_low": pick("part_low", "low") + c("overhead_low"), "input_high": pick("part_high", "high") + c("overhead_high"),
        "confidence": F.when(media, F.coalesce("part_confidence", F.lit(0.0))).otherwise(c("raw_count.confidence")),
    })
    if verified is not None:
        v = verified.select("request_id", "model", c("tokens").alias("v_tokens"), c("method").alias("v_method"), c("error").alias("v_error"))
        rows = rows.join(v, ["request_id", "model"], "left")
    else:
        rows = rows.withColumns({"v_tokens": F.lit(None).cast("long"), "v_method": F.lit(None).cast("string"), "v_error": F.lit(None).cast("string")})
    # a plan with a part that cannot be sent is never verified by what is left of it
    refused = c("status") == "unsupported"
    asked = F.lit(verified is not None or options.require_verify)
    rows = rows.withColumn("v_error", F.when(asked & refused, F.lit(UNSENDABLE)).otherwise(c("v_error")))
    good = F.coalesce((c("v_method") != "") & (F.coalesce("v_error", F.lit("")) == ""), F.lit(False))
    decision = F.when(good, c("v_tokens")).when(F.lit(options.bound == "high"), c("input_high")).otherwise(c("input_tokens"))
    rows = rows.withColumns({"verified": good, "decision_tokens": decision})
    rows = rows.withColumns({
        "cached_tokens": F.least(F.lit(options.cached_tokens).cast("long"), c("decision_tokens")), "utilization": c("input_tokens").cast("double") / c("context_window").cast("double"),
        "overflow": F.greatest(zero, c("decision_tokens") - c("context_window")), "incomplete": c("status") != "supported",
        "verify_failed": F.lit(options.require_verify) & ~good, "bound": F.lit(options.bound), "formula_version": c("raw_count.formula_version"),
    })
    rows = rows.withColumn("stale", stale_column(options.now) if options.now else F.lit(False))

    # requests with media price their components at the tiers of their modalities, then the overhead at the text rate
    of_parts = (lambda x: at_level(f"parts_{x}", levels, c("decision_tokens"))) if with_media else lambda x: F.lit(None).cast("long")
    rows = rows.withColumns({"parts_input": of_parts("input"), "parts_cached": of_parts("cached")})
    extra = F.when(F.lit(options.bound == "high"), c("overhead_high")).otherwise(c("overhead_tokens"))
    rest = F.least(extra, F.greatest(zero, c("cached_tokens") - F.coalesce("parts_cached_n", zero)))
    text_tier = tier_at(F.coalesce(F.try_element_at("modality_tiers", F.lit("text")), c("tiers")), c("decision_tokens"))
    own = media & ~c("verified")
    rows = rows.withColumns({"_tier": text_tier, "_extra": extra, "_rest": rest})
    rows = rows.withColumns({
        "component_input": F.when(own, F.coalesce("parts_input", zero) + cost_micros(c("_tier.input"), c("_extra") - c("_rest"))),
        "component_cached": F.when(own, F.coalesce("parts_cached", zero) + cost_micros(c("_tier.cached"), c("_rest"))),
    })
    rows = rows.withColumn("warnings", _warnings(over_assets))
    priced_rows = scenarios(rows, list(options.output_tokens), options.reasoning_tokens)
    columns = [
        "request_id", "model", "provider", "tokenizer", "n_sources", "total_bytes", "status", "input_tokens", "input_low", "input_high", "bound", "decision_tokens", "cached_tokens", "system_tokens", "tool_tokens",
        "wrapper_tokens", "runtime_tokens", "overhead_tokens", "context_window", "utilization", "overflow", "confidence", "formula_version", "pricing_date", "stale", "incomplete", "verified", "verify_failed",
        "warnings",
    ]
    several = ["profile"] if len(options.profiles) > 1 else []
    keep = several + ["request_id", "model", "scenario", "scenario_no", "decision_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "input_micros", "cached_micros", "output_micros", "reasoning_micros", "cost_micros", "over_output"]
    return Results(rows.select(*several, *columns), priced_rows.select(*keep), lambda: plan_sources(base), priced_rows.select(*several, *dict.fromkeys([*columns, *keep])))


def _warnings(over_assets: Column) -> Column:
    c = F.col
    said = [
        F.when(over_assets, F.concat(F.lit("request has "), c("n_assets").cast("string"), F.lit(" media assets; model limit is "), c("max_assets").cast("string"))),
        F.when(c("profile").isin("", "none"), F.lit("system, tool, and agent-runtime overhead default to zero unless explicitly supplied")),
        F.when(c("stale"), F.lit("catalog pricing is stale or past its validity window")),
        F.when(F.coalesce(c("v_error"), F.lit("")) != "", F.concat(F.lit("verification failed: "), c("v_error"))),
        F.when(c("verified") & (c("v_tokens") != c("input_tokens")), F.concat(F.lit("official aggregate differs from local estimate by "), F.format_string("%+d", c("v_tokens") - c("input_tokens")), F.lit(" tokens"))),
        F.when(c("overflow") > 0, F.concat(F.when(c("verified"), F.lit("officially verified")).otherwise(F.concat(c("bound"), F.lit("-bound"))), F.lit(" input exceeds context window by "), c("overflow").cast("string"), F.lit(" tokens"))),
    ]
    return F.array_distinct(F.concat(F.coalesce(c("plan_warnings"), F.array().cast("array<string>")), F.array_compact(F.array(*said))))


def top_sources(totals: DataFrame, k: int = 5) -> DataFrame:
    """The k sources of each request and model with most tokens; ties keep (kind, label) order."""
    w = Window.partitionBy("request_id", "model").orderBy(F.col("tokens").desc(), "ordinal")
    return totals.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
