"""Request planning: what each source costs on each model, by modality.

``sources`` has a row per countable input: request_id, ordinal (order within
the request), label, path, kind, sha256, bytes, asset_id, mime, text (countable
text, null for images), counts (map of tokenizer to count), image struct(width,
height), audio struct(duration_ms), document struct(format, pages, page_meta).
Models are a bounded, broadcast dimension.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import audio_tokens, page_pixels, with_image_rule, with_image_tokens
from ..sources.catalog import VERSION

# What a plan says of parts that a model cannot take or takes otherwise.
SAYS = {
    "image_text": "image normalized-text needs a supplied description",
    "image": "model does not support image input",
    "transcript": "normalized audio needs a transcript",
    "extraction": "document text extraction is unavailable",
    "pdf": "model does not support native PDF input",
    "embedded": "embedded text extraction is unavailable",
    "audio": "model does not support native audio input",
    "counter": "no counter for the model's tokenizer",
    "rich": "provider rich-document transformation is modeled as extracted text; embedded images/charts are ignored",
    "was_unavailable": "embedded text extraction was unavailable",
}

#: Order of capability states; the worst of a request's sources is the request's.
STATUS = ("supported", "conditional", "unknown", "unsupported")
PAGE = "array<struct<number:int,width_points:double,height_points:double,classification:string>>"


@dataclass(frozen=True)
class Override:
    """Processing or detail for sources whose path matches an ordered glob."""

    glob: str
    processing: str = ""
    image_detail: str = ""
    document_detail: str = ""


def glob_regex(glob: str) -> str:
    """Anchored Java/Python regular expression of a glob with ``**``; an empty glob is an error."""
    if not glob:
        raise ValueError("glob is empty")
    out, at, glob = "", 0, glob.replace("\\", "/")
    while at < len(glob):
        for token, pattern in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(token, at):
                out, at = out + pattern, at + len(token)
                break
        else:
            out, at = out + re.escape(glob[at]), at + 1
    return f"^{out}$"


def overridden(path: Column, default: str, field: str, rules: tuple[Override, ...]) -> Column:
    """Fold in order: each matching rule that sets the field replaces what came before."""
    value = F.lit(default)
    path = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    for rule in rules:
        pattern = glob_regex(rule.glob)
        if new := getattr(rule, field):
            value = F.when(path.rlike(pattern), F.lit(new)).otherwise(value)
    return value


def worst_status(status: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS]), status)
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.coalesce(F.max(rank), F.lit(1)).cast("int"))


def _part(kind: str, method: Column, w=None, h=None, number=None, low_zero=None, confidence=None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(kind).alias("modality"), method.alias("method"), (w if w is not None else null("long")).alias("w"), (h if h is not None else null("long")).alias("h"),
        (number if number is not None else null("int")).alias("page"), (low_zero if low_zero is not None else F.lit(False)).alias("low_zero"),
        (confidence if confidence is not None else F.lit(1.0)).alias("confidence"),
    )


_PARTS = "array<struct<modality:string,method:string,w:bigint,h:bigint,page:int,low_zero:boolean,confidence:double>>"


def _page(i: Column) -> Column:
    meta = F.try_element_at("document.page_meta", i)
    unknown = F.coalesce(meta["classification"] == "unknown", F.lit(False))
    known = F.coalesce(meta["width_points"] > 0, F.lit(False))
    w = F.when(known, page_pixels(meta["width_points"], 1275)).otherwise(F.lit(1275).cast("long"))
    h = F.when(known, F.ceil(meta["height_points"] * F.lit(150.0) / F.lit(72.0)).cast("long")).otherwise(F.lit(1650).cast("long"))
    return _part("image", F.lit("published image formula"), w, h, i, unknown, F.when(unknown, F.lit(0.65)).otherwise(F.lit(1.0)))


def planned(sources: DataFrame, models: DataFrame, processing: str = "native", image_detail: str = "auto", document_detail: str = "auto", overrides: tuple[Override, ...] = ()) -> DataFrame:
    """A row per source and model: status, warnings, provider part, and the components array."""
    s = sources.withColumns({
        "processing": overridden(F.col("path"), processing, "processing", overrides),
        "image_detail": overridden(F.col("path"), image_detail, "image_detail", overrides),
        "document_detail": overridden(F.col("path"), document_detail, "document_detail", overrides),
        # the same on each model
        "_pages": F.when(F.col("document.pages") > 0, F.transform(F.sequence(F.lit(1), F.col("document.pages")), _page)).otherwise(F.array().cast(_PARTS)),
    })
    m = models.select(F.col("id").alias("model"), F.col("ordinal").alias("model_ordinal"), "tokenizer", "modalities", "mimes", "max_assets", F.col("image").alias("image_rule"), "audio_tokens_per_second", "audio_formula", "document_formula")
    sm = s.crossJoin(F.broadcast(m))
    c = F.col
    count = F.try_element_at("counts", "tokenizer")
    accepts = F.array_contains("mimes", c("mime"))
    can = lambda what: F.array_contains("modalities", F.lit(what)) | ((F.size("modalities") == 0) & F.lit(what == "text"))
    has_text = F.octet_length(F.coalesce("text", F.lit(""))) > 0
    native, normal = c("processing") == "native", c("processing") == "normalized-text"
    pdf = c("document.format") == "pdf"
    refuse = F.concat(F.lit("model does not accept "), F.coalesce("mime", F.lit("")))
    problem = (
        F.when((c("kind") == "image") & ~accepts, refuse)
        .when((c("kind") == "image") & normal, F.lit(SAYS["image_text"]))
        .when((c("kind") == "image") & (~can("image") | c("image_rule").isNull()), F.lit(SAYS["image"]))
        .when((c("kind") == "audio") & native & ~accepts, refuse)
        .when((c("kind") == "audio") & normal & ~has_text, F.lit(SAYS["transcript"]))
        .when((c("kind") == "document") & native & ~accepts, refuse)
        .when((c("kind") == "document") & (~pdf | normal) & ~has_text, F.lit(SAYS["extraction"]))
        .when((c("kind") == "document") & pdf & ~normal & ~can("document"), F.lit(SAYS["pdf"]))
        .when((c("kind") == "document") & pdf & ~normal & ~has_text & (c("document_detail") == "text"), F.lit(SAYS["embedded"]))
    )
    # audio that a model cannot hear still counts a transcript that comes with it
    deaf = (c("kind") == "audio") & native & (~can("audio") | (c("audio_formula") == ""))
    sm = sm.withColumns({"count": count, "problem": problem, "deaf": deaf & problem.isNull()})
    native_pdf = (c("kind") == "document") & pdf & ~normal
    rich = (c("kind") == "document") & ~pdf & native
    textual = ~c("kind").isin("image", "audio", "document")
    why = (
        F.when(textual, F.lit("local tokenizer")).when(c("kind") == "audio", F.lit("transcript"))
        .when(native_pdf, F.lit("PDF extracted text")).otherwise(F.lit("normalized document text"))
    )
    some_text = textual | ((c("kind") != "image") & has_text)
    text_part = F.when(some_text & c("count").isNotNull(), F.array(_part("text", F.concat(why, F.lit(" / "), c("count.method"))))).otherwise(F.array())
    image_part = F.when(c("kind") == "image", F.array(_part("image", F.lit("published image formula"), c("image.width").cast("long"), c("image.height").cast("long")))).otherwise(F.array())
    audio_part = F.when((c("kind") == "audio") & native & ~c("deaf"), F.array(_part("audio", F.lit("published duration formula")))).otherwise(F.array())
    page_parts = F.when(native_pdf & (c("document_detail") != "text"), c("_pages")).otherwise(F.array())
    kind = _PARTS
    parts = F.concat(image_part.cast(kind), audio_part.cast(kind), text_part.cast(kind), page_parts.cast(kind))
    parts = F.when(c("problem").isNotNull(), F.array().cast(kind)).otherwise(parts)
    no_count = some_text & c("count").isNull()
    no_embedded = native_pdf & ~has_text & (c("document_detail") != "text")
    status = (
        F.when(c("problem").isNotNull() | c("deaf"), "unsupported").when(no_count, "unknown").when(rich | no_embedded, "conditional").otherwise("supported")
    )
    said = lambda when, text: F.when(when, F.concat(c("label"), F.lit(": "), text))
    warnings = F.array_compact(F.array(
        said(c("problem").isNotNull(), c("problem")), said(c("deaf"), F.lit(SAYS["audio"])), said(no_count & c("problem").isNull(), F.lit(SAYS["counter"])),
        said(rich & c("problem").isNull(), F.lit(SAYS["rich"])),
        said(no_embedded & c("problem").isNull(), F.lit(SAYS["was_unavailable"])),
    ))
    provider = (
        F.when(c("problem").isNotNull() | (c("deaf") & ~has_text), "unsupported").when(textual | ((c("kind") == "document") & ~native_pdf) | (native_pdf & (c("document_detail") == "text")) | c("deaf") | ((c("kind") == "audio") & normal), "text").otherwise(c("kind"))
    )
    detail = F.when(c("kind") == "image", c("image_detail")).when(c("kind") == "document", F.when(c("document_detail") == "text", "low").otherwise(c("document_detail")))
    return sm.withColumns({"status": status, "warnings": warnings, "provider_type": provider, "parts": parts, "detail": detail}).drop("_pages")


def components(plan: DataFrame, keep: tuple = (), every: bool = False) -> DataFrame:
    """A row per component of a planned source: token bounds, method, confidence, planned size.

    Columns to ``keep`` go along; with ``every``, a source without components has a row of its own, whose part_no is null.
    """
    c = F.col
    plan = with_image_rule(plan, "image_count", c("image_rule"), c("detail"))
    limits = [n for n in plan.columns if n.startswith("_image_count_")]
    # with the outer form no filter by the size of the parts, all their expressions in it, is inferred for the join with the models
    rows = plan.select(
        "request_id", "model", "tokenizer", "ordinal", "label", "asset_id", "processing", "detail", "count", c("audio.duration_ms").alias("duration_ms"), "audio_tokens_per_second", "audio_formula", "document_formula",
        c("image_rule.formula_version").alias("image_formula"), c("image_rule.multiplier").alias("image_multiplier"), *limits, *[c(k).alias(f"_kept_{k}") for k in keep],
        F.posexplode_outer("parts").alias("part_no", "part"),
    )
    rows = rows if every else rows.where(c("part").isNotNull())
    image = c("part.modality") == "image"
    rows = with_image_tokens(rows, "image_count", F.when(image, c("part.w")), F.when(image, c("part.h")))
    audio = F.when(c("part.modality") == "audio", audio_tokens(c("duration_ms"), c("audio_tokens_per_second")))
    text = c("part.modality") == "text"
    expected = F.when(text, c("count.tokens")).otherwise(F.coalesce("image_count.tokens", audio))
    formula = (
        F.when(text, F.when(c("count.formula_version") == "", F.concat(F.lit(f"{VERSION}:"), c("tokenizer"))).otherwise(c("count.formula_version")))
        .when(image, F.concat(F.when(c("part.page").isNotNull(), F.concat("document_formula", F.lit("+"))).otherwise(""), "image_formula")).otherwise(c("audio_formula"))
    )
    return rows.select(
        "request_id", "model", "ordinal", "part_no", F.when(c("part.page").isNotNull(), F.concat(c("label"), F.lit(" page "), c("part.page").cast("string"))).otherwise(c("label")).alias("source"),
        c("label").alias("of"), "asset_id", c("part.modality").alias("modality"), F.lit("tokens").alias("unit"),
        F.when(text, c("count.low")).when(c("part.low_zero"), F.lit(0).cast("long")).otherwise(expected).alias("low"), expected.alias("expected"), F.when(text, c("count.high")).otherwise(expected).alias("high"),
        c("part.method").alias("method"), F.when(text, c("count.confidence")).otherwise(c("part.confidence")).alias("confidence"), formula.alias("formula_version"),
        F.when(text, F.lit("normalized-text")).otherwise(c("processing")).alias("processing"), F.when(~text, c("detail")).alias("detail"),
        c("image_count.planned_w"), c("image_count.planned_h"), c("image_count.patches"), c("image_count.tiles"), F.when(image, c("image_multiplier")).alias("multiplier"),
        *[c(f"_kept_{k}").alias(k) for k in keep],
    )


def source_totals(comps: DataFrame) -> DataFrame:
    """Per source and model: summed bounds, least confidence, one formula or ``mixed``."""
    one = F.when(F.min("formula_version") == F.max("formula_version"), F.min("formula_version")).otherwise(F.lit("mixed"))
    tokens = comps.where("unit = 'tokens'")
    return tokens.groupBy("request_id", "model", "ordinal", F.col("of").alias("label")).agg(
        F.sum("expected").alias("tokens"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.min("confidence").alias("confidence"), one.alias("formula_version"))
