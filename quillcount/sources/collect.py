"""Collecting sources from files: listing, ignore rules, predicates, limits, transcripts.

Listing is a driver-side walk of paths (names only) or Spark's ``binaryFile``
scan; bytes are read and judged on executors. Limits depend on the order of
paths: whether a file is taken depends on which ones before it were, so they
are a fold per request, not a running sum.
"""

from __future__ import annotations

import glob as globbing
import os
import re
import subprocess
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..functions.text import is_binary, is_generated, normalized

SKIPPED = (".git", "node_modules", "vendor", "dist", "build", "coverage", ".next", ".cache")
IGNORE_FILES = (".gitignore", ".quillignore")
_SPECIAL = re.compile(r"[*?\[]")


@dataclass(frozen=True)
class Limits:
    """Bytes per text file, in all and per medium; media, pages and milliseconds at most."""

    file: int = 5 << 20
    total: int = 100 << 20
    media: int = 50 << 20
    media_count: int = 100
    pages: int = 600
    duration_ms: int = 4 * 3_600_000


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negated: bool


def ignore_regex(pattern: str) -> str:
    """A root ignore file's pattern: a leading slash anchors, a trailing one covers a directory's content."""
    anchored = pattern.startswith("/")
    body = pattern.removeprefix("/")
    below = body.endswith("/")
    parts = re.split(r"(\*\*|\*|\?)", body.removesuffix("/"))
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return ("^" if anchored else "^(?:.*/)?") + "".join(wild.get(p) or re.escape(p) for p in parts) + ("(?:/.*)?" if below else "") + "$"


def ignore_rules(*texts: str) -> list[IgnoreRule]:
    """Rules of ignore files' texts in order; blank lines and comments aside."""
    lines = [x.strip() for t in texts for x in t.splitlines()]
    return [IgnoreRule(ignore_regex(x.removeprefix("!")), x.startswith("!")) for x in lines if x and not x.startswith("#")]


def ignored(path: str, rules: list[IgnoreRule]) -> bool:
    """The last matching rule decides."""
    return next((not r.negated for r in reversed(rules) if re.search(r.pattern, path)), False)


def ignored_column(path: Column, rules: list[IgnoreRule]) -> Column:
    """The same natively, with every directory above tested as ``dir/``: a pruned directory keeps its files out."""
    def last(p: Column) -> Column:
        out = F.lit(False)
        for r in rules:
            out = F.when(p.rlike(r.pattern), F.lit(not r.negated)).otherwise(out)
        return out

    pieces = F.split(path, "/")
    above = F.transform(F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.concat(F.array_join(F.slice(pieces, F.lit(1), n), "/"), F.lit("/")))
    return last(path) | F.exists(above, last)


def skipped_directory(path: Column, include_hidden: bool = False) -> Column:
    """Whether a path lies under a directory that walks never enter."""
    above = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    named = F.exists(above, lambda p: p.isin(*SKIPPED))
    return named if include_hidden else named | F.exists(above, lambda p: F.startswith(p, F.lit(".")) & (p != "."))


def display_path(root: str, path: str) -> str:
    inside = os.path.relpath(path, root)
    return path.replace(os.sep, "/") if inside.startswith("..") else inside.replace(os.sep, "/")


def git_files(root: str, changed: bool = False) -> list[str]:
    """Tracked and untracked files, or those that differ from the last commit."""
    def run(*args: str) -> list[str]:
        out = subprocess.run(["git", "-C", root, *args, "-z"], capture_output=True, check=True).stdout
        return [x.decode() for x in out.split(b"\0") if x]

    if not changed:
        return sorted(set(run("ls-files", "-co", "--exclude-standard")))
    try:
        found = run("diff", "--name-only", "HEAD")
    except subprocess.CalledProcessError:  # no commit yet
        found = run("diff", "--name-only", "--cached")
    return sorted(set(found) | set(run("ls-files", "-o", "--exclude-standard")))


def requested_paths(root: str, paths: list[str] = (), preset: str = "", has_input: bool = False) -> list[str]:
    """Absolute paths of a request: named ones and globs, a preset's, or the root itself."""
    out = []
    for raw in paths:
        full = os.path.join(root, raw)
        if _SPECIAL.search(raw):
            matches = sorted(globbing.glob(full, include_hidden=True))
            if not matches:
                raise FileNotFoundError(f"glob {raw!r} matched no files")
            out += matches
        else:
            out.append(full)
    if preset == "plan":
        plan = next((p for p in ("plan.md", "PLAN.md") if os.path.isfile(os.path.join(root, p))), None)
        if plan is None:
            raise FileNotFoundError("preset plan needs plan.md or PLAN.md")
        out.append(os.path.join(root, plan))
    elif preset in ("tracked", "changed"):
        out += [os.path.join(root, p) for p in git_files(root, preset == "changed")]
    elif preset:
        raise ValueError(f"unknown preset {preset!r}")
    if not out and not preset and not has_input:
        out.append(root)
    return sorted(out)


def discover(root: str, paths: list[str], rules: list[IgnoreRule], include_hidden: bool = False) -> list[tuple]:
    """(sequence, abs path, label, size, warning, incomplete) in discovery order; the first of equal paths wins."""
    events, seen = [], set()

    def note(text: str, incomplete: bool) -> None:
        events.append((len(events), None, None, None, text, incomplete))

    def take(path: str) -> None:
        if path not in seen and os.path.isfile(path):
            seen.add(path)
            events.append((len(events), path, display_path(root, path), os.path.getsize(path), None, False))

    for path in map(os.path.abspath, paths):
        label = display_path(root, path)
        if os.path.islink(path):
            note(f"skip symlink: {label}", False)
        elif not os.path.exists(path):
            note(f"skip {label}: no such file", True)
        elif os.path.isdir(path):
            def walk(folder: str) -> None:
                for entry in sorted(os.scandir(folder), key=lambda e: e.name):
                    own = display_path(root, entry.path)
                    if entry.is_symlink():
                        continue
                    if entry.is_dir():
                        hidden = entry.name.startswith(".") and not include_hidden
                        if entry.name not in SKIPPED and not hidden and not ignored(own + "/", rules):
                            walk(entry.path)
                    elif not ignored(own, rules):
                        take(entry.path)

            walk(path)
        elif not ignored(label, rules):
            take(path)
    return events


def mismatch(path: Column, mime: Column) -> Column:
    """Warning where a file's extension suggests another type than its content has."""
    kinds = F.create_map(*[F.lit(x) for pair in media.EXTENSIONS.items() for x in pair])
    wanted = F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)))
    return F.when(wanted.isNotNull() & (wanted != mime), F.concat(path, F.lit(": extension suggests "), wanted, F.lit(" but content is "), mime))


#: Files that are composed at once: a stretch that fits, or fails, as a whole is one step.
COMPOSED = 1024


def running_totals(size, added, is_media, free, total: int, media: int, limits: Limits):
    """(totals before each file, media before each file, total and media after the last) of files in order.

    ``free`` files are taken if the totals let them in; others never are. All
    free files are first supposed to be taken: that is right up to the first one
    that does not fit, from which it goes on without those too large ever to fit.
    """
    totals, counts = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for start in range(0, len(size), COMPOSED):
        at, stop = start, min(start + COMPOSED, len(size))
        own = free[start:stop] & (size[start:stop] <= limits.total - total)
        while at < stop:
            block = slice(at, stop)
            on = own[at - start :]
            t, m = np.where(on, added[block], 0), (on & is_media[block]).astype(np.int64)
            totals[block], counts[block] = total + np.cumsum(t) - t, media + np.cumsum(m) - m
            out = np.flatnonzero(on & ((totals[block] + size[block] > limits.total) | (is_media[block] & (counts[block] >= limits.media_count))))
            if not len(out):
                total, media = total + int(t.sum()), media + int(m.sum())
                break
            at += int(out[0]) + 1
            total, media = int(totals[at - 1]), int(counts[at - 1])
            own[at - start :] &= (size[at:stop] <= limits.total - total) & ~(is_media[at:stop] & (media >= limits.media_count))
    return totals, counts, total, media


def fold_limits(files: DataFrame, limits: Limits = Limits(), key: str = "request_id") -> DataFrame:
    """``files`` with ``taken`` and ``skip`` (why not), deciding in ``sequence`` order within each request.

    ``files``: size, text_size (of the normalised text), is_media, bad (an error
    or null), pages, duration_ms, drop (binary or generated: warned, no limit).
    What does not depend on other files is decided natively. The totals before
    each file are a fold: narrow rows are sorted by request and streamed, in
    bounded memory however many files a request has.
    """
    long = lambda x: F.lit(x).cast("long")
    c = F.col
    say = lambda text: F.concat(F.lit("skip "), c("label"), F.lit(text))
    over = c("size") > max(limits.file, limits.media)
    # The sentences of skipped files, which readers match
    before_count = F.when(c("is_media") & (c("size") > limits.media), say(": media is over the limit"))
    after_count = (
        F.when(c("is_media") & c("bad").isNotNull(), F.concat(F.lit("skip "), c("label"), F.lit(": "), c("bad")))
        .when(c("is_media") & (F.coalesce("pages", F.lit(0)) > limits.pages), say(": too many pages"))
        .when(c("is_media") & (F.coalesce("duration_ms", long(0)) > limits.duration_ms), say(": too long"))
        .when(~c("is_media") & (c("size") > limits.file), say(": text file is over the limit"))
    )
    dropped = F.when(~c("is_media") & c("drop").isNotNull(), F.concat(F.lit("skip "), c("drop"), F.lit(": "), c("label")))
    free = ~over & F.coalesce(before_count, after_count, dropped).isNull()
    added = F.when(c("is_media"), c("size")).otherwise(c("text_size"))
    narrow = files.select(c(key).alias("k"), c("sequence").cast("long").alias("s"), c("size").cast("long"), F.coalesce(added, long(0)).cast("long").alias("added"), F.coalesce("is_media", F.lit(False)).alias("m"), F.coalesce(free, F.lit(False)).alias("free"))

    def fold(batches):
        name, total, media = None, 0, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            size, added, is_media, free = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
            totals, counts = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[a] != name:
                    name, total, media = keys[a], 0, 0
                part = slice(a, b)
                totals[part], counts[part], total, media = running_totals(size[part], added[part], is_media[part], free[part], total, media, limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals), pa.array(counts)], names=["_k", "_s", "_total", "_count"])

    kind = narrow.schema["k"].dataType.simpleString()
    states = narrow.repartition("k").sortWithinPartitions("k", "s").mapInArrow(fold, f"_k {kind}, _s long, _total long, _count long")
    rows = files.withColumn("sequence", c("sequence").cast("long"))
    rows = rows.join(states, rows[key].eqNullSafe(c("_k")) & (rows["sequence"] == c("_s")))
    limit = (
        F.when(over, say(": file is over the limit"))
        .when(c("_total") + c("size") > limits.total, say(": total input limit reached"))
        .otherwise(F.coalesce(before_count, F.when(c("is_media") & (c("_count") >= limits.media_count), say(": media count limit reached")), after_count))
    )
    out = rows.select(*[c(x) for x in files.columns], F.coalesce(limit, dropped).alias("skip"), limit.isNull().alias("complete"))
    return out.withColumn("taken", c("skip").isNull())


def read_files(spark: SparkSession, events: list[tuple], request_id: str = "request", most: int | None = None) -> DataFrame:
    """Discovered files with content, inspected media, normalised text and predicates. Files of
    more than ``most`` bytes, which no limit would let in, are listed but not opened."""
    listed = spark.createDataFrame([(e[0], e[1], e[2], e[3]) for e in events if e[1] is not None], "sequence long, abs string, label string, size long")
    names = [e[1] for e in events if e[1] is not None and (most is None or e[3] <= most)]
    # Spark's file scans leave out names that start with a dot or an underscore: those few are read here
    hidden = [n for n in names if os.path.basename(n)[0] in "._"]
    content = spark.createDataFrame([(n, open(n, "rb").read()) for n in hidden], "abs string, content binary")
    if shown := [n for n in names if n not in set(hidden)]:
        plain = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
        scan = spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?\\,])", r"\\\1", n) for n in shown])
        content = content.unionByName(scan.select(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))).alias("abs"), "content"))
    files = listed.join(content, "abs", "left" if most is not None else "inner").withColumn("content", F.coalesce("content", F.lit(b""))).withColumn("asset", media.inspected(F.col("content")))
    text = normalized(F.col("content").cast("string"))
    is_media = F.col("asset.mime") != ""
    return files.select(
        F.lit(request_id).alias("request_id"), "sequence", "label", "size", "content", "asset", is_media.alias("is_media"), F.when(~is_media, text).alias("text"),
        F.octet_length(F.when(~is_media, text)).cast("long").alias("text_size"), F.col("asset.error").alias("bad"), F.col("asset.document.pages").alias("pages"), F.col("asset.audio.duration_ms").alias("duration_ms"),
        F.when(~is_media, F.when(is_binary(F.col("content")), "binary").when(is_generated(F.col("label"), F.col("content").cast("string")), "generated")).alias("drop"),
    )


SOURCES = ("request_id", "label", "path", "kind", "sha256", "bytes", "asset_id", "mime", "text", "image", "audio", "document")


def file_sources(files: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(sources, warnings) of read files; sources by (kind, label)."""
    rows = fold_limits(files, limits)
    sha = F.sha2("content", 256)
    asset = lambda n: F.col(f"asset.{n}")
    m = F.col("is_media")
    document = F.when(asset("document").isNotNull(), F.struct(asset("document.format").alias("format"), asset("document.pages").alias("pages"), asset("document.page_meta").alias("page_meta")))
    sources = rows.where("taken").select(
        "request_id", "label", F.col("label").alias("path"), F.when(m, asset("source_kind")).otherwise("file").alias("kind"), F.when(m, sha).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"),
        F.when(m, F.col("size")).otherwise(F.col("text_size")).alias("bytes"), F.when(m, F.concat(F.lit("asset-"), F.substring(sha, 1, 12))).otherwise("").alias("asset_id"), F.coalesce(asset("mime"), F.lit("")).alias("mime"),
        F.when(m, normalized(F.coalesce(asset("text"), F.lit("")))).otherwise(F.col("text")).alias("text"), asset("image").alias("image"), asset("audio").alias("audio"), document.alias("document"),
    )
    wrong = mismatch(F.col("label"), asset("mime"))
    notes = F.array_compact(F.concat(F.array(F.col("skip"), F.when(F.col("taken"), wrong)), F.when(F.col("taken"), F.transform(F.concat(F.array_compact(F.array(wrong)), asset("warnings")), lambda w: F.concat("label", F.lit(": "), w))).otherwise(F.array().cast("array<string>"))))
    warnings = rows.select("request_id", "sequence", F.explode(notes).alias("warning"), (~F.col("complete")).alias("incomplete"))
    return sources, warnings


def inline_source(spark: SparkSession, label: str, kind: str, text: str, limit: int | None = None, request_id: str = "request") -> DataFrame:
    """A prompt, prompt file or standard input as a source; over the limit it is an error, not a skip."""
    if limit is not None and len(text.encode()) > limit:
        raise ValueError(f"{label} is over its limit of {limit} bytes")
    t = normalized(F.col("t"))
    df = spark.createDataFrame([(text,)], "t string").withColumn("t", t)
    null = {"image": "struct<width:int,height:int,orientation:int,frames:int>", "audio": "struct<duration_ms:bigint,codec:string,sample_rate_hz:int,channels:int>", "document": "struct<format:string,pages:int,page_meta:array<struct<number:int,width_points:double,height_points:double,classification:string>>>"}
    return df.select(F.lit(request_id).alias("request_id"), F.lit(label).alias("label"), F.lit("").alias("path"), F.lit(kind).alias("kind"), F.sha2(F.col("t").cast("binary"), 256).alias("sha256"), F.octet_length("t").cast("long").alias("bytes"), F.lit("").alias("asset_id"), F.lit("").alias("mime"), F.col("t").alias("text"), *[F.lit(None).cast(v).alias(k) for k, v in null.items()])


def with_transcripts(sources: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Audio sources with the text of their transcript (path, transcript); one that fits no audio is an error."""
    audio = sources.where("kind = 'audio'")
    clean = transcripts.select(F.regexp_replace("path", r"^(\./)+", "").alias("path"), normalized(F.col("transcript")).alias("transcript"))
    lost = clean.join(audio.select("path"), "path", "left_anti").select("path").take(1)
    if lost:
        raise ValueError(f"transcript audio path {lost[0][0]!r} was not collected")
    rows = sources.join(clean, "path", "left")
    return rows.withColumn("text", F.when(F.col("kind") == "audio", F.coalesce("transcript", "text")).otherwise(F.col("text"))).select(*sources.columns)


def collect(spark: SparkSession, root: str, paths: list[str] = (), preset: str = "", prompt: str | None = None, prompt_file: str | None = None, stdin: str | None = None, transcripts: dict[str, str] | None = None, limits: Limits = Limits(), include_hidden: bool = False, ignore: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sources, warnings) of one request, as a command line would gather them."""
    root = os.path.abspath(root)
    texts = [open(p, encoding="utf-8").read() for n in IGNORE_FILES if ignore and os.path.isfile(p := os.path.join(root, n))]
    found = requested_paths(root, list(paths), preset, any(x is not None for x in (prompt, prompt_file, stdin)))
    events = discover(root, found, ignore_rules(*texts), include_hidden)
    sources, warnings = file_sources(read_files(spark, events, most=max(limits.file, limits.media)), limits)
    if prompt is not None:
        sources = sources.unionByName(inline_source(spark, "prompt", "prompt", prompt, limits.total))
    if prompt_file is not None:
        with open(os.path.join(root, prompt_file), encoding="utf-8") as f:
            sources = sources.unionByName(inline_source(spark, f"prompt-file:{display_path(root, os.path.join(root, prompt_file))}", "prompt-file", f.read(), limits.file))
    if stdin is not None:
        sources = sources.unionByName(inline_source(spark, "stdin", "stdin", stdin, limits.total))
    if transcripts:
        rows = []
        for audio, text in transcripts.items():
            with open(os.path.join(root, text), encoding="utf-8") as f:
                rows.append((os.path.normpath(audio), f.read()))
        sources = with_transcripts(sources, spark.createDataFrame(rows, "path string, transcript string"))
    notes = [(e[0], e[4], e[5]) for e in events if e[4] is not None]
    if notes:
        listed = spark.createDataFrame(notes, "sequence long, warning string, incomplete boolean").withColumn("request_id", F.lit("request"))
        warnings = warnings.unionByName(listed.select("request_id", "sequence", "warning", "incomplete"))
    return sources.orderBy("kind", "label"), warnings.orderBy("sequence")
