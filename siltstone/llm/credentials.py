"""Multipart credential linking.

Base rules find assignments, access identifiers and long hex runs. Weak parts (named identifiers,
bare mixed tokens, short assignments, endpoints) are common in clean text, so they are reported
only where complementary parts stand together: an interval join over scopes of a document finds the
parts that lie less than a scope's length apart, from the end of one to the start of the other.

* a weak identifier needs a secret in reach, a weak secret needs an identifier,
* an endpoint needs both.

Defined results: a null text is an empty one; a text without findings has zero counts, the digest
of the empty string and empty ``spans``. Repeated rows get equal results. Offsets are code points,
ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, small_batches, stage

# The base rules and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.I | re.A)
WEAK_SECRET = re.compile(r"""\b(?:pwd|pass|key|auth|credential|signature|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.I | re.A)
BARE_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|\b(?:host|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}""", re.I | re.A)

#: Kinds in the order in which equal starts are listed, with the role that each part plays.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}

PART = "struct<start:long,kind:int,end:long>"
SCAN_SCHEMA = f"doc_id long, text_key string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<{PART}>, weak array<{PART}>"


@dataclass(frozen=True)
class LinkConfig:
    #: Length of a scope; parts with fewer code points than this between them are in reach of each other.
    scope_chars: int = 512


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that don't touch a base span; a bare token mixes cases and digits."""
    found = [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in BARE_TOKEN.finditer(text) if mixed(m[0])]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    kept, at = [], 0
    for part in sorted(set(found)):
        while at < len(base) and base[at][2] <= part[0]:
            at += 1
        if not any(b[0] < part[2] and part[0] < b[2] for b in base[at : at + 4]):
            kept.append(part)
    return kept


def mixed(token: str) -> bool:
    return any(c.islower() for c in token) and any(c.isupper() for c in token) and any(c.isdigit() for c in token)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            weak = weak_parts(text, base) if ":" in text or "=" in text or base else []
            digest = hashlib.sha256(join_spans(base).encode()).hexdigest()
            as_dicts = [[{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans in (base, weak)]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, *as_dicts))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"])
        out.insert(0, "doc_id", pdf["doc_id"].array)
        out.insert(1, "text_key", pdf["text_key"].array)
        yield out


def link_parts(scanned: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Weak parts that are completed by parts in reach: rows (text_key, linked array).

    Every part is dealt to all scopes that it touches when widened by half a scope on both sides, so
    that parts in reach of each other share one. In a scope the latest end among the parts of a role
    that start before and the earliest start among those that start after tell whether one is in
    reach, so a scope with many parts never becomes pairs.
    """
    reach, half = config.scope_chars, (config.scope_chars + 1) // 2
    parts = scanned.where(F.size("weak") > 0).select("text_key", F.explode(F.concat("base", "weak")).alias("part")).distinct()
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])]), F.col("part.kind"))
    start, end = F.col("part.start"), F.col("part.end")
    touched = F.sequence(F.floor((start - half) / reach), F.floor((end - 1 + half) / reach))
    dealt = parts.select("text_key", "part", role.alias("role"), start.alias("start"), end.alias("end"), F.explode(touched).alias("scope"))
    scope = Window.partitionBy("text_key", "scope")
    before = scope.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = scope.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def near(wanted: str) -> Column:
        ended = F.max(F.when(F.col("role") == wanted, F.col("end"))).over(before)
        starts = F.min(F.when(F.col("role") == wanted, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - ended < reach, F.lit(False)) | F.coalesce(starts - F.col("end") < reach, F.lit(False))

    seen = dealt.select("text_key", "part", "role", near("id").alias("near_id"), near("secret").alias("near_secret")).where(F.col("part.kind") >= 3)
    seen = seen.groupBy("text_key", "part", "role").agg(F.bool_or("near_id").alias("has_id"), F.bool_or("near_secret").alias("has_secret"))
    needed = F.when(F.col("role") == "id", F.col("has_secret")).when(F.col("role") == "secret", F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret"))
    return seen.where(needed).groupBy("text_key").agg(F.collect_set("part").alias("linked"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """One row for each row of ``docs``: counts and digest of the base spans, and all spans as
    text and as an array of (start, kind, end)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scanned = texts.select("doc_id", "text", F.md5("text").alias("text_key")).mapInPandas(_scan, SCAN_SCHEMA)
    scanned = stage(scanned, "secret-parts")
    plain = scanned.where(F.size("weak") == 0).withColumn("linked", F.lit(None).cast(f"array<{PART}>"))
    every = scanned.where(F.size("weak") > 0).join(link_parts(scanned, config), "text_key", "left").unionByName(plain)
    found = F.concat("base", F.coalesce("linked", F.array().cast(f"array<{PART}>")))
    return every.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _joined(found).alias("spans"), "text_key", F.array_sort(found).alias("span_list"))


def redact(docs: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows the text."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans)], dtype=object)

    columns = docs.columns
    found = find_secrets(docs, config).where(F.size("span_list") > 0).select("text_key", "span_list").dropDuplicates(["text_key"])
    keyed = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")))).join(found, "text_key", "left")
    out = keyed.withColumn("text", F.when(F.col("span_list").isNull(), F.col("text")).otherwise(replaced(F.when(F.col("span_list").isNotNull(), F.col("text")), F.col("span_list"))))  # other texts aren't sent
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("span_list").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(columns)


def _without(text: str | None, spans: list | None) -> str | None:
    """A text with each span replaced by its kind, in one pass; a span inside one before it is gone with it."""
    if text is None or spans is None:
        return text
    pieces, at = [], 0
    for span in spans:
        if span["end"] > at:
            pieces += [text[at : max(at, span["start"])], "[", KINDS[span["kind"]], "]"]
            at = span["end"]
    return "".join([*pieces, text[at:]])


def op5_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
