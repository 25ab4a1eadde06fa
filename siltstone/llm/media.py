"""Media columns: interleaved document sequences.

Pages are parsed to ordered items: texts and media references, each with its place and a media
item with its caption. References name payloads by digest; an equi-join on the digest resolves
them, so that places and captions stay aligned whatever the order of the join.

``encode_payloads`` stores texts as 8-bit grey images of width 64 (binary PGM), reads the stored
bytes back and describes them. Payload rows are unique by digest before the join.

Defined results: a null page has no items and a null text is an empty one. A reference without a
payload stays, unresolved. Repeated rows are parsed each; repeated payloads count once. Equal texts
give equal values. Equal references of a page are items of their own. Extra columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .markup import BLOCK, attributes, one_spaced, scan

WIDTH = 64
MEDIA_TAGS = frozenset("img video audio source embed".split())
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def items_of(page: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, reference, caption) of one page in page order.

    A caption is the figcaption of the figure that holds the media, or else its alt or title.
    """
    items: list[list] = []
    pieces: list[str] = []
    figure: list[list] | None = None
    caption: list[str] | None = None

    def flush() -> None:
        text = one_spaced("".join(pieces))
        pieces.clear()
        if text:
            items.append(["text", text, None, None])

    for kind, value, source in scan(page):
        if kind == "text":
            (pieces if caption is None else caption).append(value)
        elif kind == "open" and value in MEDIA_TAGS:
            found = attributes(source)
            if found.get("src"):
                flush()
                items.append(["media", None, found["src"].strip(), one_spaced(found.get("alt") or found.get("title") or "") or None])
                if figure is not None:
                    figure.append(items[-1])
        elif value == "br":
            pieces.append(" ")
        elif value == "figcaption":
            if kind == "open":
                flush()
                caption = []
            elif caption is not None:
                text = one_spaced("".join(caption))
                if figure:
                    for item in figure:
                        item[3] = text or item[3]
                elif text:
                    items.append(["text", text, None, None])
                caption = None
        elif value == "figure":
            flush()
            figure = [] if kind == "open" else None
        elif value in BLOCK:
            flush()
    if caption:
        pieces.extend(caption)
    flush()
    return [(i, *item) for i, item in enumerate(items)]


def items_column() -> Callable[[Column], Column]:
    """Column function from a page to its array of items."""

    @F.pandas_udf(f"array<{ITEM}>")
    def parsed(column: pd.Series) -> pd.Series:
        names = ("position", "kind", "text", "ref", "caption")
        return pd.Series([[dict(zip(names, x)) for x in items_of(p or "")] for p in column], dtype=object)

    return parsed


def digest_of(ref: Column) -> Column:
    """The digest that a reference names, null if it names none."""
    return F.nullif(F.regexp_extract(ref, r"^(?:sha256:|media:)?([0-9a-f]{64})", 1), F.lit(""))


def sequences(pages: DataFrame, page: str, keep: list[str]) -> DataFrame:
    """A row for each item: the kept columns, position, kind, text, ref, caption, digest."""
    items = pages.select(*keep, F.explode(items_column()(F.col(page))).alias("item")).select(*keep, "item.*")
    return items.withColumn("digest", digest_of(F.col("ref")))


def resolve(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """``items`` with the columns of ``payloads`` (unique by digest) and whether they were found. Rows
    without a digest don't take part in the join, so they don't meet in one task."""
    marked = payloads.withColumn("resolved", F.lit(True))
    named = items.where("digest is not null").join(marked, "digest", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    others = items.where("digest is null").withColumn("resolved", F.lit(False))
    return named.unionByName(others, allowMissingColumns=True)


def store(payload: bytes) -> bytes:
    """The payload as a binary PGM image of width 64, losslessly."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def read_back(media: bytes) -> bytes:
    kind, size, top, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a binary PGM of 8-bit samples")
    return samples


def average_hash(samples: bytes) -> str:
    """64 bits in hex: which cells of an 8 by 8 grid are lighter than the whole image."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH // 8, 8).sum(2, dtype=np.int64)
    cuts = np.arange(9) * len(rows) // 8
    sums = np.vstack([np.zeros((1, 8), np.int64), rows.cumsum(0)])
    cells, area = sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts) * 8
    lighter = cells * len(samples) > area[:, None] * int(sums[-1].sum())
    return f"{int.from_bytes(np.packbits(lighter).tobytes(), 'big'):016x}"


def payload_of(text: Column) -> Column:
    """UTF-8 bytes followed by zeros up to a positive multiple of 64."""
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    short = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), short)))


def encode_payloads(payloads: DataFrame) -> DataFrame:
    """Store each payload (digest, payload), read it back, describe it; one row for each digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for digest, payload in zip(pdf["digest"], pdf["payload"]):
                media = store(bytes(payload))
                samples = read_back(media)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), average_hash(samples)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return payloads.mapInPandas(run, FEATURES).dropDuplicates(["digest"])


def document_page(text: Column, caption: Column, digest: Column) -> Column:
    """A page of a document: its lines as paragraphs, its payload as a figure after the first."""
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first, rest = F.substring_index(escaped, "\n", 1), F.regexp_extract(escaped, r"(?s)\n(.*)", 1)
    figure = F.concat(F.lit("<figure><img src='sha256:"), digest, F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<p>"), first, F.lit("</p>"), figure, F.lit("<p>"), F.replace(rest, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))


def op6_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page that shows its payload after its first line.

    Beside what is read back from the payload: the number of items of the page's sequence, the place
    and caption of the payload in it, and the SHA-256 of its texts, joined by line ends.
    """
    texts = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    payload = payload_of(F.col("text"))
    digest = F.sha2(payload, 256)
    n_bytes = F.octet_length("text").cast("long")
    page = document_page(F.col("text"), F.concat(n_bytes.cast("string"), F.lit(" bytes")), digest)
    read = texts.select("doc_id", n_bytes.alias("n_bytes"), items_column()(page).alias("items"))
    shown = F.filter("items", lambda x: x["kind"] == "media")[0]
    said = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"]), "\n")
    read = read.select(
        "doc_id", "n_bytes", digest_of(shown["ref"]).alias("digest"), F.size("items").cast("long").alias("n_items"), shown["position"].cast("long").alias("position"),
        shown["caption"].alias("caption"), F.sha2(said.cast("binary"), 256).alias("texts_sha256"),
    )
    described = encode_payloads(texts.select(digest.alias("digest"), payload.alias("payload")))
    found = read.join(described, "digest", "left")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position", "caption", "texts_sha256")


#: Documents that a page shows.
SHOWN = 3


def illustrated(pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """``pages`` (page_id, html) whose html follows media, from ``payloads`` (doc_id, digest).

    Page n shows the payloads of documents 3n to 3n + 2, where there are such: one in a figure with markup in its
    caption, one inside a sentence, one beside the first again in a figure of two. A reference to a payload that
    nobody has and one that names no digest follow.
    """
    slot = F.pmod("doc_id", F.lit(SHOWN))
    of = payloads.where("doc_id is not null").groupBy(F.floor(F.col("doc_id") / SHOWN).alias("page_id")).agg(*[F.min(F.when(slot == i, F.col("digest"))).alias(f"d{i}") for i in range(SHOWN)])
    known = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).join(of, "page_id", "left")
    number = lambda i: (F.col("page_id") * SHOWN + i).cast("string")
    parts = [
        F.concat(F.lit('<figure><img alt="not shown" src="sha256:'), F.col("d0"), F.lit('"><figcaption>Picture of <b>document '), number(0), F.lit("</b></figcaption></figure>")),
        F.concat(F.lit("<p>A sentence with <img title='Document "), number(1), F.lit("' src='media:"), F.col("d1"), F.lit("'> in its middle.</p>")),
        F.concat(F.lit("<figure><video src="), F.col("d2"), F.lit('></video><img src="sha256:'), F.col("d0"), F.lit('" alt="again"><figcaption>Two &amp; one</figcaption></figure>')),
        F.concat(F.lit('<div><audio title="Lost" src="sha256:'), F.sha2(F.concat(F.lit("lost "), number(0)), 256), F.lit('"></audio><img src="photo.jpg" alt="Elsewhere"></div>')),
    ]
    return known.select("page_id", F.concat(*[F.coalesce(p, F.lit("")) for p in parts], "html").alias("html"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of every page with media of the documents: a row for each text, and for each media reference with
    its caption, whether one of the documents' payloads has its digest, and that payload's size and picture."""
    texts = read_table(spark, sf_dir, "documents").select("doc_id", payload_of(F.coalesce("text", F.lit(""))).alias("payload"))
    digests = texts.select("doc_id", F.sha2("payload", 256).alias("digest"))
    items = sequences(illustrated(read_table(spark, sf_dir, "pages"), digests), "html", ["page_id"])
    wanted = items.where("digest is not null").select("digest").distinct()
    asked = texts.withColumn("digest", F.sha2("payload", 256)).join(wanted, "digest", "left_semi")
    described = encode_payloads(asked.select("digest", "payload")).select("digest", "payload_bytes", "feature")
    found = resolve(items, described)
    return found.select("page_id", "position", "kind", "text", "ref", "caption", "resolved", "payload_bytes", "feature")
