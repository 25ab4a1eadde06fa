"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.llm import credentials, curriculum, host_paths, langid, media, order_minhash, perplexity, rotation, slack_packing, url_lists

LONG = "palabra larga " * 30_000
ROWS = [
    (1, "the cat sat on the mat and the dog ran off", "en", "a", 1), (1, "the cat sat on the mat and the dog ran off", "en", "a", 1), (2, None, "en", None, 0), (3, "", None, "", 0),
    (None, "le chat est sur la table et le chien court", "fr", "b", 2), (4, LONG, "es", "b", len(LONG)), (5, "### $$$ 123", "xx", "a", 1), (6, "der Hund und die Katze 中文 <|endoftext|>", None, "a", 5),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, digest string, bucket int, kept boolean, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, 9, "x", 1, True, "l") for r in ROWS], EXTRA)


def everything(docs):
    model = langid.fit_documents(docs)
    yield "language", langid.predict(docs, model)
    yield "near", order_minhash.near_duplicates(docs)
    yield "secrets", credentials.find_secrets(docs)
    yield "mix", curriculum.assign(docs, ["doc_id", "size"])
    yield "pack", slack_packing.pack_documents(docs)
    yield "quality", perplexity.judge(docs)


def test_rows_stay_whole(docs):
    counts = {name: df.count() for name, df in everything(docs)}
    assert counts.pop("pack") >= len(ROWS)
    assert set(counts.values()) == {len(ROWS)}


def test_empty_tables(spark, docs):
    for name, df in everything(docs.limit(0)):
        assert df.count() == 0, name
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert host_paths.extract(pages).count() == 0
    entries = spark.createDataFrame([], "list_key string, effective date, action string")
    assert url_lists.decide(spark.createDataFrame([("http://a.example/x", None)], "url string, fetched date"), entries).first()["decision"] == "none"
    assert rotation.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_defined_results(docs):
    pieces = slack_packing.pack_documents(docs).collect()
    assert sum(p["length"] == 1 for p in pieces) == 2  # the null and the empty text
    secrets = {r["doc_id"]: r for r in credentials.find_secrets(docs).collect()}
    assert secrets[2]["spans"] == "" and secrets[2]["n_hex"] == 0
    mix = {(r["doc"]["doc_id"], r["size"]): r for r in curriculum.assign(docs, ["doc_id"]).collect()}
    assert mix[(2, 0)]["taken"] == 0 and mix[(2, 0)]["source_size"] == 0
    near = order_minhash.near_duplicates(docs).collect()
    assert {r["class_size"] for r in near if r["doc_id"] == 1} == {2}
    assert order_minhash.first_of_class(docs).count() == len(ROWS) - 2  # one copy, and the empty with the null text
    languages = {r["doc_id"]: r for r in langid.predict(docs, langid.fit_documents(docs)).collect()}
    assert languages[2]["lang_pred"] == languages[3]["lang_pred"] == languages[5]["lang_pred"] == "und"
    quality = {r["doc_id"]: r for r in perplexity.judge(docs).collect()}
    assert quality[2]["n_words"] == 0 and quality[2]["base_failed"] and not quality[2]["kept"]


def test_pages_and_media(spark):
    rows = [(1, "http://h.example/a", "<p>one</p>", "t"), (1, "http://h.example/a", "<p>one</p>", "t"), (2, None, None, None), (3, "not a url", "", ""), (4, "http://h.example/b", "<" * 5000 + "a" * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in host_paths.extract(pages).collect()}
    assert host_paths.extract(pages).count() == 5
    assert found[2]["text"] == "" and found[2]["n_chars"] == 0 and found[1]["text"] == "one"
    assert media.sequences(pages, "html", ["page_id"]).where("page_id in (2, 3)").count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    for rows in (docs, docs.limit(0), docs.where("text is null"), docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))):
        n = rows.count()
        for name, apply in corpus_pipeline.STAGES:
            found = apply(spark, rows, "")
            kept = found.count()
            assert name == corpus_pipeline.STAGES[-1][0] or found.columns == docs.columns
            assert kept == n if name == "secret scans" else kept >= n if name == "best-fit packing" else n == 0 or kept <= 3 * n, name


def test_media_edges(spark, monkeypatch):
    rows = [(1, "", "d", 1), (2, None, "d", 1), (1, "", "d", 1), (3, LONG, "d", 1), (4, "a < b & c\n\n<img src='x'>", "d", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string, position int")
    for given in (table, table.limit(0)):
        monkeypatch.setattr(media, "read_table", lambda *_, t=given: t)
        found = media.op6_interleaved_media(spark, "").collect()
        assert len(found) == given.count()
    monkeypatch.setattr(media, "read_table", lambda *_: table)
    found = {r["doc_id"]: r for r in media.op6_interleaved_media(spark, "").collect()}
    assert found[1]["n_bytes"] == found[2]["n_bytes"] == 0 and found[1]["payload_bytes"] == 64 and found[1]["feature"] == found[2]["feature"]
    assert found[3]["n_items"] == 2 and found[4]["n_items"] == 3 and found[4]["position"] == 1
    items = media.sequences(spark.createDataFrame([(1, "<img src=a><img src=a>", 7)], "id long, page string, position int"), "page", ["id"])
    payloads = spark.createDataFrame([], "digest string, payload_bytes long")
    assert [(r["position"], r["resolved"]) for r in media.resolve(items, payloads).orderBy("position").collect()] == [(0, False), (1, False)]


def test_rotation_edges(spark):
    schema = "conv_id long, turn long, role string, text string, participant string, run int, seq int, length int"
    rows = [(1, i, f"s{i % 3}", f"turn {i}", "p", 1, 1, 1) for i in range(400)] + [(2, 0, "a", "x", "p", 1, 1, 1)] * 3 + [(3, None, "a", LONG, "p", 1, 1, 1)]
    found = rotation.rotate(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 1200 + 3 + 1
    for p in ("s0", "s1", "s2"):
        mine = sorted((r for r in found if r["conv_id"] == 1 and r["participant"] == p), key=lambda r: r["seq"])
        assert [r["turn"] for r in mine] == list(range(400)) and all(a["char_end"] == b["char_start"] for a, b in zip(mine, mine[1:]))
    assert sorted(r["seq"] for r in found if r["conv_id"] == 2) == [0, 1, 2]


def test_list_edges(spark):
    day = datetime.date(2024, 1, 5)
    captures = spark.createDataFrame([("http://a.example/x", day, "own", 1)] * 3 + [("http://[::1]:80/", day, "own", 2), ("http://b.a.example", None, "own", 3)], "url string, fetched date, list_key string, salt int")
    entries = [("a.example", day, "block", 1), ("a.example", day, "block", 2), ("a.example", day, "allow", 3), ("example", day, "allow", 1), ("[::1]", day, "block", 1), (None, day, "block", 1), ("b.a.example", None, "block", 1)]
    found = url_lists.decide(captures, spark.createDataFrame(entries, "list_key string, effective date, action string, url int")).collect()
    assert len(found) == 5 and [r["decision"] for r in found if r["url"] == "http://a.example/x"] == ["block"] * 3
    by_url = {r["url"]: r for r in found}
    assert by_url["http://[::1]:80/"]["decision"] == "block" and by_url["http://b.a.example"]["decision"] == "none" and by_url["http://[::1]:80/"]["list_key"] == "own"


def test_repeated_rows_share(spark):
    rows = [(1, "one two three four", "a")] * 4 + [(2, "five six", "b")] * 2
    found = curriculum.assign(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    taken = [r["taken"] for r in found if r["doc"]["doc_id"] == 1]
    assert len(found) == 6 and abs(sum(taken) - next(r["target"] for r in found if r["doc"]["doc_id"] == 1)) <= 1 and all(0 <= x <= 12 for x in taken)


def test_repeated_rows_are_packed_each(spark):
    pieces = slack_packing.pack_documents(spark.createDataFrame([(1, "one two three")] * 5 + [(None, "x")] * 2, "doc_id long, text string")).collect()
    assert len(pieces) == 7 and len({(p["sequence_id"], p["offset"]) for p in pieces}) == 7
