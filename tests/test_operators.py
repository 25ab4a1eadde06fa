"""Worked cases of single operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from siltstone.config import ChunkConfig, FusionConfig, RecallConfig, SearchConfig
from siltstone.functions.dictionaries import lexeme, lexeme_sql
from siltstone.operators import chunking, evaluation, fusion, graph, mining, recall, sparse, stats
from siltstone.sources import files, walk

HIT = "query_id int, corpus_id string, leg string, chunk_id string, score double"


def hits(spark, rows):
    return fusion.ranked_lists(spark.createDataFrame(rows, HIT))


def test_reciprocal_rank(spark):
    found = fusion.reciprocal_rank(hits(spark, [(1, "c", "vector", "v1", 0.9), (1, "c", "vector", "v2", 0.8), (1, "c", "sparse", "s1", 0.85), (1, "c", "sparse", "v1", 0.7), (1, "c", "graph", "g1", 0.95)]), 10).collect()
    assert found[0]["chunk_id"] == "v1" and math.isclose(found[0]["score"], 1 / 61 + 1 / 62, abs_tol=1e-9)
    assert [r["chunk_id"] for r in found[1:]] == ["s1", "g1", "v2"]


def test_reciprocal_rank_ignores_scale_and_row_order(spark):
    rows = [(1, "c", leg, f"d{i}", 1.0 / (i + 1)) for leg in ("vector", "sparse") for i in range(5)]
    a = fusion.reciprocal_rank(hits(spark, rows), 10).orderBy("rank").collect()
    b = fusion.reciprocal_rank(hits(spark, [(*r[:4], r[4] * 7) for r in reversed(rows)]), 10).orderBy("rank").collect()
    assert a == b
    assert fusion.reciprocal_rank(hits(spark, rows), 3).orderBy("rank").collect() == a[:3]


def test_weighted_fusion_and_corpora(spark):
    config = FusionConfig(vector_weight=0.5, sparse_weight=0.5, graph_weight=0.0, normalize_scores=False)
    found = fusion.weighted(hits(spark, [(1, "c", "vector", "c1", 0.9), (1, "c", "sparse", "c1", 0.6)]), 5, config).collect()
    assert [round(r["score"], 6) for r in found] == [0.75]
    two = fusion.reciprocal_rank(hits(spark, [(1, "a", "vector", "c1", 0.9), (1, "b", "vector", "c1", 0.8)]), 5)
    assert two.count() == 2
    assert FusionConfig(vector_weight=0, sparse_weight=0, graph_weight=0).weights() == {"vector": 0.4, "sparse": 0.3, "graph": 0.3}
    assert fusion.reciprocal_rank(hits(spark, []), 5).count() == 0


def test_shaping(spark):
    rows = spark.createDataFrame([(1, "c", "a.py", "a1", 0.9, 1), (1, "c", "a.py", "a2", 0.8, 2), (1, "c", "b.py", "b1", 0.7, 3)], "query_id int, corpus_id string, file_path string, chunk_id string, score double, rank int")
    assert [r["chunk_id"] for r in fusion.dedup(rows, ["corpus_id", "file_path"]).orderBy("rank").collect()] == ["a1", "b1"]
    assert fusion.cap(rows, ["file_path"], 2).count() == 3
    texts = {"c1": "apple banana apple", "c2": "apple banana apple", "c3": "zebra yak"}
    pool = spark.createDataFrame([(1, k, 1.0 - i / 10, i + 1, t) for i, (k, t) in enumerate(texts.items())], "query_id int, chunk_id string, score double, rank int, text string")
    chosen = fusion.mmr(pool.withColumn("words", fusion.word_set(F.col("text"))), 2, 0.0).orderBy("rank").collect()
    assert [r["chunk_id"] for r in chosen] == ["c1", "c3"]


def test_neighbours(spark):
    chunks = spark.createDataFrame([("c", f"f:{i}", "f", i) for i in range(5)], "corpus_id string, chunk_id string, file_path string, chunk_ordinal int")
    seed = spark.createDataFrame([(1, "c", "f:0", 1.0, 1)], "query_id int, corpus_id string, chunk_id string, score double, rank int")
    found = fusion.neighbours(seed, chunks).orderBy("final_rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in found] == [("f:0", 1.0), ("f:1", 0.9)]
    assert [r["chunk_id"] for r in fusion.neighbours(seed, chunks, first_is_missing=True).collect()] == ["f:0"]


def test_rerank_and_blends(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, 1, 1.0), (1, "b", 0.5, 2, 1.0), (1, "c", 0.4, 3, 9.0)], "query_id int, chunk_id string, score double, rank int, rerank_score double")
    found = fusion.rerank_blend(rows, 0.7, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in found] == [("a", 0.0), ("b", 0.0), ("c", 0.4)]
    seeds = spark.createDataFrame([(1, "c1", 0.9), (1, "c2", 0.8)], "query_id int, chunk_id string, score double")
    more = spark.createDataFrame([(1, "c3", 0.95)], "query_id int, chunk_id string, score double")
    assert [r["chunk_id"] for r in fusion.graph_blend(seeds, more, 0.8, 5).orderBy("rank").collect()] == ["c1", "c2", "c3"]
    assert [round(x, 6) for x in fusion.overlap_reranker(__import__("pandas").Series(["a b"]), __import__("pandas").Series(["b c"]))] == [0.5]


def test_full_text_fallback(spark):
    chunks = spark.createDataFrame([("c", "c1", "src/auth/login_controller.py", "authentication flow token refresh login")], "corpus_id string, chunk_id string, file_path string, content string")
    index = sparse.index_of(chunks)
    asked = spark.createDataFrame([(1, "Where is the authentication flow unicorn token refresh code?"), (2, "token refresh")], "query_id int, question string")
    assert [r["query_id"] for r in sparse.all_terms(index, asked).collect()] == [2]
    found = sparse.first_answer([("fts", sparse.all_terms(index, asked)), ("relaxed", sparse.relaxed_or(index, asked))]).orderBy("query_id").collect()
    assert [(r["query_id"], r["engine"]) for r in found] == [(1, "relaxed"), (2, "fts")]
    path = sparse.path_search(chunks, spark.createDataFrame([(1, "login controller")], "query_id int, question string")).collect()
    assert path[0]["score"] == 2.0
    assert sparse.phrase(index, asked).count() == 1
    more = spark.createDataFrame([(1, "token unicorn"), (2, "zzzz controller"), (3, "zzzz"), (4, "token")], "query_id int, question string")
    chain = {r["query_id"]: r["engine"] for r in sparse.fallback_chain(index, more, "fts").collect()}
    assert chain == {1: "relaxed_or", 2: "file_path", 4: "fts"}
    assert sparse.relaxed_or(index, more.limit(0)).count() == 0
    quoted = sparse.bm25(index, spark.createDataFrame([(1, "flow token"), (2, "token flow")], "query_id int, question string"), quoted=True)
    assert [r["query_id"] for r in quoted.collect()] == [1]


def test_boolean_search_with_phrases(spark):
    assert sparse.parse_boolean('a b OR c -d') == ([("a",)], [("d",)], [[("b",), ("c",)]])
    assert sparse.parse_boolean('"x y" OR z -"p q" "" w') == ([("w",)], [("p", "q")], [[("x", "y"), ("z",)]])
    rows = [("c", "1", "red fox runs"), ("c", "2", "fox red runs"), ("c", "3", "the red fox sleeps now"), ("c", "4", "a b")]
    index = sparse.index_of(spark.createDataFrame(rows, "corpus_id string, chunk_id string, content string"))
    ids = lambda q: sorted(r["chunk_id"] for r in sparse.boolean(index, *sparse.parse_boolean(q)).collect())
    assert ids('"red fox"') == ["1", "3"] and ids('red fox -"red fox"') == ["2"] and ids('"red fox" runs OR now') == ["1", "3"] and ids('"fox runs" OR b') == ["1", "4"]


def brute_covers(words, asked):
    """Sum over minimal stretches that hold every term of 1 / (1 + words not asked for)."""
    n, score = len(words), 0.0
    whole = [(i, j) for i in range(n) for j in range(i, n) if set(asked) <= set(words[i : j + 1])]
    for i, j in whole:
        if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole):
            score += 1 / (1 + sum(w not in asked for w in words[i : j + 1]))
    return score


def test_cover_density(spark):
    import random

    random.seed(4)
    rows = [("c", str(i), " ".join(random.choices("abcdef", k=random.randint(1, 14)))) for i in range(60)]
    asked = [(1, "a b"), (2, "c"), (3, "a b c"), (4, "b a b")]
    index = sparse.index_of(spark.createDataFrame(rows, "corpus_id string, chunk_id string, content string"))
    found = {(r["query_id"], r["chunk_id"]): r["score"] for r in sparse.cover_density(index, spark.createDataFrame(asked, "query_id int, question string")).collect()}
    for q, text in asked:
        for _, i, content in rows:
            expected = brute_covers(content.split(), text.split())
            assert math.isclose(found.get((q, i), 0.0), expected, abs_tol=1e-9), (text, content)


def test_stored_index_equals_index(spark, tmp_path):
    rows = [("c", "1", "x y x"), ("d", "2", "y"), ("c", "3", "")]
    chunks = spark.createDataFrame(rows, "corpus_id string, chunk_id string, content string")
    made, stored = sparse.index_of(chunks), sparse.store_index(chunks, str(tmp_path / "index"))
    for name in ("words", "postings", "vocabulary", "totals"):
        columns = sorted(getattr(made, name).columns)
        assert sorted(map(str, getattr(made, name).select(columns).collect())) == sorted(map(str, getattr(stored, name).select(columns).collect()))


def spans(strategy, text, **config):
    return [text[a:b] for a, b in chunking.STRATEGIES[strategy](text, ChunkConfig(**config))]


def test_token_windows():
    parts = spans("fixed_tokens", " ".join(f"tok{i}" for i in range(200)), target_tokens=64, overlap_tokens=8)
    assert len(parts) >= 3 and all(len(p.split()) <= 64 for p in parts)
    assert "tok63" in parts[0].split() and "tok63" in parts[1].split()


def test_structural_strategies():
    assert len(spans("recursive", "\n\n".join(" ".join("abcdefghijklmnopqrstuvwxyzabcd") for _ in range(4)), target_tokens=20, overlap_tokens=2)) >= 2
    assert spans("recursive", "\n\nA\n\nB", target_tokens=512)
    heads = spans("markdown", "# Title\n" + "w " * 120 + "\n## Sub\n" + "x " * 120, target_tokens=64, overlap_tokens=4)
    assert len(heads) >= 2 and heads[0].startswith("# Title") and any(h.startswith("## Sub") for h in heads)
    code = "import os\n\ndef foo():\n    return 1\n\ndef bar():\n    return 2\n"
    parts = spans("ast", code, target_tokens=10, overlap_tokens=1, ast_overlap_lines=0)
    assert "foo" in parts[0] and "import os" in parts[0] and "bar" not in parts[0] and "".join(parts) == code
    assert spans("ast", code) == [code]
    wide = spans("ast", code, target_tokens=10, overlap_tokens=1, ast_overlap_lines=1)
    assert wide == ["import os\n\ndef foo():\n    return 1\n\n", "    return 1\n\ndef bar():\n    return 2\n"]
    assert len(spans("ast", code, target_tokens=3, overlap_tokens=1, preserve_imports=False, ast_overlap_lines=0)) == 2
    assert spans("ast", "def broken(:\n")
    source = "const x = 1;\nfunction foo() { return '}' + /[}/]/.source; } // }\nfunction bar() {\n  /* { */ return `${2}`; }\n"
    ts = spans("braces", source, target_tokens=16, overlap_tokens=1)
    assert "".join(ts) == source and [("foo" in p, "bar" in p) for p in ts][-2:] == [(True, False), (False, True)]
    assert spans("braces", source) == [source] and len(spans("braces", "{" * 5000 + "'" * 5000, target_tokens=16, overlap_tokens=1)) >= 1
    keep = lambda how: spans("recursive", "aaaa b\n\ncccc d\n\neeee f", target_tokens=2, overlap_tokens=1, separator_keep=how)
    assert keep("none") == ["aaaa b", "cccc d", "eeee f"] and keep("suffix") == ["aaaa b\n\n", "cccc d\n\n", "eeee f"] and keep("prefix") == ["aaaa b", "\n\ncccc d", "\n\neeee f"]
    assert chunking.hard_split("one two three four", [(0, 18)], ChunkConfig(max_tokens=3)) == [(0, 14), (14, 18)]
    assert spans("qa_blocks", "Q: a?\nA: b\nQ: c?\nA: d\n", target_tokens=4, overlap_tokens=1)[0].startswith("Q: a?")
    assert spans("sentence", "One. Two. Three.")[0] == "One. Two. Three."


def test_python_that_its_parser_refuses(spark):
    """Too deep, cut off, or with other line ends than the platform's: cut some other way, never an error."""
    for text in ("-" * 100_000 + "1", "(" * 50_000, "x = " + "[" * 300 + "]" * 300, "a\0b", "def f(:"):
        assert "".join(spans("ast", text, target_tokens=64, overlap_tokens=4, ast_overlap_lines=0)) == text
    for text in ("a = 1\rb = 2\r", "a = 1\r\nb = 2\r\nc = 3", "a = 1\n\rb = 2"):
        parts = spans("ast", text, target_tokens=2, overlap_tokens=1, ast_overlap_lines=0)
        assert "".join(parts) == text and len(parts) >= 2
    deep = "+".join(["f(1)"] * 30_000)
    files_ = spark.createDataFrame([("c", "deep.py", deep), ("c", "minus.py", "-" * 100_000 + "1"), ("c", "ok.py", "import os")], "corpus_id string, file_path string, content string")
    found = graph.python_graph(files_).collect()
    assert {(r["file_path"], r["kind"]) for r in found} == {("deep.py", "module"), ("minus.py", "module"), ("ok.py", "module"), ("ok.py", "imports")}


FORMS = {
    "en": [("walks", "walking", "walked", "walk"), ("study", "studies", "studied"), ("hope", "hoping", "hoped"), ("running", "runs", "run"), ("boxes", "box"), ("quickly", "quick")],
    "fr": [("cheval", "chevaux"), ("donner", "donnait", "donnent", "donnez"), ("petits", "petit", "petite", "petites")],
    "de": [("häuser", "hauses"), ("schöne", "schönen", "schöner", "schönes"), ("freiheit", "freiheiten")],
    "es": [("niños", "niño", "niña", "niñas"), ("hablar", "hablando", "hablaron", "hablamos"), ("nación", "naciones")],
}


def test_inflected_forms_meet(spark):
    import duckdb

    rows = spark.createDataFrame([(n, w, i) for n, groups in FORMS.items() for i, g in enumerate(groups) for w in g] + [("en", "the", -1), ("de", "und", -1), ("xx", "walks", -2), (None, "walks", -2)], "language string, word string, family int")
    found = [(r["language"], r["word"], r["family"], r["lexeme"]) for r in rows.withColumn("lexeme", lexeme(F.col("word"), F.col("language"))).collect()]
    for name, groups in FORMS.items():
        for i in range(len(groups)):
            assert len({x for n, _, f, x in found if (n, f) == (name, i)}) == 1, (name, groups[i], [x for n, _, f, x in found if (n, f) == (name, i)])
    assert {x for _, _, f, x in found if f == -1} == {None} and {x for _, _, f, x in found if f == -2} == {"walks"}
    for language, word, _, expected in found:
        quoted = "NULL" if language is None else f"'{language}'"
        assert duckdb.sql("SELECT " + lexeme_sql("word", "language") + f" FROM (SELECT '{word}' AS word, {quoted}::varchar AS language)").fetchall()[0][0] == expected, word


def test_search_by_lexemes(spark):
    rows = [("en", "1", "She was walking home"), ("fr", "2", "des chevaux noirs"), ("de", "3", "ein schönes Haus"), ("en", "4", "the of and")]
    index = sparse.with_dictionaries(sparse.index_of(spark.createDataFrame(rows, "corpus_id string, chunk_id string, content string")), F.col("corpus_id"))
    asked = spark.createDataFrame([(1, "who walks"), (2, "le cheval"), (3, "schöner"), (4, "the")], "query_id int, question string")
    found = sparse.bm25(index, sparse.in_dictionaries(asked, ["en", "fr", "de", "es"])).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in found} == {(1, "1"), (2, "2"), (3, "3")}


def test_split_and_message_chunks(spark):
    f = spark.createDataFrame([("c", "a.txt", "One. Two.\nThree."), ("c", "b.txt", "")], "corpus_id string, file_path string, content string")
    found = chunking.split(f, "sentence").collect()
    assert [(r["chunk_ordinal"], r["start_line"], r["end_line"]) for r in found] == [(0, 1, 2)]
    turns = spark.createDataFrame([(1, 0, "user", "Hello there. How are you?"), (1, 1, "assistant", "Fine, thank you."), (1, 2, "system", "x")], "conv_id int, turn int, role string, text string")
    rows = chunking.message_chunks(turns).orderBy("line").collect()
    assert [(r["chunk_id"], r["line"], r["token_count"]) for r in rows] == [("recall:1:0:0", 1, 2), ("recall:1:0:1", 2, 3), ("recall:1:1:0", 3, 3)]
    assert chunking.message_chunks(turns, by_sentence=False).count() == 2


def test_graph(spark):
    e = spark.createDataFrame([("f", "Foo", "class", "src/a.py"), ("b", "Bar", "class", "src/b.py"), ("m", "Mid", "class", "")], "entity_id string, name string, entity_type string, file_path string")
    r = spark.createDataFrame([("f", "m", "calls", 0.45), ("b", "m", "imports", 2.0), ("b", "gone", "calls", 0.5)], "source_id string, target_id string, relation_type string, weight double")
    found = graph.entity_search(e, r, spark.createDataFrame([(1, "foo")], "query_id int, question string")).orderBy("rank").collect()
    assert [(x["name"], x["hops"], round(x["score"], 6)) for x in found] == [("Foo", 0, 1.0), ("Mid", 1, 0.35), ("Bar", 2, round(0.7 / 3, 6))]
    later = spark.createDataFrame([("f", "m", "calls", 0.2), ("f", "m", "likes", 0.9)], r.schema)
    writes = r.withColumn("written", F.lit(1)).union(later.withColumn("written", F.lit(2)))
    valid = graph.valid_edges(e, writes, "written").collect()
    assert sorted(x["weight"] for x in valid) == [0.2, 1.0]
    nodes, inside = graph.community_subgraph("src", graph.communities(e), e, r.union(spark.createDataFrame([("f", "b", "calls", 0.1)], r.schema)), 5)
    assert [x["entity_id"] for x in nodes.collect()] == ["b", "f"] and [(x["source_id"], x["target_id"]) for x in inside.collect()] == [("f", "b")]
    assert {x["entity_id"]: x["community"] for x in graph.communities(e).collect()} == {"f": "src", "b": "src", "m": "(root)"}


def test_python_graph(spark):
    source = "import os\n\nclass A:\n    def run(self):\n        return 1\n\nclass B(A):\n    pass\n\ndef main():\n    B()\n"
    f = spark.createDataFrame([("c", "x.py", source), ("c", "bad.py", "def (")], "corpus_id string, file_path string, content string")
    rows = graph.python_graph(f).collect()
    kinds = {(r["record"], r["kind"]) for r in rows}
    assert {("relation", "inherits"), ("relation", "calls"), ("relation", "imports"), ("relation", "contains"), ("entity", "class")} <= kinds
    assert sum(r["file_path"] == "bad.py" for r in rows) == 1


@pytest.mark.parametrize(("message", "turn", "expected"), [("hi", 0, "skip"), ("thanks", 3, "skip"), ("lol", 1, "skip"), ("how does chunking work?", 2, "skip"), ("you mentioned a better approach", 2, "deep"), ("the bug", 3, "standard"), ("why is it slow?", 1, "light"), ("fix it", 0, "light")])
def test_gate(spark, message, turn, expected):
    rows = spark.createDataFrame([(message, turn)], "message string, turn int")
    assert recall.gate(rows).first()["intensity"] == expected


def test_recency_and_confidence(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 0), (1, "b", 0.5, 100), (2, "c", 0.5, 5)], "query_id int, chunk_id string, score double, ts int")
    found = {r["chunk_id"]: round(r["blended"], 6) for r in fusion.recency_blend(rows, 0.5).collect()}
    assert found == {"a": 0.5, "b": 0.75, "c": 0.5}


def test_mining(spark):
    log = "ts int, kind string, event_id string, query string, corpus_id string, top_paths array<string>, signal string, doc_id string"
    rows = [(1, "search", "e1", "q", "c", ["good.txt", "bad.txt"], None, None), (2, "feedback", "e1", None, None, None, "thumbsup", None), (3, "feedback", "e1", None, None, None, "thumbsup", None), (4, "feedback", "gone", None, None, None, "click", "x")]
    found = mining.triplets(spark.createDataFrame(rows, log)).collect()
    assert [(r["query"], r["positive"], r["negative"]) for r in found] == [("q", "good.txt", "bad.txt")]
    split = mining.dev_split(spark.range(12), "id")
    assert split.where("split = 'dev'").count() == 1
    positives = spark.createDataFrame([(1, "p"), (2, "q")], "query_id int, positive string")
    short = mining.negatives(positives, spark.createDataFrame([("n",), ("p",)], "path string"), 5).collect()
    assert sorted((r["query_id"], r["nth"]) for r in short) == [(q, i) for q in (1, 2) for i in range(1, 6)]
    assert {r["negative"] for r in short if r["query_id"] == 1} == {"n"} and {r["negative"] for r in short if r["query_id"] == 2} == {"n", "p"}
    pool = spark.range(300).select(F.concat(F.lit("f"), "id").alias("path"))
    drawn = mining.negatives(spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("f"), "id").alias("positive")), pool, 4).collect()
    assert len({(r["query_id"], r["negative"]) for r in drawn}) == 800 and all(r["positive"] != r["negative"] for r in drawn)
    seeds = mining.click_seeds(spark.createDataFrame([("q", "b", ["a", "b", "c", "d", "e", "f"], 1), ("r", None, ["a"], 2), ("s", "x", None, 3)], "query string, clicked_chunk string, results array<string>, ts int"))
    assert sorted((r["query"], r["positive"], r["negatives"]) for r in seeds.collect()) == [("q", "b", ["a", "c", "d", "e"]), ("s", "x", [])]
    texts = spark.createDataFrame([("p", "text"), ("n", " "), ("m", "more")], "path string, text string")
    cleaned = mining.clean_triplets(spark.createDataFrame([(" q ", "p", "m"), ("q", "p", "n"), ("q", "p", "gone"), ("", "p", "m")], "query string, positive string, negative string"))
    kept, counts = mining.with_texts(cleaned, texts)
    assert [(r["query"], r["negative_text"]) for r in kept.collect()] == [("q", "more")] and tuple(counts.first()) == (1, 1, 1)


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, "a.py"), (1, "b.py"), (2, "z.py")], "query_id int, path string")
    got = spark.createDataFrame([(1, "x.py", 1), (1, "src/A.py", 2), (1, "src/a.py", 3), (2, "q.py", 1)], "query_id int, path string, rank int")
    rows = {r["query_id"]: r for r in evaluation.per_query(expected, got).collect()}
    assert rows[1]["reciprocal_rank"] == 0.5 and rows[1]["recall_5"] == 0.5 and rows[1]["precision_5"] == 0.4
    assert rows[2]["reciprocal_rank"] == 0 and not rows[2]["topk_hit"]
    series = spark.createDataFrame([("a", float(50 + 10 * i)) for i in range(10)], "k string, v double")
    assert evaluation.ceil_percentile(series, "k", "v", 0.95, "p").first()["p"] == 140.0
    many = [(g, float((i * 7919) % 1000 // d)) for g, d in (("x", 1), ("y", 50), ("z", 2000)) for i in range(1000)]
    for p in (0.0, 0.5, 0.95, 1.0):
        found = {r["k"]: r["p"] for r in evaluation.ceil_percentile(spark.createDataFrame(many, "k string, v double"), "k", "v", p, "p").collect()}
        assert found == {g: sorted(v for k, v in many if k == g)[math.ceil(p * 999)] for g in "xyz"}
    for p in (0.0, 0.1, 0.5, 0.95, 1.0):
        table = spark.createDataFrame(many + [("one", 3.0)], "k string, v double")
        by_rank = {r["k"]: r["p"] for r in evaluation.nearest_rank(table, "k", "v", p, "p").collect()}
        between = {r["k"]: r["p"] for r in evaluation.interpolated(table, "k", "v", p, "p").collect()}
        for g in ("x", "y", "z", "one"):
            values = sorted(v for k, v in [*many, ("one", 3.0)] if k == g)
            place = p * (len(values) - 1)
            assert by_rank[g] == values[max(0, math.ceil(p * len(values)) - 1)]
            assert math.isclose(between[g], values[math.floor(place)] + (values[math.ceil(place)] - values[math.floor(place)]) * (place % 1), abs_tol=1e-9)
    assert evaluation.depth() == 20
    labels = spark.createDataFrame([(0, "x", 1.0), (1, "y", 0.5), (2, "z", 1.0)], "row int, key string, label double")
    assert evaluation.profile(labels).first()["label_kind"] == "graded"


def test_cost(spark):
    catalog = spark.createDataFrame([("acme", "large", 0, 0.001, 0.002, 0.00008, 0.00025, None)], "provider string, model string, position int, input_per_1k double, output_per_1k double, embed_per_1k double, per_request double, rerank_per_1k double")
    rows = spark.createDataFrame([(1, "Acme", "large", 1000, 2000, 3, 2, 100), (2, "x", "y", 1, 1, 0, 0, 1)], "request_id int, provider string, model string, tokens_in int, tokens_out int, embeds int, reranks int, per_day int")
    found = {r["request_id"]: r for r in stats.cost(rows, catalog).collect()}
    assert found[1]["per_request_usd"] == 0.00574 and found[1]["daily_usd"] == 0.574 and found[1]["monthly_usd"] == 17.22
    assert found[2]["error"] == "Unknown model: x/y"


def test_files(spark, tmp_path):
    for name, content in {"a.py": "x", "b.log": "y", "keep/b.log": "z", "node_modules/c.js": "n", "bin.dat": "a\0b", "late.dat": "\x10\nA\0"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    found = files.list_files(spark, str(tmp_path), ignore=["*.log", "!keep/b.log"])
    assert sorted(r["path"] for r in found.collect()) == ["a.py", "keep/b.log"]
    log = tmp_path / "log.jsonl"
    log.write_text(json.dumps({"kind": "search", "event_id": "1", "query": "q"}) + "\n\nnot json\n")
    assert files.read_log(spark, str(log)).count() == 1
    rows = spark.createDataFrame([("a/b",), ("../x",), ("/etc",)], "p string")
    assert [r[0] for r in rows.select(files.contained(F.col("p"))).collect()] == [True, False, False]
    assert spark.range(1).select(files.clean_sources(F.array(F.lit(" a"), F.lit("a"), F.lit(""), F.lit("b")))).first()[0] == ["a", "b"]
    assert spark.range(1).select(*[files.language(F.lit(f"x/y.{e}")) for e in ("PY", "sh", "kt", "toml", "swift", "rb")]).first()[:] == ("python", "shell", "kotlin", "toml", "swift", None)
    assert sorted(r["path"] for r in files.list_files(spark, str(tmp_path), include=["*.log", "a.*"]).collect()) == ["a.py", "b.log", "keep/b.log"]
    for name, content in {".gitignore": "*.tmp\n/top.txt", "sub/.gitignore": "top.txt\n!x.tmp", "top.txt": "1", "x.tmp": "1", "sub/top.txt": "1", "sub/x.tmp": "1", "sub/y.tmp": "1", "other/top.txt": "1"}.items():
        (tmp_path / "rules" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "rules" / name).write_text(content)
    rules = files.folder_rules(files.read_rules(spark, str(tmp_path / "rules")))
    assert sorted(r["path"] for r in files.list_files(spark, str(tmp_path / "rules"), ignore=rules, include=["*.txt", "*.tmp"]).collect()) == ["other/top.txt", "sub/x.tmp"]
    new = files.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "c")]
    blocks = files.block_offsets(spark.createDataFrame([("f", 0, "a\nb"), ("f", 1, "c")], "file_path string, block int, content string")).orderBy("block").collect()
    assert [(r["char_offset"], r["line_offset"]) for r in blocks] == [(0, 0), (3, 1)]


def test_logs_runs_and_corpora(spark, tmp_path):
    rows = spark.createDataFrame([(None, "search", "e", "q" * 3000), ("2024", "chat", "f", "x")], "ts string, kind string, event_id string, query string")
    files.append_log(rows, str(tmp_path / "log"))
    found = {r["event_id"]: r for r in files.read_log(spark, str(tmp_path / "log")).collect()}
    assert len(found["e"]["query"]) == 2000 and found["e"]["ts"] and found["f"]["ts"] == "2024"
    for started in (1, 2, 3):
        files.save_run(spark.createDataFrame([(f"r{started}", started, 0.5)], "run_id string, started_at int, mrr double"), str(tmp_path / "runs"))
    assert [r["run_id"] for r in files.latest_runs(spark.read.json(str(tmp_path / "runs")), 2).collect()] == ["r3", "r2"]
    files.write_corpus(spark.createDataFrame([("a", 1), ("b", 2)], "corpus_id string, n int"), str(tmp_path / "chunks"))
    files.write_corpus(spark.createDataFrame([("b", 3)], "corpus_id string, n int"), str(tmp_path / "chunks"))
    table = spark.read.parquet(str(tmp_path / "chunks"))
    assert sorted((r["corpus_id"], r["n"]) for r in table.collect()) == [("a", 1), ("b", 3)]
    assert files.without_corpus({"t": table}, "a")["t"].count() == 1
    files.split_named_texts(spark.createDataFrame([("x.txt", "one"), ("y.txt", " ")], "filename string, text string"), str(tmp_path / "named"))
    assert [p.name for p in (tmp_path / "named").iterdir() if p.is_dir()] == ["filename=x.txt"]
    (tmp_path / "data.json").write_text(json.dumps([{"question": "q", "expected_chunks": ["a"]}, {"entry_id": "no question"}]))
    assert [r["expected_paths"] for r in files.read_dataset(spark, str(tmp_path / "data.json")).collect()] == [["a"]]
    (tmp_path / "t.csv").write_text("a, b\n1,2\n")
    assert sorted(r["line"] for r in files.read_csv_lines(spark, str(tmp_path / "t.csv")).collect()) == ["1\t2", "a\tb"]
    assert files.read_texts(spark, str(tmp_path / "t.csv")).first()["content"] == "a, b\n1,2\n"


def test_filters(spark):
    rows = [("src/gen/a.py", "x"), ("src/a.min.js", "x"), ("src/b.py", "All Rights reserved"), ("src/c.py", None)]
    kept = spark.createDataFrame(rows, "p string, c string").where(~files.excluded(F.col("p"), F.col("c"), ["GEN/"], ["*.min.js", ""], ["rights"]))
    assert [r["p"] for r in kept.collect()] == ["src/c.py"]
    chunks = spark.createDataFrame([("f", 1, "a", '{"chunk_ordinal": "2"}'), ("f", 1, "b", '{"chunk_ordinal": ""}'), ("f", 1, "c", '{"chunk_ordinal": 1}'), ("f", 1, "d", None), ("g", 1, "e", '{"chunk_ordinal": 1}')], "file_path string, start_line int, chunk_id string, metadata string")
    assert [r["chunk_id"] for r in files.with_ordinals(chunks, "f", [1, 2]).collect()] == ["c", "a"]


def test_embedding_hooks(spark):
    import numpy as np
    import pandas as pd

    from siltstone.functions import tokenizer
    from siltstone.operators import embedding

    plain = tokenizer.TokenizerConfig()
    assert tokenizer.truncated("a b  c d", 2, plain) == "a b  " and tokenizer.truncated("a b c d e", 3, plain, "truncate_middle") == "a …d e"
    assert tokenizer.truncated("ﬁ A", 9, tokenizer.TokenizerConfig(lowercase=True)) == "fi a" and tokenizer.same_length("ﬁ A", tokenizer.TokenizerConfig(lowercase=True)) == "ﬁ a"
    assert tokenizer.count("abcde", tokenizer.TokenizerConfig("estimate")) == 2
    with pytest.raises(ValueError):
        tokenizer.truncated("a b", 1, plain, "error")
    rows = spark.createDataFrame([(1, "one two"), (2, None)], "id int, t string")
    config = embedding.EmbeddingConfig(dim=4, prefix="<", suffix=">")
    assert [r["prepared"] for r in embedding.prepare(rows, "t", config).orderBy("id").collect()] == ["<one two>", "<>"]
    given = embedding.embed(rows, "id", "t", lambda texts: np.array([[len(t), 0, 0, 1] for t in texts]), config).orderBy("id").collect()
    assert [r["embedding"] for r in given] == [[9, 0, 0, 1], [2, 0, 0, 1]]
    with pytest.raises(Exception, match="embeddings of shape"):
        embedding.embed(rows, "id", "t", lambda texts: np.zeros((len(texts), 3)), config).collect()
    text = "\n".join(f"w{i} x" for i in range(30))
    files_ = spark.createDataFrame([("c", "f", text), ("c", "g", "")], "corpus_id string, file_path string, content string")
    found = embedding.late_chunks(files_, config=embedding.EmbeddingConfig(dim=8), chunking=ChunkConfig(target_tokens=20, overlap_tokens=5)).collect()
    assert [r["chunk_ordinal"] for r in found] == [0, 1, 2, 3] and found[-1]["char_end"] == len(text)
    vectors = embedding.hashed_tokens(8)
    for r in found:
        assert r["start_line"] == 1 + text[: r["char_start"]].count("\n") and r["end_line"] == 1 + text[: r["char_end"]].count("\n")
        piece = text[r["char_start"] : r["char_end"]]
        mean = vectors(piece, tokenizer.token_spans(piece, plain)).mean(0)
        assert np.allclose(r["embedding"], mean / np.linalg.norm(mean)) and r["token_count"] == len(piece.split())
    hits_ = spark.createDataFrame([(1, "a", 0.5, 1, "q", "x"), (1, "b", 0.4, 2, "q", "q"), (2, "a", 0.5, 1, " ", "x")], "query_id int, chunk_id string, score double, rank int, question string, content string")
    order = lambda model: {(r["query_id"], r["rank"]): (r["chunk_id"], r["skipped_reason"]) for r in fusion.rerank(hits_, model).collect()}

    def failing(questions: pd.Series, texts: pd.Series) -> pd.Series:
        raise RuntimeError("no")

    assert order(fusion.overlap_reranker) == {(1, 1): ("b", None), (1, 2): ("a", None), (2, 1): ("a", "empty_query")}
    assert order(None)[(1, 1)] == ("a", "missing_model") and order(failing)[(1, 1)] == ("a", "error")


def brute_mmr(rows, k, lam):
    def similarity(a, b):
        if a[3] is not None and b[3] is not None:
            return sum(x * y for x, y in zip(a[3], b[3])) / math.sqrt(sum(x * x for x in a[3]) * sum(y * y for y in b[3]))
        x, y = set(a[2].split()), set(b[2].split())
        return len(x & y) / len(x | y)

    left, chosen = list(rows), []
    while left and len(chosen) < k:
        best = max(left, key=lambda r: (lam * r[1] - (1 - lam) * max([similarity(r, c) for c in chosen], default=0), -rows.index(r)))
        left.remove(best)
        chosen.append(best)
    return [r[0] for r in chosen]


def test_diversification_against_brute_force(spark):
    import random

    random.seed(2)
    for vectors in (False, True):
        rows = [(f"c{i}", round(1 - i / 40, 4), " ".join(random.choices(["aa", "bb", "cc", "dd", "ee"], k=4)), [random.random() - 0.5 for _ in range(3)] if vectors else None) for i in range(25)]
        hits_ = spark.createDataFrame([(1, c, s, i + 1, t, v) for i, (c, s, t, v) in enumerate(rows)], "query_id int, chunk_id string, score double, rank int, text string, embedding array<double>")
        found = fusion.mmr(hits_.withColumn("words", fusion.word_set(F.col("text"))), 8, 0.6).orderBy("rank").collect()
        assert [r["chunk_id"] for r in found] == brute_mmr(rows, 8, 0.6)


def test_config_and_engine(spark):
    from siltstone.engine import Engine

    assert stats.flat_config({"a": SearchConfig(), "b": {"c": 1}})["a.top_k"] == 50 and stats.flat_config({"b": {"c": 1}}) == {"b.c": 1}
    assert stats.patched(ChunkConfig(), {"size": 400}).size == 400
    with pytest.raises(ValueError):
        stats.patched(ChunkConfig(), {"size": 100})
    with pytest.raises(TypeError):
        stats.patched(ChunkConfig(), {"nothing": 1})
    rows = [("c", "f", "f:0", "red fox"), ("c", "g", "g:0", "blue fox"), ("d", "h", "h:0", "green")]
    chunks = spark.createDataFrame(rows, "corpus_id string, file_path string, chunk_id string, content string")
    vectors = spark.createDataFrame([("c", "f:0", [1.0, 0.0]), ("d", "h:0", [0.0, 1.0])], "corpus_id string, chunk_id string, embedding array<double>")
    engine = Engine(sparse.index_of(chunks), chunks, vectors)
    asked, queries = spark.createDataFrame([(1, "red fox")], "query_id int, question string"), spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<double>")
    assert [r["chunk_id"] for r in engine.search(asked, queries).orderBy("rank").collect()][0] == "f:0"
    assert {r["chunk_id"] for r in engine.search(asked, mode="sparse").collect()} == {"f:0", "g:0"}
    assert {r["corpus_id"] for r in engine.search(asked, queries, corpora=["d"]).collect()} == {"d"}
    assert engine.answer(asked, mode="sparse").first()["context"].startswith("[1] f\nred fox")
    with pytest.raises(ValueError):
        engine.search(asked, mode="dense")
    assert "corpus_chunks" in engine.register_views() and spark.sql("SELECT count(*) FROM corpus_chunks").first()[0] == 3


def test_python_concepts_and_keys(spark):
    texts = spark.createDataFrame([("1", "Use `load_file` with ThingMaker; helper imported from tools.io")], "chunk_id string, content string")
    r = graph.docstring_concepts(texts).first()
    assert r["concepts"] == ["load_file", "ThingMaker"] and [tuple(x) for x in r["imports"]] == [("helper", "tools.io")]
    more = spark.createDataFrame([("1", "a imported from x.y, b imported from z. a imported from x.y and `Q` `Q`"), ("2", None)], "chunk_id string, content string")
    found = {r["chunk_id"]: (r["concepts"], [tuple(x) for x in r["imports"]]) for r in graph.docstring_concepts(more).collect()}
    assert found == {"1": (["Q"], [("a", "x.y"), ("b", "z")]), "2": ([], [])}


def brute_braces(text):
    """Top-level blocks by a recursive reading of code and templates, character by character."""
    blocks, opened = [], [None]

    def code(i, depth, inside):
        """From ``i`` to the brace that ends an expression of a template, or the end."""
        while i < len(text):
            c = text[i]
            if text.startswith("//", i):
                i = text.find("\n", i) if "\n" in text[i:] else len(text)
                continue
            if text.startswith("/*", i):
                end = text.find("*/", i + 2)
                i = end + 2 if end >= 0 else len(text)
                continue
            if c in "\"'":
                i += 1
                while i < len(text) and text[i] != c:
                    i += 2 if text[i] == "\\" else 1
                i += 1
                continue
            if c == "`":
                i = template(i + 1)
                continue
            if c == "{":
                if not depth and not inside:
                    opened[0] = text.rfind("\n", 0, i) + 1
                depth += 1
            elif c == "}":
                if not depth and inside:
                    return i + 1
                if depth:
                    depth -= 1
                    if not depth and not inside:
                        end = text.find("\n", i)
                        blocks.append((opened[0], end + 1 if end >= 0 else len(text)))
            i += 1
        return i

    def template(i):
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                i = code(i + 2, 0, True)
            else:
                i += 1
        return i

    code(0, 0, False)
    return blocks


def test_braces_inside_templates(spark):
    import random

    rng = random.Random(12)
    parts = ["{", "}", "`", "${", "}", "'", '"', "\\", "// ", "/* ", " */", "\n", "a ", "x.y()", "\n", "{\n", "}\n", "`a${b}c`", "'}'"]
    config = ChunkConfig(target_tokens=1, overlap_tokens=0)
    seen = 0
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        cuts = sorted({0, len(text), *(x for b in brute_braces(text) for x in b)})
        expected = chunking.recursive(text, config) if len(cuts) == 2 else chunking.packed(list(zip(cuts, cuts[1:])), text, 1)
        assert chunking.brace_blocks(text, config) == expected, text
        seen += len(cuts) > 2
    assert seen > 300
    nested = "function f() {\n  return `${a.map((x) => { return `${x}}`; })}`;\n}\nfunction g() {\n}\n"
    assert spans("braces", nested, target_tokens=8, overlap_tokens=0) == [nested[: nested.index("function g")], nested[nested.index("function g") :]]


def test_concept_extractors_fail_by_chunk(spark):
    def first_two(text):
        if "bad" in text:
            raise RuntimeError("no answer")
        return [" Alpha ", "", text.split()[0], "alpha"]

    graph.register_extractor("first_two", first_two)
    rows = spark.createDataFrame([("1", "Words here words"), ("2", "bad things things"), ("3", ""), ("4", None)], "chunk_id string, content string")
    found = sorted((r["chunk_id"], r["rank"], r["concept"], r["freq"]) for r in graph.concepts(rows, extractor="first_two").collect())
    assert found[:2] == [("1", 1, "alpha", 2), ("1", 2, "words", 1)] and [f for f in found if f[0] == "2"] == [("2", 1, "things", 2)]
    plain = sorted((r["chunk_id"], r["rank"], r["concept"], r["freq"]) for r in graph.concepts(rows).collect())
    assert plain == [("1", 1, "words", 2), ("1", 2, "here", 1), ("2", 1, "things", 2)]


def test_counters_that_start_again(spark):
    samples = [("a", 1.0, 10, 5), ("a", 1.0, 70, 9), ("a", 1.0, 130, 2), ("a", 2.0, 10, 5), ("a", 2.0, 70, 15), ("a", 2.0, 130, 4), ("b", 1.0, 60, 100), ("b", 2.0, 60, 100), ("b", 1.0, 200, 100), ("b", 2.0, 200, 103)]
    rows = spark.createDataFrame(samples, "series string, le double, s int, v int").withColumn("ts", F.timestamp_seconds("s"))
    gained = {(r["series"], r["le"], r["s"]): r["increase"] for r in stats.counter_increases(rows, ["series", "le"], "ts", "v").collect()}
    assert gained == {("a", 1.0, 10): 0, ("a", 1.0, 70): 4, ("a", 1.0, 130): 2, ("a", 2.0, 10): 0, ("a", 2.0, 70): 10, ("a", 2.0, 130): 4, ("b", 1.0, 60): 0, ("b", 2.0, 60): 0, ("b", 1.0, 200): 0, ("b", 2.0, 200): 3}
    found = stats.histogram_quantile(rows, ["series"], "le", "ts", "v", "1 hour", 0.5).collect()
    assert len(found) == 1 and math.isclose(found[0]["quantile"], 1 + (0.5 * 17 - 6) / 11)  # 6 up to 1.0, 11 between 1.0 and 2.0


def test_ignored_folders_are_never_listed(spark, tmp_path):
    top, log = tmp_path / "top", tmp_path / "log"
    for name, content in {
        ".gitignore": "*.tmp\nskip/\n/only_top.txt\n# note", "only_top.txt": "1", "a.tmp": "1", "a.txt": "1", "skip/b.txt": "1", "skip/deep/c.txt": "1", "node_modules/d.js": "1",
        "sub/.gitignore": "!x.tmp\ninner/\n", "sub/x.tmp": "1", "sub/y.tmp": "1", "sub/only_top.txt": "1", "sub/inner/e.txt": "1", "sub/ok/f.txt": "1", "other/inner/g.txt": "1", "big.txt": "x" * 100, "nul.bin": "a\0b",
    }.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(content)
    (top / "empty").mkdir()
    log.mkdir()

    def noted(root, folder):
        (log / (folder.replace("/", "+") or "top")).touch()
        return walk.list_with_arrow(root, folder)

    found = walk.walk(spark, str(top), ["empty_not/"], noted).collect()
    assert {p.name for p in log.iterdir()} == {"top", "sub", "sub+ok", "other", "other+inner", "empty"}
    assert {r["path"] for r in found if not r["is_folder"]} == {".gitignore", "a.txt", "sub/.gitignore", "sub/x.tmp", "sub/only_top.txt", "sub/ok/f.txt", "other/inner/g.txt", "big.txt", "nul.bin"}
    kept = {r["path"]: bytes(r["content"]) for r in walk.walk_files(spark, str(top), include=["*.txt", "*.bin"], max_bytes=50).collect()}
    assert kept == {"a.txt": b"1", "sub/only_top.txt": b"1", "sub/ok/f.txt": b"1", "other/inner/g.txt": b"1"}
    assert walk.walk(spark, str(top / "empty")).count() == 0


def test_bad_bytes_are_dropped(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a\xffb\xe6\x97c")), (2, None), (3, bytearray("\ufffd\u00e9".encode())), (4, bytearray())], "id int, content binary")
    assert {r["id"]: r["t"] for r in rows.select("id", files.decoded(F.col("content")).alias("t")).collect()} == {1: "abc", 2: None, 3: "\ufffd\u00e9", 4: ""}


def test_table_previews(spark):
    rows = spark.createDataFrame([(3, " c ", None, 1.5), (1, "a" * 30, "x", 2.5), (2, "", " ", None)], "id int, s string, t string, v double")
    text = lambda **k: files.table_as_text(rows, "id", **k).first()["text"]
    assert text(max_cell=5) == "--- row 0 ---\n\n[s]\naaaaa…\n\n[t]\nx\n\n\n--- row 2 ---\n\n[s]\nc"
    assert text(max_rows=1, max_cell=2) == "--- row 0 ---\n\n[s]\naa…\n\n[t]\nx\n\n… (truncated by max_rows)"
    assert text(max_chars=20) == "--- row 0 ---\n\n[s]\na\n\n… (truncated by max_chars)"
    assert "[v]\n2.5" in text(text_only=False) and "[" not in text(names=False)
    assert files.table_as_text(rows.limit(0), "id").first()["text"] == ""
    assert "[v]" in files.table_as_text(rows.select("id", "v"), "id").first()["text"]


def test_gate_overrides_and_switch(spark):
    rows = spark.createDataFrame([("hi", 0, "DEEP "), ("hi", 0, None), ("hi", 0, "often")], "message string, turn int, override string")
    assert [(r["intensity"], r["decided_by"], r["top_k"]) for r in recall.gate(rows).collect()] == [("deep", "user", 10), ("skip", "rules", None), ("skip", "rules", None)]
    assert {(r["intensity"], r["decided_by"]) for r in recall.gate(rows, RecallConfig(enabled=False, default_intensity="light")).collect()} == {("light", "gate off")}


def test_merged_maps_models_and_power(spark):
    m = spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"b": "3", "c": None}), (2, None, {"x": "y"}), (3, {"x": "y"}, None), (4, None, None), (5, {}, {})], "id int, old map<string,string>, new map<string,string>")
    found = {r["id"]: r["m"] for r in m.select("id", stats.merged(F.col("old"), F.col("new")).alias("m")).collect()}
    assert found == {1: {"a": "1", "b": "3", "c": None}, 2: {"x": "y"}, 3: {"x": "y"}, 4: None, 5: {}}
    catalog = spark.createDataFrame([("p", "m", ["EMB"]), ("p", "n", ["GEN", "EMB"]), ("q", "o", None)], "provider string, model string, components array<string>")
    assert sorted(r["model"] for r in stats.models_for(catalog, "emb").collect()) == ["m", "n"]
    with pytest.raises(ValueError):
        stats.models_for(catalog, "other")
    prices = spark.createDataFrame([("acme", "large", 0, 0.001, 0.002, None, None, None)], "provider string, model string, position int, input_per_1k double, output_per_1k double, embed_per_1k double, per_request double, rerank_per_1k double")
    asked = spark.createDataFrame([(1, "acme", "large", 1000, 0, 0, 0, 10, 0.5, 100.0, 2.0), (2, "acme", "large", 1000, 0, 0, 0, 10, 0.5, None, 2.0), (3, "no", "no", 1, 0, 0, 0, 1, None, 5.0, None)], "request_id int, provider string, model string, tokens_in int, tokens_out int, embeds int, reranks int, per_day int, kwh_rate double, watts double, hours_per_day double")
    got = {r["request_id"]: r for r in stats.cost(asked, prices).collect()}
    assert (got[1]["electricity_usd"], got[1]["daily_usd"], got[1]["monthly_usd"], got[1]["error"]) == (0.1, 0.11, 3.3, "")
    assert got[2]["daily_usd"] == 0.01 and got[2]["error"].startswith("Electricity") and got[3]["error"].count(";") == 1


def test_recall_gate_edges_of_words_are_those_of_sql(spark):
    """A question word that goes on with a letter beyond ASCII is one to SQL."""
    import duckdb

    said = ["Doíar ga. La en menteco un laciónasieñ del ñóllll.", "isñ el", "Doar ga la en menteco un la del", "the pläne ñthe idea of it all is one that I like", "what é", "whaté now", "do", "the ideaé of it all is one that we all like"]
    rows = spark.createDataFrame([(i, 1, m) for i, m in enumerate(said)], "conv_id int, turn int, message string")
    con = duckdb.connect()
    theirs = [con.execute(f"SELECT {recall.intensity_sql('m', '1')} FROM (SELECT ?::varchar AS m)", [m]).fetchone()[0] for m in said]
    assert [r["intensity"] for r in recall.gate(rows).orderBy("conv_id").collect()] == theirs


def test_last_hop_shuffles_no_pairs(spark, monkeypatch):
    edges = spark.createDataFrame([(f"g{i % 3}", f"m{i}", "contains") for i in range(60)] + [("g0", "m1", "contains"), ("top", "g0", "contains"), ("g1", "g2", "contains"), ("m1", "m1", "contains")], "source_id string, target_id string, relation_type string")
    seeds = spark.createDataFrame([(f"m{i}", f"m{i}") for i in range(0, 60, 7)] + [("alone", "alone"), ("pair", "m1"), ("pair", "m2")], "seed string, node string")
    near: dict[str, set[str]] = {}
    for r in edges.collect():
        near.setdefault(r["source_id"], set()).add(r["target_id"])
        near.setdefault(r["target_id"], set()).add(r["source_id"])
    for most, held in ((1, 500), (2, 500), (2, 5), (3, 500)):
        monkeypatch.setattr(graph, "HELD", held)
        expected: dict[tuple[str, str], int] = {}
        for r in seeds.collect():
            layer = {r["node"]}
            for h in range(most + 1):
                for n in layer:
                    expected[r["seed"], n] = min(h, expected.get((r["seed"], n), h))
                layer = {m for n in layer for m in near.get(n, ())}
        found = graph.hops(seeds, edges, most)
        assert "hashpartitioning(seed" not in found._jdf.queryExecution().executedPlan().toString()
        rows = [(r["seed"], r["node"], r["hops"]) for r in found.collect()]
        assert len(rows) == len(set(rows)) and {(s, n): h for s, n, h in rows} == expected


def test_spread_reads_its_edges_once(spark, monkeypatch):
    edges = [(f"g{i % 3}", f"m{i}") for i in range(40)] + [("top", "g0"), ("g0", "g1"), ("m1", "m1"), ("g0", "m0")]
    table = spark.createDataFrame([(a, b, "contains") for a, b in edges], "source_id string, target_id string, relation_type string")
    starts = {"m0": 0.9, "m5": 0.4, "alone": 1.0}
    best, layer = dict(starts), dict(starts)
    for h in (1, 2):
        beside: dict[str, float] = {}
        for a, b in [*edges, *[(b, a) for a, b in edges]]:
            if a in layer:
                beside[b] = max(layer[a], beside.get(b, 0.0))
        layer = beside
        for n, x in layer.items():
            best[n] = max(best.get(n, 0.0), x / (1 + h))
    rows = spark.createDataFrame([(n, x) for n, x in starts.items()], "node string, score double")
    for most_rows, hub in ((100, 10_000), (1, 10_000), (1, 5)):  # the front sent around, joined, joined with salts
        monkeypatch.setattr(graph, "MOST_ROWS", most_rows)
        found = graph.spread(rows, [], table, 2, hub=hub)
        assert "source_id" not in found._jdf.queryExecution().executedPlan().toString()  # edges are read from what was staged
        assert {r["node"]: round(r["score"], 9) for r in found.collect()} == {n: round(x, 9) for n, x in best.items()}


def test_tasks_of_dense_search_do_not_grow_with_vectors(spark):
    from siltstone.operators import dense

    rows = [("ab"[i % 2], i, [float(i % 7), float(i % 5), 1.0]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "corpus_id string, chunk_id long, embedding array<double>")
    asked = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    shown = lambda t: sorted((r["query_id"], r["corpus_id"], r["chunk_id"], r["score"]) for r in fusion.ranked_lists(t.withColumn("leg", F.lit("vector"))).where("rank <= 3").collect())
    found = dense.nearest(vectors.repartition(60), asked, 3)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert shown(found) == shown(dense.nearest(vectors.coalesce(1), asked, 3))
