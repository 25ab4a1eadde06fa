"""Graph and chunk queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..operators import chunking, dense, graph
from ..operators.joins import small
from ..operators.numbering import numbered
from ..sources import tables as T
from .linked import LINKS_SQL as LINKED_SQL, links
from .registry import query
from .search import COSINE_SQL, nearest_of_all

LINKS_SQL = f"{T.CHUNKS_SQL}, {LINKED_SQL}"
WALK_SQL = f"""{T.GRAPH_SQL}, both_ways AS (SELECT source_id AS src, target_id AS dst FROM relationships UNION SELECT target_id, source_id FROM relationships)"""


def walk_sql(seeds: str, most: int = 2) -> str:
    """Nodes by least hops in unrolled joins from a table (seed, node)."""
    return f"""h0 AS ({seeds}), h1 AS (SELECT DISTINCT seed, dst AS node FROM h0 JOIN both_ways ON node = src), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN both_ways ON node = src
), walked AS (SELECT seed, node, min(hops) AS hops FROM (SELECT seed, node, 0 AS hops FROM h0 UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) WHERE hops <= {most} GROUP BY ALL)"""


#: Stated entities: the suppliers and customers whose number is divisible by 100.
STATED_SQL = "SELECT entity_id, name FROM entities WHERE split_part(entity_id, ':', 1) IN ('supplier', 'customer') AND split_part(entity_id, ':', 2)::bigint % 100 = 0"


def stated(spark: SparkSession, sf: str) -> DataFrame:
    kind, number = F.split_part("entity_id", F.lit(":"), F.lit(1)), F.split_part("entity_id", F.lit(":"), F.lit(2)).cast("bigint")
    return T.entities(spark, sf).where(kind.isin("supplier", "customer") & (number % 100 == 0)).select("entity_id", "name")


@query(f"WITH {WALK_SQL}, {walk_sql(f'SELECT entity_id AS seed, entity_id AS node FROM ({STATED_SQL})')} SELECT seed, node, hops::int AS hops FROM walked")
def entity_hops(spark: SparkSession, sf: str) -> DataFrame:
    seeds = stated(spark, sf).select(F.col("entity_id").alias("seed"), F.col("entity_id").alias("node"))
    return graph.hops(seeds, T.relationships(spark, sf), 2)


@query(f"""WITH {T.GRAPH_SQL}, both_ways AS (SELECT source_id AS src, target_id AS dst FROM relationships WHERE relation_type = 'contains' UNION SELECT target_id, source_id FROM relationships WHERE relation_type = 'contains'
), {walk_sql(f'SELECT entity_id AS seed, entity_id AS node FROM ({STATED_SQL})')} SELECT seed, node, hops::int AS hops FROM walked""")
def entity_hops_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Hops over one type of relation."""
    seeds = stated(spark, sf).select(F.col("entity_id").alias("seed"), F.col("entity_id").alias("node"))
    return graph.hops(seeds, T.relationships(spark, sf), 2, ["contains"])


@query(f"WITH {T.GRAPH_SQL} SELECT entity_id, name, entity_type FROM entities WHERE entity_type = 'class' AND contains(lower(name), '1') ORDER BY name, entity_id LIMIT 25")
def entity_list(spark: SparkSession, sf: str) -> DataFrame:
    found = T.entities(spark, sf).where((F.col("entity_type") == "class") & F.contains(F.lower("name"), F.lit("1")))
    return found.select("entity_id", "name", "entity_type").orderBy("name", "entity_id").limit(25)


@query(f"WITH {T.GRAPH_SQL} SELECT source_id, target_id, relation_type, weight FROM relationships WHERE source_id IN (SELECT entity_id FROM ({STATED_SQL}))")
def entity_relationships(spark: SparkSession, sf: str) -> DataFrame:
    asked = small(stated(spark, sf).select(F.col("entity_id").alias("source_id")))
    return T.relationships(spark, sf).join(asked, "source_id", "left_semi").select("source_id", "target_id", "relation_type", "weight")


SEARCH_SQL = f"""{WALK_SQL}, asked AS (SELECT entity_id AS query_id, lower(name) AS token FROM ({STATED_SQL})
), {walk_sql('SELECT DISTINCT query_id AS seed, entity_id AS node FROM entities JOIN asked ON contains(lower(name), token)')}, ranked_entities AS (
  SELECT w.seed AS query_id, e.entity_id, e.name, w.hops, CASE WHEN w.hops = 0 THEN 1::double ELSE 0.7::double END / (1 + w.hops) AS score,
         row_number() OVER (PARTITION BY w.seed ORDER BY (w.hops = 0) DESC, w.hops, e.name, e.entity_id) AS rank
  FROM walked w JOIN entities e ON e.entity_id = w.node), found AS (SELECT * FROM ranked_entities WHERE rank <= 30)"""


def searched(spark: SparkSession, sf: str) -> DataFrame:
    """What is near the stated entities, asked for by their names."""
    asked = stated(spark, sf).select(F.col("entity_id").alias("query_id"), F.col("name").alias("question"))
    return graph.entity_search(T.entities(spark, sf), T.relationships(spark, sf), asked)


@query(f"WITH {SEARCH_SQL} SELECT query_id, entity_id, name, hops::int AS hops, round(score, 6) AS score, rank::int AS rank FROM found")
def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf).select("query_id", "entity_id", "name", "hops", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {SEARCH_SQL}, {LINKS_SQL} SELECT query_id, chunk_id, round(max(score), 6) AS score FROM found JOIN links USING (entity_id) GROUP BY ALL")
def entity_chunk_search(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entity_chunks(searched(spark, sf), links(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {WALK_SQL}, {LINKS_SQL}, seeds AS (SELECT chunk_id, 1 / (1 + chunk_ordinal)::double AS score FROM chunks WHERE doc_id % 100 = 0
), start_at AS (SELECT entity_id, max(score) AS seed_score FROM seeds JOIN links USING (chunk_id) GROUP BY entity_id
), {walk_sql('SELECT entity_id AS seed, entity_id AS node FROM start_at')}
SELECT l.chunk_id, round(max(s.seed_score / (1 + w.hops)), 6) AS score FROM walked w JOIN start_at s ON s.entity_id = w.seed JOIN links l ON l.entity_id = w.node GROUP BY l.chunk_id""")
def expand_via_entities(spark: SparkSession, sf: str) -> DataFrame:
    seeds = T.places(spark, sf).where("doc_id % 100 = 0").select("chunk_id", (F.lit(1.0) / (1 + F.col("chunk_ordinal"))).alias("score"))
    return graph.expand_chunks(seeds, links(spark, sf), T.relationships(spark, sf), 2).withColumn("score", F.round("score", 6))


@query(f"""WITH {WALK_SQL}, {walk_sql("SELECT 'supplier:1' AS seed, 'supplier:1' AS node")}, nodes AS (SELECT node FROM walked JOIN entities ON entity_id = node ORDER BY hops, name, node LIMIT 201)
SELECT DISTINCT source_id, target_id, relation_type, weight FROM relationships WHERE source_id IN (SELECT node FROM nodes) AND target_id IN (SELECT node FROM nodes)""")
def neighbor_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.subgraph("supplier:1", T.entities(spark, sf), T.relationships(spark, sf), 2, 200)[1]


@query(f"WITH {T.GRAPH_SQL} SELECT coalesce(nullif(split_part(file_path, '/', 1), ''), '(root)') AS community, count(*) AS size, min(entity_id) AS first_member FROM entities GROUP BY 1")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.communities(T.entities(spark, sf)).groupBy("community")
    return found.agg(F.count("*").alias("size"), F.min("entity_id").alias("first_member")).orderBy(F.desc("size"), "community")


@query(f"WITH {T.GRAPH_SQL} SELECT entity_id, split_part(file_path, '/', 1) AS community FROM entities WHERE split_part(file_path, '/', 1) = 'geo'")
def community_members(spark: SparkSession, sf: str) -> DataFrame:
    return graph.communities(T.entities(spark, sf)).where("community = 'geo'")


@query(f"WITH {T.GRAPH_SQL} SELECT 'entity' AS what, entity_type AS kind, count(*) AS n FROM entities GROUP BY ALL UNION ALL SELECT 'relation', relation_type, count(*) FROM relationships GROUP BY ALL")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_stats(T.entities(spark, sf), T.relationships(spark, sf))


WRITES_SQL = f"""{T.GRAPH_SQL}, writes AS (
  SELECT *, 1 AS written FROM relationships UNION ALL SELECT source_id, target_id, relation_type, weight / 2, 2 FROM relationships WHERE relation_type = 'contains'
  UNION ALL SELECT source_id, target_id, 'likes', weight, 3 FROM relationships UNION ALL SELECT source_id, 'gone:1', relation_type, weight, 3 FROM relationships UNION ALL SELECT source_id, target_id, relation_type, 7, 0 FROM relationships)"""


@query(f"""WITH {WRITES_SQL} SELECT source_id, target_id, relation_type, arg_max(least(greatest(weight, 0), 1), written) AS weight FROM writes
WHERE relation_type <> 'likes' AND source_id IN (SELECT entity_id FROM entities) AND target_id IN (SELECT entity_id FROM entities) GROUP BY ALL""")
def relationship_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Edges written up to three times, the later writes smaller; some of an unknown type or to an unknown end."""
    e = T.relationships(spark, sf)
    columns = ["source_id", "target_id", "relation_type", "weight"]
    write = lambda t, n: t.select(*columns, F.lit(n).alias("written"))
    writes = write(e, 1).union(write(e.where("relation_type = 'contains'").withColumn("weight", F.col("weight") / 2), 2))
    writes = writes.union(write(e.withColumn("relation_type", F.lit("likes")), 3)).union(write(e.withColumn("target_id", F.lit("gone:1")), 3)).union(write(e.withColumn("weight", F.lit(7.0)), 0))
    return graph.valid_edges(T.entities(spark, sf), writes, "written")


@query(f"""WITH {T.GRAPH_SQL}, members AS (SELECT entity_id, name FROM entities WHERE split_part(file_path, '/', 1) = 'geo' ORDER BY name, entity_id LIMIT 20)
SELECT DISTINCT source_id, target_id, relation_type, weight FROM relationships WHERE source_id IN (SELECT entity_id FROM members) AND target_id IN (SELECT entity_id FROM members)""")
def community_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The subgraph of the first twenty members of a community."""
    entities = T.entities(spark, sf)
    return graph.community_subgraph("geo", graph.communities(entities), entities, T.relationships(spark, sf), 20)[1]


@query(f"""WITH {T.GRAPH_SQL}, {T.CHUNKS_SQL}, given AS (SELECT 'part:' || doc_id AS entity_id, chunk_id FROM chunks UNION ALL SELECT 'gone:' || doc_id, chunk_id FROM chunks UNION ALL SELECT 'part:1', 'nowhere' FROM chunks)
SELECT DISTINCT entity_id, chunk_id FROM given WHERE entity_id IN (SELECT entity_id FROM entities) AND chunk_id IN (SELECT chunk_id FROM chunks)""")
def explicit_entity_links(spark: SparkSession, sf: str) -> DataFrame:
    chunks = T.chunks(spark, sf)
    name = lambda kind: F.concat(F.lit(kind + ":"), F.col("doc_id").cast("string")).alias("entity_id")
    given = chunks.select(name("part"), "chunk_id").union(chunks.select(name("gone"), "chunk_id")).union(chunks.select(F.lit("part:1"), F.lit("nowhere")))
    return graph.explicit_links(given, T.entities(spark, sf), chunks)


@query(f"""WITH {T.CHUNKS_SQL}, spans AS (SELECT file_path, file_path || '#' || k AS entity_id, 2 * k + 1 AS start_line, 2 * k + 3 AS end_line FROM files, (SELECT unnest(range(0, 10)) AS k))
SELECT entity_id, chunk_id FROM spans s JOIN chunks c USING (file_path) WHERE NOT (c.end_line < s.start_line OR c.start_line > s.end_line)""")
def span_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    spans = T.files(spark, sf).select("file_path", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    spans = spans.select("file_path", F.concat_ws("#", "file_path", F.col("k").cast("string")).alias("entity_id"), (2 * F.col("k") + 1).alias("start_line"), (2 * F.col("k") + 3).alias("end_line"))
    return graph.span_links(spans, T.chunks(spark, sf))


CONCEPTS_SQL = f"""{T.CHUNKS_SQL}, named AS (SELECT chunk_id, lower(unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{2,63}}'))) AS concept FROM chunks
), concepts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY freq DESC, concept) AS rank FROM (
  SELECT chunk_id, concept, count(*) AS freq FROM named WHERE length(concept) >= 4 AND concept NOT IN ({', '.join(repr(w) for w in graph.CONCEPT_STOPWORDS)}) GROUP BY ALL)) WHERE rank <= 8)"""


@query(f"WITH {CONCEPTS_SQL} SELECT chunk_id, concept, freq, rank::int AS rank FROM concepts")
def concept_extract(spark: SparkSession, sf: str) -> DataFrame:
    return graph.concepts(T.chunks(spark, sf))


@query(f"""WITH {CONCEPTS_SQL} SELECT r.concept AS source, o.concept AS target, 'related_to' AS relation_type, 0.5::double AS weight, count(*) AS n_chunks
FROM concepts r JOIN concepts o USING (chunk_id) WHERE r.rank = 1 AND o.rank > 1 GROUP BY ALL""")
def concept_star_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.concept_star(graph.concepts(T.chunks(spark, sf)))


@query(f"""WITH {CONCEPTS_SQL.replace("FROM chunks\n), concepts", "FROM budget\n), concepts").replace("named AS (", "budget AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY file_path, chunk_ordinal) AS nth FROM chunks) WHERE nth <= 200), named AS (")}
SELECT DISTINCT sha1('concept|' || concept) AS entity_id, concept AS name, chunk_id FROM concepts""")
def concept_entity_links(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts of the first two hundred chunks of each corpus, which is the budget, linked to their chunks."""
    return graph.concept_links(graph.concepts(graph.within_budget(T.chunks(spark, sf))))


@query(f"""WITH {COSINE_SQL}, seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10
), seqs AS (SELECT vec_id AS chunk_id, label AS corpus_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq FROM embeddings)
SELECT s.query_id, n.chunk_id, round(max(s.score) / (1 + min(abs(n.seq - a.seq))), 6) AS score FROM seeds s JOIN seqs a USING (chunk_id) JOIN seqs n ON n.corpus_id = a.corpus_id AND abs(n.seq - a.seq) <= 1 GROUP BY ALL""")
def chunk_sequence_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.vectors(spark, sf).select("chunk_id", "corpus_id")
    seqs = numbered(rows, ["chunk_id"], F.floor(F.col("chunk_id") / 4096), "seq", ["corpus_id"])
    seeds = nearest_of_all(spark, sf, 10).select("query_id", "chunk_id", "score")
    return graph.sequence_neighbours(seeds, seqs, 1).withColumn("score", F.round("score", 6))


NAMES = r"\b[A-Z][a-z]{3,}"


def proper_names(text: str) -> list[str]:
    """Capitalised words; a text without any is refused."""
    found = list(dict.fromkeys(re.findall(NAMES, text)))
    if not found:
        raise ValueError("no names")
    return found


graph.register_extractor("proper_names", proper_names)


@query(f"""WITH {CONCEPTS_SQL}, given AS (SELECT chunk_id, list_transform(regexp_extract_all(content, '{NAMES}'), lambda w: lower(w)) AS ns FROM chunks
), each AS (SELECT chunk_id, list_filter(ns, lambda x, i: list_position(ns, x) = i)[1:8] AS ns FROM given WHERE len(ns) > 0)
SELECT chunk_id, concept, freq, rank::int AS rank FROM concepts WHERE chunk_id NOT IN (SELECT chunk_id FROM each)
UNION ALL SELECT chunk_id, unnest(ns), 1::bigint, generate_subscripts(ns, 1)::int FROM each""")
def concept_extract_names(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts by a second extractor, with identifiers for the chunks that it refuses."""
    return graph.concepts(T.chunks(spark, sf), extractor="proper_names")


def _key(kind: str, name: str) -> str:
    return f"sha1('suppliers|' || path || '|{kind}|' || {name})"


SYNTAX_SQL = f"""WITH f AS (SELECT 'src/s' || s_suppkey || '.py' AS path, 'Supplier' || s_suppkey AS c FROM supplier), d AS (SELECT *, unnest(range(25)) AS i FROM f), facts(path, record, kind, id, name, target, start_line, end_line) AS (
  SELECT path, 'entity', 'module', {_key('module', 'path')}, path, NULL, 1, 134 FROM f
  UNION ALL SELECT path, 'relation', 'imports', {_key('module', 'path')}, 'os', {_key('module', "'os'")}, 1, 1 FROM f UNION ALL SELECT path, 'relation', 'imports', {_key('module', 'path')}, 'json.loads', {_key('module', "'json.loads'")}, 2, 2 FROM f
  UNION ALL SELECT path, 'entity', 'class', {_key('class', 'c')}, c, NULL, 5, 7 FROM f UNION ALL SELECT path, 'relation', 'contains', {_key('module', 'path')}, c, {_key('class', 'c')}, 5, 5 FROM f
  UNION ALL SELECT path, 'entity', 'function', {_key('function', "c || '.load'")}, c || '.load', NULL, 6, 7 FROM f UNION ALL SELECT path, 'relation', 'contains', {_key('class', 'c')}, c || '.load', {_key('function', "c || '.load'")}, 6, 6 FROM f
  UNION ALL SELECT path, 'entity', 'function', {_key('function', "'part_' || i")}, 'part_' || i, NULL, 9 + 5 * i, 12 + 5 * i FROM d
  UNION ALL SELECT path, 'relation', 'contains', {_key('module', 'path')}, 'part_' || i, {_key('function', "'part_' || i")}, 9 + 5 * i, 9 + 5 * i FROM d)
SELECT 'suppliers' AS corpus_id, path AS file_path, record, kind, id, name, target, start_line::int AS start_line, end_line::int AS end_line FROM facts"""


@query(SYNTAX_SQL)
def python_ast_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and relations of the modules made for the suppliers."""
    return graph.python_graph(python_files(spark, sf))


DOCS_SQL = """docs AS (SELECT s_suppkey AS chunk_id, 'Class SupplierOrder uses `part.Key` and `part.Key`. Found `' || lower(n_name) || '` and TradeNation' || s_suppkey || '. '
  || n_name || ' imported from geo.nations. load_' || s_suppkey || ' imported from trade.parts_' || (s_suppkey % 7) || ' and ' || n_name || ' imported from geo.nations' AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"""WITH {DOCS_SQL}, named AS (SELECT chunk_id, list_concat(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_.]*)`', 1), regexp_extract_all(content, '\\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\\b', 1)) AS cs,
  regexp_extract_all(content, '\\b[A-Za-z_][A-Za-z0-9_.]* imported from [A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z0-9_]+)*') AS ms FROM docs)
SELECT chunk_id, array_to_string(list_filter(cs, lambda x, i: list_position(cs, x) = i), ',') AS concepts, array_to_string(list_transform(list_filter(ms, lambda x, i: list_position(ms, x) = i), lambda x: replace(x, ' imported from ', '<')), ',') AS imports FROM named""")
def docstring_concept_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names and imports in a text made for each supplier."""
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    made = F.format_string(
        "Class SupplierOrder uses `part.Key` and `part.Key`. Found `%s` and TradeNation%d. %s imported from geo.nations. load_%d imported from trade.parts_%d and %s imported from geo.nations",
        F.lower("n_name"), "s_suppkey", "n_name", "s_suppkey", F.col("s_suppkey") % 7, "n_name",
    )
    texts = T.table(spark, sf, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("chunk_id"), made.alias("content"))
    found = graph.docstring_concepts(texts)
    shown = F.transform("imports", lambda x: F.concat(x["name"], F.lit("<"), x["source"]))
    return found.select("chunk_id", F.array_join("concepts", ",").alias("concepts"), F.array_join(shown, ",").alias("imports"))


# Chunks


@query(f"WITH {T.CHUNKS_SQL} SELECT chunk_id, chunk_ordinal, char_start, char_end, token_count, md5(content) AS content_md5 FROM chunks")
def chunk_fixed_chars(spark: SparkSession, sf: str) -> DataFrame:
    return T.chunks(spark, sf).select("chunk_id", "chunk_ordinal", "char_start", "char_end", "token_count", F.md5("content").alias("content_md5"))


@query(f"WITH {T.CHUNKS_SQL} SELECT chunk_id, start_line, end_line FROM chunks")
def chunk_line_spans(spark: SparkSession, sf: str) -> DataFrame:
    return T.chunks(spark, sf).select("chunk_id", "start_line", "end_line")


@query(f"""WITH {T.FILES_SQL}, s AS (SELECT file_path, content, unnest(range(0, (CASE WHEN length(content) > 2048 THEN (length(content) - 2048 + 1791) // 1792 ELSE 0 END) * 1792 + 1, 1792)) AS char_start FROM files)
SELECT file_path, (char_start // 1792)::int AS chunk_ordinal, char_start::int AS char_start, ((length(substr(content, char_start + 1, 2048)) + 3) // 4)::int AS token_count, md5(substr(content, char_start + 1, 2048)) AS piece_md5 FROM s""")
def chunk_estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.estimated_token_windows(T.files(spark, sf))


def markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with a heading on top and one before each further line."""
    content = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.replace("content", F.lit("\n"), F.lit("\n\n## More\n\n")))
    return T.files(spark, sf).withColumn("content", content)


def question_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with every sentence on a line of its own, questions and answers by turns."""
    lines = F.filter(F.split(F.regexp_replace("content", r"([.!?])[ \t\n\r\f]+", "$1\u0001"), "\u0001"), lambda x: x != "")
    return T.files(spark, sf).withColumn("content", F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i % 2 == 0, "Q: ").otherwise("A: "), x)), "\n"))


QUESTION_FILES_SQL = f"""{T.FILES_SQL.replace("files AS", "plain_files AS")}, files AS (
  SELECT corpus_id, file_path, doc_id, array_to_string(list_transform(ls, lambda x, i: CASE WHEN i % 2 = 1 THEN 'Q: ' ELSE 'A: ' END || x), chr(10)) AS content
  FROM (SELECT *, list_filter(string_split(regexp_replace(content, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ls FROM plain_files))"""


def brace_files(spark: SparkSession, sf: str) -> DataFrame:
    """A source for each supplier: a class with its nation's name and functions with templates, braces in them and regular expressions."""
    s, n = T.table(spark, sf, "supplier"), T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    made = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.format_string(
        "function part%d(rows) {\n  // } %s\n  const all = rows.map((r) => { return `${r.map((x) => { return `${x}}`; }).join('}')}`; });\n  return /[}/]/.test(all) ? '{' : `\\`${all}`;\n}\n", i, F.col("s_name")))
    head = F.format_string("/* { */\nclass Supplier%d {\n  nation() { return \"%s }\"; }\n}\n", "s_suppkey", "n_name")
    path = F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".js"))
    return s.join(F.broadcast(n), "s_nationkey").select(F.lit("suppliers").alias("corpus_id"), path.alias("file_path"), F.concat(head, F.array_join(made, "")).alias("content"))


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    """A module for each supplier: imports, a class and functions named after parts."""
    s = T.table(spark, sf, "supplier")
    made = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.format_string("def part_%d(rows):\n    \"\"\"Rows of %s.\"\"\"\n    found = [r for r in rows if r]\n    return sorted(found)\n\n", i, F.col("s_name")))
    head = F.format_string("import os\nfrom json import loads\n\n\nclass Supplier%d:\n    def load(self):\n        return loads('1')\n\n", "s_suppkey")
    path = F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    return s.select(F.lit("suppliers").alias("corpus_id"), path.alias("file_path"), F.concat(head, F.array_join(made, "")).alias("content"))


def packed_sql(files: str, unit: str, lines: int = 0) -> str:
    """Units that tile a text, joined while they fit 128 estimated tokens, blank and short ones left out; with ``lines`` of
    context on both sides."""
    before, offset = "length({0}) - length(replace({0}, chr(10), ''))", "(length(array_to_string(ls[1:{0}], chr(10))) + ({0} > 0)::int)"
    first = f"greatest(0, {before.format('substr(content, 1, s::bigint)')} - {lines})"
    last = f"least(len(ls), {before.format('substr(content, 1, (e - 1)::bigint)')} + {lines} + 1)"
    widened = f"SELECT file_path, content, n, {offset.format('l1')} AS s, CASE WHEN l2 = len(ls) THEN length(content) ELSE {offset.format('l2')} END AS e FROM (SELECT *, {first} AS l1, {last} AS l2 FROM (SELECT *, string_split(content, chr(10)) AS ls FROM filled))"
    return f"""WITH RECURSIVE {files}, units AS MATERIALIZED (SELECT corpus_id, file_path, content, {unit} AS us FROM files
), ends AS MATERIALIZED (
  SELECT file_path, nth, sum(length(u)) OVER (PARTITION BY file_path ORDER BY nth)::bigint AS e FROM (SELECT file_path, unnest(us) AS u, generate_subscripts(us, 1) AS nth FROM units)
), cut(file_path, s, e, made) AS (
  SELECT file_path, 0::bigint, coalesce(max(CASE WHEN e <= 512 THEN e END), min(e)), true FROM ends GROUP BY file_path
  UNION ALL SELECT c.file_path, c.e, coalesce(max(CASE WHEN n.e <= c.e + 512 THEN n.e END), min(n.e)), true FROM cut c JOIN ends n ON n.file_path = c.file_path AND n.e > c.e GROUP BY c.file_path, c.e
), pieces AS (SELECT c.file_path, c.s, c.e, u.content, substr(u.content, (c.s + 1)::bigint, (c.e - c.s)::bigint) AS piece FROM cut c JOIN units u USING (file_path)
), filled AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS n FROM pieces WHERE trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), placed AS ({widened if lines else 'SELECT * FROM filled'})
SELECT file_path, (row_number() OVER (PARTITION BY file_path ORDER BY s, e) - 1)::int AS chunk_ordinal, s::int AS char_start, e::int AS char_end,
       (1 + s - length(replace(substr(content, 1, s::bigint), chr(10), '')))::int AS start_line, (1 + e - length(replace(substr(content, 1, e::bigint), chr(10), '')))::int AS end_line
FROM placed WHERE n = 1 OR e - s >= 50"""


SENTENCE_UNIT = "regexp_extract_all(content, '(?s).+?(?:[.!?][ \t\n\r\f\v]+|$)')"
QUESTION_UNIT = "list_transform(string_split(replace(content, chr(10) || 'Q:', chr(10) || chr(1) || 'Q:'), chr(1)), lambda x: x)"


def _function_sql() -> str:
    """The text of one function of `brace_files`, number ``i``."""
    code = "function part@(rows) {\n  // } #\n  const all = rows.map((r) => { return `${r.map((x) => { return `${x}}`; }).join('}')}`; });\n  return /[}/]/.test(all) ? '{' : `\\`${all}`;\n}\n"
    return "'" + code.replace("'", "''").replace("\n", "' || chr(10) || '").replace("@", "' || i || '").replace("#", "' || s_name || '") + "'"


BRACE_FILES_SQL = f"""files AS (SELECT 'suppliers' AS corpus_id, 'src/s' || s_suppkey || '.js' AS file_path, parts, array_to_string(parts, '') AS content FROM (
  SELECT s_suppkey, list_concat(['/* {{ */' || chr(10), 'class Supplier' || s_suppkey || ' {{' || chr(10) || '  nation() {{ return "' || n_name || ' }}"; }}' || chr(10) || '}}' || chr(10)], fs) AS parts
  FROM (SELECT s_suppkey, list({_function_sql()} ORDER BY i) AS fs FROM supplier, (SELECT unnest(range(25)) AS i) GROUP BY s_suppkey) JOIN supplier USING (s_suppkey) JOIN nation ON s_nationkey = n_nationkey))"""

PYTHON_FILES_SQL = """files AS (SELECT 'suppliers' AS corpus_id, 'src/s' || s_suppkey || '.py' AS file_path, parts, array_to_string(parts, '') AS content FROM (
  SELECT s_suppkey, list_concat(list_concat(['import os' || chr(10), 'from json import loads' || chr(10), chr(10) || chr(10) || 'class Supplier' || s_suppkey || ':' || chr(10) || '    def load(self):' || chr(10) || '        return loads(''1'')' || chr(10)], fs), [chr(10)]) AS parts
  FROM (SELECT s_suppkey, list(chr(10) || 'def part_' || i || '(rows):' || chr(10) || '    \"\"\"Rows of ' || s_name || '.\"\"\"' || chr(10) || '    found = [r for r in rows if r]' || chr(10) || '    return sorted(found)' || chr(10) ORDER BY i) AS fs
        FROM supplier, (SELECT unnest(range(25)) AS i) GROUP BY s_suppkey)))"""

TOKENS_SQL = f"""WITH {T.FILES_SQL}, units AS (SELECT file_path, content, length(content) - length(ltrim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lead, regexp_extract_all(content, '[^ \t\n\r\f\v]+[ \t\n\r\f\v]*') AS us FROM files
), placed AS (SELECT file_path, len(us) AS n, nth, (lead + sum(length(u)) OVER x - length(u))::bigint AS s, (lead + sum(length(u)) OVER x - length(u) + length(rtrim(u, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))::bigint AS e
  FROM (SELECT file_path, lead, us, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS nth FROM units) WINDOW x AS (PARTITION BY file_path ORDER BY nth)
), cut AS (SELECT file_path, n, unnest(range(0, CASE WHEN n > 128 THEN (n - 128 + 111) // 112 ELSE 0 END + 1)) AS w FROM (SELECT DISTINCT file_path, n FROM placed)
), spans AS (SELECT c.file_path, c.w, a.s, b.e, count(*) OVER (PARTITION BY c.file_path) AS windows FROM cut c JOIN placed a ON a.file_path = c.file_path AND a.nth = c.w * 112 JOIN placed b ON b.file_path = c.file_path AND b.nth = least(c.w * 112 + 128, c.n) - 1)
SELECT p.file_path, (row_number() OVER (PARTITION BY p.file_path ORDER BY w) - 1)::int AS chunk_ordinal, s::int AS char_start, e::int AS char_end,
       (1 + s - length(replace(substr(content, 1, s), chr(10), '')))::int AS start_line, (1 + e - length(replace(substr(content, 1, e), chr(10), '')))::int AS end_line
FROM spans p JOIN files f ON f.file_path = p.file_path WHERE windows = 1 OR e - s >= 50"""


def _split(strategy: str, files):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = chunking.split(files(spark, sf), strategy, ChunkConfig(target_tokens=128, overlap_tokens=16))
        return found.select("file_path", "chunk_ordinal", "char_start", "char_end", "start_line", "end_line")

    return run


for _name, _strategy, _files, _sql in (
    ("chunk_sentences", "sentence", T.files, packed_sql(T.FILES_SQL, SENTENCE_UNIT)), ("chunk_markdown", "markdown", markdown_files, None), ("chunk_recursive", "recursive", T.files, None),
    ("chunk_qa_blocks", "qa_blocks", question_files, packed_sql(QUESTION_FILES_SQL, QUESTION_UNIT)), ("chunk_fixed_tokens", "fixed_tokens", T.files, TOKENS_SQL),
    ("chunk_python_statements", "ast", python_files, packed_sql(PYTHON_FILES_SQL, "parts", ChunkConfig().ast_overlap_lines)), ("chunk_python_fallback", "ast", T.files, None), ("chunk_brace_blocks", "braces", brace_files, packed_sql(BRACE_FILES_SQL, "parts")),
):
    _run = _split(_strategy, _files)
    _run.__name__ = _name
    query(_sql)(_run)


@query(f"WITH {T.CHUNKS_SQL} SELECT * FROM (SELECT corpus_id, chunk_id AS src, lead(chunk_id) OVER (PARTITION BY corpus_id, file_path ORDER BY chunk_ordinal) AS dst FROM chunks) WHERE dst IS NOT NULL")
def next_chunk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.next_edges(T.chunks(spark, sf))


@query("""WITH said AS (SELECT conv_id, turn, role, string_split(regexp_replace(trim(text), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL
), kept AS (SELECT conv_id, turn, role, list_filter(ps, lambda p: trim(p) <> '') AS ps FROM said
), parts AS (SELECT conv_id, turn, role, unnest(range(0, len(ps))) AS part, ps FROM kept)
SELECT 'recall:' || conv_id || ':' || turn || ':' || part AS chunk_id, conv_id, role, ps[part + 1] AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part)::int AS line,
       len(list_filter(regexp_split_to_array(ps[part + 1], '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))::int AS token_count FROM parts""")
def recall_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.message_chunks(T.turns(spark, sf))
