"""Queries over files, logs and stored tables: what is read, left out, decoded, written and deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, mining
from ..sources import files as S
from ..sources import tables as T
from ..sources.shared import shared_dir
from . import linked
from .registry import query

#: Folders and extensions that the paths are made from.
FOLDERS = ["src", "docs/build", "node_modules/x", "keep", "tmp/a", "a/top", "top", ".git/objects"]
EXTENSIONS = ["py", "TSX", "md", "log", "yml", "unknown", "Rs"]
RULES = ["*.log", "!keep/*.log", "/top/", "tmp/", "# a note", "docs/**/*.md"]
GLOBS = ["*.py", "keep/*", "*[0-5].md"]
PATHS_SQL = f"""paths AS (SELECT doc_id, list_extract({FOLDERS}, (doc_id % {len(FOLDERS)} + 1)::int) || '/f' || doc_id || '.' || list_extract({EXTENSIONS}, (doc_id % {len(EXTENSIONS)} + 1)::int) AS path FROM documents)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, path): a made-up place for every document."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return T.table(spark, sf, "documents").select("doc_id", F.concat(pick(FOLDERS), F.lit("/"), name, F.lit("."), pick(EXTENSIONS)).alias("path"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LANGUAGE_SQL = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in S.LANGUAGES.items()) + " END"


@query(f"WITH {PATHS_SQL} SELECT doc_id, path, {LANGUAGE_SQL} AS language FROM paths")
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).select("doc_id", "path", S.language(F.col("path")).alias("language"))


def ignored_sql() -> str:
    out = "false"
    for negated, pattern in filter(None, map(S.rule_pattern, RULES)):
        out = f"CASE WHEN regexp_matches(path, {quoted(pattern)}) THEN {str(not negated).lower()} ELSE {out} END"
    return f"regexp_matches(path, {quoted(S.always_ignored())}) OR {out}"


@query(f"WITH {PATHS_SQL} SELECT doc_id, path FROM paths WHERE NOT ({ignored_sql()})")
def files_not_ignored(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).where(~S.ignore_predicate(F.col("path"), RULES))


GLOBS_SQL = " OR ".join(f"regexp_matches(path, {quoted('^' + S.glob_pattern(g) + '$')}) OR regexp_matches(regexp_extract(path, '[^/]*$'), {quoted('^' + S.glob_pattern(g) + '$')})" for g in GLOBS)


@query(f"WITH {PATHS_SQL} SELECT doc_id, path FROM paths WHERE {GLOBS_SQL}")
def files_included(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).where(S.included(F.col("path"), GLOBS))


@query("SELECT doc_id, doc_id % 5 = 0 AS binary_file, md5(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS text_md5 FROM documents WHERE text IS NOT NULL")
def decoded_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as bytes, a third with bytes that are no UTF-8 at the end, a fifth with a NUL, which is left out here."""
    d = T.table(spark, sf, "documents").where("text is not null")
    bad = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFE697"))).otherwise(F.unhex(F.lit("")))
    nul = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("0078"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode("text", "UTF-8"), nul, bad)
    return d.select("doc_id", S.has_nul(content).alias("binary_file"), F.md5(F.replace(S.decoded(content), F.lit("\0"), F.lit(""))).alias("text_md5"))


GIVEN_SQL = "given AS (SELECT doc_id, list_extract(['a/b', '../x', '/etc', 'C:/x', 'a/../b', 'a..b/c', '', 'x/..'], (doc_id % 8 + 1)::int) AS path FROM documents)"


@query(f"WITH {GIVEN_SQL} SELECT doc_id, path, path NOT IN ('../x', '/etc', 'C:/x', 'a/../b', 'x/..') AS inside FROM given")
def contained_paths(spark: SparkSession, sf: str) -> DataFrame:
    given = ["a/b", "../x", "/etc", "C:/x", "a/../b", "a..b/c", "", "x/.."]
    path = F.element_at(F.array(*map(F.lit, given)), (F.col("doc_id") % 8 + 1).cast("int"))
    return T.table(spark, sf, "documents").select("doc_id", path.alias("path")).withColumn("inside", S.contained(F.col("path")))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform([coalesce(source, ''), ' ' || coalesce(lang, '') || ' ', coalesce(source, '') || ' ', 'extra', ''], lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, array_to_string(list_filter(ss, lambda x, i: list_position(ss, x) = i), ',') AS sources FROM s""")
def cleaned_sources(spark: SparkSession, sf: str) -> DataFrame:
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    given = F.array(source, F.concat(F.lit(" "), lang, F.lit(" ")), F.concat(source, F.lit(" ")), F.lit("extra"), F.lit(""))
    return T.table(spark, sf, "documents").select("doc_id", F.array_join(S.clean_sources(given), ",").alias("sources"))


@query(f"""WITH {T.CHUNKS_SQL}, {T.GRAPH_SQL}, {linked.LINKS_SQL}, own AS (
  SELECT e.entity_id, c.file_path FROM entities e JOIN links l USING (entity_id) JOIN chunks c USING (chunk_id)
  UNION ALL SELECT entity_id, file_path FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM links)
), tops AS (SELECT entity_id, coalesce(nullif(split_part(file_path, '/', 1), ''), '(root)') AS community, count(*) AS n FROM own GROUP BY ALL)
SELECT entity_id, community FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, community) AS nth FROM tops) WHERE nth = 1""")
def linked_communities(spark: SparkSession, sf: str) -> DataFrame:
    """The folder that most chunks of an entity are in, or its own file where it has none."""
    entities = T.entities(spark, sf)
    known = linked.links(spark, sf).join(entities.select("entity_id"), "entity_id", "left_semi")
    return graph.communities(entities, known, T.places(spark, sf))


@query(f"""WITH {T.FILES_SQL}, named AS (SELECT doc_id, 'd' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE content END AS text FROM files
), given AS (SELECT trim(' q' || doc_id || ' ') AS query, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'd' || doc_id END AS positive, 'd' || (doc_id + 1) AS negative FROM documents
), kept AS (SELECT * FROM given WHERE positive <> ''
), met AS (SELECT k.query, p.text AS pt, n.text AS nt FROM kept k LEFT JOIN named p ON p.path = k.positive LEFT JOIN named n ON n.path = k.negative)
SELECT sum((pt IS NULL OR nt IS NULL)::int)::bigint AS missing, sum((pt IS NOT NULL AND nt IS NOT NULL AND (trim(pt) = '' OR trim(nt) = ''))::int)::bigint AS empty, sum((trim(coalesce(pt, '')) <> '' AND trim(coalesce(nt, '')) <> '')::int)::bigint AS kept,
  min(CASE WHEN trim(coalesce(pt, '')) <> '' AND trim(coalesce(nt, '')) <> '' THEN md5(query || pt || nt) END) AS least_md5 FROM met""")
def triplet_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Triplets of neighbouring documents with their texts, and what was rejected."""
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    texts = T.files(spark, sf).select(name(F.col("doc_id")).alias("path"), F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("content")).alias("text"))
    d = T.table(spark, sf, "documents").select("doc_id")
    given = d.select(F.concat(F.lit(" q"), F.col("doc_id").cast("string"), F.lit(" ")).alias("query"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise(name(F.col("doc_id"))).alias("positive"), name(F.col("doc_id") + 1).alias("negative"))
    kept, counts = mining.with_texts(mining.clean_triplets(given), texts)
    least = kept.agg(F.min(F.md5(F.concat("query", "positive_text", "negative_text"))).alias("least_md5"))
    return counts.crossJoin(least)  # a row each


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone-{name}/{uuid.uuid4().hex}"


@query("""WITH said AS (SELECT event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'search' ELSE 'feedback' END AS kind, 'page ' || user_id AS q FROM events)
SELECT kind, count(*) AS n, sum(length(q))::bigint AS chars, min(event_id::varchar) AS first_event FROM said GROUP BY kind""")
def log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log of JSON lines in two goes, among lines that are blank or broken, and read again."""
    path, event = _folder(spark, "log"), F.col("event_type")
    rows = T.table(spark, sf, "events").select(F.lit(None).cast("string").alias("ts"), F.when(event.isin("view", "signup"), "search").otherwise("feedback").alias("kind"), F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("page "), F.col("user_id").cast("string")).alias("query"))
    S.append_log(rows.where("cast(event_id as bigint) % 2 = 0"), path)
    S.append_log(rows.where("cast(event_id as bigint) % 2 = 1"), path)
    spark.range(3).select(F.element_at(F.array(F.lit(""), F.lit("{broken"), F.lit("not json")), (F.col("id") + 1).cast("int")).alias("value")).write.mode("append").text(path)
    return S.read_log(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("chars"), F.min("event_id").alias("first_event"))


@query("""SELECT 'run-' || user_id AS run_id, user_id AS started_at, count(*) AS n FROM events GROUP BY user_id ORDER BY user_id DESC, run_id LIMIT 20""")
def latest_saved_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run for each user, some written again, and the newest twenty of them."""
    path = _folder(spark, "runs")
    runs = T.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.col("user_id").alias("started_at"), "n")
    S.save_run(runs.withColumn("n", F.lit(0).cast("long")), path)
    S.save_run(runs, path)
    return S.latest_runs(spark.read.schema("started_at bigint, n bigint, run_id string").json(path)).select("run_id", "started_at", "n")


@query(f"WITH {T.CHUNKS_SQL} SELECT corpus_id, count(*) AS n, count(DISTINCT file_path) AS n_files FROM chunks WHERE corpus_id <> 'fr' GROUP BY corpus_id")
def corpus_written_and_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks written by corpus, one corpus written again, another deleted."""
    path, chunks = _folder(spark, "corpus"), T.places(spark, sf).select("corpus_id", "chunk_id", "file_path")
    S.write_corpus(chunks, path)
    S.write_corpus(chunks.where("corpus_id = 'en'"), path)
    left = S.without_corpus({"chunks": spark.read.parquet(path)}, "fr")["chunks"]
    return left.groupBy("corpus_id").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_files"))


@query("SELECT item_id % 10 || '.txt' AS filename, sum(length(text) + 1)::bigint AS chars FROM benchmark WHERE trim(text) <> '' GROUP BY 1")
def named_texts_split(spark: SparkSession, sf: str) -> DataFrame:
    """The passages written as text files by name and read again."""
    path = _folder(spark, "named")
    b = T.table(spark, sf, "benchmark").select(F.concat((F.col("item_id") % 10).cast("string"), F.lit(".txt")).alias("filename"), "text")
    S.split_named_texts(b, path)
    found = spark.read.text(path, wholetext=True)
    return found.groupBy("filename").agg(F.sum(F.length("value")).alias("chars"))

