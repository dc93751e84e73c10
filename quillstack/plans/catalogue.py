"""Registered queries of the document engine, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import geometry as geo
from quillstack.functions import ids
from quillstack.functions import markup as mk
from quillstack.functions import responses as rs
from quillstack.functions import status as st
from quillstack.functions import tables as tb
from quillstack.functions import texts as tx
from quillstack.operators import blocks as bl
from quillstack.operators import files as fi
from quillstack.operators import jobs as jo
from quillstack.operators import tree as tr
from quillstack.plans.registry import ORACLE_SQL, QUERIES, query
from quillstack.scratch import materialise
from quillstack.sources import binding as b
from quillstack.sources.binding import BLOCKS, EDGES, EVENTS, FILES, JOBS, LINES, LISTING, TREE
from quillstack.streaming import events as ev

LISTING_ONLY, BLOCKS_ONLY = LISTING.removeprefix(LINES + ", "), BLOCKS.removeprefix(LINES + ", ")
__all__ = ["ORACLE_SQL", "QUERIES"]

def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recognition results: some with error markers, blank, or with a model's own words."""
    k = F.col("doc_id") % 11
    text = F.when(k == 0, F.concat(F.lit("[Ошибка: timeout] "), "text")).when(k == 1, F.lit("[НеПовторяемая ошибка: context]")).when(k == 2, F.lit("  \n\t ")).when(
        k == 3, F.concat(F.lit("Let me see. I need to read it.\n"), "text")).when(k == 4, F.concat(F.lit("<div><img src='"), F.regexp_replace("text", "[<>]", ""), F.lit("'/></div>"))).when(
        k == 5, F.concat(F.lit('<table data-bbox="10 200 30 400"><tr><td>'), "text", F.lit("</td></tr></table>"))).otherwise(F.col("text"))
    return b.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("ocr_text"))


MARKED = r"""marked AS (SELECT doc_id, source, lang, CASE doc_id % 11 WHEN 0 THEN '[Ошибка: timeout] ' || text WHEN 1 THEN '[НеПовторяемая ошибка: context]' WHEN 2 THEN '  ' || chr(10) || chr(9) || ' '
  WHEN 3 THEN 'Let me see. I need to read it.' || chr(10) || text WHEN 4 THEN '<div><img src=''' || regexp_replace(text, '[<>]', '', 'g') || '''/></div>'
  WHEN 5 THEN '<table data-bbox="10 200 30 400"><tr><td>' || text || '</td></tr></table>' ELSE text END AS ocr_text FROM documents),
trimmed AS (SELECT *, regexp_replace(ocr_text, '^\s+|\s+$', '', 'g') AS s FROM marked),
counted AS (SELECT *, len(regexp_extract_all(s, '(?im)(?:(?:The user wants|I need to|I will now|I should|Let me|Looking at|Analyzing)\b|^\d+\.\s+\*\*)')) AS n FROM trimmed),
judged AS (SELECT doc_id, source, lang, ocr_text, CASE WHEN s = '' OR s IS NULL THEN 'not_recognized' WHEN starts_with(ocr_text, '[Ошибка') OR starts_with(ocr_text, '[НеПовторяемая') THEN 'error'
  WHEN length(s) > 50 AND length(regexp_replace(regexp_replace(CASE WHEN regexp_matches(s, '&[^&\t\n\r\f ;]{0,33}$') THEN regexp_replace(s, '[^>]*$', '') ELSE s END, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) < 20 THEN 'error'
  WHEN n > 0 AND (n >= 2 OR regexp_matches(s, '(?i)(?:I will now generate|based on this analysis|Let me now|I will now output)\b'))
    AND (NOT regexp_matches(s, '(?i)<(?:p|table|div|h[1-6]|ul|ol|tr|td|th)\b') OR n >= 3) THEN 'error'
  WHEN regexp_matches(s, '(?i)<table\b') AND NOT regexp_matches(s, '(?i)<h[1-6]\b') AND list_min(list_transform(regexp_extract_all(s, 'data-bbox="\d+\s+(\d+)\s+\d+\s+\d+"', 1), lambda t: t::int)) >= 150 THEN 'error'
  ELSE 'success' END AS status FROM counted)"""


@query(f"WITH {MARKED} SELECT source, count(*) AS total, count(*) FILTER (status = 'success') AS recognized, count(*) FILTER (status = 'error') AS failed, "
       "count(*) FILTER (status = 'not_recognized') AS empty, CASE WHEN count(*) FILTER (status = 'success') = 0 THEN 'error' WHEN count(*) FILTER (status = 'success') < 0.9 * count(*) THEN 'partial' ELSE 'done' END AS status FROM judged GROUP BY source")
def ocr_coverage_report(spark, sf_dir):
    """How much of each source was recognised, and whether its job is done, partial or an error."""
    found = marked_documents(spark, sf_dir).select("source", st.status(F.col("ocr_text")).alias("s"))
    n = lambda s: F.count_if(F.col("s") == s)
    out = found.groupBy("source").agg(F.count("*").alias("total"), n("success").alias("recognized"), n("error").alias("failed"), n("not_recognized").alias("empty"))
    return out.withColumn("status", st.coverage(F.col("recognized"), F.col("total")))


@query(f"WITH {MARKED} SELECT doc_id, status, status <> 'success' AS needs_ocr FROM judged")
def text_status(spark, sf_dir):
    """Statuses by an html parser's text and JSON dumps. SQL cuts tags by a pattern, and the text after the last one where a reference begun at its end keeps the parser waiting."""
    found = marked_documents(spark, sf_dir).select("doc_id", st.status(F.col("ocr_text")).alias("status"))
    return found.select("doc_id", "status", (F.col("status") != "success").alias("needs_ocr"))


@query()
def text_status_parsed(spark, sf_dir):
    """Statuses with an html parser's text and JSON dumps found; tests hold the functions against cases."""
    return marked_documents(spark, sf_dir).select("doc_id", st.status(F.col("ocr_text")).alias("status"), st.suspicion(F.col("ocr_text")).alias("reason"))


@query(f"WITH {MARKED} SELECT l.quality, l.toxic, j.status, count(*) AS n FROM judged j JOIN labels l ON j.doc_id = l.doc_id GROUP BY ALL")
def quality_vs_labels(spark, sf_dir):
    found = marked_documents(spark, sf_dir).select("doc_id", st.status(F.col("ocr_text")).alias("status"))
    return found.join(b.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "status").agg(F.count("*").alias("n"))


def _uuids(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("uuid"))


_V = "list_transform(range(0, 8), lambda k: instr('34679ACDEFGHJKLMNPQRTUVWXY', substr(p, k + 1, 1)) - 1)"
CODES = f"""u AS (SELECT o_orderkey, md5(o_orderkey::varchar) AS uuid FROM orders),
n AS (SELECT *, ('0x' || left(uuid, 10))::bigint AS n0 FROM u), m AS (SELECT *, CASE WHEN n0 >= 208827064576 THEN n0 // 26 ELSE n0 END AS n FROM n),
p AS (SELECT *, list_reduce(list_transform([8031810176, 308915776, 11881376, 456976, 17576, 676, 26, 1], lambda d: substr('34679ACDEFGHJKLMNPQRTUVWXY', ((n // d) % 26 + 1)::int, 1)), lambda x, y: x || y) AS p FROM m),
v AS (SELECT *, {_V} AS v FROM p),
codes AS (SELECT o_orderkey, uuid, n, p || substr('34679ACDEFGHJKLMNPQRTUVWXY', (list_sum(v) % 26 + 1)::int, 1)
  || substr('34679ACDEFGHJKLMNPQRTUVWXY', (list_sum(list_transform(v, lambda x, i: x * (i + 2))) % 26 + 1)::int, 1)
  || substr('34679ACDEFGHJKLMNPQRTUVWXY', (list_sum(list_transform(v, lambda x, i: x * (i + 6) * i)) % 26 + 1)::int, 1) AS c FROM v)"""


@query(f"WITH {CODES} SELECT o_orderkey, left(c, 4) || '-' || substr(c, 5, 4) || '-' || substr(c, 9, 3) AS code, true AS valid, lpad(lower(to_hex(n)), 10, '0') AS decoded FROM codes")
def block_codes(spark, sf_dir):
    coded = _uuids(spark, sf_dir).select("o_orderkey", ids.encode(F.col("uuid")).alias("code"))
    return coded.select("o_orderkey", "code", ids.is_valid(F.col("code")).alias("valid"), ids.decode(F.col("code")).alias("decoded"))


@query(f"WITH {CODES} SELECT o_orderkey, left(c, 4) || '-' || substr(c, 5, 4) || '-' || substr(c, 9, 3) AS code, left(c, 4) || '-' || substr(c, 5, 4) || '-' || substr(c, 9, 3) AS again FROM codes")
def block_code_migration(spark, sf_dir):
    coded = _uuids(spark, sf_dir).select("o_orderkey", ids.migrated(F.col("uuid")).alias("code"))
    return coded.select("o_orderkey", "code", ids.migrated(F.col("code")).alias("again"))


@query()
def block_code_repair(spark, sf_dir):
    """Codes with a letter lost are made whole again; tests compare with a plain search."""
    damaged = F.regexp_replace(ids.encode(F.col("uuid")), "^(.{5}).", "$1")
    return b.spread(_uuids(spark, sf_dir), "o_orderkey").select("o_orderkey", damaged.alias("damaged")).select("o_orderkey", "damaged", ids.repair(F.col("damaged")).alias("repaired"))


@query("""WITH d AS (SELECT md5(o_orderkey::varchar) AS h, o_orderkey FROM orders),
t AS (SELECT o_orderkey, regexp_replace(lower(translate(trim(' ' || translate(left(h, 8), '015', 'OlS') || '-' || substr(h, 9) || '!'), 'OoIl|!іІSsGg', '001111115566')), '[^0-9a-f]', '', 'g') AS x FROM d)
SELECT o_orderkey, left(x, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) AS uuid FROM t""")
def uuid_normalize(spark, sf_dir):
    seen = F.concat(F.lit(" "), F.translate(F.substring("uuid", 1, 8), "015", "OlS"), F.lit("-"), F.substring("uuid", 9, 32), F.lit("!"))
    return _uuids(spark, sf_dir).select("o_orderkey", ids.normal_uuid(seen).alias("uuid"))


@query("""SELECT p_partkey, CASE WHEN p_name = p_type THEN 100.0 ELSE (greatest(length(p_name), length(p_type)) - levenshtein(p_name, p_type)) / greatest(length(p_name), length(p_type)) * 100 END AS score FROM part""")
def levenshtein_ratio(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select("p_partkey", ids.similarity(F.col("p_name"), F.col("p_type")).alias("score"))


@query(f"""WITH {BLOCKS}, seen AS (SELECT doc_id, CASE WHEN pos % 3 = 0 THEN regexp_replace(id, '-', '~') ELSE id END AS seen FROM blocks),
s AS (SELECT s.doc_id, seen, b.id, b.pos, CASE WHEN seen = b.id THEN 100.0 ELSE (greatest(length(seen), length(b.id)) - levenshtein(seen, b.id)) / greatest(length(seen), length(b.id)) * 100 END AS score
  FROM seen s JOIN blocks b ON s.doc_id = b.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seen ORDER BY score DESC, pos) AS k FROM s WHERE score >= 70)
SELECT doc_id, seen, id, score FROM r WHERE k = 1""")
def fuzzy_block_match(spark, sf_dir):
    blocks = b.blocks(spark, sf_dir)
    seen = blocks.select("doc_id", F.when(F.col("pos") % 3 == 0, F.regexp_replace("id", "-", "~")).otherwise(F.col("id")).alias("seen"))
    return bl.block_similarity(seen, blocks.select("doc_id", "id", "pos"))


def _tree(spark, sf_dir):
    return tr.with_paths(b.edges(spark, sf_dir))


@query(f"WITH RECURSIVE {TREE} SELECT id, path, depth FROM tree")
def tree_paths(spark, sf_dir):
    return _tree(spark, sf_dir).select("id", "path", "depth")


@query(f"WITH RECURSIVE {TREE} SELECT a.id AS root_id, t.id, t.name, t.depth FROM tree a JOIN tree t ON starts_with(t.path, a.path || '.') WHERE a.node_type = 'folder' AND a.depth = 1")
def tree_descendants(spark, sf_dir):
    return tr.descendants(_tree(spark, sf_dir), (F.col("node_type") == "folder") & (F.col("depth") == 1)).select("root_id", "id", "name", "depth")


@query(f"WITH RECURSIVE {TREE} SELECT t.id AS node_id, a.id, a.name, a.depth FROM tree a JOIN tree t ON starts_with(t.path, a.path || '.') WHERE t.node_type = 'document'")
def tree_ancestors(spark, sf_dir):
    return tr.ancestors(_tree(spark, sf_dir), F.col("node_type") == "document")


@query(f"""WITH RECURSIVE {EDGES}, f AS (SELECT id, name AS full_name FROM edges WHERE parent_id IS NULL UNION ALL SELECT e.id, f.full_name || ' / ' || e.name FROM edges e JOIN f ON e.parent_id = f.id)
SELECT id, full_name FROM f""")
def node_full_name(spark, sf_dir):
    return tr.full_names(_tree(spark, sf_dir))


@query(f"WITH {EDGES} SELECT e.id, coalesce(c.n, 0) AS children_count FROM edges e LEFT JOIN (SELECT parent_id, count(*) AS n FROM edges GROUP BY 1) c ON c.parent_id = e.id")
def tree_children_counts(spark, sf_dir):
    return tr.child_counts(b.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {TREE}, s AS (SELECT unnest(string_split(path, '.')) AS id FROM tree) SELECT id, count(*) - 1 AS descendants_count FROM s GROUP BY id""")
def tree_descendant_counts(spark, sf_dir):
    return tr.descendant_counts(_tree(spark, sf_dir))


@query(f"""WITH RECURSIVE {TREE}, {FILES}, own AS (SELECT node_id, count(*) AS n FROM files GROUP BY 1), s AS (SELECT unnest(string_split(path, '.')) AS root, node_type, coalesce(n, 0) AS n FROM tree LEFT JOIN own ON node_id = id)
SELECT root AS id, count(*) FILTER (node_type = 'folder') AS folders, count(*) FILTER (node_type = 'document') AS documents, sum(n)::bigint AS files FROM s WHERE root NOT LIKE 'O%' GROUP BY root""")
def subtree_stats(spark, sf_dir):
    return tr.subtree_stats(_tree(spark, sf_dir), b.files(spark, sf_dir))


@query(f"""WITH RECURSIVE {TREE} SELECT id, CASE WHEN id = 'N3' THEN 'R2' ELSE parent_id END AS parent_id,
CASE WHEN list_contains(string_split(path, '.'), 'N3') THEN 'R2.' || array_to_string(list_slice(string_split(path, '.'), 2, 99), '.') ELSE path END AS path, depth FROM tree""")
def tree_move(spark, sf_dir):
    return tr.moved(_tree(spark, sf_dir), "N3", "R2").select("id", "parent_id", "path", "depth")


@query(f"WITH RECURSIVE {TREE} SELECT id, path FROM tree WHERE NOT list_contains(string_split(path, '.'), 'N7')")
def tree_delete(spark, sf_dir):
    return tr.deleted(_tree(spark, sf_dir), "N7").select("id", "path")


@query(f"""WITH RECURSIVE {TREE}, hit AS (SELECT id, path FROM tree WHERE contains(lower(name), 'asia')), up AS (SELECT unnest(string_split(path, '.')) AS id FROM hit)
SELECT id, path FROM tree t WHERE id IN (SELECT id FROM up) OR EXISTS (SELECT 1 FROM hit h WHERE starts_with(t.path, h.path || '.'))""")
def tree_search(spark, sf_dir):
    return tr.visible(_tree(spark, sf_dir), "Asia")


@query(f"WITH {EDGES} SELECT id, parent_id, ((row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, created_at, id) - 1) * 10)::int AS sort_order FROM edges")
def sibling_renumber(spark, sf_dir):
    return tr.renumbered(b.edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT parent_id, left(name, 9) AS name, count(*) AS n FROM edges GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sibling_names(spark, sf_dir):
    return tr.repeated_names(b.edges(spark, sf_dir).withColumn("name", F.substring("name", 1, 9)))


@query(f"""WITH {FILES}, {LISTING_ONLY} SELECT coalesce(l.key, f.r2_key) AS key, CASE WHEN l.key IS NULL THEN 'db_only' WHEN f.r2_key IS NULL THEN 'storage_only' WHEN l.size <> f.file_size THEN 'size_mismatch' ELSE 'both' END AS state
FROM listing l FULL OUTER JOIN files f ON l.key = f.r2_key""")
def file_reconcile(spark, sf_dir):
    return fi.reconcile(b.listing(spark, sf_dir), b.files(spark, sf_dir))


@query(f"""WITH {EDGES}, a AS (SELECT id, name, sort_order FROM edges WHERE node_type = 'document'), z AS (SELECT id, CASE WHEN sort_order = 2 THEN upper(name) ELSE name END AS name, sort_order FROM a WHERE sort_order <> 3
  UNION ALL SELECT 'X' || id, name, sort_order FROM a WHERE sort_order = 4)
SELECT coalesce(z.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN z.id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL OUTER JOIN z ON a.id = z.id
WHERE a.id IS NULL OR z.id IS NULL OR a.name <> z.name""")
def snapshot_diff(spark, sf_dir):
    before = b.edges(spark, sf_dir).where("node_type = 'document'").select("id", "name", "sort_order")
    after = before.where("sort_order <> 3").withColumn("name", F.when(F.col("sort_order") == 2, F.upper("name")).otherwise(F.col("name")))
    after = after.union(before.where("sort_order = 4").withColumn("id", F.concat(F.lit("X"), "id")))
    return fi.changes(before, after, "id", ["name", "sort_order"])


@query(f"""WITH {EDGES}, {FILES}, {BLOCKS_ONLY}, a AS (SELECT DISTINCT doc_id FROM blocks WHERE page > 0), h AS (SELECT node_id, bool_or(file_type = 'ocr_html') AS html FROM files GROUP BY 1)
SELECT e.id, CASE WHEN e.sort_order = 6 THEN 'unknown' WHEN a.doc_id IS NULL THEN 'missing_blocks' WHEN coalesce(h.html, false) THEN 'complete' ELSE 'missing_files' END AS status
FROM edges e LEFT JOIN a ON a.doc_id = e.id LEFT JOIN h ON h.node_id = e.id WHERE e.node_type = 'document'""")
def document_status(spark, sf_dir):
    documents = b.edges(spark, sf_dir).where("node_type = 'document'").select("id", F.when(F.col("sort_order") != 6, F.concat(F.lit("tree_docs/"), "id")).alias("r2_key"))
    annotated = b.blocks(spark, sf_dir).where("page > 0").select(F.col("doc_id").alias("node_id"))
    return fi.document_status(documents, annotated, b.files(spark, sf_dir))


@query(f"""WITH {FILES} SELECT node_id, max_by(r2_key, line) FILTER (file_type = 'ocr_html') AS html_key, max_by(r2_key, line) FILTER (file_type = 'result_md') AS md_key FROM files GROUP BY node_id""")
def sidecar_resolve(spark, sf_dir):
    return fi.sidecars(b.files(spark, sf_dir))


@query(f"""WITH {FILES}, n AS (SELECT node_id, r2_key, file_type, CASE WHEN line = 1 THEN NULL ELSE file_size + 1 END AS file_size FROM files WHERE line <= 2
  UNION ALL SELECT node_id, 'new/' || r2_key, 'pdf', 0 FROM files WHERE line = 3)
SELECT coalesce(n.node_id, f.node_id) AS node_id, coalesce(n.r2_key, f.r2_key) AS r2_key, CASE WHEN n.r2_key IS NULL THEN f.file_type ELSE n.file_type END AS file_type, coalesce(n.file_size, f.file_size) AS file_size
FROM files f FULL OUTER JOIN n ON n.node_id = f.node_id AND n.r2_key = f.r2_key""")
def file_upsert(spark, sf_dir):
    files = b.files(spark, sf_dir).select("node_id", "r2_key", "file_type", "file_size", "line")
    new = files.where("line <= 2").select("node_id", "r2_key", "file_type", F.when(F.col("line") > 1, F.col("file_size") + 1).alias("file_size"))
    new = new.union(files.where("line = 3").select("node_id", F.concat(F.lit("new/"), "r2_key"), F.lit("pdf"), F.lit(0).cast("long")))
    return fi.upsert(files.drop("line"), new, ["node_id", "r2_key"], keep_old=("file_size",))


@query(f"WITH {FILES} SELECT node_id, r2_key FROM files WHERE NOT (node_id = 'O1' AND file_type IN ('crop', 'ocr_html', 'result_md'))")
def purge_artifacts(spark, sf_dir):
    return fi.purged(b.files(spark, sf_dir), "O1", "tree_docs/none").select("node_id", "r2_key")


@query(f"WITH {LISTING} SELECT regexp_replace(key, '/[^/]*$', '') AS folder, count(*) AS objects, sum(size)::bigint AS bytes FROM listing GROUP BY 1")
def storage_totals(spark, sf_dir):
    return fi.totals(b.listing(spark, sf_dir))


def _cache(spark, sf_dir):
    return b.files(spark, sf_dir).select(F.regexp_extract("file_name", r"^(\d+)", 1).alias("shard"), F.col("r2_key").alias("key"), F.col("file_size").alias("size"), F.col("created_at").alias("accessed"))


CACHE = FILES + ", cache AS (SELECT regexp_extract(file_name, '^(\\d+)', 1) AS shard, r2_key AS key, file_size AS size, created_at AS accessed FROM files)"


@query(f"""WITH {CACHE}, w AS (SELECT *, sum(size) OVER (PARTITION BY shard) AS total, coalesce(sum(size) OVER (PARTITION BY shard ORDER BY accessed, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM cache)
SELECT shard, key FROM w WHERE total - gone > 200000""")
def lru_evict(spark, sf_dir):
    return fi.evicted(_cache(spark, sf_dir), "shard", 200_000).select("shard", "key")


@query(f"""WITH {CACHE}, w AS (SELECT *, count(*) OVER (PARTITION BY shard) AS n, row_number() OVER (PARTITION BY shard ORDER BY accessed, key) AS k FROM cache) SELECT shard, key FROM w WHERE k <= greatest(n // 10, 1)""")
def ttl_evict_oldest_tenth(spark, sf_dir):
    return fi.oldest_tenth(_cache(spark, sf_dir), "shard").select("shard", "key")


@query(f"WITH {FILES} SELECT node_id AS prefix, r2_key AS key, (row_number() OVER (PARTITION BY node_id ORDER BY r2_key) - 1) // 3 AS batch FROM files")
def delete_batches(spark, sf_dir):
    return fi.batches(b.files(spark, sf_dir).select(F.col("node_id").alias("prefix"), F.col("r2_key").alias("key")), 3)


@query(f"WITH {JOBS}, q AS (SELECT *, CASE WHEN trim(engine) = 'chandra' THEN 'chandra' ELSE 'lmstudio' END AS e FROM jobs WHERE status = 'queued'), w AS (PARTITION_X) SELECT 1".replace("w AS (PARTITION_X) SELECT 1",
       """w AS (SELECT id, e, priority, lag(id) OVER o AS before_id, lead(id) OVER o AS after_id, lead(priority) OVER o AS next FROM q WINDOW o AS (PARTITION BY e ORDER BY priority, created_at, id))
SELECT id, before_id, after_id, CASE WHEN priority = next THEN priority - 1 ELSE next END AS mine, CASE WHEN priority = next THEN next + 1 ELSE CASE WHEN next IS NOT NULL THEN priority END END AS other FROM w"""))
def job_neighbours(spark, sf_dir):
    """A queued job's neighbours in its engine's queue, and both priorities after swapping with the next."""
    jobs = b.jobs(spark, sf_dir).withColumn("engine", jo.engine(F.col("engine")))
    both = jo.swapped(F.col("priority"), F.col("after_priority"))
    return jo.neighbours(jobs, "engine").select("id", "before_id", "after_id", both["mine"].alias("mine"), F.when(F.col("after_priority").isNotNull(), both["other"]).alias("other"))


@query(f"WITH {JOBS} SELECT coalesce(max(priority) + 1, 0) AS priority FROM jobs WHERE status = 'queued'")
def next_priority(spark, sf_dir):
    return jo.next_priority(b.jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT id, node_id, created_at FROM jobs WHERE status = 'done' ORDER BY created_at DESC, id DESC LIMIT 100")
def job_history_top100(spark, sf_dir):
    return b.jobs(spark, sf_dir).where("status = 'done'").orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "node_id", "created_at")


@query(f"WITH {JOBS} SELECT id, updated_at FROM jobs WHERE updated_at > TIMESTAMP '1997-06-01'")
def job_delta_since(spark, sf_dir):
    return b.jobs(spark, sf_dir).where(F.col("updated_at") > F.to_timestamp_ntz(F.lit("1997-06-01 00:00:00"))).select("id", "updated_at")


@query(f"""WITH {JOBS}, m AS (SELECT * REPLACE (CASE WHEN status = 'queued' AND substr(id, 2)::bigint % 16 <> 0 THEN 'partial' WHEN status = 'processing' AND substr(id, 2)::bigint % 3 <> 0 THEN 'error' ELSE status END AS status) FROM jobs),
w AS (SELECT *, bool_or(status IN ('queued', 'processing')) OVER (PARTITION BY node_id) AS active FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC, id DESC) AS j FROM w WHERE status IN ('done', 'partial') AND NOT active) SELECT node_id, id, status FROM d WHERE j = 1""")
def job_latest_done_per_node(spark, sf_dir):
    """The last finished job of nodes without an active one; most waiting jobs are taken as partly done."""
    k = F.substring("id", 2, 20).cast("long")
    status = F.when((F.col("status") == "queued") & (k % 16 != 0), "partial").when((F.col("status") == "processing") & (k % 3 != 0), "error").otherwise(F.col("status"))
    return jo.latest_done(b.jobs(spark, sf_dir).withColumn("status", status)).select("node_id", "id", "status")


@query(f"""WITH {JOBS} SELECT id, CASE WHEN progress > 0.01 THEN epoch(updated_at - created_at) / progress - epoch(updated_at - created_at) END AS seconds,
CASE WHEN status = 'done' THEN 'terminal' WHEN retry_count >= 4 THEN 'retries' WHEN epoch(updated_at - created_at) / 3600 > 480 THEN 'runtime' END AS guard FROM jobs""")
def job_eta_and_guard(spark, sf_dir):
    hours = (F.unix_timestamp(F.col("updated_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 3600
    return b.jobs(spark, sf_dir).select("id", jo.remaining(F.col("created_at"), F.col("updated_at"), F.col("progress")).alias("seconds"),
                                        jo.guard(F.col("status"), F.col("retry_count"), F.lit(4), hours, F.lit(480)).alias("guard"))


@query(f"""WITH {JOBS} SELECT id, CASE WHEN status IN ('queued', 'processing') THEN 'paused' ELSE status END AS paused, CASE WHEN status = 'done' THEN status ELSE 'cancelled' END AS cancelled, trim(lower(engine)) AS engine FROM jobs""")
def job_transitions(spark, sf_dir):
    s = F.col("status")
    return b.jobs(spark, sf_dir).select("id", jo.transition(s, "pause").alias("paused"), jo.transition(s, "cancel").alias("cancelled"), jo.engine(F.col("engine")).alias("engine"))


@query(f"WITH {JOBS}, {EVENTS}, p AS (SELECT 'J' || job AS id, max_by(progress, seq) AS progress FROM evs GROUP BY 1) SELECT j.id, j.status, coalesce(p.progress, j.progress) AS progress FROM jobs j LEFT JOIN p ON p.id = j.id")
def job_patch(spark, sf_dir):
    patches = b.events(spark, sf_dir).groupBy(F.concat(F.lit("J"), F.col("job").cast("string")).alias("id")).agg(F.max_by("progress", "seq").alias("progress"))
    return jo.patched(b.jobs(spark, sf_dir), patches, ["progress"]).select("id", "status", "progress")


@query(f"""WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY 1) SELECT doc_id, least(greatest(300 + n * 30 + least(n * 5, 1800), 600), 14400) AS soft, least(greatest(300 + n * 30 + least(n * 5, 1800), 600), 14400) + 600 AS hard FROM n""")
def job_timeouts(spark, sf_dir):
    n = b.blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", geo.timeouts(F.col("n")).alias("t")).select("doc_id", "t.soft", "t.hard")


@query(f"WITH {BLOCKS} SELECT doc_id, count(*) AS total, count(*) FILTER (block_type = 'text') AS text, count(*) FILTER (block_type = 'image') AS image, count(*) FILTER (block_type = 'stamp') AS stamp FROM blocks GROUP BY 1")
def block_type_stats(spark, sf_dir):
    return bl.type_stats(b.blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, s AS (SELECT *, CASE WHEN coalesce(ocr_text, '') = '' THEN 'not_recognized' WHEN starts_with(ocr_text, '[') THEN 'error' ELSE 'success' END AS st FROM blocks),
c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (st = 'success') AS recognized, count(*) FILTER (st = 'error') AS failed, count(*) FILTER (starts_with(ocr_text, '[НеПов')) AS non_retriable, count(*) FILTER (st = 'not_recognized') AS empty FROM s GROUP BY 1)
SELECT *, CASE WHEN recognized = 0 THEN 'error' WHEN recognized < 0.9 * total THEN 'partial' ELSE 'done' END AS status FROM c""")
def recognition_report(spark, sf_dir):
    return bl.recognition_report(b.blocks(spark, sf_dir))


IMAGES = BLOCKS + """, links AS (SELECT t.doc_id, t.linked_block_id AS image_id, max_by(t.id, t.page * 100 + t.pos) AS text_id FROM blocks t JOIN blocks i ON i.id = t.linked_block_id AND i.doc_id = t.doc_id
  WHERE t.block_type = 'text' AND i.block_type = 'image' GROUP BY 1, 2)"""


@query(f"WITH {IMAGES} SELECT * FROM links")
def link_image_text(spark, sf_dir):
    return bl.image_texts(b.blocks(spark, sf_dir))


@query(f"""WITH {IMAGES} SELECT b.doc_id, count(*) AS total, count(*) FILTER (block_type = 'stamp') AS stamps, count(l.text_id) AS embedded, count(*) FILTER (block_type <> 'stamp' AND l.text_id IS NULL) AS exported
FROM blocks b LEFT JOIN links l ON l.text_id = b.id GROUP BY 1""")
def export_stats(spark, sf_dir):
    return bl.export_stats(b.blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, seg AS (SELECT id, '<p>' || ocr_text || '</p>' AS html FROM blocks WHERE pos % 2 = 1 AND ocr_text IS NOT NULL)
SELECT b.id, s.html AS ocr_html, CASE WHEN s.id IS NULL THEN 'none' ELSE 'marker' END AS method, CASE WHEN s.id IS NULL THEN 0.0 ELSE 100.0 END AS score FROM blocks b LEFT JOIN seg s ON s.id = b.id""")
def enrich_blocks(spark, sf_dir):
    blocks = b.blocks(spark, sf_dir)
    segments = blocks.where("pos % 2 = 1 and ocr_text is not null").select("id", F.concat(F.lit("<p>"), "ocr_text", F.lit("</p>")).alias("html"), F.lit("marker").alias("method"), F.lit(100.0).alias("score"))
    return bl.enriched(blocks, segments).select("id", "ocr_html", "method", "score")


@query(f"""WITH {BLOCKS}, n AS (SELECT doc_id, id, page, pos, block_type, 'corrected ' || id AS ocr_text FROM blocks WHERE is_correction UNION ALL SELECT doc_id, id || '-new', page, pos + 100, 'text', 'added' FROM blocks WHERE pos = 1)
SELECT coalesce(n.doc_id, b.doc_id) AS doc_id, coalesce(n.id, b.id) AS id, coalesce(n.page, b.page) AS page, coalesce(n.pos, b.pos) AS pos, coalesce(n.block_type, b.block_type) AS block_type,
CASE WHEN n.id IS NULL THEN b.ocr_text ELSE n.ocr_text END AS ocr_text, CASE WHEN n.id IS NULL THEN b.is_correction ELSE false END AS is_correction FROM blocks b FULL OUTER JOIN n ON n.id = b.id""")
def correction_merge(spark, sf_dir):
    blocks = b.blocks(spark, sf_dir)
    keep = ["doc_id", "id", "page", "pos", "block_type"]
    new = blocks.where("is_correction").select(*keep, F.concat(F.lit("corrected "), "id").alias("ocr_text"))
    new = new.union(blocks.where("pos = 1").select("doc_id", F.concat("id", F.lit("-new")), "page", F.col("pos") + 100, F.lit("text"), F.lit("added")))
    return bl.corrected(blocks, new)


@query(f"WITH {BLOCKS}, r AS (SELECT id, 'old ' || id AS t FROM blocks WHERE pos <> 6) SELECT b.id, CASE WHEN coalesce(b.ocr_text, '') <> '' THEN b.ocr_text ELSE r.t END AS ocr_text FROM blocks b LEFT JOIN r ON r.id = b.id")
def legacy_fill_empty(spark, sf_dir):
    blocks = b.blocks(spark, sf_dir)
    return bl.filled(blocks, blocks.where("pos <> 6").select("id", F.concat(F.lit("old "), "id").alias("ocr_text"))).select("id", "ocr_text")


STAMPS = BLOCKS + """, pages AS (SELECT doc_id, page, min_by(code, pos) AS page_code FROM blocks WHERE block_type = 'stamp' GROUP BY 1, 2),
modes AS (SELECT doc_id, page_code, count(*) AS n, min(page) AS seen FROM pages GROUP BY 1, 2), best AS (SELECT doc_id, page_code AS code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k FROM modes)"""


@query(f"WITH {STAMPS} SELECT doc_id, code FROM best WHERE k = 1")
def stamp_inherit_mode(spark, sf_dir):
    return bl.inherited_code(b.blocks(spark, sf_dir))


@query(f"WITH {BLOCKS} SELECT doc_id, min_by(code, page * 100 + pos) AS code FROM blocks WHERE block_type = 'stamp' GROUP BY 1")
def stamp_first(spark, sf_dir):
    return bl.first_code(b.blocks(spark, sf_dir))


@query(f"""WITH {STAMPS} SELECT b.id, coalesce(p.page_code, m.code) AS code FROM blocks b LEFT JOIN pages p ON p.doc_id = b.doc_id AND p.page = b.page LEFT JOIN best m ON m.doc_id = b.doc_id AND m.k = 1 WHERE b.block_type <> 'stamp'""")
def stamp_propagate(spark, sf_dir):
    return bl.propagated(b.blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, c AS (SELECT *, (px[1] + px[3]) / 2 / 1240 AS x, (px[2] + px[4]) / 2 / 1754 AS y, bool_or(block_type = 'stamp') OVER (PARTITION BY doc_id, page) AS has FROM blocks),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY x + y DESC, pos) AS k FROM c WHERE NOT has AND x > 0.5 AND y > 0.7) SELECT doc_id, page, id FROM r WHERE k = 1""")
def stamp_autodetect(spark, sf_dir):
    return bl.stamp_candidates(b.blocks(spark, sf_dir), b.WIDTH, b.HEIGHT)


@query(f"""WITH {BLOCKS}, m AS (SELECT doc_id, unnest(range(0, max(page) + 1)) AS page FROM blocks WHERE page <> 1 GROUP BY 1), n AS (SELECT doc_id, page, count(*) AS n FROM blocks WHERE page <> 1 GROUP BY 1, 2)
SELECT m.doc_id, m.page::int AS page, coalesce(n.n, 0) AS blocks FROM m LEFT JOIN n ON n.doc_id = m.doc_id AND n.page = m.page""")
def sparse_pages_fill(spark, sf_dir):
    return bl.dense_pages(b.blocks(spark, sf_dir).where("page <> 1"))


@query(f"WITH {BLOCKS} SELECT doc_id, page, greatest(max(px[3]) + 50, 1240) AS width, greatest(max(px[4]) + 50, 1754) AS height FROM blocks GROUP BY 1, 2")
def page_size_estimate(spark, sf_dir):
    return bl.page_sizes(b.blocks(spark, sf_dir))


PARTS = BLOCKS + """, pg AS (SELECT DISTINCT doc_id, page FROM blocks), w AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, ntile(2) OVER (PARTITION BY doc_id ORDER BY page) AS part FROM pg),
parts AS (SELECT doc_id, part::int AS part, min(page) AS first, max(page) AS last FROM w WHERE n >= 2 GROUP BY 1, 2)"""


@query(f"WITH {PARTS} SELECT * FROM parts")
def page_ranges_ntile(spark, sf_dir):
    return bl.page_ranges(b.blocks(spark, sf_dir).select("doc_id", "page").distinct(), 2)


@query(f"""WITH {PARTS}, p AS (SELECT b.doc_id, b.id, r.part, b.page - r.first AS part_page, b.linked_block_id FROM blocks b JOIN parts r ON r.doc_id = b.doc_id AND b.page BETWEEN r.first AND r.last)
SELECT p.doc_id, p.id, p.part, p.part_page, CASE WHEN o.part = p.part THEN p.linked_block_id END AS linked_block_id FROM p LEFT JOIN p o ON o.id = p.linked_block_id""")
def annotation_split_links(spark, sf_dir):
    blocks = b.blocks(spark, sf_dir)
    return bl.split_links(blocks, bl.page_ranges(blocks.select("doc_id", "page").distinct(), 2))


@query(f"WITH {BLOCKS} SELECT id FROM blocks WHERE coalesce(ocr_text, '') = '' OR pos = 1")
def checkpoint_pending(spark, sf_dir):
    blocks = b.blocks(spark, sf_dir)
    return bl.pending(blocks, blocks.where("coalesce(ocr_text, '') <> '' and pos > 1")).select("id")


LOST = BLOCKS + """, lost AS (SELECT doc_id, id, page, pos, CASE WHEN coalesce(ocr_text, '') = '' THEN 'empty' ELSE 'api_error' END AS reason FROM blocks
  WHERE block_type = 'text' AND (coalesce(ocr_text, '') = '' OR starts_with(ocr_text, '[Ошибка')))"""


@query(f"WITH {LOST} SELECT doc_id, id, reason FROM lost")
def verify_missing(spark, sf_dir):
    return bl.missing(b.blocks(spark, sf_dir)).select("doc_id", "id", "reason")


@query(f"""WITH {LOST}, w AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS k FROM lost) SELECT doc_id, id FROM w WHERE n <= 2 OR k <= greatest(1, floor(n * (2 / n)))""")
def retry_quota(spark, sf_dir):
    return bl.retry_quota(bl.missing(b.blocks(spark, sf_dir)), 2).select("doc_id", "id")


def _page():
    return F.lit(b.WIDTH), F.lit(b.HEIGHT)


@query(f"""WITH {BLOCKS}, s AS (SELECT id, [px[1] / 1240, px[2] / 1754, px[3] / 1240, px[4] / 1754] AS s FROM blocks)
SELECT id, [trunc(s[1] * 1240)::int, trunc(s[2] * 1754)::int, trunc(s[3] * 1240)::int, trunc(s[4] * 1754)::int] AS px FROM s""")
def bbox_round_trip(spark, sf_dir):
    return b.blocks(spark, sf_dir).select("id", geo.to_pixels(geo.to_shares(F.col("coords_px"), *_page()), *_page()).alias("px"))


@query(f"""WITH {BLOCKS}, s AS (SELECT id, list_transform([px[1] / 1240 - 0.1, px[2] / 1754, px[3] / 1240 - 0.1, px[4] / 1754], lambda v: least(greatest(v, 0.0), 1.0)) AS s FROM blocks)
SELECT id, CASE WHEN s[3] - s[1] > 1e-6 AND s[4] - s[2] > 1e-6 THEN s END AS box FROM s""")
def bbox_normalize(spark, sf_dir):
    s = geo.to_shares(F.col("coords_px"), *_page())
    return b.blocks(spark, sf_dir).select("id", geo.normal_shares(F.array(s[0] - 0.1, s[1], s[2] - 0.1, s[3])).alias("box"))


@query(f"""WITH {BLOCKS}, c AS (SELECT id, least(greatest(px[1], 0), 799) AS x1, least(greatest(px[2], 0), 999) AS y1, least(greatest(px[3], 0), 800) AS x2, least(greatest(px[4], 0), 1000) AS y2 FROM blocks)
SELECT id, [x1, y1, CASE WHEN x2 <= x1 THEN least(800, x1 + 1) ELSE x2 END, CASE WHEN y2 <= y1 THEN least(1000, y1 + 1) ELSE y2 END] AS box FROM c""")
def bbox_sanitize(spark, sf_dir):
    return b.blocks(spark, sf_dir).select("id", geo.inside_page(F.col("coords_px"), F.lit(800), F.lit(1000)).alias("box"))


@query(f"WITH {BLOCKS} SELECT id FROM blocks WHERE px[1] < 600 AND px[3] > 200 AND px[2] < 900 AND px[4] > 300")
def blocks_in_rectangle(spark, sf_dir):
    return b.blocks(spark, sf_dir).where(geo.meets(F.col("coords_px"), 200, 300, 600, 900)).select("id")


@query(f"""WITH {BLOCKS}, p AS (SELECT id, px, list_transform([0, 1, 2], lambda k: [px[1] + k * 7, px[2] + k * 11]) AS p FROM blocks)
SELECT id, list_transform(p, lambda q: least(greatest(trunc(10 + (q[1] - px[1]) / greatest(px[3] - px[1], 1) * 300)::int, 0), 1239)) AS xs,
list_transform(p, lambda q: least(greatest(trunc(20 + (q[2] - px[2]) / greatest(px[4] - px[2], 1) * 200)::int, 0), 1753)) AS ys FROM p""")
def polygon_rescale(spark, sf_dir):
    px = F.col("coords_px")
    points = F.array(*(F.struct((px[0] + k * 7).alias("x"), (px[1] + k * 11).alias("y")) for k in range(3)))
    new = geo.rescaled_points(points, px, F.array(F.lit(10), F.lit(20), F.lit(310), F.lit(220)), *_page())
    return b.blocks(spark, sf_dir).select("id", F.transform(new, lambda p: p["x"]).alias("xs"), F.transform(new, lambda p: p["y"]).alias("ys"))


@query("""WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || left(text, 20) || '</think>' || text WHEN 1 THEN text || '<THINK>' || text WHEN 2 THEN left(text, 10) || '</think>' || text ELSE text END AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<think>.*?</think>', '', 'gis'), '<think>.*$', '', 'gis'), '^.*?</think>', '', 'is'), '^\\s+|\\s+$', '', 'g') AS text FROM m""")
def strip_thinking(spark, sf_dir):
    k, t = F.col("turn") % 4, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("<think>"), F.substring(t, 1, 20), F.lit("</think>"), t)).when(k == 1, F.concat(t, F.lit("<THINK>"), t)).when(k == 2, F.concat(F.substring(t, 1, 10), F.lit("</think>"), t)).otherwise(t)
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip_thinking(said).alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || '[img:0123456789abcdef0123_img]' || chr(10) || chr(10) || chr(10) || chr(10) || text, '\\[img:[a-f0-9]{20,}_img\\]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS markdown,
replace(replace(replace(replace(text || '<a href="x">&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents""")
def sanitize_texts(spark, sf_dir):
    t = F.col("text")
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.sanitize_markdown(F.concat(t, F.lit("[img:0123456789abcdef0123_img]\n\n\n\n"), t)).alias("markdown"), tx.escape_html(F.concat(t, F.lit('<a href="x">&'))).alias("escaped"))


@query(f"WITH {FILES} SELECT r2_key, 'p/' || regexp_replace(file_name, '(?i)\\.pdf$', '') || '_ocr.html' AS html, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f', file_size / 1024) || ' KB' ELSE printf('%.1f', file_size / 1048576) || ' MB' END AS size FROM files")
def export_keys(spark, sf_dir):
    return b.files(spark, sf_dir).select("r2_key", tx.export_keys(F.lit("p"), F.col("file_name"))["html"].alias("html"), tx.size_text(F.col("file_size")).alias("size"))


@query()
def page_markdown(spark, sf_dir):
    """Pages' html as Markdown; tests compare with plain Python."""
    return mk.with_markdown(b.spread(b.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id"), "html", "markdown").select("page_id", "markdown")


@query(f"""WITH {IMAGES}, ok AS (SELECT *, CASE WHEN coalesce(ocr_text, '') = '' OR starts_with(ocr_text, '[') THEN '*(no data)*' ELSE ocr_text END AS md FROM blocks)
SELECT b.doc_id, string_agg('### ' || upper(b.block_type) || ' ' || b.id || chr(10) || b.md || coalesce(chr(10) || '> ' || CASE WHEN t.ocr_text IS NULL THEN NULL ELSE t.md END, ''), chr(10) ORDER BY b.page, b.pos) AS content
FROM ok b LEFT JOIN links own ON own.text_id = b.id LEFT JOIN links l ON l.image_id = b.id LEFT JOIN ok t ON t.id = l.text_id WHERE b.block_type <> 'stamp' AND own.text_id IS NULL GROUP BY 1""")
def document_markdown(spark, sf_dir):
    return bl.markdown(b.blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS k FROM blocks)
SELECT doc_id, string_agg('<div id="' || id || '"><h2>' || k || '</h2><p>' || CASE WHEN coalesce(ocr_text, '') = '' OR starts_with(ocr_text, '[') THEN '' ELSE ocr_text END || '</p></div>', chr(10) ORDER BY page, pos) AS content FROM n WHERE block_type <> 'stamp' GROUP BY 1""")
def document_html(spark, sf_dir):
    return bl.html(b.blocks(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT job, max_by(status, seq) AS status, max_by(progress, seq) AS progress, count(*) AS n FROM evs GROUP BY 1")
def event_fold_latest(spark, sf_dir):
    return ev.latest(b.events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT job, min_by(seq, (ts, seq)) AS owner FROM evs GROUP BY 1")
def execution_lock_first(spark, sf_dir):
    return ev.first_owner(b.events(spark, sf_dir))


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job ORDER BY ts, seq) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM evs),
i AS (SELECT *, sum(starts) OVER (PARTITION BY job ORDER BY ts, seq) AS k FROM g) SELECT job, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS edits, max_by(progress, seq) AS progress FROM i GROUP BY job, k""")
def session_sync(spark, sf_dir):
    return ev.sessions(b.events(spark, sf_dir), "6 hours")


NUMBERED = EVENTS + ", e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS k FROM evs)"
WAIT, LEAST = 8 * 86_400.0, 0.3
JUDGED = NUMBERED + """, judged AS (SELECT job, ts, seq, status, progress, k, true AS written, status AS s, progress AS p, us AS t FROM e WHERE k = 1
  UNION ALL SELECT job, ts, seq, status, progress, k, w, CASE WHEN w THEN status ELSE s END, CASE WHEN w THEN progress ELSE p END, CASE WHEN w THEN us ELSE t END
  FROM (SELECT e.*, j.s, j.p, j.t, e.status = 'purchase' OR e.status <> j.s OR e.us - j.t >= 3000000 OR abs(e.progress - j.p) >= 0.05 AS w FROM judged j JOIN e ON e.job = j.job AND e.k = j.k + 1) n)"""
PATIENT = JUDGED.replace("3000000", str(int(WAIT * 1_000_000))).replace("0.05", str(LEAST))


@query(f"WITH RECURSIVE {JUDGED} SELECT job, ts, seq, status, progress FROM judged WHERE written")
def debounce_updates(spark, sf_dir):
    """Updates a job's status row gets from its events."""
    return ev.debounced(b.events(spark, sf_dir), b.ENDS)


@query(f"WITH RECURSIVE {PATIENT}, l AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY k DESC) AS back FROM judged) SELECT job, ts, seq, status, progress FROM l WHERE back = 1 AND NOT written")
def debounce_pending(spark, sf_dir):
    """Updates that are written when the job's updater is flushed; with limits as wide as the gaps between these events."""
    return ev.pending(b.events(spark, sf_dir), b.ENDS, WAIT, LEAST)


@query(f"WITH RECURSIVE {PATIENT} SELECT job, count(*) FILTER (written) AS written, count(*) FILTER (NOT written) AS skipped FROM judged GROUP BY job")
def debounce_stats(spark, sf_dir):
    return ev.debounce_stats(b.events(spark, sf_dir), b.ENDS, WAIT, LEAST)


@query(f"""WITH RECURSIVE {NUMBERED}, taken AS (SELECT job, seq, k, us, true AS passes, 1.0::double AS tokens FROM e WHERE k = 1
  UNION ALL SELECT job, seq, k, us, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END
  FROM (SELECT e.*, least(2.0::double, x.tokens + (e.us - x.us)::double / 1000000::double / 86400::double * 2::double) AS t FROM taken x JOIN e ON e.job = x.job AND e.k = x.k + 1) n)
SELECT job, seq, passes FROM taken""")
def token_bucket(spark, sf_dir):
    """Which requests of a job a bucket of tokens lets pass."""
    return ev.rate_limited(b.events(spark, sf_dir))


LOOKS = NUMBERED + ", o AS (SELECT job, seq, k, us, status = 'purchase' AS active, progress * 2000 AS age FROM e)"


@query(f"""WITH RECURSIVE {LOOKS}, z AS (SELECT job, seq, k, false AS dead, CASE WHEN NOT active AND age > 600 THEN us END AS first FROM o WHERE k = 1
  UNION ALL SELECT job, seq, k, NOT active AND age >= 1500 AND first IS NOT NULL AND us - first >= 432000000000,
    CASE WHEN active THEN NULL WHEN age < 1500 THEN coalesce(first, CASE WHEN age > 600 THEN us END) WHEN first IS NULL THEN us WHEN us - first < 432000000000 THEN first END
  FROM (SELECT o.*, z.first FROM z JOIN o ON o.job = z.job AND o.k = z.k + 1) n) SELECT job, seq, dead FROM z""")
def zombie_confirmed(spark, sf_dir):
    """Looks at which a job is taken for dead, suspected five days before."""
    looks = b.events(spark, sf_dir).select("job", "ts", "seq", F.col("status").isin(*b.ENDS).alias("active"), (F.col("progress") * 2000).alias("age"))
    return ev.dead_jobs(looks, 1500, again=432_000.0)


FAILURES = EVENTS + """, x AS (SELECT *, progress < 0.7 AS failed FROM evs), c AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY job ORDER BY ts, seq) AS island FROM x),
f AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY job, island ORDER BY ts, seq) AS failures FROM c)"""


@query(f"WITH {FAILURES} SELECT job, seq, failures, CASE WHEN failures = 0 THEN 15.0 ELSE least(15.0 * power(2, least(failures - 1, 3)), 180) END::double AS seconds FROM f")
def poll_intervals(spark, sf_dir):
    """Seconds to the next poll after each answer; low values stand for errors."""
    seen = ev.failures_in_a_row(b.events(spark, sf_dir), F.col("progress") < 0.7)
    return seen.select("job", "seq", "failures", jo.back_off(F.col("failures")).alias("seconds"))


@query(f"""WITH {FAILURES} SELECT job, seq, CASE WHEN failures > 0 THEN (failures - 1) % 10 + 1 END AS attempt, failures > 0 AND failures % 10 = 0 AS gave_up,
CASE WHEN failures = 0 OR failures % 10 = 0 THEN NULL WHEN failures >= 5 THEN 30.0 ELSE 3.0 END::double AS delay FROM f""")
def sync_retries(spark, sf_dir):
    """Attempts, delays and giving up after each failed write of an annotation."""
    seen = ev.failures_in_a_row(b.events(spark, sf_dir), F.col("progress") < 0.7)
    return seen.select("job", "seq", ev.sync_retry(F.col("failures")).alias("r")).select("job", "seq", "r.*")


@query(f"""WITH {EDGES}, {FILES}, p AS (SELECT node_id, first(r2_key ORDER BY created_at, r2_key) AS key FROM files WHERE file_type = 'crop' GROUP BY 1)
SELECT id, coalesce(key, CASE WHEN sort_order <> 6 THEN 'tree_docs/' || id END) AS r2_key FROM edges LEFT JOIN p ON node_id = id WHERE node_type = 'document'""")
def node_first_key(spark, sf_dir):
    nodes = b.edges(spark, sf_dir).where("node_type = 'document'").select("id", F.when(F.col("sort_order") != 6, F.concat(F.lit("tree_docs/"), "id")).alias("r2_key"))
    return fi.first_keys(nodes, b.files(spark, sf_dir), "crop")


@query(f"""WITH {EDGES}, {JOBS} SELECT id, CASE WHEN coalesce(status, '') = '' THEN 'unknown' ELSE status END AS status, CASE WHEN sort_order = 2 THEN 'checked' ELSE '' END AS message
FROM edges WHERE id IN (SELECT node_id FROM jobs WHERE status = 'queued') OR id IN (SELECT 'O' || substr(id, 2) FROM jobs WHERE status = 'processing')""")
def pdf_statuses(spark, sf_dir):
    """Statuses of the nodes and documents that jobs wait for."""
    jobs = b.jobs(spark, sf_dir)
    ids = jobs.where("status = 'queued'").select(F.col("node_id").alias("id")).union(jobs.where("status = 'processing'").select(F.concat(F.lit("O"), F.expr("substr(id, 2)"))))
    nodes = b.edges(spark, sf_dir).select("id", F.col("status").alias("pdf_status"), F.when(F.col("sort_order") == 2, "checked").alias("pdf_status_message"))
    return fi.pdf_statuses(nodes, ids)


@query(f"WITH {BLOCKS} SELECT doc_id, page, count(*) AS stamps FROM blocks WHERE block_type = 'stamp' GROUP BY doc_id, page")
def stamped_pages(spark, sf_dir):
    return bl.stamped_pages(b.blocks(spark, sf_dir))


@query(f"WITH {BLOCKS} SELECT doc_id, bool_or(coalesce(ocr_text, '') <> '') AS recognised FROM blocks WHERE page > 0 GROUP BY doc_id")
def recognised_documents(spark, sf_dir):
    return bl.recognised(b.blocks(spark, sf_dir).where("page > 0"))


@query(f"""WITH {EVENTS}, o AS (SELECT *, lag(ts) OVER (PARTITION BY job ORDER BY ts, seq) AS before FROM evs) SELECT job, seq, floor(epoch(ts - before))::bigint AS idle, floor(epoch(ts - before)) > 43200 AS suspect FROM o WHERE before IS NOT NULL""")
def zombie_scan(spark, sf_dir):
    return ev.idle(b.events(spark, sf_dir), 43_200)


def _responses(spark, sf_dir):
    """Turns of conversations as a server's responses: plain, in parts, structured, in the reasoning, an error, reasoning alone."""
    k, t = F.col("turn") % 6, F.col("text")
    said = lambda content, reason="stop", thought=None: F.to_json(F.struct(F.array(F.struct(F.lit(reason).alias("finish_reason"), F.struct(content.alias("content"), (F.lit(None).cast("string") if thought is None else thought).alias("reasoning_content")).alias("message"))).alias("choices")))
    part = lambda **fields: F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))
    parts = F.concat(F.lit('{"choices":[{"finish_reason":"length","message":{"content":['), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2), F.lit(","), part(text=F.concat(F.lit(" "), t)), F.lit(","), part(content=F.lit("end")), F.lit(",7]}}]}"))
    html = F.concat(F.lit("<p>"), t, F.lit("</p>"))
    thought = F.concat(F.lit("Title: Rooms list.\nNow <table><tr><td>"), t, F.lit("</td></tr></table>"))
    response = F.when(k == 0, said(html)).when(k == 1, parts).when(k == 2, said(part(ocr_html=F.concat(F.lit(" "), html)))).when(k == 3, said(F.lit(""), thought=thought)).when(k == 4, F.lit('{"error":"busy"}')).otherwise(said(F.concat(F.lit("Let me see. "), t)))
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("response"))


_REASONS = r"(?i)^(?:\d+\.\s+\*\*|(?:Let me|I need to|I will|I should|I see|I can|First[,.]|Looking at|Analyzing|The user|The input|The image|The document|The table|This is|This looks|Here |Now |OK |Sure |Based on|Alright|To (?:analyze|process|extract|transcribe))\b)"
_CUT = "CASE WHEN regexp_matches(ltrim({0}), '" + _REASONS + "') THEN CASE WHEN regexp_matches({0}, '(?i)<(?:p|table|h[1-6]|div|ul|ol|span|br|hr|img)\\b') THEN regexp_extract({0}, '(?is)<(?:p|table|h[1-6]|div|ul|ol|span|br|hr|img)\\b.*') ELSE '' END ELSE {0} END"
SAID = f"""said AS (SELECT conv_id, turn, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
joined AS (SELECT *, array_to_string(list_filter([t, t, 'end'], lambda x: x <> ''), chr(10)) AS parts, regexp_replace('Let me see. ' || text, '\\s+$', '') AS thought FROM said),
cut AS (SELECT conv_id, turn, text, {_CUT.format("parts")} AS parts, {_CUT.format("thought")} AS thought FROM joined)"""


@query(f"""WITH {SAID}, x AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '<p>' || text || '</p>' WHEN 1 THEN CASE WHEN parts = '' THEN '' ELSE '[LENGTH_TRUNCATED]' || parts END WHEN 2 THEN '<p>' || text || '</p>'
  WHEN 3 THEN '<div data-label="Section-Header"><h1>Rooms list</h1></div>' || chr(10) || '<table><tr><td>' || text || '</td></tr></table>' WHEN 4 THEN '[Ошибка: Chandra: некорректный ответ (busy)]' ELSE thought END AS text FROM cut)
SELECT conv_id, turn, CASE WHEN text = '' THEN '[Ошибка: Chandra: пустой ответ модели]' ELSE text END AS text FROM x""")
def parse_response(spark, sf_dir):
    return rs.read(_responses(spark, sf_dir), "response", "text").select("conv_id", "turn", "text")


@query(f"""WITH {SAID} SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '<p>' || text || '</p>' WHEN 1 THEN array_to_string(list_filter([t, t, 'end'], lambda x: x <> ''), chr(10)) WHEN 5 THEN regexp_replace('Let me see. ' || text, '\\s+$', '') ELSE '' END AS text
FROM said""")
def message_text(spark, sf_dir):
    message = F.get_json_object("response", "$.choices[0].message")
    plain = F.when(F.col("turn") % 6 != 2, rs.message_text(message))  # not the JSON text of a structured one
    return _responses(spark, sf_dir).select("conv_id", "turn", F.coalesce(plain, F.lit("")).alias("text"))


@query(f"""WITH m AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'I need to read. ' || text WHEN 1 THEN 'Here <b>is</b> <p>' || text ELSE text END AS x FROM conversations) SELECT conv_id, turn, {_CUT.format("x")} AS text FROM m""")
def strip_reasoning(spark, sf_dir):
    k, t = F.col("turn") % 3, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("I need to read. "), t)).when(k == 1, F.concat(F.lit("Here <b>is</b> <p>"), t)).otherwise(t)
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", rs.strip_untagged_reasoning(said).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[CONTEXT_OVERFLOW]' END AS marker FROM conversations")
def final_errors(spark, sf_dir):
    code = F.when(F.col("turn") % 2 == 0, 400).otherwise(500)
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", rs.final_error(code, F.concat(F.lit("exceeds the Context Size: "), "text")).alias("marker"))


def _stamps(spark, sf_dir):
    """Order lines as stamps' JSON; every third in a fence, every fifth broken. A query that names the text more than once has it written first, as each use would make it again."""
    text = lambda c: F.col(c).cast("string")
    line = F.col("line")
    data = F.to_json(F.struct(
        F.concat(F.lit("DOC-"), text("l_suppkey")).alias("document_code"), F.lit("").alias("stage"), text("line").alias("sheet_number"), F.when(line % 2 == 0, text("l_partkey")).alias("total_sheets"), F.col("l_linestatus").alias("project_name"),
        F.array(F.struct(F.lit("1").alias("change_num"), F.lit(None).cast("string").alias("doc_num")), F.struct(text("line").alias("change_num"), F.when(line % 3 == 0, text("l_partkey")).alias("doc_num"))).alias("revisions"),
        F.array(F.struct(F.col("l_returnflag").alias("role"), F.concat(F.lit("P"), text("l_suppkey")).alias("surname")), F.struct(F.lit("").alias("role"), F.lit("nobody").alias("surname"))).alias("signatures")))
    told = F.when(line % 5 == 0, F.concat(F.lit("broken "), data)).when(line % 3 == 0, F.concat(F.lit("see ```json\n"), data, F.lit("\n``` there"))).otherwise(F.concat(F.lit(" "), data))
    return b.lines(spark, sf_dir).select("l_orderkey", "line", told.alias("ocr_text"))


STAMP_PARTS = LINES + """, parts AS (SELECT l_orderkey, line, [['Шифр', 'DOC-' || l_suppkey], ['Лист', line || CASE WHEN line % 2 = 0 THEN ' (из ' || l_partkey || ')' ELSE '' END], ['Объект', l_linestatus],
  ['Статус', 'Изм. ' || line || CASE WHEN line % 3 = 0 THEN ' (Док. № ' || l_partkey || ')' ELSE '' END], ['Ответственные', l_returnflag || ': P' || l_suppkey]] AS p FROM li WHERE line % 5 <> 0)"""


@query(f"WITH {STAMP_PARTS} SELECT l_orderkey, line, array_to_string(list_transform(p, lambda x: x[1] || ': ' || x[2]), ' | ') AS parts FROM parts")
def stamp_parts(spark, sf_dir):
    read = _stamps(spark, sf_dir).select("l_orderkey", "line", F.explode(F.array_compact(F.array(rs.parsed_json(F.col("ocr_text"))))).alias("data"))
    return rs.with_stamp_parts(read, "data", "parts").select("l_orderkey", "line", rs.stamp_line(F.col("parts")).alias("parts"))


@query(f"WITH {LINES} SELECT l_orderkey, line, CASE WHEN line % 5 = 0 THEN 'suspicious' ELSE 'ok' END AS quality, line % 5 <> 0 AS found FROM li")
def json_quality(spark, sf_dir):
    read = materialise(_stamps(spark, sf_dir), "stamps").withColumn("data", rs.parsed_json(F.col("ocr_text")))
    return read.select("l_orderkey", "line", rs.json_quality(F.col("ocr_text"), F.col("data")).alias("quality"), F.col("data").isNotNull().alias("found"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 11 <> 0 THEN 'plan' ELSE '' END AS fragment_type, CASE WHEN p_size % 3 = 0 THEN p_type END AS zone_name, CASE WHEN p_size % 3 <> 0 THEN p_type END AS location_text, CASE WHEN p_size % 11 = 0 THEN '' ELSE p_name END AS content_summary,
CASE WHEN p_size % 3 = 0 THEN '+3.5' END AS level_or_elevation, CASE WHEN p_size % 4 = 0 THEN 'check' ELSE '' END AS verification_recommendations,
CASE WHEN p_size % 5 = 0 THEN [p_brand, p_name, 'E3'] ELSE []::varchar[] END AS key_entities, p_size % 11 <> 0 AS is_image FROM part""")
def image_ocr_fields(spark, sf_dir):
    size = F.col("p_size")
    place = F.when(size % 3 == 0, F.to_json(F.struct(F.col("p_type").alias("zone_name"), F.lit("+3.5").alias("level_or_elevation")))).otherwise(F.concat(F.lit('"'), "p_type", F.lit('"')))
    entities = F.when(size % 5 == 0, F.to_json(F.array("p_brand", "p_name", F.lit("E3")))).otherwise(F.lit('"none"'))
    data = F.concat(F.lit('{"location":'), place, F.lit(',"key_entities":'), entities, F.when(size % 11 == 0, F.lit(',"summary":"')).otherwise(',"content_summary":"'), "p_name", F.lit('"'), F.when(size % 4 == 0, F.lit(',"verification_recommendations":"check"')).otherwise(""), F.when((size % 2 == 0) & (size % 11 != 0), F.lit(',"fragment_type":"plan"')).otherwise(""), F.lit("}"))
    data = F.when(size % 7 == 0, F.concat(F.lit('{"analysis":'), data, F.lit("}"))).otherwise(data)
    read = b.table(spark, sf_dir, "part").select("p_partkey", data.alias("data"))
    read = read.select("p_partkey", rs.image_fields(F.col("data")).alias("f"), rs.is_image_json(F.col("data")).alias("is_image"))
    return read.select("p_partkey", "f.fragment_type", "f.zone_name", "f.location_text", "f.content_summary", "f.level_or_elevation", "f.verification_recommendations", "f.key_entities", "is_image")


@query("""SELECT p_partkey, '| Name | Size\\| |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |' || chr(10) || '|  | ' || p_brand || ' ' || p_type || ' |' || chr(10) || '| wide |  |' AS markdown FROM part""".replace("\\\\", "\\"))
def table_to_markdown(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Size|</th></tr><tr><td rowspan='2'>"), "p_name", F.lit("</td><td>"), text("p_size"), F.lit("</td></tr><tr><td><b>"), "p_brand", F.lit("</b><br/>"), "p_type", F.lit("</td></tr><tr><td colspan=2>wide</td></tr></table>"))
    return b.table(spark, sf_dir, "part").select("p_partkey", tb.to_markdown(html).alias("markdown"))


@query("""SELECT p_partkey, '<p>before &amp; on</p>' || chr(10) || '<table><thead><tr><th>Name</th><th>Size</th></tr></thead><tbody><tr><td>' || p_name || '</td><td>' || p_size || '</td></tr></tbody></table>' || chr(10) || '<p>' || p_brand || '</p>' AS html FROM part""")
def md_table_to_html(spark, sf_dir):
    text = F.concat(F.lit("before & on\n\n| Name | Size |\n|---|:--|\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n"), "p_brand")
    return b.table(spark, sf_dir, "part").select("p_partkey", tb.to_html(text).alias("html"))


@query()
def filter_mixed_text(spark, sf_dir):
    """Documents with pictures and descriptions of them mixed in, cleaned; tests compare with plain Python."""
    k = F.col("doc_id") % 3
    text = F.concat(F.when(k == 0, F.lit('<div class="a" data-label="Image">x</div><img src="y">')).when(k == 1, F.lit("A photograph showing the residential building from the street ЖК ")).otherwise(""), "text")
    clean = tb.without_images(text, F.when(F.col("doc_id") % 7 == 0, "qwen").otherwise("chandra"))
    return b.spread(b.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", clean.alias("c")).select("doc_id", "c.text", "c.removed_chars", "c.removed_image_segments")


@query(f"WITH {EDGES} SELECT id, name FROM edges WHERE parent_id IS NULL")
def root_nodes(spark, sf_dir):
    return tr.children(b.edges(spark, sf_dir), None).select("id", "name")


@query(f"WITH {EDGES} SELECT id, name, sort_order FROM edges WHERE parent_id = 'N3'")
def node_children(spark, sf_dir):
    return tr.children(b.edges(spark, sf_dir), "N3").select("id", "name", "sort_order")


@query(f"WITH {EDGES} SELECT id, CASE WHEN node_type = 'folder' THEN ['folder', 'document'] ELSE []::varchar[] END AS allowed FROM edges")
def allowed_child_types(spark, sf_dir):
    return b.edges(spark, sf_dir).select("id", tr.child_types(F.col("node_type")).alias("allowed"))


@query(f"WITH {EDGES} SELECT id, node_type = 'document' AND sort_order = 2 AS is_locked FROM edges")
def lock_documents(spark, sf_dir):
    nodes = b.edges(spark, sf_dir).withColumn("is_locked", F.lit(None).cast("boolean"))
    return tr.locked(nodes, nodes.where("sort_order = 2")).select("id", "is_locked")


@query(f"""WITH {EDGES}, last AS (SELECT parent_id, max(sort_order) AS n FROM edges GROUP BY 1) SELECT id, parent_id, sort_order FROM edges
UNION ALL SELECT 'new' || e.id, e.id, coalesce(n, -1) + 1 FROM edges e LEFT JOIN last l ON l.parent_id = e.id WHERE e.node_type = 'folder' AND e.sort_order = 1""")
def tree_create(spark, sf_dir):
    nodes = b.edges(spark, sf_dir)
    new = nodes.where("sort_order = 1").select(F.concat(F.lit("new"), "id").alias("id"), F.col("id").alias("parent_id"), F.lit("document").alias("node_type"), F.lit("a").alias("name"))
    return tr.created(nodes, new).select("id", "parent_id", "sort_order")


@query(f"WITH {JOBS} SELECT id, priority, created_at FROM jobs WHERE status IN ('queued', 'processing')")
def job_list(spark, sf_dir):
    return jo.listed(b.jobs(spark, sf_dir), ("queued", "processing")).select("id", "priority", "created_at")


@query(f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def job_status_counts(spark, sf_dir):
    return jo.counts(b.jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT count(*) FILTER (status IN ('queued', 'processing')) AS active, count(*) FILTER (status IN ('queued', 'processing')) < 100 AS room FROM jobs")
def queue_capacity(spark, sf_dir):
    return jo.has_room(b.jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'done' THEN retry_count ELSE retry_count + 1 END AS retry_count FROM jobs")
def job_retry(spark, sf_dir):
    jobs = b.jobs(spark, sf_dir)
    return jo.retried(jobs, jobs.where("status <> 'done'")).select("id", "retry_count")


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'processing' THEN updated_at WHEN status = 'done' THEN created_at END AS started_at FROM jobs")
def job_started(spark, sf_dir):
    jobs = b.jobs(spark, sf_dir).withColumn("started_at", F.when(F.col("status") == "done", F.col("created_at")))
    return jo.started(jobs, F.col("updated_at")).select("id", "started_at")


@query(f"WITH {JOBS}, {FILES} SELECT f.node_id AS job_id, f.r2_key FROM files f WHERE 'J' || substr(f.node_id, 2) NOT IN (SELECT id FROM jobs WHERE status = 'done')")
def job_delete(spark, sf_dir):
    """Files that are left once finished jobs are deleted with theirs."""
    jobs = b.jobs(spark, sf_dir)
    files = b.files(spark, sf_dir).select(F.concat(F.lit("J"), F.expr("substr(node_id, 2)")).alias("job_id"), "node_id", "r2_key")
    _, left, _ = jo.without(jobs, files, files.select("job_id"), jobs.where("status = 'done'"))
    return left.select(F.col("node_id").alias("job_id"), "r2_key")


@query(f"WITH {FILES} SELECT r2_key, file_type FROM files WHERE node_id = 'O1'")
def node_files(spark, sf_dir):
    return fi.of_node(b.files(spark, sf_dir), "O1").select("r2_key", "file_type")


@query(f"WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC, r2_key DESC) AS k FROM files WHERE file_type = 'ocr_html') SELECT node_id, r2_key FROM r WHERE k = 1")
def newest_file_of_type(spark, sf_dir):
    return fi.first_of_type(b.files(spark, sf_dir), "ocr_html")


@query(f"""WITH {LISTING}, u AS (SELECT *, substr(key, 11) AS rest FROM listing WHERE starts_with(key, 'tree_docs/'))
SELECT 'tree_docs/' || split_part(rest, '/', 1) || CASE WHEN contains(rest, '/') THEN '/' ELSE '' END AS name, contains(rest, '/') AS folder, count(*) AS objects, sum(size)::bigint AS bytes FROM u GROUP BY 1, 2""")
def list_with_delimiter(spark, sf_dir):
    return fi.under(b.listing(spark, sf_dir), "tree_docs/")


@query(f"WITH {LISTING} SELECT CASE WHEN starts_with(key, 'tree_docs/1/') THEN 'archive/one/' || substr(key, 13) ELSE key END AS key, size FROM listing")
def rename_prefix(spark, sf_dir):
    return fi.renamed(b.listing(spark, sf_dir), "tree_docs/1/", "archive/one/")
