"""The registered queries of the engine's own operators, each over whole tables, with DuckDB SQL where SQL can express it.

The test tables have no Han text and no boxes; queries pass their own character classes and derive boxes, ids and trees from the columns there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.functions import boxes as b
from glosswright.functions import ids
from glosswright.functions import similarity as s
from glosswright.functions import text as t
from glosswright.operators import jsontree as j
from glosswright.operators import relational as r
from glosswright.plans import funnel as fu
from glosswright.session import dealt, ship
from glosswright.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
KEY_WORDS, KEY_CHARS = 5, 4


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g') AS kept FROM documents")
def script_filter(spark, d):
    return read(spark, d, "documents").select("doc_id", t.keep_chars(F.col("text"), t.LETTERS).alias("kept"))


@query("""
SELECT doc_id, reason, CASE WHEN n_chars < 100 THEN 'no_images' WHEN reason IS NOT NULL THEN 'skipped' ELSE 'kept' END AS disposition FROM (
  SELECT doc_id, n_chars, CASE WHEN length(kept) < 400 THEN 'too few characters (' || length(kept) || ')'
    WHEN regexp_matches(text, 'pass.{0,6}word') THEN 'pattern 1' WHEN regexp_matches(text, 'token|secret') THEN 'pattern 2' WHEN regexp_matches(text, 'the and') THEN 'pattern 3' END AS reason
  FROM (SELECT *, regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g') AS kept FROM documents))""")
def caption_skip_reason(spark, d):
    reason = t.skip_reason(F.col("text"), t.LETTERS, ("pass.{0,6}word", "token|secret", "the and"), 400)
    images = F.when(F.col("n_chars") >= 100, F.array(F.lit("x"))).otherwise(F.array())
    return read(spark, d, "documents").withColumn("reason", reason).select("doc_id", "reason", t.disposition(images, F.col("reason")).alias("disposition"))


@query("SELECT doc_id, translate(text, 'éèêëàâçñóíú', 'eeeeaacnoiu') AS unified FROM documents")
def variant_translate(spark, d):
    table = dict(zip("éèêëàâçñóíú", "eeeeaacnoiu"))
    return read(spark, d, "documents").select("doc_id", t.unify_variants(F.col("text"), table).alias("unified"))


@query("SELECT item_id, array_to_string(list_sort(string_split(text, '')), '') AS chars FROM benchmark")
def sorted_chars(spark, d):
    return read(spark, d, "benchmark").select("item_id", t.sorted_chars(F.col("text")).alias("chars"))


@query(r"""
SELECT page_id, regexp_replace(html, '[（(【「『〔\[]\s*(?:0|var|the|de)\s*[）)】」』〕\]]', '', 'g') AS stripped FROM pages""")
def strip_annotations(spark, d):
    return read(spark, d, "pages").select("page_id", t.strip_annotations(F.col("html"), ("0", "var", "the", "de")).alias("stripped"))


@query("""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS anchor, b.text AS caption FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT *, CASE WHEN NOT contains(anchor, 'the') THEN replace(caption, 'the', '') ELSE caption END AS one FROM p)
SELECT conv_id, turn, CASE WHEN NOT contains(anchor, 'que') THEN replace(one, 'que', '') ELSE one END AS caption FROM q""")
def strip_markers(spark, d):
    pairs = _turns(spark, d)
    return pairs.select("conv_id", "turn", t.strip_markers(F.col("caption"), F.col("anchor"), ("the", "que")).alias("caption"))


@query(r"""
SELECT conv_id, turn, array_to_string(list_filter(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''),
  lambda x: NOT (contains(x, 'thing') OR contains(x, 'queque') OR contains(x, 'sign') OR starts_with(x, 'The'))), chr(10)) AS lines FROM conversations""")
def anchor_clean_lines(spark, d):
    lines = t.anchor_lines(F.col("text"), ("thing", "queque"), "sign", "The")
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(lines, "\n").alias("lines"))


@query("""
WITH p AS (SELECT doc_id, regexp_replace(text, '[^a-z]+', '', 'g') AS own, regexp_replace(lang || source, '[^a-z]+', '', 'g') AS clean FROM documents)
SELECT doc_id, CASE WHEN clean = '' THEN 'empty' WHEN own = '' THEN 'caption has no text'
  WHEN ratio < 0.75 THEN 'not in caption (' || CAST(round_even(ratio * 100, 0) AS INT) || '%)' WHEN length(clean) < 6 THEN 'too short (' || length(clean) || ' chars)' END AS reason
FROM (SELECT *, len(list_filter(string_split(clean, ''), lambda c: contains(own, c))) / len(clean) AS ratio FROM p)""")
def char_membership_verify(spark, d):
    clean = t.keep_chars(F.concat("lang", "source"), "a-z")
    return read(spark, d, "documents").select("doc_id", t.verify_label(clean, F.col("text"), "a-z", least=6).alias("reason"))


def _turns(spark, d):
    """Each turn as an anchor with the next as its caption."""
    a = read(spark, d, "conversations")
    b_ = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("caption"))
    return a.select("conv_id", "turn", "role", F.col("text").alias("anchor")).join(b_, ["conv_id", "turn"])


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"""
WITH p AS (SELECT a.conv_id, a.turn, regexp_replace(lower(a.text), '[^a-z]+', '', 'g') AS x, regexp_replace(lower(b.text), '[^a-z]+', '', 'g') AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT *, list_sum(list_transform(string_split('{_LETTERS}', ''), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) AS common FROM p),
z AS (SELECT *, CASE WHEN length(x) + length(y) = 0 THEN 100.0 ELSE round_even(200.0::DOUBLE * common / (length(x) + length(y)), 1) END AS score FROM q)
SELECT conv_id, turn, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 75 AND y <> '' THEN 'SUCCESS' ELSE 'REJECT' END AS status, CAST(length(y) AS BIGINT) AS label_len FROM z""")
def multiset_similarity_gate(spark, d):
    pairs = _turns(spark, d)
    pairs = pairs.select("conv_id", "turn", t.keep_chars(F.lower("anchor"), "a-z").alias("x"), t.keep_chars(F.lower("caption"), "a-z").alias("y"))
    score = F.bround(s.sorted_similarity(F.col("x"), F.col("y")), 1)
    status = F.when((F.col("score") >= 75) & (F.col("y") != ""), "SUCCESS").otherwise("REJECT")
    return pairs.withColumn("score", score).select("conv_id", "turn", "score", status.alias("status"), F.length("y").cast("long").alias("label_len"))


@query()
def indel_ratio(spark, d):
    """Turns and their answers, compared as sequences."""
    ship(spark)
    return _turns(spark, d).select("conv_id", "turn", F.bround(s.indel_ratio("anchor", "caption"), 1).alias("score"))


def _contained(spark, d):
    """Candidate pairs of documents and benchmark items: all in which the document may hold the item.

    A document that holds an item has the item's words but the first and the last unchanged; up to ``KEY_WORDS`` of them are the key. Of items without such words
    the first ``KEY_CHARS`` characters are, or fewer if they have no more. Only items without characters meet every document, which holds them.
    """
    words = F.split("item", r"\s+")
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("item")).where("item IS NOT NULL")
    inner = F.least(F.lit(KEY_WORDS), F.size(words) - 2)
    items = items.withColumn("n", F.when(inner > 0, inner).otherwise(-F.least(F.lit(KEY_CHARS), F.length("item"))))
    items = items.withColumn("k", F.when(F.col("n") > 0, F.xxhash64("n", F.slice(words, 2, F.greatest(F.lit(0), "n")))).otherwise(F.xxhash64("n", F.left("item", -F.col("n")))))
    docs = read(spark, d, "documents").select("doc_id", "text")
    used = [x.n for x in items.select("n").distinct().collect()]  # KEY_WORDS + KEY_CHARS + 1 rows at most
    each = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - n + 1)), lambda i: F.slice(c, i, n))
    of_words = lambda n: t.let(F.split("text", r"\s+"), lambda c: F.transform(each(c, n), lambda w: F.xxhash64(F.lit(n), w)))
    of_chars = lambda n: t.let(F.split("text", ""), lambda c: F.transform(each(c, n), lambda w: F.xxhash64(F.lit(-n), F.array_join(w, ""))))
    keys = [of_words(n) if n > 0 else of_chars(-n) for n in used if n]
    empty = docs.where("text IS NOT NULL").crossJoin(items.where("n = 0").drop("n", "k"))
    if not keys:
        return empty
    hits = docs.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*keys))).alias("k")).join(items.where("n <> 0").select("k", "item_id"), "k").select("doc_id", "item_id").distinct()
    keyed = hits.join(docs, "doc_id").join(items.where("n <> 0").drop("n", "k"), "item_id").select("doc_id", "text", "item_id", "item")
    return keyed.unionByName(empty) if 0 in used else keyed


@query("""
SELECT d.doc_id, b.item_id, CAST(strpos(d.text, b.text) AS INT) AS start, substr(d.text, strpos(d.text, b.text), length(b.text)) AS label FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def verbatim_slice(spark, d):
    at = F.instr(F.col("text"), F.col("item"))
    return _contained(spark, d).where(at > 0).select("doc_id", "item_id", at.alias("start"), F.substring("text", at, F.length("item")).alias("label"))


@query()
def window_align_gate(spark, d):
    """Turns as anchors in their answers, every pair: score, window and the verbatim label."""
    ship(spark)
    rows = _turns(spark, d).select("conv_id", "turn", t.keep_chars(F.lower("anchor"), "a-z").alias("x"), t.keep_chars(F.lower("caption"), "a-z").alias("y"))
    rows = rows.withColumn("a", s.aligned("x", "y", "y")).select("conv_id", "turn", "a.*")
    return rows.withColumn("status", F.when((F.col("score") >= 75) & (F.col("label") != ""), "SUCCESS").otherwise("REJECT"))


@query(r"""
WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/groups/111111111/posts/' || (20000000 + page_id) WHEN 1 THEN 'https://h/?a=333333333&b=' || (40000000 + page_id) ELSE url END AS u FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(u, '(?:posts|permalink)/(\d{8,})', 1), ''), list_filter(regexp_extract_all(u, '\d{8,}'), lambda x: x <> '40000001')[-1]) AS post_id,
  regexp_extract(u, '/groups/(\d+)', 1) AS grp FROM p""")
def id_from_url(spark, d):
    n = F.col("page_id")
    u = F.when(n % 3 == 0, F.concat("url", F.lit("/groups/111111111/posts/"), (20000000 + n).cast("string"))).when(n % 3 == 1, F.concat(F.lit("https://h/?a=333333333&b="), (40000000 + n).cast("string"))).otherwise(F.col("url"))
    return read(spark, d, "pages").withColumn("u", u).select("page_id", ids.reference_id(F.col("u"), "40000001").alias("post_id"), ids.group_of(F.col("u")).alias("grp"))


@query("""
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS author, CAST(9000000000 + o_orderkey AS VARCHAR) AS post, CAST(8000000000 + o_orderkey AS VARCHAR) AS first_post,
  'https://www.facebook.com/groups/g/posts/' || (9000000000 + o_orderkey) || '/' AS post_url, 'https://www.facebook.com/' || o_custkey AS author_url FROM orders""")
def id_roundtrip_base64(spark, d):
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("S:_I"), F.col("o_custkey").cast("string"), F.lit(":VK:"), (8000000000 + k).cast("string"), F.lit(":VK:"), (9000000000 + k).cast("string"))
    bare = F.regexp_replace(F.base64(raw.cast("binary")), "=+$", "")
    rows = read(spark, d, "orders").select("o_orderkey", bare.alias("e")).withColumn("x", ids.decode_id(F.col("e")))
    return rows.select("o_orderkey", "x.author", "x.post", ids.first_post(F.col("e")).alias("first_post"), ids.post_url("g", F.col("x.post")).alias("post_url"), ids.author_url(F.col("x.author")).alias("author_url"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, d):
    """A property found in the walk of each event's own text."""
    tree = j.walked(read(spark, d, "events").select("event_id", "props"), ["event_id"], "props")
    return j.first_value(tree, ["event_id"], "k").select("event_id", F.col("k").try_cast("long").alias("k"))


def _trees(spark, d):
    e = read(spark, d, "events")
    i = F.col("event_id").cast("string")
    line = F.concat(
        F.lit('{"data":[{"empty":{"k":""}},{"node":{"id":"p'), i, F.lit('","comet_sections":{"content":{"story":{"message":{"text":"t'), i, F.lit('"}}}},"props":'), F.col("props"),
        F.lit('}},{"node":{"id":"q'), i, F.lit('"}},{"post_id":"'), i, F.lit('"}],"page_info":{"end_cursor":"c'), i, F.lit('"}}'),
    )
    return j.walked(dealt(e.select("event_id", "props"), "event_id").select("event_id", line.alias("line")), ["event_id"])


@query("""
SELECT event_id, CAST(x.n AS BIGINT) AS n, 'c' || event_id AS cursor, json_extract_string(props, '$.k') AS k, ['p' || event_id, CAST(event_id AS VARCHAR)] AS ids, 't' || event_id AS caption
FROM events, (SELECT 21 + 1 AS n) x""")
def json_tree_walk(spark, d):
    facts = j.tree_facts(_trees(spark, d), ["event_id"], ("k",))
    caption = j.caption(F.get(F.filter("nodes", lambda x: x["post_id"].startswith("p")), F.lit(0))["node"])
    return facts.select("event_id", "n", "cursor", "k", "ids", caption.alias("caption"))


@query("SELECT o_orderkey AS post_id, c_name AS scrape_time FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def provenance_left(spark, d):
    seen = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("post_id"), F.col("c_name").alias("timestamp"))
    posts = read(spark, d, "orders").select(F.col("o_custkey").alias("post_id"), "o_orderkey")
    return r.with_scrape_time(posts, seen).select(F.col("o_orderkey").alias("post_id"), "scrape_time")


@query("SELECT text AS caption, min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY text HAVING count(*) = 1")
def unique_caption_match(spark, d):
    return r.unique_by(read(spark, d, "documents").select(F.col("text").alias("caption"), "doc_id"), "caption", "doc_id").select("caption", "doc_id")


@query(r"""
WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS folder, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'p' || doc_id END AS post_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS cap FROM documents),
u AS (SELECT cap, min(folder) AS folder FROM o WHERE cap <> '' GROUP BY cap HAVING count(*) = 1),
m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x/' || doc_id ELSE 'catchup' END AS source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS cap FROM documents),
z AS (SELECT m.doc_id, a.folder AS f, a.post_id AS f_id, b.folder AS g, b.post_id AS g_id FROM m LEFT JOIN o a ON contains(source, '/') AND a.folder = split_part(source, '/', 2)
  LEFT JOIN u ON u.cap = m.cap LEFT JOIN o b ON b.folder = u.folder)
SELECT doc_id, CASE WHEN f_id <> '' THEN 'source_index' WHEN f_id IS NULL AND g_id <> '' THEN 'caption_match' ELSE 'unresolved' END AS resolved_by,
  CASE WHEN f_id <> '' THEN f_id WHEN f_id IS NULL AND g_id <> '' THEN g_id END AS post_id, CASE WHEN f_id <> '' THEN f WHEN f_id IS NULL AND g_id <> '' THEN g END AS folder FROM z""")
def resolved_by(spark, d):
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    origin = docs.select(n.cast("string").alias("folder"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("p"), n.cast("string"))).alias("post_id"), F.col("text").alias("caption"))
    merged = docs.select("doc_id", F.when(n % 3 == 0, F.concat(F.lit("x/"), n.cast("string"))).otherwise("catchup").alias("source"), F.col("text").alias("caption"))
    return r.resolve_provenance(merged, origin).select("doc_id", "resolved_by", "post_id", "folder")


@query("""
SELECT CAST(coalesce(l.doc_id, d.doc_id) AS VARCHAR) AS post_id_numeric, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS author_id, coalesce('l' || l.doc_id, d.source) AS post_url,
  CAST(d.n_chars AS VARCHAR) AS scrape_time, 'd' || d.doc_id AS v11_folder, 'm' || l.doc_id AS merged_folder, coalesce(l.toxic = 1, false) AS has_label
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def trace_index_upsert(spark, d):
    i = F.col("doc_id").cast("string")
    origin = read(spark, d, "documents").select(i.alias("id"), F.col("lang").alias("author_id"), F.col("source").alias("post_url"), F.col("n_chars").cast("string").alias("scrape_time"), F.concat(F.lit("d"), i).alias("folder"))
    merged = read(spark, d, "labels").select(i.alias("id"), F.col("quality").cast("string").alias("author_id"), F.concat(F.lit("l"), i).alias("post_url"), F.lit(None).cast("string").alias("scrape_time"), F.concat(F.lit("m"), i).alias("folder"), F.when(F.col("toxic") == 1, "x").otherwise(" ").alias("label"))
    return r.trace_index(origin, merged)


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 42")
def point_lookup(spark, d):
    return r.lookup(read(spark, d, "documents").select("doc_id", "source", "lang"), 42, "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti_join(spark, d):
    done = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return r.unseen(read(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("""
WITH a AS (SELECT event_id, event_type, user_id, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) > 1 THEN 'repeated' WHEN user_id % 2 = 0 THEN 'duplicate' ELSE 'new' END AS status, ts FROM events),
i AS (SELECT *, sum(CASE WHEN status = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
z AS (SELECT *, sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT event_id, event_type, status, CAST(streak AS BIGINT) AS streak, streak >= 3 AND status = 'duplicate' AS stop FROM z""")
def dupe_streak(spark, d):
    out = r.duplicate_streak(read(spark, d, "events").select("event_id", "event_type", "user_id", "ts"), "event_type", ["ts", "event_id"], "user_id", F.col("user_id") % 2 == 0, 3)
    return out.select("event_id", "event_type", "status", "streak", "stop")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2""")
def feed_silence_sessions(spark, d):
    return r.silences(read(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", 86400)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY 1, 2")
def session_dedup(spark, d):
    return r.first_of(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT c_custkey, CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS folder
FROM (SELECT c_custkey, 9000 + row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer)""")
def surrogate_number(spark, d):
    return r.numbered(read(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 9000).select("c_custkey", t.folder_name(F.col("number")).alias("folder"))


@query("SELECT doc_id, CAST((n - 1) // 80 AS BIGINT) AS chunk, CAST((n - 1) % 80 AS BIGINT) AS ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def chunk_assign(spark, d):
    return r.chunked(read(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("ordinal").cast("long").alias("ordinal"))


@query("""
WITH k AS (SELECT conv_id, list(text ORDER BY turn) AS replies FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT c.conv_id AS job, CAST(c.turn AS INT) AS ordinal, c.role AS post_id, coalesce(k.replies[c.turn + 1], '') AS reply FROM conversations c LEFT JOIN k ON c.conv_id = k.conv_id""")
def response_zip(spark, d):
    c = read(spark, d, "conversations")
    jobs = c.where("role <> 'system'").groupBy(F.col("conv_id").alias("job")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("replies"))
    return r.zip_replies(c.select(F.col("conv_id").alias("job"), F.col("turn").cast("int").alias("ordinal"), F.col("role").alias("post_id")), jobs)


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def best_by_measure(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return r.best_by(rows, ["l_orderkey"], "l_extendedprice", -F.col("l_linenumber"), -F.col("l_partkey")).drop("l_partkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 50 OFFSET 100")
def lexical_slice(spark, d):
    return r.lexical_slice(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 50)


def _lines(spark, d, *columns):
    """Order lines dealt out by order: a file of few row groups would be gathered, and its orders worked on, by few tasks."""
    return dealt(read(spark, d, "lineitem").select("l_orderkey", *columns), "l_orderkey")


def _layouts(spark, d):
    """Boxes made of order lines: columns, and signatures where the discount is small."""
    x, y = F.col("l_partkey") % 300, F.col("l_suppkey") % 100
    box = F.struct(F.array(x, y, x + 20 + F.col("l_quantity"), y + 100 + F.col("l_quantity") * 4).cast("array<double>").alias("bbox"), (F.col("l_discount") < 0.02).cast("int").alias("class"), (0.2 + F.col("l_tax") * 10).alias("conf"))
    rows = _lines(spark, d, "l_linenumber", box.alias("b")).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "b"))), lambda z: z["b"]).alias("raw"))
    rows = rows.withColumn("boxes", b.with_layout(F.col("raw")))
    return rows.select("l_orderkey", "raw", "boxes", b.of_class(F.col("boxes"), 0).alias("columns"), b.of_class(F.col("boxes"), 1).alias("signatures"))


_SIDES = "greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
_INTER = lambda a, b: _SIDES.format(a=a, b=b)


def box_clean_sql() -> str:
    """The columns ``c`` of each order, and ``f``, what cleaning leaves of them."""
    return f"""
WITH boxes AS (SELECT l_orderkey, l_linenumber AS n, (l_partkey % 300)::DOUBLE AS x1, (l_suppkey % 100)::DOUBLE AS y1, (l_partkey % 300 + 20 + l_quantity)::DOUBLE AS x2, (l_suppkey % 100 + 100 + l_quantity * 4)::DOUBLE AS y2,
  l_discount < 0.02 AS signature, 0.2 + l_tax * 10 >= 0.25 AS sure FROM lineitem),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY -(x1 + x2) / 2, n, x1, y1, x2, y2) AS i, (x1 + x2) / 2 AS cx, y2 - y1 AS h, greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1) AS a FROM boxes WHERE sure),
lists AS (SELECT o.l_orderkey, coalesce(list({{'k': -a, 'i': i, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'cx': cx, 'h': h, 'a': a}} ORDER BY i) FILTER (NOT signature), []) AS c,
  coalesce(list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY i) FILTER (signature), []) AS s FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN placed USING (l_orderkey) GROUP BY o.l_orderkey),
single AS (SELECT *, list_sort(list_filter(c, lambda x: len(list_filter(c, lambda y: x.i <> y.i AND y.a > 0 AND {_INTER('x', 'y')} >= 0.7 * y.a)) < 2)) AS o FROM lists),
kept AS (SELECT *, CASE WHEN len(o) > 0 THEN list_reduce(list_transform(o, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: {_INTER('y[1]', 'k')} / y[1].a >= 0.75)) = 0 THEN list_concat(acc, y) ELSE acc END) ELSE [] END AS r FROM single),
free AS (SELECT *, list_filter(r, lambda x: len(list_filter(s, lambda g: g.y2 - g.y1 < 0.5 * list_max(list_transform(c, lambda b: b.h)) AND {_INTER('x', 'g')} / x.a >= 0.6)) = 0) AS f FROM kept)"""


@query(f"""
{box_clean_sql()}
SELECT l_orderkey, len(c)::INT AS before, CASE WHEN len(f) = 0 THEN len(c) ELSE len(f) END::INT AS after,
  list_transform(list_sort(list_transform(CASE WHEN len(f) = 0 THEN c ELSE f END, lambda x: {{'i': x.i, 'cx': x.cx}})), lambda x: x.cx) AS centers FROM free""")
def box_clean_nms(spark, d):
    rows = _layouts(spark, d).withColumn("clean", b.clean_columns(F.col("columns"), F.col("signatures")))
    return rows.select("l_orderkey", F.size("columns").alias("before"), F.size("clean").alias("after"), F.transform("clean", lambda c: c["center_x"]).alias("centers"))


@query("""
WITH x AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount >= 0.02 AND 0.2 + l_tax * 10 >= 0.25) AS n, count(*) FILTER (WHERE l_discount < 0.02 AND 0.2 + l_tax * 10 >= 0.25) AS s,
  avg(((l_suppkey % 100 + 100 + l_quantity * 4) - l_suppkey % 100) / greatest(20 + l_quantity, 1)) FILTER (WHERE l_discount >= 0.02 AND 0.2 + l_tax * 10 >= 0.25) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(n AS INT) AS n_columns, CAST(s AS INT) AS n_signatures, round(a, 6) AS aspect FROM x""")
def box_layout(spark, d):
    return _layouts(spark, d).select("l_orderkey", F.size("columns").alias("n_columns"), F.size("signatures").alias("n_signatures"), F.round(b.mean_aspect(F.col("columns")), 6).alias("aspect"))


@query("""
WITH h AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS h, CAST(l_orderkey % 97 AS INT) AS n FROM lineitem GROUP BY l_orderkey),
c AS (SELECT *, list_transform(h, lambda x: CAST(round_even(x / list_sum(h) * n, 0) AS INT)) AS c FROM h),
e AS (SELECT *, n - CAST(list_sum(c) AS INT) AS rest, list_position(c, list_max(c)) AS pos FROM c)
SELECT l_orderkey, n, list_transform(c, lambda x, i: CASE WHEN i = pos THEN x + rest ELSE x END) AS counts FROM e""")
def allocate_chars(spark, d):
    rows = _lines(spark, d, "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("h"))
    rows = rows.withColumn("n", (F.col("l_orderkey") % 97).cast("int"))
    return rows.select("l_orderkey", "n", b.allocation(F.col("h"), F.col("n"), compat=True).alias("counts"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CAST(length(regexp_replace(x, '[^A-Z]+', '', 'g')) AS INT)), lambda n: n > 0) AS counts FROM documents)
SELECT doc_id, counts, coalesce(list_min(counts) = 1 AND list_max(counts) >= 3, false) AS orphan FROM l""")
def orphan_qa(spark, d):
    counts = t.line_counts(F.col("text"), "A-Z")
    return read(spark, d, "documents").select("doc_id", counts.alias("counts"), b.has_orphan(F.transform(counts, lambda n: F.repeat(F.lit("x"), n))).alias("orphan"))


@query("""
WITH p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g') AS own, n_chars % 4 AS pics, CAST(n_chars % 700 AS INT) AS cols FROM documents)
SELECT CASE WHEN pics = 0 THEN 'no images' WHEN cols <= 0 THEN 'no columns' WHEN cols > greatest(length(own), 1) THEN 'more columns than characters' ELSE 'kept' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def funnel_reasons(spark, d):
    box = F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(30.0)).alias("bbox"), F.lit(30.0).alias("height"))
    rows = read(spark, d, "documents").select("doc_id", F.col("text").alias("caption"), (F.col("n_chars") % 4).alias("n_images"), F.array_repeat(box, (F.col("n_chars") % 700).cast("int")).alias("columns"))
    return fu.layout_checks(rows, t.LETTERS).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, 'old' AS run FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'new' AS run FROM documents d WHERE n_chars > 500 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.lang = 'en' AND o.doc_id = d.doc_id)""")
def pass_fail_union(spark, d):
    docs = read(spark, d, "documents")
    return r.appended(docs.where("lang = 'en'").select("doc_id", F.lit("old").alias("run")), docs.where("n_chars > 500").select("doc_id", F.lit("new").alias("run")), "doc_id")


@query("""
WITH s AS (SELECT count(*) AS posts, count(score) AS passed, round(avg(score), 6) AS mean_score, median(score) AS median_score FROM (SELECT CASE WHEN n_chars > 300 THEN CAST(n_chars AS DOUBLE) END AS score FROM documents))
SELECT s.*, (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-zà-ÿ]+', '', 'g'), '')) AS c FROM documents) WHERE c <> '') AS distinct_chars FROM s""")
def corpus_stats(spark, d):
    docs = read(spark, d, "documents").select("text", F.when(F.col("n_chars") > 300, F.col("n_chars").cast("double")).alias("score"))
    return r.corpus_stats(docs, "text", "score", "A-Za-zà-ÿ").withColumn("mean_score", F.round("mean_score", 6))


@query("""
SELECT trim(arg_max(text, doc_id)) AS line FROM documents WHERE contains(text, 'thing') OR contains(text, 'queque') OR contains(lower(text), 'posts')""")
def log_last_marked(spark, d):
    return files.last_marked(read(spark, d, "documents"), "doc_id", "text", ("thing", "queque", "posts"))


@query("SELECT CAST(sum((length(text) - length(replace(text, 'thing', ''))) // 5) AS BIGINT) AS n, sum((length(text) - length(replace(text, 'thing', ''))) // 5) > 0 AS found FROM documents")
def log_occurrences(spark, d):
    return files.occurrences(read(spark, d, "documents"), "text", "thing")


@query("""
WITH a AS (SELECT doc_id, lang AS label, quality AS columns, text FROM documents JOIN labels USING (doc_id)), z AS (SELECT doc_id, lang || CASE WHEN toxic = 1 THEN '!' ELSE '' END AS label, toxic AS columns FROM documents JOIN labels USING (doc_id) WHERE n_chars > 200)
SELECT count(*) FILTER (WHERE z.label <> a.label) AS labels_changed, count(*) FILTER (WHERE z.columns <> a.columns) AS columns_changed, count(*) FILTER (WHERE length(z.label) > length(a.label)) AS labels_longer, count(*) FILTER (doc_id % 4 = 0) AS annotated,
  CAST(coalesce(sum(length(z.label) - length(a.label)) FILTER (WHERE z.label <> a.label), 0) AS BIGINT) AS chars_gained, count(*) FILTER (WHERE z.label IS NULL) AS skipped FROM a LEFT JOIN z USING (doc_id)""")
def fix_deltas(spark, d):
    """Counters of a pass; every fourth caption has a bracketed annotation, every fifth one in brackets of no kind that is stripped."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    caption = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, "（ 上聯】").when(F.col("doc_id") % 5 == 0, "<上聯>").otherwise(""))
    before = rows.select(F.col("doc_id").alias("post_id"), F.col("lang").alias("label"), F.col("quality").alias("columns"), caption.alias("caption"))
    after = rows.where("n_chars > 200").select(F.col("doc_id").alias("post_id"), F.concat("lang", F.when(F.col("toxic") == 1, "!").otherwise("")).alias("label"), F.col("toxic").alias("columns"))
    return r.fix_deltas(before, after)


@query("""
SELECT l_orderkey AS post_id, substr(min((CASE WHEN l_linestatus = 'O' THEN '0' ELSE '1' END) || name), 2) AS name
FROM (SELECT *, l_partkey || CASE WHEN l_linestatus = 'O' THEN '.jpg' ELSE '.png' END AS name FROM lineitem) GROUP BY 1""")
def first_image(spark, d):
    name = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linestatus") == "O", ".jpg").otherwise(".png"))
    return r.first_image(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), name.alias("name")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def epoch_to_iso(spark, d):
    return read(spark, d, "events").select("event_id", t.iso_time(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")).alias("iso"))


@query("""
SELECT conv_id, turn, role = 'user' AS has_calligraphy, regexp_replace(regexp_extract(text, '([^\\n]*)', 1), '[^A-Za-z]+', '', 'g') AS clean_text, CAST(turn AS INT) AS high_count FROM conversations""".replace("\\\\n", "\\n"))
def reply_parse(spark, d):
    reply = F.concat(F.lit("has_calligraphy: "), F.when(F.col("role") == "user", "yes").otherwise("no"), F.lit("\nCLEAN_TEXT: ."), F.col("text"), F.lit("\nHIGH_COUNT: "), F.col("turn").cast("string"))
    return read(spark, d, "conversations").withColumn("x", t.reply_fields(reply, t.LETTERS)).select("conv_id", "turn", "x.*")


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN string_split(url, '/')[-1] END AS tail, translate(url, ':=', '__') AS safe FROM pages")
def path_and_safe_id(spark, d):
    return read(spark, d, "pages").select("page_id", t.path_tail(F.col("url")).alias("tail"), t.safe_id(F.col("url")).alias("safe"))


@query("""
WITH j AS (SELECT o_orderkey AS job, CASE o_orderpriority WHEN '1-URGENT' THEN 'JOB_STATE_SUCCEEDED' WHEN '2-HIGH' THEN 'JOB_STATE_FAILED' WHEN '3-MEDIUM' THEN 'JOB_STATE_EXPIRED' ELSE 'RUNNING' END AS state FROM orders)
SELECT CASE state WHEN 'JOB_STATE_SUCCEEDED' THEN 'done' WHEN 'RUNNING' THEN 'open' ELSE 'failed' END AS outcome, count(*) AS n FROM j GROUP BY 1""")
def job_states(spark, d):
    p = F.col("o_orderpriority")
    state = F.when(p == "1-URGENT", "JOB_STATE_SUCCEEDED").when(p == "2-HIGH", "JOB_STATE_FAILED").when(p == "3-MEDIUM", "JOB_STATE_EXPIRED").otherwise("RUNNING")
    return fu.job_state(read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), state.alias("state"))).groupBy("outcome").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    import glosswright.plans.corpus_queries  # noqa: F401  registers its queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
