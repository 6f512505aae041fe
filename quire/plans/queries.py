"""The queries of the library proper over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as T
from quire.operators import catalog as C
from quire.operators import sequence as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark, d):
    return S.lines(read(spark, d, "documents"))


L = """WITH s AS (SELECT doc_id AS key, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
lines AS (SELECT key, unnest(a) AS t, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS b FROM s),
w AS (SELECT *, greatest(1, length(t)) AS w FROM lines),
o AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(w) OVER (PARTITION BY key) AS total FROM w)
"""


@query(L + "SELECT key, b, t FROM lines")
def block_explode(spark, d):
    return lines(spark, d)


@query(r"SELECT doc_id AS key, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS t FROM documents")
def text_collapse(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("key"), T.collapse_space(F.col("text")).alias("t"))


@query(L + "SELECT key, b, CAST(w AS BIGINT) AS w, CAST(off AS BIGINT) AS off, CAST(total AS BIGINT) AS total FROM o")
def block_offsets(spark, d):
    return S.offsets(lines(spark, d)).select("key", "b", "w", "off", "total")


@query(L + "SELECT key, b, CAST(off AS BIGINT) AS off, round(CAST(off AS DOUBLE) / total, 9) AS p FROM o")
def block_progress(spark, d):
    return S.progress(S.offsets(lines(spark, d))).select("key", "b", "off", F.round("p", 9).alias("p"))


@query(L + "SELECT key, max(b) AS b FROM o WHERE off * 1000 <= 370 * total GROUP BY key")
def block_at_progress(spark, d):
    return S.block_at(S.offsets(lines(spark, d)), F.lit(370))


@query(L + ", e AS (SELECT key, b, b // 3 AS ord FROM lines WHERE b % 3 = 0) SELECT l.key, l.b, CAST(e.ord AS INTEGER) AS ord FROM lines l ASOF LEFT JOIN e ON l.key = e.key AND l.b >= e.b")
def contents_asof(spark, d):
    x = lines(spark, d).select("key", "b")
    return S.as_of(x, x.where("b % 3 = 0").withColumn("ord", (F.col("b") / 3).cast("int")))


@query(L + ", e AS (SELECT key, b FROM lines WHERE b % 4 = 1) SELECT key, b, (SELECT max(e.b) FROM e WHERE e.key = l.key AND e.b < l.b) AS prev_b, (SELECT min(e.b) FROM e WHERE e.key = l.key AND e.b > l.b) AS next_b FROM lines l")
def chapter_next_prev(spark, d):
    x = lines(spark, d).select("key", "b")
    return S.neighbours(x, x.where("b % 4 = 1"))


@query(L + """, p AS (SELECT key, CAST(max(b) // 2 AS INTEGER) AS h FROM lines GROUP BY key), q AS (SELECT p.key, p.h + 1 AS b, l.t AS x FROM p JOIN lines l ON l.key = p.key AND l.b = p.h)
SELECT key, b, found FROM (SELECT q.key, q.b, l.b AS found, row_number() OVER (PARTITION BY q.key ORDER BY abs(l.b - q.b), l.b) AS n FROM q JOIN lines l ON l.key = q.key AND l.t = q.x AND abs(l.b - q.b) <= 3000) WHERE n = 1""")
def reanchor_nearest(spark, d):
    x = lines(spark, d)
    half = x.groupBy("key").agg((F.max("b") / 2).cast("int").alias("h"))
    places = half.join(x, (half["key"] == x["key"]) & (F.col("b") == F.col("h"))).select(half["key"], (F.col("h") + 1).alias("b"), F.col("t").alias("x"))
    return S.nearest(places, x)


@query(L + ", i AS (SELECT key, b, b - row_number() OVER (PARTITION BY key ORDER BY b) AS g FROM lines WHERE length(t) < 60) SELECT key, min(b) AS first_b, max(b) AS last_b, count(*) AS n FROM i GROUP BY key, g")
def heading_islands(spark, d):
    return S.islands(lines(spark, d), F.length("t") < 60)


@query("SELECT conv_id AS key, turn AS b, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn + 1, false) AS follows FROM conversations")
def bare_number_runs(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("b"), F.coalesce(F.lead("turn").over(w) == F.col("turn") + 1, F.lit(False)).alias("follows"))


KEY = "substr(sha1(CAST(octet_length(encode(coalesce(text, ''))) AS VARCHAR) || chr(10) || coalesce(text, '')), 1, 20)"


@query(f"SELECT doc_id, {KEY} AS key FROM documents")
def content_key(spark, d):
    return read(spark, d, "documents").select("doc_id", C.content_key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, key, min(doc_id) OVER (PARTITION BY key) AS keeper, doc_id > min(doc_id) OVER (PARTITION BY key) AS duplicate FROM (SELECT doc_id, {KEY} AS key FROM documents)")
def dedup_first_wins(spark, d):
    x = C.first_of_key(content_key(spark, d), "key", "doc_id")
    return x.select("doc_id", "key", "keeper", (F.col("doc_id") > F.col("keeper")).alias("duplicate"))


@query("SELECT key, size, CAST(kept AS BIGINT) AS kept FROM (SELECT doc_id AS key, n_chars AS size, sum(n_chars) OVER () - coalesce(sum(n_chars) OVER (ORDER BY doc_id % 97, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept, sum(n_chars) OVER () AS total FROM documents) WHERE kept > total // 2")
def lru_prune(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 97).alias("opened"), F.col("n_chars").alias("size"))
    return C.prune(x, F.floor(F.col("whole") / 2)).select("key", "size", "kept")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 8")
def topk_recent(spark, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("n", F.row_number().over(w)).where("n <= 8").drop("n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def library_refresh(spark, d):
    return C.refresh(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'the') AND contains(lower(concat_ws(' ', text, source)), 'src1')")
def library_search(spark, d):
    return read(spark, d, "documents").where(C.search("The SRC1", F.col("text"), F.col("source"))).select("doc_id")


TITLE = "regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)"


@query(rf"""WITH r AS (SELECT user_id AS key, CAST(floor(max(epoch(ts))) AS BIGINT) AS t FROM events GROUP BY user_id),
b AS (SELECT page_id AS key, url AS path, trim({TITLE}) AS title FROM pages)
SELECT b.key, coalesce(r.t, 0) AS t, row_number() OVER (ORDER BY coalesce(r.t, 0) DESC, regexp_replace(lower(trim(title)), '^(the|an|a) +', ''), path) AS pos FROM b LEFT JOIN r ON b.key = r.key""")
def library_recency(spark, d):
    reads = read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("t"))
    books = read(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("path"), F.when(F.col("html").isNotNull(), F.coalesce(H.page_title(F.col("html")), F.lit(""))).alias("title"))
    return C.recency(books, reads).select("key", "t", "pos")


@query(r"WITH r AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root FROM pages), o AS (SELECT root, row_number() OVER (ORDER BY root) AS ord FROM r) SELECT CAST(ord AS INTEGER) AS ord, root, count(p.url) AS n FROM o LEFT JOIN pages p ON starts_with(p.url, root || '/') GROUP BY ord, root")
def library_folder(spark, d):
    pages = read(spark, d, "pages").select(F.col("url").alias("path"))
    roots = pages.select(F.regexp_extract("path", "^([a-z]+://[^/]+)", 1).alias("root")).distinct()
    counted = pages.groupBy(F.regexp_extract("path", "^([a-z]+://[^/]+)/", 1).alias("root")).agg(F.count("*").alias("n"))  # a prefix up to a slash is an equality
    return roots.join(counted, "root", "left").select(F.row_number().over(W.orderBy("root")).alias("ord"), "root", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT lower(trim({TITLE})) AS title, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def shared_titles(spark, d):
    x = read(spark, d, "pages").select(T.lower(F.coalesce(H.page_title(F.col("html")), F.lit(""))).alias("title"))
    return x.groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


@query(f"SELECT page_id, nullif(trim({TITLE}), '') AS title FROM pages")
def page_title(spark, d):
    return read(spark, d, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


BARE = r"regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all({BARE}, '<a [^>]*href="([^"]*)"', 1) AS a FROM pages) SELECT page_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS n, unnest(a) AS href FROM l""")
def page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("n", "href"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({BARE}, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS t FROM pages")
def page_text(spark, d):
    return read(spark, d, "pages").select("page_id", H.plain(F.col("html")).alias("t"))


@query()
def page_blocks(spark, d):
    return H.page_blocks(read(spark, d, "pages"))


@query()
def block_contract(spark, d):
    return H.contract_faults(H.page_blocks(read(spark, d, "pages")))


@query(f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all({BARE}, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, count(*) AS links, CAST(count_if(p.path IS NULL) AS BIGINT) AS dead FROM l LEFT JOIN p ON p.path = l.href GROUP BY page_id""")
def link_dead(spark, d):
    pages = read(spark, d, "pages")
    paths = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    x = pages.select("page_id", F.explode(H.links(F.col("html"))).alias("href")).join(paths, F.col("href") == F.col("path"), "left")
    return x.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("path").isNull()).alias("dead"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def url_parts(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))


STATS = L + """, g AS (SELECT key, list_sort(list(length(t))) AS a, count(*) AS n, sum(CASE WHEN t LIKE ' %' THEN 1 ELSE 0 END) AS indented, sum(CASE WHEN trim(t) = '' THEN 1 ELSE 0 END) AS blank FROM lines GROUP BY key),
st AS (SELECT key, n, a[least(n - 1, 9 * n // 10) + 1] AS p90, round(indented / CAST(n AS DOUBLE), 9) AS indented, round(blank / CAST(n AS DOUBLE), 9) AS blank FROM g)
"""


@query(STATS + "SELECT key, n, CAST(p90 AS INTEGER) AS p90, indented, blank FROM st")
def layout_stats(spark, d):
    size = F.col("n")
    x = lines(spark, d).groupBy("key").agg(F.sort_array(F.collect_list(F.length("t"))).alias("a"), F.count("*").alias("n"), F.sum(F.startswith("t", F.lit(" ")).cast("int")).alias("i"), F.sum((F.trim("t") == "").cast("int")).alias("e"))
    at = F.least(size - 1, F.floor(9 * size / 10)).cast("int") + 1
    return x.select("key", "n", F.element_at("a", at).alias("p90"), F.round(F.col("i") / size, 9).alias("indented"), F.round(F.col("e") / size, 9).alias("blank"))


@query(STATS + "SELECT key, CASE WHEN indented >= 0.2 THEN 'indented' WHEN p90 <= 100 AND n > 3 THEN 'wrapped' ELSE 'line' END AS layout FROM st")
def layout_mode(spark, d):
    return layout_stats(spark, d).select("key", F.when(F.col("indented") >= 0.2, "indented").when((F.col("p90") <= 100) & (F.col("n") > 3), "wrapped").otherwise("line").alias("layout"))


@query(L + ", z AS (SELECT key, length(t) // 10 AS size, sum(length(t)) AS chars FROM lines GROUP BY ALL) SELECT key, size AS base FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY chars DESC, size) AS n FROM z) WHERE n = 1")
def base_size_mode(spark, d):
    z = lines(spark, d).groupBy("key", F.floor(F.length("t") / 10).alias("size")).agg(F.sum(F.length("t")).alias("chars"))
    return z.groupBy("key").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("base"))


@query(L + ", z AS (SELECT key, b, length(t) AS n, max(length(t)) OVER (PARTITION BY key) AS m FROM lines) SELECT key, b, CASE WHEN 100 * n <= 86 * m THEN -1 WHEN 100 * n >= 155 * m THEN 2 WHEN 100 * n >= 115 * m THEN 1 ELSE 0 END AS z FROM z")
def size_bucket(spark, d):
    n, m = 100 * F.length("t"), F.max(F.length("t")).over(W.partitionBy("key"))
    return lines(spark, d).select("key", "b", F.when(n <= 86 * m, -1).when(n >= 155 * m, 2).when(n >= 115 * m, 1).otherwise(0).alias("z"))


@query(L + "SELECT key, b, count_if(length(t) < 40) OVER (PARTITION BY key) * 3 > count(*) OVER (PARTITION BY key) AND count(*) OVER (PARTITION BY key) >= 4 AS calm FROM lines")
def calm_spacing(spark, d):
    w = W.partitionBy("key")
    return lines(spark, d).select("key", "b", ((F.count_if(F.length("t") < 40).over(w) * 3 > F.count("*").over(w)) & (F.count("*").over(w) >= 4)).alias("calm"))


@query(L + "SELECT key, b FROM lines WHERE t = upper(t) AND t <> lower(t)")
def caps_lines(spark, d):
    return lines(spark, d).where(T.caps_line(F.col("t"))).select("key", "b")


@query(L + r"SELECT key, b FROM lines WHERE regexp_matches(t, '(?i)^\s*(chapter|part|book|chapitre|partie|livre|kapitel|teil|buch|capítulo|parte|libro)\s+([0-9]+|[ivxlcdm]+)\b')")
def numbered_heading(spark, d):
    return lines(spark, d).where(T.numbered_heading(F.col("t"))).select("key", "b")


@query(L + r"""SELECT key, b, regexp_matches(t, '[.!?…]["''”’»)\]]*$') AS prose, regexp_matches(t, '^\p{Lu}( \p{Lu}){4,}$') AS spaced FROM lines""")
def line_tests(spark, d):
    return lines(spark, d).select("key", "b", T.prose_end(F.col("t")).alias("prose"), T.letter_spaced(F.col("t")).alias("spaced"))


@query()
def title_sort_key(spark, d):
    return read(spark, d, "pages").select("page_id", T.title_sort_key(H.page_title(F.col("html"))).alias("sort_key"))


@query()
def depth_normalise(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), (F.col("turn") * 7 % 5).cast("int").alias("d"))
    return S.fold_depths(x)


@query("WITH e AS (SELECT conv_id AS key, turn AS ord, turn * 7 % 5 AS d FROM conversations) SELECT key, ord, (SELECT max(p.ord) FROM e p WHERE p.key = e.key AND p.ord < e.ord AND p.d < e.d) AS parent FROM e")
def contents_parents(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), (F.col("turn") * 7 % 5).alias("d"))
    return S.parents(x).select("key", "ord", "parent")


@query("SELECT conv_id AS key, turn AS ord, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn * 7 % 5, turn) AS INTEGER) AS pos FROM conversations")
def reading_order(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), (F.col("turn") * 7 % 5).alias("b"))
    return S.reading_order(x).select("key", "ord", "pos")


@query("WITH e AS (SELECT conv_id AS key, turn AS ord, turn // 2 * 2 AS b FROM conversations) SELECT key, ord, (SELECT min(x.b) FROM e x WHERE x.key = e.key AND x.b > e.b) AS end_b FROM e")
def entry_ends(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), (F.floor(F.col("turn") / 2) * 2).alias("b"))
    return S.entry_ends(x).select("key", "ord", "end_b")


@query("WITH e AS (SELECT conv_id AS key, turn AS ord, role AS t, turn // 2 AS b FROM conversations), f AS (SELECT *, coalesce(lag(t) OVER w = t AND lag(b) OVER w = b, false) AS same FROM e WINDOW w AS (PARTITION BY key ORDER BY ord)) SELECT key, ord FROM f WHERE NOT same")
def repeats_removed(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), F.col("role").alias("t"), F.floor(F.col("turn") / 2).alias("b"))
    return S.without_repeats(x).select("key", "ord")


@query("WITH c AS (SELECT conv_id AS key, turn AS col, length(text) AS n FROM conversations), w AS (SELECT key, col, CAST(greatest(4, least(36, max(n))) AS BIGINT) AS width FROM c GROUP BY key, col) SELECT key, col, width, CAST(coalesce(sum(width) OVER (PARTITION BY key ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w")
def column_widths(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("col"), F.col("text").alias("t"))
    return S.column_widths(x)


@query()
def picture_budget(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), F.length("text").alias("size"))
    return S.within_budget(x, 4, 400, 700)


@query()
def shared_suffix(spark, d):
    """The longest run of last words that all titles of a host share."""
    x = read(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.reverse(F.split(F.coalesce(H.page_title(F.col("html")), F.lit("")), " ")).alias("w"))
    ends = x.select("host", F.posexplode("w").alias("i", "word")).groupBy("host", "i", "word").agg(F.count("*").alias("n"))
    total = x.groupBy("host").agg(F.count("*").alias("titles"))
    full = ends.join(total, "host").where("n = titles").withColumn("g", F.col("i") - F.row_number().over(W.partitionBy("host").orderBy("i"))).where("g = -1")
    suffix = full.groupBy("host").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("i", "word")))), lambda s: s["word"]), " ").alias("suffix"))
    return total.join(suffix, "host", "left").select("host", "titles", F.coalesce("suffix", F.lit("")).alias("suffix"))


@query("SELECT user_id AS key, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS b FROM events GROUP BY user_id")
def place_latest(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("b"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id AS key, min(ts) AS started, max(ts) + INTERVAL 20 MINUTE AS ended, count(*) AS saves FROM s GROUP BY user_id, n""")
def idle_sessions(spark, d):
    x = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = x.groupBy(F.col("user_id").alias("key"), F.session_window("ts", "20 minutes").alias("s")).agg(F.count("*").alias("saves"))
    return s.select("key", F.col("s.start").cast("timestamp_ntz").alias("started"), F.col("s.end").cast("timestamp_ntz").alias("ended"), "saves")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hour_counts(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, CASE WHEN n_chars % 101 = 0 THEN '' WHEN n_chars % 101 = 100 THEN '100%' ELSE CAST(greatest(1, least(99, CAST(n_chars % 101 AS INTEGER))) AS VARCHAR) || '%' END AS label FROM documents")
def percent_label(spark, d):
    return read(spark, d, "documents").select("doc_id", C.percent_label(F.col("n_chars") % 101 / 100).alias("label"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '(?i)\.(fb2\.zip|epub|mobi|azw3?|prc|fb2|txt|md|html?|xhtml|cbz|zip)$', ''), '[_\s]+', ' ', 'g')) AS title FROM pages")
def file_title(spark, d):
    return read(spark, d, "pages").select("page_id", C.file_title(F.col("url")).alias("title"))


@query(r"SELECT doc_id, CASE WHEN length(x) > 60 THEN rtrim(substr(x, 1, 60)) || '…' ELSE x END AS title FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)")
def short_title(spark, d):
    return read(spark, d, "documents").select("doc_id", C.shorten(F.col("text"), 60).alias("title"))


@query("SELECT c_custkey, split_part(c_name, '#', 2) || ' ' || split_part(c_name, '#', 1) AS name FROM customer")
def natural_name(spark, d):
    return read(spark, d, "customer").select("c_custkey", C.natural_name(F.regexp_replace("c_name", "#", ", ")).alias("name"))


from quire.plans import blocks, reading  # noqa: E402, F401 - their queries join the same tables
