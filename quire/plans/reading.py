"""Queries of contents, links, places and reading functions over the test tables. Where books are missing, lines and turns stand in."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.functions import text as T
from quire.operators import contents as N
from quire.operators import order as O
from quire.operators import sequence as S
from quire.plans.queries import L, lines, query, read

SNIPPET = r"substr(trim(regexp_replace(replace({}, chr(173), ''), '\s+', ' ', 'g')), 1, 48)"


def turns(spark, sf_dir, **more):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), *(c.alias(n) for n, c in more.items()))


@query(L + f"SELECT key, b, {SNIPPET.format('t')} AS x FROM lines")
def snippets(spark, d):
    return lines(spark, d).select("key", "b", R.snippet(F.col("t")).alias("x"))


@query()
def place_marks(spark, d):
    return lines(spark, d).select("key", "b", R.mark(R.snippet(F.col("t"))).alias("x"))


@query(r"SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM pages")
def plain_blocks(spark, d):
    return read(spark, d, "pages").select("page_id", R.plain_block(F.col("html")).alias("t"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM pages")
def escaped_markup(spark, d):
    return read(spark, d, "pages").select("page_id", R.escape(F.col("html")).alias("t"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN strlen(t) <= 400 THEN t ELSE regexp_replace(substr(t, 1, (SELECT max(i) FROM range(401) r(i) WHERE strlen(substr(t, 1, CAST(i AS INTEGER))) <= 400)), '^\s+|\s+$', '', 'g') END AS t FROM c""")
def clipboard_text(spark, d):
    """With a bound of 400 bytes, which most of the texts pass; none has an empty line."""
    return read(spark, d, "documents").select("doc_id", R.clipped(F.col("text"), 400).alias("t"))


@query(L + ", a AS (SELECT key, b, t, (SELECT max(x.b) FROM lines x WHERE x.key = l.key) AS last FROM lines l) SELECT key, string_agg(CASE WHEN b = 1 THEN substr(t, 6) WHEN b = 3 THEN substr(t, 1, 9) ELSE t END, chr(10) ORDER BY b) AS t FROM a WHERE b BETWEEN 1 AND 3 GROUP BY key")
def selection_text(spark, d):
    part = F.when(F.col("b") == 1, F.substring("t", 6, 1 << 30)).when(F.col("b") == 3, F.substring("t", 1, 9)).otherwise(F.col("t"))
    x = lines(spark, d).where("b between 1 and 3").select("key", "b", part.alias("t"))
    return x.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "t"))), lambda s: s["t"]), "\n").alias("t"))


@query(L + f""", x AS (SELECT key, b, t, {SNIPPET.format('t')} AS x FROM lines), m AS (SELECT key, max(b) AS last FROM lines GROUP BY key),
p AS (SELECT m.key, CAST(m.last // 2 + m.key % 2 AS BIGINT) AS b, CAST(m.key * 37 % 1000 AS BIGINT) AS p, CASE WHEN m.key % 3 = 2 THEN '?' ELSE x.x END AS x, m.last FROM m JOIN x ON x.key = m.key AND x.b = m.last // 2),
sh AS (SELECT p.*, (SELECT max(o.b) FROM o WHERE o.key = p.key AND p.p > 0 AND o.off * 1000 <= p.p * o.total) AS share FROM p), g AS (SELECT *, coalesce(share, least(b, last)) AS guess FROM sh),
f AS (SELECT g.key, g.b, count_if(x.b = g.b) > 0 AS kept, arg_min(x.b, abs(x.b - g.guess) * 1000000 + x.b) FILTER (abs(x.b - g.guess) <= 3000) AS moved FROM g JOIN x ON x.key = g.key AND x.x = g.x WHERE abs(x.b - g.guess) <= 3000 OR x.b = g.b GROUP BY ALL)
SELECT g.key, CASE WHEN f.kept THEN g.b ELSE coalesce(f.moved, g.share, least(g.b, g.last)) END AS found, CASE WHEN f.kept THEN 'kept' WHEN f.moved IS NOT NULL THEN 'moved' WHEN g.share IS NOT NULL THEN 'share' ELSE 'last' END AS how FROM g LEFT JOIN f ON f.key = g.key""")
def relocated_places(spark, d):
    """Every document is opened again at a place one block off, or with words that are gone."""
    x = lines(spark, d).withColumn("x", R.snippet(F.col("t")))
    half = x.groupBy("key").agg(F.max("b").alias("last")).withColumn("h", F.floor(F.col("last") / 2).cast("int"))
    words = x.select(F.col("key").alias("k"), F.col("b").alias("hb"), "x")
    places = half.join(words, (F.col("key") == F.col("k")) & (F.col("h") == F.col("hb"))).select("key", (F.col("h") + F.col("key") % 2).cast("long").alias("b"), (F.col("key") * 37 % 1000).alias("p"), F.when(F.col("key") % 3 == 2, "?").otherwise(F.col("x")).alias("x"))
    return N.relocate(places, x)


@query(L + """, a AS (SELECT key, 's' || b // 4 AS name, CASE b % 4 WHEN 0 THEN '' WHEN 1 THEN 'P1' WHEN 2 THEN 'p2' ELSE 'p1' END AS fragment, b FROM lines WHERE b % 5 < 4),
l AS (SELECT key, b AS id, 's' || (b * 7 % 11) AS name, CASE b % 5 WHEN 0 THEN '' WHEN 1 THEN 'p1' WHEN 2 THEN 'P2' WHEN 3 THEN 'none' ELSE 'P1' END AS fragment FROM lines)
SELECT key, id, name, fragment, coalesce((SELECT min(a.b) FROM a WHERE a.key = l.key AND a.name = l.name AND a.fragment = l.fragment), (SELECT min(a.b) FROM a WHERE a.key = l.key AND a.name = l.name AND lower(a.fragment) = lower(l.fragment)),
(SELECT min(a.b) FROM a WHERE a.key = l.key AND a.name = l.name AND a.fragment = '')) AS b FROM l""")
def link_targets(spark, d):
    x = lines(spark, d)
    anchors = x.where("b % 5 < 4").select("key", F.concat(F.lit("s"), F.floor(F.col("b") / 4)).alias("name"), F.element_at(F.array(*map(F.lit, ("", "P1", "p2", "p1"))), F.col("b") % 4 + 1).alias("fragment"), "b")
    links = x.select("key", F.col("b").alias("id"), F.concat(F.lit("s"), F.col("b") * 7 % 11).alias("name"), F.element_at(F.array(*map(F.lit, ("", "p1", "P2", "none", "P1"))), F.col("b") % 5 + 1).alias("fragment"))
    return N.resolve(links, anchors)


@query()
def contents_labels(spark, d):
    """Every third turn is a label without a target."""
    return N.labels_open(turns(spark, d, d=F.col("turn") * 7 % 5, b=F.when(F.col("turn") % 3 > 0, F.col("turn"))))


@query("""WITH RECURSIVE e AS (SELECT conv_id AS key, turn AS ord, turn * 7 % 5 AS d, role AS t FROM conversations), p AS (SELECT *, (SELECT max(x.ord) FROM e x WHERE x.key = e.key AND x.ord < e.ord AND x.d < e.d) AS parent FROM e),
r AS (SELECT key, ord, t AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.key, p.ord, r.path || ' › ' || p.t FROM p JOIN r ON r.key = p.key AND r.ord = p.parent) SELECT key, ord, path FROM r""")
def contents_paths(spark, d):
    return N.paths(turns(spark, d, d=F.col("turn") * 7 % 5, t=F.col("role")))


@query("SELECT conv_id AS key, turn AS ord, coalesce(lead(turn * 7 % 5) OVER (PARTITION BY conv_id ORDER BY turn) > turn * 7 % 5, false) AS branch FROM conversations")
def contents_branches(spark, d):
    return N.with_children(turns(spark, d, d=F.col("turn") * 7 % 5)).select("key", "ord", "branch")


@query(L + ", k AS (SELECT key, b, length(t) < 40 AS h, lag(length(t) < 40) OVER (PARTITION BY key ORDER BY b) AS was FROM lines) SELECT key, b FROM k WHERE b > 0 AND (b % 3 = 0 OR b % 4 = 1) AND NOT coalesce(was, false)")
def page_starts(spark, d):
    x = lines(spark, d)
    return N.page_starts(x.select("key", "b", F.when(F.length("t") < 40, "h").otherwise("p").alias("k")), x.where("b % 3 = 0").unionByName(x.where("b % 4 = 1")))


@query(L + ", h AS (SELECT key, b, length(t) % 4 + 1 AS l FROM lines), n AS (SELECT *, count(*) OVER (PARTITION BY key ORDER BY l) AS upto, min(l) OVER (PARTITION BY key) AS first FROM h) SELECT key, b, CAST(l AS INTEGER) AS l FROM n WHERE upto <= 5 OR l = first")
def heading_cap(spark, d):
    return N.capped_levels(lines(spark, d).select("key", "b", (F.length("t") % 4 + 1).alias("l")), 5).select("key", "b", "l")


PLACES = "p AS (SELECT page_id // 2 * 4 AS key, url AS path, ' ' || upper(" + "regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)" + ") AS title, page_id % 13 AS t FROM pages WHERE page_id % 5 < 4)"


def _places(spark, d):
    from quire.functions import html as H

    title = F.coalesce(H.page_title(F.col("html")), F.lit(""))
    x = read(spark, d, "pages").select("page_id", F.col("url").alias("path"), title.alias("name"))
    places = x.where("page_id % 5 < 4").select((F.floor(F.col("page_id") / 2) * 4).alias("key"), "path", F.concat(F.lit(" "), T.upper(F.col("name"))).alias("title"), (F.col("page_id") % 13).alias("t"))
    return x.select(F.col("page_id").alias("key"), "path", F.col("name").alias("title")), places


@query("WITH " + PLACES + """, b AS (SELECT page_id AS key, url AS path, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages)
SELECT key, path, title, coalesce((SELECT max(p.t) FROM p WHERE p.key = b.key), (SELECT max(p.t) FROM p WHERE p.path = b.path AND lower(trim(p.title)) = lower(trim(b.title)))) AS t FROM b""")
def remembered_places(spark, d):
    return N.remembered(*_places(spark, d))


@query("WITH " + PLACES + """, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, path DESC) AS i FROM p) WHERE i = 1)
SELECT key, t FROM (SELECT *, row_number() OVER (PARTITION BY path, lower(trim(title)) ORDER BY t DESC, key DESC) AS j FROM n) WHERE j = 1""")
def superseded_places(spark, d):
    return N.superseded(_places(spark, d)[1]).select("key", "t")


@query("SELECT doc_id AS path, n_chars AS size, doc_id % 7 AS mtime, doc_id % 5 > 0 AND doc_id % 11 > 0 AND doc_id % 3 > 0 AS good FROM documents")
def reusable_entries(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 7).alias("mtime"))
    index = files.select("path", F.when(F.col("path") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("path") % 11 == 0, -1).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("path") % 3 == 0, "").otherwise("k").alias("key"))
    return N.reusable(files, index)


@query("SELECT doc_id AS path, n, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS i FROM (SELECT doc_id, 0 AS n, n_chars AS size FROM documents UNION ALL SELECT doc_id, 1, -1 FROM labels)) WHERE i = 1")
def index_union(spark, d):
    books = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("n"), F.col("n_chars").alias("size"))
    pending = read(spark, d, "labels").select(F.col("doc_id").alias("path"), F.lit(1).alias("n"), F.lit(-1).cast("long").alias("size"))
    return N.last_wins(books.unionByName(pending), "path", F.col("n"))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id * 3 % (SELECT count(*) FROM documents) AS b FROM documents UNION SELECT doc_id, doc_id + 7 FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT e.b FROM r JOIN e ON e.a = r.id) SELECT id FROM r""")
def linked_documents(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("a"))
    edges = x.select("a", (F.col("a") * 3 % F.lit(x.count())).alias("b")).unionByName(x.where("a % 2 = 0").withColumn("b", F.col("a") + 7))
    return O.reachable(spark.range(1, 2), edges).select("id")


@query("SELECT conv_id, count(*) AS n, sha1(string_agg(turn || ':' || length(text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def ordered_digest(spark, d):
    part = F.struct("turn", F.concat_ws(":", "turn", F.length("text").cast("string")).alias("s"))
    x = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(part)).alias("l"))
    return x.select("conv_id", "n", F.sha1(F.array_join(F.transform("l", lambda s: s["s"]), "\n").cast("binary")).alias("digest"))


@query("SELECT host, arg_min(page_id, (NOT exact, -size, page_id)) AS page_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, page_id % 17 = 3 AS exact, length(html) AS size FROM pages) GROUP BY host")
def cover_choice(spark, d):
    x = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), (F.col("page_id") % 17 == 3).alias("exact"), F.length("html").alias("size"))
    return x.groupBy("host").agg(F.min_by("page_id", F.struct(~F.col("exact"), -F.col("size"), "page_id")).alias("page_id"))


@query(L + "SELECT key, b // 3 AS start, arg_max(t, b) AS name FROM lines GROUP BY ALL")
def section_names(spark, d):
    return lines(spark, d).groupBy("key", F.floor(F.col("b") / 3).alias("start")).agg(F.max_by("t", "b").alias("name"))


@query(r"""SELECT conv_id, turn, ['','m','mm','mmm'][turn * 397 % 3999 // 1000 + 1] || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][turn * 397 % 3999 // 100 % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][turn * 397 % 3999 // 10 % 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][turn * 397 % 3999 % 10 + 1] AS roman,
turn * 397 % 3999 AS back, CASE WHEN turn < 26 THEN chr(97 + CAST(turn AS INTEGER)) ELSE chr(96 + CAST(turn // 26 AS INTEGER)) || chr(97 + CAST(turn % 26 AS INTEGER)) END AS letter FROM conversations""")
def list_markers(spark, d):
    n = F.col("turn") * 397 % 3999
    return read(spark, d, "conversations").select("conv_id", "turn", R.roman(n).alias("roman"), R.roman_value(R.roman(n)).cast("long").alias("back"), R.letter_marker(F.col("turn") + 1).alias("letter"))


@query("SELECT event_id, translate(CAST(user_id AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS t FROM events")
def raised_numbers(spark, d):
    return read(spark, d, "events").select("event_id", R.raised(F.col("user_id").cast("string")).alias("t"))


@query(r"WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN regexp_replace(regexp_replace(substr(t, 1, 120), ' [^ ]*$', ''), '[ ,;:-]+$', '') || '…' ELSE t END AS t FROM x")
def contents_titles(spark, d):
    return read(spark, d, "documents").select("doc_id", R.contents_title(F.col("text")).alias("t"))


@query(r"WITH x AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\s', ' ', 'g'), ' '), lambda w: w <> '') AS a FROM documents), y AS (SELECT doc_id, array_to_string(list_filter(a, lambda w, i: list_position(a, w) = i)[1:20], ', ') AS t FROM x) SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '…' ELSE t END AS t FROM y")
def author_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", R.author_line(F.split("text", r"\s")).alias("t"))


@query(L + "SELECT key, b, translate(t, ' ' || chr(10) || chr(160) || chr(8239) || chr(173), '') <> '' AS visible FROM lines")
def visible_blocks(spark, d):
    return lines(spark, d).select("key", "b", R.visible(F.col("t")).alias("visible"))


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 10 ELSE least(60, greatest(10, value)) END AS v FROM events")
def clamped(spark, d):
    return read(spark, d, "events").select("event_id", R.clamp(F.col("value"), 10.0, 60.0).alias("v"))


@query(r"SELECT doc_id, (length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))) * 50 > length(text) AS noisy FROM documents")
def noise_test(spark, d):
    return read(spark, d, "documents").select("doc_id", R.noisy(F.col("text")).alias("noisy"))


@query(L + ", j AS (SELECT key, count(*) AS n, to_json(list(struct_pack(b := b, n := length(t)) ORDER BY b)) AS blocks FROM lines GROUP BY key) SELECT key, '{\"key\":' || key || ',\"blocks\":' || blocks || '}' AS json FROM j WHERE strlen(blocks) <= 50331648")
def book_json(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("b", F.length("t").alias("n"))))
    x = lines(spark, d).groupBy("key").agg(listed.alias("blocks"))
    return x.select("key", F.to_json(F.struct("key", "blocks")).alias("json")).where(F.octet_length("json") <= 48 << 20)


@query("SELECT user_id AS key, date_trunc('hour', ts) AS hour, arg_max(event_id, (ts, event_id)) AS kept, count(*) - 1 AS replaced FROM events GROUP BY ALL")
def latest_request(spark, d):
    """Of the requests of a user in an hour, the last; those before it are replaced."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return read(spark, d, "events").groupBy(F.col("user_id").alias("key"), hour.alias("hour")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("kept"), (F.count("*") - 1).alias("replaced"))


@query("SELECT event_id, CAST(greatest(0, coalesce(json_extract(props, '$.k')::BIGINT, 0)) AS BIGINT) AS b, least(1, greatest(0, value / 100)) AS p FROM events")
def saved_state(spark, d):
    """Saved fields read from JSON; what is missing or out of bounds is put right."""
    x = read(spark, d, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"), "value")
    return x.select("event_id", F.greatest(F.lit(0), F.coalesce("k", F.lit(0))).cast("long").alias("b"), R.clamp(F.col("value") / 100, 0.0, 1.0).alias("p"))


@query()
def natural_order(spark, d):
    x = read(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "page_id", T.natural_key(F.col("url")).alias("nat"))
    return x.select("host", "page_id", F.row_number().over(W.partitionBy("host").orderBy("nat", "page_id")).alias("pos"))


@query(L + ", f AS (SELECT key, min(b) FILTER (b % 9 = 8) AS first, count(*) AS n FROM lines GROUP BY key) SELECT key, first, coalesce(first > 7 AND first * 20 > n, false) AS opening FROM f")
def late_contents(spark, d):
    """Contents that start late get an entry for the opening: here every ninth block is an entry."""
    s = lines(spark, d).groupBy("key").agg(F.min(F.when(F.col("b") % 9 == 8, F.col("b"))).alias("first"), F.count("*").alias("n"))
    return s.select("key", "first", F.coalesce((F.col("first") > 7) & (F.col("first") * 20 > F.col("n")), F.lit(False)).alias("opening"))


@query(L + ", c AS (SELECT key, b // 3 AS s, min(b) AS b FROM lines GROUP BY ALL), e AS (SELECT key, b, lead(b) OVER (PARTITION BY key ORDER BY b) AS upto FROM (SELECT key, b FROM lines WHERE b % 5 = 0)) SELECT e.key, e.b AS entry, c.b AS child FROM e JOIN c ON c.key = e.key AND c.b >= e.b AND (e.upto IS NULL OR c.b < e.upto)")
def spanned_sections(spark, d):
    """Sections that begin within a contents entry: as of its start, so no range join."""
    x = lines(spark, d)
    sections = x.groupBy("key", F.floor(F.col("b") / 3).alias("s")).agg(F.min("b").alias("b"))
    entries = x.where("b % 5 = 0").select("key", "b", F.col("b").alias("ord"))
    return S.as_of(sections.select("key", "b").unionByName(entries.select("key", "b")).distinct(), entries).join(sections.select("key", "b"), ["key", "b"], "left_semi").where("ord is not null").select("key", F.col("ord").alias("entry"), F.col("b").alias("child"))
