"""Queries of headings, titles, links, and rules over blocks. Where books are missing, lines, turns and pages stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import split as X
from quire.functions import text as S
from quire.functions import titles as T
from quire.operators import blocks as K
from quire.operators import contents as N
from quire.plans.queries import L, lines, query, read

ONE_OF = "(?:" + "|".join(f"{T.PARTS} {T.CHAPTERS}".split()) + ")"
SAID = r"(?:\d{1,4}|" + "|".join(T.NUMBERS.split()) + r"|(?:twenty|thirty|forty|fifty)(?:-[a-z]+)?|[ivxlcdm]+)"


@query(L + rf""", x AS (SELECT key, b, CASE b % 8 WHEN 0 THEN 'Kapitel ' || b + 1 WHEN 1 THEN 'EPILOGUE' WHEN 2 THEN '第' || b || '章 x' WHEN 3 THEN '## ' || t WHEN 4 THEN repeat('-', b % 5) WHEN 5 THEN CAST(b % 2000 AS VARCHAR) || '.' WHEN 6 THEN '* * *' ELSE t END AS t FROM lines)
SELECT key, b, CASE WHEN regexp_full_match(t, '(?i)\[?\s*{ONE_OF}\s+{SAID}(?:[^\w’''].*)?') THEN 'numbered' WHEN regexp_full_match(t, '(?i){T._any(T.NAMES, ",")}\s*[.:]?') THEN 'named'
WHEN regexp_full_match(t, '{T.IDEOGRAPHIC}') THEN 'ideographic' WHEN regexp_full_match(t, '(\d{{1,3}}|[IVXLCDM]+)\.?') THEN 'number' WHEN regexp_full_match(t, '#{{1,6}}\s+.*') THEN 'markdown'
WHEN regexp_full_match(t, '={{3,}}|-{{3,}}') THEN 'underline' WHEN regexp_full_match(t, '([*•·~#=_-]\s*){{3,}}|\*') THEN 'rule' END AS kind FROM x""")
def heading_kinds(spark, d):
    b = F.col("b")
    said = [F.concat(F.lit("Kapitel "), b + 1), F.lit("EPILOGUE"), F.concat(F.lit("第"), b, F.lit("章 x")), F.concat(F.lit("## "), "t"), F.repeat(F.lit("-"), b % 5), F.concat((b % 2000).cast("string"), F.lit(".")), F.lit("* * *"), F.col("t")]
    return lines(spark, d).select("key", "b", T.heading_kind(F.element_at(F.array(*said), b % 8 + 1)).alias("kind"))


@query(L + r""", x AS (SELECT key, b, CASE b % 3 WHEN 0 THEN upper(substr(t, 1, 50)) WHEN 1 THEN upper(substr(t, 1, 20)) || '.' ELSE t END AS t FROM lines)
SELECT key, b, length(t) BETWEEN 3 AND 60 AND upper(t) = t AND lower(t) <> t AND regexp_matches(t, '^[\p{L}\p{N}]') AND length(regexp_replace(t, '\P{L}', '', 'g')) >= 3 AND right(t, 1) NOT IN ('.', ',', ';', ':') AND t NOT IN ('THE END', 'END', 'FINIS', 'FIN') AS caps,
right(t, 1) IN (',', ';') OR (right(t, 1) = '.' AND NOT (regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '\p{Ll}|\p{Lt}')) AND NOT regexp_full_match(t, '(?i)(chapter|part|book|volume|section|letter|canto|act|scene|chapitre|livre|kapitel|teil|cap[ií]tulo|capitolo)\s+(\d+|[ivxlcdm]+)\.')) AS prose FROM x""")
def heading_tests(spark, d):
    t = F.when(F.col("b") % 3 == 0, S.upper(F.substring("t", 1, 50))).when(F.col("b") % 3 == 1, F.concat(S.upper(F.substring("t", 1, 20)), F.lit("."))).otherwise(F.col("t"))
    return lines(spark, d).select("key", "b", t.alias("t")).select("key", "b", T.caps_heading(F.col("t")).alias("caps"), T.ends_like_prose(F.col("t")).alias("prose"))


SPACED = "array_to_string(string_split(upper(regexp_replace(substr(t, 1, 9), '[^a-zA-Z]', '', 'g')), ''), ' ')"


@query(L + f""", x AS (SELECT key, b // 2 AS b, CASE WHEN b % 4 = 0 THEN 'R U N N I N G' WHEN b % 4 = 2 THEN {SPACED} ELSE 'R U N N I N G I' END AS t FROM lines WHERE b % 2 = 0 OR b = 1),
y AS (SELECT key, t, min(b) AS b, count(*) AS n, replace(t, ' ', '') AS said FROM x WHERE length(replace(t, ' ', '')) >= 5 GROUP BY key, t)
SELECT key, b, t FROM y WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM y h WHERE h.key = y.key AND h.n > 1 AND (contains(h.said, y.said) OR (contains(y.said, h.said) AND regexp_full_match(substr(y.said, 1, instr(y.said, h.said) - 1) || substr(y.said, instr(y.said, h.said) + length(h.said)), '[IO]*'))))""")
def scanned_titles(spark, d):
    """Of letter-spaced lines, those that are no running head."""
    spaced = F.array_join(F.split(F.upper(F.regexp_replace(F.substring("t", 1, 9), "[^a-zA-Z]", "")), ""), " ")
    t = F.when(F.col("b") % 4 == 0, "R U N N I N G").when(F.col("b") % 4 == 2, spaced).otherwise("R U N N I N G I")
    return K.spaced_titles(lines(spark, d).where("b % 2 = 0 or b = 1").select("key", F.floor(F.col("b") / 2).alias("b"), t.alias("t")))


@query(L + ", x AS (SELECT key, b, CASE b % 7 WHEN 3 THEN 'hr' WHEN 5 THEN 'li' ELSE 'p' END AS k, b % 11 = 4 AS a, b % 3 = 0 OR b % 8 = 1 AS f FROM lines), y AS (SELECT *, lead(k) OVER w AS k2, lead(a) OVER w AS a2, lead(f) OVER w AS f2 FROM x WINDOW w AS (PARTITION BY key ORDER BY b)) SELECT key, b FROM y WHERE f AND NOT f2 AND NOT a2 AND k2 IN ('p', 'li')")
def prose_titles(spark, d):
    x = lines(spark, d).select("key", "b", F.when(F.col("b") % 7 == 3, "hr").when(F.col("b") % 7 == 5, "li").otherwise("p").alias("k"), F.when(F.col("b") % 11 == 4, "c").alias("a"))
    return K.titles_before_prose(x, x.where("b % 3 = 0 or b % 8 = 1"))


@query(L + ", x AS (SELECT key, b, b // 6 AS section, CASE b % 5 WHEN 4 THEN 'img' WHEN 3 THEN 'li' ELSE 'p' END AS k FROM lines) SELECT key, b, section, k, CASE WHEN b = min(b) OVER (PARTITION BY key, section) AND k <> 'img' THEN 2 END AS s FROM x")
def section_gaps(spark, d):
    x = lines(spark, d).select("key", "b", F.floor(F.col("b") / 6).alias("section"), F.when(F.col("b") % 5 == 4, "img").when(F.col("b") % 5 == 3, "li").otherwise("p").alias("k"))
    return K.section_gaps(x)


@query(L + """, x AS (SELECT key, b, b // 8 AS section, CASE b % 5 WHEN 4 THEN 'hr' WHEN 3 THEN 'li' ELSE 'p' END AS k, CAST(key % 3 + length(t) % 3 AS INTEGER) AS i, b % 9 = 2 AS a FROM lines),
y AS (SELECT *, CASE WHEN count(*) FILTER (k = 'p' AND NOT a) OVER w >= 4 THEN min(i) FILTER (k = 'p' AND NOT a) OVER w END AS shared FROM x WINDOW w AS (PARTITION BY key, section))
SELECT key, b, CASE WHEN k = 'hr' OR coalesce(shared, 0) = 0 THEN i WHEN i > shared THEN i - shared END AS i FROM y""")
def calm_indent(spark, d):
    x = lines(spark, d).select("key", "b", F.floor(F.col("b") / 8).alias("section"), F.when(F.col("b") % 5 == 4, "hr").when(F.col("b") % 5 == 3, "li").otherwise("p").alias("k"), (F.col("key") % 3 + F.length("t") % 3).cast("int").alias("i"), F.when(F.col("b") % 9 == 2, "c").alias("a"))
    return K.calm_indent(x).select("key", "b", "i")


@query(L + """, e AS (SELECT key, 'declared' AS list, b FROM lines WHERE b % 4 = 0 AND b < key % 5 * 4 UNION ALL SELECT key, 'headings', b FROM lines WHERE b < key % 7 UNION ALL SELECT key, 'sections', b // 2 FROM lines WHERE b < key % 11 UNION ALL SELECT key, 'likes', b FROM lines WHERE b < key % 13 UNION ALL SELECT key, 'numbered', b FROM lines),
n AS (SELECT key, count(DISTINCT b) FILTER (list = 'declared') AS d, count(DISTINCT b) FILTER (list = 'headings') AS h, count(DISTINCT b) FILTER (list = 'sections') AS s, count(DISTINCT b) FILTER (list = 'likes') AS l, count(DISTINCT b) FILTER (list = 'numbered') AS m FROM e GROUP BY key),
c AS (SELECT *, greatest(h, s) AS g, CASE WHEN h >= s THEN 'headings' ELSE 'sections' END AS gn, CASE WHEN d < 3 THEN d + 1 ELSE 3 END AS need FROM n)
SELECT key, CASE WHEN d >= 3 AND key % 3 * 2 <= 3 THEN 'declared' WHEN g >= 3 AND g >= need THEN gn WHEN l >= 3 AND l >= need THEN 'likes' WHEN m >= 3 AND m >= need THEN 'numbered' WHEN g >= need THEN gn WHEN l >= need THEN 'likes' ELSE 'declared' END AS chosen FROM c""")
def contents_choice(spark, d):
    x = lines(spark, d).select("key", "b")
    of = lambda name, test, b="b": x.where(test).select("key", F.lit(name).alias("list"), F.expr(b).cast("long").alias("b"))
    entries = of("declared", "b % 4 = 0 and b < key % 5 * 4").union(of("headings", "b < key % 7")).union(of("sections", "b < key % 11", "b div 2")).union(of("likes", "b < key % 13")).union(of("numbered", "true"))
    return K.chosen_contents(entries, x.select("key", (F.col("key") % 3).alias("dead"), F.lit(3).alias("targeted")).distinct())


@query(L + ", n AS (SELECT key, max(b) + 1 AS n, min(b) FILTER (b < 9 AND length(t) % 5 = 2) AS at FROM lines GROUP BY key) SELECT n.key, coalesce(n.at + 1, 0) AS first, CASE WHEN n.at IS NULL THEN n.n ELSE coalesce((SELECT max(l.b) FROM lines l WHERE l.key = n.key AND l.b > n.at AND l.b >= n.n - 9 + 1 AND length(l.t) % 5 = 3), n.n) END AS past FROM n")
def own_words(spark, d):
    """Marker lines are those of some lengths; nine lines are searched from both sides."""
    t = F.when(F.length("t") % 5 == 2, "*** START").when(F.length("t") % 5 == 3, "*** END").otherwise("x")
    return K.own_words(lines(spark, d).select("key", "b", t.alias("t")), r"^\*{3} START", r"^\*{3} END", 9)


@query("SELECT page_id, t, t NOT IN ('', 'start', 'unknown') AND NOT (NOT contains(t, ' ') AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[_.-]')) AS kept FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'My-Book-v' || page_id WHEN 2 THEN 'Book ' || page_id || '.' ELSE regexp_extract(url, '[^/]*$') END AS t FROM pages)")
def own_titles(spark, d):
    n = F.col("page_id")
    t = F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(F.lit("My-Book-v"), n)).when(n % 4 == 2, F.concat(F.lit("Book "), n, F.lit("."))).otherwise(F.regexp_extract("url", "[^/]*$", 0))
    return read(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", "t", T.is_title(F.col("t")).alias("kept"))


HREF = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'mailto:' || page_id || '@x' WHEN 2 THEN 'ftp' || url WHEN 3 THEN 'HTTP:// /' ELSE url || ' \"a<' || page_id || '>' END"


@query(f"SELECT page_id, CASE page_id % 5 WHEN 2 THEN NULL WHEN 3 THEN '' ELSE h END AS href, replace(replace(replace(replace(h, ' ', '%20'), '\"', '%22'), '<', '%3C'), '>', '%3E') AS safe FROM (SELECT page_id, {HREF} AS h FROM pages)")
def outer_links(spark, d):
    x = read(spark, d, "pages").select("page_id", F.expr(HREF.replace("'ftp' || url", "concat('ftp', url)")).alias("h"))
    return x.select("page_id", T.external(F.col("h")).alias("href"), T.safe_href(F.col("h")).alias("safe"))


@query("SELECT page_id, t, t <> '' AND NOT regexp_matches(lower(t), '\\.(jpe?g|png)$') AND NOT regexp_full_match(t, '(?i)(image|cover)?[\\s0-9._-]*') AS said FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Image ' || page_id WHEN 1 THEN page_id || '.PNG' WHEN 2 THEN 'cover' WHEN 3 THEN '' ELSE 'A view of ' || page_id END AS t FROM pages)")
def picture_words(spark, d):
    n = F.col("page_id")
    t = F.when(n % 5 == 0, F.concat(F.lit("Image "), n)).when(n % 5 == 1, F.concat(n, F.lit(".PNG"))).when(n % 5 == 2, "cover").when(n % 5 == 3, "").otherwise(F.concat(F.lit("A view of "), n))
    return read(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", "t", T.meaningful(F.col("t")).alias("said"))


@query("SELECT conv_id, turn, 'a ' || CASE WHEN turn % 3 < 2 THEN '<a href=\"b:' || turn * 7 || '\">' || role || '</a>' ELSE role END || ' b' AS t FROM conversations")
def block_links(spark, d):
    """Every third link leads nowhere."""
    t = F.concat(F.lit('a <a href="\x1f'), F.col("turn") % 3, F.lit('\x1f">'), "role", F.lit("</a> b"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.relinked(t, F.array(F.col("turn") * 7, F.col("turn") * 7)).alias("t"))


@query("""WITH RECURSIVE e AS (SELECT conv_id AS key, turn AS ord, turn * 7 % 5 AS d, role || turn AS t FROM conversations), p AS (SELECT *, (SELECT max(x.ord) FROM e x WHERE x.key = e.key AND x.ord < e.ord AND x.d < e.d) AS parent FROM e),
r AS (SELECT key, ord, t, '' AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.key, p.ord, p.t, CASE WHEN r.path = '' THEN r.t ELSE r.path || ' › ' || r.t END FROM p JOIN r ON r.key = p.key AND r.ord = p.parent) SELECT key, ord, t, path FROM r WHERE contains(lower(t), 'us') AND contains(lower(t), '2')""")
def contents_search(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), (F.col("turn") * 7 % 5).alias("d"), F.concat("role", "turn").alias("t"))
    return N.matching(x, " US  2 ")


@query()
def cut_blocks(spark, d):
    """Documents as one block each, every other one as preformatted text."""
    x = read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit(0).alias("b"), F.when(F.col("doc_id") % 2 == 0, "pre").otherwise("p").alias("k"), F.col("text").alias("t"), F.lit(0).alias("f"), F.lit(None).cast("string").alias("m"))
    return K.cut_long(x)


@query("SELECT conv_id, CAST(turn // 3 * 3 AS INTEGER) AS start, count(*) AS n, CAST(greatest(0, least(4 - turn // 3 * 3, count(*))) AS INTEGER) AS hdr FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) GROUP BY conv_id, turn // 3")
def table_parts(spark, d):
    """The turns of a conversation as a table of four header rows, in parts of three rows."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    x = read(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("rows"))
    parts = x.select("conv_id", F.posexplode(X.row_parts(F.transform("rows", lambda r: F.array(r["role"])), F.lit(4), 3)).alias("i", "p"))
    return parts.select("conv_id", (F.col("i") * 3).alias("start"), F.size("p.rows").cast("long").alias("n"), F.col("p.hdr").alias("hdr"))


@query()
def capital_words(spark, d):
    return S.small_batches(lines(spark, d)).select("key", "b", T.capitalised(F.col("t")).alias("t"))
