"""Text work: cleaning, hashes, duplicates, HTML, similarity, packages, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.catalog import projections as p
from usagelens.catalog.oracle_parts import CHATS
from usagelens.catalog.registry import query
from usagelens.functions import text as t
from usagelens.functions.similarity import ngram_cosine
from usagelens.operators import detect, packages, rows, vectors
from usagelens.session import scratch_path, spread

_C = f"WITH {CHATS} "


@query("clean_text", _C + "SELECT chat_id, user_text_clean, sha256(user_text_clean) AS user_text_hash FROM chats")
def clean_text(spark, folder):
    return p.chats(spark, folder).select("chat_id", "user_text_clean", "user_text_hash")


@query("duplicate_texts", """SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id
  FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_texts(spark, folder):
    return p.table(spark, folder, "documents").groupBy(t.content_hash(F.col("text")).alias("text_hash")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("row_duplicates", """SELECT (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS unique_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates_removed FROM documents""")
def row_duplicates(spark, folder):
    return rows.duplicate_counts(p.table(spark, folder, "documents").select("text", "lang"))


@query("rows_per_first_column", "SELECT source AS key, count(*) AS row_count FROM documents GROUP BY 1")
def rows_per_first_column(spark, folder):
    return rows.count_by_first(p.table(spark, folder, "documents").select("source", "lang"))


@query("html_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, folder):
    return spread(p.table(spark, folder, "pages")).select("page_id", t.html_text(F.col("html")).alias("text"))


@query("html_preview", r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 5000) AS text FROM pages""")
def html_preview(spark, folder):
    """The first 5000 characters of the text, the feature's own limit."""
    return spread(p.table(spark, folder, "pages")).select("page_id", t.html_text(F.col("html"), 5000).alias("text"))


@query("word_counts", r"""SELECT conv_id, turn, len(regexp_extract_all(translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', 'ACEEEINOOUsaceeeinoou'),
  '\b[\w''-]+\b')) AS words FROM conversations""")
def word_counts(spark, folder):
    return p.table(spark, folder, "conversations").select("conv_id", "turn", t.word_count(F.col("text")).alias("words"))


@query("conversation_authors", """SELECT CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'model' END AS author,
  count(*) AS turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1""")
def conversation_authors(spark, folder):
    return p.table(spark, folder, "conversations").select(t.normalize_author(F.col("role")).alias("author")).filter(
        "author IS NOT NULL").groupBy("author").agg(F.count("*").alias("turns"))


@query("department_inference", _C + """SELECT chat_id, CASE WHEN contains(lower(user_text), 'budget') THEN 'finance'
  WHEN contains(lower(user_text), 'key') THEN 'security' WHEN contains(lower(user_text), 'nation') THEN 'sales' END AS department FROM chats""")
def department_inference(spark, folder):
    keywords = {"finance": ["budget"], "security": ["key"], "sales": ["nation"]}
    return p.chats(spark, folder).select("chat_id", t.infer_department(F.col("user_text"), keywords).alias("department"))


@query("turn_similarity", """WITH pairs AS (
    SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  gx AS (SELECT conv_id, turn, unnest(CASE WHEN length(x) < 3 THEN [x] ELSE list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) END) AS g FROM pairs),
  gy AS (SELECT conv_id, turn, unnest(CASE WHEN length(y) < 3 THEN [y] ELSE list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3)) END) AS g FROM pairs),
  cx AS (SELECT conv_id, turn, g, count(*) AS n FROM gx GROUP BY ALL), cy AS (SELECT conv_id, turn, g, count(*) AS n FROM gy GROUP BY ALL),
  dots AS (SELECT conv_id, turn, sum(cx.n * cy.n) AS dot FROM cx JOIN cy USING (conv_id, turn, g) GROUP BY 1, 2),
  nx AS (SELECT conv_id, turn, sum(n * n) AS s FROM cx GROUP BY 1, 2), ny AS (SELECT conv_id, turn, sum(n * n) AS s FROM cy GROUP BY 1, 2)
  SELECT conv_id, turn, round(coalesce(dot, 0) / (sqrt(nx.s) * sqrt(ny.s)), 3) AS similarity
  FROM nx JOIN ny USING (conv_id, turn) LEFT JOIN dots USING (conv_id, turn)""")
def turn_similarity(spark, folder):
    """Similarity of every turn to the next one."""
    turns = p.table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = turns.join(following, ["conv_id", "turn"])
    return ngram_cosine(pairs, ["conv_id", "turn"], "text", "next_text")


@query("nearest_vectors", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings),
  m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY 1, 2),
  d AS (SELECT m.label AS query_id, e.vec_id, sum((CAST(e.x AS DOUBLE) - m.c) * (CAST(e.x AS DOUBLE) - m.c)) AS distance FROM e JOIN m USING (i) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
  SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def nearest_vectors(spark, folder):
    """The five vectors nearest to the centre of each label."""
    table = p.table(spark, folder, "embeddings")
    queries = vectors.centroids(table, "label").select(F.col("label").alias("query_id"), F.col("centroid").alias("query"))
    return vectors.nearest(queries, table, 5).withColumn("distance", F.round("distance", 6))


@query("nearest_to_each", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  d AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) ** 2 AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
  SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def nearest_to_each(spark, folder):
    """The five vectors nearest to every vector, from lists to which the later half of the vectors was added."""
    table = p.table(spark, folder, "embeddings")
    lists = vectors.VectorLists.build(table.filter("vec_id % 2 = 0"), scratch_path(spark, "vector-lists"), lists=32)
    lists.add(table)
    asked = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return lists.nearest(asked, 5, others_only=True).withColumn("distance", F.round("distance", 6))


#: Whole texts, each with import lines of its own behind it; a carriage return starts no line.
_CODE = r"""code AS (SELECT doc_id AS chat_id, text || CASE WHEN doc_id % 2 = 0 THEN E'\nimport pkg' || (doc_id % 19) || E'\r  import hidden\nfrom requets.x import y'
    ELSE E'\nconst a = require("@scope/lib-' || (doc_id % 23) || '"); require("./local"); require("djagno")' END AS code FROM documents),
  m AS (SELECT chat_id, regexp_extract_all(code, '(?m)^\s*(?:import|from)\s+([a-zA-Z0-9_\-]+)', 1) AS py,
    regexp_extract_all(code, '(?:require\s*\(\s*[''"]|from\s+[''"])([a-zA-Z0-9@][a-zA-Z0-9_\-./]*)[''"]', 1) AS js FROM code),
  l AS (SELECT chat_id, CASE WHEN len(py) >= len(js) THEN 'python' ELSE 'node' END AS language,
    CASE WHEN len(py) >= len(js) THEN py ELSE js END AS names FROM m),
  e AS (SELECT chat_id, language, unnest(names) AS package, unnest(range(0, len(names))) AS place FROM l),
  found AS (SELECT chat_id, language, row_number() OVER (PARTITION BY chat_id ORDER BY min(place)) - 1 AS position, package FROM e GROUP BY 1, 2, 4)"""


@query("code_packages", f"WITH {_CODE} SELECT chat_id, language, position, package FROM found")
def code_packages(spark, folder):
    return detect.extract_packages(_code(spark, folder), "chat_id", "code").select("chat_id", "language", "position", "package")


def _code(spark, folder):
    return p.table(spark, folder, "documents").selectExpr(
        "doc_id AS chat_id", "concat(text, CASE WHEN doc_id % 2 = 0 THEN concat('\\nimport pkg', doc_id % 19, '\\r  import hidden\\nfrom requets.x import y') "
        "ELSE concat('\\nconst a = require(\"@scope/lib-', doc_id % 23, '\"); require(\"./local\"); require(\"djagno\")') END) AS code")


@query("import_verdicts", f"""WITH {_CODE}, n AS (SELECT DISTINCT package, language FROM found),
  v AS (SELECT *, CASE package WHEN 'requets' THEN 'requests' WHEN 'djagno' THEN 'django' END AS typosquat_of, contains(package, '7') AS listed FROM n)
  SELECT package, language, false AS is_stdlib, typosquat_of, CASE WHEN typosquat_of IS NULL THEN listed END AS exists,
    CASE WHEN typosquat_of IS NULL AND listed THEN 'safe' ELSE 'danger' END AS risk FROM v""")
def import_verdicts(spark, folder):
    """Imports against a registry snapshot; two names lie within two edits of popular ones."""
    found = detect.extract_packages(_code(spark, folder), "chat_id", "code")
    registry = found.select("package", "language").distinct().filter(F.col("package").contains("7"))
    return packages.import_verdicts(found, registry).select("package", "language", "is_stdlib", "typosquat_of", "exists", "risk")


_NAMES = """d AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '')) AS n,
    CASE WHEN p_partkey % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem FROM part),
  q AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN substr(n, 1, 1) || substr(n, 3, 1) || substr(n, 2, 1) || substr(n, 4)
    WHEN 1 THEN substr(n, 1, 2) || substr(n, 4) WHEN 2 THEN substr(n, 1, 2) || substr(n, 2) WHEN 3 THEN replace(n, '-', '_') ELSE n END AS q FROM d)"""
#: Every name beside every dictionary name. Tokens match within one edit, a swap of neighbours included; at that
#: distance the restricted and the unrestricted edit distance agree.
_LOOKALIKES = f"""WITH {_NAMES}, f AS (SELECT q, regexp_split_to_array(q, '[-_.]+') AS a FROM q WHERE q NOT IN (SELECT n FROM d)),
  k AS (SELECT DISTINCT n AS p, regexp_split_to_array(n, '[-_.]+') AS b FROM d),
  ta AS (SELECT DISTINCT unnest(a) AS x FROM f), tb AS (SELECT DISTINCT unnest(b) AS y FROM k),
  near AS (SELECT x, list(y) AS ys FROM ta, tb WHERE damerau_levenshtein(x, y) <= 1 GROUP BY x),
  back AS (SELECT y, list(x) AS xs FROM ta, tb WHERE damerau_levenshtein(x, y) <= 1 GROUP BY y),
  fa AS (SELECT f.q, u.i, ys FROM f, (SELECT q, a, unnest(range(1, len(a) + 1)) AS i FROM f) u LEFT JOIN near ON x = u.a[u.i] WHERE u.q = f.q),
  fb AS (SELECT k.p, u.i, xs FROM k, (SELECT p, b, unnest(range(1, len(b) + 1)) AS i FROM k) u LEFT JOIN back ON y = u.b[u.i] WHERE u.p = k.p),
  ca AS (SELECT fa.q, k.p, count(*) AS n FROM fa JOIN k ON list_has_any(fa.ys, k.b) GROUP BY 1, 2),
  cb AS (SELECT f.q, fb.p, count(*) AS n FROM fb JOIN f ON list_has_any(fb.xs, f.a) GROUP BY 1, 2),
  pairs AS (SELECT f.q, k.p, (coalesce(ca.n, 0) + coalesce(cb.n, 0)) / 2.0 AS hits, len(a) + len(b) AS size, damerau_levenshtein(f.q, k.p) AS distance
    FROM f CROSS JOIN k LEFT JOIN ca ON ca.q = f.q AND ca.p = k.p LEFT JOIN cb ON cb.q = f.q AND cb.p = k.p),
  s AS (SELECT *, hits / (size - hits) AS jaccard, distance BETWEEN 1 AND 2 AS close FROM pairs),
  c AS (SELECT q, p, distance, CASE WHEN close THEN 'damerau-levenshtein' ELSE 'fuzzy-jaccard' END AS method,
    round_even(CASE WHEN close THEN greatest(0.0, 1 - distance / greatest(length(q), length(p), 1)::DOUBLE) ELSE jaccard END, 4) AS confidence
    FROM s WHERE close OR jaccard >= 0.6),
  r AS (SELECT q, p, ecosystem, distance, method, confidence, row_number() OVER (PARTITION BY q ORDER BY confidence DESC, p, ecosystem) AS rank
    FROM c JOIN (SELECT DISTINCT n, ecosystem FROM d) e ON e.n = c.p)
  SELECT q AS package_name, p AS matched_package, ecosystem, distance, method, confidence, rank FROM r WHERE rank <= 10"""


@query("package_lookalikes", _LOOKALIKES)
def package_lookalikes(spark, folder):
    """Near names in the whole dictionary."""
    return packages.lookalikes(p.package_names(spark, folder), p.packages(spark, folder))


@query("package_verdicts", """WITH d AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '')) AS n FROM part),
  q AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN substr(n, 1, 1) || substr(n, 3, 1) || substr(n, 2, 1) || substr(n, 4)
    WHEN 1 THEN substr(n, 1, 2) || substr(n, 4) WHEN 2 THEN substr(n, 1, 2) || substr(n, 2) WHEN 3 THEN replace(n, '-', '_') ELSE n END AS name FROM d)
  SELECT name AS package_name, name IN (SELECT n FROM d) AS exact_match_found, name NOT IN (SELECT n FROM d) AS is_suspicious FROM q""")
def package_verdicts(spark, folder):
    return packages.name_verdicts(p.package_names(spark, folder), p.packages(spark, folder)).drop("match_count")


@query("packages_by_ecosystem", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, count(*) AS package_count FROM part GROUP BY 1")
def packages_by_ecosystem(spark, folder):
    return packages.count_by_ecosystem(p.packages(spark, folder))


@query("packages_by_name", "SELECT p_partkey % 1000 AS dependents, p_type AS description FROM part WHERE lower(p_name) = 'red widget' AND lower(p_brand) = 'brand#17'")
def packages_by_name(spark, folder):
    return packages.find_by_name(p.packages(spark, folder), "Red-Widget-Brand17").select(
        F.col("dependent_packages_count").alias("dependents"), "description")


@query("stable_ids", "SELECT event_id, substr(sha1(user_id || '|' || event_type), 1, 20) AS stable_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 12) || '-hash' AS pseudonym FROM events")
def stable_ids(spark, folder):
    return p.table(spark, folder, "events").select(
        "event_id", t.stable_id(F.col("user_id").cast("string"), F.col("event_type")).alias("stable_id"),
        t.pseudonym(F.col("user_id")).alias("pseudonym"))
