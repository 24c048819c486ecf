"""The queries over the test tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import decontamination, embedding_dedup, language, licenses, line_dedup, merkle, packing, pii, quality, secrets, simhash, spelling, warc
from cuemill.llm.shared import keep

PACK_VOCABULARY = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


#: As OP1_SQL has it.
SQL_COPYRIGHT_LINE = r"(^|\n)[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """The canonical text of an SQL expression, with its line ends."""
    out = f"regexp_replace(regexp_replace(lower({text}), {_quoted(SQL_COPYRIGHT_LINE)}, '\\1', 'g'), {_quoted(licenses.NOT_WORD)}, ' ', 'g')"
    for spelling, usual in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(spelling)}, {_quoted(usual)})"
    return out


def _one_line_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


OP1_SQL = f"""
WITH k AS (
  SELECT digest, min(license_id) AS license_id
  FROM (SELECT license_id, sha256({_one_line_sql(_canonical_sql('text'))}) AS digest
        FROM (VALUES {', '.join(f'({_quoted(name)}, {_quoted(text)})' for name, text in licenses.KNOWN)}) AS v(license_id, text))
  GROUP BY digest),
c AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
w AS (SELECT doc_id, sha256({_one_line_sql('lines')}) AS text_digest FROM c),
n AS (
  SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT DISTINCT doc_id, license_id
        FROM (SELECT doc_id, trim(unnest(string_split(lines, chr(10)))) AS unit FROM c) JOIN k ON sha256(unit) = digest WHERE unit <> '')
  GROUP BY doc_id)
SELECT w.doc_id, text_digest, license_id, coalesce(notices, '') AS notices
FROM w LEFT JOIN k ON text_digest = digest LEFT JOIN n ON w.doc_id = n.doc_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, k - 1 AS line, list_distinct(list_filter(string_split_regex(lower(lines[k]), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
s AS (SELECT sorted, any_value(w) AS w, min({'d': doc_id, 'l': line}) AS first FROM (SELECT *, list_sort(w) AS sorted FROM l WHERE len(w) > 0) GROUP BY sorted),
n AS (SELECT row_number() OVER () AS id, w, sorted, first, len(w) AS n FROM s),
t AS (SELECT id, n, unnest(w) AS word FROM n),
c AS (SELECT word, count(*) AS times FROM t GROUP BY word),
p AS (SELECT * FROM (SELECT id, n, t.word, row_number() OVER (PARTITION BY id ORDER BY times, t.word) AS pos FROM t JOIN c ON t.word = c.word) WHERE pos <= n // 5 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND a.id < b.id WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
alike AS (
  SELECT x.id AS x, y.id AS y, x.first AS fx, y.first AS fy
  FROM pairs JOIN n x ON x.id = a JOIN n y ON y.id = b
  WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
gone AS (SELECT DISTINCT CASE WHEN fx > fy THEN x ELSE y END AS id FROM alike),
r AS (
  SELECT doc_id, line FROM (SELECT *, list_sort(w) AS sorted FROM l WHERE len(w) > 0) l JOIN n ON l.sorted = n.sorted
  WHERE {'d': doc_id, 'l': line} > first OR id IN (SELECT id FROM gone)),
g AS (SELECT doc_id, list(line) AS removed FROM r GROUP BY doc_id),
f AS (SELECT d.doc_id, text, string_split(text, chr(10)) AS lines, coalesce(removed, []) AS removed FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id,
  CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda k: NOT list_contains(removed, k)), lambda k: lines[k + 1]), chr(10)), '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, len(removed) AS n_removed
FROM f
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    return pii.with_counts(found).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "secrets")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages")).drop("record_id")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
    '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS bits,
    max(page_id) OVER (PARTITION BY hex) AS first
  FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(PACK_VOCABULARY))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.train(docs.where("not held_out"))
    return language.identify(docs, model, keep_cols=["doc_id", "held_out"])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep_cols=["doc_id"])
    return decontamination.with_counts(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []
    ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
b AS (
  SELECT item_id, CASE WHEN text IS NULL THEN []
    ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, k, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and which rows it finds changed after a known change to some of them."""
    docs = read(spark, sf_dir, "documents")
    fields = lambda n_chars: [docs["doc_id"], docs["source"], docs["lang"], n_chars, docs["text"]]
    changed = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    leaf = merkle.leaf_digest(*fields(docs["n_chars"]))
    now = F.when(changed & docs["n_chars"].isNotNull(), merkle.leaf_digest(*fields(docs["n_chars"] + 1)))
    leaves = keep(docs.select(docs["lang"].alias("group"), docs["doc_id"].alias("order"), leaf.alias("leaf"), now.alias("now")), "digests")
    found = merkle.manifest(leaves, "now")
    root = merkle.folded(F.coalesce("now", "leaf"), F.col("siblings"), (F.col("position"), F.col("size")), (F.col("group_position"), F.col("groups")))
    found = found.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    return secrets.with_counts(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


#: CRC-32 of a list of bytes, by a table of 256 entries made by the rule.
SQL_CRC32 = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)"""


def sql_crc32(data: str) -> str:
    """Over a list of bytes; the table of SQL_CRC32 must be in reach."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(crc[CAST(xor(c & 255, b) AS INT) + 1], c >> 8)))"


_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))"


def _leaf_sql(n_chars: str) -> str:
    one = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(map(one, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: Groups are named by a letter and the language, so that null comes first.
OP12_SQL = f"""
WITH RECURSIVE {SQL_CRC32},
d AS (
  SELECT doc_id, coalesce('v' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {sql_crc32(_DIGITS)} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS now
  FROM documents, crc),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
t AS (
  SELECT g, 0 AS lvl, i, m, leaf AS h FROM n
  UNION ALL SELECT g, lvl + 1, i // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE m > 1 GROUP BY g, lvl, i // 2),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM t WHERE m = 1),
u AS (
  SELECT 0 AS lvl, i, m, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, i // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE m > 1 GROUP BY lvl, i // 2),
r AS (SELECT h AS root FROM u WHERE m = 1),
p AS (
  SELECT n.g, n.i, coalesce(string_agg(t.h, '' ORDER BY t.lvl), '') AS siblings
  FROM n LEFT JOIN t ON n.g = t.g AND t.m > 1 AND t.i = xor(n.i >> t.lvl, 1) GROUP BY n.g, n.i),
q AS (SELECT s.g, s.i, s.m, s.subroot, coalesce(string_agg(u.h, '' ORDER BY u.lvl), '') AS siblings FROM s LEFT JOIN u ON u.m > 1 AND u.i = xor(s.i >> u.lvl, 1) GROUP BY ALL),
f AS (
  SELECT g, i AS leaf_no, 0 AS lvl, i, m, now AS h FROM n
  UNION ALL SELECT f.g, leaf_no, f.lvl + 1, f.i // 2, (f.m + 1) // 2, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN t.h || f.h ELSE f.h || t.h END)
  FROM f LEFT JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.i = xor(f.i, 1) WHERE f.m > 1),
k AS (
  SELECT f.g, leaf_no, 0 AS lvl, q.i, q.m, h FROM f JOIN q ON f.g = q.g WHERE f.m = 1
  UNION ALL SELECT k.g, leaf_no, k.lvl + 1, k.i // 2, (k.m + 1) // 2, sha256(CASE WHEN u.h IS NULL THEN k.h WHEN k.i % 2 = 1 THEN u.h || k.h ELSE k.h || u.h END)
  FROM k LEFT JOIN u ON u.lvl = k.lvl AND u.i = xor(k.i, 1) WHERE k.m > 1)
SELECT n.doc_id, n.leaf, q.subroot, root, sha256(p.siblings || q.siblings) AS proof_sha256, k.h AS folded_root, k.h = root AS verified
FROM n JOIN p ON n.g = p.g AND n.i = p.i JOIN q ON n.g = q.g JOIN k ON n.g = k.g AND n.i = k.leaf_no AND k.m = 1, r
"""

#: Near words by the table of all words with one character left out: of one, the other; or of both, the same at the same place.
OP11_SQL = f"""
WITH RECURSIVE {SQL_CRC32},
x AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\u00C0-\u00FF]{{6,}}')) AS run FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, run, count(*) AS n FROM x GROUP BY doc_id, run),
z AS (
  SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS points FROM y),
b AS (SELECT doc_id, run, n, {sql_crc32('flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))')} AS h FROM z, crc),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM b),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
l AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
  SELECT l.word AS a, w.word AS b FROM l JOIN w ON l.less = w.word
  UNION SELECT w.word, l.word FROM l JOIN w ON l.less = w.word
  UNION SELECT p.word, q.word FROM l p JOIN l q ON p.less = q.less AND p.i = q.i AND p.word <> q.word),
k AS (SELECT a, count(*) AS n_near, min({{'less': -n, 'near': b}}) AS best FROM e JOIN w ON b = word GROUP BY a),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN best.near END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
  FROM w LEFT JOIN k ON word = a),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word JOIN f g ON r.at = g.word WHERE g.form IS NULL
"""

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_manifest": op12_manifest,
    "op13_secrets": op13_secrets,
}

ORACLES = {
    "op1_licenses": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op12_manifest": OP12_SQL,
}
