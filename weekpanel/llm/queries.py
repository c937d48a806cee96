"""Registered queries of the operators, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.llm import licenses, repair
from weekpanel.llm.chat import format_conversations, read_back
from weekpanel.llm.decontaminate import contaminated
from weekpanel.llm.host_rules import apply_host_rules
from weekpanel.llm.language import fit_language, language_of
from weekpanel.llm.licenses import scan_licenses
from weekpanel.llm.lm_score import ORDER, lm_scores
from weekpanel.llm.minhash import near_duplicates
from weekpanel.llm.packing import pack
from weekpanel.llm.quality import fit_quality, score_column
from weekpanel.llm.text import remainder, table
from weekpanel.llm.toxicity import fit_toxicity
from weekpanel.llm.url_filter import host_of, judge_urls
from weekpanel.llm.whitening import whiten
from weekpanel.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS ws FROM d),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
windows AS (SELECT k, i, ws[i:i + 4] AS s FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
again AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
covered AS (SELECT k, sum(least(5, gap)) AS n FROM (
              SELECT k, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i), 5) AS gap FROM again) GROUP BY k),
c AS (SELECT doc_id, source AS host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN dup USING (k) LEFT JOIN covered USING (k)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM c),
h AS (SELECT host, count(*) AS n, sum(failed::INT) AS f FROM j WHERE host IS NOT NULL GROUP BY host),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS strength
          FROM (SELECT coalesce(sum(f) / sum(n), 0.0) AS m, var_samp(f / n) AS v FROM h)),
rates AS (SELECT host, (f + strength * m) / (n + strength) AS rate FROM h, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM j LEFT JOIN rates USING (host)
"""


@query("op9_host_rules", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and host verdicts of all documents."""
    docs = table(spark, sf_dir, "documents")
    return apply_host_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# All pairs that share a shingle, their exact similarity, and everything reachable over the links.
_OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
       UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN component USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op8_minhash", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = remainder("doc_id", 5) == 0
    model = fit_language(docs.filter(~out))
    judged = docs.select("doc_id", out.alias("held_out"), language_of(docs, model, F.col("text")).alias("p"))
    return judged.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def _scored(spark: SparkSession, sf_dir: str, out, fit, threshold: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~out))
    judged = docs.select("doc_id", out.alias("held_out"), score_column(docs, model, F.col("text")).alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    return _scored(spark, sf_dir, remainder("doc_id", 5) == 0, fit_quality, 0.3)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    return _scored(spark, sf_dir, remainder("doc_id", 3) == 1, fit_toxicity, 0.7)


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold (near) copies of benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The rules and the names of listed hosts that op1 applies (fixed values).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
LISTED_HOST = r"(^|[.])(cheap-pills|casino-win|adult-x|free-bets|spam-farm)[.]"

_OP1_SQL = f"""
WITH rules(h, p, v) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
fit AS (
  SELECT DISTINCT host, path, h || p AS rule, v
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT host, path, rule, v FROM fit QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) = 1),
listed AS (SELECT DISTINCT host || regexp_replace(path, '/+$', '') AS k FROM parts WHERE regexp_matches(host, '{LISTED_HOST}'))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN host || regexp_replace(path, '/+$', '') IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (host, path)
"""


@query("op1_url_filter", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; the list of single URLs is the canonical URLs on listed hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    urls = pages.select("url").filter(host_of(F.col("url")).rlike(LISTED_HOST))
    return judge_urls(pages, rules, urls).select("page_id", "host", "path", "rule", "verdict")


def document_path() -> Column:
    """A file path for a document: directories by source and id, some files in the upper ones."""
    thousand, hundred = F.expr("doc_id div 1000"), F.expr("doc_id div 100")
    top = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    middle = F.concat_ws("/", "source", thousand.cast("string"), F.col("doc_id").cast("string"))
    deep = F.concat_ws("/", "source", thousand.cast("string"), hundred.cast("string"), F.col("doc_id").cast("string"))
    return F.when(F.pmod("doc_id", F.lit(1000)) == 0, top).when(F.pmod("doc_id", F.lit(100)) == 0, middle).otherwise(deep)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)}, {title})" for i, (k, t, title) in enumerate(licenses.TEMPLATES))


def _counted(key: str, words: str, of: str) -> str:
    terms = f"SELECT {key}, unnest(regexp_extract_all(lower({words}), '{licenses.TERM}')) AS term FROM {of}"
    return f"SELECT {key}, term, count(*) AS tf FROM ({terms}) GROUP BY ALL"


_LEFT = r"regexp_replace({}, '^[\x20\x09-\x0D]+', '')"

_OP10_SQL = f"""
WITH templates(i, license, words, title) AS (VALUES {_TEMPLATE_ROWS}),
tt AS ({_counted('i', 'words', 'templates')}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))::DOUBLE) + 1 AS w FROM tt GROUP BY term),
known AS (SELECT i, term, tf * w / sqrt(sum((tf * w) ** 2) OVER (PARTITION BY i)) AS v FROM tt JOIN idf USING (term)),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, source || '/' || CASE WHEN doc_id % 1000 = 0 THEN ''
        WHEN doc_id % 100 = 0 THEN (doc_id // 1000) || '/' ELSE (doc_id // 1000) || '/' || (doc_id // 100) || '/' END AS folder FROM documents),
u AS (SELECT *, row_number() OVER () AS unit FROM (
        SELECT k, false AS block, unnest(string_split(t, chr(10))) AS line FROM d
        UNION ALL SELECT * FROM (SELECT k, true, unnest(regexp_split_to_array(t, '\n[\x20\x09-\x0D]*\n')) AS line FROM d) WHERE contains(line, chr(10)))),
ut AS ({_counted('unit', 'line', 'u')}),
uw AS (SELECT unit, term, tf * coalesce(w, ln(1 + (SELECT count(*) FROM templates)) + 1) AS w FROM ut LEFT JOIN idf USING (term)),
sized AS (SELECT unit, sqrt(sum(w * w)) AS size FROM uw GROUP BY unit),
cosine AS (SELECT unit, i, round(sum(w * v) / any_value(size), 6) AS similarity FROM uw JOIN known USING (term) JOIN sized USING (unit) GROUP BY unit, i),
best AS (SELECT unit, similarity, i FROM cosine QUALIFY row_number() OVER (PARTITION BY unit ORDER BY similarity DESC, i) = 1),
m AS (SELECT k, block, line, license, title, similarity FROM best JOIN u USING (unit) JOIN templates USING (i) WHERE similarity >= 0.7),
own AS (SELECT k, list_sort(list(struct_pack(s := -similarity, license := license)))[1] AS b,
          bool_or(title AND starts_with({_LEFT.format('t')}, {_LEFT.format('line')}))
          OR greatest(coalesce(sum(len({_WORDS.format('line')})) FILTER (WHERE NOT block), 0), coalesce(sum(len({_WORDS.format('line')})) FILTER (WHERE block), 0))
             >= 0.5 * any_value(len({_WORDS.format('t')})) AS is_file FROM m JOIN d USING (k) GROUP BY k),
placed AS (SELECT k, doc_id, rtrim(folder, '/') AS directory, b, is_file FROM d LEFT JOIN own USING (k)),
files AS (SELECT directory AS source_dir, min(b).license AS inherited FROM placed WHERE is_file GROUP BY directory),
near AS (SELECT directory, source_dir, inherited FROM (SELECT DISTINCT directory FROM placed) JOIN files
           ON directory = source_dir OR starts_with(directory, source_dir || '/')
         QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(source_dir) DESC) = 1)
SELECT doc_id, directory, b.license AS license, -b.s AS similarity, CASE WHEN b IS NULL THEN source_dir END AS source_dir,
       coalesce(b.license, inherited) AS effective_license
FROM placed LEFT JOIN near USING (directory)
"""


@query("op10_licenses", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licenses of all documents.  The tables have no file paths: :func:`document_path`
    lays documents out in directories by source and id."""
    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text", document_path())


@query("op3_lm_score")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    out = remainder("doc_id", 7) == 2
    return lm_scores(table(spark, sf_dir, "documents"), ~out, order=ORDER).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


# A conversation that op11 adds to the table: marks of many templates inside its texts.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"

_OP11_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             role || text AS said FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(said) + length(said) - length(replace(replace(said, '<', ''), chr(92), '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op11_chat_format", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with marks in its texts, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, i, r, PROBE_TEXT) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)))


_CRC = """xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _better(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _step(state: int, cost: str, letter: str, when: str = "true") -> str:
    return f"struct_pack(c := CASE WHEN {when} THEN v{state}.c + {cost} ELSE 1000000000 END, a := v{state}.a || '{letter}')"


def _after(state: str, letter: str = "I") -> str:
    return f"struct_pack(c := {state}.c + 5, a := {state}.a || '{letter}')"


# Forward DP over rows: of each of the four role states the least (cost, audit) so far.
_OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
marked AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM marked WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged),
judged AS (SELECT *, left(role, 1) AS init, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
priced AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS x,
    lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init AS pair FROM judged),
sizes AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM priced GROUP BY conv_id),
dp(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, 0::BIGINT, struct_pack(c := 0::BIGINT, a := ''), struct_pack(c := 1000000000::BIGINT, a := ''),
         struct_pack(c := 5::BIGINT, a := 'I'), struct_pack(c := 10::BIGINT, a := 'II') FROM sizes
  UNION ALL
  SELECT conv_id, i, w0, w1, u2, {_better('w3', _after('u2'))} FROM (
    SELECT *, {_better('w2', _after('w0'), _after('w1'), _after('w3'))} AS u2 FROM (
      SELECT dp.conv_id, p.i, {_step(0, '2', 'D')} AS w0,
        {_better(_step(1, '2', 'D'), _step(0, 'x', 'K', "init = 's'"))} AS w1,
        {_better(_step(2, '2', 'D'), *[_step(q, 'x + 1', 'R') for q in (0, 1, 3)], *[_step(q, 'x', 'K', "init = 'u'") for q in (0, 1, 3)])} AS w2,
        {_better(_step(3, '2', 'D'), _step(2, 'x + 1', 'R'), _step(2, 'x', 'K', "init = 'a'"))} AS w3
      FROM dp JOIN priced p ON p.conv_id IS NOT DISTINCT FROM dp.conv_id AND p.i = dp.i + 1))),
ends AS (SELECT s.*, least(v0, v3) AS best FROM sizes s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.i = s.n),
letters AS (SELECT conv_id, k, best.a[k] AS e, length(replace(best.a, 'D', '')) % 2 AS odd,
    length(replace(best.a[1:k], 'I', '')) AS i, length(replace(best.a[1:k], 'D', '')) AS o
    FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS k FROM ends)),
fixed AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN p.role WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN e = 'I' THEN '' ELSE p.text END, chr(10) ORDER BY k)) AS sha
    FROM letters l LEFT JOIN priced p ON e <> 'I' AND p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.i = l.i WHERE e <> 'D' GROUP BY l.conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM d.conv_id
"""
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@query("op12_repair", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of all conversations, damaged first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = repair.damage(rows)
    report = materialize(repair.audits(damaged), "audits")
    digests = repair.digests(repair.repaired(damaged, report))
    found = rows.select("conv_id").distinct()
    for part in (report, digests):
        key = F.col("conv_id").eqNullSafe(F.col("of"))
        found = found.join(part.withColumnRenamed("conv_id", "of"), key, "left").drop("of")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *repair.FAULTS, "illegal", "cost")]
    sha = F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256")
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), sha)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading components of all whole embeddings, whitened."""
    return whiten(table(spark, sf_dir, "embeddings"))
