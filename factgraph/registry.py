"""Registered queries over the given tables, and DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import staging
from .functions import scores, shapes, text, vectors
from .operators import buckets, contradictions, counters, gates, graph, hooks, provenance, search, similarity, tables, trust
from .plans import consistency, publish
from .sources import readers
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = fx.NOW


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL over the views ``<name>_fx``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = fx.duck(sql)
        return f

    return add


def _ids(df: DataFrame, step: int) -> DataFrame:
    """Query rows of a batch lookup: the ids divisible by ``step``, against all rows."""
    return df.where(F.col("id") % step == 0).select("id")


def _assertions(s: SparkSession, d: str) -> DataFrame:
    return gates.gate_assertions(fx.facts(s, d), fx.articles(s, d))


STATEMENT = "concat_ws(' ', subject, predicate, object)"
DIST = "1 - list_cosine_similarity(a.embedding, b.embedding)"

# ---------------------------------------------------------------- gates and filters


@query(r"""SELECT id, regexp_replace(regexp_replace(subject, '^\s+', ''), '\s+$', '') AS subject, regexp_replace(regexp_replace(predicate, '^\s+', ''), '\s+$', '') AS predicate,
    regexp_replace(regexp_replace(object, '^\s+', ''), '\s+$', '') AS object, confidence FROM facts_fx
    WHERE regexp_replace(subject, '\s+', '', 'g') <> '' AND regexp_replace(predicate, '\s+', '', 'g') <> '' AND regexp_replace(object, '\s+', '', 'g') <> ''""")
def valid_triples(s, d):
    return gates.valid_triples(fx.facts(s, d).select("id", "subject", "predicate", "object", "confidence"))


@query(f"SELECT id, {STATEMENT} AS statement FROM facts_fx")
def fact_statement(s, d):
    return fx.facts(s, d).select("id", text.fact_statement(F.col("subject"), F.col("predicate"), F.col("object")).alias("statement"))


@query("SELECT id, url FROM articles_fx JOIN queue_fx ON article_id = id WHERE status = 'PENDING' AND (raw_text IS NULL OR length(raw_text) < 100) ORDER BY id LIMIT 50")
def needs_scrape(s, d):
    return gates.needs_scrape(fx.articles(s, d), fx.queue(s, d))


@query("SELECT id, url FROM articles_fx WHERE processed_at IS NULL AND url IS NOT NULL ORDER BY id LIMIT 10")
def needs_digest(s, d):
    return gates.needs_digest(fx.articles(s, d))


@query("SELECT id, article_id FROM facts_fx WHERE checked_at IS NULL ORDER BY id LIMIT 50")
def needs_provenance(s, d):
    return gates.needs_provenance(fx.facts(s, d))


@query("""SELECT id, title FROM articles_fx a JOIN queue_fx q ON q.article_id = a.id WHERE status = 'SCRAPED' AND title <> '' AND raw_text <> ''
    AND NOT EXISTS (SELECT 1 FROM article_topics_fx t WHERE t.article_id = a.id AND t.article_id % 2 = 0) ORDER BY id LIMIT 500""")
def needs_topic(s, d):
    return gates.needs_topic(fx.articles(s, d), fx.queue(s, d), fx.article_topics(s, d).where("article_id % 2 = 0"))


@query(f"""SELECT f.id, subject, predicate, object, f.created_at, trust_score FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id
    WHERE trust_score >= 0.8 AND f.created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND is_original ORDER BY f.created_at DESC, f.id LIMIT 500""")
def baseline_facts(s, d):
    return gates.baseline_facts(fx.facts(s, d).drop("embedding"), fx.articles(s, d), NOW)


def _check_sql(where: str) -> str:
    return f"SELECT f.id, subject, predicate, object, f.created_at FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id WHERE is_original {where}"


@query(_check_sql(f"AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY"))
def facts_to_check(s, d):
    return gates.facts_to_check(fx.facts(s, d).drop("embedding"), fx.articles(s, d), NOW)


@query(_check_sql(""))
def facts_to_check_all(s, d):
    return gates.facts_to_check(fx.facts(s, d).drop("embedding"), fx.articles(s, d), NOW, backfill=True)


@query(_check_sql(f"AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 9 DAY"))
def facts_to_check_days(s, d):
    return gates.facts_to_check(fx.facts(s, d).drop("embedding"), fx.articles(s, d), NOW, backfill=True, days_back=9)


@query("SELECT id, confidence FROM facts_fx WHERE is_original AND checked_at IS NOT NULL")
def gate_facts(s, d):
    return gates.gate_facts(fx.facts(s, d)).select("id", "confidence")


ASSERTIONS = "SELECT id AS fact_id, article_id, is_original, provenance_id FROM facts_fx WHERE (is_original OR provenance_id IS NOT NULL) AND article_id IN (SELECT id FROM articles_fx)"


@query(ASSERTIONS)
def gate_assertions(s, d):
    return _assertions(s, d)


GATED_ARTICLES = "SELECT * FROM articles_fx WHERE (processed_at IS NOT NULL AND id IN (SELECT article_id FROM article_topics_fx)) OR is_reference"


@query(f"SELECT id, url, is_reference FROM ({GATED_ARTICLES})")
def gate_articles(s, d):
    return gates.gate_articles(fx.articles(s, d), fx.article_topics(s, d)).select("id", "url", "is_reference")


@query("SELECT id, subject, confidence FROM facts_fx WHERE lower(subject) = 'the' ORDER BY confidence DESC, id LIMIT 20")
def facts_by_subject(s, d):
    return gates.facts_by_subject(fx.facts(s, d), "THE")


@query("SELECT id, confidence * 2 - 0.5 AS confidence FROM facts_fx WHERE confidence * 2 - 0.5 < 0 OR confidence * 2 - 0.5 > 1")
def invalid_confidence(s, d):
    return gates.invalid_confidence(fx.facts(s, d).select("id", (F.col("confidence") * 2 - 0.5).alias("confidence")))


@query("SELECT id FROM facts_fx WHERE object = ''")
def missing_text(s, d):
    return gates.missing_text(fx.facts(s, d).select("id", F.col("object").alias("text"))).select("id")


@query(r"""SELECT conv_id, turn, CASE WHEN q IS NULL OR q = '' THEN 'INVALID_QUERY' WHEN t = '' THEN 'EMPTY_QUERY' WHEN length(q) > 500 THEN 'QUERY_TOO_LONG' WHEN length(t) < 3 THEN 'QUERY_TOO_SHORT'
    WHEN regexp_matches(t, '(?i)[''"].*[''"](?:\s*;|\s*or|\s*and|\s*where)') OR regexp_matches(t, '[\$`\\]') OR regexp_matches(t, '\$\{.*?\}') OR regexp_matches(t, '--\s*$') THEN 'SUSPICIOUS_QUERY' ELSE 'OK' END AS code
    FROM (SELECT conv_id, turn, text AS q, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM conversations)""")
def screen_queries(s, d):
    return fx.table(s, d, "conversations").select("conv_id", "turn", text.screen_code(F.col("text")).alias("code"))


@query(r"""SELECT id, regexp_matches(subject, '^[a-zA-Z0-9_\-.]{1,255}$') AS fact_ok, regexp_matches(subject, '^[a-zA-Z0-9_-]{1,255}$') AS node_ok FROM facts_fx""")
def valid_ids(s, d):
    return fx.facts(s, d).select("id", text.valid_fact_id(F.col("subject")).alias("fact_ok"), text.valid_node_id(F.col("subject")).alias("node_ok"))


# ---------------------------------------------------------------- sources and scalar functions


_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form")
_BODY = "html"
for _tag in _TAGS:
    _BODY = rf"regexp_replace({_BODY}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_BODY = rf"regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BODY = f"replace({_BODY}, '{_entity}', '{_char}')"


@query(rf"""SELECT page_id, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS title, text FROM (SELECT page_id, html,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM pages) WHERE length(text) > 200""")
def scan_pages(s, d):
    return readers.extract_main_text(fx.table(s, d, "pages")).select("page_id", "title", "text")


def _file(s: SparkSession, df: DataFrame, fmt: str, **options: str) -> str:
    """A file of the given form that Spark writes from the given tables, for the readers to read."""
    path = staging.new_dir(s, "source")
    df.write.format(fmt).options(**options).save(path)
    return path


@query("SELECT url, (page_id % 25)::INT AS mentions FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 25 >= 10 AND starts_with(url, 'http')")
def scan_event_dump(s, d):
    x = lambda n: [F.lit("x")] * n
    mentions = F.when(F.col("page_id") % 7 == 0, "many").otherwise((F.col("page_id") % 25).cast("string"))
    row = F.when(F.col("page_id") % 11 == 0, F.concat_ws("\t", *x(31), mentions, "url")).otherwise(F.concat_ws("\t", *x(31), mentions, *x(28), "url"))
    return readers.read_event_dump(s, _file(s, fx.table(s, d, "pages").select(row.alias("value")), "text"))


@query(r"""SELECT url, regexp_replace(regexp_replace(title, '^\s+', ''), '\s+$', '') AS title, 'Wire' AS publisher, CASE WHEN id % 3 = 0 THEN 'about ' || id ELSE coalesce(publisher, '') END AS raw_text,
    CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE published_date END AS published_date FROM articles_fx WHERE id % 4 <> 1 AND id % 6 <> 1 AND regexp_matches(title, '\S')""")
def scan_rss(s, d):
    a = fx.articles(s, d)
    items = a.select(
        F.when(F.col("id") % 4 == 1, " ").otherwise(F.col("title")).alias("title"), F.when(F.col("id") % 6 == 1, F.lit("ftp://x/")).otherwise(F.col("url")).alias("link"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("about "), "id")).alias("summary"), F.col("publisher").alias("description"),
        F.when(F.col("id") % 5 != 0, F.date_format("published_date", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("pubDate"))
    return readers.read_feed_items(s, _file(s, items, "xml", rowTag="item", rootTag="channel"), "Wire", NOW)


@query("SELECT row_number() OVER (ORDER BY n_nationkey)::INT - 1 AS position, n_name AS name, 'https://' || lower(n_name) || '.example/' AS url, n_regionkey::VARCHAR AS category, (n_nationkey % 10)::DOUBLE AS trust_score FROM nation")
def scan_trusted_sources(s, d):
    entry = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/")).alias("url"), F.col("n_regionkey").cast("string").alias("category"), (F.col("n_nationkey") % 10).cast("double").alias("trust_score"))
    whole = fx.table(s, d, "nation").agg(F.sort_array(F.collect_list(entry)).alias("trusted_sources"))  # a list kept by hand: one document
    return readers.read_trusted_sources(s, _file(s, whole, "json"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_tables(s, d):
    path = _file(s, fx.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "csv", header="true")
    return readers.read_table(s, path, "o_orderkey long, o_custkey long, o_totalprice double", "csv", header="true")


def _escaped_sql(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '^\s+', ''), '\s+$', '')"
    for raw, safe in (("'\\'", "'\\\\'"), ("chr(34)", "'\\' || chr(34)"), ("chr(39)", "'\\' || chr(39)"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        out = f"replace({out}, {raw}, {safe})"
    return out


def _encoded_sql(c: str) -> str:
    out = f"url_encode({c})"
    for form, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{form}', '{char}')"
    return out


@query(f"SELECT conv_id, turn, {_escaped_sql('text')} AS escaped, {_encoded_sql('text')} AS encoded FROM conversations")
def escaped_text(s, d):
    return fx.table(s, d, "conversations").select("conv_id", "turn", text.escaped(F.col("text")).alias("escaped"), text.encoded_path(F.col("text")).alias("encoded"))


@query("SELECT coalesce(CASE WHEN id % 3 <> 0 THEN id END::VARCHAR, 'unknown') AS id, coalesce(CASE WHEN id % 4 <> 0 THEN confidence END, 0.5) AS confidence, coalesce(CASE WHEN id % 5 = 0 THEN confidence END, 0.0)::DOUBLE AS controversy, coalesce(strftime(checked_at, '%Y-%m-%d'), 'Unknown Date') AS day, embedding AS vector, printf('%.1f', confidence * 100) AS percent FROM facts_fx")
def hit_defaults(s, d):
    when = lambda c, v: F.when(c, F.col(v))
    cells = text.hit_defaults(when(F.col("id") % 3 != 0, "id"), when(F.col("id") % 4 != 0, "confidence"), when(F.col("id") % 5 == 0, "confidence"))
    return fx.facts(s, d).select(*cells, text.date_or_unknown(F.date_format("checked_at", "yyyy-MM-dd")).alias("day"), vectors.unwrapped(F.array("embedding")).alias("vector"), scores.percent_text(F.col("confidence")).alias("percent"))


@query("SELECT id, embedding AS vector FROM facts_fx")
def vector_text(s, d):
    f = fx.facts(s, d).select("id", vectors.format_vector_text(F.col("embedding")).alias("t"))
    return f.select("id", vectors.parse_vector_text(F.col("t")).alias("vector"))


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(s, d):
    e = fx.table(s, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("id"), F.round(vectors.cosine_similarity(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query(r"""SELECT id, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host,
    CASE WHEN contains(title, ' - ') THEN string_split(title, ' - ')[-1] ELSE 'Web' END AS publisher, title || '. ' || left(raw_text, 500) AS input,
    left(id::VARCHAR, 8) || '...' AS preview, replace(regexp_replace(title, '<[^>]*>?', '', 'g'), '&nbsp;', ' ') AS clean FROM articles_fx""")
def article_strings(s, d):
    return fx.articles(s, d).select("id", text.authority(F.col("url")).alias("host"), text.publisher_of_title(F.col("title")).alias("publisher"), text.classifier_input(F.col("title"), F.col("raw_text")).alias("input"), text.id_preview(F.col("id")).alias("preview"), text.strip_html(F.col("title")).alias("clean"))


@query(r"""WITH h AS (SELECT doc_id, text, left(text, 3500) AS head, reverse(left(text, 3500)) AS back FROM documents),
    c AS (SELECT doc_id, text, head, greatest(CASE WHEN instr(back, ' .') > 0 THEN length(head) - instr(back, ' .') - 1 ELSE -1 END, CASE WHEN instr(back, chr(10)) > 0 THEN length(head) - instr(back, chr(10)) ELSE -1 END,
        CASE WHEN instr(back, chr(10) || '.') > 0 THEN length(head) - instr(back, chr(10) || '.') - 1 ELSE -1 END) AS cut_at FROM h)
    SELECT doc_id, md5(CASE WHEN length(text) <= 3500 THEN text WHEN cut_at > 0 THEN left(head, cut_at + 1) ELSE head END) AS cut_md5 FROM c""")
def smart_cut(s, d):
    return fx.table(s, d, "documents").select("doc_id", F.md5(text.smart_cut(F.col("text"))).alias("cut_md5"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split(text, '. ')), '^\s+', ''), '\s+$', '') AS sentence FROM documents) SELECT doc_id, sentence FROM s WHERE length(sentence) > 15""")
def sentences(s, d):
    return fx.table(s, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


def _holds(c: str, words: list[str]) -> str:
    return " OR ".join(f"contains({c}, '{w}')" for w in words)


@query(f"""SELECT claim_id, rank, CASE WHEN {_holds('url', scores.HIGH_AUTHORITY)} THEN 1.0::DOUBLE WHEN {_holds('url', scores.LOW_AUTHORITY)} THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS authority FROM evidence_fx""")
def domain_authority(s, d):
    return fx.evidence(s, d).select("claim_id", "rank", scores.domain_authority(F.col("url")).alias("authority"))


STANCE = f"CASE WHEN snippet IS NULL OR length(snippet) < 10 THEN 'NEUTRAL' WHEN {_holds('lower(snippet)', scores.AGAINST)} THEN 'CONTRADICT' WHEN {_holds('lower(snippet)', scores.IN_FAVOUR)} THEN 'SUPPORT' ELSE 'NEUTRAL' END"


@query(f"SELECT id, {STANCE} AS stance FROM stance_texts_fx")
def stance(s, d):
    return hooks.stance(fx.stance_texts(s, d)).select("id", "stance")


@query("""SELECT id, CASE WHEN confidence > 0.7 THEN 'VERIFIED TRUE' WHEN confidence > 0.4 THEN 'DEBATED' ELSE 'FALSE / UNPROVEN' END AS band, CASE WHEN confidence < 0.6 THEN 'NEUTRAL' WHEN id % 2 = 0 THEN 'CONTRADICT' ELSE 'SUPPORT' END AS stance,
    round(confidence * 100)::BIGINT AS percent, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(created_at, '%Y-%m-%d') AS day FROM facts_fx""")
def fact_display(s, d):
    label = F.when(F.col("id") % 2 == 0, "contradiction").otherwise("ENTAILMENT")
    return fx.facts(s, d).select("id", scores.verdict_band(F.col("confidence")).alias("band"), scores.stance_from_scores(label, F.col("confidence")).alias("stance"), F.round(F.col("confidence") * 100).cast("long").alias("percent"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("SELECT id, subject, predicate, object, confidence::VARCHAR AS confidence FROM facts_fx WHERE id % 2 = 0 UNION ALL SELECT id, subject, predicate, object, confidence::VARCHAR FROM facts_fx WHERE id % 2 = 1")
def facts_json(s, d):
    one = F.struct("subject", "predicate", "object", F.col("confidence").cast("string").alias("confidence"))
    j = fx.facts(s, d).select("id", F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.array(one).alias("facts")))).otherwise(F.to_json(F.array(one))).alias("j"))
    return j.select("id", F.inline(shapes.parse_facts(F.col("j"))))


@query("SELECT id, confidence AS score FROM facts_fx")
def nli_json(s, d):
    row = F.struct(F.lit("CONTRADICTION").alias("label"), F.col("confidence").alias("score"))
    j = fx.facts(s, d).select("id", F.when(F.col("id") % 2 == 0, F.to_json(F.array(F.array(row)))).otherwise(F.to_json(F.array(row))).alias("j"))
    return j.select("id", F.element_at(shapes.nli_scores(F.col("j")), "contradiction").alias("score"))


@query("SELECT id, CASE WHEN confidence >= 0.3 THEN 'a' ELSE 'b' END AS label, greatest(confidence, 0.3::DOUBLE) AS score FROM facts_fx WHERE confidence <> 0.3")
def zero_shot_json(s, d):
    f = fx.facts(s, d).where("confidence <> 0.3")
    lists = F.struct(F.array(F.lit("a"), F.lit("b")).alias("labels"), F.array(F.col("confidence"), F.lit(0.3)).alias("scores"))
    dicts = F.array(F.struct(F.lit("a").alias("label"), F.col("confidence").alias("score")), F.struct(F.lit("b").alias("label"), F.lit(0.3).alias("score")))
    j = f.select("id", F.when(F.col("id") % 3 == 0, F.to_json(lists)).when(F.col("id") % 3 == 1, F.to_json(F.array(lists))).otherwise(F.to_json(dicts)).alias("j"))
    return j.select("id", shapes.zero_shot_top(F.col("j")).alias("t")).select("id", "t.label", "t.score")


# ---------------------------------------------------------------- table mutation


# urls repeat: of incoming rows with one url the first is new, and only if no old row has that url; rows without a url are all new
@query("""WITH old AS (SELECT id, url FROM articles_fx WHERE id % 2 = 0), new AS (SELECT CASE WHEN id % 4 = 0 THEN -id ELSE id END AS id, url FROM articles_fx WHERE id % 2 = 1 OR id % 4 = 0),
    first AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM new)
    SELECT id, url FROM old UNION ALL SELECT id, url FROM first WHERE (r = 1 OR url IS NULL) AND NOT EXISTS (SELECT 1 FROM old WHERE old.url = first.url)""")
def insert_ignore(s, d):
    a = fx.articles(s, d).select("id", "url")
    old, new = a.where("id % 2 = 0"), a.where("id % 2 = 1 OR id % 4 = 0").withColumn("id", F.when(F.col("id") % 4 == 0, -F.col("id")).otherwise(F.col("id")))
    return tables.insert_ignore(old, new, ["url"], [F.col("id")])


# urls repeat: every old row with a url meets the first incoming one with it; rows without a url meet none
UPSERTED = """WITH old AS (SELECT url, id, title, raw_text FROM articles_fx WHERE id % 2 = 0), new AS (SELECT url, id, 'new ' || title AS title, 'other' AS raw_text FROM articles_fx WHERE id % 2 = 1 OR id % 4 = 0),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM new) WHERE r = 1 OR url IS NULL)
    SELECT coalesce(o.url, n.url) AS url, coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, md5(coalesce(o.raw_text, n.raw_text)) AS text_md5 FROM old o FULL JOIN first n ON n.url = o.url"""


@query(UPSERTED)
def upsert_articles(s, d):
    a = fx.articles(s, d).select("url", "id", "title", "raw_text")
    new = a.where("id % 2 = 1 OR id % 4 = 0").withColumns({"title": F.concat(F.lit("new "), "title"), "raw_text": F.lit("other")})
    return tables.upsert_articles(a.where("id % 2 = 0"), new).select("url", "id", "title", F.md5("raw_text").alias("text_md5"))


@query(UPSERTED)
def upsert_articles_in_place(s, d):
    a = fx.articles(s, d).select("url", "id", "title", "raw_text")
    new = a.where("id % 2 = 1 OR id % 4 = 0").withColumns({"title": F.concat(F.lit("new "), "title"), "raw_text": F.lit("other")})
    path = staging.new_dir(s, "articles")
    buckets.create(a.where("id % 2 = 0"), path, ["url"], 16)
    buckets.upsert_into(s, path, new, ["title"], ["id", "raw_text"], [F.col("id")])
    return buckets.read(s, path).select("url", "id", "title", F.md5("raw_text").alias("text_md5"))


@query("""SELECT src AS fact1_id, dst AS fact2_id, CASE WHEN src % 20 = 0 THEN 0.99::DOUBLE ELSE weight END AS contradiction_score, TIMESTAMP '2024-01-01' AS detected_at FROM edges_fx WHERE type = 'CONTRADICTS'""")
def upsert_contradictions(s, d):
    e = fx.edges(s, d).where("type = 'CONTRADICTS'").selectExpr("src AS fact1_id", "dst AS fact2_id", "weight AS contradiction_score", "TIMESTAMP'2024-01-01' AS detected_at", "TIMESTAMP'2024-01-01' AS updated_at", "'x' AS detection_method")
    new = e.where("fact1_id % 20 = 0").withColumns({"contradiction_score": F.lit(0.99), "detected_at": F.lit(NOW).cast("timestamp"), "updated_at": F.lit(NOW).cast("timestamp")})
    return tables.upsert_contradictions(e, new).select("fact1_id", "fact2_id", "contradiction_score", "detected_at")


@query("SELECT article_id, CASE WHEN article_id % 2 = 0 THEN status ELSE 'PENDING' END AS status, attempts FROM queue_fx")
def enqueue(s, d):
    return tables.enqueue(fx.queue(s, d).where("article_id % 2 = 0"), fx.articles(s, d))


@query("""SELECT article_id, CASE WHEN status = 'PENDING' AND article_id % 2 = 0 THEN 'SCRAPED' WHEN status = 'SCRAPED' AND article_id % 5 = 0 THEN 'CLASSIFIED' ELSE status END AS status, attempts FROM queue_fx""")
def queue_transition(s, d):
    q = fx.queue(s, d)
    return tables.advance_queue(q, q.where("article_id % 2 = 0"), q.where("article_id % 5 = 0"))


OLD = f"SELECT id FROM articles_fx WHERE processed_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY ORDER BY processed_at, id LIMIT 1000"


@query(f"SELECT id, 'archive' AS part FROM ({OLD}) UNION ALL SELECT id, 'live' FROM articles_fx WHERE id NOT IN ({OLD})")
def archive_split(s, d):
    live, old = tables.archive_old(fx.articles(s, d), NOW)
    part = lambda df, name: df.select("id", F.lit(name).alias("part"))
    return part(live, "live").unionByName(part(old, "archive"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN trust_score ELSE 0.5::DOUBLE END AS trust_score FROM articles_fx")
def add_column_default(s, d):
    return tables.add_column_default(fx.articles(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("trust_score")).alias("trust_score")), "trust_score", 0.5)


# ---------------------------------------------------------------- graph


@query(f"""SELECT 'Fact' AS label, id, {STATEMENT} AS text, confidence, NULL::VARCHAR AS url FROM facts_fx UNION ALL SELECT 'Article', id, NULL, NULL, url FROM articles_fx""")
def merge_nodes(s, d):
    return graph.build_vertices(fx.articles(s, d), fx.facts(s, d)).select("label", "id", "text", "confidence", "url")


PUBLISHED = "SELECT id FROM facts_fx WHERE is_original AND checked_at IS NOT NULL"
ASSERTED = f"""SELECT DISTINCT article_id AS src, CASE WHEN is_original THEN fact_id ELSE provenance_id END AS dst FROM ({ASSERTIONS})
    WHERE article_id IN (SELECT id FROM ({GATED_ARTICLES})) AND CASE WHEN is_original THEN fact_id ELSE provenance_id END IN ({PUBLISHED})"""


@query(ASSERTED)
def merge_assertions(s, d):
    f, a = gates.gate_facts(fx.facts(s, d)), gates.gate_articles(fx.articles(s, d), fx.article_topics(s, d))
    return graph.build_assertion_edges(_assertions(s, d), a, f).select("src", "dst")


@query("SELECT src, dst, weight FROM edges_fx WHERE type = 'CONTRADICTS'")
def merge_contradiction_edges(s, d):
    e = fx.edges(s, d).where("type = 'CONTRADICTS'").selectExpr("src AS fact1_id", "dst AS fact2_id", "weight AS contradiction_score", "'x' AS detection_method", "TIMESTAMP'2024-01-01' AS detected_at")
    back = e.selectExpr("fact2_id AS fact1_id", "fact1_id AS fact2_id", "0.0D AS contradiction_score", "detection_method", "TIMESTAMP'2023-01-01' AS detected_at")
    return graph.build_contradiction_edges(e.unionByName(back), fx.facts(s, d)).select("src", "dst", "weight")


GRAPH = f"""SELECT 'Fact' AS label, id, NULL::BIGINT AS dst, {STATEMENT} AS text, confidence, NULL::VARCHAR AS url, NULL::VARCHAR AS title, NULL::VARCHAR AS date FROM facts_fx WHERE id IN ({PUBLISHED})
    UNION ALL SELECT 'Article', id, NULL, NULL, NULL, url, title, strftime(published_date, '%Y-%m-%dT%H:%M:%S') FROM articles_fx WHERE id IN (SELECT id FROM ({GATED_ARTICLES}))
    UNION ALL SELECT 'ASSERTED', src, dst, NULL, NULL, NULL, NULL, NULL FROM ({ASSERTED})"""


def _graph_rows(v: DataFrame, e: DataFrame) -> DataFrame:
    none = lambda c: F.lit(None).cast("double" if c == "confidence" else "string").alias(c)
    columns = ["text", "confidence", "url", "title", "date"]
    edges = e.select(F.col("type").alias("label"), F.col("src").alias("id"), "dst", *map(none, columns))
    return v.select("label", "id", F.lit(None).cast("long").alias("dst"), *columns).unionByName(edges)


@query(GRAPH)
def publish_graph(s, d):
    path = staging.new_dir(s, "graph")
    publish.write_graph(*publish.publish_graph(fx.facts(s, d), fx.articles(s, d), fx.article_topics(s, d)), path)
    return _graph_rows(*publish.read_graph(s, path))


@query(f"SELECT label, id, dst, TRUE AS gone FROM ({GRAPH})")
def reset_graph(s, d):
    path = staging.new_dir(s, "graph")
    publish.write_graph(*publish.publish_graph(fx.facts(s, d), fx.articles(s, d), fx.article_topics(s, d)), path)
    before = staging.staged(_graph_rows(*publish.read_graph(s, path)).select("label", "id", "dst"), "before")
    publish.write_graph(*graph.empty_graph(s), path)
    after = _graph_rows(*publish.read_graph(s, path)).select("label", "id", "dst").withColumn("left", F.lit(True))
    same = [before[c].eqNullSafe(after[c]) for c in ("label", "id", "dst")]
    return before.join(after, same, "left").select(before["label"], before["id"], before["dst"], F.col("left").isNull().alias("gone"))


@query(f"""SELECT 'facts' AS part, id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS at, {STATEMENT} AS text FROM facts_fx UNION ALL SELECT 'articles', id, strftime(published_date, '%Y-%m-%dT%H:%M:%S'), url FROM articles_fx
    UNION ALL SELECT 'assertions', fact_id, NULL, article_id::VARCHAR FROM ({ASSERTIONS})""")
def export_payload(s, d):
    path = staging.new_dir(s, "payload")
    publish.export_payload(fx.facts(s, d).drop("embedding"), fx.articles(s, d), _assertions(s, d), path)
    got = lambda part, schema: s.read.schema(schema).json(f"{path}/{part}")
    f = got("facts", "id long, created_at string, subject string, predicate string, object string").select(F.lit("facts").alias("part"), "id", F.col("created_at").alias("at"), text.fact_statement(F.col("subject"), F.col("predicate"), F.col("object")).alias("text"))
    a = got("articles", "id long, published_date string, url string").select(F.lit("articles").alias("part"), "id", F.col("published_date").alias("at"), F.col("url").alias("text"))
    e = got("assertions", "fact_id long, article_id string").select(F.lit("assertions").alias("part"), F.col("fact_id").alias("id"), F.lit(None).cast("string").alias("at"), F.col("article_id").alias("text"))
    return f.unionByName(a).unionByName(e)


@query(f"""WITH src AS (SELECT dst AS id, list({{'id': a.id, 'title': title, 'url': url}} ORDER BY a.id, title, url) AS sources FROM edges_fx JOIN articles_fx a ON a.id = src WHERE type = 'ASSERTED' GROUP BY dst)
    SELECT f.id, to_json({{'@context': 'https://schema.org', '@type': 'ClaimReview', 'factReviewed': {STATEMENT}, 'reviewRating': {{'@type': 'Rating', 'ratingValue': confidence, 'bestRating': 1.0::DOUBLE, 'worstRating': 0.0::DOUBLE}},
        'itemReviewed': {{'@type': 'CreativeWork', 'sources': coalesce(sources, [])}}}})::VARCHAR AS jsonld FROM facts_fx f LEFT JOIN src ON src.id = f.id""")
def export_jsonld(s, d):
    f = fx.facts(s, d)
    return graph.export_claim_review(f.select("id"), f, fx.articles(s, d), fx.edges(s, d))


ASSERT_LISTS = "SELECT dst AS id, list_sort(list(DISTINCT src)) AS articles FROM edges_fx WHERE type = 'ASSERTED' AND src IN (SELECT id FROM articles_fx) GROUP BY dst"


@query(f"SELECT f.id, {STATEMENT} AS statement, confidence, coalesce(articles, []) AS articles FROM facts_fx f LEFT JOIN ({ASSERT_LISTS}) l ON l.id = f.id")
def fact_with_articles(s, d):
    f = fx.facts(s, d)
    return graph.fact_with_articles(f.select("id"), f, fx.articles(s, d), fx.edges(s, d))


@query(f"""SELECT id AS center, 'Fact' AS kind, id, NULL::BIGINT AS source, NULL::BIGINT AS target, {STATEMENT} AS label FROM facts_fx WHERE id % 10 = 0
    UNION ALL SELECT dst, 'Article', src, NULL, NULL, CASE WHEN title = '' THEN 'Unknown' ELSE title END FROM edges_fx JOIN articles_fx ON id = src WHERE type = 'ASSERTED' AND dst % 10 = 0
    UNION ALL SELECT dst, 'edge', NULL, src, dst, 'ASSERTED' FROM edges_fx WHERE type = 'ASSERTED' AND dst % 10 = 0""")
def fact_subgraph(s, d):
    f = fx.facts(s, d)
    return graph.fact_subgraph(_ids(f, 10), f, fx.articles(s, d), fx.edges(s, d)).drop("confidence")


@query("""WITH e AS (SELECT DISTINCT src, dst, type, CASE WHEN type = 'ASSERTED' THEN 'Article' ELSE 'Fact' END AS sl FROM edges_fx),
    n AS (SELECT sl AS label, src AS id, 'Fact' AS other_label, dst AS other_id, type FROM e UNION ALL SELECT 'Fact', dst, sl, src, type FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY other_label, other_id, type) AS rank FROM (SELECT DISTINCT * FROM n))
    SELECT v.label, v.id, other_label, other_id, type, rank::INT AS rank FROM (SELECT 'Fact' AS label, id FROM facts_fx UNION ALL SELECT 'Article', id FROM articles_fx) v
    LEFT JOIN r ON r.label = v.label AND r.id = v.id AND rank <= 25""")
def neighbors(s, d):
    f, a = fx.facts(s, d), fx.articles(s, d)
    v = f.select(F.lit("Fact").alias("label"), "id").unionByName(a.select(F.lit("Article").alias("label"), "id"))
    return graph.neighbors(v, v, fx.edges(s, d))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'first' ELSE 'second' END AS side FROM facts_fx")
def merge_elements(s, d):
    f = fx.facts(s, d).select("id")
    return graph.merge_elements(f.where("id % 2 = 0").withColumn("side", F.lit("first")), f.withColumn("side", F.lit("second")), ["id"])


@query("""SELECT src AS a, dst AS b, weight, x.confidence AS a_confidence, y.confidence AS b_confidence FROM edges_fx JOIN facts_fx x ON x.id = src JOIN facts_fx y ON y.id = dst
    WHERE type = 'CONTRADICTS' AND x.confidence > 0.5 AND y.confidence > 0.5 ORDER BY weight DESC, a, b LIMIT 50""")
def contradictions_all(s, d):
    return graph.contradictions_all(fx.facts(s, d), fx.edges(s, d))


@query(f"SELECT src AS id, dst AS other_id, {STATEMENT} AS statement, confidence, weight FROM edges_fx JOIN facts_fx ON id = dst WHERE type = 'CONTRADICTS'")
def contradictions_of(s, d):
    f = fx.facts(s, d)
    return graph.contradictions_of(f.select("id"), f, fx.edges(s, d))


@query(f"""SELECT f.id, {STATEMENT} AS statement, confidence, b.src AS predecessor_id, n.dst AS evolved_to_id, coalesce(t.sources, []) AS sources FROM facts_fx f
    LEFT JOIN (SELECT * FROM edges_fx WHERE type = 'EVOLVES_TO') n ON n.src = f.id LEFT JOIN (SELECT * FROM edges_fx WHERE type = 'EVOLVES_TO') b ON b.dst = f.id
    LEFT JOIN (SELECT dst, list_sort(list(DISTINCT title)) AS sources FROM edges_fx JOIN articles_fx ON id = src WHERE type = 'ASSERTED' GROUP BY dst) t ON t.dst = f.id""")
def fact_history(s, d):
    f = fx.facts(s, d)
    return graph.fact_history(f.select("id"), f, fx.articles(s, d), fx.edges(s, d))


@query("""WITH RECURSIVE p AS (SELECT src AS start_id, dst AS id, 1 AS distance, [src, dst] AS path FROM edges_fx WHERE type = 'EVOLVES_TO'
    UNION ALL SELECT start_id, e.dst, distance + 1, list_append(path, e.dst) FROM p JOIN edges_fx e ON e.src = p.id AND e.type = 'EVOLVES_TO' WHERE NOT list_contains(path, e.dst))
    SELECT start_id, id, distance::INT AS distance, path FROM p""")
def fact_evolution(s, d):
    return graph.evolve(fx.facts(s, d).select("id"), fx.edges(s, d))


@query("""SELECT (SELECT count(*) FROM facts_fx) + (SELECT count(*) FROM articles_fx) AS nodes, (SELECT count(*) FROM facts_fx) AS facts, (SELECT count(*) FROM articles_fx) AS articles,
    (SELECT count(*) FROM articles_fx WHERE is_reference) AS "references", (SELECT count(*) FROM edges_fx WHERE type = 'ASSERTED') AS assertions""")
def count_nodes(s, d):
    return graph.count_nodes(graph.build_vertices(fx.articles(s, d), fx.facts(s, d)), fx.edges(s, d))


@query("SELECT count(DISTINCT src) AS articles, count(DISTINCT dst) AS facts, count(*) AS assertions, count(*) // count(DISTINCT src) AS per_article FROM edges_fx WHERE type = 'ASSERTED'")
def relationship_stats(s, d):
    return graph.relationship_stats(fx.edges(s, d))


@query("SELECT type, count(*) AS n FROM edges_fx WHERE type <> 'ASSERTED' GROUP BY type")
def relationship_types(s, d):
    return graph.relationship_types(fx.edges(s, d))


@query("SELECT DISTINCT label FROM (SELECT 'Fact' AS label FROM facts_fx UNION ALL SELECT 'Article' FROM articles_fx)")
def distinct_labels(s, d):
    return graph.distinct_labels(graph.build_vertices(fx.articles(s, d), fx.facts(s, d)))


@query("SELECT id, subject, predicate, object, confidence FROM facts_fx ORDER BY confidence DESC, id LIMIT 20 OFFSET 40")
def list_facts(s, d):
    return graph.list_facts(fx.facts(s, d), *graph.page_bounds(20, 40))


@query("SELECT id, title, url, published_date FROM articles_fx ORDER BY published_date DESC, id LIMIT 20 OFFSET 10")
def list_articles(s, d):
    return graph.list_articles(fx.articles(s, d), *graph.page_bounds(20, 10))


@query(f"""SELECT src AS article_id, dst AS fact_id, title, {STATEMENT} AS statement, is_reference FROM edges_fx JOIN articles_fx a ON a.id = src JOIN facts_fx f ON f.id = dst WHERE type = 'ASSERTED' ORDER BY src, dst LIMIT 5""")
def sample_assertions(s, d):
    return graph.sample_assertions(fx.facts(s, d), fx.articles(s, d), fx.edges(s, d))


# ---------------------------------------------------------------- joins over facts and articles


@query("SELECT f.id, subject, predicate, object, confidence, created_at, title, url FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id ORDER BY created_at DESC, f.id LIMIT 50")
def latest_facts(s, d):
    return provenance.latest_facts(fx.facts(s, d), fx.articles(s, d))


@query("SELECT id, url, status FROM articles_fx JOIN queue_fx ON article_id = id")
def queue_join(s, d):
    return fx.articles(s, d).select("id", "url").join(fx.queue(s, d).select(F.col("article_id").alias("id"), "status"), "id")


@query("SELECT id, title FROM articles_fx WHERE id NOT IN (SELECT article_id FROM article_topics_fx)")
def unclassified_anti(s, d):
    return fx.articles(s, d).select("id", "title").join(fx.article_topics(s, d).select(F.col("article_id").alias("id")), "id", "left_anti")


@query("SELECT t.article_id, name, t.confidence FROM article_topics_fx t JOIN topics_fx ON id = topic_id")
def topic_lookup(s, d):
    return fx.article_topics(s, d).join(fx.topics(s, d).select(F.col("id").alias("topic_id"), "name"), "topic_id").select("article_id", "name", "confidence")


@query("""SELECT a.id, coalesce(arg_max(s.trust_score / 10, s.position), 0.5) AS trust_score FROM articles_fx a LEFT JOIN sources_fx s ON contains(a.url, s.host) GROUP BY a.id""")
def trust_domain_join(s, d):
    return trust.score_trust(fx.articles(s, d), fx.sources(s, d)).select("id", "trust_score")


@query(r"""SELECT replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host, arg_max(page_id % 10 + 1, page_id) / 10 AS score FROM pages GROUP BY 1""")
def domain_score_map(s, d):
    listed = fx.table(s, d, "pages").select(F.col("page_id").alias("position"), "url", (F.col("page_id") % 10 + 1).cast("double").alias("trust_score"))
    return trust.domain_score_map(listed).select("host", "score")


@query("""SELECT CASE WHEN trust_score >= 0.9 THEN 'High (0.9-1.0)' WHEN trust_score >= 0.7 THEN 'Medium (0.7-0.9)' WHEN trust_score >= 0.5 THEN 'Low (0.5-0.7)' ELSE 'Unknown (<0.5)' END AS trust_tier, count(*) AS n FROM articles_fx GROUP BY 1""")
def trust_tiers(s, d):
    return trust.trust_tiers(fx.articles(s, d))


@query("SELECT claim_id, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rank, url) AS r FROM evidence_fx) WHERE r <= 5")
def top5_evidence(s, d):
    return trust.top_evidence(fx.evidence(s, d)).select("claim_id", "rank", "url")


@query(f"""WITH e AS (SELECT claim_id, {STANCE} AS stance, CASE WHEN {_holds('url', scores.HIGH_AUTHORITY)} THEN 1.0 WHEN {_holds('url', scores.LOW_AUTHORITY)} THEN 0.2 ELSE 0.5 END::DOUBLE AS a FROM evidence_fx),
    n AS (SELECT claim_id, sum(CASE WHEN stance = 'SUPPORT' THEN a ELSE 0 END) AS support, sum(CASE WHEN stance = 'CONTRADICT' THEN a ELSE 0 END) AS against FROM e GROUP BY claim_id)
    SELECT claim_id, support, against, CASE WHEN claim_id % 11 = 0 THEN 0.05 WHEN claim_id % 11 = 1 THEN 0.95 ELSE round(greatest(0.01, least(0.99, 0.5 + 0.2 * (support - against))), 6) END::DOUBLE AS confidence FROM n""")
def claim_confidence(s, d):
    e = fx.evidence(s, d)
    checks = e.where("claim_id % 11 < 2").select("claim_id", F.when(F.col("claim_id") % 11 == 0, "Mostly False").otherwise("True").alias("rating"))
    return trust.score_claims(e.select("claim_id"), e, checks)


@query(f"""SELECT f.id, {STATEMENT} AS statement, m.id AS master_id, m.s AS master_statement FROM facts_fx f LEFT JOIN (SELECT id, {STATEMENT} AS s FROM facts_fx) m ON m.id = f.provenance_id""")
def provenance_lookup(s, d):
    f = fx.facts(s, d)
    return provenance.provenance_lookup(f.select("id"), f, fx.articles(s, d)).select("id", "statement", "master_id", "master_statement")


@query("""SELECT url FROM articles_fx UNION ALL SELECT url FROM (SELECT DISTINCT url FROM external_hits_fx WHERE rank = 1) h WHERE NOT EXISTS (SELECT 1 FROM articles_fx a WHERE a.url = h.url)""")
def external_reference(s, d):
    return provenance.external_reference(fx.articles(s, d), fx.external_hits(s, d)).select("url")


# ---------------------------------------------------------------- similarity

PAIRS = f"SELECT a.id AS a, b.id AS b, {DIST} AS dist FROM facts_fx a JOIN facts_fx b ON a.id < b.id"
REPS = "reps AS (SELECT min(id) AS id, embedding, count(*) AS n FROM facts_fx GROUP BY embedding)"


@query(f"WITH {REPS} SELECT a.id AS a, b.id AS b, round({DIST}, 6) AS distance, a.n * b.n AS links FROM reps a JOIN reps b ON a.id < b.id WHERE {DIST} < 0.6")
def similar_pairs(s, d):
    pairs, member = similarity.similar_pairs(fx.facts(s, d), 0.6)
    n = member.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    sized = pairs.join(n.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", F.round("distance", 6).alias("distance"), (F.col("na") * F.col("nb")).alias("links"))


@query()  # candidates by random projections: some pairs are missed, so no SQL gives the same rows; a test measures recall against all pairs
def similar_pairs_lsh(s, d):
    return similarity.similar_pairs(fx.facts(s, d), 0.6, method="lsh")[0].select("a", "b", F.round("distance", 6).alias("distance"))


def _knn_sql(t: float) -> str:
    return f"""WITH p AS ({PAIRS}), n AS (SELECT a AS id, b AS neighbor_id, dist FROM p WHERE dist < {t} UNION ALL SELECT b, a, dist FROM p WHERE dist < {t})
        SELECT id, neighbor_id, abs(round(dist, 6)) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), neighbor_id) AS r FROM n) WHERE r <= 10"""


def _round(df: DataFrame) -> DataFrame:
    return df.select("id", "neighbor_id", F.abs(F.round("distance", 6)).alias("distance"))


@query(_knn_sql(0.15))
def knn_neighbors(s, d):
    return _round(similarity.knn_neighbors(fx.facts(s, d)))


# vectors that differ by fact, so that the work grows with the facts
_OWN = "own AS (SELECT id, list_transform(embedding, lambda x, i: x + ((id * 31 + i * 17) % 97 - 48) / 2000.0::DOUBLE) AS embedding FROM facts_fx)"


@query(f"WITH {_OWN}, " + _knn_sql(0.15)[5:].replace("facts_fx", "own"))
def knn_own_vectors(s, d):
    shift = lambda x, i: x + F.pmod(F.col("id") * 31 + (i + 1) * 17, F.lit(97)).cast("double") / 2000 - F.lit(48 / 2000)
    return _round(similarity.knn_neighbors(fx.facts(s, d).withColumn("embedding", F.transform("embedding", shift))))


@query(_knn_sql(0.65))
def knn_neighbors_wide(s, d):
    return _round(similarity.knn_neighbors(fx.facts(s, d), 0.65))


@query(f"""WITH c AS (SELECT f.id, f.embedding FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id WHERE is_original AND f.created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY),
    n AS (SELECT a.id, b.id AS neighbor_id, {DIST} AS dist FROM c a JOIN facts_fx b ON a.id <> b.id AND b.is_original WHERE {DIST} BETWEEN 0.05 AND 0.65)
    SELECT id, neighbor_id, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), neighbor_id) AS r FROM n) WHERE r <= 10""")
def band_candidates(s, d):
    f = fx.facts(s, d)
    return _round(similarity.band_candidates(f, gates.facts_to_check(f, fx.articles(s, d), NOW), 0.05, 0.65))


# one fact after the other, in order: kept unless a kept one is near; of equal vectors only the first can be kept
def _greedy_sql(t: float) -> str:
    return f"""WITH RECURSIVE o AS (SELECT id, embedding, row_number() OVER (ORDER BY created_at, id) AS rn, row_number() OVER (PARTITION BY embedding ORDER BY created_at, id) AS copy FROM facts_fx),
    lead AS (SELECT id, embedding, row_number() OVER (ORDER BY rn) AS k FROM o WHERE copy = 1),
    near AS (SELECT b.k, list(a.k) AS earlier FROM lead a JOIN lead b ON a.k < b.k WHERE {DIST} < {t} GROUP BY b.k),
    every AS (SELECT lead.k, coalesce(earlier, []) AS earlier FROM lead LEFT JOIN near ON near.k = lead.k),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT e.k, CASE WHEN list_has_any(r.kept, e.earlier) THEN r.kept ELSE list_append(r.kept, e.k) END FROM r JOIN every e ON e.k = r.k + 1),
    final AS (SELECT unnest(kept) AS k FROM r WHERE k = (SELECT max(k) FROM lead))
    SELECT id, id IN (SELECT lead.id FROM lead JOIN final ON final.k = lead.k) AS kept FROM facts_fx"""


@query(_greedy_sql(0.05))
def dedup_semantic(s, d):
    return similarity.dedup_facts(fx.facts(s, d))


@query(_greedy_sql(0.6))
def dedup_semantic_wide(s, d):
    return similarity.dedup_facts(fx.facts(s, d), 0.6)


@query("SELECT id, NOT EXISTS (SELECT 1 FROM facts_fx e WHERE e.embedding = f.embedding AND (e.id % 4 = 0 OR e.id < f.id)) AS kept FROM facts_fx f WHERE id % 4 <> 0")
def dedup_against_stored(s, d):
    f = fx.facts(s, d)
    return similarity.dedup_facts(f.where("id % 4 <> 0").withColumn("created_at", F.lit(NOW).cast("timestamp")), 1e-6, f.where("id % 4 = 0"))


@query(f"""WITH b AS (SELECT f.id FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id WHERE trust_score >= 0.8 AND f.created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND is_original ORDER BY f.created_at DESC, f.id LIMIT 500),
    c AS (SELECT f.id FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id WHERE is_original AND f.created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY)
    SELECT c.id AS fact1_id, b.id AS fact2_id FROM c JOIN b ON c.id <> b.id""")
def cross_candidates(s, d):
    f, a = fx.facts(s, d), fx.articles(s, d)
    return similarity.cross_candidates(gates.facts_to_check(f, a, NOW), gates.baseline_facts(f, a, NOW))


@query(f"""WITH k AS ({_knn_sql(0.15)}), dt AS (SELECT f.id, published_date AS date FROM facts_fx f LEFT JOIN articles_fx a ON a.id = f.article_id),
    e AS (SELECT k.id, neighbor_id, n.date AS date, distance FROM k JOIN dt o ON o.id = k.id JOIN dt n ON n.id = k.neighbor_id WHERE n.date < o.date),
    b AS (SELECT id, neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date, distance, neighbor_id) AS r FROM e) WHERE r = 1)
    SELECT dt.id, b.id IS NULL AND x.fact_id IS NULL AS is_original, b.neighbor_id AS provenance_id, CASE WHEN b.id IS NULL THEN x.url END AS external_source_url FROM dt LEFT JOIN b ON b.id = dt.id LEFT JOIN external_hits_fx x ON x.fact_id = dt.id""")
def trace_provenance(s, d):
    return provenance.trace_provenance(fx.facts(s, d), fx.articles(s, d), fx.external_hits(s, d)).select("id", "is_original", "provenance_id", "external_source_url")


# ---------------------------------------------------------------- search

TEXT = f"lower({STATEMENT})"
WORDS = r"list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: w <> '')[1:10]"
BOOST = "CASE WHEN confidence > 0.8 THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN confidence > 0.9 THEN 1.5 ELSE 1.0 END::DOUBLE"


def _top_sql(hits: str, k: int = 15) -> str:
    return f"""WITH h AS ({hits}) SELECT query_id, id, subject, predicate, object, confidence, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM h) WHERE rank <= {k}"""


_ANY = f"FROM queries_fx q JOIN facts_fx f ON len(list_filter({WORDS}, lambda w: contains({TEXT}, w))) > 0"
_PHRASE = f"FROM queries_fx q JOIN facts_fx f ON contains({TEXT}, lower(query))"
_SIM = "list_cosine_similarity(q.embedding, f.embedding)"


@query(_top_sql(f"SELECT q.query_id, f.*, confidence AS relevance {_ANY}"))
def search_keyword(s, d):
    return search.search_keyword(fx.search_queries(s, d), fx.facts(s, d))


@query(_top_sql(f"SELECT q.query_id, f.*, confidence * ({BOOST}) AS relevance {_ANY}"))
def search_truthrank(s, d):
    return search.search_truthrank(fx.search_queries(s, d), fx.facts(s, d))


@query(_top_sql(f"SELECT q.query_id, f.*, confidence AS relevance {_PHRASE}"))
def search_phrase(s, d):
    return search.search_phrase(fx.search_queries(s, d), fx.facts(s, d))


@query(f"SELECT q.query_id, f.id {_ANY}")
def keyword_any(s, d):
    return search.keyword_any(fx.search_queries(s, d), fx.facts(s, d)).select("query_id", "id")


@query(f"SELECT q.query_id, f.id {_PHRASE}")
def phrase_match(s, d):
    return search.phrase_match(fx.search_queries(s, d), fx.facts(s, d)).select("query_id", "id")


@query(_top_sql(f"SELECT q.query_id, f.*, round({_SIM}, 6) AS relevance FROM queries_fx q JOIN facts_fx f ON {_SIM} >= 0.3"))
def search_vector(s, d):
    return search.search_vector(fx.search_queries(s, d), fx.facts(s, d), 0.3)


HYBRID = f"""SELECT q.query_id, f.*, round((CASE WHEN contains({TEXT}, lower(query)) THEN confidence ELSE 0 END * 0.5 + greatest({_SIM}, 0) * 0.5) * confidence * ({BOOST}), 6) AS relevance
    FROM queries_fx q JOIN facts_fx f ON contains({TEXT}, lower(query)) OR {_SIM} > 0"""


@query(_top_sql(HYBRID))
def search_hybrid(s, d):
    return search.search_hybrid(fx.search_queries(s, d), fx.facts(s, d))


@query(_top_sql(f"SELECT q.query_id, f.*, round(confidence * 0.5 + {_SIM} * 0.5, 6) AS relevance {_PHRASE}"))
def search_hybrid_filtered(s, d):
    return search.search_hybrid_filtered(fx.search_queries(s, d), fx.facts(s, d))


@query(_top_sql(f"{HYBRID} AND q.query_id % 2 = 0".replace("ON contains", "ON (contains", 1).replace(f"{_SIM} > 0 AND", f"{_SIM} > 0) AND") + f" UNION ALL SELECT q.query_id, f.*, confidence {_ANY} AND q.query_id % 2 = 1"))
def search_route(s, d):
    q = fx.search_queries(s, d).withColumn("embedding", F.when(F.col("query_id") % 2 == 0, F.col("embedding")))
    return search.search(q, fx.facts(s, d), 64)


@query(f"""WITH b AS (SELECT q.query_id, f.id, {STATEMENT} AS statement, confidence, row_number() OVER (PARTITION BY q.query_id ORDER BY confidence DESC, f.id) AS r {_PHRASE})
    SELECT q.query_id, b.id IS NOT NULL AS found, b.id, statement, confidence FROM queries_fx q LEFT JOIN b ON b.query_id = q.query_id AND r = 1""")
def verify_fact(s, d):
    return search.verify(fx.search_queries(s, d), fx.facts(s, d))


@query("SELECT query_id, unnest(list_filter(list_distinct([query, query || 's', query]), lambda t: t <> '')) AS term FROM queries_fx")
def expand_terms(s, d):
    return fx.search_queries(s, d).select("query_id", F.explode(text.expand_terms(F.col("query"), F.array(F.concat("query", F.lit("s")), F.col("query"), F.lit(" "), F.lit(None)))).alias("term"))


# ---------------------------------------------------------------- hooks, contradictions, consistency


@query(r"""WITH w AS (SELECT item_id, text, list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), lambda x: ('0x' || left(md5(x), 8))::BIGINT % 64) AS slots FROM benchmark),
    c AS (SELECT item_id, text, list_transform(range(64), lambda i: len(list_filter(slots, lambda x: x = i))::DOUBLE) AS n, len(slots) AS words FROM w)
    SELECT item_id, text, CASE WHEN words > 0 THEN list_transform(n, lambda x: (x / sqrt(list_sum(list_transform(n, lambda y: y * y))))::FLOAT) END AS embedding FROM c""")
def embed(s, d):
    return hooks.embed(fx.table(s, d, "benchmark").select("item_id", "text"))


@query("""WITH x AS (SELECT label AS topic_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT topic_id, i, avg(x) AS x FROM x GROUP BY ALL),
    p AS (SELECT topic_id, list(x ORDER BY i) AS p FROM m GROUP BY topic_id), c AS (SELECT id, topic_id, list_cosine_similarity(embedding, p) AS score FROM facts_fx, p)
    SELECT id AS article_id, topic_id, round(score, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic_id) AS r FROM c) WHERE r = 1 AND score > 0.1""")
def classify_topics(s, d):
    f = fx.facts(s, d)
    proto = hooks.topic_prototypes(fx.table(s, d, "embeddings").select(F.col("label").alias("topic_id"), "embedding"))
    return hooks.classify_topics(f, proto, 0.1).withColumn("confidence", F.round("confidence", 6))


@query(r"""WITH s AS (SELECT doc_id AS id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS position FROM documents),
    w AS (SELECT id, position, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w FROM s) SELECT id, position::INT AS position, w[1] AS subject, w[2] AS predicate, array_to_string(w[3:5], ' ') AS object FROM w WHERE len(w) >= 3""")
def extract_facts(s, d):
    return hooks.extract_facts(fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(r"""WITH h AS (SELECT doc_id, text, left(text, 3500) AS head, reverse(left(text, 3500)) AS back FROM documents),
    c AS (SELECT doc_id, text, head, greatest(CASE WHEN instr(back, ' .') > 0 THEN length(head) - instr(back, ' .') - 1 ELSE -1 END, CASE WHEN instr(back, chr(10)) > 0 THEN length(head) - instr(back, chr(10)) ELSE -1 END,
        CASE WHEN instr(back, chr(10) || '.') > 0 THEN length(head) - instr(back, chr(10) || '.') - 1 ELSE -1 END) AS cut_at FROM h),
    s AS (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN length(text) <= 3500 THEN text WHEN cut_at > 0 THEN left(head, cut_at + 1) ELSE head END, '. '), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) > 15) AS s FROM c)
    SELECT doc_id AS id, generate_subscripts(s, 1)::INT - 1 AS position, unnest(s) AS claim FROM s""")
def extract_claims(s, d):
    return hooks.extract_claims(fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


# a text is words and what lies between them: a word's place is the length of all before it
_WORD = rf"{hooks.ENTITY}|{hooks.WORD}"
_ENTITIES = rf"""m AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS words, regexp_split_to_array(text, '{_WORD}') AS gaps FROM documents),
    p AS (SELECT doc_id, generate_subscripts(words, 1) AS k, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap FROM m),
    l AS (SELECT doc_id, k, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) - length(word) AS start FROM p),
    e AS (SELECT doc_id AS id, word AS text, 'ORG' AS type, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT - 1 AS position, start::INT AS start FROM l WHERE regexp_full_match(word, '{hooks.ENTITY}'))"""


@query(f"WITH {_ENTITIES} SELECT * FROM e")
def extract_entities(s, d):
    return hooks.extract_entities(fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {_ENTITIES} SELECT id, text, type, start FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(text), type ORDER BY start) AS r FROM e) WHERE r = 1")
def unique_entities(s, d):
    return hooks.unique_entities(hooks.extract_entities(fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")))


def _nli_sql(a: str, b: str) -> str:
    """The default score of two facts by their aliases."""
    negated = lambda t: rf"regexp_matches(lower(concat_ws(' ', {t}.subject, {t}.predicate, {t}.object)), '\b(not|no|never|none|nor)\b|n''t\b')"
    numbers = lambda t: rf"list_sort(regexp_extract_all(concat_ws(' ', {t}.subject, {t}.predicate, {t}.object), '\d+'))"
    differ = f"({negated(a)} <> {negated(b)} OR len({numbers(a)}) > 0 AND len({numbers(b)}) > 0 AND {numbers(a)} <> {numbers(b)})"
    return f"CASE WHEN lower({a}.subject) = lower({b}.subject) AND lower({a}.predicate) = lower({b}.predicate) AND {differ} THEN 0.9 ELSE 0.1 END::DOUBLE"


@query(f"SELECT a.id AS fact1_id, b.id AS fact2_id, {_nli_sql('a', 'b')} AS contradiction_score FROM stated a JOIN stated b ON b.id = a.id + 1".replace("stated", "(SELECT id, CASE WHEN id % 3 = 0 THEN 'it' ELSE subject END AS subject, CASE WHEN id % 3 < 2 THEN 'is' ELSE predicate END AS predicate, object || CASE WHEN id % 4 = 1 THEN ' not 7' WHEN id % 4 = 2 THEN ' 7 or 12' ELSE '' END AS object FROM facts_fx)"))
def score_nli(s, d):
    f = fx.facts(s, d)
    k = F.col("id")
    stated = f.select("id", F.when(k % 3 == 0, "it").otherwise(F.col("subject")).alias("subject"), F.when(k % 3 < 2, "is").otherwise(F.col("predicate")).alias("predicate"), F.concat("object", F.when(k % 4 == 1, " not 7").when(k % 4 == 2, " 7 or 12").otherwise("")).alias("object"))
    pairs = hooks.pair_texts(f.select(k.alias("fact1_id"), (k + 1).alias("fact2_id")), stated)
    return hooks.score_nli(pairs).select("fact1_id", "fact2_id", "contradiction_score")


def _found_sql(pairs: str, method: str) -> str:
    return f"""{pairs} SELECT least(a.id, b.id) AS fact1_id, greatest(a.id, b.id) AS fact2_id, max({_nli_sql('a', 'b')}) AS contradiction_score, TIMESTAMP '{NOW}' AS detected_at, TIMESTAMP '{NOW}' AS updated_at, '{method}' AS detection_method
        FROM pairs JOIN facts_fx a ON a.id = pairs.fact1_id JOIN facts_fx b ON b.id = pairs.fact2_id GROUP BY 1, 2"""


_CHECKED = f"c AS (SELECT f.id, f.embedding FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id WHERE is_original AND f.created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY)"
_BASELINE = f"base AS (SELECT f.id FROM facts_fx f JOIN articles_fx a ON a.id = f.article_id WHERE trust_score >= 0.8 AND f.created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND is_original ORDER BY f.created_at DESC, f.id LIMIT 500)"


@query(_found_sql(f"""WITH {_CHECKED}, n AS (SELECT a.id, b.id AS neighbor_id, {DIST} AS dist FROM c a JOIN facts_fx b ON a.id <> b.id AND b.is_original WHERE {DIST} BETWEEN 0.05 AND 0.65),
    pairs AS (SELECT id AS fact1_id, neighbor_id AS fact2_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), neighbor_id) AS r FROM n) WHERE r <= 10)""", "band"))
def detect_contradictions(s, d):
    return contradictions.detect(fx.facts(s, d), fx.articles(s, d), NOW, high=0.65, least=0.05)


@query(_found_sql(f"WITH {_CHECKED}, {_BASELINE}, pairs AS (SELECT c.id AS fact1_id, base.id AS fact2_id FROM c JOIN base ON c.id <> base.id)", "cross"))
def detect_contradictions_cross(s, d):
    return contradictions.detect(fx.facts(s, d), fx.articles(s, d), NOW, candidates="cross", least=0.05)


@query("SELECT id::VARCHAR AS id, 'ORPHANED' AS type, 'HIGH' AS severity FROM facts_fx WHERE id % 3 <> 0 AND id % 5 = 0 UNION ALL SELECT id::VARCHAR, 'MISSING', 'MEDIUM' FROM facts_fx WHERE id % 3 = 0 AND id % 5 <> 0")
def consistency_diff(s, d):
    f = fx.facts(s, d).select("id")
    return consistency.consistency_diff(f.where("id % 5 = 0"), f.where("id % 3 = 0"))


@query("SELECT DISTINCT type AS id, 'UNEXPECTED_RELATIONSHIP_TYPE' AS type, 'MEDIUM' AS severity FROM edges_fx WHERE type NOT IN ('ASSERTED', 'CONTRADICTS')")
def unexpected_types(s, d):
    return consistency.unexpected_types(fx.edges(s, d))


@query(f"SELECT (SELECT count(*) FROM facts_fx WHERE NOT (is_original AND checked_at IS NOT NULL)) + 1 + (SELECT count(*) FROM facts_fx WHERE is_original AND checked_at IS NOT NULL AND {STATEMENT} = '') AS total, 0::BIGINT AS critical, (SELECT count(*) FROM facts_fx WHERE is_original AND checked_at IS NOT NULL AND {STATEMENT} = '') AS high")
def consistency_report(s, d):
    f = fx.facts(s, d)
    v = graph.build_vertices(fx.articles(s, d), gates.gate_facts(f))
    return consistency.issue_summary(consistency.consistency_report(v, fx.edges(s, d), f))


# ---------------------------------------------------------------- streams


def _events(s: SparkSession, d: str, files: int | None = None) -> DataFrame:
    rows = streams.read_files(s, f"{d}/events.parquet", fx.table(s, d, "events").schema, files)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, user_id FROM events) GROUP BY ALL")
def stream_ingest_dedup(s, d):
    out = streams.run_available(streams.ingest_dedup(_events(s, d).select("event_id", "ts", "event_type", "user_id"), ["event_id"], "ts", "1 hour"))
    return out.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_rates_tumbling(s, d):
    return _plain_time(streams.complete(streams.rates(_events(s, d), "ts", ["event_type"], "30 minutes")).select("start", "event_type", "n", F.round("total", 4).alias("total")))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, count(*) AS n FROM events, range(24) r(k) GROUP BY ALL""")
def stream_rates_sliding(s, d):
    return _plain_time(streams.complete(streams.rates(_events(s, d), "ts", [], "1 day", "1 hour")).select("start", "n"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_rates_session(s, d):
    return _plain_time(streams.complete(streams.session_rates(_events(s, d), "ts", ["user_id"], "30 minutes")).select("start", "user_id", "n"))


@query("""SELECT article_id, CASE WHEN status = 'PENDING' AND article_id IN (SELECT user_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events)) THEN 'SCRAPED'
    WHEN status = 'SCRAPED' AND article_id IN (SELECT user_id FROM events WHERE event_type IN (SELECT max(event_type) FROM events)) THEN 'CLASSIFIED' ELSE status END AS status, attempts FROM queue_fx""")
def stream_queue_state(s, d):
    e = fx.table(s, d, "events").agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    rows = _events(s, d).select(F.col("user_id").alias("article_id"), F.when(F.col("event_type") == e["lo"], "SCRAPED").when(F.col("event_type") == e["hi"], "CLASSIFIED").alias("stage"))
    return streams.queue_state(rows.where("stage IS NOT NULL"), fx.queue(s, d))


@query("SELECT user_id, count(*) AS n FROM events JOIN queue_fx ON article_id = user_id GROUP BY user_id")
def stream_new_vs_baseline(s, d):
    base = fx.queue(s, d).select(F.col("article_id").alias("user_id"), "status")
    out = streams.run_available(streams.new_vs_baseline(_events(s, d).select("event_id", "user_id"), base, "user_id"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT event_id, ts, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS window_end FROM events), b AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM m WHERE event_id % 2 = 0)
    SELECT count(*) FILTER (event_id % 2 = 0 OR window_end > mark) AS on_time, count(*) FILTER (event_id % 2 = 1 AND window_end <= mark) AS late FROM m, b""")
def late_data(s, d):
    e = fx.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    arrivals, folder = staging.new_dir(s, "arrivals"), staging.new_dir(s, "late")
    for part in (0, 1):  # the second half arrives after the whole first half
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(arrivals)
        found = streams.late_rows(streams.read_files(s, f"{arrivals}/*.parquet", e.schema), "ts", "30 minutes", "1 hour", folder)
    return found.agg(F.sum("counted").alias("on_time"), F.sum(F.col("arrived") - F.col("counted")).alias("late"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_durable_ingest(s, d):
    empty = s.createDataFrame([], "user_id long, event_id long")
    return streams.durable_ingest(_events(s, d).select("user_id", "event_id"), empty, ["user_id"], "event_id")


# ---------------------------------------------------------------- set operations and counters


@query("SELECT id FROM facts_fx WHERE id % 2 = 0 AND id % 3 <> 0")
def except_ids(s, d):
    f = fx.facts(s, d).select("id")
    return f.where("id % 2 = 0").subtract(f.where("id % 3 = 0"))


@query("SELECT DISTINCT subject FROM facts_fx")
def distinct_rows(s, d):
    return fx.facts(s, d).select("subject").distinct()


@query("SELECT ingestion_source, count(*) AS n, count(*) FILTER (processed_at IS NULL) AS waiting FROM articles_fx GROUP BY 1")
def run_counters(s, d):
    return fx.articles(s, d).groupBy("ingestion_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("processed_at").isNull()).alias("waiting"))


# urls repeat: inserted is the first row of each url that no old row has, and every row without a url
@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM articles_fx), k AS (SELECT ingestion_source, (r = 1 OR url IS NULL) AND NOT EXISTS (SELECT 1 FROM articles_fx o WHERE o.id % 2 = 0 AND o.url = f.url) AS new FROM f)
    SELECT ingestion_source, count(*) AS found, count(*) FILTER (new) AS inserted, count(*) FILTER (NOT new) AS known FROM k GROUP BY 1""")
def insert_counters(s, d):
    a = fx.articles(s, d).select("id", "url", "ingestion_source")
    return tables.insert_counters(a.where("id % 2 = 0"), a, ["url"], [F.col("id")], "ingestion_source")


# a dump made of all pages: some lines are cut short, some have few mentions, some no address, some urls come twice
@query("""WITH l AS (SELECT page_id, CASE WHEN page_id % 13 = 5 THEN NULL ELSE page_id % 23 END AS mentions, CASE WHEN page_id % 17 = 3 THEN 'BBC' ELSE 'http://e.example/' || (page_id // 2) END AS url, page_id % 11 = 7 AS short FROM pages),
    k AS (SELECT *, CASE WHEN short OR mentions IS NULL THEN 'malformed' WHEN mentions < 10 THEN 'skipped' WHEN NOT starts_with(url, 'http') THEN 'other' ELSE 'accepted' END AS kind FROM l),
    t AS (SELECT DISTINCT 'http://e.example/' || page_id AS url FROM pages WHERE page_id % 3 = 0), i AS (SELECT count(DISTINCT url) AS inserted FROM k WHERE kind = 'accepted' AND url NOT IN (SELECT url FROM t))
    SELECT count(*) AS read, count(*) FILTER (kind = 'malformed') AS malformed, count(*) FILTER (kind = 'skipped') AS skipped, count(*) FILTER (kind = 'other') AS other,
    any_value(inserted) AS inserted, count(*) FILTER (kind = 'accepted') - any_value(inserted) AS known FROM k, i""")
def ingest_counters(s, d):
    pages, folder = fx.table(s, d, "pages").select("page_id"), staging.new_dir(s, "events")
    mentions = F.expr("IF(page_id % 13 = 5, 'none', string(page_id % 23))")
    url = F.expr("IF(page_id % 17 = 3, 'BBC', concat('http://e.example/', page_id div 2))")
    fields = F.concat(F.array_repeat(F.lit("x"), 31), F.array(mentions), F.when(F.expr("page_id % 11 = 7"), F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("y"), 20)), F.array(url))
    pages.select(F.array_join(fields, "\t").alias("value")).write.text(f"{folder}/dump")
    target = pages.where("page_id % 3 = 0").select(F.concat(F.lit("http://e.example/"), "page_id").alias("url"))
    return counters.one_row(s, counters.ingest_event_dump(s, f"{folder}/dump", target, folder))


@query("SELECT count(DISTINCT embedding) AS new, count(*) - count(DISTINCT embedding) AS duplicate FROM facts_fx")
def dedup_counters(s, d):
    f = fx.facts(s, d)
    return counters.one_row(s, counters.write_deduplicated(f, similarity.dedup_facts(f, 1e-6), staging.new_dir(s, "facts")))


@query("SELECT count(*) AS found, count(*) FILTER (src % 20 <> 0) AS new, count(*) FILTER (src % 20 = 0) AS updated FROM edges_fx WHERE type = 'CONTRADICTS'")
def contradiction_counters(s, d):
    e = fx.edges(s, d).where("type = 'CONTRADICTS'").selectExpr("src AS fact1_id", "dst AS fact2_id")
    return counters.one_row(s, counters.write_contradictions(e, e.where("fact1_id % 20 = 0"), staging.new_dir(s, "pairs")))


@query("SELECT id, subject, predicate, object, confidence FROM facts_fx ORDER BY confidence DESC, id LIMIT 20")
def page_bounds(s, d):
    return graph.list_facts(fx.facts(s, d), *graph.page_bounds(500, -3, strict=False))
