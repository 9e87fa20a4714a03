"""Queries on documents, pages, benchmark items and events as notes, searches and lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.functions import text as ft
from barlight.operators import index, lifecycle, redact, search, summary
from barlight.plans.bar_queries import table
from barlight.sources import notes as note_source
from barlight.sources.scratch import materialise, scratch_path

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: the first 40 characters are the title, lang and source the keywords."""
    return docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("lang").alias("description"), F.array("lang", "source").alias("keywords"),
        F.col("text").alias("body"), (F.col("doc_id") % 100 / 100.0).alias("importance"), F.col("doc_id").alias("modified_at"),
    )


TOKEN = "'" + ft.TOKEN + "'"
TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), {TOKEN})"


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string({TOKENS}, ' '), '')) AS digest FROM documents")
def p12_tokens(spark, sf_dir):
    t = ft.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


SENTENCES = r"""[s FOR s IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split_regex(regexp_replace(coalesce(text, ''), '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n+')] IF s <> '']"""


@query(f"SELECT doc_id, CAST(len({SENTENCES}) AS BIGINT) AS n, md5(coalesce(array_to_string({SENTENCES}, '|'), '')) AS digest FROM documents")
def p13_sentences(spark, sf_dir):
    s = ft.sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


CJK_TEXT = "translate(coalesce(text, ''), 'abcdefghij', '一二三四五六七八九十')"
EXPANDED = f"""array_to_string([CASE WHEN regexp_matches(p, '^[{ft.CJK}]') THEN array_to_string(list_concat([p[i] FOR i IN range(1, len(p) + 1)], [p[i:i + 1] FOR i IN range(1, len(p))]), ' ') ELSE p END
  FOR p IN regexp_extract_all({CJK_TEXT}, '[{ft.CJK}]+|[^{ft.CJK}]+')], '')"""


@query(f"""WITH x AS (SELECT doc_id, {EXPANDED} AS e FROM documents) SELECT doc_id, CAST(length(e) AS INTEGER) AS n_chars, md5(coalesce(array_to_string(regexp_extract_all(lower(e), '[a-z0-9_]{{2,}}|[{ft.CJK}]+'), ' '), '')) AS digest FROM x""")
def p14_cjk_expansion(spark, sf_dir):
    """Texts with ten letters turned into CJK characters, so that there are runs to expand."""
    t = F.translate("text", "abcdefghij", "一二三四五六七八九十")
    return docs(spark, sf_dir).select("doc_id", F.length(ft.expand_cjk(t)).alias("n_chars"), F.md5(F.array_join(ft.search_tokens(t), " ")).alias("digest"))


@query(f"""WITH x AS (SELECT doc_id, {EXPANDED} AS e FROM documents), j AS (SELECT doc_id, regexp_replace(regexp_replace(e, '([{ft.CJK}])\\s+([{ft.CJK}])', '\\1\\2', 'g'), '([{ft.CJK}])\\s+([{ft.CJK}])', '\\1\\2', 'g') AS e FROM x),
p AS (SELECT doc_id, list_transform(regexp_extract_all(e, '[{ft.CJK}]+|[^{ft.CJK}]+'), lambda p: CASE WHEN regexp_matches(p, '^[{ft.CJK}]') AND length(p) > 3 AND p = p[:(length(p) + 2) // 3] || array_to_string([p[i:i + 1] FOR i IN range(1, (length(p) + 2) // 3)], '') THEN p[:(length(p) + 2) // 3] ELSE p END) AS ps FROM j)
SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(array_to_string(ps, ''), ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM p""")
def p14_cjk_display(spark, sf_dir):
    """The same texts, expanded and turned back for display."""
    t = F.translate("text", "abcdefghij", "一二三四五六七八九十")
    return docs(spark, sf_dir).select("doc_id", F.md5(ft.display_cjk(ft.expand_cjk(t))).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')) AS clean,
  CASE WHEN length(text) <= 8000 THEN length(text) ELSE 8000 END AS kept_chars, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '[^a-z0-9_\-""" + ft.SCRIPTS + """]', '', 'g')) AS slug FROM documents""")
def p15_sanitize(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(ft.sanitized(t)).alias("clean"), F.length(ft.truncated(t)).cast("long").alias("kept_chars"), F.md5(ft.slug(t)).alias("slug"))


STRIPPED = r"regexp_replace(lower({}), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, left(sha256({STRIPPED.format('source')} || '|' || {STRIPPED.format('lang')} || '|' || {STRIPPED.format('text')}), 12) AS hash FROM documents")
def p16_content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ft.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("hash"))


IMPORTANCE = "greatest(0.0, least(1.0, doc_id % 10 / 10.0 * (exp(-0.6931471805599453 / 14 * (doc_id % 60)) + least(0.3, 0.1 * (doc_id % 5)))))"


@query(f"SELECT doc_id, round({IMPORTANCE}, 9) AS importance FROM documents")
def p17_importance(spark, sf_dir):
    made = ft.importance(F.col("doc_id") % 10 / 10.0, F.col("doc_id") % 60, F.col("doc_id") % 5)
    return docs(spark, sf_dir).select("doc_id", F.round(made, 9).alias("importance"))


@query("SELECT conv_id, turn, CAST(length(CAST(to_json({'role': role, 'text': text || CASE WHEN turn % 3 = 0 THEN '\"a\\b\"' ELSE '' END}) AS VARCHAR)) // 4 AS BIGINT) AS tokens FROM conversations")
def p18_token_estimate(spark, sf_dir):
    """All messages, every third with quotes and a backslash at its end."""
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, '"a\\b"').otherwise("")).alias("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ft.json_estimate(F.to_json(F.struct("role", text))).alias("tokens"))


CODES = "upper(s_name) || CASE s_suppkey % 4 WHEN 0 THEN '-USD' WHEN 1 THEN '.N' WHEN 2 THEN '/EUR' ELSE '' END"


@query(f"""WITH s AS (SELECT s_suppkey, replace({CODES}, '#', '') AS c FROM supplier)
SELECT s_suppkey, upper(trim(c)) AS symbol, CASE WHEN regexp_matches(c, '[-/.]') THEN 'structured_entity' ELSE 'generic_entity' END AS domain,
  CASE s_suppkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'N' WHEN 2 THEN 'EUR' END AS unit, s_suppkey % 4 <> 3 AS conflicts FROM s""")
def p19_symbols(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    tail = F.when(F.col("s_suppkey") % 4 == 0, "-usd").when(F.col("s_suppkey") % 4 == 1, ".n").when(F.col("s_suppkey") % 4 == 2, "/eur").otherwise("")
    # Names carry a dash-free number: the separators are the ones added here.
    name = F.replace("s_name", F.lit("#"), F.lit(""))
    code = F.concat(F.lit(" "), name, tail)
    return s.select("s_suppkey", ft.normal_symbol(code).alias("symbol"), ft.symbol_domain(code).alias("domain"), ft.symbol_unit(code).alias("unit"), ft.alias_conflict(code, name).alias("conflicts"))


LINKED = "text || ' [[' || left(md5(CAST(doc_id % 7 AS VARCHAR)), 6) || ']] [[' || left(md5(CAST(doc_id % 3 AS VARCHAR)), 6) || ']] [[' || left(md5(CAST(doc_id % 7 AS VARCHAR)), 6) || ']]'"


@query(f"""WITH x AS (SELECT doc_id, regexp_extract_all({LINKED}, '\\[\\[([0-9a-f]{{6}})\\]\\]', 1) AS l FROM documents)
SELECT doc_id, array_to_string([v FOR v, i IN l IF list_position(l, v) = i], ',') AS links FROM x""")
def p20_wikilinks(spark, sf_dir):
    mark = lambda m: F.concat(F.lit(" [["), F.left(F.md5((F.col("doc_id") % m).cast("string")), F.lit(6)), F.lit("]]"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(ft.wikilinks(F.concat("text", mark(7), mark(3), mark(7))), ",").alias("links"))


@query(r"""WITH c AS (SELECT o_orderkey, 'On ' || strftime(o_orderdate, '%Y-%m-%d') || ' order ' || o_orderkey || ' paid ' || printf('%.2f', o_totalprice) || ' plus 1,234 and 7% tax' AS t FROM orders)
SELECT o_orderkey, o_orderkey || '.00;' || regexp_extract(t, 'paid ([0-9.]+)', 1) || ';1234.00' AS numbers FROM c""")
def p21_numbers(spark, sf_dir):
    """All numbers of a sentence on each order, with a date and a percentage that are none."""
    o = table(spark, sf_dir, "orders")
    t = F.format_string("On %s order %d paid %.2f plus 1,234 and 7%% tax", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), "o_orderkey", "o_totalprice")
    shown = F.array_join(F.transform(ft.numbers(t), lambda n: F.format_string("%.2f", n)), ";")
    return o.select("o_orderkey", shown.alias("numbers"))


RESULTS = """CASE event_id % 5 WHEN 0 THEN '{"status": "Failed"}' WHEN 1 THEN '{"ok": false, "n": 1}' WHEN 2 THEN props WHEN 3 THEN '{"status": "done", "success": true}' ELSE 'plain text' END"""


@query("SELECT event_id, event_id % 5 NOT IN (0, 1) AS succeeded FROM events")
def p22_tool_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", ft.tool_succeeded(F.expr(RESULTS)).alias("succeeded"))


DELIVERABLES = """CASE doc_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN text || ' <tool_sep> ' WHEN 2 THEN text || ' based on Mock Data only' WHEN 3 THEN '{"status": "ok", "content": "x"}' WHEN 4 THEN '## Plan' || chr(10) || 'do it' ELSE text END"""


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'empty deliverable' WHEN 1 THEN 'unparsed tool-call markup (provider did not parse tool calls)' WHEN 2 THEN 'explicitly fabricated / mock data'
  WHEN 3 THEN 'raw tool-result envelope, not analysis' WHEN 4 THEN 'plan-only stub (no executed analysis / conclusion)' WHEN 5 THEN 'data agent produced no tool calls and no report.md' END AS fault FROM documents""")
def p23_deliverables(spark, sf_dir):
    d = docs(spark, sf_dir)
    data_agent = F.col("doc_id") % 7 == 5
    return d.select("doc_id", ft.deliverable_fault(F.expr(DELIVERABLES), data_agent, F.lit(False), F.lit(0)).alias("fault"))


OTHERS = ft.RESPONSE_TEXTS[1:]


@query(f"""WITH t AS (SELECT *, translate(text, chr(9) || chr(10) || chr(13) || '\\"', '     ') || CASE WHEN doc_id % 3 = 0 THEN ' "a\\b"' ELSE '' END AS title FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN title ELSE replace(replace(title, '\\', '\\\\'), '"', '\\"') END AS title,
  {", ".join(f"CASE WHEN doc_id % {i + 2} > 0 THEN '{k} in ' || lang || ' from ' || source END AS {k}" for i, k in enumerate(OTHERS))}, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS predicted_sign FROM t""")
def p11_response_fields(spark, sf_dir):
    """All twelve fields of answers with whole texts, some fields missing: in fences with a trailing comma (even ids), or with an unescaped line that no parser takes, whose text stays as
    it was written (odd ids)."""
    d = docs(spark, sf_dir)
    title = F.concat(F.translate("text", "\t\n\r\\\"", "     "), F.when(F.col("doc_id") % 3 == 0, ' "a\\b"').otherwise(""))
    title = F.replace(F.replace(title, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rest = F.concat(*[F.when(F.col("doc_id") % (i + 2) > 0, F.format_string(f'"{k}": "{k} in %s from %s", ', "lang", "source")).otherwise("") for i, k in enumerate(OTHERS)])
    good = F.concat(F.lit('Here: ```json\n{'), rest, F.lit('"title": "'), title, F.lit('", "predicted_sign": 1,}\n```'))
    bad = F.concat(F.lit("{"), rest, F.lit('"title": "'), title, F.lit('" and more, "predicted_sign": -1'))
    f = ft.response_fields(F.when(F.col("doc_id") % 2 == 0, good).otherwise(bad))
    return d.select("doc_id", *[c.alias(k) for k, c in f.items()])


@query("""WITH p AS (SELECT doc_id, lower(text) || CASE WHEN doc_id % 4 = 0 THEN ' Place Order with Real Money' ELSE '' END AS t FROM documents)
SELECT doc_id, array_to_string([w FOR w IN [""" + ", ".join(f"'{w}'" for w in ft.TRADING_INTENT) + """] IF contains(lower(t), w)], ',') AS phrases FROM p""")
def f8_trading_intent(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " Place Order with Real Money").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", F.array_join(ft.intent_phrases(t), ",").alias("phrases"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'BTCUSDT,ETHUSDT' ELSE '' END AS listed, CASE WHEN doc_id % 3 = 0 THEN 'BTCUSDT' ELSE '' END AS generic FROM documents")
def f9_symbol_mentions(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.lit(" BTCUSDT over ethusdt, XBTCUSDTX by OHLCV")).otherwise(F.lit(" none"))
    text = F.concat(F.lower("text"), said)
    listed = ft.listed_symbols(text, ["BTC", "BTCUSDT", "ETHUSDT"])
    generic = F.filter(ft.generic_symbols(text), lambda s: s == "BTCUSDT")
    return docs(spark, sf_dir).select("doc_id", F.array_join(listed, ",").alias("listed"), F.array_join(generic, ",").alias("generic"))


COMMON = ["THE", "LICENSE", "LICENSED", "WORK", "VERSION", "IS", "AN", "AND"]


@query(r"SELECT doc_id, array_to_string([upper(x) FOR x IN regexp_extract_all(text, '(?i)\b(?:" + "|".join(sorted(COMMON, key=len, reverse=True)) + r")\b')], ',') AS listed FROM documents")
def f9_listed_symbols(spark, sf_dir):
    """Every mention of a list in the whole texts, in order."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(ft.listed_symbols(F.col("text"), COMMON), ",").alias("listed"))


@query()
def f9_generic_symbols(spark, sf_dir):
    """Codes in the whole texts as they are written; a test compares them with a scan character by character."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(ft.generic_symbols(F.col("text")), ",").alias("symbols"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(?:" + "|".join(ft.ACTIONS) + r")\b') AS actionable, regexp_matches(text, '(?i)\b(?:" + "|".join(ft.NUMERIC) + r")\b') AS numeric FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' Get the closing price' ELSE '' END AS text FROM documents)")
def f10_query_kinds(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " Get the closing price").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", ft.mentions(t, ft.ACTIONS).alias("actionable"), ft.mentions(t, ft.NUMERIC).alias("numeric"))


# ---- search and similarity ----

POSTED = f"""
tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc_id, len({TOKENS}) AS dl FROM documents),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, sum(dl) AS words, avg(dl) AS mean FROM dl)"""


@query(f"WITH {POSTED} SELECT d.term, d.n, round(ln((docs - n + 0.5) / (n + 0.5) + 1), 9) AS idf, round(ln(docs / (1 + n)), 9) AS sentence_idf FROM df d, total")
def g5_g7_document_frequency(spark, sf_dir):
    d = docs(spark, sf_dir)
    df = search.document_frequency(search.postings(d, ft.tokens(F.col("text"))))
    n_docs = F.broadcast(d.agg(F.count("*").alias("docs")))
    return df.join(n_docs, F.lit(True)).select("term", "n", F.round(search.idf(F.col("docs"), F.col("n")), 9).alias("idf"), F.round(F.log(F.col("docs") / (1 + F.col("n"))), 9).alias("sentence_idf"))


@query(f"WITH {POSTED} SELECT doc_id, term, tf FROM tf")
def g6_term_frequency(spark, sf_dir):
    return search.postings(docs(spark, sf_dir), ft.tokens(F.col("text")))


SIMILAR = POSTED + """,
asked AS (SELECT t.doc_id AS src, t.term, ln((docs - 1 - (n - 1) + 0.5) / (n - 1 + 0.5) + 1) AS idf, (words - dl) / (docs - 1) AS mean FROM tf t JOIN df USING (term) JOIN dl USING (doc_id), total WHERE t.doc_id % 50 = 0),
scores AS (SELECT src, t.doc_id AS dst, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM asked JOIN tf t USING (term) JOIN dl ON dl.doc_id = t.doc_id WHERE src <> t.doc_id GROUP BY 1, 2),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM scores WHERE score >= 0.3) WHERE rank <= 5)"""


@query(f"WITH {SIMILAR} SELECT src, dst, round(score, 4) AS score, rank FROM links")
def a9_similar_notes(spark, sf_dir):
    """J3 and K6: every document whose id is divisible by 50 against all others."""
    return search.similar(docs(spark, sf_dir), F.col("doc_id") % 50 == 0).withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


WORDS = "[a-z0-9_]{2,}"
SEARCH = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{WORDS}')) AS dl FROM documents),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, avg(dl) AS mean FROM dl),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM benchmark),
scores AS (SELECT query_id, t.doc_id, round(sum(ln((docs - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM asked JOIN tf t USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = t.doc_id, total GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 5)"""


def plain_tokens(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


@query(f"WITH {SEARCH} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits")
def t1_full_text_search(spark, sf_dir):
    """Every benchmark item as a query; the best five documents."""
    return search.search(docs(spark, sf_dir), asked(spark, sf_dir), plain_tokens).withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


@query()
def t1_snippets(spark, sf_dir):
    """The best five documents of every query with the matches marked around the first one; Chinese, Japanese and Korean signs by themselves and in pairs."""
    d, q = docs(spark, sf_dir), asked(spark, sf_dir)
    return search.snippets(search.search(d, q, ft.search_tokens), q, d, ft.search_tokens).select("query_id", "doc_id", "rank", "snippet")


@query(f"""WITH {SEARCH}, words AS (SELECT query_id, '(?i)\\b(' || string_agg(term, '|' ORDER BY length(term) DESC, term DESC) || ')\\b' AS pattern FROM asked GROUP BY 1),
met AS (SELECT h.query_id, h.doc_id, h.rank, d.lang, d.text, w.pattern, length(regexp_extract(d.text, '(?s)^(.*?)' || w.pattern, 1)) AS first FROM hits h JOIN words w USING (query_id) JOIN documents d ON d.doc_id = h.doc_id)
SELECT query_id, doc_id, rank, lang, regexp_replace(substr(text, greatest(first + 1 - 20, 1), 120), pattern, '>>>\\1<<<', 'g') AS snippet FROM met""")
def j2_hits_with_content(spark, sf_dir):
    """Every hit joined to its document, in the order of ranks: language, and the text around the first match."""
    d, q = docs(spark, sf_dir), asked(spark, sf_dir)
    found = search.snippets(search.search(d, q, plain_tokens), q, d, plain_tokens, lang="lang")
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "lang", "snippet")


def changed_sql(where: str) -> str:
    """SEARCH over the texts that an index holds after its changes."""
    return SEARCH.replace("FROM documents", "FROM held").replace("\ntok AS", f"\nheld AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN lang || ' ' || reverse(text) ELSE text END AS text FROM documents WHERE {where}),\ntok AS", 1)


def changed_index(spark: SparkSession, sf_dir: str) -> str:
    """An index of half of the documents that then gets the rest, loses every eleventh, and has every seventh replaced by its text backwards."""
    path, d = scratch_path(spark, "index"), docs(spark, sf_dir)
    index.rebuild(d.where("doc_id % 2 = 0"), path, plain_tokens)
    index.upsert(d.where("doc_id % 2 = 1"), path, plain_tokens)
    index.remove(d.where("doc_id % 11 = 5").select("doc_id"), path)
    backwards = d.where("doc_id % 7 = 3 and doc_id % 11 <> 5").select("doc_id", F.concat_ws(" ", "lang", F.reverse("text")).alias("text"))
    index.upsert(backwards, path, plain_tokens)
    return path


@query(f"WITH {changed_sql('doc_id % 11 <> 5')} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits")
def t1_index_after_changes(spark, sf_dir):
    """Every benchmark item asked of an index with four segments."""
    found = index.search(changed_index(spark, sf_dir), asked(spark, sf_dir), plain_tokens)
    return found.withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {changed_sql('doc_id % 11 <> 5')} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits")
def t1_merged_index(spark, sf_dir):
    """The same after the segments are merged into one."""
    path = changed_index(spark, sf_dir)
    index.merge(spark, path)
    found = index.search(path, asked(spark, sf_dir), plain_tokens)
    return found.withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


RECALL = f"""
terms AS (SELECT DISTINCT doc_id AS id, 2 AS w, 0 AS field, unnest(regexp_extract_all(lower(left(text, 40) || ' ' || lang), {TOKEN})) AS term FROM documents
  UNION ALL SELECT DISTINCT doc_id, 2, 1, unnest(regexp_extract_all(lower(lang || ' ' || source), {TOKEN})) FROM documents
  UNION ALL SELECT DISTINCT doc_id, 1, 2, unnest({TOKENS}) FROM documents),
wanted AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
recalled AS (SELECT query_id, id, round(sum(w) * (0.5 + 0.5 * (id % 100 / 100.0)), 6) AS score FROM terms JOIN wanted USING (term) GROUP BY 1, 2),
recall AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM recalled) WHERE rank <= 5)"""


@query(f"WITH {RECALL} SELECT query_id, id, score, rank FROM recall")
def t2_weighted_recall(spark, sf_dir):
    return search.recall(notes(spark, sf_dir), asked(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {SEARCH}, {RECALL} SELECT query_id, doc_id AS id, rank, 'index' AS via FROM hits WHERE query_id % 3 <> 0 UNION ALL SELECT query_id, id, rank, 'scan' FROM recall WHERE query_id % 3 = 0")
def t3_recall_chain(spark, sf_dir):
    """Index hits; queries without (here every third is kept from the index) fall back to the scan."""
    q = asked(spark, sf_dir)
    first = search.search(docs(spark, sf_dir), q.where("query_id % 3 <> 0"), plain_tokens).withColumnRenamed("doc_id", "id")
    missed = q.join(first.select("query_id").distinct(), "query_id", "left_anti")
    out = search.with_fallback(first, search.recall(notes(spark, sf_dir), missed), q)
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "via")


@query(f"""WITH {RECALL}, {SIMILAR.replace('tok AS', 'tok AS')},
seed AS (SELECT query_id, id, rank FROM recall WHERE rank <= 3 OR id % 50 = 0),
linked AS (SELECT query_id, dst AS id, min((s.rank, l.rank)) AS spot FROM seed s JOIN links l ON l.src = s.id GROUP BY 1, 2),
fresh AS (SELECT * FROM linked l WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.query_id = l.query_id AND s.id = l.id)),
both_ AS (SELECT query_id, id, 0 AS level, rank AS a, 0 AS b FROM seed UNION ALL SELECT query_id, id, 1, spot[1], spot[2] FROM fresh)
SELECT query_id, id, place, level = 1 AS linked FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, a, b, id) AS place FROM both_) WHERE place <= 5""")
def a8_recall_with_links(spark, sf_dir):
    """J4: recalled notes and the notes linked to them, five in all; links of notes that are not recalled cannot appear, so only recalled ones are searched for, against all."""
    hits = materialise(search.recall(notes(spark, sf_dir), asked(spark, sf_dir)).where("rank <= 3 or id % 50 = 0"), "recalled")
    links = search.similar(docs(spark, sf_dir), F.col("doc_id") % 50 == 0, among=hits.select(F.col("id").alias("doc_id")))
    return search.expand(hits, links).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH a AS (SELECT d.doc_id, b.item_id, list_distinct(regexp_extract_all(lower(d.text), {TOKEN})) AS x, list_distinct(regexp_extract_all(lower(b.text), {TOKEN})) AS y FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, item_id, CAST(len(list_intersect(x, y)) AS BIGINT) AS shared, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM a""")
def k12_token_sets(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    j = docs(spark, sf_dir).withColumn("item_id", F.col("doc_id") % b.count()).join(b, "item_id")
    x, y = F.array_distinct(ft.tokens(F.col("text"))), F.array_distinct(ft.tokens(F.col("item")))
    return j.select("doc_id", "item_id", F.size(F.array_intersect(x, y)).cast("long").alias("shared"), F.round(search.jaccard(x, y), 9).alias("jaccard"))


@query(f"""WITH {SEARCH}, {RECALL} SELECT query_id, doc_id AS id, rank, 'index' AS via FROM hits
UNION ALL SELECT query_id, id, rank, 'scan' FROM recall WHERE query_id NOT IN (SELECT query_id FROM hits)""")
def t3_rebuilt_chain(spark, sf_dir):
    """The chain that finds its index empty (all documents were removed), builds it once and asks it again."""
    path, d, q = scratch_path(spark, "index"), docs(spark, sf_dir), asked(spark, sf_dir)
    index.upsert(d, path, plain_tokens)
    index.remove(d.select("doc_id"), path)
    out = index.search_chain(path, q, d, plain_tokens, lambda missed: search.recall(notes(spark, sf_dir), missed))
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "via")


# ---- summaries ----

SCORED = f"""
s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
p AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos, len(ss) AS n FROM s),
w AS (SELECT doc_id, pos, n, unnest(regexp_extract_all(lower(sentence), {TOKEN})) AS term FROM p),
k AS (SELECT doc_id, pos, n, term, count(*) AS k FROM w GROUP BY ALL),
i AS (SELECT *, ln(n / (1 + count(*) OVER (PARTITION BY doc_id, term))) AS idf FROM k),
c AS (SELECT doc_id, pos, sum(k * idf) / sum(k) AS score FROM i GROUP BY 1, 2),
scored AS (SELECT p.doc_id, p.pos, p.n, p.sentence, round(coalesce(score, 0), 9) AS score FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.pos = p.pos)"""


@query(f"WITH {SCORED} SELECT doc_id, CAST(pos AS INTEGER) AS pos, n, round(score, 6) AS score FROM scored")
def t4_sentence_scores(spark, sf_dir):
    return summary.sentence_scores(docs(spark, sf_dir)).select("doc_id", "pos", "n", F.round("score", 6).alias("score"))


@query(f"""WITH {SCORED}, r AS (SELECT *, pos = 0 OR pos = n - 1 AS edge, row_number() OVER (PARTITION BY doc_id, pos = 0 OR pos = n - 1 ORDER BY score DESC, pos) AS r FROM scored),
kept AS (SELECT doc_id, max(n) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS kept, string_agg(sentence, ' ' ORDER BY pos) AS body FROM r WHERE edge OR r <= 5 OR n <= 7 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(kept, '') AS kept, md5('Keywords: ' || lang || ', ' || source || chr(10) || CASE WHEN coalesce(n, 0) <= 7 THEN regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') ELSE body END) AS digest
FROM documents d LEFT JOIN kept USING (doc_id)""")
def t4_summaries(spark, sf_dir):
    made = summary.summaries(docs(spark, sf_dir), F.concat_ws(", ", "lang", "source"))
    return made.select("doc_id", "n_sentences", "kept", F.md5("summary").alias("digest"))


TERMS = f"""
s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
p AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos, len(ss) AS n FROM s),
t AS (SELECT doc_id, n, pos, regexp_extract_all(lower(sentence), {TOKEN}) AS ts FROM p),
w AS (SELECT doc_id, n, pos, unnest(ts) AS term, generate_subscripts(ts, 1) AS spot FROM t),
g AS (SELECT doc_id, term, count(*) AS tf, min((pos, spot)) AS first, round(count(*) * ln(max(n) / (1 + count(DISTINCT pos))), 9) AS score FROM w GROUP BY 1, 2),
terms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS rank FROM g) WHERE rank <= 15)"""


@query(f"WITH {TERMS} SELECT doc_id, term, round(score, 6) AS score, rank FROM terms")
def t5_digest_terms(spark, sf_dir):
    return summary.digest_terms(docs(spark, sf_dir)).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TERMS} SELECT doc_id, 'Key concepts:' || chr(10) || string_agg('  - ' || term, chr(10) ORDER BY rank) AS digest FROM terms GROUP BY doc_id")
def t5_digests(spark, sf_dir):
    return summary.digests(docs(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 50 > 7 THEN 'daily' WHEN doc_id % 3 = 1 AND doc_id % 50 > 30 THEN 'digest' END AS target FROM documents")
def t6_compression_due(spark, sf_dir):
    level = F.when(F.col("doc_id") % 3 == 0, "raw").when(F.col("doc_id") % 3 == 1, "daily").otherwise("digest")
    return docs(spark, sf_dir).select("doc_id", summary.due(level, F.col("doc_id") % 50).alias("target"))


@query(f"""WITH {SCORED}, r AS (SELECT *, pos = 0 OR pos = n - 1 AS edge, row_number() OVER (PARTITION BY doc_id, pos = 0 OR pos = n - 1 ORDER BY score DESC, pos) AS r FROM scored),
kept AS (SELECT doc_id, max(n) AS n, string_agg(sentence, ' ' ORDER BY pos) AS body FROM r WHERE edge OR r <= 5 OR n <= 7 GROUP BY doc_id),
made AS (SELECT d.doc_id, {TOKENS} AS x, regexp_extract_all(lower(CASE WHEN coalesce(n, 0) <= 7 THEN coalesce(d.text, '') ELSE body END), {TOKEN}) AS y FROM documents d LEFT JOIN kept USING (doc_id))
SELECT doc_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1) END, 9) AS retention FROM made""")
def t7_retention(spark, sf_dir):
    """Share of tokens that each summary keeps."""
    j = summary.summarised(docs(spark, sf_dir).select("doc_id", "text"))
    x, y = F.array_distinct(ft.tokens(F.col("text"))), F.array_distinct(ft.tokens(F.col("summary")))
    return j.select("doc_id", F.round(search.jaccard(x, y), 9).alias("retention"))


# ---- lifecycle ----

REINFORCED = """
ev AS (SELECT user_id AS note, ts, event_id, CASE event_id % 5 WHEN 0 THEN 100 WHEN 1 THEN -150 WHEN 2 THEN 200 WHEN 3 THEN -300 ELSE -50 END * CASE WHEN event_id % 2 = 0 THEN 7 ELSE 10 END // 10 AS d FROM events),
l AS (SELECT note, count(*) AS n_events, list_concat([[500::BIGINT, 0, 0]], list([d::BIGINT] ORDER BY ts, event_id)) AS xs FROM ev GROUP BY note),
f AS (SELECT note, n_events, list_reduce(xs, lambda a, x: CASE WHEN abs(a[2] + x[1]) > 500 THEN a ELSE [CAST(10 * round_even(greatest(0, least(1000, a[1] + x[1])) / 10, 0) AS BIGINT), a[2] + x[1], a[3] + 1] END) AS r FROM l)"""


def reinforcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = list(lifecycle.DELTAS)
    e = table(spark, sf_dir, "events")
    event = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("note"), event.alias("event"), F.when(F.col("event_id") % 2 == 0, "system").otherwise("user").alias("source"), "ts", "event_id")


@query(f"WITH {REINFORCED} SELECT note, r[1] / 1000 AS quality, r[2] / 1000 AS session_delta, r[3] AS n_applied, n_events FROM f")
def t9_reinforcement(spark, sf_dir):
    return lifecycle.reinforced(reinforcements(spark, sf_dir))


HOUR = 3_600_000_000


@query(f"""WITH l AS (SELECT user_id AS hash, count(*) AS n_writes, list([epoch_us(ts)] ORDER BY ts) AS xs FROM events GROUP BY user_id),
f AS (SELECT hash, n_writes, list_reduce(xs, lambda a, x: CASE WHEN x[1] - a[len(a)] >= {12 * HOUR} THEN list_append(a, x[1]) ELSE a END) AS kept FROM l)
SELECT hash, n_writes, unnest(kept) AS accepted_at FROM f""")
def k10_duplicate_writes(spark, sf_dir):
    """The 30-second window scaled to 12 hours: these events are minutes apart."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("hash"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return lifecycle.accepted_writes(e, 12 * HOUR)


@query("""WITH w AS (SELECT event_type AS hash, epoch_us(ts) + unnest([0, 9000000, 29999999, 30000000, 45000000, 60000000]) AS ts FROM events),
l AS (SELECT hash, count(*) AS n_writes, list([ts] ORDER BY ts) AS xs FROM w GROUP BY hash),
f AS (SELECT hash, n_writes, list_reduce(xs, lambda a, x: CASE WHEN x[1] - a[len(a)] >= 30000000 THEN list_append(a, x[1]) ELSE a END) AS kept FROM l)
SELECT hash, n_writes, unnest(kept) AS accepted_at FROM f""")
def k10_write_window(spark, sf_dir):
    """The 30-second window itself, over few contents: each event is written again within the minute that follows."""
    at = F.explode(F.array(*[F.unix_micros(F.col("ts").cast("timestamp")) + us for us in (0, 9_000_000, 29_999_999, 30_000_000, 45_000_000, 60_000_000)]))
    return lifecycle.accepted_writes(table(spark, sf_dir, "events").select(F.col("event_type").alias("hash"), at.alias("ts")), 30_000_000)


@query("SELECT user_id AS note, count(*) AS access_count, max(epoch_us(ts)) AS last_access FROM events GROUP BY user_id")
def t10_access(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("note"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return lifecycle.access(e)


@query(f"SELECT doc_id, CASE WHEN doc_id % 30 >= 7 AND {IMPORTANCE} < 0.15 THEN 'archive' END AS action, CASE WHEN doc_id % 30 >= 7 THEN CASE WHEN {IMPORTANCE} < 0.05 THEN 'delete' WHEN {IMPORTANCE} < 0.15 THEN 'archive' END END AS with_delete FROM documents")
def t8_collection(spark, sf_dir):
    made = ft.importance(F.col("doc_id") % 10 / 10.0, F.col("doc_id") % 60, F.col("doc_id") % 5)
    age = F.col("doc_id") % 30
    return docs(spark, sf_dir).select("doc_id", lifecycle.collection(age, made).alias("action"), lifecycle.collection(age, made, delete=True).alias("with_delete"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 30 >= 7 AND {IMPORTANCE} < 0.15 THEN 'archive' WHEN doc_id % 60 > 7 AND doc_id % 2 = 0 THEN 'daily' WHEN doc_id % 60 > 30 AND doc_id % 2 = 1 THEN 'digest' END AS action FROM documents""")
def a10_maintenance(spark, sf_dir):
    """Collection first, then compression of what stays."""
    made = ft.importance(F.col("doc_id") % 10 / 10.0, F.col("doc_id") % 60, F.col("doc_id") % 5)
    level = F.when(F.col("doc_id") % 2 == 0, "raw").otherwise("daily")
    action = F.coalesce(lifecycle.collection(F.col("doc_id") % 30, made), summary.due(level, F.col("doc_id") % 60))
    return docs(spark, sf_dir).select("doc_id", action.alias("action"))


@query(f"""WITH sums AS (WITH {SCORED}, r AS (SELECT *, pos = 0 OR pos = n - 1 AS edge, row_number() OVER (PARTITION BY doc_id, pos = 0 OR pos = n - 1 ORDER BY score DESC, pos) AS r FROM scored)
SELECT doc_id, max(n) AS n, string_agg(sentence, ' ' ORDER BY pos) AS body FROM r WHERE edge OR r <= 5 OR n <= 7 GROUP BY doc_id),
digs AS (WITH {TERMS} SELECT doc_id, 'Context: ' || any_value(lang) || chr(10) || 'Key concepts:' || chr(10) || string_agg('  - ' || term, chr(10) ORDER BY rank) AS digest FROM terms JOIN documents USING (doc_id) GROUP BY doc_id),
acts AS (SELECT doc_id, text, lang, CASE doc_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'daily' ELSE 'digest' END AS level, CASE WHEN doc_id % 30 >= 7 THEN CASE WHEN {IMPORTANCE} < 0.05 THEN 'delete' WHEN {IMPORTANCE} < 0.15 THEN 'archive' END END AS gone,
CASE WHEN doc_id % 60 > 7 AND doc_id % 3 = 0 THEN 'daily' WHEN doc_id % 60 > 30 AND doc_id % 3 = 1 THEN 'digest' END AS target FROM documents)
SELECT a.doc_id, CASE WHEN gone IS NOT NULL THEN gone WHEN target IS NOT NULL THEN 'compress' END AS action, CASE WHEN gone IS NULL THEN coalesce(target, level) ELSE level END AS level, gone IS NULL AND target IS NOT NULL AS has_original,
md5(CASE WHEN gone = 'delete' THEN NULL WHEN gone IS NOT NULL OR target IS NULL THEN a.text WHEN target = 'digest' THEN coalesce(digest, a.text)
ELSE 'Keywords: ' || lang || chr(10) || CASE WHEN coalesce(n, 0) <= 7 THEN regexp_replace(a.text, '^\\s+|\\s+$', '', 'g') ELSE body END END) AS text_md5
FROM acts a LEFT JOIN sums USING (doc_id) LEFT JOIN digs USING (doc_id)""")
def a10_maintained_notes(spark, sf_dir):
    """The pass carried out, with deletion: bodies are replaced by summaries or terms, originals are kept."""
    k = F.col("doc_id")
    level = F.when(k % 3 == 0, "raw").when(k % 3 == 1, "daily").otherwise("digest")
    notes = docs(spark, sf_dir).select("doc_id", "text", level.alias("level"), (k % 30).alias("age_days"), (k % 60).alias("idle_days"), ft.importance(k % 10 / 10.0, k % 60, k % 5).alias("importance"), F.col("lang").alias("keywords"))
    made = lifecycle.maintained(notes, delete=True)
    return made.select("doc_id", "action", "level", F.col("original").isNotNull().alias("has_original"), F.md5("text").alias("text_md5"))


# ---- notes as files, categories ----


@query("""SELECT doc_id AS id, md5('x' || rtrim(replace(replace(text, chr(10), ' '), ':', ' '))) AS title, lang AS category, least(1.0, greatest(0.0, doc_id % 15 / 10.0)) AS quality, CASE WHEN length(text) <= 8000 THEN length(text) ELSE 8000 END AS body_chars,
  'project' AS memory_type, 'raw' AS compression_level, lang || ',' || source AS keywords, doc_id % 9 AS access_count, '' AS description, CAST(0.5 AS DOUBLE) AS importance FROM documents""")
def s9_note_ingest(spark, sf_dir):
    """Documents written as texts with a front-matter header, then read into typed columns."""
    d = docs(spark, sf_dir)
    title = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(":"), F.lit(" "))
    quality = F.format_string("%.1f", F.col("doc_id") % 15 / 10.0)
    raw = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\ntitle: x"), title, F.lit("\ncategory: "), "lang", F.lit("\nkeywords: ["), "lang", F.lit(", "), "source", F.lit("]\nquality_score: "), quality, F.lit("\naccess_count: "), (F.col("doc_id") % 9).cast("string"), F.lit("\n---\n"), "text")
    n = note_source.parse(d.select(raw.alias("value")))
    return n.select(
        F.col("id").cast("long").alias("id"), F.md5("title").alias("title"), "category", F.col("quality_score").alias("quality"), F.length("body").cast("long").alias("body_chars"),
        "memory_type", "compression_level", F.array_join("keywords", ",").alias("keywords"), F.col("access_count").cast("long").alias("access_count"), "description", "importance")


@query("SELECT doc_id, lang AS category, source FROM documents WHERE lang IN ('en', 'fr')")
def s10_category_scan(spark, sf_dir):
    """Notes written by category, then read with the partitions of two of them alone."""
    return note_source.by_category(docs(spark, sf_dir).select("doc_id", "source", F.col("lang").alias("category")), ["en", "fr"]).select("doc_id", "category", "source")


@query("""WITH c(category) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('none')),
k AS (SELECT lang, lower(trim(source)) AS kw, min(doc_id) AS first FROM documents WHERE trim(source) <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first, kw) AS n FROM k)
SELECT category, coalesce((SELECT count(*) FROM documents d WHERE d.lang = category), 0) AS n, coalesce((SELECT string_agg(kw, ',' ORDER BY n) FROM r WHERE r.lang = category AND r.n <= 10), '') AS keywords FROM c""")
def g8_category_rollup(spark, sf_dir):
    """Count and first ten distinct keywords of each of five categories, empty ones too."""
    return note_source.rollup(docs(spark, sf_dir).select(F.col("lang").alias("category"), F.array("source").alias("keywords"), F.col("doc_id").alias("place")), ["en", "de", "fr", "es", "none"])


# ---- redaction ----


@query()
def t11_redact_text(spark, sf_dir):
    r = redact.redact_text(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(r).alias("digest"), (r != F.col("text")).alias("changed"), (F.length("text") - F.length(r)).cast("long").alias("shorter"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k=' || json_extract_string(props, '$.k') ELSE 'k=' || json_extract_string(props, '$.k') END || ';api-Key=[redacted];content=' || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '[redacted]' END AS shown FROM events""")
def t12_redact_maps(spark, sf_dir):
    """Flat JSON with a key that is sensitive and one that is so in arguments alone."""
    e = table(spark, sf_dir, "events")
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("api-Key"), F.lit("abc"), F.lit("content"), F.lit("x")))
    args, result = redact.redact_map(m), redact.redact_map(m, result=True)
    red = F.when(F.col("event_id") % 2 == 0, result).otherwise(args)
    shown = F.concat_ws(";", *[F.concat(F.lit(k + "="), F.try_element_at(red, F.lit(k))) for k in ("k", "api-Key", "content")])
    return e.select("event_id", shown.alias("shown"))


@query()
def t12_redact_nested(spark, sf_dir):
    """JSON of unknown depth."""
    e = table(spark, sf_dir, "events")
    nested = F.concat(F.lit('{"run": {"stdout": "token = abcdef123456", "args": [{"password": "x"}, '), "props", F.lit("]}}"))
    return e.select("event_id", redact.redact_json(nested).alias("redacted"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS rest FROM pages)
SELECT page_id, CASE WHEN rest = '' OR starts_with(rest, '/') THEN '<path>' || rest ELSE '<path>/store' || rest END AS shown FROM p""")
def t13_redact_paths(spark, sf_dir):
    """Every page's address as a path under the inner of two roots; what has no separator after it is under the outer one."""
    p = table(spark, sf_dir, "pages")
    root = F.regexp_extract("url", "^https?://[^/]*", 0)
    text = F.concat(F.lit("/srv/store"), F.substring("url", F.length(root) + 1, F.length("url")))
    return p.select("page_id", redact.redact_paths(text, ["/srv", "/srv/store"]).alias("shown"))
