"""Queries of retrieval, code map, telemetry, evaluation and incremental maintenance, with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.text import _fold_table
from tidemark.operators import archive, codemap, evaluation, incremental, retrieval, telemetry
from tidemark.session import settle
from tidemark.sources.tables import table


def _words(spark, folder):
    return table(spark, folder, "misses").select("q")


def _docs(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")


def token_df(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and occurrences of each term."""
    return retrieval.postings(_docs(spark, folder), "doc_id", {"text": 1.0}).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def hidden_terms(spark, folder):
    """Terms of at least 6 characters that begin with a letter and are in at most 32 documents."""
    return token_df(spark, folder).where("n_docs <= 32 AND length(term) >= 6").where(F.col("term").rlike(r"^\p{L}")).select("term", "n_docs")


def bm25_topk(spark, folder):
    """The 8 best documents for each query that missed."""
    index = settle(retrieval.postings(_docs(spark, folder), "doc_id", {"text": 1.0}))
    best = retrieval.top(retrieval.bm25(index, retrieval.phrases(_words(spark, folder))), 8)
    return best.select("query", "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_weighted_topics(spark, folder):
    """Trail entries for the queries that missed: headings weigh 3, the text that they stand above 1."""
    e = table(spark, folder, "documents").where(F.col("text").rlike(r"^# \d{4}-\d{2}-\d{2} · ")).select("doc_id", F.regexp_extract("text", r"^# \d{4}-\d{2}-\d{2} · ([^\n]*)", 1).alias("heading"), F.substring(F.regexp_replace("text", r"^[^\n]*", ""), 1, 2000).alias("hidden"))
    index = settle(retrieval.postings(e, "doc_id", {"heading": 3.0, "hidden": 1.0}))
    best = retrieval.top(retrieval.bm25(index, retrieval.phrases(_words(spark, folder))), 4)
    return best.select("query", "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def search_passages(spark, folder):
    """Passages for the queries that missed, equal ones once."""
    c = archive.chunks(table(spark, folder, "documents")).select(F.concat_ws(":", "file", "from_line").alias("chunk_id"), "chunk")
    return retrieval.search_passages(settle(c), _words(spark, folder))


def map_find(spark, folder):
    """Modules for the queries that missed and for the headings of the trail."""
    m = settle(archive.modules(archive.file_lines(table(spark, folder, "documents"))))
    return codemap.best(codemap.find(m, _map_queries(spark, folder), k=12))


def _map_queries(spark, folder):
    """What the map is asked: all queries that missed, and the headings of all trail entries as sentences."""
    return _words(spark, folder).union(table(spark, folder, "trail").select(F.col("heading").alias("q"))).where("q IS NOT NULL").distinct()


def abbrev_homes(spark, folder):
    """Where short identifier segments are used most."""
    names = F.regexp_extract_all("text", F.lit(r"([A-Za-z]\w*)\(\)"), F.lit(1))
    w = _docs(spark, folder).select(F.col("doc_id").alias("file"), F.explode(names).alias("name")).select("file", F.explode(tx.segments(F.col("name"))).alias("term")).where("length(term) BETWEEN 3 AND 5")
    return codemap.homes(w)


def _calls(spark, folder):
    return telemetry.calls(table(spark, folder, "messages"))


def bill_once(spark, folder):
    """Calls and tokens of each session, each call once."""
    return _calls(spark, folder).groupBy("session").agg(F.count("*").alias("n_calls"), *[F.sum(c).alias(f"sum_{c}") for c in ("i", "cw", "cr", "o")])


def weighted_cost(spark, folder):
    return _calls(spark, folder).groupBy("session").agg(F.round(F.sum(telemetry.cost()), 4).alias("cost"))


def cost_histogram(spark, folder):
    """Calls and cost by size of context."""
    return _calls(spark, folder).groupBy(telemetry.band().alias("band")).agg(F.count("*").alias("n_calls"), F.round(F.sum(telemetry.cost()), 2).alias("cost"))


def expired_cache(spark, folder):
    """Share of cost of calls that wrote more than half of a large context again."""
    expired = (F.col("k") > telemetry.EXPIRED_FROM) & (F.col("cw") > 0.5 * F.col("k"))
    return _calls(spark, folder).agg(F.count_if(expired).alias("n_expired"), F.round(F.sum(F.when(expired, telemetry.cost()).otherwise(0.0)) / F.sum(telemetry.cost()), 6).alias("share"), F.round(F.avg("k"), 4).alias("mean_context"))


def context_growth(spark, folder):
    """Growth of context between calls."""
    order = Window.partitionBy("session").orderBy("line_no", "row_id")
    grown = F.greatest(F.lit(0), F.col("k") - F.lag("k").over(order))
    return _calls(spark, folder).withColumn("grown", F.coalesce(grown, F.lit(0))).groupBy("session").agg(F.sum("grown").alias("growth"), F.max("k").alias("largest"))


def ceiling_simulation(spark, folder):
    """Simulated cost by ceiling and penalty."""
    s = telemetry.simulate(_calls(spark, folder), (150_000, 200_000, 300_000, 500_000), (0, 10_000, 30_000))
    return s.groupBy("ceiling", "penalty").agg(F.count("*").alias("n_sessions"), F.round(F.sum("cost"), 2).alias("cost"))


def steps_before_first_edit(spark, folder):
    """Tool calls that aren't edits before the first edit of a session; null if there is none."""
    m = table(spark, folder, "messages").where("tool IS NOT NULL").select("session", "line_no", "row_id", F.col("tool").isin("Edit", "Write").alias("edits"))
    first = m.groupBy("session").agg(F.min(F.when(F.col("edits"), F.struct("line_no", "row_id"))).alias("first"))
    return m.join(first, "session").groupBy("session").agg(F.when(F.first("first").isNotNull(), F.count_if(F.struct("line_no", "row_id") < F.col("first"))).alias("steps"))


def _stats(spark, folder):
    """One row a session: the newest version, of equal ones any."""
    s = table(spark, folder, "session_stats")
    return s.groupBy("session").agg(F.max_by(F.struct(*[c for c in s.columns if c != "session"]), F.struct("v", "day", "turns", "output_tokens")).alias("s")).select("session", "s.*")


def halves_change(spark, folder):
    """Mean tokens written an edit, in the older and the newer half of the sessions; the newer half has the odd one."""
    s = _stats(spark, folder)
    placed = evaluation.systematic(s.select("day", "session", "output_tokens", "edits"), ["day", "session"], 1)
    n = s.agg(F.floor(F.count("*") / 2).alias("half"))
    half = placed.join(F.broadcast(n)).withColumn("part", F.when(F.col("position") < F.col("half"), "older").otherwise("newer"))
    return half.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("edits") > 0, F.col("output_tokens") / F.col("edits")).otherwise(0.0)), 4).alias("tokens_an_edit"))


def cache_share(spark, folder):
    """Ratio of means, sessions that used the map, sessions with calls of large context."""
    s = _stats(spark, folder)
    return s.agg(F.round(F.try_divide(F.sum("cache_read"), F.sum(F.col("cache_read") + F.col("input_tokens") + F.col("cache_write"))), 6).alias("cache_share"), F.count_if(F.col("map_uses") > 0).alias("with_map"), F.count_if(F.col("over200k") > 0).alias("with_large"))


def upper_median(spark, folder):
    return telemetry.upper_median(_stats(spark, folder), ["day"], "turns")


def concentration(spark, folder):
    """Share of output tokens of the tenth of the sessions that wrote most."""
    s = _stats(spark, folder).select("session", F.coalesce("output_tokens", F.lit(0)).alias("o"))
    placed = evaluation.systematic(s.withColumn("least", -F.col("o")), ["least", "session"], 1)
    n = s.agg(F.ceil(F.count("*") / 10).alias("tenth"), F.sum("o").alias("whole"))
    return placed.join(F.broadcast(n)).agg(F.round(F.sum(F.when(F.col("position") < F.col("tenth"), F.col("o")).otherwise(0)) / F.max("whole"), 6).alias("share"))


def tool_cost(spark, folder):
    """Calls and characters of input by tool, and of large ones."""
    m = table(spark, folder, "messages").where("tool IS NOT NULL")
    size = F.coalesce(F.length("input"), F.lit(0))
    return m.groupBy("tool").agg(F.count("*").alias("n_calls"), F.sum(size).alias("n_chars"), F.count_if(size > 512).alias("n_large"), F.sum(F.when(size > 512, size).otherwise(0)).alias("large_chars")).orderBy(F.col("n_chars").desc(), "tool").limit(14)


def health_verdict(spark, folder):
    """What is wrong with the archive, as counts, and whether it is well."""
    state = table(spark, folder, "session_state")
    behind = state.agg(F.count_if(F.col("bytes") > F.col("byte_offset")).alias("behind"), F.count("*").alias("sessions"))
    twice = table(spark, folder, "session_stats").groupBy("session").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
    bare = table(spark, folder, "trail").agg(F.count_if(F.size("pointers") == 0).alias("bare"))
    return behind.join(twice).join(bare).withColumn("healthy", (F.col("behind") + F.col("twice") + F.col("bare")) == 0)


def recall_mrr(spark, folder):
    """How well BM25 finds the documents again from their 4 rarest long words, for each 50th document."""
    index = settle(retrieval.postings(_docs(spark, folder), "doc_id", {"text": 1.0}))
    df = index.groupBy("term").agg(F.count("*").alias("df")).where("df BETWEEN 2 AND 300 AND length(term) >= 5")
    order = Window.partitionBy("doc").orderBy("df", "term")
    words = index.where("doc % 50 = 0").join(df, "term").withColumn("nth", F.row_number().over(order)).where("nth <= 4")
    asked = words.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("query"))
    truth = settle(asked.select("query", "doc"))
    answers = retrieval.top(retrieval.bm25(index, retrieval.phrases(truth, "query")), 12)
    return evaluation.metrics(evaluation.first_ranks(answers, truth))


def systematic_sample(spark, folder):
    """Each 20th document from the 4th on."""
    return evaluation.systematic(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 20, 3)


def incremental_index(spark, folder):
    """The chunk index after two increments, summed by term: equal to that of a full build."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    before = d.where("doc_id % 3 != 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit(" stale"))).otherwise(F.col("text")))
    index = settle(incremental.chunk_index(before))
    changed = incremental.changes(incremental.manifest(before), incremental.manifest(d))
    after = incremental.update_index(index, d, changed)
    return after.groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n"))


_FROM, _TO = _fold_table()
_TERMS = rf"""terms AS (SELECT doc, unnest(regexp_extract_all(lower(translate(regexp_replace(t, '[\x{{0300}}-\x{{036F}}]', '', 'g'), '{_FROM}', '{_TO}')), '[\p{{L}}\p{{N}}]+')) AS term, w FROM src)"""


def _bm25_sql(src: str, k: int, queries: str = "SELECT DISTINCT q AS query FROM misses WHERE q IS NOT NULL") -> str:
    return rf"""WITH src AS ({src}), {_TERMS}, post AS (SELECT term, doc, sum(w) AS tf, count(*) AS n FROM terms GROUP BY ALL),
    qs AS ({queries}), ws AS (SELECT query, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT query, regexp_extract_all(lower(translate(regexp_replace(query, '[\x{{0300}}-\x{{036F}}]', '', 'g'), '{_FROM}', '{_TO}')), '[\p{{L}}\p{{N}}]+') AS l FROM qs)),
    ph AS (SELECT query, pos * 2 AS p, word AS prefix, length(word) <= 2 AS exact FROM ws UNION ALL SELECT query, pos * 2 + 1, substring(word, 1, length(word) - 3), false FROM ws WHERE length(word) >= 7),
    len AS (SELECT doc, sum(n) AS l FROM post GROUP BY doc), corpus AS (SELECT count(*) AS n, avg(l) AS a FROM len),
    vocab AS (SELECT DISTINCT term FROM post), mt AS (SELECT query, p, term FROM ph JOIN vocab ON CASE WHEN exact THEN term = prefix ELSE starts_with(term, prefix) END),
    hits AS (SELECT query, p, doc, sum(tf) AS tf FROM mt JOIN post USING (term) GROUP BY ALL), df AS (SELECT query, p, count(*) AS df FROM hits GROUP BY ALL),
    sc AS (SELECT query, doc, sum(-(CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score
      FROM hits JOIN df USING (query, p) JOIN len USING (doc), corpus GROUP BY ALL),
    rk AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9), doc) AS rank FROM sc) """


_CALLS = """rowz AS (SELECT session, message_id, line_no, row_id, coalesce(usage.input_tokens, 0) AS i, coalesce(usage.cache_creation_input_tokens, 0) AS cw, coalesce(usage.cache_read_input_tokens, 0) AS cr, coalesce(usage.output_tokens, 0) AS o,
  CASE WHEN message_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY session, message_id ORDER BY line_no, row_id) END AS nth FROM messages WHERE type = 'assistant' AND usage IS NOT NULL),
calls AS (SELECT *, i + cw + cr AS k, i + 1.25::DOUBLE * cw + 0.1::DOUBLE * cr + 5.0::DOUBLE * o AS cost FROM rowz WHERE nth = 1)"""
_STATS = "st AS (SELECT * FROM session_stats QUALIFY row_number() OVER (PARTITION BY session ORDER BY v DESC, day DESC, turns DESC, output_tokens DESC) = 1)"
_DOC = "SELECT doc_id AS doc, text AS t, 1.0::DOUBLE AS w FROM documents WHERE text IS NOT NULL"
_CHUNKED = r"""RECURSIVE ls AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
c AS (SELECT file, line_no, line, 1 AS from_line, length(line) + 1 AS held FROM ls WHERE line_no = 1 UNION ALL
  SELECT l.file, l.line_no, l.line, CASE WHEN c.held > 400 AND regexp_matches(c.line, '^\s*$') THEN l.line_no ELSE c.from_line END, CASE WHEN c.held > 400 AND regexp_matches(c.line, '^\s*$') THEN length(l.line) + 1 ELSE c.held + length(l.line) + 1 END
  FROM c JOIN ls l ON l.file = c.file AND l.line_no = c.line_no + 1),
ch AS (SELECT file, from_line, string_agg(line, chr(10) ORDER BY line_no) AS chunk FROM c GROUP BY ALL)"""

SQL = {
    "token_df": f"WITH src AS ({_DOC}), {_TERMS} SELECT term, count(DISTINCT doc) AS n_docs, count(*) AS n FROM terms GROUP BY term",
    "hidden_terms": f"WITH src AS ({_DOC}), {_TERMS} SELECT term, count(DISTINCT doc) AS n_docs FROM terms WHERE length(term) >= 6 AND regexp_matches(term, '^\\p{{L}}') GROUP BY term HAVING count(DISTINCT doc) <= 32",
    "bm25_topk": _bm25_sql(_DOC, 8) + "SELECT query, rank, doc AS doc_id, round(score, 6) AS score FROM rk WHERE rank <= 8",
    "bm25_weighted_topics": _bm25_sql(r"""SELECT doc_id AS doc, regexp_extract(text, '^# \d{4}-\d{2}-\d{2} · ([^\n]*)', 1) AS t, 3.0::DOUBLE AS w FROM documents WHERE regexp_matches(text, '^# \d{4}-\d{2}-\d{2} · ')
      UNION ALL SELECT doc_id, substring(regexp_replace(text, '^[^\n]*', ''), 1, 2000), 1.0 FROM documents WHERE regexp_matches(text, '^# \d{4}-\d{2}-\d{2} · ')""", 4) + "SELECT query, rank, doc AS doc_id, round(score, 6) AS score FROM rk WHERE rank <= 4",
    "search_passages": _bm25_sql("SELECT file || ':' || from_line AS doc, chunk AS t, 1.0::DOUBLE AS w FROM ch", 32).replace("WITH src", f"WITH {_CHUNKED}, src", 1)
    + r""", ded AS (SELECT query, rank, doc, score, row_number() OVER (PARTITION BY query, trim(replace(t, chr(13) || chr(10), chr(10)), ' ') ORDER BY rank) AS nth FROM rk JOIN src USING (doc) WHERE rank <= 32)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank, doc AS chunk_id, round(score, 6) AS score FROM ded WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 8""",
    "bill_once": f"WITH {_CALLS} SELECT session, count(*) AS n_calls, CAST(sum(i) AS BIGINT) AS sum_i, CAST(sum(cw) AS BIGINT) AS sum_cw, CAST(sum(cr) AS BIGINT) AS sum_cr, CAST(sum(o) AS BIGINT) AS sum_o FROM calls GROUP BY session",
    "weighted_cost": f"WITH {_CALLS} SELECT session, round(sum(cost), 4) AS cost FROM calls GROUP BY session",
    "cost_histogram": f"WITH {_CALLS} SELECT CASE WHEN k < 50000 THEN '<50000' WHEN k < 100000 THEN '<100000' WHEN k < 200000 THEN '<200000' WHEN k < 400000 THEN '<400000' WHEN k < 700000 THEN '<700000' ELSE '>=700000' END AS band, count(*) AS n_calls, round(sum(cost), 2) AS cost FROM calls GROUP BY 1",
    "expired_cache": f"WITH {_CALLS} SELECT count(*) FILTER (k > 50000 AND cw > 0.5 * k) AS n_expired, round(coalesce(sum(cost) FILTER (k > 50000 AND cw > 0.5 * k), 0) / sum(cost), 6) AS share, round(avg(k), 4) AS mean_context FROM calls",
    "context_growth": f"WITH {_CALLS}, g AS (SELECT session, k, coalesce(greatest(0, k - lag(k) OVER (PARTITION BY session ORDER BY line_no, row_id)), 0) AS grown FROM calls) SELECT session, CAST(sum(CASE WHEN grown > 0 THEN grown ELSE 0 END) AS BIGINT) AS growth, max(k) AS largest FROM g GROUP BY session",
    "ceiling_simulation": f"""WITH RECURSIVE {_CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no, row_id) AS n FROM calls),
      b AS (SELECT session, min(k) AS base FROM o WHERE n <= 3 GROUP BY session), params AS (SELECT c.ceiling, p.penalty FROM (VALUES (150000), (200000), (300000), (500000)) c(ceiling), (VALUES (0), (10000), (30000)) p(penalty)),
      s AS (SELECT session, ceiling, penalty, base, n, k::DOUBLE AS was, CASE WHEN k > ceiling THEN base + 15000.0 + penalty ELSE k::DOUBLE END AS ctx,
          CASE WHEN k > ceiling THEN k * 0.1::DOUBLE + 50000 + (base + 15000 + penalty) * 1.25::DOUBLE + o * 5 WHEN k > 50000 AND cw > 0.5 * k THEN k * 1.25::DOUBLE + o * 5 ELSE k * 0.1::DOUBLE + o * 5 END AS cost
        FROM o JOIN b USING (session), params WHERE n = 1
        UNION ALL SELECT s.session, s.ceiling, s.penalty, s.base, o.n, o.k::DOUBLE,
          CASE WHEN s.ctx + greatest(0, o.k - s.was) > s.ceiling THEN s.base + 15000.0 + s.penalty ELSE s.ctx + greatest(0, o.k - s.was) END,
          s.cost + CASE WHEN s.ctx + greatest(0, o.k - s.was) > s.ceiling THEN (s.ctx + greatest(0, o.k - s.was)) * 0.1::DOUBLE + 50000 + (s.base + 15000 + s.penalty) * 1.25::DOUBLE + o.o * 5
            WHEN o.k > 50000 AND o.cw > 0.5 * o.k THEN (s.ctx + greatest(0, o.k - s.was)) * 1.25::DOUBLE + o.o * 5 ELSE s.ctx * 0.1::DOUBLE + greatest(0, o.k - s.was) * 1.25::DOUBLE + o.o * 5 END
        FROM s JOIN o ON o.session = s.session AND o.n = s.n + 1)
      SELECT CAST(ceiling AS BIGINT) AS ceiling, CAST(penalty AS BIGINT) AS penalty, count(*) AS n_sessions, round(sum(cost), 2) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY session, ceiling, penalty ORDER BY n DESC) AS z FROM s) WHERE z = 1 GROUP BY ALL""",
    "steps_before_first_edit": """WITH t AS (SELECT session, line_no, row_id, tool IN ('Edit', 'Write') AS e FROM messages WHERE tool IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no, row_id) AS n FROM t)
      SELECT session, min(n) FILTER (e) - 1 AS steps FROM r GROUP BY session""",
    "halves_change": f"""WITH {_STATS}, o AS (SELECT *, row_number() OVER (ORDER BY day, session) - 1 AS p, count(*) OVER () // 2 AS half FROM st)
      SELECT CASE WHEN p < half THEN 'older' ELSE 'newer' END AS part, count(*) AS n, round(avg(CASE WHEN edits > 0 THEN output_tokens::DOUBLE / edits ELSE 0 END), 4) AS tokens_an_edit FROM o GROUP BY 1""",
    "cache_share": f"WITH {_STATS} SELECT round(sum(cache_read)::DOUBLE / sum(cache_read + input_tokens + cache_write), 6) AS cache_share, count(*) FILTER (map_uses > 0) AS with_map, count(*) FILTER (over200k > 0) AS with_large FROM st",
    "upper_median": f"WITH {_STATS} SELECT day, count(turns) AS n, list_sort(list(turns))[count(turns) // 2 + 1] AS median FROM st WHERE turns IS NOT NULL GROUP BY day",
    "concentration": f"WITH {_STATS}, o AS (SELECT coalesce(output_tokens, 0) AS o, row_number() OVER (ORDER BY coalesce(output_tokens, 0) DESC, session) AS p, count(*) OVER () AS n FROM st) SELECT round(sum(o) FILTER (p <= ceil(n / 10))::DOUBLE / sum(o), 6) AS share FROM o",
    "tool_cost": "SELECT tool, count(*) AS n_calls, CAST(coalesce(sum(length(input)), 0) AS BIGINT) AS n_chars, count(*) FILTER (length(input) > 512) AS n_large, CAST(coalesce(sum(length(input)) FILTER (length(input) > 512), 0) AS BIGINT) AS large_chars FROM messages WHERE tool IS NOT NULL GROUP BY tool ORDER BY n_chars DESC, tool LIMIT 14",
    "health_verdict": """SELECT *, behind + twice + bare = 0 AS healthy FROM (SELECT count(*) FILTER (bytes > byte_offset) AS behind, count(*) AS sessions FROM session_state),
      (SELECT count(*) AS twice FROM (SELECT session FROM session_stats GROUP BY session HAVING count(*) > 1)), (SELECT count(*) FILTER (len(pointers) = 0) AS bare FROM trail)""",
    "systematic_sample": "SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) WHERE position >= 3 AND (position - 3) % 20 = 0",
    "incremental_index": f"WITH {_CHUNKED}, src AS (SELECT file || ':' || from_line AS doc, chunk AS t, 1 AS w FROM ch), {_TERMS} SELECT term, count(DISTINCT doc) AS n_chunks, count(*) AS n FROM terms GROUP BY term",
    "abbrev_homes": r"""WITH n AS (SELECT doc_id AS file, unnest(regexp_extract_all(text, '([A-Za-z]\w*)\(\)', 1)) AS name FROM documents WHERE text IS NOT NULL),
      s AS (SELECT file, unnest(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' ')) AS term FROM n),
      c AS (SELECT term, file, count(*) AS n FROM s WHERE length(term) BETWEEN 3 AND 5 GROUP BY ALL HAVING count(*) >= 2)
      SELECT term, file, n, row_number() OVER (PARTITION BY term ORDER BY n DESC, file) AS home FROM c QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, file) <= 3""",
}

_ALL = (
    token_df, hidden_terms, bm25_topk, bm25_weighted_topics, search_passages, map_find, abbrev_homes, bill_once, weighted_cost, cost_histogram, expired_cache, context_growth, ceiling_simulation,
    steps_before_first_edit, halves_change, cache_share, upper_median, concentration, tool_cost, health_verdict, recall_mrr, systematic_sample, incremental_index,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
