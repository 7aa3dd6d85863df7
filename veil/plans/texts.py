"""Queries over documents: detectors, the gate, findings, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import spans as sp
from veil.functions.text import alnum_lower, collapse_ws, placeholder_tokens
from veil.operators import detect as d
from veil.operators import gate, metrics
from veil.operators.model import chunk_text, score_tokens
from veil.operators.terms import match_terms
from veil.plans import duck
from veil.plans.registry import query
from veil.plans.tables import table
from veil.sources.files import classify_files, cut_texts
from veil.sources.sinks import split_verified


def found(spark, sf, detector, name="documents"):
    """Spans of one detector, one row each."""
    items = F.explode(F.expr(detector("text"))).alias("i")
    return table(spark, sf, name).select("doc_id", items).select(
        "doc_id", F.col("i.start").alias("start"), F.col("i.end").alias("end"), "i.match")


def found_sql(source_where: str) -> str:
    return f"SELECT doc_id, s AS start, e AS \"end\", v AS match FROM ({source_where})"


def shape_sql(pattern: str, where: str) -> str:
    return found_sql(f"{duck.spans('documents', 'doc_id', 'text', pattern)}) WHERE ({where}")


@query("h1_card", shape_sql("[0-9]+", f"length(v) BETWEEN 13 AND 19 AND {duck.luhn('v')}"))
def _(spark, sf):
    return found(spark, sf, d.detect_card)


@query("h7_email", shape_sql(duck.EMAIL, "true"))
def _(spark, sf):
    return found(spark, sf, d.detect_email)


@query("h8_phone", shape_sql(duck.PHONE, "true"))
def _(spark, sf):
    return found(spark, sf, d.detect_phone)


@query("h9_ip", shape_sql(r"[0-9]+(?:\.[0-9]+)+", duck.IS_IP))
def _(spark, sf):
    return found(spark, sf, d.detect_ip)


@query("h15_entropy", shape_sql(duck.LONG, "regexp_matches(v, '[0-9]') AND regexp_matches(v, "
                                f"'[A-Za-z]') AND {duck.entropy('v')} >= 3.0"))
def _(spark, sf):
    return found(spark, sf, d.detect_entropy)


NAMED = (duck.spans("documents", "doc_id", "text", duck.ASSIGN))


@query("h17_structure", f"""SELECT doc_id, CAST(e - 1 - length(x) AS INT) AS start,
  CAST(e - 1 AS INT) AS "end", x AS match FROM (SELECT *, regexp_extract(v, '"([^"]+)"$', 1) AS x
  FROM ({NAMED})) WHERE regexp_matches(v, '^[A-Za-z0-9_]*(token|secret|password|pwd|key|auth)')""")
def _(spark, sf):
    return found(spark, sf, d.detect_structure)


@query("s1_spans", found_sql(duck.spans("documents", "doc_id", "text", r"[0-9]+(?:\.[0-9]+)+")))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.inline(F.expr(sp.find_spans(
        "text", r"[0-9]+(?:\.[0-9]+)+")))).select(
        "doc_id", F.col("s").alias("start"), F.col("e").alias("end"), F.col("v").alias("match"))


CLEAN = f"WITH {duck.clean_ctes('documents', 'doc_id')}"
KEPT = f"{CLEAN} SELECT doc_id, unnest(k) AS i FROM kept"
ALL_CLEAN = "SELECT doc_id, clean FROM clean"


def sanitized(spark, sf, **options):
    return gate.sanitize(table(spark, sf, "documents").select("doc_id", "source", "text"),
                         source=F.col("source"), **options)


@query("s4_redact_text", f"WITH {duck.clean_ctes('documents', 'doc_id', accounts=False)} {ALL_CLEAN}")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gate.redact_text("text").alias("clean"))


@query("s2_analyze", f"""{CLEAN} SELECT doc_id, i.s AS start, i.e AS "end", i.v AS match, i.cat AS cat,
  i.kind AS kind, i.level AS level, i.ph AS ph FROM (SELECT doc_id, unnest(k) AS i FROM kept)""")
def _(spark, sf):
    out = gate.analyze(table(spark, sf, "documents").select("doc_id", "text"), warnings=False)
    return out.select("doc_id", F.inline(F.expr(sp.each("items")))).select(
        "doc_id", "start", "end", "match", "cat", "kind", "level", "ph")


@query("s5_sanitize", f"{CLEAN} SELECT doc_id, clean, CAST(coalesce(len(k), 0) AS INT) AS n_items, "
                      "0 AS n_warnings, false AS ner_ok FROM clean")
def _(spark, sf):
    return sanitized(spark, sf).select("doc_id", "clean", F.size("items").alias("n_items"),
                                       F.size("warnings").alias("n_warnings"), "ner_ok")


@query("s7_idempotence", f"{CLEAN} SELECT doc_id, clean, true AS same FROM clean")
def _(spark, sf):
    once = sanitized(spark, sf, warnings=False).select("doc_id", "clean")
    twice = gate.sanitize(once.withColumn("again", F.col("clean")).withColumnRenamed("clean", "first"),
                          "again", warnings=False)
    return twice.select("doc_id", F.col("first").alias("clean"),
                        (F.col("first") == F.col("clean")).alias("same"))


@query("s8_rules_only", f"{CLEAN} SELECT false AS ner_ok, count(*) AS docs, "
                        "CAST(sum(coalesce(len(k), 0)) AS BIGINT) AS found FROM clean")
def _(spark, sf):
    return sanitized(spark, sf, ner=None, warnings=False).groupBy("ner_ok").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("items")).alias("found"))


@query("s6_exit_check", f"""{CLEAN} SELECT verdict, count(*) AS docs,
  CAST(sum(left_over) AS BIGINT) AS residual FROM (SELECT 'clean' AS verdict, 0 AS left_over FROM clean
  UNION ALL SELECT CASE WHEN n > 0 THEN 'quarantine' ELSE 'clean' END, n FROM (
    SELECT t.doc_id, coalesce(c.n, 0) AS n FROM documents t LEFT JOIN (
      SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id) c USING (doc_id))) GROUP BY verdict""")
def _(spark, sf):
    """Finished texts pass; the same texts unredacted are what the check must refuse."""
    docs = sanitized(spark, sf, warnings=False).select("clean", "text")
    payloads = docs.select(F.explode(F.array("clean", "text")).alias("clean"))
    return split_verified(gate.exit_check(payloads)).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("residual_count").alias("residual"))


@query("d5_leak_report", f"WITH items AS ({duck.items('documents', 'doc_id')}) "
                         "SELECT kind, count(*) AS leaks FROM items GROUP BY kind")
def _(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", "text")
    return metrics.leak_report(gate.exit_check(raw, "text"))


@query("d6_run_metrics", f"""{CLEAN} SELECT CAST(sum(coalesce(len(k), 0)) AS BIGINT) AS found,
  CAST(sum(strlen(clean)) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS leaks FROM clean""")
def _(spark, sf):
    return metrics.run_metrics(gate.exit_check(sanitized(spark, sf, warnings=False)))


@query("d1_findings_summary", f"""{KEPT.replace('SELECT doc_id, unnest(k) AS i FROM kept', '')}
  SELECT source, {duck.PLACEHOLDER_CLASS} AS class, count(*) AS hits FROM (
    SELECT source, i.ph AS ph FROM (SELECT doc_id, unnest(k) AS i FROM kept) JOIN documents USING (doc_id))
  GROUP BY 1, 2""")
def _(spark, sf):
    return metrics.findings_summary(gate.findings(sanitized(spark, sf, warnings=False), ("source",)),
                                    "source")


@query("a11_findings_sink", f"""{CLEAN} SELECT source, doc_id, i.s AS start, i.v AS match, i.ph AS ph
  FROM (SELECT doc_id, unnest(k) AS i FROM kept) JOIN documents USING (doc_id) WHERE i.level <> 'low'""")
def _(spark, sf):
    from veil.session import work_dir
    from veil.sources.sinks import write_findings

    path = work_dir(spark, "findings")
    write_findings(sanitized(spark, sf, warnings=False), path, ("doc_id",))
    return spark.read.parquet(path).select("source", F.col("doc_id").cast("long"), "start", "match", "ph")


@query("a12_clean_sink", f"""{CLEAN} SELECT doc_id, 'clean' AS verdict, strlen(clean) AS bytes FROM clean""")
def _(spark, sf):
    from veil.session import work_dir
    from veil.sources.sinks import write_clean

    path = work_dir(spark, "clean")
    write_clean(gate.exit_check(sanitized(spark, sf, warnings=False)).select(
        "doc_id", "clean", "residual", "residual_count"), path)
    return spark.read.parquet(path).select(
        "doc_id", "verdict", F.octet_length("clean").cast("long").alias("bytes"))


@query("f3_union_sources", f"""WITH items AS (SELECT 'file' AS source, * FROM (
    {duck.items('documents', 'doc_id')}) UNION ALL SELECT 'message', * FROM (
    {duck.items('(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)', 'doc_id')}))
  SELECT source, i.cat AS cat, count(*) AS n FROM (SELECT source, unnest(k) AS i FROM (
    {duck.kept('items', 'source, doc_id')})) GROUP BY 1, 2""")
def _(spark, sf):
    docs = gate.sanitize(table(spark, sf, "documents").select("doc_id", "text"), source="file",
                         warnings=False)
    turns = gate.sanitize(table(spark, sf, "conversations").select("conv_id", "turn", "text"),
                          source="message", warnings=False)
    both = gate.findings(docs, ("doc_id",)).unionByName(gate.findings(turns, ("conv_id", "turn")),
                                                        allowMissingColumns=True)
    return both.groupBy("source", "cat").agg(F.count(F.lit(1)).alias("n"))


@query("d9_evaluate", f"""WITH items AS ({duck.items('documents', 'doc_id')}),
  hits AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id)
  SELECT CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
    CAST(sum(CASE WHEN toxic = 1 AND coalesce(n, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS caught,
    CAST(sum(CASE WHEN toxic <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
    CAST(sum(CASE WHEN toxic <> 1 AND coalesce(n, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms
  FROM documents JOIN labels USING (doc_id) LEFT JOIN hits USING (doc_id)""")
def _(spark, sf):
    """The labels are about toxicity; the query tests the shape of the evaluation."""
    found_n = sanitized(spark, sf, warnings=False).select("doc_id", F.size("items").alias("n"))
    truth = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_private"))
    return metrics.evaluate(found_n, truth, "doc_id", "n", "is_private")


@query("a13_payload_bytes", "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.sum(metrics.payload_bytes(F.col("text"))).alias("bytes"))


@query("a1_cut_texts", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) "
                       "|| '… truncated' ELSE text END AS text FROM documents")
def _(spark, sf):
    """The cut is the feature; 2,000 here so that it is exercised."""
    return cut_texts(table(spark, sf, "documents").select("doc_id", "text"), max_chars=2000)


@query("g1_collapse_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", collapse_ws(F.col("text")).alias("text"))


@query("g11_alnum_lower", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", alnum_lower(F.col("text")).alias("text"))


@query("e10_chunk_text", r"""SELECT doc_id, CAST(i - 1 AS INT) AS chunk_no,
  CAST(coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0) AS INT) AS base, p[i] AS text
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id,
    regexp_extract_all(text, '(?s).{1,899}(?:\s|\z)|\S{900}|\s') AS p FROM documents))""")
def _(spark, sf):
    return chunk_text(table(spark, sf, "documents"))


@query("g22_winning_label", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS label_idx,
  round(1 / list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE)
    - CAST(list_max(embedding) AS DOUBLE)))), 6) AS score FROM embeddings""")
def _(spark, sf):
    scored = score_tokens(table(spark, sf, "embeddings"), "embedding")
    return scored.select("vec_id", "label_idx", F.round("score", 6).alias("score"))


@query("c1_match_terms", """WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term
    FROM benchmark), hits AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
  SELECT term, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM hits JOIN words USING (term)
  WHERE length(term) >= 2 GROUP BY term""")
def _(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    hits = match_terms(table(spark, sf, "documents"), words, sizes=[1])
    # Per document first: a term that is in every text then shuffles one row per document.
    per_doc = hits.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("docs"))


@query("d3_placeholders", f"""{CLEAN} SELECT doc_id, array_to_string(list_distinct_in_order, ' ') AS tokens FROM (
  SELECT doc_id, list_reduce(regexp_extract_all(clean, '\\[[A-Z][A-Z_0-9]*(?::[^\\]]*)?\\]'),
    lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, []::VARCHAR[])
    AS list_distinct_in_order FROM clean)""")
def _(spark, sf):
    return sanitized(spark, sf, warnings=False).select("doc_id", F.array_join(
        F.array_distinct(placeholder_tokens(F.col("clean"))), " ").alias("tokens"))


MANIFEST = """SELECT doc_id, source || '/file' || CAST(doc_id AS STRING) || CASE doc_id % 7
  WHEN 0 THEN '.PNG' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.csv' WHEN 4 THEN '.jpeg'
  WHEN 5 THEN '.md' ELSE '' END AS path, CASE doc_id % 7 WHEN 6 THEN 'image/tiff' ELSE 'x/y' END AS mime
  FROM {documents}"""


@query("a7_classify_files", f"""SELECT doc_id, path, CASE WHEN mime LIKE 'image/%' OR regexp_matches(lower(path),
    '\\.(png|jpg|jpeg|webp|gif|bmp)$') THEN 'image' WHEN lower(path) LIKE '%.pdf' THEN 'pdf'
  WHEN regexp_matches(lower(path), '\\.(xlsx|xls|xlsm)$') THEN 'sheet' ELSE 'text' END AS kind
  FROM ({MANIFEST.format(documents='documents')})""")
def _(spark, sf):
    from veil.plans.tables import derive

    return classify_files(derive(spark, sf, MANIFEST, "documents")).select("doc_id", "path", "kind")


@query("g23_json_structure", """SELECT key, count(*) AS n, CAST(sum(CAST(val AS BIGINT)) AS BIGINT) AS total FROM (
  SELECT regexp_extract(props, '"([a-z]+)"', 1) AS key, regexp_extract(props, ': ?([0-9]+)', 1) AS val FROM events)
  GROUP BY key""")
def _(spark, sf):
    events = table(spark, sf, "events")
    parsed = events.withColumn("v", F.try_parse_json("props"))
    keys = parsed.select("v", F.explode(F.json_object_keys("props")).alias("key"))
    # variant_get wants a constant path, so the value is read by key through a map.
    value = F.from_json(F.to_json("v"), "map<string,string>")
    return keys.select("key", F.try_element_at(value, F.col("key")).cast("long").alias("val")).groupBy(
        "key").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))
