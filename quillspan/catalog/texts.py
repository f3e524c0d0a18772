"""Text functions, splitting, guards and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillspan.catalog.registry import CHUNKS, TOKENS, WORD, query
from quillspan.catalog.registry import texts as chunk_texts
from quillspan.functions.columns import ARTICLES, LEGAL_FORMS, approximate_tokens, chunk_key, collapse, content_hash, entity_key, relation_type, tokens
from quillspan.operators import context, guards, routing, splitting
from quillspan.sources.tables import table


@query("SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS tokens FROM documents")
def token_estimates(s, d):
    return table(s, d, "documents").select("doc_id", approximate_tokens(F.col("text")).alias("tokens"))


@query(rf"WITH {CHUNKS} SELECT chunk_id, coalesce(len({TOKENS % 'content'}), 0) AS n FROM ch")
def token_lengths(s, d):
    return chunk_texts(s, d).select("chunk_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def collapsed_texts(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(collapse(F.col("text"))).alias("h"))


@query()
def content_hashes(s, d):
    return table(s, d, "documents").select("doc_id", content_hash(F.col("source"), F.col("text")).alias("h"))


_FORMS, _ARTICLES = "|".join(LEGAL_FORMS), "|".join(ARTICLES)
_KEY = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(%s, '&', ' and ')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '^ +| +$', '', 'g'), '^(?:(?:{_ARTICLES})(?: |$))+', ''), '(?:(?:^| )(?:{_FORMS}))+$', '')"
_NAMES = "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT -p_partkey, 'The ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' GmbH & Co. KG' WHEN 2 THEN ', LLP' ELSE '' END FROM part"


@query(f"SELECT k, CASE WHEN key <> '' THEN key ELSE lower(trim(name)) END AS key FROM (SELECT k, name, {_KEY % 'name'} AS key FROM ({_NAMES}))")
def entity_names(s, d):
    form = F.when(F.col("p_partkey") % 4 == 0, " Inc.").when(F.col("p_partkey") % 4 == 1, " GmbH & Co. KG").when(F.col("p_partkey") % 4 == 2, ", LLP").otherwise("")
    parts = table(s, d, "part").select((-F.col("p_partkey")).alias("k"), F.concat(F.lit("The "), F.col("p_name"), form).alias("name"))
    names = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).unionByName(parts)
    return names.select("k", entity_key(F.col("name")).alias("key"))


@query(r"SELECT DISTINCT p_type, CASE WHEN regexp_full_match(t, '[A-Z][A-Z0-9_]{0,63}') THEN t ELSE 'RELATED_TO' END AS rel FROM (SELECT p_type, upper(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS t FROM part)")
def relation_types(s, d):
    return table(s, d, "part").select("p_type", relation_type(F.col("p_type")).alias("rel")).distinct()


# Splitting


def _documents(s, d):
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


_MADE = ("recursive", "token", "markdown", "code", "semantic", "sentence")


@query("SELECT doc_id::VARCHAR AS id, strategy, true AS exact, true AS whole, true AS in_order FROM documents, (VALUES ('recursive'), ('token'), ('markdown'), ('code'), ('semantic'), ('sentence')) x(strategy) WHERE regexp_matches(text, '\\S')".replace("\\\\", "\\"))
def split_invariants(s, d):
    """For every strategy: offsets give the content, no character but white space is left out, chunks are in order."""
    docs = _documents(s, d)
    out = []
    for name in _MADE:
        cut = splitting.split(docs, name).join(docs.withColumnRenamed("id", "document_id"), "document_id")
        exact = F.bool_and(F.expr("substring(text, start_char + 1, end_char - start_char) = content")).alias("exact")
        spans = F.array_sort(F.collect_list(F.struct("start_char", "end_char", "chunk_index")))
        by = cut.groupBy("document_id").agg(exact, F.first("text").alias("text"), spans.alias("x"))
        gap = F.expr("transform(x, (s, i) -> substring(text, if(i = 0, 0, x[i - 1].end_char) + 1, greatest(0, s.start_char - if(i = 0, 0, x[i - 1].end_char))))")
        tail = F.expr("substring(text, x[size(x) - 1].end_char + 1)")
        whole = (F.length(F.regexp_replace(F.concat(F.array_join(gap, ""), tail), r"\s|\p{Z}|[\x1c-\x1f\x85]", "")) == 0).alias("whole")
        order = F.expr("forall(x, s -> s.chunk_index = 0 or (x[s.chunk_index].start_char > x[s.chunk_index - 1].start_char and x[s.chunk_index].end_char > x[s.chunk_index - 1].end_char))").alias("in_order")
        out.append(by.select(F.col("document_id").alias("id"), F.lit(name).alias("strategy"), "exact", whole, order))
    return reduce(lambda a, b: a.unionByName(b), out)


@query()
def split_recursive(s, d):
    return splitting.split(_documents(s, d), "recursive").select("document_id", "chunk_index", "start_char", "end_char")


@query()
def split_markdown(s, d):
    return splitting.split(_documents(s, d), "markdown").select("document_id", "chunk_index", "start_char", "end_char", "heading")


@query()
def split_semantic(s, d):
    return splitting.split(_documents(s, d), "semantic").select("document_id", "chunk_index", "start_char", "end_char")


@query()
def split_code(s, d):
    return splitting.split(_documents(s, d), "code").select("document_id", "chunk_index", "start_char", "end_char")


# Windows of 128 tokens that start 112 apart, without outer white space.
@query(r"""WITH t AS (SELECT doc_id::VARCHAR AS document_id, text, regexp_extract_all(text, '\s*(?:[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])') AS x FROM documents WHERE regexp_matches(text, '\S')),
e AS (SELECT document_id, text, len(x) AS n, list_transform(range(0, len(x), 112), lambda i: i) AS starts, list_prepend(0, list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[1:i], lambda w: length(w)))::BIGINT)) AS ends FROM t WHERE len(x) <= 400),
w AS (SELECT document_id, text, n, ends, unnest(starts) AS i FROM e)
SELECT document_id, count(*) AS chunks, CAST(max(ends[least(i + 128, n) + 1]) AS INT) AS last_end FROM w WHERE i = 0 OR i + 16 < n GROUP BY document_id""")
def split_token(s, d):
    """Counted for texts of at most 400 tokens, which SQL can number; the operator runs over all."""
    docs = _documents(s, d)
    cut = splitting.split(docs, "token").groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("end_char").alias("last_end"))
    few = docs.where(F.size(F.regexp_extract_all("text", F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))) <= 400).select(F.col("id").alias("document_id"))
    return cut.join(few, "document_id", "left_semi")


@query()
def sentence_windows(s, d):
    return splitting.sentence_windows(_documents(s, d)).select("document_id", "chunk_index", "content", "window")


@query()
def parents_and_children(s, d):
    return splitting.parents_and_children(_documents(s, d)).select("chunk_id", "document_id", "parent_id", "chunk_level", "start_char", "end_char")


@query(f"WITH {CHUNKS} SELECT p.document_id, count(*) AS children, bool_and(c.start_char >= p.start_char OR c.start_char IS NULL OR p.start_char IS NULL) AS inside FROM ch c JOIN ch p ON c.parent_id = p.chunk_id GROUP BY p.document_id")
def children_by_parent(s, d):
    from quillspan.catalog.registry import chunks

    own = chunks(s, d, "document_id", "parent_id", "start_char")
    p = own.select(F.col("chunk_id").alias("parent_id"), F.col("document_id").alias("doc"), F.col("start_char").alias("at"))
    both = own.join(p, "parent_id")
    return both.groupBy(F.col("doc").alias("document_id")).agg(F.count("*").alias("children"), F.bool_and((F.col("start_char") >= F.col("at")) | F.col("start_char").isNull() | F.col("at").isNull()).alias("inside"))


@query()
def chunk_ids(s, d):
    return splitting.split(_documents(s, d), "recursive").select("chunk_id", chunk_key(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("again"))


# Guards

_MARKS = "|".join(rf"[{c}]{{2,}}" for c in ("-", "_", "~", "*", "#", "=", "!", "?", "/", ":", "`", "|", "+", "<", ">", "(", ")", "{", "}", "@", "%", "&", ",", ";", "\\\\", "\\[", "\\]", '"', "$", "''", "•"))
_INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}]"
_WRAP = r"regexp_replace(regexp_replace(%s, '(\w)[ \t]*[\r\n][ \t]*(\w)', '\1 \2', 'g'), '(\w)[ \t]*[\r\n][ \t]*(\w)', '\1 \2', 'g')"


def _rule(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"(regexp_matches(a, '{quoted}') OR regexp_matches(b, '{quoted}') OR regexp_matches(c, '{quoted}'))"


_LEFT = " * ".join(f"CASE WHEN {_rule(p)} THEN 1 - {w}::DOUBLE ELSE 1.0::DOUBLE END" for _, p, w in guards.RULES)
_SCANNED = (
    "SELECT doc_id, coalesce(x, '') AS a, regexp_replace(" + _WRAP % "coalesce(x, '')" + f", '{_MARKS}', ' ', 'g') AS b, regexp_replace(" + _WRAP % f"regexp_replace(coalesce(text, ''), '{_INVISIBLE}', ' ', 'g')" + f", '{_MARKS}', ' ', 'g') AS c "
    f"FROM (SELECT doc_id, text, regexp_replace(text, '{_INVISIBLE}', '', 'g') AS x FROM documents)"
)


@query(f"SELECT doc_id, round(1 - {_LEFT}, 3) AS risk, round(1 - {_LEFT}, 3) >= 0.7 AS suspicious FROM ({_SCANNED})")
def injection_scan(s, d):
    return guards.scan(table(s, d, "documents")).select("doc_id", "risk", "suspicious")


@query()
def injection_neutralized(s, d):
    return guards.scan(table(s, d, "documents")).where("suspicious").select("doc_id", guards.neutralized(F.col("clean_text")).alias("safe"))


@query(r"SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_returnflag")
def sql_guard(s, d):
    """A guarded statement over two allowed views, with a common table expression."""
    for name in ("lineitem", "orders"):
        table(s, d, name).createOrReplaceTempView(name)
    done = "WITH done AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN done ON l_orderkey = o_orderkey GROUP BY l_returnflag"
    return guards.guarded(s, done, {"lineitem", "orders"})


_BAD = ["DELETE FROM lineitem", "SELECT * FROM secret", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT (SELECT max(x) FROM secret) AS m FROM lineitem", "CREATE TABLE t AS SELECT 1", "INSERT INTO lineitem SELECT * FROM lineitem", "SELECT version()", "SELECT conversion FROM lineitem", "WITH a AS (SELECT 1 AS x) SELECT * FROM a"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(i in (8, 9)).lower()})" for i in range(len(_BAD))) + ") t(n, passes)")
def sql_guard_verdicts(s, d):
    out = []
    for i, sql in enumerate(_BAD):
        try:
            guards.checked(s, sql, {"lineitem"})
            out.append((i, True))
        except PermissionError:
            out.append((i, False))
    return s.createDataFrame(out, "n int, passes boolean")


@query(rf"WITH {CHUNKS} SELECT chunk_id, CASE WHEN length(trim(coalesce(content, ''))) < 64 THEN 'short' WHEN NOT regexp_matches(content, '{WORD}') THEN 'wordless' END AS verdict FROM ch")
def chunk_verdicts(s, d):
    return chunk_texts(s, d).select("chunk_id", guards.chunk_verdict(F.col("text")).alias("verdict"))


@query(r"SELECT gq_id, CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN length(t) < 10 THEN 'too_short' WHEN length(t) > 120 THEN 'too_long' WHEN len(w) >= 20 AND len(list_distinct(w)) < 0.2 * len(w) THEN 'repetitive' END AS verdict FROM (SELECT *, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS w FROM (SELECT gq_id, trim(regexp_replace(question, '\s+', ' ', 'g')) AS t FROM generated_questions))")
def query_verdicts(s, d):
    return table(s, d, "generated_questions").select("gq_id", guards.query_verdict(F.col("question"), 120, 10).alias("verdict"))


# Routing


def _sql_route(q: str) -> str:
    r, g, n = (p.replace("'", "''") for p in (routing.RELATIONAL, routing.GRAPH, routing.NONE))
    return f"CASE WHEN regexp_matches(trim({q}), '{n}') THEN 'none 0.95' WHEN regexp_matches({q}, '{r}') AND regexp_matches({q}, '{g}') THEN 'relational,graph,vector 0.7' WHEN regexp_matches({q}, '{r}') THEN 'relational,vector 0.85' WHEN regexp_matches({q}, '{g}') THEN 'graph,vector 0.85' ELSE 'vector 0.5' END"


@query(f"SELECT item, {_sql_route('question')} AS decision FROM (SELECT gq_id AS item, question FROM generated_questions UNION ALL SELECT id, question FROM eval_cases) WHERE question IS NOT NULL")
def rule_route(s, d):
    both = table(s, d, "generated_questions").select(F.col("gq_id").alias("item"), "question").unionByName(table(s, d, "eval_cases").select(F.col("id").alias("item"), "question"))
    r = routing.routed(F.col("question"))
    return both.where("question is not null").select("item", F.concat_ws(" ", F.array_join(r["stores"], ","), r["confidence"].cast("string")).alias("decision"))


@query("SELECT gq_id, CASE WHEN t AND n THEN 'drift' WHEN t THEN 'global' ELSE 'local' END AS mode FROM (SELECT gq_id, regexp_matches(question, '" + routing.THEMATIC + r"') AS t, regexp_matches(question, '\s\p{Lu}[\p{L}\p{N}]+|[""“''][^""”'']+[""”'']') AS n FROM generated_questions WHERE question IS NOT NULL)".replace('""', '"'))
def graph_modes(s, d):
    return table(s, d, "generated_questions").where("question is not null").select("gq_id", routing.graph_mode(F.col("question")).alias("mode"))


@query()
def question_variants(s, d):
    g = table(s, d, "generated_questions").where("question is not null")
    raw = F.array(F.concat(F.lit("1. "), "question"), F.concat(F.lit("2) Tell me: "), F.coalesce("answer", F.lit(""))), F.lit("short"))
    return g.select("gq_id", routing.variants(F.col("question"), raw).alias("variants"))


@query(rf"""SELECT gq_id, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: regexp_matches(x, '\[\d+(?:\s*,\s*\d+)*\]')))::DOUBLE / len(s), 6) ELSE 1.0 END AS coverage
FROM (SELECT gq_id, list_filter(string_split(regexp_replace(answer || ' [1]', '([.!?][\"''”’)\]]*(?:\s*\[\d+(?:\s*,\s*\d+)*\])*)\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: length(trim(x)) > 15) AS s FROM generated_questions WHERE answer IS NOT NULL)""".replace('\\"', '"'))
def citation_coverage(s, d):
    g = table(s, d, "generated_questions").where("answer is not null")
    return g.select("gq_id", F.round(context.coverage(F.concat("answer", F.lit(" [1]"))), 6).alias("coverage"))
